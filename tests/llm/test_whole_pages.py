"""Nothing of a page but scripts and styles is dropped."""

from __future__ import annotations

import pytest

from regatta.llm.html_blocks import blocks


def texts(html):
    return [b.text for b in blocks(html)]


def test_formulas_and_fallback_texts_stay():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p>See <object data='a'>the chart</object> here.</p><script>no</script><style>no</style>"
    assert texts(page) == ["Let x=2 be.", "See the chart here."]
    assert texts("<iframe>frame</iframe><template><p>inside</p></template><p>end") == ["frame", "inside", "end"]


@pytest.mark.parametrize("tag", ["object", "svg", "math", "iframe", "template"])
def test_a_missing_end_tag_loses_nothing(tag):
    assert "after" in " ".join(texts(f"<p>before</p><{tag}><p>after</p>"))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<p>Some words <svg viewBox="0 0 1 1"><path d="M0"/></svg> more words.</p>', ["Some words more words."]),
        ("<p>An <custom-tip>odd <x-y/>tag</custom-tip> and <picture><source><img></picture><slot>a slot</slot><noscript>none</noscript>.</p>", ["An odd tag and a slotnone."]),
        ("<p>Look <svg><title>icon</title><desc>of it</desc><text>label</text></svg> here</p><p>end</p>", ["Look label here", "end"]),
        ("<svg/><title>Page</title><p>x", ["Page", "x"]),
        ('<p>a</p><script src="a.js"/>var x = 1;</script><p>b</p>', ["a", "b"]),
        ("<style/>p{}</style><p>b</p>", ["b"]),
        ("<p>a</p><script>never closed <p>b</p>", ["a"]),
        ("<p>a</p><!-- never closed <p>b</p>", ["a"]),
        ("<p>a<!-- x --> b</p>", ["a b"]),
        ("<svg><g><path/><use/><p>far</p></g></svg><section><p>near</p></section>", ["far", "near"]),
    ],
)
def test_only_block_elements_end_a_block(page, expected):
    assert texts(page) == expected


def test_self_closed_tags_are_no_ancestors():
    found = blocks("<article><svg><path/><use/></svg><p>text</p></article>")
    assert [b.path for b in found] == [("article", "p")]


def test_a_very_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i} of the article has some words.</p>" for i in range(20000)) + "</article>"
    assert texts(page) == [f"Paragraph {i} of the article has some words." for i in range(20000)]
