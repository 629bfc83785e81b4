"""Pages, headings, chunks, dates and files against cases worked out by hand."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from regatta.functions import pages as pg
from regatta.functions import text as tx
from regatta.functions.citations import found_in
from regatta.operators import catalog, chunking, rml
from regatta.operators import documents as dc
from regatta.operators.chunking import Limits
from regatta.sources import sinks

PAGE = """<html><head><title>EUR-Lex - The title</title><style>p{}</style></head><body><nav>Menu</nav><header>Top</header>
<main><h1>Head</h1><p>One &amp; two<br>three</p><ul><li>first<li>second</ul></main><p>outside</p><footer>Foot</footer></body></html>"""


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


def test_plain_text_of_pages(spark):
    text = one(spark, pg.plain_text(F.col("c0"), pg.EUROPEAN), PAGE)
    assert "Menu" not in text and "Foot" not in text and "Head\n\n\n"[:5] in text
    assert "One & two\nthree" in text and "\n• first\n• second" in text and "\n\n\n" not in text
    assert one(spark, pg.plain_text(F.col("c0")), "a < b &lt;p&gt; <nav>open") == "a < b <p> open"
    assert one(spark, pg.plain_text(F.col("c0")), None) is None


def test_main_content_prefers_the_main_element():
    assert pg.main_content(PAGE) == ("EUR-Lex - The title", "Head\nOne & two\nthree\nfirst\nsecond")
    assert pg.main_content("<div class='page-content'>in</div><p>out</p>")[1] == "in"
    assert pg.main_content("<p>a</p><script>x</script><p>b</p>") == (None, "a\nb") and pg.main_content(None) == (None, None)


def test_facts_of_pages(spark):
    assert one(spark, pg.page_title(F.col("c0")), PAGE) == "The title"
    assert one(spark, pg.page_date(F.col("c0")), "on 31.12.2020 and 2021-01-02") == dt.date(2020, 12, 31)
    assert one(spark, pg.page_date(F.col("c0")), "on 45.13.2020 and 2021-01-02") == dt.date(2021, 1, 2)
    assert one(spark, pg.page_eli(F.col("c0")), '<a href="x/eli/reg/2016/679/oj">') == "eli/reg/2016/679/oj"
    for url, content, kind in (("a.PDF", "", "pdf"), ("a", "%PDF-1", "pdf"), ("a", "PK..", "docx"), ("a.md", "", "markdown"), (None, "<!DOCTYPE html>", "html"), (None, None, "text")):
        assert one(spark, pg.file_format(F.col("c0"), F.col("c1")), url, content) == kind


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("CHAPTER 1 - INTRODUCTION", ("1", "INTRODUCTION", 2)), ("Section 1.2: Scope", ("1.2", "Scope", 4)), ("ARTICLE 5", ("5", None, 3)), ("title 3", ("3", None, 1)),
        ("2.1 Scope of it", ("2.1", "Scope of it", 4)), ("(a) Who reports", ("a", "Who reports", 4)), ("2.1 lower case", None), ("Section five", None),
        ("Section 4.2(a) is", None), ("2 One number", None), ("SECTION 1 9", None), ("", None),
    ],
)
def test_headings(line, expected):
    assert rml.heading(line) == expected


def test_sections_hold_the_text_up_to_the_next_heading():
    got = list(rml.headings("before\nCHAPTER 1 - A\nx\ny\nSECTION 2: B\n\nz"))
    assert got == [("1", "A", 2, 7, 20, "x\ny"), ("2", "B", 4, 25, 37, "z")]


PARAGRAPHS = "First one. It goes on.\n\nSecond.\n \nThird paragraph is long, so long. It ends."


@pytest.mark.parametrize(
    ("strategy", "text", "limits", "expected"),
    [
        ("semantic", PARAGRAPHS, Limits(36), ["First one. It goes on.\n\nSecond.", "Third paragraph is long, so long.", "It ends."]),
        ("semantic", PARAGRAPHS, Limits(30), ["First one. It goes on.", "Second.", "Third paragraph is long, so", "long. It ends."]),
        ("sentence", "One two. Three four. Five.", Limits(14), ["One two.", "Three four.", "Five."]),
        ("sentence", "One two. three. Four five. Six", Limits(20), ["One two. three.", "Four five. Six"]),
        ("recursive", "a b\nc d\n\ne f g h i", Limits(9), ["a b\nc d", "e f g h i"]),
        ("recursive", "a b\nc d\n\ne f g h i", Limits(5), ["a b", "c d", "e f", "g h i"]),
        ("recursive", "Intro text\nSECTION 1 One\nmore\nSECTION 2 Two", Limits(21), ["Intro text", "SECTION 1 One\nmore", "SECTION 2 Two"]),
        ("fixed", "One. Two three four five", Limits(12, 4), ["One.", "ne. Two", "Two three", "ree four", "our five"]),
        ("structural", "Preface, which stays\nSECTION 1 First part of it\n1.2 Small\nPART 3 Third", Limits(50, 0, 11), ["Preface, which stays", "SECTION 1 First part of it", "PART 3 Third"]),
        ("structural", "SECTION 1. Head\nA line of it\nanother", Limits(20, 0, 5), ["SECTION 1. Head", "A line of it\nanother"]),
    ],
)
def test_chunks_end_at_the_best_place_within_reach(strategy, text, limits, expected):
    own = chunking.cut(text, strategy, limits)
    assert [c.content for c in own] == expected
    assert all(text[c.start : c.end] == c.content and len(c.content) <= limits.most for c in own)


def packed_by_hand(text, levels, most):
    """For each character in turn: is it the end of the chunk that holds the one before?"""
    edges = [{m.end() for m in level.finditer(text)} for level in levels]
    spans, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            best = [[e for e in range(at + 1, at + most + 1) if e in level] for level in edges]
            end = next((x[-1] for x in best if x), at + most)
        spans.append((at, end))
        at = end
    return spans


def test_packing_equals_a_search_by_hand():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a", "Bc", " ", ". ", "\n", "\n\n", "\nSECTION 1 ", "! "], k=rng.randrange(1, 60)))
        for name, levels in chunking.LEVELS.items():
            for most in (1, 7, 25):
                spans = packed_by_hand(text, levels, most)
                assert list(chunking.packed(text, levels, most)) == spans
                if name != "fixed":
                    assert [c.content for c in chunking.cut(text, name, Limits(most))] == [text[a:b].strip() for a, b in spans if text[a:b].strip()]


def test_chunks_keep_their_limits(spark):
    limits = Limits(500, 50, 20)
    words, stops = "Word " * 500, "Content. " * 200
    for name in chunking.STRATEGIES:
        assert [c.content for c in chunking.cut("Short text content.", name, limits)] == ([] if name == "structural" else ["Short text content."])
        for text in (words, stops, "x" * 1300, "A b.\n\n" * 300):
            own = chunking.cut(text, name, limits)
            assert own and all(text[c.start : c.end] == c.content and len(c.content) <= 500 for c in own), name
            # Nothing but white space stands between two chunks.
            assert all(not text[a.end : b.start].strip() for a, b in zip(own, own[1:])) and not text[own[-1].end :].strip(), name
        assert chunking.cut(" \n ", name, limits) == []
    fixed = chunking.cut("x" * 1200, "fixed", limits)
    assert [(c.start, c.end, c.overlap) for c in fixed] == [(0, 500, 0), (450, 950, 50), (900, 1200, 50)]
    text = "SECTION 1 First part of it\nSECTION 2. Second part of it"
    parts = chunking.cut(text, "structural", Limits(500, 50, 5))
    assert [c.section for c in parts] == ["1", "2"] and [c.content for c in chunking.merged(text, parts, 500)] == [text]
    assert chunking.merged(text, parts, 30) == parts
    docs = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, " ")], "doc_id bigint, text string")
    got = [tuple(r) for r in chunking.chunks(docs, "sentence", Limits(12)).collect()]
    assert got == [(1, 0, 2, "One two.", 0, 8, None, 2, 0), (1, 1, 2, "Three four.", 9, 20, None, 2, 0)]
    with pytest.raises(ValueError, match="no such strategy"):
        chunking.chunks(docs, "magic")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Pursuant to 42 U.S.C. § 1234, the", [("us_code", "42 U.S.C. § 1234", "42", "1234"), ("section", "§ 1234", "1234", None)]),
        ("42USC1395w-4(b)(2)", [("us_code", "42USC1395w-4(b)(2)", "42", "1395w-4(b)(2)")]),
        ("Under 45 CFR 164.502, and 45 c.f.r. 160", [("cfr", "45 CFR 164.502", "45", "164.502"), ("cfr", "45 c.f.r. 160", "45", "160")]),
        ("Regulation (EU) 2016/679 and regulation (EC) No 45/2001", [("eu_regulation", "Regulation (EU) 2016/679", "2016/679", None), ("eu_regulation", "regulation (EC) No 45/2001", "45/2001", None)]),
        ("Directive 2014/65/EU; Directive 2014/65", [("eu_directive", "Directive 2014/65/EU", "2014/65/EU", None)]),
        ("S.I. 2019/1234 (PSI 2019/1)", [("uk_si", "S.I. 2019/1234", "2019/1234", None)]),
        ("Section 1.2.3(a)(ii), Art. 5-6, article 7 and §8", [("section", "Section 1.2.3(a)(ii)", "1.2.3(a)(ii)", None), ("section", "Art. 5-6", "5-6", None), ("section", "article 7", "7", None), ("section", "§8", "8", None)]),
        ("Sections 4, U.S.C., 42 U.S. C 7, section (a), 12", []),
        ("", []),
    ],
)
def test_citations(text, expected):
    assert list(found_in(text)) == expected


def test_cleaning(spark):
    text = "A  b ,c\r\nPage 3 of 9\r\r\n \n\n- 4 -\nPage 5\nPages 5\nPage 5 of it\n-\nx.y 1.5!\x00\x07 end : "
    assert one(spark, tx.cleaned(F.col("c0")), text) == "A b, c\n\nPages 5\nPage 5 of it\n-\nx. y 1.5! end:"
    assert one(spark, tx.cleaned(F.col("c0")), None) is None and one(spark, tx.cleaned(F.col("c0")), "") == ""
    assert one(spark, tx.unified_lines(F.col("c0")), "a\t b\r\n\r\n\n\nc\rd") == "a b\n\nc\nd"


def test_normalized_texts(spark):
    signs = "\u201cﬁve\u201d \u2018x\u2019 \u2013 \u2026\u00ad\u200b §4 ¶2 Ａ"
    assert one(spark, rml.normalized(F.col("c0")), signs) == "\"five\" 'x' - ... Section 4 Paragraph 2 A"
    assert one(spark, rml.normalized(F.col("c0")), None) is None


def test_entity_hashes(spark):
    expected = int(hashlib.sha256(b"ENT-1").hexdigest(), 16) % rml.FIELD_ORDER
    assert one(spark, rml.entity_hash(F.col("c0")), "ENT-1") == str(expected) and one(spark, rml.entity_hash(F.col("c0")), None) is None
    assert 0 <= expected < rml.FIELD_ORDER


def test_dates_of_effect(spark):
    for text, day in (
        ("takes effect on MAY 25, 2018 and 2019-01-01", dt.date(2018, 5, 25)), ("see 2019-01-01 or 3 May 2017", dt.date(2019, 1, 1)),
        ("of 25 May 2018", dt.date(2018, 5, 25)), ("effective Foo 99, 2018", None), ("", None),
    ):
        assert one(spark, tx.effective_date(F.col("c0")), text) == day


def test_preprocessing_breaks_dotted_citations_as_documented(spark):
    docs = spark.createDataFrame([(1, "Pursuant to 42 U.S.C. § 1234 and 45 CFR 164.502(a)(1)."), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in dc.preprocessed(docs).collect()}
    assert {c.type for c in got[1].citations} == {"cfr", "section"} and got[2].text is None


def test_search_filters_and_guards(spark):
    need = spark.createDataFrame([(1, "basic", ["A"]), (2, None, None)], "id int, tier string, jurisdictions array<string>")
    assert catalog.filtered(need).count() == 2 and catalog.filtered(need, jurisdictions=["A", "B"]).count() == 1
    assert catalog.is_read_only("select 1 as created_at offset 2;") and not catalog.is_read_only("select 1; drop table t")
    with pytest.raises(PermissionError):
        catalog.ad_hoc(spark, {}, "drop table t")
    assert catalog.relevance(need.limit(0), "word", "id", "tier").count() == 0


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b").write_bytes(b"%PDF \xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.text) for r in sinks.documents_in(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("html", "<p>x</p>"), "b": ("pdf", None)}
    assert sinks.consumer_options("h:1", ["a", "b"], "g", True, 5)["maxOffsetsPerTrigger"] == "5"
    assert sinks.kafka_producer("h:1").options["kafka.acks"] == "all"
