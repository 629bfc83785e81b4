"""Leaf blocks of HTML pages: the pieces of text between block-level tags, with their ancestors."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Tags that begin and end blocks of text; all others, unknown ones too, stand inside a block.
BLOCK = frozenset(
    """address article aside audio blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
    figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main map menu nav ol optgroup option p pre
    script search section select style summary table tbody td template textarea tfoot th thead title tr ul video""".split()
)
#: Elements of a drawing that tell about it and are never shown as text.
UNSHOWN = frozenset("title desc metadata".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style".split())
#: A start tag that closes an open element of these names first (up to the nearest stop).
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
STOPS = frozenset("article aside body div footer form header main nav section table ul ol dl blockquote".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """Text of a block (references decoded, white space single), its ancestors outermost first, and its link characters."""

    text: str
    path: tuple[str, ...]
    linked: int


def blocks(html: str) -> list[Block]:
    """Non-empty leaf blocks of a page in page order.

    An ancestor is written as its tag and the words of its class, id and role;
    only tags of ``BLOCK`` end a block or are ancestors.  Tags may be unclosed,
    crossed or cut off; comments, scripts, styles and titles of drawings hold
    no text; a bare ``<`` is text.  As in a browser, a script or style ends at
    its end tag only (a stroke at the end of its start tag means nothing), and
    where a comment, script or style is never closed the rest of the page
    belongs to it.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, tag with names
    pieces: list[tuple[str, bool]] = []
    link, drawings = False, 0

    def past(tag: str, at: int) -> int | None:
        over = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
        return over.end() if over else None

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(" ".join(p.split())) for p, in_link in pieces if in_link)
                out.append(Block(text, tuple(s[1] for s in stack), min(linked, len(text))))
            pieces.clear()

    def close(tags: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in STOPS:
                return

    at = 0
    for found in TOKEN.finditer(html):
        start = found.start()
        if start < at:  # inside an element that was passed over
            continue
        if start > at:
            pieces.append((unescape(html[at:start]), link))
        at = found.end()
        ending, tag, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag not in BLOCK or (drawings and tag in UNSHOWN):
            if tag == "br":
                pieces.append((" ", False))
            elif tag == "a":
                link = not ending
            elif tag == "svg":
                drawings = max(0, drawings - 1) if ending else drawings + (not rest.endswith("/"))
            elif drawings and tag in UNSHOWN and not ending and not rest.endswith("/"):
                at = past(tag, at) or at
            continue
        flush()
        if ending:
            link = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            at = past(tag, at) or len(html)
            continue
        close(CLOSES.get(tag, ()))
        if tag not in VOID:
            names = [w for m in NAMES.finditer(rest) for w in PART.findall((m[1] or m[2] or m[3] or "").lower())] if rest else []
            stack.append((tag, ".".join([tag, *names])))
    if at < len(html):
        pieces.append((unescape(html[at:]), link))
    flush()
    return out
