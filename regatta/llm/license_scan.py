"""License scans by ordered signature rules over the words of whole texts.

Each rule of ``license_rules`` is tried only on texts that hold its keywords.
Its finds are intervals of words.  A find whose interval lies within that of a
find of an earlier kind, or within a longer one of its own kind, is
suppressed, so that "GNU Lesser General Public License" is no find of the
plain one, and a whole license text is one find.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.license_rules import KINDS, RULES

#: Phrases whose places always count, whatever the rules find.  Fixed values of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Bytes of words after A-Z are lower-cased; all others below 0x80 part words.  Bytes of other characters are letters.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    """A signature: ``words`` must all be in a text before ``pattern`` is tried on it."""

    number: int
    kind: str
    label: str
    words: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


@dataclass(frozen=True)
class Find:
    """Where a rule matches: words ``first`` up to, but not including, ``end``."""

    rule: Rule
    first: int
    end: int


def parsed(lines: str) -> list[Rule]:
    """The rules of a listing; each matches whole words between blanks."""
    found = []
    for line in filter(str.strip, lines.splitlines()):
        kind, label, words, pattern = line.split(None, 3)
        if kind not in KINDS:
            raise ValueError(f"unknown kind of rule: {line}")
        whole = re.compile(rf"(?<= )(?:{pattern.replace('$)', ' $)')})(?= )".encode())
        found.append(Rule(len(found), kind, label, tuple(w.encode() for w in words.split(",")), whole))
    return found


class Scanner:
    """The rules, by the first of their keywords."""

    def __init__(self, rules: list[Rule], phrases: dict[str, str]):
        self.phrases = {f" {p} ".encode(): label for p, label in phrases.items()}
        self.by_word: dict[bytes, list[Rule]] = {}
        for rule in rules:
            self.by_word.setdefault(rule.words[0], []).append(rule)
        self.keywords = frozenset(w for rule in rules for w in rule.words)

    def gated(self, words: list[bytes]) -> list[Rule]:
        """Rules all of whose keywords are among the words, in their order."""
        held = self.keywords.intersection(words)
        rules = (r for w in held for r in self.by_word.get(w, ()) if held.issuperset(r.words))
        return sorted(rules, key=lambda r: r.number)

    def places(self, line: bytes) -> dict[str, list[int]]:
        """Starts of each phrase, counted in words; ``line`` is the text's words with a blank around each."""
        out = {}
        for phrase, label in self.phrases.items():
            starts, at, word, seen = [], line.find(phrase), 0, 0
            while at >= 0:
                word, seen = word + line.count(b" ", seen, at), at
                starts.append(word)
                at = line.find(phrase, at + 1)
            if starts:
                out[label] = starts
        return out

    def finds(self, words: list[bytes], line: bytes) -> list[Find]:
        """What the rules find and other finds do not suppress."""
        found, starts = [], None
        for rule in self.gated(words):
            for match in rule.pattern.finditer(line):
                if starts is None:  # the place in the line of each word
                    starts = list(accumulate((len(w) + 1 for w in words), initial=1))
                first = bisect_right(starts, match.start()) - 1
                found.append(Find(rule, first, bisect_right(starts, match.end() - 1)))
        return unsuppressed(found)


def unsuppressed(finds: list[Find]) -> list[Find]:
    """Finds that lie within no find of an earlier kind, nor within a longer, or equal and earlier, one of their own.

    Suppressed finds suppress nothing themselves; what lies within one lies
    within its suppressor too.  Sorted starts with the largest end so far
    answer each question by one search, whatever the number of finds.
    """
    kept: list[Find] = []
    for kind in KINDS:
        spans = sorted((f.first, f.end) for f in kept)
        starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
        farthest = -1
        for find in sorted((f for f in finds if f.rule.kind == kind), key=lambda f: (f.first, -f.end, f.rule.number)):
            before = bisect_right(starts, find.first)
            within = before > 0 and reach[before - 1] >= find.end
            if not within and find.end > farthest:
                kept.append(find)
                farthest = find.end
    return sorted(kept, key=lambda f: (f.first, f.end, f.rule.number))


def sureness(labels_and_kinds: set[tuple[str, str]]) -> float:
    """Between 0 and 1: one minus the product of the doubts of each label and kind found."""
    doubt = 1.0
    for _, kind in sorted(labels_and_kinds):
        doubt *= 1.0 - KINDS[kind]
    return round(1.0 - doubt, 6)


@cache
def _scanner() -> Scanner:
    return Scanner(parsed(RULES), PHRASES)


def scan(text: bytes, scanner: Scanner) -> tuple[int, list[int], set[str], list[Find]]:
    """Number of words, places of all phrases, their labels, and the finds of a text in UTF-8."""
    words = text.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    places = scanner.places(line)
    return len(words), sorted(p for starts in places.values() for p in starts), set(places), scanner.finds(words, line)


FIND = "struct<rule:int,kind:string,label:string,first_word:bigint,end_word:bigint>"
SCHEMA = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
    "labels": pa.string(), "score": pa.float64(),
    "finds": pa.list_(pa.struct([("rule", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])),
}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that whole texts hold, by phrases and by signature rules.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in
    lower case.  Returns one row per input row: the id, ``n_words``;
    ``n_base``, ``first_word`` and ``last_word`` of the places of ``PHRASES``
    (words counted from 0; null without a place), ``base_labels`` of these
    places; ``labels``, these and those of the rules (distinct, sorted, joined
    by commas); ``score``, how sure it is that there is a license at all; and
    ``finds``, an array of (rule, kind, label, first_word, end_word) of the
    rules' finds in order of place.

    A null text is empty: no words, empty labels, score 0.  Null and repeated
    ids pass through, extra columns are ignored, an empty table gives an empty
    result.  No rule reads beyond a bounded number of words, so the time of a
    text is linear in its length; memory is a small multiple of it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            out = {name: [] for name in SCHEMA}
            for text in batch.column("text"):
                n, places, base, finds = scan(text.as_py(), scanner)
                pairs = {(f.rule.label, f.rule.kind) for f in finds} | {(label, "mention") for label in base}
                values = (
                    n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)),
                    ",".join(sorted({label for label, _ in pairs})), sureness(pairs),
                    [{"rule": f.rule.number, "kind": f.rule.kind, "label": f.rule.label, "first_word": f.first, "end_word": f.end} for f in finds],
                )
                for name, value in zip(SCHEMA, values, strict=True):
                    out[name].append(value)
            arrays = [pa.array(out[name], kind) for name, kind in SCHEMA.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *SCHEMA])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    columns = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return rows.mapInArrow(run, f"doc_id {id_type}, {columns}, finds array<{FIND}>")
