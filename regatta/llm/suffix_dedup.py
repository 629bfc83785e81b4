"""Removal of repeated passages, exact to the byte, by sharded suffix arrays.

A passage is a string of ``length`` bytes; one is removed where it also starts
earlier.  Every such string has an anchor: the ``GRAM``-byte piece of it with
the smallest hash, the same wherever the string stands.  Around an anchor all
strings that it can represent lie within a neighbourhood.

1. One pass finds the anchors and hashes their neighbourhoods.  Equal
   neighbourhoods hold equal strings, so only the first of each kind goes on
   and the later ones are removed whole; each task does this for its own rows
   before anything is shuffled.
2. Anchors with different neighbourhoods (the edges of repeated passages) are
   divided by where the anchor lies in their strings; the strings of one
   division share most of their bytes, and the hash of the shared bytes sends
   all that can be equal to one shard.  A key with too many snippets for one
   shard is divided again, which lets its strings share more bytes, until
   each shard is small or a division holds one string only.
3. Each shard builds a suffix array by induced sorting and finds equal strings
   by permuted common prefixes of at least ``length``.  The bytes that all
   strings of a snippet share stand in it as one symbol, equal for equal bytes.
4. The removed spans go back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.llm.columns import fresh
from regatta.llm.storage import removed, written
from regatta.llm.suffix_array import permuted_lcp, suffix_array
from regatta.llm.worker import let_go, trimmed

GRAM = 32
#: Divisions of an anchor's strings by the anchor's place in them, and parts that a division is cut into when its key is large.
DIVISIONS, FINER = 2, 4
#: Bytes hashed at a time, and bytes of the snippets of one suffix array, which has about half as many symbols.
PIECE, SHARD = 1 << 19, 1 << 19
#: Pieces whose anchors are gathered before they are sent on, and bytes of snippets in one batch.
GATHERED, SENT = 16, 1 << 21
#: Snippets of one key that one shard takes; a key with more of them is divided again.
GROUP = 15_000
#: An anchor is hot with more rows than this and than one in ``HOT`` of all, so that there are at most ``HOT`` hot ones.
MANY, HOT = 100_000, 10_000

_RANDOM = np.random.default_rng(20240607)
_TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A second, independent value for each byte, for a second hash of the same strings.
_SECOND = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_EMPTY = np.uint64(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class _Hasher:
    """Hashes of any substring of a byte array, from sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        n = len(data)
        if n + 1 > len(_Hasher.up):
            _Hasher.up, _Hasher.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        self.sums = np.r_[_EMPTY, np.cumsum(table[data] * _Hasher.up[:n])]

    up, down = _powers(_BASE, 1 << 10), _powers(_INVERSE, 1 << 10)

    def every(self, width: int) -> np.ndarray:
        """Hash of each substring of ``width`` bytes."""
        sums = self.sums
        return _mixed((sums[width:] - sums[:-width]) * _Hasher.down[: len(sums) - width])

    def at(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[high] - self.sums[low]) * _Hasher.down[low])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return out if have == width else pick(out[: len(values) - width + 1], out[width - have :])


def _anchors(pieces: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """Anchors of some pieces of documents.

    A piece is (row, place of its first byte in the document, first string
    start that counts, bytes); its bytes reach beyond the strings that count by
    an anchor's neighbourhood or to the document's ends.  Returns row, place in
    the document, anchor hash and neighbourhood hash.
    """
    width = length - GRAM + 1
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    ends = np.cumsum(sizes)
    hasher = _Hasher(data)
    grams = hasher.every(GRAM)
    least = _sliding(grams, width, np.minimum)  # by string start
    least = np.r_[least, np.zeros(len(data) - len(least), np.uint64)]
    for (_, _, first, own), end in zip(pieces, ends, strict=True):
        begin = end - len(own)
        least[begin : begin + first] = 0
        least[max(begin, min(begin + first + PIECE, end - length + 1)) : end] = 0
    reach = _sliding(np.r_[np.zeros(width - 1, np.uint64), least[: len(grams)]], width, np.maximum)
    at = np.flatnonzero((reach == grams) & (reach > 0))
    piece = np.searchsorted(ends, at, side="right")
    start = ends - sizes
    low, high = np.maximum(at - width + 1, start[piece]), np.minimum(at + length, ends[piece])
    shape = ((at - low) * (2 * length) + (high - at)).astype(np.uint64)
    around = _mixed(hasher.at(low, high) ^ (shape * _TABLE[7]))
    rows = np.array([p[0] for p in pieces])[piece]
    place = at - start[piece] + np.array([p[1] for p in pieces])[piece]
    return rows, place, grams[at], around


def _pieces(texts: pa.Array, length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Whole texts in groups of about ``PIECE`` bytes; longer texts in overlapping pieces."""
    width = length - GRAM + 1
    group: list[tuple[int, int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        view = text.as_buffer()
        if view is None or len(view) < length:
            continue
        n = len(view)
        for begin in range(0, n - length + 1, PIECE):
            low, high = max(0, begin - width), min(n, begin + PIECE + 2 * length)
            group.append((row, low, begin - low, view[low:high].to_pybytes()))
            size += high - low
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _find_anchors(length: int):
    """Anchors; each is marked as the first of its kind among those gathered with it, or a later one."""

    def first_seen(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, place, gram, around = (np.concatenate(x) for x in zip(*found))
        key, tie = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("k", "tie"))
        order = np.lexsort((place, tie, key, around, gram))
        key, tie, place, gram, around = (x[order] for x in (key, tie, place, gram, around))
        new = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])]
        again = np.r_[False, (key[1:] == key[:-1]) & (tie[1:] == tie[:-1]) & (place[1:] == place[:-1])] & ~new
        keep = ~again
        return pa.RecordBatch.from_arrays(
            [
                pa.array(gram.view(np.int64)[keep]), pa.array(around.view(np.int64)[keep]), pa.array(key[keep]),
                pa.array(tie[keep]), pa.array(place[keep]), pa.array(new[keep]),
            ],
            names=["gram", "around", "k", "tie", "place", "first"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # what an earlier step has left in this worker
        for batch in batches:
            groups = _pieces(batch.column("bytes"), length)
            while found := [_anchors(group, length) for group in islice(groups, GATHERED)]:
                yield first_seen(batch, found)
        trimmed()

    return find


def _firsts(df: DataFrame, group: list[str], content: str, order: list[str]) -> DataFrame:
    """Add ``repeat`` (behind the first row of its group and content) and ``mixed`` (its group has other contents)."""
    same, all_of = Window.partitionBy(*group, content).orderBy(*order), Window.partitionBy(*group)
    return df.withColumn("repeat", F.rank().over(same) > 1).withColumn(
        "mixed", F.min(content).over(all_of) < F.max(content).over(all_of)
    )


def _repeats(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows behind the first of their group, for groups of any size: a minimum, combined before its shuffle, and a join."""
    place = F.struct(*order)
    first = df.groupBy(*group).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(first, group).where(place > F.col("_first")).drop("_first")


def _snippets(length: int, again: bool):
    """Hashes of the bytes around the anchors of a document, a row for each division that has strings.

    A division is a range of places (``a`` to ``b`` - 1) of the anchor in its
    strings.  At first there are ``DIVISIONS`` of each anchor; ``again``, those
    that a document asks for are cut into ``FINER`` parts, and contents are hashed
    independently of the shared bytes.
    """
    width = length - GRAM + 1
    edges = np.array([width * i // DIVISIONS for i in range(DIVISIONS + 1)])

    def divisions(row: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = row.values
        if not again:
            at = np.asarray(values)
            return np.repeat(at, DIVISIONS), np.tile(edges[:-1], len(at)), np.tile(edges[1:], len(at))
        at, a, b = (np.asarray(values.field(c)) for c in ("place", "a", "b"))
        step = np.arange(FINER)
        low = a[:, None] + (b - a)[:, None] * step // FINER
        high = a[:, None] + (b - a)[:, None] * (step + 1) // FINER
        held = (low < high).ravel()
        return np.repeat(at, FINER)[held], low.ravel()[held], high.ravel()[held]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for row, (text, asked) in enumerate(zip(batch.column("bytes"), batch.column("asked"), strict=True)):
                data = np.frombuffer(text.as_py(), np.uint8)
                n = len(data)
                at, a, b = divisions(asked)
                hasher = _Hasher(data)
                whole = _Hasher(data, _SECOND) if again else hasher
                first, last = np.maximum(at - b + 1, 0), np.minimum(at - a, n - length)  # string starts
                has = first <= last
                p, a, b, first, last = at[has], a[has], b[has], first[has], last[has]
                shared = _mixed(hasher.at(p - a, p + length - b + 1) ^ ((a * 512 + b).astype(np.uint64) * _BASE))
                content = _mixed(whole.at(first, last + length) ^ ((p - first) * 512 + last - first).astype(np.uint64))
                out.append((np.full(len(p), row), shared, content, first, last + length, p - first, a, b))
            if not out:
                continue
            row, shared, content, first, end, inside, a, b = (np.concatenate(x) for x in zip(*out))
            where = pa.array(row)
            small = lambda x: pa.array(x.astype(np.int16))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shared.view(np.int64)), pa.array(content.view(np.int64)), batch.column("k").take(where),
                    batch.column("tie").take(where), pa.array(first), pa.array(end), small(inside), small(a), small(b),
                ],
                names=["shared", "content", "k", "tie", "low", "high", "inside", "a", "b"],
            )

    return cut


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a document's snippets, and where in them those stand that all their strings share."""
    for batch in batches:
        rows, key, place, bits, start, shares, size = [], [], [], [], [], [], 0

        def sent() -> pa.RecordBatch:
            one = pa.array(np.array(rows, np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), batch.column("k").take(one), batch.column("tie").take(one), pa.array(place, pa.int64()),
                 pa.array(bits, pa.binary()), pa.array(start, pa.int16()), pa.array(shares, pa.int16())],
                names=["shared", "k", "tie", "low", "bits", "start", "shares"],
            )

        for row, (text, snippets) in enumerate(zip(batch.column("bytes"), batch.column("snippets"), strict=True)):
            data, values = text.as_py(), snippets.values
            for shared, low, high, at, n in zip(*(values.field(c).to_pylist() for c in ("shared", "low", "high", "start", "shares")), strict=True):
                key.append(shared)
                place.append(low)
                bits.append(data[low:high])
                start.append(at)
                shares.append(n)
                rows.append(row)
                size += high - low
                if size >= SENT:
                    yield sent()
                    rows, key, place, bits, start, shares, size = [], [], [], [], [], [], 0
        yield sent()


def repeated_strings(
    bits: list[bytes], key: np.ndarray, tie: np.ndarray, low: np.ndarray, start: np.ndarray, shares: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Snippets (indices) and places of strings of ``length`` bytes that an earlier snippet also has.

    All strings of a snippet hold its ``shares`` bytes from ``start`` on; these
    become one symbol, the same for the same bytes, so strings are equal if
    their symbols are.  Snippets are joined with separators, sorted by one
    suffix array; strings that start a common prefix of all their symbols are
    equal, and all but the earliest (document, place) of them are reported.
    """
    names: dict[bytes, int] = {}
    start, shares = start.astype(np.int64), shares.astype(np.int64)
    inner = list(zip(bits, start.tolist(), (start + shares).tolist(), strict=True))
    shared = np.array([names.setdefault(b[i:j], len(names)) for b, i, j in inner])
    sizes = np.array([len(b) for b in bits]) - shares + 1
    need = length - shares + 1  # symbols of a string
    text = np.zeros(int(sizes.sum()) + len(bits), np.uint32)
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    body = np.ones(len(text), bool)
    body[starts + sizes] = False
    text[body] = np.frombuffer(b"".join(b[: i + 1] + b[j:] for b, i, j in inner), np.uint8).astype(np.uint32) + 1
    text[starts + start] = shared + 257
    order = suffix_array(text)
    snippet = np.repeat(np.arange(len(bits), dtype=np.int32), sizes + 1)
    left = np.repeat((starts + sizes).astype(np.int32), sizes + 1) - np.arange(len(text), dtype=np.int32)
    common = permuted_lcp(text, order, int(need.max()))[order]
    whole = left[order] >= need[snippet[order]]
    order, common = order[whole], common[whole]  # a suffix between two that agree in a whole string is whole itself
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = snippet[order]
    group = np.cumsum(np.r_[True, common[1:] < need[of[1:]]])
    place = low[of] + order - starts[of]
    turn = np.lexsort((place, tie[of], key[of], group))
    group, of, place = group[turn], of[turn], place[turn]
    head = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0))
    later = (key[of] != key[of[head]]) | (tie[of] != tie[of[head]]) | (place != place[head])
    return of[later], place[later]


def _runs(of: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge strings of one snippet that overlap or touch: snippet, low, high."""
    turn = np.lexsort((place, of))
    of, place = of[turn], place[turn]
    new = np.r_[True, (of[1:] != of[:-1]) | (place[1:] > place[:-1] + length)]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:] - 1, len(of) - 1]
    return of[heads], place[heads], place[tails] + length


def _shards(length: int):
    """Cut a sorted partition into shards of whole groups and mark the repeated strings of each."""

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        key, tie, low, start, shares = (frame[c].to_numpy() for c in ("k", "tie", "low", "start", "shares"))
        of, place = repeated_strings(frame["bits"].tolist(), key, tie, low, start, shares, length)
        if not len(of):
            return pd.DataFrame({"k": key[:0], "tie": tie[:0], "low": low[:0], "high": low[:0]})
        of, lo, hi = _runs(of, place, length)
        return pd.DataFrame({"k": key[of], "tie": tie[of], "low": lo, "high": hi})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            while len(frame):
                total = np.cumsum(frame["bits"].str.len().to_numpy())
                over = np.flatnonzero(size + total >= SHARD)
                if not len(over):
                    waiting.append(frame)
                    size += int(total[-1])
                    break
                cut = int(over[0])
                shared = frame["shared"].to_numpy()
                later = np.flatnonzero(shared[cut + 1 :] != shared[cut:-1])
                if not len(later):  # the group goes on in the next batch
                    waiting.append(frame)
                    size += int(total[-1])
                    break
                end = cut + 1 + int(later[0])
                yield solved(pd.concat([*waiting, frame.iloc[:end]], ignore_index=True))
                waiting, size, frame = [], 0, frame.iloc[end:]
        if waiting:
            yield solved(pd.concat(waiting, ignore_index=True))
        trimmed()

    return run


ID_COLS = "k bigint, tie bigint"


def _neighbourhoods(keyed: DataFrame, length: int) -> DataFrame:
    """Places of anchors: later ones of equal neighbourhoods (``repeat``), and first ones of anchors that have several kinds."""
    found = keyed.mapInArrow(_find_anchors(length), f"gram bigint, around bigint, {ID_COLS}, place bigint, first boolean")
    found = written(found, "anchors")
    order = ["k", "tie", "place"]
    firsts = found.where("first").select("gram", "around", *order)
    least = max(MANY, firsts.count() // HOT)
    hot = firsts.groupBy("gram").agg(F.count("*").alias("_n")).where(F.col("_n") > least).select("gram", F.lit(True).alias("hot"))
    hot = written(hot, "hot")
    marked = firsts.join(F.broadcast(hot), "gram", "left")  # at most HOT rows
    cold = _firsts(marked.where("hot is null"), ["gram"], "around", order).where("repeat or mixed").select(*order, "repeat")
    # Rows of a hot anchor meet by neighbourhood; such an anchor has several kinds.
    crowd = marked.where("hot")
    later = _repeats(crowd, ["gram", "around"], order).select("gram", "around", *order)
    crowd = later.select(*order, F.lit(True).alias("repeat")).union(crowd.join(later, ["gram", "around", *order], "left_anti").select(*order, F.lit(False)))
    seen = cold.union(found.where("not first").select(*order, F.lit(True)))
    seen = written(seen.union(crowd) if not hot.isEmpty() else seen, "neighbourhoods")
    removed(found)
    removed(hot)
    return seen


def _divided(keyed: DataFrame, places: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Snippets that meet others: whole repeats of earlier ones as spans, and those whose bytes must be compared, with their key.

    Keys with more than ``GROUP`` snippets are divided again; divisions of one
    place hold one string each, so that all but its first are repeats.
    """
    spans, opened = [], []
    asked, again = places, False
    order = ["k", "tie", "low"]
    while True:
        cut = keyed.join(asked, ["k", "tie"]).select("bytes", "asked", "k", "tie")
        schema = f"shared bigint, content bigint, {ID_COLS}, low bigint, high bigint, inside smallint, a smallint, b smallint"
        snippets = written(cut.mapInArrow(_snippets(length, again), schema), "snippets")
        sizes = written(snippets.groupBy("shared").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        met = snippets.join(sizes, "shared")
        small = _firsts(met.where(f"n <= {GROUP}"), ["shared"], "content", order).where("repeat or mixed")
        shares = (F.lit(length + 1) - F.col("b") + F.col("a")).cast("smallint")
        start = (F.col("inside") - F.col("a")).cast("smallint")
        open_ = written(small.select(*order, "high", "shared", start.alias("start"), shares.alias("shares"), "repeat"), "open")
        spans.append(open_.where("repeat").select(*order, "high"))
        opened.append(open_.where("not repeat").drop("repeat"))
        if not sizes.where(f"n > {GROUP}").isEmpty():
            large = met.where(f"n > {GROUP}")
            same = _repeats(large.where("b - a = 1"), ["shared", "content"], order)
            spans.append(written(same.select(*order, "high"), "same"))
            more = large.where("b - a > 1").groupBy("k", "tie").agg(
                F.collect_set(F.struct((F.col("low") + F.col("inside")).alias("place"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))).alias("asked")
            )
            asked, again = written(more, "asked"), True
        else:
            asked = None
        removed(snippets)
        removed(sizes)
        if asked is None or asked.isEmpty():
            return spans, opened


def removed_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte spans to remove: ``k`` (id; the largest long for null), ``tie`` (hash of the text), ``low``, ``high``.

    Spans of one document may overlap.  Documents are ordered by ``k``, ``tie``.
    """
    keyed = _keyed(docs, id_col, text_col)
    width = length - GRAM + 1
    seen = _neighbourhoods(keyed, length)
    low = F.greatest(F.col("place") - (width - 1), F.lit(0))
    marks = [seen.where("repeat").select("k", "tie", low.alias("low"), (F.col("place") + length).alias("high"))]
    places = seen.where("not repeat").groupBy("k", "tie").agg(F.array_sort(F.collect_set("place")).alias("asked"))
    whole, opened = _divided(keyed, places, length)
    marks += whole
    wanted = reduce(DataFrame.union, opened).groupBy("k", "tie").agg(F.collect_set(F.struct("shared", "low", "high", "start", "shares")).alias("snippets"))
    bits = keyed.join(wanted, ["k", "tie"]).select("bytes", "snippets", "k", "tie")
    bits = bits.mapInArrow(_fetched, f"shared bigint, {ID_COLS}, low bigint, bits binary, start smallint, shares smallint")
    shards = bits.repartition("shared").sortWithinPartitions("shared", "k", "tie", "low")
    marks.append(shards.mapInPandas(_shards(length), f"{ID_COLS}, low bigint, high bigint"))
    spans = written(reduce(DataFrame.union, marks), "spans")
    for used in [seen, *whole, *opened]:
        removed(used)
    return spans


def _tie(text: Column) -> Column:
    """Tells documents of one id apart (those with a null id too)."""
    return F.xxhash64(text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))
    return docs.select(key.alias("k"), _tie(text).alias("tie"), text.cast("binary").alias("bytes"))


def _merged(low: np.ndarray, high: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Union of spans, cut at the end of the text; spans that touch become one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.minimum(np.maximum.accumulate(high[order]), n)
    new = np.r_[True, low[1:] > high[:-1]]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:] - 1, len(low) - 1]
    return list(zip(low[heads].tolist(), high[tails].tolist()))


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())]
)


def _cut(with_text: bool):
    @F.pandas_udf(RESULT)
    def cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, low, high in zip(texts, lows, highs, strict=True):
            data = text or b""
            spans = _merged(np.asarray(low), np.asarray(high), len(data)) if low is not None and len(low) else []
            kept = data
            if spans:
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            text_out = kept.decode("utf-8", "ignore") if with_text else None
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), text_out))
        return pd.DataFrame(rows, columns=RESULT.names)

    return cut


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of the documents and ``dedup``: n_bytes, n_removed, n_spans, kept_sha256 and the kept text.

    Every byte of a ``length``-byte string that also starts earlier (in a
    document of a smaller id, or earlier in the same) is removed; strings are
    judged on the input and never cross documents.  The kept text drops parts
    of characters that a removal cut through; the hash is over all kept bytes.

    A null text is empty; texts shorter than ``length`` are kept whole; null
    ids come last; rows that repeat an id and its text are one document and
    get the same result, rows that repeat an id with another text are ordered
    by a hash of it; extra columns pass through (one that is named ``dedup`` is
    replaced); an empty table gives an empty result.  Texts of any length are
    read in overlapping pieces.
    """
    spans = removed_spans(docs, length, id_col, text_col)
    k, tie, low, high = (fresh(c, docs.columns) for c in ("_k", "_tie", "_low", "_high"))
    lists = spans.groupBy(F.col("k").alias(k), F.col("tie").alias(tie)).agg(F.collect_list("low").alias(low), F.collect_list("high").alias(high))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key: Column = F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))
    met = docs.join(lists, (key == F.col(k)) & (_tie(text) == F.col(tie)), "left")
    cut = _cut(with_text)(F.col(text_col).cast("binary"), F.col(low), F.col(high))
    return met.select(*(docs[c] for c in docs.columns if c.lower() != "dedup"), cut.alias("dedup"))
