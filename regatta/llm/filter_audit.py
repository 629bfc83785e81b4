"""How filters interact: what every order of them removes, from a packed bitmap index.

``bitmap_index`` packs the rows of each partition into NumPy bitsets, one per
filter and label, a part at a time; ``subset_counts`` takes every subset of
the filters as a prefix (AND-NOT of the bitsets, then popcount) and sums the
counts of all partitions; ``orders_report`` reads every order and step off
these sums.  No row is looked at once per order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.lookup import looked_up
from regatta.llm.storage import removed, written
from regatta.llm.words import SPACE, word_count

#: Rows that are packed at a time, and parts whose sums a task holds before it hands them on.
CHUNK, PARTS = 1 << 16, 4096


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone; true where it fails.  A null text is taken as empty."""
    text = F.coalesce(text, F.lit(""))
    words, pieces = word_count(text), F.split(text, f"{SPACE}+")
    # White space at an end leaves an empty piece, which is no word; both ends leave the same one.
    distinct = F.size(F.array_distinct(pieces)) - F.array_contains(pieces, "").cast("int")
    return {
        "A": words < 100,
        "B": 100 * distinct < 80 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def with_repeats(rows: DataFrame, key: str, total: int, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether a row of a smaller ``doc_id`` has the same ``key``.

    Never true for rows without id, and such rows make nobody else's true.
    The smallest id of a key is combined before its shuffle, and keys of very
    many rows are broadcast, at most ``lookup.HUBS`` of them.
    """
    groups = rows.groupBy(key).agg(F.min("doc_id").alias("first__id"), F.count("*").alias("n__rows")).where("n__rows > 1")
    groups = written(groups, "repeats")
    found = looked_up(rows, groups, key, "n__rows", total)
    return found.withColumn(name, F.coalesce(F.col("doc_id") > F.col("first__id"), F.lit(False))).drop("first__id")


def with_labels(rows: DataFrame, labels: DataFrame, conditions: dict[str, Column], total: int) -> DataFrame:
    """``rows`` with a boolean column per condition on ``labels``: whether any label row of the id meets it."""
    met = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()))
    met = met.where(F.array_contains(F.array(*conditions), True))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n__rows"))
    found = looked_up(rows, met.join(sizes.hint("merge"), "doc_id"), "doc_id", "n__rows", total)
    return found.withColumns({n: F.coalesce(n, F.lit(False)) for n in conditions})


def _packed(flags: np.ndarray) -> bytes:
    """Booleans as bits in whole words of 64."""
    bits = np.packbits(flags, bitorder="little")
    return np.pad(bits, (0, -len(bits) % 8)).tobytes()


def bitmap_index(rows: DataFrame, flags: list[str], part: str = "part") -> DataFrame:
    """Packed bitmaps of boolean columns: rows (``part``, ``n``, ``bits``), one per part and chunk of a partition.

    ``bits`` has a bitset for each of ``flags``, in their order, of ``n`` bits
    and zeros up to a whole word.  Rows of a chunk are ordered by part, and
    each part starts at a word of its own, so that the index takes about a bit
    a row and flag, however many parts there are.  A null flag counts as false.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield chunk(held)
                held, size = [], 0
        if size:
            yield chunk(held)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        coded = table["part"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        columns = [table[f].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[order] for f in flags]
        edges = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]
        spans = list(zip(edges[:-1], edges[1:]))
        bits = [[_packed(c[a:b]) for c in columns] for a, b in spans]
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.cast(pa.string()), pa.array(np.diff(edges), pa.int64()), pa.array(bits, pa.list_(pa.binary()))], names=["part", "n", "bits"]
        )

    chosen = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags)
    return chosen.mapInArrow(index, "part string, n bigint, bits array<binary>")


def kept_by_subset(n: int, filters: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """Rows that pass all filters of a subset: counts by (all rows, then each label) and subset, a bit of its number per filter."""
    out = np.zeros((1 + len(labels), 1 << len(filters)), np.int64)
    everything = np.frombuffer(_packed(np.ones(n, bool)), np.uint64)
    kept = [everything]
    for s in range(1 << len(filters)):
        if s:
            lowest = (s & -s).bit_length() - 1
            kept.append(kept[s & (s - 1)] & ~filters[lowest])
        out[:, s] = [np.bitwise_count(x).sum() for x in (kept[s], *(kept[s] & label for label in labels))]
    return out


def subset_counts(index: DataFrame, filters: int, labels: int) -> DataFrame:
    """Rows (``part``, ``subset``, ``counts``): what is left after the filters of each subset, of all rows and of each label's.

    The first ``filters`` bitsets of the index are filters, the next
    ``labels`` are labels.  Every subset of every part is there, also with
    zeros.  Counts are summed in each partition and then over all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, n, bits in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "bits"))):
                sets = [np.frombuffer(b, np.uint64) for b in bits]
                own = kept_by_subset(n, sets[:filters], sets[filters : filters + labels])
                sums[part] = sums[part] + own if part in sums else own
            if len(sums) > PARTS:
                yield rows_of(sums)
                sums = {}
        yield rows_of(sums)

    def rows_of(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        subsets = 1 << filters
        counts = [c for own in sums.values() for c in own.T.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p for p in sums for _ in range(subsets)], pa.string()),
                pa.array(list(range(subsets)) * len(sums), pa.int32()),
                pa.array(counts, pa.list_(pa.int64())),
            ],
            names=["part", "subset", "counts"],
        )

    found = index.mapInArrow(count, "part string, subset int, counts array<bigint>")
    each = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(1 + labels)]
    return found.groupBy("part", "subset").agg(*each).select("part", "subset", F.array(*(f"c{i}" for i in range(1 + labels))).alias("counts"))


REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "lost array<bigint>, shapley bigint"
)


def _report_of(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """Every order and step of one part from the counts by (all rows and labels, subset)."""
    n = len(letters)
    full, bit = (1 << n) - 1, {x: 1 << i for i, x in enumerate(letters)}
    left = counts[0].tolist()
    unique = {x: left[full ^ b] - left[full] for x, b in bit.items()}
    without = {x: [s for s in range(full + 1) if not s & b] for x, b in bit.items()}
    # A subset of size k comes before a filter in k! (n - 1 - k)! orders.
    shapley = {x: sum(factorial(k := s.bit_count()) * factorial(n - 1 - k) * (left[s] - left[s | bit[x]]) for s in without[x]) for x in letters}
    for order in permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            after = before | bit[x]
            gone = (counts[:, before] - counts[:, after]).tolist()
            fails = left[0] - left[bit[x]]
            yield part, "".join(order), step, left[after], gone[0], fails - gone[0], unique[x], gone[1:], shapley[x]
            before = after


def orders_report(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the counts by subset.

    ``kept`` and ``removed`` are after and by this step; ``redundant`` fail
    its filter but are gone already; ``unique_fails`` fail this filter only;
    ``lost`` are those of each label that the step removes; ``shapley`` is
    what the filter removes, summed over all orders.  A task sees one part's
    counts at a time, ``2 ** len(letters)`` short rows.
    """
    of_part = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "counts"))).alias("by_subset"))
    names = [f.split()[0] for f in REPORT.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.int64()]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, by_subset in zip(batch.column("part").to_pylist(), batch.column("by_subset").to_pylist()):
                rows = list(_report_of(part, np.array([s["counts"] for s in by_subset]).T, letters))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return of_part.mapInArrow(report, REPORT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of filters A to E on whole texts, by language.

    A: under 100 words; B: few distinct words; C: many capitals; D: holds a
    symbol; E: the text of a smaller ``doc_id``, removed or not.  Returns
    ``part``, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and
    ``shapley`` for each part, all 120 orders and their five steps.

    A null text is empty; a null language is the part ``''``.  Rows without
    an id never fail E and have no label; rows that repeat an id count each,
    none of them fails E because of another, and all have its labels; of
    labels that repeat an id any may say good or toxic.  Extra columns are
    ignored; an empty table has no part and gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"),
        *(c.alias(n) for n, c in text_filters(F.col("text")).items()),
    )
    rows = written(measured, "measured")
    total = rows.count()
    marked = with_repeats(rows, "same", total, "E").drop("same")
    rated = with_labels(marked, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, total)
    letters = "ABCDE"
    counts = written(subset_counts(bitmap_index(rated, [*letters, "good", "toxic"]), len(letters), 2), "counts")
    removed(rows)
    report = orders_report(counts, letters)
    return report.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        F.col("lost")[0].alias("good_lost"), F.col("lost")[1].alias("toxic_lost"), "shapley",
    )


SQL = r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents),
f as (
    select doc_id, part,
        (len(w) < 100)::int
        + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
    from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (
    select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
    from f left join l using (doc_id) group by part, mask),
x(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from x a, x b, x c, x d, x e
    where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (
    select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
    from o, (select unnest(generate_series(1, 5))::int as step)),
r as (
    select part, filter_order, step, bit,
        coalesce(sum(n) filter (where (mask & (earlier | bit)) = 0), 0) as kept,
        coalesce(sum(n) filter (where (mask & earlier) = 0 and (mask & bit) <> 0), 0) as removed,
        coalesce(sum(n) filter (where (mask & earlier) <> 0 and (mask & bit) <> 0), 0) as redundant,
        coalesce(sum(n) filter (where mask = bit), 0) as unique_fails,
        coalesce(sum(good) filter (where (mask & earlier) = 0 and (mask & bit) <> 0), 0) as good_lost,
        coalesce(sum(toxic) filter (where (mask & earlier) = 0 and (mask & bit) <> 0), 0) as toxic_lost
    from m, s group by part, filter_order, step, bit)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
    unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""
