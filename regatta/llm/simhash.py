"""SimHash near-duplicates found through a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` of 64 bits agree in at least
one of ``distance + 1`` blocks of bits.  For each block the fingerprints are
rotated so that the block leads, and those that share the block's value meet;
there they are sorted by the rank of the remaining bits in the Gray code, so
that neighbours differ in few bits.  Runs of neighbours become nodes that hold
the bits all members share (a mask and a pattern), runs of nodes become upper
nodes, and a search descends pairs of nodes while the differences accumulated
in shared bits stay within the distance.  Whole groups go at one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.components import components
from regatta.llm.lookup import looked_up
from regatta.llm.storage import removed, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingle hashes whose bits are unpacked at a time (64 bytes each).
PIECE = 1 << 16
#: Children of an index node, and node pairs examined at a time.
FANOUT, FRONTIER = 8, 1 << 15
#: Fingerprints that one task indexes together; larger groups are divided by further blocks.
GROUP = 50_000


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: ASCII lower case, words, word shingles with repeats, XXH64, majority per bit."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, runs)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the ``carried`` columns and signed 64-bit ``fp`` of every row; null, empty and wordless texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *carried, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(fps.view(np.int64))], names=[*own, "fp"])

    own = ["doc_id", *carried]
    return rows.mapInArrow(compute, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own) + ", fp bigint")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of 64-bit words in Gray-code order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def close_pairs(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of unsigned words within a Hamming distance, in bounded pieces.

    ``fps`` are in Gray order.  Memory is linear in their number plus one frontier.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(fps & fps, fps | fps)]
    while len(levels[-1][0]) > FANOUT:
        ands, ors = levels[-1]
        starts = np.arange(0, len(ands), FANOUT)
        levels.append((np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)))
    nodes = [(ands, ~(ands ^ ors) & none) for ands, ors in levels]  # pattern, mask of shared bits
    top = len(nodes) - 1
    i, j = np.triu_indices(len(nodes[top][0]))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack.append((level, i[FRONTIER:], j[FRONTIER:]))
            i, j = i[:FRONTIER], j[:FRONTIER]
        pattern, mask = nodes[level]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= distance
        i, j = i[near], j[near]
        if level == 0:
            apart = i < j
            yield i[apart], j[apart]
            continue
        step = np.arange(FANOUT)
        a = (i[:, None, None] * FANOUT + step[:, None] + 0 * step).ravel()
        b = (j[:, None, None] * FANOUT + 0 * step[:, None] + step).ravel()
        kept = (a <= b) & (b < len(nodes[level - 1][0]))
        stack.append((level - 1, a[kept], b[kept]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root (smallest index of the component) of each of ``n`` vertices, from pieces of edges."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != (up := root[root])).any():
                root = up
    return root


def _links(distance: int):
    """A function over partitions sorted by group that emits a spanning forest of each group's links."""

    def of_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            keys = frame["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            fps = frame["fp"].to_numpy().view(np.uint64)
            turned = frame["turned"].to_numpy().view(np.uint64)
            for at, end in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                own = fps[at:end][np.argsort(gray_rank(turned[at:end]), kind="stable")]
                root = forest(len(own), close_pairs(own, distance))
                hung = np.flatnonzero(root != np.arange(len(own)))
                if len(hung):
                    yield pd.DataFrame({"a": own[hung].view(np.int64), "b": own[root[hung]].view(np.int64)})

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            keys = frame["key"].to_numpy()
            last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1]) if len(frame) else 0
            rest = frame.iloc[last:]  # the last group may go on in the next batch
            yield from joined(frame.iloc[:last])
        if rest is not None and len(rest):
            yield from joined(rest)

    return of_groups


def _field(value: str, low: int, width: int) -> str:
    return f"(shiftrightunsigned({value}, {low}) & {(1 << width) - 1}L)"


def _spans(bits: int, parts: int) -> list[tuple[int, int]]:
    """(low bit, width) of ``parts`` nearly equal blocks that cover ``bits`` bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def linked(fps: DataFrame, distance: int = 2, group: int = GROUP) -> DataFrame:
    """Edges (``a``, ``b``) that connect all fingerprints within ``distance`` bits of each other.

    ``fps`` holds distinct values in a long column ``fp``.  Each group of
    fingerprints with one block in common yields a spanning forest of its
    links, so edges stay linear in the input.  A group of more than ``group``
    members is divided by a block of the remaining bits, by the same argument,
    and again until every group is small or no bits remain; nothing is dropped.
    Groups are told apart by a hash of their blocks; two that share it only
    cause comparisons in vain.
    """
    parts, rows = distance + 1, []
    for part, (low, width) in enumerate(_spans(64, parts)):
        up = 64 - low - width  # the block's bits go to the top, the rest keep their cyclic order
        turned = f"(shiftleft(fp, {up}) | shiftrightunsigned(fp, {64 - up}))" if up else "fp"
        rows.append(f"struct(xxhash64({part}, {_field('fp', low, width)}) as key, {turned} as turned, {turned} & {(1 << (64 - width)) - 1}L as remaining)")
    spread = fps.select("fp", F.expr(f"inline(array({', '.join(rows)}))"))
    bits, small, passed = 64 - 64 // parts, [], []
    while True:
        sizes = written(spread.groupBy("key").count().where("count > 1"), "groups")
        passed.append(sizes)
        met = spread.join(sizes, "key")
        if bits < parts or sizes.where(f"count > {group}").isEmpty():
            small.append(met.select("fp", "key", "turned"))
            break
        small.append(met.where(f"count <= {group}").select("fp", "key", "turned"))
        rows = []
        for part, (low, width) in enumerate(_spans(bits, parts)):
            without = f"(shiftleft(shiftrightunsigned(remaining, {low + width}), {low}) | (remaining & {(1 << low) - 1}L))"
            rows.append(f"struct(xxhash64(key, {part}, {_field('remaining', low, width)}) as sub, {without} as rest)")
        divided = met.where(f"count > {group}").select("fp", "turned", F.expr(f"inline(array({', '.join(rows)}))"))
        spread = written(divided.select("fp", "turned", F.col("sub").alias("key"), F.col("rest").alias("remaining")), "divided")
        passed.append(spread)
        bits -= bits // parts
    flat = reduce(DataFrame.union, small)
    # A fixed number of partitions: the work is comparing, which the bytes that adaptive execution goes by do not show.
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = flat.repartition(n, "key").sortWithinPartitions("key").mapInPandas(_links(distance), "a bigint, b bigint")
    edges = written(edges, "pairs")
    for table in passed:
        removed(table)
    return edges


def simhash_groups(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint and component of every document.

    Returns one row per input row: the id, ``fingerprint`` (16 lowercase hex
    digits), ``component_id`` (smallest id reachable over links of at most
    ``distance`` differing bits, itself included), ``fp`` (the bits as a
    signed long), ``root`` (a fingerprint that names the component, also where
    it has no id) and the columns ``carried``.  Null, empty and wordless texts have fingerprint zero and
    link like any other.  Rows with a null id take part in the links but never
    name a component (null if a component has no other); repeated rows each
    appear; extra columns are ignored; an empty table gives an empty result.
    Equal fingerprints are collapsed before any join, so large groups of
    copies cost one row.
    """
    found = written(fingerprints(docs, id_col, text_col, carried), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n__rows"))
    roots = components(linked(classes.select("fp"), distance))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n__rows", F.coalesce("root", "fp").alias("root"))
    named = written(named, "classes")
    # A component may hold a third of all classes, and a class a third of all rows.
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n__classes"))
    of_fp = looked_up(named, ids, "root", "n__classes", named.count()).select("fp", "component_id", "root", "n__rows")
    return looked_up(found, of_fp, "fp", "n__rows", found.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", *carried
    )
