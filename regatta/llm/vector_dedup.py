"""Embedding near-duplicates by an exact metric range join.

Unit vectors with a cosine of at least c lie within r = sqrt(2 - 2c) of each
other.  Each vector's home is the cell of its nearest pivot.  A partner y of x
can be at home in the cell of pivot p only if, with q the pivot of x,

* d(x, p) - d(x, q) <= 2 r (triangle inequality over y),
* d(x, p) <= r + the largest distance of p to a vector of its cell, and
* (d(x, p)^2 - d(x, q)^2) / (2 d(p, q)) <= r (x's distance to the border of p and q).

x visits the cells that pass all three and have a higher number than its own,
so that each pair meets once, and the pairs of a cell are compared there and
nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.components import components
from regatta.llm.lookup import looked_up
from regatta.llm.simhash import forest
from regatta.llm.storage import removed, written

#: Fewest and most pivots, and vectors that the fitting of pivots reads (the only bounded sample; all vectors are joined).
LEAST, PIVOTS, SAMPLE = 4, 1024, 8192
#: Home vectors and guests that one task compares at a time.
HOME, GUESTS = 16384, 65536
#: Slack for rounding in distances that choose cells (never in the final test).
ROUNDING = 1e-6
#: Seconds that a compared pair and a copied vector cost, which weigh when the number of pivots is chosen.
PAIR_COST, COPY_COST = 5e-9, 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, stored as bytes, as a matrix of doubles."""
    width = len(column[0].as_buffer()) // 8 if len(column) else 0
    return np.frombuffer(b"".join(v.as_py() for v in column), np.float64).reshape(-1, width) if width else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_pivots(vectors: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` of the unit vectors far from each other (each is the farthest from those before it)."""
    chosen = [0]
    nearest = 2 - 2 * vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        far = int(nearest.argmax())
        if nearest[far] <= 1e-12:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, 2 - 2 * vectors @ vectors[far])
    return vectors[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))


def visits(d: np.ndarray, between: np.ndarray, radii: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and which cells it visits, from its distances to the pivots and those of the pivots to each other."""
    home = d.argmin(1)
    own = d[np.arange(len(d)), home][:, None]
    border = d * d - own * own <= 2 * radius * between[home] + ROUNDING
    near = (d - own <= 2 * radius + ROUNDING) & (d <= radii + radius + ROUNDING) & border
    return home, near & (np.arange(d.shape[1]) > home[:, None])


def fitted_pivots(units: np.ndarray, n: int, radius: float) -> np.ndarray:
    """The number of pivots, of those chosen on the sample, for which comparing and copying ``n`` such vectors costs least.

    More pivots save comparisons where vectors lie in groups; where all lie
    about equally far from each other they only make copies.
    """
    pivots = choose_pivots(units, PIVOTS)
    units = units[:2048]  # enough to compare numbers by
    d, between = _distances(units, pivots), _distances(pivots, pivots)
    best, least = 1, np.inf
    for k in sorted({min(2**i, len(pivots)) for i in range(11)}):
        if k < min(LEAST, len(pivots)):
            continue
        home, seen = visits(d[:, :k], between[:k, :k], np.full(k, np.inf), radius)
        homes, guests = np.bincount(home, minlength=k), seen.sum(0)
        pairs = float((homes * (homes / 2 + guests)).sum()) / len(units) ** 2
        cost = pairs * n * PAIR_COST + (1 + seen.sum() / len(units)) * COPY_COST
        if cost < least:
            best, least = k, cost
    return pivots[:best]


def _farthest(pivots: np.ndarray):
    """Each batch's greatest distance of a home vector to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("bytes"))
            if len(m):
                d = _distances(_unit(m), pivots)
                far = np.full(len(pivots), -1.0)
                np.maximum.at(far, d.argmin(1), d.min(1))
                cells = np.flatnonzero(far >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(far[cells])], names=["cell", "far"])

    return run


def _dealt(pivots: np.ndarray, radii: np.ndarray, radius: float):
    """Each vector at home in its cell, and a copy in each cell that it visits."""
    between = _distances(pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("bytes"))
            if not len(m):
                continue
            d = _distances(_unit(m), pivots)
            home, seen = visits(d, between, radii, radius)
            seen[np.arange(len(d)), home] = True
            row, cell = np.nonzero(seen)
            one = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), pa.array(d[row, cell]), batch.column("node").take(one),
                 batch.column("copies").take(one), batch.column("bytes").take(one)],
                names=["cell", "home", "far", "node", "copies", "bytes"],
            )

    return run


def _compared(threshold: float):
    """Links of one block: its vectors at home among themselves and against guests.

    Both are sorted by distance to the pivot; partners differ by at most the
    radius in it, so each slice of guests meets a slice of the block only.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + ROUNDING

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("far", kind="stable")
        matrix = _matrix(pa.array(frame["bytes"], pa.binary()))
        node, copies, far, guest = (frame[c].to_numpy() for c in ("node", "copies", "far", "guest"))
        norms = np.linalg.norm(matrix, axis=1)
        units = _unit(matrix).astype(np.float32)
        slack = 1e-5 + 1e-6 * matrix.shape[1]  # rounding of the rough products
        block = np.flatnonzero(~guest)
        counts = np.zeros(len(frame), np.int64)
        around = far[block]

        def met(some: np.ndarray, among: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.nonzero(units[some] @ units[among].T >= threshold - slack)
            i, j = some[i], among[j]
            if inside:
                i, j = i[i < j], j[i < j]
            exact = np.einsum("ij,ij->i", matrix[i], matrix[j]) / (norms[i] * norms[j]) >= threshold
            i, j = i[exact], j[exact]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            return i, j

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            first = len(frame) and frame["col"].iloc[0] == 0
            for rows, inside in ((np.flatnonzero(guest), False), (block if first else block[:0], True)):
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    low, high = np.searchsorted(around, (far[some[0]] - radius, far[some[-1]] + radius))
                    low = max(low, at) if inside else low  # pairs of the block once
                    if low < high:
                        yield met(some, block[low:high], inside)

        root = forest(len(frame), pairs())
        linked = np.flatnonzero(counts)
        hung = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame(
            {
                "a": np.r_[node[linked], node[hung]],
                "b": np.r_[node[linked], node[root[hung]]],
                "n": np.r_[counts[linked], np.zeros(len(hung), np.int64)],
            }
        )

    return run


def _joined(vectors: DataFrame, threshold: float, pivots: np.ndarray) -> DataFrame:
    """Per distinct vector (node): its links as rows (node, node, n), and edges of a spanning forest (a, b, 0)."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    far = vectors.mapInArrow(_farthest(pivots), "cell int, far double").groupBy("cell").agg(F.max("far").alias("far"))
    radii = np.full(len(pivots), -np.inf)
    for row in far.collect():  # a row per pivot
        radii[row.cell] = row.far
    dealt = vectors.mapInArrow(_dealt(pivots, radii, radius), "cell int, home boolean, far double, node bigint, copies bigint, bytes binary")
    dealt = written(dealt, "cells")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("all"), F.sum(F.col("home").cast("bigint")).alias("homes"))
    # A cell of any size is a grid: blocks of its own vectors in rows, guests in columns.
    grid = sizes.select("cell", F.ceil(F.col("homes") / HOME).alias("rows"), F.ceil(F.col("all") / GUESTS).alias("cols")).where("rows > 0")
    met = dealt.join(F.broadcast(grid), "cell")  # a row per pivot
    place = F.xxhash64("node")
    row, col = F.pmod(place, "rows"), F.pmod(F.xxhash64("node", F.lit(1)), "cols")
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda x: x < n)
    whole = ["far", "node", "copies", "bytes"]
    at_home = met.where("home").select("cell", row.alias("row"), F.explode(upto(F.col("cols"))).alias("col"), F.lit(False).alias("guest"), *whole)
    # Guests: visitors in all rows, the cell's own vectors in the rows before theirs.
    rows = F.when(F.col("home"), row).otherwise(F.col("rows"))
    guests = met.select("cell", F.explode(upto(rows)).alias("row"), col.alias("col"), F.lit(True).alias("guest"), *whole)
    return at_home.union(guests).groupBy("cell", "row", "col").applyInPandas(_compared(threshold), "a bigint, b bigint, n bigint")


def vector_links(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and component of every vector under cosine similarity in double precision.

    Returns one row per input row: the id, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, itself included) and
    ``kept`` (the row is its component's smallest id).  Vectors that are null,
    empty or zero or hold null or non-finite components link with nothing, nor
    do rows without an id (their component is null and they are not kept).
    Vectors of different lengths never link.  Rows that repeat an id are told
    apart by their vectors; rows equal in both count as links of each other.
    Extra columns are ignored; an empty table gives an empty result.

    Equal vectors are collapsed first (by two independent 64-bit hashes), so
    groups of copies cost one row each.  Each cell is divided into blocks of
    bounded size, each block reports a count per vector and a spanning forest
    of its links, never all pairs.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
        & F.col(id_col).isNotNull(),
        F.lit(False),
    )
    key = ["h1", "h2"]
    rows = table.select(F.col(id_col).alias("vec_id"), v.alias("v"), good.alias("good"))
    linkable = rows.where("good").select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    classes = linkable.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())  # fixed once it is written
    packed = written(classes.mapInArrow(_packed, "h1 bigint, h2 bigint, least bigint, node bigint, copies bigint, width int, bytes binary"), "vectors")
    links, spark = [], table.sparkSession
    for width in sorted(r["width"] for r in packed.select("width").distinct().collect()):  # usually one
        own = packed.where(F.col("width") == width).select("node", "copies", "bytes")
        sample = own.orderBy(F.xxhash64(F.lit(3), "bytes")).limit(SAMPLE).select("bytes").toArrow()
        units = _unit(_matrix(sample.column("bytes").combine_chunks()))
        links.append(_joined(own, threshold, fitted_pivots(units, own.count(), float(np.sqrt(max(0.0, 2 - 2 * threshold))))))
    found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    for one in links:
        found = found.union(one)
    found = written(found, "links")
    roots = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = packed.select(*key, "least", "node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    links_of = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = written(named.select(*key, "least", "copies", links_of, F.coalesce("root", "node").alias("root")), "classes")
    removed(packed)
    removed(found)
    # A component may hold a third of all classes, and a class a third of all vectors.
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n__classes"))
    of_class = looked_up(named, ids, "root", "n__classes", named.count()).select(*key, "copies", "n_links", "component_id")
    keyed = written(linkable.select("vec_id", *key), "keys")
    met = looked_up(keyed, of_class, key, "copies", keyed.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = met.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, so that later steps move and read them without a list per row."""
    own = ["h1", "h2", "least", "node", "copies"]
    for batch in batches:
        lists = batch.column("v")
        offsets = np.asarray(lists.offsets)
        values = np.asarray(lists.values, np.float64)
        data = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        width = pa.array(np.diff(offsets).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in own), width, pa.array(data, pa.binary())], names=[*own, "width", "bytes"]
        )
