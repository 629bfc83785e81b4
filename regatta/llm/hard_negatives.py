"""Hard negatives by a full sort of each anchor's integer scores.

Anchors and rows are cut into blocks, and every block of anchors meets every
block of rows in one group of bounded size.  There each anchor's scores are
sorted by score and id; the first rows of its label are candidates for its
positives, and, once those are known, each positive's upper limit is found by
binary search and the rows of another label are read on from there.  The few
rows that a group returns for an anchor are then ranked over all groups, so the
result is that of one sort over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regatta.llm.storage import removed, written

#: Components that a block of anchors or rows holds at most (8 bytes each), and rows of a block at most.
CELLS, ROWS = 1 << 22, 1 << 16
#: Rows that are worth a block of their own: small tables are cut for the sake of more tasks, but not finer than this.
WORTH = 1024
BIGGEST = (1 << 63) - 1


def integer_vectors(vector: Column, scale: int = 256) -> Column:
    """Each component x as the integer floor(scale * x), x taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd), F.lit(False))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as far as a long holds them; beyond, its largest or smallest value."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    bound = np.abs(anchors.astype(float)).sum(1).max() * np.abs(rows.astype(float)).max()
    if bound < 2**53:  # doubles add up to the exact integer
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    if bound < 2**62:
        return anchors @ rows.T
    exact = anchors.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -BIGGEST, BIGGEST).astype(np.int64)


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of the rows of each length of vector."""
    column = table["v"].combine_chunks()
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = at, flat[(starts[at][:, None] + np.arange(n)).astype(np.int64)].reshape(len(at), n).astype(np.int64)
    return out


def _sorted_scores(anchors: pa.Table, rows: pa.Table):
    """For each anchor that meets rows of its length: its place, the places of these rows by (score, id), and their scores."""
    ids = rows["id"].to_numpy()
    theirs = _by_length(rows)
    for length, (places, vectors) in _by_length(anchors).items():
        if length not in theirs:
            continue
        at, other = theirs[length]
        step = max(1, CELLS // len(at))
        for first in range(0, len(places), step):
            for place, own in zip(places[first : first + step], scores(vectors[first : first + step], other)):
                order = np.lexsort((ids[at], -own))
                yield int(place), at[order], own[order]


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _first_positives(most: int):
    """A group's function: the first rows of each anchor's label, other than those of its id."""
    schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {f.name: [] for f in schema}
        if anchors.num_rows and rows.num_rows:
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            own_id, own_label, keys = (anchors[c].to_numpy() for c in ("id", "label", "key"))
            for a, order, own in _sorted_scores(anchors, rows):
                first = np.flatnonzero((labels[order] == own_label[a]) & (ids[order] != own_id[a]))[:most]
                out["anchor_id"] += [own_id[a]] * len(first)
                out["key"] += [keys[a]] * len(first)
                out["positive_id"] += ids[order[first]].tolist()
                out["positive_score"] += own[first].tolist()
        return _table(out, schema)

    return run


def _first_negatives(most: int, lower: int, upper: int):
    """A group's function: for each anchor and positive, the first rows of another label within the positive's limits."""
    names = ("anchor_id", "key", "positive_no", "positive_id", "positive_score", "negative_id", "negative_score")
    schema = pa.schema([(n, pa.int32() if n == "positive_no" else pa.int64()) for n in names])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        if anchors.num_rows and rows.num_rows:
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            own_id, own_label, keys = (anchors[c].to_numpy() for c in ("id", "label", "key"))
            positives = anchors["positives"].to_pylist()
            for a, order, own in _sorted_scores(anchors, rows):
                other = labels[order] != own_label[a]
                order, falling = order[other], -own[other]  # ascending
                for p in positives[a]:
                    score = p["positive_score"]
                    top, bottom = upper * score // 100, -(-lower * score // 100)  # in whole numbers: s <= top, s >= bottom
                    begin = np.searchsorted(falling, -top, "left")
                    end = min(begin + most, np.searchsorted(falling, -bottom, "right"))
                    n = max(0, end - begin)
                    out["anchor_id"] += [own_id[a]] * n
                    out["key"] += [keys[a]] * n
                    out["positive_no"] += [p["positive_no"]] * n
                    out["positive_id"] += [p["positive_id"]] * n
                    out["positive_score"] += [score] * n
                    out["negative_id"] += ids[order[begin:end]].tolist() if n else []
                    out["negative_score"] += (-falling[begin:end]).tolist() if n else []
        return _table(out, schema)

    return run


def _dealt(df: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
    """Rows dealt evenly to ``blocks`` in column ``own`` and copied to every one of ``copies`` blocks of the other side."""
    dealt = df.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    lower: int = 30,
    upper: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows of another label that score close to, but well below, an anchor's positives.

    ``anchor`` is a condition on the input that picks the anchors.  A score is
    the inner product of integer vectors (``integer_vectors``); higher scores
    come first, ties by smaller id.  An anchor's positives are its first rows
    of its label with another id than its own; a positive's negatives are the
    first rows of another label whose score lies between ``lower`` and
    ``upper`` hundredths of the positive's (none where that is below zero).

    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score``.  Rows with a null id or label,
    a null vector or a null or non-finite component take no part.  Rows that
    repeat an id are rows of their own; an anchor that is repeated with its
    label and vector is asked once.  Vectors of different lengths do not meet.
    Scores beyond a long are taken as its ends.  Extra columns are ignored; an
    empty table gives an empty result.

    Every anchor is scored against every row, in groups of at most ``CELLS``
    components and ``ROWS`` rows a side, whatever the labels; nothing of that
    product is written but each group's first rows of an anchor.
    """
    id_, label = F.col(id_col).cast("bigint"), F.col(label_col).cast("bigint")
    usable = id_.isNotNull() & label.isNotNull() & finite(F.col(vector_col))
    chosen = rows.where(usable).select(id_.alias("id"), label.alias("label"), integer_vectors(F.col(vector_col), scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    all_rows = written(chosen, "vectors")
    asked = all_rows.where("is_anchor").select("id", "label", "v", F.xxhash64("label", "v").alias("key")).dropDuplicates(["id", "key"])
    asked = written(asked, "anchors")
    n, width = all_rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, min(ROWS, CELLS // max(1, width)))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, -(-n // most), min(tasks, n // WORTH))
    anchor_blocks = max(1, -(-asked.count() // most))
    dealt_rows = _dealt(all_rows.drop("is_anchor"), "r", row_blocks, "a", anchor_blocks).groupBy("a", "r")

    def met(anchors: DataFrame, run, schema: str) -> DataFrame:
        dealt = _dealt(anchors, "a", anchor_blocks, "r", row_blocks).groupBy("a", "r")
        return dealt.cogroup(dealt_rows).applyInArrow(run, schema)

    found = met(asked, _first_positives(positives), "anchor_id bigint, key bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("positive_no", place).where(F.col("positive_no") <= positives)
    listed = found.groupBy("anchor_id", "key").agg(F.collect_list(F.struct("positive_no", "positive_id", "positive_score")).alias("positives"))
    ready = written(asked.join(listed.withColumnRenamed("anchor_id", "id"), ["id", "key"]), "positives")
    schema = (
        "anchor_id bigint, key bigint, positive_no int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    )
    hard = met(ready, _first_negatives(negatives, lower, upper), schema)
    order = Window.partitionBy("anchor_id", "key", "positive_no").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    result = written(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for table in (all_rows, asked, ready):
        removed(table)
    return result


SQL = """
with r as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and vec_id is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.id as anchor_id, o.id, a.label = o.label as same, list_dot_product(a.v, o.v)::bigint as score
    from r a join r o on a.id % 100 = 0 and a.id <> o.id),
p as (
    select anchor_id, id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
    id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same
    and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 10
"""
