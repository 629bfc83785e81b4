"""Operators on document tables: headers and footers, chunks, diffs, near-duplicates."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regatta.functions.citations import citations
from regatta.functions.text import (
    change_severity,
    cleaned,
    detected_jurisdiction,
    detected_type,
    effective_date,
    sentence_count,
    stripped,
    text_by_text,
    word_count,
)
from regatta.operators.rml import normalized
from regatta.operators.storage import checkpointed


def repeated_lines(docs: DataFrame, least_lines: int = 20, more_than: int = 3) -> DataFrame:
    """(doc_id, line, n): lines that look like headers or footers, in documents of ``least_lines`` or more."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines")).where(F.size("lines") >= least_lines)
    short = lines.select("doc_id", F.explode("lines").alias("line")).withColumn("line", stripped(F.col("line")))
    short = short.where((F.length("line") > 10) & (F.length("line") < 200))
    return short.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def without_headers(docs: DataFrame, least_lines: int = 20, more_than: int = 3) -> DataFrame:
    """Documents with repeated lines taken out, lines in order; within the row, without a shuffle, in one pass over its lines."""

    def kept(text: str) -> str:
        lines = text.split("\n")
        if len(lines) < least_lines:
            return text
        often = Counter(s for s in map(str.strip, lines) if 10 < len(s) < 200)
        return "\n".join(x for x in lines if often[x.strip()] <= more_than)

    return docs.withColumn("text", text_by_text(kept)(F.col("text")))


def preprocessed(docs: DataFrame) -> DataFrame:
    """Normalised, cleaned documents without headers, with citations, counts, effective date, jurisdiction and type.

    The cleaning puts a space behind full stops before citations are sought, so
    that ``42 U.S.C.`` is one only in texts that were not cleaned; this is the
    order of the pipeline.
    """
    clean = without_headers(docs.select("doc_id", cleaned(normalized(F.col("text"))).alias("text")))
    text = F.col("text")
    return clean.select(
        "doc_id", "text", citations(text).alias("citations"), sentence_count(text).alias("sentence_count"), word_count(text).alias("word_count"),
        effective_date(text).alias("effective_date"), detected_jurisdiction(text).alias("jurisdiction"), detected_type(text).alias("regulation_type"),
    )


def version_diff(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text", prefix: int | None = None) -> DataFrame:
    """Rows that were added, removed or modified between two versions, with a severity.

    A full outer join on the key; equal texts leave before anything is
    compared.  What is new is of high severity, what is deleted of medium; a
    modification is judged by the whole of both texts, or by their first
    ``prefix`` characters.
    """
    a = old.select(F.col(key).alias("_a"), F.col(text).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.col(text).alias("_new"))
    met = a.join(b, F.col("_a") == F.col("_b"), "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").otherwise("modified")
    seen = lambda c: F.coalesce(F.col(c) if prefix is None else F.substring(c, 1, prefix), F.lit(""))
    severity = F.when(kind == "modified", change_severity(seen("_old"), seen("_new"))).when(kind == "new", "high").otherwise("medium")
    return met.select(F.coalesce("_a", "_b").alias(key), kind.alias("change_type"), severity.alias("severity"))


def _matrix(frame: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and norms by length of vector; vectors that are null, empty or hold a null are left out."""
    by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, v in zip(frame["id"], frame["v"]):
        own = None if v is None else np.asarray(v, np.float64)
        if own is not None and own.size and not np.isnan(own).any():
            ids, rows = by_size.setdefault(own.size, ([], []))
            ids.append(i)
            rows.append(own)
    found = {}
    for size, (ids, rows) in by_size.items():
        m = np.stack(rows)
        found[size] = np.array(ids, np.int64), m, np.sqrt(np.cumsum(m * m, axis=1)[:, -1])
    return found


#: Components of the vectors of a block of either side at most, rows of a block at most, and vectors compared at a time.
CELLS, ROWS, SLICE = 1 << 22, 1 << 15, 256
#: Vectors for which a block of their own is worth while.
WORTH = 512


def _columns(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return _matrix(pd.DataFrame({"id": table["id"].to_pylist(), "v": table["v"].to_pylist()}))


def _nearest(top_k: int, threshold: float):
    """A function of a block of queries and a block of vectors that emits the ``top_k`` best of each query."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        best = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        block = _columns(asked)
        for size, (ids, vectors, all_norms) in _columns(given).items():
            if size not in block:
                continue
            query_ids, q, lengths = block[size]
            for at in range(0, len(ids), SLICE):
                own, v, norms = ids[at : at + SLICE], vectors[at : at + SLICE], all_norms[at : at + SLICE]
                scale = np.outer(norms, lengths)
                with np.errstate(all="ignore"):
                    rough = np.where(scale > 0, (v @ q.T) / scale, 0.0)
                    i, j = np.nonzero((rough >= threshold - 1e-9) & (own[:, None] != query_ids[None, :]))
                    # Sums in one order, so that equal vectors have equal scores.
                    dot = np.zeros(len(i))
                    for d in range(size):
                        dot += v[i, d] * q[j, d]
                    score = np.where(scale[i, j] > 0, dot / (norms[i] * lengths[j]), 0.0)
                met = score >= threshold
                rows = pd.DataFrame({"query_id": query_ids[j[met]], "vec_id": own[i[met]], "score": score[met]})
                best = pd.concat([best, rows]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                best = best[best.groupby("query_id").cumcount() < top_k]
        return pa.Table.from_pandas(best, schema=schema, preserve_index=False)

    return run


def similar(vectors: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float = 0.5, block: int = ROWS) -> DataFrame:
    """Nearest vectors of each query by cosine, best first, ties by id.

    There may be any number of queries.  Both sides are dealt to blocks of at
    most about ``block`` rows and ``CELLS`` components, every block of queries meets every block of vectors in one
    group of a shuffle, and each group keeps its ``top_k`` of a query, which
    are ranked over all groups.  No vector passes through the driver.
    """
    chosen = lambda rows: rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    v, q = checkpointed(chosen(vectors)), checkpointed(chosen(queries))
    n, width = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, min(block, CELLS // max(1, width)))
    row_blocks = max(1, -(-n // most), min(2 * v.sparkSession.sparkContext.defaultParallelism, n // WORTH))
    query_blocks = max(1, -(-q.count() // most))

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, copies: int):
        # Both sides' keys have one type: by their hashes blocks meet, and those of an int and a bigint differ.
        numbered = rows.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("query_block", "row_block")

    asked, given = dealt(q, "query_block", query_blocks, "row_block", row_blocks), dealt(v, "row_block", row_blocks, "query_block", query_blocks)
    found = asked.cogroup(given).applyInArrow(_nearest(top_k, threshold), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
