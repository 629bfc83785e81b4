"""The corpus pipeline: from raw documents to packed token sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns the columns of ``documents`` (the last one: packed pieces).
``run`` writes each stage's rows and rereads them for the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regatta.llm import mixing, packing, simhash, suffix_dedup, toxicity
from regatta.llm.columns import fresh
from regatta.llm.storage import written
from regatta.llm.words import word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score below 0.3).

    The classifier learns from the labelled rows among these documents that are
    not held out; without labels every score is the bias, and all stay.  Null
    and empty texts score the bias; repeated rows and null ids are judged by
    their texts alone; extra columns pass through; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = (fresh(c, docs.columns) for c in ("score", "predicted"))
    scored = toxicity.toxicity(docs, toxicity.trained(docs, labels), threshold=0.3, score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the first by id (null ids last), fingerprint and hash of the text.

    The same rule holds for every row: null and empty texts are one group, and
    rows that repeat an id are told apart by their texts.  Rows equal in id and
    text are taken in order of their other columns, written as JSON.  Extra
    columns of any type pass through; an empty table stays empty.
    """
    own, id_, none, row = (fresh(c, docs.columns) for c in ("_hash", "_id", "_none", "_row"))
    rows = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    groups = simhash.simhash_groups(rows, distance=2, carried=(own,))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", F.col(own).alias("hash"))).alias("first")
    # Keys without nulls: the same partitioning serves the grouping and the join, so texts are shuffled once.
    key = lambda id_col: (F.coalesce(id_col, F.lit(0)).alias(id_), F.col(id_col).isNull().alias(none))
    kept = written(groups.groupBy("root").agg(first).select(*key("first.doc_id"), F.col("first.hash").alias(own)), "kept")
    # Rows of one id and text are combined before the shuffle, however many there are.
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
    rows = rows.groupBy(*key("doc_id"), own).agg(F.min_by(F.struct(*docs.columns), others).alias(row))
    # Ids of kept documents grow with the corpus: a merge join at every size, never a broadcast.
    return rows.join(kept.hint("merge"), [id_, none, own]).select(f"{row}.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the passages removed that an earlier one has (strings of 100 bytes).

    A null text stays null; texts under 100 bytes stay whole; rows that repeat
    an id and its text get the same result; extra columns pass through; an
    empty table stays empty.
    """
    with_extra = docs.withColumnRenamed("dedup", extra := fresh("_dedup", docs.columns)) if "dedup" in docs.columns else docs
    done = suffix_dedup.suffix_dedup(with_extra, length=100)
    done = done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("dedup.kept")))
    done = done.withColumn("n_chars", F.length("text").cast("bigint"))
    if "dedup" in docs.columns:
        done = done.drop("dedup").withColumnRenamed(extra, "dedup")
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it (none to three).

    Rows equal in id, source and size share their copies out in order of their
    text.  Null and wordless texts have size 0 and are never taken; a null
    source is one of its own; extra columns pass through; an empty table stays
    empty.
    """
    size, copies, turn = (fresh(c, docs.columns) for c in ("_size", "_copies", "_turn"))
    mixed = mixing.mixed(docs, weights=(5.0, 2.0, 1.0), limit=3.0, seed=42, keep_source=True)
    mixed = written(mixed.select("doc_id", "source", F.col("size").alias(size), F.col("copies").alias(copies)), "copies")
    rows, key = docs.withColumn(size, word_count(F.col("text"))), ["doc_id", "source", size]
    if not mixed.groupBy(*key).count().where("count > 1").isEmpty():
        rows = rows.withColumn(turn, F.row_number().over(Window.partitionBy(*key).orderBy("text")))
        mixed = mixed.withColumn(turn, F.row_number().over(Window.partitionBy(*key).orderBy(copies)))
        key = [*key, turn]
    taken = mixed.where(F.col(copies) > 0).select(*(F.col(c).alias(f"{c}__taken") for c in key), copies)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}__taken")) for c in key))
    repeat = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(fresh("_copy", docs.columns))
    return rows.join(taken.hint("merge"), same).select(*docs.columns, repeat).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, best-fit packed into sequences of 2048 tokens.

    Null and empty texts are an end id each; repeated rows and null ids are
    packed like others; extra columns are ignored; an empty table gives none.
    """
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express a trained classifier, suffix arrays or a packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing and rereading each one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
