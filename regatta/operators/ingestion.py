"""Ingestion of regulation documents: parsing, checks, and an outcome for each document of a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.operators.rules import TIERS

SCHEMA = (
    "id string, name string, jurisdiction string, effective_date string, "
    "requirements array<struct<id: string, article_ref: string, text: string, tier: string>>"
)


def parsed(texts: DataFrame) -> DataFrame:
    """``doc_id`` and the ``body`` of documents (``doc_id``, ``json``); null for text that is not JSON."""
    body = F.when(F.try_parse_json("json").isNotNull(), F.from_json("json", SCHEMA))
    return texts.select("doc_id", body.alias("body"))


def _absent(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def _checks(body: Column) -> Column:
    """Array of the broken rules of a document, in the order of its fields."""
    own = [F.when(_absent(body[c]), F.lit(f"Missing required field: {c}")) for c in ("id", "name", "jurisdiction")]
    day = body["effective_date"]
    wrong_day = ~_absent(day) & F.try_to_date(day, "yyyy-MM-dd").isNull()
    own.append(F.when(wrong_day, F.concat(F.lit("Invalid effective_date format: "), day)))

    def of_requirement(r: Column, i: Column) -> Column:
        missing = [F.when(_absent(r[c]), F.concat(F.lit("Requirement "), i.cast("string"), F.lit(f": Missing {c}"))) for c in ("id", "text", "article_ref")]
        named = F.concat(F.lit("Requirement "), F.coalesce(r["id"], F.lit("")), F.lit(": Invalid tier '"), F.coalesce(r["tier"], F.lit("")), F.lit("'"))
        return F.array(*missing, F.when(~F.coalesce(r["tier"].isin(*TIERS), F.lit(False)), named))

    items = F.coalesce(body["requirements"], F.array().cast("array<struct<id: string, article_ref: string, text: string, tier: string>>"))
    return F.filter(F.concat(F.array(*own), F.flatten(F.transform(items, of_requirement))), lambda e: e.isNotNull())


def errors(docs: DataFrame) -> DataFrame:
    """A row per broken rule of the documents that could be read."""
    return docs.where("body is not null").select("doc_id", F.explode(_checks(F.col("body"))).alias("error"))


def outcomes(texts: DataFrame) -> DataFrame:
    """Status, error, number of requirements and of broken rules of every document.

    All is decided within a document's row: one that cannot be read fails by
    itself and never the batch.
    """
    body, ok = F.col("body"), F.col("body").isNotNull()
    return parsed(texts).select(
        "doc_id", F.when(ok, "succeeded").otherwise("failed").alias("status"), F.when(~ok, "not a document").alias("error"),
        F.when(ok, F.greatest(F.size(body["requirements"]), F.lit(0))).otherwise(0).cast("bigint").alias("requirements"),
        F.when(ok, F.size(_checks(body))).otherwise(0).cast("bigint").alias("warnings"),
    )


def totals(found: DataFrame) -> DataFrame:
    """Documents of a batch by outcome, requirements, and the share that succeeded (0 of none)."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    n = F.count("*")
    return found.agg(
        n.alias("processed"), of("succeeded").alias("succeeded"), of("failed").alias("failed"), F.coalesce(F.sum("requirements"), F.lit(0)).alias("requirements"),
        F.coalesce(F.try_divide(of("succeeded"), n), F.lit(0.0)).alias("success_rate"),
    )


def uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each table and key: rows, rows beyond the first of their key, and rows that lack a part of it."""

    def one(name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        lacking = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in key))
        per_key = rows.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_lacking", lacking)
        return per_key.agg(F.sum("_n"), F.sum(F.col("_n") - 1), F.sum(F.when(F.col("_lacking"), F.col("_n")).otherwise(0))).toDF("n", "repeated", "missing").withColumn("name", F.lit(name))

    counted = [one(name, rows, key) for name, (rows, key) in tables.items()]
    return reduce(DataFrame.unionByName, counted).fillna(0)
