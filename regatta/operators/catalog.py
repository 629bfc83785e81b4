"""Filters, search, pages and totals of the requirement and regulation tables."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _any_of(column: str, values: list[str]) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, values)))


def filtered(
    requirements: DataFrame, *, tiers: list[str] | None = None, methods: list[str] | None = None, jurisdictions: list[str] | None = None,
    sectors: list[str] | None = None, layers: list[int] | None = None, regulations: list[str] | None = None,
    effective_after: str | None = None, effective_before: str | None = None,
) -> DataFrame:
    """Requirements that meet every given predicate; one that is missing or empty restricts nothing.

    All predicates stand in one filter above the scan, so that Catalyst can push them down.
    """
    tests = [
        F.col("tier").isin(tiers) if tiers else None,
        F.col("method").isin(methods) if methods else None,
        _any_of("jurisdictions", jurisdictions) if jurisdictions else None,
        _any_of("sectors", sectors) if sectors else None,
        F.col("layer").isin(layers) if layers else None,
        F.col("regulation_id").isin(regulations) if regulations else None,
        F.col("effective_date") >= F.lit(effective_after).cast("date") if effective_after else None,
        F.col("effective_date") <= F.lit(effective_before).cast("date") if effective_before else None,
    ]
    given = [t for t in tests if t is not None]
    return requirements.where(reduce(and_, given)) if given else requirements


def in_jurisdiction(regulations: DataFrame, code: str) -> DataFrame:
    """Regulations whose jurisdiction is ``code`` (in any case) or whose list holds it."""
    return regulations.where(reduce(or_, (F.col("jurisdiction") == code.upper(), F.array_contains("jurisdictions", code.upper()))))


def relevance(docs: DataFrame, query: str, key: str, text: str, k: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key`` and BM25 score of the documents that hold any word of the query, scored as in the usual formula.

    Each document is reduced to its length and the counts of the query's few
    words within its own row; only these numbers are aggregated and no text
    is shuffled.
    """
    words = sorted({w for w in re.split(r"\W+", query.lower()) if w})
    tokens = F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")
    count = lambda w: F.size(F.filter("_tokens", lambda t: t == w)).alias(f"_n{words.index(w)}")
    rows = docs.select(key, tokens.alias("_tokens")).select(key, F.size("_tokens").alias("_length"), *map(count, words))
    held = [F.count(F.when(F.col(f"_n{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(words))]
    corpus = rows.agg(F.count("*").alias("_docs"), F.avg("_length").alias("_mean"), *held)  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        n, d = F.col(f"_n{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - d + 0.5) / (d + 0.5))
        score = score + idf * n * (k + 1) / (n + k * (1 - b + b * F.col("_length") / F.col("_mean")))
    hit = reduce(or_, (F.col(f"_n{i}") > 0 for i in range(len(words)))) if words else F.lit(False)
    return rows.where(hit).crossJoin(F.broadcast(corpus)).select(key, score.alias("score"))


def paged(rows: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    """One page of rows in a total order; pages count from 1."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def latest(rows: DataFrame, at: list[str], n: int, per: str | None = None) -> DataFrame:
    """The ``n`` latest rows by the columns ``at``, in all or of each value of ``per``."""
    order = [F.desc(c) for c in at]
    if per is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def regulation_statistics(requirements: DataFrame) -> DataFrame:
    """Requirements of each regulation by tier (known ones), type and method, in one pass over them (grouping sets)."""
    fields = ("tier", "type", "method")
    sets = [[F.col("regulation_id"), F.col(f)] for f in fields] + [[F.col("regulation_id")]]
    counted = requirements.groupingSets(sets, "regulation_id", *fields).agg(F.count("*").alias("n"), *(F.grouping(f).alias(f"_{f}") for f in fields))
    field = F.lit("total")
    for f in reversed(fields):
        field = F.when(F.col(f"_{f}") == 0, f).otherwise(field)
    rows = counted.select("regulation_id", field.alias("field"), F.coalesce(*fields, F.lit("total")).alias("value"), "n")
    return rows.where("field <> 'tier' or value in ('basic', 'standard', 'advanced')")


# How a text that only reads starts, words that none holds outside of quotes, and quotes and comments (Python and Java alike).
READS = r"(?i)^\s*\(*\s*(?:select|with|values)\b"
WRITES = r"(?i)\b(?:insert|overwrite|update|delete|merge|create|drop|alter|truncate|refresh|cache|set)\b|;\s*\S"
QUOTED = r"(?s)--[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`"


def is_read_only(sql: str) -> bool:
    """Whether ad-hoc text only reads: it starts as a query and holds no word of a writing statement as a whole word.

    Names like ``offset`` or ``created_at`` and quoted text do not count.
    """
    bare = re.sub(QUOTED, " ", sql)
    return bool(re.search(READS, bare)) and not re.search(WRITES, bare)


def reads_only(sql: Column) -> Column:
    """The same for a column of texts."""
    bare = F.regexp_replace(sql, QUOTED, " ")
    return bare.rlike(READS) & ~bare.rlike(WRITES)


def ad_hoc(spark: SparkSession, tables: dict[str, DataFrame], sql: str, args: dict[str, Any] | None = None, writer: bool = False) -> DataFrame:
    """Run a query over named tables with named parameters; text that may write needs a ``writer``.

    The tables are known to this query only: views of the same names in the
    session are neither seen nor changed afterwards.
    """
    if not writer and not is_read_only(sql):
        raise PermissionError("writing statements need the writer role")
    # A view is resolved when the query is, so it can go at once, and one of the user's can come back.
    had = {name: spark.table(name) for name in tables if any(v.name == name.lower() and v.isTemporary for v in spark.catalog.listTables())}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    try:
        return spark.sql(sql, args=args or {})
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, view in had.items():
            view.createOrReplaceTempView(name)
