"""Domain tables built from the driver's tables: entities, requirements, assessments, states, edges, events.

Schemas are explicit and never inferred; each function is a projection that
Catalyst prunes to the columns a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Market segment of a customer -> type of the entity.
ENTITY_TYPES = {
    "AUTOMOBILE": "corporation", "BUILDING": "sme", "FURNITURE": "startup", "HOUSEHOLD": "non_profit", "MACHINERY": "government",
}
SEGMENTS = tuple(ENTITY_TYPES)
#: (return flag, line status) -> status of an assessment item.
ITEM_STATUS = {
    "AF": "compliant", "AO": "partial", "NF": "non_compliant", "NO": "pending", "RF": "remediation", "RO": "not_applicable",
}
EVENT_TYPES = {
    "error": "violation.detected", "click": "assessment.started", "view": "score.calculated",
    "purchase": "assessment.completed", "signup": "entity.created",
}
ASSESSMENT_STATUS = {"F": "completed", "O": "in_progress", "P": "pending_review"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(key: Column, values: dict[str, str]) -> Column:
    """A small fixed mapping as one CASE expression."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("code"), F.col("r_name").alias("parent")
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    placed = customer.join(jurisdictions(spark, sf_dir), customer.c_nationkey == F.col("n_nationkey"))
    return placed.select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), mapped(F.col("c_mktsegment"), ENTITY_TYPES).alias("entity_type"),
        F.array("code", "parent").alias("jurisdictions"), F.array("c_mktsegment").alias("sectors"),
        F.pmod(F.col("c_custkey") * 37, F.lit(400)).cast("int").alias("employee_count"), (F.col("c_acctbal") * 10000).alias("annual_revenue"),
        (F.col("c_custkey") % 50 == 0).alias("deleted"),
    )


def regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulations by brand, those with an odd number at the end named and in force since a day that it gives, and a draft without requirements."""
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("regulation_id")).distinct()
    number = F.regexp_extract("regulation_id", "([0-9]+)$", 1).try_cast("int")
    named = brand.where(number % 2 == 1).select(
        "regulation_id", F.concat(F.lit("Regulation "), number.cast("string")).alias("name"), F.concat(F.lit("NATION_"), (number % 25).cast("string")).alias("jurisdiction"),
        F.array(F.concat(F.lit("NATION_"), ((number * 2) % 25).cast("string"))).alias("jurisdictions"), F.date_add(F.lit("2020-01-01").cast("date"), number).alias("effective_date"),
    )
    draft = spark.range(1).select(
        F.lit("Draft").alias("regulation_id"), F.lit("Regulation in draft").alias("name"), F.lit("NATION_1").alias("jurisdiction"),
        F.lit(None).cast("array<string>").alias("jurisdictions"), F.lit(None).cast("date").alias("effective_date"),
    )
    return named.union(draft)


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    code = lambda k: F.concat(F.lit("NATION_"), (k % 25).cast("string"))
    segment = F.element_at(F.array(*map(F.lit, SEGMENTS)), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("requirement_id"), F.col("p_brand").alias("regulation_id"), F.col("p_name").alias("natural_language"),
        F.when(F.col("p_size") <= 20, "basic").when(F.col("p_size") <= 40, "standard").otherwise("advanced").alias("tier"),
        F.col("p_type").alias("method"),
        F.when(key % 10 == 0, F.array(F.lit("ALL"))).when(key % 11 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(code(key), code(3 * key))).alias("jurisdictions"),
        F.when(key % 7 == 0, F.array(F.lit("ALL"))).otherwise(F.array(segment)).alias("sectors"),
        F.when(key % 3 != 0, F.col("p_retailprice") * 1000).alias("penalty"), (key % 7 + 1).cast("int").alias("layer"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_size") * 30).cast("int")).alias("effective_date"),
    )


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("assessment_id"), F.col("o_custkey").alias("entity_id"), mapped(F.col("o_orderstatus"), ASSESSMENT_STATUS).alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("completed_at"), F.col("o_orderdate").alias("created_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.round(F.col("l_discount") * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("assessment_id"), F.col("l_partkey").alias("requirement_id"), F.col("l_linenumber").alias("line"),
        mapped(F.concat("l_returnflag", "l_linestatus"), ITEM_STATUS).alias("status"),
        F.when(step <= 2, "low").when(step <= 5, "medium").when(step <= 8, "high").otherwise("critical").alias("risk_impact"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status of each (entity, requirement) over completed assessments."""
    done = assessments(spark, sf_dir).where("status = 'completed'").select("assessment_id", "entity_id", "completed_at")
    order = Window.partitionBy("entity_id", "requirement_id").orderBy(F.desc("completed_at"), F.desc("assessment_id"), "status")
    joined = items(spark, sf_dir).select("assessment_id", "requirement_id", "status").join(done, "assessment_id")
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("entity_id", "requirement_id", "status", "completed_at")


def depends_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEPENDS_ON edges: key -> key / 2, and 1 -> 499, which closes a cycle."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    down = part.where("src > 1").select("src", F.floor(F.col("src") / 2).cast("bigint").alias("dst"))
    return down.union(part.where("src = 1").select("src", F.lit(499).cast("bigint").alias("dst")))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONFLICTS_WITH edges key - key + 17 where key is a multiple of 13, both ends present."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    made = part.where("src % 13 = 0").select("src", (F.col("src") + 17).alias("dst"))
    return made.join(part.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped_events(table(spark, sf_dir, "events"))


def shaped_events(raw: DataFrame) -> DataFrame:
    """Compliance events from raw rows, batch or streaming alike."""
    return raw.select(
        "event_id", "ts", F.col("user_id").alias("entity_id"), mapped(F.col("event_type"), EVENT_TYPES).alias("event_type"),
        (F.col("value") * 20).cast("int").alias("score"), "props",
    )


#: A regulation text by requirement key ``k``: literal pieces, and whole numbers as expressions of both SQL dialects in braces.
LEGAL_TEXT = (
    "CHAPTER {k % 9 + 1} - INTRODUCTION\nThis rule of the European Union is effective January {k % 28 + 1}, 2024 .Pursuant to {k % 50 + 1} U.S.C. § {1000 + k}"
    " and {k % 45 + 1} CFR {100 + k % 60}.{k % 9}, entities must keep records.  They may not destroy them!\n\n\n\nPage {k % 30} of 30\n"
    "SECTION 1.{k % 7}: Definitions\nRegulation (EU) 2016/{k} and Directive 2014/{k % 90 + 1}/EU apply; SI 2019/{k} too. A person may appeal.\n"
    "2.{k % 5 + 1} Scope of the rules\nSection 4.{k % 8}(a)(1) is amended. Operators shall report personal data {k % 11} times.\n(a) Who reports\n-  {k % 4} -\nEnd"
)


def legal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short regulation text per requirement, with headings, citations, dates and page numbers."""
    parts = [F.expr(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(re.split("[{}]", LEGAL_TEXT))]
    # Keys of a small file make many texts: dealt to as many tasks as a shuffle has, before they are.
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    return keys.select(F.col("k").alias("doc_id"), F.concat(*parts).alias("text"))
