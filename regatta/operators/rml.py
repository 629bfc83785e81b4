"""Regulation documents: nested records of requirements, their checks, and their graph form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.functions.text import change_severity
from regatta.operators.rules import JURISDICTION_NAMES, SECTOR_NAMES, named
from regatta.operators.storage import checkpointed

SCHEMA_VERSION = "1.0"
TIERS = ("basic", "standard", "advanced")


def statistics(requirements: DataFrame) -> DataFrame:
    """Counts of requirements per regulation, in all and by tier, and the first id."""
    of = lambda t: F.count(F.when(F.col("tier") == t, 1)).cast("int").alias(t)
    counts = [F.count("*").cast("int").alias("total"), *map(of, TIERS), F.min("requirement_id").alias("first_requirement")]
    return requirements.groupBy(F.col("regulation_id").alias("id")).agg(*counts)


def generated(
    requirements: DataFrame, size: int = 1000, regulations: DataFrame | None = None, sources: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """Nested documents of a regulation, about ``size`` requirements in order of id in each ``chunk``, with the regulation's statistics.

    ``regulations`` (regulation_id, name, jurisdiction, effective_date) and
    ``sources`` (regulation_id, url, hash) add what is known of a regulation;
    one that is not among them goes by its id.  ``links`` (src, dst, type) are
    the references of each requirement, in order of type and target.  A
    requirement's ``confidence`` and ``parsing_notes`` are its metadata where
    it has such columns.
    """
    column = lambda c, kind: (F.col(c) if c in requirements.columns else F.lit(None)).cast(kind).alias(c)
    rows = requirements.select("*", *(column(c, kind) for c, kind in (("confidence", "double"), ("parsing_notes", "string")) if c not in requirements.columns))
    reference = "array<struct<type:string,target:bigint>>"
    if links is None:
        rows = rows.withColumn("references", F.array().cast(reference))
    else:
        of = links.groupBy(F.col("src").alias("requirement_id")).agg(F.array_sort(F.collect_list(F.struct("type", F.col("dst").alias("target")))).alias("references"))
        rows = rows.join(of, "requirement_id", "left").withColumn("references", F.coalesce("references", F.array().cast(reference)))
    item = F.struct(
        F.col("requirement_id").alias("id"), F.col("natural_language").alias("text"), F.col("tier"), F.col("method").alias("verification_method"),
        F.struct(F.col("jurisdictions"), F.col("sectors")).alias("scope"), F.struct(F.col("penalty").alias("penalty_monetary_max")).alias("enforcement"),
        F.col("effective_date").cast("string").alias("effective_date"), F.col("references"), F.struct("confidence", "parsing_notes").alias("metadata"),
    )
    stats = statistics(requirements).select(F.col("id").alias("_id"), F.struct("total", *TIERS).alias("statistics"))
    if regulations is not None:
        known = regulations.select(F.col("regulation_id").alias("_id"), "name", "jurisdiction", F.col("effective_date").cast("string").alias("in_force"))
        stats = stats.join(known, "_id", "left")
    if sources is not None:
        stats = stats.join(sources.select(F.col("regulation_id").alias("_id"), F.struct("url", "hash").alias("source")), "_id", "left")
    rows = rows.join(stats, rows["regulation_id"].eqNullSafe(F.col("_id")))
    chunk = F.pmod(F.xxhash64("requirement_id", "natural_language"), F.ceil(F.col("statistics.total") / size)).cast("int").alias("chunk")
    about = [c for c in ("name", "jurisdiction", "in_force", "source") if c in stats.columns]
    docs = rows.groupBy(F.col("regulation_id").alias("id"), chunk).agg(
        F.array_sort(F.collect_list(item)).alias("requirements"), F.first("statistics").alias("statistics"), *(F.first(c).alias(c) for c in about)
    )
    named = [F.coalesce("name", "id").alias("name")] if "name" in about else []
    told = [F.col(c).alias("effective_date" if c == "in_force" else c) for c in about if c != "name"]
    return docs.select("id", "chunk", F.lit(SCHEMA_VERSION).alias("schema_version"), "requirements", "statistics", *named, *told)


def encoded(docs: DataFrame) -> DataFrame:
    """Documents as JSON text with a hash of it."""
    text = F.to_json(F.struct(*docs.columns))
    return docs.select("id", "chunk", text.alias("json"), F.sha2(text, 256).alias("document_hash"))


def decoded(texts: DataFrame, schema: str) -> DataFrame:
    """Documents from JSON text under an explicit schema; malformed text gives nulls."""
    return texts.select(F.from_json("json", schema).alias("d")).select("d.*")


def validation_errors(requirements: DataFrame) -> DataFrame:
    """(id, error) for every broken rule of a requirement."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    checks = [
        F.when(F.col("requirement_id").isNull(), "missing id"),
        F.when(blank("natural_language"), "missing text"),
        F.when(~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)), "invalid tier"),
        F.when(F.col("effective_date").isNotNull() & F.try_to_date(F.col("effective_date").cast("string")).isNull(), "invalid effective date"),
        F.when(F.coalesce(F.size("jurisdictions") < 1, F.lit(True)), "missing jurisdiction"),
    ]
    return requirements.select("requirement_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("error"))


def graph_edges(requirements: DataFrame, references: DataFrame) -> DataFrame:
    """Edges (type, src, dst) of requirements: membership, scope, and references whose ends both exist.

    ``references`` has ``src``, ``dst`` and ``kind``; kinds other than
    depends_on and conflicts_with make no edge.
    """
    name = F.col("requirement_id").cast("string")
    belongs = requirements.select(F.lit("BELONGS_TO").alias("type"), name.alias("src"), F.col("regulation_id").alias("dst"))
    scope = lambda kind, field: requirements.select(F.lit(kind).alias("type"), name.alias("src"), F.explode(F.array_distinct(field)).alias("dst"))
    known = requirements.select(F.col("requirement_id").alias("_id"))
    linked = references.where(F.col("kind").isin("depends_on", "conflicts_with"))
    linked = linked.join(known, linked.src == F.col("_id"), "left_semi").join(known, linked.dst == F.col("_id"), "left_semi")
    linked = linked.select(F.upper("kind").alias("type"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return belongs.union(scope("APPLIES_TO_JURISDICTION", "jurisdictions")).union(scope("APPLIES_TO_SECTOR", "sectors")).union(linked)


def _alike(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (earlier, later) of nodes of one regulation with a Jaccard similarity above ``threshold``.

    Distinct sets that are so alike have more than t / (1 - t) words, sizes
    within a factor of t, and a word in common among the rarest
    size - t * size + 1 of each, taken in one order of all words.
    """
    t, slack = threshold, 1e-9
    n = F.size("_words")
    long = rows.where(n >= int(t / (1 - t) - slack)) if t < 1 else rows.limit(0)
    each = long.select("_node", F.explode("_words").alias("_word"))
    often = each.groupBy("_word").agg(F.count("*").alias("_often"))
    least = F.array_sort(F.collect_list(F.struct("_often", "_word"))).alias("_least")
    rare = long.join(each.join(often, "_word").groupBy("_node").agg(least), "_node")
    first = F.expr(f"slice(_least, 1, cast(size(_words) - ceil({t}D * size(_words) - {slack}D) + 1 as int))")
    rare = rare.select("regulation_id", "requirement_id", "_node", "_words", n.alias("_n"), F.explode(first["_word"]).alias("_word"))
    a = rare.select(*(F.col(c).alias(f"a_{c}") for c in rare.columns))
    sizes = F.expr(f"sequence(cast(ceil({t}D * _n - {slack}D) as int), cast(floor(_n / {t}D + {slack}D) as int))")
    b = rare.withColumn("_like", F.explode(sizes))
    met = a.join(b, (F.col("a__word") == F.col("_word")) & (F.col("a__n") == F.col("_like")) & F.col("a_regulation_id").eqNullSafe(F.col("regulation_id")))
    met = met.where(F.struct("a_requirement_id", "a__node") < F.struct("requirement_id", "_node"))
    share = F.size(F.array_intersect("a__words", "_words")) / F.size(F.array_union("a__words", "_words"))
    return met.where(share > t).select(F.col("a__node").alias("earlier"), F.col("_node").alias("later")).distinct()


def greedy_unique(requirements: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Requirements whose words are not too like those of an earlier one kept in the same regulation.

    First wins, in order of id; similarity is Jaccard on word sets.  Equal word
    sets are collapsed first; pairs that are alike come from an equi-join on
    rare words, and rounds of joins settle them: what has no earlier one left
    stays, and what is like it goes.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("natural_language", F.lit(""))), r"\s+"), lambda w: w != "")))
    order = Window.partitionBy("regulation_id", "_words").orderBy("requirement_id")
    first = requirements.select("requirement_id", "regulation_id", words.alias("_words")).withColumn("_n", F.row_number().over(order))
    first = first.where((F.col("_n") == 1) | (F.size("_words") == 0)).drop("_n")
    first = checkpointed(first.withColumn("_node", F.sha2(F.to_json(F.struct("regulation_id", "requirement_id", "_words")), 256)))
    pairs, gone = checkpointed(_alike(first, threshold)), []
    while not pairs.isEmpty():
        stay = pairs.select("earlier").distinct().join(pairs.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        out = checkpointed(pairs.join(stay, "earlier").select(F.col("later").alias("_node")).distinct())
        gone.append(out)
        for end in ("earlier", "later"):
            pairs = pairs.join(out.withColumnRenamed("_node", end), end, "left_anti")
        pairs = checkpointed(pairs)
    for out in gone:
        first = first.join(out, "_node", "left_anti")
    return first.select("requirement_id", "regulation_id")


#: Words that make a sentence an obligation, prohibition or permission (stand-in for a language model).
MODALS = {"prohibition": r"\b(?:shall|must|may) not\b", "obligation": r"\b(?:shall|must|is required to)\b", "permission": r"\bmay\b"}


def extracted(docs: DataFrame) -> DataFrame:
    """Requirement-like sentences of documents with their kind and an id by position.

    A deterministic stand-in for extraction by a language model, which cannot run here.
    """
    sentences = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("at", "sentence"))
    kind = None
    for name, pattern in MODALS.items():
        hit = F.lower("sentence").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    found = sentences.withColumn("kind", kind).where("kind is not null")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return found.select("doc_id", F.format_string("REQ-%d-%03d", F.col("doc_id"), number).alias("requirement_id"), "kind", "sentence")


#: Typographic signs and what replaces them (fixed values).
SIGNS = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2026": "...", "\u00a0": " ",
    "\u00ad": "", "\u200b": "", "\u00a7": "Section ", "\u00b6": "Paragraph ",
}


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form with typographic signs replaced (no built-in function does this)."""
    signs = str.maketrans(SIGNS)
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(signs))


#: Order of the scalar field that entity hashes are reduced by (a fixed value).
FIELD_ORDER = 21888242871839275222246405745257275088548364400416034343698204186575808495617


@F.pandas_udf(T.StringType())
def entity_hash(ids: pd.Series) -> pd.Series:
    """SHA-256 of an id as an integer modulo the field order, in decimal (beyond any Spark number type)."""
    one = lambda x: None if x is None else str(int.from_bytes(hashlib.sha256(x.encode()).digest(), "big") % FIELD_ORDER)
    return ids.map(one)


#: Levels of headings by their first word (fixed values); numbered and lettered headings are of the last.
LEVELS = {"title": 1, "part": 2, "chapter": 2, "subpart": 3, "article": 3, "division": 3, "section": 4}
LOWEST = 4
HEAD_WORD = re.compile(rf"({'|'.join(LEVELS)})\s+", re.I)
DOTTED = re.compile(r"\d+(?:[.\-]\d+)*")
LETTERED = re.compile(r"\s*[a-z]", re.I)
#: Numbers of headings without a word: 1.2.3, or (a), or (7).
BARE = re.compile(r"(\d+(?:\.\d+)+)\s+|\(([a-z]|\d+)\)\s+")
TITLE = 201


def heading(line: str) -> tuple[str, str | None, int] | None:
    """Number, title and level of a line that is a heading, else None.

    Either a word of ``LEVELS`` (any case), a number that may end in a letter,
    and an optional title behind blanks, a colon or a dash; or a bare number
    and a title in capitals' style.  Titles have at most 201 characters.
    """
    if word := HEAD_WORD.match(line):
        number = DOTTED.match(line, word.end())
        if not number:
            return None
        letter = LETTERED.match(line, number.end())
        for end in ([letter.end()] if letter else []) + [number.end()]:
            rest = line[end:]
            title = re.sub(r"^\s*[:\-\u2014\u2013]\s*", "", rest, count=1).lstrip() if rest.strip() else ""
            if not title or (len(title) <= TITLE and re.match("[a-z]", title, re.I)):
                return line[number.start() : end], title.strip() or None, LEVELS[word[1].lower()]
        return None
    if bare := BARE.match(line):
        title = line[bare.end() :]
        if len(title) <= TITLE and "A" <= title[:1] <= "Z":
            return bare[1] or bare[2], title.strip(), LOWEST
    return None


def headings(text: str) -> Iterator[tuple[str, str | None, int, int, int, str]]:
    """Number, title, level, place, end of the heading's line, and content up to the next heading, line by line."""
    held, body, at = None, [], 0
    for line in text.split("\n"):
        found = heading(line)
        if found:
            if held:
                yield *held, "\n".join(body).strip()
            held, body = (*found, at, at + len(line)), []
        elif held:
            body.append(line)
        at += len(line) + 1
    if held:
        yield *held, "\n".join(body).strip()


def sections(docs: DataFrame) -> DataFrame:
    """Headings of each document with level, place and the text up to the next heading.

    A heading is one line; a document is read once, within its row, so no
    text is shuffled.  Null and empty texts have none.
    """
    columns = ["doc_id", "number", "title", "level", "start_pos", "end_pos", "content"]

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc_id, *found) for doc_id, text in zip(frame["doc_id"], frame["text"]) for found in headings(text or "")]
            yield pd.DataFrame(rows, columns=columns)

    schema = "doc_id bigint, number string, title string, level int, start_pos int, end_pos int, content string"
    return docs.select("doc_id", "text").mapInPandas(find, schema)


def celex(year: Column, kind: str, number: Column) -> Column:
    return F.format_string(f"3%d{kind}%04d", year, number)


def graph_nodes(requirements: DataFrame, regulations: DataFrame) -> DataFrame:
    """Nodes (type, id, name) of requirements and of all that they belong to or apply to, each once."""
    own = requirements.select(F.lit("Requirement").alias("type"), F.col("requirement_id").cast("string").alias("id"), F.col("natural_language").alias("name"))
    of = requirements.select(F.col("regulation_id").alias("id")).distinct().join(regulations.select(F.col("regulation_id").alias("id"), "name"), "id", "left")
    of = of.select(F.lit("Regulation").alias("type"), "id", F.coalesce("name", "id").alias("name"))

    def scope(kind: str, field: str, names: dict[str, str]) -> DataFrame:
        codes = requirements.select(F.explode(field).alias("id")).distinct()
        return codes.select(F.lit(kind).alias("type"), "id", named(F.col("id"), names).alias("name"))

    return own.union(of).union(scope("Jurisdiction", "jurisdictions", JURISDICTION_NAMES)).union(scope("Sector", "sectors", SECTOR_NAMES))


def regulation_changes(old: DataFrame, new: DataFrame, old_regulations: DataFrame, new_regulations: DataFrame) -> DataFrame:
    """Changes between two versions of regulations: new ones, requirements that came, went or were reworded, and their own facts.

    ``old`` and ``new``: requirement_id, regulation_id, article_ref, text,
    type; the regulations: regulation_id, name, effective_date.  A new
    regulation is one change, whatever it holds.  A regulation counts as changed
    only if its name or a requirement's article, text or type differs; then a
    new date of effect is reported too.  Contents are cut to 500 characters.
    """
    a = old.select(F.col("requirement_id").alias("_a"), F.col("regulation_id").alias("_ra"), F.struct("article_ref", "text", "type").alias("_old"))
    b = new.select(F.col("requirement_id").alias("_b"), F.col("regulation_id").alias("_rb"), F.struct("article_ref", "text", "type").alias("_new"))
    known = old_regulations.select("regulation_id").distinct()
    met = a.join(b, F.col("_a") == F.col("_b"), "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    met = met.withColumn("regulation_id", F.coalesce("_rb", "_ra")).join(known, "regulation_id", "left_semi")
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").otherwise("modified")
    severity = F.when(kind == "new", "high").when(kind == "deleted", "medium").otherwise(
        change_severity(F.coalesce("_old.text", F.lit("")), F.coalesce("_new.text", F.lit("")))
    )
    verb = F.when(kind == "new", "New").when(kind == "deleted", "Removed").otherwise("Modified")
    article = F.coalesce(F.when(kind == "deleted", F.col("_old.article_ref")).otherwise(F.col("_new.article_ref")), F.lit("Unknown"))
    cut = lambda c, name: F.substring(c, 1, 500).alias(name)
    # A change of the article or type alone makes the regulation a changed one but no row.
    needs = met.where(~F.col("_old.text").eqNullSafe(F.col("_new.text"))).select(
        "regulation_id", F.coalesce("_a", "_b").alias("requirement_id"), kind.alias("change_type"), severity.alias("severity"),
        F.concat(verb, F.lit(" requirement: "), article).alias("summary"), cut("_old.text", "old_content"), cut("_new.text", "new_content"),
    )
    nobody = F.lit(None).cast(needs.schema["requirement_id"].dataType).alias("requirement_id")
    fresh = new_regulations.join(known, "regulation_id", "left_anti").select(
        "regulation_id", nobody, F.lit("new").alias("change_type"), F.lit("high").alias("severity"), F.concat(F.lit("New regulation: "), "name").alias("summary"),
        F.lit(None).cast("string").alias("old_content"), F.substring("name", 1, 1000).alias("new_content"),
    )
    o, n = (r.select("regulation_id", F.struct("name", "effective_date").alias(c)) for r, c in ((old_regulations, "_o"), (new_regulations, "_n")))
    touched = met.select("regulation_id").distinct().withColumn("_touched", F.lit(True))
    facts = o.join(n, "regulation_id").join(touched, "regulation_id", "left")
    facts = facts.where(F.coalesce("_touched", F.lit(False)) | ~F.col("_o.name").eqNullSafe(F.col("_n.name")))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_o.{c}").cast("string").alias("was"), F.col(f"_n.{c}").cast("string").alias("now")) for c in ("name", "effective_date")))
    facts = facts.select("regulation_id", F.explode(F.filter(pairs, lambda f: ~f["was"].eqNullSafe(f["now"]))).alias("f"))
    facts = facts.select(
        "regulation_id", nobody, F.lit("modified").alias("change_type"), F.lit("low").alias("severity"), F.concat(F.lit("Metadata change: "), "f.field").alias("summary"),
        F.col("f.was").alias("old_content"), F.col("f.now").alias("new_content"),
    )
    return needs.union(fresh).union(facts)
