"""Queries on regulatory texts, versions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions import pages as pg
from regatta.functions import text as tx
from regatta.functions.citations import citations
from regatta.operators import chunking, rml
from regatta.operators import documents as dc
from regatta.plans.domain_sql import as_sql, oracle
from regatta.plans.registry import query
from regatta.sources import domain
from regatta.sources.domain import table


def _first(words: dict[str, tuple[str, ...]], limit: int) -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains(lower(substr(text, 1, {limit})), '{n}')" for n in needles) + f" then '{name}'" for name, needles in words.items()
    )
    return f"case {cases} end"


@query(f"select doc_id, {_first(tx.JURISDICTIONS, 10000)} as jurisdiction, {_first(tx.REGULATION_TYPES, 5000)} as regulation_type from documents")
def n10_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.detected_jurisdiction(text).alias("jurisdiction"), tx.detected_type(text).alias("regulation_type")
    )


@query("select doc_id, sha256(text) as content_hash, length(text) // 4 as estimated_tokens from documents")
def f15_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.canonical_hash(F.col("text")).alias("content_hash"), tx.estimated_tokens(F.col("text")).alias("estimated_tokens")
    )


@query(
    """select doc_id, line, count(*)::bigint as n from (
         select doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents where len(string_split(text, chr(10))) >= 20)
       where length(line) > 10 and length(line) < 200 group by doc_id, line having count(*) > 3"""
)
def a23_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.repeated_lines(table(spark, sf_dir, "documents"))


@query(
    """with lines as (select doc_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as bare, count(*) over (partition by doc_id) as n from (
         select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
       counted as (select *, case when length(bare) > 10 and length(bare) < 200 then count(*) over (partition by doc_id, bare) else 0 end as often from lines)
       select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where n < 20 or often <= 3), '') as text from counted group by doc_id"""
)
def n04_without_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.without_headers(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(None)
def n06_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cleaned(F.col("text")).alias("text"))


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


#: What cleaning makes of the texts of the rules, worked out by hand.
CLEANED = (
    domain.LEGAL_TEXT.replace(" .Pursuant", ". Pursuant").replace("U.S.C.", "U. S. C.").replace("  They", " They")
    .replace("\n\n\n\nPage {k % 30} of 30\n", "\n\n").replace("\n-  {k % 4} -", "")
)


@query(oracle(f"select k as doc_id, {as_sql(CLEANED)} as text from (select p_partkey as k from part)"))
def n06_cleaned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.legal_texts(spark, sf_dir).select("doc_id", tx.cleaned(F.col("text")).alias("text"))


#: The citations of the texts of the rules, worked out by hand: type, raw text, identifier and section as templates.
CITED = (
    ("us_code", "{k % 50 + 1} U.S.C. § {1000 + k}", "{k % 50 + 1}", "{1000 + k}"),
    ("cfr", "{k % 45 + 1} CFR {100 + k % 60}.{k % 9}", "{k % 45 + 1}", "{100 + k % 60}.{k % 9}"),
    ("eu_regulation", "Regulation (EU) 2016/{k}", "2016/{k}", None),
    ("eu_directive", "Directive 2014/{k % 90 + 1}/EU", "2014/{k % 90 + 1}/EU", None),
    ("uk_si", "SI 2019/{k}", "2019/{k}", None),
    ("section", "§ {1000 + k}", "{1000 + k}", None),
    ("section", "SECTION 1.{k % 7}", "1.{k % 7}", None),
    ("section", "Section 4.{k % 8}(a)(1)", "4.{k % 8}(a)(1)", None),
)


def _cited_sql(family: str, *templates: str | None) -> str:
    columns = ", ".join(f"{as_sql(t) if t else 'null'} as {name}" for t, name in zip(templates, ("raw", "identifier", "section"), strict=True))
    return f"select p_partkey as doc_id, '{family}' as type, {columns} from (select p_partkey, p_partkey as k from part)"


def _citations(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(citations(F.col("text"))).alias("c"))
    return found.select("doc_id", "c.type", "c.raw", "c.identifier", "c.section")


@query(None)
def n08_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(table(spark, sf_dir, "documents"))


@query(oracle(" union all ".join(_cited_sql(*c) for c in CITED)))
def n08_citations_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(domain.legal_texts(spark, sf_dir))


@query(
    oracle(
        """select doc_id, coalesce(nullif(word_number, ''), nullif(dotted, ''), lettered) as number, coalesce(nullif(word_title, ''), nullif(dotted_title, ''), lettered_title) as title,
             case lower(word) when 'title' then 1 when 'part' then 2 when 'chapter' then 2 when 'subpart' then 3 when 'article' then 3 when 'division' then 3 else 4 end::int as level,
             start_pos, end_pos, regexp_replace(substr(text, end_pos + 1, coalesce(lead(start_pos) over (partition by doc_id order by start_pos), length(text)) - end_pos),
               '^\\s+|\\s+$', '', 'g') as content
           from (select *, regexp_extract(line, '^(?i)(chapter|article|section|part|title|subpart|division) ', 1) as word,
               regexp_extract(line, '^(?i:chapter|section) ([0-9.]+)', 1) as word_number, regexp_extract(line, '^(?i:chapter|section) [0-9.]+ ?[:-] (.*)$', 1) as word_title,
               regexp_extract(line, '^([0-9]+[.][0-9]+) ([A-Z].*)$', 1) as dotted, regexp_extract(line, '^([0-9]+[.][0-9]+) ([A-Z].*)$', 2) as dotted_title,
               regexp_extract(line, '^[(]([a-z])[)] ([A-Z].*)$', 1) as lettered, regexp_extract(line, '^[(]([a-z])[)] ([A-Z].*)$', 2) as lettered_title
             from (select *, (end_pos - length(line))::int as start_pos from (
               select doc_id, text, line, (sum(length(line) + 1) over (partition by doc_id order by i) - 1)::int as end_pos from (
                 select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from legal_texts))))
           where word_title <> '' or dotted <> '' or lettered <> ''"""
    )
)
def n09_sections_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.sections(domain.legal_texts(spark, sf_dir))


@query(
    """select doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '\\s+', '', 'g') <> ''))::int as sentences,
         len(regexp_extract_all(text, '\\S+'))::int as words, length(text)::int as chars from documents"""
)
def n12_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    counts = (tx.sentence_count(text).alias("sentences"), tx.word_count(text).alias("words"), F.length(text).alias("chars"))
    return table(spark, sf_dir, "documents").select("doc_id", *counts)


@query(
    oracle(
        f"""select doc_id, case when length(first) < 200 and right(first, 1) not in ('.', ',', ';') then first end as title, length(whole)::int as chars
            from (select doc_id, whole, string_split(whole, chr(10))[1] as first from (
              select doc_id, {_replaced("text", (r"[ ]+", "' '"), (chr(92) + "n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''"))} as whole from legal_texts))"""
    )
)
def n07_plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = tx.stripped(tx.unified_lines(F.col("text")))
    return domain.legal_texts(spark, sf_dir).select("doc_id", tx.title_line(whole).alias("title"), F.length(whole).alias("chars"))


@query(
    """select page_id, nullif(trim(regexp_extract(html, '<title>([^<]+)</title>', 1)), '') as title, nullif(regexp_extract(html, 'eli/[^"''>[:space:]]+', 0), '') as eli,
         try_cast(nullif(regexp_extract(substr(html, 1, 5000), '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0), '') as date) as published,
         case when regexp_matches(url, '[.]html?$') then 'html' when contains(lower(substr(html, 1, 1000)), '<html') or contains(lower(substr(html, 1, 1000)), '<!doctype html') then 'html'
           else 'text' end as format from pages"""
)
def n03_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, identifier, date and format of every page."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", pg.page_title(html).alias("title"), pg.page_eli(html).alias("eli"), pg.page_date(html).alias("published"), pg.file_format(F.col("url"), html).alias("format")
    )


@query(None)
def n01_page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", pg.page_content("html").alias("c"))
    return found.select("page_id", "c.title", "c.text")


@query(None)
def n02_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pg.plain_text(F.col("html")).alias("text"))


@query(None)
def n02_european_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pg.plain_text(F.col("html"), pg.EUROPEAN).alias("text"))


@query(None)
def n05_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rml.normalized(F.col("text")).alias("text"))


@query(None)
def n13_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised, cleaned and rid of headers; then counts, citations, date, jurisdiction and type of each text."""
    return dc.preprocessed(domain.legal_texts(spark, sf_dir))


@query(None)
def n14_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "fixed", chunking.Limits(500, 50))


@query(None)
def n14_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(domain.legal_texts(spark, sf_dir), "structural", chunking.Limits(500, 50, 20))


@query(None)
def n14_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "semantic")


@query(None)
def n14_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "sentence")


@query(None)
def n14_recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "recursive")


@query(None)
def n14_merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(domain.legal_texts(spark, sf_dir), "structural", chunking.Limits(500, 50, 20), merge=True)


def _second_version(docs: DataFrame) -> DataFrame:
    changed = docs.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" penalty"))).otherwise(F.col("text")).alias("text"))
    return changed.union(docs.where("doc_id % 50 = 1").select(F.col("doc_id") + 100000000, "text"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(
    f"""with old as (select doc_id, text from documents), new as (
          select doc_id, case when doc_id % 7 = 0 then text || ' penalty' else text end as text from documents where doc_id % 10 <> 0
          union all select doc_id + 100000000, text from documents where doc_id % 50 = 1),
        met as (select o.doc_id as a, n.doc_id as b, o.text as old_text, n.text as new_text from old o full outer join new n on o.doc_id = n.doc_id
          where o.text is distinct from n.text),
        worded as (select *, {WORDS.format("coalesce(old_text, '')")} as x, {WORDS.format("coalesce(new_text, '')")} as y from met)
        select coalesce(a, b) as doc_id, case when a is null then 'new' when b is null then 'deleted' else 'modified' end as change_type,
          case when a is null then 'high' when b is null then 'medium'
            when {" or ".join(f"contains(lower(new_text), '{w}')" for w in tx.PENALTY_WORDS)} then 'critical'
            when share > 0.5 then 'high' when share > 0.2 then 'medium' else 'low' end as severity
        from (select *, (len(list_filter(x, lambda w: not list_contains(y, w))) + len(list_filter(y, lambda w: not list_contains(x, w))))::double
          / greatest(len(x), len(y), 1) as share from worded)"""
)
def n18_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dc.version_diff(docs, _second_version(docs))


@query(None)
def n18_version_diff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes rated by whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dc.version_diff(docs, _second_version(docs))


@query(
    """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
       scored as (select query_id, vec_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) as score
         from (select vec_id, embedding::double[] as v from embeddings), q where vec_id <> query_id)
       select query_id, vec_id, round(score, 6) as score, n::int as rank from (
         select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored where score >= 0.3) where n <= 10"""
)
def n22_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = dc.similar(vectors, vectors.where("vec_id % 50 = 0"), top_k=10, threshold=0.3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(None)
def n22_similar_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are all rows whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = dc.similar(vectors, vectors.where("vec_id % 50 = 0"), top_k=10, threshold=0.3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
