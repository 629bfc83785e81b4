"""Host-level quality rules in DataFrame functions only.

Rules are checked per document; failures are counted by host; each host's rate
of failure is shrunk towards the rate of all hosts by a beta prior fitted to
the hosts themselves; and the hosts' verdicts are joined back to documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.storage import written
from regatta.llm.words import SPACE, SPACE_CHARS, word_count

#: Characters that count as symbols, fixed by the operator's contract.
SYMBOLS = "#*$%&|<>"
#: Low bits of a packed window that hold its place; texts of more windows sort pairs.
PLACE_BITS = 24


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within windows of three words that the text has twice or more, each word counted once.

    Every window is hashed to 64 bits.  Longs that hold the upper bits of a
    hash above its place are sorted, which brings equal windows together much
    faster than a sort of pairs; in the rare text where different hashes share
    their upper bits the pairs are sorted instead.  The places of windows with
    an equal neighbour, sorted, cover min(3, distance to the next such place)
    words each.
    """
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    mask = (1 << PLACE_BITS) - 1

    def by_hash(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))

        def places(p: Column) -> Column:
            at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

            def clash(x: Column, i: Column) -> Column:
                other = F.get(p, i + 1)
                return (F.shiftright(x.bitwiseXOR(other), PLACE_BITS) == 0) & (F.get(h, at(x)) != F.get(h, at(other)))

            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            clashes = (F.size(F.filter(p, clash)) > 0) | (F.size(h) > mask)
            return F.when(clashes, F.transform(pairs, lambda s: s["i"])).otherwise(F.transform(p, at))

        return _once(_once(packed, places), lambda order: _covered(h, order))

    return F.coalesce(_once(hashes, by_hash), F.lit(0).cast("bigint"))


def _covered(h: Column, order: Column) -> Column:
    """Words covered by windows whose hash a neighbour in ``order`` (places by hash) shares."""

    def repeats(at: Column, i: Column) -> Column:
        own = F.get(h, at)
        near = lambda j: F.coalesce(F.get(h, F.get(order, j)) == own, F.lit(False))
        return near(i + 1) | ((i > 0) & near(F.greatest(i - 1, F.lit(0))))

    return F.aggregate(
        F.sort_array(F.filter(order, repeats)),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"), p.alias("last")),
        lambda acc: acc["sum"],
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: host and the counts that the rules judge.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line) and
    ``n_repeat_words``.  A null text has none of anything.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    visible = _without(F.col("text"), SPACE_CHARS)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACE_CHARS)) > 0)
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    return rows.select(
        "doc_id",
        "host",
        word_count(F.col("text")).alias("n_words"),
        F.length(visible).cast("bigint").alias("word_chars"),
        (F.length(visible) - F.length(_without(visible, SYMBOLS))).cast("bigint").alias("n_symbols"),
        _once(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
        _once(words, _repeat_words).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows (fixed by the operator's contract)."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule a host is judged by: the base rules, symbols, repeated lines, odd word lengths.

    Whole-number comparisons, so that every engine agrees.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        base_failed()
        | (10 * F.col("n_symbols") > words)
        | (10 * F.col("n_dup_lines") > 3 * words)
        | (F.col("word_chars") < 2 * words)
        | (F.col("word_chars") > 15 * words)
    )


def host_verdicts(measured: DataFrame, limit: float = 0.5) -> DataFrame:
    """Shrunken failure rate and verdict of each host.

    The prior is a beta distribution whose mean is the failure rate of all
    documents and whose weight follows from how much hosts' rates vary beyond
    chance (method of moments over hosts of two or more documents, between 1 and
    1000 documents' worth).  A host passes while its posterior mean is at most
    ``limit``.  Only the prior's two numbers reach the driver.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(rule_failed().cast("bigint")).alias("failed"))
    rate = F.sum("failed") / F.sum("n")
    prior = hosts.agg(
        rate.alias("mean"),
        F.count(F.when(F.col("n") > 1, 1)).alias("hosts"),
        F.sum(F.when(F.col("n") > 1, (F.col("failed") / F.col("n")) * (F.col("failed") / F.col("n")))).alias("squares"),
        F.sum(F.when(F.col("n") > 1, F.col("failed") / F.col("n"))).alias("rates"),
        F.sum(F.when(F.col("n") > 1, 1.0 / F.col("n"))).alias("inverse"),
    )
    m, k = F.col("mean"), F.col("hosts")
    variance = F.col("squares") / k - (F.col("rates") / k) * (F.col("rates") / k)
    chance = m * (1 - m) * F.col("inverse") / k
    between = variance - chance
    weight = F.when(k < 2, 1.0).when(between <= m * (1 - m) / 1000, 1000.0).otherwise(F.greatest(F.lit(1.0), m * (1 - m) / between - 1))
    row = prior.select("mean", weight.alias("weight")).first()
    mean, weight = F.lit(row["mean"] or 0.0), F.lit(row["weight"] or 1.0)
    posterior = (F.col("failed") + weight * mean) / (F.col("n") + weight)
    return hosts.select("host", "n", "failed", posterior.alias("host_rate"), (posterior <= limit).alias("host_ok"))


def host_rules(docs: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents' measures with ``base_failed``, ``host_rate`` and ``kept``.

    A document is kept if it passes the base rules and its host passes.  A
    null host is a host of its own; null ids and repeated rows are judged like
    others; a null text has no words and fails; extra columns are ignored; an
    empty table gives an empty result.  Counting combines before its shuffle,
    so a host of a third of all rows costs a row per task, and the join is
    one that adaptive execution can split.
    """
    measured = written(measures(docs, id_col, text_col, host_col), "measures")  # read three times, computed once
    verdicts = host_verdicts(measured, limit).withColumnRenamed("host", "_host")
    met = measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.col("host_ok")).alias("kept"), "host_rate",
    )


#: DuckDB SQL of the query with the default limit.
SQL = """
with words as (
  select doc_id, source as host, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), grams as (
  select doc_id, host, t, w,
         [ (w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1) ] as g
  from words
), places as (
  select doc_id, unnest(g) as gram, unnest(range(1, len(g) + 1)) as place from grams
), repeated as (
  select doc_id, place from (select doc_id, place, count(*) over (partition by doc_id, gram) as n from places) where n > 1
), covered as (
  select doc_id, count(distinct p) as n from (
    select doc_id, unnest([place, place + 1, place + 2]) as p from repeated) group by doc_id
), measured as (
  select g.doc_id, g.host, len(g.w)::bigint as n_words,
         coalesce(list_sum([length(x) for x in g.w]), 0)::bigint as word_chars,
         len(regexp_extract_all(g.t, '[#*$%&|<>]'))::bigint as n_symbols,
         (select count(x) - count(distinct x) from (select unnest(string_split(g.t, chr(10))) as x)
          where regexp_matches(x, '[^\\x20\\x09-\\x0D]'))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from grams g left join covered c on g.doc_id = c.doc_id
), judged as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, greatest(n_words, 1) as k from measured
), ruled as (
  select *, (base_failed or 10 * n_symbols > k or 10 * n_dup_lines > 3 * k or word_chars < 2 * k or word_chars > 15 * k) as failed
  from judged
), hosts as (
  select host, count(*)::double as n, sum(failed::int)::double as failed from ruled group by host
), moments as (
  select sum(failed) / sum(n) as mean, count(*) filter (where n > 1)::double as hosts,
         sum((failed / n) * (failed / n)) filter (where n > 1) as squares,
         sum(failed / n) filter (where n > 1) as rates, sum(1.0 / n) filter (where n > 1) as inverse
  from hosts
), prior as (
  select mean, case when hosts < 2 then 1.0
    when squares / hosts - (rates / hosts) * (rates / hosts) - mean * (1 - mean) * inverse / hosts <= mean * (1 - mean) / 1000 then 1000.0
    else greatest(1.0, mean * (1 - mean) / (squares / hosts - (rates / hosts) * (rates / hosts) - mean * (1 - mean) * inverse / hosts) - 1)
    end as weight
  from moments
), verdicts as (
  select host, (failed + weight * mean) / (n + weight) <= 0.5 as host_ok from hosts, prior
)
select r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       (not r.base_failed and v.host_ok) as kept
from ruled r join verdicts v on r.host is not distinct from v.host
"""
