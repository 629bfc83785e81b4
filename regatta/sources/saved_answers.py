"""A Spark data source over saved answers of the Federal Register and of EUR-Lex.

``spark.read.format("saved_answers").load(folder)`` gives a row for each
document or search result in the files below a folder, which is laid out by
source: ``federal_register/...`` and ``eurlex/...``.  The files are what the
services answered:

* Federal Register: JSON, either one document or a page of ``results``; the
  body that a document names by its url is saved with it as ``body_html``, or
  ``raw_text`` where there is no page;
* EUR-Lex: HTML pages named by their CELEX number, pages of search results
  named ``search*.html``, and JSON answers of the SPARQL endpoint.

JSON may also stand line by line, many answers to a file (then a EUR-Lex line
is an object of ``celex`` and ``html``).  A file is read by one task, and small
files share one; an answer that does not parse is a row with its ``error``.

Conditions on ``source`` choose files before any is opened, conditions on
``publication_date`` drop documents before their rows are made, where the
session allows push-down and the option ``pushFilters`` is true.  As a
stream the source takes new files in order of the time they were saved.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from regatta.functions import pages as pg

NAME, PUSHDOWN = "saved_answers", "spark.sql.python.filterPushdown.enabled"
FEDERAL, EUROPEAN = "federal_register", "eurlex"
SCHEMA = (
    "source string, source_id string, source_url string, title string, content_html string, document_type string, jurisdiction string, "
    "publication_date date, effective_date date, comment_end_date date, agencies array<string>, docket_ids array<string>, citation string, "
    "cfr_references array<string>, metadata map<string,string>, is_result boolean, snippet string, file string, saved_at timestamp, error string"
)
COLUMNS = tuple(re.findall(r"(\w+) \w+(?:<[^>]*>)?(?:, |$)", SCHEMA))

# Fixed values of the sources: kinds of documents, and what else is kept of one.
FEDERAL_TYPES = {"RULE": "rule", "PRORULE": "proposed_rule", "NOTICE": "notice", "PRESDOCU": "executive_order"}
FEDERAL_METADATA = ("abstract", "action", "dates", "regulation_id_numbers", "significant", "page_length", "start_page", "end_page", "pdf_url")
FEDERAL_SITE, EUROPEAN_SITE = "https://www.federalregister.gov", "https://eur-lex.europa.eu"
CELEX = re.compile(r"CELEX[:\s]*(\d{5}[A-Z]\d{4})")


def day(text: object) -> dt.date | None:
    """A day in ISO form; null for anything else."""
    try:
        return dt.date.fromisoformat(text)
    except (TypeError, ValueError):
        return None


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def federal_document(answer: dict) -> dict:
    """Fields of a document of the Federal Register."""
    number = answer.get("document_number") or ""
    return {
        "source_id": number,
        "source_url": answer.get("html_url") or f"{FEDERAL_SITE}/d/{number}",
        "title": answer.get("title") or "",
        "content_html": answer.get("body_html") or answer.get("raw_text") or "",
        "document_type": FEDERAL_TYPES.get(answer.get("type"), "regulation"),
        "publication_date": day(answer.get("publication_date")),
        "effective_date": day(answer.get("effective_on")),
        "comment_end_date": day(answer.get("comments_close_on")),
        "agencies": [a["name"] for a in answer.get("agencies") or [] if a.get("name")],
        "docket_ids": answer.get("docket_ids") or [],
        "citation": answer.get("citation"),
        "cfr_references": [f"{r.get('title', '')} CFR {part}" for r in answer.get("cfr_references") or [] for part in r.get("parts") or []],
        "metadata": {k: _text(answer[k]) for k in FEDERAL_METADATA if answer.get(k) is not None},
    }


def federal_result(answer: dict) -> dict:
    """Fields of one result of a search: no content yet, and the beginning of the abstract."""
    document = federal_document(answer)
    return document | {"content_html": None, "is_result": True, "snippet": (answer.get("abstract") or "")[:500] or None}


def european_type(celex: str) -> str:
    """The letter in a CELEX number tells directives from regulations and decisions, which count as regulations."""
    return "directive" if celex[5:6] == "L" else "regulation"


def european_document(celex: str, page: str) -> dict:
    """Fields of a page of EUR-Lex; title and dates are read off the page by expressions (``scraped``)."""
    where = f"{EUROPEAN_SITE}/legal-content/EN/TXT"
    return {
        "source_id": celex,
        "source_url": f"{where}/HTML/?uri=CELEX:{celex}",
        "content_html": page,
        "document_type": european_type(celex),
        "metadata": {"celex": celex, "pdf_url": f"{where}/PDF/?uri=CELEX:{celex}"},
    }


def european_result(celex: str, title: str, published: dt.date | None = None, kind: str = "") -> dict:
    return {
        "source_id": celex,
        "source_url": f"{EUROPEAN_SITE}/legal-content/EN/TXT/?uri=CELEX:{celex}",
        "title": title,
        "document_type": "directive" if "DIR" in kind else european_type(celex),
        "publication_date": published,
        "is_result": True,
    }


class _Links(HTMLParser):
    """Links of a page of search results that name a document, with their texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = tag == "a" and CELEX.search(dict(attrs).get("href") or "")
        if named:
            self.found.append([named[1], ""])
        self.inside = bool(named) or (self.inside and tag != "a")

    def handle_endtag(self, tag: str) -> None:
        self.inside = self.inside and tag != "a"

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.found[-1][1] += data


def search_page(page: str) -> Iterator[dict]:
    links = _Links()
    links.feed(page)
    links.close()
    yield from (european_result(celex, title.strip()) for celex, title in links.found if title.strip())


def _federal(answer: dict) -> Iterator[dict]:
    if isinstance(answer.get("results"), list):
        yield from map(federal_result, answer["results"])
    else:
        yield federal_document(answer)


def _european(answer: dict) -> Iterator[dict]:
    if "celex" in answer and "html" in answer:
        yield european_document(answer["celex"], answer["html"] or "")
        return
    for row in answer["results"]["bindings"]:
        told = {k: v.get("value", "") for k, v in row.items()}
        yield european_result(told.get("celex", ""), told.get("title", ""), day(told.get("date", "")[:10]), told.get("type", ""))


def answers(source: str, name: str, text: str) -> Iterator[dict]:
    """Fields of all that one file holds."""
    if source == EUROPEAN and name.endswith((".html", ".htm")):
        yield from search_page(text) if name.startswith("search") else [european_document(name.rsplit(".", 1)[0], text)]
        return
    parse = _federal if source == FEDERAL else _european
    try:
        whole = [json.loads(text)]
    except ValueError:
        whole = None
    for item in whole if whole is not None else filter(str.strip, text.splitlines()):
        try:
            answer = item if whole is not None else json.loads(item)
            if not isinstance(answer, dict):
                raise ValueError("not an object")
            yield from parse(answer)
        except (ValueError, KeyError, TypeError, AttributeError) as problem:
            yield {"error": f"{type(problem).__name__}: {problem}"}


@dataclass(frozen=True, order=True)
class File:
    """A file with the nanosecond at which it was saved."""

    saved: int
    path: str
    size: int

    @property
    def source(self) -> str:
        """The folder's name that tells the source, the nearest one above the file."""
        return next((p for p in reversed(self.path.split("/")[:-1]) if p in (FEDERAL, EUROPEAN)), "")


@dataclass
class Files(ds.InputPartition):
    """Files that one task reads."""

    files: tuple[File, ...]


COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


class _Base:
    """Listing, partitioning and reading that batches and streams share."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        #: Bytes of files that share a task.
        self.most = int(options.get("bytesperpartition", 64 << 20))
        self.sources: set[str] = {FEDERAL, EUROPEAN}
        self.dates: list[tuple[str, dt.date]] = []

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = self.root.removeprefix("file://").removeprefix("file:")
        return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)

    def listed(self) -> list[File]:
        """Files of the wanted sources, in order of saving; hidden and unfinished ones are passed over."""
        store, path = self._store()
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        inside = lambda p: p[len(path) :].strip("/").split("/")
        files = [File(i.mtime_ns, i.path, i.size) for i in found if i.type == fs.FileType.File and not any(x.startswith((".", "_")) for x in inside(i.path))]
        return sorted(f for f in files if f.source in self.sources)

    def dealt(self, files: Iterable[File]) -> list[Files]:
        """Files in order, as many to a task as the bound allows."""
        out: list[list[File]] = []
        size = 0
        for f in files:
            if not out or size + f.size > self.most:
                out.append([])
                size = 0
            out[-1].append(f)
            size += f.size
        return [Files(tuple(x)) for x in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        compare = {op.__name__: op for op in COMPARED.values()}
        for file in partition.files:
            with store.open_input_stream(file.path) as stream:
                text = stream.read().decode("utf-8", "replace")
            common = {
                "source": file.source, "jurisdiction": "US" if file.source == FEDERAL else "EU", "is_result": False, "file": file.path,
                "saved_at": dt.datetime.fromtimestamp(file.saved / 1e9, dt.timezone.utc),
            }
            for fields in answers(file.source, file.path.rsplit("/", 1)[-1], text):
                published = fields.get("publication_date")
                if all(published is not None and compare[op](published, value) for op, value in self.dates):
                    row = common | fields
                    yield tuple(row.get(c) for c in COLUMNS)


class Reader(_Base, ds.DataSourceReader):
    """Reads a folder as it is."""

    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())


class PushingReader(Reader):
    """The same where the session allows push-down; Spark accepts no such reader elsewhere."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Take conditions on the source and comparisons of the publication date; Spark keeps the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("source",) and isinstance(f, (ds.EqualTo, ds.In)):
                self.sources &= {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            elif column == ("publication_date",) and type(f) in COMPARED and isinstance(f.value, dt.date):
                self.dates.append((COMPARED[type(f)].__name__, f.value))
            else:
                yield f


class StreamReader(_Base, ds.DataSourceStreamReader):
    """Reads files in order of saving; an offset is the last file taken."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"saved": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.listed()
        return {"saved": files[-1].saved, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        place = lambda o: (o["saved"], o["path"])
        return self.dealt(f for f in self.listed() if place(start) < (f.saved, f.path) <= place(end))


class SavedAnswers(ds.DataSource):
    """The data source; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushfilters") == "true" else Reader)(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def saved_answers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The answers saved below a folder; conditions are pushed down where the session allows it (``PUSHDOWN``)."""
    spark.dataSource.register(SavedAnswers)
    pushed = {"pushFilters": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format(NAME).options(**pushed, **{k: str(v) for k, v in options.items()}).load(path)


def saved_answers_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The answers saved below a folder, and those still to come."""
    spark.dataSource.register(SavedAnswers)
    return spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def scraped(answers: DataFrame) -> DataFrame:
    """Documents among the answers with what follows from their pages: plain text, its hash, and what EUR-Lex says on the page only.

    Works on batches and streams; results of searches and answers that did
    not parse are left out.
    """
    page, european = F.col("content_html"), F.col("source") == EUROPEAN
    either = lambda ours, theirs: F.when(european, ours).otherwise(theirs)
    content = F.coalesce(either(pg.plain_text(page, pg.EUROPEAN), pg.plain_text(page)), F.lit(""))
    eli: Column = F.when(european, pg.page_eli(page))
    named = F.when(eli.isNotNull(), F.map_concat("metadata", F.create_map(F.lit("eli"), eli))).otherwise(F.col("metadata"))
    documents = answers.where("error is null and not is_result")
    return documents.select(
        "source", "source_id", "source_url",
        either(F.coalesce(pg.page_title(page), F.concat(F.lit("EUR-Lex Document "), "source_id")), F.col("title")).alias("title"),
        content.alias("content"), "content_html", "document_type", "jurisdiction", F.array("jurisdiction").alias("jurisdictions"),
        either(pg.page_date(page), F.col("publication_date")).alias("publication_date"), "effective_date", "comment_end_date",
        F.get("agencies", F.lit(0)).alias("agency"), F.coalesce("agencies", F.array().cast("array<string>")).alias("agencies"),
        F.coalesce("docket_ids", F.array().cast("array<string>")).alias("docket_ids"), "citation",
        F.coalesce("cfr_references", F.array().cast("array<string>")).alias("cfr_references"),
        F.when(content != "", F.sha2(content, 256)).otherwise("").alias("content_hash"), F.col("saved_at").alias("scraped_at"), named.alias("metadata"),
    )


def matching(answers: DataFrame, words: str, first: Column | None = None, last: Column | None = None, limit: int = 100) -> DataFrame:
    """A search over saved answers: titles that hold the words in any case, within the dates, newest first."""
    found = answers.where(F.lower("title").contains(words.lower()))
    found = found if first is None else found.where(F.col("publication_date") >= first)
    found = found if last is None else found.where(F.col("publication_date") <= last)
    return found.orderBy(F.desc_nulls_last("publication_date"), "source_id").limit(limit)
