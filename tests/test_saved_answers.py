"""The data source over saved answers: fields, partitions, pushed conditions, streams, and answers that do not parse."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

import pytest

from regatta.sources import saved_answers as sa

RULE = {
    "document_number": "2024-00123", "title": "Rule on Rings", "type": "RULE", "html_url": "https://x/d/2024-00123", "publication_date": "2024-01-15",
    "effective_on": "2024-02-15", "comments_close_on": "soon", "abstract": "What it is.", "citation": "89 FR 1", "docket_ids": ["D-1", "D-2"],
    "agencies": [{"name": "Ring Agency"}, {"raw_name": "no name"}, {"name": "Other Agency"}], "regulation_id_numbers": ["1234-AB56"], "start_page": 7,
    "cfr_references": [{"title": 45, "parts": [160, 164]}, {"title": 12}], "body_html": "<p>Part 160 &amp; 164.<br>End</p><script>x</script>",
}
PAGE = '<html><head><title>EUR-Lex - On data</title></head><body><nav>Menu</nav><p>of 27.4.2016</p><a href="eli/reg/2016/679/oj">x</a></body></html>'
SEARCH = '<a href="./?uri=CELEX:32016R0679&qid=1" class="t">Data <b>protection</b></a><a href="/x">no</a><a href="?uri=CELEX:32014L0065">Markets &amp; more</a>'
SPARQL = {"results": {"bindings": [
    {"celex": {"value": "32014L0065"}, "title": {"value": "Markets"}, "date": {"value": "2014-05-15T00:00:00"}, "type": {"value": "DIR"}},
    {"celex": {"value": "32020D0001"}, "title": {"value": "A decision"}, "date": {"value": "x"}},
]}}


@pytest.fixture
def folder(tmp_path):
    us, eu = tmp_path / "federal_register", tmp_path / "eurlex" / "2016"
    us.mkdir(parents=True), eu.mkdir(parents=True)
    (us / "one.json").write_text(json.dumps(RULE, indent=1))
    (us / "search.json").write_text(json.dumps({"count": 2, "results": [RULE, {"document_number": "2", "type": "ODD", "abstract": None}]}))
    (us / "many.jsonl").write_text("\n".join([json.dumps(RULE | {"document_number": f"L{i}", "publication_date": f"2024-03-0{i}"}) for i in (1, 2, 3)] + ["{broken", "7", ""]))
    (us / "_SUCCESS").write_text("")
    (us / ".hidden.json").write_text("{")
    (eu / "32016R0679.html").write_text(PAGE)
    (eu / "search-1.html").write_text(SEARCH)
    (eu / "sparql.json").write_text(json.dumps(SPARQL))
    return str(tmp_path)


def test_documents_of_the_federal_register(spark, folder):
    row = sa.scraped(sa.saved_answers(spark, folder)).where("source_id = '2024-00123'").first()
    assert (row.source, row.title, row.document_type, row.jurisdiction, row.jurisdictions) == ("federal_register", "Rule on Rings", "rule", "US", ["US"])
    assert (row.publication_date, row.effective_date, row.comment_end_date) == (dt.date(2024, 1, 15), dt.date(2024, 2, 15), None)
    assert row.agency == "Ring Agency" and row.agencies == ["Ring Agency", "Other Agency"] and row.docket_ids == ["D-1", "D-2"]
    assert row.cfr_references == ["45 CFR 160", "45 CFR 164"] and row.citation == "89 FR 1" and row.source_url == "https://x/d/2024-00123"
    assert row.content == "Part 160 & 164.\nEnd" and row.content_hash == hashlib.sha256(row.content.encode()).hexdigest()
    assert row.metadata["abstract"] == "What it is." and row.metadata["start_page"] == "7" and row.metadata["regulation_id_numbers"] == '["1234-AB56"]'


def test_documents_of_eurlex(spark, folder):
    row = sa.scraped(sa.saved_answers(spark, folder)).where("source = 'eurlex'").collect()
    assert len(row) == 1
    row = row[0]
    assert (row.source_id, row.title, row.document_type, row.publication_date) == ("32016R0679", "On data", "regulation", dt.date(2016, 4, 27))
    assert row.metadata["celex"] == "32016R0679" and row.metadata["eli"] == "eli/reg/2016/679/oj" and "Menu" not in row.content


def test_results_of_searches(spark, folder):
    found = {(r.source, r.source_id): r for r in sa.saved_answers(spark, folder).where("is_result").collect()}
    assert set(found) == {("federal_register", "2024-00123"), ("federal_register", "2"), *(("eurlex", c) for c in ("32016R0679", "32014L0065", "32020D0001"))}
    assert found["federal_register", "2"].document_type == "regulation" and found["federal_register", "2"].snippet is None
    assert found["federal_register", "2024-00123"].snippet == "What it is." and found["federal_register", "2024-00123"].content_html is None
    titles = {r.source_id: [] for r in found.values()}
    for r in sa.saved_answers(spark, folder).where("is_result and source = 'eurlex'").collect():
        titles[r.source_id].append((r.title, r.document_type, r.publication_date))
    assert titles["32016R0679"] == [("Data protection", "regulation", None)]
    assert sorted(titles["32014L0065"], key=repr) == [("Markets & more", "directive", None), ("Markets", "directive", dt.date(2014, 5, 15))]
    assert [r.source_id for r in sa.matching(sa.saved_answers(spark, folder).where("is_result"), "MARKETS", limit=1).collect()] == ["32014L0065"]


def test_answers_that_do_not_parse_are_rows(spark, folder):
    bad = sa.saved_answers(spark, folder).where("error is not null").collect()
    assert len(bad) == 2 and all(r.file.endswith("many.jsonl") and r.source_id is None for r in bad)
    assert sa.scraped(sa.saved_answers(spark, folder)).where("source = 'federal_register'").count() == 4


def test_a_file_is_read_by_one_task_and_small_ones_share(spark, folder):
    assert sa.saved_answers(spark, folder, bytesPerPartition=1).rdd.getNumPartitions() == 6
    assert sa.saved_answers(spark, folder).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="path"):
        spark.read.format(sa.NAME).load().count()


def test_conditions_are_pushed_down(spark, folder, monkeypatch):
    key = sa.PUSHDOWN
    before = spark.conf.get(key)
    rows = lambda: sa.saved_answers(spark, folder, bytesPerPartition=1)
    wanted = "source = 'federal_register' and publication_date >= date '2024-03-02' and title like 'Rule%'"
    plain = sorted(r.source_id for r in rows().where(wanted).collect())
    try:
        spark.conf.set(key, "true")
        assert sorted(r.source_id for r in rows().where(wanted).collect()) == plain == ["L2", "L3"]
        assert rows().where(wanted).rdd.getNumPartitions() == 3  # the files of the other source are not read
    finally:
        spark.conf.set(key, before)
    reader = sa.PushingReader({"path": folder})
    from pyspark.sql import datasource as ds

    like = ds.StringStartsWith(("title",), "Rule")
    assert list(reader.pushFilters([ds.EqualTo(("source",), "eurlex"), like, ds.LessThan(("publication_date",), dt.date(2020, 1, 1))])) == [like]
    assert reader.sources == {"eurlex"} and reader.dates == [("lt", dt.date(2020, 1, 1))]


def test_a_stream_takes_each_file_once_in_order_of_saving(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        stream = sa.saved_answers_stream(spark, folder + "/federal_register").where("not is_result and error is null").select("source_id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.source_id for r in spark.read.schema("source_id string").parquet(out).collect())

    assert drain() == ["2024-00123", "L1", "L2", "L3"] and drain() == ["2024-00123", "L1", "L2", "L3"]
    late = os.path.join(folder, "federal_register", "a-later.json")
    with open(late, "w") as f:
        json.dump(RULE | {"document_number": "new"}, f)
    assert drain() == ["2024-00123", "L1", "L2", "L3", "new"]
