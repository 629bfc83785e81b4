"""Filter interactions, license scans and hard negatives against brute force, with odd rows."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.llm import filter_audit, hard_negatives, license_scan, lookup
from tests.conftest import same_rows

DOCS = "doc_id bigint, text string, lang string, part string"
LABELS = "doc_id bigint, quality int, toxic int"


def fails(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        x
        for x, bad in {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
        }.items()
        if bad
    )


def audited(rows, labels):
    """Every order applied filter by filter to lists of rows."""
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = []
        for i, text, lang in rows:
            if (lang or "") == part:
                bad = fails(text or "")
                if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows):
                    bad += "E"
                mine = [x for x in labels if i is not None and x[0] == i]
                own.append((bad, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                redundant = sum(x in r[0] for r in own) - len(gone)
                unique = sum(r[0] == x for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone)]
    for (part, order, step), values in out.items():
        letter = order[step - 1]
        values.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == letter))
    return out


def audit_rows():
    rng = random.Random(11)
    words = ["Alpha", "beta", "GAMMA", "delta%", "of", *(f"word{i}" for i in range(200))]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([5, 99, 100, 130]))), rng.choice(["en", "fr", None])) for i in range(60)]
    copy = " ".join(words)
    rows += [(100 + i, copy, "de") for i in range(40)]
    rows += [(7, copy, "de"), (7, rows[3][1], "en"), (3, rows[3][1], "en"), (None, copy, "en"), (None, copy, ""), (200, None, "en"), (201, "", "en"), (202, " \t", None)]
    rows += [(203, "a " * 20000, "en"), (204, "É" * 99 + "A" * 11, "fr"), (205, "A b c " * 100, "fr"), (206, "x|y", "solo")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 110)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_audit_equals_every_order_applied(spark, monkeypatch):
    rows, labels = audit_rows()
    expected = audited(rows, labels)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(3)
    rated = spark.createDataFrame(labels, LABELS)
    for chunk, parts, many in ((filter_audit.CHUNK, filter_audit.PARTS, 1000), (16, 1, 3)):  # also with hubs and tiny chunks
        monkeypatch.setattr(filter_audit, "CHUNK", chunk)
        monkeypatch.setattr(filter_audit, "PARTS", parts)
        monkeypatch.setattr(lookup, "MANY", many)
        monkeypatch.setattr(lookup, "HUBS", 20 if many == 3 else 1000)
        got = filter_audit.filter_audit(docs, rated).collect()
        found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in got}
        assert len(got) == len(found) and found == expected


def test_audit_equals_its_sql(spark, duck, small):
    got = filter_audit.filter_audit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    same_rows(got, duck.sql(filter_audit.SQL))


def test_audit_of_nothing(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    got = filter_audit.filter_audit(spark.createDataFrame([(1, "a b", "en", "")], DOCS), spark.createDataFrame([], LABELS))
    assert got.count() == 600 and got.where("step = 5 and kept = 0").count() == 120


def test_looked_up_rows_are_those_of_a_join(spark):
    rows = spark.createDataFrame([(1, "a")] * 30 + [(2, "b"), (3, "c"), (None, "d")], "k bigint, v string")
    table = spark.createDataFrame([(1, 30, "x"), (2, 1, "y"), (9, 1, "z")], "k bigint, size bigint, w string")
    expected = sorted(map(str, rows.join(table.drop("size"), "k", "left").select("k", "v", "w").collect()))
    for total in (33, 33_000_000):
        assert sorted(map(str, lookup.looked_up(rows, table, "k", "size", total).select("k", "v", "w").collect())) == expected
    lookup_many, lookup.MANY = lookup.MANY, 5
    try:
        assert sorted(map(str, lookup.looked_up(rows, table, "k", "size", 33).select("k", "v", "w").collect())) == expected
    finally:
        lookup.MANY = lookup_many


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software"
)
SCANS = {
    "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"},
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may": {"apache", "apache-2.0"},
    "see http://www.apache.org/licenses/LICENSE-2.0 for it": {"apache-2.0"},
    "This library is under the GNU Lesser General Public License v2.1.": {"lgpl-2.1"},
    "The GNU  General\nPublic-License, version 3": {"gpl", "gpl-3.0"},
    "under CC BY-SA 4.0 since": {"cc-by", "cc-by-sa-4.0"},
    MIT: {"mit"},
    "The MIT License (MIT)": {"mit"},
    "ich gehe mit der lizenz nach apache und cc bin": set(),
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    "either version 2 of the License, or (at your option) any later version.": {"gpl", "gpl-2.0-or-later"},
    "gplv3": {"gpl-3.0"},
    "the gpl 2": {"gpl-2.0"},
    "": set(),
}


def base_by_hand(text: str):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = sorted(i for i, _ in places)
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in places}))


def test_rules_are_many_and_each_is_reachable():
    rules = license_scan.parsed(license_scan.RULES)
    assert len(rules) > 200
    for rule in rules:
        # Every literal keyword stands in the pattern, so no gate shuts out what the pattern would find.
        for word in rule.words:
            assert word.decode() in re.sub(r"[()?:|\[\]\\+*{}]", " ", rule.pattern.pattern.decode()) or word.decode() in rule.pattern.pattern.decode(), rule
    with pytest.raises(ValueError, match="unknown kind"):
        license_scan.parsed("rumour mit mit mit")


def test_gates_lose_no_find():
    """Every rule tried on every text finds what the gated rules find, and the sweep suppresses what pairs would."""
    scanner = license_scan._scanner()
    rng = random.Random(5)
    texts = [*SCANS, *(" ".join(rng.choices(list(SCANS), k=4)) for _ in range(40))]
    everything = license_scan.parsed(license_scan.RULES)
    rank = {k: i for i, k in enumerate(license_scan.KINDS)}
    for text in texts:
        words = text.encode().translate(license_scan._WORDS).split()
        line = b" " + b" ".join(words) + b" "
        raw = []
        for rule in everything:
            for m in rule.pattern.finditer(line):
                assert set(rule.words) <= set(words), (rule, text)
                raw.append((rank[rule.kind], rule.number, line.count(b" ", 0, m.start()) - 1, line.count(b" ", 0, m.end())))

        def suppresses(x, y):
            within = x[2] <= y[2] and x[3] >= y[3]
            return within and x != y and (x[0] < y[0] or (x[0] == y[0] and (x[3] - x[2] > y[3] - y[2] or x[1] < y[1])))

        left = {(y[1], y[2], y[3]) for y in raw if not any(suppresses(x, y) for x in raw)}
        assert {(f.rule.number, f.first, f.end) for f in scanner.finds(words, line)} == left


def test_license_scan(spark):
    odd = ["mit license " * 5000, "CC BY cc by CC-BY", "mit  license\x00apache license", "ÄMIT license", "mit license2", "Ünïcode “MIT” License", "x" * 100000, None]
    texts = [*SCANS, *odd]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "MIT License", "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, labels string")
    got = license_scan.license_scan(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word is None, r.first_word or 0, r.last_word or 0, r.base_labels) for r in got) == sorted(
        (i is None, i or 0, n, m, a is None, a or 0, b or 0, s) for i, t, _ in rows for n, m, a, b, s in [base_by_hand(t or "")]
    )
    by_id = {r.doc_id: r for r in got}
    for i, expected in enumerate(SCANS.values()):
        assert set(filter(None, by_id[i].labels.split(","))) == expected, texts[i]
        assert (by_id[i].score > 0) == bool(expected) and 0 <= by_id[i].score <= 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def negatives_by_hand(rows, most=5, k=10):
    usable = [(i, np.floor(256 * np.array(v, float)).astype(int), y) for i, v, y in rows if i is not None and y is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    anchors = {(i, tuple(v), y): (i, v, y) for i, v, y in usable if i % 100 == 0}
    for i, v, y in anchors.values():
        scored = sorted(((-int(v @ w), j, z) for j, w, z in usable if len(w) == len(v)), key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2] == y and r[1] != i][:most]:
            hard = [r for r in scored if r[2] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, key string"


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(0, 0.3, 4).round(1).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(900)]  # a label holds half, many ties
    same = rows[5][1]
    rows += [(1000 + i, same, i % 3) for i in range(300)]  # a vector holds a quarter
    rows += [(2000, None, 1), (2100, [0.1, None, 0.2, 0.3], 1), (2200, [float("nan"), 0.0, 0.0, 0.0], 2), (2300, [float("inf")] * 4, 2), (2400, same, None)]
    rows += [(None, same, 1), (2500, [0.0] * 4, 1), (2600, [], 1), (2700, [1.0, 2.0], 1), (2701, [1.0, 2.0], 2), (2702, [1.0, 1.9], 1), (2703, [0.5, 1.0], 3)]
    rows += [(100, rows[100][1], rows[100][2]), (101, rows[101][1], rows[101][2]), (200, same, 7)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(3)
    expected = negatives_by_hand([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    assert len(expected) > 100
    for cells, size, worth in ((hard_negatives.CELLS, hard_negatives.ROWS, hard_negatives.WORTH), (64, 8, 8), (1 << 12, 500, 1)):
        monkeypatch.setattr(hard_negatives, "CELLS", cells)
        monkeypatch.setattr(hard_negatives, "ROWS", size)
        monkeypatch.setattr(hard_negatives, "WORTH", worth)
        if size == 8:  # many small blocks, on fewer rows
            few = [r for i, r in enumerate(rows) if i % 4 == 0]
            got = hard_negatives.hard_negatives(spark.createDataFrame([(*r, "") for r in few], VECTORS), F.col("vec_id") % 100 == 0)
            assert sorted(map(tuple, got.collect())) == negatives_by_hand([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in few])
        else:
            assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())) == expected


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1, "")], VECTORS)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0


def test_scores_are_exact_at_any_size():
    small = np.array([[3, -4], [1 << 20, 7]], np.int64)
    assert hard_negatives.scores(small, small).tolist() == (small @ small.T).tolist()
    large = np.array([[(1 << 30) + 1, 3]], np.int64)
    assert hard_negatives.scores(large, large)[0, 0] == ((1 << 30) + 1) ** 2 + 9
    huge = np.array([[1 << 60, 1 << 60]], np.int64)
    assert hard_negatives.scores(huge, huge)[0, 0] == hard_negatives.BIGGEST and hard_negatives.scores(huge, -huge)[0, 0] == -hard_negatives.BIGGEST


def test_hard_negatives_equal_their_sql(spark, duck, small):
    from regatta.llm.queries import op13_hard_negatives

    same_rows(op13_hard_negatives(spark, small), duck.sql(hard_negatives.SQL))
