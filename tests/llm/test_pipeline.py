"""The corpus pipeline: each stage on its own input against a plainer version, and hostile tables."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.llm import op1_quality as op1
from reportloom.llm import op6_nbest as op6
from reportloom.llm import op9_decontamination as op9

from .test_operators import VOCAB, expected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def P():
    return pytest.importorskip("corpus_pipeline")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def edit_distance(item, text):
    """Least edits between an item and any part of a text, by plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for a, c in enumerate(item, 1):
        new = [a]
        for b, d in enumerate(text, 1):
            new.append(min(row[b - 1] + (c != d), row[b] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, P):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        into, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == names, name
        assert 0 < docs.count() <= before
        before = docs.count()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            good = op1.quality_scores(into, op1.fit(into, labels)).filter(f"score >= {op1.THRESHOLD}")
            assert ids(docs) == ids(good)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in into.select("doc_id", "text").collect()]
            want = [k for k, _, least in expected_components(rows, 5, 80).elements() if k == least]
            assert ids(docs) == sorted(want, key=str)
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and last.filter("not round_trip").count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with nulls, ties, repeats, empty and long texts and clashing columns."""
    at = str(tmp_path_factory.mktemp("tables"))
    g = np.random.default_rng(2)
    text = lambda n: " ".join(g.choice(VOCAB, n))
    item, long = text(30), text(400)
    near = long.split()
    near[7] = "changed"
    rows = [
        (0, None), (1, ""), (2, " \n"), (3, long), (4, " ".join(near)), (5, long), (5, long), (6, f"{text(20)} {item} {text(20)}"), (7, f"{text(20)} {item[:40]}q{item[41:]} {text(20)}"),
        (8, "mail joe@mail7.example.com or 10.1.2.3 " + text(30)), (None, text(40)), (9, text(2000)), (10, "x" * 3000), *[(20 + i, text(60)) for i in range(20)], *[(50 + i, "!!! ### " * 40 + str(i)) for i in range(10)],
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "score": F.lit(1), "kept_id": F.lit(2), "n_entities": F.lit(3), "set_id": F.lit(4), "pos": F.lit(5)})
    d.repartition(3).write.parquet(f"{at}/documents.parquet")
    marks = [(i, 1, 0) for i in range(20, 40)] + [(50 + i, 0, 1) for i in range(10)] + [(None, 1, 0), (999, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, item


def test_stages_on_hostile_tables(spark, P, small):
    at, item = small
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(P.STAGES)
    labels = spark.read.parquet(f"{at}/labels.parquet")
    scores = op1.quality_scores(docs, op1.fit(docs, labels))
    good = stages["quality"](spark, docs, at)
    assert ids(good) == ids(scores.filter(f"score >= {op1.THRESHOLD}")) and good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    one = stages["near_duplicates"](spark, docs, at)
    assert ids(one) == sorted((k for k, _, least in expected_components(rows, 5, 80).elements() if k == least), key=str) and one.columns == docs.columns
    clean = stages["decontamination"](spark, docs, at)
    p = op9.normal(item)
    held = [(k, t) for k, t in rows if edit_distance(p, op9.normal(t)) <= len(p) // op9.ERROR_DIVISOR]
    assert Counter(k for k, _ in held) == {6: 1, 7: 1} and ids(clean) == sorted(((k for k, t in rows if (k, t) not in held)), key=str)
    assert clean.columns == docs.columns
    private = stages["personal_data"](spark, docs, at)
    got = Counter((r.doc_id, r.text, r.n_chars) for r in private.collect())
    same = Counter((k, t, None if t is None else len(t)) for k, t in rows if k != 8)
    assert not same - got and "joe@" not in str(got) and private.columns == docs.columns and private.count() == len(rows)
    pieces = stages["pieces"](spark, docs, at)
    assert pieces.count() == len(rows) and {r.n_pieces for r in pieces.filter("doc_id in (0, 1)").collect()} == {0}
    assert op6.nbest_digests(docs.limit(0)).count() == 0


def test_run_whole(spark, P, small):
    at, _ = small
    out = P.run(spark, at).collect()
    kept = {r.doc_id for r in out}
    assert len(out) == len(kept) + (sum(r.doc_id == 5 for r in out) > 1) and {6, 7} & kept == set() and {50, 51, 52} & kept == set()
    assert all(r.round_trip for r in out if r.doc_id not in (2,))


def test_empty_tables(spark, P, small, tmp_path):
    at, _ = small
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
