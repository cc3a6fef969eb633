"""Costly steps over texts are dealt over tasks."""

from pyspark.sql import functions as F

from reportloom.operators import textops as TX
from reportloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_are_dealt_by_document(spark, monkeypatch):
    """A task holds a bounded number of documents, whatever the size of their rows, and the rows stay the same."""
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("- Thu ngân sách: "), F.col("id").cast("string"), F.lit(" tỷ đồng;")).alias("text"))
    want = sorted(TX.metrics(docs).collect())
    monkeypatch.setattr(TX.spread, "__defaults__", (2,))
    got = TX.metrics(docs)
    assert "RepartitionByExpression [doc_id" in plan(got) and ", 20" in plan(got)
    assert sorted(got.collect()) == want and len(want) == 40


def test_spread_keeps_rows_and_splits_one_file(spark):
    rows = spark.range(30).coalesce(1).withColumnRenamed("id", "k")
    out = TX.spread(rows, "k", 3)
    assert out.rdd.getNumPartitions() == 10
    assert sorted(r.k for r in out.collect()) == list(range(30))
    assert TX.spread(rows.limit(0), "k").count() == 0


def test_zones_and_metadata_queries_are_dealt_out(spark):
    for name in ("document_zones", "metadata_record"):
        assert "RepartitionByExpression [o_orderkey" in plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
