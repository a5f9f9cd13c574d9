"""Graphs of bounded size are searched in bundles; the rounds that larger ones take give the same rows."""

import pytest
from pyspark.sql import functions as F

from facetry.operators import components as cm
from facetry.operators import graphs as gr


@pytest.fixture(scope="module")
def edges(spark):
    g = lambda n: F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 3 == 1, F.lit("b")).otherwise(F.lit("c"))
    e = spark.range(400).select(g(3).alias("material"), F.pmod(F.xxhash64("id"), F.lit(150)).alias("u"), F.pmod(F.xxhash64(F.col("id") + 1000), F.lit(150)).alias("v"), (F.col("id") % 7 * 1.0).alias("w"))
    return e.where("u <> v").groupBy("material", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w")).cache()


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_bundles_and_rounds_agree(spark, edges, kind, monkeypatch):
    monkeypatch.setattr(cm, "BUNDLE", 120)
    e = edges.select("material", F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), "w")
    found = cm.components(e, ["material"])
    assert rows(found) == rows(cm.components(e, ["material"], whole=0)) == rows(cm.components(e, ["material"], whole=130)) and found.count() > 100
    forest = gr.spanning_forest(e, ["material"], "w")
    assert rows(forest) == rows(gr.spanning_forest(e, ["material"], "w", whole=0)) and forest.count() == found.where("node <> component").count()


def test_bundles_shuffle_once(spark, edges, monkeypatch):
    """Rounds would write a folder each."""
    names, before = [], cm.written
    monkeypatch.setattr(cm, "written", lambda df, name: names.append(name) or before(df, name))
    cm.components(edges, ["material"]).count()
    assert names == ["edges", "components"]


def test_nulls_and_structs_take_rounds(spark, edges):
    some = edges.withColumn("w", F.when(F.col("material") != "b", F.col("w")))
    assert rows(gr.spanning_forest(some, ["material"], "w").where("material = 'b'").select("u", "v")) == rows(gr.spanning_forest(some, ["material"], "w", whole=0).where("material = 'b'").select("u", "v"))
    pairs = edges.select("material", F.struct(F.col("u").alias("x")).alias("u"), F.struct(F.col("v").alias("x")).alias("v"))
    assert rows(cm.components(pairs, ["material"]).select("material", "node.x", "component.x").toDF("material", "n", "c")) == rows(cm.components(edges, ["material"]).toDF("material", "n", "c"))
    assert cm.components(edges.limit(0), ["material"]).count() == 0 and gr.spanning_forest(edges.limit(0), ["material"], "w").count() == 0
