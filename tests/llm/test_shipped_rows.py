"""How many rows the exact comparison of some queries with all vectors sends out."""

from pyspark.sql import functions as F

from facetry.llm import ann


def test_vectors_are_sent_once_for_each_block_of_askers(spark):
    rows = spark.range(500).select(F.col("id").alias("cid"), F.array(F.col("id").cast("double")).alias("embedding"))
    asks = rows.where("cid % 20 = 0")
    sent = ann.everywhere_rows(rows, asks, 500, asks.count(), 10)
    sides = {r["side"]: r["count"] for r in sent.groupBy("side").count().collect()}
    assert sides == {0: 500 * 3, 1: 25 * 50}
    # Every asker meets every vector in exactly one block.
    met = sent.where("side = 1").select(F.col("cid").alias("q"), "block").join(sent.where("side = 0").select("cid", "block"), "block")
    assert met.count() == met.distinct().count() == 25 * 500
    few = ann.everywhere_rows(rows, asks.limit(3), 500, 3, 10)
    assert few.where("side = 0").count() == 500
