"""Triples and sides run in tasks by their number, not by the size that few bytes compress to."""

from pyspark.sql import functions as F

from facetry.operators import graphs as gr
from facetry.operators import triangles as tr


def test_wedges_and_sides_are_dealt_by_their_number(spark):
    n = 220_000
    ring = spark.range(0, n, 1, 1).select(F.lit("a").alias("m"), F.least("id", (F.col("id") + 1) % n).alias("u"), F.greatest("id", (F.col("id") + 1) % n).alias("v"))
    t = gr.wedges(ring, ["m"])
    assert t.count() == n and t.where("k - i = 2 and j - i = 1").count() == n - 2
    e = ring.withColumn("w", F.lit(2.0))
    sides = tr.edge_statistics(t, e, ["m"], ["w"])
    assert sides.rdd.getNumPartitions() >= 6 and sides.groupBy("n_sides", "sum_w").count().collect() == [(2, 4.0, n)]
    nodes = spark.range(n).select(F.lit("a").alias("m"), F.col("id").alias("node"), F.lit(1.0).alias("x"))
    assert tr.at_vertices(t, nodes, ["m"], {"x": "x"}).rdd.getNumPartitions() >= 3
    on = tr.mean_onto_edges(t.withColumn("f", F.lit(3.0)), e, ["m"], ["f"])
    assert on.rdd.getNumPartitions() >= 6 and on.groupBy("n_triangles", "mean_f").count().collect() == [(2, 3.0, n)]
