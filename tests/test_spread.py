"""Steps that make many rows of one run in tasks of bounded size, however few files hold the input."""

from pyspark.sql import functions as F

from facetry.operators import sites as s


def test_range_joins_spread_one_partition(spark):
    points = spark.range(0, 8000, 1, 1).select(F.lit("a").alias("m"), F.col("id").alias("site"), (F.col("id") * 7.0).alias("x"), F.lit(0.0).alias("y"))
    got = s.range_join(points, 7.0, ["m"], "site", ("x", "y"))
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 2 * 7999
    assert got.agg(F.min("distance"), F.max("distance")).first() == (7.0, 7.0)


def test_periodic_range_joins_spread_one_partition(spark):
    site = spark.range(0, 2000, 1, 1).select(F.lit("a").alias("material"), F.col("id").alias("site"), F.array(F.col("id") / 2000, F.lit(0.0), F.lit(0.0)).alias("frac"))
    cells = spark.range(1).select(F.lit("a").alias("material"), F.array(*[F.lit(x) for x in (4000.0, 0.0, 0.0, 0.0, 4000.0, 0.0, 0.0, 0.0, 4000.0)]).alias("cell"))
    got = s.periodic_range_join(site, cells, 2.5)
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 4000 and got.where("image[0] <> 0").count() == 2


def test_matches_and_orbits_spread_one_partition(spark):
    left = spark.range(0, 8000, 1, 1).select(F.lit("a").alias("g"), F.col("id").alias("k"))
    right = spark.createDataFrame([("a", 10.0, "x"), ("a", 100.0, "y")], "g string, low double, t string")
    got = s.nearest_match(left, right, ["g"], ["k"], F.abs(F.col("k") - F.col("low")), [F.col("t")])
    assert got.rdd.getNumPartitions() >= 4 and got.groupBy("t").count().sort("t").collect() == [("x", 56), ("y", 7944)]
    rot = [[1, 0, 0, 1], [0, -1, 1, 0], [-1, 0, 0, -1], [0, 1, -1, 0]]
    ops = spark.createDataFrame([("a", *map(float, (m[0], m[1], 0, m[2], m[3], 0, 0, 0, 1))) for m in rot], "material string, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    v = spark.range(0, 60000, 1, 1).select(F.lit("a").alias("material"), F.col("id").alias("site"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = s.orbit(v, ops, ["site"])
    assert got.rdd.getNumPartitions() >= 3 and got.groupBy("orbit_size", "stabilizer_size").count().sort("orbit_size").collect() == [(1, 4, 30000), (4, 1, 30000)]
