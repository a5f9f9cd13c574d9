"""Grid and series queries. Grid: line number (7) x quantity band (5) x discount step (6), value = mean price.
Series: a user's events by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators import grids as gd
from facetry.operators import series as se
from facetry.plans.registry import query
from facetry.plans.sites import r
from facetry.session import cut, table

N = (7, 5, 6)
CELL = "l_linenumber - 1 AS i, CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS j, CAST(floor(l_discount * 50 + 1e-9) AS BIGINT) AS k"
G_SQL = f"gr AS (SELECT 'price' AS field, i, j, k, avg(l_extendedprice) / 1000 AS value FROM (SELECT *, {CELL} FROM lineitem) GROUP BY i, j, k)"


def grid(spark, sf_dir, value: str = "l_extendedprice", over: float = 1000.0) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        F.lit("price").alias("field"), (F.col("l_linenumber") - 1).cast("long").alias("i"), F.floor((F.col("l_quantity") - 1) / 10).alias("j"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("k"), F.col(value).alias("v"))
    return cut(cells.groupBy("field", "i", "j", "k").agg((F.avg("v") / over).alias("value")))


def at(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("price").alias("field"), "p_partkey", ((F.col("p_partkey") % 97) / 97.0).alias("x"), ((F.col("p_size") % 53) / 53.0).alias("y"), ((F.col("p_partkey") % 31) / 31.0).alias("z"))


S_SQL = f"""{G_SQL}, pt AS (SELECT p_partkey, least((p_partkey % 97) / 97.0::DOUBLE, 6/7.0::DOUBLE - 1e-10) * 7 AS x, least((p_size % 53) / 53.0::DOUBLE, 0.8::DOUBLE - 1e-10) * 5 AS y, least((p_partkey % 31) / 31.0::DOUBLE, 5/6.0::DOUBLE - 1e-10) * 6 AS z FROM part),
    co AS (SELECT p_partkey, CAST(floor(x) AS BIGINT) + a AS i, CAST(floor(y) AS BIGINT) + b AS j, CAST(floor(z) AS BIGINT) + c AS k, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE c WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM pt, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c))"""


@query("d1_trilinear_sample", f"WITH {S_SQL} SELECT p_partkey, round(CASE WHEN count(value) = 8 THEN sum(w * value) END, 5) AS value FROM co LEFT JOIN gr USING (i, j, k) GROUP BY p_partkey")
def d1(spark, sf_dir):
    return gd.sampled(at(spark, sf_dir), grid(spark, sf_dir), N, ["field"], "p_partkey").select("p_partkey", r(F.col("value"), "value", 5))


DIFF = "coalesce((lead(value) OVER {w} - lag(value) OVER {w}) / 2, lead(value) OVER {w} - value, value - lag(value) OVER {w}, 0)"
D_SQL = f"""{G_SQL}, df AS (SELECT i, j, k, value, {DIFF.format(w='(PARTITION BY j, k ORDER BY i)')} AS d_i, {DIFF.format(w='(PARTITION BY i, k ORDER BY j)')} AS d_j, {DIFF.format(w='(PARTITION BY i, j ORDER BY k)')} AS d_k FROM gr)"""


@query("w2_d3_gradient", f"WITH {D_SQL} SELECT CAST(i AS BIGINT) AS i, j, k, round(d_i * 7, 5) + 0.0 AS gx, round(d_j * 5, 5) + 0.0 AS gy, round(d_k * 6, 5) + 0.0 AS gz FROM df")
def d3(spark, sf_dir):
    return gd.gradient(grid(spark, sf_dir), N, ["field"]).select("i", "j", "k", *[r(F.col(c), c, 5) for c in ("gx", "gy", "gz")])


@query("w3_d4_laplacian", f"WITH {G_SQL} SELECT CAST(i AS BIGINT) AS i, j, k, round(coalesce(lag(value) OVER x, value) + coalesce(lead(value) OVER x, value) + coalesce(lag(value) OVER y, value) + coalesce(lead(value) OVER y, value) + coalesce(lag(value) OVER z, value) + coalesce(lead(value) OVER z, value) - 6 * value, 5) + 0.0 AS laplacian FROM gr WINDOW x AS (PARTITION BY j, k ORDER BY i), y AS (PARTITION BY i, k ORDER BY j), z AS (PARTITION BY i, j ORDER BY k)")
def d4(spark, sf_dir):
    return gd.laplacian(grid(spark, sf_dir), ["field"]).select("i", "j", "k", r(F.col("laplacian"), "laplacian", 5))


@query("d2_vector_sample", f"WITH {D_SQL}, {S_SQL[len(G_SQL) + 2:]}, s AS (SELECT p_partkey, sum(w * d_i * 7) AS gx, sum(w * d_j * 5) AS gy, sum(w * d_k * 6) AS gz FROM co JOIN df USING (i, j, k) GROUP BY p_partkey) SELECT p_partkey, round(gx, 4) + 0.0 AS gx, round(sqrt(gx*gx + gy*gy + gz*gz), 4) AS norm FROM s")
def d2(spark, sf_dir):
    g = cut(gd.gradient(grid(spark, sf_dir), N, ["field"]))
    return gd.sampled_vector(at(spark, sf_dir), g, ["gx", "gy", "gz"], N, ["field"], "p_partkey").select("p_partkey", r(F.col("gx"), "gx", 4), r(F.col("norm"), "norm", 4))


@query("d5_d7_moments", f"WITH {D_SQL} SELECT 'price' AS field, round(avg(value), 5) AS mean, round(var_pop(value), 5) AS variance, round(avg(d_i*d_i*49 + d_j*d_j*25 + d_k*d_k*36), 3) AS mean_square FROM df")
def d5(spark, sf_dir):
    g = grid(spark, sf_dir)
    m = gd.moments(g, ["field"]).join(gd.mean_square_gradient(gd.gradient(g, N, ["field"]), ["field"]), "field")
    return m.select("field", r(F.col("mean"), "mean", 5), r(F.col("variance"), "variance", 5), r(F.col("mean_square"), "mean_square", 3))


@query("d6_coupling_tensor", f"WITH {D_SQL}, h AS (SELECT i, j, k, avg(l_tax) * 10 AS value FROM (SELECT *, {CELL} FROM lineitem) GROUP BY i, j, k), dh AS (SELECT i, j, k, {DIFF.format(w='(PARTITION BY j, k ORDER BY i)')} AS e_i, {DIFF.format(w='(PARTITION BY i, k ORDER BY j)')} AS e_j, {DIFF.format(w='(PARTITION BY i, j ORDER BY k)')} AS e_k FROM h) SELECT 'price' AS field, round(-avg(d_i * e_i * 49 + d_j * e_j * 25 + d_k * e_k * 36), 4) AS trace, round(-avg(d_i * e_j * 35), 4) AS m01 FROM df JOIN dh USING (i, j, k)")
def d6(spark, sf_dir):
    a = gd.gradient(grid(spark, sf_dir), N, ["field"])
    b = gd.gradient(grid(spark, sf_dir, "l_tax", 0.1), N, ["field"])
    return gd.coupling(a, b, ["field"]).select("field", r(F.col("trace"), "trace", 4), r(F.col("m01"), "m01", 4))


@query("p13_field_fallback", f"WITH {S_SQL}, s AS (SELECT p_partkey, CASE WHEN count(value) = 8 AND p_partkey % 3 <> 0 THEN sum(w * value) END AS v FROM co LEFT JOIN gr USING (i, j, k) GROUP BY p_partkey) SELECT p_partkey, round(coalesce(v, (p_size + p_retailprice) / 2), 4) AS value, round(CASE WHEN v IS NULL THEN abs(p_size - p_retailprice) / 2 ELSE 0 END, 4) AS uncertainty FROM s JOIN part USING (p_partkey)")
def p13(spark, sf_dir):
    s = gd.sampled(at(spark, sf_dir), grid(spark, sf_dir), N, ["field"], "p_partkey").withColumn("v", F.when(F.col("p_partkey") % 3 != 0, F.col("value")))
    value, spread = gd.missing_filled(F.col("v"), [F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(None).cast("double")])
    return s.join(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey").select("p_partkey", r(value, "value", 4), r(spread, "uncertainty", 4))


EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1704067200 AS t, value FROM events)"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("t"), "value")


BOUND = 86400.0 * 10


@query("w1_bounded_integral", f"WITH {EV}, s AS (SELECT *, (t - lag(t) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(greatest(0, coalesce(sum(a) FILTER (WHERE t <= {BOUND}), 0)) / 1000, 4) AS integral FROM s GROUP BY user_id")
def w1(spark, sf_dir):
    return se.integral(events(spark, sf_dir), ["user_id"], "t", "value", F.lit(BOUND)).select("user_id", r(F.col("integral") / 1000, "integral", 4))


@query("d8_m25_value_at", f"WITH {EV}, s AS (SELECT *, lead(t) OVER w AS x, lead(value) OVER w AS y FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(CASE WHEN {BOUND} < min(t) THEN min_by(value, t) ELSE coalesce(max(CASE WHEN t <= {BOUND} AND {BOUND} < x THEN value + ({BOUND} - t) * (y - value) / (x - t) END), max_by(value, t)) END, 4) AS value FROM s GROUP BY user_id")
def d8(spark, sf_dir):
    return se.value_at(events(spark, sf_dir), ["user_id"], "t", "value", F.lit(BOUND)).select("user_id", r(F.col("value"), "value", 4))


@query("w4_moving_average", f"WITH {EV}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) - 1 AS k FROM ev) SELECT user_id, round(0.1 * sum(value * power(0.9, k)) + 0.9 * min_by(value, t) * power(0.9, max(k)), 5) AS average FROM s GROUP BY user_id")
def w4(spark, sf_dir):
    return se.moving_average(events(spark, sf_dir), ["user_id"], "t", "value", 0.9).select("user_id", r(F.col("average"), "average", 5))


@query("w7_step_angles", f"WITH {EV}, s AS (SELECT user_id, event_id, (t - lag(t) OVER w) / 1e5 AS px, value - lag(value) OVER w AS py, (lead(t) OVER w - t) / 1e5 AS nx, lead(value) OVER w - value AS ny FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(*) AS n, round(avg(acos(greatest(-1, least(1, (px*nx + py*ny) / sqrt((px*px + py*py) * (nx*nx + ny*ny)))))), 5) AS curvature FROM s WHERE sqrt((px*px + py*py) * (nx*nx + ny*ny)) > 1e-10 GROUP BY user_id")
def w7(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.col("t") / 1e5)
    return se.step_angles(e, ["user_id"], "t", ("x", "value")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("angle"), "curvature", 5))


@query("w8_autocorrelation", f"WITH {EV}, s AS (SELECT user_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS y FROM ev), c AS (SELECT user_id, stddev_pop(x) AS a, stddev_pop(y) AS b, covar_pop(x, y) AS c FROM s WHERE y IS NOT NULL GROUP BY user_id) SELECT user_id, round(CASE WHEN a > 1e-12 AND b > 1e-12 THEN c / (a * b) END, 5) + 0.0 AS autocorrelation FROM c")
def w8(spark, sf_dir):
    return se.autocorrelation(events(spark, sf_dir), ["user_id"], "t", "value").select("user_id", r(F.col("autocorrelation"), "autocorrelation", 5))


@query("a22_conservation", "SELECT user_id, round(stddev_pop(value) / abs(avg(value)), 6) AS score, round(avg(value) - stddev_pop(value), 5) AS low, round(avg(value) + stddev_pop(value), 5) AS high FROM events GROUP BY user_id")
def a22(spark, sf_dir):
    return se.conservation(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", r(F.col("score"), "score"), r(F.col("low"), "low", 5), r(F.col("high"), "high", 5))


@query("a24_extents", "WITH e AS (SELECT l_returnflag, min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, greatest(b - a, d - c) AS \"range\", round(a - 0.1 * greatest(b - a, d - c), 6) AS low_q, round(d + 0.1 * greatest(b - a, d - c), 6) AS high_d FROM e")
def a24(spark, sf_dir):
    return se.extents(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ("l_quantity", "l_discount")).select("l_returnflag", "range", r(F.col("low_l_quantity"), "low_q"), r(F.col("high_l_discount"), "high_d"))
