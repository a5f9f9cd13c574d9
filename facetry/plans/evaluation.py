"""Scaling and evaluation queries over parts, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import descriptors as d
from facetry.operators import evaluation as ev
from facetry.operators import scaling
from facetry.plans.registry import query
from facetry.plans.sites import r
from facetry.session import table


@query("l1_normalized", "SELECT c_custkey, round(coalesce((c_acctbal - avg(c_acctbal) OVER w) / CASE WHEN coalesce(stddev_samp(c_acctbal) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(c_acctbal) OVER w END, 0), 6) + 0.0 AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def l1(spark, sf_dir):
    return scaling.normalized(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_acctbal"], ["c_nationkey"]).select("c_custkey", r(F.col("c_acctbal"), "z"))


@query("l2_l3_l4_scalers", """WITH s AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d, min(p_retailprice) AS lo, max(p_retailprice) - min(p_retailprice) AS ra, quantile_cont(p_retailprice, 0.5) AS me, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr FROM part GROUP BY p_brand)
    SELECT p_partkey, round((p_retailprice - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) + 0.0 AS standard, round((p_retailprice - lo) / CASE WHEN ra = 0 THEN 1 ELSE ra END, 6) AS minmax, round((p_retailprice - me) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) + 0.0 AS robust FROM part JOIN s USING (p_brand)""")
def l2(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("standard"), F.col("p_retailprice").alias("minmax"), F.col("p_retailprice").alias("robust"))
    names = ["standard", "minmax", "robust"]
    fitted = scaling.fit(p, names, {n: n for n in names}, ["p_brand"])
    return scaling.transform(p, fitted, names, ["p_brand"]).select("p_partkey", *[r(F.col(n), n) for n in names])


@query("l5_inverse", "SELECT p_partkey, round(p_retailprice, 5) AS price FROM part")
def l5(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    fitted = scaling.fit(p.where("p_partkey % 2 = 0"), ["price"], "robust")
    return scaling.inverse(scaling.transform(p, fitted, ["price"]), fitted, ["price"]).select("p_partkey", r(F.col("price"), "price", 5))


@query("a19_a26_feature_summary", "SELECT 'p_size' AS feature, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, round(avg(p_size), 5) AS mean, round(var_pop(p_size), 5) AS variance FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 5), round(var_pop(p_retailprice), 5) FROM part")
def a26(spark, sf_dir):
    return scaling.summary(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("feature", "low", "high", r(F.col("mean"), "mean", 5), r(F.col("variance"), "variance", 5))


LINE = "WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b, var_pop(x) * count(*) AS sxx FROM p)"


def line(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("x"), F.col("p_retailprice").alias("y"))


@query("l8_l9_linear_probe", f"{LINE} SELECT p_partkey, y AS true_y, round(my + b * (x - mx), 4) AS pred_y FROM p, s")
def l8(spark, sf_dir):
    return ev.predictions(line(spark, sf_dir), ["p_partkey"], "x", ["y"]).select("p_partkey", "true_y", r(F.col("pred_y"), "pred_y", 4))


@query("l10_l11_leave_one_out", f"{LINE} SELECT p_partkey, round(y - my - b * (x - mx), 4) + 0.0 AS train_error, round((y - my - b * (x - mx)) / (1 - 1 / n - (x - mx) * (x - mx) / sxx), 4) + 0.0 AS test_error FROM p, s")
def l10(spark, sf_dir):
    return ev.leave_one_out(line(spark, sf_dir), ["p_partkey"], "x", "y").select("p_partkey", r(F.col("train_error"), "train_error", 4), r(F.col("test_error"), "test_error", 4))


@query("l12_l13_s15_error_rows", f"{LINE}, q AS (SELECT p_partkey, y, my + b * (x - mx) AS h FROM p, s) SELECT CAST(p_partkey AS VARCHAR) AS label, round(y, 4) AS true, round(h, 4) AS pred, round(h - y, 4) + 0.0 AS error, round(abs(h - y) / abs(y) * 100, 4) AS relative_percent FROM q UNION ALL SELECT 'METRICS', round(avg(abs(h - y)), 4), round(sqrt(avg((h - y) * (h - y))), 4), round(1 - sum((h - y) * (h - y)) / (var_pop(y) * count(*)), 4), NULL FROM q")
def l12(spark, sf_dir):
    p = ev.predictions(line(spark, sf_dir), ["p_partkey"], "x", ["y"]).select(F.col("p_partkey").alias("label"), F.col("true_y").alias("true"), F.col("pred_y").alias("pred"))
    return ev.with_metrics_row(p, "label").select("label", r(F.col("true"), "true", 4), r(F.col("pred"), "pred", 4), r(F.col("error"), "error", 4), r(F.col("relative_percent"), "relative_percent", 4))


@query("a20_a21_error_metrics", "SELECT p_brand, round(avg(abs(p_size * 20 - p_retailprice)), 4) AS mae, round(sqrt(avg(power(p_size * 20 - p_retailprice, 2))), 4) AS rmse, round(1 - sum(power(p_size * 20 - p_retailprice, 2)) / (var_pop(p_retailprice) * count(*)), 4) AS r2 FROM part GROUP BY p_brand")
def a20(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("true"), (F.col("p_size") * 20.0).alias("pred"))
    return ev.metrics(p, ["p_brand"]).select("p_brand", r(F.col("mae"), "mae", 4), r(F.col("rmse"), "rmse", 4), r(F.col("r2"), "r2", 4))


@query("a23_t2_leaderboard", "SELECT p_brand, round(avg(p_size), 6) AS score, min_by(p_partkey, (p_size, p_partkey)) AS best FROM part GROUP BY p_brand ORDER BY score, p_brand")
def a23(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(r(F.avg("p_size"), "score"), F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("best"))
    return ev.leaderboard(m, "score", "p_brand")


@query("a25_l14_embedding_statistics", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, label, round(list_sum(e) / 64, 6) + 0.0 AS mean, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64 - power(list_sum(e) / 64, 2)), 6) AS std, list_min(e) AS low, list_max(e) AS high FROM e")
def a25(spark, sf_dir):
    return ev.embedding_statistics(table(spark, sf_dir, "embeddings"), ["vec_id", "label"], "embedding").select("vec_id", "label", r(F.col("mean"), "mean"), r(F.col("std"), "std"), "low", "high")


@query("l15_cosine_similarity", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS a_vec_id, b.vec_id AS b_vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM e a, e b WHERE a.vec_id % 50 = 0")
def l15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # Rounded by plain arithmetic, half away from zero as in the SQL: ``round`` makes a decimal number of every pair.
    c = F.col("cosine")
    rounded = F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6 + 0.0
    return ev.cosine_similarity(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding").select("a_vec_id", "b_vec_id", rounded.alias("cosine"))


@query("l16_principal_components")
def l16(spark, sf_dir):
    return ev.principal_components(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").select("vec_id", r(F.col("pc1"), "pc1", 5), r(F.col("pc2"), "pc2", 5))


@query("l17_l18_clusters")
def l17(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = ev.clustered(e, "embedding", ev.k_means(e, "embedding"))
    s = ev.mean_silhouettes(e, "vec_id", "embedding", {k: f"k{k}" for k in (2, 3, 4, 5)})
    return s.select("k", "n", r(F.col("silhouette"), "silhouette", 4), "best")


@query("l18_label_silhouette", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(list_distance(a.e, b.e)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL), s AS (SELECT vec_id, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM p GROUP BY vec_id) SELECT vec_id, round(coalesce((b - a) / greatest(a, b), 0), 5) + 0.0 AS silhouette FROM s")
def l18(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return ev.silhouette(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label").select("vec_id", r(F.col("silhouette"), "silhouette", 5))


@query("l19_quartiles", "SELECT p_brand, round(quantile_cont(abs(p_size - 25), 0.25), 4) AS q25, round(quantile_cont(abs(p_size - 25), 0.5), 4) AS q50, round(quantile_cont(abs(p_size - 25), 0.75), 4) AS q75 FROM part GROUP BY p_brand")
def l19(spark, sf_dir):
    q = ev.quartiles(table(spark, sf_dir, "part").withColumn("e", F.col("p_size") - 25), ["p_brand"], "e")
    return q.select("p_brand", *[r(F.col(c), c, 4) for c in ("q25", "q50", "q75")])


@query("l20_target_correlation", "SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS correlation FROM part GROUP BY p_brand")
def l20(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(r(F.corr("p_size", "p_retailprice"), "correlation"))


@query("l21_w6_batch_plan", "WITH b AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey, CAST(p // 4 AS BIGINT) AS batch FROM b WHERE NOT (n % 4 = 1 AND p = n - 1)")
def l21(spark, sf_dir):
    return ev.batch_plan(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_custkey"], 4, ["c_nationkey"])


@query("l6_jitter")
def l6(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", scaling.jitter(3, 0.5, "p_partkey").alias("e"))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), r(F.avg("e"), "mean", 4), r(F.stddev_pop("e"), "std", 4))


@query("m26_m27_cosine_error", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(power(1 - list_cosine_similarity(a.e, b.e), 2), 6) AS error FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def m26(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", r(d.scaled_cosine_error(F.col("a"), F.col("b")), "error"))
