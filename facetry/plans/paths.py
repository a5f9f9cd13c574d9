"""Whole-structure and path queries; materials are brands (parts as sites) or orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.functions import tensor as t
from facetry.operators import paths as pa
from facetry.operators.sites import bag_entropy, structure_tensors
from facetry.plans.bonds import E_SQL, K, edges, nodes
from facetry.plans.registry import query
from facetry.plans.sites import EIGEN, NB, SITE, neighbours, r
from facetry.session import table


@query("b1_global_moments", "SELECT l_returnflag AS material, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(var_pop(l_quantity), 5) AS variance FROM lineitem GROUP BY l_returnflag")
def b1(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("material")).agg(r(F.avg(q), "mean"), r(F.stddev_pop(q), "std"), r(F.var_pop(q), "variance", 5))


@query("b2_formula_units", "WITH c AS (SELECT p_brand, p_type, count(*) * 6 AS n FROM part GROUP BY p_brand, p_type), g AS (SELECT p_brand, list(n) AS l FROM c GROUP BY p_brand) SELECT p_brand, CAST(list_reduce(l, lambda a, b: gcd(a, b)) AS BIGINT) AS units, round(list_max(l) / list_min(l), 6) AS ratio FROM g")
def b2(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg((F.count(F.lit(1)) * 6).alias("n"))
    return pa.formula_units(c, ["p_brand"], "n").join(c.groupBy("p_brand").agg(r(F.max("n") / F.min("n"), "ratio")), "p_brand")


@query("b3_packing_fraction", "SELECT p_brand, round(sum(4 / 3.0::DOUBLE * pi() * power(p_size / 10.0, 3)) / 1000, 4) AS packing FROM part GROUP BY p_brand")
def b3(spark, sf_dir):
    return pa.packing_fraction(table(spark, sf_dir, "part").withColumn("radius", F.col("p_size") / 10.0), ["p_brand"], "radius", F.lit(1000.0)).select("p_brand", r(F.col("packing"), "packing", 4))


@query("b4_coordination_entropy", f"WITH {NB}, n AS (SELECT center, max(element) AS e, count(*) AS c FROM nb GROUP BY center), p AS (SELECT e, count(*) / sum(count(*)) OVER (PARTITION BY e) AS p FROM n GROUP BY e, c) SELECT e AS material, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY e")
def b4(spark, sf_dir):
    n = neighbours(spark, sf_dir).groupBy("center").agg(F.max("element").alias("material"), F.count(F.lit(1)).alias("c"))
    return bag_entropy(n, ["material"], F.col("c")).select("material", r(F.col("entropy"), "entropy"))


@query("b5_histogram_entropy", """WITH f AS (SELECT o_orderpriority AS k, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY k),
    w AS (SELECT *, CAST(ceil((hi - lo) / least(2 * iqr / power(n, 1/3.0::DOUBLE), (hi - lo) / (log2(n) + 1))) AS BIGINT) AS bins FROM f), b AS (SELECT k, least(bins - 1, CAST(floor((o_totalprice - lo) / (hi - lo) * bins) AS BIGINT)) AS bin FROM orders JOIN w ON k = o_orderpriority), p AS (SELECT k, count(*) / sum(count(*)) OVER (PARTITION BY k) AS p FROM b GROUP BY k, bin)
    SELECT k AS material, round(-sum(p * log2(p)), 5) AS entropy FROM p GROUP BY k""")
def b5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("material"), "o_totalprice")
    return pa.histogram_entropy(o, ["material"], "o_totalprice").select("material", r(F.col("entropy"), "entropy", 5))


KIND_SITE = SITE.replace("SELECT center,", "SELECT center, element,").replace("GROUP BY center", "GROUP BY center, element")


@query("b6_bulk_anisotropy", f"WITH {NB}, {KIND_SITE}, {EIGEN} SELECT element, round(avg((e1 - e3) / (xx + yy + zz)), 5) + 0.0 AS anisotropy FROM e GROUP BY element")
def b6(spark, sf_dir):
    e = F.col("e")
    x = structure_tensors(neighbours(spark, sf_dir), ["center", "element"]).withColumn("e", t.eigenvalues(F.col("tensor")))
    return x.groupBy("element").agg(r(F.avg((e[0] - e[2]) / (e[0] + e[1] + e[2])), "anisotropy", 5))


@query("b7_octahedra", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 6 AND bool_and(l_returnflag <> 'R') AND max(l_quantity) / 50 > 0.75")
def b7(spark, sf_dir):
    return pa.octahedra(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_quantity") / 50)


@query("b8_force_covariance", f"WITH {NB}, f AS (SELECT element, x AS fx, y AS fy, z AS fz, d AS vx, l_tax * 10 AS vy, 1.0 AS vz FROM nb) SELECT element, round(var_pop(fx) + var_pop(fy) + var_pop(fz), 5) AS trace, round(sum(sqrt(power(vy*fz - vz*fy, 2) + power(vz*fx - vx*fz, 2) + power(vx*fy - vy*fx, 2))) / 1000, 3) AS torsion FROM f GROUP BY element")
def b8(spark, sf_dir):
    f = neighbours(spark, sf_dir).withColumn("t", F.col("l_tax") * 10).withColumn("one", F.lit(1.0))
    return pa.force_covariance(f, ["element"], ("x", "y", "z"), ("d", "t", "one")).select("element", r(F.col("trace"), "trace", 5), r(F.col("torsion") / 1000, "torsion", 3))


def _log_det_sql(names: list[str], ridge: str = "1e-6") -> str:
    """Pivots of the correlation matrix plus a ridge, one elimination step a table."""
    n = range(len(names))
    first = ", ".join(f"CASE WHEN stddev_pop({names[i]}) > 1e-12 AND stddev_pop({names[j]}) > 1e-12 THEN covar_pop({names[i]}, {names[j]}) / (stddev_pop({names[i]}) * stddev_pop({names[j]})) ELSE 0 END{f' + {ridge}' if i == j else ''} AS a{i}_{j}" for i in n for j in n if i <= j)
    steps = [f"s0 AS (SELECT element, {first} FROM f GROUP BY element)"]
    for k in n[:-1]:
        rest = ", ".join(f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in n for j in n if k < i <= j)
        steps.append(f"s{k + 1} AS (SELECT element, {rest}, {'ln(a0_0)' if k == 0 else f'total + ln(a{k}_{k})'} AS total FROM s{k})")
    return ", ".join(steps) + f" SELECT element, round(total + ln(a{n[-1]}_{n[-1]}), 5) + 0.0 AS log_det FROM s{n[-1]}"


@query("b9_log_volume", f"WITH {NB}, f AS (SELECT element, x, y, z, l_tax, l_partkey % 7 * 1.0::DOUBLE AS u, l_partkey % 11 * 1.0::DOUBLE AS v FROM nb), {_log_det_sql(['x', 'y', 'z', 'l_tax', 'u', 'v'])}")
def b9(spark, sf_dir):
    n = neighbours(spark, sf_dir).withColumn("u", F.col("l_partkey") % 7 * 1.0).withColumn("v", F.col("l_partkey") % 11 * 1.0)
    return pa.log_volume(n, ["element"], ["x", "y", "z", "l_tax", "u", "v"]).select("element", r(F.col("log_det"), "log_det", 5))


@query("b10_energy_per_site", "SELECT l_orderkey, round(sum(l_extendedprice) / count(*), 6) AS energy FROM lineitem GROUP BY l_orderkey")
def b10(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(r(F.sum("l_extendedprice") / F.count(F.lit(1)), "energy", 6))


@query("b11_simple_paths", f"WITH {E_SQL} SELECT x.material, count(*) AS paths FROM w x JOIN w y ON y.material = x.material AND y.a = x.b AND y.b <> x.a WHERE x.a < y.b GROUP BY x.material")
def b11(spark, sf_dir):
    return pa.simple_paths(edges(spark, sf_dir), K, 3).groupBy("material").agg(F.count(F.lit(1)).alias("paths"))


@query("b12_b13_path_statistics", f"WITH {E_SQL}, n AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), p AS (SELECT x.material, a.x AS x1, b.x AS x2, c.x AS x3, a.y AS y1, b.y AS y2, c.y AS y3 FROM w x JOIN w y ON y.material = x.material AND y.a = x.b AND y.b <> x.a JOIN n a ON a.node = x.a JOIN n b ON b.node = x.b JOIN n c ON c.node = y.b WHERE x.a < y.b) SELECT material, count(*) AS paths, round(avg(greatest(x1, x2, x3) - least(x1, x2, x3)), 5) AS mean_range, max(greatest(x1, x2, x3)) AS max_maximum, round(avg((x1*y1 + x2*y2 + x3*y3) / 3 - (x1 + x2 + x3) * (y1 + y2 + y3) / 9), 3) AS mean_covariance, round(avg(((x2-x1)*(x2-x1) + (x3-x2)*(x3-x2)) / 2), 4) AS mean_step_square FROM p GROUP BY material")
def b12(spark, sf_dir):
    rows = pa.walked(edges(spark, sf_dir), nodes(spark, sf_dir), K, 3, ["size", "price"])
    s = pa.over_paths(pa.path_statistics(rows, K, "size", "price"), K, ["range", "maximum", "covariance", "step_square"])
    return s.select("material", "paths", r(F.col("mean_range"), "mean_range", 5), "max_maximum", r(F.col("mean_covariance"), "mean_covariance", 3), r(F.col("mean_step_square"), "mean_step_square", 4))


@query("b12_path_features", f"""WITH {E_SQL}, n AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 7 AS DOUBLE) AS z, CAST(p_partkey % 11 AS DOUBLE) AS q FROM part),
    s AS (SELECT material, a, b, CASE WHEN a < b THEN 1 ELSE -1 END AS f, least(a, b) % 3 - 1 AS i, greatest(a, b) % 2 AS j FROM w),
    p AS (SELECT s.material, a.x AS x1, b.x AS x2, c.x AS x3, a.q AS q1, b.q AS q2, c.q AS q3, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-b.x AS vx, c.y-b.y AS vy, c.z-b.z AS vz, s.f*s.i + t.f*t.i AS wi, s.f*s.j + t.f*t.j AS wj
        FROM s JOIN s t ON t.material = s.material AND t.a = s.b AND t.b <> s.a JOIN n a ON a.node = s.a JOIN n b ON b.node = s.b JOIN n c ON c.node = t.b WHERE s.a < t.b),
    r AS (SELECT *, sqrt((ux*ux+uy*uy+uz*uz) * (vx*vx+vy*vy+vz*vz)) AS m, least(x1, x2, x3) AS lo, greatest(x1, x2, x3) AS hi FROM p),
    g AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE len(list_distinct([least(9, floor((x1-lo)/(hi-lo)*10)), least(9, floor((x2-lo)/(hi-lo)*10)), least(9, floor((x3-lo)/(hi-lo)*10))])) END AS kinds FROM r)
    SELECT material, count(*) AS paths, round(avg(CASE WHEN m > 1e-10 THEN acos(greatest(-1, least(1, (ux*vx+uy*vy+uz*vz) / m))) END), 5) AS mean_curvature, round(max(sqrt(16*wi*wi + 25*wj*wj) / 3), 5) AS max_wrapping, round(avg(sqrt(16*wi*wi + 25*wj*wj) / 3), 5) AS mean_wrapping,
        round(avg((ux*ux+uy*uy+uz*uz + vx*vx+vy*vy+vz*vz) / 2), 3) AS mean_gradient, round(avg((x1*q1+x2*q2+x3*q3)/3 - (x1+x2+x3)*(q1+q2+q3)/9), 4) AS mean_charge_potential, round(avg(CASE kinds WHEN 1 THEN 0 WHEN 2 THEN log2(3) - 2/3 ELSE log2(3) END), 5) AS mean_entropy,
        round(avg(CASE WHEN x1 <> x2 AND x2 <> x3 THEN sign((x2-x1)*(x3-x2)) END), 5) AS mean_autocorrelation FROM g GROUP BY material""")
def b12_features(spark, sf_dir):
    """Curvature, wrapping norm, force gradient, charge-potential covariance, entropy and autocorrelation of each path of three
    parts, from one row a path: places as forces, size as charge, key mod 11 as potential."""
    at = table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"), g.vec(F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_partkey") % 7).alias("force"), (F.col("p_partkey") % 11).cast("double").alias("q"))
    e = edges(spark, sf_dir)
    place = lambda end: at.select("material", F.col("node").alias(end), F.col("force").alias(f"p{end}"))
    e = e.join(place("u"), ["material", "u"]).join(place("v"), ["material", "v"]).select("material", "u", "v", g.sub(F.col("pv"), F.col("pu")).alias("step"), g.vec(F.col("u") % 3 - 1, F.col("v") % 2, F.lit(0.0)).alias("image"))
    rows = pa.walked(e, at, K, 3, ["x", "q", "force"], ["step", "image"])
    cell = F.array(*[F.lit(x) for x in (4.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 6.0)])
    made = rows.select(*K, "path", pa.path_curvature(F.col("step")).alias("curvature"), pa.path_wrapping(F.col("image"), cell).alias("wrapping"), pa.path_gradient(F.col("force")).alias("gradient"), pa.path_covariance(F.col("x"), F.col("q")).alias("charge_potential"), pa.path_entropy(F.col("x")).alias("entropy"), pa.path_autocorrelation(F.col("x")).alias("autocorrelation"))
    s = pa.over_paths(made, K, ["curvature", "wrapping", "gradient", "charge_potential", "entropy", "autocorrelation"])
    return s.select("material", "paths", r(F.col("max_wrapping"), "max_wrapping", 5), *[r(F.col(f"mean_{c}"), f"mean_{c}", n) for c, n in (("curvature", 5), ("wrapping", 5), ("gradient", 3), ("charge_potential", 4), ("entropy", 5), ("autocorrelation", 5))])
