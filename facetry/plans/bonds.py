"""1- and 2-simplex and graph queries. Binding: parts of a brand are nodes of that brand's graph; two are
joined when one order holds both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.functions import descriptors as d
from facetry.functions import geometry as g
from facetry.functions import tensor as t
from facetry.operators import graphs as gr
from facetry.operators import scaling as sc
from facetry.operators import triangles as tr
from facetry.plans.registry import query
from facetry.plans.sites import DIRECTION, EIGEN, NB, SITE, neighbours, r
from facetry.session import table, tasks, written

K = ["material"]
E_SQL = """lp AS (SELECT DISTINCT l_orderkey, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT DISTINCT a.p_brand AS material, a.l_partkey AS u, b.l_partkey AS v FROM lp a JOIN lp b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand AND a.l_partkey < b.l_partkey),
    w AS (SELECT material, u AS a, v AS b FROM e UNION ALL SELECT material, v, u FROM e)"""
N_SQL = "n AS (SELECT p_partkey AS node, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part)"
T_SQL = "tri AS (SELECT DISTINCT x.material, least(x.a, x.b, y.b) AS i, x.a + x.b + y.b - least(x.a, x.b, y.b) - greatest(x.a, x.b, y.b) AS j, greatest(x.a, x.b, y.b) AS k FROM w x JOIN w y ON x.material = y.material AND x.a = y.a AND x.b < y.b)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    known = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("material")), "l_partkey").where("l_orderkey is not null and material is not null")
    # Dealt by order and brand once. Most lines are the only one of their brand in an order, or repeat a part; a sort finds the others.
    w = W.partitionBy("l_orderkey", "material").orderBy("l_partkey")
    sides = known.repartition(tasks(lines.count()), "l_orderkey", "material").withColumns({"_p": F.lag("l_partkey").over(w), "_n": F.lead("l_partkey").over(w)})
    held = written(sides.where("(_p is null or _p <> l_partkey) and (_p is not null or _n is not null)").drop("_p", "_n"), "held")
    held = held.repartition(tasks(held.count()), "l_orderkey", "material")
    pairs = held.join(held.withColumnRenamed("l_partkey", "other"), ["l_orderkey", "material"]).where("l_partkey < other")
    return gr.simple_edges(pairs, K, "l_partkey", "other")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))


def weighed(spark, sf_dir) -> DataFrame:
    return gr.end_attributes(edges(spark, sf_dir), nodes(spark, sf_dir), K, ["price", "size"])


@query("g1_simple_edges", f"WITH {E_SQL} SELECT material, u, v FROM e")
def g1(spark, sf_dir):
    return edges(spark, sf_dir)


@query("g2_degree", f"WITH {E_SQL} SELECT material, a AS node, count(*) AS degree FROM w GROUP BY material, a")
def g2(spark, sf_dir):
    return gr.degrees(edges(spark, sf_dir), K)


@query("g3_three_cycles", f"WITH {E_SQL} SELECT e.material, e.u, e.v, (SELECT count(*) FROM w x JOIN w y ON x.b = y.b WHERE x.material = e.material AND y.material = e.material AND x.a = e.u AND y.a = e.v) AS n3 FROM e")
def g3(spark, sf_dir):
    return gr.three_cycles(edges(spark, sf_dir), K)


@query("g4_four_cycles", f"WITH {E_SQL}, c AS (SELECT e.material, e.u, e.v, count(*) AS n FROM e JOIN w x ON x.a = e.u AND x.material = e.material AND x.b <> e.v JOIN w y ON y.a = x.b AND y.material = e.material AND y.b <> e.u AND y.b <> e.v JOIN w z ON z.a = y.b AND z.b = e.v AND z.material = e.material GROUP BY ALL) SELECT e.material, e.u, e.v, coalesce(n, 0) AS n4, CAST(coalesce(n, 0) // 2 AS BIGINT) AS n4_halved FROM e LEFT JOIN c USING (material, u, v)")
def g4(spark, sf_dir):
    return gr.four_cycles(edges(spark, sf_dir), K)


@query("g5_wedges", f"WITH {E_SQL}, {T_SQL} SELECT * FROM tri")
def g5(spark, sf_dir):
    return gr.wedges(edges(spark, sf_dir), K)


@query("g6_wedge_centres", f"WITH {E_SQL}, {T_SQL} SELECT tri.*, CASE WHEN ij.u IS NOT NULL AND ik.u IS NOT NULL THEN i WHEN ij.u IS NOT NULL AND jk.u IS NOT NULL THEN j ELSE k END AS centre FROM tri LEFT JOIN e ij ON ij.material = tri.material AND ij.u = i AND ij.v = j LEFT JOIN e ik ON ik.material = tri.material AND ik.u = i AND ik.v = k LEFT JOIN e jk ON jk.material = tri.material AND jk.u = j AND jk.v = k")
def g6(spark, sf_dir):
    e = edges(spark, sf_dir)
    return gr.wedge_centres(gr.wedges(e, K), e, K)


@query("g6_wedge_images", f"""WITH {E_SQL}, {T_SQL}, m AS (SELECT e.*, (u + v) % 3 - 1 AS ia, u % 2 AS ib, abs(u - v) % 4 AS ic FROM e), z AS (SELECT material, u AS a, v AS b, ia, ib, ic FROM m UNION ALL SELECT material, v, u, -ia, -ib, -ic FROM m),
    c AS (SELECT tri.*, CASE WHEN ij.u IS NOT NULL AND ik.u IS NOT NULL THEN i WHEN ij.u IS NOT NULL AND jk.u IS NOT NULL THEN j ELSE k END AS centre FROM tri LEFT JOIN e ij ON ij.material = tri.material AND ij.u = i AND ij.v = j LEFT JOIN e ik ON ik.material = tri.material AND ik.u = i AND ik.v = k LEFT JOIN e jk ON jk.material = tri.material AND jk.u = j AND jk.v = k),
    o AS (SELECT *, CASE WHEN centre = i THEN j ELSE i END AS first, CASE WHEN centre = k THEN j ELSE k END AS second FROM c)
    SELECT o.*, p.ia AS a1, p.ib AS b1, p.ic AS c1, q.ia AS a2, q.ib AS b2, q.ic AS c2 FROM o JOIN z p ON p.material = o.material AND p.a = centre AND p.b = first JOIN z q ON q.material = o.material AND q.a = centre AND q.b = second""")
def g6_images(spark, sf_dir):
    """Centres of triples with the images of the two neighbours; every edge also has a farther image that is not taken."""
    e = edges(spark, sf_dir)
    image = F.array((F.col("u") + F.col("v")) % 3 - 1, F.col("u") % 2, F.abs(F.col("u") - F.col("v")) % 4)
    near = e.withColumn("image", image).withColumn("distance", F.lit(1.0))
    far = e.withColumn("image", F.array(*[F.lit(-9).cast("long")] * 3)).withColumn("distance", F.lit(2.0))
    got = gr.wedge_images(gr.wedge_centres(gr.wedges(e, K), e, K), near.unionByName(far), K)
    return got.select("material", "i", "j", "k", "centre", "first", "second", *[F.col(f"image_{side}")[n].alias(f"{c}{m}") for m, side in ((1, "first"), (2, "second")) for n, c in enumerate("abc")])


@query("l6_jittered_edges", f"""WITH {E_SQL}, q AS (SELECT p_partkey AS node, p_size + (p_partkey % 5 - 2) / 100 AS x, p_retailprice / 100 - (p_partkey % 3) / 50 AS y, p_partkey % 7 + 0.01 AS z FROM part)
    SELECT material, u, v, round(b.x - a.x, 6) AS dx, round(b.y - a.y, 6) AS dy, round(b.z - a.z, 6) + 0.0 AS dz FROM e JOIN q a ON a.node = u JOIN q b ON b.node = v""")
def l6_edges(spark, sf_dir):
    """Steps of the edges after sites have moved by offsets that both engines know."""
    return shaken(spark, sf_dir)[1].select("material", "u", "v", *[r(F.col("step")[n], f"d{c}") for n, c in enumerate("xyz")])


@query("l6_jittered_normals", f"""WITH {E_SQL}, {T_SQL}, q AS (SELECT p_partkey AS node, p_size + (p_partkey % 5 - 2) / 100 AS x, p_retailprice / 100 - (p_partkey % 3) / 50 AS y, p_partkey % 7 + 0.01 AS z FROM part),
    s AS (SELECT tri.*, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz FROM tri JOIN q a ON a.node = i JOIN q b ON b.node = j JOIN q c ON c.node = k),
    m AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) + 1e-8 AS m FROM s) SELECT material, i, j, k, round(nx / m, 5) + 0.0 AS nx, round(ny / m, 5) + 0.0 AS ny, round(nz / m, 5) + 0.0 AS nz FROM m""")
def l6_normals(spark, sf_dir):
    return shaken(spark, sf_dir)[2].select("material", "i", "j", "k", *[r(F.col("normal")[n], f"n{c}", 5) for n, c in enumerate("xyz")])


def shaken(spark, sf_dir):
    at = table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 7).cast("double").alias("z"))
    e = edges(spark, sf_dir)
    return sc.jittered(at, e, gr.wedges(e, K), K, [(F.col("node") % 5 - 2) / 100, -(F.col("node") % 3) / 50, F.lit(0.01)])


@query("m33_reduction_factor", f"WITH {E_SQL}, {T_SQL}, {N_SQL} SELECT material, i, j, k, round(least(a.size, b.size, c.size) / ((a.size + b.size + c.size) / 3), 6) AS factor FROM tri JOIN n a ON a.node = i JOIN n b ON b.node = j JOIN n c ON c.node = k")
def m33(spark, sf_dir):
    t_ = tr.at_vertices(gr.wedges(edges(spark, sf_dir), K), nodes(spark, sf_dir), K, {"size": "s"})
    return t_.select("material", "i", "j", "k", r(d.reduction_factor(F.col("si"), F.col("sj"), F.col("sk")), "factor"))


@query("j1_m19_bond_attributes", f"WITH {E_SQL}, {N_SQL} SELECT material, u, v, round(abs(a.price - b.price), 4) AS delta_price, round((a.price + b.price) / 2, 4) AS avg_price, abs(a.size - b.size) AS delta_size, (a.size + b.size) / 2 AS avg_size, round(1 - exp(-power(a.size / 10 - b.size / 10, 2) / 4), 6) AS ionic_character FROM e LEFT JOIN n a ON a.node = u LEFT JOIN n b ON b.node = v")
def j1(spark, sf_dir):
    return weighed(spark, sf_dir).select("material", "u", "v", r(F.col("delta_price"), "delta_price", 4), r(F.col("avg_price"), "avg_price", 4), "delta_size", "avg_size", r(d.ionic_character(F.col("delta_size") / 10, F.lit(0.0)), "ionic_character"))


@query("m14_m16_bond_tensors", f"""WITH {NB}, o AS (SELECT center, sum(x*x) AS xx, sum(y*y) AS yy, sum(z*z) AS zz, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*z) AS yz FROM nb GROUP BY center),
    p AS (SELECT a.center, a.xx*b.xx + a.yy*b.yy + a.zz*b.zz + 2*(a.xy*b.xy + a.xz*b.xz + a.yz*b.yz) AS ab, a.xx*a.xx + a.yy*a.yy + a.zz*a.zz + 2*(a.xy*a.xy + a.xz*a.xz + a.yz*a.yz) AS aa, b.xx*b.xx + b.yy*b.yy + b.zz*b.zz + 2*(b.xy*b.xy + b.xz*b.xz + b.yz*b.yz) AS bb,
        (a.xx*b.xy + a.xy*b.yy + a.xz*b.yz) - (b.xx*a.xy + b.xy*a.yy + b.xz*a.yz) AS c1, (a.xx*b.xz + a.xy*b.yz + a.xz*b.zz) - (b.xx*a.xz + b.xy*a.yz + b.xz*a.zz) AS c2, (a.xy*b.xz + a.yy*b.yz + a.yz*b.zz) - (b.xy*a.xz + b.yy*a.yz + b.yz*a.zz) AS c3
        FROM o a JOIN o b ON b.center = a.center + 1)
    SELECT center, round(ab / sqrt(aa * bb), 6) AS alignment, round(sqrt(2 * (c1*c1 + c2*c2 + c3*c3)), 4) AS incompatibility FROM p""")
def m14(spark, sf_dir):
    from facetry.operators.sites import structure_tensors

    a = structure_tensors(neighbours(spark, sf_dir), ["center"])
    b = a.select((F.col("center") - 1).alias("center"), F.col("tensor").alias("other"))
    return a.join(b, "center").select("center", r(t.alignment(F.col("tensor"), F.col("other")), "alignment"), r(t.frobenius(t.commutator(F.col("tensor"), F.col("other"))), "incompatibility", 4))


@query("m17_m31_bond_couplings", f"WITH {NB}, c AS (SELECT center, element, x, y, z, d, l_tax AS p, sqrt(z*z*l_tax*l_tax + z*z*l_tax*l_tax*0 + (y*l_tax)*(y*l_tax)) AS cr FROM nb) SELECT center, count(*) AS n, round(sum(sqrt((y*p)*(y*p) + (z*p)*(z*p))), 6) AS coupling, round(sum((d*d + p*p) / 2 + 0.1 * abs(x*p) + 0.05 * sqrt((y*p)*(y*p) + (z*p)*(z*p)) + 0.01 * sqrt(d*d + p*p)), 6) AS invariant FROM c GROUP BY center")
def m17(spark, sf_dir):
    q, p = g.vec("x", "y", "z"), g.vec(F.col("l_tax"), 0.0, 0.0)
    return neighbours(spark, sf_dir).groupBy("center").agg(F.count(F.lit(1)).alias("n"), r(F.sum(d.symplectic_coupling(q, p)), "coupling"), r(F.sum(d.pseudo_symplectic(q, p)), "invariant"))


@query("m28_charge_imbalance", f"WITH {E_SQL}, {N_SQL} SELECT material, u, v, round(CASE WHEN abs(a.size) + abs(b.size) > 1e-10 THEN (b.size - a.size) / (abs(a.size) + abs(b.size)) ELSE 0 END, 6) AS imbalance, round(CASE WHEN abs(a.price - b.price) > 1e-10 THEN abs(b.size - a.size) / abs(a.price - b.price) END, 6) AS slope, round(a.price + b.price, 4) AS radii FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v")
def m28(spark, sf_dir):
    n = nodes(spark, sf_dir)
    both = edges(spark, sf_dir).join(n.select("material", F.col("node").alias("u"), F.col("size").alias("a"), F.col("price").alias("pa")), ["material", "u"]).join(n.select("material", F.col("node").alias("v"), F.col("size").alias("b"), F.col("price").alias("pb")), ["material", "v"])
    return both.select("material", "u", "v", r(d.charge_imbalance(F.col("a"), F.col("b")), "imbalance"), r(d.density_slope(F.col("a"), F.col("b"), F.abs(F.col("pa") - F.col("pb"))), "slope"), r(F.col("pa") + F.col("pb"), "radii", 4))


@query("m29_axis_alignment", f"WITH {NB} SELECT center, round(avg(exp(-sqrt(2) * sqrt(y*y + z*z) / d)), 6) AS a, round(avg(exp(-sqrt(2) * sqrt(x*x + z*z) / d)), 6) AS b FROM nb GROUP BY center")
def m29(spark, sf_dir):
    v = g.vec("x", "y", "z")
    return neighbours(spark, sf_dir).groupBy("center").agg(r(F.avg(d.axis_alignment(v, g.vec(1.0, 0.0, 0.0))), "a"), r(F.avg(d.axis_alignment(v, g.vec(0.0, 1.0, 0.0))), "b"))


@query("m30_environment_alignment", f"""WITH {NB}, {SITE}, {EIGEN}, {DIRECTION}, m AS (SELECT *, xx*xx + yy*yy + zz*zz + 2*(xy*xy + xz*xz + yz*yz) AS nn FROM v)
    SELECT a.center, round(greatest(0, least(1, 0.6 * (a.xx*b.xx + a.yy*b.yy + a.zz*b.zz + 2*(a.xy*b.xy + a.xz*b.xz + a.yz*b.yz)) / sqrt(a.nn * b.nn)
        + 0.4 * abs(a.c.x*b.c.x + a.c.y*b.c.y + a.c.z*b.c.z) / (a.len * b.len))), 3) AS alignment FROM m a JOIN m b ON b.center = a.center + 1""")
def m30(spark, sf_dir):
    from facetry.operators.sites import structure_tensors

    a = structure_tensors(neighbours(spark, sf_dir), ["center"])
    b = a.select((F.col("center") - 1).alias("center"), F.col("tensor").alias("other"))
    return a.join(b, "center").select("center", F.round(d.environment_alignment(F.col("tensor"), F.col("other")), 3).alias("alignment"))


def points(spark, sf_dir) -> DataFrame:
    """Each part as a point (size, price / 100, key mod 7)."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("node"), g.vec("p_size", F.col("p_retailprice") / 100, F.col("p_partkey") % 7).alias("p"))


def placed(spark, sf_dir) -> DataFrame:
    return tr.at_vertices(gr.wedges(edges(spark, sf_dir), K), points(spark, sf_dir), K, {"p": "p"})


P_SQL = f"""{E_SQL}, {T_SQL}, q AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 7 AS DOUBLE) AS z FROM part),
    s AS (SELECT tri.*, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS ij, sqrt((c.x-b.x)*(c.x-b.x) + (c.y-b.y)*(c.y-b.y) + (c.z-b.z)*(c.z-b.z)) AS jk, sqrt((a.x-c.x)*(a.x-c.x) + (a.y-c.y)*(a.y-c.y) + (a.z-c.z)*(a.z-c.z)) AS ik,
        (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz FROM tri JOIN q a ON a.node = i JOIN q b ON b.node = j JOIN q c ON c.node = k),
    h AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) / 2 AS area FROM s)"""


@query("m4_m5_triangle_shape", f"WITH {P_SQL} SELECT material, i, j, k, round(area, 5) AS area, round(greatest(0, least(1, 12 * sqrt(3.0::DOUBLE) * area / ((ij+jk+ik)*(ij+jk+ik)))), 5) AS shape_factor, round(CASE WHEN area > 0.01 THEN 8 * area * area / ((ij+jk+ik) * ij * jk * ik) * 1.0 END, 4) AS sphericity FROM h")
def m4(spark, sf_dir):
    x = F.col("x")
    return placed(spark, sf_dir).withColumn("x", g.triangle(F.col("pi"), F.col("pj"), F.col("pk"))).select("material", "i", "j", "k", r(x["area"], "area", 5), r(x["shape_factor"], "shape_factor", 5), r(F.when(x["area"] > 0.01, x["sphericity"]), "sphericity", 4))


@query("m6_centres", f"WITH {E_SQL}, {T_SQL}, {N_SQL} SELECT material, i, j, k, round((a.price + b.price) / 2, 4) AS middle, round((a.price + b.price + c.price) / 3, 4) AS centre_x, round((a.size + b.size + c.size) / 3, 4) AS centre_y FROM tri JOIN n a ON a.node = i JOIN n b ON b.node = j JOIN n c ON c.node = k")
def m6(spark, sf_dir):
    """Middle of the first side and barycentre of each triple."""
    at = nodes(spark, sf_dir).select("material", "node", g.vec(F.col("price"), F.col("size"), F.lit(0.0)).alias("x"))
    t = tr.at_vertices(gr.wedges(edges(spark, sf_dir), K), at, K, {"x": "x"})
    p = [F.col(f"x{c}") for c in "ijk"]
    return t.select("material", "i", "j", "k", r(g.midpoint(p[0], p[1])[0], "middle", 4), r(g.barycentre(*p)[0], "centre_x", 4), r(g.barycentre(*p)[1], "centre_y", 4))


@query("m16_m33_triangle_projection", f"WITH {P_SQL} SELECT material, i, j, k, round(CASE WHEN area > 0.01 THEN (nx*nx + 2*nx*ny + 3*ny*ny + 4*nz*nz) / (4*area*area) END, 4) AS projection, round(nx / 2 + ny / 2 + nz / 2, 4) + 0.0 AS flux FROM h")
def m16(spark, sf_dir):
    tensors = [F.array(*[F.lit(float(x)) for x in m]) for m in ((1, 0, 0, 0, 2, 0, 0, 0, 3), (0, 0, 0, 0, 1, 0, 0, 0, 1), (0, 1, 0, 1, 0, 0, 0, 0, 0))]
    p = [F.col(c) for c in ("pi", "pj", "pk")]
    area = g.norm(g.cross(g.sub(p[1], p[0]), g.sub(p[2], p[0]))) / 2
    return placed(spark, sf_dir).select("material", "i", "j", "k", r(F.when(area > 0.01, d.normal_projection(tensors, *p)), "projection", 4), r(d.gradient_flux([g.vec(1.0, 1.0, 1.0)] * 3, *p), "flux", 4))


@query("m32_stress_flow", f"""WITH {P_SQL} SELECT material, i, j, k, round(CASE WHEN area > 0.01 THEN 0.0 END, 4) AS closed_flow,
    round(CASE WHEN area > 0.01 THEN sqrt(greatest(0, 14 + 2 * (ik*ik - ij*ij - jk*jk) / (ij*jk) + 6 * (ij*ij - jk*jk - ik*ik) / (jk*ik) + 3 * (jk*jk - ij*ij - ik*ik) / (ij*ik))) END, 4) AS flow FROM h""")
def m32(spark, sf_dir):
    """Weights 1, 2, 3; and weights equal to the sides' lengths, which close the polygon of normals."""
    at = points(spark, sf_dir).select("material", "node", *[F.col("p")[n].alias(c) for n, c in enumerate("xyz")])
    t_ = tr.stress_flows(tr.at_vertices(gr.wedges(edges(spark, sf_dir), K), at, K, {c: c for c in "xyz"}), {"closed_flow": None, "flow": (1.0, 2.0, 3.0)})
    return t_.select("material", "i", "j", "k", *[r(F.when(F.col("area") > 0.01, F.col(c)), c, 4) for c in ("closed_flow", "flow")])


@query("a10_a13_vertex_statistics", f"WITH {E_SQL}, {T_SQL}, {N_SQL}, v AS (SELECT tri.*, unnest([i, j, k]) AS node FROM tri) SELECT material, i, j, k, round(avg(price), 4) AS avg_price, round(var_pop(price), 4) AS var_price, max(price) AS max_price, round(9 * var_pop(size), 4) AS vfe_laplacian_variance FROM v LEFT JOIN n USING (node) GROUP BY material, i, j, k")
def a10(spark, sf_dir):
    s = tr.energy_variance(tr.vertex_statistics(gr.wedges(edges(spark, sf_dir), K), nodes(spark, sf_dir), K, ["price", "size"]), "size")
    return s.select("material", "i", "j", "k", r(F.col("avg_price"), "avg_price", 4), r(F.col("var_price"), "var_price", 4), "max_price", r(F.col("vfe_laplacian_variance"), "vfe_laplacian_variance", 4))


ES_SQL = f"""WITH {E_SQL}, {T_SQL}, {N_SQL}, f AS (SELECT material, u, v, abs(a.price - b.price) AS dp FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v), p AS (SELECT *, unnest([struct_pack(u := i, v := j), struct_pack(u := j, v := k), struct_pack(u := i, v := k)]) AS s FROM tri)"""


@query("a11_a12_edge_statistics", f"{ES_SQL} SELECT p.material, i, j, k, count(f.u) AS n_sides, round(avg(dp), 4) AS avg_dp, round(sum(dp), 4) AS flux FROM p LEFT JOIN f ON f.material = p.material AND f.u = p.s.u AND f.v = p.s.v GROUP BY p.material, i, j, k")
def a11(spark, sf_dir):
    e = written(weighed(spark, sf_dir), "weighed")
    s = tr.edge_statistics(gr.wedges(e, K), e, K, ["delta_price"])
    return s.select("material", "i", "j", "k", "n_sides", r(F.col("avg_delta_price"), "avg_dp", 4), r(F.col("sum_delta_price"), "flux", 4))


@query("j4_g10_side_vectors", f"{ES_SQL}, o AS (SELECT p.material, i, j, k, max(CASE WHEN p.s.u = i AND p.s.v = j THEN coalesce(dp, 0) END) AS s0, max(CASE WHEN p.s.u = j THEN coalesce(dp, 0) END) AS s1, max(CASE WHEN p.s.u = i AND p.s.v = k THEN coalesce(dp, 0) END) AS s2 FROM p LEFT JOIN f ON f.material = p.material AND f.u = p.s.u AND f.v = p.s.v GROUP BY p.material, i, j, k) SELECT material, i, j, k, round(s0, 4) AS s0, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM o")
def j4(spark, sf_dir):
    e = weighed(spark, sf_dir).withColumn("f", F.array("delta_price", F.lit(1.0)))
    s = tr.side_vectors(gr.wedges(e, K), e, K, "f", 2)
    return s.select("material", "i", "j", "k", *[r(F.col("sides")[2 * n], f"s{n}", 4) for n in range(3)])


@query("j5_g9_triangle_means", f"{ES_SQL}, m AS (SELECT material, p.s.u AS u, p.s.v AS v, count(*) AS c, avg(i) AS mi FROM p GROUP BY ALL) SELECT e.material, e.u, e.v, coalesce(c, 0) AS n_triangles, round(coalesce(mi, 0), 4) AS mean_i FROM e LEFT JOIN m USING (material, u, v)")
def j5(spark, sf_dir):
    e = written(edges(spark, sf_dir), "edges")
    m = tr.mean_onto_edges(gr.wedges(e, K).withColumn("first", F.col("i").cast("double")), e, K, ["first"])
    return m.select("material", "u", "v", "n_triangles", r(F.col("mean_first"), "mean_i", 4))


@query("g7_gathered", f"WITH {E_SQL}, {N_SQL} SELECT material, u, v, a.size AS x0, b.size AS x1, round((a.size - b.size) * (a.size - b.size), 4) AS d2 FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v")
def g7(spark, sf_dir):
    x = nodes(spark, sf_dir).withColumn("f", F.array("size"))
    got = gr.gathered(edges(spark, sf_dir), x, K, "f", F.array(F.lit(1.0)), (F.col("_u")[0] - F.col("_v")[0]) ** 2)
    return got.select("material", "u", "v", F.col("gathered")[0].alias("x0"), F.col("gathered")[1].alias("x1"), r(F.col("gathered")[3], "d2", 4))


@query("g8_scatter_sum", f"WITH {E_SQL}, {N_SQL}, f AS (SELECT material, u, v, abs(a.price - b.price) AS dp FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v) SELECT material, node, round(sum(dp), 4) AS total, CAST(count(*) AS DOUBLE) AS n FROM (SELECT material, unnest([u, v]) AS node, dp FROM f) GROUP BY material, node")
def g8(spark, sf_dir):
    e = weighed(spark, sf_dir).withColumn("f", F.array("delta_price", F.lit(1.0)))
    return gr.scatter_sum(e, K, "f", 2).select("material", "node", r(F.col("sum")[0], "total", 4), F.col("sum")[1].alias("n"))


@query("g11_mean_pool", "SELECT p_brand AS material, round(avg(p_size), 6) AS m0, round(avg(p_retailprice), 4) AS m1 FROM part GROUP BY p_brand")
def g11(spark, sf_dir):
    return gr.pooled(nodes(spark, sf_dir).withColumn("f", F.array("size", "price")), K, "f", 2).select("material", r(F.col("mean")[0], "m0"), r(F.col("mean")[1], "m1", 4))


# An edge is in the forest unless smaller edges (by weight, then ends) join its ends.
@query("g12_h0_persistence", f"""WITH RECURSIVE {E_SQL}, {N_SQL}, d AS (SELECT material, u, v, abs(a.price - b.price) AS x FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v),
    s AS (SELECT material, u, v, x, row_number() OVER (ORDER BY x, u, v) AS k FROM d WHERE x <= 150.0), o AS (SELECT material, u AS a, v AS b, k FROM s UNION ALL SELECT material, v, u, k FROM s),
    reach AS (SELECT material, k, u AS node FROM s UNION SELECT r.material, r.k, o.b FROM reach r JOIN o ON o.material = r.material AND o.a = r.node AND o.k < r.k),
    forest AS (SELECT s.material, s.x FROM s LEFT JOIN reach r ON r.k = s.k AND r.node = s.v WHERE r.k IS NULL)
    SELECT p.material, coalesce(round(max(x), 4), 0.0) AS max_death, coalesce(round(stddev_pop(x), 4), 0.0) AS death_std FROM (SELECT DISTINCT p_brand AS material FROM part) p LEFT JOIN forest f ON f.material = p.material GROUP BY p.material""")
def g12(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return gr.h0_persistence(weighed(spark, sf_dir), n, K, "delta_price", 150.0).select("material", r(F.col("max_death"), "max_death", 4), r(F.col("death_std"), "death_std", 4))


# As above, with a centre's neighbours in place of a brand's parts.
@query("g12_centre_persistence", f"""WITH RECURSIVE {NB}, k AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY x, y, z) AS k FROM nb),
    d AS (SELECT a.center, a.k AS u, b.k AS v, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS x FROM k a JOIN k b ON a.center = b.center AND a.k < b.k),
    s AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY x, u, v) AS r FROM d WHERE x <= 6.0), o AS (SELECT center, u AS a, v AS b, r FROM s UNION ALL SELECT center, v, u, r FROM s),
    reach AS (SELECT center, r, u AS node FROM s UNION SELECT q.center, q.r, o.b FROM reach q JOIN o ON o.center = q.center AND o.a = q.node AND o.r < q.r),
    forest AS (SELECT s.center, s.x FROM s LEFT JOIN reach q ON q.center = s.center AND q.r = s.r AND q.node = s.v WHERE q.r IS NULL)
    SELECT c.center, coalesce(round(max(x), 6), 0.0) AS max_death, coalesce(round(stddev_pop(x), 6), 0.0) AS death_std FROM (SELECT DISTINCT center FROM nb) c LEFT JOIN forest f ON f.center = c.center GROUP BY c.center""")
def g12_centres(spark, sf_dir):
    """Rips deaths of every order's neighbourhood, computed once for each bag of neighbours' coordinates."""
    n = neighbours(spark, sf_dir)
    # Sums of hashes need no list of a centre's neighbours; sums of their halves stay in long.
    h = [F.xxhash64(F.lit(seed), "x", "y", "z") for seed in (1, 2)]
    bags = n.groupBy("center").agg(F.count(F.lit(1)).alias("n"), *[F.sum(half).alias(f"h{i}") for i, half in enumerate(y for x in h for y in (x.bitwiseAND(0xFFFFFFFF), F.shiftright(x, 32)))])
    bags = bags.select("center", "n", F.concat_ws("/", *[F.col(c).cast("string") for c in ("n", "h0", "h1", "h2", "h3")]).alias("fingerprint"))
    return gr.centre_persistence(n, ["center"], "l_linenumber", 6.0, fingerprints=bags).select("center", r(F.col("max_death"), "max_death"), r(F.col("death_std"), "death_std"))


@query("g13_g15_graph_summary", f"""WITH RECURSIVE {E_SQL}, reach AS (SELECT material, a AS node, a AS seen FROM w UNION SELECT r.material, r.node, w.b FROM reach r JOIN w ON w.material = r.material AND w.a = r.seen),
    parts AS (SELECT material, count(DISTINCT first) AS components FROM (SELECT material, node, min(seen) AS first FROM reach GROUP BY material, node) GROUP BY material),
    deg AS (SELECT material, a AS node, count(*) AS k FROM w GROUP BY material, a), ends AS (SELECT w.material, CAST(x.k AS DOUBLE) AS x, CAST(y.k AS DOUBLE) AS y FROM w JOIN deg x ON x.material = w.material AND x.node = w.a JOIN deg y ON y.material = w.material AND y.node = w.b),
    mixed AS (SELECT material, count(*) AS m, sum(x * y) AS xy, sum(x) AS sx, sum(x * x) AS xx FROM ends GROUP BY material),
    c AS (SELECT material, count(*) AS nodes FROM deg GROUP BY material), l AS (SELECT material, count(*) AS edges FROM e GROUP BY material)
    SELECT material, nodes, edges, round(2 * edges / CAST(nodes * (nodes - 1) AS DOUBLE), 6) AS density, components, edges - nodes + components AS betti1,
        CASE WHEN m * xx > sx * sx THEN round((m * xy - sx * sx) / (m * xx - sx * sx), 6) + 0.0 END AS assortativity
    FROM c JOIN l USING (material) JOIN parts USING (material) JOIN mixed USING (material)""")
def g13(spark, sf_dir):
    s = gr.graph_summary(edges(spark, sf_dir), K)
    return s.select("material", "nodes", "edges", r(F.col("density"), "density"), "components", "betti1", r(F.col("assortativity"), "assortativity"))


@query("g14_components", f"WITH RECURSIVE {E_SQL}, reach AS (SELECT material, a AS node, a AS seen FROM w UNION SELECT r.material, r.node, w.b FROM reach r JOIN w ON w.material = r.material AND w.a = r.seen) SELECT material, node, min(seen) AS component FROM reach GROUP BY material, node")
def g14(spark, sf_dir):
    from facetry.operators.components import components

    return components(edges(spark, sf_dir), K)


@query("g16_path_lengths", f"""WITH RECURSIVE {E_SQL}, far(material, source, node, hops) USING KEY (material, source, node) AS (SELECT DISTINCT material, a, a, 0 FROM w
        UNION SELECT DISTINCT f.material, f.source, w.b, f.hops + 1 FROM far f JOIN w ON w.material = f.material AND w.a = f.node
            WHERE NOT EXISTS (SELECT 1 FROM recurring.far s WHERE s.material = f.material AND s.source = f.source AND s.node = w.b))
    SELECT material, round(avg(hops), 6) AS mean_path, max(hops) AS diameter FROM far WHERE hops > 0 GROUP BY material""")
def g16(spark, sf_dir):
    return gr.path_lengths(edges(spark, sf_dir), K).select("material", r(F.col("mean_path"), "mean_path"), "diameter")


@query("g17_spectral_entropy")
def g17(spark, sf_dir):
    return gr.spectral_entropy(edges(spark, sf_dir), K).select("material", r(F.col("spectral_entropy"), "spectral_entropy"))


def _wl_round(i: int) -> str:
    return f"""h{i + 1} AS (SELECT x.material, x.node, md5(x.l || '|' || coalesce(near, '')) AS l FROM h{i} x LEFT JOIN (
        SELECT w.material, w.a AS node, string_agg(y.l, ',' ORDER BY y.l) AS near FROM w JOIN h{i} y ON y.material = w.material AND y.node = w.b GROUP BY w.material, w.a) z ON z.material = x.material AND z.node = x.node)"""


@query("g18_wl_hash", f"""WITH {E_SQL}, h0 AS (SELECT p_brand AS material, p_partkey AS node, md5(CAST(CAST(p_size AS DOUBLE) AS VARCHAR)) AS l FROM part), {_wl_round(0)}, {_wl_round(1)}, {_wl_round(2)},
    hist AS (SELECT material, l || ':' || count(*) AS c FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY material, l)
    SELECT material, md5(string_agg(c, ',' ORDER BY c)) AS wl_hash FROM hist GROUP BY material""")
def g18(spark, sf_dir):
    return gr.wl_hash(edges(spark, sf_dir), nodes(spark, sf_dir), K, "size")


@query("g19_inter_orbit_fraction", f"WITH {E_SQL}, {N_SQL} SELECT material, round(avg(CASE WHEN a.size % 5 <> b.size % 5 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v GROUP BY material")
def g19(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("orbit", F.col("size") % 5)
    both = edges(spark, sf_dir).join(n.select("material", F.col("node").alias("u"), F.col("orbit").alias("a")), ["material", "u"]).join(n.select("material", F.col("node").alias("v"), F.col("orbit").alias("b")), ["material", "v"])
    return both.groupBy("material").agg(r(F.avg((F.col("a") != F.col("b")).cast("double")), "fraction"))


@query("u2_u3_u4_clusters", f"WITH {E_SQL}, o AS (SELECT e.material, e.u, e.v, unnest([e.u, e.v]) AS a FROM e), m AS (SELECT o.material, o.u, o.v, w.b FROM o JOIN w ON w.material = o.material AND w.a = o.a UNION SELECT material, u, v, a FROM o) SELECT material, u, v, count(*) AS n, string_agg(b, ',' ORDER BY b) AS members FROM m GROUP BY material, u, v")
def u3(spark, sf_dir):
    return gr.cluster(edges(spark, sf_dir), K).select("material", "u", "v", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


@query("a14_solid_angles", f"""WITH {NB}, k AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY x, y, z) AS k FROM nb),
    t AS (SELECT a.center, abs(a.x * (b.y*c.z - b.z*c.y) + a.y * (b.z*c.x - b.x*c.z) + a.z * (b.x*c.y - b.y*c.x)) AS top,
        a.d*b.d*c.d + (a.x*b.x + a.y*b.y + a.z*b.z) * c.d + (a.x*c.x + a.y*c.y + a.z*c.z) * b.d + (b.x*c.x + b.y*c.y + b.z*c.z) * a.d AS below
        FROM k a JOIN k b ON b.center = a.center AND a.k < b.k JOIN k c ON c.center = a.center AND b.k < c.k)
    SELECT s.center, coalesce(round(sum(2 * atan2(top, below)), 4), 0.0) AS solid_angle FROM (SELECT DISTINCT center FROM nb) s LEFT JOIN t ON t.center = s.center AND below > 1e-12 GROUP BY s.center""")
def a14(spark, sf_dir):
    return tr.solid_angles(neighbours(spark, sf_dir), ["center"]).select("center", r(F.col("solid_angle"), "solid_angle", 4))


@query("t3_top_nodes", "SELECT p_brand AS material, p_partkey AS node FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, ceil(0.25 * count(*) OVER (PARTITION BY p_brand)) AS m FROM part) WHERE k <= m")
def t3(spark, sf_dir):
    return gr.top_nodes(nodes(spark, sf_dir), K, "price", 0.25).select("material", "node")


@query("t5_random_nodes", "SELECT p_brand AS material, p_partkey AS node FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('5|' || p_partkey), p_partkey) AS k, floor(0.3 * count(*) OVER (PARTITION BY p_brand)) AS m FROM part) WHERE k <= m")
def t5(spark, sf_dir):
    return gr.random_nodes(nodes(spark, sf_dir), K, 0.3, 5).select("material", "node")


@query("w5_node_offsets", "SELECT p_brand AS material, CAST(coalesce(sum(n) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def w5(spark, sf_dir):
    n = nodes(spark, sf_dir).groupBy("material").agg(F.count(F.lit(1)).alias("n"))
    return gr.node_offsets(n, "material", "n").select("material", "offset")
