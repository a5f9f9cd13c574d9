"""Triangle (2-simplex) operators: vertices i < j < k, edges by sorted pair.

Triples and their sides are dealt to tasks by their number wherever they meet, so a task's memory is that of some hundred
thousand rows at any size of the input. Triples are counted first; ``graphs.wedges`` gives written ones, whose count is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.session import tasks

SIDES = ("ij", "jk", "ik")


def vertex_statistics(triples: DataFrame, nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """avg_, var_ (population), max_ of node columns over the three vertices; NULL vertices are skipped."""
    n = tasks(3 * triples.count())
    v = triples.select(*keys, "i", "j", "k", F.explode(F.array("i", "j", "k")).alias("node")).repartition(n, *keys, "node")
    known = v.join(nodes.select(*keys, "node", *columns).repartition(n, *keys, "node"), [*keys, "node"], "left")
    return known.repartition(n, *keys, "i", "j", "k").groupBy(*keys, "i", "j", "k").agg(*[x for c in columns for x in (F.avg(c).alias(f"avg_{c}"), F.var_pop(c).alias(f"var_{c}"), F.max(c).alias(f"max_{c}"), F.count(c).alias(f"n_{c}"))])


def energy_variance(statistics: DataFrame, column: str) -> DataFrame:
    """vfe_variance and its Laplacian form (9 times it); NULL unless all three vertices are known."""
    v = F.when(F.col(f"n_{column}") == 3, F.col(f"var_{column}"))
    return statistics.withColumn("vfe_variance", v).withColumn("vfe_laplacian_variance", 9 * v)


def at_vertices(triples: DataFrame, nodes: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Triples with columns of their vertices' nodes (``names``: column, its prefix before i, j, k); triples of unknown nodes are absent."""
    n = tasks(triples.count())
    for c in "ijk":
        side = nodes.select(*keys, F.col("node").alias(c), *[F.col(x).alias(f"{prefix}{c}") for x, prefix in names.items()])
        triples = triples.repartition(n, *keys, c).join(side.repartition(n, *keys, c), [*keys, c])
    return triples


def stress_flows(triples: DataFrame, weights: dict[str, tuple[float, float, float] | None], at: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Triples with ``area`` and, for each name in ``weights``, the norm of the sum of the sides' outward in-plane unit
    normals with those weights for the sides ij, jk, ki (None: their lengths); 0 for a flat triangle.

    ``at``: prefixes of the vertices' coordinates, followed by i, j, k. A side's normal is its direction turned by a right
    angle in the plane, so the sum of normals is as long as the sum of directions. Steps are columns of their own: each is
    computed once and compiled, where bound variables (``functions.descriptors.stress_flow``) are interpreted.
    """
    root = lambda *xs: F.sqrt(xs[0] * xs[0] + xs[1] * xs[1] + xs[2] * xs[2])
    side = lambda s: [F.col(f"_{s}{n}") for n in range(3)]
    ends = ("ij", "jk", "ki")
    out = triples.withColumns({f"_{a}{b}{n}": F.col(f"{c}{b}") - F.col(f"{c}{a}") for a, b in ends for n, c in enumerate(at)})
    u, v = side("ij"), side("jk")
    out = out.withColumns({f"_l{s}": root(*side(s)) for s in ends} | {f"_n{n}": u[i] * v[j] - u[j] * v[i] for n, (i, j) in enumerate(((1, 2), (2, 0), (0, 1)))})
    out = out.withColumns({"area": root(*side("n")) / 2} | {f"_w{s}": g.safe_div(F.lit(1.0), F.col(f"_l{s}"), 0.0) for s in ends})
    part = lambda w, m, n: F.col(f"_{ends[m]}{n}") * F.col(f"_w{ends[m]}") * (F.lit(float(w[m])) if w else F.col(f"_l{ends[m]}"))
    out = out.withColumns({f"_{name}{n}": part(w, 0, n) + part(w, 1, n) + part(w, 2, n) for name, w in weights.items() for n in range(3)})
    flows = {name: F.when(2 * F.col("area") > g.TOLERANCE, root(*side(name))).otherwise(F.when(F.col("area").isNotNull(), 0.0)) for name in weights}
    return out.select(*triples.columns, "area", *[c.alias(name) for name, c in flows.items()])


def sides(triples: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """One row a side: keys, i, j, k, side (0..2), u, v sorted, and further columns."""
    pair = lambda n, a, b: F.struct(F.lit(n).alias("side"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    return triples.select(*keys, "i", "j", "k", *more, F.explode(F.array(*[pair(n, *s) for n, s in enumerate(SIDES)])).alias("s")).select(*keys, "i", "j", "k", "s.side", "s.u", "s.v", *more)


def _with_edges(triples: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Sides with the other columns of their edge, NULL where a side is no edge; the rows of a triple are in one task."""
    n = tasks(3 * triples.count())
    met = sides(triples, keys).repartition(n, *keys, "u", "v").join(edges.repartition(n, *keys, "u", "v"), [*keys, "u", "v"], "left")
    return met.repartition(n, *keys, "i", "j", "k")


def edge_statistics(triples: DataFrame, edges: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """avg_, var_, max_, sum_ of edge columns over existing sides (sum: NULL if none), and the number of sides."""
    known = _with_edges(triples, edges.select(*keys, "u", "v", F.lit(1).alias("_e"), *columns), keys)
    return known.groupBy(*keys, "i", "j", "k").agg(F.count("_e").alias("n_sides"), *[x for c in columns for x in (F.avg(c).alias(f"avg_{c}"), F.var_pop(c).alias(f"var_{c}"), F.max(c).alias(f"max_{c}"), F.sum(c).alias(f"sum_{c}"))])


def side_vectors(triples: DataFrame, edges: DataFrame, keys: list[str], feature: str, n: int) -> DataFrame:
    """keys, i, j, k, sides: the three sides' vectors in order, zeros where a side is no edge, concatenated."""
    zero = F.array(*[F.lit(0.0)] * n)
    known = _with_edges(triples, edges.select(*keys, "u", "v", feature), keys)
    rows = known.groupBy(*keys, "i", "j", "k").agg(F.array_sort(F.collect_list(F.struct("side", F.coalesce(feature, zero).alias("f")))).alias("s"))
    return rows.select(*keys, "i", "j", "k", F.flatten(F.transform("s", lambda x: x["f"])).alias("sides"))


def mean_onto_edges(triples: DataFrame, edges: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Edges with the mean of triangle columns over the triangles that hold them, 0 where none does, and their number."""
    n = tasks(3 * triples.count())
    mean = sides(triples, keys, *columns).repartition(n, *keys, "u", "v").groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("n_triangles"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    return edges.select(*keys, "u", "v").repartition(n, *keys, "u", "v").join(mean, [*keys, "u", "v"], "left").fillna(0, ["n_triangles", *[f"mean_{c}" for c in columns]])


def solid_angles(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, solid_angle: sum over all triples of a centre's neighbour vectors (0 under three).

    A row holds a neighbour and the vectors after it, and sums over their pairs inside itself; the rows of a
    centre spread over tasks, then their sums meet.
    """
    numbered = neighbours.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("v"))
    one = numbered.where("size(v) > 2").select(*keys, "v", F.posexplode("v").alias("a", "va")).where("a < size(v) - 2")
    one = one.select(*keys, "va", F.slice("v", F.col("a") + 2, F.size("v")).alias("v")).repartition(*keys, F.xxhash64("va"))
    inner = lambda b: F.aggregate(F.slice("v", b + 2, F.size("v")), F.lit(0.0), lambda s, w: s + g.solid_angle(_vec(F.col("va")), _vec(F.get("v", b)), _vec(w)))
    total = F.aggregate(F.sequence(F.lit(0), F.size("v") - 2), F.lit(0.0), lambda s, b: s + inner(b))
    sums = one.withColumn("s", total).groupBy(*keys).agg(F.sum("s").alias("solid_angle"))
    return numbered.select(*keys).join(sums, keys, "left").fillna(0.0, ["solid_angle"])


def _vec(s: Column) -> Column:
    return F.array(s["x"], s["y"], s["z"])
