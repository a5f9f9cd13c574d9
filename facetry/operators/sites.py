"""Per-site (0-simplex) operators over a bag of neighbours.

``neighbours`` has the key columns, and element, x, y, z, d of each neighbour (d: distance). One
grouped aggregation gives every sum; Spark combines it map-side, so a site with many neighbours costs
one row a task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.functions import tensor as t
from facetry.session import small, spread, tasks, written

TINY = 1e-12


def _sums(weight: Column | float = 1.0) -> list[Column]:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return [F.sum(w * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]


def structure_tensors(neighbours: DataFrame, keys: list[str], weight: Column | float = 1.0) -> DataFrame:
    """keys, tensor: the sum of v v^T (weighted)."""
    sums = neighbours.groupBy(*keys).agg(*_sums(weight))
    return sums.select(*keys, t.symmetric(*[F.col(f"s{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz")]).alias("tensor"))


def with_external(sites: DataFrame, external: DataFrame, keys: list[str], tensor: str = "tensor", given: str = "external") -> DataFrame:
    """``sites`` with ``algebra`` array<double>[9]: the external tensor of the site, else the generator of its structure
    tensor's principal direction, and ``from_external``. external: keys (unique) and ``given``; a null one counts as absent."""
    met = sites.join(external.select(*keys, F.col(given).alias("_given")), keys, "left")
    return met.select(*sites.columns, F.coalesce("_given", t.lie_generator(t.principal_direction(F.col(tensor)))).alias("algebra"), F.col("_given").isNotNull().alias("from_external"))


def ends_with_external(rows: DataFrame, external: DataFrame, keys: list[str], ends: list[str], site: str, given: str = "external") -> DataFrame:
    """Bonds or triangles with ``external_{end}`` of each end's site: NULL where a site has none, as nothing stands in for it here."""
    out = rows
    for end in ends:
        out = out.join(external.select(*keys, F.col(site).alias(end), F.col(given).alias(f"external_{end}")), [*keys, end], "left")
    return out.select(*rows.columns, *[f"external_{end}" for end in ends])


def with_lonely(features: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Sites without neighbours: a tensor of 1e-12 on the diagonal, as the empty sum is regularised."""
    lone = F.array(*[F.lit(TINY if i in (0, 4, 8) else 0.0) for i in range(9)])
    return sites.select(*keys).join(features, keys, "left").withColumn("tensor", F.coalesce("tensor", lone))


def site_geometry(neighbours: DataFrame, keys: list[str], charge: Column | None = None) -> DataFrame:
    """All neighbour sums of a site in one aggregation: tensor, asymmetry, coordination, mean squared
    distance, distortion (population CV, 0 under two neighbours), charge-weighted size, and the fallback
    symmetry measure 1 + CV + kinds / n."""
    w = F.coalesce(F.abs(charge), F.lit(1.0)) if charge is not None else F.lit(1.0)
    got = neighbours.groupBy(*keys).agg(
        *_sums(), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz"), F.count(F.lit(1)).alias("coordination"),
        F.sum(F.col("d") * F.col("d")).alias("dd"), F.avg("d").alias("md"), F.stddev_pop("d").alias("sd"), F.countDistinct("element").alias("kinds"),
        F.sum(w * F.col("d") * F.col("d")).alias("charge_weighted_size"))
    cv = F.when(F.col("coordination") < 2, F.lit(0.0)).otherwise(g.safe_div(F.col("sd"), F.col("md"), 0.0))
    out = got.select(
        *keys, t.symmetric(*[F.col(f"s{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz")]).alias("tensor"), g.vec("sx", "sy", "sz").alias("asymmetry"),
        "coordination", (F.col("dd") / F.col("coordination")).alias("mean_squared_distance"), cv.alias("distortion"), "charge_weighted_size",
        (1 + cv + F.col("kinds") / F.col("coordination")).alias("symmetry_fallback"))
    return out.withColumn("asymmetry_norm_sq", g.dot(F.col("asymmetry"), F.col("asymmetry")))


def bag_entropy(rows: DataFrame, keys: list[str], *descriptor: Column, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of the bag of descriptors of each key, by two grouped counts."""
    n = rows.groupBy(*keys, *[c.alias(f"_d{i}") for i, c in enumerate(descriptor)]).agg(F.count(F.lit(1)).alias("_c"))
    # H = log2 N - sum(c log2 c) / N needs no join with the totals.
    return n.groupBy(*keys).agg((F.log2(F.sum("_c").cast("double")) - F.sum(F.col("_c") * F.log2(F.col("_c").cast("double"))) / F.sum("_c") + 0.0).alias(name))


def bond_valence(neighbours: DataFrame, parameters: DataFrame, keys: list[str], pair: list[str]) -> DataFrame:
    """Sum of exp((R0 - d) / B) with R0, B by ``pair`` of kinds; neighbours without parameters add nothing."""
    known = neighbours.join(parameters, pair, "left")
    return known.groupBy(*keys).agg(F.coalesce(F.sum(F.exp((F.col("r0") - F.col("d")) / F.col("b"))), F.lit(0.0)).alias("bond_valence_sum"))


def first_coordination(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """Coordination from the first of several neighbour tables (of growing tolerance) that has the site."""
    out = None
    for i, n in enumerate(tables):
        c = n.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_c{i}"))
        out = c if out is None else out.join(c, keys, "full_outer")
    return out.select(*keys, F.coalesce(*[F.col(f"_c{i}") for i in range(len(tables))]).alias("coordination"))


def nearest_match(left: DataFrame, right: DataFrame, on: list[str], key: list[str], gap: Column, ties: list[Column]) -> DataFrame:
    """Each left row (unique by ``key``) with the right row of equal ``on`` and the smallest gap, by ``min_by``
    in an aggregation: no window sorts all candidates of a hot key. Left rows are spread by their key, so a task meets
    the candidates of a bounded number of them."""
    both = spread(left, 2_000, *key).join(small(right, right.count()), on)
    taken = [c for c in right.columns if c not in on]
    return both.groupBy(*on, *key).agg(F.min(F.struct(gap.alias("gap"), *[c.alias(f"t{i}") for i, c in enumerate(ties)], F.struct(*taken).alias("r"))).alias("best")).select(*on, *key, "best.gap", "best.r.*")


PAIRS, BLOCK, LIST = 1 << 25, 8_192, 1_024


def _alike(rows: DataFrame, by: list[str], site: str) -> DataFrame:
    """by, _sites: sites that are alike in ``by`` as arrays of at most ``LIST``, so that they are compared together."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(site))
    return rows.select(*by, site, F.floor((n - 1) / LIST).alias("_list")).groupBy(*by, "_list").agg(F.collect_list(site).alias("_sites")).drop("_list")


def _met(here: DataFrame, there: DataFrame, on: list[str], grid: list[str], rows: int, per: int) -> DataFrame:
    """Rows of ``here`` (its _sites one a row, as ``center``) with the rows of ``there`` (its _sites whole, as ``_nbrs``) in
    the same or a neighbouring cell of ``grid``.

    ``here`` visits the cells around its own. What meets in one is dealt to tiles of about ``BLOCK`` sites a side, and tiles
    to as many tasks as there are ``PAIRS``. Both sides are shuffled, never broadcast: Spark estimates them from the files,
    however many rows are made of each.
    """
    own = there.groupBy(*on, *grid).agg(F.sum(F.size("_sites")).alias("_own"))
    visits = here.groupBy(*on, *grid).agg(F.sum(F.size("_sites")).alias("_visits"))
    for g_ in grid:
        here, visits = (x.withColumn(g_, F.explode(F.array(*[F.col(g_) + s for s in (-1, 0, 1)]))) for x in (here, visits))
    cells = written(visits.groupBy(*on, *grid).agg(F.sum("_visits").alias("_visits")).join(own.hint("merge"), [*on, *grid]), "cells")
    pairs = cells.agg(F.sum(F.col("_own").cast("double") * F.col("_visits"))).first()[0] or 0
    n, by = max(tasks(rows, per), int(-(-pairs // PAIRS))), [*on, *grid]
    there = there.withColumnRenamed("_sites", "_nbrs")
    heavy = cells.where((F.col("_own") > BLOCK) | (F.col("_visits") > BLOCK))
    many = heavy.count()
    if many:
        dealt = heavy.select(*by, F.ceil(F.col("_own") / BLOCK).alias("_bo"), F.ceil(F.col("_visits") / BLOCK).alias("_bv"))
        one, by = F.lit(1).cast("long"), [*by, "_v", "_o"]

        def tiled(side: DataFrame, mine: str, at: str, theirs: str, to: str, sites: str) -> DataFrame:
            known = side.join(small(dealt, many), [*on, *grid], "left").withColumn(at, F.pmod(F.xxhash64(*side.columns), F.coalesce(mine, one)))
            return known.withColumn(to, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(theirs, one) - 1))).drop("_bo", "_bv")

        here, there = tiled(here, "_bv", "_v", "_bo", "_o", "_sites"), tiled(there, "_bo", "_o", "_bv", "_v", "_nbrs")
    here = here.repartition(n, *by).withColumn("center", F.explode("_sites")).drop("_sites")
    return here.join(there.repartition(n, *by).hint("merge"), by)


def range_join(points: DataFrame, radius: float, keys: list[str], site: str, coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """keys, center, nbr, distance: all ordered pairs within ``radius``.

    Points are put into cells of the radius; one side visits the neighbouring cells, so the join is an
    equality of cells with a residual filter, never a nested loop. Sites at one place share their distances.
    """
    a, b = [f"_a{i}" for i in range(len(coords))], [f"_b{i}" for i in range(len(coords))]
    own = [F.floor(F.col(c) / radius).alias(f"_g{i}") for i, c in enumerate(coords)]
    alike = written(_alike(points.select(*keys, F.col(site).alias("_site"), *coords).where(" and ".join(f"`{c}` is not null" for c in coords)), [*keys, *coords], "_site"), "places")
    here = alike.select(*keys, "_sites", *[F.col(c).alias(x) for c, x in zip(coords, a)], *own)
    there = alike.select(*keys, "_sites", *[F.col(c).alias(x) for c, x in zip(coords, b)], *own)
    met = _met(here, there, keys, [f"_g{i}" for i in range(len(coords))], alike.agg(F.sum(F.size("_sites"))).first()[0] or 0, 2_000)
    square = sum((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b))
    near = met.where(square <= radius * radius).select(*keys, "center", "_nbrs", F.sqrt(square).alias("distance"))
    return near.select(*keys, "center", F.explode("_nbrs").alias("nbr"), "distance").where("center <> nbr")


def periodic_range_join(sites: DataFrame, cells: DataFrame, radius: float, keys: tuple[str, ...] = ("material",)) -> DataFrame:
    """keys, center, nbr, image, vec, distance of all periodic neighbours within ``radius``.

    sites: keys, site, frac array<double>; cells: keys, cell array<double>[9]. Along each axis the images -m..m
    of the one side are laid out, m being the radius over the cell's height (the distance of the faces) rounded
    up, so no image is missed; then both sides meet by cubes of the radius. Candidates are compared by plain numbers;
    arrays are made of the pairs that stay. Sites at one place of the cell share images and distances.
    """
    keys, axes = list(keys), range(3)
    wrapped = sites.select(*keys, F.col("site").alias("_site"), *[g.wrap01(F.col("frac")[i]).alias(f"_f{i}") for i in axes]).where("_f0 is not null and _f1 is not null and _f2 is not null")
    alike = written(_alike(wrapped, [*keys, "_f0", "_f1", "_f2"], "_site"), "places")
    placed = alike.select(*keys, "_sites", F.array("_f0", "_f1", "_f2").alias("frac")).join(cells, keys)
    edge = [g.vec(*[F.col("cell")[3 * i + j] for j in axes]) for i in axes]
    faces = [g.norm(g.cross(edge[(i + 1) % 3], edge[(i + 2) % 3])) for i in axes]
    there = placed.withColumns({f"_r{i}": radius * faces[i] / F.abs(g.determinant(F.col("cell"))) for i in axes})
    for i in axes:
        most = F.ceil(f"_r{i}").cast("int")
        # An image farther than the radius from the cell's faces meets no site of the cell.
        off = F.col("frac")[i] + F.col(f"_m{i}")
        there = there.withColumn(f"_m{i}", F.explode(F.sequence(-most, most))).where((off >= -F.col(f"_r{i}") - 1e-6) & (off <= 1 + F.col(f"_r{i}") + 1e-6))
    grid = lambda p: [F.floor(F.col(p)[i] / radius).alias(f"_g{i}") for i in axes]
    there = there.select(*keys, "_sites", F.array("_m0", "_m1", "_m2").alias("image"), "frac", "cell").withColumn("q", g.frac_to_cart(F.col("cell"), g.add(F.col("frac"), F.col("image")))).drop("frac", "cell")
    there = there.select(*keys, "_sites", "image", *[F.col("q")[i].alias(f"_q{i}") for i in axes], *grid("q"))
    here = placed.select(*keys, "_sites", g.frac_to_cart(F.col("cell"), F.col("frac")).alias("p")).select(*keys, "_sites", *[F.col("p")[i].alias(f"_p{i}") for i in axes], *grid("p"))
    met = _met(here, there, keys, ["_g0", "_g1", "_g2"], alike.agg(F.sum(F.size("_sites"))).first()[0] or 0, 500)
    step = [F.col(f"_q{i}") - F.col(f"_p{i}") for i in axes]
    distance = F.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2])
    near = met.where(distance <= radius).select(*keys, "center", "_nbrs", "image", F.array(*step).alias("vec"), distance.alias("distance"))
    self_image = (F.col("center") == F.col("nbr")) & (F.col("distance") < 1e-8)
    return near.select(*keys, "center", F.explode("_nbrs").alias("nbr"), "image", "vec", "distance").where(~self_image)


def minimum_image(pairs: DataFrame, skewed: bool = False) -> DataFrame:
    """pairs (frac_u, frac_v, cell, ...) with image, vec, distance of the nearest image: by rounding for
    orthogonal cells, from 27 images for skewed ones."""
    delta = g.sub(F.col("frac_v"), F.col("frac_u"))
    if not skewed:
        image = F.array(*[(-F.bround(delta[i])).cast("int") for i in range(3)])
        out = pairs.withColumn("image", image).withColumn("vec", g.frac_to_cart(F.col("cell"), g.nearest_image(delta)))
        return out.withColumn("distance", g.norm(F.col("vec")))
    base = F.array(*[-F.bround(delta[i]) for i in range(3)])
    shifts = F.array(*[F.array(*[F.lit(float(x)) for x in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])

    def candidate(s: Column) -> Column:
        of = lambda image: g.let(g.frac_to_cart(F.col("cell"), g.add(delta, image)), lambda v: F.struct(F.round(g.norm(v), 9).alias("r"), F.transform(image, lambda x: x.cast("int")).alias("image"), v.alias("vec")))
        return g.let(g.add(base, s), of)

    best = F.array_min(F.transform(shifts, candidate))
    return pairs.withColumn("_b", best).withColumn("image", F.col("_b.image")).withColumn("vec", F.col("_b.vec")).withColumn("distance", g.norm(F.col("vec"))).drop("_b")


def fingerprints(neighbours: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """keys, fingerprint (SHA-256 hex of the sorted (element, rounded distance) bag)."""
    bag = F.array_sort(F.collect_list(F.struct("element", F.bround("d", digits).alias("d"))))
    return neighbours.groupBy(*keys).agg(bag.alias("bag")).select(*keys, F.sha2(F.to_json(F.struct("bag")), 256).alias("fingerprint"))


def remapped(values: DataFrame, mapping: DataFrame, keys: list[str], default: Column | None = None) -> DataFrame:
    """Values (keys, site, ...) carried to the other ordering (keys, left_site, right_site); sites without a
    counterpart keep their own index, missing values take ``default``."""
    back = mapping.where("status = 'matched'").select(*keys, F.col("right_site").alias("site"), F.col("left_site").alias("_to"))
    out = values.join(back, [*keys, "site"], "left").withColumn("site", F.coalesce("_to", "site")).drop("_to")
    return out if default is None else out.withColumn("value", F.coalesce("value", default))


def rounded_lookup(points: DataFrame, known: DataFrame, coords: list[str], digits: int, value: str, missing: float) -> DataFrame:
    """``value`` of the known point at the same rounded coordinates, ``missing`` where none is."""
    key = [F.round(F.col(c), digits).alias(f"_r{i}") for i, c in enumerate(coords)]
    right = known.select(*key, F.col(value).alias("_v")).dropDuplicates([f"_r{i}" for i in range(len(coords))])
    names = [f"_r{i}" for i in range(len(coords))]
    return points.select("*", *key).join(right, names, "left").withColumn(value, F.coalesce("_v", F.lit(missing))).drop("_v", *names)


def fixed_by(sites: DataFrame, operations: DataFrame, tol: float = 1e-5) -> DataFrame:
    """site x, y, z and the operations (r00..r22, t0..t2) of its group that map it to itself up to whole cells.

    Sites and operations meet by their group column ``material``.
    """
    both = spread(sites, 20_000, "material", "site").join(small(operations, operations.count()), "material")
    moved = [F.col(f"r{i}0") * F.col("x") + F.col(f"r{i}1") * F.col("y") + F.col(f"r{i}2") * F.col("z") + F.col(f"t{i}") - F.col(c) for i, c in enumerate("xyz")]
    whole = F.lit(True)
    for m in moved:
        whole = whole & (F.abs(m - F.bround(m)) < tol)
    return both.where(whole).groupBy("material", "site").agg(F.count(F.lit(1)).alias("order"))


def orbit(vectors: DataFrame, operations: DataFrame, keys: list[str], digits: int = 5) -> DataFrame:
    """keys, orbit_size, stabilizer_size of vectors x, y, z under the group's rotations. Vectors are spread by their keys,
    so a task meets the images of a bounded number of them."""
    both = spread(vectors, 20_000, *keys).join(small(operations, operations.count()), "material")
    image = F.struct(*[(F.bround(F.col(f"r{i}0") * F.col("x") + F.col(f"r{i}1") * F.col("y") + F.col(f"r{i}2") * F.col("z"), digits) + 0.0).alias(f"i{i}") for i in range(3)])
    return both.groupBy(*keys).agg(F.countDistinct(image).alias("orbit_size"), F.count(F.lit(1)).alias("_n")).select(*keys, "orbit_size", F.bround(F.col("_n") / F.col("orbit_size")).cast("long").alias("stabilizer_size"))


def rank_of(vectors: DataFrame, keys: list[str], tol: float = 1e-10) -> DataFrame:
    """Rank of each key's set of 3-vectors x, y, z: eigenvalues of the Gram matrix above tol^2."""
    return structure_tensors(vectors, keys).select(*keys, F.size(F.filter(t.eigenvalues(F.col("tensor")), lambda e: e > F.greatest(F.lit(tol * tol), F.lit(1e-10) * t.trace(F.col("tensor"))))).cast("long").alias("rank"))


def tensor_validation(tensors: DataFrame, keys: list[str], tensor: str = "tensor") -> DataFrame:
    """total, passed, failed (antisymmetric within 1e-10), zero, nonzero (1e-15), pass_rate, rank of each key."""
    m = F.col(tensor)
    ok, zero = t.is_skew(m), t.frobenius(m) < 1e-15
    axis = tensors.select(*keys, m[7].alias("x"), m[2].alias("y"), m[3].alias("z"))
    summary = tensors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok.cast("int")).alias("passed"), F.sum((~ok).cast("int")).alias("failed"), F.sum(zero.cast("int")).alias("zero"),
        F.sum((~zero).cast("int")).alias("nonzero"), F.avg(ok.cast("double")).alias("pass_rate"))
    return summary.join(rank_of(axis, keys), keys) if keys else summary.crossJoin(rank_of(axis, keys))
