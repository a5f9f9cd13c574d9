"""Fields on regular periodic grids: rows (keys, field, i, j, k, value) with n0, n1, n2 known by key.

For sampling, a grid is cut into bricks of up to 16 x 16 x 16 cells, each a row with its values as arrays and a halo of one
cell towards the upper sides. A point meets the one brick that holds its eight corners and is interpolated in the joined row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
EDGE = 16


def bricks(grid: DataFrame, sizes: tuple[int, int, int], keys: list[str], values: list[str], edge: int = EDGE) -> DataFrame:
    """keys, b0, b1, b2, places (null in a full brick, else the sorted places of the cells that are there), v0, v1, .. (arrays).

    A cell on the lower side of a brick is in the halo of the brick before it too. The places of a full brick are its
    cells in order, so its arrays are indexed without a search. Cells must be unique; null values stay null.
    """
    own = lambda a: F.struct(F.floor(F.col(a) / edge).cast("int").alias("b"), F.pmod(F.col(a), F.lit(edge)).cast("int").alias("l"))
    halo = lambda a: F.struct((F.floor(F.col(a) / edge) - 1).cast("int").alias("b"), F.lit(edge).alias("l"))
    cells = grid.select(*keys, *AXES, *[F.col(v).alias(f"v{n}") for n, v in enumerate(values)])
    for n, a in enumerate(AXES):
        cells = cells.withColumn(f"_{n}", F.explode(F.when((F.col(a) % edge == 0) & (F.col(a) > 0), F.array(own(a), halo(a))).otherwise(F.array(own(a)))))
    place = ((F.col("_0.l") * (edge + 1) + F.col("_1.l")) * (edge + 1) + F.col("_2.l")).alias("p")
    rows = cells.select(*keys, *[F.col(f"_{n}.b").alias(f"b{n}") for n in range(3)], F.struct(place, *[f"v{n}" for n in range(len(values))]).alias("c"))
    packed = rows.groupBy(*keys, "b0", "b1", "b2").agg(F.sort_array(F.collect_list("c")).alias("c"))
    full = F.size("c") == brick_size(sizes, edge, 0) * brick_size(sizes, edge, 1) * brick_size(sizes, edge, 2)
    return packed.select(*keys, "b0", "b1", "b2", F.when(~full, F.transform("c", lambda x: x["p"])).alias("places"), *[F.col(f"c.v{n}").alias(f"v{n}") for n in range(len(values))])


def brick_size(sizes: tuple[int, int, int], edge: int, axis: int) -> Column:
    """Cells of a brick along an axis, its halo included."""
    return F.least(F.lit(edge + 1), F.lit(sizes[axis]) - F.col(f"b{axis}") * edge)


def sampled_values(points: DataFrame, grid: DataFrame, values: list[str], sizes: tuple[int, int, int], keys: list[str], point: str, tol: float = 1e-10, clamp: bool = True, edge: int = EDGE) -> DataFrame:
    """keys, point, one column a value: trilinear samples at fractional x, y, z; NULL where a corner is missing.

    Coordinates are wrapped to [0, 1) and clipped to the last grid point less ``tol``, as the last cell
    is not periodic; with ``clamp`` off, points outside are NULL.
    """
    cells = points
    for n, (c, size) in enumerate(zip("xyz", sizes)):
        top = (size - 1) / size - tol
        x = F.least(F.col(c) - F.floor(c), F.lit(top)) if clamp else F.when(F.col(c).between(0, top + tol), F.least(F.col(c), F.lit(top)))
        cells = cells.withColumn(f"_{c}", x * size).withColumn(f"_b{c}", F.floor(f"_{c}").cast("int")).withColumn(f"_w{c}", F.col(f"_{c}") - F.col(f"_b{c}"))
        cells = cells.withColumn(f"b{n}", F.floor(F.col(f"_b{c}") / edge).cast("int")).withColumn(f"_l{n}", F.pmod(F.col(f"_b{c}"), F.lit(edge)))
    cells = cells.select(*keys, point, *[f"_w{c}" for c in "xyz"], *[x for n in range(3) for x in (f"b{n}", f"_l{n}")])
    met = cells.join(bricks(grid, sizes, keys, values, edge), [*keys, "b0", "b1", "b2"], "left")
    dense = lambda a, b, c: ((F.col("_l0") + a) * brick_size(sizes, edge, 1) + F.col("_l1") + b) * brick_size(sizes, edge, 2) + F.col("_l2") + c
    sparse = lambda a, b, c: F.array_position("places", ((F.col("_l0") + a) * (edge + 1) + F.col("_l1") + b) * (edge + 1) + F.col("_l2") + c).cast("int") - 1
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    for a, b, c in corners:
        met = met.withColumn(f"_i{a}{b}{c}", F.when(F.col("places").isNull(), dense(a, b, c)).otherwise(F.nullif(sparse(a, b, c), F.lit(-1))))
    weight = lambda c, up: F.col(f"_w{c}") if up else 1 - F.col(f"_w{c}")
    at = lambda n: sum(weight("x", a) * weight("y", b) * weight("z", c) * F.get(f"v{n}", F.col(f"_i{a}{b}{c}")) for a, b, c in corners)
    return met.select(*keys, point, *[at(n).alias(v) for n, v in enumerate(values)])


def sampled(points: DataFrame, grid: DataFrame, sizes: tuple[int, int, int], keys: list[str], point: str, tol: float = 1e-10, clamp: bool = True, edge: int = EDGE) -> DataFrame:
    """keys, point, value, as :func:`sampled_values`."""
    return sampled_values(points, grid, ["value"], sizes, keys, point, tol, clamp, edge)


def sampled_vector(points: DataFrame, grid: DataFrame, components: list[str], sizes, keys: list[str], point: str, edge: int = EDGE) -> DataFrame:
    """keys, point, one column a component, and norm; all components from one join."""
    out = sampled_values(points, grid, components, sizes, keys, point, edge=edge)
    return out.withColumn("norm", F.sqrt(sum(F.col(c) ** 2 for c in components)))


def _line(keys: list[str], axis: str):
    return W.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis)


def differences(grid: DataFrame, keys: list[str]) -> DataFrame:
    """grid with d_i, d_j, d_k: central differences, one-sided at the ends (0 for a single point)."""
    out = grid
    for a in AXES:
        w = _line(keys, a)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        out = out.withColumn(f"d_{a}", F.coalesce((after - before) / 2, after - F.col("value"), F.col("value") - before, F.lit(0.0)))
    return out


def gradient(grid: DataFrame, sizes: tuple[int, int, int], keys: list[str], inverse_cell: list[float] | None = None, scale: bool = True, transpose: bool = True) -> DataFrame:
    """grid with gx, gy, gz: differences per index (``scale`` off) or per fractional coordinate, mapped by the
    inverse cell's transpose (the chain rule for row-vector cells), by the inverse itself, or not at all."""
    d = [F.col(f"d_{a}") * (n if scale else 1) for a, n in zip(AXES, sizes)]
    if inverse_cell is None:
        g = d
    else:
        m = [[inverse_cell[3 * r + c] for c in range(3)] for r in range(3)]
        g = [sum(d[c] * (m[r][c] if transpose else m[c][r]) for c in range(3)) for r in range(3)]
    out = differences(grid, keys)
    return out.select(*grid.columns, *[x.alias(n) for x, n in zip(g, ("gx", "gy", "gz"))])


def laplacian(grid: DataFrame, keys: list[str]) -> DataFrame:
    """grid with laplacian: sum of second differences, edge values repeated at the ends."""
    out = grid.withColumn("laplacian", F.lit(0.0))
    for a in AXES:
        w = _line(keys, a)
        out = out.withColumn("laplacian", F.col("laplacian") + F.coalesce(F.lag("value").over(w), "value") + F.coalesce(F.lead("value").over(w), "value") - 2 * F.col("value"))
    return out


def coupling(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m00..m22, trace, determinant of the mean outer product of -gradient(first) and gradient(second)."""
    a = first.select(*keys, *AXES, *[(-F.col(f"g{c}")).alias(f"a{n}") for n, c in enumerate("xyz")])
    b = second.select(*keys, *AXES, *[F.col(f"g{c}").alias(f"b{n}") for n, c in enumerate("xyz")])
    m = a.join(b, [*keys, *AXES]).groupBy(*keys).agg(*[F.avg(F.col(f"a{r}") * F.col(f"b{c}")).alias(f"m{r}{c}") for r in range(3) for c in range(3)])
    det = sum(s * F.col(f"m0{x}") * F.col(f"m1{y}") * F.col(f"m2{z}") for s, x, y, z in ((1, 0, 1, 2), (1, 1, 2, 0), (1, 2, 0, 1), (-1, 2, 1, 0), (-1, 1, 0, 2), (-1, 0, 2, 1)))
    return m.withColumn("trace", F.col("m00") + F.col("m11") + F.col("m22")).withColumn("determinant", det)


def moments(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.groupBy(*keys).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def mean_square_gradient(with_gradient: DataFrame, keys: list[str]) -> DataFrame:
    return with_gradient.groupBy(*keys).agg(F.avg(sum(F.col(f"g{c}") ** 2 for c in "xyz")).alias("mean_square"))


def missing_filled(sample: Column, vertices: list[Column]) -> tuple[Column, Column]:
    """(value, uncertainty): the sample, else the mean of the known vertex values with their population std."""
    known = F.filter(F.array(*vertices), lambda x: x.isNotNull())
    n = F.size(known)
    mean = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n))
    spread = F.when(n > 0, F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.when(n > 0, n)))
    return F.coalesce(sample, mean), F.when(sample.isNotNull(), 0.0).otherwise(spread)
