"""Column scaling: statistics of a training relation joined to the relation to be scaled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.geometry import cross, let, norm, sub
from facetry.session import tasks
from facetry.operators.quantiles import quantiles

METHODS = ("standard", "minmax", "robust", "zscore", "none")


def fit(train: DataFrame, columns: list[str], methods: dict[str, str] | str = "standard", keys: list[str] | None = None) -> DataFrame:
    """keys, {column}_shift and {column}_scale of each column; a zero spread scales by 1.

    standard: mean, population std; zscore: mean, sample std; minmax: minimum, range; robust: median,
    interquartile range by exact linear interpolation (:func:`quantiles`, so hot keys are no buffer).
    """
    each = {c: methods if isinstance(methods, str) else methods[c] for c in columns}
    if bad := set(each.values()) - set(METHODS):
        raise ValueError(f"unknown scaling method: {', '.join(sorted(bad))}")
    one = lambda spread: F.when(F.coalesce(spread, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(spread)
    made = []
    for c, method in each.items():
        x = F.col(c)
        shift, scale = {
            "standard": lambda: (F.avg(x), one(F.stddev_pop(x))), "zscore": lambda: (F.avg(x), one(F.stddev_samp(x))), "minmax": lambda: (F.min(x), one(F.max(x) - F.min(x))),
            "robust": lambda: (F.lit(0.0), F.lit(1.0)), "none": lambda: (F.lit(0.0), F.lit(1.0)),
        }[method]()
        made += [shift.alias(f"{c}_shift"), scale.alias(f"{c}_scale")]
    fitted = train.groupBy(*(keys or [])).agg(*made)
    for c in [c for c, method in each.items() if method == "robust"]:
        q = quantiles(train, keys or [], c, [0.25, 0.5, 0.75])
        own = q.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys or [])], F.col("q")[1].alias("_shift"), one(F.col("q")[2] - F.col("q")[0]).alias("_scale"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys or [])] or [F.lit(True)]
        met = fitted.join(own if keys else F.broadcast(own), same, "left")
        fitted = met.select(*[F.col("_shift").alias(x) if x == f"{c}_shift" else F.coalesce("_scale", F.lit(1.0)).alias(x) if x == f"{c}_scale" else F.col(x) for x in fitted.columns])
    return fitted


def _joined(df: DataFrame, fitted: DataFrame, keys: list[str] | None) -> DataFrame:
    return df.join(fitted, keys, "left") if keys else df.join(F.broadcast(fitted.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")


def transform(df: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with columns scaled. Without keys the fitted relation is a single row."""
    return _joined(df, fitted, keys).select(*[((F.col(c) - F.col(f"{c}_shift")) / F.col(f"{c}_scale")).alias(c) if c in columns else F.col(c) for c in df.columns])


def inverse(df: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    return _joined(df, fitted, keys).select(*[(F.col(c) * F.col(f"{c}_scale") + F.col(f"{c}_shift")).alias(c) if c in columns else F.col(c) for c in df.columns])


def normalized(df: DataFrame, columns: list[str], keys: list[str], compat: bool = False) -> DataFrame:
    """Z-scores by sample std in each group, missing values 0; with ``compat`` one missing value zeroes its
    group's whole column, as a mean that carries NaN does."""
    whole = [F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_n_{c}") for c in columns]]
    fitted = fit(df, columns, "zscore", keys).join(df.groupBy(*keys).agg(*whole), keys)
    both = df.join(fitted, keys, "left")
    score = lambda c: F.coalesce((F.col(c) - F.col(f"{c}_shift")) / F.col(f"{c}_scale"), F.lit(0.0))
    kept: dict[str, Column] = {c: F.when(F.col(f"_n_{c}") < F.col("_n"), F.lit(0.0)).otherwise(score(c)) if compat else score(c) for c in columns}
    return both.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in df.columns])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, low, high, mean, variance of each column, one row each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def unit_hash(seed: int, *columns: str) -> Column:
    """A uniform number in [0, 1) of 52 bits from the md5 of seed and columns: the same in every run and engine."""
    said = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long") / float(1 << 52)


def jitter(seed: int, sigma: float, *columns: str) -> Column:
    """Gaussian noise by Box-Muller from two hashes."""
    u, v = unit_hash(seed, *columns), unit_hash(seed + 1, *columns)
    return sigma * F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * 3.141592653589793 * v)


def jittered(nodes: DataFrame, edges: DataFrame, triangles: DataFrame, keys: list[str], noise: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, triangles) of a structure whose sites are moved by ``noise`` (x, y, z, e.g. :func:`jitter`), with what
    hangs on the coordinates made anew: ``step`` of each edge, and ``normal`` of each triangle (over its length + 1e-8).

    nodes: keys, node, x, y, z; edges: keys, u, v; triangles: keys, i, j, k. Edges and triangles of unknown nodes have NULLs.
    """
    moved = nodes.withColumns({c: F.col(c) + n for c, n in zip("xyz", noise)})
    at = lambda end: moved.select(*keys, F.col("node").alias(end), F.array("x", "y", "z").alias(f"_{end}"))
    e, t = edges, triangles
    for end in "uv":
        e = e.join(at(end), [*keys, end], "left")
    n = tasks(triangles.count())
    for end in "ijk":
        t = t.repartition(n, *keys, end).join(at(end).repartition(n, *keys, end), [*keys, end], "left")
    normal = let(cross(sub(F.col("_j"), F.col("_i")), sub(F.col("_k"), F.col("_i"))), lambda n: let(norm(n) + 1e-8, lambda m: F.array(*[n[i] / m for i in range(3)])))
    return moved, e.select(*edges.columns, sub(F.col("_v"), F.col("_u")).alias("step")), t.select(*triangles.columns, normal.alias("normal"))


def masked(df: DataFrame, column: str, token: Column, rate: float, seed: int, *ids: str) -> DataFrame:
    """df with column replaced by ``token`` where a hashed uniform is under ``rate``, and the flag _masked."""
    flag = unit_hash(seed, *ids) < rate
    return df.withColumn("_masked", flag).withColumn(column, F.when(F.col("_masked"), token).otherwise(F.col(column)))
