"""Ordered series: rows (keys, axis, value).

A series is cut into segments along its axis, each a window of its own, so that a key with very many rows spreads over
tasks. What crosses a cut is carried by a table of the segments: their first and last rows, counts and decayed sums. Keys
of up to ``rows`` rows are one segment; the cuts of longer ones come from a sketch of bounded size. Rows of one axis value
stay in one segment; in it, equal axis values are ordered by the carried columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import cut, small

ROWS = 1_000_000


def segmented(series: DataFrame, keys: list[str], axis: str, rows: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``series`` with its segment ``_seg`` (from 0, along the axis; null axis values in 0), and the keys with several (None: no key).

    There are at most (rows in all) / ``rows`` such keys. A null key is one segment.
    """
    n = series.groupBy(*keys).agg(F.count(axis).alias("_n"))
    long = cut(n.where(F.col("_n") > rows))
    n_long = long.count()
    if not n_long:
        return series.withColumn("_seg", F.lit(0)), None
    most = long.agg(F.max("_n")).first()[0]
    steps = max(2, -(-most // rows))
    few = small(long, n_long)
    sketch = series.join(few, keys).groupBy(*keys).agg(F.percentile_approx(axis, F.array(*[F.lit(i / steps) for i in range(1, steps)]), F.lit(10 * steps)).alias("_s"), F.first("_n").alias("_n"))
    # A key of fewer rows than the longest takes every so many of the cuts.
    every = F.greatest(F.lit(1), F.floor(F.lit(steps) / F.ceil(F.col("_n") / rows)).cast("int"))
    cuts = cut(sketch.select(*keys, F.array_distinct(F.filter("_s", lambda x, i: (i + 1) % every == 0)).alias("_cuts")))
    met = series.join(small(cuts, n_long), keys, "left")
    seg = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(axis))), F.lit(0))
    return met.withColumn("_seg", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(seg)).drop("_cuts"), small(cuts.select(*keys), n_long)


def shifted(series: DataFrame, keys: list[str], axis: str, columns: list[str], before: bool = False, after: bool = False, rows: int = ROWS) -> DataFrame:
    """``series`` with _before_{c} and _after_{c}: each column in the rows before and after in its key's order by axis."""
    cutted, long = segmented(series, keys, axis, rows)
    order = [axis, *[c for c in columns if c != axis]]
    w = W.partitionBy(*keys, "_seg").orderBy(*order)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    out = cutted.withColumn("_row", row)
    out = out.withColumns({**({"_b": F.lag("_row").over(w)} if before else {}), **({"_a": F.lead("_row").over(w)} if after else {})})
    if long is not None:
        # One row a segment: the last row of the segment before it, and the first of the one after it.
        key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        ends = cutted.join(long, keys, "left_semi").withColumn("_row", row).withColumn("_key", key).groupBy(*keys, "_seg").agg(F.min_by("_row", "_key").alias("_first"), F.max_by("_row", "_key").alias("_last"))
        along = W.partitionBy(*keys).orderBy("_seg")
        ends = cut(ends.select(*keys, "_seg", F.lag("_last").over(along).alias("_carry"), F.lead("_first").over(along).alias("_next")))
        out = out.join(small(ends, ends.count()), [*keys, "_seg"], "left")
        out = out.withColumns({**({"_b": F.coalesce("_b", "_carry")} if before else {}), **({"_a": F.coalesce("_a", "_next")} if after else {})})
    made = [F.col(f"_{side[0]}")[f"c{i}"].alias(f"_{side}_{c}") for side, on in (("before", before), ("after", after)) if on for i, c in enumerate(columns)]
    return out.select(*series.columns, *made)


def integral(series: DataFrame, keys: list[str], axis: str, value: str, bound: Column, rows: int = ROWS) -> DataFrame:
    """keys, integral: trapezoids whose both ends lie at or under ``bound``, at least 0; 0 without points, NULL if
    every value is NULL."""
    both = shifted(series, keys, axis, [axis, value], before=True, rows=rows)
    step = (F.col(axis) - F.col(f"_before_{axis}")) * (F.col(value) + F.col(f"_before_{value}")) / 2
    area = both.withColumn("_s", F.when(F.col(axis) <= bound, step))
    return area.groupBy(*keys).agg(F.when(F.count(value) > 0, F.greatest(F.lit(0.0), F.coalesce(F.sum("_s"), F.lit(0.0)))).alias("integral"))


def value_at(series: DataFrame, keys: list[str], axis: str, value: str, bound: Column, rows: int = ROWS) -> DataFrame:
    """keys, value: linear between the neighbours of ``bound``, the end values outside."""
    both = shifted(series.withColumn("_b", bound.cast("double")), keys, axis, [axis, value], after=True, rows=rows)
    x, y = F.col(f"_after_{axis}"), F.col(f"_after_{value}")
    between = (F.col(axis) <= F.col("_b")) & (F.col("_b") < x)
    line = F.col(value) + (F.col("_b") - F.col(axis)) * (y - F.col(value)) / F.when(x > F.col(axis), x - F.col(axis))
    got = both.groupBy(*keys).agg(F.max(F.when(between, line)).alias("_m"), F.min(axis).alias("_lo"), F.min_by(value, axis).alias("_first"), F.max_by(value, axis).alias("_last"), F.first("_b").alias("_b"))
    return got.select(*keys, F.when(F.col("_b") < F.col("_lo"), F.col("_first")).otherwise(F.coalesce("_m", "_last")).alias("value"))


def moving_average(series: DataFrame, keys: list[str], axis: str, value: str, beta: float = 0.999, rows: int = ROWS) -> DataFrame:
    """keys, average: old * beta + new * (1 - beta) in order, the first value as it is.

    The fold is a weighted sum: value i of n weighs (1 - beta) beta^(n - 1 - i), the first beta^(n - 1). A segment gives
    its count and its sum as if it were the last one; the sum then decays by the rows of the segments after it.
    """
    cutted, _ = segmented(series, keys, axis, rows)
    ranked = cutted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_seg").orderBy(F.desc(axis))) - 1)
    parts = ranked.groupBy(*keys, "_seg").agg(F.sum(F.col(value) * F.pow(F.lit(beta), F.col("_r"))).alias("_s"), F.count(F.lit(1)).alias("_n"), F.min_by(value, axis).alias("_f"))
    later = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc("_seg")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = parts.withColumn("_later", later).groupBy(*keys).agg(F.sum(F.col("_s") * F.pow(F.lit(beta), F.col("_later"))).alias("_s"), (F.sum("_n") - 1).alias("_n"), F.min_by("_f", "_seg").alias("_f"))
    return n.select(*keys, ((1 - beta) * F.col("_s") + beta * F.col("_f") * F.pow(F.lit(beta), F.col("_n"))).alias("average"))


def step_angles(paths: DataFrame, keys: list[str], position: str, coords: tuple[str, ...], rows: int = ROWS) -> DataFrame:
    """keys, position, angle between the steps before and after each inner point."""
    out = shifted(paths, keys, position, [position, *[c for c in coords if c != position]], before=True, after=True, rows=rows)
    for c in coords:
        out = out.withColumn(f"_p{c}", F.col(c) - F.col(f"_before_{c}")).withColumn(f"_n{c}", F.col(f"_after_{c}") - F.col(c))
    product = sum(F.col(f"_p{c}") * F.col(f"_n{c}") for c in coords)
    length = F.sqrt(sum(F.col(f"_p{c}") ** 2 for c in coords) * sum(F.col(f"_n{c}") ** 2 for c in coords))
    return out.select(*keys, position, F.when(length > 1e-10, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / F.when(length > 1e-10, length))))).alias("angle")).where("angle is not null")


def autocorrelation(paths: DataFrame, keys: list[str], position: str, value: str, rows: int = ROWS) -> DataFrame:
    """keys, autocorrelation at lag 1; NULL for constant or too short series."""
    both = shifted(paths, keys, position, [position, value], after=True, rows=rows)
    both = both.select(*keys, F.col(value).alias("_x"), F.col(f"_after_{value}").alias("_y")).where("_x is not null and _y is not null")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("_x").alias("_a"), F.stddev_pop("_y").alias("_b"), F.covar_pop("_x", "_y").alias("_c")).select(
        *keys, F.when((F.col("_a") > 1e-12) & (F.col("_b") > 1e-12), F.col("_c") / F.when((F.col("_a") > 1e-12) & (F.col("_b") > 1e-12), F.col("_a") * F.col("_b"))).alias("autocorrelation"))


def conservation(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, score (population std over |mean|, infinite for mean 0), low and high (mean -+ std)."""
    s = series.groupBy(*keys).agg(F.stddev_pop(value).alias("_s"), F.avg(value).alias("_m"))
    return s.select(*keys, F.when(F.col("_m") == 0, F.lit(float("inf"))).otherwise(F.col("_s") / F.abs(F.when(F.col("_m") != 0, F.col("_m")))).alias("score"), (F.col("_m") - F.col("_s")).alias("low"), (F.col("_m") + F.col("_s")).alias("high"))


def extents(points: DataFrame, keys: list[str], coords: tuple[str, ...], pad: float = 0.1) -> DataFrame:
    """keys, low_/high_ of each axis padded by ``pad`` of the largest range, and range."""
    e = points.groupBy(*keys).agg(*[x for c in coords for x in (F.min(c).alias(f"_l{c}"), F.max(c).alias(f"_h{c}"))])
    e = e.withColumn("range", F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in coords]))
    return e.select(*keys, "range", *[x for c in coords for x in ((F.col(f"_l{c}") - pad * F.col("range")).alias(f"low_{c}"), (F.col(f"_h{c}") + pad * F.col("range")).alias(f"high_{c}"))])
