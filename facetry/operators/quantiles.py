"""Exact interpolated quantiles by key, without a buffer that holds a key's values.

Keys of up to ``limit`` values take Spark's exact percentile, whose buffer is then bounded. The others are at most rows /
``limit`` keys. Their order statistics are searched for: a sketch of bounded size gives two values around the rank, the
values below and between them are counted exactly, and the part between them is sketched again until it has at most
``limit`` values (or is one value); those are sorted in a row. Each round leaves about 4 / ``accuracy`` of the values, so a
few rounds do for any number of rows; a sketch that misses the rank only costs a round, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import cut, small, written


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], limit: int = 100_000, accuracy: int = 1_000) -> DataFrame:
    """keys, q (array<double>: a linearly interpolated quantile for each probability, as percentile); NULL without values.

    Null keys are a key; null values are left out.
    """
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    own = [*named.values()] or ["_k"]
    rows = df.select(*([F.col(k).alias(v) for k, v in named.items()] or [F.lit(0).alias("_k")]), F.col(value).cast("double").alias("x"))
    back = lambda some: some.select(*[F.col(v).alias(k) for k, v in named.items()], "q")
    counted = cut(rows.groupBy(*own).agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")))
    hot = cut(counted.where(F.col("n") > limit))
    n_hot = hot.count()
    exact = F.percentile("x", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")
    if not n_hot:
        return back(rows.groupBy(*own).agg(exact))
    marks = small(hot.select(*[F.col(k).alias(f"_j{k}") for k in own]), n_hot)
    same = [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in own]
    few = rows.join(marks, same, "left_anti").groupBy(*own).agg(exact)
    values = rows.where("x is not null").join(marks, same, "left_semi")
    return back(few.unionByName(_searched(values, hot, own, probabilities, limit, accuracy)))


def _searched(values: DataFrame, hot: DataFrame, own: list[str], probabilities: list[float], limit: int, accuracy: int) -> DataFrame:
    """own, q of the keys in ``hot`` (own, n, a: least, b: greatest value)."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), (p * (F.col("n") - 1)).alias("at")) for i, p in enumerate(probabilities)])
    # A search: ranks low and low + 1 lie among the values from a to b; ``below`` are smaller, ``between`` are strictly inside.
    open_ = hot.select(*own, "n", "a", "b", F.explode(places).alias("p")).select(
        *own, "p.i", (F.col("p.at") - F.floor("p.at")).alias("part"), F.floor("p.at").alias("low"), "a", "b", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.col("n").alias("between"))
    open_, done, margin = written(open_, "searches"), None, 2
    while True:
        settled = (F.col("between") <= limit) | (F.col("a") == F.col("b"))
        ready, open_ = open_.where(settled), cut(open_.where(~settled))
        done = ready if done is None else done.unionByName(ready)
        n = open_.count()
        if not n:
            break
        # Ties at the bounds do not count as between, so what is left there is at most a few steps of the sketch.
        sketch = _within(values, small(open_, n), own).groupBy(*own, "i").agg(F.percentile_approx("x", F.array(*[F.lit(k / accuracy) for k in range(accuracy + 1)]), F.lit(accuracy * 4)).alias("s"))
        known = _beside(open_, sketch, own)
        step = lambda shift: F.floor((F.col("low") - F.col("below") + shift) / F.col("inside") * accuracy).cast("int")
        at = lambda k: F.get("s", F.least(F.lit(accuracy), F.greatest(F.lit(0), k)))
        tried = written(known.withColumn("_a", at(step(0) - margin)).withColumn("_b", at(step(1) + margin + 1)).drop("s"), "tries")
        counts = _within(values, small(tried, n), own).groupBy(*own, "i").agg(
            F.sum((F.col("x") < F.col("_a")).cast("long")).alias("_less"), F.sum(F.col("x").between(F.col("_a"), F.col("_b")).cast("long")).alias("_in"), F.sum(((F.col("x") > F.col("_a")) & (F.col("x") < F.col("_b"))).cast("long")).alias("_mid"))
        both, first = _beside(tried, counts, own), F.col("low") - F.col("below")
        holds = (F.col("_less") <= first) & (first + F.when(F.col("part") > 0, 1).otherwise(0) < F.col("_less") + F.col("_in"))
        take = lambda new, old: F.when(holds, F.col(new)).otherwise(F.col(old)).alias(old)
        open_ = written(both.select(*own, "i", "part", "low", take("_a", "a"), take("_b", "b"), (F.col("below") + F.when(holds, F.col("_less")).otherwise(0)).alias("below"), take("_in", "inside"), take("_mid", "between")), "searches")
        margin *= 2
    done = written(done, "found")
    counted = _within(values, small(done, done.count()), own).groupBy(*own, "i", "x").agg(F.count(F.lit(1)).alias("_c"))
    ranked = counted.withColumn("_upto", F.sum("_c").over(W.partitionBy(*own, "i").orderBy("x")))
    met = _beside(done, ranked, own).withColumn("_rank", F.col("low") - F.col("below"))
    ends = met.groupBy(*own, "i", "part").agg(F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("x"))).alias("_x"), F.min(F.when(F.col("_upto") > F.col("_rank") + 1, F.col("x"))).alias("_y"))
    each = ends.select(*own, "i", F.when(F.col("part") > 0, F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("part")).otherwise(F.col("_x")).alias("x"))
    return each.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))


def _met(left: DataFrame, right: DataFrame, on: list[str], *more: Column) -> DataFrame:
    """Inner join by equal columns, null being a value, and ``more``; each of ``on`` once."""
    named = right.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on] + list(more)).drop(*[f"_j_{c}" for c in on])


def _beside(searches: DataFrame, other: DataFrame, own: list[str]) -> DataFrame:
    """Searches with the columns of ``other`` (own, i, ...)."""
    return _met(searches, other, [*own, "i"])


def _within(values: DataFrame, searches: DataFrame, own: list[str]) -> DataFrame:
    """The values that lie in a search's bounds, with its columns; searches are few and broadcast behind their count."""
    return _met(values, searches, own, F.col("x") >= F.col("a"), F.col("x") <= F.col("b"))
