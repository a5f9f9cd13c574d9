"""Sainte-Lague apportionment of seats by highest quotients, as DataFrame operations.

Seat k of a party with weight w has the quotient w / (2k - 1); the seats with the highest quotients
win. With x = w * seats / sum(w) and J parties, every winning seat lies within (1 +- d) * x of its
party for d = (J / 2 + 1) / seats, so at most about 3 J + 2 quotients are compared, whatever the
number of seats. The cut is found from 1,024 counts a group; only the bucket that holds it is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024


def sainte_lague(parties: DataFrame, group: str, key: str, weight: str, seats: str, won: str) -> DataFrame:
    """Add ``won`` (long) to ``parties``: seats of each (group, key), with ``seats`` (long) seats a group.

    Equal quotients go to the smaller key. Groups without weight or seats win none. ``group`` and
    ``key`` must not be null; (group, key) must be unique.
    """
    whole = W.partitionBy(group)
    base = (
        parties.withColumn("_sum", F.sum(weight).over(whole).cast("double"))
        .withColumn("_n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(whole))
        .withColumn("_x", F.when((F.col("_sum") > 0) & (F.col(seats) > 0), F.col(weight) * F.col(seats) / F.when(F.col("_sum") > 0, F.col("_sum"))).otherwise(F.lit(0.0)))
        .withColumn("_d", F.when(F.col(seats) > 0, (F.col("_n") / 2.0 + 1.0) / F.when(F.col(seats) > 0, F.col(seats))).otherwise(F.lit(1.0)))
        .withColumn("_low", F.greatest(F.lit(0.0), 1.0 - F.col("_d")))
        .withColumn("_sure", F.floor(F.col("_x") * F.col("_low") + F.when(F.col("_low") > 0, 0.5).otherwise(0.0)).cast("long"))
        .withColumn("_most", F.floor(F.col("_x") * (1.0 + F.col("_d")) + 0.5).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    )
    seat = (
        base.where((F.col("_x") > 0) & (F.col("_most") > F.col("_sure")))
        .select(group, key, "_x", "_d", "_low", "_open", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
        .withColumn("_at", (F.col("_k") - 0.5) / F.col("_x"))
        .withColumn("_b", F.floor((F.col("_at") - F.col("_low")) / (1.0 + F.col("_d") - F.col("_low")) * BUCKETS).cast("long"))
    )
    cuts = (
        seat.groupBy(group, "_b")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_open").alias("_o"))
        .withColumn("_before", F.sum("_c").over(W.partitionBy(group).orderBy("_b")) - F.col("_c"))
        .where((F.col("_before") < F.col("_o")) & (F.col("_before") + F.col("_c") >= F.col("_o")))
        .select(group, F.col("_b").alias("_cut"), (F.col("_o") - F.col("_before")).alias("_rest"))
    )
    placed = seat.join(cuts, group)
    below = placed.where(F.col("_b") < F.col("_cut")).select(group, key)
    ranked = (
        placed.where(F.col("_b") == F.col("_cut"))
        .withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_at", key, "_k")))
        .where(F.col("_r") <= F.col("_rest"))
        .select(group, key)
    )
    extra = below.unionAll(ranked).groupBy(group, key).agg(F.count(F.lit(1)).alias("_extra"))
    return base.join(extra, [group, key], "left").select(
        *[F.col(c) for c in parties.columns], (F.col("_sure") + F.coalesce(F.col("_extra"), F.lit(0))).alias(won)
    )
