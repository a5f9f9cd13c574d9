"""Mixing sources to target weights by Sainte-Lague block quotas [native].

1. Each source's target is its weight's share of all words; a target stops at ``most`` times its
   source, and the excess is shared again by weight (water-filling, solved in closed form).
2. Targets become whole blocks: first blocks to sources, then each source's blocks to its shards,
   both by highest quotients (:func:`facetry.llm.apportion.sainte_lague`).
3. Inside a shard, documents stand in a seeded order and their words are cut into blocks of equal
   size. Every block is taken ``quota div blocks`` times, and ``quota mod blocks`` blocks, chosen by
   seeded hash, once more. A document's ``taken`` words are those of its blocks, repeats counted.

Shards hold about ``shard_words`` words whatever the source's size, so a hot source spreads over
many tasks. Edge cases: null text counts 0 words; documents without words take none; a null source
is a source of its own, ordered last; repeated rows are separate documents; an empty table gives no
rows. Only doc_id, source and text are read, so further columns do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.llm.apportion import sainte_lague
from facetry.session import cut, small, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: DataFrame | None = None, most: float = 3.0) -> DataFrame:
    """totals (source, source_size) -> source, sid, source_size, weight, target.

    ``weights`` (source, weight) gives the mix; without it the sources in code-point order, null
    last, weigh 1, 2, 3, repeating. The windows run over one row a source.
    """
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("sid", F.row_number().over(order).cast("long"))
    if weights is None:
        ranked = ranked.withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        ranked = ranked.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    fill = everything.orderBy(F.col("_cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("_total") - F.col("_caps")
    return (
        ranked.where("weight > 0")
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)))
        .withColumn("_open", F.col("_weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("_full", F.col("_cap") * F.col("_open") <= F.col("weight") * rest)
        .withColumn("_level", F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), "sid", (rest / F.col("_open")).alias("level")))).over(everything))
        .select("source", "sid", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_level.level") * F.col("weight"), F.col("_cap"))).alias("target"))
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, most: float = 3.0, block_words: int = 64, shard_words: int = 1 << 18, seed: int = 17, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text).

    ``also`` names columns of ``docs`` to hand on; sid and shard then follow, null for rows outside the shards.
    """
    sized = written(docs.select("doc_id", "source", n_words().alias("size"), *also), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, most).withColumn("_all", F.lit(0)))
    many = targets.count()
    blocks = targets.withColumn("_seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words).cast("long"))
    quotas = cut(
        sainte_lague(blocks, "_all", "sid", "target", "_seats", "quota").select(
            "source", "sid", "source_size", "target", "quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards")
        )
    )
    named = sized.withColumnRenamed("source", "_source")
    rows = named.join(small(quotas, many), F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source" if weights is None else "source")
    if weights is not None:
        rows = rows.withColumnRenamed("_source", "source").fillna(0.0, ["target"])
    wordless = rows.where((F.col("size") == 0) | F.col("sid").isNull())
    laid = (
        rows.where((F.col("size") > 0) & F.col("sid").isNotNull())
        .withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("shards")))
    )
    shards = laid.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    plan = sainte_lague(shards, "sid", "shard", "words", "quota", "won").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long"))
    plan = plan.withColumn("won", F.least(F.col("won"), F.floor(most * F.col("blocks")).cast("long")))
    chosen = (
        plan.select("sid", "shard", "words", "blocks", "won", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
        .withColumn("_r", F.row_number().over(W.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "sid", "shard", "b"), "b")))
        .withColumn("_lo", F.floor(F.col("b") * F.col("words") / F.col("blocks")).cast("long"))
        .withColumn("_hi", F.floor((F.col("b") + 1) * F.col("words") / F.col("blocks")).cast("long"))
        .withColumn("_take", F.when(F.col("_r") <= F.col("won") % F.col("blocks"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(0)))
        .withColumn("_before", F.sum("_take").over(W.partitionBy("sid", "shard").orderBy("b")) - F.col("_take"))
        .groupBy("sid", "shard")
        .agg(
            F.first("words").alias("words"), F.first("blocks").alias("blocks"), F.first("won").alias("won"), F.sum("_take").alias("_whole"),
            F.array_sort(F.collect_list(F.struct("b", "_lo", "_take", "_before"))).alias("_cuts"),
        )
    )
    run = W.partitionBy("sid", "shard").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    spots = laid.withColumn("_end", F.sum("size").over(run)).withColumn("_start", F.col("_end") - F.col("size"))

    def upto(x: str):
        """Words of once-more blocks before word x of the shard."""
        block = F.get("_cuts", F.floor(((F.col(x) + 1) * F.col("blocks") - 1) / F.col("words")).cast("int"))
        return F.when(F.col(x) >= F.col("words"), F.col("_whole")).otherwise(
            block["_before"] + F.when(block["_take"] > 0, F.col(x) - block["_lo"]).otherwise(F.lit(0))
        )

    taken = F.floor(F.col("won") / F.col("blocks")).cast("long") * F.col("size") + upto("_end") - upto("_start")
    out = ["doc_id", "source", "size", "source_size", "target"]
    where = [*also, "sid", "shard"] if also else []
    nowhere = [*also, F.lit(None).cast("long").alias("sid"), F.lit(None).cast("long").alias("shard")] if also else []
    return spots.join(chosen, ["sid", "shard"]).select(*out, taken.cast("long").alias("taken"), *where).unionAll(wordless.select(*out, F.lit(0).cast("long").alias("taken"), *nowhere))


def mixed_documents(docs: DataFrame, seed: int = 17, **kw) -> DataFrame:
    """Rows of ``docs`` as the mix repeats them, so that whole documents make up the words taken.

    A shard's taken words over its words are its copies a document: all get the whole part, and one more
    go to a systematic sample of the fraction. Documents stand by size, so the sample has its share of
    every length and misses the shard's words by about one document; the count left over at a shard's end
    is carried to the next shard of its source. Documents without words are not part of a mix. Equal rows
    are known by two hashes and share their copies. Extra columns may have any name.
    """
    whole = F.struct(*docs.columns)
    marked = docs.select("doc_id", "source", "text", whole.alias("_whole"), F.concat(F.hex(F.xxhash64(whole)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), whole))).alias("_row"))
    rows = mix(marked, seed=seed, also=("_row",), **kw).where("sid is not null")
    units = written(rows.groupBy("sid", "shard", "_row", F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken")), "mix-units")
    shards = units.groupBy("sid", "shard").agg((F.sum("taken") / F.sum(F.col("n") * F.col("_size"))).alias("ratio"), F.sum("n").alias("rows"))
    share = F.col("ratio") - F.floor("ratio")
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "sid"), F.lit(1 << 20)) / (1 << 20)
    earlier = F.sum(share * F.col("rows")).over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("sid", "shard", F.floor("ratio").alias("base"), share.alias("share"), (start + F.coalesce(earlier, F.lit(0.0))).alias("_at")).withColumn("_at", F.col("_at") - F.floor("_at"))
    run = W.partitionBy("sid", "shard").orderBy("_size", F.xxhash64(F.lit(seed + 4), "_row"), "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = lambda n: F.floor(F.col("share") * n + F.col("_at"))
    plan = (
        units.withColumn("_upto", F.sum("n").over(run)).join(shards, ["sid", "shard"])
        .select("_row", "_size", "n", (F.col("n") * F.col("base") + upto(F.col("_upto")) - upto(F.col("_upto") - F.col("n"))).alias("_all"))
        .where("_all > 0")
    )
    met = marked.withColumn("_size", n_words()).join(plan, ["_row", "_size"])
    place = F.row_number().over(W.partitionBy("_row", "_size").orderBy("_row"))
    copies = F.floor(F.col("_all") / F.col("n")) + F.when(F.col("_place") <= F.col("_all") % F.col("n"), 1).otherwise(0)
    return met.withColumn("_place", place).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*[F.col("_whole")[c].alias(c) for c in docs.columns])
