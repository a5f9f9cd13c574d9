"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix [native].

Input partitions hold n_1 .. n_V rows; shards have exact sizes m_1 .. m_C. The number of rows that
partition p sends to shard c, under a uniform random permutation of all rows, is drawn exactly: the
partitions form a binary tree, and every node deals the shard capacities it received to its two
halves by successive hypergeometric draws (inversion over the probability ratios, from the mode).
Then rows are permuted inside their partition, cut by the partition's row of the matrix, exchanged,
and permuted again inside their shard, which gives gapless slots.

A partition holds about ``part_rows`` rows, or the root of the number of rows where that is more. The
second permutation deals a shard's rows to cells of about ``cell_rows`` by the same hash that orders
them, and sets a cell off by the counts of the cells before it. So no task sorts more than a partition
or a cell. The matrix has partitions x shards entries, the nodes of its tree are spread over tasks, and
it never passes through the driver.

Edge cases: null text counts no bytes and has the crc of no bytes; repeated rows are separate rows;
an empty table gives no rows; with fewer rows than shards the last shards stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import written


def _draw(good: str, total: str, taken: str, key: str, seed: int) -> str:
    """SQL for one hypergeometric draw: good ones among ``taken`` of ``total`` that hold ``good``.

    Weights relative to the mode follow from the ratios of neighbouring probabilities; the walk spans
    nine standard deviations and some, beyond which no double-precision weight is left.
    """
    u = f"(pmod(xxhash64({seed}, {key}), 9007199254740992L) / 9007199254740992D)"
    low, high = "greatest(0L, q.t - (q.n - q.g))", "least(q.t, q.g)"
    mode = f"least({high}, greatest({low}, cast(floor((q.t + 1D) * (q.g + 1D) / (q.n + 2D)) as bigint)))"
    width = "cast(16 + ceil(9 * sqrt(q.t * (q.g / greatest(1D, cast(q.n as double))) * (1 - q.g / greatest(1D, cast(q.n as double))) * (q.n - q.t) / greatest(1D, q.n - 1D))) as bigint)"
    up = "(q.g - k) * cast(q.t - k as double) / ((k + 1D) * (q.n - q.g - q.t + k + 1D))"
    down = "k * cast(q.n - q.g - q.t + k as double) / ((q.g - k + 1D) * (q.t - k + 1D))"
    # Two folds: the total weight on either side of the mode, then the value at which it passes u * total.
    side = lambda a, b, ratio: f"""case when {a} then aggregate({b}, named_struct('w', 1D, 's', 0D), (s, k) -> named_struct('w', s.w * {ratio}, 's', s.s + s.w * {ratio})).s else 0D end"""
    seek = lambda b, ratio, step, x: f"""aggregate({b}, named_struct('w', 1D, 's', 0D, 'k', r.mo), (s, k) -> case when s.s >= {x} then s else named_struct('w', s.w * {ratio}, 's', s.s + s.w * {ratio}, 'k', k {step} 1L) end).k"""
    ups, downs = "sequence(r.mo, r.hi - 1L)", "sequence(r.mo, r.lo + 1L, -1L)"
    return f"""get(transform(array(named_struct('g', {good}, 'n', {total}, 't', {taken}, 'u', {u})), q ->
      get(transform(array(named_struct('mo', {mode}, 'lo', greatest({low}, {mode} - {width}), 'hi', least({high}, {mode} + {width}))), r ->
      get(transform(array(named_struct('up', {side('r.hi > r.mo', ups, up)}, 'down', {side('r.mo > r.lo', downs, down)})), z ->
        case when q.u * (1D + z.up + z.down) < 1D then r.mo
             when q.u * (1D + z.up + z.down) < 1D + z.up and r.hi > r.mo then {seek(ups, up, '+', 'q.u * (1D + z.up + z.down) - 1D')}
             when r.mo > r.lo then {seek(downs, down, '-', 'q.u * (1D + z.up + z.down) - 1D - z.up')}
             else r.mo end), 0)), 0)), 0)"""


def communication_matrix(counts: DataFrame, sizes: list[int], levels: int, seed: int) -> DataFrame:
    """counts (one row: column n, array<long> of 2^levels partition sizes) -> part, sends array<long>.

    A node carries the sizes of its own partitions only. Every fourth level its nodes are dealt to more tasks.
    """
    caps = ", ".join(f"{s}L" for s in sizes)
    nodes = counts.select(F.expr(f"array({caps})").alias("caps"), F.lit(0).alias("node"), "n")
    for level in range(levels):
        half = 1 << (levels - level - 1)
        if level and level % 4 == 0:
            nodes = nodes.repartition(min(1 << level, 4096), "node")
        total, left = "aggregate(n, 0L, (a, x) -> a + x)", f"aggregate(slice(n, 1, {half}), 0L, (a, x) -> a + x)"
        draw = _draw("x.c", "s.n", "s.t", f"{level}, node, x.i", seed)
        deal = f"""aggregate(transform(caps, (c, i) -> named_struct('c', c, 'i', i)), named_struct('n', {total}, 't', {left}, 'o', cast(array() as array<bigint>)),
            (s, x) -> get(transform(array({draw}), d -> named_struct('n', s.n - x.c, 't', s.t - d, 'o', concat(s.o, array(d)))), 0)).o"""
        first, second = f"named_struct('caps', l, 'node', node * 2, 'n', slice(n, 1, {half}))", f"named_struct('caps', zip_with(caps, l, (a, b) -> a - b), 'node', node * 2 + 1, 'n', slice(n, {half + 1}, {half}))"
        nodes = nodes.withColumn("l", F.expr(deal)).select(F.explode(F.expr(f"array({first}, {second})")).alias("e")).select("e.*")
    return nodes.select(F.col("node").alias("part"), F.col("caps").alias("sends"))


def shuffle_rows(rows: DataFrame, shards: int = 40, seed: int = 23, part_rows: int = 1 << 15, cell_rows: int = 1 << 18) -> DataFrame:
    """``rows`` with shard and slot, uniformly permuted, law "rows".

    ``rows`` is written once, so that each row keeps its partition and place when tasks are repeated.
    """
    kept = written(rows.withColumn("_at", F.monotonically_increasing_id()), "shuffle-rows")
    n = kept.count()
    levels = max(0, math.ceil(math.log2(max(1, n / max(part_rows, math.isqrt(n))))))
    parts, cells = 1 << levels, max(1, round(n / shards / cell_rows))
    # The matrix's partitions are runs of 256 neighbouring input rows, dealt evenly.
    placed = kept.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), F.shiftright(F.col("_at"), 8)), F.lit(parts)).cast("int"))
    every = rows.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part"), F.lit(0).alias("c"))
    counted = placed.select("_part", F.lit(1).alias("c")).unionAll(every).groupBy("_part").agg(F.sum("c").alias("c"))
    counts = counted.agg(F.transform(F.array_sort(F.collect_list(F.struct("_part", "c"))), lambda x: x["c"]).alias("n"))
    matrix = communication_matrix(counts, [n // shards + (s < n % shards) for s in range(shards)], levels, seed).select(F.col("part").alias("_part"), F.expr(
        "aggregate(sends, cast(array() as array<bigint>), (a, x) -> concat(a, array(x + coalesce(get(a, size(a) - 1), 0L))))").alias("_upto"))
    matrix = written(matrix, "shuffle-matrix")
    local = W.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_at"), "_at")
    again = F.xxhash64(F.lit(seed + 2), "_at")
    sent = (
        placed.withColumn("_r", F.row_number().over(local))
        .join(F.broadcast(matrix) if parts * shards <= 1 << 20 else matrix, "_part")
        .withColumn("shard", F.expr("size(filter(_upto, x -> x < _r))"))
        .withColumn("_cell", F.pmod(again, F.lit(cells)).cast("int"))
        .drop("_upto", "_part", "_r")
    )
    sent = written(sent, "shuffle-sent")
    own = W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    before = sent.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0))).drop("_n")
    ranked = sent.withColumn("_own", F.row_number().over(W.partitionBy("shard", "_cell").orderBy(again, "_at")))
    met = ranked.join(F.broadcast(before) if shards * cells <= 100_000 else before, ["shard", "_cell"])
    return met.withColumn("slot", F.col("_own") - 1 + F.col("_before")).drop("_cell", "_at", "_own", "_before")


def sharded(docs: DataFrame, shards: int = 40, seed: int = 23, **kw) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shuffle_rows(narrow, shards, seed, **kw)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
