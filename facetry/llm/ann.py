"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Vectors are put on the unit sphere of one more dimension, within bands of similar norm, where the
largest inner product is the smallest distance. Each table hashes by ``m`` Gaussian projections cut
into cells of ``width``; a query visits its own cell and then the cells whose perturbations cross the
nearest walls, in order of the summed squared distance to them. Candidates of all tables are scored by
the exact inner product of the original vectors, in double precision.

Equal vectors form one class that keeps its ``k`` + 1 smallest ids (no more can ever be answers), so a
very common vector is compared once. Buckets with many vectors or queries are cut into blocks that
meet pairwise. Queries left with under ``k`` answers are compared with all vectors, in blocks.

Edge cases: null vectors, zero vectors, vectors holding null or non-finite components or not of the most
common dimension take no part; repeated rows count once; an empty table gives no rows; ties go to the
smaller id. The projections depend on the seed alone; their number and that of the probes are fitted on
a bounded sample (:func:`nearest`), and norm bands cover all vectors.

A pair can be scored in several buckets, in matrix products of different shapes that differ in the last
bits. Pairs are made single before they are counted, and the answers are scored once more, component by
component in order, so a rerun gives the same bits; ties at a block's cut are kept in full.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import cut, small, written

BAND = math.log(1.25)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, each pair once."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return good.where(F.size("embedding") == sizes.select("d").scalar()).dropDuplicates(["vec_id", "embedding"])


def projections(dimension: int, tables: int, m: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.standard_normal((tables * m, dimension + 1)), r.uniform(0, width, tables * m)


def perturbations(walls: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """``walls`` (2m): squared distances to the lower walls of each projection, then to the upper ones.
    The ``probes`` cheapest sets of moves, cheapest first, the empty set before them."""
    m, order = len(walls) // 2, np.argsort(walls, kind="stable")
    cost = walls[order].tolist()
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        s, moves = heapq.heappop(heap)
        named = [int(order[i]) for i in moves]
        if len({x % m for x in named}) == len(named):
            out.append(tuple(named))
        last = moves[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (s + cost[last + 1], (*moves, last + 1)))
            heapq.heappush(heap, (s - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
    return out


def _cells(cells: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row of cell numbers."""
    key = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for c in cells.T:
        key = (key ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def hashed(classes: DataFrame, dimension: int, tables: int, m: int, width: float, probes: int, bands: list[int], seed: int) -> DataFrame:
    """bucket, side (0 indexed, 1 asking), cid of every table entry and probe."""
    a, b = projections(dimension, tables, m, width, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, x, asks = batch.column(0).to_numpy(), _rows(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(cid):
                continue
            norms = np.linalg.norm(x, axis=1)
            band = np.floor(np.log(norms) / BAND).astype(int)
            top = np.exp((band + 1) * BAND)
            scaled = x / top[:, None]
            on = np.concatenate((scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))[:, None]), 1)
            out: list[tuple[np.ndarray, int, np.ndarray]] = []
            spot = np.floor((on @ a.T + b) / width)
            for t in range(tables):
                own = np.column_stack((np.full(len(cid), t), band, spot[:, t * m : t * m + m]))
                out.append((_cells(own), 0, cid))
            q = np.flatnonzero(asks)
            if len(q):
                ask = np.concatenate((x[q] / norms[q, None], np.zeros((len(q), 1))), 1)
                at = (ask @ a.T + b) / width
                home, rest = np.floor(at), at - np.floor(at)
                for t in range(tables):
                    part, cells, who = slice(t * m, t * m + m), [], []
                    for i in range(len(q)):
                        for moves in perturbations(np.concatenate((rest[i, part] ** 2, (1 - rest[i, part]) ** 2)), probes):
                            cell = home[i, part].copy()
                            for x_ in moves:
                                cell[x_ % m] += -1 if x_ < m else 1
                            cells.append(cell)
                            who.append(cid[q[i]])
                    cells, who = np.array(cells), np.array(who)
                    for n in bands:
                        out.append((_cells(np.column_stack((np.full(len(who), t), np.full(len(who), n), cells))), 1, who))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([np.full(len(o[2]), o[1], np.int32) for o in out])), pa.array(np.concatenate([o[2] for o in out]))], names=["bucket", "side", "cid"])

    return classes.select("cid", "embedding", "asks").mapInArrow(run, "bucket long, side int, cid long")


def _top(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``n`` largest and of what differs from the last of them by rounding only."""
    if scores.shape[1] <= n:
        return tuple(np.indices(scores.shape).reshape(2, -1))
    last = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    return np.nonzero(scores >= last - 1e-12 * np.maximum(1.0, np.abs(last)))


def _best(met: DataFrame, k: int) -> DataFrame:
    """met (bucket, block, side, cid, embedding) -> qid, cid, score: each asking class's best classes of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asks, found = None, [], []

        def finish():
            if not asks or not found:
                return None
            q = np.concatenate([x[0] for x in asks])
            row, cid, score = (np.concatenate([f[i] for f in found]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(cid), pa.array(score)], names=["qid", "cid", "score"])

        def less() -> list:
            """What was found, cut to each asking vector's best."""
            row, cid, score = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((-score, row))
            row, cid, score = row[order], cid[order], score[order]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, len(row)]))
            last = score[np.minimum(first + k - 1, len(row) - 1)]
            keep = (np.arange(len(row)) < first + k) | ((row[np.minimum(first + k - 1, len(row) - 1)] == row) & (score >= last - 1e-12 * np.maximum(1.0, np.abs(last))))
            return [(row[keep], cid[keep], score[keep])]

        for batch in batches:
            bucket, block, side, cid, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), _rows(batch.column(4))
            if not len(cid):
                continue
            cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])])
            for s, e in zip(cuts, np.r_[cuts[1:], len(cid)]):
                if (bucket[s], block[s]) != key:
                    if (done := finish()) is not None:
                        yield done
                    key, asks, found = (bucket[s], block[s]), [], []
                if side[s]:
                    asks.append((cid[s:e], x[s:e]))
                elif asks:
                    y = x[s:e]
                    scores = np.concatenate([a[1] for a in asks]) @ y.T
                    row, col = _top(scores, k)
                    found.append((row, cid[s:e][col], scores[row, col]))
                    if len(found) > 16:
                        found = less()
        if (done := finish()) is not None:
            yield done

    ordered = met.select("bucket", "block", "side", "cid", "embedding").repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("side"))
    return ordered.mapInArrow(run, "qid long, cid long, score double")


def _blocks(rows: DataFrame, indexed: str, asking: str) -> DataFrame:
    """Give every row its blocks: indexed rows meet each asking block of their bucket and the reverse."""
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("side") == 0, F.col(indexed)).otherwise(F.col(asking)))
    other = F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col(asking)).otherwise(F.col(indexed)) - 1)
    return rows.withColumn("_own", own).withColumn("_other", F.explode(other)).withColumn(
        "block", F.when(F.col("side") == 0, F.col("_own") * F.col(asking) + F.col("_other")).otherwise(F.col("_other") * F.col(asking) + F.col("_own")))


def everywhere_rows(classes: DataFrame, asks: DataFrame, n: int, n_asks: int, block_rows: int) -> DataFrame:
    """The rows that are sent out so that ``n_asks`` classes meet all ``n``: each vector once for each block of askers, each asker once for each block of vectors."""
    blocks = lambda rows: F.lit(max(1, -(-rows // block_rows))).cast("long")
    both = classes.select("cid", "embedding", F.lit(0).alias("side")).unionAll(asks.select("cid", "embedding", F.lit(1).alias("side")))
    return _blocks(both.withColumn("_x", blocks(n)).withColumn("_q", blocks(n_asks)), "_x", "_q").withColumn("bucket", F.lit(0).cast("long"))


def tuned(asks: np.ndarray, answers: list[np.ndarray], stock: np.ndarray, tables: int, width: float, target: float, deepest: int, seed: int) -> tuple[int, int, float]:
    """(m, probes, recall): the setting that visits the smallest share of ``stock`` and finds ``target`` of the answers."""
    unit = lambda x: np.concatenate((x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))), 1)
    best = (math.inf, 1, 3, 0.0)
    for m in range(1, deepest + 1):
        a, b = projections(asks.shape[1], tables, m, width, seed)
        at = (unit(asks) @ a.T + b) / width
        home, rest = np.floor(at), at - np.floor(at)
        known = np.floor((unit(np.concatenate([stock, *answers])) @ a.T + b) / width)
        sizes = np.cumsum([len(stock), *map(len, answers)])
        for probes in (1, 3, 9, 27, 81, 200):
            if probes > 3**m:
                break
            hit = total = 0
            visited = np.zeros(len(asks))
            for i in range(len(asks)):
                mine = known[sizes[i] : sizes[i + 1]]
                seen, got = np.zeros(len(stock), int), np.zeros(len(mine), bool)
                for t in range(tables):
                    part = slice(t * m, t * m + m)
                    cells = set()
                    for moves in perturbations(np.concatenate((rest[i, part] ** 2, (1 - rest[i, part]) ** 2)), probes):
                        cell = home[i, part].copy()
                        for x in moves:
                            cell[x % m] += -1 if x < m else 1
                        cells.add(tuple(cell))
                    got |= np.array([tuple(c) in cells for c in mine[:, part]], bool)
                    seen += np.array([tuple(c) in cells for c in known[: len(stock), part]], bool)
                hit, total, visited[i] = hit + got.sum(), total + len(mine), seen.mean()
            if total and hit / total >= target:
                if visited.mean() < best[0]:
                    best = (visited.mean(), m, probes, hit / total)
                break
    return best[1:]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 8, width: float = 0.8, target: float = 0.96, sample: int = 48, stock: int = 1024, block_rows: int = 20_000, seed: int = 31) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row with vec_id divisible by ``every``.

    The number of projections a table and of probes is fitted so that ``target`` of the true answers of
    at most ``sample`` queries (compared with all vectors, in blocks) are visited, at the least share of
    at most ``stock`` vectors; both samples are the first by hash. Every vector is indexed.
    """
    used = usable(vectors).withColumn("_asks", F.col("vec_id") % every == 0)
    in_class = W.partitionBy("embedding")
    first = used.withColumn("_r", F.row_number().over(in_class.orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    asking = used.where("_asks").groupBy("embedding").agg(F.lit(True).alias("asks"))
    classes = written(
        first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).join(asking, "embedding", "left")
        .select(F.monotonically_increasing_id().alias("cid"), "embedding", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "classes")
    size = F.expr("sqrt(aggregate(embedding, 0D, (a, x) -> a + x * x))")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("embedding")).alias("d"), F.collect_set(F.floor(F.log(size) / BAND)).alias("bands")).first()
    n, dimension = facts["n"], facts["d"] or 1

    def everywhere(asks: DataFrame) -> DataFrame:
        """Exact best classes of the given classes: they meet all vectors, block by block."""
        return _best(everywhere_rows(classes, asks, n, asks.count(), block_rows), k + 1)

    by_hash = F.xxhash64("embedding")
    trial = written(classes.where("asks").orderBy(by_hash).limit(sample), "trial")
    true = everywhere(trial).withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("_r") <= k).join(classes.select("cid", F.col("embedding").alias("near")), "cid")
    shown = trial.join(true.groupBy("qid").agg(F.collect_list("near").alias("near")), F.col("cid") == F.col("qid")).select("embedding", "near").collect()
    m, probes = 1, 3
    if shown:
        some = classes.orderBy(by_hash).limit(stock).select("embedding").collect()
        m, probes, _ = tuned(np.array([r["embedding"] for r in shown]), [np.array(r["near"]) for r in shown], np.array([r["embedding"] for r in some]), tables, width, target, max(1, round(math.log2(max(2, n / 64)))), seed)
    entries = written(hashed(classes, dimension, tables, m, width, probes, sorted(facts["bands"] or []), seed), "entries")
    sizes = entries.groupBy("bucket").agg(F.sum(1 - F.col("side")).alias("x"), F.sum("side").alias("q")).where("x > 0 and q > 0").select(
        "bucket", F.ceil(F.col("x") / block_rows).alias("_x"), F.ceil(F.col("q") / block_rows).alias("_q"))
    met = _blocks(entries.join(sizes, "bucket"), "_x", "_q").join(classes.select("cid", "embedding"), "cid")
    found = written(_best(met, k + 1).groupBy("qid", "cid").agg(F.max("score").alias("score")), "found")
    enough = found.groupBy("qid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > k)
    wanting = cut(classes.where("asks").join(enough, F.col("cid") == F.col("qid"), "left_anti").select("cid", "embedding"))
    if not wanting.isEmpty():
        found = found.unionAll(everywhere(wanting))
    top = W.partitionBy("qid").orderBy(F.desc("score"), "least")
    ids = classes.select("cid", "ids", F.get("ids", F.lit(0)).alias("least"))
    both = found.groupBy("qid", "cid").agg(F.max("score").alias("score")).join(ids, "cid")
    # A few more than needed, by rounded score, so that rounding cannot push a tie out; then each is scored anew.
    rounded = W.partitionBy("qid").orderBy(F.desc(F.round("score", 10)), "least")
    near = both.withColumn("_r", F.row_number().over(rounded)).where(F.col("_r") <= k + 8).select("qid", "cid", "ids", "least")
    near = near.join(classes.select("cid", F.col("embedding").alias("_y")), "cid").join(classes.where("asks").select(F.col("cid").alias("qid"), F.col("embedding").alias("_x")), "qid")
    exact = F.aggregate(F.zip_with("_x", "_y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    ranked = near.select("qid", "ids", "least", exact.alias("score")).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).select("qid", "score", "ids")
    queries = used.where("_asks").select(F.col("vec_id").alias("query_id"), "embedding").join(classes.where("asks").select("embedding", F.col("cid").alias("qid")), "embedding").select("query_id", "qid")
    answers = ranked.select("qid", "score", F.explode("ids").alias("vec_id"))
    short = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("_r", F.row_number().over(short)).where(F.col("_r") <= k + 1)
    lists = answers.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("a"))
    own = F.slice(F.filter("a", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(small(lists, n // every), "qid").select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
