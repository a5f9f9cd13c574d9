"""Graph (1-simplex) operators on edge tables of many graphs at once, keyed by ``keys``.

Edges are u <= v without repeats. Joins are equalities on (keys, node); AQE splits hot nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.operators.components import WHOLE, bundled, components, numbered
from facetry.session import cut, removed, small, tasks, written


def simple_edges(pairs: DataFrame, keys: list[str], u: str, v: str, loops: bool = False) -> DataFrame:
    """Undirected simple edges of a bag of pairs; self-loops stay only on demand."""
    e = pairs.select(*keys, F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u is not null and v is not null").distinct()
    return e if loops else e.where("u <> v")


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    """a -> b and b -> a of every edge (a self-loop once)."""
    return edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b")).unionAll(edges.where("u <> v").select(*keys, F.col("v").alias("a"), F.col("u").alias("b")))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, degree; a self-loop counts twice."""
    return edges.select(*keys, F.explode(F.array("u", "v")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))


def three_cycles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, v, n3: common neighbours of the ends of each edge. Wedges meet the edge that closes them.

    Edges point to the end of higher degree (then the greater id), so a hub is the centre of few wedges.
    """
    e = edges.where("u <> v")
    degree = degrees(e, keys)
    ends = e.join(degree.select(*keys, F.col("node").alias("u"), F.col("degree").alias("_du")), [*keys, "u"]).join(degree.select(*keys, F.col("node").alias("v"), F.col("degree").alias("_dv")), [*keys, "v"])
    low = (F.col("_du") < F.col("_dv")) | ((F.col("_du") == F.col("_dv")) & (F.col("u") < F.col("v")))
    up = ends.select(*keys, F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = up.join(up.withColumnRenamed("b", "c"), [*keys, "a"]).where("b < c")
    closed = wedge.join(e.select(*keys, F.col("u").alias("b"), F.col("v").alias("c")), [*keys, "b", "c"])
    sides = closed.select(*keys, F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in ("ab", "ac", "bc")])).alias("s")).select(*keys, "s.u", "s.v")
    n = sides.groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("n3"))
    return edges.join(n, [*keys, "u", "v"], "left").fillna(0, ["n3"])


def four_cycles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, v, n4, n4_halved: cycles u-k-l-v through each edge, and the floor of half their number.

    For each neighbour k of u, the ends k and v have their common neighbours but u itself as l. Common
    neighbours are counted once for each pair, so paths of three edges are never listed.
    """
    e = edges.where("u <> v")
    ways = both_ways(e, keys)
    common = ways.join(ways.withColumnRenamed("b", "c"), [*keys, "a"]).where("b <> c").groupBy(*keys, F.col("b").alias("k"), F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    k = e.join(ways.select(*keys, F.col("a").alias("u"), F.col("b").alias("k")), [*keys, "u"]).where("k <> v")
    n = k.join(common.where("m > 1"), [*keys, "k", "v"]).groupBy(*keys, "u", "v").agg(F.sum(F.col("m") - 1).alias("n4"))
    return edges.join(n, [*keys, "u", "v"], "left").fillna(0, ["n4"]).withColumn("n4_halved", F.floor(F.col("n4") / 2))


def wedges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, k (i < j < k): all pairs of neighbours of a centre as unique sorted triples, written to the shared folder.

    Centres and triples are dealt to as many tasks as there are pairs for, which the degrees tell.
    """
    e = written(edges.where("u <> v").select(*keys, "u", "v"), "edges")
    n = tasks(degrees(e, keys).agg(F.sum(F.expr("degree * (degree - 1) div 2"))).first()[0] or 0)
    ways = both_ways(e, keys).repartition(n, *keys, "a")
    w = ways.join(ways.withColumnRenamed("b", "c"), [*keys, "a"]).where("b < c")
    t = F.array_sort(F.array("a", "b", "c"))
    found = written(w.select(*keys, t[0].alias("i"), t[1].alias("j"), t[2].alias("k")).repartition(n, *keys, "i", "j", "k").distinct(), "wedges")
    removed(e)
    return found


def wedge_centres(triples: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The first of i, j, k whose neighbours hold the other two, as ``centre``."""
    pairs = triples.select(*keys, "i", "j", "k", F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.lit(n).alias("side")) for n, (x, y) in enumerate(("ij", "ik", "jk"))])).alias("s")).select(*keys, "i", "j", "k", "s.u", "s.v", "s.side")
    there = pairs.join(edges.select(*keys, "u", "v"), [*keys, "u", "v"]).groupBy(*keys, "i", "j", "k").agg(F.collect_set("side").alias("sides"))
    has = lambda *s: F.forall(F.array(*map(F.lit, s)), lambda x: F.array_contains("sides", x))
    return there.withColumn("centre", F.when(has(0, 1), F.col("i")).when(has(0, 2), F.col("j")).when(has(1, 2), F.col("k"))).drop("sides")


def wedge_images(centred: DataFrame, edges: DataFrame, keys: list[str], distance: str = "distance") -> DataFrame:
    """``centred`` (keys, i, j, k, centre) with first, second (the other two, in order), and the image of the neighbour that
    stands for each: image_first, image_second, seen from the centre; edges: keys, u, v, image (of v from u), distance.

    Of several images of a neighbour the nearest is taken, then the least. Rows without a centre have NULLs.
    """
    turned = F.transform("image", lambda x: -x)
    ways = edges.select(*keys, F.col("u").alias("centre"), F.col("v").alias("_o"), "image", F.col(distance).alias("_d")).unionAll(edges.where("u <> v").select(*keys, F.col("v").alias("centre"), F.col("u").alias("_o"), turned.alias("image"), F.col(distance).alias("_d")))
    near = ways.groupBy(*keys, "centre", "_o").agg(F.min(F.struct("_d", "image")).alias("_n")).select(*keys, "centre", "_o", F.col("_n.image").alias("_image"))
    others = F.filter(F.array("i", "j", "k"), lambda x: x != F.col("centre"))
    out = centred.withColumn("first", F.get(others, F.lit(0))).withColumn("second", F.get(others, F.lit(1)))
    for side in ("first", "second"):
        out = out.join(near.withColumnsRenamed({"_o": side, "_image": f"image_{side}"}), [*keys, "centre", side], "left")
    return out.select(*centred.columns, "first", "second", "image_first", "image_second")


def end_attributes(edges: DataFrame, nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Edges with delta_ and avg_ of each node column; NULL where an end lacks it."""
    side = lambda end: nodes.select(*keys, F.col("node").alias(end), *[F.col(c).alias(f"_{end}_{c}") for c in columns])
    both = edges.join(side("u"), [*keys, "u"], "left").join(side("v"), [*keys, "v"], "left")
    made = [x for c in columns for x in (F.abs(F.col(f"_u_{c}") - F.col(f"_v_{c}")).alias(f"delta_{c}"), ((F.col(f"_u_{c}") + F.col(f"_v_{c}")) / 2).alias(f"avg_{c}"))]
    return both.select(*[F.col(c) for c in edges.columns], *made)


def cluster(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, v, members: both ends and their neighbours, without repeats and sorted."""
    near = both_ways(edges, keys).groupBy(*keys, F.col("a").alias("n")).agg(F.collect_set("b").alias("near"))
    side = lambda end: near.select(*keys, F.col("n").alias(end), F.col("near").alias(f"near_{end}"))
    return edges.join(side("u"), [*keys, "u"]).join(side("v"), [*keys, "v"]).select(*keys, "u", "v", F.array_sort(F.array_distinct(F.concat(F.array("u", "v"), "near_u", "near_v"))).alias("members"))


def graph_summary(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nodes, edges, density, components, betti1, assortativity."""
    edges = written(edges, "edges")
    n = degrees(edges, keys)
    parts = components(edges, keys).groupBy(*keys).agg(F.countDistinct("component").alias("components"))
    ways = both_ways(edges, keys).join(n.select(*keys, F.col("node").alias("a"), F.col("degree").alias("da")), [*keys, "a"]).join(n.select(*keys, F.col("node").alias("b"), F.col("degree").alias("db")), [*keys, "b"])
    mixed = ways.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.sum(F.col("da") * F.col("db")).cast("double").alias("_xy"), F.sum("da").cast("double").alias("_x"), F.sum(F.col("da") * F.col("da")).cast("double").alias("_xx"))
    spread = F.col("_m") * F.col("_xx") - F.col("_x") * F.col("_x")
    counts = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes")).join(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges")), keys)
    return counts.join(parts, keys, "left").join(mixed, keys, "left").select(
        *keys, "nodes", "edges", (2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), "components", (F.col("edges") - F.col("nodes") + F.col("components")).alias("betti1"),
        F.when(spread > 0, (F.col("_m") * F.col("_xy") - F.col("_x") * F.col("_x")) / F.when(spread > 0, spread)).alias("assortativity"))


WORDS = 16  # long columns of a block of sources: 1,024 sources, a bit each


def _source_bits(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, block, word, bit: a place of its own for each node. Nodes are dealt to blocks by hash, about half a
    block each, and numbered inside; a block that gets too many goes on in further ones."""
    per = 64 * WORDS
    n = nodes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (per // 2)).alias("_b"))
    dealt = nodes.join(n, keys).withColumn("_d", F.pmod(F.xxhash64("node"), F.col("_b")))
    numbered = dealt.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_d").orderBy("node")) - 1)
    at = F.col("_r") % per
    return numbered.select(*keys, "node", (F.floor(F.col("_r") / per) * F.col("_b") + F.col("_d")).cast("long").alias("block"), F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _ranked(n: int, a: np.ndarray, b: np.ndarray, straight: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """Nodes 0 .. n - 1 by degree: each one's place, the edges a -> b (both ways) between places in order of b, and
    ``united(rows, by, out, room)``, which puts into ``out`` the rows of all neighbours of each place, united by the ufunc
    ``by``. The first, second .. neighbours of all nodes that have one are taken at once; of hubs those beyond ``straight``
    in a piece."""
    degree = np.bincount(b, minlength=n)
    place = np.empty(n, int)
    place[np.argsort(-degree, kind="stable")] = np.arange(n)
    a, b = place[a], place[b]
    order = np.argsort(b, kind="stable")
    a, b = a[order].astype(np.int32), b[order].astype(np.int32)
    degree = -np.sort(-degree)
    first = np.cumsum(degree) - degree
    nth = [a[first[degree > k] + k] for k in range(min(straight, int(degree[0])))]
    late = np.arange(len(a)) - first[b] >= straight
    la, lb = a[late], b[late]
    late = _starts(lb)

    def united(rows: np.ndarray, by: np.ufunc, out: np.ndarray, room: np.ndarray) -> None:
        out[:] = 0
        for from_ in nth:
            np.take(rows, from_, axis=0, out=room[: len(from_)], mode="clip")
            by(out[: len(from_)], room[: len(from_)], out=out[: len(from_)])
        if len(late):
            out[lb[late]] = by(out[lb[late]], by.reduceat(rows[la], late, axis=0))

    return place, a, b, united


def _hops(n: int, a: np.ndarray, b: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Numbers of pairs at 1, 2, .. hops from the sources; a -> b are the edges both ways between nodes 0 .. n - 1.

    A bit a source, as many words of them a node as take some 32 MB; fronts of few nodes take only those nodes' edges.
    """
    words = int(min(WORDS, max(1, (1 << 22) // n)))
    place, a, b, united = _ranked(n, a, b)
    sources = place[sources]
    seen, front, reached, room = (np.empty((n, words), np.uint64) for _ in range(4))
    counts: list[int] = []
    for i in range(0, len(sources), 64 * words):
        some = sources[i : i + 64 * words]
        bit = np.arange(len(some))
        seen[:] = 0
        seen[some, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        front[:] = seen
        hop = 0
        while True:
            active = front.any(1)
            if 8 * np.count_nonzero(active) < n:
                there = active[a]
                x, y = a[there], b[there]
                starts = _starts(y)
                y = y[starts]
                got = np.bitwise_or.reduceat(front[x], starts, axis=0) if len(x) else np.zeros((0, words), np.uint64)
                got &= ~seen[y]
                front[active] = 0
                front[y] = got
                seen[y] |= got
            else:
                united(front, np.bitwise_or, reached, room)
                np.bitwise_not(seen, out=front)
                front &= reached
                seen |= front
                got = front
            found = int(np.bitwise_count(got).sum())
            if not found:
                break
            if hop == len(counts):
                counts.append(0)
            counts[hop] += found
            hop += 1
    return np.array(counts, int)


def _small_distances(edges: DataFrame, sizes: DataFrame, keys: list[str], pairs: int = 1 << 30, turns: int = 16) -> DataFrame:
    """keys, hops, pairs: of graphs of bounded size (``sizes``: keys, _e edges, _n nodes); a task holds the edges of one graph
    and some of its nodes as sources. A graph goes to as many tasks as its edges times its nodes call for, at most ``turns``,
    so that its edges are sent that often and no more."""

    def search(g: pd.DataFrame) -> pd.DataFrame:
        is_edge = (g["u"] != g["v"]).to_numpy()
        e = g.loc[is_edge, ["u", "v"]].to_numpy()
        nodes, at = np.unique(e, return_inverse=True)
        u, v = at.reshape(-1, 2).T
        counts = _hops(len(nodes), np.r_[u, v], np.r_[v, u], np.searchsorted(nodes, g.loc[~is_edge, "u"].to_numpy()))
        return pd.DataFrame({**{k: [g[k].iloc[0]] * len(counts) for k in keys}, "hops": np.arange(1, len(counts) + 1), "pairs": counts})

    work = F.col("_e").cast("double") * F.col("_n")
    dealt = written(sizes.select(*keys, work.alias("_w"), F.least(F.lit(turns), F.ceil(work / pairs)).cast("long").alias("_turns")), "turns")
    total = dealt.agg(F.sum("_w"), F.sum("_turns")).first()
    n = max(1, min(4 * (total[1] or 0), max(int((total[0] or 0) // (pairs // 8)), 1)))
    near = edges.join(dealt.select(*keys, "_turns"), keys).select(*keys, "_turns", "u", "v")
    ends = near.select(*keys, "_turns", F.explode(F.array("u", "v")).alias("u")).distinct()
    # A source is a row that leads to itself, as no edge does; a null there would turn long numbers into floats.
    sources = ends.select(*keys, F.pmod(F.xxhash64("u"), F.col("_turns")).alias("_turn"), "u", F.col("u").alias("v"))
    rows = near.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_turns") - 1)).alias("_turn"), "u", "v").unionByName(sources).repartition(n, *keys, "_turn")
    return rows.groupBy(*keys, "_turn").applyInPandas(search, rows.select(*keys, *[F.lit(0).cast("long").alias(c) for c in ("hops", "pairs")]).schema)


def _large_distances(edges: DataFrame, bits: DataFrame, keys: list[str], blocks_at_once: int, levels: int) -> DataFrame:
    """As above by DataFrame rounds: a row holds the bits of a block that reached a node; rows meet the edges, and bits that
    arrive at a node are united by bit_or. ``levels`` rounds are planned at a time, then cut."""
    ways = cut(both_ways(edges, keys))
    words = [f"w{i}" for i in range(WORDS)]
    own = cut(bits.join(edges.select(*keys).distinct(), keys, "left_semi").select(*keys, "node", "block", *[F.when(F.col("word") == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)]))
    last = own.agg(F.max("block")).first()[0]
    counted = None
    for first in range(0, (-1 if last is None else last) + 1, blocks_at_once):
        seen = own.where(F.col("block").between(first, first + blocks_at_once - 1)).withColumn("hops", F.lit(0).cast("long"))
        seen = seen.withColumns({f"n{i}": F.col(w) for i, w in enumerate(words)})  # n: the bits that are new in this round
        hop, before = 0, None
        while True:
            for _ in range(levels):
                hop += 1
                moved = seen.where(F.col("hops") == hop - 1).select(*keys, F.col("node").alias("a"), "block", *[f"n{i}" for i in range(WORDS)]).join(ways, [*keys, "a"])
                arrived = moved.groupBy(*keys, F.col("b").alias("node"), "block").agg(*[F.bit_or(f"n{i}").alias(f"_a{i}") for i in range(WORDS)])
                both = seen.join(arrived, [*keys, "node", "block"], "full_outer")
                old = [F.coalesce(F.col(w), F.lit(0).cast("long")) for w in words]
                new = [F.coalesce(F.col(f"_a{i}"), F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(o)) for i, o in enumerate(old)]
                any_new = new[0]
                for x in new[1:]:
                    any_new = any_new.bitwiseOR(x)
                both = both.select(*keys, "node", "block", F.when(any_new != 0, F.lit(hop).cast("long")).otherwise(F.col("hops")).alias("hops"), *[o.bitwiseOR(x).alias(w) for o, x, w in zip(old, new, words)], *[F.when(any_new != 0, x).otherwise(F.col(f"n{i}")).alias(f"n{i}") for i, x in enumerate(new)], *[c for c in both.columns if c.startswith("h_")], F.when(any_new != 0, sum(F.bit_count(x) for x in new)).cast("long").alias(f"h_{hop}"))
                seen = both
            stood = seen = written(seen, "reached")
            if before is not None:
                removed(before)
            before = stood
            made = [c for c in seen.columns if c.startswith("h_")]
            part = seen.select(*keys, F.explode(F.array(*[F.struct(F.lit(int(c[2:])).cast("long").alias("hops"), F.col(c).alias("pairs")) for c in made])).alias("x")).select(*keys, "x.*").where("pairs is not null").groupBy(*keys, "hops").agg(F.sum("pairs").alias("pairs"))
            part = cut(part)
            counted = part if counted is None else counted.unionByName(part)
            seen = seen.drop(*made)
            if seen.where(F.col("hops") == hop).isEmpty():
                break
        removed(before)
    return counted if counted is not None else edges.select(*keys, F.lit(0).cast("long").alias("hops"), F.lit(0).cast("long").alias("pairs")).limit(0)


def distances(edges: DataFrame, keys: list[str], whole: int = WHOLE, blocks_at_once: int = 16, levels: int = 4, apart: int = 4_096) -> DataFrame:
    """keys, hops, pairs: ordered pairs of nodes at each number of hops from one another, from every node at once.

    Breadth-first search with a bit a source; a level unites the bits that arrive at a node. Pairs are counted by their
    bits, never listed. Graphs of up to ``whole`` edges are searched in tasks that hold the graph, some sources a task;
    larger ones by joins over all tasks, ``blocks_at_once`` blocks of 1,024 sources at a time, so rows stay under blocks x
    nodes. Paths may be of any length.

    No path leaves a component, so where a graph has over ``apart`` edges all are searched by components (small ones in
    bundles): a source then meets its own component only, and copies of a graph cost as much as the graph each.
    """
    e = written(edges.where("u <> v").select(*keys, "u", "v"), "edges")
    of = keys
    if not e.groupBy(*keys).agg(F.count(F.lit(1)).alias("_e")).where(F.col("_e") > apart).isEmpty():
        of, whole_graphs = [*keys, "_part"], e
        e = written(_in_parts(e, keys), "edges")
        removed(whole_graphs)
    nodes = e.select(*of, F.explode(F.array("u", "v")).alias("node")).distinct()
    size = cut(e.groupBy(*of).agg(F.count(F.lit(1)).alias("_e")).join(nodes.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")), of))
    some = lambda sizes: e.join(sizes.select(*of), of, "left_semi")
    little, large = size.where(F.col("_e") <= whole), size.where(F.col("_e") > whole)
    found, used = _small_distances(some(little), little, of).select(*keys, "hops", "pairs"), [e]
    if not large.isEmpty():
        bits = written(_source_bits(nodes.join(large.select(*of), of, "left_semi"), of), "bits")
        found, used = found.unionByName(_large_distances(some(large), bits, of, blocks_at_once, levels).select(*keys, "hops", "pairs")), [e, bits]
    counted = written(found.groupBy(*keys, "hops").agg(F.sum("pairs").alias("pairs")), "distances")
    removed(*used)
    return counted


def _in_parts(edges: DataFrame, keys: list[str], nodes: int = 512) -> DataFrame:
    """Edges with ``_part``: their component, or for components of under ``nodes`` nodes a bundle of about twice as many nodes."""
    parts = components(edges, keys)
    sizes = parts.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n"))
    bundles = sizes.where(F.col("_n") < nodes).groupBy(*keys).agg(F.ceil(F.sum("_n") / (2 * nodes)).alias("_b"))
    named = sizes.join(bundles, keys, "left").select(
        *keys, "component", F.when(F.col("_n") < nodes, F.concat(F.lit("bundle "), F.pmod(F.xxhash64("component"), F.col("_b")))).otherwise(F.concat(F.lit("component "), F.col("component"))).alias("_part"))
    of_node = parts.join(named, [*keys, "component"]).select(*keys, F.col("node").alias("u"), "_part")
    return edges.join(of_node, [*keys, "u"]).select(*keys, "_part", "u", "v")


def path_lengths(edges: DataFrame, keys: list[str], whole: int = WHOLE) -> DataFrame:
    """keys, mean_path, diameter over all connected pairs of different nodes."""
    d = distances(edges, keys, whole)
    return d.groupBy(*keys).agg((F.sum(F.col("hops") * F.col("pairs")) / F.sum("pairs")).alias("mean_path"), F.max("hops").alias("diameter"))


def _first_joins(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edges, taken in order, that join nodes not joined before."""
    parent, kept = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, int)


def spanning_forest(edges: DataFrame, keys: list[str], weight: str, whole: int = WHOLE) -> DataFrame:
    """keys, u, v, w of the minimum spanning forest (by weight, then ends). Graphs of up to ``whole`` edges take Kruskal's
    in bundles, a bundle a task; larger ones Boruvka's rounds over all graphs at once."""
    e = written(edges.where("u <> v").select(*keys, "u", "v", F.col(weight).alias("w")), "edges")
    little, large = bundled(e, keys, ("u", "v"), whole, "w")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["w", "u", "v"], kind="stable")
        nodes, _, a, b, _ = numbered(g, keys, ("u", "v"))
        return g.iloc[_first_joins(len(nodes), a, b)][[*keys, "u", "v", "w"]]

    done = None if little is None else written(little.groupBy("_bundle").applyInPandas(run, e.schema), "forest")
    if large is None:
        if done is None:
            return e.limit(0)
        removed(e)
        return done
    found = _boruvka(large, keys)
    return found if done is None else found.unionByName(done)


def _boruvka(edges: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`spanning_forest`, by rounds."""
    e = cut(edges)
    labels = cut(e.select(*keys, F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("c", F.col("node")))
    forest = None
    while True:
        left = e.join(labels.select(*keys, F.col("node").alias("u"), F.col("c").alias("cu")), [*keys, "u"]).join(labels.select(*keys, F.col("node").alias("v"), F.col("c").alias("cv")), [*keys, "v"]).where("cu <> cv")
        out = left.unionAll(left.select(*[F.col(c) for c in left.columns if c not in ("cu", "cv")], F.col("cv").alias("cu"), F.col("cu").alias("cv")))
        best = cut(out.groupBy(*keys, F.col("cu").alias("c")).agg(F.min(F.struct("w", "u", "v", F.col("cv").alias("to"))).alias("b")))
        if not best.limit(1).count():
            break
        chosen = best.select(*keys, "b.u", "b.v", "b.w").distinct()
        forest = chosen if forest is None else forest.unionAll(chosen).distinct()
        joined = components(best.select(*keys, F.col("c").alias("u"), F.col("b.to").alias("v")), keys)
        labels = cut(labels.join(joined.select(*keys, F.col("node").alias("c"), "component"), [*keys, "c"], "left").select(*keys, "node", F.coalesce("component", "c").alias("c")))
    return cut(forest) if forest is not None else e.limit(0)


def h0_persistence(edges: DataFrame, nodes: DataFrame, keys: list[str], weight: str, radius: float) -> DataFrame:
    """keys, max_death, death_std: finite deaths of the Rips filtration up to ``radius`` (0, 0 without any)."""
    f = spanning_forest(edges.where(F.col(weight) <= radius), keys, weight)
    deaths = f.groupBy(*keys).agg(F.max("w").alias("max_death"), F.stddev_pop("w").alias("death_std"))
    return nodes.select(*keys).distinct().join(deaths, keys, "left").fillna(0.0, ["max_death", "death_std"])


def _prim(points: np.ndarray) -> np.ndarray:
    """Edge lengths of minimum spanning trees of B sets of n points (B x n x 3), all sets a step at a time: B x (n - 1)."""
    sets, n = points.shape[:2]
    out, every, here = np.empty((sets, n - 1)), np.arange(sets), np.zeros(sets, int)
    best, outside = np.full((sets, n), np.inf), np.ones((sets, n), bool)
    for i in range(n - 1):
        outside[every, here] = False
        best = np.where(outside, np.minimum(best, np.linalg.norm(points - points[every, here][:, None], axis=2)), np.inf)
        here = best.argmin(axis=1)
        out[:, i] = best[every, here]
    return out


def centre_persistence(neighbours: DataFrame, keys: list[str], site: str, radius: float, coords: tuple[str, ...] = ("x", "y", "z"), fingerprints: DataFrame | None = None, whole: int = 64) -> DataFrame:
    """keys (of the centres), max_death, death_std: finite deaths of the Rips filtration of each centre's neighbours.

    neighbours: keys, site (unique in a centre), coords; points that are not finite join nothing. Edges up to ``radius`` take
    part; fewer than two neighbours give 0, 0. With ``fingerprints`` (keys, fingerprint, and n, the number of neighbours, which is
    counted where it is absent) a neighbourhood is computed once for each fingerprint, at its smallest centre, and joined back.
    Neighbourhoods of up to ``whole`` points are a row each and take a spanning tree there, those of one size of a batch together;
    larger ones find their edges by a range join inside the centre and their forests by rounds over all centres at once.
    """
    from facetry.operators.sites import range_join

    by, known = keys, neighbours.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if fingerprints is not None:
        by, known = ["fingerprint"], fingerprints if "n" in fingerprints.columns else fingerprints.join(known, keys)
        # A null key meets no neighbours, so it must not stand for others.
        known = known.select(*keys, "n", F.when(F.expr(" and ".join(f"`{k}` is not null" for k in keys)), F.col("fingerprint")).alias("fingerprint"))
    known = written(known, "centres")
    chosen = known.where("n > 1")
    if fingerprints is not None:
        first = chosen.where("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct(*keys)).alias("_r"), F.first("n").alias("n"))
        chosen = written(first.select("_r.*", "n", "fingerprint"), "chosen")
    asked = neighbours.select(*keys, F.col(site).alias("_s"), *[F.col(c).cast("double").alias(c) for c in coords])
    asked = asked.where(" and ".join(f"abs({c}) < double('infinity')" for c in coords))
    few = asked.join(chosen.where(F.col("n") <= whole).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.array(*coords)).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_p")
            size, points = lists.value_lengths().to_numpy(), lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(coords))
            start, most, spread = np.cumsum(size) - size, np.zeros(len(b)), np.zeros(len(b))
            for n in np.unique(size[size > 1]):
                at = np.flatnonzero(size == n)
                d = _prim(points[start[at][:, None] + np.arange(n)])
                near = d <= radius
                at, d, near = (x[near.any(axis=1)] for x in (at, d, near))
                most[at], spread[at] = d.max(axis=1, where=near, initial=0.0), d.std(axis=1, where=near)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(most), pa.array(spread)], names=[*keys, "max_death", "death_std"])

    found = few.mapInArrow(run, few.select(*keys, F.lit(0.0).alias("max_death"), F.lit(0.0).alias("death_std")).schema)
    many = chosen.where(F.col("n") > whole)
    if not many.isEmpty():
        own = {k: f"_k{i}" for i, k in enumerate(keys)}  # range_join has columns of its own
        pairs = range_join(asked.join(many.select(*keys), keys, "left_semi").withColumnsRenamed(own), radius, [*own.values()], "_s", coords).where("center < nbr")
        pairs = pairs.select(*[F.col(v).alias(k) for k, v in own.items()], F.col("center").alias("u"), F.col("nbr").alias("v"), "distance")
        forest = spanning_forest(pairs, keys, "distance")
        found = found.unionByName(forest.groupBy(*keys).agg(F.max("w").alias("max_death"), F.stddev_pop("w").alias("death_std")))
    if fingerprints is not None:
        found = written(found.join(chosen.select(*keys, "fingerprint"), keys).select("fingerprint", "max_death", "death_std"), "deaths")
    return known.join(found, by, "left").select(*keys, "max_death", "death_std").fillna(0.0, ["max_death", "death_std"])


def spectral_entropy(edges: DataFrame, keys: list[str], dense: int = 2000, probes: int = 16, steps: int = 40, seed: int = 17, whole: int = WHOLE) -> DataFrame:
    """keys, spectral_entropy (bits) of the combinatorial Laplacian's spectrum.

    With T the sum of degrees, it is log2 T less the sum of v log2 v over all eigenvalues v, divided by T; that sum adds up
    over connected components, which are solved apart. Components of up to ``dense`` nodes take a dense solve in a task.
    Larger ones take stochastic Lanczos quadrature: ``probes`` vectors of random signs, ``steps`` multiplications; those of
    up to ``whole`` edges in a task, others by joins with the edges. Their part is then an estimate; its standard error is
    about its spread over the probes by the root of their number (for n nodes in the order of 1 / sqrt(n * probes) of the part).
    """
    whole_graphs = written(edges.where("u <> v").select(*keys, "u", "v"), "edges")
    parts = components(whole_graphs, keys).select(*keys, F.col("node").alias("u"), "component")
    e = written(whole_graphs.join(parts, [*keys, "u"]), "edges")
    removed(whole_graphs)
    of = [*keys, "component"]
    sizes = cut(parts.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")).join(e.groupBy(*of).agg(F.count(F.lit(1)).alias("_e")), of))
    small_, large = F.col("_n") <= dense, (F.col("_n") > dense) & (F.col("_e") > whole)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(g[["u", "v"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        if len(nodes) > dense:
            signs = np.empty(len(nodes), int)
            signs[at] = g[["_signs_u", "_signs_v"]].to_numpy()
            s = _lanczos(len(nodes), np.r_[at[:, 0], at[:, 1]], np.r_[at[:, 1], at[:, 0]], signs, probes, steps)
        else:
            laplacian = np.zeros((len(nodes), len(nodes)))
            np.add.at(laplacian, (at[:, 0], at[:, 1]), -1.0)
            np.add.at(laplacian, (at[:, 1], at[:, 0]), -1.0)
            np.fill_diagonal(laplacian, 0)
            np.fill_diagonal(laplacian, -laplacian.sum(1))
            values = np.linalg.eigvalsh(laplacian)
            values = values[values > 1e-12]
            s = float((values * np.log2(values)).sum())
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "s": [s]})

    # Tasks are of as many components as make about a second: a dense solve of n nodes takes some n^3 steps.
    work = F.when(small_, F.pow("_n", F.lit(3))).otherwise(F.lit(32.0 * probes * steps) * F.col("_e"))
    n = sizes.where(~large).agg(F.sum(work), F.count(F.lit(1))).first()
    n = max(1, min(4 * n[1], int((n[0] or 0) // 2e9) + 1))
    signed = lambda end: sum((F.call_function("shiftleft", F.pmod(F.xxhash64(F.lit(seed), F.lit(p), end), F.lit(2)), F.lit(p)) for p in range(1, probes)), F.pmod(F.xxhash64(F.lit(seed), F.lit(0), end), F.lit(2)))
    held = e.join(sizes.where(~large).select(*of, "_n"), of)
    held = held.select(*of, "u", "v", *[F.when(F.col("_n") > dense, signed(end)).otherwise(0).alias(f"_signs_{end}") for end in "uv"]).repartition(n, *of)
    sums = held.groupBy(*of).applyInPandas(solve, e.select(*keys, F.lit(0.0).alias("s")).schema)
    large = sizes.where(large).drop("_e")
    if not large.isEmpty():
        sums = sums.unionByName(_lanczos_sums(e.join(large.select(*of), of, "left_semi"), large, keys, probes, steps, seed))
    degrees_ = e.groupBy(*keys).agg((2.0 * F.count(F.lit(1))).alias("_t"))
    return degrees_.join(sums.groupBy(*keys).agg(F.sum("s").alias("_s")), keys).select(*keys, (F.log2("_t") - F.col("_s") / F.col("_t")).alias("spectral_entropy"))


def _quadrature(alpha: np.ndarray, beta: np.ndarray, n: int) -> float:
    """The estimate of the sum of v log2 v over n eigenvalues from the coefficients (steps x probes)."""
    out = []
    for p in range(alpha.shape[1]):
        ends = np.flatnonzero(beta[:, p] <= 1e-9)
        m = int(ends[0]) + 1 if len(ends) else len(alpha)
        values, vectors = np.linalg.eigh(np.diag(alpha[:m, p]) + np.diag(beta[: m - 1, p], 1) + np.diag(beta[: m - 1, p], -1))
        good = values > 1e-9
        out.append(float((vectors[0, good] ** 2 * values[good] * np.log2(values[good])).sum()))
    return float(n * np.mean(out))


def _lanczos(n: int, a: np.ndarray, b: np.ndarray, signs: np.ndarray, probes: int, steps: int) -> float:
    """As :func:`_lanczos_sums` for one component; a -> b are its edges both ways, ``signs`` a bit a probe of each node. As
    many probes go together as take some 32 MB a vector."""
    place, _, to, united = _ranked(n, a, b)
    bits, degree = np.empty(n, int), np.bincount(to, minlength=n)[:, None].astype(float)
    bits[place] = signs
    together = max(1, (1 << 22) // n)
    alpha, beta = np.zeros((steps, probes)), np.zeros((steps, probes))
    for first in range(0, probes, together):
        some = np.arange(first, min(probes, first + together))
        v = ((bits[:, None] >> some & 1) * 2 - 1) / np.sqrt(n)
        before, y, room, last = np.zeros_like(v), np.empty_like(v), np.empty_like(v), 0.0
        for step in range(steps):
            united(v, np.add, y, room)
            w = degree * v - y
            w -= last * before
            alpha[step, some] = now = np.einsum("ij,ij->j", v, w)
            # The rest after taking off alpha v has the squared length |w|^2 - alpha^2, as v has length 1.
            beta[step, some] = last = np.sqrt(np.maximum(np.einsum("ij,ij->j", w, w) - now * now, 0.0))
            w -= now * v
            before, v = v, np.divide(w, last, out=np.zeros_like(w), where=np.broadcast_to(last > 1e-9, w.shape))
    return _quadrature(alpha, beta, n)


def _lanczos_sums(edges: DataFrame, sizes: DataFrame, keys: list[str], probes: int, steps: int, seed: int) -> DataFrame:
    """keys, s: estimates of the sum of v log2 v over the eigenvalues of each component."""
    of, each = [*keys, "component"], range(probes)
    ways = written(both_ways(edges, of), "ways")
    nodes = ways.groupBy(*of, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("deg")).join(sizes, of)
    sign = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(p), "node"), F.lit(2)) * 2 - 1) / F.sqrt("_n") for p in each]
    zero = F.array(*[F.lit(0.0)] * probes)
    state = written(nodes.select(*of, "node", "deg", F.array(*sign).alias("v"), zero.alias("before"), zero.alias("beta")), "lanczos")
    told = None
    for step in range(steps):
        near = state.select(*of, F.col("node").alias("b"), "v").join(ways, [*of, "b"]).groupBy(*of, F.col("a").alias("node")).agg(F.array(*[F.sum(F.col("v")[p]) for p in each]).alias("y"))
        w = F.array(*[F.col("deg") * F.col("v")[p] - F.col("y")[p] - F.col("beta")[p] * F.col("before")[p] for p in each])
        moved = written(state.join(near, [*of, "node"]).select(*of, "node", "deg", "v", w.alias("w")), "lanczos")
        # The rest after taking off alpha v has the squared length |w|^2 - alpha^2, as v has length 1.
        facts = moved.groupBy(*of).agg(F.array(*[F.sum(F.col("v")[p] * F.col("w")[p]) for p in each]).alias("alpha"), F.array(*[F.sum(F.col("w")[p] * F.col("w")[p]) for p in each]).alias("q"))
        beta = F.zip_with("alpha", "q", lambda a, q: F.sqrt(F.greatest(q - a * a, F.lit(0.0))))
        facts = written(facts.select(*of, F.lit(step).alias("step"), "alpha", beta.alias("beta")), "coefficients")
        told = facts if told is None else told.unionByName(facts)
        rest = F.array(*[F.when(F.col("beta")[p] > 1e-9, (F.col("w")[p] - F.col("alpha")[p] * F.col("v")[p]) / F.col("beta")[p]).otherwise(0.0) for p in each])
        following = written(moved.join(small(facts, sizes.count()), of).select(*of, "node", "deg", rest.alias("next"), F.col("v").alias("before"), "beta").withColumnRenamed("next", "v"), "lanczos")
        removed(state, moved)
        state = following

    def quadrature(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step")
        s = _quadrature(np.stack(g["alpha"].to_list()), np.stack(g["beta"].to_list()), g["_n"].iloc[0])
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "s": [s]})

    met = told.join(sizes, of)
    return met.groupBy(*of).applyInPandas(quadrature, edges.select(*keys, F.lit(0.0).alias("s")).schema)


def md5_in_order(rows: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """keys and ``name``: the md5 of a key's texts in order, joined by commas. Spark sorts the rows, which are hashed as
    they pass, so no key's texts are held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(key, digest):
            return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, types)], pa.array([digest.hexdigest()])], names=[*keys, name])

        now = digest = types = None
        for b in batches:
            types = [c.type for c in b.columns[:-1]]
            for *key, x in zip(*[c.to_pylist() for c in b.columns]):
                if digest is None or key != now:
                    if digest is not None:
                        yield given(now, digest)
                    now, digest = key, hashlib.md5(x.encode())
                else:
                    digest.update(b"," + x.encode())
        if digest is not None:
            yield given(now, digest)

    ordered = rows.select(*keys, text).repartition(*keys).sortWithinPartitions(*keys, text)
    return ordered.mapInArrow(run, rows.select(*keys, F.lit("").alias(name)).schema)


def wl_hash(edges: DataFrame, nodes: DataFrame, keys: list[str], label: str, rounds: int = 3) -> DataFrame:
    """keys, wl_hash (32 hex digits): equal for relabelled graphs. A node's label is hashed with all its neighbours' labels
    in order (a row of 32 bytes a neighbour), a graph's hash is of all its labels and their counts in order."""
    ways = written(both_ways(edges, keys), "ways")
    now = nodes.select(*keys, "node", F.md5(F.col(label).cast("string")).alias("l"))
    history = now
    for i in range(rounds):
        near = ways.join(now.select(*keys, F.col("node").alias("b"), "l"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("l")), ",").alias("near"))
        now = cut(now.join(near, [*keys, "node"], "left").select(*keys, "node", F.md5(F.concat_ws("|", "l", F.coalesce("near", F.lit("")))).alias("l")))
        history = history.unionAll(now)
    histogram = history.groupBy(*keys, "l").agg(F.count(F.lit(1)).alias("c"))
    return md5_in_order(histogram.select(*keys, F.concat_ws(":", "l", F.col("c").cast("string")).alias("_m")), keys, "_m", "wl_hash")


def scatter_sum(edges: DataFrame, keys: list[str], feature: str, n: int) -> DataFrame:
    """keys, node, sum array<double>: edge feature vectors summed onto both ends."""
    ends = edges.select(*keys, F.explode(F.array("u", "v")).alias("node"), feature)
    sums = ends.groupBy(*keys, "node").agg(*[F.sum(F.col(feature)[i]).alias(f"s{i}") for i in range(n)])
    return sums.select(*keys, "node", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("sum"))


def pooled(nodes: DataFrame, keys: list[str], feature: str, n: int) -> DataFrame:
    """keys, mean array<double> of the node vectors of each graph."""
    m = nodes.groupBy(*keys).agg(*[F.avg(F.col(feature)[i]).alias(f"s{i}") for i in range(n)])
    return m.select(*keys, F.array(*[F.col(f"s{i}") for i in range(n)]).alias("mean"))


def gathered(edges: DataFrame, nodes: DataFrame, keys: list[str], feature: str, extra: Column, distance2: Column) -> DataFrame:
    """keys, u, v, gathered: [x_u, x_v, edge features, squared distance] of each edge."""
    side = lambda end: nodes.select(*keys, F.col("node").alias(end), F.col(feature).alias(f"_{end}"))
    both = edges.join(side("u"), [*keys, "u"]).join(side("v"), [*keys, "v"])
    return both.select(*keys, "u", "v", F.concat("_u", "_v", extra, F.array(distance2)).alias("gathered"))


def top_nodes(nodes: DataFrame, keys: list[str], score: str, ratio: float) -> DataFrame:
    """The ceil(ratio * n) nodes of each graph with the highest score, with gate = score."""
    ranked = nodes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), "node")))
    n = nodes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * ratio).alias("_n"))
    return ranked.join(n, keys).where("_r <= _n").drop("_r", "_n")


def random_nodes(nodes: DataFrame, keys: list[str], rate: float, seed: int) -> DataFrame:
    """Exactly int(rate * n) nodes of each graph, by the md5 of seed and node."""
    ranked = nodes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string"))), "node")))
    n = nodes.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * rate).alias("_n"))
    return ranked.join(n, keys).where("_r <= _n").drop("_r", "_n")


def node_offsets(graphs: DataFrame, order: str, size: str) -> DataFrame:
    """Offset of each graph's nodes when graphs are concatenated in order: one row a graph, so one window."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return graphs.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
