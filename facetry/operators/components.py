"""Connected components of an edge table by star contraction.

Each round points every node at the smallest neighbour label and then at that label's own label, so
the number of rounds grows with the logarithm of the longest chain. Each round is written to the shared
folder and the one before removed; only a count and a sum of hashes reach the driver.

A node's smallest neighbour is a grouped minimum, combined before the shuffle. It meets the node's edges by a
join; the edges of hubs (more than 1,000 and more than 1 in 50,000 of all, so at most 50,000 nodes) stay where
they are and meet a broadcast instead, so no task receives a hub.

Rounds shuffle all edges several times each. Where ``keys`` part the edges into graphs, those of bounded size go to tasks in
bundles of bounded size and are searched there, so their edges are shuffled once; only larger graphs take rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegralType, StringType

from facetry.session import cut, removed, spread_join, written

HUB, HUBS = 1_000, 50_000
WHOLE, BUNDLE = 1_000_000, 250_000


def with_least(edges: DataFrame, least: DataFrame, keys: list[str], rows: int, node: str = "a") -> DataFrame:
    """Edges with the columns of their node in ``least`` (keys, node, .., n: its number of edges); ``rows``: edges in all, at most."""
    if rows <= HUB:
        return edges.join(least.drop("n"), [*keys, node])
    return spread_join(edges, least, [*keys, node], "n", max(HUB, rows // HUBS)).drop("n")


def bundled(edges: DataFrame, keys: list[str], ends: tuple[str, str], whole: int, odd: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """``edges`` in two parts, None where there are none: the graphs (by keys) of up to ``whole`` edges with ``_bundle``, whose
    groups hold whole graphs, about ``BUNDLE`` edges or one graph each; and the other edges. Graphs with a null in ``odd``, and
    nodes or keys that are neither numbers nor texts nor the like, are among the others. Edges without a key join none."""
    kinds = {f.name: f.dataType for f in edges.schema}
    if not keys or not all(isinstance(kinds[c], (IntegralType, StringType)) for c in ends) or not all(isinstance(kinds[k], AtomicType) for k in keys):
        return None, edges
    size = cut(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_e"), F.sum(F.isnull(odd).cast("long") if odd else F.lit(0)).alias("_odd")))
    fits = (F.col("_e") <= whole) & (F.col("_odd") == 0)
    total = size.agg(F.sum(F.when(fits, F.col("_e"))), F.sum(F.when(~fits, F.col("_e")))).first()
    n = max(1, -(-(total[0] or 0) // BUNDLE))
    some = lambda which: edges.join(size.where(which).select(*keys), keys, "left_semi")
    return some(fits).withColumn("_bundle", F.pmod(F.xxhash64(*keys), F.lit(n))) if total[0] else None, some(~fits) if total[1] else None


def numbered(rows: pd.DataFrame, keys: list[str], ends: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of edges of several graphs: each node's value, a row of its graph, and the two ends as numbers of nodes; numbers
    follow the nodes' order. The last array numbers the rows' graphs."""
    graph = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    values, at = np.unique(np.concatenate([rows[c].to_numpy() for c in ends]), return_inverse=True)
    both, at = np.unique(np.tile(graph, 2) * len(values) + at, return_inverse=True)
    first = np.unique(graph, return_index=True)[1]
    return values[both % len(values)], first[both // len(values)], at[: len(rows)], at[len(rows):], graph


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes: roots are hooked to smaller ones that an edge joins them to."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _searched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component of the graphs in bundles."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        nodes, of, a, b, _ = numbered(g, keys, ("a", "b"))
        return g[keys].iloc[of].reset_index(drop=True).assign(node=nodes, component=nodes[_least(len(nodes), a, b)])

    return rows.groupBy("_bundle").applyInPandas(run, rows.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).schema)


def components(edges: DataFrame, keys: list[str] | None = None, u: str = "u", v: str = "v", whole: int = WHOLE) -> DataFrame:
    """(keys..., node, component): component is the smallest node reachable. Nodes without edges are absent.

    Graphs of up to ``whole`` edges are searched in bundles, a bundle a task. Others by large-star / small-star rounds:
    in every round each node links its larger neighbours to its smallest one, then its smaller ones and itself; ends
    when no edge changes. A null end is dropped.
    """
    keys = keys or []
    now = written(edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
              .select(*keys, F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(), "edges")
    little, large = bundled(now, keys, ("a", "b"), whole)
    done = None if little is None else written(_searched(little, keys), "components")
    if done is not None:
        if large is None:
            removed(now)
            return done
        rest = written(large, "edges")
        removed(now)
        now = rest
    found = _contracted(now, keys)
    return found if done is None else found.unionByName(done)


def _contracted(now: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component of ``written`` edges (keys, a, b; a > b) by rounds."""
    before, rows = None, now.count()
    while True:
        both = now.unionAll(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(*keys, "a", F.least("a", "m").alias("m"), "n")
        large = with_least(both.where("b > a"), least, keys, 2 * rows).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            with_least(large, low, keys, 2 * rows)
            .select(*keys, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select(*keys, "e.a", "e.b").where("a <> b").distinct()
        )
        after = written(small, "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        removed(now)
        now, rows = after, seen[0]
        if seen == before:
            break
        before = seen
    star = now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.unionAll(roots)
