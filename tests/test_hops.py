"""Path lengths of graphs that tasks search whole, some sources a task."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from facetry.operators import graphs as gr


def brute(pairs):
    nodes, at = np.unique(np.array(pairs), return_inverse=True)
    near = np.zeros((len(nodes), len(nodes)), np.float32)
    near[tuple(at.reshape(-1, 2).T)] = 1
    near = near + near.T > 0
    seen, out, hop = np.eye(len(nodes), dtype=bool), Counter(), 0
    while True:
        hop, new = hop + 1, (seen.astype(np.float32) @ near > 0) & ~seen
        if not new.any():
            return out
        out[hop], seen = int(new.sum()), seen | new


def made(spark, pairs):
    return spark.createDataFrame(sorted({("m", min(p), max(p)) for p in pairs if p[0] != p[1]}), "material string, u long, v long")


def test_one_component_of_many_edges_needs_no_rounds(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(gr, "_large_distances", refused)
    u, v = np.random.default_rng(3).integers(0, 420, (2, 90_000))
    e = made(spark, [*zip(u.tolist(), v.tolist()), *((420 + i, 419 + i) for i in range(5))])
    assert e.count() > 50_000
    got = {r["hops"]: r["pairs"] for r in gr.distances(e, ["material"]).collect()}
    assert got == brute([(r["u"], r["v"]) for r in e.collect()])


def test_long_ids_stay_apart(spark):
    e = made(spark, [((1 << 60) + i, (1 << 60) + i + 1) for i in range(9)])
    assert {r["hops"]: r["pairs"] for r in gr.distances(e, ["material"]).collect()} == {h: 2 * (10 - h) for h in range(1, 10)}


def test_sources_of_a_graph_are_dealt_to_tasks(spark):
    u, v = np.random.default_rng(4).integers(0, 3000, (2, 5000))
    e = made(spark, [*zip(u.tolist(), v.tolist()), *((7, i) for i in range(200))])
    pairs = [(r["u"], r["v"]) for r in e.collect()]
    sizes = spark.createDataFrame([("m", len(pairs), len(set(sum(pairs, ()))))], "material string, _e long, _n long")
    found = gr._small_distances(e, sizes, ["material"], pairs=1 << 20, turns=5)
    assert found.groupBy("hops").count().where("hops = 1").first()["count"] == 5
    assert {r["hops"]: r["p"] for r in found.groupBy("hops").agg(F.sum("pairs").alias("p")).collect()} == brute(pairs)
