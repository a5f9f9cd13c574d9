"""Optimal pairing, per-centre persistence, bit-parallel distances and hubs, against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import components as cm
from facetry.operators import graphs as gr
from facetry.operators import matching as mt

SIDE = "material string, site int, fingerprint string, element string, pos array<double>, cell array<double>"
BOX = [10.0, 0.0, 0.0, 0.0, 8.0, 0.0, 0.0, 0.0, 6.0]
SKEW = [10.0, 0.0, 0.0, 4.0, 8.0, 0.0, 1.0, 2.0, 6.0]


def distance(p, q, cell):
    d = np.subtract(p, q)
    return float(np.linalg.norm((d - np.round(d)) @ np.array(cell).reshape(3, 3) if cell else d))


def check(spark, groups, within=1e-5, **options):
    """groups: name -> (cell, left positions, right positions). The sum of distances of every group is the least."""
    left = [(n, i, "f", "C", list(map(float, p)), c) for n, (c, a, _) in groups.items() for i, p in enumerate(a)]
    right = [(n, 100 + i, "f", "C", list(map(float, p)), None) for n, (_, _, b) in groups.items() for i, p in enumerate(b)]
    rows = mt.match_orderings(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE).drop("cell"), ["material"], **options).collect()
    for n, (c, a, b) in groups.items():
        own = [r for r in rows if r["material"] == n]
        assert {r["status"] for r in own} == {"matched"} and len(own) == len(a)
        assert sorted(r["left_site"] for r in own) == list(range(len(a))) and sorted(r["right_site"] for r in own) == [100 + i for i in range(len(a))]
        assert all(math.isclose(r["distance"], distance(a[r["left_site"]], b[r["right_site"] - 100], c), abs_tol=1e-9) for r in own)
        cost = [[distance(p, q, c) for q in b] for p in a]
        least = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(a))))
        assert math.isclose(sum(r["distance"] for r in own), least, abs_tol=within)


def random_groups(n, kind):
    rng = np.random.default_rng(n)
    out = {}
    for k in range(4):
        a = rng.random((n, 3)).round(2 if k == 0 else 9)
        b = a[rng.permutation(n)] + rng.normal(0, (0.01, 0.05, 0.3, 0.0)[k], (n, 3))
        out[f"g{k}"] = ({"box": BOX, "skew": SKEW, "plain": None}[kind], a.tolist(), b.tolist())
    return out


@pytest.mark.parametrize("kind", ["box", "skew", "plain"])
def test_pairing_of_whole_groups_is_optimal(spark, kind):
    check(spark, random_groups(7, kind))


@pytest.mark.parametrize("kind", ["box", "skew", "plain"])
def test_pairing_by_components_is_optimal(spark, kind):
    check(spark, random_groups(6, kind), whole=0)


def test_pairing_by_auction_is_optimal(spark):
    groups = random_groups(5, "box")
    check(spark, {k: groups[k] for k in ("g1", "g2")}, within=5e-2, whole=0, most=1, step=1e-2)


def test_symmetric_ties_pair_fully(spark):
    """Corners of a square turned by an eighth: every corner has two nearest ones, and greedy choices may end badly."""
    a = [(x, y, 0) for x in (0.0, 1.0) for y in (0.0, 1.0)]
    b = [(0.5, -0.2, 0), (0.5, 1.2, 0), (-0.2, 0.5, 0), (1.2, 0.5, 0)]
    line = {"chain": (None, [(float(i), 0, 0) for i in range(6)], [(i + 0.6, 0, 0) for i in range(6)]), "square": (None, a, b)}
    check(spark, line)
    check(spark, line, whole=0)


def test_unequal_groups_and_rows_without_position_stay_apart(spark):
    left = spark.createDataFrame([("m", 0, "f", "C", [0.0, 0.0, 0.0], None), ("m", 1, "f", "C", [1.0, 0.0, 0.0], None), ("m", 2, "g", "O", [5.0, 0.0, 0.0], None), ("m", 3, "h", "O", None, None), ("m", 4, None, "O", [0.0, 0.0, 0.0], None)], SIDE)
    right = spark.createDataFrame([("m", 7, "f", "C", [1.01, 0.0, 0.0], None), ("m", 8, "f", "N", [0.3, 0.0, 0.0], None), ("m", 9, "g", "O", [5.0, 0.0, 0.0], None), ("m", 10, "g", "O", [6.0, 0.0, 0.0], None), ("m", 11, None, "O", [0.0, 0.0, 0.0], None)], SIDE).drop("cell")
    rows = {(r["left_site"], r["right_site"]): r for r in mt.match_orderings(left, right, ["material"]).collect()}
    assert not rows[1, 7]["far"] and rows[0, 8]["far"] and rows[1, 7]["same_element"] and not rows[0, 8]["same_element"]
    assert {k for k, r in rows.items() if r["status"] == "left_only"} == {(2, None), (3, None), (4, None)}
    assert {k for k, r in rows.items() if r["status"] == "right_only"} == {(None, 9), (None, 10), (None, 11)}
    assert mt.match_orderings(left.limit(0), right.limit(0), ["material"]).count() == 0


@pytest.mark.parametrize("whole", [64, 0])
def test_tied_orderings_are_matched_to_the_end(spark, whole):
    """Equal positions, and positions that move together, leave no site of equal groups open."""
    tied = [("m", i, "f", "C", [1.0, 0.0, 0.0], None) for i in range(30)] + [("m", 100 + i, "g", "C", [float(i // 3), 0.0, 0.0], None) for i in range(30)]
    left = spark.createDataFrame(tied, SIDE)
    right = left.drop("cell").withColumn("site", F.col("site") + 1000).withColumn("pos", F.array(F.col("pos")[0] + 0.01, F.lit(0.0), F.lit(0.0)))
    rows = mt.match_orderings(left, right, ["material"], whole=whole).collect()
    assert len(rows) == 60 and {r["status"] for r in rows} == {"matched"}
    assert all(math.isclose(r["distance"], 0.01, abs_tol=1e-9) for r in rows)


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        for _ in range(20):
            cost = rng.integers(0, 6, (n, n)).astype(float)
            cost[rng.random((n, n)) < 0.3] = np.inf
            least = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))
            columns, u, v = mt.assignment(cost)
            if np.isinf(least):
                assert (columns == -1).all()
            else:
                assert math.isclose(cost[np.arange(n), columns].sum(), least) and math.isclose(u.sum() + v.sum(), least)
                assert (u[:, None] + v[None, :] <= cost + 1e-9).all()


def test_persistence_of_centres(spark):
    rng = random.Random(2)
    rows = [(c, i, rng.random() * 9, rng.random() * 9, rng.random()) for c in range(12) for i in range(rng.choice([1, 2, 5, 9]))]
    rows += [(50, i, *rows_of) for i, rows_of in enumerate([r[2:] for r in rows if r[0] == 3])]  # the same bag again
    df = spark.createDataFrame(rows, "center int, site int, x double, y double, z double")
    want = {}
    for c in {r[0] for r in rows}:
        pts = [r[2:] for r in rows if r[0] == c]
        label, deaths = list(range(len(pts))), []
        for d, i, j in sorted((math.dist(pts[i], pts[j]), i, j) for i in range(len(pts)) for j in range(i)):
            if d <= 4.0 and label[i] != label[j]:
                deaths.append(d)
                label = [label[j] if x == label[i] else x for x in label]
        want[c] = (max(deaths, default=0.0), float(np.std(deaths)) if deaths else 0.0)
    prints = df.groupBy("center").agg(F.sum(F.xxhash64("x", "y", "z").cast("decimal(38,0)")).cast("string").alias("fingerprint"))
    for options in ({}, {"whole": 1}, {"fingerprints": prints}):
        got = {r["center"]: (r["max_death"], r["death_std"]) for r in gr.centre_persistence(df, ["center"], "site", 4.0, **options).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)


def test_persistence_of_null_centres_and_points(spark):
    """A centre without a key has no deaths and stands for no other; a point that is not finite joins nothing."""
    inf, nan = math.inf, math.nan
    rows = [(c, i, float(3 * i), 0.0, 0.0) for c in (None, 4, 5) for i in range(3)] + [(6, 0, 0.0, 0.0, 0.0), (6, 1, 2.0, 0.0, 0.0), (6, 2, None, 0.0, 0.0), (6, 3, nan, 0.0, 0.0), (6, 4, inf, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "center int, site int, x double, y double, z double")
    prints = df.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y", "z").cast("decimal(38,0)")).cast("string").alias("fingerprint"))
    for options in ({}, {"whole": 1}, {"fingerprints": prints}, {"fingerprints": prints.drop("n")}):
        got = {r["center"]: (r["max_death"], r["death_std"]) for r in gr.centre_persistence(df, ["center"], "site", 4.0, **options).collect()}
        assert got.pop(None, (0.0, 0.0)) == (0.0, 0.0) and got == {4: (3.0, 0.0), 5: (3.0, 0.0), 6: (2.0, 0.0)}


def test_spanning_trees_of_many_sets_at_once():
    rng = np.random.default_rng(3)
    for n in (2, 3, 9, 40):
        points = rng.random((50, n, 3))
        for one, got in zip(points, gr._prim(points)):
            pairs = sorted((math.dist(one[i], one[j]), i, j) for i in range(n) for j in range(i))
            kept = gr._first_joins(n, *np.array([p[1:] for p in pairs]).T)
            assert np.allclose(sorted(got), [pairs[i][0] for i in kept])


def brute_distances(pairs):
    near = {}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = Counter()
    for s in near:
        seen, front, hops = {s}, [s], 0
        while front:
            hops += 1
            front = list({y for x in front for y in near[x]} - seen)
            seen.update(front)
            if front:
                out[hops] += len(front)
    return out


def test_distances_of_long_chains_and_random_graphs(spark):
    rng = random.Random(9)
    graphs = {"chain": [(i, i + 1) for i in range(999)], "loose": [(rng.randrange(900), rng.randrange(900)) for _ in range(900)], "star": [(0, i) for i in range(1, 1500)]}
    e = spark.createDataFrame([(g, min(p), max(p)) for g, ps in graphs.items() for p in set(map(tuple, map(sorted, ps)))], "material string, u int, v int")
    got = {}
    for r in gr.distances(e, ["material"]).collect():
        got.setdefault(r["material"], Counter())[r["hops"]] = r["pairs"]
    assert got == {g: brute_distances(ps) for g, ps in graphs.items()}
    row = gr.path_lengths(e.where("material = 'chain'"), ["material"]).first()
    assert row["diameter"] == 999 and math.isclose(row["mean_path"], 1001 / 3)


def test_distances_by_rounds(spark):
    rng = random.Random(4)
    graphs = {"chain": [(i, i + 1) for i in range(9)], "loose": [(rng.randrange(700), rng.randrange(700)) for _ in range(1400)]}
    e = spark.createDataFrame([(g, min(p), max(p)) for g, ps in graphs.items() for p in set(map(tuple, map(sorted, ps)))], "material string, u int, v int")
    got = {}
    for r in gr.distances(e, ["material"], whole=0, blocks_at_once=1).collect():
        got.setdefault(r["material"], Counter())[r["hops"]] = r["pairs"]
    assert got == {g: brute_distances(ps) for g, ps in graphs.items()}


def test_components_of_hubs(spark):
    """A star, a star of stars and a chain; the hub's edges meet a broadcast."""
    star = spark.range(1, 6000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    more = spark.range(0, 4000).select((F.lit(10_000) + F.col("id") % 3).alias("u"), (F.col("id") + 20_000).alias("v"))
    link = spark.createDataFrame([(10_000, 10_001), (10_001, 10_002), (90_000, 90_001), (90_001, 90_002)], "u long, v long")
    got = {r["node"]: r["component"] for r in cm.components(star.unionAll(more).unionAll(link)).collect()}
    assert len(got) == 6000 + 4003 + 3
    assert all(got[i] == 0 for i in range(6000)) and all(got[i] == 10_000 for i in range(20_000, 24_000)) and got[90_002] == 90_000


def test_spectral_entropy_by_components_and_by_lanczos(spark):
    rng = random.Random(1)
    pairs = {(i, (i + 1) % 60) for i in range(60)} | {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(100, 101), (101, 102), (200, 201)}
    e = spark.createDataFrame([("m", min(p), max(p)) for p in {tuple(sorted(p)) for p in pairs}], "material string, u int, v int")
    edges = np.array([(r["u"], r["v"]) for r in e.collect()])
    nodes, at = np.unique(edges, return_inverse=True)
    lap = np.zeros((len(nodes), len(nodes)))
    for a, b in at.reshape(-1, 2):
        lap[a, b] = lap[b, a] = -1
    np.fill_diagonal(lap, -lap.sum(1))
    p = np.linalg.eigvalsh(lap)
    p = p[p > 1e-12] / p.sum()
    want = -(p * np.log2(p)).sum()
    assert math.isclose(gr.spectral_entropy(e, ["material"]).first()[1], want, rel_tol=1e-9)
    assert math.isclose(gr.spectral_entropy(e, ["material"], dense=10, probes=32, steps=12).first()[1], want, rel_tol=0.02)


def test_distances_of_copies_need_no_rounds(spark, monkeypatch):
    """A graph of copies beyond the size of one search is searched by its components, so its bits meet no joins."""
    def refused(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(gr, "_large_distances", refused)
    rng = random.Random(5)
    one = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    pairs = [(u + 100 * i, v + 100 * i) for i in range(20) for u, v in one] + [(i, i + 1) for i in range(9000, 9700)]
    e = spark.createDataFrame(sorted({("a", min(p), max(p)) for p in pairs if p[0] != p[1]}), "material string, u int, v int")
    got = {r["hops"]: r["pairs"] for r in gr.distances(e, ["material"], whole=1500, apart=500).collect()}
    assert got == brute_distances(pairs)


def test_wl_hash_reads_every_label_in_full(spark):
    """The hash is the md5 of whole labels in order, not of sums of parts of them."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    labels, near = {0: "a", 1: "b", 2: "a"}, {0: [1], 1: [0, 2], 2: [1]}
    now = {n: md5(x) for n, x in labels.items()}
    bag = Counter(now.values())
    for _ in range(3):
        now = {n: md5(now[n] + "|" + ",".join(sorted(now[m] for m in near[n]))) for n in now}
        bag.update(now.values())
    want = md5(",".join(sorted(f"{x}:{c}" for x, c in bag.items())))
    e = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("h", 0, 1), ("h", 1, 2)], "material string, u int, v int")
    n = spark.createDataFrame([(g, i, x) for g in "gh" for i, x in labels.items()], "material string, node int, label string")
    assert {r["material"]: r["wl_hash"] for r in gr.wl_hash(e, n, ["material"], "label").collect()} == {"g": want, "h": want}
