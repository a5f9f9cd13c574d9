"""Components too large for a dense solve are estimated in tasks, with the values that rounds of joins give."""

import math
import random

import pytest

from facetry.operators import graphs as gr


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(2)
    pairs = {(i, i + 1) for i in range(59)} | {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(0, i) for i in range(1, 50)} | {(100, 101), (101, 102)}
    rows = [("m", *p) for p in pairs] + [("n", i, i + 1) for i in range(200, 240)]
    return spark.createDataFrame(sorted(rows), "material string, u int, v int").cache()


def test_estimates_in_tasks_equal_those_of_rounds(spark, edges):
    got, want = ({r[0]: r[1] for r in gr.spectral_entropy(edges, ["material"], dense=10, probes=5, steps=12, whole=whole).collect()} for whole in (1000, 0))
    assert set(got) == {"m", "n"} and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_estimates_with_many_probes_come_near_the_entropy(spark, edges):
    want = {r[0]: r[1] for r in gr.spectral_entropy(edges, ["material"]).collect()}
    got = {r[0]: r[1] for r in gr.spectral_entropy(edges, ["material"], dense=10, probes=62, steps=12).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=0.05) for k in want)


def test_components_of_bounded_size_take_no_rounds(spark, edges, monkeypatch):
    def refused(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(gr, "_lanczos_sums", refused)
    assert gr.spectral_entropy(edges, ["material"], dense=10, steps=5).count() == 2
