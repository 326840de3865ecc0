"""Scores in blocks against the row-wise operators and kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import similarity as S
from massloom.operators import gridsearch as G
from massloom.operators import spectra as P
from massloom.plans import queries


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(9)
    x = np.abs(draw.normal(size=(90, 9))) * (draw.random((90, 9)) < 0.7)
    x[3] = 0
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None]), (92, [1.0, 2.0]), (100, [0.5, 2.0])]


@pytest.mark.parametrize("method", ["cosine", "entropy"])
def test_blocks_equal_row_wise_scores(spark, vectors, method, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 20)
    monkeypatch.setattr(G, "CHUNK", 5)
    d = spark.createDataFrame(vectors, "id long, x array<double>")
    one = {"cosine": P.grid_cosine, "entropy": P.grid_entropy}[method]
    pairs = d.where("id % 10 = 0").join(d.select(F.col("id").alias("lib_id"), F.col("x").alias("y")))
    want = {(r.id, r.lib_id): r.s for r in pairs.select("id", "lib_id", one(F.col("x"), F.col("y")).alias("s")).collect()}
    rows = G.search(d, F.col("id") % 10 == 0, method, 9).collect()
    got = {(r.id, r.lib_id): r.score for r in rows}
    assert len(rows) == len(want) == 11 * len(vectors)
    odd = {3, 90, 91}  # no intensity, null, holds a null: no score
    for k, w in want.items():
        w = None if odd & set(k) or (k[0] == 100) != (k[1] in (92, 100)) else w
        assert got[k] is None if w is None or math.isnan(w) else got[k] == pytest.approx(w, abs=1e-9), k


def test_adjacent_assignment_is_the_best(vectors):
    x = np.array([v for i, v in vectors if i < 90])
    score, n = G.adjacent_assignment(x[:12], x)
    peaks = [np.array(list(enumerate(v)), float) for v in x]
    for i in range(12):
        for j in range(len(x)):
            w, k = S.hungarian_cosine(peaks[i], peaks[j], 1.0)
            assert score[i, j] == pytest.approx(w, abs=1e-12) and n[i, j] == k


@pytest.mark.parametrize("name", ["spectral_cosine", "spectral_entropy", "hungarian_cosine"])
def test_pairs_are_scored_in_blocks(spark, name):
    """No row-wise scores of joined pairs, whose time grew with the square of the table at microseconds to milliseconds a pair."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
