"""Links of embeddings of different shapes against brute force: which are found, and that both ends count them."""

import numpy as np
import pytest

from massloom.llm import embedding_dedup


def _isotropic(draw, n):
    """Directions at random, a third of them copies moved at random, to about the threshold."""
    v = draw.normal(size=(n, 64))
    copies = v[: n // 3] + draw.uniform(0.1, 0.6, (n // 3, 1)) * draw.normal(size=(n // 3, 64))
    return np.r_[v[n // 3 :], v[: n // 3], copies]


def _low_rank(rank):
    """A few strong directions under weak noise: neighbours differ along few directions."""
    return lambda draw, n: draw.normal(size=(n, rank)) @ draw.normal(size=(rank, 384)) + 0.3 * draw.normal(size=(n, 384))


def _clustered(draw, n):
    return draw.normal(size=(40, 64))[draw.integers(0, 40, n)] + 0.35 * draw.normal(size=(n, 64))


@pytest.mark.parametrize(("shape", "kind"), [(_isotropic, "float"), (_low_rank(3), "float"), (_low_rank(5), "double"), (_low_rank(8), "float"), (_clustered, "double")])
def test_links_of_both_ends(spark, shape, kind):
    v = shape(np.random.default_rng(4), 3000)
    if kind == "float":
        v = v.astype(np.float32)
    x = v.astype(np.float64)
    x /= np.sqrt((x**2).sum(1))[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    n = np.array([got[i].n_links for i in range(len(v))])
    assert near.sum() > 500 and (n <= near.sum(1)).all()
    assert n.sum() % 2 == 0 and n.sum() >= 0.99 * near.sum()


def test_doubles_beyond_floats(spark):
    """Doubles are compared as they are: too large for floats, and unlike beyond a float's digits."""
    base = np.random.default_rng(1).normal(size=8)
    rows = [(0, (base * 1e200).tolist()), (1, (base * 1e-200).tolist()), (2, (base * (1 + 1e-12)).tolist()), (3, (-base).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}
