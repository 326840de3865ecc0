"""Near copies that share only frequent values, or whose rare values differ, against brute force."""

import itertools

import numpy as np
import pytest

from massloom.llm import common, minhash

SCHEMA = "doc_id long, text string"


def _groups(texts, n, percent=80):
    """The smallest id reachable by links, from all pairs."""
    sets = minhash.shingle_sets([t.encode() for t in texts], n)
    up = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up]
    return up


def test_long_lists_of_common_words(spark):
    """Short texts of few words: every value is frequent and near pairs are not neighbours by size."""
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(list("abcdefg"), 30)) for _ in range(700)]
    for i in range(0, 60):
        words = texts[i].split()
        words[-1:] = draw.choice(list("abcdefg"), 1 + i % 3).tolist()
        texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 2).collect()}
    want = _groups(texts, 2)
    assert len(set(want)) < 740
    assert [got[i] for i in range(len(texts))] == want


def test_containment_over_tiers(spark):
    """Copies of one base with 30 own shingles each, and each of them with 180 more behind it: 0.82 alike to that one
    only, which shares its rare values but not the first of them."""
    base, texts = [f"b{i}" for i in range(794)], []
    for i in range(45):
        texts.append(" ".join([*base, *[f"c{i}_{j}" for j in range(30)]]))
    texts += [f"{t} " + " ".join(f"d{i}_{j}" for j in range(180)) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize(("n_texts", "n_words", "vocabulary", "cut"), [(2500, 40, 25, 4096), (2500, 40, 25, 40), (3000, 60, 60, 4096), (1500, 40, 400, 4096)])
def test_small_vocabularies(spark, monkeypatch, n_texts, n_words, vocabulary, cut):
    """Random words of few kinds and copies with one changed word: all lists are long, some longer than a task's share."""
    monkeypatch.setattr(minhash, "LIST", cut)
    draw = np.random.default_rng(n_texts + vocabulary)
    words = draw.integers(0, vocabulary, (n_texts, n_words))
    copies = words[:300].copy()
    copies[np.arange(300), draw.integers(0, n_words, 300)] = draw.integers(0, vocabulary, 300)
    texts = [" ".join(f"w{x}" for x in row) for row in [*words, *copies]]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), 2).collect()}
    want = _fast_groups(texts, 2)
    assert sum(i != w for i, w in enumerate(want)) >= 250
    assert [got[i] for i in range(len(texts))] == want


def _fast_groups(texts, n, percent=80):
    """As _groups, by one matrix product of all sets."""
    sets = minhash.shingle_sets([t.encode() for t in texts], n)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), len(values)), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), ids] = 1
    size = has.sum(1)
    u = common.Union(len(sets))
    for i in range(len(sets)):
        both = has[i:] @ has[i]
        for j in np.flatnonzero(100 * both >= percent * (size[i] + size[i:] - both)):
            u.join(i, i + int(j))
    return [u.root(i) for i in range(len(sets))]


def test_null_ids_and_clashing_names(spark):
    """Null ids name no group; columns with dots, and named like helpers, come back as they were."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, 1, 2.0), (None, base, 3, 4.0), (None, base + " x", 5, 6.0), (7, None, 7, 8.0), (7, None, 9, 8.0), (8, "other words than these here", 1, 1.0), (8, "same id and other text here", 1, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, `a.b` double")
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 7 for r in got) == 2 and sum(r.doc_id == 8 for r in got) == 2
