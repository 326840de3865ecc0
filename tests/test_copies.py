"""Tables of many equal values: the same results as by brute force, and no join with more rows than such tables need."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions.statistics import correlations
from massloom.operators import coelution as C
from massloom.operators import features as X
from massloom.operators import fragments as M
from massloom.operators import search as H
from massloom.operators import spectra as S
from massloom.operators import tolerance as T
from massloom.operators import tracks as R


def _metrics(plan):
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from _metrics(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from _metrics(plan.plan())
    rows = plan.metrics().get("numOutputRows")
    if "Join" in name and rows.isDefined():
        yield rows.get().value()
    for k in range(plan.children().size()):
        yield from _metrics(plan.children().apply(k))


def joined(df):
    """(rows of df, most rows that a join put out)."""
    rows = df.collect()
    return rows, max(_metrics(df._jdf.queryExecution().executedPlan()), default=0)


def test_calibration_joins_distinct_values(spark):
    f = spark.range(600).select(F.col("id").alias("feature_id"), (500 + 0.01 * (F.col("id") % 3)).alias("mz"))
    lib = spark.range(400).select((500.001 + 0.01 * (F.col("id") % 2)).alias("mz"))
    x, y = 500 + 0.01 * (np.arange(600) % 3), 500.001 + 0.01 * (np.arange(400) % 2)
    ratio = ((x[:, None] - y) / y)[np.abs(x[:, None] - y) < y * 50e-6].mean()
    rows, most = joined(X.calibrated(f, lib, 50, 0.2))
    assert len(rows) == 600 and abs(ratio) > 2e-7
    assert all(r.mz_calibrated == pytest.approx(r.mz / (1 + ratio), rel=1e-12) for r in rows)
    assert most <= 600


def test_nearest_joins_distinct_values(spark):
    draw = np.random.default_rng(2)
    x, y = np.r_[draw.uniform(0, 40, 50).round(1), np.repeat(7.3, 300), -900.0, 5000.0], np.r_[np.repeat([3.0, 7.0, 7.6, 30.0], 100), draw.uniform(0, 40, 9).round(1)]
    left, right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "i long, a double"), spark.createDataFrame([(500 - k, float(v)) for k, v in enumerate(y)], "k long, b double")
    want = {i: min((abs(v - w), 500 - k) for k, w in enumerate(y)) for i, v in enumerate(x)} | {-1: (None, None)}
    rows, most = joined(T.nearest(left, right, "a", "b", "k", 1.0))
    assert {r.i: (r.gap, r.k) for r in rows} == want and len(rows) == len(want)
    assert most <= len(want)


@pytest.fixture(scope="module")
def indexed(spark):
    """Features of few indices and areas, many of them alike."""
    draw = np.random.default_rng(4)
    rows = [(i, float(m), float(r), float(a)) for i, m, r, a in zip(range(700), draw.choice([900.0, 900.001, 950.5], 700), draw.integers(0, 60, 700) / 2, draw.integers(1, 30, 700), strict=True)]
    return rows, spark.createDataFrame(rows, "feature_id long, mz double, RI double, peak_area double")


@pytest.mark.parametrize("ri,factor", [(10, 3.0), (2.5, 1.0), (100, 1000.0)])
def test_seeded_counts_by_brute_force(spark, indexed, ri, factor):
    rows, f = indexed
    seeds = f.where("feature_id % 25 = 0").select(F.col("feature_id").alias("spec_id"), F.col("RI").alias("seed_ri"), F.col("peak_area").alias("seed_area"))
    want = {}
    for i, _, r, a in rows[::25]:
        own = [j for j, _, q, b in rows if abs(q - r) < ri and b > a / factor]
        if len(own) > 1:
            want[i] = (len(own), min(own))
    got, most = joined(H.seeded_counts(seeds, f, ri, factor))
    assert {r.spec_id: (r.n, r.first) for r in got} == want
    assert most <= len(rows)
    assert {(r.spec_id, len(r.members), r.members[0].feature_id) for r in H.seeded(seeds, f, ri, factor).collect()} == {(k, *v) for k, v in want.items()}


def test_basepeak_counts_equal_the_listed_members(spark, indexed):
    _, f = indexed
    peak = F.struct((F.col("mz") * (1 + 2e-6)).alias("mz"), F.col("peak_area").alias("intensity"))
    lib = f.where("feature_id % 10 = 0").select(F.col("feature_id").alias("id"), (F.col("RI") + 3).alias("RI"), peak.alias("base_peak"), F.array(peak).alias("peaks"), F.array(F.lit(900)).alias("rounded_list"))
    listed = {(r.id, r.seed_id, r.n) for r in H.basepeak_search(lib, f, 5, 0.005, 4, 6, 5).select("id", "seed_id", F.size("members").alias("n")).collect()}
    assert listed and {tuple(r) for r in H.basepeak_counts(lib, f, 5, 4, 6, 5).collect()} == listed


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, 900 + (i % 30) / 10, i % 7) for i in range(1200)]
    return rows, spark.createDataFrame(rows, "id long, mz double, apex int")


def test_mass_differences_join_distinct_values(spark, parts):
    rows, df = parts
    expected = [(i, j, p, q) for i, m, p in rows for j, o, q in rows if abs(o - (m + 1.0)) < (m + 1.0) * 5e-6]
    want = {i: (sum(1 for e in expected if e[0] == i), min(e[1] for e in expected if e[0] == i)) for i in {e[0] for e in expected}}
    got, most = joined(T.mass_difference_counts(df, "id", "mz", [1.0]))
    assert {r.id1: (r.n, r.least) for r in got} == want and most <= len(rows)
    pairs, most = joined(T.coeluting_differences(df, "id", "mz", "apex", [1.0], 40, least=2))
    near = [e[:2] for e in expected if abs(e[2] - e[3]) < 2]
    assert sorted(map(tuple, pairs)) == sorted(near) and most <= len(near)


def test_unique_matches_join_distinct_values(spark):
    draw = np.random.default_rng(6)
    left = [(i, float(500.0 + k * 0.1), float(t)) for i, (k, t) in enumerate(zip(np.r_[np.repeat(3, 300), draw.permutation(200)[:80]], np.r_[np.zeros(300), draw.integers(0, 3, 80)], strict=True))]
    right = [(i, float(500.001 + k * 0.1), float(t)) for i, (k, t) in enumerate(zip(np.r_[np.repeat(3, 300), draw.permutation(200)[:80]], np.r_[np.zeros(300), draw.integers(0, 3, 80)], strict=True))]
    a, b = spark.createDataFrame(left, "id1 long, mz1 double, rt1 double"), spark.createDataFrame(right, "id2 long, mz2 double, rt2 double")
    (got,), most = joined(T.unique_matches(a, b, 5, 2))
    want = T.unique_match_counts(T.feature_match(a, b, 5, 2)).first()
    assert got == want and got.unique_pairs > 0 and most < 400


def test_tracks_of_one_mass_share_their_list(spark, parts):
    rows, df = parts
    spectra = spark.createDataFrame([(k, 900 + (k % 60) / 20) for k in range(300)], "spec_id long, precursor_mz double")
    tracks = df.select(F.col("id").alias("track_id"), "mz").union(spark.createDataFrame([(-1, None)], "track_id long, mz double"))
    want = {i: [k for k in range(300) if abs(900 + (k % 60) / 20 - m) < m * 5e-6] for i, m, _ in rows} | {-1: []}
    got, most = joined(M.attach_to_tracks(tracks, spectra))
    assert {r.track_id: r.spec_ids for r in got} == want and most <= len(want)
    short, _ = joined(M.attach_to_tracks(tracks, spectra, 5, {"n": F.size("spec_ids")}))
    assert {r.track_id: r.n for r in short} == {k: len(v) for k, v in want.items()}


def test_spectra_to_features_join_distinct_values(spark, parts):
    rows, df = parts
    peaks = F.array(F.struct(F.lit(1.0).alias("mz"), (F.col("id") % 11).cast("double").alias("intensity")))
    got, most = joined(S.to_features(df.select(F.col("id").alias("feature_id"), "mz", F.col("apex").alias("rtime")), df.select(F.col("id").alias("spec_id"), F.col("mz").alias("precursor_mz"), F.col("apex").alias("rtime"), peaks.alias("peaks")), 5, 1))
    want = {}
    for i, m, t in rows:
        own = [(j % 11, j) for j, o, u in rows if abs(o - m) < m * 5e-6 and abs(u - t) <= 1]
        want[i] = (max(own)[1], len(own))
    assert {r.feature_id: (r.spec_id, r.n_spectra) for r in got} == want and most <= len(rows)


def test_annotations_are_listed_once_for_a_cluster(spark):
    clustered = spark.createDataFrame([(i, f"c{i % 3}") for i in range(400)] + [(0, "c1"), (7, None)], "feature_id long, cluster string")
    matches = spark.createDataFrame([(f"c{k % 4}", float(k % 5), k, f"n{k}") for k in range(100)], "cluster string, similarity double, n_matched long, name string")
    got, most = joined(C.map_back(clustered, matches, ["name"]))
    of = lambda cs: [f"n{k}" for _, _, k in sorted((-float(k % 5), f"n{k}", k) for k in range(100) if f"c{k % 4}" in cs)]
    assert {r.feature_id: [a.value for a in r.annotations] for r in got} == {i: of({f"c{i % 3}"} | ({"c1"} if i == 0 else set())) for i in range(400)}
    assert most <= 400


def test_correlations_pair_by_pair():
    draw = np.random.default_rng(8)
    x = draw.integers(0, 4, (40, 7)).astype(float)
    x[draw.random((40, 7)) < 0.3] = np.nan
    x[3], x[4, :] = 2.0, np.nan
    full = draw.normal(size=(12, 7)) + 1e6
    for a, b in ((x, x[:25]), (full, full)):
        got = correlations(a, b)
        for i in range(len(a)):
            for j in range(len(b)):
                both = ~(np.isnan(a[i]) | np.isnan(b[j]))
                p, q = a[i][both], b[j][both]
                want = 0.0 if len(p) < 2 or np.ptp(p) == 0 or np.ptp(q) == 0 else np.corrcoef(p, q)[0, 1]
                assert got[i, j] == pytest.approx(want, abs=1e-8), (i, j)


def test_quantitative_feature_pairs_nothing_in_joins(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(1, 50, (12, 6)).astype(float)
    rows = [(i % 3, i, f"s{k}", float(base[i % 12, k])) for i in range(240) for k in range(6) if (i % 12, k) not in {(1, 2), (5, 0)} and not (i % 12 == 7 and k > 0)]
    got, most = joined(X.quantitative_feature(spark.createDataFrame(rows, "compound int, feature_id long, sample_id string, area double"), 0.3))
    area = {(i, s): a for _, i, s, a in rows}
    for c in range(3):
        ids = [i for i in range(240) if i % 3 == c]
        vector = np.array([[area.get((i, f"s{k}"), np.nan) for k in range(6)] for i in ids])
        corr = np.round(correlations(vector, vector), 9)
        total = np.round(corr.sum(1), 6)
        quant = ids[int(np.flatnonzero(total == total.max())[0])]
        own = {r.feature_id: r for r in got if r.compound == c}
        assert {r.quant_id for r in own.values()} == {quant}
        for k, i in enumerate(ids):
            met = (~np.isnan(vector[k]) & ~np.isnan(vector[ids.index(quant)])).any()
            assert (i in own) == met
            assert not met or (own[i].corr == pytest.approx(corr[k, ids.index(quant)], abs=1e-8) and own[i].is_core == (corr[k, ids.index(quant)] > 0.3))
    assert most == 0


def test_members_that_cannot_pass_meet_no_areas(spark):
    members = spark.range(60).select(F.lit(0).cast("long").alias("seed_id"), F.col("id").alias("feature_id"), (F.col("id") * 10.0).alias("d_ri"))
    areas = spark.range(60 * 4).select((F.col("id") / 4).cast("long").alias("feature_id"), (F.col("id") % 4).alias("sample_id"), (F.col("id") % 4 + 1.0).alias("area"))
    got, most = joined(H.penalised_members(members, areas, 0.3, 1, 100))
    assert {r.feature_id for r in got} == {i for i in range(60) if i == 0 or (10 * i <= 100 and 2 / (1 + np.exp(np.e * i / 10)) >= 0.3)}
    assert most <= 4 * 7


def test_numbers_are_those_of_the_counted_ranges(spark):
    """Counting reads the key alone, so its ranges were joined to fewer than those of the wide rows that were numbered."""
    df = spark.range(120_000, numPartitions=1).select((F.col("id") * 7919 % 120_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    got = X.numbered(df, "k").agg(F.count("*").alias("n"), F.count_if(F.col("nth") == F.col("k")).alias("same"), F.max("wide")).first()
    assert tuple(got)[:2] == (120_000, 120_000)


def test_scores_get_numbers_not_structs(spark):
    pair = [([(1.0, 2.0), (2.0, 3.0)], [(1.0, 4.0)]), ([], [(1.0, 4.0)])]
    df = spark.createDataFrame(pair, f"a {S.PEAKS}, b {S.PEAKS}")
    out = S.scored(df, "a", "b", 0.1)
    assert [(round(r.score, 6), r.n_matched) for r in out.collect()] == [(round(2 / 13**0.5, 6), 1), (0.0, 0)]
    call = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line)
    assert ".mz" in call and ".intensity" in call


def test_a_spectrum_is_searched_for_its_top_once(spark):
    df = spark.range(1).select(F.array(*[F.struct(F.lit(m).alias("mz"), (F.lit(x) + F.col("id")).alias("intensity")) for m, x in ((1.0, 2.0), (2.0, 9.0), (3.0, 3.0))]).alias("peaks"))
    out = df.select(F.size(S.within_factor(F.col("peaks"), S.base_peak(F.col("peaks"))["intensity"], 4.0)).alias("n"))
    assert out.first().n == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max") <= 1


def test_means_between_two_rounded_values_round_up(spark):
    from decimal import ROUND_HALF_UP, Decimal

    draw = np.random.default_rng(1)
    rows = [(g, round(float(v), 2)) for g in range(400) for v in draw.uniform(0, 40, 64)] + [(-1, 1.0), (-1, float("nan")), (-2, None), (-3, 1e300)]
    df = spark.createDataFrame(rows, "g long, x double").repartition(4, F.rand(3))
    got = {r.g: r.m for r in df.groupBy("g").agg(R.exact_mean(F.col("x"), 6).alias("m")).collect()}
    for g in range(400):
        assert got[g] == float((sum(Decimal(str(v)) for k, v in rows if k == g) / 64).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    assert np.isnan(got[-1]) and got[-2] is None and got[-3] == 1e300
