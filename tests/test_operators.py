import pytest
from pyspark.sql import functions as F

from massloom.operators import adjacency as A
from massloom.operators import features as X
from massloom.operators import library as L
from massloom.operators import spectra as S
from massloom.operators import tolerance as T
from massloom.operators import tracks as R


def listed(spark, values, start=0):
    return spark.createDataFrame([(i + start, float(v)) for i, v in enumerate(values)], "id long, mz double")


def test_ambiguous_is_dropped_but_best_stays(spark):
    a, b = listed(spark, [100.0]), listed(spark, [100.0001, 100.0003])
    assert A.unambiguous_match(a, b).count() == 0
    assert [tuple(r)[:2] for r in A.best_adjacent_match(a, b).collect()] == [(0, 0)]


def test_unambiguous_across_blocks(spark):
    a, b = listed(spark, [9.99999, 50.0, 200.0]), listed(spark, [10.00001, 50.0001, 200.0005])
    assert sorted(tuple(r)[:2] for r in A.unambiguous_match(a, b).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_tolerance_is_strict(spark):
    left = spark.createDataFrame([(1.0,), (1.5,)], "a double")
    right = spark.createDataFrame([(2.0,)], "b double")
    join = lambda inc: [r.a for r in T.band_join(left, right, "a", "b", F.lit(0.5), 0.25, inclusive=inc).collect()]
    assert join(False) == [] and join(True) == [1.5]


def test_unmatched_keeps_nulls_out(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, None)], "i int, a double")
    b = spark.createDataFrame([(100.0001,)], "b double")
    assert sorted(r.i for r in T.unmatched(a, b, "a", "b").collect()) == [2, 3]


def test_gap_sessions_across_blocks(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 9.5, 10.5, 11.5, 30.0, 45.0)], "v double")
    got = {r.v: r.session for r in A.gap_sessions(df, [], "v", lambda v, p: v - p > 1.5).collect()}
    assert got == {1.0: 1.0, 2.0: 1.0, 9.5: 9.5, 10.5: 9.5, 11.5: 9.5, 30.0: 30.0, 45.0: 45.0}


def test_bins_sessionize(spark):
    bins = spark.createDataFrame([("s", b, 1) for b in (10, 11, 13)], "sample_id string, bin long, n long")
    assert [(r.bin, r.grp) for r in R.bin_groups(bins).orderBy("bin").collect()] == [(10, 10), (11, 10), (13, 13)]


def test_remap_keeps_the_moved_value(spark):
    t = spark.createDataFrame([("s", 1, i, v) for i, v in enumerate((5, 6, 7))], "sample_id string, grid_id int, scan int, intensity long")
    m = spark.createDataFrame([("s", 0, 1)], "sample_id string, scan int, ref_scan int")
    dense = lambda d: R.dense(d, ["grid_id"], 3).first().intensity
    assert dense(R.remap(t, m, 3, ["sample_id", "grid_id"])) == [5, 5, 7]
    assert dense(R.remap(t, m, 3, ["sample_id", "grid_id"], strict=True)) == [0, 5, 7]


def test_area_auc_and_detection(spark):
    t = spark.createDataFrame([("s", 1, i, v) for i, v in enumerate((0, 2, 0, 4, 0))], "sample_id string, grid_id int, scan int, intensity long")
    f = spark.createDataFrame([("F0", 1, 1, 3)], "feature_id string, grid_id int, left_base int, right_base int")
    assert X.areas(t, f).first().area == 6 and X.areas(t, f, "auc").first().area == 8
    a = spark.createDataFrame([("F", "a", 0), ("F", "b", 1), ("F", "c", 2)], "feature_id string, sample_id string, area long")
    assert X.detection_counts(a).first().detection_counts == 1


def test_selectivity_far_and_near(spark):
    s = {r.id: r.selectivity for r in A.selectivity(listed(spark, [100, 200, 200.0000001]), "id", "mz").collect()}
    assert s[0] == 1.0 and s[1] == 0.0


def test_penalty(spark):
    df = spark.createDataFrame([(0.5,), (50.0,), (101.0,)], "d double")
    import math

    assert [r[0] for r in df.select(L.ri_penalty(F.col("d"))).collect()] == pytest.approx([1, 2 / (1 + math.exp(math.e * 0.5)), 0])


def test_nearest_looks_as_far_as_needed(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 500.0)], "i int, a double")
    right = spark.createDataFrame([(7, 5.2), (8, 100.0)], "k int, b double")
    assert {r.i: r.k for r in T.nearest(left, right, "a", "b", "k", 1.0).collect()} == {1: 7, 2: 8}


def test_numbered_is_dense(spark):
    assert [r.nth for r in X.numbered(spark.range(100).repartition(7), "id").orderBy("id").collect()] == list(range(100))


def test_spectrum_clusters_and_search(spark):
    rows = [("t", "a", 1.0, 100.0, [(50.0, 10.0), (60.0, 5.0)]), ("t", "b", 2.0, 100.0, [(50.0, 20.0), (60.0, 11.0)]), ("t", "c", 3.0, 100.0, [(80.0, 9.0)]), ("t", "d", 90.0, 100.0, [(50.0, 1.0)])]
    s = spark.createDataFrame(rows, f"track string, spec_id string, rtime double, precursor_mz double, peaks {S.PEAKS}")
    got = {(r.rt_group, r.spec_id, r.cluster_size) for r in S.cluster_spectra(s, "track").collect()}
    assert got == {(0, "b", 2), (0, "c", 1), (1, "d", 1)}
    lib = s.select(F.upper("spec_id").alias("lib_id"), (F.col("precursor_mz") + 0.001).alias("lib_precursor_mz"), F.col("peaks").alias("lib_peaks"))
    assert {r.spec_id: r.lib_id for r in S.precursor_search(s, lib).collect()}["c"] == "C"


def test_min_labels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a int, b int")
    assert {tuple(r) for r in L.min_labels(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}


def test_tolerance_joins_are_equi_joins(spark):
    plan = T.ppm_join(listed(spark, [1.0]).toDF("i", "a"), listed(spark, [1.0]).toDF("k", "b"), "a", "b")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
