"""Searches, pseudo-spectra and look-ups on small fixtures, against brute force."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import kernels as K
from massloom.functions import similarity as S
from massloom.operators import browse as B
from massloom.operators import coelution as C
from massloom.operators import fragments as M
from massloom.operators import library as L
from massloom.operators import search as H
from massloom.operators import tolerance as T
from massloom.sources import sinks, text

FEATURE = "feature_id string, mz double, rtime double, RI double, peak_area double"


@pytest.fixture(scope="module")
def features(spark):
    draw = np.random.default_rng(3)
    rows = [(f"F{i:03d}", float(100 + draw.integers(0, 40) + draw.uniform(-0.002, 0.002)), float(draw.uniform(0, 40)), float(draw.uniform(1000, 2000)), float(draw.integers(1, 10_000))) for i in range(150)]
    return spark.createDataFrame(rows, FEATURE), rows


def test_time_bins_are_a_greedy_cover(features):
    df, rows = features
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    covered, want = set(), {}
    for f, _, t, _, _ in order[: int(len(rows) * 0.4)]:
        if f not in covered:
            near = sorted(r[0] for r in rows if abs(r[2] - t) < 0.7)
            covered.update(near)
            want[f] = near
    got = {r.spec_id: sorted(m.feature_id for m in r.members) for r in H.time_bins(df, 0.7, 0.4).collect()}
    assert got == want


def _library(spark, features, ids):
    """Entries whose peaks are the features around a time, with a little noise."""
    out = []
    for k, f in enumerate(ids):
        t, ri = next((r[2], r[3]) for r in features if r[0] == f)
        peaks = sorted((r[1] + 1e-5, r[4]) for r in features if abs(r[2] - t) < 0.7)
        out.append((f"cpd{k}", f"key{k}", ri + 5, peaks, max(peaks, key=lambda p: p[1]), [round(p[0]) for p in peaks]))
    peak = "struct<mz:double,intensity:double>"
    return spark.createDataFrame(out, f"id string, inchikey string, RI double, peaks array<{peak}>, base_peak {peak}, rounded_list array<int>"), out


def test_reverse_search_scores_every_near_entry(spark, features):
    df, rows = features
    spectra = H.time_bins(df, 0.7, 0.4).cache()
    held = {r.spec_id: r for r in spectra.collect()}
    lib, entries = _library(spark, rows, sorted(held)[:6])
    want = {}
    for s in held.values():
        for i, _, ri, peaks, _, rounded in entries:
            if abs(s.RI - ri) < 100:
                mine = np.array([(m.mz, m.peak_area) for m in s.members if round(m.mz) in rounded], float).reshape(-1, 2)
                e, (c, n) = S.entropy_similarity(mine, np.array(peaks), 0.005), S.greedy_cosine(mine, np.array(peaks), 0.005)
                if e > 0.4 or c > 0.5:
                    want[s.spec_id, i] = (e, c, n)
    got = {(r.spec_id, r.id): (r.entropy, r.cosine, r.n_matched) for r in H.reverse_search(spectra, lib).collect()}
    assert set(got) == set(want) and len(want) >= 6
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def _areas(spark, rows, seed=1):
    """Areas in eight samples: features near in time share a profile."""
    draw = np.random.default_rng(seed)
    profiles = draw.uniform(0.1, 1, (60, 8))
    out = [(r[0], f"s{k}", float(r[4] * profiles[int(r[2])][k] * draw.uniform(0.9, 1.1))) for r in rows for k in range(8)]
    return spark.createDataFrame(out, "feature_id string, sample_id string, area double"), {(f, s): a for f, s, a in out}


def test_annotation_details(spark, features):
    df, rows = features
    areas, table = _areas(spark, rows)
    spectra = H.time_bins(df, 0.7, 0.4).cache()
    held = {r.spec_id: r for r in spectra.collect()}
    lib, entries = _library(spark, rows, sorted(held)[:3])
    matches = lib.select("id").join(spectra.select("spec_id", "members")).where(F.col("spec_id") == F.element_at(F.array(*map(F.lit, sorted(held)[:3])), F.substring("id", 4, 1).cast("int") + 1))
    got = {}
    for r in H.annotation_details(matches, lib, areas).collect():
        got.setdefault(r.id, {})[r.feature_id] = r
    for k, (i, _, _, peaks, _, _) in enumerate(entries):
        members = held[sorted(held)[k]].members
        assert set(got[i]) <= {m.feature_id for m in members} and got[i]
        quant = {r.quant_id for r in got[i].values()}
        assert len(quant) == 1
        q = quant.pop()
        for f, r in got[i].items():
            x, y = ([table[g, f"s{s}"] for s in range(8)] for g in (f, q))
            want = np.corrcoef(x, y)[0, 1]
            assert r.corr == pytest.approx(want, abs=1e-6) and r.is_core == (want >= 0.7)


def test_iterated_builds_end_and_hold_features(spark, features):
    df, rows = features
    areas, _ = _areas(spark, rows)
    spectra = H.clustered_spectra(df, areas, [f"s{k}" for k in range(8)], step=60, cut=0.9).collect()
    held = {m.feature_id for r in spectra for m in r.members}
    assert spectra and held <= {r[0] for r in rows} and all(len(r.members) > 1 and r.spec_id in {m.feature_id for m in r.members} for r in spectra)
    spaced = H.spaced_spectra(df, areas, cut=0.3).collect()
    assert spaced and all(len(r.members) > 1 for r in spaced)


def test_reverse_annotation_leaves_core_features_out(spark, features):
    df, rows = features
    areas, _ = _areas(spark, rows)
    lib, _ = _library(spark, rows, ["F001", "F010", "F020"])
    out = H.reverse_annotation(df, lib, areas, window=0.7, rounds=2).collect()
    core = {r.feature_id for r in out if r["round"] == 1 and r.is_core}
    assert out and not core & {r.feature_id for r in out if r["round"] == 2}


def test_clusters_are_connected_components(spark, features):
    df, rows = features
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[2] - b[2]) < 0.1}
    assert {(r.a, r.b) for r in C.edges(df, 0.1).collect()} == pairs
    up = {r[0]: r[0] for r in rows}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in pairs:
        up[root(a)] = root(b)
    want = {}
    for x in {x for p in pairs for x in p}:
        want.setdefault(root(x), set()).add(x)
    got = {}
    for r in C.clusters(df, 0.1).collect():
        got.setdefault(r.cluster, set()).add(r.feature_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_intensity_groups():
    mz, i = np.array([100.0, 100.004, 100.0095, 200.0, 100.0041]), np.array([5, 9, 7, 1, 9])
    assert K.intensity_groups(mz, i, 0.005).tolist() == [0, 0, 1, 2, 0]  # the third is no nearer than the tolerance to the first seed


def test_knots_are_bounded(spark):
    many = spark.range(L.MAX_KNOTS + 1).select(F.col("id").cast("double").alias("index"), F.col("id").cast("double").alias("rtime_min"))
    with pytest.raises(ValueError, match="knots"):
        L.kovats(spark.createDataFrame([(1.0,)], "rtime double"), many)
    few = spark.createDataFrame([(800.0, 1.0), (900.0, 2.0)], "index double, rtime_min double")
    got = L.kovats(spark.createDataFrame([(0.0,), (60.0,), (90.0,), (600.0,), (None,)], "rtime double"), few).collect()
    assert [r.RI for r in got] == [800.0, 800.0, 850.0, 900.0, None]


def test_min_labels_never_ends_half_done(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        L.min_labels(chain, rounds=2)


def test_nearest_over_blocks_of_bins(spark):
    draw = np.random.default_rng(9)
    a, b = draw.uniform(0, 9e6, 60), np.r_[draw.uniform(0, 9e6, 20), 5.0]
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)] + [(99, None)], "i int, a double")
    right = spark.createDataFrame([(k, float(x)) for k, x in enumerate(b)], "k int, b double")
    got = {r.i: r.k for r in T.nearest(left, right, "a", "b", "k", 1.0).collect()}
    assert got.pop(99) is None and got == {i: int(np.abs(b - x).argmin()) for i, x in enumerate(a)}


def test_fragments(spark):
    tracks = spark.createDataFrame([(1, 100.0), (2, 100.0003), (3, 300.0)], "track_id int, mz double")
    spectra = spark.createDataFrame([("a", 100.0001), ("b", 100.0004)], "spec_id string, precursor_mz double")
    assert {r.track_id: r.spec_ids for r in M.attach_to_tracks(tracks, spectra).collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: []}
    m = spark.createDataFrame([("k", "n", "x", 1.0, 2.0, 0.5, 3), ("k", "n", "y", 1.0, 2.0, 0.9, 4)], "inchikey string, name string, spec_id string, mz double, rtime double, score double, n_matched int")
    row = M.by_compound(m).first()
    assert row.n == 2 and [s.spec_id for s in row.spectra] == ["y", "x"]


def test_all_scores_and_fragment_annotation(spark):
    from massloom.params import Parameters
    from massloom.plans import process

    draw = np.random.default_rng(5)
    kind = "array<struct<mz:double,intensity:double>>"
    peaks = [sorted((float(m), float(i)) for m, i in zip(draw.uniform(50, 200, 6), draw.uniform(1, 10, 6), strict=True)) for _ in range(12)]
    lib = spark.createDataFrame([(f"L{i}", 300.0 + i, p, f"key{i % 5}") for i, p in enumerate(peaks)], f"id string, mz double, peaks {kind}, inchikey string")
    asked = spark.createDataFrame([(f"S{i}", 300.001 + i, [(m + 0.001, x) for m, x in peaks[i]]) for i in range(8)], f"spec_id string, precursor_mz double, peaks {kind}")
    want = {}
    for i in range(8):
        for j, p in enumerate(peaks):
            score, n = S.greedy_cosine(np.array([(m + 0.001, x) for m, x in peaks[i]]), np.array(p), 0.005)
            if score >= 0.7 and n >= 1:
                want[f"S{i}", f"L{j}"] = (score, n)
    got = {(r.spec_id, r.id): (r.score, r.n_matched) for r in H.all_scores(asked, lib).collect()}
    assert set(got) == set(want) and len(want) >= 8 and all(got[k] == pytest.approx(v) for k, v in want.items())
    found = process.annotate_ms2(asked, lib.select(F.col("id").alias("lib_id"), F.col("mz").alias("lib_precursor_mz"), F.col("peaks").alias("lib_peaks"), "inchikey"), Parameters()).collect()
    assert {r.inchikey for r in found} == {f"key{i}" for i in range(5)} and all(r.lib_id[1:] == r.spec_id[1:] for r in found)


def test_seeded_members_correlate(spark, features):
    df, rows = features
    areas, table = _areas(spark, rows)
    seeds = df.where("feature_id < 'F010'").select(F.col("feature_id").alias("seed_id"), F.col("RI").alias("seed_ri"), F.col("peak_area").alias("seed_area"))
    at = {r[0]: r for r in rows}
    got = {r.seed_id: {m.feature_id for m in r.members} for r in H.seeded(seeds, df, 100, 1000, areas, 0.5).collect()}
    for s, members in got.items():
        for m in members:
            x, y = ([table[f, f"s{k}"] for k in range(8)] for f in (m, s))
            d = abs(at[m][3] - at[s][3])
            penalty = 1 if d < 1 else 2 / (1 + np.exp(np.e * d / 100))
            assert d < 100 and np.corrcoef(x, y)[0, 1] * penalty >= 0.5 - 1e-9
    assert all(s in members for s, members in got.items())


def test_browsing(spark, tmp_path):
    s = spark.createDataFrame([("b", None, "passed"), ("a", datetime.datetime(2020, 1, 2), "failed"), ("c", datetime.datetime(2020, 1, 1), "passed")], "sample_id string, acquired timestamp, status string")
    assert [r.sample_id for r in B.acquisition_order(s).collect()] == ["c", "a", "b"] and B.valid_samples(s).count() == 2
    f = spark.createDataFrame([("F1", 100.0), ("F2", 200.0)], "feature_id string, mz double")
    assert [tuple(r) for r in B.feature_by_number(f, 3).collect()] == [("F3", None, False)]
    files = spark.createDataFrame([(f"f{i}",) for i in range(20)], "path string")
    assert B.sampled_files(files, 0.25).count() == 5 and B.sampled_files(files, 3, 1).collect() == B.sampled_files(files.repartition(3), 3, 1).collect()
    c = spark.createDataFrame([("E1", [("F1", "M+H"), ("F2", "M+Na")])], "interim_id string, members array<struct<feature_id:string,ion:string>>")
    assert {tuple(r) for r in B.compound_index(c).collect()} == {("F1", "E1", "M+H"), ("F2", "E1", "M+Na")}
    assert sinks.as_json(c).first().value.startswith('{"interim_id":"E1","members":[')


def test_files_of_projects(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a/x_Feature_table.tsv\nb/export/\nc\n\n")
    assert [r.path for r in text.resolve_tables(spark, str(tmp_path / "list.txt")).collect()] == ["a/x_Feature_table.tsv", "b/export/full_Feature_table.tsv", "c/export/full_Feature_table.tsv"]
    (tmp_path / "lib.json").write_text('[{"id": "a", "peaks": [[50.0, 1.0]]}]')
    assert text.read_library(spark, str(tmp_path / "lib.json")).count() == 1 and text.read_library(spark, "x.txt") is None
    wide = tmp_path / "wide.tsv"
    wide.write_text("\t".join(["id", *[f"c{i}" for i in range(40)]]) + "\n" + "\t".join(["F1", *["1"] * 40]) + "\n")
    assert len(text.read_quality_table(spark, str(wide)).columns) == 22
    rows = text.read_merge_table(spark, str(wide), number_rows=True).collect()
    assert rows[0].feature_id == "row1" and rows[0].mz == 1.0
    one = sinks.export_folder(spark, str(tmp_path), "p", "0101")
    assert sinks.export_folder(spark, str(tmp_path), "p", "0101") == one + "_1"
    (tmp_path / "p_0101" / "intermediate").mkdir()
    sinks.remove_intermediates(spark, one)
    assert sorted(x.name for x in (tmp_path / "p_0101").iterdir() if not x.name.startswith(".")) == ["export"]
    (tmp_path / "p_0101" / "project.json").write_text('{"mode": "pos"}')
    (tmp_path / "p_0101" / "export" / "full_Feature_table.tsv").write_text(wide.read_text())
    project = text.read_project(spark, one, samples=5)
    assert set(project) == {"project", "features"} and len(project["features"].columns) == 16
