import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom import params
from massloom.__main__ import main
from massloom.functions import udfs
from massloom.functions.kernels import gaussian
from massloom.operators import qc
from massloom.params import Parameters
from massloom.plans import join_tables, process
from massloom.sources import sinks, text
from massloom.sources.mzml import MzmlSource
from massloom.streaming import ingest

PEAKS = [(100.0, 60, 4e6), (100.0 + 1.003355, 60, 3e6), (250.1, 120, 3e6), (400.2, 150, 6e6)]


def simulated_points(shift):
    rows = []
    for mz, at, h in PEAKS:
        y = gaussian(np.arange(200), h, at + shift, 5)
        rows += [(i, mz * (1 + 1e-7 * (i % 3)), int(v)) for i, v in enumerate(y) if v > 1000]
    return rows


@pytest.fixture(scope="module")
def points(spark):
    rows = [(s, *r) for s, shift in (("a", 0), ("b", 0), ("c", 0)) for r in simulated_points(shift)]
    return spark.createDataFrame(rows, "sample_id string, scan int, mz double, intensity long").cache()


@pytest.mark.parametrize("small", [10, 0])
def test_process_finds_the_simulated_features(spark, points, small):
    done = process.process(points, Parameters(project_sample_number_small=small), 200)
    table = done.table().orderBy("mz").toPandas()
    assert len(table) == len(PEAKS)
    assert np.allclose(table.mz, [p[0] for p in PEAKS], atol=1e-3) and np.abs(table.apex - [p[1] for p in PEAKS]).max() <= 1
    assert (table.detection_counts == 3).all() and done.preferred().count() == len(PEAKS)
    assert np.allclose(table[["a", "b", "c"]].sum(axis=1), table.peak_area, rtol=0.05)


def test_annotation_network(spark):
    f = spark.createDataFrame([("F1", 100.0, 60.0), ("F2", 101.003355, 60.5), ("F3", 300.0, 60.0)], "feature_id string, mz double, rtime double")
    k = spark.createDataFrame([("glc", 100.0 - 1.00727646677)], "id string, mass double")
    got = {r.feature_id: (r.compound, r.match_id) for r in process.annotate(f, k, Parameters()).collect()}
    assert got == {"F1": ("F1", "glc"), "F2": ("F1", None), "F3": ("F3", None)}


def test_dims(spark, points):
    assert process.process_dims(points, Parameters()).count() == 3 * len(PEAKS)


def _mzml(path, spectra, stamp="2024-01-02T03:04:05Z"):
    def array(x, term, bits, packed):
        raw = np.asarray(x, "<f8" if bits == 64 else "<f4").tobytes()
        data = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="{term}"/><cvParam accession="{"MS:1000523" if bits == 64 else "MS:1000521"}"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}"/><binary>{data}</binary></binaryDataArray>'

    body = ""
    for level, minutes, precursor, mz, inten in spectra:
        ion = f'<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{precursor}"/></selectedIon></selectedIonList></precursor></precursorList>' if precursor else ""
        body += f'<spectrum><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000130"/><scanList><scan><cvParam accession="MS:1000016" value="{minutes}" unitAccession="UO:0000031"/></scan></scanList>{ion}<binaryDataArrayList>{array(mz, "MS:1000514", 64, True)}{array(inten, "MS:1000515", 32, False)}</binaryDataArrayList></spectrum>'
    path.write_text(f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run startTimeStamp="{stamp}"><spectrumList>{body}</spectrumList></run></mzML>')


def test_mzml_source(spark, tmp_path):
    _mzml(tmp_path / "one.mzML", [(1, 0.5, None, [100.5, 200.5], [1500.7, 1000.0]), (2, 0.6, 150.0, [50.0, 149.5], [5000, 5000]), (1, 1.0, None, [100.5], [2000])])
    (tmp_path / "bad.mzML").write_text("<mzML><run>")
    spark.dataSource.register(MzmlSource)
    load = lambda t, **o: spark.read.format("mzml").option("table", t).options(**o).load(str(tmp_path))
    rows = load("points").where("sample = 'one'").orderBy("scan").collect()
    assert [(r.scan, r.rtime, r.mz, r.intensity) for r in rows] == [(0, 30.0, 100.5, 1500), (1, 60.0, 100.5, 2000)]
    assert load("points").where("_corrupt is not null").count() == 1
    ms2 = load("ms2").where("sample = 'one'").first()
    assert ms2.precursor_mz == 150.0 and [p.mz for p in ms2.peaks] == [50.0]
    spectra = load("spectra").where("sample = 'one'")
    assert [r.ms_level for r in spectra.orderBy("spectrum").collect()] == [1, 2, 1] and spectra.first().acquired == 1704164645
    stats = qc.file_statistics(spectra.withColumnRenamed("sample", "sample_id"), load("points").withColumnRenamed("sample", "sample_id")).where("sample_id = 'one'").first()
    assert (stats.n_ms1, stats.n_ms2, stats.polarity) == (2, 1, "pos")
    out = tmp_path / "out"
    assert main(["tracks", "-i", str(tmp_path), "-o", str(out)]) == 0


MSP = "Name: first\nMW: 180.1\nNote: a: b\nNote: c: d\nNum Peaks: 3\n50.5 10; 60 20\n70.25\t5\n\nName: second\nNum Peaks: 1\n80 1\n"


def test_msp_and_mgf(spark, tmp_path):
    (tmp_path / "x.msp").write_text(MSP)
    rows = text.read_msp(spark, str(tmp_path / "x.msp")).withColumn("mass", text.field("ExactMass")).orderBy("pos").collect()
    assert [len(r.peaks) for r in rows] == [3, 1] and rows[0].fields["Note"] == "c: d" and rows[0].mass == "180.1"
    (tmp_path / "y.msp").write_text('NAME: q\nNum Peaks: 2\n50:10 "note 3" 60,20\nName: r\nnum peaks: 1\n7 8\n')
    got = text.read_msp_tolerant(spark, str(tmp_path / "y.msp")).orderBy("pos").collect()
    assert [[(p.mz, p.intensity) for p in r.peaks] for r in got] == [[(50, 10), (60, 20)], [(7, 8)]]
    sinks.msp_to_mgf(text.read_msp(spark, str(tmp_path / "x.msp"))).coalesce(1).write.text(str(tmp_path / "mgf"), lineSep="\n")
    back = text.read_mgf(spark, str(tmp_path / "mgf")).orderBy("pos").collect()
    assert [len(r.peaks) for r in back] == [3, 1] and back[0].charge == 1 and back[0].fields["NAME"] == "first"
    (tmp_path / "z.mgf").write_text("BEGIN IONS\nPEPMASS=100.5 2000\nCHARGE=2-\n50 1\nEND IONS\n")
    z = text.read_mgf(spark, str(tmp_path / "z.mgf")).first()
    assert (z.precursor_mz, z.precursor_intensity, z.charge) == (100.5, 2000.0, -2)


def test_feature_tables_round_trip(spark, tmp_path):
    names = "\t".join([*text.FEATURE_COLUMNS, "s1", "s2.x"])
    (tmp_path / "f.tsv").write_text(f"{names}\nF1\t100.5\t60\t55\t65\t7\t1000\t0.9\t0.8\t12\t2\t5\t7\n")
    features, areas = text.read_feature_table(spark, str(tmp_path / "f.tsv"))
    assert features.first().mz == 100.5 and {(r.sample_id, r.area) for r in areas.collect()} == {("s1", 5.0), ("s2.x", 7.0)}
    assert text.read_targets(spark, str(tmp_path / "f.tsv")).count() == 0
    listed = text.read_feature_list(spark, str(tmp_path / "f.tsv"), 1, 2).first()
    assert (listed.id, listed.mz, listed.rt) == ("row1", 100.5, 60.0)
    assert text.list_files(spark, str(tmp_path), "*.tsv").count() == 1


def test_parameters(tmp_path):
    (tmp_path / "p.yaml").write_text("mode: neg  # comment\nmin_peak_height: 5000\n")
    p = params.load(str(tmp_path / "p.yaml"), {"mz_tolerance_ppm": 10.0})
    assert (p.mode, p.min_peak_height, p.mz_tolerance_ppm, p.derived().cal_min_peak_height) == ("neg", 5000, 10, 50000) and p.peaks().prominence == 1650
    with pytest.raises(ValueError):
        params.load(None, {"unknown": 1})
    with pytest.raises(SystemExit):
        main([])
    assert main(["list_workflows"]) == 0


def test_join_tables(spark):
    base = [("x", "F1", 100.0, 60.0), ("y", "G1", 100.0001, 62.0), ("x", "F2", 300.0, 80.0), ("y", "G2", 500.0, 90.0)]
    f = spark.createDataFrame([(t, i, mz, rt, rt - 5, rt + 5, 1e5, 10.0, 0.9, 0.9, 1) for t, i, mz, rt in base], "table string, feature_id string, mz double, rtime double, left double, right double, peak_area double, snr double, goodness_fitting double, cSelectivity double, detection_counts int")
    a = f.select("table", "feature_id", F.concat("table", F.lit("1")).alias("sample_id"), F.lit(5.0).alias("area"))
    anchors = spark.createDataFrame([("y", t + 2.0, t) for t in (10.0, 50.0, 60.0, 90.0, 120.0)], "table string, rtime double, ref_rtime double")
    out, matrix, lost = join_tables.join_tables(f, a, anchors)
    assert sorted(sorted(m.feature_id for m in r.members) for r in out.collect()) == [["F1", "G1"], ["F2"], ["G2"]]
    assert matrix.count() == 4 and lost.count() == 0
    assert join_tables.merge_by_time(f).select("merged").distinct().count() == 3


def test_sql_functions(spark):
    udfs.register(spark)
    y = gaussian(np.arange(300), 2e6, 150, 5).astype(int).tolist()
    spark.createDataFrame([(1, y)], "k int, intensity array<bigint>").createOrReplaceTempView("tracks")
    assert [r.apex for r in spark.sql("SELECT apex FROM tracks, LATERAL detect_peaks(intensity)").collect()] == [150]
    s = "array(named_struct('mz', 50D, 'intensity', 2D))"
    assert spark.sql(f"SELECT spectrum_cosine({s}, {s}) AS c").first().c == pytest.approx(1.0)


def test_streaming(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "in"))
    q = ingest.append_tracks(ingest.points_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("sample_id", "track").distinct().count() == 3 * len(PEAKS)
