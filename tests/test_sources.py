"""Readers, reshaping, scalars, sinks and the plans on small inputs."""

import csv
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake import cli, sinks
from curvelake.functions import scalars as S
from curvelake.kernels.dose import hill
from curvelake.kernels.growth import stable_seed
from curvelake.kernels.slope import median_slope
from curvelake.ml import classifier
from curvelake.operators import augment, fit, grid, labels, metrics, reshape, signal
from curvelake.plans import analysis
from curvelake.sinks import append_run, write_ordered_csv, zip_export
from curvelake.sources import readers, sheets
from curvelake.sources.synthetic import sample_long, sample_wide, synthetic_curves


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,want", [(0.01, "0.01"), (30.0, "30"), (1e-5, "1e-05"), (123456789.0, "1.23457e+08"), (0.0, "0"), (-2.5, "-2.5"), (100000.0, "100000"), (1e6, "1e+06"), (None, None), (0.1 + 0.2, "0.3")])
def test_fmt_g(spark, value, want):
    assert one(spark, value, "double", S.fmt_g) == want


@pytest.mark.parametrize("text,want", [("1h 30m", 1.5), ("90m", 1.5), ("0,5", 0.5), ("t0", 0.0), ("to", 0.0), ("", 0.0), ("45s", 0.0125), ("x", None), (None, None), ("2", 2.0)])
def test_durations(spark, text, want):
    assert one(spark, text, "string", S.duration_hours) == (pytest.approx(want) if want is not None else None)


def test_scalars(spark):
    assert one(spark, "A[Conc=0.3]", "string", S.conc_from_id) == 0.3 and one(spark, "A[x]", "string", S.conc_from_id) is None
    assert one(spark, "GFP (A01)", "string", S.well_of) == "A01" and one(spark, "GFP (A01)", "string", S.condition_of) == "GFP"
    assert [one(spark, x, "string", S.label_of) for x in ("yes", "0", "Unsure", "?")] == ["Valid", "Invalid", "Unsure", None]
    assert one(spark, "key", "string", S.stable_seed) == stable_seed("key")
    assert one(spark, 0.4, "double", lambda x: S.lam_to_spar(S.spar_to_lam(x))) == pytest.approx(0.4)
    assert reshape.header_of_time(0.5) == "T0.5 (h)" and reshape.header_of_time(14.75) == "T14.75 (h)" and reshape.header_of_time(3.0) == "T3.0 (h)"
    assert [reshape.time_of_header(h) for h in ("T15.0(h)", "t 1 (h)", "T0.5 (hours)", "0.5 h", "Test Id")] == [15.0, 1.0, 0.5, 0.5, None]
    assert [augment.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_wide_csv_round_trip(spark, tmp_path):
    wide = sample_wide(spark)
    wide.coalesce(1).write.option("header", True).csv(str(tmp_path / "w.csv"))
    long = readers.read_any(spark, str(tmp_path / "w.csv"))
    assert long.count() == 6 * 17 and long.select("curve_key").distinct().count() == 6
    again = reshape.long_to_wide(long, ["curve_id", "concentration"])
    assert set(reshape.time_columns(again)) == set(reshape.time_columns(wide)) and again.count() == 6


def test_time_table(spark, tmp_path):
    sample_long(spark).coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    long = readers.read_any(spark, str(tmp_path / "t.csv"))
    assert long.count() == 6 * 13 and {r[0] for r in long.select("concentration").distinct().collect()} == {0.0, 0.1, 0.3, 1.0, 3.0, 10.0}
    seconds = spark.createDataFrame([("0", "1", "5", "9"), ("1800", "2", "6", "x"), ("3600", "3", "7", "")], ["Avg. time [s]", "GFP (A01)", "RFP (B02)", "Dead (C03)"])
    plate = readers.from_plate(seconds, "p")
    assert {(r.curve_id, r.model_name, r.time_h) for r in plate.collect()} == {(c, m, t) for c, m in (("A01", "GFP"), ("B02", "RFP")) for t in (0.0, 0.5, 1.0)}


def test_v_columns_blocks_and_workbook(spark, tmp_path):
    v = readers.from_v_columns(spark.createDataFrame([("T1", "2", "0.1", "0.2")], ["Test_Id", "V3", "V4", "V5"]), "v")
    assert sorted((r.curve_id, r.time_h, r.od) for r in v.collect()) == [("T1_C2", 0.0, 0.1), ("T1_C2", 0.25, 0.2)]
    cells = [("junk", 0, 0), ("Tiempo", 1, 0), ("a", 1, 1), ("Time", 1, 2), ("b", 1, 3), ("0", 2, 0), ("0.5", 2, 1), ("1h", 2, 2), ("0.7", 2, 3)]
    grid = [[next((t for t, r, c in cells if (r, c) == (row, col)), None) for col in range(4)] for row in range(3)]
    assert [(r[0], r[1], r[-2], r[-1]) for r in sheets.long_rows("s", grid)] == [("s__b1", "c1", 0.0, "0.5"), ("s__b2", "c1", 1.0, "0.7")]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [["Time (h)", "A01", "A02"], [0, 0.1, 0.2], [1, 0.3, 0.4]]
    xml = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{"ABC"[j]}{i + 1}" ' + (f't="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f"><v>{x}</v></c>") for j, x in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{xml}</sheetData></worksheet>")
    book = readers.read_any(spark, str(tmp_path / "b.xlsx"))
    assert sorted((r.curve_id, r.time_h, r.od) for r in book.collect()) == [("A01", 0.0, 0.1), ("A01", 1.0, 0.3), ("A02", 0.0, 0.2), ("A02", 1.0, 0.4)]
    for name in ("x.doc", "x.xls"):
        with pytest.raises(ValueError):
            readers.read_any(spark, name)


def test_sparse_and_flat_curves(spark):
    rows = [("one", 1.0, 0.5), ("flat", 0.0, 0.2), ("flat", 8.0, 0.2), ("dup", 0.0, 1.0), ("dup", 0.0, 3.0), ("dup", 1.0, 4.0), ("nulls", None, 1.0), ("nulls", 1.0, None)]
    obs = spark.createDataFrame(rows, "curve_key string, time_h double, od double")
    g = {(r.curve_key, r.time_h): r.od for r in grid.grid_interpolate(obs).collect()}
    assert g["one", 1.0] is None and g["flat", 4.0] == 0.2 and g["flat", 8.5] is None and g["dup", 0.5] == 3.0 and g["nulls", 1.0] is None
    assert {r.od for r in signal.normalize(obs.where("curve_key = 'flat'")).collect()} == {0.0}
    stats = {r.curve_key: r for r in grid.point_stats(obs).collect()}
    assert stats["one"].missing_frac == 0.0 and stats["one"].max_gap is None and stats["flat"].expected == 17 and "nulls" not in stats
    assert grid.grid_interpolate(obs.where("false")).count() == 0


def test_votes_leave_missing_members_out(spark):
    df = spark.createDataFrame([(0.9, None), (None, None), (0.2, 0.4)], "a double, b double")
    got = [(r.confidence_valid, r.pred_label) for r in labels.ensemble(df, {"a": 0.75, "b": 0.25}).collect()]
    assert got == [(0.9, "Valid"), (None, None), (0.25, "Invalid")]


def test_train_label_fit_export(spark, tmp_path):
    synth = synthetic_curves(spark, 160, partitions=4)
    assert synth.select("curve_key").distinct().count() == 160
    assert synth.agg(F.sum("od")).first()[0] == pytest.approx(synthetic_curves(spark, 160, partitions=7).agg(F.sum("od")).first()[0])
    table = analysis.training_table(synth.drop("subtype", "model_name")).persist()
    assert analysis.check_training_table(table) == {"repeated": 0, "unlabelled": 0, "mixed": 0}
    trained = classifier.train(table, trees=20, boosts=5)
    test = {r["model"]: r["balanced_accuracy"] for r in trained["metrics"] if r["split"] == "test" and r["slice"] == "overall"}
    assert {r["slice"] for r in trained["metrics"]} >= {"overall", "train_horizon", "is_censored", "too_sparse"} and all(r["n"] >= 5 for r in trained["metrics"])
    with pytest.raises(ValueError):
        classifier.model_matrix(table.drop("observed_tmax"))
    assert set(test) == {"LR", "RF", "HGB"} and max(test.values()) > 0.65
    classifier.save(trained, f"file://{tmp_path}/models", spark)
    assert list(classifier.discover(f"file://{tmp_path}", spark)) == ["models"] and (tmp_path / "models" / "train_metrics.csv").read_text().startswith("model,split,slice")
    trained = classifier.load(f"file://{tmp_path}/models", spark)
    obs = synth.where("curve_key in ('syn_1', 'syn_2', 'syn_3', 'syn_4', 'syn_5', 'syn_6', 'syn_7', 'syn_8')").withColumn("test_id", F.lit("P")).withColumn("concentration", F.substring("curve_key", 5, 1).cast("double"))
    labelled = analysis.label_curves(obs, trained).persist()
    assert labelled.count() == 8 and {r.final_label for r in labelled.collect()} <= {"Valid", "Invalid", "Unsure"}
    tables = analysis.fit_curves(obs, labelled, include_unsure=True, include_invalid=True, bootstrap=False)
    raw = zip_export({"gc_fit": tables["gc_fit"], "dr_fit": tables["dr_fit"]}, {"curves": 8})
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert set(z.namelist()) == {"gc_fit.csv", "dr_fit.csv", "manifest.csv", "run_info.json"} and b"mu.spline" in z.read("gc_fit.csv")
    alone = classifier.predict(analysis.curve_features(obs), trained, "RF").select("p_rf", "confidence_valid").collect()
    assert all(abs(r.p_rf - r.confidence_valid) < 1e-4 for r in alone)
    audit = labelled.select("curve_key", "pred_label", "final_label", F.when(F.col("curve_key") == "syn_1", "Valid").otherwise("Unsure").alias("true_label"))
    results, auditing = analysis.export_tables(obs, audit, tables, "Valid", include_unsure=True, fits="spline")
    assert {r.curve_key for r in results["gcFit"].collect()} <= {"syn_1"} and set(auditing) == {"classifier_audit", "grofit_input", "gc_audit", "dr_audit"}
    with zipfile.ZipFile(io.BytesIO(zip_export(auditing, {"label": "Valid"}))) as z:
        assert {"classifier_audit.csv", "grofit_input.csv", "dr_audit.csv", "run_info.json"} <= set(z.namelist())
    assert set(analysis.fit_curves(obs, fits="m", bootstrap=False)) == {"gc_model", "gc_fit", "dr_gate", "dr_fit", "dr_audit"}
    write_ordered_csv(tables["gc_fit"], str(tmp_path / "csv"), ["curve_key"])
    append_run(spark, str(tmp_path / "log"), {"n": 1})
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 8 and spark.read.text(str(tmp_path / "log")).count() == 1
    assert np.isfinite(tables["gc_fit"].agg(F.avg("mu")).first()[0])


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    """Rows of many tasks and pieces in one ordered member; quotes, line breaks and nulls come back; CRCs are right."""
    monkeypatch.setattr(sinks, "_CHUNK", 4000)
    df = spark.range(5000).select(F.format_string("k%05d", 4999 - F.col("id")).alias("curve_key"), (F.col("id") / 8).alias("mu"), F.when(F.col("id") % 3 == 0, F.lit('a "b", c')).alias("note"), F.array("id").alias("left_out")).repartition(6)
    sinks.write_archive(spark, f"file://{tmp_path}/x.zip", {"fit": df, "none": df.where("false")}, {"seed": 1}, {"fit": ["curve_key"]})
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.testzip() is None and z.namelist() == ["fit.csv", "none.csv", "manifest.csv", "run_info.json"]
        rows = list(csv.reader(io.StringIO(z.read("fit.csv").decode())))
        assert z.read("manifest.csv").decode() == "table,rows\nfit,5000\nnone,0\n" and z.read("none.csv").decode() == "curve_key,mu.spline,note\n"
    assert rows[0] == ["curve_key", "mu.spline", "note"] and [r[0] for r in rows[1:]] == [f"k{k:05d}" for k in range(5000)]
    assert {(r[1], r[2]) for r in rows[1:]} == {(str(k / 8), 'a "b", c' if k % 3 == 0 else "") for k in range(5000)}


def test_ordered_csv_and_training_scan(spark, tmp_path):
    """Ordered CSV artefacts train as Parquet ones do."""
    lines = ["FileName,Test Id,Is_Valid," + ",".join(f"T{t / 2} (h)" for t in range(33))]
    lines += [f"f,c{k},{'yes' if k % 2 else 'no'}," + ",".join(str(round(0.1 + 0.02 * t * (k % 2) + 0.001 * (k * t % 7), 4)) for t in range(33)) for k in range(30)]
    (tmp_path / "syn.csv").write_text("\n".join(lines) + "\n")
    for flags, kind in (([], "parquet"), (["--csv"], "csv")):
        cli.main(["build-train-meta", f"{tmp_path}/{kind}", str(tmp_path / "syn.csv"), *flags], spark)
    tables = [sinks.read_table(spark, f"{tmp_path}/{kind}/training_meta") for kind in ("parquet", "csv")]
    assert tables[0].columns == tables[1].columns and tables[0].count() == tables[1].count() > 60
    parts = sorted((tmp_path / "csv" / "raw_merged").glob("part-*.csv"))
    keys = [r["curve_key"] for p in parts for r in csv.DictReader(p.open())]
    assert keys == sorted(keys) and len(keys) == 30
    matrices = [sorted(map(repr, classifier.model_matrix(t).collect())) for t in tables]
    assert matrices[0] == matrices[1]


def test_dose_bootstrap_without_crossings(spark):
    """Tests of too few doses, and chunks of replicates without any EC50, give rows of rate 0."""
    doses = [0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]
    rows = [("few", d, 1.0) for d in doses[:3]] + [("flat", d, 1.0) for d in doses] + [("good", d, hill(np.array([d]), 0.0, 1.0, 3.0, 1.2)[0].item()) for d in doses for _ in range(2)]
    responses = spark.createDataFrame(rows, "test_id string, concentration double, response double")
    got = {r.test_id: r for r in fit.dose_bootstrap(responses, chunk=7).collect()}
    assert got["few"].n == 0 and got["few"].crossing_rate == 0 and got["few"].mean is None
    assert got["good"].n > 100 and got["good"].ci_lo <= 3.0 * 1.5 and got["good"].crossing_rate == got["good"].n / 300 and "flat" in got


def test_median_slope():
    """Exact at any size: closing in on the middle ranks gives what sorting all slopes gives."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40):
        t, y = rng.integers(0, 20, n) / 2.0, rng.normal(size=n).round(1)
        every = [(y[j] - y[i]) / (t[j] - t[i]) for i in range(n) for j in range(n) if t[j] > t[i]]
        want = float(np.median(every)) if every else None
        for most in (1 << 20, 50, 3):
            assert median_slope(t, y, most) == (pytest.approx(want, abs=1e-12) if want is not None else None)


def test_curves_without_groups(spark):
    """AUC and average precision over one group whose scores lie in many ranges, with ties."""
    rng = np.random.default_rng(2)
    p, y = rng.integers(0, 300, 2000) / 300, rng.integers(0, 2, 2000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap = sum(((p == s) & (y == 1)).sum() * (y[p >= s].mean()) for s in np.unique(p)) / len(pos)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)


def _same(spark, path):
    """The scan of whole files gives what the reader of one file gives."""
    columns = ["file_name", "curve_id", "model_name", "is_valid", "concentration", "time_h", "od", "curve_key"]
    both = [sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) for df in (readers.read_any(spark, str(path)), sheets.read_sheets(spark, str(path)))]
    assert both[0] == both[1] and both[0], path


def test_scan_equals_single_readers(spark, tmp_path):
    files = {
        "wide.csv": "Test Id,Concentration,Is_Valid,T0.0 (h),T0.5(h),t 1 (h)\na,\"0,5\",yes,0.1,0.2,x\nb,,no,,0.4,\"0,7\"\n",
        "ids.csv": "Is_Valid,T0.0 (h)\n,0.1\nmaybe,0.2\n,0.3\n",
        "tagged.csv": "Test Id,T0.0 (h)\nW[Conc=0.3],1\nW[2],2\n",
        "hours.csv": "Time (h),A01[0.1],B,Reading 1\n0,1,2,3\n0.5,2,x,4\n1,3,4,5\n",
        "minutes.csv": "time,A,B\n0,1,2\n30,2,3\n60,3,4\n90,5,6\n",
        "seconds.csv": "time,A\n0,1\n1800,2\n3600,3\n",
        "durations.csv": "time,A\nt0,1\n1h 30m,2\n90m,3\n2h,4\n",
        "v.csv": "Test_Id,V3,V4,V5\nT1,2,0.1,0.2\nT2,3,0.3,\n",
        "v2.csv": "V3,V4,V5\n2,0.1,0.2\n3,0.3,0.4\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        _same(spark, tmp_path / name)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "odd.csv").write_text("a,b\nx,y\n")
    whole = readers.read_any(spark, str(tmp_path))
    assert whole.count() == sum(readers.read_any(spark, str(tmp_path / f)).count() for f in files)
    with pytest.raises(Exception, match="no known layout"):
        sheets.read_sheets(spark, str(tmp_path), strict=True).count()


def test_many_files_are_one_stage(spark, tmp_path):
    """Hundreds of files of different headers: one scan, one branch, every file's rows; old ids stay file positions."""
    for k in range(300):
        times = [0.0, 0.5, 1.0 + k % 3]
        rows = [f"{'f' if k % 2 else ''},c{k},{'yes' if k % 5 else 'no'}," + ",".join(f"{k + t}" for t in times)]
        (tmp_path / f"{'syn' if k % 7 == 0 else 'lab'}{k}.csv").write_text("FileName,Test Id,Is_Valid," + ",".join(f"T{t} (h)" for t in times) + "\n" + "\n".join(rows) + "\n")
    got = readers.read_training(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 1 and "Union" not in plan and "Exchange" not in plan
    rows = got.collect()
    assert len(rows) == 900 and {r.curve_id for r in rows} == {f"c{k}" for k in range(300)} and all(r.od == int(r.curve_id[1:]) + r.time_h for r in rows)
    assert {r.curve_id for r in rows if r.source_type == "synthetic"} == {f"c{k}" for k in range(0, 300, 7)} and {r.is_valid for r in rows} == {True, False}


def test_row_index_and_missing_files(spark, tmp_path):
    """Missing ids are positions in the file whatever the splits; files that aren't there are skipped; validity has a default."""
    df = spark.createDataFrame([(float(i),) for i in range(23)], ["T0.0 (h)"]).repartition(1)
    for parts in (1, 5):
        ids = {r.od: r.curve_id for r in readers.from_wide(df.coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize([(float(i),) for i in range(23)], parts), ["T0.0 (h)"]), "s").collect()}
        assert ids == {float(i): f"row_{i}" for i in range(23)} or parts == 1
    (tmp_path / "a.csv").write_text("FileName,Test Id,Is_Valid,T0.0 (h)\nf,a,yes,0.1\n")
    assert readers.read_training(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")]).count() == 1
    with pytest.raises(ValueError):
        readers.read_training(spark, [str(tmp_path / "none.csv")])
    tidy = spark.createDataFrame([("t", "a"), ("t", "b")], "test_id string, curve_id string")
    known = spark.createDataFrame([("t", "a", True)], "test_id string, curve_id string, is_valid boolean")
    assert {r.curve_id: r.is_valid for r in labels.attach_validity(tidy, known).collect()} == {"a": True, "b": False}
    rows = spark.createDataFrame([("a", "Valid"), ("b", "Invalid"), ("c", "Valid")], "curve_key string, pred_label string")
    review = spark.createDataFrame([("a", True, "Valid"), ("b", True, "Valid"), ("c", False, "Valid")], "curve_key string, reviewed boolean, true_label string")
    assert tuple(labels.review_counts(rows, review).first()) == (3, 2, 1)
    assert [S.bootstrap_method(x) for x in (" Residual", "pairs", None, 3)] == ["residual", "pairs", "pairs", "pairs"]


def test_curve_ids_and_fit_input(spark):
    """Ids built from file, curve and dose; repeated ids numbered; points as fits read them; labels joined also where the dose is unknown."""
    df = spark.createDataFrame([("plate 1.csv", "A 1", 0.5, 1), ("plate 1.csv", "A 1", 0.5, 2), ("p", "B[Conc=3]", None, 3)], "file_name string, curve_id string, concentration double, n int")
    ids = df.select("*", augment.base_curve_id(F.col("file_name"), F.col("curve_id"), F.col("concentration")).alias("base"))
    unique = {r.n: r.base for r in augment.unique_ids(ids, "base", "n").collect()}
    assert unique[2] == unique[1] + "_2" and len(set(unique.values())) == 3 and " " not in "".join(unique.values())
    points = df.withColumn("time_h", F.col("n") * 8.5).withColumn("od", F.when(F.col("n") != 2, F.lit(0.1)))
    assert sorted((r.test_id, r.concentration, r.time) for r in reshape.fit_tidy(points).collect()) == [("p", 3.0, 25.5), ("plate 1.csv", 0.5, 8.5)]
    early, late = grid.split_windows(points)
    assert early.count() == 1 and late.count() == 2
    audit = spark.createDataFrame([("A 1", 0.5, "Valid"), ("B[Conc=3]", None, "Unsure")], "curve_id string, concentration double, true_label string")
    assert {r.n: r.true_label for r in labels.fit_input(df, audit).collect()} == {1: "Valid", 2: "Valid", 3: "Unsure"}


def test_savgol_windows(spark):
    """A parabola passes any window unchanged; weights of 5 points are the known ones."""
    assert np.allclose(np.array(signal.savgol_weights(5, 2)) * 35, [-3, 12, 17, 12, -3]) and np.allclose(np.array(signal.savgol_weights(5, 0)) * 35, [31, 9, -3, -5, 3])
    points = spark.createDataFrame([("k", float(t), 1.0 + t - 0.3 * t * t) for t in range(12)], "curve_key string, time_h double, od double")
    for window in (1, 3, 4, 7, 11, 12):
        got = {r.time_h: r.od for r in signal.savgol_smooth(points, window).collect()}
        assert all(got[t] == pytest.approx(1 + t - 0.3 * t * t) for t in got) and len(got) == 12


def test_training_stages(spark):
    tables = analysis.training_stages(synthetic_curves(spark, 12, partitions=2).drop("subtype", "model_name"))
    assert tables["raw_merged"].count() == 12 and len(reshape.time_columns(tables["final_merged"])) == 33
    assert tables["final_merged"].count() == tables["training_meta"].count() > 24


def test_training_csv_and_blanks(spark, tmp_path):
    (tmp_path / "syn.csv").write_text("FileName,Test Id,Model Name,Is_Valid,T0.0 (h),T0.5 (h)\nf,a,m,yes,0.1,0.2\nf,b,m,,0.3,x\n")
    (tmp_path / "blank.csv").write_text("FileName,already_blank_subtracted,blank_value\nf,raw,0.05\ng,yes,\n")
    rows = readers.read_training(spark, [str(tmp_path / "syn.csv")]).collect()
    assert {(r.curve_id, r.is_valid, r.source_type) for r in rows} == {("a", True, "synthetic"), ("b", False, "synthetic")} and len(rows) == 3
    blanks = readers.read_blank_status(spark, str(tmp_path / "blank.csv"))
    points = spark.createDataFrame([("k", "f", 0.0, 0.25), ("l", "g", 0.0, 0.25)], "curve_key string, file_name string, time_h double, od double")
    assert {r.curve_key: round(r.od, 6) for r in signal.baseline_by_file(points, blanks).collect()} == {"k": 0.2, "l": 0.25}
