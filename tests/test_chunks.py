"""Chunked series, moments from shifted series, feature combinations, generated gaps, channel statistics and imperfect data."""

import math
import time
import warnings
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from laglake.operators import chunks as C
from laglake.operators import forecast as FC
from laglake.operators import metrics as MET
from laglake.operators.grid import fill_date, grid
from laglake.operators.moments import gram_matrices, gram_rows
from laglake.operators.quantiles import channel_statistics
from laglake.operators.split import chrono_split
from laglake.operators.windows import make_windows
from laglake.plans.experiment import prepare_dataset, run_single
from laglake.sources.csv_scan import write_series_csv
from laglake.spec import DatasetSpec, WindowSpec


def day(i):
    return datetime(2020, 1, 1) + timedelta(days=i)


def gappy(spark, n=300, seed=1, keys=("a", "b")):
    """Two channels; some days missing, some values NULL or NaN-free, a series shorter than the others."""
    r = np.random.default_rng(seed)
    rows = []
    for k, key in enumerate(keys):
        for i in range(n - 40 * k):
            if r.random() < 0.9:
                rows.append((key, day(i), None if r.random() < 0.03 else float(r.normal()), None if r.random() < 0.03 else float(r.normal(5, 2))))
    return spark.createDataFrame(rows, "segment string, ts timestamp_ntz, p double, q double").repartition(3)


@pytest.mark.parametrize("spec, channels, targets, steps", [
    (WindowSpec(4, 2, 3), ["p"], ["q"], 16), (WindowSpec(1, 1, 1), [], ["q"], 7), (WindowSpec(6, 3, 3), ["p", "q"], ["q", "p"], 4096)])
def test_chunks_give_the_windows_and_their_moments(spark, spec, channels, targets, steps):
    df = gappy(spark)
    w, _ = chrono_split(make_windows(df, "segment", "ts", channels, targets, spec, strategy="range", on_grid=True), "segment", spec.ratios)
    c = C.with_split(C.chunk_series(df, "segment", "ts", channels, targets, spec, steps), "segment", channels, targets, spec).cache()
    cols = ["segment", "ts", "tus", "x", "y", "rn", "n", "split"]
    cut = C.cut_windows(c, "segment", "ts", channels, targets, spec).select(cols)
    assert cut.count() == w.count() > 50
    assert cut.exceptAll(w.select(cols)).isEmpty()
    want = gram_matrices(gram_rows(w))
    got = gram_matrices(C.lag_gram(c, channels, targets, spec, splits=("train", "val", "test")))
    assert set(got) == set(want)
    for s in want:
        assert np.allclose(got[s], want[s], rtol=1e-11, atol=1e-9)


def test_predictions_from_chunks(spark):
    spec, df = WindowSpec(4, 2, 2), gappy(spark)
    w, _ = chrono_split(make_windows(df, "segment", "ts", ["p"], ["q"], spec, strategy="range", on_grid=True), "segment", spec.ratios)
    coef = FC.coefficient_table(spark, "m", np.arange(18, dtype=float).reshape(9, 2))
    c = C.with_split(C.chunk_series(df, "segment", "ts", ["p"], ["q"], spec), "segment", ["p"], ["q"], spec)
    want = {(r.segment, r.ts): (r.y, r.yhat) for r in FC.predict(w.where("split = 'test'"), coef).collect()}
    got = {(r.segment, r.ts): (r.y, r.yhat) for r in C.predict_chunks(c, coef, "segment", "ts", ["p"], ["q"], spec).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k][0], want[k][0]) and np.allclose(got[k][1], want[k][1]) for k in want)


def test_chunk_bytes_do_not_grow_with_the_lag(spark):
    df = spark.range(60_000).select(F.lit("a").alias("segment"), F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, cast(id as int), 0)").alias("ts"), F.rand(1).alias("q"))
    values = {}
    for lag in (8, 64, 512):
        c = C.chunk_series(df, "segment", "ts", [], ["q"], WindowSpec(lag, minutes=1))
        values[lag] = c.agg(F.sum(F.size("pos"))).first()[0]
    assert all(60_000 <= n <= 1.08 * 60_000 for n in values.values())


def test_moments_take_time_linear_in_the_lag():
    r = np.random.default_rng(0)
    v, took = r.normal(size=(1, 200_000)), {}
    for span in (128, 512):
        t = time.perf_counter()
        s = C.Shifts(1, span)
        s.add(v, np.arange(span, v.shape[1]))
        m = s.matrix(np.arange(span, 0, -1), np.array([0]))
        took[span] = time.perf_counter() - t
        z = np.lib.stride_tricks.sliding_window_view(v[0], span + 1)
        z = np.concatenate([z[:, :-1], np.ones((len(z), 1)), z[:, -1:]], axis=1)
        some = [0, 1, span // 2, span - 1, span, span + 1]
        assert np.allclose(m[np.ix_(some, some)], z[:, some].T @ z[:, some], rtol=1e-10, atol=1e-6)
    assert took[512] < 8 * took[128] + 0.2


def test_chunks_refuse_double_and_off_grid_rows(spark):
    spec = WindowSpec(2)
    twice = spark.createDataFrame([("a", day(1), 1.0), ("a", day(1), 2.0)], "segment string, ts timestamp_ntz, q double")
    with pytest.raises(Exception, match="same key and timestamp"):
        C.chunk_series(twice, "segment", "ts", [], ["q"], spec).collect()
    off = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2) + timedelta(hours=1), 2.0)], "segment string, ts timestamp_ntz, q double")
    with pytest.raises(Exception, match="off the series' grid"):
        C.chunk_series(off, "segment", "ts", [], ["q"], spec).collect()
    none = twice.where("false")
    assert C.with_split(C.chunk_series(none, "segment", "ts", [], ["q"], spec), "segment", [], ["q"], spec).isEmpty()


def test_each_combination_equals_its_own_fit(spark):
    r = np.random.default_rng(2)
    rows = [("a", day(i), *map(float, r.normal(size=4))) for i in range(200)]
    df = spark.createDataFrame(rows, "segment string, ts timestamp_ntz, f1 double, f2 double, f3 double, q double")
    spec, features = WindowSpec(3), ["f1", "f2", "f3"]
    c = C.with_split(C.chunk_series(df, "segment", "ts", features, ["q"], spec), "segment", features, ["q"], spec)
    fits = FC.fit_combinations(gram_matrices(C.lag_gram(c, features, ["q"], spec)), features, ["q"], 2, 3, 1, lambdas=(0.0, 5.0))
    assert list(fits) == [("f1", "f2"), ("f1", "f3"), ("f2", "f3")]
    for pair, m in fits.items():
        w, _ = chrono_split(make_windows(df, "segment", "ts", list(pair), ["q"], spec, strategy="range"), "segment", spec.ratios)
        alone = FC.fit(w, lambdas=(0.0, 5.0), L=3, F_=3, A=1)
        assert np.allclose(m["weights"], alone["weights"]) and m["lambda"] == alone["lambda"]


# ---- gaps

def test_gaps_equal_the_joined_grid(spark):
    r = np.random.default_rng(5)
    rows = [(k, datetime(2020, 1, 1) + timedelta(minutes=int(m)), float(m)) for k in ("a", "b", None) for m in np.unique(r.integers(0, 4000, 60))]
    df = spark.createDataFrame(rows, "segment string, ts timestamp_ntz, v double")
    got = fill_date(df, "segment", "ts", 60, chunk_steps=7)
    known = df.where("segment IS NOT NULL")
    want = known.join(grid(known, "segment", "ts", 60), ["segment", "ts"], "full_outer").select("segment", "ts", "v")
    assert got.columns == ["segment", "ts", "v"]
    assert got.where("segment IS NOT NULL").exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("segment IS NULL").count() > 60   # series without a key are filled too
    assert "FullOuter" not in got._jdf.queryExecution().toString()


def test_a_long_gap_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(20_000), 2.0), ("a", day(20_000), 3.0)], "segment string, ts timestamp_ntz, v double")
    got = fill_date(df, "segment", "ts", 1440, chunk_steps=64)
    assert got.count() == 20_002 and got.select("ts").distinct().count() == 20_001 and got.where("v IS NOT NULL").count() == 3
    assert fill_date(df.where("false"), "segment", "ts", 1440).count() == 0


# ---- statistics

def test_channel_statistics_are_exact(spark):
    r = np.random.default_rng(7)
    data = {"normal": r.normal(1e6, 3, 30_000), "ties": r.integers(0, 3, 30_000).astype(float), "heavy": r.lognormal(0, 8, 30_000), "one": np.full(30_000, 4.5)}
    data["heavy"][5] = math.inf
    rows = list(zip(*[x.tolist() for x in data.values()], [None] * 30_000, [math.nan] + [1.0, 2.0] * 14_999 + [3.0], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data) + ", nothing double, nan double").repartition(6)
    asked = {"median": "median", "q25": 0.25, "q75": 0.75, "q999": 0.999, "q0": 0.0, "q1": 1.0}
    for few in (200_000, 10):   # ranks found on the driver, and by bins
        got = channel_statistics(df, df.columns, asked, collect_rows=few)
        assert list(got) == [*data, "nan"]
        for c, x in data.items():
            s = np.sort(x)
            assert got[c]["median"] == (s[14_999] + s[15_000]) / 2
            for name, q in (("q25", 0.25), ("q75", 0.75), ("q999", 0.999), ("q0", 0.0), ("q1", 1.0)):
                assert got[c][name] == s[int(29_999 * q + 0.5)], (c, name)
            if c != "heavy":
                assert got[c]["mean"] == pytest.approx(x.mean()) and got[c]["variance"] == pytest.approx(x.var(ddof=1), abs=1e-9)
        assert math.isnan(got["nan"]["q1"]) and got["nan"]["q25"] == 1.0 and math.isnan(got["nan"]["max"])


# ---- imperfect data

def test_missing_predictions_are_left_out_of_every_metric(spark):
    rows = [("m", 0, 10.0, 0.0), ("m", 0, 1.0, None), ("m", 1, 3.0, 3.0), ("m", 1, 5.0, 4.0), ("m", 0, 2.0, 2.0), ("m", 0, None, 7.0)]
    df = spark.createDataFrame(rows, "model string, h int, y double, yhat double")
    own = {f"own_{k}": f for k, f in MET.POOLED.items()}
    got = MET.score(df, ["model"], metrics=(*MET.ALL_METRICS, *own), extra=own, counts=True).first()
    assert (got.n, got.n_missing) == (4, 2) and got.mae == pytest.approx(11 / 4)
    assert all(got[k] == pytest.approx(got[f"own_{k}"]) for k in MET.POOLED)
    assert got.r2 == pytest.approx(MET.r2_per_horizon(df, ["model"]).first().r2)


def test_an_ensemble_needs_every_model(spark):
    rows = [("a", 1, 0, 4.0, 2.0), ("b", 1, 0, 4.0, 6.0), ("a", 2, 0, 1.0, 1.0), ("b", 2, 0, 1.0, None), ("a", 3, 0, 1.0, 1.0)]
    pred = spark.createDataFrame(rows, "model string, k int, h int, y double, yhat double")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, r2 double")
    assert {r.k: r.yhat for r in MET.ensemble(pred, scores, ["k"]).collect()} == {1: 4.0, 2: None, 3: None}


def test_a_lambda_is_not_chosen_without_validation(spark):
    w, _ = chrono_split(make_windows(gappy(spark), "segment", "ts", [], ["q"], WindowSpec(2), strategy="range", on_grid=True), "segment", (0.8, 0.0, 0.2))
    with pytest.raises(ValueError, match="no validation windows"):
        FC.fit(w, lambdas=(0.0, 1.0), L=2, A=1)
    assert FC.fit(w, lambdas=(1.0,), L=2, A=1)["lambda"] == 1.0


def test_constant_channels_leave_a_model(spark, tmp_path):
    r = np.random.default_rng(9)
    x = np.cumsum(r.normal(size=400))
    rows = [("s", day(i), 7.0, float(x[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "segment string, date timestamp_ntz, flat double, q double")
    out = {}
    for name, features in (("with", ("flat",)), ("without", ())):
        spec = DatasetSpec(path="", target="q", date="date", features=features, segment="segment", name=name)
        for method in ("standard", "minmax"):
            with warnings.catch_warnings(record=True) as said:
                warnings.simplefilter("always")
                ds = prepare_dataset(spark, spec, WindowSpec(4), source=df, normalization=method)
                out[name, method] = {r.model: r.mse for r in run_single(spark, ds).collect()}
            assert any("scaled to 0: ['flat']" in str(s.message) for s in said) == (name == "with")
    for method in ("standard", "minmax"):
        assert out["with", method] == pytest.approx(out["without", method], rel=1e-6)


def test_moments_name_what_is_not_a_number(spark):
    df = spark.createDataFrame([("train", [1.0, math.nan], [1.0]), ("train", [2.0, 3.0], [1.0])], "split string, x array<double>, y array<double>")
    with pytest.raises(ValueError, match=r"train windows, at terms \[1\]"):
        gram_matrices(gram_rows(df))


@pytest.mark.parametrize("kind, lam", [("linear", 0.0), ("dlinear", 0.5), ("nlinear", 5.0)])
def test_shared_fits_end_where_the_gradient_is_small(kind, lam):
    """Noisy data of correlated channels: no step of any weight alone improves the fit, and alternating rounds end no lower."""
    r = np.random.default_rng(6)
    L, F_, A, n = 8, 4, 2, 500
    X = np.cumsum(r.normal(size=(n, L, F_)), axis=1) + r.normal(size=(n, 1, 1))
    Y = X[:, -1, :A] * 0.7 + r.normal(size=(n, A))
    z = np.concatenate([X.reshape(n, -1), np.ones((n, 1)), Y], axis=1)
    S = z.T @ z
    m = FC._Shared(S, L, F_, A, lam, kind)
    W = FC.fit_shared(S, L, F_, A, lam, kind, bound=1e-7)
    w, v, b = m.started(400)
    alternating = m.objective(w, v, b)
    residual = np.vstack([W, -np.eye(A)])
    assert float(np.sum(residual * (S @ residual))) <= alternating * (1 + 1e-9)
    g, H = m.normal(w, v, b)
    eps = 1e-5
    for k in range(0, len(g), 5):   # the gradient is that of the objective
        step = np.zeros(len(g))
        step[k] = eps
        up, down = m.objective(*m.moved(w, v, b, step)), m.objective(*m.moved(w, v, b, -step))
        assert (up - down) / (4 * eps) == pytest.approx(g[k], abs=1e-3 * np.sqrt(H[k, k] * alternating))


# ---- store of runs

def test_a_run_is_appended_once(spark, tmp_path):
    from laglake.sources.stores import append_run, committed_runs, read_runs
    path = str(tmp_path / "store")
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    with pytest.raises(ValueError, match="no whole run"):
        read_runs(spark, path)
    assert append_run(df, path, "a", partition_by=["k"]) and not append_run(df, path, "a", partition_by=["k"])
    assert read_runs(spark, path).count() == 100
    df.limit(40).write.parquet(f"{path}/rows/run=b")   # an attempt that broke off before its manifest entry
    assert read_runs(spark, path).count() == 100
    assert append_run(df.withColumn("more", F.lit(1.5)), path, "b", partition_by=["k"])
    both = read_runs(spark, path)
    assert both.count() == 200 and {r.run: r.n_rows for r in committed_runs(spark, path).collect()} == {"a": 100, "b": 100}
    assert both.where("run = 'a' AND more IS NULL").count() == 100 and both.where("more = 1.5").count() == 100
    assert read_runs(spark, path, ["b"]).where("k = 1").count() == 33
    with pytest.raises(ValueError, match="no run"):
        read_runs(spark, path, ["c"])
    assert append_run(df.where("false"), path, "none") and read_runs(spark, path, ["none"]).isEmpty()


# ---- command line

def test_zero_shot_from_the_command_line(spark, tmp_path):
    import json
    from laglake.__main__ import main
    r = np.random.default_rng(3)
    for name, step in (("near", 1), ("far", 2)):
        x = np.cumsum(r.normal(size=300)) * step
        (tmp_path / name).mkdir()
        (tmp_path / name / "7.csv").write_text("day,value\n" + "".join(f"{day(i):%Y-%m-%d},{v:.6f}\n" for i, v in enumerate(x)))
    about = tmp_path / "near.json"
    about.write_text(json.dumps({"path": str(tmp_path / "near"), "date": "day", "target": ["value"], "name": "near"}))
    common = ["--date", "day", "--target", "value", "--lag", "3", "--normalization", "standard", "--models", "linear", "nlinear"]
    out = str(tmp_path / "out")
    main(["--path", str(tmp_path / "near"), *common, "--out", out], spark)
    fitted = {r.model: r.mse for r in main(["--path", str(tmp_path / "far"), *common, "--sources", str(about)], spark).collect()}
    stored = {r.model: r.mse for r in main(["--path", str(tmp_path / "far"), *common, "--stored", out], spark).collect()}
    assert set(fitted) == {"linear", "nlinear", "Ensemble"} and fitted == pytest.approx(stored)
    with pytest.raises(SystemExit):
        main(["--path", "x", *common, "--sources", "a", "--stored", "b"], spark)
