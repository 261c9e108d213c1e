"""Cleaning, scaling, exact quantiles, sequence transforms, metrics, fits, sources, expansion."""

import datetime as dt
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from laglake.functions import sequence as S
from laglake.operators import forecast as FC
from laglake.operators import metrics as MET
from laglake.operators.expand import channel_catalogue, expand_cases, feature_combinations
from laglake.operators.prepare import dedupe_key, drop_incomplete, prepare, shrink_types, strip_time
from laglake.operators.quantiles import exact_quantiles
from laglake.operators.scale import apply_scaler, fit_scaler
from laglake.sources.csv_scan import read_series
from laglake.operators.windows import make_windows
from laglake.spec import DatasetSpec, StripTime, WindowSpec

T0 = dt.datetime(2024, 3, 1)


def test_fx3_null_vs_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert drop_incomplete(df).count() == 2


def test_fx4_null_in_unused_column_drops_row(spark):
    df = spark.createDataFrame([(T0, 1.0, None), (T0 + dt.timedelta(days=1), 2.0, "x")], "d timestamp_ntz, v double, junk string")
    spec = DatasetSpec(path="", target=("v",), date="d")
    assert prepare(df, spec).count() == 1
    assert prepare(df, spec, null_scope="used").count() == 2


def test_fx5_duplicate_key_survivor(spark):
    df = spark.createDataFrame([("a", T0, 5.0), ("a", T0, 3.0), ("a", T0, 3.0)], "s string, d timestamp_ntz, v double")
    out = dedupe_key(df, ["s", "d"]).collect()
    assert len(out) == 1 and out[0]["v"] == 3.0


def test_shrink_types_strict_bounds(spark):
    df = spark.createDataFrame([(0, 127, 1.5, "x"), (5, 3, 2.5, "y")], "a bigint, b bigint, c double, d string")
    out = shrink_types(df)
    types = dict(out.dtypes)
    assert types == {"a": "tinyint", "b": "smallint", "c": "float", "d": "string"}


def test_fx17_strip_formats(spark):
    rows = [(T0 + dt.timedelta(hours=h),) for h in range(0, 24 * 40, 5)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    got = strip_time(df, "d", StripTime("%Y-%m-%d", (2024, 3, 2), (2024, 3, 3))).collect()
    assert min(r["d"] for r in got) >= dt.datetime(2024, 3, 2) and max(r["d"] for r in got) < dt.datetime(2024, 3, 4)
    colon = strip_time(df, "d", StripTime("%Y:%m:%d", (2024, 3, 2), (2024, 3, 3))).count()
    assert colon == len(got)
    tod = strip_time(df, "d", StripTime("%H:%M", (8, 0), (9, 0))).collect()
    assert all(dt.time(8, 0) <= r["d"].time() <= dt.time(9, 0) for r in tod)
    # day-first format compares as text: '02/03/2024' <= x <= '03/03/2024' keeps every day-of-month 02 and 03
    dm = strip_time(df, "d", StripTime("%d/%m/%Y", (2024, 3, 2), (2024, 3, 3))).collect()
    assert {r["d"].day for r in dm} == {2, 3} and {r["d"].month for r in dm} == {3, 4}


def _nearest(sorted_vals, q):
    idx = (len(sorted_vals) - 1) * q
    k = int(math.floor(idx + 0.5))
    return sorted_vals[k]


def test_exact_quantiles_narrowing(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.lognormal(3, 1, 20000), 2)
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [("h", float(v)) for v in vals[:7]], "k string, v double")
    out = {r["k"]: r for r in exact_quantiles(df, "k", "v", {"median": "median", "q25": 0.25, "q75": 0.75, "q99": 0.99},
                                              bins=16).collect()}
    for k, data in (("g", vals), ("h", vals[:7])):
        s = sorted(data.tolist())
        assert out[k]["median"] == pytest.approx(float(np.median(data)))
        for name, q in (("q25", 0.25), ("q75", 0.75), ("q99", 0.99)):
            assert out[k][name] == _nearest(s, q), (k, name)


def test_fx11_constant_column_scaling(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")
    st = fit_scaler(df, ["v"], "minmax")
    assert apply_scaler(df, st, ["v"]).first()["v"] is None
    st2 = fit_scaler(df, ["v"], "standard")
    assert apply_scaler(df, st2, ["v"], "standard").first()["v"] is None
    assert apply_scaler(df, st, ["v"], "robust").first()["v"] == 0.0


def test_scaler_roundtrip(spark):
    df = spark.createDataFrame([(float(i) ** 1.5,) for i in range(50)], "v double")
    for m in ("minmax", "standard", "robust"):
        st = fit_scaler(df, ["v"], m)
        back = apply_scaler(apply_scaler(df, st, ["v"], m), st, ["v"], m, inverse=True)
        a = sorted(r["v"] for r in df.collect())
        b = sorted(r["v"] for r in back.collect())
        assert np.allclose(a, b, atol=1e-6 if m != "robust" else 1e-3)


def test_fx13_decompose_edges(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 10)],)], "x array<double>")
    r = df.select(S.decompose("x", 3).alias("d")).first()["d"]
    assert r["trend"][0] == pytest.approx(4 / 3) and r["trend"][-1] == pytest.approx(26 / 3)
    assert len(r["trend"]) == 9 and r["seasonal"][4] == pytest.approx(0.0)
    assert S.decomposition_kernel(8) == 3 and S.decomposition_kernel(9) == 3 and S.decomposition_kernel(12) == 5
    assert S.decomposition_kernel(5) == 25


def test_fx14_revin_constant_window(spark):
    df = spark.createDataFrame([([2.0] * 6,)], "x array<double>").withColumn("st", S.revin_stats("x"))
    r = df.select(S.revin_norm("x", "st.mean", "st.std").alias("n"),
                  S.revin_denorm(S.revin_norm("x", "st.mean", "st.std"), "st.mean", "st.std").alias("b")).first()
    assert r["n"] == [0.0] * 6 and r["b"] == pytest.approx([2.0] * 6)


def test_time2vec_matches_numpy(spark):
    rng = np.random.default_rng(1)
    L, k = 5, 3
    wa, ba, wb, bb = rng.normal(size=k), rng.normal(size=(L, k)), rng.normal(size=L), rng.normal(size=L)
    x = rng.normal(size=L)
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    got = np.array(df.select(S.time2vec("x", wa.tolist(), ba.tolist(), wb.tolist(), bb.tolist()).alias("f")).first()["f"])
    want = np.concatenate([np.sin(x[:, None] * wa[None, :] + ba), (wb * x + bb)[:, None]], axis=1)
    assert np.allclose(got, want)


def test_fx15_metrics(spark):
    rows = [("m", 0, 0, 0.0, 1.0), ("m", 0, 1, 2.0, 2.5), ("m", 1, 0, 0.0, 0.0), ("m", 1, 1, 4.0, 3.0),
            ("m", 2, 0, 3.0, 2.0), ("m", 2, 1, 1.0, 1.5)]
    df = spark.createDataFrame(rows, "model string, w int, h long, y double, yhat double")
    r = MET.score(df, ["model"]).first()
    y = np.array([[0.0, 2.0], [0.0, 4.0], [3.0, 1.0]])
    p = np.array([[1.0, 2.5], [0.0, 3.0], [2.0, 1.5]])
    assert r["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert r["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r["mape"] == pytest.approx(np.mean(np.abs(y - p) / np.maximum(np.abs(y), np.finfo(np.float64).eps)))
    assert math.isnan(r["smape"])
    r2 = np.mean([1 - ((y[:, j] - p[:, j]) ** 2).sum() / ((y[:, j] - y[:, j].mean()) ** 2).sum() for j in range(2)])
    assert r["r2"] == pytest.approx(r2)
    ql = lambda q: 2 * np.mean(q * np.maximum(y - p, 0) + (1 - q) * np.maximum(p - y, 0)) / np.mean(np.abs(y))
    assert r["nql_5"] == pytest.approx(ql(0.5)) and r["nql_9"] == pytest.approx(ql(0.9))
    const = spark.createDataFrame([("m", 0, 2.0, 2.0), ("m", 0, 2.0, 2.0)], "model string, h long, y double, yhat double")
    assert MET.score(const, ["model"], metrics=("r2",)).first()["r2"] == 1.0
    assert MET.score(df, ["model"], digits=2).first()["mae"] == round(float(np.mean(np.abs(y - p))), 2)


def _windows_df(spark, X, Y, split):
    return spark.createDataFrame([(s, [float(v) for v in x], [float(v) for v in y]) for x, y, s in zip(X, Y, split)],
                                 "split string, x array<double>, y array<double>")


def test_linear_fits_match_numpy(spark):
    rng = np.random.default_rng(0)
    n, L, A = 400, 6, 2
    X = rng.normal(size=(n, L)).cumsum(axis=1)
    Y = np.stack([X @ rng.normal(size=L) + 0.3 + rng.normal(scale=0.1, size=n) for _ in range(A)], axis=1)
    split = ["train"] * 300 + ["val"] * 100
    df = _windows_df(spark, X, Y, split)
    mats = FC.split_grams(df)
    tr = slice(0, 300)
    Xa = np.hstack([X[tr], np.ones((300, 1))])
    ref = np.linalg.lstsq(Xa, Y[tr], rcond=None)[0]
    m = FC.fit(kind="linear", lambdas=(0.0,), L=L, A=A, mats=mats)
    assert np.allclose(m["weights"], ref, atol=1e-8)
    # nlinear: fit on (x - last), (y - last), then back to raw-window weights
    last = X[tr][:, -1:]
    wn = np.linalg.lstsq(np.hstack([X[tr] - last, np.ones((300, 1))]), Y[tr] - last, rcond=None)[0]
    pn = np.hstack([X[100:110] - X[100:110, -1:], np.ones((10, 1))]) @ wn + X[100:110, -1:]
    mn = FC.fit(kind="nlinear", lambdas=(0.0,), L=L, A=A, mats=mats)
    assert np.allclose(np.hstack([X[100:110], np.ones((10, 1))]) @ mn["weights"], pn, atol=1e-6)
    # dlinear with ridge on [seasonal, trend]
    K = FC.ma_matrix(L, S.decomposition_kernel(L))
    Z = np.hstack([X[tr] @ (np.eye(L) - K).T, X[tr] @ K.T, np.ones((300, 1))])
    lam = 5.0
    reg = np.eye(2 * L + 1) * lam
    reg[-1, -1] = 0
    wd = np.linalg.solve(Z.T @ Z + reg, Z.T @ Y[tr])
    md = FC.fit(kind="dlinear", lambdas=(lam,), L=L, A=A, mats=mats)
    Xt = np.hstack([X[:5], np.ones((5, 1))])
    Zt = np.hstack([X[:5] @ (np.eye(L) - K).T, X[:5] @ K.T, np.ones((5, 1))])
    assert np.allclose(Xt @ md["weights"], Zt @ wd, atol=1e-6)
    # validation MSE from the val Gram equals the direct value
    Xv = np.hstack([X[300:], np.ones((100, 1))])
    assert m["val_mse"] == pytest.approx(np.mean((Xv @ m["weights"] - Y[300:]) ** 2))
    # prediction through the broadcast coefficient table
    coef = FC.coefficient_table(spark, "linear", m["weights"])
    got = FC.predict(df.limit(3), coef).collect()
    for r in got:
        want = np.append(np.array(r["x"]), 1.0) @ m["weights"]
        assert np.allclose(r["yhat"], want)


def test_fx16_file_names(spark):
    d = tempfile.mkdtemp(prefix="laglake-csv-")
    os.makedirs(os.path.join(d, "sub"))
    for name in ("12.csv", "12.5.csv", os.path.join("sub", "abc.csv"), "skip.txt"):
        with open(os.path.join(d, name), "w") as fh:
            fh.write("date,average\n2024-01-01,1.5\n2024-01-02,2.5\n")
    spec = DatasetSpec(path=d, target=("average",), date="date", segment="station", file_name_as_feature="station")
    df = read_series(spark, spec)
    assert sorted({r["station"] for r in df.collect()}) == ["12", "12.5", "abc"]
    out = prepare(df, spec)
    assert out.count() == 6 and dict(out.dtypes)["date"] == "timestamp_ntz"
    with pytest.raises(Exception):
        read_series(spark, DatasetSpec(path=d, target=("a",), date="d", extension=".parquet"))


def test_fx18_combinations(spark):
    long = spark.createDataFrame([(c, 1.0) for c in ("f1", "f2", "f3", "f4")], "channel string, value double")
    cat = channel_catalogue(long, order=["f1", "f2", "f3", "f4"])
    two = sorted(tuple(r) for r in feature_combinations(cat, 2).collect())
    assert len(two) == 6 and two[0] == ("f1", "f2")
    tl = sorted(tuple(r) for r in feature_combinations(cat, 2, targetless=True).collect())
    assert tl == [("f1", "f2", "f3"), ("f1", "f2", "f4"), ("f1", "f3", "f4"), ("f2", "f3", "f4")]


def test_expand_cases(spark):
    cases = spark.createDataFrame([(1, 8, "1", "0"), (2, 16, "1", "1")], "Case int, lag int, Salinity string, ETTh1 string")
    cat = spark.createDataFrame([("data/Salinity/stations", 0), ("data/ETT/ETTh1.csv", 1), ("data/ETT/ETTh1_copy.csv", 2)],
                                "path string, cat_order int")
    out = sorted((r["Case"], r["flag"], r["path"]) for r in expand_cases(cases, cat, ["Salinity", "ETTh1"]).collect())
    assert out == [(1, "Salinity", "data/Salinity/stations"), (2, "ETTh1", "data/ETT/ETTh1.csv"),
                   (2, "Salinity", "data/Salinity/stations")]


def test_scaled_windows_equal_windows_of_scaled_series(spark):
    from laglake.operators.scale import apply_scaler
    from laglake.operators.windows import make_windows
    from laglake.plans.experiment import scale_windows
    from laglake.spec import WindowSpec
    rng = np.random.default_rng(5)
    rows = [("s", T0 + dt.timedelta(days=i), float(rng.normal()), float(rng.normal() * 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "seg string, ts timestamp_ntz, f double, t double")
    spec = WindowSpec(lag=3, ahead=2, offset=2)
    for method in ("minmax", "standard", "robust"):
        st = fit_scaler(df, ["f", "t"], method)
        a = make_windows(apply_scaler(df, st, ["f", "t"], method), "seg", "ts", ["f"], ["t"], spec, strategy="range")
        b = scale_windows(make_windows(df, "seg", "ts", ["f"], ["t"], spec, strategy="range"), st, ["f", "t"], ["t"], method)
        ra = sorted((r["ts"], tuple(map(tuple, r["x"])), tuple(r["y"])) for r in a.collect())
        rb = sorted((r["ts"], tuple(map(tuple, r["x"])), tuple(r["y"])) for r in b.collect())
        assert len(ra) == len(rb) > 0
        for (t1, x1, y1), (t2, x2, y2) in zip(ra, rb):
            assert t1 == t2 and np.allclose(x1, x2) and np.allclose(y1, y2)


def test_gram_equals_numpy(spark):
    from laglake.operators.moments import gram, gram_matrices, gram_rows
    rng = np.random.default_rng(9)
    X, Y = rng.normal(size=(200, 5)), rng.normal(size=(200, 2))
    df = _windows_df(spark, X, Y, ["train"] * 150 + ["val"] * 50).repartition(7)
    a = gram_matrices(gram_rows(df, "split"))
    Z = np.hstack([X, np.ones((200, 1)), Y])
    for k, sl in (("train", slice(0, 150)), ("val", slice(150, 200))):
        assert np.allclose(a[k], Z[sl].T @ Z[sl])
    long = gram(df, "split").collect()
    assert len(long) == 2 * 36 and all(np.isclose(a[r["grp"]][r["i"], r["j"]], r["v"]) for r in long)


def test_cli_end_to_end(spark):
    from laglake.__main__ import main
    d = tempfile.mkdtemp(prefix="laglake-cli-")
    rng = np.random.default_rng(2)
    for station in (3, 7):
        with open(os.path.join(d, f"{station}.csv"), "w") as fh:
            fh.write("date,average,extra\n")
            level = 10.0
            for i in range(120):
                level += rng.normal()
                fh.write(f"{(T0 + dt.timedelta(days=i)).date()},{level:.3f},{i % 7}\n")
    out = tempfile.mkdtemp(prefix="laglake-cli-out-")
    res = main(["--path", d, "--date", "date", "--target", "average", "--features", "extra", "--segment", "station",
                "--file-name-as-feature", "station", "--lag", "5", "--normalization", "standard", "--out", out], spark=spark)
    rows = {r["model"]: r for r in res.collect()}
    assert set(rows) == {"linear", "nlinear", "dlinear", "Ensemble"}
    assert all(r["rmse"] is not None and r["rmse"] >= 0 for r in rows.values())
    assert any(f.endswith(".csv") for f in os.listdir(os.path.join(out, "results")))


def test_read_cases_and_expand(spark):
    from laglake.sources.cases import read_cases
    d = tempfile.mkdtemp(prefix="laglake-cases-")
    p = os.path.join(d, "cases.csv")
    with open(p, "w") as fh:
        fh.write("Case,lag,Salinity,ETTh1\n1,8,1,0\n2,16,1,1\n3,32,0,1\n")
    cases = read_cases(spark, p, selected=[2, 3])
    cat = spark.createDataFrame([("data/Salinity/stations", 0), ("data/ETT/ETTh1.csv", 1)], "path string, cat_order int")
    out = sorted((r["Case"], r["flag"]) for r in expand_cases(cases, cat, ["Salinity", "ETTh1"]).collect())
    assert out == [(2, "ETTh1"), (2, "Salinity"), (3, "ETTh1")]


def test_metric_and_registry_errors(spark):
    from laglake.functions.activations import apply_activation
    neg = spark.createDataFrame([("m", 0, -1.0, 1.0)], "model string, h long, y double, yhat double")
    with pytest.raises(Exception):
        MET.score(neg, ["model"], metrics=("msle",), extra={"msle": MET.msle}).collect()
    with pytest.raises(ValueError):
        MET.nql(1.5)
    with pytest.raises(ValueError):
        apply_activation("relu", F.col("x"))
    from laglake.operators.moments import MAX_TERMS, gram_rows
    with pytest.raises(ValueError):
        gram_rows(_windows_df(spark, np.ones((2, 3)), np.ones((2, 1)), ["train", "val"]), n_terms=MAX_TERMS + 1)


def test_last_value_roundtrip_and_cluster_conf(spark):
    from laglake.session import cluster_conf
    df = spark.createDataFrame([([3.0, 5.0, 4.0], [6.0])], "x array<double>, y array<double>")
    r = df.select(S.last_value_norm("x").alias("n"),
                  S.last_value_denorm(F.transform("y", lambda v: v - F.element_at("x", -1)), F.element_at("x", -1)).alias("b")).first()
    assert r["n"] == [-1.0, 1.0, 0.0] and r["b"] == [6.0]
    conf = cluster_conf(100 * 2**40)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20) + 1
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_prepare_parses_text_dates(spark):
    df = spark.createDataFrame([("02/01/2024", 1.0), ("03/01/2024", 2.0)], "d string, v double")
    out = prepare(df, DatasetSpec(path="", target=("v",), date="d", time_format="%d/%m/%Y")).orderBy("d").collect()
    assert [r["d"] for r in out] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)]
    iso = spark.createDataFrame([("2024-01-02 05:00:00", 1.0)], "d string, v double")
    assert prepare(iso, DatasetSpec(path="", target=("v",), date="d")).first()["d"] == dt.datetime(2024, 1, 2, 5)


def test_zero_shot_flow_matches_numpy(spark):
    from laglake.plans.experiment import evaluate_stored, prepare_dataset, run_single, run_zero_shot
    from laglake.spec import WindowSpec
    rng = np.random.default_rng(4)

    def ar_rows(seg_prefix, n_seg, n):
        rows = []
        for s in range(n_seg):
            v = 0.0
            for i in range(n):
                v = 0.8 * v + rng.normal()
                rows.append((f"{seg_prefix}{s}", T0 + dt.timedelta(days=i), float(v)))
        return rows

    src_df = spark.createDataFrame(ar_rows("s", 3, 200), "segment string, ts timestamp_ntz, v double")
    tgt_df = spark.createDataFrame(ar_rows("t", 2, 150), "segment string, ts timestamp_ntz, v double")
    ws = WindowSpec(lag=2, ahead=1, offset=1)
    spec = lambda name: DatasetSpec(path="", target=("v",), date="ts", segment="segment", name=name)
    src = prepare_dataset(spark, spec("src"), ws, source=src_df, strategy="range")
    tgt = prepare_dataset(spark, spec("tgt"), ws, source=tgt_df, strategy="range")
    res = {r["model"]: r for r in run_zero_shot(spark, tgt, [src], kinds=("linear",), lambdas=(0.0,)).collect()}
    # numpy: fit on the source's train windows, score the target's test windows
    sw = src.windows.where(F.col("split") == "train").select("x", "y").collect()
    X = np.array([list(r["x"]) + [1.0] for r in sw])
    Y = np.array([r["y"][0] for r in sw])
    w = np.linalg.lstsq(X, Y, rcond=None)[0]
    tw = tgt.windows.where(F.col("split") == "test").select("x", "y").collect()
    Xt = np.array([list(r["x"]) + [1.0] for r in tw])
    Yt = np.array([r["y"][0] for r in tw])
    p = Xt @ w
    assert res["linear"]["mse"] == pytest.approx(np.mean((p - Yt) ** 2))
    assert res["linear"]["r2"] == pytest.approx(1 - np.sum((Yt - p) ** 2) / np.sum((Yt - Yt.mean()) ** 2))
    assert res["linear"]["r2"] > 0.3
    # the same model stored and evaluated zero-shot gives the same scores
    path = tempfile.mkdtemp(prefix="laglake-models-")
    run_single(spark, src, kinds=("linear",), lambdas=(0.0,), model_path=path)
    st = evaluate_stored(spark, tgt, path, kinds=("linear",)).first()
    assert st["mse"] == pytest.approx(res["linear"]["mse"])


def test_shared_weight_linear(spark):
    rng = np.random.default_rng(8)
    n, L, F_, A = 600, 4, 3, 2
    X = rng.normal(size=(n, L, F_))
    w_true, v_true = rng.normal(size=(L, A)), np.array([0.5, -1.0, 2.0])
    Y = np.einsum("ntc,th,c->nh", X, w_true, v_true) + np.array([0.3, -0.2]) + rng.normal(scale=0.01, size=(n, A))
    df = spark.createDataFrame([("train" if i < 500 else "val", X[i].tolist(), Y[i].tolist()) for i in range(n)],
                               "split string, x array<array<double>>, y array<double>")
    mats = FC.split_grams(df)
    m = FC.fit(kind=FC.SHARED, lambdas=(0.0,), L=L, F_=F_, A=A, mats=mats)
    Xa = np.hstack([X.reshape(n, -1), np.ones((n, 1))])
    pred = Xa[500:] @ m["weights"]
    assert np.sqrt(np.mean((pred - Y[500:]) ** 2)) < 0.02
    # the effective weights factor as w_th * v_c (rank one across channels per horizon)
    Wt = m["weights"][:-1].reshape(L, F_, A)
    for h in range(A):
        assert np.linalg.matrix_rank(Wt[:, :, h], tol=1e-8) == 1
    # with one channel the shared model is the plain linear fit
    df1 = _windows_df(spark, X[:, :, 0], Y, ["train"] * 500 + ["val"] * 100)
    mats1 = FC.split_grams(df1)
    a = FC.fit(kind=FC.SHARED, lambdas=(0.0,), L=L, F_=1, A=A, mats=mats1)["weights"]
    b = FC.fit(kind="linear", lambdas=(0.0,), L=L, F_=1, A=A, mats=mats1)["weights"]
    assert np.allclose(a, b, atol=1e-8)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/events.parquet"), reason="driver tables absent")
def test_scan_pushdown_and_pruning(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = _plan(strip_time(ev, "ts", StripTime("%Y-%m-%d", (2024, 1, 5), (2024, 1, 20))).select("event_id"))
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    spec = DatasetSpec(path="", target=("value",), date="ts", segment="event_type")
    used = _plan(prepare(ev, spec, null_scope="used"))
    schema = used.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert set(f.split(":")[0] for f in schema.split(",")) == {"ts", "event_type", "value"}


def test_strftime_translation():
    from laglake.functions.timecols import strftime_to_spark
    assert strftime_to_spark("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    assert strftime_to_spark("%d/%m/%Y") == "dd/MM/yyyy"
    assert strftime_to_spark("%Y:%m:%d") == "yyyy:MM:dd"
    assert strftime_to_spark("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    assert strftime_to_spark("day %j of %Y") == "'day' DDD 'of' yyyy"


def test_scaler_suffix_and_catalogue_order(spark):
    from laglake.operators.expand import univariate_unpivot
    df = spark.createDataFrame([("s", T0, 1.0, 10.0), ("s", T0 + dt.timedelta(days=1), 3.0, 30.0)],
                               "seg string, ts timestamp_ntz, b double, a double")
    st = fit_scaler(df, ["a", "b"], "minmax")
    out = apply_scaler(df, st, ["a", "b"], suffix="_scaled").orderBy("ts").collect()
    assert out[0]["a"] == 10.0 and out[0]["a_scaled"] == 0.0 and out[1]["b_scaled"] == 1.0
    long = univariate_unpivot(df, "seg", "ts", ["b", "a"])
    assert long.count() == 4 and set(long.columns) == {"seg", "ts", "channel", "value"}
    cat = {r["channel"]: r["pos"] for r in channel_catalogue(long).collect()}
    assert cat == {"a": 0, "b": 1}
    assert {r["channel"]: r["pos"] for r in channel_catalogue(long, order=["b", "a"]).collect()} == {"b": 0, "a": 1}


def test_materialize_cuts_lineage(spark):
    from laglake.session import checkpoint_dir, materialize
    df = spark.range(0, 1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    m = materialize(df, "unit")
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "HashAggregate" not in plan
    assert checkpoint_dir(spark) and sorted(r["k"] for r in m.collect()) == list(range(7))


def test_predict_multichannel_windows(spark):
    rng = np.random.default_rng(12)
    X, W = rng.normal(size=(5, 3, 2)), rng.normal(size=(3 * 2 + 1, 2))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(5)], "id int, x array<array<double>>")
    got = {r["id"]: r["yhat"] for r in FC.predict(df, FC.coefficient_table(spark, "m", W)).collect()}
    for i in range(5):
        assert np.allclose(got[i], np.append(X[i].reshape(-1), 1.0) @ W)


def test_spec_validation():
    from laglake.spec import WindowSpec
    with pytest.raises(ValueError):
        WindowSpec(lag=0)
    s = DatasetSpec(path="p", target="y", date="d", features=("a", "y"), segment="k")
    assert s.target == ("y",) and s.channels == ("a", "y") and s.used_columns == ("d", "k", "a", "y")
    assert WindowSpec(lag=4, ahead=2, offset=3).span == 6


def test_case_parquet_and_json_sink(spark):
    from laglake.sources.cases import read_cases
    from laglake.sources.stores import write_table
    d = tempfile.mkdtemp(prefix="laglake-sinks-")
    cases = spark.createDataFrame([(1, 8), (2, 16)], "Case int, lag int")
    write_table(cases, os.path.join(d, "cases.parquet"))
    assert [r["lag"] for r in read_cases(spark, os.path.join(d, "cases.parquet"), selected=[2]).collect()] == [16]
    write_table(cases, os.path.join(d, "cases.json"), fmt="json", single_file=True)
    back = spark.read.schema(cases.schema).json(os.path.join(d, "cases.json"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 8), (2, 16)]


def _csv(folder, name, text):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(text)


def test_csv_types_hold_for_all_rows_and_headers_match(spark):
    d = tempfile.mkdtemp(prefix="laglake-csv-")
    _csv(d, "007.csv", "date,lo,hi\n" + "".join(f"{T0 + dt.timedelta(hours=h)},{h},{h + 1}\n" for h in range(10_500)) + "2030-01-01,5.5,7\n")
    _csv(d, "b.csv", "date,hi,lo\n2031-01-01,100,1\n")
    spec = DatasetSpec(path=d, target=("lo",), date="date", features=("hi",), file_name_as_feature="st")
    df = read_series(spark, spec)
    assert dict(df.dtypes) == {"date": "timestamp_ntz", "lo": "double", "hi": "bigint", "st": "string"}
    assert df.where("lo is null or hi is null or date is null").count() == 0 and df.count() == 10_502
    assert [(r.lo, r.hi, r.st) for r in df.where("hi = 100 and lo = 1").collect()] == [(1.0, 100, "b")]
    assert df.where("st = '7'").count() == 10_501
    schema = "date timestamp_ntz, lo bigint, hi bigint"
    with pytest.raises(ValueError, match="lo"):
        read_series(spark, spec, schema)
    assert read_series(spark, spec, schema, on_bad="null").where("lo is null").count() == 1
    _csv(d, "c.csv", "date,hi,lo\n2031-01-02,1\n")
    with pytest.raises(ValueError, match="1 lines"):
        read_series(spark, spec)
    _csv(d, "c.csv", "date,hi,other\n2031-01-02,1,2\n")
    with pytest.raises(ValueError, match="columns"):
        read_series(spark, spec)


def test_unread_dates_are_dropped_and_listed(spark):
    from laglake.operators.prepare import unread_dates
    df = spark.createDataFrame([("2024-01-01", 1.0), ("soon", 2.0), ("later", 3.0), (None, 4.0)], "d string, v double")
    spec = DatasetSpec(path="", target=("v",), date="d")
    assert [r.v for r in prepare(df, spec).collect()] == [1.0]
    assert {r.d for r in unread_dates(df, spec).collect()} == {"soon", "later"}


def test_quantiles_of_ties_and_odd_values(spark):
    rng = np.random.default_rng(0)
    data = {"tied": rng.choice([1.0, 2.0, 3.0], 4000).tolist(), "steep": [2.0 ** -k for k in range(900)], "one": [5.0],
            "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 1e-300], "open": [float("inf"), float("-inf"), 0.0, 1.0], "nan": [float("nan"), 1.0, float("nan")]}
    rows = [(k, v) for k, some in data.items() for v in some] + [("tied", None)]
    got = {r["k.x"]: r for r in exact_quantiles(spark.createDataFrame(rows, "`k.x` string, `v.y` double").repartition(5), "k.x", "v.y",
                                                {"q1": 0.25, "q9": 0.9}, bins=64).collect()}
    for k, some in data.items():
        s = sorted(some, key=lambda v: (v != v, v))
        assert got[k]["n"] == len(s)
        for name, q in (("q1", 0.25), ("q9", 0.9)):
            assert got[k][name] == _nearest(s, q) or got[k][name] != got[k][name] and _nearest(s, q) != _nearest(s, q)


def test_dotted_names(spark):
    from laglake.operators.expand import univariate_unpivot
    from laglake.operators.grid import fill_date, fill_gaps
    from laglake.operators.prepare import shrink_types
    from laglake.operators.scale import apply_scaler, fit_scaler
    df = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), float(i)) for i in (0, 1, 3)], "`s.e` string, `d.t` timestamp_ntz, `max. PAR` double")
    assert dict(shrink_types(df).dtypes)["max. PAR"] == "float"
    assert univariate_unpivot(df, "s.e", "d.t", ["max. PAR"]).count() == 3
    st = fit_scaler(df, ["max. PAR"], "minmax")
    assert sorted(r["max. PAR"] for r in apply_scaler(df, st, ["max. PAR"], "minmax").collect()) == [0.0, pytest.approx(1 / 3), 1.0]
    plain = df.withColumnsRenamed({"s.e": "s", "d.t": "t"})
    dense = fill_date(plain, "s", "t", 1440)
    for how, value in (("forward", 1.0), ("backward", 3.0), ("max", 3.0)):
        out = {r["t"]: r["max. PAR"] for r in fill_gaps(dense, "s", "t", ["max. PAR"], how).collect()}
        assert out[T0 + dt.timedelta(days=2)] == value


@pytest.mark.parametrize("kind", ["linear", "nlinear", "dlinear"])
def test_shared_fits_recover_their_model(spark, kind):
    from laglake.operators import forecast as FC
    from laglake.operators.moments import gram_matrices, gram_rows
    rng = np.random.default_rng(4)
    L, C, A, n = 8, 3, 2, 600
    D, carry = FC.channel_map(kind, L)
    w, v, beta = rng.normal(size=(len(D), A)), np.array([0.5, -1.0, 1.5]), np.array([2.0, -1.0])
    X = rng.normal(size=(n, L, C)) + 5
    Y = np.einsum("nlc,lhc->nh", X, (D.T @ w + carry[:, None])[:, :, None] * v) + beta
    S = gram_matrices(gram_rows(_windows_df(spark, X.reshape(n, -1), Y, ["train"] * n)))["train"]
    W = FC.fit_shared(S, L, C, A, kind=kind)
    assert np.abs(np.hstack([X.reshape(n, -1), np.ones((n, 1))]) @ W - Y).max() < 1e-2 * Y.std()


def test_t2v_model_equals_its_layers(spark):
    """The Gram's linear features, with weights put through the layers one by one."""
    from laglake.operators import forecast as FC
    from laglake.operators.features import t2v_features, t2v_revin_frame, time2vec_weights
    rng = np.random.default_rng(5)
    n, L, C, k = 20, 8, 2, 3
    X = rng.normal(size=(n, L, C))
    wt = time2vec_weights(L, k, channels=C)
    df = spark.createDataFrame([(i, X[i].tolist(), [0.0]) for i in range(n)], "segment long, x array<array<double>>, y array<double>")
    fr = {r.segment: np.array(r.x) for r in t2v_revin_frame(df, wt, keep=("segment",), normalised=False).collect()}
    D, carry = FC.channel_map("t2v", L)
    w, v, b = rng.normal(size=2 * L), rng.normal(size=k + C), 0.7
    row = np.concatenate([w, [b]]) @ D + carry
    K = FC.ma_matrix(L, FC.decomposition_kernel(L))
    f = t2v_features(X, wt)
    mu, sd = f.mean(axis=1, keepdims=True), np.sqrt(f.var(axis=1, keepdims=True) + 1e-5)
    z = (f - mu) / sd
    layers = np.einsum("l,nlc->nc", w[:L], z - np.einsum("tl,nlc->ntc", K, z)) + np.einsum("l,nlc->nc", w[L:], np.einsum("tl,nlc->ntc", K, z)) + b
    want = (layers * sd[:, 0] + mu[:, 0]) @ v
    got = [fr[i].reshape(L + 2, k + C) for i in range(n)]
    assert np.allclose([row @ g @ v for g in got], want)


def test_moving_average_and_revin_take_linear_time_forms(spark):
    from laglake.functions import sequence as S
    rng = np.random.default_rng(1)
    X = [rng.normal(size=m) * 10 + 1e6 for m in (1, 5, 9, 30)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)] + [(9, None), (10, [])], "i int, x array<double>")
    for k in (1, 3, 25):
        out = {r.i: r for r in df.select("i", S.decompose("x", k).alias("d"), S.moving_average("x", k).alias("m")).collect()}
        for i, x in enumerate(X):
            p = (k - 1) // 2
            pad = np.concatenate([[x[0]] * p, x, [x[-1]] * p])
            want = np.array([pad[j:j + k].mean() for j in range(len(x))])
            assert np.allclose(out[i].m, want, rtol=1e-12) and np.allclose(out[i].d.trend, want, rtol=1e-12)
            assert np.allclose(np.array(out[i].d.seasonal) + want, x)
        assert out[10].m == [] and (out[9].m is None)


def test_model_versions_are_replaced(spark):
    from laglake.operators import forecast as FC
    path = tempfile.mkdtemp(prefix="laglake-models-") + "/m"
    w = np.array([[2.0], [1.0]])
    for factor, version in ((1, 1), (3, 1), (5, 2)):
        FC.save_model(FC.coefficient_table(spark, "linear", factor * w, version), path)
    df = spark.createDataFrame([([10.0],)], "x array<double>")
    assert FC.predict(df, FC.load_model(spark, path, "linear", 1)).first().yhat == [63.0]
    assert FC.predict(df, FC.load_model(spark, path, "linear")).first().yhat == [105.0]


def test_flows_with_any_date_name_and_single_series(spark):
    from laglake.plans.experiment import evaluate_stored, prepare_dataset, run_single, run_zero_shot
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=160)).tolist()
    many = spark.createDataFrame([(s, T0 + dt.timedelta(days=i), walk[i] * (s + 1)) for s in (0, 1) for i in range(160)], "st int, `Date Time` timestamp_ntz, v double")
    ws = WindowSpec(lag=2)
    spec = DatasetSpec(path="", target=("v",), date="Date Time", segment="st", name="many")
    ds = prepare_dataset(spark, spec, ws, source=many, normalization="standard", strategy="range")
    path = tempfile.mkdtemp(prefix="laglake-models-")
    a = {r.model: r.asDict() for r in run_single(spark, ds, model_path=path).collect()}
    b = {r.model: r.asDict() for r in evaluate_stored(spark, ds, path).collect()}
    assert a.keys() == b.keys() and "Ensemble" in a and all(abs(a[m]["mse"] - b[m]["mse"]) < 1e-9 for m in a)
    best = min(a[m]["mae"] for m in a if m != "Ensemble")
    assert a["Ensemble"]["mae"] < 3 * best
    import dataclasses
    assert run_zero_shot(spark, ds, [dataclasses.replace(ds, name="other")]).count() == 4
    one = many.where("st = 0").select("Date Time", "v")
    single = prepare_dataset(spark, DatasetSpec(path="", target=("v",), date="Date Time", name="one"), ws, source=one, normalization="standard")
    n = 158
    counts = {r.split: r["count"] for r in single.raw.groupBy("split").count().collect()}
    assert counts == {"train": math.ceil(n * 0.7), "val": int(n * (0.7 + 0.1)) - math.ceil(n * 0.7), "test": 160 - int(n * (0.7 + 0.1))}


def test_strategies_agree_off_the_minute_and_duplicates_raise(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 30, 250_000)
    rows = [("a", base + dt.timedelta(hours=i), float(i)) for i in range(20) if i != 7]
    jitter = [("b", base + dt.timedelta(hours=i, seconds=20 * (i % 3)), float(i)) for i in range(20)]
    spec = WindowSpec(lag=3, minutes=60)
    for data, n in ((rows, 13), (jitter, None), (rows + jitter, None)):
        df = spark.createDataFrame(data, "s string, t timestamp_ntz, v double")
        got = [sorted((r.s, r.t, tuple(r.x), tuple(r.y)) for r in make_windows(df, "s", "t", ["v"], ["v"], spec, strategy=how, chunk_steps=4).collect())
               for how in ("range", "halo", "dense", "dense_halo", "auto")]
        assert all(g == got[0] for g in got) and (n is None or len(got[0]) == n)
    again = spark.createDataFrame(rows + [("a", rows[3][1], 99.0)], "s string, t timestamp_ntz, v double")
    for how in ("range", "halo", "dense", "dense_halo"):
        with pytest.raises(Exception, match="same key and timestamp"):
            make_windows(again, "s", "t", ["v"], ["v"], spec, strategy=how).collect()


def test_checkpoint_folder_is_needed_on_a_cluster(spark):
    from laglake import session

    class Other:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: "spark://host" if k == "spark.master" else d)})()
        sparkContext = None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Other())


def test_clear_scratch(spark):
    from laglake import session
    df = session.materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)


def _csv_files(tmp_path, **files):
    from laglake.spec import DatasetSpec
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return DatasetSpec(path=str(tmp_path), target="v", date="d")


def test_csv_line_breaks_within_quotes(spark, tmp_path):
    spec = _csv_files(tmp_path, a='d,note,v\n2020-01-01,"two\nlines, and ""quotes""",1.5\n2020-01-02,plain,2\n', b="d,note,v\n2020-01-03,x,3\n")
    got = sorted((r.d.day, r.note, r.v) for r in read_series(spark, spec).collect())
    assert got == [(1, 'two\nlines, and "quotes"', 1.5), (2, "plain", 2.0), (3, "x", 3.0)]


def test_csv_keeps_codes_and_digits(spark, tmp_path):
    spec = _csv_files(tmp_path, a="d,code,word,big,mixed,v\n01/02/2020,007,1d,9007199254740993,9007199254740993,1e3\n13/02/2020 10:30,12,2f,1,0.5,-.5\n")
    df = read_series(spark, spec)
    assert dict(df.dtypes) == {"d": "timestamp_ntz", "code": "string", "word": "string", "big": "bigint", "mixed": "string", "v": "double"}
    rows = sorted(df.collect(), key=lambda r: r.d)
    assert [(r.code, r.word, r.big, r.mixed, r.v) for r in rows] == [("007", "1d", 9007199254740993, "9007199254740993", 1000.0), ("12", "2f", 1, "0.5", -0.5)]
    assert [(r.d.year, r.d.month, r.d.day, r.d.hour) for r in rows] == [(2020, 2, 1, 0), (2020, 2, 13, 10)]


def test_csv_month_first_only_where_needed(spark, tmp_path):
    spec = _csv_files(tmp_path, a="d,v\n01/02/2020,1\n01/13/2020,2\n")
    assert sorted((r.d.month, r.d.day) for r in read_series(spark, spec).collect()) == [(1, 2), (1, 13)]
