"""Fits without a Gram matrix: equal to the closed form, beyond its bound, stopped by validation error, on imperfect data."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from laglake.operators import chunks as C
from laglake.operators import forecast as FC
from laglake.operators import iterative as IT
from laglake.operators.moments import MAX_TERMS, gram_matrices
from laglake.spec import WindowSpec


def series(spark, n=400, seed=3, constant=False, nan=False):
    r = np.random.default_rng(seed)
    rows = []
    for key in ("a", "b"):
        p, q = 0.0, 0.0
        for i in range(n):
            p = 0.7 * p + r.normal()
            q = 0.5 * q + 0.4 * p + r.normal()
            if r.random() < 0.97:
                rows.append((key, datetime(2020, 1, 1) + timedelta(days=i), 3.0 if constant else p, float("nan") if nan and i == 7 else 1000 + 5 * q))
    return spark.createDataFrame(rows, "segment string, ts timestamp_ntz, p double, q double").repartition(3)


def chunked(df, channels, targets, spec, steps=64):
    return C.with_split(C.chunk_series(df, "segment", "ts", channels, targets, spec, steps), "segment", channels, targets, spec).cache()


@pytest.mark.parametrize("kind, channels, targets", [("linear", ["p"], ["q"]), ("nlinear", ["p"], ["q"]), ("linear", [], ["p", "q"])])
def test_equals_the_gram_solution(spark, kind, channels, targets):
    spec, lambdas = WindowSpec(5, 2, 2), (0.0, 10.0, 1e4)
    c = chunked(series(spark), channels, targets, spec)
    mats = gram_matrices(C.lag_gram(c, channels, targets, spec))
    a = 2 * len(targets)
    want = FC.ridge_path(mats, kind, lambdas, 5, 2, a)
    got = IT.iterative_path(c, channels, targets, spec, kind, lambdas)
    for x, y in zip(got, want, strict=True):
        assert np.allclose(x["weights"], y["weights"], rtol=1e-5, atol=1e-6) and x["n_train"] == y["n_train"]
        assert np.isclose(x["val_mse"], y["val_mse"], rtol=1e-7) and x["residual"] <= 1e-9
    best = IT.fit_iterative(c, channels, targets, spec, kind, lambdas)
    assert best["lambda"] == FC.fit(kind=kind, lambdas=lambdas, L=5, F_=2, A=a, mats=mats)["lambda"]


def test_runs_above_the_bound_of_a_gram_matrix(spark):
    """More inputs than windows: the ridge solution is the dual one, from inner products of windows."""
    lag, n, lam = MAX_TERMS + 8, MAX_TERMS + 320, 500.0
    r = np.random.default_rng(1)
    v = np.convolve(r.normal(size=n + 50), np.ones(50) / 7, "valid")[:n] + 20
    rows = [("a", datetime(2020, 1, 1) + timedelta(minutes=i), float(x)) for i, x in enumerate(v)]
    spec = WindowSpec(lag, 1, 1, 1)
    c = chunked(spark.createDataFrame(rows, "segment string, ts timestamp_ntz, q double"), [], ["q"], spec)
    with pytest.raises(ValueError):
        C.lag_gram(c, [], ["q"], spec)
    m = IT.fit_iterative(c, [], ["q"], spec, lambdas=(lam,))
    x = np.lib.stride_tricks.sliding_window_view(v[:-1], lag)[:int(m["n_train"])]
    y = v[lag:][:int(m["n_train"])]
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = xc.T @ np.linalg.solve(xc @ xc.T + lam * np.eye(len(x)), yc)
    assert len(x) > 200 and np.allclose(m["weights"][:-1, 0], w, atol=1e-6 * np.abs(w).max())
    assert np.isclose(m["weights"][-1, 0], y.mean() - x.mean(axis=0) @ w, rtol=1e-6)


def test_stops_where_the_validation_error_stops_falling(spark):
    spec = WindowSpec(40, 1, 1)
    c = chunked(series(spark, 160, seed=8), ["p"], ["q"], spec)
    whole = IT.fit_iterative(c, ["p"], ["q"], spec, tolerance=1e-3)
    early = IT.fit_iterative(c, ["p"], ["q"], spec, patience=3)
    assert early["passes"] < whole["passes"] and early["val_mse"] < whole["val_mse"]
    mats = gram_matrices(C.lag_gram(c, ["p"], ["q"], spec))
    assert np.isclose(FC.val_mse(mats["val"], early["weights"], early_n(mats), 1), early["val_mse"], rtol=1e-6)


def early_n(mats):
    p = len(mats["val"]) - 2
    return mats["val"][p, p]


def test_imperfect_data_and_bounds(spark):
    spec = WindowSpec(3, 1, 1)
    c = chunked(series(spark, constant=True), ["p"], ["q"], spec)
    m = IT.fit_iterative(c, ["p"], ["q"], spec)
    assert (m["weights"][[0, 2, 4], 0] == 0).all() and np.abs(m["weights"][[1, 3, 5], 0]).max() > 0.1
    with pytest.raises(RuntimeError, match="passes"):
        IT.fit_iterative(c, ["p"], ["q"], spec, most=3)
    with pytest.raises(ValueError, match="finite"):
        IT.fit_iterative(chunked(series(spark, nan=True), ["p"], ["q"], spec), ["p"], ["q"], spec)
    with pytest.raises(ValueError, match="bound"):
        IT.fit_iterative(c, ["p"], ["q"], WindowSpec(IT.MAX_NUMBERS, 1, 1))
    assert IT.fit_iterative(c.where("false"), ["p"], ["q"], spec) is None
    with pytest.raises(ValueError, match="validation"):
        none = WindowSpec(3, 1, 1, ratios=(0.8, 0.0, 0.2))
        IT.fit_iterative(chunked(series(spark), ["p"], ["q"], none), ["p"], ["q"], none, patience=2)
