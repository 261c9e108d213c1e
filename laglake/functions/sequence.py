"""Array (window) transforms as Column expressions: moving average, decomposition,
last-value normalisation, reversible instance normalisation and Time2Vec features.

All builders take a 1-D ``array<double>`` column (one channel of one window, oldest step
first). Per-element maps are higher-order functions; the moving average and the decomposition run on Arrow batches. Time
is linear in the length of a window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REVIN_EPS = 1e-5
MAX_LITERAL_WEIGHTS = 4096   # beyond this the generated expression outgrows whole-stage codegen


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decomposition_kernel(lag: int) -> int:
    """Kernel size used by the decomposition models: lag//3 made odd when lag >= 7, else 25."""
    if lag >= 7:
        k = lag // 3
        return k + 1 if k % 2 == 0 else k
    return 25


def array_sum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0).cast("double"), lambda a, v: a + v)


def array_mean(x) -> Column:
    return F.try_divide(array_sum(x), F.size(_c(x)))   # NULL for an empty array, which plans may evaluate before they filter it


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where ``use`` needs it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _averages(arrays: pd.Series, k: int) -> list:
    """Edge-padded moving averages by running sums, in one pass over all windows of a length."""
    out = [None] * len(arrays)
    by_length: dict[int, list[int]] = {}
    for i, a in enumerate(arrays):
        if a is not None:
            by_length.setdefault(len(a), []).append(i)
    p = (k - 1) // 2
    for n, rows in by_length.items():
        if not n:
            for i in rows:
                out[i] = np.empty(0)
            continue
        x = np.stack([np.asarray(arrays.iloc[i], float) for i in rows])
        level = x[:, :1]   # sums of differences from the first value keep their digits
        padded = np.concatenate([np.repeat(x[:, :1], p + 1, axis=1), x, np.repeat(x[:, -1:], p, axis=1)], axis=1) - level
        padded[:, 0] = 0.0
        sums = np.cumsum(padded, axis=1)
        average = (sums[:, k:] - sums[:, :-k]) / k + level if sums.shape[1] > k else np.empty((len(rows), 0))
        for i, row in zip(rows, average, strict=True):
            out[i] = row
    return out


def moving_average(x, k: int) -> Column:
    """Stride-1 mean over a window of ``k`` after padding (k-1)//2 copies of the first and the
    last value at each end (length kept for odd k). Arrow batches, time linear in the length."""
    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series(_averages(arrays, k), dtype=object)

    return run(_c(x).cast("array<double>"))


def decompose(x, k: int) -> Column:
    """struct<trend, seasonal> with trend = moving_average(x, k) and seasonal = x - trend."""
    @F.pandas_udf("trend array<double>, seasonal array<double>")
    def run(arrays: pd.Series) -> pd.DataFrame:
        trend = _averages(arrays, k)
        rest = [None if t is None else np.asarray(a, float) - t for a, t in zip(arrays, trend, strict=True)]
        return pd.DataFrame({"trend": pd.Series(trend, dtype=object), "seasonal": pd.Series(rest, dtype=object)})

    return run(_c(x).cast("array<double>"))


def last_value_norm(x) -> Column:
    """Subtract the last step of the window from every step."""
    x = _c(x)
    return bound(F.try_element_at(x, F.lit(-1)), lambda last: F.transform(x, lambda v: v - last))


def last_value_denorm(y, last) -> Column:
    return F.transform(_c(y), lambda v: v + _c(last))


def _steps(x: Column, channels: int, fn) -> Column:
    """``fn(values, channel)`` for one channel, or for each channel of a steps x channels array."""
    if channels == 1:
        return fn(x, 0)
    def of(c: int) -> Column:
        return F.transform(x, lambda step: F.element_at(step, c + 1))

    return F.array(*[fn(of(c), c) for c in range(channels)])


def revin_stats(x, eps: float = REVIN_EPS, channels: int = 1) -> Column:
    """struct<mean, std> per window: mean and sqrt(population variance + eps); an array of them, one per channel,
    for a steps x channels window."""
    def one(v, _):
        def spread(m):
            return F.try_divide(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, e: a + (e - m) * (e - m)), F.size(v))
        return bound(array_mean(v), lambda m: F.struct(m.alias("mean"), F.sqrt(spread(m) + F.lit(eps)).alias("std")))

    return _steps(_c(x), channels, one)


def revin_norm(x, mean, std, weight: float = 1.0, bias: float = 0.0) -> Column:
    both = F.struct(_c(mean).alias("m"), _c(std).alias("s"))
    return bound(both, lambda b: F.transform(_c(x), lambda v: (v - b["m"]) / b["s"] * F.lit(weight) + F.lit(bias)))


def revin_norm_channels(x, stats, weights=None, biases=None) -> Column:
    """A steps x channels window normalised by ``revin_stats(x, channels=n)``, with an affine map per channel."""
    n = len(weights) if weights else None
    return bound(_c(stats), lambda st: F.transform(_c(x), lambda step: F.transform(
        step, lambda v, c: (v - st[c]["mean"]) / st[c]["std"] * (F.lit(1.0) if n is None else F.element_at(F.array(*map(F.lit, map(float, weights))), c + 1))
        + (F.lit(0.0) if n is None else F.element_at(F.array(*map(F.lit, map(float, biases))), c + 1)))))


def revin_denorm(y, mean, std, weight: float = 1.0, bias: float = 0.0, eps: float = REVIN_EPS) -> Column:
    both = F.struct(_c(mean).alias("m"), _c(std).alias("s"))
    return bound(both, lambda b: F.transform(_c(y), lambda v: (v - F.lit(bias)) / F.lit(weight + eps * eps) * b["s"] + b["m"]))


def time2vec(x, wa, ba, wb, bb) -> Column:
    """Time2Vec features of a one-channel window of length L with given weights.

    ``wa``: k periodic frequencies, ``ba``: L x k phase table, ``wb``/``bb``: L slopes/intercepts.
    Step t yields [sin(x_t*wa_j + ba_tj) for j < k] + [wb_t*x_t + bb_t]  (array<array<double>>).
    Weights become literal arrays, so keep L*k small; ``operators.features.t2v_revin_frame`` covers
    large k with numpy per batch."""
    x = _c(x)
    k = len(wa)
    if k * len(ba) > MAX_LITERAL_WEIGHTS:
        raise ValueError(f"{k * len(ba)} literal weights: use operators.features.t2v_revin_frame for large L*k")
    wa_c = F.array(*[F.lit(float(v)) for v in wa])
    ba_c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ba])
    wb_c = F.array(*[F.lit(float(v)) for v in wb])
    bb_c = F.array(*[F.lit(float(v)) for v in bb])

    def step(t):
        xt = F.element_at(x, t)
        periodic = F.transform(F.sequence(F.lit(1), F.lit(k)),
                               lambda j: F.sin(xt * F.element_at(wa_c, j) + F.element_at(F.element_at(ba_c, t), j)))
        return F.concat(periodic, F.array(F.element_at(wb_c, t) * xt + F.element_at(bb_c, t)))

    return F.transform(F.sequence(F.lit(1), F.size(x)), step)
