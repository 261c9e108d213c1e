"""Scaler statistics on training rows and the affine scale / inverse-scale maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laglake.operators.common import qc
from laglake.operators.quantiles import channel_statistics

ROBUST_EPS = 1e-12
STAT_COLUMNS = ("min", "max", "mean", "median", "std", "variance", "quantile_25", "quantile_50", "quantile_75", "iqr")


def fit_scaler(train_raw: DataFrame, channels, method: str = "minmax") -> DataFrame:
    """One row per channel: min, max, mean, median, std, variance (sample), nearest-rank
    quartiles, iqr and the method name; pooled over every segment of the training rows. The rows are read at most three times
    (``channel_statistics``), when this is called; channels without a value have no row."""
    found = channel_statistics(train_raw, channels, {"median": "median", "quantile_25": 0.25, "quantile_50": 0.5, "quantile_75": 0.75})
    rows = []
    for c, s in found.items():
        s["std"] = None if s["variance"] is None else s["variance"] ** 0.5
        s["iqr"] = s["quantile_75"] - s["quantile_25"]
        rows.append((c, *[s[k] for k in STAT_COLUMNS], method))
    schema = ", ".join(["channel string", *[f"{k} double" for k in STAT_COLUMNS], "method string"])
    return train_raw.sparkSession.createDataFrame(rows, schema)


def _forward(x, s, method):
    if method == "minmax":
        return F.try_divide(x - s["min"], s["max"] - s["min"])
    if method == "standard":
        return F.try_divide(x - s["mean"], s["std"])
    if method == "robust":
        return (x - s["median"]) / (s["iqr"] + F.lit(ROBUST_EPS))
    raise ValueError("method must be minmax|standard|robust")


def _inverse(x, s, method):
    if method == "minmax":
        return x * (s["max"] - s["min"]) + s["min"]
    if method == "standard":
        return x * s["std"] + s["mean"]
    if method == "robust":
        return x * s["iqr"] + s["median"]   # the inverse uses the bare iqr
    raise ValueError("method must be minmax|standard|robust")


def _stat_cols(stats: DataFrame, channels):
    """Pivot the (small, one row per channel) stats table into one row of <stat>_<channel> columns."""
    aggs = [F.first(F.when(F.col("channel") == c, F.col(s)), ignorenulls=True).alias(f"_{s}{i}")
            for i, c in enumerate(channels) for s in ("min", "max", "mean", "std", "median", "iqr")]
    return stats.agg(F.count(F.lit(1)).alias("_n"), *aggs).where(F.col("_n") > 0).drop("_n")


def apply_scaler(df: DataFrame, stats: DataFrame, channels, method: str | None = None, inverse: bool = False,
                 suffix: str = "") -> DataFrame:
    """Scale (or unscale) ``channels`` of ``df`` with the per-channel stats. The stats table has
    one row per channel (bounded by the schema), so its pivoted single row is broadcast.
    A constant channel under minmax / standard yields NULL (try_divide) instead of inf/NaN."""
    channels = list(channels)
    if method is None:
        method = stats.select("method").first()["method"]
    one = F.broadcast(_stat_cols(stats, channels))
    j = df.crossJoin(one)
    outs = []
    for i, c in enumerate(channels):
        s = {k: F.col(f"_{k}{i}") for k in ("min", "max", "mean", "std", "median", "iqr")}
        f = _inverse if inverse else _forward
        outs.append(f(qc(c).cast("double"), s, method).alias(c + suffix))
    keep = [c for c in df.columns if c not in channels or suffix]
    return j.select(*[qc(c) for c in keep], *outs)
