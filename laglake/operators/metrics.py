"""Forecast metrics as one grouped aggregate over long prediction rows (group, ..., h, y, yhat).

Pooled means for MAE / MSE / RMSE / MAPE / sMAPE / normalised quantile losses; R2 is the uniform
average over horizons of the per-horizon coefficient of determination (constant actuals score 1
when predicted exactly, else 0). Optional inverse scaling and half-to-even rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16   # float64 machine epsilon, the MAPE floor


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)))


def smape(y: Column, p: Column) -> Column:
    den = (F.abs(p) + F.abs(y)) / 2
    return F.avg(F.when(den == 0, F.lit(float("nan"))).otherwise(F.abs(p - y) / den)) * 100


def msle(y: Column, p: Column) -> Column:
    bad = (y < 0) | (p < 0)
    term = F.when(bad, F.raise_error(F.lit("MSLE needs non-negative values"))).otherwise(
        F.pow(F.log1p(y) - F.log1p(p), 2))
    return F.avg(term)


def nql(q: float):
    if not 0 <= q <= 1:
        raise ValueError("quantile must be within [0, 1]")

    def f(y: Column, p: Column) -> Column:
        both = (y - p).isNotNull()   # ``greatest`` skips NULLs
        loss = F.lit(q) * F.greatest(y - p, F.lit(0.0)) + F.lit(1 - q) * F.greatest(p - y, F.lit(0.0))
        return F.try_divide(2 * F.avg(F.when(both, loss)), F.avg(F.when(both, F.abs(y))))
    return f


# The registered metric names (output columns) in report order.
POOLED = {"mae": mae, "mse": mse, "rmse": rmse, "mape": mape, "smape": smape, "nql_5": nql(0.5), "nql_9": nql(0.9)}
ALL_METRICS = ("r2", "mae", "mse", "rmse", "mape", "smape", "nql_5", "nql_9")


def r2_per_horizon(pred: DataFrame, group, y: str = "y", p: str = "yhat", h: str = "h") -> DataFrame:
    pc = F.col(p)
    yc = F.when(pc.isNotNull(), F.col(y))
    per = pred.groupBy(*group, h).agg(F.sum((yc - pc) * (yc - pc)).alias("_ssr"),
                                      (F.count(yc) * F.var_pop(yc)).alias("_sst"))
    r2h = (F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst"))
            .when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return per.groupBy(*group).agg(F.avg(r2h).alias("r2"))


def unscale(c: Column, stats_row: dict | None) -> Column:
    """Inverse scaling of a prediction column with a scaler record (min/max/mean/std/median/iqr/method)."""
    if not stats_row:
        return c
    m = stats_row["method"]
    if m == "minmax":
        return c * (stats_row["max"] - stats_row["min"]) + stats_row["min"]
    if m == "standard":
        return c * stats_row["std"] + stats_row["mean"]
    if m == "robust":
        return c * stats_row["iqr"] + stats_row["median"]
    raise ValueError(m)


def score(pred: DataFrame, group=("model",), y: str = "y", p: str = "yhat", h: str = "h", metrics=ALL_METRICS,
          scaler: dict | None = None, digits: int | None = None, extra: dict | None = None, counts: bool = False) -> DataFrame:
    """One row per group with the requested metrics. ``scaler``: a scaler record to unscale y and
    yhat first; ``digits``: round half to even; ``extra``: name -> f(y, p) aggregate builders; ``counts``: adds ``n``, the rows
    scored, and ``n_missing``, the rows left out. A row whose y or yhat is NULL is left out of every metric.

    The registered metrics are rolled up from one aggregate over (group, horizon) - sums of the
    per-row terms plus the per-horizon R2 inputs - so the prediction rows are read and shuffled once
    (map-side partial aggregation), and the second aggregate sees one row per (group, horizon)."""
    group = list(group)
    d = pred.select(*group, h, unscale(F.col(y), scaler).alias("_y0"), unscale(F.col(p), scaler).alias("_p0"))
    both = F.col("_y0").isNotNull() & F.col("_p0").isNotNull()
    d = d.select(*group, h, F.when(both, F.col("_y0")).alias("_y"), F.when(both, F.col("_p0")).alias("_p"))
    yc, pc = F.col("_y"), F.col("_p")
    e = yc - pc
    den = (F.abs(pc) + F.abs(yc)) / 2
    ql = lambda q: F.lit(q) * F.greatest(e, F.lit(0.0)) + F.lit(1 - q) * F.greatest(-e, F.lit(0.0))
    per = d.groupBy(*group, h).agg(
        F.count(yc).alias("_n"), F.count_if(yc.isNull()).alias("_missing"), F.sum(F.abs(e)).alias("_ae"), F.sum(e * e).alias("_se"),
        F.sum(F.abs(e) / F.greatest(F.abs(yc), F.lit(EPS))).alias("_ape"),
        F.sum(F.when(den == 0, F.lit(float("nan"))).otherwise(F.abs(pc - yc) / den)).alias("_sm"),
        F.sum(ql(0.5)).alias("_q5"), F.sum(ql(0.9)).alias("_q9"), F.sum(F.abs(yc)).alias("_ay"),
        (F.count(yc) * F.var_pop(yc)).alias("_sst"))
    n = F.sum("_n")
    r2h = (F.when(F.col("_sst") > 0, 1 - F.col("_se") / F.col("_sst"))
            .when(F.col("_se") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    built = {
        "mae": F.sum("_ae") / n, "mse": F.sum("_se") / n, "rmse": F.sqrt(F.sum("_se") / n),
        "mape": F.sum("_ape") / n, "smape": F.sum("_sm") / n * 100,
        "nql_5": F.try_divide(2 * F.sum("_q5") / n, F.sum("_ay") / n),
        "nql_9": F.try_divide(2 * F.sum("_q9") / n, F.sum("_ay") / n),
        "r2": F.avg(r2h),
    }
    fns = dict(extra or {})
    unknown = [m for m in metrics if m not in built and m not in fns]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    out = per.groupBy(*group).agg(*[built[m].alias(m) for m in metrics if m in built],
                                  n.alias("n"), F.sum("_missing").alias("n_missing"))
    custom = [m for m in metrics if m not in built]
    if custom:
        c = d.groupBy(*group).agg(*[fns[m](yc, pc).alias(m) for m in custom])
        out = out.join(c, group, "inner") if group else out.crossJoin(c)
    cols = [F.bround(F.col(m), digits).alias(m) if digits is not None else F.col(m) for m in metrics]
    return out.select(*group, *cols, *(["n", "n_missing"] if counts else []))


def long_predictions(df: DataFrame, keys, y: str = "y", p: str = "yhat") -> DataFrame:
    """Explode aligned y / yhat arrays into (keys, h, y, yhat) rows."""
    z = df.select(*keys, F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("yhat"))).alias("h", "z"))
    return z.select(*keys, F.col("h").cast("long").alias("h"), F.col("z.y").alias("y"), F.col("z.yhat").alias("yhat"))


def ensemble(pred: DataFrame, scores: DataFrame, keys, model: str = "model", name: str = "Ensemble") -> DataFrame:
    """R2-weighted average of the models' predictions per (keys, h): w_m = r2_m / sum(r2).
    The score table has one row per model (bounded), so it is broadcast. Where a model's prediction is missing, the weighted
    sum would fall short, so there is no ensemble prediction (NULL)."""
    every = Window.partitionBy()
    w = scores.select(model, (F.col("r2") / F.sum("r2").over(every)).alias("weight"), F.count(model).over(every).alias("_models"))
    j = pred.join(F.broadcast(w), model, "inner")
    total = F.when(F.count("yhat") == F.first("_models"), F.sum(F.col("weight") * F.col("yhat")))
    return j.groupBy(*keys, "h").agg(F.first("y").alias("y"), total.alias("yhat")).withColumn(model, F.lit(name))
