"""The two top-level flows of the reference as plain functions over DataFrames.

``prepare_dataset``: one dataset -> cleaned series -> windows -> chronological split -> scaler
fitted on training rows -> scaled windows (affine, so no second window pass), raw splits, rejects.
``run_zero_shot``: target + source datasets -> assembly -> fits of every linear kind from one Gram
pass -> predictions on the target's test windows -> metrics with the target's scaler -> ensemble."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.operators import forecast as FC
from laglake.operators import metrics as MET
from laglake.operators.assemble import assemble_zero_shot
from laglake.operators.common import qc
from laglake.operators.expand import union_all
from laglake.operators.prepare import prepare
from laglake.operators.scale import fit_scaler
from laglake.operators.split import chrono_split, raw_split, raw_split_single, rejected_segments, split_bounds
from laglake.operators.windows import grid_check, make_windows
from laglake.session import materialize
from laglake.sources.csv_scan import read_series
from laglake.spec import DatasetSpec, WindowSpec, unique

SEGMENT = "__series"


@dataclass
class PreparedDataset:
    name: str
    spec: DatasetSpec
    window: WindowSpec
    series: DataFrame         # cleaned series (segment, ts, channels)
    windows: DataFrame        # split windows: segment, ts, tus, x, y, rn, n, split (scaled if normalization)
    rejected: DataFrame       # segment, n, reason
    raw: DataFrame            # raw rows with split label (a row can sit in two splits)
    scaler: DataFrame | None  # one row per channel
    key: str


def scale_windows(windows: DataFrame, stats: DataFrame, channels, targets, method: str) -> DataFrame:
    """Scale x (steps x channels, or one channel) and y (ahead x targets) with per-channel stats.
    The stats table has one row per channel; its values become literals. A channel that is constant in training scales to 0 under
    minmax and standard (a warning names it): it tells a model nothing, and the inverse gives the constant again."""
    rows = {r["channel"]: r.asDict() for r in stats.collect()}
    constant = [c for c in unique([*channels, *targets]) if c in rows and not (rows[c]["max"] - rows[c]["min"])]
    if constant and method != "robust":
        warnings.warn(f"constant in the training rows, scaled to 0: {constant}", stacklevel=2)

    def f(v, c):
        s = rows.get(c)
        if s is None:   # no training row at all: nothing to scale against
            return F.lit(None).cast("double")
        if method == "minmax":
            den = s["max"] - s["min"]
            return (v - F.lit(s["min"])) / F.lit(den) if den else v * 0
        if method == "standard":
            return (v - F.lit(s["mean"])) / F.lit(s["std"]) if s["std"] and c not in constant else v * 0
        return (v - F.lit(s["median"])) / F.lit(s["iqr"] + 1e-12)

    channels, targets = list(channels), list(targets)
    if len(channels) == 1:
        x = F.transform("x", lambda v: f(v, channels[0]))
    else:
        x = F.transform("x", lambda step: F.array(*[f(F.element_at(step, i + 1), c) for i, c in enumerate(channels)]))
    T = len(targets)
    if T == 1:
        y = F.transform("y", lambda v: f(v, targets[0]))
    else:
        y = F.transform("y", lambda v, i: F.coalesce(*[F.when(i % T == j, f(v, t)) for j, t in enumerate(targets)]))
    return windows.withColumn("x", x).withColumn("y", y)


def prepare_dataset(spark: SparkSession, spec: DatasetSpec, window: WindowSpec, source: DataFrame | None = None,
                    normalization: str | None = None, strategy: str = "auto", null_scope: str = "all",
                    strict_parity: bool = False, materialize_windows: bool = True,
                    materialize_series: bool = True, on_grid: bool | None = None) -> PreparedDataset:
    """``materialize_series`` / ``materialize_windows``: write the cleaned series and the window table
    once to the shared scratch folder and read them back. The series feeds the windows, the rejects
    and the raw splits, and the windows feed the split, rejects and boundaries; without this each
    consumer would re-parse and re-shuffle the input (and lineage is cut for recovery)."""
    if window.minutes != spec.granularity:
        raise ValueError(f"window step {window.minutes} min differs from the dataset granularity {spec.granularity} min")
    raw_in = source if source is not None else read_series(spark, spec)
    series = prepare(raw_in, spec, null_scope=null_scope)
    if materialize_series:
        series = materialize(series, f"series-{spec.name}")
    key = spec.segment
    if key is None:
        series = series.withColumn(SEGMENT, F.lit("all"))
        key = SEGMENT
    single = spec.segment is None
    if single:   # one series is one key: always spread it over time chunks
        if strategy == "auto":
            strategy = "halo" if on_grid or grid_check(series, key, spec.date, window.minutes)["on_grid"] else "dense_halo"
        strategy = {"range": "halo", "dense": "dense_halo"}.get(strategy, strategy)
    w = make_windows(series, key, spec.date, spec.features, spec.target, window, strategy=strategy, on_grid=on_grid)
    if materialize_windows:
        w = materialize(w, f"windows-{spec.name}")
    acc, split_rej = chrono_split(w, key, window.ratios, strict_parity=strict_parity)
    rej = rejected_segments(series, w, key, window.ratios, split_rejects=split_rej)
    bounds = split_bounds(acc, key, spec.date)
    if single:   # sliced by the sample indices of the windows, as there is no segment to split by date
        raw = raw_split_single(series, w.agg(F.count(F.lit(1)).alias("n")), spec.date, window.ratios)
    else:
        raw = raw_split(series, bounds, key, spec.date)
    stats = None
    if normalization:
        stats = fit_scaler(raw.where(F.col("split") == "train"), list(spec.channels), normalization)
        acc = scale_windows(acc, stats, spec.channels, spec.target, normalization)
    return PreparedDataset(spec.name, spec, window, series, acc, rej, raw, stats, key)


def _named(d: PreparedDataset) -> DataFrame:
    """The windows with their key as ``segment`` (text) and their date as ``ts``, whatever the dataset calls them."""
    rest = [c for c in d.windows.columns if c not in (d.key, d.spec.date)]
    return d.windows.select(qc(d.key).cast("string").alias("segment"), qc(d.spec.date).alias("ts"), *[qc(c) for c in rest])


def run_zero_shot(spark: SparkSession, target: PreparedDataset, sources: list[PreparedDataset],
                  kinds=FC.KINDS, lambdas=(0.0, 1.0, 10.0, 100.0), ensemble: bool = True) -> DataFrame:
    """Metrics per model kind (and the R2-weighted ensemble) on the target's test windows,
    fitted on the sources' train / val windows, scored with the target's scaler."""
    shapes = {d.name: (d.window.lag, len(d.spec.channels), d.window.ahead * len(d.spec.target))
              for d in [target, *sources]}
    a = assemble_zero_shot(_named(target), {d.name: _named(d) for d in sources}, target_name=target.name, shapes=shapes)
    L, F_, A = shapes[target.name]
    mats = FC.split_grams(a.where(F.col("dataset") != target.name), n_terms=L * F_ + 1 + A)
    scaler = None
    if target.scaler is not None:
        first = target.spec.target[0]
        r = target.scaler.where(F.col("channel") == first).first()
        scaler = r.asDict() if r else None
    fitted = {}
    for kind in kinds:
        m = FC.fit(kind=kind, lambdas=lambdas, L=L, F_=F_, A=A, mats=mats)
        if m is not None:
            fitted[kind] = FC.coefficient_table(spark, kind, m["weights"])
    if not fitted:
        raise ValueError("no training windows in the source datasets")
    return _score_kinds(spark, fitted, a.where(F.col("dataset") == target.name), scaler, ensemble)


def _target_scaler(d: PreparedDataset) -> dict | None:
    if d.scaler is None:
        return None
    r = d.scaler.where(F.col("channel") == d.spec.target[0]).first()
    return r.asDict() if r else None


def _score_kinds(spark, fitted: dict, test: DataFrame, scaler, ensemble: bool) -> DataFrame:
    """Scores of each model and of their ensemble on ``test`` (windows keyed by segment and ts). Predictions are written
    once; the scores and the ensemble read them. The ensemble's weights are R2, which scaling leaves alone, so they come
    from the scores themselves."""
    preds = [MET.long_predictions(FC.predict(test, coef).withColumn("model", F.lit(kind)), ["model", "segment", "ts"])
             for kind, coef in fitted.items()]
    long = materialize(union_all(preds), "predictions")
    scores = materialize(MET.score(long, ["model"], scaler=scaler), "scores")
    if ensemble and len(preds) > 1:
        e = MET.ensemble(long, scores, ["segment", "ts"])
        scores = scores.unionByName(MET.score(e, ["model"], scaler=scaler))
    return scores


def run_single(spark: SparkSession, ds: PreparedDataset, kinds=FC.KINDS, lambdas=(0.0, 1.0, 10.0, 100.0),
               ensemble: bool = True, model_path: str | None = None, version: int = 1) -> DataFrame:
    """One dataset: fit every kind on its train windows (lambda chosen on val, one Gram pass),
    optionally store the coefficients, score on its test windows with its own scaler."""
    L, F_, A = ds.window.lag, len(ds.spec.channels), ds.window.ahead * len(ds.spec.target)
    mats = FC.split_grams(ds.windows, n_terms=L * F_ + 1 + A)
    fitted = {}
    for kind in kinds:
        m = FC.fit(kind=kind, lambdas=lambdas, L=L, F_=F_, A=A, mats=mats)
        if m is None:
            continue
        fitted[kind] = FC.coefficient_table(spark, kind, m["weights"], version)
        if model_path:
            FC.save_model(fitted[kind], model_path)
    if not fitted:
        raise ValueError("no training windows")
    return _score_kinds(spark, fitted, _named(ds).where(F.col("split") == "test"), _target_scaler(ds), ensemble)


def evaluate_stored(spark: SparkSession, target: PreparedDataset, model_path: str, kinds=FC.KINDS,
                    ensemble: bool = True) -> DataFrame:
    """Zero-shot evaluation of stored models: load each kind's latest coefficients (a filtered,
    partition-pruned read), predict the target's test windows, score with the target's scaler."""
    fitted = {k: FC.load_model(spark, model_path, k) for k in kinds}
    return _score_kinds(spark, fitted, _named(target).where(F.col("split") == "test"), _target_scaler(target), ensemble)
