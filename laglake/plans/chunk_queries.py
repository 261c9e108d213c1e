"""Registered queries over chunked series: the chunk store, moments from shifted series, models of feature combinations; of imperfect
data: missing predictions, constant channels; and of whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from laglake.operators import chunks as C
from laglake.operators import forecast as FC
from laglake.operators import iterative as IT
from laglake.operators import metrics as MET
from laglake.operators.moments import gram_matrices
from laglake.operators.split import chrono_split
from laglake.operators.windows import make_windows
from laglake.plans import oracle_sql as O
from laglake.plans import queries as Q
from laglake.plans import views as V
from laglake.plans.experiment import evaluate_stored, prepare_dataset, run_single, run_zero_shot
from laglake.plans.views import with_views
from laglake.session import scratch_path
from laglake.sources.stores import append_run, read_runs
from laglake.spec import DatasetSpec, WindowSpec


def d6_chunks(spark, sf):
    """D6 written as chunks once and read back, with the split's positions."""
    path = C.write_chunks(C.chunk_series(V.d6(spark, sf), "segment", "ts", [], ["qty"], Q.D6_SPEC), scratch_path(spark, "chunks"))
    return C.with_split(C.read_chunks(spark, path), "segment", [], ["qty"], Q.D6_SPEC)


@Q.register("gram_lagcov", Q.QUERIES["gram_moments"][1])
def q_gram_lagcov(spark, sf):
    """The Gram matrix of the split windows from shifted series: no window is made."""
    rows = C.lag_gram(d6_chunks(spark, sf), [], ["qty"], Q.D6_SPEC, splits=("train", "val", "test"))
    g = rows.select("grp", "i", F.posexplode("v").alias("k", "v"))
    return g.select(F.col("grp").alias("split"), "i", (F.col("i") + F.col("k")).cast("int").alias("j"), Q.rnd("v").alias("v"))


@Q.register("windows_chunk_store", Q.QUERIES["windows_roundtrip"][1])
def q_windows_chunk_store(spark, sf):
    """Test windows cut from the stored chunks."""
    w = C.cut_windows(d6_chunks(spark, sf), "segment", "ts", [], ["qty"], Q.D6_SPEC)
    return Q.explode_xy(w.where("split = 'test'"), ["segment"])


@Q.register("chrono_split_chunks", Q.QUERIES["chrono_split"][1])
def q_chrono_split_chunks(spark, sf):
    w = C.cut_windows(d6_chunks(spark, sf), "segment", "ts", [], ["qty"], Q.D6_SPEC)
    return w.groupBy("segment", "split").agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _predict_sql():
    body = " UNION ALL ".join(f"SELECT segment, ts, CAST({h} AS BIGINT) AS h, round(y[{h + 1}], 6) AS y, "
                              f"round(list_dot_product(x, {Q._lit_list(Q.LIN_W[h])}) + {Q.LIN_B[h]!r}, 6) AS yhat FROM w" for h in range(2))
    return with_views(f", s AS ({O.d6_split()}), w AS (SELECT * FROM s WHERE split = 'test') " + body, "D6")


@Q.register("predict_chunks", _predict_sql())
def q_predict_chunks(spark, sf):
    """Predictions of the test windows, one matrix product per stored chunk."""
    coef = Q._coef(spark, "linear", FC.effective("linear", Q._lin_matrix(Q.LIN_W, Q.LIN_B), 8, 1, 2))
    p = C.predict_chunks(d6_chunks(spark, sf), coef, "segment", "ts", [], ["qty"], Q.D6_SPEC)
    long = MET.long_predictions(p, ["segment", "ts"])
    return long.select("segment", "ts", "h", Q.rnd("y").alias("y"), Q.rnd("yhat").alias("yhat"))


PAIR_SPEC = WindowSpec(lag=1, ahead=1, offset=1, minutes=1440)
PAIR_FEATURES = ("price", "disc")


def _pairs_sql():
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, covar_pop(x[1][{i + 1}], x[1][{i + 1}]) AS s11, covar_pop(x[1][3], x[1][3]) AS s22, covar_pop(x[1][{i + 1}], x[1][3]) AS s12, "
        f"covar_pop(x[1][{i + 1}], y[1]) AS s1y, covar_pop(x[1][3], y[1]) AS s2y, avg(x[1][{i + 1}]) AS m1, avg(x[1][3]) AS m2, avg(y[1]) AS my, count(*) AS n_train FROM tr"
        for i, c in enumerate(PAIR_FEATURES))
    return with_views(
        f", s AS ({O.split_cte(O.windows_cte('WIDE', ['segment'], 'ts', ['price', 'disc', 'qty'], ['qty'], 1, 1, 1, 1440), ['segment'], 'ts')}), "
        f"tr AS (SELECT x, y FROM s WHERE split = 'train'), m AS ({each}), "
        "w AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM m) "
        "SELECT feature, round(w1 * sqrt(s11), 5) AS w_feature, round(w2 * sqrt(s22), 5) AS w_target, round(my - w1 * m1 - w2 * m2, 4) AS intercept, n_train FROM w", "WIDE")


@Q.register("combination_fits", _pairs_sql())
def q_combination_fits(spark, sf):
    """A lag-1 model for each feature with the target, all solved from the one Gram matrix of the 3-channel series. Weights are per
    standard deviation of their channel, as prices and discounts differ by nine orders of magnitude."""
    chunks = C.with_split(C.chunk_series(V.wide(spark, sf), "segment", "ts", PAIR_FEATURES, ["qty"], PAIR_SPEC), "segment", PAIR_FEATURES, ["qty"], PAIR_SPEC)
    mats = gram_matrices(C.lag_gram(chunks, PAIR_FEATURES, ["qty"], PAIR_SPEC))
    rows = []
    if "train" in mats:
        for (feature,), m in FC.fit_combinations(mats, PAIR_FEATURES, ["qty"], 1, 1, 1).items():
            S, w, i = mats["train"], m["weights"], PAIR_FEATURES.index(feature)
            n = S[3, 3]
            std = [float(max(S[c, c] / n - (S[c, 3] / n) ** 2, 0.0) ** 0.5) for c in (i, 2)]
            rows.append((feature, float(w[0, 0]) * std[0], float(w[1, 0]) * std[1], float(w[2, 0]), int(round(n))))
    df = spark.createDataFrame(rows, "feature string, w_feature double, w_target double, intercept double, n_train long")
    return df.select("feature", Q.rnd("w_feature", 5).alias("w_feature"), Q.rnd("w_target", 5).alias("w_target"), Q.rnd("intercept", 4).alias("intercept"), "n_train")


@Q.register("fit_lag2_iterative", Q.QUERIES["fit_lag2"][1])
def q_fit_lag2_iterative(spark, sf):
    """The ridge fits of two input steps by conjugate gradients over the chunked series: all strengths in the same passes, no Gram matrix."""
    chunks = C.with_split(C.chunk_series(V.d6(spark, sf), "segment", "ts", [], ["qty"], Q.LAG2_SPEC), "segment", [], ["qty"], Q.LAG2_SPEC)
    rows = [(kind, c["lambda"], *map(float, c["weights"][:, 0]), int(round(c["n_train"])), c["val_mse"])
            for kind in ("linear", "nlinear") for c in IT.iterative_path(chunks, [], ["qty"], Q.LAG2_SPEC, kind, Q.LAG2_LAMBDAS)]
    df = spark.createDataFrame(rows, "model string, lambda double, w0 double, w1 double, bias double, n_train long, val_mse double")
    return df.select("model", "lambda", Q.rnd("w0").alias("w0"), Q.rnd("w1").alias("w1"), Q.rnd("bias", 4).alias("bias"), "n_train", Q.rnd("val_mse", 2).alias("val_mse"))


_GAPPY = "CASE WHEN x[-1] > avg_x THEN x[-1] END"


def _missing_sql():
    return with_views(
        f", s AS ({O.d6_split()}), w AS (SELECT *, list_avg(x) AS avg_x FROM s WHERE split = 'test'), "
        f"p AS (SELECT UNNEST(range(len(y))) AS h, UNNEST(y) AS y, {_GAPPY} AS yhat FROM w), "
        "r AS (SELECT avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END) AS r2 FROM "
        "(SELECT sum((y - yhat) * (y - yhat)) AS sse, count(*) * var_pop(y) AS sst FROM p WHERE yhat IS NOT NULL GROUP BY h)) "
        "SELECT 'gappy' AS model, round((SELECT r2 FROM r), 6) AS r2, round(avg(abs(y - yhat)), 6) AS mae, round(avg((y - yhat) * (y - yhat)), 6) AS mse, "
        "round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, count(yhat) AS n, count(*) - count(yhat) AS n_missing FROM p HAVING count(*) > 0", "D6")


@Q.register("metrics_missing", _missing_sql())
def q_metrics_missing(spark, sf):
    """Scores of a model that gives no prediction where the last value is below the window's mean: such rows are left out of every
    metric, and counted."""
    w = Q.d6_split_windows(spark, sf).where("split = 'test'")
    last, mean = F.element_at("x", -1), F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    p = w.select("segment", "ts", "y", F.transform("y", lambda _: F.when(last > mean, last)).alias("yhat")).withColumn("model", F.lit("gappy"))
    out = MET.score(MET.long_predictions(p, ["model", "segment", "ts"]), ["model"], metrics=("r2", "mae", "mse", "rmse"), counts=True)
    return out.select("model", *[Q.rnd(c).alias(c) for c in ("r2", "mae", "mse", "rmse")], "n", "n_missing")


@Q.register("constant_channel_fit", with_views(
    f", s AS ({O.split_cte(O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 1, 1, 1, 1440), ['segment'], 'ts')}), "
    "tr AS (SELECT x[1] AS xv, y[1] AS yv FROM s WHERE split = 'train') "
    "SELECT CAST(0 AS DOUBLE) AS w_constant, round(regr_slope(yv, xv), 6) AS slope, round(regr_intercept(yv, xv), 4) AS intercept, count(*) AS n_train FROM tr", "D6"))
def q_constant_channel_fit(spark, sf):
    """A lag-1 model whose first channel is the same everywhere (the flags' length): it gets no weight, the others are as without it."""
    df = V.d6(spark, sf).withColumn("flags", F.length("segment").cast("double"))
    acc, _ = chrono_split(make_windows(df, "segment", "ts", ["flags"], ["qty"], PAIR_SPEC, strategy=Q.VIEW_STRATEGY, on_grid=True), "segment", (0.7, 0.1, 0.2))
    m = FC.fit(acc, "linear", lambdas=(0.0,), L=1, F_=2, A=1)
    rows = [(float(m["weights"][0, 0]), float(m["weights"][1, 0]), float(m["weights"][2, 0]), int(round(m["n_train"])))] if m else []
    out = spark.createDataFrame(rows, "w_constant double, slope double, intercept double, n_train long")
    return out.select("w_constant", Q.rnd("slope").alias("slope"), Q.rnd("intercept", 4).alias("intercept"), "n_train")


@Q.register("runs_appended_again", Q.QUERIES["windows_roundtrip"][1])
def q_runs_appended_again(spark, sf):
    """Split windows appended to a store of runs, the same run twice: its rows are there once."""
    path = scratch_path(spark, "runs")
    w = Q.d6_split_windows(spark, sf).select("segment", "ts", "split", "x", "y")
    for _ in range(2):
        append_run(w, path, "first", partition_by=["split"], sort_within=["segment", "ts"])
    return Q.explode_xy(read_runs(spark, path).where("split = 'test'"), ["segment"])


# ---- whole flows at lag 1, where the fit has a closed form

AR1 = WindowSpec(lag=1, ahead=1, offset=1, minutes=1440)
AR1_HOURLY = WindowSpec(lag=1, ahead=1, offset=1, minutes=60)


def _ar1_d6(spark, sf):
    return prepare_dataset(spark, DatasetSpec(path="", target=("qty",), date="ts", segment="segment", name="D6"), AR1, source=V.d6(spark, sf),
                           normalization="standard", strategy=Q.VIEW_STRATEGY, on_grid=True)


def _ar1_h5(spark, sf):
    return prepare_dataset(spark, DatasetSpec(path="", target=("value",), date="ts", segment="segment", name="H5", granularity=60), AR1_HOURLY,
                           source=V.h5(spark, sf), normalization="standard", strategy=Q.VIEW_STRATEGY, on_grid=True)


def _flow_sql(other: bool) -> str:
    """AR(1) fitted on D6's training windows, scored on D6's own test windows, or on those of H5 in H5's own scale."""
    parts = ""
    for view, ch, minutes in (("D6", "qty", 1440), ("H5", "value", 60)):
        cut = O.split_cte(O.windows_cte(view, ["segment"], "ts", [ch], [ch], 1, 1, 1, minutes), ["segment"], "ts")
        parts += (f", s{view} AS ({cut}), b{view} AS (SELECT segment, max(ts) FILTER (WHERE split = 'train') AS last FROM s{view} GROUP BY 1), "
                  f"t{view} AS (SELECT avg({ch}) AS m, stddev_samp({ch}) AS s FROM {view} JOIN b{view} USING (segment) WHERE ts <= last)")
    fit = ", f AS (SELECT regr_slope(y[1], x[1]) AS b, regr_intercept(y[1], x[1]) AS a FROM sD6 WHERE split = 'train')"
    if other:
        p = (", p AS (SELECT 'linear' AS model, 0 AS h, y[1] AS y, f.b * (x[1] - tH5.m) + (f.a + f.b * tD6.m - tD6.m) / tD6.s * tH5.s + tH5.m AS yhat "
             "FROM sH5, f, tD6, tH5 WHERE split = 'test')")
    else:
        p = ", p AS (SELECT 'linear' AS model, 0 AS h, y[1] AS y, f.b * x[1] + f.a AS yhat FROM sD6, f WHERE split = 'test')"
    return with_views(parts + fit + p + Q._metric_sql() + f"SELECT model, {Q._METRIC_COLS} FROM pooled JOIN r2 USING (model)", "D6", "H5")


def _rounded(scores):
    return scores.select("model", *[Q.rnd(m).alias(m) for m in MET.ALL_METRICS])


@Q.register("single_flow_ar1", _flow_sql(False))
def q_single_flow_ar1(spark, sf):
    """Read, clean, window, split, scale, fit, predict, unscale and score one dataset."""
    return _rounded(run_single(spark, _ar1_d6(spark, sf), kinds=("linear",), lambdas=(0.0,)))


@Q.register("zero_shot_flow_ar1", _flow_sql(True))
def q_zero_shot_flow_ar1(spark, sf):
    """The same with the fit on one dataset and the scores on another."""
    return _rounded(run_zero_shot(spark, _ar1_h5(spark, sf), [_ar1_d6(spark, sf)], kinds=("linear",), lambdas=(0.0,)))


@Q.register("stored_flow_ar1", _flow_sql(True))
def q_stored_flow_ar1(spark, sf):
    """The same with the coefficients stored and loaded in between."""
    path = scratch_path(spark, "ar1-models")
    run_single(spark, _ar1_d6(spark, sf), kinds=("linear",), lambdas=(0.0,), model_path=path)
    return _rounded(evaluate_stored(spark, _ar1_h5(spark, sf), path, kinds=("linear",)))


CHOICES = (0.0, 3e5, 3e6, 3e7, 3e8)


def _choice_sql() -> str:
    cut = O.split_cte(O.windows_cte("D1", [], "ts", ["qty"], ["qty"], 1, 1, 1, 1440), [], "ts")
    lam = ", ".join(f"({v!r})" for v in CHOICES)
    return with_views(
        f", s AS ({cut}), st AS (SELECT regr_sxy(y[1], x[1]) AS sxy, regr_sxx(y[1], x[1]) AS sxx, regr_avgx(y[1], x[1]) AS ax, regr_avgy(y[1], x[1]) AS ay "
        f"FROM s WHERE split = 'train'), w AS (SELECT CAST(l AS DOUBLE) AS lam, sxy / (sxx + l) AS b, ay - sxy / (sxx + l) * ax AS a FROM st, (VALUES {lam}) t(l)), "
        "e AS (SELECT lam, b, a, avg((b * x[1] + a - y[1]) * (b * x[1] + a - y[1])) AS mse FROM w, s WHERE split = 'val' GROUP BY ALL) "
        "SELECT lam AS lambda, round(b, 8) AS slope, round(a, 4) AS intercept FROM e ORDER BY mse, lam LIMIT 1", "D1")


@Q.register("select_lambda_ar1", _choice_sql())
def q_select_lambda_ar1(spark, sf):
    """The ridge strength with the least validation error, from the two Gram matrices alone."""
    m = FC.fit(Q.d1_ar1_split(spark, sf), "linear", lambdas=CHOICES, L=1, A=1)
    rows = [(float(m["lambda"]), float(m["weights"][0, 0]), float(m["weights"][1, 0]))] if m else []
    df = spark.createDataFrame(rows, "lambda double, slope double, intercept double")
    return df.select("lambda", Q.rnd("slope", 8).alias("slope"), Q.rnd("intercept", 4).alias("intercept"))
