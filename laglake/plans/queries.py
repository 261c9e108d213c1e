"""Registered queries: one per operator of the inventory, each reading the driver tables.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql or None)``.
Window arrays are exploded to (pos, value) rows and floats rounded to 6 decimals so the
DuckDB oracle can compare values exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laglake.functions import sequence as S
from laglake.functions.activations import ACTIVATIONS
from laglake.functions.calendar import cyclical_pattern, time_encode
from laglake.operators import forecast as FC
from laglake.operators import metrics as MET
from laglake.operators.assemble import assemble_zero_shot, shuffle_windows
from laglake.operators.expand import channel_catalogue, combination_series, feature_combinations, union_all, univariate_unpivot
from laglake.operators.features import t2v_revin_frame, time2vec_weights
from laglake.operators.grid import fill_date, fill_gaps
from laglake.operators.moments import gram
from laglake.operators.prepare import dedupe_key, prepare, shrink_plan, shrink_types, strip_time
from laglake.operators.quantiles import exact_quantiles
from laglake.operators.scale import apply_scaler, fit_scaler
from laglake.operators.split import chrono_split, raw_split, raw_split_single, rejected_segments, split_bounds
from laglake.operators.windows import lag_columns, make_windows
from laglake.plans import oracle_sql as O
from laglake.plans import views as V
from laglake.plans.experiment import evaluate_stored, prepare_dataset, run_single, run_zero_shot, scale_windows
from laglake.plans.views import with_views
from laglake.session import scratch_path
from laglake.sources.csv_scan import read_series, write_series_csv
from laglake.sources.stores import read_windows, write_table, write_windows
from laglake.spec import DatasetSpec, StripTime, WindowSpec

R = 6
QUERIES: dict = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def rnd(c, digits: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def explode_xy(w: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, part, pos, value) rows of the x and y arrays of a one-channel window table."""
    x = w.select(*keys, "ts", F.lit("x").alias("part"), F.posexplode("x").alias("pos", "value"))
    y = w.select(*keys, "ts", F.lit("y").alias("part"), F.posexplode("y").alias("pos", "value"))
    return x.unionByName(y).select(*keys, "ts", "part", F.col("pos").cast("long").alias("pos"), rnd("value").alias("value"))


SQL_EXPLODE_XY = """SELECT {k}ts, 'x' AS part, UNNEST(range(len(x))) AS pos, round(UNNEST(x), 6) AS value FROM w
UNION ALL SELECT {k}ts, 'y' AS part, UNNEST(range(len(y))) AS pos, round(UNNEST(y), 6) AS value FROM w"""

D6_SPEC = WindowSpec(lag=8, ahead=2, offset=3, minutes=1440)
# The series views aggregate to a bounded date domain (days or hours of the tables' span), so each
# series has a bounded length at any scale factor: one RANGE window per series is the right plan.
# Unsegmented series and raw, unbounded inputs use the halo plan instead.
VIEW_STRATEGY = "range"


def d6_windows(spark, sf, strategy=VIEW_STRATEGY, spec=D6_SPEC):
    return make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], spec, strategy=strategy, on_grid=True)


def d6_split_windows(spark, sf, strategy=VIEW_STRATEGY, on_grid=True):
    acc, _ = chrono_split(d6_windows(spark, sf, strategy), "segment", (0.7, 0.1, 0.2))
    return acc


# ---------------------------------------------------------------- windows and split
@register("chrono_split", with_views(
    f"SELECT segment, split, count(*) AS n_windows, min(ts) AS first_ts, max(ts) AS last_ts "
    f"FROM ({O.d6_split()}) GROUP BY 1, 2", "D6"))
def q_chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    return (d6_split_windows(spark, sf).groupBy("segment", "split")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@register("chrono_split_halo", with_views(
    f"SELECT segment, split, count(*) AS n_windows, min(ts) AS first_ts, max(ts) AS last_ts "
    f"FROM ({O.d6_split()}) GROUP BY 1, 2", "D6"))
def q_chrono_split_halo(spark, sf):
    return (d6_split_windows(spark, sf, "halo").groupBy("segment", "split")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@register("split_bounds", with_views(
    f"SELECT segment, max(ts) FILTER (WHERE split = 'train') AS train_max, max(ts) FILTER (WHERE split = 'val') AS val_max, "
    f"min(ts) FILTER (WHERE split = 'val') AS val_min, min(ts) FILTER (WHERE split = 'test') AS test_min "
    f"FROM ({O.d6_split()}) GROUP BY 1", "D6"))
def q_split_bounds(spark, sf):
    return split_bounds(d6_split_windows(spark, sf), "segment", "ts")


@register("lag_windows", with_views(
    f", w AS ({O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 8, 2, 3, 1440)})\n"
    + SQL_EXPLODE_XY.format(k="segment, "), "D6"))
def q_lag_windows(spark, sf):
    return explode_xy(d6_windows(spark, sf), ["segment"])


@register("lag_windows_dense", QUERIES["lag_windows"][1])
def q_lag_windows_dense(spark, sf):
    return explode_xy(d6_windows(spark, sf, "dense"), ["segment"])


@register("lag_windows_dense_halo", QUERIES["lag_windows"][1])
def q_lag_windows_dense_halo(spark, sf):
    """Grid + ROWS frames per (segment, block of 256 positions): skew-safe dense windows."""
    w = make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], D6_SPEC, strategy="dense_halo", chunk_steps=256)
    return explode_xy(w, ["segment"])


WIDE_SPEC = WindowSpec(lag=4, ahead=1, offset=1, minutes=1440)


@register("lag_windows_multi", with_views(
    f", w AS ({O.windows_cte('WIDE', ['segment'], 'ts', ['price', 'disc', 'qty'], ['qty'], 4, 1, 1, 1440)}), "
    "xs AS (SELECT segment, ts, UNNEST(range(len(x))) AS step, UNNEST(x) AS v FROM w) "
    "SELECT segment, ts, 'x' AS part, step, UNNEST(range(len(v))) AS ch, round(UNNEST(v), 6) AS value FROM xs "
    "UNION ALL SELECT segment, ts, 'y' AS part, UNNEST(range(len(y))) AS step, CAST(0 AS BIGINT) AS ch, "
    "round(UNNEST(y), 6) AS value FROM w", "WIDE"))
def q_lag_windows_multi(spark, sf):
    w = make_windows(V.wide(spark, sf), "segment", "ts", ["price", "disc"], ["qty"], WIDE_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    xs = w.select("segment", "ts", F.posexplode("x").alias("step", "v"))
    x = xs.select("segment", "ts", F.lit("x").alias("part"), F.col("step").cast("long").alias("step"),
                  F.posexplode("v").alias("ch", "value"))
    y = w.select("segment", "ts", F.lit("y").alias("part"), F.posexplode("y").alias("step", "value"),
                 F.lit(0).alias("ch"))
    return x.unionByName(y.select(x.columns)).select(
        "segment", "ts", "part", F.col("step").cast("long").alias("step"), F.col("ch").cast("long").alias("ch"),
        rnd("value").alias("value"))


@register("lag_columns", with_views(
    ", g AS (SELECT segment, UNNEST(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM D6 GROUP BY 1), "
    "dd AS (SELECT coalesce(D6.segment, g.segment) AS segment, coalesce(D6.ts, g.ts) AS ts, D6.qty "
    "FROM D6 FULL OUTER JOIN g ON D6.segment = g.segment AND D6.ts = g.ts) "
    "SELECT segment, ts, qty, lag(qty, 1) OVER w AS qty_lag_1, lag(qty, 2) OVER w AS qty_lag_2, "
    "lag(qty, 3) OVER w AS qty_lag_3 FROM dd WINDOW w AS (PARTITION BY segment ORDER BY ts)", "D6"))
def q_lag_columns(spark, sf):
    dense = fill_date(V.d6(spark, sf), "segment", "ts", 1440)
    return lag_columns(dense, "segment", "ts", ["qty"], WindowSpec(lag=3, ahead=1, offset=1))


@register("lag_columns_halo", QUERIES["lag_columns"][1])
def q_lag_columns_halo(spark, sf):
    """Time-shift lag columns per (segment, time chunk): no single task holds a whole series."""
    dense = fill_date(V.d6(spark, sf), "segment", "ts", 1440)
    return lag_columns(dense, "segment", "ts", ["qty"], WindowSpec(lag=3, ahead=1, offset=1), strategy="halo",
                       chunk_steps=256)


USER_SPEC = WindowSpec(lag=3, ahead=1, offset=1, minutes=1440)


@register("rejected_segments", with_views(
    f", w AS ({O.windows_cte('USERD', ['segment'], 'ts', ['value'], ['value'], 3, 1, 1, 1440)}), "
    "c AS (SELECT segment, count(*) AS n FROM w GROUP BY 1), "
    "t AS (SELECT segment, n, CAST(ceil(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS tr, "
    "CAST(floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS BIGINT) AS va FROM c) "
    "SELECT segment, n, CASE WHEN least(tr, n) <= 0 THEN 'empty train' "
    "WHEN greatest(least(va, n) - tr, 0) <= 0 THEN 'empty val' "
    "WHEN n - least(greatest(tr, va), n) <= 0 THEN 'empty test' END AS reason FROM t "
    "WHERE least(tr, n) <= 0 OR greatest(least(va, n) - tr, 0) <= 0 OR n - least(greatest(tr, va), n) <= 0 "
    "UNION ALL SELECT DISTINCT segment, CAST(0 AS BIGINT) AS n, 'no window' AS reason FROM USERD "
    "WHERE segment NOT IN (SELECT segment FROM c)", "USERD"))
def q_rejected_segments(spark, sf):
    s = V.userd(spark, sf)
    w = make_windows(s, "segment", "ts", ["value"], ["value"], USER_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    return rejected_segments(s, w, "segment", (0.7, 0.1, 0.2))


@register("raw_split", with_views(
    f", s AS ({O.d6_split()}), b AS (SELECT segment, max(ts) FILTER (WHERE split = 'train') AS train_max, "
    "max(ts) FILTER (WHERE split = 'val') AS val_max, min(ts) FILTER (WHERE split = 'val') AS val_min, "
    "min(ts) FILTER (WHERE split = 'test') AS test_min FROM s GROUP BY 1) "
    "SELECT D6.segment, D6.ts, round(D6.qty, 6) AS qty, 'train' AS split FROM D6 JOIN b USING (segment) WHERE D6.ts <= train_max "
    "UNION ALL SELECT D6.segment, D6.ts, round(D6.qty, 6), 'val' FROM D6 JOIN b USING (segment) WHERE D6.ts BETWEEN val_min AND val_max "
    "UNION ALL SELECT D6.segment, D6.ts, round(D6.qty, 6), 'test' FROM D6 JOIN b USING (segment) WHERE D6.ts >= test_min",
    "D6"))
def q_raw_split(spark, sf):
    b = split_bounds(d6_split_windows(spark, sf), "segment", "ts")
    out = raw_split(V.d6(spark, sf), b, "segment", "ts")
    return out.select("segment", "ts", rnd("qty").alias("qty"), "split")


D1_SPEC = WindowSpec(lag=7, ahead=1, offset=1, minutes=1440)


@register("raw_split_single", with_views(
    f", w AS ({O.windows_cte('D1', [], 'ts', ['qty'], ['qty'], 7, 1, 1, 1440)}), "
    "nw AS (SELECT count(*) AS n FROM w), "
    "rr AS (SELECT ts, qty, row_number() OVER (ORDER BY ts) - 1 AS rr FROM D1) "
    "SELECT ts, round(qty, 6) AS qty, CASE WHEN rr < CAST(ceil(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train' "
    "WHEN rr < CAST(floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS BIGINT) THEN 'val' ELSE 'test' END AS split "
    "FROM rr, nw", "D1"))
def q_raw_split_single(spark, sf):
    d = V.d1(spark, sf)
    w = make_windows(d, None, "ts", ["qty"], ["qty"], D1_SPEC, strategy="halo")
    nw = w.agg(F.count(F.lit(1)).alias("n"))
    out = raw_split_single(d, nw, "ts", (0.7, 0.1, 0.2), chunk_minutes=4096 * 1440)
    return out.select("ts", rnd("qty").alias("qty"), "split")


# ---------------------------------------------------------------- entry (flagship)
ENTRY_SQL = with_views(
    f"SELECT split, count(*) AS n_windows, min(ts) AS first_ts, max(ts) AS last_ts FROM "
    f"({O.split_cte(O.windows_cte('D1', [], 'ts', ['qty'], ['qty'], 7, 1, 1, 1440), [], 'ts')}) GROUP BY 1", "D1")


def flagship(spark, sf):
    """Unsegmented daily lineitem quantity -> halo windows (lag 7) -> chronological split counts."""
    w = make_windows(V.d1(spark, sf), None, "ts", ["qty"], ["qty"], D1_SPEC, strategy="halo")
    acc, _ = chrono_split(w, None, (0.7, 0.1, 0.2))
    return (acc.groupBy("split").agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts").alias("first_ts"),
                                     F.max("ts").alias("last_ts")))


register("flagship_split", ENTRY_SQL)(flagship)


# ---------------------------------------------------------------- cleaning

EVENTS_SPEC = DatasetSpec(path="", target=("value",), date="ts", features=("user_id",), segment="event_type",
                          granularity=60, name="events")


@register("prepare", "SELECT ts, event_type, user_id, round(value, 6) AS value FROM ("
          "SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id, user_id, value, props) AS rk "
          "FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL "
          "AND value IS NOT NULL AND props IS NOT NULL) WHERE rk = 1")
def q_prepare(spark, sf):
    out = prepare(V.table(spark, sf, "events"), EVENTS_SPEC, null_scope="all")
    return out.select("ts", "event_type", "user_id", rnd("value").alias("value"))


@register("dedupe_key", "SELECT event_type, hour, event_id, ts, user_id, round(value, 6) AS value, props FROM ("
          "SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) "
          "ORDER BY event_id, ts, user_id, value, props) AS rk FROM events) WHERE rk = 1")
def q_dedupe_key(spark, sf):
    from laglake.functions.timecols import floor_to_step
    ev = V.table(spark, sf, "events").withColumn("hour", floor_to_step("ts", 60))
    out = dedupe_key(ev, ["event_type", "hour"], order_cols=["event_id", "ts", "user_id", "value", "props"])
    return out.select("event_type", "hour", "event_id", "ts", "user_id", rnd("value").alias("value"), "props")


STRIP_DATE = StripTime("%Y-%m-%d", (2024, 1, 5), (2024, 1, 20))
STRIP_TOD = StripTime("%H:%M", (8, 0), (17, 30))


@register("strip_time_date", "SELECT event_id, ts, event_type, round(value, 6) AS value FROM events "
          "WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'")
def q_strip_time_date(spark, sf):
    out = strip_time(V.table(spark, sf, "events"), "ts", STRIP_DATE)
    return out.select("event_id", "ts", "event_type", rnd("value").alias("value"))


@register("strip_time_of_day", "SELECT event_id, ts, event_type, round(value, 6) AS value FROM events "
          "WHERE strftime(ts, '%H:%M') BETWEEN '08:00' AND '17:30'")
def q_strip_time_of_day(spark, sf):
    out = strip_time(V.table(spark, sf, "events"), "ts", STRIP_TOD)
    return out.select("event_id", "ts", "event_type", rnd("value").alias("value"))


def _shrink_sql(table: str, cols) -> str:
    parts = []
    for c, kind in cols:
        if kind == "string":
            parts.append(f"SELECT '{c}' AS column_name, 'string' AS kind, CAST(NULL AS DOUBLE) AS min_value, "
                         f"CAST(NULL AS DOUBLE) AS max_value, 'string' AS to_type")
            continue
        mn, mx = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
        if kind == "int":
            to = (f"CASE WHEN {mn} > -128 AND {mx} < 127 THEN 'int8' WHEN {mn} > -32768 AND {mx} < 32767 THEN 'int16' "
                  f"WHEN {mn} > -2147483648 AND {mx} < 2147483647 THEN 'int32' ELSE 'int64' END")
        else:
            to = f"CASE WHEN {mn} > -3.4028234663852886e38 AND {mx} < 3.4028234663852886e38 THEN 'float32' ELSE 'float64' END"
        parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS kind, {mn} AS min_value, {mx} AS max_value, {to} AS to_type "
                     f"FROM {table}")
    return " UNION ALL ".join(parts)


@register("shrink_types", _shrink_sql("lineitem", [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
    ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
    ("l_returnflag", "string"), ("l_linestatus", "string")]))
def q_shrink_types(spark, sf):
    return shrink_plan(V.table(spark, sf, "lineitem"))


H5_GRID_SQL = (", g AS (SELECT segment, UNNEST(generate_series(min(ts), max(ts), INTERVAL 60 MINUTE)) AS ts FROM H5 GROUP BY 1), "
               "dd AS (SELECT coalesce(H5.segment, g.segment) AS segment, coalesce(H5.ts, g.ts) AS ts, H5.value "
               "FROM H5 FULL OUTER JOIN g ON H5.segment = g.segment AND H5.ts = g.ts) ")


def h5_dense(spark, sf):
    return fill_date(V.h5(spark, sf), "segment", "ts", 60)


@register("fill_date", with_views(H5_GRID_SQL + "SELECT segment, ts, round(value, 6) AS value FROM dd", "H5"))
def q_fill_date(spark, sf):
    return h5_dense(spark, sf).select("segment", "ts", rnd("value").alias("value"))


FILL_CHUNK_MINUTES = 3 * 1440   # small chunks so the cross-chunk carry is exercised


@register("fill_forward", with_views(H5_GRID_SQL + "SELECT segment, ts, round(last_value(value IGNORE NULLS) OVER ("
                                     "PARTITION BY segment ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) "
                                     "AS value FROM dd", "H5"))
def q_fill_forward(spark, sf):
    out = fill_gaps(h5_dense(spark, sf), "segment", "ts", ["value"], "forward", chunk_minutes=FILL_CHUNK_MINUTES)
    return out.select("segment", "ts", rnd("value").alias("value"))


@register("fill_backward", with_views(H5_GRID_SQL + "SELECT segment, ts, round(first_value(value IGNORE NULLS) OVER ("
                                      "PARTITION BY segment ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) "
                                      "AS value FROM dd", "H5"))
def q_fill_backward(spark, sf):
    out = fill_gaps(h5_dense(spark, sf), "segment", "ts", ["value"], "backward", chunk_minutes=FILL_CHUNK_MINUTES)
    return out.select("segment", "ts", rnd("value").alias("value"))


@register("fill_stat", with_views(H5_GRID_SQL + "SELECT segment, ts, round(coalesce(value, avg(value) OVER "
                                  "(PARTITION BY segment)), 6) AS value_mean, round(coalesce(value, min(value) OVER "
                                  "(PARTITION BY segment)), 6) AS value_min, round(coalesce(value, max(value) OVER "
                                  "(PARTITION BY segment)), 6) AS value_max FROM dd", "H5"))
def q_fill_stat(spark, sf):
    d = h5_dense(spark, sf).withColumn("value_mean", F.col("value")).withColumn("value_min", F.col("value")) \
        .withColumn("value_max", F.col("value")).drop("value")
    d = fill_gaps(d, "segment", "ts", {"value_mean": "mean", "value_min": "min", "value_max": "max"})
    return d.select("segment", "ts", *[rnd(c).alias(c) for c in ("value_mean", "value_min", "value_max")])


# ---------------------------------------------------------------- sources


@register("csv_scan", with_views("SELECT segment, ts, round(qty, 6) AS qty FROM D6", "D6"))
def q_csv_scan(spark, sf):
    """D6 written by Spark as many CSV files, discovered recursively, inferred and prepared."""
    path = scratch_path(spark, "csv_scan")
    write_series_csv(V.d6(spark, sf).repartition(4, "segment"), path)
    spec = DatasetSpec(path=path, target=("qty",), date="ts", segment="segment", name="d6csv")
    out = prepare(read_series(spark, spec), spec)
    return out.select("segment", "ts", rnd("qty").alias("qty"))


@register("csv_scan_multi", "SELECT CAST(user_id % 4 AS VARCHAR) AS station, CAST(event_id AS BIGINT) AS id, ts, "
          "round(CASE WHEN event_id % 7 = 0 THEN value ELSE floor(value) END, 6) AS v, event_type AS kind, true AS from_part FROM events")
def q_csv_scan_multi(spark, sf):
    """Events as CSV folders by station: every second station has its columns in another order, and whole numbers turn
    to decimals at places. The file stem is a column."""
    ev = V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 7 == 0, F.format_string("%.17g", "value"))
        .otherwise(F.floor("value").cast("string")).alias("v"), F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("station"))
    path = scratch_path(spark, "csv_multi")
    for s in range(4):
        cols = ["id", "ts", "v", "kind"] if s % 2 else ["kind", "v", "id", "ts"]
        one = ev.where(F.col("station") == s).select(*cols)
        (one.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{path}/{s}"))
    spec = DatasetSpec(path=path, target=("v",), date="ts", segment="station", name="events-csv", file_name_as_feature="part")
    out = read_series(spark, spec)
    folder = F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1)
    return out.withColumn("station", folder).select("station", "id", "ts", rnd("v").alias("v"), "kind", F.col("part").startswith("part-").alias("from_part"))


# ---------------------------------------------------------------- scaling


def wide_train_raw(spark, sf):
    """Training rows of the 3-channel view: windows over all its channels (features price, disc and
    target qty), then rows up to each series' last training date. Both branches read the same view
    columns, so the view is aggregated once (shared shuffle)."""
    w = make_windows(V.wide(spark, sf), "segment", "ts", ["price", "disc"], ["qty"], D6_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    acc, _ = chrono_split(w, "segment", (0.7, 0.1, 0.2))
    b = split_bounds(acc, "segment", "ts")
    return raw_split(V.wide(spark, sf), b, "segment", "ts").where(F.col("split") == "train").drop("split")


def d6_train_rows(spark, sf):
    """Training rows of D6 (windows and raw rows read the same 3-column view: one aggregation)."""
    b = split_bounds(d6_split_windows(spark, sf), "segment", "ts")
    return raw_split(V.d6(spark, sf), b, "segment", "ts").where(F.col("split") == "train").drop("split")


def d6_train_stats(spark, sf, method):
    return fit_scaler(d6_train_rows(spark, sf), ["qty"], method)


def _train_sql(view):
    chans = ["price", "disc", "qty"] if view == "WIDE" else ["qty"]
    return (f", s AS ({O.split_cte(O.windows_cte(view, ['segment'], 'ts', chans, ['qty'], 8, 2, 3, 1440), ['segment'], 'ts')}), "
            "b AS (SELECT segment, max(ts) FILTER (WHERE split = 'train') AS train_max FROM s GROUP BY 1), "
            f"tr AS (SELECT {view}.* FROM {view} JOIN b USING (segment) WHERE {view}.ts <= train_max) ")


def _stats_sql(channels, method):
    return (f", lg AS (UNPIVOT (SELECT {', '.join(channels)} FROM tr) ON {', '.join(channels)} INTO NAME channel VALUE value), "
            "st AS (SELECT channel, min(value) AS min, max(value) AS max, avg(value) AS mean, median(value) AS median, "
            "stddev_samp(value) AS std, var_samp(value) AS variance, list_sort(list(value)) AS srt, count(*) AS n FROM lg GROUP BY 1), "
            "sq AS (SELECT *, srt[CAST(round((n - 1) * 0.25) AS BIGINT) + 1] AS quantile_25, "
            "srt[CAST(round((n - 1) * 0.5) AS BIGINT) + 1] AS quantile_50, "
            f"srt[CAST(round((n - 1) * 0.75) AS BIGINT) + 1] AS quantile_75, '{method}' AS method FROM st) ")


@register("scaler_stats", with_views(
    _train_sql("WIDE") + _stats_sql(["qty", "price", "disc"], "standard")
    + "SELECT channel, " + ", ".join(f"round({c}, {2 if c == 'variance' else 6}) AS {c}" for c in
                                     ("min", "max", "mean", "median", "std", "variance", "quantile_25", "quantile_50", "quantile_75"))
    + ", round(quantile_75 - quantile_25, 6) AS iqr, method FROM sq", "WIDE"))
def q_scaler_stats(spark, sf):
    st = fit_scaler(wide_train_raw(spark, sf), ["qty", "price", "disc"], "standard")
    # variance ~1e10 for prices: 2 decimals keep 12 significant digits, beyond the summation-order noise
    return st.select("channel", *[rnd(c, 2 if c == "variance" else R).alias(c) for c in st.columns
                                  if c not in ("channel", "method")], "method")


def _norm_sql(expr):
    return with_views(_train_sql("D6") + _stats_sql(["qty"], "x")
                      + f"SELECT D6.segment, D6.ts, round({expr}, 6) AS qty FROM D6, sq", "D6")


for _m, _e in (("minmax", "(D6.qty - sq.min) / nullif(sq.max - sq.min, 0)"),
               ("standard", "(D6.qty - sq.mean) / nullif(sq.std, 0)"),
               ("robust", "(D6.qty - sq.median) / ((sq.quantile_75 - sq.quantile_25) + 1e-12)")):
    def _mk(method):
        def q(spark, sf):
            out = apply_scaler(V.d6(spark, sf), d6_train_stats(spark, sf, method), ["qty"], method)
            return out.select("segment", "ts", rnd("qty").alias("qty"))
        q.__name__ = f"q_normalize_{method}"
        return q
    register(f"normalize_{_m}", _norm_sql(_e))(_mk(_m))


@register("denormalize", _norm_sql("((D6.qty - sq.median) / ((sq.quantile_75 - sq.quantile_25) + 1e-12)) * "
                                   "(sq.quantile_75 - sq.quantile_25) + sq.median"))
def q_denormalize(spark, sf):
    st = d6_train_stats(spark, sf, "robust")
    scaled = apply_scaler(V.d6(spark, sf), st, ["qty"], "robust")
    back = apply_scaler(scaled, st, ["qty"], "robust", inverse=True)
    return back.select("segment", "ts", rnd("qty").alias("qty"))


@register("denormalize_minmax", _norm_sql("((D6.qty - sq.min) / nullif(sq.max - sq.min, 0)) * (sq.max - sq.min) + sq.min"))
def q_denormalize_minmax(spark, sf):
    st = d6_train_stats(spark, sf, "minmax")
    back = apply_scaler(apply_scaler(V.d6(spark, sf), st, ["qty"], "minmax"), st, ["qty"], "minmax", inverse=True)
    return back.select("segment", "ts", rnd("qty").alias("qty"))


@register("quantiles_lineitem", "SELECT c AS channel, count(*) AS n, round(min(v), 6) AS lo, round(median(v), 6) AS median, "
          "round(quantile_disc(v, 0.25), 6) AS q25, round(quantile_disc(v, 0.9), 6) AS q90, round(max(v), 6) AS hi FROM ("
          "SELECT 'l_discount' AS c, l_discount AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) GROUP BY 1")
def q_quantiles_lineitem(spark, sf):
    """Exact quantiles of raw columns with few distinct values: nearly all rows tie."""
    long = univariate_unpivot(V.table(spark, sf, "lineitem"), None, "l_shipdate", ["l_discount", "l_quantity"])
    v = F.col("_v")
    q = exact_quantiles(long, "channel", "value", {"median": "median", "q25": 0.25, "q90": 0.9}, extra_aggs=(F.min(v).alias("lo"), F.max(v).alias("hi")))
    return q.select("channel", "n", *[rnd(c).alias(c) for c in ("lo", "median", "q25", "q90", "hi")])


# ---------------------------------------------------------------- calendar and activations

_CYC = "((hour(ts) * 60 + minute(ts)) / 5.0) / (24 * (60 / 5.0)) * 2 * pi()"


@register("cyclical_pattern", "SELECT event_id, ts, "
          f"round(sin({_CYC}), 6) AS hour_sin, round(cos({_CYC}), 6) AS hour_cos, "
          "round(sin(isodow(ts) / 7.0 * 2 * pi()), 6) AS day_sin, round(cos(isodow(ts) / 7.0 * 2 * pi()), 6) AS day_cos, "
          "round(sin(month(ts) / 12.0 * 2 * pi()), 6) AS month_sin, round(cos(month(ts) / 12.0 * 2 * pi()), 6) AS month_cos "
          "FROM events")
def q_cyclical_pattern(spark, sf):
    out = cyclical_pattern(V.table(spark, sf, "events").select("event_id", "ts"), "ts", resample=5)
    return out.select("event_id", "ts", *[rnd(c).alias(c) for c in
                                          ("hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos")])


@register("time_encode", "SELECT event_id, ts, round(cos(floor(epoch(ts)) * (2 * pi() / 86400)), 6) AS day_cos, "
          "round(sin(floor(epoch(ts)) * (2 * pi() / 86400)), 6) AS day_sin FROM events")
def q_time_encode(spark, sf):
    out = time_encode(V.table(spark, sf, "events").select("event_id", "ts"), "ts")
    return out.select("event_id", "ts", *[rnd(c).alias(c) for c in out.columns if c not in ("event_id", "ts")])


_ACT_ALIAS = {"xsinsquared": "act_xsinsquared", "xsin": "act_xsin", "snake_a.5": "act_snake_a05",
              "snake_a1": "act_snake_a1", "snake_a5": "act_snake_a5"}


@register("activations", "SELECT event_id, round(value + pow(sin(value), 2), 6) AS act_xsinsquared, "
          "round(value + sin(value), 6) AS act_xsin, "
          + ", ".join(f"round(value - cos(value * {2 * a!r}) / {2 * a!r} + {1 / (2 * a)!r}, 6) AS {n}"
                      for a, n in ((0.5, "act_snake_a05"), (1.0, "act_snake_a1"), (5.0, "act_snake_a5")))
          + " FROM events")
def q_activations(spark, sf):
    ev = V.table(spark, sf, "events")
    return ev.select("event_id", *[rnd(fn(F.col("value"))).alias(_ACT_ALIAS[n]) for n, fn in ACTIVATIONS.items()])


# ---------------------------------------------------------------- window transforms (sequence ops)

SEQ_SPEC = WindowSpec(lag=8, ahead=1, offset=1, minutes=1440)
SEQ_K = S.decomposition_kernel(SEQ_SPEC.lag)          # 8 // 3 = 2 -> 3
_SEQ_W = f", w AS ({O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 8, 1, 1, 1440)}) "


def seq_windows(spark, sf):
    return make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], SEQ_SPEC, strategy=VIEW_STRATEGY, on_grid=True)


def _explode_arr(df, col, extra=()):
    return df.select("segment", "ts", *extra, F.posexplode(col).alias("pos", "value")).select(
        "segment", "ts", *extra, F.col("pos").cast("long").alias("pos"), rnd("value").alias("value"))


def _ma_sql(k: int, src: str = "x") -> str:
    p = (k - 1) // 2
    pad = f"list_concat(list_transform(range({p}), lambda i: {src}[1]), {src}, list_transform(range({p}), lambda i: {src}[-1]))"
    return (f"list_transform(range(len({src}) + {2 * p - k + 1}), lambda i: list_sum(({pad})[i + 1:i + {k}]) / {k})")


@register("moving_average", with_views(_SEQ_W + f", t AS (SELECT segment, ts, {_ma_sql(5)} AS a FROM w) "
                                       "SELECT segment, ts, UNNEST(range(len(a))) AS pos, round(UNNEST(a), 6) AS value FROM t", "D6"))
def q_moving_average(spark, sf):
    w = seq_windows(spark, sf).select("segment", "ts", S.moving_average("x", 5).alias("a"))
    return _explode_arr(w, "a")


@register("decompose", with_views(_SEQ_W + f", t AS (SELECT segment, ts, x, {_ma_sql(SEQ_K)} AS tr FROM w) "
                                  "SELECT segment, ts, UNNEST(range(len(tr))) AS pos, round(UNNEST(tr), 6) AS trend, "
                                  "round(UNNEST(list_transform(range(len(x)), lambda i: x[i + 1] - tr[i + 1])), 6) AS seasonal "
                                  "FROM t", "D6"))
def q_decompose(spark, sf):
    w = seq_windows(spark, sf).select("segment", "ts", S.decompose("x", SEQ_K).alias("d"))
    z = w.select("segment", "ts", F.posexplode(F.arrays_zip("d.trend", "d.seasonal")).alias("pos", "z"))
    return z.select("segment", "ts", F.col("pos").cast("long").alias("pos"), rnd("z.trend").alias("trend"),
                    rnd("z.seasonal").alias("seasonal"))


@register("last_value_norm", with_views(_SEQ_W + ", t AS (SELECT segment, ts, list_transform(x, lambda v: v - x[-1]) AS a, "
                                        "list_transform(y, lambda v: v - x[-1]) AS b FROM w) "
                                        "SELECT segment, ts, 'x' AS part, UNNEST(range(len(a))) AS pos, round(UNNEST(a), 6) AS value FROM t "
                                        "UNION ALL SELECT segment, ts, 'y', UNNEST(range(len(b))), round(UNNEST(b), 6) FROM t", "D6"))
def q_last_value_norm(spark, sf):
    w = seq_windows(spark, sf)
    w = w.select("segment", "ts", S.last_value_norm("x").alias("a"),
                 F.transform("y", lambda v: v - F.element_at("x", -1)).alias("b"))
    return (_explode_arr(w.select("segment", "ts", "a"), "a", ()).withColumn("part", F.lit("x"))
            .unionByName(_explode_arr(w.select("segment", "ts", "b"), "b").withColumn("part", F.lit("y"))))


_REVIN_SQL = (", t AS (SELECT segment, ts, x, list_avg(x) AS mean FROM w), "
              "u AS (SELECT segment, ts, x, mean, sqrt(list_sum(list_transform(x, lambda v: (v - mean) * (v - mean))) / len(x) + 1e-5) AS std FROM t) ")


@register("revin_norm", with_views(_SEQ_W + _REVIN_SQL + "SELECT segment, ts, round(mean, 6) AS mean, round(std, 6) AS std, "
                                   "UNNEST(range(len(x))) AS pos, round(UNNEST(list_transform(x, lambda v: (v - mean) / std)), 6) AS value FROM u", "D6"))
def q_revin_norm(spark, sf):
    w = seq_windows(spark, sf).withColumn("st", S.revin_stats("x"))
    w = w.select("segment", "ts", rnd("st.mean").alias("mean"), rnd("st.std").alias("std"),
                 S.revin_norm("x", "st.mean", "st.std").alias("a"))
    return _explode_arr(w, "a", ("mean", "std"))


@register("revin_roundtrip", with_views(_SEQ_W + _REVIN_SQL + "SELECT segment, ts, UNNEST(range(len(x))) AS pos, "
                                        "round(UNNEST(x), 6) AS value FROM u", "D6"))
def q_revin_roundtrip(spark, sf):
    w = seq_windows(spark, sf).withColumn("st", S.revin_stats("x"))
    n = S.revin_norm("x", "st.mean", "st.std", weight=1.5, bias=0.25)
    w = w.select("segment", "ts", S.revin_denorm(n, "st.mean", "st.std", weight=1.5, bias=0.25, eps=0.0).alias("a"))
    return _explode_arr(w, "a")


@register("revin_denorm_default", with_views(
    _SEQ_W + _REVIN_SQL + "SELECT segment, ts, UNNEST(range(len(x))) AS pos, round(UNNEST(list_transform(x, "
    "lambda v: (((v - mean) / std * 1.5 + 0.25) - 0.25) / (1.5 + 1e-5 * 1e-5) * std + mean)), 6) AS value FROM u", "D6"))
def q_revin_denorm_default(spark, sf):
    """The inverse as shipped, whose epsilon makes it slightly smaller than the input."""
    w = seq_windows(spark, sf).withColumn("st", S.revin_stats("x"))
    n = S.revin_norm("x", "st.mean", "st.std", weight=1.5, bias=0.25)
    return _explode_arr(w.select("segment", "ts", S.revin_denorm(n, "st.mean", "st.std", weight=1.5, bias=0.25).alias("a")), "a")


@register("revin_channels", with_views(
    f", w AS ({O.windows_cte('WIDE', ['segment'], 'ts', ['price', 'disc', 'qty'], ['qty'], 8, 1, 1, 1440)}), "
    "e AS (SELECT segment, ts, UNNEST(range(len(x))) AS pos, UNNEST(x) AS step FROM w), "
    "f AS (SELECT segment, ts, pos, c AS ch, step[c + 1] AS v FROM e, range(3) r(c)) "
    "SELECT segment, ts, pos, CAST(ch AS BIGINT) AS ch, round((v - avg(v) OVER k) / sqrt(var_pop(v) OVER k + 1e-5), 5) AS value FROM f "
    "WINDOW k AS (PARTITION BY segment, ts, ch)", "WIDE"))
def q_revin_channels(spark, sf):
    """Instance normalisation of 3-channel windows, each channel by its own statistics."""
    w = make_windows(V.wide(spark, sf), "segment", "ts", ["price", "disc"], ["qty"], WindowSpec(lag=8), strategy=VIEW_STRATEGY, on_grid=True)
    w = w.withColumn("st", S.revin_stats("x", channels=3))
    z = w.select("segment", "ts", F.posexplode(S.revin_norm_channels("x", "st")).alias("pos", "s"))
    return z.select("segment", "ts", F.col("pos").cast("long").alias("pos"), F.posexplode("s").alias("ch", "value")).select(
        "segment", "ts", "pos", F.col("ch").cast("long").alias("ch"), rnd("value", 5).alias("value"))


# Fixed Time2Vec weights for the oracle check (k = 2 periodic features, L = 8 steps).
T2V_WA = [0.01, -0.02]
T2V_BA = [[0.1 * t, -0.05 * t] for t in range(8)]
T2V_WB = [0.5 + 0.1 * t for t in range(8)]
T2V_BB = [0.2 * t - 0.3 for t in range(8)]


def _t2v_sql():
    per = []
    for t in range(8):
        for j in range(2):
            per.append(f"SELECT segment, ts, CAST({t} AS BIGINT) AS step, CAST({j} AS BIGINT) AS feat, "
                       f"round(sin(x[{t + 1}] * {T2V_WA[j]!r} + {T2V_BA[t][j]!r}), 6) AS value FROM w")
        per.append(f"SELECT segment, ts, CAST({t} AS BIGINT), CAST(2 AS BIGINT), "
                   f"round({T2V_WB[t]!r} * x[{t + 1}] + {T2V_BB[t]!r}, 6) FROM w")
    return " UNION ALL ".join(per)


@register("time2vec", with_views(_SEQ_W + _t2v_sql(), "D6"))
def q_time2vec(spark, sf):
    w = seq_windows(spark, sf).select("segment", "ts", S.time2vec("x", T2V_WA, T2V_BA, T2V_WB, T2V_BB).alias("f"))
    st = w.select("segment", "ts", F.posexplode("f").alias("step", "row"))
    return st.select("segment", "ts", F.col("step").cast("long").alias("step"), F.posexplode("row").alias("feat", "value")) \
        .select("segment", "ts", "step", F.col("feat").cast("long").alias("feat"), rnd("value").alias("value"))


# ---------------------------------------------------------------- metrics and ensemble


def naive_predictions(spark, sf):
    """D6 test windows scored by two naive models: persistence (x[-1]) and window mean."""
    t = d6_split_windows(spark, sf).where(F.col("split") == "test")
    last = t.select("segment", "ts", "y", F.lit("last").alias("model"),
                    F.transform("y", lambda v: F.element_at("x", -1)).alias("yhat"))
    mean = t.select("segment", "ts", "y", F.lit("mean").alias("model"),
                    F.transform("y", lambda v: S.array_mean("x")).alias("yhat"))
    return MET.long_predictions(last.unionByName(mean), ["model", "segment", "ts"])


_PRED_SQL = (f", s AS ({O.d6_split()}), t AS (SELECT segment, ts, x, y AS yy FROM s WHERE split = 'test'), "
             "p AS (SELECT 'last' AS model, segment, ts, UNNEST(range(len(yy))) AS h, UNNEST(yy) AS y, x[-1] AS yhat FROM t "
             "UNION ALL SELECT 'mean', segment, ts, UNNEST(range(len(yy))), UNNEST(yy), list_avg(x) FROM t) ")


def _metric_sql(src="p"):
    return (f", pooled AS (SELECT model, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse, "
            "sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape, "
            "avg(CASE WHEN (abs(yhat) + abs(y)) / 2 = 0 THEN CAST('nan' AS DOUBLE) ELSE abs(yhat - y) / ((abs(yhat) + abs(y)) / 2) END) * 100 AS smape, "
            "2 * avg(0.5 * greatest(y - yhat, 0) + 0.5 * greatest(yhat - y, 0)) / avg(abs(y)) AS nql_5, "
            "2 * avg(0.9 * greatest(y - yhat, 0) + 0.09999999999999998 * greatest(yhat - y, 0)) / avg(abs(y)) AS nql_9 "
            f"FROM {src} GROUP BY 1), "
            f"r2h AS (SELECT model, h, sum((y - yhat) * (y - yhat)) AS ssr, count(y) * var_pop(y) AS sst FROM {src} GROUP BY 1, 2), "
            "r2 AS (SELECT model, avg(CASE WHEN sst > 0 THEN 1 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END) AS r2 FROM r2h GROUP BY 1) ")


_METRIC_COLS = ", ".join(f"round({m}, 6) AS {m}" for m in MET.ALL_METRICS)


@register("metrics_all", with_views(_PRED_SQL + _metric_sql() + f"SELECT model, {_METRIC_COLS} FROM pooled JOIN r2 USING (model)", "D6"))
def q_metrics_all(spark, sf):
    sc = MET.score(naive_predictions(spark, sf), ["model"])
    return sc.select("model", *[rnd(m).alias(m) for m in MET.ALL_METRICS])


@register("metric_r2", with_views(_PRED_SQL + _metric_sql() + "SELECT model, h, round(CASE WHEN sst > 0 THEN 1 - ssr / sst "
                                  "WHEN ssr = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2 FROM r2h", "D6"))
def q_metric_r2(spark, sf):
    p = naive_predictions(spark, sf)
    per = MET.r2_per_horizon(p, ["model", "h"], "y", "yhat", "h")  # h in group -> one horizon per row
    return per.select("model", "h", rnd("r2").alias("r2"))


@register("metric_msle", with_views(_PRED_SQL + "SELECT model, round(avg(pow(ln(1 + y) - ln(1 + yhat), 2)), 6) AS msle "
                                    "FROM p GROUP BY 1", "D6"))
def q_metric_msle(spark, sf):
    sc = MET.score(naive_predictions(spark, sf), ["model"], metrics=("msle",), extra={"msle": MET.msle})
    return sc.select("model", rnd("msle").alias("msle"))


@register("ensemble", with_views(
    _PRED_SQL + _metric_sql() + ", wt AS (SELECT model, r2 / sum(r2) OVER () AS weight FROM r2), "
    "e AS (SELECT 'Ensemble' AS model, segment, ts, h, first(y) AS y, sum(weight * yhat) AS yhat FROM p JOIN wt USING (model) "
    "GROUP BY segment, ts, h)" + _metric_sql("e").replace("pooled AS", "epooled AS").replace("r2h AS", "er2h AS")
    .replace("FROM r2h", "FROM er2h").replace("r2 AS (", "er2 AS (")
    + f"SELECT model, round(weight, 6) AS weight, {_METRIC_COLS} FROM pooled JOIN r2 USING (model) JOIN wt USING (model) "
    f"UNION ALL SELECT model, CAST(1.0 AS DOUBLE) AS weight, {_METRIC_COLS} FROM epooled JOIN er2 USING (model)", "D6"))
def q_ensemble(spark, sf):
    p = naive_predictions(spark, sf)
    sc = MET.score(p, ["model"])
    w = sc.select("model", (F.col("r2") / F.sum("r2").over(Window.partitionBy())).alias("weight"))
    e = MET.ensemble(p, sc, ["segment", "ts"])
    esc = MET.score(e, ["model"]).withColumn("weight", F.lit(1.0))
    base = sc.join(w, "model")
    return base.unionByName(esc).select("model", rnd("weight").alias("weight"), *[rnd(m).alias(m) for m in MET.ALL_METRICS])


# ---------------------------------------------------------------- forecasting


AR1_SPEC = WindowSpec(lag=1, ahead=1, offset=1, minutes=1440)


def d1_ar1_split(spark, sf):
    w = make_windows(V.d1(spark, sf), None, "ts", ["qty"], ["qty"], AR1_SPEC, strategy="halo", on_grid=True)
    acc, _ = chrono_split(w, None, (0.7, 0.1, 0.2))
    return acc


_AR1_SQL = (f", s AS ({O.split_cte(O.windows_cte('D1', [], 'ts', ['qty'], ['qty'], 1, 1, 1, 1440), [], 'ts')}), "
            "tr AS (SELECT x[1] AS xv, y[1] AS yv FROM s WHERE split = 'train') ")


@register("fit_linear_ar1", with_views(_AR1_SQL + "SELECT 'linear' AS model, CAST(0 AS BIGINT) AS h, "
                                       "round(regr_slope(yv, xv), 6) AS slope, round(regr_intercept(yv, xv), 4) AS intercept, "
                                       "count(*) AS n_train FROM tr", "D1"))
def q_fit_linear_ar1(spark, sf):
    m = FC.fit(d1_ar1_split(spark, sf), "linear", lambdas=(0.0,), L=1, A=1)
    W = m["weights"]
    sc = spark.createDataFrame([("linear", 0, float(W[0, 0]), float(W[1, 0]), int(round(m["n_train"])))],
                               "model string, h long, slope double, intercept double, n_train long")
    return sc.select("model", "h", rnd("slope").alias("slope"), rnd("intercept", 4).alias("intercept"), "n_train")


# Literal model weights (fixed parameters of the prediction checks): L = 8 steps, A = 2 horizons.
LIN_W = [[(t + 1) / 36.0 for t in range(8)], [(8 - t) / 36.0 for t in range(8)]]
LIN_B = [1.5, -2.0]
DL_WS = [[0.125] * 8, [0.1 * ((t % 3) - 1) for t in range(8)]]
DL_WT = [[(t + 1) / 36.0 for t in range(8)], [0.125] * 8]


def _coef(spark, model, Weff):
    return FC.coefficient_table(spark, model, Weff)


def _lin_matrix(ws, bs):
    W = np.zeros((len(ws[0]) + 1, len(ws)))
    for h, (w, b) in enumerate(zip(ws, bs)):
        W[:-1, h] = w
        W[-1, h] = b
    return W


def _pred_out(pred):
    z = pred.select("segment", "ts", F.posexplode("yhat").alias("h", "yhat"))
    return z.select("segment", "ts", F.col("h").cast("long").alias("h"), rnd("yhat").alias("yhat"))


def _pred_sql(exprs):
    parts = [f"SELECT segment, ts, CAST({h} AS BIGINT) AS h, round({e}, 6) AS yhat FROM w" for h, e in enumerate(exprs)]
    return with_views(f", w AS ({O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 8, 2, 3, 1440)}) " + " UNION ALL ".join(parts), "D6")


def _lit_list(v):
    return "[" + ", ".join(repr(float(a)) for a in v) + "]"


@register("predict_linear", _pred_sql([f"list_dot_product(x, {_lit_list(LIN_W[h])}) + {LIN_B[h]!r}" for h in range(2)]))
def q_predict_linear(spark, sf):
    coef = _coef(spark, "linear", FC.effective("linear", _lin_matrix(LIN_W, LIN_B), 8, 1, 2))
    return _pred_out(FC.predict(d6_windows(spark, sf), coef))


@register("predict_nlinear", _pred_sql([f"list_dot_product(list_transform(x, lambda v: v - x[-1]), {_lit_list(LIN_W[h])}) "
                                        f"+ {LIN_B[h]!r} + x[-1]" for h in range(2)]))
def q_predict_nlinear(spark, sf):
    coef = _coef(spark, "nlinear", FC.effective("nlinear", _lin_matrix(LIN_W, LIN_B), 8, 1, 2))
    return _pred_out(FC.predict(d6_windows(spark, sf), coef))


def _dl_sql(h):
    tr = _ma_sql(S.decomposition_kernel(8))
    return (f"list_dot_product(list_transform(range(8), lambda i: x[i + 1] - ({tr})[i + 1]), {_lit_list(DL_WS[h])}) "
            f"+ list_dot_product({tr}, {_lit_list(DL_WT[h])}) + {LIN_B[h]!r}")


@register("predict_dlinear", _pred_sql([_dl_sql(h) for h in range(2)]))
def q_predict_dlinear(spark, sf):
    W = np.zeros((17, 2))
    for h in range(2):
        W[:8, h], W[8:16, h], W[16, h] = DL_WS[h], DL_WT[h], LIN_B[h]
    coef = _coef(spark, "dlinear", FC.effective("dlinear", W, 8, 1, 2))
    return _pred_out(FC.predict(d6_windows(spark, sf), coef))


def _head_sql():
    body = " UNION ALL ".join(
        f"SELECT split, segment, ts, CAST({h} AS BIGINT) AS h, round(list_dot_product(x, {_lit_list(LIN_W[h])}) "
        f"+ {LIN_B[h]!r}, 6) AS yhat FROM w" for h in range(2))
    return with_views(f", s AS ({O.d6_split()}), w AS (SELECT * FROM s WHERE split IN ('train', 'val')) " + body, "D6")


@register("predict_head", _head_sql())
def q_predict_head(spark, sf):
    """Fit diagnostics: predictions on all train and val windows."""
    sw = d6_split_windows(spark, sf).where(F.col("split").isin("train", "val"))
    coef = _coef(spark, "linear", FC.effective("linear", _lin_matrix(LIN_W, LIN_B), 8, 1, 2))
    z = FC.predict(sw, coef).select("split", "segment", "ts", F.posexplode("yhat").alias("h", "yhat"))
    return z.select("split", "segment", "ts", F.col("h").cast("long").alias("h"), rnd("yhat").alias("yhat"))


LAMBDAS = (0.0, 1.0, 10.0, 100.0, 1000.0, 10000.0)


@register("select_lambda", None)
def q_select_lambda(spark, sf):
    """Ridge strength per model kind chosen on validation MSE computed from the val Gram."""
    mats = FC.split_grams(d6_split_windows(spark, sf), n_terms=8 + 1 + 2)
    rows = []
    for kind in FC.KINDS:
        m = FC.fit(kind=kind, lambdas=LAMBDAS, L=8, A=2, mats=mats)
        if m is None:
            continue
        rows.append((kind, float(m["lambda"]), float(m["val_mse"]), int(round(m["n_train"]))))
    return spark.createDataFrame(rows, "model string, lambda double, val_mse double, n_train long")


@register("model_roundtrip", with_views(_AR1_SQL + "SELECT 'linear' AS model, CAST(0 AS BIGINT) AS h, "
                                        "round(regr_slope(yv, xv), 6) AS slope, round(regr_intercept(yv, xv), 4) AS intercept "
                                        "FROM tr", "D1"))
def q_model_roundtrip(spark, sf):
    """Fit, store the coefficient table under the shared scratch folder, load it back."""
    m = FC.fit(d1_ar1_split(spark, sf), "linear", lambdas=(0.0,), L=1, A=1)
    path = scratch_path(spark, "models")
    FC.save_model(FC.coefficient_table(spark, "linear", m["weights"]), path)
    c = FC.load_model(spark, path, "linear")
    piv = c.groupBy("model", F.col("h").cast("long").alias("h")).agg(
        F.max(F.when(F.col("term") == 0, F.col("coef"))).alias("slope"),
        F.max(F.when(F.col("term") == 1, F.col("coef"))).alias("intercept"))
    return piv.select("model", "h", rnd("slope").alias("slope"), rnd("intercept", 4).alias("intercept"))


# ---------------------------------------------------------------- expansion, assembly, stores

WIDE_CH = ["qty", "price", "disc"]


@register("univariate_unpivot", with_views("SELECT segment, channel, ts, round(value, 6) AS value FROM "
                                           "(UNPIVOT WIDE ON qty, price, disc INTO NAME channel VALUE value)", "WIDE"))
def q_univariate_unpivot(spark, sf):
    u = univariate_unpivot(V.wide(spark, sf), "segment", "ts", WIDE_CH)
    return u.select("segment", "channel", "ts", rnd("value").alias("value"))


@register("feature_combinations", with_views(
    ", ch AS (SELECT DISTINCT channel, CASE channel WHEN 'qty' THEN 0 WHEN 'price' THEN 1 ELSE 2 END AS pos "
    "FROM (UNPIVOT WIDE ON qty, price, disc INTO NAME channel VALUE value)) "
    "SELECT a.channel AS c0, b.channel AS c1 FROM ch a JOIN ch b ON b.pos > a.pos", "WIDE"))
def q_feature_combinations(spark, sf):
    """Pairs of the channels that have a value in any row; ``combination_series`` builds their series."""
    long = univariate_unpivot(V.wide(spark, sf), "segment", "ts", WIDE_CH).where("value IS NOT NULL")
    return feature_combinations(channel_catalogue(long, WIDE_CH), 2)


ZS_SPEC = WindowSpec(lag=8, ahead=1, offset=1, minutes=1440)
ZS_SPEC_H = WindowSpec(lag=8, ahead=1, offset=1, minutes=60)


def zero_shot_windows(spark, sf):
    h = make_windows(V.h5(spark, sf), "segment", "ts", ["value"], ["value"], ZS_SPEC_H, strategy=VIEW_STRATEGY, on_grid=True)
    h, _ = chrono_split(h, "segment", (0.7, 0.1, 0.2))
    d6 = make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], ZS_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    d6, _ = chrono_split(d6, "segment", (0.7, 0.1, 0.2))
    d1 = make_windows(V.d1(spark, sf), None, "ts", ["qty"], ["qty"], ZS_SPEC, strategy="halo", on_grid=True)
    d1, _ = chrono_split(d1, None, (0.7, 0.1, 0.2))
    d1 = d1.withColumn("segment", F.lit("all"))
    return assemble_zero_shot(h, {"D6": d6, "D1": d1}, target_name="H5",
                              shapes={"H5": (8, 1, 1), "D6": (8, 1, 1), "D1": (8, 1, 1)})


def _zs_sql():
    h = O.split_cte(O.windows_cte("H5", ["segment"], "ts", ["value"], ["value"], 8, 1, 1, 60), ["segment"], "ts")
    d6 = O.split_cte(O.windows_cte("D6", ["segment"], "ts", ["qty"], ["qty"], 8, 1, 1, 1440), ["segment"], "ts")
    d1 = O.split_cte(O.windows_cte("D1", [], "ts", ["qty"], ["qty"], 8, 1, 1, 1440), [], "ts")
    return (f", a AS (SELECT 'H5' AS dataset, segment, ts, split, x, y FROM ({h}) WHERE split = 'test' "
            f"UNION ALL SELECT 'D6', segment, ts, split, x, y FROM ({d6}) WHERE split IN ('train', 'val') "
            f"UNION ALL SELECT 'D1', 'all', ts, split, x, y FROM ({d1}) WHERE split IN ('train', 'val')) ")


@register("zero_shot_assemble", with_views(
    _zs_sql() + "SELECT dataset, segment, ts, split, UNNEST(range(len(x))) AS pos, round(UNNEST(x), 6) AS x_value, "
    "round(y[1], 6) AS y_value FROM a", "H5", "D6", "D1"))
def q_zero_shot_assemble(spark, sf):
    a = zero_shot_windows(spark, sf)
    return a.select("dataset", "segment", "ts", "split", F.posexplode("x").alias("pos", "x_value"),
                    F.element_at("y", 1).alias("y_value")).select(
        "dataset", "segment", "ts", "split", F.col("pos").cast("long").alias("pos"), rnd("x_value").alias("x_value"),
        rnd("y_value").alias("y_value"))


@register("shuffle_windows", with_views(f"SELECT segment, ts, split, round(y[1], 6) AS y0, round(x[-1], 6) AS x_last "
                                        f"FROM ({O.d6_split()})", "D6"))
def q_shuffle_windows(spark, sf):
    s = shuffle_windows(d6_split_windows(spark, sf), ["segment", "ts"], seed=941)
    return s.select("segment", "ts", "split", rnd(F.element_at("y", 1)).alias("y0"), rnd(F.element_at("x", -1)).alias("x_last"))


@register("windows_roundtrip", with_views(f", w AS (SELECT * FROM ({O.d6_split()}) WHERE split = 'test') "
                                          + SQL_EXPLODE_XY.format(k="segment, "), "D6"))
def q_windows_roundtrip(spark, sf):
    """Split windows appended to a (dataset, split)-partitioned Parquet store and read back pruned."""
    path = scratch_path(spark, "windows")
    w = d6_split_windows(spark, sf).select("segment", "ts", "split", "x", "y")
    write_windows(w, path, dataset="D6")
    schema = w.withColumn("dataset", F.lit("D6")).schema
    back = read_windows(spark, path, dataset="D6", split="test", schema=schema)
    return explode_xy(back, ["segment"])


# ---------------------------------------------------------------- rows-only fits (no SQL twin)


def _own_stats(series, key, ts, ch, split_w):
    b = split_bounds(split_w, key, ts)
    return fit_scaler(raw_split(series, b, key, ts).where(F.col("split") == "train"), [ch], "standard")


@register("zero_shot_eval", None)
def q_zero_shot_eval(spark, sf):
    """Fit on the source datasets (each scaled by its own training stats), score on the unseen
    target's test windows with the target's scaler."""
    h5s, d6s = V.h5(spark, sf), V.d6(spark, sf)
    h = make_windows(h5s, "segment", "ts", ["value"], ["value"], ZS_SPEC_H, strategy=VIEW_STRATEGY, on_grid=True)
    h, _ = chrono_split(h, "segment", (0.7, 0.1, 0.2))
    d6 = make_windows(d6s, "segment", "ts", ["qty"], ["qty"], ZS_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    d6, _ = chrono_split(d6, "segment", (0.7, 0.1, 0.2))
    hs, ds = _own_stats(h5s, "segment", "ts", "value", h), _own_stats(d6s, "segment", "ts", "qty", d6)
    a = assemble_zero_shot(scale_windows(h, hs, ["value"], ["value"], "standard"),
                           {"D6": scale_windows(d6, ds, ["qty"], ["qty"], "standard")}, target_name="H5")
    mats = FC.split_grams(a.where(F.col("dataset") == "D6"), n_terms=8 + 1 + 1)
    rows = []
    for kind in FC.KINDS:
        m = FC.fit(kind=kind, lambdas=LAMBDAS, L=8, A=1, mats=mats)
        if m is None:
            continue
        pred = FC.predict(a.where(F.col("dataset") == "H5"), FC.coefficient_table(spark, kind, m["weights"]))
        lp = MET.long_predictions(pred.withColumn("model", F.lit(kind)), ["model", "segment", "ts"])
        rows.append(MET.score(lp, ["model"], scaler=hs.first().asDict()))
    if not rows:
        raise ValueError("no training windows in the source dataset")
    return union_all(rows)


def scale_windows_wide(w, spark, sf):
    """Split windows of the 3-channel view, standard-scaled by its training rows."""
    acc, _ = chrono_split(w, "segment", (0.7, 0.1, 0.2))
    stats = fit_scaler(wide_train_raw(spark, sf), ["price", "disc", "qty"], "standard")
    return scale_windows(acc, stats, ["price", "disc", "qty"], ["qty"], "standard")


@register("predict_t2v", None)
def q_predict_t2v(spark, sf):
    """Time2Vec (128 seeded periodic features of all three channels) -> RevIN -> decomposition -> weights shared by the
    features -> denormalisation -> feature mix, fitted from one Gram pass and scored on the test windows."""
    w = make_windows(V.wide(spark, sf), "segment", "ts", ["price", "disc"], ["qty"], WindowSpec(lag=8, ahead=2, offset=3),
                     strategy=VIEW_STRATEGY, on_grid=True)
    sw = scale_windows_wide(w, spark, sf)
    k = 128
    fr = t2v_revin_frame(sw, time2vec_weights(8, k, seed=941, channels=3), normalised=False)
    m = FC.fit(fr, "t2v_shared", (0.1, 10.0), L=8, F_=k + 3, A=2)
    if m is None:
        raise ValueError("no training windows")
    pred = FC.predict(fr.where(F.col("split") == "test"), FC.coefficient_table(spark, "t2v", m["weights"]))
    lp = MET.long_predictions(pred.withColumn("model", F.lit("t2v")), ["model", "segment", "ts"])
    return MET.score(lp, ["model"]).withColumn("lambda", F.lit(float(m["lambda"])))


# ---------------------------------------------------------------- sinks (write, read back, compare)


def _roundtrip(spark, df, name, fmt="parquet", partition_by=None, single_file=False, mode="overwrite", sort_within=None):
    path = scratch_path(spark, name)
    write_table(df, path, fmt=fmt, mode=mode, partition_by=partition_by, single_file=single_file, sort_within=sort_within)
    r = spark.read.schema(df.schema) if fmt != "csv" else spark.read.schema(df.schema).option("header", True)
    return getattr(r, fmt)(path)


@register("raw_split_sink", QUERIES["raw_split"][1])
def q_raw_split_sink(spark, sf):
    """Raw split rows stored partitioned by split, read back."""
    return _roundtrip(spark, q_raw_split(spark, sf), "rawsplit", partition_by=["split"],
                      sort_within=["segment", "ts"]).select("segment", "ts", "qty", "split")


@register("scaler_sink", QUERIES["scaler_stats"][1])
def q_scaler_sink(spark, sf):
    """Scaler record (all channels) stored as JSON, read back."""
    return _roundtrip(spark, q_scaler_stats(spark, sf), "scaler", fmt="json", single_file=True)


@register("rejected_sink", QUERIES["rejected_segments"][1])
def q_rejected_sink(spark, sf):
    """Rejected segments appended to a store (each id once), read back."""
    return _roundtrip(spark, q_rejected_segments(spark, sf), "rejects", mode="append")


@register("prediction_sink", QUERIES["predict_linear"][1])
def q_prediction_sink(spark, sf):
    """Predictions (model, segment, ts, h, yhat) stored partitioned by model, read back."""
    p = q_predict_linear(spark, sf).withColumn("model", F.lit("linear"))
    return _roundtrip(spark, p, "predictions", partition_by=["model"]).select("segment", "ts", "h", "yhat")


@register("metrics_sink", QUERIES["metrics_all"][1])
def q_metrics_sink(spark, sf):
    """Result table written as one headed CSV (one row per model, so one file), read back."""
    return _roundtrip(spark, q_metrics_all(spark, sf), "results", fmt="csv", single_file=True)


# ---------------------------------------------------------------- top-level flows

WIDE_DS = DatasetSpec(path="", target=("qty",), date="ts", features=("price", "disc"), segment="segment", name="WIDE")


@register("prepare_dataset", with_views(
    f", s AS ({O.split_cte(O.windows_cte('WIDE', ['segment'], 'ts', ['price', 'disc', 'qty'], ['qty'], 8, 2, 3, 1440), ['segment'], 'ts')}) "
    "SELECT segment, split, count(*) AS n_windows, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2", "WIDE"))
def q_prepare_dataset(spark, sf):
    """Whole dataset flow on the 3-channel daily lineitem series, standard-scaled on train rows."""
    ds = prepare_dataset(spark, WIDE_DS, D6_SPEC, source=V.wide(spark, sf), normalization="standard", strategy=VIEW_STRATEGY, on_grid=True)
    return (ds.windows.groupBy("segment", "split")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@register("zero_shot_experiment", None)
def q_zero_shot_experiment(spark, sf):
    """Target: hourly event means; source: daily lineitem quantities; every kind + ensemble."""
    h = prepare_dataset(spark, DatasetSpec(path="", target=("value",), date="ts", segment="segment", name="H5", granularity=60),
                        ZS_SPEC_H, source=V.h5(spark, sf), normalization="standard", strategy=VIEW_STRATEGY, on_grid=True)
    d = prepare_dataset(spark, DatasetSpec(path="", target=("qty",), date="ts", segment="segment", name="D6"),
                        ZS_SPEC, source=V.d6(spark, sf), normalization="standard", strategy=VIEW_STRATEGY, on_grid=True)
    return run_zero_shot(spark, h, [d])


def _d6_prepared(spark, sf):
    return prepare_dataset(spark, DatasetSpec(path="", target=("qty",), date="ts", segment="segment", name="D6"),
                           ZS_SPEC, source=V.d6(spark, sf), normalization="standard", strategy=VIEW_STRATEGY, on_grid=True)


@register("single_dataset_experiment", None)
def q_single_dataset_experiment(spark, sf):
    """Fit every kind on the daily lineitem series' own train/val windows, score its test windows."""
    return run_single(spark, _d6_prepared(spark, sf))


@register("stored_model_eval", None)
def q_stored_model_eval(spark, sf):
    """Fit on daily lineitem series, store the coefficients, reload them and score the hourly
    event series (an unseen dataset) with its own scaler."""
    path = scratch_path(spark, "zs-models")
    run_single(spark, _d6_prepared(spark, sf), model_path=path)
    h = prepare_dataset(spark, DatasetSpec(path="", target=("value",), date="ts", segment="segment", name="H5", granularity=60),
                        ZS_SPEC_H, source=V.h5(spark, sf), normalization="standard", strategy=VIEW_STRATEGY, on_grid=True)
    return evaluate_stored(spark, h, path)


# ---------------------------------------------------------------- true timestamps
RAW_SPEC = WindowSpec(lag=2, ahead=1, offset=1, minutes=60)

# The reference's rows: the series joined with its grid (from its first timestamp, to the microsecond), in time order.
_RAW_SQL = (
    "WITH b AS (SELECT event_type AS segment, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1), "
    "g AS (SELECT segment, UNNEST(generate_series(lo, hi, INTERVAL 60 MINUTE)) AS ts FROM b), "
    "d AS (SELECT coalesce(e.event_type, g.segment) AS segment, coalesce(e.ts, g.ts) AS ts, e.value FROM events e "
    "FULL OUTER JOIN g ON e.event_type = g.segment AND e.ts = g.ts), "
    "l AS (SELECT segment, ts, value, lag(value, 1) OVER k AS l1, lag(value, 2) OVER k AS l2 FROM d WINDOW k AS (PARTITION BY segment ORDER BY ts)), "
    "w AS (SELECT segment, ts, [l2, l1] AS x, [value] AS y FROM l WHERE value IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL) "
    + SQL_EXPLODE_XY.format(k="segment, "))


def _raw_query(strategy):
    """An event's type and time aren't its key: events of one type in the same microsecond are steps of their own, as in the SQL."""
    def q(spark, sf):
        ev = V.table(spark, sf, "events").select(F.col("event_type").alias("segment"), "ts", "value")
        return explode_xy(make_windows(ev, "segment", "ts", ["value"], ["value"], RAW_SPEC, strategy=strategy, chunk_steps=64, ties="keep"), ["segment"])
    return q


for _s in ("range", "halo", "dense", "dense_halo"):
    register(f"raw_windows_{_s}", _RAW_SQL)(_raw_query(_s))


@register("lag_windows_offset", with_views(
    f", w AS ({O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 4, 3, 3, 1440)})\n" + SQL_EXPLODE_XY.format(k="segment, "), "D6"))
def q_lag_windows_offset(spark, sf):
    """An offset below ahead is raised to it, so inputs and labels never overlap."""
    spec = WindowSpec(lag=4, ahead=3, offset=1, minutes=1440)
    return explode_xy(make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], spec, strategy=VIEW_STRATEGY, on_grid=True), ["segment"])


@register("lag_windows_targets", with_views(
    f", w AS ({O.windows_cte('WIDE', ['segment'], 'ts', ['price', 'qty', 'disc'], ['qty', 'disc'], 3, 2, 2, 1440)}) "
    "SELECT segment, ts, UNNEST(range(len(y))) AS pos, round(UNNEST(y), 6) AS value FROM w", "WIDE"))
def q_lag_windows_targets(spark, sf):
    """Labels of two targets over two steps, step-major."""
    spec = WindowSpec(lag=3, ahead=2, offset=2, minutes=1440)
    w = make_windows(V.wide(spark, sf), "segment", "ts", ["price"], ["qty", "disc"], spec, strategy=VIEW_STRATEGY, on_grid=True)
    z = w.select("segment", "ts", F.posexplode("y").alias("pos", "value"))
    return z.select("segment", "ts", F.col("pos").cast("long").alias("pos"), rnd("value").alias("value"))


@register("metrics_digits", with_views(_PRED_SQL + _metric_sql() + "SELECT model, round_even(mae, 2) AS mae, round_even(rmse, 2) AS rmse, "
                                       "round_even(r2, 2) AS r2 FROM pooled JOIN r2 USING (model)", "D6"))
def q_metrics_digits(spark, sf):
    return MET.score(naive_predictions(spark, sf), ["model"], metrics=("mae", "rmse", "r2"), digits=2)


@register("shrink_applied", "SELECT CAST(l_linenumber AS TINYINT) AS l_linenumber, round(CAST(l_quantity AS FLOAT)::DOUBLE, 4) AS l_quantity, "
          "l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def q_shrink_applied(spark, sf):
    """Columns cast to their narrowest types, then used."""
    d = shrink_types(V.table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag"))
    g = d.groupBy("l_linenumber", "l_quantity", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return g.select("l_linenumber", rnd(F.col("l_quantity").cast("double"), 4).alias("l_quantity"), "l_returnflag", "n")


@register("combination_series", with_views(
    ", c AS (SELECT * FROM (VALUES (0, 'qty', 'price'), (1, 'qty', 'disc'), (2, 'price', 'disc')) v(combination, a, b)) "
    "SELECT CAST(combination AS INTEGER) AS combination, segment, ts, "
    "round(CASE a WHEN 'qty' THEN qty ELSE price END, 6) AS c0, round(CASE b WHEN 'price' THEN price ELSE disc END, 6) AS c1 FROM WIDE, c", "WIDE"))
def q_combination_series(spark, sf):
    """A two-channel series per feature combination."""
    s = combination_series(V.wide(spark, sf), "segment", "ts", WIDE_CH, 2)
    return s.select("combination", "segment", "ts", rnd(F.col("channels")[0]).alias("c0"), rnd(F.col("channels")[1]).alias("c1"))


LAG2_SPEC = WindowSpec(lag=2, ahead=1, offset=1, minutes=1440)
LAG2_LAMBDAS = (0.0, 100.0, 10000.0)


def _lag2_sql():
    lam = ", ".join(f"({v!r})" for v in LAG2_LAMBDAS)
    return with_views(
        f", s AS ({O.split_cte(O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 2, 1, 1, 1440), ['segment'], 'ts')}), "
        "t AS (SELECT split, x[1] AS a, x[2] AS b, y[1] AS y FROM s), "
        "m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, "
        "covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bye, "
        "var_pop(a - b) * count(*) AS dd, covar_pop(a - b, y - b) * count(*) AS dy FROM t WHERE split = 'train'), "
        f"l AS (SELECT CAST(col0 AS DOUBLE) AS strength FROM (VALUES {lam}) v), "
        "f AS (SELECT 'linear' AS model, strength, ((bb + strength) * ay - ab * bye) / ((aa + strength) * (bb + strength) - ab * ab) AS w0, "
        "((aa + strength) * bye - ab * ay) / ((aa + strength) * (bb + strength) - ab * ab) AS w1, ma, mb, my, n FROM m, l UNION ALL "
        "SELECT 'nlinear', strength, dy / (dd + strength), 1 - dy / (dd + strength), ma, mb, my, n FROM m, l), "
        "g AS (SELECT model, strength, w0, w1, my - w0 * ma - w1 * mb AS b0, n FROM f) "
        "SELECT model, strength AS \"lambda\", round(w0, 6) AS w0, round(w1, 6) AS w1, round(b0, 4) AS bias, n AS n_train, "
        "round((SELECT avg(pow(t.y - g.w0 * t.a - g.w1 * t.b - g.b0, 2)) FROM t WHERE split = 'val'), 2) AS val_mse FROM g", "D6")


@register("fit_lag2", _lag2_sql())
def q_fit_lag2(spark, sf):
    """Ridge fits of two input steps for every strength, against their closed forms."""
    w = make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], LAG2_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    mats = FC.split_grams(chrono_split(w, "segment", (0.7, 0.1, 0.2))[0], n_terms=4)
    rows = [(kind, c["lambda"], *map(float, c["weights"][:, 0]), int(round(c["n_train"])), c["val_mse"])
            for kind in ("linear", "nlinear") for c in FC.ridge_path(mats, kind, LAG2_LAMBDAS, 2, 1, 1)]
    df = spark.createDataFrame(rows, "model string, lambda double, w0 double, w1 double, bias double, n_train long, val_mse double")
    return df.select("model", "lambda", rnd("w0").alias("w0"), rnd("w1").alias("w1"), rnd("bias", 4).alias("bias"), "n_train", rnd("val_mse", 2).alias("val_mse"))


# ---------------------------------------------------------------- off-grid alignment
ALIGN_SPEC = WindowSpec(lag=4, ahead=1, offset=1, minutes=60)


@register("lag_windows_aligned", with_views(
    ", ev AS (SELECT event_type AS segment, ts, value, epoch_us(ts) AS m FROM events), "
    "lo AS (SELECT segment, min(m) AS m_lo FROM ev GROUP BY 1), "
    "al AS (SELECT ev.segment, make_timestamp(ev.m - ((ev.m - lo.m_lo) % 3600000000)) AS ts, "
    "arg_max(ev.value, ev.ts) AS value FROM ev JOIN lo USING (segment) GROUP BY 1, 2), "
    f"w AS ({O.windows_cte('al', ['segment'], 'ts', ['value'], ['value'], 4, 1, 1, 60)}) "
    + SQL_EXPLODE_XY.format(k="segment, ")))
def q_lag_windows_aligned(spark, sf):
    """Raw events (sub-minute, off-grid timestamps) floored onto each type's hourly grid, latest
    observation per step, then hourly lag-4 windows."""
    ev = V.table(spark, sf, "events").select(F.col("event_type").alias("segment"), "ts", "value")
    w = make_windows(ev, "segment", "ts", ["value"], ["value"], ALIGN_SPEC, strategy="range", align="floor")
    return explode_xy(w, ["segment"])


@register("metrics_scaled", QUERIES["metrics_all"][1])
def q_metrics_scaled(spark, sf):
    """Naive models run on standard-scaled windows and are scored after inverse scaling with the
    training scaler (both models commute with affine maps, so the metrics equal the raw ones)."""
    st = d6_train_stats(spark, sf, "standard")
    t = scale_windows(d6_split_windows(spark, sf).where(F.col("split") == "test"), st, ["qty"], ["qty"], "standard")
    last = t.select("segment", "ts", "y", F.lit("last").alias("model"),
                    F.transform("y", lambda v: F.element_at("x", -1)).alias("yhat"))
    mean = t.select("segment", "ts", "y", F.lit("mean").alias("model"),
                    F.transform("y", lambda v: S.array_mean("x")).alias("yhat"))
    p = MET.long_predictions(last.unionByName(mean), ["model", "segment", "ts"])
    row = st.first()
    sc = MET.score(p, ["model"], scaler=row.asDict() if row else None)
    return sc.select("model", *[rnd(m).alias(m) for m in MET.ALL_METRICS])


# ---------------------------------------------------------------- zero-shot AR(1): fit on D1, score on D6
def _zs_ar1_sql():
    d6s = O.split_cte(O.windows_cte("D6", ["segment"], "ts", ["qty"], ["qty"], 1, 1, 1, 1440), ["segment"], "ts")
    p = (f", c AS (SELECT regr_slope(yv, xv) AS a, regr_intercept(yv, xv) AS b FROM tr), "
         f"t AS (SELECT segment, ts, x[1] AS xv, y[1] AS y FROM ({d6s}) WHERE split = 'test'), "
         "p AS (SELECT 'linear' AS model, segment, ts, CAST(0 AS BIGINT) AS h, y, a * xv + b AS yhat FROM t, c) ")
    return _AR1_SQL + p + _metric_sql() + f"SELECT model, {_METRIC_COLS} FROM pooled JOIN r2 USING (model)"


@register("zero_shot_ar1", with_views(_zs_ar1_sql(), "D1", "D6"))
def q_zero_shot_ar1(spark, sf):
    """AR(1) fitted by the Gram pass on the daily total's training windows, applied unchanged to
    the six flag/status series' test windows and scored there (zero-shot transfer)."""
    m = FC.fit(d1_ar1_split(spark, sf), "linear", lambdas=(0.0,), L=1, A=1)
    if m is None:
        return spark.createDataFrame([], METRICS_SCHEMA)
    coef = FC.coefficient_table(spark, "linear", m["weights"])
    w = make_windows(V.d6(spark, sf), "segment", "ts", ["qty"], ["qty"], AR1_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    acc, _ = chrono_split(w, "segment", (0.7, 0.1, 0.2))
    pred = FC.predict(acc.where(F.col("split") == "test"), coef).withColumn("model", F.lit("linear"))
    sc = MET.score(MET.long_predictions(pred, ["model", "segment", "ts"]), ["model"])
    return sc.select("model", *[rnd(m_).alias(m_) for m_ in MET.ALL_METRICS])


# ---------------------------------------------------------------- ridge path (M5) with an SQL twin at lag 1
RIDGE_LAMBDAS = (0.0, 1e6, 1e8, 1e10)


def _ridge_sql():
    va = (f", va AS (SELECT x[1] AS xv, y[1] AS yv FROM ({O.split_cte(O.windows_cte('D1', [], 'ts', ['qty'], ['qty'], 1, 1, 1, 1440), [], 'ts')}) "
          "WHERE split = 'val'), ")
    lam = ", ".join(f"({v!r})" for v in RIDGE_LAMBDAS)
    return (_AR1_SQL + va +
            "st AS (SELECT regr_sxy(yv, xv) AS sxy, regr_sxx(yv, xv) AS sxx, regr_avgx(yv, xv) AS ax, regr_avgy(yv, xv) AS ay FROM tr), "
            f"lam AS (SELECT CAST(l AS DOUBLE) AS lam FROM (VALUES {lam}) t(l)), "
            "w AS (SELECT lam, sxy / (sxx + lam) AS slope, ay - sxy / (sxx + lam) * ax AS intercept FROM st, lam) "
            "SELECT lam AS lambda, round(slope, 8) AS slope, round(intercept, 4) AS intercept, "
            "round(avg((slope * xv + intercept - yv) * (slope * xv + intercept - yv)), 3) AS val_mse FROM w, va GROUP BY lam, slope, intercept")


@register("ridge_path_ar1", with_views(_ridge_sql(), "D1"))
def q_ridge_path_ar1(spark, sf):
    """Ridge path of the lag-1 linear model: weights and validation MSE for each lambda, all from
    one Gram pass over the train / val windows (no further data pass per lambda)."""
    mats = FC.split_grams(d1_ar1_split(spark, sf), n_terms=3)
    if "train" not in mats:
        return spark.createDataFrame([], "lambda double, slope double, intercept double, val_mse double")
    rows = [(float(c["lambda"]), float(c["weights"][0, 0]), float(c["weights"][1, 0]), float(c["val_mse"]))
            for c in FC.ridge_path(mats, "linear", RIDGE_LAMBDAS, 1, 1, 1)]
    df = spark.createDataFrame(rows, "lambda double, slope double, intercept double, val_mse double")
    return df.select("lambda", rnd("slope", 8).alias("slope"), rnd("intercept", 4).alias("intercept"), rnd("val_mse", 3).alias("val_mse"))


@register("fit_shared_multi", None)
def q_fit_shared_multi(spark, sf):
    """3-channel daily windows (price, discount, quantity -> quantity): per-channel ("individual")
    and shared-weight linear models fitted from one Gram pass, compared on validation MSE."""
    w = make_windows(V.wide(spark, sf), "segment", "ts", ["price", "disc"], ["qty"], WIDE_SPEC, strategy=VIEW_STRATEGY, on_grid=True)
    acc, _ = chrono_split(w, "segment", (0.7, 0.1, 0.2))
    mats = FC.split_grams(acc, n_terms=4 * 3 + 1 + 1)
    rows = []
    for kind in ("linear", *FC.SHARED_KINDS[:3]):
        m = FC.fit(kind=kind, lambdas=(0.0, 1.0, 100.0), L=4, F_=3, A=1, mats=mats)
        if m is not None:
            rows.append((kind, float(m["lambda"]), float(m["val_mse"]), int(round(m["n_train"]))))
    return spark.createDataFrame(rows, "model string, lambda double, val_mse double, n_train long")


# ---------------------------------------------------------------- the Gram pass itself


_GRAM_SQL = with_views(
    f", s AS ({O.d6_split()}), zz AS (SELECT split, list_concat(x, [1.0], y) AS z FROM s) "
    "SELECT split, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(z[i + 1] * z[j + 1]), 6) AS v "
    "FROM zz, range(11) a(i), range(11) b(j) WHERE j >= i GROUP BY 1, 2, 3", "D6")


@register("gram_moments", _GRAM_SQL)
def q_gram_moments(spark, sf):
    g = gram(d6_split_windows(spark, sf), "split")
    return g.select(F.col("grp").alias("split"), "i", "j", rnd("v").alias("v"))


@register("gram_moments_arrow", _GRAM_SQL)
def q_gram_moments_arrow(spark, sf):
    """The same from halo windows, which arrive in chunks."""
    g = gram(d6_split_windows(spark, sf, "halo"), "split")
    return g.select(F.col("grp").alias("split"), "i", "j", rnd("v").alias("v"))


# ---------------------------------------------------------------- Time2Vec + RevIN feature map (pandas path) with an SQL twin
T2V_K = 2
T2V_SEEDED = time2vec_weights(8, T2V_K, seed=941)


def _t2v_revin_sql():
    W = T2V_SEEDED
    vals = ", ".join(f"({t}, {float(W['wb'][t])!r}, {float(W['bb'][t])!r}, " + ", ".join(repr(float(W['ba'][t][j])) for j in range(T2V_K)) + ")"
                     for t in range(8))
    bcols = ", ".join(f"ba{j}" for j in range(T2V_K))
    cases = " ".join(f"WHEN {j} THEN sin(xv * {float(W['wa'][j])!r} + ba{j})" for j in range(T2V_K))
    return with_views(
        f", w AS ({O.windows_cte('D6', ['segment'], 'ts', ['qty'], ['qty'], 8, 1, 1, 1440)}), "
        "st AS (SELECT segment, ts, UNNEST(range(len(x))) AS t, UNNEST(x) AS xv FROM w), "
        f"wt AS (SELECT * FROM (VALUES {vals}) v(t, wb, bb, {bcols})), "
        f"f AS (SELECT segment, ts, st.t, j, CASE j {cases} ELSE wb * xv + bb END AS fv "
        f"FROM st JOIN wt ON st.t = wt.t, range({T2V_K + 1}) r(j)), "
        "n AS (SELECT *, avg(fv) OVER (PARTITION BY segment, ts, j) AS mu, "
        "var_pop(fv) OVER (PARTITION BY segment, ts, j) AS va FROM f) "
        f"SELECT segment, ts, CAST(t * {T2V_K + 1} + j AS BIGINT) AS pos, round((fv - mu) / sqrt(va + 1e-5), 6) AS value FROM n",
        "D6")


@register("t2v_revin_features", _t2v_revin_sql())
def q_t2v_revin_features(spark, sf):
    """Seeded Time2Vec (2 periodic features + linear) then RevIN over each window's steps, computed
    per Arrow batch with numpy (the feature map behind ``predict_t2v``)."""
    w = seq_windows(spark, sf).withColumn("split", F.lit("all"))
    fr = t2v_revin_frame(w, T2V_SEEDED)
    z = fr.select("segment", "ts", F.posexplode("xf").alias("pos", "value"))
    return z.select("segment", "ts", F.col("pos").cast("long").alias("pos"), rnd("value").alias("value"))


@register("time_encode_orders", "SELECT o_orderkey, o_orderdate, "
          "round(cos(floor(epoch(o_orderdate)) * (2 * pi() / 86400)), 6) AS day_cos, "
          "round(sin(floor(epoch(o_orderdate)) * (2 * pi() / 86400)), 6) AS day_sin, "
          "round(cos(floor(epoch(o_orderdate)) * (2 * pi() / 31556952.0)), 6) AS month_cos, "
          "round(sin(floor(epoch(o_orderdate)) * (2 * pi() / 31556952.0)), 6) AS month_sin FROM orders")
def q_time_encode_orders(spark, sf):
    """Epoch cycles on order dates spanning several years: both the day and the year pair apply."""
    out = time_encode(V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return out.select("o_orderkey", "o_orderdate", *[rnd(c).alias(c) for c in ("day_cos", "day_sin", "month_cos", "month_sin")])


STRIP_DT = StripTime("%Y-%m-%d %H:%M", (2024, 1, 5, 8, 0), (2024, 1, 20, 17, 30))


@register("strip_time_datetime", "SELECT event_id, ts, event_type, round(value, 6) AS value FROM events "
          "WHERE strftime(ts, '%Y-%m-%d %H:%M') BETWEEN '2024-01-05 08:00' AND '2024-01-20 17:30'")
def q_strip_time_datetime(spark, sf):
    """Date-and-time strip: inclusive to the minute, with a typed range pushed to the scan."""
    out = strip_time(V.table(spark, sf, "events"), "ts", STRIP_DT)
    return out.select("event_id", "ts", "event_type", rnd("value").alias("value"))


from laglake.plans import chunk_queries  # noqa: E402, F401 - registers its queries
