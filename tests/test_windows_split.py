"""Micro fixtures for grid, windows and split (FIXTURES.md section 3)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from laglake.operators.grid import fill_date, fill_gaps
from laglake.operators.split import chrono_split, rejected_segments
from laglake.operators.windows import make_windows
from laglake.spec import WindowSpec

D = dt.datetime(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i - 1)


def series(spark, rows, schema="segment string, ts timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


def win_rows(w):
    return sorted((r["segment"], r["ts"], tuple(r["x"]), tuple(r["y"])) for r in w.collect())


def test_fx1_gap_densify_and_windows(spark):
    s = series(spark, [("a", day(i), float(i)) for i in (1, 2, 4, 5, 6)])
    dense = fill_date(s, "segment", "ts", 1440)
    got = sorted((r["ts"], r["v"]) for r in dense.collect())
    assert [t for t, _ in got] == [day(i) for i in range(1, 7)]
    assert dict(got)[day(3)] is None
    spec = WindowSpec(lag=2, ahead=1, offset=1)
    res = {st: win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy=st, chunk_steps=2))
           for st in ("range", "dense", "halo")}
    # windows ending on days 4 and 5 need day 3 -> absent; only day 6 (x = [4, 5]) survives
    assert res["range"] == [("a", day(6), (4.0, 5.0), (6.0,))]
    assert res["range"] == res["dense"] == res["halo"]


def test_fx2_unused_inner_gap_keeps_window(spark):
    # lag 2, offset 3, ahead 1: x = steps t-4, t-3; y = step t; steps t-1, t-2 unused
    s = series(spark, [("a", day(i), float(i)) for i in (1, 2, 5)])
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=2, ahead=1, offset=3))
    assert win_rows(w) == [("a", day(5), (1.0, 2.0), (5.0,))]


def test_fx10_offset_raised_to_ahead():
    assert WindowSpec(lag=4, ahead=3, offset=1).offset == 3


def test_fx12_exact_target_names(spark):
    rows = [("s", day(i), float(i), float(10 * i)) for i in range(1, 8)]
    s = spark.createDataFrame(rows, "segment string, ts timestamp_ntz, a double, `max. a` double")
    w = make_windows(s, "segment", "ts", ["max. a"], ["a"], WindowSpec(lag=2, ahead=2, offset=2))
    r = w.orderBy("ts").first()
    assert len(r["y"]) == 2 and len(r["x"]) == 2 and len(r["x"][0]) == 2


def test_multichannel_step_order(spark):
    rows = [("s", day(i), float(i), float(-i)) for i in range(1, 5)]
    s = spark.createDataFrame(rows, "segment string, ts timestamp_ntz, f double, t double")
    w = make_windows(s, "segment", "ts", ["f"], ["t"], WindowSpec(lag=2, ahead=1, offset=1))
    r = w.orderBy("ts").first()
    assert r["x"] == [[1.0, -1.0], [2.0, -2.0]] and r["y"] == [-3.0]


def test_fx6_split_val_empty_rejected(spark):
    s = series(spark, [("a", day(i), float(i)) for i in range(1, 11)])
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=1))
    w = w.unionByName(w.limit(0))
    # 9 windows here; build exactly 10 by using lag 1 on 11 days
    s = series(spark, [("a", day(i), float(i)) for i in range(1, 12)])
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=1))
    acc, rej = chrono_split(w, "segment", (0.7, 0.1, 0.2))
    assert acc.count() == 0
    r = rej.collect()
    assert len(r) == 1 and r[0]["n"] == 10 and r[0]["reason"] == "empty val"


def test_fx7_overlap_rule(spark):
    s = series(spark, [("a", day(i), float(i)) for i in range(1, 7)])
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=1))   # n = 5
    acc, _ = chrono_split(w, "segment", (0.7, 0.0, 0.3))
    c = {r["split"]: r["count"] for r in acc.groupBy("split").count().collect()}
    assert c == {"train": 4, "test": 1}
    acc2, _ = chrono_split(w, "segment", (0.7, 0.0, 0.3), strict_parity=True)
    c2 = {r["split"]: r["count"] for r in acc2.groupBy("split").count().collect()}
    assert c2 == {"train": 4, "test": 2}


def test_fx8_short_segment_rejected(spark):
    rows = [("long", day(i), float(i)) for i in range(1, 40)] + [("short", day(i), 1.0) for i in (1, 2)]
    s = series(spark, rows)
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=5))
    rej = {r["segment"]: r["reason"] for r in rejected_segments(s, w, "segment").collect()}
    assert rej == {"short": "no window"}


def test_fx9_off_grid_alignment(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=m), float(m)) for m in (0, 60, 90, 120)]
    s = series(spark, rows)
    assert fill_date(s, "segment", "ts", 60, align="keep").count() == 4
    assert fill_date(s, "segment", "ts", 60, align="drop").count() == 3
    fl = fill_date(s, "segment", "ts", 60, align="floor")
    # 01:30 floors onto 01:00: one row per grid step, the latest observation (90) wins
    assert sorted((r["ts"].hour, r["ts"].minute, r["v"]) for r in fl.collect()) == [(0, 0, 0.0), (1, 0, 90.0), (2, 0, 120.0)]


def test_halo_equals_range_random(spark):
    rnd = random.Random(7)
    rows = []
    for seg in ("a", "b"):
        for i in range(1, 400):
            if rnd.random() < 0.85:
                rows.append((seg, day(i), None if rnd.random() < 0.05 else float(rnd.randint(0, 9))))
    s = series(spark, rows)
    spec = WindowSpec(lag=4, ahead=2, offset=3)
    a = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="range"))
    b = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="halo", chunk_steps=16))
    c = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="dense"))
    assert a == b == c and len(a) > 10
    sa, _ = chrono_split(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="halo", chunk_steps=16), "segment")
    sb, _ = chrono_split(make_windows(s, "segment", "ts", ["v"], ["v"], spec), "segment")
    key = lambda df: sorted((r["segment"], r["ts"], r["rn"], r["n"], r["split"]) for r in df.collect())
    assert key(sa) == key(sb)


def test_fills_cross_chunks(spark):
    rows = [("a", day(i), (float(i) if i in (2, 9) else None)) for i in range(1, 13)]
    s = series(spark, rows)
    fw = dict((r["ts"].day, r["v"]) for r in fill_gaps(s, "segment", "ts", ["v"], "forward", chunk_minutes=3 * 1440).collect())
    bw = dict((r["ts"].day, r["v"]) for r in fill_gaps(s, "segment", "ts", ["v"], "backward", chunk_minutes=3 * 1440).collect())
    assert fw[1] is None and fw[5] == 2.0 and fw[12] == 9.0
    assert bw[1] == 2.0 and bw[5] == 9.0 and bw[12] is None
    mean = dict((r["ts"].day, r["v"]) for r in fill_gaps(s, "segment", "ts", ["v"], "mean").collect())
    assert mean[1] == pytest.approx(5.5)


def test_auto_strategy_and_grid_check(spark):
    from laglake.operators.windows import grid_check
    on = series(spark, [("a", day(i), float(i)) for i in range(1, 30)])
    assert grid_check(on, "segment", "ts", 1440) == {"on_grid": True, "max_rows": 29}
    off = on.unionByName(series(spark, [("a", day(3) + dt.timedelta(hours=5), 9.0)]))
    assert grid_check(off, "segment", "ts", 1440)["on_grid"] is False
    spec = WindowSpec(lag=3)
    a = win_rows(make_windows(on, "segment", "ts", ["v"], ["v"], spec, strategy="auto"))
    b = win_rows(make_windows(on, "segment", "ts", ["v"], ["v"], spec, strategy="auto", halo_rows=5))
    assert a == b == win_rows(make_windows(on, "segment", "ts", ["v"], ["v"], spec, strategy="range"))
    # off-grid rows count as steps under the dense (reference) semantics
    d = win_rows(make_windows(off, "segment", "ts", ["v"], ["v"], spec, strategy="auto"))
    assert d == win_rows(make_windows(off, "segment", "ts", ["v"], ["v"], spec, strategy="dense"))


def test_lag_columns_strategies(spark):
    from laglake.operators.windows import lag_columns
    s = fill_date(series(spark, [("a", day(i), float(i)) for i in (1, 2, 4, 5, 6, 9)]), "segment", "ts", 1440)
    spec = WindowSpec(lag=2, ahead=1, offset=1)
    key = lambda df: sorted((r["ts"], r["v"], r["v_lag_1"], r["v_lag_2"]) for r in df.collect())
    rows = key(lag_columns(s, "segment", "ts", ["v"], spec))
    assert rows == key(lag_columns(s, "segment", "ts", ["v"], spec, strategy="halo", chunk_steps=2))
    assert rows[5] == (day(6), 6.0, 5.0, 4.0)


def test_assembly_keeps_the_target_test_and_source_train(spark):
    from laglake.operators.assemble import assemble_zero_shot
    t = series(spark, [("a", day(i), float(i)) for i in range(1, 40)]).withColumn("split", F.lit("test")) \
        .withColumn("x", F.array(F.col("v"))).withColumn("y", F.array(F.col("v")))
    src = t.withColumn("split", F.when(F.col("v") < 20, "train").otherwise("test"))
    a = assemble_zero_shot(t, {"src": src})
    assert a.where(F.col("dataset") == "target").count() == 39   # the target's test set stays whole
    assert a.where(F.col("dataset") == "src").count() == 19
    with pytest.raises(ValueError):
        assemble_zero_shot(t, {"src": src}, shapes={"target": (8, 1, 1), "src": (4, 1, 1)})


@pytest.mark.parametrize("ratios", [(0.7, 0.1, 0.2), (0.6, 0.2, 0.2), (0.7, 0.0, 0.3), (0.5, 0.25, 0.25)])
def test_split_sizes_all_lengths(spark, ratios):
    import math
    rows = [(f"s{n:02d}", day(i), float(i)) for n in range(1, 61) for i in range(1, n + 2)]
    s = series(spark, rows)
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=1), strategy="halo", chunk_steps=8)
    acc, rej = chrono_split(w, "segment", ratios)
    got = {}
    for r in acc.groupBy("segment", "split").count().collect():
        got.setdefault(r["segment"], {})[r["split"]] = r["count"]
    rejected = {r["segment"]: r["reason"] for r in rej.collect()}
    for n in range(1, 61):
        tr = math.ceil(n * ratios[0])
        va = int(n * (ratios[0] + ratios[1]))
        sizes = {"train": min(tr, n), "val": max(min(va, n) - tr, 0), "test": n - min(max(tr, va), n)}
        bad = sizes["train"] <= 0 or (ratios[1] != 0 and sizes["val"] <= 0) or (ratios[2] != 0 and sizes["test"] <= 0)
        seg = f"s{n:02d}"
        if bad:
            assert seg in rejected and seg not in got
        else:
            assert got[seg] == {k: v for k, v in sizes.items() if v > 0}, (n, got[seg], sizes)
            # splits are contiguous and chronological
            order = [r["split"] for r in acc.where(F.col("segment") == seg).orderBy("ts").collect()] if n in (7, 33) else []
            assert order == sorted(order, key=["train", "val", "test"].index)


def test_fx9_window_alignment(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=m), float(m)) for m in (0, 60, 90, 120, 180, 200)]
    s = series(spark, rows)
    spec = WindowSpec(lag=2, ahead=1, offset=1, minutes=60)
    drop = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, align="drop"))
    assert [(r[2], r[3]) for r in drop] == [((0.0, 60.0), (120.0,)), ((60.0, 120.0), (180.0,))]
    fl = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, align="floor"))
    # 01:30 floors onto 01:00 and wins there (latest observation); 03:20 floors onto 03:00
    assert [(r[2], r[3]) for r in fl] == [((0.0, 90.0), (120.0,)), ((90.0, 120.0), (200.0,))]
    keep = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="dense"))
    assert len(keep) > 0


def test_dense_halo_equals_dense(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for seg in ("a", "b"):
        for i in range(300):
            if rnd.random() < 0.8:
                rows.append((seg, t0 + dt.timedelta(hours=i), float(rnd.randint(0, 9))))
            if rnd.random() < 0.1:   # off-grid observations count as steps under dense semantics
                rows.append((seg, t0 + dt.timedelta(hours=i, minutes=17), float(rnd.randint(0, 9))))
    s = series(spark, rows)
    spec = WindowSpec(lag=3, ahead=2, offset=2, minutes=60)
    a = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="dense"))
    b = win_rows(make_windows(s, "segment", "ts", ["v"], ["v"], spec, strategy="dense_halo", chunk_steps=16))
    assert a == b and len(a) > 50
    one = s.where(F.col("segment") == "a").drop("segment").withColumn("segment", F.lit("a"))
    c = win_rows(make_windows(one.drop("segment"), None, "ts", ["v"], ["v"], spec, strategy="dense", chunk_steps=16)
                 .withColumn("segment", F.lit("a")))
    assert c == [r for r in a if r[0] == "a"]


def test_segment_is_also_a_channel(spark):
    # a dataset whose segment column (numeric station id) is also listed as a feature
    rows = [(st, day(i), float(i * st)) for st in (3, 7) for i in range(1, 8)]
    s = spark.createDataFrame(rows, "station bigint, ts timestamp_ntz, average double")
    for strat in ("range", "halo", "dense"):
        w = make_windows(s, "station", "ts", ["station"], ["average"], WindowSpec(lag=2), strategy=strat, chunk_steps=4)
        r = w.where(F.col("station") == 7).orderBy("ts").first()
        assert r["x"] == [[7.0, 7.0], [7.0, 14.0]] and r["y"] == [21.0], strat


def test_two_targets_two_horizons_step_major(spark):
    rows = [("s", day(i), float(i), float(10 * i), float(100 * i)) for i in range(1, 9)]
    s = spark.createDataFrame(rows, "segment string, ts timestamp_ntz, f double, a double, b double")
    for strat in ("range", "halo", "dense"):
        w = make_windows(s, "segment", "ts", ["f"], ["a", "b"], WindowSpec(lag=2, ahead=2, offset=2), strategy=strat)
        r = w.orderBy("ts").first()
        # anchor day 4: x = days 1..2 (f, a, b), y = days 3..4 step-major (a, b, a, b)
        assert r["ts"] == day(4), strat
        assert r["x"] == [[1.0, 10.0, 100.0], [2.0, 20.0, 200.0]], strat
        assert r["y"] == [30.0, 300.0, 40.0, 400.0], strat


def test_shuffle_deterministic_and_paired(spark):
    from laglake.operators.assemble import shuffle_windows
    s = series(spark, [("a", day(i), float(i)) for i in range(1, 60)])
    w = make_windows(s, "segment", "ts", ["v"], ["v"], WindowSpec(lag=2), strategy="range")
    order = lambda seed: [(r["ts"], r["x"][-1], r["y"][0]) for r in shuffle_windows(w, ["segment", "ts"], seed).collect()]
    a, b, c = order(941), order(941), order(7)
    assert a == b and a != c and sorted(a) == sorted(c)
    assert all(y == x + 1 for _, x, y in a)   # x and y of each window stay together
    assert [t for t, _, _ in a] != sorted(t for t, _, _ in a)


def test_unkeyed_paths(spark):
    from laglake.operators.grid import align_to_grid
    from laglake.operators.quantiles import exact_quantiles
    from laglake.operators.split import raw_split, split_bounds
    s = spark.createDataFrame([(day(i), float(i)) for i in (1, 2, 4, 5, 6, 8)], "ts timestamp_ntz, v double")
    dense = fill_date(s, None, "ts", 1440)
    assert dense.count() == 8 and dense.where(F.col("v").isNull()).count() == 2
    filled = {r["ts"].day: r["v"] for r in fill_gaps(dense, None, "ts", ["v"], "max").collect()}
    assert filled[3] == 8.0 and filled[1] == 1.0
    assert align_to_grid(s, None, "ts", 1440, "drop").count() == 6
    long = spark.createDataFrame([(day(i), float(i)) for i in range(1, 22)], "ts timestamp_ntz, v double")
    w = make_windows(long, None, "ts", ["v"], ["v"], WindowSpec(lag=1))     # unkeyed -> halo plan
    acc, _ = chrono_split(w, None, (0.6, 0.2, 0.2))                          # 20 windows: 12 / 4 / 4
    assert {r["split"]: r["count"] for r in acc.groupBy("split").count().collect()} == {"train": 12, "val": 4, "test": 4}
    b = split_bounds(acc, None, "ts")
    labelled = {r["split"]: r["count"] for r in raw_split(long, b, None, "ts").groupBy("split").count().collect()}
    # train rows up to the last train anchor (day 13), val days 14..17, test days 18..21
    assert labelled == {"train": 13, "val": 4, "test": 4}
    q = exact_quantiles(s, None, "v", {"median": "median", "q75": 0.75}).first()
    assert q["median"] == 4.5 and q["q75"] == 6.0


def test_grid_low_high_override(spark):
    s = series(spark, [("a", day(i), float(i)) for i in (3, 5)] + [("b", day(4), 1.0)])
    g = fill_date(s, "segment", "ts", 1440, low=day(1), high=day(6))
    per = {}
    for r in g.collect():
        per.setdefault(r["segment"], []).append(r["ts"])
    assert sorted(per["a"]) == [day(i) for i in range(1, 7)]
    assert sorted(per["b"]) == [day(i) for i in range(1, 7)]
    # long series: grid points come from several chunks
    from laglake.operators.grid import grid
    pts = grid(s.where(F.col("segment") == "a"), "segment", "ts", 60, chunk_steps=7)
    assert pts.count() == 2 * 24 + 1 and pts.select("ts").distinct().count() == 49


def tied_rows():
    at = dt.datetime(2024, 1, 1)
    return [("a", at, 1.0), ("a", at + dt.timedelta(hours=1), 3.0), ("a", at + dt.timedelta(hours=1), 2.0), ("a", at + dt.timedelta(hours=1), 3.0),
            ("a", at + dt.timedelta(hours=2), 4.0), ("a", at + dt.timedelta(hours=4), 5.0), ("a", at + dt.timedelta(hours=5), 6.0),
            ("a", at + dt.timedelta(hours=5), None), ("b", at, 7.0), ("b", at, 7.0), ("b", at, 8.0)]


@pytest.mark.parametrize("late", [0, 30])
@pytest.mark.parametrize("strategy", ["range", "halo", "dense", "dense_halo", "auto"])
def test_tied_rows_are_steps_of_their_own_when_kept(spark, strategy, late):
    off = [("b", dt.datetime(2024, 1, 1, 0, 0, late), 9.0)] if late else []   # a row off the grid
    df = spark.createDataFrame(tied_rows() + off, "segment string, ts timestamp_ntz, v double").repartition(3)
    spec = WindowSpec(lag=2, ahead=1, offset=1, minutes=60)
    for stated in (None, True) if not late and strategy in ("range", "halo") else (None,):
        w = make_windows(df, "segment", "ts", ["v"], ["v"], spec, strategy=strategy, chunk_steps=2, on_grid=stated, ties="keep")
        got = sorted((r.segment, r.ts.hour, r.ts.second, tuple(r.x), tuple(r.y)) for r in w.collect())
        # the steps of a: 1, 2 3 3, 4, none, 5, none 6
        assert got == [("a", 1, 0, (1.0, 2.0), (3.0,)), ("a", 1, 0, (2.0, 3.0), (3.0,)), ("a", 2, 0, (3.0, 3.0), (4.0,)),
                       ("b", 0, 0, (7.0, 7.0), (8.0,))] + ([("b", 0, 30, (7.0, 8.0), (9.0,))] if late else [])


@pytest.mark.parametrize("name", ["raw_windows_range", "raw_windows_halo", "raw_windows_dense", "raw_windows_dense_halo"])
def test_events_of_one_type_and_time_are_steps_as_in_the_sql(spark, tmp_path, name):
    import __spark_entry__ as E
    import duckdb
    at = dt.datetime(2024, 1, 1, 0, 0, 3, 7)
    rows = [(k, at + dt.timedelta(minutes=37 * i), kind, float(i * 10 + len(kind))) for k in range(3) for kind in ("view", "click") for i in range(30) if i % 7]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").coalesce(2).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in E.queries()[name](spark, str(tmp_path)).select("segment", "ts", "part", "pos", "value").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got and got == sorted(con.sql(f"SELECT segment, ts, part, pos, value FROM ({E.oracle_sql()[name]})").fetchall())
