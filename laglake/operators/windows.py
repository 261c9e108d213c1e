"""Supervised lag windows: X = `lag` steps ending `offset` steps before the anchor row,
Y = the last `ahead` steps of the targets up to the anchor row.

Strategies (same rows, different physical plans):
  * ``range``  - RANGE frames on a microsecond index; no grid, no join. Valid when every row sits on
                 its segment's grid (checked by ``grid_check``). Plan: Exchange(key) -> Sort -> Window.
  * ``halo``   - ``range`` computed per (key, time chunk); each row is copied into the following
                 chunk(s) its windows reach, so a hot or very long segment spreads over many tasks.
  * ``dense``  - densify onto the grid (``grid.fill_date``), then ROWS frames; keeps off-grid rows
                 as steps, like the reference's outer join.
  * ``dense_halo`` - ``dense`` computed per (key, block of row positions) with the previous block's
                 last rows copied in; positions come from per-chunk prefix counts (no per-key task).
  * ``auto``   - one aggregate decides: off-grid -> dense (dense_halo for long / unkeyed series);
                 largest segment > ``halo_rows`` -> halo.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laglake.functions.timecols import from_micro_index, micro_index
from laglake.operators.common import DEFAULT_CHUNK_STEPS, MINUTE, all_not_null, as_keys, chunk_of, qc
from laglake.spec import WindowSpec, unique

HALO_ROWS = 2_000_000


def lag_columns(df: DataFrame, key, ts: str, channels, spec: WindowSpec, strategy: str = "rows",
                chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Wide form: ``<c>_lag_<l>`` for l in 1..lag+offset-1.

    ``rows``: shift by rows in date order (the reference, on a densified series).
    ``range`` / ``halo``: shift by time - the value exactly l grid steps earlier, NULL when that
    step is absent. Identical on a densified on-grid series, needs no grid, and ``halo`` spreads a
    long or hot series over (key, time chunk) tasks."""
    keys = as_keys(key)
    names = [(c, l) for c in unique(channels) for l in range(1, spec.span + 1)]
    if strategy == "rows":
        w = Window.partitionBy(*keys).orderBy(ts)
        return df.select("*", *[F.lag(qc(c), l).over(w).alias(f"{c}_lag_{l}") for c, l in names])
    if strategy not in ("range", "halo"):
        raise ValueError("strategy must be rows|range|halo")
    step_us = spec.minutes * 60_000_000
    d = df.withColumn("_tus", micros(ts))
    part = list(keys)
    if strategy == "halo":
        width = chunk_steps * step_us
        d = (d.withColumn("_own", chunk_of("_tus", width))
              .withColumn("_chunk", F.explode(F.sequence(F.col("_own"), chunk_of(F.col("_tus") + spec.span * step_us, width)))))
        part.append("_chunk")
    w = Window.partitionBy(*part).orderBy("_tus")
    lags = [F.first(qc(c)).over(w.rangeBetween(-l * step_us, -l * step_us)).alias(f"{c}_lag_{l}") for c, l in names]
    out = d.select(*[qc(c) for c in df.columns], *(["_own", "_chunk"] if strategy == "halo" else []), *lags)
    if strategy == "halo":
        out = out.where(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk")
    return out


def _step(channels) -> F.Column:
    if len(channels) == 1:
        return qc(channels[0]).cast("double")
    return F.when(all_not_null(channels), F.array(*[qc(c).cast("double") for c in channels]))


def _target_step(targets) -> F.Column:
    return F.when(all_not_null(targets), F.array(*[qc(c).cast("double") for c in targets]))


def grid_check(df: DataFrame, key, ts: str, minutes: int) -> dict:
    """One aggregate: are all rows on their segment's grid, and how long is the longest segment."""
    keys = as_keys(key)
    phase = F.pmod(micros(ts), F.lit(minutes * MINUTE))
    per = df.groupBy(*[qc(k) for k in keys]).agg(F.min(phase).alias("lo"), F.max(phase).alias("hi"), F.count(F.lit(1)).alias("n"))
    r = per.agg(F.coalesce(F.min(F.col("lo") == F.col("hi")), F.lit(True)).alias("on_grid"),
                F.coalesce(F.max("n"), F.lit(0)).alias("max_rows")).first()
    return {"on_grid": bool(r["on_grid"]), "max_rows": int(r["max_rows"])}


def has_ties(df: DataFrame, key, ts: str) -> bool:
    """Whether two rows have one (key, timestamp)."""
    again = df.where(qc(ts).isNotNull()).groupBy(*[qc(k) for k in as_keys(key)], micros(ts)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return not again.isEmpty()


def make_windows(df: DataFrame, key, ts: str, channels, targets, spec: WindowSpec, strategy: str = "auto",
                 chunk_steps: int = DEFAULT_CHUNK_STEPS, halo_rows: int = HALO_ROWS, align: str = "keep",
                 on_grid: bool | None = None, ties: str = "raise") -> DataFrame:
    """``align``: ``keep`` off-grid rows as steps (reference; needs ``dense``), or ``floor`` / ``drop``
    them onto the grid first (then RANGE / halo plans apply).

    Every strategy gives the same rows: ``range`` and ``halo`` check the grid (one aggregate) and give way to
    ``dense`` / ``dense_halo`` when a row is off it. ``on_grid=True`` states that all rows are on their grid and saves
    the check. Two rows with one (key, timestamp) raise when the plan runs; ``prepare`` removes them. With ``ties="keep"`` each is a
    step, in order of the channels' values (nulls first): ``range`` and ``halo`` look for such rows (one aggregate) and give way as above.

    Return ``[*keys, (chunk,) ts, tus, x, y]`` (``tus``: microseconds since epoch, the order key); x is array<double> for one channel, else
    array<array<double>> (steps x channels, features then targets); y is array<double> of
    ahead x targets values, step-major, oldest first."""
    if ties not in ("raise", "keep"):
        raise ValueError("ties must be raise|keep")
    keys = as_keys(key)
    channels = list(unique([*channels, *targets]))
    targets = list(unique(targets))
    shared = [c for c in channels if c in keys or c == ts]
    if shared:
        # a key (e.g. a numeric station id) can also be an input channel: window a copy of it
        df = df.select("*", *[qc(c).alias(f"__ch_{c}") for c in shared])
        channels = [f"__ch_{c}" if c in shared else c for c in channels]
        targets = [f"__ch_{c}" if c in shared else c for c in targets]
    if align != "keep":
        # aligned rows are all on the grid, so the RANGE / halo plans apply
        from laglake.operators.grid import align_to_grid
        df = align_to_grid(df.select(*[qc(c) for c in (*keys, ts, *channels)]), keys, ts, spec.minutes, align)
        on_grid = True
        if strategy in ("auto", "dense"):
            strategy = "halo" if not keys else "range"
    if not keys and strategy == "range":
        strategy = "halo"   # a single series is one hot key: always spread it over time chunks
    if strategy == "auto":
        chk = grid_check(df, keys, ts, spec.minutes)
        if not chk["on_grid"] or (ties == "keep" and has_ties(df, keys, ts)):
            strategy = "dense_halo" if (chk["max_rows"] > halo_rows or not keys) else "dense"
        else:
            strategy = "halo" if (chk["max_rows"] > halo_rows or not keys) else "range"
        # ~sqrt(n) steps per chunk balances the two levels of a hot key: rows per chunk task and
        # rows of that key in the per-chunk offset table
        chunk_steps = max(chunk_steps, math.isqrt(max(chk["max_rows"], 0)))
    elif strategy in ("range", "halo") and (on_grid is None or ties == "keep"):
        chk = grid_check(df, keys, ts, spec.minutes)
        if not chk["on_grid"] or (ties == "keep" and has_ties(df, keys, ts)):
            strategy = "dense" if strategy == "range" and chk["max_rows"] <= halo_rows else "dense_halo"
    if strategy in ("dense", "dense_halo"):
        from laglake.operators.grid import fill_date
        dense = fill_date(df.select(*[qc(c) for c in (*keys, ts, *channels)]), keys, ts, spec.minutes)
        if strategy == "dense" and keys:
            return _windows_rows(dense, keys, ts, channels, targets, spec, ties)
        return _windows_rows_halo(dense, keys, ts, channels, targets, spec, chunk_steps, ties)
    # Order by a microsecond index and rebuild ``ts`` from it after the window: the shuffled
    # rows then carry no column that a second consumer (e.g. the split's per-chunk counts)
    # would prune, so Spark can reuse this one shuffle for both.
    d = df.select(*[qc(c) for c in keys], *[qc(c) for c in channels], micros(ts).alias("tus"))
    step_us = spec.minutes * 60_000_000
    if strategy == "halo":
        width = chunk_steps * step_us
        d = (d.withColumn("_own", chunk_of("tus", width))
              .withColumn("chunk", F.explode(F.sequence(F.col("_own"), chunk_of(F.col("tus") + spec.span * step_us, width)))))
        part = [*keys, "chunk"]
    elif strategy == "range":
        part = keys
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    w = Window.partitionBy(*[qc(c) for c in part]).orderBy("tus")
    xw = w.rangeBetween(-spec.span * step_us, -spec.offset * step_us)
    yw = w.rangeBetween(-(spec.ahead - 1) * step_us, 0)
    out = d.select(*[qc(c) for c in part], "tus", *(["_own"] if strategy == "halo" else []), _again(w),
                   F.collect_list(_step(channels)).over(xw).alias("x"),
                   F.collect_list(_target_step(targets)).over(yw).alias("_y"))
    if strategy == "halo":
        out = out.where(F.col("chunk") == F.col("_own")).drop("_own")
    out = _unique(out).where((F.size("x") == spec.lag) & (F.size("_y") == spec.ahead))
    return out.select(*[qc(c) for c in part], from_micro_index("tus").alias(ts), "tus", "x",
                      F.flatten("_y").alias("y"))


def micros(ts) -> F.Column:
    """Microseconds since 1970-01-01 (BIGINT): exact for TIMESTAMP_NTZ, the windows' order key."""
    return micro_index(qc(ts))


def _again(w) -> F.Column:
    """Whether the row before has the same timestamp."""
    return (F.lag("tus").over(w) == F.col("tus")).alias("_again")


def _unique(df: DataFrame, ties: str = "raise") -> DataFrame:
    """Raises at run time if a (key, timestamp) occurs twice: its windows would hold a step twice and miss another."""
    if ties == "keep":
        return df.drop("_again")
    fail = F.raise_error(F.lit("two rows with the same key and timestamp; de-duplicate them first (prepare does)")).cast("boolean")
    return df.where(F.when(F.col("_again"), fail).otherwise(F.lit(True))).drop("_again")


def _row_order(channels, ties: str) -> list:
    """The order of steps; rows that tie in all of it are equal, so every run gives the same windows. Rows without a timestamp have no order."""
    return ["tus", *([F.when(F.col("tus").isNotNull(), qc(c)) for c in channels] if ties == "keep" else [])]


def _windows_rows(dense: DataFrame, keys, ts, channels, targets, spec: WindowSpec, ties: str = "raise") -> DataFrame:
    d = dense.withColumn("tus", micros(ts))
    w = Window.partitionBy(*[qc(k) for k in keys]).orderBy(*_row_order(channels, ties))
    out = d.select(*[qc(k) for k in keys], qc(ts), "tus", _again(w),
                   F.collect_list(_step(channels)).over(w.rowsBetween(-spec.span, -spec.offset)).alias("x"),
                   F.collect_list(_target_step(targets)).over(w.rowsBetween(-(spec.ahead - 1), 0)).alias("_y"),
                   F.count(F.lit(1)).over(w.rowsBetween(-spec.span, -spec.offset)).alias("_nx"))
    out = _unique(out, ties).where((F.size("x") == spec.lag) & (F.col("_nx") == spec.lag) & (F.size("_y") == spec.ahead))
    return out.withColumn("y", F.flatten("_y")).drop("_y", "_nx")


def _windows_rows_halo(dense: DataFrame, keys, ts, channels, targets, spec: WindowSpec, chunk_steps: int, ties: str = "raise") -> DataFrame:
    """ROWS-frame windows without a per-key task: rows get their position in the series (per-chunk
    prefix counts), are grouped in blocks of ``chunk_steps`` positions, and the last ``span`` rows of
    each block are copied into the next block, so every frame is complete inside one block."""
    from laglake.operators.common import ordered_row_number
    d = dense.withColumn("tus", micros(ts))
    d = d.withColumn("_tc", chunk_of("tus", chunk_steps * spec.minutes * 60_000_000))
    d = ordered_row_number(d, keys, _row_order(channels, ties), "_tc", name="_rn", count_name=None).drop("_tc")
    d = (d.withColumn("_own", chunk_of("_rn", chunk_steps))
          .withColumn("_blk", F.explode(F.sequence(F.col("_own"), chunk_of(F.col("_rn") + spec.span, chunk_steps)))))
    w = Window.partitionBy(*[qc(k) for k in keys], "_blk").orderBy("_rn")
    out = d.select(*[qc(k) for k in keys], qc(ts), "tus", "_own", "_blk", _again(w),
                   F.collect_list(_step(channels)).over(w.rowsBetween(-spec.span, -spec.offset)).alias("x"),
                   F.collect_list(_target_step(targets)).over(w.rowsBetween(-(spec.ahead - 1), 0)).alias("_y"),
                   F.count(F.lit(1)).over(w.rowsBetween(-spec.span, -spec.offset)).alias("_nx"))
    out = _unique(out, ties).where((F.col("_blk") == F.col("_own")) & (F.size("x") == spec.lag) & (F.col("_nx") == spec.lag)
                             & (F.size("_y") == spec.ahead))
    return out.select(*[qc(k) for k in keys], qc(ts), "tus", "x", F.flatten("_y").alias("y"))
