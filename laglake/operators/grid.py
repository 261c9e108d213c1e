"""Regular time grid: densify each series and fill gaps.

Missing points are generated from the row before the gap: inside (key, chunk) each row knows the next row's time, the last row of a
chunk learns it from a table of one row per chunk (a second read of key and time only). So a series' rows are shuffled once, no grid
is built and none is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laglake.functions.timecols import from_micro_index, micro_index
from laglake.operators.common import DEFAULT_CHUNK_STEPS, MINUTE, as_keys, chunk_of, qc, with_micros


def series_bounds(df: DataFrame, key, ts: str) -> DataFrame:
    """First and last timestamp per series (partial aggregation, skew safe)."""
    keys = as_keys(key)
    return df.groupBy(*[qc(k) for k in keys]).agg(F.min(qc(ts)).alias("lo"), F.max(qc(ts)).alias("hi"))


def grid(df: DataFrame, key, ts: str, minutes: int, low=None, high=None,
         chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """All grid points lo, lo+g, ..., <= hi of every series, anchored at the series' own first
    timestamp, to the microsecond (or ``low``/``high`` overrides). Generated in two explodes (chunks of ``chunk_steps`` points,
    then points) so no single row expands a whole long series."""
    keys = as_keys(key)
    b = series_bounds(df, keys, ts)
    if low is not None:
        b = b.withColumn("lo", F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        b = b.withColumn("hi", F.lit(high).cast("timestamp_ntz"))
    b = with_micros(with_micros(b, "lo", "m_lo"), "hi", "m_hi")
    steps = chunk_of(F.col("m_hi") - F.col("m_lo"), minutes * MINUTE)
    chunks = b.select(*[qc(k) for k in keys], "m_lo", steps.alias("_steps"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.floor(steps / chunk_steps).cast("long"))).alias("_c"))
    # spread the chunks of a long series over tasks before generating their points
    chunks = chunks.repartition(*[qc(k) for k in keys], F.col("_c"))
    pts = chunks.select(*[qc(k) for k in keys], "m_lo", F.explode(F.sequence(
        F.col("_c") * chunk_steps,
        F.least(F.col("_c") * chunk_steps + (chunk_steps - 1), F.col("_steps")))).alias("_i"))
    return pts.select(*[qc(k) for k in keys], from_micro_index(F.col("m_lo") + F.col("_i") * (minutes * MINUTE)).alias(ts))


def align_to_grid(df: DataFrame, key, ts: str, minutes: int, align: str = "floor") -> DataFrame:
    """Put off-grid rows onto their series' grid (anchored at the series' first timestamp):
    ``floor`` moves them to the step below (when several rows land on one step the latest
    observation wins), ``drop`` removes them, ``keep`` leaves the data unchanged. The per-series
    anchor table joins on the key (AQE broadcasts it when small, splits skew otherwise)."""
    keys = as_keys(key)
    if align == "keep":
        return df
    if align not in ("floor", "drop"):
        raise ValueError("align must be keep|floor|drop")
    b = with_micros(series_bounds(df, keys, ts), "lo", "m_lo").select(*[qc(k) for k in keys], "m_lo")
    src = with_micros(df, ts, "_m")
    src = src.join(b, keys, "inner") if keys else src.crossJoin(F.broadcast(b))
    off = (F.col("_m") - F.col("m_lo")) % F.lit(minutes * MINUTE)
    if align == "drop":
        return src.where(off == 0).drop("_m", "m_lo")
    others = [c for c in df.columns if c not in (*keys, ts)]
    floored = src.withColumn("_t", from_micro_index(F.col("_m") - off))
    kq = [qc(k) for k in keys]
    if not others:
        return floored.select(*kq, F.col("_t").alias(ts)).distinct()
    best = floored.groupBy(*kq, "_t").agg(F.max_by(F.struct(*[qc(c).alias(f"c{i}") for i, c in enumerate(others)]), qc(ts)).alias("_r"))
    return best.select(*kq, F.col("_t").alias(ts), *[F.col("_r")[f"c{i}"].alias(c) for i, c in enumerate(others)])


def fill_date(df: DataFrame, key, ts: str, minutes: int, low=None, high=None, align: str = "keep",
              chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """The rows of each series and the points of its grid lo, lo+g, ..., <= hi that have no row, with nulls in all other columns. The grid
    is anchored at the series' first timestamp (or ``low``, up to ``high``). ``align``: keep off-grid rows (default, the reference),
    ``floor`` them onto the grid, or ``drop`` them (see ``align_to_grid``). Points of a long gap are generated in blocks of
    ``chunk_steps``."""
    keys = as_keys(key)
    src = align_to_grid(df, keys, ts, minutes, align)
    if low is not None or high is not None:   # also where the grid lies outside of the rows
        return src.join(grid(src, keys, ts, minutes, low, high), on=[*keys, ts], how="full_outer")
    kq, step = [qc(k) for k in keys], minutes * MINUTE
    rest = [c for c in src.columns if c not in (*keys, ts)]
    d = src.select(*kq, qc(ts), micro_index(qc(ts)).alias("__t"), *[qc(c) for c in rest]).withColumn("__chunk", chunk_of("__t", chunk_steps * step))
    inside = Window.partitionBy(*kq, "__chunk").orderBy("__t")
    d = d.withColumn("__next", F.lead("__t").over(inside))
    per_chunk = d.groupBy(*kq, "__chunk").agg(F.min("__t").alias("__first"))
    per = Window.partitionBy(*kq)
    edges = per_chunk.select(*kq, "__chunk", F.lead("__first").over(per.orderBy("__chunk")).alias("__later"), F.min("__first").over(per).alias("__lo"))
    names = [*keys, "__chunk"]
    j = d.alias("l").join(edges.alias("r"), [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in names], "left")
    after = F.coalesce("__next", "__later")
    t, lo = F.col("__t"), F.col("__lo")
    base = t - F.pmod(t - lo, F.lit(step))                            # the grid point at or before the row
    missing = F.coalesce(chunk_of(after - base - 1, step), F.lit(0))  # points in between; none after the last row
    d = j.select(*[F.col(f"l.`{k}`").alias(k) for k in keys], F.col(f"l.`{ts}`").alias(ts), *[F.col(f"l.`{c}`").alias(c) for c in rest],
                 base.alias("__base"), F.greatest(missing, F.lit(0)).alias("__missing"))
    d = d.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__missing") / chunk_steps).cast("long"))))
    start = F.col("__block") * chunk_steps
    d = d.withColumn("__i", F.explode(F.sequence(start, F.least(start + (chunk_steps - 1), F.col("__missing")))))
    own = F.col("__i") == 0                                           # the row itself, then its missing points
    return d.select(*kq, F.when(own, qc(ts)).otherwise(from_micro_index(F.col("__base") + F.col("__i") * step).cast(src.schema[ts].dataType)).alias(ts),
                    *[F.when(own, qc(c)).alias(c) for c in rest])


def _chunked_fill(df: DataFrame, keys, ts: str, cols, forward: bool, chunk_minutes: int) -> DataFrame:
    """Forward (or backward) fill inside (key, chunk) windows, then carry the last (first)
    non-null value of earlier (later) chunks through a small per-chunk table."""
    kq = [qc(k) for k in keys]
    d = with_micros(df, ts, "_m").withColumn("_chunk", chunk_of("_m", chunk_minutes * MINUTE))
    part = Window.partitionBy(*kq, "_chunk").orderBy("_m")
    if forward:
        frame = part.rowsBetween(Window.unboundedPreceding, 0)
        local = [F.last(qc(c), ignorenulls=True).over(frame).alias(c) for c in cols]
        edge = [F.max_by(qc(c), F.when(qc(c).isNotNull(), F.col("_m"))).alias(f"_e{i}") for i, c in enumerate(cols)]
    else:
        frame = part.rowsBetween(0, Window.unboundedFollowing)
        local = [F.first(qc(c), ignorenulls=True).over(frame).alias(c) for c in cols]
        edge = [F.min_by(qc(c), F.when(qc(c).isNotNull(), F.col("_m"))).alias(f"_e{i}") for i, c in enumerate(cols)]
    others = [c for c in d.columns if c not in cols]
    filled = d.select(*[qc(c) for c in others], *local)
    per_chunk = d.groupBy(*kq, "_chunk").agg(*edge)
    wc = Window.partitionBy(*kq).orderBy("_chunk")
    wc = wc.rowsBetween(Window.unboundedPreceding, -1) if forward else wc.rowsBetween(1, Window.unboundedFollowing)
    agg = F.last if forward else F.first
    carry = per_chunk.select(*kq, "_chunk", *[agg(F.col(f"_e{i}"), ignorenulls=True).over(wc).alias(f"_carry{i}") for i in range(len(cols))])
    out = filled.join(carry, on=[*keys, "_chunk"], how="left")
    out = out.select(*[qc(c) for c in others], *[F.coalesce(qc(c), F.col(f"_carry{i}")).alias(c) for i, c in enumerate(cols)])
    return out.drop("_m", "_chunk")


_STAT_FILLS = {"min": F.min, "max": F.max, "mean": F.avg}


def fill_gaps(df: DataFrame, key, ts: str, cols, method: str | None = None,
              chunk_minutes: int = DEFAULT_CHUNK_STEPS * 1440) -> DataFrame:
    """Fill nulls in ``cols``: forward / backward (last / next observed value of the series),
    or min / max / mean of the series. ``cols`` may also map column -> method for the statistic
    fills, which then share one aggregate and one join."""
    keys = as_keys(key)
    if isinstance(cols, dict):
        plan = dict(cols)
    else:
        cols = list(cols)
        if method in ("forward", "backward"):
            return _chunked_fill(df, keys, ts, cols, method == "forward", chunk_minutes)
        plan = {c: method for c in cols}
    bad = {m for m in plan.values() if m not in _STAT_FILLS}
    if bad:
        raise ValueError(f"method must be forward|backward|min|max|mean, got {sorted(bad)}")
    cols = list(plan)
    stats = df.groupBy(*[qc(k) for k in keys]).agg(*[_STAT_FILLS[plan[c]](qc(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    out = df.join(stats, keys, "left") if keys else df.crossJoin(F.broadcast(stats))
    return out.select(*[qc(c) for c in df.columns if c not in cols],
                      *[F.coalesce(qc(c), F.col(f"_s{i}")).alias(c) for i, c in enumerate(cols)])
