"""Chronological train / val / test split per series, acceptance, split boundaries and raw splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laglake.operators.common import as_keys, ordered_row_number

SPLITS = ("train", "val", "test")


def split_indices(n, ratios):
    """train_idx = ceil(n*r0) and val_idx = int(n*(r0+r1)) as Column expressions on count ``n``.
    r0+r1 is summed in Python doubles (.7+.1 = .7999...), as the reference does."""
    r0, r1 = float(ratios[0]), float(ratios[1])
    return (F.ceil(n.cast("double") * F.lit(r0)).cast("long"),
            F.floor(n.cast("double") * F.lit(r0 + r1)).cast("long"))


def chrono_split(windows: DataFrame, key, ratios=(0.7, 0.1, 0.2), order: str = "tus",
                 strict_parity: bool = False):
    """Return (accepted windows with ``rn, n, split``, rejected segments with ``n, reason``).

    Rows [0, train_idx) are train, [train_idx, val_idx) val, the rest test; when val_idx < train_idx
    the test part starts at train_idx (``strict_parity=True`` also emits the overlapping rows as
    test, like the reference). A segment is rejected when train is empty, or val / test is empty
    while its ratio is not 0. Works on halo windows (``chunk`` column) without a per-key task."""
    keys = as_keys(key)
    chunk = "chunk" if "chunk" in windows.columns else None
    r = list(ratios) + [0.0] * (3 - len(ratios))
    d = ordered_row_number(windows, keys, order, chunk)
    if chunk:
        d = d.drop("chunk")
    tr, va = split_indices(F.col("n"), r)
    d = d.withColumn("_tr", tr).withColumn("_va", va)
    n_train = F.least(F.col("_tr"), F.col("n"))
    n_val = F.greatest(F.least(F.col("_va"), F.col("n")) - F.col("_tr"), F.lit(0))
    n_test = F.col("n") - F.least(F.greatest(F.col("_tr"), F.col("_va")), F.col("n"))
    reason = (F.when(n_train <= 0, "empty train")
               .when((n_val <= 0) & F.lit(r[1] != 0), "empty val")
               .when((n_test <= 0) & F.lit(r[2] != 0), "empty test"))
    d = d.withColumn("_reason", reason)
    if strict_parity:
        labels = F.array(F.when(F.col("rn") < F.col("_tr"), "train"),
                         F.when((F.col("rn") >= F.col("_tr")) & (F.col("rn") < F.col("_va")), "val"),
                         F.when(F.col("rn") >= F.col("_va"), "test"))
        d = d.withColumn("split", F.explode(F.filter(labels, lambda s: s.isNotNull())))
    else:
        d = d.withColumn("split", F.when(F.col("rn") < F.col("_tr"), "train")
                         .when(F.col("rn") < F.col("_va"), "val").otherwise("test"))
    accepted = d.where(F.col("_reason").isNull()).drop("_tr", "_va", "_reason")
    rejected = (d.where(F.col("_reason").isNotNull()).groupBy(*keys)
                .agg(F.first("n").alias("n"), F.first("_reason").alias("reason")))
    return accepted, rejected


def rejected_segments(series: DataFrame, windows: DataFrame, key, ratios=(0.7, 0.1, 0.2),
                      split_rejects: DataFrame | None = None) -> DataFrame:
    """Every segment of ``series`` that is not accepted, with its window count and a reason
    (segments without a single complete window are rejected with n = 0). Pass the rejects already
    returned by ``chrono_split`` as ``split_rejects`` to avoid splitting twice."""
    keys = as_keys(key)
    rej = split_rejects if split_rejects is not None else chrono_split(windows, keys, ratios)[1]
    have = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    none = (series.select(*keys).distinct().join(have, keys, "left_anti")
            .select(*keys, F.lit(0).cast("long").alias("n"), F.lit("no window").alias("reason")))
    return rej.unionByName(none)


def split_bounds(split_windows: DataFrame, key, ts: str) -> DataFrame:
    """Per segment: last train date, last / first val date, first test date."""
    keys = as_keys(key)
    s = F.col("split")
    return split_windows.groupBy(*keys).agg(
        F.max(F.when(s == "train", F.col(ts))).alias("train_max"),
        F.max(F.when(s == "val", F.col(ts))).alias("val_max"),
        F.min(F.when(s == "val", F.col(ts))).alias("val_min"),
        F.min(F.when(s == "test", F.col(ts))).alias("test_min"),
    )


def raw_split(raw: DataFrame, bounds: DataFrame, key, ts: str) -> DataFrame:
    """Raw rows of accepted segments labelled by date against the split boundaries:
    train ts <= train_max; val val_min <= ts <= val_max; test ts >= test_min. A row near a
    boundary can belong to two splits (window lags reach back). One equi-join on the key; the
    boundary table has one row per segment, so AQE broadcasts it when it is small."""
    keys = as_keys(key)
    t = F.col(ts)
    j = raw.join(bounds, keys, "inner") if keys else raw.crossJoin(F.broadcast(bounds))
    labels = F.array(F.when(t <= F.col("train_max"), "train"),
                     F.when((t >= F.col("val_min")) & (t <= F.col("val_max")), "val"),
                     F.when(t >= F.col("test_min"), "test"))
    return (j.withColumn("split", F.explode(F.filter(labels, lambda s: s.isNotNull())))
             .drop("train_max", "val_max", "val_min", "test_min"))


def raw_split_single(raw: DataFrame, n_windows: DataFrame, ts: str, ratios=(0.7, 0.1, 0.2),
                     chunk_minutes: int | None = 4096 * 1440) -> DataFrame:
    """Unsegmented series: raw rows (ordered by date) sliced by the *sample* indices of the
    window table: [0, train_idx) train, [train_idx, val_idx) val, [max(train_idx, val_idx), ...) test.
    ``n_windows``: one-row DataFrame with column ``n`` (count of complete windows). Row positions come
    from per-chunk counts (``chunk_minutes`` wide), so the single series is never one task."""
    from laglake.operators.common import MINUTE, chunk_of, with_micros
    r = list(ratios) + [0.0] * (3 - len(ratios))
    d = with_micros(raw, ts, "_m")
    chunk = None
    if chunk_minutes:
        d = d.withColumn("_chunk", chunk_of("_m", chunk_minutes * MINUTE))
        chunk = "_chunk"
    d = ordered_row_number(d, [], "_m", chunk, name="_rr", count_name=None)
    nb = F.broadcast(n_windows.select(F.col("n").alias("_nw")))
    d = d.crossJoin(nb)
    tr, va = split_indices(F.col("_nw"), r)
    rr = F.col("_rr")
    lab = F.when(rr < tr, "train").when(rr < va, "val").otherwise("test")
    out = d.withColumn("split", lab).drop("_m", "_rr", "_nw")
    return out.drop("_chunk") if chunk else out
