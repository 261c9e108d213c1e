"""Exact order statistics per group by counting, without gathering a group's values.

A pass divides the open bracket of each requested rank into bins between the bracket's least and largest
value (equal on a linear and, in every second pass, on a logarithmic scale), and counts values per (group, bracket,
bin) with the bin's own least and largest value. The bin that holds the rank becomes the next bracket. The two ends of a
bracket have bins of their own, so every pass excludes values; a bracket whose ends are equal is the answer,
however many values tie there. Every pass is a hash
aggregate with map-side combining, and at most ``bins`` rows per group and rank come out of it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laglake.operators.common import as_keys, qc
from laglake.session import materialize


def _round_half_away(x):
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def nearest_rank(n, q: float):
    """0-based rank of the 'nearest' quantile: round((n-1)*q), halves away from zero."""
    return _round_half_away((n - 1).cast("double") * F.lit(float(q))).cast("long")


def _scaled(v, logarithmic: bool):
    """A finite, never falling function of a double, infinities included."""
    if logarithmic:
        size = lambda x: F.least(F.log(x) + 800.0, F.lit(2000.0))
        return F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(0.0)
    return F.least(F.greatest(v, F.lit(-1.7e308)), F.lit(1.7e308)) / 2


def exact_quantiles(df: DataFrame, key, value: str, quantiles: dict, bins: int = 4096, extra_aggs=(),
                    max_broadcast_groups: int = 100_000) -> DataFrame:
    """``quantiles``: name -> q (nearest-rank quantile) or name -> 'median' (interpolated mean of
    the two middle values). Returns keys, n, ``extra_aggs`` (over the column ``_v``) and one column per name.
    NaN counts as larger than any number."""
    keys = as_keys(key)
    targets = []  # (name, rank builder)
    for name, q in quantiles.items():
        if q == "median":
            targets += [(name, lambda n: F.floor((n - 1) / 2).cast("long")), (name, lambda n: F.ceil((n - 1) / 2).cast("long"))]
        else:
            targets.append((name, lambda n, q=float(q): nearest_rank(n, q)))
    kq = [qc(k) for k in keys]
    d = df.where(qc(value).isNotNull()).select(*kq, qc(value).cast("double").alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)
    number = F.when(~F.isnan("_v"), F.col("_v"))
    base = d.groupBy(*kq).agg(F.count("_v").alias("n"), F.count(number).alias("_m"), F.min(number).alias("_lo"), F.max(number).alias("_hi"), *extra_aggs)
    base = materialize(base, "quantile-groups")
    small = base.count() <= max_broadcast_groups
    rank = F.element_at(F.array(*[f(F.col("n")) for _, f in targets]), F.col("_t") + 1)
    state = (base.withColumn("_t", F.explode(F.array(*[F.lit(i) for i in range(len(targets))]))).withColumn("_k", rank)
             .select(*kq, "_t", "_k", F.when(F.col("_k") < F.col("_m"), F.col("_lo")).otherwise(F.lit(float("nan"))).alias("_lo"),
                     F.when(F.col("_k") < F.col("_m"), F.col("_hi")).otherwise(F.lit(float("nan"))).alias("_hi")))
    state = materialize(state, "quantile-brackets")
    open_ = F.col("_lo") < F.col("_hi")
    open_ = open_ & ~F.isnan("_lo")
    done, logarithmic = [], True
    while True:
        logarithmic = not logarithmic
        done.append(state.where(~open_))
        todo = state.where(open_)
        if todo.isEmpty():
            break
        # ranks of a group with one bracket share its counts
        brackets = todo.select(*kq, "_lo", "_hi").distinct()
        if small:   # a bracket per group and rank, of a counted number of groups
            brackets = F.broadcast(brackets)
        j = d.join(brackets, keys) if keys else d.crossJoin(brackets)
        v, lo, hi = (_scaled(F.col(c), logarithmic) for c in ("_v", "_lo", "_hi"))
        inner = F.greatest(F.least(F.floor(F.try_divide(v - lo, hi - lo) * (bins - 2)), F.lit(bins - 3)), F.lit(0))
        at = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(1 + F.coalesce(inner, F.lit(0)))
        counts = (j.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                  .withColumn("_bin", at.cast("int"))
                  .groupBy(*kq, "_lo", "_hi", "_bin").agg(F.count("_v").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b")))
        upto = Window.partitionBy(*kq, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        hit = todo.join(counts, [*keys, "_lo", "_hi"]).where((F.col("_below") <= F.col("_k")) & (F.col("_k") < F.col("_below") + F.col("_c")))
        state = materialize(hit.select(*kq, "_t", (F.col("_k") - F.col("_below")).alias("_k"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi")), "quantile-brackets")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    value_of = lambda i: F.max(F.when(F.col("_t") == i, F.col("_lo")))
    cols: dict = {}
    for i, (name, _) in enumerate(targets):
        cols.setdefault(name, []).append(value_of(i))
    wide = found.groupBy(*kq).agg(*[(v[0] if len(v) == 1 else (v[0] + v[1]) / 2).alias(name) for name, v in cols.items()])
    base = base.drop("_m", "_lo", "_hi")
    out = base.join(wide, keys) if keys else base.crossJoin(F.broadcast(wide))
    out = materialize(out, "quantiles")   # one row per group; lets the cached input go
    d.unpersist()
    return out


SKETCH_K, SKETCH_ERROR = 4096, 0.003   # entries of a sketch level; three times the rank error that such sketches have


def channel_statistics(df: DataFrame, channels, quantiles: dict, fan: int = 64, collect_rows: int = 200_000) -> dict[str, dict]:
    """channel -> n, min, max, mean, variance (sample) and the exact ``quantiles`` (as in ``exact_quantiles``) of each channel, from at most three
    scans, whatever the data:

    1. moments and a mergeable sketch per channel, merged in two steps (``fan`` first). The sketch brackets every asked rank;
    2. values below each bracket are counted;
    3. values inside of a bracket (less than a hundredth) are counted by value. The rank is found among those counts: on the
       driver if they are few, else by bins as in ``exact_quantiles``, which reads the counts only.

    Sketches err with a small probability. If a rank isn't in its bracket, the channel takes ``exact_quantiles`` instead. Channels
    without a value are left out. What reaches the driver is bounded by the schema, ``fan`` and ``collect_rows``."""
    channels = list(channels)
    d = df.select(*[qc(c).cast("double").alias(f"v{i}") for i, c in enumerate(channels)]).persist(StorageLevel.MEMORY_AND_DISK)
    cols = [F.col(f"v{i}") for i in range(len(channels))]
    number = [F.when(~F.isnan(c), c) for c in cols]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.count(number[i]).alias(f"m{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), F.avg(c).alias(f"mean{i}"),
                 F.var_pop(c).alias(f"var{i}"), F.min(number[i]).alias(f"lo{i}"), F.max(number[i]).alias(f"hi{i}"), F.kll_sketch_agg_double(number[i], SKETCH_K).alias(f"s{i}")]
    parts = materialize(d.groupBy((F.spark_partition_id() % fan).alias("part")).agg(*aggs), "channel-sketches")
    rows = parts.select(*[c for c in parts.columns if c[0] != "s"]).collect()
    out = {c: s for i, c in enumerate(channels) if (s := _moments(rows, i))["n"]}
    ranks = {(i, r) for i, c in enumerate(channels) if c in out for q in quantiles.values() for r in _ranks(q, out[c]["n"]) if r < out[c]["m"]}
    found = _selected(d, parts, number, out, channels, sorted(ranks), collect_rows)
    for i, c in enumerate(channels):
        if c in out:
            s = out[c]
            for name, q in quantiles.items():
                values = [found.get((i, r)) if r < s["m"] else float("nan") for r in _ranks(q, s["n"])]
                s[name] = None if None in values else sum(values) / len(values)
            if any(s[name] is None for name in quantiles):   # a sketch that missed a rank
                exact = exact_quantiles(d.select(F.col(f"v{i}").alias("v")), None, "v", quantiles).first()
                s.update({name: exact[name] for name in quantiles})
    d.unpersist()
    return out


def _moments(rows, i: int) -> dict:
    """Counts, extremes, mean and sample variance of a channel from those of the parts."""
    n, mean, square = 0, 0.0, 0.0
    for r in rows:
        if r[f"n{i}"]:
            k, step = r[f"n{i}"], r[f"mean{i}"] - mean
            square += r[f"var{i}"] * k + step * step * n * k / (n + k)
            mean += step * k / (n + k)
            n += k
    some = [r for r in rows if r[f"n{i}"]]
    known = [r for r in rows if r[f"m{i}"]]
    nan = any(r[f"m{i}"] < r[f"n{i}"] for r in some)
    pick = lambda f, c: f((r[f"{c}{i}"] for r in known), default=None)
    lo, hi = pick(min, "lo"), pick(max, "hi")
    return {"n": n, "m": sum(r[f"m{i}"] for r in rows), "min": float("nan") if lo is None else lo, "max": float("nan") if nan else hi, "lo": lo, "hi": hi,
            "mean": mean, "variance": square / (n - 1) if n > 1 else None}


def _ranks(q, n: int) -> list[int]:
    """0-based ranks whose values' mean is the quantile."""
    if q == "median":
        return [(n - 1) // 2, n // 2]
    return [int((n - 1) * float(q) + 0.5)]


def _selected(d: DataFrame, parts: DataFrame, number, stats: dict, channels, ranks: list, collect_rows: int) -> dict:
    """(channel number, rank) -> value, for the ranks that lie in their sketch's bracket."""
    if not ranks:
        return {}
    at = lambda i, r: r / max(1, stats[channels[i]]["m"] - 1)
    used = sorted({i for i, _ in ranks})
    merged = parts.agg(*[F.kll_merge_agg_double(f"s{i}", SKETCH_K).alias(f"s{i}") for i in used])
    ask = [F.kll_sketch_get_quantile_double(f"s{i}", F.lit(min(1.0, max(0.0, at(i, r) + e)))) for i, r in ranks for e in (-SKETCH_ERROR, SKETCH_ERROR)]
    edges = merged.select(*ask).first()
    low, high = {}, {}
    for t, (i, r) in enumerate(ranks):
        s = stats[channels[i]]
        low[t] = s["lo"] if at(i, r) <= SKETCH_ERROR else edges[2 * t]
        high[t] = s["hi"] if at(i, r) >= 1 - SKETCH_ERROR else edges[2 * t + 1]
    below = d.agg(*[F.count_if(number[i] < low[t]) for t, (i, _) in enumerate(ranks)]).first()
    hits = F.array(*[F.when((number[i] >= low[t]) & (number[i] <= high[t]), F.struct(F.lit(t).alias("t"), number[i].alias("v"))) for t, (i, _) in enumerate(ranks)])
    counts = materialize(d.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).groupBy("h.t", "h.v").agg(F.count(F.lit(1)).alias("c")), "bracket-counts")
    todo = {t: (r - below[t], low[t], high[t]) for t, (_, r) in enumerate(ranks)}
    done: dict = {}
    few = counts.limit(collect_rows + 1).collect()
    if len(few) <= collect_rows:
        per: dict = {}
        for row in few:
            per.setdefault(row["t"], []).append((row["v"], row["c"]))
        for t, (k, _, _) in todo.items():
            for v, c in sorted(per.get(t, [])):
                if 0 <= k < c:
                    done[ranks[t]] = v
                    break
                k -= c
        return done
    logarithmic = True
    while todo:
        logarithmic = not logarithmic
        some = [(t, k, float(a), float(b)) for t, (k, a, b) in todo.items()]
        ends = F.broadcast(counts.sparkSession.createDataFrame(some, "t int, k long, a double, b double"))   # a row per asked rank
        v, lo, hi = (_scaled(F.col(c), logarithmic) for c in ("v", "a", "b"))
        inner = F.greatest(F.least(F.floor(F.try_divide(v - lo, hi - lo) * 4094), F.lit(4093)), F.lit(0))
        bin_ = F.when(F.col("v") == F.col("a"), 0).when(F.col("v") == F.col("b"), 4095).otherwise(1 + F.coalesce(inner, F.lit(0))).cast("int")
        binned = (counts.join(ends, "t").where((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).groupBy("t", bin_.alias("bin"))
                  .agg(F.sum("c").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).collect())
        for t, (k, _, _) in list(todo.items()):
            for r in sorted((r for r in binned if r["t"] == t), key=lambda r: r["bin"]):
                if k < 0 or k < r["c"]:
                    break
                k -= r["c"]
            else:
                k = -1
            if k < 0:
                del todo[t]   # not in its bracket
            elif r["a"] == r["b"]:
                done[ranks[t]] = r["a"]
                del todo[t]
            else:
                todo[t] = (k, r["a"], r["b"])
    return done
