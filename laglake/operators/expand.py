"""Experiment expansion as DataFrame jobs: univariate series per channel, feature combinations
of a channel catalogue, and the case grid (cases x datasets x feature sets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laglake.operators.common import as_keys, qc


def univariate_unpivot(df: DataFrame, key, ts: str, channels) -> DataFrame:
    """Every channel becomes its own one-channel series keyed by (key..., channel)."""
    keys = as_keys(key)
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), qc(c).alias("value")) for c in channels])).alias("_p")
    return df.select(*[qc(k) for k in keys], qc(ts), one).select(*[qc(k) for k in keys], qc(ts), "_p.channel", "_p.value")


def combination_series(df: DataFrame, key, ts: str, channels, k: int, targetless: bool = False) -> DataFrame:
    """The multi-channel series of every feature combination: (combination, key, ts, channels array). ``combination`` is the
    position in ``itertools.combinations`` order and ``channels`` holds its members' values in that order. The
    combinations come from the schema; each row of ``df`` is expanded once."""
    from itertools import combinations
    keys = as_keys(key)
    sets = list(combinations(list(channels), k + 1 if targetless else k))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("combination"), F.array(*[F.lit(c) for c in s]).alias("members"),
                                       F.array(*[qc(c).cast("double") for c in s]).alias("channels")) for i, s in enumerate(sets)])).alias("_c")
    return df.select(one, *[qc(x) for x in keys], qc(ts)).select("_c.combination", "_c.members", *[qc(x) for x in keys], qc(ts), "_c.channels")


def channel_catalogue(long_df: DataFrame, order: list[str] | None = None, dataset: str | None = None) -> DataFrame:
    """(dataset, channel, pos) of the distinct channels of a long table; ``pos`` follows
    ``order`` (declared feature order) when given, else the channel name."""
    ch = long_df.select("channel").distinct()
    if order:
        m = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
        ch = ch.withColumn("pos", m[F.col("channel")])
    else:
        ch = ch.withColumn("pos", F.dense_rank().over(Window.orderBy("channel")) - 1)
    return ch.withColumn("dataset", F.lit(dataset)) if dataset else ch


def feature_combinations(catalogue: DataFrame, k: int, targetless: bool = False) -> DataFrame:
    """All k-subsets of the catalogue's channels in catalogue order (like itertools.combinations)
    as columns c0..c{k-1}. For a dataset without a declared target (``targetless``) the subsets
    have k+1 members and the first one becomes the target: columns target, c0..c{k-1}.
    A self-join on strictly increasing positions; the catalogue has one row per channel, so it
    is broadcast."""
    size = k + 1 if targetless else k
    if size < 1:
        raise ValueError("k must be >= 1")
    cat = F.broadcast(catalogue.select("channel", "pos"))
    out = cat.select(F.col("channel").alias("m0"), F.col("pos").alias("p0"))
    for i in range(1, size):
        nxt = cat.select(F.col("channel").alias(f"m{i}"), F.col("pos").alias(f"p{i}"))
        out = out.join(nxt, F.col(f"p{i}") > F.col(f"p{i - 1}"), "inner")
    if targetless:
        return out.select(F.col("m0").alias("target"), *[F.col(f"m{i + 1}").alias(f"c{i}") for i in range(k)])
    return out.select(*[F.col(f"m{i}").alias(f"c{i}") for i in range(k)])


def expand_cases(cases: DataFrame, catalogue: DataFrame, dataset_flags: list[str], case_col: str = "Case",
                 selected=None) -> DataFrame:
    """Case rows x selected datasets: the per-dataset flag columns of the case table are unpivoted,
    truthy flags are joined to the dataset catalogue by substring match on its path (first
    catalogue entry in catalogue order wins)."""
    c = cases if selected is None else cases.where(F.col(case_col).isin(list(selected)))
    params = [x for x in c.columns if x not in dataset_flags]
    flags = c.select(*params, *[F.col(f).cast("string").alias(f) for f in dataset_flags]).unpivot(
        params, dataset_flags, "flag", "on")
    flags = flags.where(F.lower(F.col("on")).isin("1", "true", "yes", "x"))
    cat = F.broadcast(catalogue)
    j = flags.join(cat, F.col("path").contains(F.col("flag")), "inner")
    first = Window.partitionBy(*[F.col(p) for p in params], "flag").orderBy("cat_order")
    return j.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r", "on")


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
