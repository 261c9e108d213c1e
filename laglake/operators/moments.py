"""Second-moment (Gram) aggregation of window rows: the single data pass behind every linear fit.

For each window z = [vec(x), 1, y] (vec(x): L*F inputs, y: A labels). Every Python worker folds
its Arrow batches into one partial Gram matrix S = sum z z^T and emits it as one array per matrix row; these are
added in two steps. Only the (P+A)^2 matrix reaches the
driver, never the windows. ``chunks.lag_gram`` gives the same rows from the series themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of a matrix' terms: 8192 squared doubles are 512 MB, what a driver can solve. Checked before any job.
MAX_TERMS = 8192
#: Matrices up to so many terms are added in the JVM.
JVM_TERMS = 256

_ROWS = "grp string, i int, part int, v array<double>"


def _flat(col: str, multi: bool):
    return F.flatten(F.col(col)) if multi else F.col(col)


def gram_rows(windows: DataFrame, group: str | None = "split", x: str = "x", y: str = "y", n_terms: int | None = None,
              fan: int = 64) -> DataFrame:
    """(grp, i, v): row i of sum(z z^T) per group value (e.g. train / val), from the diagonal on.

    A task folds its Arrow batches into one matrix per group and emits it as one array per matrix row. The arrays
    are added in two steps, ``fan`` sums per row first, so no task adds up more than its share of partitions."""
    multi = isinstance(windows.schema[x].dataType.elementType, T.ArrayType)
    g = F.col(group).cast("string") if group else F.lit("all")
    z = windows.select(g.alias("grp"), F.concat(_flat(x, multi), F.array(F.lit(1.0)), F.col(y).cast("array<double>")).alias("z"))
    if n_terms is None:
        first = z.select(F.size("z").alias("n")).first()
        n_terms = first["n"] if first else 0
    if n_terms > MAX_TERMS:
        raise ValueError(f"a Gram matrix of {n_terms} terms exceeds the bound of {MAX_TERMS}")

    def fold(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() % fan
        acc: dict = {}
        for b in batches:
            grp = b.column(0).dictionary_encode()
            lists = b.column(1)
            m = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            which = grp.indices.to_numpy()
            for k, name in enumerate(grp.dictionary.to_pylist()):
                some = m[which == k]
                s = some.T @ some
                acc[name] = acc[name] + s if name in acc else s
        for name, s in acc.items():
            yield from part_rows(name, s, part)

    return added_rows(z, fold, n_terms)


def part_rows(grp: str, s: np.ndarray, part: int):
    """A task's matrix as Arrow batches of rows from the diagonal on."""
    for at in range(0, len(s), 1024):
        i = np.arange(at, min(at + 1024, len(s)))
        flat = np.concatenate([s[k, k:] for k in i])
        ends = np.concatenate([[0], np.cumsum(len(s) - i)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([grp] * len(i)), pa.array(i, pa.int32()), pa.array(np.full(len(i), part), pa.int32()),
                                          pa.ListArray.from_arrays(ends, pa.array(flat))], names=["grp", "i", "part", "v"])


def added_rows(df: DataFrame, fold, n_terms: int) -> DataFrame:
    """(grp, i, v): the tasks' matrix rows added in two steps, ``part`` first, so no task adds up more than its share of partitions. Small
    matrices are added in the JVM, larger ones (whose rows take whole megabytes) by numpy."""
    parts = df.mapInArrow(fold, _ROWS)
    if n_terms <= JVM_TERMS:
        zero = F.array_repeat(F.lit(0.0), F.size(F.element_at("vs", 1)))
        total = F.aggregate("vs", zero, lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("v")
        for by in (("grp", "i", "part"), ("grp", "i")):
            parts = parts.groupBy(*by).agg(F.collect_list("v").alias("vs")).select(*by, total)
        return parts

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(some["grp"].iloc[0], i, some["part"].iloc[0], np.sum(np.vstack(some["v"].to_numpy()), axis=0)) for i, some in pdf.groupby("i")]
        return pd.DataFrame(rows, columns=["grp", "i", "part", "v"])

    band = F.floor(F.col("i") / 64).alias("band")   # some rows of the matrix together, to have fewer groups
    parts = parts.groupBy("grp", band, "part").applyInPandas(add, _ROWS)
    return parts.groupBy("grp", band).applyInPandas(add, _ROWS).drop("part")


def gram(windows: DataFrame, group: str | None = "split", x: str = "x", y: str = "y", n_terms: int | None = None) -> DataFrame:
    """(grp, i, j, v) of sum(z z^T) per group value, upper triangle."""
    rows = gram_rows(windows, group, x, y, n_terms)
    return rows.select("grp", "i", F.posexplode("v").alias("k", "v")).select("grp", "i", (F.col("i") + F.col("k")).cast("int").alias("j"), "v")


def gram_matrices(rows: DataFrame) -> dict[str, np.ndarray]:
    """The summed rows of ``gram_rows`` as symmetric numpy matrices per group (bounded by ``MAX_TERMS``). Raises if an entry isn't
    finite: a NULL, NaN or infinite value is in the windows."""
    out: dict[str, np.ndarray] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["grp"], r["i"])):
        m = out.setdefault(r["grp"], np.zeros((len(r["v"]), len(r["v"]))))   # row 0 comes first and is the longest
        m[r["i"], r["i"]:] = r["v"]
        m[r["i"]:, r["i"]] = r["v"]
    for grp, m in out.items():
        bad = np.flatnonzero(~np.isfinite(np.diagonal(m)))
        if len(bad):
            raise ValueError(f"values that aren't finite numbers in the {grp} windows, at terms {bad[:8].tolist()} of [inputs, 1, labels] "
                             f"(term t * channels + c is channel c at step t)")
    return out
