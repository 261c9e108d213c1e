"""Chunked series: the window store that doesn't repeat a value for every lag.

A series is kept as rows (key, chunk, phase, pos, v): a run of grid steps with the steps that the first windows of the chunk reach back to
(the halo). Consumers cut windows inside their own Arrow batch: window rows, second moments and predictions all come from the same rows.
Chunks are at least ``HALO_SHARE`` times as long as the halo, so what is written stays within a sixteenth of the series'
own size, whatever the lag.

Second moments (``lag_gram``). Entries of the Gram matrix of windows are sums of products of shifted series. Over a run of consecutive
anchors s..e, the entry of shifts (a + 1, b + 1) is that of (a, b) plus the product that enters at the left end minus
the one that leaves at the right end. So only products with the unshifted series are summed step by step (linear in the lag);
all else follows along the diagonals from the runs' ends, once per task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laglake.functions.timecols import from_micro_index, micro_index
from laglake.operators.common import DEFAULT_CHUNK_STEPS, MINUTE, all_not_null, as_keys, chunk_of, qc
from laglake.operators.moments import MAX_TERMS, added_rows, part_rows
from laglake.operators.split import split_indices
from laglake.session import materialize
from laglake.spec import WindowSpec, unique

HALO_SHARE = 16


def chunk_series(df: DataFrame, key, ts: str, channels, targets, spec: WindowSpec, chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """[*keys, chunk, phase, pos, v]: ``pos`` are the grid positions of the chunk's rows, from 0 at the halo's first step, rising; ``v`` holds an array of
    values per channel (features, then targets). Rows without any value aren't kept. Raises if a series has rows off its grid, or two rows
    with one timestamp."""
    keys, channels = as_keys(key), list(unique([*channels, *targets]))
    steps = max(chunk_steps, HALO_SHARE * spec.span)
    width = spec.minutes * MINUTE
    d = df.select(*[qc(k) for k in keys], micro_index(qc(ts)).alias("__t"), *[qc(c).cast("double").alias(f"__v{i}") for i, c in enumerate(channels)])
    d = d.where(F.coalesce(*[F.col(f"__v{i}") for i in range(len(channels))]).isNotNull())
    d = d.withColumn("__p", chunk_of("__t", width)).withColumn("phase", F.pmod("__t", F.lit(width)))
    own, last = chunk_of("__p", steps), chunk_of(F.col("__p") + spec.span, steps)
    d = d.withColumn("chunk", F.explode(F.sequence(own, last)))
    at = (F.col("__p") - F.col("chunk") * steps + spec.span).cast("int")
    row = F.struct(at.alias("p"), *[F.col(f"__v{i}").alias(f"v{i}") for i in range(len(channels))])
    g = d.groupBy(*[qc(k) for k in keys], "chunk").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("phase").alias("phase"), F.max("phase").alias("phase_high"))
    bad = F.when(F.col("phase") != F.col("phase_high"), F.raise_error(F.lit("rows off the series' grid; align them first (align_to_grid)")).cast("boolean"))
    twice = F.when(F.size(F.array_distinct("rows.p")) != F.size("rows"), F.raise_error(
        F.lit("two rows with the same key and timestamp; de-duplicate them first (prepare does)")).cast("boolean"))
    g = g.where(F.coalesce(bad, twice, F.lit(True)))
    v = F.array(*[F.col(f"rows.v{i}") for i in range(len(channels))])
    return g.select(*[qc(k) for k in keys], "chunk", "phase", F.lit(steps).alias("steps"), F.col("rows.p").alias("pos"), v.alias("v"))


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> str:
    chunks.write.mode(mode).parquet(path)
    return path


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Piece:
    """A chunk as arrays over its steps, halo included: values (channels x steps, 0 where there is none) and the valid anchors."""

    def __init__(self, pos, v, steps: int, spec: WindowSpec, targets: list[int]):
        size = spec.span + steps
        self.spec = spec
        at = np.asarray(pos, np.int64)
        self.v = np.zeros((len(v), size))
        there = np.zeros((len(v), size), bool)
        for c, values in enumerate(v):
            known = values.is_valid().to_numpy(zero_copy_only=False)
            there[c, at[known]] = True
            self.v[c, at[known]] = values.drop_null().to_numpy(zero_copy_only=False)
        x = np.concatenate([[0], np.cumsum(there.all(axis=0))])
        y = np.concatenate([[0], np.cumsum(there[targets].all(axis=0))])
        a = np.arange(spec.span, size)
        full = (x[a - spec.offset + 1] - x[a - spec.span] == spec.lag) & (y[a + 1] - y[a - spec.ahead + 1] == spec.ahead)
        self.anchors = a[full]

    def inputs(self, anchors: np.ndarray) -> np.ndarray:
        """(windows, lag, channels), oldest step first."""
        view = np.lib.stride_tricks.sliding_window_view(self.v, self.spec.lag, axis=1)
        return view[:, anchors - self.spec.span].transpose(1, 2, 0)

    def labels(self, anchors: np.ndarray, targets: list[int]) -> np.ndarray:
        """(windows, ahead, targets), oldest first."""
        view = np.lib.stride_tricks.sliding_window_view(self.v[targets], self.spec.ahead, axis=1)
        return view[:, anchors - self.spec.ahead + 1].transpose(1, 2, 0)


def pieces(b: pa.RecordBatch, spec: WindowSpec, targets: list[int]) -> Iterator[tuple[int, Piece]]:
    pos, v, steps = (b.column(b.schema.get_field_index(n)) for n in ("pos", "v", "steps"))
    for i in range(b.num_rows):
        yield i, Piece(pos[i].values.to_numpy(), [v[i].values[c].values for c in range(len(v[i]))], steps[i].as_py(), spec, targets)


def target_places(channels, targets) -> list[int]:
    names = list(unique([*channels, *targets]))
    return [names.index(t) for t in unique(targets)]


def with_split(chunks: DataFrame, key, channels, targets, spec: WindowSpec) -> DataFrame:
    """``chunks`` of accepted series with ``base`` (windows of the series before the chunk) and ``n`` (windows of the series), from which a
    consumer knows the split of each window (as ``chrono_split``). One pass counts the windows of each chunk; the
    prefix sums run over one row per chunk."""
    keys, places = as_keys(key), target_places(channels, targets)
    kinds = [chunks.schema[k] for k in keys]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], T.StructField("chunk", T.LongType()), T.StructField("windows", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(p.anchors) for _, p in pieces(b, spec, places)], pa.int64())
            front = [b.column(b.schema.get_field_index(c)) for c in (*keys, "chunk")]
            yield pa.RecordBatch.from_arrays([*front, n], names=[*keys, "chunk", "windows"])

    counts = materialize(chunks.mapInArrow(count, schema), "chunk-counts")
    per = Window.partitionBy(*[qc(k) for k in keys])
    before = per.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    places_ = counts.select(*[qc(k) for k in keys], "chunk", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("base"), F.sum("windows").over(per).alias("n"))
    r = [*spec.ratios, 0.0, 0.0][:3]
    tr, va = split_indices(F.col("n"), r)
    whole = F.col("n") > 0
    train, val = F.least(tr, F.col("n")), F.greatest(F.least(va, F.col("n")) - tr, F.lit(0))
    test = F.col("n") - F.least(F.greatest(tr, va), F.col("n"))
    accepted = whole & (train > 0) & ((val > 0) | F.lit(r[1] == 0)) & ((test > 0) | F.lit(r[2] == 0))
    places_ = places_.withColumn("tr", tr).withColumn("va", va).where(accepted)
    return chunks.join(places_, [*keys, "chunk"])


def split_parts(p: Piece, base: int, tr: int, va: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(split, anchors, row numbers) of a chunk's windows."""
    rn = base + np.arange(len(p.anchors))
    code = np.where(rn < tr, 0, np.where(rn < va, 1, 2))
    return [(name, p.anchors[code == k], rn[code == k]) for k, name in enumerate(("train", "val", "test")) if (code == k).any()]


def cut_windows(chunks: DataFrame, key, ts: str, channels, targets, spec: WindowSpec) -> DataFrame:
    """Window rows [*keys, ts, tus, x, y, rn, n, split] of ``with_split`` chunks, as ``make_windows`` and ``chrono_split`` give them."""
    keys, places = as_keys(key), target_places(channels, targets)
    many = len(unique([*channels, *targets])) > 1
    kinds = [T.StructField(k, chunks.schema[k].dataType) for k in keys]
    value = T.ArrayType(T.ArrayType(T.DoubleType())) if many else T.ArrayType(T.DoubleType())
    rest = [("tus", T.LongType()), ("x", value), ("y", T.ArrayType(T.DoubleType())), ("rn", T.LongType()), ("n", T.LongType()), ("split", T.StringType())]
    schema = T.StructType([*kinds, *[T.StructField(n, t) for n, t in rest]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i, p in pieces(b, spec, places):
                start = col["chunk"][i].as_py() * col["steps"][i].as_py() - spec.span
                for split, a, rn in split_parts(p, col["base"][i].as_py(), col["tr"][i].as_py(), col["va"][i].as_py()):
                    x, y = p.inputs(a), p.labels(a, places)
                    flat = pa.array(np.ascontiguousarray(x).ravel())
                    steps = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, x.shape[2], dtype=np.int32), flat) if many else flat
                    xs = pa.ListArray.from_arrays(np.arange(0, len(a) * spec.lag + 1, spec.lag, dtype=np.int32), steps)
                    ys = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1] * y.shape[2], dtype=np.int32), pa.array(np.ascontiguousarray(y).ravel()))
                    front = [pa.array([col[k][i].as_py()] * len(a), col[k].type) for k in keys]
                    tus = (start + a) * (spec.minutes * MINUTE) + col["phase"][i].as_py()
                    yield pa.RecordBatch.from_arrays([*front, pa.array(tus, pa.int64()), xs, ys, pa.array(rn, pa.int64()),
                                                      pa.array(np.full(len(a), col["n"][i].as_py()), pa.int64()), pa.array([split] * len(a), pa.string())],
                                                     names=[*keys, "tus", "x", "y", "rn", "n", "split"])

    out = chunks.mapInArrow(run, schema)
    return out.select(*[qc(k) for k in keys], from_micro_index("tus").alias(ts), "tus", "x", "y", "rn", "n", "split")


class Shifts:
    """Sums of products of shifted series over runs of anchors: what ``lag_gram`` keeps per split while it reads chunks."""

    def __init__(self, channels: int, span: int):
        self.span, self.f = span, channels
        self.first = np.zeros((channels, span + 1, channels))    # unshifted channel x (shift, channel)
        self.sums = np.zeros((span + 1, channels))
        self.n = 0
        self.left, self.right = [], []                           # ends of runs, not yet multiplied
        self.edge = np.zeros((span * channels, span * channels))

    def add(self, v: np.ndarray, anchors: np.ndarray) -> None:
        span = self.span
        total = np.concatenate([np.zeros((self.f, 1)), np.cumsum(v, axis=1)], axis=1)
        back = np.arange(span)
        for run in np.split(anchors, np.flatnonzero(np.diff(anchors) != 1) + 1):
            s, e = int(run[0]), int(run[-1])
            for c in range(self.f):
                for d in range(self.f):
                    self.first[c, :, d] += np.correlate(v[d, s - span:e + 1], v[c, s:e + 1], "valid")[::-1]
            shift = np.arange(span + 1)
            self.sums += (total[:, e - shift + 1] - total[:, s - shift]).T
            self.n += e - s + 1
            self.left.append(v[:, s - 1 - back].T.ravel())
            self.right.append(v[:, e - back].T.ravel())
        if len(self.left) >= 256:
            self.settle()

    def settle(self) -> None:
        if self.left and self.span:
            left, right = np.vstack(self.left), np.vstack(self.right)
            self.edge += left.T @ left - right.T @ right
        self.left, self.right = [], []

    def matrix(self, inputs: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Gram of z = [inputs, 1, labels]; both are numbers shift * channels + channel."""
        self.settle()
        f, w = self.f, self.span + 1
        g = np.zeros((w, f, w, f))
        g[0] = self.first
        edge = self.edge.reshape(self.span, f, self.span, f)
        for a in range(self.span):
            g[a + 1, :, 1:] = g[a, :, :-1] + edge[a]
            g[a + 1, :, 0] = self.first[:, a + 1].T
        g, sums = g.reshape(w * f, w * f), self.sums.ravel()
        at = np.concatenate([inputs, labels])
        p = len(inputs)
        out = np.empty((len(at) + 1, len(at) + 1))
        keep = np.delete(np.arange(len(at) + 1), p)
        out[np.ix_(keep, keep)] = g[np.ix_(at, at)]
        out[p, keep] = out[keep, p] = sums[at]
        out[p, p] = self.n
        return out


def lag_gram(chunks: DataFrame, channels, targets, spec: WindowSpec, fan: int = 64, splits=("train", "val")) -> DataFrame:
    """(grp, i, v) as ``moments.gram_rows`` over the windows of ``with_split`` chunks, without making the windows."""
    names, places = list(unique([*channels, *targets])), target_places(channels, targets)
    f = len(names)
    terms = spec.lag * f + 1 + spec.ahead * len(places)
    if max(terms, (spec.span + 1) * f) > MAX_TERMS:
        raise ValueError(f"a Gram matrix over {spec.span + 1} steps of {f} channels exceeds the bound of {MAX_TERMS} terms")
    inputs = np.array([(spec.span - t) * f + c for t in range(spec.lag) for c in range(f)], np.int64)
    labels = np.array([(spec.ahead - 1 - h) * f + c for h in range(spec.ahead) for c in places], np.int64)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        acc: dict[str, Shifts] = {}
        for b in batches:
            base, tr, va = (b.column(b.schema.get_field_index(n)) for n in ("base", "tr", "va"))
            for i, p in pieces(b, spec, places):
                for split, a, _ in split_parts(p, base[i].as_py(), tr[i].as_py(), va[i].as_py()):
                    if split in splits:
                        acc.setdefault(split, Shifts(f, spec.span)).add(p.v, a)
        for split, shifts in acc.items():
            yield from part_rows(split, shifts.matrix(inputs, labels), TaskContext.get().partitionId() % fan)

    return added_rows(chunks, fold, terms)


def predict_chunks(chunks: DataFrame, coef: DataFrame, key, ts: str, channels, targets, spec: WindowSpec, split: str = "test") -> DataFrame:
    """[*keys, ts, y, yhat] of a split's windows: one matrix product per chunk, cut from it where it lies."""
    from laglake.operators.forecast import coefficient_matrix
    keys, places = as_keys(key), target_places(channels, targets)
    weights = coefficient_matrix(coef)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[T.StructField(k, chunks.schema[k].dataType) for k in keys], T.StructField("tus", T.LongType()), T.StructField("y", numbers), T.StructField("yhat", numbers)])

    def lists(values: np.ndarray) -> pa.Array:
        flat = np.ascontiguousarray(values, np.float64)
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i, p in pieces(b, spec, places):
                start = col["chunk"][i].as_py() * col["steps"][i].as_py() - spec.span
                for name, a, _ in split_parts(p, col["base"][i].as_py(), col["tr"][i].as_py(), col["va"][i].as_py()):
                    if name == split:
                        x = p.inputs(a).reshape(len(a), -1)
                        tus = (start + a) * (spec.minutes * MINUTE) + col["phase"][i].as_py()
                        front = [pa.array([col[k][i].as_py()] * len(a), col[k].type) for k in keys]
                        yield pa.RecordBatch.from_arrays([*front, pa.array(tus, pa.int64()), lists(p.labels(a, places).reshape(len(a), -1)), lists(x @ weights[:-1] + weights[-1])],
                                                         names=[*keys, "tus", "y", "yhat"])

    out = chunks.mapInArrow(run, schema)
    return out.select(*[qc(k) for k in keys], from_micro_index("tus").alias(ts), "y", "yhat")
