"""Linear models without a Gram matrix, for more terms than one can hold (``moments.MAX_TERMS``): conjugate gradients on the centred
and scaled normal equations.

A step needs X'(X d) for one direction d per horizon and ridge strength. That is one pass over the chunked series: windows are cut from a chunk
some at a time and multiplied where they lie, and a task gives back vectors of (inputs x horizons x strengths) numbers, which are added in
two steps. Only such vectors reach the driver or a task (at most ``MAX_NUMBERS``, checked before any job); memory doesn't grow with the square of the lag.
All strengths and horizons go through the same passes, and a pass gives the validation error of the weights it starts from as well,
so a fit can stop where that error stops falling (``patience``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from laglake.operators.chunks import pieces, split_parts, target_places
from laglake.operators.forecast import CONSTANT
from laglake.operators.moments import added_rows
from laglake.session import materialize
from laglake.spec import WindowSpec, unique

#: Bound of inputs x horizons x strengths: two such matrices of 64 MB go to every worker.
MAX_NUMBERS = 1 << 23
BAND = 4096          # numbers in a row of a task's vector
BLOCK = 1 << 22      # numbers of windows cut at a time
KINDS = ("linear", "nlinear")


class Pass:
    """Sums over the windows of ``with_split`` chunks, one job each."""

    def __init__(self, chunks: DataFrame, channels, targets, spec: WindowSpec, kind: str, fan: int = 64):
        self.chunks, self.spec, self.kind, self.fan = chunks, spec, kind, fan
        self.places, self.f = target_places(channels, targets), len(unique([*channels, *targets]))
        self.inputs, self.labels = spec.lag * self.f, spec.ahead * len(self.places)

    def run(self, fns: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], size: int) -> dict[str, np.ndarray]:
        """Per split, the sum of its function's vectors over blocks of windows (inputs, labels); at most ``size`` numbers."""
        spec, places, p, nlinear, fan = self.spec, self.places, self.inputs, self.kind == "nlinear", self.fan

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            acc: dict[str, np.ndarray] = {}
            many = max(1, BLOCK // p)
            for b in batches:
                base, tr, va = (b.column(b.schema.get_field_index(n)) for n in ("base", "tr", "va"))
                for i, piece in pieces(b, spec, places):
                    for split, anchors, _ in split_parts(piece, base[i].as_py(), tr[i].as_py(), va[i].as_py()):
                        for at in range(0, len(anchors) if split in fns else 0, many):
                            some = anchors[at:at + many]
                            x, y = piece.inputs(some), piece.labels(some, places).reshape(len(some), -1)
                            if nlinear:
                                y = y - x[:, -1, -1:]
                                x = x - x[:, -1:, :]
                            v = fns[split](x.reshape(len(some), p), y)
                            acc[split] = acc[split] + v if split in acc else v
            part = TaskContext.get().partitionId() % fan
            for split, v in acc.items():
                for first in range(0, len(v), 64 * BAND):
                    rows = [v[k:k + BAND] for k in range(first, min(first + 64 * BAND, len(v)), BAND)]
                    i = np.arange(first // BAND, first // BAND + len(rows))
                    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([split] * len(rows)), pa.array(i, pa.int32()), pa.array(np.full(len(rows), part), pa.int32()),
                                                      pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))], names=["grp", "i", "part", "v"])

        found: dict[str, list] = {}
        for r in sorted(added_rows(self.chunks, fold, size).collect(), key=lambda r: r["i"]):
            found.setdefault(r["grp"], []).append(r["v"])
        return {split: np.concatenate(rows) for split, rows in found.items()}


def fit_iterative(chunks: DataFrame, channels, targets, spec: WindowSpec, kind: str = "linear", lambdas=(0.0,), tolerance: float = 1e-9,
                  most: int = 1000, patience: int | None = None) -> dict | None:
    """As ``forecast.fit`` (kinds ``linear`` and ``nlinear``) from ``with_split`` chunks, for any number of terms: the strength with
    the least validation error. See ``iterative_path``."""
    path = iterative_path(chunks, channels, targets, spec, kind, lambdas, tolerance, most, patience)
    if len(path) > 1 and np.isnan(path[0]["val_mse"]):
        raise ValueError("no validation windows to choose among several lambdas; pass a single one")
    return min(path, key=lambda m: m["val_mse"]) if path else None


def iterative_path(chunks: DataFrame, channels, targets, spec: WindowSpec, kind: str = "linear", lambdas=(0.0,), tolerance: float = 1e-9,
                   most: int = 1000, patience: int | None = None) -> list[dict]:
    """Weights on [vec(x), 1], validation error, passes and the largest relative residual for every ridge strength, all from the same passes. A
    column (horizon and strength) is done once its residual is at most ``tolerance`` times the right side's length; if ``most`` passes don't get
    every column there, this raises. With ``patience``, a strength is also done once its validation error hasn't fallen for so many
    passes, and its weights are those with the least error. An input that is the same in every window gets weight 0.
    Without training windows the list is empty; values that aren't finite raise."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    run = Pass(chunks, channels, targets, spec, kind)
    p, a, k = run.inputs, run.labels, len(lambdas)
    if p * a * k > MAX_NUMBERS:
        raise ValueError(f"{p} inputs x {a} labels x {k} strengths exceed the bound of {MAX_NUMBERS} numbers")
    run.chunks = materialize(chunks, "fit-chunks")

    def first(x, y):
        return np.concatenate([x.sum(axis=0), y.sum(axis=0), [len(x)]])

    found = run.run({"train": first, "val": first}, p + a + 1)
    if "train" not in found:
        return []
    for split, v in found.items():
        if not np.isfinite(v).all():
            raise ValueError(f"values that aren't finite numbers in the {split} windows, at terms {np.flatnonzero(~np.isfinite(v))[:8].tolist()} of [inputs, labels]")
    n = found["train"][-1]
    n_val = found["val"][-1] if "val" in found else 0.0
    if patience is not None and not n_val:
        raise ValueError("no validation windows to stop by")
    mx, my = found["train"][:p] / n, found["train"][p:p + a] / n

    def second(x, y):
        x, y = x - mx, y - my
        return np.concatenate([np.einsum("ij,ij->j", x, x), (x.T @ y).ravel()])

    second_sums = run.run({"train": second}, p + p * a)["train"]
    squares, xy = second_sums[:p], second_sums[p:].reshape(p, a)
    strength = np.repeat(np.asarray(lambdas, float), a)                     # per column: strengths, then horizons
    varies = squares > CONSTANT * (squares + n * mx * mx)
    scale = np.where(varies[:, None], np.sqrt(np.where(varies, squares, 1.0)[:, None] + strength), np.inf)
    right = np.tile(xy, (1, k)) / scale
    size = np.linalg.norm(right, axis=0)
    u, r = np.zeros_like(right), right.copy()
    d, rr = r.copy(), size ** 2
    best, best_mse, since = np.zeros_like(u), np.full(k, np.inf), np.zeros(k, int)
    stopped, passes = np.zeros(k, bool), 2

    def val_errors(w):
        def fn(x, y):
            e = np.tile(y - my, (1, k)) - (x - mx) @ w
            return np.einsum("ij,ij->j", e, e)
        return fn

    def by_strength(sums):
        return sums.reshape(k, a).sum(axis=1) / max(n_val * a, 1.0)

    while True:
        open_ = (np.sqrt(rr) > tolerance * size) & ~np.repeat(stopped, a)
        if not open_.any():
            break
        if passes >= most:
            raise RuntimeError(f"residuals of {float((np.sqrt(rr) / np.maximum(size, 1e-300)).max()):.1e} after {passes} passes; try a larger lambda or more passes")
        step = np.where(open_, d / scale, 0.0)

        def product(x, y, step=step):
            x = x - mx
            return (x.T @ (x @ step)).ravel()

        fns = {"train": product}
        if patience is not None:
            fns["val"] = val_errors(u / scale)
        sums = run.run(fns, p * a * k)
        passes += 1
        if patience is not None:
            mse = by_strength(sums["val"])
            better = (mse < best_mse) & ~stopped
            columns = np.repeat(better, a)
            best[:, columns], best_mse = u[:, columns], np.where(better, mse, best_mse)
            since = np.where(better, 0, since + 1)
            stopped |= since >= patience
        q = (sums["train"].reshape(p, -1) + strength * step) / scale
        dq = np.einsum("ij,ij->j", d, q)
        alpha = np.where(open_ & (dq > 0), rr / np.where(dq > 0, dq, 1.0), 0.0)
        u += alpha * d
        r -= alpha * q
        new = np.einsum("ij,ij->j", r, r)
        d = np.where(open_, r + np.where(rr > 0, new / np.where(rr > 0, rr, 1.0), 0.0) * d, d)
        rr = np.where(open_, new, rr)
    w = u / scale
    mse = by_strength(run.run({"val": val_errors(w)}, a * k)["val"]) if n_val else np.full(k, np.nan)
    if patience is not None:
        worse = np.repeat(best_mse < mse, a)
        w[:, worse], mse = (best / scale)[:, worse], np.minimum(mse, best_mse)
    out = []
    for at, lam in enumerate(lambdas):
        cols = slice(at * a, (at + 1) * a)
        some = w[:, cols]
        weights = np.vstack([some, my - mx @ some])
        if kind == "nlinear":   # y - last = some (x - last): the last step of each channel takes what its steps gave, the last channel's is carried
            last = np.arange(p - run.f, p)
            weights[last] -= some.reshape(spec.lag, run.f, a).sum(axis=0)
            weights[p - 1] += 1.0
        out.append({"kind": kind, "lambda": lam, "weights": weights, "val_mse": float(mse[at]), "n_train": n, "passes": passes,
                    "residual": float((np.sqrt(rr[cols]) / np.maximum(size[cols], 1e-300)).max())})
    return out
