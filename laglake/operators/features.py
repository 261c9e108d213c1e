"""Window feature maps that need a matrix product per row: Time2Vec with many periodic
features followed by reversible instance normalisation. Vectorised per Arrow batch with numpy
inside ``mapInPandas`` (weights are small and shipped with the closure)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from laglake.functions.sequence import REVIN_EPS


def time2vec_weights(L: int, k: int, seed: int = 941, lo: float = -0.05, hi: float = 0.05, channels: int = 1) -> dict:
    """Seeded uniform weights: wa (k, or channels x k), ba (L x k), wb (L), bb (L)."""
    rng = np.random.default_rng(seed)
    wa = rng.uniform(lo, hi, k if channels == 1 else (channels, k))
    return {"wa": wa, "ba": rng.uniform(lo, hi, (L, k)), "wb": rng.uniform(lo, hi, L), "bb": rng.uniform(lo, hi, L)}


def t2v_features(X: np.ndarray, weights: dict) -> np.ndarray:
    """n x L x (k + channels) Time2Vec features of n x L x channels windows: k periodic ones of a projection of all channels,
    then one linear one per channel."""
    wa = np.asarray(weights["wa"], float)
    wa = wa[None, :] if wa.ndim == 1 else wa
    ba, wb, bb = (np.asarray(weights[n], float) for n in ("ba", "wb", "bb"))
    return np.concatenate([np.sin(X @ wa + ba[None]), wb[None, :, None] * X + bb[None, :, None]], axis=2)


def t2v_revin_frame(windows: DataFrame, weights: dict, keep=("segment", "ts", "split"), normalised: bool = True) -> DataFrame:
    """Time2Vec features with reversible instance normalisation over a window's steps.

    ``normalised``: ``xf`` = flattened normalised features (L x (k + channels), step-major), ``yn`` = labels normalised by the
    raw (last channel's) window mean / std, and those ``mean``, ``std``. Otherwise ``x`` = the centred features followed
    by their std and mean, ((L + 2) x (k + channels), step-major), and ``y``: what the shared ``t2v`` model reads, since
    normalising, a linear map over steps and denormalising is linear in these."""
    keep = [c for c in keep if c in windows.columns]
    arrays = ["y", "xf", "yn"] if normalised else ["x", "y"]
    out = T.StructType(list(windows.select(*keep).schema.fields) + [T.StructField(a, T.ArrayType(T.DoubleType())) for a in arrays]
                       + ([T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())] if normalised else []))
    multi = isinstance(windows.schema["x"].dataType.elementType, T.ArrayType)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            if multi:
                X = np.stack([np.vstack(w) for w in pdf["x"]]).astype(np.float64)
            else:
                X = np.vstack(pdf["x"].to_numpy()).astype(np.float64)[:, :, None]   # n x L x channels
            Y = np.vstack(pdf["y"].to_numpy()).astype(np.float64)                   # n x A
            f = t2v_features(X, weights)
            mu = f.mean(axis=1, keepdims=True)
            sd = np.sqrt(f.var(axis=1, keepdims=True) + REVIN_EPS)
            res = pdf[keep].copy()
            res["y"] = list(Y)
            if normalised:
                own = X[:, :, -1]
                m, s = own.mean(axis=1), np.sqrt(own.var(axis=1) + REVIN_EPS)
                res["xf"] = list(((f - mu) / sd).reshape(len(pdf), -1))
                res["yn"] = list((Y - m[:, None]) / s[:, None])
                res["mean"], res["std"] = m, s
            else:
                res["x"] = list(np.concatenate([f - mu, sd, mu], axis=1).reshape(len(pdf), -1))
            yield res[[c.name for c in out]]

    return windows.select(*keep, "x", "y").mapInPandas(run, out)
