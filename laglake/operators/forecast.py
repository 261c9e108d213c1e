"""Linear forecasters fitted from Gram matrices (closed form, ridge), model selection on the
validation Gram, prediction with broadcast coefficients, and a coefficient store.

Models (all are linear in z = [vec(x), 1, y], so each is a fixed change of basis M applied to
the one Gram matrix: S' = M S M^T):
  linear   y_h = w_h . x + b_h
  nlinear  y_h - x_last = w_h . (x - x_last) + b_h            (last-value normalisation)
  dlinear  y_h = ws_h . seasonal(x) + wt_h . trend(x) + b_h    (moving-average decomposition)
Every model collapses to effective weights on the raw window, so prediction is one dot product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.functions.sequence import decomposition_kernel
from laglake.operators.moments import gram_matrices, gram_rows

KINDS = ("linear", "nlinear", "dlinear")
SHARED_KINDS = ("linear_shared", "nlinear_shared", "dlinear_shared", "t2v_shared")
SHARED = SHARED_KINDS[0]
#: An input whose variance is below this share of its mean square is the same in every window (rounding apart).
CONSTANT = 1e-13


def ma_matrix(L: int, k: int) -> np.ndarray:
    """L x L matrix of the edge-padded moving average (odd k keeps the length)."""
    p = (k - 1) // 2
    K = np.zeros((L, L))
    for t in range(L):
        for s in range(t - p, t - p + k):
            K[t, min(max(s, 0), L - 1)] += 1.0 / k
    return K


def basis(kind: str, L: int, F_: int, A: int, last_channel: int | None = None) -> np.ndarray:
    """Matrix M with z' = M z; z = [vec(x) (L*F, step-major), 1, y (A)]."""
    P = L * F_
    n = P + 1 + A
    if kind == "linear":
        return np.eye(n)
    if kind == "nlinear":
        M = np.eye(n)
        for t in range(L):
            for c in range(F_):
                M[t * F_ + c, (L - 1) * F_ + c] -= 1.0
        lc = F_ - 1 if last_channel is None else last_channel
        for h in range(A):
            M[P + 1 + h, (L - 1) * F_ + lc] -= 1.0
        return M
    if kind == "dlinear":
        K = ma_matrix(L, decomposition_kernel(L))
        I = np.eye(L)
        Mx = np.zeros((2 * P, P))
        for c in range(F_):
            idx = np.arange(L) * F_ + c
            Mx[np.ix_(idx, idx)] = I - K            # seasonal block
            Mx[np.ix_(P + idx, idx)] = K            # trend block
        M = np.zeros((2 * P + 1 + A, n))
        M[:2 * P, :P] = Mx
        M[2 * P, P] = 1.0
        M[2 * P + 1:, P + 1:] = np.eye(A)
        return M
    raise ValueError(f"kind must be one of {KINDS}")


def solve(S: np.ndarray, n_feat: int, lam: float) -> np.ndarray:
    """Ridge solution W ((n_feat+1) x A) of the transformed Gram; the intercept is not penalised. Inputs and labels are
    centred from the Gram's own sums first, and inputs are brought to one scale, which leaves the solution alone but not the raw
    levels and units in the condition number. An input that is the same in every window gets weight 0."""
    p, n = n_feat + 1, S[n_feat, n_feat]
    if n <= 0:
        return np.zeros((p, S.shape[0] - p))
    mx, my = S[:n_feat, n_feat] / n, S[n_feat, p:] / n
    A_ = S[:n_feat, :n_feat] - n * np.outer(mx, mx)
    B_ = S[:n_feat, p:] - n * np.outer(mx, my)
    varies = np.diagonal(A_) > CONSTANT * np.diagonal(S)[:n_feat]
    A_[np.arange(n_feat), np.arange(n_feat)] += lam
    W = np.zeros((n_feat, S.shape[0] - p))
    if varies.any():
        scale = np.sqrt(np.diagonal(A_)[varies])
        some = A_[np.ix_(varies, varies)] / np.outer(scale, scale)
        W[varies] = np.linalg.lstsq(some, B_[varies] / scale[:, None], rcond=None)[0] / scale[:, None]
    return np.vstack([W, my - mx @ W])


def effective(kind: str, W: np.ndarray, L: int, F_: int, A: int, last_channel: int | None = None) -> np.ndarray:
    """Collapse a fitted model into weights on [vec(x), 1] (rows) per horizon (columns)."""
    P = L * F_
    M = basis(kind, L, F_, A, last_channel)
    p = W.shape[0]
    # y'_h = W^T (M_x z)  and  y_h = y'_h - (M_y z - y)_h  => y_h = (W^T M_x - (M_y - [0 I])) z restricted to x,1
    Mx, My = M[:p, :P + 1], M[p:, :P + 1]
    return (W.T @ Mx - My).T


def val_mse(Sv: np.ndarray, Weff: np.ndarray, n_val: float, A: int) -> float:
    """Mean squared error on the validation windows from their Gram alone: tr(B^T S B)/(n*A)."""
    B = np.vstack([Weff, -np.eye(A)])
    return float(np.trace(B.T @ Sv @ B) / max(n_val * A, 1.0))


def split_grams(split_windows: DataFrame, n_terms: int | None = None) -> dict:
    """One data pass: train and val Gram matrices of the split windows (test windows aren't needed to fit);
    ``n_terms`` = L*F + 1 + A is checked against the bound before the job."""
    return gram_matrices(gram_rows(split_windows.where(F.col("split").isin("train", "val")), "split", n_terms=n_terms))


def fit(split_windows: DataFrame | None = None, kind: str = "linear", lambdas=(0.0,), L: int | None = None, F_: int = 1,
        A: int | None = None, last_channel: int | None = None, mats: dict | None = None) -> dict:
    """Fit ``kind`` (linear, nlinear, dlinear, or one of ``SHARED_KINDS``) on the train Gram for every lambda, pick the lambda with the lowest validation
    MSE (from the val Gram, no further data pass). Pass ``mats`` (``split_grams``) to fit several
    model kinds from the same pass. Returns a dict with weights and diagnostics."""
    if mats is None:
        n_terms = (L * F_ + 1 + A) if (L and A and kind != "t2v_shared") else None
        mats = split_grams(split_windows, n_terms)
    if "train" not in mats:
        return None   # no training window
    P = mats["train"].shape[0] - 1 - A
    L = L or P // F_
    if len(lambdas) > 1 and not ("val" in mats and mats["val"][P, P] > 0):
        raise ValueError("no validation windows to choose among several lambdas; pass a single one")
    best = None
    for cand in ridge_path(mats, kind, lambdas, L, F_, A, last_channel):
        if best is None or cand["val_mse"] < best["val_mse"]:
            best = cand
    return best


def ridge_path(mats: dict, kind: str, lambdas, L: int, F_: int, A: int, last_channel: int | None = None) -> list:
    """Weights and validation MSE for every lambda, all from the train / val Gram matrices."""
    S = mats["train"]
    P = L * F_
    if kind in SHARED_KINDS:
        out = []
        P = S.shape[0] - 1 - A
        for lam in lambdas:
            Weff = fit_shared(S, L, F_, A, lam, kind.removesuffix("_shared"))
            mse = val_mse(mats["val"], Weff, mats["val"][P, P], A) if "val" in mats else float("nan")
            out.append({"kind": kind, "lambda": lam, "weights": Weff, "val_mse": mse, "n_train": S[P, P]})
        return out
    M = basis(kind, L, F_, A, last_channel)
    St = M @ S @ M.T
    n_feat = M.shape[0] - 1 - A
    out = []
    for lam in lambdas:
        lam_eff = lam if (kind != "dlinear" or lam > 0) else 1e-8 * max(1.0, float(np.trace(St[:n_feat, :n_feat])) / n_feat)
        W = solve(St, n_feat, lam_eff)
        Weff = effective(kind, W, L, F_, A, last_channel)
        mse = val_mse(mats["val"], Weff, mats["val"][P, P], A) if "val" in mats else float("nan")
        out.append({"kind": kind, "lambda": lam, "weights": Weff, "val_mse": mse, "n_train": S[P, P]})
    return out


def sub_gram(S: np.ndarray, keep: list[int], L: int, F_: int) -> np.ndarray:
    """The Gram matrix of windows that have only the channels ``keep`` of F."""
    P = L * F_
    at = [t * F_ + c for t in range(L) for c in keep]
    at += range(P, len(S))
    return S[np.ix_(at, at)]


def fit_combinations(mats: dict, features, targets, k: int, L: int, A: int, kind: str = "linear", lambdas=(0.0,)) -> dict[tuple, dict]:
    """A model for every k of the features (with the targets, which are the last channels), all from the Gram matrices of the
    windows with all channels: each is solved from its own rows and columns, so no series is expanded and no data are read again.
    Returns the chosen members -> the result of ``fit``; its weights are on [vec(x), 1] of members and targets."""
    from itertools import combinations
    features, targets = list(features), list(targets)
    own = [len(features) + i for i in range(len(targets))]
    F_, out = len(features) + len(targets), {}
    for chosen in combinations(range(len(features)), k):
        keep = [*chosen, *own]
        some = {split: sub_gram(S, keep, L, F_) for split, S in mats.items()}
        out[tuple(features[c] for c in chosen)] = fit(kind=kind, lambdas=lambdas, L=L, F_=len(keep), A=A, mats=some)
    return out


def coefficient_table(spark: SparkSession, model: str, Weff: np.ndarray, version: int = 1) -> DataFrame:
    """(model, version, h, term, coef) rows; term = position in [vec(x), 1] (last = intercept)."""
    rows = [(model, version, int(h), int(t), float(Weff[t, h])) for h in range(Weff.shape[1]) for t in range(Weff.shape[0])]
    return spark.createDataFrame(rows, "model string, version int, h int, term int, coef double")


def save_model(coef: DataFrame, path: str) -> None:
    """Store a coefficient table. A version of a model that is saved again is replaced; others stay."""
    coef.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "version").parquet(path)


def load_model(spark: SparkSession, path: str, model: str, version: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("model") == model)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == version)


def coefficient_matrix(coef: DataFrame) -> np.ndarray:
    """Weights on [vec(x), 1] (rows) per horizon (columns) of one model's coefficient table."""
    rows = coef.select("h", "term", "coef").collect()
    if not rows:
        raise ValueError("the coefficient table is empty")
    W = np.zeros((max(r["term"] for r in rows) + 1, max(r["h"] for r in rows) + 1))
    for r in rows:
        W[r["term"], r["h"]] = r["coef"]
    return W


def predict(windows: DataFrame, coef: DataFrame, x: str = "x") -> DataFrame:
    """Append ``yhat`` (array, one value per horizon) = W_h . [vec(x), 1]. The coefficients (a model's, bounded by
    ``MAX_TERMS`` per horizon) go to the tasks as one matrix, and a batch of windows is one matrix product."""
    W = coefficient_matrix(coef)
    multi = str(windows.schema[x].dataType).startswith("ArrayType(ArrayType")

    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        if not len(arrays):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.vstack(arrays.to_numpy()).astype(np.float64) @ W[:-1] + W[-1]), dtype=object)

    return windows.withColumn("yhat", run(F.flatten(F.col(x)) if multi else F.col(x)))


def channel_map(kind: str, L: int) -> tuple[np.ndarray, np.ndarray]:
    """(D, carry) of a shared-weight model: a channel's window x gives the features D x, and carry x is added to the output
    as it is. ``t2v`` reads L steps of centred features followed by their std and mean per channel (see
    ``features.t2v_revin_frame``): the decomposition sees the steps, the std carries the layer's bias through the
    denormalisation, the mean is added back."""
    I = np.eye(L)
    if kind == "linear":
        return I, np.zeros(L)
    if kind == "nlinear":
        last = np.zeros(L)
        last[-1] = 1.0
        return I - np.outer(np.ones(L), last), last
    K = ma_matrix(L, decomposition_kernel(L))
    both = np.vstack([I - K, K])
    if kind == "dlinear":
        return both, np.zeros(L)
    if kind == "t2v":
        D = np.zeros((2 * L + 1, L + 2))
        D[:2 * L, :L] = both
        D[2 * L, L] = 1.0
        carry = np.zeros(L + 2)
        carry[L + 1] = 1.0
        return D, carry
    raise ValueError(f"no shared form of {kind!r}")


def fit_shared(S: np.ndarray, L: int, F_: int, A: int, lam: float = 0.0, kind: str = "linear", warm: int = 20, most: int = 500,
               bound: float = 1e-4) -> np.ndarray:
    """Shared-weight model for F channels: y_h = sum_c v_c (w_h . D x_c + carry . x_c) + beta_h, one set of time weights for
    every channel, then a channel mix; the ridge term is lam |w|^2 F |v|^2, which doesn't depend on how a factor is shared between
    w and v. Some rounds of alternating least squares start it; then damped Newton steps on all weights at once, whose gradient and
    Hessian come from the one Gram matrix S, until the scaled gradient (the largest cosine between the residuals and what one weight can
    change) is at most ``bound``, or the sum of squares is rounding only. Raises if ``most`` steps don't get there; a ridge term helps where inputs are nearly collinear. Returns effective weights on [vec(x), 1] like ``effective``."""
    m = _Shared(S, L, F_, A, lam, kind)
    W, v, beta = m.started(warm)
    best, mu = m.objective(W, v, beta), 1e-4
    for _ in range(most):
        g, H = m.normal(W, v, beta)
        scale = np.sqrt(np.maximum(np.diagonal(H), 1e-300))
        g, H = g / scale, H / np.outer(scale, scale)
        steepest = float(np.abs(g).max()) / max(best, 1e-300) ** 0.5
        if steepest <= bound or best <= m.rounding:
            return m.effective(W, v, beta)
        while True:
            step = np.linalg.solve(H + mu * np.eye(len(g)), -g) / scale
            new = m.moved(W, v, beta, step)
            value = m.objective(*new)
            if value < best:
                (W, v, beta), best, mu = new, value, max(mu / 5, 1e-12)
                break
            mu *= 4
            if mu > 1e12:   # no direction gains anything in floating point
                return m.effective(W, v, beta)
    raise RuntimeError(f"the shared {kind} fit has a scaled gradient of {steepest:.1e} after {most} steps; try a larger lambda")


class _Shared:
    """The bilinear least squares problem behind ``fit_shared``, in terms of the Gram matrix."""

    def __init__(self, S: np.ndarray, L: int, F_: int, A: int, lam: float, kind: str):
        self.D, self.carry = channel_map(kind, L)
        self.S, self.F, self.A, self.lam = S, F_, A, lam
        self.steps, self.p = self.D.shape[1], len(self.D)
        self.P = P = self.steps * F_
        self.xx = S[:P, :P].reshape(self.steps, F_, self.steps, F_)
        self.x1 = S[:P, P].reshape(self.steps, F_)
        self.rounding = 1e-13 * float(np.trace(S[P + 1:, P + 1:]))

    def rows(self, W: np.ndarray) -> np.ndarray:
        """Weights of each horizon on a channel's own steps (A x steps)."""
        return W.T @ self.D + self.carry

    def effective(self, W, v, beta) -> np.ndarray:
        return np.vstack([np.kron(self.rows(W).T, v[:, None]), beta])

    def residual(self, W, v, beta) -> np.ndarray:
        return np.vstack([self.effective(W, v, beta), -np.eye(self.A)])

    def objective(self, W, v, beta) -> float:
        r = self.residual(W, v, beta)
        return float(np.sum(r * (self.S @ r))) + self.lam * self.F * float(np.sum(W * W)) * float(v @ v)

    def moved(self, W, v, beta, step):
        k = self.p * self.A
        return W + step[:k].reshape(self.A, self.p).T, v + step[k:k + self.F], beta + step[k + self.F:]

    def normal(self, W, v, beta) -> tuple[np.ndarray, np.ndarray]:
        """Half the gradient and half the Hessian over (w_1, .., w_A, v, beta)."""
        p, F_, A, lam = self.p, self.F, self.A, self.lam * self.F
        k, rows = p * A, self.rows(W)
        Sr = self.S @ self.residual(W, v, beta)
        Srx = Sr[:self.P].reshape(self.steps, F_, A)
        one = np.einsum("tcsd,c->tsd", self.xx, v, optimize=True)
        both = self.D @ (one @ v) @ self.D.T + lam * (v @ v) * np.eye(p)
        H, g = np.zeros((k + F_ + A, k + F_ + A)), np.zeros(k + F_ + A)
        ones = self.D @ (self.x1 @ v)
        for h in range(A):
            at = slice(h * p, (h + 1) * p)
            H[at, at] = both
            H[at, k:k + F_] = self.D @ (np.einsum("tsd,s->td", one, rows[h]) + Srx[:, :, h]) + 2 * lam * np.outer(W[:, h], v)
            H[at, k + F_ + h] = ones
            H[k:k + F_, k:k + F_] += np.einsum("tcsd,t,s->cd", self.xx, rows[h], rows[h], optimize=True) + lam * (W[:, h] @ W[:, h]) * np.eye(F_)
            H[k:k + F_, k + F_ + h] = rows[h] @ self.x1
            H[k + F_ + h, k + F_ + h] = self.S[self.P, self.P]
            g[at] = self.D @ (Srx[:, :, h] @ v) + lam * (v @ v) * W[:, h]
            g[k:k + F_] += rows[h] @ Srx[:, :, h] + lam * (W[:, h] @ W[:, h]) * v
            g[k + F_ + h] = Sr[self.P, h]
        return g, np.triu(H) + np.triu(H, 1).T

    def started(self, rounds: int):
        """Alternating half-steps from equal channel weights: each is linear least squares."""
        p, F_, A = self.p, self.F, self.A
        M = np.zeros((p + 1 + A, self.steps + 1 + A))     # of the mixed series u = sum_c v_c x_c, 1 and y
        M[:p, :self.steps] = self.D
        M[p:, self.steps:] = np.eye(1 + A)
        M[p + 1:, :self.steps] = -self.carry
        S_x = self.S[:self.P, self.P:].reshape(self.steps, F_, 1 + A)
        S_y = self.S[self.P:, self.P:]
        v = np.ones(F_) / F_
        for _ in range(rounds):
            S_ux = np.einsum("tcs,c->ts", np.tensordot(self.xx, v, axes=(3, 0)), v)
            S_u = np.einsum("tcj,c->tj", S_x, v)
            W = solve(M @ np.block([[S_ux, S_u], [S_u.T, S_y]]) @ M.T, p, self.lam * F_ * float(v @ v))
            big, right = np.zeros((F_ + A, F_ + A)), np.zeros(F_ + A)
            for h, row in enumerate(self.rows(W[:p])):
                big[:F_, :F_] += np.tensordot(np.tensordot(row, self.xx, axes=(0, 0)), row, axes=(1, 0)) + self.lam * F_ * (W[:p, h] @ W[:p, h]) * np.eye(F_)
                g = np.tensordot(row, S_x, axes=(0, 0))
                big[:F_, F_ + h] = g[:, 0]
                right[:F_] += g[:, 1 + h]
                right[F_ + h] = S_y[0, 1 + h]
            big[F_:, :F_] = big[:F_, F_:].T
            big[F_:, F_:] = np.eye(A) * S_y[0, 0]
            sol = np.linalg.lstsq(big, right, rcond=None)[0]
            v, beta = sol[:F_], sol[F_:]
        return W[:p], v, beta
