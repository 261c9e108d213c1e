"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by
backpropagation through time. It labels every byte position; a document's probabilities are the mean over all of
its positions.

Texts are read whole, as windows of ``span`` bytes that follow one another (the state starts anew in each, in
training too), so memory doesn't grow with a text's length.

Training uses a bounded sample of the labelled rows: about ``rows_per_lang`` documents of each language,
chosen by a hash of the id, with ``cuts`` windows each at evenly spread places. Nothing else is bounded.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if there are no
labelled rows to learn from. Ties between languages go to the first in code point order. Repeated rows give
repeated results; null ids count as the text 'null' in the hold-out split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, table

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    span: int = 128
    rows_per_lang: int = 600
    cuts: int = 4
    epochs: int = 6
    batch: int = 256
    rate: float = 0.02
    seed: int = 13
    block: int = 4096


def initial(langs: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.3, (3 * hidden, 256))
        w[f"u{side}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden))
        w[f"c{side}"] = np.zeros((3 * hidden, 1))
        w[f"v{side}"] = rng.normal(0, 0.3, (langs, hidden))
    w["o"] = np.zeros((langs, 1))
    return {k: v.astype(np.float32) for k, v in w.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_side(w: Weights, side: str, text: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, hidden, windows) of one direction; with ``keep``, also what backpropagation needs.
    ``text`` is (steps, windows); ``mask`` is 0 behind a window's end, where the state is held at 0."""
    steps, n = text.shape
    hidden = w[f"u{side}"].shape[1]
    gates, u = w[f"x{side}"] + w[f"c{side}"], w[f"u{side}"]
    out, kept = np.empty((steps, hidden, n), np.float32), []
    h = np.zeros((hidden, n), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x = gates.take(text[t], axis=1)
        a = u @ h
        zr = sigmoid(x[:2 * hidden] + a[:2 * hidden])
        z, r = zr[:hidden], zr[hidden:]
        c = np.tanh(x[2 * hidden:] + r * a[2 * hidden:])
        new = c + z * (h - c)
        if mask is not None:
            new *= mask[t]
        if keep:
            kept.append((t, h, z, r, c, a[2 * hidden:]))
        out[t] = h = new
    return out, kept


def probabilities(w: Weights, text: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """(languages, steps, windows) probabilities of every position."""
    f, kept_f = run_side(w, "f", text, mask, keep)
    b, kept_b = run_side(w, "b", text, mask, keep)
    logit = np.matmul(w["vf"], f) + np.matmul(w["vb"], b) + w["o"]
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit, out=logit)
    p /= p.sum(axis=1, keepdims=True)
    return p, f, b, kept_f, kept_b


def gradients(w: Weights, text: np.ndarray, mask: np.ndarray, lang: np.ndarray) -> tuple[Weights, float]:
    """Mean cross-entropy over positions, and its gradients through all steps of both directions."""
    p, f, b, kept_f, kept_b = probabilities(w, text, mask, keep=True)
    n = max(1.0, float(mask.sum()))
    which = np.arange(text.shape[1])
    loss = -float((np.log(p[:, lang, which] + 1e-9) * mask).sum()) / n
    d = p.copy()
    d[:, lang, which] -= 1
    d *= mask[:, None, :] / n
    g: Weights = {"o": d.sum(axis=(0, 2))[:, None]}
    for side, states, kept in (("f", f, kept_f), ("b", b, kept_b)):
        g[f"v{side}"] = np.einsum("tkn,thn->kh", d, states, optimize=True)
        u, hidden = w[f"u{side}"], states.shape[1]
        into = np.matmul(w[f"v{side}"].T, d)
        gu, gx = np.zeros_like(u), np.zeros((256, 3 * hidden), np.float32)
        back = np.zeros((hidden, text.shape[1]), np.float32)
        for t, h, z, r, c, an in reversed(kept):
            dh = (into[t] + back) * mask[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r])
            gu += da @ h.T
            np.add.at(gx, text[t], np.concatenate([dz, dr, dc]).T)
            back = u.T @ da + dh * z
        g[f"u{side}"], g[f"x{side}"] = gu, gx.T.copy()
        g[f"c{side}"] = g[f"x{side}"].sum(axis=1, keepdims=True)
    return g, loss


def train(texts: list[bytes], langs: np.ndarray, count: int, s: Settings) -> Weights:
    """Adam over shuffled batches; classes are balanced by the sample."""
    w = initial(count, s.hidden, s.seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    rng, step = np.random.default_rng(s.seed + 1), 0
    total = max(1, s.epochs * -(-len(texts) // s.batch))
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), s.batch):
            some = order[at:at + s.batch]
            text, mask = padded([texts[i] for i in some], s.span)
            g, _ = gradients(w, text, mask, langs[some])
            norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
            step += 1
            rate = s.rate * (1 - 0.9 * step / total)
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return w


def padded(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) bytes and mask of texts of at most ``span`` bytes."""
    n = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(t.ljust(span, b"\0") for t in texts), np.uint8).reshape(len(texts), span).T
    mask = (np.arange(span)[:, None] < n).astype(np.float32)
    last = max(1, int(n.max(initial=1)))
    return np.ascontiguousarray(text[:last]), mask[:last]


def pooled(w: Weights, texts: list[bytes], s: Settings) -> np.ndarray:
    """(texts, languages): mean probabilities over all positions of each text. Windows of all texts run in
    blocks: full ones without a mask, the last ones of texts with it."""
    k = len(w["o"])
    sums = np.zeros((k, len(texts)))
    full, owner, rest, rest_owner = [], [], [], []

    def flush(limit: int) -> None:
        nonlocal full, owner, rest, rest_owner
        while len(owner) > limit:
            text = np.frombuffer(b"".join(full[:s.block]), np.uint8).reshape(-1, s.span).T.copy()
            add(probabilities(w, text, None)[0], owner[:s.block])
            full, owner = full[s.block:], owner[s.block:]
        while len(rest) > limit:
            text, mask = padded(rest[:s.block], s.span)
            add(probabilities(w, text, mask)[0] * mask[:, None, :], rest_owner[:s.block])
            rest, rest_owner = rest[s.block:], rest_owner[s.block:]

    def add(p: np.ndarray, who: list[int]) -> None:
        each = p.sum(axis=0)
        for lang in range(k):
            sums[lang] += np.bincount(who, weights=each[lang], minlength=len(texts))

    for i, raw in enumerate(texts):
        whole = len(raw) // s.span
        for at in range(0, whole, s.block):
            many = min(s.block, whole - at)
            full += [raw[(at + j) * s.span:(at + j + 1) * s.span] for j in range(many)]
            owner += [i] * many
            flush(s.block)
        if tail := raw[whole * s.span:]:
            rest.append(tail)
            rest_owner.append(i)
    flush(0)
    return sums.T / np.maximum(1, [len(t) for t in texts])[:, None]


def sample(docs: DataFrame, s: Settings, learn, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Windows, their language numbers and the languages, from the rows where ``learn`` holds."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    langs = sorted(counts, key=lambda x: x.encode())
    if not langs:
        return [], np.empty(0, np.int64), []
    toss = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for a in langs for x in (a, min(1.0, 1.3 * s.rows_per_lang / counts[a]))])
    rows = rows.where(toss < share[F.col(lang_col).cast("string")])
    text = F.col(text_col)
    room = F.greatest(F.length(text) - s.span, F.lit(0))
    parts = F.array(*[F.substring(text, (room * (i / max(1, s.cuts - 1))).cast("int") + 1, F.lit(s.span)) for i in range(s.cuts)])
    got = rows.select(F.col(lang_col).cast("string").alias("l"), toss.alias("t"), F.array_distinct(parts).alias("p")).collect()
    texts, labels = [], []
    taken = dict.fromkeys(langs, 0)
    for r in sorted(got, key=lambda r: (r["t"], r["l"], r["p"])):
        if taken[r["l"]] < s.rows_per_lang:
            taken[r["l"]] += 1
            texts += [x.encode("utf-8", "surrogatepass")[:s.span] for x in r["p"]]
            labels += [langs.index(r["l"])] * len(r["p"])
    return texts, np.array(labels, np.int64), langs


def language_id(docs: DataFrame, learn, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score and probabilities (a map by language) of every row of ``docs``, by a network
    trained on those where the condition ``learn`` holds."""
    s = settings or Settings()
    texts, labels, langs = sample(docs, s, learn, id_col, text_col, lang_col)
    w = train(texts, labels, len(langs), s) if langs else {}

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.as_py() or "" for t in batch.column(1)]
        known = [bool(langs) and any(map(str.isalpha, t)) for t in texts]
        p = pooled(w, [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known, strict=True)], s) if langs else np.zeros((len(texts), 1))
        top = p.argmax(axis=1)
        return {"doc_id": batch.column(0), "lang_pred": [langs[j] if k else "und" for j, k in zip(top, known, strict=True)],
                "score": [min(1.0, float(r[j])) if k else 0.0 for r, j, k in zip(p, top, known, strict=True)],
                "probabilities": [list(zip(langs, map(float, r), strict=True)) if k else [] for r, k in zip(p, known, strict=True)]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, probabilities map<string,double>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 isn't 2 modulo 4; predicts all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id(docs, F.coalesce(crc_mod("doc_id", 4), F.lit(0)) != 2)
    return found.select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
