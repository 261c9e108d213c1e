"""LM scoring by cross-entropy difference: a target and a background bigram model, matched in order,
smoothing and vocabulary, and the mean per-token difference of their losses for every document.

A text is the sequence <s> w1 .. wn </s> of its words. The background counts all documents, the target those whose
id is among ``target_ids``. Both models: p1(w) = (c(w) + 1) / (N + V) with N the model's tokens and V the shared
vocabulary (all words of the corpus, and </s>), and p(w | v) = (c(v w) + mu p1(w)) / (c(v) + mu). A document's score is
the mean over its tokens of -ln p_target + ln p_background: the lower, the more it resembles the target.

Counts are exact over the whole corpus (words and word pairs by 52-bit hash): each block of texts counts its own and asks
the buckets for the corpus' counts of just the keys it holds, so no count table is broadcast or collected.

Defined results: a null text, or one without words, has 0 tokens, null losses and score 0, and isn't counted.
Null ids belong to no target. Repeated rows are counted as often as they occur. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exchange import ASK, answered, ask_table, asks, mixed, plan, replies

START, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
SCORED = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
DROP = 12
_CUT = np.uint64(DROP)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    seen: dict[bytes, int] = {}
    parts, n = [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split() if t else []
        n.append(len(words))
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    return (known[np.concatenate(parts)] if parts else np.empty(0, np.uint64)), np.array(n, np.int64)


def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token in order: its own key, its context's and the pair's; and each text's number of tokens."""
    words, n = word_hashes(texts)
    tokens = np.where(n > 0, n + 1, 0)
    ends = np.cumsum(tokens)
    now = np.empty(int(tokens.sum()), np.uint64)
    last = np.zeros(len(now), bool)
    last[ends[tokens > 0] - 1] = True
    now[~last], now[last] = words, END
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(ends - tokens)[tokens > 0]] = START
    pair = mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(now))
    return mixed(now) >> _CUT << _CUT, mixed(before) >> _CUT << _CUT, pair >> _CUT << _CUT, tokens


def distinct(texts: list[str | None], target: np.ndarray):
    """keys, (all, target) counts and, per key, whether it counts as a word of the vocabulary; and what is needed to look
    tokens up: positions of own, context and pair keys among the keys, and tokens per text."""
    own, context, pair, tokens = keys_of(texts)
    starts = mixed(np.array([START])) >> _CUT << _CUT
    many, goal = int((tokens > 0).sum()), int((tokens[target] > 0).sum())
    every = np.concatenate([own, pair, starts])
    keys, which = np.unique(every, return_inverse=True)
    of_target = np.repeat(target, tokens)
    weight = np.concatenate([of_target, of_target, [False]])
    total = np.bincount(which, minlength=len(keys))
    hits = np.bincount(which, weights=weight, minlength=len(keys)).astype(np.int64)
    total[which[-1]] += many - 1
    hits[which[-1]] += goal
    word = np.zeros(len(keys), np.uint8)
    word[which[:len(own)]] = 1
    fact = np.zeros(len(keys), FACT)
    fact["all"], fact["target"], fact["word"] = total, hits, word
    return keys, fact, which[:len(own)], np.searchsorted(keys, context), which[len(own):-1], tokens


FACT = np.dtype([("all", "<u4"), ("target", "<u4"), ("word", "u1")])
COUNT = np.dtype([("all", "<u8"), ("target", "<u8")])


def summed(which: np.ndarray, facts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    out = np.empty(len(which), COUNT)
    for name in COUNT.names:
        out[name] = np.bincount(which, weights=facts[name]).astype(np.int64)[which]
    return out


def totals(keys: np.ndarray, which: np.ndarray, facts: np.ndarray) -> bytes:
    """The bucket's vocabulary and its tokens in each model."""
    word = facts["word"] > 0
    vocabulary = len(np.unique(which[word]))
    return np.array([vocabulary, facts["all"][word].sum(), facts["target"][word].sum()], "<i8").tobytes()


def losses(own: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int, vocabulary: int, mu: float) -> np.ndarray:
    one = (own + 1.0) / (n + vocabulary)
    return -np.log((pair + mu * one) / (context + mu))


def lm_scores(docs: DataFrame, target_ids: DataFrame, mu: float = 16.0, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``SCORED`` rows, one per row of ``docs``. ``target_ids`` has the ids of target documents in ``id_col``; they go to
    the blocks as rows of their own, so that texts are shuffled once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("mark"))
    blocks, buckets = plan(rows, block_bytes, 4.0)
    marks = target_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    dealt = rows.unionByName(marks).withColumn("block", F.pmod(key, F.lit(blocks)).cast("long")).repartition(blocks, "block")

    def split(t: pa.Table) -> tuple[pa.Array, list, np.ndarray]:
        mark = np.array(t["mark"].to_pylist(), bool)
        ids = np.array([x if x is not None else 0 for x in t["doc_id"].to_pylist()], np.int64)
        known = np.array(t["doc_id"].is_valid().to_pylist(), bool)
        own = t.filter(pa.array(~mark))
        return own["doc_id"], own["text"].to_pylist(), (np.isin(ids, ids[mark]) & known)[~mark]

    def ask(t: pa.Table) -> pa.Table:
        _, texts, target = split(t)
        keys, facts, *_ = distinct(texts, target)
        return ask_table(asks(t["block"][0].as_py(), 0, keys, facts, buckets, DROP, empty=True))

    def score(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({n: [] for n in ("doc_id", "n_tokens", "loss_target", "loss_background", "score")})
        ids, texts, target = split(t)
        _, _, own, context, pair, tokens = distinct(texts, target)
        counts, fronts = replies(reply, COUNT, front=24)
        vocabulary, n_all, n_target = np.sum([np.frombuffer(f, "<i8") for f in fronts], axis=0).tolist()
        text = np.repeat(np.arange(len(tokens)), tokens)
        means = []
        for name, n in (("target", n_target), ("all", n_all)):
            c = counts[name].astype(np.float64)
            loss = np.bincount(text, weights=losses(c[own], c[context], c[pair], n, vocabulary, mu), minlength=len(tokens))
            means.append(loss / np.maximum(1, tokens))
        none = tokens == 0
        return pa.table({"doc_id": ids, "n_tokens": tokens, "loss_target": pa.array(means[0], mask=none), "loss_background": pa.array(means[1], mask=none),
                         "score": np.where(none, 0.0, means[0] - means[1])})

    asked = dealt.groupBy("block").applyInArrow(ask, ASK)
    return dealt.groupBy("block").cogroup(answered(asked, summed, FACT, totals).groupBy("block")).applyInArrow(score, SCORED)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality. Background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good FROM documents),
s AS (SELECT k, doc_id, coalesce(good, false) AS good, CASE WHEN len(w) > 0 THEN list_concat(['<s>'], w, ['</s>']) END AS w FROM d),
t AS (SELECT k, good, unnest(w[:-2]) AS v, unnest(w[2:]) AS w, unnest(range(len(w) - 1)) AS i FROM s WHERE w IS NOT NULL),
u AS (SELECT k, good, CASE WHEN i = 0 THEN '0' ELSE '1' || v END AS v, CASE WHEN i = max(i) OVER (PARTITION BY k) THEN '2' ELSE '1' || w END AS w FROM t),
one AS (SELECT w, count(*)::DOUBLE AS a, (count(*) FILTER (good))::DOUBLE AS g FROM u GROUP BY w),
con AS (SELECT v, count(*)::DOUBLE AS a, (count(*) FILTER (good))::DOUBLE AS g FROM u GROUP BY v),
two AS (SELECT v, w, count(*)::DOUBLE AS a, (count(*) FILTER (good))::DOUBLE AS g FROM u GROUP BY v, w),
n AS (SELECT count(*)::DOUBLE AS voc, sum(a) AS a, sum(g) AS g FROM one),
l AS (SELECT u.k, -ln((two.g + 16 * (one.g + 1) / (n.g + n.voc)) / (con.g + 16)) AS lt,
             -ln((two.a + 16 * (one.a + 1) / (n.a + n.voc)) / (con.a + 16)) AS lb
      FROM u JOIN one USING (w) JOIN con USING (v) JOIN two ON two.v = u.v AND two.w = u.w CROSS JOIN n),
m AS (SELECT k, count(*) AS n, avg(lt) AS lt, avg(lb) AS lb FROM l GROUP BY k)
SELECT s.doc_id, coalesce(m.n, 0)::BIGINT AS n_tokens, m.lt AS loss_target, m.lb AS loss_background, coalesce(m.lt - m.lb, 0.0) AS score
FROM s LEFT JOIN m USING (k)
"""
