"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``least`` and at
least 2 q words long, that no neighbouring word extends keeping the period.

1. Names. Level k names the factors of 2^k words: equal factors of a text share a name, which is the pair of its halves' names.
   A factor that occurs once in its text gets no name, and no factor around it can have one, so levels empty quickly in prose.
2. Proposals. From each occurrence of a factor of m = 2^k words, the next occurrences less than 2 m words on form at most
   a few arithmetic progressions. The distance to the first member of each, if it is m or more, is proposed as a period. The root of
   every run is proposed at the level of its own size (tests hold this against all primitive roots up to a length).
3. Extension. The names of all levels give the common extension of the two occurrences to either side in one descent, which is the
   run. Runs found several times, or with a multiple of their period, collapse on (start, end).

Texts of an Arrow batch are worked on together, some hundred thousand words at once; names include the text, so no match crosses
texts. Work is O(n log n) for any text. There is no shuffle.

Defined results: a null text has no words. Rows are independent (repeated ids included). ``rewrite`` is a deterministic
change of the words before the search (see ``tail_repeated``); a null id is rewritten by none. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
RUNS = "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>"
GROUP_WORDS = 200_000


def progressions(at: np.ndarray, name: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposed (position, period) pairs from the rising positions ``at`` of factors of m words and their names."""
    order = np.argsort(name, kind="stable")
    p, name = at[order], name[order]
    n = len(p)
    gap = np.full(n, np.iinfo(np.int64).max)   # to the next occurrence; none: never reached
    same = name[1:] == name[:-1]
    gap[:-1][same] = np.diff(p)[same]
    ends = np.flatnonzero(np.concatenate([gap[1:] != gap[:-1], [True]]))
    last = ends[np.searchsorted(ends, np.arange(n))]   # the last occurrence with the same gap, in the order of names
    found_at, found = [], []
    live, cur = np.arange(n), np.arange(n)
    while True:
        ok = gap[cur] < 2 * m
        live, cur = live[ok], cur[ok]
        far = p[cur + 1] - p[live] if len(live) else live
        ok = far < 2 * m
        live, cur, far = live[ok], cur[ok], far[ok]
        if not len(live):
            break
        good = far >= m
        found_at.append(p[live[good]])
        found.append(far[good])
        cur = last[cur] + 1   # the last member of the progression
    if not found:
        return p[:0], p[:0]
    pos, q = np.concatenate(found_at), np.concatenate(found)
    by = np.lexsort((pos, q))
    pos, q = pos[by], q[by]
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (pos[1:] > pos[:-1] + 1)]) if len(pos) else np.empty(0, bool)
    return pos[first], q[first]


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of several texts at once: ``words`` holds their word numbers one after the other, ``ends``
    where each text ends. Sorted by start, then period."""
    n = len(words)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    stop = ends[text]
    nameless = -1 - np.arange(n + 1)   # a different value at each position, equal to none
    _, which, times = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    here = np.flatnonzero(times[which] > 1)
    levels, pos, period, m = [], [], [], 1
    key = which[here]
    while len(here):
        name = nameless.copy()
        _, key = np.unique(key, return_inverse=True)
        name[here] = key
        levels.append(name)
        a, q = progressions(here, key, m)
        pos.append(a)
        period.append(q)
        two = here[here + 2 * m <= stop[here]]
        two = two[name[two + m] >= 0]
        pair = name[two] * (len(here) + 1) + name[two + m]
        _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        often = times[which] > 1
        here, key, m = two[often], which[often], 2 * m
    if not levels:
        return none, none, none
    at, q = np.concatenate(pos), np.concatenate(period)
    start, end = at.copy(), at + q
    for k in range(len(levels) - 1, -1, -1):   # extensions are shorter than twice the longest factor that occurs twice
        name, size = levels[k], 1 << k
        fits = end < n
        same = np.zeros(len(end), bool)
        same[fits] = name[end[fits] - q[fits]] == name[end[fits]]
        end += np.where(same, size, 0)
        back = start - size
        fits = back >= 0
        same = np.zeros(len(end), bool)
        same[fits] = name[back[fits]] == name[back[fits] + q[fits]]
        start -= np.where(same, size, 0)
    good = (end - start >= np.maximum(least, 2 * q))
    start, end, q = start[good], end[good], q[good]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(q) else np.empty(0, bool)
    start, end, q = start[new], end[new], q[new]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


def tail_repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: in one text of ten, chosen by the id's checksum, the words from a on repeat with period p."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def texts_with_runs(ids: list, texts: list, least: int, rewrite: Callable | None) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Of each text: its words and its runs (start, length, period) by start, then period."""
    at = 0
    while at < len(texts):
        numbers: dict[bytes, int] = {}
        group, parts, total = [], [], 0
        while at < len(texts) and (not group or total < GROUP_WORDS):
            words = (texts[at] or "").encode("utf-8", "surrogatepass").split()
            order = rewrite(ids[at], len(words)) if rewrite else None
            if order is not None:
                words = [words[i] for i in order.tolist()]
            group.append(words)
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            total += len(words)
            at += 1
        ends = np.cumsum([len(w) for w in group])
        start, end, q = find_runs(np.concatenate(parts), ends, least)
        cut = np.searchsorted(start, ends).tolist()
        base, low = 0, 0
        for words, high in zip(group, cut, strict=True):
            yield words, list(zip((start[low:high] - base).tolist(), (end[low:high] - start[low:high]).tolist(), q[low:high].tolist(), strict=True))
            base, low = base + len(words), high


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = 12, rewrite: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text with its runs collapsed (words joined by one space; null stays null) and the runs, of every row."""
    def run(b: pa.RecordBatch) -> dict:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        kept, runs = [], []
        for words, found in texts_with_runs(ids, texts, least, rewrite):
            kept.append(b" ".join(collapsed(words, found)).decode("utf-8", "replace"))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
        return {"doc_id": b.column(0), "text": [None if t is None else k for t, k in zip(texts, kept, strict=True)], "runs": runs}

    return map_batches(_rows(docs, id_col, text_col), run, RUNS)


def run_digests(docs: DataFrame, least: int = 12, rewrite: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of digests per document: the number of runs, the longest (ties: smallest start, then period), a hash of all runs and of
    the collapsed text."""
    def run(b: pa.RecordBatch) -> dict:
        ids, out = b.column(0).to_pylist(), []
        for words, found in texts_with_runs(ids, b.column(1).to_pylist(), least, rewrite):
            s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
            out.append((len(words), len(found), s, n, q, 1000 * n // q if found else None,
                        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
                        hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        return {"doc_id": b.column(0), **dict(zip(names, zip(*out, strict=True), strict=True))}

    return map_batches(_rows(docs, id_col, text_col), run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words over every whole document, with the contract's rewriting."""
    return run_digests(table(spark, sf_dir, "documents"), rewrite=tail_repeated)
