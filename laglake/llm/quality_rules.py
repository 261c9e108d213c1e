"""Quality rules: word-level base counts, then compression bands.

A document's text is compressed with zstandard as a whole and in fixed chunks. Repetitive text compresses
far better than prose, random or encoded text hardly at all, so each length class has a band of accepted
ratios (raw bytes / compressed bytes); a text outside its band, or with a share of chunks outside the chunk
band (or below it: a lower limit) above a limit, is rejected.

The lower limits lie between measured ratios at level 3. Chunks of 2,000 bytes: random ASCII 1.18, base85 1.21, base64 1.31 at
most; prose of the four languages 1.70 at least. 1,000 to 2,000 bytes: base64 1.31 at most, prose 1.64 at least; 600 to
999 bytes: 1.27 and 1.43. Base32 (1.55) and hexadecimal (1.9) lie too near prose, or within it, and aren't told by these limits.

Defined results: a null or empty text has no words, fails the base rules and has a null ratio. Every row
gives one row (repeated ids included); null ids are passed through. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import SPACES, map_batches, table

SYMBOLS = "#*$%&|<>"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, chunks long, odd_chunks long, kept boolean")


@dataclass(frozen=True)
class Bands:
    """Length-specific limits: ``whole`` holds (texts of at least so many bytes, least ratio, largest ratio);
    the last row that applies counts. Short texts compress badly, so their lower limit is loose."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0), (300, 1.05, 3.5), (600, 1.35, 3.5), (1_000, 1.4, 4.0), (3_000, 1.4, 4.5), (30_000, 1.5, 5.0))
    chunk_bytes: int = 2_000
    chunk: tuple[float, float] = (1.5, 5.0)
    max_odd_share: float = 0.5
    max_dense_share: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    k = len(ids)
    if k == n:
        return 0
    pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen: set[str] = set()
    found = 0
    for line in lines:
        if line in seen:
            found += bool(line.strip(SPACES))
        else:
            seen.add(line)
    return found


def compression(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """(ratio of the whole, number of chunks, chunks outside the band, inside all limits). A last chunk
    shorter than half the chunk size joins the one before it."""
    n = len(raw)
    if not n:
        return None, 0, 0, False
    ratio = n / len(packer.compress(raw))
    low, high = next((a, b) for at, a, b in reversed(bands.whole) if n >= at)
    good, step, chunks, odd, dense = low <= ratio <= high, bands.chunk_bytes, 0, 0, 0
    if n >= step:
        cuts = list(range(0, n - step // 2, step))
        for i, at in enumerate(cuts):
            part = raw[at:at + step] if i + 1 < len(cuts) else raw[at:]
            r = len(part) / len(packer.compress(part))
            chunks += 1
            odd += not bands.chunk[0] <= r <= bands.chunk[1]
            dense += r < bands.chunk[0]
        good = good and odd <= bands.max_odd_share * chunks and dense <= bands.max_dense_share * chunks
    return ratio, chunks, odd, good


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """One document's result columns after the id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    repeated = repeated_words(words)
    failed = n < bands.min_words or 100 * repeated > bands.max_repeat_percent * n
    ratio, chunks, odd, good = compression(raw, bands, packer)
    return (n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, ratio, chunks, odd,
            good and not failed)


def quality_rules(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, compression figures and the verdict ``kept``."""
    bands = bands or Bands()
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def run(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(t.as_py(), bands, packer) for t in batch.column(1)]
        return {"doc_id": batch.column(0), **dict(zip(names, zip(*rows), strict=True))}

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")),
                       run, SCHEMA)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production limits over every whole document."""
    return quality_rules(table(spark, sf_dir, "documents"))
