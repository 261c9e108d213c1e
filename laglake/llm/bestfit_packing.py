"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Documents longer than a sequence are cut into full pieces behind a first piece that may be shorter. Full pieces
fill a sequence each. The others are dealt by hash to groups of about ``group_items``, and a task packs a
group: best-fit decreasing, then a local search that exchanges one for one, two for one, or moves pieces between
underfull bins whenever that raises the sum of squared fills, starting from the emptiest bin, until
no bin can be improved. A group wastes at most part of one bin more than the whole would.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each for
itself; null ids are passed through. An empty table gives an empty result.

Scale: texts are tokenised where they are read; only (id, piece, length, checksum) rows are shuffled. The number
of groups follows the number of rows, so a group's memory is bounded.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import loaded
from .common import map_batches, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what full pieces leave."""
    first = (n - 1) % size + 1
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, size: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """A row per piece with the CRC-32 of its ids."""
    closing = end_id.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> dict:
        bpe = loaded(tokenizer)
        out: dict[str, list] = {x.split()[0]: [] for x in PIECES.split(", ")}
        texts = batch.column(1).fill_null("").dictionary_encode()  # copies within a batch are tokenised once
        done = []
        for text in texts.dictionary:
            ids = bpe.encode(text.as_py()) + closing
            done.append([(k, start, n, zlib.crc32(ids[4 * start:4 * (start + n)])) for k, (start, n) in enumerate(cuts(len(ids) // 4, size))])
        for doc, which in zip(batch.column(0).to_pylist(), texts.indices.to_pylist(), strict=True):
            for piece in done[which]:
                for name, v in zip(out, (doc, *piece), strict=True):
                    out[name].append(v)
        return out

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item; items come in falling order. Bins are found by free space: bit f of ``open_`` says that
    some bin has f free."""
    free: list[list[int]] = [[] for _ in range(size + 1)]
    open_, bins, used = 0, np.empty(len(lengths), dtype=np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        fits = open_ >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            at = free[f].pop()
            if not free[f]:
                open_ &= ~(1 << f)
        else:
            f, at = size, used
            used += 1
        bins[i] = at
        if f - n:
            free[f - n].append(at)
            open_ |= 1 << (f - n)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Raises the sum of squared fills by moves and exchanges until none helps. ``bins`` is changed and returned.

    A step takes the emptiest bin that isn't settled (fill a) and looks, over all items t of other bins (fill b), for the best
    net transfer d out of it: an item s against t (d = s - t), a pair against t, or s alone into free
    space (t = 0). It must fit (d <= size - b) and raise the squares (b - a + d > 0); among those the
    largest gain 2 d (b - a + d) is made. A bin without one is settled. When all are, those are taken up again that a bin changed
    since could help, and are held against the changed bins only. Every step raises the sum, so the search ends."""
    if not len(lengths):
        return bins
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    member: list[list[int]] = [[] for _ in fill]
    for i, b in enumerate(bins.tolist()):
        member[b].append(i)
    settled = fill >= size
    step, changed, seen = 0, np.zeros(len(fill), np.int64), np.full(len(fill), -1)   # a bin has been held against all changes before ``seen``
    while True:
        alive = np.flatnonzero(~settled & (fill > 0))
        if not len(alive):
            open_ = (fill < size) & (fill > 0)
            newest = int(changed[open_].max(initial=-1))
            again = open_ & (seen < newest)
            if not again.any():
                return bins
            settled[again] = False
            continue
        a = int(alive[np.argmin(fill[alive])])
        roomy = np.flatnonzero((fill < size) & (fill > 0) & (changed > seen[a]))
        roomy = roomy[roomy != a]
        mine = member[a]
        own: dict[int, tuple[int, ...]] = {}
        for x, i in enumerate(mine):
            own.setdefault(int(lengths[i]), (i,))
            for j in mine[x + 1:]:
                own.setdefault(int(lengths[i] + lengths[j]), (i, j))
        items = np.array([i for b in roomy.tolist() for i in member[b]], dtype=np.int64)
        there = np.concatenate([bins[items], roomy]) if len(roomy) else np.empty(0, np.int64)
        gives = np.concatenate([lengths[items], np.zeros(len(roomy), np.int64)]) if len(roomy) else there
        gap, lead = size - fill[there], fill[there] - fill[a]
        top, pick = 0, None
        for s, what in own.items():
            d = s - gives
            gain = np.where((d > 0) & (d <= gap) & (lead + d > 0), d * (lead + d), 0)
            if len(what) == 2:
                gain[len(items):] = 0   # one move at a time into free space
            k = int(np.argmax(gain)) if len(gain) else -1
            if k >= 0 and gain[k] > top:
                top, pick = int(gain[k]), (what, k, int(d[k]))
        if pick is None:
            settled[a], seen[a] = True, step
            continue
        what, k, d = pick
        step += 1
        b = int(there[k])
        back = [int(items[k])] if k < len(items) else []
        for i in what:
            member[a].remove(i)
            member[b].append(i)
            bins[i] = b
        for i in back:
            member[b].remove(i)
            member[a].append(i)
            bins[i] = a
        fill[a] -= d
        fill[b] += d
        changed[a] = changed[b] = step
        seen[a] = seen[b] = -1
        settled[a], settled[b] = False, fill[b] >= size


def packed_group(size: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t["length"].to_numpy()
        bins = local_search(lengths, best_fit(lengths, size), size)
        order = np.lexsort((np.arange(len(bins)), bins))
        offset, running, last = np.zeros(len(bins), np.int64), 0, -1
        for i in order.tolist():
            if bins[i] != last:
                running, last = 0, bins[i]
            offset[i] = running
            running += int(lengths[i])
        names = np.unique(bins, return_inverse=True)[1]
        sequence = (t["pack"][0].as_py() << 32) + names
        return t.drop_columns(["pack"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset))
    return run


def bestfit_packing(docs: DataFrame, tokenizer: str, size: int = 2048, group_items: int = 8192, id_col: str = "doc_id",
                    text_col: str = "text", end_id: int = 0) -> DataFrame:
    """A row per piece: where it starts in its document, and its sequence and offset there."""
    groups = max(1, math.ceil(docs.count() / group_items))
    cut = pieces(docs, size, tokenizer, id_col, text_col, end_id)
    cut = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return cut.groupBy("pack").applyInArrow(packed_group(size), PACKED)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens from all documents."""
    return bestfit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
