"""Suffix-array deduplication of passages: every byte that lies in a ``length``-byte string which also starts
earlier (in a smaller document, or earlier in the same one) is removed.

Blocks hold documents of neighbouring ids, so the order of blocks is the order of documents. Within a block, prefix
polynomial hashes (modulo 2^64) give the hash of any substring in constant time.

1. Anchors. Each ``length``-byte window picks the smallest hashed ``gram``-byte string in it, the leftmost of equals. Equal
   windows pick the same gram at the same offset, wherever they are. Consecutive windows that picked one anchor
   form its range.
2. Suffix sort within a block, for grams that occur more than once there. Whole ranges that are equal (hash, then bytes) keep
   their first occurrence. The windows of the ranges left, bucketed by (gram, offset), are sorted as suffixes by
   a bottom-up mergesort; two suffixes compare by their common extension, found by binary search over prefix hashes,
   and the byte behind it. Neighbours with a common extension of at least ``length`` are verified byte by byte
   and form a class, whose first member stays.
3. Between blocks, a block asks about its distinct grams (with the hash of the gram's range, if it has one only). It learns
   whether a gram is elsewhere, whether all ranges in the corpus are equal, and whether an earlier block has it.
   Where ranges differ, it asks about the classes of its windows by their 64-bit hash. Bytes are verified within blocks
   only; a false match between blocks needs equal 64-bit hashes of two windows.
4. Windows that start a later copy cover the bytes that go.

A gram or window that millions of documents hold is one entry per block, so no task gets a hot group.

Defined results: a null text is empty; a text shorter than ``length`` is only kept. Null ids come after all others; rows
with equal ids are ordered by their text's first 16 bytes, then by its hash. Empty tables give no rows. A document is
never cut in two: a block is about ``block_bytes`` of text or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.session import materialize

from .common import table, text_bytes
from .exchange import ASK, answered, ask_table, asks, distinct, mixed, plan, replies

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
GRAM_DROP = 20  # 44 bits tell grams apart; equal ranges need 32 more bits to agree
U = np.uint64
PIECE = 1 << 16  # positions worked on at a time, so that only few arrays are as long as a block
LOW_BITS = 11


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(1, n), U)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * U(step)
        have, step = have + more, step * step & MASK
    return out


def pieces(n: int) -> Iterator[slice]:
    return (slice(at, min(at + PIECE, n)) for at in range(0, n, PIECE))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``first`` on."""
    before = np.cumsum(count) - count
    out = np.repeat((first - before).astype(np.int32), count)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Block:
    """The texts of a block in order, their hashes, and the windows' anchors."""

    def __init__(self, t: pa.Table, length: int, gram: int):
        self.length, self.gram = length, gram
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in t["text"].to_pylist()]
        ids = t["doc_id"].to_pylist()
        mark = t["mark"].to_pylist() if "mark" in t.column_names else [0] * len(ids)
        self.order = sorted(range(len(raw)), key=lambda k: (ids[k] is None, ids[k] or 0, raw[k][:16].ljust(16, b"\0"), mark[k], raw[k]))
        self.ids, self.raw = [ids[k] for k in self.order], [raw[k] for k in self.order]
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        n = len(self.data)
        self.ends = np.cumsum([len(r) for r in self.raw], dtype=np.int64)
        # the prefix hash before position i is the sum of (byte + 1) * BASE^j over j < i; a substring's hash is shifted to j = 0
        self.prefix = np.zeros(n + 1, U)
        base, power = powers(BASE, min(n, PIECE)), 1
        for s in pieces(n):
            part = self.data[s].astype(U)
            part += U(1)
            part *= base[:len(part)]
            part *= U(power)
            part[:1] += self.prefix[s.start:s.start + 1]
            np.cumsum(part, out=self.prefix[s.start + 1:s.stop + 1])
            power = power * pow(BASE, PIECE, 1 << 64) & MASK
        # INVERSE^i is low[i's lower bits] * high[its upper bits]
        self.low = powers(INVERSE, 1 << LOW_BITS)
        self.high = powers(pow(INVERSE, 1 << LOW_BITS, 1 << 64), (n >> LOW_BITS) + 1)
        self.anchors()

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        out = self.prefix[at + length]
        out -= self.prefix[at]
        out *= self.low[at & ((1 << LOW_BITS) - 1)]
        out *= self.high[at >> LOW_BITS]
        return out

    def anchors(self) -> None:
        """Windows by anchor: gram hash, anchor, first window and number of windows, in order."""
        n, span = len(self.data), self.length - self.gram + 1
        none = np.empty(0, np.int64)
        self.key, self.anchor, self.first, self.count = none.astype(U), none, none, none
        if n < self.length:
            return
        starts = np.concatenate([[0], self.ends[:-1]])
        inside = np.zeros(n + 1, np.int8)  # windows that don't leave their document
        fits = self.ends - starts >= self.length
        np.add.at(inside, starts[fits], 1)
        np.add.at(inside, self.ends[fits] - self.length + 1, -1)
        np.cumsum(inside, out=inside)
        first, anchor, rank = [none], [none], [none]
        windows, last, held = 0, -2, -1  # so far: windows, the last one and its anchor
        for s in pieces(n - self.length + 1):
            at = np.flatnonzero(inside[s]) + s.start
            if not len(at):
                continue
            picked = self.picked(s.start, s.stop, span)[at - s.start]
            new = (np.diff(at, prepend=last) != 1) | (np.diff(picked, prepend=held) != 0)
            first.append(at[new])
            anchor.append(picked[new])
            rank.append(np.flatnonzero(new) + windows)
            windows, last, held = windows + len(at), at[-1], picked[-1]
        self.first, self.anchor = np.concatenate(first), np.concatenate(anchor)
        self.count = np.diff(np.concatenate([*rank, [windows]]))
        # anchors have the smallest of their windows' hashes; mixed once more, they spread over all buckets
        self.key = mixed(mixed(self.hashes(self.anchor, self.gram)) ^ U(BASE))

    def picked(self, start: int, stop: int, span: int) -> np.ndarray:
        """The gram that each window from ``start`` to ``stop`` picks: its position."""
        at = np.arange(start, stop + span - 1)
        low = U((1 << 32) - 1)  # 32 bits of hash, then the position; the same in every block
        x = mixed(self.hashes(at, self.gram))
        x &= ~low
        x |= at.view(U)
        have = 1
        while have * 2 <= span:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if span > have:
            x = np.minimum(x[:have - span], x[span - have:])
        return (x & low).view(np.int64)

    def ranges(self) -> np.ndarray:
        """A hash of each range: its bytes and where the anchor is in it."""
        whole = self.hashes(self.first, self.count + (self.length - 1))
        return mixed(whole + mixed((self.anchor - self.first).astype(U) * U(BASE) + self.count.astype(U)))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes from a equal those from b, for each triple."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 20_000):
        s = slice(at, at + 20_000)
        total = int(n[s].sum())
        if total:
            edge = np.cumsum(n[s]) - n[s]
            step = np.arange(total) - np.repeat(edge, n[s])
            differ = data[np.repeat(a[s], n[s]) + step] != data[np.repeat(b[s], n[s]) + step]
            out[s] = np.add.reduceat(np.concatenate([differ, [False]]), np.minimum(edge, total)) == 0
            out[s][n[s] == 0] = True
    return out


def extension(b: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common extension of the suffixes at x and y, up to ``length``: binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), b.length, np.int64)
    for _ in range(int(b.length).bit_length()):
        mid = (low + high + 1) >> 1
        same = b.hashes(x, mid) == b.hashes(y, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def before(b: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the suffix at x sorts before the one at y; equal windows by position."""
    common = extension(b, x, y)
    i = np.minimum(common, b.length - 1)
    return np.where(common >= b.length, x < y, b.data[x + i] < b.data[y + i])


def suffix_sort(b: Block, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of the windows at ``at`` by bucket (rising input), then as suffixes. Bottom-up mergesort of all buckets at once: in each
    round, runs of 2^k within a bucket merge in pairs, an element's place being its own rank plus its rank in the
    other run, found by binary search."""
    n = len(at)
    order = np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.concatenate([start, [n]]))
    base, most = np.repeat(start, size), int(size.max(initial=0))
    stop = base + np.repeat(size, size)
    run = 1
    while run < most:
        live = np.flatnonzero(stop - base > run)
        local = live - base[live]
        left = (local // run) % 2 == 0
        own = base[live] + local // run * run
        other = np.where(left, own + run, own - run)
        other_end = np.minimum(other + run, stop[live])
        low, high = np.minimum(other, other_end), other_end.copy()
        me = at[order[live]]
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            less = before(b, at[order[mid]], me[todo])
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = np.where(left, own, other) + (live - own) + np.maximum(0, low - np.minimum(other, other_end))
        merged = order.copy()
        merged[place] = order[live]
        order = merged
        run *= 2
    return order


def repeats(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Later copies within the block.

    Returns whether each range is a later copy as a whole; and for the ranges that aren't, where grams have several of them,
    the windows: range, position and whether the window is a later copy."""
    later = np.zeros(len(b.key), bool)
    ranges = b.ranges()
    order = np.lexsort((b.first, ranges, b.key))
    same = (b.key[order][1:] == b.key[order][:-1]) & (ranges[order][1:] == ranges[order][:-1])
    if same.any():
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
        x = np.flatnonzero(np.concatenate([[False], same]))
        i, j = order[x], order[head[x]]
        good = b.count[i] == b.count[j]
        n = np.where(good, b.count[i] + b.length - 1, 0)
        later[i[good & same_bytes(b.data, b.first[i], b.first[j], n)]] = True
    left = np.flatnonzero(~later)
    _, gram, times = np.unique(b.key[left], return_inverse=True, return_counts=True)
    many = left[times[gram] > 1]
    many = many[np.lexsort((b.first[many], b.key[many]))]
    parts = []
    for s in windows_at_once(b.key[many], b.count[many]):
        parts.append(sorted_windows(b, many[s]))
    if not parts:
        return later, np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)
    return later, *[np.concatenate(x) for x in zip(*parts, strict=True)]


def windows_at_once(key: np.ndarray, count: np.ndarray, most: int = 200_000) -> list[slice]:
    """Slices of the ranges (sorted by gram) that hold whole grams, and at most about ``most`` windows unless one gram has more: what the
    sort needs beside the result is bounded by a slice."""
    ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1 if len(key) else np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    out, at = [], 0
    for end, more in zip(ends.tolist(), np.append(ends, -1)[1:].tolist(), strict=True):
        if more < 0 or total[more] - total[at] > most:
            out.append(slice(at, end))
            at = end
    return out


def sorted_windows(b: Block, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of some grams' ranges, sorted as suffixes within (gram, offset): range, position, and whether it is a later copy."""
    rng = np.repeat(many, b.count[many])
    at = b.first[rng] + np.arange(len(rng)) - np.repeat(np.cumsum(b.count[many]) - b.count[many], b.count[many])
    offset = b.anchor[rng] - at
    by = np.lexsort((at, offset, b.key[rng]))
    rng, at = rng[by], at[by]
    key, offset = b.key[rng], offset[by]
    bucket = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])]))
    order = suffix_sort(b, at, bucket)
    rng, at, bucket = rng[order], at[order], bucket[order]
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    copy = np.zeros(len(at), bool)
    if len(near):
        x, y = at[near], at[near + 1]
        equal = extension(b, x, y) >= b.length
        near, x, y = near[equal], x[equal], y[equal]
        copy[near[same_bytes(b.data, x, y, np.full(len(x), b.length, np.int64))] + 1] = True
    return rng.astype(np.int32), at.astype(np.int32), copy


GRAM_FACT = "<u4"  # the upper bits of the only range's hash; 0: several ranges
ELSEWHERE, FIRST, LATER, SEVERAL = 0, 1, 2, 3  # ELSEWHERE: the gram is in no other block


def gram_state(which: np.ndarray, facts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """What each block learns about each of its grams."""
    n = int(which.max(initial=-1)) + 1
    times, least = np.bincount(which, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, which, blocks)
    low, high = np.full(n, 1 << 32, np.int64), np.zeros(n, np.int64)
    np.minimum.at(low, which, facts.astype(np.int64))
    np.maximum.at(high, which, facts.astype(np.int64))
    several = (low != high) | (low == 0)
    out = np.where(several[which], SEVERAL, np.where(blocks == least[which], FIRST, LATER))
    return np.where(times[which] == 1, ELSEWHERE, out).astype(np.uint8)


def window_state(which: np.ndarray, facts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """1 where an earlier block has the window."""
    least = np.full(int(which.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, blocks)
    return (blocks > least[which]).astype(np.uint8)


def among(rising: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is one of the rising keys; looked up in order, which is several times faster."""
    out = np.zeros(len(x), bool)
    if len(rising):
        order = np.argsort(x)
        x = x[order]
        out[order] = rising[np.minimum(np.searchsorted(rising, x), len(rising) - 1)] == x
    return out


class Known:
    """What a block works out for itself: later copies, and its distinct grams with their facts."""

    def __init__(self, b: Block):
        self.b = b
        self.later, self.rng, self.at, self.copy = repeats(b)
        cut = b.key >> U(GRAM_DROP) << U(GRAM_DROP)
        self.grams, self.gram = np.unique(cut, return_inverse=True)
        mark = np.maximum(b.ranges() >> U(32), U(1)).astype(np.int64)
        low, high = np.full(len(self.grams), 1 << 32, np.int64), np.zeros(len(self.grams), np.int64)
        np.minimum.at(low, self.gram, mark)
        np.maximum.at(high, self.gram, mark)
        self.facts = np.where(low == high, low, 0).astype(GRAM_FACT)

    def open_windows(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows to ask about: of ranges whose gram has several ranges in the corpus, first copies in the block."""
        b = self.b
        ask = (state[self.gram] == SEVERAL) & ~self.later
        sorted_ = np.zeros(len(b.key), bool)
        sorted_[self.rng] = True
        r = np.flatnonzero(ask & ~sorted_)
        at = np.concatenate([spread(b.first[r], b.count[r]), self.at[ask[self.rng] & ~self.copy]])
        found = np.empty(len(at), U)
        for s in pieces(len(at)):
            found[s] = mixed(b.hashes(at[s], b.length))
        return at, found

    def marked(self, state: np.ndarray, reply: np.ndarray) -> np.ndarray:
        """Whether each byte of the block goes."""
        b, n = self.b, len(self.b.data)
        change = np.zeros(n + 1, np.int32)
        whole = np.flatnonzero(self.later | (state[self.gram] == LATER))
        np.add.at(change, b.first[whole], 1)
        np.add.at(change, b.first[whole] + b.count[whole] + b.length - 1, -1)
        at, h = self.open_windows(state)
        known = distinct(h)[reply > 0]   # windows that an earlier block has
        single = [self.at[self.copy], *[at[s][among(known, h[s])] for s in pieces(len(at))]]
        # a later copy of a window that an earlier block has is a later copy in this block as well, so nothing is missed
        for x in single:
            np.add.at(change, x, 1)
            np.add.at(change, x + b.length, -1)
        np.cumsum(change, out=change)
        return change[:n] > 0


KEY = ("last", "doc_id", "begin", "mark")  # the order of documents


def with_order(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with what orders them besides the id: nulls last, the text's first 16 bytes, its hash."""
    return rows.select("*", F.col("doc_id").isNull().cast("int").alias("last"), F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 16).alias("begin"),
                       F.xxhash64("text").alias("mark"))


def order_keys(last: np.ndarray, ids: np.ndarray, begin: list, mark: np.ndarray) -> np.ndarray:
    """The order as byte strings that compare like it."""
    sign = U(1 << 63)
    out = np.zeros((len(ids), 33), np.uint8)
    out[:, 0] = last
    out[:, 1:9] = (ids.astype(np.int64).view(U) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:25] = np.array(begin, "S16").view(np.uint8).reshape(-1, 16)
    out[:, 25:] = (mark.astype(np.int64).view(U) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S33").ravel()


def block_starts(rows: DataFrame, block_bytes: int) -> np.ndarray:
    """Keys at which blocks of about ``block_bytes`` bytes of text start, a block ending before the document that would overfill it. Range
    partitions of (key, bytes) cut themselves in parallel; the driver joins what is left over at their edges (one key of 33 bytes a
    block). Repeated and null ids are cut like any others."""
    @F.pandas_udf("binary")
    def key(last: pd.Series, ids: pd.Series, begin: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([bytes(k).ljust(33, b"\0") for k in order_keys(last.to_numpy(), ids.to_numpy(), begin.tolist(), mark.to_numpy())], dtype=object)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, int]] = []
        for b in batches:
            for k, n, rows_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = max(1, min(rows_, n // block_bytes))   # equal rows fill several blocks
                if parts == 1 and found and found[-1][1] + n <= block_bytes:
                    found[-1] = (found[-1][0], found[-1][1] + n)
                else:
                    found += [(k, -(-n // parts))] * parts
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["key", "size"])

    small = rows.select(key("last", F.coalesce("doc_id", F.lit(0)), "begin", "mark").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    small = materialize(small.groupBy("key").agg(F.sum("size").alias("size"), F.count("size").alias("rows")), "order-keys")
    parts = small.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(cut, "key binary, size long").collect()
    starts: list[bytes] = []
    size = 0
    for r in sorted(parts, key=lambda r: bytes(r["key"])):
        k = bytes(r["key"])
        if not starts or size + r["size"] > block_bytes:
            starts.append(k)
            size = 0
        size += r["size"]
    return np.array(starts, "S33")


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with the number of their block: neighbouring documents, about as many bytes each."""
    rows = with_order(rows)
    starts = block_starts(rows, max(1, -(-text_bytes(rows) // blocks)))

    @F.pandas_udf("long")
    def block(last: pd.Series, ids: pd.Series, begin: pd.Series, mark: pd.Series, share: pd.Series) -> pd.Series:
        keys = order_keys(last.to_numpy(), ids.to_numpy(), begin.tolist(), mark.to_numpy())
        high = np.searchsorted(starts, keys, side="right") - 1
        first = np.minimum(np.searchsorted(starts, keys), high)   # equal rows may fill several blocks: any of them
        return pd.Series(np.maximum(0, first + (share.to_numpy() * (high - first + 1)).astype(np.int64)))

    numbered = rows.withColumn("block", block("last", F.coalesce("doc_id", F.lit(0)), "begin", "mark", F.rand(5)))
    return numbered.drop("last", "begin").repartition(max(1, len(starts)), "block")


def suffix_dedup(docs: DataFrame, length: int = 100, gram: int = 32, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """doc_id, the kept bytes as ``text``, the removed spans (byte offsets) and the struct ``rest`` of the columns
    ``carry``, of every row. With ``decode``, ``text`` is a string without the characters that a span cuts in two, and null where
    the input is."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest)
    blocks, buckets = plan(rows, block_bytes, 1.0)
    texts = dealt(rows, blocks)

    def ask_grams(t: pa.Table) -> pa.Table:
        k = Known(Block(t, length, gram))
        return ask_table(asks(t["block"][0].as_py(), 0, k.grams, k.facts, buckets, GRAM_DROP))

    def ask_windows(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not t.num_rows:
            return ask_table([])
        k = Known(Block(t, length, gram))
        keys = distinct(k.open_windows(replies(reply, "u1")[0])[1])
        return ask_table(asks(t["block"][0].as_py(), 1, keys, np.zeros(len(keys), np.uint8), buckets))

    def finish(t: pa.Table, reply: pa.Table) -> pa.Table:
        ids, kept, spans, order, empty = [], [], [], [], []
        if t.num_rows:
            b = Block(t, length, gram)
            gone = Known(b).marked(replies(reply, "u1")[0], replies(reply, "u1", 1)[0])
            ids, order, missing = b.ids, b.order, t["text"].is_null().to_pylist()
            empty = [missing[k] for k in order]
            for raw, end in zip(b.raw, b.ends.tolist(), strict=True):
                g = gone[end - len(raw):end]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans.append([{"start": s, "stop": e} for s, e in edge.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(raw, np.uint8)[~g].tobytes() if len(edge) else raw)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([None if gone else x.decode("utf-8", "ignore") for x, gone in zip(kept, empty, strict=True)], pa.string()) if decode else pa.array(kept, pa.binary()), "rest": t["rest"].take(pa.array(order, pa.int64())).cast(nullable(t["rest"].type)),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))})

    result = f"doc_id long, text {'string' if decode else 'binary'}, rest {rows.schema['rest'].dataType.simpleString()}, spans array<struct<start:int,stop:int>>"
    groups = texts.groupBy("block")
    about_grams = answered(groups.applyInArrow(ask_grams, ASK), gram_state, GRAM_FACT)
    about_windows = answered(groups.cogroup(about_grams.groupBy("block")).applyInArrow(ask_windows, ASK), window_state, "u1")
    return groups.cogroup(about_grams.unionByName(about_windows).groupBy("block")).applyInArrow(finish, result)


def nullable(kind: pa.StructType) -> pa.StructType:
    return pa.struct([pa.field(f.name, f.type) for f in kind])


def digest_columns(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", (F.octet_length("text") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes over all documents."""
    return digest_columns(suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))
