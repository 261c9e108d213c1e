"""Blocks that ask and buckets that answer.

Several operators need a fact about the whole corpus (a count, a first occurrence) for very many keys, in the place where
the text is. Texts are dealt to blocks of a few megabytes once. A block sends its distinct keys, sorted, to the
buckets that own them; a bucket joins the lists of all blocks and answers each block in the order of its
keys. A key that occurs everywhere costs one entry per block, however many rows hold it, so no key is hot; a
group in memory is one block, or one bucket's lists.

``sent`` and ``received`` code sorted 64-bit keys as differences of as few bytes as the largest needs. Keys may be cut to
their upper bits (``drop`` bits fewer) where a rare collision does no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

ASK = "bucket long, block long, kind int, keys binary, facts binary"
ANSWER = "block long, bucket long, kind int, facts binary"


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on: runs of equal bytes, which shuffles compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def values_of(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def sent(keys: np.ndarray, drop: int = 0) -> bytes:
    """Rising uint64 keys as bytes: one for the width, then the differences."""
    if not len(keys):
        return b""
    step = np.diff(keys >> np.uint64(drop), prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def received(data: bytes) -> np.ndarray:
    """The keys that were sent, without the bits that were dropped."""
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    raw = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, rising: by sorting, which for a block's keys takes a quarter of the time of numpy's hashed ``unique``."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each input (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))   # a new array; the rest works in place
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def plan(docs: DataFrame, block_bytes: int, bucket_factor: float, bucket_bytes: int = 8 << 20, least: int = 48,
         from_bytes: int = 30 << 30, most: int = 16) -> tuple[int, int]:
    """Numbers of blocks and buckets for the text column: ``bucket_factor`` is what a text byte sends at most. Beyond
    ``from_bytes`` of text both grow with its square root, up to ``most`` times, so that the lists that each block sends
    each bucket don't become single keys too soon."""
    size = text_bytes(docs)
    grow = min(most, max(1.0, math.sqrt(size / from_bytes)))
    return max(least, math.ceil(size / (block_bytes * grow))), max(least, math.ceil(size * bucket_factor / (bucket_bytes * grow)))


def by_hash(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """``docs`` dealt to blocks by a hash of the columns; every use of the result shares one shuffle."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("long")).repartition(blocks, "block")


def slices(keys: np.ndarray, buckets: int) -> list[slice]:
    """Rising keys are cut into ``buckets`` equal ranges of the 64-bit space."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def asks(block: int, kind: int, keys: np.ndarray, facts: np.ndarray, buckets: int, drop: int = 0, empty: bool = False) -> list[tuple]:
    """Rows of ``ASK`` of one block; with ``empty``, buckets without a key get a row too."""
    return [(i, block, kind, sent(keys[s], drop), planes(facts[s])) for i, s in enumerate(slices(keys, buckets)) if empty or s.stop > s.start]


def ask_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "block", "kind", "keys", "facts"), cols, (
        pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def answered(ask: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], fact: str, prefix: Callable | None = None) -> DataFrame:
    """``answer(which, facts, blocks)`` gets, over all entries of a bucket, the number of each entry's key, its fact
    (numpy type ``fact``) and its block, and returns a fact per entry. ``prefix(keys, answers)`` may add bytes in
    front of every reply of the bucket."""
    def run(t: pa.Table) -> pa.Table:
        lists = [received(k) for k in t["keys"].to_pylist()]
        facts = [values_of(f, fact) for f in t["facts"].to_pylist()]
        n = [len(x) for x in lists]
        keys, which = np.unique(np.concatenate(lists), return_inverse=True)
        out = answer(which, np.concatenate(facts), np.repeat(t["block"].to_numpy(), n))
        front = prefix(keys, which, np.concatenate(facts)) if prefix else b""
        parts = np.split(out, np.cumsum(n)[:-1])
        return pa.table({"block": t["block"], "bucket": t["bucket"], "kind": t["kind"], "facts": pa.array([front + planes(p) for p in parts], pa.binary())})

    return ask.groupBy("bucket", "kind").applyInArrow(run, ANSWER)


def replies(t: pa.Table, fact: str, kind: int = 0, front: int = 0) -> tuple[np.ndarray, list[bytes]]:
    """A block's answers of a kind in the order of its rising keys, and the replies' first ``front`` bytes."""
    rows = sorted((r for r in t.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    parts = [values_of(r["facts"][front:], fact) for r in rows]
    return (np.concatenate(parts) if parts else np.empty(0, fact)), [r["facts"][:front] for r in rows]
