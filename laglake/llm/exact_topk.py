"""Exact top-k search: tiled matrix products of query blocks and candidate shards, partial selection in each
tile, and tree merging of the per-query top lists.

Vectors become integers floor(scale * x). Candidates are dealt to spans and queries to groups by a hash of the
id; a task gets one span and one group, cuts them into tiles (a query block meeting a candidate shard) and keeps
the k best of each query. The lists of ``fan`` spans at a time are merged until one per query is left.

A task's first shard is multiplied exactly. After that a query's k-th best score so far is known (in a large table from
the start, by a search of two spans before the others), and shards are sieved: both sides are rounded to about six bits,
four candidates share one float64 (fields of 13 bits), so one product bounds four scores from above. Only pairs whose
bound reaches the k-th best are multiplied exactly; Cauchy-Schwarz on the rounding errors makes the bound hold for every
pair. Where the sieve keeps too much (data much alike, many dimensions), a block goes back to exact products. Selection
always is by exact scores.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no
part. An id stands for one vector: of repeated ids the smallest vector (in array order) counts. Only vectors of
equal length are compared. Ties go to the smaller id. A query without candidates has no rows. Floors are held to the long
range. Products are exact: floats while every partial sum stays below 2^24 (float32) or 2^53 (float64), Python integers
otherwise (held to the long range).

Scale: every query meets every row. A query is sent once to each span and a row once to each group, as packed integers of
two bytes, so what is shuffled is rows * queries / span_rows twice; nothing is broadcast or collected. A task holds
one span, one group and one tile of scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.session import materialize

from .common import map_batches, table

PIECE = "span long, part long, asked boolean, dim int, wide boolean, ids binary, m binary"
LISTS = "block long, part long, query_ids binary, counts binary, ids binary, scores binary"
HITS = "query_id long, rank int, vec_id long, score long"
#: Fields of a packed number; the largest product of two rounded vectors; rows of a tile whose fields are tested together.
FIELD, LIMIT, TOGETHER = 13, 2047, 16
#: Signs of the four fields, and what one unit in each of them adds. The last is negated, as its sign is the top bit.
SIGNS = sum(1 << (FIELD * f + FIELD - 1) for f in range(4))
UNITS = np.array([1.0, 2.0 ** FIELD, 2.0 ** (2 * FIELD), -2.0 ** (3 * FIELD)])
#: Added so that the integer is in the low 52 bits of the float64.
BASE = 1.5 * 2.0 ** 52
#: Spans that are searched before the others where the table is large.
FIRST = 2
#: Rows and columns of one packed product, rows of an exact one; share of kept pairs beyond which exact products are cheaper.
ROWS, COLUMNS, PLAIN, DENSE = 512, 256, 256, 0.012


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of integers (the finalizer of splitmix64)."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    ends = np.flatnonzero(x[1:] != x[:-1]) + 1
    return [*zip([0, *ends], [*ends, len(x)], strict=True)] if len(x) else []


def single(ids: list[np.ndarray], vectors: list[np.ndarray]) -> list[np.ndarray]:
    """Masks of the rows that count, for pieces of ids and vectors: one row per id, the smallest vector in array order."""
    keep = [np.ones(len(i), bool) for i in ids]
    every = np.concatenate(ids)
    order = np.argsort(every, kind="stable")
    again = np.flatnonzero(every[order][1:] == every[order][:-1]) + 1
    if not len(again):
        return keep
    which = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    start = np.cumsum([0, *(len(i) for i in ids)])

    def vector(at: int) -> tuple[int, int, list]:
        d, row = which[at], at - start[which[at]]
        return d, row, vectors[d][row].tolist()

    for run in np.split(again, np.flatnonzero(np.diff(again) > 1) + 1):
        d, row, least = vector(order[run[0] - 1])
        for at in order[run]:
            other = vector(at)
            gone = (d, row) if other[2] < least else other[:2]
            keep[gone[0]][gone[1]] = False
            if other[2] < least:
                d, row, least = other
    return keep


def pieces(vectors: DataFrame, is_query: Column, scale: int, spans: int, groups: int, blocks: int, id_col: str, vec_col: str,
           low: int = 0, high: int = 0) -> DataFrame:
    """Valid vectors as floor(scale * x), packed by span (candidates, once for each group) and by group (queries, once for
    each span). Rows of ``span`` and ``part``, the group, meet in one task. Only spans from ``low`` on; with ``high``, those
    before it, as one."""
    def quantized(b: pa.RecordBatch) -> tuple[list[np.ndarray], ...]:
        lists = b.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)   # nulls become nan
        offsets = lists.offsets.to_numpy().astype(np.int64)
        dims, first = np.diff(offsets), offsets[:-1] - offsets[0]
        fine = np.ones(len(dims), bool)
        finite = np.isfinite(flat)
        if not finite.all():
            fine[np.repeat(np.arange(len(dims)), dims)[~finite]] = False
        ids, asked, span = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
        out = [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.clip(np.floor(flat * scale), -2.0 ** 63, 2.0 ** 63) + 0.0
        for d in np.unique(dims[fine]):
            rows = np.flatnonzero(fine & (dims == d))
            at = first[rows][:, None] + np.arange(d)
            for o, x in zip(out, (ids[rows], asked[rows], span[rows], whole[at]), strict=True):
                o.append(x)
        return out

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.split()[0]: [] for f in PIECE.split(", ")}

        def cut(ids: list[np.ndarray], place: list[np.ndarray], v: list[np.ndarray], asked: bool) -> None:
            for i, to, x, keep in zip(ids, place, v, single(ids, v) if ids else (), strict=True):
                order = np.flatnonzero(keep)
                order = order[np.argsort(to[order], kind="stable")]
                wide = bool(np.abs(x).max(initial=0) > 32767)
                i, to, x = i[order].astype("<i8"), to[order], x[order].astype("<f8" if wide else "<i2")
                for a, e in runs(to):
                    row = {"span": None if asked else int(to[a]), "part": int(to[a]) if asked else None, "asked": asked,
                           "dim": x.shape[1], "wide": wide, "ids": i[a:e].tobytes(), "m": x[a:e].tobytes()}
                    for c, value in row.items():
                        out[c].append(value)

        ids, asked, span, v = quantized(b)
        own = [(s >= low) & (s < (high or spans)) for s in span]
        place = [np.full_like(s, low) if high else s for s in span]
        cut(*([x[o] for x, o in zip(c, own, strict=True)] for c in (ids, place, v)), False)
        part = [(mixed(i) % np.uint64(blocks) % np.uint64(groups)).astype(np.int64) for i in ids]
        cut(*([x[o] for x, o in zip(c, asked, strict=True)] for c in (ids, part, v)), True)
        return out

    x = F.col(vec_col)
    if vectors.select(vec_col).dtypes[0][1] != "array<float>":
        x = x.cast("array<double>")
    rows = (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), x.alias("v"), F.coalesce(is_query.cast("boolean"), F.lit(False)).alias("asked"),
                    F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(spans)).alias("span")))
    if low or high:
        rows = rows.where(F.col("asked") | F.col("span").between(low, (high or spans) - 1))
    whole = lambda a, b: F.sequence(F.lit(a), F.lit(b - 1)).cast("array<long>")
    cuts = map_batches(rows, run, PIECE)
    return (cuts.withColumn("copy", F.explode(F.when(F.col("asked"), whole(low, low + 1 if high else spans)).otherwise(whole(0, groups))))
            .select(F.coalesce("span", "copy").alias("span"), F.coalesce("part", "copy").alias("part"), "asked", "dim", "wide", "ids", "m"))


def gathered(t: pa.Table, asked: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and integer vectors by dimension, one row per id, ordered by a hash of the id."""
    dims, wide, ids, m = [], [], [], []
    for flag, d, w, i, x in zip(*(t[c].to_pylist() for c in ("asked", "dim", "wide")), t["ids"], t["m"], strict=True):
        if flag is asked:
            dims.append(d)
            wide.append(w)
            ids.append(np.frombuffer(i.as_buffer(), "<i8"))
            m.append(np.frombuffer(x.as_buffer(), "<f8" if w else "<i2").reshape(len(ids[-1]), d))
    out = {}
    keep = single(ids, m) if ids else []
    for d in sorted(set(dims)):
        some = [n for n, x in enumerate(dims) if x == d]
        every = np.concatenate([ids[n][keep[n]] for n in some])
        order = np.argsort(mixed(every), kind="stable")
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        whole = np.empty((len(every), d), "<f8" if any(wide[n] for n in some) else "<i2")
        at = 0
        for n in some:
            rows = m[n][keep[n]]
            whole[place[at:at + len(rows)]] = rows
            at += len(rows)
        out[d] = every[order], whole
    return out


def largest(m: np.ndarray) -> float:
    """The largest norm of the rows."""
    return max((float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max()) for x in np.array_split(m, 1 + len(m) // 65536) if x.size), default=0.0)


def exact_kind(a: np.ndarray, b: np.ndarray) -> type | None:
    """The float type in which products of rows are exact: no sum of some of their terms is beyond the product of the norms."""
    most = 1.001 * largest(a) * largest(b)
    return np.float32 if most < 2.0 ** 24 else np.float64 if most < 2.0 ** 53 else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact int64."""
    if kind := exact_kind(a, b):
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    edge = 2 ** 63 - 1
    return np.array([[max(-edge - 1, min(edge, sum(p * q for p, q in zip(x, y, strict=True)))) for y in whole[1]] for x in whole[0]],
                    dtype=np.int64).reshape(len(a), len(b))


def firsts(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best of each group (largest score, then smallest id), in order, and their places from 0."""
    order = np.lexsort((ids, ~scores, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=g[:1] - 1))
    place = np.arange(len(g)) - np.repeat(start, np.diff(start, append=len(g)))
    return order[place < k], place[place < k]


class Best:
    """The k best candidates of each query so far, of those that reach its ``floor``."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(queries, -np.inf) if floor is None else floor
        self.count = np.zeros(queries, np.int64)
        self.ids, self.scores = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def least(self, rows: slice) -> np.ndarray:
        """What a score must reach to be among the k best; -inf where nothing is known."""
        return np.where(self.count[rows] == self.k, self.scores[rows, -1].astype(np.float64), self.floor[rows])

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        full = self.count[row] == self.k
        last = self.scores[row, -1]
        ahead = ~full | (scores > last) | ((scores == last) & (ids < self.ids[row, -1]))
        row, ids, scores = row[ahead], ids[ahead], scores[ahead]
        if not len(row):
            return
        old = np.unique(row)
        r, c = np.nonzero(np.arange(self.k) < self.count[old][:, None])
        row, ids, scores = np.concatenate([old[r], row]), np.concatenate([self.ids[old[r], c], ids]), np.concatenate([self.scores[old[r], c], scores])
        at, place = firsts(row, ids, scores, self.k)
        self.ids[row[at], place], self.scores[row[at], place] = ids[at], scores[at]
        ends = np.flatnonzero(np.diff(row[at], append=-1))
        self.count[row[at][ends]] = place[ends] + 1


def tile_hits(s: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a tile of scores among which each row's k best are, whichever one column is left out. Maxima of
    column groups give a score that k + 1 columns reach, and show where such columns are."""
    m, n = s.shape
    many = min(n, -(-16 * (k + 1) // 64) * 64)
    wide = n // many
    groups = s[:, :many * wide].reshape(m, wide, many)
    tops = groups.max(axis=1) if wide > 1 else groups[:, 0]
    edge = np.maximum(least, np.partition(tops, many - 1 - k, axis=1)[:, many - 1 - k]) if many > k else least
    edge = edge.astype(s.dtype)
    g, j = np.divmod(np.flatnonzero(tops >= edge[:, None]), many)
    at = np.flatnonzero(groups[g, :, j] >= edge[g][:, None])
    h, w = np.divmod(at, wide)
    rest, last = np.divmod(np.flatnonzero(s[:, many * wide:] >= edge[:, None]), max(1, n - many * wide))
    at = np.sort(np.concatenate([g[h] * n + w * many + j[h], rest * n + many * wide + last]))
    row, col = np.divmod(at, n)
    if len(at) > 8 * (k + 1) * m:   # many ties at the edge: columns are in the order of ids, so a row's first k + 1 do
        tie = s[row, col] == edge[row]
        before = np.cumsum(tie) - tie
        begins = np.searchsorted(row, np.arange(m))
        rank = before - before[np.minimum(begins, len(at) - 1)][row]
        keep = ~tie | (rank <= k)
        row, col = row[keep], col[keep]
    return row, col


class Rounded:
    """Rows scaled to the norm ``size`` at most and rounded: integers, what one unit is worth, the norm of the rounding error."""

    def __init__(self, m: np.ndarray, size: float, each: bool):
        x = m.astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        self.norm = float(norm.max(initial=0.0))
        one = np.maximum(norm if each else np.full(len(m), self.norm), 1e-300)
        while True:
            self.unit = one / size
            self.whole = np.rint(x / self.unit[:, None])
            most = float(np.sqrt((self.whole ** 2).sum(axis=1)).max(initial=0.0))
            if most * most <= LIMIT:
                break
            size *= 0.999 * math.sqrt(LIMIT) / most
        self.most = np.sqrt((self.whole ** 2).sum(axis=1))
        x -= self.whole * self.unit[:, None]
        self.error = np.sqrt((x * x).sum(axis=1))
        self.whole = self.whole.astype(np.int8)   # norms are below 46


def packed(c: Rounded) -> np.ndarray:
    """(dimensions + 1, candidates / 4): four candidates in a number; below them ones, by which a query's own number is added."""
    n, d = c.whole.shape
    four = np.zeros((-(-n // 4) * 4, d))
    four[:n] = c.whole
    return np.ascontiguousarray(np.vstack([np.einsum("nfd,f->dn", four.reshape(-1, 4, d), UNITS), np.ones(len(four) // 4)]))


def sieved(q: Rounded, least: np.ndarray, c: Rounded, four: np.ndarray, many: int, most: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and columns of the pairs whose score can be ``least`` or more; None if they are more than the share ``most``.

    With q = u Q + e and c = w C + f, q.c is at most u w Q.C + |u Q| |f| + |e| |c|. A field holds Q.C less a whole number below
    what it must reach; where Q.C reaches it, the field's sign is clear (a borrow from the fields below takes 1 at most)."""
    m, n = len(least), four.shape[1]
    far, size = float(c.error.max(initial=0.0)), c.norm
    unit = float(c.unit[0])
    room = (q.unit * q.most * far + q.error * size) * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(least)
    with np.errstate(divide="ignore", over="ignore"):
        reach = np.clip(np.ceil((least - room) / (q.unit * unit)) - 1, -LIMIT - 1, LIMIT)
    rows = -(-m // TOGETHER) * TOGETHER
    a = np.zeros((rows, four.shape[0]))
    a[:m, :-1] = q.whole
    a[:, -1] = BASE - LIMIT * UNITS.sum()
    a[:m, -1] = BASE - reach * UNITS.sum()
    out_r, out_c, kept = [], [], 0
    buffer = np.empty((min(rows, ROWS), min(n, COLUMNS)))
    for at in range(0, n, COLUMNS):
        part = np.ascontiguousarray(four[:, at:at + COLUMNS])
        for low in range(0, rows, ROWS):
            some = a[low:low + ROWS]
            x = np.matmul(some, part, out=buffer[:len(some)] if part.shape[1] == buffer.shape[1] else None)
            x = x.view(np.int64).reshape(-1, TOGETHER, part.shape[1])
            g, j = np.divmod(np.flatnonzero((np.bitwise_and.reduce(x, axis=1) & SIGNS) != SIGNS), x.shape[2])
            if not len(g):
                continue
            near = x[g, :, j].ravel()
            h = np.flatnonzero((near & SIGNS) != SIGNS)
            value, (h, r) = near[h], np.divmod(h, TOGETHER)
            r, j = low + g[h] * TOGETHER + r, (at + j[h]) * 4
            for f in range(4):
                hit = value & (1 << (FIELD * f + FIELD - 1)) == 0
                out_r.append(r[hit])
                out_c.append(j[hit] + f)
                kept += len(out_r[-1])
        if kept > most * m * max(4 * (at + COLUMNS), many // 8):
            return None
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    r, c_ = np.concatenate(out_r), np.concatenate(out_c)
    real = (r < m) & (c_ < many)
    return r[real], c_[real]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block_rows: int, shard_rows: int, sieve_from: int = 0,
           floor: np.ndarray | None = None) -> Best:
    """The k best candidates of every query but itself, of those whose score reaches ``floor``. Candidates come in an order
    that has nothing to do with their scores, so few of the later ones are better than the k best so far."""
    found, kind = Best(len(q_ids), k, floor), exact_kind(q, c)
    blocks = [slice(a, min(a + block_rows, len(q_ids))) for a in range(0, len(q_ids), block_rows)]
    rounded: list[Rounded | None] = [None] * len(blocks)
    side = math.sqrt(LIMIT) - 0.5
    buffer = np.empty((min(PLAIN, len(q_ids)), min(shard_rows, len(c_ids))), kind or np.int64)

    def add(b: slice, row: np.ndarray, col: np.ndarray, scores: np.ndarray) -> None:
        ids = shard_ids[col]
        other = ids != q_ids[b][row]
        found.add(row[other] + b.start, ids[other], scores[other].astype(np.int64))

    at = 0
    while at < len(c_ids):
        known = 2 * len(c_ids) if floor is not None else at   # without a floor short steps at first, as much is found in them
        many = min(max(shard_rows, min(4 * shard_rows, known // 2)), len(c_ids) - at)
        order = at + np.argsort(c_ids[at:at + many], kind="stable")
        shard_ids, shard, four, plain = c_ids[order], c[order], None, None
        for n, b in enumerate(blocks):
            least = found.least(b)
            if kind and q.shape[1] and len(q) >= sieve_from and np.isfinite(least).all():
                if four is None:
                    whole = Rounded(shard, side, False)
                    four = packed(whole)
                if rounded[n] is None:
                    rounded[n] = Rounded(q[b], side, True)
                hits = sieved(rounded[n], least, whole, four, many, DENSE)
                if hits is not None:
                    for low in range(0, len(hits[0]), 1 << 13):
                        row, col = (x[low:low + (1 << 13)] for x in hits)
                        scores = np.einsum("nd,nd->n", q[b].take(row, axis=0).astype(kind), shard.take(col, axis=0).astype(kind))
                        near = scores >= found.least(b)[row]
                        add(b, row[near], col[near], scores[near])
                    continue
            if kind is None:
                for low in range(0, many, shard_rows):
                    scores = product(q[b], shard[low:low + shard_rows])
                    row, col = np.divmod(np.arange(scores.size), scores.shape[1])
                    add(b, row, col + low, scores[row, col])
                continue
            if plain is None:
                plain = [np.ascontiguousarray(shard[low:low + shard_rows].T, kind) for low in range(0, many, shard_rows)]
            for top in range(b.start, b.stop, PLAIN):   # few rows at a time: the scores are read again from the cache
                some = slice(top, min(top + PLAIN, b.stop))
                left = q[some].astype(kind)
                for n_, part in enumerate(plain):
                    scores = np.matmul(left, part, out=buffer[:len(left)] if part.shape[1] == buffer.shape[1] else None)
                    row, col = tile_hits(scores, found.least(some), k)
                    add(some, row, col + n_ * shard_rows, scores[row, col])
        at += many
    return found


def seeds(lists: DataFrame, k: int, low: int, spans: int, groups: int) -> DataFrame:
    """For each span from ``low`` on, pieces with the k-th best scores that a search of those before has found; ``asked`` is null."""
    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"part": [], "ids": [], "m": []}
        for block, q, n, scores in zip(*(b.column(c) for c in ("block", "query_ids", "counts", "scores")), strict=True):
            n, last = np.frombuffer(n.as_buffer(), "<i8"), np.frombuffer(scores.as_buffer(), "<i8")
            full = n == k
            out["part"].append(block.as_py() % groups)
            out["ids"].append(np.frombuffer(q.as_buffer(), "<i8")[full].tobytes())
            out["m"].append(last[np.cumsum(n)[full] - 1].tobytes())
        return out

    return (map_batches(lists, run, "part long, ids binary, m binary")
            .select(F.explode(F.sequence(F.lit(low), F.lit(spans - 1)).cast("array<long>")).alias("span"), "part", F.lit(None).cast("boolean").alias("asked"),
                    F.lit(None).cast("int").alias("dim"), F.lit(None).cast("boolean").alias("wide"), "ids", "m"))


def tile_lists(k: int, blocks: int, block_rows: int, shard_rows: int, sieve_from: int):
    """Arrow function over a span and a group: the top lists of the group's queries within the span, by block of queries.
    Where the k-th best scores of another span are there, lists have what reaches them."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in ("query_ids", "counts", "ids", "scores"))])

    def run(t: pa.Table) -> pa.Table:
        span = t["span"][0].as_py()
        asked, own = gathered(t, True), gathered(t, False)
        known = t.filter(t["asked"].is_null())
        if seeded := known.num_rows > 0:
            at, least = (np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in known[c]]) for c in ("ids", "m"))
            order = np.argsort(at)
            at, least = np.append(at[order], 0), np.append(least[order].astype(np.float64), -np.inf)
        out: list[dict] = []
        for d, (q_ids, q) in asked.items():
            if d in own:
                floor = None
                if seeded:
                    place = np.searchsorted(at[:-1], q_ids)
                    floor = np.where(at[place] == q_ids, least[place], -np.inf)
                found = search(q_ids, q, *own[d], k, block_rows, shard_rows, sieve_from, floor)
                block = (mixed(q_ids) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                order = order[found.count[order] > 0]
                for a, e in runs(block[order]):
                    rows = order[a:e]
                    full = np.arange(k) < found.count[rows][:, None]
                    out.append({"block": int(block[rows[0]]), "part": span, "query_ids": q_ids[rows].astype("<i8").tobytes(),
                                "counts": found.count[rows].astype("<i8").tobytes(), "ids": found.ids[rows][full].astype("<i8").tobytes(),
                                "scores": found.scores[rows][full].astype("<i8").tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def merged(k: int, last: bool):
    """Arrow function over the lists of some spans for one block of queries: the k best of each query, as one row of lists or
    (the last time) as rows."""
    def run(t: pa.Table) -> pa.Table:
        q, n, ids, scores = (np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in t[c]]) for c in ("query_ids", "counts", "ids", "scores"))
        q = np.repeat(q, n)
        at, place = firsts(q, ids, scores, k)
        q, ids, scores = q[at], ids[at], scores[at]
        if last:
            return pa.table({"query_id": q, "rank": (place + 1).astype(np.int32), "vec_id": ids, "score": scores})
        first = np.flatnonzero(place == 0)
        lists = (q[first], np.diff(first, append=len(q)), ids, scores)
        return pa.table({"block": [t["block"][0].as_py()], "part": [t["part"][0].as_py()]}
                        | {c: pa.array([x.astype("<i8").tobytes()], pa.binary()) for c, x in zip(("query_ids", "counts", "ids", "scores"), lists, strict=True)})

    return run


def dealt(rows: int, asked: int, block_rows: int, shard_rows: int, span_rows: int) -> tuple[int, int, int]:
    """Spans of candidates, groups and blocks of queries: spans of ``span_rows``, smaller ones if they were fewer than 32;
    groups of half as many."""
    spans = max(1, math.ceil(rows / max(0.75 * shard_rows, min(span_rows, rows / 32))))
    return spans, max(1, math.ceil(2 * asked / span_rows)), max(1, math.ceil(asked / (0.75 * block_rows)))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 1024,
               shard_rows: int = 4096, fan: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", span_rows: int = 1 << 18,
               sieve_from: int = 4096) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id as ``vec_id`` and its integer score. A task with fewer than ``sieve_from``
    queries doesn't sieve: its candidates would cost more to round than to multiply."""
    rows, asked = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    spans, groups, blocks = dealt(rows, asked, block_rows, shard_rows, span_rows)
    tops = tile_lists(k, blocks, block_rows, shard_rows, sieve_from)
    first = FIRST if rows > 4 * span_rows else 0
    tiles = pieces(vectors, is_query, scale, spans, groups, blocks, id_col, vec_col, first)
    if first:
        few = max(1, math.ceil(asked / (span_rows / 16)))
        start = pieces(vectors, is_query, scale, spans, few, blocks, id_col, vec_col, 0, first)
        known = materialize(start.groupBy("span", "part").applyInArrow(tops, LISTS), "topk-first")
        tiles = tiles.unionByName(seeds(known, k, first, spans, groups))
    lists = tiles.groupBy("span", "part").applyInArrow(tops, LISTS)
    if first:
        lists = lists.unionByName(known)
    while True:
        last = spans <= fan
        lists = lists.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(merged(k, last), HITS if last else LISTS)
        if last:
            return lists
        spans = math.ceil(spans / fan)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 50; every other row is a candidate; the 5 best."""
    return exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
