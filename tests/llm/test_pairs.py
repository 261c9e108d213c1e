"""Passage dedup, n-gram join and top-k against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laglake.llm import exact_topk, ngram_join, suffix_dedup
from laglake.llm.graph import components


def brute_spans(rows, length):
    """(id, kept bytes, spans) of rows in order of (null last, id, text)."""
    seen, out = set(), []
    for i, raw in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(raw[p:p + length])
        edge = [k for k in range(len(raw) + 1) if (k < len(raw) and gone[k]) != (k > 0 and bool(gone[k - 1]))]
        out.append((i, bytes(b for b, g in zip(raw, gone, strict=True) if not g), list(zip(edge[::2], edge[1::2], strict=True))))
    return out


@pytest.mark.parametrize(("length", "gram", "block_bytes"), [(100, 32, 1 << 20), (100, 32, 700), (30, 8, 2000), (12, 12, 500)])
def test_suffix_dedup_equals_brute_force(docs, odd_rows, length, gram, block_bytes):
    got = suffix_dedup.suffix_dedup(docs, length, gram, block_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, bytes(r.text), [(s.start, s.stop) for s in r.spans]) for r in got), key=key) == sorted(brute_spans(odd_rows, length), key=key)


def test_suffix_dedup_digests_and_carried_columns(docs, odd_rows):
    got = {(r.doc_id, r.n_bytes, r.n_removed): r for r in suffix_dedup.digest_columns(suffix_dedup.suffix_dedup(docs)).collect()}
    for i, kept, spans in brute_spans(odd_rows, 100):
        r = got[i, len(kept) + sum(b - a for a, b in spans), sum(b - a for a, b in spans)]
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.n_spans == len(spans)
    whole = suffix_dedup.suffix_dedup(docs, carry=tuple(docs.columns), decode=True).select("rest.block", "rest.rest", "rest.doc_id").collect()
    assert sorted(r.block for r in whole) == list(range(len(odd_rows))) and all(r.block == r.rest for r in whole)


def test_suffix_sort_orders_windows(rng):
    import pyarrow as pa
    text = "".join(rng.choice("ab") for _ in range(400))
    b = suffix_dedup.Block(pa.table({"doc_id": [1], "text": [text]}), 20, 5)
    at = np.arange(0, 380)
    order = suffix_dedup.suffix_sort(b, at, np.zeros(len(at), int))
    assert order.tolist() == sorted(range(380), key=lambda k: (text[k:k + 20], k))


def brute_components(rows, width=5, percent=80):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((rows[k][0], len(s), least.get(find(k)) if s else rows[k][0]) for k, s in enumerate(sets))


def test_ngram_join_equals_brute_force(docs, odd_rows):
    got = ngram_join.ngram_join(docs, block_bytes=3000).collect()
    assert Counter(tuple(r) for r in got) == brute_components(odd_rows)


@pytest.mark.parametrize(("chunk", "pivots", "percent"), [(96, 8, 80), (5, 1, 80), (7, 3, 70)])
def test_ngram_join_of_chains_in_chunks(spark, rng, chunk, pivots, percent):
    """Chains of near copies, whose ends aren't similar, dealt to many chunks."""
    rows, k = [], 0
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(25):
            rows.append((k, " ".join(words)))
            k += rng.randint(1, 3)
            words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words[:18] = [f"x{rng.randrange(10**6)}" for _ in range(18)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(df, chunk_sets=chunk, pivots=pivots, percent=percent, block_bytes=4000).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, percent=percent)


def test_ngram_join_sends_probes_only_to_candidates(spark, rng, monkeypatch):
    """Texts of passages that each occur in a few texts: one component of shared n-grams, no main class, few links."""
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(400)]
    dealt = passages * 4
    rng.shuffle(dealt)
    rows = [(k, " ".join(dealt[5 * k:5 * k + 5])) for k in range(320)]
    rows += [(1000 + k, rows[k][1] + f" end{k}") for k in range(0, 60, 2)]
    whole = ngram_join.compared

    def bounded(percent):
        run = whole(percent)

        def checked(t):
            assert t.num_rows <= 90, t.num_rows
            return run(t)
        return checked

    monkeypatch.setattr(ngram_join, "compared", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(df, chunk_sets=12, block_bytes=20_000).collect()
    want = brute_components(rows)
    assert Counter(tuple(r) for r in got) == want and len({c for *_, c in want}) == 320


def test_counts_keep_their_order_above_a_byte():
    counts = np.array([0, 1, 2, 100, 127, 300, 1000, 10_000, 10**6, 10**9])
    got = ngram_join.coded(counts)
    assert got[:5].tolist() == counts[:5].tolist() and (np.diff(got.astype(int)) > 0).all()
    assert all(ngram_join.band_of(m, 80) - ngram_join.band_of(n, 80) <= 1 for n in range(1, 500) for m in range(n, n * 100 // 80 + 1))


def test_overlaps_derived_from_a_similar_set(rng):
    universe = np.arange(400, dtype=np.uint64) * np.uint64(7919)
    sets = [np.sort(rng.choices(universe.tolist(), k=80)) for _ in range(6)]
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    sets += [np.unique(np.concatenate([s[:-4], [np.uint64(10**9 + k)]]).astype(np.uint64)) for k, s in enumerate(sets)]
    classes = ngram_join.Classes(len(sets))
    ngram_join.links(sets, sets, 60, classes)
    expected = {(a, b) for a in range(12) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 60 * len(set(sets[a]) | set(sets[b]))}
    assert expected and all(classes.find(a) == classes.find(b) for a, b in expected)


def test_representatives_keep_one_of_each(docs):
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter({i: 1 for i in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 15, 16, 17)}) + Counter({8: 1})
    assert ids.count(None) == 1   # the copy without an id goes, the row without text stays


def test_representatives_without_ids_and_with_repeated_ones(spark, rng):
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(40)) for x in "abc")
    rows = [(None, a, 1), (None, a, 2), (3, a, 3), (3, a + " ", 4), (4, a, 5),              # one stays, with id 3
            (None, b, 6), (None, b, 7), (None, b.upper(), 8), (None, b + " end", 9),        # no id at all: one stays
            (7, c, 10), (7, c, 11), (7, a + " tail", 12),                                   # 7 also names a copy of the first
            (None, "", 13), (None, "", 14), (9, None, 15), (9, "", 16), (9, " ", 17)]       # no words: equal ones once
    df = spark.createDataFrame(rows, "doc_id long, text string, _i int")
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns
    got = sorted((r for r in kept.collect()), key=lambda r: r[2])
    found = [(r.doc_id, r.text) for r in got]
    assert sum(t is not None and t.strip().lower().startswith(a[:30]) for _, t in found) == 1 and {i for i, t in found if t in (a, a + " ")} == {3}
    assert sum(t is not None and t.lower().startswith(b[:30]) for _, t in found) == 1
    assert found.count((7, c)) == 1 and sum(i == 7 for i, _ in found) == 1
    assert [(i, t) for i, t in found if not (t or "").strip()] and Counter((i, t) for i, t in found if not (t or "").strip()) == Counter(
        [(None, ""), (9, None), (9, ""), (9, " ")])
    again = ngram_join.representatives(df.repartition(7))
    assert sorted(again.collect(), key=lambda r: r[2]) == got


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_top(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [float(np.floor(256 * float(x))) for x in v]
            ok[i] = min(ok.get(i, w), w)
    out = []
    for q, v in ok.items():
        if q % 5 == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), c) for c, w in ok.items() if c != q and len(w) == len(v))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def test_topk_with_odd_vectors_and_small_tiles(spark, rng):
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (5, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5]), (300, [1.0, 2.0]), (301, []), (305, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, block int, score int")
    for shard, fan in ((4096, 8), (7, 2), (30, 3)):
        got = exact_topk.exact_topk(df, F.col("vec_id") % 5 == 0, block_rows=6, shard_rows=shard, fan=fan)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5)
    assert exact_topk.exact_topk(df.where("false"), F.col("vec_id") % 5 == 0).collect() == []


def test_topk_of_huge_components_is_exact():
    a = np.array([[2.0 ** 40, 1.0], [3.0, 2.0 ** 30]])
    assert exact_topk.product(a, a).tolist() == [[2 ** 63 - 1, 3 * 2 ** 40 + 2 ** 30], [3 * 2 ** 40 + 2 ** 30, 9 + 2 ** 60]]


def test_topk_sieve_loses_no_pair():
    """Rounded and packed products find what exact ones do, and keep few pairs of vectors that aren't alike."""
    r = np.random.default_rng(4)

    def unit(n: int, d: int = 16) -> np.ndarray:
        x = r.normal(size=(n, d))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    tight, shares = unit(1) + 0.1 * unit(900), unit(900)
    shares[::3] = shares[0]
    tables = {"apart": unit(900), "tight": tight, "copies": shares, "norms": unit(900) * np.exp(3 * r.normal(size=(900, 1))), "zero": np.zeros((900, 4)),
              "signs": np.sign(unit(900, 5)), "one component": unit(900, 1), "large": unit(900) * 1e5, "negative": -np.abs(unit(900)), "wide": unit(900, 300)}
    for name, x in tables.items():
        v = np.floor(256 * x)
        ids = r.permutation(900) * 10 - 4000
        asked = ids % 70 == 0
        scores = v[asked] @ v.T
        want = [[(int(-s), int(i)) for s, i in sorted((-int(s), i) for s, i in zip(row, ids, strict=True) if i != own)[:3]] for row, own in zip(scores, ids[asked], strict=True)]
        third = np.array([w[-1][0] for w in want], float)
        for floor in (None, third, np.where(np.arange(len(third)) % 2 == 0, third - 5, -np.inf)):
            found = exact_topk.search(ids[asked], v[asked], ids, v, 3, 50, 60, 0, floor)
            assert [[*zip(s[:c].tolist(), i[:c].tolist(), strict=True)] for s, i, c in zip(found.scores, found.ids, found.count, strict=True)] == want, name
    v = np.floor(256 * unit(4000, 64))
    side = exact_topk.LIMIT ** 0.5 - 0.5
    c = exact_topk.Rounded(v, side, False)
    row, col = exact_topk.sieved(exact_topk.Rounded(v[:512], side, True), np.full(512, 0.5 * 65536), c, exact_topk.packed(c), 4000, 1.0)
    real = {*zip(*(x.tolist() for x in np.nonzero(v[:512] @ v.T >= 0.5 * 65536)), strict=True)}
    assert real <= {*zip(row.tolist(), col.tolist(), strict=True)} and len(row) < 0.01 * 512 * 4000


def test_topk_with_spans_searched_before(spark, rng):
    """Several spans and groups, the k-th best scores of one span known to the others; repeated ids of several lengths."""
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(400)]
    rows += [(i, [round(rng.uniform(-1, 1), 1) for _ in range(rng.choice((2, 3)))]) for i in range(0, 400, 7)] + [(i, [1e6 * rng.random(), -1.0, 0.5]) for i in (1000, 1005)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute_top(rows, 5)
    for block, shard, fan, span, sieve in ((8, 8, 3, 64, 0), (16, 20, 2, 30, 10), (1024, 4096, 8, 32, 0)):
        got = exact_topk.exact_topk(df, F.col("vec_id") % 5 == 0, block_rows=block, shard_rows=shard, fan=fan, span_rows=span, sieve_from=sieve)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_topk_query_copies_grow_with_the_table(spark, monkeypatch):
    """A query goes to a bounded number of spans until these are large: no copy for each shard of the table."""
    sent, plain = [], exact_topk.pieces
    monkeypatch.setattr(exact_topk, "pieces", lambda *a, **b: sent.append(plain(*a, **b)) or sent[-1])
    for n in (2000, 4000):
        df = spark.range(n, numPartitions=2).selectExpr("id vec_id", "array(float(sin(id)), float(cos(id)))  embedding")
        exact_topk.exact_topk(df, F.col("vec_id") % 5 == 0, block_rows=8, shard_rows=8)
    few, many = (x.agg(F.sum(F.octet_length("m"))).first()[0] for x in sent)
    assert many < 2.5 * few
    spans, groups, _ = exact_topk.dealt(15_000_000, 300_000, 1024, 4096, 1 << 18)
    assert 15_000_000 * groups + 300_000 * spans < 5 * 15_000_000


def test_empty_tables(nothing):
    assert suffix_dedup.suffix_dedup(nothing).collect() == []
    assert ngram_join.ngram_join(nothing).collect() == []


def test_passage_blocks_hold_like_amounts(spark):
    """Long texts in a row, null ids, one repeated id and equal rows without an id are all dealt by bytes."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    same = word(20_000)
    rows = [(i, word(40_000 if i < 96 else 20)) for i in range(960)] + [(None, word(9_000)) for _ in range(200)] + [(7, word(9_000)) for _ in range(200)]
    rows += [(None, same)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.dealt(df, 48).collect()
    size, low = Counter(), {}
    for x in got:
        size[x.block] += len(x.text)
    total = sum(size.values())
    assert total == sum(len(t) for _, t in rows) and max(size.values()) <= 2 * total / 48 + 40_000
    # blocks follow the order of documents
    for x in got:
        k = (x.doc_id is None, x.doc_id or 0, x.text[:16])
        low[x.block] = (min(low.get(x.block, (k, k))[0], k), max(low.get(x.block, (k, k))[1], k))
    spans = [low[b] for b in sorted(low)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_gram_keys_spread_over_all_buckets(rng):
    import pyarrow as pa

    from laglake.llm.exchange import slices
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    b = suffix_dedup.Block(pa.table({"doc_id": [1], "text": [text]}), 100, 32)
    sizes = [s.stop - s.start for s in slices(np.unique(b.key), 16)]
    assert max(sizes) < 2 * sum(sizes) / 16


def test_blocks_are_hashed_in_pieces(rng, monkeypatch):
    """The same anchors and hashes wherever pieces end, and few arrays as long as the block."""
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(90))) for _ in range(60)] + ["", None, "é" * 40]
    t = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    plain = suffix_dedup.Block(t, 20, 5)
    for piece in (1, 7, 64):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        b = suffix_dedup.Block(t, 20, 5)
        for name in ("prefix", "first", "anchor", "count", "key"):
            assert np.array_equal(getattr(b, name), getattr(plain, name)), name
    data = bytes(plain.data)
    for i, n in ((0, 20), (len(data) - 20, 20), (3, len(data) - 3)):
        assert int(plain.hashes(np.array([i]), n)[0]) == sum((c + 1) * pow(suffix_dedup.BASE, j, 1 << 64) for j, c in enumerate(data[i:i + n])) % (1 << 64)
    monkeypatch.undo()
    n = 1 << 20
    t = pa.table({"doc_id": [1], "text": [bytes(rng.choices(b"abcdefgh ", k=n)).decode()]})
    tracemalloc.start()
    b = suffix_dedup.Block(t, 100, 32)
    assert tracemalloc.get_traced_memory()[1] < 24 * n   # 8 for the prefix hashes, 3 for copies of the text
    tracemalloc.stop()
    k = suffix_dedup.Known(b)
    at, h = k.open_windows(np.full(len(k.grams), suffix_dedup.SEVERAL, np.uint8))
    assert sorted(at.tolist()) == list(range(n - 99))
    keys = np.unique(h)
    del h
    gone = k.marked(np.full(len(k.grams), suffix_dedup.SEVERAL, np.uint8), (np.arange(len(keys)) % 50 == 0).astype(np.uint8))
    assert 0 < gone.sum() <= n
