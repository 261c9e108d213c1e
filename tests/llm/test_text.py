"""Mixing, quality rules, toxicity, language, LM scores, packing and archives against plain versions."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from laglake.llm import bestfit_packing, language_id, lm_scoring, mix_sources, quality_rules, toxicity, warc
from laglake.llm.bpe import Bpe


def words(text):
    return (text or "").encode().split()


# mixing


def plain_targets(sizes):
    """Reshare what capped sources can't take until none is above its cap."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(None if k == 3 else f"s{k}", int(rng.integers(0, 10 ** rng.integers(1, 6)))) for k in range(11)]
    got = {r.source: r.target for r in mix_sources.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = plain_targets(dict(rows))
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mix_of_odd_rows(docs, nothing, limit):
    m = mix_sources.mix(docs, broadcast_rows=limit)
    rows = m.collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["_mix"]["size"] == len(words(r.text))
        sizes[r.source] += r["_mix"]["size"]
    want = plain_targets(dict(sizes))
    for r in rows:
        x = r["_mix"]
        assert x.source_size == sizes[r.source] and math.isclose(x.target, want[r.source], rel_tol=1e-9)
        coin = int(hashlib.md5(f"{'null' if r.doc_id is None else r.doc_id}:7".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert x.copies == math.floor(x.rate) + (coin < x.rate - math.floor(x.rate)) <= 3
    out = mix_sources.expand(m)
    assert out.columns == docs.columns and out.count() == sum(r["_mix"].copies for r in rows)
    assert mix_sources.mix(nothing).collect() == []


# quality


def plain_base(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for k in range(len(w) - 2):
        if grams[w[k], w[k + 1], w[k + 2]] > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(line.encode().split())
        seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(x.decode().count(c) for x in w for c in "#*$%&|<>"), dup, len(hit)


def test_quality_base_counts(docs, nothing, odd_rows, rng):
    got = quality_rules.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *plain_base(t)) for i, t in odd_rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(nothing).collect() == []
    for _ in range(200):
        t = "".join(rng.choice("ab \n#|") for _ in range(rng.randint(0, 60)))
        assert quality_rules.judge(t, quality_rules.Bands(), zstandard.ZstdCompressor())[:5] == plain_base(t)


def test_compression_bands(rng):
    bands, packer = quality_rules.Bands(), zstandard.ZstdCompressor()
    good = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    noise = base64.b85encode(rng.randbytes(20_000)).decode()
    noise = " ".join(noise[k:k + 9] for k in range(0, len(noise), 9))
    judge = lambda t: quality_rules.judge(t, bands, packer)
    assert judge(good)[-1] and not judge(noise)[-1]
    assert not judge(" ".join(f"line {k % 3} of the same boiler plate words" for k in range(500)))[-1]
    half = good[:6000] + noise[:9000]
    assert judge(half)[7] > 0.5 * judge(half)[6] and not judge(half)[-1]


def test_encoded_text_goes_and_prose_stays(rng):
    bands, packer = quality_rules.Bands(), zstandard.ZstdCompressor()
    judge = lambda t: quality_rules.judge(t, bands, packer)
    encoded = lambda n: "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(n // 77 + 1))[:n]
    letters = {"en": "etaoinshrdlu", "fr": "esaitnruléèà", "de": "enisratdhuöß", "es": "eaosrnidlñóí"}
    for alphabet in letters.values():
        clean = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(5000))
        for n in (600, 1000, 1500, 2000, 2999, 3001, 20_000):
            assert judge(clean[:n])[-1], n
        assert judge(clean[:2000])[7] == 1 and judge(clean[:20_000])[8] == 0
        for share in (0.4, 0.5, 0.6, 0.8):
            block = int(20_000 * share)
            mixed = judge(clean[:7000] + " " + encoded(block) + " " + clean[7000:27_000 - block - 7000])
            assert mixed[8] >= block // 2000 - 1 and not mixed[-1], share
    for n in (700, 1000, 1500, 2000, 3000, 30_000):
        spaced = " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(n))[:n]
        assert not judge(spaced)[5] and not judge(spaced)[-1], n


# toxicity


def plain_segments(scores):
    """Ruzzo and Tompa's maximal subsequences by their definition: the best segment, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], best[3]
    return plain_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]


def test_segments_equal_definition(rng):
    for _ in range(150):
        known = {k: rng.choice([1.37, 2.11, -0.83, 3.77, 0.59]) for k in range(rng.randint(0, 14)) if rng.random() < 0.6}
        n = rng.randint(max(known, default=0) + 1, 16)
        scores = [known.get(k, -0.7) for k in range(n)]
        got = toxicity.segments(sorted(known), [known[k] for k in sorted(known)], -0.7)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


@pytest.fixture(scope="module")
def marked(spark, rng):
    from conftest import prose
    rows, labels = [], []
    for k in range(500):
        t = prose(rng, rng.randint(5, 120)).split(" ")
        toxic = k % 5 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["Scum", "idiot,", "vilewort", "vileword"]))
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    labels += [(None, 1), (3, None), (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_passages(marked):
    docs, labels = marked
    m = toxicity.learned(docs, labels, F.col("doc_id") % 3 != 0)
    got = toxicity.toxicity(docs, m).collect()
    wrong = [r.doc_id for r in got if r.doc_id % 3 == 0 and r.predicted != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 3
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [texts[r.doc_id][p.start:p.stop].lower() for r in got for p in r.passages]
    assert spans and sum(any(x in s for x in ("scum", "idiot", "vile")) for s in spans) > 0.95 * len(spans)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, m).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_toxicity_of_odd_rows_and_no_labels(docs, nothing, marked):
    m = toxicity.learned(*marked, F.lit(True))
    got = toxicity.toxicity(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = toxicity.learned(docs, marked[1].where("false"), F.lit(True))
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.49, 0)}
    one = toxicity.learned(marked[0], marked[1].where("toxic = 1"), F.lit(True))
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {1}
    assert toxicity.toxicity(nothing, m).collect() == []


def test_toxicity_of_few_or_unknown_labels(spark, marked):
    """Too few labels, or labels of other documents, must not reject the corpus."""
    docs, labels = marked
    unknown = labels.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10_000)
    toss = spark.range(500).select("id", F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(10)).alias("fold")).where("fold < 7 AND id > 3").collect()
    toxic, clean = [r.id for r in toss if r.id % 5 == 0], [r.id for r in toss if r.id % 5]
    table = lambda t, c: spark.createDataFrame([(i, 1) for i in toxic[:t]] + [(i, 0) for i in clean[:c]], "doc_id long, toxic int")
    for few, share in ((unknown, 0.49), (table(2, 2), 0.49), (table(1, 3), 1 / 3), (table(3, 1), 2 / 3)):
        m = toxicity.learned(docs, few, F.lit(True))
        assert {(round(r.score, 9), r.predicted) for r in toxicity.toxicity(docs, m).collect()} == {(round(share, 9), int(share > 0.5))}
        assert toxicity.without_toxic(docs, m).count() == (0 if share > 0.5 else 500)


# language


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.initial(3, 2, 1).items()}
    text, mask = language_id.padded([b"abcab", b"ca", b""], 5)
    lang = np.array([0, 2, 1])
    g, _ = language_id.gradients(w, text, mask, lang)
    for name, at in [("uf", (1, 0)), ("ub", (5, 1)), ("xf", (0, 97)), ("xb", (4, 98)), ("cf", (3, 0)), ("vf", (2, 1)), ("vb", (0, 0)), ("o", (1, 0)), ("ub", (2, 0))]:
        loss = []
        for step in (1e-3, -1e-3):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += step
            loss.append(language_id.gradients(moved, text, mask, lang)[1])
        assert abs((loss[0] - loss[1]) / 2e-3 - g[name][at]) < 2e-3, name
    assert rng is not None


def test_language_of_alphabets(spark, rng):
    kinds = {"aa": "abcdef ", "bb": "uvwxyz ", "cc": "éèàçù "}
    rows = [(k, "".join(rng.choice(kinds[lang]) for _ in range(rng.randint(30, 400))), lang) for k, lang in enumerate(sorted(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 456", "bb"), (903, "abc", None), (None, "uvw" * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    s = language_id.Settings(rows_per_lang=40, span=32, epochs=12, batch=64, block=50)
    got = {r.doc_id: r for r in language_id.language_id(df, F.coalesce(F.col("doc_id") % 4, F.lit(0)) != 2, s).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows[:180]) >= 175
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "bb"
    none = language_id.language_id(df, F.lit(False), s).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language_id.language_id(df.where("false"), F.lit(True), s).collect() == []


def test_windows_of_a_text_pool_to_its_mean():
    w = language_id.initial(2, 4, 3)
    s = language_id.Settings(hidden=4, span=16, block=3)
    texts = [b"", b"x" * 5, bytes(range(100)), b"y" * 16]
    got = language_id.pooled(w, texts, s)
    for t, row in zip(texts, got, strict=True):
        each = [language_id.probabilities(w, *language_id.padded([t[k:k + 16]], 16))[0][:, :, 0] for k in range(0, len(t), 16)]
        want = np.concatenate(each).mean(axis=0) if each else np.zeros(2)
        assert np.allclose(row, want, atol=1e-5)


# LM scores


def test_lm_scores_equal_plain_counts(docs, nothing, spark, odd_rows):
    targets = spark.createDataFrame([(5,), (6,), (6,), (15,), (None,), (999,)], "doc_id long")
    got = lm_scoring.lm_scores(docs, targets, block_bytes=2000).collect()
    models = {name: (Counter(), Counter(), Counter()) for name in ("all", "goal")}
    seqs = [(i, ["<s>", *w, "</s>"] if (w := [("w", x) for x in words(t)]) else []) for i, t in odd_rows]
    for i, q in seqs:
        for one, con, two in [models["all"]] + [models["goal"]] * (i in (5, 6, 15)):
            one.update(q[1:])
            con.update(q[:-1])
            two.update(zip(q, q[1:], strict=False))
    v = len(models["all"][0])

    def loss(q, name):
        one, con, two = models[name]
        n = sum(one.values())
        return sum(-math.log((two[a, b] + 16 * (one[b] + 1) / (n + v)) / (con[a] + 16)) for a, b in zip(q, q[1:], strict=False)) / (len(q) - 1)

    want = sorted((str(i), max(0, len(q) - 1), round(loss(q, "goal") - loss(q, "all"), 9) if q else 0.0) for i, q in seqs)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in got) == want
    assert lm_scoring.lm_scores(nothing, targets).collect() == []


# packing


def test_ids_equal_the_tokenizers_library(odd_rows, rng):
    from tokenizers import Tokenizer
    path = bestfit_packing.default_tokenizer()
    bpe, other = Bpe(path), Tokenizer.from_file(path)
    texts = [t or "" for _, t in odd_rows] + ["".join(rng.choice(" \n\t  ab.'s\x85\x1cé1") for _ in range(30)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == other.encode(t, add_special_tokens=False).ids


def test_pieces_and_sequences(docs, odd_rows, nothing):
    path = bestfit_packing.default_tokenizer()
    bpe = Bpe(path)
    got = bestfit_packing.bestfit_packing(docs, path, size=256, group_items=8).collect()
    want = []
    for i, t in odd_rows:
        ids = bpe.encode(t or "") + b"\0\0\0\0"
        n = len(ids) // 4
        at = [0, *range((n - 1) % 256 + 1, n, 256)]
        want += [(i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for some in bins.values():
        some.sort()
        assert [a for a, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 256
    assert bestfit_packing.bestfit_packing(nothing, path).collect() == []


def test_local_search_empties_bins():
    two_for_one = bestfit_packing.local_search(np.array([7, 4, 3, 3, 3], np.int64), np.array([0, 1, 0, 1, 2], np.int64), 10)
    assert len(np.unique(two_for_one)) == 2
    rng = np.random.default_rng(1)
    for size in (50, 200):
        lengths = np.sort(rng.integers(1, size, 400))[::-1].copy()
        first = bestfit_packing.best_fit(lengths, size)
        before = len(np.unique(first))
        squares = (np.bincount(first, weights=lengths) ** 2).sum()
        after = bestfit_packing.local_search(lengths, first.copy(), size)
        fill = np.bincount(after, weights=lengths)
        assert fill.max() <= size and len(np.unique(after)) <= before and (fill ** 2).sum() >= squares
        bare = bestfit_packing.local_search(lengths, np.arange(400), size)
        assert np.bincount(bare, weights=lengths).max() <= size and len(np.unique(bare)) <= 1.1 * lengths.sum() / size + 1


# archives


@pytest.fixture(scope="module")
def pages(spark):
    same = "<html>same</html>"
    rows = [(1, "http://a/\r\nx", same), (2, None, same), (3, "http://b/é", "<p>é\r\n\r\n</p>"), (4, "u", None), (5, "u", ""), (None, "v", same),
            (9, "w", same), (9, "w", same), (10, "z", "x" * 300_000), (None, "y", "only")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, salt int").repartition(3)


def plain_roles(rows, least=0):
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == raw]
        last = max((j for j in same if j is not None), default=None)
        visit = len(raw) >= least and len(same) > 1 and last is not None and i != last
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if visit else "response", last if visit else None] += 1
    return out


@pytest.mark.parametrize(("least", "archive"), [(0, 64 << 20), (10, 300)])
def test_warc_round_trip(spark, pages, tmp_path, least, archive):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(warc.marked(pages, least, salts=3), folder, archive)
    got = warc.read_warc(manifest, batch_rows=2).collect()
    rows = [tuple(r)[:3] for r in pages.collect()]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain_roles(rows, least)
    assert all(r.verified for r in got)
    assert Counter(bytes(r.payload) for r in got if r.payload is not None) <= Counter((h or "").encode() for *_, h in rows)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_warc_reader_rejects_damage(spark, pages, tmp_path):
    manifest = warc.write_warc(warc.marked(pages).coalesce(1), str(tmp_path))
    path = manifest.first().uri
    data = open(path, "rb").read()
    import io
    members = list(warc.records(io.BytesIO(data), 7))
    assert members == list(warc.records(io.BytesIO(data)))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError):
        warc.parse(members[0][:-1])
    broken = members[0].replace(b"HTTP/1.1 200", b"HTTP/1.1 201")
    assert not warc.parse(broken)["verified"] and warc.parse(members[0])["verified"]


def test_warc_of_nothing(pages, tmp_path):
    manifest = warc.write_warc(warc.marked(pages.where("false")), str(tmp_path))
    assert manifest.count() == 0 and warc.read_warc(manifest).collect() == []


def test_segments_take_linear_time():
    import time
    r = random.Random(4)
    for at, gains in ((list(range(0, 3_000_000, 30)), [5.0] * 100_000), (list(range(100_000)), [r.uniform(-1, 1) for _ in range(100_000)]),
                      (list(range(100_000)), [1.0] * 100_000)):
        t = time.perf_counter()
        toxicity.segments(at, gains, -0.7)
        assert time.perf_counter() - t < 1


def test_search_leaves_no_open_exchange(rng):
    """After the search, no bin has a move, exchange or two-for-one exchange that raises the squares."""
    for n, most in ((60, 9), (120, 30), (200, 70)):
        size = 100
        lengths = np.sort(np.array([rng.randint(1, most) for _ in range(n)], np.int64))[::-1].copy()
        bins = bestfit_packing.local_search(lengths, np.arange(n), size)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(int)
        assert fill.max() <= size
        for a in np.flatnonzero(fill):
            own = [int(x) for x in lengths[bins == a]]
            sums = {*own}, {x + y for i, x in enumerate(own) for y in own[i + 1:]}
            for b in np.flatnonzero((fill > 0) & (fill < size)):
                if a != b and fill[a] < size:
                    for pair in (0, 1):
                        for s in sums[pair]:
                            for t in [int(x) for x in lengths[bins == b]] + [0] * (1 - pair):
                                d = s - t
                                assert not (d > 0 and d <= size - fill[b] and fill[b] - fill[a] + d > 0)


def test_mix_leaves_columns_of_any_name(spark):
    names = ["_size", "_rate", "_source", "_target", "_mix", "_source_size", "_words", "_source_totals", "_MIX_"]
    df = spark.createDataFrame([(i, f"s{i % 2}", "a b c", *range(70, 70 + len(names))) for i in range(6)],
                               "doc_id long, source string, text string, " + ", ".join(f"`{n}` int" for n in names))
    m = mix_sources.mix(df)
    assert m.columns[:-1] == df.columns and m.columns[-1].lower() not in {c.lower() for c in df.columns}
    assert {tuple(r[n] for n in names) for r in m.collect()} == {tuple(range(70, 70 + len(names)))}
    out = mix_sources.expand(m)
    assert out.columns == df.columns and {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(70, 70 + len(names)))}
