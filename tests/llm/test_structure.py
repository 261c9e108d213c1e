"""Wrappers of pages, periodic runs and the prefix trie against plain versions."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from laglake.llm import periodic_runs as R
from laglake.llm import prefix_trie as T
from laglake.llm import wrappers as H


# ---- periodic runs

def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i:j + q]
            if len(part) >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_the_definition(rng):
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds, p = rng.randint(0, 60), rng.randint(1, 3), rng.randint(1, 9)
            w = [rng.randrange(kinds) for _ in range(n)]
            texts.append([w[i % p] for i in range(n)] + w[: n // 3] if rng.random() < 0.6 and n >= p else w)
        least = rng.choice([2, 5, 12])
        ends = np.cumsum([len(x) for x in texts])
        start, end, q = R.find_runs(np.array(sum(texts, []), np.int64), ends, least)
        want = [(e - len(x) + s, e - len(x) + s + n, k) for x, e in zip(texts, ends.tolist(), strict=True) for s, n, k in plain_runs(x, least)]
        assert list(zip(start.tolist(), end.tolist(), q.tolist(), strict=True)) == want


def test_every_primitive_root_is_proposed():
    import itertools
    for q in range(1, 12):
        for root in itertools.product((0, 1), repeat=q):
            w = list(root) * 2
            s, e, k = R.find_runs(np.array(w, np.int64), np.array([len(w)]), 1)
            assert [r for r in plain_runs(w, 1)] == [(a, b - a, c) for a, b, c in zip(s.tolist(), e.tolist(), k.tolist(), strict=True)]


def test_long_periodic_texts_take_no_quadratic_time():
    import time
    for w in (np.zeros(200_000, np.int64), np.arange(200_000) % 997):
        t = time.perf_counter()
        s, e, q = R.find_runs(w, np.array([len(w)]), 12)
        assert len(s) == 1 and (s[0], e[0]) == (0, len(w)) and time.perf_counter() - t < 10


def plain_digest(doc_id, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1] or [(None, None, None)]
    return (doc_id, len(runs), *best[0], None if not runs else 1000 * best[0][1] // best[0][2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_digests_of_odd_rows(spark, docs, nothing, rng):
    more = [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(60)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter(tuple(r) for r in R.run_digests(both, rewrite=R.tail_repeated).select(*COLUMNS).collect())
    assert got == Counter(plain_digest(r.doc_id, r.text) for r in both.collect())
    assert any(plain_digest(i, t)[1] for i, t in more)
    assert R.run_digests(nothing).columns == R.run_digests(docs).columns and R.run_digests(nothing).count() == 0


def quick_runs(words):
    """Runs by comparing the text with itself at every distance; the smallest period of a stretch comes first."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        if not same.any():
            continue
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in edge[edge[:, 1] - edge[:, 0] >= q].tolist():
            if e - s + q >= max(12, 2 * q) and (s, e + q) not in seen:
                out.append((s, e + q - s, q))
            seen.add((s, e + q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_query_equals_plain_version(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setitem(globals(), "plain_runs", lambda words, least: quick_runs(words))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in R.op12_periodic_runs(spark, sf).select(*COLUMNS).collect())
    assert got == Counter(plain_digest(r.doc_id, r.text) for r in docs)


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in R.periodic_runs(df).collect()}
    assert got[1].text == "x a b c y" and [tuple(r) for r in got[1].runs] == [(1, 15, 3)]
    assert got[2].text is None and got[2].runs == []


# ---- prefix trie

def plain_trie(rows, rebuild=True):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    seqs = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(c - 20 * int(c / 20)), [])
        seqs[c] = base[:h] + seq[h:] if rebuild else seq
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved,
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


SCHEMA = "conv_id long, turn long, role string, text string, n long, node int, path string, least int, depth int, seq string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "p", 7, 7, "s") for r in rows], SCHEMA).repartition(3)


def trie(df):
    found = T.prefix_trie(T.rebuilt(T.turns(df))).drop("node", "parent")
    return Counter(tuple(r) for r in found.collect())


def test_trie_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a b", "c", "", None, "x y z"])) for c in list(range(60)) + [-25, -20] for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "lost"), (121, 0, "user", "gone"), (122, None, "user", "b"), (122, 1, "user", "a"), (122, 1, "bot", "a"), (122, 1, "bot", "a")]
    rows += [(200, t, "user", f"{t % 3} w") for t in range(70)]
    assert trie(conversations(spark, rows)) == plain_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(4)]
    assert trie(conversations(spark, rows)) == plain_trie(rows)
    one = [(5, 0, None, None)]
    assert trie(conversations(spark, one)) == plain_trie(one)
    assert not trie(conversations(spark, []))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 31])
def test_cut_names_depend_on_the_prefix_only(n):
    size = 1 << max(1, n.bit_length())
    a = T.cut_names([f"t{i}" for i in range(n)], size)
    assert len(set(a)) == n and "" not in a
    assert T.cut_names([f"t{i}" for i in range(n)][: n // 2], size) == a[: n // 2]
    if n > 2:
        b = T.cut_names(["other", *[f"t{i}" for i in range(1, n)]], size)
        assert not set(a) & set(b)


def test_member_hashes_over_many_pieces(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", 3)]
    got = {r.end: r.ends_sha256 for r in T.member_hashes(spark.createDataFrame(rows, "end string, conv_id long"), piece_bytes=100).collect()}
    assert got == {"hot": hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), "cold": hashlib.sha256(b"3").hexdigest()}


# ---- wrappers

def page(title, body, extra="", main=("<article>", "</article>")):
    return (f'<!DOCTYPE html><html><head><title>T {title}</title><style>p{{}}</style></head><body class="with-sidebar"><header id=top>Site</header>'
            f'<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <article>no</article> --><div class="ad">Buy</div>{main[0]}'
            f'<h1>{title}</h1>{body}{main[1]}<aside>side</aside>{extra}<footer>&copy; Site</footer><script>if (a<b) x("</p><p>no</p>")</script></body></html>')


DIV = ('<div id="page"><div class="post-12">', '</div></div>')


def text_of(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y", 3, "z") for i, (u, h) in enumerate(rows)],
                               "page_id long, url string, html string, text string, host string, salt int, region string").repartition(2)
    return {r.page_id: r.text for r in H.extract(df).collect()}


def test_main_texts(spark):
    u = "http://a.example.com/1"
    rows = [(u, page("One", "<p>First &amp; <b>bold</b>&nbsp;text<p>Se<i>co</i>nd<br>line</p><ul><li>x<li>y</ul>")),
            (u, page("Two", "<p>Only</p>", '<div class="comments"><p>me too</p></div><form><p>mail</p></form>')),
            (u, page("Three", '<p>Kept</p><div class="share-buttons">Share</div><section id="comments"><article class="comment">hi</article></section>')),
            (u, None), (u, ""), (None, "just text\n with  space"), ("nonsense", "<p>a<p>b"), (u, "<html><body><article><p>cut of<p>f &lt;i"),
            (u, '<div><article><p title="a > b">q</p></article><div hidden>no</div></div>'), (u, "<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "</article>")]
    got = text_of(spark, rows)
    assert got == {0: "One\nFirst & bold text\nSecond line\nx\ny", 1: "Two\nOnly", 2: "Three\nKept", 3: "", 4: "", 5: "just text with space", 6: "a\nb",
                   7: "cut of\nf <i", 8: "q", 9: "deep"}


def test_templates_without_article_elements(spark):
    rows = [("http://b.example.com/x", page(f"Title {i}", "".join(f"<p>Paragraph {i} {k}</p>" for k in range(1 + i % 4)) + "<div>Read more</div>", main=DIV)) for i in range(12)]
    got = text_of(spark, rows)
    for i in range(12):   # the template's own text is known from its pages
        assert got[i].split("\n") == [f"Title {i}", *[f"Paragraph {i} {k}" for k in range(1 + i % 4)]]
    few = text_of(spark, rows[:2])
    assert few[1] == "Title 1\nParagraph 1 0\nParagraph 1 1\nRead more"


def test_equal_pages_keep_their_text(spark):
    rows = [("http://c.example.com/x", page("Same", "<p>all alike</p>"))] * 20 + [("http://c.example.com/y", page("Other", "<p>else</p>"))]
    got = text_of(spark, rows)
    assert set(got.values()) == {"Same\nall alike", "Other\nelse"} and len(got) == 21


def expr(*htmls):
    w = H.wrapper_of(H.read_page(htmls[0]))
    for h in htmls[1:]:
        H.merge(w, H.wrapper_of(H.read_page(h)))
    return H.expression(json.loads(json.dumps(w)))


def test_mismatches_become_slots_and_groups():
    assert expr("<div><h1>a</h1><p>x</p></div>", "<div><h1>b</h1><p>y</p></div>") == "<div><h1>#</h1><p>#</p></div>"
    assert expr("<div><h1>a</h1></div>", "<div><h1>a</h1><p>y</p></div>") == "<div><h1>#</h1>(<p>#</p>)?</div>"
    assert expr("<ul><li>a<li>b<li>c</ul>") == "<ul>(<li>#</li>)+</ul>"
    assert expr("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>((<dt>#</dt>)?(<dd>#</dd>)?)+</dl>" or expr("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    assert expr("<div><p>a</p><hr></div>", "<div><hr><p>a</p></div>").startswith("<div>(") and expr("<div><p>a</p><hr></div>", "<div><hr><p>a</p></div>").endswith(")+</div>")


def test_wide_levels_go_by_element_name(spark):
    many = "<div>" + "".join(f"<p class='{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}q{'x' * (i // 676)}'>t{i}</p>" for i in range(1000)) + "</div>"
    w = H.wrapper_of(H.read_page(many))
    assert len(w["c"]["div"]["c"]) <= H.WIDE + 1
    assert text_of(spark, [("http://d.example.com", many)])[0].split("\n") == [f"t{i}" for i in range(1000)]


def test_wrappers_meet_in_two_steps(spark):
    rows = [(i, f"http://h{i % 3}.example.com/", page(str(i), "<p>x</p>" * (1 + i % 2))) for i in range(30)]
    df = H.with_host(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7))
    got = {r.host: r for r in H.wrappers(df, fan=2, hosts_at_once=1).collect()}
    assert {h: r.pages for h, r in got.items()} == {f"h{i}.example.com": 10 for i in range(3)}
    assert H.choose_region(json.loads(got["h0.example.com"].wrapper), 10)["path"][-1] == "*article"
