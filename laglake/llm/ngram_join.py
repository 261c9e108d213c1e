"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word n-grams. Two documents link when 100 * intersection >= percent * union;
the result is the connected component of every document. Exact copies of a set are one set throughout.

1. How many distinct sets hold each n-gram is counted exactly over the corpus (in blocks that ask buckets). A set can only have a link if
   at least ``percent`` of its n-grams occur elsewhere, so most sets end here.
2. Remaining sets that share an n-gram of their prefixes (rarest first) are candidates for links. Their connected
   components, found from one edge per n-gram and task instead of pairs, bound who must be compared.
3. Within a component, sets are compared by an inverted index (``links``): lists are cut into runs by position and runs whose position
   bound can't reach the threshold are skipped; and where a set is highly similar to one whose
   overlaps with all others are known, its own overlaps are derived from those, by the lists of the n-grams in
   which the two differ.
4. Components of more than ``chunk_sets`` sets are dealt to chunks. Each chunk compares its own sets and a few pivots of
   the component; then each set outside the component's largest class is sent, as a probe, to the chunks that hold a candidate of
   another class (``probes_of``: a common prefix n-gram, sizes and positions that could bear a link). Two sets
   that are already in one class needn't be compared. No link that would join two classes is lost, no pair of sets is
   emitted, and a task holds a chunk and a block of about ``2 * chunk_sets`` probes.

Defined results: null and empty texts have an empty set (n_shingles 0), link with nothing and are their own
component. Fewer words than n make one n-gram of the whole. Null ids never name a component that has another id.
Rows with equal ids get one row each. n-grams are compared by 64-bit hash, sets by 128-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.session import materialize

from .common import fresh, table
from .exchange import ASK, answered, ask_table, asks, by_hash, mixed, plan, replies
from .graph import components

DROP = 28  # 36 bits tell n-grams apart when they are counted: a collision only makes a count too high
SETS = "kind int, doc_id long, mark binary, n long, digest binary, tokens binary, df binary"
STEP = np.uint64(0x9E3779B97F4A7C15)
ENTRY = "token long, digest binary, n long, room long, band long"
#: The counts that a byte stands for: exact below 128, then four to an octave (up to 4e11), so that common n-grams keep their order.
LEVELS = np.concatenate([np.arange(128), np.floor(128 * 2.0 ** (np.arange(128) / 4))])


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The rising 64-bit hashes of each text's distinct n-grams of lower-cased (A-Z) words."""
    seen: dict[bytes, int] = {}
    out = []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        out.append(ids)
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    sets = []
    for ids in out:
        if not len(ids):
            sets.append(np.empty(0, np.uint64))
            continue
        h, w = known[ids], min(width, len(ids))
        x = np.full(len(h) - w + 1, np.uint64(w))
        for k in range(w):
            x = mixed(x * STEP + h[k:len(h) - w + 1 + k])
        sets.append(np.unique(x))
    return sets


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def coded(counts: np.ndarray) -> np.ndarray:
    """The byte of the largest level that isn't above each count."""
    return (np.searchsorted(LEVELS, counts, side="right") - 1).astype(np.uint8)


def coded_sum(which: np.ndarray, facts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return coded(np.bincount(which, weights=LEVELS[facts]))[which]


class Classes:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Index:
    """Inverted lists over the sets of a task, and those of the prefixes with positions."""

    def __init__(self, sets: list[np.ndarray], ranks: list[np.ndarray], percent: int):
        """``ranks``: for each set, its n-grams in the common order (rarest first)."""
        self.size = np.array([len(s) for s in sets], np.int64)
        self.percent = percent
        every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(self.size)])
        self.sets = [inverse[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.owners = owner[np.argsort(inverse, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(every)))])
        self.prefix = [np.searchsorted(every, r[:len(r) - needed(len(r), percent) + 1]) for r in ranks]
        token = np.concatenate(self.prefix)
        place = np.concatenate([np.arange(len(p)) for p in self.prefix])
        order = np.lexsort((place, token))
        self.p_owner = np.repeat(np.arange(len(sets)), [len(p) for p in self.prefix])[order]
        self.p_place = place[order]
        self.p_at = np.searchsorted(token[order], np.arange(len(every) + 1))

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set holds, from the inverted lists."""
        n = self.at[tokens + 1] - self.at[tokens]
        if not n.sum():
            return np.zeros(len(self.size), np.int64)
        at = np.repeat(self.at[tokens] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owners[at], minlength=len(self.size))

    def candidates(self, i: int) -> np.ndarray:
        """Sets that share a prefix token with set i and pass the length and position bounds. A list's entries rise by position;
        a position above the last that any length could bear ends the list's use: the runs behind it are skipped."""
        n, found = int(self.size[i]), []
        last = n * (100 - self.percent) // self.percent  # of any set that could link, as its size is n * 100 / percent at most
        for k, token in enumerate(self.prefix[i].tolist()):
            a, b = self.p_at[token], self.p_at[token + 1]
            if b - a < 2:
                continue
            b = a + np.searchsorted(self.p_place[a:b], last, side="right")
            who, place = self.p_owner[a:b], self.p_place[a:b]
            size = self.size[who]
            least = -(-self.percent * (n + size) // (100 + self.percent))
            found.append(who[(np.minimum(n - k, size - place) >= least) & (who != i)])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def linked(self, i: int, overlap: np.ndarray) -> np.ndarray:
        """Sets whose overlap with set i reaches the threshold."""
        return 100 * overlap >= self.percent * (self.size[i] + self.size - overlap)


def links(sets: list[np.ndarray], ranks: list[np.ndarray], percent: int, classes: Classes, probes: np.ndarray | None = None) -> None:
    """Joins the classes of all linked sets (with ``probes``: of those linked to a probe)."""
    index = Index(sets, ranks, percent)
    known: dict[int, np.ndarray] = {}
    nearest, common = np.full(len(sets), -1), np.zeros(len(sets), np.int64)
    for i in np.argsort(index.size, kind="stable").tolist() if probes is None else probes.tolist():
        j = int(nearest[i])
        mine = index.sets[i]
        if j >= 0 and index.size[i] + index.size[j] - 2 * common[i] < index.size[i]:
            other = index.sets[j]
            both = np.isin(mine, other, assume_unique=True)
            overlap = known[j] + index.overlaps(mine[~both]) - index.overlaps(other[~np.isin(other, mine, assume_unique=True)])
        else:
            near = index.candidates(i)
            if not len(near) or probes is None and all(classes.find(i) == classes.find(k) for k in near.tolist()):
                continue
            overlap = index.overlaps(mine)
        known[i] = overlap
        better = overlap > common
        nearest[better], common[better] = i, overlap[better]
        for k in np.flatnonzero(index.linked(i, overlap)).tolist():
            classes.join(i, k)


def compared(percent: int):
    """Arrow function over a chunk: an edge from each set to the first of its class. Probes carry the class they are in already."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("digest", "ascending"), ("probe", "descending")])
        digests = t["digest"].to_pylist()
        keep = [k for k, d in enumerate(digests) if not k or d != digests[k - 1]]
        t = t.take(pa.array(keep))
        digests, probe, known = t["digest"].to_pylist(), np.array(t["probe"].to_pylist(), bool), t["class"].to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in t["tokens"].to_pylist()]
        ranks = [ranked(s, np.frombuffer(d, np.uint8)) for s, d in zip(sets, t["df"].to_pylist(), strict=True)]
        classes, first = Classes(len(sets)), {}
        for k, c in enumerate(known):
            if c is not None:
                classes.join(first.setdefault(c, k), k)
        links(sets, ranks, percent, classes, np.flatnonzero(probe) if any(c is not None for c in known) else None)
        roots = [classes.find(k) for k in range(len(sets))]
        pairs = [(digests[k], digests[r]) for k, r in enumerate(roots) if k != r]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    return run


def ranked(tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
    return tokens[np.lexsort((tokens, df))]


def shared_prefixes(percent: int):
    """Arrow function over sets: within the batch, an edge from each set to the first one with a common prefix n-gram; and each
    n-gram's first set, to meet those of other batches."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            digests = b.column(0).to_pylist()
            order = np.argsort(np.array(digests, dtype=object), kind="stable")
            tokens, owner = [], []
            for rank, k in enumerate(order.tolist()):
                s, df = np.frombuffer(b.column(1)[k].as_py(), "<u8"), np.frombuffer(b.column(2)[k].as_py(), np.uint8)
                by = np.lexsort((s, df))[:len(s) - needed(len(s), percent) + 1]
                by = by[df[by] > 1]
                tokens.append(s[by])
                owner.append(np.full(len(by), rank))
            token, own = np.concatenate(tokens), np.concatenate(owner)
            if not len(token):
                continue
            at = np.lexsort((own, token))
            token, own = token[at], own[at]
            start = np.concatenate([[True], token[1:] != token[:-1]])
            first = own[start][np.cumsum(start) - 1]
            pair = np.unique(np.stack([own, first])[:, own != first], axis=1)
            name = [digests[k] for k in order.tolist()]
            rows = [(None, name[x], name[y]) for x, y in pair.T.tolist()] + [(x, name[y], None) for x, y in zip(token[start].view(np.int64).tolist(), own[start].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["token", "a", "b"])
    return run


def band_of(n: int, percent: int) -> int:
    """Sets that link lie in the same or in adjacent bands of sizes."""
    return int(math.log(n) / math.log(1.0001 * 100 / percent))


def prefix_entries(percent: int):
    """Arrow function over sets (digest, tokens, df): a row of ``ENTRY`` for each prefix n-gram that another set may hold. ``room`` is
    the number of the set's n-grams from this one on, in the common order."""
    def run(batches):
        for b in batches:
            parts = []
            for k in range(b.num_rows):
                s, df = np.frombuffer(b.column(1)[k].as_py(), "<u8"), np.frombuffer(b.column(2)[k].as_py(), np.uint8)
                by = np.lexsort((s, df))[:len(s) - needed(len(s), percent) + 1]
                place = np.flatnonzero(df[by] > 1)
                parts.append((s[by[place]].view(np.int64), np.full(len(place), k), np.full(len(place), len(s)), len(s) - place,
                              np.full(len(place), band_of(len(s), percent))))
            if parts:
                token, who, n, room, band = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token), b.column(0).take(pa.array(who)), pa.array(n), pa.array(room), pa.array(band)],
                                                 names=[x.split()[0] for x in ENTRY.split(", ")])
    return run


def probes_of(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """digest, label, chunk: the chunks that hold a candidate of another class for a set outside its component's main class. ``open_``: digest, label,
    chunk, class, main of the sets of components with several classes.

    Entries of one n-gram, chunk, class and band of sizes count as one with the widest bounds, which can only add candidates.
    Of two sets outside the main class, the one of the larger class name is the probe."""
    entries = sets.select("digest", "tokens", "df").join(open_.select("digest"), "digest").mapInArrow(prefix_entries(percent), ENTRY)
    entries = materialize(entries.join(open_, "digest"), "entries")
    here = entries.groupBy("token", "band", "chunk", "class").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("most"), F.first("main").alias("main"))
    probe = entries.where(F.col("class") != F.col("main")).select(
        "token", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), "digest", "label", "n", "room", F.col("class").alias("own"))
    smallest = F.greatest(100 * F.col("low"), percent * F.col("n"))   # 100 times the least size of a candidate
    return probe.join(here, ["token", "band"]).where(
        ((F.col("class") == F.col("main")) | (F.col("class") < F.col("own"))) & (100 * F.col("high") >= percent * F.col("n"))
        & (100 * F.col("n") >= percent * F.col("low"))
        & (100 * (100 + percent) * F.least("room", "most") >= percent * (100 * F.col("n") + smallest))).select("digest", "label", "chunk").distinct()


def second_pass(open_: DataFrame, sets: DataFrame, percent: int, chunk_sets: int) -> DataFrame:
    """label, chunk, block, digest, class, probe: each chunk's own sets with each block of its probes."""
    sent = materialize(probes_of(open_, sets, percent), "probes")
    per = sent.groupBy("label", "chunk").agg(F.ceil(F.count("*") / (2 * chunk_sets)).cast("long").alias("blocks"))
    own = open_.join(per, ["label", "chunk"]).select(
        "label", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "digest", "class", F.lit(False).alias("probe"))
    probes = sent.join(per, ["label", "chunk"]).join(open_.select("digest", "class"), "digest").select(
        "label", "chunk", F.pmod(F.xxhash64("digest", F.lit(2)), F.col("blocks")).alias("block"), "digest", "class", F.lit(True).alias("probe"))
    return own.unionByName(probes)


def corpus_sets(docs: DataFrame, width: int, percent: int, block_bytes: int) -> DataFrame:
    """Written ``SETS`` rows: of kind 0 for each row of ``docs`` (doc_id, text, mark; the last is passed on), and of kind 1 for each set that
    may have a link, once per block."""
    blocks, buckets = plan(docs, block_bytes, 1.0)
    dealt = by_hash(docs, blocks, "doc_id", "text")

    def block_sets(t: pa.Table):
        sets = shingle_sets(t["text"].to_pylist(), width)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        first: dict[bytes, int] = {}
        for k, d in enumerate(digests):
            if d is not None:
                first.setdefault(d, k)
        one = [sets[k] for k in first.values()]
        every = np.concatenate(one) if one else np.empty(0, np.uint64)
        keys, which, times = np.unique(every >> np.uint64(DROP), return_inverse=True, return_counts=True)
        return sets, digests, list(first.values()), keys << np.uint64(DROP), which, times

    def ask(t: pa.Table) -> pa.Table:
        *_, keys, _, times = block_sets(t)
        return ask_table(asks(t["block"][0].as_py(), 0, keys, coded(times), buckets, DROP))

    def tell(t: pa.Table, reply: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows:
            ids = t["doc_id"].to_pylist()
            sets, digests, once, _, which, _ = block_sets(t)
            df = replies(reply, "u1")[0][which]
            marks = t["mark"].to_pylist()
            rows = [(0, i, m, len(s), d, None, None) for i, m, s, d in zip(ids, marks, sets, digests, strict=True)]
            at = 0
            for k in once:
                n = len(sets[k])
                here = df[at:at + n]
                at += n
                if int((here > 1).sum()) >= needed(n, percent):
                    rows.append((1, ids[k], None, n, digests[k], sets[k].astype("<u8").tobytes(), here.tobytes()))
        return pa.table({x.split()[0]: pa.array([r[k] for r in rows], kind) for k, (x, kind) in enumerate(zip(
            SETS.split(", "), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True))})

    asked = dealt.groupBy("block").applyInArrow(ask, ASK)
    return materialize(dealt.groupBy("block").cogroup(answered(asked, coded_sum, "u1").groupBy("block")).applyInArrow(tell, SETS), "ngram-sets")


def classes_of(sets: DataFrame, percent: int, chunk_sets: int, pivots: int) -> DataFrame:
    """node (a set's digest), label: the classes of linked sets, for sets with a link. ``sets``: digest, tokens, df; written."""
    near = materialize(sets.select("digest", "tokens", "df").mapInArrow(shared_prefixes(percent), "token long, a binary, b binary"), "prefixes")
    met = (near.where("token IS NOT NULL").groupBy("token").agg(F.min("a").alias("b"), F.collect_set("a").alias("a"))
           .where(F.size("a") > 1).select(F.explode("a").alias("a"), "b"))
    group = components(near.where("token IS NULL").select("a", "b").unionByName(met))
    sizes = group.groupBy("label").agg(F.count("*").alias("n"), *[F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(pivots)) == k, F.col("node"))).alias(f"p{k}") for k in range(pivots)])
    big = materialize(sizes.where(F.col("n") > chunk_sets).withColumn("chunks", F.ceil(F.col("n") / chunk_sets).cast("long")), "big-groups")
    dealt = group.join(big.select("label", "chunks"), "label", "left").withColumn(
        "chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))).cast("long"))
    dealt = materialize(dealt.select(F.col("node").alias("digest"), "label", "chunk", F.col("chunks").isNotNull().alias("big")), "chunks")
    member = sets.select("digest", "tokens", "df").join(dealt, "digest")
    member = materialize(member, "members")
    cols = ["label", "chunk", "digest", "tokens", "df", "class", "probe"]
    own = member.withColumn("class", F.lit(None).cast("binary")).withColumn("probe", F.lit(False))
    sent = big.select("label", "chunks", F.explode(F.array(*[F.col(f"p{k}") for k in range(pivots)])).alias("digest")).where("digest IS NOT NULL")
    sent = member.select("digest", "tokens", "df").join(sent, "digest")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    sent = sent.select("label", every, "digest", "tokens", "df", F.lit(None).cast("binary").alias("class"), F.lit(False).alias("probe"))
    found = materialize(own.select(cols).unionByName(sent.select(cols)).groupBy("label", "chunk").applyInArrow(compared(percent), "a binary, b binary"), "links")
    if big.isEmpty():
        return components(found)
    classes = components(found)
    state = materialize(dealt.where("big").join(classes.withColumnRenamed("node", "digest").withColumnRenamed("label", "class"), "digest", "left")
                        .select("digest", "label", "chunk", F.coalesce("class", "digest").alias("class")), "big-members")
    per = state.groupBy("label", "class").agg(F.count("*").alias("n"))
    main = materialize(per.groupBy("label").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1"), "main-classes")
    if main.isEmpty():
        return classes
    open_ = materialize(state.join(main.select("label", "main"), "label"), "open-members")
    again = second_pass(open_, member, percent, chunk_sets).join(member.select("digest", "tokens", "df"), "digest")
    more = again.groupBy("label", "chunk", "block").applyInArrow(compared(percent), "a binary, b binary")
    return components(found.unionByName(more))


def labelled(all_: DataFrame, percent: int, chunk_sets: int, pivots: int, least: Column) -> DataFrame:
    """digest, least, label of every distinct set of ``SETS`` rows: ``least`` is an aggregate over its rows, ``label`` names its class."""
    sets = materialize(all_.where("kind = 1").groupBy("digest").agg(F.first("tokens").alias("tokens"), F.first("df").alias("df")), "distinct-sets")
    classes = classes_of(sets, percent, chunk_sets, pivots)
    firsts = materialize(all_.where("kind = 0 AND digest IS NOT NULL").groupBy("digest").agg(least.alias("least")), "least-ids")
    return materialize(firsts.join(classes.withColumnRenamed("node", "digest"), "digest", "left")
                       .select("digest", "least", F.coalesce("label", "digest").alias("label")), "labelled-sets")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, chunk_sets: int = 96, pivots: int = 8, block_bytes: int = 4 << 20,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("mark"))
    all_ = corpus_sets(rows, width, percent, block_bytes)
    members = all_.where("kind = 0").select("doc_id", "n", "digest")
    label = labelled(all_, percent, chunk_sets, pivots, F.min("doc_id"))
    per = materialize(label.groupBy("label").agg(F.min("least").alias("component_id")), "least-of-classes")
    named = materialize(label.join(per, "label").select("digest", "component_id"), "named-sets")
    return members.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, chunk_sets: int = 96,
                    pivots: int = 8, block_bytes: int = 4 << 20) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, rows without an id last; of several texts under that id the one with
    the smallest MD5. Rows without words are linked with nothing and stay, those equal in id and text once. Of rows equal in id and
    text, that with the smallest hash of all columns stays, so reruns agree."""
    mark = F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark"))
    all_ = corpus_sets(rows, width, percent, block_bytes)
    members = all_.where("kind = 0")
    label = labelled(all_, percent, chunk_sets, pivots, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")))
    first = label.groupBy("label").agg(F.min("least").alias("least")).select("least.doc_id", "least.mark")
    first = first.unionByName(members.where("digest IS NULL").select("doc_id", "mark").distinct())
    times = members.groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("m")).agg((F.count("*") > 1).alias("again"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("mark").eqNullSafe(F.col("m"))
    first = materialize(first.join(times, same).select("i", "m", "again"), "kept-rows")
    i, m, ik, mk = (fresh(n, docs.columns) for n in ("_i", "_m", "_ik", "_mk"))
    keyed = docs.withColumn(i, F.col(id_col).cast("long")).withColumn(m, mark)

    def kept(again: bool) -> DataFrame:
        some = first.where(F.col("again") == again).select(F.col("i").alias(ik), F.col("m").alias(mk))
        return keyed.join(some, F.col(i).eqNullSafe(F.col(ik)) & F.col(m).eqNullSafe(F.col(mk)), "left_semi")

    once = kept(False).drop(i, m)
    if first.where("again").isEmpty():
        return once
    columns = [f"`{c}`" for c in docs.columns]
    order = F.xxhash64(*[f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()])
    more = kept(True).groupBy(i, m).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return once.unionByName(more.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words, a similarity of 0.8, all documents."""
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
f AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = s.doc_id), s.doc_id)) AS component_id FROM s
"""
