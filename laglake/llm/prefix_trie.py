"""Prefix trie of conversations by van Emde Boas recursion.

The trie is never walked level by level. Sequences of fewer than B turns are cut at B / 2: the distinct cut prefixes are named (a 128-bit
hash), the first halves form an upper trie, and what follows a cut belongs to the lower forest of that name. Upper
trie and lower forests are the same problem with half the depth, so one aggregate per halving handles all of them at once, on rows
that are already distinct; log2(depth) halvings leave single turns, which are the nodes, each with the name of its parent.

Totals of subtrees are grafted upward in the opposite order. At size B the totals of the roots of each lower forest are summed, and
the sum is added to the cut node it hangs from and to that node's ancestors in its upper trie (at most B / 2 nodes, known from
the distinct upper sequence).

Equal conversations are one row from the beginning, and a node that very many conversations share is one row per level. A hot node's
members are hashed from text pieces that range partitions build in parallel (SHA-256 itself reads them one after the other, in
constant memory). The names of a conversation's turns (22 bytes a turn, no texts) lie in one row.

Defined results: turns are ordered by turn (null first), then role, the text's first 64 characters and its hash; null role or text is empty; repeated rows are
turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has no conversations
and gives no rows, not even a root. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.session import materialize

from .common import WORD_SQL, table

ROOT = ""
NONE = hashlib.sha256(b"").hexdigest()


def short_hash(data: bytes) -> str:
    from base64 import b64encode
    return b64encode(hashlib.md5(data).digest()).decode()[:22]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as (name, words): the hash of role and text, and the number of words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    name = F.substring(F.base64(F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))), 1, 22)
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", F.substring("text", 1, 64).alias("begin"), name.alias("name"),
                    F.regexp_count("text", F.lit(WORD_SQL)).cast("long").alias("words"))
    many = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return many.select("conv_id", F.transform("all", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("seq"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """The contract's sequences: the first h turns of conversation c - c % 20, then c's own after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = seqs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("seq", 1, 3).alias("head"))
    joined = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", h).join(heads, "base", "left")
    nothing = F.slice("seq", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")),
                                             F.slice("seq", F.col("h") + 1, F.size("seq"))).alias("seq"))


def cut_names(seq: list[str], size: int) -> list[str]:
    """Names of all prefixes: a cut prefix is named by its forest and the upper sequence; both halves are named alike."""
    out = [""] * len(seq)
    todo = [(ROOT, 0, size)]
    while todo:
        forest, at, size = todo.pop()
        half = size // 2
        if at >= len(seq):
            continue
        if half:
            todo.append((forest, at, half))
            if at + half <= len(seq):
                name = out[at + half - 1] = short_hash((forest + "".join(seq[at:at + half])).encode())
                todo.append((name, at + half, half))
    return out


def named(seqs: DataFrame, size: int) -> DataFrame:
    """``seqs`` (seq of name and words, n, least) with ``path``: the names of its prefixes."""
    @F.pandas_udf("array<string>")
    def names(s):
        return s.map(lambda x: cut_names(list(x), size))

    return seqs.select("*", names(F.transform("seq", lambda t: t["name"])).alias("path"), F.transform("seq", lambda t: t["words"]).alias("words"))


def halved(pieces: DataFrame, half: int) -> DataFrame:
    """Distinct upper sequences and lower sequences of all subproblems of twice ``half`` turns."""
    cols = lambda forest, base, start: [forest.alias("forest"), base.alias("base"), F.slice("path", start, half).alias("path"),
                                        F.slice("words", start, half).alias("words"), F.col("n"), F.col("least")]
    upper = pieces.select(*cols(F.col("forest"), F.col("base"), 1))
    lower = pieces.where(F.size("path") > half).select(*cols(F.element_at("path", half), F.col("base") + half, half + 1))
    return distinct_pieces(upper.unionByName(lower))


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    rest = [F.first(c).alias(c) for c in ("forest", "base", "path", "words")]   # the last name decides them
    found = pieces.withColumn("end", F.element_at("path", -1)).groupBy("end").agg(*rest, F.sum("n").alias("n"), F.min("least").alias("least"))
    return materialize(found, "trie-pieces")


def member_hashes(ends: DataFrame, piece_bytes: int = 1 << 20) -> DataFrame:
    """end, SHA-256 of its rising conv_ids, comma-joined. Range partitions write pieces of the texts; one pass over each end's
    pieces, in order, hashes them."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = first = None
        parts: list[str] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_pydict({"end": pa.array([end], pa.string()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(parts)], pa.string())})

        for b in batches:
            for e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if e != end or size >= piece_bytes:
                    if parts:
                        yield flush()
                    end, first, parts, size = e, c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
        if parts:
            yield flush()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state, done = None, None, ([], [])
        for b in batches:
            for e, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if e == end:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done[0].append(end)
                    done[1].append(state.hexdigest())
                end, state = e, hashlib.sha256(ids.encode())
            if len(done[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], ["end", "ends_sha256"])
                done = ([], [])
        if state is not None:
            done[0].append(end)
            done[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], ["end", "ends_sha256"])

    sorted_ = ends.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    texts = sorted_.mapInArrow(pieces, "end string, first long, ids string")
    return texts.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashes, "end string, ends_sha256 string")


def grafted(nodes: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """``nodes`` (name, forest, depth, leaves, saved) with the totals of their subtrees; ``levels``: pieces by size."""
    total = nodes
    for half in sorted(levels):
        # roots of lower forests: their parent ends an upper sequence of this size
        roots = total.where((F.col("depth") > 1) & ((F.col("depth") - 1) % (2 * half) == half))
        hang = roots.groupBy(F.col("forest").alias("end")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        above = levels[half].where((F.size("path") == half) & (F.col("base") % (2 * half) == 0)).select("end", "path")
        more = hang.join(above, "end").select(F.explode("path").alias("name"), "leaves", "saved")
        rest = [F.max(c).alias(c) for c in total.columns if c not in ("name", "leaves", "saved")]
        total = (total.unionByName(more, allowMissingColumns=True).groupBy("name")
                 .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *rest))
        total = materialize(total, "trie-totals")
    return total


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, seq: array of name and words): the columns of the contract and the node's
    and its parent's names."""
    seqs = materialize(seqs, "trie-sequences")
    longest = seqs.agg(F.max(F.size("seq"))).first()[0]
    if longest is None:
        return _nodes(seqs.sparkSession)
    size = 1 << max(1, longest.bit_length())   # more than the longest, so every prefix ends at a cut of some size
    # equal conversations are one row; the sequence's own hash stands for it
    whole = F.md5(F.array_join(F.transform("seq", lambda t: t["name"]), ""))
    alike = seqs.withColumn("whole", whole).groupBy("whole").agg(F.first("seq").alias("seq"), F.count("conv_id").alias("n"), F.min("conv_id").alias("least"))
    alike = materialize(named(alike, size), "trie-names")
    everything = alike.agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    pieces = alike.where(F.size("path") > 0).select(F.lit(ROOT).alias("forest"), F.lit(0).alias("base"), "path", "words", "n", "least")
    levels, half = {}, size // 2
    while half:
        pieces = levels[half] = halved(pieces, half)
        half //= 2
    one = pieces.select(F.col("end").alias("name"), "forest", (F.col("base") + 1).alias("depth"), F.element_at("words", 1).alias("words"), "n", "least")
    children = one.groupBy(F.col("forest").alias("name")).agg(F.count("name").alias("n_children"))
    nodes = one.join(children, "name", "left").select(
        "name", "forest", "depth", "n", "least", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    total = grafted(materialize(nodes, "trie-nodes"), levels)
    top = total.where("depth = 1").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("name").alias("n_children"))
    root = everything.crossJoin(top).select(   # one row each
        F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("forest"), F.lit(0).alias("depth"), F.col("n_convs").alias("n"),
        F.col("conv_id").alias("least"), "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved"))
    every = materialize(total.unionByName(root), "trie-all")
    ends = seqs.withColumn("whole", whole).join(alike.select("whole", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(ROOT)).alias("end")), "whole")
    parents = every.select(F.col("name").alias("forest"), F.col("least").alias("parent_conv_id"))
    out = every.join(parents, "forest", "left").join(member_hashes(ends).withColumnRenamed("end", "name"), "name", "left")
    return out.select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
                      F.col("name").alias("node"), F.col("forest").alias("parent"))


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                     "saved_tokens long, ends_sha256 string, node string, parent string")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(turns(table(spark, sf_dir, "conversations")))).drop("node", "parent")


SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
own AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT conv_id, count(*) AS len FROM own GROUP BY conv_id),
c AS (SELECT s.conv_id, s.conv_id - s.conv_id % 20 AS base, coalesce(b.len, 0) AS base_len,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s.conv_id::VARCHAR) + 1),
            lambda i: ord(substr(s.conv_id::VARCHAR, i, 1))::BIGINT)), lambda a, b: xor(crc.t[(xor(a, b) % 256) + 1], a // 256)), 4294967295) % 4 AS h
    FROM size s LEFT JOIN size b ON b.conv_id = s.conv_id - s.conv_id % 20, crc),
turns AS (SELECT c.conv_id, o.k AS k, o.r, o.x FROM c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
    UNION ALL SELECT c.conv_id, o.k - c.h + least(c.h, c.base_len), o.r, o.x FROM c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
keyed AS (SELECT conv_id, k AS depth, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
        string_agg(md5(length(r)::VARCHAR || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY k) AS key FROM turns),
path AS (SELECT conv_id, depth, words, key FROM keyed UNION ALL SELECT conv_id, 0, 0, '' FROM c),
deepest AS (SELECT conv_id, max(depth) AS last FROM path GROUP BY conv_id),
node AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
    FROM path JOIN deepest USING (conv_id) GROUP BY key),
tree AS (SELECT n.*, p.key AS parent, p.conv_id AS parent_conv_id FROM node n
    LEFT JOIN path q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN node p ON p.key = q.key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM tree WHERE parent IS NOT NULL GROUP BY parent),
full_tree AS (SELECT t.*, coalesce(k.n_children, 0) AS n_children FROM tree t LEFT JOIN kids k USING (key)),
totals AS (SELECT a.key, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
    FROM full_tree d JOIN path a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.key)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_tree JOIN totals USING (key)
"""
