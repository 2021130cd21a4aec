"""A trie of conversation prefixes by vertical bitmaps.

Conversations are dealt into shards of bounded size, and their positions into blocks, so that no task holds more
than a shard's conversations over a block's turns.  A shard numbers its conversations by id and indexes (position,
turn) to bitsets of them.  Depth first, a node's bitset intersected with the postings of the next position yields
its children; popcounts are the members, the lowest bit is the least, and bits without a next turn are the ends.
Nodes of different shards are one if the digests of their paths are equal.

Sums over subtrees take no walk: each conversation owns the nodes of which it is the least member, which are the end
of its path.  The sum over a node's subtree is what its members own, without what its own least member owns above it.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.llm.common import cut, dealt_anew
from codicil.llm.conversation_repair import sql_crc32
from codicil.llm.mixing import word_count

#: Conversations of a shard, about, and positions of a block.
SHARD_CONVERSATIONS = 4096
BLOCK_TURNS = 128

_ROOT = hashlib.sha256(b"").digest()
_NOTHING = hashlib.sha256(b"").hexdigest()
_INDEX = "conv_id long, depth int, key binary, words long, path binary, parent binary, last boolean"


def _chained(block_turns: int):
    """Depths and, at the start of each block, digests of paths, for conversations that come one after the other."""

    def chain(batches):
        held, conv, depth, path = None, None, 0, _ROOT
        names = [c.split(" ")[0] for c in _INDEX.split(", ")]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            out = []
            for c, key, words in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if held is not None:
                    out.append((*held, c != conv))
                if held is None or c != conv:  # the first row stands for the root
                    conv, depth, path, parent = c, 0, _ROOT, None
                else:
                    depth, parent, path = depth + 1, path, hashlib.sha256(path + key).digest()
                start = depth % block_turns == 0
                held = (c, depth, key, words, path if start else None, parent if start else None)
            if out:
                yield batch(out)
        if held is not None:
            yield batch([(*held, True)])

    return chain


def _members(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


class _Postings:
    """The vertical index of one shard's block."""

    def __init__(self, rows: pa.Table):
        columns = {c: rows.column(c).to_pylist() for c in rows.column_names}
        self.conversations = sorted(set(columns["conv_id"]))
        bit = {c: i for i, c in enumerate(self.conversations)}
        self.first = min(columns["depth"])
        self.starts: dict[bytes, int] = {}
        self.parents: dict[bytes, bytes | None] = {}
        self.postings: dict[tuple[int, bytes | None], int] = {}
        self.words: dict[tuple[int, bytes | None], int] = {}
        self.last: dict[int, int] = {}
        self.there: dict[int, int] = {}
        self.turns: list[dict[int, bytes]] = [{} for _ in self.conversations]
        for c, depth, key, words, path, parent, last in zip(*[columns[x] for x in ("conv_id", "depth", "key", "words", "path", "parent", "last")], strict=True):
            i = bit[c]
            one = 1 << i
            self.turns[i][depth] = key
            self.postings[depth, key] = self.postings.get((depth, key), 0) | one
            self.words[depth, key] = words
            self.there[depth] = self.there.get(depth, 0) | one
            if last:
                self.last[depth] = self.last.get(depth, 0) | one
            if path is not None:
                self.starts[path] = self.starts.get(path, 0) | one
                self.parents[path] = parent

    def nodes(self):
        """(path, parent, depth, words, bits) of all nodes, depth first."""
        stack = [(path, self.parents[path], self.first, bits) for path, bits in self.starts.items()]
        while stack:
            path, parent, depth, bits = stack.pop()
            any_of = (bits & -bits).bit_length() - 1
            yield path, parent, depth, self.words[depth, self.turns[any_of][depth]], bits
            rest = bits & self.there.get(depth + 1, 0)
            while rest:
                key = self.turns[(rest & -rest).bit_length() - 1][depth + 1]
                child = rest & self.postings[depth + 1, key]
                rest ^= child
                stack.append((hashlib.sha256(path + key).digest(), path, depth + 1, child))


_NODES = "path binary, parent binary, depth int, words long, conv_id long, n_convs long, ends array<long>"


def _shard_nodes(rows: pa.Table) -> pa.Table:
    p = _Postings(rows)
    found = []
    for path, parent, depth, words, bits in p.nodes():
        ends = [p.conversations[i] for i in _members(bits & p.last.get(depth, 0))]
        found.append((path, parent, depth, words, p.conversations[(bits & -bits).bit_length() - 1], bits.bit_count(), ends))
    types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=[c.split(" ")[0] for c in _NODES.split(", ")])


def _shard_sums(rows: pa.Table) -> pa.Table:
    """What the members of each node own altogether."""
    p = _Postings(rows.drop_columns(["saved", "leaf"]))
    own = {c: (s, x) for c, s, x in zip(*[rows.column(n).to_pylist() for n in ("conv_id", "saved", "leaf")], strict=True)}
    weights = [own[c] for c in p.conversations]
    found = []
    for path, _, _, _, bits in p.nodes():
        saved = leaves = 0
        for i in _members(bits):
            saved, leaves = saved + weights[i][0], leaves + weights[i][1]
        found.append((path, saved, leaves))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["path", "saved", "leaves"])


def _hashed(batches):
    """(path, ends_sha256) of rows sorted by path and conv_id; no list of ends is held."""
    path, h = None, None
    names = ["path", "ends_sha256"]
    for b in batches:
        found = []
        for p, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if p != path:
                if h is not None:
                    found.append((path, h.hexdigest()))
                path, h = p, hashlib.sha256(b"%d" % c)
            else:
                h.update(b",%d" % c)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found])], names=names)
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([h.hexdigest()])], names=names)


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, shard_conversations: int = SHARD_CONVERSATIONS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each distinct sequence of first turns: path, depth, conv_id, parent, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, turn, role, text), other columns being left aside.  ids: (conv_id) of conversations that count even
    without turns.  path and parent are digests of the sequences, the root's of none (its parent is null); conv_id is the
    least member; n_leaves counts childless nodes of the subtree, the node itself included; saved_tokens sums up (n_convs - 1)
    times the words of its last text over the subtree; ends_sha256 is of the ids of members that have no further turn,
    ascending and joined by commas.  Turns go by number, null first, ties by role and a hash of the text; equal rows are
    turns of their own.  Null roles and texts are empty ones.  Rows without a conv_id belong to no conversation.  Very
    long texts are hashed where they are read.  Without conversations there are no rows.
    """
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    t = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    keyed = t.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2(whole, 256)).alias("key"), word_count(F.col("text")).alias("words"))
    named = t.select("conv_id") if ids is None else t.select("conv_id").union(ids.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long")))
    roots = named.distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(t.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(_ROOT).alias("key"), F.lit(0).cast("long").alias("words"))
    ordered = roots.unionByName(keyed).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "key")
    index = cut(ordered.select("conv_id", "key", "words").mapInArrow(_chained(block_turns), _INDEX), "trie-index")
    shards = max(1, math.ceil(index.filter("depth = 0").count() / shard_conversations))
    dealt = lambda d: d.withColumn("shard", F.pmod(F.xxhash64("conv_id"), F.lit(shards))).withColumn("block", F.expr(f"depth div {block_turns}"))
    columns = ["conv_id", "depth", "key", "words", "path", "parent", "last"]

    local = cut(dealt(index).groupBy("shard", "block").applyInArrow(lambda rows: _shard_nodes(rows.select(columns)), _NODES), "trie-shards")
    nodes = cut(local.groupBy("path").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")), "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    saves = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    owned = owned.withColumn("saves", saves).withColumn("above", F.coalesce(F.sum("saves").over(above), F.lit(0).cast("long")))
    owned = cut(owned, "trie-owned")
    weights = owned.groupBy("conv_id").agg(F.sum("saves").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    nothing = F.lit(0).cast("long")
    weighted = index.withColumn("conv_id", dealt_anew("conv_id", "long")).join(weights.withColumn("conv_id", dealt_anew("conv_id", "long")), "conv_id", "left")
    weighted = weighted.withColumn("saved", F.coalesce("saved", nothing)).withColumn("leaf", F.coalesce("leaf", nothing))
    sums = dealt(weighted).groupBy("shard", "block").applyInArrow(lambda rows: _shard_sums(rows.select([*columns, "saved", "leaf"])), "path binary, saved long, leaves long")
    sums = sums.groupBy("path").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    ends = local.select("path", F.explode("ends").alias("end")).repartition("path").sortWithinPartitions("path", "end").mapInArrow(_hashed, "path binary, ends_sha256 string")
    whose = nodes.select(dealt_anew("path"), F.col("conv_id").alias("parent_conv_id")).withColumnRenamed("path", "parent")
    joined = owned.join(sums, "path").join(ends, "path", "left").withColumn("parent", dealt_anew("parent")).join(whose, "parent", "left")
    return joined.select(
        "path", F.col("depth").cast("long").alias("depth"), "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saved") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): each conversation c starts anew with the first h turns of conversation c - c % 20 and goes on with its own
    turns after its first h, where h is the CRC-32 of its id modulo 4.  Turns are numbered by (part, turn) anew."""
    c = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("role", "text")])
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = c.withColumn("at", F.row_number().over(in_order) - 1)
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    ids = c.select("conv_id").distinct()
    heads = numbered.filter("at < 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("at").cast("long").alias("turn"), "role", "text")
    begun = ids.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("h", h).join(heads, "base").filter("turn < h").select("conv_id", "turn", "role", "text")
    own = numbered.filter(F.col("at") >= h).select("conv_id", (F.col("at") + 3).cast("long").alias("turn"), "role", "text")
    return begun.unionByName(own), ids


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return prefix_trie(turns, ids).select(columns)


# A path is the SHA-256 of its turns' digests, one after the other.
OP13_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {sql_crc32("conv_id::VARCHAR")} % 4 AS h FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth FROM c),
ids AS (SELECT DISTINCT conv_id, h FROM c),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, nth, role, text FROM ids i JOIN numbered n ON n.conv_id = i.conv_id - i.conv_id % 20 AND nth < i.h
  UNION ALL SELECT conv_id, 1, nth, role, text FROM numbered WHERE nth >= h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, nth) AS depth, sha256(length(role) || ':' || role || text) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words FROM rebuilt),
walk AS (
  SELECT conv_id, 0::BIGINT AS depth, sha256('') AS path, NULL::VARCHAR AS parent, 0::BIGINT AS words FROM ids
  UNION ALL SELECT t.conv_id, t.depth, sha256(w.path || t.key), w.path, t.words FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.depth = w.depth + 1),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path),
nodes AS (SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM walk GROUP BY path),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up AS (
  SELECT path AS top, parent AS next, (n_convs - 1) * words AS saved, (path NOT IN (SELECT parent FROM children))::BIGINT AS leaf FROM nodes
  UNION ALL SELECT u.next, n.parent, u.saved, u.leaf FROM up u JOIN nodes n ON n.path = u.next),
sums AS (SELECT top, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.parent LEFT JOIN children k ON k.parent = n.path JOIN sums s ON s.top = n.path LEFT JOIN ends e ON e.path = n.path
"""
