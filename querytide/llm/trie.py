"""Prefix trie of conversations in succinct level-order form (LOUDS), with rollups per node.

1. Rebuilding. Each turn becomes a 128-bit digest of (role, text) and its number of words; texts travel no
   further. A conversation's digests are sorted by turn, and joined with the head of its base
   conversation.
2. Prefixes. A prefix is known by a chained 128-bit digest. Prefixes are counted, combined per batch
   before the shuffle. One with more than `limit` members is heavy: the limit grows with the corpus so
   that there are at most `HEAVY` of them, and that set may go to all tasks.
3. Shards. A conversation leaves the heavy prefixes at its first light one. The subtrees below light
   prefixes are dealt to buckets; in each, numpy builds the level-order bit vector and the label array of
   their trie, level after level, and rolls members, leaves and saved words up in reverse
   level order with `add.at`.
4. Upper levels. The heavy prefixes form a trie of their own, of bounded size. What the light subtrees
   below each heavy node sum to is aggregated, and the same rollup runs over the upper trie once.
5. Conversations that end at a heavy prefix may be a large part of all. Their ids are sorted by range,
   joined in pieces, and hashed piece by piece.

Defined results: null role or text is empty; turns sort by turn, null first, turns that share a number by
their digest. Rows without conv_id belong to no conversation. A conversation whose own turns all
fall to a base that is absent is turnless, a member of the root alone. An empty table gives no rows.
The unit is a conversation: one task holds the digests of one, 20 bytes a turn. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk

WORD = "[^\\x20\\x09-\\x0D]+"
#: Conversations that share a base, and turns that a conversation may take from it.
FAMILY, TURNS = 20, 4
#: Members that make a prefix heavy at least, heavy prefixes at most, and turns of a bucket.
MEMBERS, HEAVY, BUCKET = 256, 1 << 16, 1 << 18
ROOT = bytes(16)
NODES = "above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's own sequence of (label, words), written."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", label.alias("label"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return tables.written(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["label"].alias("label"), t["words"].alias("words"))).alias("turns")), "turns")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns): digested conversations, their first turns replaced by their base's."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, TURNS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS).cast("int")
    both = own.withColumn("base", base).hint("merge").join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), taken), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", taken + 1, F.lit((1 << 31) - 1))).alias("turns"))


def paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, labels, prefixes, words), packed by 16, 16 and 4 bytes a turn, written."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            length = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = turns.flatten()
            labels = np.frombuffer(b"".join(flat.field("label").to_pylist()), np.uint64).reshape(-1, 2)
            words = flat.field("words").to_numpy(zero_copy_only=False).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(length)])
            prefixes, at, live = np.zeros_like(labels), np.zeros((len(length), 2), np.uint64), np.flatnonzero(length > 0)
            for depth in range(int(length.max(initial=0))):
                live = live[length[live] > depth]
                place = offsets[live] + depth
                for k in (0, 1):  # two independent families; each lane takes in both lanes of the label
                    at[live, k] = tk.joined(tk.joined(at[live, k], labels[place, 0], k + 1), labels[place, 1], k + 1)
                prefixes[place] = at[live]
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut(labels), pa.binary()), pa.array(cut(prefixes), pa.binary()), pa.array(cut(words), pa.binary())], names=["conv_id", "labels", "prefixes", "words"])

    tables.small_batches(sequences.sparkSession)
    return tables.written(sequences.mapInArrow(mapper, "conv_id long, labels binary, prefixes binary, words binary"), "paths")


def counted(sequences: DataFrame) -> DataFrame:
    """(prefix, parent, depth, words, n_convs, conv_id): each prefix with its members and the smallest of them."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(2).to_pylist())
            length = np.array([len(x) // 16 for x in batch.column(2).to_pylist()], np.int64)
            prefixes = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            words = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32)
            depth = np.arange(len(prefixes)) - np.repeat(np.cumsum(length) - length, length)
            conv = np.repeat(batch.column(0).to_numpy(), length)
            order = np.lexsort((conv, prefixes[:, 1], prefixes[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (prefixes[order[1:]] != prefixes[order[:-1]]).any(axis=1)
            first, n = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
            cell = lambda i: raw[16 * i : 16 * i + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell(i) for i in first.tolist()], pa.binary()), pa.array([cell(i - 1) if d else ROOT for i, d in zip(first.tolist(), depth[first].tolist(), strict=True)], pa.binary()), pa.array(depth[first] + 1), pa.array(words[first].astype(np.int64)), pa.array(n), pa.array(conv[first])],
                names=["prefix", "parent", "depth", "words", "n_convs", "conv_id"],
            )

    rows = sequences.mapInArrow(mapper, "prefix binary, parent binary, depth long, words long, n_convs long, conv_id long")
    return rows.groupBy("prefix").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


class Louds:
    """A trie in level order: node 0 is the root; `bits` has a one for each child of a node and a zero after them."""

    def __init__(self, children: np.ndarray, levels: np.ndarray) -> None:
        self.levels = levels
        self.bits = np.ones(2 * len(children) - 1, bool)
        self.bits[np.cumsum(children) + np.arange(len(children))] = False

    def children(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Of each node but the root: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[0], ones - np.arange(len(ones))])

    def up(self, update: np.ufunc, values: np.ndarray, parents: np.ndarray) -> None:
        """Rolls `values` up in place, in reverse level order."""
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            update.at(values, parents[a:b], values[a:b])


def louds_of(ids: np.ndarray, length: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """The trie of label sequences; the label of each node, and the node where each sequence ends."""
    offsets = np.cumsum(length) - length
    base = int(ids.max(initial=0)) + 1
    at, live, nodes = np.zeros(len(length), np.int64), np.arange(len(length)), 1
    parents, labels, levels = [], [np.zeros(1, np.int64)], [0, 1]
    for depth in range(int(length.max(initial=0))):
        live = live[length[live] > depth]
        keys, inverse = np.unique(at[live] * base + ids[offsets[live] + depth], return_inverse=True)
        at[live] = nodes + inverse
        parents.append(keys // base)
        labels.append(keys % base)
        nodes += len(keys)
        levels.append(nodes)
    return Louds(np.bincount(np.concatenate([*parents, np.zeros(0, np.int64)]), minlength=nodes), np.array(levels)), np.concatenate(labels), at


def rolled(trie: Louds, n: np.ndarray, words: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n_leaves, saved_tokens) of the subtrees, from what each node has itself and what hangs below it outside this trie."""
    parents = trie.parents()
    saved = saved + (n - 1) * words
    trie.up(np.add, leaves, parents)
    trie.up(np.add, saved, parents)
    return leaves, saved


def subtrees(table: pa.Table) -> pa.Table:
    """NODES of the light subtrees of one bucket."""
    conv, depth = table["conv_id"].to_numpy(), table["depth"].to_numpy()
    raw = table["labels"].to_pylist()
    length = np.array([len(x) // 16 for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.zeros(len(order), np.int64)
    new[1:] = (flat[order[1:]] != flat[order[:-1]]).any(axis=1)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    trie, labels, end = louds_of(ids, length)
    parents, children = trie.parents(), trie.children()
    size = len(children)

    words_of = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    # A root's label is its prefix, all others are turns; both have one number of words each
    words_of[ids] = np.frombuffer(b"".join(table["words"].to_pylist()), np.int32)
    words = words_of[labels]
    words[0] = 0
    n, first = np.zeros(size, np.int64), np.full(size, (1 << 63) - 1)
    np.add.at(n, end, 1)
    np.minimum.at(first, end, conv)
    trie.up(np.add, n, parents)
    trie.up(np.minimum, first, parents)
    leaves, saved = rolled(trie, n, words, (children == 0).astype(np.int64), np.zeros(size, np.int64))

    level = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    above = [None] * size
    above_of, root_depth = table["above"].to_pylist(), np.zeros(size, np.int64)
    top = end.copy()
    for _ in range(int(length.max(initial=0)) - 1):
        deep = level[top] > 1
        if not deep.any():
            break
        top[deep] = parents[top[deep]]
    for i, x in enumerate(top.tolist()):
        above[x] = above_of[i]
    root_depth[top] = depth
    for a, b in zip(trie.levels[2:-1], trie.levels[3:], strict=True):
        root_depth[a:b] = root_depth[parents[a:b]]

    hashes = [NOTHING] * size
    ranked = np.lexsort((conv, end))
    cut = np.flatnonzero(np.diff(end[ranked], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ranked)], strict=True):
        hashes[int(end[ranked[a]])] = hashlib.sha256(",".join(map(str, conv[ranked[a:b]].tolist())).encode()).hexdigest()
    keep = slice(1, None)
    return pa.table(
        {
            "above": pa.array(above[keep], pa.binary()),
            "conv_id": first[keep],
            "depth": (root_depth + level)[keep],
            "parent_conv_id": pa.array(first[parents][keep], mask=(level == 1)[keep]),
            "n_convs": n[keep],
            "n_children": children[keep],
            "n_leaves": leaves[keep],
            "saved_tokens": saved[keep],
            "ends_sha256": pa.array(hashes[keep], pa.string()),
        }
    )


def dealt(sequences: DataFrame, heavy: frozenset[bytes], buckets: int) -> DataFrame:
    """(bucket, conv_id, above, depth, labels, words): what each conversation has below its last heavy prefix, `above`, at `depth`.

    The first label is the light prefix itself, which names the subtree; no labels: it ends at `above`."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, labels, prefixes, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                d = 0
                while d < len(prefixes) and prefixes[d : d + 16] in heavy:
                    d += 16
                light = prefixes[d : d + 16]
                out.append((int.from_bytes(light[:8], "little") % buckets, conv, prefixes[d - 16 : d] if d else ROOT, d // 16, light + labels[d + 16 :], words[d // 4 :]))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["bucket", "conv_id", "above", "depth", "labels", "words"])

    return sequences.mapInArrow(mapper, "bucket int, conv_id long, above binary, depth long, labels binary, words binary")


def ends_of(ended: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) over the conversations (above, conv_id) that end at heavy prefixes, in bounded memory."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [i for i in range(len(node)) if not i or node[i] != node[i - 1]]
            rows = [(node[a], conv[a], ",".join(map(str, conv[a:b]))) for a, b in zip(cut, [*cut[1:], len(node)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["prefix", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_pydict({"prefix": pa.array([now], pa.binary()), "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        yield row()
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if now is not None:
            yield row()

    lists = ended.select("above", "conv_id").repartitionByRange("above", "conv_id").sortWithinPartitions("above", "conv_id").mapInArrow(pieces, "prefix binary, first long, ids string")
    return lists.repartition("prefix").sortWithinPartitions("prefix", "first").select("prefix", "ids").mapInArrow(hashed, "prefix binary, ends_sha256 string")


def upper(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heavy nodes' results, from (prefix, parent, depth, words, n_convs, conv_id, below, leaves, saved, ends_sha256): HEAVY + 1 rows at most."""
    batches = [b for b in rows if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).sort_by([("depth", "ascending"), ("parent", "ascending"), ("prefix", "ascending")])
    prefix, parent = table["prefix"].to_pylist(), table["parent"].to_pylist()
    depth = table["depth"].to_numpy()
    levels = [int(np.searchsorted(depth, d)) for d in range(int(depth[-1]) + 2)]
    # In level order children stand by the places of their parents
    order, place = [0], {prefix[0]: 0}
    for a, b in zip(levels[1:-1], levels[2:], strict=True):
        for i in sorted(range(a, b), key=lambda i: (place[parent[i]], i)):
            place[prefix[i]] = len(order)
            order.append(i)
    table = table.take(order)
    own = np.bincount([place[x] for x in table["parent"].to_pylist()[1:]], minlength=len(order)).astype(np.int64)
    trie = Louds(own, np.array(levels))
    get = lambda c: table[c].fill_null(0).to_numpy().astype(np.int64)
    n, first, children = get("n_convs"), get("conv_id"), own + get("below")
    leaves, saved = rolled(trie, n, get("words"), get("leaves") + (children == 0), get("saved"))
    up = pa.array(first[trie.parents()], mask=np.arange(len(first)) == 0)
    yield pa.RecordBatch.from_arrays(
        [table["prefix"].combine_chunks(), pa.array(first), table["depth"].combine_chunks(), up, pa.array(n), pa.array(children), pa.array(leaves), pa.array(saved), table["ends_sha256"].fill_null(NOTHING).combine_chunks()],
        names=[x.split()[0] for x in NODES.split(", ")],
    )


def prefix_trie(conversations: DataFrame, members: int = MEMBERS, most: int = HEAVY) -> DataFrame:
    """A row of RESULT for each node of the trie of the rebuilt `conversations` (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    own = digested(conversations)
    sequences = paths(rebuilt(own))
    tables.removed(own)
    total, convs, smallest = sequences.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)) / 4, F.count("*"), F.min("conv_id")).first()
    limit = max(members, int(total // most))  # heavy prefixes have more members each, and the members of all prefixes are `total`
    heavy = tables.written(counted(sequences).where(F.col("n_convs") > limit), "heavy")
    known = frozenset(bytes(r.prefix) for r in heavy.select("prefix").toLocalIterator())  # `most` at most
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-total // BUCKET)))
    parts = dealt(sequences, known, buckets)
    nodes = tables.written(parts.where(F.length("labels") > 0).groupBy("bucket").applyInArrow(subtrees, NODES), "nodes")

    root = spark.createDataFrame([(bytearray(ROOT), None, 0, 0, convs, smallest)] if convs else [], "prefix binary, parent binary, depth long, words long, n_convs long, conv_id long")
    below = nodes.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ends = ends_of(parts.where(F.length("labels") == 0))
    frame = heavy.select(root.columns).unionByName(root).join(below.withColumnRenamed("above", "prefix"), "prefix", "left").join(ends, "prefix", "left")
    tops = tables.written(frame.coalesce(1).mapInArrow(upper, NODES), "upper")
    for done in (sequences, heavy):
        tables.removed(done)
    names = F.broadcast(tops.select(F.col("above").alias("_up"), F.col("conv_id").alias("_of")))  # HEAVY + 1 rows at most
    light = nodes.join(names, nodes["above"] == names["_up"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_of"))
    return light.select(*RESULT).unionByName(tops.select(*RESULT))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(tables.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, b: xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY p) + (SELECT count(*) FROM t b WHERE b.conv_id = c.base AND b.p <= c.h), role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h
), s AS (
  SELECT conv_id, list(md5(len(role)::VARCHAR || ':' || role || text) ORDER BY p) AS labels,
    list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY p) AS words
  FROM r GROUP BY conv_id
), u AS (SELECT c.conv_id, coalesce(labels, []) AS labels, coalesce(words, []) AS words FROM c LEFT JOIN s USING (conv_id)),
d AS (
  SELECT conv_id, d AS depth, array_to_string(labels[1:d], ',') AS prefix, array_to_string(labels[1:d - 1], ',') AS parent,
    CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, len(labels) = d AS ends
  FROM u, unnest(generate_series(0, len(labels))) AS g(d)
), n AS (
  SELECT depth, prefix, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM d GROUP BY depth, prefix
), k AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
x AS (
  SELECT a.depth, a.prefix, sum((b.n_children = 0)::INT) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM m a JOIN m b ON b.depth >= a.depth AND (a.depth = 0 OR b.prefix = a.prefix OR starts_with(b.prefix, a.prefix || ',')) GROUP BY 1, 2
)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN x USING (depth, prefix) LEFT JOIN m q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.prefix = m.parent
"""
