"""Conversation prefix trie, built of adaptive radix trees over fixed-width turn ids.

A turn's id is the 128-bit digest of its role and text, big-endian as written, so a conversation is a key of WIDTH bytes a turn.
Conversations are rebuilt beside the one that lends them their head (families of five share a shuffle), and equal ones become one key with
its number and its smallest id. Keys are dealt to tasks by prefix: the shortest one that only one key or at most `heavy` turns share, by default a task's fair
share, so a first turn that a third of all conversations begin with is spread by what follows. A task inserts its keys into an
adaptive radix tree (nodes of 4, 16, 48 or 256 children that grow when full, paths without a branch compressed) and emits a
node for each turn-aligned byte depth, with the sums of its subtree. Nodes whose prefix is shared by more than one task's keys come in
parts: they are few (turns / heavy at each depth), get merged, and pass their sums on to their ancestors by number of row; that takes
the square of the depth down to which a prefix is that common.

The ids that end at a node are sorted by range over all tasks, joined in pieces of PIECE bytes, and the pieces of a node are hashed in
turn, so copies of one conversation are nowhere held at once.

Defined cases: a null role or text is empty; null turns come first; turns that tie are taken in the order of their digest, repeated
rows stay repeated turns; rows with a null conv_id belong to no conversation; a conversation with neither a head nor turns beyond it is
a member of the root alone; an empty table has no node, not even a root; very long texts count by their bytes; other columns are ignored.
One conversation's turns (some 24 bytes each, without texts) are one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreement, bounded, materialize

WIDTH, HEADS, FAMILY = 16, 9, 5
#: Turns that one task holds at most (some 400 bytes each), least turns worth a place of their own, bytes of one piece of ids.
MOST, LEAST, PIECE = 500_000, 64, 1 << 16


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (turn ids in turn), sizes (bytes of the texts): each conversation with the head of its family's first one."""
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    turn_id = F.md5(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), turn_id.alias("id"), F.octet_length(text("text")).alias("size")).alias("turn"))
    turns = turns.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).repartition("family")
    own = turns.groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # rows are dealt by family already, so this takes no further shuffle
    families = own.groupBy("family").agg(F.collect_list(F.struct("conv_id", "turns")).alias("convs"))
    each = families.select(F.expr("get(filter(convs, c -> c.conv_id = family), 0).turns").alias("lent"), F.inline("convs"))
    h = F.expr(f"cast(crc32(cast(cast(conv_id AS string) AS binary)) % {HEADS} AS int)")
    path = each.withColumn("h", h).select("conv_id", F.expr("concat(slice(coalesce(lent, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("path"))
    return path.select("conv_id", F.unhex(F.array_join("path.id", "")).alias("key"), F.col("path.size").alias("sizes"))


def _chained(batches):
    """Adds chain: a 64-bit hash of each prefix of the key."""
    for b in batches:
        chains = []
        for key in b.column("key").to_pylist():
            state, chain = xxhash.xxh3_64(), []
            for at in range(0, len(key), WIDTH):
                state.update(key[at : at + WIDTH])
                chain.append(state.intdigest())
            chains.append(np.array(chain, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chains, pa.list_(pa.int64()))], [*b.schema.names, "chain"])


class Few:
    """Up to 16 children: their bytes, and beside them the children. Node4 and Node16 of the tree."""

    def __init__(self):
        self.bytes, self.nodes, self.room = bytearray(), [], 4

    def get(self, byte: int):
        i = self.bytes.find(byte)
        return None if i < 0 else self.nodes[i]

    def put(self, byte: int, node) -> "Few | Index":
        i = self.bytes.find(byte)
        if i >= 0:
            self.nodes[i] = node
        elif len(self.nodes) < self.room or self.room == 4:
            self.room = 16 if len(self.nodes) == 4 else self.room
            self.bytes.append(byte)
            self.nodes.append(node)
        else:
            return Index(self).put(byte, node)
        return self

    def all(self):
        return self.nodes


class Index:
    """Up to 48 children: a place for each byte that says which of them is its. Node48."""

    def __init__(self, few: Few):
        self.at, self.nodes = bytearray(b"\xff" * 256), list(few.nodes)
        for i, byte in enumerate(few.bytes):
            self.at[byte] = i

    def get(self, byte: int):
        i = self.at[byte]
        return None if i == 255 else self.nodes[i]

    def put(self, byte: int, node) -> "Index | Full":
        if self.at[byte] != 255:
            self.nodes[self.at[byte]] = node
        elif len(self.nodes) < 48:
            self.at[byte] = len(self.nodes)
            self.nodes.append(node)
        else:
            return Full(self).put(byte, node)
        return self

    def all(self):
        return self.nodes


class Full:
    """A place for each of 256 bytes. Node256."""

    def __init__(self, index: Index):
        self.nodes = [index.get(byte) for byte in range(256)]

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "Full":
        self.nodes[byte] = node
        return self

    def all(self):
        return [n for n in self.nodes if n is not None]


class Node:
    """Bytes of a path without a branch, the children after it, and the number of the key that ends here, or -1."""

    __slots__ = ("path", "children", "row")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.children, self.row = path, Few(), row


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(key[at:], row))
                return
            n = agreement(key, at, child.path)
            if n < len(child.path):  # part the path
                fork = Node(child.path[:n])
                node.children = node.children.put(key[at], fork)
                child.path = child.path[n:]
                fork.children = fork.children.put(child.path[0], child)
                child = fork
            node, at = child, at + n
        node.row = row

    def aligned(self):
        """(depth in turns, number of the parent or -1, number of the key that ends here or -1) of each turn-aligned depth, parents first."""
        out = [(0, -1, -1)]
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, parent = stack.pop()
            end = at + len(node.path)
            for depth in range(at // WIDTH + 1, end // WIDTH + 1):
                out.append((depth, parent, -1))
                parent = len(out) - 1
            if node.row >= 0:  # a key ends at a whole turn
                out[parent] = (*out[parent][:2], node.row)
            stack += [(c, end, parent) for c in node.children.all()]
        return out


_NODE = "top boolean, id long, up long, conv_id long, depth long, parent_conv_id long, n_convs long, size long, n_children long, n_leaves long, saved_tokens long, end binary"


def _nodes(batches):
    """Nodes of a task's keys. Of a node above them (top), the part that is seen here: its sums are those of the whole nodes right below."""
    tree, keys, sizes, chains, lows, ns, heavy = Tree(), [], [], [], [], [], []
    for b in batches:
        for column, held in (("key", keys), ("low", lows), ("n", ns), ("heavy", heavy)):
            held += b.column(column).to_pylist()
        sizes += [x.values.to_numpy() for x in b.column("sizes")]
        chains += [x.values.to_numpy() for x in b.column("chain")]
    if not keys:
        return
    for row, key in enumerate(keys):
        tree.insert(key, row)
    depth, parent, ends = zip(*tree.aligned())
    count = len(depth)
    best, n = list(ends), [ns[r] if r >= 0 else 0 for r in ends]
    kids, leaves, saved, size, top = ([0] * count for _ in range(5))
    for i in range(count - 1, -1, -1):
        r, d, p = best[i], depth[i], parent[i]
        size[i] = int(sizes[r][d - 1]) if d else 0
        top[i] = d <= heavy[r]
        if not top[i]:
            leaves[i] += not kids[i]
            saved[i] += (n[i] - 1) * size[i]
        if p >= 0:
            n[p] += n[i]
            if best[p] < 0 or lows[r] < lows[best[p]]:
                best[p] = r
            if not top[i]:
                kids[p], leaves[p], saved[p] = kids[p] + 1, leaves[p] + leaves[i], saved[p] + saved[i]
    name = lambda i: 0 if depth[i] == 0 else int(chains[best[i]][depth[i] - 1])
    rows = []
    for i in range(count):
        p = parent[i]
        whole = p >= 0 and not top[p]
        rows.append((bool(top[i]), name(i) if top[i] else None, None if whole or p < 0 else name(p), lows[best[i]], depth[i], lows[best[p]] if whole else None, n[i], size[i], kids[i], leaves[i], saved[i],
                     hashlib.md5(keys[ends[i]]).digest() if ends[i] >= 0 else None))
        if len(rows) == 10_000 or i == count - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.bool_(), *[pa.int64()] * 10, pa.binary()))], [f.split()[0] for f in _NODE.split(", ")])
            rows = []


def _pieces(batches):
    """Of rows in the order of end and conv_id: runs of one end, their ids joined."""
    end, ids, size, out = None, [], 0, []

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.binary(), pa.int64(), pa.string()))], ["end", "first", "ids"])

    for b in batches:
        for e, c in zip(b.column("end").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (e != end or size > PIECE):
                out.append((end, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            end, size = e, size + 12
            ids.append(c)
        if len(out) > 10_000:
            yield emit(out)
            out = []
    if ids:
        out.append((end, ids[0], ",".join(map(str, ids))))
    yield emit(out)


def _hashed(batches):
    """Of pieces in the order of end and first id: the hash of each end's ids."""
    end, state, out = None, None, []

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], []), (pa.binary(), pa.string()))], ["end", "ends_sha256"])

    for b in batches:
        for e, ids in zip(b.column("end").to_pylist(), b.column("ids").to_pylist()):
            if e != end:
                if state:
                    out.append((end, state.hexdigest()))
                end, state = e, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield emit(out)
            out = []
    if state:
        out.append((end, state.hexdigest()))
    yield emit(out)


def ending(convs: DataFrame) -> DataFrame:
    """end (digest of a key) and the hash of the sorted ids of the conversations with that key."""
    rows = convs.select(F.unhex(F.md5("key")).alias("end"), "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    pieces = rows.mapInArrow(_pieces, "end binary, first long, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_hashed, "end binary, ends_sha256 string")


def nodes(conversations: DataFrame, heavy: int | None = None) -> DataFrame:
    """One row per node of the trie. heavy: turns beyond which a shared prefix is spread over tasks."""
    spark = conversations.sparkSession
    convs = materialize(rebuilt(conversations))
    distinct = convs.groupBy("key").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), F.first("sizes").alias("sizes"))
    keys = materialize(distinct.mapInArrow(_chained, "key binary, low long, n long, sizes array<int>, chain array<long>"))
    turns = keys.agg(F.sum(F.size("chain"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // MOST))
    heavy = heavy or max(LEAST, turns // tasks)
    prefixes = keys.select("low", F.size("chain").alias("size"), F.posexplode("chain").alias("at", "id"))
    common = bounded(prefixes.groupBy("at", "id").agg(F.sum("size").alias("held"), F.count("*").alias("keys")).where((F.col("held") > heavy) & (F.col("keys") > 1)).select("at", "id"))
    # prefixes of a common prefix are common, so their number is the depth down to which a key's prefixes are
    deep = bounded(prefixes.join(common, ["at", "id"], "left_semi").groupBy("low").agg(F.count("*").cast("int").alias("heavy")))
    placed = keys.join(deep, "low", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0)))
    placed = placed.withColumn("place", F.coalesce(F.get("chain", F.least("heavy", F.size("chain") - 1)), F.lit(0)))
    found = materialize(placed.repartition(tasks, "place").mapInArrow(_nodes, _NODE))

    total = lambda *names: [F.sum(c).alias(c) for c in names]
    tops = materialize(found.where("top").groupBy("id", "up", "depth").agg(F.min("conv_id").alias("conv_id"), *total("n_convs", "n_children", "n_leaves", "saved_tokens"), F.max("size").alias("size"), F.max("end").alias("end")))
    below = tops.where("depth > 0").groupBy(F.col("up").alias("id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    tops = tops.join(below, ["id", "depth"], "left").withColumn("n_children", F.expr("n_children + coalesce(more, 0)"))
    own = tops.withColumn("n_leaves", F.expr("n_leaves + int(n_children = 0)")).withColumn("saved_tokens", F.expr("saved_tokens + (n_convs - 1) * size"))
    above = bounded(own.select("id", "up", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"))
    # the chain of a top node's smallest member begins with its ancestors
    lines = above.where("depth > 0").join(keys.select(F.col("low").alias("conv_id"), "chain"), "conv_id")
    line = F.posexplode(F.expr("concat(array(0L), slice(chain, 1, cast(depth AS int)))")).alias("at", "over")
    sums = lines.select("n_leaves", "saved_tokens", line).union(above.where("depth = 0").select("n_leaves", "saved_tokens", F.lit(0), F.lit(0).cast("long")))
    sums = sums.groupBy(F.col("over").alias("id"), F.col("at").cast("long").alias("depth")).agg(*total("n_leaves", "saved_tokens"))
    up = above.select(F.col("id").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    upper = above.drop("n_leaves", "saved_tokens").join(sums, ["id", "depth"]).join(up, ["up", "depth"], "left").withColumn("parent_conv_id", F.col("up_conv_id"))
    # most nodes have a whole parent; only those right below a common prefix look it up
    whole = found.where("NOT top AND up IS NULL").select(*cols)
    first = found.where("NOT top AND up IS NOT NULL").join(up, ["up", "depth"], "left").withColumn("parent_conv_id", F.col("up_conv_id"))
    out = materialize(whole.union(first.select(*cols)).union(upper.select(*cols)))
    ended = out.where("end IS NOT NULL").join(ending(convs), "end", "left").select(*cols[:-1], "ends_sha256")
    return ended.union(out.where("end IS NULL").select(*cols[:-1], F.sha2(F.lit(""), 256).alias("ends_sha256")))
