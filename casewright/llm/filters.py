"""Filter interaction audit: what five filters remove in every order, with duplicates found by radix tries over full texts.

One pass over the texts: a task inserts its texts, CHUNK bytes at a time, into a compressed trie that holds the smallest id at each
terminal. So a chunk's copies of a text become one entry, with the text's failure bits, however many there are. Entries
are then range-partitioned by adaptive text prefixes: a prefix of FIRST bytes, then four times as many and so on, until the entries
that share it hold no more than a task's fair share, at most HEAVY bytes (or it is the whole text). A task inserts the entries of its prefixes, whole, into one
trie and hands the smallest id back to the entries that share a terminal. Documents carry that as a bit of their mask, meet
their labels, and masks are counted by part; all orders are derived from those counts.

A text's longer prefixes are told apart by 64-bit hashes; that only decides which task gets it, texts themselves are compared byte by byte.
A text that a third of all rows share is one entry a chunk. Texts themselves are moved once.

Defined cases: null text is empty, null lang an empty string; a null doc_id has no labels, is no duplicate and makes none; rows that repeat a doc_id
and its text count each and aren't duplicates of one another; a label that is 1 in any of a doc_id's rows counts; very long texts are
compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreement, bounded, materialize, slices, text_of

FILTERS = "ABCDE"
CHUNK, HEAVY, LEAST, FIRST = 16 << 20, 256 << 20, 1 << 16, 8
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_ENTRY = "chunk long, number int, text binary, size long, bits int, low long, steps array<long>, members array<struct<doc_id: long, part: string>>"


def bits(text: bytes) -> int:
    """Failures of A to D as bits 0 to 3."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode())
    capitals, marks = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _MARKS))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | (marks > 0) << 3


class Node:
    """A node of a compressed trie: the bytes that lead to it, its children by first byte, and what ends at it."""

    __slots__ = ("label", "children", "low", "held")

    def __init__(self, label: bytes):
        self.label, self.children, self.low, self.held = label, {}, None, None


class Trie:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, low: int | None) -> Node:
        """The terminal of a text, with its smallest id brought up to date."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                at = len(text)
            else:
                n = agreement(text, at, child.label)
                at += n
                if n < len(child.label):  # part the edge
                    fork = node.children[child.label[0]] = Node(child.label[:n])
                    child.label = child.label[n:]
                    fork.children[child.label[0]] = child
                    child = fork
            node = child
        if node.held is None:
            node.held = []
        if low is not None and (node.low is None or low < node.low):
            node.low = low
        return node

    def terminals(self, texts: bool = True):
        """(text, node) of every inserted text; text is None if not asked for."""
        stack = [(b"", self.root)]
        while stack:
            lead, node = stack.pop()
            text = lead + node.label if texts else None
            if node.held is not None:
                yield text, node
            stack += [(text, c) for c in node.children.values()]


def steps(text: bytes) -> list[int]:
    """A hash of each adaptive prefix, the last of which is the whole text."""
    out, n = [], FIRST
    while True:
        out.append(xxhash.xxh3_64_intdigest(text[:n], seed=n if n < len(text) else 1) - (1 << 63))
        if n >= len(text):
            return out
        n *= 4


def _entries(trie: Trie, chunk: int):
    rows, size = [], 0
    for number, (text, node) in enumerate(trie.terminals()):
        rows.append((chunk, number, text, len(text), bits(text), node.low, steps(text), node.held))
        size += len(text) + 24 * len(node.held)
        if size > 1 << 21:
            yield rows
            rows, size = [], 0
    yield rows


def _local(batches):
    from pyspark import TaskContext

    chunk, trie, size = TaskContext.get().partitionId() << 32, Trie(), 0
    schema = pa.schema([("chunk", pa.int64()), ("number", pa.int32()), ("text", pa.binary()), ("size", pa.int64()), ("bits", pa.int32()), ("low", pa.int64()), ("steps", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string())])))])

    def flush():
        for rows in _entries(trie, chunk):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    for b in batches:
        for part in slices(b):
            for doc, lang, text in zip(part.column("doc_id").to_pylist(), part.column("part").to_pylist(), part.column("text").to_pylist()):
                trie.insert(text, doc).held.append({"doc_id": doc, "part": lang})
                size += len(text) + 100
                if size > CHUNK:
                    yield from flush()
                    chunk, trie, size = chunk + 1, Trie(), 0
    yield from flush()


def _merge(batches):
    """Entries whose text other entries share, with the smallest id of all."""
    trie = Trie()
    for b in batches:
        for chunk, number, text, low in zip(*(b.column(c).to_pylist() for c in ("chunk", "number", "text", "low"))):
            trie.insert(text, low).held.append((chunk, number))
    rows = []
    for _, node in trie.terminals(texts=False):
        if len(node.held) > 1:
            rows += [(*h, node.low) for h in node.held]
        if len(rows) > 10_000:
            yield _found(rows)
            rows = []
    yield _found(rows)


def _found(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.int32(), pa.int64()))], ["chunk", "number", "least"])


def placed(entries: DataFrame, heavy_bytes: int = HEAVY) -> DataFrame:
    """Written entries with the place (level of the prefix, its hash) by which they are dealt out: the shortest prefix whose entries hold at most
    heavy_bytes, or else the whole text."""
    each = entries.select("size", F.posexplode("steps").alias("level", "step"))
    heavy = bounded(each.groupBy("level", "step").agg(F.sum("size").alias("held")).where(F.col("held") > heavy_bytes).select("level", "step"))
    deepest = heavy.agg(F.max("level")).first()[0]
    level, out = F.lit(0), entries
    for i in range(0 if deepest is None else deepest + 1):
        known = heavy.where(F.col("level") == i).select(F.col("step").alias(f"_s{i}"))
        out = out.join(known, F.get("steps", F.lit(i)) == F.col(f"_s{i}"), "left")
        level = F.when(F.col(f"_s{i}").isNull(), level).otherwise(F.least(F.lit(i + 1), F.size("steps") - 1))
    return out.withColumn("place", F.struct(F.substring("text", 1, FIRST).alias("prefix"), F.get("steps", level).alias("step"))).select(*entries.columns, "place")


def duplicates(entries: DataFrame, heavy_bytes: int = HEAVY) -> DataFrame:
    """chunk, number and the smallest id of the text, for written entries that share their text with others. There are so many tasks that
    one has about heavy_bytes of texts to hold; a prefix is heavy from a task's fair share on."""
    spark, total = entries.sparkSession, entries.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // heavy_bytes))
    share = min(heavy_bytes, max(total // tasks, LEAST))
    dealt = placed(entries.select("chunk", "number", "text", "low", "size", "steps"), share).select("chunk", "number", "text", "low", "place")
    return dealt.repartitionByRange(tasks, "place").mapInArrow(_merge, "chunk long, number int, least long")


def masks(docs: DataFrame, heavy_bytes: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, part, mask (bit i: fails filter i)."""
    lang = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), lang.alias("part"), text_of(docs).cast("binary").alias("text"))
    entries = materialize(texts.mapInArrow(_local, _ENTRY))
    least = bounded(duplicates(entries, heavy_bytes))
    rows = entries.select("chunk", "number", "bits", "low", "members").join(least, ["chunk", "number"], "left")
    each = rows.select("bits", F.coalesce("least", "low").alias("low"), F.explode("members").alias("m"))
    return each.select("m.doc_id", "m.part", (F.col("bits") + F.when(F.expr("m.doc_id > low"), 16).otherwise(0)).alias("mask"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, mask, good and toxic."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return masks(docs).join(known, "doc_id", "left").groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.count("*").alias("n"))


def orders():
    """An array of all steps of all permutations: filter_order, step, the bit of the step's filter and the bits of the filters before it."""
    rows = [{"filter_order": "".join(p), "step": i + 1, "bit": 1 << FILTERS.index(p[i]), "before": sum(1 << FILTERS.index(f) for f in p[:i])} for p in permutations(FILTERS) for i in range(len(FILTERS))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    found = materialize(counts(docs, labels))
    each, n = found.select("*", F.inline(orders())), F.col("n")
    fails, clear = F.expr("mask & bit <> 0"), F.expr("mask & before = 0")
    total = lambda test, name, value=n: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long").alias(name)
    return each.groupBy("part", "filter_order", "step").agg(
        total(clear & ~fails, "kept"), total(clear & fails, "removed"), total(fails & ~clear, "redundant"), total(F.expr("mask = bit"), "unique_fails"),
        total(clear & fails & F.col("good"), "good_lost"), total(clear & fails & F.col("toxic"), "toxic_lost"),
        # of all orders, one in bit_count(mask) removes a document by this filter
        total(fails, "shapley", n * F.expr("120 div greatest(bit_count(mask), 1)")))
