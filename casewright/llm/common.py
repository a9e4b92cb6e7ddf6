"""Helpers shared by the training-data operators."""

from __future__ import annotations

import time

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.network import shared_path

#: A word is a maximal run of anything but ASCII white space, which is what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, "llm")
    df.write.option("compression", "zstd").parquet(path)
    _release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Seconds between collections, and when the last one was.
RELEASE_EVERY, _released = 8, [0.0]


def _release(spark: SparkSession) -> None:
    """Let Spark delete the broadcasts and shuffle files of finished steps: its cleaner does so once the driver's JVM has
    collected their handles, which may take half an hour while they fill the executors' memory and disks."""
    if time.monotonic() - _released[0] > RELEASE_EVERY:
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


#: Rows of texts that Python gets at a time: thousands of long texts in one batch would fill its memory and the JVM's buffers.
TEXTS = 1000


def text_of(docs: DataFrame) -> Column:
    """The text column, empty where null; the session's Arrow batches are limited to TEXTS rows, unless it limits them more."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= TEXTS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS)
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


#: A key list of at most so many rows (some 16 bytes each) is broadcast; beyond, its join is shuffled.
BROADCAST_ROWS = 500_000


def bounded(keys: DataFrame) -> DataFrame:
    """Written keys with a broadcast hint if their counted size allows, else as they are."""
    keys = materialize(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def slices(batch, column: str = "text", most: int = 1 << 21):
    """Parts of an Arrow batch whose binary column holds `most` bytes or so, or one longer text."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Nothing is kept: hashing again is faster than looking words up, and needs no memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and shift, wrapping)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each window of n word hashes."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + mix(hashes[i : i + count] + np.uint64(i))
    return mix(out)


def agreement(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of b, and of a from at on, agree."""
    n = min(len(a) - at, len(b))
    if a.startswith(b[:n], at):
        return n
    low, high = 0, n - 1  # agree in low, not in high + 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[low:mid], at + low) else (low, mid - 1)
    return low


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) of every node that isn't its component's root, the smallest
    node.

    Alternating large-star and small-star rounds; each round is written to the shared folder. Every round is joins
    and minimums, so a node with very many neighbours is pre-aggregated and its join side can be split by AQE.
    """
    now, before = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            both.where("b < a").join(low, "a").select(F.col("a"), F.col("m").alias("b"))).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        now = materialize(small)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == before:
            break
        before = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined_by(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of all links so far, from those known as roots and some more links: only components that the new
    links touch take part in the rounds."""
    of = lambda c: F.coalesce(F.col(f"r{c}.root"), F.col(c)).alias(c)
    between = links.join(roots.alias("ra"), F.expr("a = ra.node"), "left").join(roots.alias("rb"), F.expr("b = rb.node"), "left").select(of("a"), of("b"))
    merged = components(between)
    moved = roots.join(merged.select(F.col("node").alias("old"), F.col("root").alias("new")), F.expr("root = old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialize(moved.union(merged))
