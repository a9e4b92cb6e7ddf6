r"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of each non-blank line and the one before it; where it hits one of AVERAGE values, a chunk of two or more
lines ends. So boundaries depend on the lines beside them alone: a line put in or taken out changes the chunk around it, and those after it stay. Chunks
whose digest occurs more than once are fetched and compared byte by byte with the first occurrence (smallest doc_id, then place); those
that are equal are repeats.

A passage rarely begins and ends where a chunk does, so repeats then grow line by line to both sides, and passages too short to hold a
whole chunk are found: every two neighbouring non-blank lines (with the blank lines between them) that don't both lie in one repeated chunk are
compared in the same way. Repeats that overlap or touch are removed as one, so every run of two or more non-blank lines that
occurs earlier goes whole. The first place of every line stays.

Defined cases: null text is empty; text without a repeated chunk is returned as it is; single lines are never removed;
blank lines before and after a chunk stay; rows that repeat doc_id and text are one document and get the same result; a chunk
within one document may repeat too; very long texts are cut like others; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, mix, text_of, word_hashes


#: One boundary in so many lines, and the multiplier of the rolling hash.
AVERAGE, BASE = 4, np.uint64(0x100000001B3)


def windows(lines: list[bytes]) -> list[tuple[int, int]]:
    """(start, stop) of each two neighbouring non-blank lines, in lines."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    return [(a, b + 1) for a, b in zip(at, at[1:])]


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(start, stop) of each chunk of two or more non-blank lines; one line may be left at the end."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    h = word_hashes([lines[i] for i in at])
    ends = mix(h[:-1] * BASE + h[1:]) % np.uint64(AVERAGE) == 0 if len(h) > 1 else np.zeros(0, bool)
    out, first = [], 0
    for n in [*(np.flatnonzero(ends) + 1).tolist(), len(at) - 1]:
        if n > first:
            out.append((at[first], at[n] + 1))
            first = n + 1
    return out


def _hash(lines: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\n".join(lines))


_DIGESTS = "doc_id long, tid binary, n_lines long, numbers array<int>, hashes array<long>"


def _digests(units):
    """Numbers and digests of a text's units; those inside its removed chunks (gone, if there is such a column) are left out."""
    def run(batches):
        for b in batches:
            n, numbers, hashes = [], [], []
            removed = b.column("gone").to_pylist() if "gone" in b.schema.names else [None] * b.num_rows
            for text, gone in zip(b.column("text").to_pylist(), removed):
                lines = text.split(b"\n")
                inside, at = sorted((x["start"], x["stop"]) for x in gone or []), 0
                kept = []
                for i, (start, stop) in enumerate(units(lines)):
                    while at < len(inside) and inside[at][1] < stop:
                        at += 1
                    if not (at < len(inside) and inside[at][0] <= start):
                        kept.append((i, _hash(lines[start:stop])))
                n.append(len(lines))
                numbers.append([i for i, _ in kept])
                hashes.append(np.array([h for _, h in kept], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), pa.array(n, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], [f.split()[0] for f in _DIGESTS.split(", ")])
    return run


_FETCHED = "doc_id long, tid binary, number int, hash long, chunk binary, start int, stop int"


def _fetch(units):
    """The bytes of the wanted units."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for doc, tid, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tid", "text", "wanted"))):
                    lines = text.split(b"\n")
                    held = units(lines)
                    for i in (i for run in wanted for i in range(run["start"], run["stop"])):
                        chunk = b"\n".join(lines[slice(*held[i])])
                        h = xxhash.xxh3_64_intdigest(chunk)
                        out.append((doc, tid, i, h - (1 << 64) * (h >> 63), chunk, *held[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()))], [f.split()[0] for f in _FETCHED.split(", ")])
    return run


def _runs(ranges: DataFrame, name: str) -> DataFrame:
    """doc_id, tid and an array of the ranges (start, stop) of each text, merged where they overlap or touch."""
    by = Window.partitionBy("doc_id", "tid").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.select("doc_id", "tid", "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    runs = apart.select("doc_id", "tid", "start", "stop", F.sum("new").over(by).alias("run")).groupBy("doc_id", "tid", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(name))


def _bounded(lists: DataFrame, column: str) -> DataFrame:
    """Written lists with a broadcast hint if their counted entries allow, else as they are (then texts are shuffled)."""
    entries = lists.agg(F.sum(F.size(column) + 1)).first()[0] or 0
    return F.broadcast(lists) if entries <= BROADCAST_ROWS else lists


def _repeats(keyed: DataFrame, texts: DataFrame, units, overlap: int) -> DataFrame:
    """doc_id, tid, start, stop (lines) of the units of keyed texts that are equal to an earlier one which ends at least `overlap` units before."""
    each = texts.select("doc_id", "tid", F.explode(F.arrays_zip("numbers", "hashes")).alias("x")).select("doc_id", "tid", F.col("x.numbers").alias("number"), F.col("x.hashes").alias("hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tid", "number"))
    heads = materialize(each.groupBy("hash").agg(F.count("*").alias("n"), first.alias("head")).where("n > 1").select("hash", "head"))
    again = each.join(heads.select("hash"), "hash", "left_semi").select("doc_id", "tid", F.col("number").alias("start"), (F.col("number") + 1).alias("stop"))
    wanted = _bounded(materialize(_runs(again, "wanted").withColumnsRenamed({"doc_id": "_doc", "tid": "_tid"})), "wanted")
    fetched = materialize(keyed.join(wanted, F.expr("doc_id <=> _doc AND tid = _tid")).select("doc_id", "tid", "text", "wanted").mapInArrow(_fetch(units), _FETCHED))
    at = F.expr("head.doc_id <=> doc_id AND head.tid = tid AND head.number = number")
    kept = fetched.join(heads.withColumnRenamed("hash", "h"), F.expr("hash = h") & at, "left_semi").select(F.col("hash").alias("h"), F.col("chunk").alias("first"), F.col("doc_id").alias("d0"), F.col("tid").alias("t0"), F.col("number").alias("n0")).dropDuplicates(["h"])
    kept = materialize(kept)  # so that the join deals both sides anew, and Spark can split a very common unit
    again = fetched.join(kept, F.expr(f"hash = h AND chunk = first AND NOT (doc_id <=> d0 AND tid = t0 AND number <= n0 + {overlap})"))
    return again.select("doc_id", "tid", "start", "stop")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, gone): texts are doc_id, tid, n_lines; gone are doc_id, tid, removed chunks (start, stop in lines), removed lines."""
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t")).select("doc_id", F.unhex(F.md5("t")).alias("tid"), F.col("t").cast("binary").alias("text"))
    texts = materialize(keyed.mapInArrow(_digests(chunks), _DIGESTS).distinct())
    whole = materialize(_repeats(keyed, texts, chunks, 0))
    # chunks stay apart here: lines on both sides of a boundary are a pair of their own
    held = _bounded(materialize(whole.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone"))), "gone").select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), "gone")
    rest = keyed.join(held, F.expr("doc_id <=> _doc AND tid = _tid"), "left").select("doc_id", "tid", "text", "gone")
    # the next window of the same text shares a line with the first one
    pairs = _repeats(keyed, materialize(rest.mapInArrow(_digests(windows), _DIGESTS).distinct()), windows, 1)
    gone = _runs(whole.union(pairs), "gone")
    return texts.select("doc_id", "tid", "n_lines"), materialize(gone.withColumn("n_removed", F.expr("aggregate(gone, 0L, (a, x) -> a + x.stop - x.start)")))


def without(text: str, gone) -> str:
    """The text without its chunks (start, stop)."""
    lines = text.encode().split(b"\n")
    for x in sorted(gone, key=lambda x: -x["start"]):
        del lines[x["start"] : x["stop"]]
    return b"\n".join(lines).decode()


def _rewrite(text: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([t if g is None or not len(g) else without(t, g) for t, g in zip(text, gone)], dtype=object)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with its text rewritten (and n_chars, if there is one), n_lines and n_removed_lines added as _n_lines and _n_removed."""
    texts, gone = removals(docs)
    g = _bounded(gone, "gone").select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), F.col("gone").alias("_gone"), F.col("n_removed").alias("_n_removed"))
    text = F.coalesce(F.expr("cast(d.text AS string)"), F.lit(""))
    out = docs.alias("d").join(g, F.expr("cast(d.doc_id AS bigint) <=> _doc") & (F.unhex(F.md5(text)) == F.col("_tid")), "left")
    new = F.when(F.col("_gone").isNull(), F.col("d.text")).otherwise(F.col("_new"))
    out = out.withColumn("_new", F.pandas_udf(_rewrite, "string")(F.when(F.col("_gone").isNotNull(), text), "_gone"))
    cols = {"text": new} | ({"n_chars": F.when(F.col("_gone").isNull(), F.col("d.n_chars")).otherwise(F.char_length("_new"))} if "n_chars" in docs.columns else {})
    return out.select(*(cols[c].cast(docs.schema[c].dataType).alias(c) if c in cols else F.col(f"d.`{c}`") for c in docs.columns),
        F.size(F.split(text, "\n")).cast("long").alias("_n_lines"), F.coalesce("_n_removed", F.lit(0)).cast("long").alias("_n_removed"))


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed_lines"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated chunks."""
    return dedup(docs).select(*docs.columns)
