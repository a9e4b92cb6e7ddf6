"""Passages that repeat across documents, by a sparse suffix array.

A window of MIN_WORDS words belongs to its minimiser: the place in it whose next K words have the smallest hash (the leftmost of
equal ones). Equal windows have it at the same offset, so only suffixes at such places are retained, one word in about
twenty. What a place can tell is its own stretch: the words from the first to the last window that belong to it.

1. Places with an equal stretch make one class; in a class of two or more every window repeats, so copies and the inside of
   long passages are settled by one hash each.
2. Classes that share their first K words with another class, so mostly the ends of passages, are sorted by what follows (a
   range partition over key and context, so a very common key spreads over many tasks), compared with their NEIGHBOURS on
   both sides and extended right and left word by word.
3. A key with more classes than that, or one that a range boundary cuts, may hold partners further apart. Its windows
   that no match with a smaller place covers are grouped by hash, in partial form first. The smallest window of each content
   is always among them, so no repeat is missed.

Offsets of repeated windows are bits of one number a place. A span may go if it matches one of a smaller (doc_id, place);
the smallest one always stays. Texts that are equal as a whole are one entry. Words are compared by hashes: 64 bits a word
for classes and keys, 32 bits a word over at least MIN_WORDS words between neighbours.

Defined cases: null text is empty; empty or short texts have no spans; equal texts are whole repeats of the smallest
doc_id; rows that repeat a doc_id and text count as repeats too; a null doc_id comes last; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, mix, text_of, word_hashes

MIN_WORDS, K = 50, 12
#: Places in a window, and sorted neighbours on either side that each class is compared with.
W, NEIGHBOURS = MIN_WORDS - K + 1, 4
#: Words to the left of a place, and from it on, that lie in windows with it.
LEFT, RIGHT = W - 1, MIN_WORDS
#: Words hashed at once, unless one text has more.
CHUNK = 1 << 17
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Rolling:
    """Hashes of any stretches of a sequence of hashes, by prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * _powers(_BASE, n))])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def owners(grams: np.ndarray) -> np.ndarray:
    """For each W neighbouring grams the position of the smallest one (by its upper 40 bits, then the leftmost)."""
    most, out = 1 << 24, []
    for at in range(0, max(len(grams) - W + 1, 0), most - W):
        part = grams[at : at + most - 1]
        x = (part & ~np.uint64(most - 1)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= W:
            x, size = np.minimum(x[:-size], x[size:]), size * 2
        x = np.minimum(x[: len(x) - (W - size)], x[W - size :])
        out.append((x[: most - W] & np.uint64(most - 1)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _places(words: np.ndarray, sizes: np.ndarray):
    """Retained places of texts laid end to end: text number, place in it, key, hash of its stretch, smallest and largest
    offset of the place in its windows."""
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    roll, n = Rolling(words), len(words)
    if n < MIN_WORDS:
        return (np.zeros(0, np.int64),) * 6
    at = np.arange(n - K + 1)
    grams = roll.of(at, at + K)
    own = owners(grams)
    start = np.flatnonzero(np.arange(len(own)) + MIN_WORDS <= ends[text[: len(own)]])
    own = own[start]
    head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[start[1:]] != text[start[:-1]]))[: len(own)])
    last = np.append(head[1:], len(own))[: len(head)] - 1
    place, first, end = own[head], start[head], start[last]
    whole = mix(roll.of(first, end + MIN_WORDS) + (place - first).astype(np.uint64))
    which = text[place]
    return which, place - (ends - sizes)[which], grams[place].view(np.int64), whole.view(np.int64), place - end, place - first


PLACE = "place int, key long, span long, low tinyint, high tinyint"
_LISTS = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in PLACE.split(", "))
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.int8())


def _groups(sizes: list[int]):
    """Ranges of texts with CHUNK words or so together."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > CHUNK:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _retain(batches):
    for b in batches:
        col = b.column("text")
        for lo, hi in _groups([len(x) // 6 for x in (v.as_buffer() for v in col)]):
            part, words, sizes = b.slice(lo, hi - lo), [], []
            for t in part.column("text").to_pylist():
                w = t.split()
                sizes.append(len(w))
                words.append(word_hashes(w))
            which, *cols = _places(np.concatenate(words), np.array(sizes, np.int64))
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(which, minlength=len(sizes)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(c).cast(t)) for c, t in zip(cols, _TYPES)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "tid", "n_words", *(c.split()[0] for c in PLACE.split(", "))])


SUFFIX = "key long, span long, nameless boolean, label long, tid binary, place int, low tinyint, high tinyint, crowded boolean, after binary, ahead binary"
_FIELDS = [c.split()[0] for c in SUFFIX.split(", ")]
_ARROW = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.int8(), pa.int8(), pa.bool_(), pa.binary(), pa.binary())


def _contexts(batches):
    """For the chosen places of each text: the words of its stretch from the place on and, reversed, those before, as 32-bit hashes."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part, out = b.slice(at, 64), []
            for tid, label, text, wanted in zip(*(part.column(c).to_pylist() for c in ("tid", "label", "text", "wanted"))):
                short = (word_hashes(text.split()) >> np.uint64(32)).astype(">u4")
                for x in wanted:
                    p = x["place"]
                    out.append((x["key"], x["span"], label is None, label, tid, p, x["low"], x["high"], x["crowded"], short[p : p + RIGHT - x["low"]].tobytes(), short[p - x["high"] : p][::-1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], _FIELDS)


def _grid(col: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded to width, their lengths)."""
    size = np.fromiter(map(len, col), np.int64, len(col)) // 4
    flat = np.frombuffer(b"".join(col), ">u4").astype(np.uint32)
    out = np.zeros((len(col), width), np.uint32)
    out[np.arange(width)[None] < size[:, None]] = flat
    return out, size


def _same(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of rows, most at most."""
    return np.minimum(np.column_stack([x != y, np.ones(len(x), bool)]).argmax(axis=1), most)


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers whose bits low to high are set; none if high < low."""
    size = np.maximum(high - low + 1, 0).astype(np.uint64)
    return np.where(size > 0, ((np.uint64(1) << size) - np.uint64(1)) << np.maximum(low, 0).astype(np.uint64), np.uint64(0))


def _neighbours(batches):
    """Offsets of repeated windows of a sorted partition's rows, and its first and last key for the cuts between partitions."""
    held, ends = None, []
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.table(b.select(_FIELDS[:-3] + _FIELDS[-2:])) if hasattr(b, "select") else pa.Table.from_batches([b])
        seam = held.num_rows if held is not None else 0
        if seam:
            rows = pa.concat_tables([held, rows])
        key = rows.column("key").to_numpy()
        ends = [ends[0] if ends else int(key[0]), int(key[-1])]
        (after, right), (ahead, left) = _grid(rows.column("after").to_pylist(), RIGHT), _grid(rows.column("ahead").to_pylist(), LEFT)
        low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
        order = sorted(range(len(key)), key=list(zip(*(rows.column(c).to_pylist() if c != "label" else rows.column(c).fill_null(0).to_pylist() for c in ("nameless", "label", "tid", "place")))).__getitem__)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        every, gone = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)
        for s in range(1, NEIGHBOURS + 1):
            i = np.arange(max(0, seam - s), max(len(key) - s, 0))  # rows before the seam were compared among themselves
            i = i[key[i] == key[i + s]]
            if len(i):
                j = i + s
                r, l = _same(after[i], after[j], np.minimum(right[i], right[j])), _same(ahead[i], ahead[j], np.minimum(left[i], left[j]))
                both = _bits(np.maximum(np.maximum(low[i], low[j]), MIN_WORDS - r), np.minimum(np.minimum(high[i], high[j]), l))
                every[i] |= both
                every[j] |= both
                later = rank[i] > rank[j]
                gone[i[later]] |= both[later]
                gone[j[~later]] |= both[~later]
        hit = np.flatnonzero(every)
        yield _masks(key[hit], rows.column("span").to_numpy()[hit], every[hit], gone[hit], False)
        held = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
    if ends:
        yield _masks(np.array(ends), np.zeros(2, np.int64), np.zeros(2, np.uint64), np.zeros(2, np.uint64), True)


MASKS = "key long, span long, every long, gone long, edge boolean"


def _masks(key, span, every, gone, edge):
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(span), pa.array(every.view(np.int64)), pa.array(gone.view(np.int64)), pa.array([edge] * len(key), pa.bool_())], [c.split()[0] for c in MASKS.split(", ")])


def _windows(batches):
    """The windows at the open offsets of each place: key, span, the place's order, offset, hash."""
    power, back = _powers(_BASE, LEFT + RIGHT), _powers(_INVERSE, LEFT + 1)
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            (after, _), (ahead, _) = _grid(part.column("after").to_pylist(), RIGHT), _grid(part.column("ahead").to_pylist(), LEFT)
            line = np.concatenate([ahead[:, ::-1], after], axis=1).astype(np.uint64)  # the place is at LEFT
            sums = np.concatenate([np.zeros((len(line), 1), np.uint64), np.cumsum(mix(line * np.uint64(0xD6E8FEB86659FD93)) * power, axis=1)], axis=1)
            open_, rows, offsets, hashes = part.column("open").to_numpy().view(np.uint64), [], [], []
            for o in range(W):
                i = np.flatnonzero(open_ >> np.uint64(o) & np.uint64(1))
                rows.append(i)
                offsets.append(np.full(len(i), o, np.int8))
                hashes.append(mix((sums[i, LEFT - o + MIN_WORDS] - sums[i, LEFT - o]) * back[LEFT - o]))
            rows = pa.array(np.concatenate(rows))
            names = ["key", "span", "nameless", "label", "tid", "place"]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in names), pa.array(np.concatenate(offsets)), pa.array(np.concatenate(hashes).view(np.int64))], [*names, "offset", "hash"])


def _merged(cover: np.ndarray) -> list[dict]:
    at = np.flatnonzero(np.diff(cover > 0, prepend=False, append=False))
    return [{"start": int(a), "stop": int(z)} for a, z in zip(at[::2], at[1::2])]


SPANS = "array<struct<start:int,stop:int>>"


def _lay(batches):
    """Spans of each text from the offsets of its places."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        out = []
        for got in b.column("found").to_pylist():
            place = np.array([x["place"] for x in got], np.int64)
            laid = []
            for c in ("every", "gone"):
                bits = np.array([x[c] for x in got], np.int64).view(np.uint64)
                row, o = np.nonzero(bits[:, None] >> np.arange(W, dtype=np.uint64) & np.uint64(1))
                start = place[row] - o
                step = np.zeros(int(place.max()) + MIN_WORDS + 2, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + MIN_WORDS, -1)
                laid.append(_merged(np.cumsum(step)))
            out.append(laid)
        yield pa.RecordBatch.from_arrays([b.column("tid"), *(pa.array([x[i] for x in out], kind) for i in (0, 1))], ["tid", "spans", "removable"])


def _compared(keyed: DataFrame, open_: DataFrame) -> DataFrame:
    """key, span, every, gone: offsets of the repeated windows of classes that share their key with another class."""
    wanted = materialize(open_.groupBy(F.col("rep.tid").alias("_tid"), F.col("rep.label").alias("_label")).agg(F.collect_list(F.struct("rep.place", "key", "span", "low", "high", "crowded")).alias("wanted")))
    names = bounded(wanted.select("_tid", "_label"))
    texts = keyed.join(names, F.expr("doc_id <=> _label AND tid = _tid"), "left_semi").dropDuplicates(["tid"])
    suffixes = materialize(texts.join(wanted, F.expr("tid = _tid")).select("tid", F.col("_label").alias("label"), "text", "wanted").mapInArrow(_contexts, SUFFIX))
    order = ["key", "after", "nameless", "label", "tid", "place"]
    parts = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = materialize(suffixes.drop("crowded").repartitionByRange(int(parts), *order).sortWithinPartitions(*order).mapInArrow(_neighbours, MASKS))
    near = found.where("NOT edge").groupBy("key", "span").agg(F.bit_or("every").alias("every"), F.bit_or("gone").alias("gone"))
    # keys on both sides of a boundary: two rows a partition, so a bounded list
    cut = F.broadcast(found.where("edge").groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("cut")))
    near = materialize(near)
    owned = "((1L << (high - low + 1)) - 1L) << low"
    rest = suffixes.join(cut, "key", "left").where("crowded OR cut").join(near.drop("every"), ["key", "span"], "left")
    rest = rest.withColumn("open", F.expr(f"({owned}) & ~coalesce(gone, 0L)")).where("open <> 0")
    windows = materialize(rest.select("key", "span", "nameless", "label", "tid", "place", "after", "ahead", "open").mapInArrow(_windows, "key long, span long, nameless boolean, label long, tid binary, place int, offset tinyint, hash long"))
    at = ["key", "offset", "hash"]
    heads = materialize(windows.groupBy(*at).agg(F.count("*").alias("n"), F.min(F.struct("nameless", "label", "tid", "place", "span")).alias("head")).where("n > 1").select(*at, F.col("head.span").alias("head")))
    bit = "1L << offset"
    far = windows.join(heads, at).groupBy("key", "span").agg(F.expr(f"bit_or({bit})").alias("every"), F.expr(f"bit_or(CASE WHEN span <> head THEN {bit} ELSE 0L END)").alias("gone"))
    return materialize(near.union(far).groupBy("key", "span").agg(F.bit_or("every").alias("every"), F.bit_or("gone").alias("gone")))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts are doc_id, tid, n_words; spans are tid, spans and removable (arrays of start, stop in words)."""
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t")).select("doc_id", F.unhex(F.md5("t")).alias("tid"), F.col("t").cast("binary").alias("text"))
    names = [c.split()[0] for c in PLACE.split(", ")]
    texts = materialize(keyed.mapInArrow(_retain, f"doc_id long, tid binary, n_words long, {_LISTS}"))
    one = texts.where(F.size("place") > 0).groupBy("tid").agg(F.min("doc_id").alias("label"), F.first(F.struct(*names)).alias("s"))
    places = materialize(one.select("tid", "label", F.explode(F.arrays_zip(*(F.col(f"s.{c}") for c in names))).alias("x")).select("tid", "label", *(F.col(f"x.{c}").alias(c) for c in names)))
    # a key that occurs once has neither a copy nor a partner: most places end here, before wide rows are dealt out by class
    several = materialize(places.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
    # keys with more than a task's fair share of the places, at most one a task, stay where they are
    share = places.count() // int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(several.where(F.col("_n") > share).select("key"))
    others = several.where(F.col("_n") <= share).select("key").hint("merge")
    places = materialize(places.join(heavy, "key", "left_semi").union(places.join(heavy, "key", "left_anti").join(others, "key", "left_semi")))
    rep = F.min(F.struct(F.col("label").isNull().alias("nameless"), "label", "tid", "place")).alias("rep")
    classes = materialize(places.groupBy("key", "span").agg(F.count("*").alias("n"), rep, F.first("low").alias("low"), F.first("high").alias("high")))
    # more than NEIGHBOURS + 1 classes of a key: not every two of them are neighbours
    shared = materialize(classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", (F.col("k") > NEIGHBOURS + 1).alias("crowded")))
    masks = _compared(keyed, classes.join(shared, "key"))
    known = classes.join(masks, ["key", "span"], "left").where("n > 1 OR every IS NOT NULL").select("key", "span", "n", F.col("rep.tid").alias("_tid"), F.col("rep.place").alias("_place"), "every", "gone")
    whole = "((1L << (high - low + 1)) - 1L) << low"
    member = places.join(materialize(known), ["key", "span"]).select("tid", F.struct("place",
        F.expr(f"CASE WHEN n > 1 THEN {whole} ELSE every END").alias("every"),
        F.expr(f"CASE WHEN tid = _tid AND place = _place THEN coalesce(gone, 0L) ELSE {whole} END").alias("gone")).alias("x"))
    spans = member.groupBy("tid").agg(F.collect_list("x").alias("found")).mapInArrow(_lay, f"tid binary, spans {SPANS}, removable {SPANS}")
    return texts.select("doc_id", "tid", "n_words"), spans


def find(docs: DataFrame) -> DataFrame:
    """One row per document that holds a repeated passage: doc_id, n_words, spans and removable (arrays of start, stop in
    words), n_repeated, n_removable. Equal texts of MIN_WORDS words or more are repeats as a whole."""
    texts, spans = repeats(docs)
    copies = texts.where(f"n_words >= {MIN_WORDS}").groupBy("tid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    known = materialize(copies.join(spans, "tid", "left").where("copies > 1 OR spans IS NOT NULL"))
    whole, none = F.expr("array(named_struct('start', 0, 'stop', int(n_words)))"), F.expr(f"cast(array() AS {SPANS})")
    out = texts.join(known, "tid").select("doc_id", "n_words", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"),
        F.when((F.col("copies") > 1) & ~F.col("doc_id").eqNullSafe(F.col("low")), whole).otherwise(F.coalesce("removable", none)).alias("removable"))
    total = lambda c: F.expr(f"aggregate({c}, 0L, (a, x) -> a + x.stop - x.start)")
    return out.withColumn("n_repeated", total("spans")).withColumn("n_removable", total("removable"))


def digest(found: DataFrame) -> DataFrame:
    said = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.start, ':', x.stop)), ',')")
    return found.select("doc_id", "n_words", said("spans").alias("spans"), said("removable").alias("removable"), "n_repeated", "n_removable")
