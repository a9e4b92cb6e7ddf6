"""Near-duplicate groups: MinHash bands propose pairs, odd sketches screen them, full shingle sets decide.

Rows with the same shingle set form one class, so thousands of copies cost one sketch. Bands of classical MinHash samples
propose: within a band's bucket every class is paired with the bucket's centre, the class that shares most places with
others over all bands. Classes left outside a bucket's largest component then meet a few more centres, round by round; what
still is apart is compared across components in tiles of at most TILE members, each pair once, so no link between
proposed classes is lost and no task holds a whole bucket.

The screen is an odd sketch: a set's one-permutation MinHash samples (the smallest shingle hash of each of SAMPLES ranges)
are folded into BITS parity bits. The XOR of two sketches counts their differing samples; with the numbers of samples
and shingles known, the count expected at the threshold follows, with the spread of the sampling and of the fold. A pair
goes to the exact test unless it lies SIGMAS spreads beyond, or beyond what differing shingles can set at most: the XOR
never counts more bits than samples differ, and those are the differing shingles and one for each shingle that
shares its range with another of its set. Small sets have nearly every shingle as a sample, so their screen is nearly exact.

With 32 bands of 5 samples a pair at similarity 0.85 escapes every bucket with probability 9e-9 (0.80: 3e-6). Sets are held as
64-bit hashes of shingles.

Defined cases: null text is empty; a text without words has an empty set and links with nothing; fewer than five words
are one shingle; repeated rows share one class; a null doc_id takes part and counts as larger than any id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, joined_by, materialize, mix, ngrams, text_of, word_hashes

SHINGLE, BANDS, ROWS, SAMPLES, BITS, SIGMAS = 5, 32, 5, 8192, 2048, 6
#: Fixed hash parameters, drawn from a stated seed.
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]
#: ROUNDS with CENTRES new centres a bucket go on while rows have more than SMALL partners in other components on average.
ROUNDS, CENTRES, SMALL, TILE = 1, 8, 4, 1024
_LONG, _SIGN = np.int64, [f"o{i}" for i in range(BITS // 64)]
_KNOWN = ["n_shingles", "samples", *_SIGN]


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text."""
    words = word_hashes(text.lower().split())
    if len(words) >= SHINGLE:
        return np.unique(ngrams(words, SHINGLE))
    return np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=7)], np.uint64) if len(words) else words


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: the minima of ROWS permutations."""
    x, low = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        low = np.minimum(low, (_A * x[None, i : i + 1024] + _B).min(axis=1))
    return np.array([xxhash.xxh3_64_intdigest(p.tobytes(), seed=i) for i, p in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(_LONG)


def odd_sketch(found: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of samples, parity of how many of them fall on each of BITS places, as longs)."""
    part = found >> np.uint64(64 - SAMPLES.bit_length() + 1)
    least = found[np.append(True, part[1:] != part[:-1])[: len(found)]]
    at = mix(least) >> np.uint64(64 - BITS.bit_length() + 1)
    return len(least), np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(_LONG)


def _sketches(batches):
    for b in batches:
        ns, tids, prints, bands, many, odd = [], [], [], [], [], []
        for text in b.column("text").to_pylist():
            found = shingle_set(text)
            tids.append(hashlib.md5(text).digest())
            ns.append(len(found))
            prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            bands.append(band_keys(found) if len(found) else None)
            n, bits = odd_sketch(found)
            many.append(n)
            odd.append(bits)
        grid = np.array(odd, _LONG).reshape(-1, len(_SIGN))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(tids, pa.binary()), pa.array(ns, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(many, pa.int32()), *(pa.array(grid[:, i]) for i in range(len(_SIGN)))],
            ["doc_id", "tid", "n_shingles", "node", "bands", "samples", *_SIGN])


def _sets(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            found = [shingle_set(t) for t in b.column("text").slice(lo, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "items"])


def _judge(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _near(num: int, den: int) -> str:
    """SQL over sides p and q: sizes allow the threshold and the odd sketches don't rule it out.

    At similarity j the union has u = (sum of sizes) / (1 + j) shingles and fills v of the k ranges; a share j of its
    samples, drawn without replacement, agrees. The other d samples set b / 2 * (1 - exp(-2 d / b)) bits."""
    j, k, b = num / den, SAMPLES, BITS
    u = f"((p.n_shingles + q.n_shingles) / {1 + j}D)"
    full = lambda n: f"({k}D * (1 - exp(-{n} / {k}D)))"
    e = f"exp(-{u} / {k}D)"
    # expected for the union, in the proportion that the two sets themselves show
    v = f"({full(u)} * (p.samples + q.samples) / ({full('p.n_shingles')} + {full('q.n_shingles')}))"
    d = f"greatest(p.samples + q.samples - {2 * j}D * {v}, 0D)"
    spread = f"({v} * {j * (1 - j)}D * greatest({u} - {v}, 0D) / {u} + {j * j * (1 - j * j)}D * greatest({k}D * {e} * (1 - (1 + {u} / {k}D) * {e}), 0D))"
    fold = f"greatest({b / 4}D * (1 - exp(-4 * {d} / {b}D)) - {d} * exp(-4 * {d} / {b}D), 0D)"
    likely = f"{b / 2}D * (1 - exp(-2 * {d} / {b}D)) + {SIGMAS} * sqrt(4 * exp(-4 * {d} / {b}D) * {spread} + {fold}) + 1"
    differ = f"floor({(1 - j) / (1 + j) + 1e-12}D * (p.n_shingles + q.n_shingles)) + p.n_shingles - p.samples + q.n_shingles - q.samples"
    xor = " + ".join(f"bit_count(p.{o} ^ q.{o})" for o in _SIGN)
    return f"{den} * least(p.n_shingles, q.n_shingles) >= {num} * greatest(p.n_shingles, q.n_shingles) AND {xor} <= {differ} AND {xor} <= {likely}"


def links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the written pairs (a, b) of classes that reach the threshold on their full sets; sets are built for the
    pairs' classes only."""
    nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    held = bounded(nodes.join(classes.select("node", F.col("label").alias("_label")), "node").select("_label").distinct())
    texts = docs.select("doc_id", text_of(docs).cast("binary").alias("text")).alias("d").join(held, F.expr("d.doc_id <=> _label"), "left_semi")
    sets = materialize(texts.mapInArrow(_sets, "node binary, items binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return materialize(both.mapInArrow(_judge(num, den), "a binary, b binary"))


def members(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, tid (digest of its text), n_shingles, root (its group, null without words), component_id (smallest
    doc_id of the group)."""
    rows = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(
        _sketches, "doc_id long, tid binary, n_shingles long, node binary, bands array<long>, samples int, " + ", ".join(f"{o} long" for o in _SIGN)))
    full = rows.where("n_shingles > 0")
    classes = materialize(full.groupBy("node").agg(F.min("doc_id").alias("label"), F.first(F.struct(*_KNOWN, "bands")).alias("s")).select("node", "label", "s.*"))
    slim = classes.select("node", *_KNOWN)
    banded = classes.select("node", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(banded.join(crowded, "key"))
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    places = materialize(shared.join(weight, "node"))
    centres = places.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    near = F.expr(_near(num, den))

    def screened(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(slim.alias("p"), F.expr("a = p.node")).join(slim.alias("q"), F.expr("b = q.node")).where(near).select("a", "b")

    tested = materialize(screened(places.join(centres, "key").select(F.col("centre").alias("a"), F.col("node").alias("b"))))
    roots = materialize(components(links(docs, tested, classes, num, den)))
    for round_ in range(ROUNDS + 1):
        # a bucket of two is settled by its one pair; larger ones are settled when they lie in one component
        at = places.where("n > 2").join(roots, "node", "left").select("key", "node", "n", "weight", F.coalesce("root", "node").alias("root"))
        parts = at.groupBy("key", "root").agg(F.count("*").alias("m"))
        open_ = parts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("major"), F.sum(F.col("m") * F.col("m")).alias("within"), F.count("*").alias("roots")).where("roots > 1").select("key", "major.root", "within").withColumnRenamed("root", "major")
        at = materialize(at.join(open_, "key"))
        # each row has n - within / n partners elsewhere on average
        apart = at.agg(F.sum(F.expr("n - within / n")), F.count("*")).first()
        last = round_ == ROUNDS or (apart[0] or 0) <= SMALL * apart[1]
        if not last:  # classes outside the major component meet CENTRES heavy classes of their two largest buckets
            slot = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(CENTRES))
            heavy = at.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("weight", "node", "root")).alias("c"))
            loose = at.where("root <> major").withColumn("nth", F.expr("row_number() OVER (PARTITION BY node ORDER BY n DESC, key)")).where("nth <= 2")
            pairs = screened(loose.join(heavy, "key").where("root <> c.root").select(F.col("c.node").alias("a"), F.col("node").alias("b")))
        else:  # all that is still apart, each pair in one bucket and tile; the screen is part of the join, so only likely pairs become rows
            tiles = F.ceil(F.col("n") / TILE).cast("int")
            wide = at.select("key", "node", "root", tiles.alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
            wide = wide.join(classes.select("node", *_KNOWN, "bands"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            wide = materialize(wide.withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other")).drop("tiles", "other"))
            once = "array_min(array_intersect(p.bands, q.bands)) = p.key"
            pairs = wide.alias("p").join(wide.alias("q"), F.expr(f"p.key = q.key AND p.x = q.x AND p.y = q.y AND (p.tile <> q.tile OR p.x = p.y) AND p.root < q.root AND {_near(num, den)} AND {once}"))
            pairs = pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
        fresh = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            more = links(docs, fresh, classes, num, den)
            tested = tested.union(fresh)
            if not more.isEmpty():
                roots = joined_by(roots, more)
        if last:
            break
    homes = classes.select("node", "label").join(roots, "node", "left").select("node", "label", F.coalesce("root", "node").alias("root"))
    lows = homes.groupBy("root").agg(F.min("label").alias("component_id"))
    homes = homes.join(lows, "root").select("node", "root", "component_id")
    return rows.select("doc_id", "tid", "n_shingles", "node").join(homes, "node", "left").select("doc_id", "tid", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def groups(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id linked, directly or not), kept."""
    return members(docs, num, den).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id (an id before none), then the smallest digest of its text, and of rows
    that repeat both just one. Texts without words are in no group and all stay. A doc_id may stand at several texts: each of them
    goes or stays by its own group."""
    found = materialize(members(docs, 80, 100).select("doc_id", "tid", "root"))
    rows = found.where("root IS NOT NULL").groupBy("root", "doc_id", "tid").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tid", "n")).alias("x")).select("x.doc_id", "x.tid", "x.n")
    alone = found.where("root IS NULL").select("doc_id", "tid").distinct()
    side = lambda df: bounded(df.select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")))
    same = F.expr("d.doc_id <=> _doc") & (F.unhex(F.md5(text_of(docs))) == F.col("_tid"))
    single = docs.alias("d").join(side(first.where("n = 1").select("doc_id", "tid").union(alone)), same, "left_semi")
    repeated = side(first.where("n > 1"))
    if repeated.isEmpty():
        return single
    return single.union(docs.alias("d").join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
