"""Hidden Markov language model with class emissions.

A word's class is itself for the WORDS most frequent training words, else one of TIED classes by its ending. A state
emits a class, the class emits the word by its smoothed training count, so the counts of all words count in full
while transitions and emissions keep a fixed size (STATES x classes). Baum-Welch: every partition runs forward and
backward over all its training sequences (in segments of SEGMENT tokens; a segment that continues a document has its own
start distribution, so what the state knew before a cut is not trained across it), expected counts are summed across
partitions by position, and the few thousand sums make the next parameters. States start out sticky, so that they settle on
kinds of text. Scores are exact: the scaled forward recursion over the whole document, never cut.

Word counts are exact over all training documents. Those of the COMMON most frequent words (a fixed bound) go to every
task; the others are joined by word, once per document and word.

Defined cases: null text is empty and scores its end alone; very long texts are scored whole; repeated rows are scored
each; without any training document every token counts as unknown; an empty table gives an empty result; a null
doc_id trains; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_of, word_hashes

STATES, WORDS, TIED, COMMON, ROUNDS, SEGMENT, SEED, STICKY = 8, 2048, 512, 131072, 5, 128, 3, 400
CLASSES = WORDS + TIED + 1  # the last is the end
#: The end token's hash; white space is never part of a word.
END = xxhash.xxh3_64_intdigest(b"\n")
SMOOTH = 0.01


#: Class of a word that isn't one of the WORDS: by its last byte, and by its last two.
_ONE = np.array([WORDS + zlib.crc32(bytes([i])) % TIED for i in range(256)], np.uint16)
_TWO = np.array([WORDS + zlib.crc32(bytes([i >> 8, i & 255])) % TIED for i in range(65536)], np.uint16)


def tied(words: list[bytes]) -> np.ndarray:
    """The ending class of each word."""
    if not words:
        return np.zeros(0, np.uint16)
    size = np.fromiter(map(len, words), np.int64, len(words))
    laid, end = np.frombuffer(b" ".join(words), np.uint8), np.cumsum(size + 1) - 2
    last, before = laid[end], laid[np.maximum(end - 1, 0)]
    return np.where(size > 1, _TWO[before.astype(np.int64) << 8 | last], _ONE[last])


class Vocabulary:
    """The COMMON words by hash, with their counts and ranks."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, ranks: np.ndarray):
        self.common, self.counts, self.ranks = common, counts, ranks

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, class and count (0 if not COMMON) of each word."""
        h = word_hashes(words)
        cls, c = tied(words), np.zeros(len(h), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            hit = np.flatnonzero(self.common[at] == h)
            at = at[hit]
            c[hit] = self.counts[at]
            top = self.ranks[at] < WORDS
            cls[hit[top]] = self.ranks[at[top]].astype(np.uint16)
        return h, cls, c


def _count(batches):
    """Counts of the words of training documents, summed per batch: (h, cls of an infrequent word, n)."""
    for b in (part for whole in batches for part in slices(whole)):
        words, ends = [], b.num_rows
        for text in b.column("text").to_pylist():
            words += text.lower().split()
        h, first, n = np.unique(word_hashes(words), return_index=True, return_counts=True)
        cls = tied([words[i] for i in first]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h, np.uint64(END)).view(np.int64)), pa.array(np.append(cls, np.int32(CLASSES - 1))), pa.array(np.append(n, ends))], ["h", "cls", "n"])


class Counts:
    """Totals of the training tokens: the COMMON words with counts, N, V, and the denominators of the tied classes."""

    def __init__(self, vocabulary: DataFrame):
        total = vocabulary.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = int(total[0] or 0), int(total[1])
        top = vocabulary.where(F.col("cls") != CLASSES - 1).orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
        h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
        order = np.argsort(h)
        self.common, self.counts, self.ranks = h[order], c[order], order.astype(np.int64)  # position in the order of counts
        self.end = int((vocabulary.where(F.col("cls") == CLASSES - 1).agg(F.sum("c")).first()[0]) or 0)
        by = {r[0]: (r[1], r[2]) for r in vocabulary.groupBy("cls").agg(F.sum("c"), F.count("*")).collect()}  # TIED + 1 rows at most
        size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (s, n) in by.items():
            size[k], kinds[k] = s, n
        top_cls = top.column("cls").to_numpy()[:WORDS]
        np.subtract.at(size, top_cls, c[:WORDS])
        np.subtract.at(kinds, top_cls, 1)
        self.log_z = float(np.log10(self.n + 0.5 * (self.v + 1)))
        self.log_d = np.log10(size + 0.5 * (kinds + 1))


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, word double, cls binary, rare array<long>, rare_n array<int>"


def _encode(t: Counts):
    def run(batches):
        vocabulary = Vocabulary(t.common, t.counts, t.ranks)
        for b in batches:
            cols = [[] for _ in range(7)]
            for text in b.column("text").to_pylist():
                h, cls, c = vocabulary.of(text.lower().split())
                own, loose = c > 0, cls >= WORDS
                logs = np.log10(c[own] + 0.5)
                rare, n = np.unique(h[~own], return_counts=True)
                base = logs.sum() + np.log10(t.end + 0.5) - t.log_z * (len(h) + 1)
                word = np.log10(c[own & loose] + 0.5).sum() - t.log_d[cls[loose]].sum()
                row = (len(h) + 1, int(own.sum()) + (t.end > 0), float(base), float(word), np.append(cls, np.uint16(CLASSES - 1)).astype("<u2").tobytes(), rare.view(np.int64), n.astype(np.int32))
                for col, x in zip(cols, row):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *(pa.array(c, k) for c, k in zip(cols, types))], [f.split()[0] for f in ENCODED.split(", ")])
    return run


class Model:
    """start (of a document, of a continuation), trans and emit (class by state) of the HMM."""

    def __init__(self, sums: np.ndarray | None = None):
        k = STATES
        if sums is None:
            rng = np.random.default_rng(SEED)
            # states that last, and emissions far enough apart that documents of a kind soon share one
            sums = np.concatenate([np.ones(2 * k), (np.eye(k) * STICKY + rng.uniform(0.5, 1.5, (k, k))).ravel(), rng.exponential(1.0, k * CLASSES)])
        start, trans, emit = np.split(sums + SMOOTH, [2 * k, 2 * k + k * k])
        norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
        self.start, self.trans = norm(start.reshape(2, k), 1), norm(trans.reshape(k, k), 1)
        self.emit = norm(emit.reshape(CLASSES, k), 0)

    def expected(self, cls: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Expected counts over segments: cls (time, segment) padded with CLASSES, lengths in falling order."""
        k, (steps, width) = STATES, cls.shape
        emit = np.vstack([self.emit, np.ones(k)])
        alpha, scale = np.zeros((steps, width, k)), np.ones((steps, width))
        on = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # segments longer than t
        for t in range(steps):
            m = on[t]
            a = (self.start[np.where(first, 0, 1)] if t == 0 else alpha[t - 1, :m] @ self.trans)[:m] * emit[cls[t, :m]]
            s = a.sum(axis=1)
            alpha[t, :m], scale[t, :m] = a / s[:, None], s
        trans, gamma, beta = np.zeros((k, k)), alpha, np.ones((width, k))
        for t in range(steps - 2, -1, -1):
            m = on[t + 1]
            e = emit[cls[t + 1, :m]] * beta[:m] / scale[t + 1, :m, None]
            trans += alpha[t, :m].T @ e
            gamma[t + 1, :m] *= beta[:m]
            beta[:m] = e @ self.trans.T
        gamma[0] *= beta
        flat = cls.ravel()
        emitted = np.stack([np.bincount(flat, gamma[:, :, i].ravel(), CLASSES + 1)[:CLASSES] for i in range(k)], axis=1)
        start = np.stack([gamma[0][first].sum(axis=0), gamma[0][~first].sum(axis=0)])
        return np.concatenate([start.ravel(), (trans * self.trans).ravel(), emitted.ravel()])

    def log10(self, cls: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of whole class sequences laid end to end, by the scaled forward recursion."""
        order = np.argsort(-length, kind="stable")
        begin = (np.cumsum(length) - length)[order]
        total, alpha = np.zeros(len(length)), np.tile(self.start[0], (len(length), 1))
        falling = length[order]
        for t in range(int(falling[0]) if len(falling) else 0):
            m = int(np.searchsorted(-falling, -t, side="left"))
            a = (alpha[:m] if t == 0 else alpha[:m] @ self.trans) * self.emit[cls[begin[:m] + t]]
            s = a.sum(axis=1)
            total[:m] += np.log10(s)
            alpha = a / s[:, None]
        out = np.zeros(len(length))
        out[order] = total
        return out


def _sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    seqs = [np.frombuffer(x, "<u2") for x in col.to_pylist()]
    return np.concatenate(seqs).astype(np.int64) if seqs else np.zeros(0, np.int64), np.array([len(s) for s in seqs], np.int64)


def _expect(model: Model):
    def run(batches):
        sums = None
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                cls, length = _sequences(b.column("cls").slice(at, 2000))
                if not len(length):
                    continue
                parts = -(-length // SEGMENT)
                which = np.repeat(np.arange(len(length)), parts)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = (np.cumsum(length) - length)[which] + nth * SEGMENT
                size = np.minimum(SEGMENT, length[which] - nth * SEGMENT)
                order = np.argsort(-size, kind="stable")
                for lo in range(0, len(order), 4000):
                    o = order[lo : lo + 4000]
                    t = np.arange(int(size[o[0]]))[:, None]
                    grid = np.where(t < size[o], cls[np.minimum(start[o] + t, len(cls) - 1)], CLASSES)
                    x = model.expected(grid, size[o], nth[o] == 0)
                    sums = x if sums is None else sums + x
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])
    return run


def _forward(model: Model):
    def run(batches):
        for b in batches:
            cls, length = _sequences(b.column("cls"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "cls"), pa.array(model.log10(cls, length))], [*(c for c in b.schema.names if c != "cls"), "path"])
    return run


def train(encoded: DataFrame, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training rows; what reaches the driver is one number for each of the fixed parameters."""
    model = Model()
    for _ in range(rounds):
        parts = encoded.where("NOT held_out").select("cls").mapInArrow(_expect(model), "sums array<double>")
        sums = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        if not sums.num_rows:
            break
        new = np.zeros(sums.num_rows)
        new[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
        model = Model(new)
    return model


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), text_of(docs).cast("binary").alias("text"))
    counted = rows.where("NOT held_out").select("text").mapInArrow(_count, "h long, cls int, n long")
    vocabulary = materialize(counted.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("c")))
    t = Counts(vocabulary)
    encoded = materialize(rows.mapInArrow(_encode(t), ENCODED).withColumn("rid", F.monotonically_increasing_id()))
    model = train(encoded)
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("m"))
    looked = rare.join(vocabulary.select("h", "c"), "h", "left").groupBy("rid").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("more"))
    paths = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "word", "cls").mapInArrow(
        _forward(model), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, word double, path double")
    logs = F.coalesce("logs", F.lit(0.0))
    return paths.join(looked, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(t.n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("path") + F.col("word") + logs).alias("score"))
