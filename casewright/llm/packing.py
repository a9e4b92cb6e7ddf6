"""Packing by power-of-two decomposition.

Each document's ids (its tokens and an end id) are cut into pieces of the largest possible power-of-two lengths, at
most 2048. A piece is a whole sequence of the bucket of its length, so no sequence crosses documents and none is
padded. Nothing is shuffled: pieces are made where their document is read.

Defined cases: null text is empty and gives the end id alone; very long texts give many pieces of 2048; repeated rows
are packed each on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, word_hashes

LONGEST, END = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


#: Plain words: Latin letters (composed, so normalisation leaves them alone) and at most one full stop or comma.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: Texts that show whether a tokenizer treats white space and case as WordIds assumes.
_PROBE = "Some Plain words,  and\nmore\t(of) THEM. Été naïve, x1 #2 don't e-mail a.b@c.org"


class WordIds:
    """Ids of texts as the tokenizer gives them. Where the tokenizer never joins what white space separates, a text's ids are
    those of its words in turn, and words met before are looked up by a 64-bit hash; plain words share the ids of their
    lower-case letters where it ignores case. A tokenizer that fails the probe of these properties encodes whole texts.
    The table is sorted arrays of numbers, emptied when it holds LIMIT words, so memory is bounded by it and the texts in hand."""

    LIMIT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        whole = self.encode([_PROBE])[0]
        self.by_words = b"".join(self.encode(_PROBE.split())) == whole
        self.by_letters = self.by_words and self.encode([_PROBE.lower()])[0] == whole and self.encode(["word."])[0] == b"".join(self.encode(["word", "."]))
        self.marks = {"": b"", **dict(zip(".,", self.encode([".", ","])))}
        self.empty()

    def empty(self) -> None:
        """known: sorted hashes; at: each one's number; the ids of number n are flat[starts[n] : starts[n + 1]]."""
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, words: list[str], step: int = 1000) -> list[bytes]:
        return [array("I", e.ids).tobytes() for at in range(0, len(words), step) for e in self.tokenizer.encode_batch_fast(words[at : at + step], add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """encode() for words of letters only: several to a text, whose ids are parted after each one that ends a word."""
        texts = [" ".join(words[at : at + 200]) for at in range(0, len(words), 200)]
        ids = np.frombuffer(b"".join(self.encode(texts, 20)), np.uint32)
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != len(words) + 1 or cuts[-1] != 4 * len(ids):
            return self.encode(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        i = np.searchsorted(self.known, hashes)
        hit = i < len(self.known)
        hit[hit] = self.known[i[hit]] == hashes[hit]
        out = np.full(len(hashes), -1, np.int64)
        out[hit] = self.at[i[hit]]
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Hashes not known yet, each once."""
        number = len(self.starts) - 1 + np.arange(len(hashes))
        order = np.argsort(hashes)
        i = np.searchsorted(self.known, hashes[order])
        self.known, self.at = np.insert(self.known, i, hashes[order]), np.insert(self.at, i, number[order])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), np.uint32))

    def ids(self, number: int) -> bytes:
        return self.flat[self.starts[number] : self.starts[number + 1]].tobytes()

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Encode new words: the letters of plain ones first, which are words themselves."""
        text = [w.decode() for w in words]
        parts = [(m[1].lower(), m[2]) if self.by_letters and (m := _PLAIN.fullmatch(w)) else (w, "") for w in text]
        cores = list({c for c, _ in parts})
        core_hash = word_hashes([c.encode() for c in cores])
        new = np.flatnonzero(self.find(core_hash) < 0)
        letters = [i for i in new if self.by_letters and cores[i].isalpha()]
        other = [i for i in new if not (self.by_letters and cores[i].isalpha())]
        for some, how in ((letters, self.encode_letters), (other, self.encode)):
            if some:
                self.add(core_hash[some], how([cores[i] for i in some]))
        number = dict(zip(cores, self.find(core_hash).tolist()))
        left = np.flatnonzero(self.find(hashes) < 0)
        if len(left):
            self.add(hashes[left], [self.ids(number[parts[i][0]]) + self.marks[parts[i][1]] for i in left])

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.frombuffer(x, np.uint32) for t in texts for x in self.encode([t.decode()])]
        if len(self.known) > self.LIMIT:
            self.empty()
        words, stops = [], [0]
        for t in texts:
            words += t.split()
            stops.append(len(words))
        hashes, first, n = np.unique(word_hashes(words), return_index=True, return_inverse=True)
        number = self.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            self.learn([words[i] for i in first[new]], hashes[new])
            number[new] = self.find(hashes[new])
        number = number[n]
        start = self.starts[number]
        size = self.starts[number + 1] - start
        upto = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        return np.split(ids, upto[stops[1:-1]])


#: One table a Python worker, kept from task to task of one call of pack(), never from call to call.
_HELD: dict[tuple[str, str], WordIds] = {}


def word_ids(path: str, call: str) -> WordIds:
    if (path, call) not in _HELD:
        _HELD.clear()
        _HELD[path, call] = WordIds(path)
    return _HELD[path, call]


def lengths(n: int) -> list[int]:
    """n as pieces: 2048 as often as it fits, then the binary digits of the rest, longest first."""
    rest = n % LONGEST
    return [LONGEST] * (n // LONGEST) + [1 << i for i in range(LONGEST.bit_length() - 1, -1, -1) if rest >> i & 1]


def _pieces(path: str):
    call = uuid4().hex

    def run(batches):
        known = word_ids(path, call)
        for b in batches:
            for part in slices(b):
                out = []
                for doc, found in zip(part.column("doc_id").to_pylist(), known.of(part.column("text").to_pylist())):
                    ids = np.append(found, np.uint32(END)).astype("<u4", copy=False)
                    start = 0
                    for n in lengths(len(ids)):
                        out.append((doc, start, n, ids[start : start + n].tobytes(), len(ids)))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["doc_id", "start", "length", "ids", "doc_tokens"])
    return run


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of the
    length), sequence_id, offset. Write it with partitionBy("bucket") for batches of equal length."""
    pieces = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(_pieces(tokenizer), SCHEMA)
    return pieces.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, ids included."""
    return pack(docs, tokenizer_path())
