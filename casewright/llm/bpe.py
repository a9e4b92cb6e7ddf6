"""Byte-level BPE encoding with a contiguous rank array, and decoding.

A text is parted at special tokens and then into words by the vocabulary's pattern. A short word is held as two contiguous
arrays, its part ids and the rank of each two neighbours (a rank too large where the vocabulary has no such merge). The arrays
are scanned for the smallest rank, the boundary there is deleted, the two ranks beside it are looked up anew, and so on until
nothing merges. Words of one length take these steps together, as rows of two matrices. Words beyond LONG bytes, where
scanning would be quadratic, go through a heap of the same ranks with the same order of merges. A table of some KNOWN words met
before is kept by each Python worker, so a word is merged once and not at every place.

The pattern's letters, numbers and white space are those of the tokenizer: where the installed `regex` knows characters that
another Unicode version lacks, the tokenizer itself is asked once about them, and texts with such characters take a pattern that leaves them out.

Nothing is shuffled, a task holds a few MB of texts at a time, and nothing depends on how rows are partitioned.

Defined cases: null text is empty and has no ids; a special token's string in a text is that token, as in the tokenizer;
ids that the vocabulary lacks are skipped in decoding, null ids decode to an empty text, and bytes that aren't UTF-8 become U+FFFD; repeated
rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

LONG, KNOWN, NONE = 128, 250_000, 1 << 30
#: Fixed values of byte-level vocabularies: the contractions and classes of words, with letters, numbers and white space left open.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{l}+| ?{n}+| ?[^{s}{o}]+|[{s}]+(?![^{s}])|[{s}]+"
_ASCII = re.compile(_PATTERN.format(l="[A-Za-z]", n="[0-9]", s=r"\x09-\x0D\x20", o="A-Za-z0-9"))
_FIXED = dict(s=r"\p{White_Space}", o=r"\p{L}\p{N}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1 without a space, else
    the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, letters = held["model"], byte_letters()
        split = held["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or held["normalizer"] or any(x[k] for x in held["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        joined = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs])
        self.pair_ranks = np.argsort(joined)
        self.pairs, self.merged = joined[self.pair_ranks], np.array([vocab[a + b] for a, b in pairs])
        special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.special = {k: array("I", [v]).tobytes() for k, v in special.items()}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes = np.full(size + 1, b"", object)  # the last one for ids that don't exist
        for token, i in [*vocab.items(), *special.items()]:
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.words: dict[str, bytes] = {}
        self.patterns = self._patterns(path)

    def _patterns(self, path: str):
        """(pattern for most texts, a quick test for and the characters that need the other one, or None, the other one)."""
        from tokenizers import Tokenizer

        splits = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
        apart = {}
        for kind, lead in (("L", "a"), ("N", "1")):
            young = [c for c in "".join(regex.findall(rf"\p{{{kind}}}+", every)) if unicodedata.category(c)[0] != kind]
            # a character of the same kind as the one before it is never parted from it
            held = {i for _, (i, j) in splits(" ".join(lead + c for c in young)) if j - i >= 2 + (i > 0)}
            apart[kind] = "".join(c for n, c in enumerate(young) if (3 * n - 1 if n else 0) not in held)
        usual = regex.compile(_PATTERN.format(l=r"\p{L}", n=r"\p{N}", **_FIXED))
        strange = "".join(sorted(set(apart["L"] + apart["N"])))
        if not strange:
            return usual, None, None, usual
        codes = [ord(c) for c in strange]
        first = [c for c, b in zip(codes, [-2, *codes]) if c > b + 1]
        last = [c for c, b in zip(codes, [*codes[1:], 1 << 30]) if c < b - 1]
        one = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))
        known = lambda k: rf"(?:(?![{one}])\p{{{k}}})"
        other = _PATTERN.format(l=known("L"), n=known("N"), s=_FIXED["s"], o="@@").replace(f"[^{_FIXED['s']}@@]", rf"(?:[{one}]|[^{_FIXED['s']}{_FIXED['o']}])")
        return usual, re.compile(f"[{strange[0]}-\U0010ffff]"), re.compile(f"[{one}]"), regex.compile(other)

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours (first id << 32 | second id), or NONE."""
        i = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[i] == pairs, self.pair_ranks[i], NONE)

    def short_words(self, words: list[bytes]) -> list[bytes]:
        """Ids, as bytes of unsigned 32-bit numbers, of words of one length: a row of parts and a row of ranks for each word.
        Every row loses one boundary a round, so rows stay equally long; those without a merge left are done."""
        out: list[bytes] = [b""] * len(words)
        parts = self.byte[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        row, ranks = np.arange(len(words)), self.ranks_of(parts[:, :-1] << 32 | parts[:, 1:])
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            low = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            done = low == NONE
            if done.any():
                flat, step = parts[done].astype("<u4").tobytes(), 4 * parts.shape[1]
                for n, i in enumerate(row[done].tolist()):
                    out[i] = flat[n * step : (n + 1) * step]
                parts, ranks, row, at, low = (x[~done] for x in (parts, ranks, row, at, low))
            if not len(row):
                return out
            i, n = np.arange(len(row)), ranks.shape[1]
            parts[i, at] = self.merged[low]
            parts = parts[np.arange(n + 1) != at[:, None] + 1].reshape(len(row), n)
            ranks = ranks[np.arange(n) != at[:, None]].reshape(len(row), n - 1)
            for some, pair in ((at > 0, at - 1), (at < n - 1, at)):  # the pairs that the new part now is in
                ranks[i[some], pair[some]] = self.ranks_of(parts[i[some], pair[some]] << 32 | parts[i[some], pair[some] + 1])

    def learn(self, words: set[str]) -> None:
        """Put new words and their ids into the table."""
        by_length: dict[int, list[bytes]] = {}
        for w in (w.encode() for w in words):
            by_length.setdefault(len(w), []).append(w)
        for n, some in by_length.items():
            ids = self.short_words(some) if n <= LONG else [array("I", self.long_word(w)).tobytes() for w in some]
            self.words.update(zip((w.decode() for w in some), ids))

    def long_word(self, word: bytes) -> list[int]:
        """Ids of one word by a heap of (rank, place); entries whose pair has changed since are passed over."""
        parts, get, n = self.byte[list(word)].tolist(), dict(zip(self.pairs.tolist(), self.pair_ranks.tolist())).get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j], NONE) != low:
                continue
            parts[i], parts[j], after[i] = int(self.merged[low]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(parts[a] << 32 | parts[b], NONE)) < NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def split(self, text: str) -> list[str]:
        """Words and special tokens."""
        out, (most, young, strange, other) = [], self.patterns
        for part in self.parting.split(text) if self.parting else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                find = _ASCII if part.isascii() else other if young and young.search(part) and strange.search(part) else most
                out += find.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > KNOWN:
            self.words = {}
        parts = [self.split(t) for t in texts]
        self.words.update(self.special)
        self.learn(set().union(*parts) - self.words.keys())
        return [np.frombuffer(b"".join(map(self.words.__getitem__, p)), "<u4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        last = len(self.bytes) - 1
        return b"".join(self.bytes[np.where((ids >= 0) & (ids < last), ids, last)]).decode("utf-8", "replace")


#: One codec a Python worker.
_HELD: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Codec(path)
    return _HELD[path]


def _encoded(path: str):
    def run(batches):
        known = codec(path)
        for b in batches:
            for part in slices(b):
                ids = known.encode([t.decode() for t in part.column("text").to_pylist()])
                upto = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(upto), pa.array(flat.view(np.int32)))], ["doc_id", "ids"])
    return run


def _decoded(path: str):
    def run(batches):
        known = codec(path)
        for b in batches:
            none = np.zeros(0, np.int32)
            texts = [known.decode(np.array(x.values.drop_null(), np.int64) if x.is_valid else none) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its whole text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Rows of doc_id and ids with the text that the ids stand for as decoded."""
    return coded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(path), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)) in one pass of one Python worker a task."""
    first, then = _encoded(path), _decoded(path)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(lambda batches: then(first(batches)), "doc_id long, ids array<int>, decoded string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
