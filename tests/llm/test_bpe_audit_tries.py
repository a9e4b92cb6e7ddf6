"""BPE, the filter audit and the conversation trie against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import bpe, conversations, filters
from casewright.llm.common import materialize

SF = "/root/testdata/sf0.001"
rng = random.Random(5)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_is_the_tokenizers(tokenizer):
    codec = bpe.codec(bpe.vocabulary_path())
    texts = ["", "it's <|endoftext|>x <|endoftext|><|endoftext|> <|endof", "x" * 30000, "ab" * 5000 + " " * 3000 + "\n" * 777 + "\t x", "é" * 500, "\x1c \x85 a\xa0b ", "don't I'LL we'll 'tis '", "a" * 127 + " " + "a" * 128 + " " + "a" * 129,
             "".join(rng.choice("ab1 !\n'sé²१\U00011de0՘₏") for _ in range(3000))]
    # every code point, beside a letter, a number, a mark and a space
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice(["a", "1", "!", " ", "  ", ""]) + c for c in every[at : at + 20_000]) for at in range(0, len(every), 20_000)]
    got = codec.encode(texts)
    for text, ids in zip(texts, got):
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()
        assert codec.decode(ids.astype(np.int64)) == text
    for _ in range(500):  # broken UTF-8 too
        ids = [rng.randrange(50257) for _ in range(rng.randrange(20))]
        assert codec.decode(np.array(ids, np.int64)) == tokenizer.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([60000, -1, 64])) == tokenizer.decode([64], skip_special_tokens=False)


def test_bpe_short_and_long_words_agree():
    codec = bpe.Codec(bpe.vocabulary_path())
    for n in (1, 2, 3, 17, 60, 128):
        words = [bytes(rng.choice(b"aabbcehnorst") for _ in range(n)) for _ in range(50)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.short_words(words)] == [codec.long_word(w) for w in words]


def test_bpe_query(spark, tokenizer):
    schema = "doc_id long, text string, ids string, decoded int"
    rows = [(1, "one two", "x", 1), (1, "one two", "x", 1), (2, None, None, None), (None, "<|endoftext|>" * 3, "x", 2), (3, "long " * 40_000, "x", 3), (4, "", "", 4)]
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for docs, want in ((spark.createDataFrame(rows, schema).repartition(3), [r[:2] for r in rows]), (spark.read.parquet(f"{SF}/documents.parquet"), real)):
        got = bpe.digest(bpe.round_trip(docs, bpe.vocabulary_path())).collect()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in want]
        assert Counter(map(tuple, got)) == Counter((d, len(i), sha(",".join(map(str, i))), sha(t or "")) for (d, t), i in zip(want, ids))
    coded = bpe.decode(bpe.encode(docs, bpe.vocabulary_path()), bpe.vocabulary_path())
    assert Counter((r.doc_id, r.decoded) for r in coded.collect()) == Counter((d, t or "") for d, t in real)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), bpe.vocabulary_path()).first().decoded == ""
    assert bpe.round_trip(spark.createDataFrame([], schema), bpe.vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        bpe.Codec(bpe.vocabulary_path("word_bpe_49k.json"))


DOCS, LABELS = "doc_id long, text string, lang string, part string, mask int, quality string", "doc_id long, quality int, toxic int"
LEAD = "the same long beginning of very many texts " * 30


def audit_by_force(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, lang, *_ in docs:
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d}
        fails.append((lang or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for i, f in enumerate(order):
                gone = [m for m in mine if f in m[0] and not m[0] & set(order[:i])]
                shapley[part, f] += len(gone)
                out[part, order, i + 1] = [sum(not m[0] & set(order[: i + 1]) for m in mine), len(gone), sum(f in m[0] and bool(m[0] & set(order[:i])) for m in mine), sum(m[0] == {f} for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def prose(n, of=5000):
    return " ".join("w%d" % rng.randrange(of) for _ in range(n))


def audit_table():
    rows = [(i, prose(150), rng.choice(["en", "de", None]), "x", 1, "y") for i in range(40)]
    rows += [(100 + i, rows[i % 7][1], rng.choice(["en", "", "fr"]), "x", 1, "y") for i in range(60)]  # copies
    rows += [(200 + i, LEAD + "%s end" % (i % 9), "en", "x", 1, "y") for i in range(40)]
    rows += [(300 + i, LEAD[: i * 11], "de", "x", 1, "y") for i in range(30)] + [(300 + i, LEAD[: i * 11], "de", "x", 1, "y") for i in range(5)]
    rows += [(None, None, None, "x", 1, "y"), (None, rows[0][1], "en", "x", 1, "y"), (400, None, "en", "x", 1, "y"), (401, "", "en", "x", 1, "y"), (402, "ABC é # x", "fr", "x", 1, "y"), (403, "ÄÖÜ " * 120, "fr", "x", 1, "y"), (404, "A" * 300_000, "fr", "x", 1, "y"), (405, "A" * 300_000 + "b", "fr", "x", 1, "y"), (404, "A" * 300_000, "fr", "x", 1, "y")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 405, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    return rows, labels


def test_filter_audit_by_force(spark, monkeypatch):
    rows, labels = audit_table()
    want = audit_by_force(rows, labels)
    for parts, chunk, heavy in ((1, 1 << 24, 1 << 28), (5, 3000, 200), (3, 40_000, 3000)):
        monkeypatch.setattr(filters, "HEAVY", heavy)
        monkeypatch.setattr(filters.duplicates, "__defaults__", (heavy,))
        monkeypatch.setattr(filters.masks, "__defaults__", (heavy,))
        assert audit_rows(filters.audit(spark.createDataFrame(rows, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS))) == want
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = audit_by_force([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert audit_rows(filters.audit(docs, labels)) == want
    assert filters.audit(spark.createDataFrame([], DOCS), labels).count() == 0


def test_adaptive_prefixes_spread_a_common_beginning(spark):
    texts = [LEAD + str(i) for i in range(400)] + [prose(5) for _ in range(50)]
    rows = [(i, 0, t.encode(), len(t), 0, i, filters.steps(t.encode())) for i, t in enumerate(texts)]
    entries = materialize(spark.createDataFrame(rows, "chunk long, number int, text binary, size long, bits int, low long, steps array<long>"))
    assert filters.placed(entries, 1 << 30).groupBy("place").count().agg(F.max("count")).first()[0] == 400
    spread = filters.placed(entries, 20_000).groupBy("place").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert tuple(spread) == (1, 450)  # their common beginning is longer than any lighter prefix


def test_trie_holds_full_texts():
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    trie = filters.Trie()
    for i, t in enumerate(texts):
        trie.insert(t, i).held.append(i)
    held = {t: (node.low, node.held) for t, node in trie.terminals()}
    assert held == {t: (texts.index(t), [i for i, x in enumerate(texts) if x == t]) for t in texts}


TURNS = "conv_id long, turn int, role string, text string, depth string, key int"


def trie_by_force(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[2] for t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha([c for c in m if len(built[c]) == len(k)])) for k, m in members.items())


def trie_rows(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_conversation_trie_by_force(spark, monkeypatch):
    rows = []
    for c in range(700):
        lead = [("system", "the usual start"), ("user", "hello é"), ("assistant", "hi")][: rng.choice([0, 1, 3, 3])]
        turns = lead + [(rng.choice(["user", None]), rng.choice(["a", "b", None, "x" * 50])) for _ in range(rng.randrange(6))]
        if c % 3 == 0:
            turns = [("user", "copied"), ("assistant", "copied too"), ("user", "again")] * 3  # a third are copies
        rows += [(c, i, r, t, "clash", 1) for i, (r, t) in enumerate(turns) if c % 35 or c == 0]
    rows += [(700, i, "user", "t%d" % (i // 2), "x", 1) for i in range(300)]  # a long one
    rows += [(701, None, "user", "null turn", "x", 1), (701, 1, "user", "tie", "x", 1), (701, 1, "assistant", "tie", "x", 1), (701, 1, "assistant", "tie", "x", 1), (None, 1, "user", "no conversation", "x", 1), (802, 3, None, None, "x", 1), (10**12, 0, "user", "copied", "x", 1)]
    rng.shuffle(rows)
    want, convs = trie_by_force(rows), spark.createDataFrame(rows, TURNS)
    for parts, heavy, piece in ((1, None, 1 << 16), (4, 10, 100), (3, 10**9, 24)):
        monkeypatch.setattr(conversations, "PIECE", piece)
        assert trie_rows(conversations.nodes(convs.repartition(parts), heavy)) == want
    real = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_rows(conversations.nodes(real)) == trie_by_force([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in real.collect()])
    assert conversations.nodes(spark.createDataFrame([], TURNS)).count() == 0


def test_radix_tree_grows_its_nodes():
    tree = conversations.Tree()
    keys = [bytes([a]) + bytes(14) + bytes([b]) for a in range(256) for b in ((0, 1) if a % 2 else (5,))] + [bytes(16) * 3]
    layouts = set()
    for i, k in enumerate(keys):
        tree.insert(k, i)
        layouts.add((type(tree.root.children).__name__, getattr(tree.root.children, "room", 0)))
    assert layouts == {("Few", 4), ("Few", 16), ("Index", 0), ("Full", 0)}
    nodes = tree.aligned()
    assert sorted(r for *_, r in nodes if r >= 0) == list(range(len(keys)))
    assert Counter(d for d, *_ in nodes) == {0: 1, 1: len(set(k[:16] for k in keys)), 2: 1, 3: 1}
