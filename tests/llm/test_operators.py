"""Training-data operators against brute force, on edge cases and on the small tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import hmm, licenses, linededup, mixing, neardup, neighbours, packing, pii, quality, suffixes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string"
rng = random.Random(99)
WORDS = ["w%d" % i for i in range(3000)]
LONG = " ".join(rng.choice(WORDS) for _ in range(9000))
PASSAGE = " ".join("p%d" % i for i in range(70))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(200, 1)
NEAR = BASE.replace(BASE.split()[100], "changed", 1)
ROWS = [(1, BASE, "s0"), (2, BASE, "s0"), (3, NEAR, "s1"), (4, None, None), (5, "", "s1"), (6, LONG, "s0"), (7, "one two", "s2"), (8, "One  two", "s2"),
    (9, f"{prose(60, 2)} {PASSAGE} {prose(60, 3)}", "s1"), (10, f"{prose(80, 4)} {PASSAGE} {prose(20, 5)}", "s0"), (None, prose(90, 6), "s3"), (11, "mail a.b@x.org ip 10.0.0.300 10.0.0.3 call +1 (202) 555-0123 card 4111 1111 1111 1111 and 4111 1111 1111 1112", "s1"),
    (12, "x" * 30000, "s1"), (13, prose(55, 7), "s1"), (13, prose(55, 7), "s1"), (14, "a@b é\U0001F600 q@w.de+12345678901 1.2.3.4.5.6.7.8", "s0"), (15, "\x1c <|endoftext|> it's 3,5", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_empty_tables(spark, none):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (pii.digest(pii.find(none)), neardup.groups(none), quality.apply_policy(quality.ledger(none)), packing.pack(none, packing.tokenizer_path()), suffixes.digest(suffixes.find(none)),
               mixing.mix(none), licenses.digest(licenses.scan(none)), neighbours.nearest(vectors, vectors), hmm.score(none), linededup.dedup(none)):
        assert df.count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, rx, ok in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
                         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(rx, t) if ok(m[0])]
    return out


def check_pii(df, rows):
    want = Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)).encode()).hexdigest(), *(sum(x[0] == k for x in base_spans(t)) for k in pii.KINDS)) for i, t in rows)
    got = df.collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want


def test_pii(spark, docs):
    check_pii(pii.digest(pii.find(docs)), [(i, t) for i, t, _ in ROWS])
    real = spark.read.parquet(f"{SF}/documents.parquet")
    check_pii(pii.digest(pii.find(real)), [(r.doc_id, r.text) for r in real.collect()])


def test_wider_personal_data_on_labelled_text(spark):
    """Half of the candidates beyond the base are personal data, the others order numbers and the like in the same form."""
    r, rows, want, all_wide = random.Random(6), [], set(), set()
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    for i in range(400):
        good = i % 2 == 0
        form = f"({digits(3)}) {digits(3)}-{digits(4)}" if r.random() < (0.7 if good else 0.3) else f"{digits(3)}-{digits(3)}-{digits(4)}"
        lead = (r.choice(["call me at ", "my phone is ", "tel: ", "reach us by phone "]) if r.random() < 0.85 else "it was ") if good else (r.choice(["order no. ", "invoice ", "serial ", "ticket # "]) if r.random() < 0.85 else "it was ")
        text = f"{prose(5, i)} {lead}{form} {r.choice(['mobile', 'office', 'or email']) if good and r.random() < 0.5 else 'then'} {prose(4, i + 1000)}"
        at = text.index(form)
        rows.append((i, text))
        all_wide.add((i, at, at + len(form)))
        if good:
            want.add((i, at, at + len(form)))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x.doc_id, y.s, y.e) for x in found for y in x.spans if y.kind == 3}
    assert got <= all_wide and not any(x.base for x in found)
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_reliabilities_by_force(spark):
    r = np.random.default_rng(8)
    true = r.random(4000) < 0.4
    hit, slip = np.array([0.9, 0.8, 0.7, 0.95, 0.6]), np.array([0.1, 0.3, 0.2, 0.4, 0.5])
    votes = (np.where(true[:, None], hit, slip) > r.random((4000, 5))) @ (1 << np.arange(5))
    got = pii.reliabilities(spark.createDataFrame([(0, int(v), True) for v in votes], "kind int, votes int, ok boolean")).first()
    v = votes[:, None] >> np.arange(5) & 1
    prior, a, b = 0.5, np.full(5, 0.8), np.full(5, 0.2)
    for _ in range(pii.ROUNDS):
        x, y = prior * np.prod(np.where(v, a, 1 - a), axis=1), (1 - prior) * np.prod(np.where(v, b, 1 - b), axis=1)
        w = x / (x + y)
        prior, a, b = (w.sum() + 1) / (len(w) + 2), (w @ v + 4) / (w.sum() + 5), ((1 - w) @ v + 1) / ((1 - w).sum() + 5)
    assert got.prior == pytest.approx(prior) and np.allclose(got.hit, a) and np.allclose(got.slip, b)
    assert np.abs(a - hit).max() < 0.08


def test_many_spans_in_one_text(spark):
    text = " ".join(f"user{i}@example.org" for i in range(3000))
    check_pii(pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))), [(1, text)])


def shingles(t):
    w = words(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def groups_by_force(rows, num):
    s, n = [shingles(t) for _, t in rows], len(rows)
    up = list(range(n))
    top = lambda i: i if up[i] == i else top(up[i])
    for a in range(n):
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= num * (len(s[a]) + len(s[b]) - both):
                up[top(a)] = top(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return Counter((d, len(s[i]), low.get(top(i), d)) for i, (d, _) in enumerate(rows))


def test_near_duplicates(docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(docs, 85, 100).collect())
    assert got == groups_by_force([(i, t) for i, t, _ in ROWS], 85)


def test_large_group_of_near_copies(spark):
    hub, r = [f"h{i}" for i in range(120)], random.Random(3)
    rows = [(i, " ".join(w if r.random() > 0.01 else f"z{i}_{k}" for k, w in enumerate(hub))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in neardup.groups(df, 85, 100).collect()) == groups_by_force(rows, 85)


def test_quality_measures_and_policies(docs):
    led = quality.ledger(docs)
    for r, t in ((r, next(t for i, t, _ in ROWS if i == r.doc_id)) for r in quality.apply_policy(led).collect()):
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    cut = {r.rule: r for r in quality.ablation(led).collect()}
    bits = [r.failed_bits for r in led.collect()]
    for name, bit in quality.BIT.items():
        mask = quality.POLICIES["v2"]
        assert (cut[name].n_failed, cut[name].n_only) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits))


def test_quality_stage_keeps_what_the_ledger_keeps(spark, docs):
    kept = quality.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect())


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in rows)
    for i, t, _ in ROWS:
        ids, own, at = tok.encode(t or "", add_special_tokens=False).ids + [1], sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id)), 0
        if i == 13:
            own = own[::2]
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    one = packing.digest(packing.pack(docs.where("doc_id = 7"), packing.tokenizer_path())).first()
    assert one.ids_crc32 == zlib.crc32(np.array((tok.encode("one two", add_special_tokens=False).ids + [1])[: one.length], "<u4").tobytes())


def test_repeated_passages(docs):
    got = {r.doc_id: r for r in suffixes.find(docs).collect()}
    assert set(got) == {1, 2, 3, 9, 10, 13}
    for i, before in ((9, 60), (10, 80)):
        (s,) = got[i].spans
        assert (s.start, s.stop) == (before, before + 70)
    assert not got[9].removable and got[10].removable and not got[1].removable and got[2].n_removable == 200


def passages_by_force(rows):
    """(spans, removable) of distinct texts, from all windows of 50 words."""
    rows, seen, out = sorted((i, hashlib.md5(t.encode()).digest(), t.encode().split()) for i, t in rows), {}, {}
    for i, _, w in rows:
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    for i, _, w in rows:
        masks = np.zeros((2, len(w) + 2), int)
        for k in range(len(w) - 49):
            at = seen[tuple(w[k : k + 50])]
            masks[0, k + 1 : k + 51] |= len(at) > 1
            masks[1, k + 1 : k + 51] |= at[0] != (i, k)
        if masks[0].any():
            out[i] = [np.flatnonzero(np.diff(m)).reshape(-1, 2).tolist() for m in masks]
    return out


def test_places_without_a_partner_are_not_dealt_out_by_class(spark, monkeypatch):
    seen, real = [], suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    lone = " ".join("u%d" % i for i in range(400))
    rows = [(1, lone), (2, "a b " + PASSAGE), (3, PASSAGE + " c d")]
    got = suffixes.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_repeated) for r in got.collect()) == [(2, 70), (3, 70)]
    classes = next(df for df in seen if "rep" in df.columns)
    assert not classes.where("rep.label = 1").count()


def test_repeated_passages_around_a_frequent_phrase(spark):
    r = random.Random(4)
    stream = [r.choice(WORDS) for _ in range(60000)]
    at = np.arange(len(stream) - 11)
    low = np.argsort(suffixes.Rolling(suffixes.word_hashes([w.encode() for w in stream])).of(at, at + 12))
    phrase = lambda k: " ".join(stream[low[k] : low[k] + 12])
    # low phrases before each passage and within it, so that its only kept places lie in what all passages share
    shared, rows = f"{phrase(0)} {prose(13, 900)}", []
    for i in range(80):
        rows.append((i, f"{prose(60, 1000 + i)} {phrase(1 + i)} {prose(25, 2000 + i * 7 % 40)} {shared} {prose(60, 3000 + i)}"))
    want = passages_by_force(rows)
    got = {x.doc_id: [[[y.start, y.stop] for y in c] for c in (x.spans, x.removable)] for x in suffixes.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) == 80 and got == want


def test_repeated_passages_by_force(spark):
    r = random.Random(12)
    pool = [prose(r.randrange(40, 90), 100 + i) for i in range(30)]
    rows = [(i, " ".join(r.choice(pool) if r.random() < 0.5 else prose(r.randrange(1, 60), 10_000 + 50 * i + k) for k in range(r.randrange(1, 9)))) for i in range(120)]
    rows += [(500 + i, " ".join(["a"] * (40 + i))) for i in range(40)] + [(600 + i, " ".join(r.choice("ab") for _ in range(150))) for i in range(30)]
    real = [(x.doc_id, x.text or "") for x in spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"]).collect()]
    for some in (rows, real):
        want = passages_by_force(some)
        got = {x.doc_id: [[[y.start, y.stop] for y in c] for c in (x.spans, x.removable)] for x in suffixes.find(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert want and got == want


def test_mixing(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, real):
        rows = mixing.mix(df).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(df.repartition(5)).collect()))
        size = Counter()
        for r in df.collect():
            size[r.source] += len(words(r.text))
        order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        full, left = set(), 1.5 * sum(size.values())
        while True:
            level = (left - sum(2 * size[s] for s in full)) / max(1e-9, sum(weight[s] for s in order if s not in full))
            more = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
            if not more:
                break
            full |= more
        taken = Counter()
        for r in rows:
            assert r.taken in (0, r.size, 2 * r.size) and r.source_size == size[r.source]
            assert r.target == pytest.approx(2 * size[r.source] if r.source in full else level * weight[r.source])
            taken[r.source] += r.taken
        for s in order:
            biggest = max((r.size for r in rows if r.source == s), default=0)
            target = next(r.target for r in rows if r.source == s)
            assert abs(taken[s] - target) <= 2 * biggest + 1e-6


def test_mixing_of_repeated_rows(spark, none):
    rows = [(None, "ten words " * 5, "x")] * 1000 + [(3, "one two three", "y")] * 7 + [(None, "other words here too " * 3, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(2)).collect()))
    for source in ("x", "y", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= own[0].size and max(r.copies for r in own) - min(r.copies for r in own) <= 1
    staged = mixing.stage(spark, df, "")
    assert Counter(r.source for r in staged.collect()) == Counter(r.source for r in got for _ in range(r.copies)) and staged.columns == df.columns
    assert mixing.stage(spark, none, "").count() == 0


def test_licenses(spark):
    mit = "MIT License text\nCopyright (c) 2020 Someone\n"
    text = licenses.KNOWN[0][1]
    rows = [(1, f"Copyright (c) 2021 A Person\n\n{text.upper()}"), (2, "x\nLicensed under the Apache Licence, version 2.0.\ny"), (3, None), (4, mit)]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: (None, ["Apache-2.0"]), 3: (None, []), 4: (None, [])}


def test_licenses_with_titles_and_wrapped_lines(spark):
    import textwrap

    rows, want = [], {}
    for name, text in licenses.KNOWN[:5]:
        rows.append((len(rows), f"The {name} License\n\nCopyright (c) The Authors\nAll rights reserved.\n\n" + textwrap.fill(text, 60)))
        want[len(want)] = (name, [name])
    for f in sorted((licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")):
        rows.append((len(rows), f"Some project\n\n{f.read_text()}"))
        want[len(want)] = (None, f.stem)
    for line, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under a Creative Commons\nAttribution-NoDerivs 3.0 Unported License.", "CC-BY-ND-3.0"), ("# Licensed under the Apache License,\n# Version 2.0.", "Apache-2.0"), ("CC BY-SA 2.5", "CC-BY-SA-2.5")):
        rows.append((len(rows), f"text\n{line}\nmore"))
        want[len(want)] = (None, name)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        license, notices = want[r.doc_id]
        assert r.license == license and (notices == r.notices if license else notices in r.notices), (rows[r.doc_id][1][:200], r)


def test_neighbours_recall_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9100, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 10).collect()
    hit = total = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((v, i) for i, v in enumerate(d) if i != q)[:10]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [o[0] for o in own] == list(range(1, 11)) and all(o[2] == pytest.approx(d[o[1]]) for o in own)
        hit, total = hit + len({i for _, i in want} & {o[1] for o in own}), total + 10
    assert hit / total >= 0.9
    assert len({g.query_id for g in got}) == 60


def test_neighbours_edge_cases(spark):
    """Clashing names, repeated ids, ties, fewer than ten candidates, unlike lengths."""
    rows = [(i, [float(x), float(y)], "c", 1.0) for i, (x, y) in enumerate([(0, 1), (1, 1), (1, -1), (-1, 1), (-1, -1), (3, 1)])] + [(0, [0.5, 0.5], "c", 1.0), (7, [1.0], "c", 1.0), (8, [2.0], "c", 1.0), (9, [1.0, 1.0], "c", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, radius double")
    got = [tuple(x) for x in neighbours.nearest(df, df.where("vec_id IN (0, 7)"), 10).collect()]
    for q, v in [(0, (0, 1)), (0, (0.5, 0.5)), (7, (1.0,))]:
        want = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), i) for i, w, *_ in rows if i != q and len(w) == len(v))
        assert {(q, k + 1, i, d) for k, (d, i) in enumerate(want)} <= set(got)
    assert len(got) == 6 + 6 + 1


def test_neighbours_of_plain_vectors_verify_few(spark):
    """20,000 vectors without structure: recall, and the share of rows whose distance is computed in a block."""
    x = np.random.default_rng(4).standard_normal((20000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.search(df, df.where("vec_id % 1000 = 0"), 10).collect()
    hit = 0
    for q in range(0, 20000, 1000):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        best = sorted((f.score, f.vec_id) for f in found if f.query_id == q)[:10]
        hit += len({i for _, i in best} & set(np.argsort(d)[1:11].tolist()))
    assert hit / 200 >= 0.9
    assert np.mean([f.verified for f in found]) < 0.1 * neighbours.BLOCK


def test_language_model(docs):
    rows = hmm.score(docs).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in ROWS}
    count = Counter()
    for i, t, _ in ROWS:
        if not held[i]:
            count.update([*words(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for r, t in ((r, next(t for i, t, _ in ROWS if i == r.doc_id)) for r in rows):
        toks = [*words(lower(t)), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(toks), sum(count[w] > 0 for w in toks), n)
        assert r.base_score == pytest.approx(sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks))
        assert r.score < 0


def test_forward_is_exact():
    m, cls = hmm.Model(), np.array([5, 9, hmm.CLASSES - 1])
    total = sum(m.start[0][a] * m.emit[5, a] * m.trans[a, b] * m.emit[9, b] * m.trans[b, c] * m.emit[-1, c] for a in range(hmm.STATES) for b in range(hmm.STATES) for c in range(hmm.STATES))
    assert m.log10(cls, np.array([3]))[0] == pytest.approx(log10(total))


def test_held_out_text_scores_above_its_base(spark):
    rows = hmm.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (rows.s - rows.b) / rows.n > 0.1


def test_score_by_force(spark, docs):
    """The path over classes and the words within them, summed state by state, with the model that training gives."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    vocabulary = rows.where("NOT held_out").select("text").mapInArrow(hmm._count, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("c")).persist()
    t = hmm.Counts(vocabulary)
    model = hmm.train(rows.mapInArrow(hmm._encode(t), hmm.ENCODED).persist())
    count = Counter()
    for i, text, _ in ROWS:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            count.update([w.encode() for w in words(lower(text))])
    order = sorted(count, key=lambda w: (-count[w], int(hmm.word_hashes([w]).view(np.int64)[0])))
    own = {w: k for k, w in enumerate(order[: hmm.WORDS])}
    cls = lambda w: own[w] if w in own else int(hmm.tied([w])[0])
    size, kinds = Counter(), Counter()
    for w in order[hmm.WORDS :]:
        size[cls(w)] += count[w]
        kinds[cls(w)] += 1
    for r in (r for r in hmm.score(docs).collect() if r.n_tokens < 100):
        text = next(x for i, x, _ in ROWS if i == r.doc_id)
        seq = [w.encode() for w in words(lower(text))]
        total, alpha = 0.0, None
        for c in [*map(cls, seq), hmm.CLASSES - 1]:
            alpha = (model.start[0] if alpha is None else alpha @ model.trans) * model.emit[c]
            total += log10(alpha.sum())
            alpha = alpha / alpha.sum()
        within = sum(log10((count[w] + 0.5) / (size[cls(w)] + 0.5 * (kinds[cls(w)] + 1))) for w in seq if w not in own)
        assert r.score == pytest.approx(total + within)


def test_training_raises_likelihood():
    r = np.random.default_rng(1)
    seq = np.concatenate([np.tile([3, 7], 40), np.tile([11, 12, 13], 30)])
    grid, m, before = seq[:, None], hmm.Model(), -np.inf
    for _ in range(5):
        now = m.log10(seq, np.array([len(seq)]))[0]
        assert now >= before - 0.5
        before = now
        m = hmm.Model(m.expected(grid, np.array([len(seq)]), np.array([True])))


def test_line_chunks(spark):
    block = "\n".join(f"shared line {i} of the block" for i in range(40))
    rows = [(1, f"a\n{block}\nb", 9), (2, f"other start\nx\n{block}\nend", 9), (3, "alone\nhere", 9), (4, None, 9), (5, "", 9), (6, "one line", 9), (7, "one line", 9)]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, lines long")).collect()}
    assert out[1].text == rows[0][1] and out[2]._n_removed >= 25 and out[2].text.startswith("other start\nx") and out[2].text.endswith("end")
    assert out[4].text is None and out[5].text == "" and out[6].text == out[7].text == "one line"
    left = out[2].text.split("\n")
    assert all(x in rows[1][1].split("\n") for x in left)


def lines_by_force(rows):
    """Texts without the pairs of neighbouring non-blank lines whose like occurs earlier."""
    rows, seen, out = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t or "") for i, t in rows}), {}, {}
    for place, (_, i, _, t) in enumerate(rows):
        lines, gone = t.split("\n"), set()
        at = [k for k, x in enumerate(lines) if x.encode().strip()]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            head = seen.setdefault("\n".join(lines[a : b + 1]), (place, k))
            if head[0] != place or head[1] + 1 < k:
                gone |= set(range(a, b + 1))
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_chunks_go_whole(spark):
    r, rows = random.Random(5), []
    for n in (2, 3, 5, 10):
        for copy in range(8):
            block = "\n".join(f"block of {n}, copy {copy}, line {k}" for k in range(n))
            rows += [(len(rows), f"{r.random()}\n{block}\n{r.random()}"), (len(rows) + 1, f"{r.random()}\n{r.random()}\n{block}\n{r.random()}")]
    out = {x.doc_id: x for x in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        lines = t.split("\n")
        assert out[i].text == (t if i % 2 == 0 else "\n".join([*lines[:2], lines[-1]])) and out[i]._n_removed == (i % 2) * (len(lines) - 3)


def test_line_chunks_by_force(spark):
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "d e", "", " "]) + str(r.randrange(9) // 6) * r.randrange(2) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(70, "x\nx"), (71, "y\ny\ny\ny\ny"), (72, "p\n\nq"), (73, "p\n\nq\n"), (None, "p\n\nq"), (74, None), rows[3]]
    real = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for some in (rows, real):
        want = lines_by_force(some)
        got = linededup.dedup(spark.createDataFrame(some, "doc_id long, text string").withColumn("was", F.coalesce("text", F.lit("")))).collect()
        assert len(got) == len(some)
        for x in got:
            assert (x.text or "") == want[x.doc_id or 0, x.was] and x._n_lines == x.was.count("\n") + 1
            assert x._n_removed == len(x.was.split("\n")) - (len(x.text.split("\n")) if x.text and x._n_removed < x._n_lines else 0 if x._n_removed == x._n_lines else 1)


def test_pipeline_by_force(spark, none):
    """Every stage on what its predecessor kept, against brute force, and the pieces of run() against the documents that the mix took."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(21)
    shared = "\n".join(prose(9, 7000 + k) for k in range(4))
    rows = [(i, "\n".join(prose(12, 500 + 10 * i + k) for k in range(8)), f"s{i % 3}") for i in range(24)]
    rows += [(30 + i, f"{prose(20, 900 + i)}\n{shared}\n{prose(40, 950 + i)}", "s1") for i in range(4)]
    near = [rows[3][1], rows[5][1]]
    rows += [(40 + i, t.replace(t.split()[50], "swapped", 1), "s2") for i, t in enumerate(near)] + [(45, near[0], None), (46, near[0], "s0"), (47, None, "s0"), (48, "few words", "s1"), (49, "a b c " * 60, "s1"), (None, prose(70, 77), "s0"), (None, prose(80, 78), "s1")]
    line = prose(120, 4242)
    rows += [(60, line, "s0"), (61, line.replace(line.split()[70], "swapped", 1), "s1"), (62, line, "s2")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    said = lambda df: Counter((x.doc_id, x.text, x.source) for x in df.collect())

    def good(t):
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        return len(w) >= 50 and 100 * len({i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}) <= 50 * len(w)

    stages = dict(pipeline.STAGES)
    one = stages["quality rules"](spark, docs, "").persist()
    want = [x for x in rows if good(x[1])]
    assert said(one) == Counter(want) and len(want) < len(rows)
    cut = lines_by_force([(i, t) for i, t, _ in want])
    want = [(i, cut[i or 0, t], s) for i, t, s in want]
    two = stages["line dedup"](spark, one, "").persist()
    assert said(two) == Counter(want) and any("\n" in t and len(words(t)) < 65 for _, t, _ in want)
    kept = {(d, n) for d, n, c in groups_by_force([(i, t) for i, t, _ in want], 80) if d == c}
    want = [x for x in want if (x[0], len(shingles(x[1]))) in kept]
    three = stages["near dedup"](spark, two, "").persist()
    assert said(three) == Counter(want) and {60, 61, 62} & {x[0] for x in want} == {60}
    took = Counter()
    for x in mixing.mix(three).collect():
        took[x.doc_id, x.source, x.size] += x.copies
    four = stages["mixing"](spark, three, "").persist()
    got = Counter()
    for (i, t, s), n in said(four).items():
        got[i, s, len(words(t))] += n
    assert got == +took and set(said(four)) <= set(want)
    tok, pieces = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for (_, t, _), n in said(four).items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        pieces[len(ids)] += n
    five = stages["packing"](spark, four, "").collect()
    assert Counter(x.doc_tokens for x in five if x.start == 0) == pieces and sum(x.length for x in five) == sum(k * n for k, n in pieces.items())
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0


def test_pipeline_on_clashing_columns(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    assert pipeline.STAGES[-1][1](spark, now, "").count() > 0
