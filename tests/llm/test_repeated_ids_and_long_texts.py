"""Ids that stand at several texts, shift-resistant chunks, and long texts under a time bound."""

import random
import re
import time
from collections import Counter

from casewright.llm import licenses, linededup, mixing, neardup
from test_operators import lines_by_force


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(3000) for _ in range(n))


def test_a_line_more_changes_the_chunks_beside_it():
    r = random.Random(4)
    lines = [b"%d" % r.randrange(10**9) for _ in range(400)]
    cut = lambda x: [b"\n".join(x[a:b]) for a, b in linededup.chunks(x)]
    before = cut(lines)
    assert all(len(c.split(b"\n")) >= 2 for c in before) and sum(len(c.split(b"\n")) for c in before) >= 399 and 50 < len(before) < 150
    for at in (0, 1, 57, 200, 399):
        after = cut([*lines[:at], b"a new line", *lines[at:]])
        assert len(set(before) - set(after)) <= 3 and len(set(after) - set(before)) <= 4
    assert linededup.chunks([]) == linededup.chunks([b"x", b" "]) == [] and linededup.chunks([b"", b"x", b"", b"y", b""]) == [(1, 4)]


def test_repeated_passages_beside_each_other(spark):
    """Chunks that touch, passages shorter than a chunk, and a window across two repeated chunks that occurs again elsewhere."""
    r = random.Random(11)
    blocks = [[f"block {b} line {k}" for k in range(r.randrange(2, 12))] for b in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randrange(1, 5)):
            block = r.choice(blocks)
            a = r.randrange(len(block))
            text += r.choice([block, block, block[a : a + r.randrange(1, 4)], [f"own {i} {r.random()}", ""]])
        rows.append((i, "\n".join(text)))
    rows += [(100, "\n".join(blocks[3] + blocks[4])), (101, "\n".join(blocks[4] + blocks[5])), (102, "\n".join([blocks[3][-1], blocks[4][0]])), (103, "\n".join(f"long {k % 700}" for k in range(5000)))]
    want = lines_by_force(rows)
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.text for r in got} == {i: want[i, t] for i, t in rows}


def test_near_dedup_of_ids_at_several_texts(spark):
    a, b, c, d = (prose(90, k) for k in range(4))
    swap = lambda t: t.replace(t.split()[40], "swapped", 1)
    rows = [(9, a), (9, c), (5, swap(c)), (None, b), (None, d), (3, swap(d)), (9, c), (9, a), (None, b), (7, ""), (7, None), (None, ""), (7, ""), (2, a + " "), (2, b)]
    schema = "doc_id long, text string, lang string, n int"
    for parts in (1, 4):
        docs = spark.createDataFrame([(*x, "en", 1) for x in rows], schema).repartition(parts)
        got = Counter((r.doc_id, r.text) for r in neardup.stage(spark, docs, "").collect())
        # one row of each group: a by (2, a), c by (5, c'), b by (2, b), d by (3, d'); texts without words all stay
        assert got == Counter([(2, a + " "), (5, swap(c)), (2, b), (3, swap(d)), (7, ""), (7, None), (None, ""), (7, "")])


def test_mixing_takes_the_same_texts_at_any_partitioning(spark):
    rows = [(1, " ".join(f"{k}-{i}" for k in range(20)), "s") for i in range(40)] + [(i, prose(30, i), "s") for i in range(2, 20)] + [(None, prose(25, 99 + i), None) for i in range(9)]
    taken = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        taken.add(frozenset(Counter((r.doc_id, r.text, r.source) for r in mixing.stage(spark, docs, "").collect()).items()))
    assert len(taken) == 1


def canonical(text):
    """The canonical form, written with Python's own patterns."""
    t = text.lower()
    for p in licenses.DROPPED:
        t = re.sub(p.replace(r"[^\p{L}\p{N}\n]", r"(?:[\W_](?<!\n))").replace(r"[^\p{L}\p{N}]", r"[\W_]"), "", t)
    for p, to in licenses.SPELLINGS:
        t = re.sub(p, to, t)
    return re.sub(r"[\W_]+", " ", t).strip()


def notices_by_force(text):
    known = {canonical(t): code for code, t in sorted(licenses.texts(), reverse=True)}
    lines = [x for x in map(canonical, text.split("\n")) if x]
    longest = max(len(k.split()) for k in known)
    found = set()
    for i in range(len(lines)):
        run = ""
        for line in lines[i : i + longest]:
            run = f"{run} {line}".strip()
            if run in known:
                found.add(known[run])
            if len(run.split()) > longest:
                break
    return sorted(found)


def test_license_notices_by_force(spark):
    r = random.Random(3)
    pieces = [t for _, t in licenses._named()] + ["Licensed under the", "Apache Licence,", "Version 2.0", "MIT License", "plain words here", "", "# licensed", "Permission is hereby granted", "licence"]
    rows = [(i, "\n".join(r.choice(pieces) for _ in range(r.randrange(1, 9))), "x", i) for i in range(80)] + [(200, None, "x", 1), (201, "", "x", 1)]
    rows += rows[:5]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, rid int").repartition(3)).collect()
    assert Counter((x.doc_id, tuple(x.notices)) for x in got) == Counter((i, tuple(notices_by_force(t or ""))) for i, t, *_ in rows)


def test_license_scan_of_a_very_long_text(spark):
    lines = ["licensed"] * 20_000
    lines[15_000:15_000] = ["Licensed under the Apache License,", "Version 2.0."]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    licenses.scan(docs.limit(0)).count()
    began = time.time()
    assert licenses.scan(docs).first().notices == ["Apache-2.0"]
    assert time.time() - began < 60
