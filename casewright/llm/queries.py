"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, conversations, filters, hmm, licenses, linededup, mixing, neardup, neighbours, packing, pii, quality, suffixes
from .common import table


def op1_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_near_duplicates(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "documents"), 85, 100)


def op3_quality_ledger(spark, sf_dir):
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def op4_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path()))


def op5_repeated_passages(spark, sf_dir):
    return suffixes.digest(suffixes.find(table(spark, sf_dir, "documents")))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op8_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op9_language_model(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_line_chunks(spark, sf_dir):
    return linededup.digest(linededup.dedup(table(spark, sf_dir, "documents")))


def op11_bpe(spark, sf_dir):
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path()))


def op12_filter_audit(spark, sf_dir):
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark, sf_dir):
    return conversations.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_near_duplicates, op3_quality_ledger, op4_packing, op5_repeated_passages, op6_mixing, op7_licenses, op8_neighbours, op9_language_model, op10_line_chunks,
                                  op11_bpe, op12_filter_audit, op13_conversation_trie)}

_W = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op2_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_W.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS g FROM d),
e AS (SELECT r, unnest(g) AS x FROM s),
n AS (SELECT r, doc_id, len(g) AS n FROM s),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT ra, rb FROM p JOIN n na ON na.r = ra JOIN n nb ON nb.r = rb WHERE 100 * n_both >= 85 * (na.n + nb.n - n_both)),
u AS (SELECT ra AS a, rb AS b FROM l UNION ALL SELECT rb, ra FROM l),
c(r, m) AS (SELECT r, r FROM n UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.r),
f AS (SELECT c.r, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.m GROUP BY c.r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, f.component_id, n.doc_id = f.component_id AS kept FROM n JOIN f USING (r)""",
    "op3_quality_ledger": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_W.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS k FROM w WHERE len(w) > 2)),
h AS (SELECT r, count(DISTINCT i + j) AS n FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines FROM w LEFT JOIN h USING (r)),
b AS (SELECT *, CAST({" + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, (_, test) in enumerate(quality.RULES))} AS BIGINT) AS failed_bits FROM m)
SELECT *, failed_bits & {quality.BASE} <> 0 AS base_failed, failed_bits & {quality.POLICIES[quality.CURRENT]} = 0 AS kept FROM b""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_W.format("coalesce(text, '')")} AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
p AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS b FROM f f1, f f2, f f3, f f4, f f5 WHERE (f1.b | f2.b | f3.b | f4.b | f5.b) = 31),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, b[i] AS bit, CAST(list_sum(b[:i - 1]) AS BIGINT) AS before FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
e AS (SELECT part, filter_order, step, n, good, toxic, mask = bit AS sole, mask & bit <> 0 AS fails, mask & coalesce(before, 0) = 0 AS clear, 120 // greatest(bit_count(mask), 1) AS share FROM n, s)
SELECT part, filter_order, step, CAST(sum(CASE WHEN clear AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN clear AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND NOT clear THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN sole THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN clear AND fails THEN n * good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN clear AND fails THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fails THEN n * share ELSE 0 END) AS BIGINT) AS shapley FROM e GROUP BY ALL""",
    "op13_conversation_trie": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS l,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT)) % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.l, [])[:c.h], c.l[c.h + 1:]) AS p FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, unnest(range(0, len(p) + 1)) AS d, p FROM r),
n AS (SELECT p[:d] AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = d), '')) AS ends_sha256 FROM m GROUP BY p[:d], d),
kids AS (SELECT k[:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.k, unnest(range(0, n.depth + 1)) AS upto, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.k[n.depth].x) END AS saved FROM n LEFT JOIN kids ON kids.k = n.k AND kids.depth = n.depth),
s AS (SELECT k[:upto] AS k, upto AS depth, sum(leaf) AS leaves, sum(saved) AS saved FROM a GROUP BY k[:upto], upto)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k AND s.depth = n.depth LEFT JOIN kids ON kids.k = n.k AND kids.depth = n.depth LEFT JOIN n p ON p.k = n.k[:n.depth - 1] AND p.depth = n.depth - 1""",
}
