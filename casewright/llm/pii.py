"""Personal data by weak supervision, in DataFrame functions only.

Labelers vote on candidate spans: a gazetteer of endings and prefixes, cue words before and after, no counter-cue before
(order numbers, versions and the like), and a strong shape. Expectation-maximisation over the counts of vote patterns (at most
32 for each of 4 kinds) estimates each labeler's reliability; the posteriors are soft labels on which a naive Bayes span
classifier is trained. It sees other things than the votes: shape, size, the characters around the span and the kind of word
that leads to it. It decides on the candidates beyond the base patterns. Whether a candidate is a base match is no vote, and the
base spans themselves always stay. Where a corpus holds no candidates beyond the base, as the given tables, none is added.

Defined cases: a null text is empty; an empty text has no span; every input row gives one output row, repeated rows
included; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

KINDS = ("email", "ip", "card", "phone")
#: Base patterns in a form that never backtracks over a run twice; they match exactly the spans of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates: spelled-out addresses, full IPv6, cards with other separators, local phone numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/])",
    "phone": r"(?<![0-9+()./-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: Cue words before a span, and gazetteer tests of its text.
CUES = {"email": r"mail|contact|write to|reach", "ip": r"\bip\b|host|server|address", "card": r"card|visa|credit|pay", "phone": r"phone|\btel|call|fax|mobile"}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|us|ch|at|nl|be)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
}
#: Words after a span that confirm it, words before it that speak against it, and strong shapes.
AFTER = r"^[^\p{L}\p{N}]{0,3}(?:mobile|cell|fax|office|home|work|direct|visa|amex|mastercard|is my|or email|or call)"
COUNTER = r"(?:order|invoice|version|ver\.|release|build|ref|serial|isbn|doi|figure|table|section|page|case|ticket|part|model|sku|no\.|#)[^\p{L}\p{N}]{0,3}(?:[\p{L}]{1,8}[^\p{L}\p{N}]{1,2})?$"
SHAPE = {
    "email": r"(?i)[(\[]dot[)\]]|\.[a-z]{2,6}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$|:",
    "card": r"^[0-9]{4}(?:[\x20._/-][0-9]{4}){3}$|^[0-9]{15,16}$",
    "phone": r"^\+|^\(|^[2-9][0-9]{2}([.-])[0-9]{3}\1",
}
LABELERS, ROUNDS, SHAPES = 5, 30, 64
#: Matches laid end to end by so many at a time: growing one array match by match would copy it each time.
STRIDE = 64
_SPAN = "array<struct<s:int,e:int,m:string>>"


def _spans(rx: str) -> str:
    """SQL: spans (s, e, m) of rx in column t, by code point; matches and the gaps between them are laid end to end."""
    step = f"""(z, x) -> CASE WHEN x.m IS NULL THEN z ELSE named_struct('p', z.p + x.g + char_length(x.m),
        'a', array_append(z.a, named_struct('s', z.p + x.g, 'e', z.p + x.g + char_length(x.m), 'm', x.m))) END"""
    some = f"aggregate(slice(w, {STRIDE} * k + 1, {STRIDE}), named_struct('p', z.p, 'a', cast(array() AS {_SPAN})), {step})"
    laid = f"""aggregate(sequence(0, size(w) DIV {STRIDE}), named_struct('p', 0, 'a', cast(array() AS array<{_SPAN}>)),
      (z, k) -> element_at(transform(array({some}), y -> named_struct('p', y.p, 'a', array_append(z.a, y.a))), 1), z -> flatten(z.a))"""
    return f"""CASE WHEN t RLIKE r'{rx}' THEN element_at(transform(array(
      zip_with(split(t, r'{rx}', -1), regexp_extract_all(t, r'{rx}', 0), (g, m) -> named_struct('g', char_length(g), 'm', m))), w -> {laid}), 1)
      ELSE cast(array() AS {_SPAN}) END"""


def _valid(kind: str, m: str = "x.m") -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    luhn = f"""aggregate(transform(sequence(1, greatest(length({digits}), 1)), i -> CASE WHEN i % 2 = 1 THEN int(substr({digits}, -i, 1))
      WHEN int(substr({digits}, -i, 1)) > 4 THEN 2 * int(substr({digits}, -i, 1)) - 9 ELSE 2 * int(substr({digits}, -i, 1)) END), 0, (a, b) -> a + b) % 10 = 0"""
    return {
        "email": "true",
        "ip": f"({m} LIKE '%:%' OR forall(split({m}, r'[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 3) AS int), 0) <= 255))",
        "card": f"(length({digits}) BETWEEN 13 AND 19 AND {luhn})",
        "phone": f"(length({digits}) BETWEEN 9 AND 15)",
    }[kind]


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, base and cand spans of every row, written once: the texts are read a single time."""
    df = docs.select(F.col("doc_id"), text_of(docs).alias("t"))
    raw, out = {}, []
    for k in KINDS:
        raw[f"b_{k}"], raw[f"w_{k}"] = F.expr(_spans(BASE[k])), F.expr(_spans(WIDE[k]))
    df = df.select("doc_id", "t", *(c.alias(n) for n, c in raw.items()))
    shape = "regexp_replace(regexp_replace(x.m, '[A-Za-z]+', 'x'), '[0-9]+', '9')"
    tell = lambda k, i, base: f"""x -> element_at(transform(array(named_struct('b', lower(substring(t, greatest(x.s - 23, 1), least(x.s, 24))), 'a', lower(substring(t, x.e + 1, 16)))), c ->
        named_struct('kind', {i}, 's', x.s, 'e', x.e, 'ok', {_valid(k)}, 'base', {base}, 'votes',
        int(x.m RLIKE r'{GAZETTEER[k]}') + 2 * int(c.b RLIKE r'{CUES[k]}') + 4 * int(c.a RLIKE r'{AFTER}') + 8 * int(NOT c.b RLIKE r'{COUNTER}') + 16 * int(x.m RLIKE r'{SHAPE[k]}'),
        'seen', array(concat('s', least(x.e - x.s, 40) DIV 4), concat('h', pmod(hash({shape}), {SHAPES})),
          concat('b', CASE WHEN c.b = '' THEN 0 WHEN c.b RLIKE r'[\\x20\\x09-\\x0D]$' THEN 1 WHEN c.b RLIKE r'[\\p{{L}}\\p{{N}}]$' THEN 2 ELSE 3 END),
          concat('a', CASE WHEN c.a = '' THEN 0 WHEN c.a RLIKE r'^[\\x20\\x09-\\x0D]' THEN 1 WHEN c.a RLIKE r'^[\\p{{L}}\\p{{N}}]' THEN 2 ELSE 3 END),
          concat('l', CASE WHEN c.b RLIKE r'{COUNTER}' THEN 2 WHEN c.b RLIKE r'{CUES[k]}' THEN 1 ELSE 0 END)))), 1)"""  # noqa: E731
    for i, k in enumerate(KINDS):
        out.append(f"transform(b_{k}, {tell(k, i, 'true')})")
        out.append(f"transform(w_{k}, {tell(k, i, 'false')})")
    df = df.withColumn("cand", F.expr(f"concat({', '.join(out)})")).select("doc_id", "cand")
    df = df.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "cand")
    return materialize(df)


def reliabilities(cand: DataFrame) -> DataFrame:
    """kind, prior, hit, slip and the posterior of each vote pattern, by EM inside one expression over <= 32 patterns of valid candidates."""
    pats = cand.where("ok").groupBy("kind", "votes").count().groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("count").cast("double").alias("n")))).alias("pats"))
    like = lambda p, v: "*".join(f"(CASE WHEN {v} & {1 << j} <> 0 THEN {p}[{j}] ELSE 1 - {p}[{j}] END)" for j in range(LABELERS))
    post = lambda z, v: f"({z}.prior * {like(z + '.hit', v)}) / ({z}.prior * {like(z + '.hit', v)} + (1 - {z}.prior) * {like(z + '.slip', v)})"
    total = lambda w: f"aggregate(q, double(0), (a, x) -> a + x.n * {w})"
    rate = lambda w, on, off: "array(" + ", ".join(f"({total(f'{w} * int(x.v & {1 << j} <> 0)')} + {on}) / ({total(w)} + {on + off})" for j in range(LABELERS)) + ")"
    step = f"""(z, i) -> element_at(transform(array(transform(pats, y -> named_struct('v', y.votes, 'n', y.n, 'p', {post('z', 'y.votes')}))),
      q -> named_struct('prior', ({total('x.p')} + 1) / ({total('double(1)')} + 2), 'hit', {rate('x.p', 4, 1)}, 'slip', {rate('(1 - x.p)', 1, 4)})), 1)"""
    start = f"named_struct('prior', double(0.5), 'hit', array_repeat(double(0.8), {LABELERS}), 'slip', array_repeat(double(0.2), {LABELERS}))"
    em = pats.withColumn("z", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, {step})"))
    return em.select("kind", "z.*", F.expr(f"map_from_entries(transform(pats, y -> named_struct('k', y.votes, 'p', {post('z', 'y.votes')})))").alias("soft"))


def classifier(cand: DataFrame, model: DataFrame) -> DataFrame:
    """kind, bias and log-odds by feature value (at most 100 values a kind): naive Bayes on the soft labels."""
    soft = cand.where("ok").join(F.broadcast(model.select("kind", "soft")), "kind").withColumn("p", F.expr("soft[votes]"))
    by = soft.select("kind", "p", F.explode("seen").alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    both = soft.groupBy("kind").agg(F.sum("p").alias("y"), F.sum(1 - F.col("p")).alias("n"))
    odds = by.join(F.broadcast(both), "kind").withColumn("w", F.log((F.col("yes") + 0.5) / (F.col("y") + 5)) - F.log((F.col("no") + 0.5) / (F.col("n") + 5)))
    return odds.groupBy("kind").agg(F.first(F.log((F.col("y") + 1) / (F.col("n") + 1))).alias("bias"), F.map_from_entries(F.collect_list(F.struct("f", "w"))).alias("w"))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, base and all spans as arrays of (kind, s, e), in order of kind, then start.

    A wide candidate is added if its classifier probability reaches threshold, its structure is valid and it overlaps
    no base span; base matches that fail their test are dropped and never come back.
    """
    rows = candidates(docs)
    cand = rows.select("rid", F.inline("cand"))
    model = materialize(reliabilities(cand))  # 4 rows at most
    scores = materialize(classifier(cand, model))  # 4 rows at most
    added = (
        cand.where("NOT base AND ok").join(F.broadcast(scores), "kind")
        .withColumn("p", F.expr("1 / (1 + exp(-(bias + aggregate(transform(seen, f -> coalesce(w[f], double(0))), double(0), (a, b) -> a + b))))"))
        .where(F.col("p") >= threshold)
        .groupBy("rid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    )
    base = rows.select("rid", "doc_id", F.expr("array_sort(transform(filter(cand, x -> x.base AND x.ok), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)))").alias("base"))
    return base.join(added, "rid", "left").select("doc_id", "base", F.expr(
        "CASE WHEN more IS NULL THEN base ELSE array_sort(concat(base, filter(more, a -> NOT exists(base, b -> a.s < b.e AND b.s < a.e)))) END").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    said = lambda c: f"array_join(transform({c}, x -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1), ':', x.s, ':', x.e)), ',')"
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.expr(f"sha2({said('base')}, 256)").alias("base_sha256"), F.expr(said("spans")).alias("spans"))
