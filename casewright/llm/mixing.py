"""Mixing sources to target word counts by pivotal dependent rounding, in DataFrame functions only.

Targets: the sources share the wanted total by weight, each up to a multiple of its own size; the excess is reshared
until none is above. Every document of a source starts with the same expected number of copies, target / size. Its
fractional part is settled by pivots: of two open documents, words move from one to the other until one is integral,
in a random direction that keeps both expectations; the moved words are equal, so the source's expected total never
changes. Blocks of about 32 documents settle inside one expression, the one document that each block leaves open goes
on to the next level, and so on up the tree, log(n)/log(32) levels deep. Only the last one is rounded on its own.

Rows with equal doc_id, source and size are one unit. Of its m rows so many take another copy for certain as the whole part
of m times the fraction says; only the rest, a fraction of one row, is settled by pivots. The copies are dealt to the rows by number.

Random choices are hashes of ids and a seed: reruns agree at any partitioning.

Defined cases: null text has size 0; a document of size 0 is never taken; a null source is a source of its own,
after all others; of rows with one doc_id, source and size some take one copy more than others, those whose text has the smaller digest; very long texts are counted
whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, text_of

WEIGHTS, SHARE, MOST, BLOCK, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 32, 11


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words. Words are the pieces between white space that hold anything."""
    words = F.expr(r"cast(size(filter(split(_t, r'[\x20\x09-\x0D]+'), x -> x <> '')) AS bigint)")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of(docs).alias("_t")).select("doc_id", "source", words.alias("size"))


def targets(units: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source. With caps sorted by cap / weight, the share a weight gets once the
    first k are full is closed-form, so no iteration is needed. The windows run over sources, not documents."""
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    order = "row_number() OVER (ORDER BY source IS NULL, encode(source, 'UTF-8')) - 1"
    kinds = ", ".join(str(w) for w in WEIGHTS)
    per = per.withColumn("w", F.expr(f"element_at(array({kinds}), cast(({order}) % {len(WEIGHTS)} + 1 AS int))").cast("double"))
    per = per.withColumn("cap", MOST * F.col("source_size")).withColumn("total", F.expr(f"{SHARE} * sum(source_size) OVER ()").cast("double"))
    ahead = "OVER (ORDER BY cap / w, source IS NULL, encode(source, 'UTF-8') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    per = per.withColumn("full", F.expr(f"sum(cap) {ahead} - cap")).withColumn("left", F.expr(f"sum(w) OVER () - sum(w) {ahead} + w"))
    per = per.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    # the first source that its share doesn't fill sets the level for all after it
    per = per.withColumn("open", F.expr("min(CASE WHEN level * w <= cap THEN struct(cap / w AS at, level AS level) END) OVER ()"))
    return per.select("source", "source_size", F.expr("CASE WHEN open IS NULL THEN cap ELSE least(cap, open.level * w) END").alias("target"))


#: One pivot: state z = (open unit o, settled units); the next unit is x; u is a hash in [0, 1).
_U = f"(pmod(xxhash64(z.o.doc_id, x.doc_id, z.o.size, x.size, z.o.source, {SEED}), 1000003) / 1000003D)"
_UP = "least((1 - z.o.p) * z.o.s, x.p * x.s)"  # words that can move from x to o
_DOWN = "least(z.o.p * z.o.s, (1 - x.p) * x.s)"  # and from o to x
_UNIT = "named_struct('doc_id', {0}.doc_id, 'source', {0}.source, 'size', {0}.size, 's', {0}.s, 'p', {1}, 'whole', {0}.whole, 'm', {0}.m, 'sure', {0}.sure)"
_TYPE = "struct<doc_id:{0},source:string,size:bigint,s:double,p:double,whole:int,m:bigint,sure:bigint>"


def _settle(kind: str) -> str:
    """SQL: fold a block's units into (o: the one left open, or null; a: those settled)."""
    moved = f"CASE WHEN {_U} * ({_UP} + {_DOWN}) < {_DOWN} THEN {_UP} ELSE -{_DOWN} END"
    snap = lambda p: f"(CASE WHEN {p} < 1e-9 THEN 0D WHEN {p} > 1 - 1e-9 THEN 1D ELSE {p} END)"
    # y = (o with its new p, x with its new p); whichever stays fractional goes on, the other is settled
    pair = f"element_at(transform(array({moved}), d -> named_struct('o', {_UNIT.format('z.o', snap('(z.o.p + d / z.o.s)'))}, 'x', {_UNIT.format('x', snap('(x.p - d / x.s)'))})), 1)"
    after = f"""element_at(transform(array({pair}), y -> CASE
        WHEN y.o.p IN (0D, 1D) AND y.x.p IN (0D, 1D) THEN named_struct('o', cast(NULL AS {_TYPE.format(kind)}), 'a', concat(z.a, array(y.o, y.x)))
        WHEN y.o.p IN (0D, 1D) THEN named_struct('o', y.x, 'a', array_append(z.a, y.o))
        ELSE named_struct('o', y.o, 'a', array_append(z.a, y.x)) END), 1)"""
    return f"""aggregate(units, named_struct('o', cast(NULL AS {_TYPE.format(kind)}), 'a', cast(array() AS array<{_TYPE.format(kind)}>)),
      (z, x) -> CASE WHEN x.p IN (0D, 1D) THEN named_struct('o', z.o, 'a', array_append(z.a, x))
                     WHEN z.o IS NULL THEN named_struct('o', x, 'a', z.a) ELSE {after} END)"""


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized rows, units with m rows that all take `whole` copies and `extra` of which take one more, sources with their
    targets)."""
    sized = materialize(sizes(docs).withColumn("part", F.spark_partition_id()))
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    kind = sized.schema["doc_id"].dataType.simpleString()
    per = materialize(targets(units))  # one row a source
    ratio = F.expr("CASE WHEN source_size > 0 THEN target / source_size ELSE 0D END")
    units = units.alias("u").join(bounded(per.select(F.col("source").alias("_source"), ratio.alias("r"))), F.expr("u.source <=> _source"))
    units = units.select("doc_id", "source", "size", "m", F.expr("CASE WHEN size = 0 THEN 0 ELSE int(floor(r + 1e-9)) END").alias("whole"), F.expr("CASE WHEN size = 0 THEN 0D ELSE greatest(r - floor(r + 1e-9), 0D) * m END").alias("more"))
    start = materialize(units.select("doc_id", "source", "size", F.col("size").cast("double").alias("s"), F.expr("CASE WHEN more - floor(more + 1e-9) < 1e-9 THEN 0D ELSE more - floor(more + 1e-9) END").alias("p"), "whole", "m", F.expr("bigint(floor(more + 1e-9))").alias("sure")))
    unit = F.struct("doc_id", "source", "size", "s", "p", "whole", "m", "sure")
    done, now, level = [start.where("p = 0")], start.where("p > 0"), 0
    n = now.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while n > 1:
        blocks = -(-n // BLOCK)
        share = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + level)), F.lit(blocks)) if blocks > 1 else F.lit(0)
        block = now.groupBy("source", share.alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("by"), F.xxhash64("doc_id", "size").alias("tie"), unit.alias("unit")))).alias("units"))
        block = block.withColumn("units", F.expr("transform(units, x -> x.unit)"))
        settled = materialize(block.select(F.expr(_settle(kind)).alias("z")))
        done.append(settled.select(F.inline("z.a")))
        now = settled.where("z.o IS NOT NULL").select("z.o.*")
        n, level = (blocks if blocks > 1 else 1), level + 1
    last = now.withColumn("p", F.expr(f"CASE WHEN pmod(xxhash64(doc_id, size, source, {SEED}), 1000003) / 1000003D < p THEN 1D ELSE 0D END"))
    for part in done:
        last = last.unionByName(part)
    return sized, last.select("doc_id", "source", "size", "m", F.col("whole").cast("long").alias("whole"), (F.col("sure") + F.col("p")).cast("long").alias("extra")), per


_SAME = "_d <=> _k AND _s <=> _t AND _n = _z"


def dealt(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows with _d, _s, _n (doc_id, source, size), _h (digest of the text) and part, their number of a written partition: adds copies.

    Rows of a unit are numbered by the digests of their texts, so the same texts are taken at any partitioning; rows that repeat a text are numbered by
    partition first, so a unit that holds very many rows is numbered in many tasks."""
    units = units.select(F.col("doc_id").alias("_k"), F.col("source").alias("_t"), F.col("size").alias("_z"), "m", "whole", "extra")
    found = rows.join(units, F.expr(_SAME)).drop("_k", "_t", "_z")
    alone = found.where("m = 1").withColumn("copies", F.col("whole") + F.col("extra")).drop("m", "whole", "extra")
    many = found.where("m > 1")
    counts = many.groupBy(F.col("_d").alias("_k"), F.col("_s").alias("_t"), F.col("_n").alias("_z"), F.col("_h").alias("_g"), F.col("part").alias("_p")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.expr("sum(_c) OVER (PARTITION BY _k, _t, _z ORDER BY _g, _p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _c")).drop("_c")
    number = F.expr("row_number() OVER (PARTITION BY _d, _s, _n, _h, part ORDER BY part)")
    many = many.withColumn("_i", number).join(counts, F.expr(f"{_SAME} AND _h = _g AND part = _p"))
    return alone.unionByName(many.withColumn("copies", F.expr("whole + CASE WHEN _before + _i <= extra THEN 1L ELSE 0L END")).select(alone.columns))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    sized, decided, per = copies(docs)
    rows = dealt(sized.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.lit("").alias("_h"), "part"), materialize(decided))
    s = bounded(per.select(F.col("source").alias("_source"), "source_size", "target"))
    return rows.join(s, F.expr("_s <=> _source")).select(F.col("_d").alias("doc_id"), F.col("_s").alias("source"), F.col("_n").alias("size"), "source_size",
        F.col("target").cast("double"), "copies", (F.col("copies") * F.col("_n")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Only rows that share doc_id, source and size with others are numbered; the rest
    meets its copies where it is read. Null and repeated rows, empty tables and clashing columns as in copies()."""
    _, decided, _ = copies(docs)
    decided = materialize(decided)
    words = F.expr(r"cast(size(filter(split(coalesce(cast(text AS string), ''), r'[\x20\x09-\x0D]+'), x -> x <> '')) AS bigint)")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_d"), F.col("source").cast("string").alias("_s"), words.alias("_n"), F.md5(text_of(docs)).alias("_h"))
    side = lambda rows: bounded(rows.select(F.col("doc_id").alias("_k"), F.col("source").alias("_t"), F.col("size").alias("_z"), (F.col("whole") + F.col("extra")).alias("copies")))
    out = packed.join(side(decided.where("m = 1 AND whole + extra > 0")), F.expr(_SAME)).select("_row", "copies")
    if not decided.where("m > 1").isEmpty():
        again = materialize(packed.join(side(decided.where("m > 1")).drop("copies"), F.expr(_SAME), "left_semi").withColumn("part", F.spark_partition_id()))
        out = out.union(dealt(again, decided.where("m > 1")).where("copies > 0").select("_row", "copies"))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
