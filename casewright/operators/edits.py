"""Edits of case tables: set, add and describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENDS = ("least(i, j) AS _low", "greatest(i, j) AS _high", "ckt AS _ckt")
_SAME = "least(i, j) = _low AND greatest(i, j) = _high AND ckt = _ckt"


def set_fields(elements: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """changes: i, j (either way round), ckt, seq, values (field -> text). The latest change of a field wins."""
    said = changes.select("i", "j", "ckt", "seq", F.explode("values").alias("field", "value"))
    last = said.groupBy(*map(F.expr, _ENDS)).agg(*(F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}") for f in fields))
    out = elements.join(last, F.expr(_SAME), "left")
    return out.select(*(F.coalesce(F.col(f"_{c}").cast(elements.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in elements.columns))


def add_circuits(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """One new element for each wanted (i, j), in service, with the smallest circuit number that the pair doesn't use."""
    used = elements.groupBy(F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).agg(F.collect_set(F.col("ckt").try_cast("int")).alias("used"))
    asked = wanted.groupBy(F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).agg(F.count("*").cast("int").alias("n"))
    free = asked.join(used, ["low", "high"], "left").withColumn("used", F.coalesce("used", F.expr("cast(array() AS array<int>)")))
    ids = F.expr("slice(array_except(sequence(1, size(used) + n), used), 1, n)")
    return elements.unionByName(free.select(F.col("low").alias("i"), F.col("high").alias("j"), F.explode(ids.cast("array<string>")).alias("ckt"), F.lit(1).alias("st")), allowMissingColumns=True)


def describe(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, was, now: each field that differs, as text."""
    tall = lambda df, name: df.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", name))
    return tall(before, "was").join(tall(after, "now"), [*keys, "field"]).where("NOT (was <=> now)")


def generator_warnings(generators: DataFrame, buses: DataFrame) -> DataFrame:
    """Generators (bus, st) in service at a load bus (type 1): the solver holds their output and doesn't let them hold the voltage."""
    return generators.where("st = 1").join(buses.where("ide = 1").select("bus", "ide"), "bus")


def scaled(buses: DataFrame, area: int, column: str, factor: float | None = None, change: float | None = None) -> DataFrame:
    """The column of an area's live buses times factor, or changed by an amount in all, shared in proportion. A change that no
    positive factor gives is refused."""
    chosen = (F.col("area") == area) & (F.col("ide") != 4)
    if factor is None:
        total = buses.where(chosen).agg(F.sum(F.col(column).cast("decimal(18,5)")).cast("double")).first()[0]
        if not total or (total + change) / total <= 0:
            raise ValueError(f"{column} of area {area} is {total or 0}; it can't change by {change}")
        factor = (total + change) / total
    if factor <= 0:
        raise ValueError("a factor must be positive")
    return buses.withColumn(column, F.when(chosen, F.col(column) * factor).otherwise(F.col(column)))


def area_by_name(areas: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, area: the area of each wanted name: an equal name, else the only one of which either is the other's start."""
    w, a = wanted.select("name", F.lower(F.trim("name")).alias("w")), areas.select("area", F.lower(F.trim("area_name")).alias("a"))
    # a name that another one begins with is one of its prefixes, so both ways are equal joins
    starts = lambda df, c: df.select("*", F.explode(F.expr(f"transform(sequence(1, length({c})), n -> left({c}, n))")).alias("start")).where(F.length(c) > 0)
    met = starts(a, "a").join(w, F.expr("start = w")).union(starts(w, "w").join(a.where("a <> ''"), F.expr("start = a AND a <> w")).select("area", "a", "start", "name", "w"))
    best = met.groupBy("name").agg(F.max(F.when(F.expr("a = w"), F.col("area"))).alias("equal"), F.count("*").alias("n"), F.max("area").alias("only"))
    return best.select("name", F.coalesce("equal", F.when(F.col("n") == 1, F.col("only"))).alias("area")).where("area IS NOT NULL")


def totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """area (null for all), load and generation before and after in service, the imbalance that the edits make (generation less load, against before), and the
    buses that carry it: swing buses of the area with generation after the edits, in order. Columns: bus, ide, area, load_mw, generation_mw."""
    exact = lambda c, n: F.sum(F.col(c).cast("decimal(28,5)")).alias(n)
    side = lambda df, n: df.where("ide <> 4").groupingSets([["area"], []], "area").agg(exact("load_mw", f"load_{n}"), exact("generation_mw", f"generation_{n}"), F.grouping("area").alias("all"))
    swing = after.where("ide = 3 AND generation_mw IS NOT NULL").groupingSets([["area"], []], "area").agg(F.sort_array(F.collect_list("bus")).alias("carried_by"), F.grouping("area").alias("all"))
    a, b = side(before, "before"), side(after, "after")
    met = a.join(b.withColumnsRenamed({"area": "_a", "all": "_l"}), F.expr("area <=> _a AND all = _l"), "full").withColumn("area", F.coalesce("area", "_a")).withColumn("all", F.coalesce("all", "_l"))
    met = met.join(swing.withColumnsRenamed({"area": "_s", "all": "_m"}), F.expr("area <=> _s AND all = _m"), "left")
    names = ["load_before", "load_after", "generation_before", "generation_after"]
    known = [F.coalesce(c, F.lit(0).cast("decimal(38,5)")) for c in names]
    return met.select("area", *(k.cast("double").alias(n) for k, n in zip(known, names)), ((known[3] - known[1]) - (known[2] - known[0])).cast("double").alias("imbalance_mw"), F.coalesce("carried_by", F.array().cast("array<bigint>")).alias("carried_by"))
