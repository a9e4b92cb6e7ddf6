"""RAW power-flow cases as a job over many case files: lines, sections, records and typed tables.

A case is a case line, two title lines, and sections of comma-separated records, each ended by a marker (a record that
begins with 0) that may name the section it ends and the one it begins. Quoted fields stay text; a slash outside quotes
starts a comment; a line with only Q ends the case.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from casewright.functions.columns import lenient_double, lenient_int

#: Names of the fields of a version 33 record's first line, by section.
NAMES = {
    "BUS": "I NAME BASKV IDE AREA ZONE OWNER VM VA NVHI NVLO EVHI EVLO",
    "LOAD": "I ID STATUS AREA ZONE PL QL IP IQ YP YQ OWNER SCALE INTRPT",
    "FIXED SHUNT": "I ID STATUS GL BL",
    "GENERATOR": "I ID PG QG QT QB VS IREG MBASE ZR ZX RT XT GTAP STAT RMPCT PT PB O1 F1 O2 F2 O3 F3 O4 F4 WMOD WPF",
    "BRANCH": "I J CKT R X B RATEA RATEB RATEC GI BI GJ BJ ST MET LEN O1 F1 O2 F2 O3 F3 O4 F4",
    "TRANSFORMER": "I J K CKT CW CZ CM MAG1 MAG2 NMETR NAME STAT O1 F1 O2 F2 O3 F3 O4 F4 VECGRP",
    "AREA": "I ISW PDES PTOL ARNAME",
    "ZONE": "I ZONAME",
    "OWNER": "I OWNAME",
}
#: Sections whose records have three lines; transformers have four or five.
THREE_LINES = ("TWO-TERMINAL DC", "VOLTAGE SOURCE CONVERTER")
#: name=default of the fields of editable records by version; no default means the field stays empty.
_OWN = "O1 F1=1.0 O2=0 F2=1.0 O3=0 F3=1.0 O4=0 F4=1.0"
_LOAD = "I ID=1 {status}=1 AREA ZONE PL=0.0 QL=0.0 IP=0.0 IQ=0.0 YP=0.0 YQ=0.0 OWNER SCALE=1 INTRPT=0"
_GEN = ("I ID=1 PG=0.0 QG=0.0 QT=9999.0 QB=-9999.0 VS=1.0 IREG=0", "MBASE ZR=0.0 ZX=1.0 RT=0.0 XT=0.0 GTAP=1.0 STAT=1 RMPCT=100.0 PT=9999.0 PB=-9999.0", "WMOD=0 WPF=1.0")
_TAIL = "GI=0.0 BI=0.0 GJ=0.0 BJ=0.0 {status}=1 MET=1 LEN=0.0"
_RATES = " ".join(f"RATE{i}=0.0" for i in range(1, 13))
LAYOUTS = {
    (33, "LOAD"): _LOAD.format(status="STATUS"),
    (34, "LOAD"): _LOAD.format(status="STAT") + " DGENP=0.0 DGENQ=0.0 DGENF=0",
    (35, "LOAD"): _LOAD.format(status="STAT") + " DGENP=0.0 DGENQ=0.0 DGENM=0 LOADTYPE",
    (33, "GENERATOR"): f"{_GEN[0]} {_GEN[1]} {_OWN} {_GEN[2]}",
    (34, "GENERATOR"): f"{_GEN[0]} {_GEN[1]} {_OWN} {_GEN[2]} NREG=0",
    (35, "GENERATOR"): f"{_GEN[0]} NREG=0 {_GEN[1]} BASLOD=0 {_OWN} {_GEN[2]}",
    (33, "BRANCH"): f"I J CKT=1 R=0.0 X B=0.0 RATEA=0.0 RATEB=0.0 RATEC=0.0 {_TAIL.format(status='ST')} {_OWN}",
    (34, "BRANCH"): f"I J CKT=1 R=0.0 X B=0.0 NAME {_RATES} {_TAIL.format(status='STAT')} {_OWN}",
    (35, "BRANCH"): f"I J CKT=1 R=0.0 X B=0.0 NAME {_RATES} {_TAIL.format(status='STAT')} {_OWN}",
}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """file, text: a row a case file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def fields(line: Column) -> Column:
    """Fields of a data line: array of (value, quoted)."""
    body = F.regexp_extract(line, r"""^((?:'[^']*'|"[^"]*"|[^'"/])*)""", 1)
    cells = F.regexp_extract_all(F.concat(body, F.lit(",")), F.lit(r"""((?:'[^']*'|"[^"]*"|[^,'"])*),"""), 1)
    return F.transform(cells, lambda x: F.struct(F.trim(F.regexp_replace(x, "['\"]", "")).alias("value"), x.rlike("['\"]").alias("quoted")))


def lines(cases: DataFrame) -> DataFrame:
    """file, version, n, section, ordinal, fields: the data lines of every section, in order. The window runs within a file."""
    each = cases.select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "line")).select("file", "n", F.trim("line").alias("line"))
    each = each.withColumn("first", F.min(F.when(~F.col("line").startswith("@!"), F.col("n"))).over(Window.partitionBy("file")))
    order = Window.partitionBy("file").orderBy("n")
    each = each.withColumn("version", F.max(F.when(F.col("n") == F.col("first"), F.get(fields(F.col("line")), F.lit(2))["value"].try_cast("int"))).over(Window.partitionBy("file")))
    body = each.where("n >= first + 3").withColumn("ended", F.max(F.expr("int(upper(line) = 'Q')")).over(order)).where("ended = 0")
    marker = F.col("line").rlike(r"^0\s*(/|$)")
    body = body.withColumn("marker", marker).withColumn("part", F.sum(marker.cast("int")).over(order) - marker.cast("int"))
    name = lambda what: F.nullif(F.trim(F.regexp_extract(F.upper("line"), rf"{what} (.+?) DATA", 1)), F.lit(""))
    within = Window.partitionBy("file", "part")
    # a section is named by the marker that ends it, else by the one before it
    body = body.withColumn("ending", F.max(F.when(F.col("marker"), name("END OF"))).over(within))
    begun = body.where("marker").select("file", (F.col("part") + 1).alias("part"), name("BEGIN").alias("begun"))
    body = body.where("NOT marker AND NOT startswith(line, '@!') AND line <> ''").join(begun, ["file", "part"], "left")
    named = F.coalesce("ending", "begun", F.when(F.col("part") == 0, "BUS"), F.concat(F.lit("SECTION "), F.col("part") + 1))
    out = body.select("file", "version", "n", named.alias("section"), "part", fields(F.col("line")).alias("fields"))
    out = out.where("size(fields) > 1 OR get(fields, 0).value <> '' OR get(fields, 0).quoted")
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("file", "part").orderBy("n")) - 1)


@F.pandas_udf(ArrayType(IntegerType()))
def _record_of(flags: pd.Series) -> pd.Series:
    """For the lines of a transformer section, in order, with 1 where the third field names a bus: each line's record."""
    out = []
    for f in flags:
        of, at, record = [0] * len(f), 0, 0
        while at < len(f):
            size = 5 if f[at] else 4
            for i in range(at, min(at + size, len(f))):
                of[i] = record
            at, record = at + size, record + 1
        out.append(of)
    return pd.Series(out)


def records(data: DataFrame) -> DataFrame:
    """file, version, section, record, line (within the record), n, fields. A transformer's length is known from its first line
    only, so those sections are folded, one case's section at a time."""
    plain = data.where("section <> 'TRANSFORMER'")
    size = F.when(F.col("section").isin(*THREE_LINES), 3).otherwise(1)
    plain = plain.select("file", "version", "section", F.floor(F.col("ordinal") / size).cast("int").alias("record"), (F.col("ordinal") % size).cast("int").alias("line"), "n", "fields")
    folded = data.where("section = 'TRANSFORMER'")
    third = F.expr("int(size(fields) > 2 AND get(fields, 2).value NOT IN ('0', ''))")
    of = folded.groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("ordinal", third.alias("k")))).alias("x")).select("file", "part", _record_of(F.col("x.k")).alias("of"))
    folded = folded.join(of, ["file", "part"]).withColumn("record", F.expr("of[ordinal]"))
    line = F.row_number().over(Window.partitionBy("file", "part", "record").orderBy("ordinal")) - 1
    return plain.union(folded.select("file", "version", "section", "record", line.alias("line"), "n", "fields"))


def named(found: DataFrame) -> DataFrame:
    """file, section, record, values (map of name -> text): the first lines of records, by the version 33 names; another version's
    line takes them only if it has exactly as many fields. Fields beyond the names, or without any, are field_<n>."""
    names = F.create_map(*(F.lit(x) for s, n in NAMES.items() for x in (s, n)))
    known = F.coalesce(F.split(F.element_at(names, F.col("section")), " "), F.expr("cast(array() AS array<string>)"))
    out = found.where("line = 0").withColumn("known", known).withColumn("known", F.expr("CASE WHEN version = 33 OR size(known) = size(fields) THEN known ELSE cast(array() AS array<string>) END"))
    pairs = F.expr("map_from_arrays(transform(fields, (x, i) -> coalesce(get(known, i), concat('field_', i + 1))), transform(fields, x -> x.value))")
    return out.select("file", "section", "record", pairs.alias("values"))


def _number(i: int) -> Column:
    return lenient_double(F.get("fields", F.lit(i))["value"])


def _int(i: int) -> Column:
    return lenient_int(F.get("fields", F.lit(i))["value"])


def _text(i: int) -> Column:
    return F.coalesce(F.get("fields", F.lit(i))["value"], F.lit(""))


def buses(found: DataFrame) -> DataFrame:
    out = found.where("section = 'BUS' AND size(fields) >= 9").select("file", _int(0).alias("bus_id"), _text(1).alias("bus_name"), _number(2).alias("base_kv"), _int(4).alias("area"), _int(5).alias("zone"), _int(6).alias("owner"), _number(7).alias("vm"), _number(8).alias("va"))
    return out.na.drop(subset=["bus_id", "base_kv", "area", "zone", "owner", "vm", "va"])


def branches(found: DataFrame) -> DataFrame:
    """Branch records of 18 fields or more; of records with one key the first in the file stays."""
    names = ["r", "x", "b", "ratea", "rateb", "ratec", "gi", "bi", "gj", "bj"]
    rows = found.where("section IN ('BRANCH', 'NONTRANSFORMER BRANCH') AND size(fields) >= 18")
    out = rows.select("file", "n", F.abs(_int(0)).alias("from_bus"), F.abs(_int(1)).alias("to_bus"), _text(2).alias("line_id"), *(_number(i + 3).alias(c) for i, c in enumerate(names)),
        _int(13).alias("status"), _int(14).alias("metered_end"), _number(15).alias("length"), _int(16).alias("owner_1"), _number(17).alias("owner_1_fraction"))
    out = out.where("from_bus IS NOT NULL AND to_bus IS NOT NULL")
    keep = [c for c in out.columns if c not in ("file", "n", "from_bus", "to_bus", "line_id")]
    first = out.groupBy("file", "from_bus", "to_bus", "line_id").agg(F.min_by(F.struct(*keep), "n").alias("x"))
    return first.select("file", "from_bus", "to_bus", "line_id", "x.*").withColumn("raw_branch_type", F.lit("nontransformer_branch"))


def areas(found: DataFrame) -> DataFrame:
    out = found.where("section IN ('AREA', 'AREA INTERCHANGE') AND size(fields) >= 5")
    return out.select("file", _int(0).alias("area"), _int(1).alias("slack_bus"), _number(2).alias("pdes"), _number(3).alias("ptol"), _text(4).alias("area_name")).where("area IS NOT NULL")


def transformers(found: DataFrame) -> DataFrame:
    """file, record, i, j, k (0 with two windings), circuit, status, name."""
    out = found.where("section = 'TRANSFORMER' AND line = 0").select("file", "record", F.abs(_int(0)).alias("i"), F.abs(_int(1)).alias("j"), F.coalesce(F.abs(_int(2)), F.lit(0)).alias("k"),
        F.coalesce(F.nullif(_text(3), F.lit("")), F.lit("1")).alias("circuit"), F.coalesce(F.nullif(_text(11), F.lit("")), F.lit("1")).alias("status"), _text(10).alias("name"))
    return out.where("i IS NOT NULL AND j IS NOT NULL")


def windings(found: DataFrame, observed: DataFrame, bus_ids: DataFrame) -> DataFrame:
    """Transformer rows as the results name them. observed: file, from_bus, to_bus, line_id of the branches seen in results.

    Two windings: one row, turned the way it was observed. Three: a row a winding, through the internal bus (one that the case
    doesn't list) that is observed with all three terminals."""
    named_ = transformers(found)
    two = named_.where("k = 0").alias("t")
    seen = observed.select(F.col("file").alias("_f"), F.col("from_bus").alias("_a"), F.col("to_bus").alias("_b"), F.col("line_id").alias("_c")).distinct()
    rates = found.where("section = 'TRANSFORMER' AND line >= 2").select(F.col("file").alias("_rf"), F.col("record").alias("_rr"), (F.col("line") - 1).alias("_w"), _number(3).alias("ratea"))
    turned = two.join(seen.alias("x"), F.expr("_f = file AND _a = i AND _b = j AND _c = circuit"), "left").select("t.*", F.col("_f").alias("_same"))
    turned = turned.join(seen.alias("y"), F.expr("_f = file AND _a = j AND _b = i AND _c = circuit"), "left").withColumn("turn", F.expr("_same IS NULL AND _f IS NOT NULL"))
    flat = turned.select("file", "record", F.expr("IF(turn, j, i)").alias("from_bus"), F.expr("IF(turn, i, j)").alias("to_bus"), F.col("circuit").alias("line_id"), F.lit("1-2").alias("winding"), F.lit(None).cast("long").alias("internal_bus"), F.lit(1).alias("w"))
    three = named_.where("k <> 0").select("file", "record", "circuit", F.posexplode(F.array("i", "j", "k")).alias("w", "terminal"))
    ends = seen.select("_f", "_a", "_b", "_c", F.col("_a").alias("_t"), F.col("_b").alias("_o")).union(seen.select("_f", "_a", "_b", "_c", "_b", "_a"))
    inner = ends.join(bus_ids.select(F.col("file").alias("_bf"), F.col("bus_id").alias("_bus")).distinct(), F.expr("_bf = _f AND _bus = _o"), "left_anti")
    met = three.join(inner, F.expr("_f = file AND _c = circuit AND _t = terminal"))
    whole = met.groupBy("file", "record", F.col("_o").alias("internal_bus")).agg(F.count_distinct("w").alias("n")).where("n = 3").drop("n")
    wound = met.join(whole.select(F.col("file").alias("_wf"), F.col("record").alias("_wr"), "internal_bus"), F.expr("_wf = file AND _wr = record AND internal_bus = _o"))
    wound = wound.select("file", "record", F.col("_a").alias("from_bus"), F.col("_b").alias("to_bus"), F.col("circuit").alias("line_id"), F.expr("CAST(w + 1 AS STRING)").alias("winding"), "internal_bus", (F.col("w") + 1).alias("w"))
    both = flat.union(wound).join(rates, F.expr("_rf = file AND _rr = record AND _w = w"), "left")
    return both.select("file", "from_bus", "to_bus", "line_id", "winding", "internal_bus", "ratea")


def typed(found: DataFrame) -> DataFrame:
    """file, version, section, record, values (map of name -> text): load, generator and branch records by their version's layout;
    what a record leaves out takes its default."""
    spark = found.sparkSession
    rows = [(v, s, [f.split("=")[0] for f in text.split()], [f.partition("=")[2] for f in text.split()]) for (v, s), text in LAYOUTS.items()]
    layout = F.broadcast(spark.createDataFrame(rows, "version int, section string, names array<string>, defaults array<string>"))  # nine rows
    filled = F.expr("map_from_arrays(names, transform(defaults, (d, i) -> coalesce(nullif(get(fields, i).value, ''), d)))")
    return found.join(layout, ["version", "section"]).select("file", "version", "section", "record", filled.alias("values"))


def network_tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(buses, branches, transformers, areas) of all records as one network: buses with bus_name, ide, area and the in-service load_mw and
    generation_mw; branches i, j, ckt, st; transformers i, j, k, circuit, status; areas area, area_name."""
    value = lambda n: F.element_at("values", F.lit(n))
    first = F.coalesce(value("STATUS"), value("STAT"), value("ST"), F.lit("1"))
    bus = named(found.where("section = 'BUS'")).select(lenient_int(value("I")).alias("bus"), F.trim(value("NAME")).alias("bus_name"), lenient_int(value("IDE")).alias("ide"), lenient_int(value("AREA")).alias("area")).where("bus IS NOT NULL")
    records_ = typed(found)
    at_bus = lambda section, field, name: records_.where(F.col("section") == section).where(first == "1").groupBy(lenient_int(value("I")).alias("bus")).agg(
        F.sum(lenient_double(value(field)).cast("decimal(18,5)")).alias(name))
    sums = bus.join(at_bus("LOAD", "PL", "load_mw"), "bus", "left").join(at_bus("GENERATOR", "PG", "generation_mw"), "bus", "left").na.fill(0, ["load_mw", "generation_mw"])
    branch = records_.where("section = 'BRANCH'").select(F.abs(lenient_int(value("I"))).alias("i"), F.abs(lenient_int(value("J"))).alias("j"), F.coalesce(F.nullif(F.trim(value("CKT")), F.lit("")), F.lit("1")).alias("ckt"), F.when(first == "0", 0).otherwise(1).alias("st"))
    return sums, branch, transformers(found).select("i", "j", "k", "circuit", "status"), areas(found).select("area", "area_name").distinct()


def searchable(found: DataFrame) -> DataFrame:
    """kind, record, keys (bus numbers, id or circuit), buses of the load, generator, branch and transformer records."""
    value = lambda n: F.element_at("values", F.lit(n))
    rows, bus = typed(found), lambda n: F.abs(lenient_int(value(n)))
    row = lambda kind, buses_, last: [F.lit(kind).alias("kind"), F.concat_ws(" ", *buses_, last).alias("record"), F.array(*(b.cast("string") for b in buses_), last).alias("keys"), F.array(*buses_).alias("buses")]
    single = [rows.where(F.col("section") == s.upper()).select(*row(s, [bus("I")], F.trim(value("ID")))) for s in ("load", "generator")]
    branch = rows.where("section = 'BRANCH'").select(*row("branch", [bus("I"), bus("J")], F.trim(value("CKT"))))
    wound = transformers(found).withColumn("buses", F.expr("filter(array(i, j, k), b -> b <> 0)"))
    wound = wound.select(F.lit("transformer").alias("kind"), F.concat_ws(" ", "i", "j", "k", "circuit").alias("record"), F.concat(F.col("buses").cast("array<string>"), F.array("circuit")).alias("keys"), "buses")
    return single[0].union(single[1]).union(branch).union(wound)
