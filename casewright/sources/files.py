"""Text sources and sinks of case data: CSV with aliased headers, whitespace tables, success logs, JSON lines."""

from __future__ import annotations

import re
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.columns import canonical_label, lenient_double, lenient_int

#: Header names, normalised, that stand for a canonical column.
ALIASES = {
    "event_idx": ("event_idx", "event_index", "contingency_index"),
    "contingency": ("contingency", "contingency_name", "event"),
    "from_bus": ("from_bus", "frombus", "i_bus", "ibus"),
    "to_bus": ("to_bus", "tobus", "j_bus", "jbus"),
    "line_id": ("circuit_id", "circuit", "ckt", "line_id"),
    "section": ("section", "section_id"),
    "loading_percent": ("loading_percent", "loading_pct", "loading", "utilization_percent", "utilization_pct"),
    "rate_mva": ("rate_mva", "rating_mva", "rating"),
    "viol": ("viol", "violation"),
}
#: What a header must have for its role, as aliases of each column.
ROLES = {
    "flat": (ALIASES["from_bus"], ALIASES["to_bus"], ALIASES["line_id"], ALIASES["loading_percent"]),
    "convergence": (ALIASES["event_idx"], ALIASES["contingency"], ("converged",), ("status_code", "status")),
    "bus": (("bus_id", "bus"), ("base_kv", "kv"), ("area", "area_id")),
}
_INTS, _DOUBLES, _LABELS = ("event_idx", "from_bus", "to_bus", "viol"), ("rate_mva", "loading_percent"), ("line_id", "section")
#: Columns that a row must hold to count as a case.
REQUIRED = ("from_bus", "to_bus", "line_id", "loading_percent")


def normalised(header: str) -> str:
    """Lower case; whatever isn't a letter or digit is one underscore, and none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_")


def canonical_columns(header: list[str]) -> dict[str, str]:
    """canonical name -> header name, the first alias that the header has."""
    have = {}
    for h in header:
        have.setdefault(normalised(h), h)
    return {name: have[a] for name, options in ALIASES.items() for a in [next((o for o in options if o in have), None)] if a}


def role(header: list[str]) -> str:
    """flat, convergence, bus or unknown, by the columns that a header has."""
    names = {normalised(h) for h in header}
    return next((r for r, columns in ROLES.items() if all(names & set(options) for options in columns)), "unknown")


def csv_roles(spark: SparkSession, path: str, preferred: dict[str, str]) -> DataFrame:
    """file, role, chosen for the CSV files below path, by their first lines. Of several files of a role the one whose name
    holds the preferred word is chosen, then the first by name. Headers are cut at every comma. Later blocks of a file are read and dropped:
    Spark has no way to skip them before they are read."""
    rows = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    # min_by of a text alone makes Spark sort all lines of a split by file; beside a set it hashes, so a task holds one line a file
    heads = rows.where("at = 0").groupBy("file", "name").agg(F.min_by("value", "n").alias("head"), F.collect_set("at").alias("starts")).where(F.size("starts") == 1).drop("starts")
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_|_$", "")
    heads = heads.withColumn("names", F.transform(F.split("head", ","), clean))
    kind = F.coalesce(*(F.when(reduce(lambda a, b: a & b, (F.arrays_overlap("names", F.array(*map(F.lit, o))) for o in columns)), r) for r, columns in ROLES.items()), F.lit("unknown"))
    heads = heads.withColumn("role", kind)
    liked = F.coalesce(*(F.when((F.col("role") == r) & F.lower("name").contains(word), 0) for r, word in preferred.items()), F.lit(1))
    first = heads.where("role <> 'unknown'").groupBy("role").agg(F.min_by("file", F.struct(liked, "file")).alias("best"))
    return heads.join(F.broadcast(first), "role", "left").select("file", "role", F.coalesce(F.col("file") == F.col("best"), F.lit(False)).alias("chosen"))  # three rows


def _typed(name: str, x: Column) -> Column:
    if name in _INTS:
        return lenient_int(x)
    if name in _DOUBLES:
        return lenient_double(x)
    return canonical_label(x) if name in _LABELS else F.trim(x)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """All rows of flat-result CSV files, typed leniently: labels stay literal, what isn't a number is null. Only aliased
    columns are read. Missing optional columns get their defaults."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    found = canonical_columns(raw.columns)
    defaults = {"section": F.lit(""), "event_idx": F.lit(None).cast("long"), "contingency": F.lit(""), "rate_mva": F.lit(None).cast("double"), "viol": F.lit(0).cast("long")}
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    typed = {n: _typed(n, F.col(f"`{found[n]}`")) if n in found else defaults[n] for n in ALIASES}
    return raw.select(*(F.coalesce(c, defaults[n]).alias(n) if n in ("section", "viol") else c.alias(n) for n, c in typed.items()))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=list(REQUIRED))


def reject_counts(rows: DataFrame) -> DataFrame:
    """Rows read, accepted and rejected, and by which column."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(_whole()).alias("n_accepted"), F.count_if(~_whole()).alias("n_rejected"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in REQUIRED))


def _whole() -> Column:
    out = F.lit(True)
    for c in REQUIRED:
        out = out & F.col(c).isNotNull()
    return out


def whitespace_table(lines: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Lines (value) of a text table by (name, type) columns. A line with another number of fields, or with a field that
    isn't of its type, is rejected."""
    cells = F.split(F.trim("value"), r"\s+")
    fields = lines.select(cells.alias("c")).where(F.size("c") == len(columns))
    typed = fields.select(*((F.col("c")[i] if t == "string" else F.col("c")[i].try_cast(t)).alias(n) for i, (n, t) in enumerate(columns)))
    return typed.na.drop(subset=[n for n, _ in columns])


#: Fixed value: the form of a success line.
SUCCESS = r"(?i)contingency:\s*(\d+)\s+success:\s*(true|false)(?:\s+violation:\s*(\w+))?(?:\s+warning:\s*(\w+))?"


def success_log(lines: DataFrame) -> DataFrame:
    """`contingency: N success: true|false [violation: w] [warning: w]` lines without regard to case, others left out."""
    part = lambda i: F.lower(F.regexp_extract("value", SUCCESS, i))
    return lines.where(F.col("value").rlike(SUCCESS)).select(part(1).cast("long").alias("contingency"), (part(2) == "true").alias("success"),
        F.coalesce(F.nullif(part(3), F.lit("")), F.lit("none")).alias("violation"), (part(4) == "isolated").alias("isolated"))


BUCKETS = 64


def write_index(cases: DataFrame, path: str) -> None:
    """Cases in buckets of their event, sorted by it, so one event reads one folder and few row groups."""
    # a constant, balanced number of writers a bucket: a large base case isn't one task
    (cases.withColumn("event_bucket", F.pmod("event_idx", F.lit(BUCKETS)).cast("int"))
        .repartition("event_bucket", F.pmod(F.xxhash64("from_bus", "to_bus"), F.lit(4))).sortWithinPartitions("event_bucket", "event_idx")
        .write.mode("overwrite").option("compression", "zstd").partitionBy("event_bucket").parquet(path))


def read_event(spark: SparkSession, path: str, event: int) -> DataFrame:
    """Cases of one event from the index: partition pruning on its bucket, then a pushed filter."""
    return spark.read.parquet(path).where((F.col("event_bucket") == event % BUCKETS) & (F.col("event_idx") == event)).drop("event_bucket")


#: Words that sound like success and like failure.
SUCCESS_WORDS, FAILURE_WORDS = ("true", "success", "pass", "passed", "1"), ("false", "failed", "fail", "0")


def token_counts(lines: DataFrame, run: str, column: str) -> DataFrame:
    """By run: how many words sound like success, and how many like failure. For logs without the usual lines."""
    words = lambda known: F.size(F.regexp_extract_all(F.lower(column), F.lit(rf"\b({'|'.join(known)})\b"), 1))
    return lines.groupBy(run).agg(F.sum(words(SUCCESS_WORDS)).alias("success_like"), F.sum(words(FAILURE_WORDS)).alias("failure_like"))


def stamp(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, bytes and the latest change of the files below path. No content is read."""
    found = spark.read.format("binaryFile").load(path).select("length", "modificationTime")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("changed"))


#: The form of the index and of cached summaries; what another version wrote isn't used.
VERSION = 1


def build_index(spark: SparkSession, source: str, read, path: str) -> DataFrame:
    """Index the cases that read(source) gives and have an event and a finite loading. Each build is a folder of its own; its row in the
    manifest is written last, so readers never see half of one. Fails if the source changed meanwhile. Returns the row."""
    before = stamp(spark, source).first()
    name = uuid4().hex
    known = read(source).where(F.col("event_idx").isNotNull() & F.col("loading_percent").isNotNull() & ~F.isnan("loading_percent") & (F.abs("loading_percent") < float("inf")))
    write_index(known, f"{path}/{name}")
    if stamp(spark, source).first() != before:
        raise RuntimeError("the source changed while it was indexed")
    rows = spark.read.parquet(f"{path}/{name}").count()
    row = spark.createDataFrame([(name, VERSION, rows, before.files, before.bytes, before.changed)], "generation string, version int, n_rows long, files long, bytes long, changed timestamp").withColumn("built", F.current_timestamp())
    row.write.mode("append").parquet(f"{path}/manifest")
    return row


def current_index(spark: SparkSession, path: str, source: str) -> tuple[str, bool] | None:
    """(folder, fresh) of the latest build: it is fresh while the source has the files, bytes and time that were indexed."""
    last = spark.read.parquet(f"{path}/manifest").where(F.col("version") == VERSION).orderBy(F.desc("built")).first()
    now = stamp(spark, source).first()
    return (f"{path}/{last.generation}", (last.files, last.bytes, last.changed) == tuple(now)) if last else None


def cache_state(cached: DataFrame, sources: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """source, state: of each source's cached tables (source, name, version, written). fresh: all required tables are there in
    this version and newer than the source (source, changed); stale: some is older; missing otherwise."""
    tables_ = cached.where((F.col("version") == VERSION) & F.col("name").isin(*required)).groupBy("source").agg(F.count_distinct("name").alias("n"), F.min("written").alias("oldest"))
    both = sources.join(tables_, "source", "left")
    state = F.when(F.coalesce("n", F.lit(0)) < len(required), "missing").when(F.col("oldest") > F.col("changed"), "fresh").otherwise("stale")
    return both.select("source", state.alias("state"))


#: Kinds of files by suffix.
KINDS = {"csv": "table", "parquet": "table", "jsonl": "table", "json": "json", "xml": "xml", "raw": "case", "txt": "text", "log": "text", "md": "text", "html": "page", "pdf": "page"}


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, name, bytes, changed, suffix, kind, state of the files below path: hidden, unsupported or supported. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    found = found.withColumn("suffix", suffix).withColumn("kind", F.coalesce(F.element_at(kinds, F.col("suffix")), F.lit("other")))
    return found.withColumn("state", F.when(F.col("name").startswith("."), "hidden").when(F.col("kind") == "other", "unsupported").otherwise("supported"))
