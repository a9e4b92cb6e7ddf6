"""The solver's whitespace-separated text tables: a schema for each by its file's name, typed rows, and rejected lines by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tables' lines; a name is a number with decimals unless it says otherwise.
_BUS, _GENERATOR, _BRANCH = "row_index:int bus_id:int", "row_index:int bus_id:int generator_id:string", "row_index:int from_bus:int to_bus:int line_id:string"
_AVERAGES = "average rms_average rms_base"
_EXTREMES, _CASES = "base_value min_value max_value min_deviation max_deviation", "min_contingency:int max_contingency:int"
SCHEMAS = {
    "vmag": f"{_BUS} {_AVERAGES}", "vang": f"{_BUS} {_AVERAGES}", "vmag_mm": f"{_BUS} {_EXTREMES} {_CASES}", "vang_mm": f"{_BUS} {_EXTREMES} {_CASES}",
    "pgen": f"{_GENERATOR} {_AVERAGES}", "qgen": f"{_GENERATOR} {_AVERAGES}", "pgen_mm": f"{_GENERATOR} {_EXTREMES} {_CASES}", "qgen_mm": f"{_GENERATOR} {_EXTREMES} {_CASES}",
    "pflow": f"{_BRANCH} {_AVERAGES}", "qflow": f"{_BRANCH} {_AVERAGES}", "pflow_mm": f"{_BRANCH} {_EXTREMES} min_allowable max_allowable {_CASES}", "qflow_mm": f"{_BRANCH} {_EXTREMES} min_allowable max_allowable {_CASES}",
    "perf_mm": f"{_BRANCH} {_EXTREMES} {_CASES}", "perf_sum": "contingency_index:int performance_index_sum performance_index_average",
    "line_flt_cnt": f"{_BRANCH} fault_count:int", "pq_change_cnt": "row_index:int bus_id:int pq_change_count:int",
}
_TYPES = {"int": "bigint", "string": "string", "": "double"}


def columns(name: str) -> list[tuple[str, str]]:
    """(column, Spark type) of a table."""
    return [(c.partition(":")[0], _TYPES[c.partition(":")[2]]) for c in SCHEMAS[name].split(" ")]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """name, cells: the lines that aren't blank of all files below path whose name is a table's; name is the table."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z_]+)\.txt(?:/[^/]*)?$", 1)
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(name.alias("name"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("cells"))
    return rows.where(F.col("name").isin(*SCHEMAS)).where("cells[0] <> ''")


def _typed(i: int, kind: str) -> Column:
    cell = F.get("cells", F.lit(i))
    return cell if kind == "string" else cell.try_cast(kind)


def _fits(name: str) -> tuple[Column, Column]:
    """Whether a line has the table's number of cells, and whether all of them read as their types."""
    read = F.lit(True)
    for i, (_, kind) in enumerate(columns(name)):
        read = read & _typed(i, kind).isNotNull()
    return F.size("cells") == len(columns(name)), read


def table(rows: DataFrame, name: str) -> DataFrame:
    """The typed rows of one table; lines that don't fit its schema are left out."""
    wide, read = _fits(name)
    return rows.where(F.col("name") == name).where(wide & read).select(*(_typed(i, kind).alias(c) for i, (c, kind) in enumerate(columns(name))))


def rejects(rows: DataFrame) -> DataFrame:
    """name, accepted, wrong_width, unreadable of every table, in one pass."""
    reason = F.lit(None).cast("string")
    for name in SCHEMAS:
        wide, read = _fits(name)
        reason = F.when(F.col("name") == name, F.when(~wide, "width").when(~read, "value").otherwise("accepted")).otherwise(reason)
    said = rows.select("name", reason.alias("reason"))
    return said.groupBy("name").agg(*(F.count_if(F.col("reason") == r).alias(c) for r, c in (("accepted", "accepted"), ("width", "wrong_width"), ("value", "unreadable"))))
