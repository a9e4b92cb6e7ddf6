"""Names, cells and keys compared as a reader of case tables means them; headings; amounts written for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stored name may be cut at so many characters, or before a mark such as ~1.
CUT, MARK = 12, r"~\d+(?=\s|$)"
#: Patterns of a line that begins a section, tried in this order; the first also matches lines of any length.
REQUIREMENT = r"^([RM]\d+(?:\.\d+)*)\.?(?:\s+[A-Z(].*)?$"
HEADINGS = (
    r"^#{1,6}\s+(.{1,100})$",
    r"^([A-H]\.\s+[A-Z][A-Za-z,&/ -]{2,70})$",
    r"^((?:Attachment|Appendix|Table|Section|Part|Chapter|Exhibit)\s+[0-9A-Z]+(?:\.\d+)*\b[^.;]{0,80})$",
    r"^(\d+(?:\.\d+){0,4}\.?\s+[A-Z][^.;,]{1,80})$",
)
LONGEST_HEADING = 120


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normal_name(x: Column) -> Column:
    """Without case, punctuation and marks of a cut name."""
    return _spaced(F.regexp_replace(F.regexp_replace(F.lower(_text(x)), MARK, ""), r"[^\p{L}\p{N}_]+", " "))


def match_class(query: Column, value: Column) -> Column:
    """exact, prefix or fuzzy, or null. Fuzzy: the query runs past a name that was cut, or each of its words begins a word of
    the name; it needs three characters of query."""
    wanted, name, stored = normal_name(query), normal_name(value), F.trim(_text(value))
    cut = stored.contains("~") | (F.length(stored) >= CUT)
    words = F.forall(F.split(wanted, " "), lambda t: F.exists(F.split(name, " "), lambda w: w.startswith(t)))
    return (F.when((wanted == "") | (name == ""), None).when((stored == F.trim(_text(query))) | (name == wanted), "exact")
        .when(name.startswith(wanted), "prefix").when((F.length(wanted) >= 3) & ((cut & wanted.startswith(name)) | words), "fuzzy"))


#: The order of match classes.
CLASSES = ("exact", "prefix", "fuzzy")


def best_matches(table: DataFrame, queries: DataFrame, column: str) -> DataFrame:
    """query, the table's columns, match and place: matches of each query, best class first. Up to LISTED queries meet every name; more of them
    are joined by what a match must share: the first letter of one of the query's words with that of one of the name's."""
    asked, hit = queries.select("query").distinct(), match_class(F.col("query"), F.col(column)).isNotNull()
    if asked.count() <= LISTED:
        found = table.join(F.broadcast(asked), hit)
    else:
        letters = lambda c: F.explode(F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != ""), lambda w: F.left(w, F.lit(1)))))
        keyed = table.withColumn("_row", F.monotonically_increasing_id())
        pairs = keyed.select("*", letters(F.col(column)).alias("_letter")).join(asked.select("query", letters(F.col("query")).alias("_letter")), "_letter").where(hit)
        found = pairs.dropDuplicates(["_row", "query"]).drop("_row", "_letter")
    found = found.withColumn("match", match_class(F.col("query"), F.col(column)))
    return found.withColumn("place", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("match")).cast("int"))


LISTED = 1000


def number(x: Column) -> Column:
    out = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def join_key(x: Column) -> Column:
    """Whole numbers as whole text, other numbers as they are, text without case and extra spaces: '1.0', 1 and ' 1' are equal."""
    n = number(x)
    return F.coalesce(F.when(n == F.floor(n), n.try_cast("bigint").cast("string")), n.cast("string"), F.lower(_spaced(_text(x))))


#: The operators of a filter.
OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in", "contains", "startswith", "matches")


def passes(cell: Column, operator: str, value) -> Column:
    """A filter on one cell: numbers if both sides are, else text without case."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}; choose from {', '.join(OPERATORS)}")
    if operator == "matches":
        return match_class(F.lit(str(value)), cell).isNotNull()
    if operator == "in":
        return F.exists(F.array(*(passes(cell, "==", v) for v in value)), lambda x: x)
    text, wanted = F.lower(F.trim(_text(cell))), str("" if value is None else value).strip().lower()
    if operator == "contains":
        return text.contains(wanted)
    if operator == "startswith":
        return text.startswith(wanted)
    compare = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[operator]
    as_text = compare(text, F.lit(wanted))
    try:
        right = float(wanted)
    except ValueError:
        return as_text
    left = number(cell)
    return F.when(left.isNotNull(), compare(left, F.lit(right))).otherwise(as_text)


def filtered(df: DataFrame, filters: list[tuple[str, str, object]], columns: list[str] | None = None) -> DataFrame:
    """Rows that pass all filters (column, operator, value), with the chosen columns. Unknown columns are refused by name."""
    missing = [c for c in [*(f[0] for f in filters), *(columns or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    for column, operator, value in filters:
        df = df.where(passes(F.col(column), operator, value))
    return df.select(*columns) if columns else df


def in_area(areas: Column, wanted: str) -> Column:
    """Whether one of the areas (names or ids of either end) is the wanted one, without case."""
    return F.exists(areas, lambda x: F.lower(F.trim(x.cast("string"))) == wanted.strip().lower())


def heading(line: Column) -> Column:
    """The section a line begins, or an empty string."""
    text = _spaced(line)
    found = F.regexp_extract(text, REQUIREMENT, 1)
    short = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in HEADINGS), F.lit(""))
    return F.when(found != "", found).when(F.length(text) <= LONGEST_HEADING, short).otherwise("")


def duration(seconds: Column) -> Column:
    """3 h 4 min, 3 min 12 s, 4.2 s or 19 ms; unknown for null."""
    s = F.bround(seconds).cast("long")
    return (F.when(seconds.isNull(), "unknown").when(seconds < 1, F.concat(F.format_number(seconds * 1000, 0), F.lit(" ms"))).when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit(" s")))
        .when(s < 3600, F.format_string("%d min %d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s / 60) % 60)))


def tokens(used: dict[str, Column]) -> dict[str, Column]:
    """Counts of input, output, cache_read, cache_write, prompt and total; what is missing is 0, a missing or zero total is the sum."""
    count = {k: F.coalesce(used[k].cast("long"), F.lit(0)) if k in used else F.lit(0).cast("long") for k in ("input", "output", "cache_read", "cache_write")}
    prompt = count["input"] + count["cache_read"] + count["cache_write"]
    total = F.nullif(used["total"].cast("long"), F.lit(0).cast("long")) if "total" in used else F.lit(None).cast("long")
    return count | {"prompt": prompt, "total": F.coalesce(total, prompt + count["output"])}
