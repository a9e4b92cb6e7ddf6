"""Documents: JSON leaves, text of web pages, passages and the state of a library's files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.names import heading
from casewright.operators.network import settle



def _opened(now: DataFrame, key: str) -> DataFrame:
    """key, path, value of the leaves below variants v, level by level: as deep as the deepest document goes, a job a level."""
    leaves = None
    while True:
        kind = "schema_of_variant(v)"
        held = settle(now.withColumn("_kind", F.expr(f"CASE WHEN {kind} LIKE 'OBJECT%' THEN 'o' WHEN {kind} LIKE 'ARRAY%' THEN 'a' END")).select(key, "path", "_kind", F.to_json("v").alias("_json"), F.expr("CASE WHEN _kind IS NULL THEN CAST(v AS string) END").alias("value")))
        here = held.where("_kind IS NULL").select(key, "path", "value")
        leaves = here if leaves is None else leaves.union(here)
        inner = held.where("_kind IS NOT NULL").withColumn("v", F.parse_json("_json"))
        if inner.isEmpty():
            return leaves
        parts = F.expr("""CASE WHEN _kind = 'o' THEN transform(map_entries(CAST(v AS map<string,variant>)), e -> named_struct('path', concat(path, '.', e.key), 'v', e.value))
          ELSE transform(CAST(v AS array<variant>), (x, i) -> named_struct('path', concat(path, '[', i, ']'), 'v', x)) END""")
        now = inner.select(key, F.explode(parts).alias("e")).select(key, "e.path", "e.v")


def json_leaves(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value: a row for each value that is neither an object nor an array. Text that isn't JSON has none."""
    return _opened(docs.select(key, F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL"), key)


def xml_leaves(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value: a row for each attribute (@name) and text of an XML document; repeated siblings are numbered from 1."""
    found = _opened(docs.select(key, F.lit("").alias("path"), F.expr(f"from_xml({text}, 'variant')").alias("v")).where("v IS NOT NULL"), key)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\._VALUE$", ""), r"\._([^.\[]+)$", ".@$1"), r"^\.", "")
    numbered = F.expr(r"aggregate(regexp_extract_all(p, '([^\\[]+)(?:\\[(\\d+)\\])?', 0), '', (a, x) -> concat(a, CASE WHEN x RLIKE '\\[' THEN concat(substring_index(x, '[', 1), '[', int(regexp_extract(x, '\\[(\\d+)', 1)) + 1, ']') ELSE x END))")
    return found.select(key, path.alias("p"), "value").select(key, numbered.alias("path"), "value").where("value IS NOT NULL")


#: What a page's text loses or turns into, in this order.
_PAGE = (
    (r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"(?is)<title\b.*?</title>", ""), (r"(?s)<!--.*?-->", ""),
    (r"(?i)<h[1-6]\b[^>]*>", "\n# "), (r"(?i)</?(p|div|li|tr|br|h[1-6]|ul|ol|table|section|article)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t\r]+", " "), (r" ?\n ?", "\n"), (r"\n\n+", "\n"),
)
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def html_text(html: Column) -> Column:
    """The page's text: headings begin with #, blocks are lines, scripts and styles are gone."""
    return F.trim(reduce(lambda x, step: F.regexp_replace(x, *step), _PAGE, F.coalesce(html, F.lit(""))), F.lit(" \n"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), _TITLE, 1))


def _html_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = reduce(lambda x, step: f"regexp_replace({x}, {quoted(step[0])}, {quoted(step[1])}, 'g')", _PAGE, "coalesce(html, '')")
    return f"SELECT page_id, trim(regexp_extract(coalesce(html, ''), {quoted(_TITLE)}, 1)) AS title, trim({text}, concat(' ', chr(10))) AS text FROM pages"


HTML_SQL = _html_sql()

#: A passage ends before a heading once it has LEAST characters, and before a line that would take it beyond MOST.
LEAST, MOST = 200, 1200


def passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, passage (from 1), section, body. Each document is folded over its own lines. A passage's section is the latest heading
    before its first line of text."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda l: F.struct(F.rtrim(l).alias("l"), heading(l).alias("h")))
    state = "named_struct('done', {done}, 'open', {open}, 'size', {size}, 'section', {section}, 'start', {start}, 'only', {only})"
    empty = "cast(array() AS array<struct<section:string,body:string>>)"
    closed = "array_append(a.done, named_struct('section', a.start, 'body', a.open))"
    now = "CASE WHEN x.h <> '' THEN x.h ELSE a.section END"
    # cut at a heading: the passage so far keeps its section; cut for length: the next one starts in the section of now
    cut = f"(a.open IS NOT NULL AND ((x.h <> '' AND a.size >= {LEAST}) OR a.size + length(x.l) > {MOST}))"
    fold = f"""aggregate(_lines, {state.format(done=empty, open="cast(NULL AS string)", size="0", section="''", start="''", only="true")},
      (a, x) -> CASE WHEN {cut} THEN {state.format(done=closed, open="x.l", size="length(x.l) + 1", section=now, start=now, only="(trim(x.l) = '' OR x.h <> '')")}
        ELSE {state.format(done="a.done", open="CASE WHEN a.open IS NULL THEN x.l ELSE concat(a.open, chr(10), x.l) END", size="a.size + length(x.l) + 1", section=now,
          start="CASE WHEN x.h <> '' AND a.only THEN x.h ELSE a.start END", only="a.only AND (trim(x.l) = '' OR x.h <> '')")} END,
      a -> filter(array_append(a.done, named_struct('section', a.start, 'body', a.open)), p -> trim(BOTH concat(' ', chr(10), chr(9), chr(13)) FROM p.body) <> ''))"""
    found = docs.select(key, lines.alias("_lines")).select(key, F.posexplode(F.expr(fold)).alias("at", "p"))
    return found.select(key, (F.col("at") + 1).alias("passage"), "p.section", F.trim(F.col("p.body"), F.lit(" \n\t\r")).alias("body"))


def refresh(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """file, state. found: file, text, bytes, time; recorded: file, bytes, time, sha.

    A file whose size and time are as recorded is unchanged; otherwise its contents are hashed and decide.
    """
    r = recorded.select(F.col("file").alias("_file"), F.col("bytes").alias("_bytes"), F.col("time").alias("_time"), "sha")
    both = found.join(r, found["file"] == r["_file"], "full")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("time") == F.col("_time"))
    state = F.when(F.col("file").isNull(), "removed").when(F.col("_file").isNull(), "new").when(same, "unchanged").when(F.sha2("text", 256) == F.col("sha"), "unchanged").otherwise("changed")
    return both.select(F.coalesce("file", "_file").alias("file"), state.alias("state"))
