"""Column expressions: labels, lenient casts, classes and case metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper edges of the half-open voltage bands in kV, and their names.
VOLTAGE_BANDS = ((50.0, "<50 kV"), (100.0, "50-99 kV"), (230.0, "100-229 kV"), (345.0, "230-344 kV"), (500.0, "345-499 kV"))
TOP_BAND, UNKNOWN = "500+ kV", "unknown"
#: Words that a search ignores.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with")
KEY = ("from_bus", "to_bus", "line_id", "section")


def canonical_label(x: Column) -> Column:
    """Trim, strip quotes, trim again and collapse spaces; letters, digits and leading zeros stay."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")), r"\s+", " ")


def lenient_int(x: Column) -> Column:
    """Whole part of a number's text ('1.0' is 1), null for anything else or what isn't finite."""
    return lenient_double(x).try_cast("bigint")


def lenient_double(x: Column) -> Column:
    value = F.trim(x).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


#: Words that stand for yes and no.
YES, NO = ("true", "1", "yes", "y", "ok", "converged"), ("false", "0", "no", "n", "failed", "diverged")


def lenient_bool(x: Column) -> Column:
    text = F.lower(F.trim(x))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


#: Names of the base case once everything but letters and digits is an underscore.
BASE_NAMES = ("base", "base_case", "basecase")


def base_case(event: Column, name: Column) -> Column:
    """Whether a case is the base case: event 0, or one of its names in any spelling."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    # few names hold the word at all; only those are taken apart
    return F.coalesce(event == 0, F.lit(False)) | (F.coalesce(F.lower(name).contains("base"), F.lit(False)) & F.coalesce(key.isin(*BASE_NAMES), F.lit(False)))


def voltage_class(kv: Column) -> Column:
    out = F.when(kv.isNull(), UNKNOWN)
    for edge, name in VOLTAGE_BANDS:
        out = out.when(kv < edge, name)
    return out.otherwise(TOP_BAND)


def transformer_step(from_kv: Column, to_kv: Column) -> Column:
    """unknown, same (at most 0.5 kV apart), up or down."""
    return F.when(from_kv.isNull() | to_kv.isNull(), UNKNOWN).when(F.abs(from_kv - to_kv) <= 0.5, "same").when(to_kv > from_kv, "up").otherwise("down")


def facility_label(a: Column, b: Column, circuit: Column, section: Column) -> Column:
    return F.concat(a, F.lit(" to "), b, F.lit(" ("), F.concat_ws("/", circuit, F.when(section != "", section)), F.lit(")"))


def case_key() -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in KEY))


def case_metrics() -> dict[str, Column]:
    """Computed metrics of a case: size of the loading, lower end voltage (a missing end is skipped), angle difference."""
    return {"abs_loading": F.abs("loading_percent"), "low_voltage": F.least("v_from_pu", "v_to_pu"), "angle_difference": F.abs(F.col("ang_from_deg") - F.col("ang_to_deg"))}


def percent_of_rating(flow: Column, rating: Column, reported: Column | None = None) -> Column:
    own = F.when(rating > 0, flow / rating * 100)
    return own if reported is None else F.coalesce(reported, own)


#: Names of outages of an element between two buses, and at one bus.
OUTAGE_TWO, OUTAGE_ONE = r"(?i)^\s*(?:BR|BRANCH|LINE|XF|TR)_(\d+)_(\d+)(?:_|\s*$)", r"(?i)^\s*(?:GN|GEN|G|LOAD|LD)_(\d+)(?:_|\s*$)"


def outage_buses(name: Column) -> Column:
    """Buses that a contingency name (BR_from_to_circuit, GN_bus_id and the like) takes out."""
    branch = F.array(F.regexp_extract(name, OUTAGE_TWO, 1), F.regexp_extract(name, OUTAGE_TWO, 2))
    return F.transform(F.when(name.rlike(OUTAGE_TWO), branch).when(name.rlike(OUTAGE_ONE), F.array(F.regexp_extract(name, OUTAGE_ONE, 1))).otherwise(F.array()), lambda x: x.cast("int"))


def end_area_label(area: Column, name: Column, shared: Column) -> Column:
    """name (id) where several areas share the name, else the name, else the id."""
    clean = F.nullif(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), F.lit(""))
    return F.coalesce(F.when(shared & area.isNotNull(), F.concat(clean, F.lit(" ("), area.cast("string"), F.lit(")"))), clean, area.cast("string"))


def tie_flag(areas: Column) -> Column:
    """Whether a facility's ends lie in two known areas."""
    return F.size(F.array_distinct(F.filter(areas, lambda x: x.isNotNull() & (x != "") & (x != UNKNOWN)))) > 1


def utilization_group(branch_type: Column, from_kv: Column, to_kv: Column, stored: Column) -> Column:
    """Step group of a transformer, voltage class of the higher end of a line, else the stored class."""
    own = voltage_class(F.greatest(from_kv, to_kv))
    return F.when(branch_type.contains("_winding_transformer"), transformer_step(from_kv, to_kv)).when(own != UNKNOWN, own).otherwise(F.coalesce(F.nullif(stored, F.lit("")), F.lit(UNKNOWN)))


def truthy(x: Column) -> Column:
    """A lenient boolean; other text counts if it is a number that isn't zero."""
    return F.coalesce(lenient_bool(x), F.coalesce(lenient_double(x), F.lit(0.0)) != 0)


def search_tokens(text: Column) -> Column:
    """Lower-case tokens joined by . - or /, and the parts of joined ones, without stop words."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[.\-/][a-z0-9]+)*)"), 1)
    parts = F.flatten(F.transform(F.filter(whole, lambda x: x.rlike(r"[.\-/]")), lambda x: F.split(x, r"[.\-/]")))
    return F.filter(F.concat(whole, parts), lambda x: ~x.isin(*STOP_WORDS))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
