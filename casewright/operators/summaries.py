"""Reductions of cases: by facility, by contingency, by any group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from casewright.functions import columns as C
from casewright.functions.columns import KEY
from casewright.operators import quantiles
from casewright.operators.network import settle
from casewright.operators.ranking import running_sum

THERMAL = 100.0


def usable(cases: DataFrame, convergence: DataFrame) -> DataFrame:
    """Cases of contingencies that converged; contingencies that aren't listed stay. The failed ones are one row an event."""
    failed = convergence.where(F.lower("converged") == "false").select("event_idx").distinct()
    return cases.join(failed, "event_idx", "left_anti")


#: Rows of extremes that are broadcast to the cases; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def _known(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _violated(cases: DataFrame) -> Column:
    """Whether viol reads as true; a number needs no reading."""
    number = isinstance(cases.schema["viol"].dataType, NumericType)
    return F.coalesce(F.col("viol") != 0, F.lit(False)) if number else C.truthy(F.col("viol").cast("string"))


def branch_summary(cases: DataFrame) -> DataFrame:
    """One row a facility. Sums and extremes are plain numbers, so a pass of hash aggregation finds them; a second pass looks at the cases that
    reach an extreme or hold the first rating, a few a facility, for their events and names.

    Of equal extremes the case with the smallest event, then name, stands for them. The rating is the first known one in that order. The base
    loading is the largest of the base cases'. A violation is anything that reads as true, or a loading of 100 % or more."""
    v, size, e = F.col("loading_percent"), F.abs("loading_percent"), F.coalesce(F.col("event_idx").cast("long"), F.lit((1 << 63) - 1))
    rows = cases.where("loading_percent IS NOT NULL AND from_bus IS NOT NULL AND to_bus IS NOT NULL AND line_id <> ''")
    sums = settle(rows.groupBy(*C.KEY).agg(F.count("*").alias("case_count"), (F.sum(v.cast("decimal(18,5)")).cast("double") / F.count("*")).alias("mean_loading"), F.min(v).alias("min_loading"), F.max(v).alias("max_loading"), F.max(size).alias("max_abs_loading"),
        F.max(F.when(C.base_case(F.col("event_idx"), F.col("contingency")), v)).alias("base_loading"), F.count_if(_violated(cases) | (v >= THERMAL)).alias("overload_count"), F.count_if(size >= THERMAL).alias("thermal_count"), F.min(F.when(F.col("rate_mva").isNotNull(), e)).alias("_rated")))
    ends = _known(sums.select(*C.KEY, "min_loading", "max_loading", "max_abs_loading", "_rated"))
    low, high, far, rated = v == F.col("min_loading"), v == F.col("max_loading"), size == F.col("max_abs_loading"), F.col("rate_mva").isNotNull() & (e == F.col("_rated"))
    met = rows.select(*C.KEY, "event_idx", "contingency", "loading_percent", "rate_mva").join(ends, list(C.KEY)).where(low | high | far | rated)
    order = F.struct(e.alias("e"), "contingency")
    at = met.groupBy(*C.KEY).agg(F.min_by("event_idx", F.when(low, order)).alias("min_event"), F.min_by("event_idx", F.when(high, order)).alias("max_event"), F.min_by("event_idx", F.when(far, order)).alias("binding_event"),
        F.min_by("contingency", F.when(far, order)).alias("binding_contingency"), F.min_by("rate_mva", F.when(rated, F.struct(e.alias("e"), "contingency", "rate_mva"))).alias("rate_mva"))
    return sums.join(at, list(C.KEY)).select(*C.KEY, "case_count", "mean_loading", "min_loading", "max_loading", "max_abs_loading", "base_loading", "overload_count", "thermal_count", "rate_mva", "binding_contingency", "min_event", "max_event", "binding_event",
        (F.col("min_loading") - F.col("base_loading")).alias("min_deviation"), (F.col("max_loading") - F.col("base_loading")).alias("max_deviation"))


def contingency_summary(cases: DataFrame) -> DataFrame:
    """One row a contingency: facilities, violations, largest size of loading, thermal overloads, and the worst facility (of equal ones the smallest key).
    Two passes, as in branch_summary()."""
    size, keys = F.abs("loading_percent"), ["event_idx", "contingency"]
    sums = settle(cases.groupBy(*keys).agg(F.count("*").alias("facilities"), F.count_if(F.col("viol") == 1).alias("violations"), F.max(size).alias("max_abs_loading"), F.count_if(size >= THERMAL).alias("thermal_count")))
    ends = _known(sums.select(F.col("event_idx").alias("_e"), F.col("contingency").alias("_c"), "max_abs_loading"))
    worst = cases.select(*keys, *C.KEY, size.alias("size")).join(ends, F.expr("event_idx <=> _e AND contingency <=> _c AND size = max_abs_loading"))
    named = worst.groupBy("_e", "_c").agg(F.min(F.struct(*C.KEY)).alias("k")).select("_e", "_c", F.concat_ws("|", *(F.col(f"k.{c}").cast("string") for c in C.KEY)).alias("worst_facility"))
    return sums.join(named, F.expr("event_idx <=> _e AND contingency <=> _c"), "left").drop("_e", "_c")


def running_branches(cases: DataFrame) -> DataFrame:
    """branch_summary() in one pass, as a stream needs it; its state holds structures, so a batch of this form sorts its rows.

    Of equal extremes the case with the smallest event, then name, stands for them. The rating is the first known one in that order. The base
    loading is the largest of the base cases'. A violation is anything that reads as true, or a loading of 100 % or more."""
    v, size = F.col("loading_percent"), F.abs("loading_percent")
    at = F.struct(F.col("event_idx"), F.col("contingency"))
    base = F.max(F.when(C.base_case(F.col("event_idx"), F.col("contingency")), v))
    low, high, far = (F.min_by(at, F.struct(x.alias("x"), F.col("event_idx").isNull().alias("none"), "event_idx", "contingency")) for x in (v, -v, -size))
    found = cases.where("loading_percent IS NOT NULL AND from_bus IS NOT NULL AND to_bus IS NOT NULL AND line_id <> ''").groupBy(*C.KEY).agg(
        F.count("*").alias("case_count"), (F.sum(v.cast("decimal(18,5)")).cast("double") / F.count("*")).alias("mean_loading"),
        F.min(v).alias("min_loading"), F.max(v).alias("max_loading"), F.max(size).alias("max_abs_loading"), base.alias("base_loading"),
        F.count_if(_violated(cases) | (v >= THERMAL)).alias("overload_count"), F.count_if(size >= THERMAL).alias("thermal_count"),
        F.min_by("rate_mva", F.when(F.col("rate_mva").isNotNull(), F.struct(F.col("event_idx").isNull().alias("none"), "event_idx", "contingency", "rate_mva"))).alias("rate_mva"),
        low.alias("low"), high.alias("high"), far.alias("far"))
    return found.select(*C.KEY, "case_count", "mean_loading", "min_loading", "max_loading", "max_abs_loading", "base_loading", "overload_count", "thermal_count", "rate_mva", F.col("far.contingency").alias("binding_contingency"),
        F.col("low.event_idx").alias("min_event"), F.col("high.event_idx").alias("max_event"), F.col("far.event_idx").alias("binding_event"),
        (F.col("min_loading") - F.col("base_loading")).alias("min_deviation"), (F.col("max_loading") - F.col("base_loading")).alias("max_deviation"))


def running_contingencies(cases: DataFrame) -> DataFrame:
    """contingency_summary() in one pass, as a stream needs it."""
    size = F.abs("loading_percent")
    return cases.groupBy("event_idx", "contingency").agg(
        F.count("*").alias("facilities"), F.count_if(F.col("viol") == 1).alias("violations"), F.max(size).alias("max_abs_loading"),
        F.count_if(size >= THERMAL).alias("thermal_count"),
        F.min_by(F.concat_ws("|", *(F.col(c).cast("string") for c in KEY)), F.struct(-size, *KEY)).alias("worst_facility"))


def by_group(df: DataFrame, group: str, value: Column) -> DataFrame:
    """label and the nine statistics; unknown values drop out. Groups of unknown values only aren't returned."""
    labelled = df.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("label"), value.alias("_value"))
    return quantiles.statistics(labelled, ["label"], F.col("_value")).drop("q")


def distributions(df: DataFrame, variables: list[str], metrics: list[str]) -> DataFrame:
    """variable, label, metric and count, mean, quartiles and range of each metric by each variable's labels; null labels and values drop out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("label"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for v in variables for m in metrics))).alias("x")
    groups = ["variable", "label", "metric"]
    out = quantiles.statistics(df.select(pairs).select("x.*").where("label IS NOT NULL"), groups, F.col("value"))
    return out.select(*groups, "n", "mean", F.col("q")[0].alias("q1"), "median", F.col("q")[2].alias("q3"), "low", "high")


def interface_flow(cases: DataFrame, buses: DataFrame, one: int, other: int) -> DataFrame:
    """Signed flow from area one to the other for each contingency. Bus areas are a dimension table; Spark broadcasts it if small."""
    areas = buses.select(F.col("bus_id"), F.col("area"))
    f, t = areas.toDF("from_bus", "from_area"), areas.toDF("to_bus", "to_area")
    ties = cases.join(f, "from_bus").join(t, "to_bus")
    sign = F.when((F.col("from_area") == one) & (F.col("to_area") == other), 1).when((F.col("from_area") == other) & (F.col("to_area") == one), -1)
    return ties.where(sign.isNotNull()).groupBy("event_idx").agg(F.sum((sign * F.col("p_from_mw")).cast("decimal(18,6)")).cast("double").alias("flow_mw"))


def quantile_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Right-closed bins at the quantiles, the lowest edge included, equal edges merged. The edges are one row."""
    counts = quantiles.counted(df, [], F.col(value))
    edges = quantiles.select(counts, [], tuple(i / bins for i in range(bins + 1))).select(F.array_distinct("q").alias("edges"))
    placed = counts.join(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.expr("size(filter(edges, e -> e < _v))")))
    return placed.groupBy("bin").agg(F.sum("_c").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of non-negative values. Equal values are counted first, so the ordered pass sees distinct values."""
    v = df.where(f"{value} >= 0").groupBy(F.col(value).cast("decimal(18,5)").alias("v")).count()
    ranked = running_sum(v, ["v"], "count", "upto")
    return ranked.agg(F.round(F.expr("2 * sum(v * count * (upto - (count - 1) / 2)) / (sum(count) * sum(v * count)) - (sum(count) + 1) / sum(count)").cast("double"), 6).alias("gini"))


def success_totals(log: DataFrame) -> DataFrame:
    """violation (null for all together), total, success, failure, unknown, success_rate_pct, failure_rate_pct, isolated of a success log
    (success, violation, isolated)."""
    said = log.select(F.coalesce("violation", F.lit("none")).alias("violation"), "success", F.coalesce("isolated", F.lit(False)).alias("isolated"))
    found = said.groupingSets([["violation"], []], "violation").agg(F.count("*").alias("total"), F.count_if(F.col("success")).alias("success"), F.count_if(~F.col("success")).alias("failure"), F.count_if(F.col("isolated")).alias("isolated"))
    rate = lambda c: F.round(F.col(c) * 100 / F.nullif(F.col("total"), F.lit(0)), 4)
    return found.select("violation", "total", "success", "failure", (F.col("total") - F.col("success") - F.col("failure")).alias("unknown"), rate("success").alias("success_rate_pct"), rate("failure").alias("failure_rate_pct"), "isolated")


def voltage_extremes(cases: DataFrame, low: float, high: float, worst: int = 10) -> DataFrame:
    """side (low or high), rank, bus, value of the buses with the lowest and highest voltages, with how many buses there are (buses) and how many lie beyond
    the limit (beyond). Each case gives a value for both its ends; each side is a bounded heap a task."""
    ends = cases.select(F.explode(F.array(F.struct(F.col("from_bus").alias("bus"), F.col("v_from_pu").alias("v")), F.struct(F.col("to_bus").alias("bus"), F.col("v_to_pu").alias("v")))).alias("x")).select("x.*").where("v IS NOT NULL")
    per = settle(ends.groupBy("bus").agg(F.min("v").alias("low"), F.max("v").alias("high")))
    counts = per.agg(F.count("*").alias("buses"), F.count_if(F.col("low") < low).alias("n_low"), F.count_if(F.col("high") > high).alias("n_high"))
    first = lambda side, order: per.orderBy(order, "bus").limit(worst).select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, "bus")).alias("rank"), "bus", F.col(side).alias("value"))
    rows = first("low", F.asc("low")).union(first("high", F.desc("high")))
    return rows.join(F.broadcast(counts)).select("side", "rank", "bus", "value", "buses", F.when(F.col("side") == "low", F.col("n_low")).otherwise(F.col("n_high")).alias("beyond"))


def flow_extremes(flows: DataFrame) -> DataFrame:
    """One row of an interface's flows (event_idx, flow_mw): base, minimum and maximum, with their events; ties go to the smaller event."""
    at = lambda order: F.min_by("event_idx", F.struct(order.alias("x"), "event_idx"))
    v = F.col("flow_mw")
    return flows.agg(F.max(F.when(F.col("event_idx") == 0, v)).alias("base_mw"), F.min(v).alias("min_mw"), at(v).alias("min_event"), F.max(v).alias("max_mw"), at(-v).alias("max_event"), F.count("*").alias("events"))
