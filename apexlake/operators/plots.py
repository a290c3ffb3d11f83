"""The data of plots and reports: stacked components, brake points, heat map cells, Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.functions.text import issue_name
from apexlake.operators import issues, signal

#: What parts of a score are called, and unit, name and decimals of a metric.
COMPONENTS = {"comp_s": "Component Δs", "comp_v": "Component ΔVmin", "comp_sev": "Component Severity", "comp_freq": "Component Frequency"}
UNITS = {"d_delta_s": "(m)", "d_Ventry": "(m/s)", "d_Vmin": "(m/s)", "d_Vexit": "(m/s)", "d_a_long_peak": "(g)"}
NAMES = {"d_delta_s": "s", "d_Ventry": "Ventry", "d_Vmin": "Vmin", "d_Vexit": "Vexit", "d_a_long_peak": "a_long_peak"}
DECIMALS = {"d_delta_s": 1, "d_Ventry": 2, "d_Vmin": 2, "d_Vexit": 2, "d_a_long_peak": 2}
#: Columns of a table of issues, in order, and what stands for absent ones.
ISSUE_COLUMNS = {
    "turn": 0, "composite_score": 0.0, "score": 0.0, "stability_score": 0.0, "med_|d_delta_s|": 0.0, "med_|d_Vmin|": 0.0, "events_count": 0,
    "top_types": "", "sample_event_id": "", "comp_s": 0.0, "comp_v": 0.0, "comp_sev": 0.0, "comp_freq": 0.0,
}


def stacked(top: DataFrame) -> DataFrame:
    """(turn, component, label, value, bottom): the bars of top issues, each on those before it."""
    bars, bottom = [], F.lit(0.0)
    for name, label in COMPONENTS.items():
        bars.append(F.struct(F.lit(name).alias("component"), F.lit(label).alias("label"), F.col(name).alias("value"), bottom.alias("bottom")))
        bottom = bottom + F.col(name)
    return top.select("turn", F.explode(F.array(*bars)).alias("b")).select("turn", "b.*")


def brake_points(events: DataFrame, cards: DataFrame, points: DataFrame, order: str = "rn", keys: Sequence[str] = ("lap",)) -> DataFrame:
    """(lap, turn, delta_s_to_apex_m, x_apex, y_apex, x_brake, y_brake) of heavy brakes that have a card.

    Of several cards of a lap and turn the least counts; without an onset the apex stands for it. The samples
    nearest by arc length mark a place, those of the event's lap, or with keys=() of all laps; laps without samples get nulls.
    """
    first = cards.groupBy("lap", "turn").agg(F.min(F.struct("s_apex", "s_brake_onset")).alias("c"))
    rows = events.where("type = 'heavy_brake'").select("lap", "turn", "delta_s_to_apex_m").join(first, ["lap", "turn"])
    rows = rows.select("lap", "turn", "delta_s_to_apex_m", F.col("c.s_apex").alias("s_apex"), F.coalesce("c.s_brake_onset", "c.s_apex").alias("s_brake"))
    for target, name in (("s_apex", "apex"), ("s_brake", "brake")):
        rows = signal.nearest_points(points, rows, target, order, keys).withColumnsRenamed({"x": f"x_{name}", "y": f"y_{name}"})
    return rows.drop("s_apex", "s_brake")


def cells(report: DataFrame, metrics: Sequence[str] = ("d_delta_s", "d_Ventry", "d_Vmin", "d_a_long_peak"), least_coverage: float = 0.6, marked: int = 3) -> DataFrame:
    """(turn, place, metric, unit, value, shown, shown_raw, least_stable): the heat map of a stability report.

    Turns are in order of their stability score, those without one last. shown is the normalised value,
    shown_raw the raw one with the metric's decimals, N/A where coverage is too low. least_stable marks the
    turns with the ``marked`` largest values of the first metric.
    """
    columns = [f"{m}_iqr" for m in metrics]
    long = issues.heatmap(report, columns, least_coverage).join(issues.heatmap(report, columns, least_coverage, normalise=False).withColumnRenamed("value", "raw"), ["turn", "metric"])
    score = issues.stability_score(report)
    places = score.select("turn", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("stability_score"), "turn")).alias("place"))
    worst = long.where((F.col("metric") == columns[0]) & F.col("value").isNotNull()).join(places, "turn").orderBy(F.desc("value"), "place").limit(marked).select("turn", F.lit(True).alias("least_stable"))
    known = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for m in metrics for x in (m, table[m]))), F.col("metric"))
    rows = long.withColumn("metric", F.regexp_replace("metric", "_iqr$", "")).join(places, "turn").join(worst, "turn", "left")
    text = lambda c, digits: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", c))
    return rows.select(
        "turn", "place", known(NAMES).alias("metric"), known(UNITS).alias("unit"), "value", text("value", 2).alias("shown"),
        F.when(known(DECIMALS) == 1, text("raw", 1)).otherwise(text("raw", 2)).alias("shown_raw"), F.coalesce("least_stable", F.lit(False)).alias("least_stable"),
    )


def _kinds(limit: int | None = None) -> Column:
    kinds = F.filter(F.transform(F.split("top_types", ","), lambda t: F.trim(t)), lambda t: ~t.isin("", "-"))
    return F.slice(kinds, 1, limit) if limit else kinds


def turn_issues(top: DataFrame) -> DataFrame:
    """(turn, issues): the types of each turn's row with its score and events, a list of structs."""
    row = F.transform(_kinds(), lambda t: F.struct(t.alias("type"), F.col("score").alias("score"), F.col("events_count").alias("events_count")))
    return top.select("turn", F.explode(row).alias("i")).groupBy("turn").agg(F.array_sort(F.collect_list("i")).alias("issues"))


def advised(top: DataFrame, most: int = 2) -> DataFrame:
    """(turn, at, issue): the issues that advice is given on, of the first ``most`` types of each turn."""
    return top.select("turn", F.posexplode(_kinds(most)).alias("at", "type")).select("turn", "at", issue_name(F.col("type")).alias("issue")).where("issue is not null")


def payload(events: DataFrame, digits: int = 4) -> DataFrame:
    """(event_id, payload): what the rule found and the severity, as JSON with spaces after colons and commas, numbers in plain decimals."""
    plain = F.regexp_replace(F.regexp_replace(F.round("severity", digits).cast("decimal(38,10)").cast("string"), r"0+$", ""), r"\.$", ".0")
    return events.select("event_id", F.concat(F.regexp_replace("ref_flags", r"\}$", ""), F.lit(', "severity": '), plain, F.lit("}")).alias("payload"))


def trajectory(points: DataFrame, benchmark_lap: int | None = None, order: str = "rn") -> DataFrame:
    """(lap, place, x, y, v, benchmark): the track as driven, in order; benchmark marks the reference lap's line."""
    place = F.row_number().over(W.partitionBy("lap").orderBy("s", order))
    return points.where("x is not null and y is not null").select("lap", place.alias("place"), "x", "y", "v", F.coalesce(F.col("lap") == F.lit(benchmark_lap), F.lit(False)).alias("benchmark"))


def layout(points: DataFrame, apexes: DataFrame, lap: int | None = None, order: str = "rn") -> DataFrame:
    """(turn, s_apex, x, y, label): apexes on the line of one lap, or of all if it has no samples or none is named; labels T1, T2 ..."""
    own = points.where(F.col("lap") == lap) if lap is not None else points
    used = points if lap is not None and own.isEmpty() else own
    found = signal.nearest_points(used.withColumn("_row", F.struct("lap", order)), apexes.select("turn", "s_apex"), "s_apex", "_row")
    return found.withColumn("label", F.concat(F.lit("T"), F.col("turn").cast("string")))


def whole_issues(top: DataFrame) -> DataFrame:
    """Top issues with all of their columns in one order; absent ones hold 0 or an empty text, others follow."""
    known = [(F.col(f"`{c}`") if c in top.columns else F.lit(empty)).alias(c) for c, empty in ISSUE_COLUMNS.items()]
    return top.select(*known, *(f"`{c}`" for c in top.columns if c not in ISSUE_COLUMNS))
