"""Text helpers: speed units, labels, squeezing, report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def speed_unit(name: str, most: float | None = None) -> str:
    """Unit of a speed column by its name; else ms if its largest value is below 50, or unknown, taken as ms."""
    low = name.lower()
    if "mph" in low:
        return "mph"
    if "kmh" in low or "km/h" in low:
        return "kmh"
    if "mps" in low or "m/s" in low or (most is not None and most < 50):
        return "ms"
    return "unknown"


def to_ms(speed: Column, unit: str) -> Column:
    return {"kmh": speed / 3.6, "mph": speed * 0.44704}.get(unit, speed)


def squeeze(text: Column) -> Column:
    """At most one empty line in a row, one space in a row, none around."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), " {2,}", " "))


def severity_label(score: Column) -> Column:
    """How consistent a turn is driven, by its normalised stability score."""
    return F.when(score >= 0.8, "Very Poor").when(score >= 0.6, "Poor").when(score >= 0.4, "Average").otherwise("Good")


def priority_label(composite: Column) -> Column:
    """How urgent a turn is, by its composite issue score."""
    return F.when(composite >= 25, "Very High Priority").when(composite >= 20, "High Priority").when(composite >= 15, "Medium Priority").otherwise("Lower Priority")


#: What each event type is called in reports.
ISSUES = {
    "conservative_entry": "Conservative Entry / Overslowing",
    "late_brake": "Late Braking / Missed Apex",
    "weak_exit": "Weak Corner Exit",
    "overslow": "Conservative Entry / Overslowing",
    "heavy_brake": "Late Braking / Missed Apex",
    "early_brake": "Conservative Entry / Overslowing",
}


def issue_name(kind: Column) -> Column:
    """The issue of an event type; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ISSUES.items() for x in pair)), kind)


def issue_counts(issues: DataFrame) -> DataFrame:
    """(type, n) over comma lists of event types; empty ones and "-" are skipped."""
    return issues.select(F.explode(F.split("top_types", ", ")).alias("type")).where("type not in ('', '-')").groupBy("type").agg(F.count("*").alias("n"))
