"""Comparison over sessions: pivots, trends, step changes, personal bests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pivot(scores: DataFrame, sessions: list) -> DataFrame:
    """A row per turn and a column per session."""
    return scores.groupBy("turn").pivot("session", sessions).agg(F.first("score"))


def direction(change: F.Column) -> F.Column:
    """improved, worsened or stable: less is better."""
    return F.when(change > 0, "improved").when(change < 0, "worsened").otherwise("stable")


def trend(times: DataFrame) -> DataFrame:
    """(first_s, last_s, improvement_s, improvement_pct, trend, slope, intercept) of lap times by date order."""
    numbered = times.withColumn("i", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("date")) - 1).cast("double"))
    out = numbered.agg(F.min_by("laptime_s", "date").alias("first_s"), F.max_by("laptime_s", "date").alias("last_s"), F.regr_slope("laptime_s", "i").alias("slope"), F.regr_intercept("laptime_s", "i").alias("intercept"))
    out = out.withColumn("improvement_s", F.col("first_s") - F.col("last_s"))
    percent = F.when(F.col("first_s") > 0, F.col("improvement_s") / F.col("first_s") * 100).otherwise(0.0)
    return out.withColumns({"improvement_pct": percent, "trend": direction(F.col("improvement_s"))})


def step_changes(rows: DataFrame, value: str, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """+ change to the date before, and whether it is larger than ``least``."""
    change = F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy("date"))
    return rows.withColumn("change", change).withColumn("marked", F.coalesce(F.abs("change") > least, F.lit(False)))


def common_turns(scores: DataFrame, most: int = 8) -> DataFrame:
    """Turns of both the first and the last session, the lowest ``most``."""
    ends = scores.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    rows = scores.crossJoin(F.broadcast(ends))
    return rows.where("date = a").select("turn").intersect(rows.where("date = b").select("turn")).orderBy("turn").limit(most)


def first_last(scores: DataFrame) -> DataFrame:
    """(turn, first_score, last_score, change, trend, spread) of turns with two sessions or more."""
    out = scores.groupBy("turn").agg(F.min_by("score", "date").alias("first_score"), F.max_by("score", "date").alias("last_score"), (F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("n"))
    out = out.where("n >= 2").withColumn("change", F.col("first_score") - F.col("last_score"))
    return out.withColumn("trend", direction(F.col("change"))).drop("n")


def long_table(sessions: DataFrame) -> DataFrame:
    """(session, date, turn, composite_score, issue_score, stability_score, events_count): top issues of all sessions.

    Without a column composite_score the issue score stands for it; what is absent or null is 0. A single
    session has nothing to compare with: no rows.
    """
    def number(*names: str, kind: str = "double") -> F.Column:
        own = [c for c in names if c in sessions.columns][:1]
        return F.coalesce(*(F.col(c).cast(kind) for c in own), F.lit(0).cast(kind))

    several = sessions.agg((F.min("session") < F.max("session")).alias("_several"))
    rows = sessions.crossJoin(F.broadcast(several)).where("_several")
    return rows.select("session", "date", "turn", number("composite_score", "score").alias("composite_score"), number("score").alias("issue_score"), number("stability_score").alias("stability_score"), number("events_count", kind="long").alias("events_count"))


def improvements(scores: DataFrame) -> DataFrame:
    """first_last() + improvement_pct, the change in per cent of the first score."""
    percent = F.when(F.col("first_score") > 0, F.col("change") / F.col("first_score") * 100).otherwise(0.0)
    return first_last(scores).withColumn("improvement_pct", percent)


def largest(scores: DataFrame, k: int) -> DataFrame:
    """(turn, mean): the k turns with the highest mean score over sessions; ties by turn."""
    return scores.groupBy("turn").agg(F.avg("score").alias("mean")).orderBy(F.desc("mean"), "turn").limit(k)


def timed(sessions: DataFrame) -> DataFrame:
    """Sessions that have a lap time other than 0."""
    return sessions.where("laptime_s is not null and laptime_s <> 0")


def personal_bests(times: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Laps that were strictly faster than all before them; the first always is."""
    before = F.min("laptime_s").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return times.withColumn("before", before).where(F.col("before").isNull() | (F.col("laptime_s") < F.col("before")))
