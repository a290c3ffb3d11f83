"""Coaching and comparison reports in Markdown, for all sessions or tracks at once, as ordered folds of lines.

A report is one text, so its lines meet in one task; they are as many as its turns and sessions. Reports are spread over tasks
and written by them. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.functions import advice as texts
from apexlake.functions import text as labels
from apexlake.operators import compare, issues, ordered

Keys = Sequence[str]
#: Metrics shown of a turn's stability, with names and units.
METRICS = {"d_delta_s_iqr": ("Braking Distance IQR", "m"), "d_Vmin_iqr": ("Apex Speed IQR", "m/s"), "d_Ventry_iqr": ("Entry Speed IQR", "m/s"), "d_a_long_peak_iqr": ("Longitudinal Acceleration IQR", "g")}
#: What follows a priority.
ADVISED = {"Very High Priority": " (many issues and poor consistency, recommend prioritizing improvement)", "High Priority": " (needs focused attention)"}
#: Headings and lines of the reports.
COACHING = "# Intelligent Coaching Advice Report\nThis report is generated based on driving data analysis and knowledge base recommendations.\n\n---\n\n## Issue Count\n\n"
COMPARISON = "# Session Comparison Analysis Report\n\n"
SESSIONS = "## 📋 Session Comparison Table\n\n| Session Name | Date | Benchmark Lap | Lap Time | PB Status |\n|------------|------|--------|------|--------|\n"
LAPTIMES = "## ⏱️ Lap Time Comparison\n\n| Session | Lap Time | Relative to Fastest | PB Type |\n|---------|------|----------|--------|\n"
MEMORY = "### 📌 PB Memory Note\n\nThe following sessions used historical PB as analysis benchmark (because current PB did not exceed historical best):\n\n"
TURN = "| Session | Composite Score | Issue Score | Stability Score | Event Count |\n|---------|----------|----------|------------|--------|\n"
TREND = "### 🎯 Top Issues Trend\n\n| Turn | First Score | Last Score | Change | Trend |\n|------|----------|----------|------|------|\n"
HINT = "> 💡 Tip: Check `trend_*.png` charts for more detailed trend visualization\n\n"

_two = texts.two_digits
_text = lambda c: F.col(c).cast("string")
_opt = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")


def _line(rows: DataFrame, keys: Keys, section: int, text: Column, *order: Column) -> DataFrame:
    """(keys, section, a, b, text) of a report's lines; order: a number and a text at most."""
    a, b = [*order, F.lit(None), F.lit(None)][:2]
    return rows.select(*keys, F.lit(section).alias("section"), a.cast("double").alias("a"), b.cast("string").alias("b"), text.alias("text"))


def folded(lines: Sequence[DataFrame], keys: Keys) -> DataFrame:
    """(keys, text): the lines of each report one after the other, by section and order; null lines are left out."""
    rows = lines[0]
    for more in lines[1:]:
        rows = rows.unionByName(more)
    all_of = F.array_sort(F.collect_list(F.struct("section", "a", "b", "text")))
    return rows.where("text is not null").groupBy(*keys).agg(F.array_join(F.transform(all_of, lambda x: x["text"]), "").alias("text"))


def coaching(top: DataFrame, report: DataFrame | None = None, advice: DataFrame | None = None, keys: Keys = ("session",), shown: int = 5, sessions: DataFrame | None = None) -> DataFrame:
    """(keys, text): the coaching report of each session.

    top: (keys, turn, score, events_count, top_types and, where known, composite_score), a row for each turn, worst first by
    composite_score, else score, then turn. report: the stability report; advice: (keys, turn, issue, text), given on the first two issues
    of a turn. Counts of types are over all turns, equal ones in order of appearance. A session without issues says so if ``sessions``
    (keys) names it. Texts are repaired as a whole.
    """
    top = top if "composite_score" in top.columns else top.withColumn("composite_score", F.lit(None).cast("double"))
    score, composite = F.col("score"), F.col("composite_score")
    by = W.partitionBy(*keys).orderBy(F.desc_nulls_last(F.coalesce(composite, score)), "turn")
    top = ordered.kept(top.select(*keys, "turn", "score", "composite_score", "events_count", "top_types").withColumn("place", F.row_number().over(by)))
    every = (top if sessions is None else sessions).select(*keys).distinct()

    kinds = top.select(*keys, "place", F.posexplode(F.transform(F.split("top_types", ", "), lambda t: F.trim(t))).alias("i", "type")).where("type not in ('', '-')")
    counts = kinds.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "i")).alias("first"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    counted = counts.withColumn("nth", nth)
    table = F.concat(F.lit("| "), "type", F.lit(" | "), _text("n"), F.lit(" |\n"))
    none = every.select(*keys).join(counted.select(*keys).distinct(), list(keys), "left_anti")

    rows = top.where(F.col("place") <= shown)
    if report is None:
        rows = rows.withColumns({"known": F.lit(False), "rank": F.lit(None).cast("int"), "own": F.lit(None).cast("double"), "total": F.lit(None).cast("long")} | {m: F.lit(None).cast("double") for m in METRICS})
    else:
        ranked = issues.advice_rank(report, keys)
        own = ordered.looked_up(report.select(*keys, "turn", *METRICS), ranked.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(*keys))), (*keys, "turn"))
        rows = ordered.looked_up(rows, own.withColumn("known", F.lit(True)).withColumnRenamed("composite", "own"), (*keys, "turn")).withColumn("known", F.coalesce("known", F.lit(False)))
    if advice is None:
        rows = rows.withColumn("items", F.array().cast("array<struct<i: int, issue: string, text: string>>"))
    else:
        wanted = kinds.where(F.col("place") <= shown).withColumn("i", F.row_number().over(W.partitionBy(*keys, "place").orderBy("i"))).where("i <= 2")
        wanted = wanted.join(top.select(*keys, "place", "turn"), [*keys, "place"]).select(*keys, "turn", "i", labels.issue_name(F.col("type")).alias("issue"))
        said = advice.where("coalesce(text, '') <> ''").groupBy(*keys, "turn", "issue").agg(F.min("text").alias("text"))
        items = wanted.join(said, [*keys, "turn", "issue"]).groupBy(*keys, "turn").agg(F.array_sort(F.collect_list(F.struct("i", "issue", "text"))).alias("items"))
        rows = ordered.looked_up(rows, items, (*keys, "turn"))
    known, has = F.col("known"), composite.isNotNull()
    severity = labels.severity_label(F.coalesce("own", F.lit(0.0)))
    details = F.slice(F.array_compact(F.array(*(F.when(F.col(m).isNotNull(), F.concat(F.lit(f"| {n} | "), _two(F.col(m)), F.lit(f" {u} |\n"))) for m, (n, u) in METRICS.items()))), 1, 3)
    priority = labels.priority_label(F.coalesce(composite, score))
    words = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ADVISED.items() for x in pair)), priority), F.lit(""))
    several = F.size("items") > 1
    spoken = F.array_join(F.transform("items", lambda x: F.concat(_opt(several, F.lit("**"), x["issue"], F.lit(":**\n\n")), x["text"], F.lit("\n\n"))), "\n")
    section = F.concat(
        F.lit("### Turn "), _text("turn"), F.lit(" ("), _opt(has, F.lit("composite score: "), _two(composite), F.lit(", ")), F.lit("issue score: "), _two(score), _opt(known, F.lit(", stability: "), severity), F.lit(")\n\n"),
        F.lit("- **Event Count**: "), _text("events_count"), F.lit("\n- **Main Issues**: "), F.col("top_types"), F.lit("\n\n"),
        _opt(
            known, F.lit("#### Stability Metrics\n\n"), _opt(F.size(details) > 0, F.lit("| Metric | Value |\n|------|------|\n"), F.array_join(details, ""), F.lit("\n")),
            _opt(F.col("rank").isNotNull(), F.lit("- Stability ranking: "), _text("rank"), F.lit("/"), _text("total"), F.lit(" (higher rank = less stable)\n")),
            F.lit("- **Stability Assessment**: "), severity, F.lit("\n\n"),
            _opt(has, F.lit("- **Composite Score**: "), _two(composite), F.lit(" (issue score: "), _two(score), F.lit(" + stability score)\n")),
            F.lit("- **Overall Priority**: "), priority, words, F.lit("\n\n"),
        ),
        _opt(F.size("items") > 0, F.lit("**AI-Personalized Coaching Advice**\n\n"), spoken), F.lit("---\n\n"),
    )
    out = folded([
        _line(every, keys, 0, F.lit(COACHING)), _line(counted.where("nth = 1"), keys, 1, F.lit("| Issue Type | Count |\n|---------|---------|\n")), _line(counted, keys, 2, table, F.col("nth")),
        _line(none, keys, 2, F.lit("No issues detected.\n")), _line(every, keys, 3, F.lit("\n## Main Issue Analysis\n\n")), _line(rows, keys, 4, section, F.col("place")),
    ], keys)
    return out.withColumn("text", texts.repair(F.col("text")))


def comparison(sessions: DataFrame, scores: DataFrame, keys: Keys = ("track",), shown: int = 10, made: str | None = None) -> DataFrame:
    """(keys, text): the report that compares the sessions of each track.

    sessions: (keys, session, date, lap, laptime_s) and, where a kept best stood for the lap, old_lap, old_laptime_s, old_session, else null.
    scores: (keys, session, date, turn, composite_score, issue_score, stability_score, events_count), as compare.long_table() gives
    them. Sessions are in order of date and name; the ``shown`` lowest turns get a table. Issues are compared and trends given from
    two sessions on. A lap time of 0 or null is none. made: the time that the report names.
    """
    for c, kind in (("old_lap", "int"), ("old_laptime_s", "double"), ("old_session", "string")):
        sessions = sessions if c in sessions.columns else sessions.withColumn(c, F.lit(None).cast(kind))
    of = W.partitionBy(*keys)
    sessions = sessions.withColumns({"laptime_s": F.nullif("laptime_s", F.lit(0.0)), "place": F.row_number().over(of.orderBy("date", "session")), "several": F.count(F.lit(1)).over(of) > 1})
    sessions = ordered.kept(sessions.withColumn("fastest", F.min("laptime_s").over(of)))
    every = sessions.select(*keys).distinct()
    old, timed, place = F.col("old_lap").isNotNull(), F.col("laptime_s").isNotNull(), F.col("place")
    seconds = F.concat(_two(F.col("laptime_s")), F.lit("s"))
    status = F.when(old, "📌 Using Historical PB").when(timed, "✅ Current PB").otherwise("-")
    listed = F.concat(F.lit("| "), "session", F.lit(" | "), "date", F.lit(" | "), F.when(F.coalesce(F.col("lap"), F.lit(0)) != 0, F.concat(F.lit("Lap "), _text("lap"))).otherwise("N/A"), F.lit(" | "), F.coalesce(seconds, F.lit("N/A")), F.lit(" | "), status, F.lit(" |\n"))
    behind = F.col("laptime_s") - F.col("fastest")
    raced = F.concat(F.lit("| "), "session", F.lit(" | "), seconds, F.lit(" | "), F.when(behind > 0, F.concat(F.lit("+"), _two(behind), F.lit("s"))).otherwise("Fastest"), F.lit(" | "), F.when(old, "📌 Historical PB").otherwise("✅ Current PB"), F.lit(" |\n"))
    noted = F.concat(F.lit("- **"), "session", F.lit("** ("), "date", F.lit("): Current fastest Lap "), _text("lap"), F.lit(", "), seconds, F.lit(", but using historical PB Lap "), _text("old_lap"), F.lit(", "), _two(F.col("old_laptime_s")), F.lit("s (from "), "old_session", F.lit(")\n"))
    times, memory = sessions.where(timed), sessions.where(timed & old)
    one = lambda rows: rows.select(*keys).distinct()

    pairs = sessions.where("several").select(*keys, "session", "place")
    scores = ordered.looked_up(scores, pairs, (*keys, "session"), "inner")
    turns = ordered.kept(scores.withColumn("nth", F.dense_rank().over(of.orderBy("turn"))))
    own = turns.where(F.col("nth") <= shown)
    heads = own.select(*keys, "nth", "turn").distinct()
    cells = F.concat(F.lit("| "), "session", F.lit(" | "), *(x for c in ("composite_score", "issue_score", "stability_score") for x in (_two(F.col(c)), F.lit(" | "))), _text("events_count"), F.lit(" |\n"))
    span = own.groupBy(*keys, "nth").agg(F.min("composite_score").alias("low"), F.max("composite_score").alias("high"))
    better = F.concat(_opt(F.col("high") > F.col("low"), F.lit("\n**Improvement**: "), _two(F.col("high") - F.col("low")), F.lit(" (from "), _two(F.col("high")), F.lit(" to "), _two(F.col("low")), F.lit(")\n")), F.lit("\n---\n\n"))

    ends = times.where("several").groupBy(*keys).agg(F.min_by("laptime_s", "place").alias("first"), F.max_by("laptime_s", "place").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gain = F.col("first") - F.col("last")
    percent = F.when(F.col("first") > 0, gain / F.col("first") * 100).otherwise(0.0)
    lap_trend = F.concat(
        F.lit("### ⏱️ Lap Time Trend\n\n- **First**: "), _two(F.col("first")), F.lit("s\n- **Last**: "), _two(F.col("last")), F.lit("s\n- **Change**: "), texts.signed_text(gain, "s"),
        F.lit(" ("), F.call_function("format_number", percent, F.lit("+0.0;-0.0")), F.lit("%)"), F.lit("\n- **Trend**: "), compare.direction(gain), F.lit("\n\n"),
    )
    moved = turns.groupBy(*keys, "turn").agg(F.min_by("composite_score", "place").alias("first"), F.max_by("composite_score", "place").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    turn_trend = F.concat(F.lit("| Turn "), _text("turn"), F.lit(" | "), _two(F.col("first")), F.lit(" | "), _two(F.col("last")), F.lit(" | "), texts.signed_text(gain), F.lit(" | "), compare.direction(gain), F.lit(" |\n"))
    trends = one(ends).unionByName(one(moved)).distinct()
    return folded([
        _line(every, keys, 0, F.lit(COMPARISON + (f"**Generated Time**: {made}\n\n" if made else "") + "---\n\n" + SESSIONS)), _line(sessions, keys, 1, listed, place), _line(every, keys, 2, F.lit("\n---\n\n")),
        _line(one(times), keys, 3, F.lit(LAPTIMES)), _line(times, keys, 4, raced, place), _line(one(times), keys, 5, F.lit("\n---\n\n")),
        _line(one(memory), keys, 6, F.lit(MEMORY)), _line(memory, keys, 7, noted, place), _line(one(memory), keys, 8, F.lit("\n---\n\n")),
        _line(one(turns), keys, 9, F.lit("## 🎯 Top Issues Comparison\n\n")),
        _line(heads, keys, 10, F.concat(F.lit("### Turn "), _text("turn"), F.lit("\n\n" + TURN)), F.col("nth"), F.lit("a")),
        _line(own, keys, 10, cells, F.col("nth"), F.format_string("b%012d", place)), _line(span, keys, 10, better, F.col("nth"), F.lit("c")),
        _line(trends, keys, 11, F.lit("## 📈 Trend Analysis\n\n")), _line(ends, keys, 12, lap_trend), _line(one(moved), keys, 13, F.lit(TREND)), _line(moved, keys, 14, turn_trend, F.col("turn")),
        _line(one(moved), keys, 15, F.lit("\n")), _line(trends, keys, 16, F.lit(HINT)),
    ], keys)


#: Headings and tables of the summary of events.
TYPES = "# Events Summary\n\n## Table 1: Global Event Type Counts\n\n| Type | Count |\n| --- | --- |\n"
HOTSPOTS = "\n## Table 2: Top 10 Hotspots by Turn\n\n| Turn | Events | Top Types | Max Severity |\n| --- | --- | --- | --- |\n"
PARTS = "\n## Table 3: Top Issues Component Breakdown\n\n| Turn | Score | Comp_s | Comp_v | Comp_sev | Comp_freq |\n| --- | --- | --- | --- | --- | --- |\n"


def event_summary(events: DataFrame, turns: DataFrame, top: DataFrame, sessions: DataFrame, keys: Keys = ("session",), hottest: int = 10) -> DataFrame:
    """(keys, text): of each session the counts of event types, the ``hottest`` turns and the parts of its top issues.

    turns: as issues.by_turn() gives them; sessions: (keys) of all that get a summary, empty tables where they have no rows.
    """
    every = sessions.select(*keys).distinct()
    without = lambda rows: every.join(rows.select(*keys).distinct(), list(keys), "left_anti")
    cells = lambda *columns: F.concat(F.lit("| "), *(x for i, c in enumerate(columns) for x in ([F.lit(" | ")] if i else []) + [c]), F.lit(" |\n"))
    counts = events.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))
    hot = turns.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("events_count"), "turn"))).where(F.col("place") <= hottest)
    turn = F.concat(F.lit("T"), _text("turn"))
    parts = ("score", "comp_s", "comp_v", "comp_sev", "comp_freq")
    worst = top.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "turn")))
    return folded([
        _line(every, keys, 0, F.lit(TYPES)), _line(counts, keys, 1, cells(F.col("type"), _text("n")), -F.col("n"), F.col("type")), _line(without(counts), keys, 1, F.lit("| (None) | 0 |\n")),
        _line(every, keys, 2, F.lit(HOTSPOTS)), _line(hot, keys, 3, cells(turn, _text("events_count"), F.when(F.coalesce("top_types", F.lit("")) == "", "-").otherwise(F.col("top_types")), _two(F.col("max_severity"))), F.col("place")), _line(without(hot), keys, 3, F.lit("| - | 0 | - | 0.0 |\n")),
        _line(every, keys, 4, F.lit(PARTS)), _line(worst, keys, 5, cells(turn, *(_two(F.col(c)) for c in parts)), F.col("place")), _line(without(worst), keys, 5, F.lit("| - | 0.0 | 0.0 | 0.0 | 0.0 | 0.0 |\n")),
    ], keys)


def radar(scores: DataFrame, keys: Keys = ("track",), most: int = 8) -> DataFrame:
    """(keys, turn, first_score, last_score, angle): the spokes of the radar chart, turns of both the first and the last session, the lowest ``most``."""
    of = W.partitionBy(*keys)
    rows = scores.withColumns({"_a": F.min("date").over(of), "_b": F.max("date").over(of)})
    rows = rows.groupBy(*keys, "turn").agg(F.max(F.when(F.col("date") == F.col("_a"), F.col("composite_score"))).alias("first_score"), F.max(F.when(F.col("date") == F.col("_b"), F.col("composite_score"))).alias("last_score"))
    rows = rows.where("first_score is not null and last_score is not null").withColumn("i", F.row_number().over(of.orderBy("turn"))).where(F.col("i") <= most)
    return rows.withColumn("angle", (F.col("i") - 1) * (6.283185307179586 / F.count(F.lit(1)).over(of))).drop("i")


def write(reports: DataFrame, path: str, keys: Keys) -> None:
    """A text file for each report, in a folder named by its keys, written by the tasks that hold them."""
    reports.repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)
