"""The registered queries over reports, sessions and plot data, and their SQL (after the common tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexlake.functions import advice
from apexlake.operators import compare, issues, laps, ordered, plots, reporting
from apexlake.plans.adapters import _read, cards, tel, xy
from apexlake.sources import reports, sessions

rounded = lambda df: df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
#: Issues that stand for those of coaching reports, by role.
_ISSUE = "concat('Issue of ', role)"


def _shared(spark: SparkSession) -> str:
    return f"{ordered.shared_folder(spark)}/reports-{uuid.uuid4().hex}"


def _advice(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown reports, a report for each and a section for each turn, parsed again."""
    rows = _read(spark, d, "conversations").withColumn("issue", F.expr(_ISSUE))
    part = F.concat(F.lit("### Turn "), F.col("turn").cast("string"), F.lit("\n\nWords before.\n\n**AI-Personalized Coaching Advice**\n\n**Analysis:**\n\nNone.\n\n**"), "issue", F.lit(":**\n\n"), "text", F.lit("\n\n---\n\n"))
    whole = rows.groupBy(F.col("conv_id").alias("report")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("content"))
    return reports.advice(whole)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as lines of JSON with texts in one of three fields, some lines broken."""
    rows = _read(spark, d, "conversations")
    line = F.to_json(F.struct(
        F.when(F.col("conv_id") % 7 != 0, F.col("turn")).alias("turn"), F.expr(_ISSUE).alias("issue_name"),
        F.when(F.col("conv_id") % 3 == 0, F.array("text", F.lit("more"))).alias("gold_content"), F.when(F.col("conv_id") % 3 == 1, F.col("text")).alias("reference"),
        F.array("role", F.lit("words")).alias("gold_sections"),
    ))
    return reports.references(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), F.when(F.col("conv_id") % 11 == 0, F.expr("'{broken'")).otherwise(line).alias("value")))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return reports.matched(_advice(spark, d), _gold(spark, d)).select("report", "turn", "issue", F.length("text").alias("generated_len"), F.length("reference").alias("reference_len"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three sessions, written to a store and read again."""
    root, rows = _shared(spark), cards(spark, d).groupBy((F.col("lap") % 3).alias("s"), "turn").agg(F.round(F.avg("Ventry"), 6).alias("score"))
    for s in range(3):
        sessions.save(rows.where(F.col("s") == s).select("turn", "score"), root, "top_issues", str(s), f"2024-01-0{s + 1}")
    return sessions.load(spark, root, "top_issues")


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Lap times on three tracks, a session for each lap."""
    times = laps.lap_times(tel(spark, d))
    return times.select(F.concat(F.lit("track "), F.col("lap") % 3).alias("track"), "lap", "laptime_s", F.concat(F.lit("session "), F.col("lap")).alias("session"), F.format_string("2024-01-%02d", F.col("lap") + 1).alias("date"))


def _bests(spark: SparkSession, d: str) -> str:
    """Folder of bests kept over three calls, the last of which repeats all laps."""
    root, times = _shared(spark), ordered.kept(_tracks(spark, d))
    for own in (times.where("lap < 4"), times.where("lap >= 4"), times):
        sessions.update_bests(own, root)
    return root


def _session_cards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cards of three sessions with differences, and the lap each is compared with."""
    rows = ordered.kept(cards(spark, d).withColumn("session", (F.col("lap") % 3).cast("int")))
    best = rows.groupBy("session").agg(F.min("lap").alias("lap"))
    return ordered.kept(issues.deltas(rows, best, ("session",))), best


def _coaching(spark: SparkSession, d: str) -> DataFrame:
    """Coaching reports of three sessions, with conversations as advice."""
    key = ("session",)
    rows, best = _session_cards(spark, d)
    report = ordered.kept(issues.stability(rows, best, key))
    scored = issues.scores(issues.turn_stats(report, issues.relative_events(rows, best, key), key), key)
    top = issues.top_issues(issues.composite(scored, issues.stability_score(report, key), keys=key), 6, key)
    said = _read(spark, d, "conversations").where("conv_id < 30").select((F.col("conv_id") % 3).cast("int").alias("session"), (F.col("turn") + 1).cast("int").alias("turn"), F.when(F.col("role") == "user", "Late Braking / Missed Apex").otherwise("Conservative Entry / Overslowing").alias("issue"), F.regexp_extract("text", "^[A-Za-z ]+", 0).alias("text"))
    return reporting.coaching(top, report, said, key, sessions=best.select("session").unionByName(spark.range(9, 10).select(F.col("id").cast("int").alias("session"))))


def _tracked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sessions of three tracks with lap times, some of them kept bests, and the scores of their turns."""
    times = _tracks(spark, d).withColumn("laptime_s", F.when(F.col("lap") != 5, F.round(F.col("laptime_s") / 1000, 3)))
    kept = F.col("lap") % 4 == 1
    own = times.withColumns({"old_lap": F.when(kept, F.col("lap") + 50), "old_laptime_s": F.when(kept, F.lit(80.25)), "old_session": F.when(kept, F.lit("earlier"))})
    rows = cards(spark, d).where("lap < 12").select(F.concat(F.lit("track "), F.col("lap") % 3).alias("track"), F.concat(F.lit("session "), "lap").alias("session"), F.format_string("2024-01-%02d", F.col("lap") + 1).alias("date"), "turn", F.round(F.coalesce("Ventry", F.lit(0.0)), 6).alias("composite_score"), F.round(F.coalesce("Vmin", F.lit(0.0)), 6).alias("issue_score"), F.lit(0.125).alias("stability_score"), F.col("turn").alias("events_count"))
    return own, ordered.kept(rows)


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    return reporting.comparison(*_tracked(spark, d), shown=4)


def _listing(spark: SparkSession, d: str) -> DataFrame:
    root, times = _shared(spark), ordered.kept(_tracks(spark, d))
    own = ordered.kept(cards(spark, d))
    for s in ("track 0", "track 1"):
        sessions.save(times.where(F.col("track") == s), root, "benchmark_lap", s, "2024-01-01")
    sessions.save_deltas(own, issues.deltas(own, 1), root, "track 1", "2024-01-02")
    return sessions.listing(spark, root)


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a lap of an earlier session, out of a store of three."""
    root, rows = _shared(spark), ordered.kept(cards(spark, d))
    sessions.save_all(rows.withColumn("session", F.concat(F.lit("s"), F.col("lap") % 3)), root, "corner_cards", "2024-01-01")
    return rounded(sessions.history(spark, root, "s2", 5))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the events of three sessions."""
    key = ("session",)
    rows, best = _session_cards(spark, d)
    events = ordered.kept(issues.relative_events(rows, best, key))
    top = issues.scores(issues.turn_stats(issues.stability(rows, best, key), events, key), key)
    return reporting.event_summary(events, issues.by_turn(events, key), top, best, key, hottest=5)


def _formed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as advice in other forms, brought into one."""
    raw = F.concat(F.lit("2. analysis:\nHere the driver is late; Driver has time.\n3. Recommendation :\na. "), F.regexp_extract("text", "^[A-Za-z ]+", 0), F.lit("\n  7. again\nEnd here\nb. no item\n\n\n\n\n4. Implementation: later\nmore\n\nlast"))
    return _read(spark, d, "conversations").select("conv_id", "turn", advice.one_format(raw).alias("text"))


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    times = laps.lap_times(tel(spark, d)).select(F.col("lap").cast("string").alias("session"), "lap", "laptime_s")
    best = times.where("lap % 4 <> 3").withColumns({"lap": F.col("lap") + 100, "laptime_s": F.col("laptime_s") + (F.col("lap") % 2) - 0.5})
    return sessions.benchmark(times.withColumn("mode", F.lit("fastest")), best)


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return ordered.kept(issues.deltas(ordered.kept(cards(spark, d)), 1))


def _top(spark: SparkSession, d: str) -> DataFrame:
    rows = _deltas(spark, d)
    return issues.scores(issues.turn_stats(issues.stability(rows, 1), issues.relative_events(rows, 1)))


def _brakes(spark: SparkSession, d: str) -> DataFrame:
    own = ordered.kept(cards(spark, d))
    arc = laps.arc_length(xy(spark, d)).select("lap", "rn", F.round("s", 4).alias("s"), "x", "y")
    return plots.brake_points(issues.absolute_events(own), own, arc)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).groupBy((F.col("lap") % 3).cast("string").alias("date"), "turn").agg(F.round(F.avg("Ventry"), 6).alias("score"))


QUERIES = {
    "text_repair": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", advice.repair(F.col("text")).alias("text")),
    "line_kinds": lambda s, d: advice.line_kinds(_read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.expr("concat(case when turn % 4 = 0 then '## 🎯 ' when turn % 4 = 1 then '- **x** ' else '' end, text, '\n\n| a | b |\n|---|---|\n---')").alias("text")), "k").select("k", "at", "kind", F.length("content").alias("n")),
    "report_advice": lambda s, d: _advice(s, d),
    "gold_references": lambda s, d: _gold(s, d),
    "gold_match": _matched,
    "eval_means": lambda s, d: reports.means(_matched(s, d).withColumn("score", F.lit(None).cast("double")), "issue", ("generated_len", "reference_len"), ("score",)),
    "best_laps": lambda s, d: rounded(sessions.current_bests(s, _bests(s, d))),
    "best_history": lambda s, d: rounded(sessions.best_history(s, _bests(s, d))),
    "lap_complete_rows": lambda s, d: laps.drop_incomplete(xy(s, d)).groupBy("lap").agg(F.count("*").alias("n")),
    "lap_long_rows": lambda s, d: laps.long_enough(xy(s, d), 850).groupBy("lap").agg(F.count("*").alias("n")),
    "history_cards": _history,
    "timed_sessions": lambda s, d: rounded(compare.timed(_tracked(s, d)[0].select("track", "session", "laptime_s"))),
    "event_payloads": lambda s, d: plots.payload(issues.relative_events(_deltas(s, d), 1)),
    "event_summaries": _summaries,
    "advice_format": _formed,
    "track_layout": lambda s, d: plots.layout(laps.arc_length(xy(s, d)).withColumn("s", F.round("s", 4)), s.sql("SELECT CAST(id + 1 AS INT) AS turn, 97e0 + 270e0 * id AS s_apex FROM range(11)"), 3),
    "trajectory": lambda s, d: plots.trajectory(laps.arc_length(xy(s, d)).withColumn("s", F.round("s", 4)), 4),
    "coaching_report": _coaching,
    "comparison_report": _comparison,
    "radar": lambda s, d: rounded(reporting.radar(_tracked(s, d)[1])),
    "store_listing": _listing,
    "session_store": lambda s, d: rounded(compare.long_table(_stored(s, d))),
    "benchmark_choice": lambda s, d: rounded(_benchmark(s, d)),
    "best_lap_text": lambda s, d: laps.lap_times(tel(s, d)).select("lap", advice.best_lap_text(F.when(F.col("lap") % 3 > 0, F.col("lap")), F.round("laptime_s", 1), F.lit("S"), F.lit("2024-01-01")).alias("text")),
    "stacked_components": lambda s, d: rounded(plots.stacked(_top(s, d))),
    "brake_points": lambda s, d: rounded(_brakes(s, d)),
    "heatmap_cells": lambda s, d: plots.cells(ordered.kept(issues.stability(_deltas(s, d), 1))).select("turn", "place", "metric", "unit", F.round("value", 6).alias("value"), "least_stable"),
    "advised_issues": lambda s, d: plots.advised(_top(s, d)),
    "turn_issues": lambda s, d: plots.turn_issues(_top(s, d)).select("turn", F.array_join("issues.type", ",").alias("types"), F.size("issues").alias("n")),
    "improvements": lambda s, d: rounded(compare.improvements(_scores(s, d))),
    "largest_turns": lambda s, d: rounded(compare.largest(_scores(s, d), 5)),
}

_LATIN = "try(decode(unhex(list_aggregate(list_transform(string_split(text, ''), lambda c: printf('%02x', CASE WHEN ord(c) < 256 THEN ord(c) ELSE 63 END)), 'string_agg', ''))))"
_ISSUES = "'Issue of ' || role"
_SEEN = "trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_REFS = f"""refs AS (SELECT turn, {_ISSUES} AS issue, CASE WHEN conv_id % 3 = 0 THEN text || chr(10) || chr(10) || 'more' WHEN conv_id % 3 = 1 THEN text ELSE role || ' words' END AS reference, conv_id * 1000 + turn AS rid
  FROM conversations WHERE conv_id % 7 <> 0 AND conv_id % 11 <> 0)"""
_PAIRS = f"""{_REFS}, mt AS (SELECT conv_id AS report, turn, issue, length({_SEEN}) AS generated_len, length(reference) AS reference_len
  FROM (SELECT *, {_ISSUES} AS issue FROM conversations) c JOIN (SELECT turn, issue, arg_min(reference, rid) AS reference FROM refs GROUP BY ALL) r USING (turn, issue) WHERE {_SEEN} <> '')"""
_S3 = "sg AS (SELECT CAST(lap % 3 AS VARCHAR) AS date, turn, ROUND(AVG(Ventry), 6) AS score FROM cards GROUP BY ALL)"
_ARC = """arc AS (SELECT lap, rn, x, y, ROUND(SUM(COALESCE(SQRT(dx * dx + dy * dy), 0e0)) OVER (PARTITION BY lap ORDER BY rn ROWS UNBOUNDED PRECEDING), 4) AS s
  FROM (SELECT *, x - LAG(x) OVER (PARTITION BY lap ORDER BY rn) AS dx, y - LAG(y) OVER (PARTITION BY lap ORDER BY rn) AS dy FROM xy) z)"""
_HEAT = "hm AS (" + " UNION ALL ".join(f"SELECT turn, {i} AS i, '{n}' AS metric, '{u}' AS unit, CASE WHEN lap_count / (SELECT COUNT(DISTINCT lap) FROM dl WHERE lap <> 1) >= 0.6 THEN d_{c}_iqr END AS raw FROM st" for i, (c, n, u) in enumerate((("delta_s", "s", "(m)"), ("Ventry", "Ventry", "(m/s)"), ("Vmin", "Vmin", "(m/s)"), ("a_long_peak", "a_long_peak", "(g)")))) + ")"
_KINDS = "list_filter(list_transform(string_split(top_types, ','), lambda t: trim(t)), lambda t: t NOT IN ('', '-'))"

#: Laps by track, and those that no earlier one was as fast as.
_BESTS = """br AS (SELECT 'track ' || lap % 3 AS track, lap, laptime_s, 'session ' || lap AS session, printf('2024-01-%02d', lap + 1) AS date FROM lt),
  bl AS (SELECT * FROM br WHERE laptime_s > 0 AND laptime_s < COALESCE((SELECT MIN(o.laptime_s) FROM br o WHERE o.track = br.track AND o.date < br.date AND o.laptime_s > 0), 'inf'::DOUBLE))"""

_LF = "chr(10)"
_q = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_p2 = lambda x: f"printf('%.2f', {x})"
_sign = lambda x, d=2: f"printf('%+.{d}f', {x})"
_way = lambda x: f"CASE WHEN {x} > 0 THEN 'improved' WHEN {x} < 0 THEN 'worsened' ELSE 'stable' END"
#: Sessions of three tracks, and their scores.
_TRACKED = """sn AS (SELECT 'track ' || lap % 3 AS track, 'session ' || lap AS session, printf('2024-01-%02d', lap + 1) AS date, lap, NULLIF(CASE WHEN lap <> 5 THEN ROUND(laptime_s / 1000, 3) END, 0) AS t, lap % 4 = 1 AS old FROM lt),
  sco AS (SELECT 'track ' || lap % 3 AS track, 'session ' || lap AS session, printf('2024-01-%02d', lap + 1) AS date, turn, ROUND(COALESCE(Ventry, 0e0), 6) AS c, ROUND(COALESCE(Vmin, 0e0), 6) AS i, turn AS n FROM cards WHERE lap < 12)"""
_COMPARISON = f""", {_TRACKED}, f AS (SELECT track, MIN(t) AS f FROM sn GROUP BY track),
  l1 AS (SELECT track, string_agg('| ' || session || ' | ' || date || ' | ' || CASE WHEN lap <> 0 THEN 'Lap ' || lap ELSE 'N/A' END || ' | ' || COALESCE({_p2('t')} || 's', 'N/A') || ' | ' || CASE WHEN old THEN '📌 Using Historical PB' WHEN t IS NOT NULL THEN '✅ Current PB' ELSE '-' END || ' |' || {_LF}, '' ORDER BY date, session) AS x FROM sn GROUP BY track),
  l2 AS (SELECT track, string_agg('| ' || session || ' | ' || {_p2('t')} || 's | ' || CASE WHEN t > f THEN '+' || {_p2('t - f')} || 's' ELSE 'Fastest' END || ' | ' || CASE WHEN old THEN '📌 Historical PB' ELSE '✅ Current PB' END || ' |' || {_LF}, '' ORDER BY date, session) AS x FROM sn JOIN f USING (track) WHERE t IS NOT NULL GROUP BY track),
  l3 AS (SELECT track, {_q(reporting.MEMORY)} || string_agg('- **' || session || '** (' || date || '): Current fastest Lap ' || lap || ', ' || {_p2('t')} || 's, but using historical PB Lap ' || (lap + 50) || ', 80.25s (from earlier)' || {_LF}, '' ORDER BY date, session) || {_q(chr(10) + '---' + chr(10) * 2)} AS x FROM sn WHERE old AND t IS NOT NULL GROUP BY track),
  m1 AS (SELECT track, turn, {_q('### Turn ')} || turn || {_q(chr(10) * 2 + reporting.TURN)} || string_agg('| ' || session || ' | ' || {_p2('c')} || ' | ' || {_p2('i')} || ' | ' || {_p2('0.125e0')} || ' | ' || n || ' |' || {_LF}, '' ORDER BY date, session)
    || CASE WHEN MAX(c) > MIN(c) THEN {_q(chr(10) + '**Improvement**: ')} || {_p2('MAX(c) - MIN(c)')} || ' (from ' || {_p2('MAX(c)')} || ' to ' || {_p2('MIN(c)')} || ')' || {_LF} ELSE '' END || {_q(chr(10) + '---' + chr(10) * 2)} AS x FROM sco GROUP BY track, turn),
  m2 AS (SELECT track, string_agg(x, '' ORDER BY turn) AS x FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY turn) AS k FROM m1) z WHERE k <= 4 GROUP BY track),
  e1 AS (SELECT track, arg_min(t, date) AS a, arg_max(t, date) AS b FROM sn WHERE t IS NOT NULL GROUP BY track),
  e2 AS (SELECT track, string_agg('| Turn ' || turn || ' | ' || {_p2('a')} || ' | ' || {_p2('b')} || ' | ' || {_sign('a - b')} || ' | ' || {_way('a - b')} || ' |' || {_LF}, '' ORDER BY turn) AS x FROM (SELECT track, turn, arg_min(c, date) AS a, arg_max(c, date) AS b FROM sco GROUP BY track, turn) z GROUP BY track)
  SELECT track, {_q(reporting.COMPARISON + '---' + chr(10) * 2 + reporting.SESSIONS)} || l1.x || {_q(chr(10) + '---' + chr(10) * 2 + reporting.LAPTIMES)} || l2.x || {_q(chr(10) + '---' + chr(10) * 2)} || COALESCE(l3.x, '') || {_q('## 🎯 Top Issues Comparison' + chr(10) * 2)} || m2.x
    || {_q('## 📈 Trend Analysis' + chr(10) * 2 + '### ⏱️ Lap Time Trend' + chr(10) * 2 + '- **First**: ')} || {_p2('a')} || {_q('s' + chr(10) + '- **Last**: ')} || {_p2('b')} || {_q('s' + chr(10) + '- **Change**: ')} || {_sign('a - b')} || 's (' || {_sign('(a - b) / a * 100', 1)} || {_q('%)' + chr(10) + '- **Trend**: ')} || {_way('a - b')}
    || {_q(chr(10) * 2 + reporting.TREND)} || e2.x || {_q(chr(10) + reporting.HINT)} AS text
  FROM l1 JOIN l2 USING (track) LEFT JOIN l3 USING (track) JOIN m2 USING (track) JOIN e1 USING (track) JOIN e2 USING (track)"""
_SEV = lambda x: f"CASE WHEN {x} >= 8e-1 THEN 'Very Poor' WHEN {x} >= 6e-1 THEN 'Poor' WHEN {x} >= 4e-1 THEN 'Average' ELSE 'Good' END"


def coaching_sql(common: str) -> str:
    """The coaching reports of three sessions: what each has of scores and spreads, then text. common: the common tables' definitions."""
    own = " UNION ALL ".join(f"""SELECT {s} AS session, * FROM (WITH {common.replace('FROM lineitem GROUP BY', f'FROM lineitem WHERE l_suppkey % 3 = {s} GROUP BY').replace('lap = 1)', f'lap = {s})').replace('lap <> 1', f'lap <> {s}')}
      SELECT st.turn, composite_score AS cs, score, events_count AS n, top_types, {', '.join(reporting.METRICS)}, row_number() OVER (ORDER BY composite_score DESC, st.turn) AS place FROM co JOIN st USING (turn)) q{s}""" for s in range(3))
    shown = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN '| {n} | ' || {_p2(m)} || ' {u} |' || {_LF} END" for m, (n, u) in reporting.METRICS.items())
    return f"""WITH w AS ({own}), rk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY raw DESC, turn) AS rank, COUNT(*) OVER (PARTITION BY session) AS total, raw / MAX(raw) OVER (PARTITION BY session) AS own FROM (SELECT *,
        COALESCE(5e-1 * d_delta_s_iqr, 0e0) + COALESCE(3e-1 * d_Vmin_iqr, 0e0) + COALESCE(1e-1 * d_Ventry_iqr, 0e0) + COALESCE(1e-1 * d_a_long_peak_iqr, 0e0) AS raw FROM w) z),
      tp AS (SELECT * FROM rk WHERE place <= 6),
      kn AS (SELECT session, turn, place, k.i AS i, string_split(top_types, ', ')[k.i] AS type FROM tp, LATERAL (SELECT unnest(range(1, len(string_split(top_types, ', ')) + 1)) AS i) k WHERE top_types <> '-'),
      kc AS (SELECT session, string_agg('| ' || type || ' | ' || n || ' |' || {_LF}, '' ORDER BY n DESC, first) AS x FROM (SELECT session, type, COUNT(*) AS n, MIN(place * 100 + i) AS first FROM kn GROUP BY session, type) z GROUP BY session),
      sd AS (SELECT CAST(conv_id % 3 AS INT) AS session, turn + 1 AS turn, CASE WHEN role = 'user' THEN 'Late Braking / Missed Apex' ELSE 'Conservative Entry / Overslowing' END AS issue, MIN(regexp_extract(text, '^[A-Za-z ]+', 0)) AS said FROM conversations WHERE conv_id < 30 AND regexp_extract(text, '^[A-Za-z ]+', 0) <> '' GROUP BY ALL),
      it AS (SELECT kn.session, kn.turn, COUNT(*) AS m, list(struct_pack(i := i, issue := sd.issue, said := said) ORDER BY i) AS items FROM kn JOIN sd ON sd.session = kn.session AND sd.turn = kn.turn AND sd.issue = CASE type WHEN 'late_brake' THEN 'Late Braking / Missed Apex' WHEN 'weak_exit' THEN 'Weak Corner Exit' ELSE 'Conservative Entry / Overslowing' END WHERE i <= 2 AND place <= 5 GROUP BY kn.session, kn.turn),
      se5 AS (SELECT tp.session, place, '### Turn ' || tp.turn || ' (composite score: ' || {_p2('cs')} || ', issue score: ' || {_p2('score')} || ', stability: ' || {_SEV('own')} || {_q(')' + chr(10) * 2 + '- **Event Count**: ')} || n || {_q(chr(10) + '- **Main Issues**: ')} || top_types
        || {_q(chr(10) * 2 + '#### Stability Metrics' + chr(10) * 2 + '| Metric | Value |' + chr(10) + '|------|------|' + chr(10))} || array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL)[:3], '') || {_q(chr(10) + '- Stability ranking: ')} || rank || '/' || total || {_q(' (higher rank = less stable)' + chr(10) + '- **Stability Assessment**: ')} || {_SEV('own')}
        || {_q(chr(10) * 2 + '- **Composite Score**: ')} || {_p2('cs')} || ' (issue score: ' || {_p2('score')} || {_q(' + stability score)' + chr(10) + '- **Overall Priority**: ')} || CASE WHEN cs >= 25 THEN 'Very High Priority (many issues and poor consistency, recommend prioritizing improvement)' WHEN cs >= 20 THEN 'High Priority (needs focused attention)' WHEN cs >= 15 THEN 'Medium Priority' ELSE 'Lower Priority' END || {_q(chr(10) * 2)}
        || COALESCE({_q('**AI-Personalized Coaching Advice**' + chr(10) * 2)} || array_to_string(list_transform(items, lambda x: CASE WHEN m > 1 THEN '**' || x.issue || {_q(':**' + chr(10) * 2)} ELSE '' END || x.said || {_q(chr(10) * 2)}), {_LF}), '') || {_q('---' + chr(10) * 2)} AS x FROM tp LEFT JOIN it ON it.session = tp.session AND it.turn = tp.turn WHERE place <= 5),
      al AS (SELECT session, string_agg(x, '' ORDER BY place) AS x FROM se5 GROUP BY session)
      SELECT CAST(s AS INT) AS session, trim(regexp_replace(regexp_replace({_q(reporting.COACHING)} || COALESCE({_q('| Issue Type | Count |' + chr(10) + '|---------|---------|' + chr(10))} || kc.x, {_q('No issues detected.' + chr(10))}) || {_q(chr(10) + '## Main Issue Analysis' + chr(10) * 2)} || COALESCE(al.x, ''), '\\n\\s*\\n\\s*\\n+', {_q(chr(10) * 2)}, 'g'), ' +', ' ', 'g'), ' ' || {_LF}) AS text
      FROM (SELECT unnest([0, 1, 2, 9]) AS s) z LEFT JOIN kc ON kc.session = s LEFT JOIN al ON al.session = s"""


def summaries_sql(common: str) -> str:
    """The summaries of events of three sessions."""
    own = lambda body: " UNION ALL ".join(f"""SELECT {s} AS session, * FROM (WITH {common.replace('FROM lineitem GROUP BY', f'FROM lineitem WHERE l_suppkey % 3 = {s} GROUP BY').replace('lap = 1)', f'lap = {s})').replace('lap <> 1', f'lap <> {s}')} {body}) q{s}""" for s in range(3))
    row = lambda *cells: "'| ' || " + " || ' | ' || ".join(cells) + f" || ' |' || {_LF}"
    return f"""WITH a AS ({own('SELECT type, COUNT(*) AS n FROM ev GROUP BY type')}), b AS ({own('SELECT *, row_number() OVER (ORDER BY events_count DESC, turn) AS k FROM byturn')}), c AS ({own('SELECT * FROM sc')}),
      a1 AS (SELECT session, string_agg({row('type', 'n')}, '' ORDER BY n DESC, type) AS x FROM a GROUP BY session), b1 AS (SELECT session, string_agg({row("'T' || turn", 'events_count', 'top_types', _p2('max_severity'))}, '' ORDER BY k) AS x FROM b WHERE k <= 5 GROUP BY session),
      c1 AS (SELECT session, string_agg({row("'T' || turn", *(_p2(x) for x in ('score', 'comp_s', 'comp_v', 'comp_sev', 'comp_freq')))}, '' ORDER BY score DESC, turn) AS x FROM c GROUP BY session)
      SELECT CAST(a1.session AS INT) AS session, {_q(reporting.TYPES)} || a1.x || {_q(reporting.HOTSPOTS)} || b1.x || {_q(reporting.PARTS)} || c1.x AS text FROM a1 JOIN b1 USING (session) JOIN c1 USING (session)"""


ORACLES = {
    "text_repair": f""" SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\([^\\x00-\\x7f]+\\)', '', 'g'), ':\\s+:', ':', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text
      FROM (SELECT conv_id, turn, CASE WHEN text <> '' AND regexp_matches(text, '[^\\x00-\\x7f]') AND NOT regexp_matches(text, '[^\\x{{00}}-\\x{{ff}}]') THEN COALESCE({_LATIN}, text) ELSE text END AS t FROM conversations) z""",
    "line_kinds": """ SELECT k, CAST(i AS INT) AS "at", kind, CAST(length(CASE WHEN kind = 'h2' THEN trim(substr(l, 6)) WHEN kind = 'item' THEN '<b>x</b>' || substr(l, 8) ELSE l END) AS INT) AS n
      FROM (SELECT k, i, l, CASE WHEN l = '---' THEN 'rule' WHEN l = '' THEN 'blank' WHEN l = '|---|---|' THEN 'separator' WHEN l = '| a | b |' THEN 'row' WHEN l LIKE '## %' THEN 'h2' WHEN l LIKE '- %' THEN 'item' ELSE 'paragraph' END AS kind
      FROM (SELECT k, i - 1 AS i, trim(lines[i], ' ' || chr(9) || chr(13)) AS l FROM (SELECT k, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT conv_id * 1000 + turn AS k,
        string_split(CASE turn % 4 WHEN 0 THEN '## 🎯 ' WHEN 1 THEN '- **x** ' ELSE '' END || text || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '---', chr(10)) AS lines FROM conversations) a) b) c) d""",
    "report_advice": f" SELECT conv_id AS report, turn, {_ISSUES} AS issue, {_SEEN} AS text FROM conversations WHERE {_SEEN} <> ''",
    "gold_references": f", {_REFS} SELECT * FROM refs",
    "gold_match": f", {_PAIRS} SELECT * FROM mt",
    "eval_means": f", {_PAIRS} SELECT issue, COUNT(*) AS n, printf('%.1f', AVG(generated_len)) AS generated_len, printf('%.1f', AVG(reference_len)) AS reference_len, 'N/A' AS score FROM mt GROUP BY issue",
    "best_laps": f", {_BESTS} SELECT track, arg_min(lap, laptime_s) AS lap, ROUND(MIN(laptime_s), 6) AS laptime_s, arg_min(session, laptime_s) AS session, arg_min(date, laptime_s) AS date FROM bl GROUP BY track",
    "best_history": f""", {_BESTS} SELECT * FROM (SELECT track, lap, ROUND(laptime_s, 6) AS laptime_s, session, date, LAG(lap) OVER w AS old_lap, ROUND(LAG(laptime_s) OVER w, 6) AS old_laptime_s,
      LAG(session) OVER w AS old_session, ROUND(LAG(laptime_s) OVER w - laptime_s, 6) AS improvement FROM bl WINDOW w AS (PARTITION BY track ORDER BY date)) z WHERE old_lap IS NOT NULL""",
    "lap_complete_rows": """, e AS (SELECT lap, COUNT(*) AS n, arg_max(t_s, rn) - arg_min(t_s, rn) AS dur, SQRT((arg_max(x, rn) - arg_min(x, rn)) ** 2 + (arg_max(y, rn) - arg_min(y, rn)) ** 2) AS gap FROM xy GROUP BY lap)
      SELECT lap, n FROM e WHERE n < 100 OR NOT (dur < 9e-1 * (SELECT median(dur) FROM e WHERE n >= 100 AND dur > 0) OR gap > 4e1)""",
    "lap_long_rows": " SELECT lap, COUNT(*) AS n FROM xy GROUP BY lap HAVING COUNT(*) >= 850",
    "history_cards": f" SELECT lap, turn, {', '.join(f'ROUND({c}, 6) AS {c}' for c in ('s_apex', 's_brake_onset', 'Ventry', 'Vmin', 'Vexit', 'a_long_peak'))}, 's2' AS session, '2024-01-01' AS date FROM cards WHERE lap = 5",
    "timed_sessions": f", {_TRACKED} SELECT track, session, t AS laptime_s FROM sn WHERE t IS NOT NULL",
    "event_payloads": """ SELECT event_id, replace(ref_flags, '}', ', "severity": ' || CASE WHEN v LIKE '%.' THEN v || '0' ELSE v END || '}') AS payload FROM (SELECT *, rtrim(printf('%.4f', ROUND(severity, 4)), '0') AS v FROM ev) z""",
    "advice_format": """ SELECT conv_id, turn, 'Analysis:' || chr(10) || 'Here you is late; you has time.' || chr(10) || 'Actionable Recommendations:' || chr(10) || CASE WHEN r = '' THEN 'a. ' ELSE '1. ' || ltrim(r, ' ') END || chr(10) || CASE WHEN r = '' THEN '1' ELSE '2' END || '. again' || chr(10) || 'End here' || chr(10) || 'b. no item' || chr(10) || chr(10) || chr(10) || 'last' AS text
      FROM (SELECT conv_id, turn, regexp_extract(text, '^[A-Za-z ]+', 0) AS r FROM conversations) z""",
    "track_layout": f""", {_ARC} SELECT CAST(i + 1 AS INT) AS turn, 97e0 + 270e0 * i AS s_apex, (SELECT arg_min(x, (ABS(s - 97e0 - 270e0 * i), rn)) FROM arc WHERE lap = 3) AS x, (SELECT arg_min(y, (ABS(s - 97e0 - 270e0 * i), rn)) FROM arc WHERE lap = 3) AS y, 'T' || (i + 1) AS label FROM range(11) b(i)""",
    "trajectory": f""", {_ARC} SELECT arc.lap, CAST(row_number() OVER (PARTITION BY arc.lap ORDER BY s, arc.rn) AS INT) AS place, arc.x, arc.y, v, arc.lap = 4 AS benchmark FROM arc JOIN xy ON xy.lap = arc.lap AND xy.rn = arc.rn""",
    "comparison_report": _COMPARISON,
    "radar": f""", {_TRACKED}, ed AS (SELECT track, MIN(date) AS a, MAX(date) AS b FROM sco GROUP BY track), rd AS (SELECT track, turn, MAX(CASE WHEN date = a THEN c END) AS first_score, MAX(CASE WHEN date = b THEN c END) AS last_score FROM sco JOIN ed USING (track) GROUP BY track, turn),
      rr AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY turn) AS k FROM rd WHERE first_score IS NOT NULL AND last_score IS NOT NULL), r8 AS (SELECT * FROM rr WHERE k <= 8)
      SELECT track, turn, ROUND(first_score, 6) AS first_score, ROUND(last_score, 6) AS last_score, ROUND((k - 1) * (6.283185307179586e0 / COUNT(*) OVER (PARTITION BY track)), 6) AS angle FROM r8""",
    "store_listing": """ SELECT 'benchmark_lap' AS name, 'track ' || lap % 3 AS session, '2024-01-01' AS date, COUNT(*) AS n FROM lt WHERE lap % 3 < 2 GROUP BY lap % 3
      UNION ALL SELECT 'corner_cards_with_delta', 'track 1', '2024-01-02', COUNT(*) FROM cards""",
    "session_store": f", {_S3} SELECT date AS session, '2024-01-0' || (CAST(date AS INT) + 1) AS date, turn, score AS composite_score, score AS issue_score, 0e0 AS stability_score, 0 AS events_count FROM sg",
    "benchmark_choice": """ SELECT CAST(lap AS VARCHAR) AS session, CAST(CASE WHEN old THEN lap + 100 ELSE lap END AS INT) AS lap, ROUND(CASE WHEN old THEN laptime_s - 5e-1 ELSE laptime_s END, 6) AS laptime_s, CASE WHEN old THEN 'historical_pb' ELSE 'fastest' END AS mode
      FROM (SELECT *, lap % 4 <> 3 AND lap % 2 = 0 AS old FROM lt) z""",
    "best_lap_text": " SELECT lap, CASE WHEN lap % 3 = 0 THEN 'No PB record' ELSE 'Lap ' || lap || ', ' || printf('%.2f', ROUND(laptime_s, 1)) || 's (Session: S, 2024-01-01)' END AS text FROM lt",
    "stacked_components": """ SELECT turn, component, label, ROUND(value, 6) AS value, ROUND(bottom, 6) AS bottom FROM (SELECT turn, 'comp_s' AS component, 'Component Δs' AS label, comp_s AS value, 0e0 AS bottom FROM sc UNION ALL SELECT turn, 'comp_v', 'Component ΔVmin', comp_v, comp_s FROM sc
      UNION ALL SELECT turn, 'comp_sev', 'Component Severity', comp_sev, comp_s + comp_v FROM sc UNION ALL SELECT turn, 'comp_freq', 'Component Frequency', comp_freq, comp_s + comp_v + comp_sev FROM sc) z""",
    "brake_points": f""", {_ARC}, hb AS (SELECT lap, turn, s_apex - s_brake_onset AS delta, s_apex AS a, COALESCE(s_brake_onset, s_apex) AS b FROM cards WHERE a_long_peak / 9.81e0 < -0.28e0),
      ax AS (SELECT hb.lap, turn, arg_min(x, (ABS(s - a), rn)) AS x, arg_min(y, (ABS(s - a), rn)) AS y FROM hb LEFT JOIN arc ON arc.lap = hb.lap  GROUP BY ALL),
      bx AS (SELECT hb.lap, turn, arg_min(x, (ABS(s - b), rn)) AS x, arg_min(y, (ABS(s - b), rn)) AS y FROM hb LEFT JOIN arc ON arc.lap = hb.lap  GROUP BY ALL)
      SELECT lap, turn, ROUND(delta, 6) AS delta_s_to_apex_m, ax.x AS x_apex, ax.y AS y_apex, bx.x AS x_brake, bx.y AS y_brake FROM hb JOIN ax USING (lap, turn) JOIN bx USING (lap, turn)""",
    "heatmap_cells": f""", {_HEAT}, hq AS (SELECT i, quantile_cont(raw, 0.95) AS top FROM hm GROUP BY i), pl AS (SELECT turn, CAST(ROW_NUMBER() OVER (ORDER BY stability_score DESC NULLS LAST, turn) AS INT) AS place FROM ss),
      hn AS (SELECT turn, place, i, metric, unit, CASE WHEN raw IS NULL THEN NULL WHEN top > 0 THEN GREATEST(LEAST(raw / top, 1e0), 0e0) ELSE 0e0 END AS value FROM hm JOIN hq USING (i) JOIN pl USING (turn)),
      worst AS (SELECT turn FROM hn WHERE i = 0 AND value IS NOT NULL ORDER BY value DESC, place LIMIT 3)
      SELECT turn, place, metric, unit, ROUND(value, 6) AS value, turn IN (SELECT turn FROM worst) AS least_stable FROM hn""",
    "advised_issues": f""" SELECT turn, CAST(i - 1 AS INT) AS "at", CASE k[i] WHEN 'late_brake' THEN 'Late Braking / Missed Apex' WHEN 'weak_exit' THEN 'Weak Corner Exit' ELSE 'Conservative Entry / Overslowing' END AS issue
      FROM (SELECT turn, k, unnest(generate_series(1, LEAST(len(k), 2))) AS i FROM (SELECT turn, {_KINDS} AS k FROM sc) y) z""",
    "turn_issues": f" SELECT turn, array_to_string(list_sort(k), ',') AS types, CAST(len(k) AS INT) AS n FROM (SELECT turn, {_KINDS} AS k FROM sc) z WHERE len(k) > 0",
    "improvements": f""", {_S3} SELECT turn, first_score, last_score, ROUND(spread, 6) AS spread, ROUND(first_score - last_score, 6) AS change, CASE WHEN first_score > last_score THEN 'improved' WHEN first_score < last_score THEN 'worsened' ELSE 'stable' END AS trend,
      ROUND(CASE WHEN first_score > 0 THEN (first_score - last_score) / first_score * 100 ELSE 0 END, 6) AS improvement_pct FROM (SELECT turn, arg_min(score, date) AS first_score, arg_max(score, date) AS last_score, MAX(score) - MIN(score) AS spread, COUNT(*) AS n FROM sg GROUP BY turn) z WHERE n >= 2""",
    "largest_turns": f", {_S3} SELECT turn, ROUND(AVG(score), 6) AS mean FROM sg GROUP BY turn ORDER BY AVG(score) DESC, turn LIMIT 5",
}
