"""The registered queries over laps, corners and issues, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.functions import text
from apexlake.operators import compare, issues, laps, ordered, retrieval
from apexlake.plans import adapters
from apexlake.plans.adapters import CTES, cards, tel, xy

BENCHMARK = 1
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
_rounded = lambda df: df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """Cards with differences, computed once: one scan of the cards' table whatever reads them."""
    return ordered.kept(issues.deltas(ordered.kept(cards(spark, d)), BENCHMARK))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return issues.relative_events(_deltas(spark, d), BENCHMARK)


def _report(spark: SparkSession, d: str) -> DataFrame:
    return issues.stability(_deltas(spark, d), BENCHMARK)


def _composite(spark: SparkSession, d: str, benchmark: int | DataFrame = BENCHMARK, rows: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both scores of each turn, from one table of cards."""
    rows = _deltas(spark, d) if rows is None else rows
    report = ordered.kept(issues.stability(rows, benchmark, keys))
    scored = issues.scores(issues.turn_stats(report, issues.relative_events(rows, benchmark, keys), keys), keys)
    return issues.composite(scored, issues.stability_score(report, keys), keys=keys)


def top_issues(spark: SparkSession, d: str) -> DataFrame:
    out = issues.top_issues(_composite(spark, d))
    return _rounded(out.select("turn", "composite_score", "score", "stability_score", "events_count", "top_types", "comp_s", "comp_v", "comp_sev", "comp_freq"))


def session_issues(spark: SparkSession, d: str) -> DataFrame:
    """The three worst turns of three sessions, each against a lap of its own, in one job."""
    rows = ordered.kept(cards(spark, d).withColumn("session", (F.col("lap") % 3).cast("int")))
    best = rows.groupBy("session").agg(F.min("lap").alias("lap"))
    rows = ordered.kept(issues.deltas(rows, best, ("session",)))
    out = issues.top_issues(_composite(spark, d, best, rows, ("session",)), 3, ("session",))
    return _rounded(out.select("session", "turn", "composite_score", "score", "stability_score", "events_count", "top_types", "sample_event_id"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Mean entry speed per turn and session, for the comparisons."""
    rows = cards(spark, d).withColumn("session", (F.col("lap") % 3).cast("int"))
    return rows.groupBy("session", "turn").agg(F.round(F.avg("Ventry"), 6).alias("score")).withColumn("date", F.concat(F.lit("2024-01-0"), (F.col("session") + 1).cast("string")))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return laps.lap_times(tel(spark, d)).withColumn("date", F.lpad(F.col("lap").cast("string"), 2, "0"))


def _corner(spark: SparkSession, d: str) -> DataFrame:
    arc = laps.arc_length(xy(spark, d)).select("lap", "rn", F.round("s", 4).alias("s"), "v", (F.col("longitudinal_acc_g") * 9.81).alias("a_long"))
    arc = laps.derivative(arc, "a_long", "jerk", 1.0)
    apexes = spark.createDataFrame([(i + 1, 146.0 + 270.35 * i) for i in range(10)], "turn int, s_apex double")
    return _rounded(laps.corner_metrics(arc, apexes))


def _by_session(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry of three sessions of four laps."""
    return tel(spark, d).withColumn("session", (F.col("lap") % 3).cast("int"))


def _dvdt(spark: SparkSession, d: str) -> DataFrame:
    rows, order = _by_session(spark, d), ("t_s", "event_id")
    rows = rows.join(laps.median_dt(rows, order, ("session",)), "session")
    return laps.derivative(rows, "v", "dvdt", F.col("dt"), order, ("session",)).select("event_id", *r6("dvdt"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _deltas(spark, d)
    ranked = issues.advice_rank(issues.stability(rows, BENCHMARK))
    rows = _composite(spark, d, BENCHMARK, rows).select("turn", "composite_score").join(ranked, "turn")
    return rows.select("turn", text.severity_label(F.col("composite")).alias("severity"), text.priority_label(F.col("composite_score")).alias("priority"), "rank")


def _eval_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters._read(spark, d, "labels").join(adapters._read(spark, d, "documents"), "doc_id")
    return _rounded(rows.groupBy("source").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("n")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return adapters._read(spark, d, "embeddings")


def _asking(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _retry(spark: SparkSession, d: str) -> DataFrame:
    """Queries that ask with a vector of zeros or one pointing nowhere near at first, every third with its own, and all with their own again."""
    own = _asking(spark, d)
    first = own.withColumn("embedding", F.expr("transform(embedding, (x, i) -> cast(CASE query_id div 100 % 3 WHEN 0 THEN x WHEN 1 THEN 0 ELSE CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END END AS float))"))
    return retrieval.retried(_vectors(spark, d), first, own, 5, 0.5, carry=["label"])


QUERIES = {
    "top_issues": top_issues,
    "lap_times": lambda s, d: laps.lap_times(tel(s, d)),
    "lap_filter_warmup": lambda s, d: laps.drop_warmup(tel(s, d)).groupBy("lap").agg(F.count("*").alias("n")),
    "lap_completeness": lambda s, d: _rounded(laps.completeness(xy(s, d))),
    "ref_lap_fastest": lambda s, d: laps.reference_lap(laps.lap_times(tel(s, d))),
    "ref_lap_median": lambda s, d: laps.reference_lap(laps.lap_times(tel(s, d)), "median"),
    "ref_lap_n": lambda s, d: laps.reference_lap(laps.lap_times(tel(s, d)), lap=5),
    "lap_ffill": lambda s, d: laps.fill_lap(_by_session(s, d).select("session", "event_id", F.when(F.col("rn") % 3 == 0, F.col("lap")).alias("lap")), "event_id", ("session",)),
    "arc_length": lambda s, d: laps.arc_length(xy(s, d)).select("lap", "rn", *r6("s")),
    "median_dt": lambda s, d: _rounded(laps.median_dt(_by_session(s, d), ("t_s", "event_id"), ("session",))),
    "dvdt": _dvdt,
    "speed_units": lambda s, d: tel(s, d).select("event_id", *(F.round(text.to_ms(F.col("v"), u), 6).alias(u) for u in ("ms", "kmh", "mph"))),
    "corner_segment_metrics": _corner,
    "card_deltas": lambda s, d: _rounded(issues.deltas(ordered.kept(cards(s, d)), BENCHMARK).select("lap", "turn", "delta_s_to_apex_m", *issues.METRICS)),
    "ev_absolute": lambda s, d: _rounded(issues.absolute_events(cards(s, d))),
    "ev_all": lambda s, d: _rounded(_events(s, d)),
    "event_histogram": lambda s, d: _events(s, d).groupBy("type").agg(F.count("*").alias("n")),
    "events_by_turn": lambda s, d: _rounded(issues.by_turn(_events(s, d))),
    "hotspots": lambda s, d: issues.by_turn(_events(s, d)).select("turn", "events_count").orderBy(F.desc("events_count"), "turn").limit(10),
    "stability_report": lambda s, d: _rounded(_report(s, d)),
    "stability_score": lambda s, d: _rounded(issues.stability_score(_report(s, d))),
    "stability_fallback": lambda s, d: _rounded(issues.fallback_score(_report(s, d))),
    "stability_numbers": lambda s, d: _rounded(issues.stability_numbers(_report(s, d))),
    "long_metrics": lambda s, d: _rounded(issues.long_metrics(_deltas(s, d))),
    "issue_scores": lambda s, d: _rounded(_composite(s, d).select("turn", "comp_s", "comp_v", "comp_sev", "comp_freq", "score")),
    "composite_scores": lambda s, d: _rounded(_composite(s, d).select("turn", "composite_score", "stability_score")),
    "session_issues": session_issues,
    "labels": _labels,
    "issue_counts": lambda s, d: text.issue_counts(issues.by_turn(_events(s, d))),
    "session_pivot": lambda s, d: compare.pivot(_sessions(s, d), [0, 1, 2]).select("turn", *(F.col(str(i)).alias(f"s{i}") for i in range(3))),
    "session_first_last": lambda s, d: _rounded(compare.first_last(_sessions(s, d))),
    "common_turns": lambda s, d: compare.common_turns(_sessions(s, d)),
    "laptime_trend": lambda s, d: _rounded(compare.trend(_times(s, d).withColumn("laptime_s", F.round("laptime_s", 3)))),
    "step_changes": lambda s, d: _rounded(compare.step_changes(_sessions(s, d), "score", 1.0, ("turn",))),
    "pb_memory_fold": lambda s, d: compare.personal_bests(_times(s, d), "lap").select("lap", "laptime_s"),
    "eval_summary": _eval_summary,
    "kb_topk": lambda s, d: retrieval.retrieved(_vectors(s, d), _asking(s, d), 10),
    "kb_retry": _retry,
    "text_squeeze": lambda s, d: adapters._read(s, d, "conversations").select("conv_id", "turn", text.squeeze(F.col("text")).alias("text")),
}

#: What an event keeps of its card.
_CARD = "delta_s_to_apex_m, Ventry, Vmin, Vexit, d_delta_s, d_Ventry, d_Vmin, d_Vexit, a_long_peak / 9.81e0 AS a_long_peak_g"
_D = f"""{CTES}, pb AS (SELECT turn, s_apex - s_brake_onset AS d, Ventry, Vmin, Vexit, a_long_peak FROM cards WHERE lap = 1),
dl AS (SELECT c.*, c.s_apex - c.s_brake_onset AS delta_s_to_apex_m, c.s_apex - c.s_brake_onset - pb.d AS d_delta_s, c.Ventry - pb.Ventry AS d_Ventry,
  c.Vmin - pb.Vmin AS d_Vmin, c.Vexit - pb.Vexit AS d_Vexit, c.a_long_peak - pb.a_long_peak AS d_a_long_peak FROM cards c LEFT JOIN pb USING (turn)),
raw AS (
  SELECT lap, turn, 'late_brake' AS type, ABS(d_delta_s) - 7e0 AS severity, '{{"delta_s": "late"}}' AS ref_flags, {_CARD} FROM dl WHERE lap <> 1 AND d_delta_s < -7e0
  UNION ALL SELECT lap, turn, 'early_brake', d_delta_s - 12e0, '{{"delta_s": "early"}}', {_CARD} FROM dl WHERE lap <> 1 AND d_delta_s > 12e0
  UNION ALL SELECT lap, turn, 'overslow', ABS(d_Vmin) - 1.2e0, '{{"vmin": "lower"}}', {_CARD} FROM dl WHERE lap <> 1 AND d_Vmin < -1.2e0
  UNION ALL SELECT lap, turn, 'weak_exit', GREATEST(ABS(d_Vexit) - 1.5e0, 0e0) + GREATEST(0.25e0 - ABS(a_long_peak / 9.81e0), 0e0),
    '{{"vexit": "lower", "a_long_peak": "weak"}}', {_CARD} FROM dl WHERE lap <> 1 AND d_Vexit < -1.5e0 AND ABS(a_long_peak / 9.81e0) < 0.25e0),
ev AS (SELECT *, lap || '-' || turn || '-' || type || '-' || ROW_NUMBER() OVER (PARTITION BY type ORDER BY lap, turn) AS event_id FROM raw WHERE severity > 0),
kinds AS (SELECT turn, type, COUNT(*) AS n, MIN(lap) AS first FROM ev GROUP BY ALL),
tt AS (SELECT turn, string_agg(type, ', ' ORDER BY rk) AS top_types FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY turn ORDER BY n DESC, first, type) AS rk FROM kinds) q WHERE rk <= 3 GROUP BY turn),
bt AS (SELECT turn, COUNT(*) AS events_count, MAX(severity) AS max_severity, arg_max(event_id, (severity, -lap, -turn)) AS sample_event_id FROM ev GROUP BY turn),
byturn AS (SELECT * FROM bt JOIN tt USING (turn)),
st AS (SELECT turn, CAST(COUNT(DISTINCT lap) AS INT) AS lap_count,
  {', '.join(f'median({m}) AS {m}_median, quantile_cont({m}, 0.25) AS {m}_q25, quantile_cont({m}, 0.75) AS {m}_q75, quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS {m}_iqr, AVG({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, COUNT({m}) AS {m}_count, median(ABS({m})) AS "med_|{m}|", quantile_cont(ABS({m}), 0.75) - quantile_cont(ABS({m}), 0.25) AS "iqr_|{m}|"' for m in issues.METRICS)}
  FROM dl WHERE lap <> 1 GROUP BY turn),
q AS (SELECT {', '.join(f'quantile_cont(CASE WHEN {c} > 0 THEN {c} END, 0.95) AS q{i}' for i, c in enumerate(issues.WEIGHTS))} FROM st),
ss AS (SELECT turn, {' + '.join(f'COALESCE({w}e0 * GREATEST(LEAST({c} / q{i}, 1e0), 0e0), 0e0)' for i, (c, w) in enumerate(issues.WEIGHTS.items()))} AS stability_score FROM st, q),
ts AS (SELECT dl.turn, COALESCE(median(ABS(d_delta_s)), 0e0) AS ms, COALESCE(median(ABS(d_Vmin)), 0e0) AS mv FROM dl WHERE lap <> 1 GROUP BY turn),
tj AS (SELECT ts.*, COALESCE(events_count, 0) AS events_count, COALESCE(max_severity, 0e0) AS sev, COALESCE(top_types, '-') AS top_types FROM ts LEFT JOIN byturn USING (turn)),
qq AS (SELECT GREATEST(quantile_cont(ms, 0.95), 1e-6) AS a, GREATEST(quantile_cont(mv, 0.95), 1e-6) AS b, GREATEST(quantile_cont(sev, 0.95), 1e-6) AS c FROM tj),
cp AS (SELECT turn, events_count, top_types, 1e1 * LEAST(ms / a, 1e0) AS comp_s, 1e1 * LEAST(mv / b, 1e0) AS comp_v, 1e1 * LEAST(sev / c, 1e0) AS comp_sev, LEAST(LN(1e0 + events_count), 3e0) AS comp_freq FROM tj, qq),
sc AS (SELECT *, comp_s + 8e-1 * comp_v + 6e-1 * comp_sev + 3e-1 * comp_freq AS score FROM cp),
sp AS (SELECT MIN(stability_score) AS s0, MAX(stability_score) AS s1 FROM ss), ip AS (SELECT MIN(score) AS i0, MAX(score) AS i1 FROM sc),
co AS (SELECT sc.*, COALESCE(stability_score, 0e0) AS stability_score,
  CASE WHEN i0 = i1 THEN score ELSE i0 + (7e-1 * COALESCE((score - i0) / NULLIF(i1 - i0, 0e0), 0e0) + 3e-1 * COALESCE((COALESCE(stability_score, 0e0) - s0) / NULLIF(s1 - s0, 0e0), 0e0)) * (i1 - i0) END AS composite_score
  FROM sc LEFT JOIN ss USING (turn), sp, ip),
lt AS (SELECT lap, MIN(t_s) AS t_min, MAX(t_s) AS t_max, COUNT(t_s) AS samples, MAX(t_s) - MIN(t_s) AS laptime_s FROM tel GROUP BY lap),
md AS (SELECT median(laptime_s) AS m FROM lt), gd AS (SELECT lt.*, laptime_s >= 5e-1 * m AND samples >= 200 AS good, m FROM lt, md),
gl AS (SELECT * FROM gd WHERE good OR NOT (SELECT bool_or(good) FROM gd)), gm AS (SELECT median(laptime_s) AS gm FROM gl),
se AS (SELECT CAST(lap % 3 AS INT) AS session, turn, ROUND(AVG(Ventry), 6) AS score, '2024-01-0' || (lap % 3 + 1) AS date FROM cards GROUP BY lap % 3, turn)"""
_w = lambda body: f"WITH RECURSIVE {_D} {body}"
_round = lambda *c: ", ".join(f'ROUND("{x}", 6) AS "{x}"' for x in c)
_STATS = [f"{a}{m}{b}" for m in issues.METRICS for a, b in (("", "_median"), ("", "_q25"), ("", "_q75"), ("", "_iqr"), ("", "_mean"), ("", "_std"), ("med_|", "|"), ("iqr_|", "|"))]

#: The k vectors most similar to each query's vector, an expression of the row asking.
_found = lambda vector, k: f"""SELECT query_id, rank, vec_id, similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM (
    SELECT query_id, vec_id, ROUND(list_dot_product(e, q) / (SQRT(list_dot_product(e, e)) * SQRT(list_dot_product(q, q))), 6) + 0e0 AS similarity
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v, (SELECT vec_id AS query_id, CAST({vector} AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0) a WHERE list_dot_product(q, q) > 0) s) r WHERE rank <= {k}"""  # noqa: E731

ORACLES = {
    "top_issues": _w(f"SELECT turn, events_count, top_types, {_round('composite_score', 'score', 'stability_score', 'comp_s', 'comp_v', 'comp_sev', 'comp_freq')} FROM co ORDER BY co.composite_score DESC, turn LIMIT 8"),
    "lap_times": _w("SELECT * FROM lt"),
    "lap_filter_warmup": _w("SELECT lap, COUNT(*) AS n FROM tel WHERE lap <> 0 AND lap <> (SELECT MAX(lap) FROM tel) GROUP BY lap"),
    "lap_completeness": _w("""SELECT lap, samples, ROUND(duration, 6) AS duration, ROUND(gap_m, 6) AS gap_m,
        NOT (samples >= 100 AND (duration < 9e-1 * (SELECT median(duration) FROM e WHERE samples >= 100 AND duration > 0) OR gap_m > 4e1)) AS keep FROM e""").replace(
        " SELECT lap, samples, ROUND", """, e AS (SELECT lap, COUNT(*) AS samples, arg_max(t_s, rn) - arg_min(t_s, rn) AS duration,
        SQRT((arg_max(x, rn) - arg_min(x, rn)) ** 2 + (arg_max(y, rn) - arg_min(y, rn)) ** 2) AS gap_m FROM xy GROUP BY lap) SELECT lap, samples, ROUND"""),
    "ref_lap_fastest": _w("SELECT lap, laptime_s, 'fastest' AS mode FROM gl ORDER BY laptime_s, lap LIMIT 1"),
    "ref_lap_median": _w("SELECT lap, laptime_s, 'median' AS mode FROM gl, gm ORDER BY ABS(laptime_s - gm), lap LIMIT 1"),
    "ref_lap_n": _w("SELECT lap, laptime_s, CASE WHEN (SELECT COUNT(*) FROM gl WHERE lap = 5) > 0 THEN '5' ELSE 'fastest' END AS mode FROM gl ORDER BY lap <> 5, laptime_s, lap LIMIT 1"),
    "lap_ffill": _w("SELECT CAST(lap % 3 AS INT) AS session, event_id, CAST(COALESCE(LAST_VALUE(CASE WHEN rn % 3 = 0 THEN lap END IGNORE NULLS) OVER (PARTITION BY lap % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS INT) AS lap FROM tel"),
    "arc_length": _w("""SELECT lap, rn, ROUND(SUM(COALESCE(SQRT(dx * dx + dy * dy), 0e0)) OVER (PARTITION BY lap ORDER BY rn ROWS UNBOUNDED PRECEDING), 6) AS s
        FROM (SELECT *, x - LAG(x) OVER (PARTITION BY lap ORDER BY rn) AS dx, y - LAG(y) OVER (PARTITION BY lap ORDER BY rn) AS dy FROM xy) z"""),
    "median_dt": _w("SELECT session, ROUND(median(d), 6) AS dt FROM (SELECT CAST(lap % 3 AS INT) AS session, t_s - LAG(t_s) OVER (PARTITION BY lap % 3 ORDER BY t_s, event_id) AS d FROM tel) z GROUP BY session"),
    "dvdt": _w("""SELECT event_id, ROUND(dv / dt, 6) AS dvdt FROM (SELECT lap % 3 AS session, event_id, v - LAG(v) OVER (PARTITION BY lap % 3 ORDER BY t_s, event_id) AS dv FROM tel) a
        JOIN (SELECT session, median(d) AS dt FROM (SELECT lap % 3 AS session, t_s - LAG(t_s) OVER (PARTITION BY lap % 3 ORDER BY t_s, event_id) AS d FROM tel) z GROUP BY session) b USING (session)"""),
    "speed_units": _w("SELECT event_id, ROUND(v, 6) AS ms, ROUND(v / 3.6e0, 6) AS kmh, ROUND(v * 0.44704e0, 6) AS mph FROM tel"),
    "card_deltas": _w(f"SELECT lap, turn, {_round('delta_s_to_apex_m', *issues.METRICS)} FROM dl"),
    "ev_absolute": _w("""SELECT lap, turn, 'heavy_brake' AS type, ROUND(a_long_peak / 9.81e0, 6) AS a_long_peak_g, ROUND(s_apex - s_brake_onset, 6) AS delta_s_to_apex_m, NULL::DOUBLE AS Ventry, NULL::DOUBLE AS Vmin
        FROM cards WHERE a_long_peak / 9.81e0 < -0.28e0 UNION ALL SELECT lap, turn, 'conservative_entry', NULL, NULL, ROUND(Ventry, 6), ROUND(Vmin, 6) FROM cards WHERE Ventry < 1.3e0 * Vmin"""),
    "ev_all": _w(f"SELECT lap, turn, type, event_id, ref_flags, 'rule_v1' AS source, {_round('severity', 'delta_s_to_apex_m', 'Ventry', 'Vmin', 'Vexit', 'd_delta_s', 'd_Ventry', 'd_Vmin', 'd_Vexit', 'a_long_peak_g')} FROM ev"),
    "event_histogram": _w("SELECT type, COUNT(*) AS n FROM ev GROUP BY type"),
    "events_by_turn": _w("SELECT turn, events_count, ROUND(max_severity, 6) AS max_severity, sample_event_id, top_types FROM byturn"),
    "hotspots": _w("SELECT turn, events_count FROM byturn ORDER BY events_count DESC, turn LIMIT 10"),
    "stability_report": _w(f"SELECT turn, lap_count, {_round(*_STATS)}, {', '.join(f'{m}_count' for m in issues.METRICS)}, t.total_laps, ROUND(lap_count / t.total_laps, 6) AS coverage FROM st, (SELECT CAST(COUNT(DISTINCT lap) AS INT) AS total_laps FROM dl WHERE lap <> 1) t"),
    "stability_score": _w(f"SELECT turn, {_round('stability_score')} FROM ss"),
    "stability_fallback": _w("""SELECT turn, ROUND(raw / MAX(raw) OVER (), 6) AS stability_score FROM (SELECT turn,
        COALESCE(5e-1 * d_delta_s_iqr, 0e0) + COALESCE(3e-1 * d_Vmin_iqr, 0e0) + COALESCE(1e-1 * d_Ventry_iqr, 0e0) + COALESCE(1e-1 * d_a_long_peak_iqr, 0e0) AS raw FROM st) z"""),
    "stability_numbers": _w(f"SELECT (SELECT COUNT(*) FROM st) AS turns, ROUND(MAX(x), 6) AS most, ROUND(AVG(x), 6) AS mean FROM ({' UNION ALL '.join(f'SELECT {m}_iqr AS x FROM st' for m in issues.METRICS)}) z"),
    "long_metrics": _w(" UNION ALL ".join(f"SELECT lap, turn, '{m}' AS metric, ROUND({m}, 6) AS value FROM dl" for m in issues.METRICS)),
    "session_issues": " UNION ALL ".join(f"""SELECT CAST({s} AS INT) AS session, * FROM (WITH {_D.replace('FROM lineitem GROUP BY', f'FROM lineitem WHERE l_suppkey % 3 = {s} GROUP BY').replace('lap = 1)', f'lap = {s})').replace('lap <> 1', f'lap <> {s}')}
        SELECT turn, {_round('composite_score', 'score', 'stability_score')}, events_count, top_types, sample_event_id FROM (SELECT co.*, COALESCE(bt.sample_event_id, '') AS sample_event_id FROM co LEFT JOIN bt USING (turn)) x ORDER BY x.composite_score DESC, turn LIMIT 3) q{s}""" for s in range(3)),
    "issue_scores": _w(f"SELECT turn, {_round('comp_s', 'comp_v', 'comp_sev', 'comp_freq', 'score')} FROM sc"),
    "composite_scores": _w(f"SELECT turn, {_round('composite_score', 'stability_score')} FROM co"),
    "labels": _w("""SELECT turn, CASE WHEN raw / top >= 0.8 THEN 'Very Poor' WHEN raw / top >= 0.6 THEN 'Poor' WHEN raw / top >= 0.4 THEN 'Average' ELSE 'Good' END AS severity,
        CASE WHEN composite_score >= 25 THEN 'Very High Priority' WHEN composite_score >= 20 THEN 'High Priority' WHEN composite_score >= 15 THEN 'Medium Priority' ELSE 'Lower Priority' END AS priority, rank
        FROM (SELECT turn, raw, MAX(raw) OVER () AS top, CAST(ROW_NUMBER() OVER (ORDER BY raw DESC, turn) AS INT) AS rank FROM (SELECT turn,
        COALESCE(5e-1 * d_delta_s_iqr, 0e0) + COALESCE(3e-1 * d_Vmin_iqr, 0e0) + COALESCE(1e-1 * d_Ventry_iqr, 0e0) + COALESCE(1e-1 * d_a_long_peak_iqr, 0e0) AS raw FROM st) y) z JOIN co USING (turn)"""),
    "issue_counts": _w("SELECT type, COUNT(*) AS n FROM (SELECT unnest(string_split(top_types, ', ')) AS type FROM byturn) z WHERE type NOT IN ('', '-') GROUP BY type"),
    "session_pivot": _w("SELECT turn, MAX(CASE WHEN session = 0 THEN score END) AS s0, MAX(CASE WHEN session = 1 THEN score END) AS s1, MAX(CASE WHEN session = 2 THEN score END) AS s2 FROM se GROUP BY turn"),
    "session_first_last": _w("""SELECT turn, first_score, last_score, ROUND(spread, 6) AS spread, ROUND(first_score - last_score, 6) AS change,
        CASE WHEN first_score > last_score THEN 'improved' WHEN first_score < last_score THEN 'worsened' ELSE 'stable' END AS trend
        FROM (SELECT turn, arg_min(score, date) AS first_score, arg_max(score, date) AS last_score, MAX(score) - MIN(score) AS spread, COUNT(*) AS n FROM se GROUP BY turn) z WHERE n >= 2"""),
    "common_turns": _w("SELECT turn FROM se WHERE date = (SELECT MIN(date) FROM se) INTERSECT SELECT turn FROM se WHERE date = (SELECT MAX(date) FROM se) ORDER BY turn LIMIT 8"),
    "laptime_trend": _w("""SELECT *, ROUND(CASE WHEN first_s > 0 THEN (first_s - last_s) / first_s * 100 ELSE 0 END, 6) AS improvement_pct,
        CASE WHEN first_s > last_s THEN 'improved' WHEN first_s < last_s THEN 'worsened' ELSE 'stable' END AS trend FROM (
        SELECT arg_min(l, lap) AS first_s, arg_max(l, lap) AS last_s, ROUND(regr_slope(l, i), 6) AS slope, ROUND(regr_intercept(l, i), 6) AS intercept, ROUND(arg_min(l, lap) - arg_max(l, lap), 6) AS improvement_s
        FROM (SELECT lap, ROUND(laptime_s, 3) AS l, CAST(ROW_NUMBER() OVER (ORDER BY lap) - 1 AS DOUBLE) AS i FROM lt) z) y"""),
    "step_changes": _w("SELECT session, turn, score, date, ROUND(change, 6) AS change, COALESCE(ABS(change) > 1e0, FALSE) AS marked FROM (SELECT *, score - LAG(score) OVER (PARTITION BY turn ORDER BY date) AS change FROM se) z"),
    "pb_memory_fold": _w("SELECT lap, laptime_s FROM (SELECT *, MIN(laptime_s) OVER (ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lt) z WHERE b IS NULL OR laptime_s < b"),
    "eval_summary": "SELECT source, ROUND(AVG(quality), 6) AS quality, ROUND(AVG(toxic), 6) AS toxic, COUNT(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "kb_topk": f"SELECT * FROM ({_found('embedding', 10)}) z",
    "kb_retry": f"""WITH a AS ({_found("list_transform(embedding, lambda x, i: CAST(CASE vec_id // 100 % 3 WHEN 0 THEN x WHEN 1 THEN 0 ELSE CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END END AS FLOAT))", 5)}), b AS ({_found('embedding', 5)}),
        g AS (SELECT query_id FROM a WHERE rank = 1 AND similarity >= 5e-1)
        SELECT z.*, label FROM (SELECT *, 1 AS attempt FROM a WHERE query_id IN (FROM g) UNION ALL SELECT *, 2 FROM b WHERE query_id NOT IN (FROM g)) z JOIN embeddings USING (vec_id)""",
    "text_squeeze": "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ') AS text FROM conversations",
    "corner_segment_metrics": _w("""SELECT * FROM fin""").replace(" SELECT * FROM fin", """,
      a0 AS (SELECT *, x - LAG(x) OVER (PARTITION BY lap ORDER BY rn) AS dx, y - LAG(y) OVER (PARTITION BY lap ORDER BY rn) AS dy FROM xy),
      a1 AS (SELECT lap, rn, v, longitudinal_acc_g * 9.81e0 AS a, ROUND(SUM(COALESCE(SQRT(dx * dx + dy * dy), 0e0)) OVER (PARTITION BY lap ORDER BY rn ROWS UNBOUNDED PRECEDING), 4) AS s FROM a0),
      a2 AS (SELECT *, a - LAG(a) OVER (PARTITION BY lap ORDER BY rn) AS j FROM a1),
      ap AS (SELECT CAST(i + 1 AS INT) AS turn, 146e0 + 270.35e0 * i AS p FROM range(10) r(i)),
      seg AS (SELECT * FROM a2 JOIN ap ON ABS(s - p) <= 6e1),
      met AS (SELECT lap, turn, MIN(v) AS Vmin, MIN(CASE WHEN s < p THEN a END) AS a_long_peak,
        COALESCE(median(CASE WHEN s < p AND s >= p - 3e1 THEN v END), arg_max(v, rn) FILTER (WHERE s < p), arg_min(v, rn)) AS Ventry,
        COALESCE(median(CASE WHEN s > p AND s <= p + 3e1 THEN v END), arg_min(v, rn) FILTER (WHERE s > p), arg_max(v, rn)) AS Vexit,
        CASE WHEN COALESCE(bool_or(s < p AND j < 0), FALSE) THEN MAX(CASE WHEN s < p AND a < -0.15e0 * 9.81e0 AND j < 0 THEN s END) ELSE MAX(CASE WHEN s < p AND a < -0.15e0 * 9.81e0 THEN s END) END AS s_brake_onset
        FROM seg GROUP BY lap, turn),
      fin AS (SELECT l.lap, ap.turn, ROUND(p, 6) AS s_apex, ROUND(s_brake_onset, 6) AS s_brake_onset, ROUND(Ventry, 6) AS Ventry, ROUND(Vmin, 6) AS Vmin, ROUND(Vexit, 6) AS Vexit, ROUND(a_long_peak, 6) AS a_long_peak
        FROM (SELECT DISTINCT lap FROM tel) l CROSS JOIN ap LEFT JOIN met USING (lap, turn)) SELECT * FROM fin"""),
}

from apexlake.plans import reports, signals  # noqa: E402

QUERIES |= signals.QUERIES | reports.QUERIES
ORACLES |= {name: _w(sql) for name, sql in (signals.ORACLES | reports.ORACLES).items()}
ORACLES |= {"coaching_report": reports.coaching_sql(_D), "event_summaries": reports.summaries_sql(_D)}
