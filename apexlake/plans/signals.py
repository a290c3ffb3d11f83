"""The registered queries over smoothing, geometry, apexes, ingest and heat maps, and their SQL (after the common tables)."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexlake.operators import issues, laps, ordered, signal
from apexlake.plans.adapters import cards, shaped, tel, timed, xy
from apexlake.sources import telemetry

#: Samples of a smoothing window.
WINDOW = 11
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def _arc(spark: SparkSession, d: str) -> DataFrame:
    return laps.arc_length(xy(spark, d)).select("lap", "rn", F.round("s", 4).alias("s"), "x", "y")


def _line(spark: SparkSession, d: str) -> DataFrame:
    return signal.resample(_arc(spark, d), keys=("lap",))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """(lap, gi, s, kappa): the smoothed curvature of each lap's profile."""
    arc = laps.arc_length(shaped(spark, d)).select("lap", "rn", F.round("s", 4).alias("s"), "x", "y")
    rows = signal.curvature(signal.resample(arc, keys=("lap",)), keys=("lap",))
    rows = signal.savgol(rows, "kappa", "kappa_s", 21, 3, "gi", ("lap",))
    return rows.select("lap", "gi", "s", F.round("kappa_s", 9).alias("kappa"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return laps.median_dt(timed(spark, d), ["rn"], ("lap",))


def smooth_velocity(spark: SparkSession, d: str) -> DataFrame:
    return signal.smoothed(timed(spark, d), "v", "v_smooth", 0.5, _steps(spark, d))


def acceleration(spark: SparkSession, d: str) -> DataFrame:
    return signal.acceleration(smooth_velocity(spark, d), _steps(spark, d))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry with positions around a place, in degrees."""
    return xy(spark, d).select("event_id", "lap", "t_s", "v", (F.lit(31.0) + F.col("y") / 111000).alias("lat"), (F.lit(121.0) + F.col("x") / 95000).alias("lon"))


def _apexes(spark: SparkSession) -> DataFrame:
    """Of every lap: places along it and far beyond its end."""
    turns = spark.sql("SELECT CAST(id + 1 AS INT) AS turn, 146e0 + 270.35e0 * id AS s_apex FROM range(16)")
    return spark.range(12).select(F.col("id").cast("int").alias("lap")).crossJoin(turns)


def csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry written as delimited files with other headers and units, read again."""
    path = f"{ordered.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = _placed(spark, d).select(
        F.col("event_id").alias("row"), (F.col("lap") % 3).alias("session"), F.col("t_s").alias("Elapsed_Time (s)"), F.col("lat").alias("Latitude (deg)"), F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("lon").cast("string")).alias("LONGITUDE"),
        (F.col("v") * 3.6).alias("Speed (km/h)"), F.when(F.col("event_id") % 4 == 0, F.col("lap")).alias("Lap #"), F.lit(0).alias("altitude (m)"),
    )
    rows.write.option("header", True).csv(path)
    read = telemetry.read_text(spark, path).drop("rid").withColumns({"row": F.col("row").cast("long"), "session": F.col("session").cast("int")})
    return telemetry.canonical(read, keys=("session",), order="row").select("session", "row", *r6("t_s", "lat", "lon", "v"), "lap")


def _stability(spark: SparkSession, d: str) -> DataFrame:
    return issues.stability(ordered.kept(issues.deltas(ordered.kept(cards(spark, d)), 1)), 1)


QUERIES = {
    "savgol_velocity": lambda s, d: signal.savgol(tel(s, d), "v", "smooth", WINDOW, keys=("lap",)).select("event_id", *r6("smooth")),
    "project_tmerc": lambda s, d: signal.project(_placed(s, d), ("lap",)).select("event_id", *(F.round(c, 4).alias(c) for c in ("x", "y"))),
    "resample_centerline": lambda s, d: _line(s, d).select("lap", "gi", *r6("s", "x", "y")),
    "curvature": lambda s, d: signal.curvature(_line(s, d), keys=("lap",)).select("lap", "gi", *r6("kappa")),
    "smooth_velocity": lambda s, d: smooth_velocity(s, d).select("event_id", *r6("v_smooth")),
    "acceleration": lambda s, d: acceleration(s, d).select("event_id", "source", (F.round("a_long", 6) + 0.0).alias("a_long")),
    "apex_peaks": lambda s, d: signal.apexes(profile(s, d), ("lap",)).select("lap", "turn", "kappa", *r6("s_apex")),
    "apex_scan": lambda s, d: signal.scan(profile(s, d), ("lap",)),
    "apex_autotune": lambda s, d: signal.tuned(profile(s, d), ("lap",)),
    "apex_candidates": lambda s, d: signal.candidates(signal.scan(profile(s, d), ("lap",)), ("lap",)).drop("in_target"),
    "curvature_debug": lambda s, d: signal.curvature_debug(profile(s, d), ("lap",)).select("lap", "is_peak", "kappa_s", *r6("s", "peak_s_before_merge", "peak_s_after_merge")),
    "nearest_apex_xy": lambda s, d: signal.nearest_points(_arc(s, d), _apexes(s), "s_apex", keys=("lap",)),
    "nearest_overview_xy": lambda s, d: signal.nearest_points(_arc(s, d).withColumn("row", F.struct("lap", "rn")), _apexes(s).where("lap = 0").drop("lap"), "s_apex", "row"),
    "csv_ingest": csv_ingest,
    "advice_rank": lambda s, d: issues.advice_rank(_stability(s, d)).select("turn", *r6("composite"), "rank"),
    "heatmap_norm": lambda s, d: issues.heatmap(_stability(s, d)).select("turn", "metric", *r6("value")),
    "heatmap_meta": lambda s, d: issues.heatmap_meta(_stability(s, d)).select("metric", *r6("least", "most", "mean", "q95")),
}

_H = signal.hat_matrix(WINDOW, 2)
_N = signal.FLATTENING / (2 - signal.FLATTENING)
_E = 2 * _N**0.5 / (1 + _N)
_R = signal.AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_A = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_x = f"{_R!r} * (eta + " + " + ".join(f"{a!r} * cos({2 * j}e0 * xi) * sinh({2 * j}e0 * eta)" for j, a in enumerate(_A, 1)) + ")"
_y = f"{_R!r} * (xi + " + " + ".join(f"{a!r} * sin({2 * j}e0 * xi) * cosh({2 * j}e0 * eta)" for j, a in enumerate(_A, 1)) + ")"
_t = lambda lat: f"sinh(atanh(sin(radians({lat}))) - {_E!r} * atanh({_E!r} * sin(radians({lat}))))"
_ARC = """arc AS (SELECT lap, rn, x, y, ROUND(SUM(COALESCE(SQRT(dx * dx + dy * dy), 0e0)) OVER (PARTITION BY lap ORDER BY rn ROWS UNBOUNDED PRECEDING), 4) AS s
  FROM (SELECT *, x - LAG(x) OVER (PARTITION BY lap ORDER BY rn) AS dx, y - LAG(y) OVER (PARTITION BY lap ORDER BY rn) AS dy FROM xy) z)"""
_GRID = f"""{_ARC}, seg AS (SELECT *, LEAD(s) OVER w AS s2, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM arc WINDOW w AS (PARTITION BY lap ORDER BY s, rn)),
  gr AS (SELECT lap, CAST(i AS INT) AS gi, a + i * ((b - a) / 999) AS g FROM (SELECT lap, MIN(s) AS a, MAX(s) AS b FROM arc GROUP BY lap) e, range(1000) r(i)),
  ln AS (SELECT gr.lap, gi, g AS s, seg.x + (g - seg.s) / (s2 - seg.s) * (x2 - seg.x) AS x, seg.y + (g - seg.s) / (s2 - seg.s) * (y2 - seg.y) AS y
    FROM gr ASOF JOIN (SELECT * FROM seg WHERE s2 > s) seg ON gr.lap = seg.lap AND gr.g >= seg.s)"""
_grad = lambda f: f"CASE WHEN h IS NULL THEN (LEAD({f}) OVER w - {f}) / k WHEN k IS NULL THEN ({f} - LAG({f}) OVER w) / h ELSE (h * h * LEAD({f}) OVER w + (k * k - h * h) * {f} - k * k * LAG({f}) OVER w) / (h * k * (h + k)) END"
_CURVE = f"""{_GRID}, g1 AS (SELECT *, s - LAG(s) OVER w AS h, LEAD(s) OVER w - s AS k FROM ln WINDOW w AS (PARTITION BY lap ORDER BY gi)),
  g2 AS (SELECT *, {_grad('x')} AS x1, {_grad('y')} AS y1 FROM g1 WINDOW w AS (PARTITION BY lap ORDER BY gi)),
  g3 AS (SELECT *, {_grad('x1')} AS xx, {_grad('y1')} AS yy FROM g2 WINDOW w AS (PARTITION BY lap ORDER BY gi)),
  ku AS (SELECT lap, gi, s, ABS(x1 * yy - y1 * xx) / GREATEST(POWER(x1 * x1 + y1 * y1, 1.5e0), 1e-10) AS kappa FROM g3)"""
_hat = lambda h: "(SELECT * FROM (VALUES " + ", ".join(f"({r}, {c}, {float(h[r, c])!r})" for r in range(len(h)) for c in range(len(h))) + ") v(r, c, w))"
#: Profiles of the shaped tracks, their maxima (runs of equal values), and prominence by looking at every point between a maximum and the next higher points.
_TOPS = f"""{_CURVE.replace('FROM xy)', 'FROM shaped)')}, pr AS (SELECT lap, k1.gi AS i, s, kv AS h FROM (SELECT a.lap, a.gi, ROUND(SUM(b.kappa * w), 9) AS kv
    FROM (SELECT *, LEAST(GREATEST(gi - 10, 0), 979) AS lo FROM ku) a JOIN ku b ON a.lap = b.lap AND b.gi BETWEEN a.lo AND a.lo + 20 JOIN {_hat(signal.hat_matrix(21, 3))} h ON r = a.gi - a.lo AND c = b.gi - a.lo GROUP BY a.lap, a.gi) k1 JOIN ln USING (lap, gi)),
  p1 AS (SELECT *, COALESCE(CAST(h <> LAG(h) OVER w AS INT), 0) AS fresh, s - LAG(s) OVER w AS d FROM pr WINDOW w AS (PARTITION BY lap ORDER BY i)),
  p2 AS (SELECT *, SUM(fresh) OVER (PARTITION BY lap ORDER BY i) AS run FROM p1),
  p3 AS (SELECT lap, h, (MIN(i) + MAX(i)) // 2 AS mid, LAG(h) OVER w AS b, LEAD(h) OVER w AS a FROM p2 GROUP BY lap, run, h WINDOW w AS (PARTITION BY lap ORDER BY run)),
  c0 AS (SELECT p3.lap, mid AS i, p3.h, s, COALESCE((SELECT MAX(q.i) + 1 FROM pr q WHERE q.lap = p3.lap AND q.i < mid AND q.h > p3.h), 0) AS lo, COALESCE((SELECT MIN(q.i) - 1 FROM pr q WHERE q.lap = p3.lap AND q.i > mid AND q.h > p3.h), 999) AS hi
    FROM p3 JOIN pr ON pr.lap = p3.lap AND pr.i = mid WHERE b < p3.h AND a < p3.h),
  cd AS (SELECT *, h - GREATEST((SELECT MIN(q.h) FROM pr q WHERE q.lap = c0.lap AND q.i BETWEEN lo AND c0.i), (SELECT MIN(q.h) FROM pr q WHERE q.lap = c0.lap AND q.i BETWEEN c0.i AND hi)) AS pm FROM c0),
  stt AS (SELECT lap, quantile_cont(h, 0.75) - quantile_cont(h, 0.25) AS spread, median(d) AS step FROM p1 GROUP BY lap)"""
_EMPTY = "CAST([] AS STRUCT(i BIGINT, s DOUBLE, h DOUBLE, pm DOUBLE)[])"


def _detect(settings: list[dict[str, float]]) -> str:
    """Of each lap and setting: the peaks kept one after the other in recursive steps (bf), and after the merge (af)."""
    rows = ", ".join(f"({n}, {', '.join(f'{o[c]!r}e0' for c in signal.DEFAULT)})" for n, o in enumerate(settings))
    least = " UNION ALL ".join(f"SELECT lap, {q!r}e0 AS q, quantile_cont(h, {q!r}) AS least FROM pr GROUP BY lap" for q in sorted({o["q"] for o in settings}))
    return f"""{_TOPS}, sg AS (SELECT * FROM (VALUES {rows}) v(stage, q, gap, prom, mrg)),
      hq AS ({least}),
      ls AS (SELECT stt.lap, stage, gap, prom * spread AS pmin, mrg, CASE WHEN step > 0 THEN GREATEST(CAST(FLOOR(gap / step) AS BIGINT), 1) ELSE 10 END AS dist, least FROM stt JOIN hq USING (lap) JOIN sg USING (q)),
      oc AS (SELECT ls.lap, stage, row_number() OVER (PARTITION BY ls.lap, stage ORDER BY h DESC, i DESC) AS nth, struct_pack(i := i, s := s, h := h, pm := pm) AS t FROM ls JOIN cd ON cd.lap = ls.lap AND h >= least),
      sup AS (SELECT lap, stage, CAST(0 AS BIGINT) AS nth, {_EMPTY} AS kept FROM ls UNION ALL
        SELECT sup.lap, sup.stage, oc.nth, CASE WHEN len(list_filter(kept, lambda k: abs(k.i - t.i) < dist)) > 0 THEN kept ELSE list_append(kept, t) END FROM sup JOIN oc ON oc.lap = sup.lap AND oc.stage = sup.stage AND oc.nth = sup.nth + 1 JOIN ls ON ls.lap = sup.lap AND ls.stage = sup.stage),
      bf AS (SELECT ls.lap, ls.stage, mrg, list_sort(list_filter(arg_max(kept, nth), lambda k: k.pm >= pmin)) AS before FROM sup JOIN ls ON ls.lap = sup.lap AND ls.stage = sup.stage GROUP BY ls.lap, ls.stage, mrg, pmin),
      mg AS (SELECT lap, stage, mrg, before, CAST(0 AS BIGINT) AS nth, {_EMPTY} AS kept FROM bf UNION ALL
        SELECT lap, stage, mrg, before, nth + 1, CASE WHEN len(kept) = 0 OR before[nth + 1].s - kept[-1].s >= mrg THEN list_append(kept, before[nth + 1]) WHEN before[nth + 1].h > kept[-1].h THEN list_append(kept[:len(kept) - 1], before[nth + 1]) ELSE kept END FROM mg WHERE nth < len(before)),
      af AS (SELECT lap, stage, kept AS after FROM mg WHERE nth = len(before))"""


_SCAN = _detect([dict(zip(signal.GRID, own)) for own in itertools.product(*signal.GRID.values())]) + ", scn AS (SELECT lap, q, gap AS min_gap_m, prom AS prom_mult, mrg AS merge_gap_m, CAST(len(after) AS INT) AS apex_count FROM af JOIN sg USING (stage))"
_STAGES = len(signal.TUNING)
_COLUMNS = ("d_delta_s_iqr", "d_Ventry_iqr", "d_Vmin_iqr", "d_a_long_peak_iqr")
#: Quadratic weights in closed form, over each lap's own window: of 0.5 s for speed (w5, s5), of 0.2 s for the sensor (w2, s2).
_fit = lambda w, x, y: f"(1e0 / {w} + {x} * {y} * 12e0 / ({w} * ({w} * {w} - 1e0)) + ({x} * {x} - ({w} * {w} - 1e0) / 12e0) * ({y} * {y} - ({w} * {w} - 1e0) / 12e0) * 180e0 / ({w} * ({w} * {w} - 1e0) * ({w} * {w} - 4e0)))"
_moved = lambda name, w, value, out: f"""{name} AS (SELECT a.*, b.* EXCLUDE (e, m) FROM tw a JOIN (SELECT a.event_id AS e, 0 AS m, COUNT(*) - COUNT({value}) AS gaps, SUM({value} * {_fit('(a.' + w + ' * 1e0)', '(a.rn - 1 - a.lo' + w + ' - a.' + w + ' // 2)', '(b.rn - 1 - a.lo' + w + ' - a.' + w + ' // 2)')}) AS {out}
  FROM tw a JOIN tw b ON a.lap = b.lap AND b.rn - 1 BETWEEN a.lo{w} AND a.lo{w} + a.{w} - 1 GROUP BY a.event_id) b ON a.event_id = b.e)"""  # noqa: E731
_WINDOWS = f"""tma AS (SELECT lap, median(d) AS dt FROM (SELECT lap, t_s - LAG(t_s) OVER (PARTITION BY lap ORDER BY rn) AS d FROM timed) z GROUP BY lap),
  tmb AS (SELECT timed.*, dt, COUNT(longitudinal_acc_g) OVER (PARTITION BY lap) AS sensed, GREATEST(5, CAST(FLOOR(0.5e0 / dt) AS INT)) AS z5, GREATEST(5, CAST(FLOOR(0.2e0 / dt) AS INT)) AS z2 FROM timed JOIN tma USING (lap)),
  tu AS (SELECT *, z5 + (z5 + 1) % 2 AS w5, z2 + (z2 + 1) % 2 AS w2 FROM tmb), tw AS (SELECT *, LEAST(GREATEST(rn - 1 - w5 // 2, 0), n - w5) AS low5, LEAST(GREATEST(rn - 1 - w2 // 2, 0), n - w2) AS low2 FROM tu),
  {_moved('smv', 'w5', 'b.v', 's5')}, {_moved('smw', 'w2', 'b.longitudinal_acc_g * 9.81e0', 's2')}"""
_HEAT = "hm AS (" + " UNION ALL ".join(f"SELECT turn, '{c}' AS metric, CASE WHEN lap_count / (SELECT COUNT(DISTINCT lap) FROM dl WHERE lap <> 1) >= 0.6 THEN {c} END AS value FROM st" for c in _COLUMNS) + ")"

#: Each follows the common tables' definitions and a comma is put before its own.
ORACLES = {
    "savgol_velocity": f""", hat AS (SELECT * FROM (VALUES {', '.join(f'({r}, {c}, {float(_H[r, c])!r})' for r in range(WINDOW) for c in range(WINDOW))}) v(r, c, w)),
      sm AS (SELECT event_id, lap, v, rn - 1 AS i, n, LEAST(GREATEST(rn - 1 - {WINDOW // 2}, 0), n - {WINDOW}) AS lo FROM tel)
      SELECT a.event_id, ROUND(CASE WHEN a.n < {WINDOW} THEN a.v ELSE SUM(b.v * w) END, 6) AS smooth FROM sm a LEFT JOIN sm b ON a.lap = b.lap AND b.i >= a.lo AND b.i < a.lo + {WINDOW} AND a.n >= {WINDOW}
      LEFT JOIN hat ON r = a.i - a.lo AND c = b.i - a.lo GROUP BY a.event_id, a.n, a.v""",
    "project_tmerc": f""", pl AS (SELECT event_id, lap, 31e0 + y / 111000 AS lat, 121e0 + x / 95000 AS lon FROM xy),
      pm AS (SELECT *, lon - median(lon) OVER (PARTITION BY lap) AS dl, median(lat) OVER (PARTITION BY lap) AS lat0 FROM pl),
      pt AS (SELECT event_id, {_t('lat')} AS t, dl, {_t('lat0')} AS t0 FROM pm),
      pe AS (SELECT event_id, atan2(t, cos(radians(dl))) AS xi, asinh(sin(radians(dl)) / sqrt(t * t + cos(radians(dl)) * cos(radians(dl)))) AS eta, t0 FROM pt),
      po AS (SELECT event_id, {_x} AS x, {_y} AS y, t0 FROM pe), pz AS (SELECT event_id, {_y} AS y0 FROM (SELECT event_id, atan2(t0, 1e0) AS xi, 0e0 AS eta FROM pt) q)
      SELECT event_id, ROUND(x, 4) AS x, ROUND(y - y0, 4) AS y FROM po JOIN pz USING (event_id)""",
    "resample_centerline": f", {_GRID} SELECT lap, gi, ROUND(s, 6) AS s, ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM ln",
    "curvature": f", {_CURVE} SELECT lap, gi, ROUND(kappa, 6) AS kappa FROM ku",
    "smooth_velocity": f", {_WINDOWS} SELECT event_id, ROUND(CASE WHEN n < w5 THEN v ELSE s5 END, 6) AS v_smooth FROM smv",
    "acceleration": f""", {_WINDOWS}, ga AS (SELECT event_id, s2, gaps FROM smw), dv AS (SELECT * EXCLUDE (gaps), (CASE WHEN n < w5 THEN v ELSE s5 END) AS vs FROM smv)
      SELECT event_id, CASE WHEN sensed > 0 THEN 'sensor_g' ELSE 'dvdt' END AS source, ROUND(CASE WHEN sensed = 0 THEN (vs - LAG(vs) OVER (PARTITION BY lap ORDER BY rn)) / dt WHEN n < w2 THEN 9.81e0 * longitudinal_acc_g WHEN gaps = 0 THEN s2 END, 6) + 0e0 AS a_long FROM dv JOIN ga USING (event_id)""",
    "apex_peaks": f", {_detect([signal.DEFAULT])} SELECT lap, CAST(z.turn AS INT) AS turn, ROUND(after[z.turn].s, 6) AS s_apex, after[z.turn].h AS kappa FROM af, LATERAL (SELECT unnest(range(1, len(after) + 1)) AS turn) z",
    "apex_scan": f", {_SCAN} SELECT *, apex_count BETWEEN 12 AND 16 AS in_target FROM scn",
    "apex_candidates": f", {_SCAN} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lap ORDER BY q, min_gap_m, prom_mult, merge_gap_m) AS INT) AS place FROM scn WHERE apex_count BETWEEN 12 AND 16) z WHERE place <= 10",
    "apex_autotune": f""", {_detect(signal.TUNING)}, hit AS (SELECT lap, MIN(stage) FILTER (len(after) BETWEEN 12 AND 16) AS first FROM af GROUP BY lap)
      SELECT lap, q, gap AS min_gap_m, prom AS prom_mult, mrg AS merge_gap_m, CAST(len(after) AS INT) AS apex_count FROM af JOIN hit USING (lap) JOIN sg USING (stage) WHERE stage = COALESCE(first, {_STAGES - 1})""",
    "curvature_debug": f""", {_detect([signal.DEFAULT])} SELECT pr.lap, CAST(len(list_filter(before, lambda b: b.i = pr.i)) AS INT) AS is_peak, ROUND(s, 6) AS s, h AS kappa_s,
      CASE WHEN len(list_filter(before, lambda b: b.i = pr.i)) > 0 THEN ROUND(s, 6) END AS peak_s_before_merge, CASE WHEN len(list_filter(after, lambda b: b.i = pr.i)) > 0 THEN ROUND(s, 6) END AS peak_s_after_merge FROM pr JOIN bf USING (lap) JOIN af USING (lap)""",
    "nearest_apex_xy": f""", {_ARC}, tg AS (SELECT CAST(l AS INT) AS lap, CAST(i + 1 AS INT) AS turn, 146e0 + 270.35e0 * i AS s_apex FROM range(12) a(l), range(16) b(i))
      SELECT tg.lap, turn, s_apex, arg_min(x, (ABS(s - s_apex), rn)) AS x, arg_min(y, (ABS(s - s_apex), rn)) AS y FROM tg LEFT JOIN arc ON arc.lap = tg.lap GROUP BY tg.lap, turn, s_apex""",
    "nearest_overview_xy": f""", {_ARC} SELECT CAST(i + 1 AS INT) AS turn, 146e0 + 270.35e0 * i AS s_apex, (SELECT arg_min(x, (ABS(s - 146e0 - 270.35e0 * i), lap, rn)) FROM arc) AS x, (SELECT arg_min(y, (ABS(s - 146e0 - 270.35e0 * i), lap, rn)) FROM arc) AS y FROM range(16) b(i)""",
    "csv_ingest": """ SELECT CAST(lap % 3 AS INT) AS session, event_id AS row, ROUND(t_s, 6) AS t_s, ROUND(31e0 + y / 111000, 6) AS lat, ROUND(121e0 + x / 95000, 6) AS lon, ROUND(v * 3.6e0 / 3.6e0, 6) AS v, l AS lap
      FROM (SELECT *, CAST(COALESCE(LAST_VALUE(CASE WHEN event_id % 4 = 0 THEN lap END IGNORE NULLS) OVER (PARTITION BY lap % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS INT) AS l FROM xy) z WHERE event_id % 50 <> 0""",
    "advice_rank": """ SELECT turn, ROUND(raw / MAX(raw) OVER (), 6) AS composite, CAST(ROW_NUMBER() OVER (ORDER BY raw DESC, turn) AS INT) AS rank FROM (SELECT turn,
      COALESCE(5e-1 * d_delta_s_iqr, 0e0) + COALESCE(3e-1 * d_Vmin_iqr, 0e0) + COALESCE(1e-1 * d_Ventry_iqr, 0e0) + COALESCE(1e-1 * d_a_long_peak_iqr, 0e0) AS raw FROM st) z""",
    "heatmap_norm": f""", {_HEAT}, hq AS (SELECT metric, quantile_cont(value, 0.95) AS top FROM hm GROUP BY metric)
      SELECT turn, metric, ROUND(CASE WHEN value IS NULL THEN NULL WHEN top > 0 THEN GREATEST(LEAST(value / top, 1e0), 0e0) ELSE 0e0 END, 6) AS value FROM hm JOIN hq USING (metric)""",
    "heatmap_meta": f", {_HEAT} SELECT metric, ROUND(MIN(value), 6) AS least, ROUND(MAX(value), 6) AS most, ROUND(AVG(value), 6) AS mean, ROUND(quantile_cont(value, 0.95), 6) AS q95 FROM hm GROUP BY metric",
}
