"""From telemetry files to issues and reports in one call, for all sessions of a folder at once.

``python -m apexlake.run --csv FOLDER --outdir STORE --analyze-issues --generate-advice --preset high_speed_track``
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.operators import issues, laps, ordered, reporting, signal
from apexlake.sources import sessions, telemetry

KEYS = ("session",)
#: The parameters of an analysis, and presets as what they change.
DEFAULT: dict[str, float] = {
    "smooth_win_sec": 0.5, "apex_height_quantile": 0.78, "min_turn_gap_m": 65.0, "apex_prom_mult": 0.60, "post_merge_gap_m": 45.0, "segment_window_m": 60.0, "brake_thr_g": -0.28, "brake_onset_thr_g": -0.15,
    "late_brake_thr_m": 7.0, "early_brake_thr_m": 12.0, "overslow_thr_ms": 1.2, "weak_exit_thr_ms": 1.5, "weak_exit_adecel_g": 0.25, "stability_weight": 0.3, "topk": 8,
}
PRESETS: dict[str, dict[str, Any]] = {
    "default": {"description": "Default parameter configuration"},
    "sows_track": {"description": "SOWS track preset (12-16 turns)", "apex_height_quantile": 0.75},
    "high_speed_track": {
        "description": "High-speed track preset", "apex_height_quantile": 0.80, "min_turn_gap_m": 75.0, "apex_prom_mult": 0.70, "post_merge_gap_m": 50.0, "segment_window_m": 70.0, "brake_thr_g": -0.30, "brake_onset_thr_g": -0.18,
        "late_brake_thr_m": 8.0, "early_brake_thr_m": 15.0, "overslow_thr_ms": 1.5, "weak_exit_thr_ms": 2.0, "weak_exit_adecel_g": 0.30, "stability_weight": 0.25, "topk": 10,
    },
    "technical_track": {
        "description": "Technical track preset (multiple turns)", "apex_height_quantile": 0.70, "min_turn_gap_m": 55.0, "apex_prom_mult": 0.55, "post_merge_gap_m": 40.0, "segment_window_m": 55.0, "brake_thr_g": -0.25, "brake_onset_thr_g": -0.12,
        "late_brake_thr_m": 6.0, "early_brake_thr_m": 10.0, "overslow_thr_ms": 1.0, "weak_exit_thr_ms": 1.2, "weak_exit_adecel_g": 0.20, "stability_weight": 0.35, "topk": 12,
    },
}


def settings(preset: str | None = None, flags: Mapping[str, Any] | None = None, config: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The parameters: defaults, then flags, then the preset, which overrules both. config: a document whose ``presets`` join the known ones.

    An unknown preset, and what a preset holds beyond the parameters, is passed over.
    """
    known = {**{n: DEFAULT | own for n, own in PRESETS.items()}, **(config or {}).get("presets", {})}
    chosen = {k: v for k, v in known.get(preset or "", {}).items() if k in DEFAULT}
    return DEFAULT | {k: v for k, v in (flags or {}).items() if k in DEFAULT and v is not None} | chosen


def prepared(rows: DataFrame, p: Mapping[str, Any], keep_warmup: bool = False) -> DataFrame:
    """Telemetry (session, t_s, lat, lon, v, lap, longitudinal_acc_g, rid) with rn, x, y, s, v_smooth, a_long, source and jerk, without laps that don't count."""
    rows = signal.project(rows, KEYS).withColumn("rn", F.row_number().over(W.partitionBy(*KEYS).orderBy("rid")))
    rows = rows if keep_warmup else laps.drop_warmup(rows, KEYS)
    rows = ordered.kept(laps.drop_incomplete(rows, keys=KEYS))
    steps = ordered.kept(laps.median_dt(rows, ["rn"], KEYS))
    rows = laps.arc_length(rows, keys=KEYS)
    rows = signal.smoothed(rows, "v", "v_smooth", p["smooth_win_sec"], steps, keys=KEYS)
    rows = signal.acceleration(rows, steps, keys=KEYS)
    rows = ordered.looked_up(rows, steps, KEYS)
    return ordered.kept(laps.derivative(rows, "a_long", "jerk", F.col("dt"), keys=KEYS).drop("dt"))


def centerline(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(session, gi, s, kappa): smoothed curvature along each session's reference lap, or along all its laps if it has no such lap."""
    own = ordered.looked_up(rows, reference.select(*KEYS, F.col("lap").alias("_ref")), KEYS)
    own = own.withColumn("_there", F.max((F.col("lap") == F.col("_ref")).cast("int")).over(W.partitionBy(*KEYS)))
    own = own.where("lap = _ref or coalesce(_there, 0) = 0")
    line = signal.curvature(signal.resample(own, keys=KEYS), keys=KEYS)
    return signal.savgol(line, "kappa", "kappa_s", 21, 3, "gi", KEYS).select(*KEYS, "gi", "s", F.col("kappa_s").alias("kappa"))


def analysed(rows: DataFrame, p: Mapping[str, Any], mode: str = "fastest", lap: int | None = None, tune: bool = False, target: tuple[int, int] = (12, 16), scan: bool = False, keep_warmup: bool = False, best: DataFrame | None = None, earlier: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of an analysis, each over all sessions.

    best: (session, lap, laptime_s) of kept bests, which stand for a session's own reference lap unless it is strictly faster;
    earlier: (session, cards ...) of these laps. Sessions without laps or profiles have no rows further on.
    """
    rows = prepared(rows, p, keep_warmup)
    own = ordered.kept(laps.reference_lap(laps.lap_times(rows, KEYS), mode, lap, keys=KEYS))
    reference = own if best is None else ordered.kept(sessions.benchmark(own, best))
    line = ordered.kept(centerline(rows, reference))
    base = {"q": p["apex_height_quantile"], "min_gap_m": p["min_turn_gap_m"], "prom_mult": p["apex_prom_mult"], "merge_gap_m": p["post_merge_gap_m"]}
    found = ordered.kept(signal.hits(line, KEYS, *target, **base) if tune else signal.detected(line, KEYS, [base]))
    apexes = ordered.kept(signal.numbered(found, KEYS).select(*KEYS, "turn", "s_apex"))
    samples = laps.long_enough(rows.select(*KEYS, "lap", "rn", "s", F.col("v_smooth").alias("v"), "a_long", "jerk"), keys=KEYS)
    cards = laps.corner_metrics(samples, apexes, p["segment_window_m"], brake_g=p["brake_onset_thr_g"], keys=KEYS)
    if earlier is not None:
        old = reference.where("mode = 'historical_pb'").select(*KEYS)
        earlier = earlier.join(old, list(KEYS), "left_semi")
    cards = ordered.kept(issues.deltas(ordered.kept(cards), reference.select(*KEYS, "lap"), KEYS, earlier))
    rules = {"late_m": p["late_brake_thr_m"], "early_m": p["early_brake_thr_m"], "slow_ms": p["overslow_thr_ms"], "exit_ms": p["weak_exit_thr_ms"], "exit_g": p["weak_exit_adecel_g"]}
    events = ordered.kept(issues.relative_events(cards, reference.select(*KEYS, "lap"), KEYS, **rules))
    absolute = issues.absolute_events(cards, p["brake_thr_g"], keys=KEYS)
    report = ordered.kept(issues.stability(cards, reference.select(*KEYS, "lap"), KEYS))
    scored = issues.scores(issues.turn_stats(report, events, KEYS), KEYS)
    ranked = issues.composite(scored, issues.stability_score(report, KEYS), p["stability_weight"], KEYS)
    out = {
        "benchmark_lap": reference.withColumn("is_historical_pb", F.col("mode") == "historical_pb"), "corner_cards": cards, "events": absolute.unionByName(events, allowMissingColumns=True), "stability_report": report,
        "consistency_values": issues.heatmap(report, keys=KEYS, normalise=False).withColumn("kind", F.lit("raw")).unionByName(issues.heatmap(report, keys=KEYS).withColumn("kind", F.lit("norm"))),
        "top_issues": issues.top_issues(ranked, int(p["topk"]), KEYS), "apex_params": found.select(*KEYS, *(f"setting.{c}" for c in signal.DEFAULT), F.size("after").alias("apex_count")),
        "curvature_debug": signal.curvature_debug(line, KEYS, found),
    }
    if scan:
        out["apex_scan"] = signal.scan(line, KEYS, *target)
    return out


def run(spark: SparkSession, path: str, root: str, p: Mapping[str, Any], track: str = "track", date: str | None = None, overrides: Mapping[str, str] | None = None, unit: str = "auto", memory: bool = True, advice: DataFrame | None = None, **options: Any) -> dict[str, DataFrame]:
    """Analyses every file of a folder as a session, writes its tables and reports to the store, and keeps new bests of the track."""
    read = telemetry.read_text(spark, path).withColumn("session", F.regexp_replace("file", r"\.[A-Za-z]+$", "")).drop("file")
    rows = ordered.kept(telemetry.canonical(read, overrides, unit, KEYS))
    kept = sessions.current_bests(spark, root).where(F.col("track") == track) if memory else None
    best = earlier = None
    if kept is not None and not kept.isEmpty():
        record = kept.first()
        best = rows.select(*KEYS).distinct().crossJoin(F.broadcast(kept.select("lap", "laptime_s")))
        cards = sessions.history(spark, root, record.session, record.lap)
        if cards is not None:
            earlier = rows.select(*KEYS).distinct().crossJoin(F.broadcast(cards.drop("session", "date", *issues.METRICS)))
    tables = {name: ordered.kept(t) for name, t in analysed(rows, p, best=best, earlier=earlier, **options).items()}
    for name, table in tables.items():
        sessions.save_all(table, root, name, date)
    every = ordered.kept(rows.select(*KEYS).distinct())
    reporting.write(reporting.coaching(tables["top_issues"], tables["stability_report"], advice, sessions=every), f"{root}/coaching_advice_report", KEYS)
    by_rule = tables["events"].where("event_id is not null")
    reporting.write(reporting.event_summary(tables["events"], issues.by_turn(by_rule, KEYS), tables["top_issues"], every), f"{root}/events_summary", KEYS)
    if memory:
        new = tables["benchmark_lap"].where("not is_historical_pb")
        sessions.update_bests(new.select(F.lit(track).alias("track"), "lap", "laptime_s", "session", F.coalesce(F.lit(date), F.current_date().cast("string")).alias("date")), root)
    return tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Track driving data analysis on Spark")
    out.add_argument("--csv", help="file or folder of telemetry")
    out.add_argument("--outdir", default="output")
    out.add_argument("--ref-lap", default="fastest", help="fastest, median or a lap's number")
    for name in ("lat", "lon", "time", "speed", "lap", "along"):
        out.add_argument(f"--{name}-col")
    out.add_argument("--speed-unit", choices=("auto", "ms", "kmh", "mph"), default="auto")
    for name, value in DEFAULT.items():
        out.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    out.add_argument("--apex-target-min", type=int, default=12)
    out.add_argument("--apex-target-max", type=int, default=16)
    for name in ("apex-auto-tune", "apex-scan", "keep-warmup-cooldown", "no-pb-memory", "list-presets"):
        out.add_argument(f"--{name}", action="store_true")
    out.add_argument("--preset")
    out.add_argument("--config-file")
    out.add_argument("--save-config")
    out.add_argument("--track", default="track")
    out.add_argument("--session-date")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if there is nothing to read."""
    a = parser().parse_args(argv)
    if a.list_presets:
        print("\n".join(f"{name}: {own['description']}" for name, own in PRESETS.items()))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    config = sessions.read_document(spark, a.config_file, {}) if a.config_file else {}
    p = settings(a.preset, vars(a), config)
    if a.save_config:
        sessions.save_document(spark, p, a.save_config)
    if not a.csv or not sessions.exists(spark, a.csv):
        print(f"no such path: {a.csv}")
        return 1
    columns = {"lat": a.lat_col, "lon": a.lon_col, "t_s": a.time_col, "v": a.speed_col, "lap": a.lap_col, "longitudinal_acc_g": a.along_col}
    given = int(a.ref_lap) if a.ref_lap.isdigit() and int(a.ref_lap) > 0 else None
    tables = run(
        spark, a.csv, a.outdir, p, a.track, a.session_date, {k: v for k, v in columns.items() if v}, a.speed_unit, not a.no_pb_memory,
        mode="median" if a.ref_lap == "median" else "fastest", lap=given, tune=a.apex_auto_tune, target=(a.apex_target_min, a.apex_target_max), scan=a.apex_scan, keep_warmup=a.keep_warmup_cooldown,
    )
    print(json.dumps({name: table.count() for name, table in tables.items()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
