"""Corner cards to issues: deltas to a benchmark lap, rule events, stability, scores."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.operators import ordered

Keys = Sequence[str]

METRICS = ("d_delta_s", "d_Ventry", "d_Vmin", "d_Vexit", "d_a_long_peak")


#: What a card holds, and its differences to the benchmark's.
BASE = {"d_delta_s": "delta_s_to_apex_m", "d_Ventry": "Ventry", "d_Vmin": "Vmin", "d_Vexit": "Vexit", "d_a_long_peak": "a_long_peak"}
#: Types of events and what their rules say of the reference: fixed texts of the format.
FLAGS = {"late_brake": '{"delta_s": "late"}', "early_brake": '{"delta_s": "early"}', "overslow": '{"vmin": "lower"}', "weak_exit": '{"vexit": "lower", "a_long_peak": "weak"}'}


def against(cards: DataFrame, benchmark: int | DataFrame, keys: Keys = ()) -> DataFrame:
    """+ _benchmark: the lap that a session is compared with, one number for all or a table (keys, lap), null without one."""
    if not isinstance(benchmark, DataFrame):
        return cards.withColumn("_benchmark", F.lit(benchmark))
    return ordered.looked_up(cards, benchmark.groupBy(*keys).agg(F.min("lap").alias("_benchmark")), keys)


def others(cards: DataFrame, benchmark: int | DataFrame, keys: Keys = ()) -> DataFrame:
    """Cards of other laps than the benchmark; of a session without one, none."""
    return against(cards, benchmark, keys).where("lap <> _benchmark").drop("_benchmark")


def checked(cards: DataFrame, benchmark: int) -> DataFrame:
    """The cards, or ValueError: columns are missing, all turns are null, or the benchmark lap has no card."""
    need = {"lap", "turn"} - set(cards.columns)
    if need:
        raise ValueError(f"corner cards lack the columns {', '.join(sorted(need))}")
    if "delta_s_to_apex_m" not in cards.columns and not {"s_apex", "s_brake_onset"} <= set(cards.columns):
        raise ValueError("corner cards need delta_s_to_apex_m, or s_apex and s_brake_onset")
    if benchmark is None:
        raise ValueError("no benchmark lap given")
    seen = cards.where("turn is not null").agg(F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("lap") == benchmark, 1)).alias("own")).first()
    if not seen.turns:
        raise ValueError("no card has a turn")
    if not seen.own:
        raise ValueError(f"no card of benchmark lap {benchmark}")
    return cards


def deltas(cards: DataFrame, benchmark: int | DataFrame, keys: Keys = (), earlier: DataFrame | None = None) -> DataFrame:
    """+ delta_s_to_apex_m, unless it is there, and the differences of each metric to the benchmark lap's card of that turn.

    earlier: cards of a lap of another session, with the keys of the sessions that they are the benchmark of. Of several
    benchmark cards of a turn the first by lap and values counts; without one, differences are null.
    """
    rows = cards if "delta_s_to_apex_m" in cards.columns else cards.withColumn("delta_s_to_apex_m", F.col("s_apex") - F.col("s_brake_onset"))
    order = [c for c in ("lap", "s_apex", *BASE.values()) if c in rows.columns]
    own = against(rows, benchmark, keys).where("lap = _benchmark").drop("_benchmark")
    if earlier is not None:
        taken = ordered.looked_up(own, earlier.select(*keys).distinct().withColumn("_taken", F.lit(True)), keys)
        own = taken.where("_taken is null").drop("_taken").unionByName(earlier, allowMissingColumns=True)
    best = own.groupBy(*keys, "turn").agg(F.min_by(F.struct(*BASE.values()), F.struct(*order)).alias("_pb"))
    rows = ordered.looked_up(rows, best, (*keys, "turn"))
    return rows.withColumns({d: F.col(c) - F.col(f"_pb.{c}") for d, c in BASE.items()}).drop("_pb")


def absolute_events(cards: DataFrame, brake_g: float = -0.28, entry_factor: float = 1.3, keys: Keys = ()) -> DataFrame:
    """(keys, lap, turn, type, a_long_peak_g, delta_s_to_apex_m, Ventry, Vmin): hard braking, slow entries."""
    g = F.col("a_long_peak") / 9.81
    heavy = cards.where(g < brake_g).select(*keys, "lap", "turn", F.lit("heavy_brake").alias("type"), g.alias("a_long_peak_g"), (F.col("s_apex") - F.col("s_brake_onset")).alias("delta_s_to_apex_m"))
    slow = cards.where(F.col("Ventry") < entry_factor * F.col("Vmin")).select(*keys, "lap", "turn", F.lit("conservative_entry").alias("type"), "Ventry", "Vmin")
    return heavy.unionByName(slow, allowMissingColumns=True)


def rule_events(cards: DataFrame, benchmark: int | DataFrame, keys: Keys = (), late_m: float = 7.0, early_m: float = 12.0, slow_ms: float = 1.2, exit_ms: float = 1.5, exit_g: float = 0.25) -> DataFrame:
    """Events as relative_events() gives them, but without event_id: no shuffle."""
    g = F.col("a_long_peak") / 9.81
    weak = F.abs(g)
    rules = (
        ("late_brake", F.col("d_delta_s") < -late_m, F.abs("d_delta_s") - late_m),
        ("early_brake", F.col("d_delta_s") > early_m, F.col("d_delta_s") - early_m),
        ("overslow", F.col("d_Vmin") < -slow_ms, F.abs("d_Vmin") - slow_ms),
        ("weak_exit", (F.col("d_Vexit") < -exit_ms) & (weak < exit_g), F.greatest(F.abs("d_Vexit") - exit_ms, F.lit(0.0)) + F.greatest(exit_g - weak, F.lit(0.0))),
    )
    found = F.array(*(F.when(rule, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), F.lit(FLAGS[kind]).alias("ref_flags"))) for kind, rule, severity in rules))
    values = ("delta_s_to_apex_m", "Ventry", "Vmin", "Vexit", "d_delta_s", "d_Ventry", "d_Vmin", "d_Vexit")
    rows = others(cards, benchmark, keys).select(*keys, "lap", "turn", *values, g.alias("a_long_peak_g"), F.explode(F.array_compact(found)).alias("_e"))
    rows = rows.select(*keys, "lap", "turn", "_e.type", "_e.severity", "_e.ref_flags", F.lit("rule_v1").alias("source"), *values, "a_long_peak_g")
    return rows.where((F.col("severity") > 0) & (F.col("severity") < float("inf")))


def relative_events(cards: DataFrame, benchmark: int | DataFrame, keys: Keys = (), **rules: float) -> DataFrame:
    """(keys, lap, turn, type, severity, ref_flags, source, values of the card, event_id) of cards with deltas, other laps than the benchmark's.

    Comparisons are strict; severities that are not finite are no events. The number in event_id counts a session's events of a type in (lap, turn)
    order, over ranges of events, so a type may have any number of them.
    """
    rows = ordered.running_total(rule_events(cards, benchmark, keys, **rules), [*keys, "type"], ["lap", "turn", "severity"], 1, "_count")
    return rows.withColumn("event_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("lap", "turn", "type", "_count")))).drop("_count")


def by_turn(events: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, turn, events_count, max_severity, sample_event_id, top_types) with at most three types, frequent first."""
    order, turn = ("lap", "turn", "type"), [*keys, "turn"]
    severity = F.coalesce("severity", F.lit(0.0))
    best = F.struct(severity, *(-F.col(c) for c in order[:2]))
    kinds = events.groupBy(*turn, "type").agg(F.count("*").alias("n"), F.min("lap").alias("first"), F.max(severity).alias("most"), F.max_by("event_id", best).alias("id"), F.max(best).alias("best"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "type"))), 1, 3)
    return kinds.groupBy(*turn).agg(F.sum("n").alias("events_count"), F.max("most").alias("max_severity"), F.max_by("id", "best").alias("sample_event_id"), F.array_join(F.transform(top, lambda x: x["type"]), ", ").alias("top_types"))


def long_metrics(cards: DataFrame, keys: Keys = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """(keys, lap, turn, metric, value): a row for each card and metric; NaN counts as null."""
    rows = cards.select(*keys, "lap", "turn", *(F.nullif(F.col(m).cast("double"), F.lit(float("nan"))).alias(m) for m in metrics))
    return rows.unpivot([*keys, "lap", "turn"], list(metrics), "metric", "value")


def wide_metrics(long: DataFrame, values: Sequence[str], keys: Keys = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """(keys, turn, metric_value ...): the way back, a row for each turn; what a turn has no row of is null."""
    out = long.groupBy(*keys, "turn").pivot("metric", list(metrics)).agg(*(F.first(v).alias(v) for v in values))
    return out.withColumnsRenamed({m: f"{m}_{values[0]}" for m in metrics}) if len(values) == 1 else out  # pivot names a single value by the metric alone


def stability(cards: DataFrame, benchmark: int | DataFrame, keys: Keys = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """A wide row of exact statistics per turn over the other laps: coverage, quartiles, mean, deviation.

    Metrics become rows, are summed up by turn and metric, and become columns again. Quartiles are picked from values ranked
    over ranges, so a turn may have any number of laps. Null values don't count; a metric without any has null
    statistics and count 0; cards without turn are left out.
    """
    rows = others(cards, benchmark, keys).where("turn is not null")
    long = long_metrics(rows, keys, metrics).where("value is not null").select(*keys, "turn", "metric", "value")
    both = long.select(*keys, "turn", "metric", F.inline(F.array(*(F.struct(F.lit(size).alias("size"), v.alias("v")) for size, v in ((False, F.col("value")), (True, F.abs("value")))))))
    by = [*keys, "turn", "metric"]
    found = ordered.quantiles(both, [*by, "size"], "v", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    found = found.withColumn("iqr", F.col("q75") - F.col("q25"))
    parts = [F.max(F.when(~F.col("size"), F.col(c))).alias(c) for c in ("median", "q25", "q75", "iqr")] + [F.max(F.when(F.col("size"), F.col(c))).alias(f"abs_{c}") for c in ("median", "iqr")]
    own = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("count"))
    names = ("median", "q25", "q75", "iqr", "mean", "std", "count", "abs_median", "abs_iqr")
    wide = wide_metrics(ordered.looked_up(found.groupBy(*by).agg(*parts), own, by, "inner"), names, keys, metrics)
    laps = rows.groupBy(*keys, "turn").agg(F.count_distinct("lap").cast("int").alias("lap_count"))
    total = rows.groupBy(*keys).agg(F.count_distinct("lap").cast("int").alias("total_laps"))
    out = ordered.looked_up(ordered.looked_up(laps, wide, (*keys, "turn")), total, keys, "inner")
    named = [*((f"{m}_{n}", f"{m}_{n}") for m in metrics for n in names[:7]), *((f"{m}_abs_{n}", f"{short}_|{m}|") for m in metrics for n, short in (("median", "med"), ("iqr", "iqr")))]
    columns = [F.coalesce(old, F.lit(0)).alias(new) if old.endswith("_count") else F.col(old).alias(new) for old, new in named]
    return out.select(*keys, "turn", "lap_count", *columns, "total_laps", (F.col("lap_count") / F.col("total_laps")).alias("coverage"))


def stability_numbers(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, turns, most, mean): how many turns a stability report has, and the largest and mean spread among its metrics."""
    spreads = F.explode(F.array(*(F.col(f"{m}_iqr") for m in METRICS)))
    numbers = report.select(*keys, spreads.alias("_x")).groupBy(*keys).agg(F.max("_x").alias("most"), F.avg("_x").alias("mean"))
    turns = report.groupBy(*keys).agg(F.count(F.lit(1)).alias("turns"))
    return ordered.looked_up(turns, numbers, keys, "inner")


WEIGHTS = {"d_delta_s_iqr": 0.5, "d_Vmin_iqr": 0.3, "d_a_long_peak_iqr": 0.2}


def stability_score(report: DataFrame, keys: Keys = (), weights: dict[str, float] | None = None) -> DataFrame:
    """(keys, turn, stability_score): weighted spreads over the 95 % point of the positive ones of the session, up to 1 each."""
    own = W.partitionBy(*keys)
    weights = weights or WEIGHTS
    tops = report.withColumns({f"_q{i}": F.percentile(F.when(F.col(c) > 0, F.col(c)), 0.95).over(own) for i, c in enumerate(weights)})
    parts = [F.coalesce(w * F.greatest(F.least(F.col(c) / F.col(f"_q{i}"), F.lit(1.0)), F.lit(0.0)), F.lit(0.0)) for i, (c, w) in enumerate(weights.items())]
    return tops.select(*keys, "turn", functools.reduce(Column.__add__, parts).alias("stability_score"))


def fallback_score(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, turn, stability_score): where no scores can be computed from positive spreads, the raw weighted spreads over their largest sum."""
    weights = {"d_delta_s_iqr": 0.5, "d_Vmin_iqr": 0.3, "d_Ventry_iqr": 0.1, "d_a_long_peak_iqr": 0.1}
    raw = functools.reduce(Column.__add__, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()))
    rows = report.select(*keys, "turn", raw.alias("_raw"))
    return rows.select(*keys, "turn", F.coalesce(F.col("_raw") / F.nullif(F.max("_raw").over(W.partitionBy(*keys)), F.lit(0.0)), F.lit(0.0)).alias("stability_score"))


def advice_rank(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, turn, composite, rank): raw spreads weighted over the session's largest sum; rank 1 is the least stable, ties by turn.

    No rank if nothing is spread.
    """
    weights = {"d_delta_s_iqr": 0.5, "d_Vmin_iqr": 0.3, "d_Ventry_iqr": 0.1, "d_a_long_peak_iqr": 0.1}
    raw = functools.reduce(Column.__add__, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()))
    own = W.partitionBy(*keys)
    rows = report.select(*keys, "turn", raw.alias("raw")).withColumn("most", F.max("raw").over(own))
    rank = F.row_number().over(own.orderBy(F.desc("raw"), "turn"))
    return rows.select(*keys, "turn", F.when(F.col("most") > 0, F.col("raw") / F.col("most")).alias("composite"), F.when(F.col("most") > 0, rank).alias("rank"))


def heatmap(report: DataFrame, columns: Sequence[str] = ("d_delta_s_iqr", "d_Ventry_iqr", "d_Vmin_iqr", "d_a_long_peak_iqr"), least_coverage: float = 0.6, normalise: bool = True, keys: Keys = ()) -> DataFrame:
    """(keys, turn, metric, value): turns of enough coverage; normalised, over the metric's 95 % point and within 0 to 1."""
    long = report.select(*keys, "turn", "coverage", F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("metric", "raw"))
    long = long.withColumn("value", F.when(F.col("coverage") >= least_coverage, F.col("raw")))
    top = F.percentile("value", 0.95).over(W.partitionBy(*keys, "metric"))
    if normalise:
        long = long.withColumn("top", top).withColumn("value", F.when(F.col("value").isNull(), None).when(F.col("top") > 0, F.greatest(F.least(F.col("value") / F.col("top"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0))
    return long.select(*keys, "turn", "metric", "value")


def heatmap_meta(report: DataFrame, columns: Sequence[str] = ("d_delta_s_iqr", "d_Ventry_iqr", "d_Vmin_iqr", "d_a_long_peak_iqr"), least_coverage: float = 0.6) -> DataFrame:
    """(metric, least, most, mean, q95) of the values that the heat map shows."""
    long = heatmap(report, columns, least_coverage, normalise=False)
    return long.groupBy("metric").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("q95"))


def turn_stats(report: DataFrame, events: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, turn, medians of absolute differences, and events of the turn), from a stability report and events; nothing counts as 0."""
    rows = report.select(*keys, "turn", *(F.coalesce(F.col(f"{a}_|{m}|"), F.lit(0.0)).alias(f"{a}_|{m}|") for m in ("d_delta_s", "d_Vmin") for a in ("med", "iqr")))
    out = ordered.looked_up(rows, by_turn(events, keys), (*keys, "turn"))
    return out.withColumns({"events_count": F.coalesce("events_count", F.lit(0)), "max_severity": F.coalesce("max_severity", F.lit(0.0)), "top_types": F.coalesce("top_types", F.lit("-")), "sample_event_id": F.coalesce("sample_event_id", F.lit(""))})


def scores(stats: DataFrame, keys: Keys = ()) -> DataFrame:
    """+ comp_s, comp_v, comp_sev, comp_freq and their weighted sum, score; a session's turns are its only rows in a window."""
    source = {"comp_s": "med_|d_delta_s|", "comp_v": "med_|d_Vmin|", "comp_sev": "max_severity"}
    own = W.partitionBy(*keys)
    out = stats.withColumns({f"_q_{k}": F.coalesce(F.percentile(c, 0.95).over(own), F.lit(0.0)) for k, c in source.items()})
    out = out.withColumns({k: 10.0 * F.least(F.col(c) / F.greatest(F.col(f"_q_{k}"), F.lit(1e-6)), F.lit(1.0)) for k, c in source.items()})
    out = out.withColumn("comp_freq", F.least(F.log1p(F.col("events_count").cast("double")), F.lit(3.0)))
    return out.withColumn("score", F.col("comp_s") + 0.8 * F.col("comp_v") + 0.6 * F.col("comp_sev") + 0.3 * F.col("comp_freq")).drop(*(f"_q_{k}" for k in source))


def composite(scored: DataFrame, stable: DataFrame, weight: float = 0.3, keys: Keys = ()) -> DataFrame:
    """+ stability_score and composite_score: both scores on 0 to 1, blended, on the issue scores' scale."""
    own = W.partitionBy(*keys)
    stable = stable.select(*keys, "turn", F.col("stability_score").alias("_s"), F.min("stability_score").over(own).alias("_s0"), F.max("stability_score").over(own).alias("_s1"))
    rows = ordered.looked_up(scored, stable, (*keys, "turn"))
    rows = rows.withColumns({"stability_score": F.coalesce("_s", F.lit(0.0)), "_s0": F.max("_s0").over(own), "_s1": F.max("_s1").over(own), "_i0": F.min("score").over(own), "_i1": F.max("score").over(own)})
    part = lambda c, low, high: F.coalesce((F.col(c) - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0)), F.lit(0.0))
    blend = (1 - weight) * part("score", "_i0", "_i1") + weight * part("stability_score", "_s0", "_s1")
    flat = F.col("_i1") == F.col("_i0")
    return rows.withColumn("composite_score", F.when(flat, F.col("score")).otherwise(F.col("_i0") + blend * (F.col("_i1") - F.col("_i0")))).drop("_s", "_s0", "_s1", "_i0", "_i1")


def top_issues(scored: DataFrame, k: int = 8, keys: Keys = ()) -> DataFrame:
    """The k turns of each session with the highest composite scores; ties by turn."""
    if not keys:
        return scored.orderBy(F.desc("composite_score"), "turn").limit(max(1, k))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("composite_score"), "turn"))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= max(1, k)).drop("_rank")
