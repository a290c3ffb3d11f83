"""Laps and trajectories: lap times, filters, the reference lap, arc length and derivatives.

Frames are keyed by lap; a ``keys`` argument adds columns, such as a session, that partition all windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]


def _whole(keys: Keys) -> W:
    return W.partitionBy(*keys)


def lap_times(tel: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, lap, t_min, t_max, samples, laptime_s)"""
    out = tel.groupBy(*keys, "lap").agg(F.min("t_s").alias("t_min"), F.max("t_s").alias("t_max"), F.count("t_s").alias("samples"))
    return out.withColumn("laptime_s", F.col("t_max") - F.col("t_min"))


def drop_warmup(tel: DataFrame, keys: Keys = ()) -> DataFrame:
    """Without lap 0 and the last lap, if there is more than one lap."""
    laps = tel.groupBy(*keys, "lap").agg(F.lit(1).alias("one"))
    ends = laps.groupBy(*keys).agg(F.max("lap").alias("last"), F.count("*").alias("laps"))
    joined = tel.join(ends, list(keys)) if keys else tel.crossJoin(F.broadcast(ends))
    gone = (F.col("laps") > 1) & ((F.col("lap") == 0) | ((F.col("lap") == F.col("last")) & (F.col("last") > 0)))
    return joined.where(~F.coalesce(gone, F.lit(False))).drop("last", "laps")


def completeness(xy: DataFrame, order: str = "rn", least_rows: int = 100, least_share: float = 0.9, most_gap_m: float = 40.0, keys: Keys = ()) -> DataFrame:
    """(keys, lap, samples, duration, gap_m, keep): laps with a short duration or an open loop are not kept.

    Laps with less than ``least_rows`` rows are kept unjudged.
    """
    ends = xy.groupBy(*keys, "lap").agg(
        F.count("*").alias("samples"),
        *(f(c, order).alias(f"{c}_{name}") for c in ("t_s", "x", "y") for f, name in ((F.min_by, "first"), (F.max_by, "last"))),
    )
    ends = ends.withColumn("duration", F.col("t_s_last") - F.col("t_s_first"))
    ends = ends.withColumn("gap_m", F.sqrt((F.col("x_last") - F.col("x_first")) * (F.col("x_last") - F.col("x_first")) + (F.col("y_last") - F.col("y_first")) * (F.col("y_last") - F.col("y_first"))))
    judged = F.col("samples") >= least_rows
    median = ends.where(judged & (F.col("duration") > 0)).groupBy(*keys).agg(F.median("duration").alias("usual"))
    ends = ends.join(median, list(keys), "left") if keys else ends.crossJoin(F.broadcast(median))
    bad = judged & ((F.col("duration") < least_share * F.col("usual")) | (F.col("gap_m") > most_gap_m))
    return ends.select(*keys, "lap", "samples", "duration", "gap_m", (~F.coalesce(bad, F.lit(False))).alias("keep"))


def drop_incomplete(xy: DataFrame, order: str = "rn", keys: Keys = (), **limits: float) -> DataFrame:
    """Without the laps that completeness() doesn't keep; sessions of a single lap stay whole."""
    laps = completeness(xy, order, keys=keys, **limits)
    gone = laps.withColumn("_laps", F.count(F.lit(1)).over(_whole(keys))).where("not keep and _laps > 1").select(*keys, "lap")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*keys, "lap")]
    return xy.alias("x").join(gone.alias("g"), same, "left_anti")


def long_enough(rows: DataFrame, least: int = 10, keys: Keys = ()) -> DataFrame:
    """Without laps of fewer rows, in sessions of several laps: those that corner cards are made of."""
    counted = rows.groupBy(*keys, "lap").agg(F.count(F.lit(1)).alias("_rows"))
    counted = counted.withColumn("_laps", F.count(F.lit(1)).over(_whole(keys))).where((F.col("_rows") >= least) | (F.col("_laps") == 1)).select(*keys, "lap")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*keys, "lap")]
    return rows.alias("x").join(counted.alias("g"), same, "left_semi")


def reference_lap(times: DataFrame, mode: str = "fastest", lap: int | None = None, least_samples: int = 200, keys: Keys = ()) -> DataFrame:
    """(keys, lap, laptime_s, mode): the fastest or median lap of those of good quality, or a given one.

    Good are laps of at least half the median time and ``least_samples`` samples; all, if none is. A given
    lap that is absent falls back to the fastest, and mode then says so.
    """
    whole = _whole(keys)
    good = (F.col("laptime_s") >= 0.5 * F.median("laptime_s").over(whole)) & (F.col("samples") >= least_samples)
    rows = times.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("any_good", F.max("good").over(whole)).where(F.col("good") | ~F.col("any_good"))
    rows = rows.withColumn("far", F.abs(F.col("laptime_s") - F.median("laptime_s").over(whole)))
    said = F.lit(mode)
    if mode == "median":
        best = F.struct("far", "lap")
    elif lap is not None:
        here = F.max(F.col("lap") == lap).over(whole)
        rows, said = rows.withColumn("here", here), F.when(F.col("here"), F.lit(str(lap))).otherwise("fastest")
        best = F.struct((F.col("lap") != lap).alias("other"), "laptime_s", "lap")
    else:
        best = F.struct("laptime_s", "lap")
    rows = rows.withColumn("mode", said).withColumn("best", best)
    return rows.groupBy(*keys).agg(*(F.min_by(c, "best").alias(c) for c in ("lap", "laptime_s", "mode")))


def fill_lap(tel: DataFrame, order: str, keys: Keys = ()) -> DataFrame:
    """Null laps take the last lap before them, 0 at the start."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return tel.withColumn("lap", F.coalesce(F.last("lap", ignorenulls=True).over(w), F.lit(0)).cast("int"))


def arc_length(xy: DataFrame, order: str = "rn", keys: Keys = ()) -> DataFrame:
    """+ s: distance along each lap, from 0."""
    w = W.partitionBy(*keys, "lap").orderBy(order)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    steps = xy.withColumn("ds", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return steps.withColumn("s", F.sum("ds").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("ds")


def median_dt(tel: DataFrame, order: Sequence[str], keys: Keys = ()) -> DataFrame:
    """(keys, dt): the median time step in file order; else the mean, else 0.1."""
    steps = tel.withColumn("d", F.col("t_s") - F.lag("t_s").over(W.partitionBy(*keys).orderBy(*order)))
    return steps.groupBy(*keys).agg(F.coalesce(F.when(F.median("d") > 0, F.median("d")), F.when(F.avg("d") > 0, F.avg("d")), F.lit(0.1)).alias("dt"))


def derivative(rows: DataFrame, column: str, out: str, dt: float | F.Column, order: str | Sequence[str] = "rn", keys: Keys = ("lap",)) -> DataFrame:
    """+ out: difference to the row before over a time step, one for all rows or one for each session."""
    by = [order] if isinstance(order, str) else order
    step = F.lit(float(dt)) if isinstance(dt, int | float) else dt
    return rows.withColumn(out, (F.col(column) - F.lag(column).over(W.partitionBy(*keys).orderBy(*by))) / step)


def corner_metrics(samples: DataFrame, apexes: DataFrame, window_m: float = 60.0, near_m: float = 30.0, brake_g: float = -0.15, keys: Keys = ()) -> DataFrame:
    """Corner cards: (keys, lap, turn, s_apex, s_brake_onset, Ventry, Vmin, Vexit, a_long_peak).

    samples: lap, rn, s, v, a_long, jerk. A range join by buckets of the window's width, so that it is
    an equality join at any number of apexes. A corner without samples keeps a row of nulls.
    """
    bucket = lambda c: F.floor(c / window_m)
    reach = apexes.withColumn("bucket", F.explode(F.sequence(bucket(F.col("s_apex") - window_m), bucket(F.col("s_apex") + window_m))))
    inside = samples.withColumn("bucket", bucket(F.col("s"))).join(reach, [*keys, "bucket"]).where(F.abs(F.col("s") - F.col("s_apex")) <= window_m)
    before, after = F.col("s") < F.col("s_apex"), F.col("s") > F.col("s_apex")
    entry = before & (F.col("s") >= F.col("s_apex") - near_m)
    leave = after & (F.col("s") <= F.col("s_apex") + near_m)
    hard = before & (F.col("a_long") < brake_g * 9.81)
    got = inside.groupBy(*keys, "lap", "turn").agg(
        F.min("v").alias("Vmin"), F.min(F.when(before, F.col("a_long"))).alias("a_long_peak"),
        F.coalesce(F.median(F.when(entry, F.col("v"))), F.max_by(F.when(before, F.col("v")), F.when(before, F.col("rn"))), F.min_by("v", "rn")).alias("Ventry"),
        F.coalesce(F.median(F.when(leave, F.col("v"))), F.min_by(F.when(after, F.col("v")), F.when(after, F.col("rn"))), F.max_by("v", "rn")).alias("Vexit"),
        F.coalesce(F.max(before & (F.col("jerk") < 0)), F.lit(False)).alias("eases"),
        F.max(F.when(hard, F.col("s"))).alias("any_onset"), F.max(F.when(hard & (F.col("jerk") < 0), F.col("s"))).alias("sharp_onset"),
    )
    every = samples.select(*keys, "lap").distinct()
    every = every.join(apexes, list(keys)) if keys else every.crossJoin(F.broadcast(apexes))
    onset = F.when(F.col("eases"), F.col("sharp_onset")).otherwise(F.col("any_onset")).alias("s_brake_onset")
    return every.join(got, [*keys, "lap", "turn"], "left").select(*keys, "lap", "turn", "s_apex", onset, "Ventry", "Vmin", "Vexit", "a_long_peak")
