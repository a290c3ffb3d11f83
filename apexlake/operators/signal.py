"""Smoothing, map projection, resampling, curvature and apexes.

Everything is column expressions over windows of a session's keys; parallelism is over sessions. Apexes come
from profiles of a fixed number of points: windows find the local maxima, and folds over arrays of these pick apexes.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.operators import ordered

Keys = Sequence[str]

#: WGS 84: semi-major axis in metres, flattening.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def hat_matrix(window: int, degree: int) -> np.ndarray:
    """Row i: weights of the window's values in the fitted polynomial at the window's i-th place."""
    a = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(rows: DataFrame, column: str, out: str, window: int, degree: int = 2, order: str = "rn", keys: Keys = ()) -> DataFrame:
    """+ out: the column smoothed by polynomials over moving windows; at the ends the first and last window's serve.

    Groups with fewer rows than the window stay as they are; rows whose window has a null are null.
    """
    group = W.partitionBy(*keys)
    ordered = group.orderBy(order)
    i, n = F.row_number().over(ordered) - 1, F.count(F.lit(1)).over(group)
    rows = rows.withColumns({"_i": i, "_n": n, "_v": F.collect_list(F.struct(F.col(column).cast("double").alias("x"))).over(ordered.rowsBetween(-(window - 1), window - 1))})
    first = F.least(F.greatest(F.col("_i") - window // 2, F.lit(0)), F.col("_n") - window)
    weights = F.array(*(F.array(*map(F.lit, r)) for r in hat_matrix(window, degree).tolist()))
    part = F.slice("_v", (first - F.greatest(F.col("_i") - (window - 1), F.lit(0)) + 1).cast("int"), window)
    terms = F.zip_with(part, F.get(weights, (F.col("_i") - first).cast("int")), lambda v, w: v["x"] * w)
    smooth = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn(out, F.when(F.col("_n") >= window, smooth).otherwise(F.col(column))).drop("_i", "_n", "_v")


def project(rows: DataFrame, keys: Keys = ()) -> DataFrame:
    """+ x, y in metres: Transverse Mercator about the session's median longitude and latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    series = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )

    def plane(lat: Column, lon: Column) -> tuple[Column, Column]:
        phi = F.radians(lat)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(F.radians(lon))), F.asinh(F.sin(F.radians(lon)) / F.sqrt(t * t + F.cos(F.radians(lon)) * F.cos(F.radians(lon))))
        x, y = eta, xi
        for j, a in enumerate(series, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return radius * x, radius * y

    whole = W.partitionBy(*keys)
    rows = rows.withColumns({"_lon": F.median("lon").over(whole), "_lat": F.median("lat").over(whole)})
    x, y = plane(F.col("lat"), F.col("lon") - F.col("_lon"))
    _, origin = plane(F.col("_lat"), F.lit(0.0))
    return rows.withColumns({"x": x, "y": y - origin}).drop("_lon", "_lat")


def resample(arc: DataFrame, points: int = 1000, order: str = "rn", keys: Keys = ()) -> DataFrame:
    """(keys, gi, s, x, y): the line at equal distances along it, straight between samples.

    Sessions with fewer than three samples give no rows.
    """
    whole, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("s", order)
    rows = arc.where("s is not null").select(*keys, order, "s", "x", "y").withColumns({"_a": F.min("s").over(whole), "_b": F.max("s").over(whole), "_n": F.count(F.lit(1)).over(whole)} | {f"_{c}": F.lead(c).over(w) for c in ("s", "x", "y")})
    rows = rows.where("_n >= 3 and _s is not null and _b > _a").withColumn("step", (F.col("_b") - F.col("_a")) / (points - 1))
    place = lambda c: F.when(F.col(c) >= F.col("_b"), F.lit(points)).otherwise(F.ceil((F.col(c) - F.col("_a")) / F.col("step"))).cast("int")
    rows = rows.withColumns({"_lo": place("s"), "_hi": place("_s") - 1}).where("_lo <= _hi")
    rows = rows.withColumn("gi", F.explode(F.sequence("_lo", "_hi"))).withColumn("g", F.col("_a") + F.col("gi") * F.col("step"))
    share = F.coalesce((F.col("g") - F.col("s")) / F.nullif(F.col("_s") - F.col("s"), F.lit(0.0)), F.lit(0.0))
    return rows.select(*keys, "gi", F.col("g").alias("s"), (F.col("x") + share * (F.col("_x") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("_y") - F.col("y"))).alias("y"))


def gradient(rows: DataFrame, columns: dict[str, str], along: str, order: str, keys: Keys = ()) -> DataFrame:
    """+ derivatives by ``along``, {new: of}: second order inside also at unequal steps, first order at the ends."""
    w = W.partitionBy(*keys).orderBy(order)
    before, after = F.col(along) - F.lag(along).over(w), F.lead(along).over(w) - F.col(along)
    rows = rows.withColumns({"_h": before, "_k": after})
    h, k = F.col("_h"), F.col("_k")
    out = {}
    for new, of in columns.items():
        back, on = F.col(of) - F.lag(of).over(w), F.lead(of).over(w) - F.col(of)
        inner = (h * h * (F.col(of) + on) + (k * k - h * h) * F.col(of) - k * k * (F.col(of) - back)) / (h * k * (h + k))
        out[new] = F.when(h.isNull(), on / k).when(k.isNull(), back / h).otherwise(inner)
    return rows.withColumns(out).drop("_h", "_k")


def curvature(line: DataFrame, order: str = "gi", keys: Keys = ()) -> DataFrame:
    """+ kappa of the line (s, x, y); the denominator is at least 1e-10."""
    rows = gradient(line, {"_x1": "x", "_y1": "y"}, "s", order, keys)
    rows = gradient(rows, {"_x2": "_x1", "_y2": "_y1"}, "s", order, keys)
    speed = F.col("_x1") * F.col("_x1") + F.col("_y1") * F.col("_y1")
    kappa = F.abs(F.col("_x1") * F.col("_y2") - F.col("_y1") * F.col("_x2")) / F.greatest(F.pow(speed, F.lit(1.5)), F.lit(1e-10))
    return rows.withColumn("kappa", kappa).drop("_x1", "_y1", "_x2", "_y2")


def smoothed(rows: DataFrame, column: str, out: str, seconds: float, steps: DataFrame, degree: int = 2, order: str = "rn", keys: Keys = ("lap",), least: int = 5) -> DataFrame:
    """+ out: as savgol(), each session by a window of so many seconds of its own median time step.

    steps: (keys, dt), as laps.median_dt() gives. A session's rows are numbered in units of its window, so that one
    range frame holds each session's own window, whatever its length; the weights are a row for each
    window length and place in the window, made where lengths occur and joined. Sessions shorter than their window stay as they are;
    rows whose window has a null are null. Sessions without a step get none smoothed. Rows equal in order are in undefined order.
    """
    odd = F.greatest(F.lit(least), F.floor(F.lit(seconds) / F.col("dt")).cast("int"))
    steps = steps.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), (odd + (odd + 1) % 2).alias("_w"))
    group = W.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.row_number().over(group.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(group)})
    met = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    rows = (rows.join(steps, met, "left") if met else rows.crossJoin(F.broadcast(steps))).drop(*(f"_g{i}" for i in range(len(keys))))
    rows = rows.withColumn("_fits", F.coalesce(F.col("_n") >= F.col("_w"), F.lit(False)))
    rows = rows.withColumn("_u", F.when(F.col("_fits"), 4.0 * F.col("_i") / (F.col("_w") - 1)).otherwise(16.0 * F.col("_i")))
    near = group.orderBy("_u").rangeBetween(-5, 5)
    rows = rows.withColumns({"_v": F.collect_list(F.struct("_i", F.col(column).cast("double").alias("x"))).over(near), "_lo": F.least(F.greatest(F.col("_i") - F.floor(F.col("_w") / 2), F.lit(0)), F.col("_n") - F.col("_w"))})
    rows = rows.withColumn("_at", F.when(F.col("_fits"), (F.col("_i") - F.col("_lo")).cast("int")))
    weights = hats(steps.select("_w").distinct(), degree).withColumnRenamed("_w", "_ww")
    rows = rows.join(weights, (F.col("_w") == F.col("_ww")) & (F.col("_at") == F.col("_place")), "left")
    part = F.slice("_v", (F.col("_lo") - F.col("_v")[0]["_i"] + 1).cast("int"), F.col("_w"))
    smooth = F.aggregate(F.zip_with(part, "_weights", lambda v, w: v["x"] * w), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn(out, F.when(F.col("_fits"), smooth).otherwise(F.col(column))).drop("_i", "_n", "_w", "_fits", "_u", "_v", "_lo", "_at", "_ww", "_place", "_weights")


def hats(windows: DataFrame, degree: int) -> DataFrame:
    """(_w, _place, _weights): hat_matrix() of each window length (_w), a row for each place."""

    def made(batches):
        for batch in batches:
            for w in batch["_w"].dropna():
                yield pd.DataFrame({"_w": w, "_place": range(w), "_weights": list(hat_matrix(int(w), degree))})

    return windows.mapInPandas(made, "_w int, _place int, _weights array<double>")


def acceleration(rows: DataFrame, steps: DataFrame, sensor: str = "longitudinal_acc_g", speed: str = "v_smooth", order: str = "rn", keys: Keys = ("lap",), seconds: float = 0.2) -> DataFrame:
    """+ a_long in m/s2, source: the sensor's g, smoothed, in sessions where it says anything, else the change of speed over the median step.

    Rows whose window has a null reading are null; the first row of a session without a sensor is null too.
    """
    group = W.partitionBy(*keys)
    rows = rows.withColumns({"_sensed": F.count(sensor).over(group) > 0, "_g": F.col(sensor) * 9.81})
    rows = smoothed(rows, "_g", "_a", seconds, steps, 2, order, keys)
    rows = rows.join(steps.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), "dt"), [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], "left")
    change = (F.col(speed) - F.lag(speed).over(group.orderBy(order))) / F.col("dt")
    rows = rows.withColumns({"a_long": F.when(F.col("_sensed"), F.col("_a")).otherwise(change), "source": F.when(F.col("_sensed"), "sensor_g").otherwise("dvdt")})
    return rows.drop("_sensed", "_g", "_a", "dt", *(f"_g{i}" for i in range(len(keys))))


DEFAULT = {"q": 0.78, "min_gap_m": 65.0, "prom_mult": 0.6, "merge_gap_m": 45.0}
#: The grid of the scan, and the orders of the three stages of tuning.
GRID = {"q": (0.75, 0.78, 0.80), "min_gap_m": (55.0, 65.0, 75.0), "prom_mult": (0.5, 0.6, 0.7), "merge_gap_m": (40.0, 45.0, 55.0)}


def tuning(base: dict[str, float]) -> list[dict[str, float]]:
    """Settings in the order of tuning: the quantile varies, then the gap, then prominence and merge gap; last the base itself."""
    return [base | {"q": q} for q in GRID["q"]] + [base | {"min_gap_m": g} for g in GRID["min_gap_m"]] + [base | {"prom_mult": p, "merge_gap_m": m} for p in GRID["prom_mult"] for m in GRID["merge_gap_m"]] + [base]


TUNING = tuning(DEFAULT)
_SETTING = "q double, min_gap_m double, prom_mult double, merge_gap_m double"
#: A top of a profile: place in it (the middle of a flat top), position, height, and the lowest value between it and the top before.
_STACK = "array<struct<h: double, low: double>>"


def _lowest(tops: Column, valley: str) -> Column:
    """Of each top, in order: the lowest value between it and the last strictly higher top before it, or the profile's end.

    A stack of tops, each lower than the one below: what a top is at least as high as goes, its lowest value with it.
    """

    def step(state: Column, top: Column) -> Column:
        low = F.least(top[valley], F.coalesce(F.array_min(F.transform(F.filter(state["open"], lambda e: e["h"] <= top["h"]), lambda e: e["low"])), top[valley]))
        still = F.filter(state["open"], lambda e: e["h"] > top["h"])
        return F.struct(F.concat(still, F.array(F.struct(top["h"].alias("h"), low.alias("low")))).alias("open"), F.concat(state["out"], F.array(low)).alias("out"))

    start = F.struct(F.array().cast(_STACK).alias("open"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(tops, start, step, lambda state: state["out"])


def tops(line: DataFrame, keys: Keys, qs: Sequence[float]) -> DataFrame:
    """(keys, tops, heights, step, spread): the local maxima of each session's profile (s, kappa), as one array.

    A top: (i, s, h, prominence), i its place in the profile, of a flat top the middle. heights: quantiles at qs; spread: the
    interquartile range; step: median distance of points. Runs of equal values come from windows; runs at the ends are
    no tops but bound prominence. Points without kappa or s are left out; sessions without any have no row. A
    profile has a fixed number of points, so arrays are bounded by it.
    """
    whole, along = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("s")
    rows = line.where("kappa is not null and s is not null").select(*keys, "s", F.col("kappa").cast("double").alias("h"))
    rows = rows.withColumns({"i": F.row_number().over(along) - 1, "_new": (F.col("h") != F.lag("h").over(along)).cast("int"), "_d": F.col("s") - F.lag("s").over(along)})
    rows = rows.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0)))
    stats = rows.groupBy(*keys).agg(F.percentile("h", F.array(*map(F.lit, (*qs, 0.25, 0.75)))).alias("_q"), F.median("_d").alias("step"))
    runs = rows.withColumn("_mid", F.floor((F.min("i").over(W.partitionBy(*keys, "_run")) + F.max("i").over(W.partitionBy(*keys, "_run"))) / 2))
    runs = runs.groupBy(*keys, "_run").agg(F.first("h").alias("h"), F.max("_mid").alias("i"), F.max(F.when(F.col("i") == F.col("_mid"), F.col("s"))).alias("s"))
    by = whole.orderBy("_run")
    before, after = F.lag("h").over(by), F.lead("h").over(by)
    runs = runs.withColumns({"_edge": before.isNull() | after.isNull(), "_top": (before.isNull() | (before < F.col("h"))) & (after.isNull() | (after < F.col("h")))})
    runs = runs.withColumn("_g", F.sum(F.col("_top").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("_top").cast("int"))
    hills = runs.groupBy(*keys, "_g").agg(F.min("h").alias("left"), F.max(F.when(F.col("_top"), F.struct("i", "s", "h", "_edge"))).alias("_p"))
    hills = hills.withColumn("right", F.coalesce(F.lead("left").over(whole.orderBy("_g")), F.col("_p.h"))).where("_p is not null")
    found = hills.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_p.i").alias("i"), F.col("_p.s").alias("s"), F.col("_p.h").alias("h"), F.col("_p._edge").alias("edge"), "left", "right"))).alias("_t"))
    found = found.withColumns({"_l": _lowest(F.col("_t"), "left"), "_r": F.reverse(_lowest(F.reverse("_t"), "right"))})
    both = F.zip_with(F.col("_t"), F.zip_with("_l", "_r", lambda a, b: F.greatest(a, b)), lambda t, low: F.struct(t["i"].alias("i"), t["s"].alias("s"), t["h"].alias("h"), (t["h"] - low).alias("prominence"), t["edge"].alias("edge")))
    found = found.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.filter(both, lambda t: ~t["edge"]).alias("tops"))
    met = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    out = stats.join(found, met) if met else stats.crossJoin(F.broadcast(found))
    return out.select(*keys, "tops", F.slice("_q", 1, len(qs)).alias("heights"), "step", (F.element_at("_q", -1) - F.element_at("_q", -2)).alias("spread"))


def peaks(tops: Column, height: Column, distance: Column, prominence: Column) -> Column:
    """The tops that are high, apart and prominent enough, in order; of two that are too near the higher stays, of equal ones the later."""
    high = F.reverse(F.array_sort(F.transform(F.filter(tops, lambda t: t["h"] >= height), lambda t: F.struct(t["h"].alias("h"), t["i"].alias("i"), t["s"].alias("s"), t["prominence"].alias("prominence")))))
    kept = F.aggregate(high, F.slice(high, 1, 0), lambda kept, t: F.when(F.exists(kept, lambda k: F.abs(k["i"] - t["i"]) < distance), kept).otherwise(F.concat(kept, F.array(t))))
    return F.array_sort(F.transform(F.filter(kept, lambda t: t["prominence"] >= prominence), lambda t: F.struct(t["i"].alias("i"), t["s"].alias("s"), t["h"].alias("h"))))


def merged(peaks: Column, gap_m: Column) -> Column:
    """The peaks; while the next is nearer than the gap to the one kept last, the higher of both stays."""

    def step(kept: Column, t: Column) -> Column:
        last = F.element_at(kept, -1)
        near = F.when(t["h"] > last["h"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(t))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(t)).when(t["s"] - last["s"] < gap_m, near).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(peaks, F.slice(peaks, 1, 0), step)


def detected(line: DataFrame, keys: Keys, settings: Sequence[dict[str, float]]) -> DataFrame:
    """(keys, stage, setting, before, after): peaks of each session's profile by each setting, before and after the merge.

    Settings are crossed with the sessions' tops, not with their profiles.
    """
    qs = sorted({o["q"] for o in settings})
    table = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(qs.index(o["q"])).alias("at"), *(F.lit(float(o[c])).alias(c) for c in DEFAULT)) for n, o in enumerate(settings)))
    rows = tops(line, keys, qs).withColumn("setting", F.explode(table))
    distance = F.when(F.col("step") > 0, F.greatest(F.floor(F.col("setting.min_gap_m") / F.col("step")), F.lit(1))).otherwise(10)
    before = peaks(F.col("tops"), F.get("heights", F.col("setting.at")), distance, F.col("setting.prom_mult") * F.col("spread"))
    rows = rows.withColumn("before", before).withColumn("after", merged(F.col("before"), F.col("setting.merge_gap_m")))
    return rows.select(*keys, "setting.stage", "setting", "before", "after")


def apexes(line: DataFrame, keys: Keys, **options: float) -> DataFrame:
    """(keys, turn, s_apex, kappa): apexes of each session's profile (s, kappa), numbered from 1 along it."""
    return numbered(detected(line, keys, [DEFAULT | options]), keys)


def numbered(found: DataFrame, keys: Keys) -> DataFrame:
    """(keys, turn, s_apex, kappa) of peaks after the merge."""
    rows = found.select(*keys, F.posexplode("after").alias("turn", "p"))
    return rows.select(*keys, (F.col("turn") + 1).alias("turn"), F.col("p.s").alias("s_apex"), F.col("p.h").alias("kappa"))


def curvature_debug(line: DataFrame, keys: Keys, found: DataFrame | None = None, **options: float) -> DataFrame:
    """(keys, s, kappa_s, is_peak, peak_s_before_merge, peak_s_after_merge): the profile with its peaks marked, by one setting or as found."""
    found = detected(line, keys, [DEFAULT | options]) if found is None else found
    marks = found.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.explode("before").alias("_p"), "after")
    marks = marks.select(*(f"_k{n}" for n in range(len(keys))), F.col("_p.i").alias("_i"), F.exists("after", lambda a: a["i"] == F.col("_p.i")).alias("_stays"))
    rows = line.where("kappa is not null and s is not null").withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy("s")) - 1)
    rows = rows.join(marks, [*(F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col("_at") == F.col("_i")], "left")
    peak = F.col("_i").isNotNull()
    return rows.select(*keys, "s", F.col("kappa").alias("kappa_s"), peak.cast("int").alias("is_peak"), F.when(peak, F.col("s")).alias("peak_s_before_merge"), F.when(F.col("_stays"), F.col("s")).alias("peak_s_after_merge"))


def scan(line: DataFrame, keys: Keys, least: int = 12, most: int = 16) -> DataFrame:
    """(keys, q, min_gap_m, prom_mult, merge_gap_m, apex_count, in_target) of all 81 combinations of the grid."""
    grid = [dict(zip(GRID, own)) for own in itertools.product(*GRID.values())]
    return detected(line, keys, grid).select(*keys, *(f"setting.{c}" for c in DEFAULT), F.size("after").alias("apex_count"), F.size("after").between(least, most).alias("in_target"))


def candidates(scanned: DataFrame, keys: Keys, first: int = 10) -> DataFrame:
    """+ place: the first settings of a scan whose count is in the target, in the grid's order; at most so many a session."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*DEFAULT))
    return scanned.where("in_target").withColumn("place", place).where(F.col("place") <= first)


def hits(line: DataFrame, keys: Keys, least: int = 12, most: int = 16, **base: float) -> DataFrame:
    """(keys, setting, before, after): peaks by the first setting of the three stages within the target.

    Without a hit the base stays, by default the default setting.
    """
    settings = tuning(DEFAULT | base)
    found = F.size("after").between(least, most)
    rank = F.when(found, F.col("stage")).when(F.col("stage") == len(settings) - 1, len(settings)).otherwise(len(settings) + 1)
    best = detected(line, keys, settings).groupBy(*keys).agg(F.min_by(F.struct("setting", "before", "after"), rank).alias("b"))
    return best.select(*keys, "b.*")


def tuned(line: DataFrame, keys: Keys, least: int = 12, most: int = 16) -> DataFrame:
    """(keys, q, min_gap_m, prom_mult, merge_gap_m, apex_count): the setting of hits()."""
    return hits(line, keys, least, most).select(*keys, *(f"setting.{c}" for c in DEFAULT), F.size("after").alias("apex_count"))


def nearest_points(points: DataFrame, targets: DataFrame, target: str, order: str = "rn", keys: Keys = ()) -> DataFrame:
    """targets + x, y of the sample whose s is nearest to the target, however far; ties by order. Without keys all laps count."""
    return ordered.nearest(targets, target, points, "s", order, ("x", "y"), keys)
