"""Smoothing, geometry and apexes on inputs with known answers, and ingest of odd files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexlake.operators import laps, ordered, signal
from apexlake.sources import telemetry


def plain_peaks(h, least, distance, prominence):
    """By the definition, point by point."""
    at = []
    for i in range(1, len(h) - 1):
        j = i
        while j + 1 < len(h) and h[j + 1] == h[i]:
            j += 1
        if h[i - 1] < h[i] and j + 1 < len(h) and h[j + 1] < h[i] and h[(i + j) // 2] >= least:
            at.append((i + j) // 2)
    gone = set()
    for p in sorted(at, key=lambda p: (h[p], p), reverse=True):
        if p not in gone:
            gone |= {q for q in at if q != p and q not in gone and abs(q - p) < distance}
    out = []
    for p in (p for p in at if p not in gone):
        lows = []
        for step in (-1, 1):
            low, q = h[p], p
            while 0 <= q < len(h) and h[q] <= h[p]:
                low, q = min(low, h[q]), q + step
            lows.append(low)
        if h[p] - max(lows) >= prominence:
            out.append(p)
    return out


def merged(at, h, s, gap):
    out = []
    for p in at:
        if out and s[p] - s[out[-1]] < gap:
            out[-1] = p if h[p] > h[out[-1]] else out[-1]
        else:
            out.append(p)
    return out


def heights(seed):
    r = np.random.default_rng(seed)
    if seed == 20:
        return np.zeros(150)
    if seed in (21, 22):
        return np.arange(150.0)[:: 43 - 2 * seed]
    return np.round(np.convolve(r.normal(size=150), np.ones(5) / 5, "same"), 1)  # ties and flat tops


def test_peaks_are_brute_force(spark):
    own = {seed: heights(seed) for seed in range(23)} | {30: np.array([1.0]), 31: np.array([1.0, 2.0])}
    rows = [(seed, 4.0 * i, float(x), "c") for seed, h in own.items() for i, x in enumerate(h)] + [(40, None, 1.0, "c"), (40, 1.0, None, "c")]
    line = spark.createDataFrame(rows, "lap int, s double, kappa double, i string").repartition(4)  # with a clashing name
    options = {"q": 0.4, "min_gap_m": 13.0, "prom_mult": 0.5, "merge_gap_m": 30.0}
    got = {r.lap: ([p.i for p in r.before], [p.i for p in r.after]) for r in signal.detected(line, ("lap",), [signal.DEFAULT | options]).collect()}
    for seed, h in own.items():
        low, high = np.percentile(h, (25, 75))
        before = plain_peaks(h.tolist(), np.quantile(h, 0.4), 3, 0.5 * (high - low))
        assert got.get(seed, ([], [])) == (before, merged(before, h, 4.0 * np.arange(len(h)), 30.0)), seed
    assert 40 not in got and sum(len(b) > len(a) for b, a in got.values()) > 5


def test_merge_follows_the_peak_kept(spark):
    rows = spark.createDataFrame([([(2, 20.0, 1.0), (6, 60.0, 3.0), (9, 90.0, 2.0), (20, 200.0, 5.0)],), ([],)], "p array<struct<i: int, s: double, h: double>>")
    kept = lambda gap: [[p.i for p in r.m] for r in rows.select(signal.merged(F.col("p"), F.lit(gap)).alias("m")).collect()]
    assert kept(45.0) == [[6, 20], []] and kept(40.0) == [[2, 6, 20], []]


def test_each_session_has_its_own_window(spark):
    rows = [(g, i, i * dt, 1.0 - 0.5 * i + 0.125 * i * i if i != 60 else None) for g, n, dt in (("a", 200, 1 / 64), ("b", 100, 1 / 16), ("c", 7, 1 / 64), (None, 40, 1 / 8)) for i in range(n)]
    rows = spark.createDataFrame(rows, "g string, rn int, t_s double, v double").repartition(5)
    steps = laps.median_dt(rows, ["rn"], ("g",))
    got = {(r.g, r.rn): (r.v, r.out) for r in signal.smoothed(rows, "v", "out", 0.5, steps, keys=("g",)).collect()}
    assert len(got) == 347 and all(out is None or abs(out - v) < 1e-8 for v, out in got.values())
    assert [k for k in sorted(got, key=str) if got[k][1] is None] == sorted([("a", i) for i in range(44, 77)] + [("b", i) for i in range(56, 65)], key=str)
    assert signal.smoothed(rows.where("false"), "v", "out", 0.5, steps, keys=("g",)).count() == 0


def test_sensor_or_derivative_by_session(spark):
    rows = [(g, i, i / 64, 2.0 * i, sense(i)) for g, sense in ((1, lambda i: 0.5), (2, lambda i: None), (3, lambda i: None if i == 20 else 0.1)) for i in range(60)]
    rows = spark.createDataFrame(rows, "lap int, rn int, t_s double, v_smooth double, longitudinal_acc_g double")
    got = signal.acceleration(rows, laps.median_dt(rows, ["rn"], ("lap",))).orderBy("lap", "rn").collect()
    assert {(r.lap, r.source) for r in got} == {(1, "sensor_g"), (2, "dvdt"), (3, "sensor_g")}
    assert all(abs(r.a_long - 4.905) < 1e-9 for r in got[:60]) and got[60].a_long is None and all(abs(r.a_long - 128) < 1e-9 for r in got[61:120])
    assert [r.rn for r in got[120:] if r.a_long is None] == list(range(14, 27))


def test_nearest_point_at_any_distance(spark):
    r = np.random.default_rng(2)
    points = [(g, i, float(s), float(i)) for g in (1, 2, None) for i, s in enumerate(np.round(r.normal(0, 50, 300), 0))] + [(1, 900, 1e6, 900.0), (1, 901, None, 1.0), (5, 1, 3.0, 1.0)]
    targets = [(g, float(t)) for g in (1, 2, None, 4, 5) for t in [*np.round(r.normal(0, 80, 60), 1), -1e9, 5e5, 5.5, 5.5]] + [(1, None), (1, float("nan"))]
    p, t = spark.createDataFrame(points, "g int, o int, s double, x double").repartition(5), spark.createDataFrame(targets, "g int, t double").repartition(5)
    for parts in (1, 7):
        got = ordered.nearest(t, "t", p, "s", "o", ["x"], ["g"], parts).collect()
        assert len(got) == len(targets)
        for row in got:
            own = [(abs(s - row.t), o, x) for g, o, s, x in points if g == row.g and s is not None] if row.t is not None and row.t == row.t else []
            assert row.x == (min(own)[2] if own else None), row
    whole = {r.t: r.x for r in ordered.nearest(t.where("g = 1 and t is not null"), "t", p.where("g = 1"), "s", "o", ["x"]).collect()}
    assert whole[-1e9] == min((s, o, x) for g, o, s, x in points if g == 1 and s is not None)[2] and whole[5e5] is not None
    assert ordered.nearest(t, "t", p.where("false"), "s", "o", ["x"]).where("x is null").count() == len(targets)


def test_polynomials_stay_as_they_are(spark):
    rows = spark.createDataFrame([(g, i, 3.0 - 0.5 * i + 0.25 * i * i) for g, n in ((1, 30), (2, 4)) for i in range(n)], "g int, rn int, v double")
    got = signal.savgol(rows, "v", "smooth", 9, 2, keys=("g",)).collect()
    assert len(got) == 34 and all(abs(r.smooth - r.v) < 1e-9 for r in got)
    holes = signal.savgol(rows.withColumn("v", F.when(F.col("rn") != 15, F.col("v"))), "v", "smooth", 9, 2, keys=("g",))
    assert sorted(r.rn for r in holes.where("smooth is null and g = 1").collect()) == list(range(11, 20))


def test_circle_line_and_empty(spark):
    ring = [(1, i, 100 * float(np.cos(a)), 100 * float(np.sin(a)), 100 * float(a)) for i, a in enumerate(np.linspace(0, 5, 2000))] + [(2, i, 2.0 * i, 1.0 * i, 5**0.5 * i) for i in range(50)] + [(3, 0, 0.0, 0.0, 0.0)]
    line = signal.resample(spark.createDataFrame(ring, "lap int, rn int, x double, y double, s double"), keys=("lap",))
    got = signal.curvature(line, keys=("lap",)).collect()
    assert sum(r.lap == 1 for r in got) == sum(r.lap == 2 for r in got) == 1000 and not any(r.lap == 3 for r in got)
    inner = sorted(r.kappa for r in got if r.lap == 1 and 10 < r.gi < 990)
    assert abs(np.median(inner) - 0.01) < 5e-4
    assert all(abs(r.kappa) < 1e-6 and abs(r.y - r.x / 2) < 1e-9 for r in got if r.lap == 2)
    assert signal.apexes(signal.curvature(line.where("lap = 9"), keys=("lap",)), ("lap",)).count() == 0


def test_projection_keeps_distances(spark):
    rows = spark.createDataFrame([(i, 45.0 + dy, 7.0 + dx) for i, (dy, dx) in enumerate([(0.0, 0.0), (0.001, 0.0), (0.0, 0.001), (-0.001, 0.0), (0.0, -0.001)])], "i int, lat double, lon double")
    at = {r.i: (r.x, r.y) for r in signal.project(rows).collect()}
    assert at[0] == pytest.approx((0, 0), abs=1e-6)
    assert at[1] == pytest.approx((0, 111.132), abs=0.01) and at[2] == pytest.approx((78.847, 0), abs=0.01)  # a thousandth of a degree at 45 degrees


def test_ingest_of_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Time,Latitude (deg),longitude,Speed (mph),Speed (m/s),Lap #,Fahrer\n1,45,7,10,4.5,,J\xfcrgen\n2,45.1,7.1,bad,5,2,x\n3,nan?,7,1,6,,x\n4,45.2,7.2,1,oops,,x\n5,45.3,7.3,1,7,,x\n".encode("latin-1"))
    rows = telemetry.read_text(spark, str(tmp_path / "a.csv"))
    assert rows.where("Fahrer = 'Jürgen'").count() == 1
    got = [(r.t_s, r.v, r.lap) for r in telemetry.canonical(rows).orderBy("rid").collect()]
    assert got == [(1.0, 4.5, 0), (2.0, 5.0, 2), (5.0, 7.0, 2)]
    assert telemetry.canonical(rows, {"v": "speed (MPH)"}).orderBy("rid").first().v == pytest.approx(4.4704)
    with pytest.raises(ValueError, match="no column for lat"):
        telemetry.canonical(rows.drop("Latitude (deg)"))
    assert telemetry.canonical(rows.where("false")).count() == 0


def test_columns_by_aliases():
    assert telemetry.resolve(["Lap #", "x"], telemetry.ALIASES["lap"]) == "Lap #"
    assert telemetry.resolve(["Speed (km/h)", "speed (mph)"], telemetry.ALIASES["v"]) == "speed (mph)"
    assert telemetry.resolve(["t"], telemetry.ALIASES["t_s"]) is None
    assert telemetry.metric_speed(["Speed (mph)", "speed_mps"]) == "speed_mps" and telemetry.metric_speed(["speed"]) is None
