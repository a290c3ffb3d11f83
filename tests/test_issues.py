"""Running totals and quantiles over hot groups, and issues of many sessions at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexlake.operators import issues, ordered, plots

CARDS = "session string, lap int, turn int, s_apex double, s_brake_onset double, Ventry double, Vmin double, Vexit double, a_long_peak double, _k0 string, metric string"


def cards(spark, sessions=("a", "b", None), laps=9, turns=4):
    r = np.random.default_rng(5)
    rows = [(s, lap, t, 100.0 * t, None if lap == 3 else 100.0 * t - float(r.integers(5, 60)), *(float(x) for x in r.normal(20, 4, 3)), -float(r.uniform(0, 9)), "k", "m") for s in sessions for lap in range(laps) for t in range(1, turns + 1)]
    rows += [("a", 1, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "k", "m"), ("a", None, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "k", "m"), ("lone", 4, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "k", "m")]
    return spark.createDataFrame(rows, CARDS).repartition(4)


def test_running_total_of_a_hot_group(spark):
    r = np.random.default_rng(1)
    rows = [("hot", int(i), int(w)) for i, w in zip(r.permutation(4000), r.integers(0, 9, 4000))] + [("b", 1, 2), ("b", None, 3), (None, 5, 7), (None, 6, 1), ("b", 2, None)]
    got = ordered.running_total(spark.createDataFrame(rows, "g string, i int, w int").repartition(7), ["g"], ["i"], F.col("w"), "upto")
    parts = got.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = {(x.g, x.i): x.upto for x in got.collect()}
    hot = np.cumsum([w for _, _, w in sorted(rows[:4000], key=lambda x: x[1])])
    assert [found["hot", i] for i in range(4000)] == hot.tolist() and len(found) == len(rows) and int(parts) > 1
    assert (found["b", None], found["b", 1], found["b", 2], found[None, 5], found[None, 6]) == (3, 5, 5, 7, 8)
    assert ordered.running_total(spark.createDataFrame([], "g string, i int"), ["g"], ["i"], 1, "n").count() == 0


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(2)
    own = {"hot": np.round(r.normal(size=5000), 2), "same": np.full(300, 7.25), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), None: r.normal(size=9), "inf": np.array([1.0, np.inf, np.inf])}
    rows = [(g, float(x), 1) for g, v in own.items() for x in v] + [("none", None, 1), ("one", None, 1)]
    got = ordered.quantiles(spark.createDataFrame(rows, "g string, v double, _v int").repartition(6), ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.95})
    found = {x.g: x for x in got.collect()}
    assert set(found) == set(own)
    for g, v in own.items():
        assert found[g]["count"] == len(v)
        if g != "inf":
            assert [found[g].a, found[g].b, found[g].c] == pytest.approx(np.quantile(v, (0.25, 0.5, 0.95)).tolist(), abs=1e-12)
    assert found["inf"].b == np.inf


def test_sessions_at_once_are_each_by_itself(spark):
    rows = cards(spark)
    best = spark.createDataFrame([("a", 0), ("b", 2), (None, 5), ("other", 1)], "session string, lap int")
    def whole(r, b, keys):
        r = issues.deltas(r, b, keys)
        report = issues.stability(r, b, keys)
        scored = issues.scores(issues.turn_stats(report, issues.relative_events(r, b, keys), keys), keys)
        return issues.top_issues(issues.composite(scored, issues.stability_score(report, keys), keys=keys), 3, keys)

    def table(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)

    at_once = whole(rows, best, ["session"])
    assert {r.session for r in at_once.collect()} == {"a", "b", None}  # no benchmark, no issues
    for s, lap in (("a", 0), ("b", 2), (None, 5)):
        own = whole(rows.where(F.col("session").eqNullSafe(s)), lap, [])
        assert table(at_once.where(F.col("session").eqNullSafe(s)).drop("session")) == table(own)


def test_statistics_of_a_turn(spark):
    rows = issues.deltas(cards(spark).where("session = 'a'"), 0)
    got = {r.turn: r for r in issues.stability(rows, 0).collect()}
    plain = rows.where("lap <> 0 and turn is not null").toPandas()
    assert set(got) == {1, 2, 3, 4}
    for turn, own in plain.groupby("turn"):
        for m in issues.METRICS:
            v = own[m].dropna().to_numpy()
            want = [np.median(v), np.quantile(v, 0.75) - np.quantile(v, 0.25), v.mean(), v.std(), len(v), np.median(abs(v)), np.quantile(abs(v), 0.75) - np.quantile(abs(v), 0.25)]
            assert [got[turn][c] for c in (f"{m}_median", f"{m}_iqr", f"{m}_mean", f"{m}_std", f"{m}_count", f"med_|{m}|", f"iqr_|{m}|")] == pytest.approx(want)
    empty = issues.stability(rows.withColumn("d_Vmin", F.lit(None).cast("double")), 0).first()
    assert empty["d_Vmin_count"] == 0 and empty["d_Vmin_median"] is None and empty["med_|d_Vmin|"] is None
    assert issues.stability(rows.where("false"), 0).count() == 0
    back = issues.wide_metrics(issues.long_metrics(rows).where("lap = 1").groupBy("turn", "metric").agg(F.max("value").alias("v")), ["v"]).where("turn = 2").first()
    assert back.d_Vexit_v == rows.where("lap = 1 and turn = 2").first().d_Vexit


def test_events_hold_what_the_rule_saw(spark):
    rows = spark.createDataFrame([(lap, 1, 0.0, 20.0, x, 20.0, -9.81, d, 0.0, x, 0.0, 0.0) for lap, x, d in ((1, 0.0, 0.0), (2, -3.0, 20.0), (3, float("-inf"), -8.0), (4, None, None))], "lap int, turn int, delta_s_to_apex_m double, Ventry double, Vmin double, Vexit double, a_long_peak double, d_delta_s double, d_Ventry double, d_Vmin double, d_Vexit double, d_a_long_peak double")
    got = issues.relative_events(rows, 1).orderBy("event_id").collect()
    assert [(r.event_id, r.source, r.ref_flags) for r in got] == [("2-1-early_brake-1", "rule_v1", '{"delta_s": "early"}'), ("2-1-overslow-1", "rule_v1", '{"vmin": "lower"}'), ("3-1-late_brake-1", "rule_v1", '{"delta_s": "late"}')]
    assert got[0].a_long_peak_g == -1.0 and got[0].d_delta_s == 20.0


def test_guards(spark):
    rows = cards(spark)
    assert issues.checked(rows, 1) is rows
    for bad, lap, said in ((rows.drop("turn"), 1, "lack"), (rows.drop("s_apex"), 1, "need"), (rows, None, "no benchmark"), (rows, 77, "no card of benchmark lap 77"), (rows.where("turn is null"), 1, "no card has a turn")):
        with pytest.raises(ValueError, match=said):
            issues.checked(bad, lap)
    assert issues.relative_events(issues.deltas(rows, 77), 77).count() == 0


def test_layout_and_trajectory(spark):
    points = spark.createDataFrame([(lap, i, 10.0 * i, float(lap), float(i), 30.0) for lap in (1, 2) for i in range(5)] + [(1, 9, 1.0, None, 2.0, 1.0)], "lap int, rn int, s double, x double, y double, v double")
    marks = spark.createDataFrame([(1, 12.0), (2, 1000.0)], "turn int, s_apex double")
    assert sorted((r.label, r.x, r.y) for r in plots.layout(points, marks, 2).collect()) == [("T1", 2.0, 1.0), ("T2", 2.0, 4.0)]
    assert {r.x for r in plots.layout(points, marks, 8).collect()} == {1.0}
    rows = plots.trajectory(points, 2).collect()
    assert len(rows) == 10 and {r.lap for r in rows if r.benchmark} == {2}
