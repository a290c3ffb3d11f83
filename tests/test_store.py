"""The store of sessions, kept bests and retrieval, on nulls, ties, repeats and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexlake.operators import retrieval
from apexlake.sources import sessions

TIMES = "track string, lap int, laptime_s double, session string, date string"


def test_a_session_is_a_partition(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    for name in ("a/b c=1", "b", "ü"):
        sessions.save(spark.createDataFrame([(1, name), (2, None)], "turn int, said string"), root, "events", name, "2024-01-01")
    own = sessions.load(spark, root, "events", ["a/b c=1"])
    assert [(r.turn, r.said, r.session) for r in own.orderBy("turn").collect()] == [(1, "a/b c=1", "a/b c=1"), (2, None, "a/b c=1")]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.session for r in sessions.load(spark, root, "events").collect()} == {"a/b c=1", "b", "ü"}
    # Made from its own partition, with a type of its own, then without rows.
    sessions.save(own.where("turn = 2").select(F.col("turn").cast("long").alias("turn"), F.lit(5).alias("more")), root, "events", "a/b c=1", "2024-01-02")
    assert [(r.turn, r.said, r.more, r.date) for r in sessions.load(spark, root, "events", ["a/b c=1"]).collect()] == [(2, None, 5, "2024-01-02")]
    assert dict(sessions.load(spark, root, "events").dtypes)["turn"] == "int"
    assert sorted(r.turn for r in sessions.load(spark, root, "events", ["a/b c=1"], backup=True).collect()) == [1, 2]
    sessions.save(own.where("false").select("turn"), root, "events", "b")
    assert sessions.load(spark, root, "events", ["b"]).count() == 0 and sessions.load(spark, root, "events", ["none"]).count() == 0
    assert sessions.load(spark, root, "apex_scan") is None and sessions.preview(spark, root, "apex_scan", "b") is None
    assert sessions.preview(spark, root, "events", "ü", 1).count() == 1
    assert sorted((r.name, r.session, r.n) for r in sessions.listing(spark, root).collect()) == [("events", "a/b c=1", 1), ("events", "ü", 2)]


def test_deltas_are_written_if_new(spark, tmp_path):
    root, cards = f"file://{tmp_path}/store", spark.createDataFrame([(1, 2, 3.0)], "lap int, turn int, d_delta_s double")
    assert sessions.save_deltas(cards, cards, root, "s") and sessions.load(spark, root, "corner_cards_with_delta").count() == 1
    whole = cards.withColumns({m: F.lit(1.0) for m in sessions.METRICS})
    assert not sessions.save_deltas(whole, whole, root, "t") and sessions.load(spark, root, "corner_cards_with_delta", ["t"]).count() == 0


def test_bests_are_kept(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert sessions.bests(spark, root).count() == 0 and sessions.update_bests(spark.createDataFrame([], TIMES), root) == 0
    first = [("a", 3, 90.0, "s1", "2024-01-01"), ("a", 4, 89.0, "s1", "2024-01-01"), ("a", 5, 95.0, "s2", "2024-01-02"), ("b", 1, 70.0, "s1", "2024-01-01"), (None, 1, 1.0, "s", "d"), ("a", 9, None, "s1", None), ("a", 9, 0.0, "s1", "2023-01-01")]
    second = [("a", 1, 89.0, "s3", "2024-01-03"), ("a", 2, 88.5, "s3", "2024-01-03"), ("a", 2, 88.5, "s3", "2024-01-03"), ("b", 2, 71.0, "s3", "2024-01-03"), ("c", 1, 60.0, "s3", "2024-01-03")]
    put = lambda rows: sessions.update_bests(spark.createDataFrame(rows, TIMES).repartition(3), root)
    assert (put(first), put(first), put(second), put(second), put(first + second)) == (3, 0, 2, 0, 0)
    assert {(r.track, r.lap, r.laptime_s) for r in sessions.current_bests(spark, root).collect()} == {("a", 2, 88.5), ("b", 1, 70.0), ("c", 1, 60.0)}
    assert [(r.track, r.old_laptime_s, r.laptime_s, r.improvement) for r in sessions.best_history(spark, root).orderBy("date", F.desc("laptime_s")).collect()] == [("a", 90.0, 89.0, 1.0), ("a", 89.0, 88.5, 0.5)]


def brute(base, asked, k):
    out = {}
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    sound = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
    for q, v in asked:
        if q is not None and sound(v):
            out[q] = sorted((-round(float(unit(v) @ unit(w)), 6) or 0.0, i) for i, w in base if i is not None and sound(w) and len(w) == len(v))[:k]
    return {q: v for q, v in out.items() if v}


def test_retrieval_is_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = [(i, r.normal(size=6).tolist()) for i in range(300)] + [(400 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(40)] + [(500, None), (501, [0.0] * 6), (502, [None] + [1.0] * 5), (503, [float("nan")] * 6), (None, [1.0] * 6), (504, [1.0, 1.0]), (7, [1.0] * 6), (7, [1.0] * 6)]
    asked = [(i, r.normal(size=6).tolist()) for i in range(50)] + [(60, [2.0, 4.0, 0.0, 0.0, 2.0, 2.0]), (61, None), (62, [0.0] * 6), (63, [1.0, 0.5]), (64, [1.0, 2.0, 3.0]), (None, [1.0] * 6)]
    b = spark.createDataFrame([(i, v, "x", 1) for i, v in base], "vec_id long, embedding array<double>, part string, id int").repartition(5)
    a = spark.createDataFrame(asked + asked[:3], "query_id long, embedding array<double>").repartition(3)
    for held in (65536, 20):
        monkeypatch.setattr(retrieval, "HELD", held)
        got = {}
        for x in retrieval.retrieved(b, a, 7).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((-x.similarity or 0.0, x.vec_id))
        assert got == brute(base, asked, 7)
    assert retrieval.retrieved(b.where("false"), a, 7).count() == 0 and retrieval.retrieved(b, a.where("false"), 7).count() == 0


def test_weak_queries_ask_again(spark):
    b = spark.createDataFrame([(1, [1.0, 0.0], "right"), (2, [0.0, 1.0], "up")], "vec_id long, embedding array<double>, text string")
    first = spark.createDataFrame([(10, [1.0, 0.1]), (11, [-1.0, 0.1]), (12, None), (13, [0.0, 0.0]), (14, [-1.0, -1.0])], "query_id long, embedding array<double>")
    again = spark.createDataFrame([(10, [0.0, 1.0]), (11, [1.0, 0.0]), (12, [0.2, 1.0]), (13, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.attempt, r.text) for r in retrieval.retried(b, first, again, 1, 0.3, carry=["text"]).collect()}
    assert got == {(10, 1, "right"), (11, 2, "right"), (12, 2, "up")}
