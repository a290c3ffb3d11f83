"""Reports of many sessions at once, with nothing, nulls and ties in them."""

import glob

from apexlake.operators import reporting

TOP = "session string, turn int, score double, composite_score double, events_count long, top_types string"
SESSIONS = "track string, session string, date string, lap int, laptime_s double, old_lap int, old_laptime_s double, old_session string"
SCORES = "track string, session string, date string, turn int, composite_score double, issue_score double, stability_score double, events_count long"


def text_of(rows):
    return {r[0]: r.text for r in rows.collect()}


def test_coaching_without_stability_or_advice(spark):
    rows = [("a", 1, 12.125, None, 3, "overslow, late_brake"), ("a", 2, 12.125, None, 0, "-"), ("a", 3, 30.0, None, 1, " late_brake"), ("b", 7, 1.0, 26.0, 2, None)]
    got = text_of(reporting.coaching(spark.createDataFrame(rows, TOP), sessions=spark.createDataFrame([("a",), ("b",), ("c",)], "session string")))
    assert "| late_brake | 2 |\n| overslow | 1 |" in got["a"] and got["a"].index("### Turn 3 (issue score: 30.00)") < got["a"].index("### Turn 1 (issue score: 12.12)") < got["a"].index("### Turn 2")
    assert "composite" not in got["a"] and "Stability" not in got["a"] and got["a"].endswith("---")
    assert "No issues detected." in got["b"] and "No issues detected." in got["c"] and got["c"].endswith("## Main Issue Analysis")
    assert text_of(reporting.coaching(spark.createDataFrame([], TOP))) == {}


def test_only_the_worst_turns_are_shown(spark):
    rows = [("a", t, float(t), 50.0 - t, t, "weak_exit") for t in range(1, 12)]
    said = spark.createDataFrame([("a", 1, "Weak Corner Exit", "Wait. ç"), ("a", 1, "Weak Corner Exit", "Wait. ç"), ("a", 2, "Weak Corner Exit", None), ("a", 9, "Weak Corner Exit", "not shown")], "session string, turn int, issue string, text string")
    got = text_of(reporting.coaching(spark.createDataFrame(rows, TOP), advice=said))["a"]
    assert [f"### Turn {t} " in got for t in range(1, 12)] == [True] * 5 + [False] * 6
    assert "| weak_exit | 11 |" in got and got.count("**AI-Personalized Coaching Advice**") == 1 and "Weak Corner Exit" not in got


def test_comparison(spark, tmp_path):
    sessions = [("t", "s1", "2024-01-02", 3, 81.5, None, None, None), ("t", "s2", "2024-01-01", 0, 0.0, None, None, None), ("t", "s3", "2024-01-03", 4, 80.0, 9, 79.125, "old"), ("lone", "x", "2024-01-01", 1, 70.0, None, None, None), (None, "n", None, None, None, None, None, None)]
    scores = [("t", "s1", "2024-01-02", t, 10.0 + t, 1.0, 0.5, 2) for t in range(1, 13)] + [("t", "s3", "2024-01-03", t, 10.0, 1.0, 0.5, 2) for t in (1, 12)] + [("lone", "x", "2024-01-01", 1, 5.0, 5.0, 5.0, 5)]
    reports = reporting.comparison(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(scores, SCORES), made="2024-02-01 10:00:00")
    got = text_of(reports)
    t = got["t"]
    assert "**Generated Time**: 2024-02-01 10:00:00" in t and t.index("| s2 | 2024-01-01 | N/A | N/A | - |") < t.index("| s1 | 2024-01-02 | Lap 3 | 81.50s | ✅ Current PB |") < t.index("📌 Using Historical PB")
    assert "| s1 | 81.50s | +1.50s | ✅ Current PB |" in t and "| s3 | 80.00s | Fastest | 📌 Historical PB |" in t and "Lap 9, 79.12s (from old)" in t
    assert "### Turn 10\n" in t and "### Turn 11\n" not in t and "**Improvement**: 1.00 (from 11.00 to 10.00)" in t
    assert "- **Change**: +1.50s (+1.8%)\n- **Trend**: improved" in t and "| Turn 12 | 22.00 | 10.00 | +12.00 | improved |" in t and "| Turn 2 |" not in t
    assert "Trend" not in got["lone"] and "Issues" not in got["lone"] and "| x | 70.00s | Fastest |" in got["lone"] and "| n |" not in (got[None] or "")
    reporting.write(reports, f"file://{tmp_path}/out", ["track"])
    (path,) = glob.glob(f"{tmp_path}/out/track=t/*.txt")
    assert open(path, encoding="utf-8").read() == t + "\n"


def test_radar(spark):
    rows = [("t", s, s, turn, float(turn), 0.0, 0.0, 0) for s in ("1", "2", "3") for turn in range(10) if (s, turn) != ("3", 0)]
    got = reporting.radar(spark.createDataFrame(rows, SCORES)).orderBy("turn").collect()
    assert [r.turn for r in got] == list(range(1, 9)) and got[0].angle == 0 and abs(got[4].angle - 3.14159265) < 1e-6
