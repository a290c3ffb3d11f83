"""The whole run from files to reports, over several sessions at once and again with kept bests."""

import glob
import json
import math

import pytest

from apexlake import run
from apexlake.sources import sessions


def write_session(path, laps, pace, extra=""):
    """A five-lobed track driven at a steady pace with slower corners; some lines broken."""
    lines = ["Time (s),Latitude (deg),Longitude (deg),Speed (km/h),Lap #" + extra]
    t, lap_rows = 0.0, 240
    for lap in range(laps):
        for i in range(lap_rows if lap != 2 else 130):  # lap 2 is cut short
            a = 2 * math.pi * i / lap_rows
            r = 300 + 90 * math.sin(5 * a)
            v = pace - 6 * math.sin(5 * a) ** 2 + lap % 3
            t += 2 * math.pi * r / lap_rows / v
            lines.append(f"{t:.4f},{45 + r * math.sin(a) / 111132:.8f},{7 + r * math.cos(a) / 78847:.8f},{v * 3.6:.4f},{lap}" + ("," if extra else ""))
        lines.append("broken,,,,")
    path.write_text("\n".join(lines) + "\n")


def test_presets():
    assert run.settings() == run.DEFAULT and run.settings("default", {"topk": 3})["topk"] == 8  # presets overrule flags
    assert run.settings("technical_track")["stability_weight"] == 0.35 and run.settings("sows_track")["min_turn_gap_m"] == 65.0
    assert run.settings("mine", {"topk": 5}, {"presets": {"mine": {"brake_thr_g": -0.4, "other": 1}}}) == run.DEFAULT | {"topk": 5, "brake_thr_g": -0.4}
    assert run.settings("unknown", {"topk": None, "csv": "x"}) == run.DEFAULT


def test_nothing_to_read(spark, tmp_path, capsys):
    assert run.main(["--csv", f"file://{tmp_path}/none"], spark) == 1
    assert run.main(["--list-presets"], spark) == 0 and "technical_track: " in capsys.readouterr().out


def test_files_to_reports(spark, tmp_path):
    folder, root = tmp_path / "csv", f"file://{tmp_path}/store"
    folder.mkdir()
    write_session(folder / "monday.csv", 7, 30.0)
    write_session(folder / "tuesday.csv", 6, 28.0)
    argv = ["--csv", f"file://{folder}", "--outdir", root, "--session-date", "2024-05-01", "--apex-scan", "--preset", "sows_track", "--save-config", f"{root}/config"]
    assert run.main(argv, spark) == 0
    load = lambda name, *named: sessions.load(spark, root, name, named or None)
    got = {r.session: r for r in load("benchmark_lap").collect()}
    assert set(got) == {"monday", "tuesday"} and got["monday"].lap == 5 and not got["monday"].is_historical_pb  # laps 1 to 5, the faster have lap % 3 = 2; lap 2 is cut short
    cards = load("corner_cards", "monday").toPandas()
    assert set(cards.lap) == {1, 3, 4, 5} and cards.groupby("lap").turn.nunique().eq(10).all()
    assert cards[cards.lap == 5].d_Vmin.abs().max() == pytest.approx(0, abs=1e-9) and cards[cards.lap == 1].d_Vmin.max() < 0
    assert load("apex_scan").count() == 162 and load("curvature_debug").count() == 2000 and {r.apex_count for r in load("apex_params").collect()} == {10}
    assert load("events").where("type = 'overslow' and source = 'rule_v1'").count() > 0
    top = load("top_issues", "tuesday").collect()
    assert 0 < len(top) <= 8 and all(r.composite_score is not None for r in top)
    assert {r.kind for r in load("consistency_values").collect()} == {"raw", "norm"}
    (report,) = glob.glob(f"{tmp_path}/store/coaching_advice_report/session=monday/*.txt")
    assert "### Turn " in open(report).read()
    (report,) = glob.glob(f"{tmp_path}/store/events_summary/session=tuesday/*.txt")
    assert "| conservative_entry | 30 |" in open(report).read() and "| T10 | " in open(report).read()
    assert sessions.read_document(spark, f"{root}/config", {})["apex_height_quantile"] == 0.75
    best = sessions.current_bests(spark, root).first()
    assert (best.track, best.lap, best.session) == ("track", 5, "monday") and best.laptime_s == pytest.approx(got["monday"].laptime_s)

    # A slower session is held against the kept best, whose cards are in the store; it adds nothing to it.
    write_session(tmp_path / "wednesday.csv", 5, 25.0)
    assert run.main(["--csv", f"file://{tmp_path}/wednesday.csv", "--outdir", root, "--session-date", "2024-05-02", "--apex-auto-tune", "--apex-target-min", "9", "--apex-target-max", "11"], spark) == 0
    own = load("benchmark_lap", "wednesday").first()
    assert own.is_historical_pb and own.lap == 5 and own["mode"] == "historical_pb"
    slow = load("corner_cards", "wednesday").toPandas()
    assert slow.d_Vmin.notna().all() and slow.d_Vmin.max() < -2
    assert sessions.bests(spark, root).count() == 1 and load("top_issues").select("session").distinct().count() == 3
    assert json.loads(json.dumps(run.PRESETS)) == run.PRESETS
