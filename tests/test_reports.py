"""Advice texts, reports, the store of sessions and report data on inputs with known answers."""

import json

from pyspark.sql import functions as F

from apexlake.functions import advice
from apexlake.operators import compare, issues, plots, reporting
from apexlake.sources import reports, sessions


def _on(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.t for r in rows.select("i", function(F.col("text")).alias("t")).orderBy("i").collect()]


def test_repair(spark):
    pairs = {
        "Kurve fährt".encode().decode("latin-1"): "Kurve fährt",
        "Kurve fährt": "Kurve fährt",  # Latin-1, but no UTF-8 when encoded so
        "已 fährt".replace("已", "—"): "— fährt",
        "**Symptom (症状)**: x": "**Symptom:** x",
        "**Likely Causes\t(why)**: y": "**Likely Causes:** y",
        "a (症状) b": "a b",
        "Line: : two  spaces\n\n\n\nend ": "Line: two spaces\n\nend",
        "**Note  :** z": "**Note:** z",
        'ç—‡çŠ¶ â€™s â€"': "症状 's —",
        "": "",
    }
    assert _on(spark, advice.repair, [*pairs, None]) == [*pairs.values(), None]


def test_one_format(spark):
    pairs = {
        "The driver brakes. The DRIVER's line; a driver can wait, a driver waits": "you brakes. you's line; a you can wait, a driver waits",
        "1. Analysis : late\n2. recommendation:\n a. one\n7. two\n\n b. three\nRemember\n4. kept": "Analysis: late\nActionable Recommendations:\n1. one\n2. two\n\n3. three\nRemember\n4. kept",
        "Recommendations:\n5. x\nRecommendations:\n5. y": "Actionable Recommendations:\n1. x\nActionable Recommendations:\n1. y",
        "Analysis: a\n3. Implementation: go\nslow\n\nend": "Analysis: a\n\nend",
        "a\nImplementation: go\nslow": "a",
        "a\n\n\n\n\nb": "a\n\n\nb",
        "": "",
    }
    assert _on(spark, advice.one_format, [*pairs, None]) == [*pairs.values(), None]


def test_line_kinds(spark):
    text = "# 📊 Top **x**\n#### Low\n* **b** item\n| a | b |\n|:--|---|\n***\n\n🟢 plain **bold**\n##no"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    got = [(r.kind, r.content) for r in advice.line_kinds(rows, "k").where("k = 1").orderBy("at").collect()]
    assert got == [("h1", "Top **x**"), ("h4", "Low"), ("item", "<b>b</b> item"), ("row", "| a | b |"), ("separator", "|:--|---|"), ("rule", "***"), ("blank", ""), ("paragraph", "plain <b>bold</b>"), ("paragraph", "##no")]
    assert [(r.k, r.kind) for r in advice.line_kinds(rows, "k").where("k > 1").collect()] == [(3, "blank")]


def test_reports_and_references(spark, tmp_path):
    head = reports.HEAD
    report = f"# R\n### Turn 3\n{head}\n\n**Old:**\n\nold\n### Turn 4\nno advice\n### Turn 3\n{head}\n\n**Late:**\n\n one\n\n\n\ntwo \n**Analysis:**\n\nskip\n\n**Late:**\n\nlast\n---\n### Turn 12\n{head}\n\n**Exit:** \n\nwide\n"
    (tmp_path / "r.md").write_text(report)
    got = {(r.report, r.turn, r.issue): r.text for r in reports.advice(reports.read_reports(spark, str(tmp_path / "r.md"))).collect()}
    assert got == {("r.md", 3, "Late"): "last", ("r.md", 12, "Exit"): "wide"}
    lines = [
        json.dumps({"turn": 3, "issue_name": "Late", "gold_content": ["a", "b"]}), "{bad", "", json.dumps({"turn": None, "issue_name": "Late", "reference": "x"}),
        json.dumps({"turn": "3", "issue_name": "Late", "gold_content": [], "reference": "r"}), json.dumps({"turn": 12, "issue_name": "Exit", "gold_sections": ["s", "t"]}), json.dumps({"turn": 5, "issue_name": "", "reference": "x"}), json.dumps({"turn": 6, "issue_name": "No"}),
    ]
    gold = reports.references(spark.createDataFrame(list(enumerate(lines)), "rid int, value string"))
    assert sorted((r.turn, r.issue, r.reference) for r in gold.collect()) == [(3, "Late", "a\n\nb"), (3, "Late", "r"), (12, "Exit", "s t")]
    both = reports.matched(spark.createDataFrame([(3, "Late", "last"), (3, "None", "x"), (12, "Exit", "")], "turn int, issue string, text string"), gold)
    assert [(r.turn, r.reference) for r in both.collect()] == [(3, "a\n\nb")]


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert sessions.load(spark, root, "top_issues") is None and sessions.history(spark, root, "01", 2) is None
    sessions.save(spark.createDataFrame([(1, 5.0), (2, None)], "turn int, score double"), root, "top_issues", "01", "2024-01-01")
    one = sessions.load(spark, root, "top_issues")
    assert compare.long_table(one).count() == 0
    sessions.save(spark.createDataFrame([(1, 4.0, 7.0)], "turn int, score double, composite_score double"), root, "top_issues", "1")
    sessions.save(spark.createDataFrame([(1, 6.0)], "turn int, score double"), root, "top_issues", "01", "2024-01-03")
    got = {(r.session, r.turn): (r.score, r.composite_score) for r in sessions.load(spark, root, "top_issues").collect()}
    assert got == {("01", 1): (6.0, None), ("1", 1): (4.0, 7.0)}
    assert sorted(r.turn for r in sessions.load(spark, root, "top_issues", backup=True).collect()) == [1, 2]
    long = {r.session: (r.composite_score, r.issue_score, r.events_count) for r in compare.long_table(sessions.load(spark, root, "top_issues")).collect()}
    assert long == {"01": (0.0, 6.0, 0), "1": (7.0, 4.0, 0)}
    sessions.save(spark.createDataFrame([(2, 1, 9.5), (3, 1, 9.0)], "lap int, turn int, s_apex double"), root, "corner_cards", "01")
    assert [r.s_apex for r in sessions.history(spark, root, "01", 2).collect()] == [9.5] and sessions.history(spark, root, "01", 8) is None
    known = sessions.registered(sessions.load(spark, root, "top_issues"), spark.createDataFrame([("1", 4, 80.5)], "session string, lap int, laptime_s double"))
    assert {r.session: r.lap for r in known.collect()} == {"01": None, "1": 4}


def test_documents(spark, tmp_path):
    path = f"file://{tmp_path}/pb"
    assert sessions.read_document(spark, path, {"a": 1}) == {"a": 1}
    sessions.save_document(spark, {"a": 2, "pb": {"lap": 3}}, path)
    assert sessions.read_document(spark, path, {"a": 1, "b": 0}) == {"a": 2, "b": 0, "pb": {"lap": 3}}
    (tmp_path / "bad").write_text("{no")
    assert sessions.read_document(spark, f"file://{tmp_path}/bad", {"a": 1}) == {"a": 1}


def test_summary_and_columns(spark):
    events = spark.createDataFrame([("late_brake",), ("late_brake",), ("overslow",)], "type string")
    turns = spark.createDataFrame([(1, 2, "late_brake", 3.456), (2, 5, "", 1.0)], "turn int, events_count int, top_types string, max_severity double")
    top = spark.createDataFrame([(1, 9.876, 1.0, 2.0, 3.0, 0.5)], "turn int, score double, comp_s double, comp_v double, comp_sev double, comp_freq double")
    one = lambda df: df.withColumn("session", F.lit("s"))
    known = spark.createDataFrame([("s",), ("t",)], "session string")
    lines, empty = (r.text for r in reporting.event_summary(one(events), one(turns), one(top), known).orderBy("session").collect())
    lines = lines.split("\n")
    assert "| late_brake | 2 |" in lines and "| T2 | 5 | - | 1.00 |" in lines and "| T1 | 9.88 | 1.00 | 2.00 | 3.00 | 0.50 |" in lines
    assert lines.index("| T2 | 5 | - | 1.00 |") < lines.index("| T1 | 2 | late_brake | 3.46 |") and lines.index("| late_brake | 2 |") < lines.index("| overslow | 1 |")
    assert "| (None) | 0 |" in empty and "| - | 0 | - | 0.0 |" in empty and empty.endswith("| - | 0.0 | 0.0 | 0.0 | 0.0 | 0.0 |\n")
    whole = plots.whole_issues(top.withColumn("extra", F.lit(1)))
    assert whole.columns == [*plots.ISSUE_COLUMNS, "extra"] and whole.first().top_types == ""
    found = spark.createDataFrame([(k, x, issues.FLAGS[k]) for k, x in (("late_brake", 2.5), ("weak_exit", 0.0004), ("overslow", 12345678.5), ("early_brake", 3.0), ("late_brake", None))], "event_id string, severity double, ref_flags string")
    assert [r.payload for r in plots.payload(found).collect()] == ['{"delta_s": "late", "severity": 2.5}', '{"vexit": "lower", "a_long_peak": "weak", "severity": 0.0004}', '{"vmin": "lower", "severity": 12345678.5}', '{"delta_s": "early", "severity": 3.0}', None]
    assert _on(spark, lambda t: advice.signed_text(t.cast("double"), "s"), ["1.239", "-0.5"]) == ["+1.24s", "-0.50s"]


def test_blocks_of_advice(spark):
    texts = {
        "**A:**\n\nfirst\nline\n\n**B:** \n \n\nsecond **C:**\n\nstill second\n---\nlost\n**D:**\nno empty line\n**E:**\n\nlast": [("A", "first\nline"), ("B", "second **C:**\n\nstill second"), ("E", "last")],
        "before **F:**\n\ntext\n**bold** words\n**Note: x\nout": [("F", "text\n**bold** words")],
        "**G:**\n\n**H:**\n\nx": [("G", ""), ("H", "x")],
        "": [], "no titles\n\n---": [],
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", reports.blocks(F.col("t")).alias("b")).collect()
    assert {r.t: [(b.title, b.body.strip()) for b in r.b] for r in got} == texts
    assert spark.createDataFrame([(None,)], "t string").select(reports.blocks(F.col("t")).alias("b")).first().b is None


def test_evaluation_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("m1", 10, 0.5), ("m1", 20, None), ("m2", 5, 0.25)], "model string, length int, f1 double")
    reports.save_evaluation(rows, f"file://{tmp_path}/eval", lengths=("length",), scores=("f1",))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/eval/models").where("model = 'm1'").count() == 2
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/eval/summary_markdown").collect()]
    assert lines[0] == "| model | n | length | f1 |" and "| m1 | 2 | 15.0 | 0.5000 |" in lines and "| m2 | 1 | 5.0 | 0.2500 |" in lines
