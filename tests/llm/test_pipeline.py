"""The corpus pipeline as a whole on a small corpus, and its filters on repeated and null ids."""

import random

from helpers import DOCS

import corpus_pipeline
from apexlake.llm import jaccard
from apexlake.llm.common import Scratch


def prose(n, seed):
    return " ".join(random.Random(seed).choices(["word%d" % i for i in range(500)], k=n))


def test_stages_in_a_row(spark, tmp_path):
    item = prose(30, 999)
    texts = [prose(80, i) for i in range(60)]
    texts[10] = texts[3] + " end"
    texts[11] = texts[4]
    texts[20] = prose(40, 500) + " " + item + " " + prose(40, 501)
    texts += ["vile scumbag rotten " * 6 + prose(60, 700 + i) for i in range(20)] + [None, ""]
    spark.createDataFrame([(i, t, None, "s%d" % (i % 3), None, "x", "y", None) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(82)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark).save(stage(spark, docs, str(tmp_path)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept[0] == set(range(60)) | {80, 81}
    assert kept[1] == kept[0] - {10, 11}  # one line each, like an earlier one
    assert kept[2] == kept[1] and kept[3] == kept[2] - {20}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[3]


def test_one_row_of_each_group_stays(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(5, a), (5, b), (6, a), (7, b + " more"), (8, prose(60, 3)), (8, prose(60, 3)), (None, a), (None, None), (9, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in jaccard.keep_one(table, Scratch(spark)).collect())
    assert kept == sorted([("5", a), ("5", b), ("8", prose(60, 3)), ("None", "None"), ("9", "")])
