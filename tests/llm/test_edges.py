"""Every operator and stage on tables with clashing columns, null ids and texts, repeated rows, a long text, and without rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apexlake.llm import decontaminate, jaccard, licenses, lines, middle, neighbours, packing, quality, rules, toxicity, trie, urls, warc
from apexlake.llm.common import Scratch
from apexlake.llm.queries import tokenizer_file

#: Names that operators use inside.
NAMES = ("_id", "_body", "_docs", "_keys", "_gone", "_lines", "_text", "_removed", "body", "removed", "comp", "place", "first", "cls", "n", "line", "word", "words", "leaf", "member", "u", "v", "node", "root", "key", "hash", "id", "row", "cut", "whole", "at", "part", "times", "score", "toxic", "quality", "item_id", "host", "label", "window", "queue", "tokens", "kept", "query_id", "rank", "vec", "shard", "depth", "turns")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(8)


def prose(n):
    return " ".join(R.choices(["word%d" % i for i in range(300)], k=n))


TEXTS = [prose(60 + i) for i in range(12)]
ROWS = [(i, t, "en", f"s{i % 3}", 5) for i, t in enumerate(TEXTS)] + [(12, TEXTS[0], None, None, None), (13, TEXTS[1] + " more", "en", "s1", 3)]
ROWS += [(14, None, "en", "s0", 0), (15, "", None, "s0", 0), (16, " \n\t", "en", None, 3), (None, TEXTS[2], "en", "s1", 1), (None, None, None, None, None), (17, "long " * 30_000 + prose(3000), "en", "s2", 1), (18, "vile scumbag " * 20, "en", "s2", 1)]
ROWS += [ROWS[4], ROWS[4], ROWS[14], ROWS[17]]  # repeated


def clash(df):
    return df.withColumns({n: F.lit(f"c {n}") for n in NAMES if n not in df.columns})


def documents(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 18)) for i in range(19)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, TEXTS[5]), (2, TEXTS[6][:80]), (3, None), (None, "x y z")], "item_id long, text string")


def pages(spark):
    rows = [(1, "http://casino.example.com/a", "<p>casino win</p>" * 20), (2, "http://example.net/de/8x", "<p>garden sunny</p>" * 20), (3, None, None), (None, "http://sunnygarden.org/", "<p>x</p>"), (4, "no url", "<p>garden sunny</p>" * 20), (1, "http://casino.example.com/a", "<p>casino win</p>" * 20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def turns(spark):
    return spark.createDataFrame([(c, t, "user" if t else None, TEXTS[c % 3]) for c in range(8) for t in range(3)] + [(None, 1, "user", "x"), (9, None, None, None), (9, 1, "a", "b"), (9, 1, "a", "b")], "conv_id long, turn long, role string, text string")


def vectors(spark):
    return spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(50)] + [(100, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (101, None)], "vec_id long, embedding array<float>")


OPERATORS = {
    "op1": (documents, lambda s, d: decontaminate.matches(d, items(s))),
    "op1 stage": (documents, lambda s, d: decontaminate.keep_clean(d, items(s), Scratch(s))),
    "op2": (documents, lambda s, d: rules.judge(d, Scratch(s))),
    "op3": (documents, lambda s, d: toxicity.score(d, labels(s), Scratch(s))),
    "op3 stage": (documents, lambda s, d: toxicity.keep_clean(d, labels(s), Scratch(s))),
    "op4": (pages, lambda s, d: warc.archive(d, w := Scratch(s), w.path(), payload=False).select("response.payload_digest", "response.record_type", "metadata.page_id")),
    "op5": (pages, lambda s, d: urls.judge(d, Scratch(s))),
    "op6": (documents, lambda s, d: jaccard.join(d, Scratch(s))),
    "op6 stage": (documents, lambda s, d: jaccard.keep_one(d, Scratch(s))),
    "op7": (documents, lambda s, d: licenses.scan(d, Scratch(s))),
    "op8": (documents, lambda s, d: lines.dedup(d, Scratch(s), least_words=1)),
    "op8 stage": (documents, lambda s, d: lines.keep_first(d, Scratch(s), least_words=1)),
    "op9": (documents, lambda s, d: quality.score(d, labels(s), Scratch(s))),
    "op10": (documents, lambda s, d: packing.pack(d, Scratch(s), tokenizer_file())),
    "op11": (turns, lambda s, d: trie.nodes(trie.rebuilt(d, w := Scratch(s)), w)),
    "op12": (documents, lambda s, d: middle.transform(d, Scratch(s))),
    "op13": (vectors, lambda s, d: neighbours.search(d, Scratch(s))),
}


def table(df, columns):
    rows = df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes)).collect()
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    source, operator = OPERATORS[name]
    plain = operator(spark, source(spark))
    got = operator(spark, clash(source(spark)))
    assert table(got, plain.columns) == table(plain, plain.columns)
    if name.endswith("stage"):
        assert set(got.columns) == set(clash(source(spark)).columns) and got.where("node <> 'c node' or _body <> 'c _body'").count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    source, operator = OPERATORS[name]
    assert operator(spark, source(spark).where("false")).count() == 0


def test_stages_keep_the_columns_of_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "packing"]
