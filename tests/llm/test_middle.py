"""Fill-in-the-middle against plain Python, and back."""

import hashlib
import re

import pytest
from helpers import docs, rows
from pyspark.sql import functions as F

from apexlake.llm import middle
from apexlake.llm.common import Scratch

TEXTS = [None, "", "a", "ab", "é😀û" * 7, "has <P> in it", "a<S>b", "<M>", "<", "<P", "x\ny\r\n" * 300, "long 😀 text " * 20_000, *[f"text {i} < P> <S " * (i % 9) for i in range(150)], "twice", "twice"]


def pieces(text, unit):
    return [m[0] for m in re.finditer(f"(?s)(?:{unit}|.)", text)]


def brute(doc_id, text, unit="."):
    text = text or ""
    units = pieces(text, unit)
    n, d = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "run"), [(".", 256), (".", 1), (r"[a-zé]+", 7), (r"[^\n]{0,20}\n", 2)])
def test_is_plain_python_and_comes_back(spark, unit, run):
    d = docs(spark, TEXTS).unionByName(spark.createDataFrame([(None, "no id"), (None, "no id either"), (None, None), (3, "same id"), (3, "same id")], "doc_id long, text string"), allowMissingColumns=True)
    d = d.withColumns({"n": F.lit("x"), "id": F.lit(1), "hash": F.lit(2), "low": F.lit(3), "at": F.lit(4)})  # clashing names
    got = middle.transform(d, Scratch(spark), unit=unit, run=run)
    back = got.select("*", middle.restore(F.col("output"), F.col("form")).alias("back"))
    want = [(*brute(r.doc_id, r.text, unit), r.text or "") for r in d.collect()]
    assert sorted(rows(back), key=str) == sorted(want, key=str)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_many_copies_of_a_row_stay(spark):
    d = spark.createDataFrame([(7, "copied text")] * 3000 + [(8, "another")], "doc_id long, text string").repartition(6)
    got = middle.transform(d, Scratch(spark)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {7: 3000, 8: 1}


def test_empty_table(spark):
    assert rows(middle.transform(docs(spark, []), Scratch(spark))) == []
