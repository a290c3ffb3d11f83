"""What the similarity join rules out before it compares sets, and how often it deals entries out."""

import random

from helpers import docs

from apexlake.llm import common, jaccard
from apexlake.llm.common import Scratch


def near(n, edits, seed):
    """One text of n words and copies of it with so many words exchanged."""
    r = random.Random(seed)
    base = ["w%d" % r.randrange(5000) for _ in range(n)]
    out = [base]
    for k in range(6):
        own = base[:]
        for i in r.sample(range(n), edits):
            own[i] = "x%d" % r.randrange(5000)
        out.append(own)
    return [" ".join(x) for x in out]


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_bitmaps_rule_out_unlike_sets_but_no_link(spark):
    texts = near(150, 1, 1) + near(150, 5, 2) + near(150, 12, 3) + near(60, 3, 4)
    scratch = Scratch(spark)
    rows = docs(spark, texts).selectExpr("doc_id", "doc_id as body", "text")
    sets = scratch.save(rows.mapInArrow(jaccard._profile, jaccard.PROFILE)).where("shingles is not null")
    cls = {r.doc_id: r.cls for r in sets.select("doc_id", "cls").collect()}
    pairs = {(min(cls[a], cls[b]), max(cls[a], cls[b])): (shingles(texts[a]), shingles(texts[b])) for a in cls for b in cls if a < b}
    links = {p for p, (x, y) in pairs.items() if 100 * len(x & y) >= 80 * len(x | y)}
    left = {tuple(r) for r in jaccard.possible(spark.createDataFrame(list(pairs), "a long, b long"), sets, scratch, 80).collect()}
    assert links and links <= left and len(left) < 0.3 * len(pairs)
    assert {tuple(r) for r in jaccard.verified(spark.createDataFrame(list(pairs), "a long, b long"), sets, scratch, 80).collect()} == links


def test_union_find_stops_once_all_are_stars(spark, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, **o: saved.append(1) or save(self, df, **o))
    star = spark.createDataFrame([(9, 1), (8, 1), (7, 2), (5, 5)], "a long, b long")
    assert {tuple(r) for r in common.components(star, Scratch(spark)).collect()} == {(9, 1), (8, 1), (1, 1), (7, 2), (2, 2)}
    assert len(saved) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in common.components(chain, Scratch(spark)).collect()} == {(i, 0) for i in range(41)}
