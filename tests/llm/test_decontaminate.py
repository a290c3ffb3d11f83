"""Benchmark passages with all edits in one place, and short items."""

import random

import pyarrow as pa
import pytest
from helpers import docs

from apexlake.llm import decontaminate
from apexlake.llm.common import Scratch, Words, strings


def prose(n, seed):
    return random.Random(seed).choices(["w%d" % i for i in range(400)], k=n)


@pytest.mark.parametrize("place", ["head", "middle", "end"])
def test_edits_in_one_place(spark, place):
    items = [(n, prose(n, n)) for n in (20, 40, 59, 120, 200)] + [(8, prose(8, 8))]
    texts = []
    for n, words in items:
        k = int(0.2 * n)
        at = {"head": 0, "middle": (n - k) // 2, "end": n - k}[place]
        texts.append(" ".join(prose(50, n + 1000) + words[:at] + ["x%d" % i for i in range(k)] + words[at + k :] + prose(50, n + 2000)))
        texts.append(" ".join(prose(50, n + 3000) + words[:at] + words[at + k :] + prose(50, n + 4000)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontaminate.matches(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2 * k + j, n) for k, (n, _) in enumerate(items) for j in range(2)}


def test_short_items_are_found_by_all_their_words(spark):
    bench = spark.createDataFrame([(1, "who won the race"), (2, "one two three four five six")], "item_id long, text string")
    texts = ["asked: WHO won\nthe race", "who won a race", "zero one two three four five six", "one two three four six"]
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs(spark, texts), bench).collect()} == {(0, 1, 0), (2, 2, 0)}


def test_recall_of_scattered_edits():
    """Substitutions, insertions and deletions anywhere, as many as are allowed: at least 97 % are found."""
    r, found, tried = random.Random(3), 0, 0
    items = [prose(n, 31 * n + i) for n in (10, 20, 30, 45, 60, 120) for i in range(12)]
    index = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items], 0.2, 8, 2, 3, 4)
    for number, item in enumerate(items):
        for _ in range(4):
            words = item[:]
            for k in range(int(0.2 * len(item))):
                at = r.randrange(len(words))
                words[at : at + r.randrange(2)] = ["x%d" % k] if r.random() < 0.7 else []
            text = " ".join(prose(60, r.random()) + words + prose(60, r.random()))
            if decontaminate.edits_of(index.lists[number], Words(strings(pa.array([" ".join(words)]))).hash.tolist(), int(0.2 * len(item))):
                tried += 1
                found += any(n == number for _, n, *_ in index.find(Words(strings(pa.array([text])))))
    assert tried > 250 and found >= 0.97 * tried


def test_rows_of_one_id_are_judged_each(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    bad, good = "x alpha beta gamma delta epsilon zeta eta theta iota kappa y", "nothing of that kind is in here"
    table = spark.createDataFrame([(7, bad, "a"), (7, good, "b"), (None, bad, "c"), (None, good, "d"), (None, None, "e")], "doc_id long, text string, item_id string")
    assert sorted(r.item_id for r in decontaminate.keep_clean(table, bench, Scratch(spark)).collect()) == ["b", "d", "e"]


def test_starts_without_runs_of_items_are_left_out_and_lose_nothing():
    """Words of items in other orders are not walked over; with runs or without them the same passages are found."""
    made = lambda items: decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items], 0.2, 8, 2, 3, 4)
    find = lambda text: sorted(index.find(Words(strings(pa.array([text])))))
    items, walked = [prose(n, 7 * n) for n in (8, 12, 25, 60)], []
    index = made(items)
    keys, index.keys = index.keys, lambda h, starts, scales: walked.append(len(starts)) or keys(h, starts, scales)
    assert find(" ".join(random.Random(1).choices(items[3], k=3000))) == [] and sum(walked) < 300
    items += [["w1", "w2", "w3"], ["w5", "w6"]]
    index, r, texts = made(items), random.Random(5), []
    for item in items * 20:
        words = item[:]
        for k in range(int(0.2 * len(item))):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = ["x%d" % k] if r.random() < 0.7 else []
        texts.append(" ".join(prose(30, r.random()) + words + prose(30, r.random())))
    with_runs = [find(t) for t in texts]
    index.left = [(size, 0) for size, _ in index.left]
    assert with_runs == [find(t) for t in texts] and sum(map(len, with_runs)) > 60
