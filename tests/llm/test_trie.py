"""The conversation trie against a dictionary of prefixes built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

from helpers import rows

from apexlake.llm import trie
from apexlake.llm.common import Scratch

TURNS = "conv_id long, turn long, role string, text string, depth string, key string, base int"


def brute(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if max(len(built[c]) for c in members[n]) == len(n)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, turns):
    return spark.createDataFrame([(*t, "d", "k", 1) for t in turns], TURNS).repartition(3)


def made(spark, turns):
    scratch = Scratch(spark)
    return sorted(rows(trie.nodes(trie.rebuilt(table(spark, turns), scratch), scratch)), key=str)


def test_is_brute_force(spark):
    r = random.Random(3)
    turns = []
    for c in [*range(0, 130), 5000, 5003, 2**40 + 7]:
        for k in range(r.choice([1, 1, 2, 3, 5, 9])):
            turns.append((c, r.choice([k, k, None, 3]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "hi there", "", None, "a\tb\n c", "é û"])))
    turns += [(140, k, "user", f"same {k}") for k in range(6)] * 2  # repeated rows are turns of their own
    turns += [(c, k, "user", f"copy {k}") for c in range(200, 260) for k in range(8)]  # many equal conversations
    turns += [(300, k, "user", "long " * 50) for k in range(400)] + [(301, 0, "user", "word " * 50_000)]
    turns += [(None, 1, "user", "nobody's"), (161, 0, None, None)]
    assert made(spark, turns) == brute(turns)


def test_blocks_of_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    turns = [(c, k, "user", "same") for c in range(1, 120, 2) for k in range(5)]
    assert made(spark, turns) == brute(turns)


def test_empty_table(spark):
    assert made(spark, []) == []
