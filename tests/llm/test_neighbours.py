"""Nearest neighbours against brute force."""

import numpy as np
from helpers import rows

from apexlake.llm import neighbours
from apexlake.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, id string, vec int, radius int, bound int, shard string"


def table(spark, pairs):
    return spark.createDataFrame([(i, v, "a", 1, 2, 3, "s") for i, v in pairs], SCHEMA).repartition(5)


def brute(pairs, dims, k=10):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in pairs if i is not None and v and None not in v and len(v) == dims and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in sorted(((i, v) for i, v in sound if i % 100 == 0), key=lambda x: (x[0], *-x[1])):
        out[i] = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in sound if j != i)[:k]
    return out


def made(spark, pairs, **how):
    out = {}
    for q, rank, i, score in sorted(rows(neighbours.search(table(spark, pairs), Scratch(spark), **how))):
        out.setdefault(q, []).append((score, i))
        assert rank == len(out[q])
    return out


def clustered(n, dims=32, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, dims))
    return [(i, (centres[min(r.geometric(0.4), 20) - 1] + r.standard_normal(dims) * r.choice([0.05, 0.5])).tolist()) for i in range(n)]


def test_recall_and_exact_scores(spark):
    pairs = clustered(6000)
    got, want = made(spark, pairs, sample=1000), brute(pairs, 32)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.95
    exact = {(q, i): s for q, v in brute(pairs, 32, 6000).items() for s, i in v}
    assert all(exact[q, i] == s for q, v in got.items() for s, i in v)


def test_odd_rows(spark):
    pairs = [*clustered(230, 8, 3), (400, [0.0] * 8), (401, None), (402, []), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (500, [float("inf")] * 8), (None, [1.0] * 8), (600, [1.0] * 5)]
    pairs += [(700 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(60)]  # ties go by id
    pairs += [(100, pairs[100][1]), (7, pairs[7][1]), (800, [1.0] * 8), (800, [-1.0] * 8)]  # repeated rows, two vectors for an id
    assert made(spark, pairs, recall=1.0) == brute(pairs, 8)
    few = [(100, [1.0, 2.0]), (200, [2.0, 1.0]), (5, [1.0, 1.0])]
    assert made(spark, few) == brute(few, 2)
    assert made(spark, few[:1]) == {} and made(spark, []) == {}


def test_all_codes_within_the_radius(spark):
    r = np.random.default_rng(1)
    codes = r.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[:500] = codes[0] ^ (1 << r.integers(0, 16, (500, 4))).astype(np.uint16)
    index = neighbours.Index(codes)
    for radius in (0, 1, 3, 4, 5, 11, 22, 30, 64):
        for q in (0, 1, 600):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(neighbours.hamming(codes, codes[q]) <= radius).tolist()
