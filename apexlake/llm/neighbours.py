"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that codes and radii are learned from, at most.
SAMPLE = 8192
#: Bits of a substring: one table of an index has so many places, as a power of two.
BITS = 16
#: Vectors in a shard of the index, at most but for chance.
SHARD = 65536
_ONES = np.bitwise_count(np.arange(1 << BITS))
#: All values of a substring by the number of their bits, and how many have so many bits at most.
_FLIPS = np.argsort(_ONES, kind="stable").astype(np.uint16)
_FEWER = np.cumsum(np.bincount(_ONES))


class Codes:
    """Binary codes: centred vectors, turned by a rotation under which signs lose least (iterative quantisation).

    Beyond a code of as many bits as the vectors have components, further rotations are learned from other
    beginnings. Codes are rows of 16-bit substrings.
    """

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 20, seed: int = 7):
        rng, dims = np.random.default_rng(seed), sample.shape[1]
        self.mean = sample.mean(0)
        x, turns = sample - self.mean, []
        while sum(t.shape[1] for t in turns) < bits:
            turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0))
                turn = u @ v
            turns.append(turn)
        self.turn = np.concatenate(turns, 1)[:, :bits]
        self.sample, self.own = sample, self.encode(sample)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        bits = np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.uint16)

    def radii(self, distances: np.ndarray, recall: float) -> np.ndarray:
        """Hamming radius by Euclidean distance: within it are the codes of a share ``recall`` of pairs so far apart.

        Bits differ in proportion to the angle between vectors, so pairs of the sample are sorted by distance
        and cut into equal parts; a part's radius is the quantile of its Hamming distances, and no less than a nearer part's.
        """
        step = max(1, len(self.sample) // 512)
        some = self.sample[::step]
        d = np.sqrt(np.maximum((some**2).sum(1)[:, None] - 2 * some @ self.sample.T + (self.sample**2).sum(1), 0))
        h = hamming(self.own[::step, None], self.own[None])
        apart = (np.arange(len(some)) * step)[:, None] != np.arange(len(self.sample))
        d, h = d[apart], h[apart]
        if not len(d):
            return np.full(len(distances), self.turn.shape[1])
        order = np.argsort(d)
        # Near pairs are few and all that count: parts double in size.
        edges = np.unique(np.minimum(64 * 2 ** np.arange(30), len(d)))
        parts = np.split(h[order], edges[:-1])
        reach = np.maximum.accumulate([np.quantile(p, recall, method="higher") for p in parts])
        return reach[np.minimum(np.searchsorted(d[order][edges - 1], distances), len(edges) - 1)].astype(int)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[a ^ b].sum(-1, dtype=np.int32)


class Index:
    """Of each substring of the codes: the rows at each of its values. Built for one shard, in the task that holds it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for column in codes.T:
            counts = np.bincount(column, minlength=1 << BITS)
            self.tables.append((np.argsort(column, kind="stable").astype(np.int32), np.concatenate(([0], np.cumsum(counts))), np.flatnonzero(counts).astype(np.uint16)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ from the code in at most ``radius`` bits.

        Pigeonhole: with m substrings and radius = m * q + r, such a row differs in at most q bits in one of the
        first r + 1 substrings, or in at most q - 1 in one of the others. Values of a substring that near are looked up.
        """
        share, more = divmod(radius, len(self.tables))
        found = np.zeros(len(self.codes), bool)
        for k, (rows, starts, values) in enumerate(self.tables):
            near = share if k <= more else share - 1
            if near < 0:
                continue
            if _FEWER[near] < len(values):
                values = code[k] ^ _FLIPS[: _FEWER[near]]
            else:  # fewer values occur than are that near
                values = values[_ONES[values ^ code[k]] <= near]
            first = starts[values]
            sizes = starts[values.astype(np.int32) + 1] - first
            ends = np.cumsum(sizes)
            found[rows[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]] = True
        at = np.flatnonzero(found)
        return at[hamming(self.codes[at], code) <= radius]


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part; of several lengths the most common, of equally common ones the smallest."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & sound)
    common = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("vec") == (common["dims"] if common else 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fitted(rows: DataFrame, sample: int, bits: int) -> tuple[int, np.ndarray, Codes | None]:
    """Number of rows, ids of the sample, codes learned from it: ``sample`` rows at most, drawn by a hash of id and vector."""
    n = rows.count()
    share = min(1.0, 0.95 * sample / max(n, 1)) if n > sample else 1.0
    drawn = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).toArrow()
    if not len(drawn):
        return n, np.zeros(0, np.int64), None
    return n, drawn.column("id").to_numpy(), Codes(matrix(drawn.column("vec").combine_chunks()), bits)


def search(
    vectors: DataFrame, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, bits: int = 64, recall: float = 0.97, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``.

    The index is dealt out: each shard holds some 65,536 vectors at most, drawn by hash, and an index of them, so that
    copies of a vector, or near copies by the million, spread over all shards. Every query visits every
    shard; a task holds one shard and a batch of queries, whatever there is of either. A query's
    distance to its k-th nearest in the sample bounds that to its k-th nearest of all, and gives
    its Hamming radius: a share ``recall`` of pairs of the sample that far apart lies within it. All codes within
    the radius are looked up, their vectors compared in double precision, and k for each shard kept,
    none beyond the bound; the sample's nearest count as found. So a radius too small for a query's neighbours is
    what can lose one, nothing else, and each query gets k.

    Rows take no part whose id is null, or whose vector is null, empty, zero, or holds null or non-finite components, or has
    another length than most. Equal distances go by smaller id. Repeated rows are candidates each; rows with the
    query's id are its own. Of different vectors of a queried id the smallest as an array
    asks. With k candidates or fewer all are returned. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    n, ids, codes = fitted(rows, sample, bits)
    shards = max(-(-n // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = spark.sparkContext.broadcast((ids, codes))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = known.value
        for batch in batches:
            asks, bounds, near = matrix(batch.column("vec")), np.full(len(batch), np.inf), []
            for i, (own, query) in enumerate(zip(batch.column("id").to_numpy(), asks)):
                others = np.flatnonzero(ids != own)
                d = distances(codes.sample[others], query)
                if len(d) >= k:
                    bounds[i] = np.partition(d, k - 1)[k - 1]
                near.append([{"vec_id": int(ids[others[j]]), "score": float(d[j])} for j in np.flatnonzero(d <= bounds[i])])
            radius = np.where(np.isinf(bounds), codes.turn.shape[1], codes.radii(np.minimum(bounds, 1e300), recall))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(radius, pa.int32()), pa.array(bounds), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))], ["id", "vec", "radius", "bound", "near"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, index, here = known.value[1], [], None, None
        for batch in batches:
            shard, asks = batch.column("shard").to_numpy(), batch.column("radius").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(shard * 2 + asks)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                part = batch.slice(a, b - a)
                if shard[a] != here:
                    here, held, index = shard[a], [], None
                part_ids, part_vectors = part.column("id").to_numpy(), matrix(part.column("vec"))
                if not asks[a]:
                    held.append((part_ids, part_vectors))
                    continue
                if index is None and held:
                    own, base = (np.concatenate(x) for x in zip(*held))
                    index, held = Index(codes.encode(base)), []
                if index is None:
                    continue
                found = []
                for query_id, query, code, radius, bound in zip(part_ids, part_vectors, codes.encode(part_vectors), part.column("radius").to_numpy(), part.column("bound").to_numpy()):
                    at = index.within(code, radius)
                    at = at[own[at] != query_id]
                    d = distances(base[at], query)
                    near = np.flatnonzero(d <= bound)
                    best = near[np.lexsort((own[at[near]], d[near]))[:k]]
                    found.append((np.full(len(best), query_id), own[at[best]], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "vec_id", "score"])

    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    kind = dict(rows.dtypes)["vec"]
    asked = scratch.save(asked.mapInArrow(bounded, f"id long, vec {kind}, radius int, bound double, near array<struct<vec_id: long, score: double>>"))
    spread = F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    base = rows.select(spread.alias("shard"), "id", "vec", F.lit(None).cast("int").alias("radius"), F.lit(None).cast("double").alias("bound"))
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "vec", "radius", "bound")
    dealt = base.unionByName(visits).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("radius").isNotNull())
    found = dealt.mapInArrow(visited, "query_id long, vec_id long, score double")
    # What the sample knows is found too, whatever the radius; rows of both count once, repeated rows each.
    both = found.withColumn("own", F.lit(1)).unionByName(asked.select(F.col("id").alias("query_id"), F.inline("near")).withColumn("own", F.lit(0)))
    both = both.groupBy("query_id", "vec_id", "score").agg(F.sum("own").alias("a"), F.sum(1 - F.col("own")).alias("b"))
    found = both.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.greatest("a", "b"))).alias("copy"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
