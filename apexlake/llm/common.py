"""What the training-data operators share: scratch tables in the cluster's shared folder, distributed
union-find, and vectorised hashing of words and word shingles in Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: For tables of sorted lists of numbers: Parquet packs the differences.
PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


class Scratch:
    """Intermediate tables, written as Parquet to the folder in ``spark.checkpoint.dir``.

    A written table cuts the lineage, survives lost executors and carries size statistics, so that
    later joins broadcast it only if it is small. Where the setting is absent, a session on one machine
    takes a folder of its own; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        self.spark, self.top, self.live = spark, f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}", []
        self.paths = 0

    def path(self) -> str:
        self.paths += 1
        return f"{self.top}/{self.paths}"

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        path = self.path()
        with small_batches(self.spark):
            df.write.options(**{"compression": "zstd"} | options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in tables:
            self._delete(df.scratch_path)

    def last(self, df: DataFrame) -> DataFrame:
        """Save df and delete all other tables."""
        out = self.save(df)
        for path in self.live[:-1]:
            self._delete(path)
        return out

    def _delete(self, path: str) -> None:
        if path in self.live:
            self.live.remove(path)
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches by bytes while a job runs, as rows are whole documents; the caller's settings come back."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Distributed union-find by alternating large and small stars.

    edges: (a, b) longs; loops and repeats are allowed. Returns (node, root) for every node with an
    edge to another node; root is the smallest node of the component, and root itself is listed.
    Each round is a few keyed aggregates and joins over at most the given number of edges.
    """
    now = scratch.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = scratch.save(small)
        scratch.drop(now)
        now = after
        # Done once all are stars: each node below has one edge, and none is above another.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v"), F.lit(0), F.lit(1)).toDF("node", "below", "above"))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 0 and below + above > 1").isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text: what tells rows apart where doc_ids repeat or are null."""
    return F.xxhash64(F.coalesce(docs.doc_id.cast("string"), F.lit("none")), F.coalesce(docs.text.cast("string"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with row_key() in the place of doc_id, to judge each row by itself."""
    return docs.select(row_key(docs).alias("doc_id"), docs.text.cast("string").alias("text"))


def among(rows: DataFrame, keys: DataFrame, key: str, column: str | None = None, bits: int = 24) -> DataFrame:
    """The rows whose column is among the keys, and few others, without a shuffle of rows.

    A bitmap of 2**bits bits over hashes is broadcast, as words of 64: at most 2**18 rows by default, whatever the
    number of keys; the more keys there are, the more others pass.
    """
    word = lambda c: F.shiftrightunsigned(F.xxhash64(c), 70 - bits)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({c}), {64 - bits}) & 63 as int))")
    words = keys.groupBy(word(key).alias("_word")).agg(F.bit_or(bit(key)).alias("_bits"))
    column = column or key
    return rows.join(F.broadcast(words), word(column) == F.col("_word")).where(F.col("_bits").bitwiseAND(bit(column)) != 0).drop("_word", "_bits")


def join_up(leaves: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, least_times: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to begin with between those that share leaves: (leaves of two members or more, links, components).

    leaves: (leaf, member), repeats allowed. The hub of a leaf is the member whose leaves are largest, so
    among near copies the one that the others are edited from. Each member meets first the hub it shares
    most leaves with, then one of each other component that a hub or neighbour of its belongs to. Those shared in
    fewer than ``least_times`` leaves are passed over. verify: (a, b) to those of them that are links.
    """
    often = scratch.save(leaves.groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1").select("leaf"))
    leaves = scratch.save(among(leaves, often, "leaf").distinct())
    shared = leaves.groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1")
    leaves = scratch.save(leaves.join(shared, "leaf"))
    weighed = leaves.join(leaves.groupBy("member").agg(F.sum("k").alias("weight")), "member")
    hubs = scratch.save(weighed.groupBy("leaf").agg(F.max(F.struct("weight", "member")).alias("hub")))
    met = leaves.join(hubs, "leaf").where("member <> hub.member").groupBy("member", "hub").agg(F.count("*").alias("times")).where(F.col("times") >= least_times)
    met = scratch.save(met.select("member", F.col("hub.member").alias("hub"), F.struct("times", F.col("hub.weight").alias("weight"), F.col("hub.member").alias("hub")).alias("rank")))
    pair = lambda df: df.select(F.least("member", "hub").alias("a"), F.greatest("member", "hub").alias("b")).distinct()
    first = met.groupBy("member").agg(F.max("rank").alias("rank")).select("member", F.col("rank.hub").alias("hub"))
    links = verify(scratch.save(pair(first)))
    comps = scratch.save(components(links, scratch))
    root = lambda end: comps.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    # Hubs that are like few of their leaf leave a group in pieces: neighbours in a leaf meet as well.
    order = W.partitionBy("leaf", F.pmod(F.xxhash64("member"), F.ceil(F.col("k") / 4096))).orderBy("member")
    beside = leaves.select("member", F.lag("member").over(order).alias("hub")).where("hub is not null").groupBy("member", "hub").agg(F.count("*").alias("times")).where(F.col("times") >= least_times)
    met = met.select("member", "hub", "rank.times").unionByName(beside)
    apart = met.join(root("member"), "member", "left").join(root("hub"), "hub", "left")
    apart = apart.select("member", "hub", "times", F.coalesce("root_member", "member").alias("x"), F.coalesce("root_hub", "hub").alias("y")).where("x <> y")
    apart = apart.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max(F.struct("times", "member", "hub")).alias("p")).select("p.member", "p.hub")
    links = scratch.save(links.unionByName(verify(scratch.save(pair(apart)))))
    scratch.drop(often, hubs)
    return leaves, links, scratch.save(components(links, scratch))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SHINGLE = _rng.integers(1, 2**64, 5, dtype=np.uint64) | np.uint64(1)
#: White space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and all other ASCII that is neither letter nor digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}
#: Bytes of text that are hashed at once.
SLICE_BYTES = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most so many bytes each, one row at least."""
    ends, start = offsets(column), 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, end
        start = end


def span_sums(data: np.ndarray) -> np.ndarray:
    """Sums by which the hash of any run of these bytes is known at once."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data))[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + _ODD)


def strings(column: pa.Array) -> pa.Array:
    """The column as plain strings; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.string()).fill_null("")


def offsets(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts: row, 64-bit hash (A-Z lower-cased), byte span."""

    def __init__(self, column: pa.Array, space: np.ndarray = SPACE):
        ends = offsets(column)
        low, high = int(ends[0]), int(ends[-1])
        raw = column.buffers()[2] if len(column) else None
        self.data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        self.edges = ends - low
        n = high - low
        black = ~space[self.data]
        first = np.zeros(n + 1, bool)
        first[self.edges] = True
        self.start = np.flatnonzero(black & (first[:-1] | np.concatenate(([True], ~black[:-1]))[:n]))
        self.end = np.flatnonzero(black & (first[1:] | np.concatenate((~black[1:], [True]))[:n])) + 1
        self.sums = span_sums(self.data)
        self.hash = span_hash(self.sums, self.start, self.end)
        self.first = np.searchsorted(self.start, self.edges)  # of each row, and the end
        self.row = np.repeat(np.arange(len(column)), np.diff(self.first))

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of the first so many bytes of each word."""
        return span_hash(self.sums, self.start, np.minimum(self.end, self.start + size))

    def shingles(self) -> list[np.ndarray]:
        """Of each row: the sorted distinct hashes of its five-word shingles; with fewer words, of all in one."""
        h, n = self.hash, len(self.hash)
        joined = np.zeros(n, np.uint64)
        for k, c in enumerate(_SHINGLE):
            joined[: max(n - k, 0)] += h[k:] * c
        joined = mix(joined)
        out = []
        for low, high in zip(self.first[:-1], self.first[1:]):
            if high - low >= 5:
                out.append(np.unique(joined[low : high - 4]))
            elif high > low:
                short = (h[low:high] * _SHINGLE[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit words as Spark's longs."""
    return np.ascontiguousarray(x).view(np.int64)
