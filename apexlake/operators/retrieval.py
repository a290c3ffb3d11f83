"""Retrieval from a knowledge base by cosine similarity: any number of queries over any number of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.operators import ordered

#: Vectors that a task holds at most, but for chance, while queries pass by.
HELD = 65536


def _sound(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of rows whose vector has a length: not null, not zero, of finite components."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & good)


def retrieved(vectors: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding", carry: Sequence[str] = ()) -> DataFrame:
    """(query, rank, key, similarity, carry): the k most similar vectors of each query, by cosine to 6 decimals; ties by key.

    Blocked: vectors are dealt to parts of 65,536 at most, each query visits every part and takes k from it, and
    these are merged. A task holds one part and a batch of queries. Vectors that are null, zero, not finite or of
    another length than the query's are never found, such queries find nothing. Repeated rows are found as often;
    of a repeated query_id the smallest vector asks. carry: further columns of the vectors' table, by
    key, for the few rows found.
    """
    spark = vectors.sparkSession
    base = _sound(vectors, key, vector)
    asked = _sound(queries, query_key, query_vector).groupBy("id").agg(F.min("vec").alias("vec"))
    parts = max(-(-base.count() // HELD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    base = base.select(part.alias("part"), F.lit(False).alias("asks"), F.size("vec").alias("dims"), "id", "vec")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), F.size("vec").alias("dims"), "id", "vec")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("vec").flatten().to_numpy().reshape(len(batch), -1)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ids, units = None, [], None, None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "dims", "asks")], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                rows, (p, dims, asks) = batch.slice(a, b - a), group[a]
                if (p, dims) != here:
                    here, held, ids = (p, dims), [], None
                if not asks:
                    held.append((rows.column("id").to_numpy(), matrix(rows)))
                    continue
                if ids is None and held:
                    ids, units = (np.concatenate(x) for x in zip(*held))
                if ids is None:
                    continue
                for query, unit in zip(rows.column("id").to_numpy(), matrix(rows)):
                    likeness = np.round(units @ unit, 6)
                    least = np.partition(likeness, -k)[-k] if len(ids) > k else -2.0
                    near = np.flatnonzero(likeness >= least)
                    near = near[np.lexsort((ids[near], -likeness[near]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), query)), pa.array(ids[near]), pa.array(likeness[near] + 0.0)], ["query", "found", "similarity"])

    dealt = base.unionByName(visits).repartitionById(parts, "part").sortWithinPartitions("part", "dims", "asks")
    found = dealt.mapInArrow(best, "query long, found long, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "found"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query_key), "rank", F.col("found").alias(key), "similarity")
    if not carry:
        return found
    return ordered.looked_up(found, vectors.select(key, *carry).dropDuplicates([key]), [key])


def retried(vectors: DataFrame, queries: DataFrame, again: DataFrame, k: int = 5, least: float = 0.3, query_key: str = "query_id", **options) -> DataFrame:
    """retrieved() + attempt: queries that find nothing, or whose best is less similar than ``least``, ask once more with the vector they have in ``again``.

    What the second attempt finds stands for the first's, also if it is nothing. A query that is not in
    ``again`` finds nothing then.
    """
    first = ordered.kept(retrieved(vectors, queries, k, query_key=query_key, **options))
    good = first.where((F.col("rank") == 1) & (F.col("similarity") >= least)).select(query_key)
    second = again.join(queries.select(query_key).distinct(), query_key, "left_semi").join(good, query_key, "left_anti")
    found = retrieved(vectors, second, k, query_key=query_key, **options)
    return first.join(good, query_key, "left_semi").withColumn("attempt", F.lit(1)).unionByName(found.withColumn("attempt", F.lit(2)))
