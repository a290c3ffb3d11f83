"""The trie of conversation prefixes: every distinct beginning of a conversation is a node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Conversation ids that are joined to one string before they are hashed in order.
BLOCK = 4096


def rebuilt(conversations: DataFrame, scratch: Scratch, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, depth, role, text, turns): conversations that begin with turns of their group's first; depth 0 is the textless root.

    Turns are ordered by turn, role and text, nulls first. h is crc32 of the id modulo ``most``; the first h turns
    of a conversation are replaced by the first h of the one whose id is the multiple of ``group`` below.
    """
    said = conversations.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = scratch.save(said.withColumn("at", F.row_number().over(order)))
    ids = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    ids = ids.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    first = said.where(F.col("at") < most).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "role", "text")
    head = ids.join(first, "base").where("depth <= h").select("conv_id", "depth", "role", "text")
    heads = head.groupBy("conv_id").agg(F.max("depth").alias("given"))
    shape = scratch.save(ids.join(heads, "conv_id", "left").select("conv_id", "h", F.coalesce("given", F.lit(0)).alias("given"), "own"))
    tail = said.join(shape, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("depth"), "role", "text")
    root = shape.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = shape.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    return root.unionByName(head).unionByName(tail).join(turns, "conv_id")


def occurrences(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, turns, key, above, tokens, upto): each conversation's nodes from the root down.

    key names a node: exclusive or of digests of the turns so far, each digest with its place, 120 bits;
    above is its parent's. tokens: words of the last text; upto: words of all texts so far.
    """
    digest = F.sha2(F.concat_ws(":", F.col("depth"), F.length("role"), F.col("role"), F.col("text")), 256)
    part = lambda k: F.when(F.col("depth") > 0, F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long")).otherwise(0)
    down = W.partitionBy("conv_id").orderBy("depth")
    rows = turns.select("conv_id", "depth", "turns", part(0).alias("x"), part(1).alias("y"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    sofar = down.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "depth", "turns", "tokens", F.struct(*(F.bit_xor(c).over(sofar).alias(c) for c in "xy"), "depth").alias("key"), F.sum("tokens").over(sofar).alias("upto"))
    return rows.withColumn("above", F.lag("key").over(down))


def owned(rows: DataFrame) -> DataFrame:
    """(conv_id, since, leaf): of each conversation that owns nodes, the depth of the first, and whether its last one has no children.

    The smallest member owns a node. If a conversation is the smallest at some depth, it is so further
    down its path too, where there are fewer members: what it owns is a suffix of its path.
    """
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("turns").alias("deepest"))
    return nodes.groupBy("conv_id").agg(F.min("key.depth").alias("since"), F.bool_or(F.col("deepest") == F.col("key.depth")).alias("leaf"))


def digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's conv_ids in ascending order, joined by commas.

    Ids are joined by blocks of numbers first, in parallel; then each key's blocks run through
    the hash in order, a batch at a time, so that no key's ids are ever gathered.
    """
    low = F.floor(F.col("conv_id") / BLOCK)
    blocks = ends.groupBy("key", low.alias("low")).agg(F.concat_ws(",", F.sort_array(F.collect_list("conv_id"))).alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for batch in batches:
            out = []
            for x, y, depth, ids in zip(batch["x"], batch["y"], batch["depth"], batch["ids"]):
                if (x, y, depth) == key:
                    sha.update(b",")
                else:
                    out += [(*key, sha.hexdigest())] if key else []
                    key, sha = (x, y, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["x", "y", "depth", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["x", "y", "depth", "ends_sha256"])

    flat = blocks.select("key.x", "key.y", "key.depth", "low", "ids").repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "low")
    return flat.mapInPandas(hashed, "x long, y long, depth long, ends_sha256 string").select(F.struct("x", "y", "depth").alias("key"), "ends_sha256")


def nodes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node.

    turns: as rebuilt() gives them. A node's subtree sums are one aggregate over its members: tokens of a member's
    path from the node down, without those of nodes that it owns, are what caching prefixes saves, since each
    node's tokens count once for each member but its owner. Likewise a leaf counts for its owner
    only, and a child for the member that owns it. All aggregates are partial before their shuffle, so the
    root and common first turns, members of which are all or many conversations, are a row for each task.

    Rows without conv_id belong to no conversation. Null role or text is empty; equal turns are ordered
    by role and text, repeated rows are turns of their own. A conversation without turns is a member of the root only.
    Ids need not be dense. Texts of any length are whole; an empty table gives no rows; other columns are not looked at.
    """
    rows = scratch.save(occurrences(turns.withColumn("depth", F.col("depth").cast("long"))))
    own = rows.join(scratch.save(owned(rows)), "conv_id", "left")
    mine = W.partitionBy("conv_id")
    since = F.coalesce("since", F.col("turns") + 1)
    # Words of the nodes that it doesn't own: those above the first it owns.
    others = F.coalesce(F.max(F.when(F.col("depth") < since, F.col("upto"))).over(mine), F.lit(0))
    own = own.select(
        "conv_id", "key", "above", "depth", "turns",
        F.greatest(others - F.col("upto") + F.col("tokens"), F.lit(0)).alias("saved"),
        ((F.col("depth") < F.col("turns")) & (F.col("depth") + 1 >= since)).cast("long").alias("child"),
        (F.coalesce("leaf", F.lit(False))).cast("long").alias("leaf"),
    )
    total: dict[str, Column] = {
        "conv_id": F.min("conv_id"), "above": F.max("above"), "n_convs": F.count(F.lit(1)), "n_children": F.sum("child"), "n_leaves": F.sum("leaf"), "saved_tokens": F.sum("saved"),
    }
    found = scratch.save(own.groupBy("key").agg(*(c.alias(n) for n, c in total.items())))
    ends = digests(rows.where("depth = turns").select("key", "conv_id"))
    parents = found.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = found.join(ends, "key", "left").join(parents, "above", "left")
    return out.select(
        "conv_id", F.col("key.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 of the digits of an id, a byte and a bit at a time.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: list_reduce(list_concat([xor(r, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"

SQL = f"""
    WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS place,
      COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    i AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
    r AS (SELECT i.conv_id, 0 AS part, o.place, role, text FROM i JOIN o ON o.conv_id = i.base AND o.place <= h
      UNION ALL SELECT i.conv_id, 1, o.place, role, text FROM i JOIN o ON o.conv_id = i.conv_id AND o.place > h),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, struct_pack(r := role, t := text) AS said,
      len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
    p AS (SELECT conv_id, depth, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM t
      UNION ALL SELECT conv_id, 0, [], 0 FROM i),
    k AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended, dense_rank() OVER (ORDER BY path) AS node FROM p),
    n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ended) AS leaf, min(words) AS words,
      sha256(COALESCE(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM k GROUP BY node, depth),
    below AS (SELECT DISTINCT x.node AS top, y.node FROM k x JOIN k y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
    sums AS (SELECT top, count(*) FILTER (leaf) AS n_leaves, SUM((n_convs - 1) * words) AS saved FROM below JOIN n USING (node) GROUP BY top),
    step AS (SELECT DISTINCT x.node AS parent, y.node AS child FROM k x JOIN k y ON x.conv_id = y.conv_id AND y.depth = x.depth + 1)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, (SELECT m.conv_id FROM step s JOIN n m ON m.node = s.parent WHERE s.child = n.node) AS parent_conv_id, n.n_convs,
      (SELECT count(*) FROM step s WHERE s.parent = n.node) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
    FROM n JOIN sums ON sums.top = n.node
"""
