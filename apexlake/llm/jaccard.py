"""N-gram Jaccard join by signature trees: token bitmaps and size ranges prune pairs of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PACKED, Scratch, Words, among, components, join_up, mix, signed, slices, strings

#: Words of 64 bits in a signature (trees fold them to half as many, for shorter conditions), log2 of the counters of frequent shingles, least shingles kept of a set.
SIGNATURE, COUNTERS, WALKS = 16, 20, 6
#: Bits of a shingle's hash.
WIDE = 48
#: Linked sets share one prefix shingle, and one more for each so many shingles of the smaller set.
SHARED = 24
_BITS = [f"b{i}" for i in range(SIGNATURE)]
_FOLDED = _BITS[: SIGNATURE // 2]
_SALTS = mix(np.arange(1, WALKS + 1, dtype=np.uint64))
PROFILE = "doc_id long, body long, cls long, n long, " + ", ".join(f"{b} long" for b in _BITS) + ", least array<long>, shingles array<long>, part int, counts binary"


def _rows_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, signature, least shingles by walk) of each set; equal sets are one class."""
    size = np.array([len(s) for s in sets], np.int64)
    cls, sign, least = np.zeros(len(sets), np.int64), np.zeros((len(sets), SIGNATURE), np.int64), np.zeros((len(sets), WALKS), np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return cls, size, sign, least
    flat, first = np.concatenate(sets), (np.cumsum(size) - size)[some]
    total = lambda x: np.add.reduceat(x, first)
    cls[some] = signed(mix(total(mix(flat)) + mix(total(mix(flat + np.uint64(1))) + size[some].astype(np.uint64))))
    for k, salt in enumerate(_SALTS):
        least[some, k] = signed(np.minimum.reduceat(mix(flat ^ salt), first))
    bits = np.zeros((len(sets), SIGNATURE * 64), bool)
    bits[np.repeat(np.arange(len(sets)), size), (flat >> np.uint64(20)) % np.uint64(SIGNATURE * 64)] = True
    return cls, size, np.packbits(bits, axis=1, bitorder="little").view(np.int64), least


def _lists(values: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=None if null is None else pa.array(null))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size, signature, least shingles of each document, and its set, once for each class where it is met
    again soon; then the task's counts of shingles by leading bits."""
    names, counts, known = [x.split()[0] for x in PROFILE.split(", ")], np.zeros(1 << COUNTERS, np.int64), set()
    for batch in batches:
        texts = strings(batch.column(2))
        for low, high in slices(texts):
            sets = [s >> np.uint64(64 - WIDE) for s in Words(texts.slice(low, high - low)).shingles()]
            cls, size, sign, least = _rows_of(sets)
            again = np.zeros(len(sets), bool)
            for i, key in enumerate(cls.tolist()):
                again[i] = key in known or not size[i]
                known.add(key)
            if len(known) > 100_000:
                known.clear()
            own = np.concatenate([s for s, seen in zip(sets, again) if not seen] or [np.zeros(0, np.uint64)])
            np.add.at(counts, own >> np.uint64(WIDE - COUNTERS), 1)
            none = high - low
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[low:high], batch.column(1)[low:high], pa.array(cls), pa.array(size), *(pa.array(np.ascontiguousarray(sign[:, k])) for k in range(SIGNATURE)),
                 _lists(least.ravel(), np.full(none, WALKS)), _lists(signed(own), np.where(again, 0, size), again), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
                names=names,
            )
    step = 1 << 14
    parts = [counts[k : k + step].astype("<i8").tobytes() for k in range(0, len(counts), step)]
    kinds = [pa.int64()] * (4 + SIGNATURE) + [pa.list_(pa.int64())] * 2
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), t) for t in kinds), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=names)


def _summed(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, block by block; rare ones are set to 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(block.as_buffer(), "<i8")
                whole[part] = whole[part] + own if part in whole else own.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros(1 << COUNTERS, np.int64)
    for r in rows.where("part is not null").select("part", "counts").repartition("part").mapInArrow(run, "part int, counts binary").collect():
        own = np.frombuffer(bytes(r.counts), "<i8")
        out[r.part * len(own) : (r.part + 1) * len(own)] = own
    out[out <= 1.5 * out.mean() + 128] = 0
    return out


def _prefix(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which any set that is similar enough shares 1 + n // SHARED: rare before frequent, by hash."""
    length = min(len(s), len(s) - -(-len(s) * percent // 100) + 1 + len(s) // SHARED)
    weight = often[s >> np.uint64(WIDE - COUNTERS)]
    rare = s[weight == 0]
    if len(rare) >= length:
        return rare[:length]
    rest = s[weight > 0]
    return np.concatenate((rare, rest[np.lexsort((rest, weight[weight > 0]))]))[:length]


def _entries(sets: DataFrame, often: np.ndarray, percent: int, scratch: Scratch) -> DataFrame:
    """(token, cls, n, spot): the prefix shingles of each class, its size, and how many of its set come before."""
    shared = scratch.spark.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().view(np.uint64)
            own = [_prefix(flat[a:b], shared.value, percent) for a, b in zip(ends[:-1], ends[1:])]
            size = np.array([len(x) for x in own], np.int64)
            spots = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([*own, np.zeros(0, np.uint64)]))), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(np.diff(ends), size)), pa.array(spots.astype(np.int32))],
                names=["token", "cls", "n", "spot"],
            )

    return scratch.save(sets.select("cls", "shingles").mapInArrow(run, "token long, cls long, n int, spot int"))


def possible(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sizes and bitmaps allow a link, so that few sets must travel."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    signs = among(sets.select("cls", "n", *_BITS), wanted, "cls").groupBy("cls").agg(*(F.any_value(c).alias(c) for c in ("n", *_BITS)))
    signs = scratch.save(signs)
    side = lambda s: signs.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", *_BITS)))
    count = lambda x: sum((x(c) for c in _BITS[1:]), x(_BITS[0]))
    shared = count(lambda c: F.bit_count(F.col(f"{c}_a").bitwiseAND(F.col(f"{c}_b"))))
    over = F.least(*(F.col(f"n_{s}") - count(lambda c: F.bit_count(f"{c}_{s}")) for s in "ab"))
    may = (100 + percent) * F.least(shared + over, "n_a", "n_b") >= percent * (F.col("n_a") + F.col("n_b"))
    out = scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b"))
    scratch.drop(signs)
    return out


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sets are similar enough."""
    pairs = possible(pairs, sets, scratch, percent)
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    own = scratch.save(among(sets.select("cls", "shingles"), wanted, "cls").groupBy("cls").agg(F.first("shingles").alias("s")).join(wanted, "cls", "left_semi"), **PACKED)
    both = pairs.join(own.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    out = scratch.save(both.where((100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))) & (F.col("common") > 0)).select("a", "b"))
    scratch.drop(pairs, wanted, own)
    return out


def _bound(x: str, y: str, percent: int) -> F.Column:
    """Whether two nodes may hold a linked pair: by sizes, by components, and by the largest possible overlap.

    Sets share at most the bits that both nodes have, and one more for each shingle that fell on a bit
    another one of its set had set already. Nor can they share more than the smaller number of
    shingles before and after the token that both stand below.
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    shared = sum((F.bit_count(c(x, b).bitwiseAND(c(y, b))) for b in _FOLDED[1:]), F.bit_count(c(x, "b0").bitwiseAND(c(y, "b0"))))
    overlap = F.least(shared + F.least(c(x, "over"), c(y, "over")), F.least(c(x, "before"), c(y, "before")) + 1 + F.least(c(x, "after"), c(y, "after")))
    sizes = (100 * c(x, "high") >= percent * c(y, "low")) & (100 * c(y, "high") >= percent * c(x, "low"))
    one = (c(x, "first") == c(x, "last")) & (c(y, "first") == c(y, "last")) & (c(x, "first") == c(y, "first"))
    return sizes & ~one & ((100 + percent) * overlap >= percent * (c(x, "low") + c(y, "low")))


def candidates(entries: DataFrame, percent: int, scratch: Scratch, leaf: int = 16, fan: int = 32, tree: int = 4096) -> DataFrame:
    """Pairs of classes below a token that dual traversal can't rule out, for each token: (a, b, n) with the smaller size.

    entries: (token, k, cls, spot, comp, n, signature); k is the number of classes below the token, spot
    the number of shingles of the set that come before it. The classes below a token are a tree, or
    several if there are more than ``tree``, so that no task numbers them all: ordered by size, ``leaf`` of
    them make a leaf, ``fan`` leaves a node above. Pairs of nodes below one token are followed from the
    top; pairs that _bound() rules out are not opened.
    """
    own = F.pmod(F.xxhash64("cls"), F.ceil(F.col("k") / tree))
    rows = entries.withColumn("tree", own).withColumn("place", F.row_number().over(W.partitionBy("token", "tree").orderBy("n", "cls")) - 1)
    at = lambda size: F.shiftleft("tree", 40) + F.floor(F.col("place") / size)
    rows = rows.select(
        "token", "cls", F.col("n").alias("low"), F.col("n").alias("high"), F.col("comp").alias("first"), F.col("comp").alias("last"), *_FOLDED,
        (F.col("n") - sum((F.bit_count(b) for b in _FOLDED[1:]), F.bit_count("b0"))).alias("over"),
        F.col("spot").cast("long").alias("before"), (F.col("n") - F.col("spot") - 1).alias("after"), at(leaf).alias("leaf"), at(leaf * fan).alias("node"),
    )
    rows = scratch.save(rows)
    merge = lambda df, *by: df.groupBy("token", *by).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), *(F.bit_or(b).alias(b) for b in _FOLDED),
        *(F.max(c).alias(c) for c in ("over", "before", "after")),
    )
    leaves = scratch.save(merge(rows, "leaf", "node"))
    nodes = merge(leaves, "node")
    side = lambda df, s, keep: df.select(*(F.col(c) if c == "token" else F.col(c).alias(f"{s}_{c}") for c in df.columns))

    def opened(pairs: DataFrame | None, below: DataFrame, by: str | None, order: str) -> DataFrame:
        x, y = side(below, "x", by), side(below, "y", by)
        if pairs is None:
            both = x.join(y, "token")
        else:
            both = pairs.join(x, ["token", f"x_{by}"]).join(y, ["token", f"y_{by}"])
        return both.where((F.col(f"x_{order}") <= F.col(f"y_{order}")) & _bound("x", "y", percent))

    top = opened(None, nodes, None, "node").select("token", "x_node", "y_node")
    middle = scratch.save(opened(top, leaves, "node", "leaf").select("token", "x_leaf", "y_leaf"))
    found = middle.join(side(rows.drop("node"), "x", None), ["token", "x_leaf"]).join(side(rows.drop("node"), "y", None), ["token", "y_leaf"])
    found = found.where((F.col("x_cls") < F.col("y_cls")) | ((F.col("x_leaf") < F.col("y_leaf")) & (F.col("x_cls") != F.col("y_cls")))).where(_bound("x", "y", percent))
    return found.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"), F.least("x_low", "y_low").alias("n"))


def _in_leaf(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, n) of the pairs below tokens that have so few classes that they are one leaf."""
    one = F.struct("cls", "n", "spot", "comp")
    leaf = entries.groupBy("token").agg(F.array_sort(F.collect_list(one)).alias("m"))
    rows = leaf.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    c = lambda side, name: F.col(f"{side}.{name}")
    overlap = F.least(c("x", "spot"), c("y", "spot")) + F.least(c("x", "n") - c("x", "spot"), c("y", "n") - c("y", "spot"))
    may = ((100 + percent) * F.least(overlap, c("x", "n"), c("y", "n")) >= percent * (c("x", "n") + c("y", "n"))) & (c("x", "comp") != c("y", "comp"))
    return rows.where(may).select(c("x", "cls").alias("a"), c("y", "cls").alias("b"), F.least(c("x", "n"), c("y", "n")).alias("n"))


def _grouped(docs: DataFrame, scratch: Scratch, percent: int, leaf: int = 32) -> DataFrame:
    """(doc_id, body, n, comp): the size of each row's set, and its component, null without shingles."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), text.alias("text"))
    profile = scratch.save(rows.mapInArrow(_profile, PROFILE), **PACKED)
    often = _summed(profile)
    sets = profile.where("shingles is not null")

    # Near copies are one component before trees are built; what shares one least shingle only is left to them.
    # Leaves are equal least shingles of one walk, and of three: those part large groups into more alike ones.
    keys = [F.xxhash64(F.lit(i), *(F.col("least")[k] for k in walks)) for i, walks in enumerate([*((k,) for k in range(WALKS)), (0, 1, 2), (3, 4, 5), (0, 2, 4), (1, 3, 5)])]
    leaves = sets.select(F.explode(F.array(*keys)).alias("leaf"), F.col("cls").alias("member"))
    _, links, comps = join_up(leaves, lambda pairs: verified(pairs, sets, scratch, percent), scratch, 2)

    entries = _entries(sets, often, percent, scratch)
    live = scratch.save(entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"))
    # Dealt by token once: what lies together so is counted, and classes met by several tasks made one, in place.
    some = among(entries, live, "token").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    some = some.select("token", "cls", "n", "spot", F.coalesce("root", "cls").alias("comp")).repartition("token")
    some = some.groupBy("token", "cls").agg(*(F.any_value(c).alias(c) for c in ("n", "spot", "comp")))
    together = W.partitionBy("token")
    below = some.select("*", F.min("comp").over(together).alias("low"), F.max("comp").over(together).alias("high"), F.count("*").over(together).alias("k"))
    below = scratch.save(below.where("low < high").drop("low", "high"))
    scratch.drop(entries, live)
    large = scratch.save(below.where(F.col("k") > leaf))
    folded = [F.col(one).bitwiseOR(F.col(two)).alias(one) for one, two in zip(_FOLDED, _BITS[len(_FOLDED) :])]
    classes = among(sets.select("cls", *folded), large, "cls").groupBy("cls").agg(*(F.any_value(c).alias(c) for c in _FOLDED))
    found = _in_leaf(below.where(F.col("k") <= leaf), percent).unionByName(candidates(large.join(scratch.save(classes), "cls"), percent, scratch, leaf))
    found = scratch.save(found.groupBy("a", "b").agg(F.count("*").alias("times"), F.min("n").alias("n")).where(F.col("times") > F.floor(F.col("n") / SHARED)))
    # Each class meets first the one it shares most tokens with; what that makes one component is not compared again.
    both = found.select("a", "b", "times").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "times"))
    best = both.groupBy("a").agg(F.max(F.struct("times", "b")).alias("p")).select(F.least("a", "p.b").alias("a"), F.greatest("a", "p.b").alias("b")).distinct()
    links = scratch.save(links.unionByName(verified(scratch.save(best), sets, scratch, percent)))
    comps = scratch.save(components(links, scratch))
    root = lambda end: comps.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rest = found.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = verified(scratch.save(rest.select("a", "b")), sets, scratch, percent)

    comps = scratch.save(components(links.unionByName(more), scratch))
    owned = profile.where("part is null").select("doc_id", "body", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(comps, F.col("cls") == F.col("node"), "left")
    return scratch.last(owned.select("doc_id", "body", "n", F.coalesce("root", "cls").alias("comp")))


def join(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """Similarity join of whole texts: (doc_id, n_shingles, component_id).

    A document's set is that of its distinct shingles of five words (A-Z lower-cased); two documents link
    when 100 * intersection >= percent * union. component_id is the smallest doc_id that links lead to.

    Equal sets are one class. Similar sets share a shingle of their prefix, so a signature tree stands below
    each prefix shingle of two classes or more, and pairs of its nodes are ruled out by bitmaps, sizes,
    places and components; pairs that meet below as many tokens as linked sets of their sizes share are
    compared exactly. So that groups of near copies are one
    component, which trees skip, before they are built, each class meets the hub of its group first.
    Frequent shingles come last in prefixes, by counters of fixed size over all texts.

    Fewer than five words: the whole sequence is the one shingle. Null, empty or blank text: no shingles,
    linked with nothing, component_id is doc_id. Repeated rows are in one class. Rows of one doc_id with
    different texts are judged each. Null doc_id: never the smallest, unless alone. Empty table: no rows.
    Other columns are ignored.
    """
    owned = _grouped(docs, scratch, percent)
    least = owned.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").select("comp", "component_id")
    out = owned.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """One row of each group, that with the smallest doc_id (then text hash; a null doc_id comes last).

    Rows without shingles stay. Of rows equal in doc_id and text one stays, whichever in other columns; of
    rows of one doc_id each text is judged for itself. Empty table: no rows. Other columns may have any names.
    """
    owned = _grouped(docs, scratch, percent).where("comp is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    keys = owned.groupBy("comp", place.alias("place")).agg(F.count("*").alias("times"))
    firsts = keys.groupBy("comp").agg(F.min("place").alias("first"))
    keys = keys.join(firsts, "comp").where("place <> first or times > 1")
    keys = scratch.last(keys.select("place.doc_id", "place.body", (F.col("place") == F.col("first")).alias("first")))
    mine = lambda c: F.col(f"_docs.`{c}`")  # noqa: E731  by side, as docs may have any names
    same = mine("doc_id").cast("long").eqNullSafe(F.col("_keys.doc_id")) & (F.xxhash64(F.coalesce(mine("text").cast("string"), F.lit(""))) == F.col("_keys.body"))
    out = docs.alias("_docs").join(keys.alias("_keys"), same, "left_anti")
    repeated = keys.where("first")
    if repeated.isEmpty():
        return out
    return out.unionByName(docs.alias("_docs").join(repeated.alias("_keys"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
