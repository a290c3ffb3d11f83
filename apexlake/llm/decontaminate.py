"""Benchmark decontamination: CGK walks, bit-sampling LSH over windows up to an item's size, exact edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, keyed, mix, row_key, slices, strings

#: Words of a run that an item and its match have in common.
RUN = 3

PAIRS = "doc_id long, item_id long, start long, end long, edits int, item_words int"


def edits_of(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Least edit distance between item and a beginning of text, and that beginning's length, if at most ``most``.

    Bit-parallel: a column of the distance table in two integers.
    """
    n = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(item):
        where[x] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now = full, 0, n
    best = (now, 0)
    for j, x in enumerate(text[: n + most], 1):
        hit = where.get(x, 0)
        diagonal = (((hit & up) + up) ^ up) | hit | down
        right, left = down | ~(diagonal | up), up & diagonal
        now += bool(right & top) - bool(left & top)
        right, left = (right << 1) | 1, left << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
        best = min(best, (now, -j))
    return (best[0], -best[1]) if best[0] <= most else None


def _runs(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words."""
    out = np.zeros(max(0, len(h) - RUN + 1), np.uint64)
    for k in range(RUN):
        out = mix(out + h[k : k + len(out)])
    return out


class Items:
    """The benchmark's items as word hashes, with the tables that windows of documents are looked up in."""

    def __init__(self, ids: list[int], texts: list[str], error: float, least_words: int, walks: int, samples: int, bits: int, seed: int = 11):
        words = Words(strings(pa.array(texts, pa.string())))
        spans = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.items = [(i, s) for i, s in zip(ids, spans) if len(s)]
        self.most = [int(error * len(s)) if len(s) >= least_words else 0 for _, s in self.items]
        self.lists = [s.tolist() for _, s in self.items]
        self.sets = [set(s) for s in self.lists]
        self.known = np.unique(np.concatenate([s for _, s in self.items])) if self.items else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << 16, bool)
        self.table[self.known >> np.uint64(48)] = True
        self.longest = max((len(s) for _, s in self.items), default=0)
        # Windows of each class of lengths: so many words, of which so many may be in no item.
        classes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (_, s), k in zip(self.items, self.most):
            classes[int(np.log(len(s)) / np.log(1.15))].append((len(s) - k, k))
        self.windows = [(min(a for a, _ in c), max(k for _, k in c)) for c in classes.values()]
        # An edit breaks at most RUN runs of an item, so many of its runs are left in a match of at most so many words.
        # Each class has its windows' length and the least number of runs left.
        self.left = [(max(a + 2 * k for a, k in c), min(a + k - RUN + 1 - RUN * k for a, k in c)) for c in classes.values()]
        self.runs = np.unique(np.concatenate([_runs(s) for _, s in self.items])) if self.items else np.zeros(0, np.uint64)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.runs >> np.uint64(44)] = True
        # Walks of each item from every word of it, so that edits at its head leave others whole; sampled over
        # windows of eight steps (fewer in short items), sixteen and so on up to the item's size.
        rng = np.random.Generator(np.random.PCG64(seed))
        self.walks = rng.integers(1, 2**64, walks, dtype=np.uint64)
        least = lambda n: min(8, 1 << max(0, n.bit_length() - 2))
        self.scales = sorted({1 << k for _, s in self.items for k in range(len(s).bit_length()) if 1 << k >= least(len(s))})
        draw = lambda size: np.unique([(i * size + rng.integers(0, max(1, size))) // bits for i in range(bits)])  # noqa: E731  one step of each part
        self.picks = {(w, size): [draw(size) for _ in range(samples)] for size in self.scales for w in range(walks)}
        parts = []
        for number, (_, s) in enumerate(self.items):
            for size in self.scales:
                if least(len(s)) <= size <= len(s):
                    starts = np.arange(len(s) - size + 1)
                    own = self.keys(s, starts, [size])
                    parts.append((own.ravel(), np.full(own.size, number), np.repeat(starts, own.shape[1])))
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        key, owner, offset = (np.concatenate(c) for c in zip(empty, *parts))
        order = np.lexsort((offset, owner, key))
        self.key, self.owner, self.offset = key[order], owner[order].astype(np.int32), offset[order].astype(np.int32)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.key >> np.uint64(42)] = True

    def keys(self, h: np.ndarray, starts: np.ndarray, scales: list[int]) -> np.ndarray:
        """Sampled keys of the CGK walks from each start, over windows of so many steps: a row for each start.

        A walk writes the word it stands on at each step and goes on by a random bit of word and step, so
        walks over similar texts meet again after an edit and then write the same.
        """
        out = []
        for w, salt in enumerate(self.walks):
            at, wrote, turns = starts.copy(), {}, mix(h ^ salt)
            used = {int(p) for size in scales for own in self.picks[w, size] for p in own}
            for j in range(max(used, default=-1) + 1):
                here = np.minimum(at, len(h) - 1)
                if j in used:
                    wrote[j] = h[here]
                at += (turns[here] >> np.uint64(j & 63) & np.uint64(1)).astype(np.int64)
            for size in scales:
                for s, places in enumerate(self.picks[w, size]):
                    key = np.full(len(starts), mix(np.array([(w * 1000 + s) * 1000 + size], np.uint64))[0])
                    for p in places.tolist():
                        key = mix(key + wrote[p])
                    out.append(key)
        return np.stack(out, axis=1) if out else np.zeros((len(starts), 0), np.uint64)

    def find(self, words: Words) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item number, first word, end, edits, words of the item): the best match of each row and item."""
        if not self.items or not len(words.hash):
            return []
        n, h = len(words.hash), words.hash
        known = self.table[h >> np.uint64(48)]
        maybe = np.flatnonzero(known)
        at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        known[maybe] = self.known[at] == h[maybe]
        other = np.concatenate(([0], np.cumsum(~known, dtype=np.int32)))
        last = np.repeat(words.first[1:], np.diff(words.first))  # end of each word's row
        runs = _runs(h)
        maybe = np.flatnonzero(self.likely[runs >> np.uint64(44)])
        maybe = maybe[np.isin(runs[maybe], self.runs) & (maybe + RUN <= last[maybe])]
        whole = np.zeros(n + 1, np.int32)
        whole[maybe + 1] = 1
        whole = np.cumsum(whole, dtype=np.int32)
        good = np.zeros(n, bool)
        for (size, most), (reach, left) in zip(self.windows, self.left):
            m = n - size
            if m >= 0:
                fits = (other[size:] - other[: m + 1] <= most) & (np.arange(m + 1) + size <= last[: m + 1])
                if left > 0:
                    fits &= whole[np.minimum(np.arange(m + 1) + max(0, reach - RUN + 1), n)] - whole[: m + 1] >= left
                good[: m + 1] |= fits
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        most_of = np.array(self.most, np.int64)
        # A walk so far from any good start belongs to no match.
        reach, slack = self.longest + max(self.most), max(self.most)
        upto, spots = np.concatenate(([0], np.cumsum(good))), np.arange(n)
        near = np.flatnonzero(upto[np.minimum(spots + slack + 1, n)] > upto[np.maximum(spots - reach, 0)])
        for low in range(0, len(near), 10_000):
            some = near[low : low + 10_000]
            keys = self.keys(h, some, self.scales)
            spot = np.flatnonzero(self.seen[keys.ravel() >> np.uint64(42)])
            own = keys.ravel()[spot]
            first, end = np.searchsorted(self.key, own), np.searchsorted(self.key, own, "right")
            times = end - first
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            hit, at = np.repeat(first, times) + nth, np.repeat(some[spot // max(1, keys.shape[1])], times)
            pairs = np.unique((at - self.offset[hit] + reach) * len(self.items) + self.owner[hit])
            begin, number = pairs // len(self.items) - reach, pairs % len(self.items)
            tried = []
            for shift in range(-slack, slack + 1):
                start = begin + shift
                fit = (np.abs(shift) <= most_of[number]) & (start >= 0) & (start < n)
                fit[fit] = good[start[fit]]
                tried.append(start[fit] * len(self.items) + number[fit])
            for p, number in zip(*(x.tolist() for x in divmod(np.unique(np.concatenate(tried)), len(self.items)))):
                item, most = self.lists[number], self.most[number]
                text = h[p : min(p + len(item) + most, last[p])].tolist()
                if len(text) < len(item) - most or len(self.sets[number].difference(text)) > most:
                    continue
                got, row = edits_of(item, text, most), int(words.row[p])
                if got:
                    place = p - int(words.first[row])
                    new = (got[0], place, place + got[1])
                    best[row, number] = min(best.get((row, number), new), new)
        return [(row, number, b[1], b[2], b[0], len(self.items[number][1])) for (row, number), b in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, error: float = 0.2, least_words: int = 8, walks: int = 2, samples: int = 3, bits: int = 4, block: int = 1000) -> DataFrame:
    """Passages of documents that are benchmark items but for a few edits: (doc_id, item_id, start, end, edits, item_words).

    Every word of a whole text may start a passage. Starts whose item-sized window has more words
    that no item has than edits are allowed, or fewer runs of items' words than so many edits leave whole,
    cannot match and are left out. At the others, CGK walks are
    sampled over windows of eight steps up to an item's size and looked up among walks from every word of
    every item; starts around what is found are tried, and the edit distance in words decides: at most ``error`` times the item's words. The best passage
    of each document and item is returned, words counted from 0. Items are taken to the tasks in blocks of
    at most ``block``, a pass for each.

    Items of less than ``least_words`` words match where all their words are equal; empty or null ones match
    nothing; of repeated item_ids with other texts each counts. Null, empty texts: no matches.
    Repeated documents: a row each. Empty tables: no rows. Other columns are ignored.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-items.count() // block))
    found = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = Items([r.item_id for r in own], [r.text for r in own], error, least_words, walks, samples, bits)

        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                column, rows = strings(batch.column(1)), []
                for low, high in slices(column):
                    for row, number, *rest in index.find(Words(column.slice(low, high - low))):
                        rows.append((batch.column(0)[low + row].as_py(), index.items[number][0], *rest))
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=[x.split()[0] for x in PAIRS.split(", ")])

        found.append(texts.mapInArrow(run, PAIRS))
    return reduce(DataFrame.unionByName, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents without a benchmark passage, with their columns. Rows of one doc_id are judged each by their text."""
    bad = scratch.last(matches(keyed(docs), benchmark, **options).select("doc_id").distinct())
    return docs.join(bad, row_key(docs) == bad.doc_id, "left_anti")
