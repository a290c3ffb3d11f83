"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, mix, slices, strings

_SYMBOL, _UPPER, _DIGIT, _BANG, _MARK = (
    np.isin(np.arange(256), [ord(c) for c in chars])
    for chars in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", ".,;:?")
)
#: Statistics of a text, in this order.
STATISTICS = (
    "log words", "word bytes", "symbols", "capitals", "digits", "exclamation marks", "marks", "distinct words",
    "repeats of the word before", "words in repeated windows", "most frequent word", "log line words", "repeated lines",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text; zeros for texts without words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for low, high in slices(texts):
        words = Words(texts.slice(low, high - low))
        sums = {}
        for name, table in (("sym", _SYMBOL), ("up", _UPPER), ("dig", _DIGIT), ("bang", _BANG), ("mark", _MARK)):
            total = np.concatenate(([0], np.cumsum(table[words.data])))
            sums[name] = total[words.edges[1:]] - total[words.edges[:-1]]
        length = np.concatenate(([0], np.cumsum(words.end - words.start)))
        newline = np.flatnonzero(words.data == 10)
        for i in range(high - low):
            a, b = words.first[i], words.first[i + 1]
            n = b - a
            if not n:
                continue
            h, size = words.hash[a:b], words.edges[i + 1] - words.edges[i]
            _, counts = np.unique(h, return_counts=True)
            repeated = 0.0
            if n >= 3:
                three = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))
                _, back, times = np.unique(three, return_inverse=True, return_counts=True)
                hit = times[back] > 1
                cover = np.zeros(n, bool)
                for k in range(3):
                    cover[k : n - 2 + k] |= hit
                repeated = cover.mean()
            cuts = np.searchsorted(words.start[a:b], newline[np.searchsorted(newline, words.edges[i]) : np.searchsorted(newline, words.edges[i + 1])])
            firsts = np.unique(np.concatenate(([0], cuts[cuts < n])))
            lines = np.add.reduceat(h, firsts)
            out[low + i] = (
                np.log1p(n), (length[b] - length[a]) / n, sums["sym"][i] / size, sums["up"][i] / size, sums["dig"][i] / size,
                sums["bang"][i] / size, sums["mark"][i] / size, len(counts) / n, (h[1:] == h[:-1]).sum() / n, repeated,
                counts.max() / n, np.log1p(n / len(firsts)), 1 - len(np.unique(lines)) / len(lines),
            )
    return out


def _map_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = statistics(strings(batch.column(1)))
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(STATISTICS)), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), stats], names=["doc_id", "stats"])


class Fourier:
    """cos(x W + b): inner products of these approximate a Gaussian kernel of unit-scaled statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, np.where(scale > 1e-12, scale, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.concatenate((np.ones((len(x), 1)), z), axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pool(level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for y, w in zip(level, weight):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks[-1]
            blocks[-1] = [(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), y) for y, _, n in blocks]) if blocks else np.zeros(0)


def score(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    features: int = 128,
    width: float = 3.0,
    ridge: float = 1.0,
    folds: int = 3,
    threshold: float = 0.3,
) -> DataFrame:
    """Quality of each document: (doc_id, held_out, score, predicted).

    Learns from all labelled rows whose crc32(doc_id as text) mod 5 is not 0. Each partition sums its
    normal equations, by fold; Spark adds them up, so the driver gets one small matrix whatever the
    input. Ridge scores of left-out folds are calibrated by isotonic regression over score bins.

    Null or empty text: scored from zero statistics. Null doc_id: not held out, never learned from.
    Repeated documents are scored each; of repeated labels the smallest counts; null labels do not.
    Without labels every score is 0.5. Other columns are ignored.
    """
    stats = scratch.save(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_map_statistics, "doc_id long, stats array<double>"))
    crc = F.crc32(F.col("doc_id").cast("string"))
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    marks = marks.where(crc % 5 != 0).withColumn("fold", (F.floor(crc / 5) % folds).cast("int"))
    known = scratch.save(stats.join(marks, "doc_id").select("label", "fold", "stats"))
    n = len(STATISTICS)
    at = known.agg(F.count("*"), *(f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(n))).first()
    result = "doc_id long, held_out boolean, score double, predicted int"
    model = None
    if at[0]:
        fourier = Fourier(np.array(at[1 : n + 1]), np.array(at[n + 1 :]), features, width)
        size = features + 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, size, size + 1))
            for batch in batches:
                z, y, fold = fourier(matrix(batch.column(2))), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for k in range(folds):
                    own = fold == k
                    total[k] += z[own].T @ np.concatenate((z[own], y[own, None]), axis=1)
            flat = total.reshape(folds * size, size + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, size + 1), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), lists], names=["i", "row"])

        cells = known.mapInArrow(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
        equations = np.zeros((folds * size, size + 1))
        for i, j, x in cells.groupBy("i", "j").agg(F.sum("x")).collect():
            equations[i, j] = x
        equations = equations.reshape(folds, size, size + 1)
        keep = ridge * np.eye(size)
        keep[0, 0] = 1e-9
        solve = lambda e: np.linalg.solve(e[:, :-1] + keep, e[:, -1])
        whole = solve(equations.sum(axis=0))
        left_out = np.stack([solve(equations.sum(axis=0) - e) for e in equations])

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = (fourier(matrix(batch.column(2))) * left_out[batch.column(1).to_numpy()]).sum(axis=1)
                bins = np.floor(np.clip(s, -1, 2) * 500).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(0)], names=["bin", "label"])

        table = known.mapInArrow(raw, "bin int, label double").groupBy("bin").agg(F.count("*"), F.avg("label")).collect()
        bins, weight, mean = map(np.array, zip(*sorted(map(tuple, table))))
        model = whole, (bins + 0.5) / 500, pool(mean, weight)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(batch.num_rows, 0.5)
            if model and batch.num_rows:
                s = np.clip(np.interp(fourier(matrix(batch.column(1))) @ model[0], model[1], model[2]), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return stats.select("doc_id", "stats", F.coalesce(crc % 5 == 0, F.lit(False)).alias("held_out")).mapInArrow(apply, result)
