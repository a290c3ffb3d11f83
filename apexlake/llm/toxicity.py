"""Toxicity: cumulative-link ordinal regression of severity grades on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Scratch, Words, keyed, mix, row_key, signed, slices, strings


#: Bytes of the beginnings of words that are features beside the words.
STEM = 5


def features(words: Words) -> np.ndarray:
    """Two features of each word: itself and its first bytes."""
    return np.stack((words.hash, mix(words.prefix(STEM))), axis=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, least shingle, word hash, times in the text)"""
    for batch in batches:
        texts = strings(batch.column(1))
        for low, high in slices(texts):
            words = Words(texts.slice(low, high - low), PUNCTUATION)
            own = features(words)
            ids, marks = batch.column(0), batch.column(2)
            rows = [(np.unique(own[words.first[i] : words.first[i + 1]], return_counts=True), s[:1]) for i, s in enumerate(words.shingles())]
            sizes = np.array([len(h) for (h, _), _ in rows])
            at = pa.array(np.repeat(np.arange(low, high), sizes))
            least = np.array([int(signed(s)[0]) if len(s) else 0 for _, s in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()).take(at), marks.cast(pa.int32()).take(at), pa.array(np.repeat(least, sizes)), pa.array(signed(np.concatenate([h for (h, _), _ in rows]))), pa.array(np.concatenate([n for (_, n), _ in rows]))],
                names=["doc_id", "toxic", "least", "word", "times"],
            )


class Ordinal:
    """P(grade >= k) = sigmoid(x w - cut_k): one weight for each feature, shared by all cuts."""

    def __init__(self, features: np.ndarray, grades: int):
        self.features, self.grades = features, grades
        self.w, self.cuts = np.zeros(len(features)), np.arange(1.0, grades + 1)

    def fit(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, l2: float = 1e-5, steps: int = 500, rate: float = 0.1):
        """By Adam over all given rows; cuts stay ordered, as their gaps are exponentials."""
        n, k = len(grade), np.arange(1, self.grades + 1)
        p = np.concatenate((self.w, [1.0], np.zeros(self.grades - 1)))
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            w, gaps = p[: len(self.w)], np.exp(p[len(self.w) + 1 :])
            cuts = p[len(self.w)] + np.concatenate(([0.0], np.cumsum(gaps)))
            x = np.bincount(row, value * w[feature], n)
            above = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -40, 40)))
            edge = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
            prob = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
            slope = above * (1 - above)
            at = np.zeros((n, self.grades))  # of the log-likelihood by (x - cut_k)
            at += np.where(k == grade[:, None], slope / prob[:, None], 0)
            at -= np.where(k == grade[:, None] + 1, slope / prob[:, None], 0)
            by_cut = -at.sum(axis=0)
            g = np.concatenate((np.bincount(feature, value * at.sum(axis=1)[row], len(w)) / n - l2 * w, [by_cut.sum() / n], gaps * np.cumsum(by_cut[::-1])[::-1][1:] / n))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.cuts = p[: len(self.w)], p[len(self.w)] + np.concatenate(([0.0], np.cumsum(np.exp(p[len(self.w) + 1 :]))))
        return self

    def above(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.cuts, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = 10_000, vocabulary: int = 2048, least_z: float = 5.5, grades: int = 3) -> Ordinal | None:
    """Fit on at most ``sample_rows`` labelled rows of each class, those with the smallest hashes of doc_id.

    Features are the words and beginnings of words whose document counts differ most between the classes, by the
    signed root of the likelihood ratio, at least ``least_z``, ``vocabulary`` at most. Labels say only toxic or not, so the grade of a
    toxic row comes from the number of its toxic words: of the sampled toxic rows that have any, the
    thirds are grades 1 to 3; toxic rows without any have grade 1, other rows 0. Of near copies (equal
    least shingle) one row counts, so that a group of copies makes no features. None without both classes.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("order", F.xxhash64("doc_id"))
    picked = scratch.save(marks.where("toxic = 1").orderBy("order").limit(sample_rows).unionByName(marks.where("toxic = 0").orderBy("order").limit(sample_rows)).select("doc_id", "toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").dropDuplicates(["doc_id"])
    found = scratch.save(texts.select("doc_id", "text", "toxic").mapInArrow(_counts, "doc_id long, toxic int, least long, word long, times long"))
    one = found.groupBy("least").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    found = scratch.save(found.join(one, "doc_id"))
    of = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if len(of) < 2:
        return None
    term = lambda seen, share: F.when(seen > 0, seen * F.log(seen / ((F.col("a") + F.col("b")) * F.lit(share)))).otherwise(0.0)
    share = of[1] / (of[0] + of[1])
    z = F.signum(F.col("a") / of[1] - F.col("b") / of[0]) * F.sqrt(F.greatest(F.lit(0.0), 2 * (term(F.col("a"), share) + term(F.col("b"), 1 - share))))
    words = found.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    words = scratch.save(words.where("a + b >= 5").withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "word").limit(vocabulary).select("word", "z"))
    strength = {r.word: r.z for r in words.collect()}
    chosen = np.array(sorted(strength), np.int64)
    rows = found.join(words, "word").select("doc_id", "toxic", "word", "times").toPandas()
    totals = found.select("doc_id", "toxic").distinct().orderBy("doc_id").toPandas()
    if not len(chosen):
        return None
    row = np.searchsorted(totals.doc_id.to_numpy(), rows.doc_id.to_numpy())
    feature, value = np.searchsorted(chosen, rows.word.to_numpy()), np.log1p(rows.times.to_numpy())
    bad = np.array([strength[w] for w in rows.word]) > 0
    hits = np.bincount(row[bad], rows.times.to_numpy()[bad], len(totals))
    toxic = totals.toxic.to_numpy()
    some = hits[(toxic == 1) & (hits > 0)]
    cuts = np.quantile(some, [k / grades for k in range(1, grades)]) if len(some) else np.ones(grades - 1)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, hits), 0)
    return Ordinal(chosen, grades).fit(row, feature, value, grade)


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.5, **fitting) -> DataFrame:
    """Severity of each document: (doc_id, expected_severity, grade, p_toxic, toxic).

    expected_severity is the sum of P(grade >= k); grade the most severe with P(grade >= k) at least
    ``threshold``; toxic says that it is 1 or more. Whole texts are scored, in one pass without shuffle.

    Null or empty text: no features, so the model's base rate. Repeated documents are scored each; of
    repeated labels the largest counts, null labels do not. Without labels of both classes everything
    has severity 0. Null doc_id: scored, never learned from. Other columns are ignored.
    """
    return applied(docs, fit(docs, labels, scratch, **fitting), threshold)


def applied(docs: DataFrame, model: Ordinal | None, threshold: float) -> DataFrame:
    """score() by a fitted model."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            above = np.zeros((len(texts), model.grades if model else 1))
            if model:
                table = np.zeros(1 << 16, bool)
                table[model.features.view(np.uint64) >> np.uint64(48)] = True
                for low, high in slices(texts):
                    words = Words(texts.slice(low, high - low), PUNCTUATION)
                    own = features(words).ravel()
                    maybe = np.flatnonzero(table[own >> np.uint64(48)])
                    h = signed(own[maybe])
                    at = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
                    hit = model.features[at] == h
                    pair, times = np.unique(words.row[maybe[hit] // 2] * len(model.features) + at[hit], return_counts=True)
                    x = np.bincount(pair // len(model.features), np.log1p(times) * model.w[pair % len(model.features)], high - low)
                    above[low:high] = model.above(x)
            grade = (above >= threshold).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(grade > 0)],
                names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    out = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(apply, out)


def keep_clean(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.5, **fitting) -> DataFrame:
    """The documents that are not toxic, with their columns. Rows of one doc_id are judged each by their text."""
    model = fit(docs, labels, scratch, **fitting)
    bad = scratch.last(applied(keyed(docs), model, threshold).where("toxic").select("doc_id").distinct())
    return docs.join(bad, row_key(docs) == bad.doc_id, "left_anti")
