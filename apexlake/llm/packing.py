"""Mixture-controlled packing: deficit round-robin over source queues, windows of fixed token count."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, strings

TOKENS = "doc_id long, queue string, part int, place long, n long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " window_id long, queue string"
)


class Encoder:
    """Token ids of a text by a byte-level BPE file of ``tokenizers``, with words kept in a bounded cache.

    A text is cut at single spaces that the pre-tokenizer cuts at as well, so each part can be looked up;
    only parts not met lately go through the BPE model. Texts with runs of white space in which a cut
    could differ, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, cached: int = 300_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
        self.run = regex.compile(r"\s (?:\s|$)").search
        self.pretoken = regex.compile(public_tokenizers.PATTERN).findall
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte = [""] * 256
        for i in range(128):
            self.byte[i] = letters.pre_tokenize_str(chr(i))[0][0]
        for i in range(128, 0x800, 1):
            pair = chr(i).encode()
            mapped = letters.pre_tokenize_str(chr(i))[0][0]
            self.byte[pair[0]], self.byte[pair[1]] = mapped[0], mapped[1]
        for c in ("ࠀ", "က", "\U00010000", "\U00040000", "\U00080000", "\U000c0000", "\U00100000", *map(chr, range(0xE000, 0xFFFF, 0x400)), *map(chr, range(0x800, 0xD800, 0x400))):
            for b, mapped in zip(c.encode(), letters.pre_tokenize_str(c)[0][0]):
                self.byte[b] = mapped
        self.word, self.chunk = _Cache(self._word, cached), _Cache(self._chunk, cached)

    def _word(self, word: str) -> bytes:
        mapped = "".join([self.byte[b] for b in word.encode()])
        return np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], self.kind).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and what follows it up to the next space."""
        if chunk.isalpha():
            return self.word[" " + chunk]
        if chunk[:-1].isalpha() and not (chunk[-1].isnumeric() or chunk[-1].isspace()):
            return self.word[" " + chunk[:-1]] + self.word[chunk[-1]]
        return b"".join([self.word[w] for w in self.pretoken(" " + chunk)])

    def whole(self, text: str) -> bool:
        """Whether a cut at a space could fall inside one of the pre-tokenizer's pieces."""
        spaces = "  " in text or "\n " in text or any(c in text for c in self.odd)
        return spaces and bool(self.run(text)) or any(x in text for x in self.special)

    def __call__(self, text: str) -> bytes:
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        first, *rest = text.split(" ")
        return b"".join([*map(self.word.__getitem__, self.pretoken(first)), *map(self.chunk.__getitem__, rest)])


class _Cache(dict):
    """The last entries: twice the given number at most."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


_encoders: dict[str, Encoder] = {}


def tokens(docs: DataFrame, tokenizer: str, end_id: int, queues: int) -> DataFrame:
    """Of each document: ids with the end id, its queue, and its place in its partition's part of that queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, filled = TaskContext.get().partitionId(), {}
        encode = _encoders.setdefault(tokenizer, None) or _encoders.update({tokenizer: Encoder(tokenizer)}) or _encoders[tokenizer]
        end = np.array([end_id], encode.kind).tobytes()
        for batch in batches:
            texts = strings(batch.column(1))
            for low in range(0, len(texts), 500):
                ids = [encode(t) + end for t in texts[low : low + 500].to_pylist()]
                own, n = batch.column(2)[low : low + 500].to_pylist(), [len(x) // encode.kind.itemsize for x in ids]
                place = []
                for queue, size in zip(own, n):
                    place.append(filled.get(queue, 0))
                    filled[queue] = place[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low : low + 500].cast(pa.int64()), pa.array(own, pa.string()), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "place", "n", "ids"],
                )

    few = docs.select("source").distinct().limit(queues + 1).count() <= queues
    queue = F.coalesce(F.concat(F.lit("source "), F.col("source").cast("string")), F.lit("no source"))
    if not few:
        queue = F.concat(F.lit("group "), F.pmod(F.xxhash64(queue), F.lit(queues)).cast("string"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), queue.alias("queue")).mapInArrow(run, TOKENS)


class Rounds:
    """Where windows end in each queue, without a pass over the queues.

    Token j of queue k is due at (j + 0.5) / T_k; windows are runs of equal length in that order, ties
    by queue. So each queue has had its share of what is packed so far, to a token, at each window's
    end: the state that a token-quantum deficit round-robin carries, in closed form, so that any task
    can start at any window.
    """

    def __init__(self, totals: np.ndarray, window: int):
        self.totals, self.window, self.all = totals, window, int(totals.sum())

    def due(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil(x[:, None] * self.totals - 0.5), 0, self.totals).astype(np.int64)

    def ends(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each of the windows."""
        goal = np.minimum(windows * self.window, self.all)
        low, high = np.zeros(len(goal)), np.full(len(goal), 1.0 + 1e-9)
        for _ in range(64):
            middle = (low + high) / 2
            over = self.due(middle).sum(axis=1) > goal
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        out = self.due(low)
        more = np.maximum(self.due(high) - out, 0)
        left = (goal - out.sum(axis=1))[:, None]
        before = np.cumsum(more, axis=1) - more
        out += np.clip(left - before, 0, more)
        return np.where((goal >= self.all)[:, None], self.totals, out)

    def first(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """About the window of a queue's token: it or one beside it."""
        return self.due((place + 0.5) / self.totals[queue]).sum(axis=1) // self.window


def pack(
    docs: DataFrame,
    scratch: Scratch,
    tokenizer: str,
    end_id: int = 1,
    sequence_tokens: int = 2048,
    window_sequences: int = 8,
    queues: int = 1024,
) -> DataFrame:
    """Pack every token of every document into sequences; one row per piece.

    Sources are queues; each window of ``window_sequences`` sequences takes from every queue its
    corpus-wide proportion of tokens, exact to one token, and what a window falls short is carried to
    the next, whichever task makes it. Within a window, pieces of a queue lie together. Documents are
    cut at window and sequence ends only; only the last sequence is not full. With more sources than
    ``queues``, sources share queues by hash.

    Null text: empty, so the end id alone. Null source: a queue of its own. Repeated rows are packed
    each. Empty table: no rows. Other columns are ignored.
    """
    ids = scratch.save(tokens(docs, tokenizer, end_id, queues))
    filled = ids.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    base = scratch.save(filled.select("queue", "part", (F.sum("total").over(W.partitionBy("queue").orderBy("part")) - F.col("total")).alias("base")))
    totals = sorted((r.queue, r.total) for r in filled.groupBy("queue").agg(F.sum("total").alias("total")).collect())
    names, sizes = [q for q, _ in totals], np.array([t for _, t in totals], np.int64)
    window = sequence_tokens * window_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, number = Rounds(sizes, window), {q: i for i, q in enumerate(names)}
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                n = batch.column(3).to_numpy()
                queue = np.array([number[q] for q in batch.column(1).to_pylist()])
                place = batch.column(2).to_numpy() + batch.column(5).to_numpy()
                span = np.stack([rounds.first(queue, place) - 1, rounds.first(queue, place + n - 1) + 2], axis=1)
                known = np.unique(np.concatenate([np.arange(max(a, 0), b + 1) for a, b in span]))
                ends = rounds.ends(known)
                rows = []
                for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4))):
                    raw = np.frombuffer(text.as_buffer(), np.dtype(f"<u{len(text.as_buffer()) // n[i]}")).astype("<u4")
                    k, done = queue[i], 0
                    while done < n[i]:
                        p = place[i] + done
                        w = int(np.searchsorted(ends[:, k], p, "right")) - 1
                        ahead = ends[w + 1, :k].sum() - ends[w, :k].sum()
                        spot = int(ahead + p - ends[w, k])
                        size = int(min(n[i] - done, ends[w + 1, k] - p, sequence_tokens - spot % sequence_tokens))
                        g = int(known[w]) * window + spot
                        rows.append((doc, done, size, zlib.crc32(raw[done : done + size].tobytes()), int(n[i]), g // sequence_tokens, g % sequence_tokens, int(known[w]), names[k]))
                        done += size
                kinds = [pa.int64()] * 8 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id", "queue"],
                )

    placed = ids.join(base, ["queue", "part"]).select("doc_id", "queue", "place", "n", "ids", "base")
    return placed.mapInArrow(run, PIECES)
