import zlib
from collections import defaultdict

import numpy as np
from helpers import docs

from apexlake.llm import packing
from apexlake.llm.common import Scratch
from apexlake.llm.queries import tokenizer_file

TEXTS = [
    "The and attion to thanedble the, anea.\nEriner thanea. It's they'll  12 3é",
    "", None, "a  b   c \n \n d\t e ", "<|endoftext|> x <|endoftext|>", "ü" * 300 + " 漢字 😀 end\0 mid", " lead", "trail ", "\n", " ",
    *["word%d and more text, again. " % i * (i + 3) for i in range(40)], "long text here " * 4000, "same", "same",
]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(tokenizer_file()), packing.Encoder(tokenizer_file(), cached=5)
    for text in TEXTS:
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(mine(text or ""), mine.kind).tolist() == want, text


def test_every_id_once_and_mixture(spark):
    from tokenizers import Tokenizer

    sources = [("hot" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 4}") for i in range(len(TEXTS))]
    out = packing.pack(docs(spark, TEXTS, sources), Scratch(spark), tokenizer_file(), sequence_tokens=256, window_sequences=2).collect()
    whole, of = Tokenizer.from_file(tokenizer_file()), defaultdict(list)
    sequences, windows, totals = defaultdict(list), defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in out:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        windows[r.window_id][r.queue] += r.length
        totals[r.queue] += r.length
    for i, text in enumerate(TEXTS):
        ids, at = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or k == len(sequences) - 1
    total, so_far = sum(totals.values()), defaultdict(int)
    for w in sorted(windows):
        for q, t in totals.items():
            so_far[q] += windows[w][q]
            packed = min((w + 1) * 512, total)
            assert abs(so_far[q] - packed * t / total) <= 1.5


def test_empty_and_many_sources(spark):
    assert packing.pack(docs(spark, ["x"]).where("false"), Scratch(spark), tokenizer_file()).count() == 0
    out = packing.pack(docs(spark, TEXTS[:20], [f"s{i}" for i in range(20)]), Scratch(spark), tokenizer_file(), queues=3)
    assert {r.queue for r in out.collect()} <= {"group 0", "group 1", "group 2"}
