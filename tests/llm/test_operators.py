"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import io
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from helpers import docs, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from apexlake.llm import decontaminate, jaccard, licenses, lines, quality, rules, toxicity, urls, warc
from apexlake.llm.common import Scratch, Words, components, strings

R = random.Random(4)
VOCAB = ["w%d" % i for i in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def changed(text, share, seed):
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = "x%d" % r.randrange(10**6)
    return " ".join(w)


BASE = [prose(120, i) for i in range(12)]
TEXTS = [
    *BASE, None, "", " \n\t ", "one two three", "ONE two three", "one two", BASE[0].upper(), BASE[1], BASE[1],
    *[changed(BASE[2], 0.005 * (k % 5 + 1), k) for k in range(60)], *[changed(BASE[3], 0.02, k) for k in range(8)], prose(6000, 77), changed(prose(6000, 77), 0.01, 5), prose(4, 3), "é " * 50,
]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_jaccard_is_brute_force(spark):
    sets = [shingles(t) for t in TEXTS]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, TEXTS), Scratch(spark)).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = jaccard.keep_one(docs(spark, TEXTS), Scratch(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(sets)) if want[i] == i]


def test_trees_alone_find_all_pairs(spark):
    """Dual traversal from scratch: every linked pair is among the candidates."""
    from apexlake.llm.jaccard import _BITS, _prefix, SIGNATURE, WIDE
    import numpy as np

    sets = [Words(strings(pa.array([t]))).shingles()[0] >> np.uint64(64 - WIDE) for t in TEXTS]

    out, often = [], np.zeros(1 << 20, np.int64)
    for i, s in enumerate(sets):
        bits = np.zeros(SIGNATURE * 64, bool)
        bits[(s >> np.uint64(20)) % np.uint64(SIGNATURE * 64)] = True
        for spot, t in enumerate(_prefix(s, often, 80) if len(s) else []):
            out.append((int(t.view(np.int64)), i, spot, i, len(s), *np.packbits(bits, bitorder="little").view(np.int64).tolist()))
    entries = spark.createDataFrame(out, "token long, cls long, spot int, comp long, n long, " + ", ".join(f"{b} long" for b in _BITS))
    entries = entries.withColumn("k", F.count("*").over(Window.partitionBy("token")))
    got = {(a, b) for a, b, _ in rows(jaccard.candidates(entries, 80, Scratch(spark), leaf=2, fan=2, tree=7))}
    plain = [set(s.tolist()) for s in sets]
    for i in range(len(plain)):
        for j in range(i):
            if plain[i] and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j]):
                assert (j, i) in got


def test_components(spark):
    links = [(R.randrange(300), R.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    want = roots(500, links)
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"), Scratch(spark))))
    assert all(got.get(i, i) == want[i] for i in range(500))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_rules_counts(spark):
    shared = "this very line is on many pages of one host"
    texts = [*TEXTS[:18], "a b c\na b c\n\na b c d", "x y z x y z q", "# $ a|b <c>", *[f"{shared}\nonly {i} words here" + " more" * 2 for i in range(25)], *[shared + "\n" + prose(80, i) for i in range(5)]]

    def brute(t):
        w = [x for x in __import__("re").split("[ \t-\r]+", t or "") if x]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
        ls = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(hit)

    got = {r.doc_id: r for r in rules.judge(docs(spark, texts), Scratch(spark)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.removed_words == (10 if shared in (t or "") else 0)
    assert all(got[i].kept for i in range(12)) and all(got[i].kept for i in range(len(texts) - 5, len(texts)))
    assert rules.judge(docs(spark, texts).where("false"), Scratch(spark)).count() == 0


def test_line_dedup_is_brute_force(spark):
    import re

    long = [" ".join(random.Random(s).choices(["stone%d" % i for i in range(900)], k=14)) for s in range(30)]
    near = [x + " end" for x in long[:6]]
    texts = ["\n".join(long[:10]), "\n".join(long[5:15] + ["few words"]), None, "", "\n".join(near + ["few words"]), long[20].upper() + "\n" + long[20], "\n".join(long[20:25])]

    def own(line):
        norm = re.sub("[ \t-\r]+", " ", line.lower()).strip(" ")
        return norm, {norm[a : a + 8] for a in range(max(1, len(norm) - 7))}

    places = [(d, k, *own(x)) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if len(p[2].split(" ")) >= 5]
    links = [(i, j) for i in range(len(places)) for j in range(i) if len(places[i][3] & places[j][3]) >= 0.8 * len(places[i][3] | places[j][3])]
    want, up = defaultdict(list), roots(len(places), links)
    for i, p in enumerate(places):
        if up[i] != i:
            want[p[0]].append(p[1])
    got = {r.doc_id: r.removed for r in lines.dedup(docs(spark, texts), Scratch(spark)).collect()}
    assert got == {d: want[d] for d in range(len(texts))}
    kept = {r.doc_id: r.text for r in lines.keep_first(docs(spark, texts), Scratch(spark)).collect()}
    assert kept[0] == texts[0] and kept[2] is None and kept[3] == "" and kept[1] == "\n".join(long[10:15] + ["few words"])
    assert lines.dedup(docs(spark, texts).where("false"), Scratch(spark)).count() == 0


def test_decontamination(spark):
    items = [(i, prose(20 + 3 * i, 1000 + i)) for i in range(12)] + [(90, "too short"), (91, None), (92, ""), (3, prose(29, 1003))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, want = [], set()
    for i, t in items[:12]:
        for k, share in enumerate((0, 0.05, 0.15)):
            want.add((len(texts), i))
            texts.append(prose(200, 50 * i + k) + " " + (t if not share else changed(t, share, k)).upper().replace(" ", "\n", 1) + " " + prose(100, i))
    texts += [prose(300, 9000 + i) for i in range(10)] + [None, "", " "]
    found = decontaminate.matches(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    for r in found:
        assert r.edits <= 0.2 * r.item_words and abs(r.start - 200) <= 8
    clean = decontaminate.keep_clean(docs(spark, texts), bench, Scratch(spark))
    assert sorted(r.doc_id for r in clean.collect()) == list(range(36, len(texts))) and clean.columns == docs(spark, ["x"]).columns
    assert decontaminate.matches(docs(spark, texts), bench.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_edit_distance(seed):
    r = random.Random(seed)
    a, b = ([r.randrange(4) for _ in range(r.randrange(1, 90))] for _ in range(2))
    b = a[:] if seed % 3 == 0 else b
    row, best = list(range(len(a) + 1)), (len(a), 0)
    for j, y in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
        row = new
        best = min(best, (row[-1], -j))
    assert decontaminate.edits_of(a, b, len(a)) == (best[0], -best[1])


def test_licenses(spark):
    texts = ["some prose\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "All rights reserved.", "the driver has a valid license to sell food", None, "", prose(50, 1), "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: (r.families, r.n_unknown) for r in licenses.scan(docs(spark, texts), Scratch(spark)).collect()}
    assert got == {0: ("apache-2.0", 0), 1: ("mit", 0), 2: ("all-rights-reserved", 0), 3: ("", 1), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("cc-by-nc", 0), 8: ("gpl", 0)}


def test_wrapped_licenses(spark):
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General Public\n# License as published by the Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    mit = "Permission is hereby granted, free of charge,\r\nto any person obtaining a copy of this software\r\nand associated documentation files"
    spread = "\n".join(prose(30, i) + " " + w for i, w in enumerate(("all", "rights", "reserved")))
    short = "This work is licensed under the GNU\nGeneral Public License, version 3."
    narrow = prose(7, 5) + " " + short.replace(" ", "\n") + "\n" + prose(300, 6)
    texts = [gpl, bsd + "\n \n" + mit, "\n\n".join([prose(40, 3), gpl, "All rights reserved.", prose(40, 4)]), spread, bsd.replace("\n", "\n\n\n"), short, narrow]
    got = {r.doc_id: (r.families, r.n_found, r.n_paragraphs) for r in licenses.scan(docs(spark, texts), Scratch(spark)).collect()}
    assert got == {0: ("gpl", 1, 1), 1: ("bsd,mit", 2, 2), 2: ("all-rights-reserved,gpl", 2, 4), 3: ("", 0, 1), 4: ("", 0, 3), 5: ("gpl", 1, 1), 6: ("gpl", 1, 1)}


def test_unknown_licenses(spark):
    unknown = ["Licensed under the Eclipse Public License 2.0", "Licensed under the Python Software Foundation License.", "SPDX-License-Identifier: Zlib", "Licensed under the Academic Free License, version 3.0.", "This work is licensed under the Open Font License, version 1.1."]
    got = {r.doc_id: (r.families, r.n_unknown) for r in licenses.scan(docs(spark, unknown), Scratch(spark)).collect()}
    assert got == {i: ("", 1) for i in range(len(unknown))}


def test_licenses_are_those_of_plain_sets(spark):
    r = random.Random(6)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    texts = []
    for i in range(120):
        words = r.choice(notices).split(" ")
        texts.append(prose(r.randrange(40), i) + r.choice([" ", "\n"]) + "\n".join(w for w in words if r.random() > 0.1 * (i % 5)) + "\n\n" + prose(20, i))
    weights, intercept, heat = licenses.train()
    names, tells = [*licenses.TEMPLATES, "unknown"], licenses.telling(licenses.TEMPLATES)
    import math
    import re

    def families(text):
        found = set()
        for paragraph in re.split(licenses.BLANK, text.lower()):
            words = [w for w in re.split(licenses.WORD, paragraph) if w]
            windows = [(words[i : i + 24], False) for i in range(0, max(len(words), 1), 12)] + [(words, True)]
            for w, wide in windows:
                grams = licenses._grams(" ".join(w))
                z = [sum(weights[g][k] for g in grams if g in weights) + intercept[k] for k in range(len(names))]
                p = 1 / sum(math.exp((x - max(z)) / heat) for x in z)
                family = names[z.index(max(z))]
                for template in map(licenses._grams, licenses.TEMPLATES.get(family, ())):
                    own = tells[family] & template
                    short = sum(" " not in g for g in template) <= 12
                    if p >= 0.5 and len(template & grams) >= 0.6 * len(template) and (not own or own & grams) and not (short and wide):
                        found.add(family)
        return ",".join(sorted(found))

    got = {x.doc_id: x.families for x in licenses.scan(docs(spark, texts), Scratch(spark)).collect()}
    want = {i: families(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 60


def test_license_gate_loses_nothing():
    words = set(licenses.needed(0.6))
    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        grams = licenses._grams(text)
        without = {g for g in grams if not words & set(g.split())}
        assert len(without) < 0.6 * len(grams)


def test_toxicity_and_quality(spark):
    r = random.Random(8)
    bad = lambda t: " ".join(x if r.random() > 0.06 else r.choice(["vile", "scumbag", "rotten"]) for x in t.split())
    texts = [bad(prose(80, i)) + " vile scumbag" if i % 4 == 0 else prose(80, i) + (" ###" * 60 if i % 5 == 0 else "") for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 5 != 0 or i % 4 == 0), int(i % 4 == 0)) for i in range(0, 402)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs(spark, texts), labels.where("doc_id < 300"), Scratch(spark)).collect()}
    assert sum(got[i].toxic == (i % 4 == 0) for i in range(300, 400)) >= 99 and not got[400].toxic and not got[401].toxic
    assert all(0 <= x.expected_severity <= 3 for x in got.values()) and len(got) == len(texts)
    assert toxicity.score(docs(spark, texts), labels.where("false"), Scratch(spark)).where("toxic").count() == 0
    scored = {x.doc_id: x for x in quality.score(docs(spark, texts), labels, Scratch(spark)).collect()}
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i].held_out == (i in set(held)) for i in range(400))
    assert sum(scored[i].predicted == int(i % 5 != 0 or i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert {x.score for x in quality.score(docs(spark, texts), labels.where("false"), Scratch(spark)).collect()} == {0.5}


PAGES = "page_id long, url string, html string, digest string, host string"


def test_warc(spark):
    page = "<p>" + "same " * 40
    table = [(5, "http://a/\r\nx", page, "", ""), (2, None, page, "", ""), (9, "https://b", page, "", ""), (1, "c", "", "", ""), (3, "d", None, "", ""), (4, "e", "é\r\n\r\nWARC/1.1\r\n\r\n" * 30, "", ""), (7, "f", "short", "", ""), (8, "f", "short", "", "")]
    scratch = Scratch(spark)
    got = {r.metadata.page_id: r for r in warc.archive(spark.createDataFrame(table, PAGES), scratch, scratch.path(), records_per_file=5).collect()}
    assert len(got) == len(table)
    for page_id, _, html, *_ in table:
        r, data = got[page_id], (html or "").encode()
        assert r.request and r.request.record_type == "request"
        assert (r.response.payload_bytes, r.response.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.response.header_digest == r.response.payload_digest
        assert (r.response.record_type, r.response.refers_to) == (("revisit", 2) if page_id in (5, 9) else ("response", None))
        assert r.response.payload is None if page_id in (5, 9) else bytes(r.response.payload) == data


def test_warc_names_records_and_odd_archives(spark):
    page = "<p>" + "same " * 40
    table = [(5, "http://a", page, "", ""), (2, "http://b", page, "", ""), (None, "http://c", page, "", ""), (2, "http://d", page, "", "")]
    scratch = Scratch(spark)
    got = warc.archive(spark.createDataFrame(table, PAGES), scratch, scratch.path()).collect()
    ids = {r.capture_id for r in got if r.metadata.page_id == 2}
    again = [r for r in got if r.response.record_type == "revisit"]
    assert len(got) == 4 and len(ids) == 2 and len(again) == 1 and again[0].response.refers_id in ids and again[0].response.refers_to == 2
    assert warc.archive(spark.createDataFrame([], PAGES), scratch, scratch.path()).count() == 0
    odd = b"WARC/1.1\r\nWARC-Type: warcinfo\r\n\r\nWARC/1.1\r\nWARC-Type:response\r\nX: \xff\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    assert [(h["warc-type"], b) for h, b in warc.parse(io.BytesIO(odd))] == [("warcinfo", b""), ("response", b"a\r\nb")]


def test_urls(spark):
    table = [(i, f"https://www.{h}.example.org/en/{i}", "<p>sunny garden with flowers casino", "", "") for i, h in enumerate(["sunnygarden", "flowers", "garden-flowers", "casino-win", "adult-x", "casinowin"] * 20)]
    table += [(900, None, None, "", ""), (901, "nothing", "", "", ""), (902, "http://A.COM/en/x?q", "", "", ""), (903, "http://x.example.com/en/71#y", "", "", ""), (904, "http://example.net/de/80", "", "", ""), (905, "http://b.net/de/9", "", "", ""), (906, "http://notcom/en/", "", "", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(table, PAGES), Scratch(spark)).collect()}
    assert len(got) == len(table)
    assert [(got[i].host, got[i].path, got[i].rule) for i in (900, 901, 902, 903, 904, 905, 906)] == [("", "", None), ("", "", None), ("a.com", "/en/x", "com/en/"), ("x.example.com", "/en/71", "example.com/en/7"), ("example.net", "/de/80", "example.net/de/8"), ("b.net", "/de/9", "net/de/"), ("notcom", "/en/", None)]
    assert [got[i].verdict for i in (902, 903, 904, 905)] == ["block", "allow", "block", "allow"]
    assert [got[i].verdict for i in range(6)] == ["allow", "allow", "allow", "block", "block", "block"]  # the last by its segments
    assert urls.split_name("sunnygarden", {"sunny": 3.0, "garden": 3.0, "sun": 3.5}, 12.0) == ["sunny", "garden"]
