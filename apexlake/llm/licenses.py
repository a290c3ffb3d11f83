"""License scans: logistic regression on word n-grams of paragraphs, confirmed against templates."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Public notices of each family; a paragraph must resemble one of them to be confirmed.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "all-rights-reserved": ("All rights reserved.", "Copyright by the authors. All rights reserved."),
}
#: Legal sounding paragraphs of no family.
UNKNOWN = (
    "Licensed under the terms of the agreement between the parties.", "The driver must carry a valid license at all times.",
    "All rights of the members are described below.", "You need permission to enter this area.", "This work is released in May.",
    "Released under pressure, version 3 of the public work.", "The copyright office is open on weekdays.",
    "Licensed to sell food and drinks.", "Under the license of the city the market may open.",
    "Licensed under the Eclipse Public License 2.0.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "This program is free software under the GNU Affero General Public License, version 3.", "Distributed under the Boost Software License, Version 1.0.",
    "To the extent possible under law, the author has waived all copyright under CC0 1.0.", "This software is provided 'as-is', without any express or implied warranty.",
    "Licensed under the European Union Public Licence, version 1.2.", "Licensed under the Microsoft Public License.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: ISC",
)
#: Templates of up to SHORT words are looked for in windows of twice as many, which begin at every SHORT-th word of a paragraph, so that
#: each run of SHORT words lies in one, on however many lines; longer ones in paragraphs as a whole too.
SHORT = 12
WORD, BLANK = "[^a-z0-9]+", "\n[ \t\r]*(?:\n[ \t\r]*)+"


def _grams(text: str) -> set[str]:
    import re

    words = [w for w in re.split(WORD, text.lower()) if w]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


#: Words that name licences, by which unknown ones are counted, and words that other texts often have: the first and the last that needed() takes.
RARE = ("license", "licensed", "rights", "reserved", "permission", "redistribution", "redistribute", "gnu", "spdx", "mozilla", "creative", "cc")
COMMON = frozenset("a all and any are as by can charge except following for free general granted in is it later may not obtaining of or person program provided public published released source subject terms that the this to under use version with without work you".split())


def needed(least_similarity: float) -> list[str]:
    """Words of which each confirmed paragraph has one: without those of a template too many of its n-grams are missing.

    RARE words of each template are taken first, then the longest, COMMON ones last, until their absence leaves less than ``least_similarity``.
    """
    out: set[str] = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        grams, chosen = _grams(text), set()
        for word in sorted((g for g in grams if " " not in g), key=lambda w: (w not in RARE, w in COMMON, -len(w), w)):
            chosen.add(word)
            if sum(not chosen & set(g.split()) for g in grams) < least_similarity * len(grams):
                break
        out |= chosen
    return sorted(out)


def train(l2: float = 3e-3, steps: int = 300, seed: int = 3) -> tuple[dict[str, list[float]], list[float], float]:
    """Weights of each n-gram by class (families, then unknown), intercepts, and the temperature.

    Fitted on the driver to the templates alone, each with words dropped or foreign words around, so
    the model's size is that of the templates. The temperature is calibrated on notices held out, a fourth of those of
    each family that has several and of the unknown, by a model that has not seen them.
    """
    rng, names = np.random.Generator(np.random.PCG64(seed)), [*TEMPLATES, "unknown"]
    filler = ["lorem", "alpha", "river", "table", "seven", "green", "often", "walk", "north", "paper"]
    examples: list[tuple[set[str], int, int]] = []
    for k, name in enumerate(names):
        for notice, text in enumerate(TEMPLATES.get(name, UNKNOWN)):
            for copy in range(24):
                words = [w for w in text.split() if copy == 0 or rng.random() > 0.08]
                for side in range(2):
                    extra = list(rng.choice(filler, rng.integers(0, 6))) if copy % 2 else []
                    words = extra + words if side else words + extra
                examples.append((_grams(" ".join(words)), k, notice))
    examples += [({*rng.choice(filler, 6)}, len(names) - 1, 0) for _ in range(60)]
    vocabulary = sorted(set().union(*(g for g, _, _ in examples)) - set(filler))
    number = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary) + 1))
    for i, (grams, _, _) in enumerate(examples):
        own = [number[g] for g in grams if g in number]
        x[i, own] = 1.0
    x[:, -1] = 1.0
    y, notice = np.array([k for _, k, _ in examples]), np.array([n for _, _, n in examples])

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fitted(rows: np.ndarray) -> np.ndarray:
        w, goal = np.zeros((x.shape[1], len(names))), np.eye(len(names))[y[rows]]
        for _ in range(steps):
            w += 1.0 * (x[rows].T @ (goal - soft(x[rows] @ w)) / rows.sum() - l2 * w)
        return w

    held = notice % 4 == 1
    z = x[held] @ fitted(~held)
    heat = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=lambda t: -np.log(np.maximum(soft(z / t)[np.arange(held.sum()), y[held]], 1e-12)).mean())
    w = fitted(np.ones(len(y), bool))
    return {g: w[i].tolist() for g, i in number.items()}, w[-1].tolist(), heat


def telling(templates: dict[str, tuple[str, ...]]) -> dict[str, set[str]]:
    """Words of each family's templates that no other family's have: a notice of the family holds one of them."""
    own = {name: {g for t in texts for g in _grams(t) if " " not in g} for name, texts in templates.items()}
    return {name: words - set().union(*(w for other, w in own.items() if other != name)) for name, words in own.items()}


def scan(docs: DataFrame, scratch: Scratch, least_probability: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """Licenses named in each document: (doc_id, n_paragraphs, n_found, n_unknown, families, probability).

    Paragraphs of whole texts end at blank lines. Windows of 24 words, one from every 12th word, and the paragraph as a
    whole are scored by the classifier if they hold a word of needed(), without which no template could be confirmed. The family
    is confirmed if the window holds at least ``least_similarity`` of the words and word pairs of one of its
    templates, or the paragraph of one of more than 12 words, and one of the words that only this family's templates have, if
    the template has such. n_found: paragraphs with a confirmed family; n_unknown: others that hold
    one of the words RARE, so of an unknown licence, or of none. families: the confirmed ones, sorted, with commas; probability: the largest of them.

    Words and pairs meet the model, a broadcast table of fixed size, in one join; sums by window give class scores and shares
    of templates at once. Only pieces that hold a licence word are shuffled.

    Null or empty text: no paragraphs found. Repeated rows: a row each. Null doc_id: kept. Very long paragraphs are whole, in
    windows. Empty table: no rows. Other columns are ignored.
    """
    weights, intercept, heat = train()
    names, spark = [*TEMPLATES, "unknown"], scratch.spark
    known, own = [(name, _grams(t)) for name, texts in TEMPLATES.items() for t in texts], telling(TEMPLATES)
    model = [(g, w, [float(g in t) / len(t) for _, t in known], [g in t and g in own[name] for name, t in known]) for g, w in weights.items()]
    table = F.broadcast(spark.createDataFrame(model, "gram string, w array<double>, share array<double>, tells array<boolean>"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
    gate = sorted({*needed(least_similarity), *RARE})
    paragraphs = rows.select("doc_id", "body", F.posexplode(F.split(F.lower("text"), BLANK)).alias("at", "paragraph"))
    held = functools.reduce(lambda a, b: a | b, (F.contains("paragraph", F.lit(word)) for word in gate))
    paragraphs = paragraphs.where(held).dropDuplicates(["doc_id", "body", "at"])
    split = paragraphs.select("doc_id", "body", "at", F.array_remove(F.split("paragraph", WORD), "").alias("w"))
    windows = F.expr(f"transform(sequence(0, greatest(size(w) - 1, 0) div {SHORT}), i -> struct(slice(w, {SHORT} * i + 1, {2 * SHORT}) as w, false as wide))")
    pieces = F.concat(windows, F.array(F.struct(F.col("w"), F.lit(True).alias("wide"))))
    pieces = F.filter(pieces, lambda p: F.arrays_overlap(p["w"], F.array(*map(F.lit, gate))))
    found = split.select("doc_id", "body", "at", F.posexplode(pieces).alias("i", "p"))
    found = found.select("doc_id", "body", "at", "i", "p.wide", F.col("p.w").alias("w"), F.arrays_overlap("p.w", F.array(*map(F.lit, RARE))).alias("named"))
    pairs = F.expr("CASE WHEN size(w) > 1 THEN transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) ELSE array() END")
    grams = found.select("doc_id", "body", "at", "i", "wide", "named", F.explode(F.array_distinct(F.concat("w", pairs))).alias("gram"))
    sums = grams.join(table, "gram").groupBy("doc_id", "body", "at", "i", "wide", "named").agg(
        *(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(names))),
        *(F.sum(F.col("share")[t]).alias(f"s{t}") for t in range(len(known))), *(F.max(F.col("tells")[t]).alias(f"t{t}") for t in range(len(known))),
    )
    score = [F.col(f"z{k}") + intercept[k] for k in range(len(names))]
    sums = sums.withColumn("top", F.greatest(*score))
    total = functools.reduce(lambda a, b: a + b, (F.exp((z - F.col("top")) / heat) for z in score))
    family, likest = F.lit(names[-1]), F.lit(0.0)
    for k in range(len(names) - 2, -1, -1):
        fits = []
        for t, (name, grams_of) in enumerate(known):
            if name == names[k]:
                told = F.col(f"t{t}") if own[name] & grams_of else F.lit(True)
                fits.append(F.when(told if sum(" " not in g for g in grams_of) > SHORT else told & ~F.col("wide"), F.col(f"s{t}")).otherwise(0.0))
        best = score[k] == F.col("top")
        family, likest = F.when(best, names[k]).otherwise(family), F.when(best, F.greatest(*fits, F.lit(0.0))).otherwise(likest)
    judged = sums.select("doc_id", "body", "at", "named", family.alias("family"), (1 / total).alias("p"), likest.alias("likest"))
    sure = (F.col("family") != names[-1]) & (F.col("p") >= least_probability) & (F.col("likest") >= least_similarity - 1e-9)
    judged = judged.withColumn("sure", sure).where("sure or named")
    of = lambda flag: F.collect_set(F.when(F.col(flag), F.col("at")))
    per = scratch.save(judged.groupBy("doc_id", "body").agg(
        F.size(of("sure")).cast("long").alias("n_found"), F.size(F.array_except(of("named"), of("sure"))).cast("long").alias("n_unknown"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("sure"), F.col("family")))), ",").alias("families"), F.max(F.when(F.col("sure"), F.col("p"))).alias("probability"),
    ))
    every = rows.select("doc_id", "body", F.size(F.filter(F.split("text", BLANK), lambda x: x.rlike(r"\S"))).cast("long").alias("n_paragraphs"))
    none = F.lit(0).cast("long")
    return every.join(per, every.doc_id.eqNullSafe(per.doc_id) & (every.body == per.body), "left").select(
        every.doc_id, "n_paragraphs", F.coalesce("n_found", none).alias("n_found"), F.coalesce("n_unknown", none).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"), "probability"
    )
