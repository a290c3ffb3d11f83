"""URL filters: host and path rules, then naive Bayes over words that a Viterbi splits host names into."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Pieces of host names that mark a url as unwanted, for the labels that the classifier learns from.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "malware", "phish", "pills", "poker", "porn", "slots", "spam", "sex", "track", "tracker", "win", "xxx")


def parts(pages: DataFrame) -> DataFrame:
    """+ host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    url = F.col("url").cast("string")
    return pages.select(
        "page_id",
        F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )


def ruled(rules: Sequence[tuple[str, str]], what: str) -> F.Column:
    """Verdict or text of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits &= F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(verdict if what == "verdict" else rule)).otherwise(out)
    return out


def split_name(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name into words; an unknown piece costs ``unknown`` and more by its letters."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        choice = min((best[at] + cost.get(name[at:end], unknown + 2.5 * (end - at)), at) for at in range(end))
        best.append(choice[0])
        back.append(choice[1])
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segments(labels: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, words): the words of each distinct host label, by a unigram model counted over all of texts."""
    pieces = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    pieces = pieces.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("label") - F.col("at") + 1), lambda n: F.substring("label", F.col("at"), n))).alias("word"))
    pieces = scratch.save(pieces.distinct())
    wanted = scratch.save(pieces.select("word").distinct())
    words = texts.select(F.explode(F.split(F.lower(F.regexp_replace(F.col("text").cast("string"), "<[^>]*>", " ")), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")
    counts = scratch.save(words.join(wanted, "word").groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    known = pieces.join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("counts"))

    @F.pandas_udf("array<string>")
    def viterbi(label: pd.Series, counts: pd.Series) -> pd.Series:
        unknown = math.log(total) + 2.5
        return pd.Series([split_name(x, {w: math.log(total / n) for w, n in (c or {}).items()}, unknown) for x, c in zip(label, counts)])

    return labels.join(known, "label", "left").select("label", viterbi("label", F.col("counts")).alias("words"))


def judge(pages: DataFrame, scratch: Scratch, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """Verdict on each url: (page_id, host, path, rule, verdict, log_odds).

    The longest fitting rule decides; a rule fits its host and all subdomains. Elsewhere multinomial
    naive Bayes decides over the words of host and path, those of host names split by Viterbi under word
    counts of all pages. It learns from all urls; one counts as unwanted if a piece of its host between
    dots and hyphens is among ``seeds``. Numbers in paths count as one word.

    Null url, or without ``://``: empty host and path, no words, so the verdict of the prior. Null html
    adds no words. Repeated rows are judged each. Empty table: no rows. Other columns are ignored.
    """
    urls = parts(pages)
    hosts = urls.groupBy("host").agg(F.count("*").alias("n"))
    hosts = scratch.save(hosts.withColumn("labels", F.array_remove(F.split("host", "[^a-z0-9\u0080-\U0010ffff]+"), "")).withColumn("bad", F.arrays_overlap("labels", F.array(*map(F.lit, seeds)))))
    labels = scratch.save(hosts.select(F.explode("labels").alias("label")).distinct())
    split = scratch.save(segments(labels, pages.select(F.col("html").alias("text")), scratch))
    host_words = scratch.save(hosts.select("host", "n", "bad", F.explode("labels").alias("label")).join(split, "label").select("host", "n", "bad", F.explode("words").alias("word")))
    shape = F.array_remove(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), "[^a-z0-9\u0080-\U0010ffff]+"), "")
    paths = urls.select("host", F.array_join(shape, "/").alias("shape")).groupBy("host", "shape").agg(F.count("*").alias("n"))
    paths = scratch.save(paths.join(hosts.select("host", "bad"), "host"))
    path_words = paths.select("shape", "bad", "n", F.explode(F.split("shape", "/")).alias("word")).where("word <> ''")

    def weights(words: DataFrame) -> DataFrame:
        return words.groupBy("word").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g"))

    table = weights(host_words.select(F.concat(F.lit("host:"), "word").alias("word"), "bad", "n").unionByName(path_words.select(F.concat(F.lit("path:"), "word").alias("word"), "bad", "n")))
    table = scratch.save(table)
    b, g, v = table.agg(F.sum("b"), F.sum("g"), F.count("*")).first()
    b, g = (b or 0) + v + 1, (g or 0) + v + 1
    odds = scratch.save(table.select("word", (F.log((F.col("b") + 1) / F.lit(float(b))) - F.log((F.col("g") + 1) / F.lit(float(g)))).alias("w")))
    bad, all_ = hosts.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum("n")).first()
    prior = math.log(((bad or 0) + 1) / ((all_ or 0) - (bad or 0) + 1))
    of_host = host_words.select("host", F.concat(F.lit("host:"), "word").alias("word")).join(odds, "word").groupBy("host").agg(F.sum("w").alias("h"))
    shapes = paths.select("shape").distinct()
    of_shape = shapes.select("shape", F.explode(F.transform(F.split("shape", "/"), lambda w: F.concat(F.lit("path:"), w))).alias("word")).join(odds, "word").groupBy("shape").agg(F.sum("w").alias("p"))
    of_host, of_shape = scratch.save(of_host), scratch.save(of_shape)
    out = urls.withColumn("shape", F.array_join(shape, "/")).join(of_host, "host", "left").join(of_shape, "shape", "left")
    out = out.withColumn("log_odds", F.lit(prior) + F.coalesce("h", F.lit(0.0)) + F.coalesce("p", F.lit(0.0)))
    verdict = F.coalesce(ruled(rules, "verdict"), F.when(F.col("log_odds") >= 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", ruled(rules, "rule").alias("rule"), verdict.alias("verdict"), "log_odds")
