"""Quality rules: counts per document, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, host, text (null: empty), and a hash of the text that tells repeated doc_ids apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text")).withColumn("body", F.xxhash64("text"))


def counts(rows: DataFrame) -> DataFrame:
    """+ n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), without the text."""
    has_word = lambda line: F.translate(line, SPACE_CHARS, "") != ""
    rows = rows.withColumn("w", F.array_remove(F.split("text", SPACES), "")).withColumn("l", F.filter(F.split("text", "\n"), has_word))
    rows = rows.select(
        "doc_id", "host", "body", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    # Windows as longs, hash above and position below, sort as numbers; equal neighbours are compared by words.
    rows = rows.withColumn("bits", F.length(F.bin("n_words")))
    window = "transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | cast(i as bigint))"
    rows = rows.withColumn("sorted", F.expr(f"if(n_words < 3, cast(array() as array<bigint>), sort_array({window}))"))
    rows = rows.withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    same = lambda j: f"""(shiftright(sorted[{j}], bits) = shiftright(x, bits)
        and w[cast(sorted[{j}] & mask as int)] = w[cast(x & mask as int)]
        and w[cast(sorted[{j}] & mask as int) + 1] = w[cast(x & mask as int) + 1]
        and w[cast(sorted[{j}] & mask as int) + 2] = w[cast(x & mask as int) + 2])"""  # noqa: E731
    twice = f"transform(sorted, (x, j) -> if((j > 0 and {same('j - 1')}) or (j < size(sorted) - 1 and {same('j + 1')}), x & mask, cast(null as bigint)))"
    rows = rows.withColumn("starts", F.expr(f"sort_array(array_compact({twice}))"))
    cover = "aggregate(starts, named_struct('last', -3L, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n)"
    return rows.withColumn("n_repeat_words", F.expr(cover)).drop("w", "bits", "sorted", "mask", "starts")


def normal(line: F.Column) -> F.Column:
    """Lower-case, runs of white space as one space, none around; the pattern runs only where it must."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, SPACES, " ")).otherwise(line)))


def line_rows(rows: DataFrame) -> DataFrame:
    """(host, doc_id, body, line, words): each line with a word, as the hash of its normalised form."""
    lines = rows.select("host", "doc_id", "body", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("line", normal(F.col("line"))).where("line <> ''")
    return lines.select("host", "doc_id", "body", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).cast("long").alias("words"))


def judge(docs: DataFrame, scratch: Scratch, most_documents: int = 20, least_left_percent: int = 20) -> DataFrame:
    """Counts and verdict of each document: (doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, removed_words).

    A line goes if more than ``most_documents`` distinct documents of its host (source) have it, up to
    case and white space. A document that lacks words or repeats itself (base_failed), or that keeps
    less than ``least_left_percent`` of its words, is rejected.

    Null text: empty. Null source: one host. Repeated rows are judged each and count as one document;
    rows of one doc_id with other texts count as documents of their own. Other columns are ignored.
    Empty table: no rows.
    """
    rows = keyed(docs)
    lines = line_rows(rows.dropDuplicates(["doc_id", "body", "host"]))
    common = lines.groupBy("host", "line", "doc_id", "body").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = scratch.save(common.where(F.col("n") > most_documents).select("host", "line"))
    gone = lines.join(common, ["host", "line"]).groupBy("doc_id", "body", "host").agg(F.sum("words").alias("gone"))
    base = counts(rows)
    key = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.body == b.body) & (a.host == b.host)
    gone = gone.select("doc_id", "body", "host", "gone")
    out = base.join(gone, key(base, gone), "left").select(*(base[c] for c in base.columns), F.coalesce("gone", F.lit(0)).alias("removed_words"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    depleted = (F.col("n_words") - F.col("removed_words")) * 100 < F.col("n_words") * least_left_percent
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words")


SQL = """
WITH d AS (SELECT doc_id, COALESCE(source, '') AS host, COALESCE(text, '') AS text FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x : x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
g AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t),
r AS (SELECT doc_id, COUNT(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) x GROUP BY doc_id),
ln AS (SELECT doc_id, host, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line
       FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) x),
f AS (SELECT host, line FROM ln WHERE line <> '' GROUP BY host, line HAVING COUNT(DISTINCT doc_id) > 20),
e AS (SELECT doc_id, CAST(SUM(len(string_split(line, ' '))) AS BIGINT) AS removed FROM ln JOIN f USING (host, line) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(COALESCE(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, COALESCE(removed, 0) AS removed_words
      FROM b LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - removed_words) * 100 < n_words * 20) AS kept,
  removed_words
FROM c
"""
