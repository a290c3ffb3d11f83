"""Fill-in-the-middle: texts cut at drawn units and put together as prefix, suffix and middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Any one code point.
CODE_POINT = "."


def one(unit: str) -> str:
    """The pattern of a unit; where it matches nothing, a code point is a unit, so that units cover the text."""
    return "(?s)." if unit == CODE_POINT else f"(?s)(?:{unit}|.)"


def many(unit: str, run: int) -> str:
    """Up to so many units, the same ones: a possessive repeat takes no match back."""
    return f"{one(unit)}{{1,{run}}}+"


def draw(doc_id: Column, seed: int, which: int) -> Column:
    """The so-manyth group of 8 digits of the hex SHA-256 of ``seed:doc_id``, unsigned."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """+ id, hash: what tells different documents apart; rows equal in both are cut alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "hash": F.xxhash64("text")})


def runs(texts: DataFrame, unit: str, run: int, scratch: Scratch) -> DataFrame:
    """(id, hash, units, chars, units_before, chars_before): the matches of each text in order, up to ``run`` units a row.

    Texts don't travel, only lengths do. Copies of a row meet in the first, partial aggregate. The sums of a
    text are a window over its runs, a 256th of its units, so that a text of a billion units is 4 million rows.
    """
    lengths = F.transform(
        F.regexp_extract_all("text", F.lit(many(unit, run)), F.lit(0)),
        lambda x: F.struct(F.regexp_count(x, F.lit(one(unit))).alias("units"), F.char_length(x).alias("chars")),
    )
    found = texts.select("id", "hash", F.posexplode(lengths).alias("at", "run"))
    found = found.groupBy("id", "hash", "at").agg(F.max("run.units").cast("long").alias("units"), F.max("run.chars").cast("long").alias("chars"))
    sums = "SUM({0}) OVER (PARTITION BY id, hash ORDER BY at) - {0} AS {0}_before"
    return scratch.save(found.select("id", "hash", "units", "chars", F.expr(sums.format("units")), F.expr(sums.format("chars"))))


def cuts(placed: DataFrame, seed: int) -> DataFrame:
    """(id, hash, n, low, high): units of each text, and where its two cuts fall: each a run and the units of it before the cut.

    A cut request is (text, place, ordinal of the last unit before the cut) and is joined with the run that
    holds this ordinal; requests for ordinal 0 meet no run, their cut is the text's beginning.
    """
    texts = placed.groupBy("id", "hash").agg(F.sum("units").alias("n"))
    ends = F.array_sort(F.array(*(F.pmod(draw(F.col("id"), seed, k), F.col("n") + 1) for k in (0, 1))))
    requests = texts.select("id", "hash", "n", F.posexplode(ends).alias("place", "ordinal"))
    held = (F.col("ordinal") > F.col("units_before")) & (F.col("ordinal") <= F.col("units_before") + F.col("units"))
    r, p = requests.alias("r"), placed.alias("p")
    met = r.join(p, (F.col("r.id") == F.col("p.id")) & (F.col("r.hash") == F.col("p.hash")) & held)
    where = F.struct("chars_before", "chars", (F.col("ordinal") - F.col("units_before")).alias("left"))
    offsets = met.groupBy("r.id", "r.hash").agg(*(F.max(F.when(F.col("place") == k, where)).alias(name) for k, name in enumerate(("low", "high"))))
    return texts.join(offsets, ["id", "hash"], "left")


def offset(text: Column, cut: Column, unit: str) -> Column:
    """Code points of the text before a cut."""
    units = F.slice(F.regexp_extract_all(F.substring(text, cut.chars_before.cast("int") + 1, cut.chars.cast("int")), F.lit(one(unit)), F.lit(0)), 1, cut.left.cast("int"))
    inside = F.aggregate(units, F.lit(0), lambda n, x: n + F.char_length(x))
    return F.coalesce(cut.chars_before.cast("int") + inside, F.lit(0))


def transform(docs: DataFrame, scratch: Scratch, unit: str = CODE_POINT, seed: int = 1, plain_from: int = 90, spm_below: int = 20, run: int = 256) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs (doc_id, text).

    A text is n units, matches of a pattern from left to right. The prefix ends after the smaller of two drawn
    numbers of units, the middle after the larger. All draws are digits of a hash of seed and doc_id, so a row
    comes out alike wherever and however often it is computed. Plain texts stay as they are: empty
    ones, those that hold a mark, and those whose third draw is ``plain_from`` or more of 100; the others
    are spm if the fourth is below ``spm_below``, else psm.

    Null text counts as empty, an empty text has 0 units and is plain. A null doc_id is drawn for as an
    empty string. Repeated rows stay as many; rows that share a doc_id but not the text are cut each by
    itself. Texts of any length are whole. An empty table gives no rows. Other columns are not looked at.
    """
    texts = keyed(docs)
    found = cuts(runs(texts, unit, run, scratch), seed)
    got = texts.join(found, ["id", "hash"], "left")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (draw(F.col("id"), seed, 2) % 100 >= plain_from)
    got = got.select(
        "doc_id", "text", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(plain, "plain").when(draw(F.col("id"), seed, 3) % 100 < spm_below, "spm").otherwise("psm").alias("form"),
        *(F.when(~plain, offset(F.col("text"), F.col(c), unit)).alias(c) for c in ("low", "high")),
    )
    prefix, middle, suffix = F.expr("substring(text, 1, low)"), F.expr("substring(text, low + 1, high - low)"), F.expr("substring(text, high + 1)")
    p, s, m = map(F.lit, MARKS)
    put = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    return got.select("doc_id", "n", "form", F.col("low").cast("long").alias("prefix_chars"), (F.col("high") - F.col("low")).cast("long").alias("middle_chars"), put.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that transform() made an output from: texts in these forms hold no mark, so each mark stands once."""
    p, s, m = MARKS
    after = lambda mark: F.substring_index(output, mark, -1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    psm = F.concat(before(after(p), s), after(m), before(after(s), m))
    spm = F.concat(before(after(p), m), after(m), before(after(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = """
    WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, length(COALESCE(text, '')) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, substring(text, 1, low) AS a, substring(text, low + 1, high - low) AS b, substring(text, high + 1) AS z FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM p
"""
