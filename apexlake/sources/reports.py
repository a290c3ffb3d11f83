"""Coaching reports and reference texts read back as tables, joined and averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.functions.advice import strip

#: Where a section of a turn begins, and what stands before its advice.
SECTION = r"(?s)### Turn (\d+)(.*?)(?=### Turn \d|\z)"
HEAD = "**AI-Personalized Coaching Advice**"
#: Titles inside the advice that are no issues.
TITLES = ("actionable recommendations", "analysis")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, content): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("report"), F.col("value").alias("content"))


def blocks(text: Column) -> Column:
    """An array of (title, body) of a text: a line that ends in a bold title with a colon, an empty line, and what follows.

    A body ends before a line that begins with such a title, whatever follows it, before a rule, or with the text.
    Titles inside a body's lines begin nothing.
    """
    lines = F.split(text, "\n")
    pairs = F.zip_with(lines, F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("end"))), lambda line, after: F.struct(line.alias("line"), (strip(after) == "").alias("blank")))
    start = F.struct(F.array().cast("array<struct<title: string, body: string>>").alias("done"), F.lit(None).cast("string").alias("title"), F.lit("").alias("body"))
    closed = lambda state: F.when(state["title"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(state["title"].alias("title"), state["body"].alias("body")))))

    def step(state: Column, pair: Column) -> Column:
        line = pair["line"]
        ends = strip(line).rlike(r"^(\*\*[^*]*:|---)")
        opens = line.rlike(r"\*\*[^*]+:\*\*\s*$") & pair["blank"] & (state["title"].isNull() | ends)
        fresh = F.struct(closed(state).alias("done"), F.regexp_extract(line, r"\*\*([^*]+):\*\*\s*$", 1).alias("title"), F.lit("").alias("body"))
        over = F.struct(closed(state).alias("done"), F.lit(None).cast("string").alias("title"), F.lit("").alias("body"))
        more = F.struct(state["done"].alias("done"), state["title"].alias("title"), F.concat(state["body"], F.lit("\n"), line).alias("body"))
        return F.when(opens, fresh).when(ends, over).when(state["title"].isNotNull(), more).otherwise(state)

    return F.aggregate(pairs, start, step, closed)


def advice(reports: DataFrame) -> DataFrame:
    """(report, turn, issue, text): the advice to each issue of each turn of Markdown reports.

    Of several sections of a turn the last that has advice counts, of several texts to an issue the last.
    Sections without advice and empty texts are left out; null reports have none.
    """
    sections = F.arrays_zip(*(F.regexp_extract_all("content", F.lit(SECTION), F.lit(g)).alias(n) for g, n in ((1, "turn"), (2, "body"))))
    rows = reports.select("report", F.posexplode(sections).alias("at", "s")).where(F.contains("s.body", F.lit(HEAD)))
    rows = rows.select("report", "at", F.col("s.turn").cast("int").alias("turn"), F.substring_index(F.substring_index("s.body", HEAD, 2), HEAD, -1).alias("body"))
    rows = rows.withColumn("last", F.max("at").over(W.partitionBy("report", "turn"))).where("at = last")
    rows = rows.select("report", "turn", F.posexplode(blocks(F.col("body"))).alias("i", "b"))
    rows = rows.select("report", "turn", "i", strip(F.col("b.title")).alias("issue"), strip(F.regexp_replace(strip(F.col("b.body")), "\n{3,}", "\n\n")).alias("text"))
    rows = rows.where(~F.lower("issue").isin(*TITLES) & (F.col("text") != ""))
    return rows.groupBy("report", "turn", "issue").agg(F.max_by("text", "i").alias("text"))


def save_evaluation(rows: DataFrame, root: str, key: str = "model", lengths: tuple[str, ...] = (), scores: tuple[str, ...] = ()) -> None:
    """Writes an evaluation as delimited files: a folder for each model, all rows together, and the means, these in Markdown too."""
    put = lambda df: df.write.mode("overwrite").option("header", True)
    put(rows).partitionBy(key).csv(f"{root}/models")
    put(rows).csv(f"{root}/all")
    summary = means(rows, key, lengths, scores).orderBy(key).coalesce(1)
    put(summary).csv(f"{root}/summary")
    names = summary.columns
    line = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), " | "), F.lit(" |"))
    head = summary.sparkSession.createDataFrame([(0, f"| {' | '.join(names)} |"), (1, f"|{'---|' * len(names)}")], "i int, value string")
    body = summary.select((F.row_number().over(W.orderBy(key)) + 1).alias("i"), line.alias("value"))  # a row for each model
    head.unionByName(body).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{root}/summary_markdown")


def references(lines: DataFrame, order: str = "rid") -> DataFrame:
    """(turn, issue, reference, order) of lines of JSON in column value.

    The text is gold_content, or else reference, or else the words of gold_sections; lists are joined by an
    empty line. Lines that are no JSON or lack a turn, an issue or a text are left out.
    """
    get = lambda name: F.get_json_object("value", f"$.{name}")
    some = lambda c: F.when((c != "") & (c != "[]"), c)
    whole = lambda c, by: F.coalesce(F.array_join(F.from_json(c, "array<string>"), by), c)
    text = F.coalesce(whole(some(get("gold_content")), "\n\n"), some(get("reference")), whole(some(get("gold_sections")), " "))
    rows = lines.select(get("turn").try_cast("int").alias("turn"), get("issue_name").alias("issue"), text.alias("reference"), order)
    return rows.where("turn is not null and issue <> '' and reference is not null")


def matched(generated: DataFrame, gold: DataFrame, order: str = "rid") -> DataFrame:
    """Advice with the first reference of its turn and issue, where there is one that is not empty."""
    first = gold.groupBy("turn", "issue").agg(F.min_by("reference", order).alias("reference"))
    return generated.join(first, ["turn", "issue"]).where("text <> '' and reference <> ''")


def means(rows: DataFrame, key: str, lengths: tuple[str, ...], scores: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, a mean for each column as text): lengths with one decimal, scores with four, N/A without values."""
    shown = lambda c, digits: F.coalesce(F.format_string(f"%.{digits}f", F.avg(c)), F.lit("N/A")).alias(c)
    some = lambda c, digits: F.when(F.count(c) > 0, shown(c, digits)).otherwise("N/A").alias(c)
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(some(c, 1) for c in lengths), *(some(c, 4) for c in scores))
