"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licenses, lines, middle, neighbours, packing, quality, rules, toxicity, trie, urls, warc
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.last(packing.pack(table(spark, sf_dir, "documents"), scratch, tokenizer_file()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.last(quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.last(toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = warc.archive(table(spark, sf_dir, "pages"), scratch, scratch.path(), payload=False)
    return found.select(
        F.col("metadata.page_id").alias("page_id"),
        *(F.col(f"response.{c}").alias(c) for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")),
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), Scratch(spark))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), Scratch(spark))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), Scratch(spark))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark).last(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), Scratch(spark), least_words=1)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), Scratch(spark))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.last(trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations"), scratch), scratch))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"), Scratch(spark))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.last(neighbours.search(table(spark, sf_dir, "embeddings"), scratch))


QUERIES = {"op6_jaccard": op6_jaccard, "op1_decontamination": op1_decontamination, "op8_lines": op8_lines, "op2_rules": op2_rules, "op7_licenses": op7_licenses, "op4_warc": op4_warc, "op5_urls": op5_urls, "op3_toxicity": op3_toxicity, "op9_quality": op9_quality, "op10_packing": op10_packing, "op11_trie": op11_trie, "op12_middle": op12_middle, "op13_neighbours": op13_neighbours}

ORACLES: dict[str, str] = {
    "op2_rules": rules.SQL,
    "op11_trie": trie.SQL,
    "op12_middle": middle.SQL,
    "op4_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, MIN(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, payload_bytes, payload_digest,
          CASE WHEN first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first < d.page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
}
