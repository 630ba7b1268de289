"""The registered queries of the operators, each over its whole table, and their SQL."""

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm import (
    conversation_repair, decontamination, line_dedup, mixing, ngram_jaccard, periodic_runs, quality_classifier, quality_rules,
    sentencepiece_codec, substring_dedup, suffix_dedup, toxicity, url_filters,
)
from millwatch.llm.text import blank_words

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = decontamination.find_contamination(_documents(spark, sf).select("doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_documents(spark, sf))


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf), _labels(spark, sf))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf), _labels(spark, sf))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.filter_urls(
        spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"),
        _labels(spark, sf), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.dedup_passages(_documents(spark, sf))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf)).drop("source")


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(_documents(spark, sf))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_sentencepiece(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    model = Path(path or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    out = sentencepiece_codec.encode_texts(_documents(spark, sf), model)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.col("ends").cast("array<string>"), ","), 256).alias("ends_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that op12 has to find: chosen by a checksum of conversation and turn."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    hurt = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), hurt.alias("text"), F.explode(copies).alias("_")).drop("_")


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    done = conversation_repair.repair(damaged(rows))
    hashes = conversation_repair.digests(done.rows).withColumnRenamed("conv", "conv_of")
    found = done.summary.join(hashes, F.col("conv").eqNullSafe(F.col("conv_of")), "left")
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """Every tenth text, by a checksum of its id, becomes periodic from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    parts = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, blank_words(F.col("text"))).alias("w"))
    parts = parts.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> if(i < a, w[int(i)], w[int(a + (i - a) % p)])), ' ')")
    return parts.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = periodic_runs.find_runs(with_planted_run(_documents(spark, sf)))
    # Runs come by start, so the first of equal exponents stays.
    top = F.aggregate("runs", F.lit(None).cast(periodic_runs.RUNS.elementType), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "kept").select(
        "doc_id", "n_runs", *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
