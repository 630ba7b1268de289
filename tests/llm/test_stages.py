"""Stages of the pipeline on rows made up for one rule each."""

import brute
import duckdb

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from millwatch.llm import decontamination, line_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
near_copies = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_near_copies_share_80_percent_of_five_word_shingles(spark):
    words = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("e" if i in at else w for i, w in enumerate(words))
    rows = [(1, edited()), (2, edited(30, 60)), (3, edited(20, 40, 60)), (4, edited(0, 1, 2))]  # 86 of 106 five-word shingles, 89 of 105 four-word ones
    rows += [(i + 10, t) for i, t in duckdb.sql(f"select doc_id, text from '{SF.replace('0.001', '0.01')}/documents.parquet'").fetchall()]
    want = {d for d, (_, c) in brute.components(rows, 80, 5).items() if c == d}
    assert 1 in want and 2 not in want
    assert {r.doc_id for r in near_copies(spark, frame(spark, rows), SF).collect()} == want


def test_near_copies_with_repeated_and_missing_ids(spark):
    text = lambda name, *at: " ".join("e" if i in at else f"{name}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a", 30)), (2, text("b")), (None, text("a", 0)), (None, text("a", 59)), (None, text("b", 0)),
            (None, text("c")), (None, text("c", 0)), (None, text("c", 0)), (None, text("d")), (None, None), (None, ""), (3, None)]
    got = [(r.doc_id, r.text) for r in near_copies(spark, frame(spark, rows), SF).collect()]
    alone = [r for r in rows if r[1] in (text("c"), text("c", 0))]
    third = [r for r in got if r in alone]
    assert third in ([(None, text("c"))], [(None, text("c", 0))] * 2)  # copies of one text without an id are one document
    assert sorted(map(str, (r for r in got if r not in alone))) == sorted(map(str, [
        (1, text("a")), (2, text("b")), (None, text("d")), (None, None), (None, ""), (3, None)]))


# Every name that an operator or a stage gives to a column of its own, and odd ones.
OWN = ["n_hit", "n_words", "items", "n_items", "contaminated", "_doc", "_hash", "_found", "_words", "_key", "_true", "_lines", "_kept", "_drop",
       "n_lines", "n_removed", "score", "_gone", "_sign", "sign", "_id", "_text", "_label", "share", "id", "line", "site", "columns_beside",
       "extra_columns", "n_hit_of_table", "a.b", "c`d"]


def with_own_names(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in OWN])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_columns_with_the_names_of_a_stage_pass_unchanged(spark, name):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, with_own_names(plain), SF)
    assert got.columns == [*plain.columns, *OWN]
    rows = [r for r in got.collect()]
    assert all(r[len(plain.columns) + i] == f"{c} {r.doc_id}" for r in rows for i, c in enumerate(OWN))
    assert sorted(tuple(r)[:len(plain.columns)] for r in rows) == sorted(map(tuple, stage(spark, plain, SF).collect()))


def test_the_last_stage_looks_at_its_own_columns_only(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    wide = with_own_names(plain).withColumns({c: F.lit("x") for c in ("size", "target", "taken", "source_size", "hash", "passes")})
    assert sorted(map(tuple, corpus_pipeline.mix_sources(spark, wide, SF).collect())) == sorted(
        map(tuple, corpus_pipeline.mix_sources(spark, plain, SF).collect()))


@pytest.mark.parametrize("operator, results", [
    (lambda spark, docs: decontamination.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")),
     ["n_words", "n_hit", "items", "n_items", "contaminated"]),
    (lambda spark, docs: line_dedup.dedup_lines(docs), ["n_lines", "n_removed"])])
def test_columns_with_the_names_of_results_come_back_beside_them(spark, operator, results):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    out = operator(spark, with_own_names(plain))
    again = {c: f"{c}_of_table" for c in results}
    again["n_hit"] = "n_hit_of_table_of_table" if "n_hit" in results else None
    names = [*plain.columns, *[again.get(c) or c for c in OWN], *results]
    assert out.columns == names
    want = sorted(map(tuple, operator(spark, plain).collect()))
    rows = out.collect()
    n = len(plain.columns)
    assert all(r[n + i] == f"{c} {r.doc_id}" for r in rows for i, c in enumerate(OWN))
    assert sorted((*tuple(r)[:n], *tuple(r)[n + len(OWN):]) for r in rows) == want
