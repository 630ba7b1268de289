"""The exact operators against brute force: on a whole small table and on made-up rows."""

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from millwatch.llm import decontamination, exchange, line_dedup, ngram_jaccard, queries, substring_dedup, suffix_dedup

DOCS = "doc_id bigint, text string, source string, lang string"


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def rows_of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out.setdefault(d.pop(key), []).append(tuple(d.values()))
    return out


def one(df, key="doc_id"):
    found = rows_of(df, key)
    assert all(len(v) == 1 for v in found.values())
    return {k: v[0] for k, v in found.items()}


def made_up(seed=5, n=120):
    """Short vocabularies, copies, near copies, shared passages, one very long text, odd spaces."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["The", "of", "é", "aß", "x1", "it's", "ZÜ", "run", "a-b", "|"]) + rnd.choice(["", "", "n", "q.", "t"])
    texts = [" ".join(word() for _ in range(rnd.choice([0, 1, 3, 5, 30, 120]))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"w{i}" for i in range(100)]
    for i in range(0, n, 5):
        texts[i] = texts[i] + "\n " + passage + "\t" + texts[i + 1]
    for i in range(1, n, 6):
        edited = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            edited[rnd.randrange(100)] = f"e{rnd.randrange(10 ** 6)}"
        texts[i] = "\n".join(" ".join(edited[j:j + 9]) for j in range(0, 100, 9))
    texts[2], texts[3], texts[4] = "", "   \n\t", "one two"
    texts.append(" ".join(f"w{rnd.randrange(2000)}" for _ in range(30000)) + " " + passage * 3)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


ITEMS = [(7, "p3 p4 P5 p6 p7 p8 p9 p10 p11 p12 p13 p14"), (30, "one, two"), (4, None), (5, ""), (7, "the OF é"), (None, "run run"),
         (12, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 zzz")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 4}", "en") for i, t in rows], DOCS)


@pytest.mark.parametrize("name, reference", [
    ("op1_decontamination", "contamination"), ("op2_ngram_jaccard", "components"),
    ("op8_substring_dedup", "passages"), ("op10_suffix_dedup", "byte_strings"),
])
def test_query_on_the_whole_table(spark, table, name, reference):
    args = [table]
    if reference == "contamination":
        args.append(duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
    assert one(queries.QUERIES[name](spark, SF)) == getattr(brute, reference)(*args)


@pytest.mark.parametrize("seed", [5, 6])
def test_made_up_documents(spark, seed, monkeypatch):
    rows = made_up(seed)
    monkeypatch.setattr(exchange, "UNIT_HASHES", 4000)  # several units a task
    docs = frame(spark, rows).repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.find_contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert one(got) == brute.contamination(rows, ITEMS)
    assert one(ngram_jaccard.jaccard_components(docs)) == brute.components(rows)
    got = substring_dedup.dedup_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert one(got) == brute.passages(rows)
    got = suffix_dedup.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert one(got) == brute.byte_strings(rows)


@pytest.mark.parametrize("boundary", [1, 30, 10 ** 9])
def test_any_boundary_gives_the_same_components(spark, boundary, monkeypatch):
    rows = made_up(9, 90)
    monkeypatch.setattr(ngram_jaccard, "choose_boundary", lambda nodes: boundary)
    assert one(ngram_jaccard.jaccard_components(frame(spark, rows))) == brute.components(rows)


def test_chain_of_links_is_one_component(spark):
    """Neighbours link, ends do not; no text is central."""
    base = [f"w{i}" for i in range(160)]
    rows = [(100 - k, " ".join(base[5 * k:5 * k + 100])) for k in range(12)]
    assert one(ngram_jaccard.jaccard_components(frame(spark, rows))) == brute.components(rows)
    assert len({c for _, c in brute.components(rows).values()}) == 1


def test_lines(spark):
    rows = [(1, "Top line\na b c\nown 1", "s1"), (2, " Top line \n\nown 2\nTop line", "s2"), (3, "Top line", "s3"), (4, "Top line\nx", None),
            (5, None, "s1"), (6, "", "s2"), (7, "a b c\nown 7", "s1"), (8, "a b c", "s2"), (9, "   \nTop line", "s3")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    for limit in (2, 3, 4, 5):
        got = line_dedup.dedup_lines(docs, min_sites=limit).select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")))
        assert one(got) == brute.boilerplate(rows, limit)


def test_line_query_on_the_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    want = {d: (n, gone, brute.sha(text)) for d, (n, gone, text) in brute.boilerplate(rows, 10).items()}
    assert one(queries.QUERIES["op6_line_dedup"](spark, SF)) == want


ODD = [(None, "w1 w2 w3 w4 w5 w6"), (1, None), (2, ""), (3, "x"), (4, "same text here for all"), (4, "same text here for all"),
       (5, "same text here for all"), (None, None)]


@pytest.mark.parametrize("run", [
    lambda d, items: decontamination.find_contamination(d, items),
    lambda d, items: ngram_jaccard.jaccard_components(d),
    lambda d, items: substring_dedup.dedup_passages(d),
    lambda d, items: suffix_dedup.dedup_bytes(d),
    lambda d, items: line_dedup.dedup_lines(d, min_sites=2),
])
def test_odd_rows_and_empty_tables(spark, run):
    items = spark.createDataFrame([(1, "w2 w3")], "item_id bigint, text string")
    docs = frame(spark, ODD).withColumns({"hashes": F.lit(1), "share": F.lit("x"), "node": F.lit(2), "phrase": F.lit("p"), "line": F.lit(0)})
    found = rows_of(run(docs, items))
    assert {k: len(v) for k, v in found.items()} == {None: 2, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1}
    assert len(set(map(str, found[4]))) == 1
    assert rows_of(run(docs.limit(0), items)) == {}


def test_no_benchmark_no_hits(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    got = decontamination.find_contamination(frame(spark, ODD), items)
    assert got.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and got.count() == len(ODD)


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta y gamma"), (2, "gamma " + "z " * 30 + "alpha beta"), (3, "beta alpha gamma gamma"), (4, "alpha beta")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    phrases = decontamination.test_phrases(items)
    vocabulary = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    index = decontamination.build_index(docs, vocabulary)
    near = decontamination.proximity_matches(index, decontamination.rarest_terms(phrases, index), 5)
    assert {r["doc"] for r in near.collect()} == {1, 3}
