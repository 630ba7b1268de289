"""Rules, classifiers, URL filters, mixing and the pipeline; and the queries that have SQL."""

import itertools
import random
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, difference
from conftest import SF
from millwatch.llm import boosting, mixing, packed, quality_classifier, quality_rules, queries, suffix_array, toxicity, url_filters
from millwatch.llm.oracle import SQL

MORE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


# -- quality rules ----------------------------------------------------------------------------------


def test_rule_counts_on_the_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = queries.QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(got) == len(rows)
    want = {d: brute.quality_counts(t) for d, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_rule_counts_of_odd_texts(spark):
    texts = [None, "", " \n", "a b c d e a b c d e", "x " * 30, "l1 w\nl1 w\n\n\nl1 w ", "é|ü#*  $%&<>", "one\x0btwo\x0cthree\x1cfour\u00a0five",
             "a b c d e f a b c d e g b c d e f"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lines int")
    got = {r.doc_id: r for r in quality_rules.document_counts(docs).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeated, _ = brute.quality_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated), t
    assert quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.judge(docs.union(docs)).count() == 2 * len(texts)


def test_em_finds_the_reliable_rules():
    rnd = random.Random(1)
    seen = Counter()
    truth = defaultdict(list)
    for _ in range(20000):
        good = rnd.random() < 0.85
        votes = tuple((2 if good else 0) if rnd.random() < accuracy else rnd.choice([0, 1, 2]) for accuracy in (0.95, 0.9, 0.9, 0.1))
        seen[votes] += 1
        truth[votes].append(good)
    post = quality_rules.estimate(sorted(seen.items()))
    right = sum((post[v] >= 0.5) == g for v, gs in truth.items() for g in gs)
    assert right > 0.95 * 20000
    assert quality_rules.estimate([]) == {}


def test_rules_keep_what_labels_call_good(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    got = queries.QUERIES["op5_quality_rules"](spark, MORE).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in got.collect()}
    assert n.get((1, False), 0) < 0.02 * n[1, True]
    assert n.get((0, True), 0) < 0.1 * n[0, False]


# -- classifiers ------------------------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(label)[order]
    rank = np.searchsorted(s, s, side="left") + (np.searchsorted(s, s, side="right") - np.searchsorted(s, s, side="left") + 1) / 2
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("name, label, folds, held, cut, least", [
    # a few texts of this small table are labelled toxic without any toxic word, which bounds the second area
    ("op3_quality_classifier", "quality", 5, 0, 0.3, 0.97), ("op4_toxicity", "toxic", 3, 1, 0.7, 0.94)])
def test_classifier_on_held_out_labels(spark, name, label, folds, held, cut, least):
    rows = queries.QUERIES[name](spark, MORE).join(spark.read.parquet(f"{MORE}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (brute.fold(r.doc_id, folds) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    out = [r for r in rows if r.held_out]
    assert auc([r.score for r in out], [r[label] for r in out]) > least
    assert np.mean([r.predicted == r[label] for r in out]) > 0.97


@pytest.mark.parametrize("classify", [quality_classifier.classify, toxicity.classify])
def test_classifiers_take_odd_rows(spark, classify):
    docs = spark.createDataFrame([(None, "x y"), (1, None), (2, ""), (3, "you idiot " * 5), (3, "you idiot " * 5), (4, "fine words here")],
                                 "doc_id bigint, text string").withColumns({"score": F.lit("s"), "_text": F.lit(0)})
    labels = spark.createDataFrame([(3, 0, 1), (3, 1, 0), (4, 1, 0), (None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = classify(docs, labels)
    assert got.count() == 6 and got.filter("score is null or held_out is null or score < 0 or score > 1").count() == 0
    assert got.filter("doc_id = 3").distinct().count() == 1
    assert classify(docs, labels.limit(0)).count() == 6
    assert classify(docs.limit(0), labels).count() == 0


def test_additive_model_is_a_sum_of_tables():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair can tell
    model = boosting.fit_additive(x, y)
    assert {tuple(sorted(g[:2])) for g in model["grids"][:1]} == {(0, 1)}
    assert np.mean((boosting.score_additive(model, x) > 0.5) == y) > 0.95


def test_isotonic_steps_rise():
    upper, share = boosting.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(upper) > 0).all() and (np.diff(share) >= 0).all()


# -- urls -------------------------------------------------------------------------------------------


def test_urls_by_hand_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://xexample.org/en/1", "ftp://com/fr/",
            "x://a.com/fr", "x://a.com/de/?q", "http://h?p/q", "http://h#f", "http://b.org", "a://b://c.org/en/1", "http://c.COM/de/1\n2"]
    rules = queries.URL_RULES
    pages = spark.createDataFrame([(i, u, "w") for i, u in enumerate(urls + urls)], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = url_filters.filter_urls(pages.drop("host"), none, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        url = urls[r.page_id % len(urls)] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(brute.UPPER)
        path = rest[cut:min([rest.find(c, cut) for c in "?#" if c in rest[cut:]], default=len(rest))]
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[1])
    assert url_filters.filter_urls(pages.limit(0).drop("host"), none, rules).count() == 0


def test_mined_rules_against_all_combinations(spark):
    rnd = random.Random(3)
    sites = ["a.example.net", "bets.example.net", "b.shop.net"]
    rows = []
    for i in range(400):
        host, part = rnd.choice(sites), rnd.choice(["news", "win", "win/free", "x1"])
        low = (host == sites[1] and "win" in part) or rnd.random() < 0.1
        rows.append((i, f"http://{host}/{part}/{i}", 0 if low else 1))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 4], "doc_id bigint, quality int")
    support, confidence, least = 0.02, 0.6, 10
    tokens = lambda u: {f"host:{x}" for x in u.split("/")[2].split(".")} | {f"part:{x}" for x in u.split("/")[3:] if not x.isdigit()}
    known = [(tokens(u), q == 0) for i, u, q in rows if i % 4]
    need = max(support, least / len(known)) * len(known)
    names = sorted(set().union(*(t for t, _ in known)))
    rules = []
    for k in range(1, 7):
        for combination in itertools.combinations(names, k):
            hit = [low for t, low in known if t.issuperset(combination)]
            if sum(hit) >= need and sum(hit) >= confidence * len(hit):
                rules.append(set(combination))
    got = url_filters.filter_urls(pages, labels, [], min_support=support, min_confidence=confidence, min_pages=least).collect()
    assert rules and {r.page_id: r.verdict for r in got} == {
        i: "block" if any(rule <= tokens(u) for rule in rules) else "allow" for i, u, _ in rows}


# -- mixing -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets_and_sums(spark, seed):
    rnd = random.Random(seed)
    names = [None, "B", "a", "é", "zz", ""][:rnd.randrange(1, 7)] if seed else [None]
    rows = [(i if rnd.random() < 0.98 else None, "w " * rnd.choice([0, 1, 5, 40, 900 if seed == 2 else 60]), rnd.choice(names)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit("x"), "hash": F.lit(1)})
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute.mix_targets(sizes)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + max([r.size for r in got if r.source == s], default=0) * (1 + sum(r.doc_id is None for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_hits_targets_closely(spark):
    got = queries.QUERIES["op9_mixing"](spark, MORE).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= r.largest for r in got)


# -- arrays -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_common_prefixes(seed):
    rnd = np.random.default_rng(seed)
    text = rnd.integers(0, [2, 3, 256, 1, 5, 2][seed], 700).astype(np.uint8)
    text[300:400] = text[100:200]
    raw = text.tobytes()
    order = suffix_array.suffix_array(text, 50)
    assert sorted(order.tolist()) == list(range(len(raw)))
    heads = [raw[i:i + 50].ljust(50, b"\0") for i in order]
    assert heads == sorted(heads)
    shared = lambda a, b: next((k for k in range(50) if k >= min(len(a), len(b)) or a[k] != b[k]), 50)
    got = suffix_array.common_prefixes(suffix_array.eights(text), order, 50)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1]:order[k - 1] + 50], raw[order[k]:order[k] + 50]
        if len(a) == len(b) == 50:
            assert got[k] == shared(a, b)


def test_words_and_windows():
    texts = ["a b\tc", "", "  x  ", "é ü\nb", "last"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    rows, starts, ends, hashes = packed.words(data, offsets)
    assert [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(rows, starts, ends)] == [
        (i, w) for i, t in enumerate(texts) for w in t.split()]
    assert hashes[1] == hashes[6] and len(set(hashes.tolist())) == len(hashes) - 1
    values = np.arange(40, dtype=np.uint64) % 7
    for k in (1, 2, 3, 10, 20):
        got = packed.rolling(values, k)
        assert len(got) == 41 - k and (got[0] == got[7]) and len(set(got[:7].tolist())) == 7


# -- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    read = lambda df: {r.doc_id: (r.text, r.source) for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    now = stages["toxicity"](spark, docs, SF).cache()
    score = {r.doc_id: r.predicted for r in queries.QUERIES["op4_toxicity"](spark, SF).collect()}
    before, kept = read(docs), read(now)
    assert kept == {d: t for d, t in before.items() if not score[d]} and now.columns == docs.columns
    lines = stages["line dedup"](spark, now, SF).cache()
    want = {d: (text, kept[d][1]) for d, (n, gone, text) in brute.boilerplate([(d, t, s) for d, (t, s) in kept.items()], 10).items() if not gone or gone < n}
    kept = read(lines)
    assert kept == want and lines.columns == docs.columns and lines.filter("n_chars != length(text)").count() == 0
    apart = stages["n-gram Jaccard join"](spark, lines, SF).cache()
    want = {d: kept[d] for d, (_, c) in brute.components([(d, t) for d, (t, _) in kept.items()]).items() if c == d}
    kept = read(apart)
    assert kept == want and apart.columns == docs.columns
    clean = stages["benchmark decontamination"](spark, apart, SF).cache()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    found = brute.contamination([(d, t) for d, (t, _) in kept.items()], items)
    kept, want = read(clean), {d: kept[d] for d in kept if not found[d][-1]}
    assert kept == want and clean.columns == docs.columns
    mixed = stages["mixing sources to target weights"](spark, clean, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(mixed) == sorted(whole) and {r.doc_id for r in mixed} == set(kept)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", None, None), (2, "x", "en", "a", 1), (2, "x", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
