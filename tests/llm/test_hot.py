"""Keys with a large part of all rows: right results, and no task that holds all of them."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from millwatch.llm import exchange, suffix_dedup

DOCS = "doc_id bigint, text string"


def one(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_strings_of_a_passage_on_many_documents_spread(spark, monkeypatch):
    """Around the passage every document has words of its own, so no two stretches of its outer anchors are equal."""
    rnd = random.Random(4)
    own = lambda: " ".join(f"{rnd.randrange(10 ** 9)}" for _ in range(12))
    passage = " ".join(f"passage{i}" for i in range(12))
    rows = [(i, own() + " " + passage + " " + own()) for i in range(300)]
    rows += [(i + 300, rows[i][1][:150] + own()) for i in range(0, 90, 3)]
    rows += [(700, rows[5][1] + rows[9][1]), (701, "a" * 3000), (702, "b" + "a" * 400), (None, passage), (703, None)]
    monkeypatch.setattr(suffix_dedup, "_PART", 20_000)
    monkeypatch.setattr(exchange, "UNIT_HASHES", 500)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = suffix_dedup.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    want = brute.byte_strings([(exchange.NO_ID if d is None else d, t) for d, t in rows])
    assert one(got) == {None if d == exchange.NO_ID else d: r for d, r in want.items()}


def test_no_bucket_gets_a_hot_anchor(spark, monkeypatch):
    rnd = random.Random(4)
    own = lambda: " ".join(f"{rnd.randrange(10 ** 9)}" for _ in range(12))
    passage = " ".join(f"passage{i}" for i in range(12))
    docs = spark.createDataFrame([(i, own() + " " + passage + " " + own()) for i in range(300)], DOCS)
    plan = exchange.plan_for(docs, "text")
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    found = suffix_dedup.repeated_anchors(suffix_dedup._anchor_probes(rows, plan, 50, 24), plan, 100)
    hot = np.sort(np.concatenate([exchange.unpack_sorted(r["hashes"], r["n"]) for r in found.filter("share = -1").collect()]))
    assert len(hot)
    by_share = rows.withColumn("share", exchange.share_of("id", plan))
    largest = {}
    for name, keys in {"dealt": hot, "by anchor": hot[:0]}.items():
        sent = suffix_dedup.stretches(by_share, found.filter("share >= 0"), keys, plan, 50, 24).filter("share = -1").collect()
        held = {}
        for r in sent:
            for key in exchange.unpack_sorted(r["hashes"], r["n"]).tolist():
                held[key] = held.get(key, 0) + 1
        largest[name] = max(held.values())
    assert largest["dealt"] < 200 < 300 <= largest["by anchor"]  # twice what makes an anchor hot


def test_anchors_fill_all_buckets_alike():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, 200_000).astype(np.uint8)
    _, hashes, _, _ = suffix_dedup.anchors(data, np.array([0, len(data)]), 50, 24)
    filled = np.bincount(exchange.Plan(bits=5, rest=4, shares=23).bucket(hashes >> np.uint64(27)), minlength=32)
    assert filled.max() < 1.3 * filled.mean()
