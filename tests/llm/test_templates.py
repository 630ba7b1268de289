"""Texts of one template with scattered edits, whose links are exact."""

import random

import brute
import numpy as np
import pytest

from millwatch.llm import ngram_jaccard

DOCS = "doc_id bigint, text string"


def template_texts(n, seed=1, edits=(3, 9), vocabulary=10 ** 6, length=150):
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rnd.randint(*edits)):
            own[rnd.randrange(length)] = f"e{rnd.randrange(vocabulary)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("shingle, similar, edits, vocabulary, length", [
    (5, 80, (1, 7), 3, 60), (5, 80, (2, 4), 5, 90), (4, 85, (0, 12), 2, 40)])
def test_links_of_templates(spark, shingle, similar, edits, vocabulary, length):
    """Few substitutes, so that edits meet; some texts come from a second template that shares half of the first."""
    rows = template_texts(110, 3, edits, vocabulary, length)
    rows += [(200 + i, " ".join(t.split()[length // 2:]) + " " + " ".join(f"z{k}" for k in range(length // 2))) for i, t in rows[:40]]
    rows += [(400 + i, " ".join(t.split()[:-i])) for i, t in rows[1:30]]
    got = {r[0]: tuple(r)[1:] for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), shingle=shingle, similar=similar).collect()}
    assert got == brute.components(rows, similar, shingle)


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """Texts of one template: candidates beside the comparisons with the centre stay below one a text."""
    made, open_pairs = [], ngram_jaccard._open_pairs

    def counted(*args):
        pairs = open_pairs(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_jaccard, "_open_pairs", counted)
    for n in (200, 400, 800):
        rows = template_texts(n)
        got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), shingle=5, similar=80)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.components(rows, 80, 5)
        assert made[-1] <= n // 10


def test_keys_grow_with_the_texts(spark, monkeypatch):
    """A group of variants that grows does not change how its sets are looked up, so eight times the texts make about eight times the keys."""
    made, keys_of = [], ngram_jaccard._keys

    def counted(*args):
        keys = keys_of(*args)
        made.append(keys.count())
        return keys

    monkeypatch.setattr(ngram_jaccard, "_keys", counted)
    for n in (10, 80):
        rows = template_texts(n, edits=(1, 2), length=250)
        got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, DOCS))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.components(rows)
    assert 0 < made[1] <= 12 * made[0]


def test_parity_bits_never_exceed_the_difference():
    rnd = random.Random(5)
    for size in (4, 20, 300, 5000):
        a = {rnd.getrandbits(64) for _ in range(size)}
        b = set(list(a)[size // 3:]) | {rnd.getrandbits(64) for _ in range(size // 4)}
        bits = [ngram_jaccard.parities(np.array(sorted(s), np.uint64)) for s in (a, b)]
        differ = sum(bin((x ^ y) & (2 ** 64 - 1)).count("1") for x, y in zip(*bits))
        assert 0 < differ <= len(a ^ b)
