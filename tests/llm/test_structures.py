"""Operators 11 to 13 against slow versions and the library that 11 has to match."""

import random

import brute_new as slow
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from conftest import SF
from millwatch.llm import conversation_repair as repair
from millwatch.llm import periodic_runs, queries, sentencepiece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROWS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return file.read()


def with_map(model, prefix=True, squeeze=True):
    """The model with the compiled map of a public normalisation in place of its own."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec
    proto = pb.ModelProto.FromString(model)
    proto.normalizer_spec.CopyFrom(pb.NormalizerSpec.FromString(spec() if callable(spec) else spec))
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    return proto.SerializeToString()


def odd_texts(n=400, seed=3):
    rnd = random.Random(seed)
    bits = [" ", "  ", "a", "the", "é", "漢", "ｶﾞ", "ﬁ", "①", "\n", "\t", "\x01", "​", "▁", "▁▁", "ཀ", "x́", "ing", " of", "<0x0A>", "<s>",
            "　", "😀", "e", "r", "\x00", "¨", "ö", "̈"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 2, 5, 40]))) for _ in range(n)]
    return [None, "", " ", "\n", *texts, " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(20000)), "longword" * 3000, texts[7], texts[7]]


def encoded(spark, texts, model):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "ids bigint, text string, decoded string, starts int")
    return {r[0]: r for r in sentencepiece_codec.encode_texts(rows.repartition(4), model, id_col="ids").toDF(
        "id", "ids", "starts", "ends", "decoded").collect()}


@pytest.mark.parametrize("form", ["own", "map", "map, no prefix", "map, all spaces"])
def test_pieces_spans_and_decoding_equal_the_library(spark, model, form, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "_CHUNK", 500)
    used = model if form == "own" else with_map(model, "no prefix" not in form, "all spaces" not in form)
    library = sentencepiece.SentencePieceProcessor(model_proto=used)
    texts = odd_texts()
    got = encoded(spark, texts, used)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", return_type="proto").pieces
        assert list(zip(got[i].ids, got[i].starts, got[i].ends)) == [(p.id, p.begin, p.end) for p in want], text
        assert got[i].decoded == library.decode([p.id for p in want])


def test_spans_cover_the_text(spark, model):
    texts = [t for t in odd_texts(80) if t]
    for i, r in encoded(spark, texts, model).items():
        raw = texts[i].encode()
        assert r.starts[0] == 0 and r.ends[-1] == len(raw)
        assert all(a == b for a, b in zip(r.ends, r.starts[1:])) and b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw


def test_any_ids_decode_like_the_library(spark, model):
    library, rnd = sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(5)
    rows = [(i, [rnd.choice([rnd.randrange(32000), rnd.randrange(259), 28705]) for _ in range(rnd.randrange(9))]) for i in range(500)]
    rows += [(500, []), (501, None)]
    got = dict(sentencepiece_codec.decode_ids(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), model).collect())
    assert got == {i: library.decode(ids or []) for i, ids in rows}


def test_unfit_models_are_refused(spark, model):
    proto = pb.ModelProto.FromString(model)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        sentencepiece_codec.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), proto.SerializeToString())


def test_op11_on_the_table(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r[0]: tuple(r)[1:4] for r in queries.op11_sentencepiece(spark, SF).collect()}
    want = {}
    for doc, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        ids = library.encode(text or "")
        want[doc] = (len(ids), slow.sha(",".join(map(str, ids))), slow.sha(library.decode(ids)))
    assert got == want


def repaired(spark, rows, damage=False):
    frame = spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit(1)).withColumn("place", F.lit("x")).repartition(3)
    done = repair.repair(queries.damaged(frame) if damage else frame)
    found = {r["conv"]: list(r)[1:] for r in done.summary.collect()}
    hashes = {r[0]: r[1] for r in repair.digests(done.rows).collect()}
    return {c: (*v, hashes.get(c, slow.sha(""))) for c, v in found.items()}


def made_up_turns(n, seed, longest=9):
    rnd, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "u2", "", "tool", "User"])
            text = rnd.choice(["", " \n", "a.", "b!", "b!", "long one?\t", "cut", f"x{rnd.randrange(50)}.", "é."])
            out.append((rnd.choice([conv, conv, conv, None]) if conv % 40 == 0 else conv,
                        rnd.choice([turn, turn, turn, None, 3]), role, text))
    return out


@pytest.mark.parametrize("range_rows", [200_000, 7, 1])
def test_repair_equals_a_search(spark, range_rows, monkeypatch):
    """With ranges of a few rows every conversation crosses several."""
    monkeypatch.setattr(repair, "_RANGE_ROWS", range_rows)
    rows = made_up_turns(150 if range_rows > 1 else 25, 11)
    assert repaired(spark, rows) == slow.conversations(rows)


def test_long_conversation_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(repair, "_RANGE_ROWS", 100)
    rnd = random.Random(2)
    rows = [(5, t, rnd.choice(["user", "user", "assistant"]), rnd.choice(["same.", f"own {t}.", f"own {t}.", "", "cut"])) for t in range(1200)]
    rows += [(4, 0, "user", "q?"), (6, 0, "user", "q?"), (6, 1, "assistant", "a."), *[(7, 0, "user", "same.")] * 300]
    assert repaired(spark, rows) == slow.conversations(rows)


def test_audits_of_long_conversations_are_not_copied():
    """One user turn after the other: two equal-cost audits that differ from the first letter on stay open to the end."""
    cost, audit = repair.repair_roles([("u", False, False)] * 100_001)
    assert (cost, audit) == (50_002, "D" + "KR" * 50_000)
    assert repair._step.cache_info().currsize < 1000


def test_nothing_left_and_nulls(spark):
    rows = [(1, 0, None, None), (2, None, "user", "a."), (2, None, "assistant", "b."), (None, 2 ** 40, "system", "s."), (3, 1, "user", None)]
    assert repaired(spark, rows) == slow.conversations([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert repaired(spark, rows[:0]) == {}


def test_damage(spark):
    rows = made_up_turns(60, 5) + [(None, None, None, None), (10 ** 12, -4, "user", "a.b!c?")]
    got = queries.damaged(spark.createDataFrame(rows, ROWS)).collect()
    key = lambda r: tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(slow.damaged(rows), key=key)


def test_op12_on_the_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    none = (0, 0, 0, 0, 0, 0, "", slow.sha(""))
    want = {r[0]: none for r in rows} | slow.conversations(slow.damaged(rows))
    assert {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).collect()} == want


def periodic_texts(n, seed):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        own = []
        for _ in range(rnd.randrange(5)):
            root = [rnd.choice("abc") for _ in range(rnd.randrange(1, 9))]
            root = root * rnd.randrange(1, 5) + [rnd.choice("ab")] * rnd.randrange(4)
            own += (root * rnd.randrange(1, 7))[:rnd.randrange(1, 150)]
        for _ in range(rnd.randrange(3)):
            if own:
                own[rnd.randrange(len(own))] = rnd.choice(["x", "é\x1c", "a"])
        out.append(rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "\t ", "\r\n", "\x0b"]).join(own) + rnd.choice(["", " "]))
    return [None, "", "\t", *out, "no no " * 4000, " ".join(f"w{i % 700} z" for i in range(6000)), out[3], out[3]]


@pytest.mark.parametrize("chunk", [1_000_000, 3000, 1])
def test_runs_equal_a_search(spark, chunk, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_CHUNK", chunk)
    texts = periodic_texts(300, 9)
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id bigint, text string, runs int").repartition(4)
    got = {r.id: (r.n_words, [tuple(x) for x in r.runs], r.kept) for r in periodic_runs.find_runs(rows, id_col="id").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        own = slow.words(text)
        want = slow.runs(own)
        gone = {k for a, size, q in want for k in range(a + q, a + size)}
        assert got[i] == (len(own), want, " ".join(w for k, w in enumerate(own) if k not in gone))


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert sentencepiece_codec.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), open(MODEL, "rb").read()).count() == 0


def test_op13_on_the_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == {d: slow.run_digest(slow.planted(d, t)) for d, t in rows}
    assert sum(r[0] > 0 for r in got.values()) > 5
