"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon has a given part and a learned one.  The learned part comes from the
bounded training sample: words, and beginnings of words, that toxic texts carry far
more often than others.  Features are densities of lexicon words, how often they
stand near a second-person pronoun, capitals, punctuation, and disguised spellings
(digits or signs in place of letters).

Results for odd rows: a NULL text is scored as an empty one; equal texts get equal
scores; without usable labels every score is 0; an empty table gives an empty
result.  Only the text enters the score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import boosting, labelled

FOLDS, HELD_OUT, PREDICT_FROM = 3, 1, 0.7
#: The learned lexicon has at most this many entries; an entry needs so many toxic texts of the sample, and they so large a share.
LEXICON_SIZE = 2_000
ENTRY_NEEDS = ((4, 0.8), (6, 0.6))
NEAR_WORDS = 3
GIVEN = ("idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "imbecile",
         "pig", "vermin", "dumb", "ugly")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te",
                 "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros")
FEATURES = ("given", "given_log", "learned", "learned_log", "stems", "stems_log", "near_you", "you", "upper", "shout", "stop",
            "disguised", "disguised_hits", "log_words")

# Kinds of lexicon keys: whole words by hash, beginnings of 5 and of 4 bytes by their value.
WORD, FIVE, FOUR = 0, 1, 2

_SPLIT = np.zeros(256, bool)  # plain words end at ASCII signs
_SPLIT[:0x80] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _SPLIT[ord(_a):ord(_b) + 1] = False
_SPOKEN = np.arange(256, dtype=np.uint8)  # signs and digits read as the letters they stand in for
for _sign, _letter in (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s"), ("!", "i")):
    _SPOKEN[ord(_sign)] = ord(_letter)


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    from millwatch.llm.packed import words
    return words(np.where(_SPLIT[data], np.uint8(0x20), data), offsets, lower=True)


def _beginning(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes of each word, in lower case, as one number; 0 for shorter words."""
    from millwatch.llm.packed import LOWER
    out = np.zeros(len(starts), np.uint64)
    long = ends - starts >= size
    at = starts[long]
    value = np.zeros(len(at), np.uint64)
    for i in range(size):
        value = (value << np.uint64(8)) | LOWER[data[at + i]].astype(np.uint64)
    out[long] = value
    return out


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_plain(data, np.array([0, len(data)]))[3][0])


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    rows, starts, ends, hashes = _plain(data, offsets)
    return rows, {WORD: hashes, FIVE: _beginning(data, starts, ends, 5), FOUR: _beginning(data, starts, ends, 4)}


def learn_lexicon(rows: DataFrame) -> dict[int, np.ndarray]:
    """Keys of each kind that speak for a toxic text; (``_text``, ``_label``) rows of the sample.

    Tasks count texts per key for each chunk before anything is shuffled.
    """
    from millwatch.llm.packed import text_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("_label")).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch, "_text"):
                text_row, keys = _keys(data, offsets)
                toxic = label[a:b] > 0
                for kind, values in keys.items():
                    use = values != 0
                    key, row = values[use], text_row[use]
                    order = np.lexsort((row, key))
                    key, row = key[order], row[order]
                    once = np.ones(len(key), bool)  # a text counts once for a key
                    once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                    found, at = np.unique(key[once], return_inverse=True)
                    of_toxic = np.bincount(at, toxic[row[once]], len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), kind, np.int32)), pa.array(found.view(np.int64)),
                         pa.array(np.bincount(at, minlength=len(found)).astype(np.int64)), pa.array(of_toxic)],
                        ["kind", "key", "n", "toxic"])

    counts = rows.mapInArrow(run, "kind int, key bigint, n bigint, toxic bigint").groupBy("kind", "key").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    sure = [(F.col("toxic") >= least) & (F.col("toxic") >= share * F.col("n")) for least, share in ENTRY_NEEDS]
    best = counts.filter(sure[0] | sure[1])
    best = best.orderBy(F.col("toxic").desc(), "n", "kind", "key").limit(LEXICON_SIZE).collect()  # the size of the lexicon
    return {kind: np.sort(np.array([r["key"] for r in best if r["kind"] == kind], np.int64).view(np.uint64))
            for kind in (WORD, FIVE, FOUR)}


def features(lexicon: dict[int, np.ndarray]) -> labelled.Features:
    given = np.sort(np.array([word_hash(w) for w in GIVEN], np.uint64))
    person = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], np.uint64))

    def compute(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        from millwatch.llm.packed import among, words
        from millwatch.llm.quality_classifier import _KINDS, byte_kinds
        n = len(offsets) - 1
        kinds = dict(zip(_KINDS, byte_kinds(data, offsets).T))
        rows, keys = _keys(data, offsets)
        per_text = lambda mask: np.bincount(rows[mask], minlength=n).astype(float)
        by_given, by_word = among(keys[WORD], given), among(keys[WORD], lexicon[WORD])
        by_stem = among(keys[FIVE], lexicon[FIVE]) | among(keys[FOUR], lexicon[FOUR])
        you = among(keys[WORD], person)
        hit, near = by_given | by_word | by_stem, np.zeros(len(rows), bool)
        for d in range(1, NEAR_WORDS + 1):
            same = rows[d:] == rows[:-d]
            near[d:] |= hit[d:] & you[:-d] & same
            near[:-d] |= hit[:-d] & you[d:] & same
        # Words as they stand, and as they would be read aloud.
        raw_rows, starts, ends, _ = words(data, offsets)
        letter = np.concatenate([[0], np.cumsum((data | 0x20) - 97 < 26)])
        odd = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b"0134579@$*!", np.uint8)))])
        inner = np.maximum(ends - 1, starts + 1)
        disguised = (letter[ends] - letter[starts] >= 2) & (odd[inner] - odd[starts] > 0) & (letter[ends] - letter[inner] > 0)
        spoken_rows, _, _, spoken = _plain(_SPOKEN[data], offsets)
        spoken_hits = np.bincount(spoken_rows[among(spoken, given)], minlength=n) - per_text(by_given)
        n_words = np.bincount(rows, minlength=n).astype(float)
        w = np.maximum(n_words, 1)
        c = np.maximum(sum(v for k, v in kinds.items() if k not in ("tail", "blank", "line_end")), 1)
        return np.stack([
            per_text(by_given) / w, np.log1p(per_text(by_given)), per_text(by_word) / w, np.log1p(per_text(by_word)),
            per_text(by_stem) / w, np.log1p(per_text(by_stem)), per_text(near) / w, per_text(you) / w,
            kinds["upper"] / c, kinds["shout"] / w, kinds["stop"] / w,
            np.bincount(raw_rows[disguised], minlength=n) / w, np.maximum(spoken_hits, 0) / w, np.log1p(n_words)], axis=1)

    return compute


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        sample: int = labelled.SAMPLE) -> tuple[dict[int, np.ndarray], dict | None]:
    """The learned lexicon and the trees."""
    rows = labelled.training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, id_col, text, sample)
    lexicon = learn_lexicon(rows)
    x, y = labelled.features_of(rows, features(lexicon), len(FEATURES))
    return lexicon, boosting.fit_trees(x, y) if len(y) else None


def score_toxicity(docs: DataFrame, model: tuple[dict[int, np.ndarray], dict | None], id_col: str = "doc_id",
                   text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    lexicon, trees = model

    def score(x: np.ndarray) -> np.ndarray:
        return boosting.score_trees(trees, x) if trees else np.zeros(len(x))

    return labelled.scored(docs, features(lexicon), score, id_col, text, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = labelled.SAMPLE) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    out = score_toxicity(docs, fit(docs, labels, id_col, text, sample), id_col, text)
    return out.select(
        id_col, F.coalesce(labelled.fold(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
