"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table per feature and per chosen
pair of features (``boosting.fit_additive``) from a bounded sample of labelled rows.
A score is a sum of table entries, looked up for a whole chunk of documents at once.

Results for odd rows: a NULL text is scored as an empty one; equal texts get equal
scores; without usable labels every score is 0.5; an empty table gives an empty
result.  Only the text enters the score.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import boosting, labelled

FOLDS, HELD_OUT, PREDICT_FROM = 5, 0, 0.3

_KINDS = ("lower", "upper", "digit", "blank", "line_end", "shout", "symbol", "bar", "stop", "other", "lead", "tail")
_KIND = np.full(256, _KINDS.index("other"), np.int64)
_KIND[ord("a"):ord("z") + 1] = _KINDS.index("lower")
_KIND[ord("A"):ord("Z") + 1] = _KINDS.index("upper")
_KIND[ord("0"):ord("9") + 1] = _KINDS.index("digit")
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _KINDS.index("blank")
_KIND[0x0A] = _KINDS.index("line_end")
_KIND[ord("!")] = _KINDS.index("shout")
_KIND[[ord(c) for c in "#*$%&<>"]] = _KINDS.index("symbol")
_KIND[ord("|")] = _KINDS.index("bar")
_KIND[[ord(c) for c in ".,;:?"]] = _KINDS.index("stop")
_KIND[0x80:0xC0] = _KINDS.index("tail")
_KIND[0xC0:] = _KINDS.index("lead")

FEATURES = ("log_words", "word_length", "upper", "digit", "line_end", "shout", "symbol", "bar", "stop", "other", "lead",
            "distinct_words", "repeated_windows", "repeated_lines")


def byte_kinds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each kind every text has."""
    n, k = len(offsets) - 1, len(_KINDS)
    row = np.repeat(np.arange(n) * k, np.diff(offsets))
    return np.bincount(row + _KIND[data], minlength=n * k).reshape(n, k).astype(float)


def _again(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many entries of each row equal an earlier one of the row, mask of all entries found twice)."""
    from millwatch.llm.packed import mixed
    key = mixed(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    later = np.bincount(rows[twice], minlength=n).astype(float)
    twice[order[:-1][same]] = True
    return later, twice


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    from millwatch.llm.packed import covered, rolling, window_rows, words
    n = len(offsets) - 1
    kinds = dict(zip(_KINDS, byte_kinds(data, offsets).T))
    rows, _, _, hashes = words(data, offsets)
    n_words = np.bincount(rows, minlength=n).astype(float)
    chars = sum(v for k, v in kinds.items() if k not in ("tail", "blank", "line_end"))
    inside = window_rows(rows, 5)
    at = np.flatnonzero(inside)
    _, twice = _again(rows[at], rolling(hashes, 5)[at], n) if len(at) else (None, np.zeros(0, bool))
    repeated = np.bincount(rows[covered(at[twice], 5, len(rows))], minlength=n) if len(rows) else np.zeros(n)
    earlier = _again(rows, hashes, n)[0] if len(rows) else np.zeros(n)
    # Lines as the words between two line ends: equal runs of words count as equal lines.
    line = np.cumsum(data == 0x0A)
    starts = words(data, offsets)[1]
    line_of = line[starts] + rows  # a new text begins a new line
    lines, first = np.unique(line_of, return_index=True)
    dup_lines = np.zeros(n)
    if len(lines):
        sums = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(
            first, np.diff(np.append(first, len(hashes)))).astype(np.uint64) + np.uint64(1)), first)
        dup_lines = _again(rows[first], sums, n)[0] / np.maximum(1, np.bincount(rows[first], minlength=n))
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    return np.stack([
        np.log1p(n_words), chars / w, kinds["upper"] / c, kinds["digit"] / c, kinds["line_end"] / w, kinds["shout"] / w,
        kinds["symbol"] / c, kinds["bar"] / w, kinds["stop"] / w, kinds["other"] / c, kinds["lead"] / c,
        1 - earlier / w, repeated / w, dup_lines], axis=1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = labelled.SAMPLE) -> dict | None:
    rows = labelled.training_rows(docs, labels, "quality", FOLDS, HELD_OUT, id_col, text, sample)
    x, y = labelled.features_of(rows, features, len(FEATURES))
    return boosting.fit_additive(x, y) if len(y) else None


def score_quality(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    def score(x: np.ndarray) -> np.ndarray:
        return boosting.score_additive(model, x) if model else np.full(len(x), 0.5)

    return labelled.scored(docs, features, score, id_col, text, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = labelled.SAMPLE) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    out = score_quality(docs, fit(docs, labels, id_col, text, sample), id_col, text)
    return out.select(
        id_col, F.coalesce(labelled.fold(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
