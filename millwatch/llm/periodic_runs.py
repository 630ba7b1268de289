"""Runs of repeated words: maximal stretches with a period q and at least four times its length.

Per text, by pattern matching inside the text itself.  Words are numbered, suffixes sorted
by prefix doubling, and the ranks of every doubling are kept: they name the interval of
the suffix array where a block of 2^k words stands.  Each aligned block of 2^k words asks
a wavelet matrix over the suffix array for its next occurrences among the places 2^k to
2^(k+1) - 1 further on, where a run with such a period must repeat it.  Occurrences of a
block so close together form an arithmetic progression: with one or two members they are
the candidate periods; with more, the block itself is periodic, and only the distances
between the ends of the two periodic stretches around it and around the progression can
be periods.  Candidates are extended to maximal runs by comparing ranks of doubled blocks
in both directions.  A run of at least 4 q words holds an aligned block of each fitting
length in its first q words, so none is missed.

Texts are worked where they are, several small ones at once: no shuffle, no join.  A text
of n words takes O(n log n) space in its task, about 100 bytes a word.

Results for odd rows: NULL, empty and blank texts have no words and no runs; repeated
rows and repeated or missing ids give a row each; a text is never cut, however long; an
empty table gives an empty table.  Ties need no rule, since runs are a set, given by
start and period.  Only id and text are read, so no other column can clash, and none is
carried: the result's own columns follow the id.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many words, and so many times its period.
LENGTH, TIMES = 6, 4
#: Small texts are worked together up to about so many bytes.
_CHUNK = 1_000_000

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


class Ranks:
    """Suffixes of a sequence in order, and the rank of every block of 2^k members.

    Equal blocks share a rank: the place in ``order`` where their interval begins.
    """

    def __init__(self, members: np.ndarray):
        n = self.n = len(members)
        order = np.argsort(members, kind="stable")
        rank, many = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.levels: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []  # at the first place of an interval, how many it holds
        place, key = np.arange(n), members[order]
        while True:
            new = np.ones(len(place), bool)
            new[1:] = key[1:] != key[:-1]
            first = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
            rank = rank.copy()
            rank[order[place]] = first
            many = np.ones(n, np.int32)
            many[place[new]] = np.diff(np.append(np.flatnonzero(new), len(place)))
            again = many[first] > 1
            if not again.any():
                break
            self.levels.append(rank)
            self.sizes.append(many)
            place, first = place[again], first[again]
            at = order[place]
            further = at + (1 << len(self.levels) - 1)
            key = first.astype(np.int64) * (n + 1) + np.where(further < n, rank[np.minimum(further, n - 1)].astype(np.int64) + 1, 0)
            by = np.argsort(key, kind="stable")
            order[place], key = at[by], key[by]
        self.order = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many members agree from ``i`` and from ``j`` on."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = (i < self.n) & (j < self.n)
            same &= level[np.where(same, i, 0)] == level[np.where(same, j, 0)]
            step = same.astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many members agree before ``i`` and before ``j``."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, a, b = self.levels[k], i - (1 << k), j - (1 << k)
            same = (a >= 0) & (b >= 0)
            same &= level[np.where(same, a, 0)] == level[np.where(same, b, 0)]
            step = same.astype(np.int64) << k
            i -= step
            j -= step
        return start - i


class WaveletMatrix:
    """Order statistics of any stretch of a sequence of numbers, for many stretches at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of [low, high) are smaller than ``bound``."""
        count = np.zeros(len(low), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, z = zeros[low], zeros[high]
            one = (bound >> b & 1) == 1
            count += np.where(one, z - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - z, z)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest number of [low, high), counted from 0; there must be so many."""
        value = np.zeros(len(low), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, z = zeros[low], zeros[high]
            one = nth >= z - a
            nth = np.where(one, nth - (z - a), nth)
            value |= one.astype(np.int64) << b
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - z, z)
        return value


def _occurrences(ranks: Ranks, longest: int) -> tuple[np.ndarray, ...]:
    """(block, its length, first three occurrences one to two lengths on); ``n`` stands for none."""
    n, asked = ranks.n, []
    for k, (level, sizes) in enumerate(zip(ranks.levels, ranks.sizes)):
        if TIMES << k > longest:
            break
        at = np.arange(0, n, 1 << k)
        low = level[at].astype(np.int64)
        held = sizes[low] > 1
        at, low = at[held], low[held]
        asked.append((at, np.full(len(at), 1 << k), low, low + sizes[low]))
    if not asked:
        return tuple(np.zeros((5, 0), np.int64))
    at, length, low, high = map(np.concatenate, zip(*asked))
    matrix = WaveletMatrix(ranks.order)
    nth = matrix.below(low, high, at + length)
    found = []
    for _ in range(3):
        place = np.full(len(at), n)
        there = nth < high - low
        place[there] = matrix.nth(low[there], high[there], nth[there])
        near = place < at + 2 * length
        keep = near if not found else slice(None)  # a block without a first occurrence asks no more
        place = np.where(near, place, n)
        found = [f[keep] for f in found] + [place[keep]]
        at, length, low, high, nth = at[keep], length[keep], low[keep], high[keep], nth[keep] + 1
    return at, length, *found


def runs_of(members: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs of a sequence, by start and period.

    ``longest`` is the length of the longest of the texts laid end to end in it, no two of which share a member.
    """
    ranks = Ranks(members)
    n = ranks.n
    at, length, first, second, third = _occurrences(ranks, longest)
    alone, two = third == n, (third == n) & (second < n)
    x, far = at[~alone], first[~alone]
    inner = second[~alone] - far
    left, right = ranks.behind(x, x + inner), ranks.ahead(x, x + inner)
    far_left, far_right = ranks.behind(far, far + inner), ranks.ahead(far, far + inner)
    start = np.concatenate([at[alone], at[two], x, x])
    period = np.concatenate([(first - at)[alone], (second - at)[two], (far - far_left) - (x - left), (far + far_right) - (x + right)])
    block = np.concatenate([length[alone], length[two], length[~alone], length[~alone]])
    fits = (period >= block) & (period < 2 * block) & (start + period < n)
    start, period = start[fits], period[fits]
    begin = start - ranks.behind(start, start + period)
    size = start + period + ranks.ahead(start, start + period) - begin
    long = size >= np.maximum(LENGTH, TIMES * period)
    begin, size, period = begin[long], size[long], period[long]
    order = np.lexsort((period, size, begin))
    begin, size, period = begin[order], size[order], period[order]
    least = np.ones(len(begin), bool)  # of the periods of one stretch the smallest; the others are its multiples
    least[1:] = (begin[1:] != begin[:-1]) | (size[1:] != size[:-1])
    found = np.stack([begin, size, period], 1)[least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``_CHUNK`` bytes; a longer text is one of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _CHUNK, side="right")))
        yield texts.slice(a, b - a)
        a = b


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, row offsets); words are kept apart by ASCII white space only."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), counts)[real]
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int64)


def _joined(words: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words), pa.scalar(" ", pa.large_string()))


def _work(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs and the kept words of each text."""
    words, offsets = _words(texts)
    rows, counts = len(texts), np.diff(offsets)
    row_of = np.repeat(np.arange(rows), counts)
    numbers = words.dictionary_encode()
    members = row_of * (len(numbers.dictionary) + 1) + numbers.indices.to_numpy(zero_copy_only=False)
    found = runs_of(members, int(counts.max(initial=0))) if len(members) else np.zeros((0, 3), np.int64)
    row = row_of[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    per_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(np.bincount(row_of[keep], minlength=rows))]).astype(np.int64)
    fields = [found[:, 0] - offsets[row], found[:, 1], found[:, 2]]
    runs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=[
        pa.field(f.name, pa.int64(), False) for f in RUNS.elementType])
    return [
        pa.array(counts, pa.int64()),
        pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), runs, type=pa.list_(pa.field("element", runs.type, False))),
        _joined(words.filter(pa.array(keep)), kept).cast(pa.string()),
    ]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, its ``runs`` by start and period, and ``kept``.

    ``kept`` holds the words, joined by one space, without those that a run contains after its first period.
    """
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *_work(texts)],
                                                 names=["_id", "n_words", "runs", "kept"])
                done += len(texts)

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema).toDF(id_col, *schema.names[1:])
