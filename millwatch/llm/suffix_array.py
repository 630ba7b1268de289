"""A suffix array by two-stage sorting, and adjacent common prefixes, in numpy.

Only suffixes smaller than their successor are sorted directly.  A larger one follows
from the order of its successor: scanning the buckets of first characters upwards,
the suffix before each one visited is appended to the bucket of its own first
character if it is larger than its successor.  Both work on whole buckets at once.

Orders hold for the first ``depth`` characters; suffixes equal that far may come in
any order, side by side.
"""

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a place later; the last is larger."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1:] = -1
    # Among equal characters the first change to come decides.
    at = np.where(step != 0, np.arange(n), n)
    change = np.minimum.accumulate(at[::-1])[::-1]
    return step[change] > 0


def eights(text: np.ndarray) -> np.ndarray:
    """At each place the next eight characters (bytes) as one number, in order; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(text)].astype(np.uint64)
    return out


def sort_directly(keys: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes; ``keys`` from ``eights``; only ties look further."""
    reach = len(keys)

    def key(at, level):
        place = at + 8 * level
        return np.where(place < reach, keys[np.minimum(place, reach - 1)], np.uint64(0))

    first = key(starts, 0)
    order = np.argsort(first)
    out, first = starts[order], first[order]
    new = np.ones(len(out), bool)
    new[1:] = first[1:] != first[:-1]
    for level in range(1, -(-depth // 8)):
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        further = key(out[tied], level)
        order = np.lexsort((further, group))
        out[tied] = out[tied][order]
        further, group = further[order], group[order]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (further[1:] != further[:-1]) | (group[1:] != group[:-1])
        new[tied] = fresh
    return out


def suffix_array(text: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """All places of ``text`` (bytes) in the order of their suffixes, up to ``depth`` characters."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    keys = eights(text) if keys is None else keys
    small = smaller_than_next(text)
    direct = sort_directly(keys, np.flatnonzero(small), depth)
    first = text[direct]
    begin = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The last suffix is larger than its (empty) successor, which comes before all others.
    waiting[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):  # the same character before: larger than its successor too, and next in order
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
            waves.append(wave)
        bucket = np.concatenate([*waves, direct[begin[c]:begin[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]]) if len(chars) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            waiting[int(chars[a])].append(before[a:b])
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(keys: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """min(limit, common prefix) of each suffix in ``order`` with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    reach = len(keys)
    a, b = order[:-1], order[1:]
    open_ = np.arange(len(a))
    for level in range(-(-limit // 8)):
        pa, pb = a[open_] + 8 * level, b[open_] + 8 * level
        ka = np.where(pa < reach, keys[np.minimum(pa, reach - 1)], np.uint64(0))
        kb = np.where(pb < reach, keys[np.minimum(pb, reach - 1)], np.uint64(1))
        differ = ka ^ kb
        same = differ == 0
        # Leading equal bytes of the eight.
        lead = np.zeros(len(open_), np.int64)
        for i in range(1, 8):
            lead += (differ >> np.uint64(64 - 8 * i)) == 0
        out[open_ + 1] = 8 * level + np.where(same, 8, lead)
        open_ = open_[same]
    return np.minimum(out, limit)
