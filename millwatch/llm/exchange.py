"""Shuffling very many small hashes in packed rows.

Repeat-finding operators compare a hash of every window of every text.  As rows of
their own these would be tens of bytes each.  Here a task gathers the hashes of a
unit of text, sorts them, reduces what it can itself, and sends one row per bucket of
hashes: sorted hashes as differences, in byte planes, compressed.  A bucket is a
range of hash values, about ``BUCKET_BYTES`` of input text each, whatever the input's
size, so the number of buckets grows with the input and their size does not.

Answers return to "shares": groups of documents by id modulo a prime.  An answer
need not name its document, since a hash that repeats does so for every document
that has it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 6_000_000
#: A unit of text is handed over after about so many hashes.
UNIT_HASHES = 1_000_000
#: Rows without an id come after all others.
NO_ID = 2 ** 63 - 1


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


@dataclass(frozen=True)
class Plan:
    """Sizes that follow from the bytes of all texts."""

    bits: int     # buckets are the top bits of a hash
    rest: int     # further bytes of the hash that are sent
    shares: int   # groups of documents

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - self.bits - 8 * self.rest)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        """The part of the hashes that is sent and compared."""
        return hashes >> self.shift

    def bucket(self, cut: np.ndarray) -> np.ndarray:
        return (cut >> np.uint64(8 * self.rest)).astype(np.int64)

    def share(self, ids: np.ndarray) -> np.ndarray:
        return ids % self.shares

    @property
    def share_bits(self) -> int:
        return max(1, self.shares.bit_length())


def plan_for(docs: DataFrame, text: str, rest: int = 4, bucket_bytes: int = BUCKET_BYTES) -> Plan:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    return Plan(bits=(buckets - 1).bit_length(), rest=rest, shares=_prime(buckets + 1))


def known_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def share_of(id_col: str, plan: Plan) -> Column:
    return F.pmod(known_id(id_col), F.lit(plan.shares)).cast("int")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned numbers, plane by plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


def pack_sorted(values: np.ndarray, width: int = 8) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)), width)


def unpack_sorted(data: bytes, n: int, width: int = 8) -> np.ndarray:
    return np.cumsum(unpack(data, n, width), dtype=np.uint64)


def sort_pairs(high: np.ndarray, low: np.ndarray, low_bits: int, high_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order; as one number each where they fit."""
    if high_bits + low_bits <= 64:
        both = np.sort((high << np.uint64(low_bits)) | low.astype(np.uint64))
        return both >> np.uint64(low_bits), both & np.uint64((1 << low_bits) - 1)
    order = np.lexsort((low, high))
    return high[order], low[order].astype(np.uint64)


def slices(keys: np.ndarray):
    """(key, start, end) of the runs of equal keys in sorted keys."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])):
            yield int(keys[a]), int(a), int(b)


def groups_of(table: pa.Table, *columns: str):
    """Rows of a small table of packed rows as tuples of Python values."""
    return zip(*(table.column(c).to_pylist() for c in columns))
