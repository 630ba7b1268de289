"""Remove repeated passages of words, by fixed-block anchors.

Every document's non-overlapping blocks of ``block`` words are the reference blocks;
every rolling window of ``block`` words is a probe.  A window of ``window`` words
(``window >= 2 * block - 1``) always holds a whole reference block, so wherever such a
window repeats, a probe hits a reference block of another place.  Hits are then
extended: all whole windows around a hit are compared, the earliest place of each
keeps it, and neighbouring repeated windows join to maximal repeats.

1. Tasks send the distinct probes of a unit of text to hash buckets; a bucket finds
   those that meet a reference block elsewhere (a superset is harmless).
2. Documents with hits send their windows around hits, one per unit and content; a
   bucket finds the earliest place of each, and all others are repeats.
3. Documents lose the words that repeats cover.

What a unit of text shows to be repeated never leaves it more than once, so a passage
on a third of all documents costs one entry per unit.  Steps 2 and 3 read the same
shuffle of the documents.

Results for odd rows: NULL and empty texts have no words; documents without an id come
after all others; rows that share an id count as one document, so an equal window at
an equal place of both stays in both; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import exchange as ex
from millwatch.llm.packed import among, covered, rolling, text_chunks, window_rows, words

WINDOW, BLOCK = 20, 10
_PROBES = "bucket int, share int, n int, hashes binary, shares binary, flags binary"
_PLACES = "bucket int, share int, n int, hashes binary, ids binary, starts binary"


def _first_words(rows: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of every text among all words."""
    return np.searchsorted(rows, np.arange(n))


def _probe_unit(plan: ex.Plan, cut: np.ndarray, share: np.ndarray, is_block: np.ndarray, counted: bool = False) -> Iterator[tuple]:
    """Rows of one unit: distinct probes by bucket, and what the unit itself shows to repeat, by share.

    With ``counted`` the flags hold the power of two in the number of equal probes, above their lowest two bits.
    """
    low = (share.astype(np.uint64) << np.uint64(1)) | (~is_block).astype(np.uint64)
    cut, low = ex.sort_pairs(cut, low, plan.share_bits + 1, plan.bits + 8 * plan.rest)
    at = np.concatenate([[0], np.flatnonzero(cut[1:] != cut[:-1]) + 1])
    size = np.diff(np.append(at, len(cut)))
    blocks = np.add.reduceat(1 - (low & np.uint64(1)).astype(np.int64), at)
    first, first_share = cut[at], low[at] >> np.uint64(1)
    flags = (blocks > 0).astype(np.uint64) | ((size > 1).astype(np.uint64) << np.uint64(1))
    if counted:
        flags |= np.log2(size).astype(np.uint64) << np.uint64(2)
    for bucket, a, b in ex.slices(plan.bucket(first)):
        yield (bucket, -1, b - a, ex.pack_sorted(first[a:b]), ex.pack(first_share[a:b], 4), ex.pack(flags[a:b], 1))
    again = np.repeat(size > 1, size)
    share_of, repeated = ex.sort_pairs(low[again] >> np.uint64(1), cut[again], plan.bits + 8 * plan.rest, plan.share_bits)
    new = np.ones(len(repeated), bool)
    new[1:] = (repeated[1:] != repeated[:-1]) | (share_of[1:] != share_of[:-1])
    share_of, repeated = share_of[new], repeated[new]
    buckets = 1 << plan.bits
    for share, a, b in ex.slices(share_of):
        yield (buckets + share % buckets, share, b - a, ex.pack_sorted(repeated[a:b]), b"", b"")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def probes(docs: DataFrame, plan: ex.Plan, block: int) -> DataFrame:
    """Step 1, sending: ``docs`` has (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch, "text"):
                rows, _, _, hashes = words(data, offsets)
                at = np.flatnonzero(window_rows(rows, block))
                if not len(at):
                    continue
                row = rows[at]
                place = at - _first_words(rows, b - a)[row]
                held.append((plan.cut(rolling(hashes, block)[at]), plan.share(ids[a:b])[row], place % block == 0))
                n += len(at)
                if n >= ex.UNIT_HASHES:
                    yield _batch(list(_probe_unit(plan, *map(np.concatenate, zip(*held)))), _PROBES)
                    held, n = [], 0
        if held:
            yield _batch(list(_probe_unit(plan, *map(np.concatenate, zip(*held)))), _PROBES)

    return docs.mapInArrow(run, _PROBES)


def hits(sent: DataFrame, plan: ex.Plan) -> DataFrame:
    """Step 1, comparing: the repeated hashes by share of documents, (share, n, hashes)."""
    schema = "share int, n int, hashes binary"

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= 1 << plan.bits:
            return table.select(["share", "n", "hashes"])
        parts = [(ex.unpack_sorted(h, n), ex.unpack(s, n, 4), ex.unpack(f, n, 1))
                 for n, h, s, f in ex.groups_of(table, "n", "hashes", "shares", "flags")]
        cut, share, flags = map(np.concatenate, zip(*parts))
        order = np.argsort(cut)
        cut, share, flags = cut[order], share[order], flags[order]
        at = np.concatenate([[0], np.flatnonzero(cut[1:] != cut[:-1]) + 1])
        size = np.diff(np.append(at, len(cut)))
        block = np.bitwise_or.reduceat(flags & np.uint64(1), at) > 0
        keep = np.repeat(block & (size > 1), size)
        share, cut = ex.sort_pairs(share[keep], cut[keep], plan.bits + 8 * plan.rest, plan.share_bits)
        return pa.Table.from_batches([_batch([(s, b - a, ex.pack_sorted(cut[a:b])) for s, a, b in ex.slices(share)], schema)])

    return sent.groupBy("bucket").applyInArrow(run, schema)


def _place_unit(plan: ex.Plan, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
    """Rows of one unit: the earliest place of each window by bucket, all later ones as repeats by share."""
    order = np.lexsort((starts, ids, hashes))
    hashes, ids, starts = hashes[order], ids[order], starts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    # An equal place of a row with the same id is not an earlier one.
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (ids != ids[lead]) | (starts != starts[lead])
    first = np.flatnonzero(new)
    for bucket, a, b in ex.slices((hashes[first] >> np.uint64(64 - plan.bits)).astype(np.int64)):
        i = first[a:b]
        yield (bucket, -1, b - a, ex.pack_sorted(hashes[i]), ex.pack(ids[i].view(np.uint64), 8), ex.pack(starts[i].astype(np.uint64), 4))
    yield from _repeats(plan, ids[later], starts[later], buckets=1 << plan.bits)


def _repeats(plan: ex.Plan, ids: np.ndarray, starts: np.ndarray, buckets: int = 0) -> Iterator[tuple]:
    share = plan.share(ids)
    order = np.lexsort((starts, ids, share))
    ids, starts, share = ids[order], starts[order], share[order]
    for s, a, b in ex.slices(share):
        yield (buckets + s % buckets if buckets else -1, s, b - a, b"", ex.pack(ids[a:b].view(np.uint64), 8), ex.pack(starts[a:b].astype(np.uint64), 4))


def places(docs: DataFrame, found: DataFrame, plan: ex.Plan, window: int, block: int) -> DataFrame:
    """Step 2, sending: whole windows around hits."""
    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and known.num_rows:
            repeated = np.unique(np.concatenate([ex.unpack_sorted(h, n) for n, h in ex.groups_of(known, "n", "hashes")]))
            held = []
            for batch in own.combine_chunks().to_batches():
                ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
                for a, b, data, offsets in text_chunks(batch, "text"):
                    rows, _, _, hashes = words(data, offsets)
                    whole = window_rows(rows, window)
                    if not len(whole):
                        continue
                    probe = plan.cut(rolling(hashes, block))
                    hit = np.flatnonzero(window_rows(rows, block) & among(probe, repeated))
                    # A window starts at most window - block words before a hit that it holds.
                    near = covered(np.maximum(hit - (window - block), 0), window - block + 1, len(whole) + window)[:len(whole)]
                    at = np.flatnonzero(whole & near)
                    row = rows[at]
                    held.append((rolling(hashes, window)[at], ids[a:b][row], at - _first_words(rows, b - a)[row]))
            held = [h for h in held if len(h[0])]
            if held:
                out = list(_place_unit(plan, *map(np.concatenate, zip(*held))))
        return pa.Table.from_batches([_batch(out, _PLACES)])

    return docs.groupBy("share").cogroup(found.groupBy("share")).applyInArrow(run, _PLACES)


def repeats(sent: DataFrame, plan: ex.Plan) -> DataFrame:
    """Step 2, comparing: places whose window starts earlier elsewhere, (share, n, ids, starts)."""
    schema = "share int, n int, ids binary, starts binary"

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= 1 << plan.bits:
            return table.select(["share", "n", "ids", "starts"])
        parts = [(ex.unpack_sorted(h, n), ex.unpack(i, n, 8).view(np.int64), ex.unpack(s, n, 4).astype(np.int64))
                 for n, h, i, s in ex.groups_of(table, "n", "hashes", "ids", "starts")]
        hashes, ids, starts = map(np.concatenate, zip(*parts))
        order = np.lexsort((starts, ids, hashes))
        hashes, ids, starts = hashes[order], ids[order], starts[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (ids != ids[lead]) | (starts != starts[lead])
        rows = [row[1:3] + row[4:] for row in _repeats(plan, ids[later], starts[later])]
        return pa.Table.from_batches([_batch(rows, schema)])

    return sent.groupBy("bucket").applyInArrow(run, schema)


def without(docs: DataFrame, removed: DataFrame, window: int, schema: str) -> DataFrame:
    """Step 3: (id, n_words, n_removed, kept); kept words joined by one space."""
    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        places = [(ex.unpack(i, n, 8).view(np.int64), ex.unpack(s, n, 4).astype(np.int64))
                  for n, i, s in ex.groups_of(known, "n", "ids", "starts")]
        ids, starts = map(np.concatenate, zip(*places)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(ids, kind="stable")
        ids, starts = ids[order], starts[order]
        own_ids = own.column("id").to_numpy()
        out: list[tuple] = []
        texts = own.column("text").cast(pa.large_binary())
        for k, doc in enumerate(own_ids.tolist()):
            parts = (texts[k].as_py() or b"").split()
            a, b = np.searchsorted(ids, [doc, doc + 1] if doc < ex.NO_ID else [doc, doc], side="left")
            b = b if doc < ex.NO_ID else len(ids)
            gone = 0
            n = len(parts)
            if b > a:
                mask = covered(starts[a:b][starts[a:b] + window <= n], window, n)
                gone = int(mask.sum())
                parts = [parts[i] for i in np.flatnonzero(~mask)]
            out.append((n, gone, b" ".join(parts).decode("utf-8", "replace")))
        n_words, n_removed, kept = zip(*out) if out else ((), (), ())
        return pa.table({"id": own.column("id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return docs.groupBy("share").cogroup(removed.groupBy("share")).applyInArrow(run, schema)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_words, n_removed and the kept text."""
    if window < 2 * block - 1:
        raise ValueError("a window must be sure to hold a whole block: window >= 2 * block - 1")
    plan = ex.plan_for(docs, text)
    own = docs.select(ex.known_id(id_col).alias("id"), F.col(text).alias("text"))
    by_share = own.withColumn("share", ex.share_of("id", plan))
    found = hits(probes(own, plan, block), plan)
    removed = repeats(places(by_share, found, plan, window, block), plan)
    out = without(by_share, removed, window, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.nullif("id", F.lit(ex.NO_ID)).alias(id_col), "n_words", "n_removed", "kept")
