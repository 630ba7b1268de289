"""Remove byte strings that already stand in an earlier document, with suffix arrays.

A string of ``length`` bytes goes when the same bytes start in a document with a
smaller id.  The suffixes of a whole corpus fit no task, so they are dealt out by
content: each string of ``length`` bytes belongs to its anchor, the piece of ``gram``
bytes inside it with the smallest hash.  Equal strings have equal anchors.

1. Tasks send their distinct anchors to hash buckets; a bucket finds those that occur
   more than once (most do not, and their strings need no sorting).
2. Around each anchor found, the strings that belong to it are sent to the anchor's
   bucket as one stretch of text.  Of equal stretches, the documents after the first
   lose theirs at once, in the sending unit or in the bucket.  An anchor with more
   stretches than one sort takes is hot: its strings are sent one by one, each to the
   bucket of its own hash, so that equal strings still meet and others spread.
3. A bucket writes its stretches one after another and builds their suffix array by
   two-stage sorting (``suffix_array``).  Adjacent suffixes with a common prefix of
   ``length`` bytes are equal strings; all but the smallest id lose them.
4. Documents lose the bytes that such strings cover.

Results for odd rows: NULL is an empty text; texts shorter than ``length`` lose
nothing; documents without an id come after all others; rows that share an id take
nothing from each other; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import exchange as ex
from millwatch.llm.packed import among, mixed, rolling, text_chunks
from millwatch.llm.substring_dedup import _PROBES, _batch, _probe_unit
from millwatch.llm.suffix_array import common_prefixes, eights, suffix_array
from millwatch.session import stored

LENGTH, GRAM = 50, 24
_STRETCHES = "bucket int, share int, n int, hashes binary, ids binary, starts binary, counts binary, bytes binary"
_SPANS = "share int, n int, ids binary, starts binary, counts binary"
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
#: Bytes that a task looks at, and sorts, at a time; numbers per byte take some hundred times as much.
_CHUNK, _PART = 400_000, 800_000
#: Bytes of stretches after which a sending unit is handed over.
_UNIT_BYTES = 32_000_000
#: Stretches overlap, so a bucket of them holds a few times its share of the text.
_BUCKET_BYTES = 3_000_000


def _sliding(values: np.ndarray, k: int, choose) -> np.ndarray:
    """Smallest or largest of each k consecutive values."""
    size, level = 1, values
    while 2 * size <= k:
        level = choose(level[:len(level) - size], level[size:])
        size *= 2
    rest = k - size
    return choose(level[:len(level) - rest], level[rest:]) if rest else level


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, runs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the gram, its hash, first and last start of the strings it is the anchor of), over all texts.

    The hash is scrambled once more: anchors have the smallest ones, which would all fall into the first buckets.
    Without ``runs`` the last two are not worked out.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none
    span = length - gram + 1  # grams in a string
    grams = rolling(_BYTE[data], gram)
    least = _sliding(grams, span, np.minimum)
    inside = np.zeros(len(least), bool)
    sizes = np.diff(offsets)
    for a, n in zip(offsets[:-1][sizes >= length].tolist(), sizes[sizes >= length].tolist()):
        inside[a:a + n - length + 1] = True
    least[~inside] = 0  # strings across two texts have no anchor
    # A gram is an anchor if it is the least of some string around it.
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    place = np.flatnonzero(_sliding(padded, span, np.maximum)[:len(grams)] == grams)
    place = place[grams[place] != 0]
    own = grams[place]
    if not runs:
        return place, mixed(own), none, none
    # Its strings start in one run: between the nearest smaller grams on both sides.
    first, last = np.full(len(place), -1), np.full(len(place), -1)
    for back in range(span):
        start = place - back
        good = start >= 0
        good[good] = start[good] < len(least)
        good[good] = least[start[good]] == own[good]
        last = np.where(good & (last < 0), start, last)
        first = np.where(good, start, first)
    keep = last >= 0
    return place[keep], mixed(own[keep]), first[keep], last[keep]


def _anchor_probes(docs: DataFrame, plan: ex.Plan, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch, "text", _CHUNK):
                place, hashes, _, _ = anchors(data, offsets, length, gram, runs=False)
                if not len(place):
                    continue
                row = np.searchsorted(offsets, place, side="right") - 1
                held.append((plan.cut(hashes), plan.share(ids[a:b])[row], np.ones(len(place), bool)))
                n += len(place)
                if n >= ex.UNIT_HASHES:
                    yield _batch(list(_probe_unit(plan, *map(np.concatenate, zip(*held)), counted=True)), _PROBES)
                    held, n = [], 0
        if held:
            yield _batch(list(_probe_unit(plan, *map(np.concatenate, zip(*held)), counted=True)), _PROBES)

    return docs.mapInArrow(run, _PROBES)


def repeated_anchors(sent: DataFrame, plan: ex.Plan, most: int) -> DataFrame:
    """Step 1, comparing: repeated anchors by share of documents, (share, n, hashes); those of share -1 are hot.

    Units count in powers of two, so an anchor that is not hot stands in fewer than 2 * ``most`` places.
    """
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
        places = np.add.reduceat(np.uint64(1) << (flags >> np.uint64(2)), at)
        hot = cut[at[places >= most]]
        keep = np.repeat(size > 1, size)
        share, cut = ex.sort_pairs(share[keep], cut[keep], plan.bits + 8 * plan.rest, plan.share_bits)
        rows = [(s, b - a, ex.pack_sorted(cut[a:b])) for s, a, b in ex.slices(share)]
        return pa.Table.from_batches([_batch(rows + [(-1, len(hot), ex.pack_sorted(hot))] * (len(hot) > 0), schema)])

    return sent.groupBy("bucket").applyInArrow(run, schema)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after another."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _pack_spans(plan: ex.Plan, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """(share, n, ids, starts, counts): ``counts`` strings in a row start at ``starts``."""
    share = plan.share(ids)
    order = np.lexsort((starts, ids, share))
    ids, starts, counts, share = ids[order], starts[order], counts[order], share[order]
    return [(s, b - a, ex.pack(ids[a:b].view(np.uint64), 8), ex.pack(starts[a:b].astype(np.uint64), 4), ex.pack(counts[a:b].astype(np.uint64), 4))
            for s, a, b in ex.slices(share)]


def _later(content: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have the content of an entry with a smaller id."""
    order = np.lexsort((ids, content))
    c, i = content[order], ids[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(c), bool)
    out[order] = i != i[lead]
    return out


def _stretch_hash(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of a gathered text."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    from millwatch.llm.packed import _M, _powers
    begin = np.cumsum(sizes) - sizes
    power = _powers(_M, int(sizes.max()))
    values = _BYTE[text] * power[np.arange(len(text)) - np.repeat(begin, sizes)]
    return mixed(np.add.reduceat(values, begin) + sizes.astype(np.uint64))


def _single_strings(plan: ex.Plan, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray,
                    length: int) -> tuple[tuple, tuple]:
    """The strings that start from ``first`` to ``last`` as stretches of one, dealt by their own hash; spans of equal later ones."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    at = np.flatnonzero(np.cumsum(edge))
    own = rolling(_BYTE[data], length)[at]
    row = np.searchsorted(offsets, at, side="right") - 1
    start, doc = at - offsets[row], ids[row]
    later = _later(own, doc)
    gone = np.flatnonzero(later)
    new = np.ones(len(gone), bool)
    new[1:] = (at[gone[1:]] != at[gone[:-1]] + 1) | (row[gone[1:]] != row[gone[:-1]])
    lead = np.flatnonzero(new)
    spans = (doc[gone[lead]], start[gone[lead]], np.diff(np.append(lead, len(gone))))
    keep = ~later
    text = np.lib.stride_tricks.sliding_window_view(data, length)[at[keep]].reshape(-1)
    n = int(keep.sum())
    return (plan.cut(own[keep]), doc[keep], start[keep], np.ones(n, np.int64), np.full(n, length), own[keep], text), spans


def stretches(docs: DataFrame, found: DataFrame, hot: np.ndarray, plan: ex.Plan, length: int, gram: int) -> DataFrame:
    """Step 2: the text around repeated anchors by bucket, and spans that the unit settles, by share."""
    buckets = 1 << plan.bits

    def settled(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[tuple]:
        return [(buckets + s % buckets, s, n, b"", i, at, c, b"") for s, n, i, at, c in _pack_spans(plan, ids, starts, counts)]

    def unit(parts: list[tuple]) -> list[tuple]:
        cut, ids, starts, counts, sizes, content, text = map(np.concatenate, zip(*parts))
        parts.clear()
        later = _later(content, ids)
        out = settled(ids[later], starts[later], counts[later])
        begin = np.cumsum(sizes) - sizes
        keep = np.flatnonzero(~later)
        keep = keep[np.argsort(cut[keep], kind="stable")]
        for bucket, a, b in ex.slices(plan.bucket(cut[keep])):
            k = keep[a:b]
            out.append((bucket, -1, b - a, ex.pack_sorted(cut[k]), ex.pack(ids[k].view(np.uint64), 8),
                        ex.pack(starts[k].astype(np.uint64), 4), ex.pack(counts[k].astype(np.uint64), 4),
                        pa.compress(_gather(text, begin[k], sizes[k]).tobytes(), codec="zstd", asbytes=True)))
        return out

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and known.num_rows:
            repeated = np.unique(np.concatenate([ex.unpack_sorted(h, n) for n, h in ex.groups_of(known, "n", "hashes")]))
            parts, held = [], 0
            for batch in own.combine_chunks().to_batches():
                ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
                for a, b, data, offsets in text_chunks(batch, "text", _CHUNK):
                    place, hashes, first, last = anchors(data, offsets, length, gram)
                    if not len(place):
                        continue
                    cut = plan.cut(hashes)
                    hit = among(cut, repeated)
                    cut, first, last = cut[hit], first[hit], last[hit]
                    single = among(cut, hot)
                    if single.any():
                        part, spans = _single_strings(plan, data, offsets, ids[a:b], first[single], last[single], length)
                        parts.append(part)
                        held += len(part[-1])
                        out += settled(*spans)
                        cut, first, last = cut[~single], first[~single], last[~single]
                    row = np.searchsorted(offsets, first, side="right") - 1
                    sizes = last - first + length
                    text = _gather(data, first, sizes)
                    parts.append((cut, ids[a:b][row], first - offsets[row], last - first + 1, sizes, _stretch_hash(text, sizes), text))
                    held += len(text)
                    if held >= _UNIT_BYTES:
                        out += unit(parts)
                        held = 0
            if parts:
                out += unit(parts)
        return pa.Table.from_batches([_batch(out, _STRETCHES)])

    return docs.groupBy("share").cogroup(found.groupBy("share")).applyInArrow(run, _STRETCHES)


def repeated_strings(ids: np.ndarray, counts: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings whose equal stands in a smaller id: (stretch, offset of the first, how many in a row).

    ``text`` holds the stretches one after another, ``counts`` strings each.
    """
    sizes = counts + length - 1
    begin = np.cumsum(sizes) - sizes
    keys = eights(text)
    order = suffix_array(text, length, keys)
    owner = np.repeat(np.arange(len(counts)), sizes)
    offset = np.arange(len(text)) - begin[owner]
    order = order[offset[order] < counts[owner[order]]]  # places where a whole string starts
    same = common_prefixes(keys, order, length) >= length
    group = np.cumsum(~same) - 1
    id_of = ids[owner[order]]
    least = np.minimum.reduceat(id_of, np.flatnonzero(~same)) if len(order) else id_of
    gone = np.sort(order[id_of > least[group]])
    if not len(gone):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.ones(len(gone), bool)
    new[1:] = (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])
    at = np.flatnonzero(new)
    return owner[gone[at]], offset[gone[at]], np.diff(np.append(at, len(gone)))


def settle(sent: DataFrame, plan: ex.Plan, length: int) -> DataFrame:
    """Step 3: spans of strings that stand in an earlier document, (share, n, ids, starts, counts)."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= 1 << plan.bits:
            return table.select(["share", "n", "ids", "starts", "counts"])
        parts = []
        for n, h, i, s, c, raw in ex.groups_of(table, "n", "hashes", "ids", "starts", "counts", "bytes"):
            counts = ex.unpack(c, n, 4).astype(np.int64)
            size = int((counts + length - 1).sum())
            text = np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
            parts.append((ex.unpack_sorted(h, n), ex.unpack(i, n, 8).view(np.int64), ex.unpack(s, n, 4).astype(np.int64), counts,
                          _stretch_hash(text, counts + length - 1), text))
        cut, ids, starts, counts, content, text = map(np.concatenate, zip(*parts))
        parts.clear()
        sizes = counts + length - 1
        later = _later(content, ids)
        spans = [(ids[later], starts[later], counts[later])]
        begin, keep = np.cumsum(sizes) - sizes, np.flatnonzero(~later)
        keep = keep[np.argsort(cut[keep], kind="stable")]
        # An anchor's strings (a hot anchor's: a hash's) equal only each other, so a bucket may be sorted in parts, between two of them.
        size = np.cumsum(sizes[keep])
        ends = np.flatnonzero(np.append(cut[keep][1:] != cut[keep][:-1], True)) + 1
        a = 0
        while a < len(keep):
            base = size[a - 1] if a else 0
            fit = ends[(ends > a) & (size[ends - 1] - base <= _PART)]
            b = int(fit[-1]) if len(fit) else int(ends[ends > a][0])
            k = keep[a:b]
            stretch, offset, many = repeated_strings(ids[k], counts[k], _gather(text, begin[k], sizes[k]), length)
            spans.append((ids[k][stretch], starts[k][stretch] + offset, many))
            a = b
        rows = _pack_spans(plan, *map(np.concatenate, zip(*spans)))
        return pa.Table.from_batches([_batch(rows, _SPANS)])

    return sent.groupBy("bucket").applyInArrow(run, _SPANS)


def without(docs: DataFrame, spans: DataFrame, length: int, schema: str) -> DataFrame:
    """Step 4: (id, n_bytes, n_removed, n_spans, kept)."""
    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        parts = [(ex.unpack(i, n, 8).view(np.int64), ex.unpack(s, n, 4).astype(np.int64), ex.unpack(c, n, 4).astype(np.int64))
                 for n, i, s, c in ex.groups_of(known, "n", "ids", "starts", "counts")]
        ids, starts, counts = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        order = np.argsort(ids, kind="stable")
        ids, starts, counts = ids[order], starts[order], counts[order]
        texts = own.column("text").cast(pa.large_binary())
        out = []
        for k, doc in enumerate(own.column("id").to_pylist()):
            raw = texts[k].as_py() or b""
            a, b = np.searchsorted(ids, doc, side="left"), np.searchsorted(ids, doc, side="right")
            removed = spans_ = 0
            kept = raw
            if b > a:
                edge = np.zeros(len(raw) + 1, np.int64)
                end = starts[a:b] + counts[a:b] + length - 1
                fits = end <= len(raw)
                np.add.at(edge, starts[a:b][fits], 1)
                np.add.at(edge, end[fits], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                spans_ = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), removed, spans_, kept))
        n_bytes, n_removed, n_spans, kept = zip(*out) if out else ((), (), (), ())
        return pa.table({"id": own.column("id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return docs.groupBy("share").cogroup(spans.groupBy("share")).applyInArrow(run, schema)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes."""
    plan = ex.plan_for(docs, text, bucket_bytes=_BUCKET_BYTES)
    own = docs.select(ex.known_id(id_col).alias("id"), F.col(text).alias("text"))
    by_share = own.withColumn("share", ex.share_of("id", plan))
    # A stretch has at most 2 * length - gram bytes: those of an anchor that is not hot fit in one part.
    found = stored(repeated_anchors(_anchor_probes(own, plan, length, gram), plan, _PART // (4 * length - 2 * gram)), "anchors")
    # At most the bytes of all stretches divided by _PART / 2.
    rows = found.filter("share = -1").collect()
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(ex.unpack_sorted(r["hashes"], r["n"]) for r in rows)]))
    spans = settle(stretches(by_share, found.filter("share >= 0"), hot, plan, length, gram), plan, length)
    out = without(by_share, spans, length, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.nullif("id", F.lit(ex.NO_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
