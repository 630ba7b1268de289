"""N-gram Jaccard join: size-aware, heavy and light sets, exact.

Two documents link when their sets of word shingles have a Jaccard similarity of at
least ``similar`` percent.  A link needs an overlap of at least ``similar`` percent of
either set, so in any common order of shingles, the first ``n - need + k`` shingles of
both sets (``need``: that overlap, rounded up) share at least k.

* Light sets (fewer shingles than a boundary) enumerate all subsets of k = 2 of that
  prefix; two light sets that link share such a subset.
* Heavy sets scan the inverted lists of the shingles of their prefix for k = 1, which
  also hold the light sets that are large enough to link with a heavy one.

The order is by document frequency, rare first; frequencies are counted over all
documents.  A shingle of frequency one cannot be shared: it takes a place in the
prefix and is never sent on, and a document whose prefix is full of such shingles has
no partner.  The boundary is the size at which the counted cost of enumerating below
and scanning above is least.  Either way the cost is in rows of keys, which are shuffled and
sorted; the pairs within a list are compared by bits in a join and cost a small part of
a row each, so one large group of variants does not make all smaller sets light, with
many times the rows.

Equal sets are one node from the start.  Among the nodes of a subset or list, all are
first compared with its most central one; components of those links come next; only
nodes that are still in different components are then compared with each other, so a
large group of near copies costs one comparison a member, and no link between
components is missed.  Two bounds keep pairs that cannot link from being made at all.  A
set with ``alone`` shingles of its own shares at most ``n - alone``; it leaves the keys whose
sets are all too large for that.  And what two sets of a key share lies within what each
shares with the centre, which has been counted, or beside it.  Where the first part alone
is too little for a link, both sets must hold the same shingle beside the centre, and
only sets that do are paired: near copies that differ in places of their own are not.
Each set also carries ``PARITY`` bits, each the parity of how many of its shingles fall
there.  Two sets differ in at least as many shingles as their bits differ, so the join
that pairs sets leaves out those whose bits differ in too many for a link: of texts of
one template with scattered edits it makes next to no pair that does not link.  The
bits are compared within the join; sets much larger than ``PARITY`` fill them and are
compared in full instead.

Results for odd rows: NULL texts and texts without words have an empty set and link
with nothing, each its own component; documents without an id come after all others
and are told apart by text only; rows that share an id have a set and a component
each; an empty table gives an empty result.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm import exchange as ex
from millwatch.llm.packed import LOWER, among, mixed, rolling, text_chunks, window_rows, words
from millwatch.llm.substring_dedup import _batch
from millwatch.session import stored

SHINGLE, SIMILAR = 4, 85
#: Words of 64 parity bits of a set.
PARITY_WORDS = 8
PARITY = 64 * PARITY_WORDS
_PARITY = [f"parity_{i}" for i in range(PARITY_WORDS)]
#: What a scanned key costs in enumerated ones, which seldom meet another set and are not looked at again.
SCANNED = 4
#: So many comparisons of two sets' bits within a list cost as much as an enumerated key.
COMPARISONS = 64
_SENT = "bucket int, n int, hashes binary, shares binary, counts binary"
_KNOWN = "share int, n int, hashes binary, counts binary"
_SETS = ("id bigint, n bigint, node bigint, alone int, listed binary, n_listed int, order binary, enumerate double, scan double, "
         + ", ".join(f"{p} bigint" for p in _PARITY))


class Sets(NamedTuple):
    """The distinct shingles of some texts, by text and hash."""

    row: np.ndarray
    hash: np.ndarray
    size: np.ndarray


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Sets:
    n = len(offsets) - 1
    rows, _, _, hashes = words(LOWER[data], offsets)
    at = np.flatnonzero(window_rows(rows, shingle))
    row, value = rows[at], rolling(hashes, shingle)[at]
    count = np.bincount(rows, minlength=n)
    for k in range(1, shingle):  # shorter texts: the whole sequence is the one shingle
        first = np.searchsorted(rows, np.flatnonzero(count == k))
        if len(first):
            row = np.concatenate([row, rows[first]])
            value = np.concatenate([value, mixed(rolling(hashes, k)[first] + np.uint64(k))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return Sets(row, value, np.bincount(row, minlength=n))


def parities(hashes: np.ndarray) -> list[int]:
    """``PARITY`` bits of a set: bit i is set where an odd number of hashes fall on i."""
    odd = np.bincount((mixed(hashes) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def needed(n: np.ndarray, similar: int) -> np.ndarray:
    """The smallest overlap of a set of n with any set it links with."""
    return -(-n * similar // 100)


def _send_counts(docs: DataFrame, plan: ex.Plan, shingle: int) -> DataFrame:
    """How many documents of a unit have each shingle, by bucket of shingles, for each share."""
    def unit(held: list) -> pa.RecordBatch:
        cut, share = map(np.concatenate, zip(*held))
        cut, share = ex.sort_pairs(cut, share, plan.share_bits, plan.bits + 8 * plan.rest)
        at = np.concatenate([[0], np.flatnonzero((cut[1:] != cut[:-1]) | (share[1:] != share[:-1])) + 1])
        count = np.diff(np.append(at, len(cut))).astype(np.uint64)
        cut, share = cut[at], share[at]
        return _batch([(bucket, b - a, ex.pack_sorted(cut[a:b]), ex.pack(share[a:b], 4), ex.pack(count[a:b], 4))
                       for bucket, a, b in ex.slices(plan.bucket(cut))], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch, "text"):
                sets = shingle_sets(data, offsets, shingle)
                if len(sets.row):
                    held.append((plan.cut(sets.hash), plan.share(ids[a:b])[sets.row]))
                    n += len(sets.row)
                if n >= ex.UNIT_HASHES:
                    yield unit(held)
                    held, n = [], 0
        if held:
            yield unit(held)

    return docs.mapInArrow(run, _SENT)


def _frequencies(sent: DataFrame, plan: ex.Plan) -> DataFrame:
    """Shingles of at least two documents with their frequency, for the shares that have them."""
    def run(table: pa.Table) -> pa.Table:
        parts = [(ex.unpack_sorted(h, n), ex.unpack(s, n, 4), ex.unpack(c, n, 4))
                 for n, h, s, c in ex.groups_of(table, "n", "hashes", "shares", "counts")]
        cut, share, count = map(np.concatenate, zip(*parts))
        order = np.argsort(cut)
        cut, share, count = cut[order], share[order], count[order]
        at = np.concatenate([[0], np.flatnonzero(cut[1:] != cut[:-1]) + 1])
        size = np.diff(np.append(at, len(cut)))
        total = np.repeat(np.add.reduceat(count, at), size)
        keep = total > 1
        cut, share, total = cut[keep], share[keep], total[keep]
        order = np.lexsort((cut, share))
        cut, share, total = cut[order], share[order], total[order]
        new = np.ones(len(cut), bool)
        new[1:] = (cut[1:] != cut[:-1]) | (share[1:] != share[:-1])
        cut, share, total = cut[new], share[new], total[new]
        rows = [(s, b - a, ex.pack_sorted(cut[a:b]), ex.pack(total[a:b], 4)) for s, a, b in ex.slices(share)]
        return pa.Table.from_batches([_batch(rows, _KNOWN)])

    return sent.groupBy("bucket").applyInArrow(run, _KNOWN)


def _set_rows(docs: DataFrame, known: DataFrame, plan: ex.Plan, shingle: int, similar: int) -> DataFrame:
    """One row per document: size, node, and for those that may have partners their shared shingles.

    ``alone``: how many shingles no other document has; ``listed``: the others, sorted;
    ``order``: the places in ``listed`` of the prefix for k = 2, rare first.
    A column ``sign`` of the documents passes through.
    """
    signed = "sign" in docs.columns
    schema = _SETS + ", sign bigint" * signed

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        parts = [(ex.unpack_sorted(h, n), ex.unpack(c, n, 4)) for n, h, c in ex.groups_of(known, "n", "hashes", "counts")]
        cut, total = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        order = np.argsort(cut)
        cut, total = cut[order], total[order]
        out, signs = [], []
        for batch in own.combine_chunks().to_batches():
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            if signed:
                signs.append(batch.column(batch.schema.get_field_index("sign")))
            for a, b, data, offsets in text_chunks(batch, "text"):
                sets = shingle_sets(data, offsets, shingle)
                value = plan.cut(sets.hash)
                at = np.minimum(np.searchsorted(cut, value), max(len(cut) - 1, 0))
                shared = cut[at] == value if len(cut) else np.zeros(len(value), bool)
                frequency = np.where(shared, total[at], 1) if len(cut) else np.ones(len(value), np.uint64)
                bounds = np.searchsorted(sets.row, np.arange(b - a + 1))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets.hash), dtype=np.uint64)])
                nodes = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sets.size.astype(np.uint64)).view(np.int64)
                listed = np.concatenate([[0], np.cumsum(shared)])
                n_listed = listed[bounds[1:]] - listed[bounds[:-1]]
                alone = sets.size - n_listed
                spare = sets.size - needed(sets.size, similar)
                for k in range(b - a):
                    row = (int(ids[a + k]), int(sets.size[k]), int(nodes[k]), int(alone[k]))
                    if not sets.size[k] or alone[k] > spare[k]:  # the prefix for k = 1 is full of shingles without a partner
                        out.append((*row, None, 0, None, 0.0, 0.0, *[None] * PARITY_WORDS))
                        continue
                    i = bounds[k] + np.flatnonzero(shared[bounds[k]:bounds[k + 1]])
                    f = frequency[i]
                    rank = np.lexsort((value[i], f))[:spare[k] + 2 - alone[k]]
                    m, scanned = len(rank), f[rank[:spare[k] + 1 - alone[k]]]
                    out.append((*row, ex.pack_sorted(np.sort(value[i]), 8), len(i), ex.pack(np.argsort(np.argsort(value[i]))[rank].astype(np.uint64), 4),
                                m * (m - 1) / 2, float(SCANNED * len(scanned) + scanned.sum() / COMPARISONS), *parities(value[bounds[k]:bounds[k + 1]])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.float64(),
                 *[pa.int64()] * PARITY_WORDS]
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        names = [c.split()[0] for c in _SETS.split(", ")]
        out = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        return out.append_column("sign", pa.chunked_array(signs, pa.int64())) if signed else out

    return docs.groupBy("share").cogroup(known.groupBy("share")).applyInArrow(run, schema)


def choose_boundary(nodes: DataFrame) -> int:
    """The size from which sets are heavy: least cost of enumerating below and scanning from there.

    Costs are summed by size, in steps of a tenth, before they reach the driver: some 200 rows at most.
    """
    step = F.floor(F.log("n") / F.log(F.lit(1.1))).cast("int")
    rows = sorted((r["step"], r["e"], r["s"]) for r in nodes.filter("listed is not null").groupBy(step.alias("step")).agg(
        F.sum("enumerate").alias("e"), F.sum("scan").alias("s")).collect())
    best, boundary, below, above = None, 1, 0.0, sum(s for _, _, s in rows)
    for step_, e, s in [(0, 0.0, 0.0), *rows]:
        below, above = below + e, above - s
        if best is None or below + above < best:
            best, boundary = below + above, int(1.1 ** (step_ + 1)) + 1
    return boundary


def _keys(nodes: DataFrame, boundary: int, similar: int) -> DataFrame:
    """(key, node, alone, n), each once: subsets of two for light sets, single shingles for heavy ones and those near them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, lone, sizes = [], [], [], []
            for node, n, alone, n_listed, listed, order in zip(*(batch.column(c).to_pylist() for c in (
                    "node", "n", "alone", "n_listed", "listed", "order"))):
                spare = n - int(needed(np.int64(n), similar))
                m = min(n_listed, spare + 2 - alone)
                prefix = ex.unpack_sorted(listed, n_listed)[ex.unpack(order, m, 4).astype(np.int64)]
                found = []
                if n < boundary:
                    i, j = np.triu_indices(m, 1)
                    x, y = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
                    found.append(mixed(mixed(x) * np.uint64(3) + y))
                if n >= boundary or 100 * n >= similar * boundary:
                    found.append(mixed(prefix[:spare + 1 - alone] + np.uint64(1)))
                keys.append(np.unique(np.concatenate(found)))
                owners.append(np.full(len(keys[-1]), node))
                lone.append(np.full(len(keys[-1]), alone))
                sizes.append(np.full(len(keys[-1]), n))
            if keys:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners), pa.int64()),
                    pa.array(np.concatenate(lone), pa.int64()), pa.array(np.concatenate(sizes), pa.int64())], ["key", "node", "alone", "n"])

    return nodes.mapInArrow(run, "key bigint, node bigint, alone bigint, n bigint")


def _largest_partner(similar: int) -> Column:
    """The largest set that a set of ``n`` with ``alone`` shingles of its own can link with."""
    shared = F.col("n") - F.col("alone")
    return F.expr(f"(100 * (n - alone)) div {similar}") + shared - F.col("n")


def _compared(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b): size of the overlap, the other shared shingles of b, and whether a and b reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, known = [], None, None
            for a, b, na, ka, la, nb, kb, lb in zip(*(batch.column(c).to_pylist() for c in (
                    "a", "b", "n_a", "k_a", "l_a", "n_b", "k_b", "l_b"))):
                if a != last:
                    last, known = a, ex.unpack_sorted(la, ka)
                own = ex.unpack_sorted(lb, kb)
                same = among(own, known)
                both = int(same.sum())
                out.append((a, b, both, own[~same].view(np.int64), 100 * both >= similar * (na + nb - both)))
            columns = zip(*out) if out else ((), (), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["a", "b", "both", "others", "linked"])

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("n_listed").alias(f"k_{s}"),
                                  F.col("listed").alias(f"l_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select(
        "a", "b", "n_a", "k_a", "l_a", "n_b", "k_b", "l_b").mapInArrow(run, "a bigint, b bigint, both bigint, others array<bigint>, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node that links reach.

    Labels spread along links and then jump to their label's label, so that a chain of
    length n takes about log n rounds; each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_near"))
        spread = labels.join(near, F.col("node") == F.col("_n")).select("node", "label", F.least("label", "_near").alias("_to"))
        at = labels.select(F.col("node").alias("_at"), F.col("label").alias("_further"))
        moved = stored(spread.join(at, F.col("_to") == F.col("_at")).select(
            "node", F.least("_to", "_further").alias("label"), (F.least("_to", "_further") != F.col("label")).alias("_changed")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("_changed").limit(1).count():
            return labels


def _labelled(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys of which the nodes are in different components, with each node's component."""
    found = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ = found.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a != _b").select("key")
    return found.join(mixed_, "key")


def _open_pairs(keys: DataFrame, compared: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """(a, b): pairs of different components that share a key and may link.

    Within a key, what each set shares with the centre bounds the overlap, but for
    shingles that both hold beside the centre.  So pairs for which that bound is
    enough come from the keys, all others from the shingles beside their centre.
    Either way the parity bits of the two sets must be as close as a link needs.
    """
    seen = compared.select(F.col("a").alias("centre"), F.col("b").alias("node"), "both", "others")
    found = stored(keys.join(seen.drop("others"), ["centre", "node"], "left").join(nodes.select("node", *_PARITY), "node").select(
        "key", "centre", "node", "label", "n", F.coalesce("both", F.col("n") - F.col("alone")).alias("within"), *_PARITY), "open-keys")
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"_{p}"))) for p in _PARITY), F.lit(0))

    def paired(rows: DataFrame, on: list[str], most: Column) -> DataFrame:
        other = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
        both = F.col("n") + F.col("_n")
        apart = (F.col("label") < F.col("_label")) & (100 * most >= similar * (both - most))
        apart = apart & ((100 + similar) * differ <= (100 - similar) * both)
        for c in on:
            apart = apart & (F.col(c) == F.col(f"_{c}"))
        return rows.join(other, apart).select(F.col("node").alias("a"), F.col("_node").alias("b"))

    within = F.least("within", "_within")
    inside = paired(found.drop("centre"), ["key"], within)
    members = found.drop("key").distinct().join(seen.drop("both"), ["centre", "node"])
    beside = members.select(*[c for c in found.columns if c != "key"], F.size("others").alias("others"), F.explode("others").alias("shingle"))
    outside = paired(beside, ["centre", "shingle"], within + F.least("others", "_others"))
    return inside.unionByName(outside).distinct()


def link_nodes(nodes: DataFrame, similar: int) -> DataFrame:
    """(node, label) of all nodes with a link; ``nodes``: distinct sets with their shared shingles."""
    keys = _keys(nodes, choose_boundary(nodes), similar)
    # The centre of a key: most of its shingles are shared; ties by node.
    centre = keys.groupBy("key").agg(
        F.min_by("node", F.struct("alone", "node")).alias("centre"), F.min("n").alias("_least"), F.count(F.lit(1)).alias("_n"))
    keys = stored(keys.join(centre.filter("_n > 1"), "key").filter(_largest_partner(similar) >= F.col("_least")).select(
        "key", "node", "alone", "n", "centre"), "keys")
    star = keys.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    compared = stored(_compared(star, nodes, similar), "compared")
    edges = compared.filter("linked").select("a", "b")
    labels = components(edges)
    pairs = _open_pairs(_labelled(keys, labels), compared, nodes, similar)
    tested = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = stored(_compared(pairs.join(tested, ["a", "b"], "left_anti"), nodes, similar).filter("linked").select("a", "b"), "edges")
    return components(edges.unionByName(more)) if more.limit(1).count() else labels


def signature(text: str) -> Column:
    """Tells texts of one id, or without an id, apart."""
    return F.xxhash64(text)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                       similar: int = SIMILAR, signed: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach).

    With ``signed`` also ``sign``, which is ``signature`` of the text, and ``component_sign``,
    the smallest one among the rows of the component that have its smallest id.
    """
    plan = ex.plan_for(docs, text, rest=5)
    own = docs.select(ex.known_id(id_col).alias("id"), F.col(text).alias("text"))
    by_share = own.withColumn("share", ex.share_of("id", plan))
    sign = ["sign"] * signed
    if signed:
        by_share = by_share.withColumn("sign", signature("text"))
    known = _frequencies(_send_counts(own, plan, shingle), plan)
    sets = stored(_set_rows(by_share, known, plan, shingle, similar), "sets")
    # Equal sets are one node; any of their rows has its shingles.
    nodes = stored(sets.filter("listed is not null").groupBy("node").agg(F.min_by(
        F.struct("n", "alone", "listed", "n_listed", "order", "enumerate", "scan", *_PARITY), "id").alias("one")).select("node", "one.*"), "nodes")
    labels = link_nodes(nodes, similar)
    placed = sets.select("id", "n", "node", *sign).join(labels, "node", "left").select(
        "id", "n", *sign, F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    smallest = placed.filter("label is not null").groupBy("label").agg(
        F.min("id").alias("component"), *([F.min(F.struct("id", "sign"))["sign"].alias("_least")] * signed))
    out = placed.join(smallest, "label", "left")
    return out.select(
        F.nullif("id", F.lit(ex.NO_ID)).alias(id_col), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "id"), F.lit(ex.NO_ID)).alias("component_id"),
        *([F.col("sign"), F.coalesce("_least", "sign").alias("component_sign")] if signed else []))
