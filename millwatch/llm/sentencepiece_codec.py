"""SentencePiece encoding with byte spans, and decoding.

Normalisation is a longest-prefix rewriting by the model's compiled character map: a
double-array trie that is walked for all positions of a chunk of texts at once.  Each
normalised byte keeps the byte of the text that it comes from.  Pieces are merged in
the order of their scores inside words that no piece of the vocabulary can cross, and
every piece is projected back to the bytes of the original text through that
alignment.  Every row is worked where it is: no shuffle, no join.

Only BPE models with byte fallback and without user-defined pieces or spaces as suffixes
are taken; others are refused with ``ValueError``.  A model file is read by the driver
and sent with the tasks; its size does not depend on the input.

Results for odd rows: NULL and empty texts have no pieces and decode to the empty text;
repeated rows and repeated or missing ids give a row each; a text is never cut, however
long; an empty table gives an empty table.  There are no ties: pieces of equal score
merge from the left.  Only the id and the text are read, so no other column can clash,
and none is carried: the result's own columns follow the id.
"""

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
_SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)
#: Texts are worked in chunks of about so many bytes (a longer text is a chunk of its own).
_CHUNK = 2_000_000
#: Words remembered by a task; beyond, it starts anew.
_REMEMBERED = 300_000
#: Words of at most so many characters are merged together, in tables of these widths; longer ones apart.
_SHORT, _WIDTHS = 32, (1, 2, 4, 8, 16, 32)
_NEVER = 1 << 40

codecs.register_error("one_sign_a_byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharMap:
    """The compiled character map: longest prefixes and what they become."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").astype(np.int64)
        self.targets = blob[4 + size:]
        self._known: dict[int, bytes] = {}

    def target(self, at: int) -> bytes:
        if at not in self._known:
            self._known[at] = self.targets[at:self.targets.index(b"\0", at)]
        return self._known[at]

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, target) of the prefixes that a reading from the left replaces.

        ``limit`` is the end of the row that each byte is in.
        """
        at = np.flatnonzero((data & 0xC0) != 0x80)
        length, value = np.zeros(len(data), np.int32), np.zeros(len(data), np.int64)
        if not len(self.units):
            at = at[:0]
        node, depth = np.full(len(at), self._child(self.units[:1]).sum()), 0
        while len(at):
            inside = at + depth < limit[at]
            at, node = at[inside], node[inside]
            byte = data[at + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[node]
            same = (unit & (1 << 31 | 0xFF)) == byte
            at, node, unit = at[same], node[same], unit[same]
            node = node ^ self._child(unit)
            depth += 1
            leaf = (unit >> 8 & 1) == 1
            length[at[leaf]] = depth
            value[at[leaf]] = self.units[node[leaf]] & (1 << 31) - 1
        start = np.flatnonzero(length)
        end = start + length[start]
        if (start[1:] < end[:-1]).any():  # a match may start inside another one
            taken, free = [], 0
            for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
                if a >= free:
                    taken.append(i)
                    free = b
            start = start[taken]
        return start, length[start], value[start]


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Codec:
    """A model's normaliser, merges and decoder."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto.FromString(model)
        trainer, norm, kinds = proto.trainer_spec, proto.normalizer_spec, pb.ModelProto.SentencePiece
        if (trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)):
            raise ValueError("only BPE models with byte fallback and without own pieces or suffixed spaces are supported")
        self.map = CharMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        usual = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        ranks = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.ids = usual
        self.rank = {piece: ranks[proto.pieces[i].score] for piece, i in usual.items()}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.surface = np.array([self._surface(p, kinds, trainer.unk_surface) for p in proto.pieces], object)
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.spaced = {i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL and p.piece.startswith(SPACE)}
        self.words = re.compile(self._word_pattern([p for p in usual if len(p) > 1]))
        self.rank_of = np.array([self.rank.get(p.piece, _NEVER) for p in proto.pieces], np.int64)
        self.size_of = np.array([len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.sign = np.full(0x110000, -1, np.int64)
        single = [(ord(p), i) for p, i in usual.items() if len(p) == 1]
        self.sign[[c for c, _ in single]] = [i for _, i in single]
        pairs = {usual[p[:k]] << 32 | usual[p[k:]]: i for p, i in usual.items() for k in range(1, len(p)) if p[:k] in usual and p[k:] in usual}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self._forget()

    @staticmethod
    def _surface(piece, kinds, unknown: str) -> bytes:
        if piece.type == kinds.BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == kinds.CONTROL:
            return b""
        return (unknown if piece.type == kinds.UNKNOWN else piece.piece.replace(SPACE, " ")).encode()

    @staticmethod
    def _word_pattern(pieces: list[str]) -> str:
        """Stretches that no merge can cross: no piece holds the two characters at a boundary side by side."""
        joined = {c for p in pieces for c in p}
        after = any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:]))
        inner = "[" + "".join(map(re.escape, sorted(joined if after else joined - {SPACE}))) + "]"
        return f"(?s:{inner}+|.)" if after else f"(?s:{SPACE}*{inner}+|{SPACE}+|.)"

    def _forget(self) -> None:
        self.number = _Numbers()
        self.flat_ids, self.flat_sizes, self.many = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, origin of each, row offsets); origins have one more entry a row, its end.

        Origins count from the row's first byte; row ``i`` of them starts at ``offsets[i] + i``.
        """
        rows, size = len(offsets) - 1, len(data)
        row_of = _rows(offsets)
        start, length, value = self.map.longest(data, offsets[1:][row_of] if size else row_of)
        head = (data & 0xC0) != 0x80  # first bytes of what is read at once
        inside = np.zeros(size + 1, np.int8)
        inside[start] += 1
        np.subtract.at(inside, start + length, 1)
        matched = np.cumsum(inside[:-1]) > 0
        head[matched] = False
        head[start] = True
        targets = [self.map.target(v) for v in value.tolist()]
        width = np.where(matched, 0, 1)
        width[start] = [len(t) for t in targets]
        origin = np.repeat(np.arange(size), width)
        out = data[origin]
        place = np.cumsum(width) - width
        if targets:
            wide = width[start]
            out[np.repeat(place[start] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())] = np.frombuffer(b"".join(targets), np.uint8)
        single = ~matched & (data == 0x20)
        single[start] = [t == b" " for t in targets]
        row = row_of[origin]
        blank = out == 0x20
        # Where reading starts: after spaces in front, if these go.
        first = offsets[:-1].copy()
        if self.squeeze:
            solid = np.append(np.flatnonzero(head & ~single), size)
            first = np.minimum(solid[np.searchsorted(solid, offsets[:-1])], offsets[1:])
            chunk = np.cumsum(head)[origin] if len(origin) else origin
            new = np.ones(len(out), bool)
            new[1:] = chunk[1:] != chunk[:-1]
            fresh = np.ones(len(out), bool)
            fresh[1:] = row[1:] != row[:-1]
            ahead = np.append(True, blank[:-1]) | fresh  # a space, or nothing, stands before
            begin = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0)) if len(out) else origin
            last_solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(out)))) if len(out) else origin
            keep = ~(blank & (last_solid < begin) & ahead[begin])
            out, origin, row, blank = out[keep], origin[keep], row[keep], blank[keep]
        lead = (first < offsets[1:]) & bool(self.prefix)
        counts = np.bincount(row, minlength=rows)
        if self.prefix:  # a space before each row that has something to read
            at = (np.cumsum(counts) - counts)[lead]
            out, origin, blank = np.insert(out, at, 0x20), np.insert(origin, at, first[lead]), np.insert(blank, at, True)
            counts = counts + lead
        ends = offsets[1:].copy()
        if self.squeeze:  # and no spaces at the end of a row
            bounds = np.concatenate([[0], np.cumsum(counts)])
            row = _rows(bounds)
            mark = np.zeros(len(out) + 1, bool)
            mark[:-1] = ~blank
            if self.escape and len(out) > 2:  # the sign itself, where the text has it, is a space as well
                sign = (out[:-2] == _SPACE_BYTES[0]) & (out[1:-1] == _SPACE_BYTES[1]) & (out[2:] == _SPACE_BYTES[2])
                for k in range(3):
                    mark[k:len(sign) + k][sign] = False
            solid = np.flatnonzero(mark[:-1])
            after = np.searchsorted(solid, bounds[1:])
            final = np.where(after > 0, np.append(solid, 0)[after - 1] + 1, 0) if len(solid) else np.zeros(rows, np.int64)
            final = np.maximum(final, bounds[:-1])
            cut = final < bounds[1:]
            ends[cut] = origin[final[cut]]
            keep = np.arange(len(out)) < final[row]
            out, origin, blank, counts = out[keep], origin[keep], blank[keep], final - bounds[:-1]
        if self.escape:
            wide = np.where(blank, 3, 1)
            row = np.repeat(np.arange(rows), counts)
            counts = np.bincount(row, weights=wide, minlength=rows).astype(np.int64)
            spaces = np.flatnonzero(np.repeat(blank, wide))
            out, origin = np.repeat(out, wide), np.repeat(origin, wide)
            out[spaces] = np.tile(_SPACE_BYTES, len(spaces) // 3)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        origin = np.insert(origin, bounds[1:], ends) - np.repeat(offsets[:-1], counts + 1)
        return out, origin, bounds

    def _merge(self, word: str) -> list[str]:
        """Pieces of a word: the best-scored neighbours first, from the left among equals.

        The queue holds plain numbers, so even a word of a whole text is held in little room.
        """
        piece, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        queue = [rank[p] << 40 | i for i in range(n - 1) if (p := piece[i] + piece[i + 1]) in rank]
        heapq.heapify(queue)
        while queue:
            key = heapq.heappop(queue)
            left = key & (1 << 40) - 1
            if not piece[left] or (right := after[left]) >= n:
                continue
            both = piece[left] + piece[right]
            if rank.get(both) != key >> 40:
                continue
            piece[left], piece[right] = both, ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                if (r := rank.get(both + piece[after[left]])) is not None:
                    heapq.heappush(queue, r << 40 | left)
            if before[left] >= 0 and (r := rank.get(piece[before[left]] + both)) is not None:
                heapq.heappush(queue, r << 40 | before[left])
        return [p for p in piece if p]

    def _pieces(self, word: str) -> tuple[list[int], list[int]]:
        """(ids, normalised bytes of each) of a word."""
        ids, sizes = [], []
        for piece in self._merge(word):
            raw = piece.encode()
            if piece in self.ids:
                ids.append(self.ids[piece])
                sizes.append(len(raw))
            else:  # a character without a piece: its bytes, the last of which stands for all
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
        return ids, sizes

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbours merged; ``_NEVER`` where the vocabulary has no such piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = (self.pairs[at] == key) & (left >= 0) & (right >= 0) if len(self.pairs) else np.zeros(key.shape, bool)
        piece = np.where(found, self.merged[at] if len(self.pairs) else 0, -1)
        return np.where(found, self.rank_of[piece], _NEVER), piece

    def _merge_all(self, signs: np.ndarray) -> np.ndarray:
        """Pieces of short words, a row each, -1 behind the last: one merge a word and round."""
        signs = signs.copy()
        rank, piece = self._ranks(signs[:, :-1], signs[:, 1:])
        active = np.arange(len(signs))
        part = signs
        while len(active):
            best = rank.argmin(1)  # the leftmost of equal ones
            row = np.arange(len(active))
            go = rank[row, best] < _NEVER
            if not go.all():
                signs[active[~go]] = part[~go]
                active, part, rank, piece, best = active[go], part[go], rank[go], piece[go], best[go]
                row = np.arange(len(active))
            if not len(active):
                break
            made = piece[row, best]
            behind = np.arange(part.shape[1]) > best[:, None]
            part = np.where(behind, np.pad(part[:, 1:], ((0, 0), (0, 1)), constant_values=-1), part)
            part[row, best] = made
            behind = behind[:, :-1]
            rank = np.where(behind, np.pad(rank[:, 1:], ((0, 0), (0, 1)), constant_values=_NEVER), rank)
            piece = np.where(behind, np.pad(piece[:, 1:], ((0, 0), (0, 1)), constant_values=-1), piece)
            last = rank.shape[1] - 1
            for at, ok in ((np.maximum(best - 1, 0), best > 0), (np.minimum(best, last), best <= last)):
                r, p = self._ranks(part[row, at], part[row, at + 1])
                rank[row[ok], at[ok]], piece[row[ok], at[ok]] = r[ok], p[ok]
        return signs

    def _learn(self, words: list[str]) -> None:
        """Adds the pieces of new words to the table."""
        lengths = np.array([len(w) for w in words], np.int64)
        signs = self.sign[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        start = np.cumsum(lengths) - lengths
        plain = (np.minimum.reduceat(signs, start) >= 0) & (lengths <= _SHORT)
        many, parts = np.zeros(len(words), np.int64), []
        for width in _WIDTHS:
            rows = np.flatnonzero(plain & (lengths <= width) & (lengths > width // 2))
            if not len(rows):
                continue
            column = np.arange(width)
            table = np.where(column < lengths[rows, None], signs[np.minimum(start[rows, None] + column, len(signs) - 1)], -1)
            table = self._merge_all(table) if width > 1 else table
            held = table >= 0
            many[rows] = held.sum(1)
            parts.append((rows, table[held], self.size_of[table[held]]))
        for row in np.flatnonzero(~plain).tolist():
            ids, sizes = self._pieces(words[row])
            many[row] = len(ids)
            parts.append(([row], ids, sizes))
        begin = np.cumsum(many) - many
        flat_ids, flat_sizes = np.zeros(many.sum(), np.int32), np.zeros(many.sum(), np.int32)
        for rows, ids, sizes in parts:
            count = many[rows]
            at = np.repeat(begin[rows] - np.cumsum(count) + count, count) + np.arange(len(ids))
            flat_ids[at], flat_sizes[at] = ids, sizes
        self.flat_ids, self.flat_sizes = np.append(self.flat_ids, flat_ids), np.append(self.flat_sizes, flat_sizes)
        self.many = np.append(self.many, many)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, byte after the last, row offsets) of the pieces of texts laid end to end."""
        if len(self.number) > _REMEMBERED or len(self.flat_ids) > 20 * _REMEMBERED:
            self._forget()
        out, origin, bounds = self.normalise(data, offsets)
        raw, number, known = out.tobytes(), self.number, len(self.number)
        words, per_row = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found = self.words.findall(raw[a:b].decode())
            words += [number[w] for w in found]
            per_row.append(len(found))
        if len(number) > known:
            self._learn(list(islice(number, known, None)))
        many = self.many
        flat = np.cumsum(many) - many
        words = np.array(words, np.int64)
        count = many[words]
        pick = np.repeat(flat[words] - np.cumsum(count) + count, count) + np.arange(count.sum())
        ids, sizes = self.flat_ids[pick], self.flat_sizes[pick].astype(np.int64)
        tokens = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(per_row)), per_row), count, len(per_row)))]).astype(np.int64)
        end = np.cumsum(sizes)
        row = _rows(tokens)
        first, last = origin[end - sizes + row], origin[end + row]
        return ids, first, last, tokens

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; invalid bytes become U+FFFD, one each."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        parts = self.surface[ids].tolist()
        if self.prefix or self.squeeze:  # spaces that encoding put in front, up to the first text
            for i, k in enumerate(ids.tolist()):
                if k in self.silent:
                    continue
                stripped = k in self.spaced
                if stripped:
                    parts[i] = parts[i][1:]
                if k in self.bytes_of or parts[i] or (stripped and not self.squeeze):
                    break
        joined = b"".join(parts)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return joined.decode(errors="one_sign_a_byte")


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row offsets) of chunks of the texts; NULL is empty."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _CHUNK, side="right")) - 1)
        yield raw[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
        a = b


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``ids``, the byte span of every piece (``starts``, ``ends``), and the ``decoded`` text."""
    Codec(model)  # refuse what cannot be used before any task starts
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType)] + [
        T.StructField(name, T.ArrayType(T.IntegerType(), False)) for name in ("ids", "starts", "ends")
    ] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            done = 0
            for data, offsets in _chunks(batch.column(1)):
                ids, first, last, bounds = one.encode(data, offsets)
                decoded = [one.decode(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v.astype(np.int32))) for v in (ids, first, last)]
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, rows), *lists, pa.array(decoded, pa.string())],
                                                 names=["_id", "ids", "starts", "ends", "decoded"])
                done += rows

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema).toDF(id_col, *schema.names[1:])


def decode_ids(rows: DataFrame, model: bytes, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per sequence of ids: id and its ``decoded`` text."""
    schema = T.StructType([T.StructField("_id", rows.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            texts = [one.decode(r.values.to_numpy(zero_copy_only=False)) if r.is_valid else "" for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "decoded"])

    return rows.select(F.col(id_col), F.col(ids)).mapInArrow(run, schema).toDF(id_col, *schema.names[1:])
