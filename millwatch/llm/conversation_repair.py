"""Repairing the structure of conversations by generalised LR parsing with edits.

The roles of a conversation, by their initials, have to follow a small grammar: an optional
system turn, then pairs of user and assistant.  Rows may be kept, deleted or given
another role, and empty turns inserted, each at a cost.  A parser reads the rows with all
its stacks at once: stacks share their tails, an action leads from each to new ones, and
equal stacks merge by the smaller (cost, audit), the audit being the letters of the edits
(Delete, Insert, Keep, Rerole).  Just after a row no audit of a stack is the beginning
of another's, so their order is known from the order before the row and the few letters
added: audits are never compared as strings, and read back along links at the end.  A stack
that costs more than any other could come to by catching up is dropped.

Rows are dealt out by ranges of (conversation, turn), so a conversation with a large part
of all rows spreads over as many tasks as it fills.  A range parses the conversations that
it holds whole; of those that reach its ends, at most two, it gives the best way from every
stack to every stack, and these ways are chained over the ranges.  Texts repeated across
ranges are found by digests of the conversations that cross ranges only.

Results for odd rows: a NULL role or text counts as one space; NULL ids are one
conversation; NULL turns come first.  Rows of one turn follow role, then the first 64
characters of the text, then its md5; equal rows are interchangeable.  A text is never
cut.  An empty table gives empty tables.  Only the four named columns are read, so no
other can clash, and none is carried; the results have the operator's own columns, given
in ``repair``.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch.session import stored

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: talk: nothing, or an optional system turn and pairs; the first symbol is the start.
GRAMMAR = [("talk", ()), ("talk", ("body",)), ("talk", ("s", "body")), ("body", ("pair",)), ("body", ("body", "pair")), ("pair", ("u", "a"))]
_START = GRAMMAR[0][0]
_LEFT = {left for left, _ in GRAMMAR}
#: No stack needs more than this to go on like any other: two insertions and a deletion.
_CATCH_UP = 2 * INSERT + DELETE
#: Rows of a range, about.
_RANGE_ROWS = 200_000

State = frozenset
#: A stack is (its top state, the stack below); the lowest has nothing below.
Stack = tuple


def _closed(items: set) -> State:
    """Items (rule, dot) with the rules of every symbol that may come next."""
    todo = list(items)
    while todo:
        rule, dot = todo.pop()
        right = GRAMMAR[rule][1]
        for r, (left, _) in enumerate(GRAMMAR):
            if dot < len(right) and right[dot] == left and (r, 0) not in items:
                items.add((r, 0))
                todo.append((r, 0))
    return frozenset(items)


@lru_cache(maxsize=None)
def _goto(state: State, symbol: str) -> State:
    return _closed({(r, d + 1) for r, d in state if d < len(GRAMMAR[r][1]) and GRAMMAR[r][1][d] == symbol})


def _done(state: State) -> list[int]:
    return [r for r, d in state if d == len(GRAMMAR[r][1])]


ROOT: Stack = (_closed({(r, 0) for r, (left, _) in enumerate(GRAMMAR) if left == _START}), None)


def _reduced(stack: Stack) -> Iterator[Stack]:
    """The stack and what reductions make of it, except the start symbol's; stacks that can only be reduced are left out."""
    state = stack[0]
    if any(d < len(GRAMMAR[r][1]) for r, d in state) or any(GRAMMAR[r][0] == _START for r in _done(state)):
        yield stack
    for rule in _done(state):
        left, right = GRAMMAR[rule]
        if left != _START:
            below = stack
            for _ in right:
                below = below[1]
            yield from _reduced((_goto(below[0], left), below))


@lru_cache(maxsize=None)
def moves(stack: Stack, initial: str) -> tuple[Stack, ...]:
    """The stacks after shifting a role."""
    state = _goto(stack[0], initial) if initial and initial not in _LEFT else frozenset()
    return tuple(_reduced((state, stack))) if state else ()


def accepts(stack: Stack) -> bool:
    return any(GRAMMAR[r][0] == _START for r in _done(stack[0]))


def _stacks() -> list[Stack]:
    found = [ROOT]
    for stack in found:
        found += [s for i in "sua" for s in moves(stack, i) if s not in found]
    return found


STACKS = _stacks()
_NUMBER = {s: i for i, s in enumerate(STACKS)}
#: Fronts are tuples of (stack, cost above the cheapest, place of its audit among all).
Front = tuple


def _inserted(front: Front) -> dict[Stack, tuple[int, int, int, int]]:
    """Stack -> (cost, place, insertions, which of the front) with any number of empty turns added."""
    best = {s: (cost, place, 0, i) for i, (s, cost, place) in enumerate(front)}
    todo = list(best)
    while todo:
        stack = todo.pop()
        cost, place, many, i = best[stack]
        for initial in ROLES:
            for then in moves(stack, initial):
                offer = (cost + INSERT, place, many + 1, i)
                if then not in best or offer < best[then]:
                    best[then] = offer
                    todo.append(then)
    return best


@lru_cache(maxsize=100_000)
def _step(front: Front, initial: str, gone: bool, truncated: bool) -> tuple[Front, int, tuple]:
    """(front after a row, cost that all have in common, (which before, letters) of each).

    ``gone`` rows must be deleted.  Fronts hold costs relative to the cheapest, so few different ones ever occur.
    """
    best: dict[Stack, tuple[int, int, str, int]] = {}

    def offer(stack: Stack, *way) -> None:
        if stack not in best or way < best[stack]:
            best[stack] = way

    for stack, (cost, place, many, i) in _inserted(front).items():
        offer(stack, cost + DELETE, place, "I" * many + "D", i)
        if not gone:
            cost += TRUNCATED * truncated
            for then in moves(stack, initial):
                offer(then, cost, place, "I" * many + "K", i)
            for other in ROLES:
                for then in moves(stack, other):
                    offer(then, cost + REROLE, place, "I" * many + "R", i)
    least = min(way[0] for way in best.values())
    best = {s: way for s, way in best.items() if way[0] - least <= _CATCH_UP}
    places = {way: n for n, way in enumerate(sorted({w[1:3] for w in best.values()}))}
    order = sorted(best, key=_NUMBER.get)
    return (tuple((s, best[s][0] - least, places[best[s][1:3]]) for s in order), least,
            tuple((best[s][3], best[s][2]) for s in order))


def _read_back(links: list[tuple], at: int) -> str:
    letters = []
    for link in reversed(links):
        at, added = link[at]
        letters.append(added)
    return "".join(reversed(letters))


def parse(rows: list[tuple[str, bool, bool]], entry: Stack = ROOT) -> tuple[Front, int, list[tuple]]:
    """(front, its common cost, links) after the rows (initial, must go, truncated)."""
    front, cost, links = ((entry, 0, 0),), 0, []
    for row in rows:
        front, more, link = _step(front, *row)
        cost += more
        links.append(link)
    return front, cost, links


def best_end(front: Front) -> tuple[int, int, int]:
    """(cost, which of the front, insertions) of the cheapest way to end."""
    cost, _, many, i = min(way for s, way in _inserted(front).items() if accepts(s))
    return cost, i, many


def repair_roles(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    front, cost, links = parse(rows)
    more, i, many = best_end(front)
    return cost + more, _read_back(links, i) + "I" * many


def _expects_answer(stack: Stack) -> bool:
    return bool(moves(stack, "a"))


@dataclass(frozen=True)
class Repair:
    """What ``repair`` gives; the keys are ranges, the rows' places ascend along a conversation."""

    summary: DataFrame   #: conversation, gaps, blank, duplicate, truncated, illegal, cost, audit
    rows: DataFrame      #: conversation, part, seq, role, text, whole: the repaired rows


_WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SCAN = ("part bigint, place bigint, whole boolean, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, "
         "truncated bigint, illegal bigint, first_initial string, last_initial string, cost bigint, audit string, "
         "ways array<struct<entry: int, exit: int, cost: bigint, audit: string>>")
_PIECE = ("part bigint, place bigint, whole boolean, ends boolean, answer boolean, edits string, gaps bigint, blank bigint, "
          "duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _schema(conv: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(rest).fields])


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _arrow(schema: T.StructType) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    types = [pa.list_(_WAY) if f.name == "ways" else to_arrow_type(f.dataType) for f in schema]
    return schema.names, types


def _in_ranges(rows: DataFrame) -> DataFrame:
    """The rows in order with their place; a place's upper bits number its range."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _RANGE_ROWS))
    head, digest = F.left("text", F.lit(64)), F.md5("text")
    keyed = rows.withColumn("head", head).withColumn("digest", digest).withColumn("copy", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "head", "digest", "copy")]
    placed = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return stored(placed.select("conv", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("place")), "turns")


def _marks(placed: DataFrame) -> DataFrame:
    """What the parser needs of each row, without its text."""
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    return placed.select(
        F.shiftright("place", 33).alias("part"), "place", "conv", "turn", F.left("role", F.lit(1)).alias("initial"),
        (F.length(solid) == 0).alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "digest")).alias("content"))


def _seen_before(marks: DataFrame) -> DataFrame:
    """(later range, conversation, content) of what an earlier range of the same conversation has; few conversations cross ranges."""
    crossing = marks.groupBy("conv").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select(F.col("conv").alias("c"))
    held = marks.join(crossing, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select("conv", "content", "part").distinct()
    return held.groupBy("conv", "content").agg(F.array_sort(F.collect_list("part")).alias("parts")).filter(F.size("parts") > 1).select(
        F.explode(F.expr("slice(parts, 2, size(parts) - 1)")).alias("later"), F.col("conv").alias("held_by"), F.col("content").alias("held"))


def _scan(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per range and conversation in it."""
    schema = _schema(marks.schema["conv"].dataType, _SCAN)
    names, types = _arrow(schema)

    def scan(own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table([], names, types)
        own = own.sort_by("place")
        earlier: dict = {}
        for conv, content in zip(known.column("held_by").to_pylist(), known.column("held").to_pylist()):
            earlier.setdefault(conv, set()).add(content)
        convs = own.column("conv").to_pylist()
        turns, initials, blanks, cuts, contents, places = (
            own.column(c).to_pylist() for c in ("turn", "initial", "blank", "truncated", "content", "place"))
        out, a = [], 0
        part = places[0] >> 33
        while a < len(convs):
            b, rows, held = a, [], earlier.get(convs[a], set())
            blank = duplicate = truncated = illegal = 0
            while b < len(convs) and convs[b] == convs[a]:
                again = not blanks[b] and contents[b] in held
                cut = not blanks[b] and not again and cuts[b]
                blank, duplicate, truncated = blank + blanks[b], duplicate + again, truncated + cut
                illegal += b > a and initials[b - 1] + initials[b] not in LEGAL
                held.add(contents[b])
                rows.append((initials[b], blanks[b] or again, cut))
                b += 1
            dated = [t for t in turns[a:b] if t is not None]
            counts = (dated[0] if dated else None, dated[-1] if dated else None, len(set(dated)), blank, duplicate, truncated, illegal,
                      initials[a], initials[b - 1])
            whole = a > 0 and b < len(convs)
            ways = []
            if whole:
                cost, audit = repair_roles(rows)
            else:
                cost, audit = None, None
                for entry in STACKS:
                    front, base, links = parse(rows, entry)
                    ways += [(_NUMBER[entry], _NUMBER[s], base + more, _read_back(links, i)) for i, (s, more, _) in enumerate(front)]
            ways = [dict(zip(("entry", "exit", "cost", "audit"), w)) for w in ways]
            out.append((convs[a], part, places[a], whole, *counts, cost, audit, ways))
            a = b
        return _table(out, names, types)

    return marks.groupBy("part").cogroup(seen.groupBy("later")).applyInArrow(scan, schema)


def _chain(ways: list[list[dict]]) -> tuple[int, list[str], list[int]]:
    """(cost, the edits of each range, the stack each starts from) of the best way through consecutive ranges."""
    best, links = {0: (0, 0)}, []
    for one in ways:
        then: dict[int, tuple[int, int, str, int]] = {}
        for w in one:
            if w["entry"] in best:
                cost, place = best[w["entry"]]
                way = (cost + w["cost"], place, w["audit"], w["entry"])
                if w["exit"] not in then or way < then[w["exit"]]:
                    then[w["exit"]] = way
        places = {p: n for n, p in enumerate(sorted({w[1:3] for w in then.values()}))}
        links.append({s: (w[3], w[2]) for s, w in then.items()})
        best = {s: (w[0], places[w[1:3]]) for s, w in then.items()}
    order = sorted(best)
    cost, i, many = best_end(tuple((STACKS[s], *best[s]) for s in order))
    at, edits, entries = order[i], [], []
    for link in reversed(links):
        at, audit = link[at]
        edits.append(audit)
        entries.append(at)
    edits.reverse()
    edits[-1] += "I" * many
    return cost, edits, entries[::-1]


def _fold(scanned: DataFrame) -> DataFrame:
    """Edits by range of the conversations at the ends of ranges, with their counts in the row of the last one."""
    schema = _schema(scanned.schema["conv"].dataType, _PIECE)
    names, types = _arrow(schema)

    def fold(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        cost, edits, entries = _chain([r["ways"] for r in rows])
        totals = {c: sum(r[c] for r in rows) for c in _COUNTS}
        turns, last = 0, None
        for before, r in zip([None, *rows], rows):
            if before:
                totals["illegal"] += before["last_initial"] + r["first_initial"] not in LEGAL
            turns += r["turns"] - (last is not None and last == r["first_turn"])
            last = r["last_turn"] if r["last_turn"] is not None else last
        first = next((r["first_turn"] for r in rows if r["first_turn"] is not None), None)
        gaps = last - first + 1 - turns if turns else 0
        out = []
        for r, own, entry in zip(rows, edits, entries):
            ends = r is rows[-1]
            out.append((r["conv"], r["part"], r["place"], False, ends, _expects_answer(STACKS[entry]), own,
                        *((gaps, *totals.values(), cost, "".join(edits)) if ends else (None,) * 7)))
        return _table(out, names, types)

    return scanned.groupBy("conv").applyInArrow(fold, schema)


def _repaired(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The rows after their edits, range by range, in order."""
    conv = placed.schema["conv"].dataType
    none = F.lit(None).cast("string")
    texts = placed.select(F.shiftright("place", 33).alias("part"), "place", F.lit(1).alias("kind"), "conv", "role", "text",
                          none.alias("edits"), F.lit(False).alias("answer"), F.lit(False).alias("whole"))
    heads = pieces.select("part", "place", F.lit(0).alias("kind"), "conv", none.alias("role"), none.alias("text"), "edits", "answer", "whole")
    order = ["part", "place", "kind"]
    mixed = texts.unionByName(heads).repartition("part").sortWithinPartitions(*order)
    schema = _schema(conv, "part bigint, seq bigint, role string, text string, whole boolean")
    names, types = _arrow(schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, answer, whole, seq, key = "", 0, False, False, 0, (None, None)
        out: list[tuple] = []

        def add(role: str, text: str) -> None:
            nonlocal answer, seq
            answer = role[:1] == "u"
            out.append((*key, seq, role, text, whole))
            seq += 1

        def insert() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                at += 1
                add(ROLES["a" if answer else "u"], "")

        for batch in batches:
            for part, kind, conv, role, text, *head in zip(*(batch.column(c).to_pylist() for c in (
                    "part", "kind", "conv", "role", "text", "edits", "answer", "whole"))):
                if kind == 0:
                    insert()
                    (edits, answer, whole), at, seq, key = head, 0, 0, (conv, part)
                    continue
                insert()
                letter = edits[at]
                at += 1
                if letter == "K":
                    add(role, text)
                elif letter == "R":
                    add(ROLES["a" if answer else "u"], text)
            yield from _table(out, names, types).to_batches()
            out.clear()
        insert()
        yield from _table(out, names, types).to_batches()

    return mixed.mapInArrow(edit, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults and cheapest repair of every conversation, and its repaired rows."""
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    placed = _in_ranges(own)
    marks = _marks(placed)
    scanned = stored(_scan(marks, _seen_before(marks)), "scanned")
    gaps = F.coalesce(F.expr("last_turn - first_turn + 1 - turns"), F.lit(0).cast("bigint"))
    whole = scanned.filter("whole").select(
        "conv", "part", "place", "whole", F.lit(True).alias("ends"), F.lit(False).alias("answer"), F.col("audit").alias("edits"),
        gaps.alias("gaps"), *_COUNTS, "cost", "audit")
    pieces = whole.unionByName(_fold(scanned.filter("not whole")))
    return Repair(pieces.filter("ends").select("conv", "gaps", *_COUNTS, "cost", "audit"), _repaired(placed, pieces))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256 of its ``role:text`` lines joined by line ends).

    Conversations that a range holds whole are hashed where they are; of the others the lines stream
    through a task in order, without being held.
    """
    conv = repaired.schema["conv"].dataType
    between = _schema(conv, "part bigint, seq bigint, sha string, line string")
    final = _schema(conv, "sha string")

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = _arrow(between)
        key, state = None, None
        for batch in batches:
            out = []
            for c, part, seq, role, text, whole in zip(*(col.to_pylist() for col in batch.columns)):
                if state and key != (c, part):
                    out.append((*key, 0, state.hexdigest(), None))
                    state = None
                key = (c, part)
                line = f"{role}:{text}"
                if not whole:
                    out.append((c, part, seq, None, line))
                elif state:
                    state.update(b"\n" + line.encode())
                else:
                    state = hashlib.sha256(line.encode())
            yield from _table(out, names, types).to_batches()
        if state:
            yield from _table([(*key, 0, state.hexdigest(), None)], names, types).to_batches()

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = _arrow(final)
        key, state = None, None
        for batch in batches:
            out = []
            for c, sha, line in zip(*(batch.column(n).to_pylist() for n in ("conv", "sha", "line"))):
                if state and key != c:
                    out.append((key, state.hexdigest()))
                    state = None
                key = c
                if sha is not None:
                    out.append((c, sha))
                elif state:
                    state.update(b"\n" + line.encode())
                else:
                    state = hashlib.sha256(line.encode())
            yield from _table(out, names, types).to_batches()
        if state:
            yield from _table([(key, state.hexdigest())], names, types).to_batches()

    dealt = repaired.mapInArrow(here, between).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return dealt.mapInArrow(there, final)
