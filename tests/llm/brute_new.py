"""Slow, plain versions of operators 11 to 13."""

import heapq
import re
import zlib
from hashlib import sha256

BLANKS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def damaged(rows):
    """(conv, turn, role, text) rows after damage."""
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault): the first end of a search by (cost, audit)."""
    queue, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, had, lines = heapq.heappop(queue)
        if i == len(rows) and had in ("", "a"):
            return cost, audit, list(lines)
        if (i, had) in closed:
            continue
        closed.add((i, had))
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[had]
        for name in ("user", "assistant"):
            if name[0] in after:
                heapq.heappush(queue, (cost + 5, audit + "I", i, name[0], (*lines, f"{name}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, had, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if role[:1] and role[:1] in after:
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        for name in ("user", "assistant"):
            if name[0] in after:
                heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, name[0], (*lines, f"{name}:{text}")))


def conversations(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows without damage."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, own in groups.items():
        own.sort()
        seen, marked = set(), []
        for _, _, role, text in own:
            solid = text.rstrip(BLANKS)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for known, t, _, _ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(marked)
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, cost, audit, sha("\n".join(lines)))
    return out


def planted(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    own, g = words(text), h // 10
    n = len(own)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
    return own


def runs(own):
    """(start, length, period) of all runs, by start and period."""
    n, found = len(own), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and own[i] == own[i + q]:
                i += 1
            if i + q - a >= max(6, 4 * q):
                found.setdefault((a, i + q - a), q)
            i += 1
    return sorted(((a, size, q) for (a, size), q in found.items()), key=lambda r: (r[0], r[2]))


def run_digest(own):
    """The row that op13 gives for a list of words."""
    found = runs(own)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines),
            sha(" ".join(w for i, w in enumerate(own) if i not in gone)))
