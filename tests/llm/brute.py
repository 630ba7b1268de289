"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_words(text):
    return PLAIN.findall((text or "").translate(UPPER))


def blank_words(text):
    return BLANK.findall(text or "")


def contamination(docs, items):
    phrases = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[i:i + 10])].add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i:i + n])) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[p]
        names = sorted(str(x) for x in found if x is not None)
        out[doc] = (len(w), len(hit), len(names), sha(",".join(names)), bool(hit))
    return out


def shingles(text, k=4):
    w = blank_words((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs, similar=85, k=4):
    sets = {doc: shingles(text, k) for doc, text in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    of = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            of[x].add(d)
    for d, s in sets.items():
        common = Counter(o for x in s for o in of[x] if o < d)
        for o, both in common.items():
            if 100 * both >= similar * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def passages(docs, window=20):
    first = {}
    for doc, text in sorted(docs):
        w = blank_words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (doc, i))
    out = {}
    for doc, text in docs:
        w, gone = blank_words(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (doc, i):
                gone.update(range(i, i + window))
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def byte_strings(docs, length=50):
    first = {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i:i + length], doc)
    out = {}
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def quality_counts(text):
    w = blank_words(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if BLANK.search(line)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed)


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def boilerplate(docs, min_sites):
    """doc -> (lines, removed, kept text); docs: (doc, text, site)."""
    sites, owner = defaultdict(set), {}
    line = lambda x: x.strip(" ")
    for doc, text, site in docs:
        for x in (text or "").split("\n"):
            if BLANK.search(x):
                sites[line(x)].add(site)
                owner[line(x)] = min(doc, owner.get(line(x), doc))
    out = {}
    for doc, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (BLANK.search(x) and len(sites[line(x)]) >= min_sites and owner[line(x)] != doc)]
        out[doc] = (sum(bool(BLANK.search(x)) for x in lines), len(lines) - len(kept), "\n".join(kept))
    return out


def mix_targets(sizes, most=3):
    """source -> target, by resharing round after round; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        share = {s: most * sizes[s] if s in full else weight[s] * rest / free for s in order}
        over = {s for s in order if share[s] > most * sizes[s]} - full
        if not over:
            return share
        full |= over
