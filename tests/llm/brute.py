"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
LAST = 1 << 62


def low(text):
    return (text or "").translate(ASCII_LOWER)


def shingles(words, size):
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def order(doc_id):
    return LAST if doc_id is None else doc_id


def contaminated(docs, items, window=10):
    """doc -> (n_words, n_hit, sorted item ids)"""
    def words(text):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(str(item) if item is not None else None)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((doc, len(w), len(hit), tuple(sorted(found - {None}))))
    return sorted(out, key=str)


def substrings(docs, width=50):
    first = {}
    rows = [(order(i), (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for k in range(len(b) - width + 1):
            first[b[k:k + width]] = min(i, first.get(b[k:k + width], LAST))
    out = []
    for (doc, _), (i, b) in zip(docs, rows, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < i:
                gone[k:k + width] = b"\x01" * width
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((doc, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated_lines(docs, size=5, percent=80):
    """doc -> removed line numbers; rows that repeat are one document"""
    seen, index, out = [], {}, {}
    for i, text in sorted(set(docs), key=lambda x: order(x[0])):
        gone = []
        for p, line in enumerate((text or "").split("\n")):
            s = shingles(re.findall(r"[^\x20\x09-\x0D]+", line.lower()), size)
            if not s:
                continue
            common = {}
            for x in s:
                for j in index.get(x, ()):
                    common[j] = common.get(j, 0) + 1
            if any(100 * c >= percent * (len(s) + len(seen[j]) - c) for j, c in common.items()):
                gone.append(p)
            for x in s:
                index.setdefault(x, []).append(len(seen))
            seen.append(s)
        out[i, text] = gone
    return out


def repeated_units(docs, unit="line"):
    """(doc, text) -> removed byte ranges of lines, paragraphs or sentences that stood earlier,
    neighbours as one; rows that repeat are one document"""
    ends = {"line": rb"[^\n]+", "paragraph": rb"(?s).+?(?=\n[\x20\x09-\x0D]*\n|\Z)", "sentence": rb"[^\n]+"}
    seen, out = set(), {}
    for i, text in sorted(set(docs), key=lambda x: order(x[0])):
        units = []                                           # start, stop, stood earlier
        for part in re.finditer(ends[unit], (text or "").encode()):
            words = list(re.finditer(rb"[^\x20\x09-\x0D]+", part[0]))
            cuts = [k + 1 for k, w in enumerate(words) if unit == "sentence" and w[0][-1:] in b".!?"]
            for a, b in zip([0, *cuts], [*cuts, len(words)]):
                if a < b:
                    name = tuple(w[0].lower() for w in words[a:b])
                    units.append((part.start() + words[a].start(), part.start() + words[b - 1].end(), name in seen))
                    seen.add(name)
        spans = []
        for k, (start, stop, go) in enumerate(units):
            if go and k and units[k - 1][2]:
                spans[-1] = (spans[-1][0], stop)
            elif go:
                spans.append((start, stop))
        out[i, text] = spans
    return out


def similar_groups(docs, size=3, percent=90):
    """doc -> (set size, least id of its component)"""
    sets = [shingles(re.findall(r"[^\x20\x09-\x0D]+", low(t)), size) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)
