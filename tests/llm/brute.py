"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TR))


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TR))


def leaks(rows, items, size=10):
    wins = []
    for i, t in items:
        w = plain_words(t)
        if i is not None and w:
            n = min(size, len(w))
            wins += [(str(i), tuple(w[j : j + n])) for j in range(len(w) - n + 1)]
    wins = set(wins)
    out = []
    for i, t in rows:
        w, hit, got = plain_words(t), set(), set()
        at = {}
        for n in {len(x) for _, x in wins}:
            for j in range(len(w) - n + 1):
                at.setdefault(tuple(w[j : j + n]), []).append(j)
        for item, x in wins:
            for j in at.get(x, ()):
                hit.update(range(j, j + len(x)))
                got.add(item)
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for j in range(len(b) - width + 1):
                s = b[j : j + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - width + 1) if i is not None else ():
            if first[b[j : j + width]] < i:
                gone[j : j + width] = [True] * width
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(t, n):
    w = spaced(t)
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), (root(i) if s else i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)]


def mixing(rows, weights=(5, 2, 1), cap=3):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(spaced(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(cap * size[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: cap * size[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap * size[s] + 1e-9}
        if not over:
            return size, target
        full |= over


def base_scores(rows, modulus=7, held=2):
    out, count = [], Counter()
    h = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % modulus == held
    for i, t in rows:
        if not h(i):
            count.update([*spaced(t), ""])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        w = [*spaced(t), ""]
        out.append((i, h(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    return out


def _luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def pii_base(t):
    t = t or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def secrets_base(t):
    t = t or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(found)]
