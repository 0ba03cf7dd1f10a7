"""Plain single-machine versions to compare with."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """rows: (id, text) -> per row (id, keep_id, size, sha)"""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    best = {}
    for (i, t), n in zip(rows, norm, strict=True):
        key = (-len(t or ""), i is None, i or 0)
        best[n] = min(best.get(n, (key, i)), (key, i), key=lambda x: x[0])
    size = Counter(norm)
    return [(i, best[n][1], size[n], sha256(n)) for (i, _), n in zip(rows, norm, strict=True)]


def lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(i)]
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return out


def fingerprint(text):
    w = words(lower(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def near(rows, radius=2):
    """rows: (id, text) -> per row (id, fingerprint, component)"""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f, least[find(k)]) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True))]


def passages(rows, window=50):
    """rows: (id, text) -> per row (id, n, removed, kept text)"""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < order(i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def base_counts(text):
    w = words(text)
    at = defaultdict(list)
    for p in range(len(w) - 4):
        at[tuple(w[p : p + 5])].append(p)
    again = len({p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)})
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, again
