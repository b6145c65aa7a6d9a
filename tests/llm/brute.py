"""Plain readings of the contracts, for small inputs."""

import hashlib
import re
import zlib

import xxhash


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def simhash(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits=2):
    """component by row, of (id, fingerprint) rows."""
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if prints[i][0] is not None:
            least[find(i)] = min(least.get(find(i), prints[i][0]), prints[i][0])
    return [least.get(find(i)) for i in range(n)]


def contamination(t, items, window=10):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(x or ""))
    w, hit, found = split(t), set(), set()
    for item, x in items:
        v = split(x)
        if not v:
            continue
        n = min(window, len(v))
        for a in range(len(v) - n + 1):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[a : a + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def ctph(data):
    """A piecewise hash read byte by byte."""
    if not data:
        return "3::"
    h = []
    for i in range(len(data)):
        x = sum((b + 1) * pow(0x01000193, k, 2**32) for k, b in enumerate(reversed(data[max(0, i - 6) : i + 1]))) % 2**32
        x = (x ^ x >> 15) * 0x85EBCA6B % 2**32
        h.append(x ^ x >> 13)
    cuts = lambda s: [i for i, x in enumerate(h) if x % s == s - 1]
    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and len(cuts(size)) < 32:
        size //= 2
    while len(cuts(size)) > 128:
        size *= 2

    def signs(s):
        out, start = "", 0
        for end in sorted({*(i + 1 for i in cuts(s)), len(data)}):
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[zlib.crc32(data[start:end]) * 0x9E3779B1 >> 20 & 63]
            start = end
        return out

    return f"{size}:{signs(size)}:{signs(2 * size)}"


def edits(a, b):
    """Insertions and deletions that turn a into b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] if x == y else 1 + min(old[j], row[j - 1]))
    return row[-1]


def likeness(x, y):
    if x == y:
        return 1.0
    (s, *own), (t, *other) = x.split(":"), y.split(":")
    sides = [(a, b) for i, a in enumerate(own) for j, b in enumerate(other) if int(s) << i == int(t) << j]
    out = 0.0
    for a, b in sides:
        n = min(4, len(a), len(b))
        if n and any(a[i : i + n] in b for i in range(len(a) - n + 1)):
            out = max(out, 1 - edits(a, b) / (len(a) + len(b)))
    return out
