import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from scholia.llm import repeats, substrings, suffixes

from test_first import KIND, table


def by_words(data, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(data, split):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def by_bytes(data, size):
    out, seen = [], set()
    for doc, t in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone, own = set(), []
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            if s in seen:
                gone |= set(range(i, i + size))
            seen.add(s)
        runs = sum(1 for j in gone if j - 1 not in gone)
        out.append((doc, len(b), len(gone), runs, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    return out


def corpus(seed, vocabulary=400):
    rng = random.Random(seed)
    w = lambda n: [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]
    passages = [w(rng.randrange(8, 60)) for _ in range(6)]
    out = [(1, None), (2, ""), (3, "  \n\t"), (None, "alone here")]
    for i in range(60):
        parts = w(rng.randrange(1, 40))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a:] + w(rng.randrange(12)) if rng.random() < 0.7 else p
        out.append((1000 - i * 3, rng.choice([" ", "\n", " \t"]).join(parts)))
    out += [(5, "same " * 90), (6, "ab " * 50), (7, out[10][1]), (8, out[10][1]), (9, "x" * 700)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    data = corpus(seed)
    got = substrings.report(table(spark, data).repartition(5), window=10, anchor=3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_words(data, 10)))


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_match_brute_force(spark, seed):
    data = corpus(seed)
    got = suffixes.report(table(spark, data).repartition(5), length=30, trigger=6).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_bytes(data, 30)))


@pytest.mark.parametrize("length", [300, 900])
def test_wide_windows_match_brute_force(spark, length):
    rng = random.Random(length)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    data = [(1, t), (2, "x" * 50 + t[200:2900] + "y" * 700), (3, t[:1000] + t[1001:]), (4, t[::-1])]
    got = suffixes.report(table(spark, data), length=length).collect()
    assert sorted(map(tuple, got)) == sorted(by_bytes(data, length))
    words = [(i, " ".join(x)) for i, x in data]
    got = substrings.report(table(spark, words), window=length).collect()
    assert sorted(map(tuple, got)) == sorted(by_words(words, length))


def test_small_blocks(spark, monkeypatch):
    """Long texts go through in blocks, and full buffers are settled early."""
    data = corpus(5)
    hasher, rule = repeats.Hasher(), repeats.Rule("bytes", 30, 6, True)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    for _, t in data:
        u = hasher.units((t or "").encode(), "bytes")
        starts = [at + i for at, part in repeats.blocks(u, rule) for i in range(len(part) - 29)]
        assert starts == list(range(max(0, len(u) - 29)))
    long = " ".join(t or "" for _, t in data)
    monkeypatch.setattr(repeats, "BLOCK", 50)
    small = hasher.units(long.encode(), "words")
    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    assert (small == repeats.Hasher().units(long.encode(), "words")).all()


def test_repeated_rows_and_empty_tables(spark):
    t = " ".join(f"u{i}" for i in range(20))
    rows = [(1, t), (1, t), (2, "other text"), (2, "more"), (None, None), (None, "q")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.report(table(spark, rows), window=10, anchor=3).collect())
    assert got == [(0, 0), (0, 0), (1, 20), (1, 20), (2, 0), (2, 0)]
    assert all(r.n_removed == 0 for r in suffixes.report(table(spark, rows), length=30, trigger=6).collect())
    none = spark.createDataFrame([], KIND)
    assert substrings.report(none).count() == 0 and suffixes.report(none).count() == 0
    assert {(r.doc_id, r.text) for r in substrings.dedup(table(spark, [(1, "a  b"), (2, None)])).collect()} == {(1, "a b"), (2, "")}


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 9, 2, 7], np.uint64)
    for w in range(1, 9):
        assert repeats.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(9 - w)]


def thue_morse(n, a, b):
    """a and b in an order that every polynomial hash modulo a power of two takes for the reverse one, from 1,024 on."""
    return "".join((b, a)[bin(i).count("1") % 2 == 0] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_self_similar_text_is_told_apart(spark, n):
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    head = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}")]
    assert [r.n_removed for r in substrings.report(table(spark, rows)).collect()] == [0, 0]
    plain = [(1, x), (2, y), (3, x + "z" + y)]
    got = suffixes.report(table(spark, plain), length=n).collect()
    assert sorted(map(tuple, got)) == sorted(by_bytes(plain, n))
    several = [(1, " ".join(x)), (2, " ".join(y))]  # words instead of letters
    assert [r.n_removed for r in substrings.report(table(spark, several), window=n).collect()] == [0, 0]
    u = [repeats.Hasher().units(t.encode(), "bytes") for t in (x, y)]
    h = [repeats.Hasher(seed).span(repeats.Hasher(seed).rungs(v, n), np.array([0]), np.array([n]))[0] for v in u for seed in (repeats._B, repeats._OTHER)]
    assert len(set(h)) == 4
