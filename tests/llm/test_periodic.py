"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from paneleffect.llm import periodic


def brute_runs(words, least=6, exponent=4):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def brute(doc_id, text, plant):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rough(rng, n):
    """Texts of few words with repeated stretches, at one another's edges and inside one another."""
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = rng.choices("abc", k=rng.randrange(1, 6)) * rng.choice([1, 2, 4, 5, 9])
            words += unit[: rng.randrange(1, len(unit) + 1)] * rng.choice([1, 1, 4, 5])
            words += rng.choices(["a", "b", "É", "x1", "x2", "x3"], k=rng.randrange(4))
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    return texts


def test_all_runs_of_small_alphabets():
    rng = random.Random(9)
    for settings in (periodic.Settings(), periodic.Settings(rounds=0)):
        for _ in range(400):
            docs = [rng.choices(range(rng.choice([1, 2, 3])), k=rng.randrange(0, 40)) for _ in range(rng.randrange(1, 5))]
            before = np.cumsum([0, *map(len, docs)])
            if not before[-1]:
                continue
            words = np.array([w for d in docs for w in d], dtype=np.uint64)
            got = sorted(zip(*(x.tolist() for x in periodic.runs(words, before, settings))))
            assert got == sorted((k, *r) for k, d in enumerate(docs) for r in brute_runs(d))


def test_suffixes_agree_and_rank():
    rng = random.Random(2)
    for _ in range(60):
        text = [*rng.choices(range(3), k=rng.randrange(1, 70)), 9]
        tree = periodic.SuffixTree(np.array(text))
        assert sorted(range(len(text)), key=lambda i: text[i:]) == np.argsort(tree.rank).tolist()
        a, b = np.array([(i, j) for i in range(len(text)) for j in range(len(text)) if i != j]).T
        want = [next(k for k in range(len(text)) if text[i + k] != text[j + k]) for i, j in zip(a, b)]
        assert tree.agreement(a, b).tolist() == want


def test_digest_equals_brute_force(frame):
    texts = [*rough(random.Random(5), 250), None, "", " \n\t ", "ha " * 5, "ha " * 6, "ha " * 300, "a b " * 3, "a b " * 4, "one two three", "so so so so so so it it it it it it"]
    rows = [*enumerate(texts), (None, "ha ha ha ha ha ha"), (3, texts[4]), (3, texts[4])]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))) > 10
    key = lambda r: tuple((x is None, x) for x in r)
    for plant in (False, True):
        docs = frame(rows)
        got = periodic.digest(periodic.planted(docs) if plant else docs).collect()
        assert sorted(map(tuple, got), key=key) == sorted((brute(*r, plant) for r in rows), key=key)


def test_a_long_text_and_no_rows(frame):
    words = [f"w{k * k % 977}" for k in range(30_000)]
    text = " ".join(words[:20_000] + ["p", "q", "r"] * 2000 + words[:5] * 800)
    row = periodic.collapsed(frame([(1, text)])).first()
    assert [tuple(r) for r in row["runs"] if r["start"] >= 20_000][0] == (20_000, 6000, 3)
    assert row["n_words"] == 30_000 and "p q r w0" in row["collapsed"]
    assert periodic.digest(periodic.planted(frame([]))).collect() == []
