"""Periodic runs against brute force (12)."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from routeyard.llm import periodic_runs as pr


def brute_runs(words):
    """(start, length, period) of all runs, every lag compared with every place."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def texts_with_runs(rng):
    """Runs of every length of period, runs in runs, runs that touch, and texts of few words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    out = ["a " * 5, "a " * 6, "a b " * 4, "a b " * 4 + "a", "x " * 3000, "a b " * 900 + "c"]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for q in (3, 7, 15, 16, 17, 23, 31, 32, 33, 47, 63, 64, 65, 100, 127, 130, 200):
        for exponent in (3.9, 4, 4.5, 7):
            inner = rng.choice(["words", "few", "run"])
            if inner == "words":
                block = [word(3) for _ in range(q)]
            elif inner == "few":
                block = [rng.choice("ab") for _ in range(q)]
            else:                                           # a period that is almost a run of a shorter one
                small = [rng.choice("ab") for _ in range(rng.randint(1, max(1, q // 2)))]
                block = (small * q)[:q - 1] + ["z"]
            n = int(q * exponent)
            out.append(" ".join([word(2) for _ in range(rng.randint(0, 20))] + (block * 9)[:n]
                                + [word(2) for _ in range(rng.randint(0, 20))]))
    nested = ["p"] * 9 + ["q", "r"] * 6 + ["s"]
    out.append(" ".join(nested * 8 + ["t"] + nested * 5))
    a, b = ["a"], ["a", "b"]
    while len(b) < 2000:                                    # Fibonacci words are full of nearly periodic stretches
        a, b = b, b + a
    out.append(" ".join(b))
    return out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(4):
        texts = texts_with_runs(rng)
        data = [t.encode() for t in texts]
        bounds = np.cumsum([0, *map(len, data)])
        rows = pr.runs_of(*pr.word_array(np.frombuffer(b"".join(data), np.uint8), bounds)).tolist()
        for i, t in enumerate(texts):
            assert [tuple(r[1:]) for r in rows if r[0] == i] == brute_runs(split(t)), t[:200]


def test_query_columns_equal_brute_force(make_docs, odd_texts):
    rng = random.Random(8)
    texts = [*odd_texts, *texts_with_runs(rng), "\x0b a\x0ca\ta a\na\ra", "é " * 7 + "  x x"]
    ids = list(range(-3, len(texts) - 3))
    got = {r["doc_id"]: r for r in pr.digests(pr.periodic_runs(pr.planted(make_docs(texts, ids)))).collect()}
    changed = 0
    for i, text in zip(ids, texts):
        w = split(text)
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        if n > 6000:
            continue                                        # too slow for the brute force
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert changed > 5


def test_unusual_rows(make_docs):
    rows = pr.periodic_runs(make_docs([None, "", " \n", "a " * 7, "a " * 7], ids=[1, None, 1, None, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["collapsed"]) for r in rows) == [
        ("1", 0, ""), ("1", 0, ""), ("None", 0, ""), ("None", 7, "a"), ("None", 7, "a")]
    assert pr.periodic_runs(make_docs(["a"]).limit(0)).count() == 0
    assert pr.planted(make_docs(["a b", None], ids=[None, None])).filter("text = 'a b'").count() == 1


@pytest.mark.parametrize("w", [1, 2, 8])
def test_window_minima_are_leftmost(w):
    values = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    want = sorted({i + int(np.argmin(values[i:i + w])) for i in range(200 - w + 1)})
    assert pr.window_minima(values, w).tolist() == want
