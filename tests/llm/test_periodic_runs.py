"""Periodic runs against the definition, for symbols and for whole documents."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest

from fluxlens.llm.periodic_runs import COMPACT, collapsed, periodic_runs, runs_of, text_runs


def brute(s, shortest=12) -> list[tuple[int, int, int]]:
    """All maximal stretches with a period that are long enough, kept under their smallest period."""
    spans: dict[tuple[int, int], int] = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                spans.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in spans.items())


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_random_words(shortest):
    rng = random.Random(shortest)
    for _ in range(600):
        n, letters = rng.randrange(70), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.5:
            a, p = rng.randrange(n // 2), rng.randrange(1, 12)
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
        assert runs_of(s, shortest) == brute(s, shortest)
        assert text_runs([b"%d" % x for x in s], shortest) == brute(s, shortest)


def test_fibonacci_and_long_texts():
    short, word = [0], [0, 1]
    while len(word) < 400:
        short, word = word, word + short
    assert runs_of(word) == brute(word)
    n = COMPACT * 2  # kept in compact arrays
    begin = time.perf_counter()
    assert text_runs([b"a"] * n) == [(0, n, 1)]
    assert text_runs([b"%d" % (i % 1000) for i in range(n)]) == [(0, n, 1000)]
    assert time.perf_counter() - begin < 60


def test_collapse_keeps_the_first_period():
    words = b"x a b a b a b a b a b a b y".split()
    assert collapsed(words, text_runs(words)) == b"x a b y".split()


def expected(doc_id, text, rewrite):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(words), len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("rewrite", [False, True])
def test_documents(spark, rows_of, rewrite):
    rows = [(r["doc_id"], " ".join((r["text"] or "").split(" ")[:400])) for r in rows_of("documents")]
    rows += [(1000 + i, "to be or not " * i) for i in range(12)] + [(7, "a\tb\nc\x0bd " * 9), (7, "a\tb\nc\x0bd " * 9), (None, "z " * 12)]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), rewrite=rewrite)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(i, t, rewrite) for i, t in rows), key=repr)


def test_odd_documents(spark, odd_documents):
    got = {(r.doc_id, r.n_words): r for r in periodic_runs(odd_documents).collect()}
    assert periodic_runs(odd_documents).count() == odd_documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[0, 0].n_runs, got[0, 0].runs_sha256, got[0, 0].collapsed_sha256) == (0, empty, empty)
    assert (got[4, 60_000].start, got[4, 60_000].length, got[4, 60_000].period) == (0, 60_000, 1)
    assert (got[7, 2000].length, got[7, 2000].period) == (2000, 5)
    assert periodic_runs(odd_documents.limit(0)).collect() == []
