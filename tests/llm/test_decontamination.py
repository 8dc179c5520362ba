"""Greedy string tiling against a plain version, planted and reordered passages, odd rows."""

from __future__ import annotations

import random
import re
import time
import tracemalloc

import numpy as np

from fluxlens.llm.decontamination import Searcher, contaminations, tiles, without_contaminated
from fluxlens.llm.words import word_hashes


def plain_tiles(text: list, pattern: list, least: int) -> int:
    """Words covered when the longest free common run is marked again and again."""
    free_t, free_p, covered = [True] * len(text), [True] * len(pattern), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and free_p[p + k] and free_t[t + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return covered
        for i in range(k):
            free_p[p + i] = free_t[t + i] = False
        covered += k


def split(text: str | None) -> list[str]:
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def test_tiles_cover_what_plain_tiling_covers():
    rng = random.Random(5)
    for _ in range(150):
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(60))]
        pattern = [rng.randrange(1, 5) for _ in range(rng.randrange(4, 30))]
        at = rng.randrange(len(text) + 1)
        text[at:at] = pattern[rng.randrange(3) :]
        found = tiles(np.asarray(text, np.uint64), np.asarray(pattern, np.uint64))
        used_p, used_t = set(), set()
        for p, t, k in found:
            assert k >= 4 and pattern[p : p + k] == text[t : t + k]
            assert used_p.isdisjoint(range(p, p + k)) and used_t.isdisjoint(range(t, t + k))
            used_p |= set(range(p, p + k))
            used_t |= set(range(t, t + k))
        left = [x if i not in used_t else -1 - i for i, x in enumerate(text)]
        rest = [x if i not in used_p else -1000 - i for i, x in enumerate(pattern)]
        assert plain_tiles(left, rest, 4) == 0
        assert abs(len(used_p) - plain_tiles(text, pattern, 4)) <= 4  # equally long tiles may be placed in another order


def test_given_documents_by_brute_force(spark, rows_of):
    docs, items = rows_of("documents"), rows_of("benchmark")
    rng = random.Random(1)
    extra = []
    for k, item in enumerate(items[:12]):
        w = item["text"].split()
        cut = rng.randrange(5, len(w) - 5)
        extra.append({"doc_id": 10_000 + k, "text": "before it " + " ".join(w[cut:]) + " between them " + " ".join(w[:cut]).upper() + " after"})
        extra.append({"doc_id": 20_000 + k, "text": "only " + " ".join(w[: len(w) // 3])})
    docs = docs + extra
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched_words for r in contaminations(frame, bench).collect()}
    want = {}
    for d in docs:
        text = split(d["text"])
        runs = {tuple(text[i : i + 4]) for i in range(len(text) - 3)}
        for i in items:
            pattern = split(i["text"])
            if any(tuple(pattern[k : k + 4]) in runs for k in range(len(pattern) - 3)) and (n := plain_tiles(text, pattern, 4)) * 2 >= len(pattern):
                want[d["doc_id"], i["item_id"]] = n
    assert got == want
    assert {10_000 + k for k in range(12)} <= {d for d, _ in got} and not any(d >= 20_000 for d, _ in got)
    blocks = {(r.doc_id, r.item_id): r.matched_words for r in contaminations(frame, bench, block_bytes=2000).collect()}
    assert blocks == want
    kept = {r.doc_id for r in without_contaminated(frame, bench).collect()}
    assert kept == {d["doc_id"] for d in docs} - {d for d, _ in want}


def test_odd_rows(spark, odd_documents):
    bench = spark.createDataFrame([(1, "a b c d e a b c d e"), (1, "a b c d e a b c d e"), (None, "long long long long"), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in contaminations(odd_documents, bench).collect()}
    assert got == {(7, 1, 1.0), (15, 1, 1.0), (4, None, 1.0), (12, None, 1.0)}
    kept = without_contaminated(odd_documents, bench)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 4
    for frame, items in ((odd_documents.limit(0), bench), (odd_documents, bench.limit(0))):
        assert contaminations(frame, items).isEmpty()
    assert without_contaminated(odd_documents, bench.limit(0)).count() == odd_documents.count()


def test_words_that_text_and_item_repeat_take_linear_time_and_memory():
    """A million equal words against an item of as equal ones: found once, without all pairs of places."""
    for unit, words in ((b"a ", 400), (b"a b ", 200)):
        hashes, _ = word_hashes([unit * words], plain=True)
        searcher = Searcher([hashes], 0.5)
        tracemalloc.start()
        started = time.perf_counter()
        found = list(searcher.search([unit * (1_000_000 // len(unit.split())), b"nothing of it"]))
        seconds, peak = time.perf_counter() - started, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [(t, i, sum(x[2] for x in tiled)) for t, i, tiled in found] == [(0, 0, 400)]
        assert seconds < 90 and peak < 500 << 20
