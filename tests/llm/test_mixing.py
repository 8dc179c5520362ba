"""Mixing against targets found by repeated resharing, and the words taken against the targets."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from fluxlens.llm.mixing import mix, planned_copies


def targets(sizes: dict, weights=(3, 1, 2), percent=150, most=2) -> dict:
    """Share, cut what is above its limit, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = percent * sum(sizes.values()) / 100, set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= above


def size_of(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got, **options):
    sizes: dict = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    want, taken, largest = targets(sizes, **options), defaultdict(int), defaultdict(int)
    source_of = {i: s for i, _, s in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, size_of(t)) for i, t, _ in rows)
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        share = want[source] / sizes[source] if sizes[source] else 0
        assert int(share) <= r.copies <= int(share + 1) and r.taken == r.copies * r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_targets_and_words_taken(spark):
    rng = random.Random(5)
    sources = ["a", "B", "é", "", None, "\U0001f600", "z"]
    rows = [(i, "w " * min(rng.randrange(1, 60), rng.randrange(1, 400)), rng.choices(sources, [50, 1, 1, 9, 5, 2, 3])[0]) for i in range(1500)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = planned_copies(documents).collect()
    check(rows, got)
    assert sorted(map(tuple, planned_copies(documents.repartition(7)).collect())) == sorted(map(tuple, got))
    check(rows, planned_copies(documents, weights=(1, 5), percent=80, most_copies=4).collect(), weights=(1, 5), percent=80, most=4)
    assert all(r.copies == 2 for r in planned_copies(documents, percent=500).collect())  # no more than two of each can be had


def test_given_documents(spark, rows_of):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in rows_of("documents")]
    check(rows, planned_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_the_mix_repeats_whole_rows(spark, rows_of):
    rows = [(r["doc_id"], r["text"], r["source"], 1.0) for r in rows_of("documents")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    copies = {r.doc_id: r.copies for r in planned_copies(documents).collect()}
    mixed = mix(documents)
    assert mixed.columns == documents.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_one_source_with_most_rows_and_equal_rows(spark):
    rows = [(1, "one two three", "hot")] * 3000 + [(i, "w " * (i % 9), "cold") for i in range(600)]
    got = planned_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = sum(r.taken for r in got if r.source_size == 9000)
    assert abs(taken - next(r.target for r in got if r.source_size == 9000)) <= 3


def test_odd_documents(spark, odd_documents):
    got = planned_copies(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(r.taken == r.copies * r.size <= 2 * r.size for r in got)
    assert planned_copies(odd_documents.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (None, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in planned_copies(blank).collect()] == [(0, 0.0, 0)] * 2
