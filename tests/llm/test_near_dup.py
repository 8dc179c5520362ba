"""Near-duplicates against all pairs by brute force, and odd rows."""

from __future__ import annotations

import random
import re
import time

import pytest

from fluxlens.llm.components import connected_components
from fluxlens.llm.near_dup import banding, keep_one_of_each, near_duplicates


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def as_dict(frame) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_given_documents_and_changed_copies(spark, rows_of):
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    for _, text in docs[:60]:
        words = text.split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((len(docs), " ".join(words)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert as_dict(got) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_short_texts_and_large_groups(spark):
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(words[: 1 + i % 30])) for i in range(120)]
    docs += [(1000 + i, " ".join([*words, "tail", str(i), str(i * 7)] + ["same"] * 3)) for i in range(150)]
    assert as_dict(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_rows(spark, odd_documents):
    rows = near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    named = {r.doc_id: r for r in rows}
    assert named[0].n_shingles == 0 and named[0].component_id == 0 and named[8].component_id == 8
    assert named[11].component_id == 3 and not named[11].kept
    assert [r.kept for r in rows if r.doc_id is None and r.n_shingles] == [False]
    kept = keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.where("doc_id = 11").isEmpty() and kept.where("doc_id = 3").count() == 2
    assert near_duplicates(odd_documents.limit(0)).isEmpty()


def test_chains_become_one_component(spark):
    links = [(i + 1, i) for i in range(60)] + [(100, 101), (100, 100), (None, 3)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_bands_follow_the_percentage():
    assert banding(85) == (24, 5)
    for percent in range(11, 101):
        bands, rows = banding(percent)
        assert bands * rows <= 128 and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    with pytest.raises(ValueError):
        banding(5)


@pytest.mark.parametrize("percent", [50, 80])
def test_pairs_at_lower_percentages(spark, percent):
    # pairs of 450 shingles with just the wanted share in common
    rng = random.Random(percent)
    docs = []
    for k in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(454)]
        kept = -(-2 * 450 * percent // (100 + percent)) + 4
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:kept] + [f"v{rng.randrange(10**9)}" for _ in range(454 - kept)]))]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: d - d % 2 for d, _ in docs}


def variants(count: int, first_id: int, seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    return [(first_id + i, " ".join([*base[: (k := rng.randrange(300))], f"x{i}", *base[k + 1 :]])) for i in range(count)]


def test_group_of_near_copies_takes_time_in_proportion(spark):
    """A template with many variants is one component; ten times as many take no hundred times as long."""
    seconds = []
    for count in (100, 1000, 10_000):
        frame = spark.createDataFrame(variants(count, 0, 5), "doc_id long, text string").repartition(8)
        started = time.perf_counter()
        assert {r.component_id for r in near_duplicates(frame).collect()} == {0}
        seconds.append(time.perf_counter() - started)
    assert seconds[2] < 13 * seconds[1]


def test_large_groups_that_meet_in_buckets_are_linked_exactly(spark):
    """Two templates with some words in common, variants between them, and chains whose ends are not alike."""
    a, b = variants(150, 0, 5), variants(150, 1000, 6)
    words_a, words_b = a[0][1].split(" "), b[0][1].split(" ")
    between = [(2000 + i, " ".join(words_a[: 10 * i] + words_b[10 * i :])) for i in range(31)]
    chain = [(3000 + i, " ".join(words_a[:260] + [f"c{j}" for j in range(i, i + 60)])) for i in range(0, 90, 3)]
    docs = a + b + between + chain
    assert as_dict(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs)
