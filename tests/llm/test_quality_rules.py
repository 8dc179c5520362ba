"""Weak supervision: measures by brute force, a fit that finds known accuracies, verdicts against labels, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from fluxlens.llm.quality_rules import fit_votes, judge


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def row(r) -> tuple:
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_given_documents(spark, rows_of):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in rows_of("documents", sf)}
    rows = {r.doc_id: r for r in judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert {d: row(r) for d, r in rows.items()} == {d: base(t) for d, t in texts.items()}
    known = [(bool(r["quality"]), rows[r["doc_id"]]) for r in rows_of("labels", sf) if not rows[r["doc_id"]].base_failed]
    assert np.mean([y == r.kept for y, r in known]) >= 0.97
    assert all(r.kept for y, r in known if y)


def test_odd_rows(spark, odd_documents):
    rows = judge(odd_documents).collect()
    texts = Counter(base(r.text) for r in odd_documents.collect())
    assert Counter(map(row, rows)) == texts
    assert not any(r.kept and r.base_failed for r in rows) and all(r.kept is not None for r in rows)
    assert judge(odd_documents.limit(0)).isEmpty()


def test_repeats_of_all_kinds(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices("ab", k=rng.randrange(12)))) for i in range(300)] + [(999, " ".join(rng.choices("abcdefghijkl", k=20_000)))]
    rows = {r.doc_id: r for r in judge(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: row(rows[i]) for i, _ in texts} == {i: base(t) for i, t in texts}


def test_fit_finds_known_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    accuracy, speaks = np.array([0.95, 0.9, 0.8, 0.7]), np.array([0.9, 0.6, 0.7, 0.8])
    right = rng.random((len(good), 4)) < accuracy
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 4)) < speaks)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    prior, odds = fit_votes(patterns)
    score = prior + sum(np.vectorize(o.get)(votes[:, i]) for i, o in enumerate(odds))
    assert ((score > 0) == good).mean() >= 0.93
    assert [round(o[1] - o[-1]) for o in odds] == sorted((round(o[1] - o[-1]) for o in odds), reverse=True)
    assert fit_votes([]) == (0.0, [])
