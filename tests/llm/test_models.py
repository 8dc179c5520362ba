"""Trained text models: accuracy on rows they have not seen, and odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from fluxlens.llm import quality_zstd, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))


def test_quality_on_the_held_out_third(spark, tables, rows_of, odd_documents):
    documents, labels = tables
    model = quality_zstd.train(documents, labels)
    rows = {r.doc_id: r for r in quality_zstd.score_quality(documents, model).collect()}
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    known = [(r["quality"], rows[r["doc_id"]]) for r in rows_of("labels", SF)]
    held = [(y, r) for y, r in known if r.held_out]
    assert np.mean([y == r.predicted for y, r in held]) >= 0.95
    good, bad = ([r.score for y, r in held if y == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    odd = quality_zstd.score_quality(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in odd)
    assert quality_zstd.score_quality(odd_documents.limit(0), model).isEmpty()


def test_quality_learns_nothing_from_held_out_rows(spark, tables):
    documents, labels = tables
    lying = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert quality_zstd.train(documents, labels) == quality_zstd.train(documents, lying)


def test_quality_without_labels(spark, tables, odd_documents):
    model = quality_zstd.train(odd_documents, tables[1].limit(0))
    assert {r.score for r in quality_zstd.score_quality(odd_documents, model).collect()} == {0.5}


def test_toxicity_on_unseen_rows(spark, tables, rows_of, odd_documents):
    documents, labels = tables
    model = toxicity.train(documents, labels.where("doc_id % 3 <> 0"))
    rows = {r.doc_id: r for r in toxicity.rate(documents, model).collect()}
    held = [(bool(r["toxic"]), rows[r["doc_id"]]) for r in rows_of("labels", SF) if r["doc_id"] % 3 == 0]
    assert np.mean([y == r.toxic for y, r in held]) >= 0.98
    assert np.mean([r.toxic for y, r in held if y]) >= 0.9
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    kept = toxicity.without_toxic(documents, model)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if not r.toxic}
    odd = toxicity.rate(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and not any(r.toxic for r in odd)
    assert toxicity.without_toxic(odd_documents, model).count() == odd_documents.count()


def test_toxicity_without_labels(spark, tables, odd_documents):
    model = toxicity.train(odd_documents, tables[1].limit(0))
    assert {(r.severity, r.toxic) for r in toxicity.rate(odd_documents, model).collect()} == {(0.0, False)}


def test_ordinal_fit_recovers_order_and_shared_weights():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (4000, 5)).astype(float)
    score = x @ [2.0, 1.0, 0.0, -1.0, 0.5] + rng.logistic(size=4000)
    grades = np.searchsorted([1.0, 3.0, 5.0], score)
    rows, columns = np.nonzero(x)
    weights, thresholds = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, 5)
    assert np.allclose(weights, [2, 1, 0, -1, 0.5], atol=0.2) and np.allclose(thresholds, [1, 3, 5], atol=0.3)


def plain_quality(text: str | None, model) -> float:
    """The score of one text by the definition: blocks one by one, bends one by one."""
    raw = (text or "").encode()
    n = max(1, round(len(raw) / 512))
    sizes = []
    for i in range(n):
        block = raw[len(raw) * i // n : len(raw) * (i + 1) // n]
        pair = []
        for content in (model.good, model.bad):
            made = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            pair.append(len(made.compress(block)))
        sizes.append((len(block), *pair))
    differences = [(g - b) / max(g, b) for _, g, b in sizes]
    shrunk = min(min(g, b) / max(size, 64) for size, g, b in sizes)
    bends = [1.0]
    for x, points in ((max(differences), (-0.05, 0.0, 0.05)), (math.fsum(differences) / n, (-0.05, 0.0)), (shrunk, (0.25, 0.45))):
        bends.append(10 * min(0.0, max(-0.3, x - points[0])))
        bends += [10 * min(0.3, max(0.0, x - p)) for p in points]
    return 1 / (1 + math.exp(-math.fsum(w * v for w, v in zip(model.weights, bends, strict=True))))


def test_quality_scores_by_brute_force(spark, tables, rows_of):
    documents, labels = tables
    model = quality_zstd.train(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in rows_of("documents", SF)}
    rows = quality_zstd.score_quality(documents, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_quality(texts[r.doc_id], model)
        assert math.isclose(r.score, want, abs_tol=1e-9) and r.predicted == (r.score >= 0.5), r.doc_id


def plain_severity(text: str | None, model) -> list[float]:
    """P(grade > k) for each threshold by the definition, feature by feature."""
    score = 0.0
    for word in set(re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())):
        for feature in (word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) >= n)):
            score += model.weights.get(feature.encode(), 0.0)
    return [1 / (1 + math.exp(min(30.0, max(-30.0, t - score)))) for t in model.thresholds]


def test_severity_by_brute_force(spark, tables, rows_of):
    documents, labels = tables
    model = toxicity.train(documents, labels)
    assert model.thresholds and model.weights
    texts = {r["doc_id"]: r["text"] for r in rows_of("documents", SF)}
    rows = toxicity.rate(documents, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        above = plain_severity(texts[r.doc_id], model)
        chances = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert math.isclose(r.severity, math.fsum(above), abs_tol=1e-9) and math.isclose(r.p_toxic, above[0], abs_tol=1e-9), r.doc_id
        assert chances[r.grade] >= max(chances) - 1e-9 and r.toxic == (r.p_toxic >= 0.5), r.doc_id


def test_severity_learns_real_grades(spark):
    """Grades 0 to 3 given as labels are learned as they are and found again on rows that were not learned from."""
    random.seed(8)
    steps = [("river", "garden", "window"), ("rude", "silly"), ("nasty", "harsh"), ("vile", "brutal")]
    grades = [i % 4 for i in range(1600)]
    texts = [" ".join([*random.choices(steps[0], k=12), *random.choices(steps[g], k=4 if g else 0)]) for g in grades]
    table = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, grades, strict=True))], "doc_id long, text string, grade int")
    model = toxicity.train(table, table.where("doc_id < 1200").select("doc_id", "grade"), label="grade", classes=(0, 1, 2, 3))
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    unseen = [(grades[r.doc_id], r) for r in toxicity.rate(table.where("doc_id >= 1200"), model).collect()]
    assert len(unseen) == 400
    assert np.mean([g == r.grade for g, r in unseen]) >= 0.95
    assert np.mean([abs(g - r.severity) for g, r in unseen]) <= 0.4
