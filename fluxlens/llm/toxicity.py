"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

P(grade <= k) is a logistic function of (threshold k - score): one weight for each feature is shared by all ordered
thresholds. A document's features are its distinct words and their beginnings of four to six letters, each with the
number of distinct words that have it. Only features that tell grade 0 from the others are kept, so a model is small
whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.labelled import labelled_sample
from fluxlens.llm.tasks import pieces

#: Labelled documents of each class that are read for training.
DOCUMENTS_PER_CLASS = 5_000
#: Features of a model at most, the most telling first.
FEATURES = 4_096
BEGINNINGS = (4, 5, 6)
#: Grades of labels that only tell toxic from clean: up to so many marked words are grade 1, grade 2; more are grade 3.
GRADE_STEPS = (3, 7)

_SIGNS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    """The distinct words of a text in lower case, divided by everything in ASCII that is not a letter."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_SIGNS).split())


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings, the latter marked so that they differ from whole words."""
    text = word.decode("utf-8", "replace")
    return [word] + [text[:n].encode() + b"~" for n in BEGINNINGS if len(text) >= n]


@dataclass(frozen=True)
class SeverityModel:
    """Feature weights and ascending thresholds; without thresholds every text has grade 0."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def scorer(self, kept: int = 400_000):
        """Score of a set of words, with a bounded memory of the words' weights."""
        known: dict[bytes, float] = {}

        def score(found: set[bytes]) -> float:
            nonlocal known
            if len(known) > kept:
                known = {}
            for word in found.difference(known):
                known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
            return sum(map(known.__getitem__, found))

        return score

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - scores[:, None], -30, 30)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, rounds: int = 400, penalty: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient steps on the penalised likelihood; entries (row, column, value)."""
    levels = int(grades.max())
    weights = np.zeros(n_features)
    # the first threshold and the logarithms of the distances keep the order
    share = np.array([(grades > k).mean() for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    start = np.log(1 / share - 1)
    shape = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.1))))
    parts = [weights, shape]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    n = len(grades)
    for step in range(1, rounds + 1):
        weights, shape = parts
        gaps = np.exp(shape[1:])
        thresholds = shape[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        scores = np.bincount(rows, values * weights[columns], n)
        bounds = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper = 1 / (1 + np.exp(np.clip(scores - bounds[grades + 1], -30, 30)))
        lower = 1 / (1 + np.exp(np.clip(scores - bounds[grades], -30, 30)))
        lower[grades == 0], upper[grades == levels] = 0.0, 1.0
        width = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / width, lower * (1 - lower) / width
        by_score = (up - low) / n
        grad_w = np.bincount(columns, values * by_score[rows], n_features) + penalty * weights / max(1, n_features) ** 0.5
        by_bound = np.bincount(grades, -up, levels + 1)[:levels] + np.bincount(grades, low, levels + 1)[1 : levels + 1]
        by_bound = by_bound / n
        tail = np.cumsum(by_bound[::-1])[::-1]
        grad_s = np.concatenate(([tail[0]], tail[1:] * gaps))
        for i, gradient in enumerate((grad_w, grad_s)):
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.999 * second[i] + 0.001 * gradient**2
            rate = 0.1 * (1 - step / rounds) + 0.005
            parts[i] = parts[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    weights, shape = parts
    return weights, shape[0] + np.concatenate(([0.0], np.cumsum(np.exp(shape[1:]))))


def _telling(sample: DataFrame, limit: int) -> dict[bytes, float]:
    """Features whose presence moves the odds of grade 0 against the rest most, with that logarithm of odds."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, toxic = [], []
            for text, grade in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own = {f for w in words(text) for f in features(w)}
                found += own
                toxic += [int(grade > 0)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(toxic, pa.int64())], ["feature", "toxic"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    least = 3 if toxic >= 300 else 2
    odds = F.log((F.col("with_toxic") + 0.5) / (toxic + 1)) - F.log((F.col("with_clean") + 0.5) / (clean + 1))
    found = (
        sample.mapInArrow(spread, "feature binary, toxic long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("with_toxic"), F.sum(1 - F.col("toxic")).alias("with_clean"))
        .where((F.col("with_toxic") >= least) | (F.col("with_clean") >= 10 * least))
        .withColumn("odds", odds)
        .where("abs(odds) >= 0.7")
        .orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("with_toxic") + F.col("with_clean"))), "feature")
        .limit(limit)
    )
    return {bytes(r["feature"]): r["odds"] for r in found.collect()}


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = DOCUMENTS_PER_CLASS, limit: int = FEATURES, classes: tuple[int, ...] = (0, 1)) -> SeverityModel:
    """Fit on at most `per_class` labelled documents of each class.

    Labels of more than two classes are grades. Labels that only say toxic or clean (0, 1) are graded by the number of
    marked words: words with a feature whose odds are at least 20 to 1 for toxic text.
    """
    sample = labelled_sample(documents, labels, label, per_class, classes, skip_held_out=False)
    telling = _telling(sample, limit)
    if not telling:
        return SeverityModel({}, ())
    index = {f: i for i, f in enumerate(sorted(telling))}
    marks = {f for f, odds in telling.items() if odds >= np.log(20)}

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns, values, hits = [], [], []
            for text in batch.column("text").to_pylist():
                counts: dict[int, int] = {}
                marked = 0
                for word in words(text):
                    own = features(word)
                    marked += any(f in marks for f in own)
                    for f in own:
                        if f in index:
                            counts[index[f]] = counts.get(index[f], 0) + 1
                order = sorted(counts)
                columns.append(order)
                values.append([counts[c] for c in order])
                hits.append(marked)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(hits, pa.int32()), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))],
                ["doc_id", "label", "marked", "columns", "values"],
            )

    known = sample.mapInArrow(entries, "doc_id long, label int, marked int, columns array<int>, values array<int>")
    data = sorted(known.collect())  # at most `per_class` rows of each class, the kept features only
    grades = np.asarray([r["label"] for r in data])
    if len(classes) == 2:
        marked = np.asarray([r["marked"] for r in data])
        grades = np.where(grades > 0, 1 + sum((marked > s).astype(int) for s in GRADE_STEPS), 0)
    present, grades = np.unique(grades, return_inverse=True)
    if len(present) < 2:
        return SeverityModel({}, ())
    rows = np.repeat(np.arange(len(data)), [len(r["columns"]) for r in data])
    columns = np.concatenate([np.asarray(r["columns"], np.int64) for r in data])
    values = np.concatenate([np.asarray(r["values"], float) for r in data])
    weights, thresholds = fit_ordinal(rows, columns, values, grades, len(index))
    # a grade that no sampled document has is as far as the next one
    levels = [float(thresholds[np.searchsorted(present, k + 1) - 1]) for k in range(int(present[-1]))]
    return SeverityModel({f: float(weights[i]) for f, i in index.items() if weights[i]}, tuple(levels))


def rate(documents: DataFrame, model: SeverityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: doc_id, severity (expected grade), p_toxic (grade above 0), grade (likeliest), toxic.

    A null text is empty: it has no words and is rated by the thresholds alone. Null identifiers and repeated rows
    stay; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in pieces(batches):
            scores = np.asarray([score(words(t)) for t in batch.column("text").to_pylist()])
            above = model.above(scores) if model.thresholds else np.zeros((len(scores), 1))
            chances = -np.diff(np.concatenate((np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(documents: DataFrame, model: SeverityModel, text_column: str = "text") -> DataFrame:
    """The rows, all columns, whose text is more likely of grade 0 than of the others together."""
    at = documents.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in pieces(batches):
            if model.thresholds:
                scores = np.asarray([score(words(t)) for t in batch.column(at).to_pylist()])
                batch = batch.filter(pa.array(model.above(scores)[:, 0] < 0.5))
            yield batch

    return documents.mapInArrow(run, documents.schema)
