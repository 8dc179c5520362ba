"""Quality by compression: dictionaries of good and of bad text, the difference in compressed size, calibrated.

Texts are compressed in blocks, once with a dictionary built from good text and once with one from bad text. A block's
difference is (good size - bad size) / larger size: below 0 where it resembles good text. A document is described by
its worst and its mean block and by how far its most repetitive block shrinks; a logistic curve fitted on documents
that were not used for the dictionaries turns that into the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.labelled import held_out, labelled_sample
from fluxlens.llm.tasks import pieces, utf8

BLOCK_BYTES = 512
DICTIONARY_BYTES = 32_768
LEVEL = 1
#: Labelled documents of each class that are read for training, half for the dictionaries, half for the calibration.
DOCUMENTS_PER_CLASS = 3_000
#: Blocks of each class that build a dictionary.
BLOCKS_PER_CLASS = 4_000


def blocks(text: bytes) -> list[bytes]:
    """The whole text in blocks of equal size, about BLOCK_BYTES each, so that no short rest stands alone."""
    n = max(1, round(len(text) / BLOCK_BYTES))
    marks = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]


class Compressors:
    """The two dictionaries, ready to compress; built once in each task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content) if content else None
        if data is not None:
            data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Worst block difference, mean difference, and compressed by raw size of the block that shrinks most."""
        differences, ratios = [], []
        for block in blocks(text):
            good, bad = (len(c.compress(block)) for c in self.pair)
            differences.append((good - bad) / max(good, bad))
            ratios.append(min(good, bad) / max(len(block), 64))
        return max(differences), sum(differences) / len(differences), min(ratios)


def _expand(features: np.ndarray) -> np.ndarray:
    """A constant and the features bent at their turning points, so that the score rises or falls throughout."""
    worst, mean, shrunk = features.reshape(-1, 3).T
    columns = [np.ones_like(worst)]
    for x, points in ((worst, (-0.05, 0.0, 0.05)), (mean, (-0.05, 0.0)), (shrunk, (0.25, 0.45))):
        columns.append(10 * np.clip(x - points[0], -0.3, 0))
        columns += [10 * np.clip(x - p, 0, 0.3) for p in points]
    return np.stack(columns, axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first column is the constant and is not penalised."""
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * weights)
        weights += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scores(self, compressors: Compressors, texts: Iterable[bytes]) -> np.ndarray:
        features = np.asarray([compressors.features(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(_expand(features) @ np.asarray(self.weights), -30, 30)))


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; too few of them serve as raw content."""
    samples = [s for s in samples if s]
    if len(samples) >= 100:
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too alike for the library's trainer
    return b"".join(samples)[:DICTIONARY_BYTES]


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = DOCUMENTS_PER_CLASS, blocks_per_class: int = BLOCKS_PER_CLASS) -> QualityModel:
    """Fit on labelled documents outside the held-out third. Without both classes every score is the share of class 1, or 0.5."""
    sample = labelled_sample(documents, labels, label, per_class).withColumn("for_calibration", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = zip(batch.column("label").to_pylist(), utf8(batch.column("text")), strict=True)
            found = [(label, b) for label, t in rows for line in set(t.split(b"\n")) for b in blocks(line)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["label", "block"])

    # distinct lines, so that a passage repeated in many documents weighs the same in both dictionaries
    parts = sample.where("not for_calibration").mapInArrow(cut, "label int, block binary")

    def chosen(value: int) -> list[bytes]:
        rows = parts.where(F.col("label") == value).distinct().orderBy(F.xxhash64("block"), "block").limit(blocks_per_class).collect()
        return [bytes(r["block"]) for r in rows]

    good, bad = dictionary(chosen(1)), dictionary(chosen(0))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(good, bad)
        for batch in pieces(batches):
            found = np.asarray([compressors.features(t) for t in utf8(batch.column("text"))], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(c) for c in found.T)], ["doc_id", "label", "worst", "mean", "shrunk"])

    known = sample.where("for_calibration").select("doc_id", "label", "text").mapInArrow(describe, "doc_id long, label int, worst double, mean double, shrunk double")
    rows = sorted(known.collect())  # at most `per_class` rows of each class
    y = np.asarray([r["label"] for r in rows], float)
    x = _expand(np.asarray([[r["worst"], r["mean"], r["shrunk"]] for r in rows], float))
    return QualityModel(good, bad, tuple(fit_logistic(x, y) if len(set(y)) == 2 else np.zeros(x.shape[1])))


def score_quality(documents: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted.

    Only the text is an input of the score. A null text is empty and gets the score of an empty text; null identifiers
    and repeated rows stay; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(model.good, model.bad)
        for batch in pieces(batches):
            scores = model.scores(compressors, utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
