"""Small helpers for code that runs inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fluxlens.session import work_folder


def settled(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, where a lost executor takes nothing."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(frame.sparkSession, "checkpoint"))
    return frame.checkpoint()


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that work arrays stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, for input that is sorted by the keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
