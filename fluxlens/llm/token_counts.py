"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.bpe import WordMemory, merge_ranks, merged_count, plain_word, tokenizer
from fluxlens.llm.tasks import pieces


def counter(path: str) -> WordMemory:
    """Token counts of chunks: the file's normalizer and splitter give the words, heap merging their counts."""
    ranks, ending, specials = merge_ranks(path)
    loaded = tokenizer(path)
    special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")

    def merged(word: str) -> int:
        symbols = list(word)
        symbols[-1] += ending
        return merged_count(symbols, ranks)

    def count(text: str) -> int:
        word = plain_word(text)
        if word is not None:
            return merged(word)
        return sum(merged(w) for w, _ in loaded.pre_tokenizer.pre_tokenize_str(loaded.normalizer.normalize_str(text)))

    def with_specials(text: str) -> int:
        if special.search(text):
            return len(special.findall(text)) + sum(map(count, special.split(text)))
        return count(text)

    return WordMemory(with_specials, 0)


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than `limit`).

    `vocabulary` is the path of a BPE file, the same on every executor. A null text is empty: 0 bytes, 0 tokens.
    Null identifiers and repeated rows stay as they are, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = counter(vocabulary)
        for batch in pieces(batches):
            counts = [sum(memory.values(t)) if t else 0 for t in batch.column("text").to_pylist()]
            sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
