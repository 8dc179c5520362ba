"""Packing of token sequences: exact complements found by hashing length sums, then best fit for the rest.

Tokens are counted out in tasks. What the packing needs to know is only how many pieces there are of each length, at
most `capacity` numbers whatever the corpus, so the plan is made on that histogram: how often each combination of
lengths is used. A piece's rank among those of its length then says which sequence of which combination it fills.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxlens.llm.bpe import WordMemory, plain_word, tokenizer
from fluxlens.llm.tasks import pieces, settled

CAPACITY = 2048
#: Pieces of one length that are ranked in one task.
RANK_ROWS = 50_000

Combination = tuple[tuple[int, ...], int]


def token_memory(path: str) -> WordMemory:
    """Little-endian 32-bit identifiers of chunks, as the library gives them without added special tokens."""

    loaded = tokenizer(path)

    def encode(part: str) -> bytes:
        signs = plain_word(part)
        if signs is None:
            ids = loaded.encode(part, add_special_tokens=False).ids
        else:
            ids = [token.id for token in loaded.model.tokenize(signs)]
        return pack_ids(f"<{len(ids)}I", *ids)

    return WordMemory(encode, b"")


def token_pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's tokens and the end token, cut into pieces of `capacity`: doc_id, piece, start, length, ids_crc32."""
    closing = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = token_memory(vocabulary)
        for batch in pieces(batches):
            owner, start, length, crc = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = b"".join(memory.values(text)) + closing if text else closing
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    owner.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
            starts = pa.array(start, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int32())),
                    pa.array([s // capacity for s in start], pa.int32()),
                    starts,
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Combinations of lengths under the counts that are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.capacity = capacity
        self.made: list[Combination] = []

    def use(self, lengths: tuple[int, ...]) -> bool:
        """Fill as many sequences as the counts allow with these lengths."""
        needed: dict[int, int] = {}
        for length in lengths:
            needed[length] = needed.get(length, 0) + 1
        times = min(int(self.left[length]) // n for length, n in needed.items())
        if times:
            for length, n in needed.items():
                self.left[length] -= times * n
            self.made.append((lengths, times))
        return times > 0

    def pairs(self, gap: int) -> np.ndarray:
        """First parts of the pairs whose sum is the gap, the more even first part last."""
        first = np.arange(1, gap // 2 + 1)
        return first[(self.left[first] > 0) & (self.left[gap - first] > 0) & ((first * 2 != gap) | (self.left[first] > 1))]

    def exact(self) -> None:
        """Largest lengths first, look up one, two or three lengths whose sum is exactly the gap."""
        if self.left[self.capacity]:
            self.use((self.capacity,))
        for largest in range(self.capacity - 1, 0, -1):
            gap = self.capacity - largest
            if self.left[largest] and gap <= self.capacity and self.left[gap]:
                self.use((largest, gap))
        for largest in range(self.capacity - 1, 0, -1):
            gap = self.capacity - largest
            if self.left[largest]:
                for first in self.pairs(gap):
                    if not self.left[largest]:
                        break
                    self.use((largest, gap - int(first), int(first)))
        for largest in range(self.capacity - 1, 0, -1):
            gap = self.capacity - largest
            for second in range(min(gap - 2, largest), gap // 3, -1):
                if not self.left[largest]:
                    break
                if self.left[second]:
                    for first in self.pairs(gap - second):
                        if not (self.left[largest] and self.left[second]):
                            break
                        self.use((largest, second, gap - second - int(first), int(first)))

    def best_fit(self) -> None:
        """What is left, longest first: into the open sequences with the smallest sufficient gap, else into new ones."""
        open_: dict[int, list[Combination]] = {}
        gaps: list[int] = []

        def add(lengths: tuple[int, ...], times: int) -> None:
            gap = self.capacity - sum(lengths)
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((lengths, times))

        for length in range(self.capacity, 0, -1):
            count = int(self.left[length])
            while count:
                at = bisect_left(gaps, length)
                if at == len(gaps):
                    each = self.capacity // length
                    if count >= each:
                        add((length,) * each, count // each)
                    if count % each:
                        add((length,) * (count % each), 1)
                    break
                gap = gaps[at]
                lengths, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
                each = min(gap // length, -(-count // times))
                taken = min(times, count // each)
                add(lengths + (length,) * each, taken)
                if times > taken:
                    add(lengths, times - taken)
                count -= taken * each
            self.left[length] = 0
        self.made += [c for group in open_.values() for c in group]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """(lengths, times) whose use consumes exactly the given counts of lengths, each sum at most the capacity."""
    plan = _Plan(counts, capacity)
    plan.exact()
    plan.best_fit()
    return plan.made


def _intervals(plan: list[Combination]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank) with the sequence of that rank and the offset in it."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append(((length << 40) | rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    keys, first, offsets = (np.asarray(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return keys, first, offsets


def _ranked(found: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Each piece's rank (from 0) among those of its length, counted in shares of bounded size."""
    hot = {length: -(-count // RANK_ROWS) for length, count in counts.items() if count > RANK_ROWS}
    shares = F.lit(1).cast("long")
    if hot:
        shares = F.coalesce(F.create_map([F.lit(x) for pair in hot.items() for x in pair])[F.col("length")].cast("long"), shares)
    shared = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), shares))
    before = (
        shared.groupBy("length", "share").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n"))
        .select("length", "share", "before")
    )
    place = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return shared.withColumn("place", place).join(before, ["length", "share"]).withColumn("rank", F.col("place") + F.col("before"))


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end token alone. Rows with null or repeated identifiers are packed like
    others. Other columns are not read; an empty table gives no rows.
    """
    found = settled(token_pieces(documents, vocabulary, capacity, end, id_column, text_column))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    keys, first, offsets = _intervals(packing_plan(counts, capacity))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            key = (length << 40) | rank
            at = np.searchsorted(keys, key, side="right") - 1
            sequence = first[at] + key - keys[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = _ranked(found, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
