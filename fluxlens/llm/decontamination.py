"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared where they share runs of four words (seeds). Tiles are the longest common
runs that overlap no other tile, found by running Karp-Rabin over lengths that halve from a long one; the share of the
item's words under tiles is its coverage, whatever their order in the document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import pieces
from fluxlens.llm.words import U64, grams, word_hashes

SEED_WORDS = 4
COVERAGE = 0.5
#: Bytes of benchmark text that are searched in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
_FIRST_LENGTH = 20
_FILTER_BITS = 22

_BASE = 0x9E3779B97F4A7C15
_INVERSE = U64(pow(_BASE, -1, 1 << 64))


def _windows(words: np.ndarray, length: int) -> np.ndarray:
    """Rolling hashes of all runs of `length` words: differences of one running sum, brought to the same power."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.concatenate(([U64(1)], np.full(len(words), U64(_BASE)))))
    back = np.cumprod(np.concatenate(([U64(1)], np.full(len(words), _INVERSE))))
    sums = np.concatenate(([U64(0)], np.cumsum(words * powers[:-1])))
    return (sums[length:] - sums[:-length]) * back[: len(words) - length + 1]


def tiles(text: np.ndarray, pattern: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(position in pattern, position in text, length) of the greedy tiling; longer tiles are placed first."""
    taken_t, taken_p = np.zeros(len(text), bool), np.zeros(len(pattern), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(_FIRST_LENGTH, len(pattern)))
    while True:
        sizes, at_p, at_t = _scan(text, pattern, taken_t, taken_p, length)
        longest = int(sizes.max(initial=0))
        if longest > 2 * length:
            length = longest
            continue
        order = np.lexsort((at_t, at_p, -sizes))
        sizes, at_p, at_t = sizes[order], at_p[order], at_t[order]
        clipped = False
        while len(sizes):
            size, p, t = int(sizes[0]), int(at_p[0]), int(at_t[0])
            taken_p[p : p + size] = taken_t[t : t + size] = True
            found.append((p, t, size))
            left = ((at_p >= p + size) | (at_p + sizes <= p)) & ((at_t >= t + size) | (at_t + sizes <= t))
            clipped |= int(left.sum()) < len(left) - 1
            sizes, at_p, at_t = sizes[left], at_p[left], at_t[left]
        if clipped and len(_scan(text, pattern, taken_t, taken_p, length)[0]):
            continue  # what is left of matches that others have cut
        if length <= least:
            return sorted(found)
        length = max(least, length // 2)


def _scan(text: np.ndarray, pattern: np.ndarray, taken_t: np.ndarray, taken_p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of at least `length` free equal words: their lengths, positions in the pattern and in the text.

    For each place of the pattern all places of the text are looked at together, and only those where a run begins go on,
    so a word that both repeat many times makes as many runs as it has places in the text, not pairs of places.
    """

    def free(taken: np.ndarray) -> np.ndarray:
        counts = np.concatenate(([0], np.cumsum(taken)))
        return np.flatnonzero(counts[length:] == counts[:-length]) if len(taken) >= length else np.zeros(0, np.int64)

    at_t, at_p = free(taken_t), free(taken_p)
    none = np.zeros(0, np.int64)
    if not len(at_t) or not len(at_p):
        return none, none, none
    hash_p = _windows(pattern, length)[at_p]
    hash_t = _windows(text, length)[at_t]
    near = np.isin(hash_t, hash_p)
    hash_t, at_t = hash_t[near], at_t[near]
    order = np.argsort(hash_t, kind="stable")
    hash_t, at_t = hash_t[order], at_t[order]
    first, last = np.searchsorted(hash_t, hash_p, side="left"), np.searchsorted(hash_t, hash_p, side="right")
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    for p, a, b in zip(at_p.tolist(), first.tolist(), last.tolist(), strict=True):
        places = at_t[a:b]
        if p and not taken_p[p - 1] and len(places):
            before = places - 1
            places = places[(places == 0) | (text[before] != pattern[p - 1]) | taken_t[before]]  # else part of a run that begins earlier
        if len(places):
            sizes = _extended(text, pattern, taken_t, taken_p, p, places)
            whole = sizes >= length
            found.append((sizes[whole], p, places[whole]))
    if not found:
        return none, none, none
    return np.concatenate([s for s, _, _ in found]), np.repeat([p for _, p, _ in found], [len(s) for s, _, _ in found]), np.concatenate([t for _, _, t in found])


def _extended(text: np.ndarray, pattern: np.ndarray, taken_t: np.ndarray, taken_p: np.ndarray, p: int, places: np.ndarray) -> np.ndarray:
    """How far the free words from `p` and from each of the places agree."""
    if len(places) == 1:
        t = int(places[0])
        end = min(len(pattern) - p, len(text) - t)
        same = (pattern[p : p + end] == text[t : t + end]) & ~taken_p[p : p + end] & ~taken_t[t : t + end]
        return np.asarray([end if same.all() else int(same.argmin())])
    sizes = np.zeros(len(places), np.int64)
    going = np.arange(len(places))
    for step in range(len(pattern) - p):
        at = places[going] + step
        going, at = going[at < len(text)], at[at < len(text)]
        going = going[(text[at] == pattern[p + step]) & ~taken_t[at]] if not taken_p[p + step] else going[:0]
        if not len(going):
            break
        sizes[going] = step + 1
    return sizes


class Searcher:
    """Finds the items of one block of the benchmark in texts."""

    def __init__(self, items: Sequence[np.ndarray], coverage: float):
        self.items, self.coverage = items, coverage
        seeds = [grams(i, SEED_WORDS) for i in items]
        hashes = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(x) for x in seeds])
        place = np.concatenate([np.arange(len(x)) for x in seeds]) if seeds else owner
        order = np.lexsort((place, owner, hashes))
        hashes, owner, self.place = hashes[order], owner[order], place[order]
        # a seed of an item is one row, however often the item repeats it; its places are a stretch of `place`
        head = np.flatnonzero((np.diff(hashes, prepend=~hashes[:1]) != 0) | (np.diff(owner, prepend=-1) != 0))
        self.seeds, self.owner = hashes[head], owner[head]
        self.begin, self.end = head, np.append(head[1:], len(hashes)).astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def search(self, texts: Sequence[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) of every pair whose coverage reaches the threshold."""
        if not len(self.seeds):
            return
        hashes, marks = word_hashes(texts, plain=True)
        runs = grams(hashes, SEED_WORDS)
        at = np.flatnonzero(self.filter[(runs & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        first = np.searchsorted(self.seeds, runs[at], side="left")
        last = np.searchsorted(self.seeds, runs[at], side="right")
        text = np.searchsorted(marks, at, side="right") - 1
        inside = (last > first) & (at + SEED_WORDS <= marks[text + 1])
        if not inside.any():
            return
        at, first, last, text = at[inside], first[inside], last[inside], text[inside]
        # each different seed of a text once; `first` names the seed
        once = np.unique(np.stack((text, first, last)), axis=1)
        counts = once[2] - once[1]
        which = np.repeat(once[1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pairs = np.stack((np.repeat(once[0], counts), self.owner[which], which, np.repeat(once[1], counts)))
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        edges = np.flatnonzero((np.diff(pairs[0], prepend=-1) != 0) | (np.diff(pairs[1], prepend=-1) != 0))
        hits = np.searchsorted(text, np.arange(len(marks)))
        for a, b in zip(edges, [*edges[1:], pairs.shape[1]], strict=True):
            owner, number = int(pairs[0, a]), int(pairs[1, a])
            item = self.items[number]
            need = self.coverage * len(item)
            places = np.concatenate([self.place[self.begin[w] : self.end[w]] for w in pairs[2, a:b]])
            if _covered(places, len(item)).sum() < need:
                continue  # not even all seeds together cover enough
            mine = slice(hits[owner], hits[owner + 1])
            begin = marks[owner]
            seeded = at[mine][np.isin(first[mine], pairs[3, a:b])] - begin
            covered = np.flatnonzero(_covered(seeded, int(marks[owner + 1] - begin)))
            gaps = np.flatnonzero(np.diff(covered) > 1) + 1
            words = hashes[begin + covered]
            near = np.insert(words, gaps, U64(0)) if len(gaps) else words
            found = tiles(near, item)
            if sum(t[2] for t in found) >= need:
                yield owner, number, found


def _covered(places: np.ndarray, words: int) -> np.ndarray:
    """Which words lie under the seeds at some places."""
    edges = np.zeros(words + SEED_WORDS + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + SEED_WORDS, -1)
    return np.cumsum(edges)[:words] > 0


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in column.to_pylist()]


def benchmark_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """The distinct items with four words or more as word hashes, in blocks of about `block_bytes` of text."""
    items = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == block).orderBy("item_id", "text").collect()  # about `block_bytes`
        hashes, marks = word_hashes([r["text"].lower().encode("utf-8", "replace") for r in rows], plain=True)
        words = [hashes[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
        kept = [i for i, w in enumerate(words) if len(w) >= SEED_WORDS]
        yield [rows[i]["item_id"] for i in kept], [words[i] for i in kept]


def contaminations(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item of which at least `coverage` is found in it.

    Columns: doc_id, item_id, coverage, n_tiles, longest_tile, matched_words, item_words. Words are lower-cased and
    divided by white space and ASCII punctuation. Null texts match nothing, items of fewer than four words are too short
    to tell and are left out, equal items count under each identifier, rows with null or repeated identifiers are
    searched like others, other columns are not read, and an empty table on either side gives no rows.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int, matched_words int, item_words int"
    result = None
    for ids, items in benchmark_blocks(benchmark, block_bytes=block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast((ids, items))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, items = shared.value
            searcher = Searcher(items, coverage)
            for batch in pieces(batches):
                owners = batch.column("doc_id").to_pylist()
                rows = []
                for text, item, found in searcher.search(_texts(batch.column("text"))):
                    sizes = [t[2] for t in found]
                    total = len(items[item])
                    rows.append((owners[text], ids[item], sum(sizes) / total, len(sizes), max(sizes), sum(sizes), total))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

        part = texts.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result


def without_contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, all columns, in which no benchmark item is covered to the threshold. Nothing is shuffled."""
    at = documents.columns.index(text_column)
    for _, items in benchmark_blocks(benchmark, block_bytes=block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, coverage)
            for batch in pieces(batches):
                clean = np.ones(batch.num_rows, bool)
                for text, _, _ in searcher.search(_texts(batch.column(at))):
                    clean[text] = False
                yield batch.filter(pa.array(clean))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
