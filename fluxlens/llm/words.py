"""Words of whole texts as 64-bit hashes, computed for many texts at once with NumPy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
SEGMENT_BYTES = 1 << 20
SPACE = bytes([32, *range(9, 14)])

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, with every ASCII sign that is neither letter nor digit as a space.
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BASE = U64(0x9E3779B97F4A7C15)
_MIXERS = tuple(U64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = values.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    table = np.cumprod(np.full(1 << 12, _BASE))

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            cls.table = np.cumprod(np.full(n + n // 2, _BASE))
        return cls.table


def _segments(texts: Sequence[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Texts joined into buffers of about SEGMENT_BYTES; longer texts are cut at white space only."""
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for owner, text in enumerate(texts):
        start = 0
        while start < len(text) or start == 0:
            stop = len(text)
            if stop - start > SEGMENT_BYTES:
                cuts = [c for c in (text.find(s, start + SEGMENT_BYTES) for s in (b" ", b"\n", b"\t")) if c >= 0]
                stop = min(cuts) + 1 if cuts else stop
            parts.append(text[start:stop])
            owners.append(owner)
            size += stop - start + 1
            start = max(stop, 1)
            if size >= SEGMENT_BYTES:
                yield b"\n".join(parts) + b"\n", owners, [len(p) + 1 for p in parts]
                parts, owners, size = [], [], 0
    if parts:
        yield b"\n".join(parts) + b"\n", owners, [len(p) + 1 for p in parts]


def word_hashes(texts: Sequence[bytes], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the position of each text's first word (one more at the end).

    A word is a run of bytes outside space and 0x09-0x0D, with A-Z lower-cased; with `plain` ASCII punctuation also
    divides words. Equal words have equal hashes in every process.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for joined, owners, sizes in _segments(texts):
        buffer = (_PLAIN if plain else _LOWER)[np.frombuffer(joined, np.uint8)]
        space = _SPACE[buffer]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, stops = edge[::2], edge[1::2]
        if not len(starts):
            continue
        lengths = stops - starts
        within = np.arange(len(buffer)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(buffer)]))))
        within[space] = 0
        terms = (buffer.astype(np.uint64) + U64(1)) * _Powers.upto(int(lengths.max()) + 1)[within]
        terms[space] = 0
        found.append(mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64)))
        marks = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        np.add.at(counts, owners, np.diff(marks))
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes, np.concatenate(([0], np.cumsum(counts)))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for every run of n words, n at most 5."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1] * _MIXERS[0]
    for j in range(1, n):
        total = total + words[j : len(words) - n + 1 + j] * _MIXERS[j]
    return mix(total)


def shingle_sets(texts: Sequence[bytes], n: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingles; a text of fewer words is one shingle, of none an empty set."""
    hashes, marks = word_hashes(texts)
    sets = []
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        words = hashes[a:b]
        if 0 < len(words) < n:
            short = np.add.reduce(words * np.asarray(_MIXERS[: len(words)])) + U64(len(words))
            sets.append(mix(np.asarray([short], np.uint64)))
        else:
            shingles = np.sort(grams(words, n))
            sets.append(shingles[np.diff(shingles, prepend=~shingles[:1]) != 0] if len(shingles) else shingles)
    return sets
