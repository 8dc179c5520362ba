"""Tokens of whole texts from a public tokenizer file, word by word with a bounded memory of words already seen.

White space always ends a token of these vocabularies, so a text's tokens are those of its space-divided chunks in
order. A chunk's trailing signs are split off where the letter before them makes a token boundary certain.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from functools import lru_cache

#: Signs that may be split from the end of a chunk: never part of a special token's or a contraction's end.
_TAIL = '.,;:!?*#$%&)"]}'
#: Letters up to here have the same class, case and normal form in every Unicode version.
_SETTLED = "ɐ"
#: Chunks and parts of chunks remembered by each task process; beyond that its memory starts anew.
CHUNKS_KEPT = 300_000
PARTS_KEPT = 700_000


class _Memo(dict):
    """Values by key, each made once by `make`."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordMemory:
    """Values of chunks: a chunk's value is the sum (+) of its parts' values, and `value_of` makes those."""

    def __init__(self, value_of: Callable, nothing):
        self.nothing = nothing
        self.chunks = _Memo(self._chunk)
        self.parts = _Memo(value_of)

    def _chunk(self, chunk: str):
        value = self.nothing
        for part in _parts(chunk):
            value = value + self.parts[part]
        return value

    def values(self, text: str) -> Iterable:
        """The values of the text's chunks in order."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks.clear()
        if len(self.parts) > PARTS_KEPT:
            self.parts.clear()
        return map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))


def _parts(chunk: str) -> tuple[str, ...]:
    core = chunk.rstrip(_TAIL)
    tail = chunk[len(core) :]
    if tail and not (core and core[-1].isalpha() and core[-1] < _SETTLED and core[-1] != "İ"):
        core, tail = chunk, ""
    if core.isascii() or (max(core) < _SETTLED and "İ" not in core):
        if "<|" not in core:
            core = core.lower()
    if not tail:
        return (core,) if core else ()
    return core, tail


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, loaded once in each process."""
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> tuple[dict[tuple[str, str], int], str, tuple[str, ...]]:
    """Ranks of the merges of a BPE file, the ending that marks a word's last symbol, and the special strings."""
    import json

    with open(path, encoding="utf-8") as file:
        loaded = json.load(file)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in loaded["model"]["merges"]]
    specials = tuple(t["content"] for t in loaded["added_tokens"])
    return {m: rank for rank, m in enumerate(merges)}, loaded["model"].get("end_of_word_suffix") or "", specials


@lru_cache(maxsize=1)
def _byte_signs() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one sign: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def plain_word(part: str) -> str | None:
    """The signs of a part that is one lower-case word of settled letters, which needs no normalizing or splitting; else None."""
    if not part.isalpha() or part.lower() != part:
        return None
    if part.isascii():
        return part
    if max(part) >= _SETTLED:
        return None
    return part.encode().decode("latin-1").translate(_byte_signs())


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the adjacent pair of lowest rank, the leftmost first, is merged until none is left.

    A heap holds the mergeable pairs and a doubly linked list the symbols, so a word of n symbols takes n log n steps.
    """
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, first, second = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != first or j >= n or symbols[j] != second:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = first + second, ""
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return left
