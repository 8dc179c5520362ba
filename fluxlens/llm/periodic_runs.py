"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

All prefixes' states lie on the automaton's link tree; the path from a prefix's state to the root holds all suffixes of
that prefix. Appending word i accesses that path. Every preferred path of the link-cut tree is coloured with the position
at which its strings occurred last, so an access walks over the path's segments from long to short suffixes, and a
segment of colour j whose longest string on the path has L words says: the words up to i and up to j agree for exactly L
words. With d = i - j at most L the last 2*d words are a square, and its period cannot be shorter: a root that is a power
would have occurred later than j. Every square with a primitive root shows up this way, as the last earlier occurrence of
its second half is its first half. Squares of one period at consecutive ends are one run, which began at j - L + 1.
An access changes O(log n) segments on average, so a text of n words takes O(n log n) steps whatever it holds.

A run of 12 words or more repeats some six words, so only the stretches of a text that consist of repeated six-word grams
go into an automaton. Each document is worked on where it lies: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import pieces, utf8
from fluxlens.llm.words import U64, mix

MIN_WORDS = 12
#: From this many words on, states are kept in compact arrays instead of lists.
COMPACT = 1 << 17

_SCHEMA = (
    "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _numbers(count: int, value: int) -> list[int] | array:
    return [value] * count if count < 2 * COMPACT else array("q", [value]) * count


class SuffixAutomaton:
    """States of all substrings of a word sequence; state 0 is the empty string.

    A state's first transition is kept in two plain columns, further ones in a dictionary, as most states have just one.
    """

    def __init__(self, symbols: Sequence[int]):
        room = 2 * len(symbols) + 2
        self.length, self.link = _numbers(room, 0), _numbers(room, -1)
        self.word, self.next = _numbers(room, -1), _numbers(room, 0)
        self.more: dict[int, dict[int, int]] = {}
        self.prefix_state = _numbers(len(symbols), 0)
        self.states = 1
        self._build(symbols)

    def _build(self, symbols: Sequence[int]) -> None:
        length, link, word, following, more = self.length, self.link, self.word, self.next, self.more
        last, states = 0, 1
        for i, symbol in enumerate(symbols):
            new = states
            states += 1
            length[new] = i + 1
            at, target = last, -1
            while at != -1:
                first = word[at]
                if first == symbol:
                    target = following[at]
                    break
                if first == -1:
                    word[at], following[at] = symbol, new
                else:
                    others = more.get(at)
                    if others is None:
                        more[at] = {symbol: new}
                    elif symbol in others:
                        target = others[symbol]
                        break
                    else:
                        others[symbol] = new
                at = link[at]
            if at == -1:
                link[new] = 0
            elif length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = states
                states += 1
                length[copy] = length[at] + 1
                link[copy], word[copy], following[copy] = link[target], word[target], following[target]
                if target in more:
                    more[copy] = dict(more[target])
                while at != -1:
                    if word[at] == symbol:
                        if following[at] != target:
                            break
                        following[at] = copy
                    elif at in more and more[at].get(symbol) == target:
                        more[at][symbol] = copy
                    else:
                        break
                    at = link[at]
                link[target] = link[new] = copy
            last = new
            self.prefix_state[i] = new
        self.states = states


class LinkCutPaths:
    """Preferred paths of a rooted tree as splay trees keyed by depth; each path has one colour, kept at its splay root."""

    def __init__(self, parents: Sequence[int], nodes: int):
        self.above = _numbers(nodes, -1)
        for node in range(nodes):
            self.above[node] = parents[node]
        self.left, self.right = _numbers(nodes, -1), _numbers(nodes, -1)
        self.colour = _numbers(nodes, -1)

    def _splay(self, node: int) -> None:
        """Rotate `node` to the top of its splay tree; `above` of a splay root is its path's parent in the tree."""
        above, left, right, colour = self.above, self.left, self.right, self.colour
        while True:
            parent = above[node]
            if parent == -1 or (left[parent] != node and right[parent] != node):
                return
            top = above[parent]
            inner = top != -1 and (left[top] == parent or right[top] == parent)
            if inner and (left[top] == parent) == (left[parent] == node):
                turns = (parent, node)
            elif inner:
                turns = (node, node)
            else:
                turns = (node,)
            for child in turns:
                over = above[child]
                high = above[over]
                if left[over] == child:
                    moved = right[child]
                    left[over], right[child] = moved, over
                else:
                    moved = left[child]
                    right[over], left[child] = moved, over
                if moved != -1:
                    above[moved] = over
                above[over], above[child] = child, high
                if high != -1 and left[high] == over:
                    left[high] = child
                elif high != -1 and right[high] == over:
                    right[high] = child
                else:
                    colour[child] = colour[over]

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Make the path from `node` to the root one path of this colour; gives (colour before, deepest node) of each segment on it."""
        above, right, colours = self.above, self.right, self.colour
        below, at = -1, node
        while at != -1:
            self._splay(at)
            before = colours[at]
            if before != -1:
                yield before, at
            deeper = right[at]
            if deeper != -1:
                colours[deeper] = before
            right[at] = below
            below, at = at, above[at]
        self._splay(node)
        colours[node] = colour


def runs_of(symbols: Sequence[int], shortest: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `shortest` symbols and twice its period, by start, then period."""
    automaton = SuffixAutomaton(symbols)
    paths = LinkCutPaths(automaton.link, automaton.states)
    length = automaton.length
    current: dict[int, list[int]] = {}
    found: list[tuple[int, int, int]] = []

    def close(period: int, start: int, end: int) -> None:
        if end - start + 1 >= shortest:
            found.append((start, end - start + 1, period))

    for i, state in enumerate(automaton.prefix_state):
        for before, deepest in paths.access(state, i):
            period, agree = i - before, length[deepest]
            if period <= agree:
                run = current.get(period)
                if run and run[1] == i - 1:
                    run[1] = i
                else:
                    if run:
                        close(period, *run)
                    current[period] = [before - agree + 1, i]
    for period, run in current.items():
        close(period, *run)
    return sorted(found)


def repeated_stretches(symbols: np.ndarray, shortest: int = MIN_WORDS) -> list[tuple[int, int]]:
    """[begin, end) of the stretches outside which no run of `shortest` symbols can lie.

    A run of n >= 2*q symbols agrees with itself q symbols on, for n - q >= n / 2 symbols: every symbol of it lies in a
    gram of shortest / 2 symbols that occurs twice. Grams are compared by hash, which can only add stretches.
    """
    width = (shortest + 1) // 2
    if len(symbols) < shortest:
        return []
    count = len(symbols) - width + 1
    gram = np.zeros(count, np.uint64)
    for j in range(width):
        gram = mix(gram * U64(0x9E3779B97F4A7C15) + symbols[j : j + count].astype(np.uint64) + U64(1))
    order = np.argsort(gram)
    same = np.diff(gram[order]) == 0
    if not same.any():
        return []
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(symbols) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    covered = np.cumsum(edges[:-1]) > 0
    marks = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(marks[::2], marks[1::2], strict=True) if b - a >= shortest]


def text_runs(words: Sequence[bytes], shortest: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    if len(words) < shortest:
        return []
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = []
    for begin, end in repeated_stretches(symbols, shortest):
        found += [(begin + s, n, q) for s, n, q in runs_of(symbols[begin:end].tolist(), shortest)]
    return found


def collapsed(words: Sequence[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    runs = list(runs)
    if not runs:
        return list(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def _rewritten(words: list[bytes], key: int | None) -> list[bytes]:
    """Words as the query asks for: for each tenth key all words from some position on repeat with a period."""
    if key is None or key % 10 or not words:
        return words
    group, n = key // 10, len(words)
    begin = group % n
    period = 1 + (n - begin) // (3 + group % 8)
    unit = words[begin : begin + period]
    times, rest = divmod(n - begin, period)
    return words[:begin] + unit * times + unit[:rest]


def _find(shortest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            keys = batch.column("key").to_pylist()
            for number, text, key in zip(batch.column("id").to_pylist(), utf8(batch.column("text")), keys, strict=True):
                words = _rewritten(text.split(), key)
                runs = text_runs(words, shortest)
                longest = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                shown = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                kept = b" ".join(collapsed(words, runs))
                rows.append((number, len(words), len(runs), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 7 + [pa.string()] * 2
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def periodic_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = MIN_WORDS, rewrite: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli), two digests.

    Words are numbered from 0 and divided by space and 0x09-0x0D; a run is a stretch of at least `shortest` words and
    twice its smallest period that cannot be longer on either side. Ties for the longest run go to the smallest start,
    then period; without a run the four values are null. `runs_sha256` is of all runs as lines `start,length,period`,
    `collapsed_sha256` of the text without the words that repeat a run's first period. A null or empty text has no words.
    `rewrite` first makes each document with crc32(identifier) % 10 = 0 periodic from some word on; a null identifier
    never is. Repeated rows give one row each; other columns are not read; an empty table gives no rows.
    """
    identifier = F.col(id_column).cast("long")
    key = F.crc32(identifier.cast("string").cast("binary")) if rewrite else F.lit(None).cast("long")
    texts = documents.select(identifier.alias("id"), F.col(text_column).cast("string").alias("text"), key.alias("key"))
    return texts.mapInArrow(_find(shortest), _SCHEMA).withColumnRenamed("id", "doc_id")
