"""The prefix trie against one built in memory."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from fluxlens.llm.prefix_trie import conversation_trie


def brute(rows, rebuild=True) -> list[tuple]:
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    members: dict = {}
    ends: dict = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        s = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums: dict = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        sums[node] = (sum(sums[b][0] for b in below) or 1, (len(members[node]) - 1) * words + sum(sums[b][1] for b in below))
    digest = {n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest() for n in members}
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), *sums[n], digest[n]) for n, m in members.items()), key=repr
    )


def rows_in(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("band", [2, 16])
def test_given_conversations(spark, rows_of, band):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations")]
    assert rows_in(conversation_trie(spark.createDataFrame(rows, SCHEMA), rebuild=True, band=band)) == brute(rows)


@pytest.mark.parametrize("rebuild", [False, True])
def test_long_and_equal_conversations(spark, rebuild):
    rng = random.Random(2)
    rows = [(c, t, "u" if t % 2 else "a", rng.choice(["x", "x", "x", "yes no"])) for c in range(60) for t in range(rng.choice([1, 2, 9, 70]))]
    rows += [(c, t, "u", f"word {t}") for c in range(60, 300) for t in range(3)]  # one large group of equal conversations
    rows += [(400, t, "u", "word 0" if t == 0 else "long") for t in range(1300)]  # more turns than one step
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_in(conversation_trie(frame, rebuild=rebuild, band=4)) == brute(rows, rebuild)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "nobody"), (5, None, "u", "first"), (5, 1, None, None), (5, 1, None, None), (7, -3, "u", "é " * 30_000), (8, 0, "u", "")]
    rows += [(20, 0, "u", "a"), (21, 0, "u", "a"), (22, 0, "u", "a b"), (43, 5, "u", "no base")]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", place string, node_a double")
    assert rows_in(conversation_trie(frame)) == brute(rows, rebuild=False)
    assert rows_in(conversation_trie(frame, rebuild=True)) == brute(rows)
    assert conversation_trie(frame.limit(0), rebuild=True).collect() == []
