"""Token counts and packing against the tokenizer library, text by text."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fluxlens.llm.bpe import tokenizer
from fluxlens.llm.packing import pack, packing_plan
from fluxlens.llm.queries import vocabulary
from fluxlens.llm.token_counts import count_tokens, counter


@pytest.fixture(scope="module")
def encode():
    return lambda text: tokenizer(vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_random_texts(encode):
    rng = random.Random(1)
    signs = ["a", "B", "'s", "'T", ".", ",", " ", "\n", "\t", "<|endoftext|>", "<|", "é", "É", "́", "Σ", "ς", "1", "½", "中", "🙂", "\x1c", "\xa0", "_", "-", "İ", "ß", "ǅ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)] + ["ab" * 2000, "'" * 99]
    memory = counter(vocabulary())
    assert [sum(memory.values(t)) for t in texts] == [len(encode(t)) for t in texts]


def test_counts_of_documents(spark, rows_of, encode, odd_documents):
    for frame in (spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows_of("documents")], "doc_id long, text string"), odd_documents):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(encode(r.text)), len(encode(r.text)) > 2048) for r in frame.select("doc_id", "text").collect())
        assert Counter(map(tuple, count_tokens(frame, vocabulary()).collect())) == want
    assert count_tokens(odd_documents.limit(0), vocabulary()).isEmpty()


@pytest.mark.parametrize("size", [0, 1, 7, 400, 20_000])
def test_plan_uses_every_length_once(size):
    rng = random.Random(size)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1.1)))) for _ in range(size)) + Counter({1: size // 20})
    plan = packing_plan(dict(counts))
    used: Counter = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        for length in lengths:
            used[length] += times
    assert used == counts
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(times for _, times in plan) <= least + max(2, least // 50) + 2


def test_exact_complements_are_found():
    plan = packing_plan({1000: 3, 1048: 3, 700: 2, 48: 4, 1300: 2, 2048: 5})
    assert sorted(plan) == sorted([((2048,), 5), ((1048, 1000), 3), ((1300, 700, 48), 2), ((48, 48), 1)])


def check_packing(rows: list, texts: Counter, encode) -> None:
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want: Counter = Counter()
    for (doc, text), n in texts.items():
        ids = [*encode(text), 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            piece = ids[start : start + 2048]
            want[doc, k, start, len(piece), zlib.crc32(np.asarray(piece, "<u4").tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_packing(spark, rows_of, encode, odd_documents):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    for frame in (spark.createDataFrame(docs, "doc_id long, text string"), odd_documents):
        check_packing(pack(frame, vocabulary()).collect(), Counter((r.doc_id, r.text) for r in frame.collect()), encode)
    assert pack(odd_documents.limit(0), vocabulary()).isEmpty()


def test_hot_length_is_ranked_in_shares(spark, encode, monkeypatch):
    monkeypatch.setattr("fluxlens.llm.packing.RANK_ROWS", 50)
    docs = [(i, "the same text") for i in range(500)] + [(1000 + i, "more " * i) for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_packing(pack(frame, vocabulary()).collect(), Counter(docs), encode)
