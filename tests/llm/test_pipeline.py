"""The pipeline stage by stage: each decision takes effect, clean documents stay, and the result is whole."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from test_near_dup import brute

import corpus_pipeline
from fluxlens.llm.bpe import tokenizer
from fluxlens.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"
PLANTED = re.compile(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, found[-1], SF).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "secret_scans", "best_fit_packing"]
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:-1])


def test_each_stage_on_its_own_input(steps, rows_of):
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps[:-1]]
    labels = {r["doc_id"]: r["toxic"] for r in rows_of("labels", SF)}
    gone = [a.keys() - b.keys() for a, b in zip(rows, rows[1:], strict=False)]
    assert {d for d in labels if labels[d]} <= gone[0] and not any(labels.get(d) == 0 for d in gone[0])
    names = brute([(d, r["text"]) for d, r in rows[1].items()], percent=80)
    assert gone[1] == {d for d, (_, c) in names.items() if c != d}
    items = [i["text"].lower() for i in rows_of("benchmark", SF)]
    assert gone[2] == {d for d, r in rows[2].items() if any(i in r["text"].lower() for i in items)}
    assert not gone[3]
    for d, r in rows[4].items():
        before = rows[3][d]["text"]
        assert r["text"] == PLANTED.sub("[secret]", before) and r["n_chars"] == (len(r["text"]) if r["text"] != before else rows[3][d]["n_chars"])


def test_packing_holds_every_token(steps):
    pieces = {(r.doc_id, r.piece): r for r in steps[-1].collect()}
    for r in steps[-2].collect():
        ids = [*tokenizer(vocabulary()).encode(r.text, add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            own = pieces.pop((r.doc_id, k))
            part = ids[start : start + 2048]
            assert (own.start, own.length, own.ids_crc32) == (start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    assert not pieces


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    cut = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.columns == steps[-1].columns
    assert sorted(got.select(cut).collect()) == sorted(steps[-1].select(cut).collect())
