from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows_of():
    """All rows of a given table as dictionaries."""

    def read(name: str, sf_dir: str = SF) -> list[dict]:
        found = duckdb.connect().execute(f"select * from '{sf_dir}/{name}.parquet'")
        names = [d[0] for d in found.description]
        return [dict(zip(names, r, strict=True)) for r in found.fetchall()]

    return read


#: Texts that every operator must take: null, empty, blank, one word, very long, odd signs.
ODD_TEXTS = [None, "", " \n\t ", "word", "long " * 60_000, "x" * 300_000, "é中\U0001f600 \x00 <p> {}", "a b c d e\n" * 400]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts twice each, nulls in every column, and extra columns whose names operators might use themselves."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), "x", 1.5) for i, t in enumerate(ODD_TEXTS + ODD_TEXTS)]
    rows += [rows[3], (None, None, None, None, None, None, None), (None, "word", "en", "s", 4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double")
