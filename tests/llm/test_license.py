"""Licence scans against the same question in SQL, a small tree of files, odd rows."""

from __future__ import annotations

import re
import textwrap

import duckdb

from fluxlens.llm.license_scan import TEMPLATES, scan
from fluxlens.llm.queries import ORACLE, QUERIES

MIT, GPL, APACHE = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "// Licensed under the Apache License, Version 2.0 (the License)"


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = connection.execute(ORACLE["op7_license_scans"])
    names = [d[0] for d in want.description]
    rows = QUERIES["op7_license_scans"](spark, sf).select(*names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall())) and len(rows) == 1000


def test_nearest_directory_wins(spark):
    files = [
        (1, "LICENSE", f"x\n{MIT}\ny"), (2, "lib/COPYING.txt", GPL), (3, "lib/deep/er/a.c", "code\nno cue"), (4, "lib/b.c", f"code\n{APACHE}"),
        (5, "app/c.py", "nothing"), (6, "top.py", None), (7, "libs/d.c", ""), (8, "lib/deep/notice", "license of nobody knows what and why"),
        (9, None, MIT), (None, "lib/e.c", "text"), (5, "app/c.py", "nothing"), (10, "/abs/LICENSE", GPL), (11, "/abs/x/y.c", ""), (12, "lib/license.py", "x"),
    ]
    frame = spark.createDataFrame([(*f, "GPL-3.0") for f in files], "doc_id long, path string, text string, license string")
    got = sorted(((r.doc_id or 0, r.path, r.own_license, r.inherited_license, r.inherited_from, r.license) for r in scan(frame).collect()), key=repr)
    want = [
        (1, "LICENSE", "MIT", "MIT", "", "MIT"), (2, "lib/COPYING.txt", "GPL-3.0", "GPL-3.0", "lib", "GPL-3.0"), (3, "lib/deep/er/a.c", None, "GPL-3.0", "lib", "GPL-3.0"),
        (4, "lib/b.c", "Apache-2.0", "GPL-3.0", "lib", "Apache-2.0"), (5, "app/c.py", None, "MIT", "", "MIT"), (5, "app/c.py", None, "MIT", "", "MIT"), (6, "top.py", None, "MIT", "", "MIT"),
        (7, "libs/d.c", None, "MIT", "", "MIT"), (8, "lib/deep/notice", None, "GPL-3.0", "lib", "GPL-3.0"), (9, None, None, None, None, None), (0, "lib/e.c", None, "GPL-3.0", "lib", "GPL-3.0"),
        (10, "/abs/LICENSE", "GPL-3.0", "GPL-3.0", "/abs", "GPL-3.0"), (11, "/abs/x/y.c", None, "GPL-3.0", "/abs", "GPL-3.0"), (12, "lib/license.py", None, "GPL-3.0", "lib", "GPL-3.0"),
    ]
    assert got == sorted(want, key=repr)


def test_odd_rows(spark, odd_documents):
    frame = odd_documents.withColumnRenamed("source", "path")
    rows = scan(frame).collect()
    assert len(rows) == odd_documents.count() and {r.license for r in rows} == {None}
    assert scan(frame.limit(0)).isEmpty()


def test_copying_the_table_changes_no_score(spark):
    texts = ["Licensed under the Apache License, Version 2.0, January.", "Software released under the MIT License.", f"{MIT} As is.", "Some parts are under another licence, see January's copyright notice."]
    texts += [f"Copyright of Software part {i % 5}, all rights reserved" for i in range(40)]

    def verdicts(copies):
        rows = [(i, f"c{c}/{i}.txt", t) for c in range(copies) for i, t in enumerate(texts)]
        return {(r.doc_id, r.own_license, r.own_score) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}

    once = verdicts(1)
    assert [n for _, n, _ in sorted(once, key=lambda r: r[0])][:4] == ["Apache-2.0", "MIT", "MIT", None] and len(once) == len(texts)
    assert verdicts(10) == once and verdicts(100) == once


def long_text(name: str) -> str:
    """The longest template of a licence, in lines of about 70 signs as in files."""
    return "\n".join(textwrap.wrap(max((t for n, t in TEMPLATES if n == name), key=len), 70))


HEADERS = {
    "// SPDX-License-Identifier: MIT\nint main() { return 0; }": "MIT",
    "# SPDX-License-Identifier: Apache-2.0\nimport os": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0",
    "# Copyright 2023 The Sample Authors.\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software": "Apache-2.0",
    "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU General Public License for more details. */": "GPL-3.0",
    "MIT License\n\nCopyright (c) 2021 Ada Example\n\n" + "{MIT}": "MIT",
    "Copyright (c) 2019, Example Corp.\nAll rights reserved.\n\n" + "{BSD-3-Clause}": "BSD-3-Clause",
    "BSD 2-Clause License\n\nCopyright (c) 2020, Someone\n\n" + "{BSD-2-Clause}": "BSD-2-Clause",
    "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\ncode()": "MPL-2.0",
    "ISC License\nCopyright 2022 N. N.\n" + "{ISC}": "ISC",
}
NO_LICENSE = [
    "Copyright 2020 Example Corp. All rights reserved.", "// (c) Copyright of the museum, do not copy", "The driver's licence was issued in spring.", "copyright law in the nineteenth century",
    "Please read the license agreement before you open the package.", "A software license is a legal instrument that governs the use of software.", "The song passed into the public domain in 1984.",
]


def test_usual_headers_and_whole_texts_next_to_given_documents(spark, rows_of):
    given = [(r["doc_id"], f"given/{r['doc_id']}.txt", r["text"]) for r in rows_of("documents", "/root/testdata/sf0.01")]
    own = [(10_000 + i, f"own/{i}.c", re.sub(r"\{(.*)\}", lambda m: long_text(m[1]) if any(n == m[1] for n, _ in TEMPLATES) else m[0], t)) for i, t in enumerate(HEADERS)]
    none = [(20_000 + i, f"none/{i}.txt", t) for i, t in enumerate(NO_LICENSE)]
    got = {r.doc_id: r.own_license for r in scan(spark.createDataFrame(given + own + none, "doc_id long, path string, text string")).where("doc_id >= 10000").collect()}
    assert [got[10_000 + i] for i in range(len(HEADERS))] == list(HEADERS.values())
    assert [got[20_000 + i] for i in range(len(NO_LICENSE))] == [None] * len(NO_LICENSE)
