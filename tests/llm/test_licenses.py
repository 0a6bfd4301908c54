import textwrap
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from asmlens.llm import licenses as L


def full(name, least=400):
    return next(t for n, t in L.CATALOGUE if n == name and len(t) > least)


def wrapped(text, width=72, mark=""):
    return "\n".join(mark + line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


ROWS = [
    (1, "Copyright (c) 2001 Somebody\n\n" + wrapped(full("ISC").upper())),
    (2, "prose\nlicenced under the apache LICENCE,  version 2.0\nmore prose\n(c) 2020 X\nReleased under the MIT License!"),
    (3, None), (4, ""), (5, "plain text"), (None, "Licensed under CC BY-NC 4.0."), (2, "prose"),
    (6, "Released under the MIT License.\n" * 3),
    (7, "MIT License\n\nCopyright (c) 2024 The Authors\n\n" + wrapped(full("MIT"))),
    (8, "The MIT License (MIT)\r\nCopyright \u00a9 2013-2020 A. Name <a@b.c>\r\n\r\n" + wrapped(full("MIT"), 60).replace("\n", "\r\n")),
    (9, wrapped("Copyright 2019 Foo Inc. All rights reserved.\n\n" + full("BSD-3-Clause"), 66, " * ")),
    (10, wrapped("BSD 2-Clause License\n\nCopyright (c) 2019, Foo\nAll rights reserved.\n\n" + full("BSD-2-Clause").replace("1.", "*").replace("2.", "*"), 70, "# ")),
    (11, wrapped(full("Unlicense"))), (12, "zlib License\n\n(C) 1995-2024 X and Y\n\n" + wrapped(full("Zlib"))), (13, wrapped(full("BSL-1.0"))), (14, wrapped(full("0BSD"))),
    (15, "Copyright 2020 X\n\n" + wrapped(full("Apache-2.0"), 80, "// ")),
    (16, "copyright holders and contributors \u201cas is\u201d\n" + full("MIT")), (17, full("MIT") + " But only on Mondays."), (18, "MIT License"),
    (19, "word " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 300_000),
]
WANT = {1: "ISC", 7: "MIT", 8: "MIT", 9: "BSD-3-Clause", 10: "BSD-2-Clause", 11: "Unlicense", 12: "Zlib", 13: "BSL-1.0", 14: "0BSD", 15: "Apache-2.0"}


def test_whole_texts_and_lines(documents):
    docs = documents(ROWS).withColumns({"digest": F.lit("clash"), "text_license": F.lit(1), "found": F.lit(2), "lines": F.lit(3)})
    rows = L.scan(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows if r.doc_id != 2}
    for k in range(1, 20):
        if k != 2:
            assert got[k].text_license == WANT.get(k), k
    assert (got[None].text_license, got[None].line_licenses, got[None].n_license_lines) == ("CC-BY-NC-4.0",) * 2 + (1,)
    assert (got[6].line_licenses, got[6].n_license_lines) == ("MIT", 3) and (got[19].line_licenses, got[19].n_license_lines) == ("MIT", 1)
    assert sorted((r.line_licenses, r.n_license_lines) for r in rows if r.doc_id == 2) == [("", 0), ("Apache-2.0,MIT", 2)]
    assert L.scan(documents(ROWS).where("doc_id > 1000")).count() == 0


def test_twin_on_the_same_rows(documents):
    want = sorted((str(r.doc_id), str(r.text_license), r.line_licenses, r.n_license_lines) for r in L.scan(documents(ROWS)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert sorted((str(a), str(b), c, d) for a, b, c, d in con.execute(L.ORACLE).fetchall()) == want


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_texts_as_published(documents, file, name):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("the system has no such text")
    text = path.read_text(encoding="utf8")
    rows = L.scan(documents([(1, text), (2, text + "\nAnd more."), (3, text.replace("\n", "\r\n").upper())])).collect()
    assert {r.doc_id: r.text_license for r in rows} == {1: name, 2: None, 3: name}
