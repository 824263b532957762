import hashlib
import textwrap
from pathlib import Path

import pytest

from surestat.llm import license_table, licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_entire_license_texts_match(spark):
    wrapped = "\n\n".join(textwrap.fill(p, 78) for p in MIT.split("\n\n"))
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 Someone\n\n{MIT}", "MIT"), (2, wrapped, "MIT"), (3, wrapped.replace("modify, merge", "merge"), None), (4, f"{MIT}\nAnd a further term.", None)]
    for i, (file, name) in enumerate((("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))):
        path = Path("/usr/share/common-licenses", file)
        if path.exists():
            rows.append((10 + i, path.read_text(), name))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark), 3000).collect()}
    assert got == {i: name for i, _, name in rows}


@pytest.mark.parametrize("text", [MIT, "Copyright (c) x\nA Licence, whilst NON-commercial\n\n\x0c end — ok", "© y\n..."])
def test_the_table_is_made_in_the_query_s_form(spark, text):
    row = licenses.digested(spark.createDataFrame([(text,)], "text string")).first()
    body = license_table.canonical(text)
    assert row.digest == (hashlib.sha256(body.encode()).hexdigest() if body else None)


def test_neighbouring_spellings_are_all_replaced(spark):
    text = "licence licence favour favour sub licence sub license non commercial non-commercial whilst"
    row = spark.createDataFrame([(text,)], "text string").select(licenses.canonical_lines("text").alias("x")).first()
    want = "license license favor favor sublicense sublicense noncommercial noncommercial while"
    assert row.x == [want] and license_table.canonical(text) == want


def test_notices_of_several_lines_match_however_they_are_wrapped(spark):
    header = licenses.KNOWN["Apache-2.0"][-1]
    rows = [(i, f"some code\n\n{textwrap.fill(header, width)}\n\nmore code\nRELEASED under the MIT licence\nend") for i, width in enumerate((50, 72, 90))]
    rows.append((9, textwrap.fill(header, 60)))
    rows.append((10, f"before\n{textwrap.fill(header, 60)}"))
    got = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark), 3000).collect()}
    # wrapped at 50, the first line is a notice in itself
    assert got == {0: (None, 3, "Apache-2.0,MIT"), 1: (None, 2, "Apache-2.0,MIT"), 2: (None, 2, "Apache-2.0,MIT"), 9: ("Apache-2.0", 1, "Apache-2.0"), 10: (None, 0, "")}


def test_sql_gives_the_same_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    header = textwrap.fill(licenses.KNOWN["Apache-2.0"][-1], 70)
    texts = [MIT, textwrap.fill(MIT, 78), f"x\n \t\n{header}\n\n\n\ny", header, "Licence licence\nsub licence", "(c) me\n\nReleased under the MIT License.", "", None, "...", "é favour\tfavour é\r\n\r\n© z"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", docs)
    theirs = con.execute(licenses.oracle())
    columns = [d[0] for d in theirs.description]
    ours = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.known_licenses(spark), 3000).select(columns)
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs.fetchall(), key=str)
    assert sum(r.license is not None for r in ours.collect()) >= 3
