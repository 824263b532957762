"""The training-data queries on small tables: SQL where there is some, and the contracts' totals."""

from collections import Counter
from pathlib import Path

import pytest

from surestat.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    ours = QUERIES[name](spark, DATA)
    theirs = con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert Counter(map(tuple, ours.select(columns).collect())) == Counter(theirs.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("op3_best_fit_packing", "op5_threshold_topk")))
def test_a_row_for_each_document(spark, name):
    ids = Counter(r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect())
    assert ids == Counter(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
