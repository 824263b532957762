"""Every query with SQL against DuckDB on the same small tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from surestat.plans import queries as plans

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return repr(list(v)) if isinstance(v, (list, tuple)) else repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours = plans.QUERIES[name](spark, DATA)
    theirs = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert table(ours.columns, [tuple(r) for r in ours.collect()]) == table(columns, theirs.fetchall())


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_both_walks_go_all_steps():
    assert plans.ORACLES["rwr_by_joins"] == plans.ORACLES["rwr_fixed_k"]


def test_entry_points(spark):
    found = __spark_entry__.queries()
    assert set(plans.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    if Path(DATA).is_dir():
        assert __spark_entry__.entry(spark).columns == ["index", "disease", "uq"]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_points_without_the_training_data_operators(tmp_path, with_pipeline):
    """A copy of the repository without those folders, in a process of its own."""
    here = Path(__spark_entry__.__file__).parent
    shutil.copytree(here / "surestat", tmp_path / "surestat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "surestat/llm").mkdir()  # what a deletion of files alone leaves
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    if with_pipeline and (here / "corpus_pipeline.py").exists():
        shutil.copy(here / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and len(q) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
