"""What the driver calls, and the queries against their SQL."""

import datetime
import decimal
import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from docquery.queries import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (decimal.Decimal, int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_against_sql(spark, sf, duck, name):
    query, sql = REGISTRY[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_works_without_the_training_data_operators(tmp_path):
    """A copy without those folders still imports, and has the other queries."""
    for name in ("__spark_entry__.py", "docquery"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else os.mkdir(tmp_path / name)
    for name in os.listdir(os.path.join(ROOT, "docquery")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "docquery", name), tmp_path / "docquery" / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q.keys() == e.oracle_sql().keys() and len(q) > 60"
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
