import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from umbra.plans import queries as plans

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, SMALL).toPandas()) == rows(duck.execute(plans.oracle_sql()[name]).df())


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "text"]
    assert df.count() == 200


def test_rest_stands_without_the_subpackage(tmp_path):
    """The entry imports, and has the other queries, where the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "umbra"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "umbra" / "llm")], check=False)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q)); assert not any(n.startswith('op1') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
