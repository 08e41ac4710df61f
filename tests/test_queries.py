"""Every query of the library against its SQL in DuckDB, on the small tables."""

import math
import os
import shutil
import subprocess
import sys

import pytest

from leafmill.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 6) + 0.0) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert rows == sorted((tuple(plain(w[order.index(c)]) for c in columns) for w in cursor.fetchall()), key=str)


def test_allowed_text_of_lines_with_signs_of_their_own(spark, tmp_path):
    import duckdb

    # Lines 5, 10 and so on aren't in the pool; 15 and 20 are spelled with a sign between two languages, and their parts are in the pool.
    rows = [(i, "\n".join(["Osll", "el."] * 7 + [f"Osll {sign} el.", "Osll", "el.", "Osll", "el.", f"el. {sign} Osll"])) for i, sign in enumerate("|:/：／｜-")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, n, digest FROM ({queries.oracle_sql()['allowed_text']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in queries.queries()["allowed_text"](spark, str(tmp_path)).select("page_id", "n", "digest").orderBy("page_id").collect()] == want


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("gone", [("leafmill/llm", "tests/llm"), ("leafmill/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_training_data_operators(tmp_path, gone):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(top, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'norm_lines' in names and set(e.oracle_sql()) == names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""}, stdout=subprocess.DEVNULL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
