"""Every query of the library runs beside its SQL over the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corpusloom import queries_dense, queries_rows, queries_text

FOLDER = "/root/testdata/sf0.001"
MODULES = (queries_rows, queries_text, queries_dense)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
SLOW = ("estimator_", "transductive_", "ssl_", "lsi_transfer", "sfa_transfer", "no_transfer", "benchmark_", "mda_beside")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) + 0.0 if isinstance(x, float) else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in values)


def database():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    result = database().execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL and not k.startswith(SLOW)))
def test_runs_and_repeats(spark, name):
    one, two = (rows(df.columns, df.collect()) for df in (QUERIES[name](spark, FOLDER) for _ in range(2)))
    assert one and one == two
