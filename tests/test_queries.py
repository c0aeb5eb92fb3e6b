"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from rasterloom.plans import QUERIES, SQL  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf001}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def rows(columns, data, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf001, name):
    df = QUERIES[name](spark, sf001)
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    assert rows(df.columns, df.collect(), order) == rows(names, cur.fetchall(), order)


@pytest.fixture(scope="module")
def ragged(sf001, tmp_path_factory):
    """The embeddings' 5 x 5 tiles with a last one of two rows and two cells: a count that 25 does not divide."""
    d = str(tmp_path_factory.mktemp("ragged"))
    c = duckdb.connect()
    c.execute(f"copy (select * from '{sf001}/embeddings.parquet' where vec_id < 62) to '{d}/embeddings.parquet'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{d if t == 'embeddings' else sf001}/{t}.parquet'")
    assert c.execute("select count(*), max(vec_id) from embeddings").fetchall() == [(62, 61)]
    return d, c


@pytest.mark.parametrize("name", ["a32_flip_average", "s7_array_ingest", "x2_window_model"])
def test_query_equals_sql_on_a_tile_that_lacks_cells(spark, ragged, name):
    d, c = ragged
    df = QUERIES[name](spark, d)
    cur = c.execute(SQL[name])
    names = [x[0] for x in cur.description]
    order = sorted(df.columns)
    assert rows(df.columns, df.collect(), order) == rows(names, cur.fetchall(), order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf001, name):
    assert QUERIES[name](spark, sf001).count() > 0


def test_no_other_module_needs_the_training_data_package():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rasterloom")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read(), n
