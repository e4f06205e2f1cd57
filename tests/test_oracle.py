"""Every query of the graph operators against its SQL, on the smallest tables. The chosen queries run side by side: each is small, and most of its time is planning."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pandas as pd
import pytest

from graphspark.plans import bindings, queries

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return "NULL"
        if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in bindings.BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(request, spark):
    """Rows to come of all queries that this run asks for, by name."""
    chosen = [i.callspec.params["name"] for i in request.session.items if i.module.__name__ == __name__ and hasattr(i, "callspec")]
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda n=n: queries.queries()[n](spark, SF).toPandas()) for n in chosen}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(results, duck, name):
    got, want = results[name].result(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(results, name):
    assert len(results[name].result()) > 0
