"""Every query of the library against its SQL on small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cinegraph import queries as library

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = library.queries(), library.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return repr(list(v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.6g}" if isinstance(v, (float, np.floating)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, D).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_is_stable(spark, name):
    df = QUERIES[name](spark, D)
    assert rows(df.toPandas()) == rows(QUERIES[name](spark, D).toPandas())


def test_dhash_counts_in_single_precision(spark, tmp_path):
    # (0.55999994 + 1) * 100 is 156 in single precision, and just below it in double
    e = pd.DataFrame({"vec_id": [0, 1], "embedding": [np.array([0.55999994, 0.555] * 32, "float32"), np.zeros(64, "float32")]})
    e.to_parquet(tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as from '{tmp_path}/embeddings.parquet'")
    assert rows(QUERIES["dhash"](spark, str(tmp_path)).toPandas()) == rows(c.execute(SQL["dhash"]).fetchdf())


def test_relation_premerge_has_no_ends_without_a_name(spark, tmp_path):
    names = [None, "red gear", "red  gear", "reds gear", "KELVIN one", "blue gear x"]
    pd.DataFrame({"p_partkey": range(30), "p_name": [names[i % 6] for i in range(30)], "p_brand": [f"Brand#{i % 7}" for i in range(30)], "p_type": "T"}).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame({"l_orderkey": [i % 13 for i in range(300)], "l_partkey": [i * i % 30 for i in range(300)], "l_linenumber": np.array([i % 7 for i in range(300)], "int32")}).to_parquet(tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    assert rows(QUERIES["relation_premerge"](spark, str(tmp_path)).toPandas()) == rows(c.execute(SQL["relation_premerge"]).fetchdf())
