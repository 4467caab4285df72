"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodestrand.plans.analyses import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return None
        return str(x)[:10] if hasattr(x, "year") else x if isinstance(x, (bool, str)) else float(x)

    return sorted(str([cell(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark).toPandas()
    assert len(out) == 15 and out["q"].between(0, 1).all() and (out["q"] >= out["p"] - 1e-12).all()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
