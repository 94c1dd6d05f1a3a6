import duckdb
import pandas as pd
import pytest

from fusionframe.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "part", "orders", "documents", "supplier", "nation"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


