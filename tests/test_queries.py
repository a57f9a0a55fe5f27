"""Every query of the library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from attestra.plans.catalogue import FLAGSHIP, ORACLES, QUERIES
from verify import rows_of


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, db, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)
