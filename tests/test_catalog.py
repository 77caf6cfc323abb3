"""Every query of the library against its SQL on the smallest dataset."""

import os

import duckdb
import pytest

from strandline.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(rows):
    def one(v):
        return v if v is None or isinstance(v, (str, bool)) else int(v) if float(v) == int(v) else round(float(v), 6)

    return sorted(repr([one(v) for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == plain(duck.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]}) x").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
