"""Every registered query against its SQL twin on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from tesserae.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names: list[str], values: list) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda x: repr(round(float(x), 6) + 0.0) if isinstance(x, float | Decimal) else str(x)
    return sorted(tuple(text(r[k]) for k in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if (sql := registry.oracle_sql().get(name)) is None:
        assert len(got) > 0
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, found.fetchall())
