"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import datetime
import decimal

import pytest

from quillspark.plans import registry
from tests.conftest import SF


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float("%.8g" % float(v))
    if isinstance(v, datetime.datetime):
        return str(v)
    return tuple(map(plain, v))


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    answer = duck.execute(registry.sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in answer.description], answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
