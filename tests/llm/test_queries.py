import os

import duckdb
import pytest

from pagegrain.llm import registry
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(str(r[order.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_operator_is_registered():
    assert [f"op{n}_" for n in range(1, 14)] == sorted({k.split("_")[0] + "_" for k in registry.queries()}, key=lambda s: int(s[2:-1]))
