"""Every query of the subpackage with SQL gives what its SQL gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = llm.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    got = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
    assert mine == theirs
