"""Every registered query with SQL against DuckDB, on tables cut small."""

import glob
import os

import duckdb
import pytest

from dendrium.operators import treequery
from dendrium.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(df.select(*[f"`{n}`" for n in names]).collect()) == key(cursor.fetchall())


@pytest.mark.parametrize("bad", ["", "NP <", "(NP < VP", "NP < [VP", "< NP", "NP VP"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        treequery.parse(bad)
