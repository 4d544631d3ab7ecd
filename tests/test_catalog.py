"""Every catalogue query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lattica.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v) + 0.0, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    own = catalog.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(own.columns) == sorted(want.columns)
    assert rows(own) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_learned_stages_give_finite_vectors(spark, name):
    found = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(found) and found["content_id"].is_unique
    assert all(all(map(math.isfinite, v)) for v in found["vector"])
