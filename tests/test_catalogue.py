"""Every query equals its SQL."""

import duckdb
import pandas as pd
import pytest

from attestor.plans import evaluation, measures, universe_queries  # noqa: F401  (add their queries)
from attestor.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(None if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    got, want = plain(QUERIES[name](spark, sf).toPandas()), plain(con.execute(ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    norm = lambda rows: sorted((tuple(None if v is None else v.removesuffix(".000000").removesuffix(".0") for v in r) for r in rows), key=str)
    assert norm(got[1]) == norm(want[1])
