"""Every query against the SQL that states its result, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from narrata.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Queries that no SQL states, with the tests that cover them.
OTHERWISE = {"clean_text_full": "test_whole_texts.py::test_clean_text_full"}


def rows(frame):
    cell = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr([cell(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert len(found) and (name in SQL or name in OTHERWISE)
    if name in SQL:
        con = duckdb.connect()
        for f in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        wanted = con.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
