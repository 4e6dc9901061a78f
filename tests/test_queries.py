"""Every registered query that has SQL gives the rows that DuckDB gives."""

import numpy as np
import pandas as pd
import pytest

from quire.plans import all_queries, all_sql
from tests.conftest import SCALES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(int(x)) if isinstance(x, (int, np.integer)) else str(x)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_sql()))
@pytest.mark.parametrize("at", SCALES)
def test_query_matches_sql(name, at, spark, ducks):
    duck, sql = ducks[at], all_sql()[name]
    found = all_queries()[name](spark, at)
    kinds = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in found.dtypes} == kinds
    assert rows(found.toPandas()) == rows(duck.execute(sql).df())
