"""Result types of every registered query equal its DuckDB oracle's types."""

import os

import pytest

import __spark_entry__ as E
from scripts.check_oracle import connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def test_types_match_oracle(spark):
    con = connect(SF)
    bad = {}
    for name, sql in E.oracle_sql().items():
        st = dict(E.queries()[name](spark, SF).dtypes)
        dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        diff = [(c, t, dt.get(c)) for c, t in st.items() if MAP.get(t, t) != dt.get(c)]
        if diff:
            bad[name] = diff
    assert not bad, bad
