"""Every registered query of the library itself against its SQL on the smallest tables."""

import pytest
from oracle import same

from latticework import jobs

SF = "/root/testdata/sf0.001"
QUERIES, SQL = jobs.queries(), jobs.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and max(r["rank"] for r in rows) == 3


def test_every_query_is_named_by_its_operator():
    assert all(name[0].isalpha() and any(c.isdigit() for c in name.split("_")[0]) for name in QUERIES)


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
