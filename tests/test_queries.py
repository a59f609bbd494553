"""Every registered query of the telemetry part against its SQL."""

import pytest

from tests.oracle import SF, compare
from tidemark import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, catalog.queries()[name], SQL[name], "/root/testdata/sf0.01" if name in NEEDS_ROWS else SF)


#: At the least size no panel has windows enough for a split.
NEEDS_ROWS = {k for k, sql in SQL.items() if "t0 as" in sql}


def test_entry(spark):
    import __spark_entry__ as e

    got = {r.scheme: r for r in e.entry(spark).collect()}
    assert got["maximum"].recall == 1 and got["maximum"].false_positive_rate == 0
    assert got["maximum"].windows == 80 and got["maximum"].events == 11


def test_manifest_holds_every_file(spark):
    import hashlib
    from pathlib import Path

    want = {str(p.relative_to(SF)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(SF).rglob("*.parquet")}
    got = catalog.queries()["table_manifest"](spark, SF).collect()
    assert len(got) == len(want) and {r.file: (r.length, r.sha256) for r in got} == want
