"""Every query outside llm against its SQL twin on the smallest tables."""

import duckdb
import pytest

from farpairs.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect())
    if name not in registry.oracle_sql():
        assert got  # tests/test_structural.py holds these operators against brute force
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(registry.oracle_sql()[name])
    at = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert [found.columns[i] for i in at] == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
