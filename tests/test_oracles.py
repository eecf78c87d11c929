import pytest
from oracle import compare

from veilscope.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, SMALL)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["scenario"] for r in rows} == {"none", "drop", "mask"}
    assert all(r["leaks"] == 0 for r in rows if r["scenario"] == "mask")
