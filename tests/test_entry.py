import importlib

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["search_budgeted", "fetch_context", "net_diff", "restore_at", "resolve_refs", "related_both", "file_summaries", "global_stats", "upsert_nodes", "forget_reparent", "wikilink_extract", "p4_found", "p5_found"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in entry.CORE:
        importlib.import_module(name)


@pytest.mark.parametrize("name", QUICK)
def test_queries_against_sql(spark, name):
    assert ": ok" in compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, connect(SF))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
