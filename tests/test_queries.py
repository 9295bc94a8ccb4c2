"""Every query against its SQL, and the same rows whatever the partitions."""

import pytest

import __spark_entry__ as entry
from checks import compare, registry, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    mine = compare.rows(df.columns, df.collect())
    result = con.sql(entry.oracle_sql()[name])
    assert mine == compare.rows(result.columns, result.fetchall())
    assert mine[1], "a query without rows checks nothing"


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "repo_id" and rows.count() > 0


@pytest.mark.parametrize("name", ["dry_run", "graph_degree", "graph_report", "progress_events", "tree_lines", "dir_rollup", "cache_upsert", "manifest_alias"])
def test_partitions_do_not_matter(spark, name, monkeypatch):
    def rows(partitions):
        plain = views.table
        with monkeypatch.context() as patch:
            patch.setattr(views, "table", lambda *a, **k: plain(*a).repartition(partitions))
            df = entry.queries()[name](spark, SF)
            return compare.rows(df.columns, df.collect())

    assert rows(1) == rows(7)
