"""Every query against its DuckDB text on the smallest tables; queries without one are in test_value_models."""

import pytest

from lumengrid.plans import area_queries, pixel_queries, scene_queries, tree_queries

ALL = {**pixel_queries.QUERIES, **scene_queries.QUERIES, **area_queries.QUERIES, **tree_queries.QUERIES}
SQL = {**pixel_queries.SQL, **scene_queries.SQL, **area_queries.SQL, **tree_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(ALL[name], SQL[name])


def test_entry_module():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
