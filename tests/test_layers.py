"""The layer queries over all orders."""

from lumengrid.plans import scene_queries


def test_every_order_becomes_a_layer(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert orders > 400
    assert scene_queries.QUERIES["layer_table"](spark, sf_dir).count() == orders
    assert scene_queries.QUERIES["layer_resize"](spark, sf_dir).count() == orders


def test_layer_queries_read_all_orders_once():
    assert not any("o_orderkey <" in sql for sql in scene_queries.SQL.values())
    assert not any(n.endswith("_all") for n in scene_queries.QUERIES)
