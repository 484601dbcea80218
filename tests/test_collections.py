"""Orders with their lines inside."""

from sparkdoc.sources import collections as c


def test_orders_and_lines_are_dealt_once(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, 5, "F", 2.5), (2, 5, "P", 7.0), (2, 6, "O", 8.0), (3, 99, "F", 1.0), (None, 6, "F", 4.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(5, "ann", "A"), (6, "bob", "B")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(2, 30, 2, 1.0), (2, 20, 1, 3.0), (3, 9, 1, 1.0), (4, 8, 1, 1.0), (None, 7, 1, 1.0)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    docs = c.order_documents(spark, at)
    got = {(r.key, r.value.status): (r.value.customer.name, r.value.total, r.value.parts, r.value.lines and [tuple(x) for x in r.value.lines]) for r in c.stored(c.order_documents, spark, at).collect()}
    assert got == {("orders/0000000001", "F"): ("ann", 2.5, None, None), ("orders/0000000002", "P"): ("ann", 7.0, [20, 30], [(1, 20, 3.0), (2, 30, 1.0)]),
                   ("orders/0000000002", "O"): ("bob", 8.0, [20, 30], [(1, 20, 3.0), (2, 30, 1.0)]), (None, "F"): ("bob", 4.0, None, None)}
    plan = docs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(id" not in plan
