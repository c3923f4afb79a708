from pyspark.sql import functions as F

from graphloom.operators.algorithms import Algorithms
from graphloom.sources.star_schema import load

SF = "/root/testdata/sf0.001"


def test_rounds_move_numbers_in_the_order_of_nodes(spark):
    nodes, links = Algorithms(load(spark, SF))._numbered(["neighbour"], None, "out")
    assert dict(links.dtypes) == {"s": "bigint", "t": "bigint", "w": "double"}
    rows = [r["n"] for r in nodes.orderBy("v").collect()]
    assert rows == sorted(rows, key=lambda n: (n["id"], n["kind"])) and nodes.select("v").distinct().count() == len(rows)
    assert links.count() == load(spark, SF).edges(["neighbour"]).count() and links.join(nodes, F.col("s") == F.col("v"), "left_anti").count() == 0
