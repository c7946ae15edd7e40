"""The relational tables as one graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import Graph, Table

NAMESPACE = "http://example.org/"
#: table -> (key columns, no two rows have the same; column -> table that it names)
SHAPES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "region": (("r_regionkey",), {}),
    "nation": (("n_nationkey",), {"n_regionkey": "region"}),
    "customer": (("c_custkey",), {"c_nationkey": "nation"}),
    "supplier": (("s_suppkey",), {"s_nationkey": "nation"}),
    "part": (("p_partkey",), {}),
    "orders": (("o_orderkey",), {"o_custkey": "customer"}),
    "lineitem": ((), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": (("event_id",), {}),
    "documents": (("doc_id",), {}),
    "pages": (("page_id",), {}),
    "benchmark": (("item_id",), {}),
    "conversations": (("conv_id", "turn"), {}),
    "embeddings": (("vec_id",), {}),
}


def tables_graph(spark: SparkSession, folder: str, *names: str) -> Graph:
    """The named tables of a folder of Parquet tables; nothing is read until a rule asks for it."""
    graph = Graph(spark)
    for name in names or SHAPES:
        key, links = SHAPES[name]
        graph.add_table(Table(spark.read.parquet(f"{folder}/{name}.parquet"), name, key, links, NAMESPACE, unique=bool(key)))
    return graph
