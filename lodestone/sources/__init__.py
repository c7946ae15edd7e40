"""Reading and writing graphs."""

from .files import READERS, read_graph, write_graph
from .tables import tables_graph

__all__ = ["READERS", "read_graph", "tables_graph", "write_graph"]
