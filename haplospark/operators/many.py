"""Several graphs at once; results carry graph_id, in the given order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.graph import GraphDataset
from haplospark.operators.traverse import traverse
from haplospark.schema import Direction


def traverse_many(graphs: Mapping[str, GraphDataset], operands: Mapping[str, DataFrame], direction: Direction | str, **how) -> DataFrame:
    """graph_id, row, id, value: each graph's traversal of its own operand, as one table (and one job)."""
    if set(graphs) != set(operands):
        raise ValueError("every graph needs an operand, and every operand a graph")
    out = None
    for name, g in graphs.items():
        part = traverse(g, operands[name], direction, **how).values.select(F.lit(name).alias("graph_id"), "row", "id", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there is no graph")
    return out
