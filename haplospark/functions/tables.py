"""A traversal as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from haplospark.operators.graph import GraphDataset
from haplospark.operators.traverse import Spec, operand_size
from haplospark.plans.strategy import Strategy, choose
from haplospark.schema import Direction


def register_traversal(spark: SparkSession, graph: GraphDataset, name: str, direction: Direction | str, by_individual: bool = False) -> None:
    """Make ``SELECT * FROM name(TABLE(operand) PARTITION BY row)`` give (row, id, value): the traversal of ``operand(row, id, value)``.

    Each vector is a partition of its own, held by one task; absent ids are 0, results are dense.  For graphs that fit a worker; others
    take ``operators.traverse``.
    """
    spec = Spec(Direction.parse(direction), by_individual).checked(graph)
    if choose(graph.meta, selector_entries=graph.selector_entries) is not Strategy.KERNEL:
        raise ValueError("the graph does not fit a worker")
    sent, size, up = spark.sparkContext.broadcast(graph.structure), operand_size(graph, spec), spec.direction is Direction.UP

    class Traversal:
        def __init__(self) -> None:
            self.vector, self.row = np.zeros(size), None

        def eval(self, entry: Row) -> None:
            self.row = entry["row"]
            self.vector[entry["id"]] += entry["value"]

        def terminate(self) -> Iterator[tuple[int, int, float]]:
            if self.row is None:
                return
            x, graph = self.vector[None, :], sent.value
            out = graph.up(x, by_individual=by_individual)[0] if up else graph.down(x, by_individual=by_individual)
            for i, v in enumerate(out[0].tolist()):
                yield self.row, i, v

    spark.udtf.register(name, udtf(Traversal, returnType="row int, id bigint, value double"))
