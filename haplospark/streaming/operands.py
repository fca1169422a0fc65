"""Traversals over operands that arrive as a stream: every row is a whole vector, so rows are independent and need no state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.checkpoints import release, stored
from haplospark.operators.graph import GraphDataset
from haplospark.operators.traverse import Spec, operand_size, traverse
from haplospark.plans.strategy import Strategy, choose, vectors_at_once
from haplospark.schema import Direction


def traverse_stream(graph: GraphDataset, vectors: DataFrame, direction: Direction | str, by_individual: bool = False) -> DataFrame:
    """``vectors(key, values array<double>)``, a stream or a table, to (key, values): the traversed vector of each row.

    Only for graphs that fit a worker; ``write_stream`` takes others.
    """
    spec = Spec(Direction.parse(direction), by_individual).checked(graph)
    if choose(graph.meta, selector_entries=graph.selector_entries) is not Strategy.KERNEL:
        raise ValueError("the graph does not fit a worker; write_stream takes any graph")
    most = vectors_at_once(graph.meta, selector_entries=graph.selector_entries)
    sent, size = vectors.sparkSession.sparkContext.broadcast(graph.structure), operand_size(graph, spec)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (whole.iloc[j : j + most] for whole in frames for j in range(0, len(whole), most)):
            x = np.stack([np.asarray(v, float) for v in f["values"]])
            if x.shape[1] != size:
                raise ValueError(f"a vector has {x.shape[1]} values, not {size}")
            out = sent.value.up(x, by_individual=by_individual)[0] if spec.direction is Direction.UP else sent.value.down(x, by_individual=by_individual)
            yield pd.DataFrame({"key": f["key"], "values": list(out)})

    return vectors.select(F.col("key").cast("bigint").alias("key"), "values").mapInPandas(run, "key bigint, values array<double>")


def write_stream(graph: GraphDataset, vectors: DataFrame, direction: Direction | str, path: str, by_individual: bool = False, strategy: Strategy | None = None):
    """A query (started) that writes (batch, row, key, id, value) of each micro-batch of a stream of ``vectors(key, values)`` below ``path``: for graphs of any size.

    ``row`` tells apart vectors of one batch with equal keys.  A batch that is repeated after a failure replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = stored(batch.select(F.col("key").cast("bigint").alias("key"), "values", F.monotonically_increasing_id().alias("place")), "batch")
        # A row's number is its place among the vectors of the batch: one small column.
        named = stored(rows.select("key", "place").withColumn("row", (F.row_number().over(Window.orderBy("place")) - 1).cast("int")), "rows")
        operand = rows.join(named.select("place", "row"), "place").select("row", F.posexplode("values").alias("id", "value"))
        got = traverse(graph, operand, direction, by_individual=by_individual, strategy=strategy, sparse=True).values
        got.join(named.select("row", "key"), "row").select("row", "key", "id", "value").write.mode("overwrite").parquet(f"{path}/batch={number}")
        release(rows, named)

    return vectors.writeStream.foreachBatch(one).option("checkpointLocation", f"{path.rstrip('/')}-progress").trigger(availableNow=True).start()
