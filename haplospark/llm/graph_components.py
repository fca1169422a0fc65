"""Connected components of a link table, by alternating stars.

No link, node or component comes to the driver: each round is a few joins and partial aggregations, its result
is written to the shared folder, and only two counters say whether it changed anything.  Alternating stars settle in a number
of rounds that grows with the square of the logarithm of the number of nodes, so there is no limit on rounds.  Up to ``ONE_TASK`` links are
settled by one task instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.checkpoints import stored

#: Links (of tens of bytes) that one task takes.
ONE_TASK = 100_000


def _at_once(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    both = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).combine_chunks()
    names = both.unique()
    names = names.take(pc.array_sort_indices(names))
    where = pc.index_in(both, names).to_numpy()
    u, v = where[: t.num_rows], where[t.num_rows :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for x in (u, v, root[u], root[v]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """Stored (node, root) of every node of ``links(u, v)``; root is the least node reachable.  Nodes are of any type that has an order.

    Links may repeat, point either way or join a node with itself; nulls are ignored.  No links give no rows.
    """
    edges = stored(links.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    if state[0] <= ONE_TASK:
        kind = edges.schema["u"].dataType.simpleString()
        return stored(edges.coalesce(1).mapInArrow(_at_once, f"node {kind}, root {kind}"), "roots", edges)
    while True:
        moved = stored(_large_star(edges).distinct(), "stars", edges)
        edges = stored(_small_star(moved).distinct(), "links", moved)
        before, state = state, _state(edges)
        if state == before:
            both = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
            return stored(both.distinct(), "roots", edges)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = stored(least.select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u >= v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))
