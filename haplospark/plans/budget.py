"""What a graph needs, by category and by level, from its statistics alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.graph import GraphDataset

#: Bytes of an id and of a value.
ID, VALUE = 8, 8


def accounting(graph: GraphDataset, vectors: int = 1) -> DataFrame:
    """category, entries, nbytes of edges, selectors, node values, operands and results for so many vectors."""
    m = graph.meta
    stats = graph.selector_stats.agg(F.sum("mut_nnz").alias("mut"), F.sum("miss_nnz").alias("miss")).first()
    rows = [
        ("edges", m.num_edges, 2 * ID * m.num_edges), ("mutation selector", stats["mut"], 2 * ID * stats["mut"]), ("missingness selector", stats["miss"], 2 * ID * stats["miss"]),
        ("node values", vectors * m.num_nodes, vectors * VALUE * m.num_nodes), ("operands and results", vectors * (m.num_samples + m.num_mutations), vectors * VALUE * (m.num_samples + m.num_mutations)),
    ]
    return graph.nodes.sparkSession.createDataFrame(rows, "category string, entries bigint, nbytes bigint")


def largest_levels(graphs: dict[str, GraphDataset]) -> DataFrame:
    """level, max_nodes, max_edges over several graphs."""
    out = None
    for name, g in graphs.items():
        sizes = g.nodes.groupBy("level").agg(F.count("*").alias("nodes"))
        edges = g.edges.groupBy(F.col("dst_level").alias("level")).agg(F.count("*").alias("edges"))
        part = sizes.join(edges, "level", "left").select(F.lit(name).alias("graph_id"), "level", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("level").agg(F.max("nodes").cast("bigint").alias("max_nodes"), F.max("edges").cast("bigint").alias("max_edges"))


def promotion_order(graph: GraphDataset) -> DataFrame:
    """Level pairs that have edges, the largest first: the order in which they are worth keeping in memory."""
    return graph.block_stats.where("nnz > 0").withColumn("nbytes", 2 * ID * F.col("nnz")).orderBy(F.desc("nbytes"), "dst_level", "src_level")
