"""Compiling edge and mutation tables into a validated, height-ordered graph dataset."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.checkpoints import Levels, release, stored
from haplospark.operators.kernel import Structure, node_levels

#: Up to so many edges levels are found in one task, in one pass; beyond, level by level with joins.
ONE_TASK_EDGES = 5_000_000


@dataclass(frozen=True)
class Meta:
    num_samples: int
    num_mutations: int
    num_nodes: int
    num_edges: int
    ploidy: int
    height: int
    has_missing: bool
    has_coalescence: bool

    @property
    def num_individuals(self) -> int:
        return -(-self.num_samples // max(self.ploidy, 1))


@dataclass(frozen=True, eq=False)
class GraphDataset:
    """A compiled graph: plain tables, and what is known of their sizes."""

    meta: Meta
    nodes: DataFrame
    edges: DataFrame
    mut_node: DataFrame
    miss_node: DataFrame
    mutations: DataFrame
    bias: DataFrame | None = None

    @cached_property
    def samples(self) -> DataFrame:
        """sample_id, individual_id: consecutive samples belong to one individual, by ploidy."""
        ids = self.nodes.sparkSession.range(self.meta.num_samples)
        return ids.select(F.col("id").alias("sample_id"), F.floor(F.col("id") / max(self.meta.ploidy, 1)).cast("bigint").alias("individual_id"))

    @cached_property
    def block_stats(self) -> DataFrame:
        """dst_level, src_level, nrows, ncols, nnz of every level pair, empty ones included."""
        sizes = self.nodes.groupBy("level").agg(F.count("*").alias("n"))
        pairs = sizes.select(F.col("level").alias("dst_level"), F.col("n").alias("nrows")).join(sizes.select(F.col("level").alias("src_level"), F.col("n").alias("ncols")), F.col("src_level") < F.col("dst_level"))
        nnz = self.edges.groupBy("dst_level", "src_level").agg(F.count("*").alias("nnz"))
        return pairs.join(nnz, ["dst_level", "src_level"], "left").select("dst_level", "src_level", "nrows", "ncols", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))

    @cached_property
    def level_pairs(self) -> list[tuple[int, int]]:
        """(dst_level, src_level) of the level pairs that have edges."""
        return sorted((r[0], r[1]) for r in self.edges.select("dst_level", "src_level").distinct().collect())

    @cached_property
    def selector_entries(self) -> int:
        return self.mut_node.count() + self.miss_node.count()

    @cached_property
    def selector_stats(self) -> DataFrame:
        """level, mut_nnz, miss_nnz of every level."""
        at = lambda pairs, name: pairs.join(self.nodes.select("node_id", "level"), "node_id").groupBy("level").agg(F.count("*").alias(name))
        levels = self.nodes.select("level").distinct()
        joined = levels.join(at(self.mut_node, "mut_nnz"), "level", "left").join(at(self.miss_node, "miss_nnz"), "level", "left")
        return joined.select("level", F.coalesce("mut_nnz", F.lit(0)).cast("bigint").alias("mut_nnz"), F.coalesce("miss_nnz", F.lit(0)).cast("bigint").alias("miss_nnz"))

    @cached_property
    def mutation_ids(self) -> DataFrame:
        return self.nodes.sparkSession.range(self.meta.num_mutations).withColumnRenamed("id", "mutation_id")

    @cached_property
    def structure(self) -> Structure:
        """The whole graph as arrays; for graphs that the planner found to fit into a worker."""
        def pairs(df: DataFrame, a: str, b: str) -> tuple[np.ndarray, ...]:
            found = df.select(a, b).toArrow()
            return tuple(found[c].to_numpy() for c in (a, b))

        coal = None
        if self.meta.has_coalescence:
            at, count = pairs(self.nodes.where("coal_count > 0"), "node_id", "coal_count")
            coal = np.zeros(self.meta.num_nodes)
            coal[at] = count
        m = self.meta
        return Structure(m.num_nodes, m.num_samples, m.num_mutations, m.ploidy, *pairs(self.edges, "parent", "child"), pairs(self.mut_node, "mutation_id", "node_id"), pairs(self.miss_node, "mutation_id", "node_id"), coal)

    def mutation(self, mutation_id: int) -> DataFrame:
        if not 0 <= mutation_id < self.meta.num_mutations:
            raise IndexError(f"mutation {mutation_id} is not within 0..{self.meta.num_mutations - 1}")
        return self.mutations.where(F.col("mutation_id") == mutation_id)

    def with_bias(self) -> GraphDataset:
        """With the response of both endpoints to an init of 1 in each node, and to 2 x the coalescence count."""
        from haplospark.operators.traverse import endpoint_bias

        return replace(self, bias=stored(endpoint_bias(self), "bias"))


def _require(bad: DataFrame, message: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def levels(edges: DataFrame, num_nodes: int, num_edges: int) -> DataFrame:
    """node_id, level of every node 0..num_nodes-1."""
    if num_edges <= ONE_TASK_EDGES:
        # Stored: it is a start of several tables, and edges would be brought together for each.
        found = stored(edges.select("parent", "child").repartition(1).mapInArrow(_levels_in_a_task(num_nodes), "node_id bigint, level int"), "levels")
        if found.isEmpty():
            raise ValueError("the graph has a cycle")
        return found
    return _levels_by_joins(edges, num_nodes)


def _levels_in_a_task(num_nodes: int):
    """No rows at all where there is a cycle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(batches, pa.schema([("parent", pa.int64()), ("child", pa.int64())]))
        try:
            found = node_levels(every["parent"].to_numpy(), every["child"].to_numpy(), num_nodes)
        except ValueError:
            return
        for k in range(0, num_nodes, 100_000):
            here = found[k : k + 100_000].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(here))), pa.array(here)], names=["node_id", "level"])

    return run


def _levels_by_joins(edges: DataFrame, num_nodes: int) -> DataFrame:
    """A node is settled one round after the last of its children.

    Each round takes up the edges above the nodes just settled, and no others: edges lie ordered by child, so that a
    range of ids is read.  Of a node with some children settled only their number is kept; it is settled when that is all of them.
    """
    spark = edges.sparkSession
    by_child = stored(edges.select("parent", "child").repartitionByRange("child").sortWithinPartitions("child"), "edges")
    degree = stored(by_child.groupBy("parent").agg(F.count("*").alias("degree")).repartitionByRange("parent").sortWithinPartitions("parent"), "degrees")
    found = Levels(spark, "levels", "node_id bigint")
    front = found.add(0, spark.range(num_nodes).withColumnRenamed("id", "node_id").join(degree.select(F.col("parent").alias("node_id")), "node_id", "left_anti"))
    level, begun, settled = 0, None, 0
    while True:
        span = front.agg(F.count("*").alias("n"), F.min("node_id").alias("low"), F.max("node_id").alias("high")).first()
        if not span["n"]:
            break
        settled, level = settled + span["n"], level + 1
        above = by_child.where(F.col("child").between(span["low"], span["high"])).join(front.withColumnRenamed("node_id", "child"), "child")
        touched = above.groupBy("parent").agg(F.count("*").alias("seen"))
        counted = touched if begun is None else touched.unionByName(begun).groupBy("parent").agg(F.sum("seen").alias("seen"))
        counted = stored(counted.join(degree, "parent"), "counted", begun)
        begun = stored(counted.where("seen < degree").select("parent", "seen"), "begun")
        front = found.add(level, counted.where("seen = degree").select(F.col("parent").alias("node_id")))
        release(counted)
    release(by_child, degree, begun)
    if settled != num_nodes:
        raise ValueError("the graph has a cycle")
    return found.every()


def compile_graph(
    edges: DataFrame,
    mutation_rows: DataFrame,
    num_samples: int,
    num_nodes: int,
    ploidy: int,
    coalescence: DataFrame | None = None,
    mutations: DataFrame | None = None,
) -> GraphDataset:
    """Validate and compile.

    ``edges(parent, child)``; ``mutation_rows(mutation_id, node_id, miss_node_id)``: any number of rows for each of the
    mutations 0..M-1, null for "no node"; ``coalescence(node_id, coal_count)``: individuals whose haplotypes meet first
    at that node; a sample without a count has 0, an inner node without one is an error.

    Errors (``ValueError``): an empty graph, a repeated edge, an edge below or to itself (a cycle), an id out of range,
    a gap in the mutation ids, a sample with children.  A mutation may have several nodes, which add up (also the same one
    twice); of its missing nodes each counts once.
    """
    if num_samples <= 0 or num_nodes <= 0:
        raise ValueError("a graph needs at least one sample and one node")
    if num_samples > num_nodes:
        raise ValueError("there are more samples than nodes")
    edges = edges.select(F.col("parent").cast("bigint").alias("parent"), F.col("child").cast("bigint").alias("child"))
    inside = lambda c: F.col(c).between(0, num_nodes - 1)
    _require(edges.where(~inside("parent") | ~inside("child") | F.col("parent").isNull() | F.col("child").isNull()), "an edge leaves the graph")
    _require(edges.groupBy("parent", "child").agg(F.count("*").alias("n")).where("n > 1"), "a repeated edge")
    _require(edges.where(F.col("parent") < num_samples), "a sample has children")
    num_edges = edges.count()
    height = levels(edges, num_nodes, num_edges)
    # A window by level would put all leaves into one task; positions come from a sort and each partition's count.
    nodes = _positions(height).withColumn("is_sample", F.col("node_id") < num_samples)
    if coalescence is not None:
        given = coalescence.select(F.col("node_id").cast("bigint").alias("node_id"), F.col("coal_count").cast("bigint").alias("coal_count"))
        nodes = nodes.join(given, "node_id", "left").withColumn("coal_count", F.coalesce("coal_count", F.when(F.col("is_sample"), F.lit(0))))
        _require(nodes.where("coal_count is null and level > 0"), "an inner node has no coalescence count")
        nodes = nodes.withColumn("coal_count", F.coalesce("coal_count", F.lit(0)))
    else:
        nodes = nodes.withColumn("coal_count", F.lit(None).cast("bigint"))
    nodes = stored(nodes.select("node_id", "level", "pos", "is_sample", "coal_count"), "nodes")
    own = nodes.select(F.col("node_id").alias("id"), F.col("level").alias("l"))
    linked = edges.join(own.select(F.col("id").alias("parent"), F.col("l").alias("dst_level")), "parent").join(own.select(F.col("id").alias("child"), F.col("l").alias("src_level")), "child")
    # By ranges of level pairs: a traversal's level reads its own files, and a pair of very many edges is in several.
    linked = stored(linked.select("parent", "child", "dst_level", "src_level").repartitionByRange("dst_level", "src_level", "child").sortWithinPartitions("dst_level", "src_level", "child"), "edges")
    rows = mutation_rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("mutation_id", "node_id", "miss_node_id")])
    _require(rows.where(F.col("mutation_id").isNull() | (F.col("mutation_id") < 0)), "a mutation without a number")
    _require(rows.where(~inside("node_id") | ~inside("miss_node_id")), "a mutation's node is not in the graph")
    seen = rows.agg(F.count_distinct("mutation_id").alias("n"), (F.max("mutation_id") + 1).alias("m")).first()
    if seen["n"] != (seen["m"] or 0):
        raise ValueError(f"mutation numbers have gaps: {seen['n']} of {seen['m']}")
    mut_node = stored(rows.where("node_id is not null").select("mutation_id", "node_id"), "mut_node")
    miss_node = stored(rows.where("miss_node_id is not null").select("mutation_id", F.col("miss_node_id").alias("node_id")).distinct(), "miss_node")
    if mutations is None:
        none = F.lit(None)
        mutations = rows.select("mutation_id").distinct().select("mutation_id", none.cast("double").alias("position"), none.cast("double").alias("time"), none.cast("string").alias("allele"), none.cast("string").alias("ref_allele"))
    top = nodes.agg(F.max("level")).first()[0]
    meta = Meta(num_samples, int(seen["m"] or 0), num_nodes, num_edges, ploidy, int(top), not miss_node.isEmpty(), coalescence is not None)
    return GraphDataset(meta, nodes, linked, mut_node, miss_node, stored(mutations, "mutations"))


def _positions(height: DataFrame) -> DataFrame:
    """pos: place in the order by (level, node_id), from 0, without a window over everything."""
    ordered = stored(height.repartitionByRange("level", "node_id").sortWithinPartitions("level", "node_id").withColumn("part", F.spark_partition_id()), "ordered")
    per = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition.
    starts = per.withColumn("start", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("start", F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("level", "node_id"))
    return ordered.join(F.broadcast(starts), "part").select("node_id", "level", (F.col("start") + within - 1).cast("bigint").alias("pos"))


def individual(sample: Column, ploidy: int) -> Column:
    return F.floor(sample / max(ploidy, 1)).cast("bigint")
