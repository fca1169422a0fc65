"""Compiled graphs on disk: one Parquet folder per table, small statistics for planning, and a last-written meta row.

A store is complete once ``meta`` is there.  ``scan`` reads meta and statistics only.  Edges are laid out by level pair,
so a traversal of some levels reads only their files.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from haplospark import schema
from haplospark.operators.graph import GraphDataset, Meta, compile_graph

MAGIC = "haplospark-graph"
VERSION = 1
SUFFIX = ".graph"


@dataclass(frozen=True)
class StoreScan:
    """What is known without reading a single edge."""

    meta: Meta
    blocks: list[Row]
    selectors: list[Row]

    @property
    def level_pairs(self) -> list[tuple[int, int]]:
        return [(b["dst_level"], b["src_level"]) for b in self.blocks if b["nnz"]]


def _path(path: str) -> str:
    if not path.rstrip("/").endswith(SUFFIX):
        raise ValueError(f"a graph store ends with {SUFFIX}: {path}")
    return path.rstrip("/")


def default_path(source: str, output_dir: str, name: str | None = None) -> str:
    """``output_dir`` plus the absolute source path without its leading slash, or plus ``name``."""
    stem = name if name is not None else str(PurePosixPath(source).with_suffix("")).lstrip("/")
    return f"{output_dir.rstrip('/')}/{stem}{SUFFIX}"


def exists(spark: SparkSession, path: str) -> bool:
    return _there(spark, f"{_path(path)}/meta/_SUCCESS")


def save(graph: GraphDataset, path: str, overwrite: bool = False) -> str:
    """Write all tables; meta goes first on an overwrite and is written last, so a run that dies leaves no store."""
    path, spark = _path(path), graph.nodes.sparkSession
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    graph.edges.repartition("dst_level", "src_level").sortWithinPartitions("parent", "child").write.mode("overwrite").partitionBy("dst_level", "src_level").parquet(f"{path}/edges")
    for name in ("nodes", "mut_node", "miss_node", "mutations", "block_stats", "selector_stats"):
        put(getattr(graph, name), name)
    if graph.bias is not None:
        put(graph.bias, "bias")
    m = graph.meta
    row = (MAGIC, VERSION, m.num_samples, m.num_individuals, m.num_mutations, m.num_nodes, m.num_edges, m.ploidy, m.height, m.has_missing, m.has_coalescence)
    put(spark.createDataFrame([row], schema.META), "meta")
    return path


def _meta(spark: SparkSession, path: str) -> Meta:
    if not exists(spark, path):
        raise FileNotFoundError(f"no complete graph store at {path}")
    r = spark.read.schema(schema.META).parquet(f"{path}/meta").first()
    if r is None or r["magic"] != MAGIC:
        raise ValueError(f"{path} is not a graph store")
    if r["version"] != VERSION:
        raise ValueError(f"{path} has version {r['version']}, not {VERSION}")
    return Meta(r["num_samples"], r["num_mutations"], r["num_nodes"], r["num_edges"], r["ploidy"], r["height"], r["has_missing"], r["has_coalescence"])


def scan(spark: SparkSession, path: str) -> StoreScan:
    """Meta and statistics, checked against each other."""
    path = _path(path)
    meta = _meta(spark, path)
    blocks = spark.read.schema(schema.BLOCKS).parquet(f"{path}/block_stats").orderBy("dst_level", "src_level").collect()
    selectors = spark.read.schema(schema.SELECTOR_STATS).parquet(f"{path}/selector_stats").orderBy("level").collect()
    if sum(b["nnz"] for b in blocks) != meta.num_edges or any(min(b["nrows"], b["ncols"], b["nnz"]) < 0 for b in blocks):
        raise ValueError(f"the block statistics of {path} do not fit its number of edges")
    if [s["level"] for s in selectors] != list(range(meta.height + 1)):
        raise ValueError(f"the selector statistics of {path} do not fit its height")
    return StoreScan(meta, blocks, selectors)


def block(spark: SparkSession, path: str, dst_level: int, src_level: int) -> DataFrame:
    """The edges of one level pair; other pairs' files are not read."""
    edges = spark.read.schema(schema.EDGES).parquet(f"{_path(path)}/edges")
    return edges.where((F.col("dst_level") == dst_level) & (F.col("src_level") == src_level))


def load(spark: SparkSession, path: str) -> GraphDataset:
    path = _path(path)
    meta = _meta(spark, path)
    get = lambda name, s: spark.read.schema(s).parquet(f"{path}/{name}")
    biased = _there(spark, f"{path}/bias/_SUCCESS")
    return GraphDataset(
        meta, get("nodes", schema.NODES), get("edges", schema.EDGES), get("mut_node", schema.SELECTOR), get("miss_node", schema.SELECTOR),
        get("mutations", schema.MUTATIONS), get("bias", schema.BIAS) if biased else None,
    )


def load_many(spark: SparkSession, paths: list[str]) -> list[GraphDataset]:
    """Several graphs, in the given order."""
    return [load(spark, p) for p in paths]


def ensure(spark: SparkSession, path: str, build) -> GraphDataset:
    """The store at ``path`` if it is complete and valid, else ``build()``, saved there."""
    try:
        scan(spark, path)
    except (FileNotFoundError, ValueError):
        save(build(), path, overwrite=True)
    return load(spark, path)


def convert(spark: SparkSession, source: str, output_dir: str, name: str | None = None) -> str:
    """Compile the tables below ``source`` and store the graph with its endpoint responses; returns the store's path.

    ``source``: ``shape.parquet`` (one row: num_samples, num_nodes, ploidy), ``edges.parquet``, ``mutation_rows.parquet``, and,
    where there are any, ``coalescence.parquet`` and ``mutations.parquet``.
    """
    shape = spark.read.parquet(f"{source}/shape.parquet").collect()
    if len(shape) != 1:
        raise ValueError(f"the shape of {source} has {len(shape)} rows, not one")
    there = lambda n: _there(spark, f"{source}/{n}.parquet")
    read = lambda n: spark.read.parquet(f"{source}/{n}.parquet")
    graph = compile_graph(
        read("edges"), read("mutation_rows"), shape[0]["num_samples"], shape[0]["num_nodes"], shape[0]["ploidy"],
        read("coalescence") if there("coalescence") else None, read("mutations") if there("mutations") else None,
    )
    return save(graph.with_bias(), default_path(source, output_dir, name), overwrite=True)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
