"""A deterministic graph made from the star-schema tables, so that queries have something to run on.

Samples are the two haplotypes of each customer; inner nodes are nations, market segments, regions and a root; mutations
are parts.  All rules are plain expressions, so the same graph can be written down in SQL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.operators.graph import GraphDataset, compile_graph

PLOIDY = 2
#: Node numbers behind the last sample: 25 nations, 5 segments, 5 regions, the root.
NATION, SEGMENT, REGION, ROOT = 0, 25, 30, 35


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_mktsegment, rank: its place by name, from 0."""
    names = sorted(r[0] for r in read(spark, sf_dir, "customer").select("c_mktsegment").distinct().limit(REGION - SEGMENT + 1).collect())
    if len(names) > REGION - SEGMENT:
        raise ValueError("there are more market segments than nodes for them")
    return spark.createDataFrame(list(enumerate(names)), "rank int, c_mktsegment string")


def edge_table(spark: SparkSession, sf_dir: str, samples: int) -> DataFrame:
    ranked = read(spark, sf_dir, "customer").join(F.broadcast(segment_ranks(spark, sf_dir)), "c_mktsegment")
    nation = F.col("c_nationkey").cast("bigint") + samples + NATION
    other = F.when(F.col("c_custkey") % 3 == 0, nation).otherwise(samples + SEGMENT + F.col("rank").cast("bigint"))
    haplotypes = ranked.select(F.explode(F.array(F.struct(nation.alias("parent"), (2 * F.col("c_custkey")).alias("child")), F.struct(other.alias("parent"), (2 * F.col("c_custkey") + 1).alias("child")))).alias("e")).select("e.*")
    nations = read(spark, sf_dir, "nation").select((F.col("n_regionkey").cast("bigint") + samples + REGION).alias("parent"), (F.col("n_nationkey").cast("bigint") + samples + NATION).alias("child"))
    root = F.lit(samples + ROOT).cast("bigint")
    regions = read(spark, sf_dir, "region").select(root.alias("parent"), (F.col("r_regionkey").cast("bigint") + samples + REGION).alias("child"))
    segments = segment_ranks(spark, sf_dir).select(root.alias("parent"), (F.col("rank").cast("bigint") + samples + SEGMENT).alias("child"))
    return haplotypes.unionByName(nations).unionByName(regions).unionByName(segments)


def mutation_table(spark: SparkSession, sf_dir: str, samples: int) -> DataFrame:
    p = F.col("p_partkey")
    node = F.when(p % 97 == 0, F.lit(None)).when(p % 41 == 0, p % samples).otherwise(samples + p % 36)
    miss = F.when(p % 7 == 0, samples + (p + 11) % 25)
    parts = read(spark, sf_dir, "part")
    second = parts.where((p % 53 == 0) & (p % 97 != 0)).select(p.alias("mutation_id"), (samples + (p + 1) % 25).alias("node_id"), F.lit(None).cast("bigint").alias("miss_node_id"))
    return parts.select(p.alias("mutation_id"), node.cast("bigint").alias("node_id"), miss.cast("bigint").alias("miss_node_id")).unionByName(second)


def position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("mutation_id"), (1000 * F.col("p_size") + p % 40).cast("double").alias("position"), F.lit(0.0).alias("time"), F.element_at(F.array(*map(F.lit, "ACGT")), (p % 4 + 1).cast("int")).alias("allele"), F.element_at(F.array(*map(F.lit, "CGTA")), (p % 4 + 1).cast("int")).alias("ref_allele")
    )


def coalescence_table(spark: SparkSession, sf_dir: str, samples: int) -> DataFrame:
    """Both haplotypes of a customer hang below the nation if its number is divisible by 3, else they meet at the root."""
    met = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("bigint") + samples + NATION).otherwise(F.lit(samples + ROOT).cast("bigint"))
    counts = read(spark, sf_dir, "customer").groupBy(met.alias("node_id")).agg(F.count("*").alias("n"))
    inner = spark.range(samples, samples + ROOT + 1).withColumnRenamed("id", "node_id")
    return inner.join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("coal_count"))


def graph(spark: SparkSession, sf_dir: str) -> GraphDataset:
    """The compiled graph; compiled once for each application and folder."""
    return _graph(spark.sparkContext.applicationId, sf_dir)


def forget() -> None:
    """The next graph is compiled anew."""
    _graph.cache_clear()


@lru_cache(maxsize=4)
def _graph(application: str, sf_dir: str) -> GraphDataset:
    spark = SparkSession.getActiveSession()
    samples = PLOIDY * read(spark, sf_dir, "customer").count()
    return compile_graph(
        edge_table(spark, sf_dir, samples), mutation_table(spark, sf_dir, samples), samples, samples + ROOT + 1, PLOIDY, coalescence_table(spark, sf_dir, samples), position_table(spark, sf_dir)
    )
