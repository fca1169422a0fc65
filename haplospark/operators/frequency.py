"""Allele counts and frequencies, and products with the standardised or mean-imputed matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.checkpoints import stored
from haplospark.operators.genotypes import dosages, node_products
from haplospark.operators.graph import GraphDataset
from haplospark.operators.traverse import down, traverse

#: Nodes of a mutation whose products with each other are looked up.
PAIRED = 64


def ones(graph: GraphDataset) -> DataFrame:
    return graph.samples.select(F.lit(0).alias("row"), F.col("sample_id").alias("id"), F.lit(1.0).alias("value"))


def allele_counts(graph: GraphDataset) -> DataFrame:
    """mutation_id, allele_count, miss_count."""
    got = traverse(graph, ones(graph), "up", miss=True)
    miss = got.missing.select("id", F.col("value").alias("m"))
    return got.values.join(miss, "id").select(F.col("id").alias("mutation_id"), F.col("value").cast("bigint").alias("allele_count"), F.col("m").cast("bigint").alias("miss_count"))


def miss_counts(graph: GraphDataset) -> DataFrame:
    """mutation_id, miss_count: samples without a call, 0 where all have one."""
    return traverse(graph, ones(graph), "up", miss=True).missing.select(F.col("id").alias("mutation_id"), F.col("value").cast("bigint").alias("miss_count"))


def allele_frequencies(graph: GraphDataset) -> DataFrame:
    """mutation_id, freq, center, sigma: counts over called samples (0 if there is none), and what standardises a dosage."""
    called = F.lit(graph.meta.num_samples) - F.col("miss_count")
    freq = F.when(called != 0, F.col("allele_count") / called).otherwise(F.lit(0.0))
    ploidy = F.lit(float(graph.meta.ploidy))
    spread = F.sqrt(F.greatest(ploidy * F.col("freq") * (1 - F.col("freq")), F.lit(0.0)))
    return allele_counts(graph).withColumn("freq", freq).select("mutation_id", "freq", (ploidy * F.col("freq")).alias("center"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("sigma"))


def dosage_squares(graph: GraphDataset) -> DataFrame:
    """mutation_id, value: diagonal of XᵀX over individuals, from coalescence counts (mutations of one node)."""
    got = traverse(graph, ones(graph), "up", init_mode="xtx").values
    return got.select(F.col("id").alias("mutation_id"), "value")


def _squares_of_several(graph: GraphDataset, several: DataFrame) -> DataFrame:
    """mutation_id, value: sums of squared dosages, as the products of the mutation's nodes with each other.

    The products of two nodes are the same for all mutations that have both, so nothing is written out by mutation.
    Mutations of more than ``PAIRED`` nodes, which have more pairs than is worth while, are written out.
    """
    own = graph.mut_node.join(several, "mutation_id", "left_semi").groupBy("mutation_id", "node_id").agg(F.count("*").alias("times"))
    few = own.groupBy("mutation_id").agg((F.count("*") <= PAIRED).alias("few"))
    own = stored(own.join(few, "mutation_id"), "own")
    left, right = own.where("few").select("mutation_id", F.col("node_id").alias("a"), F.col("times").alias("ta")), own.where("few").select("mutation_id", F.col("node_id").alias("b"), F.col("times").alias("tb"))
    pairs = stored(left.join(right, "mutation_id").where("a <= b").select("mutation_id", "a", "b", (F.col("ta") * F.col("tb") * F.when(F.col("a") < F.col("b"), 2).otherwise(1)).alias("times")), "node_pairs")
    out = pairs.join(node_products(graph, pairs), ["a", "b"]).groupBy("mutation_id").agg(F.sum(F.col("times") * F.col("product")).alias("value"))
    many = own.where("not few").select("mutation_id").distinct()
    if many.isEmpty():
        return out
    written = dosages(graph, many).groupBy("variant_id").agg(F.sum(F.col("dosage") * F.col("dosage")).cast("double").alias("value")).withColumnRenamed("variant_id", "mutation_id")
    return out.unionByName(written)


def dosage_sums(graph: GraphDataset) -> DataFrame:
    """variant_id, sum, sumsq, missing (0) of the mutations that have a carrier, without the matrix.

    Sums come from one traversal; squares of mutations with one node from coalescence counts, those of mutations with several nodes (all,
    where there are no counts) from products of nodes.
    """
    nodes = graph.mut_node.groupBy("mutation_id").agg(F.count("*").alias("n"))
    squares = _squares_of_several(graph, nodes.where("n > 1" if graph.meta.has_coalescence else "n > 0").select("mutation_id"))
    if graph.meta.has_coalescence:
        squares = squares.unionByName(dosage_squares(graph).join(nodes.where("n = 1").select("mutation_id"), "mutation_id").select("mutation_id", "value"))
    sums = traverse(graph, ones(graph), "up", sparse=True).values.select(F.col("id").alias("mutation_id"), F.round("value").cast("bigint").alias("sum"))
    return sums.join(squares, "mutation_id").select(F.col("mutation_id").alias("variant_id"), "sum", F.round("value").cast("bigint").alias("sumsq"), F.lit(0).cast("bigint").alias("missing"))


def up_imputed(graph: GraphDataset, operand: DataFrame, freqs: DataFrame, by_individual: bool = False) -> DataFrame:
    """V times X with missing entries set to the frequency: the plain product plus frequency times the missingness output."""
    got = traverse(graph, operand, "up", by_individual=by_individual, miss=True)
    miss = got.missing.withColumnRenamed("value", "m")
    f = freqs.select(F.col("mutation_id").alias("id"), "freq")
    return got.values.join(miss, ["row", "id"]).join(f, "id").select("row", "id", (F.col("value") + F.col("freq") * F.col("m")).alias("value"))


def down_imputed(graph: GraphDataset, operand: DataFrame, freqs: DataFrame, by_individual: bool = False) -> DataFrame:
    """W times the transpose of the imputed X."""
    f = freqs.select(F.col("mutation_id").alias("id"), "freq")
    weighted = operand.join(f, "id").select("row", "id", (F.col("value") * F.col("freq")).alias("value"))
    return down(graph, operand, by_individual=by_individual, miss=weighted)


def standardised_down(graph: GraphDataset, operand: DataFrame, freqs: DataFrame) -> DataFrame:
    """V (by mutation) times the transpose of the individuals x mutations matrix, imputed, centred and scaled; row, id (individual), value."""
    f = freqs.select(F.col("mutation_id").alias("id"), "freq", "center", "sigma")
    scaled = operand.join(f, "id").select("row", "id", (F.col("value") / F.col("sigma")).alias("value"), "center")
    shift = scaled.groupBy("row").agg(F.sum(F.col("value") * F.col("center")).alias("shift"))
    seen = down_imputed(graph, scaled.select("row", "id", "value"), freqs, by_individual=True)
    return seen.join(shift, "row").select("row", "id", (F.col("value") - F.col("shift")).alias("value"))


def standardised_up(graph: GraphDataset, operand: DataFrame, freqs: DataFrame) -> DataFrame:
    """V (by individual) times that matrix; row, id (mutation), value."""
    f = freqs.select(F.col("mutation_id").alias("id"), "center", "sigma")
    total = operand.groupBy("row").agg(F.sum("value").alias("total"))
    back = up_imputed(graph, operand, freqs, by_individual=True).join(f, "id").join(total, "row")
    return back.select("row", "id", ((F.col("value") - F.col("total") * F.col("center")) / F.col("sigma")).alias("value"))


def standardised_gram(graph: GraphDataset, operand: DataFrame, freqs: DataFrame) -> DataFrame:
    """V (by mutation) times XᵀX; row, id (mutation), value."""
    return standardised_up(graph, standardised_down(graph, operand, freqs), freqs)
