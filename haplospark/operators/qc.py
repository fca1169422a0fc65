"""Variant matching and quality control: relational operators over variant, genotype and sample tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.checkpoints import stored

#: A variant takes part in a model only if its projected norm is at least this.
MIN_PROJECTED_NORM = 0.1
#: Covariate entries that stand for a missing value.
MISSING_TOKENS = ("-9", "NA")
#: Levels that a categorical covariate may have.
MAX_LEVELS = 10
#: Singular values below this share of the largest do not count.
RANK_CUT = 1e-8
#: Numbers of a covariate basis that is broadcast.
MAX_BROADCAST_NUMBERS = 4_000_000
#: Tasks that put factors of partitions together.
FACTORS = 16


def unique_id(chrom: Column, bp: Column, allele1: Column, allele0: Column) -> Column:
    return F.concat_ws(":", chrom.cast("string"), bp.cast("string"), allele1, allele0)


def repeated_positions(variants: DataFrame, bp: str = "bp") -> DataFrame:
    """bp, n of positions that occur more than once."""
    return variants.groupBy(bp).agg(F.count("*").alias("n")).where("n > 1")


def singletons(variants: DataFrame, bp: str = "bp") -> DataFrame:
    """``variants`` whose position occurs once."""
    return variants.join(repeated_positions(variants, bp).select(bp), bp, "left_anti")


def match_variants(bim: DataFrame, mutations: DataFrame, also_repeated: DataFrame | None = None) -> DataFrame:
    """``bim(chrom, snp_id, bp, allele1, allele0, row)`` rows whose position and both alleles are a mutation's.

    Positions repeated in the BIM, in ``also_repeated(bp)``, or among the mutations (rounded half to even) drop out.
    Adds mutation_id and unique_id.
    """
    left = singletons(bim)
    if also_repeated is not None:
        left = left.join(also_repeated.select("bp").distinct(), "bp", "left_anti")
    graph = mutations.select("mutation_id", F.bround("position").cast("bigint").alias("bp"), F.col("allele").alias("allele1"), F.col("ref_allele").alias("allele0"))
    graph = singletons(graph.join(left.select("bp").distinct(), "bp", "left_semi"))
    found = left.join(graph, ["bp", "allele1", "allele0"])
    return found.select("chrom", "snp_id", "bp", "allele1", "allele0", "row", "mutation_id", unique_id(F.col("chrom"), F.col("bp"), F.col("allele1"), F.col("allele0")).alias("unique_id"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` and ``name``: their place in the order, from 0.  Sorted by range, with each part's number of rows added up: no window over everything."""
    part, here = "__part", "__at"
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(here, F.monotonically_increasing_id()), "numbered")
    per = dealt.groupBy(part).agg(F.count("*").alias("__n"), F.min(here).alias("__first"))
    starts = per.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each part
    return dealt.join(F.broadcast(starts), part).withColumn(name, (F.col("__start") + F.col(here) - F.col("__first")).cast("bigint")).drop(part, here, "__first", "__start")


def global_index(variants: DataFrame, chrom: str = "chrom", row: str = "row", name: str = "global_idx") -> DataFrame:
    """``variants`` and ``name``: the place by (chrom, row), from 0."""
    return numbered(variants, [chrom, row], name)


def sample_variants(variants: DataFrame, count: int, seed: int, chrom: int = 0, keep: Callable[[DataFrame], DataFrame] | None = None, batch: int = 256) -> DataFrame:
    """The first ``count`` rows of ``variants(row, ...)``, numbered from 0, that ``keep`` keeps, in a seeded random order; by row.

    Batches of the order are looked at until enough are found, so a costly ``keep`` (a match with a graph) sees few rows.  Too few rows are an error.
    """
    total, spark = variants.count(), variants.sparkSession
    if not 1 <= count <= total:
        raise ValueError(f"{count} variants were asked for, of {total}")

    def shuffled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            order = np.random.default_rng(np.random.SeedSequence([seed, chrom])).permutation(total)
            for k in range(0, total, 100_000):
                yield pd.DataFrame({"__turn": np.arange(k, min(k + 100_000, total)), "row": order[k : k + 100_000]})

    order = stored(spark.range(1).coalesce(1).mapInPandas(shuffled, "__turn bigint, row bigint"), "order")
    step, found = max(batch, 8 * count), None
    for first in range(0, total, step):
        here = order.where(F.col("__turn").between(first, first + step - 1))
        own = variants.join(here.select("row"), "row", "left_semi")
        kept = stored((own if keep is None else keep(own)).join(here, "row"), "sampled")
        found = kept if found is None else stored(found.unionByName(kept), "sampled", found, kept)
        if found.count() >= count:
            return found.orderBy("__turn").limit(count).drop("__turn").orderBy("row")
    raise ValueError(f"{count} variants were asked for, but only {found.count()} of {total} fit")


def contiguous_runs(rows: DataFrame, row: str = "row", by: list[str] | None = None) -> DataFrame:
    """first, last, n of each run of consecutive numbers, within ``by``."""
    keys = by or []
    placed = numbered(rows.select(*keys, row), [*keys, row], "__place")
    islands = placed.groupBy(*keys, (F.col(row) - F.col("__place")).alias("__island")).agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count("*").alias("n"))
    return islands.drop("__island")


def calibration_blocks(variants: DataFrame, blocks: int, order: str = "global_idx", is_model: str = "is_model") -> DataFrame:
    """The model variants with their block: of the running count m (from 0) of model variants, floor(blocks * m / count).

    The running count is a place in the order (as in ``global_index``).
    """
    model = numbered(variants.where(is_model), [order], "__m")
    total = model.agg(F.count("*")).first()[0]
    return model.withColumn("block", F.floor(F.lit(blocks) * F.col("__m") / F.lit(max(total, 1))).cast("int")).drop("__m")


def snp_stats(genotypes: DataFrame, num_individuals: int) -> DataFrame:
    """Of ``genotypes(variant_id, individual_id, dosage)``, where absent rows are dosage 0 and null is a missing call:
    variant_id, sum, sumsq, missing, mean, mean_center_norm2, norm_scale, a1freq."""
    g = F.col("dosage")
    sums = genotypes.groupBy("variant_id").agg(F.coalesce(F.sum(g), F.lit(0)).cast("bigint").alias("sum"), F.coalesce(F.sum(g * g), F.lit(0)).cast("bigint").alias("sumsq"), F.count_if(g.isNull()).alias("missing"))
    return stats_of_sums(sums, num_individuals)


def stats_of_sums(sums: DataFrame, num_individuals: int) -> DataFrame:
    """The same from ``sums(variant_id, sum, sumsq, missing)``."""
    n = F.lit(float(num_individuals))
    centred = F.col("sumsq") - F.col("sum") * F.col("sum") / n
    return sums.select(
        "variant_id", "sum", "sumsq", "missing", (F.col("sum") / n).alias("mean"), centred.alias("mean_center_norm2"),
        F.when(centred > 0, F.sqrt((n - 1) / centred)).otherwise(F.lit(0.0)).alias("norm_scale"), (F.col("sum") / (2 * n)).alias("a1freq"),
    )


def require_complete(stats: DataFrame) -> DataFrame:
    """``stats``, failing on the first variant with a missing call."""
    return stats.withColumn("missing", F.when(F.col("missing") > 0, F.raise_error(F.concat(F.lit("missing calls in variant "), F.col("variant_id").cast("string"))).cast("bigint")).otherwise(F.col("missing")))


def projected_norms(genotypes: DataFrame, basis: DataFrame, stats: DataFrame) -> DataFrame:
    """variant_id, proj_norm2, x_norm2: the norm of the centred dosages outside the span of the covariates.

    ``basis(individual_id, q array<double>)`` has orthonormal columns that span the constant; so it is the centred norm less
    the squares of the centred dosages' coordinates.  Sums are per variant and column: map-side, a few numbers a variant.
    """
    basis = stored(basis, "basis")
    width = basis.select(F.size("q")).first()[0]
    # The matrix is by far the larger side: with a basis that a task can hold, it stays where it is.
    small = basis.count() * (width + 4) <= MAX_BROADCAST_NUMBERS
    carried = genotypes.where("dosage is not null and dosage <> 0").join(F.broadcast(basis) if small else basis, "individual_id")
    dots = carried.groupBy("variant_id").agg(*[F.sum(F.col("dosage") * F.col("q")[j]).alias(f"d{j}") for j in range(width)])
    ones = basis.agg(*[F.sum(F.col("q")[j]).alias(f"s{j}") for j in range(width)]).first()
    inside = F.lit(0.0)
    for j in range(width):
        inside = inside + F.pow(F.coalesce(f"d{j}", F.lit(0.0)) - F.col("mean") * F.lit(float(ones[f"s{j}"])), 2)
    out = stats.join(dots, "variant_id", "left").select("variant_id", "norm_scale", F.greatest(F.col("mean_center_norm2") - inside, F.lit(0.0)).alias("proj_norm2"))
    return out.select("variant_id", "proj_norm2", (F.col("proj_norm2") * F.col("norm_scale") * F.col("norm_scale")).alias("x_norm2"))


def is_model_variant() -> Column:
    c = F.col
    return (c("mean_center_norm2") > 0) & (c("proj_norm2") >= MIN_PROJECTED_NORM) & (c("norm_scale") > 0) & (c("x_norm2") > 0)


def require_model_counts(variants: DataFrame) -> dict[int, int]:
    """Model variants by chromosome; each needs one, and all together two."""
    found = {r[0]: r[1] for r in variants.groupBy("chrom").agg(F.count_if(is_model_variant()).alias("n")).collect()}
    empty = sorted(c for c, n in found.items() if not n)
    if empty:
        raise ValueError(f"no model variant on chromosome {empty[0]}")
    if sum(found.values()) < 2:
        raise ValueError("fewer than two model variants")
    return found


def join_samples(samples: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``table(fid, iid, ...)`` for every sample; extra rows are ignored, repeated or missing samples are errors."""
    twice = table.groupBy("fid", "iid").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sample {twice[0]['fid']} {twice[0]['iid']} stands twice in the table")
    out = samples.join(table.select("fid", "iid", *columns, F.lit(True).alias("__there")), ["fid", "iid"], "left")
    lost = out.where("__there is null").limit(1).collect()
    if lost:
        raise ValueError(f"sample {lost[0]['fid']} {lost[0]['iid']} is not in the table")
    return out.drop("__there")


def covariate_columns(table: DataFrame, categorical: list[str], quantitative: list[str], max_levels: int = MAX_LEVELS, missing: tuple[str, ...] = MISSING_TOKENS) -> tuple[DataFrame, list[str]]:
    """``table`` with one 0/1 column for each level of each categorical covariate, the quantitative ones as numbers, and a
    constant 1; and the names of these columns, in order.

    ``missing``: entries of quantitative covariates that stand for a missing value, for tables in which -9 is a number like any other.
    """
    for c in [*categorical, *quantitative]:
        bad = table.where(F.col(c).isNull() | F.col(c).cast("string").isin(*(missing if c in quantitative else MISSING_TOKENS))).limit(1).collect()
        if bad:
            raise ValueError(f"covariate {c} has a missing value")
    names: list[str] = []
    for c in categorical:
        found = sorted(str(r[0]) for r in table.select(c).distinct().limit(max_levels + 1).collect())
        if len(found) > max_levels:
            raise ValueError(f"covariate {c} has more than {max_levels} levels")
        for level in found:
            names.append(f"{c}={level}")
            table = table.withColumn(names[-1], (F.col(c).cast("string") == level).cast("double"))
    for c in quantitative:
        names.append(f"q:{c}")
        table = table.withColumn(names[-1], F.col(c).cast("double"))
    return table.withColumn("constant", F.lit(1.0)), [*names, "constant"]


def orthonormal_basis(matrix: np.ndarray) -> np.ndarray:
    """n x rank, spanning the columns of ``matrix``."""
    u, s, _ = np.linalg.svd(np.asarray(matrix, float), full_matrices=False)
    return u[:, s >= s[0] * RANK_CUT] if len(s) and s[0] > 0 else u[:, :0]


def project(basis: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``vectors`` (n, or n x k) without their parts in the span of ``basis``."""
    return vectors - basis @ (basis.T @ vectors)


def _upper_factor(table: DataFrame, names: list[str]) -> np.ndarray:
    """R of a QR decomposition of tall columns: each partition's own, put together in a few tasks, then here."""
    width = len(names)

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for f in frames:
            rows = [np.frombuffer(b, float).reshape(-1, width) for b in f["r"]] if "r" in f.columns else [f.to_numpy(float)]
            for x in rows:
                r = np.linalg.qr(np.vstack([r, x]), mode="r")
        yield pd.DataFrame({"r": [np.ascontiguousarray(r).tobytes()]})

    parts = table.select(*[F.col(f"`{n}`").cast("double").alias(f"c{k}") for k, n in enumerate(names)]).mapInPandas(reduced, "r binary")
    few = parts.repartition(FACTORS).mapInPandas(reduced, "r binary").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(x["r"], float).reshape(-1, width) for x in few]), mode="r")


def covariate_basis(table: DataFrame, names: list[str], key: str = "individual_id") -> DataFrame:
    """individual_id, q: the orthonormal basis of tall covariate columns; rows stay distributed.

    Singular values are those of the columns' upper factor, so the cut is the same as in ``orthonormal_basis``; a second
    factor, of the turned columns, makes them orthonormal to the last digits.
    """
    _, values, vectors = np.linalg.svd(_upper_factor(table, names), full_matrices=False)
    keep = values >= values[0] * RANK_CUT if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    turned = _turned(table, key, names, vectors[keep].T / values[keep])
    columns = [f"q{k}" for k in range(int(keep.sum()))]
    again = np.linalg.inv(_upper_factor(turned, columns)) if columns else np.zeros((0, 0))
    return _turned(turned, key, columns, again).select(key, F.array(*columns).cast("array<double>").alias("q"))


def _turned(table: DataFrame, key: str, names: list[str], turn: np.ndarray) -> DataFrame:
    """``key`` and q0, q1, ...: the columns times ``turn``."""
    product = lambda w: sum((F.col(f"`{n}`") * F.lit(float(x)) for n, x in zip(names, w, strict=True)), F.lit(0.0))
    return table.select(key, *[product(turn[:, k]).alias(f"q{k}") for k in range(turn.shape[1])])
