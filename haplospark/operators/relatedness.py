"""Products with the standardised genotype matrix of model variants, projected off the covariates.

``variants``: mutation_id, chrom, mean, norm_scale, x_norm2 (and what tests need), a DataFrame; only flags and scales of
model variants enter the traversals.  Vectors over individuals live on the driver (n x k), those over variants stay
in Spark: a product with the relatedness matrix goes up, is scaled, and comes down again within one job, in which every
column is its own task where the graph fits a worker.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.graph import GraphDataset
from haplospark.operators.qc import is_model_variant, project
from haplospark.operators.traverse import down, to_array, to_vectors, up
from haplospark.plans.strategy import Strategy, choose, vectors_at_once


@dataclass(frozen=True, eq=False)
class InTask:
    """The same products of single vectors (1 x n) within a task; ``sent``: the graph's arrays, (chrom, mean, scale) by mutation, and the basis."""

    sent: Broadcast
    totals: dict[int, int]
    num_model: int

    def project(self, v: np.ndarray) -> np.ndarray:
        basis = self.sent.value[-1]
        return v - (v @ basis) @ basis.T

    def scores(self, v: np.ndarray, skip: int | None = None) -> np.ndarray:
        structure, chrom, mean, scale, _ = self.sent.value
        score = structure.select(structure.nodes_up(v[:, structure.individual_of()]), structure.mut)
        return (score - v.sum() * mean) * (scale if skip is None else scale * (chrom != skip))

    def combine(self, weights: np.ndarray) -> np.ndarray:
        structure, _, mean, scale, _ = self.sent.value
        w = weights * scale
        return self.project(structure.down(w, by_individual=True) - w @ mean)

    def column(self, mutation: int) -> np.ndarray:
        one = np.zeros((1, self.sent.value[0].num_mutations))
        one[0, mutation] = 1.0
        return self.combine(one)

    def apply(self, v: np.ndarray, skip: int | None = None) -> np.ndarray:
        active = self.num_model - self.totals.get(skip, 0)
        return self.combine(self.scores(self.project(v), skip)) / active if active > 0 else np.zeros_like(v)


@dataclass(eq=False)
class Relatedness:
    graph: GraphDataset
    variants: DataFrame
    basis: np.ndarray
    strategy: Strategy | None = None

    def __post_init__(self) -> None:
        if self.basis.shape[0] != self.graph.meta.num_individuals:
            raise ValueError("the covariate basis does not have one row for each individual")

    @cached_property
    def model(self) -> DataFrame:
        return self.variants.where(is_model_variant())

    @cached_property
    def _totals(self) -> dict[int, tuple[int, float]]:
        return {r["chrom"]: (r["n"], r["x"]) for r in self.model.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("x_norm2").alias("x")).collect()}

    @property
    def chromosomes(self) -> list[int]:
        return sorted(self._totals)

    @property
    def num_model(self) -> int:
        return sum(n for n, _ in self._totals.values())

    @property
    def x_norm2_sum(self) -> float:
        return float(sum(x for _, x in self._totals.values()))

    @property
    def n(self) -> int:
        return self.graph.meta.num_individuals

    @property
    def dim(self) -> int:
        return self.n - self.basis.shape[1]

    def project(self, v: np.ndarray) -> np.ndarray:
        return project(self.basis, v)

    @property
    def _spark(self):
        return self.graph.nodes.sparkSession

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chrom, mean, scale) by mutation, 0 for those outside the model; for graphs that fit a worker."""
        m = self.graph.meta.num_mutations
        chrom, mean, scale = np.full(m, -1), np.zeros(m), np.zeros(m)
        p = self.model.select("mutation_id", "chrom", "mean", "norm_scale").toArrow()
        at = p["mutation_id"].to_numpy()
        chrom[at], mean[at], scale[at] = (p[c].to_numpy() for c in ("chrom", "mean", "norm_scale"))
        return chrom, mean, scale

    @cached_property
    def _sent(self):
        return self._spark.sparkContext.broadcast((self.graph.structure, *self._flat))

    @property
    def in_tasks(self) -> bool:
        """Whether a task can hold the graph and a vector."""
        return (self.strategy or choose(self.graph.meta, selector_entries=self.graph.selector_entries)) is Strategy.KERNEL

    @cached_property
    def task(self) -> InTask:
        sent = self._spark.sparkContext.broadcast((self.graph.structure, *self._flat, self.basis))
        return InTask(sent, {c: n for c, (n, _) in self._totals.items()}, self.num_model)

    def scores(self, vectors: np.ndarray) -> DataFrame:
        """row, mutation_id, score of every model variant: scale x (xᵀPv - mean x sum of Pv)."""
        v = self.project(np.asarray(vectors, float).reshape(self.n, -1))
        total = self._spark.createDataFrame([(k, float(s)) for k, s in enumerate(v.sum(axis=0))], "row int, total double")
        raw = up(self.graph, to_vectors(self._spark, np.ascontiguousarray(v.T)), by_individual=True, strategy=self.strategy)
        joined = raw.join(self.model.select(F.col("mutation_id").alias("id"), "mean", "norm_scale"), "id").join(F.broadcast(total), "row")
        return joined.select("row", F.col("id").alias("mutation_id"), (F.col("norm_scale") * (F.col("value") - F.col("mean") * F.col("total"))).alias("score"))

    def score_squares(self, vectors: np.ndarray) -> np.ndarray:
        """Sum over the model variants of squared scores, for each column."""
        k = np.asarray(vectors).reshape(self.n, -1).shape[1]
        got = {r["row"]: r["s"] for r in self.scores(vectors).groupBy("row").agg(F.sum(F.col("score") * F.col("score")).alias("s")).collect()}
        return np.array([got.get(j, 0.0) for j in range(k)])

    def combine(self, weights: DataFrame, k: int) -> np.ndarray:
        """n x k: the projected sum over model variants of weight x standardised column; ``weights(row, mutation_id, weight)``."""
        own = weights.join(self.model.select("mutation_id", "mean", "norm_scale"), "mutation_id").withColumn("w", F.col("weight") * F.col("norm_scale"))
        shift = np.zeros(k)
        for r in own.groupBy("row").agg(F.sum(F.col("w") * F.col("mean")).alias("s")).collect():
            shift[r["row"]] = r["s"]
        raw = down(self.graph, own.select("row", F.col("mutation_id").alias("id"), F.col("w").alias("value")), by_individual=True, strategy=self.strategy)
        return self.project(to_array(raw, k, self.n).T - shift)

    def columns(self, mutations: Sequence[int]) -> np.ndarray:
        """n x k: the projected standardised columns of single variants."""
        pairs = self._spark.createDataFrame([(k, int(m), 1.0) for k, m in enumerate(mutations)], "row int, mutation_id bigint, weight double")
        return self.combine(pairs, len(mutations))

    def apply(self, vectors: np.ndarray, without: Sequence[int | None] | None = None) -> np.ndarray:
        """Relatedness times each column, leaving out (for column j) the variants of chromosome ``without[j]``."""
        v = self.project(np.asarray(vectors, float).reshape(self.n, -1))
        k = v.shape[1]
        left = list(without) if without is not None else [None] * k
        active = np.array([self.num_model - (self._totals.get(c, (0, 0))[0] if c is not None else 0) for c in left], float)
        if self.in_tasks:
            raw = self._apply_in_tasks(v, left)
        else:
            skip = self._spark.createDataFrame([(j, c) for j, c in enumerate(left)], "row int, skip int")
            seen = self.scores(v).join(self.model.select("mutation_id", "chrom"), "mutation_id").join(F.broadcast(skip), "row").where("skip is null or chrom <> skip")
            raw = self.combine(seen.select("row", "mutation_id", F.col("score").alias("weight")), k)
        return np.where(active > 0, self.project(raw) / np.maximum(active, 1), 0.0)

    def _apply_in_tasks(self, v: np.ndarray, left: list[int | None]) -> np.ndarray:
        sent, k = self._sent, v.shape[1]
        most = vectors_at_once(self.graph.meta, selector_entries=self.graph.selector_entries)
        skip = [-2 if c is None else int(c) for c in left]

        def run(frames):
            structure, chrom, mean, scale = sent.value
            for f in (whole.iloc[j : j + most] for whole in frames for j in range(0, len(whole), most)):
                x = np.stack([np.frombuffer(b, float) for b in f["v"]])
                use = scale * (chrom[None, :] != f["skip"].to_numpy()[:, None])
                score, _ = structure.up(x, by_individual=True)
                w = (score - x.sum(axis=1)[:, None] * mean) * use * use
                back = structure.down(w, by_individual=True) - (w @ mean)[:, None]
                yield pd.DataFrame({"row": f["row"], "v": [b.tobytes() for b in back]})

        rows = [(j, skip[j], np.ascontiguousarray(v[:, j]).tobytes()) for j in range(k)]
        spread = self._spark.createDataFrame(rows, "row int, skip int, v binary").repartition(min(k, self._spark.sparkContext.defaultParallelism), "row")
        out = np.zeros((self.n, k))
        for r in spread.mapInPandas(run, "row int, v binary").collect():  # k vectors over individuals
            out[:, r["row"]] = np.frombuffer(r["v"], float)
        return out


