"""Principal components of the standardised, imputed genotype matrix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.checkpoints import stored
from haplospark.operators import panels, solvers
from haplospark.operators.frequency import allele_frequencies, standardised_down, standardised_gram, standardised_up
from haplospark.operators.graph import GraphDataset
from haplospark.operators.relatedness import Relatedness
from haplospark.operators.traverse import to_array, to_vectors
from haplospark.plans.strategy import Strategy, choose, vectors_at_once

SOLVERS: dict[str, Callable] = {"randomized": solvers.randomized, "lanczos": solvers.lanczos, "lobpcg": solvers.lobpcg}
#: Up to so many columns a matrix is decomposed as it is.
DENSE_COLUMNS = 2000


@dataclass(frozen=True)
class Components:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray


def _broadcast(graph: GraphDataset, freqs: DataFrame):
    """The graph's arrays and (freq, center, sigma) by mutation; for graphs that fit a worker."""
    f, known = freqs.toArrow(), np.full((3, graph.meta.num_mutations), np.nan)
    known[:, f["mutation_id"].to_numpy()] = [f[c].to_numpy() for c in ("freq", "center", "sigma")]
    return graph.nodes.sparkSession.sparkContext.broadcast((graph.structure, *known))


def _operator(graph: GraphDataset, size: int, by_tables: Callable[[DataFrame, DataFrame], DataFrame], by_arrays: Callable[..., np.ndarray]) -> solvers.Apply:
    """v (size x k) -> the operator times v; one Spark job a call, every column a task where the graph fits a worker."""
    freqs, spark = stored(allele_frequencies(graph), "freqs"), graph.nodes.sparkSession
    if choose(graph.meta, selector_entries=graph.selector_entries) is not Strategy.KERNEL:
        return lambda v: to_array(by_tables(to_vectors(spark, np.ascontiguousarray(v.T)), freqs), v.shape[1], size).T
    sent = _broadcast(graph, freqs)
    most = vectors_at_once(graph.meta, selector_entries=graph.selector_entries)

    def run(frames):
        for part in (whole.iloc[j : j + most] for whole in frames for j in range(0, len(whole), most)):
            out = by_arrays(np.stack([np.frombuffer(b, float) for b in part["v"]]), *sent.value)
            yield pd.DataFrame({"row": part["row"], "v": [b.tobytes() for b in out]})

    def apply(v: np.ndarray) -> np.ndarray:
        k = v.shape[1]
        rows = spark.createDataFrame([(j, np.ascontiguousarray(v[:, j]).tobytes()) for j in range(k)], "row int, v binary").repartition(min(k, spark.sparkContext.defaultParallelism), "row")
        out = np.empty_like(v)
        for r in rows.mapInPandas(run, "row int, v binary").collect():
            out[:, r["row"]] = np.frombuffer(r["v"], float)
        return out

    return apply


def _down(w: np.ndarray, structure, freq: np.ndarray, center: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    w = w / sigma
    return structure.down(w, miss=freq * w, by_individual=True) - (w @ center)[:, None]


def _up(h: np.ndarray, structure, freq: np.ndarray, center: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    seen, missing = structure.up(h, by_individual=True)
    return (seen + freq * missing - h.sum(axis=1)[:, None] * center) / sigma


def gram_operator(graph: GraphDataset) -> solvers.Apply:
    """v (mutations x k) -> XᵀX v."""
    return _operator(graph, graph.meta.num_mutations, lambda v, f: standardised_gram(graph, v, f), lambda v, *known: _up(_down(v, *known), *known))


def people_operator(graph: GraphDataset) -> solvers.Apply:
    """u (individuals x k) -> XXᵀ u."""
    return _operator(graph, graph.meta.num_individuals, lambda u, f: standardised_down(graph, standardised_up(graph, u, f), f), lambda u, *known: _down(_up(u, *known), *known))


def components_by_people(graph: GraphDataset, k: int, solver: str = "randomized", **how) -> tuple[Components, DataFrame]:
    """Largest eigenpairs of XXᵀ over individuals, and the same of XᵀX over mutations as a table (row, id, value).

    Both have the same eigenvalues, so what the driver holds are vectors over individuals, however many mutations there are; of
    each, one traversal gives the vector over mutations, which stays a table.  Where the graph fits a worker, the randomized solver's block of
    vectors is a ``Panel``, and the driver holds the ``k`` results alone.
    """
    if solver not in SOLVERS:
        raise ValueError(f"solver must be one of {', '.join(SOLVERS)}, not {solver!r}")
    if solver == "randomized" and choose(graph.meta, selector_entries=graph.selector_entries) is Strategy.KERNEL:
        freqs = stored(allele_frequencies(graph), "freqs")
        sent = _broadcast(graph, freqs)
        values, found, residuals = panels.randomized(graph.nodes.sparkSession, lambda u: _down(_up(u, *sent.value), *sent.value), graph.meta.num_individuals, k, **how)
        scaled = found.vectors().join(F.broadcast(graph.nodes.sparkSession.createDataFrame([(j, float(v)) for j, v in enumerate(values)], "row int, at double")), "row")
        scaled = scaled.select("row", "id", (F.col("value") / F.sqrt(F.when(F.col("at") > 0, F.col("at")).otherwise(F.lit(1.0)))).alias("value"))
        return Components(values, found.array(), residuals), standardised_up(graph, scaled, freqs)
    apply = people_operator(graph)
    values, vectors = SOLVERS[solver](apply, graph.meta.num_individuals, k, **how)
    scaled = vectors / np.sqrt(np.where(values > 0, values, 1))
    by_mutation = standardised_up(graph, to_vectors(graph.nodes.sparkSession, np.ascontiguousarray(scaled.T)), stored(allele_frequencies(graph), "freqs"))
    return Components(values, vectors, solvers.relative_residuals(apply, values, vectors)), by_mutation


def principal_components(graph: GraphDataset, k: int, solver: str = "randomized", **how) -> Components:
    """Largest eigenpairs of XᵀX over mutations, with their relative residuals."""
    if solver not in SOLVERS:
        raise ValueError(f"solver must be one of {', '.join(SOLVERS)}, not {solver!r}")
    apply = gram_operator(graph)
    values, vectors = SOLVERS[solver](apply, graph.meta.num_mutations, k, **how)
    return Components(values, vectors, solvers.relative_residuals(apply, values, vectors))


def compare_solvers(graph: GraphDataset, k: int, tol: float = 1e-6) -> pd.DataFrame:
    """solver, status (ok, skipped, error, not finite), largest residual, angle to the first that went well, and whether both pass."""
    rows, first = [], None
    for name in SOLVERS:
        row = {"solver": name, "status": "ok", "residual": np.nan, "angle": np.nan, "passed": False}
        try:
            got = principal_components(graph, k, name)
            if not np.isfinite(got.vectors).all():
                row["status"] = "not finite"
            else:
                first = got if first is None else first
                row["residual"], row["angle"] = float(got.residuals.max()), solvers.largest_angle_sine(first.vectors, got.vectors)
                row["passed"] = solvers.passes(got.residuals, row["angle"], tol)
        except ValueError as e:
            row["status"] = f"skipped: {e}"
        except (RuntimeError, np.linalg.LinAlgError) as e:
            row["status"] = f"error: {e}"
        rows.append(row)
    return pd.DataFrame(rows)


def sample_components(k: Relatedness, count: int, solver: str = "lanczos") -> np.ndarray:
    """individuals x count, standardised: eigenvectors of the relatedness matrix, or of the model columns where they are few."""
    if k.num_model <= DENSE_COLUMNS:
        ids = [r[0] for r in k.model.orderBy("mutation_id").select("mutation_id").collect()]
        u, _, _ = np.linalg.svd(k.columns(ids), full_matrices=False)
        return solvers.standardised_components(u[:, :count])
    _, vectors = SOLVERS[solver](k.apply, k.n, count)
    return solvers.standardised_components(vectors)


def as_table(graph: GraphDataset, vectors: np.ndarray) -> DataFrame:
    """row (component), id, value."""
    return to_vectors(graph.nodes.sparkSession, np.ascontiguousarray(vectors.T))
