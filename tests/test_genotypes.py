"""Matrices written out and sums of squares, without a walk for each mutation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospark.operators import frequency, genotypes
from haplospark.operators.graph import compile_graph

SAMPLES, INNER = 40, 12


def made(spark, mutations: int, coalescence: bool, seed: int = 5):
    """(graph, individuals x mutations) of a random graph with several paths, mutations of no, one and several nodes, and one node twice."""
    r = np.random.default_rng(seed)
    edges, reach = [], np.vstack([np.eye(SAMPLES), np.zeros((INNER, SAMPLES))])
    for k in range(INNER):
        below = sorted(set(r.choice(SAMPLES + k, 6, replace=False).tolist()))
        edges += [(SAMPLES + k, c) for c in below]
        reach[SAMPLES + k] = reach[below].sum(axis=0)
    rows, x = [], np.zeros((SAMPLES, mutations))
    for m in range(mutations):
        at = r.integers(0, SAMPLES + INNER, m % 4).tolist() if m % 9 else [SAMPLES, SAMPLES]
        rows += [(m, int(n), None) for n in at] or [(m, None, None)]
        x[:, m] = sum((reach[n] for n in at), np.zeros(SAMPLES))
    rows = spark.createDataFrame(rows, "mutation_id bigint, node_id bigint, miss_node_id bigint")
    by_person = x.reshape(-1, 2, mutations).sum(axis=1)
    # Counts are taken as they are given, so only mutations of one node would need true ones.
    counts = spark.range(SAMPLES + INNER).select(F.col("id").alias("node_id"), F.lit(0).alias("coal_count")) if coalescence else None
    return compile_graph(spark.createDataFrame(edges, "parent bigint, child bigint"), rows, SAMPLES, SAMPLES + INNER, 2, counts), by_person


def test_sums_of_squares(spark, monkeypatch):
    graph, x = made(spark, 300, coalescence=False)
    monkeypatch.setattr(frequency, "dosages", lambda *a: pytest.fail("the matrix was written out"))
    monkeypatch.setattr(genotypes, "BLOCK", 3)
    monkeypatch.setattr(genotypes, "PEOPLE", 7)
    monkeypatch.setattr(genotypes, "PAIRS", 50)
    got = {r["variant_id"]: (r["sum"], r["sumsq"]) for r in frequency.dosage_sums(graph).collect()}
    assert got == {m: (int(x[:, m].sum()), int((x[:, m] ** 2).sum())) for m in range(300) if x[:, m].any()}


def test_mutations_of_many_nodes(spark, monkeypatch):
    graph, x = made(spark, 60, coalescence=False)
    monkeypatch.setattr(frequency, "PAIRED", 2)
    got = {r["variant_id"]: r["sumsq"] for r in frequency.dosage_sums(graph).collect()}
    assert got == {m: int((x[:, m] ** 2).sum()) for m in range(60) if x[:, m].any()}


def test_dosages_walk_from_each_node_once(spark, monkeypatch):
    graph, x = made(spark, 300, coalescence=False)
    for name, value in {"LISTED": 3, "SHARING": 4, "TASK_ENTRIES": 500}.items():
        monkeypatch.setattr(genotypes, name, value)
    seeds, walk = [], genotypes._walk
    monkeypatch.setattr(genotypes, "_walk", lambda g, pairs: (seeds.append(pairs.count()), walk(g, pairs))[1])
    rows = genotypes.dosages(graph).collect()
    assert len(rows) == np.count_nonzero(x)
    assert all(x[r["individual_id"], r["variant_id"]] == r["dosage"] for r in rows)
    assert max(seeds) <= SAMPLES + INNER
