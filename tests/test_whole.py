"""Queries over all mutations, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

from haplospark import fixture, queries

SF = "/root/testdata/sf0.001"


def dosages(spark):
    """(mutation, individual) -> copies, by walking down from every mutation's nodes."""
    samples = fixture.PLOIDY * fixture.read(spark, SF, "customer").count()
    below = {}
    for r in fixture.edge_table(spark, SF, samples).collect():
        below.setdefault(r["parent"], []).append(r["child"])
    out = Counter()
    for r in fixture.mutation_table(spark, SF, samples).where("node_id is not null").collect():
        at = [r["node_id"]]
        while at:
            node = at.pop()
            if node < samples:
                out[r["mutation_id"], node // fixture.PLOIDY] += 1
            at += below.get(node, [])
    return out


def test_dosages_of_all_mutations(spark):
    rows = queries.QUERIES["explicit_dosages"](spark, SF).collect()
    assert len(rows) == len({(r["variant_id"], r["individual_id"]) for r in rows})
    assert {(r["variant_id"], r["individual_id"]): r["dosage"] for r in rows} == dosages(spark)


def test_models_of_all_mutations(spark):
    """The relatedness of the model covers every mutation that has a dosage."""
    table = queries._model(spark, SF).variants
    assert {r["mutation_id"] for r in table.select("mutation_id").collect()} == {m for m, _ in dosages(spark)}


def test_tasks_share_a_matrix(spark, monkeypatch):
    """All pairs of a small file of variants are made by many tasks, and stay there for a basis that a task can hold."""
    from haplospark.operators import qc

    seen = []
    monkeypatch.setattr(qc, "snp_stats", lambda calls, n, f=qc.snp_stats: (seen.append(calls), f(calls, n))[1])
    assert queries.projected_norms_of_close_covariates(spark, SF).count() == 200
    assert seen[0].rdd.getNumPartitions() >= 16
    people = spark.range(50).select(F.col("id").alias("individual_id"), F.array(F.lit(50**-0.5)).alias("q"))
    norms = qc.projected_norms(seen[0], people, qc.snp_stats(seen[0], 50))
    assert "BroadcastHashJoin [individual_id" in norms._jdf.queryExecution().toString()
