"""Queries over sources, sinks and text formats: each writes files into the shared folder from the star-schema tables, and reads them back.

They are kept in ``queries.QUERIES`` and ``queries.SQL`` like all others.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark import fixture
from haplospark.checkpoints import shared_dir, stored
from haplospark.functions.statistics import g6, g17, p_value_text, register
from haplospark.functions.tables import register_traversal
from haplospark.operators import compare, mixed_model, pca, qc
from haplospark.operators.many import traverse_many
from haplospark.operators.relatedness import Relatedness
from haplospark.operators.traverse import Requirements, Spec, prepare, traverse
from haplospark.queries import _CALLS, _GRAPH, _PANEL, _ROWS, _SAMPLES, _SAMPLES3, _bim, _calls, _model, _phenotype, _samples, _up_sql, _whole, query
from haplospark.schema import Direction
from haplospark.sources import plink, store, tables
from haplospark.streaming.operands import write_stream


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


# --- PLINK files ----------------------------------------------------------------------------------------------------

_BIM_ROWS = """
WITH b AS (
  SELECT CAST(19 + p_partkey % 4 AS INTEGER) AS chrom, 'rs' || CAST(p_partkey AS VARCHAR) AS snp_id, '0.5' AS genetic_pos, CAST(1000 * p_size + p_partkey % 40 AS BIGINT) AS bp,
         substr(CASE WHEN p_partkey % 11 = 0 THEN 'CGTA' ELSE 'ACGT' END, CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS allele1,
         substr(CASE WHEN p_partkey % 11 = 0 THEN 'ACGT' ELSE 'CGTA' END, CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS allele0, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row
  FROM part WHERE p_partkey % 5 <> 0)"""


def _bim_file(spark: SparkSession, sf_dir: str) -> str:
    path = _place(spark, "variants.bim")
    plink.write_bim(_bim(spark, sf_dir).withColumn("genetic_pos", F.lit("0.5")), path)
    return path


@query(f"{_BIM_ROWS} SELECT * FROM b")
def bim_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants written as BIM and read back, in order."""
    return plink.read_bim(spark, _bim_file(spark, sf_dir))


@query(f"{_BIM_ROWS} SELECT * FROM b WHERE row IN (0, 1, 2, 7, 50, 51)")
def bim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a BIM file by their places (the feature is the list of places)."""
    return plink.select_rows(plink.read_bim(spark, _bim_file(spark, sf_dir)), [0, 1, 2, 7, 50, 51])


@query("SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS fid, 'i' || CAST(c_custkey AS VARCHAR) AS iid, 'f' || CAST(c_nationkey AS VARCHAR) || ' i' || CAST(c_custkey AS VARCHAR) || ' 0 0 ' || CAST(c_custkey % 2 + 1 AS VARCHAR) || ' -9' AS raw, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row FROM customer")
def fam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as FAM and read back, in order."""
    people, path = _people(spark, sf_dir), _place(spark, "people.fam")
    plink.write_fam(people.withColumn("raw", F.concat_ws(" ", "fid", "iid", F.lit("0 0"), "sex", F.lit("-9"))).withColumn("row", F.col("key")), path)
    return plink.read_fam(spark, path)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return fixture.read(spark, sf_dir, "customer").select(
        key.alias("key"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("fid"), F.concat(F.lit("i"), key.cast("string")).alias("iid"), (key % 2 + 1).cast("string").alias("sex"),
        F.col("c_acctbal").alias("pheno"), "c_mktsegment",
    )


def _bed_file(spark: SparkSession, sf_dir: str) -> tuple[str, int, int]:
    """(path, individuals, variants) of a BED file of the calls."""
    n, m, path = fixture.read(spark, sf_dir, "supplier").count(), fixture.read(spark, sf_dir, "part").count(), _place(spark, "calls.bed")
    plink.write_bed(_calls(spark, sf_dir), path, n, m)
    return path, n, m


@query(f"{_CALLS} SELECT v AS variant_id, CAST(i AS BIGINT) AS individual_id, g AS dosage FROM calls WHERE g IS NULL OR g <> 0")
def bed_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls packed to a BED file and unpacked again."""
    return plink.bed_genotypes(spark, *_bed_file(spark, sf_dir))


@query(f"{_CALLS} SELECT p_partkey AS variant_id, CAST(coalesce(sm, 0) AS BIGINT) AS sum, CAST(coalesce(sq, 0) AS BIGINT) AS sumsq, CAST(coalesce(missing, 0) AS BIGINT) AS missing FROM part LEFT JOIN s ON s.v = p_partkey")
def bed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums straight from the packed bytes."""
    return plink.bed_stats(spark, *_bed_file(spark, sf_dir))


@query(f"{_CALLS} SELECT p_partkey AS variant_id, CAST((SELECT count(*) FROM calls WHERE calls.v = p_partkey AND g IS NULL) AS BIGINT) AS missing, CAST((SELECT count(*) FROM supplier) AS BIGINT) AS individuals FROM part")
def bed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of dosages, null where a call is missing."""
    path, n, m = _bed_file(spark, sf_dir)
    return plink.read_bed(spark, path, n, m).select("variant_id", F.size(F.filter("dosages", lambda d: d.isNull())).cast("bigint").alias("missing"), F.size("dosages").cast("bigint").alias("individuals"))


@query(f"{_CALLS}, t AS (SELECT unnest([0, 1, 2, 5, 6, 40]) AS p, unnest([0, 1, 2, 3, 4, 5]) AS k) SELECT CAST(k AS BIGINT) AS variant_id, CAST(i AS BIGINT) AS individual_id, g AS dosage FROM calls JOIN t ON t.p = calls.v WHERE g IS NULL OR g <> 0")
def bed_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given variants (the feature) copied to a BED file of their own."""
    path, n, m = _bed_file(spark, sf_dir)
    target, rows = _place(spark, "subset.bed"), [0, 1, 2, 5, 6, 40]
    plink.write_bed_subset(path, target, n, m, rows)
    return plink.bed_genotypes(spark, target, n, len(rows))


# --- sample tables --------------------------------------------------------------------------------------------------


@query("SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS fid, 'i' || CAST(c_custkey AS VARCHAR) AS iid, c_acctbal / 7 AS pheno FROM customer")
def phenotype_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phenotype written with 17 digits, read back and joined to the samples."""
    people, path = _people(spark, sf_dir), _place(spark, "pheno.txt")
    tables.write_phenotype(people.withColumn("pheno", F.col("pheno") / 7), path)
    return tables.read_phenotype(spark, path, people.select("fid", "iid"))


@query("SELECT c_custkey AS id, printf('%.6g', c_acctbal / 7) AS six, printf('%.17g', c_acctbal / 7) AS seventeen FROM customer")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six and seventeen significant digits, as C writes them."""
    x = F.col("pheno") / 7
    return _people(spark, sf_dir).select(F.col("key").alias("id"), g6(x).alias("six"), g17(x).alias("seventeen"))


@query("SELECT p_partkey AS id, printf('%.1E', p_retailprice / power(10, p_partkey % 200 + 3)) AS text FROM part")
def p_value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of p-values down to 1e-200."""
    p = F.col("p_retailprice") / F.pow(F.lit(10.0), F.col("p_partkey") % 200 + 3)
    return fixture.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), p_value_text(p, F.lit(1.0)).alias("text"))


@query("SELECT c_custkey AS id, printf('%.6g', c_acctbal / 7) AS six, printf('%.1E', abs(c_acctbal) / 1.0E7 + 1.0E-9) AS p FROM customer")
def texts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text formats as functions of SQL."""
    register(spark)
    _people(spark, sf_dir).createOrReplaceTempView("people_of_texts")
    return spark.sql("SELECT key AS id, g6(pheno / 7) AS six, p_value_text(abs(pheno) / 1.0E7 + 1.0E-9, 1.0E0) AS p FROM people_of_texts")


_COVARIATES = """
WITH p AS (SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS fid, 'i' || CAST(c_custkey AS VARCHAR) AS iid, c_custkey % 2 + 1 AS sex, c_acctbal / 3 AS pc1, c_acctbal / 11 AS pc2 FROM customer)"""


def _covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "covariates.txt")
    tables.write_covariates(_people(spark, sf_dir).withColumns({"PC1": F.col("pheno") / 3, "PC2": F.col("pheno") / 11}), path, 2)
    return tables.read_samples_table(spark, path, ["PC1", "PC2", "SEX"])


@query(f"{_COVARIATES} SELECT fid, iid, printf('%.17g', pc1) AS PC1, printf('%.17g', pc2) AS PC2, CAST(sex AS VARCHAR) AS SEX FROM p")
def covariate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covariates(spark, sf_dir)


@query(f"""{_COVARIATES}, c AS (
  SELECT iid, 'SEX=1' AS name, CASE WHEN sex = 1 THEN 1.0E0 ELSE 0.0E0 END AS value FROM p UNION ALL SELECT iid, 'SEX=2', CASE WHEN sex = 2 THEN 1.0E0 ELSE 0.0E0 END FROM p
  UNION ALL SELECT iid, 'q:PC1', pc1 FROM p UNION ALL SELECT iid, 'constant', 1.0E0 FROM p)
SELECT iid, name, round(value, 6) AS value FROM c""")
def covariate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each level of a categorical covariate, quantitative ones as they are, and the constant; a row each."""
    wide, names = qc.covariate_columns(_covariates(spark, sf_dir), ["SEX"], ["PC1"], missing=("NA",))  # a balance of -27 makes a component of -9
    return wide.select("iid", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(f"`{n}`"), 6).alias("value")) for n in names])).alias("c")).select("iid", "c.name", "c.value")


@query("SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS fid, 'i' || CAST(c_custkey AS VARCHAR) AS iid, c_mktsegment AS segment FROM customer")
def sample_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its row of a table that has others as well."""
    people, key = _people(spark, sf_dir), F.col("s_suppkey").cast("string")
    others = fixture.read(spark, sf_dir, "supplier").select(F.lit("s").alias("fid"), key.alias("iid"), F.lit("none").alias("segment"))
    return qc.join_samples(people.select("fid", "iid"), people.select("fid", "iid", F.col("c_mktsegment").alias("segment")).unionByName(others), ["segment"])


# --- variant tables -------------------------------------------------------------------------------------------------

_MANIFEST = """
SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS global_idx, CAST(19 + p_partkey % 4 AS INTEGER) AS chrom, p_partkey AS local_grg_idx, p_partkey AS bed_row, 'rs' || CAST(p_partkey AS VARCHAR) AS snp_id,
       CAST(p_size AS BIGINT) AS bp, 'A' AS allele1, 'C' AS allele0, CAST(0 AS BIGINT) AS missing, p_retailprice / 7 AS mean, p_retailprice AS mean_center_norm2, p_retailprice / 3 AS proj_norm2, 0.5E0 AS norm_scale, p_retailprice / 12 AS x_norm2, 0.25E0 AS a1freq
FROM part"""


@query(_MANIFEST)
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant manifest written and read back."""
    p, price, path = F.col("p_partkey"), F.col("p_retailprice"), _place(spark, "manifest.tsv")
    rows = fixture.read(spark, sf_dir, "part").select(
        p.alias("local_grg_idx"), p.alias("bed_row"), (19 + p % 4).cast("int").alias("chrom"), F.concat(F.lit("rs"), p.cast("string")).alias("snp_id"), F.col("p_size").cast("bigint").alias("bp"),
        F.lit("A").alias("allele1"), F.lit("C").alias("allele0"), F.lit(0).cast("bigint").alias("missing"), (price / 7).alias("mean"), price.alias("mean_center_norm2"), (price / 3).alias("proj_norm2"),
        F.lit(0.5).alias("norm_scale"), (price / 12).alias("x_norm2"), F.lit(0.25).alias("a1freq"),
    )
    tables.write_manifest(qc.numbered(rows, ["bed_row"], "global_idx"), path)
    return tables.read_manifest(spark, path)


_STATISTICS = """
WITH r AS (
  SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row, p_partkey AS k, p_size, p_partkey % 7 <> 0 AS ok, p_retailprice / 1.0E5 AS x FROM part)"""
_STAT_COLUMNS = """row, 'rs' || CAST(k AS VARCHAR) AS SNP, CAST(19 + k % 4 AS VARCHAR) AS CHR, CAST(p_size AS VARCHAR) AS BP, printf('%.6g', x) AS GENPOS, 'A' AS ALLELE1, 'C' AS ALLELE0,
  printf('%.6g', x / 3) AS A1FREQ, printf('%.6g', CAST(k % 5 AS DOUBLE) / 50.0E0) AS F_MISS, printf('%.6g', CASE WHEN ok THEN x * 9 ELSE -1.0E9 END) AS CHISQ_LINREG, printf('%.1E', CASE WHEN ok THEN x ELSE 1.0E0 END) AS P_LINREG,
  printf('%.6g', CASE WHEN ok THEN x - 1.0E-2 ELSE 0.0E0 END) AS BETA, CASE WHEN ok THEN printf('%.6g', x / 8) ELSE '-nan' END AS SE, printf('%.6g', CASE WHEN ok THEN x * 8 ELSE -1.0E9 END) AS CHISQ_BOLT_LMM_INF,
  printf('%.1E', CASE WHEN ok THEN x / 2 ELSE 1.0E0 END) AS P_BOLT_LMM_INF"""


def _statistics(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """Statistics of all parts as a file has them; every seventh takes no part in a test."""
    p, x = F.col("p_partkey"), F.col("p_retailprice") / 1e5
    ok = p % 7 != 0
    rows = fixture.read(spark, sf_dir, "part").select(
        p.alias("row"), F.concat(F.lit("rs"), p.cast("string")).alias("snp_id"), (19 + p % 4).alias("chrom"), F.col("p_size").alias("bp"), x.cast("string").alias("genetic_pos"), F.lit("A").alias("allele1"), F.lit("C").alias("allele0"),
        (x / 3).alias("a1freq"), (p % 5).alias("missing"), F.when(ok, x * 9).otherwise(-1e9).alias("chisq_linreg"), F.when(ok, x).otherwise(1.0).alias("p_linreg"), F.when(ok, x - 0.01 + shift).otherwise(0.0).alias("beta"),
        F.when(ok, x / 8).alias("se"), F.when(ok, x * 8).otherwise(-1e9).alias("chisq_lmm"), F.when(ok, x / 2).otherwise(1.0).alias("p_lmm"),
        *[F.when(ok, 1.0).otherwise(0.0).alias(c) for c in ("mean_center_norm2", "proj_norm2", "norm_scale", "x_norm2")],
    )
    path = _place(spark, "statistics.txt")
    tables.write_statistics(tables.statistics_table(rows, 50).withColumn("row", F.substring("SNP", 3, 20).cast("bigint")), path)
    return tables.read_statistics(spark, path)


@query(f"{_STATISTICS} SELECT {_STAT_COLUMNS} FROM r")
def statistics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of association statistics written and read back, as text."""
    return _statistics(spark, sf_dir)


@query("SELECT 'ok' AS status, CAST(count(*) AS BIGINT) AS reference_rows, CAST(count(*) AS BIGINT) AS actual_rows, true AS freq_passed, false AS beta_passed, false AS passed, CAST(count(*) FILTER (WHERE p_partkey % 7 <> 0) AS BIGINT) AS n_se FROM part")
def statistics_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of statistics compared, one with its effects shifted."""
    got = compare.compare_stats(_statistics(spark, sf_dir), _statistics(spark, sf_dir, 0.5), compare.Tolerances())
    row = (got["status"], got["reference_rows"], got["actual_rows"], got["A1FREQ"]["passed"], got["BETA"]["passed"], got["passed"], got["SE"]["n"])
    return spark.createDataFrame([row], "status string, reference_rows bigint, actual_rows bigint, freq_passed boolean, beta_passed boolean, passed boolean, n_se bigint")


# --- graph stores ---------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> str:
    return store.save(fixture.graph(spark, sf_dir), _place(spark, "star.graph"))


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def stored_graph_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A traversal of a graph that was saved and loaded."""
    g = store.load(spark, _store(spark, sf_dir))
    return _whole(traverse(g, _samples(g, 3), "up").values)


@query(f"""{_GRAPH}
SELECT k.s AS num_samples, CAST((SELECT count(*) FROM part) AS BIGINT) AS num_mutations, CAST((SELECT count(*) FROM ids) AS BIGINT) AS num_nodes, CAST((SELECT count(*) FROM edges) AS BIGINT) AS num_edges,
       CAST((SELECT max(level) FROM heights) AS INTEGER) AS height, CAST((SELECT count(*) FROM (SELECT DISTINCT a.level, b.level FROM edges e JOIN heights a ON a.node_id = e.parent JOIN heights b ON b.node_id = e.child) x) AS INTEGER) AS level_pairs
FROM k""")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store says of itself without an edge being read."""
    found = store.scan(spark, _store(spark, sf_dir))
    m = found.meta
    return spark.createDataFrame([(m.num_samples, m.num_mutations, m.num_nodes, m.num_edges, m.height, len(found.level_pairs))], "num_samples bigint, num_mutations bigint, num_nodes bigint, num_edges bigint, height int, level_pairs int")


@query(f"{_GRAPH} SELECT e.parent, e.child FROM edges e JOIN heights a ON a.node_id = e.parent JOIN heights b ON b.node_id = e.child WHERE a.level = 3 AND b.level = 1")
def store_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of one level pair (the feature), from its own files."""
    return store.block(spark, _store(spark, sf_dir), 3, 1).select("parent", "child")


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def converted_graph_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge and mutation tables converted to a store, loaded and traversed."""
    source, s = _place(spark, "source"), fixture.PLOIDY * fixture.read(spark, sf_dir, "customer").count()
    for name, df in {
        "shape": spark.createDataFrame([(s, s + fixture.ROOT + 1, fixture.PLOIDY)], "num_samples bigint, num_nodes bigint, ploidy int"), "edges": fixture.edge_table(spark, sf_dir, s),
        "mutation_rows": fixture.mutation_table(spark, sf_dir, s), "coalescence": fixture.coalescence_table(spark, sf_dir, s), "mutations": fixture.position_table(spark, sf_dir),
    }.items():
        df.write.parquet(f"{source}/{name}.parquet")
    g = store.load(spark, store.convert(spark, source, shared_dir(spark), uuid.uuid4().hex))
    return _whole(traverse(g, _samples(g, 3), "up").values)


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def ensured_graph_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is made because it is not there, and found the second time."""
    path = _place(spark, "star.graph")
    for _ in range(2):
        g = store.ensure(spark, path, lambda: fixture.graph(spark, sf_dir))
    return _whole(traverse(g, _samples(g, 3), "up").values)


@query(f"SELECT g AS graph_id, id, (1 + k) * value AS value FROM ({_up_sql(_SAMPLES)}) u CROSS JOIN (SELECT 'first' AS g, 0 AS k UNION ALL SELECT 'second', 1) x")
def stored_graphs_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores loaded in order, with an operand each."""
    graphs = dict(zip(("first", "second"), store.load_many(spark, [_store(spark, sf_dir), _store(spark, sf_dir)]), strict=True))
    x = {n: _samples(g).withColumn("value", (1 + k) * F.col("value")) for k, (n, g) in enumerate(graphs.items())}
    return traverse_many(graphs, x, "up").select("graph_id", "id", F.round("value").cast("bigint").alias("value"))


# --- other forms of a traversal -------------------------------------------------------------------------------------


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def up_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traversal as a table function of SQL."""
    g = fixture.graph(spark, sf_dir)
    register_traversal(spark, g, "graph_up", "up")
    _samples(g, 3).createOrReplaceTempView("graph_operand")
    return _whole(spark.sql("SELECT * FROM graph_up(TABLE(graph_operand) PARTITION BY row)"))


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def up_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A traversal checked once, with what it declares to need, then called."""
    g = fixture.graph(spark, sf_dir)
    return _whole(prepare(g, Spec(Direction.UP), requirements=Requirements(max_rows_up=3))(_samples(g, 3)).values)


@query(f"SELECT * FROM ({_up_sql(_SAMPLES3, rows=_ROWS)}) u WHERE value <> 0")
def up_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By levels, without zeros."""
    from haplospark.plans.strategy import Strategy

    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g, 3), "up", strategy=Strategy.LEVELS, sparse=True).values)


@query(f"SELECT vec AS key, id, value FROM ({_up_sql(_SAMPLES3, rows=_ROWS)}) u WHERE value <> 0")
def up_of_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that arrive as a stream, by the way for graphs of any size."""
    from haplospark.plans.strategy import Strategy

    g, source, target = fixture.graph(spark, sf_dir), _place(spark, "vectors"), _place(spark, "answers")
    dense = _samples(g, 3).groupBy(F.col("row").cast("bigint").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]).alias("values"))
    dense.write.parquet(source)
    write_stream(g, spark.readStream.schema("key bigint, values array<double>").parquet(source), "up", target, strategy=Strategy.LEVELS).awaitTermination()
    return spark.read.parquet(target).select(F.col("key").cast("int").alias("key"), "id", F.round("value").cast("bigint").alias("value"))


# --- linear algebra in closed form ----------------------------------------------------------------------------------

#: The one model variant of the panel: the least that has any spread.
_ONE = f"""{_PANEL},
one AS (SELECT min(v) AS v FROM ok),
z AS (SELECT c_custkey AS i, (coalesce(x.g, 0) - ok.mean) * ok.scale AS z FROM customer CROSS JOIN one JOIN ok ON ok.v = one.v LEFT JOIN x ON x.v = one.v AND x.i = c_custkey),
y AS (SELECT c_custkey AS i, c_acctbal - avg(c_acctbal) OVER () AS y FROM customer)"""


def _one_variant(spark: SparkSession, sf_dir: str) -> Relatedness:
    k = _model(spark, sf_dir)
    least = k.model.agg(F.min("mutation_id")).first()[0]
    return Relatedness(k.graph, stored(k.variants.where(F.col("mutation_id") == least), "variants"), k.basis)


def _by_person(spark: SparkSession, values: np.ndarray) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"id": np.arange(len(values)), "value": values})).select("id", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"""{_ONE},
c AS (SELECT sum(z * y) / (2.0E0 + sum(z * z)) AS c FROM z JOIN y ON y.i = z.i)
SELECT z.i AS id, round((y - z * c) / 2.0E0, 5) + 0.0 AS value FROM z JOIN y ON y.i = z.i CROSS JOIN c""")
def conjugate_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phenotype solved against one variant's relatedness plus twice the identity, which has a closed form."""
    from haplospark.operators.solvers import conjugate_gradients as solve

    k = _one_variant(spark, sf_dir)
    out = solve(lambda v: k.apply(v) + 2.0 * v, _phenotype(spark, sf_dir)[:, None], k.project, 1e-12, 50)
    return _by_person(spark, out[:, 0])


@query(f"""{_ONE},
w AS (SELECT i, z / sqrt(sum(z * z) OVER () / (count(*) OVER () - 1)) AS w FROM z),
l AS (SELECT max(w) AS hi, min(w) AS lo FROM w)
SELECT i AS id, round(CASE WHEN hi >= -lo THEN w ELSE -w END, 5) + 0.0 AS value FROM w CROSS JOIN l""")
def leading_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading component over people of one variant's relatedness: the variant itself, standardised."""
    return _by_person(spark, pca.sample_components(_one_variant(spark, sf_dir), 1)[:, 0])


@query(f"""{_ONE} SELECT name AS solver, round(sum(z * z), 4) AS eigenvalue, true AS converged FROM z CROSS JOIN (SELECT 'lanczos' AS name UNION ALL SELECT 'lobpcg' UNION ALL SELECT 'randomized') s GROUP BY name""")
def leading_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest eigenvalue of one variant's relatedness by each method, and whether its residual is small."""
    from haplospark.operators import solvers

    k, rows = _one_variant(spark, sf_dir), []
    for name, found in (("lanczos", solvers.lanczos(k.apply, k.n, 1, basis=4)), ("lobpcg", solvers.lobpcg(k.apply, k.n, 1)), ("randomized", solvers.randomized(k.apply, k.n, 1, oversample=3, power=2))):
        values, vectors = found
        rows.append((name, float(values[0]), bool((solvers.relative_residuals(k.apply, values, vectors) <= 1e-5).all())))
    return spark.createDataFrame(rows, "solver string, eigenvalue double, converged boolean").withColumn("eigenvalue", F.round("eigenvalue", 4))


@query("SELECT c_custkey AS id, round((c_acctbal - avg(c_acctbal) OVER ()) / 2.0E0, 5) + 0.0 AS value FROM customer")
def loco_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phenotype solved without the chromosome of the only variant: nothing but the noise is left."""
    import math

    k = _one_variant(spark, sf_dir)
    solved = mixed_model.loco_residuals(k, _phenotype(spark, sf_dir), mixed_model.Variances(math.log(2.0), 1.0, 0.5, np.ones(k.n)))
    return _by_person(spark, solved[k.chromosomes[0]])


@query(f"{_PANEL} SELECT chrom, CAST(count(*) AS BIGINT) AS n FROM ok GROUP BY chrom")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model variants of each chromosome, all of which need one."""
    return spark.createDataFrame(list(qc.require_model_counts(_model(spark, sf_dir).variants).items()), "chrom int, n bigint")


@query("""
WITH t AS (SELECT s_suppkey AS k, 1.0E0 + s_suppkey % 7 AS pro, 1.5E0 + s_suppkey % 5 AS retro FROM supplier),
s AS (SELECT sum(pro) AS p, sum(retro) AS r, count(*) * 1.0E0 AS n FROM t),
j AS (SELECT (p - pro) / (r - retro) AS q FROM t CROSS JOIN s),
d AS (SELECT sqrt(sum((q - m) * (q - m)) * (max(n) - 1) / max(n)) AS std FROM j CROSS JOIN (SELECT avg(q) AS m FROM j) a CROSS JOIN s)
SELECT round(CASE WHEN std > 0.01 THEN median(pro) / median(retro) ELSE max(p) / max(r) END, 9) AS factor, round(max(std), 9) AS std, round(median(pro) / median(retro), 9) AS ratio_of_medians, round(median(pro / retro), 9) AS median_of_ratios
FROM t CROSS JOIN s CROSS JOIN d GROUP BY std""")
def calibration_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration factor of a given table of statistics (a row for each supplier)."""
    k = fixture.read(spark, sf_dir, "supplier").select("s_suppkey").toPandas()["s_suppkey"].to_numpy()
    got = mixed_model.calibration_factor(1.0 + k % 7, 1.5 + k % 5)
    return spark.createDataFrame([tuple(round(float(x), 9) for x in got)], "factor double, std double, ratio_of_medians double, median_of_ratios double")


@query(f"""{_PANEL},
fit AS (SELECT 1.7E0 AS g, 1.3E0 AS v),
r AS (SELECT c_custkey AS i, (c_custkey % 13 - 6) - avg(c_custkey % 13 - 6) OVER () AS r FROM customer),
s AS (SELECT x.v, sum(x.g * r.r) AS s FROM x JOIN r ON r.i = x.i GROUP BY x.v)
SELECT st.v AS mutation_id, round(CASE WHEN st.c >= 0.1E0 THEN power(s / fit.g / fit.v, 2) / st.c ELSE -1.0E9 END, 6) AS chisq,
       round(CASE WHEN st.c >= 0.1E0 THEN s / fit.g / (st.c * fit.v * fit.v) ELSE 0.0E0 END, 6) + 0.0 AS beta, round(CASE WHEN st.c >= 0.1E0 THEN 1 / (sqrt(st.c) * fit.v) END, 6) AS se
FROM st CROSS JOIN fit JOIN s ON s.v = st.v""")
def lmm_assoc_given_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-model statistics of all mutations for given variances, scale and solved phenotype."""
    k = _model(spark, sf_dir)
    solved = k.project((np.arange(k.n) % 13 - 6).astype(float))

    class Given(mixed_model.Calibration):
        def scale(self, chrom: int) -> float:
            return 1.3

    given = Given(None, 0, dict.fromkeys(k.chromosomes, solved), k.dim, 1.7)
    out = mixed_model.association(k, _phenotype(spark, sf_dir), mixed_model.Variances(0.0, 1.7, 0.5, solved), given)
    return out.select("mutation_id", F.round("chisq_lmm", 6).alias("chisq"), (F.round("beta", 6) + F.lit(0.0)).alias("beta"), F.round("se", 6).alias("se"))
