"""The engine's queries by name, each with the SQL that must agree with it.

All run on the graph that ``fixture`` derives from the star-schema tables, with whole-number operands, so that results are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark import fixture
from haplospark.checkpoints import stored
from haplospark.operators import compare, frequency, genotypes, mixed_model, pca, qc
from haplospark.operators.graph import GraphDataset
from haplospark.operators.many import traverse_many
from haplospark.operators.relatedness import Relatedness
from haplospark.operators.traverse import accumulate, traverse
from haplospark.plans import budget
from haplospark.plans.strategy import Strategy

#: Cells of a matrix that a task makes, and people that are broadcast.
TASK_CELLS, MAX_BROADCAST_PEOPLE = 100_000_000, 1_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- the graph in SQL -----------------------------------------------------------------------------------------------

#: s: number of samples; edges; reach: all pairs of a node and what hangs below it, one row for each path; mut, miss: selectors.
_GRAPH = """
WITH RECURSIVE
k AS (SELECT CAST(2 * count(*) AS BIGINT) AS s FROM customer),
seg AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS r FROM (SELECT DISTINCT c_mktsegment FROM customer) x),
edges AS (
  SELECT CAST(k.s + c_nationkey AS BIGINT) AS parent, CAST(2 * c_custkey AS BIGINT) AS child FROM customer CROSS JOIN k
  UNION ALL
  SELECT CAST(CASE WHEN c_custkey % 3 = 0 THEN k.s + c_nationkey ELSE k.s + 25 + seg.r END AS BIGINT), CAST(2 * c_custkey + 1 AS BIGINT)
  FROM customer CROSS JOIN k JOIN seg ON seg.c_mktsegment = customer.c_mktsegment
  UNION ALL SELECT CAST(k.s + 30 + n_regionkey AS BIGINT), CAST(k.s + n_nationkey AS BIGINT) FROM nation CROSS JOIN k
  UNION ALL SELECT k.s + 35, CAST(k.s + 30 + r_regionkey AS BIGINT) FROM region CROSS JOIN k
  UNION ALL SELECT k.s + 35, k.s + 25 + r FROM seg CROSS JOIN k),
ids AS (
  SELECT CAST(2 * c_custkey AS BIGINT) AS node FROM customer UNION ALL SELECT CAST(2 * c_custkey + 1 AS BIGINT) FROM customer
  UNION ALL SELECT CAST(k.s + n_nationkey AS BIGINT) FROM nation CROSS JOIN k UNION ALL SELECT k.s + 25 + r FROM seg CROSS JOIN k
  UNION ALL SELECT CAST(k.s + 30 + r_regionkey AS BIGINT) FROM region CROSS JOIN k UNION ALL SELECT k.s + 35 FROM k),
reach(top, bottom, steps) AS (
  SELECT node, node, 0 FROM ids
  UNION ALL SELECT e.parent, w.bottom, w.steps + 1 FROM edges e JOIN reach w ON e.child = w.top),
heights AS (SELECT top AS node_id, CAST(max(steps) AS INTEGER) AS level FROM reach GROUP BY top),
mut AS (
  SELECT p_partkey AS m, CAST(CASE WHEN p_partkey % 41 = 0 THEN p_partkey % k.s ELSE k.s + p_partkey % 36 END AS BIGINT) AS node FROM part CROSS JOIN k WHERE p_partkey % 97 <> 0
  UNION ALL SELECT p_partkey, CAST(k.s + (p_partkey + 1) % 25 AS BIGINT) FROM part CROSS JOIN k WHERE p_partkey % 53 = 0 AND p_partkey % 97 <> 0),
miss AS (SELECT p_partkey AS m, CAST(k.s + (p_partkey + 11) % 25 AS BIGINT) AS node FROM part CROSS JOIN k WHERE p_partkey % 7 = 0),
met AS (
  SELECT top AS node, CAST(floor(bottom / 2) AS BIGINT) AS ind FROM reach CROSS JOIN k WHERE bottom < k.s
  GROUP BY top, CAST(floor(bottom / 2) AS BIGINT) HAVING count(DISTINCT bottom) = 2),
coal AS (
  SELECT a.node, count(*) AS n FROM met a LEFT JOIN (SELECT e.parent, b.ind FROM met b JOIN edges e ON e.child = b.node) lower ON lower.parent = a.node AND lower.ind = a.ind
  WHERE lower.ind IS NULL GROUP BY a.node)"""

#: Operands: (SQL over k and a table of ids, the same as a column of the id and the row).
_ROWS = "(SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) rr"


def _up_sql(seed: str, pairs: str = "mut", rows: str = "(SELECT 0 AS r) rr", name: str = "value") -> str:
    """``seed``: SELECT r, node, v.  Result by mutation."""
    return f"""{_GRAPH},
seed AS ({seed}),
val AS (SELECT s.r, w.top AS node, sum(s.v) AS v FROM seed s JOIN reach w ON w.bottom = s.node GROUP BY s.r, w.top),
got AS (SELECT val.r, p.m, sum(val.v) AS v FROM val JOIN {pairs} p ON p.node = val.node GROUP BY val.r, p.m)
SELECT CAST(rr.r AS INTEGER) AS vec, part.p_partkey AS id, CAST(coalesce(got.v, 0) AS BIGINT) AS {name}
FROM part CROSS JOIN {rows} LEFT JOIN got ON got.r = rr.r AND got.m = part.p_partkey"""


def _down_sql(seed: str, by: str = "sample", rows: str = "(SELECT 0 AS r) rr") -> str:
    """``seed``: SELECT r, node, v.  Result by sample, individual or node."""
    at = {"sample": "w.bottom", "individual": "CAST(floor(w.bottom / 2) AS BIGINT)", "node": "w.bottom"}[by]
    ids = {"sample": "SELECT node AS i FROM ids CROSS JOIN k WHERE node < k.s", "individual": "SELECT c_custkey AS i FROM customer", "node": "SELECT node AS i FROM ids"}[by]
    only = "" if by == "node" else "CROSS JOIN k WHERE w.bottom < k.s"
    return f"""{_GRAPH},
seed AS ({seed}),
got AS (SELECT s.r, {at} AS i, sum(s.v) AS v FROM seed s JOIN reach w ON w.top = s.node {only} GROUP BY s.r, {at})
SELECT CAST(rr.r AS INTEGER) AS vec, CAST(d.i AS BIGINT) AS id, CAST(coalesce(got.v, 0) AS BIGINT) AS value
FROM ({ids}) d CROSS JOIN {rows} LEFT JOIN got ON got.r = rr.r AND got.i = d.i"""


def _all_nodes_up_sql(seed: str) -> str:
    return f"""{_GRAPH},
seed AS ({seed}),
got AS (SELECT s.r, w.top AS node, sum(s.v) AS v FROM seed s JOIN reach w ON w.bottom = s.node GROUP BY s.r, w.top)
SELECT 0 AS vec, ids.node AS id, CAST(coalesce(got.v, 0) AS BIGINT) AS value FROM ids LEFT JOIN got ON got.node = ids.node"""


_SAMPLES = "SELECT 0 AS r, node, node % 11 - 5 AS v FROM ids CROSS JOIN k WHERE node < k.s"
_SAMPLES3 = f"SELECT r, node, (node * (r + 1)) % 11 - 5 AS v FROM ids CROSS JOIN k CROSS JOIN {_ROWS} WHERE node < k.s"
_PEOPLE = "SELECT 0 AS r, node, CAST(floor(node / 2) AS BIGINT) % 11 - 5 AS v FROM ids CROSS JOIN k WHERE node < k.s"
_ONES = "SELECT 0 AS r, node, 1 AS v FROM ids CROSS JOIN k WHERE node < k.s"
_PARTS = "SELECT 0 AS r, node, m % 7 - 3 AS v FROM mut"
_PARTS3 = f"SELECT r, node, (m * (r + 1)) % 7 - 3 AS v FROM mut CROSS JOIN {_ROWS}"
_INIT = "SELECT 0 AS r, node, 3 AS v FROM ids"
_MATRIX = "SELECT 0 AS r, node, node % 5 - 2 AS v FROM ids"
_XTX = "SELECT 0 AS r, node, 2 * n AS v FROM coal"


def _operand(ids: DataFrame, value: Callable[[Column, Column], Column], rows: int = 1) -> DataFrame:
    row = F.explode(F.array(*[F.lit(r) for r in range(rows)])) if rows > 1 else F.lit(0)
    return ids.select(row.alias("row"), F.col(ids.columns[0]).alias("id")).withColumn("value", value(F.col("id"), F.col("row")).cast("double"))


def _samples(g: GraphDataset, rows: int = 1) -> DataFrame:
    return _operand(g.samples.select("sample_id"), lambda i, r: (i * (r + 1)) % 11 - 5, rows)


def _people(g: GraphDataset) -> DataFrame:
    return _operand(g.samples.select("individual_id").distinct(), lambda i, r: i % 11 - 5)


def _parts(g: GraphDataset, rows: int = 1) -> DataFrame:
    return _operand(g.mutation_ids, lambda i, r: (i * (r + 1)) % 7 - 3, rows)


def _whole(result: DataFrame) -> DataFrame:
    return result.select(F.col("row").cast("int").alias("vec"), "id", F.round("value").cast("bigint").alias("value"))


def _init(g: GraphDataset) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(0, -1, 3.0)], "row int, id bigint, value double")


# --- compilation ----------------------------------------------------------------------------------------------------


@query(f"{_GRAPH} SELECT node_id, level FROM heights")
def node_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).nodes.select("node_id", "level")


@query(f"{_GRAPH} SELECT node_id, level, CAST(row_number() OVER (ORDER BY level, node_id) - 1 AS BIGINT) AS pos FROM heights")
def height_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).nodes.select("node_id", "level", "pos")


@query(f"""{_GRAPH},
sizes AS (SELECT level, count(*) AS n FROM heights GROUP BY level),
nnz AS (SELECT a.level AS d, b.level AS s, count(*) AS n FROM edges e JOIN heights a ON a.node_id = e.parent JOIN heights b ON b.node_id = e.child GROUP BY a.level, b.level)
SELECT d.level AS dst_level, s.level AS src_level, CAST(d.n AS BIGINT) AS nrows, CAST(s.n AS BIGINT) AS ncols, CAST(coalesce(nnz.n, 0) AS BIGINT) AS nnz
FROM sizes d JOIN sizes s ON s.level < d.level LEFT JOIN nnz ON nnz.d = d.level AND nnz.s = s.level""")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).block_stats


@query(f"""{_GRAPH}
SELECT h.level AS level, CAST(count(mut.m) AS BIGINT) AS mut_nnz, CAST((SELECT count(*) FROM miss JOIN heights x ON x.node_id = miss.node WHERE x.level = h.level) AS BIGINT) AS miss_nnz
FROM heights h LEFT JOIN mut ON mut.node = h.node_id GROUP BY h.level""")
def selector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).selector_stats


@query(f"{_GRAPH} SELECT node AS sample_id, CAST(floor(node / 2) AS BIGINT) AS individual_id FROM ids CROSS JOIN k WHERE node < k.s")
def sample_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).samples


@query(f"{_GRAPH} SELECT ids.node AS node_id, CAST(coalesce(coal.n, 0) AS BIGINT) AS coal_count FROM ids LEFT JOIN coal ON coal.node = ids.node")
def coalescence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).nodes.select("node_id", "coal_count")


@query("SELECT p_partkey AS mutation_id, CAST(1000 * p_size + p_partkey % 40 AS DOUBLE) AS position, substr('ACGT', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS allele, substr('CGTA', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS ref_allele FROM part")
def mutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).mutations.select("mutation_id", "position", "allele", "ref_allele")


@query("SELECT p_partkey AS mutation_id, CAST(1000 * p_size + p_partkey % 40 AS DOUBLE) AS position FROM part WHERE p_partkey = 11")
def mutation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.graph(spark, sf_dir).mutation(11).select("mutation_id", "position")


# --- traversal ------------------------------------------------------------------------------------------------------


@query(_up_sql(_SAMPLES))
def up_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g), "up").values)


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def up_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g, 3), "up").values)


@query(_up_sql(_SAMPLES3, rows=_ROWS))
def up_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins and aggregations alone."""
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g, 3), "up", strategy=Strategy.LEVELS).values)


@query(_up_sql(_PEOPLE))
def up_by_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _people(g), "up", by_individual=True).values)


@query(_down_sql(_PARTS))
def down_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g), "down").values)


@query(_down_sql(_PARTS3, rows=_ROWS))
def down_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g, 3), "down").values)


@query(_down_sql(_PARTS3, rows=_ROWS))
def down_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g, 3), "down", strategy=Strategy.LEVELS).values)


@query(_down_sql(_PARTS, "individual"))
def down_by_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g), "down", by_individual=True).values)


@query(_all_nodes_up_sql(_SAMPLES))
def up_emit_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g), "up", emit_all_nodes=True).values)


@query(_down_sql(_PARTS, "node"))
def down_emit_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g), "down", emit_all_nodes=True).values)


@query(_up_sql(f"{_SAMPLES} UNION ALL {_INIT}"))
def up_init_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g), "up", init_mode="vector", init=_init(g)).values)


@query(_up_sql(f"{_SAMPLES} UNION ALL {_MATRIX}"))
def up_init_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    init = _operand(g.nodes.select("node_id"), lambda i, r: i % 5 - 2)
    return _whole(traverse(g, _samples(g), "up", init_mode="matrix", init=init).values)


@query(_up_sql(f"{_ONES} UNION ALL {_XTX}"))
def up_xtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, frequency.ones(g), "up", init_mode="xtx").values)


@query(_down_sql(f"{_PARTS} UNION ALL {_INIT}"))
def down_init_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g), "down", init_mode="vector", init=_init(g)).values)


@query(_down_sql(f"{_PARTS} UNION ALL {_XTX}"))
def down_xtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g), "down", init_mode="xtx").values)


@query(f"""{_GRAPH},
one AS (SELECT w.top AS node, count(*) AS v FROM reach w GROUP BY w.top),
two AS (SELECT w.top AS node, sum(2 * coal.n) AS v FROM reach w JOIN coal ON coal.node = w.bottom GROUP BY w.top),
b1 AS (SELECT mut.m, sum(one.v) AS v FROM mut JOIN one ON one.node = mut.node GROUP BY mut.m),
b2 AS (SELECT mut.m, sum(two.v) AS v FROM mut JOIN two ON two.node = mut.node GROUP BY mut.m),
d1 AS (SELECT w.bottom AS i, count(*) AS v FROM reach w GROUP BY w.bottom),
d2 AS (SELECT w.bottom AS i, sum(2 * coal.n) AS v FROM reach w JOIN coal ON coal.node = w.top GROUP BY w.bottom)
SELECT 'mut' AS kind, p_partkey AS id, CAST(coalesce(b1.v, 0) AS BIGINT) AS vec_bias, CAST(coalesce(b2.v, 0) AS BIGINT) AS xtx_bias
FROM part LEFT JOIN b1 ON b1.m = p_partkey LEFT JOIN b2 ON b2.m = p_partkey
UNION ALL
SELECT 'sample', ids.node, CAST(coalesce(d1.v, 0) AS BIGINT), CAST(coalesce(d2.v, 0) AS BIGINT)
FROM ids CROSS JOIN k LEFT JOIN d1 ON d1.i = ids.node LEFT JOIN d2 ON d2.i = ids.node WHERE ids.node < k.s""")
def endpoint_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haplospark.operators.traverse import endpoint_bias as build

    whole = lambda c: F.round(c).cast("bigint").alias(c)
    return build(fixture.graph(spark, sf_dir)).select("kind", "id", whole("vec_bias"), whole("xtx_bias"))


@query(_up_sql(_SAMPLES, pairs="miss"))
def up_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _samples(g), "up", miss=True).missing)


@query(_down_sql(f"{_PARTS} UNION ALL SELECT 0 AS r, node, m % 5 - 2 AS v FROM miss"))
def down_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return _whole(traverse(g, _parts(g), "down", miss=_operand(g.mutation_ids, lambda i, r: i % 5 - 2)).values)


@query(_down_sql(_PARTS))
def split_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the mutations, each brought down, add up to the whole."""
    g = fixture.graph(spark, sf_dir)
    half = lambda b: traverse(g, _parts(g).where(F.col("id") % 2 == b), "down").values
    return _whole(accumulate(half(0), half(1)))


@query(f"""{_GRAPH},
seed AS ({_SAMPLES}),
val AS (SELECT w.top AS node, sum(s.v) AS v FROM seed s JOIN reach w ON w.bottom = s.node GROUP BY w.top),
got AS (SELECT p.m, sum(val.v) AS v FROM val JOIN mut p ON p.node = val.node GROUP BY p.m),
one AS (SELECT part.p_partkey AS id, CAST(coalesce(got.v, 0) AS BIGINT) AS value FROM part LEFT JOIN got ON got.m = part.p_partkey)
SELECT 'first' AS graph_id, id, value FROM one UNION ALL SELECT 'second', id, 2 * value FROM one""")
def multi_graph_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs with an operand each, in one table."""
    g = fixture.graph(spark, sf_dir)
    x = _samples(g)
    got = traverse_many({"first": g, "second": g}, {"first": x, "second": x.withColumn("value", 2 * F.col("value"))}, "up")
    return got.select("graph_id", "id", F.round("value").cast("bigint").alias("value"))


@query(f"""{_GRAPH}, c AS (
  SELECT 1 AS k, 'edges' AS category, count(*) AS n, 16 AS w FROM edges UNION ALL SELECT 2, 'mutation selector', count(*), 16 FROM mut UNION ALL SELECT 3, 'missingness selector', count(*), 16 FROM miss
  UNION ALL SELECT 4, 'node values', 4 * count(*), 8 FROM ids UNION ALL SELECT 5, 'operands and results', 4 * (k.s + (SELECT count(*) FROM part)), 8 FROM k)
SELECT category, CAST(n AS BIGINT) AS entries, CAST(n * w AS BIGINT) AS nbytes FROM c""")
def budget_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by category for four vectors."""
    return budget.accounting(fixture.graph(spark, sf_dir), 4)


@query(f"""{_GRAPH},
e AS (SELECT h.level, count(*) AS n FROM edges JOIN heights h ON h.node_id = edges.parent GROUP BY h.level)
SELECT h.level AS level, CAST(count(*) AS BIGINT) AS max_nodes, CAST(coalesce(max(e.n), 0) AS BIGINT) AS max_edges FROM heights h LEFT JOIN e ON e.level = h.level GROUP BY h.level""")
def largest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return budget.largest_levels({"first": g, "second": g})


# --- frequencies ----------------------------------------------------------------------------------------------------

_COUNTS = f"""{_GRAPH},
car AS (SELECT top AS node, count(*) AS n FROM reach CROSS JOIN k WHERE bottom < k.s GROUP BY top),
ac AS (SELECT mut.m, sum(car.n) AS n FROM mut JOIN car ON car.node = mut.node GROUP BY mut.m),
mc AS (SELECT miss.m, sum(car.n) AS n FROM miss JOIN car ON car.node = miss.node GROUP BY miss.m),
counts AS (SELECT p_partkey AS mutation_id, CAST(coalesce(ac.n, 0) AS BIGINT) AS allele_count, CAST(coalesce(mc.n, 0) AS BIGINT) AS miss_count FROM part LEFT JOIN ac ON ac.m = p_partkey LEFT JOIN mc ON mc.m = p_partkey),
freqs AS (SELECT mutation_id, CASE WHEN k.s - miss_count <> 0 THEN allele_count * 1.0E0 / (k.s - miss_count) ELSE 0.0E0 END AS freq FROM counts CROSS JOIN k)"""


@query(f"{_COUNTS} SELECT mutation_id, allele_count, miss_count FROM counts")
def allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.allele_counts(fixture.graph(spark, sf_dir))


@query(f"{_COUNTS} SELECT mutation_id, miss_count FROM counts")
def miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.miss_counts(fixture.graph(spark, sf_dir))


@query(f"""{_COUNTS} SELECT mutation_id, round(freq, 6) AS freq, round(2 * freq, 6) AS center,
round(CASE WHEN freq * (1 - freq) <= 0 THEN 1.0E0 ELSE sqrt(2 * freq * (1 - freq)) END, 6) AS sigma FROM freqs""")
def allele_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return frequency.allele_frequencies(fixture.graph(spark, sf_dir)).select("mutation_id", r("freq"), r("center"), r("sigma"))


@query(f"""{_COUNTS},
car2 AS (SELECT mut.m, reach.bottom AS i, count(*) AS n FROM mut JOIN reach ON reach.top = mut.node CROSS JOIN k WHERE reach.bottom < k.s GROUP BY mut.m, reach.bottom),
lost AS (SELECT miss.m, reach.bottom AS i FROM miss JOIN reach ON reach.top = miss.node CROSS JOIN k WHERE reach.bottom < k.s),
x AS (SELECT m, i, CAST(n AS DOUBLE) AS g FROM car2 UNION ALL SELECT lost.m, lost.i, freqs.freq FROM lost JOIN freqs ON freqs.mutation_id = lost.m),
got AS (SELECT m, sum(g * (i % 11 - 5)) AS v FROM x GROUP BY m)
SELECT p_partkey AS id, round(coalesce(v, 0), 4) + 0.0 AS value FROM part LEFT JOIN got ON got.m = p_partkey""")
def up_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing entries count as the allele frequency."""
    g = fixture.graph(spark, sf_dir)
    return frequency.up_imputed(g, _samples(g), frequency.allele_frequencies(g)).select("id", (F.round("value", 4) + F.lit(0.0)).alias("value"))


_X = f"""{_GRAPH},
x AS (SELECT mut.m AS v, CAST(floor(reach.bottom / 2) AS BIGINT) AS i, count(*) AS g FROM mut JOIN reach ON reach.top = mut.node CROSS JOIN k WHERE reach.bottom < k.s GROUP BY mut.m, CAST(floor(reach.bottom / 2) AS BIGINT))"""


@query(f"{_X} SELECT v AS variant_id, i AS individual_id, CAST(g AS BIGINT) AS dosage FROM x")
def explicit_dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix, every mutation, written out."""
    return genotypes.dosages(fixture.graph(spark, sf_dir)).select("variant_id", "individual_id", F.col("dosage").cast("bigint").alias("dosage"))


@query(f"{_X} SELECT v AS mutation_id, CAST(sum(g * g) AS BIGINT) AS value FROM x WHERE v IN (SELECT m FROM mut GROUP BY m HAVING count(*) = 1) GROUP BY v")
def dosage_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of squared dosages from coalescence counts; defined for mutations of exactly one node."""
    g = fixture.graph(spark, sf_dir)
    single = g.mut_node.groupBy("mutation_id").count().where("count = 1").select("mutation_id")
    return frequency.dosage_squares(g).join(single, "mutation_id").select("mutation_id", F.round("value").cast("bigint").alias("value"))


# --- variants -------------------------------------------------------------------------------------------------------


def _bim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant list that overlaps the graph's mutations: parts, some left out, some with swapped or foreign alleles."""
    p = F.col("p_partkey")
    letter = lambda word, shift: F.element_at(F.array(*map(F.lit, word)), ((p + shift) % 4 + 1).cast("int"))
    swap = F.when(p % 11 == 0, F.lit(1)).otherwise(F.lit(0))
    return fixture.read(spark, sf_dir, "part").where(p % 5 != 0).select(
        (19 + p % 4).cast("int").alias("chrom"), F.concat(F.lit("rs"), p.cast("string")).alias("snp_id"), (1000 * F.col("p_size") + p % 40).cast("bigint").alias("bp"),
        F.when(swap == 1, letter("CGTA", 0)).otherwise(letter("ACGT", 0)).alias("allele1"), F.when(swap == 1, letter("ACGT", 0)).otherwise(letter("CGTA", 0)).alias("allele0"), p.alias("row"),
    )


_BIM = """
WITH bim AS (
  SELECT CAST(19 + p_partkey % 4 AS INTEGER) AS chrom, 'rs' || CAST(p_partkey AS VARCHAR) AS snp_id, CAST(1000 * p_size + p_partkey % 40 AS BIGINT) AS bp,
         substr(CASE WHEN p_partkey % 11 = 0 THEN 'CGTA' ELSE 'ACGT' END, CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS allele1,
         substr(CASE WHEN p_partkey % 11 = 0 THEN 'ACGT' ELSE 'CGTA' END, CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS allele0, p_partkey AS row
  FROM part WHERE p_partkey % 5 <> 0),
own AS (
  SELECT p_partkey AS mutation_id, CAST(1000 * p_size + p_partkey % 40 AS BIGINT) AS bp, substr('ACGT', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS a1, substr('CGTA', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS a0 FROM part),
found AS (
  SELECT bim.*, own.mutation_id FROM bim JOIN own ON own.bp = bim.bp AND own.a1 = bim.allele1 AND own.a0 = bim.allele0
  WHERE bim.bp NOT IN (SELECT bp FROM bim GROUP BY bp HAVING count(*) > 1) AND bim.bp NOT IN (SELECT bp FROM own GROUP BY bp HAVING count(*) > 1))"""


@query(f"{_BIM} SELECT bp, CAST(count(*) AS BIGINT) AS n FROM bim GROUP BY bp HAVING count(*) > 1")
def repeated_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.repeated_positions(_bim(spark, sf_dir))


@query(f"{_BIM} SELECT * FROM bim WHERE bp NOT IN (SELECT bp FROM bim GROUP BY bp HAVING count(*) > 1)")
def singleton_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.singletons(_bim(spark, sf_dir))


@query(f"{_BIM} SELECT chrom, snp_id, bp, allele1, allele0, row, mutation_id, CAST(chrom AS VARCHAR) || ':' || CAST(bp AS VARCHAR) || ':' || allele1 || ':' || allele0 AS unique_id FROM found")
def bim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.match_variants(_bim(spark, sf_dir), fixture.graph(spark, sf_dir).mutations)


@query(f"{_BIM} SELECT snp_id, chrom, CAST(row_number() OVER (ORDER BY chrom, row) - 1 AS BIGINT) AS global_idx FROM found")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.global_index(bim_match(spark, sf_dir)).select("snp_id", "chrom", "global_idx")


@query(f"""{_BIM}, o AS (SELECT *, row_number() OVER (ORDER BY chrom, row) - 1 AS g FROM found),
good AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS m, count(*) OVER () AS total FROM o WHERE mutation_id % 3 <> 0)
SELECT snp_id, CAST(g AS BIGINT) AS global_idx, CAST(floor(7 * m / (total * 1.0E0)) AS INTEGER) AS block FROM good""")
def calibration_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = qc.global_index(bim_match(spark, sf_dir)).withColumn("is_model", F.col("mutation_id") % 3 != 0)
    return qc.calibration_blocks(listed, 7).select("snp_id", "global_idx", "block")


@query(f"""{_BIM}, o AS (SELECT chrom, row, row - 4 * row_number() OVER (PARTITION BY chrom ORDER BY row) AS island FROM bim)
SELECT chrom, CAST(min((row - row % 4) / 4) AS BIGINT) AS first, CAST(max((row - row % 4) / 4) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY chrom, island""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive rows within a chromosome's list (every fourth row is one chromosome's)."""
    rows = _bim(spark, sf_dir).select("chrom", F.floor(F.col("row") / 4).alias("row"))
    return qc.contiguous_runs(rows, by=["chrom"])


@query("""
WITH z AS (SELECT s_suppkey AS i, CAST(s_suppkey % 50 AS DOUBLE) AS a, CAST(s_suppkey % 3 AS DOUBLE) AS b FROM supplier),
m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM z),
c AS (SELECT i, a - ma AS a, b - mb AS b FROM z CROSS JOIN m),
t AS (SELECT sum(a * b) / sum(a * a) AS t FROM c),
e AS (SELECT i, a, b - t * a AS r FROM c CROSS JOIN t),
y AS (SELECT p_partkey AS v, s_suppkey AS i, CAST((p_partkey * s_suppkey) % 5 AS DOUBLE) AS y FROM part CROSS JOIN supplier),
s AS (
  SELECT y.v, sum(y * y) - sum(y) * sum(y) / count(*) - power(sum(y * e.a), 2) / (SELECT sum(a * a) FROM e) - power(sum(y * e.r), 2) / (SELECT sum(r * r) FROM e) AS p
  FROM y JOIN e ON e.i = y.i GROUP BY y.v)
SELECT v AS variant_id, round(greatest(p, 0.0E0), 4) + 0.0 AS proj_norm2 FROM s""")
def projected_norms_of_close_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two covariates that differ by a hundred thousandth of a third: all count, so norms are those outside the constant and both directions."""
    key, n = F.col("s_suppkey"), fixture.read(spark, sf_dir, "supplier").count()
    people = fixture.read(spark, sf_dir, "supplier").select(key.alias("individual_id"), (key % 50).alias("a"), (key % 50 + 1e-5 * (key % 3)).alias("b"))
    table, names = qc.covariate_columns(people, [], ["a", "b"])
    each = _matrix_rows(fixture.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id")), people.select("individual_id"), n)  # the matrix itself
    calls = each.withColumn("dosage", (F.col("variant_id") * F.col("individual_id")) % 5)
    found = qc.projected_norms(calls, qc.covariate_basis(table, names), qc.snp_stats(calls, n))
    return found.select("variant_id", (F.round("proj_norm2", 4) + F.lit(0.0)).alias("proj_norm2"))


def _matrix_rows(variants: DataFrame, people: DataFrame, n: int) -> DataFrame:
    """Every variant with every one of the ``n`` people.  Tasks take variants: those of a small file would all be in one."""
    tasks = max(4 * variants.sparkSession.sparkContext.defaultParallelism, variants.count() * n // TASK_CELLS)
    return variants.repartition(tasks, "variant_id").crossJoin(F.broadcast(people) if n <= MAX_BROADCAST_PEOPLE else people)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype calls by supplier (as individuals) and part (as variants), some of them missing."""
    rows = fixture.read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_linenumber").alias("k"))
    return rows.select(F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("individual_id"), F.when(F.col("k") != 7, (F.col("k") % 3).cast("bigint")).alias("dosage"))


_CALLS = """
WITH calls AS (SELECT l_partkey AS v, l_suppkey AS i, CASE WHEN max(l_linenumber) <> 7 THEN CAST(max(l_linenumber) % 3 AS BIGINT) END AS g FROM lineitem GROUP BY l_partkey, l_suppkey),
n AS (SELECT count(*) * 1.0E0 AS n FROM supplier),
s AS (SELECT v, coalesce(sum(g), 0) AS sm, coalesce(sum(g * g), 0) AS sq, count(*) - count(g) AS missing FROM calls GROUP BY v),
st AS (SELECT v, sm, sq, missing, sm / n AS mean, sq - sm * sm / n AS c, CASE WHEN sq - sm * sm / n > 0 THEN sqrt((n - 1) / (sq - sm * sm / n)) ELSE 0.0E0 END AS scale, sm / (2 * n) AS freq FROM s CROSS JOIN n)"""


@query(f"{_CALLS} SELECT v AS variant_id, CAST(sm AS BIGINT) AS sum, CAST(sq AS BIGINT) AS sumsq, CAST(missing AS BIGINT) AS missing, round(mean, 6) AS mean, round(c, 6) AS mean_center_norm2, round(scale, 6) AS norm_scale, round(freq, 6) AS a1freq FROM st")
def snp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = qc.snp_stats(_calls(spark, sf_dir), fixture.read(spark, sf_dir, "supplier").count())
    r = lambda c: F.round(c, 6).alias(c)
    return stats.select("variant_id", "sum", "sumsq", "missing", r("mean"), r("mean_center_norm2"), r("norm_scale"), r("a1freq"))


@query(f"""{_CALLS}, grp AS (SELECT s_suppkey AS i, s_suppkey % 4 AS a FROM supplier),
size AS (SELECT a, count(*) * 1.0E0 AS m FROM grp GROUP BY a),
per AS (SELECT c.v, grp.a, sum(c.g) AS t FROM calls c JOIN grp ON grp.i = c.i WHERE c.g IS NOT NULL GROUP BY c.v, grp.a),
fit AS (SELECT per.v, sum(t * t / m) AS f FROM per JOIN size ON size.a = per.a GROUP BY per.v)
SELECT st.v AS variant_id, round(greatest(sq - coalesce(f, 0.0E0), 0.0E0), 5) + 0.0 AS proj_norm2 FROM st LEFT JOIN fit ON fit.v = st.v""")
def projected_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms outside a categorical covariate of four levels (one column for each level spans the constant)."""
    people = fixture.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("individual_id"), (F.col("s_suppkey") % 4).alias("group"))
    table, names = qc.covariate_columns(people, ["group"], [])
    calls = _calls(spark, sf_dir)
    found = qc.projected_norms(calls, qc.covariate_basis(table, names), qc.snp_stats(calls, people.count()))
    return found.select("variant_id", (F.round("proj_norm2", 5) + F.lit(0.0)).alias("proj_norm2"))


# --- association ----------------------------------------------------------------------------------------------------


def _model(spark: SparkSession, sf_dir: str) -> Relatedness:
    """The relatedness of the customers from all parts, its variants stored once for each application and folder; the constant is the only covariate."""
    return _stored_model(spark.sparkContext.applicationId, sf_dir)


@lru_cache(maxsize=4)
def _stored_model(application: str, sf_dir: str) -> Relatedness:
    import numpy as np

    g = fixture.graph(SparkSession.getActiveSession(), sf_dir)
    n = g.meta.num_individuals
    stats = qc.stats_of_sums(frequency.dosage_sums(g), n)
    c = F.col("mean_center_norm2")
    table = stats.select(F.col("variant_id").alias("mutation_id"), (19 + F.col("variant_id") % 4).cast("int").alias("chrom"), "mean", "mean_center_norm2", "norm_scale", c.alias("proj_norm2"), (c * F.col("norm_scale") * F.col("norm_scale")).alias("x_norm2"), "a1freq", "missing")
    return Relatedness(g, stored(qc.global_index(table, row="mutation_id"), "variants"), np.full((n, 1), n**-0.5))


def _phenotype(spark: SparkSession, sf_dir: str):
    import numpy as np

    return fixture.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").toArrow().sort_by("c_custkey")["c_acctbal"].to_numpy().astype(np.float64)


_PANEL = f"""{_X},
n AS (SELECT count(*) * 1.0E0 AS n FROM customer),
st AS (SELECT v, sum(g) / n AS mean, sum(g * g) - sum(g) * sum(g) / n AS c FROM x CROSS JOIN n GROUP BY v, n),
ok AS (SELECT v, mean, c, sqrt((n - 1) / c) AS scale, CAST(19 + v % 4 AS INTEGER) AS chrom FROM st CROSS JOIN n WHERE c >= 0.1E0)"""


@query(f"""{_PANEL}, s AS (SELECT v, CAST(sum(g) AS BIGINT) AS sm, CAST(sum(g * g) AS BIGINT) AS sq FROM x GROUP BY v)
SELECT v AS variant_id, sm AS sum, sq AS sumsq, CAST(0 AS BIGINT) AS missing FROM s""")
def dosage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and squares of every mutation's dosages, from traversals instead of the matrix."""
    return frequency.dosage_sums(fixture.graph(spark, sf_dir))


@query(f"""{_PANEL},
y AS (SELECT c_custkey AS i, c_acctbal - avg(c_acctbal) OVER () AS y FROM customer),
yy AS (SELECT sum(y * y) AS y2 FROM y),
xy AS (SELECT x.v, sum(x.g * y.y) AS s FROM x JOIN y ON y.i = x.i GROUP BY x.v)
SELECT st.v AS mutation_id, round(CASE WHEN st.c >= 0.1E0 THEN s * s / y2 / st.c * (n - 1) ELSE -1.0E9 END, 6) AS chisq FROM st CROSS JOIN yy CROSS JOIN n JOIN xy ON xy.v = st.v""")
def linreg_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_model.association(_model(spark, sf_dir), _phenotype(spark, sf_dir)).select("mutation_id", F.round("chisq_linreg", 6).alias("chisq"))


def _grm_sql(loco: str) -> str:
    return f"""{_PANEL},
u AS (SELECT c_custkey AS i, (c_custkey % 11 - 5) - avg(c_custkey % 11 - 5) OVER () AS u FROM customer),
sc AS (SELECT ok.v, ok.mean, ok.scale, ok.scale * sum(x.g * u.u) AS s FROM ok JOIN x ON x.v = ok.v JOIN u ON u.i = x.i WHERE {loco} GROUP BY ok.v, ok.mean, ok.scale),
tot AS (SELECT sum(mean * scale * s) AS shift, count(*) AS m FROM sc),
back AS (SELECT x.i, sum(x.g * sc.scale * sc.s) AS b FROM x JOIN sc ON sc.v = x.v GROUP BY x.i)
SELECT c_custkey AS id, round((coalesce(b, 0) - shift) / m, 6) + 0.0 AS value FROM customer CROSS JOIN tot LEFT JOIN back ON back.i = c_custkey"""


def _grm(spark: SparkSession, sf_dir: str, without: int | None) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    k = _model(spark, sf_dir)
    v = (np.arange(k.n) % 11 - 5).astype(float)
    out = k.apply(v[:, None], [without])[:, 0]
    return spark.createDataFrame(pa.table({"id": np.arange(k.n), "value": out})).select("id", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(_grm_sql("true"))
def grm_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm(spark, sf_dir, None)


@query(_grm_sql("ok.chrom <> 19"))
def grm_loco_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm(spark, sf_dir, 19)


@query(f"""{_COUNTS},
f AS (SELECT mutation_id AS m, freq, 2 * freq AS center, CASE WHEN freq * (1 - freq) <= 0 THEN 1.0E0 ELSE sqrt(2 * freq * (1 - freq)) END AS sigma FROM freqs),
g AS (SELECT mut.m, CAST(floor(reach.bottom / 2) AS BIGINT) AS i, count(*) * 1.0E0 AS g FROM mut JOIN reach ON reach.top = mut.node CROSS JOIN k WHERE reach.bottom < k.s GROUP BY mut.m, CAST(floor(reach.bottom / 2) AS BIGINT)
  UNION ALL SELECT miss.m, CAST(floor(reach.bottom / 2) AS BIGINT), sum(f.freq) FROM miss JOIN f ON f.m = miss.m JOIN reach ON reach.top = miss.node CROSS JOIN k WHERE reach.bottom < k.s GROUP BY miss.m, CAST(floor(reach.bottom / 2) AS BIGINT)),
w AS (SELECT m, (m % 7 - 3) / sigma AS w, center FROM f),
shift AS (SELECT sum(w * center) AS t FROM w),
h0 AS (SELECT g.i, sum(g.g * w.w) AS h FROM g JOIN w ON w.m = g.m GROUP BY g.i),
h AS (SELECT c_custkey AS i, coalesce(h0.h, 0) - t AS h FROM customer CROSS JOIN shift LEFT JOIN h0 ON h0.i = c_custkey),
hs AS (SELECT sum(h) AS total FROM h),
b AS (SELECT g.m, sum(g.g * h.h) AS b FROM g JOIN h ON h.i = g.i GROUP BY g.m)
SELECT f.m AS id, round((coalesce(b.b, 0) - total * center) / sigma, 3) + 0.0 AS value FROM f CROSS JOIN hs LEFT JOIN b ON b.m = f.m""")
def xtx_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised, imputed XᵀX times a vector."""
    g = fixture.graph(spark, sf_dir)
    out = frequency.standardised_gram(g, _parts(g), frequency.allele_frequencies(g))
    return out.select("id", (F.round("value", 3) + F.lit(0.0)).alias("value"))


@query("""
WITH p AS (SELECT p_retailprice AS r, p_retailprice + (p_partkey % 7 - 3) * 0.001E0 AS a FROM part),
d AS (SELECT r, a, abs(a - r) AS gap, abs(a - r) / greatest(abs(r), 1.0E-300) AS rel FROM p)
SELECT CAST(count(*) AS BIGINT) AS n, round(max(gap), 9) AS max_abs, round(median(gap), 9) AS median_abs, round(quantile_cont(gap, 0.99), 9) AS p99_abs,
       round(max(rel), 9) AS max_rel, round(median(rel), 9) AS median_rel, round(quantile_cont(rel, 0.99), 9) AS p99_rel, round(corr(r, a), 9) AS pearson FROM d""")
def stats_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture.read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("r"), (F.col("p_retailprice") + (F.col("p_partkey") % 7 - 3) * 0.001).alias("a"))
    got = compare.difference(p, "r", "a")
    return got.select("n", *[F.round(c, 9).alias(c) for c in got.columns[1:]])


@query()
def pca_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four largest eigenpairs by randomised Rayleigh-Ritz over individuals: component, eigenvalue, relative residual."""
    got, _ = pca.components_by_people(fixture.graph(spark, sf_dir), 4, "randomized")
    rows = [(k, float(v), float(r)) for k, (v, r) in enumerate(zip(got.values, got.residuals, strict=True))]
    return spark.createDataFrame(rows, "component int, eigenvalue double, residual double")


@query()
def lmm_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed-model table of all mutations for the account balances."""
    k, y = _model(spark, sf_dir), _phenotype(spark, sf_dir)
    fit = mixed_model.estimate_variances(k, y)
    calibration = mixed_model.calibrate(k, y, fit)
    return mixed_model.association(k, y, fit, calibration).select("mutation_id", "chrom", "a1freq", "chisq_linreg", "p_linreg", "beta", "se", "chisq_lmm", "p_lmm")


@query()
def sample_pcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two leading components over individuals, standardised."""
    k = _model(spark, sf_dir)
    return pca.as_table(k.graph, pca.sample_components(k, 2, "lanczos"))


