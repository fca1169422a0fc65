"""Matrix products by traversal, without the matrix.

With X the samples x mutations matrix that the graph encodes (entry: number of paths from the mutation's nodes to the
sample), ``up`` gives V·X and ``down`` V·Xᵀ for any number of vectors at once.  Vectors are long tables
(row, id, value); absent ids are 0, results are dense (zeros included).  Two strategies, which agree:

* kernel: one task per group of vectors, arrays broadcast (only where ``plans.strategy`` finds that they fit a worker);
* levels: for each level, one join of all edges into it with the values of the levels that they come from, and one aggregation, for graphs of
  any size.  Level tables are written to the shared folder, so lineage stays short and lost executors cost a read.

Dense results are as large as ids times rows; ``sparse=True`` leaves zeros out, and needs no such grid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.checkpoints import Levels, stored
from haplospark.operators.graph import GraphDataset, individual
from haplospark.plans.strategy import WORKER_BYTES, Strategy, choose
from haplospark.schema import VECTOR, Direction, InitMode

_INPUT, _INIT_VECTOR, _INIT_MATRIX, _MISS = range(4)


@dataclass(frozen=True)
class Spec:
    """What a traversal does; checked once, usable for many operands."""

    direction: Direction
    by_individual: bool = False
    init: InitMode = InitMode.NONE
    emit_all_nodes: bool = False
    miss: bool = False
    sparse: bool = False

    def checked(self, graph: GraphDataset) -> Spec:
        if self.emit_all_nodes and self.miss:
            raise ValueError("all nodes cannot be returned together with missingness")
        if self.sparse and self.init is not InitMode.NONE:
            raise ValueError("with an init hardly any value is zero: no sparse result")
        if self.miss and self.init is not InitMode.NONE:
            raise ValueError("an init and missingness exclude each other")
        if self.init is InitMode.XTX and not graph.meta.has_coalescence:
            raise ValueError("xtx needs coalescence counts, which this graph does not have")
        return self


@dataclass(frozen=True)
class Requirements:
    """What a caller declares to need; anything beyond is refused before any work."""

    max_rows_up: int | None = None
    max_rows_down: int | None = None
    miss_input: bool = True
    miss_output: bool = True
    init_vector: bool = True
    init_matrix: bool = True
    init_xtx: bool = True

    def check(self, spec: Spec, operand: DataFrame | None = None) -> None:
        declared = {InitMode.NONE: True, InitMode.VECTOR: self.init_vector, InitMode.MATRIX: self.init_matrix, InitMode.XTX: self.init_xtx}
        if not declared[spec.init]:
            raise RuntimeError(f"init mode {spec.init.value} was not declared")
        if spec.miss and not (self.miss_output if spec.direction is Direction.UP else self.miss_input):
            raise RuntimeError("missingness was not declared")
        most = self.max_rows_up if spec.direction is Direction.UP else self.max_rows_down
        if operand is not None and most is not None and operand.select("row").distinct().count() > most:
            raise RuntimeError(f"more than {most} vectors, as declared")


@dataclass(frozen=True)
class Result:
    """``values``; for UP with miss also ``missing``, by mutation through the missingness selector."""

    values: DataFrame
    missing: DataFrame | None = None


@dataclass(frozen=True)
class PreparedTraversal:
    """A graph and a checked specification; call it with operands."""

    graph: GraphDataset
    spec: Spec
    strategy: Strategy | None = None
    requirements: Requirements = Requirements()

    def __call__(self, operand: DataFrame, init: DataFrame | None = None, miss: DataFrame | None = None) -> Result:
        g, spec = self.graph, self.spec
        operand = _vector(operand, "operand")
        self.requirements.check(spec, operand)
        if (spec.init in (InitMode.VECTOR, InitMode.MATRIX)) != (init is not None):
            raise ValueError(f"init mode {spec.init.value} " + ("needs an init table" if init is None else "takes no init table"))
        if miss is not None and (spec.direction is Direction.UP or not spec.miss):
            raise ValueError("only a downward traversal with miss=True takes a missingness operand")
        if spec.miss and spec.direction is Direction.DOWN and miss is None:
            raise ValueError("a downward traversal with miss=True needs a missingness operand")
        if init is not None:
            if not isinstance(init, DataFrame):
                raise TypeError("init must be a DataFrame")
            init = init.select(F.col("row").cast("int").alias("row"), (F.col("id").cast("bigint") if spec.init is InitMode.MATRIX else F.lit(-1).cast("bigint")).alias("id"), F.col("value").cast("double").alias("value"))
        miss = _vector(miss, "miss") if miss is not None else None
        strategy = self.strategy or choose(g.meta, WORKER_BYTES, g.selector_entries)
        return (_by_kernel if strategy is Strategy.KERNEL else _by_levels)(g, spec, operand, init, miss)


def _vector(df: DataFrame, what: str) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"{what} must be a DataFrame of row, id, value")
    if not {"row", "id", "value"} <= set(df.columns):
        raise ValueError(f"{what} needs the columns row, id and value, not {df.columns}")
    return df.select(F.col("row").cast("int").alias("row"), F.col("id").cast("bigint").alias("id"), F.col("value").cast("double").alias("value"))


def traverse(
    graph: GraphDataset,
    operand: DataFrame,
    direction: Direction | str,
    by_individual: bool = False,
    init_mode: InitMode | str | None = None,
    init: DataFrame | None = None,
    emit_all_nodes: bool = False,
    miss: DataFrame | bool | None = None,
    strategy: Strategy | None = None,
    sparse: bool = False,
) -> Result:
    """One traversal.  ``miss``: True (UP: also return the missingness output), or for DOWN a table by mutation; ``sparse``: without zeros."""
    spec = Spec(Direction.parse(direction), by_individual, InitMode.parse(init_mode), emit_all_nodes, miss is not None and miss is not False, sparse)
    return prepare(graph, spec, strategy)(operand, init, miss if isinstance(miss, DataFrame) else None)


def prepare(graph: GraphDataset, spec: Spec, strategy: Strategy | None = None, requirements: Requirements | None = None) -> PreparedTraversal:
    """A traversal checked once, to be called with any number of operands."""
    requirements = requirements or Requirements()
    requirements.check(spec)
    return PreparedTraversal(graph, spec.checked(graph), strategy, requirements)


def up(graph: GraphDataset, operand: DataFrame, **how) -> DataFrame:
    """row, id (mutation), value."""
    return traverse(graph, operand, Direction.UP, **how).values


def down(graph: GraphDataset, operand: DataFrame, **how) -> DataFrame:
    """row, id (sample or individual), value."""
    return traverse(graph, operand, Direction.DOWN, **how).values


def accumulate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two results added up."""
    return first.unionByName(second).groupBy("row", "id").agg(F.sum("value").alias("value"))


# --- kernel ---------------------------------------------------------------------------------------------------------


def operand_size(graph: GraphDataset, spec: Spec) -> int:
    if spec.direction is Direction.DOWN:
        return graph.meta.num_mutations
    return graph.meta.num_individuals if spec.by_individual else graph.meta.num_samples


def run_kernel(structure, spec: Spec, frame: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(values, missing) of one vector given as rows (kind, id, value)."""
    kind, at, value = frame["kind"].to_numpy(), frame["id"].to_numpy(), frame["value"].to_numpy()

    def dense(which: int, n: int) -> np.ndarray:
        own = kind == which
        if own.any() and not (0 <= at[own].min() and at[own].max() < n):
            raise ValueError(f"an id is not within 0..{n - 1}")
        return np.bincount(at[own], value[own], n)[None, :]

    x = dense(_INPUT, size)
    init = None
    if spec.init is InitMode.VECTOR:
        init = np.full((1, structure.num_nodes), value[kind == _INIT_VECTOR].sum())
    elif spec.init is InitMode.MATRIX:
        init = dense(_INIT_MATRIX, structure.num_nodes)
    elif spec.init is InitMode.XTX:
        init = 2.0 * structure.coal[None, :]
    if spec.direction is Direction.UP:
        values = x[:, structure.individual_of()] if spec.by_individual else x
        node = structure.nodes_up(values, init)
        if spec.emit_all_nodes:
            return node[0], None
        return structure.select(node, structure.mut)[0], structure.select(node, structure.miss)[0] if spec.miss else None
    miss = dense(_MISS, structure.num_mutations) if spec.miss else None
    if spec.emit_all_nodes:
        return structure.nodes_down(x, init, miss)[0], None
    return structure.down(x, init, miss, spec.by_individual)[0], None


def _by_kernel(graph: GraphDataset, spec: Spec, operand: DataFrame, init: DataFrame | None, miss: DataFrame | None) -> Result:
    kinds = [(operand, _INPUT)]
    if init is not None:
        kinds.append((init, _INIT_VECTOR if spec.init is InitMode.VECTOR else _INIT_MATRIX))
    if miss is not None:
        kinds.append((miss, _MISS))
    rows = None
    for df, kind in kinds:
        part = df.withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    sent, size = operand.sparkSession.sparkContext.broadcast(graph.structure), operand_size(graph, spec)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values, missing = run_kernel(sent.value, spec, frame, size)
        out = pd.DataFrame({"row": frame["row"].iloc[0], "id": np.arange(len(values)), "value": values})
        if missing is None:
            return out.assign(missing=False)
        return pd.concat([out.assign(missing=False), pd.DataFrame({"row": frame["row"].iloc[0], "id": np.arange(len(missing)), "value": missing, "missing": True})])

    out = rows.groupBy("row").applyInPandas(run, VECTOR + ", missing boolean")
    out = out.where("value <> 0") if spec.sparse else out
    if not spec.miss or spec.direction is Direction.DOWN:
        return Result(out.drop("missing"))
    out = stored(out, "traversal")
    return Result(out.where("not missing").drop("missing"), out.where("missing").drop("missing"))


# --- levels ---------------------------------------------------------------------------------------------------------


def _added(df: DataFrame) -> DataFrame:
    return df.groupBy("row", "node_id").agg(F.sum("value").alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _seeds(graph: GraphDataset, spec: Spec, operand: DataFrame, init: DataFrame | None, miss: DataFrame | None, propagate_init: bool) -> DataFrame:
    """row, node_id, value before any edge is taken."""
    by_mutation = lambda df, pairs: df.join(pairs, df["id"] == pairs["mutation_id"]).select("row", "node_id", "value")
    if spec.direction is Direction.DOWN:
        parts = [by_mutation(operand, graph.mut_node)]
        if miss is not None:
            parts.append(by_mutation(miss, graph.miss_node))
    elif spec.by_individual:
        s = graph.samples
        parts = [operand.join(s, operand["id"] == s["individual_id"]).select("row", F.col("sample_id").alias("node_id"), "value")]
    else:
        parts = [operand.select("row", F.col("id").alias("node_id"), "value")]
    if propagate_init and spec.init is InitMode.MATRIX:
        parts.append(init.select("row", F.col("id").alias("node_id"), "value"))
    elif propagate_init and spec.init is InitMode.VECTOR:  # rows of the operand times nodes: the size of the result
        parts.append(graph.nodes.select("node_id").crossJoin(F.broadcast(init.groupBy("row").agg(F.sum("value").alias("value")))).select("row", "node_id", "value"))
    elif propagate_init and spec.init is InitMode.XTX:
        rows = F.broadcast(operand.select("row").distinct())
        parts.append(graph.nodes.where("coal_count > 0").crossJoin(rows).select("row", "node_id", (2.0 * F.col("coal_count")).alias("value")))
    return _added(_union(parts))


def _by_levels(graph: GraphDataset, spec: Spec, operand: DataFrame, init: DataFrame | None, miss: DataFrame | None) -> Result:
    shortcut = spec.init in (InitMode.VECTOR, InitMode.XTX) and not spec.emit_all_nodes and graph.bias is not None
    rows = stored(operand.select("row").distinct(), "rows")
    seeds = stored(_seeds(graph, spec, operand, init, miss, not shortcut).join(graph.nodes.select("node_id", "level"), "node_id"), "seeds")
    upward = spec.direction is Direction.UP
    near, far, to, order = ("child", "parent", "dst_level", range(graph.meta.height + 1)) if upward else ("parent", "child", "src_level", range(graph.meta.height, -1, -1))
    sources: dict[int, list[int]] = {}
    for dst, src in graph.level_pairs:
        sources.setdefault(dst if upward else src, []).append(src if upward else dst)
    held = Levels(seeds.sparkSession, "values", "row int, node_id bigint, value double")
    for level in order:
        here = seeds.where(F.col("level") == level).select("row", "node_id", "value")
        if level in sources:
            into = graph.edges.where(F.col(to) == level).select(F.col(near).alias("node_id"), F.col(far).alias("to"))
            pushed = held.of(sources[level]).join(into, "node_id").select("row", F.col("to").alias("node_id"), "value")
            here = _added(here.unionByName(pushed))
        held.add(level, here)
    every = held.every().select("row", "node_id", "value")

    def dense(found: DataFrame, ids: DataFrame) -> DataFrame:
        if spec.sparse:
            return found.select("row", "id", "value").where("value <> 0")
        grid = ids.crossJoin(F.broadcast(rows))  # the size of the result
        return grid.join(found, ["row", "id"], "left").select("row", "id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def selected(pairs: DataFrame) -> DataFrame:
        found = every.join(pairs, "node_id").groupBy("row", F.col("mutation_id").alias("id")).agg(F.sum("value").alias("value"))
        return dense(found, graph.mutation_ids.withColumnRenamed("mutation_id", "id"))

    if spec.emit_all_nodes:
        return Result(dense(every.withColumnRenamed("node_id", "id"), graph.nodes.select(F.col("node_id").alias("id"))))
    if upward:
        out = selected(graph.mut_node)
        return Result(_biased(graph, spec, out, init) if shortcut else out, selected(graph.miss_node) if spec.miss else None)
    at = every.where(F.col("node_id") < graph.meta.num_samples).select("row", F.col("node_id").alias("id"), "value")
    ids = graph.samples.select(F.col("sample_id").alias("id"))
    if shortcut:
        at, ids = _biased(graph, spec, dense(at, ids), init), ids
    if spec.by_individual:
        at = at.groupBy("row", individual(F.col("id"), graph.meta.ploidy).alias("id")).agg(F.sum("value").alias("value"))
        ids = graph.samples.select(F.col("individual_id").alias("id")).distinct()
    return Result(dense(at, ids))


def _biased(graph: GraphDataset, spec: Spec, out: DataFrame, init: DataFrame | None) -> DataFrame:
    """Traversals are linear: an init that is a multiple of a known one adds that multiple of its known response."""
    kind = "mut" if spec.direction is Direction.UP else "sample"
    bias = graph.bias.where(F.col("kind") == kind).select("id", "vec_bias", "xtx_bias")
    joined = out.join(bias, "id")
    if spec.init is InitMode.XTX:
        return joined.select("row", "id", (F.col("value") + F.col("xtx_bias")).alias("value"))
    times = F.broadcast(init.groupBy("row").agg(F.sum("value").alias("times")))
    return joined.join(times, "row", "left").select("row", "id", (F.col("value") + F.coalesce("times", F.lit(0.0)) * F.col("vec_bias")).alias("value"))


def endpoint_bias(graph: GraphDataset) -> DataFrame:
    """kind (mut, sample), id, vec_bias, xtx_bias: responses of both endpoints to an init of 1, and of 2 x coalescence."""
    spark = graph.nodes.sparkSession
    zero = spark.createDataFrame([(0, 0, 0.0)], VECTOR)
    one = spark.createDataFrame([(0, -1, 1.0)], VECTOR)
    out = None
    for kind, direction in (("mut", Direction.UP), ("sample", Direction.DOWN)):
        if kind == "mut" and not graph.meta.num_mutations:
            continue
        vec = traverse(graph, zero, direction, init_mode="vector", init=one).values.select("id", F.col("value").alias("vec_bias"))
        if graph.meta.has_coalescence:
            xtx = traverse(graph, zero, direction, init_mode="xtx").values.select("id", F.col("value").alias("xtx_bias"))
            both = vec.join(xtx, "id")
        else:
            both = vec.withColumn("xtx_bias", F.lit(None).cast("double"))
        part = both.select(F.lit(kind).alias("kind"), "id", "vec_bias", "xtx_bias")
        out = part if out is None else out.unionByName(part)
    return out


# --- arrays in and out ----------------------------------------------------------------------------------------------


def to_vectors(spark, matrix: np.ndarray) -> DataFrame:
    """(row, id, value) of a k x n array."""
    if not isinstance(matrix, np.ndarray):
        raise TypeError("the operand must be a NumPy array")
    if matrix.ndim != 2 or 0 in matrix.shape:
        raise ValueError(f"the operand must be k x n and not empty, not of shape {matrix.shape}")
    k, n = matrix.shape
    columns = {"row": np.repeat(np.arange(k, dtype=np.int32), n), "id": np.tile(np.arange(n), k), "value": matrix.astype(float).ravel()}
    return spark.createDataFrame(pa.table(columns), VECTOR)


def to_array(result: DataFrame, k: int, n: int) -> np.ndarray:
    """k x n from a result; only for sizes that suit a driver."""
    found = result.select("row", "id", "value").toArrow()
    out = np.zeros((k, n))
    out[found["row"].to_numpy(), found["id"].to_numpy()] = found["value"].to_numpy()
    return out


def matmul(graph: GraphDataset, matrix: np.ndarray, direction: Direction | str, **how) -> np.ndarray:
    """``traverse`` with a k x n array in and an array out."""
    direction = Direction.parse(direction)
    spec = Spec(direction, how.get("by_individual", False), InitMode.parse(how.get("init_mode")), how.get("emit_all_nodes", False))
    spark = graph.nodes.sparkSession
    operand = to_vectors(spark, matrix)
    if matrix.shape[1] != operand_size(graph, spec):
        raise ValueError(f"the operand has {matrix.shape[1]} columns, not {operand_size(graph, spec)}")
    m = graph.meta
    width = m.num_nodes if spec.emit_all_nodes else m.num_mutations if direction is Direction.UP else m.num_individuals if spec.by_individual else m.num_samples
    return to_array(traverse(graph, operand, direction, **how).values, len(matrix), width)
