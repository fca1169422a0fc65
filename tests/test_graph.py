import random

import numpy as np
import pytest

from haplospark.operators import frequency
from haplospark.operators import graph as graphs
from haplospark.operators.graph import compile_graph
from haplospark.operators.many import traverse_many
from haplospark.operators.traverse import Requirements, Spec, matmul, prepare, to_vectors, traverse
from haplospark.plans import budget
from haplospark.plans.strategy import Strategy, choose
from haplospark.schema import Direction, InitMode
from haplospark.sources import store
from haplospark.streaming.operands import traverse_stream
from tests.test_kernel import paths, random_structure, selector

EDGES = "parent bigint, child bigint"
ROWS = "mutation_id bigint, node_id bigint, miss_node_id bigint"


def compiled(spark, s, coal=True):
    rows = [(int(m), int(n), None) for m, n in zip(*s.mut, strict=True)] + [(int(m), None, int(n)) for m, n in zip(*s.miss, strict=True)]
    coalescence = spark.createDataFrame([(n, int(c)) for n, c in enumerate(s.coal)], "node_id bigint, coal_count bigint") if coal else None
    edges = spark.createDataFrame([(int(p), int(c)) for p, c in zip(s.parent, s.child, strict=True)], EDGES)
    return compile_graph(edges, spark.createDataFrame(rows, ROWS), s.num_samples, s.num_nodes, s.ploidy, coalescence)


@pytest.fixture(scope="module")
def pair(spark):
    s = random_structure(np.random.default_rng(11))
    return s, compiled(spark, s)


@pytest.mark.parametrize("strategy", list(Strategy))
def test_strategies_equal_the_matrix(spark, pair, strategy):
    s, g = pair
    rng = np.random.default_rng(0)
    n, m, q = paths(s), selector(s, s.mut), selector(s, s.miss)
    v, w = rng.integers(-3, 4, (2, s.num_samples)).astype(float), rng.integers(-3, 4, (2, s.num_mutations)).astype(float)
    np.testing.assert_allclose(matmul(g, v, "up", strategy=strategy), v @ (m @ n)[:, : s.num_samples].T)
    np.testing.assert_allclose(matmul(g, w, "DOWN", strategy=strategy), (w @ m @ n)[:, : s.num_samples])
    np.testing.assert_allclose(matmul(g, v, "up", strategy=strategy, emit_all_nodes=True), v @ n[:, : s.num_samples].T)
    np.testing.assert_allclose(matmul(g, w, "down", strategy=strategy, by_individual=True, init_mode="xtx"), (w @ m @ n + 2 * s.coal @ n)[:, : s.num_samples].reshape(2, -1, 2).sum(2))
    got = traverse(g, to_vectors(spark, v), "up", miss=True, strategy=strategy)
    out = np.zeros((2, s.num_mutations))
    for r in got.missing.collect():
        out[r["row"], r["id"]] = r["value"]
    np.testing.assert_allclose(out, v @ (q @ n)[:, : s.num_samples].T)
    down = traverse(g, to_vectors(spark, w), "down", miss=to_vectors(spark, w + 1), strategy=strategy).values
    out = np.zeros((2, s.num_samples))
    for r in down.collect():
        out[r["row"], r["id"]] = r["value"]
    np.testing.assert_allclose(out, (w @ m @ n + (w + 1) @ q @ n)[:, : s.num_samples])


def test_bias_shortcut(spark, pair):
    s, g = pair
    n, m = paths(s), selector(s, s.mut)
    biased = g.with_bias()
    v = np.arange(s.num_samples, dtype=float)[None, :]
    init = spark.createDataFrame([(0, -1, 2.5)], "row int, id bigint, value double")
    expected = v @ (m @ n)[:, : s.num_samples].T + 2.5 * (m @ n).sum(1)
    for graph in (g, biased):
        np.testing.assert_allclose(matmul(graph, v, "up", init_mode="vector", init=init, strategy=Strategy.LEVELS), expected)


def test_levels_by_joins_equal_one_pass(spark, pair, monkeypatch):
    s, g = pair
    monkeypatch.setattr(graphs, "ONE_TASK_EDGES", 0)
    again = graphs.levels(g.edges, s.num_nodes, len(s.parent))
    assert sorted(map(tuple, again.collect())) == sorted((r["node_id"], r["level"]) for r in g.nodes.collect())
    loop = spark.createDataFrame([(1, 2), (2, 1)], EDGES)
    with pytest.raises(ValueError, match="cycle"):
        graphs.levels(loop, 3, 2)


def test_a_tall_graph(spark, monkeypatch):
    """Forty levels with edges that skip levels: settled and traversed level by level, as by the kernel."""
    rng = random.Random(1)
    node = lambda level, i: i if level == 0 else 10 + 2 * (level - 1) + i
    edges = {(node(h, i), node(h - 1, rng.randrange(10 if h == 1 else 2))) for h in range(1, 41) for i in range(2)} | {(node(h, 0), node(rng.randrange(h - 1), 0)) for h in range(2, 41, 3)}
    table = spark.createDataFrame(sorted(edges), "parent bigint, child bigint")
    rows = spark.createDataFrame([(k, 89 - k, None) for k in range(90)], "mutation_id bigint, node_id bigint, miss_node_id bigint")
    monkeypatch.setattr(graphs, "ONE_TASK_EDGES", 0)
    g = graphs.compile_graph(table, rows, 10, 90, 1)
    assert g.meta.height == 40
    x = np.random.default_rng(0).integers(-3, 4, (2, 10)).astype(float)
    np.testing.assert_allclose(matmul(g, x, "up", strategy=Strategy.LEVELS), matmul(g, x, "up", strategy=Strategy.KERNEL))


def test_positions(pair):
    _, g = pair
    rows = sorted((r["level"], r["node_id"], r["pos"]) for r in g.nodes.collect())
    assert [r[2] for r in rows] == list(range(len(rows)))


def test_validation(spark):
    edges = lambda *e: spark.createDataFrame(list(e), EDGES)
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    ok = rows((0, 3, None))
    with pytest.raises(ValueError, match="repeated edge"):
        compile_graph(edges((3, 0), (3, 0)), ok, 2, 4, 2)
    with pytest.raises(ValueError, match="leaves the graph"):
        compile_graph(edges((9, 0)), ok, 2, 4, 2)
    with pytest.raises(ValueError, match="cycle"):
        compile_graph(edges((3, 2), (2, 3)), ok, 2, 4, 2)
    with pytest.raises(ValueError, match="gaps"):
        compile_graph(edges((3, 0)), rows((0, 3, None), (2, 3, None)), 2, 4, 2)
    with pytest.raises(ValueError, match="not in the graph"):
        compile_graph(edges((3, 0)), rows((0, 7, None)), 2, 4, 2)
    with pytest.raises(ValueError, match="at least one sample"):
        compile_graph(edges((3, 0)), ok, 0, 4, 2)
    with pytest.raises(ValueError, match="coalescence"):
        compile_graph(edges((3, 0)), ok, 2, 4, 2, spark.createDataFrame([(0, 0)], "node_id bigint, coal_count bigint"))


def test_selectors_bag_and_set(spark):
    edges = spark.createDataFrame([(3, 0), (3, 1), (4, 3), (4, 2)], EDGES)
    rows = spark.createDataFrame([(0, 3, 4), (0, 4, 4), (1, None, None), (2, 3, 3), (2, 3, 3)], ROWS)
    g = compile_graph(edges, rows, 3, 5, 1)
    got = {r["mutation_id"]: (r["allele_count"], r["miss_count"]) for r in frequency.allele_counts(g).collect()}
    assert got == {0: (5, 3), 1: (0, 0), 2: (4, 2)}


def test_arguments(spark, pair):
    s, g = pair
    v = np.ones((1, s.num_samples))
    with pytest.raises(TypeError):
        matmul(g, [[1.0]], "up")
    with pytest.raises(ValueError, match="columns"):
        matmul(g, np.ones((1, 3)), "up")
    with pytest.raises(ValueError, match="not empty"):
        matmul(g, np.ones((0, 3)), "up")
    with pytest.raises(ValueError, match="direction"):
        matmul(g, v, "sideways")
    with pytest.raises(ValueError, match="all nodes"):
        prepare(g, Spec(Direction.UP, emit_all_nodes=True, miss=True))
    with pytest.raises(ValueError, match="exclude"):
        prepare(g, Spec(Direction.DOWN, init=InitMode.XTX, miss=True))
    with pytest.raises(ValueError, match="init table"):
        traverse(g, to_vectors(spark, v), "up", init_mode="vector")
    with pytest.raises(ValueError, match="coalescence"):
        prepare(compiled(spark, s, coal=False), Spec(Direction.UP, init=InitMode.XTX))
    with pytest.raises(IndexError):
        g.mutation(10_000)
    with pytest.raises(ValueError, match="needs the columns"):
        traverse(g, spark.createDataFrame([(1,)], "x int"), "up")


def test_store_round_trip(spark, pair, tmp_path):
    s, g = pair
    path = store.save(g.with_bias(), f"{tmp_path}/a.graph")
    scan = store.scan(spark, path)
    assert scan.meta == g.meta and sum(b["nnz"] for b in scan.blocks) == len(s.parent)
    back = store.load(spark, path)
    v = np.ones((1, s.num_samples))
    np.testing.assert_allclose(matmul(back, v, "up"), matmul(g, v, "up"))
    assert back.bias.count() == s.num_mutations + s.num_samples
    pairs = scan.level_pairs
    assert sum(store.block(spark, path, *p).count() for p in pairs) == len(s.parent)
    with pytest.raises(FileExistsError):
        store.save(g, path)
    with pytest.raises(ValueError, match="ends with"):
        store.scan(spark, f"{tmp_path}/a.npz")
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"{tmp_path}/b.graph")
    spark.createDataFrame([("other", 1, 1, 1, 1, 1, 1, 1, 1, False, False)], spark.read.parquet(f"{path}/meta").schema).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="not a graph store"):
        store.scan(spark, path)
    assert store.ensure(spark, path, lambda: g).meta == g.meta
    assert store.default_path("/x/y.tables", "/out") == "/out/x/y.graph" and store.default_path("/x/y", "/out", "z") == "/out/z.graph"
    assert [h.meta for h in store.load_many(spark, [path, path])] == [g.meta, g.meta]


def test_choice(pair):
    _, g = pair
    assert choose(g.meta) is Strategy.KERNEL and choose(g.meta, budget=10) is Strategy.LEVELS


def test_stream(spark, pair, tmp_path):
    s, g = pair
    rows = spark.createDataFrame([(k, [float(k)] * s.num_samples) for k in range(3)], "key bigint, values array<double>")
    expected = s.up(np.ones((1, s.num_samples)))[0][0]
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = traverse_stream(g, stream, "up").writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: r["values"] for r in spark.table("streamed").collect()}
    assert sorted(got) == [0, 1, 2]
    np.testing.assert_allclose(got[2], 2 * expected)


def test_requirements(spark, pair):
    s, g = pair
    two = to_vectors(spark, np.ones((2, s.num_samples)))
    with pytest.raises(RuntimeError, match="vectors"):
        prepare(g, Spec(Direction.UP), requirements=Requirements(max_rows_up=1))(two)
    assert prepare(g, Spec(Direction.UP), requirements=Requirements(max_rows_up=2))(two).values.count() == 2 * s.num_mutations
    with pytest.raises(RuntimeError, match="init mode"):
        prepare(g, Spec(Direction.UP, init=InitMode.XTX), requirements=Requirements(init_xtx=False))
    with pytest.raises(RuntimeError, match="missingness"):
        prepare(g, Spec(Direction.DOWN, miss=True), requirements=Requirements(miss_input=False))


def test_many_graphs_and_budget(spark, pair):
    s, g = pair
    x = to_vectors(spark, np.ones((1, s.num_samples)))
    got = traverse_many({"a": g, "b": g}, {"a": x, "b": x}, "up")
    assert got.count() == 2 * s.num_mutations and got.groupBy("id").agg({"value": "max", "*": "count"}).count() == s.num_mutations
    with pytest.raises(ValueError, match="operand"):
        traverse_many({"a": g}, {"b": x}, "up")
    assert {r["category"]: r["entries"] for r in budget.accounting(g).collect()}["edges"] == len(s.parent)
    order = [r["nnz"] for r in budget.promotion_order(g).collect()]
    assert order == sorted(order, reverse=True) and sum(order) == len(s.parent)


def test_convert(spark, pair, tmp_path):
    s, g = pair
    src = f"{tmp_path}/src"
    spark.createDataFrame([(s.num_samples, s.num_nodes, s.ploidy)], "num_samples bigint, num_nodes bigint, ploidy int").write.parquet(f"{src}/shape.parquet")
    g.edges.select("parent", "child").write.parquet(f"{src}/edges.parquet")
    rows = [(int(m), int(n), None) for m, n in zip(*s.mut, strict=True)] + [(int(m), None, int(n)) for m, n in zip(*s.miss, strict=True)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{src}/mutation_rows.parquet")
    path = store.convert(spark, src, f"{tmp_path}/out", "mine")
    assert path.endswith("/out/mine.graph")
    v = np.ones((1, s.num_samples))
    np.testing.assert_allclose(matmul(store.load(spark, path), v, "up"), matmul(g, v, "up"))


def test_compiling_sends_no_edges_to_the_driver(spark, monkeypatch):
    """Levels of a graph that one task can hold are found in that task."""
    from haplospark.operators.graph import compile_graph

    edges = spark.createDataFrame([(4, 0), (4, 1), (5, 4), (5, 2), (6, 5), (6, 3)], "parent bigint, child bigint")
    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(edges), name, lambda self: pytest.fail("a table was brought to the driver"))
    graph = compile_graph(edges, spark.createDataFrame([(0, 6, None)], "mutation_id bigint, node_id bigint, miss_node_id bigint"), 4, 7, 2)
    assert {r["node_id"]: r["level"] for r in graph.nodes.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3}
