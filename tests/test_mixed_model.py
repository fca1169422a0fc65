import numpy as np
import pytest

from haplospark import fixture
from haplospark.operators import genotypes, mixed_model, pca, qc, solvers
from haplospark.operators.frequency import allele_frequencies
from haplospark.operators.relatedness import Relatedness
from haplospark.plans.strategy import Strategy
from haplospark.queries import _model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    k = _model(spark, SF)
    p = k.model.orderBy("mutation_id").toPandas()
    x = np.zeros((k.n, len(p)))
    at = {m: j for j, m in enumerate(p["mutation_id"])}
    for r in genotypes.dosages(k.graph).collect():
        if r["variant_id"] in at:
            x[r["individual_id"], at[r["variant_id"]]] = r["dosage"]
    return k, p, (x - x.mean(0)) * p["norm_scale"].to_numpy()


def test_products(panel):
    k, p, x = panel
    v = np.random.default_rng(0).standard_normal((k.n, 3))
    np.testing.assert_allclose(k.apply(v), x @ (x.T @ k.project(v)) / x.shape[1], atol=1e-8)
    left = p["chrom"].to_numpy() != 20
    np.testing.assert_allclose(k.apply(v, [20, 20, 20]), x[:, left] @ (x[:, left].T @ k.project(v)) / left.sum(), atol=1e-8)
    by_levels = Relatedness(k.graph, k.variants, k.basis, Strategy.LEVELS)
    np.testing.assert_allclose(by_levels.apply(v[:, :1], [19]), k.apply(v[:, :1], [19]), atol=1e-8)
    np.testing.assert_allclose(k.columns(p["mutation_id"][:3].tolist()), x[:, :3], atol=1e-8)
    np.testing.assert_allclose(k.score_squares(v), ((x.T @ k.project(v)) ** 2).sum(0))


def test_mixed_model_against_dense_algebra(spark, panel):
    k, p, x = panel
    y = mixed_model.simulate_phenotype(k, 0.4)
    assert abs(y.mean()) < 1e-12 and y.std() == pytest.approx(1)
    np.testing.assert_array_equal(y, mixed_model.simulate_phenotype(k, 0.4))
    fit = mixed_model.estimate_variances(k, y, max_iter=500)
    assert 0 < fit.h2 < 1 and fit.genetic > 0 and fit.noise == pytest.approx(fit.ratio * fit.genetic)
    cal = mixed_model.calibrate(k, y, fit, count=8)
    assert len(cal.table) == 8 <= cal.tried and cal.factor > 0
    py = k.project(y)
    for c in k.chromosomes:
        left = p["chrom"].to_numpy() != c
        h = x[:, left] @ x[:, left].T / left.sum() + fit.ratio * np.eye(k.n)
        exact = k.project(np.linalg.solve(h, py))
        assert np.linalg.norm(cal.solved[c] - exact) < 2e-3 * np.linalg.norm(exact)
    table = mixed_model.association(k, y, fit, cal).toPandas().set_index("mutation_id")
    score = x.T @ py
    for j, m in enumerate(p["mutation_id"]):
        assert table.loc[m, "chisq_linreg"] == pytest.approx(score[j] ** 2 / (py @ py) / (x[:, j] @ x[:, j]) * k.dim, rel=1e-6)
        assert table.loc[m, "chisq_lmm"] == pytest.approx((table.loc[m, "beta"] / table.loc[m, "se"]) ** 2, rel=1e-6)
    bad = table[~table.index.isin(p["mutation_id"])]
    assert (bad["chisq_lmm"] == -1e9).all() and (bad["p_lmm"] == 1).all() and (bad["beta"] == 0).all() and bad["se"].isna().all()
    residuals = mixed_model.loco_residuals(k, y, fit)
    assert set(residuals) == set(cal.solved)


def test_calibration_picks_are_those_of_one_stream(panel, monkeypatch):
    """Against a plain walk through the random numbers, also where numbers must be drawn ahead again and again."""
    from haplospark.functions.random_bits import Twister

    k, p, x = panel
    solved = k.project(np.random.default_rng(3).standard_normal(k.n))
    fit = mixed_model.Variances(0.0, 1.0, 0.5, solved)
    stat = dict(zip(p["global_idx"], (x.T @ solved) ** 2 / (solved @ solved) / (x * x).sum(0) * k.dim, strict=True))
    monkeypatch.setattr(mixed_model, "OUTLIER", float(np.median(list(stat.values()))))
    order, count = sorted(stat), 6
    edges = [order[-(-b * len(order) // count)] for b in range(count)] + [k.variants.count()]
    name, bits, want, tried = p.set_index("global_idx"), Twister(mixed_model.SEED + mixed_model.CALIBRATION_SEED), [], 0
    for low, high in zip(edges, edges[1:], strict=False):
        while True:
            m = low + bits.below_2_30() % (high - low)
            tried += m in stat
            if m in stat and stat[m] < mixed_model.OUTLIER:
                want.append((int(name.loc[m, "chrom"]), int(name.loc[m, "mutation_id"])))
                break
    assert mixed_model.pick_calibration(k, fit, count) == (want, tried)
    monkeypatch.setattr(mixed_model, "AHEAD", 1)
    assert mixed_model.pick_calibration(k, fit, count) == (want, tried)


def test_search_for_the_ratio():
    def at(f):
        def attempt(x):
            tried.append(x)
            return mixed_model.Trial(x, np.array([1.0, 1.0, np.exp(f(x))]), np.ones(3), np.zeros(1), 0.0)

        tried = []
        return attempt, tried

    attempt, tried = at(lambda x: 2 * x - 3)
    assert mixed_model.search_ratio(attempt, 0.0, lambda t: 1.0).log_ratio == pytest.approx(1.5) and len(tried) <= 7
    attempt, tried = at(lambda x: 1.0)  # flat: the first start
    assert mixed_model.search_ratio(attempt, 0.25, lambda t: 0.75).log_ratio == 0.25 and len(tried) == 2
    attempt, tried = at(lambda x: x - 0.001)  # a start is close enough
    assert mixed_model.search_ratio(attempt, 5.0, lambda t: 0.0).log_ratio == 0.0 and len(tried) == 2
    attempt, tried = at(lambda x: np.exp(x) + 1)  # no root: steps are bounded, and stay within the limits
    assert -10 <= mixed_model.search_ratio(attempt, 0.0, lambda t: -1.0).log_ratio <= 10 and len(tried) <= 7
    trial = mixed_model.Trial(0.0, np.array([1.0, 3.0, 8.0]), np.array([1.0, 1.0, 2.0]), np.zeros(1), 0.0)
    assert trial.gap() == pytest.approx(np.log(4 / 2)) and trial.jackknife == pytest.approx([np.log(4 / 3), np.log(4)])


def test_calibration_errors(panel):
    k, _, _ = panel
    fit = mixed_model.Variances(0.0, 1.0, 0.5, np.ones(k.n))
    with pytest.raises(ValueError, match="at least two"):
        mixed_model.pick_calibration(k, fit, 1)
    with pytest.raises(ValueError, match="model variants"):
        mixed_model.pick_calibration(k, fit, 10_000)


def test_pca(spark):
    g = fixture.graph(spark, SF)
    apply = pca.gram_operator(g)
    m = g.meta.num_mutations
    dense = apply(np.eye(m))
    np.testing.assert_allclose(dense, dense.T, atol=1e-6)
    exact = np.linalg.eigvalsh(dense)[::-1][:3]
    first = pca.principal_components(g, 3, "randomized", oversample=20, power=6)
    np.testing.assert_allclose(first.values, exact, rtol=1e-6)
    with pytest.raises(ValueError, match="solver"):
        pca.principal_components(g, 3, "magic")
    same, table = pca.components_by_people(g, 3, "randomized", oversample=20, power=6)
    np.testing.assert_allclose(same.values, exact, rtol=1e-6)
    v = np.zeros((m, 3))
    for r in table.collect():
        v[r["id"], r["row"]] = r["value"]
    np.testing.assert_allclose(v.T @ v, np.eye(3), atol=1e-6)
    assert solvers.largest_angle_sine(v, first.vectors) <= 1e-2 and (same.residuals < 1e-2).all()
    freqs = allele_frequencies(g).toPandas()
    assert ((freqs["sigma"] > 0) & (freqs["freq"] >= 0)).all()


def test_sample_components(panel):
    k, _, x = panel
    u, _, _ = np.linalg.svd(x, full_matrices=False)
    assert solvers.largest_angle_sine(pca.sample_components(k, 2), u[:, :2]) < 1e-6


def test_runs(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 9, 10)], "row bigint")
    assert sorted((r["first"], r["last"]) for r in qc.contiguous_runs(df).collect()) == [(1, 3), (7, 7), (9, 10)]


def test_solving_in_tasks(spark, panel, monkeypatch):
    """Columns solved each in a task go the same rounds as a block; no block comes to the driver."""
    k, p, _ = panel
    y, w = np.random.default_rng(3).standard_normal((2, k.n))
    m, c = int(p["mutation_id"][2]), int(p["chrom"][2])
    ratio, block, tasks = 0.7, solvers.CgReport(), solvers.CgReport()
    rhs = np.column_stack([y + ratio**0.5 * w, y, k.columns([m])[:, 0]])
    expected = solvers.conjugate_gradients(lambda v: k.apply(v, [None, 19, c]) + ratio * v, rhs, k.project, 1e-6, 100, block)
    found = mixed_model.solve_in_tasks(k, [(None, None), (19, None), (c, m)], ratio, 1e-6, 100, spark.sparkContext.broadcast([(y, w), (y, None)]), tasks)
    for r in found.collect():
        np.testing.assert_allclose(np.frombuffer(r["x"], float), expected[:, r["row"]], atol=1e-8)
    assert tasks.iterations == block.iterations
    for name in ("columns", "apply", "score_squares"):
        monkeypatch.setattr(Relatedness, name, lambda *a: pytest.fail("a block of vectors came to the driver"))
    mixed_model.calibrate(k, y, mixed_model.estimate_variances(k, y, max_iter=200), count=4)
