"""Spark sums against a dense numpy fit, and the result rows."""

import math
import os

import numpy as np
import pytest
from dense_gee import dense_gee

from dayspan.functions.tails import chi2_tail
from dayspan.models.gee import AR1, EXCHANGEABLE, INDEPENDENCE, PreparedModels, gee_fit, gee_select
from dayspan.models.results import RESULT_SCHEMA, fit_report, gee_results, gee_sweep, result_rows
from dayspan.models.spec import ModelSpec, design

LEVELS = {"x": ["No", "Yes"], "g": ["a", "b", "c", "empty"]}
SCHEMA = "id int, day int, t double, x string, g string, y int"


def make(seed=0, clusters=60, largest=9, fixed=None):
    rng = np.random.default_rng(seed)
    rows, dense = [], []
    for i in range(clusters):
        n = fixed or int(rng.integers(1, largest))
        u = rng.normal()
        x = rng.integers(0, 2, n)
        g = rng.integers(0, 3, n)
        t = np.arange(n) / 5.0
        y = (rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * x + 0.3 * t + 0.4 * (g == 1) + u)))).astype(int)
        rows += [(i, j, float(t[j]), "Yes" if x[j] else "No", "abc"[g[j]], int(y[j])) for j in range(n)]
        dense.append((np.column_stack([np.ones(n), t, x, g == 1, g == 2]).astype(float), y.astype(float)))
    return rows, dense


def pick(dense, columns):
    return [(x[:, columns], y) for x, y in dense]


@pytest.fixture(scope="module")
def data(spark):
    rows, dense = make()
    return spark.createDataFrame(rows, SCHEMA).repartition(5), dense


@pytest.mark.parametrize("corr", [EXCHANGEABLE, AR1, INDEPENDENCE])
@pytest.mark.parametrize("cluster_rows", [0, 5, 10_000])
def test_fit_matches_dense(data, corr, cluster_rows):
    """All clusters in buckets, the larger ones in parts, or all in parts."""
    df, dense = data
    fit = gee_fit(df, ModelSpec("y", ("t", "x")), "id", ["day"], corr, LEVELS, cluster_rows)
    b, v, a = dense_gee(pick(dense, [0, 1, 2]), corr)
    assert fit.converged
    np.testing.assert_allclose(fit.beta, b, atol=1e-8)
    np.testing.assert_allclose(fit.covariance, v, atol=1e-9)
    assert fit.alpha == pytest.approx(a, abs=1e-8)
    assert fit.score_norm < 1e-8
    assert (fit.n_clusters, fit.n_obs) == (len(dense), sum(len(y) for _, y in dense))


def test_many_models_in_the_same_passes(data):
    df, dense = data
    specs = [ModelSpec("y", ("x",)), ModelSpec("y", ("t",)), ModelSpec("y", ("t", "g")), ModelSpec("y")]
    prepared = PreparedModels(df, specs, "id", ["day"], LEVELS)
    for corr in (EXCHANGEABLE, AR1):
        fits = prepared.fit(corr)
        for m, columns in enumerate(([0, 2], [0, 1], [0, 1, 3, 4], [0])):
            b, v, _ = dense_gee(pick(dense, columns), corr)
            known = np.isfinite(fits[m].beta)
            np.testing.assert_allclose(fits[m].beta[known], b, atol=1e-8)
            np.testing.assert_allclose(fits[m].std_error[known], np.sqrt(np.diag(v)), atol=1e-8)


def test_factor_only_rows_are_collapsed(data):
    df, dense = data
    prepared = PreparedModels(df, [ModelSpec("y", ("x",))], "id", ["day"], LEVELS, with_neighbours=False)
    assert prepared.data.count() < df.count()
    b, _, _ = dense_gee(pick(dense, [0, 2]), EXCHANGEABLE)
    np.testing.assert_allclose(prepared.fit(EXCHANGEABLE)[0].beta, b, atol=1e-8)
    with pytest.raises(ValueError):
        prepared.fit(AR1)


def test_clusters_of_one_row_agree_under_all_structures(spark):
    rows, _ = make(4, clusters=150, fixed=1)
    df = spark.createDataFrame(rows, SCHEMA)
    prepared = PreparedModels(df, [ModelSpec("y", ("x",))], "id", ["day"], LEVELS)
    fits = [prepared.fit(c)[0] for c in (EXCHANGEABLE, AR1, INDEPENDENCE)]
    for fit in fits[1:]:
        np.testing.assert_allclose(fit.beta, fits[0].beta, atol=1e-9)
        np.testing.assert_allclose(fit.covariance, fits[0].covariance, atol=1e-9)
    assert {f.alpha for f in fits} == {0.0}
    assert gee_select(df, [ModelSpec("y", ("x",))], "id", ["day"], LEVELS)[0].corr == EXCHANGEABLE


def test_selection_takes_the_smaller_qic(data):
    df, _ = data
    spec = ModelSpec("y", ("t", "x"))
    prepared = PreparedModels(df, [spec], "id", ["day"], LEVELS)
    qic = {c: prepared.fit(c)[0].qic for c in (EXCHANGEABLE, AR1)}
    assert gee_select(df, [spec], "id", ["day"], LEVELS)[0].corr == min(qic, key=qic.get)


def test_separated_predictor_falls_back_to_independence(spark):
    rows, _ = make(2)
    df = spark.createDataFrame([(*r[:5], int(r[3] == "Yes")) for r in rows], SCHEMA)
    fit = gee_select(df, [ModelSpec("y", ("x",))], "id", ["day"], LEVELS)[0]
    assert fit.corr == INDEPENDENCE
    assert len(result_rows(fit)) == 3


def separated(spark, n=360):
    """A predictor that tells the outcomes apart, one that does so on one side only, a constant, and two usual ones."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i // 6, i % 6, y, float(y), float(y and i % 3 == 0), 1.0, float(rng.normal()) + 0.5 * y, float(rng.normal())))
    return spark.createDataFrame(rows, "id int, day int, y int, same double, one_sided double, constant double, a double, b double")


def test_separation_is_recognized_and_marked(spark):
    df = separated(spark)
    names = ["same", "a", "one_sided", "constant", "b"]
    fits = gee_select(df, [ModelSpec("y", (n,)) for n in names], "id", ["day"])
    alone = gee_select(df, [ModelSpec("y", (n,)) for n in ("a", "b")], "id", ["day"])
    report = {r["model_formula"]: r for r in fit_report(spark, fits).collect()}
    assert {k: r["reason"] for k, r in report.items()} == {
        "y ~ same": "separated", "y ~ one_sided": "separated", "y ~ constant": "singular", "y ~ a": "converged", "y ~ b": "converged"}
    assert all(report[f"y ~ {n}"]["iterations"] < 15 for n in ("same", "one_sided", "constant"))
    assert [r["converged"] for r in report.values()] == [r["reason"] == "converged" for r in report.values()]
    assert report["y ~ same"]["corr_structure"] == INDEPENDENCE
    rows = {(r["model_formula"], r["term"]): r for r in gee_results(spark, fits, report=True).collect()}
    for name in ("same", "one_sided", "constant"):
        row = rows[f"y ~ {name}", name]
        assert all(row[c] is None for c in ("or", "or_ci_low", "or_ci_high", "beta_hat", "std_error", "wald_p_value", "anova_p_value", "QIC"))
        assert row["converged"] is False and row["n_obs"] == 360
    # The other side's rate is a finite estimate.
    rate = df.filter("one_sided = 0").agg({"y": "avg"}).first()[0]
    assert rows["y ~ one_sided", "(Intercept)"]["beta_hat"] == pytest.approx(math.log(rate / (1 - rate)), abs=1e-4)
    for fit, neighbour in zip(alone, (fits[1], fits[4])):
        assert neighbour.corr == fit.corr and neighbour.converged
        np.testing.assert_allclose(neighbour.beta, fit.beta, atol=1e-9)
        np.testing.assert_allclose(neighbour.std_error, fit.std_error, atol=1e-9)


def test_a_rare_event_is_not_taken_for_separation(spark):
    """One event among 20,000 has a finite solution far out; the same without it has none."""
    rows = [(i % 500, i, 0, float(i % 2)) for i in range(40_000)]
    rows += [(0, 50_000 + i, 1, 0.0) for i in range(9)] + [(1, 60_000, 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, day int, y int, x double")
    fit = gee_fit(df, ModelSpec("y", ("x",)), "id", ["day"], INDEPENDENCE)
    assert fit.reason == "converged" and fit.beta[1] == pytest.approx(math.log(1 / 20_000) - math.log(9 / 20_000), abs=1e-6)
    fit = gee_fit(df.filter("NOT (x = 1 AND y = 1)"), ModelSpec("y", ("x",)), "id", ["day"], INDEPENDENCE)
    assert fit.reason == "separated" and np.isnan(fit.beta[1]) and fit.beta[0] == pytest.approx(math.log(9 / 20_000), abs=1e-3)


def test_models_share_one_narrow_table(spark, tmp_path):
    """Eight models of the same columns take little more room than the largest of them, and know their own rows."""
    rng = np.random.default_rng(8)
    rows = [(i // 20, i % 20, float(rng.normal()), None if i % 7 == 0 else float(rng.normal()), float(rng.integers(0, 2)), int(rng.integers(0, 2)))
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, day int, a double, b double, c double, y int")
    sets = [("a", "b", "c"), ("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a", "b")]
    many = PreparedModels(df, [ModelSpec("y", s) for s in sets], "id", ["day"])
    one = PreparedModels(df, [ModelSpec("y", sets[0])], "id", ["day"])

    def size(prepared):
        root = prepared.data.stage_path.removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet"))

    assert many.class_of == [0, 1, 0, 1, 0, 1, 0, 0]
    assert many.data.count() == df.count() and one.data.count() == df.filter("b IS NOT NULL").count()
    # Two classes of rows (with and without b): the row before is kept for each.
    assert size(many) <= 1.5 * size(one)
    together, apart = many.fit(AR1), one.fit(AR1)
    np.testing.assert_allclose(together[0].beta, apart[0].beta, atol=1e-9)
    np.testing.assert_allclose(together[0].covariance, apart[0].covariance, atol=1e-9)
    for m in (1, 5, 6):
        single = gee_fit(df, ModelSpec("y", sets[m]), "id", ["day"], AR1)
        np.testing.assert_allclose(together[m].beta, single.beta, atol=1e-9)
        assert together[m].n_obs == single.n_obs


def test_a_pass_has_one_exchange(spark, data):
    df, _ = data
    prepared = PreparedModels(df, [ModelSpec("y", ("t", "x")), ModelSpec("y", ("x",))], "id", ["day"], LEVELS)
    for corr in (EXCHANGEABLE, AR1):
        zero = {m: np.zeros(len(prepared.columns[m])) for m in (0, 1)}
        plan = prepared.pass_frame(corr, [0, 1], zero, {0: 0.1, 1: 0.1})._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(m") == 1 and plan.count("Exchange ") == 1
    prepared.release()
    assert not os.path.exists(prepared.data.stage_path.removeprefix("file:"))


def test_many_models_fill_several_words(spark, data):
    df, _ = data
    specs = [ModelSpec("y", ("x",)) if i % 2 else ModelSpec("y", ("t",)) for i in range(130)]
    holes = df.selectExpr("id", "day", "IF(day % 3 = 1, NULL, t) AS t", "x", "y")
    prepared = PreparedModels(holes, specs, "id", ["day"], LEVELS)
    assert prepared.class_of == [i % 2 for i in range(130)]


def test_fit_statistics(data):
    df, dense = data
    fit = gee_fit(df, ModelSpec("y", ("t", "x")), "id", ["day"], AR1, LEVELS)
    quasi, omega = 0.0, np.zeros((3, 3))
    for x, y in pick(dense, [0, 1, 2]):
        mu = 1 / (1 + np.exp(-x @ fit.beta))
        quasi += np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))
        omega += x.T @ (x * (mu * (1 - mu))[:, None])
    cic = np.trace(omega @ fit.covariance)
    assert fit.quasi_likelihood == pytest.approx(quasi)
    assert fit.cic == pytest.approx(cic)
    assert fit.qic == pytest.approx(-2 * quasi + 2 * cic)
    assert fit.qicu == pytest.approx(-2 * quasi + 6)
    assert fit.qicc == pytest.approx(fit.qic + 24 / (fit.n_clusters - 4))


def test_result_rows(spark, data):
    df, _ = data
    fits = gee_select(df, [ModelSpec("y", ("t", "g"))], "id", ["day"], LEVELS)
    frame = gee_results(spark, fits)
    assert len(frame.columns) == 34 and frame.columns == [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    rows = frame.collect()
    assert [(r["predictor"], r["level"], r["level_number"], r["term_number"]) for r in rows] == [
        ("(Intercept)", None, None, None), ("t", None, None, 1), ("g", "a", 1, 2), ("g", "b", 2, 2), ("g", "c", 3, 2), ("g", "empty", 4, 2)]
    counts = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert [r["n_per_level"] for r in rows[2:]] == [counts["a"], counts["b"], counts["c"], 0]
    assert rows[2]["or"] is None and rows[2]["conf_level"] is None and rows[5]["or"] is None
    assert rows[3]["or"] == pytest.approx(math.exp(rows[3]["beta_hat"]))
    assert rows[3]["wald_p_value"] == pytest.approx(chi2_tail((rows[3]["beta_hat"] / rows[3]["std_error"]) ** 2, 1))
    fit = fits[0]
    b, v = fit.beta[[2, 3]], fit.covariance[np.ix_([2, 3], [2, 3])]
    assert rows[2]["anova_df"] == 2 and rows[2]["anova_chi_sq"] == pytest.approx(b @ np.linalg.solve(v, b))
    assert rows[0]["anova_p_value"] is None and {r["n_obs"] for r in rows} == {df.count()}


def test_missing_values_are_left_out_per_model(spark):
    rows, dense = make(6)
    holes = [(i, j, t if (i + j) % 3 else None, x, g, y) for i, j, t, x, g, y in rows]
    df = spark.createDataFrame(holes, SCHEMA)
    prepared = PreparedModels(df, [ModelSpec("y", ("t",)), ModelSpec("y", ("x",))], "id", ["day"], LEVELS)
    fits = prepared.fit(AR1)
    kept = []
    for i, (x, y) in enumerate(dense):
        keep = [(i + j) % 3 != 0 for j in range(len(y))]
        if any(keep):
            kept.append((x[keep][:, [0, 1]], y[keep]))
    np.testing.assert_allclose(fits[0].beta, dense_gee(kept, AR1)[0], atol=1e-8)
    assert fits[0].n_obs == sum(len(y) for _, y in kept) < fits[1].n_obs


def test_sweep(spark, data):
    df, dense = data
    single, adjusted = gee_sweep(df, "y", ["x", "g"], ["t"], "id", ["day"], LEVELS)
    assert [r[0] for r in single.select("model_formula").distinct().orderBy("model_formula").collect()] == ["y ~ g", "y ~ t", "y ~ x"]
    assert {r[0] for r in adjusted.select("model_formula").distinct().collect()} == {"y ~ t + x", "y ~ t + g"}
    row = adjusted.filter("model_formula = 'y ~ t + x' AND term = 'xYes'").first()
    b, _, _ = dense_gee(pick(dense, [0, 1, 2]), row["corr_structure"])
    assert row["beta_hat"] == pytest.approx(b[2], abs=1e-8)


def test_spec():
    assert ModelSpec("y").formula == "y ~ 1"
    assert ModelSpec("y", ("",)).formula == "y ~ 1"
    assert ModelSpec("y", ("a", "b", "a")).formula == "y ~ a + b"
    spec = ModelSpec.with_interaction("y", ["a", "b"], "z")
    assert spec.formula == "y ~ a*z + b*z" and spec.interaction_text == "a*z, b*z" and spec.predictor_text == "a, b, z"
    assert spec.terms == [("a",), ("z",), ("b",), ("a", "z"), ("z", "b")]
    with pytest.raises(ValueError):
        ModelSpec.with_interaction("y", ["a"], None)


def test_interaction_columns(spark, data):
    df, dense = data
    spec = ModelSpec.with_interaction("y", ["t"], "x")
    assert [c.name for c in design(spec, LEVELS)] == ["(Intercept)", "t", "xYes", "t:xYes"]
    fit = gee_fit(df, spec, "id", ["day"], EXCHANGEABLE, LEVELS)
    products = [(np.column_stack([x[:, :3], x[:, 1] * x[:, 2]]), y) for x, y in dense]
    np.testing.assert_allclose(fit.beta, dense_gee(products, EXCHANGEABLE)[0], atol=1e-8)
    assert [r["term"] for r in result_rows(fit)] == ["(Intercept)", "t", "xNo", "xYes", "t:xYes"]
