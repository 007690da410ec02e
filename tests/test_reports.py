"""Reports and fits that SQL cannot state in one value: small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import design as D
from plumbline.operators import measure as M
from plumbline.operators import profile as P
from plumbline.operators import quality as Q
from plumbline.operators import regress as R


def test_dictionary_lists_values_ranges_and_codes(spark):
    rows = [(i, "ab"[i % 2], i + 0.5 if i % 10 else -999.0, None if i % 4 == 0 else i) for i in range(200)]
    d = {r["name"]: r for r in P.dictionary(spark.createDataFrame(rows, "id long, g string, x double, y int")).collect()}
    assert set(d) == {"id", "g", "x", "y"}
    assert d["g"]["values"] == "a | b" and d["g"]["type"] == "string" and d["g"]["n_missing"] == 0 and d["g"]["miss_kind"] == "none"
    assert d["id"]["values"] == "0 to 199" and d["y"]["values"] == "1 to 199" and d["y"]["n_missing"] == 50 and d["y"]["miss_kind"] == "TODO"
    assert d["x"]["missing_codes"] == "-999" and d["x"]["values"] == "-999.0 to 199.5"


def test_preview_shows_ends_and_commonest(spark):
    rows = [(i, "x" if i < 6 else "y", None if i == 0 else i * 10) for i in range(9)]
    d = {r["column"]: r for r in Q.preview(spark.createDataFrame(rows, "k int, g string, v int"), "k").collect()}
    assert d["k"]["first"] == "0 | 1 | 2" and d["k"]["last"] == "8 | 7 | 6" and (d["k"]["min"], d["k"]["max"]) == ("0", "8")
    assert d["g"]["common"] == "x | y" and d["g"]["type"] == "string"
    assert d["v"]["first"] == " | 10 | 20" and d["v"]["missing_share"] == pytest.approx(1 / 9)


def test_propensities_of_a_saturated_model(spark):
    """With one binary covariate the fitted score is the treated share of its cell."""
    rows = [(x, t, float(10 * x + 2 * t + i % 3)) for x, t, n in ((0, 0, 30), (0, 1, 10), (1, 0, 12), (1, 1, 36)) for i in range(n)]
    d = spark.createDataFrame(rows, "x int, t int, y double")
    s = D.propensity_scores(d, "t", ["x"], ["y"])
    got = {r["x"]: r["p"] for r in s.groupBy("x").agg(F.avg("ps").alias("p")).collect()}
    assert got[0] == pytest.approx(0.25, abs=1e-6) and got[1] == pytest.approx(0.75, abs=1e-6)
    e = D.ipw_effect(s, "t", "y").first()
    cell = {(x, t): np.mean([y for a, b, y in rows if (a, b) == (x, t)]) for x in (0, 1) for t in (0, 1)}
    share = {0: 40 / 88, 1: 48 / 88}
    assert e["effect"] == pytest.approx(sum(share[x] * (cell[x, 1] - cell[x, 0]) for x in (0, 1)), abs=1e-5)
    assert 0 < e["ess_treated"] <= 46 and 0 < e["ess_control"] <= 42


def test_omega_recovers_a_one_factor_model(spark):
    """Rows whose sample correlations are exactly those of the loadings."""
    load = np.array([0.9, 0.8, 0.7, 0.6])
    corr = np.outer(load, load)
    np.fill_diagonal(corr, 1.0)
    z = np.random.default_rng(0).normal(size=(200, 4))
    z -= z.mean(axis=0)
    z = z @ np.linalg.inv(np.linalg.cholesky(np.cov(z.T))).T @ np.linalg.cholesky(corr).T
    d = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double, c double, d double")
    r = {x["item"]: x for x in M.mcdonald_omega(d, list("abcd")).collect()}
    assert [r[c]["loading"] for c in "abcd"] == pytest.approx(load.tolist(), abs=1e-5)
    assert r["a"]["omega"] == pytest.approx(load.sum() ** 2 / (load.sum() ** 2 + (1 - load**2).sum()), abs=1e-5)
    with pytest.raises(RuntimeError, match="settle"):
        M.mcdonald_omega(d, list("abcd"), iterations=1)


def test_exactly_fitted_rows_have_no_leverage_corrected_error(spark):
    d = spark.createDataFrame([(float(i), float(i == 0), float(i % 5)) for i in range(30)], "y double, only double, x double")
    v = R.hc_variances(R.fit_ols(d, "y", ["only", "x"]))
    assert np.isfinite(v["HC1"]).all() and np.isnan(v["HC2"]).all() and np.isnan(v["HC3"]).all()


def test_equivalence_has_a_verdict_for_every_row(spark):
    d = spark.range(12_000).select(F.col("id").cast("string").alias("param"), F.lit(0.0).alias("estimate"), F.lit(0.1).alias("se"), (F.col("id") + 2).cast("double").alias("dof"))
    r = R.equivalence_test(d, 0.18).agg(F.count("equivalent").alias("n"), F.count_if("equivalent").alias("yes")).first()
    assert r["n"] == 12_000 and 0 < r["yes"] < 12_000
