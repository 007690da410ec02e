"""Sufficient-statistics inference against direct definitions on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.operators import ladder as L
from plumbline.operators import regress as R

N, G = 240, 12


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    g = np.concatenate([np.zeros(80, int), rng.integers(1, G, N - 80)])
    x1, x2 = rng.normal(5, 2, N), rng.exponential(1, N)
    y = 1 + 0.5 * x1 - 0.2 * x2 + rng.normal(0, 1, N) + rng.normal(0, 0.5, G)[g]
    pdf = pd.DataFrame({"id": np.arange(N), "g": g, "h": rng.integers(0, 5, N), "x1": x1, "x2": x2, "y": y})
    return pdf, spark.createDataFrame(pdf)


def design(pdf):
    return np.column_stack([np.ones(len(pdf)), pdf["x1"], pdf["x2"]]), pdf["y"].to_numpy()


def ols(X, y):
    M = np.linalg.inv(X.T @ X)
    b = M @ X.T @ y
    return b, M, y - X @ b


def test_coefficients_and_hc(data):
    pdf, df = data
    X, y = design(pdf)
    b, M, e = ols(X, y)
    c = R.coefficients(df, R.fit_ols(df, "y", ["x1", "x2"])).toPandas().set_index("term")
    np.testing.assert_allclose(c.loc[["intercept", "x1", "x2"], "estimate"], b, rtol=1e-9)
    np.testing.assert_allclose(c.loc[["intercept", "x1", "x2"], "se"], np.sqrt(np.diag(M) * (e @ e) / (N - 3)), rtol=1e-9)
    h = np.einsum("ij,jk,ik->i", X, M, X)
    lad = L.se_ladder(df, "y", ["x1", "x2"], ["x1"]).toPandas().set_index("rung")["se"]
    for name, w in {"HC0": np.ones(N), "HC2": 1 / (1 - h), "HC3": 1 / (1 - h) ** 2, "HC1": np.full(N, N / (N - 3))}.items():
        v = M @ (X.T * (w * e**2)) @ X @ M
        assert lad[name] == pytest.approx(np.sqrt(v[1, 1]), rel=1e-9)


def test_cr2_matches_definition(data):
    pdf, df = data
    X, y = design(pdf)
    b, M, e = ols(X, y)
    H = X @ M @ X.T
    adj, cols = {}, []
    meat = np.zeros((3, 3))
    for g in np.unique(pdf["g"]):
        ix = np.flatnonzero(pdf["g"] == g)
        w, v = np.linalg.eigh(np.eye(len(ix)) - H[np.ix_(ix, ix)])
        A = v @ np.diag(np.where(w > 1e-10, 1 / np.sqrt(np.clip(w, 1e-300, None)), 0)) @ v.T
        adj[g] = (ix, A)
        s = X[ix].T @ A @ e[ix]
        meat += np.outer(s, s)
    se = np.sqrt((M @ meat @ M)[1, 1])
    p = []
    for g, (ix, A) in adj.items():
        p.append((np.eye(N) - H)[:, ix] @ A @ X[ix] @ M[:, 1])
    P = np.column_stack(p).T @ np.column_stack(p)
    dof = np.trace(P) ** 2 / (P**2).sum()
    got = L.se_ladder(df, "y", ["x1", "x2"], ["x1"], "g").where("rung = 'CR2'").first()
    assert got["se"] == pytest.approx(se, rel=1e-8)
    assert got["dof"] == pytest.approx(dof, rel=1e-6)


def test_wild_bootstrap_matches_refits(data):
    pdf, df = data
    X, y = design(pdf)
    b, M, e = ols(X, y)
    got = L.wild_cluster_bootstrap(df, "y", ["x1", "x2"], "x2", "g", draws=299, seed=5).first()
    keys = df.select("g").distinct().withColumn("h", F.xxhash64(F.col("g").cast("string"))).toPandas().set_index("g")["h"]
    groups = np.unique(pdf["g"])
    signs = L._signs(keys.loc[groups].to_numpy(), 299, 5)

    def t_stat(res, est):
        s = np.array([X[pdf["g"] == g].T @ res[pdf["g"] == g] for g in groups])
        return est / np.sqrt((M @ s.T @ s @ M)[2, 2])

    def p_value(theta):
        Xr = X[:, :2]
        yr = y - theta * X[:, 2]
        br = np.linalg.lstsq(Xr, yr, rcond=None)[0]
        fit, res = Xr @ br + theta * X[:, 2], yr - Xr @ br
        obs, hits = abs(t_stat(e, b[2] - theta)), 0
        for d in range(299):
            v = signs[:, d][np.searchsorted(groups, pdf["g"])]
            bs, _, es = ols(X, fit + v * res)
            hits += abs(t_stat(es, bs[2] - theta)) >= obs - 1e-12
        return hits / 299

    assert float(got["note"].split("p = ")[1][:6]) == pytest.approx(p_value(0.0), abs=0.004)
    assert p_value(got["ci_hi"] + 0.02) <= 0.06 and p_value(got["ci_hi"] - 0.05) >= 0.04


def test_leverage_equals_refits(data):
    pdf, df = data
    X, y = design(pdf)
    b, _, _ = ols(X, y)
    loo = np.array([ols(np.delete(X, i, 0), np.delete(y, i))[0] for i in range(N)])
    r = R.dfbetas(df, R.fit_ols(df, "y", ["x1", "x2"], ["id"]), "id").toPandas().set_index("term")
    for j, t in ((1, "x1"), (2, "x2")):
        i = int(np.argmax(np.abs(b[j] - loo[:, j])))
        assert r.loc[t, "row_id"] == i
        assert r.loc[t, "worst_loo"] == pytest.approx(loo[i, j], rel=1e-9)
        e = y - X @ b
        M = np.linalg.inv(X.T @ X)
        hc1 = np.sqrt((M @ (X.T * e**2) @ X @ M)[j, j] * N / (N - 3))
        assert r.loc[t, "in_ses"] == pytest.approx(abs(b[j] - loo[i, j]) / hc1, rel=1e-9)
    named = df.withColumn("name", F.concat(F.lit("row "), F.col("id")))
    r2 = R.dfbetas(named, R.fit_ols(named, "y", ["x1", "x2"], ["name"]), "name").toPandas().set_index("term")
    assert list(r2["row_id"]) == [f"row {i}" for i in r["row_id"]]


def test_leave_one_cluster_out(data):
    pdf, df = data
    X, y = design(pdf)
    est = {g: ols(X[pdf["g"] != g], y[pdf["g"] != g])[0][1] for g in np.unique(pdf["g"])}
    r = R.leave_one_cluster_out(R.fit_ols(df, "y", ["x1", "x2"], ["g"]), "g", ["x1"]).first()
    assert r["lo"] == pytest.approx(min(est.values()), rel=1e-9) and r["hi"] == pytest.approx(max(est.values()), rel=1e-9)
    assert r["lo_cluster"] == str(min(est, key=est.get))


@pytest.mark.parametrize("effects", [["g"], ["g", "h"]])
def test_within_equals_dummies(data, effects):
    pdf, df = data
    D = np.column_stack([pd.get_dummies(pdf[e], drop_first=i > 0).to_numpy(float) for i, e in enumerate(effects)])
    X = np.column_stack([pdf[["x1", "x2"]], D])
    b, M, e = ols(X, pdf["y"].to_numpy())
    r = R.within_fit(df, "y", ["x1", "x2"], effects).toPandas().set_index("param")
    np.testing.assert_allclose(r.loc[["x1", "x2"], "estimate"], b[:2], rtol=1e-6)
    np.testing.assert_allclose(r.loc[["x1", "x2"], "se"], np.sqrt(np.diag(M)[:2] * (e @ e) / (N - X.shape[1])), rtol=1e-6)


def test_within_on_badly_connected_panels(spark):
    """A chain of firms joined by single movers, twice, without a link between the two: slopes, errors and degrees of freedom as with dummies."""
    rng = np.random.default_rng(3)
    rows = []
    for part in (0, 1):
        for k in range(12):
            for firm in (k, k + 1):
                for _ in range(2):
                    x = rng.normal() + 0.1 * k
                    rows.append((100 * part + k, 100 * part + firm, x, 2 * x + 0.3 * k - 0.2 * firm + rng.normal()))
    pdf = pd.DataFrame(rows, columns=["worker", "firm", "x", "y"])
    X = np.column_stack([pdf["x"], *[pd.get_dummies(pdf[e]).to_numpy(float) for e in ("worker", "firm")]])
    rank = np.linalg.matrix_rank(X)
    b = np.linalg.lstsq(X, pdf["y"].to_numpy(), rcond=None)[0]
    e = pdf["y"].to_numpy() - X @ b
    se = np.sqrt(np.linalg.pinv(X.T @ X)[0, 0] * (e @ e) / (len(pdf) - rank))
    df = spark.createDataFrame(pdf)
    r = R.within_fit(df, "y", ["x"], ["worker", "firm"]).first()
    assert r["dof"] == len(pdf) - rank and r["levels"] == 50
    assert r["estimate"] == pytest.approx(b[0], rel=1e-6) and r["se"] == pytest.approx(se, rel=1e-6)
    cells = df.groupBy("worker", "firm").agg(F.count("*").alias("_n"), F.sum("x").alias("_s_x"))
    _, rounds = R.absorb(cells, ["x"], ["worker", "firm"], [1.0])
    assert rounds <= 26  # alternating projections need hundreds on a chain of this length
    assert R.level_components(cells, ["worker", "firm"]) == 2 and R.level_components(cells, ["worker"]) == 0


def test_two_way_and_iv(data):
    pdf, df = data
    X, y = design(pdf)
    b, M, e = ols(X, y)

    def cr0(key):
        s = pd.DataFrame(X * e[:, None]).groupby(key).sum().to_numpy()
        return M @ s.T @ s @ M

    both = pdf["g"] * 100 + pdf["h"]
    want = cr0(pdf["g"].to_numpy()) + cr0(pdf["h"].to_numpy()) - cr0(both.to_numpy())
    v = R.two_way_variance(R.fit_ols(df, "y", ["x1", "x2"], ["g", "h"]), "g", "h")
    assert v[1, 1] == pytest.approx(want[1, 1], rel=1e-8)
    iv = R.iv_2sls(df, "y", "x1", "x2", ["h"]).toPandas().set_index("stage")["estimate"]
    Z = np.column_stack([np.ones(N), pdf["x2"], pdf["h"]])
    W = np.column_stack([np.ones(N), pdf["x1"], pdf["h"]])
    assert iv["two_stage"] == pytest.approx(np.linalg.solve(Z.T @ W, Z.T @ y)[1], rel=1e-8)


def test_refusals(spark, data):
    _, df = data
    with pytest.raises(ValueError, match="as many parameters as rows"):
        R.fit_ols(df.limit(2), "y", ["x1", "x2"])
    with pytest.raises(ValueError, match="levels"):
        R.one_hot(df, "id")
    with pytest.raises(ValueError, match="opt_in"):
        L.randomisation_inference(df, "y", "h")


def test_randomisation_keeps_assignments_and_size(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(300), "arm": (np.arange(300) % 3 == 0).astype(float), "z": rng.normal(size=300)})
    pdf["null"] = rng.normal(size=300)
    pdf["moved"] = pdf["null"] + 1.0 * pdf["arm"]
    df = spark.createDataFrame(pdf)
    a = L.randomisation_inference(df, "null", "arm", row_id="id", draws=99, opt_in=True).first()
    b = L.randomisation_inference(df, "moved", "arm", ["z"], row_id="id", draws=99, opt_in=True).first()
    assert a["p"] > 0.05 and b["p"] == pytest.approx(0.01) and b["draws"] == 99
    assert b["null_sd"] == pytest.approx(pdf["moved"].std() / np.sqrt(300 * 2 / 9), rel=0.3)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 97, 1000])
def test_permuted_slots_are_permutations(n):
    slots = L.permuted_slots(np.arange(n), n, range(60), 5)
    assert (np.sort(slots, axis=0) == np.arange(n)[:, None]).all()
    # one unit and one draw alone land where they land among all
    assert (L.permuted_slots(np.array([n - 1]), n, [7, 59], 5) == slots[n - 1, [7, 59]]).all()


def test_permuted_slots_are_near_uniform():
    draws, n = 24_000, 4
    got = L.permuted_slots(np.arange(n), n, range(draws), 11)
    seen = pd.Series([tuple(c) for c in got.T]).value_counts()
    assert len(seen) == 24 and ((seen - 1000) ** 2 / 1000).sum() < 55  # chi-squared of 23 degrees of freedom, p = 2e-4
    one = L.permuted_slots(np.array([123]), 1000, range(20_000), 3).ravel()
    assert ((np.bincount(one // 100, minlength=10) - 2000) ** 2 / 2000).sum() < 34


def test_randomisation_equals_refits(spark, monkeypatch):
    """Any number of assignments, any number of draws: dealt in passes or at once the same, and near plain permutations refitted."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": np.arange(60), "z": rng.normal(size=60), "y": rng.normal(size=60)})
    for dose in (np.arange(60) % 2 * 1.0, np.round(rng.normal(size=60), 1), rng.normal(size=60)):
        pdf["dose"] = dose
        df = spark.createDataFrame(pdf).repartition(3)
        whole = L.randomisation_inference(df, "y", "dose", ["z"], row_id="id", draws=2_100, opt_in=True).first()
        with monkeypatch.context() as m:
            m.setattr(L, "LEVELS_AT_ONCE", 25)
            m.setattr(L, "CELLS_AT_ONCE", 1_000)
            split = L.randomisation_inference(df, "y", "dose", ["z"], row_id="id", draws=2_100, opt_in=True).first()
        assert whole["draws"] == 2_100 and split["p"] == whole["p"] and split["null_sd"] == pytest.approx(whole["null_sd"], rel=1e-9)
        fit = lambda d: np.linalg.lstsq(np.column_stack([np.ones(60), pdf["z"], d]), pdf["y"], rcond=None)[0][2]
        assert whole["observed"] == pytest.approx(fit(dose), rel=1e-8)
        est = []
        for _ in range(2_100):
            est.append(fit(rng.permutation(dose)))
        assert whole["null_sd"] == pytest.approx(np.std(est), rel=0.06)
        assert whole["p"] == pytest.approx(np.mean(np.abs(est) >= abs(fit(dose))), abs=0.04)


def test_randomisation_of_clusters_against_all_assignments(spark):
    """Eight clusters, three treated: the p-value nears the share of all 56 assignments at least as extreme."""
    from itertools import combinations
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"g": rng.integers(0, 8, 400), "id": np.arange(400)})
    pdf["arm"] = pdf["g"].isin([1, 4, 6]).astype(float)
    pdf["y"] = rng.normal(size=400) + rng.normal(0, 1, 8)[pdf["g"]] + 0.8 * pdf["arm"]
    r = L.randomisation_inference(spark.createDataFrame(pdf), "y", "arm", cluster="g", row_id="id", draws=4_000, opt_in=True).first()
    gap = lambda t: (lambda m: pdf["y"][m].mean() - pdf["y"][~m].mean())(pdf["g"].isin(t))
    exact = np.mean([abs(gap(t)) >= abs(gap((1, 4, 6))) - 1e-12 for t in combinations(range(8), 3)])
    assert r["level"] == "cluster" and r["n_units"] == 8 and r["observed"] == pytest.approx(gap((1, 4, 6)))
    assert r["p"] == pytest.approx(exact, abs=0.03)


def weights_of(spark, units, draws, seed):
    """Poisson weights per unit, as the bootstrap draws them from each unit's own hash."""
    h = spark.createDataFrame([(str(u),) for u in units], "u string").select("u", F.xxhash64("u").alias("h")).collect()
    return dict(zip([r["u"] for r in h], L._poisson(np.array([r["h"] for r in h]), draws, seed)))


def weighted(X, y, w):
    return np.linalg.solve((X.T * w) @ X, (X.T * w) @ y)


def test_unit_bootstrap_equals_weighted_refits(spark, data):
    pdf, df = data
    X, y = design(pdf)
    w = weights_of(spark, range(G), 40, 7)
    got = L.unit_bootstrap(df, "g", "y", ["x1", "x2"], 40).toPandas().pivot(index="draw", columns="param", values="estimate")
    for b in range(40):
        np.testing.assert_allclose(got.loc[b, ["x1", "x2"]].astype(float), weighted(X, y, np.array([w[str(g)][b] for g in pdf["g"]]))[1:], rtol=1e-7)
    s = L.bootstrap_summary(spark.createDataFrame(got["x1"].rename("estimate").reset_index().assign(param="x1")), 50).first()
    assert (s["n_ok"], s["n_failed"]) == (40, 10) and s["se"] == pytest.approx(got["x1"].std())
    assert (s["lo"], s["hi"]) == pytest.approx(tuple(np.quantile(got["x1"], [0.025, 0.975])))


def test_two_sample_bootstrap_equals_weighted_refits(spark, data):
    pdf, _ = data
    rng = np.random.default_rng(5)
    pdf = pdf.assign(x=pdf["x1"] * 2 + rng.normal(0, 1, N), d=rng.integers(0, 2, N).astype(float))
    cal, tgt = pdf[pdf["id"] % 2 == 0], pdf[pdf["id"] % 2 == 1]
    got = L.two_sample_bootstrap(spark.createDataFrame(cal), spark.createDataFrame(tgt), "id", "x", "x1", ["x2"], "y", "d", 25).toPandas().set_index("draw")["estimate"]
    wc, wt = weights_of(spark, cal["id"], 25, 11), weights_of(spark, tgt["id"], 25, 12)
    one = lambda t, *c: np.column_stack([np.ones(len(t)), *[t[k] if isinstance(k, str) else k for k in c]])
    for b in range(25):
        gam = weighted(one(cal, "x1", "x2"), cal["x"].to_numpy(), np.array([wc[str(i)][b] for i in cal["id"]]))
        hat = one(tgt, "x1", "x2") @ gam
        # the prediction is a linear function of the proxy and the control, so all four columns stay independent
        beta = weighted(one(tgt, "d", hat, "x2"), tgt["y"].to_numpy(), np.array([wt[str(i)][b] for i in tgt["id"]]))
        assert got[b] == pytest.approx(beta[1], rel=1e-6)


def test_unusable_draws_are_counted(spark):
    """A regressor that is 1 in one unit only is fitted in the draws that hold this unit and no others."""
    from plumbline.operators import gates
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"u": np.arange(30), "x": (np.arange(30) == 4).astype(float), "y": rng.normal(size=30)})
    b = L.unit_bootstrap(spark.createDataFrame(pdf), "u", "y", ["x"], 200)
    usable = int((weights_of(spark, range(30), 200, 7)["4"] > 0).sum())
    assert 90 < usable < 160 and b.where("estimate IS NOT NULL").count() == usable
    for share, status in ((usable / 200, "pass"), ((usable + 1) / 200, "fail")):
        g = gates.draws_usable(b, F.col("estimate").isNotNull(), 200, share).first()
        assert (g["status"], g["observed"]) == (status, usable)
    with pytest.raises(gates.GateError, match="no draws"):
        gates.draws_usable(b, F.col("estimate").isNotNull(), 0)


def test_ladder_verdicts(spark):
    row = lambda p, name, se, lo, hi, dof=50.0: (p, name, 1.0, se, lo, hi, dof, "")
    lad = spark.createDataFrame([
        row("firm", "iid", 0.1, 0.8, 1.2), row("firm", "CR2", 0.2, 0.6, 1.4), row("firm", "wild cluster bootstrap", 0.25, 0.5, 1.5),
        row("moves", "iid", 0.1, 0.8, 1.2), row("moves", "CR2", 0.8, -0.6, 2.6), row("moves", "wild cluster bootstrap", 0.4, 0.1, 1.9),
        row("short", "iid", 0.5, -0.1, 2.1), row("short", "CR2", 0.6, -0.3, 2.3, 12.0)], R.RUNG_SCHEMA)
    facts = spark.createDataFrame([(100, 60, 0.004)], "clusters long, treated_clusters long, within_share double")
    got = {r["param"]: r for r in L.ladder_verdict(lad, facts).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"firm": "pass", "moves": "fail", "short": "abstain"}
    assert got["firm"]["se_ratio"] == pytest.approx(2.5) and got["moves"]["decision_moves"] and not got["firm"]["decision_moves"]
    assert {p for p, r in got.items() if r["few_clusters"]} == {"short"} and {p for p, r in got.items() if r["incomplete"]} == {"short"}
    assert {r["status"] for r in L.ladder_verdict(lad, facts, has_fe=True).collect()} == {"fail"}  # nothing varies within
    assert {r["param"]: r["status"] for r in L.ladder_verdict(lad, None, resampled=True).collect()} == {"firm": "pass", "moves": "fail", "short": "pass"}


def test_bootstrap_se_is_sensible(data):
    pdf, df = data
    X, y = design(pdf)
    b, M, e = ols(X, y)
    s = L.bootstrap_summary(L.unit_bootstrap(df, "id", "y", ["x1", "x2"], 199), 199).toPandas().set_index("param")
    assert s.loc["x1", "se"] == pytest.approx(np.sqrt((M @ (X.T * e**2) @ X @ M)[1, 1]), rel=0.25)
    assert s.loc["x1", "n_failed"] == 0


def test_benjamini_hochberg_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.uniform(0, 0.004, 30), rng.uniform(0, 1, 270)]), 4) + 1e-5
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(300), "p": p}))
    o = np.argsort(p)
    q = np.empty(300)
    q[o] = np.minimum.accumulate((p[o] * 300 / np.arange(1, 301))[::-1])[::-1]
    for limit in (20_000, 10):
        monkeypatch.setattr(L, "SMALL_ROWS", limit)
        got = L.benjamini_hochberg(df, "p", cells=8).toPandas().sort_values("i")
        np.testing.assert_allclose(got["q"], [q[p == x].min() for x in p], rtol=1e-9)


def test_benjamini_hochberg_sums_no_frame_anew_for_each_row(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") / 300.0 + 0.001).alias("p"))
    for limit in (20_000, 10):
        monkeypatch.setattr(L, "SMALL_ROWS", limit)
        assert "unboundedfollowing" not in L.benjamini_hochberg(df, "p", cells=8)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_romano_wolf_orders(spark):
    rng = np.random.default_rng(4)
    obs = spark.createDataFrame([("a", 5.0), ("b", -2.2), ("c", 0.1)], "hypothesis string, t double")
    t = rng.normal(size=(200, 3))
    draws = spark.createDataFrame([(d, h, float(t[d, i])) for d in range(200) for i, h in enumerate("abc")], "draw int, hypothesis string, t double")
    r = L.romano_wolf(obs, draws).toPandas().set_index("hypothesis")["p_adjusted"]
    a = np.abs(t)
    pa = (np.sum(a.max(1) >= 5.0) + 1) / 201
    pb = max(pa, (np.sum(a[:, 1:].max(1) >= 2.2) + 1) / 201)
    assert r["a"] == pytest.approx(pa) and r["b"] == pytest.approx(pb) and r["c"] >= r["b"]


@pytest.mark.parametrize("t,dof,p", [(2.228139, 10, 0.05), (1.959964, float("inf"), 0.05), (12.7062, 1, 0.05), (2.0, 5.5, 0.0966)])
def test_t_tail(t, dof, p):
    assert dist.t_sf2(t, dof) == pytest.approx(p, rel=2e-3)
    assert dist.t_ppf(1 - dist.t_sf2(t, dof) / 2, dof) == pytest.approx(t, rel=1e-6)


def test_chi2_tail():
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, rel=1e-5)
    assert dist.chi2_sf(18.30704, 10) == pytest.approx(0.05, rel=1e-5)
