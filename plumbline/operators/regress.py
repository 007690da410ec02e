"""Least squares and its standard errors from distributed sufficient statistics.

The data is read twice: once for means and covariances, once with the fitted
coefficients as literals for residual-based sums. Only k x k matrices (k =
regressors) reach the driver. Columns are centred on their means, which leaves
slopes unchanged and keeps the sums accurate at any row count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.dist import t_ppf, t_sf2
from plumbline.functions.ordered import join_null_safe
from plumbline.session import SMALL_ROWS, broadcast_if_small, cut, release

MAX_LEVELS = 150


@dataclass
class Fit:
    """A fitted model: centred design frame, coefficients and the inverse cross-product."""

    frame: DataFrame          # columns _y, _x1.., plus kept ids
    names: list[str]          # slope names
    beta: np.ndarray          # intercept first, on centred columns
    minv: np.ndarray          # (X'X)^-1 including the intercept
    means: np.ndarray         # means of the slopes' columns
    ymean: float
    rss: float
    n: int
    dropped: int

    @property
    def k(self) -> int:
        return len(self.beta)

    @property
    def intercept(self) -> float:
        return float(self.ymean - self.means @ self.beta[1:])

    def back(self, v: np.ndarray) -> np.ndarray:
        """Variance on the original columns (the intercept is a combination of all terms)."""
        t = np.eye(self.k)
        t[0, 1:] = -self.means
        return t @ v @ t.T

    def index(self, param: str) -> int:
        return 1 + self.names.index(param)

    def x(self) -> list[Column]:
        return [F.lit(1.0)] + [F.col(f"_x{j + 1}") for j in range(len(self.names))]

    def residual(self) -> Column:
        e = F.col("_y")
        for j, b in enumerate(self.beta[1:]):
            e = e - F.lit(float(b)) * F.col(f"_x{j + 1}")
        return e

    def leverage(self) -> Column:
        x = self.x()
        h = F.lit(float(self.minv[0, 0]))
        for i in range(1, self.k):
            for j in range(i, self.k):
                h = h + F.lit(float(self.minv[i, j] * (1 if i == j else 2))) * x[i] * x[j]
        return h


def one_hot(df: DataFrame, col: str, cap: int = MAX_LEVELS) -> dict[str, Column]:
    """Indicator columns for all levels but the first; refuses more than `cap` levels."""
    levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(cap + 1).collect()]
    if len(levels) > cap:
        raise ValueError(f"{col} has more than {cap} levels; absorb it with within_fit instead")
    return {f"{col}={v}": (F.col(col) == F.lit(v)).cast("double") for v in sorted(levels)[1:]}


def interaction_key(*cols: str) -> Column:
    """One key for the combination of several fixed effects."""
    return F.concat_ws("^", *[F.col(c).cast("string") for c in cols])


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(values: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for (i, j), v in zip(_upper(k), values):
        m[i, j] = m[j, i] = v
    return m


def fit_ols(df: DataFrame, y: str | Column, xs: dict[str, Column] | Sequence[str], keep: Sequence[str] = ()) -> Fit:
    """Fit on complete cases; `keep` carries cluster or id columns along."""
    if not isinstance(xs, dict):
        xs = {c: F.col(c).cast("double") for c in xs}
    ycol = F.col(y) if isinstance(y, str) else y
    raw = df.select(ycol.cast("double").alias("_y"), *[c.cast("double").alias(f"_x{j + 1}") for j, c in enumerate(xs.values())], *keep)
    d = raw.dropna()
    cols = ["_y", *[f"_x{j + 1}" for j in range(len(xs))]]
    pairs = _upper(len(cols))
    # one pass gives the fit and the dropped rows: incomplete rows are masked, not filtered
    full = reduce(lambda a, b: a & b, [
        F.col(c).isNotNull() & ~F.isnan(c) if t in ("double", "float") else F.col(c).isNotNull() for c, t in raw.dtypes])
    whole = raw.select(full.alias("_full"), *[F.when(full, F.col(c)).alias(c) for c in cols])
    s = whole.agg(F.count("*").alias("total"), F.count_if("_full").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    n, k = s["n"], len(xs) + 1
    if n - k <= 0:
        raise ValueError("the model has as many parameters as rows, which leaves nothing to estimate a variance from")
    total = s["total"]
    cov = n * _symmetric([s[f"c{i}_{j}"] for i, j in pairs], len(cols))
    sxx, sxy = cov[1:, 1:], cov[1:, 0]
    inv = np.linalg.pinv(sxx, hermitian=True)
    b = inv @ sxy
    minv = np.zeros((k, k))
    minv[0, 0], minv[1:, 1:] = 1 / n, inv
    means = np.array([s[f"m{i}"] for i in range(len(cols))])
    centred = d.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(cols, means)], *keep)
    return Fit(centred, list(xs), np.concatenate([[0.0], b]), minv, means[1:], float(means[0]),
               float(cov[0, 0] - b @ sxy), n, total - n)


RUNG_SCHEMA = "param string, rung string, estimate double, se double, ci_lo double, ci_hi double, dof double, note string"


def rung(fit: Fit, name: str, v: np.ndarray, dof: float, params: Sequence[str] | None = None, note: str = "") -> list[tuple]:
    v = fit.back(v)
    out = []
    for p in params or fit.names:
        j = fit.index(p)
        est, se = float(fit.beta[j]), float(np.sqrt(max(v[j, j], 0)))
        crit = t_ppf(0.975, dof)
        out.append((p, name, est, se, est - crit * se, est + crit * se, float(dof), note))
    return out


def coefficients(df: DataFrame, fit: Fit) -> DataFrame:
    """Estimates, classical standard errors, p-values and the dropped-row count."""
    v = fit.back(fit.minv * fit.rss / (fit.n - fit.k))
    est = np.concatenate([[fit.intercept], fit.beta[1:]])
    rows = []
    for j, name in enumerate(["intercept", *fit.names]):
        se = float(np.sqrt(v[j, j]))
        t = float(est[j]) / se if se > 0 else float("nan")
        rows.append((name, float(est[j]), se, t, t_sf2(t, fit.n - fit.k) if se > 0 else None, fit.n, fit.dropped))
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, se double, t double, p double, n long, dropped long")


def hc_variances(fit: Fit) -> dict[str, np.ndarray]:
    """Classical and HC0 to HC3 variances from one pass over the rows.

    A row that is fitted exactly whatever its value (leverage 1) has no HC2 or HC3
    weight; those two are then not a number.
    """
    x, e2, h = fit.x(), F.pow(fit.residual(), 2), fit.leverage()
    weights = {"HC0": F.lit(1.0), "HC2": F.try_divide(F.lit(1.0), 1 - h), "HC3": F.try_divide(F.lit(1.0), F.pow(1 - h, 2))}
    aggs = [F.sum(e2 * w * x[i] * x[j]).alias(f"{n}_{i}_{j}") for n, w in weights.items() for i, j in _upper(fit.k)]
    s = fit.frame.agg(*aggs, F.max(h).alias("top")).first()
    out = {"iid": fit.minv * fit.rss / (fit.n - fit.k)}
    for n in weights:
        meat = _symmetric([s[f"{n}_{i}_{j}"] for i, j in _upper(fit.k)], fit.k)
        out[n] = fit.minv @ meat @ fit.minv
        if n != "HC0" and s["top"] > 1 - 1e-9:
            out[n] = np.full_like(out[n], np.nan)
    out["HC1"] = out["HC0"] * fit.n / (fit.n - fit.k)
    return out


def cluster_sums(fit: Fit, cluster: Sequence[str]) -> DataFrame:
    """Per cluster: rows, X'X (upper triangle), X'e; partial sums keep a hot cluster cheap."""
    x, e = fit.x(), fit.residual()
    return fit.frame.groupBy(*cluster).agg(
        F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"S{i}_{j}") for i, j in _upper(fit.k)],
        *[F.sum(x[i] * e).alias(f"s{i}") for i in range(fit.k)])


def cr_variances(fit: Fit, sums: DataFrame) -> tuple[dict[str, np.ndarray], int]:
    """CR0 and CR1 from the outer products of the cluster scores."""
    k = fit.k
    r = sums.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in _upper(k)]).first()
    g = r["g"]
    meat = _symmetric([r[f"m{i}_{j}"] for i, j in _upper(k)], k)
    v0 = fit.minv @ meat @ fit.minv
    return {"CR0": v0, "CR1": v0 * (g / (g - 1)) * ((fit.n - 1) / (fit.n - k))}, g


def _unpack(pdf: pd.DataFrame, k: int, prefix: str = "S") -> np.ndarray:
    m = np.zeros((len(pdf), k, k))
    for i, j in _upper(k):
        m[:, i, j] = m[:, j, i] = pdf[f"{prefix}{i}_{j}"].to_numpy()
    return m


def cr2_variance(fit: Fit, sums: DataFrame, params: Sequence[str]) -> tuple[np.ndarray, dict[str, float]]:
    """CR2 variance and Satterthwaite degrees of freedom per parameter.

    Needs only each cluster's X'X and X'e: the residual adjustment is carried by
    a k x k eigenproblem per cluster, whatever the cluster's size.
    """
    k, minv = fit.k, fit.minv
    w, q = np.linalg.eigh(minv)
    root = q @ np.diag(np.sqrt(np.clip(w, 0, None))) @ q.T
    cs = {p: minv[:, fit.index(p)] for p in params}
    names = [f"m{i}_{j}" for i in range(k) for j in range(k)]
    dof_names = [f"{stat}_{a}" for a in range(len(cs)) for stat in (
        ["am", "aa", "amm"] + [f"u{i}_{j}" for i in range(k) for j in range(k)])]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sg = _unpack(pdf, k)
            scores = np.column_stack([pdf[f"s{i}"].to_numpy() for i in range(k)])
            lam, vec = np.linalg.eigh(root @ sg @ root)
            lam = np.clip(lam, 0, None)
            live = lam > 1e-12
            gap = 1 - lam
            inv_root = np.where(gap <= 1e-10, 0.0, 1 / np.sqrt(np.where(gap <= 1e-10, 1.0, gap)))
            f = inv_root - 1
            safe = np.where(live, lam, 1.0)
            base = root @ vec

            def spread(coef):  # sum_j coef_j w_j w_j'
                return np.einsum("gij,gj,gkj->gik", base, np.where(live, coef, 0.0), base)

            kmat = spread(f / safe)
            k2 = spread((inv_root**2 - 1) / safe)
            adj = scores + np.einsum("gij,gjk,gk->gi", sg, kmat, scores)
            row = dict(zip(names, (adj.T @ adj).ravel()))
            for a, c in enumerate(cs.values()):
                sc = sg @ c
                u = sc + np.einsum("gij,gjk,gk->gi", sg, kmat, sc)
                ag = sc @ c + np.einsum("gi,gij,gj->g", sc, k2, sc)
                mg = np.einsum("gi,ij,gj->g", u, minv, u)
                stats = [float((ag - mg).sum()), float((ag**2).sum()), float((ag * mg).sum()), *(u.T @ u).ravel()]
                for nm, v in zip(dof_names[a * (3 + k * k):(a + 1) * (3 + k * k)], stats):
                    row[nm] = v
            yield pd.DataFrame([row])[names + dof_names]

    parts = sums.mapInPandas(partial, ", ".join(f"{c} double" for c in names + dof_names))
    s = parts.agg(*[F.sum(c).alias(c) for c in names + dof_names]).first()
    meat = np.array([s[c] for c in names]).reshape(k, k)
    dof = {}
    for a, p in enumerate(cs):
        u = np.array([s[f"u{i}_{j}_{a}"] for i in range(k) for j in range(k)]).reshape(k, k)
        mu = minv @ u
        dof[p] = float(s[f"am_{a}"] ** 2 / (s[f"aa_{a}"] - 2 * s[f"amm_{a}"] + np.trace(mu @ mu)))
    return minv @ meat @ minv, dof


def two_way_variance(fit: Fit, a: str, b: str) -> np.ndarray:
    """Clustering on two keys: variance by a plus by b minus by their intersection."""
    parts = [cr_variances(fit, cluster_sums(fit, key))[0]["CR0"] for key in ([a], [b], [a, b])]
    return parts[0] + parts[1] - parts[2]


def dfbetas(df: DataFrame, fit: Fit, row_id: str, threshold: float = 0.5) -> DataFrame:
    """Per term: the row whose removal moves it most (of equals the least `row_id`, of any sortable type), in HC1 standard errors.

    One scan after the fit gives the variance and the shifts. The leave-one-out shift has a closed form, so nothing is refitted; rows
    fitted exactly have no such shift and are left out.
    """
    x, e, h = fit.x(), fit.residual(), fit.leverage()
    ok = h < 1 - 1e-12
    aggs = [F.count_if(~ok).alias("exact"), *[F.sum(e * e * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in _upper(fit.k)]]
    for j, name in enumerate(fit.names, start=1):
        lin = sum((F.lit(float(fit.minv[j, i])) * x[i] for i in range(1, fit.k)), F.lit(float(fit.minv[j, 0])))
        shift = lin * e / (1 - h)
        aggs.append(F.min(F.when(ok, F.struct((-F.abs(shift)).alias("a"), F.col(row_id).alias("r"), shift.alias("s")))).alias(f"t{j}"))
    s = fit.frame.agg(*aggs).first()
    meat = _symmetric([s[f"m{i}_{j}"] for i, j in _upper(fit.k)], fit.k)
    v = fit.back(fit.minv @ meat @ fit.minv * fit.n / (fit.n - fit.k))
    rows = []
    for j, name in enumerate(fit.names, start=1):
        t, base, se = s[f"t{j}"], float(fit.beta[j]), float(np.sqrt(v[j, j]))
        if t is None:
            rows.append((name, base, None, None, None, None, False, s["exact"]))
            continue
        in_se = abs(t["s"]) / se if se > 0 else float("inf")
        rows.append((name, base, base - t["s"], t["r"], in_se, abs(t["s"]) / (abs(base) or 1.0), in_se >= threshold, s["exact"]))
    kind = fit.frame.schema[row_id].dataType.simpleString()
    kind = "long" if kind in ("tinyint", "smallint", "int") else kind
    return df.sparkSession.createDataFrame(
        rows, f"term string, estimate double, worst_loo double, row_id {kind}, in_ses double, shift double, flag boolean, n_exact long")


def leave_one_cluster_out(fit: Fit, cluster: str, params: Sequence[str]) -> DataFrame:
    """Range of each estimate over fits without one cluster: `(param, estimate, lo, hi, lo_cluster, hi_cluster)`."""
    k = fit.k
    sums = cluster_sums(fit, [cluster])
    total = np.linalg.inv(fit.minv)
    idx = [fit.index(p) for p in params]
    beta = fit.beta

    def solve(batches):
        for pdf in batches:
            rest = total[None] - _unpack(pdf, k)
            score = np.column_stack([pdf[f"s{i}"].to_numpy() for i in range(k)])
            # at the full fit X'e = 0, so dropping cluster g moves beta by -(X'X - S_g)^-1 s_g
            move = -(np.linalg.pinv(rest, hermitian=True) @ score[..., None])[..., 0]
            yield pd.DataFrame({"c": pdf[cluster].astype(str), **{f"b{j}": beta[j] + move[:, j] for j in idx}})

    loo = sums.mapInPandas(solve, "c string, " + ", ".join(f"b{j} double" for j in idx))
    a = loo.agg(*[x for j in idx for x in (F.min(F.struct(f"b{j}", "c")).alias(f"lo{j}"), F.max(F.struct(f"b{j}", "c")).alias(f"hi{j}"))])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(float(fit.beta[j])).alias("estimate"), F.col(f"lo{j}.b{j}").alias("lo"),
                 F.col(f"hi{j}.b{j}").alias("hi"), F.col(f"lo{j}.c").alias("lo_cluster"), F.col(f"hi{j}.c").alias("hi_cluster"))
        for p, j in zip(params, idx)])))


def cluster_imbalance(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters, largest over median size, and the largest cluster's share of rows."""
    g = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    # sizes repeat, so the median is taken over counts of counts
    c = g.groupBy("n").agg(F.count("*").alias("m"))
    return c.agg(F.sum("m").alias("clusters"), (F.max("n") / F.percentile("n", 0.5, F.col("m"))).alias("max_over_median"),
                 (F.max("n") / F.sum(F.col("n") * F.col("m"))).alias("largest_share"))


# ---- fixed effects -----------------------------------------------------------------------------------------

def absorb(cells: DataFrame, cols: Sequence[str], effects: Sequence[str], unit: Sequence[float], tol: float = 1e-8,
           max_iter: int = 500) -> tuple[dict[str, DataFrame], int]:
    """Coefficients of every level of the fixed effects for each column, by conjugate gradients, and the rounds it took.

    `cells` has a row per combination of levels: rows `_n` and sums `_s_<column>`. The
    normal equations in the levels are solved for all columns at once, scaled by the rows
    of a level; they are singular (constants may move between effects) but consistent. A
    round multiplies the table of cells with one direction per level, effect by effect,
    and writes tables as large as the number of levels; the driver sees sums only. Rounds
    grow with the square root of how badly the levels are connected, where alternating
    projections need its first power. Stops when the mean residual of no level exceeds
    `tol` standard deviations (`unit`).
    """
    named = lambda p: [f"_{p}_{c}" for c in cols]
    state = {e: cut(cells.groupBy(e).agg(F.sum("_n").alias("_n"), *[F.sum(f"_s_{c}").alias(f"_r_{c}") for c in cols]).withColumns(
        {f"_x_{c}": F.lit(0.0) for c in cols} | {f"_p_{c}": F.col(f"_r_{c}") / F.col("_n") for c in cols})) for e in effects}

    if len(effects) == 1:  # means of the level
        return {e: d.withColumns({f"_x_{c}": F.col(f"_r_{c}") / F.col("_n") for c in cols}) for e, d in state.items()}, 0
    size = reduce(DataFrame.unionByName, [state[e].select("_n", *named("r")) for e in effects])
    rz = size.agg(*[F.sum(F.col(f"_r_{c}") ** 2 / F.col("_n")).alias(c) for c in cols]).first()
    rz = [rz[c] or 0.0 for c in cols]
    for rounds in range(1, max_iter + 1):
        if not any(rz):
            return state, rounds - 1
        product = {}
        for e in effects:  # what a direction does to the level sums of one effect: its own rows, and the rows it shares with the others
            shared = None
            for o in effects:
                if o != e:
                    met = cells.select("_n", e, o).join(broadcast_if_small(state[o].select(o, *named("p")), SMALL_ROWS), o)
                    part = met.groupBy(e).agg(*[F.sum(F.col("_n") * F.col(f"_p_{c}")).alias(f"_q_{c}") for c in cols])
                    shared = part if shared is None else shared.unionByName(part)
            own = state[e].select(e, *[(F.col("_n") * F.col(f"_p_{c}")).alias(f"_q_{c}") for c in cols])
            q = (own if shared is None else own.unionByName(shared)).groupBy(e).agg(*[F.sum(f"_q_{c}").alias(f"_q_{c}") for c in cols])
            product[e] = cut(state[e].join(q, e))
        pq = reduce(DataFrame.unionByName, [product[e].select(*named("p"), *named("q")) for e in effects]).agg(*[F.sum(F.col(f"_p_{c}") * F.col(f"_q_{c}")).alias(c) for c in cols]).first()
        step = [z / pq[c] if z and pq[c] else 0.0 for z, c in zip(rz, cols)]
        moved = {e: d.withColumns({f"_x_{c}": F.col(f"_x_{c}") + F.lit(k) * F.col(f"_p_{c}") for k, c in zip(step, cols)} | {f"_r_{c}": F.col(f"_r_{c}") - F.lit(k) * F.col(f"_q_{c}") for k, c in zip(step, cols)}).drop(*named("q")) for e, d in product.items()}
        now = reduce(DataFrame.unionByName, [moved[e].select("_n", *named("r")) for e in effects]).agg(
            *[F.sum(F.col(f"_r_{c}") ** 2 / F.col("_n")).alias(f"z{i}") for i, c in enumerate(cols)], *[F.max(F.abs(F.col(f"_r_{c}")) / F.col("_n")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        done = [now[f"m{i}"] <= tol * u for i, u in enumerate(unit)]
        after = [0.0 if d else now[f"z{i}"] for i, d in enumerate(done)]  # a column that is settled stays as it is
        turn = [new / old if old else 0.0 for new, old in zip(after, rz)]
        new_state = {e: d.withColumns({f"_p_{c}": F.when(F.lit(z > 0), F.col(f"_r_{c}") / F.col("_n") + F.lit(k) * F.col(f"_p_{c}")).otherwise(0.0) for z, k, c in zip(after, turn, cols)}) for e, d in moved.items()}
        old, state, rz = state, {e: cut(d) for e, d in new_state.items()}, after
        release(*old.values(), *product.values())
        if all(done):
            return state, rounds
    raise RuntimeError("fixed effects did not converge")


def level_components(cells: DataFrame, effects: Sequence[str]) -> int:
    """Connected components of the levels of the first two effects, joined where they share a row: as many levels tell nothing new."""
    if len(effects) < 2:
        return 0
    from plumbline.operators.linkage import connected_components

    name = lambda i, e: F.concat(F.lit(f"{i}:"), F.col(e).cast("string"))
    edges = cells.select(name(0, effects[0]).alias("src"), name(1, effects[1]).alias("dst")).distinct()
    return connected_components(edges).select("component").distinct().count()


def within_fit(df: DataFrame, y: str, xs: Sequence[str], effects: Sequence[str], tol: float = 1e-8,
               max_iter: int = 500) -> DataFrame:
    """Slopes with any number of high-dimensional fixed effects absorbed.

    Rows are collapsed once to cells of the fixed effects, whose level coefficients
    `absorb` finds; residual cross-products follow from the level sums because residuals
    are orthogonal to every level. Degrees of freedom count every level but one for each
    connected component of the first two effects, and one for each further effect
    (with three and more effects a lower bound of what is redundant).
    """
    cols = [y, *xs]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols], *effects).dropna()
    st = d.agg(*[F.avg(c).alias(c) for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    d = d.select(*[(F.col(c) - F.lit(st[c])).alias(c) for c in cols], *effects)
    unit = [st[f"s_{c}"] or 1.0 for c in cols]  # convergence is judged in standard deviations
    cells = cut(d.groupBy(*effects).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in cols]))
    coef, _ = absorb(cells, cols, effects, unit, tol, max_iter)
    pairs = _upper(len(cols))
    total = d.agg(F.count("*").alias("n"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cross = np.array([total[f"c{i}_{j}"] for i, j in pairs])
    levels, singles = 0, 0
    for e in effects:
        j = cells.groupBy(e).agg(*[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in cols]).join(coef[e].select(e, "_n", *[f"_x_{c}" for c in cols]), e)
        r = j.agg(F.count("*").alias("g"), F.count_if(F.col("_n") == 1).alias("one"),
                  *[F.sum(F.col(f"_s_{cols[i]}") * F.col(f"_x_{cols[k]}")).alias(f"p{i}_{k}") for i, k in pairs]).first()
        cross -= np.array([r[f"p{i}_{k}"] for i, k in pairs])
        levels += r["g"]
        singles += r["one"]
    m = _symmetric(cross, len(cols))
    inv = np.linalg.pinv(m[1:, 1:], hermitian=True)
    b = inv @ m[1:, 0]
    spare = level_components(cells, effects) + max(0, len(effects) - 2)
    dof = total["n"] - len(xs) - levels + spare
    s2 = (m[0, 0] - b @ m[1:, 0]) / dof
    return df.sparkSession.createDataFrame(
        [(x, float(b[i]), float(np.sqrt(s2 * inv[i, i])), float(dof), int(levels), int(singles), int(total["n"])) for i, x in enumerate(xs)],
        "param string, estimate double, se double, dof double, levels long, singletons long, n long")


# ---- other estimators ------------------------------------------------------------------------------------------

def lin_adjusted(df: DataFrame, y: str, arm: str, covariates: Sequence[str]) -> DataFrame:
    """Experiment effect with the treatment fully interacted with centred covariates (HC2)."""
    means = df.select(y, arm, *covariates).dropna().agg(*[F.avg(c).alias(c) for c in covariates]).first()
    xs = {arm: F.col(arm).cast("double")}
    for c in covariates:
        xs[c] = F.col(c).cast("double") - F.lit(float(means[c]))
        xs[f"{arm}:{c}"] = F.col(arm).cast("double") * (F.col(c).cast("double") - F.lit(float(means[c])))
    fit = fit_ols(df, y, xs)
    rows = rung(fit, "HC2", hc_variances(fit)["HC2"], fit.n - fit.k, [arm])
    return df.sparkSession.createDataFrame(rows, RUNG_SCHEMA)


def iv_2sls(df: DataFrame, y: str, endogenous: str, instrument: str, controls: Sequence[str] = ()) -> DataFrame:
    """First stage, reduced form and two-stage estimate with HC1 standard errors, just identified."""
    cols = [y, endogenous, instrument, *controls]
    first = fit_ols(df.select(*cols).dropna(), endogenous, [instrument, *controls])
    reduced = fit_ols(df.select(*cols).dropna(), y, [instrument, *controls])
    v1, v2 = hc_variances(first)["HC1"], hc_variances(reduced)["HC1"]
    rows = []
    for stage, f, v in (("first_stage", first, v1), ("reduced_form", reduced, v2)):
        se = float(np.sqrt(v[1, 1]))
        rows.append((stage, float(f.beta[1]), se, (float(f.beta[1]) / se) ** 2, f.n))
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    mu = d.agg(*[F.avg(c).alias(c) for c in cols]).first()
    c = {x: F.col(x) - F.lit(mu[x]) for x in cols}
    xs, zs = [endogenous, *controls], [instrument, *controls]
    k = len(xs)
    s = d.agg(*[F.sum(c[z] * c[x]).alias(f"a{i}_{j}") for i, z in enumerate(zs) for j, x in enumerate(xs)],
              *[F.sum(c[z] * c[y]).alias(f"b{i}") for i, z in enumerate(zs)]).first()
    zx = np.array([[s[f"a{i}_{j}"] for j in range(k)] for i in range(k)])
    inv = np.linalg.inv(zx)
    beta = inv @ np.array([s[f"b{i}"] for i in range(k)])
    e = c[y] - sum((F.lit(float(b)) * c[x] for b, x in zip(beta, xs)), F.lit(0.0))
    m = d.agg(*[F.sum(e * e * c[zs[i]] * c[zs[j]]).alias(f"m{i}_{j}") for i, j in _upper(k)]).first()
    meat = _symmetric([m[f"m{i}_{j}"] for i, j in _upper(k)], k)
    v = inv @ meat @ inv.T * first.n / (first.n - k - 1)
    rows.append(("two_stage", float(beta[0]), float(np.sqrt(v[0, 0])), None, first.n))
    return df.sparkSession.createDataFrame(rows, "stage string, estimate double, se double, f_stat double, n long")


def collinearity(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation and the condition number of the correlation matrix, from one pass."""
    pairs = _upper(len(xs))
    d = df.select(*[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    s = d.agg(*[F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = _symmetric([s[f"c{i}_{j}"] for i, j in pairs], len(xs))
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    ev = np.linalg.eigvalsh(corr)
    cond = float(np.sqrt(ev[-1] / max(ev[0], 1e-300)))
    vif = np.diag(np.linalg.pinv(corr))
    big = np.abs(corr - np.eye(len(xs))).max(axis=1)
    return df.sparkSession.createDataFrame(
        [(x, float(vif[i]), float(big[i]), cond) for i, x in enumerate(xs)],
        "column string, vif double, max_abs_corr double, condition_number double")


def overlap(df: DataFrame, arm: str, xs: Sequence[str]) -> DataFrame:
    """Range of each column by arm, and the share of rows outside the common range."""
    g = df.agg(*[x for c in xs for x in (
        F.min(F.when(F.col(arm) == 1, F.col(c))).alias(f"l1_{c}"), F.max(F.when(F.col(arm) == 1, F.col(c))).alias(f"h1_{c}"),
        F.min(F.when(F.col(arm) == 0, F.col(c))).alias(f"l0_{c}"), F.max(F.when(F.col(arm) == 0, F.col(c))).alias(f"h0_{c}"))]).first()
    lo = {c: max(g[f"l1_{c}"], g[f"l0_{c}"]) for c in xs}
    hi = {c: min(g[f"h1_{c}"], g[f"h0_{c}"]) for c in xs}
    a = df.agg(*[F.avg((~F.col(c).between(F.lit(lo[c]), F.lit(hi[c]))).cast("double")).alias(c) for c in xs])
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(lo[c])).alias("common_lo"),
                                                F.lit(float(hi[c])).alias("common_hi"), F.col(c).alias("outside")) for c in xs])))


def subgroup_difference(df: DataFrame, y: str, x: str, split: str) -> DataFrame:
    """Slope of y on x in each level of a split, and every level's difference from the first with its own error."""
    d = df.where(F.col(split).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(F.col(split).cast("string").alias("level")).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("_yy"),
        F.regr_sxx(y, x).alias("_xx"), F.regr_sxy(y, x).alias("_xy"))
    g = g.withColumn("se", F.sqrt(F.try_divide((F.col("_yy") - F.col("slope") * F.col("_xy")) / (F.col("n") - 2), F.col("_xx"))))
    ref = g.agg(F.min_by("slope", "level").alias("_s0"), F.min_by("se", "level").alias("_e0"), F.min("level").alias("_l0"))
    j = g.join(F.broadcast(ref))
    same = F.col("level") == F.col("_l0")
    diff = F.col("slope") - F.col("_s0")
    dse = F.sqrt(F.pow("se", 2) + F.pow("_e0", 2))
    return j.select("level", "n", "slope", "se", F.when(~same, diff).alias("difference"), F.when(~same, dse).alias("difference_se"),
                    F.when(~same, F.try_divide(diff, dse)).alias("z"))


def shrink_means(df: DataFrame, by: str, y: str) -> DataFrame:
    """Empirical-Bayes group means: method-of-moments between variance, each mean pulled by its own noise."""
    g = df.where(F.col(by).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_samp(y).alias("_v"))
    a = g.agg(F.sum(F.col("n") * F.col("mean")).alias("_sm"), F.sum("n").alias("_n"), F.count("*").alias("_g"),
              (F.sum((F.col("n") - 1) * F.coalesce("_v", F.lit(0.0))) / F.sum(F.col("n") - 1)).alias("_within"),
              F.sum(F.col("n") * F.col("n")).alias("_nn"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_smm"))
    grand = F.col("_sm") / F.col("_n")
    between_ss = F.col("_smm") - F.col("_sm") * grand
    n0 = (F.col("_n") - F.col("_nn") / F.col("_n")) / (F.col("_g") - 1)
    tau2 = F.greatest((between_ss / (F.col("_g") - 1) - F.col("_within")) / n0, F.lit(0.0))
    a = a.select(grand.alias("grand_mean"), F.col("_within").alias("within_var"), tau2.alias("between_var"))
    j = g.join(F.broadcast(a))
    wt = F.col("between_var") / (F.col("between_var") + F.col("within_var") / F.col("n"))
    return j.select(by, "n", "mean", wt.alias("reliability"), (F.col("grand_mean") + wt * (F.col("mean") - F.col("grand_mean"))).alias("shrunk"))


def anderson_index(df: DataFrame, items: dict[str, int], key: str) -> tuple[DataFrame, dict[str, float]]:
    """Index weighting standardised items by the row sums of their inverse correlation matrix.

    `items` maps each column to +1 or -1, its favourable direction.
    """
    cols = list(items)
    s = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))],
               *[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in _upper(len(cols))]).first()
    sign = np.array([items[c] for c in cols])
    corr = _symmetric([s[f"r{i}_{j}"] for i, j in _upper(len(cols))], len(cols)) * np.outer(sign, sign)
    w = np.linalg.inv(corr).sum(axis=1)
    w = w / w.sum()
    expr = F.lit(0.0)
    for c, sg, wt in zip(cols, sign, w):
        expr = expr + F.lit(float(wt * sg)) * (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"])
    return df.select(key, expr.alias("index")), {c: float(x) for c, x in zip(cols, w)}


@F.pandas_udf(T.DoubleType())
def _t95(dof: pd.Series) -> pd.Series:
    known = {d: t_ppf(0.95, d) for d in dof.dropna().unique()}
    return dof.map(known)


def equivalence_test(estimates: DataFrame, delta: float) -> DataFrame:
    """Two one-sided tests at 5%: the 90% interval must lie inside (-delta, delta)."""
    crit = _t95(F.col("dof").cast("double"))
    lo, hi = F.col("estimate") - crit * F.col("se"), F.col("estimate") + crit * F.col("se")
    return estimates.select("param", "estimate", "se", lo.alias("lo90"), hi.alias("hi90"),
                            ((lo > -delta) & (hi < delta)).alias("equivalent"))


def specification_family(df: DataFrame, specs: dict[str, tuple[str, Sequence[str], Column | None]], param: str, published: str) -> DataFrame:
    """One estimate per specification (outcome, regressors, row condition) with its rank by magnitude."""
    rows = []
    for name, (y, xs, cond) in specs.items():
        d = df if cond is None else df.where(cond)
        f = fit_ols(d, y, xs)
        v = hc_variances(f)["HC1"]
        rows.append((name, float(f.beta[f.index(param)]), float(np.sqrt(v[f.index(param), f.index(param)])), f.n, name == published))
    rows.sort(key=lambda r: abs(r[1]))
    return df.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)],
                                           "spec string, estimate double, se double, n long, published boolean, rank int")
