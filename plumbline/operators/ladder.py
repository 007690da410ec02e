"""The standard-error ladder: every rung for one coefficient, resampling rungs and a verdict."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import running_total, with_cell
from plumbline.operators.regress import (RUNG_SCHEMA, _symmetric, _upper, cluster_sums, cr2_variance, cr_variances,
                                         fit_ols, hc_variances, rung)
from plumbline.operators.rollups import row_numbers
from plumbline.session import SMALL_ROWS, cut, release

FEW_CLUSTERS = 40
WITHIN_FLOOR = 0.01


def se_ladder(df: DataFrame, y: str, xs: dict[str, Column] | Sequence[str], params: Sequence[str],
              cluster: str | None = None) -> DataFrame:
    """Analytic rungs: iid, HC0 to HC3 and, with a cluster, CR0, CR1 and CR2."""
    fit = fit_ols(df, y, xs, [cluster] if cluster else [])
    rows = []
    for name, v in sorted(hc_variances(fit).items(), key=lambda kv: ("iid", "HC0", "HC1", "HC2", "HC3").index(kv[0])):
        rows += rung(fit, name, v, fit.n - fit.k, params)
    if cluster:
        sums = cluster_sums(fit, [cluster])
        vs, g = cr_variances(fit, sums)
        for name, v in vs.items():
            rows += rung(fit, name, v, g - 1, params)
        v2, dof = cr2_variance(fit, sums, params)
        for p in params:
            rows += rung(fit, "CR2", v2, dof[p], [p], "Satterthwaite degrees of freedom")
    return df.sparkSession.createDataFrame(rows, RUNG_SCHEMA)


ROWS_AT_ONCE = 2_000  # clusters or units whose draws are held in a task at one time


def _draw_hashes(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """64 well-spread bits for every key and draw."""
    with np.errstate(over="ignore"):
        step = (np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = np.asarray(keys, dtype=np.int64).view(np.uint64)[:, None] + step[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


def _signs(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """One row of +1/-1 per cluster, fixed by the cluster's own hash and the seed."""
    return (_draw_hashes(keys, draws, seed) >> np.uint64(63)).astype(float) * 2.0 - 1.0


def _poisson(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """One row of Poisson(1) weights per unit, fixed by the unit's own hash and the seed."""
    u = (_draw_hashes(keys, draws, seed) >> np.uint64(11)).astype(float) * 2.0**-53
    upto = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))
    return np.searchsorted(upto, u, "right").astype(float)


def _slices(batches):
    """Rows of a task, ROWS_AT_ONCE at a time."""
    for pdf in batches:
        for i in range(0, len(pdf), ROWS_AT_ONCE):
            yield pdf.iloc[i:i + ROWS_AT_ONCE]


def _drawn(total, cols: list[str], draws: int):
    """A task's sums as one row per draw; nothing from a task without rows."""
    if total is not None:
        o = pd.DataFrame(total, columns=cols)
        o.insert(0, "draw", np.arange(draws))
        yield o


def wild_cluster_bootstrap(df: DataFrame, y: str, xs: Sequence[str], param: str, cluster: str, draws: int = 999,
                           seed: int = 20231230, level: float = 0.95) -> DataFrame:
    """Null-imposed wild cluster bootstrap (variant 11, Rademacher): p-value and inverted interval.

    Every draw's estimate and variance are linear or quadratic in cluster sums,
    and those are linear in the hypothesised value. One distributed pass yields
    `draws x 4k` partial sums; the interval is then found without touching data.
    """
    fit = fit_ols(df, y, list(xs), [cluster])
    j, k = fit.index(param), fit.k
    q = fit.minv[:, j]
    # residuals of y and of the tested column on the other columns
    full = np.linalg.inv(fit.minv)
    others = [i for i in range(k) if i != j]
    xcols = fit.x()
    cross_y = full @ fit.beta
    inv_o = np.linalg.inv(full[np.ix_(others, others)])
    by, bx = inv_o @ cross_y[others], inv_o @ full[others, j]
    ey, ex = F.col("_y"), xcols[j]
    for b1, b2, o in zip(by, bx, others):
        ey, ex = ey - F.lit(float(b1)) * xcols[o], ex - F.lit(float(b2)) * xcols[o]
    g = fit.frame.withColumn("_ey", ey).withColumn("_ex", ex).groupBy(cluster).agg(
        *[F.sum(xcols[a] * xcols[b]).alias(f"S{a}_{b}") for a, b in _upper(k)],
        *[F.sum(xcols[a] * F.col("_ey")).alias(f"y{a}") for a in range(k)],
        *[F.sum(xcols[a] * F.col("_ex")).alias(f"x{a}") for a in range(k)]).withColumn("_h", F.xxhash64(F.col(cluster).cast("string")))
    cols = [f"{p}{a}" for p in ("R1_", "R2_", "D1_", "D2_") for a in range(k)]

    def partial(batches):
        total = None
        for pdf in _slices(batches):
            s = np.zeros((len(pdf), k, k))
            for a, b in _upper(k):
                s[:, a, b] = s[:, b, a] = pdf[f"S{a}_{b}"].to_numpy()
            ry = np.column_stack([pdf[f"y{a}"].to_numpy() for a in range(k)])
            rx = np.column_stack([pdf[f"x{a}"].to_numpy() for a in range(k)])
            v = _signs(pdf["_h"].to_numpy(), draws, seed)
            c = s @ q
            out = np.hstack([v.T @ ry, v.T @ rx, v.T @ ((ry @ q)[:, None] * c), v.T @ ((rx @ q)[:, None] * c)])
            total = out if total is None else total + out
        yield from _drawn(total, cols, draws)

    parts = g.mapInPandas(partial, "draw int, " + ", ".join(f"{c} double" for c in cols))
    d = np.array([[r[c] for c in cols] for r in parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in cols]).collect()])  # draws rows
    lin = lambda p: sum((F.lit(float(q[a])) * F.col(f"{p}{a}") for a in range(k)), F.lit(0.0))
    svec = [sum((F.lit(float(q[b])) * F.col(f"S{min(a, b)}_{max(a, b)}") for b in range(k)), F.lit(0.0)) for a in range(k)]
    t = g.withColumn("a1", lin("y")).withColumn("a2", lin("x")).withColumns({f"c{a}": e for a, e in enumerate(svec)}).agg(
        F.count("*").alias("g"), F.sum(F.col("a1") * F.col("a1")).alias("p11"), F.sum(F.col("a1") * F.col("a2")).alias("p12"),
        F.sum(F.col("a2") * F.col("a2")).alias("p22"), *[F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"C{a}_{b}") for a, b in _upper(k)]).first()
    cc = _symmetric([t[f"C{a}_{b}"] for a, b in _upper(k)], k)
    r1, r2, d1, d2 = (d[:, i * k:(i + 1) * k] for i in range(4))
    est = float(fit.beta[j])
    crve = float(np.sqrt(cr_variances(fit, cluster_sums(fit, [cluster]))[0]["CR0"][j, j]))

    def p_value(theta: float) -> float:
        delta = (r1 - theta * r2) @ fit.minv
        num = delta[:, j]
        sq = t["p11"] - 2 * theta * t["p12"] + theta**2 * t["p22"]
        var = sq - 2 * np.einsum("bi,bi->b", d1 - theta * d2, delta) + np.einsum("bi,ij,bj->b", delta, cc, delta)
        stat = np.abs(num) / np.sqrt(np.clip(var, 1e-300, None))
        return float(np.mean(stat >= abs(est - theta) / crve))

    def edge(direction: int) -> float:
        step = crve
        while p_value(est + direction * step) > 1 - level and step < 1e6 * crve:
            step *= 2
        if p_value(est + direction * step) > 1 - level:  # the test rejects nothing this far out: no bound was found
            return direction * float("inf")
        inner, outer = 0.0, step
        for _ in range(60):
            mid = (inner + outer) / 2
            if p_value(est + direction * mid) > 1 - level:
                inner = mid
            else:
                outer = mid
        return est + direction * (inner + outer) / 2

    lo, hi = edge(-1), edge(1)
    se = (hi - lo) / (2 * 1.959964)
    note = f"p = {p_value(0.0):.4f} (variant 11, Rademacher), interval by test inversion, B = {draws}"
    return df.sparkSession.createDataFrame([(param, "wild cluster bootstrap", est, se, lo, hi, float("inf"), note)], RUNG_SCHEMA)


CELLS_AT_ONCE = 1_000_000  # units x draws held in a task at one time
LEVELS_AT_ONCE = 1_000_000  # distinct assignments a task holds; more are handed out in further passes
ROUNDS = 10


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Well-spread bits of `x` under a key per column."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def permuted_slots(units: np.ndarray, n: int, draws: Sequence[int], seed: int) -> np.ndarray:
    """Where each unit number of 0..n-1 lands under the permutation of each draw: one row per unit, one column per draw.

    A Feistel network on a rectangle of at least n places, keyed by seed and draw;
    places beyond n are permuted on until they fall inside. No other unit is looked at.
    """
    wide = max(int(np.ceil(np.sqrt(n))), 1)
    w, t = np.uint64(wide), np.uint64(-(-n // wide))
    keys = _draw_hashes(np.arange(ROUNDS), max(draws) + 1, seed)[:, list(draws)]

    def step(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = x % w, x // w
        for i in range(0, ROUNDS, 2):
            left = (left + _mixed(right, keys[i][at]) % w) % w
            right = (right + _mixed(left, keys[i + 1][at]) % t) % t
        return right * w + left

    col = np.broadcast_to(np.arange(len(draws)), (len(units), len(draws)))
    x = step(np.repeat(np.asarray(units, dtype=np.uint64)[:, None], len(draws), axis=1), col)
    out = x >= n
    while out.any():
        x[out] = step(x[out], col[out])
        out = x >= n
    return x.astype(np.int64)


def _dealt_sums(units: DataFrame, levels: list, first: int, n: int, z: Sequence[str], draws: int, seed: int) -> pd.DataFrame:
    """Sums per draw of the assignments that `levels` (value, slots up to and with it) gives from slot `first` on."""
    values, upto = np.array([r["a"] for r in levels], dtype=float), np.array([r["upto"] for r in levels], dtype=np.int64)
    cols = [*[f"z_{c}" for c in z], "tt", "ty"]

    def sums(batches):
        total = None
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[lo:lo + ROWS_AT_ONCE]
                m, pos = part[[f"z_{c}" for c in z]].to_numpy(float), part["pos"].to_numpy()
                sy = part["sy"].to_numpy(float)
                total = np.zeros((draws, len(cols))) if total is None else total
                many = max(CELLS_AT_ONCE // len(part), 1)
                for d in range(0, draws, many):
                    at = range(d, min(d + many, draws))
                    slot = permuted_slots(pos, n, at, seed)
                    s = values[np.minimum(np.searchsorted(upto, slot, "right"), len(values) - 1)]
                    s = np.where((slot >= first) & (slot < upto[-1]), s, 0.0)
                    total[at.start:at.stop] += np.column_stack([s.T @ m, (s * s).T @ m[:, 0], s.T @ sy])
        yield from _drawn(total, cols, draws)

    out = units.select("pos", *[f"z_{c}" for c in z], "sy").mapInPandas(sums, "draw long, " + ", ".join(f"`{c}` double" for c in cols))
    return out.groupBy("draw").agg(*[F.sum(c).alias(c) for c in cols]).toPandas().set_index("draw").sort_index()


def randomisation_inference(df: DataFrame, y: str, arm: str, xs: Sequence[str] = (), cluster: str | None = None,
                            row_id: str | None = None, draws: int = 199, seed: str = "1234567",
                            opt_in: bool = False) -> DataFrame:
    """Permutation p-value for an assignment: `(p, draws, null_sd, observed, level, n_units)`.

    Whole clusters are permuted when the assignment never varies inside one,
    otherwise rows. Units are numbered, the assignments lie sorted on as many slots, and
    each draw sends every unit to a slot by a keyed permutation computed in the task
    (`permuted_slots`), so the multiset of assignments is kept exactly. Tasks emit a
    row of sums per draw; no table of units x draws exists. Above LEVELS_AT_ONCE distinct
    assignments the same draws are dealt in several passes.
    """
    if not opt_in:
        raise ValueError("randomisation inference describes the design; pass opt_in=True when the assignment was randomised")
    cols = [c for c in (y, arm, *xs) if c]
    ids = [c for c in (cluster, row_id) if c]
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols], *[F.col(c).cast("string").alias(f"_id_{c}") for c in ids]).dropna()
    mu = base.agg(*[F.avg(c).alias(c) for c in (y, *xs)]).first()
    base = base.select(arm, *[(F.col(c) - F.lit(mu[c])).alias(c) for c in (y, *xs)], *[f"_id_{c}" for c in ids])
    level = "row"
    if cluster:
        g = base.groupBy(f"_id_{cluster}").agg(F.min(arm).alias("a"), F.max(arm).alias("b"))
        level = "cluster" if g.where("a <> b").isEmpty() else "row"
    if level == "row" and not row_id:
        raise ValueError("permuting rows needs a row_id")
    unit = f"_id_{cluster if level == 'cluster' else row_id}"
    z = ["_1", *xs]
    units = base.withColumn("_1", F.lit(1.0)).groupBy(F.col(unit).alias("u")).agg(
        F.min(arm).alias("a"), *[F.sum(c).alias(f"z_{c}") for c in z], F.sum(y).alias("sy"))
    units = cut(units)  # one row per unit
    numbered = cut(row_numbers(units.withColumn("o", F.xxhash64("u").cast("double")), [], ["o", "u"]).select(
        (F.col("rn") - 1).alias("pos"), "a", *[f"z_{c}" for c in z], "sy"))  # read once per pass below
    release(units)
    moments = base.withColumn("_1", F.lit(1.0)).agg(
        *[F.sum(F.col(z[i]) * F.col(z[j])).alias(f"q{i}_{j}") for i, j in _upper(len(z))], *[F.sum(F.col(c) * F.col(y)).alias(f"r_{c}") for c in z]).first()
    zz = _symmetric([moments[f"q{i}_{j}"] for i, j in _upper(len(z))], len(z))
    zy = np.array([moments[f"r_{c}"] for c in z])
    inv = np.linalg.pinv(zz, hermitian=True)

    def effect(r) -> float:
        tz = np.array([r[f"z_{c}"] for c in z])
        den = r["tt"] - tz @ inv @ tz
        return (r["ty"] - tz @ inv @ zy) / den if den > 1e-12 else float("nan")

    seen = numbered.agg(F.count("*").alias("n"), *[F.sum(F.col("a") * F.col(f"z_{c}")).alias(f"z_{c}") for c in z],
                        F.sum(F.col("a") * F.col("a") * F.col("z__1")).alias("tt"), F.sum(F.col("a") * F.col("sy")).alias("ty")).first()
    n_units = seen["n"]
    if n_units == 0:
        raise ValueError("no complete rows to permute")
    levels = running_total(numbered.groupBy("a").agg(F.count("*").alias("k")), [], "a", {"upto": "k"}).select("a", "upto")
    levels = cut(row_numbers(levels, [], ["a"]))
    key = int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:4], "big")
    total, first = None, 0
    for lo in range(0, levels.count(), LEVELS_AT_ONCE):
        part = levels.where((F.col("rn") > lo) & (F.col("rn") <= lo + LEVELS_AT_ONCE)).orderBy("rn").collect()  # at most LEVELS_AT_ONCE rows
        more = _dealt_sums(numbered, part, first, n_units, z, draws, key)
        total, first = more if total is None else total + more, part[-1]["upto"]
    obs = effect(seen)
    good = np.array([v for v in (effect(r) for _, r in total.iterrows()) if np.isfinite(v)])
    release(numbered, levels)
    p = (np.sum(np.abs(good) >= abs(obs) * (1 - 1e-9)) + 1) / (len(good) + 1)
    return df.sparkSession.createDataFrame([(float(p), len(good), float(good.std(ddof=1)) if len(good) > 1 else float("nan"), float(obs), level, n_units)],
                                           "p double, draws int, null_sd double, observed double, level string, n_units long")


def design_facts(df: DataFrame, arm: str, cluster: str) -> DataFrame:
    """Clusters, treated clusters and the share of the assignment's variance that lies within clusters."""
    g = df.where(F.col(cluster).isNotNull() & F.col(arm).isNotNull()).groupBy(cluster).agg(
        F.count("*").alias("n"), F.avg(arm).alias("m"), F.var_pop(arm).alias("v"), F.max((F.col(arm) != 0).cast("int")).alias("t"))
    a = g.agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), F.sum("t").alias("treated_clusters"),
              F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    return a.select("clusters", "treated_clusters", F.try_divide(F.col("w"), F.col("w") + between).alias("within_share"))


def ladder_verdict(ladder: DataFrame, facts: DataFrame | None = None, has_fe: bool = False, resampled: bool = False) -> DataFrame:
    """Per parameter: spread of standard errors, whether the 5% decision moves, few-cluster and collapse flags."""
    rejects = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    g = ladder.groupBy("param").agg(
        F.count("*").alias("rungs"), F.min("se").alias("min_se"), F.max("se").alias("max_se"),
        F.sum(rejects.cast("int")).alias("n_reject"), F.min(F.when(F.col("rung") == "CR2", F.col("dof"))).alias("cr2_dof"),
        F.max(F.when(F.col("rung").rlike("bootstrap"), 1).otherwise(0)).alias("_boot"))
    if facts is not None:
        g = g.join(F.broadcast(facts))
    else:
        g = g.withColumns({"clusters": F.lit(None).cast("long"), "treated_clusters": F.lit(None).cast("long"), "within_share": F.lit(None).cast("double")})
    moves = (F.col("n_reject") > 0) & (F.col("n_reject") < F.col("rungs"))
    few = F.least(F.coalesce("clusters", F.lit(10**9)), F.coalesce("treated_clusters", F.lit(10**9)), F.coalesce("cr2_dof", F.lit(1e9))) < FEW_CLUSTERS
    collapsed = F.lit(has_fe) & F.coalesce(F.col("within_share") < WITHIN_FLOOR, F.lit(False))
    complete = (F.col("_boot") == 1) | F.lit(resampled)
    status = F.when(moves | collapsed, "fail").when(~complete, "abstain").otherwise("pass")
    return g.select("param", "rungs", F.try_divide("max_se", "min_se").alias("se_ratio"), moves.alias("decision_moves"),
                    few.alias("few_clusters"), collapsed.alias("collapsed"), "within_share", (~complete).alias("incomplete"), status.alias("status"))


GROUPED_RUNGS = ("CR0", "CR1", "CR2", "wild cluster bootstrap")  # rungs that sum over clusters


def table_note(ladder: DataFrame, reported: str, facts: DataFrame | None = None) -> DataFrame:
    """A sentence to print below a table, about the rung it reports: what it is, its degrees of freedom, and its clusters if it has any."""
    d = ladder.where(F.col("rung") == reported)
    parts = [F.concat(F.col("rung"), F.lit(" errors")), F.when(~F.col("dof").isin(float("inf")) & (F.col("dof") < 1e300), F.format_string("t with %.1f df", "dof"))]
    if facts is not None:
        d = d.join(F.broadcast(facts))
        parts.append(F.when(F.col("rung").isin(*GROUPED_RUNGS), F.format_string("%d clusters, %d of them with treated rows", "clusters", "treated_clusters")))
    return d.select("param", "rung", F.concat_ws("; ", *parts).alias("note"))


# ---- bootstrap draws ------------------------------------------------------------------------------------------

def bootstrap_moments(df: DataFrame, unit: str, cols: Sequence[str], draws: int, seed: int = 7) -> DataFrame:
    """Weighted cross-product sums of `cols` (with a constant) per draw, resampling whole units.

    Each unit gets a Poisson(1) weight per draw from its own hash, so draws are
    the same under any partitioning. Units are summed first; each task then emits
    one row of partial sums per draw, not one row per unit and draw.
    """
    d = df.select(F.col(unit).cast("string").alias("u"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    z = [F.lit(1.0), *[F.col(c) for c in cols]]
    pairs = _upper(len(z))
    names = [f"q{i}_{j}" for i, j in pairs]
    g = d.groupBy("u").agg(*[F.sum(z[i] * z[j]).alias(n) for (i, j), n in zip(pairs, names)]).withColumn("_h", F.xxhash64("u"))

    def partial(batches):
        total = None
        for pdf in _slices(batches):
            out = _poisson(pdf["_h"].to_numpy(), draws, seed).T @ pdf[names].to_numpy()
            total = out if total is None else total + out
        yield from _drawn(total, names, draws)

    return g.mapInPandas(partial, "draw int, " + ", ".join(f"{n} double" for n in names)).groupBy("draw").agg(
        *[F.sum(n).alias(n) for n in names])


def _draw_matrices(moments: DataFrame, k: int) -> np.ndarray:
    rows = moments.orderBy("draw").collect()  # one row per draw
    return np.stack([_symmetric([r[f"q{i}_{j}"] for i, j in _upper(k)], k) for r in rows])


def _slope(m: np.ndarray, xi: Sequence[int], yi: int, j: int) -> float:
    a = m[np.ix_(xi, xi)]
    if np.linalg.cond(a) > 1e12:
        return float("nan")
    return float(np.linalg.solve(a, m[xi, yi])[j])


def unit_bootstrap(df: DataFrame, unit: str, y: str, xs: Sequence[str], draws: int = 199, seed: int = 7) -> DataFrame:
    """Slope of each regressor in every draw: `(draw, param, estimate)`; a singular draw has a null estimate."""
    m = _draw_matrices(bootstrap_moments(df, unit, [*xs, y], draws, seed), len(xs) + 2)
    xi, yi = list(range(len(xs) + 1)), len(xs) + 1
    rows = []
    for b in range(len(m)):
        for j, x in enumerate(xs, start=1):
            v = _slope(m[b], xi, yi, j)
            rows.append((b, x, v if np.isfinite(v) else None))
    return df.sparkSession.createDataFrame(rows, "draw int, param string, estimate double")


def bootstrap_summary(draws_table: DataFrame, requested: int) -> DataFrame:
    """Standard error, percentile interval and failed draws per parameter."""
    return draws_table.groupBy("param").agg(
        F.count("estimate").alias("n_ok"), (F.lit(requested) - F.count("estimate")).alias("n_failed"),
        F.stddev_samp("estimate").alias("se"), F.percentile("estimate", 0.025).alias("lo"), F.percentile("estimate", 0.975).alias("hi"))


def two_sample_bootstrap(calibration: DataFrame, target: DataFrame, unit: str, x: str, proxy: str, controls: Sequence[str],
                         y: str, d: str, draws: int = 199, seed: int = 11) -> DataFrame:
    """Both stages re-run in every draw: x on proxy and controls in the first sample, then y on d, the prediction and controls.

    The second stage's cross-products are linear in those of the raw columns, so
    the predicted column never has to be built per draw.
    """
    mc = _draw_matrices(bootstrap_moments(calibration, unit, [proxy, *controls, x], draws, seed), len(controls) + 3)
    mt = _draw_matrices(bootstrap_moments(target, unit, [d, proxy, *controls, y], draws, seed + 1), len(controls) + 4)
    k = len(controls)
    rows = []
    for b in range(min(len(mc), len(mt))):
        a = mc[b][: k + 2, : k + 2]
        if np.linalg.cond(a) > 1e12:
            rows.append((b, d, None))
            continue
        gam = np.linalg.solve(a, mc[b][: k + 2, k + 2])  # constant, proxy, controls
        # raw columns: 1, d, proxy, controls.., y -> second stage: 1, d, prediction, controls.., y
        t = np.zeros((k + 4, k + 4))
        for i in (0, 1, *range(3, k + 4)):
            t[i, i] = 1.0
        t[2, 0], t[2, 2] = gam[0], gam[1]
        t[2, 3:k + 3] = gam[2:]
        m = t @ mt[b] @ t.T
        v = _slope(m, list(range(k + 3)), k + 3, 1)
        rows.append((b, d, v if np.isfinite(v) else None))
    return calibration.sparkSession.createDataFrame(rows, "draw int, param string, estimate double")


# ---- several hypotheses --------------------------------------------------------------------------------------------

def benjamini_hochberg(ptable: DataFrame, p: str, alpha: float = 0.05, cells: int | None = None) -> DataFrame:
    """Step-up rejections and q-values: adds `rank`, `q` and `reject`.

    A table of at most `SMALL_ROWS` hypotheses is ranked in one window; a larger
    one cell by cell.
    """
    # one row per hypothesis, read several times below
    tested = cut(ptable.where(F.col(p).isNotNull()))
    m = tested.count()
    if m <= SMALL_ROWS:
        up = Window.orderBy(p).rangeBetween(Window.unboundedPreceding, 0)
        j = tested.withColumn("rank", F.count("*").over(up))
        raw = F.col(p) * F.lit(float(m)) / F.col("rank")
        down = Window.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)  # a frame that ends open is summed anew for each row
        return j.withColumn("q", F.least(F.min(raw).over(down), F.lit(1.0))).withColumn("reject", F.col("q") <= alpha)
    # rank of a p-value = number of p-values not above it
    c = running_total(tested.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")), [], "_p", {"_rank": "_c"}, cells)
    c = c.withColumn("_raw", F.col("_p") * F.lit(float(m)) / F.col("_rank"))
    # q-value = smallest raw value at this p or above: a running minimum from the right
    c = running_min_from_right(c, "_p", "_raw", "_q", cells)
    j = tested.join(c.select("_p", F.col("_rank").alias("rank"), F.least(F.col("_q"), F.lit(1.0)).alias("q")), F.col(p) == F.col("_p")).drop("_p")
    return j.withColumn("reject", F.col("q") <= alpha)


def running_min_from_right(df: DataFrame, order: str, value: str, out: str, cells: int | None = None) -> DataFrame:
    """Smallest `value` among rows at or after each row, cell by cell."""
    d = with_cell(df, [], order, cells)
    per = d.groupBy("_cell").agg(F.min(value).alias("_m"))
    later = per.withColumn("_after", F.min("_m").over(Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    # read downwards: a frame that ends open is summed anew for each row
    w = Window.partitionBy("_cell").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    return (d.join(F.broadcast(later), "_cell").withColumn(out, F.least(F.min(value).over(w), F.col("_after"))).drop("_cell", "_split", "_after"))


def romano_wolf(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """Step-down adjusted p-values from resampled statistics.

    `observed` is `(hypothesis, t)`, `draws` is `(draw, hypothesis, t)` centred under
    the null. The k-th largest |t| is compared with the largest resampled |t|
    among the hypotheses not yet ahead of it.
    """
    obs = observed.withColumn("a", F.abs("t"))
    # hypotheses are a declared, short list; the window below sees one row each
    obs = obs.withColumn("step", F.row_number().over(Window.orderBy(F.desc("a"), "hypothesis")))
    w = Window.partitionBy("draw").orderBy(F.desc("step"))
    j = draws.withColumn("d", F.abs("t")).drop("t").join(F.broadcast(obs.select("hypothesis", "a", "step")), "hypothesis")
    j = j.withColumn("mx", F.max("d").over(w))
    p = j.groupBy("hypothesis", "step", "a").agg(((F.sum((F.col("mx") >= F.col("a")).cast("long")) + 1) / (F.count("*") + 1)).alias("p_raw"))
    return p.select("hypothesis", F.col("a").alias("abs_t"), F.max("p_raw").over(Window.orderBy("step")).alias("p_adjusted"))


def implied_bound(estimate: float, exposure: Column, df: DataFrame, bound: float) -> DataFrame:
    """Coefficient times total exposure against what the population could supply."""
    a = df.agg(F.sum(exposure).alias("exposure"))
    imp = F.lit(float(estimate)) * F.col("exposure")
    return a.select("exposure", imp.alias("implied"), F.lit(float(bound)).alias("bound"), (F.abs(imp) > F.abs(F.lit(float(bound)))).alias("impossible"))
