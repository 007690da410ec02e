"""Reliability and validity of measured variables, and correction of surrogate labels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.regress import RUNG_SCHEMA, _symmetric, _upper, fit_ols, hc_variances, rung


def _covariance(df: DataFrame, items: Sequence[str]) -> tuple[np.ndarray, int]:
    d = df.select(*[F.col(c).cast("double").alias(c) for c in items]).dropna()
    s = d.agg(F.count("*").alias("n"), *[F.covar_samp(items[i], items[j]).alias(f"c{i}_{j}") for i, j in _upper(len(items))]).first()
    return _symmetric([s[f"c{i}_{j}"] for i, j in _upper(len(items))], len(items)), s["n"]


def _alpha(c: np.ndarray) -> float:
    k = len(c)
    return float(k / (k - 1) * (1 - np.trace(c) / c.sum())) if k > 1 else float("nan")


def cronbach_alpha(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Alpha, alpha without each item, and each item's correlation with the sum of the others."""
    c, n = _covariance(df, items)
    rows = [("all", _alpha(c), None, n)]
    for i, item in enumerate(items):
        keep = [j for j in range(len(items)) if j != i]
        rest = c[np.ix_(keep, keep)]
        rows.append((item, _alpha(rest), float(c[i, keep].sum() / np.sqrt(c[i, i] * rest.sum())), n))
    return df.sparkSession.createDataFrame(rows, "item string, alpha double, item_rest_corr double, n long")


def mcdonald_omega(df: DataFrame, items: Sequence[str], iterations: int = 500) -> DataFrame:
    """Omega total of a one-factor model fitted to the item correlations, with the loadings."""
    c, n = _covariance(df, items)
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    load = np.zeros(len(items))
    for _ in range(iterations):
        m = r.copy()
        np.fill_diagonal(m, h)
        w, v = np.linalg.eigh(m)
        load = v[:, -1] * np.sqrt(max(w[-1], 0))
        if load.sum() < 0:
            load = -load
        new = np.clip(load**2, 0, 0.999)
        if np.abs(new - h).max() < 1e-10:
            break
        h = new
    else:
        raise RuntimeError(f"the one-factor model did not settle in {iterations} rounds")
    omega = float(load.sum() ** 2 / (load.sum() ** 2 + (1 - load**2).sum()))
    return df.sparkSession.createDataFrame([(x, float(l), omega, n) for x, l in zip(items, load)], "item string, loading double, omega double, n long")


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by pair of codes, for items both coded."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Raw agreement, expected agreement and kappa."""
    c = confusion(df, a, b)
    t = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ra = c.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x"))
    rb = c.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    e = ra.join(rb, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    return t.join(F.broadcast(e)).select("n", po.alias("agreement"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def codes_long(df: DataFrame, item: str, coders: Sequence[str]) -> DataFrame:
    """`(item, coder, value)` from one column per coder, missing codes left out."""
    return df.select(F.col(item).alias("item"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("coder"), F.col(c).cast("double").alias("value")) for c in coders]))).where("value is not null")


def fleiss_kappa(long: DataFrame) -> DataFrame:
    """Fleiss' kappa over items coded by every coder."""
    m = long.select("coder").distinct().count()
    c = long.groupBy("item", "value").agg(F.count("*").alias("c"))
    it = c.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s")).where(F.col("m") == m)
    p = it.agg(F.count("*").alias("n"), (F.avg(F.col("s") / (m * (m - 1.0)))).alias("observed"))
    share = c.join(it.select("item"), "item", "left_semi").groupBy("value").agg(F.sum("c").alias("c"))
    e = share.agg((F.sum(F.col("c").cast("double") * F.col("c")) / F.pow(F.sum("c"), 2)).alias("expected"))
    return p.join(F.broadcast(e)).select("n", "observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def krippendorff_alpha(long: DataFrame) -> DataFrame:
    """Nominal alpha overall and per category, and interval alpha; missing codes allowed.

    Disagreement sums have closed forms in per-item counts and moments, so no
    pairs of codes are built.
    """
    c = long.groupBy("item", "value").agg(F.count("*").alias("c"))
    it = c.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.col("value")).alias("x"),
                               F.sum(F.col("c") * F.col("value") * F.col("value")).alias("xx")).where("m >= 2")
    t = it.agg(F.sum("m").cast("double").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("do"),
               F.sum(2 * (F.col("m") * F.col("xx") - F.col("x") * F.col("x")) / (F.col("m") - 1)).alias("di"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    cat = c.join(it.select("item", "m"), "item").groupBy("value").agg(
        F.sum("c").cast("double").alias("nc"), F.sum(2 * F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("dc"))
    e = cat.agg(F.sum(F.col("nc") * F.col("nc")).alias("nn"))
    n = F.col("n")
    j = t.join(F.broadcast(e))
    overall = j.select(F.inline(F.array(
        F.struct(F.lit("nominal").alias("scale"), F.lit(None).cast("double").alias("category"),
                 (1 - (n - 1) * F.try_divide(F.col("do"), n * n - F.col("nn"))).alias("alpha")),
        F.struct(F.lit("interval").alias("scale"), F.lit(None).cast("double").alias("category"),
                 (1 - (n - 1) * F.try_divide(F.col("di"), 2 * (n * F.col("xx") - F.col("x") * F.col("x")))).alias("alpha")))))
    per = cat.join(F.broadcast(t.select("n"))).select(
        F.lit("nominal").alias("scale"), F.col("value").alias("category"), (1 - (n - 1) * F.try_divide(F.col("dc"), 2 * F.col("nc") * (n - F.col("nc")))).alias("alpha"))
    return overall.unionByName(per)


def icc(long: DataFrame) -> DataFrame:
    """Intraclass correlations from two-way mean squares over items every coder rated."""
    k = long.select("coder").distinct().count()
    full = long.groupBy("item").agg(F.count("*").alias("_m"), F.sum("value").alias("_s")).where(F.col("_m") == k)
    d = long.join(full.select("item"), "item", "left_semi")
    g = d.agg(F.count("*").cast("double").alias("all_n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    r = full.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("rs"))
    c = d.groupBy("coder").agg(F.sum("value").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("cs"))
    j = g.join(F.broadcast(r)).join(F.broadcast(c))
    n, corr = F.col("n"), F.col("s") * F.col("s") / F.col("all_n")
    ssr, ssc = F.col("rs") / k - corr, F.col("cs") / n - corr
    sse = F.col("ss") - corr - ssr - ssc
    msr, msc, mse = ssr / (n - 1), ssc / (k - 1), sse / ((n - 1) * (k - 1))
    msw = (ssc + sse) / (n * (k - 1))
    return j.select(n.cast("long").alias("n_items"), F.try_divide(msr - msw, msr + (k - 1) * msw).alias("icc1"),
                    F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n).alias("icc2"), F.try_divide(msr - mse, msr + (k - 1) * mse).alias("icc3"))


def retest(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """Correlation of two readings of the same units, and the split-half step-up."""
    j = a.select(key, F.col(col).cast("double").alias("x")).join(b.select(key, F.col(col).cast("double").alias("y")), key).where("x is not null and y is not null")
    r = j.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return r.withColumn("stepped_up", F.try_divide(2 * F.col("r"), 1 + F.col("r")))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every pairwise correlation from one pass."""
    pairs = list(combinations(cols, 2))
    a = df.agg(*[F.corr(F.col(p).cast("double"), F.col(q).cast("double")).alias(f"r{i}") for i, (p, q) in enumerate(pairs)])
    return a.select(F.inline(F.array(*[F.struct(F.lit(p).alias("left"), F.lit(q).alias("right"), F.col(f"r{i}").alias("r")) for i, (p, q) in enumerate(pairs)])))


def known_groups(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Difference between two groups known to differ, in pooled standard deviations."""
    from plumbline.operators.design import balance
    return balance(df, group, cols).select("column", "mean_control", "mean_treated", "std_diff")


def wilson(n: Column, k: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson score interval of a share."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def label_accuracy(df: DataFrame, gold: str, label: str, by: str | None = None, half_width: float = 0.05) -> DataFrame:
    """Accuracy overall and by group with Wilson intervals, and the sample each would need for `half_width`."""
    d = df.where(F.col(gold).isNotNull() & F.col(label).isNotNull()).select(
        (F.col(by).cast("string") if by else F.lit("all")).alias("group"), F.col(gold).eqNullSafe(F.col(label)).cast("long").alias("ok"))
    g = d.groupBy("group").agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    if by:
        g = g.unionByName(g.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("group", F.lit("all")))
    lo, hi = wilson(F.col("n"), F.col("k"))
    p = F.col("k") / F.col("n")
    return g.select("group", "n", p.alias("accuracy"), lo.alias("lo"), hi.alias("hi"), F.ceil(p * (1 - p) * (1.959964 / half_width) ** 2).alias("n_needed"))


def perturbation_test(base: DataFrame, changed: DataFrame, key: str, label: str, by: str, expect: str = "same") -> DataFrame:
    """Share of pairs whose label moved, by group. `expect` is same, up or down."""
    j = base.select(key, by, F.col(label).alias("a")).join(changed.select(key, F.col(label).alias("b")), key).where("a is not null and b is not null")
    fail = {"same": F.col("a") != F.col("b"), "up": F.col("b") <= F.col("a"), "down": F.col("b") >= F.col("a")}[expect]
    return j.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_flipped"), F.avg(fail.cast("double")).alias("failure_rate"))


def corrected_outcome(surrogate: Column, gold: Column, pi: float) -> Column:
    """Surrogate plus the inverse-probability-weighted error where gold was sampled with probability `pi`."""
    return surrogate + F.coalesce((gold - surrogate) / F.lit(float(pi)), F.lit(0.0))


def corrected_mean(df: DataFrame, surrogate: str, gold: str, pi: float) -> DataFrame:
    """Naive and design-corrected means of a machine-coded variable."""
    d = df.select(F.col(surrogate).cast("double").alias("s"), F.col(gold).cast("double").alias("g")).where("s is not null")
    d = d.withColumn("c", corrected_outcome(F.col("s"), F.col("g"), pi))
    return d.agg(F.count("*").alias("n"), F.count("g").alias("n_gold"), F.avg("s").alias("naive"), F.avg("c").alias("corrected"),
                 (F.stddev_samp("c") / F.sqrt(F.count("*"))).alias("se"))


def corrected_regression(df: DataFrame, surrogate: str, gold: str, pi: float, xs: Sequence[str]) -> DataFrame:
    """Regression of the corrected outcome with HC1 errors."""
    d = df.where(F.col(surrogate).isNotNull())
    fit = fit_ols(d, corrected_outcome(F.col(surrogate).cast("double"), F.col(gold).cast("double"), pi), list(xs))
    return df.sparkSession.createDataFrame(rung(fit, "HC1", hc_variances(fit)["HC1"], fit.n - fit.k), RUNG_SCHEMA)


def hajek_mean(df: DataFrame, y: str, pi: str, n: int | None = None) -> DataFrame:
    """Inclusion-weighted mean with the sum of probabilities it rests on."""
    d = df.where(F.col(y).isNotNull())
    return d.agg(F.count("*").alias("n_sampled"), (F.sum(F.col(y) / F.col(pi)) / F.sum(1 / F.col(pi))).alias("hajek"), F.avg(y).alias("unweighted"),
                 F.sum(1 / F.col(pi)).alias("estimated_population"))


def item_moments(df: DataFrame, items: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean, spread and prevalence of each item by group and period."""
    g = df.groupBy(*by).agg(*[x for c in items for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"),
                                                         F.avg((F.col(c) != 0).cast("double")).alias(f"p_{c}"))])
    return g.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"),
                                                     F.col(f"s_{c}").alias("sd"), F.col(f"p_{c}").alias("prevalence")) for c in items])))


def component_shares(df: DataFrame, items: Sequence[str], period: Column) -> DataFrame:
    """Which component moved an additive index: each item's share of the change between two periods."""
    p = period.cast("int")
    a = df.agg(*[(F.avg(F.when(p == 1, F.col(c))) - F.avg(F.when(p == 0, F.col(c)))).alias(c) for c in items])
    total = sum((F.col(c) for c in items), F.lit(0.0))
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("change"), F.try_divide(F.col(c), total).alias("share")) for c in items])))
