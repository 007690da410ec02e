"""Experiment and panel design checks and the estimators they guard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dist import chi2_sf, norm_cdf
from plumbline.functions.ordered import quantiles
from plumbline.functions.scalars import stable_uniform
from plumbline.operators.regress import RUNG_SCHEMA, cluster_sums, cr_variances, fit_ols, rung
from plumbline.session import SMALL_ROWS, cut, fetch_small


def balance(df: DataFrame, arm: str, cols: Sequence[str], cluster: str | None = None) -> DataFrame:
    """Standardised mean differences by arm, over rows or over cluster means."""
    d = df.where(F.col(arm).isNotNull())
    if cluster:
        d = d.groupBy(cluster).agg(F.max(arm).alias(arm), *[F.avg(c).alias(c) for c in cols])
    a = d.agg(*[x for c in cols for k in (0, 1) for x in (
        F.avg(F.when(F.col(arm) == k, F.col(c))).alias(f"m{k}_{c}"), F.var_samp(F.when(F.col(arm) == k, F.col(c))).alias(f"v{k}_{c}"),
        F.count(F.when(F.col(arm) == k, F.col(c))).alias(f"n{k}_{c}"))])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n0_{c}").alias("n_control"), F.col(f"n1_{c}").alias("n_treated"),
                 F.col(f"m0_{c}").alias("mean_control"), F.col(f"m1_{c}").alias("mean_treated"),
                 F.try_divide(F.col(f"m1_{c}") - F.col(f"m0_{c}"), F.sqrt((F.col(f"v0_{c}") + F.col(f"v1_{c}")) / 2)).alias("std_diff"))
        for c in cols])))


def sample_ratio(df: DataFrame, arm: str, expected: dict) -> DataFrame:
    """Chi-square of assignment counts against the planned shares."""
    n = {r[0]: r["n"] for r in df.where(F.col(arm).isin(list(expected))).groupBy(arm).agg(F.count("*").alias("n")).collect()}
    total, plan = sum(n.values()), sum(expected.values())
    stat = sum((n.get(k, 0) - total * s / plan) ** 2 / (total * s / plan) for k, s in expected.items()) if total else None
    p = chi2_sf(stat, len(expected) - 1) if stat is not None else None
    status = "abstain" if p is None else "fail" if p < 0.001 else "pass"
    return df.sparkSession.createDataFrame([(total, stat, len(expected) - 1, p, status)], "n long, chi2 double, dof int, p double, status string")


def attrition(df: DataFrame, arm: str, y: str) -> DataFrame:
    """Outcome response by arm and the test of their difference."""
    r = F.col(y).isNotNull().cast("double")
    s = df.agg(*[x for k in (0, 1) for x in (F.count_if(F.col(arm) == k).alias(f"n{k}"), F.avg(F.when(F.col(arm) == k, r)).alias(f"r{k}"))]).first()
    pool = (s["n0"] * s["r0"] + s["n1"] * s["r1"]) / (s["n0"] + s["n1"])
    se = float(np.sqrt(pool * (1 - pool) * (1 / s["n0"] + 1 / s["n1"])))
    z = (s["r1"] - s["r0"]) / se if se > 0 else None
    p = 2 * (1 - norm_cdf(abs(z))) if z is not None else None
    return df.sparkSession.createDataFrame([(s["r0"], s["r1"], s["r1"] - s["r0"], z, p)],
                                           "response_control double, response_treated double, difference double, z double, p double")


def attrition_bounds(df: DataFrame, arm: str, y: str) -> DataFrame:
    """Worst-case (Manski) bounds from the observed range, and trimming (Lee) bounds.

    Trimming removes the surplus share of responders from the arm that responds
    more, from the top for the lower bound and from the bottom for the upper.
    """
    t = F.col(arm)
    s = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), *[x for k in (0, 1) for x in (
        F.count_if(t == k).alias(f"n{k}"), F.count(F.when(t == k, F.col(y))).alias(f"c{k}"), F.sum(F.when(t == k, F.col(y))).alias(f"s{k}"))]).first()
    fill = lambda k, v: (s[f"s{k}"] + (s[f"n{k}"] - s[f"c{k}"]) * v) / s[f"n{k}"]
    rows = [("manski", float(fill(1, s["lo"]) - fill(0, s["hi"])), float(fill(1, s["hi"]) - fill(0, s["lo"])), 0.0)]
    q = [s[f"c{k}"] / s[f"n{k}"] for k in (0, 1)]
    more = int(q[1] > q[0])
    share = 1 - q[1 - more] / q[more]
    d = df.where((t == more) & F.col(y).isNotNull())
    cut = {r["p"]: r["value"] for r in quantiles(d, [y], [share, 1 - share]).collect()}
    m = d.agg(F.avg(F.when(F.col(y) <= cut[1 - share], F.col(y))).alias("low"), F.avg(F.when(F.col(y) >= cut[share], F.col(y))).alias("high")).first()
    other = s[f"s{1 - more}"] / s[f"c{1 - more}"]
    lo, hi = (m["low"] - other, m["high"] - other) if more else (other - m["high"], other - m["low"])
    rows.append(("lee", float(lo), float(hi), float(share)))
    return df.sparkSession.createDataFrame(rows, "method string, lower double, upper double, trimmed_share double")


def did_2x2(df: DataFrame, y: str, treated: Column, post: Column, cluster: str) -> DataFrame:
    """Two-group two-period difference in differences with CR1 errors by cluster."""
    xs = {"treated": treated.cast("double"), "post": post.cast("double"), "effect": (treated & post).cast("double")}
    fit = fit_ols(df, y, xs, [cluster])
    vs, g = cr_variances(fit, cluster_sums(fit, [cluster]))
    return df.sparkSession.createDataFrame(rung(fit, "CR1", vs["CR1"], g - 1, ["effect"]), RUNG_SCHEMA)


def group_time_effects(panel: DataFrame, unit: str, time: str, treat: str, y: str, never_only: bool = False) -> DataFrame:
    """ATT(g, t) against units not yet treated at t (or never treated): `(g, t, event_time, att, n_treated, n_control)`.

    `time` must be an integer period; a unit's rows in one period all count. Changes from
    each base period are summed per (first treated period, base, period) where the unit's
    periods lie, so what is shuffled after that follows periods and cohorts, not units.
    """
    p = panel.select(F.col(unit).alias("u"), F.col(time).cast("int").alias("t"), F.col(treat).alias("w"), F.col(y).cast("double").alias("y"))
    cell = p.where("u is not null").groupBy("u", "t").agg(
        F.max(F.coalesce(F.col("w") != 0, F.lit(False))).alias("w"), F.count("*").alias("m"), F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    units = cell.groupBy("u").agg(F.min(F.when(F.col("w"), F.col("t"))).alias("g0"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "m", "n", "s"))).alias("at"))
    units = cut(units)  # read for the cohorts and for the pairs
    cohorts = fetch_small(units.where("g0 is not null").select("g0").distinct(), SMALL_ROWS)
    starts = F.col("at") if cohorts is None else F.filter("at", lambda x: F.array_contains(F.lit([r["g0"] - 1 for r in cohorts] or [None]).cast("array<int>"), x["t"]))
    pairs = units.withColumn("b", F.explode(starts)).select("g0", "b", F.explode("at").alias("x"))
    sums = pairs.groupBy("g0", (F.col("b.t") + 1).alias("g"), F.col("x.t").alias("t")).agg(
        F.sum(F.col("b.m") * F.col("x.m")).alias("m"), F.sum(F.col("b.n") * F.col("x.n")).alias("n"),
        F.sum(F.col("x.s") * F.col("b.n") - F.col("b.s") * F.col("x.n")).alias("d"))
    is_t = F.coalesce(F.col("g0") == F.col("g"), F.lit(False))
    later = F.col("g0").isNull() if never_only else F.col("g0").isNull() | ((F.col("g0") > F.col("t")) & (F.col("g0") != F.col("g")))
    of = lambda who, c: F.sum(F.when(who, F.col(c)))
    r = sums.groupBy("g", "t").agg(*[of(who, c).alias(f"{name}{c}") for name, who in (("a", is_t), ("b", later)) for c in ("m", "n", "d")])
    return r.where("am > 0 and bm > 0").select(
        "g", "t", (F.col("t") - F.col("g")).alias("event_time"), (F.try_divide("ad", "an") - F.try_divide("bd", "bn")).alias("att"),
        F.col("am").alias("n_treated"), F.col("bm").alias("n_control"))


def aggregate_effects(att: DataFrame, by: str) -> DataFrame:
    """Effects weighted by treated units: by cohort (after treatment), or by event time (leads included)."""
    d = att.where("event_time >= 0") if by == "g" else att
    w = F.sum("n_treated")
    return d.groupBy(by).agg((F.sum(F.col("att") * F.col("n_treated")) / w).alias("att"), w.alias("weight"))


def event_study(att: DataFrame) -> DataFrame:
    """Lead and lag table; leads before -1 should be near zero."""
    return aggregate_effects(att, "event_time").withColumn(
        "kind", F.when(F.col("event_time") < -1, "pre-trend").when(F.col("event_time") == -1, "base").otherwise("effect"))


def rd_bins(df: DataFrame, x: str, y: str, cutoff: float, width: float) -> DataFrame:
    """Counts and means in bins that never straddle the cutoff."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor((F.col(x) - cutoff) / width).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(y).alias("y_mean")).withColumn("side", F.when(F.col("bin") >= 0, "above").otherwise("below"))


def rd_local_linear(df: DataFrame, x: str, y: str, cutoff: float, bandwidth: float) -> DataFrame:
    """Jump at the cutoff from triangular-kernel local lines either side, at a given bandwidth."""
    c = F.col(x).cast("double") - F.lit(float(cutoff))
    d = df.where(F.col(y).isNotNull()).select(c.alias("c"), F.col(y).cast("double").alias("y")).where(F.abs("c") < bandwidth)
    w = 1 - F.abs("c") / bandwidth
    s = d.groupBy((F.col("c") >= 0).alias("above")).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("c")).alias("wc"), F.sum(w * F.col("c") * F.col("c")).alias("wcc"),
        F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("c") * F.col("y")).alias("wcy"))
    det = F.col("w") * F.col("wcc") - F.col("wc") * F.col("wc")
    s = s.withColumn("level", F.try_divide(F.col("wcc") * F.col("wy") - F.col("wc") * F.col("wcy"), det)).withColumn(
        "slope", F.try_divide(F.col("w") * F.col("wcy") - F.col("wc") * F.col("wy"), det))
    pick = lambda col, side: F.max(F.when(F.col("above") == side, F.col(col)))
    return s.agg(pick("n", False).alias("n_below"), pick("n", True).alias("n_above"), pick("level", False).alias("left_limit"),
                 pick("level", True).alias("right_limit"), (pick("level", True) - pick("level", False)).alias("jump"),
                 pick("slope", False).alias("slope_below"), pick("slope", True).alias("slope_above"))


def propensity_scores(df: DataFrame, arm: str, xs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Logistic probability of treatment, fitted with Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    d = df.select(arm, *dict.fromkeys([*xs, *keep])).dropna()
    d = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(d.withColumn("_l", F.col(arm).cast("double")))
    m = LogisticRegression(featuresCol="_x", labelCol="_l", regParam=0.0, maxIter=100, tol=1e-10).fit(d)
    return m.transform(d).withColumn("ps", F.element_at(vector_to_array("probability"), 2)).select(arm, *dict.fromkeys([*xs, *keep]), "ps")


def ipw_effect(scored: DataFrame, arm: str, y: str) -> DataFrame:
    """Normalised inverse-probability estimate with effective sample sizes."""
    t, p = F.col(arm) == 1, F.col("ps")
    w = F.when(t, F.try_divide(F.lit(1.0), p)).otherwise(F.try_divide(F.lit(1.0), 1 - p))
    s = lambda c, e: F.sum(F.when(c, e))
    a = scored.agg(s(t, w).alias("w1"), s(~t, w).alias("w0"), s(t, w * F.col(y)).alias("y1"), s(~t, w * F.col(y)).alias("y0"),
                   s(t, w * w).alias("q1"), s(~t, w * w).alias("q0"), F.min("ps").alias("min_ps"), F.max("ps").alias("max_ps"))
    return a.select((F.col("y1") / F.col("w1") - F.col("y0") / F.col("w0")).alias("effect"), (F.col("w1") ** 2 / F.col("q1")).alias("ess_treated"),
                    (F.col("w0") ** 2 / F.col("q0")).alias("ess_control"), "min_ps", "max_ps")


def overlap_histogram(scored: DataFrame, arm: str, bins: int = 10) -> DataFrame:
    """Score histogram by arm."""
    b = F.least(F.floor(F.col("ps") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count_if(F.col(arm) == 1).alias("treated"), F.count_if(F.col(arm) == 0).alias("control"))


def placebo_runs(df: DataFrame, runs: dict[str, tuple[str, Column, Column | None]]) -> DataFrame:
    """The same difference in means over declared placebo outcomes, arms or samples."""
    parts = []
    for name, (y, arm, cond) in runs.items():
        d = (df if cond is None else df.where(cond)).select(arm.cast("int").alias("a"), F.col(y).cast("double").alias("y")).where("a in (0, 1) and y is not null")
        s = d.agg(*[x for k in (0, 1) for x in (F.count_if(F.col("a") == k).alias(f"n{k}"), F.avg(F.when(F.col("a") == k, F.col("y"))).alias(f"m{k}"),
                                                F.var_samp(F.when(F.col("a") == k, F.col("y"))).alias(f"v{k}"))])
        est = F.col("m1") - F.col("m0")
        se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
        parts.append(s.select(F.lit(name).alias("run"), est.alias("estimate"), se.alias("se"), F.try_divide(est, se).alias("z")))
    return reduce(DataFrame.unionByName, parts)


def split_halves(df: DataFrame, row_id: str, salt: str = "split:") -> DataFrame:
    """Adds `half`: explore or confirm, fixed by the id."""
    return df.withColumn("half", F.when(stable_uniform(F.col(row_id), salt) < 0.5, "explore").otherwise("confirm"))


def disjointness(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids shared by each pair of named samples; every count must be zero."""
    tagged = reduce(DataFrame.unionByName, [d.select(F.col(key).alias("k"), F.lit(n).alias("s")) for n, d in parts.items()])
    names = list(parts)
    k = tagged.groupBy("k").agg(*[F.max((F.col("s") == n).cast("int")).alias(f"i{i}") for i, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    a = k.agg(*[F.sum(F.col(f"i{i}") * F.col(f"i{j}")).cast("long").alias(f"p{i}_{j}") for i, j in pairs])
    return a.select(F.inline(F.array(*[F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"p{i}_{j}").alias("n_shared"),
                                                F.when(F.col(f"p{i}_{j}") == 0, "pass").otherwise("fail").alias("status")) for i, j in pairs])))


def itt_and_cace(df: DataFrame, arm: str, took: str, y: str) -> DataFrame:
    """Intention to treat, compliance difference and the implied effect on the treated."""
    m = lambda c, k: F.avg(F.when(F.col(arm) == k, F.col(c)))
    a = df.where(F.col(y).isNotNull()).agg((m(y, 1) - m(y, 0)).alias("itt"), (m(took, 1) - m(took, 0)).alias("compliance"))
    return a.withColumn("effect_on_treated", F.try_divide("itt", "compliance"))


def calibration(df: DataFrame, score: str, observed: str, bins: int = 10) -> DataFrame:
    """Mean prediction against outcome by score bin, from exact quantile cuts."""
    cuts = [r["value"] for r in quantiles(df, [score], [i / bins for i in range(1, bins)]).orderBy("p").collect()]
    b = reduce(lambda a, c: a + (F.col(score) > c).cast("int"), cuts, F.lit(1))
    return df.where(F.col(score).isNotNull() & F.col(observed).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(observed).alias("observed")).withColumn(
        "gap", F.col("observed") - F.col("predicted"))


def prediction_bounds(df: DataFrame, score: str, by: str, lo: float, hi: float, min_support: int = 30) -> DataFrame:
    """Out-of-bounds predictions and thin support by subgroup."""
    c = F.col(score)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if((c < lo) | (c > hi)).alias("n_outside")).withColumn(
        "thin", F.col("n") < min_support)
