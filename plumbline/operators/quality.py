"""Cross-column checks, recodes, missing-data policies and descriptive comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordered import melt, quantiles
from plumbline.operators.profile import _named, _rows, numeric_columns, scalar_columns, string_columns


def equal_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of rows where two columns of one type hold the same non-null value."""
    fields = [f for f in df.schema if f.name in (cols or scalar_columns(df))]
    pairs = [(a.name, b.name) for a, b in combinations(fields, 2) if a.dataType == b.dataType]
    a = df.agg(*[x for i, (p, q) in enumerate(pairs) for x in (
        F.count_if(F.col(p) == F.col(q)).alias(f"s{i}"),
        F.count_if(F.col(p).isNotNull() & F.col(q).isNotNull()).alias(f"n{i}"))])
    return _rows(a, *[_named(left=p, right=q, n_same=F.col(f"s{i}"), n=F.col(f"n{i}"),
                             identical=(F.col(f"n{i}") > 0) & (F.col(f"s{i}") == F.col(f"n{i}")))
                      for i, (p, q) in enumerate(pairs)])


def date_part_ambiguity(df: DataFrame, date: str, by: str) -> DataFrame:
    """Sources whose day of month never passes 12, a sign of swapped day and month."""
    return (df.where(F.col(date).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.max(F.dayofmonth(date)).alias("max_day"), F.max(F.month(date)).alias("max_month"))
        .withColumn("ambiguous", F.col("max_day") <= 12))


def control_totals(parts: DataFrame, totals: DataFrame, part_key: str, total_key: str, value: Column, total: str,
                   tol: float = 0.005) -> DataFrame:
    """Printed totals against the sum of their parts: counts by outcome and the largest residual."""
    s = parts.groupBy(F.col(part_key).alias(total_key)).agg(F.sum(value).alias("_s"))
    j = totals.select(total_key, total).join(s, total_key, "left")
    r = F.col("_s") - F.col(total)
    out = F.when(F.col("_s").isNull(), "no parts").when(F.abs(r) <= tol, "reconciles").when(r > 0, "parts exceed")\
        .otherwise("total exceeds")
    return j.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"), F.max(F.abs(r)).alias("max_abs_residual"))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule (a column that should be true); unknown is counted apart."""
    a = df.agg(*[x for n, r in rules.items() for x in (
        F.count_if(~r).alias(f"b_{n}"), F.count_if(r.isNull()).alias(f"u_{n}"))])
    return _rows(a, *[_named(rule=n, n_violations=F.col(f"b_{n}"), n_unknown=F.col(f"u_{n}")) for n in rules])


# ---- recodes -----------------------------------------------------------------------------------------

def recode(df: DataFrame, col: str, mapping: dict[str, str], out: str) -> DataFrame:
    """Apply a fixed mapping; values outside it become null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(m, F.col(col)))


def recode_crosstab(df: DataFrame, old: str, new: str) -> DataFrame:
    """Old by new values with counts."""
    return df.groupBy(old, new).agg(F.count("*").alias("n"))


def recode_conservation(df: DataFrame, old: str, new: str) -> DataFrame:
    """Nulls before and after a recode, and how many raw levels went unmatched."""
    g = df.groupBy(old, new).agg(F.count("*").alias("n"))
    lost = F.col(old).isNotNull() & F.col(new).isNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return g.agg(total(F.col(old).isNull()).alias("nulls_before"), total(F.col(new).isNull()).alias("nulls_after"),
                 F.count_if(lost).alias("unmatched_levels")).withColumn(
        "status", F.when(F.col("nulls_before") == F.col("nulls_after"), "pass").otherwise("fail"))


def unmatched_levels(df: DataFrame, old: str, new: str) -> DataFrame:
    """Raw levels a recode did not cover."""
    return df.where(F.col(old).isNotNull() & F.col(new).isNull()).groupBy(old).agg(F.count("*").alias("n"))


def winsorise(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Pull values outside the two percentiles back to them; adds `<col>_w`."""
    q = {r["p"]: r["value"] for r in quantiles(df, [col], [lo, hi]).collect()}
    return df.withColumn(f"{col}_w", F.least(F.greatest(F.col(col), F.lit(q[lo])), F.lit(q[hi])))


def winsor_report(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Values moved by winsorising, and the mean raw, winsorised and trimmed."""
    q = {r["p"]: r["value"] for r in quantiles(df, [col], [lo, hi]).collect()}
    c = F.col(col)
    inside = (c >= q[lo]) & (c <= q[hi])
    w = F.least(F.greatest(c, F.lit(q[lo])), F.lit(q[hi]))
    return df.agg(F.count(c).alias("n"), F.count_if(c < q[lo]).alias("n_raised"), F.count_if(c > q[hi]).alias("n_lowered"),
                  F.avg(c).alias("mean_raw"), F.avg(w).alias("mean_winsorised"),
                  F.avg(F.when(inside, c)).alias("mean_trimmed"), F.count_if(inside).alias("n_trimmed"))


def standardise(df: DataFrame, col: str, reference: Column, by: str) -> DataFrame:
    """Group means in units of the reference sample's standard deviation."""
    ref = df.agg(F.avg(F.when(reference, F.col(col))).alias("_m"), F.stddev_samp(F.when(reference, F.col(col))).alias("_s"))
    g = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("_mean"))
    return g.join(F.broadcast(ref)).select(by, "n", F.try_divide(F.col("_mean") - F.col("_m"), F.col("_s")).alias("z"))


# ---- comparisons that change with the aggregation ---------------------------------------------------------

def ratio_means(df: DataFrame, key: str, num: str, den: str) -> DataFrame:
    """Mean of ratios, ratio of means and the denominator-weighted mean, over units of `key`."""
    u = df.groupBy(key).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    r = F.try_divide("a", "b")
    return u.agg(F.count("*").alias("n_units"), F.count_if(r.isNull()).alias("n_undefined"), F.avg(r).alias("mean_of_ratios"),
                 F.try_divide(F.sum("a"), F.sum("b")).alias("ratio_of_means"),
                 F.try_divide(F.sum(r * F.col("b")), F.sum(F.when(r.isNotNull(), F.col("b")))).alias("weighted_mean_of_ratios"))


def joint_shares(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Marginal share of each flag beside the share meeting all; the joint can exceed no marginal."""
    every = reduce(lambda a, b: a & b, flags.values())
    a = df.agg(*[F.avg(f.cast("double")).alias(n) for n, f in flags.items()], F.avg(every.cast("double")).alias("_all"))
    low = F.least(*[F.col(n) for n in flags])
    return _rows(a, *[_named(flag=n, share=F.col(n), bounds_joint=F.col(n) >= F.col("_all")) for n in flags],
                 _named(flag="all", share=F.col("_all"), bounds_joint=F.col("_all") <= low))


def aggregation_reversal(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Slope across rows and across group means, and whether the sign flips."""
    rows = df.agg(F.regr_slope(y, x).alias("row_slope"), F.corr(x, y).alias("row_corr"))
    g = df.groupBy(by).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y")).agg(
        F.regr_slope("_y", "_x").alias("group_slope"), F.corr("_x", "_y").alias("group_corr"))
    return rows.join(F.broadcast(g)).withColumn(
        "reverses", F.signum("row_slope") * F.signum("group_slope") < 0)


def small_denominators(df: DataFrame, key: str, num: Column, thresholds: Sequence[int]) -> DataFrame:
    """Units below each size, and the mean unit rate with and without them."""
    u = df.groupBy(key).agg(F.count("*").alias("d"), F.avg(num).alias("r"))
    a = u.agg(F.count("*").alias("n"), F.avg("r").alias("all"), *[x for t in thresholds for x in (
        F.count_if(F.col("d") < t).alias(f"s{t}"), F.avg(F.when(F.col("d") >= t, F.col("r"))).alias(f"m{t}"))])
    return _rows(a, *[_named(threshold=F.lit(t), n_units=F.col("n"), n_below=F.col(f"s{t}"), mean_all=F.col("all"),
                             mean_kept=F.col(f"m{t}")) for t in thresholds])


def row_counts_by_model(df: DataFrame, models: dict[str, Sequence[str]]) -> DataFrame:
    """Complete rows available to each column set, and whether all sets agree."""
    a = df.agg(*[F.count_if(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in cols])).alias(m)
                 for m, cols in models.items()])
    top = F.greatest(*[F.col(m) for m in models], F.lit(0))
    return _rows(a, *[_named(model=m, n=F.col(m), lost=top - F.col(m)) for m in models])


def complete_case_report(df: DataFrame, needed: Sequence[str], observables: Sequence[str]) -> DataFrame:
    """Kept against dropped rows on what was observed for both."""
    kept = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    d = df.withColumn("_k", kept)
    a = d.agg(*[x for c in observables for x in (
        F.avg(F.when(F.col("_k"), F.col(c))).alias(f"k_{c}"), F.avg(F.when(~F.col("_k"), F.col(c))).alias(f"d_{c}"),
        F.stddev_samp(c).alias(f"s_{c}"))], F.count_if("_k").alias("n_kept"), F.count_if(~F.col("_k")).alias("n_dropped"))
    return _rows(a, *[_named(column=c, n_kept=F.col("n_kept"), n_dropped=F.col("n_dropped"), mean_kept=F.col(f"k_{c}"),
                             mean_dropped=F.col(f"d_{c}"),
                             std_diff=F.try_divide(F.col(f"k_{c}") - F.col(f"d_{c}"), F.col(f"s_{c}")))
                      for c in observables])


def missing_policies(df: DataFrame, col: str, by: str, constant: float = 0.0) -> DataFrame:
    """Group mean under each missing-data policy with the N it rests on."""
    c = F.col(col)
    g = df.groupBy(by).agg(F.count("*").alias("_n"), F.count(c).alias("_k"), F.avg(c).alias("_m"),
                           F.avg(F.coalesce(c, F.lit(constant))).alias("_i"),
                           F.avg(c.isNull().cast("double")).alias("_f"))
    return g.select(by, F.inline(F.array(
        _named(policy="complete_case", n=F.col("_k"), mean=F.col("_m"), imputed_share=F.lit(0.0)),
        _named(policy="indicator_and_constant", n=F.col("_n"), mean=F.col("_i"), imputed_share=F.col("_f")))))


# ---- binned summaries --------------------------------------------------------------------------------------

def _bin(col: Column, cuts: Sequence[float]) -> Column:
    """1-based bin: one more than the number of cuts below or at the value."""
    return reduce(lambda a, b: a + b, [(col > c).cast("int") for c in cuts], F.lit(1))


def binned_means(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Count, mean of x, mean of y and a 95% normal interval per quantile bin of x."""
    probs = [i / bins for i in range(1, bins)]
    cuts = [r["value"] for r in quantiles(df, [x], probs).orderBy("p").collect()]
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(_bin(F.col(x), cuts).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("_s"))
    half = 1.959964 * F.col("_s") / F.sqrt("n")
    return g.select("bin", "n", "x_mean", "y_mean", (F.col("y_mean") - half).alias("y_lo"),
                    (F.col("y_mean") + half).alias("y_hi"))


def density_2d(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """Counts on a rectangular grid."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.floor(F.col(x) / wx).alias("ix"), F.floor(F.col(y) / wy).alias("iy")).agg(F.count("*").alias("n"))


# ---- boundary, stability and delimiter signs ------------------------------------------------------------------

def boundary_mass(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of rows at the maximum and the gap to the next distinct value."""
    cols = list(cols or numeric_columns(df))
    vc = melt(df, [], cols).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column", "value").agg(
        F.count("*").alias("c"))
    per = vc.groupBy("column").agg(F.sum("c").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("value"))
    t = vc.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("column").agg(
        F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("max"), F.max(F.when(F.col("_r") == 1, F.col("c"))).alias("n_at_max"),
        F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("next"))
    return t.join(per, "column").select("column", "max", "n_at_max", (F.col("n_at_max") / F.col("n")).alias("share"),
                                        (F.col("max") - F.col("next")).alias("gap"))


def width_limit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of strings that fill the column's widest length, a sign of truncation."""
    cols = list(cols or string_columns(df))
    g = melt(df, [], cols, "string").where("value is not null").groupBy("column", F.length("value").alias("len")).agg(
        F.count("*").alias("c"))
    return g.groupBy("column").agg(F.max("len").alias("width"), F.max_by("c", "len").alias("n_at_width"),
                                   F.sum("c").alias("n")).withColumn("share", F.col("n_at_width") / F.col("n"))


def share_stability(df: DataFrame, col: str, values: Sequence[float], by: str) -> DataFrame:
    """Per code: mean and spread of its share across groups, and how many groups hold it.

    Groups without the code count as zero, through sums over groups that have it.
    """
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[
        F.count_if(F.col(col) == v).alias(f"c{i}") for i, v in enumerate(values)])
    sh = [F.col(f"c{i}") / F.col("n") for i in range(len(values))]
    a = g.agg(F.count("*").alias("g"), *[x for i, s in enumerate(sh) for x in (
        F.avg(s).alias(f"m{i}"), F.stddev_pop(s).alias(f"s{i}"), F.count_if(F.col(f"c{i}") > 0).alias(f"k{i}"))])
    return _rows(a, *[_named(value=F.lit(float(v)), n_groups=F.col("g"), groups_with=F.col(f"k{i}"),
                             mean_share=F.col(f"m{i}"), sd_share=F.col(f"s{i}"), one_group_only=F.col(f"k{i}") == 1)
                      for i, v in enumerate(values)]).where("groups_with > 0")


def delimiter_leaks(df: DataFrame, delimiters: Sequence[str] = (",", ";", "\t", "|"),
                    cols: Sequence[str] | None = None) -> DataFrame:
    """Values containing a delimiter, per column."""
    cols = list(cols or string_columns(df))
    a = df.agg(*[F.count_if(F.col(c).contains(d)).alias(f"x{i}_{j}")
                 for i, c in enumerate(cols) for j, d in enumerate(delimiters)])
    return _rows(a, *[_named(column=c, delimiter=d, n=F.col(f"x{i}_{j}"))
                      for i, c in enumerate(cols) for j, d in enumerate(delimiters)]).where("n > 0")


def preview(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Per column: type, missing share, commonest values, extremes, first and last values by key."""
    cols = scalar_columns(df)
    head = df.orderBy(F.asc(key)).limit(k).collect()
    tail = df.orderBy(F.desc(key)).limit(k).collect()
    st = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in cols],
                *[F.min(c).cast("string").alias(f"a_{c}") for c in cols],
                *[F.max(c).cast("string").alias(f"b_{c}") for c in cols])
    show = lambda rows, c: " | ".join("" if r[c] is None else str(r[c]) for r in rows)
    from plumbline.operators.profile import value_counts
    common = {}
    for r in value_counts(df, 3, cols).where("kind in ('value', 'constant')").orderBy(F.desc("n"), "value").collect():
        common.setdefault(r["column"], []).append(r["value"])
    return _rows(st, *[_named(column=c, type=df.schema[c].dataType.simpleString(),
                              missing_share=F.try_divide(f"m_{c}", "_n"), min=F.col(f"a_{c}"), max=F.col(f"b_{c}"),
                              common=" | ".join(common.get(c, [])), first=show(head, c), last=show(tail, c)) for c in cols])
