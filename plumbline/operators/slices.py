"""Metric diagnosis: slice discovery, decompositions, shifts, funnels and fault injection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dist import two_sided_normal
from plumbline.functions.ordered import add_offsets, melt, running_total, with_cell
from plumbline.functions.scalars import stable_uniform
from plumbline.operators.ladder import benjamini_hochberg
from plumbline.session import cut

MIN_SUPPORT = 100
LIFT_FLOOR = 1e-12
ALPHA = 0.05


def _slice_counts(df: DataFrame, dims: Sequence[str], fail: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and failures per (dimension, value); one pass, map-side combined."""
    long = melt(df.withColumn("_f", F.col(fail).cast("long")), [*by, "_f"], dims, "string")
    return long.where("value is not null").groupBy(*by, F.col("column").alias("dim"), "value").agg(
        F.count("*").alias("n1"), F.sum("_f").alias("f1"))


def _test_slices(counts: DataFrame, by: Sequence[str], min_support: int) -> DataFrame:
    """Two-proportion test of each slice against the rest of its dimension."""
    keys = [*by, "dim"]
    tot = counts.groupBy(*keys).agg(F.sum("n1").alias("_n"), F.sum("f1").alias("_f"))
    j = counts.join(F.broadcast(tot), keys)  # one row per dimension (and half)
    j = j.withColumn("n2", F.col("_n") - F.col("n1")).where((F.col("n1") >= min_support) & (F.col("n2") >= min_support))
    p1, p2, pp = F.col("f1") / F.col("n1"), (F.col("_f") - F.col("f1")) / F.col("n2"), F.col("_f") / F.col("_n")
    se = F.sqrt(pp * (1 - pp) * (1 / F.col("n1") + 1 / F.col("n2")))
    j = j.select(*keys, "value", "n1", "n2", p1.alias("p1"), p2.alias("p2"), (p1 / F.greatest(p2, F.lit(LIFT_FLOOR))).alias("lift"),
                 F.when(se > 0, (p1 - p2) / se).alias("z")).where("z is not null")
    return j.withColumn("p", two_sided_normal("z"))


def slice_scan(df: DataFrame, dims: Sequence[str], fail: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Every (dimension, value) slice with enough support on both sides, tested against the rest."""
    return _test_slices(_slice_counts(df, dims, fail), [], min_support)


def disciplined_slice(df: DataFrame, dims: Sequence[str], fail: str, row_id: str, min_support: int = MIN_SUPPORT,
                      alpha: float = ALPHA, salt: str = "half:") -> DataFrame:
    """Best false-discovery-controlled slice of one half, confirmed in the other; empty when none survives.

    Both halves are counted in the same pass.
    """
    d = df.withColumn("_half", (stable_uniform(F.col(row_id), salt) < 0.5).cast("int"))
    tested = cut(_test_slices(_slice_counts(d, dims, fail, ["_half"]), ["_half"], min_support))
    explore, confirm = tested.where("_half = 1"), tested.where("_half = 0")
    best = benjamini_hochberg(explore, "p", alpha).where("reject").orderBy(F.desc("lift"), "dim", "value").limit(1)
    scanned = explore.agg(F.count("*").alias("n_scanned"))
    j = best.alias("e").join(confirm.alias("c"), ["dim", "value"], "left").join(F.broadcast(scanned))
    return j.select("dim", "value", F.col("e.lift").alias("explore_lift"), F.col("e.q").alias("explore_q"),
                    F.col("c.lift").alias("confirm_lift"), F.col("c.p").alias("confirm_p"), "n_scanned",
                    F.coalesce((F.col("c.p") < alpha) & (F.col("c.lift") > 1), F.lit(False)).alias("confirmed"))


def co_occurrence(df: DataFrame, dims: Sequence[str], fail: str, min_support: int = 30, lift: float = 1.5) -> DataFrame:
    """Feature values whose failure rate is at least `lift` times the base rate."""
    c = _slice_counts(df, dims, fail)
    base = c.groupBy("dim").agg((F.sum("f1") / F.sum("n1")).alias("base"))
    j = c.join(F.broadcast(base), "dim").where(F.col("n1") >= min_support)
    rate = F.col("f1") / F.col("n1")
    return j.select("dim", "value", F.col("n1").alias("n"), F.col("f1").alias("failures"), rate.alias("rate"), "base",
                    F.try_divide(rate, F.col("base")).alias("lift")).where(F.col("lift") >= lift)


def base_rates(df: DataFrame, dims: Sequence[str], fail: str) -> DataFrame:
    """Share of each feature value among failures beside its share among successes."""
    c = _slice_counts(df, dims, fail)
    t = c.groupBy("dim").agg(F.sum("f1").alias("_f"), F.sum(F.col("n1") - F.col("f1")).alias("_s"))
    j = c.join(F.broadcast(t), "dim")
    return j.select("dim", "value", F.try_divide("f1", "_f").alias("among_failures"),
                    F.try_divide(F.col("n1") - F.col("f1"), F.col("_s")).alias("among_successes"))


def mix_decomposition(df: DataFrame, period: Column, segment: str, value: str) -> DataFrame:
    """Change of a mean between period 0 and 1 split into within-segment and mix parts; the parts sum exactly."""
    g = df.select(period.cast("int").alias("_p"), F.col(segment).alias("segment"), F.col(value).cast("double").alias("_v")).where(
        F.col("_p").isin(0, 1) & F.col("_v").isNotNull())
    s = g.groupBy("segment").agg(*[x for p in (0, 1) for x in (
        F.count_if(F.col("_p") == p).alias(f"n{p}"), F.sum(F.when(F.col("_p") == p, F.col("_v"))).alias(f"s{p}"))])
    t = s.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    j = s.join(F.broadcast(t))
    w0, w1 = F.col("n0") / F.col("t0"), F.col("n1") / F.col("t1")
    r0, r1 = F.try_divide("s0", "n0"), F.try_divide("s1", "n1")
    # a segment seen in one period only carries its rate over, so all of its change is mix
    q0, q1 = F.coalesce(r0, r1), F.coalesce(r1, r0)
    return j.select("segment", w0.alias("share_before"), w1.alias("share_after"), q0.alias("rate_before"), q1.alias("rate_after"),
                    ((w0 + w1) / 2 * (q1 - q0)).alias("within"), ((q0 + q1) / 2 * (w1 - w0)).alias("mix"))


def step_changes(df: DataFrame, day: Column, value: str, changes: DataFrame | None = None, min_days: int = 3) -> DataFrame:
    """Candidate break days ranked by the t-statistic of the daily means before and after.

    The window runs over one row per day.
    """
    d = df.groupBy(day.alias("day")).agg(F.avg(value).alias("m"))
    w = Window.orderBy("day")
    prev, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    for name, win in (("b", prev), ("a", rest)):
        d = d.withColumns({f"n_{name}": F.count("m").over(win), f"mean_{name}": F.avg("m").over(win), f"var_{name}": F.var_samp("m").over(win)})
    d = d.where((F.col("n_b") >= min_days) & (F.col("n_a") >= min_days))
    diff = F.col("mean_a") - F.col("mean_b")
    d = d.select("day", F.col("n_b").alias("days_before"), F.col("n_a").alias("days_after"), diff.alias("step"),
                 F.try_divide(diff, F.sqrt(F.col("var_b") / F.col("n_b") + F.col("var_a") / F.col("n_a"))).alias("t"))
    d = d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("t")), "day")))
    if changes is None:
        return d
    near = changes.select(F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))).alias("day"), "change").groupBy("day").agg(
        F.min("change").alias("change"))
    return d.join(near, "day", "left")


def numeric_shift(df: DataFrame, after: Column, cols: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per numeric column between two snapshots."""
    long = melt(df.withColumn("_a", after.cast("int")), ["_a"], cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = long.groupBy("column", "value").agg(F.sum("_a").alias("c1"), F.sum(1 - F.col("_a")).alias("c0"))
    tot = vc.groupBy("column").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    run = running_total(vc, ["column"], "value", {"r0": "c0", "r1": "c1"}).join(F.broadcast(tot), "column")
    gap = F.abs(F.try_divide("r1", "n1") - F.try_divide("r0", "n0"))
    return run.groupBy("column").agg(F.max("n0").alias("n_before"), F.max("n1").alias("n_after"), F.max(gap).alias("ks"))


def categorical_shift(df: DataFrame, after: Column, cols: Sequence[str]) -> DataFrame:
    """Total variation and chi-square per categorical column between two snapshots."""
    long = melt(df.withColumn("_a", after.cast("int")), ["_a"], cols, "string").where("value is not null")
    vc = long.groupBy("column", "value").agg(F.sum("_a").alias("c1"), F.sum(1 - F.col("_a")).alias("c0"))
    tot = vc.groupBy("column").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    j = vc.join(F.broadcast(tot), "column")
    n = F.col("n0") + F.col("n1")
    e0, e1 = (F.col("c0") + F.col("c1")) * F.col("n0") / n, (F.col("c0") + F.col("c1")) * F.col("n1") / n
    return j.groupBy("column").agg(
        (F.sum(F.abs(F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0"))) / 2).alias("total_variation"),
        F.sum(F.pow(F.col("c0") - e0, 2) / e0 + F.pow(F.col("c1") - e1, 2) / e1).alias("chi2"), (F.count("*") - 1).alias("dof"))


def label_shift(df: DataFrame, after: Column, label: str) -> DataFrame:
    """Label shares in both snapshots."""
    d = df.withColumn("_a", after.cast("int"))
    g = d.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(1 - F.col("_a")).alias("c0"), F.sum("_a").alias("c1"))
    t = g.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    return g.join(F.broadcast(t)).select(label, (F.col("c0") / F.col("n0")).alias("before"), (F.col("c1") / F.col("n1")).alias("after"))


def feature_skew(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Per feature: rows that differ between two logs of the same ids, and ids on one side only."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a")).join(
        b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b")), key, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def differs(c):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return ~x.eqNullSafe(y) if not tol else (x.isNull() != y.isNull()) | (F.abs(x - y) > tol)

    s = j.agg(F.count_if(both).alias("n"), F.count_if(~both).alias("one_side"), *[F.count_if(both & differs(c)).alias(c) for c in cols])
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), F.col("one_side"), F.col(c).alias("n_different"),
                                                F.try_divide(c, "n").alias("rate")) for c in cols])))


def staleness(reads: DataFrame, refreshes: DataFrame, key: str, ts: str, cells: int | None = None) -> DataFrame:
    """Per read: microseconds since the latest strictly earlier refresh of the same key, null when there is none.

    The latest refresh is a running maximum, carried from cell to cell, so a key
    with a long history is spread over many tasks.
    """
    r = reads.select("*", F.col(ts).alias("_t"), F.lit(None).cast("long").alias("_r"), F.lit(0).alias("_k"))
    u = r.unionByName(refreshes.select(F.col(key), F.col(ts).alias("_t"), F.col(ts).alias("_r"), F.lit(1).alias("_k")), allowMissingColumns=True)
    d = with_cell(u, [key], "_t", cells)
    per = d.where("_split").groupBy(key, "_cell").agg(F.max("_r").alias("_m"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    d = add_offsets(d, [key], per.select(key, "_cell", F.max("_m").over(before).alias("_c")))
    w = Window.partitionBy(key, "_cell").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.max("_r").over(w), F.col("_c"))
    return d.withColumn("_l", last).where("_k = 0").withColumn("age", F.col("_t") - F.col("_l")).drop("_t", "_r", "_k", "_cell", "_split", "_c", "_l")


def funnel(df: DataFrame, entity: str, steps: dict[str, Column], segment: str) -> DataFrame:
    """Entities reaching each step (having reached all before it) and the loss from the previous one."""
    names = list(steps)
    e = df.groupBy(entity, segment).agg(*[F.bool_or(c).alias(n) for n, c in steps.items()])
    reached = [reduce(lambda a, b: a & b, [F.col(n) for n in names[: i + 1]]) for i in range(len(names))]
    g = e.groupBy(segment).agg(*[F.count_if(r).alias(n) for n, r in zip(names, reached)])
    return g.select(segment, F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.col(n).alias("n"),
                 (F.lit(None).cast("double") if i == 0 else 1 - F.try_divide(n, names[i - 1])).alias("loss")) for i, n in enumerate(names)])))


def slice_ranking(df: DataFrame, period: Column, dims: Sequence[str], value: str) -> DataFrame:
    """Slices of a changed total by explanatory power, succinctness (share of volume) and surprise."""
    long = melt(df.withColumns({"_p": period.cast("int"), "_v": F.col(value).cast("double")}).where(F.col("_p").isin(0, 1)), ["_p", "_v"], dims, "string")
    s = long.where("value is not null").groupBy(F.col("column").alias("dim"), "value").agg(
        F.sum(F.when(F.col("_p") == 0, F.col("_v")).otherwise(0.0)).alias("before"), F.sum(F.when(F.col("_p") == 1, F.col("_v")).otherwise(0.0)).alias("after"))
    t = s.groupBy("dim").agg(F.sum("before").alias("_b"), F.sum("after").alias("_a"))
    j = s.join(F.broadcast(t), "dim")
    p, q = F.try_divide("before", "_b"), F.try_divide("after", "_a")
    part = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(0.0)
    return j.select("dim", "value", "before", "after",
                    F.try_divide(F.col("after") - F.col("before"), F.col("_a") - F.col("_b")).alias("explains"),
                    ((p + q) / 2).alias("size"), (0.5 * (part(p) + part(q))).alias("surprise"))


def is_is_not(df: DataFrame, dims: Sequence[str], fail: str) -> DataFrame:
    """Failing and clean counts per dimension value, and values seen on one side only."""
    c = _slice_counts(df, dims, fail)
    clean = F.col("n1") - F.col("f1")
    return c.select("dim", "value", F.col("f1").alias("failing"), clean.alias("clean"),
                    F.when(clean == 0, "only failing").when(F.col("f1") == 0, "only clean").otherwise("both").alias("seen"))


def ceiling_analysis(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """End-to-end success, and success with each stage made perfect. Each column says whether a stage was right."""
    names = list(stages)
    ok = {n: F.coalesce(c, F.lit(False)) for n, c in stages.items()}
    full = reduce(lambda a, b: a & b, ok.values())
    aggs = [F.avg(full.cast("double")).alias("_base")]
    for n in names:
        rest = [ok[m] for m in names if m != n]
        aggs.append(F.avg((reduce(lambda a, b: a & b, rest) if rest else F.lit(True)).cast("double")).alias(n))
    a = df.agg(*aggs)
    return a.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col("_base").alias("now"), F.col(n).alias("with_stage_perfect"),
                                                (F.col(n) - F.col("_base")).alias("headroom")) for n in names])))


def inject_faults(df: DataFrame, key: str, null_col: str, bad_col: str, bad_value, rate: float = 0.02, salt: str = "fault:") -> DataFrame:
    """A seeded copy with missing values, malformed values and repeated keys, each at `rate`."""
    u = lambda kind: stable_uniform(F.col(key), salt + kind)
    dirty = df.withColumn(null_col, F.when(u("null") >= rate, F.col(null_col))).withColumn(
        bad_col, F.when(u("bad") < rate, F.lit(bad_value)).otherwise(F.col(bad_col)))
    return dirty.unionByName(dirty.where(u("dup") < rate))
