"""Rollout assignment, delivery targets, timing ratings and suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import stable_bucket

# Delivery targets (metric, direction, limit).
DELIVERY_TARGETS = [("delivery_rate", "min", 0.95), ("hard_bounce_rate", "max", 0.02), ("complaint_rate", "max", 0.001)]

# Timing limits (good below, poor above); milliseconds except CLS.
TIMING_LIMITS = {
    "TTFB": (800.0, 1800.0), "FCP": (1800.0, 3000.0), "LCP": (2500.0, 4000.0), "INP": (200.0, 500.0),
    "TBT": (200.0, 600.0), "CLS": (0.1, 0.25), "SpeedIndex": (3400.0, 5800.0),
}


def assign_variation(attribute: Column, rules: Sequence[tuple[int, Column, float, str]], default: str, salt: str = "") -> Column:
    """First rule whose condition holds and whose cumulative percentage covers the key's stable bucket.

    `rules` are `(priority, condition, percentage, variation)`; a condition met
    but not covered falls through to the next rule.
    """
    bucket = stable_bucket(attribute, 100, salt)
    out = None
    for _, cond, pct, variation in sorted(rules, key=lambda r: r[0]):
        hit = F.coalesce(cond, F.lit(False)) & (bucket < F.lit(float(pct)))
        out = F.when(hit, variation) if out is None else out.when(hit, variation)
    return out.otherwise(default) if out is not None else F.lit(default)


def delivery_rates(df: DataFrame, delivered: Column, hard_bounce: Column, complaint: Column, by: Sequence[str] = ()) -> DataFrame:
    """Delivery, hard-bounce and complaint rates with their verdicts."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(delivered.cast("double")).alias("delivery_rate"),
                            F.avg(hard_bounce.cast("double")).alias("hard_bounce_rate"), F.avg(complaint.cast("double")).alias("complaint_rate"))
    return g.select(*by, "n", F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).alias("rate"), F.lit(lim).alias("target"),
        F.when((F.col(m) > lim) if side == "min" else (F.col(m) < lim), "ok").otherwise("out of range").alias("verdict")) for m, side, lim in DELIVERY_TARGETS])))


def rate_timing(df: DataFrame, metric: Column, value: Column) -> DataFrame:
    """Share of measurements rated good, needs improvement or poor, per metric."""
    good, poor = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (a, b) in TIMING_LIMITS.items():
        good, poor = F.when(metric == m, F.lit(a)).otherwise(good), F.when(metric == m, F.lit(b)).otherwise(poor)
    d = df.select(metric.alias("metric"), value.alias("_v"), good.alias("_g"), poor.alias("_p")).where("_g is not null and _v is not null")
    rating = F.when(F.col("_v") < F.col("_g"), "good").when(F.col("_v") <= F.col("_p"), "needs improvement").otherwise("poor")
    g = d.groupBy("metric", rating.alias("rating")).agg(F.count("*").alias("n"))
    t = g.groupBy("metric").agg(F.sum("n").alias("_t"))
    return g.join(F.broadcast(t), "metric").select("metric", "rating", "n", (F.col("n") / F.col("_t")).alias("share"))


def timing_rounds(df: DataFrame, round_col: str, arm: str, seconds: str) -> DataFrame:
    """Median ratio of arm b to arm a over rounds, rounds won, and the A/A spread if an arm `a2` ran too."""
    r = df.groupBy(round_col).agg(*[F.avg(F.when(F.col(arm) == x, F.col(seconds))).alias(x) for x in ("a", "a2", "b")])
    out = []
    for name, x, y in (("A/A", "a", "a2"), ("A/B", "a", "b")):
        out.append((name, x, y))
    s = r.agg(*[x for n, a, b in out for x in (
        F.count(F.col(b) / F.col(a)).alias(f"n_{b}"), F.percentile(F.col(b) / F.col(a), 0.5).alias(f"m_{b}"), F.count_if(F.col(b) < F.col(a)).alias(f"w_{b}"))])
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(f"n_{b}").alias("rounds"), F.col(f"m_{b}").alias("median_ratio"),
                                                F.col(f"w_{b}").alias("rounds_won")) for n, a, b in out]))).where("rounds > 0")


def suppress(recipients: DataFrame, address: str, suppression: DataFrame, now: Column) -> DataFrame:
    """Recipients not on the suppression list; an entry counts until it expires, addresses match in any case."""
    live = suppression.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.lower("address").alias("_a")).distinct()
    return recipients.withColumn("_a", F.lower(address)).join(live, "_a", "left_anti").drop("_a")


def suppressed_by_reason(recipients: DataFrame, address: str, suppression: DataFrame, now: Column) -> DataFrame:
    """Recipients removed, by reason."""
    live = suppression.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).groupBy(F.lower("address").alias("_a")).agg(F.min("reason").alias("reason"))
    return recipients.withColumn("_a", F.lower(address)).join(live, "_a").groupBy("reason").agg(F.count("*").alias("n"))
