"""Weighted estimates, time buckets and reports over event tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import Key, add_offsets, cell_offsets, join_null_safe, sort_keys, with_lookback, with_order_cells

Z95 = 1.959964


def weighted_totals(df: DataFrame, by: Sequence[str], weight: str, value: str) -> DataFrame:
    """Estimated count, sum and mean of a sampled table, beside the sampled row count."""
    w = F.col(weight)
    return df.groupBy(*by).agg(F.count("*").alias("sample_size"), F.sum(w).alias("est_count"),
                               F.sum(w * F.col(value)).alias("est_sum"),
                               F.try_divide(F.sum(w * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), w))).alias("est_mean"))


def weighted_intervals(df: DataFrame, by: Sequence[str], weight: str, value: str, z: float = Z95) -> DataFrame:
    """Normal intervals for estimated counts and sums under independent sampling."""
    w, x = F.col(weight), F.col(value)
    g = df.groupBy(*by).agg(F.count("*").alias("sample_size"), F.sum(w).alias("c"), F.sum(w * x).alias("s"),
                            F.sum(w * (w - 1)).alias("vc"), F.sum(w * (w - 1) * x * x).alias("vs"))
    out = []
    for name, e, v in (("count", "c", "vc"), ("sum", "s", "vs")):
        half = z * F.sqrt(v)
        out.append(F.struct(F.lit(name).alias("measure"), F.col(e).alias("estimate"), (F.col(e) - half).alias("lower"),
                            (F.col(e) + half).alias("upper")))
    return g.select(*by, "sample_size", F.inline(F.array(*out)))


# The time-bucket dimensions a report may ask for, in seconds.
BUCKETS = {"1 minute": 60, "5 minutes": 300, "15 minutes": 900, "1 hour": 3600, "6 hours": 21600, "1 day": 86400}


def time_bucket(ts: Column, width: str) -> Column:
    """Start of the bucket of the given width, aligned to UTC midnight."""
    micros = BUCKETS[width] * 1_000_000
    t = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(t - F.pmod(t, F.lit(micros).cast("long")))


def rollup_reconcile(exact: DataFrame, sampled: DataFrame, ts: str, unit: str, weight: str) -> DataFrame:
    """Exact counts per period beside the sampled estimate and whether its interval covers them."""
    a = exact.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.count("*").alias("exact"))
    b = sampled.groupBy(F.date_trunc(unit, ts).alias("period")).agg(
        F.sum(weight).alias("estimate"), F.sum(F.col(weight) * (F.col(weight) - 1)).alias("_v"))
    j = a.join(b, "period", "left")
    half = Z95 * F.sqrt(F.coalesce("_v", F.lit(0.0)))
    est = F.coalesce("estimate", F.lit(0.0))
    return j.select("period", "exact", est.alias("estimate"), (est - F.col("exact")).alias("error"),
                    (F.abs(est - F.col("exact")) <= half).alias("covered"))


def entity_profile(df: DataFrame, ts: str, entity: str, kind: str, flag: Column) -> DataFrame:
    """Hourly request volume, diversity and flagged share per entity, with rank among all entities.

    Ranks come from counts of equal volumes per hour, a table far smaller than
    the list of entities, so no hour is sorted in one task.
    """
    base = df.groupBy(F.date_trunc("hour", ts).alias("hour"), entity, kind).agg(
        F.count("*").alias("c"), F.count_if(flag).alias("f"))
    per = base.groupBy("hour", entity).agg(F.sum("c").alias("requests"), F.count("*").alias("kinds"),
                                           (F.sum("f") / F.sum("c")).alias("flagged_share"))
    vc = per.groupBy("hour", "requests").agg(F.count("*").alias("m"))
    w = Window.partitionBy("hour").orderBy(F.desc("requests"))
    vc = (vc.withColumn("rank", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
          .withColumn("n_entities", F.sum("m").over(Window.partitionBy("hour"))))
    pr = F.when(F.col("n_entities") > 1, (F.col("rank") - 1) / (F.col("n_entities") - 1)).otherwise(0.0)
    return per.join(vc.withColumn("percent_rank", pr).drop("m"), ["hour", "requests"])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First `k` rows per group; the limit is applied before the shuffle as well as after."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def _in_cell(by: Sequence[str], order: Sequence[str | Key]):
    return Window.partitionBy(*by, "_cell").orderBy(*[k.column() for k in sort_keys(order)], "_tie")


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], cells: int | None = None) -> DataFrame:
    """`row_number` of each row in its group; heavy groups are numbered cell by cell. `order` takes names and `Key`s."""
    d = with_order_cells(df, by, order, cells)
    d = add_offsets(d, by, cell_offsets(d, by, {"_off": F.count("*")}))
    rn = F.coalesce("_off", F.lit(0).cast("long")) + F.row_number().over(_in_cell(by, order))
    return d.withColumn("rn", rn).drop("_cell", "_split", "_tie", "_off")


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], value: str, offset: int, default: float, cells: int | None = None) -> DataFrame:
    """The value `offset` rows earlier in its group. `order` takes names and `Key`s."""
    d = with_lookback(df, by, order, offset, cells)
    return d.withColumn("lagged", F.lag(value, offset, default).over(_in_cell(by, order))).where("not _ctx").drop("_ctx", "_cell", "_tie")


def moving_mean(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], value: str, preceding: int, cells: int | None = None) -> DataFrame:
    """Mean of the current and `preceding` earlier rows. `order` takes names and `Key`s."""
    d = with_lookback(df, by, order, preceding, cells)
    return d.withColumn("moving", F.avg(value).over(_in_cell(by, order).rowsBetween(-preceding, 0))).where("not _ctx").drop("_ctx", "_cell", "_tie")


def nth_values(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """`nth_value` under the default frame: null until the n-th row is reached."""
    first = top_per_group(df, by, [F.col(c) for c in order], n).where(F.col("rn") == n).select(
        *by, F.struct(*order).alias("_at"), F.col(value).alias("_v"))
    j = join_null_safe(df, first, by, "left")
    return j.withColumn("nth", F.when(F.struct(*order) >= F.col("_at"), F.col("_v"))).drop("_at", "_v")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack several one-row aggregates of one schema under their aliases."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("alias"), "*") for n, d in parts.items()])
