"""The next row in descending order of a whole-number id, without a sort in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import q
from plumbline.session import broadcast_if_small

CELLS = 4096  # equal ranges of ids that are counted first
BUCKET_BYTES = 8 << 20  # text sorted in one task


def with_next(df: DataFrame, id: str, weight: Column, tie: Column, name: str = "next", enrich: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Add the following row in descending `id` as the struct `name`; after the last comes the first.

    Null ids come last. Equal ids are ordered by `tie`, a whole number; rows equal in
    both are interchangeable. Ids are cut into CELLS equal ranges, and each range, by
    the sum of `weight` in it, into buckets of about BUCKET_BYTES: by id, or by `tie`
    where a range is one id. A bucket is sorted in one task; the first row of the next
    bucket, one per bucket, is joined to its last. Rows move once.
    """
    spark = df.sparkSession
    d = df.select(F.struct(*[q(c) for c in df.columns]).alias("__in"), q(id).cast("long").alias("__id"), tie.cast("long").alias("__tie"), weight.alias("__w"))
    low, high = d.agg(F.min("__id"), F.max("__id")).first()
    low, high = (0, 0) if low is None else (low, high)
    wide = max(1, -(-(high - low + 1) // CELLS))
    cell = F.coalesce(F.lit(CELLS) - F.floor((F.col("__id").cast("double") - float(low)) / float(wide)).cast("int"), F.lit(CELLS + 1))
    d = d.withColumn("__cell", cell)
    cells = d.groupBy("__cell").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi"), F.sum("__w").alias("w")).collect()  # at most CELLS + 1 rows
    rows, at = [], 0
    for r in sorted(cells):
        n = max(1, -(-int(r["w"] or 0) // BUCKET_BYTES))
        rows.append((r["__cell"], r["lo"], r["hi"], n, at))
        at += n
    plan = F.broadcast(spark.createDataFrame(rows, "__cell int, __lo long, __hi long, __n long, __at long"))
    by_tie = F.pmod(F.shiftrightunsigned("__tie", 34), F.lit(2**30)) * F.col("__n") / F.lit(2**30)
    by_id = (F.col("__hi") - F.col("__id")).cast("double") * F.col("__n") / (F.col("__hi") - F.col("__lo") + 1).cast("double")
    part = F.least(F.floor(F.when(F.coalesce(F.col("__hi") > F.col("__lo"), F.lit(False)), by_id).otherwise(by_tie)), F.col("__n") - 1)
    d = d.join(plan, "__cell").withColumn("__bucket", F.col("__at") + part)
    order = F.struct(F.col("__id").isNull().alias("a"), F.bitwise_not("__id").alias("b"), F.shiftrightunsigned("__tie", 34).alias("c"), F.col("__tie").alias("d"))
    # the first row of each bucket goes to the bucket before it, that of the first one to the last
    first = d.groupBy("__bucket").agg(F.min(order).alias("o"))
    line = Window.orderBy("__bucket")  # one row per bucket
    goes_to = F.coalesce(F.lag("__bucket").over(line), F.max("__bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = first.select(goes_to.alias("__for"), F.bitwise_not("o.b").alias("__i"), F.col("o.d").alias("__t"))
    own = [F.col("__in").getField(c).alias(c) for c in df.columns]
    row = lambda x, *more: enrich(x.select(*own, F.struct(*more).alias("__at")))
    heads = d.join(broadcast_if_small(first), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__tie") == F.col("__t")))
    heads = row(heads, "__for").withColumn("__for", F.col("__at.__for"))
    d = row(d, "__id", "__tie", "__bucket")
    names = [c for c in d.columns if c != "__at"]
    whole = F.struct(*[q(c) for c in names])
    d = d.withColumns({c: F.col("__at").getField(c) for c in ("__id", "__tie", "__bucket")})
    heads = heads.select("__for", whole.alias("__head")).dropDuplicates(["__for"])
    line = Window.partitionBy("__bucket").orderBy(F.col("__id").desc_nulls_last(), F.shiftrightunsigned("__tie", 34), "__tie")
    d = d.withColumn("__next", F.lead(whole).over(line))
    d = d.join(heads, F.col("__bucket") == F.col("__for"), "left")
    return d.select(*[q(c) for c in names], F.coalesce("__next", "__head").alias(name))
