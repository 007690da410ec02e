"""Extraction quality: error floor and ceiling, triage routing, plausibility, repair guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import join_null_safe


def repeated(df: DataFrame, value: str, scope: Sequence[str] = ()) -> DataFrame:
    """Adds `_repeated`: the value occurs more than once in its scope.

    Counts run over 128-bit digests, so long values never cross the shuffle.
    """
    d = df.withColumn("_h", F.unhex(F.md5(F.col(value).cast("string"))))
    keys = [*scope, "_h"]
    many = d.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n").withColumn("_r", F.lit(True))
    return join_null_safe(d, many, keys, "left").withColumn("_repeated", F.coalesce("_r", F.lit(False))).drop("_h", "_r")


def error_floor(df: DataFrame, detectors: dict[str, tuple[str, Column]]) -> DataFrame:
    """Provably wrong values per detector, and the share of rows with any hit per field."""
    fields = sorted({f for f, _ in detectors.values()})
    hit = {n: F.coalesce(c, F.lit(False)) for n, (_, c) in detectors.items()}
    any_of = {f: reduce(lambda a, b: a | b, [hit[n] for n, (g, _) in detectors.items() if g == f]) for f in fields}
    a = df.agg(F.count("*").alias("_n"), *[F.count_if(h).alias(f"h_{n}") for n, h in hit.items()],
               *[F.count_if(h).alias(f"f_{f}") for f, h in any_of.items()])
    return a.select(F.inline(F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(n).alias("detector"), F.col(f"h_{n}").alias("n_wrong"), F.try_divide(f"h_{n}", "_n").alias("share"))
          for n, (f, _) in detectors.items()],
        *[F.struct(F.lit(f).alias("field"), F.lit("any").alias("detector"), F.col(f"f_{f}").alias("n_wrong"), F.try_divide(f"f_{f}", "_n").alias("share"))
          for f in fields])))


def disagreement(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Share of items two passes read differently: the error ceiling. Two missing reads agree."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols]), key)
    s = j.agg(F.count("*").alias("n"), *[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in cols])
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col("n"), F.col(c).alias("n_different"),
                                                F.try_divide(c, "n").alias("rate")) for c in cols])))


def read_class(text: Column, short: int = 20, letters: float = 0.6) -> Column:
    """empty, short, garbled (too few letters among non-blank characters) or ok."""
    # counting the rarer characters leaves the text uncopied
    solid = F.length(text) - F.regexp_count(text, F.lit(r"\s"))
    alpha = F.length(text) - F.regexp_count(text, F.lit(r"[^\p{L}]"))
    return (F.when(text.isNull() | (solid == 0), "empty").when(F.length(F.trim(text)) < short, "short")
            .when(alpha / solid < letters, "garbled").otherwise("ok"))


def rate_by_category(df: DataFrame, wrong: Column, by: str) -> DataFrame:
    """Error rate per category, with its distance from the overall rate."""
    d = df.select(F.col(by), F.coalesce(wrong, F.lit(False)).cast("double").alias("_w"))
    g = d.groupBy(by).agg(F.count("*").alias("n"), F.sum("_w").alias("_s"))
    t = g.agg((F.sum("_s") / F.sum("n")).alias("_o"))
    return g.join(F.broadcast(t)).select(by, "n", (F.col("_s") / F.col("n")).alias("rate"), (F.col("_s") / F.col("n") - F.col("_o")).alias("above_overall"))


def soundness(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Per field: present, and present and not provably wrong. `fields` maps a column to its wrongness."""
    a = df.agg(F.count("*").alias("_n"), *[x for f, w in fields.items() for x in (
        F.count(f).alias(f"p_{f}"), F.count_if(F.col(f).isNotNull() & ~F.coalesce(w, F.lit(False))).alias(f"s_{f}"))])
    return a.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.try_divide(f"p_{f}", "_n").alias("fill"),
                                                F.try_divide(f"s_{f}", "_n").alias("sound")) for f in fields])))


def closeness(value: Column, target: float) -> Column:
    """Higher is better: minus the distance to the target, so overshooting is no gain."""
    return -F.abs(value - F.lit(float(target)))


def route(df: DataFrame, key: str, detectors: dict[str, Column], truth: Column, unit_cost: dict[str, float], full_cost: float) -> DataFrame:
    """Escalation router: volume, each detector's own contribution, precision and recall, and cost.

    `truth` is an independent wrongness label, null where unknown. Cost counts
    the units each detector's reason makes a second pass re-read.
    """
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in detectors.items()}
    names = list(flags)
    d = df.select(key, *[f.alias(f"d_{n}") for n, f in flags.items()], truth.alias("_t"))
    hit = [F.col(f"d_{n}") for n in names]
    any_hit = reduce(lambda a, b: a | b, hit)
    votes = reduce(lambda a, b: a + b, [h.cast("int") for h in hit])
    known = F.col("_t").isNotNull()
    aggs = [F.count("*").alias("_n"), F.count_if(known & F.col("_t")).alias("_wrong")]
    parts = {**{n: (F.col(f"d_{n}"), F.lit(unit_cost[n])) for n in names},
             "any": (any_hit, sum((F.when(F.col(f"d_{n}"), F.lit(unit_cost[n])).otherwise(0.0) for n in names), F.lit(0.0)))}
    for n, (f, cost) in parts.items():
        alone = f & (votes == 1) if n != "any" else f & (votes >= 1)
        aggs += [F.count_if(f).alias(f"v_{n}"), F.count_if(alone).alias(f"a_{n}"), F.count_if(f & known).alias(f"k_{n}"),
                 F.count_if(f & known & F.col("_t")).alias(f"h_{n}"), F.sum(F.when(f, cost).otherwise(0.0)).alias(f"c_{n}")]
    s = d.agg(*aggs)
    return s.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("detector"), F.col(f"v_{n}").alias("n_flagged"), F.try_divide(f"v_{n}", "_n").alias("volume"), F.col(f"a_{n}").alias("n_only_this"),
        F.try_divide(f"h_{n}", f"k_{n}").alias("precision"), F.try_divide(f"h_{n}", "_wrong").alias("recall"),
        F.try_divide(F.col(f"c_{n}"), F.col("_n") * F.lit(float(full_cost))).alias("cost_share")) for n in parts])))


def falsification(df: DataFrame, detectors: dict[str, Column], implausible: Column) -> DataFrame:
    """Implausible rate inside the flagged set over the rate outside; null when nothing outside is implausible."""
    bad = F.coalesce(implausible, F.lit(False)).cast("double")
    aggs = []
    for n, c in detectors.items():
        f = F.coalesce(c, F.lit(False))
        aggs += [F.avg(F.when(f, bad)).alias(f"i_{n}"), F.avg(F.when(~f, bad)).alias(f"o_{n}")]
    s = df.agg(*aggs)
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"i_{n}").alias("inside"), F.col(f"o_{n}").alias("outside"),
                                                F.when(F.col(f"o_{n}") > 0, F.col(f"i_{n}") / F.col(f"o_{n}")).alias("ratio")) for n in detectors])))


def aggregate_plausibility(df: DataFrame, category: Column, ceilings: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Category shares against the most that is believable."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(category == c).alias(f"c{i}") for i, c in enumerate(ceilings)])
    return g.select(*by, "n", F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.try_divide(f"c{i}", "n").alias("share"), F.lit(top).alias("ceiling"),
                                                          (F.try_divide(f"c{i}", "n") > top).alias("implausible")) for i, (c, top) in enumerate(ceilings.items())])))


def guarded_repair(df: DataFrame, old: str, new: Column, out: str) -> DataFrame:
    """Apply a repair only where it keeps the text's width; `<out>_declined` marks the rest."""
    keep = F.length(new) == F.length(F.col(old))
    changed = ~new.eqNullSafe(F.col(old))
    return df.withColumn(out, F.when(keep, new).otherwise(F.col(old))).withColumn(f"{out}_declined", changed & ~F.coalesce(keep, F.lit(False)))
