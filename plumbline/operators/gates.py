"""Pipeline gates: one-row results `(gate, status, observed, expected, message)`.

`status` is pass, fail or abstain. A statistic that is null or not a number
abstains, and `enforce` treats that like a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "gate string, status string, observed double, expected double, message string"
Gate = Callable[[DataFrame], DataFrame]


class GateError(ValueError):
    """Raised by `enforce` for any gate that failed or abstained."""


def enforce(result: DataFrame) -> DataFrame:
    """Raise unless every gate passed; otherwise return the result unchanged."""
    bad = [f"{r['gate']}: {r['status']} - {r['message']}" for r in result.where("status <> 'pass'").collect()]  # one row per gate
    if bad:
        raise GateError("; ".join(bad))
    return result


def exit_code(result: DataFrame) -> int:
    """0 when all passed, 1 for a failure, 2 when a gate could not run."""
    seen = {r["status"] for r in result.select("status").distinct().collect()}
    return 2 if not seen or "abstain" in seen else 1 if "fail" in seen else 0


def _result(df: DataFrame, gate: str, observed: Column, expected: Column, ok: Column, message: Column) -> DataFrame:
    obs = observed.cast("double")
    unusable = obs.isNull() | F.isnan(obs) | ok.isNull()
    status = F.when(unusable, "abstain").when(ok, "pass").otherwise("fail")
    return df.select(F.lit(gate).alias("gate"), status.alias("status"), obs.alias("observed"),
                     expected.cast("double").alias("expected"),
                     F.when(status == "pass", "").when(status == "abstain", "the statistic could not be computed")
                     .otherwise(message).alias("message"))


def run_gates(df: DataFrame, gates: dict[str, Gate]) -> DataFrame:
    """Apply caller-supplied checks; each returns the five gate columns and is named by its key."""
    parts = [g(df).select(F.lit(n).alias("gate"), "status", F.col("observed").cast("double").alias("observed"),
                          F.col("expected").cast("double").alias("expected"), "message") for n, g in gates.items()]
    return reduce(DataFrame.unionByName, parts)


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))
    return _result(g, name, F.col("d"), F.lit(0), F.col("d") == 0,
                   F.format_string("%d rows repeat the key " + ", ".join(keys), "d"))


def row_conservation(before: DataFrame, after: DataFrame, expected: int | None = None,
                     name: str = "row_conservation") -> DataFrame:
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    target = F.lit(expected) if expected is not None else F.col("b")
    return _result(both, name, F.col("a"), target, F.col("a") == target,
                   F.format_string("%d rows in, %d out, off by %d", "b", "a", F.col("a") - target))


def injective_transform(df: DataFrame, original: str, transformed: Column, name: str = "injective_transform") -> DataFrame:
    from plumbline.operators.contract import injective
    g = injective(df, original, transformed)
    return _result(g, name, F.col("n_out"), F.col("n_in"), F.col("n_in") == F.col("n_out"),
                   F.format_string("%d distinct values became %d", "n_in", "n_out"))


def zero_is_structural(df: DataFrame, value: str, observed: str, name: str = "zero_is_structural") -> DataFrame:
    """Zeros where nothing was measured; the observed flag must be a clean boolean or 0/1."""
    t = df.schema[observed].dataType
    if isinstance(t, T.StringType):
        raise TypeError(f"{observed} is text; casting text to boolean makes every value true")
    flag = F.col(observed).cast("double")
    g = df.agg(F.count("*").alias("n"), F.count_if(flag.isNull()).alias("u"), F.count_if(~flag.isin(0.0, 1.0)).alias("x"),
               F.count_if((F.col(value) == 0) & (flag == 0)).alias("bad"))
    unusable = (F.col("u") > 0) | (F.col("x") > 0)
    return _result(g, name, F.when(~unusable, F.col("bad")), F.lit(0), F.col("bad") == 0,
                   F.format_string("%d zeros where nothing was measured", "bad"))


def same_denominator(df: DataFrame, rates: Sequence[tuple[str, str]], denominator: str, tol: float = 1e-9,
                     name: str = "same_denominator") -> DataFrame:
    """Relative deviation of numerator / rate from the denominator, floored at magnitude 1."""
    den = F.col(denominator).cast("double")
    aggs = []
    for i, (rate, num) in enumerate(rates):
        dev = F.abs(F.try_divide(F.col(num).cast("double"), F.when(F.col(rate) != 0, F.col(rate))) - den)
        aggs.append(F.max(F.try_divide(dev, F.greatest(F.abs(den), F.lit(1.0)))).alias(f"d{i}"))
    g = df.agg(*aggs)
    rows = [_result(g, f"{name}:{r}", F.col(f"d{i}"), F.lit(tol), F.col(f"d{i}") <= tol,
                    F.format_string(f"{r} is off {denominator} by up to %.6g", f"d{i}")) for i, (r, _) in enumerate(rates)]
    return reduce(DataFrame.unionByName, rows)


def bounded(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0, name: str = "bounded") -> DataFrame:
    c = F.col(col)
    g = df.agg(F.count(c).alias("n"), F.count_if((c < lo) | (c > hi)).alias("b"), F.min(c).cast("double").alias("lo"),
               F.max(c).cast("double").alias("hi"))
    return _result(g, f"{name}:{col}", F.when(F.col("n") > 0, F.col("b")), F.lit(0), F.col("b") == 0,
                   F.format_string(f"%d values outside [{lo}, {hi}], range %.6g to %.6g", "b", "lo", "hi"))


def inclusion_probs(df: DataFrame, pi: str, n: int, tol: float = 0.5, name: str = "inclusion_probs") -> DataFrame:
    """Inclusion probabilities must sum to the sample size; a missing one abstains."""
    g = df.agg(F.sum(pi).cast("double").alias("s"), F.count_if(F.col(pi).isNull()).alias("m"))
    s = F.when(F.col("m") == 0, F.round("s", 9))
    return _result(g, name, s, F.lit(n), F.abs(F.col("s") - n) <= tol, F.format_string(f"probabilities sum to %.2f, not {n}", "s"))


def draws_usable(df: DataFrame, ok: Column, requested: int, share: float = 0.5, name: str = "draws_usable") -> DataFrame:
    if requested <= 0:
        raise GateError("no draws were requested")
    g = df.agg(F.count_if(ok).alias("k"))
    return _result(g, name, F.col("k"), F.lit(share * requested), F.col("k") >= share * requested,
                   F.format_string(f"only %d of {requested} draws fit", "k"))


def published_is_conservative(df: DataFrame, spec: str, estimate: str, published: str,
                              name: str = "published_is_conservative") -> DataFrame:
    """No other specification may be smaller in magnitude; any unusable estimate abstains."""
    a = F.abs(F.col(estimate).cast("double"))
    g = df.agg(F.max(F.when(F.col(spec) == published, a)).alias("p"), F.min(F.when(F.col(spec) != published, a)).alias("m"),
               F.count_if(a.isNull() | F.isnan(a)).alias("bad"))
    return _result(g, name, F.when(F.col("bad") == 0, F.col("p")), F.col("m"), F.col("p") <= F.col("m"),
                   F.format_string("published %.6g, smallest alternative %.6g", "p", "m"))


def decomposition_reconciles(df: DataFrame, component: str, total: float | Column, tol: float = 1e-6,
                             name: str = "decomposition_reconciles") -> DataFrame:
    t = total if isinstance(total, Column) else F.lit(float(total))
    g = df.agg(F.sum(component).alias("s"), F.count_if(F.col(component).isNull()).alias("m"), F.max(t).alias("t"))
    gap = F.abs(F.col("s") - F.col("t"))
    return _result(g, name, F.when(F.col("m") == 0, F.col("s")), F.col("t"), gap <= tol,
                   F.format_string("components sum to %.9g, total is %.9g", "s", "t"))


def flip_matrix(old: DataFrame, new: DataFrame, truth: DataFrame, key: str, label: str, near: DataFrame | None = None) -> DataFrame:
    """Counts by (old right, new right) for items all three know.

    With `near`, the keys that share the feature a fix is about, there is a `slice`
    too: `near_miss` for those among them that were right before, where a narrow fix
    does its damage, and `other` for the rest.
    """
    j = (truth.select(key, F.col(label).alias("t")).join(old.select(key, F.col(label).alias("o")), key)
         .join(new.select(key, F.col(label).alias("n")), key))
    was, now = F.col("o").eqNullSafe(F.col("t")).alias("old_right"), F.col("n").eqNullSafe(F.col("t")).alias("new_right")
    if near is None:
        return j.groupBy(was, now).agg(F.count("*").alias("n"))
    j = j.join(near.select(key).distinct().withColumn("_near", F.lit(True)), key, "left")
    part = F.when(F.col("_near") & was, "near_miss").otherwise("other").alias("slice")
    return j.groupBy(part, was, now).agg(F.count("*").alias("n"))


def accept_fix(metrics: DataFrame, baseline: DataFrame, max_cost: float, tol: float = 0.0) -> DataFrame:
    """Four gates for a fix: better in sample, better out of sample, no slice worse, cost within budget.

    Both inputs hold `(split, slice, metric, cost)`, split being in, out or other.
    """
    j = metrics.alias("a").join(baseline.alias("b"), ["split", "slice"], "full").select(
        "split", "slice", (F.col("a.metric") - F.col("b.metric")).alias("gain"), F.col("a.cost").alias("cost"))
    g = j.agg(F.min(F.when(F.col("split") == "in", F.col("gain"))).alias("gi"),
              F.min(F.when(F.col("split") == "out", F.col("gain"))).alias("go"),
              F.min(F.when(F.col("split") == "other", F.col("gain"))).alias("gx"), F.sum("cost").alias("c"),
              F.count_if(F.col("gain").isNull()).alias("m"))
    ok = F.col("m") == 0
    return reduce(DataFrame.unionByName, [
        _result(g, "in_sample_gain", F.when(ok, F.col("gi")), F.lit(0.0), F.col("gi") > 0, F.lit("no gain in sample")),
        _result(g, "out_of_sample_gain", F.when(ok, F.col("go")), F.lit(0.0), F.col("go") > 0, F.lit("no gain out of sample")),
        _result(g, "no_degradation", F.when(ok, F.col("gx")), F.lit(-tol), F.col("gx") >= -tol, F.lit("another slice got worse")),
        _result(g, "cost", F.col("c"), F.lit(max_cost), F.col("c") <= max_cost, F.lit("cost above budget"))])
