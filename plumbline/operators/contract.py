"""Join contracts: uniqueness, row conservation, match rates and key repair.

Everything is derived from per-key row counts of both sides, so the join itself
never runs. Nulls in keys group together, and count as a match only with null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordered import join_null_safe

CARDINALITIES = ("1:1", "m:1", "1:m")


@dataclass(frozen=True)
class JoinContract:
    """What a join promises: keys, cardinality, type, floor and groups to report."""

    left_keys: Sequence[str]
    right_keys: Sequence[str]
    card: str = "m:1"
    how: str = "left"
    min_match: float = 0.0
    groups: Sequence[str] = field(default_factory=tuple)
    max_levels: int | None = None
    spread: float = 0.02

    def __post_init__(self):
        if self.card not in CARDINALITIES:
            raise ValueError(f"cardinality {self.card!r} is refused; declare one of {CARDINALITIES}")
        if self.how not in ("left", "inner"):
            raise ValueError("join type must be left or inner")
        if not 0 <= self.min_match <= 1:
            raise ValueError("min_match must lie in [0, 1]")
        if len(self.left_keys) != len(self.right_keys):
            raise ValueError("both sides need the same number of keys")


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, surplus rows on repeated keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))


def duplicate_examples(df: DataFrame, keys: Sequence[str], k: int = 6) -> DataFrame:
    """The first `k` repeated keys in key order, with their row counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys).limit(k)


def key_counts(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> DataFrame:
    """Per key `(k0.., nl, nr)`: rows on each side, zero when absent.

    One shuffle over a union of pre-aggregated sides; a hot key arrives as one
    partial row per map task.
    """
    names = [f"k{i}" for i in range(len(lk))]
    a = left.select(*[F.col(c).alias(n) for c, n in zip(lk, names)], F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(*[F.col(c).alias(n) for c, n in zip(rk, names)], F.lit(0).alias("l"), F.lit(1).alias("r"))
    return a.unionByName(b).groupBy(*names).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))


def _contract_sums(counts: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(
        total("nl").alias("left_rows"), total("nr").alias("right_rows"),
        F.count_if(F.col("nl") > 0).alias("left_distinct"), F.count_if(F.col("nr") > 0).alias("right_distinct"),
        total(F.greatest(F.col("nl") - 1, F.lit(0))).alias("left_dup"),
        total(F.greatest(F.col("nr") - 1, F.lit(0))).alias("right_dup"),
        total(F.col("nl") * F.col("nr")).alias("inner_rows"),
        total(F.col("nl") * F.greatest("nr", F.lit(1))).alias("left_join_rows"),
        total(F.when(F.col("nr") > 0, F.col("nl")).otherwise(0)).alias("left_matched"),
        total(F.when(F.col("nl") > 0, F.col("nr")).otherwise(0)).alias("right_matched"))


def predicted_rows(left: DataFrame, right: DataFrame, c: JoinContract) -> DataFrame:
    """Rows an inner and a left join would return."""
    return _contract_sums(key_counts(left, right, c.left_keys, c.right_keys)).select(
        "left_rows", "right_rows", "inner_rows", "left_join_rows")


def _verdict(check: str, observed: Column, expected: Column, bad: Column, abstain: Column | None = None) -> Column:
    status = F.when(bad, "fail").otherwise("pass")
    if abstain is not None:
        status = F.when(abstain, "abstain").otherwise(status)
    return F.struct(F.lit(check).alias("check"), observed.cast("double").alias("observed"),
                    expected.cast("double").alias("expected"), status.alias("status"))


def check_join(left: DataFrame, right: DataFrame, c: JoinContract) -> DataFrame:
    """Every contract check as `(check, observed, expected, status)` from one aggregate."""
    s = _contract_sums(key_counts(left, right, c.left_keys, c.right_keys))
    col = F.col
    rows_out = col("inner_rows") if c.how == "inner" else col("left_join_rows")
    need_l, need_r = c.card in ("1:1", "1:m"), c.card in ("1:1", "m:1")
    empty = col("left_rows") == 0
    left_rate = F.try_divide(col("left_matched"), col("left_rows"))
    right_rate = F.try_divide(col("right_matched"), col("right_rows"))
    conserve = c.how == "left" and c.card in ("m:1", "1:1")
    checks = [
        _verdict("left_unique", col("left_dup"), F.lit(0), F.lit(need_l) & (col("left_dup") > 0)),
        _verdict("right_unique", col("right_dup"), F.lit(0), F.lit(need_r) & (col("right_dup") > 0)),
        _verdict("rows_out", rows_out, col("left_rows"), F.lit(conserve) & (rows_out != col("left_rows"))),
        _verdict("left_rows_dropped", col("left_rows") - col("left_matched"), F.lit(0),
                 F.lit(c.how == "inner") & (col("left_matched") < col("left_rows"))),
        _verdict("left_match_rate", left_rate, F.lit(c.min_match), left_rate < c.min_match, empty),
        _verdict("right_match_rate", right_rate, F.lit(0.5), F.lit(False), col("right_rows") == 0),
    ]
    return s.select(F.inline(F.array(*checks)))


def row_conservation(left: DataFrame, right: DataFrame, c: JoinContract, expected: int | None = None) -> DataFrame:
    """Rows in, rows out and their difference; `expected` overrides rows in."""
    out = "inner_rows" if c.how == "inner" else "left_join_rows"
    target = F.lit(expected) if expected is not None else F.col("left_rows")
    return _contract_sums(key_counts(left, right, c.left_keys, c.right_keys)).select(
        "left_rows", F.col(out).alias("rows_out"), (F.col(out) - target).alias("excess"),
        (F.col("left_rows") - F.col("left_matched")).alias("left_unmatched"),
        F.when(F.col(out) == target, "pass").otherwise("fail").alias("status"))


def match_rates(left: DataFrame, right: DataFrame, c: JoinContract) -> DataFrame:
    """Match rate of each side with the floor verdict and the level-mismatch note."""
    s = _contract_sums(key_counts(left, right, c.left_keys, c.right_keys))
    lr = F.try_divide("left_matched", "left_rows")
    rr = F.try_divide("right_matched", "right_rows")
    return s.select("left_matched", "left_rows", lr.alias("left_rate"), "right_matched", "right_rows",
                    rr.alias("right_rate"),
                    F.when(lr.isNull(), "abstain").when(lr < c.min_match, "fail").otherwise("pass").alias("status"),
                    F.coalesce(rr < 0.5, F.lit(False)).alias("right_mostly_unmatched"))


def match_rate_by_group(left: DataFrame, right: DataFrame, c: JoinContract) -> DataFrame:
    """Match rate per level of each declared group, with the spread across levels.

    The left side is first reduced to one row per (keys, group levels), so a hot
    key crosses the shuffle once per level. With `max_levels`, a group of more levels
    comes back as one row without a level that carries its totals and its spread.
    """
    groups = [g for g in c.groups if g in left.columns]
    if not groups:
        raise ValueError("no declared group is a column of the left table")
    names = [f"k{i}" for i in range(len(c.left_keys))]
    lc = left.select(*[F.col(k).alias(n) for k, n in zip(c.left_keys, names)],
                     *[F.col(g).cast("string").alias(f"g_{g}") for g in groups])
    lc = lc.groupBy(*lc.columns).agg(F.count("*").alias("n"))
    rk = right.select(*[F.col(k).alias(n) for k, n in zip(c.right_keys, names)]).distinct().withColumn(
        "hit", F.lit(1))
    j = join_null_safe(lc, rk, names, "left")
    per = (j.select(F.inline(F.array(*[
                F.struct(F.lit(g).alias("group"), F.col(f"g_{g}").alias("level"),
                         "n", F.when(F.col("hit").isNotNull(), F.col("n")).otherwise(0).alias("m"))
                for g in groups])))
           .where("level is not null").groupBy("group", "level")
           .agg(F.sum("n").alias("n"), F.sum("m").alias("matched"))
           .withColumn("rate", F.col("matched") / F.col("n")))
    spread = per.groupBy("group").agg((F.max("rate") - F.min("rate")).alias("spread"), F.count("*").alias("levels"))
    d = per.join(spread, "group")
    if c.max_levels is not None:
        wide = F.col("levels") > c.max_levels
        d = d.groupBy("group", F.when(~wide, F.col("level")).alias("level"), "spread").agg(F.sum("n").alias("n"), F.sum("matched").alias("matched")).withColumn(
            "rate", F.col("matched") / F.col("n"))
    return (d.select("group", "level", "n", "matched", "rate", "spread", (F.col("spread") > c.spread).alias("flag")))


def _side_only(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> DataFrame:
    counts = key_counts(left, right, lk, rk)
    return counts.where("nl = 0 or nr = 0").withColumn("side", F.when(F.col("nr") == 0, "left").otherwise("right"))


def unmatched_keys(left: DataFrame, right: DataFrame, c: JoinContract, k: int | None = 10) -> DataFrame:
    """Distinct keys present on one side only; the first `k` per side, or all with `k=None`."""
    only = _side_only(left, right, c.left_keys, c.right_keys)
    names = [n for n in only.columns if n.startswith("k")]
    if k is None:
        return only.select("side", *names)
    w = Window.partitionBy("side").orderBy(*names)
    return only.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("side", "rn", *names)


REPAIRS = {
    "strip_leading_zeros": lambda c: F.regexp_replace(c, "^0+", ""),
    "trim": lambda c: F.trim(c),
    "lowercase": lambda c: F.lower(c),
}


def key_repairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """For each repair, distinct unmatched keys that would meet after it."""
    only = _side_only(left.select(F.col(left_key).cast("string")), right.select(F.col(right_key).cast("string")),
                      [left_key], [right_key]).where("k0 is not null")
    return (only.select("side", F.inline(F.array(*[
                F.struct(F.lit(name).alias("repair"), fn(F.col("k0")).alias("fixed")) for name, fn in REPAIRS.items()])))
            .groupBy("repair", "fixed").agg(F.max(F.when(F.col("side") == "left", 1).otherwise(0)).alias("l"),
                                            F.max(F.when(F.col("side") == "right", 1).otherwise(0)).alias("r"))
            .groupBy("repair").agg(F.sum(F.col("l") * F.col("r")).alias("new_matches"))
            .withColumn("helps", F.col("new_matches") > 0))


def key_guard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numeric keys must be whole and below 2^53 to be safe as identifiers."""
    parts = []
    for k in keys:
        v = F.col(k).cast("double")
        numeric = isinstance(df.schema[k].dataType, T.NumericType)
        floating = isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType))
        frac = F.sum(F.when(v != F.floor(v), 1).otherwise(0)) if numeric and floating else F.lit(0)
        big = F.sum(F.when(F.abs(v) > float(2**53), 1).otherwise(0)) if numeric else F.lit(0)
        parts.append(F.struct(F.lit(k).alias("key"), F.coalesce(frac, F.lit(0)).cast("long").alias("n_fractional"),
                              F.coalesce(big, F.lit(0)).cast("long").alias("n_too_large")))
    return (df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
            .withColumn("status", F.when(F.col("n_fractional") + F.col("n_too_large") > 0, "fail").otherwise("pass")))


def key_text(df: DataFrame, key: str) -> Column:
    """A numeric key written out in full, never in scientific notation."""
    if isinstance(df.schema[key].dataType, (T.DoubleType, T.FloatType)):
        return F.col(key).cast("decimal(38,0)").cast("string")
    return F.col(key).cast("string")


def injective(df: DataFrame, original: str, transformed: Column) -> DataFrame:
    """Distinct values before and after a key transform, and outputs hit by several inputs."""
    pairs = df.select(F.col(original).alias("a"), transformed.alias("b")).where("a is not null").distinct()
    return (pairs.groupBy("b").agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_in"), F.count("b").alias("n_out"),
                 F.count_if((F.col("n") > 1) & F.col("b").isNotNull()).alias("n_colliding_outputs"))
            .withColumn("collisions", F.col("n_in") - F.col("n_out"))
            .withColumn("status", F.when(F.col("collisions") != 0, "fail").otherwise("pass")))


def post_join_missing(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str],
                      cols: Sequence[str]) -> DataFrame:
    """Per right column: missing share on its own table and after a left join.

    Computed from right-side per-key null counts and left multiplicities.
    """
    names = [f"k{i}" for i in range(len(lk))]
    per_right = right.groupBy(*[F.col(k).alias(n) for k, n in zip(rk, names)]).agg(
        F.count("*").alias("nr"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in cols])
    per_left = left.groupBy(*[F.col(k).alias(n) for k, n in zip(lk, names)]).agg(F.count("*").alias("nl"))
    j = join_null_safe(per_left, per_right, names, "left")
    after = j.agg(F.sum(F.col("nl") * F.greatest(F.coalesce("nr", F.lit(0)), F.lit(1))).alias("n"),
                  *[F.sum(F.col("nl") * F.coalesce(F.col(f"m_{c}"), F.lit(1))).alias(f"a_{c}") for c in cols])
    before = right.agg(F.count("*").alias("nb"), *[F.count_if(F.col(c).isNull()).alias(f"b_{c}") for c in cols])
    return after.join(F.broadcast(before)).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.try_divide(f"b_{c}", "nb").alias("missing_before"),
                 F.try_divide(f"a_{c}", "n").alias("missing_after")) for c in cols])))


def reindex_counts(spine: DataFrame, facts: DataFrame, spine_key: str, fact_key: str, name: str) -> DataFrame:
    """Counts on the full unit list: zero where a unit was in the frame and had no rows."""
    agg = facts.groupBy(F.col(fact_key).alias(spine_key)).agg(F.count("*").alias(name))
    return spine.select(spine_key).join(agg, spine_key, "left").withColumn(
        "filled", F.col(name).isNull()).withColumn(name, F.coalesce(name, F.lit(0)))


def reindex_additive(reindexed: DataFrame, facts: DataFrame, spine_key: str, fact_key: str, name: str) -> DataFrame:
    """Reindexing may add units but must not change the rows that existed."""
    agg = facts.groupBy(F.col(fact_key).alias(spine_key)).agg(F.count("*").alias("want"))
    j = reindexed.join(agg, spine_key, "full")
    return j.agg(F.count_if(F.col(name).isNotNull() & F.col("want").isNull()).alias("n_added"),
                 F.count_if(F.col("want").isNotNull() & ~F.col(name).eqNullSafe(F.col("want"))).alias("n_changed")
                 ).withColumn("status", F.when(F.col("n_changed") > 0, "fail").otherwise("pass"))


def null_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with any null key, reported apart from the match rate."""
    anynull = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.agg(F.count("*").alias("n_rows"), F.count_if(anynull).alias("n_null_key"))
