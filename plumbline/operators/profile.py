"""Column profiling: keys, missingness, ranges, sentinels, value counts, panel shape."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordered import melt, order_statistics, quantiles
from plumbline.session import cut

# Codes that commonly stand for "missing".
SENTINEL_NUMBERS = [
    -9999, -999, -99, -9, -8, -7, -6, -5, -4, -3, -2, -1,
    77, 88, 96, 97, 98, 99,
    777, 888, 996, 997, 998, 999,
    9996, 9997, 9998, 9999, 99999, 999999,
    127, 255, 32767, 65535, 2147483647,
]
SENTINEL_STRINGS = [
    "", " ", "NA", "N/A", "n/a", "na", ".", "..", "-", "--",
    "NULL", "null", "None", "none", "nan", "NaN", "#N/A", "#NULL!", "?",
    "unknown", "Unknown", "UNKNOWN", "Not Available", "Not Reported", "Not Applicable",
    "Refused", "Don't know", "DK", "RF", "missing", "Missing",
]
SENTINEL_DATES = [
    "1899-12-30", "1900-01-01", "1901-01-01", "1960-01-01",
    "1970-01-01", "0001-01-01", "2099-12-31", "9999-12-31",
]
SPIKE_ROUND = [1, 9, 99, 999, 9999, 99999]
REFUTERS = 20  # rows drawn to refute keys, times the root of all rows
REFUTING = 100  # pairs of rows a combination is refuted by, from which others may be

# Name parts that announce a share, a count or a rate.
SHARE_WORDS = ("share", "pct", "percent", "prop", "frac", "rate_of")
RATE_AFFIXES = ("_rate", "rate_", "_per", "per_")


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_nested(f.dataType)]


def _rows(df: DataFrame, *structs: Column) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def _named(**cols) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in cols.items()])


# ---- keys ---------------------------------------------------------------------------------------

def shape_and_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, columns, distinct and surplus rows on the key; an absent key column is a failure."""
    absent = [k for k in keys if k not in df.columns]
    if absent:
        near = [c for c in df.columns if c.lower() in {a.lower() for a in absent}]
        row = [("missing_key_columns", float(len(absent)), "fail",
                ", ".join(absent) + (f"; did you mean {', '.join(near)}" if near else ""))]
        return df.sparkSession.createDataFrame(row, "metric string, value double, status string, note string")
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup"))
    return _rows(g, *[_named(metric=m, value=v.cast("double"), status=s, note="") for m, v, s in [
        ("rows", F.col("rows"), F.lit("info")), ("columns", F.lit(len(df.columns)), F.lit("info")),
        ("distinct_keys", F.col("distinct"), F.lit("info")),
        ("duplicate_rows", F.col("dup"), F.when(F.col("dup") > 0, "fail").otherwise("pass"))]])


def _is_unique(df: DataFrame, cols: Sequence[str]) -> bool:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _differing(rows: DataFrame, combos: Sequence[Sequence[str]], columns: Sequence[str]) -> set[int]:
    """Columns, as bits, in which two of `rows` differ that are alike under a combination: true of some such pairs, nearly equal ones first."""
    def row(j: int, c: Sequence[str]) -> Column:
        parts = [e for x in c for e in (F.col(x), F.col(x).isNull())]  # hashes skip nulls
        return _named(j=j, x=F.xxhash64(*parts), y=F.hash(*parts))

    alike = rows.select(F.struct(*columns).alias("r"), F.inline(F.array(*[row(j, c) for j, c in enumerate(combos)]))).groupBy("j", "x", "y")
    two = alike.agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("n")).where("n > 1")
    seen = two.select("j", F.array(*[~F.col("a")[x].eqNullSafe(F.col("b")[x]) for x in columns]).alias("d")).distinct()
    near = Window.partitionBy("j").orderBy(F.size(F.filter("d", lambda x: x)))
    few = seen.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= REFUTING).select("d").distinct()
    return {sum(1 << k for k, x in enumerate(r["d"]) if x) for r in few.collect()}


def _repeated(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows of some values that `cols` have more than once."""
    keys = df.groupBy(*cols).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.struct(*cols).alias("_k")).limit(REFUTING)
    return df.join(F.broadcast(keys), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("_k")[c]) for c in cols]), "left_semi")


def _hitting(differ: list[int], m: int, size: int, first: int = 0, taken: int = 0) -> Iterator[tuple[int, ...]]:
    """Combinations of `size` of `m` columns, in order, with a column of every mask in `differ`, which may grow meanwhile."""
    missed = [d for d in differ if not d & taken]
    if not size:
        if not missed:
            yield ()
        return
    last = reduce(lambda x, y: x & y, missed, -1) if size == 1 else -1
    for k in range(first, m - size + 1):
        if any(not d >> k for d in missed):
            return
        if last >> k & 1:
            for rest in _hitting(differ, m, size - 1, k + 1, taken | 1 << k):
                yield k, *rest


def find_minimal_key(df: DataFrame, batch: int = 8) -> DataFrame:
    """Smallest column set that identifies rows: `(size, columns)`; empty when all columns together do not. Single columns are all listed.

    Two rows refute every combination of columns in which they do not differ, so only
    combinations with a column of each difference seen so far are tried, columns with
    many values first: `batch` at a time on drawn rows, `REFUTERS` times the root of all,
    which hold some pairs for any combination that is alike in a tenth of the rows, and
    what those leave exactly on every row.
    """
    cand = scalar_columns(df)
    sketch = lambda c: F.approx_count_distinct(c, 0.02)
    # nulls are one more value; the null flag adds it
    st = df.agg(F.count("*").alias("_n"), *[
        (sketch(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cand]).first()
    n = st["_n"]
    schema = "size int, columns string"
    spark = df.sparkSession
    one = [c for c in cand if n and st[c] <= 1]  # or a few that the sketch does not tell apart
    vary = df.agg(*[(~F.min(c).eqNullSafe(F.max(c))).alias(c) for c in one]).first() if one else {}
    cand = sorted([c for c in cand if n and (c not in one or vary[c])], key=lambda c: -st[c])
    if not cand:
        return spark.createDataFrame([], schema)
    drawn = cut(df.select(*cand).sample(min(1.0, REFUTERS / n ** 0.5), 0))
    differ: list[int] = []

    def learn(masks: set[int]) -> None:
        found = {*differ, *masks}
        differ[:] = [d for d in sorted(found, key=int.bit_count) if not any(e & d == e for e in found if e != d)]

    for size in range(1, len(cand) + 1):
        combos, keys = _hitting(differ, len(cand), size), []
        while part := list(islice(combos, batch)):
            learn(_differing(drawn, [[cand[k] for k in c] for c in part], cand))
            for ks in part:
                if not all(any(d >> k & 1 for k in ks) for d in differ):
                    continue
                c = [cand[k] for k in ks]
                if not _is_unique(df, c):
                    learn(_differing(_repeated(df.select(*cand), c), [c], cand))
                elif size > 1:
                    return spark.createDataFrame([(size, " + ".join(c))], schema)
                else:
                    keys += c
            if 0 in differ:  # two rows are alike in everything
                return spark.createDataFrame([], schema)
        if keys:
            return spark.createDataFrame([(1, c) for c in sorted(keys)], schema)
    return spark.createDataFrame([], schema)


# ---- missingness ----------------------------------------------------------------------------------

def missingness(df: DataFrame) -> DataFrame:
    """Missing count and share per column."""
    cols = df.columns
    a = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _rows(a, *[_named(column=c, n_missing=F.col(c), share=F.try_divide(c, "_n")) for c in cols])


def _by_level(df: DataFrame, groups: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Means of `stats` per level of each group, long: `(group, level, n, column, value)`; null levels dropped."""
    parts = []
    for g in groups:
        a = df.where(F.col(g).isNotNull()).groupBy(F.col(g).cast("string").alias("level")).agg(
            F.count("*").alias("n"), *[F.avg(e).alias(c) for c, e in stats.items() if c != g])
        parts.append(a.select(F.lit(g).alias("group"), "level", "n", F.inline(F.array(*[
            _named(column=c, value=F.col(c)) for c in stats if c != g]))))
    return reduce(DataFrame.unionByName, parts)


def _with_spread(levels: DataFrame, threshold: float, max_levels: int | None, rate: str) -> DataFrame:
    """Levels of the columns whose rate spreads by more than `threshold` over all levels; `max_levels` only trims the listing."""
    sp = levels.groupBy("group", "column").agg((F.max("value") - F.min("value")).alias("spread"))
    levels = levels.join(sp, ["group", "column"])
    if max_levels:
        w = Window.partitionBy("group", "column").orderBy("level")
        levels = levels.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_levels).drop("_r")
    return (levels.where(F.col("spread") > threshold)
            .select("group", "column", "level", "n", F.col("value").alias(rate), "spread"))


def differential_missingness(df: DataFrame, groups: Sequence[str], threshold: float = 0.02,
                             max_levels: int | None = None) -> DataFrame:
    """Missing rate by level for columns whose rate differs across levels by more than `threshold`."""
    stats = {c: F.col(c).isNull().cast("double") for c in df.columns}
    return _with_spread(_by_level(df, [g for g in groups if g in df.columns], stats), threshold, max_levels,
                        "missing_rate")


def fill_by_period(df: DataFrame, column: str, group: str, period: Column) -> DataFrame:
    """Fill rate by group and period, with the change from the previous period."""
    g = df.where(F.col(group).isNotNull()).groupBy(group, period.alias("period")).agg(
        F.count("*").alias("n"), F.avg(F.col(column).isNotNull().cast("double")).alias("fill"))
    w = Window.partitionBy(group).orderBy("period")
    return g.withColumn("change", F.col("fill") - F.lag("fill").over(w))


def zeros_vs_missing(df: DataFrame) -> DataFrame:
    """Zero and missing counts of numeric columns that have either."""
    cols = numeric_columns(df)
    a = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) == 0).alias(f"z_{c}") for c in cols],
               *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in cols])
    return _rows(a, *[_named(column=c, zeros=F.col(f"z_{c}"), zero_share=F.try_divide(f"z_{c}", "_n"),
                             missing=F.col(f"m_{c}"), missing_share=F.try_divide(f"m_{c}", "_n"))
                      for c in cols]).where("zeros + missing > 0")


# ---- types and ranges -------------------------------------------------------------------------------

def type_traps(df: DataFrame) -> DataFrame:
    """String columns that only hold boolean spellings."""
    cols = string_columns(df)
    a = df.agg(*[F.every(F.col(c).isin("True", "False", "0", "1")).alias(c) for c in cols])
    return _rows(a, *[_named(column=c, boolean_as_text=F.coalesce(F.col(c), F.lit(False))) for c in cols])


def _has_word(name: str, words: Sequence[str], loose: bool) -> bool:
    low = name.lower()
    if loose:
        return any(w in low for w in words)
    parts = f"_{low}_"
    return any(f"_{w.strip('_')}_" in parts for w in words)


def range_violations(df: DataFrame, loose_names: bool = False) -> DataFrame:
    """Share-named columns outside [0, 1] and count-named columns below 0."""
    checks = []
    for c in numeric_columns(df):
        if _has_word(c, SHARE_WORDS, loose_names):
            checks.append((c, "share"))
        low = c.lower()
        if ("count" in low or "n_" in low or low.startswith("num")) if loose_names else (
                low.startswith(("n_", "num")) or _has_word(c, ("count",), False)):
            checks.append((c, "count"))
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "column string, rule string, min double, max double, below long, above long, status string")
    cols = sorted({c for c, _ in checks})
    a = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max))],
               *[F.count_if(F.col(c) < 0).alias(f"u_{c}") for c in cols],
               *[F.count_if(F.col(c) > 1 + 1e-7).alias(f"o_{c}") for c in cols])
    out = []
    for c, rule in checks:
        over = F.col(f"o_{c}") if rule == "share" else F.lit(0).cast("long")
        out.append(_named(column=c, rule=rule, min=F.col(f"lo_{c}"), max=F.col(f"hi_{c}"), below=F.col(f"u_{c}"),
                          above=over, status=F.when(F.col(f"lo_{c}").isNull(), "abstain").when(
                              F.col(f"u_{c}") + over > 0, "fail").otherwise("pass")))
    return _rows(a, *out)


def distribution_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Median, max, bias-corrected skew and the share held by the top hundredth of values.

    The top share needs no sort: values above the threshold are summed and ties
    at the threshold are counted in.
    """
    cols = list(cols or numeric_columns(df))
    top = lambda n: max(1, n // 100)
    q = order_statistics(df, cols, [0.5, 0.99], want=lambda n: [0.5 * (n - 1), n - top(n)])
    med, thr = {}, {}
    for r in q.collect():  # two rows per column
        (med if r["p"] == 0.5 else thr)[r["column"]] = r["value"]
    v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    above = {c: v[c] > F.lit(thr.get(c)) for c in cols}
    a = df.agg(*[x.alias(f"{n}_{c}") for c in cols for n, x in (
        ("n", F.count(v[c])), ("d", F.approx_count_distinct(v[c])), ("min", F.min(v[c])), ("max", F.max(v[c])), ("sum", F.sum(v[c])),
        ("g", F.skewness(v[c])), ("s", F.sum(F.when(above[c], v[c]))), ("c", F.count_if(above[c])))])
    d = _rows(a, *[_named(column=c, median=F.lit(med.get(c)).cast("double"), _thr=F.lit(thr.get(c)).cast("double"),
                          **{k: F.col(f"{x}_{c}") for k, x in (("n", "n"), ("_d", "d"), ("_min", "min"), ("max", "max"), ("_sum", "sum"),
                                                              ("_g1", "g"), ("_s", "s"), ("_c", "c"))}) for c in cols])
    n = F.col("n").cast("double")
    n_top = F.greatest(F.lit(1), F.floor(F.col("n") / 100)).cast("long")
    mass = F.coalesce("_s", F.lit(0.0)) + (n_top - F.col("_c")) * F.col("_thr")
    nonneg = F.col("_min") >= 0
    return (d.where("n >= 10 and _d >= 3").select(
        "column", "n", "median", "max",
        F.when(nonneg & (F.col("median") > 0), F.col("max") / F.col("median")).alias("max_over_median"),
        (F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), n_top.alias("n_top"),
        F.when(nonneg & (F.col("_sum") > 0), mass / F.col("_sum")).alias("top_mass"))
        .withColumn("heavy", (F.abs("skew") > 2) | F.coalesce(F.col("max_over_median") > 20, F.lit(False))))


def denominators(df: DataFrame, tol: float = 1e-9, min_rows: int = 10, min_distinct: int = 10,
                 loose_names: bool = False) -> DataFrame:
    """For each rate column, the first column that reproduces it as numerator / column."""
    num = numeric_columns(df)

    def is_rate(c):
        low = c.lower()
        return any(a in low for a in RATE_AFFIXES) if loose_names else (
            low.endswith(("_rate", "_per")) or low.startswith(("rate_", "per_")))

    rates = [c for c in num if is_rate(c)]
    schema = "rate string, numerator string, denominator string, n_denominators int"
    if not rates:
        return df.sparkSession.createDataFrame([], schema)
    others = [c for c in num if c not in rates]
    st = df.agg(*[F.min(c).alias(f"m_{c}") for c in others],
                *[F.approx_count_distinct(c).alias(f"d_{c}") for c in others]).first()
    cands = [c for c in others if st[f"m_{c}"] is not None and st[f"m_{c}"] >= 0 and st[f"d_{c}"] > min_distinct]

    def stem(c):
        for a in RATE_AFFIXES:
            c = c.replace(a, "")
        return c

    pairs = [(r, d) for r in rates if stem(r) in num for d in cands]
    aggs = []
    for i, (r, d) in enumerate(pairs):
        ok = F.col(d) > 0
        aggs += [F.count_if(ok).alias(f"n{i}"),
                 F.max(F.when(ok, F.abs(F.try_divide(F.col(stem(r)).cast("double"), F.col(d)) - F.col(r)))).alias(f"x{i}")]
    got = df.agg(*aggs).first() if aggs else None
    found = {}
    for i, (r, d) in enumerate(pairs):
        x = got[f"x{i}"]
        if r not in found and got[f"n{i}"] >= min_rows and x is not None and x < tol:
            found[r] = d
    used = len(set(found.values()))
    return df.sparkSession.createDataFrame(
        [(r, stem(r) if stem(r) in num else None, found.get(r), used) for r in rates], schema)


# ---- sentinels ----------------------------------------------------------------------------------------

def numeric_sentinels(df: DataFrame, cols: Sequence[str] | None = None, extra: Sequence[float] = ()) -> DataFrame:
    """Catalogue codes found in numeric columns, with their share of all rows."""
    cols = list(cols or numeric_columns(df))
    codes = [float(x) for x in (*SENTINEL_NUMBERS, *extra)]
    hits = melt(df, [], cols).where(F.col("value").isin(codes)).groupBy("column", "value").agg(F.count("*").alias("n"))
    return _share_of_rows(df, hits)


def _share_of_rows(df: DataFrame, hits: DataFrame) -> DataFrame:
    total = df.count()
    return hits.withColumn("share", F.col("n") / F.lit(total))


def string_sentinels(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Catalogue spellings of "missing" in string columns; case-sensitive and untrimmed."""
    cols = list(cols or string_columns(df))
    hits = melt(df, [], cols, "string").where(F.col("value").isin(SENTINEL_STRINGS)).groupBy("column", "value").agg(
        F.count("*").alias("n"))
    return _share_of_rows(df, hits)


def date_sentinels(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Catalogue dates with their counts."""
    cols = list(cols or [f.name for f in df.schema if isinstance(f.dataType, T.DateType)])
    dates = [F.to_date(F.lit(d)) for d in SENTINEL_DATES]
    return melt(df, [], cols, "date").where(F.col("value").isin(dates)).groupBy("column", "value").agg(
        F.count("*").alias("n"))


def value_spikes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Suspicious modes outside the catalogue: heavy, far above the median value's share, round or extreme.

    The median of the value counts has at most sqrt(2N) distinct inputs, so the
    exact `percentile` buffer stays small.
    """
    cols = list(cols or numeric_columns(df))
    vc = melt(df, [], cols).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column", "value").agg(
        F.count("*").alias("c"))
    s = vc.groupBy("column").agg(
        F.sum("c").alias("n"), F.count("*").alias("d"), F.max(F.struct("c", -F.col("value"))).alias("t"),
        F.percentile("c", 0.5).alias("med"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    v, c = -F.col("t.col2"), F.col("t.c")
    s = s.select("column", v.alias("value"), c.alias("n"), (c / F.col("n")).alias("share"),
                 (F.col("med") / F.col("n")).alias("median_share"), "d", "lo", "hi")
    a = F.abs("value")
    rnd = a.isin(SPIKE_ROUND) | ((a >= 100) & (a % 100 == 99))
    return s.where((F.col("d") > 3) & (F.col("share") > 0.01) & (F.col("share") > 25 * F.col("median_share"))
                   & (rnd | (F.col("value") == F.col("lo")) | (F.col("value") == F.col("hi")))
                   & ~F.col("value").isin([float(x) for x in SENTINEL_NUMBERS])
                   ).select("column", "value", "n", "share", "median_share")


def header_leaks(df: DataFrame) -> DataFrame:
    """String columns holding their own name as a value."""
    cols = string_columns(df)
    a = df.agg(*[F.count_if(F.lower(c) == c.lower()).alias(c) for c in cols])
    return _rows(a, *[_named(column=c, n=F.col(c)) for c in cols]).where("n > 0")


def sentinel_share_by_group(df: DataFrame, groups: Sequence[str], threshold: float = 0.02,
                            max_levels: int | None = None) -> DataFrame:
    """Share of catalogue codes by level, for columns where it differs across levels."""
    codes = [float(x) for x in SENTINEL_NUMBERS]
    stats = {c: F.coalesce(F.col(c).cast("double").isin(codes), F.lit(False)).cast("double")
             for c in numeric_columns(df)}
    return _with_spread(_by_level(df, groups, stats), threshold, max_levels, "sentinel_share")


# ---- values, digits, strings -----------------------------------------------------------------------------

def value_counts(df: DataFrame, top: int = 12, cols: Sequence[str] | None = None) -> DataFrame:
    """Commonest values per column with null as a category; constants and identifiers are labelled.

    Columns a sketch already shows to be near-unique are not shuffled at all.
    """
    cols = list(cols or scalar_columns(df))
    st = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    n = st["_n"]
    unique = [c for c in cols if st[c] > 0.97 * n and n > 100]
    rest = [c for c in cols if c not in unique]
    spark = df.sparkSession
    schema = "column string, value string, n long, share double, kind string"
    out = spark.createDataFrame([(c, None, n, 1.0, "near_unique") for c in unique], schema)
    if not rest:
        return out
    vc = melt(df, [], rest, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    d = vc.groupBy("column").agg(F.count("value").alias("_d"))
    near = (F.col("_d") > 0.9 * n) & (F.col("_d") > 50)
    # a pure rank limit, so each task keeps its own top rows before the shuffle
    ranked = vc.where("value is not null").withColumn("_r", F.row_number().over(
        Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= top)
    ranked = ranked.unionByName(vc.where("value is null").withColumn("_r", F.lit(0))).join(F.broadcast(d), "column")
    kind = (F.when(F.col("_d") == 0, "all_missing").when(near, "near_unique").when(F.col("value").isNull(), "null")
            .when(F.col("_d") == 1, "constant").otherwise("value"))
    listed = ranked.withColumn("kind", kind).where(~((F.col("kind") == "near_unique") & (F.col("_r") > 1)))
    listed = listed.select("column", F.when(F.col("kind") != "near_unique", F.col("value")).alias("value"),
                           F.when(F.col("kind") == "near_unique", F.lit(n)).otherwise(F.col("n")).alias("n"), "kind")
    return out.unionByName(listed.withColumn("share", F.col("n") / F.lit(n)).select("column", "value", "n", "share", "kind"))


RANGE_PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def numeric_range(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles of each numeric column with at least five values."""
    return quantiles(df, list(cols or numeric_columns(df)), RANGE_PROBS).where("n >= 5").select("column", "p", "value")


def extreme_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The `k` lowest and highest distinct values per column."""
    cols = list(cols or numeric_columns(df))
    d = melt(df, [], cols).where(F.col("value").isNotNull()).distinct()
    parts = []
    for side, order in (("low", F.col("value").asc()), ("high", F.col("value").desc())):
        w = Window.partitionBy("column").orderBy(order)
        parts.append(d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                     .select("column", F.lit(side).alias("side"), "rank", "value"))
    return parts[0].unionByName(parts[1])


def last_digits(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Last-digit shares over whole-number rows, flagged when one digit dominates."""
    cols = list(cols or numeric_columns(df))
    long = melt(df, [], cols).where(F.col("value").isNotNull())
    whole = (F.col("value") == F.floor("value")) & (F.abs("value") < 1e15)
    per = long.groupBy("column").agg(F.count("*").alias("_n"), F.count_if(whole).alias("n_int"),
                                     F.approx_count_distinct(F.when(whole, F.col("value"))).alias("_d"))
    dig = long.where(whole).groupBy("column", (F.abs("value") % 10).cast("int").alias("digit")).agg(
        F.count("*").alias("n"))
    out = dig.join(F.broadcast(per), "column").where("n_int > 100 and _d >= 10")
    share = F.col("n") / F.col("n_int")
    return out.select("column", "digit", "n", share.alias("share"), (F.col("n_int") / F.col("_n")).alias("int_share"),
                      ((share > 0.25) & (F.col("n_int") / F.col("_n") > 0.5)).alias("flag"))


def string_hygiene(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values before and after normalising, second-commonest length, leading zeros.

    Values are reduced to 128-bit digests before the shuffle, so long text moves
    as 16 bytes.
    """
    cols = list(cols or string_columns(df))
    long = melt(df, [], cols, "string").where(F.col("value").isNotNull())
    norm = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    v = (long.groupBy("column", F.unhex(F.md5("value")).alias("h"), F.unhex(F.md5(norm)).alias("m"),
                      F.length("value").alias("len"), F.col("value").startswith("0").alias("z"),
                      F.col("value").rlike("^[0-9]+$").alias("dig")).agg(F.count("*").alias("c")))
    raw = v.groupBy("column").agg(F.count("*").alias("n_raw"), F.sum("c").alias("_n"),
                                  F.bool_or("z").alias("_z"), F.every("dig").alias("_dig"))
    nrm = v.groupBy("column", "m").agg(F.lit(1).alias("o")).groupBy("column").agg(F.count("*").alias("n_normal"))
    lens = v.groupBy("column", "len").agg(F.sum("c").alias("c"))
    lw = Window.partitionBy("column").orderBy(F.desc("c"), "len")
    second = lens.withColumn("_r", F.row_number().over(lw)).where("_r <= 2").groupBy("column").agg(
        F.max(F.when(F.col("_r") == 2, F.col("c"))).alias("_c2"))
    return (raw.join(nrm, "column").join(second, "column").select(
        "column", "n_raw", "n_normal", (F.col("n_raw") - F.col("n_normal")).alias("n_spurious"),
        F.coalesce(F.col("_c2") / F.col("_n") > 0.15, F.lit(False)).alias("two_lengths"),
        (F.col("_z") & F.col("_dig")).alias("keep_as_text")))


# ---- coverage and panels ------------------------------------------------------------------------------------

def coverage(df: DataFrame, period: Column, cols: Sequence[str] | None = None) -> DataFrame:
    """First and last period each column has values in, and how many periods it covers."""
    cols = [c for c in (cols or scalar_columns(df))]
    per = df.groupBy(period.alias("_t")).agg(*[F.count(c).alias(c) for c in cols]).where("_t is not null")
    a = per.agg(F.count("*").alias("_p"), *[x for c in cols for x in (
        F.min(F.when(F.col(c) > 0, F.col("_t"))).alias(f"a_{c}"), F.max(F.when(F.col(c) > 0, F.col("_t"))).alias(f"b_{c}"),
        F.count_if(F.col(c) > 0).alias(f"k_{c}"))])
    return _rows(a, *[_named(column=c, first=F.col(f"a_{c}"), last=F.col(f"b_{c}"), periods=F.col(f"k_{c}"),
                             of=F.col("_p"), partial=F.col(f"k_{c}") < F.col("_p")) for c in cols])


def panel_structure(df: DataFrame, unit: str, treat: str) -> DataFrame:
    """Units whose treatment changes over time, and what that means for the design.

    Reduced to distinct (unit, value) first, so a unit holding many rows costs no more than its values.
    """
    u = df.where(F.col(unit).isNotNull()).groupBy(unit, treat).agg(F.lit(1).alias("o")).groupBy(unit).agg(
        F.count(treat).alias("v"))
    a = u.agg(F.count("*").alias("n_units"), F.count_if(F.col("v") > 1).alias("n_switchers"))
    return a.withColumn("verdict", F.when(F.col("n_units") == 0, "abstain").when(F.col("n_switchers") == 0, "none")
                        .when(F.col("n_switchers") < 0.05 * F.col("n_units"), "few").otherwise("switchers"))


def assignment_levels(df: DataFrame, treat: str, skip: Sequence[str] = (), max_levels: int = 200) -> DataFrame:
    """Columns with 2 to `max_levels` levels within which the treatment never varies."""
    cols = [c for c in scalar_columns(df) if c not in (treat, *skip)]
    st = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    cols = [c for c in cols if 2 <= st[c] <= max_levels * 1.1]
    long = melt(df, [treat], cols, "string")
    lv = long.groupBy("column", "value").agg(F.min(treat).alias("a"), F.max(treat).alias("b"),
                                             F.bool_or(F.col(treat) != 0).alias("t"))
    return (lv.where("value is not null").groupBy("column").agg(
        F.count("*").alias("n_groups"), F.count_if("t").alias("n_treated"),
        F.every(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("constant"))
        .where((F.col("n_groups") >= 2) & (F.col("n_groups") <= max_levels) & F.col("constant")).drop("constant"))


def adoption_cohorts(df: DataFrame, unit: str, time: str, treat: str) -> DataFrame:
    """Units by first treated period, with a flag for staggered adoption."""
    first = df.groupBy(unit).agg(F.min(F.when(F.col(treat) != 0, F.col(time))).alias("first")).where("first is not null")
    c = first.groupBy("first").agg(F.count("*").alias("n_units"))
    return c.join(F.broadcast(c.agg((F.count("*") > 1).alias("staggered"))))


def dictionary(df: DataFrame, max_values: int = 8) -> DataFrame:
    """Draft data dictionary: type, values or range, missing codes and counts per column."""
    cols = scalar_columns(df)
    st = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in cols],
                *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in cols],
                *[F.min(c).cast("string").alias(f"a_{c}") for c in cols],
                *[F.max(c).cast("string").alias(f"b_{c}") for c in cols]).first()
    few = [c for c in cols if st[f"d_{c}"] <= max_values]
    listed = {}
    if few:
        for r in melt(df, [], few, "string").where("value is not null").distinct().groupBy("column").agg(
                F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("v")).collect():
            listed[r["column"]] = r["v"]
    codes = {}
    num, txt = numeric_columns(df), string_columns(df)
    found = []
    if num:
        found.append(numeric_sentinels(df, num).select("column", F.format_string("%.0f", "value").alias("v")))
    if txt:
        found.append(string_sentinels(df, txt).select("column", F.concat(F.lit('"'), "value", F.lit('"')).alias("v")))
    for part in found:  # at most columns x catalogue rows
        for r in part.collect():
            codes.setdefault(r["column"], []).append(r["v"])
    rows = []
    for c in cols:
        kind = df.schema[c].dataType.simpleString()
        if c in listed:
            values = listed[c]
        elif c in txt:
            values = "many values"
        else:
            values = f"{st[f'a_{c}']} to {st[f'b_{c}']}"
        rows.append((c, kind, "TODO", "TODO", values, ", ".join(sorted(codes.get(c, []))), st[f"m_{c}"],
                     "TODO" if st[f"m_{c}"] else "none", "none recorded", "TODO"))
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, unit string, universe string, `values` string, missing_codes string, "
              "n_missing long, miss_kind string, transformations string, provenance string")
