"""Order-dependent results (quantiles, running totals, look-back) without one-task groups.

A plain window sends a whole group to one task. Here every group above `HEAVY`
rows is cut along its order into cells of about that size; lighter groups
stay whole. The cut points come from a sketch of one column or a sample of all order
columns, work inside a cell is an ordinary window, and the cells of a heavy group are
stitched with a table of at most `2 x rows / HEAVY` rows. Results are exact: sketch
and sample only decide where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil, floor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, cut, fetch_small

MAX_GROUPS = 2_000
HEAVY = 2_000_000  # rows one window task may hold
GRID = 512  # cut points a sketch is asked for at least


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `keys` treating null as equal to null; right key columns are dropped."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _search(col: Column, bounds: Sequence, lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col <= F.lit(bounds[mid]), _search(col, bounds, lo, mid)).otherwise(
        _search(col, bounds, mid + 1, hi))


def _bounds_below(bounds: Column, value: Column, step: int = 64) -> Column:
    """How many of the sorted bounds are below the value: whole steps first, then inside one step."""
    whole = F.size(F.filter(F.sequence(F.lit(step), F.size(bounds) + step, F.lit(step)), lambda i: F.try_element_at(bounds, i) < value)) * step
    return whole + F.size(F.filter(F.slice(bounds, whole + 1, F.lit(step)), lambda b: b < value))


def with_cell(df: DataFrame, by: Sequence[str], col: str, cells: int | None = None) -> DataFrame:
    """Add `_cell`, increasing in `col` inside each group of `by`, and `_split`: the group has several cells.

    `col` must be numeric; nulls go to the first cell, where Spark sorts them. `cells`
    cuts every group into that many cells instead of only heavy ones. A group has as many
    cells as its rows need, without an upper bound.
    """
    whole = {"_cell": F.lit(0), "_split": F.lit(False)}
    if not by:
        k = cells or -(-df.count() // HEAVY)
        if k <= 1:
            return df.withColumns(whole)
        cuts = df.agg(F.percentile_approx(col, [i / k for i in range(1, k)], max(10_000, 10 * k)).alias("b")).first()["b"]
        bounds = sorted(set(cuts or []))
        if len(bounds) <= GRID:
            cell = F.when(F.col(col).isNull(), 0).otherwise(_search(F.col(col), bounds, 0, len(bounds)))
        else:  # too many for one expression: the bounds travel as a value
            cell = _bounds_below(F.lit(bounds), F.col(col))
        return df.withColumns({"_cell": cell, "_split": F.lit(True)})
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    want = F.lit(cells) if cells else F.ceil(F.col("_n") / HEAVY)
    heavy = cut(sizes.select(*by, want.cast("int").alias("__cells")).where("__cells > 1"))
    if heavy.isEmpty():
        return df.withColumns(whole)
    # few: a heavy group holds more than HEAVY rows
    heavy = broadcast_if_small(heavy)
    fine = max(GRID, heavy.agg(F.max("__cells")).first()[0])
    grid = [i / fine for i in range(1, fine)]
    q = join_null_safe(df, heavy, by).groupBy(*by, "__cells").agg(F.percentile_approx(col, grid, max(10_000, 10 * fine)).alias("_q"))
    step = F.transform(F.sequence(F.lit(1), F.col("__cells") - 1), lambda i: F.element_at("_q", (i * fine / F.col("__cells")).cast("int")))
    cuts = broadcast_if_small(cut(q.select(*by, F.array_distinct(step).alias("_bounds"))))
    d = join_null_safe(df, cuts, by, "left")
    return d.withColumns({"_cell": F.when(F.col("_bounds").isNull(), 0).otherwise(_bounds_below(F.col("_bounds"), F.col(col))),
                          "_split": F.col("_bounds").isNotNull()}).drop("_bounds")


def cell_offsets(d: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Aggregates of a heavy group's earlier cells, one row per cell: `(by..., _cell, <names>)`."""
    keys = [*by, "_cell"]
    per = d.where("_split").groupBy(*keys).agg(*[c.alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, *[F.sum(f"_t_{o}").over(before).alias(o) for o in sums])


def add_offsets(d: DataFrame, by: Sequence[str], offsets: DataFrame) -> DataFrame:
    """Join per-cell offsets, null for groups in one cell. Spark may broadcast them; else rows meet by cell, as the windows need them."""
    return join_null_safe(d, offsets, [*by, "_cell"], "left")


class Key(NamedTuple):
    """A column to order by. Nulls come first in ascending and last in descending order unless `nulls_first` says."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    def column(self) -> Column:
        c, first = F.col(self.name), self.leads_with_nulls()
        if self.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    def leads_with_nulls(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def reversed(self) -> Key:
        return Key(self.name, not self.descending, not self.leads_with_nulls())


def sort_keys(order: str | Key | Sequence[str | Key]) -> list[Key]:
    """Order columns as `Key`s; a plain name is ascending."""
    many = [order] if isinstance(order, (str, Key)) else order
    return [k if isinstance(k, Key) else Key(k) for k in many]


TIE = Key("_tie")
PROBES = 16  # sampled rows per wanted cell


def _precedes(keys: Sequence[Key], a: Column, b: Column) -> Column:
    """Whether struct `a` comes strictly before `b`; both hold the keys' values as fields k0, k1, ..."""
    out = F.lit(False)
    for i, k in reversed(list(enumerate(keys))):
        x, y = a[f"k{i}"], b[f"k{i}"]
        less = F.when(x.isNull(), F.lit(k.leads_with_nulls())).when(y.isNull(), F.lit(not k.leads_with_nulls())).otherwise(
            x > y if k.descending else x < y)
        out = F.when(x.eqNullSafe(y), out).otherwise(less)
    return out


def _bounds_before(bounds: Column, row: Column, keys: Sequence[Key]) -> Column:
    """How many of the sorted bounds precede the row, by halving."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        unsure = s["lo"] < s["hi"]
        below = _precedes(keys, F.get(bounds, mid), row)
        return F.struct(F.when(unsure & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(unsure & ~below, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), halve, lambda s: s["lo"])


def _heavy_groups(df: DataFrame, by: Sequence[str], cells: int | None) -> DataFrame | None:
    """`(by..., _n, __cells)` of the groups that need several cells, None when there are none. Few: each holds more than HEAVY rows."""
    want = F.lit(cells) if cells else F.ceil(F.col("_n") / HEAVY)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("__cells", want.cast("int")).where("__cells > 1")
    heavy = cut(sizes)
    return None if heavy.isEmpty() else broadcast_if_small(heavy)


def with_order_cells(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], cells: int | None = None) -> DataFrame:
    """Add `_cell`, increasing along all of `order` inside each group of `by`, `_split` (the group has several cells) and `_tie`.

    Order columns may have any sortable type. Rows that tie on all of them are told apart
    by `_tie`, a hash of all columns, so a group of one single order value is cut as well;
    only rows equal in every column stay together. Sort by `order` and then `_tie`.
    """
    whole = {"_cell": F.lit(0), "_split": F.lit(False), "_tie": F.lit(0).cast("long")}
    heavy = _heavy_groups(df, by, cells)
    if heavy is None:
        return df.withColumns(whole)
    keys = [*sort_keys(order), TIE]
    d = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]))
    row = F.struct(*[F.col(k.name).alias(f"k{i}") for i, k in enumerate(keys)])
    hot = join_null_safe(d, heavy, by) if by else d.withColumns({c: F.lit(v) for c, v in heavy.first().asDict().items()})
    seen = hot.where(F.rand(7) < PROBES * F.col("__cells") / F.col("_n")).groupBy(*by).agg(F.collect_list(row).alias("_s"), F.first("__cells").alias("_k"))
    seen = seen.withColumn("_s", F.array_sort("_s", lambda a, b: F.when(_precedes(keys, a, b), -1).when(_precedes(keys, b, a), 1).otherwise(0)))
    at = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_k")).cast("int")))
    cuts = cut(seen.where(F.size("_s") > 0).select(*by or [F.lit(0).cast("long").alias("_all")], F.array_distinct(at).alias("_bounds")))  # a sample is drawn once
    if not by:  # one row of bounds; joined, so that they are not copied into every expression that uses the cell
        d = d.withColumn("_all", F.pmod("_tie", F.lit(1)))
    d = join_null_safe(d, broadcast_if_small(cuts), by or ["_all"], "left")
    cell = F.when(F.col("_bounds").isNull(), 0).otherwise(_bounds_before(F.col("_bounds"), row, keys))
    return d.withColumns({"_cell": cell, "_split": F.col("_bounds").isNotNull()}).drop("_bounds", *([] if by else ["_all"]))


def running_total(df: DataFrame, by: Sequence[str], order: str | Key | Sequence[str | Key], sums: dict[str, str],
                  cells: int | None = None, peers: bool = True) -> DataFrame:
    """Inclusive running sums of `sums` (output name -> column) along `order`.

    With `peers`, rows that tie on `order` share the value, as in a RANGE frame. A heavy
    group is then summed to one row per order value first, so ties take no task of their own.
    """
    keys, by = sort_keys(order), list(by)
    if not peers:
        d = with_order_cells(df, by, keys, cells)
        d = add_offsets(d, by, cell_offsets(d, by, {f"_o_{o}": F.sum(c) for o, c in sums.items()}))
        inside = Window.partitionBy(*by, "_cell").orderBy(*[k.column() for k in keys], "_tie").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({o: F.coalesce(F.col(f"_o_{o}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
        return d.drop("_cell", "_split", "_tie", *[f"_o_{o}" for o in sums])
    along = Window.partitionBy(*by).orderBy(*[k.column() for k in keys]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    plain = lambda d: d.withColumns({o: F.coalesce(F.sum(c).over(along), F.lit(0)) for o, c in sums.items()})
    heavy = _heavy_groups(df, by, cells)
    if heavy is None:
        return plain(df)
    names = [k.name for k in keys if k.name not in by]
    hot = join_null_safe(df, heavy.select(*by), by, "left_semi") if by else df
    per = hot.groupBy(*by, *names).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_p_{o}") for o, c in sums.items()])
    per = running_total(per, by, keys, {f"_p_{o}": f"_p_{o}" for o in sums}, cells, peers=False)
    out = join_null_safe(hot, per, [*by, *names]).drop(*sums)
    light = plain(join_null_safe(df, heavy.select(*by), by, "left_anti")) if by else None
    kinds = plain(df).schema
    out = out.select(*[c for c in out.columns if not c.startswith("_p_")], *[F.col(f"_p_{o}").cast(kinds[o].dataType).alias(o) for o in sums])
    out = out.select(*kinds.names)
    return out if light is None else light.unionByName(out)


def with_lookback(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], rows: int,
                  cells: int | None = None) -> DataFrame:
    """Add `_cell`, `_tie` and, flagged `_ctx`, copies of the `rows` rows that precede each cell of a heavy group.

    Windows over `(by, _cell)` in `order`, `_tie` that look back at most `rows` rows then
    see what they would see in the whole group; drop `_ctx` rows afterwards. The last rows
    of all cells are numbered along the group, and a cell takes the `rows` numbers before its own.
    """
    by = list(by)
    d = with_order_cells(df, by, order, cells)
    at, last = [*by, "_cell"], [k.reversed().column() for k in [*sort_keys(order), TIE]]
    tails = d.where("_split").drop("_split").withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy(*last))).where(F.col("_n") <= rows)
    d = d.drop("_split")
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy("_cell"))
    counts = tails.groupBy(*at).agg(F.count("*").alias("_m")).withColumn("_upto", upto)  # one row per cell
    placed = join_null_safe(tails, counts, at).withColumn("_at", F.col("_upto") - F.col("_n") + 1).drop("_n", "_m", "_upto", "_cell")
    start = F.col("_upto") - F.col("_m")
    wanted = counts.where(start > 0).select(*at, F.explode(F.sequence(F.greatest(start - rows + 1, F.lit(1)), start)).alias("_at"))
    ctx = join_null_safe(wanted, placed, [*by, "_at"])
    return d.withColumn("_ctx", F.lit(False)).unionByName(ctx.select(*d.columns, F.lit(True).alias("_ctx")))


def melt(df: DataFrame, by: Sequence[str], cols: Sequence[str], kind: str = "double") -> DataFrame:
    """Long form `(by..., column, value)`; one narrow pass, no shuffle."""
    return df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in cols])))


SLACK = 0.004  # share of rows kept either side of a wanted rank; the sketch errs by about 0.001
SKETCH_K = 4096
WHOLE = 4_000  # groups up to this many values are kept whole
BRACKET = 2_000_000  # most values a cell may hold before it is cut again


def order_statistics(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                     want: Callable[[int], Sequence[float]] | None = None) -> DataFrame | None:
    """Exact values at chosen positions of each sorted group: `(by..., column, p, value, n)`.

    `want(n)` gives the positions for a group of `n` values, one per entry of
    `probs` (default `p * (n - 1)`); a fractional position interpolates linearly.
    A mergeable sketch cuts each column closely around the wanted ranks, values
    are counted per cell, and only the cells that hold a wanted rank are shuffled.
    A cell that is still large is cut again. None when there are more than
    `MAX_GROUPS` groups.
    """
    spark, by, probs = df.sparkSession, list(by), [float(p) for p in probs]
    want = want or (lambda n: [p * (n - 1) for p in probs])
    names = [f"_v{i}" for i in range(len(cols))]
    base = df.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(v) for c, v in zip(cols, names)])
    grid = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-SLACK, SLACK)} - {0.0, 1.0}) or [0.5]
    ranks = F.array(*[F.lit(g) for g in grid])
    sketches = base.groupBy(*by).agg(*[x for v in names for x in (F.count(v).alias(f"n{v}"), F.kll_sketch_agg_double(v, SKETCH_K).alias(f"k{v}"))])
    groups = fetch_small(sketches.select(*by, *[f"n{v}" for v in names], *[
        F.when(F.col(f"n{v}") > 0, F.kll_sketch_get_quantile_double(f"k{v}", ranks)).alias(f"q{v}") for v in names]), MAX_GROUPS)
    if groups is None:
        return None
    bounds = {(tuple(r[k] for k in by), i): sorted(set(r[f"q{v}"] or [])) if r[f"n{v}"] > WHOLE else []
              for r in groups for i, v in enumerate(names)}
    ddl = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)

    def cells(only: dict[int, set] | None = None) -> DataFrame:
        """Long form `(by..., c, cell, value)`, where `cell` counts the bounds below the value."""
        if by:
            tab: dict[tuple, list] = {}
            for (key, i), bs in bounds.items():
                tab.setdefault(key, [[]] * len(cols))[i] = bs
            tab_df = spark.createDataFrame([(*k, *v) for k, v in tab.items()], ddl + ", ".join(f"_b{i} array<double>" for i in range(len(cols))))
            d = join_null_safe(base, F.broadcast(tab_df), by)
            cell = [_bounds_below(F.col(f"_b{i}"), F.col(v)) for i, v in enumerate(names)]
        else:
            d = base
            cell = [_search(F.col(v), bounds.get(((), i), []), 0, len(bounds.get(((), i), []))) for i, v in enumerate(names)]
            if only is not None:
                d = d.where(reduce(lambda x, y: x | y, [F.col(names[i]).isNotNull() & cell[i].isin(sorted(cs)) for i, cs in only.items()]))
        return d.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("c"), cell[i].alias("cell"), F.col(v).alias("value"))
                                                for i, v in enumerate(names)]))).where("value is not null")

    stuck: set[tuple] = set()
    while True:
        count: dict[tuple, dict[int, int]] = {}
        for r in cells().groupBy(*by, "c", "cell").count().collect():  # groups x columns x cuts rows
            count.setdefault((tuple(r[k] for k in by), r["c"]), {})[r["cell"]] = r["count"]
        targets, wide = [], set()
        for (key, i), part in count.items():
            n = sum(part.values())
            for p, pos in zip(probs, want(n)):
                for side, rank in (("lo", floor(pos)), ("hi", ceil(pos))):
                    seen = 0
                    for cell in sorted(part):
                        if rank < seen + part[cell]:
                            break
                        seen += part[cell]
                    targets.append((*key, i, cell, p, side, float(pos - floor(pos)), rank - seen, n))
                    if part[cell] > BRACKET and (key, i, cell) not in stuck:
                        wide.add((key, i, cell))
        if not wide:
            break
        where = F.broadcast(spark.createDataFrame([(*k, i, c) for k, i, c in wide], ddl + "c int, cell int"))
        inner = join_null_safe(cells(), where, [*by, "c", "cell"], "left_semi").groupBy(*by, "c", "cell").agg(
            F.percentile_approx("value", [x / 64 for x in range(1, 64)], 10_000).alias("q"), F.max("value").alias("top")).collect()
        stuck = set()  # cell numbers change with the bounds
        moved = False
        for r in inner:
            at = (tuple(r[k] for k in by), r["c"])
            more = sorted(set(bounds[at]) | {x for x in r["q"] if x < r["top"]})
            moved |= more != bounds[at]
            bounds[at] = more
        if not moved:  # what is left are single repeated values, which are counted, not listed
            stuck = wide
    only: dict[int, set] = {}
    for t in targets:
        only.setdefault(t[len(by)], set()).add(t[len(by) + 1])
    keys = [*by, "c", "cell"]
    wanted = F.broadcast(spark.createDataFrame(targets, ddl + "c int, cell int, p double, side string, frac double, rank long, n long")) if targets else None
    if wanted is None:
        return spark.createDataFrame([], ddl + "column string, p double, value double, n long")
    hits = join_null_safe(cells(only), wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "value").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("value")
    hits = hits.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    j = join_null_safe(hits, wanted, keys).where((F.col("_lo") <= F.col("rank")) & (F.col("rank") < F.col("_hi")))
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    out = j.groupBy(*by, "c", "p", "n").agg(at("lo").alias("_a"), at("hi").alias("_b"), F.max("frac").alias("_f"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1)
    return out.select(*by, name.alias("column"), "p", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("value"), "n")


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles: `(by..., column, p, value, n)`.

    Beyond `MAX_GROUPS` groups the built-in exact `percentile` over per-value
    counts takes over, since then each group is a small share of the rows.
    """
    out = order_statistics(df, cols, probs, by)
    if out is not None:
        return out
    keys = [*by, "column"]
    counts = melt(df, by, cols).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys, "value").agg(
        F.count("*").alias("c"))
    return (counts.groupBy(*keys).agg(F.percentile("value", list(probs), F.col("c")).alias("q"), F.sum("c").alias("n"))
            .select(*keys, "n", F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"),
                                                      F.col("q").alias("value"))))
            .toDF(*keys, "n", "p", "value").select(*keys, "p", "value", "n"))


def quantiles_wide(df: DataFrame, col: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a column per named probability."""
    q = quantiles(df, [col], sorted(set(probs.values())), by)
    g = q.groupBy(*by) if by else q.groupBy()
    return g.agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(name)
                   for name, p in probs.items()])
