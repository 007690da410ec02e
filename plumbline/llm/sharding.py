"""Shards of near equal bytes by histogram sort: splitters are probed by exact counts, then rows move once.

Rows are ordered by a key of 60 bits: 40 from a hash of the text, so that equal texts lie
next to each other, and 20 from a hash of the id, so that a group of equal texts of any
size can be cut. Only key and size of each row take part in the probing.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import pack, q
from plumbline.session import broadcast_if_small, cut, release

TEXT_HEX, ID_HEX = 10, 5  # hex digits of the key from the text and from the id
KEY_BITS, ID_BITS = 4 * (TEXT_HEX + ID_HEX), 4 * ID_HEX
PROBE_BITS = 12  # each round cuts an open interval into 2**PROBE_BITS
TOLERANCE = 0.0001  # of a shard's bytes a splitter may be off
CELL_BYTES = 16 << 20  # bytes ordered in one task
OUT = ["size", "shard", "slot"]


def row_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, and one more for its end."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def sort_key(text: Column, id: Column, place: Column | None = None) -> Column:
    """The whole number rows are ordered by; with `place`, rows that repeat in text and id differ too."""
    ids = F.concat_ws("|", F.coalesce(id.cast("string"), F.lit("-")), *([] if place is None else [place.cast("string")]))
    hexes = F.concat(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, TEXT_HEX), F.substring(F.md5(ids), 1, ID_HEX))
    return F.conv(hexes, 16, 10).cast("long")


def _json(value, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), ddl)


def find_splitters(keys: DataFrame, n: int, tolerance: float = TOLERANCE, weight: str = "size", bits: int = KEY_BITS) -> tuple[list[int], bool]:
    """`n - 1` ascending keys that cut `keys` (key, weight) into parts of near equal weight, and whether one key is too heavy for that.

    A part holds the keys from its splitter up to, not including, the next. Each round
    counts, over all partitions at once, the exact weight in the cells of every interval
    that still holds a target; a splitter is settled by the cell boundary nearest to its
    target once that is within `tolerance` of a part's weight, or when its interval is
    down to one key. A round sends at most 2**PROBE_BITS sums per open interval to the
    driver, n - 1 intervals at most, and `bits / PROBE_BITS` rounds suffice.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    target = {i: total * i / n for i in range(1, n)}
    slack = tolerance * total / n
    found: dict[int, int] = {}
    heavy = False
    # intervals still open: first key -> (weight below it, targets inside)
    width = 1 << bits
    intervals: dict[int, tuple[float, list[int]]] = {0: (0, list(target))} if total else {}
    found |= dict.fromkeys([] if total else target, 0)
    while intervals:
        step = max(1, width >> PROBE_BITS)
        spots = _json({str(low // width): k for k, low in enumerate(sorted(intervals))}, "map<string,int>")
        d = keys if len(intervals) == 1 and width == 1 << bits else keys.withColumn("__at", F.element_at(spots, F.expr(f"key div {width}").cast("string"))).where("__at IS NOT NULL")
        cells = d.groupBy(F.expr(f"key div {step}").alias("cell")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("rows")).collect()
        inside: dict[int, list] = {low: [] for low in intervals}
        for r in sorted(cells):
            inside[r["cell"] * step // width * width].append(r)
        nxt: dict[int, tuple[float, list[int]]] = {}
        for low, (below, wanted) in intervals.items():
            rows = inside[low]
            ends = list(accumulate((r["w"] for r in rows), initial=below))
            for i in wanted:
                at = min(bisect_left(ends, target[i], 1), len(rows)) - 1
                cell = rows[at]["cell"]
                under, over = target[i] - ends[at], ends[at + 1] - target[i]
                if min(under, over) <= slack or step == 1:
                    found[i] = (cell if under <= over else cell + 1) * step
                    heavy |= min(under, over) > slack and rows[at]["rows"] > 1
                else:
                    nxt.setdefault(cell * step, (ends[at], []))[1].append(i)
        intervals, width = nxt, step
    return [found[i] for i in range(1, n)], heavy


def part_of(key: Column, splitters: Sequence[int], bits: int = KEY_BITS) -> Column:
    """The number of splitters at or below the key; only those that share its first PROBE_BITS bits are compared one by one."""
    shift = max(0, bits - PROBE_BITS)
    cells: list[list[int]] = [[] for _ in range(1 << (bits - shift))]
    for s in splitters:
        if s < 1 << bits:
            cells[s >> shift].append(s)
    first = list(accumulate((len(c) for c in cells), initial=0))
    cell = (F.shiftright(key, shift) + 1).cast("int")
    base, near = _json(first, "array<int>"), _json(cells, "array<array<bigint>>")
    return F.element_at(base, cell) + F.size(F.filter(F.element_at(near, cell), lambda s: s <= key))


def _cells(keys: DataFrame, total: int, n_shards: int) -> tuple[int, DataFrame | None]:
    """Leading bits of the key that make cells of about CELL_BYTES, and for cells far above that the texts that make them so: `(c1, hot: [(t, bits)])`."""
    lead = min(KEY_BITS - ID_BITS, max(0, math.ceil(math.log2(max(1, total / CELL_BYTES)))))
    shift = KEY_BITS - lead
    c1 = F.shiftright("key", shift).alias("c1")
    heavy = keys.groupBy(c1).agg(F.sum("size").alias("w")).where(F.col("w") > 4 * CELL_BYTES).select("c1")
    heavy = cut(heavy)
    if heavy.isEmpty():
        release(heavy)
        return shift, None
    texts = keys.withColumn("c1", c1).join(broadcast_if_small(heavy), "c1").groupBy("c1", F.shiftright("key", ID_BITS).alias("t")).agg(F.sum("size").alias("w"))
    more = F.least(F.lit(ID_BITS), F.ceil(F.log2(F.col("w") / CELL_BYTES))).cast("int")
    hot = texts.where(F.col("w") > CELL_BYTES).groupBy(F.col("c1").alias("__c1")).agg(F.sort_array(F.collect_list(F.struct("t", more.alias("bits")))).alias("hot"))
    return shift, cut(hot)


def histogram_shards(df: DataFrame, n_shards: int, id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, keep: Sequence[str] | None = None) -> DataFrame:
    """Add `size` (bytes of UTF-8 and one), `shard` (0 to `n_shards` - 1) and `slot` (place in the shard, from 0 without gaps) to every row.

    Shards are ranges of `sort_key` whose sums of `size` are equal but for `tolerance` of
    a shard, or for one row where that is larger. Equal texts are neighbours: they share a
    shard unless a border falls among them, and then their order is by hash of the id. A
    null text counts as empty, null ids as one id. Rows that repeat in id and text share a
    key; only where so many do that a border cannot be set are they told apart by their
    place in the input, which is then written first unless it is a plain read of files.
    Shards may be empty when there are fewer rows than shards. Every row comes back once,
    with the columns of `keep` (default all) but those named like an output. An empty
    table gives an empty result.

    Keys and sizes alone are written and counted, some 16 bytes a row. After the
    splitters are known, whole rows are exchanged once, by shard and cell: cells are
    ranges of the key of about CELL_BYTES, so no task orders a whole shard, and a group of
    equal texts larger than that is cut by its bits of the id. Slots follow from sums over
    cells, one row per CELL_BYTES of text.
    """
    whole, columns = pack(df, OUT, keep)

    def keyed(source: DataFrame, place: Column | None) -> DataFrame:
        return source.select(sort_key(F.col("__text"), F.col("__id"), place).alias("key"), row_size(F.col("__text")).alias("size"))

    d = df.select(whole, q(id).alias("__id"), q(text).alias("__text"))
    place, written = None, None
    keys = cut(keyed(d, None))
    splitters, heavy = find_splitters(keys, n_shards, tolerance)
    if heavy:  # rows that repeat in id and text
        release(keys)
        if "Exchange" in d._jdf.queryExecution().executedPlan().toString():
            d = written = cut(d)
        place = F.monotonically_increasing_id()
        keys = cut(keyed(d, place))
        splitters, _ = find_splitters(keys, n_shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 0
    shift, hot = _cells(keys, total, n_shards)

    def placed(x: DataFrame) -> DataFrame:
        x = x.withColumn("c1", F.shiftright("key", shift)).withColumn("shard", part_of(F.col("key"), splitters))
        if hot is None:
            return x.withColumns({"seg": F.lit(0), "sub": F.lit(0)})
        x = x.join(broadcast_if_small(hot), F.col("c1") == F.col("__c1"), "left")
        t = F.shiftright("key", ID_BITS)
        own = F.filter("hot", lambda h: h["t"] == t)
        is_hot = F.coalesce(F.size(own) > 0, F.lit(False))
        seg = F.coalesce(2 * F.size(F.filter("hot", lambda h: h["t"] < t)), F.lit(0)) + is_hot.cast("int")
        low = F.col("key").bitwiseAND(F.lit((1 << ID_BITS) - 1))
        sub = F.when(is_hot, F.call_function("shiftright", low, F.lit(ID_BITS) - own[0]["bits"]).cast("int")).otherwise(0)
        return x.withColumns({"seg": seg, "sub": sub}).drop("__c1", "hot")

    cell = ["shard", "c1", "seg", "sub"]
    counts = placed(keys).groupBy(*cell).count()
    upto = Window.partitionBy("shard").orderBy("c1", "seg", "sub").rowsBetween(Window.unboundedPreceding, -1)
    start = cut(counts.withColumn("__start", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count"))
    d = d.select("__in", "__id", "__text", sort_key(F.col("__text"), F.col("__id"), place).alias("key"), row_size(F.col("__text")).alias("size"))
    d = placed(d)
    line = Window.partitionBy(*cell).orderBy("key", "__id", F.xxhash64("__text"))
    d = d.withColumn("__n", F.row_number().over(line)).join(broadcast_if_small(start), cell)
    out = d.select(*columns, "size", F.col("shard").cast("int").alias("shard"), (F.col("__start") + F.col("__n") - 1).alias("slot"))
    release(keys)
    return out


def write_shards(df: DataFrame, path: str) -> None:
    """Write sharded rows as one folder `shard=N` each, rows of a file in the order of their slots."""
    df.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
