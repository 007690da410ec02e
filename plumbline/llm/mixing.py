"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import pack, q
from plumbline.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 1.5  # words wanted, of all words there are
MOST = 2.0  # copies of a document at most, and of a source's words
RANK_BITS, ROW_BITS = 36, 12  # of the whole number documents are ordered by: their rank, then their place in the input
OUT = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add `weight` to `(source, ...)` rows: the weights repeat along the sources by code point, null last.

    Sources are numbered over ranges of names, so no task sees all of them.
    """
    n = max(1, min(sizes.sparkSession.sparkContext.defaultParallelism, sizes.count() // 1000))
    d = cut(sizes.withColumn("__none", F.col("source").isNull()).repartitionByRange(n, "__none", "source").withColumn("__part", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(d.groupBy("__part").count().collect()):  # at most as many rows as there are cores
        before[r["__part"]], total = total, total + r["count"]
    start = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    number = F.row_number().over(Window.partitionBy("__part").orderBy("__none", "source")) - 1 + F.element_at(start, F.col("__part"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    return d.withColumn("weight", weight).drop("__none", "__part")


def fill_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Add `target` to `(source, source_size, weight)`: `total` shared by weight, a target stopping at `most` times its source's size.

    What is over a stop is shared again by weight among the others, until none is above.
    """
    cap, w = F.col("source_size") * most, F.col("weight")
    rate, n_stopped = None, -1
    while True:  # each round only adds stopped sources
        stopped = F.lit(False) if rate is None else w * rate >= cap
        s = sources.agg(F.sum(F.when(stopped, cap).otherwise(0.0)).alias("full"), F.sum(F.when(~stopped, w).otherwise(0.0)).alias("w"), F.count_if(stopped).alias("n")).first()
        if not s["w"] or s["n"] == n_stopped:
            break
        rate, n_stopped = (total - (s["full"] or 0.0)) / s["w"], s["n"]
    return sources.withColumn("target", cap if rate is None else F.least(w * rate, cap))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, the same on every run and engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def mix_sources(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                most: float = MOST, seed: str = "mix", keep: Sequence[str] | None = None) -> DataFrame:
    """Add `size` (words), `source_size`, `target` (of the source) and `taken` (words the mix takes, repeats counted) to every row.

    Targets: see `fill_targets`, with `share` of all words to deal out. A document of a
    source wanted c = target / source_size times is expected e times, where e leans to
    longer documents: e = c + a (z - z'), z = size / (size + 500), z' the mean of z over
    the source's words and a = min(c, most - c) / 2, so that expected words add up to the
    target. floor(e) copies are certain. The rest p of e is a chance: documents are
    ranked by u / (1 - u) * (1 - p) / p with u uniform, hashed from seed, id and text,
    and taken in that order until the source's words are nearest to its target
    (Pareto order sampling of a fixed size, measured in words).

    A null text has size 0; rows without a source are a source of their own, the last.
    Repeated rows have one rank; which of them the end of a sample falls on is settled
    by their place in the input. Every row comes back once; `taken` is 0, 1 or 2 times its
    size. `keep` names the input columns to carry (default all); those named like an
    output are replaced. An empty table gives an empty result.

    Where a sample ends is found by summing words over bins of the rank, so a source may
    hold any share of the rows.
    """
    whole, columns = pack(df, OUT, keep)
    size = word_count(q(text))
    d = df.select(whole, q(source).alias("__source"), size.alias("size"), uniform(F.lit(seed), q(id), F.md5(F.coalesce(q(text), F.lit("")))).alias("__u"))
    d = cut(d.withColumn("__row", F.xxhash64(F.monotonically_increasing_id())))
    z = F.floor(F.col("size") * 1000 / (F.col("size") + 500)).cast("long")  # thousandths, so that sums are exact
    dec = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = cut(d.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), (dec(z * F.col("size")).cast("double") / F.sum("size")).alias("lean")))
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    src = cut(fill_targets(cut(numbered_sources(sums, weights)), share * total, most))
    s = src.select(F.col("source").alias("__s"), "source_size", "target", "lean")
    d = d.join(s, d["__source"].eqNullSafe(s["__s"]))
    c = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    e = F.when(F.col("size") > 0, c + F.least(c, most - c) / 2 * ((z - F.col("lean")) / 1000.0)).otherwise(0.0)
    e = F.least(F.greatest(e, F.lit(0.0)), F.lit(most))
    d = d.withColumn("__e", e).withColumn("__whole", F.floor("__e").cast("long")).withColumn("__p", F.col("__e") - F.col("__whole"))
    rank = F.col("__u") / (1 - F.col("__u")) * ((1 - F.col("__p")) / F.col("__p"))
    # order-preserving whole number: rank / (1 + rank) lies in (0, 1)
    key = F.when((F.col("__p") > 0) & (F.col("size") > 0), F.floor(rank / (1 + rank) * 2.0**RANK_BITS).cast("long") * 2**ROW_BITS + F.pmod("__row", F.lit(2**ROW_BITS)))
    d = d.withColumn("__key", key)
    wanted = d.groupBy("__s").agg((F.first("target") - F.sum(F.col("size") * F.col("__whole"))).alias("rest"))
    # written, so that its size is known and documents stay where they are while sources are few
    ends = cut(_ends(d.where("__key IS NOT NULL").select("__s", "__key", "size"), wanted).select(F.col("__s").alias("__t"), "end"))
    d = d.join(ends, d["__s"].eqNullSafe(ends["__t"]), "left")
    more = F.when(F.col("__key") <= F.col("end"), 1).otherwise(0)
    return d.select(*columns, "size", "source_size", "target", (F.col("size") * (F.col("__whole") + more)).alias("taken"))


def _ends(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """`(__s, end)`: the key up to which a source's documents are taken so that their words come nearest to `rest`.

    Words are summed over 2**16 bins of the rank; only the bin in which `rest` is
    reached is looked at key by key. Of a source of 10**9 documents that is some 15,000
    keys, and rows with one rank make no more than 2**ROW_BITS.
    """
    bin_ = F.shiftright("__key", RANK_BITS + ROW_BITS - 16)
    bins = ranked.groupBy("__s", bin_.alias("bin")).agg(F.sum("size").alias("words"))
    w = wanted.select(F.col("__s").alias("__w"), "rest")
    upto = Window.partitionBy("__s").orderBy("bin")
    over = bins.withColumn("to", F.sum("words").over(upto)).join(w, F.col("__s").eqNullSafe(F.col("__w"))).where("to > rest")
    edge = cut(over.groupBy("__s", "rest").agg(F.min(F.struct("bin", (F.col("to") - F.col("words")).alias("have"))).alias("at")).select(
        F.col("__s").alias("__e"), "rest", "at.bin", "at.have"))
    keys = ranked.join(edge, F.col("__s").eqNullSafe(F.col("__e")) & (bin_ == F.col("bin"))).groupBy("__e", "rest", "have", "__key").agg(F.sum("size").alias("words"))
    keys = keys.withColumn("to", F.col("have") + F.sum("words").over(Window.partitionBy("__e").orderBy("__key")))
    last = F.min(F.when(F.col("to") > F.col("rest"), F.struct("__key", "to", "words")))
    end = keys.groupBy("__e", "rest").agg(last.alias("o"))
    nearer = F.col("o.to") - F.col("rest") < F.col("rest") - (F.col("o.to") - F.col("o.words"))  # one key more comes nearer to the target
    end = end.select("__e", (F.col("o.__key") - F.when(nearer, 0).otherwise(1)).alias("end"))
    # where `rest` is not passed everything is taken
    return wanted.join(end, F.col("__s").eqNullSafe(F.col("__e")), "left").select("__s", F.coalesce("end", F.lit(2**62)).alias("end"))
