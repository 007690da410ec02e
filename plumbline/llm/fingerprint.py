"""Homomorphic document fingerprints: sums of wide vectors hashed from paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pack, q

LANES = 8  # 60-bit sums of paragraph hashes: what equality is judged by
LANE_BITS = 60
SIGNS = 60  # sums of two 30-bit lanes each, more than a text has pieces: 120 counters that estimate how much two texts share
BARE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF"  # scripts that put no blanks between words
WORD = rf"[{BARE}]|[^\s{BARE}]{{1,24}}"  # a word; one longer than 24 characters counts as several, a letter of BARE as one
CHUNK = 127  # pieces whose bits are summed in lanes of eight bits, eight in a long
BYTES = 0x0101010101010101
MASK = 2**LANE_BITS - 1


def _sum(values: Column, each) -> Column:
    """Sum of `each(value)` modulo 2**60. Addends are below 2**60, so nothing overflows."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + each(x)).bitwiseAND(F.lit(MASK)))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the fingerprint of `text` as a struct `(paragraphs, pieces, lanes, signs)`.

    Paragraphs are what line feeds separate, empty ones included. `lanes` sum LANES
    hashes of every paragraph modulo 2**60 and decide equality, whatever the order of
    paragraphs. `signs` sum, modulo 2**30 each, 120 hashed bits of every distinct piece
    in a paragraph; `likeness` compares them. Pieces are all runs of three words, overlapping
    ones too, so that a word put in, left out or changed touches three of them; a paragraph of
    one or two words is one piece. Both are sums, so fingerprints of two sets of
    paragraphs add up to that of their union (`add`, `subtract`). A null text is empty:
    one empty paragraph and no piece.
    """
    t = F.coalesce(text, F.lit(""))
    hashes = lambda p: F.transform(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))
    three = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
    d = df.withColumns({"__par": F.transform(F.split(t, "\n"), lambda p: F.xxhash64(p)),
                        "__pce": F.flatten(F.transform(F.transform(F.split(t, "\n"), hashes), lambda w: F.array_distinct(three(w))))})
    lanes = [_sum(F.col("__par"), lambda h, i=i: F.xxhash64(h, F.lit(i)).bitwiseAND(F.lit(MASK))) for i in range(LANES)]
    # sums of up to CHUNK pieces, eight to a long, are added up in the wider counters
    n = F.size("__pce")
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(CHUNK)), lambda at: F.slice("__pce", at, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<bigint>>"))
    bits = lambda xs, i: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(BYTES)))
    again = lambda c: F.transform(c, lambda h: F.xxhash64(h, F.lit(1)))
    packed = F.transform(F.transform(chunks, lambda c: F.struct(c.alias("a"), again(c).alias("b"))),
                         lambda c: F.array(*[bits(c["a"], i) for i in range(8)], *[bits(c["b"], i) for i in range(SIGNS * 2 // 8 - 8)]))
    d = d.withColumn("__sum", packed)
    lane = lambda c, m, to: F.shiftleft(F.shiftrightunsigned(F.get(c, F.lit(m // 8)), m % 8 * 8).bitwiseAND(F.lit(255)), to)
    signs = [_sum(F.col("__sum"), lambda c, k=k: lane(c, 2 * k, 0) + lane(c, 2 * k + 1, 30)) for k in range(SIGNS)]
    fp = F.struct(F.size("__par").cast("long").alias("paragraphs"), F.size("__pce").cast("long").alias("pieces"), F.array(*lanes).alias("lanes"), F.array(*signs).alias("signs"))
    return d.withColumn(name, fp).drop("__par", "__pce", "__sum")


def _combine(a: Column, b: Column, sign: int) -> Column:
    add = lambda x, y: (x + y * sign + (0 if sign > 0 else 2**LANE_BITS)).bitwiseAND(F.lit(MASK))
    return F.struct((a["paragraphs"] + b["paragraphs"] * sign).alias("paragraphs"), (a["pieces"] + b["pieces"] * sign).alias("pieces"),
                    F.zip_with(a["lanes"], b["lanes"], add).alias("lanes"), F.zip_with(a["signs"], b["signs"], add).alias("signs"))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of `a` once the paragraphs of `b` are taken out."""
    return _combine(a, b, -1)


def equal(a: Column, b: Column) -> Column:
    """Whether two fingerprints are of the same paragraphs, in any order."""
    return (a["paragraphs"] == b["paragraphs"]) & (a["lanes"] == b["lanes"])


def digest(fp: Column) -> Column:
    """What `equal` looks at, as text."""
    return F.concat(F.hex(fp["paragraphs"]), F.lit("-"), F.array_join(F.transform(fp["lanes"], lambda x: F.lpad(F.hex(x), 15, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of their pieces that two texts have in common, from 0 to 1, estimated from the fingerprints; 1 for equal ones.

    With signs of +1 and -1 for the hashed bits, the mean square of a text's counters
    is the sum of its squared piece counts, and that of two texts' differences is the
    same sum for the pieces that differ. The error is about 0.06 at one half.
    """
    def square(x, n):
        parts = [2.0 * F.shiftrightunsigned(x, s).bitwiseAND(F.lit(2**30 - 1)) - n for s in (0, 30)]
        return parts[0] * parts[0] + parts[1] * parts[1]

    def apart(x, y, n):
        parts = [2.0 * (F.shiftrightunsigned(x, s).bitwiseAND(F.lit(2**30 - 1)) - F.shiftrightunsigned(y, s).bitwiseAND(F.lit(2**30 - 1))) - n for s in (0, 30)]
        return parts[0] * parts[0] + parts[1] * parts[1]

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    own = total(F.transform(a["signs"], lambda x: square(x, a["pieces"]))) + total(F.transform(b["signs"], lambda x: square(x, b["pieces"])))
    differ = total(F.zip_with(a["signs"], b["signs"], lambda x, y: apart(x, y, a["pieces"] - b["pieces"])))
    return F.when(equal(a, b), 1.0).when(own > 0, F.least(F.greatest(1.0 - differ / own, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of every row's text, see `with_fingerprint`.

    One narrow pass without a shuffle. Equal texts have equal fingerprints, repeated
    rows too; an empty table gives an empty result; an input column called `name` is
    replaced.
    """
    whole, columns = pack(df, [name])
    return with_fingerprint(df.select(whole, q(text).alias("__text")), F.col("__text"), "__fp").select(*columns, F.col("__fp").alias(name))
