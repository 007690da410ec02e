"""Quality selection by importance resampling: hashed n-gram models of wanted and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordered import order_statistics
from plumbline.llm.common import U64, flat_text, in_pieces, mix, pack, q, rows_of, text_key, words
from plumbline.session import cut

BUCKETS = 1 << 14  # hashed n-gram counts of a model
SMOOTH = 1.0  # added to every count
SHARE = 0.85  # documents kept
FIT_ROWS = 20_000  # labelled documents the wanted model is learned from, at most
BATCH_BYTES = 4 << 20
OUT = ["n_grams", "log_weight", "rank_key", "kept"]


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of neighbouring words; marks between words count with the word before them."""
    data, off = flat_text(col)
    begin, end, h, first = words(data, off)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.diff(first)
    text = rows_of(n)
    # the byte after a word, and the one after that, tell prose from tables, markup and shouting
    pad = np.append(data, np.zeros(2, np.uint8)).astype(U64)
    upper = (data[begin] >= 65) & (data[begin] <= 90)
    shout = upper & (data[end - 1] >= 65) & (data[end - 1] <= 90) & (end - begin > 1)
    shape = pad[end] * U64(1024) + pad[end + 1] * U64(4) + shout.astype(U64)
    pair = np.flatnonzero(text[1:] == text[:-1])
    grams = np.concatenate([mix(h, 40), mix(shape, 41), mix(h[pair] ^ mix(h[pair + 1], 42), 43)])
    return (grams % U64(BUCKETS)).astype(np.int64), np.concatenate([text, text, text[pair]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, for raw text and for the wanted part."""
    total = np.zeros((2, BUCKETS), np.int64)
    for b in in_pieces(batches, "text", BATCH_BYTES):
        g, text = _grams(b.column("text"))
        wanted = b.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
        total[0] += np.bincount(g, minlength=BUCKETS)
        total[1] += np.bincount(g[wanted[text]], minlength=BUCKETS)
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "wanted"])


def models(df: DataFrame, text: Column, wanted: Column) -> np.ndarray:
    """Log of the ratio of the wanted to the raw model for every bucket; counts are of all texts."""
    d = df.select(text.alias("text"), F.coalesce(wanted, F.lit(False)).alias("wanted"))
    rows = d.mapInArrow(_count, "bucket long, raw long, wanted long").groupBy("bucket").agg(F.sum("raw"), F.sum("wanted")).collect()  # at most BUCKETS rows
    count = np.zeros((2, BUCKETS))
    for b, raw, good in rows:
        count[:, b] = raw, good
    share = (count + SMOOTH) / (count + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def _weigh(ratio, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "__text", BATCH_BYTES):
            g, text = _grams(b.column("__text"))
            n = np.bincount(text, minlength=b.num_rows)
            weight = np.bincount(text, weights=ratio.value[g], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("__in"), b.column("__u"), pa.array(n.astype(np.int64)), pa.array(weight)], schema=schema)
    return run


def resample(df: DataFrame, labels: DataFrame, good: Column, id: str = "doc_id", text: str = "text", share: float = SHARE, seed: str = "quality",
             keep: list[str] | None = None) -> DataFrame:
    """Add `n_grams`, `log_weight`, `rank_key` and `kept` to every row.

    The wanted model is that of texts whose id `labels` marks `good`, of FIT_ROWS ids at
    most (those with the least hash); the raw model is that of all texts. Both count hashed words, word pairs and what follows each word.
    `log_weight` is the log of the ratio of a text's probabilities under the two, a mean
    over its n-grams times the square root of their number, so that length alone decides
    nothing. `rank_key` adds Gumbel noise hashed from seed, id and text; the `share` of
    the rows with the highest keys are kept (at least one of equal keys at the end keeps
    them all), which draws rows without replacement in proportion to their weights.

    A null text is empty; texts without words have no n-grams, weight 0 and a key below
    all others. Ids labelled twice count as good when any label is. Null ids are not
    labelled. Repeated rows have the same key. With no good text the weights are those
    of the raw model against itself smoothed, and the draw goes on. `keep` names the
    input columns to carry (default all); those named like an output are replaced. An
    empty table gives an empty result. Texts are read twice and never shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    marks = labels.where(good).select(q(id).alias("__l")).where("__l IS NOT NULL").distinct()
    marks = F.broadcast(marks.orderBy(F.xxhash64("__l"), "__l").limit(FIT_ROWS).withColumn("__good", F.lit(True)))  # bounded: FIT_ROWS ids
    d = df.select(q(id).alias("__id"), q(text).alias("__text"))
    d = d.join(marks, d["__id"] == marks["__l"], "left")
    ratio = df.sparkSession.sparkContext.broadcast(models(d, F.col("__text"), F.col("__good")))
    whole, columns = pack(df, OUT, keep)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), q(id).cast("string"), text_key(F.coalesce(q(text), F.lit(""))).cast("string"))), 1, 13), 16, 10)
    d = df.select(whole, ((u.cast("double") + 0.5) / float(16**13)).alias("__u"), q(text).alias("__text"))
    schema = T.StructType([d.schema["__in"], d.schema["__u"]] + T._parse_datatype_string("n_grams long, __sum double").fields)
    d = d.mapInArrow(_weigh(ratio, to_arrow_schema(schema)), schema)
    weight = F.when(F.col("n_grams") > 0, F.col("__sum") / F.sqrt("n_grams")).otherwise(0.0)
    d = d.withColumn("log_weight", weight)
    d = cut(d.withColumn("rank_key", F.when(F.col("n_grams") > 0, F.col("log_weight") - F.log(-F.log("__u"))).otherwise(F.lit(-1e6))).drop("__u", "__sum"))
    least = order_statistics(d, ["rank_key"], [0.0], want=lambda n: [max(0, n - max(1, round(share * n)))])
    row = least.first() if least is not None else None
    end = row["value"] if row else 0.0
    return d.select(*columns, "n_grams", "log_weight", "rank_key", (F.col("rank_key") >= end).alias("kept"))
