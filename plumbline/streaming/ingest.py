"""Schema-validated streaming ingest from JSON files to partitioned tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from plumbline.session import cut, release
from plumbline.sources.sinks import _fs

RESERVED = "__ingest_ts"


@dataclass(frozen=True)
class Field:
    """One declared field of a stream."""

    name: str
    type: str
    required: bool = False


def stream_text(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw lines of JSON files as `value`."""
    r = spark.readStream.format("text")
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def validate(raw: DataFrame, fields: Sequence[Field], body: str = "value") -> DataFrame:
    """Parsed fields plus `_error`: null for a valid row, else what is wrong. The raw body is kept.

    A declared field present with another type, or a required field missing,
    is an error; nothing is dropped here.
    """
    if any(f.name == RESERVED for f in fields):
        raise ValueError(f"{RESERVED} is reserved")
    ddl = ", ".join(f"`{f.name}` {f.type}" for f in fields)
    p = F.from_json(F.col(body), ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    d = raw.withColumn("_p", p)
    err = F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "malformed")
    for f in fields:
        if f.required:
            err = err.when(F.col(f"_p.{f.name}").isNull(), f"missing {f.name}")
    return d.select(*[F.col(f"_p.{f.name}").alias(f.name) for f in fields], F.col(body).alias("_raw"), err.alias("_error"))


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds the ingest time and its day, the sink's partition."""
    d = df.withColumn(RESERVED, at if at is not None else F.current_timestamp())
    return d.withColumn("ingest_day", F.to_date(RESERVED))


def _start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], interval: str | None, mode: str = "append") -> StreamingQuery:
    _totals(df.sparkSession)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def _write_batch(df: DataFrame, path: str, batch_id: int, keys: Sequence[str] = ()) -> None:
    """One folder per micro-batch, replaced when the batch is retried, so delivery stays exactly once."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*keys) if keys else w).parquet(f"{path}/batch={batch_id}")


def ingest(raw: DataFrame, fields: Sequence[Field], good: str, quarantine: str, checkpoint: str,
           transform: Callable[[DataFrame], DataFrame] | None = None, interval: str | None = None) -> StreamingQuery:
    """Valid rows (transformed, stamped, by day) to one sink and invalid rows with their reason to another.

    `interval` is the roll interval, such as "300 seconds"; without one, everything
    available is processed and the query ends. The batch is written once and read
    twice, since both sinks need it.
    """
    checked = validate(raw, fields)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        ok = batch.where("_error is null").drop("_error", "_raw")
        _write_batch(stamped(transform(ok) if transform else ok), good, batch_id, ["ingest_day"])
        _write_batch(batch.where("_error is not null").select("_raw", "_error"), quarantine, batch_id)
        batch.unpersist()

    return _start(checked, checkpoint, write, interval)


class _Totals(StreamingQueryListener):
    """Batches and rows of every query, however many batches it takes; Spark itself keeps the last hundred."""

    def __init__(self):
        self.rows: dict[str, dict] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.setdefault(str(p.runId), {})[p.batchId] = p.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


_LISTENERS: dict[str, _Totals] = {}


def _totals(spark: SparkSession) -> _Totals:
    """The session's listener, added with its first query."""
    app = spark.sparkContext.applicationId
    if app not in _LISTENERS:
        _LISTENERS[app] = _Totals()
        spark.streams.addListener(_LISTENERS[app])
    return _LISTENERS[app]


def run_to_end(q: StreamingQuery) -> dict:
    """Wait for a query over what is available and total its batches and input rows."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = _totals(spark).rows.pop(str(q.runId), None)
    if rows is None:  # started elsewhere: what Spark still keeps has to be all there was
        kept = q.recentProgress
        rows = {p["batchId"]: p["numInputRows"] for p in kept}
        if len(rows) >= int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")):
            raise RuntimeError("the query's first batches may no longer be on record")
    return {"batches": len(rows), "input_rows": sum(rows.values())}


def fan_out(df: DataFrame, sinks: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """One stream to several sinks, each with its own transform; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for path, fn in sinks.values():
            _write_batch(fn(batch), path, batch_id)
        batch.unpersist()

    return _start(df, checkpoint, write, interval)


def handle_messages(df: DataFrame, handler: Callable[[DataFrame], DataFrame], error: Column, good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Per-message failure handling: rows whose `error` is not null go to the dead-letter sink with it, the rest are acknowledged."""

    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("_error", error).persist()
        _write_batch(handler(b.where("_error is null").drop("_error")), good, batch_id)
        _write_batch(b.where("_error is not null"), dead, batch_id)
        b.unpersist()

    return _start(df, checkpoint, write, None)


def deduplicate(df: DataFrame, message_id: str, ts: str, ttl: str = "86400 seconds") -> DataFrame:
    """Drop repeats of a message id arriving within the time to live.

    State is kept per id until the event-time watermark passes its expiry; the
    clock is event time, not wall time.
    """
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([message_id])


def write_stream(df: DataFrame, path: str, checkpoint: str, interval: str | None = None, mode: str = "append") -> StreamingQuery:
    """Plain file sink, one folder per micro-batch."""
    return _start(df, checkpoint, lambda b, i: _write_batch(b, path, i), interval, mode)


def pre_aggregate(df: DataFrame, ts: str, keys: Sequence[str], value: str) -> DataFrame:
    """One row per second and key: count and total (batch form)."""
    return df.groupBy(F.date_trunc("second", ts).alias("second"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def pre_aggregate_stream(df: DataFrame, ts: str, keys: Sequence[str], value: str, late: str, path: str, checkpoint: str) -> StreamingQuery:
    """The same on a stream: updated rows per micro-batch, to be read with `latest_batches`."""
    g = df.withWatermark(ts, late).groupBy(F.window(ts, "1 second").alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return write_stream(g.select(F.col("_w.start").alias("second"), *keys, "n", "total"), path, checkpoint, mode="update")


def latest_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last update of each key from a sink written per batch."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def loss_report(spark: SparkSession, accepted: int, good: str, quarantine: str) -> DataFrame:
    """Accepted rows against written and quarantined ones; a stream that accepts and writes nothing fails."""
    fs_rows = []
    for path in (good, quarantine):
        try:
            fs_rows.append(spark.read.parquet(path).count())
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fs_rows.append(0)
    written, held = fs_rows
    lost = accepted - written - held
    status = "abstain" if accepted == 0 else "fail" if lost != 0 or (written == 0 and held < accepted) else "pass"
    return spark.createDataFrame([(accepted, written, held, lost, status)], "accepted long, written long, quarantined long, lost long, status string")


def keyed_ingest(existing: DataFrame | None, arriving: DataFrame, key: str, order: str, upsert: bool) -> DataFrame:
    """Insert keeps the first row of an id, upsert the last, by arrival order.

    The winner is an aggregate, so an id sent many times costs one row per task.
    """
    d = arriving if existing is None else existing.withColumn(order, F.lit(-1).cast(arriving.schema[order].dataType)).unionByName(arriving)
    rest = [c for c in d.columns if c not in (key, order)]
    pick = F.max if upsert else F.min
    return d.groupBy(key).agg(pick(F.struct(order, *rest)).alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


KEYED_BUCKETS = 64  # of a keyed table, by hash of the key
MOST_PIECES = 8  # pieces of a bucket before it is written anew as one
PIECES = "bucket int, batch long, rows long, seq int"


def _committed(spark: SparkSession, path: str) -> list[int]:
    """Batches whose list of pieces is complete, ascending."""
    fs, log = _fs(spark, f"{path}/_log")
    if not fs.exists(log):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(log) if f.isDirectory()]
    done = [int(n.split("-")[1]) for n in names if fs.exists(_fs(spark, f"{path}/_log/{n}/_SUCCESS")[1])]
    return sorted(done)


def _pieces(spark: SparkSession, path: str, batch: int) -> list[Row]:
    """The pieces that made up the table after a batch: at most MOST_PIECES rows a bucket."""
    return spark.read.schema(PIECES).parquet(f"{path}/_log/batch-{batch}").collect()


def _folded(d: DataFrame, key: str, order: str, upsert: bool) -> DataFrame:
    """The winner of each key among rows with `_seq`, the age of their piece, and `order`."""
    rest = [c for c in d.columns if c not in (key, order, "_seq", "bucket")]
    pick = F.max if upsert else F.min
    return d.groupBy("bucket", key).agg(pick(F.struct("_seq", order, *rest)).alias("b")).select("bucket", key, F.col(f"b.{order}").alias(order), *[F.col(f"b.{c}").alias(c) for c in rest])


def _read_pieces(spark: SparkSession, path: str, pieces: Sequence[Row], schema: T.StructType) -> DataFrame:
    """Rows of pieces, with their bucket and the age of their piece."""
    if not pieces:
        return spark.createDataFrame([], schema).withColumns({"bucket": F.lit(0), "_seq": F.lit(0)})
    d = spark.read.option("basePath", f"{path}/rows").schema(T.StructType(schema.fields + T._parse_datatype_string("batch long, bucket int").fields)).parquet(
        *[f"{path}/rows/batch={r['batch']}/bucket={r['bucket']}" for r in pieces])
    age = F.create_map(*[F.lit(x) for r in {(r["batch"], r["seq"]) for r in pieces} for x in r])
    return d.withColumn("_seq", F.element_at(age, F.col("batch"))).drop("batch")


def read_keyed(spark: SparkSession, path: str, key: str, order: str, upsert: bool) -> DataFrame:
    """The table a `keyed_stream` has built, as of its last complete batch, without `order`."""
    done = _committed(spark, path)
    if not done:
        raise FileNotFoundError(f"no complete batch below {path}")
    pieces = _pieces(spark, path, done[-1])
    schema = T.StructType([f for f in spark.read.parquet(f"{path}/rows").schema.fields if f.name not in ("batch", "bucket")])
    return _folded(_read_pieces(spark, path, pieces, schema), key, order, upsert).drop("bucket", order)


def _commit(spark: SparkSession, path: str, batch_id: int, pieces: Sequence[tuple]) -> None:
    """From here on the batch counts: its list of pieces is complete once Spark has marked the write as done."""
    spark.createDataFrame(pieces, PIECES).coalesce(1).write.mode("overwrite").parquet(f"{path}/_log/batch-{batch_id}")


def _drop_unused(spark: SparkSession, path: str, keep: Sequence[int]) -> None:
    """Delete the pieces, and lists of pieces, that none of the batches in `keep` uses."""
    used = {(r["batch"], r["bucket"]) for b in keep for r in _pieces(spark, path, b)}
    fs, rows = _fs(spark, f"{path}/rows")
    for folder in fs.listStatus(rows):
        batch = int(folder.getPath().getName().split("=")[1])
        if batch > max(keep):
            continue
        left = 0
        for f in fs.listStatus(folder.getPath()):
            name = f.getPath().getName()
            if name.startswith("bucket="):
                if (batch, int(name.split("=")[1])) in used:
                    left += 1
                else:
                    fs.delete(f.getPath(), True)
        if not left:
            fs.delete(folder.getPath(), True)
    for b in _committed(spark, path):
        if b not in keep:
            fs.delete(_fs(spark, f"{path}/_log/batch-{b}")[1], True)


def keyed_stream(df: DataFrame, key: str, order: str, path: str, checkpoint: str, upsert: bool, buckets: int = KEYED_BUCKETS) -> StreamingQuery:
    """Keyed ingest as a stream, into a table of pieces per bucket of the key's hash; read it with `read_keyed`.

    Insert keeps the first row of a key, upsert the last: by batch, then by `order`. A
    micro-batch writes only its own winners, one piece per bucket it touches. A bucket is
    written anew as one piece when its later pieces have as many rows as its first, or
    when it has MOST_PIECES, so that what is written stays within a small multiple of
    what arrives. A batch counts once its list of pieces is complete. A batch that failed
    before that is written again over what it left; one that Spark replays after that is
    skipped. The pieces of the last two batches stay, for readers; older ones go. Null
    keys are one key.
    """
    spark = df.sparkSession
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        done = [b for b in _committed(spark, path) if b <= batch_id]
        if done and done[-1] == batch_id:
            return
        old = _pieces(spark, path, done[-1]) if done else []
        seq = max((r["seq"] for r in old), default=0) + 1
        arrived = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_seq", F.lit(seq))
        new = cut(_folded(arrived, key, order, upsert))
        touched = {r["bucket"]: r["count"] for r in new.groupBy("bucket").count().collect()}  # at most a row per bucket
        by_bucket: dict[int, list[Row]] = {}
        for r in sorted(old, key=lambda r: r["seq"]):
            by_bucket.setdefault(r["bucket"], []).append(r)
        whole = [b for b, n in touched.items() if (p := by_bucket.get(b)) and (len(p) + 1 >= MOST_PIECES or sum(r["rows"] for r in p[1:]) + n >= p[0]["rows"])]
        out = new.where(~F.col("bucket").isin(whole)) if whole else new
        if whole:
            kept = _read_pieces(spark, path, [r for b in whole for r in by_bucket[b]], schema)
            both = kept.unionByName(new.where(F.col("bucket").isin(whole)).withColumn("_seq", F.lit(seq)))
            out = out.unionByName(_folded(both, key, order, upsert))
        target = f"{path}/rows/batch={batch_id}"
        out.select("bucket", *schema.names).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        counts = {r["bucket"]: r["count"] for r in spark.read.parquet(target).groupBy("bucket").count().collect()} if touched else {}
        pieces = [tuple(r) for r in old if r["bucket"] not in whole] + [(b, batch_id, n, seq) for b, n in counts.items()]
        _commit(spark, path, batch_id, pieces)
        release(new)
        _drop_unused(spark, path, [*done[-1:], batch_id])

    return _start(df, checkpoint, write, None)
