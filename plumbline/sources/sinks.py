"""Writing and maintaining tables: partitioned writes, landing, round trips, stamps, manifests, retention."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut, release

WHOLE_FILE = 1 << 30
PIECE = 1 << 28  # bytes of a large file that one task reads


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


# ---- writes ------------------------------------------------------------------------------------------------

def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite", max_records: int = 20_000_000) -> None:
    """Columnar write by natural key.

    Spark is asked to group rows by key before writing (its rebalance keeps tasks
    even by splitting a large key), so a key yields few files and a hot key many
    writers.
    """
    d = df.hint("rebalance", *[F.col(k) for k in keys])
    d.write.mode(mode).partitionBy(*keys).option("maxRecordsPerFile", max_records).parquet(path)


def write_by_day(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Write under year=/month=/day= folders."""
    d = df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    write_partitioned(d, path, ["year", "month", "day"], mode)


def land_raw(df: DataFrame, path: str, body: str, extra: Sequence[str] = ()) -> None:
    """JSON lines holding the untouched body in `raw`, to be parsed later."""
    df.select(*extra, F.col(body).alias("raw")).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*keys) if keys else w).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def delete_where(spark: SparkSession, path: str, condition: Column, key: str) -> int:
    """Filtered delete from a table partitioned by `key`: only partitions holding hits are rewritten.

    Rows where the condition is unknown stay. Returns the number of rows removed. What
    stays is written beside the table first, then a list of the files it replaces; only
    then do these move out and the new ones in. A writer that dies before the list is
    complete has changed nothing; one that dies later is finished by the next call, or by
    `finish_deletes`. Until then readers may miss rows of a partition, never see any twice.
    """
    finish_deletes(spark, path)
    d = spark.read.parquet(path)
    if key not in d.columns:
        raise ValueError(f"{key} is not a column of {path}")
    gone = F.coalesce(condition, F.lit(False))
    # folders come from the files themselves, so that no value has to be turned into a folder name
    d = d.select("*", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("__folder"))
    hit = sorted(d.where(gone).groupBy("__folder").agg(F.count("*").alias("n")).collect())  # one row per touched partition
    if not hit:
        return 0
    number = spark.createDataFrame([(r["__folder"], i) for i, r in enumerate(hit)], "__folder string, __number int")
    rewritten = f"{path.rstrip('/')}/{REWRITTEN}{uuid.uuid4().hex[:12]}"  # readers pass over names with an underscore
    parts = [c for c in d.columns if any(f"/{quote(c)}=" in r["__folder"] or f"/{c}=" in r["__folder"] for r in hit)]
    keep = d.where(~gone).join(number, "__folder").drop("__folder", *parts)
    keep.write.partitionBy("__number").parquet(f"{rewritten}/new")
    plan = []
    for i, r in enumerate(hit):
        fs, folder = _fs(spark, unquote(r["__folder"]) if _missing(spark, r["__folder"]) else r["__folder"])
        plan += [(i, folder.toString(), f.getPath().getName()) for f in fs.listStatus(folder) if f.isFile()]
    spark.createDataFrame(plan, "number int, folder string, file string").coalesce(1).write.parquet(f"{rewritten}/plan")
    _swap(spark, rewritten)
    if not spark.read.schema(d.drop("__folder").schema).parquet(path).where(gone).isEmpty():
        raise RuntimeError(f"rows that match are left in {path}")
    return sum(r["n"] for r in hit)


REWRITTEN = "_rewritten-"


def finish_deletes(spark: SparkSession, path: str) -> int:
    """Finish deletes whose writer died: swap in what was completely planned, drop the rest; returns how many were finished."""
    fs, root = _fs(spark, path)
    open_ = [f.getPath().toString() for f in fs.listStatus(root) if f.getPath().getName().startswith(REWRITTEN)]
    planned = [p for p in open_ if not _missing(spark, f"{p}/plan/_SUCCESS")]
    for p in planned:
        _swap(spark, p)
    for p in open_:
        fs.delete(_fs(spark, p)[1], True)
    return len(planned)


def _swap(spark: SparkSession, rewritten: str) -> None:
    """Move the planned files out and the new ones in; each step may be repeated."""
    plan = spark.read.schema("number int, folder string, file string").parquet(f"{rewritten}/plan").collect()
    for i, folder in sorted({(r["number"], r["folder"]) for r in plan}):
        fs, here = _fs(spark, folder)
        _, old = _fs(spark, f"{rewritten}/old/{i}")
        fs.mkdirs(old)
        for r in plan:
            if r["number"] == i and not _missing(spark, f"{folder}/{r['file']}"):
                _move(spark, fs, _fs(spark, f"{folder}/{r['file']}")[1], old)
        _, new = _fs(spark, f"{rewritten}/new/__number={i}")
        for f in fs.listStatus(new) if fs.exists(new) else []:
            _move(spark, fs, f.getPath(), here)
        if fs.exists(here) and not list(fs.listStatus(here)):
            fs.delete(here, True)
    fs, p = _fs(spark, rewritten)
    fs.delete(p, True)


def _missing(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return not fs.exists(p)


def _move(spark: SparkSession, fs, file, folder) -> None:
    if not fs.rename(file, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, file.getName())):
        raise OSError(f"could not move {file} to {folder}")


def retain_days(spark: SparkSession, path: str, key: str, last_day: str, days: int) -> list[str]:
    """Drop whole day partitions more than `days` before `last_day`; returns the days dropped. No row is read."""
    from datetime import date, timedelta
    first = date.fromisoformat(last_day) - timedelta(days=days)
    fs, root = _fs(spark, path)
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(f"{key}="):
            day = name.split("=", 1)[1]
            if date.fromisoformat(day) < first:
                fs.delete(st.getPath(), True)
                dropped.append(day)
    return sorted(dropped)


def compact(spark: SparkSession, path: str, out: str, target_bytes: int = 256 << 20) -> dict[str, int]:
    """Rewrite a table of many small files into files near `target_bytes`, in the same partitions.

    Sizes come from the file listing. A table without partitions is merged without a
    shuffle when files only have to become fewer; one with partitions is regrouped by
    them, a partition that is large by itself over several writers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    s = files.agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.first("path").alias("one")).first()
    want = max(1, -(-int(s["b"] or 0) // target_bytes))
    inferred = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inferred)
    spark.conf.set(inferred, "false")  # partition values are kept as they are spelt
    try:
        d = spark.read.parquet(path)
    finally:
        spark.conf.set(inferred, before)
    keys = [c for c in d.columns if f"/{c}=" in (s["one"] or "") or f"/{quote(c)}=" in (s["one"] or "")]
    if keys:
        rows = max(1, int(d.count() / want))
        write_partitioned(d, out, keys, max_records=rows)
        return {"files_before": s["n"], "files_wanted": want}
    now = d.rdd.getNumPartitions()
    (d.coalesce(want) if want <= now else d.repartition(want)).write.mode("overwrite").parquet(out)
    return {"files_before": s["n"], "files_wanted": want}


# ---- checks ------------------------------------------------------------------------------------------------------

def _write_as(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).option("quoteAll", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def round_trip_check(df: DataFrame, folder: str, formats: Sequence[str] = ("parquet", "orc", "json", "csv")) -> DataFrame:
    """Write and re-read in each format: columns whose type changed and rows lost or gained.

    Rows are compared as multisets of digests of every column's text, so one
    shuffle of 16-byte keys compares tables of any width.
    """
    spark = df.sparkSession
    parts = []
    for fmt in formats:
        path = f"{folder}/{fmt}"
        _write_as(df, path, fmt)
        r = spark.read.option("header", True).option("inferSchema", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
        was = {f.name: f.dataType.simpleString() for f in df.schema}
        got = {f.name: f.dataType.simpleString() for f in r.schema}
        changed = sorted(c for c in was if got.get(c) != was[c])
        common = [c for c in df.columns if c in got]
        dig = lambda d: d.select(F.unhex(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast(was[c]).cast("string"), F.lit("\u0002")) for c in common]))).alias("h"))  # noqa: B023,E731
        both = dig(df).withColumn("s", F.lit(1)).unionAll(dig(r).withColumn("s", F.lit(-1))).groupBy("h").agg(F.sum("s").alias("s"))
        parts.append(both.agg(F.coalesce(F.sum(F.greatest("s", F.lit(0))), F.lit(0)).alias("rows_lost"),
                              F.coalesce(F.sum(F.greatest(-F.col("s"), F.lit(0))), F.lit(0)).alias("rows_gained")).select(
            F.lit(fmt).alias("format"), F.lit(", ".join(changed)).alias("types_changed"), "rows_lost", "rows_gained"))
    return reduce(DataFrame.unionByName, parts)


def content_digest(df: DataFrame) -> DataFrame:
    """`(n_records, digest)`: order-free, from row digests combined by exclusive-or and by sum.

    Each row is reduced to a sha256 of its columns in name order; nulls differ
    from empty text.
    """
    cols = sorted(df.columns)
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in cols]), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("long")
    s = df.agg(F.count("*").alias("n_records"), *[x for i in range(4) for x in (
        F.bit_xor(part(i)).alias(f"x{i}"), F.sum(part(i).cast("decimal(38,0)")).alias(f"s{i}"))])
    every = F.concat_ws(":", "n_records", *[F.col(f"{p}{i}").cast("string") for i in range(4) for p in ("x", "s")])
    return s.select("n_records", F.sha2(every, 256).alias("digest"))


def stamp(df: DataFrame, sidecar: str, source: str, script: str) -> dict:
    """Write a sidecar describing the table's content."""
    s = content_digest(df).first()
    rec = {"n_records": s["n_records"], "sha256": s["digest"], "source": source, "script": script}
    fs, p = _fs(df.sparkSession, sidecar)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(rec, sort_keys=True).encode()))
    out.close()
    return rec


def verify_stamp(df: DataFrame, sidecar: str) -> DataFrame:
    """Compare a table with its sidecar; raise when the content differs."""
    spark = df.sparkSession
    text = spark.read.text(sidecar, wholetext=True).first()[0]
    rec = json.loads(text)
    s = content_digest(df).first()
    if s["digest"] != rec["sha256"] or s["n_records"] != rec["n_records"]:
        raise ValueError(f"content differs from its stamp: {rec['n_records']} records stamped, {s['n_records']} found")
    return spark.createDataFrame([(rec["source"], rec["script"], s["n_records"], "pass")], "source string, script string, n_records long, status string")


def _openssl() -> ctypes.CDLL | None:
    """OpenSSL, whose digests can be handed from task to task unlike hashlib's, where it is there and one handed over comes out right."""
    for find in (lambda: "libcrypto.so.3", lambda: ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(find() or "")
            if _finish(lib, _go_on(lib, _go_on(lib, None, [b"a" * 100]), [b"b"])) == hashlib.sha256(b"a" * 100 + b"b").hexdigest():
                return lib
        except (OSError, AttributeError):
            continue
    return None


def _go_on(lib: ctypes.CDLL, state: bytes | None, pieces: Iterable[bytes]) -> bytes:
    digest = ctypes.create_string_buffer(state or b"", 128)  # a SHA256_CTX has 112 bytes, none of them an address
    if state is None:
        lib.SHA256_Init(digest)
    for piece in pieces:
        lib.SHA256_Update(digest, piece, ctypes.c_size_t(len(piece)))
    return digest.raw


def _finish(lib: ctypes.CDLL, state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctypes.create_string_buffer(state, 128))
    return out.raw.hex()


def _read(path: str, start: int, n: int) -> Iterator[bytes]:
    """`n` bytes of a file from `start` on, or those up to its end."""
    with open(path.removeprefix("file:"), "rb") as f:
        f.seek(start)
        while n and (piece := f.read(min(n, 1 << 24))):
            n -= len(piece)
            yield piece


def _hash_piece(start: int, n: int) -> Callable:
    """Digests of files up to `start`, taken `n` bytes further: a state while a file goes on, then its hex digest."""
    @F.pandas_udf(T.BinaryType())
    def step(paths: pd.Series, lengths: pd.Series, states: pd.Series) -> pd.Series:
        lib = _openssl()

        def one(path: str, length: int, state: bytes | None) -> bytes | None:
            if length <= start:
                return state
            last = length <= start + n
            if lib is not None:
                state = _go_on(lib, state, _read(path, start, n))
                return _finish(lib, state).encode() if last else state
            h = hashlib.sha256()  # nothing can be handed over: the last task reads it all
            for piece in _read(path, 0, length if last else 0):
                h.update(piece)
            return h.hexdigest().encode() if last else None
        return pd.Series([one(*x) for x in zip(paths, lengths, states)], dtype=object)
    return step


def _hash_in_pieces(files: DataFrame) -> DataFrame:
    """`path, length, sha256` of large files: each round of tasks reads one piece of every file and hands its digests to the next."""
    n, longest = files.agg(F.count(F.lit(1)), F.max("length")).first()
    d = files.withColumn("state", F.lit(None).cast("binary"))
    for start in range(0, longest, PIECE):
        old, d = d, cut(d.repartition(max(n, min(4 * n, 200)), "path").withColumn("state", _hash_piece(start, PIECE)("path", "length", "state")))
        release(old)
    return d.withColumn("sha256", F.col("state").cast("string")).drop("state")


def _relative(folder: str) -> Column:
    """A scanned file's path below the folder."""
    return F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/").split("://")[-1]) + "/", "")


def digest_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """`(path, size, sha256)` per file, path relative to the folder.

    Files up to `PIECE` are hashed in the scan. Larger ones in folders mounted on the
    executors are read piece by piece, each by another task that goes on with the digest
    of the one before; files of other stores are hashed in the scan up to 1 GiB, and
    cannot be larger. Spark's scan passes over empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rel = _relative(folder)
    mounted = _fs(spark, folder)[0].getUri().getScheme() == "file"
    whole = PIECE if mounted else WHOLE_FILE  # a plain bound on the length, so that the scan opens no file above it
    small = files.where(F.col("length") <= whole).select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(rel.alias("rel"), "path", "length")
    if large.isEmpty():
        return small
    return small.unionByName(_hash_in_pieces(large).select(F.col("rel").alias("path"), F.col("length").alias("size"), "sha256"))


def manifest_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests."""
    j = old.select("path", F.col("size").alias("s0"), F.col("sha256").alias("h0")).join(new.select("path", F.col("size").alias("s1"), F.col("sha256").alias("h1")), "path", "full")
    kind = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("h0") != F.col("h1")) | (F.col("s0") != F.col("s1")), "changed")
    return j.select("path", kind.alias("drift")).where("drift is not null")


def stale_outputs(spark: SparkSession, folder: str, lineage: DataFrame) -> DataFrame:
    """Outputs older than an input they derive from. `lineage` is `(output, input)` with paths relative to the folder.

    A missing file is reported as such, not passed over.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        _relative(folder).alias("name"), F.col("modificationTime").alias("at"))
    j = lineage.join(f.select(F.col("name").alias("output"), F.col("at").alias("out_at")), "output", "left").join(
        f.select(F.col("name").alias("input"), F.col("at").alias("in_at")), "input", "left")
    g = j.groupBy("output").agg(F.count("*").alias("n_inputs"), F.count_if(F.col("in_at") > F.col("out_at")).alias("n_newer"),
                                F.count_if(F.col("in_at").isNull() | F.col("out_at").isNull()).alias("n_missing"))
    return g.withColumn("status", F.when(F.col("n_missing") > 0, "abstain").when(F.col("n_newer") > 0, "stale").otherwise("fresh"))
