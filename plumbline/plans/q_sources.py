"""Registered queries: sources, sinks, maintenance and streaming ingest."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.registry import query
from plumbline.session import scratch
from plumbline.sources import sinks as W
from plumbline.sources import tables as R
from plumbline.streaming import ingest as I

# ---- reading ------------------------------------------------------------------------------------------

_TXT = """SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS kind, CASE WHEN event_id % 40 = 0 THEN 'NA' WHEN event_id % 40 = 1 THEN '' ELSE CAST(value AS VARCHAR(30)) END AS amount,
    lpad(CAST(user_id AS VARCHAR(9)), 5, '0') AS code FROM {events}"""


def _csv(t, sep=",", ext="csv"):
    path = scratch(t.spark, "text") + "." + ext
    t.sql(_TXT).write.option("header", True).option("sep", sep).csv(path)
    return path


@query("a1_load_table", """SELECT 'parquet' AS kind, count(*) AS n, count(*) FILTER (kind = '') AS n_empty FROM ("""
       + _TXT + """) q UNION ALL SELECT 'csv', count(*), count(*) FILTER (kind = '') FROM (""" + _TXT + """) q UNION ALL SELECT 'tsv', count(*), count(*) FILTER (kind = '') FROM ("""
       + _TXT + """) q UNION ALL SELECT 'jsonl', count(*), count(*) FILTER (kind = '') FROM (""" + _TXT + ") q")
def a1(t):
    base = t.sql(_TXT)
    pq, js = scratch(t.spark, "t") + ".parquet", scratch(t.spark, "t") + ".jsonl"
    base.write.parquet(pq)
    base.write.json(js)
    out = None
    for kind, path in (("parquet", pq), ("csv", _csv(t)), ("tsv", _csv(t, "\t", "tsv")), ("jsonl", js)):
        d = R.load_table(t.spark, path).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "").alias("n_empty")).select(F.lit(kind).alias("kind"), "n", "n_empty")
        out = d if out is None else out.unionByName(d)
    return out


@query("a2_read_text_table", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, kind, code, CASE WHEN amount IN ('', 'NA') THEN amount ELSE 'number' END AS amount FROM (" + _TXT + ") q")
def a2(t):
    d = R.read_text_table(t.spark, _csv(t))
    return d.withColumn("amount", F.when(F.col("amount").isin("", "NA"), F.col("amount")).otherwise("number"))


@query("a3_numeric_shadow", """SELECT 'double' AS amount_type, 'string' AS code_type, 'double' AS user_type, count(*) AS n, count(*) FILTER (amount IN ('', 'NA')) AS n_null FROM (""" + _TXT + ") q")
def a3(t):
    d, _ = R.numeric_shadow(R.read_text_table(t.spark, _csv(t)))
    ty = dict(d.dtypes)
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("amount").isNull()).alias("n_null")).select(
        F.lit(ty["amount"]).alias("amount_type"), F.lit(ty["code"]).alias("code_type"), F.lit(ty["user_id"]).alias("user_type"), "n", "n_null")


@query("a3_values_lost", "SELECT 'amount' AS \"column\", 'NA' AS value, count(*) AS n FROM (" + _TXT + ") q WHERE amount = 'NA'")
def a3b(t):
    return R.numeric_shadow(R.read_text_table(t.spark, _csv(t)))[1]


@query("a4_typed_csv", "SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, count(*) FILTER (amount = 'NA') AS n_corrupt FROM (" + _TXT + ") q")
def a4(t):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("kind", T.StringType()),
                           T.StructField("amount", T.DoubleType()), T.StructField("code", T.StringType())])
    d = R.read_typed_csv(t.spark, _csv(t), schema, strict=False)
    return d.select("user_id", F.col("_corrupt").isNotNull().alias("bad"), "amount", "kind", "event_id", "code").agg(
        F.count("*").alias("n"), F.sum("user_id").alias("users"), F.count_if("bad").alias("n_corrupt"))


# ---- writing ------------------------------------------------------------------------------------------------

@query("a5_partitioned_write", "SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, count(*) AS n FROM {events} GROUP BY 1, 2, 3")
def a5(t):
    path = scratch(t.spark, "by_day")
    W.write_by_day(t.events, path, "ts")
    return t.spark.read.parquet(path).groupBy("year", "month", "day").agg(F.count("*").alias("n"))


@query("a6_raw_landing", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS ok FROM {events}")
def a6(t):
    path = scratch(t.spark, "raw")
    W.land_raw(t.events, path, "props", ["event_id"])
    d = R.parse_raw(t.spark.read.schema("event_id long, raw string").json(path), "k bigint")
    return d.select("event_id", "k", F.col("_ok").alias("ok"))


@query("a7_round_trip")
def a7(t):
    return W.round_trip_check(t.orders, scratch(t.spark, "trip"))


@query("a8_stamp_verify", "SELECT 'documents' AS source, count(*) AS n_records, 'pass' AS status FROM {documents}")
def a8(t):
    side = scratch(t.spark, "stamp") + ".json"
    W.stamp(t.documents, side, "documents", "q_sources")
    return W.verify_stamp(t.documents.hint("rebalance"), side).select("source", "n_records", "status")


@query("a9_digest_manifest")
def a9(t):
    return W.digest_manifest(t.spark, t.folder, "*.parquet")


@query("a9_manifest_drift", """SELECT 'nation.parquet' AS path, 'changed' AS drift UNION ALL SELECT 'region.parquet', 'removed' UNION ALL SELECT 'extra.parquet', 'added'""")
def a9b(t):
    old = W.digest_manifest(t.spark, t.folder, "*.parquet")
    new = old.where("path <> 'region.parquet'").withColumn("sha256", F.when(F.col("path") == "nation.parquet", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return W.manifest_drift(old, new.unionByName(old.where("path = 'region.parquet'").withColumn("path", F.lit("extra.parquet"))))


@query("a10_append_overwrite_delete", """SELECT event_type, CASE WHEN event_type = 'click' THEN count(*) WHEN event_type = 'error' THEN count(*) FILTER (value >= 5) WHEN event_type = 'signup' THEN 0 ELSE 2 * count(*) END AS n
    FROM {events} WHERE event_type <> 'signup' GROUP BY 1""")
def a10(t):
    path = scratch(t.spark, "table")
    W.append(t.events, path, ["event_type"])
    W.append(t.events.where("event_type not in ('click', 'error')"), path, ["event_type"])
    W.overwrite_partitions(t.events.where("event_type = 'click'"), path, ["event_type"])
    W.delete_where(t.spark, path, (F.col("event_type") == "signup") | ((F.col("event_type") == "error") & (F.col("value") < 5)), "event_type")
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a10_insert_select", "SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM {events} WHERE event_type = 'click' GROUP BY 1")
def a10b(t):
    name = "plumb_" + re.sub(r"\W", "_", scratch(t.spark, "t").rsplit("/", 1)[-1])
    path = scratch(t.spark, "insert")
    t.spark.sql(f"CREATE TABLE {name} (user_id BIGINT, n BIGINT) USING parquet LOCATION '{path}'")
    for kind in ("purchase", "click"):
        t.sql(f"INSERT INTO {name} SELECT user_id, count(*) FROM {{events}} WHERE event_type = '{kind}' GROUP BY user_id")
    t.spark.sql(f"DROP TABLE {name}")  # the files stay at their location
    return t.spark.read.parquet(path)


@query("a11_schema_evolution", """SELECT 'ts' AS "column", 'type changed from timestamp_ntz to string' AS problem, count(ts) AS n_values FROM {events}
    UNION ALL SELECT 'props', 'column dropped', count(props) FROM {events} UNION ALL SELECT 'flag', 'new column is not nullable', 0""")
def a11(t):
    old = t.events.schema
    new = T.StructType([f for f in old if f.name not in ("ts", "props", "user_id")] + [T.StructField("ts", T.StringType()), T.StructField("uid", T.LongType()),
                       T.StructField("flag", T.BooleanType(), False), T.StructField("note", T.StringType())])
    return R.evolution_report(t.events, new, {"user_id": "uid"})


@query("a12_compaction", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, true AS fewer_files FROM {lineitem}")
def a12(t):
    many, few = scratch(t.spark, "many"), scratch(t.spark, "few")
    t.lineitem.repartition(24).write.parquet(many)
    s = W.compact(t.spark, many, few)
    d = t.spark.read.parquet(few)
    return d.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.lit(s["files_wanted"] < s["files_before"]).alias("fewer_files"))


@query("a13_read_versions", """SELECT event_id, value, CAST(NULL AS VARCHAR) AS channel FROM {events} WHERE event_type = 'view' UNION ALL SELECT event_id, value, event_type FROM {events} WHERE event_type <> 'view'""")
def a13(t):
    v1 = t.events.where("event_type = 'view'").select("event_id", "value")
    return R.read_versions(v1, t.events.where("event_type <> 'view'").select("event_id", F.col("event_type").alias("channel"), "value"))


@query("a14_stale_outputs")
def a14(t):
    names = [("customer.parquet", "nation.parquet"), ("lineitem.parquet", "orders.parquet"), ("lineitem.parquet", "part.parquet"), ("orders.parquet", "absent.parquet")]
    return W.stale_outputs(t.spark, t.folder, t.spark.createDataFrame(names, "output string, input string"))


@query("a15_retention", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 14 GROUP BY 1")
def a15(t):
    path = scratch(t.spark, "days")
    W.write_partitioned(t.events.withColumn("day", F.to_date("ts")), path, ["day"])
    W.retain_days(t.spark, path, "day", "2024-01-30", 14)
    return t.spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"))


# ---- streaming ---------------------------------------------------------------------------------------------------

FIELDS = [I.Field("event_id", "bigint", True), I.Field("user_id", "bigint", True), I.Field("event_type", "string"), I.Field("value", "double"), I.Field("ts", "timestamp")]


def _messages(t, df=None):
    """JSON lines of the events with some required fields removed and some bodies cut off."""
    d = t.events if df is None else df
    uid = F.when(F.col("event_id") % 25 != 0, F.col("user_id"))
    js = F.to_json(F.struct("event_id", uid.alias("user_id"), "event_type", "value", "ts"))
    path = scratch(t.spark, "messages")
    d.select(F.when(F.col("event_id") % 33 == 5, F.substring(js, 1, 20)).otherwise(js).alias("value")).write.text(path)
    return path


def _ingested(t, transform=None):
    good, bad, chk = (scratch(t.spark, n) for n in ("good", "bad", "chk"))
    p = I.run_to_end(I.ingest(I.stream_text(t.spark, _messages(t)), FIELDS, good, bad, chk, transform))
    return good, bad, p


_BADROW = "(event_id % 33 = 5 OR event_id % 25 = 0)"


@query("k1_validated_ingest", f"""SELECT CASE WHEN event_id % 33 = 5 THEN 'malformed' WHEN event_id % 25 = 0 THEN 'missing user_id' ELSE 'valid' END AS outcome, count(*) AS n FROM {{events}} GROUP BY 1""")
def k1(t):
    good, bad, _ = _ingested(t)
    a = t.spark.read.parquet(good).agg(F.count("*").alias("n")).select(F.lit("valid").alias("outcome"), "n")
    return a.unionByName(t.spark.read.parquet(bad).groupBy(F.col("_error").alias("outcome")).agg(F.count("*").alias("n")))


@query("k2_ingest_timestamp", f"SELECT event_type, count(*) AS n, true AS stamped, true AS day_matches FROM {{events}} WHERE NOT {_BADROW} GROUP BY 1")
def k2(t):
    d = t.spark.read.parquet(_ingested(t)[0])
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.every(F.col(I.RESERVED).isNotNull()).alias("stamped"),
                                       F.every(F.to_date(I.RESERVED) == F.col("ingest_day")).alias("day_matches"))


@query("k3_stream_transform", f"SELECT event_id, upper(event_type) AS kind, sha256(CAST(user_id AS VARCHAR)) AS who, round(value * 100, 4) AS cents FROM {{events}} WHERE NOT {_BADROW} AND event_type <> 'view'")
def k3(t):
    def change(d):
        return d.where("event_type <> 'view'").select("event_id", F.upper("event_type").alias("kind"), F.sha2(F.col("user_id").cast("string"), 256).alias("who"),
                                                      F.round(F.col("value") * 100, 4).alias("cents"))
    return t.spark.read.parquet(_ingested(t, change)[0]).select("event_id", "kind", "who", "cents")


@query("k4_file_sink", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM {events}")
def k4(t):
    out, chk = scratch(t.spark, "sink"), scratch(t.spark, "chk")
    I.run_to_end(I.write_stream(I.validate(I.stream_text(t.spark, _messages(t), 4), FIELDS).select("event_id", "_raw"), out, chk))
    d = t.spark.read.parquet(out)
    return d.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col("event_id").cast("string"), F.regexp_extract("_raw", r"event_id\D+(\d+)", 1))).alias("ids"))


@query("k5_stream_dedup", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM {events} GROUP BY 1")
def k5(t):
    src, out, chk = (scratch(t.spark, n) for n in ("replay", "once", "chk"))
    t.ev_replay.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    s = t.spark.readStream.schema(t.spark.read.parquet(src).schema).parquet(src)
    I.run_to_end(I.write_stream(I.deduplicate(s, "event_id", "ts"), out, chk))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("k6_fan_out", f"SELECT 'raw' AS sink, count(*) AS n FROM {{events}} WHERE NOT {_BADROW} UNION ALL SELECT 'purchases', count(*) FROM {{events}} WHERE NOT {_BADROW} AND event_type = 'purchase'")
def k6(t):
    a, b, chk = (scratch(t.spark, n) for n in ("a", "b", "chk"))
    s = I.validate(I.stream_text(t.spark, _messages(t)), FIELDS).where("_error is null")
    I.run_to_end(I.fan_out(s, {"raw": (a, lambda d: d), "purchases": (b, lambda d: d.where("event_type = 'purchase'"))}, chk))
    n = lambda p, k: t.spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(k).alias("sink"), "n")
    return n(a, "raw").unionByName(n(b, "purchases"))


@query("k7_dead_letter", f"""SELECT 'done' AS outcome, count(*) AS n FROM {{events}} WHERE NOT {_BADROW} AND value >= 1 UNION ALL SELECT 'amount below 1', count(*) FROM {{events}} WHERE NOT {_BADROW} AND value < 1
    UNION ALL SELECT 'invalid', count(*) FROM {{events}} WHERE {_BADROW}""")
def k7(t):
    good, dead, chk = (scratch(t.spark, n) for n in ("done", "dead", "chk"))
    s = I.validate(I.stream_text(t.spark, _messages(t)), FIELDS).withColumnRenamed("_error", "_invalid")
    err = F.when(F.col("_invalid").isNotNull(), "invalid").when(F.col("value") < 1, "amount below 1")
    I.run_to_end(I.handle_messages(s, lambda d: d.withColumn("root", F.sqrt("value")), err, good, dead, chk))
    a = t.spark.read.parquet(good).agg(F.count("*").alias("n")).select(F.lit("done").alias("outcome"), "n")
    return a.unionByName(t.spark.read.parquet(dead).groupBy(F.col("_error").alias("outcome")).agg(F.count("*").alias("n")))


_K8 = "SELECT date_trunc('second', ts) AS second, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2"


@query("k8_pre_aggregate", _K8)
def k8(t):
    return I.pre_aggregate(t.events, "ts", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("k8_pre_aggregate_stream", _K8)
def k8b(t):
    src, out, chk = (scratch(t.spark, n) for n in ("ev", "agg", "chk"))
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    s = t.spark.readStream.schema(t.spark.read.parquet(src).schema).parquet(src)
    I.run_to_end(I.pre_aggregate_stream(s, "ts", ["event_type"], "value", "1 day", out, chk))
    return I.latest_batches(t.spark, out, ["second", "event_type"]).withColumn("total", F.round("total", 4))


@query("k9_loss_report", f"SELECT count(*) AS accepted, count(*) FILTER (NOT {_BADROW}) AS written, count(*) FILTER ({_BADROW}) AS quarantined, CAST(0 AS BIGINT) AS lost, 'pass' AS status FROM {{events}}")
def k9(t):
    good, bad, p = _ingested(t)
    return I.loss_report(t.spark, p["input_rows"], good, bad)


_SENT = "SELECT vec_id, label, 0 AS sent FROM {embeddings} UNION ALL SELECT vec_id, label + 100 AS label, 1 AS sent FROM {embeddings} WHERE label < 5"


@query("k10_insert", "SELECT vec_id, label FROM {embeddings}")
def k10(t):
    return I.keyed_ingest(None, t.sql(_SENT), "vec_id", "sent", upsert=False)


@query("k10_upsert_stream", "SELECT vec_id, CASE WHEN label < 5 THEN label + 100 ELSE label END AS label FROM {embeddings}")
def k10b(t):
    src, out, chk = (scratch(t.spark, n) for n in ("sent", "keyed", "chk"))
    t.sql(_SENT).write.parquet(src)
    s = t.spark.readStream.schema(t.spark.read.parquet(src).schema).parquet(src)
    I.run_to_end(I.keyed_stream(s, "vec_id", "sent", out, chk, upsert=True))
    return I.read_keyed(t.spark, out, "vec_id", "sent", upsert=True)
