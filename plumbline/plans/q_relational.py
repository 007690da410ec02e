"""Registered queries: selection, aggregation, windows, set operations and scalar functions."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.functions.ordered import Key, quantiles, quantiles_wide, running_total
from plumbline.operators import filters as W
from plumbline.operators import rollups as R
from plumbline.plans.registry import query, sql_query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
MICROS = lambda: F.unix_micros(F.col("ts").cast("timestamp"))

# ---- selection ----------------------------------------------------------------------------------------

sql_query("b1_select_where_having", """
    SELECT event_type, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS level, count(*) AS n, round(sum(value), 4) AS total
    FROM {events} WHERE value > 1 AND event_type <> 'error' GROUP BY event_type, CASE WHEN value > 20 THEN 'high' ELSE 'low' END
    HAVING count(*) > 5""")


@query("b2_filter_vocabulary", """SELECT doc_id, lang, source, n_chars FROM {documents} WHERE lang <> 'de' AND n_chars >= 100 AND n_chars < 5000
    AND source LIKE 'src1%' AND source NOT LIKE '%9' AND source IN ('src1', 'src11', 'src12', 'src19') AND lang NOT IN ('fr')""")
def b2(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return d.where(W.filter_tree(d, {"lang_neq": "de", "n_chars_geq": 100, "n_chars_lt": 5000, "source_like": "src1%",
                                     "source_notlike": "%9", "source_in": ["src1", "src11", "src12", "src19"], "lang_notin": ["fr"]}))


@query("b2_array_filters", """SELECT doc_id, (lang = 'en' OR source = 'en') AS has, (lang = 'en' AND source = 'src1') AS has_all,
    (lang IN ('de', 'src2') OR source IN ('de', 'src2')) AS has_any FROM {documents}""")
def b2b(t):
    d = t.documents.select("doc_id", F.array("lang", "source").alias("tags"))
    return d.select("doc_id", W.filter_tree(d, {"tags_has": "en"}).alias("has"),
                    W.filter_tree(d, {"tags_hasall": ["en", "src1"]}).alias("has_all"),
                    W.filter_tree(d, {"tags_hasany": ["de", "src2"]}).alias("has_any"))


@query("b3_filter_trees", """SELECT event_id, event_type, value FROM {events} WHERE (event_type = 'purchase' AND value > 15.0)
    OR (event_type IN ('click', 'view') AND (value < 2.0 OR user_id = 7))""")
def b3(t):
    d = t.events.select("event_id", "event_type", "value", "user_id")
    tree = {"OR": [{"event_type": "purchase", "value_gt": 15.0},
                   {"AND": [{"event_type_in": ["click", "view"]}, {"OR": [{"value_lt": 2.0}, {"user_id": 7}]}]}]}
    return d.where(W.filter_tree(d, tree)).select("event_id", "event_type", "value")


@query("b4_metadata_filter", "SELECT vec_id, label FROM {embeddings} WHERE label >= 2 AND label < 8 AND label NOT IN (5) AND vec_id <> 3")
def b4(t):
    d = t.embeddings.select("vec_id", "label")
    return d.where(W.metadata_filter(d, {"label": {"$gte": 2, "$lt": 8, "$nin": [5]}, "vec_id": {"$ne": 3}}))


sql_query("b5_row_transform", """
    WITH base AS (SELECT event_id, upper(event_type) AS kind, coalesce(value, 0.0) * 100 AS cents, CAST(user_id AS VARCHAR(20)) AS uid FROM {ev_nulls})
    SELECT event_id, kind, round(cents, 4) AS cents, uid, CASE WHEN cents >= 1000 THEN 'large' WHEN cents > 0 THEN 'small' ELSE 'none' END AS size
    FROM base WHERE kind <> 'VIEW'""")


@query("b6_unnest", """SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM {documents}) q
    GROUP BY 1, 2""")
def b6(t):
    return (t.documents.select("lang", F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
            .groupBy("lang", "word").agg(F.count("*").alias("n")))


@query("b7_ingest_redaction", """SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS user_hash, CAST(epoch_us(ts) AS BIGINT) AS micros,
    make_timestamp(epoch_us(ts)) AS at FROM {events} WHERE event_type <> 'error'""")
def b7(t):
    d = t.events.where("event_type <> 'error'").select("event_id", S.redact_key(F.col("user_id")).alias("user_hash"), MICROS().alias("micros"))
    return d.withColumn("at", F.timestamp_micros("micros"))


@query("b8_qualify", """SELECT event_id, user_id, value FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2""")
def b8(t):
    return R.top_per_group(t.events, ["user_id"], [F.desc("value"), F.col("event_id")], 2).select("event_id", "user_id", "value")


@query("b9_keyset_page", "SELECT event_id, ts, user_id FROM {events} WHERE event_id < 700 ORDER BY event_id DESC LIMIT 50")
def b9(t):
    return W.keyset_page(t.events.select("event_id", "ts", "user_id"), "event_id", 700, 50)


@query("b10_measure_state", """SELECT event_type, CASE WHEN observed = 0 OR value IS NULL THEN 'not_measured' WHEN value = 0 THEN 'measured_zero'
    ELSE 'measured_positive' END AS state, count(*) AS n FROM {ev_obs} GROUP BY 1, 2""")
def b10(t):
    return t.ev_obs.groupBy("event_type", S.measure_state(F.col("value"), F.col("observed") == 1).alias("state")).agg(F.count("*").alias("n"))


# ---- aggregation ---------------------------------------------------------------------------------------

sql_query("e1_group_aggregates", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
           min(l_discount) AS min_disc, max(l_tax) AS max_tax, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    ORDER BY revenue DESC LIMIT 100""")


@query("e2_quantile", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50 FROM {events} GROUP BY 1")
def e2(t):
    return R6(quantiles_wide(t.events, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"]), "p50", "p95")


@query("e3_quantile_set", """SELECT event_type, p, round(value, 6) AS value FROM (""" + " UNION ALL ".join(
    f"SELECT event_type, CAST({p} AS DOUBLE) AS p, quantile_cont(value, {p}) AS value FROM {{events}} GROUP BY 1"
    for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) + ") q")
def e3(t):
    q = quantiles(t.events, ["value"], [0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999], ["event_type"])
    return R6(q, "value").select("event_type", "p", "value")


@query("e4_weighted_totals", """SELECT event_type, count(*) AS sample_size, sum(w) AS est_count, round(sum(w * value), 4) AS est_sum,
    round(sum(w * value) / sum(w), 6) AS est_mean FROM {ev_w} GROUP BY 1""")
def e4(t):
    return R6(R.weighted_totals(t.ev_w, ["event_type"], "w", "value"), "est_mean").withColumn("est_sum", F.round("est_sum", 4))


@query("e5_weighted_intervals", """WITH g AS (SELECT event_type, count(*) AS sample_size, sum(w) AS c, sum(w * value) AS s, sum(w * (w - 1)) AS vc,
      sum(w * (w - 1) * value * value) AS vs FROM {ev_w} GROUP BY 1)
    SELECT event_type, sample_size, 'count' AS measure, round(c, 4) AS estimate, round(c - 1.959964 * sqrt(vc), 4) AS lower, round(c + 1.959964 * sqrt(vc), 4) AS upper FROM g
    UNION ALL SELECT event_type, sample_size, 'sum', round(s, 4), round(s - 1.959964 * sqrt(vs), 4), round(s + 1.959964 * sqrt(vs), 4) FROM g""")
def e5(t):
    return R.weighted_intervals(t.ev_w, ["event_type"], "w", "value").withColumns({c: F.round(c, 4) for c in ("estimate", "lower", "upper")})


@query("e6_exact_and_approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, true AS sketch_within_10pct FROM {events} GROUP BY 1")
def e6(t):
    # distinct pairs first, so neither a hot type nor a hot user reaches one task as raw rows
    pairs = t.events.groupBy("event_type", "user_id").agg(F.lit(1).alias("o"))
    return pairs.groupBy("event_type").agg(
        F.count("*").alias("users"),
        (F.abs(F.approx_count_distinct("user_id", 0.02) - F.count("*")) <= 0.1 * F.count("*")).alias("sketch_within_10pct"))


sql_query("e7_conditional_ratios", """
    SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors,
      round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
      round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0), 6) AS purchase_per_view
    FROM {events} GROUP BY CAST(ts AS DATE)""".replace("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors",
                                                       "CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors")
          .replace("avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)", "avg(CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DOUBLE))")
          .replace("sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END)", "sum(CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE))"))

sql_query("e8_ratio_safe_average", """
    WITH pre AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS total FROM {events} GROUP BY user_id, event_type)
    SELECT event_type, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 6) AS mean_value FROM pre GROUP BY event_type""")

sql_query("e9_usage_metering", """
    SELECT o_custkey, date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS amount
    FROM {orders} GROUP BY o_custkey, date_trunc('month', o_orderdate)""")

sql_query("e10_daily_revenue", """
    SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY CAST(o_orderdate AS DATE)""")

sql_query("e10_top_products", """
    SELECT p_partkey, p_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
    GROUP BY p_partkey, p_name ORDER BY revenue DESC, p_partkey LIMIT 20""")


@query("e11_time_buckets", " UNION ALL ".join(
    f"SELECT '{w}' AS width, time_bucket(INTERVAL '{w}', ts) AS start, count(*) AS n FROM {{events}} GROUP BY 2"
    for w in R.BUCKETS))
def e11(t):
    widths = list(R.BUCKETS)
    # the finest bucket is counted once; wider ones are built from it
    fine = t.events.groupBy(R.time_bucket(F.col("ts"), "1 minute").alias("m")).agg(F.count("*").alias("c"))
    long = fine.select("c", F.inline(F.array(*[F.struct(F.lit(w).alias("width"), R.time_bucket(F.col("m"), w).alias("start")) for w in widths[1:]])))
    out = fine.select(F.lit(widths[0]).alias("width"), F.col("m").alias("start"), F.col("c").alias("n"))
    return out.unionByName(long.groupBy("width", "start").agg(F.sum("c").alias("n")))


@query("e12_multi_dataset_report", """SELECT 'errors' AS alias, count(*) AS n, round(sum(value), 4) AS total FROM {events} WHERE event_type = 'error'
    UNION ALL SELECT 'purchases', count(*), round(sum(value), 4) FROM {events} WHERE event_type = 'purchase'
    UNION ALL SELECT 'urgent_orders', count(*), round(sum(o_totalprice), 4) FROM {orders} WHERE o_orderpriority = '1-URGENT'""")
def e12(t):
    e = t.events.where("event_type in ('error', 'purchase')").groupBy(
        F.when(F.col("event_type") == "error", "errors").otherwise("purchases").alias("alias")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    o = t.orders.where("o_orderpriority = '1-URGENT'").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    return e.unionByName(R.report({"urgent_orders": o}))


sql_query("e13_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")

sql_query("e14_tenant_scope", """
    SELECT o_custkey AS tenant, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 8) AS mean
    FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")


@query("e15_rollup_reconcile", """WITH a AS (SELECT date_trunc('hour', ts) AS period, count(*) AS exact FROM {events} GROUP BY 1),
    b AS (SELECT date_trunc('hour', ts) AS period, 4.0 * count(*) AS estimate, 12.0 * count(*) AS v FROM {events}
      WHERE substr(md5(CAST(event_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') GROUP BY 1)
    SELECT a.period, exact, CAST(coalesce(estimate, 0) AS DOUBLE) AS estimate, CAST(coalesce(estimate, 0) - exact AS DOUBLE) AS error,
      abs(coalesce(estimate, 0) - exact) <= 1.959964 * sqrt(coalesce(v, 0)) AS covered FROM a LEFT JOIN b ON a.period = b.period""")
def e15(t):
    kept = t.events.where(F.substring(F.md5(F.col("event_id").cast("string")), 1, 1).isin("0", "1", "2", "3")).withColumn("w", F.lit(4.0))
    return R.rollup_reconcile(t.events, kept, "ts", "hour", "w")


# ---- windows ---------------------------------------------------------------------------------------------

BY, ORDER = ["event_type"], ["micros", "event_id"]


def _ev(t):
    return t.events.select("event_id", "user_id", "event_type", "value", MICROS().alias("micros"))


@query("f1_row_number", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM {events}")
def f1(t):
    return R.row_numbers(_ev(t), BY, ORDER).select("event_id", "rn")


@query("f1_top_per_group", """SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rn
    FROM {events} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3""")
def f1b(t):
    return R.top_per_group(t.events, BY, [F.desc("value"), F.col("event_id")], 3).select("event_type", "event_id", "value", "rn")


@query("f2_lag", "SELECT event_id, lag(value, 2, 0.0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lagged FROM {events}")
def f2(t):
    return R.lagged(_ev(t), BY, ORDER, "value", 2, 0.0).select("event_id", "lagged")


@query("f3_nth_value", "SELECT event_id, nth_value(value, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM {events}")
def f3(t):
    return R.nth_values(_ev(t), BY, ORDER, "value", 2).select("event_id", "nth")


@query("f4_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts), 4) AS running FROM {events}")
def f4(t):
    return running_total(_ev(t), BY, "micros", {"running": "value"}).select("event_id", F.round("running", 4).alias("running"))


@query("f5_moving_mean", """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving
    FROM {events}""")
def f5(t):
    return R.moving_mean(_ev(t), BY, ORDER, "value", 2).select("event_id", F.round("moving", 6).alias("moving"))


_GAPS = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 0) END AS v FROM {events})"


def _gaps(t):
    return _ev(t).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.round("value", 0)))


@query("f1_row_number_descending", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY v DESC NULLS FIRST, ts DESC, event_id) AS rn FROM " + _GAPS)
def f1c(t):
    return R.row_numbers(_gaps(t), BY, [Key("v", True, True), Key("micros", True), "event_id"]).select("event_id", "rn")


@query("f2_lag_descending", "SELECT event_id, lag(value, 2, 0.0) OVER (PARTITION BY event_type ORDER BY v DESC NULLS LAST, event_id DESC) AS lagged FROM " + _GAPS)
def f2b(t):
    return R.lagged(_gaps(t), BY, [Key("v", True), Key("event_id", True)], "value", 2, 0.0).select("event_id", "lagged")


@query("f4_running_sum_nulls_last", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY v NULLS LAST), 4) AS running FROM " + _GAPS)
def f4b(t):
    return running_total(_gaps(t), BY, Key("v", nulls_first=False), {"running": "value"}).select("event_id", F.round("running", 4).alias("running"))


@query("f5_moving_mean_descending", """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving
    FROM {events}""")
def f5b(t):
    return R.moving_mean(_ev(t), BY, [Key("micros", True), "event_id"], "value", 2).select("event_id", F.round("moving", 6).alias("moving"))


@query("f6_entity_profile", """WITH p AS (SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS requests, count(DISTINCT event_type) AS kinds,
      avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS fs FROM {events} GROUP BY 1, 2)
    SELECT hour, user_id, requests, kinds, round(fs, 6) AS flagged_share, rank() OVER w AS rank, count(*) OVER (PARTITION BY hour) AS n_entities,
      round(percent_rank() OVER w, 6) AS percent_rank FROM p WINDOW w AS (PARTITION BY hour ORDER BY requests DESC)""")
def f6(t):
    return R6(R.entity_profile(t.events, "ts", "user_id", "event_type", F.col("event_type") == "error"), "flagged_share", "percent_rank")


# ---- sorting and sets --------------------------------------------------------------------------------------

sql_query("g1_order_by", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders} ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey")


@query("g2_limit", "SELECT event_id, event_type, value FROM {events} ORDER BY value DESC, event_id LIMIT 500")
def g2(t):
    return W.limited(t.events.select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id"))


@query("g3_top_groups", "SELECT user_id, count(*) AS n FROM {events} GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15")
def g3(t):
    return W.top_groups(t.events, ["user_id"], F.count("*"), 15, "n")


@query("g4_example_rows", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem} WHERE (l_orderkey, l_linenumber) IN
    (SELECT (l_orderkey, l_linenumber) FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 6""")
def g4(t):
    keys = ["l_orderkey", "l_linenumber"]
    first = t.lineitem.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys).limit(6).drop("n")
    cols = [*keys, "l_partkey", "l_suppkey"]
    return t.lineitem.select(*cols).join(F.broadcast(first), keys, "left_semi").orderBy(*cols).limit(6)


sql_query("h1_union", """SELECT c_nationkey AS k, 'c' AS src FROM {customer} UNION SELECT s_nationkey, 's' FROM {supplier}""")
sql_query("h1_union_all", """SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) q GROUP BY k""")
sql_query("h2_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
sql_query("h3_except", "SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")


@query("h4_key_set_difference", """SELECT 'customer_only' AS side, count(*) AS n FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})
    UNION ALL SELECT 'orders_only', count(DISTINCT o_custkey) FROM {orders} WHERE o_custkey NOT IN (SELECT k FROM {cust_miss})""")
def h4(t):
    a = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n"))
    b = t.orders.join(t.cust_miss, F.col("o_custkey") == F.col("k"), "left_anti").select("o_custkey").distinct().agg(F.count("*").alias("n"))
    return a.select(F.lit("customer_only").alias("side"), "n").unionByName(b.select(F.lit("orders_only").alias("side"), "n"))


# ---- scalar functions ---------------------------------------------------------------------------------------

@query("i1_strings", r"""SELECT doc_id, upper(lang) AS u, lower(source) AS l, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n,
    text LIKE '%the%' AS has_the, regexp_matches(text, '[0-9]{3}') AS has_digits FROM {documents}""".replace("{3}", "{3}"))
def i1(t):
    return t.documents.select("doc_id", F.upper("lang").alias("u"), F.lower("source").alias("l"),
                              F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("n"),
                              F.col("text").like("%the%").alias("has_the"), F.col("text").rlike("[0-9]{3}").alias("has_digits"))


@query("i4_hash_bucket", """SELECT CAST(CAST('0x' || substr(md5('exp1:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS INT) AS bucket,
    min(sha256(CAST(user_id AS VARCHAR))) AS first_hash, count(DISTINCT user_id) AS users FROM {events} GROUP BY 1""")
def i4(t):
    u = t.events.select("user_id").distinct()
    return u.groupBy(S.stable_bucket(F.col("user_id"), 100, "exp1:").alias("bucket")).agg(
        F.min(S.redact_key(F.col("user_id"))).alias("first_hash"), F.count("*").alias("users"))


@query("i5_dates", """SELECT event_id, date_trunc('hour', ts) AS h, ts - INTERVAL 30 MINUTE AS earlier,
    ts BETWEEN TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-31 00:00:00' AS recent,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc FROM {events}""")
def i5(t):
    ts = F.col("ts").cast("timestamp")
    now = F.to_timestamp(F.lit("2024-01-31T00:00:00Z"))
    return t.events.select("event_id", F.date_trunc("hour", ts).alias("h"), (ts - F.expr("interval 30 minutes")).alias("earlier"),
                           ts.between(now - F.expr("interval 7 days"), now).alias("recent"),
                           F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc"))


@query("i6_json_paths", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS absent FROM {events}""")
def i6(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
                           F.get_json_object("props", "$.none").alias("absent"))


@query("i7_nested_access", """SELECT vec_id, embedding[1] AS first, embedding[len(embedding)] AS last, len(embedding) AS n, label AS by_field, label + 1 AS by_key FROM {embeddings}""")
def i7(t):
    d = t.embeddings.select("vec_id", "embedding", F.struct("label").alias("s"),
                            F.create_map(F.lit("a"), F.col("label"), F.lit("b"), F.col("label") + 1).alias("m"))
    return d.select("vec_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"),
                    F.size("embedding").cast("long").alias("n"), F.col("s.label").alias("by_field"), F.element_at("m", F.element_at(F.map_keys("m"), 2)).alias("by_key"))


@query("i8_math", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / l_quantity, 8) AS unit, round(ln(l_extendedprice), 6) AS log_price,
    round(asinh(l_quantity), 6) AS asinh_qty, round(ln(1 + l_discount), 6) AS log1p_disc FROM {lineitem}""")
def i8(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("unit"),
                             F.round(F.log("l_extendedprice"), 6).alias("log_price"), F.round(F.asinh("l_quantity"), 6).alias("asinh_qty"),
                             F.round(F.log1p("l_discount"), 6).alias("log1p_disc"))


@query("i9_case_cast", """SELECT event_id, coalesce(TRY_CAST(event_type AS BIGINT), -1) AS as_int, CASE WHEN value IS NULL THEN 'none' WHEN value < 5 THEN 'low' ELSE 'high' END AS level,
    CAST(user_id AS VARCHAR) AS uid FROM {ev_nulls}""")
def i9(t):
    return t.ev_nulls.select("event_id", F.coalesce(F.col("event_type").try_cast("bigint"), F.lit(-1).cast("long")).alias("as_int"),
                             F.when(F.col("value").isNull(), "none").when(F.col("value") < 5, "low").otherwise("high").alias("level"),
                             F.col("user_id").cast("string").alias("uid"))


@query("i10_strict_typing", """SELECT event_id, ts FROM {events} WHERE user_id > 100 AND value >= 3.0 AND ts < TIMESTAMP '2024-01-15 00:00:00'""")
def i10(t):
    d = t.events.select("event_id", "ts", "user_id", "value")
    for name, bad in (("user_id", "100"), ("value", 3), ("ts", "2024-01-15")):
        try:
            W.check_literal(d, name, bad)
        except TypeError:
            continue
        raise AssertionError(f"{name} accepted {bad!r}")
    return d.where(W.filter_tree(d, {"user_id_gt": 100, "value_geq": 3.0, "ts_lt": dt.datetime(2024, 1, 15)})).select("event_id", "ts")
