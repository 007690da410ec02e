"""Registered queries: pipeline gates and caller-supplied checks."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import join_null_safe
from plumbline.operators import gates as G
from plumbline.plans.registry import query

FOUR = ["gate", "status", "observed", "expected"]


def _sql(rows):
    return " UNION ALL ".join(
        f"SELECT '{g}' AS gate, {st} AS status, CAST({o} AS DOUBLE) AS observed, CAST({e} AS DOUBLE) AS expected" for g, st, o, e in rows)


@query("m1_unique_key", _sql([
    ("orders", "CASE WHEN (SELECT count(*) - count(DISTINCT o_orderkey) FROM {orders}) = 0 THEN 'pass' ELSE 'fail' END",
     "(SELECT count(*) - count(DISTINCT o_orderkey) FROM {orders})", 0),
    ("lineitem", "CASE WHEN (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM {lineitem}) = 0 THEN 'pass' ELSE 'fail' END",
     "(SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM {lineitem})", 0)]))
def m1(t):
    a = G.unique_key(t.orders, ["o_orderkey"], "orders")
    return a.unionByName(G.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")).select(*FOUR)


@query("m2_row_conservation", _sql([
    ("left_join", "'pass'", "(SELECT count(*) FROM {orders})", "(SELECT count(*) FROM {orders})"),
    ("inner_join", "CASE WHEN (SELECT count(*) FROM {orders} JOIN {cust_miss} ON o_custkey = k) = (SELECT count(*) FROM {orders}) THEN 'pass' ELSE 'fail' END",
     "(SELECT count(*) FROM {orders} JOIN {cust_miss} ON o_custkey = k)", "(SELECT count(*) FROM {orders})")]))
def m2(t):
    on = F.col("o_custkey") == F.col("k")
    a = G.row_conservation(t.orders, t.orders.join(t.cust_miss, on, "left"), name="left_join")
    return a.unionByName(G.row_conservation(t.orders, t.orders.join(t.cust_miss, on), name="inner_join")).select(*FOUR)


@query("m3_injective_transform", """WITH p AS (SELECT count(DISTINCT p_name) AS a, count(DISTINCT replace(p_name, ' ', '')[1:6]) AS b FROM {part})
    SELECT 'squashed' AS gate, CASE WHEN a = b THEN 'pass' ELSE 'fail' END AS status, CAST(b AS DOUBLE) AS observed, CAST(a AS DOUBLE) AS expected FROM p
    UNION ALL SELECT 'lower', CASE WHEN count(DISTINCT c_name) = count(DISTINCT lower(c_name)) THEN 'pass' ELSE 'fail' END,
    count(DISTINCT lower(c_name)), count(DISTINCT c_name) FROM {customer}""")
def m3(t):
    a = G.injective_transform(t.part, "p_name", F.substring(F.replace("p_name", F.lit(" "), F.lit("")), 1, 6), "squashed")
    return a.unionByName(G.injective_transform(t.customer, "c_name", F.lower("c_name"), "lower")).select(*FOUR)


@query("m4_zero_is_structural", """SELECT 'events' AS gate, CASE WHEN count(*) FILTER (value = 0 AND observed = 0) = 0 THEN 'pass' ELSE 'fail' END AS status,
    CAST(count(*) FILTER (value = 0 AND observed = 0) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS expected FROM {ev_obs}
    UNION ALL SELECT 'flag_with_nulls', 'abstain', NULL, 0""")
def m4(t):
    a = G.zero_is_structural(t.ev_obs, "value", "observed", "events")
    b = t.ev_obs.withColumn("observed", F.when(F.col("event_id") % 7 > 0, F.col("observed")))
    return a.unionByName(G.zero_is_structural(b, "value", "observed", "flag_with_nulls")).select(*FOUR)


_DEV = "max(abs({n} / nullif({r}, 0) - n_items) / greatest(abs(n_items), 1.0))"


@query("m5_same_denominator", "WITH d AS (SELECT " + _DEV.format(n="n_returned", r="n_returned_rate") + " AS a, " + _DEV.format(n="qty", r="qty_per")
       + """ AS b FROM {rates}) SELECT 'base:n_returned_rate' AS gate, CASE WHEN a <= 1e-9 THEN 'pass' ELSE 'fail' END AS status, round(a, 9) AS observed, CAST(1e-9 AS DOUBLE) AS expected FROM d
    UNION ALL SELECT 'base:qty_per', CASE WHEN b <= 1e-9 THEN 'pass' ELSE 'fail' END, round(b, 9), 1e-9 FROM d""")
def m5(t):
    return G.same_denominator(t.rates, [("n_returned_rate", "n_returned"), ("qty_per", "qty")], "n_items", name="base").select(
        "gate", "status", F.round("observed", 9).alias("observed"), "expected")


@query("m6_bounded", _sql([
    ("bounded:l_discount", "CASE WHEN (SELECT count(*) FROM {lineitem} WHERE l_discount < 0 OR l_discount > 1) = 0 THEN 'pass' ELSE 'fail' END",
     "(SELECT count(*) FROM {lineitem} WHERE l_discount < 0 OR l_discount > 1)", 0),
    ("bounded:l_quantity", "'fail'", "(SELECT count(*) FROM {lineitem} WHERE l_quantity < 0 OR l_quantity > 1)", 0)]))
def m6(t):
    return G.bounded(t.lineitem, "l_discount").unionByName(G.bounded(t.lineitem, "l_quantity")).select(*FOUR)


@query("m7_inclusion_probs", """WITH p AS (SELECT 100.0 * o_totalprice / (SELECT sum(o_totalprice) FROM {orders}) AS pi FROM {orders})
    SELECT 'proportional' AS gate, CASE WHEN abs(sum(pi) - 100) <= 0.5 THEN 'pass' ELSE 'fail' END AS status, round(sum(pi), 6) AS observed, CAST(100 AS DOUBLE) AS expected FROM p
    UNION ALL SELECT 'truncated', CASE WHEN abs(sum(least(pi * 60, 1)) - 6000) <= 0.5 THEN 'pass' ELSE 'fail' END, round(sum(least(pi * 60, 1)), 6), 6000 FROM p""")
def m7(t):
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    p = t.orders.join(F.broadcast(total)).select((100.0 * F.col("o_totalprice") / F.col("total")).alias("pi"))
    a = G.inclusion_probs(p, "pi", 100, name="proportional")
    b = G.inclusion_probs(p.select(F.least(F.col("pi") * 60, F.lit(1.0)).alias("pi")), "pi", 6000, name="truncated")
    return a.unionByName(b).select("gate", "status", F.round("observed", 6).alias("observed"), "expected")


@query("m10_decomposition", """SELECT 'priority' AS gate, 'pass' AS status, round(sum(o_totalprice), 2) AS observed, round(sum(o_totalprice), 2) AS expected FROM {orders}
    UNION ALL SELECT 'without_pending', 'fail', round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2), round(sum(o_totalprice), 2) FROM {orders}""")
def m10(t):
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    a = t.orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("part")).join(F.broadcast(total))
    b = t.orders.where("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("part")).join(F.broadcast(total))
    g = [G.decomposition_reconciles(d, "part", F.col("total"), 1e-2, n) for d, n in ((a, "priority"), (b, "without_pending"))]
    return reduce(DataFrame.unionByName, g).select("gate", "status", F.round("observed", 2).alias("observed"), F.round("expected", 2).alias("expected"))


@query("m11_flip_matrix", """SELECT c2 IS NOT DISTINCT FROM c1 AS old_right, c3 IS NOT DISTINCT FROM c1 AS new_right, count(*) AS n FROM {coders} GROUP BY 1, 2""")
def m11(t):
    c = t.coders
    pick = lambda x: c.select("doc_id", F.col(x).alias("label"))
    return G.flip_matrix(pick("c2"), pick("c3"), pick("c1"), "doc_id", "label")


@query("m11_flip_near_misses", """SELECT CASE WHEN toxic = 1 AND c2 IS NOT DISTINCT FROM c1 THEN 'near_miss' ELSE 'other' END AS slice, c2 IS NOT DISTINCT FROM c1 AS old_right, c3 IS NOT DISTINCT FROM c1 AS new_right, count(*) AS n FROM {coders} GROUP BY 1, 2, 3""")
def m11b(t):
    c = t.coders
    pick = lambda x: c.select("doc_id", F.col(x).alias("label"))
    return G.flip_matrix(pick("c2"), pick("c3"), pick("c1"), "doc_id", "label", c.where("toxic = 1"))


_M12 = """SELECT CASE WHEN toxic = 1 THEN 'other' WHEN substr(md5(CAST(doc_id AS VARCHAR(20))), 1, 1) < '8' THEN 'in' ELSE 'out' END AS split,
    avg(CASE WHEN @ = c1 THEN 1.0 ELSE 0.0 END) AS metric, count(*) / 1000.0 AS cost FROM {coders} GROUP BY 1"""


@query("m12_accept_fix", "WITH a AS (" + _M12.replace("@", "c2") + "), b AS (" + _M12.replace("@", "c3") + """),
    g AS (SELECT a.split, a.metric - b.metric AS gain, a.cost FROM a JOIN b ON a.split = b.split),
    s AS (SELECT min(CASE WHEN split = 'in' THEN gain END) AS gi, min(CASE WHEN split = 'out' THEN gain END) AS go, min(CASE WHEN split = 'other' THEN gain END) AS gx, sum(cost) AS c FROM g)
    SELECT 'in_sample_gain' AS gate, CASE WHEN gi IS NULL THEN 'abstain' WHEN gi > 0 THEN 'pass' ELSE 'fail' END AS status, round(gi, 6) AS observed FROM s
    UNION ALL SELECT 'out_of_sample_gain', CASE WHEN go IS NULL THEN 'abstain' WHEN go > 0 THEN 'pass' ELSE 'fail' END, round(go, 6) FROM s
    UNION ALL SELECT 'no_degradation', CASE WHEN gx IS NULL THEN 'abstain' WHEN gx >= 0 THEN 'pass' ELSE 'fail' END, round(gx, 6) FROM s
    UNION ALL SELECT 'cost', CASE WHEN c <= 1000 THEN 'pass' ELSE 'fail' END, round(c, 6) FROM s""")
def m12(t):
    def metrics(coder):
        split = (F.when(F.col("toxic") == 1, "other").when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", "in")
                 .otherwise("out"))
        return t.coders.groupBy(split.alias("split")).agg(
            F.avg(F.when(F.col(coder) == F.col("c1"), 1.0).otherwise(0.0)).alias("metric"),
            (F.count("*") / 1000.0).alias("cost")).withColumn("slice", F.lit("all"))
    return G.accept_fix(metrics("c2"), metrics("c3"), 1000.0).select("gate", "status", F.round("observed", 6).alias("observed"))


@query("l2_user_checks", """SELECT 'no_negative_price' AS gate, CASE WHEN count(*) FILTER (o_totalprice < 0) = 0 THEN 'pass' ELSE 'fail' END AS status,
    CAST(count(*) FILTER (o_totalprice < 0) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS expected FROM {orders}
    UNION ALL SELECT 'mostly_finished', CASE WHEN avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) > 0.5 THEN 'pass' ELSE 'fail' END,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6), 0.5 FROM {orders}""")
def l2(t):
    def no_negative(df):
        g = df.agg(F.count_if(F.col("o_totalprice") < 0).alias("x"))
        return g.select(F.when(F.col("x") == 0, "pass").otherwise("fail").alias("status"), F.col("x").alias("observed"),
                        F.lit(0).alias("expected"), F.lit("negative prices").alias("message"))

    def mostly_finished(df):
        g = df.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("x"))
        return g.select(F.when(F.col("x") > 0.5, "pass").otherwise("fail").alias("status"), F.round("x", 6).alias("observed"),
                        F.lit(0.5).alias("expected"), F.lit("too few finished").alias("message"))

    return G.run_gates(t.orders, {"no_negative_price": no_negative, "mostly_finished": mostly_finished}).select(*FOUR)


@query("l3_group_statistic", """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m FROM {lineitem} GROUP BY 1)
    SELECT l.l_suppkey, count(*) AS n, round(max(abs(l_quantity - m)), 6) AS max_dev, round(avg(abs(l_quantity - m)), 6) AS mean_abs_dev
    FROM {lineitem} l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY 1""")
def l3(t):
    # two aggregates and a join; no user function is needed
    means = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    d = join_null_safe(t.lineitem.select("l_suppkey", "l_quantity"), means, ["l_suppkey"]).withColumn("d", F.abs(F.col("l_quantity") - F.col("m")))
    return d.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.max("d"), 6).alias("max_dev"), F.round(F.avg("d"), 6).alias("mean_abs_dev"))
