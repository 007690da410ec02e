"""Registered queries: joins and join contracts."""

from pyspark.sql import functions as F

from plumbline.operators import contract as C
from plumbline.operators.contract import JoinContract
from plumbline.plans.registry import query, sql_query

ORDERS_CUST = JoinContract(["o_custkey"], ["k"], min_match=0.9, groups=["o_orderpriority", "o_orderstatus"])
LINE_ORDERS = JoinContract(["l_orderkey"], ["o_orderkey"], groups=["l_returnflag"], min_match=0.95)

sql_query("c1_joins", """
    SELECT n_name, c_mktsegment, count(o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_cust,
           round(coalesce(sum(o_totalprice), 0), 2) AS total
    FROM {nation} LEFT JOIN {customer} ON n_nationkey = c_nationkey
    LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY n_name, c_mktsegment""")

sql_query("c1_full_outer", """
    SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(k) AS n_right, count(o_orderkey) AS n_left
    FROM {orders} FULL OUTER JOIN {cust_miss} ON o_custkey = k GROUP BY c_mktsegment, o_orderpriority""")

sql_query("c1_right_cross", """
    SELECT r_name, n_name, count(s_suppkey) AS n_supp FROM {supplier} RIGHT JOIN
      (SELECT r_name, n_name, n_nationkey FROM {region} CROSS JOIN {nation} WHERE r_regionkey = n_regionkey) q
      ON s_nationkey = n_nationkey GROUP BY r_name, n_name""")

sql_query("c2_subqueries", """
    SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM {customer} c
    WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT')
      AND EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
      AND c_acctbal > (SELECT avg(c2.c_acctbal) FROM {customer} c2 WHERE c2.c_nationkey = c.c_nationkey)
    GROUP BY c_mktsegment""".replace("{customer} c\n", "{customer} AS c\n"))


@query("c3_key_uniqueness", """
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicate
    FROM (SELECT count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber) q""")
def c3(t):
    return C.key_uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("c3_duplicate_examples", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1
    ORDER BY 1, 2 LIMIT 6""")
def c3b(t):
    return C.duplicate_examples(t.lineitem, ["l_orderkey", "l_linenumber"])


_COUNTS = """
    lc AS (SELECT {lk} AS k, count(*) AS nl FROM {lt} GROUP BY 1),
    rc AS (SELECT {rk} AS k, count(*) AS nr FROM {rt} GROUP BY 1),
    j AS (SELECT coalesce(nl, 0) AS nl, coalesce(nr, 0) AS nr FROM lc FULL JOIN rc ON lc.k IS NOT DISTINCT FROM rc.k),
    s AS (SELECT sum(nl) AS left_rows, sum(nr) AS right_rows, sum(nl * nr) AS inner_rows,
      sum(nl * greatest(nr, 1)) AS left_join_rows, sum(greatest(nl - 1, 0)) AS left_dup,
      sum(greatest(nr - 1, 0)) AS right_dup, sum(CASE WHEN nr > 0 THEN nl ELSE 0 END) AS left_matched,
      sum(CASE WHEN nl > 0 THEN nr ELSE 0 END) AS right_matched FROM j)"""


def _counts(lt, lk, rt, rk):
    return _COUNTS.replace("{lk}", lk).replace("{rk}", rk).replace("{lt}", "{" + lt + "}").replace(
        "{rt}", "{" + rt + "}")


OC = _counts("orders", "o_custkey", "cust_miss", "k")
OL = _counts("orders", "o_orderkey", "lineitem", "l_orderkey")


@query("c4_check_join", f"""WITH {OC}
    SELECT 'left_unique' AS "check", CAST(left_dup AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS expected, 'pass' AS status FROM s
    UNION ALL SELECT 'right_unique', CAST(right_dup AS DOUBLE), 0, CASE WHEN right_dup > 0 THEN 'fail' ELSE 'pass' END FROM s
    UNION ALL SELECT 'rows_out', CAST(left_join_rows AS DOUBLE), CAST(left_rows AS DOUBLE),
      CASE WHEN left_join_rows <> left_rows THEN 'fail' ELSE 'pass' END FROM s
    UNION ALL SELECT 'left_rows_dropped', CAST(left_rows - left_matched AS DOUBLE), 0, 'pass' FROM s
    UNION ALL SELECT 'left_match_rate', CAST(left_matched AS DOUBLE) / CAST(left_rows AS DOUBLE), 0.9,
      CASE WHEN CAST(left_matched AS DOUBLE) / CAST(left_rows AS DOUBLE) < 0.9 THEN 'fail' ELSE 'pass' END FROM s
    UNION ALL SELECT 'right_match_rate', CAST(right_matched AS DOUBLE) / CAST(right_rows AS DOUBLE), 0.5, 'pass' FROM s""")
def c4(t):
    return C.check_join(t.orders, t.cust_miss, ORDERS_CUST)


@query("c5_predicted_rows", f"""WITH {OL} SELECT CAST(left_rows AS BIGINT) AS left_rows,
    CAST(right_rows AS BIGINT) AS right_rows, CAST(inner_rows AS BIGINT) AS inner_rows,
    CAST(left_join_rows AS BIGINT) AS left_join_rows FROM s""")
def c5(t):
    return C.predicted_rows(t.orders, t.lineitem, JoinContract(["o_orderkey"], ["l_orderkey"], card="1:m"))


@query("c6_row_conservation", f"""WITH {OL} SELECT CAST(left_rows AS BIGINT) AS left_rows,
    CAST(left_join_rows AS BIGINT) AS rows_out, CAST(left_join_rows - left_rows AS BIGINT) AS excess,
    CAST(left_rows - left_matched AS BIGINT) AS left_unmatched,
    CASE WHEN left_join_rows = left_rows THEN 'pass' ELSE 'fail' END AS status FROM s""")
def c6(t):
    return C.row_conservation(t.orders, t.lineitem, JoinContract(["o_orderkey"], ["l_orderkey"], card="1:1"))


@query("c7_match_rates", f"""WITH {OC} SELECT CAST(left_matched AS BIGINT) AS left_matched,
    CAST(left_rows AS BIGINT) AS left_rows, CAST(left_matched AS DOUBLE) / CAST(left_rows AS DOUBLE) AS left_rate,
    CAST(right_matched AS BIGINT) AS right_matched, CAST(right_rows AS BIGINT) AS right_rows,
    CAST(right_matched AS DOUBLE) / CAST(right_rows AS DOUBLE) AS right_rate,
    CASE WHEN CAST(left_matched AS DOUBLE) / CAST(left_rows AS DOUBLE) < 0.9 THEN 'fail' ELSE 'pass' END AS status,
    CAST(right_matched AS DOUBLE) / CAST(right_rows AS DOUBLE) < 0.5 AS right_mostly_unmatched FROM s""")
def c7(t):
    return C.match_rates(t.orders, t.cust_miss, ORDERS_CUST)


@query("c8_match_rate_by_group", """
    WITH m AS (SELECT o.o_orderpriority, o.o_orderstatus, (o.o_custkey IN (SELECT k FROM {cust_miss})) AS hit FROM {orders} o),
    p AS (SELECT 'o_orderpriority' AS g, o_orderpriority AS level, count(*) AS n,
            CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM m GROUP BY 2
          UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*),
            CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) FROM m GROUP BY 2),
    r AS (SELECT *, CAST(matched AS DOUBLE) / n AS rate FROM p),
    sp AS (SELECT g, max(rate) - min(rate) AS spread FROM r GROUP BY g)
    SELECT r.g AS "group", level, n, matched, rate, spread, spread > 0.02 AS flag FROM r JOIN sp ON r.g = sp.g""")
def c8(t):
    return C.match_rate_by_group(t.orders, t.cust_miss, ORDERS_CUST)


@query("c8_line_orders_by_flag", """
    WITH p AS (SELECT l_returnflag AS level, count(*) AS n, count(o_orderkey) AS matched
      FROM {lineitem} LEFT JOIN (SELECT DISTINCT o_orderkey FROM {orders}) o ON l_orderkey = o_orderkey GROUP BY 1),
    r AS (SELECT *, CAST(matched AS DOUBLE) / n AS rate FROM p)
    SELECT 'l_returnflag' AS "group", level, n, matched, rate, (SELECT max(rate) - min(rate) FROM r) AS spread,
      (SELECT max(rate) - min(rate) FROM r) > 0.02 AS flag FROM r""")
def c8b(t):
    return C.match_rate_by_group(t.lineitem, t.orders, LINE_ORDERS)


@query("c9_unmatched_examples", """
    WITH lk AS (SELECT DISTINCT o_custkey AS k0 FROM {orders}), rk AS (SELECT DISTINCT k AS k0 FROM {cust_miss}),
    o AS (SELECT 'left' AS side, k0 FROM lk WHERE k0 NOT IN (SELECT k0 FROM rk)
          UNION ALL SELECT 'right', k0 FROM rk WHERE k0 NOT IN (SELECT k0 FROM lk)),
    n AS (SELECT side, k0, row_number() OVER (PARTITION BY side ORDER BY k0) AS rn FROM o)
    SELECT side, CAST(rn AS INT) AS rn, k0 FROM n WHERE rn <= 10""")
def c9(t):
    return C.unmatched_keys(t.orders, t.cust_miss, ORDERS_CUST)


@query("c10_key_repairs", """
    WITH lk AS (SELECT DISTINCT k FROM {ord_custkeys}), rk AS (SELECT DISTINCT k FROM {cust_padded}),
    lo AS (SELECT k FROM lk WHERE k NOT IN (SELECT k FROM rk)), ro AS (SELECT k FROM rk WHERE k NOT IN (SELECT k FROM lk)),
    x AS (SELECT 'strip_leading_zeros' AS repair,
            (SELECT count(*) FROM (SELECT regexp_replace(k, '^0+', '') FROM lo INTERSECT SELECT regexp_replace(k, '^0+', '') FROM ro)) AS n
          UNION ALL SELECT 'trim', (SELECT count(*) FROM (SELECT trim(k) FROM lo INTERSECT SELECT trim(k) FROM ro))
          UNION ALL SELECT 'lowercase', (SELECT count(*) FROM (SELECT lower(k) FROM lo INTERSECT SELECT lower(k) FROM ro)))
    SELECT repair, n AS new_matches, n > 0 AS helps FROM x""")
def c10(t):
    return C.key_repairs(t.ord_custkeys, t.cust_padded, "k", "k")


@query("c11_key_guard", """
    SELECT 'c_custkey' AS key, CAST(0 AS BIGINT) AS n_fractional, count(*) FILTER (abs(c_custkey) > 9007199254740992) AS n_too_large,
      CASE WHEN count(*) FILTER (abs(c_custkey) > 9007199254740992) > 0 THEN 'fail' ELSE 'pass' END AS status FROM {customer}
    UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal <> floor(c_acctbal)), count(*) FILTER (abs(c_acctbal) > 9007199254740992),
      CASE WHEN count(*) FILTER (c_acctbal <> floor(c_acctbal) OR abs(c_acctbal) > 9007199254740992) > 0 THEN 'fail' ELSE 'pass' END
    FROM {customer}""")
def c11(t):
    return C.key_guard(t.customer, ["c_custkey", "c_acctbal"])


@query("c12_injective_transform", """
    WITH p AS (SELECT DISTINCT p_name AS a, replace(p_name, ' ', '')[1:6] AS b FROM {part}),
    g AS (SELECT b, count(*) AS n FROM p GROUP BY b)
    SELECT CAST(sum(n) AS BIGINT) AS n_in, count(b) AS n_out, count(*) FILTER (n > 1) AS n_colliding_outputs,
      CAST(sum(n) - count(b) AS BIGINT) AS collisions, CASE WHEN sum(n) <> count(b) THEN 'fail' ELSE 'pass' END AS status FROM g""")
def c12(t):
    return C.injective(t.part, "p_name", F.substring(F.replace("p_name", F.lit(" "), F.lit("")), 1, 6))


@query("c13_post_join_missing", """
    WITH j AS (SELECT r.c_name, r.c_mktsegment FROM {orders} LEFT JOIN {cust_miss} r ON o_custkey = r.k)
    SELECT 'c_name' AS "column", (SELECT avg(CASE WHEN c_name IS NULL THEN 1.0 ELSE 0 END) FROM {cust_miss}) AS missing_before,
      (SELECT CAST(count(*) FILTER (c_name IS NULL) AS DOUBLE) / count(*) FROM j) AS missing_after
    UNION ALL SELECT 'c_mktsegment', (SELECT avg(CASE WHEN c_mktsegment IS NULL THEN 1.0 ELSE 0 END) FROM {cust_miss}),
      (SELECT CAST(count(*) FILTER (c_mktsegment IS NULL) AS DOUBLE) / count(*) FROM j)""")
def c13(t):
    return C.post_join_missing(t.orders, t.cust_miss, ["o_custkey"], ["k"], ["c_name", "c_mktsegment"])


@query("c14_reindex_zero_fill", """
    WITH a AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1)
    SELECT c_custkey, coalesce(n, 0) AS n_orders, n IS NULL AS filled FROM {customer} LEFT JOIN a ON c_custkey = o_custkey""")
def c14(t):
    return C.reindex_counts(t.customer, t.orders, "c_custkey", "o_custkey", "n_orders")


@query("c14_reindex_additive", """
    WITH a AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1)
    SELECT count(*) FILTER (n IS NULL) AS n_added, CAST(0 AS BIGINT) AS n_changed, 'pass' AS status
    FROM {customer} LEFT JOIN a ON c_custkey = o_custkey""")
def c14b(t):
    r = C.reindex_counts(t.customer, t.orders, "c_custkey", "o_custkey", "n_orders")
    return C.reindex_additive(r, t.orders, "c_custkey", "o_custkey", "n_orders")
