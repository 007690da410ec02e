"""Registered queries: column profiling and data quality."""

from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.operators import quality as Q
from plumbline.plans.registry import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
NUMS = ", ".join(str(x) for x in P.SENTINEL_NUMBERS)
STRS = ", ".join("'" + s.replace("'", "''") + "'" for s in P.SENTINEL_STRINGS)
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(cols, template, sep=" UNION ALL "):
    return sep.join(template.replace("@", c) for c in cols)


@query("d1_shape_and_keys", """
    WITH g AS (SELECT count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber)
    SELECT 'rows' AS metric, CAST((SELECT count(*) FROM {lineitem}) AS DOUBLE) AS value, 'info' AS status, '' AS note
    UNION ALL SELECT 'columns', 11, 'info', '' UNION ALL SELECT 'distinct_keys', (SELECT count(*) FROM g), 'info', ''
    UNION ALL SELECT 'duplicate_rows', (SELECT sum(n - 1) FROM g), CASE WHEN (SELECT sum(n - 1) FROM g) > 0 THEN 'fail' ELSE 'pass' END, ''""")
def d1(t):
    return P.shape_and_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d2_minimal_key_single", """
    SELECT 1 AS size, c AS columns FROM (SELECT 'o_orderkey' AS c, count(*) = count(DISTINCT o_orderkey) AS u FROM {orders}
      UNION ALL SELECT 'o_custkey', count(*) = count(DISTINCT o_custkey) FROM {orders}
      UNION ALL SELECT 'o_totalprice', count(*) = count(DISTINCT o_totalprice) FROM {orders}
      UNION ALL SELECT 'o_orderdate', count(*) = count(DISTINCT o_orderdate) FROM {orders}) q WHERE u""")
def d2(t):
    return P.find_minimal_key(t.orders)


@query("d2_minimal_key_lineitem")
def d2b(t):
    return P.find_minimal_key(t.lineitem)


EVC = ["event_id", "ts", "user_id", "event_type", "props", "value"]


@query("d3_missingness", _each(EVC, """SELECT '@' AS "column", count(*) FILTER (@ IS NULL) AS n_missing,
    CAST(count(*) FILTER (@ IS NULL) AS DOUBLE) / count(*) AS share FROM {ev_nulls}"""))
def d3(t):
    return P.missingness(t.ev_nulls)


@query("d4_differential_missingness", """
    WITH l AS (SELECT event_type AS level, count(*) AS n, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS r FROM {ev_nulls} GROUP BY 1)
    SELECT 'event_type' AS "group", 'value' AS "column", level, n, round(r, 6) AS missing_rate,
      round((SELECT max(r) - min(r) FROM l), 6) AS spread FROM l WHERE (SELECT max(r) - min(r) FROM l) > 0.02""")
def d4(t):
    return R6(P.differential_missingness(t.ev_nulls, ["event_type"]), "missing_rate", "spread")


@query("d5_fill_by_period", """
    WITH g AS (SELECT event_type, CAST(ts AS DATE) AS period, count(*) AS n, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1 END) AS fill
      FROM {ev_nulls} GROUP BY 1, 2)
    SELECT event_type, period, n, round(fill, 6) AS fill,
      round(fill - lag(fill) OVER (PARTITION BY event_type ORDER BY period), 6) AS change FROM g""")
def d5(t):
    return R6(P.fill_by_period(t.ev_nulls, "value", "event_type", F.to_date("ts")), "fill", "change")


@query("d6_zeros_vs_missing", "SELECT * FROM (" + _each(["event_id", "user_id", "value", "observed"], """
    SELECT '@' AS "column", count(*) FILTER (@ = 0) AS zeros, CAST(count(*) FILTER (@ = 0) AS DOUBLE) / count(*) AS zero_share,
    count(*) FILTER (@ IS NULL) AS missing, CAST(count(*) FILTER (@ IS NULL) AS DOUBLE) / count(*) AS missing_share FROM {ev_obs}""")
    + ") q WHERE zeros + missing > 0")
def d6(t):
    return P.zeros_vs_missing(t.ev_obs)


@query("d7_type_traps", """
    WITH e AS (SELECT event_type, props, CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS big FROM {events})
    SELECT 'event_type' AS "column", bool_and(event_type IN ('True', 'False', '0', '1')) AS boolean_as_text FROM e
    UNION ALL SELECT 'props', bool_and(props IN ('True', 'False', '0', '1')) FROM e
    UNION ALL SELECT 'big', bool_and(big IN ('True', 'False', '0', '1')) FROM e""")
def d7(t):
    return P.type_traps(t.sql("SELECT event_type, props, CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS big FROM {events}"))


_D8 = "SELECT l_discount AS discount_share, l_tax - 0.02 AS tax_pct, l_quantity - 3 AS item_count, l_quantity AS n_items, l_extendedprice AS mean_price FROM {lineitem}"


@query("d8_range_violations", f"WITH e AS ({_D8}) " + _each(["discount_share", "tax_pct"], """
    SELECT '@' AS "column", 'share' AS rule, min(@) AS min, max(@) AS max, count(*) FILTER (@ < 0) AS below,
    count(*) FILTER (@ > 1 + 1e-7) AS above, CASE WHEN count(*) FILTER (@ < 0 OR @ > 1 + 1e-7) > 0 THEN 'fail' ELSE 'pass' END AS status FROM e""")
    + " UNION ALL " + _each(["item_count", "n_items"], """SELECT '@', 'count', min(@), max(@), count(*) FILTER (@ < 0), 0,
    CASE WHEN count(*) FILTER (@ < 0) > 0 THEN 'fail' ELSE 'pass' END FROM e"""))
def d8(t):
    return P.range_violations(t.sql(_D8))


@query("d9_distribution_summary", "WITH s AS (" + _each(["o_totalprice"], """
    SELECT '@' AS "column", @ AS v FROM {orders}""") + " UNION ALL " + _each(["l_quantity", "l_extendedprice", "l_discount"],
    "SELECT '@' AS \"column\", @ AS v FROM {lineitem}") + """),
    b AS (SELECT "column", count(*) AS n, median(v) AS median, max(v) AS max, skewness(v) AS skew, sum(v) AS total, min(v) AS lo FROM s GROUP BY 1),
    r AS (SELECT s."column", v, row_number() OVER (PARTITION BY s."column" ORDER BY v DESC) AS rn FROM s),
    m AS (SELECT r."column", sum(v) AS top FROM r JOIN b ON r."column" = b."column" WHERE rn <= greatest(1, n // 100) GROUP BY 1)
    SELECT b."column", n, median, max, round(CASE WHEN median > 0 THEN max / median END, 6) AS max_over_median, round(skew, 6) AS skew,
      CAST(greatest(1, n // 100) AS BIGINT) AS n_top, round(top / total, 6) AS top_mass,
      abs(skew) > 2 OR coalesce(CASE WHEN median > 0 THEN max / median END > 20, false) AS heavy
    FROM b JOIN m ON b."column" = m."column" """)
def d9(t):
    a = P.distribution_summary(t.orders, ["o_totalprice"])
    b = P.distribution_summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return R6(a.unionByName(b), "max_over_median", "skew", "top_mass")


def _denom_case(rate, num):
    cands = ["n_lines", "n_items", "n_returned", "n_disc", "qty"]
    whens = " ".join(f"WHEN count(*) FILTER ({c} > 0) >= 10 AND max(CASE WHEN {c} > 0 THEN abs({num} / {c} - {rate}) END) < 1e-9 "
                     f"AND count(DISTINCT {c}) > 10 THEN '{c}'" for c in cands)
    return f"SELECT '{rate}' AS rate, '{num}' AS numerator, CASE {whens} END AS denominator FROM {{rates}}"


@query("d10_denominators", "WITH d AS (" + _denom_case("n_returned_rate", "n_returned") + " UNION ALL "
       + _denom_case("n_disc_rate", "n_disc") + " UNION ALL " + _denom_case("qty_per", "qty")
       + ") SELECT rate, numerator, denominator, CAST((SELECT count(DISTINCT denominator) FROM d) AS INT) AS n_denominators FROM d")
def d10(t):
    return P.denominators(t.rates)


@query("d11_numeric_sentinels", "SELECT \"column\", value, n, n / CAST((SELECT count(*) FROM {li_sent}) AS DOUBLE) AS share FROM (" + _each(
    ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"],
    f"SELECT '@' AS \"column\", CAST(@ AS DOUBLE) AS value, count(*) AS n FROM {{li_sent}} WHERE @ IN ({NUMS}) GROUP BY 2") + ") q")
def d11(t):
    return P.numeric_sentinels(t.li_sent)


@query("d12_string_sentinels", f"""SELECT "column", value, n, n / CAST((SELECT count(*) FROM {{ord_sent}}) AS DOUBLE) AS share FROM (
    SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM {{ord_sent}} WHERE o_orderpriority IN ({STRS}) GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM {{ord_sent}} WHERE o_orderstatus IN ({STRS}) GROUP BY 2) q""")
def d12(t):
    return P.string_sentinels(t.ord_sent)


@query("d13_date_sentinels", "SELECT 'o_day' AS \"column\", o_day AS value, count(*) AS n FROM {ord_dates} WHERE o_day IN ("
       + ", ".join(f"DATE '{d}'" for d in P.SENTINEL_DATES) + ") GROUP BY 2")
def d13(t):
    return P.date_sentinels(t.ord_dates)


_D14 = "SELECT CASE WHEN o_orderkey % 20 = 0 THEN 1099.0 ELSE o_totalprice END AS price, CAST(o_custkey AS DOUBLE) AS cust FROM {orders}"


@query("d14_value_spikes", f"""WITH e AS ({_D14}), l AS (SELECT 'price' AS "column", price AS value FROM e UNION ALL SELECT 'cust', cust FROM e),
    c AS (SELECT "column", value, count(*) AS c FROM l GROUP BY 1, 2),
    s AS (SELECT "column", sum(c) AS n, count(*) AS d, median(c) AS med, min(value) AS lo, max(value) AS hi FROM c GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY c DESC, value) AS rn FROM c)
    SELECT t."column", t.value, t.c AS n, round(t.c / CAST(s.n AS DOUBLE), 6) AS share, round(med / CAST(s.n AS DOUBLE), 6) AS median_share
    FROM t JOIN s ON t."column" = s."column" WHERE rn = 1 AND d > 3 AND t.c / CAST(s.n AS DOUBLE) > 0.01 AND t.c > 25 * med
      AND (abs(value) IN (1, 9, 99, 999, 9999, 99999) OR (abs(value) >= 100 AND abs(value) % 100 = 99) OR value = lo OR value = hi)
      AND value NOT IN ({NUMS})""")
def d14(t):
    return R6(P.value_spikes(t.sql(_D14)), "share", "median_share")


_D15 = "SELECT event_type, CASE WHEN event_id % 500 = 0 THEN 'Kind' ELSE event_type END AS kind, props FROM {events}"


@query("d15_header_leaks", f"WITH e AS ({_D15}) SELECT 'kind' AS \"column\", count(*) FILTER (lower(kind) = 'kind') AS n FROM e HAVING count(*) FILTER (lower(kind) = 'kind') > 0")
def d15(t):
    return P.header_leaks(t.sql(_D15))


_D16 = "SELECT l_returnflag, CASE WHEN l_returnflag = 'R' AND l_orderkey % 10 = 0 THEN -999.0 ELSE l_extendedprice END AS price, l_discount FROM {lineitem}"


@query("d16_sentinel_share_by_group", f"""WITH e AS ({_D16}), l AS (SELECT l_returnflag AS level, count(*) AS n,
    avg(CASE WHEN price IN ({NUMS}) THEN 1.0 ELSE 0 END) AS r FROM e GROUP BY 1)
    SELECT 'l_returnflag' AS "group", 'price' AS "column", level, n, round(r, 6) AS sentinel_share,
    round((SELECT max(r) - min(r) FROM l), 6) AS spread FROM l WHERE (SELECT max(r) - min(r) FROM l) > 0.02""")
def d16(t):
    return R6(P.sentinel_share_by_group(t.sql(_D16), ["l_returnflag"]), "sentinel_share", "spread")


@query("d17_value_counts", """WITH l AS (SELECT 'event_type' AS "column", event_type AS value FROM {ev_nulls}
      UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM {ev_nulls}),
    v AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM v)
    SELECT "column", value, n, n / CAST((SELECT count(*) FROM {ev_nulls}) AS DOUBLE) AS share, 'value' AS kind FROM r WHERE rn <= 12
    UNION ALL SELECT 'event_id', NULL, count(*), 1.0, 'near_unique' FROM {ev_nulls}""")
def d17(t):
    return P.value_counts(t.ev_nulls, cols=["event_id", "event_type", "user_id"])


@query("d18_numeric_range", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS value FROM {{lineitem}}"
    for c in ("l_quantity", "l_extendedprice") for p in P.RANGE_PROBS))
def d18(t):
    return R6(P.numeric_range(t.lineitem, ["l_quantity", "l_extendedprice"]), "value")


@query("d18_extreme_values", """WITH l AS (SELECT DISTINCT 'l_quantity' AS "column", l_quantity AS value FROM {lineitem}
      UNION SELECT DISTINCT 'l_extendedprice', l_extendedprice FROM {lineitem}),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS lo,
      row_number() OVER (PARTITION BY "column" ORDER BY value DESC) AS hi FROM l)
    SELECT "column", 'low' AS side, CAST(lo AS INT) AS rank, value FROM r WHERE lo <= 5
    UNION ALL SELECT "column", 'high', CAST(hi AS INT), value FROM r WHERE hi <= 5""")
def d18b(t):
    return P.extreme_values(t.lineitem, ["l_quantity", "l_extendedprice"])


@query("d19_last_digits", """WITH l AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM {li_sent}
      UNION ALL SELECT 'l_orderkey', CAST(l_orderkey AS DOUBLE) FROM {li_sent}),
    w AS (SELECT *, v = floor(v) AND abs(v) < 1e15 AS whole FROM l),
    s AS (SELECT "column", count(*) AS n, count(*) FILTER (whole) AS n_int, count(DISTINCT v) FILTER (whole) AS d FROM w GROUP BY 1),
    g AS (SELECT "column", CAST(abs(v) % 10 AS INT) AS digit, count(*) AS n FROM w WHERE whole GROUP BY 1, 2)
    SELECT g."column", digit, g.n, round(g.n / CAST(n_int AS DOUBLE), 6) AS share, round(n_int / CAST(s.n AS DOUBLE), 6) AS int_share,
      g.n / CAST(n_int AS DOUBLE) > 0.25 AND n_int / CAST(s.n AS DOUBLE) > 0.5 AS flag
    FROM g JOIN s ON g."column" = s."column" WHERE n_int > 100 AND d >= 10""")
def d19(t):
    return R6(P.last_digits(t.li_sent, ["l_quantity", "l_orderkey"]), "share", "int_share")


_D20 = """SELECT CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 7 = 0 THEN p_name || ' ' ELSE p_name END AS p_name,
    lpad(CAST(p_size AS VARCHAR(9)), 4, '0') AS code, p_brand FROM {part}"""


@query("d20_string_hygiene", f"WITH e AS ({_D20}) " + _each(["p_name", "code", "p_brand"], """
    SELECT '@' AS "column", count(DISTINCT @) AS n_raw, count(DISTINCT lower(trim(regexp_replace(@, '\\s+', ' ', 'g')))) AS n_normal,
      count(DISTINCT @) - count(DISTINCT lower(trim(regexp_replace(@, '\\s+', ' ', 'g')))) AS n_spurious,
      coalesce((SELECT n FROM (SELECT length(@) AS len, count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC LIMIT 2) q ORDER BY n LIMIT 1)
        / CAST(count(*) AS DOUBLE) > 0.15 AND count(DISTINCT length(@)) > 1, false) AS two_lengths,
      bool_or(@ LIKE '0%') AND bool_and(regexp_matches(@, '^[0-9]+$')) AS keep_as_text FROM e"""))
def d20(t):
    return P.string_hygiene(t.sql(_D20))


@query("d21_coverage", "WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN value END AS late FROM {events}) "
       + _each(["user_id", "late"], """SELECT '@' AS "column", min(CASE WHEN @ IS NOT NULL THEN d END) AS first, max(CASE WHEN @ IS NOT NULL THEN d END) AS last,
    count(DISTINCT CASE WHEN @ IS NOT NULL THEN d END) AS periods, count(DISTINCT d) AS "of",
    count(DISTINCT CASE WHEN @ IS NOT NULL THEN d END) < count(DISTINCT d) AS partial FROM e"""))
def d21(t):
    e = t.events.withColumn("late", F.when(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"), F.col("value")))
    return P.coverage(e, F.to_date("ts"), ["user_id", "late"])


_D22 = """WITH u AS (SELECT user_id, count(DISTINCT @) AS v FROM {panel} GROUP BY 1)
    SELECT count(*) AS n_units, count(*) FILTER (v > 1) AS n_switchers, CASE WHEN count(*) FILTER (v > 1) = 0 THEN 'none'
    WHEN count(*) FILTER (v > 1) < 0.05 * count(*) THEN 'few' ELSE 'switchers' END AS verdict FROM u"""


@query("d22_panel_switchers", _D22.replace("@", "treat"))
def d22(t):
    return P.panel_structure(t.panel, "user_id", "treat")


@query("d22_panel_no_switchers", _D22.replace("@", "fixed"))
def d22b(t):
    return P.panel_structure(t.panel, "user_id", "fixed")


@query("d23_assignment_levels", """SELECT 'site' AS "column", count(*) AS n_groups, count(*) FILTER (b <> 0) AS n_treated
    FROM (SELECT site, min(fixed) AS a, max(fixed) AS b FROM {panel} GROUP BY 1) q HAVING bool_and(a = b)""")
def d23(t):
    return P.assignment_levels(t.panel, "fixed", skip=["user_id", "day"])


@query("d24_adoption_cohorts", """WITH f AS (SELECT user_id, min(CASE WHEN treat <> 0 THEN day END) AS first FROM {panel} GROUP BY 1)
    SELECT first, count(*) AS n_units, (SELECT count(DISTINCT first) > 1 FROM f) AS staggered FROM f WHERE first IS NOT NULL GROUP BY 1""")
def d24(t):
    return P.adoption_cohorts(t.panel, "user_id", "day", "treat")


@query("d25_dictionary")
def d25(t):
    return P.dictionary(t.li_sent)


_D26 = "SELECT o_orderkey, o_custkey, o_orderkey AS ref_key, o_orderpriority, o_orderstatus, o_orderstatus AS state FROM {orders}"


@query("d26_equal_columns", f"WITH e AS ({_D26}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} = {b}) AS n_same, count(*) AS n, bool_and({a} = {b}) AS identical FROM e"
    for a, b in [("o_orderkey", "o_custkey"), ("o_orderkey", "ref_key"), ("o_custkey", "ref_key"), ("o_orderpriority", "o_orderstatus"),
                 ("o_orderpriority", "state"), ("o_orderstatus", "state")]))
def d26(t):
    return Q.equal_columns(t.sql(_D26))


_D27 = "SELECT o_orderstatus AS feed, CASE WHEN o_orderstatus = 'P' THEN make_date(year(o_orderdate), month(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS d FROM {orders}"


@query("d27_date_part_ambiguity", f"""WITH e AS ({_D27}) SELECT feed, count(*) AS n, CAST(max(day(d)) AS INT) AS max_day, CAST(max(month(d)) AS INT) AS max_month,
    max(day(d)) <= 12 AS ambiguous FROM e GROUP BY 1""")
def d27(t):
    return Q.date_part_ambiguity(t.sql(_D27), "d", "feed")


@query("d28_control_totals", """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM {lineitem} GROUP BY 1),
    j AS (SELECT o_totalprice AS tot, s FROM {orders} LEFT JOIN s ON o_orderkey = l_orderkey)
    SELECT CASE WHEN s IS NULL THEN 'no parts' WHEN abs(s - tot) <= 0.005 THEN 'reconciles' WHEN s > tot THEN 'parts exceed' ELSE 'total exceeds' END AS outcome,
    count(*) AS n, round(max(abs(s - tot)), 4) AS max_abs_residual FROM j GROUP BY 1""")
def d28(t):
    r = Q.control_totals(t.lineitem, t.orders, "l_orderkey", "o_orderkey", F.col("l_extendedprice"), "o_totalprice")
    return r.withColumn("max_abs_residual", F.round("max_abs_residual", 4))


@query("d29_rule_violations", """SELECT 'ship_after_order' AS rule, count(*) FILTER (NOT l_shipdate > o_orderdate) AS n_violations,
    count(*) FILTER ((l_shipdate > o_orderdate) IS NULL) AS n_unknown FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    UNION ALL SELECT 'discount_below_tax', count(*) FILTER (NOT l_discount <= l_tax), 0 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""")
def d29(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.rule_violations(j, {"ship_after_order": F.col("l_shipdate") > F.col("o_orderdate"),
                                 "discount_below_tax": F.col("l_discount") <= F.col("l_tax")})


PRIORITY = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "middle", "5-LOW": "low"}
_CASE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'middle' WHEN '5-LOW' THEN 'low' END"


@query("b11_recode", f"SELECT o_orderkey, o_orderpriority, {_CASE} AS level FROM {{ord_sent}}")
def b11(t):
    return Q.recode(t.ord_sent, "o_orderpriority", PRIORITY, "level").select("o_orderkey", "o_orderpriority", "level")


@query("d30_recode_crosstab", f"SELECT o_orderpriority, {_CASE} AS level, count(*) AS n FROM {{ord_sent}} GROUP BY 1, 2")
def d30(t):
    return Q.recode_crosstab(Q.recode(t.ord_sent, "o_orderpriority", PRIORITY, "level"), "o_orderpriority", "level")


@query("d31_recode_conservation", f"""SELECT count(*) FILTER (o_orderpriority IS NULL) AS nulls_before, count(*) FILTER ({_CASE} IS NULL) AS nulls_after,
    count(DISTINCT CASE WHEN {_CASE} IS NULL THEN o_orderpriority END) AS unmatched_levels,
    CASE WHEN count(*) FILTER ({_CASE} IS NULL) = count(*) FILTER (o_orderpriority IS NULL) THEN 'pass' ELSE 'fail' END AS status FROM {{ord_sent}}""")
def d31(t):
    return Q.recode_conservation(Q.recode(t.ord_sent, "o_orderpriority", PRIORITY, "level"), "o_orderpriority", "level")


@query("d31_unmatched_levels", f"SELECT o_orderpriority, count(*) AS n FROM {{ord_sent}} WHERE {_CASE} IS NULL GROUP BY 1")
def d31b(t):
    return Q.unmatched_levels(Q.recode(t.ord_sent, "o_orderpriority", PRIORITY, "level"), "o_orderpriority", "level")


@query("d32_winsor_report", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM {lineitem})
    SELECT count(l_extendedprice) AS n, count(*) FILTER (l_extendedprice < lo) AS n_raised, count(*) FILTER (l_extendedprice > hi) AS n_lowered,
      round(avg(l_extendedprice), 4) AS mean_raw, round(avg(least(greatest(l_extendedprice, lo), hi)), 4) AS mean_winsorised,
      round(avg(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END), 4) AS mean_trimmed,
      count(*) FILTER (l_extendedprice BETWEEN lo AND hi) AS n_trimmed FROM {lineitem}, q""")
def d32(t):
    return Q.winsor_report(t.lineitem, "l_extendedprice", 0.05, 0.95).withColumns(
        {c: F.round(c, 4) for c in ("mean_raw", "mean_winsorised", "mean_trimmed")})


@query("d33_standardise", """WITH r AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {arms} WHERE arm = 0)
    SELECT event_type, count(value) AS n, round((avg(value) - any_value(m)) / any_value(s), 6) AS z FROM {arms}, r GROUP BY 1""")
def d33(t):
    return R6(Q.standardise(t.arms, "value", F.col("arm") == 0, "event_type"), "z")


@query("d34_ratio_means", """WITH u AS (SELECT l_orderkey, sum(l_discount) AS a, sum(l_tax) AS b FROM {lineitem} GROUP BY 1),
    r AS (SELECT *, CASE WHEN b <> 0 THEN a / b END AS r FROM u)
    SELECT count(*) AS n_units, count(*) FILTER (r IS NULL) AS n_undefined, round(avg(r), 6) AS mean_of_ratios, round(sum(a) / sum(b), 6) AS ratio_of_means,
      round(sum(r * b) / sum(CASE WHEN r IS NOT NULL THEN b END), 6) AS weighted_mean_of_ratios FROM r""")
def d34(t):
    return R6(Q.ratio_means(t.lineitem, "l_orderkey", "l_discount", "l_tax"), "mean_of_ratios", "ratio_of_means", "weighted_mean_of_ratios")


@query("d35_joint_shares", """WITH s AS (SELECT avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN l_discount > 0.03 THEN 1.0 ELSE 0 END) AS b,
      avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS c,
      avg(CASE WHEN l_quantity > 25 AND l_discount > 0.03 AND l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS j FROM {lineitem})
    SELECT 'large' AS flag, round(a, 6) AS share, a >= j AS bounds_joint FROM s UNION ALL SELECT 'discounted', round(b, 6), b >= j FROM s
    UNION ALL SELECT 'returned', round(c, 6), c >= j FROM s UNION ALL SELECT 'all', round(j, 6), j <= least(a, b, c) FROM s""")
def d35(t):
    return R6(Q.joint_shares(t.lineitem, {"large": F.col("l_quantity") > 25, "discounted": F.col("l_discount") > 0.03,
                                          "returned": F.col("l_returnflag") == "R"}), "share")


@query("d36_aggregation_reversal", """WITH g AS (SELECT avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM {lineitem} GROUP BY l_partkey),
    a AS (SELECT regr_slope(l_extendedprice, l_quantity) AS rs, corr(l_quantity, l_extendedprice) AS rc FROM {lineitem}),
    b AS (SELECT regr_slope(y, x) AS gs, corr(x, y) AS gc FROM g)
    SELECT round(rs, 6) AS row_slope, round(rc, 6) AS row_corr, round(gs, 6) AS group_slope, round(gc, 6) AS group_corr, rs * gs < 0 AS reverses FROM a, b""")
def d36(t):
    return R6(Q.aggregation_reversal(t.lineitem, "l_quantity", "l_extendedprice", "l_partkey"),
              "row_slope", "row_corr", "group_slope", "group_corr")


@query("d37_small_denominators", "WITH u AS (SELECT o_custkey, count(*) AS d, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS r FROM {orders} GROUP BY 1) "
       + " UNION ALL ".join(f"SELECT {k} AS threshold, count(*) AS n_units, count(*) FILTER (d < {k}) AS n_below, round(avg(r), 6) AS mean_all, "
                            f"round(avg(CASE WHEN d >= {k} THEN r END), 6) AS mean_kept FROM u" for k in (3, 5, 10)))
def d37(t):
    return R6(Q.small_denominators(t.orders, "o_custkey", (F.col("o_orderstatus") == "F").cast("double"), [3, 5, 10]), "mean_all", "mean_kept")


@query("d38_model_rows", """WITH c AS (SELECT count(*) FILTER (value IS NOT NULL) AS a, count(*) FILTER (value IS NOT NULL AND user_id IS NOT NULL) AS b,
      count(*) FILTER (user_id IS NOT NULL) AS d FROM {ev_nulls})
    SELECT 'outcome' AS model, a AS n, greatest(a, b, d) - a AS lost FROM c UNION ALL SELECT 'outcome_user', b, greatest(a, b, d) - b FROM c
    UNION ALL SELECT 'user', d, greatest(a, b, d) - d FROM c""")
def d38(t):
    return Q.row_counts_by_model(t.ev_nulls, {"outcome": ["value"], "outcome_user": ["value", "user_id"], "user": ["user_id"]})


@query("d39_complete_case_report", """SELECT 'event_id' AS "column", count(*) FILTER (value IS NOT NULL) AS n_kept, count(*) FILTER (value IS NULL) AS n_dropped,
    round(avg(event_id) FILTER (value IS NOT NULL), 6) AS mean_kept, round(avg(event_id) FILTER (value IS NULL), 6) AS mean_dropped,
    round((avg(event_id) FILTER (value IS NOT NULL) - avg(event_id) FILTER (value IS NULL)) / stddev_samp(event_id), 6) AS std_diff FROM {ev_nulls}
    UNION ALL SELECT 'user_id', count(*) FILTER (value IS NOT NULL), count(*) FILTER (value IS NULL),
    round(avg(user_id) FILTER (value IS NOT NULL), 6), round(avg(user_id) FILTER (value IS NULL), 6),
    round((avg(user_id) FILTER (value IS NOT NULL) - avg(user_id) FILTER (value IS NULL)) / stddev_samp(user_id), 6) FROM {ev_nulls}""")
def d39(t):
    return R6(Q.complete_case_report(t.ev_nulls, ["value"], ["event_id", "user_id"]), "mean_kept", "mean_dropped", "std_diff")


@query("d40_missing_policies", """SELECT event_type, 'complete_case' AS policy, count(value) AS n, round(avg(value), 6) AS mean, 0.0::DOUBLE AS imputed_share FROM {ev_nulls} GROUP BY 1
    UNION ALL SELECT event_type, 'indicator_and_constant', count(*), round(avg(coalesce(value, 0.0)), 6), round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6)
    FROM {ev_nulls} GROUP BY 1""")
def d40(t):
    return R6(Q.missing_policies(t.ev_nulls, "value", "event_type"), "mean", "imputed_share")


@query("d41_binned_means", "WITH b AS (SELECT l_extendedprice AS x, l_quantity AS y, 1" + "".join(
    f" + CAST(l_extendedprice > (SELECT quantile_cont(l_extendedprice, {i / 10}) FROM {{lineitem}}) AS INT)" for i in range(1, 10))
    + """ AS bin FROM {lineitem}) SELECT bin, count(*) AS n, round(avg(x), 4) AS x_mean, round(avg(y), 6) AS y_mean,
    round(avg(y) - 1.959964 * stddev_samp(y) / sqrt(count(*)), 6) AS y_lo, round(avg(y) + 1.959964 * stddev_samp(y) / sqrt(count(*)), 6) AS y_hi FROM b GROUP BY 1""")
def d41(t):
    return R6(Q.binned_means(t.lineitem, "l_extendedprice", "l_quantity", 10), "y_mean", "y_lo", "y_hi").withColumn("x_mean", F.round("x_mean", 4))


@query("d42_density_2d", "SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS ix, CAST(floor(l_extendedprice / 10000.0) AS BIGINT) AS iy, count(*) AS n FROM {lineitem} GROUP BY 1, 2")
def d42(t):
    return Q.density_2d(t.lineitem, "l_quantity", "l_extendedprice", 5.0, 10000.0)


_D43 = "SELECT least(l_extendedprice, 60000.0) AS price, l_quantity AS qty FROM {lineitem}"


@query("d43_boundary_mass", f"WITH e AS ({_D43}) " + _each(["price", "qty"], """SELECT '@' AS "column", max(@) AS max,
    count(*) FILTER (@ = (SELECT max(@) FROM e)) AS n_at_max, round(count(*) FILTER (@ = (SELECT max(@) FROM e)) / CAST(count(*) AS DOUBLE), 6) AS share,
    round(max(@) - max(CASE WHEN @ < (SELECT max(@) FROM e) THEN @ END), 6) AS gap FROM e"""))
def d43(t):
    return R6(Q.boundary_mass(t.sql(_D43)), "share", "gap")


@query("d43_width_limit", """SELECT 'url' AS "column", CAST(max(length(url)) AS INT) AS width, count(*) FILTER (length(url) = (SELECT max(length(url)) FROM {pages})) AS n_at_width,
    count(*) AS n, round(count(*) FILTER (length(url) = (SELECT max(length(url)) FROM {pages})) / CAST(count(*) AS DOUBLE), 6) AS share FROM {pages}""")
def d43b(t):
    return R6(Q.width_limit(t.pages, ["url"]), "share")


@query("d44_share_stability", """WITH g AS (SELECT l_returnflag, avg(CASE WHEN l_quantity = -999 THEN 1.0 ELSE 0 END) AS a,
      avg(CASE WHEN l_quantity = 999 THEN 1.0 ELSE 0 END) AS b FROM {li_sent} GROUP BY 1)
    SELECT -999.0::DOUBLE AS value, count(*) AS n_groups, count(*) FILTER (a > 0) AS groups_with, round(avg(a), 6) AS mean_share, round(stddev_pop(a), 6) AS sd_share,
      count(*) FILTER (a > 0) = 1 AS one_group_only FROM g
    UNION ALL SELECT 999.0, count(*), count(*) FILTER (b > 0), round(avg(b), 6), round(stddev_pop(b), 6), count(*) FILTER (b > 0) = 1 FROM g""")
def d44(t):
    return R6(Q.share_stability(t.li_sent, "l_quantity", [-999, 999], "l_returnflag"), "mean_share", "sd_share")


@query("d45_delimiter_leaks", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{d}' AS delimiter, count(*) FILTER (contains({c}, '{d}')) AS n FROM {{documents}}"
    for c in ("text", "lang", "source") for d in (",", ";", "|")) + ") q WHERE n > 0")
def d45(t):
    return Q.delimiter_leaks(t.documents, (",", ";", "|"))


@query("d46_preview")
def d46(t):
    return Q.preview(t.orders, "o_orderkey")
