"""Registered queries: experiment and panel design, and metric diagnosis."""

from pyspark.sql import functions as F

from plumbline.operators import design as D
from plumbline.operators import gates as G
from plumbline.operators import ladder as L
from plumbline.operators import regress as R
from plumbline.operators import slices as S
from plumbline.operators.contract import key_uniqueness
from plumbline.plans.registry import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
MICROS = lambda: F.unix_micros(F.col("ts").cast("timestamp"))
AFTER = lambda: F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
SQL_AFTER = "(ts >= TIMESTAMP '2024-01-16 00:00:00')"

# ---- design -----------------------------------------------------------------------------------------


@query("o1_balance", """SELECT 'value' AS "column", count(value) FILTER (arm = 0) AS n_control, count(value) FILTER (arm = 1) AS n_treated,
    round(avg(value) FILTER (arm = 0), 6) AS mean_control, round(avg(value) FILTER (arm = 1), 6) AS mean_treated,
    round((avg(value) FILTER (arm = 1) - avg(value) FILTER (arm = 0)) / sqrt((var_samp(value) FILTER (arm = 0) + var_samp(value) FILTER (arm = 1)) / 2), 6) AS std_diff FROM {arms}
    UNION ALL SELECT 'event_id', count(event_id) FILTER (arm = 0), count(event_id) FILTER (arm = 1), round(avg(event_id) FILTER (arm = 0), 6), round(avg(event_id) FILTER (arm = 1), 6),
    round((avg(event_id) FILTER (arm = 1) - avg(event_id) FILTER (arm = 0)) / sqrt((var_samp(event_id) FILTER (arm = 0) + var_samp(event_id) FILTER (arm = 1)) / 2), 6) FROM {arms}""")
def o1(t):
    return R6(D.balance(t.arms, "arm", ["value", "event_id"]), "mean_control", "mean_treated", "std_diff")


@query("o1_balance_clusters", """WITH c AS (SELECT user_id, max(arm) AS arm, avg(value) AS v FROM {arms} GROUP BY 1)
    SELECT 'value' AS "column", count(v) FILTER (arm = 0) AS n_control, count(v) FILTER (arm = 1) AS n_treated, round(avg(v) FILTER (arm = 0), 6) AS mean_control,
    round(avg(v) FILTER (arm = 1), 6) AS mean_treated, round((avg(v) FILTER (arm = 1) - avg(v) FILTER (arm = 0)) / sqrt((var_samp(v) FILTER (arm = 0) + var_samp(v) FILTER (arm = 1)) / 2), 6) AS std_diff FROM c""")
def o1b(t):
    return R6(D.balance(t.arms, "arm", ["value"], "user_id"), "mean_control", "mean_treated", "std_diff")


@query("o2_sample_ratio", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (arm_odd = 1) AS n1, count(*) FILTER (arm_odd = 0) AS n0 FROM {arms})
    SELECT n, round(power(n1 - n / 2.0, 2) / (n / 2.0) + power(n0 - n / 2.0, 2) / (n / 2.0), 6) AS chi2, 1 AS dof,
    CASE WHEN power(n1 - n / 2.0, 2) / (n / 2.0) + power(n0 - n / 2.0, 2) / (n / 2.0) > 10.827566 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def o2(t):
    return D.sample_ratio(t.arms, "arm_odd", {0: 0.5, 1: 0.5}).select("n", F.round("chi2", 6).alias("chi2"), "dof", "status")


@query("o3_attrition", """WITH s AS (SELECT count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1) AS n1, avg(CASE WHEN y IS NULL THEN 0.0 ELSE 1 END) FILTER (arm = 0) AS r0,
      avg(CASE WHEN y IS NULL THEN 0.0 ELSE 1 END) FILTER (arm = 1) AS r1, avg(CASE WHEN y IS NULL THEN 0.0 ELSE 1 END) AS p FROM {arms})
    SELECT round(r0, 6) AS response_control, round(r1, 6) AS response_treated, round(r1 - r0, 6) AS difference, round((r1 - r0) / sqrt(p * (1 - p) * (1.0 / n0 + 1.0 / n1)), 6) AS z FROM s""")
def o3(t):
    return R6(D.attrition(t.arms, "arm", "y").drop("p"), "response_control", "response_treated", "difference", "z")


@query("o3_attrition_bounds", """WITH s AS (SELECT min(y) AS lo, max(y) AS hi, count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1) AS n1, count(y) FILTER (arm = 0) AS c0,
      count(y) FILTER (arm = 1) AS c1, sum(y) FILTER (arm = 0) AS s0, sum(y) FILTER (arm = 1) AS s1 FROM {arms}),
    q AS (SELECT 1 - (c1 / CAST(n1 AS DOUBLE)) / (c0 / CAST(n0 AS DOUBLE)) AS sh FROM s),
    v AS (SELECT list_sort(list(y)) AS l, any_value(sh) * (count(y) - 1) AS pa, (1 - any_value(sh)) * (count(y) - 1) AS pb FROM {arms}, q WHERE arm = 0 AND y IS NOT NULL),
    k AS (SELECT l[CAST(floor(pa) AS INT) + 1] + (pa - floor(pa)) * (l[CAST(ceil(pa) AS INT) + 1] - l[CAST(floor(pa) AS INT) + 1]) AS a,
      l[CAST(floor(pb) AS INT) + 1] + (pb - floor(pb)) * (l[CAST(ceil(pb) AS INT) + 1] - l[CAST(floor(pb) AS INT) + 1]) AS b FROM v),
    m AS (SELECT avg(CASE WHEN y <= b THEN y END) AS low, avg(CASE WHEN y >= a THEN y END) AS high FROM {arms}, k WHERE arm = 0)
    SELECT 'manski' AS method, round((s1 + (n1 - c1) * lo) / n1 - (s0 + (n0 - c0) * hi) / n0, 6) AS lower, round((s1 + (n1 - c1) * hi) / n1 - (s0 + (n0 - c0) * lo) / n0, 6) AS upper FROM s
    UNION ALL SELECT 'lee', round(s1 / c1 - high, 6), round(s1 / c1 - low, 6) FROM s, m""")
def o3b(t):
    return R6(D.attrition_bounds(t.arms, "arm", "y").drop("trimmed_share"), "lower", "upper")


@query("o4_did_2x2", """WITH p AS (SELECT *, user_id % 4 = 1 AS tr, day >= DATE '2024-01-13' AS post FROM {panel})
    SELECT round((avg(y) FILTER (tr AND post) - avg(y) FILTER (tr AND NOT post)) - (avg(y) FILTER (NOT tr AND post) - avg(y) FILTER (NOT tr AND NOT post)), 6) AS estimate FROM p""")
def o4(t):
    r = D.did_2x2(t.panel, "y", F.col("user_id") % 4 == 1, F.col("day") >= F.lit("2024-01-13").cast("date"), "user_id")
    return r.select(F.round("estimate", 6).alias("estimate"))


def _int_panel(t):
    return t.panel.withColumn("period", F.datediff("day", F.lit("2024-01-01").cast("date")))


_ATT = """WITH p AS (SELECT user_id AS u, CAST(day - DATE '2024-01-01' AS INT) AS t, treat AS w, y FROM {panel}),
    un AS (SELECT u, min(CASE WHEN w <> 0 THEN t END) AS g0 FROM p GROUP BY 1), co AS (SELECT DISTINCT g0 AS g FROM un WHERE g0 IS NOT NULL),
    b AS (SELECT u, g, y AS yb FROM p JOIN co ON t = g - 1), d AS (SELECT p.u, p.t, b.g, g0, y - yb AS d FROM p JOIN b ON p.u = b.u JOIN un ON p.u = un.u),
    a AS (SELECT g, t, t - g AS event_time, avg(d) FILTER (g0 = g) - avg(d) FILTER (g0 IS NULL OR (g0 > t AND g0 <> g)) AS att,
      count(*) FILTER (g0 = g) AS n_treated, count(*) FILTER (g0 IS NULL OR (g0 > t AND g0 <> g)) AS n_control FROM d GROUP BY g, t),
    e AS (SELECT * FROM a WHERE n_treated > 0 AND n_control > 0)"""


@query("o5_group_time_effects", _ATT + " SELECT g, t, event_time, round(att, 6) AS att, n_treated, n_control FROM e")
def o5(t):
    return R6(D.group_time_effects(_int_panel(t), "user_id", "period", "treat", "y"), "att")


@query("o5_cohort_effects", _ATT + " SELECT g, round(sum(att * n_treated) / sum(n_treated), 6) AS att, CAST(sum(n_treated) AS BIGINT) AS weight FROM e WHERE event_time >= 0 GROUP BY 1")
def o5b(t):
    return R6(D.aggregate_effects(D.group_time_effects(_int_panel(t), "user_id", "period", "treat", "y"), "g"), "att")


@query("o6_event_study", _ATT + """ SELECT event_time, round(sum(att * n_treated) / sum(n_treated), 6) AS att, CAST(sum(n_treated) AS BIGINT) AS weight,
    CASE WHEN event_time < -1 THEN 'pre-trend' WHEN event_time = -1 THEN 'base' ELSE 'effect' END AS kind FROM e GROUP BY 1""")
def o6(t):
    return R6(D.event_study(D.group_time_effects(_int_panel(t), "user_id", "period", "treat", "y")), "att")


@query("o7_rd_bins", """SELECT CAST(floor((o_totalprice - 250000.0) / 10000.0) AS BIGINT) AS bin, count(*) AS n, round(avg(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate)), 6) AS y_mean,
    CASE WHEN floor((o_totalprice - 250000.0) / 10000.0) >= 0 THEN 'above' ELSE 'below' END AS side FROM {orders} GROUP BY 1, 4""")
def o7(t):
    d = t.orders.withColumn("y", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")))
    return R6(D.rd_bins(d, "o_totalprice", "y", 250000.0, 10000.0), "y_mean")


@query("o7_rd_local_linear", """WITH d AS (SELECT o_totalprice - 250000.0 AS c, CAST(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS DOUBLE) AS y FROM {orders} WHERE abs(o_totalprice - 250000.0) < 50000),
    s AS (SELECT c >= 0 AS above, count(*) AS n, sum(1 - abs(c) / 50000) AS w, sum((1 - abs(c) / 50000) * c) AS wc, sum((1 - abs(c) / 50000) * c * c) AS wcc, sum((1 - abs(c) / 50000) * y) AS wy,
      sum((1 - abs(c) / 50000) * c * y) AS wcy FROM d GROUP BY 1),
    l AS (SELECT *, (wcc * wy - wc * wcy) / (w * wcc - wc * wc) AS level FROM s)
    SELECT max(n) FILTER (NOT above) AS n_below, max(n) FILTER (above) AS n_above, round(max(level) FILTER (NOT above), 6) AS left_limit, round(max(level) FILTER (above), 6) AS right_limit,
      round(max(level) FILTER (above) - max(level) FILTER (NOT above), 6) AS jump FROM l""")
def o7b(t):
    d = t.orders.withColumn("y", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")))
    return R6(D.rd_local_linear(d, "o_totalprice", "y", 250000.0, 50000.0).drop("slope_below", "slope_above"), "left_limit", "right_limit", "jump")


def _scored(t):
    d = t.arms.withColumn("late", (F.dayofmonth("ts") > 15).cast("double")).withColumn("v", F.col("value"))
    return D.propensity_scores(d, "arm_odd", ["late", "v"], ["event_id", "value"])


@query("o8_ipw_effect")
def o8(t):
    return D.ipw_effect(_scored(t), "arm_odd", "value")


@query("o8_overlap_histogram")
def o8b(t):
    return D.overlap_histogram(_scored(t), "arm_odd", 20)


def _placebo_sql(name, y, arm, cond="true"):
    return f"""SELECT '{name}' AS run, round(avg({y}) FILTER ({arm} = 1) - avg({y}) FILTER ({arm} = 0), 6) AS estimate,
      round(sqrt(var_samp({y}) FILTER ({arm} = 1) / count({y}) FILTER ({arm} = 1) + var_samp({y}) FILTER ({arm} = 0) / count({y}) FILTER ({arm} = 0)), 6) AS se FROM {{arms}} WHERE {cond}"""


@query("o9_placebo_runs", " UNION ALL ".join([_placebo_sql("headline", "value", "arm"), _placebo_sql("placebo_outcome", "event_id", "arm"),
                                              _placebo_sql("placebo_arm", "value", "arm_odd"), _placebo_sql("placebo_period", "value", "arm", f"NOT {SQL_AFTER}")]))
def o9(t):
    r = D.placebo_runs(t.arms, {"headline": ("value", F.col("arm"), None), "placebo_outcome": ("event_id", F.col("arm"), None),
                                "placebo_arm": ("value", F.col("arm_odd"), None), "placebo_period": ("value", F.col("arm"), ~AFTER())})
    return R6(r.drop("z"), "estimate", "se")


_HALF = "CAST(CAST('0x' || substr(md5('{salt}' || CAST({id} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < 0.5"


@query("o10_split_halves", "SELECT event_id, CASE WHEN " + _HALF.replace("{salt}", "split:").replace("{id}", "event_id") + " THEN 'explore' ELSE 'confirm' END AS half FROM {events}")
def o10(t):
    return D.split_halves(t.events, "event_id").select("event_id", "half")


@query("o11_disjointness", """SELECT 'train' AS "left", 'calibrate' AS "right", CAST(0 AS BIGINT) AS n_shared, 'pass' AS status UNION ALL
    SELECT 'train', 'labelled', (SELECT count(DISTINCT d.doc_id) FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) < '8'), 'fail' UNION ALL
    SELECT 'calibrate', 'labelled', (SELECT count(DISTINCT d.doc_id) FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) >= '8'), 'fail'""")
def o11(t):
    h = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    d = t.documents.select("doc_id")
    return D.disjointness({"train": d.where(h), "calibrate": d.where(~h), "labelled": t.labels}, "doc_id")


@query("o12_implied_bound", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, sum(l_quantity) AS e, sum(l_extendedprice) AS total FROM {lineitem})
    SELECT round(e, 2) AS exposure, round(b * e, 0) AS implied, round(total, 2) AS bound, abs(b * e) > abs(total) AS impossible FROM f""")
def o12(t):
    fit = R.fit_ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    total = t.lineitem.agg(F.sum("l_extendedprice").alias("s")).first()["s"]
    r = L.implied_bound(float(fit.beta[1]), F.col("l_quantity"), t.lineitem, total)
    return r.select(F.round("exposure", 2).alias("exposure"), F.round("implied", 0).alias("implied"), F.round("bound", 2).alias("bound"), "impossible")


@query("o13_itt_cace", """WITH s AS (SELECT avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS itt, avg(took) FILTER (arm = 1 AND y IS NOT NULL) - avg(took) FILTER (arm = 0 AND y IS NOT NULL) AS c FROM {arms})
    SELECT round(itt, 6) AS itt, round(c, 6) AS compliance, round(itt / c, 6) AS effect_on_treated FROM s""")
def o13(t):
    return R6(D.itt_and_cace(t.arms, "arm", "took", "y"), "itt", "compliance", "effect_on_treated")


_PRED = "SELECT l_returnflag, l_quantity / 50.0 + CASE WHEN l_orderkey % 97 = 0 THEN 0.2 ELSE 0 END AS score, CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END AS hit FROM {lineitem}"


@query("o14_calibration", "WITH d AS (" + _PRED + "), b AS (SELECT score, hit, 1" + "".join(
    f" + CAST(score > (SELECT quantile_cont(score, {i / 10}) FROM d) AS INT)" for i in range(1, 10)) + """ AS bin FROM d)
    SELECT bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(hit), 6) AS observed, round(avg(hit) - avg(score), 6) AS gap FROM b GROUP BY 1""")
def o14(t):
    return R6(D.calibration(t.sql(_PRED).withColumn("score", F.col("score").cast("double")).withColumn("hit", F.col("hit").cast("double")), "score", "hit"), "predicted", "observed", "gap")


@query("o14_prediction_bounds", "WITH d AS (" + _PRED + ") SELECT l_returnflag, count(*) AS n, count(*) FILTER (score < 0 OR score > 1) AS n_outside, count(*) < 30 AS thin FROM d GROUP BY 1")
def o14b(t):
    return D.prediction_bounds(t.sql(_PRED), "score", "l_returnflag", 0.0, 1.0)


# ---- diagnosis ------------------------------------------------------------------------------------------

DIMS = ["event_type", "region", "build", "hr"]
_LONG = " UNION ALL ".join(f"SELECT event_id, '{d}' AS dim, CAST({d} AS VARCHAR) AS value, fail FROM {{ev_fail}}" for d in DIMS)


@query("s1_slice_scan", "WITH l AS (" + _LONG + """), c AS (SELECT dim, value, count(*) AS n1, sum(fail) AS f1 FROM l GROUP BY 1, 2), t AS (SELECT dim, sum(n1) AS n, sum(f1) AS f FROM c GROUP BY 1),
    j AS (SELECT c.dim, value, n1, n - n1 AS n2, f1 / CAST(n1 AS DOUBLE) AS p1, (f - f1) / CAST(n - n1 AS DOUBLE) AS p2, f / CAST(n AS DOUBLE) AS pp FROM c JOIN t ON c.dim = t.dim WHERE n1 >= 100 AND n - n1 >= 100)
    SELECT dim, value, n1, CAST(n2 AS BIGINT) AS n2, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p1 / greatest(p2, 1e-12), 6) AS lift,
      round((p1 - p2) / sqrt(pp * (1 - pp) * (1.0 / n1 + 1.0 / n2)), 6) AS z FROM j""")
def s1(t):
    return R6(S.slice_scan(t.ev_fail, DIMS, "fail").drop("p"), "p1", "p2", "lift", "z")


@query("s2_disciplined_slice")
def s2(t):
    return S.disciplined_slice(t.ev_fail, DIMS, "fail", "event_id")


@query("s3_co_occurrence", "WITH l AS (" + _LONG + """), b AS (SELECT dim, avg(fail) AS base FROM l GROUP BY 1)
    SELECT l.dim, value, count(*) AS n, CAST(sum(fail) AS BIGINT) AS failures, round(avg(fail), 6) AS rate, round(any_value(base), 6) AS base, round(avg(fail) / any_value(base), 6) AS lift
    FROM l JOIN b ON l.dim = b.dim GROUP BY 1, 2 HAVING count(*) >= 30 AND avg(fail) / any_value(base) >= 1.5""")
def s3(t):
    return R6(S.co_occurrence(t.ev_fail, DIMS, "fail"), "rate", "base", "lift")


@query("s4_base_rates", "WITH l AS (" + _LONG + """), t AS (SELECT dim, sum(fail) AS f, sum(1 - fail) AS s FROM l GROUP BY 1)
    SELECT l.dim, value, round(sum(fail) / CAST(any_value(f) AS DOUBLE), 6) AS among_failures, round(sum(1 - fail) / CAST(any_value(s) AS DOUBLE), 6) AS among_successes FROM l JOIN t ON l.dim = t.dim GROUP BY 1, 2""")
def s4(t):
    return R6(S.base_rates(t.ev_fail, DIMS, "fail"), "among_failures", "among_successes")


_MIX = f"""WITH g AS (SELECT event_type AS segment, count(*) FILTER (NOT {SQL_AFTER}) AS n0, count(*) FILTER {'(WHERE ' + SQL_AFTER + ')'} AS n1,
      avg(value) FILTER (WHERE NOT {SQL_AFTER}) AS r0, avg(value) FILTER (WHERE {SQL_AFTER}) AS r1 FROM {{events}} GROUP BY 1),
    w AS (SELECT segment, n0 / CAST((SELECT sum(n0) FROM g) AS DOUBLE) AS w0, n1 / CAST((SELECT sum(n1) FROM g) AS DOUBLE) AS w1, r0, r1 FROM g)"""


@query("s5_mix_decomposition", _MIX + """ SELECT segment, round(w0, 6) AS share_before, round(w1, 6) AS share_after, round(r0, 6) AS rate_before, round(r1, 6) AS rate_after,
    round((w0 + w1) / 2 * (r1 - r0), 6) AS within, round((r0 + r1) / 2 * (w1 - w0), 6) AS mix FROM w""")
def s5(t):
    return R6(S.mix_decomposition(t.events, AFTER(), "event_type", "value"), "share_before", "share_after", "rate_before", "rate_after", "within", "mix")


@query("s5_mix_reconciles", f"""SELECT 'mix' AS gate, 'pass' AS status, round(avg(value) FILTER ({SQL_AFTER}) - avg(value) FILTER (NOT {SQL_AFTER}), 6) AS observed FROM {{events}}""")
def s5b(t):
    parts = S.mix_decomposition(t.events, AFTER(), "event_type", "value").withColumn("part", F.col("within") + F.col("mix"))
    total = t.events.agg((F.avg(F.when(AFTER(), F.col("value"))) - F.avg(F.when(~AFTER(), F.col("value")))).alias("total"))
    return G.decomposition_reconciles(parts.join(F.broadcast(total)), "part", F.col("total"), 1e-6, "mix").select(
        "gate", "status", F.round("observed", 6).alias("observed"))


@query("s6_step_changes", """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM {events} GROUP BY 1),
    x AS (SELECT day, count(m) OVER b AS nb, count(m) OVER a AS na, avg(m) OVER b AS mb, avg(m) OVER a AS ma, var_samp(m) OVER b AS vb, var_samp(m) OVER a AS va FROM d
      WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    y AS (SELECT day, nb AS days_before, na AS days_after, ma - mb AS step, (ma - mb) / sqrt(vb / nb + va / na) AS t FROM x WHERE nb >= 3 AND na >= 3),
    ch AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM {events} WHERE dayofweek(ts) = 1)
    SELECT y.day, days_before, days_after, round(step, 6) AS step, round(t, 6) AS t, CAST(row_number() OVER (ORDER BY abs(t) DESC, y.day) AS INT) AS rank,
      CASE WHEN EXISTS (SELECT 1 FROM ch WHERE abs(date_diff('day', ch.day, y.day)) <= 1) THEN 'release' END AS change FROM y""")
def s6(t):
    rel = t.events.where(F.dayofweek("ts") == 2).select(F.to_date("ts").alias("day")).distinct().withColumn("change", F.lit("release"))
    return R6(S.step_changes(t.events, F.to_date("ts"), "value", rel), "step", "t")


@query("s7_numeric_shift", f"""WITH l AS (SELECT 'value' AS "column", value AS v, {SQL_AFTER} AS a FROM {{events}} UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE), {SQL_AFTER} FROM {{events}}),
    c AS (SELECT "column", v, sum(CASE WHEN a THEN 0 ELSE 1 END) AS c0, sum(CASE WHEN a THEN 1 ELSE 0 END) AS c1 FROM l GROUP BY 1, 2),
    r AS (SELECT "column", sum(c0) OVER w AS r0, sum(c1) OVER w AS r1, sum(c0) OVER (PARTITION BY "column") AS n0, sum(c1) OVER (PARTITION BY "column") AS n1 FROM c WINDOW w AS (PARTITION BY "column" ORDER BY v))
    SELECT "column", CAST(max(n0) AS BIGINT) AS n_before, CAST(max(n1) AS BIGINT) AS n_after, round(max(abs(r1 / CAST(n1 AS DOUBLE) - r0 / CAST(n0 AS DOUBLE))), 6) AS ks FROM r GROUP BY 1""")
def s7(t):
    return R6(S.numeric_shift(t.events, AFTER(), ["value", "user_id"]), "ks")


@query("s7_categorical_shift", f"""WITH c AS (SELECT event_type AS v, count(*) FILTER (NOT {SQL_AFTER}) AS c0, count(*) FILTER ({SQL_AFTER}) AS c1 FROM {{events}} GROUP BY 1),
    t AS (SELECT *, CAST(sum(c0) OVER () AS DOUBLE) AS n0, CAST(sum(c1) OVER () AS DOUBLE) AS n1 FROM c)
    SELECT 'event_type' AS "column", round(sum(abs(c1 / n1 - c0 / n0)) / 2, 6) AS total_variation, round(sum(power(c0 - (c0 + c1) * n0 / (n0 + n1), 2) / ((c0 + c1) * n0 / (n0 + n1))
      + power(c1 - (c0 + c1) * n1 / (n0 + n1), 2) / ((c0 + c1) * n1 / (n0 + n1))), 6) AS chi2, count(*) - 1 AS dof FROM t""")
def s7b(t):
    return R6(S.categorical_shift(t.events, AFTER(), ["event_type"]), "total_variation", "chi2")


@query("s7_label_shift", f"""SELECT event_type, round(count(*) FILTER (NOT {SQL_AFTER}) / CAST((SELECT count(*) FROM {{events}} WHERE NOT {SQL_AFTER}) AS DOUBLE), 6) AS before,
    round(count(*) FILTER ({SQL_AFTER}) / CAST((SELECT count(*) FROM {{events}} WHERE {SQL_AFTER}) AS DOUBLE), 6) AS after FROM {{events}} GROUP BY 1""")
def s7c(t):
    return R6(S.label_shift(t.events, AFTER(), "event_type"), "before", "after")


_SKEW = "SELECT event_id, event_type, CASE WHEN event_id % 23 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN event_id % 41 = 0 THEN NULL ELSE user_id END AS user_id FROM {events}"


@query("s8_feature_skew", "WITH b AS (" + _SKEW + """), j AS (SELECT a.value AS av, b.value AS bv, a.user_id AS au, b.user_id AS bu FROM {events} a JOIN b ON a.event_id = b.event_id)
    SELECT 'value' AS "column", count(*) AS n, CAST(0 AS BIGINT) AS one_side, count(*) FILTER (av IS DISTINCT FROM bv) AS n_different, round(count(*) FILTER (av IS DISTINCT FROM bv) / CAST(count(*) AS DOUBLE), 6) AS rate FROM j
    UNION ALL SELECT 'user_id', count(*), 0, count(*) FILTER (au IS DISTINCT FROM bu), round(count(*) FILTER (au IS DISTINCT FROM bu) / CAST(count(*) AS DOUBLE), 6) FROM j""")
def s8(t):
    return R6(S.feature_skew(t.events, t.sql(_SKEW), "event_id", ["value", "user_id"]), "rate")


@query("s9_staleness", """WITH a AS (SELECT event_id, event_type, epoch_us(ts) - max(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) OVER
      (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS age FROM {events})
    SELECT event_type, count(*) AS n, count(age) AS n_known, min(age) AS min_age, max(age) AS max_age FROM a GROUP BY 1""")
def s9(t):
    e = t.events.select("event_id", "user_id", "event_type", MICROS().alias("micros"))
    a = S.staleness(e, e.where("event_type = 'signup'").select("user_id", "micros"), "user_id", "micros")
    return a.groupBy("event_type").agg(F.count("*").alias("n"), F.count("age").alias("n_known"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))


@query("s10_funnel", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM {events} GROUP BY 1, 2),
    g AS (SELECT day, count(*) FILTER (v) AS a, count(*) FILTER (v AND c) AS b, count(*) FILTER (v AND c AND p) AS d FROM e GROUP BY 1)
    SELECT day, 1 AS step, 'view' AS name, a AS n, CAST(NULL AS DOUBLE) AS loss FROM g UNION ALL SELECT day, 2, 'click', b, round(1 - b / CAST(nullif(a, 0) AS DOUBLE), 6) FROM g
    UNION ALL SELECT day, 3, 'purchase', d, round(1 - d / CAST(nullif(b, 0) AS DOUBLE), 6) FROM g""")
def s10(t):
    steps = {n: F.col("event_type") == n for n in ("view", "click", "purchase")}
    return R6(S.funnel(t.events.withColumn("day", F.to_date("ts")), "user_id", steps, "day"), "loss")


@query("s11_slice_ranking", f"""WITH l AS (SELECT 'event_type' AS dim, event_type AS value, value AS v, {SQL_AFTER} AS a FROM {{events}} UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), value, {SQL_AFTER} FROM {{events}}),
    s AS (SELECT dim, value, sum(CASE WHEN a THEN 0 ELSE v END) AS b, sum(CASE WHEN a THEN v ELSE 0 END) AS f FROM l GROUP BY 1, 2),
    j AS (SELECT *, sum(b) OVER (PARTITION BY dim) AS tb, sum(f) OVER (PARTITION BY dim) AS tf FROM s), p AS (SELECT *, b / tb AS p, f / tf AS q FROM j)
    SELECT dim, value, round(b, 4) AS before, round(f, 4) AS after, round((f - b) / (tf - tb), 6) AS explains, round((p + q) / 2, 6) AS size,
      round(0.5 * (CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END), 8) AS surprise FROM p""")
def s11(t):
    r = S.slice_ranking(t.events, AFTER(), ["event_type", "user_id"], "value")
    return R6(r, "explains", "size").withColumns({"before": F.round("before", 4), "after": F.round("after", 4), "surprise": F.round("surprise", 8)})


@query("s12_is_is_not", "WITH l AS (" + _LONG + """) SELECT dim, value, CAST(sum(fail) AS BIGINT) AS failing, CAST(sum(1 - fail) AS BIGINT) AS clean,
    CASE WHEN sum(1 - fail) = 0 THEN 'only failing' WHEN sum(fail) = 0 THEN 'only clean' ELSE 'both' END AS seen FROM l GROUP BY 1, 2""")
def s12(t):
    return S.is_is_not(t.ev_fail, DIMS, "fail")


@query("s13_ceiling_analysis", """WITH o AS (SELECT coalesce(c2 = c1, false) AS a, coalesce(c3 = c1, false) AS b, doc_id % 19 <> 0 AS c FROM {coders}),
    s AS (SELECT avg(CASE WHEN a AND b AND c THEN 1.0 ELSE 0 END) AS n, avg(CASE WHEN b AND c THEN 1.0 ELSE 0 END) AS x, avg(CASE WHEN a AND c THEN 1.0 ELSE 0 END) AS y, avg(CASE WHEN a AND b THEN 1.0 ELSE 0 END) AS z FROM o)
    SELECT 'read' AS stage, round(n, 6) AS now, round(x, 6) AS with_stage_perfect, round(x - n, 6) AS headroom FROM s UNION ALL SELECT 'classify', round(n, 6), round(y, 6), round(y - n, 6) FROM s
    UNION ALL SELECT 'publish', round(n, 6), round(z, 6), round(z - n, 6) FROM s""")
def s13(t):
    r = S.ceiling_analysis(t.coders, {"read": F.col("c2") == F.col("c1"), "classify": F.col("c3") == F.col("c1"), "publish": F.col("doc_id") % 19 != 0})
    return R6(r, "now", "with_stage_perfect", "headroom")


_U = "CAST(CAST('0x' || substr(md5('fault:@' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@query("s14_fault_injection", "WITH d AS (SELECT o_orderkey, CASE WHEN " + _U.replace("@", "null") + " >= 0.02 THEN o_orderpriority END AS pr, CASE WHEN " + _U.replace("@", "bad")
       + " < 0.02 THEN -1.0 ELSE o_totalprice END AS price, " + _U.replace("@", "dup") + """ < 0.02 AS dup FROM {orders}), x AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE dup)
    SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct, count(*) - count(DISTINCT o_orderkey) AS n_duplicate, count(*) FILTER (pr IS NULL) AS n_missing, count(*) FILTER (price < 0) AS n_negative FROM x""")
def s14(t):
    d = S.inject_faults(t.orders, "o_orderkey", "o_orderpriority", "o_totalprice", -1.0)
    k = key_uniqueness(d, ["o_orderkey"])
    return k.join(F.broadcast(d.agg(F.count_if(F.col("o_orderpriority").isNull()).alias("n_missing"), F.count_if(F.col("o_totalprice") < 0).alias("n_negative"))))
