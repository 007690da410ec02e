"""Registered queries: regression, standard errors, resampling and several hypotheses."""

from pyspark.sql import functions as F

from plumbline.functions.dist import two_sided_normal
from plumbline.functions.scalars import stable_uniform
from plumbline.operators import gates as G
from plumbline.operators import ladder as L
from plumbline.operators import regress as R
from plumbline.plans.registry import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
Y, XS = "l_extendedprice", ["l_quantity", "l_discount"]

# two-regressor least squares in SQL on centred columns; z1, z2 are rows of (X'X)^-1 x
OLS = """m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, count(*) AS n FROM {lineitem}),
    c AS (SELECT l_extendedprice - my AS y, l_quantity - m1 AS x1, l_discount - m2 AS x2, l_suppkey, l_partkey, l_returnflag, n FROM {lineitem}, m),
    s AS (SELECT any_value(n) AS n, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS t1, sum(x2 * y) AS t2, sum(y * y) AS yy FROM c),
    b AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM s),
    f AS (SELECT *, s22 / det AS m11, -s12 / det AS m12, s11 / det AS m22, (s22 * t1 - s12 * t2) / det AS b1, (s11 * t2 - s12 * t1) / det AS b2 FROM b),
    r AS (SELECT c.*, f.b1, f.b2, y - f.b1 * x1 - f.b2 * x2 AS e, 1.0 / f.n + m11 * x1 * x1 + 2 * m12 * x1 * x2 + m22 * x2 * x2 AS h,
      m11 * x1 + m12 * x2 AS z1, m12 * x1 + m22 * x2 AS z2 FROM c, f)"""


@query("n1_ols", "WITH " + OLS + """, q AS (SELECT sum(e * e) AS rss FROM r)
    SELECT 'l_quantity' AS term, round(b1, 4) AS estimate, round(sqrt(rss / (n - 3) * m11), 4) AS se, n, CAST(0 AS BIGINT) AS dropped FROM f, q
    UNION ALL SELECT 'l_discount', round(b2, 4), round(sqrt(rss / (n - 3) * m22), 4), n, 0 FROM f, q
    UNION ALL SELECT 'intercept', round(my - b1 * m1 - b2 * m2, 4), round(sqrt(rss / (f.n - 3) * (1.0 / f.n + m1 * m1 * m11 + 2 * m1 * m2 * m12 + m2 * m2 * m22)), 4), f.n, 0 FROM f, q, m""")
def n1(t):
    c = R.coefficients(t.lineitem, R.fit_ols(t.lineitem, Y, XS))
    return c.select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "n", "dropped")


_RUNGS = {"iid": "sqrt(sum(e * e) / (count(*) - 3) * (SELECT m@@ FROM f))", "HC0": "sqrt(sum(z@ * z@ * e * e))",
          "HC1": "sqrt(sum(z@ * z@ * e * e) * count(*) / (count(*) - 3))", "HC2": "sqrt(sum(z@ * z@ * e * e / (1 - h)))",
          "HC3": "sqrt(sum(z@ * z@ * e * e / ((1 - h) * (1 - h))))"}


@query("n2_robust_rungs", "WITH " + OLS + " " + " UNION ALL ".join(
    f"SELECT '{p}' AS param, '{r}' AS rung, round(any_value(b{i}), 4) AS estimate, round({e.replace('@', str(i))}, 4) AS se, CAST(count(*) - 3 AS DOUBLE) AS dof FROM r"
    for i, p in ((1, "l_quantity"), (2, "l_discount")) for r, e in _RUNGS.items()))
def n2(t):
    d = L.se_ladder(t.lineitem, Y, XS, XS)
    return d.select("param", "rung", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "dof")


@query("n3_cluster_rungs", "WITH " + OLS + ", g AS (SELECT l_suppkey, sum(z1 * e) AS a1, sum(z2 * e) AS a2 FROM r GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT '{p}' AS param, '{r}' AS rung, round(sqrt(sum(a{i} * a{i}){fac}), 4) AS se, CAST(count(*) - 1 AS DOUBLE) AS dof FROM g"
    for i, p in ((1, "l_quantity"), (2, "l_discount")) for r, fac in (
        ("CR0", ""), ("CR1", " * count(*) / (count(*) - 1) * ((SELECT n FROM f) - 1) / ((SELECT n FROM f) - 3)"))))
def n3(t):
    fit = R.fit_ols(t.lineitem, Y, XS, ["l_suppkey"])
    vs, g = R.cr_variances(fit, R.cluster_sums(fit, ["l_suppkey"]))
    rows = [r for n, v in vs.items() for r in R.rung(fit, n, v, g - 1)]
    return t.spark.createDataFrame(rows, R.RUNG_SCHEMA).select("param", "rung", F.round("se", 4).alias("se"), "dof")


@query("n4_cr2")
def n4(t):
    return L.se_ladder(t.lineitem, Y, XS, XS, "l_suppkey").where("rung = 'CR2'")


@query("n5_wild_cluster_bootstrap")
def n5(t):
    return L.wild_cluster_bootstrap(t.lineitem, Y, XS, "l_discount", "l_suppkey", draws=999)


@query("n6_randomisation_inference")
def n6(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_nationkey", "o_totalprice", (F.col("c_nationkey") % 2).alias("arm"), "c_acctbal")
    return L.randomisation_inference(d, "o_totalprice", "arm", ["c_acctbal"], cluster="c_nationkey", row_id="o_orderkey", draws=199, opt_in=True)


@query("n6_randomisation_rows")
def n6b(t):
    return L.randomisation_inference(t.customer.withColumn("arm", F.col("c_custkey") % 2), "c_acctbal", "arm", row_id="c_custkey", draws=99, opt_in=True)


@query("n7_ladder_verdict")
def n7(t):
    d = t.lineitem.withColumn("arm", (F.col("l_suppkey") % 2).cast("double"))
    lad = L.se_ladder(d, Y, ["arm", "l_quantity"], ["arm"], "l_suppkey").unionByName(
        L.wild_cluster_bootstrap(d, Y, ["arm", "l_quantity"], "arm", "l_suppkey", draws=199))
    return L.ladder_verdict(lad, L.design_facts(d, "arm", "l_suppkey"))


@query("n7_design_facts", """WITH d AS (SELECT l_suppkey, CAST(l_suppkey % 2 AS DOUBLE) * CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS arm FROM {lineitem}),
    g AS (SELECT l_suppkey, avg(arm) AS m, max(CASE WHEN arm <> 0 THEN 1 ELSE 0 END) AS t FROM d GROUP BY 1)
    SELECT (SELECT count(*) FROM g) AS clusters, CAST((SELECT sum(t) FROM g) AS BIGINT) AS treated_clusters,
      round(sum((arm - m) * (arm - m)) / sum((arm - (SELECT avg(arm) FROM d)) * (arm - (SELECT avg(arm) FROM d))), 6) AS within_share
    FROM d JOIN g ON d.l_suppkey = g.l_suppkey""")
def n7b(t):
    d = t.lineitem.withColumn("arm", (F.col("l_suppkey") % 2).cast("double") * F.when(F.col("l_returnflag") == "N", 0.0).otherwise(1.0))
    return R6(L.design_facts(d, "arm", "l_suppkey"), "within_share")


@query("n8_table_note", "WITH g AS (SELECT count(DISTINCT l_suppkey) AS g, count(DISTINCT CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey END) AS t FROM {lineitem}) "
       "SELECT 'arm' AS param, 'CR1' AS rung, printf('CR1 errors; t with %d.0 df; %d clusters, %d of them with treated rows', g - 1, g, t) AS note FROM g "
       "UNION ALL SELECT 'arm', 'HC1', printf('HC1 errors; t with %d.0 df', (SELECT count(*) - 3 FROM {lineitem})) FROM g")
def n8(t):
    d = t.lineitem.withColumn("arm", (F.col("l_suppkey") % 2).cast("double"))
    fit = R.fit_ols(d, Y, ["arm", "l_quantity"], ["l_suppkey"])
    vs, g = R.cr_variances(fit, R.cluster_sums(fit, ["l_suppkey"]))
    rows = R.rung(fit, "CR1", vs["CR1"], g - 1, ["arm"]) + R.rung(fit, "HC1", R.hc_variances(fit)["HC1"], fit.n - fit.k, ["arm"])
    lad, facts = t.spark.createDataFrame(rows, R.RUNG_SCHEMA), L.design_facts(d, "arm", "l_suppkey")
    return L.table_note(lad, "CR1", facts).unionByName(L.table_note(lad, "HC1", facts))


@query("n9_cluster_bootstrap")
def n9(t):
    return L.bootstrap_summary(L.unit_bootstrap(t.lineitem, "l_suppkey", Y, XS, 199), 199)


@query("n9_two_sample_bootstrap")
def n9b(t):
    d = t.lineitem.withColumn("x", F.col("l_quantity") + F.col("l_tax")).withColumn("d", (F.col("l_linenumber") % 2).cast("double"))
    half = stable_uniform(F.col("l_orderkey"), "cal:") < 0.5
    b = L.two_sample_bootstrap(d.where(half), d.where(~half), "l_orderkey", "x", "l_quantity", ["l_discount"], Y, "d", 99)
    return L.bootstrap_summary(b, 99)


@query("m8_bootstrap_draws_usable")
def m8(t):
    b = L.unit_bootstrap(t.lineitem, "l_suppkey", Y, ["l_quantity"], 99)
    return G.draws_usable(b, F.col("estimate").isNotNull(), 99).select("gate", "status", "observed", "expected")


_LEV = "SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS rid, * FROM {lineitem}"


@query("n10_leverage", "WITH " + OLS.replace("l_suppkey, l_partkey, l_returnflag, n FROM {lineitem}, m", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS rid, n FROM {lineitem}, m") + """,
    v AS (SELECT sqrt(sum(z1 * z1 * e * e) * count(*) / (count(*) - 3)) AS se1, sqrt(sum(z2 * z2 * e * e) * count(*) / (count(*) - 3)) AS se2 FROM r),
    d AS (SELECT rid, b1, b2, z1 * e / (1 - h) AS d1, z2 * e / (1 - h) AS d2 FROM r),
    p AS (SELECT 'l_quantity' AS term, b1 AS b, d1 AS d, rid, se1 AS se FROM d, v QUALIFY row_number() OVER (ORDER BY abs(d1) DESC, rid) = 1
      UNION ALL SELECT 'l_discount', b2, d2, rid, se2 FROM d, v QUALIFY row_number() OVER (ORDER BY abs(d2) DESC, rid) = 1)
    SELECT term, round(b, 4) AS estimate, round(b - d, 4) AS worst_loo, rid AS row_id, round(abs(d) / se, 6) AS in_ses, abs(d) / se >= 0.5 AS flag FROM p""")
def n10(t):
    d = t.sql(_LEV)
    r = R.dfbetas(d, R.fit_ols(d, Y, XS, ["rid"]), "rid")
    return r.select("term", F.round("estimate", 4).alias("estimate"), F.round("worst_loo", 4).alias("worst_loo"), "row_id", F.round("in_ses", 6).alias("in_ses"), "flag")


@query("n11_leave_one_cluster_out")
def n11(t):
    return R.leave_one_cluster_out(R.fit_ols(t.lineitem, Y, XS, ["l_suppkey"]), "l_suppkey", XS)


@query("n11_cluster_imbalance", """WITH g AS (SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY 1)
    SELECT count(*) AS clusters, round(max(n) / median(n), 6) AS max_over_median, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS largest_share FROM g""")
def n11b(t):
    return R6(R.cluster_imbalance(t.lineitem, "l_suppkey"), "max_over_median", "largest_share")


@query("n12_two_way_clustering", "WITH " + OLS + """, a AS (SELECT sum(s * s) AS v FROM (SELECT sum(z1 * e) AS s FROM r GROUP BY l_suppkey)),
    b AS (SELECT sum(s * s) AS v FROM (SELECT sum(z1 * e) AS s FROM r GROUP BY l_partkey)), ab AS (SELECT sum(s * s) AS v FROM (SELECT sum(z1 * e) AS s FROM r GROUP BY l_suppkey, l_partkey))
    SELECT 'l_quantity' AS param, round(sqrt(a.v + b.v - ab.v), 4) AS se FROM a, b, ab""".replace(", b AS", ", b_ AS").replace("    b AS", "    b_ AS").replace("a.v + b.v", "a.v + b_.v").replace("FROM a, b, ab", "FROM a, b_, ab"))
def n12(t):
    fit = R.fit_ols(t.lineitem, Y, XS, ["l_suppkey", "l_partkey"])
    v = R.two_way_variance(fit, "l_suppkey", "l_partkey")
    rows = R.rung(fit, "two-way", v, float("inf"), ["l_quantity"])
    return t.spark.createDataFrame(rows, R.RUNG_SCHEMA).select("param", F.round("se", 4).alias("se"))


@query("n13_within_one_way", """WITH g AS (SELECT l_partkey, avg(l_extendedprice) AS my, avg(l_quantity) AS mx, count(*) AS n FROM {lineitem} GROUP BY 1),
    r AS (SELECT l_extendedprice - my AS y, l_quantity - mx AS x FROM {lineitem} l JOIN g ON l.l_partkey = g.l_partkey),
    s AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS rss, count(*) AS n FROM r)
    SELECT 'l_quantity' AS param, round(b, 4) AS estimate, round(sqrt(rss / (n - 1 - (SELECT count(*) FROM g)) / xx), 4) AS se,
      CAST(n - 1 - (SELECT count(*) FROM g) AS DOUBLE) AS dof, (SELECT count(*) FROM g) AS levels, (SELECT count(*) FROM g WHERE n = 1) AS singletons, n FROM s""")
def n13(t):
    r = R.within_fit(t.lineitem, Y, ["l_quantity"], ["l_partkey"])
    return r.withColumns({"estimate": F.round("estimate", 4), "se": F.round("se", 4)})


@query("n13_within_two_way")
def n13b(t):
    return R.within_fit(t.lineitem, Y, ["l_quantity", "l_discount"], ["l_suppkey", "l_linenumber"])


# a regression for each arm; the effect is the difference of their values at the mean covariate
@query("n14_adjusted_experiment", """WITH d AS (SELECT arm, value AS y, CAST(hour(ts) AS DOUBLE) AS x FROM {arms} WHERE value IS NOT NULL), a AS (SELECT avg(x) AS m, count(*) AS n FROM d),
    g AS (SELECT arm, avg(x) AS mx, avg(y) AS my, CAST(count(*) AS DOUBLE) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM d GROUP BY 1),
    r AS (SELECT d.arm, y - my - b * (x - mx) AS e, 1 / g.n + (m - mx) * (x - mx) / sxx AS w, 1 / g.n + (x - mx) * (x - mx) / sxx AS h FROM d JOIN g ON d.arm = g.arm, a),
    v AS (SELECT sum(w * w * e * e / (1 - h)) AS v FROM r), p AS (SELECT sum(CASE WHEN arm = 1 THEN 1 ELSE -1 END * (my + b * (m - mx))) AS est FROM g, a)
    SELECT 'arm' AS param, 'HC2' AS rung, round(est, 6) AS estimate, round(sqrt(v), 6) AS se, CAST(n - 4 AS DOUBLE) AS dof FROM v, p, a""")
def n14(t):
    d = R.lin_adjusted(t.arms.withColumn("hr", F.hour("ts").cast("double")), "value", "arm", ["hr"])
    return R6(d.select("param", "rung", "estimate", "se", "dof"), "estimate", "se")


@query("n15_iv", """WITH d AS (SELECT value AS y, CAST(took AS DOUBLE) AS x, CAST(arm AS DOUBLE) AS z FROM {arms})
    SELECT 'first_stage' AS stage, round(covar_pop(z, x) / var_pop(z), 6) AS estimate FROM d
    UNION ALL SELECT 'reduced_form', round(covar_pop(z, y) / var_pop(z), 6) FROM d
    UNION ALL SELECT 'two_stage', round(covar_pop(z, y) / covar_pop(z, x), 6) FROM d""")
def n15(t):
    return R.iv_2sls(t.arms, "value", "took", "arm").select("stage", F.round("estimate", 6).alias("estimate"))


_PT = """SELECT user_id, count(*) AS n, (avg(value) - (SELECT avg(value) FROM {events})) / ((SELECT stddev_samp(value) FROM {events}) / sqrt(count(*))) AS z FROM {events} GROUP BY user_id"""


@query("n16_benjamini_hochberg")
def n16(t):
    p = t.sql(_PT).withColumn("p", two_sided_normal("z"))
    return L.benjamini_hochberg(p, "p", 0.05).select("user_id", "n", "p", "rank", "q", "reject")


@query("n16_bh_on_given_p", """WITH p AS (SELECT s_suppkey, round(abs(s_acctbal) / 20000.0, 3) + 0.0001 AS p FROM {supplier}),
    r AS (SELECT *, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, count(*) OVER () AS m FROM p),
    q AS (SELECT *, least(min(p * m / rank) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM r)
    SELECT s_suppkey, rank, round(q, 6) AS q, q <= 0.05 AS reject FROM q""")
def n16b(t):
    p = t.supplier.select("s_suppkey", (F.round(F.abs("s_acctbal") / 20000.0, 3) + 0.0001).alias("p"))
    return L.benjamini_hochberg(p, "p").select("s_suppkey", "rank", F.round("q", 6).alias("q"), "reject")


@query("n17_romano_wolf")
def n17(t):
    outcomes = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]
    d = t.lineitem.withColumn("arm", (F.col("l_linenumber") % 2).cast("double"))
    obs, draws = None, None
    for y in outcomes:
        fit = R.fit_ols(d, y, ["arm"])
        b = L.unit_bootstrap(d, "l_suppkey", y, ["arm"], 99)
        se = b.agg(F.stddev_samp("estimate").alias("s")).first()["s"]
        o = t.spark.createDataFrame([(y, float(fit.beta[1]) / se)], "hypothesis string, t double")
        e = b.select("draw", F.lit(y).alias("hypothesis"), ((F.col("estimate") - F.lit(float(fit.beta[1]))) / F.lit(se)).alias("t"))
        obs, draws = (o, e) if obs is None else (obs.unionByName(o), draws.unionByName(e))
    return L.romano_wolf(obs, draws)


# weights are row sums of the inverse of a 3 x 3 matrix, here from its cofactors
@query("n18_anderson_index", """WITH d AS (SELECT l_orderkey, CAST(n_lines AS DOUBLE) AS a, qty AS b, -CAST(n_returned AS DOUBLE) / n_lines AS c FROM {ord_rates}),
    s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_samp(a) AS sa, stddev_samp(b) AS sb, stddev_samp(c) AS sc, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM d),
    w AS (SELECT *, (1 - bc * bc) + (ac * bc - ab) + (ab * bc - ac) AS wa, (ac * bc - ab) + (1 - ac * ac) + (ab * ac - bc) AS wb, (ab * bc - ac) + (ab * ac - bc) + (1 - ab * ab) AS wc FROM s)
    SELECT l_orderkey, round((wa * (a - ma) / sa + wb * (b - mb) / sb + wc * (c - mc) / sc) / (wa + wb + wc), 6) AS "index" FROM d, w""")
def n18(t):
    d = t.ord_rates.withColumn("share_returned", F.col("n_returned") / F.col("n_lines"))
    return R6(R.anderson_index(d, {"n_lines": 1, "qty": 1, "share_returned": -1}, "l_orderkey")[0], "index")


# the t quantile is the normal one plus its first correction, which is exact to 1e-8 at these degrees of freedom
@query("n19_equivalence", """WITH d AS (SELECT l_discount AS y, l_linenumber % 2 AS a FROM {lineitem} WHERE l_discount IS NOT NULL AND l_linenumber IS NOT NULL),
    g AS (SELECT avg(y) FILTER (a = 1) AS m1, avg(y) FILTER (a = 0) AS m0, CAST(count(*) FILTER (a = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (a = 0) AS DOUBLE) AS n0, CAST(count(*) AS DOUBLE) AS n FROM d),
    s AS (SELECT any_value(m1 - m0) AS b, sqrt(any_value(n / (n - 2)) * sum(CASE WHEN a = 1 THEN (y - m1) * (y - m1) / (n1 * n1) ELSE (y - m0) * (y - m0) / (n0 * n0) END)) AS se, any_value(n - 2) AS dof FROM d, g),
    c AS (SELECT *, 1.6448536269514722 + (power(1.6448536269514722, 3) + 1.6448536269514722) / (4 * dof) AS t FROM s)
    SELECT 'arm' AS param, round(b, 6) AS estimate, round(se, 6) AS se, round(b - t * se, 6) AS lo90, round(b + t * se, 6) AS hi90, b - t * se > -0.005 AND b + t * se < 0.005 AS equivalent FROM c""")
def n19(t):
    d = t.lineitem.withColumn("arm", (F.col("l_linenumber") % 2).cast("double"))
    return R6(R.equivalence_test(L.se_ladder(d, "l_discount", ["arm"], ["arm"]).where("rung = 'HC1'"), 0.005), "estimate", "se", "lo90", "hi90")


@query("n20_subgroup_difference", """WITH g AS (SELECT l_returnflag AS level, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b,
      sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)) AS se
      FROM {lineitem} GROUP BY 1), f AS (SELECT b AS b0, se AS e0, level AS l0 FROM g ORDER BY level LIMIT 1)
    SELECT level, n, round(b, 4) AS slope, round(se, 4) AS se, round(CASE WHEN level <> l0 THEN b - b0 END, 4) AS difference,
      round(CASE WHEN level <> l0 THEN sqrt(se * se + e0 * e0) END, 4) AS difference_se FROM g, f""")
def n20(t):
    d = R.subgroup_difference(t.lineitem, Y, "l_quantity", "l_returnflag")
    return d.select("level", "n", *[F.round(c, 4).alias(c) for c in ("slope", "se", "difference", "difference_se")])


@query("n21_collinearity", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM {lineitem})
    SELECT 'l_quantity' AS "column", round(1 / (1 - r * r), 6) AS vif, round(abs(r), 6) AS max_abs_corr, round(sqrt((1 + abs(r)) / (1 - abs(r))), 6) AS condition_number FROM c
    UNION ALL SELECT 'l_extendedprice', round(1 / (1 - r * r), 6), round(abs(r), 6), round(sqrt((1 + abs(r)) / (1 - abs(r))), 6) FROM c""")
def n21(t):
    return R6(R.collinearity(t.lineitem, ["l_quantity", "l_extendedprice"]), "vif", "max_abs_corr", "condition_number")


@query("n21_overlap", """WITH b AS (SELECT greatest(min(value) FILTER (arm = 1), min(value) FILTER (arm = 0)) AS lo, least(max(value) FILTER (arm = 1), max(value) FILTER (arm = 0)) AS hi FROM {arms})
    SELECT 'value' AS "column", any_value(lo) AS common_lo, any_value(hi) AS common_hi, round(avg(CASE WHEN value BETWEEN lo AND hi THEN 0.0 ELSE 1 END), 6) AS outside FROM {arms}, b""")
def n21b(t):
    return R6(R.overlap(t.arms, "arm", ["value"]), "outside")


@query("n22_shrunk_means", """WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM {events} GROUP BY 1),
    a AS (SELECT sum(n * mean) / sum(n) AS gm, sum(n) AS nn, count(*) AS k, sum((n - 1) * coalesce(v, 0)) / sum(n - 1) AS w, sum(n * n) AS n2 FROM g),
    t AS (SELECT gm, w, greatest((sum(n * (mean - gm) * (mean - gm)) / (any_value(k) - 1) - any_value(w)) / ((any_value(nn) - any_value(n2) / CAST(any_value(nn) AS DOUBLE)) / (any_value(k) - 1)), 0.0) AS t2 FROM g, a GROUP BY gm, w)
    SELECT user_id, n, round(mean, 6) AS mean, round(t2 / (t2 + w / n), 6) AS reliability, round(gm + t2 / (t2 + w / n) * (mean - gm), 6) AS shrunk FROM g, t""")
def n22(t):
    return R6(R.shrink_means(t.events, "user_id", "value"), "mean", "reliability", "shrunk")


def _family(t):
    d = t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return R.specification_family(d, {
        "published": (Y, ["l_quantity"], None), "with_discount": (Y, ["l_quantity", "l_discount"], None),
        "net_price": ("net", ["l_quantity"], None), "returned_only": (Y, ["l_quantity"], F.col("l_returnflag") == "R")}, "l_quantity", "published")


_FAM = """WITH f AS (SELECT 'published' AS spec, regr_slope(l_extendedprice, l_quantity) AS b FROM {lineitem}
    UNION ALL SELECT 'net_price', regr_slope(l_extendedprice * (1 - l_discount), l_quantity) FROM {lineitem}
    UNION ALL SELECT 'returned_only', regr_slope(l_extendedprice, l_quantity) FROM {lineitem} WHERE l_returnflag = 'R'
    UNION ALL SELECT 'with_discount', (regr_sxx(l_extendedprice, l_discount) * 0 + (var_pop(l_discount) * covar_pop(l_quantity, l_extendedprice) - covar_pop(l_quantity, l_discount) * covar_pop(l_discount, l_extendedprice))
      / (var_pop(l_quantity) * var_pop(l_discount) - covar_pop(l_quantity, l_discount) * covar_pop(l_quantity, l_discount))) FROM {lineitem})"""


@query("n23_specification_family", _FAM + "SELECT spec, round(b, 4) AS estimate, CAST(row_number() OVER (ORDER BY abs(b)) AS INT) AS rank FROM f")
def n23(t):
    return _family(t).select("spec", F.round("estimate", 4).alias("estimate"), "rank")


@query("m9_published_is_conservative", _FAM + """SELECT 'published_is_conservative' AS gate, CASE WHEN max(abs(b)) FILTER (spec = 'published') <= min(abs(b)) FILTER (spec <> 'published') THEN 'pass' ELSE 'fail' END AS status,
    round(max(abs(b)) FILTER (spec = 'published'), 4) AS observed, round(min(abs(b)) FILTER (spec <> 'published'), 4) AS expected FROM f""")
def m9(t):
    return G.published_is_conservative(_family(t), "spec", "estimate", "published").select(
        "gate", "status", F.round("observed", 4).alias("observed"), F.round("expected", 4).alias("expected"))
