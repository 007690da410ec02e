"""Registered queries: extraction triage, measurement, prose, vectors and experiments."""

from pyspark.sql import functions as F

from plumbline.operators import experiment as X
from plumbline.operators import extract as E
from plumbline.operators import measure as M
from plumbline.operators import prose as P
from plumbline.operators import vectors as V
from plumbline.plans.registry import query
from plumbline.session import spread

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

# ---- extraction --------------------------------------------------------------------------------------

_RPT = "(md5(text) IN (SELECT md5(text) FROM {documents} GROUP BY lang, md5(text) HAVING count(*) > 1))"


def _detectors():
    return {"wrong_script": ("text", (F.col("lang") == "en") & F.col("text").rlike("[À-ÿ]")),
            "repeated": ("text", F.col("_repeated")), "equals_lang": ("source", F.col("source") == F.col("lang")),
            "label_leak": ("source", F.lower("source").startswith("source")), "bad_format": ("source", ~F.col("source").rlike("^src[0-9]+$")),
            "wrong_length": ("n_chars", F.col("n_chars") != F.length("text")), "out_of_range": ("n_chars", (F.col("n_chars") < 10) | (F.col("n_chars") > 20000))}


_HIT = {"wrong_script": ("text", "lang = 'en' AND regexp_matches(text, '[À-ÿ]')"), "repeated": ("text", "rep"), "equals_lang": ("source", "source = lang"),
        "label_leak": ("source", "lower(source) LIKE 'source%'"), "bad_format": ("source", "NOT regexp_matches(source, '^src[0-9]+$')"),
        "wrong_length": ("n_chars", "n_chars <> length(text)"), "out_of_range": ("n_chars", "n_chars < 10 OR n_chars > 20000")}
_DOC = """WITH r AS (SELECT lang, md5(text) AS h FROM {documents} GROUP BY 1, 2 HAVING count(*) > 1),
    d AS (SELECT d.*, EXISTS (SELECT 1 FROM r WHERE r.lang = d.lang AND r.h = md5(d.text)) AS rep FROM {documents} d)"""


@query("p1_error_floor", _DOC + " " + " UNION ALL ".join(
    [f"SELECT '{f}' AS field, '{n}' AS detector, count(*) FILTER ({c}) AS n_wrong, round(count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE), 6) AS share FROM d" for n, (f, c) in _HIT.items()]
    + [f"SELECT '{f}', 'any', count(*) FILTER ({' OR '.join('(' + c + ')' for g, c in _HIT.values() if g == f)}), "
       f"round(count(*) FILTER ({' OR '.join('(' + c + ')' for g, c in _HIT.values() if g == f)}) / CAST(count(*) AS DOUBLE), 6) FROM d" for f in ("text", "source", "n_chars")]))
def p1(t):
    return R6(E.error_floor(E.repeated(t.documents, "text", ["lang"]), _detectors()), "share")


@query("p2_disagreement", " UNION ALL ".join(f"""SELECT '{c}' AS field, count(*) AS n, count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) AS n_different,
    round(count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) / CAST(count(*) AS DOUBLE), 6) AS rate FROM {{documents}} a JOIN {{second_read}} b ON a.doc_id = b.doc_id""" for c in ("lang", "source", "n_chars")))
def p2(t):
    return R6(E.disagreement(t.documents, t.second_read, "doc_id", ["lang", "source", "n_chars"]), "rate")


_CLASS = r"""CASE WHEN text IS NULL OR length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 'empty' WHEN length(trim(text)) < 20 THEN 'short'
    WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / CAST(length(regexp_replace(text, '\s', '', 'g')) AS DOUBLE) < 0.6 THEN 'garbled' ELSE 'ok' END"""


@query("p3_read_class", f"SELECT source, {_CLASS} AS class, count(*) AS n FROM {{documents}} GROUP BY 1, 2".replace("{L}", "{L}"))
def p3(t):
    return spread(t.documents.select("source", "text")).groupBy("source", E.read_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("p4_rate_by_category", _DOC + """ SELECT lang, count(*) AS n, round(avg(CASE WHEN rep THEN 1.0 ELSE 0 END), 6) AS rate,
    round(avg(CASE WHEN rep THEN 1.0 ELSE 0 END) - (SELECT avg(CASE WHEN rep THEN 1.0 ELSE 0 END) FROM d), 6) AS above_overall FROM d GROUP BY 1""")
def p4(t):
    return R6(E.rate_by_category(E.repeated(t.documents, "text", ["lang"]), F.col("_repeated"), "lang"), "rate", "above_overall")


@query("p5_soundness", """SELECT 'lang' AS field, round(count(lang) / CAST(count(*) AS DOUBLE), 6) AS fill, round(count(*) FILTER (lang IN ('en', 'fr', 'de', 'es')) / CAST(count(*) AS DOUBLE), 6) AS sound FROM {second_read}
    UNION ALL SELECT 'source', round(count(source) / CAST(count(*) AS DOUBLE), 6), round(count(source) / CAST(count(*) AS DOUBLE), 6) FROM {second_read}""")
def p5(t):
    return R6(E.soundness(t.second_read, {"lang": ~F.col("lang").isin("en", "fr", "de", "es"), "source": ~F.col("source").rlike("^src[0-9]+$")}), "fill", "sound")


@query("p6_closeness", "SELECT lang, round(avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS ratio, round(-abs(avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0 END) - 0.5), 6) AS score FROM {documents} GROUP BY 1")
def p6(t):
    g = t.documents.groupBy("lang").agg(F.avg((F.col("doc_id") % 2 == 0).cast("double")).alias("ratio"))
    return R6(g.withColumn("score", E.closeness(F.col("ratio"), 0.5)), "ratio", "score")


_ROUTE = """WITH r AS (SELECT lang, md5(text) AS h FROM {documents} GROUP BY 1, 2 HAVING count(*) > 1),
    d AS (SELECT EXISTS (SELECT 1 FROM r WHERE r.lang = d.lang AND r.h = md5(d.text)) AS a, d.lang <> s.lang AS b, d.n_chars < 100 AS c, l.quality = 0 AS t
      FROM {documents} d JOIN {second_read} s ON d.doc_id = s.doc_id LEFT JOIN {labels} l ON d.doc_id = l.doc_id)"""


def _route_sql(name, cond, alone, cost):
    return f"""SELECT '{name}' AS detector, count(*) FILTER ({cond}) AS n_flagged, round(count(*) FILTER ({cond}) / CAST(count(*) AS DOUBLE), 6) AS volume, count(*) FILTER ({alone}) AS n_only_this,
      round(count(*) FILTER (({cond}) AND t) / CAST(nullif(count(*) FILTER (({cond}) AND t IS NOT NULL), 0) AS DOUBLE), 6) AS precision,
      round(count(*) FILTER (({cond}) AND t) / CAST(count(*) FILTER (t) AS DOUBLE), 6) AS recall, round({cost} / (count(*) * 3.0), 6) AS cost_share FROM d"""


@query("p7_escalation_router", _ROUTE + _route_sql("repeated", "a", "a AND NOT b AND NOT c", "count(*) FILTER (a) * 1.0") + " UNION ALL "
       + _route_sql("disagrees", "b", "b AND NOT a AND NOT c", "count(*) FILTER (b) * 0.5") + " UNION ALL " + _route_sql("tiny", "c", "c AND NOT a AND NOT b", "count(*) FILTER (c) * 1.0")
       + " UNION ALL " + _route_sql("any", "a OR b OR c", "a OR b OR c", "(count(*) FILTER (a) * 1.0 + count(*) FILTER (b) * 0.5 + count(*) FILTER (c) * 1.0)"))
def p7(t):
    d = E.repeated(t.documents, "text", ["lang"]).drop("text").join(t.second_read.select("doc_id", F.col("lang").alias("lang2")), "doc_id").join(
        t.labels.select("doc_id", "quality"), "doc_id", "left")
    r = E.route(d, "doc_id", {"repeated": F.col("_repeated"), "disagrees": F.col("lang") != F.col("lang2"), "tiny": F.col("n_chars") < 100},
                F.col("quality") == 0, {"repeated": 1.0, "disagrees": 0.5, "tiny": 1.0}, 3.0)
    return R6(r, "volume", "precision", "recall", "cost_share")


@query("p8_falsification", """WITH d AS (SELECT n_chars < 400 AS f, lang = 'fr' AS g, regexp_matches(text, '[0-9]{5}') AS bad FROM {documents})
    SELECT 'short' AS detector, round(avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (f), 6) AS inside, round(avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (NOT f), 6) AS outside,
      round(CASE WHEN avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (NOT f) > 0 THEN avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (f) / avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (NOT f) END, 6) AS ratio FROM d
    UNION ALL SELECT 'french', round(avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (g), 6), round(avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (NOT g), 6),
      round(CASE WHEN avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (NOT g) > 0 THEN avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (g) / avg(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (NOT g) END, 6) FROM d""")
def p8(t):
    r = E.falsification(t.documents, {"short": F.col("n_chars") < 400, "french": F.col("lang") == "fr"}, F.col("text").rlike("[0-9]{5}"))
    return R6(r, "inside", "outside", "ratio")


@query("p9_aggregate_plausibility", """WITH c AS (SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 8000 THEN 'huge' ELSE 'mid' END AS k FROM {documents})
    SELECT lang, count(*) AS n, 'short' AS category, round(avg(CASE WHEN k = 'short' THEN 1.0 ELSE 0 END), 6) AS share, CAST(0.2 AS DOUBLE) AS ceiling, avg(CASE WHEN k = 'short' THEN 1.0 ELSE 0 END) > 0.2 AS implausible FROM c GROUP BY 1
    UNION ALL SELECT lang, count(*), 'huge', round(avg(CASE WHEN k = 'huge' THEN 1.0 ELSE 0 END), 6), 0.05, avg(CASE WHEN k = 'huge' THEN 1.0 ELSE 0 END) > 0.05 FROM c GROUP BY 1""")
def p9(t):
    k = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") > 8000, "huge").otherwise("mid")
    return R6(E.aggregate_plausibility(t.documents, k, {"short": 0.2, "huge": 0.05}, ["lang"]), "share")


@query("p10_guarded_repair", """WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'ring', 'rings') ELSE replace(p_name, 'red', 'tan') END AS n FROM {part})
    SELECT p_partkey, CASE WHEN length(n) = length(p_name) THEN n ELSE p_name END AS fixed, n <> p_name AND length(n) <> length(p_name) AS fixed_declined FROM r""")
def p10(t):
    new = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit("ring"), F.lit("rings"))).otherwise(F.replace("p_name", F.lit("red"), F.lit("tan")))
    return E.guarded_repair(t.part, "p_name", new, "fixed").select("p_partkey", "fixed", "fixed_declined")


# ---- measurement -------------------------------------------------------------------------------------------

ITEMS = ["i1", "i2", "i3", "i4"]


def _sumvar(items):
    return f"var_samp({' + '.join(items)})", " + ".join(f"var_samp({i})" for i in items)


def _alpha_sql(name, items, item=None):
    v, s = _sumvar(items)
    r = f"round(corr({item}, {' + '.join(items)}), 6)" if item else "CAST(NULL AS DOUBLE)"
    k = len(items)
    return f"SELECT '{name}' AS item, round({k} / {k - 1}.0 * (1 - ({s}) / ({v})), 6) AS alpha, {r} AS item_rest_corr, count(*) AS n FROM {{items}}"


@query("q1_cronbach_alpha", " UNION ALL ".join([_alpha_sql("all", ITEMS)] + [_alpha_sql(i, [j for j in ITEMS if j != i], i) for i in ITEMS]))
def q1(t):
    return R6(M.cronbach_alpha(t.items, ITEMS), "alpha", "item_rest_corr")


@query("q2_mcdonald_omega")
def q2(t):
    return M.mcdonald_omega(t.items, ITEMS)


@query("q3_confusion", "SELECT c1 AS a, c2 AS b, count(*) AS n FROM {coders} WHERE c1 IS NOT NULL AND c2 IS NOT NULL GROUP BY 1, 2")
def q3(t):
    return M.confusion(t.coders, "c1", "c2")


@query("q3_cohen_kappa", """WITH d AS (SELECT c1 AS a, c2 AS b FROM {coders} WHERE c1 IS NOT NULL AND c2 IS NOT NULL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM d),
    e AS (SELECT sum(x.c * y.c) / any_value(n * n) AS pe FROM (SELECT a, count(*) AS c FROM d GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM d GROUP BY 1) y ON x.a = y.b, n)
    SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def q3b(t):
    return R6(M.cohen_kappa(t.coders, "c1", "c2"), "agreement", "expected", "kappa")


_LONG = "l AS (SELECT doc_id AS item, unnest([c1, c2, c3]) AS v FROM {coders}), c AS (SELECT item, v, count(*) AS c FROM l WHERE v IS NOT NULL GROUP BY 1, 2)"


@query("q4_fleiss_kappa", "WITH " + _LONG + """, i AS (SELECT item, sum(c) AS m, sum(c * (c - 1)) AS s FROM c GROUP BY 1 HAVING sum(c) = 3), o AS (SELECT count(*) AS n, avg(s / 6.0) AS po FROM i),
    p AS (SELECT v, CAST(sum(c) AS DOUBLE) AS c FROM c WHERE item IN (SELECT item FROM i) GROUP BY 1), e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM p)
    SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM o, e""")
def q4(t):
    return R6(M.fleiss_kappa(M.codes_long(t.coders, "doc_id", ["c1", "c2", "c3"])), "observed", "expected", "kappa")


@query("q5_krippendorff_alpha", "WITH " + _LONG + """, m AS (SELECT item, sum(c) AS m FROM c GROUP BY 1 HAVING sum(c) >= 2), k AS (SELECT c.*, m FROM c JOIN m ON c.item = m.item),
    pr AS (SELECT a.v AS x, b.v AS y, sum(CASE WHEN a.v = b.v THEN a.c * (a.c - 1) ELSE a.c * b.c END / (a.m - 1.0)) AS o FROM k a JOIN k b ON a.item = b.item GROUP BY 1, 2),
    nc AS (SELECT v, CAST(sum(c) AS DOUBLE) AS n FROM k GROUP BY 1), t AS (SELECT sum(n) AS n FROM nc)
    SELECT 'nominal' AS scale, CAST(NULL AS DOUBLE) AS category, round(1 - (n - 1) * (SELECT sum(o) FROM pr WHERE x <> y) / (SELECT sum(a.n * b.n) FROM nc a, nc b WHERE a.v <> b.v), 6) AS alpha FROM t
    UNION ALL SELECT 'interval', NULL, round(1 - (n - 1) * (SELECT sum(o * (x - y) * (x - y)) FROM pr) / (SELECT sum(a.n * b.n * (a.v - b.v) * (a.v - b.v)) FROM nc a, nc b), 6) FROM t
    UNION ALL SELECT 'nominal', CAST(nc.v AS DOUBLE), round(1 - (t.n - 1) * (SELECT sum(o) FROM pr WHERE (x = nc.v) <> (y = nc.v)) / (2 * nc.n * (t.n - nc.n)), 6) FROM nc, t""")
def q5(t):
    return R6(M.krippendorff_alpha(M.codes_long(t.coders, "doc_id", ["c1", "c2", "c3"])), "alpha")


_RATE = "SELECT l_orderkey, avg(l_quantity) AS r1, avg(l_quantity) + avg(l_discount) * 20 AS r2, max(l_quantity) AS r3 FROM {lineitem} GROUP BY 1"


@query("q6_icc", "WITH w AS (" + _RATE + """), l AS (SELECT l_orderkey AS item, 1 AS c, r1 AS v FROM w UNION ALL SELECT l_orderkey, 2, r2 FROM w UNION ALL SELECT l_orderkey, 3, r3 FROM w),
    g AS (SELECT avg(v) AS gm, count(*) / 3.0 AS n FROM l), r AS (SELECT sum(3 * (m - gm) * (m - gm)) AS ssr FROM (SELECT avg(v) AS m FROM l GROUP BY item), g),
    c AS (SELECT sum(n * (m - gm) * (m - gm)) AS ssc FROM (SELECT avg(v) AS m FROM l GROUP BY c), g), t AS (SELECT sum((v - gm) * (v - gm)) AS sst FROM l, g),
    ms AS (SELECT n, ssr / (n - 1) AS msr, ssc / 2 AS msc, (sst - ssr - ssc) / (2 * (n - 1)) AS mse, (sst - ssr) / (2 * n) AS msw FROM g, r, c, t)
    SELECT CAST(n AS BIGINT) AS n_items, round((msr - msw) / (msr + 2 * msw), 6) AS icc1, round((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / n), 6) AS icc2, round((msr - mse) / (msr + 2 * mse), 6) AS icc3 FROM ms""")
def q6(t):
    return R6(M.icc(M.codes_long(t.sql(_RATE), "l_orderkey", ["r1", "r2", "r3"])), "icc1", "icc2", "icc3")


_HALVES = "SELECT l_orderkey, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS x, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS y FROM {lineitem} GROUP BY 1"


@query("q7_retest", "WITH h AS (" + _HALVES + ") SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(2 * corr(x, y) / (1 + corr(x, y)), 6) AS stepped_up FROM h WHERE x IS NOT NULL AND y IS NOT NULL")
def q7(t):
    h = t.sql(_HALVES)
    return R6(M.retest(h.select("l_orderkey", F.col("x").alias("q")), h.select("l_orderkey", F.col("y").alias("q")), "l_orderkey", "q"), "r", "stepped_up")


@query("q8_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM {{items}}" for i, a in enumerate(ITEMS) for b in ITEMS[i + 1:]))
def q8(t):
    return R6(M.correlation_matrix(t.items, ITEMS), "r")


@query("q8_known_groups", """WITH d AS (SELECT n_chars, quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id)
    SELECT 'n_chars' AS "column", round(avg(n_chars) FILTER (quality = 0), 6) AS mean_control, round(avg(n_chars) FILTER (quality = 1), 6) AS mean_treated,
    round((avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0)) / sqrt((var_samp(n_chars) FILTER (quality = 0) + var_samp(n_chars) FILTER (quality = 1)) / 2), 6) AS std_diff FROM d""")
def q8b(t):
    return R6(M.known_groups(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id"), "quality", ["n_chars"]), "mean_control", "mean_treated", "std_diff")


_WILSON = """SELECT {g} AS "group", n, round(p, 6) AS accuracy, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS lo,
    round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS hi, CAST(ceil(p * (1 - p) * power(z / 0.05, 2)) AS BIGINT) AS n_needed"""


@query("q9_label_accuracy", "WITH d AS (SELECT lang, CASE WHEN c1 = c2 THEN 1.0 ELSE 0 END AS ok FROM {coders} c JOIN {documents} d ON c.doc_id = d.doc_id WHERE c1 IS NOT NULL AND c2 IS NOT NULL), "
       "g AS (SELECT lang AS g, count(*) AS n, avg(ok) AS p, 1.959964 AS z FROM d GROUP BY 1 UNION ALL SELECT 'all', count(*), avg(ok), 1.959964 FROM d) " + _WILSON.replace("{g}", "g") + " FROM g")
def q9(t):
    d = t.coders.join(t.documents.select("doc_id", "lang"), "doc_id")
    return R6(M.label_accuracy(d, "c1", "c2", "lang"), "accuracy", "lo", "hi")


@query("q10_perturbation", """SELECT lang, count(*) AS n, count(*) FILTER (a.c1 <> a.c3) AS n_flipped, round(avg(CASE WHEN a.c1 <> a.c3 THEN 1.0 ELSE 0 END), 6) AS failure_rate
    FROM {coders} a JOIN {documents} d ON a.doc_id = d.doc_id WHERE c1 IS NOT NULL AND c3 IS NOT NULL GROUP BY 1""")
def q10(t):
    base = t.coders.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("c1").alias("label"))
    return R6(M.perturbation_test(base, t.coders.select("doc_id", F.col("c3").alias("label")), "doc_id", "label", "lang"), "failure_rate")


@query("q10_directional", """SELECT 'up' AS toward, count(*) AS n, count(*) FILTER (machine <> quality) AS n_flipped, round(avg(CASE WHEN quality <= machine THEN 1.0 ELSE 0 END), 6) AS failure_rate FROM {surrogate}""")
def q10b(t):
    s = t.surrogate.withColumn("toward", F.lit("up"))
    return R6(M.perturbation_test(s.select("doc_id", "toward", F.col("machine").alias("label")), s.select("doc_id", F.col("quality").alias("label")), "doc_id", "label", "toward", "up"), "failure_rate")


@query("q11_corrected_mean", """WITH d AS (SELECT machine, gold, machine + coalesce((gold - machine) / 0.25, 0.0) AS c FROM {surrogate})
    SELECT count(*) AS n, count(gold) AS n_gold, round(avg(machine), 6) AS naive, round(avg(c), 6) AS corrected, round(stddev_samp(c) / sqrt(count(*)), 6) AS se FROM d""")
def q11(t):
    return R6(M.corrected_mean(t.surrogate, "machine", "gold", 0.25), "naive", "corrected", "se")


@query("q11_corrected_regression", """WITH d AS (SELECT toxic AS x, machine + coalesce((gold - machine) / 0.25, 0.0) AS y FROM {surrogate}), m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, count(*) AS n, regr_sxx(y, x) AS sxx FROM d)
    SELECT 'toxic' AS param, round(any_value(b), 6) AS estimate, round(sqrt(sum(power((x - mx) * (y - my - b * (x - mx)), 2)) / any_value(sxx * sxx) * any_value(n) / (any_value(n) - 2)), 6) AS se FROM d, m""")
def q11b(t):
    return R6(M.corrected_regression(t.surrogate, "machine", "gold", 0.25, ["toxic"]).select("param", "estimate", "se"), "estimate", "se")


@query("q12_hajek_mean", "SELECT count(*) AS n_sampled, round(sum(o_totalprice / pi) / sum(1 / pi), 4) AS hajek, round(avg(o_totalprice), 4) AS unweighted, round(sum(1 / pi), 4) AS estimated_population FROM {sampled}")
def q12(t):
    s = t.sampled.withColumn("pi", F.col("pi").cast("double"))
    return M.hajek_mean(s, "o_totalprice", "pi").withColumns({c: F.round(c, 4) for c in ("hajek", "unweighted", "estimated_population")})


@query("q13_item_moments", " UNION ALL ".join(f"""SELECT o_orderstatus, year(o_orderdate) AS yr, '{i}' AS item, count({i}) AS n, round(avg({i}), 6) AS mean, round(stddev_samp({i}), 6) AS sd, round(avg(CASE WHEN {i} <> 0 THEN 1.0 ELSE 0 END), 6) AS prevalence
    FROM {{items}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY 1, 2""" for i in ITEMS))
def q13(t):
    d = t.items.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("yr", F.year("o_orderdate").cast("long"))
    return R6(M.item_moments(d, ITEMS, ["o_orderstatus", "yr"]), "mean", "sd", "prevalence")


@query("q13_component_shares", "WITH d AS (SELECT i.*, o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AS p FROM {items} i JOIN {orders} ON l_orderkey = o_orderkey), c AS (SELECT "
       + ", ".join(f"avg({i}) FILTER (p) - avg({i}) FILTER (NOT p) AS {i}" for i in ITEMS) + " FROM d) " + " UNION ALL ".join(
           f"SELECT '{i}' AS item, round({i}, 6) AS change, round({i} / ({' + '.join(ITEMS)}), 6) AS share FROM c" for i in ITEMS))
def q13b(t):
    d = t.items.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return R6(M.component_shares(d, ITEMS, F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")), "change", "share")


# ---- prose ------------------------------------------------------------------------------------------------

_SAFE = ["significance", "vocabulary", "promotion", "filler", "hyphen_pairs", "authority", "bold", "curly_quotes", "dashes"]
_OWN = "regexp_replace(text, '\"[^\"\\n]*\"|“[^”\\n]*”|(?m)^>.*$', ' ', 'g')"


def _tell_sql(key, table):
    parts = []
    for f in _SAFE:
        pat = P.TELLS[f].replace("'", "''")
        parts.append(f"SELECT {key}, '{f}' AS family, CAST(len(regexp_extract_all(lower({_OWN}), '{pat}')) AS INT) AS n, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS words FROM {{{table}}}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") q WHERE n > 0"


@query("r1_tell_counts", _tell_sql("doc_id", "documents"))
def r1(t):
    return P.tell_counts(t.documents, ["doc_id"], "text", _SAFE)


@query("r1_tell_counts_all_families")
def r1b(t):
    return P.tell_counts(t.documents, ["doc_id"], "text").groupBy("family").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


@query("r2_tell_clusters")
def r2(t):
    return P.tell_clusters(t.conversations, ["conv_id", "turn"], "text", 2)


@query("r3_sentence_rhythm", r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[.!?]+(\s+|$)'), lambda x: length(trim(x)) > 0) AS s FROM {documents}),
    l AS (SELECT doc_id, list_transform(s, lambda x: len(regexp_extract_all(x, '\S+'))) AS l FROM s),
    m AS (SELECT doc_id, l, array_to_string(list_transform(l, lambda x: CASE WHEN x <= 4 THEN 'S' ELSE 'L' END), '') AS m FROM l),
    r AS (SELECT doc_id, l, coalesce(list_max(list_transform(regexp_extract_all(m, 'S+'), lambda x: length(x))), 0) AS run FROM m)
    SELECT doc_id, CAST(len(l) AS INT) AS sentences, round(list_avg(l), 6) AS mean_words, round(list_stddev_samp(l), 6) AS sd_words, CAST(run AS INT) AS longest_short_run, run >= 3 AS staccato FROM r""")
def r3(t):
    return R6(P.sentence_rhythm(t.documents, ["doc_id"], "text"), "mean_words", "sd_words")


@query("r4_catalogue_violations", """WITH c AS (SELECT * FROM {catalogue}) SELECT folder, name, 'name missing' AS rule FROM c WHERE name = ''
    UNION ALL SELECT folder, name, 'name not lower-case letters, digits and hyphens' FROM c WHERE name <> '' AND NOT regexp_matches(name, '^[a-z0-9-]+$')
    UNION ALL SELECT folder, name, 'name contains reserved word admin' FROM c WHERE name <> '' AND contains(lower(name), 'admin')
    UNION ALL SELECT folder, name, 'name differs from folder' FROM c WHERE name <> '' AND name <> folder
    UNION ALL SELECT folder, name, 'description missing' FROM c WHERE description = ''
    UNION ALL SELECT folder, name, 'description longer than 200' FROM c WHERE length(description) > 200
    UNION ALL SELECT folder, name, 'description contains a tag' FROM c WHERE regexp_matches(description, '<[^>]+>')
    UNION ALL SELECT folder, name, 'name longer than 64' FROM c WHERE length(name) > 64""")
def r4(t):
    return P.catalogue_violations(t.catalogue, "folder", "name", "description", ["admin"])


@query("r5_repeated_claims", """WITH c AS (SELECT lower(regexp_extract(text, 'total for (\\w+) is ([0-9,]+)', 1)) AS name, CAST(replace(regexp_extract(text, 'total for (\\w+) is ([0-9]+)', 2), ',', '') AS DOUBLE) AS value FROM {claims})
    SELECT name, count(DISTINCT value) AS n_values, count(*) AS n_claims, min(value) AS lowest, max(value) AS highest FROM c GROUP BY 1 HAVING count(DISTINCT value) > 1""")
def r5(t):
    return P.repeated_claims(t.claims, "doc_id", "text", r"total for (\w+) is (\d[\d,]*\d|\d)")


# ---- vectors ---------------------------------------------------------------------------------------------------

def _vec_sql(score, up, k, qcond="q.vec_id IN (SELECT min(vec_id) FROM {embeddings} GROUP BY label)", cond="true"):
    return f"""SELECT q.vec_id AS query_id, b.vec_id, round({score}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {'DESC' if up else 'ASC'}, b.vec_id) AS INT) AS rank
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {{embeddings}}) q, (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {{embeddings}}) b WHERE {qcond} AND {cond}
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {'DESC' if up else 'ASC'}, b.vec_id) <= {k}"""


COS, EUC, DOT = "list_cosine_similarity(q.v, b.v)", "list_distance(q.v, b.v)", "list_inner_product(q.v, b.v)"


def _q(t):
    # one query per label: its first vector
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return t.embeddings.join(first, "vec_id", "left_semi")


@query("v1_cosine_top_k", _vec_sql(COS, True, 10))
def v1(t):
    return R6(V.top_k(t.embeddings, _q(t), "vec_id", "embedding", 10), "score")


@query("v1_euclidean_top_k", _vec_sql(EUC, False, 10))
def v1b(t):
    return R6(V.top_k(t.embeddings, _q(t), "vec_id", "embedding", 10, "euclidean"), "score")


@query("v1_dot_top_k", _vec_sql(DOT, True, 100))
def v1c(t):
    return R6(V.top_k(t.embeddings, _q(t), "vec_id", "embedding", 100, "dot-product"), "score")


@query("v2_query_by_id", _vec_sql(COS, True, 5, "q.vec_id IN (SELECT max(vec_id) FROM {embeddings} GROUP BY label)", "q.vec_id <> b.vec_id"))
def v2(t):
    ids = [r["i"] for r in t.embeddings.groupBy("label").agg(F.max("vec_id").alias("i")).collect()]
    return R6(V.query_by_id(t.embeddings, ids, "vec_id", "embedding", k=5, drop_self=True), "score")


@query("v3_filtered_search", _vec_sql(COS, True, 5, cond="b.label IN (1, 2, 3)"))
def v3(t):
    return R6(V.top_k(t.embeddings.where(F.col("label").isin(1, 2, 3)), _q(t), "vec_id", "embedding", 5), "score")


@query("v4_threshold_search", _vec_sql(COS, True, 10, cond=f"{COS} >= 0.3"))
def v4(t):
    return R6(V.search(t.embeddings, _q(t), "vec_id", "embedding"), "score")


@query("v5_describe_index", "SELECT count(*) AS n, CAST(min(len(embedding)) AS INT) AS dimensions, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN 'pass' ELSE 'fail' END AS status FROM {embeddings}")
def v5(t):
    return V.describe_index(t.embeddings, "embedding")


@query("v5_get_and_delete", """SELECT 'kept' AS what, count(*) AS n FROM {embeddings} WHERE vec_id NOT IN (SELECT doc_id FROM {labels})
    UNION ALL SELECT 'fetched', count(*) FROM {embeddings} WHERE vec_id IN (SELECT doc_id FROM {labels})""")
def v5b(t):
    ids = t.labels.select(F.col("doc_id").alias("vec_id"))
    a = V.delete_by_ids(t.embeddings, ids, "vec_id").agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n")
    return a.unionByName(V.get_by_ids(t.embeddings, ids, "vec_id").agg(F.count("*").alias("n")).select(F.lit("fetched").alias("what"), "n"))


# ---- experiments ------------------------------------------------------------------------------------------------

_B = "CAST('0x' || substr(md5('flag:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"


@query("x1_rollout", f"""SELECT event_id, CASE WHEN event_type = 'purchase' AND user_id > 20 AND {_B} < 50 THEN 'beta' WHEN {_B} < 30 THEN 'a' WHEN {_B} < 70 THEN 'b' WHEN {_B} < 100 THEN 'c' ELSE 'off' END AS variation FROM {{events}}""")
def x1(t):
    rules = [(1, (F.col("event_type") == "purchase") & (F.col("user_id") > 20), 50, "beta"), (2, F.lit(True), 30, "a"), (3, F.lit(True), 70, "b"), (4, F.lit(True), 100, "c")]
    return t.events.select("event_id", X.assign_variation(F.col("user_id"), rules, "off", "flag:").alias("variation"))


@query("x2_delivery_rates", """WITH g AS (SELECT count(*) AS n, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) AS d, avg(CASE WHEN event_type = 'error' AND value > 30 THEN 1.0 ELSE 0 END) AS h, avg(CASE WHEN event_type = 'signup' AND value > 60 THEN 1.0 ELSE 0 END) AS c FROM {events})
    SELECT n, 'delivery_rate' AS metric, round(d, 6) AS rate, CAST(0.95 AS DOUBLE) AS target, CASE WHEN d > 0.95 THEN 'ok' ELSE 'out of range' END AS verdict FROM g
    UNION ALL SELECT n, 'hard_bounce_rate', round(h, 6), 0.02, CASE WHEN h < 0.02 THEN 'ok' ELSE 'out of range' END FROM g UNION ALL SELECT n, 'complaint_rate', round(c, 6), 0.001, CASE WHEN c < 0.001 THEN 'ok' ELSE 'out of range' END FROM g""")
def x2(t):
    k, v = F.col("event_type"), F.col("value")
    return R6(X.delivery_rates(t.events, k != "error", (k == "error") & (v > 30), (k == "signup") & (v > 60)), "rate")


_METRIC = "CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'error' THEN 'CLS' WHEN 'signup' THEN 'TTFB' END"


@query("x3_timing_ratings", f"""WITH d AS (SELECT {_METRIC} AS metric, CASE event_type WHEN 'error' THEN value / 100 ELSE value * 60 END AS v FROM {{events}} WHERE event_type <> 'purchase'),
    r AS (SELECT metric, CASE WHEN v < CASE metric WHEN 'LCP' THEN 2500 WHEN 'INP' THEN 200 WHEN 'CLS' THEN 0.1 ELSE 800 END THEN 'good'
      WHEN v <= CASE metric WHEN 'LCP' THEN 4000 WHEN 'INP' THEN 500 WHEN 'CLS' THEN 0.25 ELSE 1800 END THEN 'needs improvement' ELSE 'poor' END AS rating FROM d)
    SELECT metric, rating, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY metric) AS DOUBLE), 6) AS share FROM r GROUP BY 1, 2""")
def x3(t):
    d = t.events.where("event_type <> 'purchase'")
    m = F.when(F.col("event_type") == "view", "LCP").when(F.col("event_type") == "click", "INP").when(F.col("event_type") == "error", "CLS").otherwise("TTFB")
    return R6(X.rate_timing(d, m, F.when(F.col("event_type") == "error", F.col("value") / 100).otherwise(F.col("value") * 60)), "share")


@query("x4_timing_rounds", """WITH r AS (SELECT round, avg(seconds) FILTER (arm = 'a') AS a, avg(seconds) FILTER (arm = 'a2') AS a2, avg(seconds) FILTER (arm = 'b') AS b FROM {timings} GROUP BY 1)
    SELECT 'A/A' AS comparison, count(a2 / a) AS rounds, round(median(a2 / a), 6) AS median_ratio, count(*) FILTER (a2 < a) AS rounds_won FROM r
    UNION ALL SELECT 'A/B', count(b / a), round(median(b / a), 6), count(*) FILTER (b < a) FROM r""")
def x4(t):
    return R6(X.timing_rounds(t.timings, "round", "arm", "seconds"), "median_ratio")


NOW = "2024-06-01 00:00:00"


@query("x5_suppression", f"""SELECT c_custkey, address FROM {{addresses}} WHERE lower(address) NOT IN (SELECT lower(address) FROM {{suppression}} WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')""")
def x5(t):
    return X.suppress(t.addresses, "address", t.suppression, F.lit(NOW).cast("timestamp"))


@query("x5_suppressed_by_reason", f"""SELECT reason, count(*) AS n FROM {{addresses}} a JOIN {{suppression}} s ON lower(a.address) = lower(s.address) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}' GROUP BY 1""")
def x5b(t):
    return X.suppressed_by_reason(t.addresses, "address", t.suppression, F.lit(NOW).cast("timestamp"))
