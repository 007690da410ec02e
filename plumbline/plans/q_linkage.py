"""Registered queries: record linkage, deduplication and number provenance."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import linkage as K
from plumbline.operators import provenance as P
from plumbline.plans.registry import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
COMPS = [K.Comparison("name", "jaro_winkler", 2.0), K.Comparison("size", "exact", 1.0)]
XWALK = {"Brand-1": "Brand#1"}


def _sides(t):
    return t.link_left, K.apply_crosswalk(t.link_right, "block", XWALK)


@query("c15_normalisers", r"""SELECT p_partkey, trim(regexp_replace(n, '\s+', ' ', 'g')) AS strict, regexp_replace(trim(regexp_replace(regexp_replace(lower(n), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g')), '\bgizmo\b', 'gadget', 'g') AS loose
    FROM (SELECT p_partkey, '  ' || upper(p_name) || ' -  ' || p_type || '/' || p_brand || '.' AS n FROM {part}) q""")
def c15(t):
    n = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" -  "), "p_type", F.lit("/"), "p_brand", F.lit("."))
    return t.part.select("p_partkey", S.strict_key(n).alias("strict"), S.loose_key(n, {"gizmo": "gadget"}).alias("loose"))


_R = "r AS (SELECT rid, CASE WHEN block = 'Brand-1' THEN 'Brand#1' ELSE block END AS block, name, size FROM {link_right}), l AS (SELECT * FROM {link_left})"


@query("c16_blocking", "WITH " + _R + """, c AS (SELECT l.block, x.n * y.n AS p FROM (SELECT block, count(*) AS n FROM l GROUP BY 1) x JOIN (SELECT block, count(*) AS n FROM r GROUP BY 1) y ON x.block = y.block JOIN (SELECT DISTINCT block FROM l) l ON l.block = x.block)
    SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, (SELECT count(*) FROM l WHERE block IS NULL) AS left_null_block, (SELECT count(*) FROM r WHERE block IS NULL) AS right_null_block,
      CAST(sum(p) AS BIGINT) AS candidates, CAST(max(p) AS BIGINT) AS largest_block, round(1 - sum(p) / (CAST((SELECT count(*) FROM l) AS DOUBLE) * (SELECT count(*) FROM r)), 6) AS reduction FROM c""")
def c16(t):
    a, b = _sides(t)
    return R6(K.block_summary(a, b, "block"), "reduction")


_SC = "WITH " + _R + """, s AS (SELECT l.lid AS left_id, r.rid AS right_id, (2 * jaro_winkler_similarity(l.name, r.name) + CASE WHEN l.size = r.size THEN 1 ELSE 0 END) / (2 + CASE WHEN l.size IS NULL OR r.size IS NULL THEN 0 ELSE 1 END) AS score
    FROM l JOIN r ON l.block = r.block), k AS (SELECT * FROM s WHERE score >= 0.85)"""


@query("c17_pair_scores", _SC + " SELECT left_id, right_id, round(score, 6) AS score FROM k")
def c17(t):
    a, b = _sides(t)
    return R6(K.score_pairs(a, b, "lid", "rid", "block", COMPS, 0.85), "score")


@query("c17_candidates", _SC + """ SELECT (SELECT count(*) FROM s) AS in_blocks, (SELECT count(*) FROM l JOIN r ON l.block = r.block WHERE l.size = r.size OR l.size IS NULL OR r.size IS NULL) AS keyed,
    (SELECT count(*) FROM k) AS scored, true AS bounded""")
def c17b(t):
    a, b = _sides(t)
    scored = K.score_pairs(a, b, "lid", "rid", "block", COMPS, 0.85).agg(F.count(F.lit(1)).alias("scored"))
    out = K.candidate_report(a, b, "lid", "rid", "block", COMPS, 0.85).join(F.broadcast(scored))
    return out.select("in_blocks", "keyed", "scored", ((F.col("compared") >= F.col("scored")) & (F.col("compared") <= F.col("keyed"))).alias("bounded"))


def _closeness(a, b):
    """Share of the smaller number in the larger."""
    x, y = np.array(a, dtype=float), np.array(b, dtype=float)
    return np.minimum(x, y) / np.maximum(x, y)


@query("l1_user_score", "WITH " + _R + """, s AS (SELECT l.lid AS left_id, r.rid AS right_id, (2 * jaro_winkler_similarity(l.name, r.name) + CASE WHEN l.size IS NULL OR r.size IS NULL THEN 0 ELSE least(l.size, r.size) / CAST(greatest(l.size, r.size) AS DOUBLE) END)
      / (2 + CASE WHEN l.size IS NULL OR r.size IS NULL THEN 0 ELSE 1 END) AS score FROM l JOIN r ON l.block = r.block)
    SELECT 'L' || CAST(left_id AS VARCHAR) AS left_id, 'R' || CAST(right_id AS VARCHAR) AS right_id, round(score, 6) AS score FROM s WHERE score >= 0.9""")
def l1(t):
    a, b = _sides(t)
    a, b = a.withColumn("lid", F.concat(F.lit("L"), "lid")), b.withColumn("rid", F.concat(F.lit("R"), "rid"))
    return R6(K.score_pairs(a, b, "lid", "rid", "block", [K.Comparison("name", "jaro_winkler", 2.0), K.Comparison("size", "user", 1.0, _closeness)], 0.9), "score")


_FI = _SC + """, t AS (SELECT left_id, max(score) AS best, max(CASE WHEN rn = 2 THEN score END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rn FROM k) q WHERE rn <= 2 GROUP BY 1),
    f AS (SELECT k.* FROM k JOIN t ON k.left_id = t.left_id WHERE second IS NULL OR best - second >= 0.05)"""


@query("c18_filter_margin", _FI + " SELECT left_id, right_id, round(score, 6) AS score FROM f")
def c18(t):
    a, b = _sides(t)
    return R6(K.filter_pairs(K.score_pairs(a, b, "lid", "rid", "block", COMPS, 0.85), 0.85, 0.05), "score")


@query("c19_one_to_one")
def c19(t):
    a, b = _sides(t)
    return K.one_to_one(K.score_pairs(a, b, "lid", "rid", "block", COMPS, 0.8))


@query("c20_multi_pass")
def c20(t):
    a, b = _sides(t)
    return K.multi_pass(a, b, "lid", "rid", "block", COMPS, (0.95, 0.85, 0.70), 0.02)


_TF = """WITH l AS (SELECT min(lid) AS rep, name FROM {link_left} GROUP BY 2), r AS (SELECT min(rid) AS rep, name FROM {link_right} GROUP BY 2),
    x AS (SELECT 'l' AS side, rep, name FROM l UNION ALL SELECT 'r', rep, name FROM r), n AS (SELECT count(*) AS n FROM x),
    tk AS (SELECT DISTINCT side, rep, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS w FROM x), d AS (SELECT w, count(*) AS df FROM tk WHERE w <> '' GROUP BY 1),
    v AS (SELECT side, rep, tk.w, ln(n / CAST(df AS DOUBLE)) + 1 AS x FROM tk JOIN d ON tk.w = d.w, n), z AS (SELECT side, rep, sqrt(sum(x * x)) AS s FROM v GROUP BY 1, 2),
    p AS (SELECT a.rep AS left_rep, b.rep AS right_rep, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.w = b.w WHERE a.side = 'l' AND b.side = 'r' GROUP BY 1, 2)
    SELECT left_rep, right_rep, round(dot / (za.s * zb.s), 6) AS score FROM p JOIN z za ON za.side = 'l' AND za.rep = left_rep JOIN z zb ON zb.side = 'r' AND zb.rep = right_rep WHERE dot / (za.s * zb.s) >= 0.6"""


@query("c21_tfidf_pairs", _TF)
def c21(t):
    return R6(K.tfidf_pairs(t.link_left, t.link_right, "lid", "rid", "name", 0.6), "score")


@query("c21_tfidf_documents")
def c21b(t):
    # exact copies are one text; the rest are compared with each other
    return K.tfidf_pairs(t.documents, t.documents, "doc_id", "doc_id", "text", 0.7).where("left_rep < right_rep")


_M = """, m AS (SELECT left_id, right_id FROM f QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1)"""


def _linked(t):
    a, b = _sides(t)
    marked = K.filter_pairs(K.score_pairs(a, b, "lid", "rid", "block", COMPS, 0.85), 0.85, 0.05, mark=True)
    # the pairs are read once, and one row a left record is stored
    best = F.max(F.when(F.col("kept"), F.struct("score", (-F.col("right_id")).alias("r"))))
    records = K.cut(marked.groupBy("left_id").agg(F.count("*").alias("scored"), F.count_if("kept").alias("filtered"), F.max("unclear").alias("unclear"), best.alias("b")))
    scored, filtered = records.select("left_id", F.col("scored").alias("n"), "unclear"), records.select("left_id", F.col("filtered").alias("n"))
    return a, b, scored, filtered, records.where("b IS NOT NULL").select("left_id", (-F.col("b.r")).alias("right_id"))


@query("c22_funnel", _FI + _M + """ SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, (SELECT count(*) FROM s) AS candidates,
    round(1 - (SELECT count(*) FROM s) / (CAST((SELECT count(*) FROM l) AS DOUBLE) * (SELECT count(*) FROM r)), 6) AS reduction, (SELECT count(*) FROM k) AS scored, (SELECT count(*) FROM f) AS filtered,
    (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM t WHERE second IS NOT NULL AND best - second < 0.05) AS ambiguous_left, (SELECT count(*) FROM l) - (SELECT count(*) FROM m) AS unmatched_left,
    (SELECT count(*) FROM r) - (SELECT count(*) FROM m) AS unmatched_right""")
def c22(t):
    a, b, scored, filtered, best = _linked(t)
    return R6(K.funnel(a, b, "lid", "rid", "block", scored, filtered, best, 0.05), "reduction")


@query("c23_evaluate", _FI + _M + """, tr AS (SELECT p_partkey AS left_id, p_partkey + 5000000 AS right_id FROM {part}),
    j AS (SELECT coalesce(m.left_id, tr.left_id) AS left_id, m.left_id IS NOT NULL AS p, tr.left_id IS NOT NULL AS t FROM m FULL JOIN tr ON m.left_id = tr.left_id AND m.right_id = tr.right_id),
    g AS (SELECT l.block AS grp, count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT p) AS fn FROM j LEFT JOIN l ON j.left_id = l.lid GROUP BY 1),
    a AS (SELECT * FROM g UNION ALL SELECT 'all', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM g)
    SELECT grp AS "group", tp, fp, fn, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0.0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0.0), 6) AS recall,
      round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0.0), 6) AS f1 FROM a""")
def c23(t):
    a, _, _, _, best = _linked(t)
    truth = t.part.select(F.col("p_partkey").alias("left_id"), (F.col("p_partkey") + 5000000).alias("right_id"))
    return R6(K.evaluate(best, truth, a.select(F.col("lid").alias("left_id"), "block"), "block"), "precision", "recall", "f1")


def _line_edges(t):
    """Documents that are equal as a whole, whatever their lines, or share a line too long to be a phrase."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 80)
    return K.shared_key_edges(lines.unionByName(t.documents.select("doc_id", F.col("text").alias("line"))).select("doc_id", F.unhex(F.md5("line")).alias("h")), "doc_id", "h")


_CC = """WITH RECURSIVE ln AS (SELECT DISTINCT doc_id, md5(line) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}) q WHERE length(line) > 80 UNION SELECT doc_id, md5(text) FROM {documents} WHERE text IS NOT NULL),
    e0 AS (SELECT min(doc_id) OVER (PARTITION BY h) AS a, doc_id AS b FROM ln), e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
    w(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON w.node = e.a WHERE w.root < e.b),
    cc AS (SELECT node, min(root) AS component FROM w GROUP BY 1),
    d AS (SELECT doc_id, coalesce(component, doc_id) AS component, CAST(n_chars AS DOUBLE) AS c FROM {documents} LEFT JOIN cc ON doc_id = node),
    r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY c DESC, doc_id) AS rn FROM d),
    t AS (SELECT component, max(CASE WHEN rn = 1 THEN c END) AS c1, max(CASE WHEN rn = 2 THEN c END) AS c2, count(*) AS n FROM r GROUP BY 1),
    x AS (SELECT r.doc_id, r.component, CASE WHEN c2 IS NOT NULL AND c1 - c2 <= 5 THEN 'dropped_indistinguishable' WHEN rn = 1 THEN 'kept' ELSE 'dropped_duplicate' END AS decision, t.n FROM r JOIN t ON r.component = t.component)"""


@query("c24_deduplicate", _CC + " SELECT doc_id, component, decision FROM x")
def c24(t):
    return K.deduplicate(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", _line_edges(t), 5.0)


@query("c24_dedup_report", _CC + """ SELECT count(*) AS original, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'dropped_duplicate') AS dropped_duplicate,
    count(*) FILTER (decision = 'dropped_indistinguishable') AS dropped_indistinguishable, max(n) AS largest_cluster FROM x""")
def c24b(t):
    return K.dedup_report(K.deduplicate(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", _line_edges(t), 5.0))


# ---- provenance -------------------------------------------------------------------------------------------

# Manuscripts read in SQL: paragraphs, their numbers (all, and precise ones), labels, citations and what those lead to.
_PN = r"""WITH ps AS (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS l FROM {manuscripts}), p AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS para, l[i] AS t FROM ps, unnest(range(1, len(l) + 1)) u(i)),
    clean AS (SELECT para, regexp_replace(regexp_replace(t, '\\(?:label|ref|cref|input)\{[^}]*\}', ' ', 'g'), '\\[a-zA-Z]+\d*', ' ', 'g') AS t FROM p),
    tk AS (SELECT para, unnest(regexp_extract_all(t, '-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+')) AS tok FROM clean),
    nv AS (SELECT para, tok, replace(tok, ',', '') AS c, TRY_CAST(replace(tok, ',', '') AS DOUBLE) AS v FROM tk),
    pn AS (SELECT DISTINCT para, v, contains(tok, '.') OR abs(v) >= 100 AS precise FROM nv WHERE v IS NOT NULL AND NOT regexp_matches(c, '^((19|20)[0-9]{2}|(19|20)[0-9]{6})$') AND NOT (abs(v) < 2.0 AND v = floor(v))),
    av AS (SELECT DISTINCT path, v FROM (SELECT path, TRY_CAST(replace(unnest(regexp_extract_all(body, '-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+')), ',', '') AS DOUBLE) AS v FROM {files}) q WHERE v IS NOT NULL),
    bl AS (SELECT doc_id, unnest(string_split_regex(text, '\\begin\{table\*?\}')) AS b FROM {manuscripts}),
    lf AS (SELECT DISTINCT doc_id, label, trim(unnest(files)) AS request FROM (SELECT doc_id, unnest(regexp_extract_all(b, '\\label\{(tab:[^}]*)\}', 1)) AS label, regexp_extract_all(b, '\\input\{([^}]*)\}', 1) AS files FROM bl) q),
    rf AS (SELECT doc_id, para, trim(unnest(string_split(r, ','))) AS label FROM (SELECT doc_id, para, unnest(regexp_extract_all(t, '\\[cC]?ref\{([^}]*)\}', 1)) AS r FROM p) q),
    ct AS (SELECT para, coalesce(request, rf.label) AS request FROM rf LEFT JOIN lf ON rf.doc_id = lf.doc_id AND rf.label = lf.label WHERE request IS NOT NULL OR starts_with(rf.label, 'tab:')
      UNION SELECT para, trim(unnest(regexp_extract_all(t, '\\input\{([^}]*)\}', 1))) FROM p),
    rq AS (SELECT request, regexp_replace(regexp_replace(regexp_replace(request, '^\./', ''), '/+', '/', 'g'), '\.[^./]*$', '') AS s FROM (SELECT DISTINCT request FROM ct) q),
    ar AS (SELECT DISTINCT path, regexp_replace(path, '\.[^./]*$', '') AS s FROM {files}),
    ex AS (SELECT request, count(*) AS n, min(path) AS path FROM rq JOIN ar ON rq.s = ar.s GROUP BY 1),
    tails AS (SELECT path, array_to_string(g[i:], '/') AS s FROM (SELECT path, string_split(s, '/') AS g FROM ar) q, unnest(range(2, len(g) + 1)) u(i)),
    sx AS (SELECT request, path FROM rq JOIN tails ON rq.s = tails.s
      UNION ALL SELECT request, path FROM (SELECT request, array_to_string(g[i:], '/') AS s FROM (SELECT request, string_split(s, '/') AS g FROM rq) q, unnest(range(2, len(g) + 1)) u(i)) z JOIN ar ON z.s = ar.s),
    su AS (SELECT request, count(*) AS n, min(path) AS path FROM sx GROUP BY 1),
    rs AS (SELECT rq.request, coalesce(ex.n, su.n, 0) AS n, CASE WHEN coalesce(ex.n, su.n, 0) = 1 THEN coalesce(ex.path, su.path) END AS path FROM rq LEFT JOIN ex ON rq.request = ex.request LEFT JOIN su ON rq.request = su.request),
    cited AS (SELECT DISTINCT para, path FROM ct JOIN rs ON ct.request = rs.request WHERE n = 1),
    cl AS (SELECT pn.para, pn.v, path FROM pn JOIN cited ON pn.para = cited.para WHERE precise),
    op AS (SELECT * FROM cl WHERE NOT EXISTS (SELECT 1 FROM cl c2 JOIN av ON av.path = c2.path AND av.v = c2.v WHERE c2.para = cl.para AND c2.v = cl.v)),
    nm AS (SELECT para, op.v AS stated, min(struct_pack(d := abs(av.v - op.v) / abs(av.v), a := av.v)) AS m FROM op JOIN av ON av.path = op.path AND av.v <> 0 AND (av.v > 0) = (op.v > 0) WHERE op.v <> 0 GROUP BY 1, 2),
    sv AS (SELECT DISTINCT v FROM pn), orp AS (SELECT v AS value FROM sv WHERE v NOT IN (SELECT v FROM av))"""


def _papers(t):
    """Paragraphs, citations and files, read out of the manuscripts once."""
    m = t.manuscripts
    return P.manuscript_paragraphs(m), P.read_citations(m), t.files


@query("c25_scoped_near_miss", _PN + " SELECT para, stated, m.a AS nearest, round(m.d, 6) AS distance FROM nm WHERE m.d > 0 AND m.d <= 0.03")
def c25(t):
    paragraphs, citations, files = _papers(t)
    return R6(P.near_misses(paragraphs, citations, files), "distance")


@query("c26_orphans", _PN + " SELECT value FROM orp")
def c26(t):
    paragraphs, _, files = _papers(t)
    return P.orphans(paragraphs, files)


@query("c27_resolve_citations", _PN + """ SELECT request, path, CAST(n AS BIGINT) AS n_matches, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM rs""")
def c27(t):
    _, citations, files = _papers(t)
    return P.resolve_citations(citations, files)


@query("c27_read_citations", _PN + " SELECT para AS para_id, request AS cited_path FROM ct")
def c27c(t):
    return P.read_citations(t.manuscripts)


@query("c27_provenance_status", _PN + """, su2 AS (SELECT (SELECT count(DISTINCT para) FROM cited) AS checked, (SELECT count(*) FROM nm WHERE m.d > 0 AND m.d <= 0.03) AS near_misses, (SELECT count(*) FROM rs WHERE n > 1) AS ambiguous,
      (SELECT count(DISTINCT ct.request) FROM ct JOIN rs ON ct.request = rs.request WHERE n = 0 AND para IN (SELECT para FROM pn WHERE precise)) AS unresolved,
      (SELECT count(*) FROM sv) AS stated, (SELECT count(*) FROM sv) - (SELECT count(*) FROM orp) AS matched, (SELECT count(*) FROM orp) AS orphans)
    SELECT *, CASE WHEN ambiguous > 0 OR unresolved > 0 OR checked = 0 THEN 2 WHEN near_misses > 0 THEN 1 ELSE 0 END AS exit_status FROM su2""")
def c27b(t):
    paragraphs, citations, files = _papers(t)
    return P.provenance_status(paragraphs, citations, files)


# hex-digit words in documents count as prose numbers too; whole texts are scanned
@query("i2_number_tokens", r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+')) AS tok FROM {documents}),
    n AS (SELECT doc_id, replace(tok, ',', '') AS c, TRY_CAST(replace(tok, ',', '') AS DOUBLE) AS v FROM x)
    SELECT DISTINCT doc_id, v AS value FROM n WHERE v IS NOT NULL AND NOT regexp_matches(c, '^((19|20)[0-9]{2}|(19|20)[0-9]{6})$') AND NOT (abs(v) < 2.0 AND v = floor(v))""")
def i2(t):
    return t.documents.select("doc_id", F.explode(S.number_tokens(F.col("text"))).alias("value"))


@query("i2_precise_tokens", r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+')) AS tok FROM {documents}),
    n AS (SELECT doc_id, tok, replace(tok, ',', '') AS c, TRY_CAST(replace(tok, ',', '') AS DOUBLE) AS v FROM x)
    SELECT DISTINCT doc_id, v AS value FROM n WHERE v IS NOT NULL AND NOT regexp_matches(c, '^((19|20)[0-9]{2}|(19|20)[0-9]{6})$') AND NOT (abs(v) < 2.0 AND v = floor(v)) AND (contains(tok, '.') OR abs(v) >= 100)""")
def i2b(t):
    return t.documents.select("doc_id", F.explode(S.number_tokens(F.col("text"), precise_only=True)).alias("value"))


@query("i3_strip_markup", "SELECT para_id, replace(replace(text, chr(92) || 'ref' || chr(123) || 'tab:x12345' || chr(125), ' '), chr(92) || '%', chr(92) || '%') AS body FROM {paragraphs}")
def i3(t):
    return t.paragraphs.select("para_id", S.strip_markup(F.col("text")).alias("body"))
