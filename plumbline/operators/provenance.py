"""Number provenance: do the numbers in prose agree with the artifacts they cite?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import add_offsets, with_cell
from plumbline.functions.scalars import all_numbers, number_tokens, strip_markup
from plumbline.session import cut


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ./ or /, no doubled separators."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?:^|/)(?:\./)+", "/"), "/+", "/"), r"^/", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def _tails(path: Column, proper: bool) -> Column:
    """Every suffix made of whole segments; `proper` leaves out the path itself."""
    seg = F.split(path, "/")
    start = 2 if proper else 1
    return F.when(F.size(seg) >= start, F.transform(F.sequence(F.lit(start), F.size(seg)), lambda i: F.array_join(F.slice(seg, i, F.size(seg)), "/"))).otherwise(
        F.array().cast("array<string>"))


# The commands by which a manuscript cites, labels and includes tables.
REF, INPUT = r"\\[cC]?ref\{([^}]*)\}", r"\\input\{([^}]*)\}"
LABEL, TABLE = r"\\label\{(tab:[^}]*)\}", r"\\begin\{table\*?\}"
BLANK_LINES = r"\n\s*\n"


def manuscript_paragraphs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, para, para_id, text)`: the stretches between blank lines, numbered from 1; `para_id` joins both numbers."""
    d = docs.select(F.col(id).alias("id"), F.posexplode(F.split(text, BLANK_LINES, -1)).alias("para", "text"))
    return d.select("id", (F.col("para") + 1).alias("para"), F.concat_ws(":", "id", F.col("para") + 1).alias("para_id"), "text")


def label_files(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, label, request)`: the files included where a label stands, from the start of its table environment to the next one or the end."""
    blocks = docs.select(F.col(id).alias("id"), F.explode(F.split(text, TABLE, -1)).alias("b"))
    d = blocks.select("id", F.array_distinct(F.regexp_extract_all("b", F.lit(INPUT), F.lit(1))).alias("files"), F.explode(F.regexp_extract_all("b", F.lit(LABEL), F.lit(1))).alias("label"))
    return d.select("id", "label", F.explode(F.transform("files", lambda f: F.trim(f))).alias("request")).distinct()


def read_citations(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(para_id, cited_path)`: what each paragraph of a manuscript cites.

    A reference stands for the files of its label in the same manuscript, an included
    file for itself. A reference to a table without a file is kept as it is, so that it
    counts as unresolved; references to anything else are no citations of numbers.
    """
    p = manuscript_paragraphs(docs, id, text)
    refs = p.select("id", "para_id", F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(REF), F.lit(1)), lambda r: F.split(r, ",")))).alias("label")).withColumn("label", F.trim("label"))
    refs = refs.join(label_files(docs, id, text), ["id", "label"], "left")
    refs = refs.where(F.col("request").isNotNull() | F.startswith("label", F.lit("tab:"))).select("para_id", F.coalesce("request", "label").alias("cited_path"))
    files = p.select("para_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(INPUT), F.lit(1)), lambda f: F.trim(f))).alias("cited_path"))
    return refs.unionByName(files).distinct()


def artifact_values(artifacts: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Distinct numbers of each artifact: `(path, value)`."""
    return artifacts.select(normal_path(F.col(path)).alias("path"), F.explode(all_numbers(F.col(body))).alias("value")).distinct()


def resolve_citations(requests: DataFrame, artifacts: DataFrame, request: str = "cited_path", path: str = "path") -> DataFrame:
    """Resolve each distinct request: `(request, path, n_matches, status)`.

    An exact path or stem wins; otherwise one path must end with the other on a
    segment boundary. More than one match is ambiguous, none is unresolved.
    Paths are joined on their suffixes, which are counted before the join, so a
    name shared by many artifacts stays one row.
    """
    req = requests.select(F.col(request).alias("request")).where("request is not null").distinct().withColumn("s", stem(normal_path(F.col("request"))))
    art = artifacts.select(normal_path(F.col(path)).alias("path")).distinct().withColumn("s", stem(F.col("path")))
    whole = art.groupBy("s").agg(F.count("*").alias("n"), F.min("path").alias("p"))
    tails = art.select("path", F.explode(_tails(F.col("s"), True)).alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("path").alias("p"))
    exact = req.join(whole, "s").select("request", F.lit(0).alias("tier"), "n", "p")
    longer = req.select("request", F.explode(_tails(F.col("s"), True)).alias("s")).join(whole, "s").select("request", F.lit(1).alias("tier"), "n", "p")
    shorter = req.join(tails, "s").select("request", F.lit(1).alias("tier"), "n", "p")
    hits = exact.unionByName(longer).unionByName(shorter)
    best = hits.groupBy("request", "tier").agg(F.sum("n").alias("n"), F.min("p").alias("p")).groupBy("request").agg(
        F.min(F.struct("tier", "n", "p")).alias("b"))
    j = req.select("request").join(best, "request", "left")
    n = F.coalesce(F.col("b.n"), F.lit(0))
    return j.select("request", F.when(n == 1, F.col("b.p")).alias("path"), n.alias("n_matches"),
                    F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"))


def prose_numbers(paragraphs: DataFrame, para: str, text: str, min_abs: float = 2.0, precise_only: bool = False) -> DataFrame:
    """Distinct numbers stated in each paragraph, markup removed."""
    return paragraphs.select(F.col(para).alias("para"), F.explode(number_tokens(strip_markup(F.col(text)), min_abs, precise_only)).alias("value")).distinct()


def near_misses(paragraphs: DataFrame, citations: DataFrame, artifacts: DataFrame, para: str = "para_id", text: str = "text",
                request: str = "cited_path", tol: float = 0.03, min_abs: float = 2.0, vals: DataFrame | None = None,
                cells: int | None = None) -> DataFrame:
    """Prose numbers that equal no value of the cited artifacts but lie within `tol` of the nearest one.

    `citations` is `(para, request)`. The nearest value by relative distance is the
    next one below or above with the same sign, so statements and values are
    sorted together per artifact and each statement looks one value either way; no
    pairs are built, and a large artifact is cut into cells.
    """
    res = resolve_citations(citations, artifacts, request).where("status = 'resolved'").select(F.col("request"), "path")
    cited = citations.select(F.col(para).alias("para"), F.col(request).alias("request")).distinct().join(res, "request").select("para", "path").distinct()
    # texts are scanned once each; what follows reads only the numbers found
    vals = cut(artifact_values(artifacts)) if vals is None else vals
    claims = cut(prose_numbers(paragraphs, para, text, min_abs, precise_only=True).join(cited, "para"))
    exact = claims.join(vals, ["path", "value"]).select("para", "value").distinct()
    open_ = claims.join(exact, ["para", "value"], "left_anti").where("value <> 0")
    by = ["path", "sg"]
    here = vals.where("value <> 0").join(cited.select("path").distinct(), "path", "left_semi")
    u = open_.select("path", F.signum("value").alias("sg"), F.col("value").alias("x"), F.lit(None).cast("double").alias("a"), "para").unionByName(
        here.select("path", F.signum("value").alias("sg"), F.col("value").alias("x"), F.col("value").alias("a")), allowMissingColumns=True)
    d = with_cell(u, by, "x", cells)
    per = d.where("_split").groupBy(*by, "_cell").agg(F.max("a").alias("_hi"), F.min("a").alias("_lo"))
    # read downwards as well: a frame that ends open is searched anew for each row
    w, back = Window.partitionBy(*by).orderBy("_cell"), Window.partitionBy(*by).orderBy(F.desc("_cell"))
    d = add_offsets(d, by, per.select(*by, "_cell", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
                                      F.min("_lo").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_above")))
    inside, down = Window.partitionBy(*by, "_cell").orderBy("x"), Window.partitionBy(*by, "_cell").orderBy(F.desc("x"))
    d = d.select("para", F.col("x").alias("stated"),
                 F.greatest(F.max("a").over(inside.rangeBetween(Window.unboundedPreceding, 0)), F.col("_below")).alias("p"),
                 F.least(F.min("a").over(down.rangeBetween(Window.unboundedPreceding, 0)), F.col("_above")).alias("q")).where("para is not null")
    far = lambda c: F.struct((F.abs(F.col(c) - F.col("stated")) / F.abs(F.col(c))).alias("distance"), F.col(c).alias("actual"))
    near = d.select("para", "stated", F.explode(F.array(far("p"), far("q"))).alias("b")).where("b.actual is not null").groupBy("para", "stated").agg(F.min("b").alias("b"))
    return near.select("para", "stated", F.col("b.actual").alias("nearest"), F.col("b.distance").alias("distance")).where(
        (F.col("distance") > 0) & (F.col("distance") <= tol))


def orphans(paragraphs: DataFrame, artifacts: DataFrame, para: str = "para_id", text: str = "text", min_abs: float = 2.0) -> DataFrame:
    """Distinct prose numbers found in no artifact."""
    nums = prose_numbers(paragraphs, para, text, min_abs).select("value").distinct()
    return nums.join(artifact_values(artifacts).select("value").distinct(), "value", "left_anti")


def provenance_status(paragraphs: DataFrame, citations: DataFrame, artifacts: DataFrame, para: str = "para_id", text: str = "text",
                      request: str = "cited_path") -> DataFrame:
    """Counts of every outcome and the exit status: 2 when a check could not run, 1 for near misses, else 0."""
    vals = cut(artifact_values(artifacts))
    nums = prose_numbers(paragraphs, para, text, precise_only=True).select("para").distinct()
    r = cut(resolve_citations(citations, artifacts, request))
    c = citations.select(F.col(para).alias("para"), F.col(request).alias("request")).distinct().join(r, "request")
    with_numbers = c.join(nums, "para", "left_semi").where("status = 'unresolved'").select("request").distinct().agg(F.count("*").alias("unresolved"))
    amb = r.where("status = 'ambiguous'").agg(F.count("*").alias("ambiguous"))
    checked = c.where("status = 'resolved'").select("para").distinct().agg(F.count("*").alias("checked"))
    near = near_misses(paragraphs, citations, artifacts, para, text, request, vals=vals).agg(F.count("*").alias("near_misses"))
    prose = cut(prose_numbers(paragraphs, para, text).select("value").distinct())
    known = prose.join(vals.select("value").distinct(), "value", "left_semi").agg(F.count("*").alias("matched"))
    stated = prose.agg(F.count("*").alias("stated"))
    out = checked
    for part in (near, amb, with_numbers, stated, known):  # one-row aggregates side by side
        out = out.join(F.broadcast(part))
    blocked = (F.col("ambiguous") > 0) | (F.col("unresolved") > 0) | (F.col("checked") == 0)
    return out.withColumn("orphans", F.col("stated") - F.col("matched")).withColumn(
        "exit_status", F.when(blocked, 2).when(F.col("near_misses") > 0, 1).otherwise(0))
