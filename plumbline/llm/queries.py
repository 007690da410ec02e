"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, chat, fingerprint, fm_index, language, mixing, near_dups, neighbours, periodic, quality, revisits, sharding, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- 1 -----------------------------------------------------------------------------------------------------

@query("op1_fingerprint")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = neighbours.with_next(docs, "doc_id", F.octet_length("text") + 500, F.xxhash64("text"), enrich=lambda x: fingerprint.fingerprints(x, name="own"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("beside"), edited.alias("edited"))
    d = fingerprint.fingerprints(d, "edited", "changed")
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint.digest(F.col("own")).alias("fingerprint"),
                    fingerprint.digest(F.col("changed")).alias("edited_fingerprint"), fingerprint.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                    fingerprint.likeness(F.col("own"), F.col("beside")).alias("near_next"))


# ---- 2 -----------------------------------------------------------------------------------------------------

@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(table(spark, folder, "documents"), keep=["doc_id"], n_words=51, cut_words=False)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_words_removed", "n_word_spans")


# ---- 3 -----------------------------------------------------------------------------------------------------

@query("op3_minhash_near_dups")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    d = near_dups.near_classes(table(spark, folder, "documents"))
    return d.select(F.col("id").alias("doc_id"), "class_id", "n_class", (F.col("id") == F.col("class_id")).alias("kept"))


# ---- 4 -----------------------------------------------------------------------------------------------------

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
z AS (SELECT *, CAST(floor(size * 1000 / (size + 500)) AS BIGINT) AS z FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CAST(sum(z * size) AS DOUBLE) / sum(size) AS lean FROM z GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
i AS (SELECT *, cap / weight AS edge, row_number() OVER (ORDER BY cap / weight, source) AS i, (SELECT sum(size) FROM d) * 1.5::DOUBLE AS total FROM w),
o AS (SELECT *, (total - (sum(cap) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - cap)) / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM i),
t AS (SELECT source, source_size, lean, least(weight * coalesce((SELECT arg_min(rate, i) FROM o WHERE rate <= edge), 1e300), cap) AS target FROM w),
c AS (SELECT z.*, source_size, target, lean, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS c FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN size > 0 THEN least(greatest(c + least(c, 2.0 - c) / 2 * ((z - lean) / 1000.0), 0.0), 2.0) ELSE 0.0 END AS e FROM c),
p AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM e),
k AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN floor((u / (1 - u) * ((1 - p) / p)) / (1 + (u / (1 - u) * ((1 - p) / p))) * 68719476736.0) END AS key FROM p),
n AS (SELECT *, sum(CASE WHEN key IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key NULLS LAST) AS upto,
        target - sum(size * whole) OVER (PARTITION BY source) AS rest FROM k),
b AS (SELECT source, max(upto) FILTER (key IS NOT NULL AND upto <= rest) AS fits, min(upto) FILTER (key IS NOT NULL AND upto > rest) AS over FROM n GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN key IS NOT NULL AND (upto <= rest OR (upto = over AND over - rest < rest - coalesce(fits, 0))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source"""


@query("op4_pareto_mix", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


# ---- 5 -----------------------------------------------------------------------------------------------------

@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    d = language.identify_language(table(spark, folder, "documents"), keep=["doc_id"])
    return d.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# ---- 6 -----------------------------------------------------------------------------------------------------

OP6_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, {escaped} AS esc,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 WHEN 'tool' THEN 13 END AS marks FROM c),
p AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
        lead(role, 1, 'end') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + marks)::BIGINT AS formatted_chars,
  bool_and((prev || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant', 'tool>tool')
    AND (nxt <> 'end' OR role = 'assistant')) AS valid
FROM p GROUP BY conv_id"""


def _sql_escape() -> str:
    out = "text"
    for raw, code in chat._codes(chat.TEMPLATE):
        out = f"replace({out}, '{raw}', '{code}')"
    return out


@query("op6_chat_format", OP6_SQL.replace("{escaped}", _sql_escape()))
def op6(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    c = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    d = chat.format_chats(c.unionByName(more)).withColumn("read", chat.read_turns(F.col("formatted")))
    d = d.withColumn("loss_text", chat.read_loss_text(F.col("formatted"), F.col("loss_spans")))
    said_all = F.array_join(F.transform("read", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
                    F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


# ---- 7 -----------------------------------------------------------------------------------------------------

# Captures made from the pages: a full response each (some 404), and two revisits, one of them before it. A third
# of the pages are taken as their site's front page, so that many captures share a URL.
CAPTURES = {
    "base": """SELECT page_id, 1700000000 + page_id * 3600 AS ts, md5(coalesce(html, '')) AS sum, CAST(coalesce(length(html), 0) AS STRING) AS len,
        CASE WHEN page_id % 3 = 0 THEN concat(split_part(url, '/', 1), '//', split_part(url, '/', 3)) ELSE url END AS url FROM pages""",
    "response": """SELECT concat('r', page_id) AS record_id, 'response' AS kind, url, ts, CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status,
        CASE WHEN page_id % 5 <> 0 THEN concat('"', substr(sum, 1, 12), '"') END AS etag, concat('D', CAST(ts - 86400 AS STRING)) AS modified, 'max-age=60' AS cache, len, 'text/html' AS type, CAST(NULL AS STRING) AS date FROM base""",
    "revisit": """SELECT concat('v', page_id, '-', k) AS record_id, 'revisit' AS kind, CASE WHEN k = 1 THEN concat(upper(substr(url, 1, 12)), substr(url, 13), '#again') ELSE url END AS url,
        ts + CASE WHEN k = 1 THEN 7200 ELSE -10 END AS ts, 304 AS status,
        CASE WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 11 <> 0 THEN concat('W/"', substr(sum, 1, 12), '"') END AS etag,
        CASE WHEN page_id % 4 <> 0 THEN concat('D', CAST(ts - 86400 AS STRING)) END AS modified, 'max-age=120' AS cache, '0' AS len, CAST(NULL AS STRING) AS type, concat('D', CAST(ts AS STRING)) AS date
        FROM base, (SELECT 1 AS k UNION ALL SELECT 2 AS k)""",
}

OP7_SQL = f"""
WITH base AS ({CAPTURES['base']}), response AS ({CAPTURES['response']}), revisit AS ({CAPTURES['revisit']}),
canon AS (SELECT *, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?', ['s', 'h', 'p', 'q'], 's') AS u FROM (SELECT * FROM response UNION ALL SELECT * FROM revisit)),
c AS (SELECT * EXCLUDE (url), CASE WHEN u.s <> '' AND u.h <> '' THEN lower(u.s) || '://' ||
    CASE WHEN lower(u.s) = 'http' THEN regexp_replace(lower(u.h), ':80$', '') WHEN lower(u.s) = 'https' THEN regexp_replace(lower(u.h), ':443$', '') ELSE lower(u.h) END
    || CASE WHEN u.p = '' THEN '/' ELSE u.p END || u.q END AS url FROM canon),
j AS (SELECT v.*, r.record_id AS source_id, r.etag AS retag, r.modified AS rmodified, r.len AS rlen, r.type AS rtype
  FROM (SELECT * FROM c WHERE kind = 'revisit') v ASOF LEFT JOIN (SELECT * FROM c WHERE kind = 'response' AND status = 200) r ON v.url = r.url AND v.ts > r.ts),
k AS (SELECT *, CASE WHEN url IS NULL THEN 'no-url' WHEN source_id IS NULL THEN 'no-response'
    WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = replace(retag, 'W/', '') THEN 'etag' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND rmodified IS NOT NULL THEN CASE WHEN modified = rmodified THEN 'last-modified' ELSE 'mismatch' END ELSE 'none' END AS "check" FROM j)
SELECT record_id, url, source_id, "check", "check" IN ('etag', 'last-modified') AS resolved,
  CASE WHEN "check" IN ('etag', 'last-modified') THEN 'cache-control: ' || cache || chr(10) || 'content-length: ' || rlen || chr(10) || 'content-type: ' || rtype || chr(10) || 'date: ' || date || chr(10)
    || coalesce('etag: ' || coalesce(etag, retag) || chr(10), '') || 'last-modified: ' || rmodified || chr(10) END AS headers FROM k"""


@query("op7_revisit_resolution", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    base = spark.sql(CAPTURES["base"].replace("FROM pages", "FROM {pages}"), pages=table(spark, folder, "pages"))
    parts = [spark.sql(CAPTURES[x].replace("FROM base", "FROM {base}"), base=base) for x in ("response", "revisit")]
    fields = {"ETag": "etag", "Last-Modified": "modified", "Cache-Control": "cache", "Content-Length": "len", "Content-Type": "type", "Date": "date"}
    captures = parts[0].unionByName(parts[1]).withColumn("headers", F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), F.col(c))]))
    d = revisits.resolve_revisits(captures, at="ts")
    return d.withColumn("headers", F.array_join(F.transform("headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"], F.lit("\n"))), ""))


# ---- 8 -----------------------------------------------------------------------------------------------------

@query("op8_quality_resample")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return quality.resample(table(spark, folder, "documents"), table(spark, folder, "labels"), good, keep=["doc_id"])


# ---- 9 -----------------------------------------------------------------------------------------------------

OP9_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
phrase AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM s),
sizes AS (SELECT DISTINCT n FROM phrase),
spot AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, y.n, p, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM spot) y JOIN phrase ON y.n = phrase.n AND y.x = phrase.x),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)"""


@query("op9_fm_decontaminate", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    d = fm_index.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# ---- 10 ----------------------------------------------------------------------------------------------------

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP10_SQL = """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (
  SELECT u.*, (SELECT max(struct_pack(a := length(rhost) - length(replace(rhost, '.', '')), b := length(rpath), v := rverdict, r := rhost || rpath))
    FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM u)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM j"""


@query("op10_url_filter", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# ---- 11 ----------------------------------------------------------------------------------------------------

@query("op11_histogram_shards")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    d = sharding.histogram_shards(table(spark, folder, "documents").select("doc_id", "text"), 16)
    return d.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


# ---- 13 ----------------------------------------------------------------------------------------------------

def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The documents, of which a tenth (by hash of the id) repeat a stretch of their words to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1))
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = F.pmod("g", n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    d = d.withColumns({"a": F.when(n > 0, a), "p": F.when(n > 0, p)})
    again = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    d = periodic.find_runs(with_planted_periods(table(spark, folder, "documents")), keep=["doc_id"])
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  above 0: x has the greater exponent
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x) > 0, y).otherwise(x))  # runs come by start, then period
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    d = d.withColumn("best", best)
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))


# ---- 12 ----------------------------------------------------------------------------------------------------

@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    d = alignment.align_tokenizers(table(spark, folder, "documents"), keep=["doc_id"], digest=True)
    return d.withColumnRenamed("groups", "groups_sha256")
