"""Web archive revisits: a not-modified record gets the body of the latest earlier full response to its URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import q

BINS = 1024  # equal spans of time; what one task sorts is one URL in one of them
# Header fields a not-modified response may replace in the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
DEFAULT_PORTS = {"http": "80", "https": "443"}


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, `/` for an empty path; null without a scheme and host."""
    part = lambda i: F.regexp_extract(F.trim(url), r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    for s, p in DEFAULT_PORTS.items():
        host = F.when(scheme == s, F.regexp_replace(host, f":{p}$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when((part(1) != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, part(4)))


def _entries(headers: Column) -> Column:
    """Headers as sorted `(name, value)` pairs, names in lower case; of one name the last value in order stays."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.sort_array(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _get(entries: Column, name: str) -> Column:
    return F.try_element_at(F.transform(F.filter(entries, lambda e: e["name"] == name), lambda e: e["value"]), F.lit(-1))


def resolve_revisits(records: DataFrame, id: str = "record_id", kind: str = "kind", url: str = "url", at: str = "at", status: str = "status", headers: str = "headers") -> DataFrame:
    """One row per revisit: `(record_id, url, source_id, check, resolved, headers)`.

    `records` holds `response` and `revisit` rows with a time `at` (whole number) and a
    map of headers. The source is the full response (status 200) with the same canonical
    URL and the greatest time before the revisit's, of equal times the one with the
    greatest id. `check` says how it was validated: `etag` (weak comparison) when both
    have one, else `last-modified` when both have that, else `none`; `mismatch` when the
    validators differ, `no-response` when there is no earlier full response and `no-url`
    when the URL has no scheme and host. A revisit is resolved after `etag` and
    `last-modified`; its headers are then the source's with the PERMITTED ones replaced
    by its own, as sorted `(name, value)` pairs, else null. Null times are never before
    anything: such a response is no source and such a revisit has none. Rows of other
    kinds are left out, repeated revisits come back repeatedly, other columns do not pass.
    An empty table gives an empty result.

    A URL with any share of the rows is cut along time into BINS; each bin is one
    window, and the last response of earlier bins, at most BINS rows a URL, is carried on.
    """
    r = records.select(q(id).cast("string").alias("id"), q(kind).alias("kind"), canonical_url(q(url)).alias("url"), q(at).cast("long").alias("at"),
                       (q(status) == 200).alias("full"), _entries(q(headers)).alias("entries"))
    r = r.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & F.col("full") & F.col("url").isNotNull() & F.col("at").isNotNull()))
    low, high = r.agg(F.min("at"), F.max("at")).first()
    low, high = (0, 0) if low is None else (low, high)
    wide = -(-(high - low + 1) // BINS)
    r = r.withColumn("bin", F.floor((F.col("at") - low) / wide).cast("int"))
    lost = (F.col("kind") == "revisit") & (F.col("url").isNull() | F.col("at").isNull())
    known = r.where(~F.coalesce(lost, F.lit(False)))
    source = F.when(F.col("kind") == "response", F.struct("at", "id", "entries"))
    before = Window.partitionBy("url", "bin").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    d = known.withColumn("near", F.max(source).over(before))
    # the last response of each bin, and from it the last of all earlier bins
    ends = known.where("kind = 'response'").groupBy("url", "bin").agg(F.max(F.struct("at", "id", "entries")).alias("last"))
    asked = known.where("kind = 'revisit'").select("url", "bin").distinct()
    line = Window.partitionBy("url").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(ends, ["url", "bin"], "full").withColumn("far", F.max("last").over(line)).select("url", "bin", "far").where("far IS NOT NULL")
    d = d.where("kind = 'revisit'").drop("kind", "full").join(carried, ["url", "bin"], "left").withColumn("from", F.coalesce("near", "far"))
    d = d.select("id", "url", "entries", "from").unionByName(r.where(lost).select("id", "url", "entries").withColumn("from", F.lit(None).cast(d.schema["from"].dataType)))
    own, old = F.col("entries"), F.col("from.entries")
    strong = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    by_tag = _get(own, "etag").isNotNull() & _get(old, "etag").isNotNull()
    by_date = _get(own, "last-modified").isNotNull() & _get(old, "last-modified").isNotNull()
    check = (F.when(F.col("url").isNull(), "no-url").when(F.col("from").isNull(), "no-response")
             .when(by_tag, F.when(strong(_get(own, "etag")) == strong(_get(old, "etag")), "etag").otherwise("mismatch"))
             .when(by_date, F.when(_get(own, "last-modified") == _get(old, "last-modified"), "last-modified").otherwise("mismatch")).otherwise("none"))
    ok = F.col("check").isin("etag", "last-modified")
    fresh = F.filter(own, lambda e: e["name"].isin(*PERMITTED))
    names = F.transform(fresh, lambda e: e["name"])
    merged = F.sort_array(F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["name"])), fresh))
    return d.withColumn("check", check).select(F.col("id").alias("record_id"), "url", F.col("from.id").alias("source_id"), "check", ok.alias("resolved"), F.when(ok, merged).alias("headers"))
