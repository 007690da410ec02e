"""Near-duplicate classes: DartMinHash signatures of weighted word shingles, banded joining, exact check.

A text is a multiset of word shingles. Darts fall on each unit of an element's weight
as a Poisson process along a rank axis; a dart's coordinate is hashed too, and the
earliest dart of each coordinate is the signature. Only about k ln k darts per text are
thrown, whatever its length. Two signatures agree in a coordinate with the probability
of the texts' weighted Jaccard similarity.

Texts that agree in a band share a bucket. Links are found without listing the pairs of
a bucket: each text is first checked against the best connected text it meets (one pair
per text), and only buckets that still hold several components are compared further,
tile by tile, between components. Every accepted link is checked on the full multisets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import U64, flat_text, in_pieces, lists, mix, pack, q, ranges, rows_of, text_key, unit, words
from plumbline.operators.linkage import connected_components
from plumbline.session import cut, release

SHINGLE = 5  # words
SIMILARITY = 0.8
BANDS, ROWS = 24, 4  # at similarity 0.8 a pair shares no band once in 300,000 times
TILE = 256  # texts of one bucket compared in one task at a time
BATCH_BYTES = 1 << 20


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the text of each; a text of fewer words, but not none, is one run."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    start = ranges(first[:-1], count)
    row = rows_of(count)
    width = np.minimum(n, size)[row]
    out = mix(width.astype(U64), 5)
    for j in range(size):
        has = j < width
        out[has] = mix(out[has] ^ h[start[has] + j], 6)
    return out, row


def elements(shingle: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of weight: the k-th time a shingle comes in a text is an element of its own."""
    order = np.lexsort((shingle, row))
    s, r = shingle[order], row[order]
    if not len(s):
        return s, r
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.where(nth == 0, s, mix(s ^ mix(nth.astype(U64), 8), 9)), r


def dart_signatures(element: np.ndarray, row: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Earliest dart of each of `k` coordinates for every text that has elements (zeros for the others)."""
    sig = np.zeros((texts, k), U64)
    weight = np.bincount(row, minlength=texts)
    reach = k * (log(k) + 2) / np.maximum(weight, 1)  # ranks below which about k (ln k + 2) darts fall
    missing = weight > 0
    while missing.any():
        use = missing[row]
        e, r = element[use], row[use]
        at = np.zeros(len(e))
        found, j = [], 0
        while len(e):
            at = at - np.log(unit(mix(e, 20 + j)))
            live = at < reach[r]
            e, r, at = e[live], r[live], at[live]
            dart = mix(e ^ mix(np.array([j], U64), 21), 22)
            found.append((r * k + (mix(dart, 23) % U64(k)).astype(np.int64), at, dart))
            j += 1
        cell, rank, dart = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rank, cell))
        cell = cell[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        sig.reshape(-1)[cell[first]] = dart[order][first]
        seen = np.bincount(cell[first] // k, minlength=texts)
        missing &= seen < k
        reach = np.where(missing, reach * 2, reach)  # some coordinate got no dart: look further along
    return sig


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_pieces(batches, "text", BATCH_BYTES):
        data, off = flat_text(b.column("text"))
        _, _, h, first = words(data, off)
        n = np.diff(first)
        s, row = shingles(h, first, SHINGLE)
        e, r = elements(s, row)
        sig = dart_signatures(e, r, b.num_rows, BANDS * ROWS)
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        total = np.concatenate([[U64(0)], np.cumsum(mix(h ^ mix(place.astype(U64), 30), 31), dtype=U64)])
        with np.errstate(over="ignore"):
            node = mix((total[first[1:]] - total[first[:-1]]) ^ mix(n.astype(U64), 32), 33)
        for i in np.flatnonzero(n == 0):  # no words: only an equal text is a copy
            node[i] = int.from_bytes(blake2b(data[off[i]:off[i + 1]].tobytes(), digest_size=8).digest(), "little")
        band = np.repeat(mix(np.arange(BANDS, dtype=U64), 34)[None], b.num_rows, axis=0)
        for j in range(ROWS):
            band = mix(band ^ sig.reshape(b.num_rows, BANDS, ROWS)[:, :, j], 35)
        has = n > 0
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(node.view(np.int64)),
                                          lists(band[has].ravel().view(np.int64), np.where(has, BANDS, 0), pa.int64())], ["id", "key", "node", "bands"])


def _elements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_pieces(batches, "text", BATCH_BYTES):
        data, off = flat_text(b.column("text"))
        _, _, h, first = words(data, off)
        e, r = elements(*shingles(h, first, SHINGLE))
        pair = np.unique(r * (1 << 32) + (e >> U64(32)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("node"), lists((pair & 0xFFFFFFFF).astype(np.uint32).view(np.int32), np.bincount(pair >> 32, minlength=b.num_rows), pa.int32())],
                                         ["node", "elements"])


def _compare_tiles(similarity: float):
    """Links between components of one bucket: all pairs of one tile, or of two, that are not yet joined."""
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        node, root, side = t.column("node").to_pylist(), t.column("root").to_pylist(), t.column("side").to_pylist()
        sets = [np.sort(np.asarray(x.values)) for x in t.column("elements")]
        parent = {r: r for r in root}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = []
        two = len(set(side)) > 1
        for i in range(len(node)):
            for j in range(i + 1, len(node)):
                if two and side[i] == side[j]:
                    continue
                a, b = top(root[i]), top(root[j])
                x, y = sets[i], sets[j]
                if a == b or min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    parent[max(a, b)] = min(a, b)
                    links.append((node[i], node[j]))
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["src", "dst"])
    return run


def _roots(links: DataFrame) -> DataFrame:
    """`(node, component)` for a forest of links from each node to one other: the root above it. Paths halve each round."""
    up = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    while True:
        far = up.select(F.col("node").alias("n"), F.col("component").alias("far"))
        step = cut(up.join(far, F.col("component") == F.col("n"), "left").select("node", F.coalesce("far", "component").alias("component"), F.col("far").isNotNull().alias("moved")))
        up = step.select("node", "component")
        if step.where("moved").isEmpty():
            return up


def _links(texts: DataFrame, docs: DataFrame, similarity: float) -> DataFrame | None:
    """Components `(node, component)` of the texts that have a link, or None."""
    one = texts.where(F.size("bands") > 0).groupBy("node").agg(F.min(F.struct("id", "key")).alias("at"), F.first("bands").alias("bands"))
    all_ = one.select("node", F.explode("bands").alias("bucket"))
    shared = all_.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    met = cut(all_.join(shared, "bucket"))
    if met.isEmpty():
        return None
    score = met.groupBy("node").agg(F.sum(F.col("c") - 1).alias("score"))
    scored = met.join(score, "node")
    hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("hub"))
    seen = cut(met.join(hubs, "bucket").select("bucket", "node", "c", "hub"))
    best = seen.groupBy("node").agg(F.max("hub").alias("hub")).select("node", F.col("hub.node").alias("hub"))
    # the multisets of texts that share a bucket
    want = texts.join(score.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "key")).alias("at")).select("node", F.col("at.id").alias("i"), F.col("at.key").alias("k"))
    have = docs.join(want, docs["id"].eqNullSafe(want["i"]) & (docs["key"] == want["k"])).select("node", "text").mapInArrow(_elements_of, "node long, elements array<int>")
    have = cut(have.dropDuplicates(["node"]))
    pairs = best.where("node <> hub").join(have, "node").join(have.select(F.col("node").alias("hub"), F.col("elements").alias("other")), "hub")
    both, size = F.size(F.array_intersect("elements", "other")), F.size("elements") + F.size("other")
    close = F.least(F.size("elements"), F.size("other")) >= similarity * F.greatest(F.size("elements"), F.size("other"))
    links = cut(pairs.where(close).where(both >= similarity * (size - both)).select(F.col("node").alias("src"), F.col("hub").alias("dst")))
    comp = _roots(links)
    rooted = seen.join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    rooted = rooted.join(best.select("node", F.col("hub").alias("tried")), "node")
    tried = F.max(((F.col("tried") == F.col("hub.node")) & (F.col("tried") != F.col("node"))).cast("int"))
    # a bucket of two whose only pair was the one checked has nothing left to compare
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.first("c").alias("c"), tried.alias("t")).where("a <> b AND NOT (c = 2 AND t = 1)").select("bucket")
    left = rooted.join(open_, "bucket", "left_semi").select("bucket", "node", "root", "c")
    order = Window.partitionBy("bucket").orderBy("root", "node")
    left = cut(left.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE)))
    if left.isEmpty():
        release(met, seen, have, links, left)
        return comp
    tiles = F.floor((F.col("c") - 1) / TILE)
    each = left.select("*", F.explode(F.sequence(F.lit(0), tiles)).alias("with"))
    each = each.select("bucket", F.least("tile", "with").alias("ta"), F.greatest("tile", "with").alias("tb"), F.col("tile").alias("side"), "node", "root")
    # two tiles of one and the same component have nothing to find
    useful = each.groupBy("bucket", "ta", "tb").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket", "ta", "tb")
    groups = each.join(useful, ["bucket", "ta", "tb"], "left_semi").join(have, "node").groupBy("bucket", "ta", "tb")
    more = cut(groups.applyInArrow(_compare_tiles(similarity), "src long, dst long").distinct())
    release(met, seen, have, links, left)
    if more.isEmpty():
        return comp
    up = comp.select(F.col("node").alias("n"), F.col("component").alias("r"))
    ends = more.join(up, F.col("src") == F.col("n"), "left").select(F.coalesce("r", "src").alias("src"), "dst")
    ends = ends.join(up, F.col("dst") == F.col("n"), "left").select("src", F.coalesce("r", "dst").alias("dst"))
    joined = connected_components(ends).select(F.col("node").alias("n"), F.col("component").alias("top"))
    release(more)
    low = comp.join(joined, F.col("component") == F.col("n"), "left").select("node", F.coalesce("top", "component").alias("component"))
    return low.unionByName(joined.select(F.col("n").alias("node"), F.col("top").alias("component")))


def near_classes(df: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`(id, key, class_id, n_class, keep_id, keep_key)`, one row per row of `df`.

    Two texts are linked when the weighted Jaccard similarity of their five-word
    shingles is at least `similarity`; a class is what links join. `class_id` is the
    least id of the class and `n_class` its rows. Of each class the row with the least
    `(id, key)`, null ids last, is the one to keep; `key` is a hash of the text. Words
    are as in `common.words`; a text of one to four words is one shingle; texts that
    differ only between words are copies. Texts without words (null is empty) are
    copies of equal texts only. Repeated rows are copies. Null ids are kept as ids that
    are never the least. An empty table gives an empty result.

    A pair at the threshold is missed with probability (1 - similarity**ROWS)**BANDS,
    3e-6; links found are exact. Copies are one text throughout, and texts are told
    apart by 64 bits. What moves per text is its bands; full multisets only of texts
    that share a bucket.
    """
    kind = df.schema[id].dataType.simpleString()
    docs = df.select(q(id).alias("id"), text_key(F.coalesce(q(text), F.lit(""))).alias("key"), F.coalesce(q(text), F.lit("")).alias("text"))
    texts = cut(docs.mapInArrow(_sign, f"id {kind}, key long, node long, bands array<long>"))
    comp = _links(texts, docs, similarity)
    rows = texts.select("id", "key", "node")
    rows = rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")) if comp is not None else rows.withColumn("component", F.col("node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    per = rows.groupBy("component").agg(first.alias("first"), F.count("*").alias("n_class"))
    return rows.join(per, "component").select("id", "key", F.col("first.id").alias("class_id"), "n_class", F.col("first.id").alias("keep_id"), F.col("first.key").alias("keep_key"))


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `df` without those that are near duplicates of a row that stays: one row of each class.

    All columns pass unchanged. Of rows equal in id and text one stays.
    """
    keep = near_classes(df, id, text, similarity).select("keep_id", "keep_key").distinct()
    whole, columns = pack(df, [])
    d = df.select(whole, q(id).alias("__id"), text_key(F.coalesce(q(text), F.lit(""))).alias("__key"))
    d = d.join(keep, d["__id"].eqNullSafe(keep["keep_id"]) & (d["__key"] == keep["keep_key"]))
    return d.dropDuplicates(["__id", "__key"]).select(*columns)
