"""Remove long strings of bytes, or passages of words, that occur more than once, by suffix arrays over shards.

1. Anchors. A string is filed under its least hashed gram (GRAM bytes, or WORD_GRAM words),
   so equal strings are filed alike wherever they start. Anchors whose hash occurs once in
   the corpus are dropped: no string filed there can repeat. One pass over the texts finds
   the anchors of both kinds.
2. Blocks. Around each remaining anchor lies a block: the strings filed there. A block that
   comes again as it is repeats altogether; one copy of it goes on. Of two halves of a
   string around its anchor one holds half of the rest, so only strings whose anchor has
   the same half string in another block can repeat; the others go.
3. Shards. Blocks are dealt to shards by the anchor's hash; an anchor with more text than a
   shard holds is split over several. A shard sorts the suffixes of its blocks
   (Larsson-Sadakane) and reads off, from Kasai's common prefixes, which strings occur twice.
4. Anchors that were split: what a shard could not settle, and one copy of what it could,
   goes on as sorted fingerprints, cut into ranges; a range merges the sorted lists of all
   shards by binary search.
5. The spans of each document are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import BYTE_VALUES, IS_WORD, LOWER, U64, flat_text, give_back, in_pieces, mix, pack, q, ranges, rows_of, text_key, words
from plumbline.llm.suffix import common_prefixes, suffix_array
from plumbline.session import cut, release

GRAM, WORD_GRAM = 32, 4  # bytes, and words, hashed to choose an anchor
SHARD_BYTES = 1 << 19  # block bytes a shard holds
RANGE_ROWS = 1 << 20  # fingerprints merged in one task
BATCH_BYTES = 1 << 19  # text worked on at a time in a task; a longer one is looked at piece by piece
BASE = 0x9E3779B97F4A7C15 | 1
OUT = ["kept", "n_bytes", "n_removed", "n_spans", "spans"]
WORD_OUT = ["n_words_removed", "n_word_spans"]
SPAN = "array<struct<start:int,stop:int,first:int,last:int>>"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """`common.words`, in pieces of BATCH_BYTES that end between words where one text is longer."""
    if len(data) <= BATCH_BYTES or len(off) != 2:
        return words(data, off)
    parts, at = [], 0
    while at < len(data):
        to = min(at + BATCH_BYTES, len(data))
        while to < len(data) and IS_WORD[LOWER[data[to]]]:
            to += 1
        begin, end, h, _ = words(data[at:to], np.array([0, to - at]))
        parts.append((begin + at, end + at, h))
        at = to
    begin, end, h = (np.concatenate(x) for x in zip(*parts))
    return begin, end, h, np.array([0, len(h)])


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one integer; zeros follow the end."""
    n = len(data)
    pad = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n + 8, U64)
    for r in range(8):
        part = pad[r:r + (n + 8 - r + 7) // 8 * 8].view(U64)
        out[r::8] = part[:len(out[r::8])]
    return out[:n]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position that has as many."""
    w, n = _words_at(data), len(data) - GRAM + 1
    x = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(0, GRAM, 8):
            x = (x ^ (x >> U64(31)) ^ w[j:j + n]) * U64(0x9FB21C651E98DF25)
    return x ^ (x >> U64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    pad = np.full(-(-len(x) // width) * width, ~U64(0), U64)
    pad[:len(x)] = x
    grid = pad.reshape(-1, width)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1:width - 1 + n])


def _gram_words(h: np.ndarray) -> np.ndarray:
    """A hash of the WORD_GRAM words from each place that has as many."""
    n = len(h) - WORD_GRAM + 1
    x = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(WORD_GRAM):
            x = (x ^ (x >> U64(31)) ^ h[j:j + n]) * U64(0x9FB21C651E98DF25)
    return x ^ (x >> U64(29))


class StretchHash:
    """Hashes of any stretch of symbols, from sums of value times power."""

    power = back = np.ones(1, U64)  # of BASE and of its inverse; as long as was needed so far

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            if len(StretchHash.power) <= n:
                StretchHash.power, StretchHash.back = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, x, U64)]), dtype=U64) for x in (BASE, pow(BASE, -1, 2**64)))
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * self.power[:n], dtype=U64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[stop] - self.sums[start]) * self.back[start]


def anchors(g: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, first string (symbol among all), number of strings, number of anchors and place of the first anchor of every block.

    `g` are the hashes of the grams from each symbol of texts laid end to end. A block is a
    run of strings whose anchors are one place, or follow each other with the same hash, as
    in text that repeats itself.
    """
    none = np.zeros(0, np.int64)
    if len(g) < length - gram + 1:
        return none, none.astype(U64), none, none, none, none
    place = np.arange(len(g), dtype=U64)
    low = U64((1 << 26) - 1)
    least = _least((g & ~low) | (place & low), length - gram + 1)  # ties: the first
    at = np.arange(len(least))
    where = at + ((least - at.astype(U64)) & low).astype(np.int64)
    hashes = g[where]
    text = np.searchsorted(off, at, "right") - 1
    inside = at + length <= off[text + 1]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    new &= inside
    start = np.flatnonzero(new)
    total = np.concatenate([[0], np.cumsum(inside)])
    moved = np.zeros(len(at), bool)
    moved[1:] = (where[1:] != where[:-1]) & inside[1:] & ~new[1:]
    moves = np.concatenate([[0], np.cumsum(moved)])
    stop = np.append(start[1:], len(at))
    return text[start], mix(hashes[start]), start, total[stop] - total[start], 1 + moves[stop] - moves[start], where[start]


def _half(length: int, worded: bool) -> int:
    """Symbols before its anchor that a string has, if it has not as many of its rest (at least) after it."""
    return (length - (WORD_GRAM if worded else GRAM)) // 2


def _blocks(symbols: np.ndarray, off: np.ndarray, length: int, worded: bool) -> Iterator[dict[str, np.ndarray]]:
    """Blocks found in windows of BATCH_BYTES symbols; `lo` is the first symbol among all, `c1` and `c2` are hashes of the half strings before and after the anchor."""
    gram, half = WORD_GRAM if worded else GRAM, _half(length, worded)
    for at in range(0, max(1, len(symbols)), BATCH_BYTES):
        part = symbols[at:at + BATCH_BYTES + length - 1]  # strings that start in the window
        if len(part) < length:
            continue
        inner = np.clip(off - at, 0, len(part))
        g = _gram_words(part) if worded else _gram_hashes(part)
        text, h, lo, n, places, anchor = anchors(g, inner, length, gram)
        stretch = StretchHash(part if worded else BYTE_VALUES[part])
        has1, has2 = lo <= anchor - half, lo + n > anchor - half
        c1 = stretch.of(np.where(has1, anchor - half, 0), np.where(has1, anchor + gram, 0))
        c2 = stretch.of(np.where(has2, anchor, 0), np.where(has2, anchor + length - half, 0))
        yield {"text": text, "h": mix(h, 5 if worded else 6), "whole": mix(stretch.of(lo, lo + n + length - 1), 8), "lo": lo + at, "n": n, "places": places,
               "before": anchor - lo, "c1": np.ma.masked_array(mix(c1, 9), ~has1), "c2": np.ma.masked_array(mix(c2, 10), ~has2)}


def _find_anchors(length: int, n_words: int | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", BATCH_BYTES):
            data, off = flat_text(b.column("text"))
            found = [(False, x, off, x["lo"], x["lo"] + x["n"] + length - 1) for x in _blocks(data, off, length, False)]
            if n_words is not None:
                begin, end, h, first = _words(data, off)
                found += [(True, x, first, begin[x["lo"]], end[x["lo"] + x["n"] + n_words - 2]) for x in _blocks(h, first, n_words, True)]
            for worded, x, first, start, stop in found:
                text = x["text"]
                take = pa.array(text)
                wide = [pa.array(x[c].view(np.int64)) for c in ("h", "whole")] + [pa.array(x[c].data.view(np.int64), mask=np.ma.getmaskarray(x[c])) for c in ("c1", "c2")]
                small = [pa.array(v.astype(np.int32)) for v in (x["lo"] - first[text], x["n"], x["places"], x["before"], start - off[text], stop - start)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), worded)), *wide, b.column("id").take(take), b.column("key").take(take), *small], schema=schema)
    return run


BLOCK = ("shard", "split", "twice", "worded", "lo", "n", "at", "size")


def _cut_blocks(schema: pa.Schema):
    """Rows `(text, blocks)` to one row per block with its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", BATCH_BYTES):
            data, off = flat_text(b.column("text"))
            col = b.column("blocks")
            row = rows_of(col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = pa.StructArray.from_arrays(col.flatten().flatten(), BLOCK)
            begin = off[row] + flat.field("at").to_numpy().astype(np.int64)
            size = flat.field("size").to_numpy().astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            body = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edge), pa.py_buffer(data[ranges(begin, size)])]).cast(pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[flat.field(f) for f in BLOCK], b.column("id").take(take), b.column("key").take(take), body], schema=schema)
    return run


LISTS = ("fp1", "fp2", "ids", "keys", "starts", "stops", "firsts", "settled")
FOUND = ("id {id}, key long, spans " + SPAN + ", range long, fp1 array<long>, fp2 array<long>, ids array<{id}>, keys array<long>, "
         "starts array<int>, stops array<int>, firsts array<int>, settled array<boolean>")


def _spans(start, stop, first, last, kind: pa.DataType) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.asarray(x).astype(np.int32)) for x in (start, stop, first, last)], ["start", "stop", "first", "last"]).cast(kind)


def _sort_shard(length: int, n_words: int | None, schema: pa.Schema, n_ranges: int):
    """Spans of the strings that repeat inside a shard, and sorted fingerprints of what a split anchor leaves open, a row per range."""
    def run(table: pa.Table) -> pa.Table:
        try:
            return sort(table)
        finally:
            give_back()

    def sort(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        col = {c: t.column(c).to_numpy() for c in ("lo", "n", "at", "split", "twice")}
        data, off = flat_text(t.column("body").combine_chunks())
        worded = t.column("worded")[0].as_py()
        if worded:
            begin, end, symbol, edge = words(data, off)
            _, number = np.unique(symbol, return_inverse=True)
            number, long = number + 1, n_words
        else:
            edge, symbol, number, long = off, data, data.astype(np.int64) + 1, length
        sizes = np.diff(edge)
        sa, _ = suffix_array(number, sizes, int(number.max()).bit_length())
        shared = common_prefixes(number if worded else data, sizes, sa, long) >= long
        again = np.zeros(len(number), bool)
        again[sa[shared]] = True
        again[sa[np.flatnonzero(shared) - 1]] = True
        # the first place in the order of each string stands for it where shards are merged
        head = np.zeros(len(number), bool)
        head[sa[~shared]] = True
        # strings of all blocks, one after another
        n = col["n"].astype(np.int64)
        row, at = rows_of(n), ranges(edge[:-1], n)
        dup = again[at] & ~col["twice"][row]
        change = np.ones(len(row), bool)
        change[1:] = row[1:] != row[:-1]
        first = dup & (change | ~np.concatenate([[False], dup[:-1]]))
        last = dup & (np.append(change[1:], True) | ~np.append(dup[1:], False))
        a, z, row_of = at[first], at[last] + long - 1, row[first]

        def place(x: np.ndarray, stop: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
            """Bytes in the text, and numbers of words, of the symbols from x to stop."""
            shift = col["at"][block] - off[block]
            if not worded:
                return x + shift, stop + 1 + shift, np.full(len(x), -1), np.full(len(x), -1)
            word = col["lo"][block] - edge[block]
            return begin[x] + shift, end[stop] + shift, x + word, stop + 1 + word

        ids, keys = t.column("id").combine_chunks(), t.column("key").combine_chunks()
        kind = schema.field("spans").type
        per = np.bincount(row_of, minlength=t.num_rows)
        rows = np.flatnonzero(per)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per[rows])]).astype(np.int32)), _spans(*place(a, z, row_of), kind.value_type)).cast(kind)
        found = pa.table([ids.take(pa.array(rows)), keys.take(pa.array(rows)), spans, *[pa.nulls(len(rows), f.type) for f in list(schema)[3:]]], schema=schema)
        send = np.flatnonzero(head[at] & col["split"][row])
        if not len(send):
            return found
        x, block = at[send], row[send]
        values = symbol if worded else BYTE_VALUES[data]
        f1, f2 = (mix(StretchHash(mix(values, salt)).of(x, x + long), salt).view(np.int64) for salt in (11, 12))
        start, stop, word, _ = place(x, x + long - 1, block)
        order = np.lexsort((f2, f1))
        f1, f2, take = f1[order], f2[order], pa.array(block[order])
        part = (f1.astype(np.float64) // (2.0**64 / n_ranges)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        cut_at = pa.array(edges.astype(np.int32))
        flat = [pa.array(f1), pa.array(f2), ids.take(take), keys.take(take), *[pa.array(v[order].astype(np.int32)) for v in (start, stop, word)], pa.array((again[x] | col["twice"][block])[order])]
        wide = [pa.ListArray.from_arrays(cut_at, v).cast(schema.field(c).type) for v, c in zip(flat, LISTS)]
        sent_on = pa.table([pa.nulls(len(edges) - 1, f.type) for f in list(schema)[:3]] + [pa.array(part[edges[:-1]])] + wide, schema=schema)
        return pa.concat_tables([found, sent_on])
    return run


def _merge_range(n_words: int | None, schema: pa.Schema):
    """Open strings of one fingerprint range that another shard has too, each shard's sorted list searched for in the others'."""
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        f1, f2, ids, keys, starts, stops, firsts, settled = (t.column(c).combine_chunks().flatten() for c in LISTS)
        a, b = f1.to_numpy(), f2.to_numpy()
        sizes = t.column("fp1").combine_chunks().value_lengths().to_numpy()
        edge = np.concatenate([[0], np.cumsum(sizes)])
        hit = np.zeros(len(a), bool)
        sorted_lists = [np.arange(x, y) for x, y in zip(edge[:-1], edge[1:])]  # one of each shard
        while len(sorted_lists) > 1:  # two by two: each string of one list is searched for in the other
            merged = [sorted_lists[-1]] if len(sorted_lists) % 2 else []
            for x, y in zip(sorted_lists[::2], sorted_lists[1::2]):
                lo, hi = np.searchsorted(a[x], a[y], "left"), np.searchsorted(a[x], a[y], "right")
                known = np.zeros(len(y), bool)
                for k in range(int((hi - lo).max(initial=0))):  # equal first halves: as a rule one
                    have = np.flatnonzero(lo + k < hi)
                    have = have[b[y[have]] == b[x[lo[have] + k]]]
                    known[have] = True
                    hit[x[lo[have] + k]] = True
                hit[y[known]] = True
                merged.append(np.insert(x, hi[~known], y[~known]))
            sorted_lists = merged
        hit &= ~settled.to_numpy(zero_copy_only=False)
        which = np.flatnonzero(hit)
        take = pa.array(which)
        first = firsts.to_numpy()[which]
        last = np.where(first >= 0, first + (n_words or 0), -1)
        kind = schema.field("spans").type
        spans = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32)), _spans(starts.to_numpy()[which], stops.to_numpy()[which], first, last, kind.value_type)).cast(kind)
        return pa.table([ids.take(take), keys.take(take), spans], schema=schema)
    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """`gone` spread over every UTF-8 character it touches."""
    char = np.cumsum((data & 0xC0) != 0x80)
    return np.bincount(char, weights=gone, minlength=len(data) + 1)[char] > 0 if len(data) else gone


def _merged_words(row: np.ndarray, first: np.ndarray, last: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the union of each row's spans, and runs of them."""
    keep = first >= 0
    row, first, last = row[keep], first[keep], last[keep]
    lo, hi = (row << 32) + first, (row << 32) + last
    order = np.argsort(lo)
    lo, hi, row = lo[order], hi[order], row[order]
    reach = np.maximum.accumulate(hi) if len(hi) else hi
    before = np.concatenate([[-1], reach[:-1]])[:len(lo)]
    words_ = np.maximum(hi - np.maximum(lo, before), 0)
    return np.bincount(row, weights=words_, minlength=n_rows).astype(np.int64), np.bincount(row, weights=lo > before, minlength=n_rows).astype(np.int64)


def _remove(schema: pa.Schema, as_text: bool, cut_words: bool, count_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "__text", BATCH_BYTES):
            data, off = flat_text(b.column("__text"))
            found = b.column("__spans")
            row = rows_of(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start, stop, first, last = (found.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop", "first", "last"))
            more = _merged_words(row, first, last, b.num_rows) if count_words else ()
            use = slice(None) if cut_words else first < 0
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, (start + off[row])[use], 1)
            np.add.at(edge, (stop + off[row])[use], -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            begins = np.zeros(len(data) + 1, bool)
            begins[off] = True
            first |= gone & begins[:-1]
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            last |= gone & begins[1:]
            a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
            per = np.searchsorted(a, off)
            total = np.concatenate([[0], np.cumsum(gone)])
            out = _whole_characters(data, gone) if as_text else gone
            left, kept_off = data[~out], off - np.concatenate([[0], np.cumsum(out)])[off]
            n_spans = np.diff(per)
            which = rows_of(n_spans)
            spans = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array((a - off[which]).astype(np.int32)), pa.array((z - off[which]).astype(np.int32))], ["start", "stop"])).cast(schema.field("spans").type)
            kind = pa.large_string() if as_text else pa.large_binary()
            kept = pa.Array.from_buffers(kind, b.num_rows, [None, pa.py_buffer(kept_off.astype(np.int64).tobytes()), pa.py_buffer(left.tobytes())]).cast(schema.field("kept").type)
            yield pa.RecordBatch.from_arrays([b.column("__in"), kept, pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(n_spans.astype(np.int64)), spans, *map(pa.array, more)], schema=schema)
    return run


def _find_repeats(docs: DataFrame, length: int, n_words: int | None) -> DataFrame:
    """Spans of the strings and passages that occur twice in the texts of `docs` (id, key, text), a row `(id, key, __spans)` per id and key that has any.

    A span has bytes `start` to `stop`, and words `first` to `last` where it is a passage, else -1.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema["id"].dataType.simpleString()
    schema = lambda ddl: to_arrow_schema(T._parse_datatype_string(ddl))
    least = length if n_words is None else min(length, n_words * 2 - 1)  # words of a byte, and one byte between
    ddl = f"worded boolean, h long, whole long, c1 long, c2 long, id {kind}, key long, lo int, n int, places int, before int, at int, size int"
    found = cut(docs.where(F.octet_length("text") >= least).mapInArrow(_find_anchors(length, n_words, schema(ddl)), ddl))
    often = cut(found.groupBy("h").agg(F.sum("places").alias("c")).where("c > 1").select("h"))
    twice = cut(found.join(often, "h"))
    release(found, often)
    rep = F.min(F.struct("id", "key", "lo", "n", "at", "size", "worded", "before"))
    bodies = cut(twice.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("copies"), F.max("places").alias("places"), F.max("c1").alias("c1"), F.max("c2").alias("c2"), rep.alias("rep")))
    # blocks with a half string that another block of the anchor has, and blocks that may repeat themselves
    halves = bodies.where("places = 1").select("h", "whole", "copies", "rep", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("c1").alias("c")), F.struct(F.lit(2).alias("side"), F.col("c2").alias("c")))).alias("x"))
    halves = halves.select("h", "whole", "copies", "rep", "x.side", "x.c").where("c IS NOT NULL")
    shared = halves.groupBy("h", "side", "c").count().where("count > 1").drop("count")
    kept = halves.join(shared, ["h", "side", "c"]).groupBy("h", "whole").agg(F.first("copies").alias("copies"), F.first("rep").alias("rep"), F.min("side").alias("s1"), F.max("side").alias("s2"))
    kept = kept.unionByName(bodies.where("places > 1").select("h", "whole", "copies", "rep", F.lit(1).alias("s1"), F.lit(2).alias("s2")))
    # strings of bytes that only the other half could match need not be sorted
    over = F.greatest(F.col("rep.before") - _half(length, False), F.lit(0))  # strings with all of the half before the anchor, but for the last of them
    lo = F.when(~F.col("rep.worded") & (F.col("s1") == 2), F.col("rep.lo") + over).otherwise(F.col("rep.lo"))
    hi = F.when(~F.col("rep.worded") & (F.col("s2") == 1), F.col("rep.lo") + F.least(over + 1, F.col("rep.n"))).otherwise(F.col("rep.lo") + F.col("rep.n"))
    new = {"lo": lo, "n": hi - lo, "at": F.when(F.col("rep.worded"), F.col("rep.at")).otherwise(lo), "size": F.when(F.col("rep.worded"), F.col("rep.size")).otherwise(hi - lo + length - 1)}
    kept = cut(kept.select("h", "copies", F.struct("rep.id", "rep.key", "rep.worded", *[v.alias(c) for c, v in new.items()]).alias("rep")))
    mixed = cut(kept.groupBy("h").agg(F.sum("rep.size").alias("b")))
    total = mixed.agg(F.sum("b").alias("b"), F.sum(F.when(F.col("b") > SHARD_BYTES, F.col("b"))).alias("hot")).first()
    shards = max(1, -(-(total["b"] or 0) // SHARD_BYTES))
    pieces = F.ceil(F.col("b") / SHARD_BYTES)
    shard = 2 * F.pmod(F.xxhash64("h", F.pmod(F.hash("rep.id", "rep.key", "rep.lo"), pieces)), F.lit(shards)) + F.col("rep.worded").cast("int")
    block = F.struct(shard.alias("shard"), (F.col("b") > SHARD_BYTES).alias("split"), (F.col("copies") > 1).alias("twice"), *[F.col(f"rep.{c}").alias(c) for c in BLOCK[3:]])
    blocks = kept.join(mixed, "h").select("rep.id", "rep.key", block.alias("block")).groupBy("id", "key").agg(F.collect_list("block").alias("blocks"))
    d = docs.select(F.col("id").alias("i"), F.col("key").alias("k"), "text")
    ddl = f"shard long, split boolean, twice boolean, worded boolean, lo int, n int, at int, size int, id {kind}, key long, body binary"
    # a text that comes in several rows is cut in each of them; one copy of a block is enough
    cutout = d.join(blocks, d["i"].eqNullSafe(blocks["id"]) & d["k"].eqNullSafe(blocks["key"])).select("id", "key", "text", "blocks").mapInArrow(_cut_blocks(schema(ddl)), ddl)
    n_ranges = max(1, (total["hot"] or 0) // RANGE_ROWS)
    ddl = FOUND.format(id=kind)
    sorted_ = cut(cutout.groupBy("shard").applyInArrow(_sort_shard(length, n_words, schema(ddl), n_ranges), ddl))
    last = F.when(F.col("worded"), F.col("lo") + F.col("n") + (n_words or 0) - 1).otherwise(-1)
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"), F.when(F.col("worded"), F.col("lo")).otherwise(-1).alias("first"), last.alias("last"))
    copied = twice.join(bodies.where("copies > 1").select("h", "whole"), ["h", "whole"]).select("id", "key", F.array(span).cast(SPAN).alias("spans"))
    inside = copied.unionByName(sorted_.where("spans IS NOT NULL").select("id", "key", "spans"))
    if total["hot"]:
        ddl = f"id {kind}, key long, spans {SPAN}"
        merged = sorted_.where("fp1 IS NOT NULL").select("range", *LISTS).groupBy("range")
        inside = inside.unionByName(merged.applyInArrow(_merge_range(n_words, schema(ddl)), ddl))
    out = inside.groupBy("id", "key").agg(F.flatten(F.collect_set("spans")).alias("__spans"))
    return out


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 400, keep: list[str] | None = None, as_text: bool = False,
                   n_words: int | None = None, cut_words: bool = True) -> DataFrame:
    """Add `kept` (binary), `n_bytes`, `n_removed`, `n_spans` and `spans` (start, stop in bytes, merged) to every row.

    Every byte covered by a `length`-byte string that also starts anywhere else, in the
    same text or another, is removed. Strings are judged on the input, bytes are those of
    UTF-8, and no string crosses texts. A null text is empty and has nothing removed, as
    has any text shorter than `length`. Repeated rows are repeats of each other. Null
    ids are one id. `keep` names the input columns to carry (default all); those named
    like an output are replaced. An empty table gives an empty result. With `as_text`,
    `kept` is a string, from which characters that lost a byte are gone altogether.

    With `n_words`, every run of so many words that also starts anywhere else is found as
    well, however few bytes it has, from its first word to its last with what lies between;
    `n_words_removed` counts the words in such runs and `n_word_spans` the runs merged. They
    are removed too unless `cut_words` is false. Words are those of `common.words`: their
    case, and marks and blanks between them, do not count.

    Rows are told apart by id and a hash of the text. A text of any length is searched
    BATCH_BYTES at a time and needs some three times its size when spans are cut out. Text
    is shuffled once to cut blocks and once to cut out spans; anchors are some 30 bytes per
    200 bytes of text, and one copy of each block moves, to shards of `SHARD_BYTES`, if its
    anchor has another.
    """
    if length < GRAM + 8 or (n_words is not None and n_words <= WORD_GRAM):
        raise ValueError(f"length is at least {GRAM + 8}, and n_words {WORD_GRAM + 1}")
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = df.select(q(id).alias("id"), text_key(q(text)).alias("key"), q(text).cast("binary").alias("text"))
    spans = _find_repeats(docs, length, n_words)
    spans = spans.select(F.col("id").alias("__i"), F.col("key").alias("__k"), "__spans")
    names = OUT + (WORD_OUT if n_words is not None else [])
    whole, columns = pack(df, names, keep)
    a = df.select(whole, q(id).alias("__id"), text_key(q(text)).alias("__key"), q(text).cast("binary").alias("__text"))
    j = a.join(spans, a["__id"].eqNullSafe(spans["__i"]) & a["__key"].eqNullSafe(spans["__k"]), "left").select("__in", "__text", "__spans")
    ddl = ("kept string" if as_text else "kept binary") + ", n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>" + "".join(f", {c} long" for c in names[len(OUT):])
    out = T.StructType([j.schema["__in"]] + T._parse_datatype_string(ddl).fields)
    return j.mapInArrow(_remove(to_arrow_schema(out), as_text, cut_words, n_words is not None), out).select(*columns, *names)
