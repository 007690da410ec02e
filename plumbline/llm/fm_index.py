"""Benchmark decontamination: an FM-index per shard of training text, searched for benchmark phrases.

Texts become word numbers of the phrases' vocabulary. Only runs of known words at least
as long as the shortest phrase can hold a phrase, so a shard's index covers those runs.
The Burrows-Wheeler transform of the runs is kept as a wavelet tree; all phrases are
searched backwards at once, occurrences are located by walking to sampled suffix
positions, and the words they cover become removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import U64, flat_text, in_pieces, pack, q, ranges, rows_of, words
from plumbline.llm.suffix import suffix_array

WINDOW = 10  # words in a phrase
PHRASES_PER_BLOCK = 200_000  # phrases broadcast at a time: about 10 MB
SHARD_BYTES = 1 << 20  # text indexed at a time
SAMPLE = 16  # every SAMPLE-th position of a run is stored
LOCATE = 1 << 20  # occurrences located at a time
OUT = ["n_words", "n_hit", "items", "spans", "clean"]


class WaveletTree:
    """Bit planes of a sequence, highest bit first, zeros moved before ones at each plane."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.planes = []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, bit.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((packed, ones, int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    @staticmethod
    def _ones(plane, i):
        packed, ones, _ = plane
        w = i >> 6
        return ones[w] + np.bitwise_count(packed[w] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place `i`, plus where its run begins in the last plane."""
        top = len(self.planes) - 1
        for k, plane in enumerate(self.planes):
            one = (symbol >> (top - k)) & 1
            ones = self._ones(plane, i)
            i = np.where(one == 1, plane[2] + ones, i - ones)
        return i

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(i), np.int64)
        for plane in self.planes:
            one = ((plane[0][i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(np.int64)
            out = out * 2 + one
            ones = self._ones(plane, i)
            i = np.where(one == 1, plane[2] + ones, i - ones)
        return out


class FMIndex:
    """Backward search over runs of symbols laid end to end (symbols from 1, 0 is the end of a run)."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, bits: int):
        n = len(symbols)
        sa, _ = suffix_array(symbols, lengths, bits)
        runs = len(lengths)
        starts = np.cumsum(lengths) - lengths
        inside = np.arange(n) - np.repeat(starts, lengths)
        # the end marks of the runs sort before everything; what stands before a mark is its run's last symbol
        before = np.zeros(n, np.int64)
        before[1:] = symbols[:-1]
        before[starts] = 0
        bwt = np.concatenate([symbols[starts + lengths - 1], before[sa]])
        self.n = n + runs
        self.tree = WaveletTree(bwt, bits)
        count = np.bincount(symbols, minlength=(1 << bits) + 1)
        self.first = runs + np.cumsum(count) - count  # symbol 0 is counted by `runs`
        zeros = np.array([0])
        self.base = self.tree.rank(np.arange(1 << bits), np.zeros(1 << bits, np.int64)) if n else zeros
        kept = inside[sa] % SAMPLE == 0
        self.sampled = np.concatenate([np.zeros(runs, bool), kept])
        self.position = np.cumsum(self.sampled) - 1
        self.value = sa[kept]

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, i) - self.base[symbol]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the suffixes that begin with each phrase; rows of `phrases` are right-aligned."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1]):
            live = live[(sizes[live] > j) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - j].astype(np.int64)
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at the given places."""
        out, steps, live = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.arange(len(place))
        at = place.copy()
        while len(live):
            done = self.sampled[at[live]]
            hit = live[done]
            out[hit] = self.value[self.position[at[hit]]] + steps[hit]
            live = live[~done]
            at[live] = self.step(self.tree.at(at[live]), at[live])
            steps[live] += 1
        return out


def phrase_block(item_ids: list[str | None], texts: pa.Array, window: int) -> dict | None:
    """The distinct phrases of some items, their vocabulary and the items of each phrase."""
    data, off = flat_text(texts)
    _, _, h, first = words(data, off)
    if not len(h):
        return None
    vocab, number = np.unique(h, return_inverse=True)
    n = np.diff(first)
    windows = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
    item = rows_of(windows)
    start = ranges(first[:-1], windows)
    size = np.minimum(n[item], window)
    grid = np.zeros((len(start), window), np.int32)
    for j in range(window):  # right-aligned
        has = j < size
        grid[has, window - 1 - j] = number[start[has] + size[has] - 1 - j] + 1
    phrases, which = np.unique(grid, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), item]), axis=1)
    return {"vocab": vocab, "phrases": phrases, "sizes": (phrases > 0).sum(axis=1), "shortest": int(size.min()),
            "item_of": pairs[1], "item_from": np.searchsorted(pairs[0], np.arange(len(phrases) + 1)), "ids": item_ids}


def _find(block: dict, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of a shard (begin, end, first of each text), which are hit, and the (text, item) pairs found."""
    begin, end, h, first = words(data, off)
    hit = np.zeros(len(h) + 1, np.int64)
    none = np.zeros(0, np.int64)
    vocab = block["vocab"]
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    number = np.where(vocab[at] == h, at + 1, 0)
    known = number > 0
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = ~known[1:] | ~known[:-1]
    edge[first[first <= len(h)]] = True
    start = np.flatnonzero(edge)
    length = np.diff(start)
    start = start[:-1]
    use = known[start] & (length >= block["shortest"]) if len(start) else np.zeros(0, bool)
    start, length = start[use], length[use]
    if not len(start):
        return begin, end, first, hit[:-1] > 0, none, none
    word = ranges(start, length)
    index = FMIndex(number[word], length, max(1, int(len(vocab)).bit_length()))
    lo, hi = index.search(block["phrases"], block["sizes"])
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    texts, items = [none], [none]
    done = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(found):  # LOCATE occurrences at a time, at least one phrase
        j = max(i + 1, int(np.searchsorted(done, done[i] + LOCATE, "right")) - 1)
        phrase = np.repeat(found[i:j], count[i:j])
        place = ranges(lo[found[i:j]], count[i:j])
        w = word[index.locate(place)]
        np.add.at(hit, w, 1)
        np.add.at(hit, w + block["sizes"][phrase], -1)
        text = np.searchsorted(first, w, "right") - 1
        pair = np.unique(text * len(block["phrases"]) + phrase)
        text, phrase = pair // len(block["phrases"]), pair % len(block["phrases"])
        per = block["item_from"][phrase + 1] - block["item_from"][phrase]
        texts.append(np.repeat(text, per))
        items.append(block["item_of"][ranges(block["item_from"][phrase], per)])
        i = j
    pair = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)]), axis=1)
    return begin, end, first, np.cumsum(hit[:-1]) > 0, pair[0], pair[1]


def _merge(a: np.ndarray, b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row as word numbers, overlapping and touching ones as one."""
    order = np.lexsort((a, row))
    a, b, row = a[order], b[order], row[order]
    if not len(a):
        return a, b, row
    reach = np.maximum.accumulate(b + row * (b.max() + 1)) - row * (b.max() + 1)
    new = np.ones(len(a), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return a[head], reach[np.append(head[1:], len(a)) - 1], row[head]


def _scan(block, first_pass: bool, last: bool, remove: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = block.value if block is not None else None
        for b in in_pieces(batches, "__text", SHARD_BYTES):
            data, off = flat_text(b.column("__text"))
            if tab is None:
                begin, end, _, first = words(data, off)
                hit, text, item, ids = np.zeros(len(begin), bool), [], [], []
            else:
                begin, end, first, hit, text, item = _find(tab, data, off)
                ids = tab["ids"]
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # a run of hit words may go on into the next text
            row = np.searchsorted(first, a, "right") - 1
            over = np.searchsorted(first, z, "left") - 1 - row
            parts = rows_of(over + 1)
            row = row[parts] + ranges(np.zeros(len(a), np.int64), over + 1)
            a, z = np.maximum(a[parts], first[row]), np.minimum(z[parts], first[row + 1])
            full = z > a
            a, z, row = a[full], z[full], row[full]
            found: list[set] = [set() for _ in range(b.num_rows)]
            for t, i in zip(text, item):
                if ids[i] is not None:
                    found[t].add(ids[i])
            if not first_pass:
                old = b.column("__spans")
                sizes = old.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = old.flatten()
                a, z, row = _merge(np.concatenate([a, flat.field("first").to_numpy() + first[rows_of(sizes)]]),
                                   np.concatenate([z, flat.field("after").to_numpy() + first[rows_of(sizes)]]), np.concatenate([row, rows_of(sizes)]))
                for s, more in zip(found, b.column("__items").to_pylist()):
                    s.update(more)
            per = np.bincount(row, minlength=b.num_rows)
            items = pa.array([sorted(s) for s in found], pa.list_(pa.string()))
            if not last:
                where = pa.StructArray.from_arrays([pa.array((a - first[row]).astype(np.int32)), pa.array((z - first[row]).astype(np.int32))], ["first", "after"])
                cols = [b.column("__in"), b.column("__text"), items, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), where)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
                continue
            n_hit = np.bincount(row, weights=z - a, minlength=b.num_rows).astype(np.int64)
            s, e = begin[a], end[z - 1]
            where = pa.StructArray.from_arrays([pa.array((s - off[row]).astype(np.int32)), pa.array((e - off[row]).astype(np.int32))], ["start", "stop"])
            cols = [b.column("__in"), pa.array(np.diff(first)), pa.array(n_hit), items, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), where)]
            if remove:
                gone = np.zeros(len(data) + 1, np.int64)
                gone[s] += 1
                gone[e] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                kept_off = (off - total[off]).astype(np.int64)
                null = b.column("__text").is_null().to_numpy(zero_copy_only=False)
                mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
                cols.append(pa.Array.from_buffers(pa.large_string(), b.num_rows, [mask, pa.py_buffer(kept_off.tobytes()), pa.py_buffer(data[~gone].tobytes())]))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def _blocks(items: DataFrame, id: str, text: str, window: int) -> Iterator[dict]:
    """The items in blocks of at most about PHRASES_PER_BLOCK phrases, fetched one block at a time."""
    rows = items.select(q(id).cast("string").alias("id"), q(text).alias("text")).where("text IS NOT NULL").toLocalIterator()
    ids, texts, size = [], [], 0
    for r in rows:
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"]) // 4 + 1
        if size >= PHRASES_PER_BLOCK:
            if (block := phrase_block(ids, pa.array(texts, pa.large_string()), window)) is not None:
                yield block
            ids, texts, size = [], [], 0
    if texts and (block := phrase_block(ids, pa.array(texts, pa.large_string()), window)) is not None:
        yield block


def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       keep: list[str] | None = None, remove: bool = False) -> DataFrame:
    """Add `n_words`, `n_hit`, `items`, `spans` (start, stop in bytes) and, with `remove`, `clean` to every row.

    A phrase is `window` consecutive words of an item; an item of fewer words, but not
    none, is one phrase. A word is hit when it lies inside an occurrence of a phrase;
    `items` are the ids, as sorted strings, of the items with a phrase that occurs, a
    null id left out; an id that comes twice counts once. Words are runs of digits, a-z
    in either case and non-ASCII characters. `spans` run from the first to the last
    byte of adjacent hit words and are what `clean` lacks; a null text has no words and
    stays null. `keep` names the input columns to carry (default all); those named like
    an output are replaced. Repeated rows are treated alike; an empty table gives an
    empty result, and with no items nothing is hit.

    No shuffle. Phrases are broadcast in blocks of bounded size and each block makes
    one pass over the text, so the list of items may be of any length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    sc = df.sparkSession.sparkContext
    out = OUT if remove else OUT[:-1]
    whole, columns = pack(df, out, keep)
    d = df.select(whole, q(text).alias("__text"))
    blocks = [sc.broadcast(b) for b in _blocks(items, item_id, item_text, window)] or [None]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        more = ("n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>" + ", clean string" * remove if last
                else "__text string, __items array<string>, __spans array<struct<first:int,after:int>>")
        schema = T.StructType([d.schema["__in"]] + T._parse_datatype_string(more).fields)
        d = d.mapInArrow(_scan(block, k == 0, last, remove, to_arrow_schema(schema)), schema)
    return d.select(*columns, *out)
