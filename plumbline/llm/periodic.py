"""Runs of words that repeat with a period, found by online catching of squares over dyadic blocks.

Words arrive one after another as whole numbers. Every completed aligned block of m = 1,
2, 4, ... words has a catcher. A square of period q in [2m, 4m) holds an aligned block of
m words in its first half, and that block once more q words later; so the catchers of two
blocks per size are all that a newly appended word can satisfy: the suffix of m words that
ends with it is compared with the two aligned blocks that lie 2m to 4m words back (for
m = 1 also with the word just before). A match is extended to both sides as far as the
period holds. Squares of one period that touch merge into one run, and a match inside a
run already known, at a multiple of its period, says nothing new.

Comparisons use sums of word number times power of a base, so that a suffix of any length
costs one multiplication; each run is confirmed word by word at the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import U64, in_pieces, mix, pack, q, rows_of

BASE = U64(0x9E3779B97F4A7C15 | 1)
APPEND = 1 << 18  # words taken in at a time
BATCH_BYTES = 1 << 20  # text worked on at a time in a task; a longer text is taken alone
OUT = ["n_words", "runs", "collapsed"]


class SquareCatcher:
    """Online run finder over a stream of words that belong to documents.

    `append` takes the next words; `runs` gives the runs of what has come so far. Runs
    have at least `exponent` times their smallest period (2 or more) and `least` words.
    Words of different documents must be different numbers.
    """

    def __init__(self, capacity: int, exponent: int = 2, least: int = 2):
        self.exponent, self.least, self.n = exponent, least, 0
        self.value = np.zeros(capacity, np.int64)
        self.start = np.zeros(capacity, np.int64)  # first word of the document of each word
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(capacity, BASE, U64)]), dtype=U64)
        self.sums = np.zeros(capacity + 1, U64)
        self.found: list[tuple[np.ndarray, ...]] = []

    def append(self, words: np.ndarray, begins: np.ndarray) -> None:
        """Take in `words`, whose documents begin at the stream positions `begins`, and let every catcher look at them."""
        a, n = self.n, self.n + len(words)
        if n == a:
            return
        self.value[a:n], self.start[a:n], self.n = words, begins, n
        with np.errstate(over="ignore"):
            self.sums[a + 1:n + 1] = self.sums[a] + np.cumsum(mix(words.view(U64)) * self.power[a:n], dtype=U64)
        covered = np.arange(a, n)  # for each new word, the first word of a known run of small period that holds it
        edge = np.append(np.flatnonzero(begins[1:] != begins[:-1]) + 1, n - a)
        length = a + edge - begins[edge - 1]  # words of each document
        length[-1] = np.iinfo(np.int64).max  # the last one may go on
        length = np.repeat(length, np.diff(edge, prepend=0))
        late = np.arange(a, n)
        known: list[tuple[int, int, int]] = []
        m = 1
        while True:
            # no longer run than the document, and no block before its first word
            late = late[(length[late - a] >= max(self.least, self.exponent * (2 * m if m > 1 else 1))) & (late - begins[late - a] >= (3 * m - 1 if m > 1 else 1))]
            if not len(late):
                return
            for lo, hi, per in [r for r in known if r[2] <= m]:
                part = covered[max(lo, a) - a:hi - a]
                np.minimum(part, lo, out=part)
            known = [r for r in known if r[2] > m]
            hits = [self._catch(late, m, back) for back in ((1, 2, 3) if m == 1 else (2, 3))]
            block, suffix = (np.concatenate(x) for x in zip(*hits))
            new = covered[suffix + m - 1 - a] > block  # else inside a known run, so at a multiple of its period
            known += self._merge(block[new], suffix[new], m, a)
            m *= 2

    def _same(self, x: np.ndarray, y: np.ndarray, length) -> np.ndarray:
        """Are the `length` words from x and from y (x <= y) the same?"""
        if length == 1:
            return self.value[x] == self.value[y]
        s = self.sums
        with np.errstate(over="ignore"):
            return (s[x + length] - s[x]) * self.power[y - x] == s[y + length] - s[y]

    def _catch(self, late: np.ndarray, m: int, back: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of m words, by their last word, that equal the aligned block `back` blocks before them: starts of block and suffix."""
        suffix = late - (m - 1)
        block = (suffix // m - back) * m
        ok = block >= self.start[late]
        block, suffix = block[ok], suffix[ok]
        same = self._same(block, suffix, m)
        return block[same], suffix[same]

    def _merge(self, block: np.ndarray, suffix: np.ndarray, m: int, a: int) -> list[tuple[int, int, int]]:
        """Chain matches of one period whose blocks follow each other; extend each chain that may be long enough, and keep it."""
        if not len(block):
            return []
        period = suffix - block
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        head = np.ones(len(block), bool)
        head[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + m)
        lo, per = block[head], period[head]
        hi = block[np.append(np.flatnonzero(head)[1:] - 1, len(block) - 1)] + m + per
        top = self.start[hi - 1]
        # a chain grows by less than m words to each side, but for one that began in an earlier append
        left = np.where(lo + per <= a, lo - top, m - 1)
        can = hi - lo + left + m - 1 >= np.maximum(self.exponent * per, self.least)
        lo, hi, per, top = lo[can], hi[can], per[can], top[can]
        if not len(lo):
            return []
        lo = lo - self._extend(lo, per, top, -1)
        hi = hi + self._extend(hi, per, top, 1)
        self.found.append((lo, hi, per))
        return [r for r in zip(lo.tolist(), hi.tolist(), per.tolist()) if r[1] - r[0] >= 2 * r[2]]

    def _extend(self, at: np.ndarray, period: np.ndarray, top: np.ndarray, way: int) -> np.ndarray:
        """How many words before (or from) `at` go on with the period, found by halving."""
        if way < 0:
            most = at - top
        else:
            most = np.minimum(self._ends(at - 1), self.n) - at
        have = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            can = np.flatnonzero(have + step <= most)
            if way < 0:
                x = at[can] - have[can] - step
                ok = self._same(x, x + period[can], step)
            else:
                y = at[can] + have[can]
                ok = self._same(y - period[can], y, step)
            have[can[ok]] += step
            step >>= 1
        return have

    def _ends(self, at: np.ndarray) -> np.ndarray:
        """Position after the last word so far of the document of each word."""
        return np.searchsorted(self.start[:self.n], self.start[at], "right")

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word after the last, and smallest period of every run, ordered by first word, then period."""
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        lo, hi, per = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((-hi, per, lo))  # pieces of one run share start and period; the last is the longest
        lo, hi, per = lo[order], hi[order], per[order]
        first = np.ones(len(lo), bool)
        first[1:] = (lo[1:] != lo[:-1]) | (per[1:] != per[:-1])
        lo, hi, per = lo[first], hi[first], per[first]
        hi = hi + self._extend(hi, per, self.start[lo], 1)
        order = np.lexsort((per, hi, lo))  # a multiple of the period gives the same stretch
        lo, hi, per = lo[order], hi[order], per[order]
        first = np.ones(len(lo), bool)
        first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        keep = np.flatnonzero(first & (hi - lo >= np.maximum(self.exponent * per, self.least)))
        keep = keep[[bool((self.value[lo[k]:hi[k] - per[k]] == self.value[lo[k] + per[k]:hi[k]]).all()) for k in keep]] if len(keep) else keep
        order = keep[np.lexsort((per[keep], lo[keep]))]
        return lo[order], hi[order], per[order]


def _find(exponent: int, least: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "__text", BATCH_BYTES):
            number: dict[bytes, int] = defaultdict(count().__next__)
            texts = [(x or b"").split() for x in b.column("__text").to_pylist()]  # at 0x20 and 0x09 to 0x0D
            sizes = np.array([len(w) for w in texts], np.int64)
            off = np.concatenate([[0], np.cumsum(sizes)])
            # words of different documents never compare equal
            value = np.fromiter((number[w] for words in texts for w in words), np.int64, int(off[-1])) + (rows_of(sizes) << 32)
            begins = np.repeat(off[:-1], sizes)
            catcher = SquareCatcher(int(off[-1]), exponent, least)
            for at in range(0, int(off[-1]), APPEND):
                catcher.append(value[at:at + APPEND], begins[at:at + APPEND])
            lo, hi, per = catcher.runs()
            doc = np.searchsorted(off, lo, "right") - 1
            gone = np.zeros(int(off[-1]) + 1, np.int64)
            np.add.at(gone, lo + per, 1)
            np.add.at(gone, hi, -1)
            kept = np.cumsum(gone[:-1]) == 0
            cut = set(doc.tolist())
            collapsed = [b" ".join(compress(w, kept[off[k]:off[k + 1]].tolist()) if k in cut else w) for k, w in enumerate(texts)]
            found = pa.StructArray.from_arrays([pa.array(lo - off[doc]), pa.array(hi - lo), pa.array(per)], ["start", "length", "period"])
            edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(edge), found).cast(schema.field("runs").type)
            yield pa.RecordBatch.from_arrays([b.column("__in"), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(schema.field("collapsed").type)], schema=schema)
    return run


def find_runs(df: DataFrame, text: str = "text", exponent: int = 4, least: int = 6, keep: Sequence[str] | None = None) -> DataFrame:
    """Add `n_words`, `runs` (start, length, period, in words from 0, by start, then period) and `collapsed` to every row.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A run is a stretch of words
    with a smallest period, at least `exponent` periods (2 or more) and `least` words long,
    that no neighbouring word extends with that period. `collapsed` is the text without the
    words that lie in any run beyond that run's first period, the others joined by one
    space. A null or empty text has no words, no runs and an empty `collapsed`. Each row is
    judged by itself, so repeated rows and ids do not matter; an empty table gives an empty
    result. `keep` names the input columns to carry (default all); those named like an
    output are replaced.

    There is no shuffle. A task works on BATCH_BYTES of text at a time; a longer text is
    taken whole, in appends of APPEND words, and takes some 15 times its size in memory.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    from pyspark.sql.pandas.types import to_arrow_schema

    whole, columns = pack(df, OUT, keep)
    d = df.select(whole, q(text).cast("binary").alias("__text"))
    out = T.StructType([d.schema["__in"]] + T._parse_datatype_string("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").fields)
    return d.mapInArrow(_find(exponent, least, to_arrow_schema(out)), out).select(*columns, *OUT)
