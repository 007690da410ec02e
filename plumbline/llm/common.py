"""Helpers shared by the operators: flat views of Arrow text, hashing, row keys, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
# The bytes that are part of a word, A-Z counting as a-z.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[list(WORD_BYTES)] = True


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of `df` that stay when an operator adds `names`; an input column of the same name is replaced."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def q(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, out: Sequence[str], keep: Sequence[str] | None = None) -> tuple[Column, list[Column]]:
    """The input columns an operator carries as one struct `__in`, and what turns it into columns again.

    Inside an operator no input column can then clash with one of its own.
    """
    names = [c for c in without(df, out) if keep is None or c in keep]
    whole = F.struct(*[q(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))
    return whole.alias("__in"), [F.col("__in").getField(c).alias(c) for c in names]


def text_key(text: Column) -> Column:
    """64 bits that tell texts of one id apart."""
    return F.xxhash64(text)


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more than there are texts). Null is empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def in_pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column`; one longer text is a batch of its own."""
    give_back()  # what the task before this one left in the worker
    for b in batches:
        if not b.num_rows:
            continue
        _, off = flat_text(b.column(column))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi
    give_back()


def give_back() -> None:
    """Return what a task has freed to the system: its worker stays, and waits beside the heap for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


BASE = 0x9E3779B97F4A7C15 | 1
STEP = 65_536
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate([[1], np.full(STEP, BASE, U64)]).astype(U64), dtype=U64)
BYTE_VALUES = mix(np.arange(256, dtype=U64), 7)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: first byte, byte after the last, hash of the lower-cased word, and per text the number of its first word.

    A word is a run of digits, letters a-z in either case and bytes above 0x7F; it never crosses texts.
    """
    low = LOWER[data]
    is_word = IS_WORD[low]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, is_word
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[off] = True
    begin = np.flatnonzero(is_word & (~before[:-1] | starts_text[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = is_word, False
    end = np.flatnonzero(is_word & (~after[1:] | starts_text[1:])) + 1
    # sum of value * BASE^position within the word; the power restarts every STEP bytes of the flat text
    with np.errstate(over="ignore"):
        length = end - begin
        value = BYTE_VALUES[low]
        h = np.zeros(len(begin), U64)
        todo = np.arange(len(begin))
        j = 0
        while len(todo) and j < 24:  # most words are short
            h[todo] += value[begin[todo] + j] * POWERS[j]
            j += 1
            todo = todo[length[todo] > j]
        for i in todo:  # the few long ones
            for at in range(int(begin[i]) + 24, int(end[i]), STEP - 24):
                part = value[at:min(at + STEP - 24, int(end[i]))]
                h[i] = mix(h[i:i + 1])[0] + (part * POWERS[:len(part)]).sum(dtype=U64)
    return begin, end, mix(h ^ mix(length.astype(U64), 3)), np.searchsorted(begin, off).astype(np.int64)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 1, 1, ...: the number of the group for every member."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the ranges `starts[i] .. starts[i] + counts[i]`, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and list lengths."""
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))
