"""Tokens of two tokenizers over one text: where both end, what overlaps, and how often a pair is linked in the corpus.

A text is the byte string S (a blank and the text). A byte range of S gives a fragment: the
tokens of both kinds up to the first place where both end (the open prefix), the closed
groups between such places, and the tokens after the last one (the open suffix). Fragments
of neighbouring ranges compose: the suffix of the left and the prefix of the right are
closed together where their ends now meet, the rest is carried on. Composition is
associative, so a long text is cut into ranges that are tokenised in different tasks and
reduced as a tree.

Ranges are cut where a tokenizer's result cannot depend on what lies beyond, each by its
own rule, so a range may hold tokens of one kind only in part of its bytes.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import in_pieces, lists, pack, q, rows_of
from plumbline.session import cut, release, task_count

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH_BYTES = 1 << 19  # text worked on at a time in a task
RANGE_BYTES = 1 << 16  # a longer text is cut into ranges of about so many bytes
FAN = 16  # fragments composed in one step of the tree
PAIRS_AT_ONCE = 2_000_000  # counts of pairs broadcast at a time
OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
# Fixed value: how byte-level vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# All but the characters on whose class every release of Unicode and every pattern engine agrees.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")
# A blank between ASCII letters or digits starts a new piece of SPLIT; no entry of the piece vocabulary has a blank after another character.
CUT_A = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
CUT_B = re.compile(rb"(?<=[^ ]) (?=.)", re.DOTALL)


def byte_level_bytes() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """The two tokenizers with the bytes of each of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        self.byte_level, self.any = byte_level, None
        whole = json.loads(byte_level)
        model = whole["model"]
        to_byte = byte_level_bytes()
        self.bytes_a = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in whole["added_tokens"])]))
        for token, k in model["vocab"].items():
            if all(c in to_byte for c in token):
                self.bytes_a[k] = bytes(to_byte[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # where entries are numbered in the order of their merges, the same merges can be had faster
        in_order = all(model["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
        ranks = {self.bytes_a[k]: k for k in range(256 + len(merges))} if in_order else {}
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_b = [self._piece(self.sp.id_to_piece(k)) for k in range(self.sp.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        names = [str(k) for k in range(self.width)]
        self.written = np.array([n + s for s in (",", "|", ";", "") for n in names], object)

    @staticmethod
    def _piece(name: str) -> bytes:
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode()

    @classmethod
    def of(cls, files: tuple[bytes, bytes]) -> Tokenizers:
        """One instance per worker process and pair of files."""
        kept = sys.modules.setdefault("_plumbline_tokenizers", ModuleType("_plumbline_tokenizers")).__dict__
        key = f"{hash(files[0])}:{hash(files[1])}"
        if key not in kept:
            kept[key] = cls(*files)
        return kept[key]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Byte-level tokens of strings that carry their leading blank."""
        return [self.fast.encode_ordinary(t) if self.fast is not None and not ODD.search(t) else self._any(t) for t in texts]

    def _any(self, text: str) -> list[int]:
        if self.any is None:
            from tokenizers import Tokenizer

            self.any = Tokenizer.from_str(self.byte_level.decode())
            self.any.encode_special_tokens = True
        return self.any.encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Pieces of strings without their leading blank, which the tokenizer adds."""
        return self.sp.encode(texts, num_threads=1)


@dataclass
class Settled:
    """Units (runs of tokens of both kinds) split into open prefix, closed groups and open suffix; arrays are per unit unless named flat."""

    has: np.ndarray  # is there a place where both end, or where both start?
    head_a: np.ndarray  # tokens of the prefix
    head_b: np.ndarray
    n_a: np.ndarray  # tokens in closed groups
    n_b: np.ndarray
    last: np.ndarray  # byte at which the last closed group ends
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray  # flat: distinct pairs of a unit, ascending
    times: np.ndarray  # flat: how many links each has
    n_pairs: np.ndarray


def settle(tok: Tokenizers, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> Settled:
    """Close what can be closed in units whose tokens `a` and `b` begin at bytes `a0` and `b0`."""
    n = len(na)
    ua, ub = rows_of(na), rows_of(nb)
    la, lb = tok.len_a[a], tok.len_b[b]
    ca, cb = np.cumsum(la), np.cumsum(lb)
    fa, fb = np.cumsum(na), np.cumsum(nb)
    size_a = np.concatenate([[0], ca])[fa] - np.concatenate([[0], ca])[fa - na]
    size_b = np.concatenate([[0], cb])[fb] - np.concatenate([[0], cb])[fb - nb]
    low = np.minimum(a0, b0)
    span = np.maximum(a0 + size_a, b0 + size_b) - low + 2
    base = np.cumsum(span) - span + 1  # where each unit's bytes begin among all
    total = int(span.sum()) + 1
    ends_a = ca - (np.concatenate([[0], ca])[fa - na] - (base + a0 - low))[ua]
    ends_b = cb - (np.concatenate([[0], cb])[fb - nb] - (base + b0 - low))[ub]
    is_a, is_b = np.zeros(total, bool), np.zeros(total, bool)
    is_a[ends_a] = True
    is_b[ends_b] = True
    closed = is_a & is_b
    closed[base[a0 == b0]] = True
    at = np.flatnonzero(closed)
    lo, hi = np.searchsorted(at, base, "left"), np.searchsorted(at, base + span - 1, "left")
    has = hi > lo
    padded = np.append(at, 0)
    first = np.where(has, padded[lo], base + span)  # without one, all is prefix
    final = np.where(has, padded[hi - 1], base + span)
    in_a, in_b = (ends_a > first[ua]) & (ends_a <= final[ua]), (ends_b > first[ub]) & (ends_b <= final[ub])
    head_a = np.bincount(ua, weights=ends_a <= first[ua], minlength=n).astype(np.int64)
    head_b = np.bincount(ub, weights=ends_b <= first[ub], minlength=n).astype(np.int64)
    body_a, body_b = np.bincount(ua, weights=in_a, minlength=n).astype(np.int64), np.bincount(ub, weights=in_b, minlength=n).astype(np.int64)
    # links: the stretches between neighbouring ends, of either kind, inside closed groups
    stop = np.flatnonzero(is_a | is_b)
    unit = np.searchsorted(base, stop, "right") - 1
    inside = (stop > first[unit]) & (stop <= final[unit])
    stop, unit = stop[inside], unit[inside]
    of_a, of_b = (np.cumsum(x, dtype=np.int32)[stop] - x[stop] for x in (is_a, is_b))
    pair = a[of_a] * len(tok.len_b) + b[of_b]
    bits = (len(tok.len_a) * len(tok.len_b)).bit_length()
    key = np.sort((unit << bits) | pair)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    pairs, owner = key[new] & ((1 << bits) - 1), key[new] >> bits
    # groups written out: all tokens in order of group, then kind
    kept_a, kept_b = np.flatnonzero(in_a), np.flatnonzero(in_b)
    group = np.cumsum(closed, dtype=np.int32)
    ga, gb = (group[x] - closed[x] for x in (ends_a[kept_a], ends_b[kept_b]))
    count_a, count_b = np.bincount(ga, minlength=len(at) + 1), np.bincount(gb, minlength=len(at) + 1)
    before_a, before_b = np.concatenate([[0], np.cumsum(count_a)]), np.concatenate([[0], np.cumsum(count_b)])
    code = np.empty(len(kept_a) + len(kept_b), np.int64)
    code[np.arange(len(kept_a)) + before_b[ga]] = a[kept_a] + np.where(is_b[ends_a[kept_a]], tok.width, 0)
    code[np.arange(len(kept_b)) + before_a[gb + 1]] = b[kept_b] + np.where(is_a[ends_b[kept_b]], 2 * tok.width, 0)
    edge = np.concatenate([[0], np.cumsum(body_a + body_b)])
    some = edge[1:] > edge[:-1]
    code[edge[1:][some] - 1] += tok.width  # nothing after the last token
    words = tok.written[code].tolist()
    groups = ["".join(words[x:y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return Settled(has, head_a, head_b, body_a, body_b, final - base + low, np.where(has, hi - lo - 1, 0), np.bincount(unit, minlength=n), groups, pairs, times, np.bincount(owner, minlength=n))


@dataclass
class Fragment:
    """What is known of a byte range: open prefix, closed groups (written out, with their links counted), open suffix."""

    a0: int
    b0: int
    head_a: np.ndarray
    head_b: np.ndarray
    has: bool = False
    last: int = 0
    tail_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tail_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


FIELDS = list(Fragment.__dataclass_fields__)
FRAGMENT = ("a0 long, b0 long, head_a array<long>, head_b array<long>, has boolean, last long, tail_a array<long>, tail_b array<long>, "
            "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def fragment(tok: Tokenizers, a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> Fragment:
    """The fragment of tokens `a` from byte `a0` and `b` from byte `b0`."""
    s = settle(tok, a, np.array([len(a)]), b, np.array([len(b)]), np.array([a0]), np.array([b0]))
    x, y = int(s.head_a[0]), int(s.head_b[0])
    return Fragment(a0, b0, a[:x], b[:y], bool(s.has[0]), int(s.last[0]) if s.has[0] else 0, a[x + int(s.n_a[0]):], b[y + int(s.n_b[0]):],
                    int(s.n_a[0]), int(s.n_b[0]), int(s.n_groups[0]), int(s.n_links[0]), s.groups[0], s.pairs, s.times)


def compose(tok: Tokenizers, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    open_a, open_b, at = (left.tail_a, left.tail_b, (left.last, left.last)) if left.has else (left.head_a, left.head_b, (left.a0, left.b0))
    middle = fragment(tok, np.concatenate([open_a, right.head_a]), np.concatenate([open_b, right.head_b]), *at)
    body = [f for f in ((left,) if left.has else ()) + (middle,) + ((right,) if right.has else ())]
    head, tail = left if left.has else middle, right if right.has else middle
    pairs, where = np.unique(np.concatenate([f.pairs for f in body]), return_inverse=True)
    times = np.bincount(where, weights=np.concatenate([f.times for f in body]), minlength=len(pairs)).astype(np.int64)
    return Fragment(left.a0, left.b0, head.head_a, head.head_b, left.has or middle.has or right.has, tail.last, tail.tail_a, tail.tail_b,
                    *(sum(getattr(f, c) for f in body) for c in ("n_a", "n_b", "n_groups", "n_links")), ";".join(f.groups for f in body if f.groups), pairs, times)


def _tokens(tok: Tokenizers, with_blank: list[str], without: list[str]) -> tuple[np.ndarray, ...]:
    """Flat tokens of both kinds with their counts, and which units give back their bytes."""
    ids_a, ids_b = tok.encode_a(with_blank), tok.encode_b(without)
    na, nb = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, na), (ids_b, nb)))
    # byte-level tokens are parts of the text or missing, so their length tells; pieces may differ from it
    raw = [s.encode() for s in with_blank]
    size = np.concatenate([[0], np.cumsum(tok.len_a[a])])
    end = np.cumsum(na)
    ok = size[end] - size[end - na] == np.array([len(x) for x in raw])
    piece = tok.bytes_b.__getitem__
    ok &= np.array([b"".join(map(piece, y)) == (b" " + t.encode() if t else b"") for y, t in zip(ids_b, without)], bool)
    return a, na, b, nb, ok


def _whole(files, digest: bool, schema: pa.Schema):
    """Rows of texts that fit a range: aligned in place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers.of(files.value)
        for b in in_pieces(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in b.column("text").to_pylist()]
            a, na, p, nb, ok = _tokens(tok, [" " + t if t else "" for t in texts], texts)
            if not ok.all():  # such texts have no tokens
                a, p, na, nb = a[np.repeat(ok, na)], p[np.repeat(ok, nb)], na * ok, nb * ok
            zero = np.zeros(len(texts), np.int64)
            s = settle(tok, a, na, p, nb, zero, zero)
            yield _documents(schema, b.column("r"), b.column("__in"), s.n_a, s.n_b, s.n_groups, s.n_links, s.groups, s.pairs, s.times, s.n_pairs, digest)
    return run


def _documents(schema, r, row, n_a, n_b, n_groups, n_links, groups, pairs, times, n_pairs, digest) -> pa.RecordBatch:
    from hashlib import sha256

    shown = [sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups
    cols = [r, row, *[pa.array(np.asarray(x, np.int64)) for x in (n_a, n_b, n_groups, n_links)], pa.array(shown, pa.string()), lists(pairs, n_pairs, pa.int64()), lists(times, n_pairs, pa.int32())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)


def cut_ranges(whole: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges (a from, a to, b from, b to) of S, one for every `size` bytes, cut where tokens of that kind surely end."""
    marks = range(size, len(whole), size)
    cuts = [[0] + [m.start() if (m := rule.search(whole, at)) else len(whole) for at in marks] + [len(whole)] for rule in (CUT_A, CUT_B)]
    return [(w, x, y, z) for w, x, y, z in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:]) if x > w or z > y]


def _cut_long(schema: pa.Schema, size: int):
    """Rows of long texts to one row per range; the first carries the input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", 1):
            whole = b" " + b.column("text")[0].as_py().encode()
            parts = cut_ranges(whole, size)
            n = len(parts)
            row = b.column("__in").take(pa.array([0] + [None] * (n - 1), pa.int64()))
            cols = [pa.array([b.column("r")[0].as_py()] * n), pa.array(range(n), pa.int64()), row, pa.array([p[0] for p in parts]), pa.array([whole[p[0]:p[1]].decode() for p in parts]),
                    pa.array([p[2] for p in parts]), pa.array([whole[p[2]:p[3]].decode() for p in parts])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)
    return run


def _rows(schema: pa.Schema, ids: list[tuple], rows: pa.Array, found: list[Fragment | None]) -> pa.RecordBatch:
    """Fragments as a batch `(r, seq, __in, ok, fragment)`; None where a range does not give back its bytes."""
    empty = Fragment(0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    cols = [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), rows, pa.array([f is not None for f in found])]
    cols += [pa.array([getattr(f or empty, c) for f in found], schema.field(c).type) for c in FIELDS]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)


def _fragments(files, schema: pa.Schema):
    """One fragment per range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers.of(files.value)
        for b in in_pieces(batches, "b_text", BATCH_BYTES):
            a_text, b_text = b.column("a_text").to_pylist(), b.column("b_text").to_pylist()
            a, na, p, nb, ok = _tokens(tok, a_text, [t[1:] for t in b_text])
            x, y = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
            begins = zip(b.column("a0").to_pylist(), b.column("b0").to_pylist())
            found = [fragment(tok, a[x[k]:x[k + 1]], p[y[k]:y[k + 1]], *at) if ok[k] else None for k, at in enumerate(begins)]
            yield _rows(schema, list(zip(b.column("r").to_pylist(), b.column("seq").to_pylist())), b.column("__in"), found)
    return run


def _compose(files, schema: pa.Schema, fan: int):
    """Neighbouring fragments of a document to one."""
    def run(table: pa.Table) -> pa.Table:
        tok = Tokenizers.of(files.value)
        t = table.sort_by("seq").combine_chunks()
        ids = (t.column("r")[0].as_py(), t.column("seq")[0].as_py() // fan)
        out = None
        if all(t.column("ok").to_pylist()):
            for row in t.select(FIELDS).to_pylist():
                f = Fragment(**{c: np.array(v, np.int64) if isinstance(v, list) else v for c, v in row.items()})
                out = f if out is None else compose(tok, out, f)
        return pa.Table.from_batches([_rows(schema, [ids], t.column("__in").combine_chunks().slice(0, 1), [out])])
    return run


def _close(digest: bool, schema: pa.Schema):
    """Whole documents from their one fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c) for c in ("r", "__in")] + [b.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups", "n_links")]
            pairs, times = b.column("pairs"), b.column("times")
            yield _documents(schema, *cols, b.column("groups").to_pylist(), pairs.flatten().to_numpy(), times.flatten().to_numpy(), pairs.value_lengths().to_numpy(), digest)
    return run


def align_documents(df: DataFrame, text: str, folder: str, digest: bool, columns: Sequence[str] | None = None) -> tuple[DataFrame, list, int]:
    """Rows `(r, __in, n_a, n_b, n_groups, n_links, groups, pairs, times)`, what turns `__in` into columns, and the size of the second vocabulary."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sc = df.sparkSession.sparkContext
    with open(f"{folder}/{BYTE_LEVEL}", "rb") as x, open(f"{folder}/{PIECES}", "rb") as y:
        files = sc.broadcast((x.read(), y.read()))  # two vocabulary files of a few MB
    whole, out_columns = pack(df, OUT, columns)
    d = df.select(whole, F.monotonically_increasing_id().alias("r"), q(text).cast("string").alias("text"))
    one = d.schema["__in"]
    many = T.StructField("__in", one.dataType, True)

    def kind(*parts) -> T.StructType:
        return T.StructType([f for p in parts for f in ([p] if isinstance(p, T.StructField) else T._parse_datatype_string(p).fields)])

    doc = kind("r long", many, "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")
    is_long = F.coalesce(F.octet_length("text") > RANGE_BYTES, F.lit(False))
    docs = d.where(~is_long).mapInArrow(_whole(files, digest, to_arrow_schema(doc)), doc)
    longest = df.agg(F.max(F.octet_length(q(text)))).first()[0] or 0
    if longest > RANGE_BYTES:
        part = kind("r long, seq long", many, "a0 long, a_text string, b0 long, b_text string")
        frag = kind("r long, seq long", many, "ok boolean, " + FRAGMENT)
        arrow = to_arrow_schema(frag)
        f = d.where(is_long).mapInArrow(_cut_long(to_arrow_schema(part), RANGE_BYTES), part).repartition(task_count(df.sparkSession), "r", "seq").mapInArrow(_fragments(files, arrow), frag)
        for _ in range(max(1, math.ceil(math.log(longest / RANGE_BYTES + 1, FAN) - 1e-9))):
            f = f.groupBy("r", F.floor(F.col("seq") / FAN)).applyInArrow(_compose(files, arrow, FAN), frag)
        docs = docs.unionByName(f.mapInArrow(_close(digest, to_arrow_schema(doc)), doc))
    return docs, out_columns, len(Tokenizers.of(files.value).bytes_b)


def align_tokenizers(df: DataFrame, text: str = "text", folder: str = FOLDER, digest: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Add `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum` and `groups` to every row.

    Kind A are the tokens of BYTE_LEVEL over a blank and the text, kind B those of PIECES
    over the text, both without special tokens, whose strings in a text are plain text.
    Offsets where both kinds end cut the tokens into groups, written as
    `a1,a2|b1;a3|b2,b3` (with `digest` their SHA-256 in hex). A link is a pair of an A and
    a B token that share a byte. A pair of ids counts as many rows as hold it linked;
    `count_sum` adds the counts of a row's links, `n_best` counts its links whose count is
    the highest that their A id has in the table. Null and empty texts, and those whose
    tokens do not give back a blank and the text, have no tokens: zeros and an empty
    `groups`. Repeated rows count as often as they come. `keep` names the input columns to
    carry (default all); those named like an output are replaced. An empty table gives an
    empty result.

    Texts stay where they are, but for those above RANGE_BYTES, whose ranges are tokenised
    in several tasks and composed FAN at a time; a stretch without a blank is one range.
    A row's pairs are written once. Counts of pairs are broadcast PAIRS_AT_ONCE at a time,
    so that links are never shuffled, only their sums, one row per task and document.
    """
    docs, columns, n_b = align_documents(df, text, folder, digest, keep)
    t = cut(docs)
    counts = cut(t.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    of_a = F.expr(f"pair div {n_b}")
    top = counts.groupBy(of_a.alias("a")).agg(F.max("docs").alias("most"))
    counts_ = cut(counts.withColumn("a", of_a).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    blocks = max(1, -(-counts_.count() // PAIRS_AT_ONCE))
    links = t.select("r", F.inline(F.arrays_zip("pairs", "times")))
    sums = None
    for k in range(blocks):
        mine = F.pmod(F.hash("pairs"), F.lit(blocks)) == k
        here = F.broadcast(counts_.where(F.pmod(F.hash("pair"), F.lit(blocks)) == k))
        s = (links.where(mine) if blocks > 1 else links).join(here, F.col("pairs") == F.col("pair")).groupBy("r").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        sums = s if sums is None else sums.unionByName(s)
    if blocks > 1:
        sums = sums.groupBy("r").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    release(counts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return t.select("r", "__in", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "r", "left").select(
        *columns, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
