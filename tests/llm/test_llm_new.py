"""Shards, token alignment and periodic runs against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm_operators import FOLDER, odd_documents

from plumbline.llm import alignment, periodic, queries, sharding

FILES = tuple(open(f"{alignment.FOLDER}/{f}", "rb").read() for f in (alignment.BYTE_LEVEL, alignment.PIECES))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 ----

def check_shards(rows, n, slack):
    """Near equal bytes, gapless slots in the order of the hashed texts, shards as ranges of it, equal texts together."""
    total, by = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n))
    keys, at = [], 0
    for s in range(n):
        mine = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        keys += [hashlib.md5((r["text"] or "").encode()).hexdigest()[:sharding.TEXT_HEX] for r in mine]
        at += sum(r["size"] for r in mine)
        if s < n - 1:  # where a shard ends: nearest border, or within the tolerance
            assert abs(at - total * (s + 1) / n) <= max(slack * total / n, max(r["size"] for r in rows) / 2 + 1)
    assert keys == sorted(keys)


@pytest.mark.parametrize("cell", [16 << 20, 5_000])
def test_shards_of_documents(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_BYTES", cell)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_shards(sharding.histogram_shards(docs, 16).collect(), 16, sharding.TOLERANCE)
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = queries.QUERIES["op11_histogram_shards"](spark, FOLDER).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in want.items()}


@pytest.mark.parametrize("cell", [16 << 20, 2_000])
def test_shards_with_a_text_that_a_third_of_the_rows_share(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_BYTES", cell)
    rows = [(k, "the same text again " * 3 if k % 3 == 0 else f"text {k} " * (k % 40)) for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.histogram_shards(d, 16).collect()
    check_shards(out, 16, 0.02)
    again = sharding.histogram_shards(d.repartition(5), 16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_shards_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = sharding.histogram_shards(docs, 4)
    assert set(docs.columns) <= set(out.columns)
    assert sorted(str(r) for r in out.select(*[F.col(f"`{c}`") for c in docs.columns]).collect()) == sorted(str(r) for r in docs.collect())
    check_shards(out.collect(), 4, 0.01)
    assert sharding.histogram_shards(docs.where("false"), 4).count() == 0
    same = sharding.histogram_shards(spark.createDataFrame([(1, "x" * 50, 7, 8)] * 800, "doc_id long, text string, shard int, slot int"), 16).collect()
    assert set(Counter(r["shard"] for r in same).values()) == {50} and same[0].asDict().keys() == {"doc_id", "text", "size", "shard", "slot"}
    named = sharding.histogram_shards(docs.withColumn("size", F.lit("x")), 3, id="id", text="key")
    assert dict(named.dtypes)["size"] == "bigint" and named.count() == docs.count()


def test_splitters_by_brute_force(spark):
    rng = random.Random(2)
    for rows, n, tolerance in [([(rng.randrange(1 << 60), rng.randrange(1, 90)) for _ in range(500)], 7, 0.0), ([(rng.randrange(40), 1) for _ in range(500)], 5, 0.0),
                               ([((1 << 60) - 1 - k, 10 ** (k % 3)) for k in range(200)], 9, 0.0), ([(rng.randrange(1 << 60), 3) for _ in range(400)], 3, 0.05)]:
        d = spark.createDataFrame(rows, "key long, size long")
        got, _ = sharding.find_splitters(d, n, tolerance)
        total, keys = sum(w for _, w in rows), sorted({k for k, _ in rows})
        below = lambda s: sum(w for k, w in rows if k < s)
        for i, s in enumerate(got, 1):
            best = min(abs(below(x) - total * i / n) for x in [*keys, keys[-1] + 1])
            assert abs(below(s) - total * i / n) <= max(best, tolerance * total / n)
        parts = d.select("key", sharding.part_of(F.col("key"), got).alias("p")).collect()
        assert all(r.p == sum(s <= r.key for s in got) for r in parts)


def test_shards_are_written_in_order(spark, tmp_path):
    d = sharding.histogram_shards(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), 4)
    sharding.write_shards(d, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 4
    assert spark.read.parquet(f"{tmp_path}/out/shard=2").count() == d.where("shard = 2").count()


# ---- 12 ----

def brute_alignment(tok, text):
    """Counts, links and the written groups of a text, token by token."""
    if not text:
        return 0, 0, 0, [], ""
    tok._any("")  # the plain tokenizer is the reference, never the faster one
    a, b = tok.any.encode(" " + text, add_special_tokens=False).ids, tok.sp.encode(text)
    whole = (" " + text).encode()
    if b"".join(tok.bytes_a[k] for k in a) != whole or b"".join(tok.bytes_b[k] for k in b) != whole:
        return 0, 0, 0, [], ""
    end_a, end_b = np.cumsum(tok.len_a[a]).tolist(), np.cumsum(tok.len_b[b]).tolist()
    i = j = 0
    links, groups, ga, gb = [], [], [], []
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = end_a[i], end_b[j]
        if x <= y:
            ga.append(a[i])
            i += 1
        if y <= x:
            gb.append(b[j])
            j += 1
        if x == y:
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            ga, gb = [], []
    return len(a), len(b), len(groups), links, ";".join(groups)


def brute_table(texts):
    tok = alignment.Tokenizers.of(FILES)
    found = [brute_alignment(tok, t) for t in texts]
    docs = Counter(x for f in found for x in set(f[3]))
    most = Counter()
    for (a, _), c in docs.items():
        most[a] = max(most[a], c)
    return [(na, nb, ng, len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), g) for na, nb, ng, links, g in found]


@pytest.mark.parametrize("size,fan,pairs", [(1 << 16, 16, 2_000_000), (300, 3, 1000)])
def test_alignment_by_brute_force(spark, monkeypatch, size, fan, pairs):
    monkeypatch.setattr(alignment, "RANGE_BYTES", size)
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", pairs)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute_table([r.text for r in rows]))}
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == {i: (*w[:6], sha(w[6]) if w[6] else "") for i, w in want.items()}


@pytest.mark.parametrize("size", [1 << 16, 200])
def test_alignment_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "RANGE_BYTES", size)
    odd = ["<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b", "  two  blanks  ", "\x00\x01 \x85\xa0  x", "tab\there\r\n\n line", "don't I'll we've 12,345.67", "ﬁ é ́x ½ ² ª", "क्षत्रिय 日本 🙂👩‍👩‍👧 end", "a" * 700,
           "x " * 400 + "▁" + " y" * 300, "blank at the end ", ". . . , word. Next? " * 30, "", None, "naïve café " * 60, "퟿ " * 40]
    docs = odd_documents(spark)
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    d = docs.unionByName(extra, allowMissingColumns=True).withColumn("n_a", F.lit("x"))
    out = alignment.align_tokenizers(d)
    rows = out.collect()
    given_rows = d.collect()
    want = Counter((r["doc_id"], r["text"], *w) for r, w in zip(given_rows, brute_table([r["text"] for r in given_rows])))
    assert Counter((r["doc_id"], r["text"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in rows) == want
    assert set(docs.columns) <= set(out.columns) and dict(out.dtypes)["n_a"] == "bigint"
    assert alignment.align_tokenizers(docs.where("false")).count() == 0


def as_plain(f):
    return tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in vars(f).values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " the", "unusually", " zyxq", "'s", " 12", ".", " ", "\n", "é", "日", " a"]), min_size=1, max_size=40), st.data())
def test_fragments_compose_in_any_order(parts, data):
    """Ranges cut at any token end, each kind for itself, compose to the whole however they are bracketed."""
    tok = alignment.Tokenizers.of(FILES)
    text = "".join(parts)
    a, b = np.array(tok.encode_a([" " + text])[0]), np.array(tok.encode_b([text])[0])
    n = data.draw(st.integers(1, 6))
    cuts = [sorted(data.draw(st.lists(st.integers(0, len(x)), min_size=n - 1, max_size=n - 1))) for x in (a, b)]
    ia, ib = [0, *cuts[0], len(a)], [0, *cuts[1], len(b)]
    at_a, at_b = np.concatenate([[0], np.cumsum(tok.len_a[a])]), np.concatenate([[0], np.cumsum(tok.len_b[b])])
    pieces = [alignment.fragment(tok, a[ia[k]:ia[k + 1]], b[ib[k]:ib[k + 1]], int(at_a[ia[k]]), int(at_b[ib[k]])) for k in range(n)]
    whole = as_plain(alignment.fragment(tok, a, b, 0, 0))
    while len(pieces) > 1:
        k = data.draw(st.integers(0, len(pieces) - 2))
        pieces[k:k + 2] = [alignment.compose(tok, pieces[k], pieces[k + 1])]
    assert as_plain(pieces[0]) == whole


def test_ranges_give_the_tokens_of_the_whole():
    tok = alignment.Tokenizers.of(FILES)
    rng = random.Random(6)
    words = ["word", "don't", "x.", " ", "\n", "\t", "12", "(a)", "é", "日本語", "a-b", "''", "…", "I'll", "  "]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))
        whole = (" " + text).encode()
        for size in (5, 17, 64):
            parts = alignment.cut_ranges(whole, size)
            a = [k for p in parts for k in tok.encode_a([whole[p[0]:p[1]].decode()])[0]]
            b = [k for p in parts for k in tok.encode_b([whole[p[2]:p[3]].decode()[1:]])[0]]
            assert a == tok._any(" " + text) and b == tok.sp.encode(text)


# ---- 13 ----

def brute_runs(w, exponent, least):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(exponent * p, least):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((lo, p, hi) for (lo, hi), p in found.items())


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_runs_word_by_word_by_brute_force(step):
    rng = random.Random(5)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        exponent, least = rng.choice([2, 2, 3, 4]), rng.choice([2, 6])
        off = np.cumsum([0] + [len(w) for w in docs])
        want = sorted((lo + o, p, hi + o) for w, o in zip(docs, off.tolist()) for lo, p, hi in brute_runs(w, exponent, least))
        value = np.array([x + (k << 32) for k, w in enumerate(docs) for x in w], np.int64)
        begins = np.repeat(off[:-1], np.diff(off))
        c = periodic.SquareCatcher(len(value), exponent, least)
        for at in range(0, len(value), step):
            c.append(value[at:at + step], begins[at:at + step])
        lo, hi, per = c.runs()
        assert sorted(zip(lo.tolist(), per.tolist(), hi.tolist())) == want


def test_runs_of_long_streams():
    for value, want in ((np.zeros(600_000, np.int64), [(0, 600_000, 1)]), (np.arange(400_000) % 1000, [(0, 400_000, 1000)]), (np.random.default_rng(0).integers(0, 9000, 300_000), [])):
        c = periodic.SquareCatcher(len(value), 4, 6)
        for at in range(0, len(value), 100_000):
            c.append(value[at:at + 100_000], np.zeros(len(value[at:at + 100_000]), np.int64))
        assert list(zip(*(x.tolist() for x in c.runs()))) == want


@pytest.mark.parametrize("batch", [1 << 20, 1000])
def test_runs_query_by_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(periodic, "BATCH_BYTES", batch)
    monkeypatch.setattr(periodic, "APPEND", 1 << 18 if batch > 1000 else 100)
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w, 4, 6)
        gone = {k for lo, p, hi in runs for k in range(lo + p, hi)}
        best = max(runs, key=lambda x: (Fraction(x[2] - x[0], x[1]), -x[0], -x[1]), default=None)
        want = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
        want = (r.doc_id, len(runs), *want, sha("".join(f"{lo},{hi - lo},{p}\n" for lo, p, hi in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
        assert tuple(got[r.doc_id]) == want


def test_runs_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("runs", F.lit(1))
    more = spark.createDataFrame([(200, "ha " * 50_000), (201, "\x1ca\x1ca a\x0ba\x0ca\ra a a"), (202, "a\xa0a a\xa0a a a")], "doc_id long, text string")
    out = periodic.find_runs(docs.unionByName(more, allowMissingColumns=True))
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        if len(w) < 1000:
            assert r["n_words"] == len(w) and [(x["start"], x["period"], x["start"] + x["length"]) for x in r["runs"]] == brute_runs(w, 4, 6)
    assert {(r["n_words"], r["collapsed"]) for r in rows if r["doc_id"] == 200} == {(50_000, "ha")}
    assert {r["collapsed"] for r in rows if r["text"] is None} == {""}
    assert Counter(r["doc_id"] for r in rows) == Counter([r["doc_id"] for r in docs.collect()] + [200, 201, 202])
    assert periodic.find_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, exponent=1)
