"""Training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, fingerprint, fm_index, language, mixing, near_dups, neighbours, quality, queries, revisits, suffix_dedup, url_filter
from plumbline.llm.suffix import common_prefixes, suffix_array

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `id` long, `key` string, `kept` int, score string, `__text` string, `a.b` int"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like the operators' own."""
    base = "one two three four five six seven eight nine ten eleven twelve. "
    long = "".join(f"w{i * 7919 % 5003} " for i in range(30_000))
    texts = [(1, None), (2, ""), (3, base * 12), (4, base * 12), (4, base * 12), (5, long), (6, long + "tail"), (None, "no id, some words"), (None, None),
             (7, "!!! ???"), (8, "!!! ???"), (9, "é" * 500), (10, "   "), (11, "word"), (12, "Word."), (13, "\n\n\n"), (14, "日本語のテキスト " * 60)]
    rows = [(i, t, None if i in (3, None) else ("en" if (i or 0) % 2 else "fr"), None if i in (5, 11, None) else f"s{(i or 0) % 3}", None, k, "k", 1, "s", "t", 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], connect(FOLDER)) == []


# ---- 1 ----

def test_fingerprint_query_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_BYTES", 20_000)
    got = {r.doc_id: r for r in queries.QUERIES["op1_fingerprint"](spark, FOLDER).collect()}
    rows = sorted(((r[0], r[1] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    prints, wrong = {}, 0
    for k, (i, x) in enumerate(rows):
        y, h = rows[(k + 1) % len(rows)][1], len(x) // 2
        edited = x[:len(x) - h] + y[:h]
        assert got[i].n_chars == len(x) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        prints.setdefault(x, got[i].fingerprint)
        assert prints[x] == got[i].fingerprint
        wrong += got[i].near_edited <= got[i].near_next and len(x) > 100
    assert len(set(prints.values())) == len(prints)
    assert wrong <= 0.02 * len(rows)


def test_likeness_of_texts_with_words_put_in_and_left_out(spark):
    rng = np.random.default_rng(4)

    def pieces(text):
        out = Counter()
        for w in (p.split() for p in text.split("\n")):
            out.update({tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else ())
        return out
    rows = []
    for k in range(20):
        pars = [[f"w{x}" for x in rng.integers(0, 900, int(rng.integers(30, 400)))] for _ in range(1 + k % 3)]
        text = "\n".join(map(" ".join, pars))
        less = "\n".join(" ".join(w[:c] + w[c + 1:]) for w in pars for c in [int(rng.integers(0, len(w)))])
        rows += [(text, "new " + text), (text, less)]
    rows.append(("日本語のテキストを比べるための長い文章で、空白がない。" * 2 + "もう一つの文も続く", "あ" + "日本語のテキストを比べるための長い文章で、空白がない。" * 2 + "もう一つの文も続く"))
    d = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        d = fingerprint.with_fingerprint(d, F.col(c), f"f{c}")
    off = []
    for r in d.select("a", "b", F.col("fa.pieces").alias("n"), fingerprint.likeness(F.col("fa"), F.col("fb")).alias("near")).collect()[:-1]:
        x, y = pieces(r["a"]), pieces(r["b"])
        assert r["n"] == sum(x.values())
        off.append(r["near"] - 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())))
        assert r["near"] > 0.85
    assert abs(np.mean(off)) < 0.02 and d.select(fingerprint.likeness(F.col("fa"), F.col("fb"))).collect()[-1][0] > 0.8


def test_likeness_of_millions_of_pieces(spark):
    d = fingerprint.with_fingerprint(spark.createDataFrame([("a b c d e",), ("v w x y z",)], "t string"), F.col("t"), "f").select("f")
    f, g = (r["f"] for r in d.collect())

    def times(f, n):  # the fingerprint of so many copies of the paragraph, as `add` has it
        return (f["paragraphs"] * n, f["pieces"] * n, *[[x * n % 2**60 for x in f[c]] for c in ("lanes", "signs")])
    kind = d.schema["f"].dataType.simpleString()
    pairs = spark.createDataFrame([(n, times(f, n), times(g, n)) for n in (1, 2**21 + 1)], f"n long, a {kind}, b {kind}")
    once, often = (r[0] for r in pairs.orderBy("n").select(fingerprint.likeness(F.col("a"), F.col("b"))).collect())
    assert once < 0.5 and abs(once - often) < 1e-9


def test_fingerprint_is_homomorphic_and_ignores_order(spark):
    d = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c"), ("x\n\nx", "x\nx\n", "x\n", "x"), (None, "", "q", "q")], "a string, b string, p string, q string")
    for c in "abpq":
        d = fingerprint.with_fingerprint(d, F.col(c), f"f{c}")
    r = d.select(fingerprint.equal(F.col("fa"), F.col("fb")).alias("same"), fingerprint.equal(fingerprint.add(F.col("fp"), F.col("fq")), F.col("fa")).alias("sum"),
                 fingerprint.equal(fingerprint.subtract(F.col("fa"), F.col("fq")), F.col("fp")).alias("rest"), fingerprint.likeness(F.col("fa"), F.col("fb")).alias("near")).collect()
    assert [x["same"] for x in r] == [True] * 3 and [x["sum"] for x in r] == [True, True, False] and [x["rest"] for x in r] == [True, True, False] and all(x["near"] == 1 for x in r)


def test_next_row_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_BYTES", 40)
    ids = [None, None, -2**63, 2**62, 5, 5, 5, 7, 9, 10**6]
    d = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, v long")
    out = neighbours.with_next(d, "id", F.lit(30), F.col("v"), "next").collect()
    assert len(out) == len(ids)
    step = {r["v"]: r["next"]["v"] for r in out}
    at, seen = max(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0)), []
    for _ in ids:
        seen.append(ids[at])
        at = step[at]
    assert seen == sorted((i for i in ids if i is not None), reverse=True) + [None, None] and at == 3
    assert neighbours.with_next(d.where("false"), "id", F.lit(1), F.col("v")).count() == 0


def test_fingerprints_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = fingerprint.fingerprints(docs, "text", "kept")
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
    assert fingerprint.fingerprints(docs.where("false")).count() == 0


# ---- 2 ----

def brute_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        out.append((bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


def brute_passages(texts, n_words):
    """Words in runs of `n_words` words that occur twice, and maximal runs of such words."""
    lists = [words_of(t) for t in texts]
    seen = Counter(tuple(w[k:k + n_words]) for w in lists for k in range(len(w) - n_words + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - n_words + 1):
            if seen[tuple(w[k:k + n_words])] > 1:
                gone[k:k + n_words] = [True] * n_words
        out.append((sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 3_000])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 2_000 if shard < 1 << 20 else 1 << 20)
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op2_suffix_dedup"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    texts = [r[1] for r in rows]
    want = {r[0]: (*w[1:], hashlib.sha256(w[0]).hexdigest(), *x) for r, w, x in zip(rows, brute_repeats(texts, 400), brute_passages(texts, 51))}
    assert got == want


def test_suffix_dedup_of_odd_rows(spark):
    docs = odd_documents(spark).where("coalesce(doc_id, 0) NOT IN (5, 6)")
    rows = docs.collect()
    out = suffix_dedup.remove_repeats(docs, length=60)
    want = sorted((r["id"], *w) for r, w in zip(rows, brute_repeats([r["text"] for r in rows], 60)))
    assert sorted((r["id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out.collect()) == want
    assert set(docs.columns) <= set(out.columns) and suffix_dedup.remove_repeats(docs.where("false")).count() == 0
    text = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "aé" * 40 + "x"), (2, "é" + "aé" * 40)], "doc_id long, text string"), length=61, as_text=True).collect()
    assert all(r["kept"] == r["kept"].encode().decode() for r in text)


def test_suffix_dedup_of_texts_above_a_batch(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 700)
    docs = odd_documents(spark).where("coalesce(doc_id, 0) NOT IN (5, 6)").select("doc_id", "text")
    more = [(50 + k, " ".join(f"{chr(97 + (j * (k + 3)) % 26)}{j % 97}" for j in range(900))) for k in range(3)] + [(60, "ab" * 2000), (61, "x" + "ab" * 1200 + " end")]
    d = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = d.collect()
    got = suffix_dedup.remove_repeats(d, length=60, n_words=6).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=str) == sorted(zip([r[0] for r in rows], brute_worded_repeats([r[1] for r in rows], 60, 6)), key=str)
    assert sorted((r["n_words_removed"], r["n_word_spans"]) for r in got) == sorted(brute_passages([r[1] for r in rows], 6))


def test_suffix_dedup_of_long_texts(spark):
    out = {(r["id"]): r for r in suffix_dedup.remove_repeats(odd_documents(spark).where("doc_id IN (5, 6)")).collect()}
    assert [(r["n_bytes"] - r["n_removed"]) for _, r in sorted(out.items())] == [0, 4]


def brute_worded_repeats(texts, length, n_words):
    """Bytes gone by `length` bytes or by `n_words` words that occur twice."""
    texts = [(t or "").encode() for t in texts]
    spots = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b)] for b in texts]
    runs = [[tuple(x[2] for x in s[k:k + n_words]) for k in range(len(s) - n_words + 1)] for s in spots]
    seen, strings = Counter(r for x in runs for r in x), Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b, s, x in zip(texts, spots, runs):
        gone = [False] * len(b)
        for lo, hi in [(s[k][0], s[k + n_words - 1][1]) for k, r in enumerate(x) if seen[r] > 1] + [(p, p + length) for p in range(len(b) - length + 1) if strings[b[p:p + length]] > 1]:
            gone[lo:hi] = [True] * (hi - lo)
        out.append(bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 3_000])
def test_suffix_dedup_by_words_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for d, length, n in ((docs, 400, 51), (odd_documents(spark).where("coalesce(doc_id, 0) NOT IN (5, 6)"), 60, 6)):
        rows = d.select("doc_id", "text").collect()
        got = suffix_dedup.remove_repeats(d.select("doc_id", "text"), length=length, n_words=n).collect()
        assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=str) == sorted(zip([r[0] for r in rows], brute_worded_repeats([r[1] for r in rows], length, n)), key=str)


def test_pipeline_cuts_short_worded_passages(spark):
    passage = " ".join(f"{a}{b}" for a in "abcd" for b in "efghijklmnopq")  # 52 words of two letters, 155 bytes
    rows = [(1, "one start of it, " + passage + ". the end here"), (2, "another begin: " + passage.upper().replace(" ", ", ") + " and its rest"), (3, "mine only " + " ".join(passage.split()[:50]) + " stays whole")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, d, FOLDER).collect()}
    assert got == {1: "one start of it, . the end here", 2: "another begin:  and its rest", 3: rows[2][1]}


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        sa, rank = suffix_array(data.astype(np.int64) + 1, sizes, 9)
        begin = np.cumsum(sizes) - sizes
        suffixes = [(t[j:], i, int(begin[i]) + j) for i, t in enumerate(texts) for j in range(len(t))]
        want = sorted(suffixes, key=lambda s: [(1, c) for c in s[0]] + [(0, s[1])])
        assert sa.tolist() == [s[2] for s in want] and all(rank[sa] == np.arange(len(sa)))
        lcp = common_prefixes(data, sizes, sa, 10, 4)
        for k in range(1, len(want)):
            a, b = want[k - 1][0], want[k][0]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert lcp[k] == min(n, 10)


# ---- 3 ----

def brute_classes(rows, similarity=0.8):
    grams = []
    for _, t in rows:
        w = words_of(t)
        grams.append(Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j:j + 5]) for j in range(len(w) - 4)]))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = grams[a], grams[b]
            both = sum((x & y).values())
            if (both and both >= similarity * (sum(x.values()) + sum(y.values()) - both)) or (not x and not y and (rows[a][1] or "") == (rows[b][1] or "")):
                p, r = find(a), find(b)
                top[max(p, r)] = min(p, r)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    least = {c: min((i for i in m if i is not None), default=None) for c, m in members.items()}
    return [(least[find(k)], len(members[find(k)])) for k in range(len(rows))]


@pytest.mark.parametrize("tile", [256, 2])
def test_near_duplicates_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dups, "TILE", tile)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_class) for r in queries.QUERIES["op3_minhash_near_dups"](spark, FOLDER).collect()}
    assert got == {r[0]: w for r, w in zip(rows, brute_classes(rows))}


def test_near_duplicates_around_the_threshold(spark, monkeypatch):
    """A family whose members are linked through some only: buckets hold several components."""
    monkeypatch.setattr(near_dups, "TILE", 4)
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for k in range(40):
        w = list(base)
        for i in rng.choice(200, int(rng.integers(2, 9)), replace=False):
            w[i] = f"n{k}x{i}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["class_id"], r["n_class"]) for r in near_dups.near_classes(d).collect()}
    assert got == {r[0]: w for r, w in zip(rows, brute_classes(rows))}


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sorted(((r["id"], r["class_id"], r["n_class"]) for r in near_dups.near_classes(docs).collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute_classes([tuple(r) for r in rows]))), key=str)
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({(w[0]) for w in brute_classes([tuple(r) for r in rows])} | set(), key=str)
    assert near_dups.near_classes(docs.where("false")).count() == 0 and near_dups.drop_near_duplicates(docs.where("false")).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a, b = Counter(rng.integers(0, 60, 400).tolist()), Counter(rng.integers(0, 80, 400).tolist())
    s = np.array([x for c in (a, b) for x, n in c.items() for _ in range(n)], np.uint64)
    row = np.repeat([0, 1], [400, 400])
    sig = near_dups.dart_signatures(*near_dups.elements(near_dups.mix(s), row), 3, 2048)
    want = sum((a & b).values()) / sum((a | b).values())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05 and not sig[2].any() and (sig[:2] != 0).all()


# ---- 4 ----

def test_mix_meets_targets_and_reruns_agree(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = mixing.mix_sources(d).cache()
    assert out.exceptAll(mixing.mix_sources(d.repartition(3))).count() == 0
    assert out.where("taken > 2 * size OR taken < 0").count() == 0
    for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m"), F.first("source_size").alias("s")).collect():
        assert abs(r["n"] - r["t"]) <= r["m"] / 2 + 1e-6 and r["t"] <= 2 * r["s"] + 1e-6


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = mixing.mix_sources(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    assert out.where("text IS NULL AND (size <> 0 OR taken <> 0)").count() == 0
    total = out.agg(F.sum("size")).first()[0]
    per = {r["source"]: r for r in out.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s")).collect()}
    assert abs(sum(r["t"] for r in per.values()) - 1.5 * total) < 1e-6 and None in per
    assert mixing.mix_sources(docs.where("false")).count() == 0
    same = spark.createDataFrame([(None, "a b c d", None)] * 50 + [(k, "a b c d", "x") for k in range(30)], "doc_id long, text string, source string")
    got = {r["source"]: (r["n"], r["t"]) for r in mixing.mix_sources(same).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()}
    assert all(abs(n - t) <= 4 for n, t in got.values())


# ---- 5 ----

def test_language_held_out_accuracy(spark):
    g = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = g.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right >= 0.97 * n and g.where("score < 0 OR score > 1").count() == 0


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = language.identify_language(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count() and dict(out.dtypes)["score"] == "double"
    bare = F.col("text").isNull() | ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    assert out.where(bare & ((F.col("lang_pred") != "und") | (F.col("score") != 0))).count() == 0 and out.where(~bare & (F.col("lang_pred") == "und")).count() == 0
    none = language.identify_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify_language(docs.where("false")).count() == 0


def test_windows_cover_every_byte():
    off = np.array([0, 0, 3, 260, 1500])
    start, text, size = language._windows(np.zeros(1500, np.uint8), off)
    for t in range(4):
        mine = [(s, n) for s, x, n in zip(start, text, size) if x == t]
        covered = set()
        for s, n in mine:
            covered |= set(range(s, s + n))
        assert covered == set(range(off[t], off[t + 1])) and len(mine) >= 1


# ---- 6 ----

def test_chat_round_trip_of_odd_rows(spark):
    nasty = ["[INST]", "</s>", "\\", "\\\\[ANS]", "\\a", "[ROLE]x[TEXT]", "[INST", "]", "\\\\\\", "a\n\nb", "", None, "[NONE]", "\\[SYS]\\", "é[/INST]é"]
    rows = [(c, t, r, nasty[(c * 5 + t) % len(nasty)]) for c in range(20) for t, r in enumerate(["system", "user", "assistant", "tool", "critic", "[INST]", None, "", "[NONE]", "assistant"])]
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (None, None, "assistant", None), (99, 0, "assistant", "long " * 40_000)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    out = chat.format_chats(d).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([(r[1], r[2], r[3] or "") for r in rows if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
        assert [(t["role"], t["text"]) for t in got[c]["read"]] == [r[1:] for r in mine]
        assert got[c]["loss"] == "".join(r[2] for r in mine if r[1] == "assistant") and got[c]["n_turns"] == len(mine)
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert not got[0]["valid"] and chat.format_chats(d.where("false")).count() == 0


# ---- 7 ----

def test_revisits_with_ties_hot_urls_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(revisits, "BINS", 7)
    h = lambda tag=None, mod=None, **k: {"ETag": tag, "Last-Modified": mod, **k}
    rows = [("r%d" % i, "response", "http://Hot.example/", i * 10, 200 if i % 4 else 500, h(f'"{i}"', "m", **{"Content-Length": "9"})) for i in range(30)]
    rows += [("tie", "response", "http://hot.example:80/#x", 50, 200, h('"tie"', "m"))]
    rows += [("v%d" % i, "revisit", "HTTP://hot.example", i * 10 + 5 * (i % 2), 304, h(f'W/"{i}"', "m", **{"Content-Length": "0", "Vary": "v"})) for i in range(30)]
    rows += [("n1", "revisit", None, 5, 304, None), ("n2", "revisit", "http://hot.example/", None, 304, None), ("n3", "revisit", "no scheme", 5, 304, h()), ("x", None, "http://hot.example/", 1, 200, None),
             ("n4", "response", "http://a.example/", None, 200, None), ("n5", "revisit", "http://a.example/", 7, 304, h("q")), ("v3", "revisit", "HTTP://hot.example", 35, 304, h('W/"3"', "m"))]
    d = spark.createDataFrame([(*r, 1) for r in rows], "record_id string, kind string, url string, at long, status int, headers map<string,string>, `from` int")
    got = list((r["record_id"], r["source_id"], r["check"], r["resolved"], None if r["headers"] is None else [tuple(x) for x in r["headers"]]) for r in revisits.resolve_revisits(d).collect())
    full = [(r[3], r[0], r[5]) for r in rows if r[1] == "response" and r[4] == 200 and r[3] is not None and "ot.example" in r[2]]
    want = []
    for i, kind, url, at, _, own in rows:
        if kind != "revisit":
            continue
        if url is None or "://" not in url:
            want.append((i, None, "no-url", False, None))
            continue
        src = max((s for s in full if at is not None and s[0] < at), default=None) if "ot.example" in url else None
        if src is None:
            want.append((i, None, "no-response", False, None))
            continue
        same = own["ETag"].replace("W/", "") == src[2]["ETag"]
        merged = {k.lower(): v for k, v in src[2].items()} | {k.lower(): v for k, v in own.items() if k in ("ETag", "Vary")}
        want.append((i, src[1], "etag" if same else "mismatch", same, sorted(merged.items()) if same else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert revisits.resolve_revisits(d.where("false")).count() == 0


# ---- 8 ----

def test_quality_keeps_good_text(spark):
    d = queries.QUERIES["op8_quality_resample"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {r["quality"]: r["k"] for r in d.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.95 and share[0] < 0.3


def test_quality_of_odd_rows_and_counts_by_brute_force(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    out = quality.resample(docs, labels, F.col("quality") == 1, share=0.5)
    assert set(docs.columns) <= set(out.columns) | {"kept"} and out.count() == docs.count()
    assert sorted(r["rank_key"] for r in out.collect() if r["kept"])[0] > max([r["rank_key"] for r in out.collect() if not r["kept"]])
    assert quality.resample(docs.where("false"), labels, F.col("quality") == 1).count() == 0
    two = spark.createDataFrame([(1, "a b a b"), (2, "c d")], "doc_id long, text string")
    ratio = quality.models(two, F.col("text"), F.col("doc_id") == 1)
    assert ratio.shape == (quality.BUCKETS,) and ratio.max() > 0 > ratio.min()


# ---- 9 ----

def test_fm_index_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(80):
        runs = [rng.integers(1, 4, rng.integers(1, 60)).tolist() for _ in range(rng.integers(1, 6))]
        index = fm_index.FMIndex(np.array([x for r in runs for x in r]), np.array([len(r) for r in runs]), 2)
        phrases = [rng.integers(1, 4, rng.integers(1, 6)).tolist() for _ in range(20)]
        grid = np.zeros((20, 5), np.int32)
        for k, p in enumerate(phrases):
            grid[k, 5 - len(p):] = p
        lo, hi = index.search(grid, np.array([len(p) for p in phrases]))
        for k, p in enumerate(phrases):
            want, at = [], 0
            for r in runs:
                want += [at + j for j in range(len(r) - len(p) + 1) if r[j:j + len(p)] == p]
                at += len(r)
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


@pytest.mark.parametrize("block,shard", [(200_000, 8 << 20), (1, 500)])
def test_contamination_of_odd_rows_by_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(fm_index, "PHRASES_PER_BLOCK", block)
    monkeypatch.setattr(fm_index, "SHARD_BYTES", shard)
    docs = odd_documents(spark)
    items = [(1, "Three FOUR five"), (2, "six seven eight nine ten eleven twelve one two three four!"), (2, "word"), (None, "some words"), (3, None), (4, " ?"), (5, "w1 w2 w3"), (10, "twelve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = fm_index.find_contamination(docs, bench, remove=True)
    assert set(docs.columns) <= set(out.columns)
    got = {r["id"]: r for r in out.collect()}
    phrases = [(i, tuple(w[k:k + 10])) for i, t in items for w in [words_of(t)] for k in range(max(1, len(w) - 9)) if w]
    for r in docs.collect():
        w = words_of(r["text"])
        hit, found = [False] * len(w), set()
        for i, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit[k:k + len(p)] = [True] * len(p)
                    found |= {str(i)} if i is not None else set()
        g = got[r["id"]]
        assert (g["n_words"], g["n_hit"], g["items"]) == (len(w), sum(hit), sorted(found))
        if r["text"] is None:
            assert g["clean"] is None
        else:
            raw = r["text"].encode()
            for s in reversed(g["spans"]):
                raw = raw[:s["start"]] + raw[s["stop"]:]
            assert g["clean"] == raw.decode() and len(words_of(g["clean"])) <= len(w) - sum(hit) + len(g["spans"])
    assert fm_index.find_contamination(docs.where("false"), bench).count() == 0
    assert fm_index.find_contamination(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


# ---- 10 ----

@pytest.mark.parametrize("size", [100_000, 1])
def test_url_rules_by_brute_force(spark, size):
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "http://x.example.org/es/1", "http://example.org/es", "http://example.org/en/12?x", "http://example.org/en/2",
            "http://borg/", "http://a.com/fr/", "http://a.com/de/#f", "http://a.com/de", "x://y://z.com/fr/a", "http://a..com/fr/q", "http://com/" + "fr/" * 5000, "http://a.com\n/fr/"]
    d = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] * 2, "k int, url string, host string, rule string")
    rules = queries.URL_RULES + [("org", "/", "block"), ("org", "/", "allow"), ("net", "", "block")]
    got = url_filter.judge_urls(d, rules, block_size=size)
    assert got.count() == 2 * len(urls)
    for r in got.dropDuplicates(["k"]).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["k"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h.count("."), len(p), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[3], "allow" if not best or not best[2] else "block"), urls[r["k"]]
    listed = url_filter.judge_urls(d, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(map(str, listed.collect())) == sorted(map(str, got.collect()))
    assert url_filter.judge_urls(d.where("false"), rules).count() == 0 and url_filter.judge_urls(d, []).where("rule IS NOT NULL").count() == 0


# ---- pipeline ----

def test_pipeline_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns if k < 4 else set(docs.columns) <= set(out.columns)
        out.collect()


def test_pipeline_keeps_one_of_each_class_and_cuts_passages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(out) == {w[0] for w in brute_classes(rows)}
    kept = [(i, t) for i, t in rows if i in out]
    cut = brute_worded_repeats([t for _, t in kept], 400, corpus_pipeline.PASSAGE_WORDS)
    phrases = {tuple(w[k:k + 10]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for w in [words_of(r["text"])] if w for k in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in phrases}
    for (i, _), c in zip(kept, cut):
        w = words_of(c.decode(errors="ignore"))
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    hit[k:k + n] = [True] * n
        assert words_of(out[i]["text"]) == [x for x, h in zip(w, hit) if not h]
