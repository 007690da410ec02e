"""Sources, sinks and streams: fail-closed reads, retries, replays and maintenance."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import broadcast_if_small, cut, fetch_small, scratch
from plumbline.sources import sinks as W
from plumbline.sources import tables as R
from plumbline.streaming import ingest as I


def lines(spark, rows, name="t.csv"):
    path = scratch(spark, "lines") + name
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def test_text_table_keeps_every_spelling(spark):
    d = R.read_text_table(spark, lines(spark, ["a,b", "NA,-999", ",007", '"",x']))
    assert sorted((r["a"], r["b"]) for r in d.collect()) == [("", "007"), ("", "x"), ("NA", "-999")]


def test_shadow_skips_identifiers_and_reports_losses(spark):
    rows = [(str(i), f"{i:03d}", "NA" if i == 7 else str(i / 2)) for i in range(100)]
    d, lost = R.numeric_shadow(spark.createDataFrame(rows, "n string, code string, x string"))
    assert dict(d.dtypes) == {"n": "double", "code": "string", "x": "double"}
    assert [(r["column"], r["value"], r["n"]) for r in lost.collect()] == [("x", "NA", 1)]


def test_typed_csv_is_strict_even_for_unused_columns(spark):
    path = lines(spark, ["a,b", "1,2", "3,oops"])
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    with pytest.raises(Exception):
        R.read_typed_csv(spark, path, schema).select("a").collect()
    assert R.read_typed_csv(spark, path, schema, strict=False).where("_corrupt is not null").count() == 1


def test_stamp_query_deals_rows_by_size(spark, tmp_path, monkeypatch):
    from plumbline.plans import q_sources
    from plumbline.plans.registry import Tables
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    seen, verify = [], W.verify_stamp
    monkeypatch.setattr(q_sources.W, "verify_stamp", lambda d, side: (seen.append(d), verify(d, side))[1])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        assert q_sources.a8(Tables(spark, str(tmp_path))).first()["n_records"] == 20_000
        assert seen[0].rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_stamp_detects_any_change(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    side = scratch(spark, "stamp") + ".json"
    W.stamp(d, side, "src", "job")
    assert W.verify_stamp(d.orderBy(F.desc("k")), side).first()["status"] == "pass"
    for other in (d.limit(1), d.fillna(""), d.withColumn("k", F.col("k") + 1), d.union(d)):
        with pytest.raises(ValueError):
            W.verify_stamp(other, side)


def test_filtered_delete_touches_only_its_partitions(spark):
    path = scratch(spark, "del")
    W.append(spark.range(100).select("id", (F.col("id") % 4).alias("p"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v")), path, ["p"])
    before = {r["f"]: r["n"] for r in spark.read.parquet(path).where("p <> 1").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert W.delete_where(spark, path, (F.col("p") == 1) & (F.col("v") > 50), "p") == spark.range(100).where("id % 4 = 1 and id % 5 > 0 and id > 50").count()
    d = spark.read.parquet(path)
    assert d.where("p = 1 and v > 50").count() == 0 and d.where("p = 1 and v is null").count() == 5
    after = {r["f"]: r["n"] for r in d.where("p <> 1").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert before == after
    assert W.delete_where(spark, path, F.col("p") == 2, "p") == 25 and spark.read.parquet(path).where("p = 2").count() == 0


def test_retention_drops_whole_days(spark):
    path = scratch(spark, "ret")
    d = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) as day, 1 as x")
    W.write_partitioned(d, path, ["day"])
    assert W.retain_days(spark, path, "day", "2024-01-10", 4) == [f"2024-01-0{i}" for i in range(1, 6)]
    assert spark.read.parquet(path).count() == 5


def test_round_trip_names_the_changes(spark):
    d = spark.createDataFrame([(1, "007", None), (2, "x", 1.5)], "k bigint, code string, v double")
    r = {x["format"]: x for x in W.round_trip_check(d, scratch(spark, "rt")).collect()}
    assert r["parquet"]["types_changed"] == "" and r["parquet"]["rows_lost"] == 0
    assert "k" in r["csv"]["types_changed"]


def test_size_checks(spark):
    assert fetch_small(spark.range(10), 9) is None and len(fetch_small(spark.range(10), 10)) == 10
    assert "broadcast" in broadcast_if_small(spark.range(5), 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(50), 10)._jdf.queryExecution().logical().toString().lower()
    assert cut(spark.range(5)).count() == 5


FIELDS = [I.Field("id", "bigint", True), I.Field("amount", "double")]


def test_validation_says_why(spark):
    d = spark.createDataFrame([('{"id": 1, "amount": 2.5}',), ('{"amount": 1}',), ('{"id": "x"}',), ("{broken",), ('{"id": 4}',)], "value string")
    got = [r["_error"] for r in I.validate(d, FIELDS).collect()]
    assert got[0] is None and got[1] == "missing id" and got[2] is not None and got[3] == "malformed" and got[4] is None
    with pytest.raises(ValueError, match="reserved"):
        I.validate(d, [I.Field(I.RESERVED, "string")])


def test_ingest_restart_and_replay_write_once(spark):
    src, good, bad, chk = (scratch(spark, n) for n in ("src", "good", "bad", "chk"))
    rows = lambda a, b: spark.range(a, b).select(F.to_json(F.struct("id", (F.col("id") * 1.5).alias("amount"))).alias("value"))
    rows(0, 50).write.text(src)
    run = lambda: I.run_to_end(I.ingest(I.stream_text(spark, src), FIELDS, good, bad, chk))
    assert run()["input_rows"] == 50
    rows(50, 80).write.mode("append").text(src)
    run()
    run()  # nothing new
    d = spark.read.parquet(good)
    assert d.count() == 80 and d.select("id").distinct().count() == 80
    again = scratch(spark, "again")
    for _ in range(2):  # a retried batch replaces itself
        I._write_batch(spark.range(3), again, 0)
    assert spark.read.parquet(again).count() == 3
    assert I.loss_report(spark, 80, good, bad).first()["status"] == "pass"
    assert I.loss_report(spark, 90, good, bad).first()["status"] == "fail"
    assert I.loss_report(spark, 10, scratch(spark, "none"), scratch(spark, "none2")).first()["status"] == "fail"


def test_keyed_stream_folds_batches(spark):
    src, out, chk = (scratch(spark, n) for n in ("ksrc", "kout", "kchk"))
    spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id long, v string, sent int").write.parquet(src)
    s = lambda: spark.readStream.schema("id long, v string, sent int").parquet(src)
    I.run_to_end(I.keyed_stream(s(), "id", "sent", out, chk, upsert=True))
    spark.createDataFrame([(2, "c", 5), (3, "d", 6), (2, "older", 4)], "id long, v string, sent int").write.mode("append").parquet(src)
    I.run_to_end(I.keyed_stream(s(), "id", "sent", out, chk, upsert=True))
    assert {r["id"]: r["v"] for r in I.read_keyed(spark, out, "id", "sent", upsert=True).collect()} == {1: "a", 2: "c", 3: "d"}
    first = I.keyed_ingest(None, spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id long, v string, sent int"), "id", "sent", upsert=False)
    assert first.first()["v"] == "a"


def _rows_written(spark, out):
    return {r["batch"]: r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("batch").count().collect()}


@pytest.mark.parametrize("upsert", [True, False])
def test_keyed_stream_survives_a_writer_that_dies(spark, monkeypatch, upsert):
    """Deaths before and after a batch counts: nothing is lost, doubled or taken from half a batch; writes follow the batch."""
    src, out, chk = (scratch(spark, n) for n in ("ksrc", "kout", "kchk"))
    kind, want, sent = "id long, v string, sent int", {}, 0
    commit = I._commit

    def dies_before(*a):
        raise OSError("lost before the list of pieces")

    def dies_after(*a):
        commit(*a)
        raise OSError("lost after the list of pieces")

    rng = np.random.default_rng(1)
    for n, size in enumerate([2000, 5, 5, 40, 5, 300, 5]):
        ids = rng.integers(0, 3000, size).tolist() if n else list(range(2000))
        rows = []
        for i in ids:
            sent += 1
            rows.append((i, f"{n}-{sent}", sent))
            if upsert or i not in want:
                want[i] = f"{n}-{sent}"
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append" if n else "errorifexists").parquet(src)
        run = lambda: I.run_to_end(I.keyed_stream(spark.readStream.schema(kind).parquet(src), "id", "sent", out, chk, upsert, buckets=16))
        for death in {1: [dies_before], 2: [dies_after], 3: [dies_before, dies_before, dies_after], 5: [dies_before, dies_after]}.get(n, []):
            monkeypatch.setattr(I, "_commit", death)
            with pytest.raises(Exception, match="lost"):
                run()
            if death is dies_after and len(rows) == 5:
                assert {r["id"]: r["v"] for r in I.read_keyed(spark, out, "id", "sent", upsert).collect()} == want  # it counts already
        monkeypatch.setattr(I, "_commit", commit)
        run()
        assert {r["id"]: r["v"] for r in I.read_keyed(spark, out, "id", "sent", upsert).collect()} == want
        if size == 5:
            assert _rows_written(spark, out)[n] <= 5
    assert len(I._committed(spark, out)) == 2
    pieces = {r["batch"] for b in I._committed(spark, out) for r in I._pieces(spark, out, b)}
    assert set(_rows_written(spark, out)) == pieces


def test_keyed_stream_writes_buckets_anew(spark):
    src, out, chk = (scratch(spark, n) for n in ("ksrc", "kout", "kchk"))
    for n in range(12):
        spark.createDataFrame([(i, f"{n}", n) for i in range(n, n + 6)] + [(None, f"n{n}", n)], "id long, v string, sent int").write.mode("append").parquet(src)
        I.run_to_end(I.keyed_stream(spark.readStream.schema("id long, v string, sent int").parquet(src), "id", "sent", out, chk, True, buckets=2))
    last = I._pieces(spark, out, I._committed(spark, out)[-1])
    assert max(sum(r["bucket"] == b for r in last) for b in (0, 1)) < I.MOST_PIECES
    assert {r["id"]: r["v"] for r in I.read_keyed(spark, out, "id", "sent", True).collect()} == {i: str(min(i, 11)) for i in range(17)} | {None: "n11"}


def test_delete_from_partitions_with_odd_names(spark):
    path = scratch(spark, "odd")
    names = ["a:b", "a/b", "a b", "100%", "01", "1", "x=y", None]
    d = spark.createDataFrame([(n, i) for n in names for i in range(4)], "k string, v int")
    W.append(d, path, ["k"])
    assert W.delete_where(spark, path, F.col("v") < 2, "k") == 2 * len(names)
    assert spark.read.parquet(path).count() == 2 * len(names)
    assert W.delete_where(spark, path, F.col("k").isin("a:b", "a/b", "a b", "100%") | F.col("k").isNull(), "k") == 10
    left = spark.read.parquet(path)
    assert {r["k"] for r in left.collect()} == {"01", "1", "x=y"} and left.count() == 6


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("dies_at", [0, 1, 2, 3, 5, 8, 11])
def test_delete_by_a_writer_that_dies(spark, monkeypatch, dies_at, keyed):
    """Whatever move the writer dies at, the next call leaves the right rows, each once."""
    path = scratch(spark, "dies")
    d = spark.createDataFrame([(k, i) for k in "abc" for i in range(10)], "k string, v int").repartition(2, "v")
    W.append(d, path, ["k"] if keyed else [])
    move, count = W._move, [0]

    def dies(*a):
        if count[0] == dies_at:
            raise OSError("lost")
        count[0] += 1
        move(*a)

    monkeypatch.setattr(W, "_move", dies)
    try:
        W.delete_where(spark, path, (F.col("v") < 3) | (F.col("k") == "c"), "k")
        died = False
    except OSError:
        died = True
    monkeypatch.setattr(W, "_move", move)
    seen = [tuple(r) for r in spark.read.schema("k string, v int").parquet(path).select("k", "v").collect()]
    assert len(seen) == len(set(seen))
    assert W.finish_deletes(spark, path) == died
    want = sorted((k, v) for k in "ab" for v in range(3, 10))
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == want
    assert W.delete_where(spark, path, F.col("v") == 3, "k") == 2


def test_delete_before_the_plan_is_complete_changes_nothing(spark):
    path = scratch(spark, "dies")
    W.append(spark.range(10).select("id", (F.col("id") % 2).alias("k")), path, ["k"])
    spark.range(3).withColumn("__number", F.lit(0)).write.partitionBy("__number").parquet(f"{path}/{W.REWRITTEN}x/new")
    assert W.finish_deletes(spark, path) == 0 and spark.read.parquet(path).count() == 10
    assert W.delete_where(spark, path, F.col("id") == 4, "k") == 1 and spark.read.parquet(path).count() == 9


def test_compaction_keeps_partitions(spark):
    many, few = scratch(spark, "many"), scratch(spark, "few")
    W.append(spark.range(200).select("id", F.format_string("%02d", F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("m")).repartition(10), many, ["k", "m"])
    s = W.compact(spark, many, few)
    d = spark.read.parquet(few)
    files = {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    assert s["files_before"] > len(files) == 6 and all("/k=0" in f and "/m=" in f for f in files)
    assert d.count() == 200 and d.where("m = 1").agg(F.sum("id")).first()[0] == sum(range(1, 200, 2))


def test_more_batches_than_spark_remembers(spark):
    src, good, bad, chk = (scratch(spark, n) for n in ("msrc", "mgood", "mbad", "mchk"))
    spark.range(40).select(F.to_json(F.struct("id")).alias("value")).repartition(8).write.text(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        done = I.run_to_end(I.ingest(I.stream_text(spark, src, files_per_batch=1), FIELDS, good, bad, chk))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert done == {"batches": 8, "input_rows": 40}
    assert I.loss_report(spark, done["input_rows"], good, bad).first()["status"] == "pass"


def test_stale_outputs_tells_folders_apart(spark):
    base = scratch(spark, "stale")
    for name in ("old/x.txt", "mid/x.txt", "new/x.txt"):
        spark.range(1).select(F.lit("a")).coalesce(1).write.text(f"{base}/{name}")
    files = {r["path"].split("/")[-3]: "/".join(r["path"].split("/")[-3:]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(base).select("path").collect()}
    lineage = spark.createDataFrame([(files["mid"], files["old"]), (files["old"], files["new"]), (files["new"], "gone/x.txt")], "output string, input string")
    got = {r["output"]: (r["status"], r["n_inputs"]) for r in W.stale_outputs(spark, base, lineage).collect()}
    assert got == {files["mid"]: ("fresh", 1), files["old"]: ("stale", 1), files["new"]: ("abstain", 1)}


def test_manifest_hashes_files(spark, tmp_path):
    import hashlib
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"one")
    (tmp_path / "y.bin").write_bytes(b"two")
    got = {r["path"]: (r["size"], r["sha256"]) for r in W.digest_manifest(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"a/x.bin": (3, hashlib.sha256(b"one").hexdigest()), "y.bin": (3, hashlib.sha256(b"two").hexdigest())}


def test_manifest_reads_large_files_in_pieces(spark, tmp_path, monkeypatch):
    """No task reads a large file whole: digests are handed from piece to piece, also where a file ends with a piece."""
    import hashlib
    files = {"a.bin": b"x" * 1000, "b.bin": bytes(range(256)) * 12, "c.bin": b"y" * 3000, "d/e.bin": b"z" * 2001, "f.bin": b"small"}
    (tmp_path / "d").mkdir()
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    monkeypatch.setattr(W, "PIECE", 1000)
    rounds, step = [], W._hash_piece
    monkeypatch.setattr(W, "_hash_piece", lambda start, n: rounds.append((start, n)) or step(start, n))
    out = W.digest_manifest(spark, str(tmp_path), "*.bin")
    want = {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert {r["path"]: (r["size"], r["sha256"]) for r in out.collect()} == want
    assert rounds == [(0, 1000), (1000, 1000), (2000, 1000), (3000, 1000)]
    assert "LessThanOrEqual(length,1000)" in out._jdf.queryExecution().executedPlan().toString()  # larger files stay closed in the scan
    lib = W._openssl()
    if lib is not None:
        state = None
        for k in range(4):
            state = W._go_on(lib, state, W._read(str(tmp_path / "b.bin"), 1000 * k, 1000))
        assert W._finish(lib, state) == hashlib.sha256(files["b.bin"]).hexdigest()
    monkeypatch.setattr(W, "_openssl", lambda: None)
    assert {r["path"]: (r["size"], r["sha256"]) for r in W.digest_manifest(spark, str(tmp_path), "*.bin").collect()} == want
