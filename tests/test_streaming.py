import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.config import ScanConfig, default_config
from veilframe.functions.crypto import Keyring
from veilframe.functions.tokens import TOKEN_PATTERN
from veilframe.operators import detect, redact, terms
from veilframe.plans import queries as plans
from veilframe.sources import readers, sinks
from veilframe.sources.workdir import shared_dir
from veilframe.streaming import chunks, counters

CFG = default_config()
CHUNKS = "stream_id string, seq bigint, chunk string, is_last boolean"
KEYS = Keyring(mac_key=b"m" * 32, enc_key=b"e" * 32)


def batches_of(spark, schema, *batches):
    """A stream that delivers each list of rows as one micro-batch."""
    path = shared_dir(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, mode="append"):
    out = shared_dir(spark, "out")
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", out + "-cp").outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(spark, writer):
    writer.option("checkpointLocation", shared_dir(spark, "cp")).trigger(availableNow=True).start().awaitTermination()


def test_value_split_over_micro_batches(spark, keys):
    stream = batches_of(
        spark, CHUNKS,
        [("a", 0, "My SSN is 123-", False), ("b", 0, "x a@", False)],
        [("a", 1, "45-67", False), ("b", 1, "b.co", False)],
        [("a", 3, " and more text", False), ("a", 2, "89 ok", False), ("b", 2, "m", True)],
        [("a", 4, " TOP SEC", False)],
        [("a", 5, "RET", True)],
    )
    rows = run(spark, chunks.redact_stream(stream, CFG, keys)).orderBy("stream_id", "at").collect()
    text = {s: "".join(r["redacted"] for r in rows if r["stream_id"] == s) for s in "ab"}
    masked = {s: re.sub(TOKEN_PATTERN, "<>", t) for s, t in text.items()}
    assert masked == {"a": "My SSN is <> ok and more text <>", "b": "x <>"}
    assert sum(r["stream_id"] == "a" for r in rows) > 2


def test_idle_streams_are_released(spark):
    stream = batches_of(spark, CHUNKS, [("a", 0, "tail without end", False)])
    units = chunks.hold_back(stream, chunks.value_cut(""), idle_ms=1)
    out = shared_dir(spark, "idle")
    query = (
        units.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp")
        .trigger(processingTime="200 milliseconds").start()
    )
    try:
        for _ in range(100):
            query.awaitTermination(0.3)
            rows = spark.read.schema(units.schema).parquet(out).orderBy("at").collect()
            if "".join(r["text"] for r in rows) == "tail without end":
                break
        else:
            pytest.fail("held text was never released")
    finally:
        query.stop()


def test_stream_restoration_against_the_live_vault(spark, keys):
    texts = spark.createDataFrame([("a", "mail a@b.com, ssn 123-45-6789")], "scope string, text string")
    done = redact.redact(texts, "text", "scope", CFG, keys)
    vault = redact.build_vault(done, "scope", keys)
    reply = done.first()["redacted"]
    rows = [("a", i, reply[i * 9 : i * 9 + 9], (i + 1) * 9 >= len(reply)) for i in range(-(-len(reply) // 9))]
    stream = batches_of(spark, CHUNKS, rows[:3], rows[3:7], rows[7:])
    got = []
    run_batches(
        spark, chunks.rehydrate_stream(stream, lambda: vault, keys, lambda b, e: got.extend(b.collect()))
    )
    text = "".join(r["restored"] for r in sorted(got, key=lambda r: r["at"]))
    assert text == "mail a@b.com, ssn 123-45-6789"


def test_restoration_steps_the_state_once_a_batch(spark, keys):
    vault = spark.range(0).selectExpr("'a' as scope_id", "'t' as token", "'p' as pii_type", "cast('c' as binary) as ciphertext")
    stream = batches_of(spark, CHUNKS, [("a", 0, "some text, ", False)], [("a", 1, "and more", True)])
    plans_, got = [], []

    def write(batch, epoch):
        plans_.append(batch._jdf.queryExecution().analyzed().toString())
        got.extend(batch.collect())

    run_batches(spark, chunks.rehydrate_stream(stream, lambda: vault, keys, write))
    assert "".join(r["restored"] for r in sorted(got, key=lambda r: r["at"])) == "some text, and more"
    # restoring reads its input twice: stored files, not the rows that come out of the state
    assert plans_ and all(p.count("parquet") >= 2 for p in plans_)


def test_rows_of_a_stream_as_a_frame():
    frame = chunks._frame([("a", None, "x", 3), ("a", 2**60 + 1, None, None)], ("s", "at", "text", "seq"), ("at", "seq"))
    assert frame["at"].isna().tolist() == [True, False] and frame["at"][1] == 2**60 + 1
    assert frame["seq"][0] == 3 and frame["seq"].isna().tolist() == [False, True]
    assert frame["text"].tolist() == ["x", None] and str(frame["at"].dtype) == "Int64"


def test_overlap_windows(spark):
    stream = batches_of(
        spark, CHUNKS, [("a", 0, "abcdef", False)], [("a", 1, "gh", False), ("a", 2, "ij", False)], [("a", 3, "", True)]
    )
    rows = run(spark, chunks.overlap_windows(stream, chars=4)).collect()
    got = sorted((r["seq"] if r["seq"] is not None else 99, r["window"], r["overlap"]) for r in rows)
    assert got == [(0, "abcdef", 0), (1, "cdefgh", 4), (2, "efghij", 4), (3, "ghij", 4), (99, "ghij", 4)]


def test_term_updates_reach_a_running_scan(spark):
    path = shared_dir(spark, "terms")
    terms.create_list(spark, path, ["alpha"])
    stream = batches_of(spark, "i int, text string", [(1, "Alpha beta")], [(2, "alpha BETA")], [(3, "alpha beta")])
    base = ScanConfig((detect.PatternDetector(),))
    got = {}

    def write(batch, epoch):
        for r in batch.collect():
            got.setdefault(r["i"], []).append(r["value"])
        terms.add_terms(spark, path, ["Beta"]) if epoch == 0 else terms.clear_terms(spark, path)

    run_batches(spark, counters.scan_with_live_terms(stream, spark, path, "i", "text", base, write))
    assert {k: sorted(v) for k, v in got.items()} == {1: ["Alpha"], 2: ["BETA", "alpha"]}
    assert terms.list_terms(spark, path).isEmpty()
    terms.add_terms(spark, path, ["New", "new"])
    assert [r["term"] for r in terms.list_terms(spark, path).collect()] == ["new"]


def test_running_counts(spark):
    events = [(f"2024-01-01 0{h}:10:00", k) for h in (0, 0, 1, 3, 6) for k in ("x", "y")]
    df = [(t, k) for t, k in events]
    stream = batches_of(spark, "t string, k string", df[:4], df[4:]).select(
        F.col("t").cast("timestamp").alias("ts"), "k"
    )
    rows = run(spark, counters.running_counts(stream, "ts", ["k"])).collect()
    closed = {(r["window_start"].hour, r["k"]): r["requests"] for r in rows}
    assert closed[(0, "x")] == 2 and closed[(1, "y")] == 1 and (6, "x") not in closed


def test_event_stream_lines(spark):
    path = shared_dir(spark, "sse")
    lines = ["event: message", "data: hello a@b.com", "data:none", "", "id: 1"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    got = readers.read_sse(spark, path)
    assert {r["data"] for r in got.filter("is_data").collect()} == {"hello a@b.com"}
    assert sorted(r["value"] for r in readers.sse_text(got, "data").collect()) == sorted(lines)
    assert run(spark, readers.read_sse(spark, path, stream=True)).count() == 5


def test_sources_and_sinks(spark, keys):
    path = shared_dir(spark, "bodies")
    bodies = spark.createDataFrame([("1", "openai", "{}"), ("2", "openai", None)], readers.BODY_SCHEMA)
    bodies.write.json(path)
    good, lost = readers.reject_unreadable(readers.read_bodies(spark, path))
    assert good.count() == 1 and lost.first()["reason"] == "unreadable body"
    assert readers.read_bodies(spark, path, stream=True).isStreaming

    files = shared_dir(spark, "files")
    spark.createDataFrame([("a@b.com",)], "value string").coalesce(1).write.text(files)
    rows = readers.read_files(spark, files, glob="*.txt").collect()
    assert [bytes(r["content"]) for r in rows] == [b"a@b.com\n"]

    texts = spark.createDataFrame([("s", "a@b.com")], "scope string, text string")
    done = redact.redact(texts, "text", "scope", CFG, keys)
    out = shared_dir(spark, "redacted")
    sinks.write_redacted(done.withColumn("html", F.col("text")), out, keep=["scope", "redacted"])
    assert set(spark.read.parquet(out).columns) == {"scope", "redacted"}
    vault_path = shared_dir(spark, "vault")
    vault = redact.build_vault(done, "scope", keys).withColumn("scope_date", F.lit("2024-01-01"))
    sinks.write_vault(vault, vault_path, scope_date="scope_date")
    assert spark.read.parquet(vault_path).filter("scope_date = '2024-01-01'").count() == 1
    metrics_path = shared_dir(spark, "metrics")
    for _ in range(2):
        sinks.write_metrics(spark.createDataFrame([("email", 1)], "type string, n int"), metrics_path)
    assert spark.read.parquet(metrics_path).count() == 1


def test_files_of_many_keys_share_folders_and_tasks(spark, tmp_path):
    path = f"file:{tmp_path}/files"
    rows = [(i, f"text {i}") for i in range(200)] + [(7, "text 7"), (8, None), (None, "x")]
    sinks.write_files(spark.createDataFrame(rows, "k long, t string"), path, "k", "t")
    folders = {p.parent for p in tmp_path.glob("files/**/*.txt")}
    assert all(f.name.startswith("part-") for f in folders)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        files = readers.read_files(spark, path, glob="*.txt")
        assert files.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        got = {r["path"].split("k=")[1]: bytes(r["content"]) for r in files.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {f"{i}.txt": f"text {i}\n".encode() for i in range(200)}
    want |= {"7.txt": b"text 7\n" * 2, "__HIVE_DEFAULT_PARTITION__.txt": b"x\n"}
    assert got.pop("8.txt") in (b"text 8\n\n", b"\ntext 8\n")
    assert got == {k: v for k, v in want.items() if k != "8.txt"}


def test_event_stream_files_keep_their_lines_in_order(spark, tmp_path):
    for name, text in (("a", "id: 1\n\ndata: x a@b.com\n: ping\n"), ("b", "data: 123-45-6789\r\ndata: y")):
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    got = readers.read_sse_streams(spark, str(tmp_path))
    done = redact.redact(got.withColumn("scope", F.lit("s")), "data", "scope", CFG, KEYS)
    lines = sorted(
        (r["stream_id"][-5:], r["seq"], r["is_data"], r["value"], r["redacted"]) for r in done.collect()
    )
    assert [x[:4] for x in lines] == [
        ("a.txt", 0, False, "id: 1"), ("a.txt", 1, False, ""), ("a.txt", 2, True, "data: x a@b.com"),
        ("a.txt", 3, False, ": ping"), ("b.txt", 0, True, "data: 123-45-6789"), ("b.txt", 1, True, "data: y"),
    ]
    assert lines[2][4].startswith("x __PII_email_") and lines[4][4].startswith("__PII_ssn_")
    assert lines[0][4] is None
    assert run(spark, readers.read_sse_streams(spark, str(tmp_path), stream=True)).count() == 6


def test_large_stream_files_are_split_and_keep_their_order(spark, tmp_path):
    rng = random.Random(5)
    want, streams = [], []
    for name in ("a", "b", "c"):
        text, head, seq, ends = [], 0, 0, "\r\n" if name == "b" else "\n"
        header = None
        for n in range(0 if name == "c" else 4000):
            value = rng.choice(["", ": ping", "data: é" + "x" * rng.randrange(60), f"id: {name}{n}"])
            text.append(value)
            want.append((f"{name}.txt", n, value))
            if value.startswith("id: "):
                head, header = n, value
            streams.append((f"{name}.txt#{head}", header, n - head, value))
        (tmp_path / f"{name}.txt").write_bytes("".join(v + ends for v in text).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.read_sse_streams(spark, str(tmp_path)).collect()
        assert readers.ordered_lines(spark, str(tmp_path)).select("file", "_split").distinct().count() > 20
        within = readers.read_sse_streams(spark, str(tmp_path), header="id: ").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    name = lambda r: r["stream_id"].rsplit("/", 1)[1]
    assert sorted((name(r), r["seq"], r["value"]) for r in got) == want
    key = lambda x: (x[0], x[2])
    assert sorted(((name(r), r["header"], r["seq"], r["value"]) for r in within), key=key) == sorted(streams, key=key)


def test_folders_of_a_session_are_released(spark):
    path = shared_dir(spark, "short-lived")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.sparkContext.applicationId in path


def test_batches_arrive_in_as_many_files_as_their_rows_need(spark, monkeypatch):
    texts = spark.createDataFrame(
        [(f"s{i}", f"word{i} " * (20 + i)) for i in range(30)], "scope string, text string"
    )
    got = {}
    for rows in (5, 1_000_000):
        monkeypatch.setattr(plans, "ROWS_PER_FILE", rows, raising=False)
        stream = plans._arriving(spark, texts, "scope", "text")
        chunk_rows = stream.select("stream_id", "seq", F.input_file_name().alias("file"))
        files = plans._to_table(spark, chunk_rows, "files").select("file").distinct().count()
        windows = plans._to_table(spark, chunks.overlap_windows(stream), "windows")
        got[rows] = files, sorted(map(tuple, windows.collect()), key=str)
    assert got[1_000_000][0] == plans.MICRO_BATCHES < got[5][0]
    assert got[5][1] == got[1_000_000][1]


TIMED = CHUNKS + ", ts timestamp"


def joined(rows, column="text"):
    return "".join(r[column] for r in sorted((r for r in rows if r["at"] is not None), key=lambda r: r["at"]))


def test_chunks_in_any_order_over_batches(spark, keys):
    text = "Write a@b.com, ssn 123-45-6789, or call. " * 6
    parts = [("a", i, text[i * 7 : i * 7 + 7], (i + 1) * 7 >= len(text)) for i in range(-(-len(text) // 7))]
    mixed = sorted(parts, key=lambda r: hash(("seed", r[1] * 2654435761 % 97)))
    stream = batches_of(spark, CHUNKS, mixed[:9], mixed[9:20] + mixed[:3], mixed[20:], mixed[5:8])
    rows = run(spark, chunks.redact_stream_with_rejects(stream, CFG, keys, keep_ends=True)).collect()
    taken = [r for r in rows if r["reason"] is None]
    assert re.sub(TOKEN_PATTERN, "<>", joined(taken, "redacted")) == "Write <>, ssn <>, or call. " * 6
    again = sorted(r["seq"] for r in rows if r["reason"] == "repeated")
    assert again == sorted(r[1] for r in mixed[:3] + mixed[5:8])
    assert {r["reason"] for r in rows} == {None, "repeated"}


def test_missing_chunks_are_given_up_after_patience(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    stream = batches_of(
        spark, TIMED,
        [("a", 0, "one ", False, at(0)), ("a", 2, "three ", False, at(1))],
        [("a", 3, "four ", False, at(30))],
        [("a", 1, "two ", False, at(31)), ("a", 4, "five", True, at(32)), ("a", 9, "beyond", False, at(33))],
    )
    rows = run(spark, chunks.sequenced(stream, chunks.value_cut(""), patience_ms=10_000, keep_ends=True)).collect()
    assert joined(rows) == "one three four five"
    refused = {(r["seq"], r["text"], r["reason"]) for r in rows if r["reason"]}
    assert refused == {(1, "two ", "late"), (9, "beyond", "repeated")}
    windows = run(spark, chunks.overlap_windows(stream, 4, patience_ms=10_000, keep_ends=True)).collect()
    got = [(r["seq"], r["window"]) for r in windows]
    assert sorted(got, key=str) == sorted(
        [(0, "one "), (2, "three "), (3, "ree four "), (4, "our five"), (None, "five")], key=str
    )


def test_vault_rows_after_their_tokens(spark, keys):
    texts = spark.createDataFrame([("a", "mail a@b.com, ssn 123-45-6789."), ("b", "c@d.org")], "scope string, text string")
    done = redact.redact(texts, "text", "scope", CFG, keys)
    vault = [tuple(r) for r in redact.build_vault(done, "scope", keys).select("scope_id", "token", "ciphertext").collect()]
    replies = {r["scope"]: r["redacted"] for r in done.collect()}
    forged = "__PII_email_" + "0" * 16 + "_" + "1" * 16 + "__"
    rows = [("a", 0, replies["a"][:20], False, None), ("a", 1, replies["a"][20:], True, None),
            ("b", 0, replies["b"] + " and " + forged, True, datetime.datetime(2024, 1, 1))]
    late = ("b", 7, "", False, datetime.datetime(2024, 1, 2))
    stream = batches_of(spark, TIMED, rows, [rows[0]], [rows[0]], [late])
    entries = batches_of(spark, "scope_id string, token string, ciphertext binary", [], vault[:1], vault[1:], [])
    out = run(spark, chunks.rehydrate_with_vault_stream(stream, entries, keys, patience_ms=1000)).collect()
    for scope, want in (("a", "mail a@b.com, ssn 123-45-6789."), ("b", "c@d.org and " + forged)):
        assert joined([r for r in out if r["stream_id"] == scope], "restored") == want
    assert {r["complete"] for r in out if r["stream_id"] == "a"} == {True}
    assert False in {r["complete"] for r in out if r["stream_id"] == "b"}


def test_streams_share_states(spark, keys):
    first = [(s, 0, "mail a@", False) for s in ("a", "b", "c", None)]
    second = [("b", 1, "b.co now", True), ("a", 1, "b.co or", False), ("d", 0, "x ssn 123-45-6789", True)]
    third = [(None, 1, "b.co.", True), ("a", 2, " ssn 123-45-6789", True)]
    stream = batches_of(spark, CHUNKS, first, second, third)
    units = chunks.sequenced(stream, chunks.value_cut(""), buckets=1)
    out = shared_dir(spark, "out")
    query = (
        units.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 1
    rows = spark.read.schema(units.schema).parquet(out).collect()
    want = {"a": "mail a@b.co or ssn 123-45-6789", "b": "mail a@b.co now", "d": "x ssn 123-45-6789", None: "mail a@b.co."}
    got = {s: joined([r for r in rows if r["stream_id"] == s]) for s in {r["stream_id"] for r in rows}}
    assert got == want | {"c": "mail"}  # which has not ended


def test_texts_are_cut_once(spark, capsys):
    texts = spark.createDataFrame([("a", "0123456789" * 3), ("b", ""), ("c", None), (None, "xyz\nz")], "id string, text string")
    rows = chunks.numbered_chunks(texts, "id", "text", 8)
    rows.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [("a", 0, "01234567", False), ("a", 1, "89012345", False), ("a", 2, "67890123", False),
         ("a", 3, "456789", True), (None, 0, "xyz\nz", True)], key=str
    )
