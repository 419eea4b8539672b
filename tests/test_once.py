"""Costly steps happen once a text."""

import random

from pyspark.sql import functions as F

from veilframe.config import default_config
from veilframe.functions import spans
from veilframe.operators import chat
from veilframe.plans import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_are_redacted_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"write to a{i}@corp.org or 123-45-6{i:03d} \"x\\y\" " + "w " * 30) for i in range(10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    calls, plain = [], chat.redact_bodies

    def counted(*args, **kwargs):
        calls.append(1)
        return plain(*args, **kwargs)

    monkeypatch.setattr(queries.chat, "redact_bodies", counted)
    done = queries.request_to_audit(spark, str(tmp_path))
    assert len(calls) == 1
    assert "regexp_replace" not in _plan(done)  # what is left reads stored tables
    got = {r["request_id"]: r for r in done.collect()}
    assert sorted(got) == [str(i) for i in range(10) if i % 5 != 4]
    assert all("a5@corp.org" not in r["request_redacted"] for r in got.values())
    assert "a5@corp.org" in got["5"]["response"]


def test_tokens_are_held_once_a_text(spark, keys):
    rows = spark.createDataFrame([("r", "openai", "{}")], "request_id string, provider string, body string")
    done = chat.redact_bodies(rows, default_config(), keys, only=("openai",))
    assert _plan(done).count(chat._HELD) == 2  # held once, put back once


def test_parts_without_a_match_are_not_placed(spark):
    text = F.col("t")
    found = F.array(*[spans.matches(text, p, "t", 1.0, "d") for p in ("a", "b", "c")])
    row = spark.createDataFrame([("xbx",)], "t string").select(spans.place(found).alias("s"))
    assert [(s["start"], s["value"]) for s in row.first()["s"]] == [(1, "b")]
    assert "array_compact" not in str(spans.place(found)) and "size(" in _plan(row).split("transform(filter(")[1][:900]


def test_sums_of_short_and_long_arrays(spark):
    pick = random.Random(5)
    rows = [([pick.randrange(9) for _ in range(n)],) for n in (0, 1, 2, 31, 32, 33, 34, 100)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", spans.before(F.col("v"), lambda a, b: a + b).alias("b")).collect()
    assert all(r["b"] == [sum(r["v"][:i]) for i in range(len(r["v"]))] for r in got)


def test_strings_with_backslashes_and_quotes(spark, keys):
    texts = ['a"b', "a\\", '\\"', "\\\\\"", "﷐ ﷑ \\n", "plain", 'call "x@y.org" \\ now']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    body = F.to_json(F.struct(F.array(F.struct(F.col("t").alias("content"))).alias("messages")))
    cut = chat._joined(chat._cut(body))
    old = F.translate(body, "﷐﷑", "��")
    assert all(r["a"] == r["b"] for r in rows.select(cut.alias("a"), old.alias("b")).collect())
