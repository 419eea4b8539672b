"""Scopes that end in a stored vault, and counters that add up."""

import os
from collections import Counter

from pyspark.sql import functions as F

from veilframe.config import default_config
from veilframe.operators import redact, retention
from veilframe.sources import sinks
from veilframe.sources.workdir import materialise, shared_dir

DAYS = ("2024-01-01", "2024-01-02", "2024-01-03")


def stored(spark, keys):
    rows = [(s, DAYS[int(s) % 3], f"mail a{n}@b.com") for s in map(str, range(9)) for n in range(3)]
    rows.append((None, DAYS[0], "mail x@y.com"))
    texts = spark.createDataFrame(rows, "scope string, day string, text string")
    done = redact.redact(texts, "text", "scope", default_config(), keys)
    salts = materialise(retention.new_scope_keys(done, "scope"), "salts")
    day = F.element_at(F.array(*map(F.lit, DAYS)), 1 + F.col("scope_id").cast("int") % 3)
    vault = retention.build_scoped_vault(done, "scope", salts, keys).withColumn("scope_date", day)
    path = shared_dir(spark, "vault")
    sinks.write_vault(vault, path, "scope_date")
    return path, salts


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_days_with_ended_scopes_are_rewritten(spark, keys):
    path, salts = stored(spark, keys)
    before, copy = files(path), materialise(spark.read.parquet(path), "copy")
    # one scope of day 1, all three of day 2, and scopes that are not there
    expired = spark.createDataFrame([("1",), ("1",), ("2",), ("5",), ("8",), ("77",), (None,)], "scope_id string")
    assert retention.expire_stored(spark, path, expired) == 2
    left = Counter(r["scope_id"] for r in spark.read.parquet(path).collect())
    assert left == {s: 3 for s in "03467"}
    days = lambda names: {f.split("scope_date=")[1][:10] for f in names}
    after = files(path)
    assert days(before & after) == {DAYS[0]} and days(after - before) == {DAYS[1]}
    assert not os.path.exists(f"{path}/scope_date={DAYS[2]}")
    assert retention.expire_stored(spark, path, expired) == 0 and files(path) == after

    kept = materialise(retention.drop_scope_keys(salts, expired), "kept")
    tokens = copy.select("scope_id", "token")
    read = lambda with_salts: {
        r["scope_id"] for r in retention.lookup(tokens, copy, with_salts, keys).filter("value is not null").collect()
    }
    assert read(salts) == set("012345678") and read(kept) == set("03467")
    again = retention.new_scope_keys(copy)  # new salts read nothing old
    assert read(materialise(again, "new")) == set()


def test_values_come_back_and_none_without_a_salt(spark, keys):
    path, salts = stored(spark, keys)
    vault = spark.read.parquet(path)
    got = retention.lookup(vault.select("scope_id", "token"), vault, salts, keys)
    assert Counter(r["value"] for r in got.collect()) == {f"a{n}@b.com": 9 for n in range(3)}
    done = redact.redact(
        spark.createDataFrame([("s", "a@b.com")], "scope string, text string"), "text", "scope", default_config(), keys
    )
    bare = retention.build_scoped_vault(done, "scope", salts, keys).collect()
    assert [r["ciphertext"] for r in bare] == [None]


def test_counters_take_every_batch_once(spark):
    table = sinks.CounterTable(shared_dir(spark, "counters"), "type string, n bigint", ("n",))
    frame = lambda *rows: spark.createDataFrame(rows, "n long, type string")
    read = lambda: {r["type"]: r["n"] for r in table.read(spark).collect()}
    assert read() == {}
    table.compact(spark, 5)
    table.add(frame((1, "a"), (2, "a"), (5, None)), 0)
    table.add(frame((10, "a"), (1, "b")), 1)
    table.add(frame((10, "a"), (1, "b")), 1)
    assert read() == {"a": 13, "b": 1, None: 5}
    table.compact(spark, 1)
    table.add(frame((1, "a"), (2, "a"), (5, None)), 0)  # replayed after the compaction
    table.add(frame((100, "b")), 2)
    assert read() == {"a": 13, "b": 101, None: 5}
    table.compact(spark, 2)
    table.compact(spark, 2)
    table.compact(spark, 1)
    table.add(frame((7, "c")), 3)
    assert read() == {"a": 13, "b": 101, None: 5, "c": 7}
    folders = lambda kind: sorted(os.listdir(f"{table.path}/{kind}"))
    assert folders("totals") == ["n=1", "n=2"] and folders("epochs") == ["n=2", "n=3"]
