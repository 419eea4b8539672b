"""Allow-lists and address ranges that are tables."""

import ipaddress
import random

from pyspark.sql import functions as F

from veilframe.config import default_config
from veilframe.operators import detect, guards


def test_allow_list_table_equals_the_inline_form(spark):
    texts = [(i, f"mail a{i % 5}@b.com and C{i % 3}@D.org ssn 123-45-678{i % 10}") for i in range(40)]
    texts += [(None, None), (None, ""), (99, "nothing here")] + [(100, "a1@b.com")] * 30
    df = spark.createDataFrame(texts, "i int, text string").repartition(4)
    safe = ["A1@B.com", "c2@d.org", "unseen@x.org"]
    listed = spark.createDataFrame([(v,) for v in [*safe, None]], "value string")
    found = detect.scan(df, "text", default_config(allowlist=()))
    got = detect.keep_unlisted(found, "spans", listed)
    want = detect.scan(df, "text", default_config(allowlist=tuple(safe)))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    none = detect.keep_unlisted(found, "spans", listed.limit(0))
    assert sorted(map(repr, none.collect())) == sorted(map(repr, found.collect()))


def test_longest_range_wins(spark):
    rng = random.Random(1)
    ranges = []
    for n in range(300):
        bits = rng.choice([0, 7, 8, 12, 20, 24, 31, 32])
        net = ipaddress.ip_network((rng.choice([10, 172, 8]) << 24 | rng.randrange(1 << 24), bits), strict=False)
        ranges.append((str(net), f"r{n}"))
    for n, text in enumerate(("fd00::/8", "fd00:1::/33", "2001:db8::1/128", "2001:db8::1")):
        ranges.append((text, f"s{n}"))
    bad = [("10.0.0.0/33", "bad"), ("10.0.0/8", "bad"), ("x", "bad"), (None, "bad"), ("10.0.0.0/8/8", "bad")]
    addresses = [".".join(map(str, (rng.choice([10, 172, 8]), *(rng.randrange(256) for _ in range(3))))) for _ in range(200)]
    addresses += ["10.1.2.3"] * 50 + ["fd00:1:8000::", "fd00:1::1", "2001:db8::1", "fe80::1", "no address", "", None, "::ffff:10.1.2.3"]
    df = spark.createDataFrame([(a, "own") for a in addresses], "ip string, label string").repartition(3)
    table = spark.createDataFrame(ranges + bad, "cidr string, label string")
    got = guards.label_by_range(df, "ip", table, out="network")
    nets = [(ipaddress.ip_network(c), label) for c, label in ranges]
    assert got.count() == len(addresses)
    for row in got.collect():
        try:
            ip = ipaddress.ip_address(row["ip"])
        except ValueError:
            assert row["network"] is None
            continue
        ip = getattr(ip, "ipv4_mapped", None) or ip
        hits = [(n.prefixlen, label) for n, label in nets if n.version == ip.version and ip in n]
        best = max((p for p, _ in hits), default=None)
        assert row["network"] == min((x for p, x in hits if p == best), default=None), row
    assert guards.label_by_range(df, "ip", table.limit(0)).filter(F.col("label").isNotNull()).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
