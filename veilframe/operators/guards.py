"""Predicates that admit, flag or reject a record."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import MAX_BODY_BYTES
from veilframe.functions.patterns import INJECTION_PATTERNS, to_jdk
from veilframe.functions.spans import let

# --- fixed values: reserved address ranges ------------------------------------
PRIVATE_V4 = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "0.0.0.0/8",
    "100.64.0.0/10",
    "198.18.0.0/15",
    "224.0.0.0/4",
)
PRIVATE_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")
# --- end of fixed values ------------------------------------------------------

def injection_id(body: Column) -> Column:
    """1-based number of the first injection pattern that matches, else NULL."""
    return F.coalesce(
        *[F.when(body.rlike(to_jdk(p)), F.lit(i)) for i, p in enumerate(INJECTION_PATTERNS, 1)]
    )


def injection_text(body: Column, pattern_id: Column) -> Column:
    """The text the given pattern matched."""
    chain = None
    for i, p in enumerate(INJECTION_PATTERNS, 1):
        hit = F.regexp_extract(body, to_jdk(p), 0)
        chain = F.when(pattern_id == i, hit) if chain is None else chain.when(pattern_id == i, hit)
    return chain


def flag_injection(df: DataFrame, body: str, mode: str = "flag") -> DataFrame:
    """Add ``pattern_id``, ``matched`` and ``action`` (``blocked``/``flagged``/NULL)."""
    action = "blocked" if mode.lower() == "block" else "flagged"
    return (
        df.withColumn("pattern_id", injection_id(F.col(body)))
        .withColumn("matched", injection_text(F.col(body), F.col("pattern_id")))
        .withColumn("action", F.when(F.col("pattern_id").isNotNull(), F.lit(action)))
    )


def admitted(flagged: DataFrame) -> DataFrame:
    """Rows that go through: everything not blocked."""
    return flagged.filter(F.coalesce(F.col("action") != "blocked", F.lit(True)))


def rejected(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("action") == "blocked")


def within_size(body: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    """True for bodies of at most ``max_bytes`` bytes."""
    return F.coalesce(F.octet_length(body), F.lit(0)) <= max_bytes


def _v4_number(ip: Column) -> Column:
    """An IPv4 address as a number, NULL unless it has four plain octets."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    parts = F.split(ip, r"\.")
    number = sum(
        (F.get(parts, i).cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)),
        F.get(parts, 0).cast("bigint") * 256**3,
    )
    return F.when(ip.rlike(rf"\A(?:{octet}\.){{3}}{octet}\z"), number)


def _v4_range(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    start = 0
    for octet in base.split("."):
        start = start * 256 + int(octet)
    return start, start + 2 ** (32 - int(bits)) - 1


def _v6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, NULL if malformed."""
    def undotted(lower: Column) -> Column:
        """A trailing dotted quad as two groups."""
        number = _v4_number(F.regexp_extract(lower, r"^(?:.*:)([0-9.]+)$", 1))
        groups = let(
            number,
            lambda n: F.lower(
                F.concat(
                    F.hex(F.floor(n / 65536).cast("bigint")), F.lit(":"), F.hex(n % 65536)
                )
            ),
        )
        head = F.regexp_extract(lower, r"^(.*:)[0-9.]+$", 1)
        return F.when(F.contains(lower, F.lit(".")), F.concat(head, groups)).otherwise(lower)

    def filled(part: Column) -> Column:
        groups = F.filter(F.split(part, ":"), lambda g: g != "")
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def whole(sides: Column) -> Column:
        given = F.length(sides["left"]) + F.length(sides["right"])
        fits = F.when(sides["n"] == 2, given <= 28).otherwise((sides["n"] == 1) & (given == 32))
        zeros = F.repeat(F.lit("0"), F.lit(32) - given)
        return F.when(fits, F.concat(sides["left"], zeros, sides["right"]))

    def parsed(plain: Column) -> Column:
        halves = F.split(plain, "::", -1)
        sides = F.struct(
            filled(F.get(halves, 0)).alias("left"),
            filled(F.coalesce(F.get(halves, 1), F.lit(""))).alias("right"),
            F.size(halves).alias("n"),
        )
        run = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
        tidy = plain.rlike(rf"\A(?:{run})?(?:::(?:{run})?)?\z")
        return F.when(tidy, let(sides, whole))

    return F.when(F.contains(ip, F.lit(":")), let(undotted(F.lower(ip)), parsed))


def _v6_test(digits: Column, cidr: str) -> Column:
    """Whether 32 hex digits lie in a v6 range, by prefix and one masked digit."""
    base, bits = cidr.split("/")
    n = int(bits)
    left, _, right = base.partition("::")
    groups = [g.zfill(4) for g in left.split(":") if g]
    tail = [g.zfill(4) for g in right.split(":") if g]
    number = "".join(groups + ["0000"] * (8 - len(groups) - len(tail)) + tail)
    whole, rest = divmod(n, 4)
    test = F.startswith(digits, F.lit(number[:whole])) if whole else F.lit(True)
    if rest:
        low = int(number[whole], 16)
        allowed = [f"{d:x}" for d in range(low, low + 2 ** (4 - rest))]
        test = test & F.substring(digits, whole + 1, 1).isin(*allowed)
    return test


def is_private_ip(ip: Column) -> Column:
    """True for private and reserved addresses, v4 or v6; NULL if not an address.

    IPv4 written as ``::ffff:a.b.c.d`` is judged as IPv4.
    """
    def in_v4(number: Column) -> Column:
        return reduce(or_, [number.between(*_v4_range(c)) for c in PRIVATE_V4])

    def judge_v6(digits: Column) -> Column:
        mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
        return F.when(
            F.startswith(digits, F.lit("0" * 20 + "ffff")), let(mapped, in_v4)
        ).otherwise(reduce(or_, [_v6_test(digits, c) for c in PRIVATE_V6]))

    return F.when(
        F.contains(ip, F.lit(":")), let(_v6_hex(ip), lambda d: F.when(d.isNotNull(), judge_v6(d)))
    ).otherwise(let(_v4_number(ip), in_v4))


def _bits(hex_digits: Column) -> Column:
    """Hex digits as zeros and ones."""
    return F.array_join(
        F.transform(F.split(hex_digits, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), ""
    )


def address_bits(ip: Column) -> Column:
    """An address as 128 zeros and ones, IPv4 as ``::ffff:a.b.c.d``; NULL if malformed."""
    v4 = let(_v4_number(ip), lambda n: F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(n)), 8, "0")))
    digits = F.when(F.contains(ip, F.lit(":")), _v6_hex(ip)).otherwise(v4)
    return let(digits, lambda d: F.when(d.isNotNull(), _bits(d)))


def label_by_range(
    df: DataFrame, ip: str, ranges: DataFrame, out: str = "label", cidr: str = "cidr", label: str = "label"
) -> DataFrame:
    """Add the label of the longest range that holds an address; NULL if none does.

    ``ranges`` is a table of any length, v4 and v6 (``base/bits``, or a single
    address). Distinct addresses give one key per prefix length in use (129 at
    most) and meet the ranges in one hash join. The found labels go back to the rows
    dealt by salts, so an address in a third of all rows is not one task's work.
    Malformed ranges hold nothing; of equal ranges the least label counts.
    """
    parts = F.split(F.col(cidr), "/")
    base, given = F.get(parts, 0), F.expr(f"try_cast(get(split(`{cidr}`, '/'), 1) as int)")
    v4 = ~F.contains(base, F.lit(":"))
    whole = F.when(v4, 32).otherwise(128)
    n = F.when(F.size(parts) == 1, whole).when((F.size(parts) == 2) & given.between(0, whole), given)
    prefixes = (
        ranges.select(address_bits(base).alias("bits"), (n + F.when(v4, 96).otherwise(0)).alias("n"), F.col(label).alias("_label"))
        .filter("bits is not null and n is not null")
        .groupBy(F.substring("bits", F.lit(1), F.col("n")).alias("prefix"), "n")
        .agg(F.min("_label").alias("_label"))
    )
    lengths = sorted(r[0] for r in prefixes.select("n").distinct().collect())  # at most 129
    if not lengths:
        return df.withColumn(out, F.lit(None).cast(ranges.schema[label].dataType))
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("bits", address_bits(F.col("_ip")))
    keys = addresses.filter("bits is not null").select(
        "_ip", "bits", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")
    ).select("_ip", "n", F.substring("bits", F.lit(1), F.col("n")).alias("prefix"))
    found = keys.join(prefixes, ["prefix", "n"]).groupBy("_ip").agg(F.max_by("_label", "n").alias("_label"))
    rows = left_join_salted(df.drop(out), F.col(ip), found, "_ip")
    return rows.withColumnRenamed("_label", out)


def left_join_salted(df: DataFrame, value: Column, right: DataFrame, key: str) -> DataFrame:
    """A left join with a table of distinct keys, its rows dealt to salts; the key is dropped."""
    columns = [c for c in df.columns if not _is_map(df, c)]
    salt = F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")
    many = right.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # rows without a value meet nothing: they are dealt as evenly by their salt's sign
    rows = df.withColumn("_value", value).withColumn("_salt", F.when(value.isNull(), -1 - F.xxhash64(*columns) % 4096).otherwise(salt).cast("int"))
    met = rows.join(many, (F.col("_value") == F.col(key)) & (F.col("_salt") == F.col("_s")), "left")
    return met.drop("_value", "_salt", "_s", key)


def host_of(url: Column) -> Column:
    """Host of a URL without user, port or brackets; empty when there is none."""
    start = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?"
    bracketed = F.regexp_extract(url, start + r"\[([^\]]*)\]", 1)
    plain = F.regexp_extract(url, start + r"([^/?#:\[]*)", 1)
    return F.when(bracketed != "", bracketed).otherwise(plain)


def base_domain(url: Column) -> Column:
    """The domain of a base URL: scheme cut off, then everything from the first slash."""
    bare = F.regexp_replace(F.regexp_replace(url, "^https://", ""), "^http://", "")
    return F.regexp_replace(bare, "(?s)^([^/]+)/.*$", "$1")


def domain_allowed(host: Column, domains: Iterable[str]) -> Column:
    """Host equals a domain (ignoring case) or ends with ``.domain`` (exact case).

    An empty list allows everything. Long lists belong into ``allowed_by_table``.
    """
    domains = list(domains)
    if not domains:
        return F.lit(True)
    test = F.lower(host).isin(*sorted({d.lower() for d in domains}))
    for d in sorted(set(domains)):
        test = test | F.endswith(host, F.lit("." + d))
    return test


def allowed_by_table(df: DataFrame, host: str, domains: DataFrame, column: str) -> DataFrame:
    """Rows whose host passes a domain table of any size.

    Distinct hosts are exploded to their suffixes and semi-joined by hash, so a
    host that fills a third of the rows is tested once; giving the outcome back
    is salted, so that it isn't one task's work either. An empty table passes
    every row.
    """
    if domains.isEmpty():
        return df
    keys = domains.select(
        F.explode(
            F.array(
                F.concat(F.lit("="), F.lower(column)), F.concat(F.lit("."), F.col(column))
            )
        ).alias("k")
    ).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
        lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    probes = (
        df.select(F.col(host).alias("h")).distinct()
        .withColumn("k", F.explode(F.concat(F.array(F.concat(F.lit("="), F.lower("h"))), suffixes)))
    )
    good = probes.join(keys, "k", "left_semi").select("h").distinct()
    return semi_join_salted(df, F.col(host), good, "h", "left_semi")


SALTS = 16


def semi_join_salted(df: DataFrame, value: Column, listed: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join on a value that may fill a large part of ``df``.

    Rows are dealt to salts by all their columns. The distinct (value, salt) pairs,
    few for a busy value, meet the list first, so that it is never repeated per
    salt; what is found goes back to the rows. There are never more pairs than rows.
    Nothing is broadcast, as Spark can't tell the size of hashed or salted values
    from the files they come from.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if not _is_map(df, c)]), F.lit(SALTS))
    rows = df.withColumn("_value", value).withColumn("_salt", salt.cast("int"))
    pairs = rows.select(F.col("_value").alias("_v"), F.col("_salt").alias("_s")).distinct()
    values = listed.select(F.col(column).alias("_listed"))
    met = pairs.join(values.hint("merge"), F.col("_v") == F.col("_listed"), "left_semi")
    same = (F.col("_value") == F.col("_v")) & (F.col("_salt") == F.col("_s"))
    return rows.join(met.hint("merge"), same, how).drop("_value", "_salt")


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def bearer_key(authorization: Column) -> Column:
    """SHA-256 of the key in a ``Bearer`` header, NULL for other schemes."""
    return F.when(
        F.startswith(authorization, F.lit("Bearer ")),
        F.sha2(F.substring(authorization, F.lit(8), F.length(authorization)), 256),
    )


def admit_keys(df: DataFrame, authorization: str, key_hashes: DataFrame) -> DataFrame:
    """Rows whose bearer key is listed; ``key_hashes`` has a column ``key_hash``."""
    key = bearer_key(F.col(authorization))
    return semi_join_salted(df.filter(key.isNotNull()), key, key_hashes, "key_hash", "left_semi")


def reject_keys(df: DataFrame, authorization: str, key_hashes: DataFrame) -> DataFrame:
    """The complement of ``admit_keys``.

    Rows without a bearer key are rejected outright: sent through the join they
    would all hash to one task.
    """
    key = bearer_key(F.col(authorization))
    unlisted = semi_join_salted(df.filter(key.isNotNull()), key, key_hashes, "key_hash", "left_anti")
    return unlisted.unionByName(df.filter(key.isNull()))
