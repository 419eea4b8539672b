"""One query per operator. Each takes ``(spark, sf_dir)`` and returns a table."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.config import SAFE_VALUES, ScanConfig, default_config
from veilframe.functions.patterns import PATTERNS, Pattern
from veilframe.functions.spans import SPANS_TYPE
from veilframe.functions.tokens import parse_token
from veilframe.operators import (
    audit,
    chat,
    chunks,
    detect,
    files,
    guards,
    metrics,
    rates,
    redact,
    requests,
    restore,
    retention,
    terms,
)
from veilframe.plans import tables
from veilframe.plans.tables import SAMPLE_KEYS
from veilframe.sources import readers, sinks
from veilframe.sources.workdir import materialise, shared_dir
from veilframe.streaming import chunks as stream_chunks
from veilframe.streaming import counters

Query = Callable[[SparkSession, str], DataFrame]

EVERYTHING = default_config(threshold=0.0, allowlist=())
DEFAULT = default_config()
LONG_TERMS = (
    "confidential", "top secret", "secret: mail", "this is", "call x", "card 4111",
    "ssn", "key akia", "kia", "mail test",
)
ALLOWED_DOMAINS = ("example.com", "example.org", "ththth.example.net")
FORGED = "__PII_email_0123456789abcdef_fedcba9876543210__"

# --- shared steps -------------------------------------------------------------


def _span_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    rows = detect.explode_spans(scanned, *keys)
    return rows.select(
        *keys, "type", "detector_name",
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
        "value", "confidence",
    )


def _scanned(spark: SparkSession, sf_dir: str, cfg: ScanConfig) -> DataFrame:
    return detect.scan(tables.rich_documents(spark, sf_dir), "text", cfg)


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact(
        tables.rich_documents(spark, sf_dir), "text", "scope", DEFAULT, SAMPLE_KEYS
    )


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The redacted table and its vault, both written once and read back."""
    done = materialise(_redacted(spark, sf_dir), "redacted")
    return done, materialise(redact.build_vault(done, "scope", SAMPLE_KEYS), "vault")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# --- detection ----------------------------------------------------------------


def scan_one(name: str) -> Query:
    pattern = next(p for p in PATTERNS if p.name == name)
    cfg = ScanConfig(detectors=(detect.PatternDetector((pattern,)),), threshold=0.0)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _span_rows(_scanned(spark, sf_dir, cfg), "doc_id")
        return rows.select("doc_id", "span_start", "span_end", "value")

    return query


def blocklist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = ScanConfig(detectors=(detect.TermDetector(("CONFIDENTIAL", "TOP SECRET")),))
    rows = _span_rows(_scanned(spark, sf_dir, cfg), "doc_id")
    return rows.select("doc_id", "span_start", "span_end", "value")


def term_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long list: the terms that matter, and one per order and customer."""
    docs = tables.rich_documents(spark, sf_dir)
    listed = readers.term_frame(spark, LONG_TERMS)
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        keys = tables.table(spark, sf_dir, name, key)
        listed = listed.unionByName(keys.select(F.expr(f"'{name} ' || cast({key} as string)").alias("term")))
    near = terms.term_spans(docs, "doc_id", "text", listed)
    rows = _span_rows(near, "doc_id")
    return rows.select("doc_id", "span_start", "span_end", "value")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages", "page_id", "html")
    rows = _span_rows(detect.scan(pages, "html", EVERYTHING), "page_id")
    return rows.select("page_id", "type", "detector_name", "span_start", "span_end", "value")


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scanned(spark, sf_dir, DEFAULT).select(
        "doc_id", "text", F.explode_outer("spans").alias("s")
    ).filter(F.col("s").isNotNull())
    return rows.select(
        "doc_id",
        F.col("s.start").cast("bigint").alias("span_start"),
        detect.byte_start(F.col("text"), F.col("s.start")).cast("bigint").alias("byte_start"),
    )


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.rich_documents(spark, sf_dir)
    found = docs.select("doc_id", detect.raw_spans(F.col("text"), EVERYTHING).alias("spans"))
    return _span_rows(found, "doc_id")


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_scanned(spark, sf_dir, EVERYTHING), "doc_id")


def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_scanned(spark, sf_dir, default_config(allowlist=())), "doc_id")


def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = _scanned(spark, sf_dir, EVERYTHING)
    strong = scanned.withColumn("spans", detect.above(F.col("spans"), 0.95))
    return _span_rows(strong, "doc_id")


def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_scanned(spark, sf_dir, DEFAULT), "doc_id")


def allowlist_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values allowed by a table: one key per customer, and the usual ones."""
    keys = tables.table(spark, sf_dir, "customer", "c_custkey")
    allowed = keys.select(F.expr("'akia' || lpad(cast(c_custkey as string), 16, 'a')").alias("value"))
    allowed = allowed.unionByName(spark.createDataFrame([(v,) for v in SAFE_VALUES], "value string"))
    found = materialise(_scanned(spark, sf_dir, default_config(allowlist=())), "scanned")
    return _span_rows(detect.keep_unlisted(found, "spans", allowed), "doc_id")


def custom_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-supplied pandas UDF next to the built-in patterns."""
    @F.pandas_udf(SPANS_TYPE)
    def hex_secrets(texts: pd.Series) -> pd.Series:
        import re

        form = re.compile(r"(?<![0-9A-Za-z_])[0-9a-f]{40}(?![0-9A-Za-z_])")
        return texts.map(
            lambda t: [
                dict(type="hex", start=m.start(), end=m.end(), value=m.group(),
                     confidence=0.99, detector_name="hex40")
                for m in form.finditer(t or "")
            ]
        )

    detectors = (detect.PatternDetector(), detect.RowDetector("hex40", hex_secrets))
    cfg = ScanConfig(detectors=detectors, threshold=0.0)
    return _span_rows(_scanned(spark, sf_dir, cfg), "doc_id")


# --- aggregates over spans ----------------------------------------------------


def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = detect.scan(tables.documents(spark, sf_dir), "text", EVERYTHING)
    return metrics.detections_by_type(detect.explode_spans(scanned, "doc_id"))


def detections_by_type_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detections_by_type(detect.explode_spans(_scanned(spark, sf_dir, DEFAULT), "doc_id"))


def detections_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detections_per_request(_scanned(spark, sf_dir, DEFAULT), "doc_id")


def types_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.types_found(
        detect.explode_spans(_scanned(spark, sf_dir, DEFAULT), "doc_id"), "doc_id"
    )
    return found.select("doc_id", F.array_join("types", ",").alias("types"))


# --- redaction and restoration ------------------------------------------------


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir).select("doc_id", "redacted")


def redacted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_spans(_redacted(spark, sf_dir), "doc_id")
    return rows.select(
        "doc_id", "type", F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"), "token",
    )


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _redacted(spark, sf_dir)
    return done.select("doc_id", redact.leaked(F.col("redacted"), F.col("spans")).alias("leaked"))


def vault_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vault = _stored(spark, sf_dir)
    return restore.lookup(vault.select("scope_id", "token", "pii_type"), vault, SAMPLE_KEYS)


def vault_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.token_counts(redact.build_vault(_redacted(spark, sf_dir), "scope", SAMPLE_KEYS))


def token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_spans(_redacted(spark, sf_dir), "doc_id")
    both = rows.select(
        "doc_id", F.explode(F.array("token", F.concat(F.lit("x"), "token"))).alias("token")
    ).distinct()
    p = parse_token(F.col("token"))
    return both.select(
        "doc_id", "token", p["type"].alias("type"), p["id"].alias("id"), p["sig"].alias("sig")
    )


def verified_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, vault = _stored(spark, sf_dir)
    real = vault.select("scope_id", "token")
    forged = real.select(
        "scope_id",
        F.explode(
            F.array(
                F.regexp_replace("token", "_[0-9a-f]{16}__$", "_0000000000000000__"),
                F.regexp_replace("token", "^__PII_", "__PII_x"),
                F.lit("__PII_email_nothex_nosig__"),
            )
        ).alias("token"),
    )
    foreign = real.select(F.concat("scope_id", F.lit("0")).alias("scope_id"), "token")
    tokens = real.unionByName(forged).unionByName(foreign)
    return restore.verify_and_lookup(tokens, vault, SAMPLE_KEYS)


def rehydrate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, vault = _stored(spark, sf_dir)
    back = restore.rehydrate(done, "redacted", "scope", ["doc_id"], vault, SAMPLE_KEYS)
    return back.select("doc_id", "restored", F.expr("text <=> restored").alias("same"))


def forged_token_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, vault = _stored(spark, sf_dir)
    ssn = F.get(F.filter("spans", lambda s: s["type"] == "ssn"), F.lit(0))["token"]
    twisted = F.concat(
        "redacted", F.lit(" " + FORGED), F.replace(ssn, F.lit("_ssn_"), F.lit("_phone_"))
    )
    sent = done.select("doc_id", "scope", twisted.alias("reply"))
    back = restore.rehydrate(sent, "reply", "scope", ["doc_id"], vault, SAMPLE_KEYS)
    return back.select("doc_id", "restored")


def response_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, vault = _stored(spark, sf_dir)
    reply = F.expr("redacted || ' reply to fresh' || cast(doc_id as string) || '@new.example.org'")
    sent = done.select("doc_id", "scope", reply.alias("reply"))
    back = restore.screen_response(
        sent, "reply", "scope", ["doc_id"], DEFAULT, vault, SAMPLE_KEYS
    )
    return back.select(
        "doc_id", "response", F.size("response_spans").cast("bigint").alias("new_values")
    )


def expire_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vault = _stored(spark, sf_dir)
    toxic = tables.table(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1")
    expired = toxic.select(F.expr("cast(doc_id as string)").alias("scope_id"))
    return restore.expire_scopes(vault, expired).select("scope_id", "token", "pii_type")


DAYS, ENDED_DAYS = 16, 2


def vault_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents' scopes end in the oldest days of a stored vault.

    Per value: whether it is still stored, whether its file was replaced, and
    whether an old copy of the vault can still be read with the salts that are left.
    """
    done = _redacted(spark, sf_dir)
    salts = materialise(retention.new_scope_keys(done, "scope"), "salts")
    day = F.expr(f"'2024-01-' || lpad(cast(1 + cast(scope_id as bigint) % {DAYS} as string), 2, '0')")
    vault = retention.build_scoped_vault(done, "scope", salts, SAMPLE_KEYS).withColumn("scope_date", day)
    path = shared_dir(spark, "vault-days")
    sinks.write_vault(vault, path, "scope_date")
    file = F.col("_metadata.file_path")
    copy = materialise(spark.read.parquet(path).withColumn("file", file), "vault-copy")
    toxic = tables.table(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1")
    expired = toxic.select(F.col("doc_id").cast("string").alias("scope_id")).filter(
        f"cast(scope_id as bigint) % {DAYS} < {ENDED_DAYS}"
    )
    retention.expire_stored(spark, path, expired)
    left = materialise(retention.drop_scope_keys(salts, expired), "salts-left")
    now = spark.read.parquet(path).select("scope_id", "token", file.alias("now"))
    files = now.select(F.col("now").alias("file"), F.lit(False).alias("rewritten")).distinct()
    seen = retention.lookup(copy.drop("ciphertext"), copy, left, SAMPLE_KEYS)
    return seen.join(now, ["scope_id", "token"], "left").join(files, "file", "left").select(
        "scope_id", "token", "pii_type", F.col("scope_date").cast("string").alias("scope_date"),
        F.col("now").isNotNull().alias("stored"), F.col("value").isNotNull().alias("readable"),
        F.coalesce("rewritten", F.lit(True)).alias("rewritten"),
    )


# --- chat bodies --------------------------------------------------------------


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _parts(*texts: Column) -> Column:
    return F.array(*[F.struct(t.alias("text")) for t in texts])


def chat_body(provider: str, direction: str) -> Column:
    """A document's text as the body of a chat request or response."""
    text, intro = F.col("text"), F.concat(F.lit("Be brief "), F.col("scope"))
    if provider == "gemini" and direction == "request":
        content = F.struct(F.lit("user").alias("role"), _parts(intro, text).alias("parts"))
        return F.to_json(
            F.struct(
                F.array(content).alias("contents"),
                F.struct(_parts(intro).alias("parts")).alias("systemInstruction"),
            )
        )
    if provider == "gemini":
        content = F.struct(F.lit("model").alias("role"), _parts(text, F.lit("")).alias("parts"))
        return F.to_json(
            F.struct(
                F.array(F.struct(content.alias("content"), F.lit(0).alias("index"))).alias("candidates"),
                F.struct(F.lit(7).alias("code"), intro.alias("message")).alias("error"),
            )
        )
    if provider == "anthropic" and direction == "request":
        return F.to_json(
            F.struct(
                F.array(_message("user", text), _message("assistant", F.lit(""))).alias("messages"),
                F.lit("m").alias("model"), intro.alias("system"),
            )
        )
    if provider == "anthropic":
        block = F.struct(F.lit("text").alias("type"), text.alias("text"))
        return F.to_json(
            F.struct(
                F.array(block).alias("content"),
                F.struct(F.lit("t").alias("type"), intro.alias("message")).alias("error"),
            )
        )
    if direction == "request":
        turns = F.array(
            _message("system", intro), _message("user", text), _message("assistant", F.lit(""))
        )
        return F.to_json(F.struct(turns.alias("messages"), F.lit("m").alias("model")))
    choice = F.struct(_message("assistant", text).alias("message"), F.lit(0).alias("index"))
    return F.to_json(
        F.struct(
            F.array(choice).alias("choices"),
            F.struct(intro.alias("message"), F.lit("t").alias("type")).alias("error"),
        )
    )


def _chat_rows(spark: SparkSession, sf_dir: str, provider: str, direction: str) -> DataFrame:
    docs = tables.rich_documents(spark, sf_dir)
    return docs.select(
        "doc_id", F.col("scope").alias("request_id"), F.lit(provider).alias("provider"),
        chat_body(provider, direction).alias("body"),
    )


def chat_extract(provider: str, direction: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _chat_rows(spark, sf_dir, provider, direction).withColumn(
            "fields", chat.extract_text(F.col("body"), provider, direction)
        )
        return chat.explode_fields(rows, "doc_id")

    return query


def chat_replace(provider: str, direction: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _chat_rows(spark, sf_dir, provider, direction)
        done = chat.redact_bodies(
            rows, DEFAULT, SAMPLE_KEYS, direction=direction, only=(provider,)
        )
        return done.select("doc_id", "redacted_body")

    return query


def _mixed_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all formats and of one that is unknown."""
    docs = tables.rich_documents(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("openai", "anthropic", "azure", "gemini", "other")])
    provider = F.get(names, (F.col("doc_id") % 5).cast("int"))
    body = F.coalesce(
        chat.by_provider(F.col("provider"), lambda name: chat_body(name, "request")), F.col("text")
    )
    return docs.withColumn("provider", provider).select(
        "doc_id", F.col("scope").alias("request_id"), "provider", body.alias("body"),
        F.timestamp_millis(F.col("doc_id") * 1000).alias("ts"),
        (F.col("doc_id") % 100).cast("string").alias("user_id"),
        F.lit(200).alias("status_code"), F.octet_length("text").alias("latency_ms"),
    )


def chat_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = chat.split_known(_mixed_chats(spark, sf_dir))
    return chat.explode_fields(chat.extract_fields(known), "doc_id", "provider")


def dispatch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lost = chat.split_known(_mixed_chats(spark, sf_dir))
    return lost.select("doc_id", "provider", "reason")


def route_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.request_log(spark, sf_dir)
    return log.select("request_id", "path", chat.route(F.col("path")).alias("routed"))


def raw_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.rich_documents(spark, sf_dir)
    rows = docs.select(
        "doc_id", F.col("scope").alias("request_id"), F.lit("openai").alias("provider"),
        F.concat(F.lit('{"messages": '), "text").alias("body"),
    )
    done = chat.redact_bodies(rows, DEFAULT, SAMPLE_KEYS, only=("openai",))
    return done.select("doc_id", "redacted_body")


def custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format registered by the user."""
    side = chat.BodyFormat(("title", "notes.*.lines.*"))
    formats = {**chat.FORMATS, "notes": chat.ChatFormat(side, side)}
    line = F.struct(F.array("text", F.lit(""), "scope").alias("lines"))
    body = F.to_json(F.struct(F.array(line, line).alias("notes"), F.col("scope").alias("title")))
    rows = tables.rich_documents(spark, sf_dir).select("doc_id", body.alias("body"))
    rows = rows.withColumn("fields", chat.extract_text(F.col("body"), "notes", formats=formats))
    return chat.explode_fields(rows, "doc_id")


def _known_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = chat.split_known(_mixed_chats(spark, sf_dir))
    return known


def _replies(asked: DataFrame) -> DataFrame:
    """Each provider answers with what it was sent, and with an address of its own."""
    fresh = F.expr("' reply to fresh' || cast(doc_id as string) || '@new.example.org'")
    said = F.array_join(F.transform(F.filter("fields", lambda f: F.length(f["text"]) > 40), lambda f: f["text"]), " ")
    rows = asked.withColumn("text", F.concat(said, fresh)).withColumn("scope", F.col("request_id"))
    body = chat.by_provider(F.col("provider"), lambda name: chat_body(name, "response"))
    return rows.select("doc_id", "request_id", "provider", body.alias("body"))


def _answered(requests_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Redacted requests as sent, and the screened, restored responses to them.

    The redacted requests are written once: vault, responses and audit all read them.
    """
    sent = materialise(chat.redact_bodies(requests_, DEFAULT, SAMPLE_KEYS).drop("body"), "sent")
    vault = materialise(redact.build_vault(sent, "request_id", SAMPLE_KEYS), "vault")
    asked = chat.extract_fields(
        sent.select("doc_id", "request_id", "provider", F.col("redacted_body").alias("body"))
    )
    screened = restore.screen_bodies(_replies(asked), ["doc_id"], DEFAULT, vault, SAMPLE_KEYS)
    return sent, screened


def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies: new values hidden, the request's own restored, the rest as it was."""
    _, screened = _answered(_known_chats(spark, sf_dir))
    return screened.select(
        "doc_id", "response", F.size("response_spans").cast("bigint").alias("new_values")
    )


def request_to_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow: guard, extract, redact, rebuild, respond, restore, audit."""
    guarded = guards.flag_injection(_known_chats(spark, sf_dir), "body", "flag")
    sent, screened = _answered(guarded.drop("pattern_id", "matched"))
    entries = audit.audit_entries(sent)
    answers = screened.select(
        "request_id", "response", F.size("response_spans").cast("bigint").alias("new_values")
    )
    actions = sent.select("request_id", "action")
    return _audit_view(entries).join(answers, "request_id").join(actions, "request_id")


# --- request metadata ---------------------------------------------------------


def _with_headers(log: DataFrame) -> DataFrame:
    pairs = (("X-User-Email", F.col("caller_mail")), ("x-forwarded-for", F.col("remote_addr")),
             ("Referer", F.col("caller_mail")))
    headers = F.create_map(*[c for k, v in pairs for c in (F.lit(k), v)])
    return log.select("request_id", headers.alias("headers"))


def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_headers(tables.request_log(spark, sf_dir))
    done = requests.redact_headers(rows, default_config(threshold=0.0), SAMPLE_KEYS)
    h = F.col("redacted_headers")
    return done.select(
        "request_id", h["X-User-Email"].alias("mail"), h["x-forwarded-for"].alias("forwarded"),
        h["Referer"].alias("referer"),
    )


def header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_headers(tables.request_log(spark, sf_dir))
    return requests.header_spans(rows, EVERYTHING, "request_id").select(
        "request_id", "header", "type", "value"
    )


def url_query_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages", "page_id", "url").withColumn(
        "url", F.expr(PAGE_URL)
    ).withColumn("scope", F.expr("cast(page_id as string)"))
    done = requests.redact_query(pages, "url", "scope", DEFAULT, SAMPLE_KEYS)
    return done.select("page_id", "redacted_url")


# Every third page gets a value in its query; the others must come back as they are.
PAGE_URL = (
    "regexp_extract(url, '^([^#]*)', 1)"
    " || case when url like '%?%' then '&' else '?' end"
    " || case when page_id % 3 = 0 then 'mail=user' || cast(page_id as string)"
    " || '%40corp.test&b=x+y%2A~&b=%C3%A9' else 'zz=1&b=x+y%2A~' end"
    " || case when url like '%#%' then '#top' else '' end"
)


def correlation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.request_log(spark, sf_dir)
    given = F.when(F.col("event_id") % 2 == 0, F.col("request_id")).otherwise("")
    return log.select(
        "event_id", requests.correlation_id(given, F.col("event_id")).alias("correlation_id")
    )


# --- files --------------------------------------------------------------------


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.rich_documents(spark, sf_dir)
    kind, raw = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    suffix = F.when(kind == 0, ".txt").when(kind == 1, ".CSV").when(kind == 2, ".bin").otherwise(".png")
    content = F.when(kind == 2, F.encode(F.base64(raw), "UTF-8")).otherwise(raw)
    return docs.select(
        "doc_id", F.floor(F.col("doc_id") / 10).cast("bigint").alias("request_id"),
        F.concat(F.lit("f"), "scope", suffix).alias("path"), content.alias("content"),
    )


def file_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _uploads(spark, sf_dir)
    path, content = F.col("path"), F.col("content")
    return rows.select(
        "doc_id", "path", files.file_text(path, content).alias("text"),
        files.skipped_reason(path, content).alias("skipped_reason"),
    )


def file_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _uploads(spark, sf_dir)
    return rows.select(
        "doc_id", files.likely_base64(F.col("content")).alias("base64_like"),
        files.likely_text(F.col("content")).alias("text_like"),
    )


def upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = files.scan_files(_uploads(spark, sf_dir), DEFAULT)
    totals = files.upload_totals(scanned)
    return totals.withColumn("pii_count", F.col("pii_count").cast("bigint"))


# --- guards -------------------------------------------------------------------


def _flagged(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    bodies = turns.select("conv_id", "turn", F.expr(tables.INJECTED_TEXT).alias("body"))
    return guards.flag_injection(bodies, "body", mode)


def prompt_injection_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, "flag").select(
        "conv_id", "turn", F.col("pattern_id").cast("bigint").alias("pattern_id"), "matched", "action"
    )


def prompt_injection_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.admitted(_flagged(spark, sf_dir, "Block")).select("conv_id", "turn")


def injection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.injections_by_action(_flagged(spark, sf_dir, "block"))


def private_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.request_log(spark, sf_dir)
    return log.select(
        "request_id", "remote_addr", guards.is_private_ip(F.col("remote_addr")).alias("private")
    )


def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers' addresses by the longest range of a table with a range per customer."""
    own = tables.table(spark, sf_dir, "customer", "c_custkey").select(
        F.expr("'10.' || (c_custkey % 256) || '.' || (c_custkey div 256 % 256) || '.0/24'").alias("cidr"),
        F.expr("'customer ' || c_custkey").alias("label"),
    )
    wide = tables.table(spark, sf_dir, "nation", "n_nationkey").select(
        F.expr("'10.' || (n_nationkey * 8) || '.0.0/13'").alias("cidr"),
        F.expr("'nation ' || n_nationkey").alias("label"),
    )
    rest = spark.createDataFrame([("172.16.0.0/12", "inner"), ("192.168.0.0/16", "home"), ("fd00::/8", "local")], "cidr string, label string")
    log = tables.request_log(spark, sf_dir).select("request_id", "remote_addr")
    return guards.label_by_range(log, "remote_addr", own.unionByName(wide).unionByName(rest), out="network")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages", "page_id", "url")
    return pages.select("page_id", "url", guards.host_of(F.col("url")).alias("host"))


def domain_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hosts(spark, sf_dir)
    return rows.select(
        "page_id", "host", guards.domain_allowed(F.col("host"), ALLOWED_DOMAINS).alias("allowed")
    )


def domain_allow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = readers.term_frame(spark, ALLOWED_DOMAINS)
    return guards.allowed_by_table(_hosts(spark, sf_dir), "host", domains, "term").select("page_id")


def base_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).select("page_id", guards.base_domain(F.col("url")).alias("domain"))


def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return docs.select("doc_id", guards.within_size(F.col("text"), 2000).alias("within"))


def _keyed_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = tables.request_log(spark, sf_dir)
    scheme = F.when(F.col("event_id") % 7 == 0, "Basic ").otherwise("Bearer ")
    rows = log.select("request_id", F.concat(scheme, F.lit("key-"), "user_id").alias("authorization"))
    customers = tables.table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    hashes = customers.filter("c_acctbal > 0").select(
        F.sha2(F.expr("'key-' || cast(c_custkey as string)"), 256).alias("key_hash")
    )
    return rows, hashes


def key_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hashes = _keyed_requests(spark, sf_dir)
    return guards.admit_keys(rows, "authorization", hashes).select("request_id")


def key_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hashes = _keyed_requests(spark, sf_dir)
    return guards.reject_keys(rows, "authorization", hashes).select("request_id", "authorization")


# --- audit, metrics, rates ----------------------------------------------------


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = chat.split_known(_mixed_chats(spark, sf_dir))
    return audit.audit_entries(chat.redact_bodies(known, DEFAULT, SAMPLE_KEYS))


def _audit_view(entries: DataFrame) -> DataFrame:
    return entries.select(
        "request_id",
        F.unix_seconds("timestamp").alias("at"),
        "user_id", "provider",
        F.col("pii_detected").cast("bigint").alias("pii_detected"),
        F.array_join("pii_types", ",").alias("pii_types"),
        "request_redacted",
        F.col("status_code").cast("bigint").alias("status_code"),
        "latency_ms",
    )


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit_view(_audit(spark, sf_dir))


def audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "audit")
    sinks.append_audit(_audit(spark, sf_dir), path)
    return _audit_view(spark.read.schema(audit.AUDIT_SCHEMA).json(path))


def requests_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.request_log(spark, sf_dir)
    return metrics.requests_by(log).withColumn("status_code", F.col("status_code").cast("bigint"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_histogram(tables.request_log(spark, sf_dir))


def _open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that stay open for a second per millisecond of latency, so that they overlap."""
    log = tables.request_log(spark, sf_dir)
    return log.select(
        "event_id", "ts", F.timestamp_add("SECOND", "latency_ms", "ts").alias("done")
    )


def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.peak_concurrency(_open_requests(spark, sf_dir), "ts", "done", "event_id")


def over_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.over_concurrency(_open_requests(spark, sf_dir), "ts", "done", "event_id", cap=3)
    return rows.select("event_id", "active")


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.request_log(spark, sf_dir).withColumn("failed", F.col("status_code") >= 500)
    runs = rates.failure_runs(log, "provider", "ts", "event_id", "failed", at_least=2)
    return runs.select(
        "provider", F.unix_micros("run_start").alias("run_start"),
        F.unix_micros("run_end").alias("run_end"), "failures",
    )


def _fast_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with time running 100,000 times faster, so that limits bite."""
    events = tables.table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    micros = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000)
    return events.withColumn("ts", F.timestamp_micros(micros.cast("bigint")))


def over_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.over_rate(_fast_log(spark, sf_dir), "user_id", "ts", "event_id", limit=2, seconds=3)
    return rows.select("user_id", "event_id", "recent", "over")


def over_rate_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few callers with many events each."""
    rows = rates.over_rate(_fast_log(spark, sf_dir), "event_type", "ts", "event_id", limit=50)
    return rows.select("event_type", "event_id", "recent", "over")


# --- chunked text -------------------------------------------------------------

CHUNK_CHARS = 100


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.rich_documents(spark, sf_dir)
    return docs.select(
        "doc_id", F.posexplode(chunks.split_chunks(F.col("text"), CHUNK_CHARS)).alias("seq", "chunk")
    ).withColumn("seq", F.col("seq").cast("bigint"))


def chunk_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_tails(_chunks(spark, sf_dir), "doc_id", "seq", "chunk")


def _placed_spans(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    units = chunks.redact_chunks(rows, "doc_id", "seq", "chunk", DEFAULT, SAMPLE_KEYS)
    return chunks.stream_spans(units, "doc_id")


def stream_redact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed_spans(spark, sf_dir, _chunks(spark, sf_dir))
    return rows.select(
        "doc_id", "type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "token"
    )


def spans_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir)
    met = chunks.spans_by_chunk(
        _placed_spans(spark, sf_dir, rows), rows, "doc_id", "seq", "chunk"
    )
    return met.select(
        "doc_id", "seq", "type", F.col("chunk_start").cast("bigint").alias("chunk_start"),
        F.col("chunk_end").cast("bigint").alias("chunk_end"),
    )


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as event-stream text, read back and taken apart."""
    docs = tables.rich_documents(spark, sf_dir)
    lines = F.concat(
        F.array(F.concat(F.lit("id: "), "scope"), F.lit("event: message")),
        F.transform(F.split("text", r"[\r\n]+"), lambda t: F.concat(F.lit("data: "), t)),
    )
    path = shared_dir(spark, "sse")
    docs.select(F.explode(lines).alias("value")).write.text(path)
    return readers.read_sse(spark, path).select("is_data", "data", "value")


def body_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies written as JSON lines and read back; rows without one are set aside."""
    path = shared_dir(spark, "bodies")
    rows = _mixed_chats(spark, sf_dir)
    empty_ = F.when(F.col("doc_id") % 7 != 0, F.col("body"))
    rows.select("request_id", "provider", empty_.alias("body")).write.json(path)
    good, lost = readers.reject_unreadable(readers.read_bodies(spark, path))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(lost)


def file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one file each and read as bytes."""
    path = shared_dir(spark, "files")
    docs = tables.rich_documents(spark, sf_dir)
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    sinks.write_files(docs.select("doc_id", flat.alias("value")), path, "doc_id", "value")
    rows = readers.read_files(spark, path, glob="*.txt")
    doc_id = F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint")
    text = F.regexp_replace(files.file_text(F.col("path"), F.col("content")), r"\n\z", "")
    return rows.select(doc_id.alias("doc_id"), text.alias("text"), F.col("length").alias("bytes"))


def redacted_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns on the keep-list reach the sink."""
    path = shared_dir(spark, "redacted-sink")
    sinks.write_redacted(_redacted(spark, sf_dir), path, keep=["doc_id", "redacted"])
    return spark.read.parquet(path)


def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice: a counter table is replaced, not added to."""
    path = shared_dir(spark, "metrics")
    for _ in range(2):
        sinks.write_metrics(detections_by_type(spark, sf_dir), path)
    return spark.read.parquet(path)


def metrics_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latency histogram added up over micro-batches of the event files.

    Every batch comes twice, and once more after its compaction.
    """
    files = len(tables.table(spark, sf_dir, "events").inputFiles())
    events = tables.table_stream(
        spark, sf_dir, "events", tables.EVENT_SCHEMA, files=-(-files // MICRO_BATCHES)
    )
    table = sinks.CounterTable(
        shared_dir(spark, "counters"),
        "method string, path string, n bigint, sum_ms bigint, le double, cumulative bigint",
        ("n", "sum_ms", "cumulative"),
    )

    def write(batch: DataFrame, epoch: int) -> None:
        counts = metrics.latency_histogram(batch)
        table.add(counts, epoch)
        table.add(counts, epoch)
        table.compact(spark, epoch)
        table.add(counts, epoch)

    writer = tables.requests_of(events).writeStream.foreachBatch(write).trigger(availableNow=True)
    _finish(writer.option("checkpointLocation", table.path + "-checkpoint").start())
    return table.read(spark)


def oversize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts are told, and scanned like all others."""
    cfg = dataclasses.replace(DEFAULT, watched_chars=5000)
    docs = tables.rich_documents(spark, sf_dir)
    scanned = detect.scan(docs, "text", cfg)
    return scanned.select(
        "doc_id", detect.oversize(F.col("text"), cfg).alias("oversize"),
        F.size("spans").cast("bigint").alias("found"),
    )


def dense_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values one after another without white space."""
    docs = tables.documents(spark, sf_dir)
    packed = F.expr(f"repeat('/u' || cast(doc_id as string) || '@dense.example', {DENSE})")
    spans = detect.scan(docs.select("doc_id", packed.alias("text")), "text", DEFAULT)
    return spans.select(
        "doc_id", F.size("spans").cast("bigint").alias("found"),
        F.element_at("spans", -1)["end"].cast("bigint").alias("last_end"),
    )


DENSE = 400


def adversarial_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long run of letters before each page: the worst case for the e-mail pattern."""
    pages = tables.table(spark, sf_dir, "pages", "page_id", "url")
    run = F.concat(F.lit("@"), F.repeat(F.lit("a"), F.lit(60_000)), F.lit(" x"), "page_id", F.lit("@long.example"))
    spans = detect.scan(pages.select("page_id", run.alias("text")), "text", DEFAULT)
    return spans.select("page_id", F.transform("spans", lambda s: s["value"])[0].alias("value"))


def unstated_glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that says nothing about white space, over texts of all lengths."""
    cfg = ScanConfig(detectors=(detect.PatternDetector((Pattern("pair", "pair", 0.9, r"\bthe [a-z]+ing\b"),)),))
    rows = _span_rows(detect.scan(tables.documents(spark, sf_dir), "text", cfg), "doc_id")
    return rows.select("doc_id", "span_start", "span_end", "value")


def private_ip_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.request_log(spark, sf_dir)
    ip = F.expr(
        "case event_id % 6 when 0 then '::1' when 1 then 'fd00::' || cast(event_id % 1000 as string)"
        " when 2 then '2001:db8:0:1::' || cast(event_id % 1000 as string)"
        " when 3 then '::ffff:10.0.' || cast(event_id % 256 as string) || '.1'"
        " when 4 then '::ffff:8.8.' || cast(event_id % 256 as string) || '.1' else 'fe80::1' end"
    )
    return log.select("request_id", ip.alias("ip"), guards.is_private_ip(ip).alias("private"))


def sse_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams, many to a file: data lines redacted, all lines in place."""
    docs = tables.rich_documents(spark, sf_dir)
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    event = F.concat(F.lit("id: "), "scope", F.lit("\n: ping\ndata: "), flat, F.lit("\n"))
    path = shared_dir(spark, "sse-streams")
    docs.select(event.alias("value")).filter("value is not null").write.text(path)
    lines = readers.read_sse_streams(spark, path, header="id: ")
    lines = lines.withColumn("scope", F.expr("substring(header, 5)"))
    done = redact.redact(lines, "data", "scope", DEFAULT, SAMPLE_KEYS, out="redacted")
    line = F.when(F.col("is_data"), F.concat(F.lit("data: "), "redacted")).otherwise(F.col("value"))
    return done.select(F.col("scope").cast("bigint").alias("doc_id"), "seq", line.alias("line"))


# --- streams ------------------------------------------------------------------


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = tables.table_stream(spark, sf_dir, "documents", tables.DOCUMENT_SCHEMA)
    return stream.select(
        "doc_id", F.expr(tables.RICH_TEXT).alias("text"),
        F.expr("cast(doc_id as string)").alias("scope"),
    )


MICRO_BATCHES = 4
ROWS_PER_FILE = 100_000  # chunks on average; a stream's chunks of a batch are in one file


def _delivered(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows with a column ``batch`` as a stream of that many micro-batches, in that order."""
    dealt = materialise(rows, "arriving")
    plain = dealt.drop("batch")
    path = shared_dir(spark, "chunk-stream")
    files = max(1, -(-dealt.count() // (MICRO_BATCHES * ROWS_PER_FILE)))
    for batch in range(MICRO_BATCHES):  # in order of time
        part = dealt.filter(F.col("batch") == batch).drop("batch").repartition(files, key)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", files).parquet(path)


def _arriving(spark: SparkSession, texts: DataFrame, stream: str, text: str) -> DataFrame:
    """Texts as a chunk stream in several micro-batches, every text spread over all of them.

    Chunks are short, so values lie across chunks and across batches.
    """
    rows = stream_chunks.numbered_chunks(texts, stream, text, CHUNK_CHARS)
    last = F.max(F.col("seq")).over(Window.partitionBy("stream_id"))
    batch = F.floor(F.col("seq") * MICRO_BATCHES / (last + 1))
    return _delivered(spark, rows.withColumn("batch", batch), "stream_id")


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' chunks in any order over micro-batches; every seventh comes twice."""
    texts = tables.rich_documents(spark, sf_dir)
    rows = stream_chunks.numbered_chunks(texts, "scope", "text", CHUNK_CHARS)
    place = F.xxhash64("stream_id", "seq")
    batch = lambda n: F.pmod(place + n, F.lit(MICRO_BATCHES))
    again = rows.filter("(cast(stream_id as bigint) + seq) % 7 = 0").withColumn("batch", batch(1))
    return _delivered(spark, rows.withColumn("batch", batch(0)).unionByName(again), "stream_id")


def _to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, into a file sink, and read the sink."""
    path = shared_dir(spark, name)
    _finish(
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True).start()
    )
    return spark.read.schema(stream.schema).parquet(path)


def _run_batches(spark: SparkSession, name: str, make) -> str:
    """Run a ``foreachBatch`` stream whose batches append to one table.

    Each batch writes its own folder, so a repeated batch replaces itself.
    """
    path = shared_dir(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = make(write)
    _finish(
        writer.option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    )
    return path


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _arriving(spark, tables.rich_documents(spark, sf_dir), "scope", "text")
    units = stream_chunks.redact_stream(stream, DEFAULT, SAMPLE_KEYS)
    rows = chunks.stream_spans(_to_table(spark, units, "stream-redact"), "stream_id")
    return rows.select(
        "stream_id", "type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "token"
    )


def stream_redact_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stream_redact``, from chunks that come out of order and twice."""
    units = stream_chunks.redact_stream(
        _shuffled(spark, sf_dir), DEFAULT, SAMPLE_KEYS, keep_ends=True
    )
    rows = chunks.stream_spans(_to_table(spark, units, "stream-shuffled"), "stream_id")
    return rows.select(
        "stream_id", "type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "token"
    )


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that a stream refused, told from its text."""
    rows = stream_chunks.redact_stream_with_rejects(
        _shuffled(spark, sf_dir), DEFAULT, SAMPLE_KEYS, keep_ends=True
    )
    found = _to_table(spark, rows.select("stream_id", "seq", "reason"), "stream-rejects")
    return found.filter("reason is not null")


def stream_late_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents leave restored though the vault's rows come in later batches than their tokens."""
    done, vault = _stored(spark, sf_dir)
    texts = _arriving(spark, done.select("scope", "redacted"), "scope", "redacted")
    entries = vault.select("scope_id", "token", "ciphertext").withColumn(
        "batch", 1 + F.pmod(F.xxhash64("token"), F.lit(MICRO_BATCHES - 1))
    )
    late = _delivered(spark, entries, "scope_id")
    restored = stream_chunks.rehydrate_with_vault_stream(texts, late, SAMPLE_KEYS)
    rows = _to_table(spark, restored, "stream-late-vault")
    whole = rows.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "restored"))).alias("u"), F.every("complete").alias("complete")
    )
    return whole.select("stream_id", F.array_join("u.restored", "").alias("restored"), "complete")


def stream_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents arrive in chunks and leave restored."""
    done, vault = _stored(spark, sf_dir)
    stream = _arriving(spark, done.select("scope", "redacted"), "scope", "redacted")
    out = _run_batches(
        spark, "restored",
        lambda write: stream_chunks.rehydrate_stream(stream, lambda: vault, SAMPLE_KEYS, write),
    )
    rows = spark.read.parquet(out)
    whole = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("at", "restored"))).alias("u"))
    return whole.select("stream_id", F.array_join("u.restored", "").alias("restored"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _arriving(spark, tables.rich_documents(spark, sf_dir), "scope", "text")
    windows = _to_table(spark, stream_chunks.overlap_windows(stream), "stream-windows")
    return windows.select(
        "stream_id", "seq", "window", F.col("overlap").cast("bigint").alias("overlap")
    )


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table_stream(spark, sf_dir, "events", tables.EVENT_SCHEMA)
    log = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = counters.running_counts(log, "ts", ["event_type"], width="1 day")
    out = _run_batches(
        spark, "counters",
        lambda write: counts.writeStream.outputMode("update").foreachBatch(write),
    )
    latest = spark.read.parquet(out).groupBy("window_start", "event_type").agg(
        F.max_by("requests", "epoch").alias("requests")
    )
    return latest.select(F.unix_seconds("window_start").alias("day_start"), "event_type", "requests")


def stream_over_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and days with more requests than allowed, as a stream sees them."""
    events = tables.table_stream(spark, sf_dir, "events", tables.EVENT_SCHEMA)
    log = events.select(
        F.expr("cast(user_id as string)").alias("caller"), F.col("ts").cast("timestamp").alias("ts")
    )
    counts = counters.running_counts(log, "ts", ["caller"], width="1 day")
    out = _run_batches(
        spark, "rates", lambda write: counts.writeStream.outputMode("update").foreachBatch(write)
    )
    latest = spark.read.parquet(out).groupBy("window_start", "caller").agg(
        F.max_by("requests", "epoch").alias("requests")
    )
    return latest.filter("requests > 1").select(
        F.unix_seconds("window_start").alias("day_start"), "caller", "requests"
    )


def term_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running scan picks up the term list as it stands at each micro-batch."""
    path = shared_dir(spark, "terms")
    terms.create_list(spark, path, ["obsolete"])
    terms.clear_terms(spark, path)
    terms.add_terms(spark, path, ["CONFIDENTIAL"])
    terms.add_terms(spark, path, ["Top Secret"])
    base = ScanConfig(detectors=(detect.PatternDetector(),))
    out = _run_batches(
        spark, "live-terms",
        lambda write: counters.scan_with_live_terms(
            _document_stream(spark, sf_dir), spark, path, "doc_id", "text", base, write
        ),
    )
    rows = spark.read.parquet(out)
    return rows.select(
        "doc_id", "type", F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"), "value",
    )


def term_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in force after a log of additions and clearings, taken from the orders."""
    orders = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    log = orders.select(
        F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "P", "clear").otherwise("add").alias("action"),
        F.expr("'Customer ' || cast(o_custkey as string)").alias("term"),
    )
    return terms.current_terms(log)


# --- registry -----------------------------------------------------------------


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"scan_{p.name}": scan_one(p.name) for p in PATTERNS}
    for provider in ("openai", "anthropic", "gemini", "azure"):
        for direction in ("request", "response"):
            out[f"chat_extract_{provider}_{direction}"] = chat_extract(provider, direction)
            out[f"chat_replace_{provider}_{direction}"] = chat_replace(provider, direction)
    plain: Iterable[Query] = (
        blocklist_scan, term_table_scan, scan_pages, byte_offsets, merged_spans, resolve_overlaps,
        threshold_filter, confidence_filter, allowlist_filter, allowlist_table, custom_detector,
        detections_by_type, detections_by_type_rich, detections_per_request, types_found,
        redact_text, redacted_spans, leak_check, vault_lookup, vault_count, token_parse,
        verified_lookup, rehydrate_roundtrip, forged_token_rejected, response_scan, expire_scopes,
        vault_retention,
        chat_dispatch, dispatch_rejects, route_provider, raw_fallback, custom_format,
        header_scan, header_spans, url_query_scan, correlation_id,
        file_text_extract, file_sniff, upload_totals,
        prompt_injection_flag, prompt_injection_block, injection_counts, private_ip, address_ranges,
        domain_allow, domain_allow_table, base_domain, size_limit, key_admission, key_rejection,
        audit_entries, audit_sink, requests_by_status, latency_histogram, peak_concurrency,
        over_concurrency, failure_runs, over_rate, over_rate_busy,
        chunk_tail, stream_redact_batch, spans_by_chunk, sse_lines,
        stream_redact, stream_redact_shuffled, stream_rejects, stream_rehydrate, stream_late_vault, stream_windows, stream_counters, stream_over_rate,
        term_refresh, term_log,
        response_bodies, request_to_audit, body_source, file_source, redacted_sink, metrics_sink, metrics_merge,
        oversize_text, dense_text, adversarial_text, unstated_glue, private_ip_v6, sse_redact,
    )
    out.update({q.__name__: q for q in plain})
    return out
