"""The queries again, as SQL for an independent engine.

That engine matches with RE2, so the patterns are used as first written, not in
their JDK form.
"""

from __future__ import annotations

from veilframe.config import BLOCKED_TERMS, LATENCY_BUCKETS_SECONDS, SAFE_VALUES
from veilframe.functions.patterns import INJECTION_PATTERNS, PATTERNS
from veilframe.operators.files import TEXT_SUFFIXES
from veilframe.operators.guards import PRIVATE_V4
from veilframe.plans import queries as q
from veilframe.plans import tables as t


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RICH = f"SELECT doc_id, cast(doc_id AS varchar) AS scope, {t.RICH_TEXT} AS text FROM documents"

LUHN = (
    "(length(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND "
    "list_sum(list_transform(range(1, length(regexp_replace(h, '[^0-9]', '', 'g')) + 1), lambda i: "
    "(CASE WHEN (i - 1) % 2 = 0 "
    "THEN cast(reverse(regexp_replace(h, '[^0-9]', '', 'g'))[i] AS int) "
    "ELSE (cast(reverse(regexp_replace(h, '[^0-9]', '', 'g'))[i] AS int) * 2) // 10 "
    "+ (cast(reverse(regexp_replace(h, '[^0-9]', '', 'g'))[i] AS int) * 2) % 10 END))) % 10 = 0)"
)


def hits_sql(src: str, key: str, regex: str, extra: str = "") -> str:
    """Find-all with offsets: ``key, s, e, h`` plus the constants in ``extra``."""
    r = lit(regex)
    return f"""
SELECT {key}, s, s + length(h) AS e, h{extra} FROM (
  SELECT {key}, hits[i] AS h,
    cast(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
      + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS bigint) AS s
  FROM (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all(text, {r}) AS hits, string_split_regex(text, {r}) AS gaps
    FROM ({src}) WHERE regexp_matches(text, {r}))))"""


def _escape(term: str) -> str:
    return "(?i)" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def raw_sql(src: str, key: str, terms=BLOCKED_TERMS, patterns=PATTERNS, more=()) -> str:
    """All detectors: ``key, s, e, h, type, detector_name, confidence, rank``."""
    parts = []
    for rank, p in enumerate(patterns):
        extra = (f", {lit(p.type)} AS type, {lit(p.detector_name)} AS detector_name, "
                 f"cast({p.confidence} AS double) AS confidence, {rank} AS rank")
        sql = hits_sql(src, key, p.regex, extra)
        parts.append(f"SELECT * FROM ({sql}) WHERE {LUHN}" if p.luhn else sql)
    for rank, term in enumerate(terms, 50):
        extra = (", 'blocklist' AS type, 'blocklist' AS detector_name, "
                 f"cast(1.0 AS double) AS confidence, {rank} AS rank")
        parts.append(hits_sql(src, key, _escape(term), extra))
    parts += [hits_sql(src, key, regex, extra) for regex, extra in more]
    return "\nUNION ALL\n".join(parts)


def kept_sql(src: str, key: str, threshold: float = 0.8, allow=SAFE_VALUES, **kw) -> str:
    """Resolved, filtered spans: ``key, s, e, h, type, detector_name, confidence``."""
    safe = ", ".join(lit(a.lower()) for a in allow)
    allowed = f"AND lower(x.h) NOT IN ({safe})" if allow else ""
    return f"""
SELECT {key}, x.s AS s, x.e AS e, x.h AS h, x.type AS type,
  x.detector_name AS detector_name, x.confidence AS confidence
FROM (SELECT {key}, unnest(list_reduce(
    list({{'s': s, 'e': e, 'h': h, 'type': type, 'detector_name': detector_name,
          'confidence': confidence}} ORDER BY confidence DESC, rank, s),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x.e AND x.s < a.e)) > 0
      THEN acc ELSE list_append(acc, x) END, [])) AS x
  FROM ({raw_sql(src, key, **kw)}) GROUP BY {key})
WHERE x.confidence >= {threshold} {allowed}"""


def hmac_sql(message: str) -> str:
    padded = t.SAMPLE_KEYS.mac_key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()
    return (f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))")


def token_sql(scope: str, type_: str, value: str) -> str:
    scoped = f"cast(strlen({scope}) AS varchar) || ':' || {scope}"
    ident = f"substring({hmac_sql(f"'id:' || {scoped} || {type_} || ':' || {value}")}, 1, 16)"
    sig = f"substring({hmac_sql(f"'sig:' || {scoped} || {type_} || ':' || {ident}")}, 1, 16)"
    return f"('__PII_' || {type_} || '_' || {ident} || '_' || {sig} || '__')"


def tokens_sql(src: str, key: str, scope: str, **kw) -> str:
    """``kept_sql`` with the scope and each span's token."""
    return (f"SELECT k.*, {scope} AS scope_, {token_sql(scope, 'type', 'h')} AS token "
            f"FROM ({kept_sql(src, key, **kw)}) k")


def redacted_sql(src: str, key: str, scope: str, **kw) -> str:
    """``key, text, redacted`` for every row of ``src``; scope is an expression over key."""
    return f"""
SELECT s_.*, coalesce(r_.redacted, s_.text) AS redacted FROM ({src}) s_ LEFT JOIN (
  SELECT {key}, string_agg(piece, '' ORDER BY s) || substring(any_value(text), max(e) + 1) AS redacted
  FROM (
    SELECT k.*, d.text, substring(d.text, coalesce(lag(k.e) OVER w, 0) + 1,
        k.s - coalesce(lag(k.e) OVER w, 0)) || k.token AS piece
    FROM ({tokens_sql(src, key, scope, **kw)}) k JOIN ({src}) d USING ({key})
    WINDOW w AS (PARTITION BY {key} ORDER BY k.s))
  GROUP BY {key}) r_ USING ({key})"""


SCOPE = "cast(doc_id AS varchar)"
EVERYTHING = dict(threshold=0.0, allow=())
SPAN_COLUMNS = ("type, detector_name, cast(s AS bigint) AS span_start, "
                "cast(e AS bigint) AS span_end, h AS value, confidence")
TOKENS = tokens_sql(RICH, "doc_id", SCOPE)
REDACTED = redacted_sql(RICH, "doc_id", SCOPE)


def spans_view(**kw) -> str:
    return f"SELECT doc_id, {SPAN_COLUMNS} FROM ({kept_sql(RICH, 'doc_id', **kw)})"


def one_pattern(p) -> str:
    only = raw_sql(RICH, "doc_id", terms=(), patterns=(p,))
    return ("SELECT doc_id, cast(s AS bigint) AS span_start, cast(e AS bigint) AS span_end, "
            f"h AS value FROM ({only})")


def terms_view(terms) -> str:
    only = raw_sql(RICH, "doc_id", terms=terms, patterns=())
    return ("SELECT doc_id, cast(s AS bigint) AS span_start, cast(e AS bigint) AS span_end, "
            f"h AS value FROM ({only})")


# --- chat bodies: the texts come from JSON built and read here ----------------

INTRO = "'Be brief ' || scope"
BODY = {
    ("openai", "request"):
        f"{{'messages': [{{'role': 'system', 'content': {INTRO}}}, {{'role': 'user', 'content': text}}, "
        "{'role': 'assistant', 'content': ''}], 'model': 'm'}",
    ("openai", "response"):
        "{'choices': [{'message': {'role': 'assistant', 'content': text}, 'index': 0}], "
        f"'error': {{'message': {INTRO}, 'type': 't'}}}}",
    ("anthropic", "request"):
        "{'messages': [{'role': 'user', 'content': text}, {'role': 'assistant', 'content': ''}], "
        f"'model': 'm', 'system': {INTRO}}}",
    ("anthropic", "response"):
        f"{{'content': [{{'type': 'text', 'text': text}}], 'error': {{'type': 't', 'message': {INTRO}}}}}",
    ("gemini", "request"):
        f"{{'contents': [{{'role': 'user', 'parts': [{{'text': {INTRO}}}, {{'text': text}}]}}], "
        f"'systemInstruction': {{'parts': [{{'text': {INTRO}}}]}}}}",
    ("gemini", "response"):
        "{'candidates': [{'content': {'role': 'model', 'parts': [{'text': text}, {'text': ''}]}, 'index': 0}], "
        f"'error': {{'code': 7, 'message': {INTRO}}}}}",
}
PATHS = {
    ("openai", "request"): ["messages.{i}.content"],
    ("openai", "response"): ["choices.{i}.message.content", "error.message"],
    ("anthropic", "request"): ["system", "messages.{i}.content"],
    ("anthropic", "response"): ["content.{i}.text", "error.message"],
    ("gemini", "request"): ["systemInstruction.parts.{i}.text", "contents.0.parts.{i}.text"],
    ("gemini", "response"): ["candidates.0.content.parts.{i}.text", "error.message"],
}


def _json_path(path: str) -> str:
    """``a.0.b`` as a JSON path expression; ``{i}`` is the column i."""
    out = "'$'"
    for part in path.split("."):
        if part == "{i}":
            out += " || '[' || cast(i AS varchar) || ']'"
        elif part.isdigit():
            out += f" || '[{part}]'"
        else:
            out += f" || '.{part}'"
    return out


def fields_sql(provider: str, direction: str, src: str = RICH) -> str:
    shape = ("openai" if provider == "azure" else provider, direction)
    bodies = f"SELECT doc_id, cast(to_json({BODY[shape]}) AS json) AS body FROM ({src})"
    parts = []
    for path in PATHS[shape]:
        name = lit(path).replace("{i}", "' || cast(i AS varchar) || '")
        count = "3" if "{i}" in path else "1"
        parts.append(
            f"SELECT doc_id, {name} AS path, json_extract_string(body, {_json_path(path)}) AS text "
            f"FROM ({bodies}), range(0, {count}) r(i)"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE text <> ''"


def replaced_sql(provider: str, direction: str, where: str = "true") -> str:
    """The whole body, with the redacted text in the text's place."""
    shape = ("openai" if provider == "azure" else provider, direction)
    rows = f"SELECT * EXCLUDE (text, redacted), redacted AS text FROM ({REDACTED}) WHERE {where}"
    return f"SELECT doc_id, cast(to_json({BODY[shape]}) AS varchar) AS redacted_body FROM ({rows})"


MIXED = ("openai", "anthropic", "azure", "gemini")


def mixed_fields() -> str:
    parts = []
    for i, name in enumerate(MIXED):
        src = f"SELECT * FROM ({RICH}) WHERE doc_id % 5 = {i}"
        parts.append(
            f"SELECT doc_id, {lit(name)} AS provider, path, text FROM ({fields_sql(name, 'request', src)})"
        )
    return " UNION ALL ".join(parts)


def audit_sql() -> str:
    keyed = f"SELECT doc_id || '|' || path AS k, * FROM ({mixed_fields()})"
    spans = kept_sql(f"SELECT k, text FROM ({keyed})", "k")
    found = (f"SELECT cast(split_part(k, '|', 1) AS bigint) AS doc_id, count(*) AS n, "
             f"string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ({spans}) GROUP BY 1")
    bodies = " UNION ALL ".join(
        replaced_sql(name, "request", f"doc_id % 5 = {i}") for i, name in enumerate(MIXED)
    )
    return f"""
SELECT scope AS request_id, doc_id AS at, cast(doc_id % 100 AS varchar) AS user_id, redacted_body AS request_redacted,
  CASE doc_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'azure' ELSE 'gemini' END AS provider,
  coalesce(n, 0) AS pii_detected, coalesce(types, '') AS pii_types,
  cast(200 AS bigint) AS status_code, cast(strlen(text) AS bigint) AS latency_ms
FROM ({RICH}) d JOIN ({bodies}) b USING (doc_id) LEFT JOIN ({found}) f USING (doc_id)"""


def answers_sql() -> str:
    """Responses: the request's text restored, and the provider's own address hidden."""
    fresh = "'fresh' || cast(doc_id AS varchar) || '@new.example.org'"
    parts = []
    for i, name in enumerate(MIXED):
        shape = ("openai" if name == "azure" else name, "response")
        said = f"text || ' reply to ' || {token_sql('scope', lit('email'), fresh)}"
        rows = f"SELECT doc_id, scope, {said} AS text FROM ({RICH}) WHERE doc_id % 5 = {i}"
        parts.append(
            f"SELECT doc_id, scope AS request_id, cast(to_json({BODY[shape]}) AS varchar) AS response, "
            f"cast(1 AS bigint) AS new_values FROM ({rows})"
        )
    return " UNION ALL ".join(parts)


def sent_sql() -> str:
    """Request bodies of all providers as they are, unknown ones as plain text."""
    parts = [
        f"SELECT doc_id, {lit(name)} AS provider, cast(to_json({BODY[('openai' if name == 'azure' else name, 'request')]}) "
        f"AS varchar) AS body FROM ({RICH}) WHERE doc_id % 5 = {i}"
        for i, name in enumerate(MIXED)
    ]
    parts.append(f"SELECT doc_id, 'other' AS provider, text AS body FROM ({RICH}) WHERE doc_id % 5 = 4")
    return " UNION ALL ".join(parts)


_PAIR = r"\bthe [a-z]+ing\b"
PAIRS = f"""
SELECT doc_id, cast(sum(length(piece)) OVER w - length(h) AS bigint) AS span_start,
  cast(sum(length(piece)) OVER w AS bigint) AS span_end, h AS value FROM (
  SELECT doc_id, n, h, string_split(cut, chr(1))[n] || h AS piece FROM (
    SELECT doc_id, regexp_replace(text, '{_PAIR}', chr(1), 'g') AS cut,
      unnest(regexp_extract_all(text, '{_PAIR}')) AS h,
      unnest(range(1, len(regexp_extract_all(text, '{_PAIR}')) + 1)) AS n FROM documents))
WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)"""

FLAT = f"SELECT doc_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM ({RICH})"

# --- request log --------------------------------------------------------------

LOG = (f"SELECT event_id, ts, {t.REQUEST_ID} AS request_id, cast(user_id AS varchar) AS user_id, "
       f"'POST' AS method, {t.REQUEST_PATH} AS path, {t.REQUEST_PROVIDER} AS provider, "
       f"{t.REQUEST_STATUS} AS status_code, {t.REQUEST_LATENCY} AS latency_ms, "
       f"{t.REMOTE_ADDR} AS remote_addr, {t.CALLER_MAIL} AS caller_mail FROM events")

HEADERS = (f"SELECT request_id || '|' || header AS k, request_id, header, text FROM ("
           f"SELECT request_id, 'X-User-Email' AS header, caller_mail AS text FROM ({LOG}) UNION ALL "
           f"SELECT request_id, 'x-forwarded-for', remote_addr FROM ({LOG}))")


def header_sql() -> str:
    red = redacted_sql(HEADERS, "k", "split_part(k, '|', 1)", threshold=0.0)
    return (f"SELECT request_id, max(CASE WHEN header = 'X-User-Email' THEN redacted END) AS mail, "
            f"max(CASE WHEN header <> 'X-User-Email' THEN redacted END) AS forwarded, "
            f"any_value(caller_mail) AS referer "
            f"FROM ({red}) JOIN (SELECT request_id, caller_mail FROM ({LOG})) USING (request_id) GROUP BY request_id")


def header_spans_sql() -> str:
    return (f"SELECT split_part(k, '|', 1) AS request_id, split_part(k, '|', 2) AS header, type, h AS value "
            f"FROM ({kept_sql(HEADERS, 'k', **EVERYTHING)})")


def url_query_sql() -> str:
    urls = f"SELECT page_id, {q.PAGE_URL} AS url FROM pages"
    pairs = f"""
SELECT page_id, i, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS k,
  url_decode(replace(substring(p, length(split_part(p, '=', 1)) + 2), '+', ' ')) AS v
FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p,
  generate_subscripts(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), 1) AS i FROM ({urls}))"""
    keyed = f"SELECT page_id || '|' || i AS kk, page_id, i, k, v AS text FROM ({pairs})"
    red = redacted_sql(keyed, "kk", "split_part(kk, '|', 1)")
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    joined = (f"SELECT page_id, string_agg({enc('k')} || '=' || {enc('redacted')}, '&' ORDER BY k, i) AS qs, "
              f"bool_or(redacted <> text) AS touched FROM ({red}) GROUP BY page_id")
    return f"""
SELECT page_id, CASE WHEN touched THEN regexp_extract(url, '^([^?#]*)', 1) || '?' || qs
  || regexp_extract(url, '(#.*)?$', 1) ELSE url END AS redacted_url
FROM ({urls}) JOIN ({joined}) USING (page_id)"""


def _v4_between() -> str:
    n = ("(cast(split_part(remote_addr, '.', 1) AS bigint) * 16777216 + "
         "cast(split_part(remote_addr, '.', 2) AS bigint) * 65536 + "
         "cast(split_part(remote_addr, '.', 3) AS bigint) * 256 + "
         "cast(split_part(remote_addr, '.', 4) AS bigint))")
    tests = []
    for cidr in PRIVATE_V4:
        base, bits = cidr.split("/")
        a, b, c, d = (int(x) for x in base.split("."))
        start = ((a * 256 + b) * 256 + c) * 256 + d
        tests.append(f"{n} BETWEEN {start} AND {start + 2 ** (32 - int(bits)) - 1}")
    return " OR ".join(tests)


INJECTED = f"SELECT conv_id, turn, {t.INJECTED_TEXT} AS body FROM conversations"


def injection_sql() -> str:
    ids = " ".join(f"WHEN regexp_matches(body, {lit(p)}) THEN {i}" for i, p in enumerate(INJECTION_PATTERNS, 1))
    texts = " ".join(f"WHEN {i} THEN regexp_extract(body, {lit(p)})" for i, p in enumerate(INJECTION_PATTERNS, 1))
    return (f"SELECT conv_id, turn, cast(pid AS bigint) AS pattern_id, CASE pid {texts} END AS matched "
            f"FROM (SELECT *, CASE {ids} END AS pid FROM ({INJECTED}))")


HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
ALLOWED = " OR ".join(
    f"lower(host) = {lit(d.lower())} OR suffix(host, {lit('.' + d)})" for d in q.ALLOWED_DOMAINS
)
HOSTS = f"SELECT page_id, url, {HOST} AS host FROM pages"

KEYED = (f"SELECT request_id, CASE WHEN event_id % 7 = 0 THEN 'Basic ' ELSE 'Bearer ' END || 'key-' || user_id "
         f"AS \"authorization\" FROM ({LOG})")
LISTED = ("\"authorization\" LIKE 'Bearer %' AND substring(\"authorization\", 8) IN "
          "(SELECT 'key-' || cast(c_custkey AS varchar) FROM customer WHERE c_acctbal > 0)")

UPLOADS = f"""
SELECT doc_id, doc_id // 10 AS request_id, text,
  'f' || scope || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.CSV' WHEN 2 THEN '.bin' ELSE '.png' END AS path,
  CASE WHEN doc_id % 4 = 2 THEN to_base64(encode(text)) ELSE text END AS content FROM ({RICH})"""


def _printable(text: str) -> str:
    """Whether more than 85 % of the bytes are printable ASCII."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    good = f"list_filter({pairs}, lambda h: (h BETWEEN '20' AND '7E') OR h IN ('09', '0A', '0D'))"
    return f"(len({pairs}) > 0 AND cast(len({good}) AS double) / len({pairs}) > 0.85)"


_B64 = "(strlen(content) >= 20 AND regexp_full_match(content, '[A-Za-z0-9+/=\\n\\r]*'))"


def file_text_sql() -> str:
    ends = " OR ".join(f"suffix(lower(path), {lit(s)})" for s in TEXT_SUFFIXES)
    return (f"SELECT doc_id, path, CASE WHEN {ends} THEN content "
            f"WHEN doc_id % 4 = 2 AND {_B64} AND {_printable('text')} THEN text END AS text, "
            f"CASE WHEN {ends} THEN NULL WHEN doc_id % 4 = 2 AND {_B64} THEN CASE WHEN {_printable('text')} "
            f"THEN NULL ELSE 'not text inside base64' END ELSE 'not text' END AS skipped_reason FROM ({UPLOADS})")


OPEN = f"SELECT event_id, ts, ts + to_seconds(latency_ms) AS done FROM ({LOG})"
ACTIVE = f"""
SELECT event_id, delta, sum(delta) OVER (ORDER BY ts, delta, event_id ROWS UNBOUNDED PRECEDING) AS active
FROM (SELECT event_id, ts, 1 AS delta FROM ({OPEN}) UNION ALL SELECT event_id, done, -1 FROM ({OPEN}))"""

FAILURES = f"""
SELECT provider, epoch_us(min(ts)) AS run_start, epoch_us(max(ts)) AS run_end, count(*) AS failures
FROM (SELECT provider, ts, status_code, sum(CASE WHEN status_code >= 500 THEN 0 ELSE 1 END)
  OVER (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM ({LOG}))
WHERE status_code >= 500 GROUP BY provider, g HAVING count(*) >= 2"""


def latency_sql() -> str:
    rows = [f"SELECT method, path, count(*) AS n, sum(latency_ms) AS sum_ms, cast({b} AS double) AS le, "
            f"count(*) FILTER (latency_ms <= {b} * 1000) AS cumulative FROM ({LOG}) GROUP BY ALL"
            for b in LATENCY_BUCKETS_SECONDS]
    rows.append(f"SELECT method, path, count(*) AS n, sum(latency_ms) AS sum_ms, cast('inf' AS double) AS le, "
                f"count(*) AS cumulative FROM ({LOG}) GROUP BY ALL")
    union = " UNION ALL ".join(rows)
    return (f"SELECT method, path, n, cast(sum_ms AS bigint) AS sum_ms, le, cumulative FROM ({union})")


def rate_sql(key: str, limit: int, seconds: int) -> str:
    """How many events a caller has in the last seconds, itself included."""
    return f"""
SELECT {key}, event_id, recent, recent > {limit} AS "over" FROM (
  SELECT {key}, event_id, count(*) OVER (PARTITION BY {key} ORDER BY epoch_us(ts) // 100000
    RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS recent FROM events)"""


CHUNKED = f"""
SELECT doc_id, unnest(range(0, cast(ceil(length(text) / {q.CHUNK_CHARS}) AS bigint))) AS seq, text FROM ({RICH})"""

PLACED = f"""
SELECT doc_id, type, cast(s AS bigint) AS span_start, cast(e AS bigint) AS span_end, token FROM ({TOKENS})"""


def oracle_queries() -> dict[str, str]:
    doc_span = "SELECT doc_id, cast(s AS bigint) AS span_start, cast(e AS bigint) AS span_end, h AS value"
    hex40 = (r"\b[0-9a-f]{40}\b",
             ", 'hex' AS type, 'hex40' AS detector_name, cast(0.99 AS double) AS confidence, 90 AS rank")
    out = {f"scan_{p.name}": one_pattern(p) for p in PATTERNS}
    for provider in ("openai", "anthropic", "gemini", "azure"):
        for direction in ("request", "response"):
            out[f"chat_extract_{provider}_{direction}"] = fields_sql(provider, direction)
            out[f"chat_replace_{provider}_{direction}"] = replaced_sql(provider, direction)
    page = "SELECT page_id, html AS text FROM pages"
    rehydrated = f"SELECT doc_id, text AS restored FROM ({RICH})"
    ssn_token = f"SELECT doc_id, arg_min(token, s) AS ssn FROM ({TOKENS}) WHERE type = 'ssn' GROUP BY doc_id"
    fresh = "'fresh' || cast(doc_id AS varchar) || '@new.example.org'"
    out.update({
        "blocklist_scan": terms_view(("CONFIDENTIAL", "TOP SECRET")),
        "term_table_scan": terms_view(q.LONG_TERMS),
        "scan_pages": (
            "SELECT page_id, type, detector_name, cast(s AS bigint) AS span_start, "
            f"cast(e AS bigint) AS span_end, h AS value FROM ({kept_sql(page, 'page_id', **EVERYTHING)})"
        ),
        "byte_offsets": (
            "SELECT doc_id, cast(s AS bigint) AS span_start, cast(strlen(substring(text, 1, s)) AS bigint) AS byte_start "
            f"FROM ({kept_sql(RICH, 'doc_id')}) JOIN ({RICH}) USING (doc_id)"
        ),
        "merged_spans": f"SELECT doc_id, {SPAN_COLUMNS} FROM ({raw_sql(RICH, 'doc_id')})",
        "resolve_overlaps": spans_view(**EVERYTHING),
        "threshold_filter": spans_view(allow=()),
        "confidence_filter": f"SELECT * FROM ({spans_view(**EVERYTHING)}) WHERE confidence >= 0.95",
        "allowlist_filter": spans_view(),
        "allowlist_table": (
            f"SELECT doc_id, {SPAN_COLUMNS} FROM ({kept_sql(RICH, 'doc_id')}) WHERE lower(h) NOT IN "
            "(SELECT 'akia' || lpad(cast(c_custkey AS varchar), 16, 'a') FROM customer)"
        ),
        "custom_detector": spans_view(threshold=0.0, allow=(), terms=(), more=(hex40,)),
        "detections_by_type": (
            "SELECT type, detector_name, count(*) AS detections FROM "
            f"({kept_sql('SELECT doc_id, text FROM documents', 'doc_id', **EVERYTHING)}) GROUP BY ALL"
        ),
        "detections_by_type_rich": (
            f"SELECT type, detector_name, count(*) AS detections FROM ({kept_sql(RICH, 'doc_id')}) GROUP BY ALL"
        ),
        "detections_per_request": (
            f"SELECT doc_id, count(s) AS detections FROM ({RICH}) LEFT JOIN ({kept_sql(RICH, 'doc_id')}) "
            "USING (doc_id) GROUP BY doc_id"
        ),
        "types_found": (
            "SELECT doc_id, string_agg(DISTINCT type, ',' ORDER BY type) AS types "
            f"FROM ({kept_sql(RICH, 'doc_id')}) GROUP BY doc_id"
        ),
        "redact_text": f"SELECT doc_id, redacted FROM ({REDACTED})",
        "redacted_spans": PLACED,
        "leak_check": (
            "SELECT doc_id, coalesce(bool_or(contains(redacted, h)), false) AS leaked "
            f"FROM ({REDACTED}) LEFT JOIN ({kept_sql(RICH, 'doc_id')}) USING (doc_id) GROUP BY doc_id"
        ),
        "vault_lookup": f"SELECT DISTINCT scope_ AS scope_id, token, type AS pii_type, h AS value FROM ({TOKENS})",
        "vault_count": f"SELECT scope_ AS scope_id, count(DISTINCT token) AS tokens FROM ({TOKENS}) GROUP BY 1",
        "token_parse": f"""
SELECT DISTINCT doc_id, token, type, regexp_extract(token, '_([^_]+)_[^_]+__$', 1) AS id,
  regexp_extract(token, '_([^_]+)__$', 1) AS sig FROM ({TOKENS})
UNION ALL SELECT DISTINCT doc_id, 'x' || token, NULL, NULL, NULL FROM ({TOKENS})""",
        "verified_lookup": f"SELECT DISTINCT scope_ AS scope_id, token, h AS value FROM ({TOKENS})",
        "rehydrate_roundtrip": f"SELECT doc_id, restored, true AS same FROM ({rehydrated})",
        "forged_token_rejected": (
            f"SELECT doc_id, text || ' {q.FORGED}' || replace(ssn, '_ssn_', '_phone_') AS restored "
            f"FROM ({RICH}) JOIN ({ssn_token}) USING (doc_id)"
        ),
        "response_scan": (
            f"SELECT doc_id, text || ' reply to ' || {token_sql('scope', lit('email'), fresh)} AS response, "
            f"cast(1 AS bigint) AS new_values FROM ({RICH})"
        ),
        "expire_scopes": (
            f"SELECT DISTINCT scope_ AS scope_id, token, type AS pii_type FROM ({TOKENS}) "
            "WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
        ),
        "vault_retention": (
            "SELECT scope_id, token, pii_type, scope_date, NOT gone AS stored, NOT gone AS readable, "
            "bool_or(gone) OVER (PARTITION BY scope_date) AS rewritten FROM (SELECT DISTINCT scope_ AS scope_id, "
            f"token, type AS pii_type, '2024-01-' || lpad(cast(1 + doc_id % {q.DAYS} AS varchar), 2, '0') AS scope_date, "
            f"doc_id % {q.DAYS} < {q.ENDED_DAYS} AND doc_id IN (SELECT doc_id FROM labels "
            f"WHERE toxic = 1) AS gone FROM ({TOKENS}))"
        ),
        "chat_dispatch": f"SELECT doc_id, provider, path, text FROM ({mixed_fields()})",
        "dispatch_rejects": (
            "SELECT doc_id, 'other' AS provider, 'unknown provider' AS reason FROM documents WHERE doc_id % 5 = 4"
        ),
        "route_provider": (
            "SELECT request_id, path, CASE WHEN provider <> 'other' THEN provider END AS routed "
            f"FROM ({LOG})"
        ),
        "raw_fallback": (
            "SELECT doc_id, redacted AS redacted_body FROM ("
            + redacted_sql(f"SELECT doc_id, '{{\"messages\": ' || text AS text FROM ({RICH})", "doc_id", SCOPE)
            + ")"
        ),
        "custom_format": " UNION ALL ".join(
            [f"SELECT doc_id, 'title' AS path, scope AS text FROM ({RICH})"]
            + [f"SELECT doc_id, 'notes.{i}.lines.{j}' AS path, {c} AS text FROM ({RICH})"
               for i in (0, 1) for j, c in ((0, "text"), (2, "scope"))]
        ),
        "header_scan": header_sql(),
        "header_spans": header_spans_sql(),
        "url_query_scan": url_query_sql(),
        "correlation_id": (
            "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id ELSE substring(h, 1, 8) || '-' || "
            "substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || "
            "substring(h, 21, 12) END AS correlation_id FROM "
            "(SELECT event_id, sha256(cast(event_id AS varchar)) AS h FROM events)"
        ),
        "file_text_extract": file_text_sql(),
        "file_sniff": (
            f"SELECT doc_id, {_B64} AS base64_like, {_printable('content')} AS text_like FROM ({UPLOADS})"
        ),
        "upload_totals": (
            "SELECT request_id, count(s) AS pii_count FROM "
            f"(SELECT doc_id, doc_id // 10 AS request_id FROM documents) LEFT JOIN "
            f"({kept_sql(f'SELECT doc_id, text FROM ({file_text_sql()}) WHERE text IS NOT NULL', 'doc_id')}) "
            "USING (doc_id) GROUP BY request_id"
        ),
        "prompt_injection_flag": (
            f"SELECT *, CASE WHEN pattern_id IS NOT NULL THEN 'flagged' END AS action FROM ({injection_sql()})"
        ),
        "prompt_injection_block": f"SELECT conv_id, turn FROM ({injection_sql()}) WHERE pattern_id IS NULL",
        "injection_counts": (
            f"SELECT 'blocked' AS action, count(*) AS requests FROM ({injection_sql()}) WHERE pattern_id IS NOT NULL"
        ),
        "private_ip": f"SELECT request_id, remote_addr, ({_v4_between()}) AS private FROM ({LOG})",
        "address_ranges": f"""
WITH r AS (
  SELECT 10::BIGINT * 16777216 + (c_custkey % 256) * 65536 + (c_custkey // 256 % 256) * 256 AS low, 24 AS n,
         'customer ' || c_custkey AS label FROM customer
  UNION ALL SELECT 10::BIGINT * 16777216 + n_nationkey * 8 * 65536, 13, 'nation ' || n_nationkey FROM nation
  UNION ALL SELECT 172::BIGINT * 16777216 + 16 * 65536, 12, 'inner' UNION ALL SELECT 192::BIGINT * 16777216 + 168 * 65536, 16, 'home'),
a AS (SELECT request_id, remote_addr, cast(split_part(remote_addr, '.', 1) AS bigint) * 16777216
        + cast(split_part(remote_addr, '.', 2) AS bigint) * 65536
        + cast(split_part(remote_addr, '.', 3) AS bigint) * 256 AS ip FROM ({LOG})),
d AS (SELECT ip, arg_max(label, n) AS network FROM (SELECT DISTINCT ip FROM a)
      JOIN r ON ip // cast(2 ** (32 - n) AS bigint) = low // cast(2 ** (32 - n) AS bigint) GROUP BY ip)
SELECT request_id, remote_addr, network FROM a LEFT JOIN d USING (ip)""",
        "domain_allow": f"SELECT page_id, host, ({ALLOWED}) AS allowed FROM ({HOSTS})",
        "domain_allow_table": f"SELECT page_id FROM ({HOSTS}) WHERE {ALLOWED}",
        "base_domain": (
            "SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS domain FROM pages"
        ),
        "size_limit": "SELECT doc_id, strlen(text) <= 2000 AS within FROM documents",
        "key_admission": f"SELECT request_id FROM ({KEYED}) WHERE {LISTED}",
        "key_rejection": f"SELECT request_id, \"authorization\" FROM ({KEYED}) WHERE NOT ({LISTED})",
        "audit_entries": audit_sql(),
        "audit_sink": audit_sql(),
        "requests_by_status": (
            "SELECT method, path, cast(status_code AS bigint) AS status_code, count(*) AS requests "
            f"FROM ({LOG}) GROUP BY ALL"
        ),
        "latency_histogram": latency_sql(),
        "peak_concurrency": f"SELECT cast(max(active) AS bigint) AS peak FROM ({ACTIVE})",
        "over_concurrency": (
            f"SELECT event_id, cast(active AS bigint) AS active FROM ({ACTIVE}) WHERE delta > 0 AND active > 3"
        ),
        "failure_runs": FAILURES,
        "over_rate": rate_sql("user_id", 2, 3),
        "over_rate_busy": rate_sql("event_type", 50, 1),
        "chunk_tail": (
            f"SELECT doc_id, seq, right(substring(text, 1, seq * {q.CHUNK_CHARS}), 128) AS tail FROM ({CHUNKED})"
        ),
        "stream_redact_batch": PLACED,
        "spans_by_chunk": (
            "SELECT doc_id, seq, type, greatest(span_start, seq * 100) - seq * 100 AS chunk_start, "
            "least(span_end, (seq + 1) * 100) - seq * 100 AS chunk_end FROM "
            f"(SELECT *, unnest(range(span_start // 100, (span_end - 1) // 100 + 1)) AS seq FROM ({PLACED}))"
        ),
        "sse_lines": (
            "SELECT starts_with(value, 'data: ') AS is_data, "
            "CASE WHEN starts_with(value, 'data: ') THEN substring(value, 7) END AS data, value FROM ("
            f"SELECT 'data: ' || unnest(string_split_regex(text, '[\\r\\n]+')) AS value FROM ({RICH}) UNION ALL "
            f"SELECT 'id: ' || scope FROM ({RICH}) UNION ALL SELECT 'event: message' FROM ({RICH}))"
        ),
        "stream_redact": f"SELECT cast(doc_id AS varchar) AS stream_id, * EXCLUDE (doc_id) FROM ({PLACED})",
        "stream_redact_shuffled": f"SELECT cast(doc_id AS varchar) AS stream_id, * EXCLUDE (doc_id) FROM ({PLACED})",
        "stream_rejects": (
            "SELECT cast(doc_id AS varchar) AS stream_id, cast(seq AS bigint) AS seq, 'repeated' AS reason "
            f"FROM ({CHUNKED}) WHERE (doc_id + seq) % 7 = 0"
        ),
        "stream_late_vault": (
            f"SELECT scope AS stream_id, text AS restored, true AS complete FROM ({RICH}) WHERE text <> ''"
        ),
        "stream_rehydrate": (
            f"SELECT scope AS stream_id, text AS restored FROM ({RICH}) WHERE text <> ''"
        ),
        "stream_windows": f"""
SELECT cast(doc_id AS varchar) AS stream_id, seq,
  right(substring(text, 1, seq * 100), 128) || substring(text, seq * 100 + 1, 100) AS "window",
  least(128, seq * 100) AS overlap FROM ({CHUNKED})
UNION ALL SELECT scope, NULL, right(text, 128), least(128, length(text)) FROM ({RICH}) WHERE text <> ''""",
        "stream_counters": (
            "SELECT cast(epoch(date_trunc('day', ts)) AS bigint) AS day_start, event_type, count(*) AS requests "
            "FROM events GROUP BY ALL"
        ),
        "stream_over_rate": (
            "SELECT cast(epoch(date_trunc('day', ts)) AS bigint) AS day_start, cast(user_id AS varchar) AS caller, "
            "count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1"
        ),
        "term_refresh": (
            f"SELECT doc_id, type, cast(s AS bigint) AS span_start, cast(e AS bigint) AS span_end, h AS value "
            f"FROM ({kept_sql(RICH, 'doc_id', allow=())})"
        ),
        "response_bodies": f"SELECT doc_id, response, new_values FROM ({answers_sql()})",
        "request_to_audit": (
            f"SELECT a.*, response, new_values, cast(NULL AS varchar) AS action FROM ({audit_sql()}) a "
            f"JOIN ({answers_sql()}) USING (request_id)"
        ),
        "body_source": (
            "SELECT cast(doc_id AS varchar) AS request_id, provider, CASE WHEN doc_id % 7 <> 0 THEN body END AS body, "
            f"CASE WHEN doc_id % 7 = 0 THEN 'unreadable body' END AS reason FROM ({sent_sql()})"
        ),
        "file_source": f"SELECT doc_id, text, cast(strlen(text) + 1 AS bigint) AS bytes FROM ({FLAT})",
        "redacted_sink": f"SELECT doc_id, redacted FROM ({REDACTED})",
        "oversize_text": (
            f"SELECT doc_id, length(text) > 5000 AS oversize, coalesce(n, 0) AS found FROM ({RICH}) LEFT JOIN "
            f"(SELECT doc_id, count(*) AS n FROM ({kept_sql(RICH, 'doc_id')}) GROUP BY doc_id) USING (doc_id)"
        ),
        "dense_text": (
            f"SELECT doc_id, cast({q.DENSE} AS bigint) AS found, "
            f"cast({q.DENSE} * length('/u' || cast(doc_id AS varchar) || '@dense.example') AS bigint) AS last_end "
            "FROM documents"
        ),
        "adversarial_text": (
            "SELECT page_id, 'x' || cast(page_id AS varchar) || '@long.example' AS value FROM pages"
        ),
        "unstated_glue": PAIRS,
        "private_ip_v6": (
            "SELECT request_id, CASE event_id % 6 WHEN 0 THEN '::1' WHEN 1 THEN 'fd00::' || event_id % 1000 "
            "WHEN 2 THEN '2001:db8:0:1::' || event_id % 1000 WHEN 3 THEN '::ffff:10.0.' || event_id % 256 || '.1' "
            "WHEN 4 THEN '::ffff:8.8.' || event_id % 256 || '.1' ELSE 'fe80::1' END AS ip, "
            f"event_id % 6 NOT IN (2, 4) AS private FROM ({LOG})"
        ),
        "sse_redact": (
            "SELECT doc_id, unnest(range(0, 4)) AS seq, unnest(['id: ' || scope, ': ping', 'data: ' || redacted, '']) "
            f"AS line FROM ({redacted_sql(FLAT, 'doc_id', SCOPE)}) JOIN (SELECT doc_id, scope FROM ({RICH})) USING (doc_id)"
        ),
        "term_log": (
            "SELECT DISTINCT 'customer ' || o_custkey AS term FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey > "
            "(SELECT coalesce(max(o_orderkey), -1) FROM orders WHERE o_orderstatus = 'P')"
        ),
    })
    out["metrics_merge"] = out["latency_histogram"]
    out["metrics_sink"] = out["detections_by_type"]
    return out
