"""The queries that SQL can express, as SQL on the same tables."""

from __future__ import annotations

from veilframe.llm.sharding import EIGHT, NINE, Node, tree

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         coalesce('v' || source, 'w') AS src,
         md5('mix|' || coalesce(cast(doc_id AS VARCHAR), 'text:' || md5(text), '')) AS h
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS nth
      FROM d GROUP BY src),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][nth % 3 + 1] AS weight,
             source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER ()
                 - (sum(cap) OVER (ORDER BY full_at, src ROWS UNBOUNDED PRECEDING) - cap))
             / sum(weight) OVER (ORDER BY full_at DESC, src DESC ROWS UNBOUNDED PRECEDING) AS lv
      FROM o),
t AS (SELECT src, nth, source_size, weight, least(cap, weight * max(lv) OVER ()) AS target FROM l),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS take,
             CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT
                  ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.weight, p.nth, p.passes,
             p.take - p.passes * p.source_size AS rest,
             (sum(d.size) OVER (PARTITION BY d.src ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING)
              - d.size)::BIGINT AS before
      FROM d JOIN p USING (src)),
q AS (SELECT *, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken,
             before::DOUBLE / target * weight AS x,
             [7.5::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE][nth % 3 + 1] AS w0,
             [-5.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE][nth % 3 + 1] AS slope FROM r)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0
            THEN least(x * 2 / (w0 + sqrt(greatest(w0 * w0 + slope * x * 2, 0))), 1.0) END AS position
FROM q
"""

EXACT_DEDUP = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size,
       coalesce(doc_id = keep_id, keep_id IS NULL)
         AND row_number() OVER (PARTITION BY norm, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""


JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id,
         unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
                     WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 3),
                                         lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT m.a, m.b FROM m JOIN n x ON x.doc_id = m.a JOIN n y ON y.doc_id = m.b
      WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce(l.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.a = d.doc_id
"""


SUFFIX_DEDUP = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
r AS (
  SELECT doc_id, unnest(range(0, len(ws) - 49)) AS s,
         unnest(list_transform(range(1, len(ws) - 48),
                               lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h
  FROM w WHERE len(ws) >= 50),
k AS (SELECT h FROM r GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s FROM r JOIN k USING (h)),
n AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new
      FROM m),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM n)
SELECT doc_id, min(s)::BIGINT AS start_word, (max(s) + 50)::BIGINT AS end_word,
       (max(s) + 50 - min(s))::BIGINT AS n_words
FROM g GROUP BY doc_id, span
"""

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH lo AS (
  SELECT doc_id AS id, row_number() OVER () AS rid, true AS doc, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{TERM}') AS ws FROM documents
  UNION ALL
  SELECT item_id, row_number() OVER (), false, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{TERM}') FROM benchmark),
wi AS (  -- windows of the items
  SELECT DISTINCT id AS item_id, least(13, len(ws)) AS width,
         unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
                               lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS gram
  FROM lo WHERE NOT doc AND len(ws) > 0),
wd AS (  -- runs of the documents, of every width in use
  SELECT rid, width, unnest(range(1, len(ws) - width + 2)) AS pos,
         unnest(list_transform(range(1, len(ws) - width + 2),
                               lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS gram
  FROM lo, (SELECT DISTINCT width FROM wi) WHERE doc AND len(ws) >= width),
hit AS (SELECT wd.rid, wd.pos, wd.width, wi.item_id FROM wd JOIN wi USING (width, gram)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit
       FROM (SELECT rid, unnest(range(pos, pos + width)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT rid, cast(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY rid)
SELECT id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM lo LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid) WHERE doc
"""


#: Proximity as well: the two rarest words that occur, of every window, on near diagonals.
PROXIMITY = (
    DECONTAMINATION[: DECONTAMINATION.rindex("SELECT id AS doc_id")].rstrip()
    + """,
dw AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM lo WHERE doc),
iw AS (SELECT rid AS item, id, len(ws) AS len, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place
       FROM lo WHERE NOT doc AND len(ws) > 0),
often AS (SELECT w, count(*) AS n FROM dw WHERE w IN (SELECT w FROM iw) GROUP BY w),
slot AS (SELECT item, id, place, w, n, least(2, len) AS need,
                unnest(range(greatest(1, place - least(13, len) + 1), least(place, len - least(13, len) + 1) + 1)) AS win
         FROM iw JOIN often USING (w)),
best AS (SELECT *, row_number() OVER (PARTITION BY item, win ORDER BY n, place) AS nth,
                count(*) OVER (PARTITION BY item, win) AS there FROM slot),
probe AS (SELECT DISTINCT item, id, place, w, need FROM best WHERE nth <= 2 AND there >= need),
diag AS (SELECT rid, item, id, need, pos - place AS d, list(DISTINCT place) AS places
         FROM dw JOIN probe USING (w) GROUP BY ALL),
pair AS (SELECT *, lag(d) OVER v AS d0, lag(places) OVER v AS p0 FROM diag
         WINDOW v AS (PARTITION BY rid, item ORDER BY d)),
cand AS (SELECT DISTINCT rid, coalesce(cast(id AS VARCHAR), '') AS item_id FROM pair
         WHERE len(places) >= need
            OR (d - d0 <= 3 AND len(list_distinct(list_concat(places, p0))) > greatest(len(places), len(p0))
                AND len(list_distinct(list_concat(places, p0))) >= need)),
nr AS (SELECT rid, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near
       FROM (SELECT * FROM cand EXCEPT SELECT rid, coalesce(cast(item_id AS VARCHAR), '') FROM hit) GROUP BY rid)
"""
    + DECONTAMINATION[DECONTAMINATION.rindex("SELECT id AS doc_id") :]
    .replace("\nFROM lo LEFT JOIN", ",\n       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near, '')) AS near_sha256"
             "\nFROM lo LEFT JOIN nr USING (rid) LEFT JOIN")
)


def place_sql(key: str, node: Node) -> str:
    """The shard that a key reaches, as nested choices of the largest draw."""
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return place_sql(key, node.children[0])
    draws = [
        f"ln((cast('0x' || substr(md5({key} || '|{c.name}'), 1, 13) AS BIGINT) + 0.5::DOUBLE)"
        f" / {16**13}.0::DOUBLE) / {c.weight}::DOUBLE"
        for c in node.children
    ]
    best = f"list_position([{', '.join(draws)}], list_max([{', '.join(draws)}]))"
    cases = " ".join(
        f"WHEN {i} THEN {place_sql(key, c)}" for i, c in enumerate(node.children, start=1)
    )
    return f"CASE {best} {cases} END"


def _part(query: str, documents: str) -> str:
    """A query's SQL as a subquery over another table of documents."""
    return "(" + query.replace("FROM documents", f"FROM {documents}") + ")"


_USES = MIXING[: MIXING.rindex("SELECT doc_id, size")] + """
SELECT doc_id, unnest(range(passes + CASE WHEN least(size, rest - before) * 2 >= size
                                           AND rest > before AND size > 0 THEN 1 ELSE 0 END)) AS use
FROM q"""

_KEY = "'shard|' || coalesce(cast(doc_id AS VARCHAR), '')"

#: All stages of the pipeline; ids are taken to be unique, as in the table.
PIPELINE = f"""
WITH told AS (SELECT * FROM documents WHERE regexp_matches(text, '\\p{{L}}')),
stays AS (SELECT * FROM {_part(JACCARD_JOIN, "told")} WHERE doc_id = component_id),
one AS (SELECT told.* FROM told JOIN stays USING (doc_id)),
judged AS (SELECT * FROM {_part(DECONTAMINATION, "one")} WHERE NOT contaminated),
clean AS (SELECT one.* FROM one JOIN judged USING (doc_id)),
uses AS (SELECT * FROM {_part(_USES, "clean")}),
used AS (SELECT clean.* FROM clean JOIN uses USING (doc_id)),
placed AS (SELECT *, 'key' AS law, ({place_sql(_KEY, tree(EIGHT))})::INTEGER AS shard,
                  ({place_sql(_KEY, tree(NINE))})::INTEGER AS grown_shard FROM used)
SELECT doc_id, text, lang, source, n_chars, law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY md5('shard-slot|' || doc_id)) - 1)::BIGINT AS slot,
       grown_shard
FROM placed
"""


#: The table of CRC-32, and the checksum of an ASCII string by it.
_CRC_TABLE = """list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def crc32_sql(text: str, table: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''),"
        f" lambda c: ascii(c)::BIGINT)),"
        f" lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)"
    )


TRIE = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS tab),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, sha256(len(role) || ':' || role || text) AS dg,
             len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS pos FROM d),
c AS (SELECT conv_id, n, {crc32_sql("cast(conv_id AS VARCHAR)", "tab")} % 4 AS h, conv_id - conv_id % 20 AS base
      FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), crc),
s AS (SELECT c.conv_id, o.pos, o.dg, o.words FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h
      UNION ALL
      SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.dg, o.words
      FROM c JOIN o USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE o.pos >= c.h),
p AS (SELECT conv_id, pos + 1 AS depth, words,
             string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY pos) AS name FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (SELECT name, depth, min(conv_id) AS conv, count(*) AS n_convs, max(words) AS words,
             sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                             FILTER (depth = len), '')) AS ends
      FROM p JOIN l USING (conv_id) GROUP BY name, depth),
k AS (SELECT left(name, 64 * (depth - 1)::INTEGER) AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (name)),
u AS (SELECT p.name, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
      FROM v JOIN p ON p.conv_id = v.conv AND p.depth <= v.depth GROUP BY p.name)
SELECT v.conv AS conv_id, v.depth, m.conv AS parent_conv_id, v.n_convs, v.n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN u USING (name) LEFT JOIN n m ON v.depth > 0 AND m.name = left(v.name, 64 * (v.depth - 1)::INTEGER)
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS tab),
k AS (
  SELECT conv_id, coalesce('i' || conv_id, 'n') AS ck, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ')", "tab")}
           % 20 AS kind FROM conversations, crc),
dm AS (
  SELECT ck, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM k WHERE kind <> 0),
dg AS (SELECT *, sha256(len(role) || ':' || role || text) AS digest, rtrim(text, {_BLANKS}) AS tail,
              left(role, 1) AS ini FROM dm),
po AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, digest) - 1 AS pos,
              count(*) OVER (PARTITION BY ck) AS n FROM dg),
fa AS (SELECT *, CASE WHEN tail = '' THEN 'b'
                      WHEN row_number() OVER (PARTITION BY ck, digest ORDER BY pos) > 1 THEN 'd'
                      WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
              lag(ini) OVER (PARTITION BY ck ORDER BY pos) AS was FROM po),
st AS (  -- what it costs to keep a row, or to re-role it, as s, u, a
  SELECT *, CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 5 ELSE 0 END AS base,
         (CASE WHEN ini = 's' THEN 0 ELSE 1000000000 END)::BIGINT AS s0,
         (CASE WHEN ini = 'u' THEN 0 ELSE 1 END)::BIGINT AS u0,
         (CASE WHEN ini = 'a' THEN 0 ELSE 1 END)::BIGINT AS a0 FROM fa),
b(ck, pos, f0, f1, f2, f3) AS (  -- least cost to the end: nothing, s, u, a came last
  SELECT DISTINCT ck, n, 0::BIGINT, 10::BIGINT, 5::BIGINT, 0::BIGINT FROM st
  UNION ALL
  SELECT ck, pos, least(h0, h2 + 5, h3 + 10), least(h1, h2 + 5, h3 + 10), least(h2, h3 + 5), least(h3, h2 + 5)
  FROM (SELECT st.ck, st.pos, least(2 + f0, base + s0 + f1, base + u0 + f2) AS h0,
               least(2 + f1, base + u0 + f2) AS h1, least(2 + f2, base + a0 + f3) AS h2,
               least(2 + f3, base + u0 + f2) AS h3
        FROM b JOIN st ON st.ck = b.ck AND st.pos = b.pos - 1)),
fv AS (SELECT ck, pos, [f0, f1, f2, f3] AS f FROM b),
m AS (  -- per row and state the ASCII-least edit of least cost
  SELECT x.ck, x.pos, q, nx,
         CASE WHEN x.n = x.pos THEN CASE WHEN x.f[q + 1] = 0 THEN '' ELSE 'I' END
              WHEN 2 + y.f[q + 1] = x.f[q + 1] THEN 'D'
              WHEN 5 + x.f[nx + 1] = x.f[q + 1] THEN 'I'
              WHEN q = 0 AND ini = 's' AND base + y.f[2] = x.f[q + 1] THEN 'S'
              WHEN ini = CASE nx WHEN 2 THEN 'u' ELSE 'a' END AND base + y.f[nx + 1] = x.f[q + 1] THEN 'K'
              ELSE 'R' END AS edit, role, text
  FROM (SELECT fv.ck, fv.pos, fv.f, t.n, q, CASE q WHEN 2 THEN 3 ELSE 2 END AS nx
        FROM fv JOIN (SELECT DISTINCT ck, n FROM st) t USING (ck), range(4) r(q)) x
  LEFT JOIN fv y ON y.ck = x.ck AND y.pos = x.pos + 1
  LEFT JOIN st ON st.ck = x.ck AND st.pos = x.pos),
w(ck, step, pos, q, audit, lines) AS (
  SELECT DISTINCT ck, 0, 0::BIGINT, 0::BIGINT, '', []::VARCHAR[] FROM st
  UNION ALL
  SELECT w.ck, step + 1, CASE edit WHEN 'I' THEN w.pos ELSE w.pos + 1 END,
         CASE edit WHEN 'D' THEN w.q WHEN 'S' THEN 1 ELSE nx END,
         audit || CASE edit WHEN 'S' THEN 'K' ELSE edit END,
         CASE edit WHEN 'D' THEN lines
                   WHEN 'I' THEN list_append(lines, CASE nx WHEN 2 THEN 'user:' ELSE 'assistant:' END)
                   WHEN 'R' THEN list_append(lines, CASE nx WHEN 2 THEN 'user:' ELSE 'assistant:' END || text)
                   ELSE list_append(lines, role || ':' || text) END
  FROM w JOIN m ON m.ck = w.ck AND m.pos = w.pos AND m.q = w.q WHERE edit <> ''),
e AS (SELECT ck, arg_max(audit, step) AS audit, arg_max(lines, step) AS lines FROM w GROUP BY ck),
c AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pos > 0 AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
      FROM st GROUP BY ck)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(fv.f[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM k) o LEFT JOIN c USING (ck) LEFT JOIN e USING (ck)
LEFT JOIN fv ON fv.ck = o.ck AND fv.pos = 0
"""


def oracle_queries() -> dict[str, str]:
    return {
        "op1_mixing": MIXING,
        "op4_exact_dedup": EXACT_DEDUP,
        "op6_suffix_dedup": SUFFIX_DEDUP,
        "op7_decontamination": PROXIMITY,
        "op10_jaccard_join": JACCARD_JOIN,
        "op11_prefix_trie": TRIE,
        "op13_conversation_repair": REPAIR,
    }
