"""The same results as DuckDB SQL, where SQL can say them.

SQL has no XXH64 (op5), no classifier (op7), no public tokenizer's merges (op2) and no sentence
state for names (op6), no tokenizer (op11) and no eigenvectors (op13); those, and the pipeline
made of them, are tested against plain versions.
"""

from __future__ import annotations

from txnwatch.llm import linededup, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

BACKOFF = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM docs),
spots AS (SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v,
    CASE WHEN i > 2 THEN words[i - 2] END AS u FROM places),
others AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c_w,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c_vw,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c_uvw
  FROM spots),
histories AS (
  SELECT *, lag(c_w) OVER place AS c_v, lag(c_vw) OVER place AS c_uv FROM others
  WINDOW place AS (PARTITION BY doc_id ORDER BY i)),
sizes AS (SELECT doc_id, len(words) AS n_words, (SELECT count(*) FROM spots) - len(words) AS rest FROM docs),
alone AS (SELECT h.*, n_words,
    CASE WHEN c_w > 0 THEN c_w / rest::DOUBLE ELSE 1 / (rest + 1.0::DOUBLE) END AS one
  FROM histories h JOIN sizes USING (doc_id)),
pairs AS (SELECT *, CASE WHEN v IS NULL THEN one WHEN c_vw > 0 THEN c_vw / greatest(c_v, 1)::DOUBLE
    ELSE 0.4::DOUBLE * one END AS two FROM alone),
scored AS (
  SELECT doc_id, CAST(round(ln(CASE WHEN u IS NULL THEN two
      WHEN c_uvw > 0 THEN c_uvw / greatest(c_uv, 1)::DOUBLE ELSE 0.4::DOUBLE * two END)
      * 1000000) AS BIGINT) AS millionths,
    0 = CASE WHEN u IS NOT NULL THEN c_uvw WHEN v IS NOT NULL THEN c_vw ELSE c_w END AS backed
  FROM pairs),
sums AS (SELECT doc_id, sum(millionths)::DOUBLE / 1000000 AS log_score,
  count(*) FILTER (backed) AS n_backed_off FROM scored GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_backed_off, 0) AS n_backed_off,
  coalesce(log_score, 0.0::DOUBLE) AS log_score,
  CASE WHEN n_words > 0 THEN log_score / n_words END AS per_word
FROM sizes LEFT JOIN sums USING (doc_id)"""

LINES = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM keyed WHERE key <> '' GROUP BY ALL),
bad AS (SELECT source, key FROM counts JOIN pages USING (source)
  WHERE n >= {linededup.MIN_PAGES} AND n > pages * {linededup.MAX_RATIO}::DOUBLE),
cut AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (bad.key IS NULL) AS text,
    count(bad.key) AS lost
  FROM keyed k LEFT JOIN bad ON bad.source = k.source AND bad.key = k.key GROUP BY doc_id)
SELECT doc_id, source, CASE WHEN lost > 0 THEN coalesce(cut.text, '') ELSE d.text END AS text,
  coalesce(lost, 0) AS lines_dropped
FROM documents d LEFT JOIN cut USING (doc_id)"""

MIXING = f"""
WITH docs AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE]
    [(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at
  FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM capped
  WINDOW before AS (ORDER BY full_at, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS r,
    CAST('0x' || left(md5('17:' || coalesce('=' || source, 'null')), 12) AS BIGINT)
      / 281474976710656.0::DOUBLE AS u
  FROM docs),
joined AS (SELECT ranked.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM ranked JOIN aimed ON ranked.source IS NOT DISTINCT FROM aimed.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(rate * r + u) - floor(rate * (r - 1) + u), 2) AS BIGINT) * size AS taken
FROM joined"""

_BITS = " + ".join(f"CAST(substr(bits, 5 * i + {k + 1}, 1) AS INT) * {16 >> k}" for k in range(5))

WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes,
  CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM payloads),
based AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), 'string_agg', '')
  AS payload_digest FROM hashed),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS first FROM based)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""

VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
size AS (SELECT len(v) AS d FROM sound GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.v) = (SELECT d FROM size) AND len(b.v) = len(a.v)
  AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id,
  vec_id = component_id AS kept FROM least"""


_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''),
  lambda c: ord(c)::BIGINT), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda v, _: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

TRIE = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS seq FROM turns GROUP BY conv_id),
asked AS (SELECT *, {_CRC32} % 9 AS h FROM lists),
rebuilt AS (SELECT a.conv_id, coalesce(b.seq[1:h], []) || a.seq[h + 1:] AS seq
  FROM asked a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 5),
members AS (SELECT conv_id AS c, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt),
named AS (SELECT c, depth, depth = len(seq) AS ends, seq[1:depth] AS prefix,
    min(c) OVER (PARTITION BY depth, seq[1:depth]) AS conv_id FROM members),
nodes AS (SELECT conv_id, depth, count(*) AS n_convs,
    (count(*) - 1) * max(CASE WHEN depth > 0 THEN strlen(prefix[depth].text) ELSE 0 END) AS cost,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM named GROUP BY conv_id, depth),
above AS (SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id FROM nodes n
  JOIN named m ON m.c = n.conv_id AND m.depth = n.depth - 1),
families AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n FROM above GROUP BY ALL),
grown AS (SELECT nodes.*, above.parent_conv_id, coalesce(families.n, 0) AS n_children FROM nodes
  LEFT JOIN above ON above.conv_id = nodes.conv_id AND above.depth = nodes.depth
  LEFT JOIN families ON families.parent_conv_id = nodes.conv_id AND families.depth = nodes.depth),
sums AS (SELECT m.conv_id, m.depth, count(*) FILTER (g.n_children = 0) AS n_leaves, sum(g.cost) AS saved
  FROM grown g JOIN named m ON m.c = g.conv_id AND m.depth <= g.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM grown JOIN sums USING (conv_id, depth)"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: int, pattern: str, values: str = "m") -> str:
    """Spans of a pattern's matches as (start, kind, end, value) from the pieces between them."""
    group = f"regexp_extract_all(text, {_sql(pattern)}, 2)" if values == "g" else "m"
    return f"""SELECT doc_id, {kind} AS kind, place AS start, place + length(m[i]) AS stop, g[i] AS value FROM (
  SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place FROM (
      SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {_sql(pattern)}) AS m, {group} AS g,
          regexp_split_to_array(text, {_sql(pattern)}) AS gaps FROM docs)))"""


def _secrets() -> str:
    names = "[" + ", ".join(map(_sql, secrets.KINDS)) + "]"
    spans = f"{names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    window = secrets.WINDOW
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_found(0, secrets.ASSIGN, "g")} WHERE length(g[i]) >= {secrets.MIN_VALUE}
  UNION ALL {_found(1, secrets.ACCESS)} UNION ALL {_found(2, secrets.HEX)}),
candidates AS ({_found(0, secrets.CANDIDATE)}),
judged AS (SELECT *, array_to_string(list_filter(string_split_regex(value, '[-_/=+]'), lambda p:
    NOT (regexp_matches(p, '^[A-Z]?[a-z]{{2,}}$') OR regexp_matches(p, '^[A-Z]{{3,}}$')
      OR regexp_matches(p, '^[A-Za-z]?[0-9]{{2,4}}$')
      OR regexp_matches(p, '(?i)example|sample|dummy|placeholder|changeme|xxxxxx')
      OR regexp_matches(p, '(?i)abcdefgh|0123456789|1234567890'))), '/') AS rest FROM candidates),
mixed AS (SELECT *, list_max(list_transform(range(1, length(rest) - {window - 2}),
    lambda k: list_aggregate(string_split(rest[k:k + {window - 1}], ''), 'entropy'))) AS bits,
    CASE WHEN regexp_matches(rest, '^[0-9A-Fa-f]+$') THEN 3 WHEN regexp_matches(rest, '^[a-z0-9]+$') THEN 4
      WHEN regexp_matches(rest, '^[A-Z0-9]+$') THEN 5 WHEN regexp_matches(rest, '^[A-Za-z0-9]+$') THEN 6
      ELSE 7 END AS class
  FROM judged WHERE length(rest) >= {window} AND regexp_matches(rest, '[0-9]')),
more AS (SELECT doc_id, class AS kind, start, stop, value FROM mixed
  WHERE bits >= [2.94::DOUBLE, 3.38::DOUBLE, 3.38::DOUBLE, 3.66::DOUBLE, 3.66::DOUBLE][class - 2]),
listed AS (SELECT doc_id, string_agg({spans}, ',' ORDER BY start, kind) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg({spans}, ',' ORDER BY start, kind) AS base
  FROM base GROUP BY doc_id),
extra AS (SELECT doc_id, count(*) AS n_entropy FROM more GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN extra USING (doc_id)
LEFT JOIN listed USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_stupid_backoff": BACKOFF,
    "op3_line_dedup": LINES,
    "op4_mixing": MIXING,
    "op8_warc": WARC,
    "op9_product_quantisation": VECTORS,
    "op10_secret_scan": _secrets(),
    "op12_prefix_trie": TRIE,
}
