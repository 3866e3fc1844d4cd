"""DuckDB SQL of the queries that SQL can express, over the shared tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, '.' || host AS dotted, regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.') AS listed FROM s),
f AS (SELECT *, CASE
  WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM f"""


def contamination(docs: str = "documents") -> str:
    """CTEs d (words of each document), marks (doc_id, n_hit) and found (doc_id, items)."""
    return rf"""
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT doc_id, n, s, item_id FROM dw JOIN bw USING (n, k)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)"""


OP2 = f"""
WITH {contamination()}
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
again AS (SELECT doc_id, s FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k) USING (k) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM again),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""

_TURN = "'<|' || replace(t.role, '<|', '< |') || '|>' || chr(10)"
_TEXT = "replace(t.text, '<|', '< |') || '<|end|>' || chr(10)"


def _rendered(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: {_TURN} || {_TEXT}), ''), '')"


def _masked(turns: str) -> str:
    sizes = f"list_transform({turns}, lambda t: length({_TURN} || {_TEXT}))"
    start = f"coalesce(list_sum(({sizes})[1:i - 1]), 0)::BIGINT"
    heads = f"list_transform({turns}, lambda t: length({_TURN}))"
    spans = f"list_transform(list_filter(range(1, len({turns}) + 1), lambda i: ({turns})[i].role = 'assistant'), lambda i: ({start} + ({heads})[i])::VARCHAR || '-' || ({start} + ({sizes})[i])::VARCHAR)"
    return f"coalesce(array_to_string({spans}, ','), '')"


OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
e AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last, min({{'turn': turn, 'text': text}}) FILTER (role = 'assistant') AS first, min({{'turn': turn, 'text': text}}) AS opening FROM t GROUP BY conv_id),
o AS (SELECT t.conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn = last THEN CASE WHEN first.turn < last THEN first.text ELSE opening.text END ELSE text END AS other FROM t JOIN e USING (conv_id)),
s AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) AS c, list({{'turn': turn, 'role': role, 'text': other}} ORDER BY turn, role, other) AS r FROM o GROUP BY conv_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) - 1, len(c)) AS k FROM s),
p AS (SELECT conv_id, k, c[1:k] AS p, c[k + 1:] AS c, r[k + 1:] AS r FROM n)
SELECT conv_id, k::INTEGER AS n_common, {_rendered('p')} AS prompt, {_rendered('c')} AS chosen, {_masked('c')} AS chosen_mask, {_rendered('r')} AS rejected, {_masked('r')} AS rejected_mask FROM p"""


def _crc_entry(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: The table of CRC-32, by its rule.
_CRC_TABLE = f"CAST({[_crc_entry(i) for i in range(256)]} AS BIGINT[])"


def _crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, x: xor(c >> 8, {_CRC_TABLE}[xor(c & 255, x) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


_PAIRED = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
_FOLDED = "list_reduce([{0}] || list_transform({1}, lambda e: CASE WHEN e.r THEN 'R' ELSE 'L' END || e.d), lambda acc, e: CASE WHEN e[1] = 'R' THEN sha256(acc || e[2:]) ELSE sha256(e[2:] || acc) END)"

OP11 = f"""
WITH RECURSIVE crc AS (SELECT doc_id, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
l AS (SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
  sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + CASE WHEN h % 7 = 0 THEN 1 ELSE 0 END)", "text"))}) AS claim,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents LEFT JOIN crc USING (doc_id)),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM l GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_PAIRED} FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gid FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY gid) AS nodes FROM s UNION ALL SELECT level + 1, {_PAIRED} FROM u WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
a AS (SELECT lang, list(nodes ORDER BY level) AS tree FROM t GROUP BY lang),
p AS (SELECT l.*, subroot, root, list_transform(range(0, len(tree) - 1), lambda k: {{'d': coalesce(tree[k + 1][xor(pos >> k, 1) + 1], ''), 'r': (pos >> k) & 1 = 0}}) AS low,
  list_transform(range(0, len(top) - 1), lambda k: {{'d': coalesce(top[k + 1][xor(gid >> k, 1) + 1], ''), 'r': (gid >> k) & 1 = 0}}) AS high
  FROM l JOIN a ON l.lang IS NOT DISTINCT FROM a.lang JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, r, (SELECT list(nodes ORDER BY level) AS top FROM u)),
f AS (SELECT *, low || high AS path FROM p)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda e: e.d), ''), '')) AS proof_sha256, {_FOLDED.format("claim", "path")} AS folded_root,
  {_FOLDED.format("claim", "path")} = root AS verified FROM f"""

OP12 = f"""
WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
n AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS loops FROM o),
b AS (SELECT *, CASE WHEN loops THEN g % n END AS a FROM n),
c AS (SELECT *, CASE WHEN loops THEN 1 + (n - a) // (3 + g % 8) END AS p FROM b),
x AS (SELECT doc_id, n, unnest(w) AS v, unnest(range(0, n)) AS i, loops, a, p FROM c),
y AS (SELECT x.doc_id, x.n, x.i, coalesce(z.v, x.v) AS v FROM x LEFT JOIN x z ON x.loops AND x.i >= x.a AND z.doc_id = x.doc_id AND z.i = x.a + (x.i - x.a) % x.p),
same AS (SELECT s.doc_id, s.i, t.i - s.i AS q FROM y s JOIN y t ON s.doc_id = t.doc_id AND s.v = t.v AND t.i > s.i AND 4 * (t.i - s.i) <= s.n),
isle AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM isle WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q::DOUBLE DESC, s, q) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM runs) WHERE k = 1),
lines AS (SELECT doc_id, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM y ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(m, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The pages' articles have headings, paragraphs (some with a bold beginning and unclosed tags) and two kinds of character references.
OP13 = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>') AS b FROM pages),
t AS (SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM a)
SELECT page_id, url, coalesce(array_to_string(b, chr(10)), '') AS text, length(coalesce(array_to_string(b, chr(10)), ''))::BIGINT AS n_chars FROM t"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1, "op2_decontaminate": OP2, "op6_substring_dedup": OP6, "op7_chat_format": OP7, "op10_near_dup": OP10, "op11_merkle_manifest": OP11, "op12_periodic_runs": OP12, "op13_html_extract": OP13}
