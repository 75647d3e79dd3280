"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


def decontamination(documents: str = "documents") -> str:
    """Common table expressions that end in ``judged``: one row per document."""
    return f"""
d AS (SELECT doc_id, {_WORDS} AS w FROM {documents}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS g FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM ds),
hit AS (SELECT DISTINCT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
judged AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items, '') AS items, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id))"""


DECONTAMINATION = f"""WITH {decontamination()}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, contaminated FROM judged"""


def lines(documents: str = "documents", min_sites: int = 10) -> str:
    """Common table expressions that end in ``kept_lines``: one row per document."""
    return f"""
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {documents}),
lb AS (SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS body FROM ln),
bad AS (SELECT body FROM lb WHERE body <> '' GROUP BY body HAVING count(DISTINCT source) >= {min_sites}),
marked AS (SELECT lb.*, bad.body IS NOT NULL AS gone FROM lb LEFT JOIN bad ON lb.body = bad.body),
summed AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY 1),
kept_lines AS (SELECT d.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE kept END AS kept FROM {documents} d LEFT JOIN summed USING (doc_id))"""


LINES = f"""WITH {lines()}
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept_lines"""


WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS lead, count(*) OVER (PARTITION BY payload_digest) AS n FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM lead AS again FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to FROM r"""

#: Tool calls derived from the turns: assistant turns are calls, user turns the results of the turn before.
MESSAGES = """SELECT conv_id, turn, role, text,
  CASE WHEN role = 'assistant' THEN concat('call_', conv_id, '_', turn) END AS call_id,
  CASE WHEN role = 'assistant' THEN CASE length(text) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'compute' ELSE 'search' END END AS tool,
  CASE WHEN role <> 'assistant' THEN NULL
    WHEN length(text) % 13 = 0 THEN concat('{"query": ', length(text))
    WHEN length(text) % 11 = 0 THEN '{"strict": "yes", "op": 1}'
    WHEN length(text) % 4 = 1 THEN concat('{"strict": true,  "id": ', length(text) % 5, '}')
    WHEN length(text) % 4 = 2 THEN concat('{"values": [', turn, ', ', length(text), '], "op":"sum"}')
    ELSE concat('{ "query":"q', length(text), '", "limit": ', length(text) % 50, ' }') END AS arguments,
  CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN concat('call_', conv_id, '_', turn - 2) END AS after,
  CASE WHEN role = 'user' AND turn > 0 THEN concat('call_', conv_id, '_', turn - 1) END AS result_for
FROM conversations"""


CHAT = f"""WITH RECURSIVE m AS ({MESSAGES}),
c AS (SELECT * FROM m WHERE call_id IS NOT NULL),
chain AS (
  SELECT c.conv_id, c.call_id, 0 AS level, c.after IS NOT NULL AS dangling FROM c WHERE c.after IS NULL OR c.after NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT c.conv_id, c.call_id, chain.level + 1, false FROM c JOIN chain ON c.after = chain.call_id),
answers AS (SELECT result_for, count(*) AS n FROM m WHERE result_for IS NOT NULL GROUP BY 1),
j AS (SELECT m.conv_id, m.turn, m.role, m.text, m.tool, m.arguments, m.after,
  CASE WHEN m.call_id IS NOT NULL THEN 'call' WHEN m.result_for IS NOT NULL THEN 'result' ELSE 'text' END AS kind,
  coalesce(m.call_id, m.result_for) AS call_id, chain.level, coalesce(chain.dangling, false) AS dangling, chain.call_id IS NOT NULL AS known, answers.n AS n
  FROM m LEFT JOIN chain ON chain.call_id = coalesce(m.call_id, m.result_for) LEFT JOIN answers ON answers.result_for = coalesce(m.call_id, m.result_for))
SELECT conv_id, turn, role, kind, call_id,
  CASE kind WHEN 'call' THEN CASE WHEN n > 0 THEN 'answered' ELSE 'unanswered' END WHEN 'result' THEN CASE WHEN known THEN 'linked' ELSE 'orphan' END END AS status,
  CAST(level AS BIGINT) AS level,
  concat_ws('; ', CASE WHEN kind <> 'call' THEN NULL WHEN length(text) % 13 = 0 THEN 'not an object'
    WHEN length(text) % 11 = 0 THEN CASE tool WHEN 'search' THEN 'query is missing; limit is missing' WHEN 'lookup' THEN 'id is missing; strict is not boolean'
      ELSE 'op is not string; values is missing' END
    WHEN tool = 'lookup' AND length(text) % 5 = 0 THEN 'id is below 1' END, CASE WHEN kind = 'call' AND dangling THEN 'dangling' END) AS errors,
  concat('{{', CASE WHEN kind = 'call' THEN concat('"after":', CASE WHEN after IS NULL THEN 'null' ELSE to_json(after) END, ',"arguments":',
    CASE WHEN length(text) % 13 = 0 THEN to_json(arguments) WHEN length(text) % 11 = 0 THEN '{{"op":1,"strict":"yes"}}'
      WHEN tool = 'lookup' THEN concat('{{"id":', length(text) % 5, ',"strict":true}}')
      WHEN tool = 'compute' THEN concat('{{"op":"sum","values":[', turn, ',', length(text), ']}}')
      ELSE concat('{{"limit":', length(text) % 50, ',"query":"q', length(text), '"}}') END, ',') ELSE '' END,
    CASE WHEN kind <> 'text' THEN concat('"call_id":', to_json(call_id), ',') ELSE '' END,
    '"content":', to_json(text), ',"role":', to_json(role), CASE WHEN kind = 'call' THEN concat(',"tool":', to_json(tool)) ELSE '' END, '}}') AS message
FROM j"""
