"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from .decontaminate import UNITS
from .secret_scan import BASE_RULES, RULES

OP1_SUBSTRING_DEDUP = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, ws
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
),
windows AS (
  SELECT doc_id, pos, array_to_string(ws[pos:pos + 34], ' ') AS seq FROM words WHERE pos + 34 <= len(ws)
),
repeated AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY seq) AS n FROM windows) WHERE n > 1
),
covered AS (
  SELECT w.doc_id, w.pos, w.word,
         count(r.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.pos = r.pos
),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP3_NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (SELECT u, v FROM shared WHERE 100 * n_both >= 80 * (na + nb - n_both)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u
),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN components c ON s.doc_id = c.doc_id
"""

OP4_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
firsts AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.key IS NOT NULL AND l.doc_id <> f.first_id AS gone
  FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Windows meet by their template strings here, not by hashes.
OP5_DECONTAMINATION = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', min(item_id), text FROM benchmark WHERE text IS NOT NULL GROUP BY text
),
named AS (
  SELECT side, id, row_number() OVER () AS r,
         lower(regexp_replace(text, '([\p{Ll}\p{N},;][\t\n\x0B\f\r ])(\p{Lu})', '\1' || chr(1) || '\2', 'g')) AS t
  FROM texts
),
split AS (
  SELECT side, id, r, list_filter(regexp_split_to_array(
           regexp_replace(regexp_replace(t, '([0-9])([.,])([0-9])', '\1' || chr(2) || '\3', 'g'),
                          '([0-9])([.,])([0-9])', '\1' || chr(2) || '\3', 'g'),
           '[^\p{L}\p{N}\x01\x02]+'), lambda x: x <> '') AS ws
  FROM named
),
words AS (SELECT side, id, r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, list_concat([''], ws[1:len(ws) - 1]) AS before FROM split),
marked AS (
  SELECT side, id, r, i, w,
    CASE WHEN w >= '0' AND w < ':' THEN '<number>' WHEN w < ':' THEN '<name>'
         WHEN w IN (UNITS) AND before[i] >= '0' AND before[i] < ':' THEN '<unit>' END AS kind
  FROM words
),
tokens AS (
  SELECT side, id, r, list(coalesce(kind, w) ORDER BY i) AS ts,
         list(CASE WHEN kind IS NOT NULL THEN w END ORDER BY i) AS vs, count(*) AS n
  FROM marked GROUP BY side, id, r
),
docs AS (SELECT id AS doc_id, r, ts, vs, n FROM tokens WHERE side = 'd'),
items AS (SELECT id AS item_id, ts, vs, n AS n_item, least(n, 8) AS size FROM tokens WHERE side = 'b'),
item_windows AS (
  SELECT item_id, n_item, size, pos, ts[pos:pos + size - 1] AS tpl, vs[pos:pos + size - 1] AS iv
  FROM (SELECT *, unnest(range(1, n_item - size + 2)) AS pos FROM items)
  WHERE 2 * len(list_filter(vs[pos:pos + size - 1], lambda v: v IS NOT NULL)) <= size
),
doc_windows AS (
  SELECT doc_id, r, size, place, ts[place:place + size - 1] AS tpl, vs[place:place + size - 1] AS dv
  FROM (SELECT d.*, s.size, unnest(range(1, n - s.size + 2)) AS place FROM docs d, (SELECT DISTINCT size FROM items) s WHERE d.n >= s.size)
),
hits AS (
  SELECT doc_id, r, item_id, n_item, i.size, pos, place - pos AS diagonal, i.tpl, iv, dv
  FROM item_windows i JOIN doc_windows d ON i.size = d.size AND i.tpl = d.tpl
),
slots AS (
  SELECT DISTINCT doc_id, r, item_id, diagonal, tpl[k] || chr(1) || iv[k] AS b, tpl[k] || chr(1) || dv[k] AS d
  FROM (SELECT *, unnest(range(1, size + 1)) AS k FROM hits) WHERE iv[k] IS NOT NULL
),
slot_sums AS (
  SELECT doc_id, r, item_id, diagonal, count(*) AS n, count(DISTINCT b) AS nb, count(DISTINCT d) AS nd, bool_or(b <> d) AS changed
  FROM slots GROUP BY ALL
),
runs AS (
  SELECT doc_id, r, item_id, n_item, diagonal, sum(least(size, pos - before)) AS covered
  FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id, r, item_id, diagonal ORDER BY pos), pos - size) AS before
        FROM (SELECT DISTINCT doc_id, r, item_id, n_item, size, pos, diagonal FROM hits))
  GROUP BY ALL
)
SELECT u.doc_id, u.item_id, max(covered)::BIGINT AS n_covered, max(n_item)::BIGINT AS n_item,
       bool_and(coalesce(changed, false)) AS reworded
FROM runs u LEFT JOIN slot_sums s ON u.doc_id = s.doc_id AND u.r = s.r AND u.item_id = s.item_id AND u.diagonal = s.diagonal
WHERE coalesce(n = nb AND n = nd, true) AND covered >= least(13, 0.8 * n_item)
GROUP BY u.doc_id, u.item_id
""".replace("UNITS", ", ".join(f"'{u}'" for u in UNITS))

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_LEXICAL_SEARCH = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
docs AS (SELECT r, doc_id, len(ts) AS n FROM texts WHERE len(ts) > 0),
totals AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM docs),
asked AS (
  SELECT i, item_id, unnest(list_distinct({_TERMS})) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
),
scored AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM held JOIN docs USING (r) JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY i, r
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


def _spans_sql(rank: int) -> str:
    """The spans of one rule. RE2 folds more than A-Z, so letters in either case are written out."""
    rule = RULES[rank]
    pattern = rule.pattern.replace("\\x20", " ").replace("'", "''")
    if rule.fold:
        head, tail = pattern.split(")", 1)
        pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail
    judged = f"regexp_extract_all(text, '{pattern}', {rule.group})" if rule.least else "m"
    return f"""
  SELECT row, {rank} AS rank, start, start + length(m[k]) AS "end" FROM (
    SELECT row, m, k, g[k] AS judged, (list_sum(list_transform(p[1:k], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
      SELECT row, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p, {judged} AS g FROM texts))
  ) WHERE length(judged) >= {rule.least}"""


OP12_SECRET_SCAN = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(r) for r in range(len(RULES)))}),
written AS (SELECT row, rank, start, {list(r.kind for r in RULES)}[rank + 1] || ':' || start || ':' || "end" AS span FROM spans),
found AS (
  SELECT row, {", ".join(f"count(*) FILTER (WHERE rank = {r}) AS n_{rule.kind}" for r, rule in enumerate(BASE_RULES))},
         string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE_RULES)}) AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM written GROUP BY row
)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN found f ON t.row = f.row
"""

ORACLES = {
    "op1_substring_dedup": OP1_SUBSTRING_DEDUP,
    "op3_near_dedup": OP3_NEAR_DEDUP,
    "op4_line_dedup": OP4_LINE_DEDUP,
    "op5_decontamination": OP5_DECONTAMINATION,
    "op11_lexical_search": OP11_LEXICAL_SEARCH,
    "op12_secret_scan": OP12_SECRET_SCAN,
}
