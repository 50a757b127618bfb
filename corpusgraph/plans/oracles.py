"""The registered queries as plain SQL over the supplied tables, for checking results in another engine."""

from __future__ import annotations

from ..functions.labels import LABEL_SYNONYMS, RELATION_ALIASES, RELATION_TYPES, STOP_LABELS
from ..functions import extraction as x
from ..operators.context import FALLBACK_INTRO, NOTHING_FOUND, PROMPT_HEAD, PROMPT_RULES
from ..operators.selection import RELATION_WEIGHTS


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(column: str, entries: dict, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def tokens(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}]+')"


def estimate(e: str) -> str:
    return f"greatest(1, CAST(floor(length({e}) / 4) AS INTEGER))"


def squeeze(e: str) -> str:
    return rf"regexp_replace({e}, '\s+', ' ', 'g')"


def sentences(e: str) -> str:
    """List of sentences; the engine has no lookbehind, so a mark is put after each sentence end."""
    marked = rf"regexp_replace({strip(e)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: length(s) > 0)"


def asc(e: str) -> str:
    """Letters outside ASCII as a word character, for patterns with word boundaries."""
    return f"regexp_replace({e}, '[^\\x00-\\x7F]', '_', 'g')"


LINES = rf"""
raw_lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(len(string_split(text, chr(10))))) AS unit_seq
  FROM documents),
lines AS (
  SELECT document_id, CAST(unit_seq AS BIGINT) AS unit_seq, CAST(unit_seq // 20 + 1 AS INTEGER) AS page,
         'page_' || (unit_seq // 20 + 1) AS source, 'text' AS type, {strip('raw')} AS text
  FROM raw_lines WHERE regexp_matches(raw, '\S'))"""

FACTS = """
facts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS document_id, 'c' || o_orderkey AS chunk_id, o_orderkey AS chunk_seq,
    CASE o_orderkey % 6
      WHEN 0 THEN 'Revenue increased from ' || (o_orderkey % 90 + 10) || ' million to ' || (o_orderkey % 70 + 110) || ' million. Margin reached ' || year(o_orderdate) || '.'
      WHEN 1 THEN 'Cost fell from ' || (o_orderkey % 70 + 110) || ' million to ' || (o_orderkey % 90 + 10) || ' million. Budget was set in ' || year(o_orderdate) || '.'
      WHEN 2 THEN 'LSTM is used for forecast. BERT improves revenue.'
      WHEN 3 THEN 'Sales rose from ' || year(o_orderdate) || ' to ' || (year(o_orderdate) + 1) || '. Transformer supports profit.'
      WHEN 4 THEN 'GPT and CNN met. Ebitda was flat in ' || year(o_orderdate) || ' and ' || (year(o_orderdate) + 1) || '.'
      ELSE 'Nothing here.' END AS text
  FROM orders)"""


def labels(source: str, target: str, raw: str = "raw", out: str = "label") -> str:
    """Steps that add the canonical label of a column."""
    return rf"""
{target}_1 AS (SELECT *, {squeeze(f"lower({strip(raw)})")} AS s1 FROM {source}),
{target}_2 AS (SELECT *, CASE
    WHEN length(s1) = 0 OR length(s1) > 64 OR s1 IN ({_quoted(STOP_LABELS)})
      OR (regexp_matches(s1, '^(in|the|a|an)\s+') AND length(s1) > 24)
      OR (contains(s1, ',') AND length(s1) > 32) THEN ''
    WHEN regexp_matches(s1, '(…|\.\.\.)$') THEN {strip("regexp_replace(s1, '[….]+$', '')")}
    ELSE s1 END AS s2 FROM {target}_1),
{target} AS (SELECT * EXCLUDE (s1, s2), CASE WHEN length(s2) < 2 THEN ''
    ELSE substr({_case('s2', LABEL_SYNONYMS, 's2')}, 1, 200) END AS {out} FROM {target}_2)"""


def entity_steps(source: str) -> str:
    """``ents(cid, position, label, type)`` of a table with ``cid, text``."""
    def found(rank: int, kind: str, pattern: str, group: int, flags: str, extra: str = "") -> str:
        call = f"regexp_extract_all({asc('text')}, '{pattern}', {group}{flags})"
        return (f"SELECT cid, {rank} AS p, '{kind}' AS type, unnest({call}) AS raw, "
                f"unnest(range(len({call}))) AS i FROM {source}")

    parts = [
        found(1, "date", x.YEAR, 1, ""), found(2, "number", x.AMOUNT, 0, ", 'i'"),
        found(3, "concept", x.ML_TERM, 1, ", 'i'"), found(4, "metric", x.FINANCE_TERM, 1, ", 'i'"),
    ]
    phrases = f"SELECT * FROM ({found(5, 'concept', x.PHRASE, 1, '')}) WHERE length(raw) < 28"
    return f"""
cand AS ({' UNION ALL '.join(parts)} UNION ALL {phrases}),
{labels('cand', 'cand_labels')},
ents AS (
  SELECT cid, label, type, CAST(row_number() OVER (PARTITION BY cid ORDER BY p, i) - 1 AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY cid, label ORDER BY p, i) AS n FROM cand_labels WHERE label <> '')
  WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY p, i) <= 24)"""


FACT_ENTITIES = FACTS + ", fact_texts AS (SELECT chunk_id AS cid, text FROM facts)," + entity_steps("fact_texts")


def _relation_steps() -> str:
    def captured(rule: int, pattern: str, a: int, b: int, kind: str) -> str:
        first = f"regexp_extract_all(lower(text), '{pattern}', {a})"
        second = f"regexp_extract_all(lower(text), '{pattern}', {b})"
        return (f"SELECT cid, {rule} AS rule, 0 AS sent, unnest(range(len({first}))) AS i, 0 AS j, "
                f"unnest({first}) AS a_raw, unnest({second}) AS b_raw, '{kind}' AS type FROM fact_texts")

    def words(name: str, pattern: str, group: int, flags: str) -> str:
        call = f"regexp_extract_all(s, '{pattern}', {group}{flags})"
        return f"{name} AS (SELECT cid, sent, s, unnest({call}) AS w, unnest(range(len({call}))) AS i FROM sents)"

    escaped = lambda p: p.replace("\\n", "\n")
    return f"""
sents AS (SELECT cid, unnest({sentences('text')}) AS s, unnest(range(len({sentences('text')}))) AS sent FROM fact_texts),
{words('nums', x.SENTENCE_NUMBER, 0, '')},
{words('fins', x.FINANCE_TERM, 1, ", 'i'")},
{words('mls', x.ML_TERM, 1, ", 'i'")},
rel_raw AS (
  {captured(1, escaped(x.ROSE), 2, 3, 'INCREASED_FROM')} UNION ALL
  {captured(2, escaped(x.FELL), 2, 3, 'DECREASED_FROM')} UNION ALL
  {captured(3, escaped(x.IS_USED_FOR), 1, 2, 'USED_FOR')} UNION ALL
  {captured(4, escaped(x.USED_FOR), 1, 2, 'USED_FOR')} UNION ALL
  SELECT f.cid, 5, f.sent, f.i, n.i, f.w, n.w, 'HAS_VALUE' FROM fins f JOIN nums n ON f.cid = n.cid AND f.sent = n.sent
  UNION ALL
  SELECT m.cid, 6, m.sent, m.i, f.i, m.w, f.w, 'RELATED_TO' FROM mls m JOIN fins f ON m.cid = f.cid AND m.sent = f.sent
  WHERE length(m.s) <= 160),
{labels('rel_raw', 'rel_a', 'a_raw', 'source')},
{labels('rel_a', 'rel_b', 'b_raw', 'target')},
rel_known AS (
  SELECT r.cid, r.source, r.target, r.type, min((r.rule, r.sent, r.i, r.j)) AS o
  FROM rel_b r JOIN ents a ON r.cid = a.cid AND r.source = a.label JOIN ents b ON r.cid = b.cid AND r.target = b.label
  WHERE NOT (r.rule = 6 AND r.source = r.target)
  GROUP BY r.cid, r.source, r.target, r.type),
rels AS (
  SELECT cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY o) - 1 AS INTEGER) AS position, source, target, type
  FROM rel_known QUALIFY row_number() OVER (PARTITION BY cid ORDER BY o) <= 16)"""


FACT_GRAPH = FACT_ENTITIES + "," + _relation_steps() + """,
sizes AS (
  SELECT f.document_id, f.chunk_id, f.chunk_seq, f.text,
    (SELECT count(*) FROM ents e WHERE e.cid = f.chunk_id) AS n_e, (SELECT count(*) FROM rels r WHERE r.cid = f.chunk_id) AS n_r
  FROM facts f),
conf AS (
  SELECT *, greatest(0.0, least(1.0, least(1.0, n_e * 0.12::DOUBLE + n_r * 0.18::DOUBLE)
    + least(0.25::DOUBLE, length(text) / 2000.0::DOUBLE) * 0.5::DOUBLE + CASE WHEN n_r > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence
  FROM sizes),
ment AS (
  SELECT f.document_id, f.chunk_id, f.chunk_seq, f.document_id || '::' || e.label AS graph_key, e.label AS name, e.type AS entity_type
  FROM ents e JOIN facts f ON e.cid = f.chunk_id),
relr AS (
  SELECT f.document_id, f.chunk_id, f.document_id || '::' || r.source AS from_key, f.document_id || '::' || r.target AS to_key,
    r.source AS from_name, r.target AS to_name, r.type AS rel_type
  FROM rels r JOIN facts f ON r.cid = f.chunk_id),
edges AS (SELECT DISTINCT document_id, from_key, to_key, from_name, to_name, rel_type FROM relr),
nodes AS (
  SELECT document_id, graph_key, max_by(name, chunk_seq) AS name, max_by(entity_type, chunk_seq) AS entity_type
  FROM ment GROUP BY document_id, graph_key),
ends AS (SELECT document_id, from_key AS graph_key FROM relr UNION ALL SELECT document_id, to_key FROM relr),
freq AS (
  SELECT document_id, graph_key, arg_min(entity_type, chunk_seq) AS entity_type, count(*) AS frequency, count(DISTINCT chunk_id) AS chunks
  FROM ment GROUP BY document_id, graph_key),
scores AS (
  SELECT f.document_id, f.graph_key, frequency, chunks, coalesce(d.n, 0) AS degree,
    frequency * 2.0::DOUBLE + coalesce(d.n, 0) * 3.0::DOUBLE + CASE WHEN chunks > 1 THEN 4.0::DOUBLE ELSE 0 END
    + CASE WHEN entity_type IN ('number', 'metric', 'date') THEN 2.0::DOUBLE ELSE 0 END AS score
  FROM freq f LEFT JOIN (SELECT document_id, graph_key, count(*) AS n FROM ends GROUP BY ALL) d USING (document_id, graph_key)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, graph_key) AS rank FROM scores),
deg AS (
  SELECT n.document_id, n.graph_key, coalesce(c.n, 0) AS degree
  FROM nodes n LEFT JOIN (
    SELECT document_id, graph_key, count(*) AS n FROM (
      SELECT document_id, graph_key FROM ment UNION ALL SELECT document_id, from_key FROM edges
      UNION ALL SELECT document_id, to_key FROM edges WHERE from_key <> to_key) GROUP BY ALL) c USING (document_id, graph_key)),
snap_nodes AS (
  SELECT document_id, 'chunk:' || chunk_id AS id, 'page_1' AS name, 1 AS "group", 'chunk' AS entity_type, -1 AS community_id, CAST(1 AS BIGINT) AS val FROM facts
  UNION ALL
  SELECT document_id, graph_key, substr(name, 1, 60), 2, entity_type, -1, greatest(1, d.degree) FROM nodes JOIN deg d USING (document_id, graph_key)),
snap_links AS (
  SELECT document_id, 'chunk:' || chunk_id AS source, graph_key AS target, 'MENTIONS' AS type FROM ment
  UNION ALL SELECT document_id, from_key, to_key, rel_type FROM edges)"""

QUESTIONS = r"""
asked AS (
  SELECT c_custkey AS query_id, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS VARCHAR) END AS document_id,
    CASE c_custkey % 5
      WHEN 0 THEN 'What was revenue and cost in ' || (c_custkey % 7 + 1992) || '?'
      WHEN 1 THEN 'How did margin develop in ' || (c_custkey % 7 + 1992) || '?'
      WHEN 2 THEN 'Which model supports the profit forecast'
      WHEN 3 THEN 'Sales trends with AI usage'
      ELSE 'Budget of ' || (c_custkey % 7 + 1992) END AS query
  FROM customer),
terms AS (
  SELECT *, list_concat(regexp_extract_all(query, '\b(19\d{2}|20\d{2})\b', 1),
      list_transform(regexp_extract_all(query, '\b(revenue|cost|profit|earnings|margin|sales|income|expense)\b', 1, 'i'), lambda w: lower(w))) AS terms,
    regexp_matches(lower(query), '\b(and|together|both|combined|also|additionally)\b')
      OR (contains(lower(query), 'trends') AND (contains(lower(query), 'ai') OR contains(lower(query), 'usage'))) AS multi_topic
  FROM asked),
qs AS (SELECT *, CASE WHEN multi_topic THEN 12 ELSE 8 END AS k FROM terms)"""


def _hashed(source: str, key: str, text: str, out: str) -> str:
    """Word counts in 64 hashed buckets, as a list of 64 numbers."""
    return f"""
{out}_b AS (SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS b, count(*) AS c
  FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {source}) GROUP BY ALL),
{out} AS (SELECT {key}, map_from_entries(list((b, c))) AS m, CAST(sum(c * c) AS DOUBLE) AS norm FROM {out}_b GROUP BY {key})"""


# Questions, fact chunks and their hits. Texts repeat, so vectors are compared once for each pair of
# distinct texts.
HITS = QUESTIONS + "," + f"""
kw AS (
  SELECT query_id, chunk_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY chunk_seq) AS rank, k
  FROM qs JOIN facts USING (document_id)
  WHERE len(terms) > 0 AND len(list_filter(terms, lambda w: NOT contains(lower(text), w))) = 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_seq) <= k),
q_texts AS (SELECT DISTINCT query FROM asked),
f_texts AS (SELECT DISTINCT text FROM facts),
{_hashed('q_texts', 'query', 'query', 'qv')},
{_hashed('f_texts', 'text', 'text', 'fv')},
dots AS (
  SELECT q.query, f.text, CAST(sum(q.c * f.c) AS DOUBLE) AS dot FROM qv_b q JOIN fv_b f ON q.b = f.b GROUP BY ALL),
sims AS (
  SELECT qv.query, fv.text, floor(coalesce(dot, 0) / sqrt(qv.norm * fv.norm) * 1e6 + 0.5) / 1e6 AS score
  FROM qv CROSS JOIN fv LEFT JOIN dots ON dots.query = qv.query AND dots.text = fv.text),
vh AS (
  SELECT query_id, chunk_id, score, rank, k FROM (
    SELECT q.query_id, f.chunk_id, s.score, q.k, row_number() OVER (PARTITION BY q.query_id ORDER BY s.score DESC, f.chunk_id) AS rank
    FROM qs q JOIN facts f ON q.document_id IS NULL OR q.document_id = f.document_id
    JOIN sims s ON s.query = q.query AND s.text = f.text) WHERE rank <= k),
merged AS (
  SELECT query_id, chunk_id, k, min((o, rank, score)) AS b FROM (
    SELECT *, 0 AS o FROM kw UNION ALL BY NAME SELECT *, 1 AS o FROM vh) GROUP BY ALL),
hits AS (
  SELECT query_id, chunk_id, b[3] AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], chunk_id) AS INTEGER) AS rank, k
  FROM merged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], chunk_id) <= k),
hent AS (SELECT h.query_id, h.chunk_id, h.rank, m.graph_key, m.name, q.document_id AS scope
  FROM hits h JOIN ment m USING (chunk_id) JOIN qs q USING (query_id)),
xnodes AS (SELECT DISTINCT query_id, graph_key, name, scope FROM hent),
xedges AS (
  SELECT a.query_id, e.from_key AS source, e.to_key AS target, e.rel_type AS type, a.scope
  FROM xnodes a JOIN edges e ON a.graph_key = e.from_key JOIN xnodes b ON b.query_id = a.query_id AND b.graph_key = e.to_key
  QUALIFY a.scope IS NOT NULL OR row_number() OVER (PARTITION BY a.query_id ORDER BY e.from_key, e.to_key, e.rel_type) <= 100),
cedges AS (
  SELECT x.query_id, s.chunk_id, x.source, x.target, x.type FROM xedges x
  JOIN hent s ON s.query_id = x.query_id AND s.graph_key = x.source
  JOIN hent t ON t.query_id = x.query_id AND t.chunk_id = s.chunk_id AND t.graph_key = x.target),
ctx AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position FROM (
    SELECT h.query_id, h.rank, h.chunk_id, f.text, EXISTS (SELECT 1 FROM ents e WHERE e.cid = h.chunk_id) AS in_graph,
      row_number() OVER (PARTITION BY h.query_id, {squeeze("lower(substr(f.text, 1, 400))")} ORDER BY h.rank) AS n
    FROM hits h JOIN facts f USING (chunk_id)) WHERE n = 1),
trip AS (
  SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS position,
    '(' || split_part(source, '::', 2) || ')-[' || type || ']->(' || split_part(target, '::', 2) || ')' AS triple, source, target, type
  FROM xedges WINDOW w AS (PARTITION BY query_id ORDER BY source, target, type) QUALIFY row_number() OVER w <= 30),
shown AS (
  SELECT query_id, position, chunk_id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, {squeeze("lower(substr(text, 1, 150))")} ORDER BY position) AS n
    FROM ctx WHERE position <= 3) WHERE n = 1),
cites AS (SELECT query_id, position, chunk_id, text FROM ctx WHERE position <= 5)"""

RETRIEVAL = FACT_GRAPH + "," + HITS

FEED = "feed AS (SELECT user_id AS session_id, event_id AS seq, event_type AS type, ts, json_extract_string(props, '$.k') AS k FROM events)"

def _adjacent(source: str, key: str, name: str) -> str:
    """``{name}_sent`` and ``{name}_adj`` of a table with a key and a sentence list ``sl``."""
    return f"""
{name}_sent AS (SELECT {key}, unnest(sl) AS s, unnest(range(1, len(sl) + 1)) AS i FROM {source}),
{name}_cnt AS (SELECT {key}, i, t, count(*) AS c FROM (SELECT {key}, i, unnest({tokens('s')}) AS t FROM {name}_sent) GROUP BY ALL),
{name}_nrm AS (SELECT {key}, i, CAST(sum(c * c) AS DOUBLE) AS n FROM {name}_cnt GROUP BY ALL),
{name}_dot AS (SELECT x.{key}, x.i, CAST(sum(x.c * y.c) AS DOUBLE) AS d FROM {name}_cnt x JOIN {name}_cnt y ON x.{key} = y.{key} AND y.i = x.i + 1 AND x.t = y.t GROUP BY ALL),
{name}_adj AS (
  SELECT s.{key}, s.i AS position, coalesce(d.d / sqrt(a.n * b.n), 0.0::DOUBLE) AS similarity
  FROM {name}_sent s JOIN {name}_sent s2 ON s2.{key} = s.{key} AND s2.i = s.i + 1
  LEFT JOIN {name}_dot d ON d.{key} = s.{key} AND d.i = s.i
  LEFT JOIN {name}_nrm a ON a.{key} = s.{key} AND a.i = s.i
  LEFT JOIN {name}_nrm b ON b.{key} = s.{key} AND b.i = s.i + 1)"""


# Each document as one block of sentences, and the word-count cosine of neighbours.
DOC_SENTENCES = f"""
doc_s AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text, {sentences('text')} AS sl FROM documents),
sent AS (SELECT document_id, unnest(sl) AS s, unnest(range(1, len(sl) + 1)) AS i FROM doc_s),
cnt AS (SELECT document_id, i, t, count(*) AS c FROM (SELECT document_id, i, unnest({tokens('s')}) AS t FROM sent) GROUP BY ALL),
nrm AS (SELECT document_id, i, CAST(sum(c * c) AS DOUBLE) AS n FROM cnt GROUP BY ALL),
dot AS (SELECT a.document_id, a.i, CAST(sum(a.c * b.c) AS DOUBLE) AS d FROM cnt a JOIN cnt b ON a.document_id = b.document_id AND b.i = a.i + 1 AND a.t = b.t GROUP BY ALL),
adj AS (
  SELECT s.document_id, s.i AS position, coalesce(d.d / sqrt(a.n * b.n), 0.0::DOUBLE) AS similarity
  FROM sent s JOIN sent s2 ON s2.document_id = s.document_id AND s2.i = s.i + 1
  LEFT JOIN dot d ON d.document_id = s.document_id AND d.i = s.i
  LEFT JOIN nrm a ON a.document_id = s.document_id AND a.i = s.i
  LEFT JOIN nrm b ON b.document_id = s.document_id AND b.i = s.i + 1)"""


def _packing(units: str, limit: int) -> str:
    """Blocks of ``units(document_id, unit_seq, n, page, header, tokens, text)``, walked unit by unit."""
    return f"""
walk AS (
  SELECT document_id, n, unit_seq, page, tokens AS run, unit_seq AS block_seq FROM {units} WHERE n = 1
  UNION ALL
  SELECT u.document_id, u.n, u.unit_seq, u.page,
    CASE WHEN u.page <> w.page OR u.header OR w.run + u.tokens > {limit} THEN u.tokens ELSE w.run + u.tokens END,
    CASE WHEN u.page <> w.page OR u.header OR w.run + u.tokens > {limit} THEN u.unit_seq ELSE w.block_seq END
  FROM walk w JOIN {units} u ON u.document_id = w.document_id AND u.n = w.n + 1)"""


HEADER = rf"""(length(text) <= 120 AND (
    regexp_matches(text, '(?i)^Section\s+\d+\s*[:\.]') OR regexp_matches(text, '^#+\s+\w')
    OR regexp_matches({asc('text')}, '^[\d\.\-]+\s+\w+')
    OR (text = upper(text) AND text <> lower(text) AND length(text) < 80)))"""

NORMAL = rf"""regexp_replace(regexp_replace({strip(squeeze(rf"regexp_replace(lower({strip('text')}), '[^\p{{L}}\p{{N}}_\s.\-]', ' ', 'g')"))},
    '\b(\d+)\s*(?:million|mn|m)\b', '\1m', 'g'), '\b(\d+)\s*(?:billion|bn|b)\b', '\1b', 'g')"""
NORMAL_ASCII = f"{NORMAL}"


def _topk(where: str, k: int) -> str:
    return f"""
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, s.score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, CAST(v.vec_id AS VARCHAR)) AS rank
  FROM embeddings q JOIN embeddings v ON {where},
  LATERAL (SELECT floor(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS score) s)
WHERE rank <= {k}"""


def _merged(preferred: str, other: str) -> str:
    numbers = lambda e: rf"regexp_extract_all({e}, '\b\d+(?:\.\d+)?\b')"
    extra = (f"array_to_string(list_sort(list_distinct(list_filter({numbers(other)}, "
             f"lambda n: NOT list_contains({numbers(preferred)}, n))))[1:5], ' ')")
    return (f"CASE WHEN {extra} <> '' AND length({preferred}) < length({other}) * 1.2 AND NOT contains({preferred}, {extra}) "
            f"THEN {preferred} || ' ' || {extra} ELSE {preferred} END")


MIXED = LINES + """,
mixed AS (
  SELECT document_id, page, source, unit_seq * 3 AS unit_seq, 'text' AS type, text, false AS seen FROM lines
  UNION ALL SELECT document_id, page, source, unit_seq * 3 + 1, ['text', 'table', 'image'][length(text) % 3 + 1], text || ' ' || (unit_seq % 7), false FROM lines
  UNION ALL SELECT document_id, page, source, unit_seq * 3 + 2, 'image', text || ' item', length(text) % 2 = 0 FROM lines)"""


def _near_copies(source: str, seen: str = "false") -> str:
    """Steps of the ordered merge over a table of units, with every pair of units of a document compared."""
    slot = ("{'first': %s, 'stand': %s, 'page': %s, 'source': %s, 'type': %s, 'text': %s, 'form': %s, 'priority': %s, 'merged': %s}")
    win = lambda f: f"CASE WHEN up >= old.priority THEN u_{f} ELSE old.{f} END"
    fresh = slot % ("u_seq", "u_seq", "u_page", "u_source", "u_type", "u_text", "u_form", "up", "1")
    joined = slot % ("old.first", "CASE WHEN up >= old.priority THEN u_seq ELSE old.stand END", win("page"), win("source"), win("type"),
                     "text", NORMAL, "greatest(up, old.priority)", "old.merged + 1")
    return rf"""
formed AS (SELECT document_id, unit_seq, page, source, type, text, {NORMAL} AS form,
    CASE WHEN type = 'image' AND {seen} THEN 3 WHEN type = 'image' THEN 1 ELSE 2 END AS priority FROM {source}),
u AS (SELECT *, regexp_replace(form, '(\s+\d+(\.\d+)?)+$', '') AS base FROM formed
    QUALIFY row_number() OVER (PARTITION BY document_id, form ORDER BY unit_seq) = 1),
counts AS (SELECT document_id, unit_seq, word, count(*) AS n FROM (SELECT document_id, unit_seq, unnest({tokens('text')}) AS word FROM u) GROUP BY ALL),
norms AS (SELECT document_id, unit_seq, sum(n * n) AS norm FROM counts GROUP BY ALL),
dots AS (SELECT b.document_id, b.unit_seq, a.unit_seq AS earlier_seq, sum(a.n * b.n) AS dot
    FROM counts a JOIN counts b ON a.document_id = b.document_id AND a.word = b.word AND a.unit_seq < b.unit_seq GROUP BY ALL),
pairs AS (SELECT d.document_id, d.unit_seq, earlier_seq, dot::DOUBLE / sqrt(x.norm::DOUBLE * y.norm::DOUBLE) AS similarity
    FROM dots d JOIN norms x ON d.document_id = x.document_id AND d.unit_seq = x.unit_seq
    JOIN norms y ON d.document_id = y.document_id AND earlier_seq = y.unit_seq JOIN u ON u.document_id = d.document_id AND u.unit_seq = d.unit_seq
    WHERE length(form) >= 15 AND dot::DOUBLE / sqrt(x.norm::DOUBLE * y.norm::DOUBLE) >= 0.85),
ends AS (SELECT DISTINCT document_id, unit_seq FROM (SELECT document_id, unit_seq FROM pairs UNION ALL SELECT document_id, earlier_seq FROM pairs)),
member AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_seq) AS k FROM u
    WHERE (document_id, base) IN (SELECT (document_id, base) FROM u SEMI JOIN ends USING (document_id, unit_seq))),
linked AS (SELECT m.*, coalesce(l.links, MAP {{}}) AS links FROM member m LEFT JOIN (
    SELECT document_id, unit_seq, map_from_entries(list(({{'k': earlier_seq, 'v': similarity}}))) AS links FROM pairs GROUP BY ALL) l USING (document_id, unit_seq)),
fold(document_id, k, slots, merge) AS (
  SELECT DISTINCT document_id, 0::BIGINT, []::STRUCT("first" BIGINT, stand BIGINT, page INTEGER, source VARCHAR, "type" VARCHAR, "text" VARCHAR, form VARCHAR, priority INTEGER, merged INTEGER)[],
    NULL::STRUCT(unit_seq BIGINT, kept_seq BIGINT, similarity DOUBLE) FROM member
  UNION ALL
  SELECT document_id, k, CASE WHEN place = 0 THEN list_append(slots, {fresh}) ELSE list_concat(slots[1:place - 1], [{joined}], slots[place + 1:]) END,
    CASE WHEN place > 0 THEN {{'unit_seq': u_seq, 'kept_seq': old.first, 'similarity': sim}} END
  FROM (SELECT *, CASE WHEN place = 0 THEN u_text WHEN up >= old.priority THEN {_merged('u_text', 'old.text')} ELSE {_merged('old.text', 'u_text')} END AS text
    FROM (SELECT *, slots[place] AS old FROM (SELECT *,
      CASE WHEN length(u_form) < 15 THEN 0 WHEN same > 0 THEN same WHEN list_max(sims) >= 0.85 THEN list_position(sims, list_max(sims)) ELSE 0 END AS place,
      CASE WHEN same > 0 THEN 1.0 ELSE list_max(sims) END::DOUBLE AS sim
    FROM (SELECT f.document_id, f.k + 1 AS k, slots, l.unit_seq AS u_seq, l.page AS u_page, l.source AS u_source, l.type AS u_type, l.text AS u_text,
        l.form AS u_form, l.priority AS up, coalesce(list_position(list_transform(slots, lambda s: s.form), l.form), 0) AS same,
        list_transform(slots, lambda s: coalesce(links[s.stand], -1.0)) AS sims
      FROM fold f JOIN linked l ON f.document_id = l.document_id AND l.k = f.k + 1))))),
merges AS (SELECT document_id, merge.unit_seq AS unit_seq, merge.kept_seq AS kept_seq, merge.similarity AS similarity FROM fold WHERE merge IS NOT NULL),
merged AS (
  SELECT document_id, s.first AS unit_seq, s.page AS page, s.source AS source, s.type AS type, s.text AS text, s.merged AS merged_units
  FROM (SELECT document_id, unnest(arg_max(slots, k)) AS s FROM fold GROUP BY document_id)
  UNION ALL SELECT document_id, unit_seq, page, source, type, text, 1 FROM u ANTI JOIN member USING (document_id, unit_seq)),
star AS (SELECT document_id, base, min(unit_seq) AS first_seq FROM u SEMI JOIN ends USING (document_id, unit_seq) GROUP BY ALL),
edges AS (SELECT document_id, unit_seq AS a, earlier_seq AS b FROM pairs
  UNION ALL SELECT m.document_id, unit_seq, first_seq FROM member m JOIN star s ON m.document_id = s.document_id AND m.base = s.base AND unit_seq <> first_seq),
reached(document_id, a, b) AS (
  SELECT document_id, a, b FROM edges UNION SELECT document_id, b, a FROM edges
  UNION SELECT r.document_id, r.a, CASE WHEN e.a = r.b THEN e.b ELSE e.a END FROM reached r JOIN edges e ON r.document_id = e.document_id AND (e.a = r.b OR e.b = r.b))"""


def _part_labels() -> str:
    steps = (
        "parts AS (SELECT p_partkey, p_name, p_type, p_brand, '  The ' || p_name || ', ' || p_type || '...' AS odd, "
        "p_type || ' used-for ' || p_brand AS kind FROM part),"
        + labels("parts", "l1", "p_name", "name_label") + "," + labels("l1", "l2", "p_type", "type_label") + ","
        + labels("l2", "l3", "odd", "odd_label")
    )
    cleaned = "regexp_replace(regexp_replace(regexp_replace(upper(kind), '[^A-Z_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    loose = " ".join(f"WHEN contains(t, '{k}') OR contains('{k}', t) THEN '{k}'" for k in RELATION_TYPES)
    exact = {**{k: k for k in RELATION_TYPES}, **RELATION_ALIASES}
    return f"""WITH {steps}, l4 AS (SELECT *, {cleaned} AS t FROM l3)
SELECT p_partkey, name_label, type_label, odd_label, {_case('t', exact, f'CASE {loose} END')} AS rel_type FROM l4"""


def _oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["phrase_scores"] = f"""WITH {LINES}, lt AS (SELECT document_id || '#' || unit_seq AS cid, text FROM lines), {entity_steps('lt')},
s AS (SELECT label AS name, count(*) * 2.0::DOUBLE + CASE WHEN count(*) > 1 THEN 4.0::DOUBLE ELSE 0 END
  + CASE WHEN min(type) IN ('number', 'metric', 'date') THEN 2.0::DOUBLE ELSE 0 END AS score FROM ents GROUP BY label)
SELECT name, score, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score DESC, name) <= 20"""
    sql["units_from_lines"] = f"WITH {LINES} SELECT * FROM lines"
    sql["units_from_html"] = rf"""WITH t AS (SELECT CAST(page_id AS VARCHAR) AS document_id,
  {strip(squeeze(r"regexp_replace(regexp_replace(html, '(?is)<(style|script)[^>]*>.*?</(style|script)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))} AS text FROM pages)
SELECT * FROM t WHERE text <> ''"""
    size = "CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE '' END"
    sql["rows_to_table_text"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS document_id, 'page_1_table_0' AS source,
  'name | brand | size' || chr(10) || {strip('p_name')} || ' | ' || {strip('p_brand')} || ' | ' || {size} AS text,
  p_partkey || ' | ' || {strip('p_type')} || ' | ' || {size} AS row FROM part"""
    sql["image_text_units"] = """SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS page, 'page_' || turn || '_img_0' AS source, 'image' AS type, text
FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '\\S')""".replace("\\\\", "\\")
    sql["chart_fallback"] = f"""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS page, text,
  {strip("CASE WHEN role = 'assistant' THEN text ELSE '' END")} AS own FROM conversations),
c AS (SELECT *, CASE WHEN length(own) > 0 THEN own WHEN length({strip('text')}) > 20 THEN {strip(f"substr({strip('text')}, 1, 2000)")} END AS t FROM p)
SELECT document_id, page, 'page_' || page || '_chart' AS source, t AS text FROM c WHERE t IS NOT NULL AND regexp_matches(t, '\\S')""".replace("\\\\S", "\\S")
    sql["gather_units"] = f"""WITH {LINES}, talk AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, role, text FROM conversations)
SELECT document_id, unit_seq, page, source, type, text FROM lines
UNION ALL
SELECT document_id, turn + 1099511627776, CAST(turn AS INTEGER), 'page_' || turn, 'table', {strip('CASE WHEN turn > 1 THEN text ELSE lower(text) END')} FROM talk WHERE role = 'user' AND regexp_matches(text, '\\S')
UNION ALL
SELECT document_id, turn + 2199023255552, CAST(turn AS INTEGER), 'page_' || turn, 'image', {strip('text')} FROM talk WHERE role = 'assistant' AND regexp_matches(text, '\\S')""".replace("\\\\S", "\\S")
    sql["ascii_routing"] = f"""WITH {LINES}, r AS (SELECT *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / CAST(greatest(1, length(text)) AS DOUBLE) > 0.95 AS ok FROM lines)
SELECT document_id, unit_seq, NOT ok AS needs_translation, CASE WHEN ok THEN text ELSE substr(text, 1, 3000) END AS translation_input FROM r"""
    previews = {"text_preview": 2000, "original_preview": 600, "table_preview": 1500, "image_preview": 1200, "chunk_preview": 500}
    sql["event_previews"] = f"WITH {LINES} SELECT document_id, unit_seq, " + ", ".join(
        f"substr(text, 1, {n}) AS {k}" for k, n in previews.items()) + " FROM lines"

    # chunking
    words = rf"regexp_split_to_array({strip('text')}, '\s+')"
    sql["sentence_stats"] = f"""WITH {DOC_SENTENCES} SELECT document_id, count(*) AS sentences, CAST(sum({estimate('s')}) AS BIGINT) AS tokens, CAST(max(length(s)) AS INTEGER) AS longest FROM sent GROUP BY document_id"""
    sql["section_headers"] = f"""WITH {LINES}, h AS (SELECT document_id, unit_seq, page || ' ' || text AS text FROM lines)
SELECT document_id, unit_seq, text FROM h WHERE {HEADER}"""
    from ..functions.text import SALIENT_TERMS
    sql["salient_terms"] = f"""WITH {FACTS} SELECT chunk_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '{SALIENT_TERMS}', 1, 'i'), lambda w: lower(w)))) AS INTEGER) AS terms FROM facts"""
    sql["structural_blocks"] = f"""WITH RECURSIVE {LINES},
u AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_seq) AS n, {HEADER} AS header, {estimate('text')} AS tokens FROM lines),
{_packing('u', 400)}
SELECT w.document_id, block_seq, min(u.page) AS page, min(u.source) AS source, 'text' AS type, CAST(count(*) AS INTEGER) AS n_units, string_agg(u.text, chr(10) || chr(10) ORDER BY w.n) AS text
FROM walk w JOIN u ON u.document_id = w.document_id AND u.n = w.n GROUP BY w.document_id, block_seq"""
    sql["structural_blocks_facts"] = f"""WITH RECURSIVE {FACTS},
u AS (SELECT document_id, chunk_seq AS unit_seq, text, 1 AS page, false AS header, {estimate('text')} AS tokens,
  row_number() OVER (PARTITION BY document_id ORDER BY chunk_seq) AS n FROM facts),
{_packing('u', 60)}
SELECT w.document_id, block_seq, CAST(count(*) AS INTEGER) AS n_units, string_agg(u.text, chr(10) || chr(10) ORDER BY w.n) AS text
FROM walk w JOIN u ON u.document_id = w.document_id AND u.n = w.n GROUP BY w.document_id, block_seq"""
    sql["adjacent_similarity"] = f"WITH {DOC_SENTENCES} SELECT document_id, CAST(position AS INTEGER) AS position, round(similarity, 6) AS similarity FROM adj"
    sql["semantic_chunks"] = f"""WITH {DOC_SENTENCES},
g AS (SELECT s.document_id, s.i, s.s, sum(CASE WHEN a.similarity < 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY s.document_id ORDER BY s.i) AS piece
  FROM sent s LEFT JOIN adj a ON a.document_id = s.document_id AND a.position = s.i - 1)
SELECT g.document_id, CAST(piece AS INTEGER) AS piece, CASE WHEN len(any_value(d.sl)) <= 1 THEN any_value(d.text) ELSE string_agg(g.s, ' ' ORDER BY g.i) END AS text
FROM g JOIN doc_s d USING (document_id) GROUP BY g.document_id, piece"""
    sql["weakest_boundary"] = f"""WITH {DOC_SENTENCES} SELECT document_id, CAST(position AS INTEGER) AS position, round(similarity, 6) AS similarity FROM adj
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY similarity, position) = 1"""
    sql["entity_refine"] = f"""WITH {DOC_SENTENCES},
weak AS (SELECT document_id, position, similarity FROM adj QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY similarity, position) = 1),
cut AS (SELECT d.document_id, d.text, array_to_string(sl[1:w.position], ' ') AS l, array_to_string(sl[w.position + 1:], ' ') AS r,
  {estimate('d.text')} >= 80 AND len(sl) >= 3 AND w.similarity <= 0.1 AS ok FROM doc_s d LEFT JOIN weak w USING (document_id)),
cut2 AS (SELECT *, coalesce(ok AND {estimate('l')} >= 75 AND {estimate('r')} >= 75, false) AS yes FROM cut)
SELECT document_id, 0 AS half, CASE WHEN yes THEN l ELSE text END AS text FROM cut2 UNION ALL SELECT document_id, 1, r FROM cut2 WHERE yes"""
    sql["size_windows"] = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text, {words} AS w FROM documents),
e AS (SELECT document_id, unnest(range(0, greatest(len(w), 1), 399)) AS st, w FROM d WHERE {estimate('text')} > 400),
seg AS (SELECT document_id, st, array_to_string(w[st + 1:st + 400], ' ') AS text FROM e)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY st) - 1 AS INTEGER) AS segment, text FROM seg WHERE {estimate('text')} >= 150
UNION ALL SELECT document_id, 0, text FROM d WHERE {estimate('text')} <= 400"""
    sql["coherence"] = f"""WITH {DOC_SENTENCES}, m AS (SELECT document_id, avg(similarity) AS a FROM adj GROUP BY document_id)
SELECT document_id, round(CASE WHEN len(sl) <= 1 THEN 0.95::DOUBLE ELSE a END, 6) AS score, round(CASE WHEN len(sl) <= 1 THEN 0.95::DOUBLE ELSE a END, 6) >= 0.1 AS kept
FROM doc_s LEFT JOIN m USING (document_id)"""
    stages = f"""WITH RECURSIVE {LINES},
u AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_seq) AS n, {HEADER} AS header, {estimate('text')} AS tokens FROM lines),
{_packing('u', 400)},
blocks AS (SELECT w.document_id, w.block_seq, string_agg(u.text, chr(10) || chr(10) ORDER BY w.n) AS text
  FROM walk w JOIN u ON u.document_id = w.document_id AND u.n = w.n GROUP BY w.document_id, w.block_seq),
bs AS (SELECT document_id || '#' || block_seq AS b, document_id, text, {sentences('text')} AS sl FROM blocks),
{_adjacent('bs', 'b', 's1')},
g AS (SELECT s.b, s.i, s.s, sum(CASE WHEN a.similarity < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY s.b ORDER BY s.i) AS p
  FROM s1_sent s LEFT JOIN s1_adj a ON a.b = s.b AND a.position = s.i - 1),
piece AS (SELECT g.b || '/' || p AS pk, any_value(bs.document_id) AS document_id,
    CASE WHEN len(any_value(bs.sl)) <= 1 THEN any_value(bs.text) ELSE string_agg(g.s, ' ' ORDER BY g.i) END AS text FROM g JOIN bs USING (b) GROUP BY g.b, p),
ps AS (SELECT pk, document_id, text, {sentences('text')} AS sl FROM piece),
{_adjacent('ps', 'pk', 's2')},
weak AS (SELECT pk, position, similarity FROM s2_adj QUALIFY row_number() OVER (PARTITION BY pk ORDER BY similarity, position) = 1),
cut AS (SELECT ps.pk, ps.document_id, ps.text, array_to_string(sl[1:w.position], ' ') AS l, array_to_string(sl[w.position + 1:], ' ') AS r,
  {estimate('ps.text')} >= 80 AND len(sl) >= 3 AND w.similarity <= 0.42 AS ok FROM ps LEFT JOIN weak w ON w.pk = ps.pk),
cut2 AS (SELECT *, coalesce(ok AND {estimate('l')} >= 75 AND {estimate('r')} >= 75, false) AS yes FROM cut),
refined AS (SELECT pk || '/0' AS d, document_id, CASE WHEN yes THEN l ELSE text END AS text FROM cut2 UNION ALL SELECT pk || '/1', document_id, r FROM cut2 WHERE yes),
rw AS (SELECT d, document_id, {words} AS w FROM refined WHERE {estimate('text')} > 400),
re AS (SELECT d, document_id, unnest(range(0, greatest(len(w), 1), 399)) AS st, w FROM rw),
rs AS (SELECT d || '/' || st AS e, document_id, array_to_string(w[st + 1:st + 400], ' ') AS text FROM re),
sized AS (SELECT * FROM rs WHERE {estimate('text')} >= 150 UNION ALL SELECT d || '/', document_id, text FROM refined WHERE {estimate('text')} <= 400),
zs AS (SELECT e, document_id, {sentences('text')} AS sl FROM sized),
{_adjacent('zs', 'e', 's3')},
scored AS (SELECT zs.e, zs.document_id, CASE WHEN len(sl) <= 1 THEN 0.95::DOUBLE ELSE m.a END AS score FROM zs LEFT JOIN (SELECT e, avg(similarity) AS a FROM s3_adj GROUP BY e) m USING (e))"""
    sql["chunk_stats"] = stages + """,
counts AS (
  SELECT document_id, 'a' AS k, count(*) AS n FROM bs GROUP BY 1 UNION ALL SELECT document_id, 'b', count(*) FROM piece GROUP BY 1
  UNION ALL SELECT document_id, 'c', count(*) FROM refined GROUP BY 1 UNION ALL SELECT document_id, 'd', count(*) FROM sized GROUP BY 1
  UNION ALL SELECT document_id, 'e', count(*) FROM scored WHERE score >= 0.05 GROUP BY 1)
SELECT document_id, CAST(sum(CASE WHEN k = 'a' THEN n END) AS BIGINT) AS structural, CAST(sum(CASE WHEN k = 'b' THEN n END) AS BIGINT) AS semantic,
  CAST(sum(CASE WHEN k = 'c' THEN n END) AS BIGINT) AS refined, CAST(coalesce(sum(CASE WHEN k = 'd' THEN n END), 0) AS BIGINT) AS sized,
  CAST(coalesce(sum(CASE WHEN k = 'e' THEN n END), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(CASE WHEN k = 'd' THEN n END), 0) - coalesce(sum(CASE WHEN k = 'e' THEN n END), 0) AS BIGINT) AS dropped
FROM counts GROUP BY document_id"""
    sql["chunk_documents"] = stages + """,
kept AS (
  SELECT e, document_id, score, CAST(split_part(split_part(e, '#', 2), '/', 1) AS BIGINT) AS block_seq, CAST(split_part(e, '/', 2) AS BIGINT) AS p,
    CAST(split_part(e, '/', 3) AS BIGINT) AS h, coalesce(TRY_CAST(split_part(e, '/', 4) AS BIGINT), 0) AS st FROM scored WHERE score >= 0.05),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_seq, p, h, st) - 1 AS chunk_seq FROM kept)
SELECT n.document_id, sha256(n.document_id || '#' || n.chunk_seq) AS chunk_id, n.chunk_seq, z.text, l.source, l.page, 'text' AS type, round(n.score, 6) AS coherence_score
FROM numbered n JOIN sized z USING (e) JOIN lines l ON l.document_id = n.document_id AND l.unit_seq = n.block_seq"""
    sql["chunk_numbers"] = f"""WITH {DOC_SENTENCES}, j AS (SELECT document_id, CASE WHEN len(sl) <= 1 THEN text ELSE array_to_string(sl, ' ') END AS text FROM doc_s),
d AS (SELECT document_id, text, {words} AS w FROM j),
e AS (SELECT document_id, unnest(range(0, greatest(len(w), 1), 399)) AS st, w FROM d WHERE {estimate('text')} > 400),
seg AS (SELECT document_id, st, array_to_string(w[st + 1:st + 400], ' ') AS text FROM e),
k AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY st) - 1 AS BIGINT) AS chunk_seq, text FROM seg WHERE {estimate('text')} >= 150
UNION ALL SELECT document_id, 0, text FROM d WHERE {estimate('text')} <= 400)
SELECT document_id, chunk_seq, sha256(document_id || '#' || chunk_seq) AS chunk_id, text FROM k"""

    # deduplication
    sql["normal_forms"] = f"WITH {FACTS} SELECT chunk_id, {NORMAL} AS form FROM facts"
    sql["exact_dedup"] = f"""SELECT min(doc_id) AS unit_seq, sha256({NORMAL}) AS content_hash FROM documents WHERE regexp_matches(text, '\\S') GROUP BY 2""".replace("\\\\S", "\\S")
    sql["exact_dedup_stats"] = f"""WITH {LINES} SELECT document_id, count(*) AS units, count(*) - count(DISTINCT {NORMAL}) AS removed_by_hash FROM lines GROUP BY document_id"""
    sql["similar_pairs"] = f"WITH RECURSIVE {LINES}, {_near_copies('lines')} SELECT document_id, unit_seq, earlier_seq, round(similarity, 6) AS similarity FROM pairs"
    sql["greedy_merge"] = f"WITH RECURSIVE {LINES}, {_near_copies('lines')} SELECT * FROM merged"
    mixed = f"WITH RECURSIVE {MIXED}, {_near_copies('mixed', 'seen')}"
    sql["mixed_merge"] = f"{mixed} SELECT * FROM merged"
    sql["merge_targets"] = f"{mixed} SELECT document_id, unit_seq, kept_seq, round(similarity, 6) AS similarity FROM merges"
    sql["dedup_stats"] = f"""{mixed} SELECT f.document_id, units, units - hashed AS removed_by_hash, hashed - kept AS removed_by_similarity, kept
FROM (SELECT document_id, count(*) AS units FROM formed GROUP BY 1) f JOIN (SELECT document_id, count(*) AS hashed FROM u GROUP BY 1) h USING (document_id)
JOIN (SELECT document_id, count(*) AS kept FROM merged GROUP BY 1) m USING (document_id)"""
    sql["near_copy_groups"] = f"""{mixed} SELECT document_id, group_seq, count(*) AS n_units
FROM (SELECT document_id, a, least(a, min(b)) AS group_seq FROM reached GROUP BY document_id, a) GROUP BY ALL"""
    sql["merge_rule"] = f"""WITH {FACTS}, p AS (SELECT document_id, chunk_seq AS unit_seq, text AS a, lag(text) OVER (PARTITION BY document_id ORDER BY chunk_seq) AS b FROM facts)
SELECT document_id, unit_seq, {_merged('a', 'b')} AS newer_wins, {_merged('b', 'a')} AS kept_wins FROM p WHERE b IS NOT NULL"""
    fp = squeeze(f"lower(substr({strip('text')}, 1, 400))")
    sql["prefix_dedup"] = f"""SELECT lang, min(doc_id) AS doc_id FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang, {fp}
UNION ALL SELECT lang, doc_id FROM documents WHERE NOT regexp_matches(text, '\\S')""".replace("\\\\S", "\\S")

    # extraction
    sql["entities_by_chunk"] = f"WITH {FACT_ENTITIES} SELECT cid AS chunk_id, position, label, type FROM ents"
    sql["phrases_by_line"] = f"""WITH {LINES}, lt AS (SELECT document_id || '#' || unit_seq AS cid, text FROM lines), {entity_steps('lt')}
SELECT split_part(cid, '#', 1) AS document_id, CAST(split_part(cid, '#', 2) AS BIGINT) AS unit_seq, position, label, type FROM ents"""
    sql["relations_by_chunk"] = f"WITH {FACT_GRAPH} SELECT cid AS chunk_id, position, source, target, type FROM rels"
    for name, kinds in {
        "rules_change": "'INCREASED_FROM', 'DECREASED_FROM'", "rules_used_for": "'USED_FOR'",
        "rules_has_value": "'HAS_VALUE'", "rules_related": "'RELATED_TO'",
    }.items():
        sql[name] = f"WITH {FACT_GRAPH} SELECT cid AS chunk_id, source, target, type FROM rels WHERE type IN ({kinds})"
    sql["extraction_confidence"] = f"""WITH {FACT_GRAPH} SELECT chunk_id, round(confidence, 6) AS confidence, confidence < 0.38 OR (n_e >= 3 AND n_r = 0) AS needs_augmentation FROM conf"""
    sql["label_forms"] = _part_labels()
    conf = """round(greatest(0.0, least(1.0, least(1.0, {e} * 0.12::DOUBLE + {r} * 0.18::DOUBLE) + least(0.25::DOUBLE, length(text) / 2000.0::DOUBLE) * 0.5::DOUBLE
    + CASE WHEN {r} > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)), 6)"""
    sql["tag_merge"] = f"""WITH {FACT_GRAPH},
tags AS (SELECT 'c' || o_orderkey AS cid, unnest([o_orderpriority, CAST(year(o_orderdate) AS VARCHAR), 'Clerk ' || o_custkey]) AS raw,
  unnest(['concept', 'date', 'number']) AS type, unnest([1, 2, 3]) AS i FROM orders),
{labels('tags', 'tagl')},
allm AS (SELECT cid, label, type, 0 AS o, position AS i FROM ents UNION ALL SELECT cid, label, type, 1, i FROM tagl WHERE label <> ''),
first AS (SELECT * FROM allm QUALIFY row_number() OVER (PARTITION BY cid, label ORDER BY o, i) = 1),
numbered AS (SELECT cid, label, type, CAST(row_number() OVER (PARTITION BY cid ORDER BY o, i) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY cid) AS n FROM first)
SELECT n.cid AS chunk_id, {conf.format(e='n.n', r='c.n_r')} AS confidence, n.position, n.label, n.type FROM numbered n JOIN conf c ON c.chunk_id = n.cid"""
    sql["response_merge"] = f"""WITH {FACT_GRAPH},
el AS (SELECT cid, string_agg(label || ':' || type, ';' ORDER BY position) AS l FROM ents GROUP BY cid),
rl AS (SELECT cid, string_agg(source || ':' || target || ':' || type, ';' ORDER BY position) AS l FROM rels GROUP BY cid),
m AS (SELECT c.*, (confidence < 0.38 OR (n_e >= 3 AND n_r = 0)) AS used, el.l AS e, coalesce(rl.l, '') AS r FROM conf c LEFT JOIN el ON el.cid = c.chunk_id LEFT JOIN rl ON rl.cid = c.chunk_id)
SELECT chunk_id, used AS used_response,
  CASE WHEN used THEN greatest(round(confidence, 6), {conf.format(e='(n_e + 2)', r='(n_r + 3)')}) ELSE round(confidence, 6) END AS confidence,
  CASE WHEN used THEN e || ';earnings:metric;outlook:concept' ELSE e END AS entities,
  CASE WHEN used THEN ltrim(r || ';nothing:outlook:USED_FOR;outlook:revenue:RELATED_TO;outlook:revenue:HAS_VALUE', ';') ELSE r END AS relationships FROM m"""
    sql["reuse_by_hash"] = f"""WITH {FACT_GRAPH},
el AS (SELECT cid, string_agg(label || ':' || type, ';' ORDER BY position) AS l FROM ents GROUP BY cid),
rl AS (SELECT cid, string_agg(source || ':' || target || ':' || type, ';' ORDER BY position) AS l FROM rels GROUP BY cid)
SELECT chunk_id, row_number() OVER (PARTITION BY text ORDER BY document_id, chunk_seq) > 1 AS reused,
  coalesce(el.l, '') AS entities, coalesce(rl.l, '') AS relationships
FROM sizes LEFT JOIN el ON el.cid = chunk_id LEFT JOIN rl ON rl.cid = chunk_id"""
    sql["tag_relations"] = f"""WITH {FACTS},
added AS (SELECT 'c' || o_orderkey AS cid, 'route planner ' || o_custkey AS planner, 'order tracking ' || year(o_orderdate) AS tracking, o_orderkey AS k FROM orders),
fact_texts AS (SELECT cid, text || ' ' || planner || ' is used for ' || tracking || '.' AS text FROM facts JOIN added ON cid = chunk_id),
{entity_steps("fact_texts").replace("ents AS (", "own AS (", 1)},
tagged AS (SELECT cid, planner AS raw, 1 AS i FROM added UNION ALL SELECT cid, tracking, 2 FROM added WHERE k % 4 > 0),
{labels("tagged", "tagged_labels")},
both_kinds AS (SELECT cid, label, type, 0 AS o, position AS i FROM own UNION ALL SELECT cid, label, 'concept', 1, i FROM tagged_labels WHERE label <> ''),
ents AS (SELECT cid, label, type FROM both_kinds QUALIFY row_number() OVER (PARTITION BY cid, label ORDER BY o, i) = 1),
{_relation_steps()},
n AS (SELECT t.*, (SELECT count(*) FROM ents e WHERE e.cid = t.cid) AS n_e, (SELECT count(*) FROM rels r WHERE r.cid = t.cid) AS n_r FROM fact_texts t)
SELECT cid AS chunk_id, {conf.format(e='n_e', r='n_r')} AS confidence, position, source AS from_label, target AS to_label, type FROM rels JOIN n USING (cid)"""
    sql["response_forms"] = f"""WITH base AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderpriority AS name, 'Year ' || year(o_orderdate) AS year, o_custkey FROM orders),
listed AS (
  SELECT o_orderkey, unnest([name, ' ' || year, '']) AS raw, unnest(['metric', 'concept', 'concept']) AS type, unnest([1, 2, 3]) AS i FROM base WHERE kind < 2
  UNION ALL SELECT o_orderkey, unnest([name, 'Customer ' || o_custkey]), 'concept', unnest([1, 2]) FROM base WHERE kind = 2),
{labels("listed", "named")},
joined AS (SELECT o_orderkey, string_agg(label || ':' || type, ';' ORDER BY i) AS l FROM named WHERE label <> '' GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(l, '') AS entities, CASE WHEN kind < 2 THEN name || ':' || year || ':uses' ELSE '' END AS relationships
FROM base LEFT JOIN joined USING (o_orderkey)"""
    sql["numbered_units"] = f"""SELECT p_brand AS document_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS unit_seq, p_size AS page,
  'page_' || p_size || '_table_' || p_partkey AS source, 'table' AS type, {strip('p_name')} || ' | ' || {strip('p_type')} AS text FROM part
UNION ALL
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, -p_partkey) - 1, p_size, 'page_' || p_size || '_img_' || (-p_partkey), 'image',
  coalesce(nullif(p_type, ''), p_name) FROM part WHERE p_partkey % 3 > 0 AND regexp_matches(p_name, '\\S')"""
    sql["scoped_degree"] = f"WITH {FACT_GRAPH} SELECT * FROM deg WHERE document_id = (SELECT min(document_id) FROM facts)"

    # graph
    def g(body: str) -> str:
        return f"WITH {FACT_GRAPH} {body}"

    sql["chunk_nodes"] = f"WITH {FACTS} SELECT document_id, chunk_id, text, 'page_1' AS source, 1 AS page FROM facts"
    sql["entity_nodes"] = g("SELECT * FROM nodes")
    sql["mention_edges"] = g("SELECT DISTINCT document_id, chunk_id, graph_key FROM ment")
    sql["relation_edges"] = g("SELECT from_key, to_key, rel_type FROM edges")
    sql["communities"] = f"""WITH RECURSIVE {FACT_GRAPH},
both_ways AS (SELECT from_key AS a, to_key AS b FROM edges UNION SELECT to_key, from_key FROM edges),
reach AS (SELECT graph_key AS a, graph_key AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
root AS (SELECT a AS graph_key, min(b) AS root FROM reach GROUP BY a)
SELECT document_id, graph_key, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY root) - 1 AS INTEGER) AS community_id FROM nodes JOIN root USING (graph_key)"""
    sql["entity_scores"] = g("SELECT * FROM scores")
    # As many entities as clusters: no cluster is empty, so there are 12 or as many as different label vectors.
    sql["kmeans_entities"] = g(f""", named AS (SELECT document_id, graph_key, name FROM nodes SEMI JOIN freq USING (document_id, graph_key)),
slots AS (SELECT document_id, graph_key, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 32 AS b, count(*) AS c
  FROM (SELECT document_id, graph_key, unnest({tokens('name')}) AS w FROM named) GROUP BY ALL),
shapes AS (SELECT n.document_id, n.graph_key, coalesce(v, '') AS v FROM named n LEFT JOIN (
  SELECT document_id, graph_key, string_agg(b || ':' || c, ',' ORDER BY b) AS v FROM slots GROUP BY ALL) s USING (document_id, graph_key))
SELECT document_id, CASE WHEN count(*) <= 12 THEN count(*) ELSE least(12, count(DISTINCT v)) END AS kept, true AS best_of_cluster, true AS nearest
FROM shapes GROUP BY document_id""")
    sql["top_entities"] = g("SELECT document_id, graph_key, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
    weight = _case("rel_type", RELATION_WEIGHTS, "'1.0'")
    sql["top_relations"] = g(f""", keys AS (SELECT document_id, graph_key FROM ranked WHERE rank <= 6),
agg AS (SELECT document_id, from_key, to_key, rel_type, count(*) AS frequency FROM relr GROUP BY ALL),
sc AS (SELECT a.*, (f.frequency + t.frequency) * 2.0::DOUBLE + a.frequency * 2.0::DOUBLE + CAST({weight} AS DOUBLE) AS score
  FROM agg a JOIN freq f ON f.document_id = a.document_id AND f.graph_key = a.from_key JOIN freq t ON t.document_id = a.document_id AND t.graph_key = a.to_key
  WHERE (a.document_id, a.from_key) IN (SELECT (document_id, graph_key) FROM keys) AND (a.document_id, a.to_key) IN (SELECT (document_id, graph_key) FROM keys))
SELECT document_id, from_key, to_key, rel_type, frequency, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM sc
WINDOW w AS (PARTITION BY document_id ORDER BY score DESC, from_key, to_key, rel_type) QUALIFY row_number() OVER w <= 4""")
    sql["selected_mentions"] = g("SELECT m.chunk_id, m.graph_key FROM ment m JOIN ranked r ON r.document_id = m.document_id AND r.graph_key = m.graph_key WHERE r.rank <= 6")
    sql["degree"] = g("SELECT * FROM deg")
    sql["snapshot_nodes"] = g("SELECT * FROM snap_nodes")
    sql["snapshot_links"] = g("SELECT * FROM snap_links")
    sql["complete_nodes"] = g("""SELECT * FROM snap_nodes WHERE "group" = 1 UNION ALL
SELECT document_id, id, substr(split_part(id, '::', 2), 1, 60), 2, 'concept', -1, 1 FROM
  (SELECT DISTINCT document_id, target AS id FROM snap_links UNION SELECT DISTINCT document_id, source FROM snap_links WHERE source NOT LIKE 'chunk:%')""")
    sql["links_with_known_end"] = g("""SELECT l.* FROM snap_links l WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.entity_type = 'metric' AND n.document_id = l.document_id AND n.graph_key IN (l.source, l.target))""")
    sql["first_entity_names"] = g("""SELECT document_id, CAST(row_number() OVER w AS INTEGER) AS rank, id, name FROM snap_nodes WHERE "group" = 2
WINDOW w AS (PARTITION BY document_id ORDER BY id) QUALIFY row_number() OVER w <= 40""")
    sql["relation_histogram"] = g("SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
    sql["document_relation_histogram"] = g("SELECT document_id, rel_type, count(*) AS n FROM edges GROUP BY ALL")
    sql["graph_totals"] = g("SELECT (SELECT count(*) FROM facts) AS chunks, (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS relationships")
    counts = """SELECT f.document_id, f.n AS chunks, coalesce(n.n, 0) AS entities, coalesce(e.n, 0) AS relationships
FROM (SELECT document_id, count(*) AS n FROM facts GROUP BY 1) f LEFT JOIN (SELECT document_id, count(*) AS n FROM nodes GROUP BY 1) n USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n FROM edges GROUP BY 1) e USING (document_id)"""
    sql["document_counts"] = g(counts)
    sql["stored_graph"] = g(counts + " WHERE f.document_id <> (SELECT max(document_id) FROM facts)")
    sql["store_log"] = g(counts + """ WHERE f.document_id <> (SELECT max(document_id) FROM facts)
AND (CAST(f.document_id AS BIGINT) % 10 <> 0 OR CAST(f.document_id AS BIGINT) % 15 = 0)""")
    sql["store_vectors"] = f"""WITH {FACTS} SELECT document_id, chunk_id, chunk_seq, text, len({tokens('text')}) AS n_tokens
FROM facts WHERE chunk_seq % 2 = 1 OR chunk_seq % 4 = 0"""
    sql["incremental_graph"] = sql["communities"].replace(
        "SELECT document_id, graph_key, CAST(", "SELECT document_id, graph_key, name, entity_type, CAST(")
    sql["chunks_per_document"] = f"WITH {FACTS} SELECT document_id, count(*) AS chunks FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
    sql["build_stats"] = g("SELECT count(*) AS chunks_processed, CAST(sum(n_e) AS BIGINT) AS entities_created, CAST(sum(n_r) AS BIGINT) AS relations_created FROM sizes")

    # retrieval
    def r(body: str) -> str:
        return f"WITH {RETRIEVAL} {body}"

    sql["question_terms"] = f"WITH {QUESTIONS} SELECT query_id, query, array_to_string(terms, '|') AS terms, multi_topic, k FROM qs"
    sql["default_scope"] = """WITH j AS (SELECT CAST(o_orderkey AS VARCHAR) AS job FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1)
SELECT c_custkey AS query_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey AS VARCHAR) END, (SELECT job FROM j)) END AS document_id FROM customer"""
    sql["vector_topk"] = _topk("true", 5)
    sql["indexed_topk"] = """SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL)) AS n_hits, true AS "right", true AS enough
FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL"""
    sql["model_vectors"] = f"""WITH {FACTS}, w AS (SELECT chunk_seq, unnest({tokens('text')}) AS t FROM facts),
n AS (SELECT chunk_seq, count(*) AS n_words, CAST(sum(CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64) AS BIGINT) AS places FROM w GROUP BY 1)
SELECT o_orderkey AS chunk_seq, CASE WHEN o_orderstatus <> 'P' THEN n_words END AS n_words, CASE WHEN o_orderstatus <> 'P' THEN places END AS places
FROM orders JOIN n ON n.chunk_seq = o_orderkey"""
    sql["stored_vectors"] = """SELECT doc_id, round(embedding[4]::DOUBLE, 6) AS fourth FROM documents d
LEFT JOIN embeddings e ON d.doc_id = e.vec_id AND d.lang <> 'de'"""
    sql["scoped_topk"] = _topk("q.label = v.label", 5)
    sql["post_filtered_topk"] = f"""WITH wide AS ({_topk("true", 75)})
SELECT query_id, chunk_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM wide JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON CAST(v.vec_id AS VARCHAR) = chunk_id
WHERE q.label = v.label WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= 5"""
    sql["filtered_topk"] = f"""WITH qt AS (SELECT item_id AS query_id, text, {tokens('text')}[1] AS keyword FROM benchmark), dt AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents),
{_hashed('qt', 'query_id', 'text', 'qv')}, {_hashed('dt', 'chunk_id', 'text', 'dv')},
dots AS (SELECT q.query_id, d.chunk_id, CAST(sum(q.c * d.c) AS DOUBLE) AS dot FROM qv_b q JOIN dv_b d ON q.b = d.b GROUP BY ALL),
s AS (SELECT query_id, chunk_id, floor(dot / sqrt(qv.norm * dv.norm) * 1e6 + 0.5) / 1e6 AS score FROM dots JOIN qv USING (query_id) JOIN dv USING (chunk_id))
SELECT query_id, chunk_id, score, CAST(row_number() OVER o AS INTEGER) AS rank FROM s JOIN qt USING (query_id) JOIN dt USING (chunk_id)
WHERE contains(lower(substr(dt.text, 1, 2000)), keyword) WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER o <= 8"""
    sql["overscan_topk"] = f"""WITH qt AS (SELECT item_id AS query_id, text, {tokens('text')}[1] AS keyword FROM benchmark), dt AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents),
{_hashed('qt', 'query_id', 'text', 'qv')}, {_hashed('dt', 'chunk_id', 'text', 'dv')},
dots AS (SELECT q.query_id, d.chunk_id, CAST(sum(q.c * d.c) AS DOUBLE) AS dot FROM qv_b q JOIN dv_b d ON q.b = d.b GROUP BY ALL),
s AS (SELECT query_id, chunk_id, floor(dot / sqrt(qv.norm * dv.norm) * 1e6 + 0.5) / 1e6 AS score FROM dots JOIN qv USING (query_id) JOIN dv USING (chunk_id)),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 16)
SELECT query_id, chunk_id, score, CAST(row_number() OVER o AS INTEGER) AS rank FROM w JOIN qt USING (query_id) JOIN dt USING (chunk_id)
WHERE contains(lower(substr(dt.text, 1, 2000)), keyword) WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER o <= 8"""
    sql["keyword_any"] = f"""WITH q AS (SELECT item_id AS query_id, {tokens('text')}[1:2] AS terms, ['en', 'de', 'fr', 'es'][item_id % 4 + 1] AS lang FROM benchmark)
SELECT query_id, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS rank
FROM q JOIN documents d ON d.lang = q.lang AND len(list_filter(terms, lambda w: length(w) >= 2 AND NOT contains(lower(d.text), w))) = 0
WHERE len(list_filter(terms, lambda w: length(w) >= 2)) > 0 QUALIFY rank <= 20"""
    sql["indexed_keywords"] = sql["keyword_any"]
    sql["keyword_and"] = r("SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM kw")
    sql["hybrid_hits"] = r("SELECT query_id, chunk_id, score, rank FROM hits")
    sql["hit_chunk_ids"] = r("SELECT query_id, rank, chunk_id FROM hits")
    sql["expand"] = r("SELECT query_id, graph_key, name FROM xnodes")
    sql["induced_edges"] = r("SELECT query_id, source, target, type FROM xedges")
    sql["chunk_edges"] = r("SELECT * FROM cedges")
    sql["context_chunks"] = r("SELECT query_id, position, chunk_id, text, in_graph FROM ctx")
    sql["triples"] = r("SELECT query_id, position, triple FROM trip")
    sql["passages"] = r(rf"""SELECT query_id, position, chunk_id, CASE WHEN length(text) > 40 THEN regexp_replace(substr(text, 1, 40), '\s+$', '') || '…' ELSE text END AS text FROM shown""")
    q = lambda s: s.replace("'", "''")
    sql["answer_context"] = r(f""", tl AS (SELECT query_id, string_agg('- ' || triple, chr(10) ORDER BY position) AS t, count(*) AS nt FROM trip GROUP BY 1),
pl AS (SELECT query_id, string_agg('[page_1 p1]' || chr(10) || text || chr(10), chr(10) ORDER BY position) AS p,
  string_agg(substr(text, 1, 350), chr(10) || chr(10) ORDER BY position) AS fb, count(*) AS np FROM shown GROUP BY 1)
SELECT query_id, array_to_string(['{q(PROMPT_HEAD)}', '', '## Facts', coalesce(t, '- (none)'), '', '## Passages', coalesce(p, ''), '## Question', query, '', '## Rules', '{q(PROMPT_RULES)}'], chr(10)) AS prompt,
  CASE WHEN fb IS NULL THEN '{q(NOTHING_FOUND)}' ELSE '{FALLBACK_INTRO}' || CASE WHEN length(fb) > 600 THEN substr(fb, 1, 600) || '…' ELSE fb END END AS fallback_answer,
  array_to_string(list_filter([CASE WHEN nt > 0 THEN 'Retrieved graph relationships' END, CASE WHEN np > 0 THEN 'Retrieved ' || np || ' relevant passages' END,
    CASE WHEN np >= 2 OR nt > 0 THEN 'Combined graph + passages into unified explanation' END], lambda s: s IS NOT NULL), '|') AS reasoning_steps
FROM qs LEFT JOIN tl USING (query_id) LEFT JOIN pl USING (query_id)""")
    sql["citations"] = r(""", ce AS (SELECT query_id, chunk_id, list(name ORDER BY graph_key)[1:20] AS e FROM hent GROUP BY ALL),
cr AS (SELECT query_id, chunk_id, list('(' || split_part(source, '::', 2) || ')-[' || type || ']->(' || split_part(target, '::', 2) || ')' ORDER BY source, target, type)[1:15] AS r FROM cedges GROUP BY ALL)
SELECT c.query_id, c.position, c.chunk_id, 1 AS page, 'page_1' AS source, c.text, coalesce(array_to_string(e, '|'), '') AS graph_entities, coalesce(array_to_string(r, '|'), '') AS graph_relationships
FROM cites c LEFT JOIN ce USING (query_id, chunk_id) LEFT JOIN cr USING (query_id, chunk_id)""")
    sql["citation_dedup"] = f"""WITH RECURSIVE {RETRIEVAL},
ct AS (SELECT DISTINCT text FROM ctx),
cnt AS (SELECT text, t, count(*) AS c FROM (SELECT text, unnest({tokens('text')}) AS t FROM ct) GROUP BY ALL),
cn AS (SELECT text, CAST(sum(c * c) AS DOUBLE) AS n FROM cnt GROUP BY text),
cs AS (SELECT a.text AS ta, b.text AS tb, CAST(sum(a.c * b.c) AS DOUBLE) AS d FROM cnt a JOIN cnt b USING (t) GROUP BY ALL),
near AS (
  SELECT b.query_id, b.position, list(a.position) AS near FROM ctx b JOIN ctx a ON a.query_id = b.query_id AND a.position < b.position
  JOIN cs ON cs.ta = a.text AND cs.tb = b.text JOIN cn x ON x.text = a.text JOIN cn y ON y.text = b.text
  WHERE d / sqrt(x.n * y.n) >= 0.92 GROUP BY ALL),
cc AS (SELECT c.query_id, c.position, c.chunk_id, coalesce(near, []) AS near FROM ctx c LEFT JOIN near USING (query_id, position)),
fold AS (
  SELECT query_id, position, [position] AS kept FROM cc WHERE position = 1
  UNION ALL
  SELECT c.query_id, c.position, CASE WHEN len(f.kept) < 5 AND NOT list_has_any(f.kept, c.near) THEN list_append(f.kept, c.position) ELSE f.kept END
  FROM fold f JOIN cc c ON c.query_id = f.query_id AND c.position = f.position + 1),
final AS (SELECT query_id, arg_max(kept, position) AS kept FROM fold GROUP BY query_id)
SELECT query_id, position, chunk_id FROM cc JOIN final USING (query_id) WHERE list_contains(kept, position)"""
    sql["query_confidence"] = r("""SELECT query_id, round(least(1.0, greatest(0.2,
  greatest(least(1.0, coalesce(e.n, 0) / 10.0::DOUBLE), least(1.0, coalesce(n.n, 0) / 15.0::DOUBLE)) * 0.4::DOUBLE
  + least(1.0, coalesce(h.n, 0)) * 0.3::DOUBLE + least(1.0, coalesce(c.n, 0) / 5.0::DOUBLE) * 0.3::DOUBLE)), 6) AS confidence
FROM qs LEFT JOIN (SELECT query_id, count(*) AS n FROM xedges GROUP BY 1) e USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM xnodes GROUP BY 1) n USING (query_id)
LEFT JOIN (SELECT query_id, max(score) AS n FROM hits GROUP BY 1) h USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM cites GROUP BY 1) c USING (query_id)""")
    sql["graph_trace"] = r(""", n AS (SELECT query_id, count(*) AS n_nodes, array_to_string(list_sort(list(graph_key)), '|') AS ids FROM xnodes GROUP BY 1)
SELECT query_id, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(coalesce(e.n, 0) AS INTEGER) AS n_edges, ids AS used_node_ids FROM n
LEFT JOIN (SELECT query_id, count(*) AS n FROM xedges GROUP BY 1) e USING (query_id)""")
    sql["fallback_context"] = r(""", gc AS (SELECT query_id, position AS rank, chunk_id, text, 0 AS later FROM ctx WHERE text LIKE 'Revenue%' OR text LIKE 'Cost%'),
thin AS (SELECT query_id FROM qs LEFT JOIN (SELECT query_id, count(*) AS n FROM gc GROUP BY 1) c USING (query_id) WHERE coalesce(n, 0) < 2),
allc AS (SELECT * FROM gc UNION ALL SELECT query_id, position, chunk_id, text, 1 FROM ctx WHERE position <= 5 AND query_id IN (SELECT query_id FROM thin)),
mg AS (SELECT query_id, chunk_id, min((later, rank)) AS o, any_value(text) AS text FROM allc GROUP BY ALL),
nb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS position FROM mg),
pc AS (SELECT query_id, string_agg('[page_1]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) FILTER (position <= 10) AS context,
  string_agg(chunk_id, '|' ORDER BY position) FILTER (position <= 5) AS citations FROM nb GROUP BY 1)
SELECT query_id, coalesce(context, 'No context.') AS context, coalesce(citations, '') AS citations, CASE WHEN context IS NULL THEN 0.3::DOUBLE ELSE 0.85::DOUBLE END AS confidence
FROM qs LEFT JOIN pc USING (query_id)""")
    sql["chart_points"] = rf"""WITH {FACTS}, n AS (SELECT chunk_seq, text, regexp_extract_all(text, '\b(\d+(?:\.\d+)?)\b', 1) AS nums FROM facts),
p AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS VARCHAR) AS label, CAST(l_partkey % 100 AS VARCHAR) AS value FROM lineitem),
k AS (SELECT n.chunk_seq, p.* FROM p JOIN n ON n.chunk_seq = p.l_orderkey WHERE len(nums) = 0 OR list_contains(nums, value) OR list_contains(nums, label)
  QUALIFY row_number() OVER (PARTITION BY n.chunk_seq ORDER BY l_linenumber, value, label) <= 10),
t AS (SELECT chunk_seq, string_agg(value || ' in ' || label || '.', ' ' ORDER BY l_linenumber, value, label) AS s FROM k GROUP BY 1)
SELECT CAST(n.chunk_seq AS VARCHAR) AS document_id, coalesce(s, text) AS text FROM n LEFT JOIN t USING (chunk_seq)"""
    sql["answer_texts"] = f"""WITH {FACTS}, a AS (SELECT chunk_id, chunk_seq, text || CASE WHEN chunk_seq % 2 = 0 THEN '  ' || chr(10) || chr(10) || 'Details: see above.' ELSE '' END AS answer FROM facts)
SELECT chunk_id, answer, split_part(answer, '  ' || chr(10), 1) AS summary, CASE WHEN chunk_seq % 2 = 0 THEN 'see above.' ELSE '' END AS details FROM a"""

    # event feed
    def f(body: str) -> str:
        return f"WITH {FEED} {body}"

    sql["session_counts"] = f("SELECT session_id, count(*) AS events FROM feed GROUP BY 1")
    sql["retention"] = f(""", p AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS age, count(*) OVER (PARTITION BY session_id) AS n FROM feed)
SELECT session_id, seq FROM p WHERE age <= CASE WHEN n <= 60 THEN n ELSE 40 + (n - 61) % 21 END""")
    sql["read_from"] = f(""", t AS (SELECT session_id, count(*) AS total FROM feed GROUP BY 1) SELECT session_id, seq, total FROM feed JOIN t USING (session_id) WHERE seq >= 500""")
    sql["latest_state"] = f("SELECT session_id AS job_id, type AS field, max_by(k, seq) AS value FROM feed GROUP BY ALL")
    sql["progress_state"] = f(""", l AS (SELECT session_id AS job_id, CASE WHEN type IN ('view', 'click') THEN 'graph' ELSE 'chunking' END AS section, type AS key, max_by(k, seq) AS value FROM feed GROUP BY ALL)
SELECT job_id, section, string_agg(key || '=' || value, ',' ORDER BY key) AS progress FROM l GROUP BY ALL""")
    sql["ordered_logs"] = f("SELECT session_id AS job_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS position, type AS phase, k AS message FROM feed")
    sql["percent_done"] = f("SELECT seq, CASE WHEN seq % 4 = 0 THEN 0 ELSE CAST(round_even(100.0::DOUBLE * (seq % 201) / ((seq % 4) * 50), 0) AS INTEGER) END AS percent FROM feed")
    sql["change_only"] = f("SELECT session_id, seq, type AS state FROM feed QUALIFY type IS DISTINCT FROM lag(type) OVER (PARTITION BY session_id ORDER BY seq)")
    sql["latest_per_source"] = f("SELECT session_id, type AS source, max(seq) AS seq, max_by(k, seq) AS k FROM feed GROUP BY ALL")
    sql["first_chunk_per_id"] = f("SELECT session_id, k AS chunk_id, min(seq) AS seq, min_by(type, seq) AS type FROM feed GROUP BY ALL")
    sql["newest_rows"] = f("SELECT session_id, seq, CAST(row_number() OVER w AS INTEGER) AS age FROM feed WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC) QUALIFY row_number() OVER w <= 61")
    sql["terminal_status"] = f("SELECT session_id, CASE max_by(type, seq) WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, max(seq) AS seq FROM feed WHERE type IN ('purchase', 'error') GROUP BY 1")
    sql["step_durations"] = f("""SELECT session_id, seq, type, CAST(trunc((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000) AS BIGINT) AS duration_ms FROM feed WINDOW w AS (PARTITION BY session_id ORDER BY seq)""")
    def stream(keys: str, value: str, idle_days: int) -> str:
        return f(f""", seen AS (SELECT *, lag(ts) OVER w AS before_ts, lag({value}) OVER w AS before FROM feed WINDOW w AS (PARTITION BY {keys} ORDER BY seq))
SELECT * FROM seen WHERE (before_ts IS NULL OR before IS DISTINCT FROM {value} OR epoch_ms(ts) - epoch_ms(before_ts) > {idle_days} * 86400000)
  AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM feed) - 6 * 86400000""")

    sql["ordered_changes"] = f"SELECT session_id, seq, type AS state FROM ({stream('session_id', 'type', 2)})"
    sql["first_chunk_stream"] = f"SELECT session_id, k AS chunk_id, seq FROM ({stream('session_id, k', '1', 4)})"
    sql["stream_session_counts"] = sql["session_counts"]
    sql["stream_latest_state"] = sql["latest_state"]
    sql["stream_distinct_chunks"] = f("SELECT DISTINCT session_id, k AS chunk_id FROM feed")
    sql["stream_changes"] = sql["change_only"]
    return sql


ORACLES = _oracles()
