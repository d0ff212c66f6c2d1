"""DuckDB SQL for the engine's queries, written apart from them."""

from __future__ import annotations

ENTITIES = """
named AS (
  SELECT 'Region' AS entity_type, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region
  UNION ALL SELECT 'Nation', n_nationkey, n_name FROM nation
  UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'Customer', c_custkey, c_name FROM customer
  UNION ALL SELECT 'Part', p_partkey, p_name FROM part),
seen AS (SELECT user_id, count(*) AS n, max(ts) AS last_accessed FROM events GROUP BY user_id),
ent AS (
  SELECT entity_type || ':' || key AS entity_id, entity_type,
         CASE WHEN key % 10 < 5 THEN 'STAGING' WHEN key % 10 < 9 THEN 'TRUSTED' ELSE 'ARCHIVED' END AS lifecycle_state,
         CAST(key * 37 % 101 AS DOUBLE) / 100 AS confidence, 'doc-' || (key % 50) AS source_document_id,
         'The record of ' || name AS source_sentence, CASE WHEN key % 7 <> 0 THEN name END AS extracted_text,
         key % 11 <> 0 AS resolved, TIMESTAMP '2024-01-01' + to_days(CAST(key % 30 AS INTEGER)) AS created_at,
         CAST(coalesce(n, 0) AS INTEGER) AS access_count, last_accessed
  FROM named LEFT JOIN seen ON entity_type = 'Customer' AND user_id = key
  UNION ALL
  SELECT entity_type || ':' || key || ':dup', entity_type, 'STAGING', CAST(key * 53 % 101 AS DOUBLE) / 100,
         'doc-' || ((key + 7) % 50), 'The record of ' || name, CASE WHEN key % 7 <> 0 THEN upper(name) END, true,
         TIMESTAMP '2024-01-01' + to_days(CAST(key % 30 AS INTEGER)) + to_hours(12), 0, NULL
  FROM named WHERE entity_type IN ('Customer', 'Supplier') AND key % 5 = 0)"""

EDGES = """
raw_edges AS (
  SELECT 'Supplier:' || s_suppkey AS source_entity_id, 'LOCATED_IN' AS relationship_type, 'Nation:' || s_nationkey AS target_entity_id,
         CAST(s_suppkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b FROM supplier
  UNION ALL SELECT 'Nation:' || n_nationkey, 'MEMBER_OF', 'Region:' || n_regionkey, n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey, 'BASED_IN', 'Nation:' || n, c_custkey, n
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 999 ELSE c_nationkey END AS n FROM customer)
  UNION ALL SELECT 'Supplier:' || l_suppkey, 'SUPPLIES', 'Part:' || l_partkey, l_suppkey, l_partkey
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
edg AS (
  SELECT source_entity_id || '>' || relationship_type || '>' || target_entity_id AS relationship_id, source_entity_id, target_entity_id,
         relationship_type, CASE WHEN (a + b) % 3 = 0 THEN 'STAGING' ELSE 'TRUSTED' END AS lifecycle_state,
         CAST((a * 31 + b * 17) % 101 AS DOUBLE) / 100 AS confidence, 'doc-' || (a % 50) AS source_document_id FROM raw_edges),
whole AS (
  SELECT e.*, coalesce(s.extracted_text, s.source_sentence, '') AS source_name, coalesce(t.extracted_text, t.source_sentence, '') AS target_name,
         s.entity_type AS source_type, t.entity_type AS target_type, s.lifecycle_state AS source_state, t.lifecycle_state AS target_state
  FROM edg e JOIN ent s ON e.source_entity_id = s.entity_id JOIN ent t ON e.target_entity_id = t.entity_id)"""

CHUNKS = """
chk AS (
  SELECT 'd-' || doc_id AS document_id, source AS document_type, lang || ' ' || doc_id AS document_title,
         substr(text, i * 700 + 1, 800) AS chunk_text, CAST(i AS INTEGER) AS chunk_index, embedding
  FROM (SELECT *, unnest(range(CAST(greatest(ceil((length(text) - 100) / 700.0), 1) AS BIGINT))) AS i FROM documents)
  LEFT JOIN embeddings ON doc_id = vec_id)"""

SESSIONS = """
ses AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn, text AS query_text, reply AS response_text,
         TIMESTAMP '2024-01-01' + turn * INTERVAL 1 HOUR AS created_at
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

RULES = """
counted AS (
  SELECT user_id AS u, count(*) AS applied, count(*) FILTER (event_type = 'error') AS some_,
         count(*) FILTER (event_type IN ('error', 'click', 'view')) AS most FROM events GROUP BY user_id),
rul AS (
  SELECT 'rule-' || u AS rule_name,
         CASE u % 4 WHEN 0 THEN 'Every service must have an owner' WHEN 1 THEN 'critical paths need a circuit breaker'
                    WHEN 2 THEN 'escalation path is required' ELSE 'no rule' END AS condition,
         CAST(u % 9 AS INTEGER) AS priority, u % 13 <> 0 AS enabled,
         CASE WHEN u % 5 = 0 THEN NULL WHEN u % 5 = 1 THEN '' ELSE CASE u % 4 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Supplier' WHEN 2 THEN 'Part' ELSE 'Nation' END END AS scope,
         CAST(applied AS INTEGER) AS times_applied,
         CAST(CASE u % 4 WHEN 0 THEN 0 WHEN 1 THEN some_ WHEN 2 THEN most ELSE applied END AS INTEGER) AS times_violated FROM counted)"""

FEEDBACK = """
fbk AS (
  SELECT event_id AS feedback_id, 'Customer:' || user_id AS entity_id, ts AS created_at,
         CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'incorrect' WHEN 'click' THEN 'partial' ELSE 'uncertain' END AS judgment
  FROM events WHERE event_type <> 'signup')"""

MEMORY = """
wrt AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, 'k' || (props::JSON ->> '$.k') AS key, value, event_type AS agent,
         CAST(event_id % 7 AS INTEGER) AS step_number, ts AS created_at, ts + to_days(CAST(user_id % 20 AS INTEGER)) AS expires_at, event_id AS seq
  FROM events),
mem AS (
  SELECT session_id, key, arg_max(value, seq) AS value, arg_max(agent, seq) AS agent, arg_max(step_number, seq) AS step_number,
         arg_max(expires_at, seq) AS expires_at, arg_min(created_at, seq) AS created_at FROM wrt GROUP BY session_id, key)"""

ENTITY_STOP = "'what','which','who','where','when','how','is','are','the','a','an','does','do','did','has','have','had','for','to','from','on','with','by','in','of','at'"
SEARCH_STOP = (
    "'what','which','who','where','when','how','is','are','does','the','a','an','do','did','has','have','had','for','to','from','on','with','by','in','of','at','be','was','were',"
    "'been','being','will','would','could','should','can','may','this','that','these','those','it','its','their','and','or','but','not','than','about','between','many','much','most',"
    "'name','total','expected','company','value','one','listed'"
)


#: Query vectors: all stored ones whose id is divisible by 100.
VECTORS = "qvec AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0)"


def _asked(vectors: bool = False) -> str:
    """Every turn of a user after the name of a part, or with ``vectors`` the first turns of as many
    conversations as there are stored vectors whose id is divisible by 100."""
    asked = "qry AS (SELECT query_id, query, session_id FROM qsts)"
    if vectors:
        asked = """qry AS (SELECT vec_id AS query_id, query, session_id FROM embeddings JOIN qsts ON opening AND session_id = CAST(vec_id // 100 AS VARCHAR) WHERE vec_id % 100 = 0),
qvec AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings JOIN qry ON vec_id = query_id)"""
    return f"""
qsts AS (
  SELECT CAST(conv_id * 100 + turn AS BIGINT) AS query_id, p_name || ' ' || text AS query, CAST(conv_id AS VARCHAR) AS session_id, turn = min(turn) OVER (PARTITION BY conv_id) AS opening
  FROM conversations JOIN part ON p_partkey = (conv_id * 8 + turn) % (SELECT max(p_partkey) FROM part) + 1 WHERE role = 'user'),
{asked},
ekw AS (
  SELECT query_id, generate_subscripts(ks, 1) - 1 AS pos, unnest(ks) AS needle FROM (
    SELECT query_id, list_filter(list_transform(list_filter(regexp_split_to_array(trim(lower(query)), '\\s+'),
      lambda w: w NOT IN ({ENTITY_STOP})), lambda w: trim(w, '?.,!')), lambda w: w <> '')[1:5] AS ks FROM qry)),
swords AS (
  SELECT query_id, query, list_filter(list_transform(regexp_split_to_array(trim(lower(query)), '\\s+'), lambda w: trim(w, '?.,!()"''-')),
    lambda w: length(w) > 2 AND w NOT IN ({SEARCH_STOP})) AS ws FROM qry),
phr AS (
  SELECT query_id, list_concat(list_transform(regexp_extract_all(query, '[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)+'), lambda p: lower(p)),
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ps FROM swords)"""


R1 = """
ematch AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY confidence DESC, access_count DESC, entity_id) AS rn
  FROM ekw JOIN ent ON lifecycle_state = 'TRUSTED'
   AND (contains(lower(coalesce(extracted_text, '')), needle) OR contains(lower(coalesce(source_sentence, '')), needle))),
ekept AS (SELECT * FROM ematch WHERE rn <= 30),
eonce AS (SELECT * FROM ekept QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY pos, rn) = 1),
efound AS (
  SELECT query_id, entity_id, entity_type, confidence, row_number() OVER (PARTITION BY query_id ORDER BY pos, rn) AS position FROM eonce
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, rn) <= 30)"""

R2 = """
rmatch AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY confidence DESC, relationship_id) AS rn
  FROM ekw JOIN (SELECT * FROM whole WHERE lifecycle_state = 'TRUSTED') ON contains(lower(source_name), needle)
    OR contains(lower(target_name), needle) OR contains(lower(relationship_type), needle)),
ronce AS (SELECT * FROM rmatch WHERE rn <= 40 QUALIFY row_number() OVER (PARTITION BY query_id, relationship_id ORDER BY pos, rn) = 1),
rfound AS (
  SELECT query_id, relationship_id, relationship_type, target_entity_id, confidence, row_number() OVER (PARTITION BY query_id ORDER BY pos, rn) AS position
  FROM ronce QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, rn) <= 40)"""

COSINE = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 6)"


def _vector(name: str, k: int, where: str = "true") -> str:
    return f"""
{name}_all AS (SELECT query_id, document_id, chunk_index, {COSINE.format('embedding', 'vector')} AS similarity
  FROM chk, qvec WHERE embedding IS NOT NULL AND {where}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index) AS rank FROM {name}_all
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index) <= {k})"""


def _expansion(hits: str) -> str:
    return f"""
per AS (SELECT query_id, document_id, min(rank) AS best, max(similarity) AS ds FROM {hits} GROUP BY ALL),
fdocs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS doc_rank FROM per QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best) <= 5),
ctx AS (SELECT f.query_id, f.document_id, c.chunk_index, f.doc_rank, round(f.ds * 0.9, 6) AS similarity FROM fdocs f JOIN chk c USING (document_id)
  WHERE NOT EXISTS (SELECT 1 FROM {hits} h WHERE h.query_id = f.query_id AND h.document_id = c.document_id AND h.chunk_index = c.chunk_index))"""


KEYWORDS = """
needles AS (
  SELECT query_id, 0 AS kind, generate_subscripts(ps[1:5], 1) AS pos, unnest(ps[1:5]) AS needle, 10 AS lim, 3 AS weight FROM phr
  UNION ALL SELECT query_id, 1, generate_subscripts(ws[1:6], 1), unnest(ws[1:6]), 15, 1 FROM swords
  UNION ALL SELECT query_id, 2, generate_subscripts(ws[1:4], 1), unnest(ws[1:4]), 10, 2 FROM swords),
khits AS (
  SELECT query_id, document_id, chunk_index, weight FROM needles JOIN chk
    ON contains(lower(CASE WHEN kind = 2 THEN document_title ELSE chunk_text END), needle)
  QUALIFY row_number() OVER (PARTITION BY query_id, kind, pos ORDER BY document_id, chunk_index) <= lim),
kscore AS (SELECT query_id, document_id, chunk_index, CAST(sum(weight) AS BIGINT) AS keyword_hits FROM khits GROUP BY ALL),
kw AS (
  SELECT *, round(least(0.5::DOUBLE + 0.4::DOUBLE * keyword_hits / greatest(max(keyword_hits) OVER (PARTITION BY query_id), 1), 0.85::DOUBLE), 6) AS similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY keyword_hits DESC, document_id, chunk_index) AS rank FROM kscore),
kfound AS (SELECT * FROM kw WHERE rank <= 5)"""

APPLICABLE = """
etypes AS (SELECT DISTINCT query_id, entity_type FROM efound),
app AS (
  SELECT query_id, rule_name, condition, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, rule_name) AS rank
  FROM (SELECT DISTINCT query_id FROM etypes), rul
  WHERE enabled AND (scope IS NULL OR scope = '' OR (query_id, scope) IN (SELECT (query_id, entity_type) FROM etypes))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, rule_name) <= 10)"""

UNCERTAIN = """
facts AS (
  SELECT query_id, 'entity' AS kind, confidence FROM efound UNION ALL SELECT query_id, 'edge', confidence FROM rfound
  UNION ALL SELECT query_id, 'document', NULL FROM docs_found),
cnt AS (
  SELECT q.query_id, count(*) FILTER (kind <> 'document' AND confidence >= 0.85) AS hi,
         count(*) FILTER (kind <> 'document' AND confidence >= 0.70 AND confidence < 0.85) AS mid,
         count(*) FILTER (kind <> 'document' AND confidence < 0.70) AS lo,
         count(*) FILTER (kind = 'entity') AS ne, count(*) FILTER (kind = 'edge') AS nr, count(*) FILTER (kind = 'document') AS nd
  FROM qry q LEFT JOIN facts f USING (query_id) GROUP BY q.query_id),
low AS (
  SELECT query_id, string_agg('Entity: ' || entity_type || ' (ID: ' || entity_id || ')', '|' ORDER BY position) AS low_items
  FROM (SELECT * FROM efound WHERE confidence < 0.70 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 5) GROUP BY query_id),
unc AS (
  SELECT query_id, CASE WHEN hi + mid + lo = 0 THEN 0 ELSE round((hi * 0.9::DOUBLE + mid * 0.7::DOUBLE + lo * 0.4::DOUBLE) / (hi + mid + lo), 6) END AS overall_confidence,
         hi AS high_facts, mid AS medium_facts, lo AS low_facts, coalesce(low_items, '') AS low_items,
         concat_ws('|', CASE WHEN ne = 0 THEN 'No matching entities found in knowledge graph' END,
           CASE WHEN nr = 0 AND ne > 0 THEN 'Entities found but no relationships - limited context' END,
           CASE WHEN nd = 0 THEN 'No similar documents found in episodic memory' END) AS reasons
  FROM cnt LEFT JOIN low USING (query_id)),
report AS (
  SELECT *, CASE WHEN high_facts + medium_facts + low_facts = 0 THEN 'insufficient_context' WHEN overall_confidence >= 0.85 THEN 'proceed'
                 WHEN overall_confidence >= 0.5 THEN 'caution' ELSE 'insufficient_context' END AS recommendation FROM unc)"""

HYBRID = """
ranked_docs AS (SELECT query_id, document_id, doc_rank FROM fdocs),
merged AS (
  SELECT h.query_id, h.document_id, h.chunk_index, h.similarity, r.doc_rank FROM hits h LEFT JOIN ranked_docs r USING (query_id, document_id)
  UNION ALL SELECT query_id, document_id, chunk_index, similarity, doc_rank FROM ctx),
every AS (
  SELECT *, CASE WHEN doc_rank IS NOT NULL THEN 0 ELSE 1 END AS section FROM merged
  UNION ALL SELECT query_id, document_id, chunk_index, similarity, rank, 2 FROM kfound k
    WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.query_id = k.query_id AND m.document_id = k.document_id AND m.chunk_index = k.chunk_index)),
hyb AS (
  SELECT query_id, document_id, chunk_index, similarity, section, row_number() OVER (PARTITION BY query_id
    ORDER BY section, doc_rank NULLS LAST, CASE WHEN section = 0 THEN chunk_index END NULLS FIRST, similarity DESC, document_id, chunk_index) AS position FROM every)"""

MERGE = """
stg AS (SELECT *, lower(coalesce(extracted_text, source_sentence)) AS label FROM ent WHERE lifecycle_state = 'STAGING'),
grp AS (
  SELECT label, entity_type, count(*) AS n, max(confidence) AS best, first(entity_id ORDER BY confidence DESC, entity_id) AS survivor
  FROM stg GROUP BY label, entity_type HAVING count(*) > 1),
mplan AS (SELECT entity_id, survivor, least(best + least((n - 1) * 0.05::DOUBLE, 0.10::DOUBLE), 1.0::DOUBLE) AS raised FROM stg JOIN grp USING (label, entity_type))"""

PROMOTED = """
prom AS (
  SELECT entity_id, entity_type, CASE WHEN lifecycle_state = 'STAGING' AND confidence >= 0.5 THEN 'TRUSTED' ELSE lifecycle_state END AS lifecycle_state FROM ent)"""

EVIDENCE = """
stg AS (SELECT *, lower(coalesce(extracted_text, source_sentence, '')) AS k FROM ent WHERE lifecycle_state = 'STAGING'),
grp AS (SELECT entity_type, k, max(confidence) AS best, count(DISTINCT nullif(source_document_id, '')) AS sources FROM stg GROUP BY ALL),
decided AS (
  SELECT entity_id, CASE WHEN best < 0.7 THEN 'low_confidence' WHEN sources < 2 THEN 'few_sources' ELSE 'promote' END AS decision
  FROM stg JOIN grp USING (entity_type, k))"""

CROSS = """
cross_m AS (
  SELECT s.entity_id AS staging_id, t.entity_id AS trusted_id, s.source_document_id AS staging_document, t.source_document_id AS trusted_document, t.confidence AS tc
  FROM ent s JOIN ent t ON lower(s.extracted_text) = lower(t.extracted_text) AND s.entity_type = t.entity_type
  WHERE s.lifecycle_state = 'STAGING' AND t.lifecycle_state = 'TRUSTED' AND s.entity_id <> t.entity_id)"""


def _page_parts(ent: str = "ent", edg: str = "edg", titled: bool = False, most: int = 20) -> str:
    """Pages in parts of ``most`` lines."""
    titles = "SELECT 'doc-' || doc_id AS source_document_id, min('Document ' || lang || ' ' || doc_id) AS title FROM documents WHERE doc_id < 50 AND doc_id % 2 = 0 GROUP BY 1"
    return f"""
mem AS (SELECT *, lower(extracted_text) AS k FROM {ent} WHERE lifecycle_state = 'TRUSTED' AND extracted_text IS NOT NULL),
fc AS (SELECT entity_type, k, round(avg(confidence), 6) AS c, count(*) AS n FROM mem GROUP BY 1, 2),
titles AS ({titles}{'' if titled else ' HAVING false'}),
tch AS (SELECT m.entity_type, m.k, e.relationship_id, e.relationship_type, e.confidence, e.target_entity_id AS other, '->' AS arrow FROM {edg} e JOIN mem m ON m.entity_id = e.source_entity_id WHERE e.lifecycle_state = 'TRUSTED'
  UNION ALL SELECT m.entity_type, m.k, e.relationship_id, e.relationship_type, e.confidence, e.source_entity_id, '<-' FROM {edg} e JOIN mem m ON m.entity_id = e.target_entity_id WHERE e.lifecycle_state = 'TRUSTED'),
one_ AS (SELECT * FROM tch QUALIFY row_number() OVER (PARTITION BY entity_type, k, relationship_id ORDER BY arrow DESC, other DESC) = 1),
lns AS (
  SELECT x.entity_type, k, 'relationships' AS section, row_number() OVER (PARTITION BY x.entity_type, k ORDER BY x.confidence DESC, relationship_id) - 1 AS i,
         '- ' || arrow || ' **' || relationship_type || '** ' || coalesce(o.extracted_text, o.source_sentence, '') AS line FROM one_ x JOIN {ent} o ON o.entity_id = other
  UNION ALL SELECT entity_type, k, 'sources', row_number() OVER (PARTITION BY entity_type, k ORDER BY source_document_id) - 1, '- ' || coalesce(title, source_document_id)
  FROM (SELECT DISTINCT entity_type, k, source_document_id FROM mem WHERE source_document_id IS NOT NULL) LEFT JOIN titles USING (source_document_id)),
prt AS (
  SELECT entity_type, k, section, CAST(i // {most} AS INTEGER) AS part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS text FROM lns GROUP BY ALL
  UNION ALL SELECT entity_type, k, 'facts', 0, 3, 'Type: ' || entity_type || chr(10) || 'Confidence: ' || CAST(floor(c * 100 + 0.5) AS INTEGER) || '%' || chr(10) || 'Entities: ' || n FROM fc)
SELECT entity_type, title, section, part, n_lines, text FROM (SELECT DISTINCT entity_type, extracted_text AS title, k FROM mem) JOIN prt USING (entity_type, k)"""


#: Two rounds: staged duplicates go to the best of them, then staged ones to a trusted one.
ROUNDS = MERGE + """,
one AS (SELECT e.* REPLACE (CASE WHEN p.entity_id <> p.survivor THEN 'ARCHIVED' ELSE e.lifecycle_state END AS lifecycle_state), CASE WHEN p.entity_id <> p.survivor THEN p.survivor END AS m
  FROM ent e LEFT JOIN mplan p USING (entity_id)),
two AS (SELECT s.entity_id, first(t.entity_id ORDER BY t.confidence DESC, t.entity_id) AS r FROM one s JOIN one t ON lower(s.extracted_text) = lower(t.extracted_text) AND s.entity_type = t.entity_type
  WHERE s.lifecycle_state = 'STAGING' AND t.lifecycle_state = 'TRUSTED' GROUP BY s.entity_id),
ended AS (SELECT o.entity_id, m, w.r, x.r AS rm, CASE WHEN w.r IS NOT NULL THEN 'ARCHIVED' ELSE lifecycle_state END AS state FROM one o LEFT JOIN two w USING (entity_id) LEFT JOIN two x ON x.entity_id = m)"""


def _fold(changes: str) -> str:
    """An ordered fold by recursion: one change of every entity a step, in whole millionths."""
    return f"""
{changes},
steps AS (SELECT entity_id, CAST(round(delta * 1000000) AS BIGINT) AS delta, row_number() OVER (PARTITION BY entity_id ORDER BY s1, s2) AS i FROM chg WHERE delta IS NOT NULL),
fold AS (
  SELECT entity_id, CAST(round(confidence * 1000000) AS BIGINT) AS c, lifecycle_state AS s, CAST(0 AS BIGINT) AS i FROM ent WHERE entity_id IN (SELECT entity_id FROM steps)
  UNION ALL
  SELECT f.entity_id, CASE WHEN delta >= 0 THEN least(c + delta, 1000000) ELSE greatest(c + delta, 0) END,
         CASE WHEN delta < 0 AND greatest(c + delta, 0) < 400000 AND s = 'TRUSTED' THEN 'ARCHIVED' ELSE s END, f.i + 1
  FROM fold f JOIN steps t ON f.entity_id = t.entity_id AND t.i = f.i + 1),
folded AS (SELECT entity_id, c / 1000000 AS c, s, CAST(i AS INTEGER) AS n_changes FROM fold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY i DESC) = 1)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n"


def _answers() -> str:
    return """
ans AS (
  SELECT doc_id AS q_id, CASE WHEN doc_id % 3 = 0 THEN 'Name one of the parts' ELSE 'What is thatnd of the onesen?' END AS question,
         CASE k WHEN 0 THEN text WHEN 1 THEN 'Yes, ' || passage WHEN 2 THEN '[NOT IN DOCUMENTS]' WHEN 3 THEN '[Answer depends on document content]'
           WHEN 4 THEN '2024-' || (2025 + doc_id % 3) WHEN 5 THEN passage || ' (or ' || lang || ')'
           WHEN 6 THEN 'about 12 ' || passage ELSE passage END AS expected,
         CASE WHEN doc_id % 11 = 0 THEN 'The context does not provide this.' WHEN k = 0 THEN 'It says: ' || text WHEN k = 1 THEN 'Yes. ' || text
           WHEN k = 4 THEN 'It ran from 2024 to ' || (2025 + doc_id % 2) WHEN k = 6 THEN 'Some 12.1 ' || text ELSE text END AS actual,
         lang AS category, CASE WHEN k < 3 THEN 'Easy' WHEN k < 6 THEN 'medium' ELSE 'hard' END AS difficulty, doc_id % 17 / 10.0 AS latency_s
  FROM (SELECT d.doc_id, d.lang, d.text, b.text AS passage, d.doc_id % 8 AS k
        FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id, text) - 1 AS place FROM benchmark) b
          ON d.doc_id % (SELECT count(*) FROM benchmark) = place) x)"""


def _score() -> str:
    stop = (
        "'the','and','for','are','but','not','you','all','can','had','has','was','one','our','out','its','with','that','this','from','they','been','have','will','each','which',"
        "'their','about','would','there','these','other','into','more','also','than','then','some','what','only','does','most','plus','formerly','currently','approximately','around',"
        "'total','full','per','initially','ramping','year','vs','answer','depends','document','content','provided','context'"
    )
    policy = "['does not provide','not found','no information','cannot determine','not mentioned','not specified','not contain','not available','not explicitly']"
    refuse = policy[:-1] + ",'not provided','no context','insufficient']"
    noinfo = policy[:-1] + ",'insufficient','no context']"
    neg = "[' not ',' no ',' does not',' is not',' cannot',' hasn''t',' didn''t',' doesn''t',' won''t',' isn''t','not ','no ','does not','is not','cannot']"
    aff = "['yes','correct','it does','it is','it has','they do','they are']"

    def norm(x: str) -> str:
        out = f"regexp_replace(lower({x}), '[,$%.\\s()\\-–—]', '', 'g')"
        for w, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10), ("eleven", 11), ("twelve", 12), ("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50), ("hundred", 100)):
            out = f"replace({out}, '{w}', '{n}')"
        return out

    strip = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')".format
    words = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z][a-zA-Z\\-]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({stop})))"
    nums = lambda x: f"list_filter(list_distinct(list_transform(regexp_extract_all({x}, '[\\d,]+\\.?\\d*'), lambda n: replace(n, ',', ''))), lambda n: n <> '')"
    any_in = lambda phrases, x: f"len(list_filter({phrases}, lambda p: contains({x}, p))) > 0"
    proper = "'\\b[A-Z][a-zA-Z]{2,}(?:\\s+[A-Z][a-zA-Z]{2,})*'"
    return f"""
s1 AS (SELECT *, {strip('lower(actual)')} AS al, {strip('lower(expected)')} AS el, {strip('lower(question)')} AS ql, length({strip('actual')}) AS alen FROM ans),
s2 AS (SELECT *, list_transform(regexp_extract_all(el, '\\(([^)]+)\\)', 1), lambda m: {strip('m')}) AS inner_, {strip("regexp_replace(el, '\\s*\\([^)]*\\)', '', 'g')")} AS base,
  {words('expected')} AS ew, {words('actual')} AS aw, {nums('expected')} AS en, {nums('actual')} AS an, {any_in(noinfo, 'al')} AS no_info,
  list_filter(list_transform(regexp_split_to_array(el, '[,;]|\\bor\\b|\\band\\b'), lambda i: {strip('i')}), lambda i: length(i) > 1) AS items FROM s1),
s3 AS (SELECT *, list_filter(list_concat([el], inner_, list_transform(list_filter(inner_, lambda m: starts_with(m, 'or ')), lambda m: substr(m, 4)),
    CASE WHEN base <> el THEN [base] ELSE [] END, CASE WHEN contains(el, ' or ') THEN list_transform(string_split(el, ' or '), lambda p: {strip('p')}) ELSE [] END), lambda a: a <> '') AS alts,
  regexp_extract(el, '^(\\d{{4}})\\s*[-–—]\\s*(\\d{{4}})$', 1) AS y1, regexp_extract(el, '^(\\d{{4}})\\s*[-–—]\\s*(\\d{{4}})$', 2) AS y2,
  regexp_matches(ql, '\\bname\\s+(one|a|an|any)\\b') AND (contains(el, ',') OR contains(el, ' or ')) AS name_one,
  list_filter(list_transform(items, lambda i: CASE WHEN contains(al, i) THEN 2 WHEN len(list_filter(regexp_split_to_array(i, '\\s+'), lambda w: length(w) > 2)) > 0
    AND len(list_filter(regexp_split_to_array(i, '\\s+'), lambda w: length(w) > 2 AND NOT contains(al, w))) = 0 THEN 1 ELSE 0 END), lambda x: x > 0)[1] AS item_hit,
  regexp_extract(el, '^(yes|no)\\b', 1) AS want, regexp_extract(al, '^(yes|no)\\b', 1) AS said,
  regexp_extract(al, '^((?:.|\\n)*?[a-z])\\.\\s', 1) AS cut,
  list_distinct(list_filter(regexp_extract_all(regexp_replace(el, '^(yes|no)[,.\\s]*', '') || ' ' || ql, '[a-z]+'), lambda w: length(w) > 3)) AS refs,
  list_distinct(regexp_extract_all(al, '[a-z]+')) AS acts,
  len(list_filter(ew, lambda w: len(list_filter(aw, lambda a: contains(a, w) OR contains(w, a))) > 0)) AS matched,
  list_filter(regexp_split_to_array(el, '\\s+'), lambda w: length(w) > 3 AND w NOT IN ('the','and','for','with','from','that','this','answer','depends','document','content')) AS core,
  list_distinct(regexp_extract_all(expected, {proper})) AS pe,
  len(list_filter(en, lambda e: list_contains(an, e))) + len(list_filter(en, lambda e: NOT list_contains(an, e) AND len(list_filter(an, lambda a:
    coalesce(CASE WHEN try_cast(a AS DOUBLE) = 0 THEN try_cast(e AS DOUBLE) = 0 ELSE abs(try_cast(e AS DOUBLE) - try_cast(a AS DOUBLE)) / greatest(abs(try_cast(a AS DOUBLE)), 1.0) <= 0.02 END, false))) > 0)) AS close_
  FROM s2),
s4 AS (SELECT *, CASE WHEN cut = '' THEN al ELSE cut END AS first_, len(list_intersect(refs, acts)) AS shared,
  close_ / len(en) * 0.6::DOUBLE + matched / greatest(len(ew), 1) * 0.4::DOUBLE AS combined, matched / len(ew) AS ratio,
  len(list_filter(pe, lambda p: contains(actual, p) OR contains(al, lower(p)))) AS pfound FROM s3),
s5 AS (SELECT *, CASE WHEN said <> '' THEN said WHEN {any_in(neg, 'first_')} THEN 'no'
  WHEN len(list_filter({aff}, lambda p: starts_with(first_, p))) > 0 THEN 'yes' END AS verdict FROM s4),
s6 AS (SELECT *, CASE
  WHEN contains(el, 'answer depends on document content') THEN CASE WHEN {any_in(policy, 'al')} THEN 'policy_no_answer' WHEN alen > 20 THEN 'policy_answered' ELSE 'policy_empty' END
  WHEN contains(el, 'not in documents') THEN CASE WHEN {any_in(refuse, 'al')} THEN 'trick_correct_reject' ELSE 'trick_hallucinated' END
  WHEN contains(al, el) THEN 'exact_match'
  WHEN y1 <> '' AND (contains(al, y1 || ' to ' || y2) OR contains(al, y1 || ' through ' || y2) OR contains(al, y1 || ' - ' || y2) OR contains(al, y1 || '–' || y2) OR contains(al, y1 || '—' || y2)) THEN 'timeline_match'
  WHEN name_one AND item_hit = 2 THEN 'name_one_match' WHEN name_one AND item_hit = 1 THEN 'name_one_words'
  WHEN len(list_filter(alts, lambda a: contains(al, a))) > 0 THEN 'alternative_match'
  WHEN want <> '' AND verdict = want AND alen > 15 AND (shared >= 2 OR (len(refs) > 0 AND shared / greatest(len(refs), 1) >= 0.15)) THEN CASE WHEN want = 'yes' THEN 'yes_verdict_match' ELSE 'negation_verdict_match' END
  WHEN len(list_filter(alts, lambda a: contains({norm('actual')}, {norm('a')}))) > 0 THEN 'normalized_match'
  WHEN len(en) > 0 AND NOT no_info AND close_ >= 1 AND combined >= 0.35 THEN 'nums_' || close_ || '/' || len(en) || '_words_' || matched || '/' || len(ew)
  WHEN len(ew) > 0 AND NOT no_info AND ratio >= CASE WHEN len(ew) <= 5 THEN 0.35 ELSE 0.50 END THEN 'word_overlap_' || matched || '/' || len(ew)
  WHEN len(core) BETWEEN 1 AND 3 AND len(list_filter(core, lambda w: NOT contains(al, w))) = 0 THEN 'core_words_present'
  WHEN NOT no_info AND len(pe) > 0 AND pfound / len(pe) >= 0.30 AND alen > 20 THEN 'proper_noun_' || pfound || '/' || len(pe)
  ELSE 'open' END AS reason FROM s5),
scored AS (SELECT q_id, category, difficulty, latency_s, reason,
  CASE WHEN reason = 'open' THEN NULL ELSE reason NOT IN ('policy_no_answer', 'policy_empty', 'trick_hallucinated') END AS pass,
  round(CASE WHEN reason IN ('policy_no_answer', 'policy_empty', 'trick_hallucinated') THEN 0.0 WHEN reason = 'policy_answered' THEN 0.80 WHEN reason = 'name_one_words' THEN 0.95
    WHEN reason LIKE '%verdict_match' OR reason = 'core_words_present' THEN 0.85 WHEN reason LIKE 'nums%' THEN combined WHEN reason LIKE 'word_overlap%' THEN ratio
    WHEN reason LIKE 'proper%' THEN 0.80::DOUBLE + pfound / len(pe) * 0.15::DOUBLE WHEN reason = 'open' THEN NULL ELSE 1.0 END, 6) AS score FROM s6)"""


CHARS = """
cs AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS st, CASE WHEN {size} < length(text) AND {cut} > {size} * 0.5 THEN {cut} + 1 ELSE {size} END AS en, CAST(0 AS BIGINT) AS i
  FROM (SELECT doc_id, text, substr(text, 1, {size}) AS w FROM documents WHERE length(text) > 0)
  UNION ALL
  SELECT doc_id, text, b, b + CASE WHEN b + {size} < length(text) AND {cut} > {size} * 0.5 THEN {cut} + 1 ELSE {size} END, i + 1
  FROM (SELECT doc_id, text, en - {overlap} AS b, i, substr(text, en - {overlap} + 1, {size}) AS w FROM cs WHERE en - {overlap} < length(text))),
pieces AS (SELECT doc_id, i, trim(substr(text, st + 1, en - st), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS piece FROM cs)"""
#: The place of the last sentence or line end in a window w, from 0.
CUT = (
    "greatest(CASE WHEN contains(w, '. ') THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END, "
    "CASE WHEN contains(w, chr(10)) THEN length(w) - instr(reverse(w), chr(10)) ELSE -1 END)"
)


def _chars(size: int, overlap: int) -> str:
    return CHARS.replace("{size}", str(size)).replace("{overlap}", str(overlap)).replace("{cut}", CUT)


def oracles() -> dict[str, str]:
    a, v, e = _asked(), _asked(vectors=True), ENTITIES
    ee = (e, EDGES)
    customers = "lifecycle_state = 'TRUSTED' AND confidence >= 0.3 AND entity_type = 'Customer'"
    all_edges = "edges_ AS (SELECT * FROM edg)"
    out = {
        "entity_list": _with(e) + f"""SELECT entity_id, confidence, row_number() OVER (ORDER BY confidence DESC, entity_id) AS position FROM (
  SELECT entity_id, confidence FROM ent WHERE {customers} AND (contains(lower(coalesce(extracted_text, '')), 'customer#0000') OR contains(lower(coalesce(source_sentence, '')), 'customer#0000'))
  ORDER BY confidence DESC, entity_id LIMIT 50 OFFSET 5)""",
        "entity_page_total": _with(e) + f"SELECT count(*) AS total FROM ent WHERE {customers}",
        "entity_detail_neighbors": _with(*ee) + "SELECT relationship_id, relationship_type, source_name, target_name, confidence FROM whole WHERE 'Nation:7' IN (source_entity_id, target_entity_id)",
        "relationship_list": _with(*ee) + """SELECT relationship_id, source_name, target_name, confidence, row_number() OVER (ORDER BY confidence DESC, relationship_id) AS position FROM (
  SELECT * FROM whole WHERE source_type = 'Supplier' AND target_type = 'Part' AND relationship_type = 'SUPPLIES' AND confidence >= 0.5 ORDER BY confidence DESC, relationship_id LIMIT 60)""",
        "chunk_list": _with(CHUNKS) + """SELECT document_id, chunk_index, row_number() OVER (ORDER BY document_id, chunk_index) AS position FROM (
  SELECT * FROM chk WHERE (contains(lower(chunk_text), 'onble') OR contains(lower(document_title), 'onble')) AND contains(lower(document_title), 'en') AND document_type = 'src3'
  ORDER BY document_id, chunk_index LIMIT 50 OFFSET 2)""",
        "document_chunks": _with(CHUNKS) + "SELECT chunk_index, chunk_text FROM chk WHERE document_id = 'd-12'",
        "system_stats": _with(*ee, CHUNKS, RULES, FEEDBACK, SESSIONS) + """SELECT 'entities_' || coalesce(lower(lifecycle_state), 'total') AS metric, count(*) AS value FROM ent GROUP BY GROUPING SETS ((), (lifecycle_state))
UNION ALL SELECT 'edges', count(*) FROM edg UNION ALL SELECT 'chunks', count(*) FROM chk UNION ALL SELECT 'documents', count(DISTINCT document_id) FROM chk
UNION ALL SELECT 'rules', count(*) FROM rul UNION ALL SELECT 'feedback', count(*) FROM fbk UNION ALL SELECT 'sessions', count(*) FROM ses""",
        "staging_summary": _with(*ee) + """SELECT 'entity' AS kind, entity_type AS type, count(*) AS n FROM ent WHERE source_document_id = 'doc-3' AND lifecycle_state = 'STAGING' GROUP BY ALL
UNION ALL SELECT 'edge', relationship_type, count(*) FROM edg WHERE source_document_id = 'doc-3' AND lifecycle_state = 'STAGING' GROUP BY ALL""",
        "staging_sample": _with(e) + "SELECT entity_id, confidence FROM ent WHERE source_document_id = 'doc-3' AND lifecycle_state = 'STAGING' ORDER BY confidence DESC, entity_id LIMIT 10",
        "keyword_entities": _with(e, a, R1) + "SELECT query_id, entity_id, confidence, position FROM efound",
        "keyword_edges": _with(*ee, a, R2) + "SELECT query_id, relationship_id, confidence, position FROM rfound",
        "access_stat_update": _with(e, a, R1) + "SELECT entity_id, CAST(any_value(access_count) + count(*) AS INTEGER) AS access_count FROM ekept GROUP BY entity_id",
        "vector_topk": _with(CHUNKS, VECTORS, _vector("hits", 20)) + "SELECT query_id, document_id, chunk_index, similarity, rank FROM hits",
        "vector_topk_typed": _with(CHUNKS, VECTORS, _vector("hits", 20, "document_type = 'src3'")) + "SELECT query_id, document_id, chunk_index, similarity, rank FROM hits",
        "context_expansion": _with(CHUNKS, VECTORS, _vector("hits", 6), _expansion("hits")) + "SELECT query_id, document_id, chunk_index, doc_rank, similarity FROM ctx",
        "keyword_chunks": _with(CHUNKS, a, KEYWORDS) + "SELECT query_id, document_id, chunk_index, keyword_hits, similarity, rank FROM kfound",
        "hybrid_search": _with(CHUNKS, v, _vector("hits", 20), _expansion("hits"), KEYWORDS, HYBRID) + "SELECT * FROM hyb",
        "applicable_rules": _with(e, a, R1, RULES, APPLICABLE) + "SELECT query_id, rule_name, priority, rank FROM app",
        "session_context": _with(SESSIONS) + """SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn) AS position FROM (
  SELECT * FROM ses QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, turn DESC) <= 5)""",
        "uncertainty_report": _with(*ee, CHUNKS, a, R1, R2, KEYWORDS, "docs_found AS (SELECT query_id FROM kfound)", UNCERTAIN)
        + "SELECT query_id, overall_confidence, recommendation, high_facts, medium_facts, low_facts, low_items, reasons FROM report",
        "evidence_chain": _with(e, CHUNKS, v, R1, _vector("hits", 20)) + """SELECT query_id, 'entity' AS kind, entity_id AS source, position, confidence FROM efound WHERE position <= 5 AND confidence >= 0.7
UNION ALL SELECT query_id, 'document', document_id || '#' || chunk_index, rank, similarity FROM hits WHERE rank <= 3 AND similarity >= 0.7""",
        "dup_groups": _with(e) + """SELECT lower(coalesce(extracted_text, source_sentence)) AS label, entity_type, string_agg(entity_id, ',' ORDER BY confidence DESC, entity_id) AS ids,
  string_agg(DISTINCT source_document_id, ',' ORDER BY source_document_id) AS documents, count(*) AS n FROM ent WHERE lifecycle_state = 'STAGING' GROUP BY 1, 2 HAVING count(*) > 1""",
        "conflicts": _with(e) + """SELECT 'duplicate' AS kind, 'medium' AS severity, entity_type, string_agg(entity_id, ',' ORDER BY entity_id) AS entity_ids FROM ent
  WHERE lifecycle_state = 'TRUSTED' GROUP BY entity_type, lower(coalesce(extracted_text, source_sentence)) HAVING count(*) > 1
UNION ALL SELECT 'unresolved', 'high', entity_type, entity_id FROM ent WHERE lifecycle_state = 'TRUSTED' AND NOT resolved""",
        "dedup_entities": _with(e) + """, x AS (SELECT *, ' ' || coalesce(extracted_text, source_sentence) AS nm, CAST(instr('RNSCP', entity_id[1]) AS BIGINT) * 10000000000
    + CAST(regexp_extract(entity_id, ':(\\d+)', 1) AS BIGINT) * 10 + CAST(ends_with(entity_id, ':dup') AS BIGINT) AS seq FROM ent)
SELECT lower(trim(entity_type)) AS k_type, lower(trim(nm)) AS k_name, min(seq) AS seq, arg_min(nm, seq) AS canonical_name, max(confidence) AS confidence,
  first(source_sentence ORDER BY confidence DESC, seq) AS source_sentence, count(*) AS extraction_count FROM x GROUP BY 1, 2""",
        "dedup_relationships": _with(*ee) + """, x AS (SELECT *, CAST(regexp_extract(source_entity_id, ':(\\d+)', 1) AS BIGINT) * 1000000 + CAST(regexp_extract(target_entity_id, ':(\\d+)', 1) AS BIGINT) AS seq
  FROM whole)
SELECT lower(trim(source_type)) AS k_source, upper(relationship_type) AS k_type, lower(trim(target_name)) AS k_target, min(seq) AS seq, max(confidence) AS confidence,
  first(relationship_id ORDER BY confidence DESC, seq) AS source_sentence, count(*) AS extraction_count FROM x GROUP BY 1, 2, 3""",
        "merge_duplicates_entities": _with(e, MERGE) + """SELECT entity_id, CASE WHEN survivor <> entity_id THEN 'ARCHIVED' ELSE lifecycle_state END AS lifecycle_state,
  round(CASE WHEN survivor = entity_id THEN raised ELSE confidence END, 6) AS confidence, CASE WHEN survivor <> entity_id THEN survivor END AS merged_into,
  CASE WHEN survivor <> entity_id THEN 'dedup_merge' END AS merge_reason FROM ent LEFT JOIN mplan USING (entity_id)""",
        "merge_duplicates_edges": _with(*ee, MERGE) + """SELECT relationship_id, coalesce(s.survivor, source_entity_id) AS source_entity_id, coalesce(t.survivor, target_entity_id) AS target_entity_id
FROM edg LEFT JOIN mplan s ON s.entity_id = source_entity_id LEFT JOIN mplan t ON t.entity_id = target_entity_id""",
        "cross_doc_matches": _with(e, CROSS) + "SELECT staging_id, trusted_id, staging_document, trusted_document FROM cross_m",
        "cross_doc_resolve": _with(e, CROSS) + """, boost AS (SELECT trusted_id AS entity_id, count(*) AS n FROM cross_m GROUP BY 1),
gone AS (SELECT staging_id AS entity_id, first(trusted_id ORDER BY tc DESC, trusted_id) AS survivor FROM cross_m GROUP BY 1)
SELECT entity_id, CASE WHEN survivor IS NOT NULL THEN 'ARCHIVED' ELSE lifecycle_state END AS lifecycle_state,
  round(CASE WHEN n > 0 THEN least(confidence + n * 0.03::DOUBLE, 1.0::DOUBLE) ELSE confidence END, 6) AS confidence, survivor AS resolved_into
FROM ent LEFT JOIN boost USING (entity_id) LEFT JOIN gone USING (entity_id)""",
        "conflict_history": _with(e, ROUNDS) + """SELECT entity_id, state AS lifecycle_state, concat_ws(',', 'dedup_merge:' || m, 'cross_doc_resolution:' || r) AS steps, true AS updated FROM ended WHERE m IS NOT NULL OR r IS NOT NULL""",
        "lineage_survivors": _with(e, ROUNDS) + "SELECT entity_id, coalesce(r, rm, m) AS survivor, CAST(1 + CAST(rm IS NOT NULL AS INTEGER) AS BIGINT) AS steps FROM ended WHERE m IS NOT NULL OR r IS NOT NULL",
        "lineage_edges": _with(*ee, ROUNDS) + """SELECT relationship_id, coalesce(s.r, s.rm, s.m, source_entity_id) AS source_entity_id, coalesce(t.r, t.rm, t.m, target_entity_id) AS target_entity_id
FROM edg LEFT JOIN ended s ON s.entity_id = source_entity_id LEFT JOIN ended t ON t.entity_id = target_entity_id""",
        "endpoint_validation": _with(*ee) + """, ok AS (SELECT lower(trim(entity_id)) AS k FROM ent WHERE lifecycle_state = 'TRUSTED')
SELECT relationship_id FROM edg WHERE lower(source_entity_id) IN (SELECT k FROM ok) AND lower(target_entity_id) IN (SELECT k FROM ok)""",
        "orphan_edges": _with(*ee) + """SELECT relationship_id, CASE WHEN s.entity_id IS NULL AND t.entity_id IS NULL THEN 'both' WHEN s.entity_id IS NULL THEN 'source' ELSE 'target' END AS missing
FROM edg LEFT JOIN ent s ON s.entity_id = source_entity_id LEFT JOIN ent t ON t.entity_id = target_entity_id WHERE s.entity_id IS NULL OR t.entity_id IS NULL""",
        "name_resolution": _with(e) + """, asked AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT c_name FROM customer UNION SELECT 'nobody'),
live AS (SELECT entity_id, lifecycle_state, confidence, created_at, lower(extracted_text) AS k FROM ent WHERE lifecycle_state IN ('STAGING', 'TRUSTED')
  UNION SELECT entity_id, lifecycle_state, confidence, created_at, lower(source_sentence) FROM ent WHERE lifecycle_state IN ('STAGING', 'TRUSTED')),
best AS (SELECT k, first(entity_id ORDER BY lifecycle_state = 'TRUSTED' DESC, confidence DESC, created_at DESC, entity_id) AS entity_id FROM live WHERE k IS NOT NULL GROUP BY k)
SELECT name, entity_id FROM asked LEFT JOIN best ON lower(name) = k""",
        "promote_bulk": _with(e, PROMOTED) + "SELECT entity_id, lifecycle_state FROM prom",
        "promote_evidence": _with(e, EVIDENCE) + "SELECT entity_id, CASE WHEN decision = 'promote' THEN 'TRUSTED' ELSE lifecycle_state END AS lifecycle_state FROM ent LEFT JOIN decided USING (entity_id)",
        "evidence_decisions": _with(e, EVIDENCE) + "SELECT decision, count(*) AS n FROM decided GROUP BY decision",
        "promote_edges": _with(*ee, PROMOTED) + """SELECT relationship_id, CASE WHEN edg.lifecycle_state = 'STAGING' AND s.lifecycle_state = 'TRUSTED' AND t.lifecycle_state = 'TRUSTED' THEN 'TRUSTED' ELSE edg.lifecycle_state END AS lifecycle_state
FROM edg LEFT JOIN prom s ON s.entity_id = source_entity_id LEFT JOIN prom t ON t.entity_id = target_entity_id""",
        "promote_one": _with(e) + """SELECT i.entity_id, CASE WHEN lifecycle_state IS NULL THEN 'not_found' WHEN lifecycle_state = 'STAGING' THEN 'ok' ELSE 'wrong_state' END AS status
FROM (VALUES ('Customer:1'), ('Customer:6'), ('Nobody:1')) AS i(entity_id) LEFT JOIN ent USING (entity_id)""",
        "demote_one": _with(e) + """SELECT CASE WHEN entity_id IN ('Customer:1', 'Customer:6') AND lifecycle_state = 'TRUSTED' THEN 'ARCHIVED' ELSE lifecycle_state END AS lifecycle_state, count(*) AS n FROM ent GROUP BY 1""",
        "stale_entities": _with(e) + """SELECT entity_id, access_count, last_accessed FROM ent WHERE lifecycle_state = 'TRUSTED' AND (last_accessed IS NULL OR last_accessed < TIMESTAMP '2024-04-20' - INTERVAL 90 DAY)
ORDER BY access_count, last_accessed NULLS FIRST, entity_id LIMIT 100""",
        "feedback_fold": _with(e, FEEDBACK, _fold("""chg AS (SELECT entity_id, created_at AS s1, feedback_id AS s2, CAST(CASE judgment WHEN 'correct' THEN 0.03 WHEN 'incorrect' THEN -0.05 WHEN 'partial' THEN -0.02 ELSE 0 END AS DOUBLE) AS delta FROM fbk)"""), recursive=True)
        + "SELECT entity_id, s AS lifecycle_state, round(c, 6) AS confidence, n_changes FROM folded",
        "feedback_by_response": _with(e, _fold("""j AS (SELECT event_id, ts, CAST(CASE event_type WHEN 'purchase' THEN 0.03 WHEN 'error' THEN -0.05 WHEN 'click' THEN -0.02 WHEN 'view' THEN 0 END AS DOUBLE) AS delta, event_id % 500 AS b FROM events WHERE event_id % 7 <> 0),
chg AS (SELECT 'Customer:' || b AS entity_id, ts AS s1, event_id AS s2, delta FROM j WHERE b < 400 UNION ALL SELECT 'Supplier:' || (b % 10), ts, event_id, delta FROM j WHERE b < 400)"""), recursive=True)
        + "SELECT entity_id, s AS lifecycle_state, round(c, 6) AS confidence, n_changes FROM folded",
        "feedback_records": """SELECT CAST(event_id AS VARCHAR) AS id, 'b' || (event_id % 500) AS bundle_id, 'what did ' || user_id || ' do?' AS query_text, event_type AS response_text,
  CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'incorrect' WHEN 'click' THEN 'partial' ELSE 'uncertain' END AS judgment, CASE WHEN event_id % 3 = 0 THEN 'major' END AS severity,
  CASE WHEN event_id % 500 < 400 THEN 'Customer:' || (event_id % 500) || ',Supplier:' || (event_id % 500 % 10) END AS entities
FROM events WHERE event_type <> 'signup' AND event_id % 7 <> 0 AND event_id % 3 <> 1""",
        "feedback_errors": """SELECT event_id AS feedback_id, CASE WHEN event_id % 7 = 0 THEN 'none' ELSE 'r' || event_id END AS response_id,
  CASE WHEN event_type = 'signup' THEN 'unknown judgment' ELSE 'unknown response' END AS error FROM events WHERE event_type = 'signup' OR event_id % 7 = 0 OR event_id % 500 >= 400""",
        "fileback_fold": _with(e, _fold("""resp AS (SELECT event_id, user_id, CAST(CASE WHEN event_id % 10 / 10.0 < 0.4 THEN -0.02 ELSE 0.01 END AS DOUBLE) AS delta FROM events),
chg AS (SELECT 'Customer:' || user_id AS entity_id, event_id AS s1, 0 AS s2, delta FROM resp UNION ALL SELECT 'Supplier:' || (user_id % 10), event_id, 0, delta FROM resp)"""), recursive=True)
        + "SELECT entity_id, round(c, 6) AS confidence, n_changes FROM folded",
        "confidence_calibration": _with(e, FEEDBACK) + """SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bucket, count(*) AS n, round(avg(confidence), 6) AS predicted, round(avg(CAST(judgment = 'correct' AS DOUBLE)), 6) AS actual,
  round(abs(avg(confidence) - avg(CAST(judgment = 'correct' AS DOUBLE))), 6) AS gap FROM fbk JOIN ent USING (entity_id) GROUP BY 1""",
        "rule_evolution": _with(RULES) + """, r AS (SELECT *, CASE WHEN NOT enabled THEN 'none' WHEN times_applied >= 50 AND times_violated / greatest(times_applied, 1) > 0.8 THEN 'disable'
  WHEN times_applied >= 20 AND times_violated = 0 THEN 'raise' WHEN times_applied >= 20 AND times_violated / greatest(times_applied, 1) BETWEEN 0.4 AND 0.8 THEN 'lower' ELSE 'none' END AS action FROM rul)
SELECT rule_name, CAST(CASE action WHEN 'raise' THEN priority + 1 WHEN 'lower' THEN greatest(priority - 1, 0) ELSE priority END AS INTEGER) AS priority, enabled AND action <> 'disable' AS enabled, action FROM r""",
        "rule_validation": _with(*ee, a, R1, R2, RULES, APPLICABLE) + """, unowned AS (
  SELECT query_id, first(entity_id ORDER BY position, entity_id) AS u FROM efound x WHERE entity_type = 'Part'
    AND NOT EXISTS (SELECT 1 FROM rfound r WHERE r.query_id = x.query_id AND r.relationship_type = 'SUPPLIES' AND r.target_entity_id = x.entity_id) GROUP BY query_id),
kinds AS (SELECT query_id, rule_name, CASE WHEN contains(lower(condition), 'must have') AND contains(lower(condition), 'owner') THEN 'owner' WHEN contains(lower(condition), 'circuit breaker') THEN 'circuit_breaker'
  WHEN contains(lower(condition), 'escalation') THEN 'escalation' ELSE 'none' END AS kind FROM app)
SELECT query_id, rule_name, kind, CASE WHEN kind = 'owner' AND u IS NOT NULL THEN 'violation' WHEN kind = 'escalation' AND query_id % 2 = 0 THEN 'caveat' ELSE 'pass' END AS outcome,
  CASE WHEN kind = 'owner' THEN u END AS detail FROM kinds LEFT JOIN unowned USING (query_id)""",
        "owner_violations": _with(*ee, a, R1, R2) + """SELECT query_id, first(entity_id ORDER BY position, entity_id) AS entity_id, 'warning' AS severity FROM efound x WHERE entity_type = 'Part'
  AND NOT EXISTS (SELECT 1 FROM rfound r WHERE r.query_id = x.query_id AND r.relationship_type = 'SUPPLIES' AND r.target_entity_id = x.entity_id) GROUP BY query_id""",
        "rule_counters": _with(RULES, FEEDBACK) + """, t AS (SELECT 'rule-' || regexp_extract(entity_id, ':(\\d+)', 1) AS rule_name, count(*) AS c, count(*) FILTER (judgment = 'incorrect') AS v FROM fbk GROUP BY 1)
SELECT rule_name, CAST(times_applied + coalesce(c, 0) AS INTEGER) AS times_applied, CAST(times_violated + coalesce(v, 0) AS INTEGER) AS times_violated FROM rul LEFT JOIN t USING (rule_name)""",
        "char_chunks": _with(_chars(800, 100), recursive=True) + """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, md5(piece) AS digest, CAST(length(piece) AS INTEGER) AS chars FROM pieces WHERE piece <> ''""",
        "extract_chunks": _with(_chars(1000, 100), recursive=True) + "SELECT doc_id, count(*) AS chunks, CAST(sum(length(piece)) AS BIGINT) AS chars FROM pieces WHERE piece <> '' GROUP BY doc_id",
        "wiki_pages": _with(*ee, all_edges) + """, mem AS (SELECT *, lower(extracted_text) AS k FROM ent WHERE lifecycle_state = 'TRUSTED' AND extracted_text IS NOT NULL),
pg AS (SELECT DISTINCT entity_type, extracted_text AS title, k FROM mem),
fc AS (SELECT entity_type, k, round(avg(confidence), 6) AS confidence_avg, count(*) AS n_entities, count(DISTINCT source_document_id) AS n_sources FROM mem GROUP BY 1, 2),
titles AS (SELECT 'doc-' || doc_id AS source_document_id, min('Document ' || lang || ' ' || doc_id) AS title FROM documents WHERE doc_id < 50 AND doc_id % 2 = 0 GROUP BY 1),
srcs AS (SELECT entity_type, k, string_agg('- ' || coalesce(title, source_document_id), chr(10) ORDER BY source_document_id) AS src
  FROM (SELECT DISTINCT entity_type, k, source_document_id FROM mem WHERE source_document_id IS NOT NULL) LEFT JOIN titles USING (source_document_id) GROUP BY 1, 2),
tch AS (SELECT m.entity_type, m.k, e.relationship_id, e.relationship_type, e.confidence, e.target_entity_id AS other, '->' AS arrow FROM edges_ e JOIN mem m ON m.entity_id = e.source_entity_id WHERE e.lifecycle_state = 'TRUSTED'
  UNION ALL SELECT m.entity_type, m.k, e.relationship_id, e.relationship_type, e.confidence, e.source_entity_id, '<-' FROM edges_ e JOIN mem m ON m.entity_id = e.target_entity_id WHERE e.lifecycle_state = 'TRUSTED'),
one AS (SELECT * FROM tch QUALIFY row_number() OVER (PARTITION BY entity_type, k, relationship_id ORDER BY arrow DESC, other DESC) = 1),
ln AS (SELECT one.entity_type, one.k, count(*) AS n_edges, string_agg('- ' || arrow || ' **' || relationship_type || '** ' || coalesce(o.extracted_text, o.source_sentence, ''), chr(10) ORDER BY one.confidence DESC, relationship_id) AS txt
  FROM one JOIN ent o ON o.entity_id = other GROUP BY 1, 2)
SELECT pg.entity_type, pg.title, confidence_avg, n_entities, coalesce(n_edges, 0) AS n_edges, n_sources,
  '# ' || pg.title || chr(10) || 'Type: ' || pg.entity_type || chr(10) || 'Confidence: ' || CAST(floor(confidence_avg * 100 + 0.5) AS INTEGER) || '%' || chr(10) || '## Relationships' || chr(10) || coalesce(txt, 'None') || chr(10) || '## Sources' || chr(10) || src AS markdown
FROM pg JOIN fc USING (entity_type, k) LEFT JOIN srcs USING (entity_type, k) LEFT JOIN ln USING (entity_type, k)""",
        "wiki_page_parts": _with(*ee, _page_parts(titled=True)),
        "wiki_refresh": _with(*ee, """
ent2 AS (SELECT * REPLACE (CASE WHEN lifecycle_state = 'STAGING' AND confidence >= 0.9 THEN 'TRUSTED' ELSE lifecycle_state END AS lifecycle_state) FROM ent),
edg2 AS (SELECT g.* REPLACE (CASE WHEN g.lifecycle_state = 'STAGING' AND s.lifecycle_state = 'TRUSTED' AND t.lifecycle_state = 'TRUSTED' THEN 'TRUSTED' ELSE g.lifecycle_state END AS lifecycle_state)
  FROM edg g LEFT JOIN ent2 s ON s.entity_id = source_entity_id LEFT JOIN ent2 t ON t.entity_id = target_entity_id)""", _page_parts("ent2", "edg2")),
        "wiki_list": _with(e) + """SELECT title, row_number() OVER (ORDER BY title) AS position FROM (
  SELECT DISTINCT extracted_text AS title FROM ent WHERE lifecycle_state = 'TRUSTED' AND entity_type = 'Part' AND contains(lower(extracted_text), 'ring') ORDER BY title LIMIT 20)""",
        "wm_upsert": _with(MEMORY) + "SELECT * FROM mem",
        "wm_get_all": _with(MEMORY) + "SELECT key, value, step_number, row_number() OVER (ORDER BY step_number, created_at, key) AS position FROM mem WHERE session_id = '7' AND expires_at > TIMESTAMP '2024-01-20'",
        "wm_delete": _with(MEMORY) + "SELECT count(*) AS deleted FROM mem WHERE session_id = '7'",
        "ttl_cleanup": _with(MEMORY) + "SELECT session_id, count(*) AS n FROM mem WHERE NOT expires_at < TIMESTAMP '2024-01-20' GROUP BY session_id",
        "cache_lookup": _with(SESSIONS) + f""", pl AS (SELECT *, CAST(session_id AS BIGINT) AS vec_id FROM ses),
cch AS (SELECT session_id || ':' || turn AS id, sha256(lower(trim(query_text))) AS h, embedding AS qe, 'answer ' || session_id AS rj, created_at, created_at + to_days(CAST(vec_id % 40 AS INTEGER)) AS expires_at FROM pl LEFT JOIN embeddings USING (vec_id)),
live AS (SELECT * FROM cch WHERE expires_at > TIMESTAMP '2024-01-20'),
q AS (SELECT vec_id * 1000 + turn AS query_id, CASE WHEN turn % 3 = 0 THEN translate(query_text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE 'x' || query_text END AS query, embedding AS v FROM pl JOIN embeddings USING (vec_id)),
ex AS (SELECT h, first(rj ORDER BY created_at DESC, id DESC) AS rj FROM live GROUP BY h),
nr AS (SELECT query_id, rj, {COSINE.format('qe', 'v')} AS sim, created_at, id FROM live, q WHERE qe IS NOT NULL),
nb AS (SELECT query_id, first(rj ORDER BY sim DESC, created_at DESC, id DESC) AS rj, max(sim) AS sim FROM nr WHERE sim >= 0.95 GROUP BY query_id)
SELECT query_id, CASE WHEN ex.rj IS NOT NULL THEN 'exact' WHEN nb.rj IS NOT NULL THEN 'semantic' ELSE 'miss' END AS hit, coalesce(ex.rj, nb.rj) AS response_json, CASE WHEN ex.rj IS NOT NULL THEN 1.0 ELSE nb.sim END AS similarity
FROM q LEFT JOIN ex ON ex.h = sha256(lower(trim(query))) LEFT JOIN nb USING (query_id)""",
        "score_answers": _with(_answers(), _score()) + "SELECT q_id, pass, score, reason FROM scored",
        "eval_summary": _with(_answers(), _score()) + """SELECT count(*) AS total, count(*) FILTER (pass) AS passed, round(avg(CAST(coalesce(pass, false) AS DOUBLE)), 6) AS pass_rate, round(avg(CAST(coalesce(score, 0) AS DOUBLE)), 6) AS avg_score,
  round(avg(CAST(latency_s AS DOUBLE)), 6) AS avg_latency FROM scored""",
        "eval_breakdown": _with(_answers(), _score()) + """SELECT 'category' AS dimension, lower(category) AS level, count(*) AS total, count(*) FILTER (pass) AS passed FROM scored GROUP BY 2
UNION ALL SELECT 'difficulty', lower(difficulty), count(*), count(*) FILTER (pass) FROM scored GROUP BY 2""",
        "khop_2": _with(*ee, all_edges, """both_ AS (SELECT source_entity_id AS x, target_entity_id AS y FROM edges_ WHERE lifecycle_state = 'TRUSTED' UNION SELECT target_entity_id, source_entity_id FROM edges_ WHERE lifecycle_state = 'TRUSTED'),
walk AS (SELECT s AS seed, s AS entity_id, 0 AS hop FROM (VALUES ('Region:2'), ('Supplier:3')) AS v(s) UNION SELECT seed, y, hop + 1 FROM walk JOIN both_ ON x = entity_id WHERE hop < 2)""", recursive=True)
        + "SELECT seed, entity_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY 1, 2",
        "khop_suppliers": _with(*ee, """both_ AS (SELECT source_entity_id AS x, target_entity_id AS y FROM edg WHERE lifecycle_state = 'TRUSTED' AND relationship_type <> 'SUPPLIES'
  UNION SELECT target_entity_id, source_entity_id FROM edg WHERE lifecycle_state = 'TRUSTED' AND relationship_type <> 'SUPPLIES'),
walk AS (SELECT 'Supplier:' || s_suppkey AS seed, 'Supplier:' || s_suppkey AS entity_id, 0 AS hop FROM supplier UNION SELECT seed, y, hop + 1 FROM walk JOIN both_ ON x = entity_id WHERE hop < 2)""", recursive=True)
        + "SELECT seed, hop, count(*) AS n FROM (SELECT seed, entity_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY 1, 2) GROUP BY 1, 2",
        "ingest_documents": _with(*ee, ROUNDS, """
cml AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS c FROM part),
lst AS (SELECT max(p_partkey) AS last FROM part),
rpt AS (SELECT a.c AS a, b.c AS b, c.c AS c FROM documents, lst JOIN cml a ON a.p_partkey = doc_id % last + 1 JOIN cml b ON b.p_partkey = doc_id * 3 % last + 1 JOIN cml c ON c.p_partkey = doc_id * 7 % last + 1)""")
        + """SELECT 'entity' AS kind, entity_type AS type, state AS lifecycle_state, count(*) AS n FROM ended JOIN ent USING (entity_id) GROUP BY 1, 2, 3
UNION ALL SELECT 'entity', 'Team', 'STAGING', count(DISTINCT a) FROM rpt UNION ALL SELECT 'entity', 'Service', 'STAGING', count(DISTINCT b) FROM rpt UNION ALL SELECT 'entity', 'Database', 'STAGING', count(DISTINCT c) FROM rpt
UNION ALL SELECT 'edge', relationship_type, lifecycle_state, count(*) FROM edg GROUP BY 1, 2, 3
UNION ALL SELECT 'edge', 'OWNS', 'STAGING', count(DISTINCT (a, b)) FROM rpt UNION ALL SELECT 'edge', 'DEPENDS_ON', 'STAGING', count(DISTINCT (b, c)) FROM rpt""",
        "name_mentions": _with(_asked(), """
nms AS (SELECT DISTINCT translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name FROM (
  SELECT regexp_extract(text, '^\\S+\\s+\\S+\\s+\\S+') AS name FROM benchmark UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation) WHERE name <> ''),
txt AS (SELECT document_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (
  SELECT 'd-' || doc_id AS document_id, text FROM documents UNION ALL SELECT 'q-' || query_id, query FROM qsts)),
met AS (SELECT document_id, name, t, string_split(t, name) AS gaps FROM txt JOIN nms ON contains(t, name)),
plc AS (SELECT document_id, name, t, unnest(list_transform(range(1, len(gaps)), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * length(name))) AS s FROM met)""")
        + """SELECT document_id, name, CAST(s AS INTEGER) AS start, CAST(s + length(name) AS INTEGER) AS end FROM plc
WHERE NOT regexp_matches(substr(t, CAST(s AS BIGINT), 1), '^[a-z0-9]$') AND NOT regexp_matches(substr(t, CAST(s + length(name) + 1 AS BIGINT), 1), '^[a-z0-9]$') OR (s = 0 AND NOT regexp_matches(substr(t, length(name) + 1, 1), '^[a-z0-9]$'))""",
        "insert_entities": _with(e) + """, fresh AS (SELECT 'Customer:' || (c_custkey + 500) AS id FROM customer)
SELECT entity_type, lifecycle_state, count(*) AS n, round(sum(confidence), 4) AS confidence FROM (SELECT entity_type, lifecycle_state, confidence FROM ent
  UNION ALL SELECT 'Customer', 'STAGING', 0.95::DOUBLE FROM fresh WHERE id NOT IN (SELECT entity_id FROM ent)) GROUP BY 1, 2""",
        "insert_edges": """SELECT DISTINCT 'o>' || o_custkey AS relationship_id, CASE WHEN o_custkey % 7 < 5 THEN 'stored' ELSE 'error' END AS status FROM orders""",
        "maintenance": _with(e, RULES, MEMORY) + """SELECT 'conflicts' AS task, (SELECT count(*) FROM (SELECT 1 FROM ent WHERE lifecycle_state = 'TRUSTED' GROUP BY entity_type, lower(coalesce(extracted_text, source_sentence)) HAVING count(*) > 1))
  + (SELECT count(*) FROM ent WHERE lifecycle_state = 'TRUSTED' AND NOT resolved) AS n
UNION ALL SELECT 'stale', least(100, count(*)) FROM ent WHERE lifecycle_state = 'TRUSTED' AND (last_accessed IS NULL OR last_accessed < TIMESTAMP '2024-01-20' - INTERVAL 90 DAY)
UNION ALL SELECT 'rules_changed', count(*) FROM rul WHERE enabled AND ((times_applied >= 50 AND times_violated / greatest(times_applied, 1) > 0.8) OR (times_applied >= 20 AND (times_violated = 0 OR times_violated / greatest(times_applied, 1) BETWEEN 0.4 AND 0.8)))
UNION ALL SELECT 'expired', count(*) FROM mem WHERE expires_at < TIMESTAMP '2024-01-20'""",
        "context_bundle": _with(*ee, CHUNKS, v, R1, R2, RULES, APPLICABLE, SESSIONS, _vector("hits", 20), _expansion("hits"), KEYWORDS, HYBRID, "docs_found AS (SELECT query_id FROM hyb)", UNCERTAIN)
        + """SELECT q.query_id, q.query, overall_confidence, recommendation, high_facts, medium_facts, low_facts,
  coalesce((SELECT string_agg(entity_id, ',' ORDER BY position) FROM efound x WHERE x.query_id = q.query_id), '') AS entity_ids,
  coalesce((SELECT string_agg(relationship_id, ',' ORDER BY position) FROM rfound x WHERE x.query_id = q.query_id), '') AS relationship_ids,
  coalesce((SELECT string_agg(document_id || '#' || chunk_index, ',' ORDER BY position) FROM hyb x WHERE x.query_id = q.query_id), '') AS chunk_ids,
  coalesce((SELECT string_agg(rule_name, ',' ORDER BY rank) FROM app x WHERE x.query_id = q.query_id), '') AS rule_names,
  coalesce((SELECT string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FROM (SELECT * FROM ses QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 5) s WHERE s.session_id = q.session_id), '') AS turns
FROM qry q JOIN report USING (query_id)""",
    }
    return out
