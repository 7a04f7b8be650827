"""DuckDB SQL for the registered queries of the engine, written apart from the Spark plans."""

from __future__ import annotations

from .reasoning import ORACLES as REASONING

E_NS, P_NS = "http://loomgraph.local/entity/", "http://loomgraph.local/property/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

LEVEL = "CASE WHEN {0} >= 0.99::DOUBLE THEN 'verified' WHEN {0} >= 0.90::DOUBLE THEN 'high' WHEN {0} >= 0.70::DOUBLE THEN 'medium' WHEN {0} >= 0.50::DOUBLE THEN 'low' ELSE 'uncertain' END"


def _chunks() -> str:
    return r"""
d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
c0 AS (
  SELECT doc_id, text, low, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cs
  FROM d),
ch AS (SELECT doc_id, unnest(range(len(cs)))::INTEGER AS chunk_idx, unnest(cs) AS chunk FROM c0)"""


def _scored(max_entities: int = 1000, max_triples: int = 5000) -> str:
    """CTEs up to sc: every scored triple of every document."""
    return _chunks() + rf""",
m0 AS (SELECT *, regexp_extract_all(chunk, '\p{{Lu}}[\p{{L}}\p{{N}}_]+') AS ms FROM ch),
me AS (SELECT doc_id, chunk_idx, unnest(range(len(ms)))::INTEGER AS ent_idx, unnest(ms) AS text, left(chunk, 100) AS source FROM m0),
mu AS (SELECT *, chunk_idx::BIGINT * 1000000 + ent_idx AS place, '{E_NS}' || regexp_replace(replace(lower(text), ' ', '_'), '[^a-z0-9_]', '', 'g') AS uri FROM me),
en AS (SELECT doc_id, uri, count(*) AS n, arg_min(text, place) AS label, arg_min(source, place) AS source, min(place) AS place FROM mu GROUP BY doc_id, uri),
el AS (
  SELECT * FROM (
    SELECT *, least(1.0::DOUBLE, 0.8::DOUBLE + least(0.2::DOUBLE, 0.05::DOUBLE * n)) AS confidence, (row_number() OVER (PARTITION BY doc_id ORDER BY place))::INTEGER AS rank FROM en)
  WHERE rank <= {max_entities}),
rr AS (
  SELECT doc_id, chunk_idx, chunk, unnest(range(len(ms) - 1))::INTEGER AS rel_idx, unnest(ms[1:len(ms) - 1]) AS subject, unnest(ms[2:len(ms)]) AS object
  FROM m0 WHERE len(ms) > 1),
lk AS (
  SELECT rr.*, s.uri AS s, '{P_NS}mentioned_with' AS p, o.uri AS o, lower(s.label) AS sl, lower(o.label) AS ol, s.confidence AS sc, o.confidence AS oc
  FROM rr JOIN el s ON s.doc_id = rr.doc_id AND lower(s.label) = lower(rr.subject) JOIN el o ON o.doc_id = rr.doc_id AND lower(o.label) = lower(rr.object)),
tr AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, rel_idx))::INTEGER AS seq FROM lk) WHERE seq <= {max_triples}),
ev AS (
  SELECT tr.*, (CASE WHEN sl = '' OR ol = '' THEN 0.5 WHEN instr(low, sl) > 0 AND instr(low, ol) > 0
    THEN CASE WHEN abs(instr(low, sl) - instr(low, ol)) < 50 THEN 1.0 WHEN abs(instr(low, sl) - instr(low, ol)) < 200 THEN 0.8 ELSE 0.6 END ELSE 0.3 END)::DOUBLE AS evidence
  FROM tr JOIN d USING (doc_id)),
ne AS (SELECT *, least(1.0::DOUBLE, 0.75::DOUBLE * 0.5::DOUBLE + ((sc + oc) / 2) * 0.3::DOUBLE + evidence * 0.2::DOUBLE) AS neural FROM ev),
sco AS (SELECT *, {LEVEL.format('neural')} AS confidence_level, least(1.0::DOUBLE, 0.7::DOUBLE * neural + 0.3::DOUBLE * 1.0::DOUBLE) AS confidence FROM ne)"""


KG = """
kg AS (
  SELECT 1000000000000 + n_nationkey AS seq, 'kg:nation/' || n_nationkey AS s, 'kg:inRegion' AS p, 'kg:region/' || n_regionkey AS o FROM nation
  UNION ALL SELECT 2000000000000 + c_custkey, 'kg:customer/' || c_custkey, 'kg:locatedIn', 'kg:nation/' || c_nationkey FROM customer
  UNION ALL SELECT 3000000000000 + s_suppkey, 'kg:supplier/' || s_suppkey, 'kg:locatedIn', 'kg:nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 4000000000000 + o_orderkey, 'kg:order/' || o_orderkey, 'kg:placedBy', 'kg:customer/' || o_custkey FROM orders
  UNION ALL SELECT 5000000000000 + l_orderkey * 10 + l_linenumber, 'kg:order/' || l_orderkey, 'kg:contains', 'kg:part/' || l_partkey FROM lineitem
  UNION ALL SELECT 6000000000000 + l_orderkey * 10 + l_linenumber, 'kg:part/' || l_partkey, 'kg:suppliedBy', 'kg:supplier/' || l_suppkey FROM lineitem
  UNION ALL SELECT 7000000000000 + event_id, 'kg:user/' || user_id, 'kg:performed', 'kg:event/' || event_type FROM events),
sk AS (SELECT * FROM kg WHERE p IN ('kg:inRegion', 'kg:locatedIn')),
edge AS (SELECT least(s, o) AS a, greatest(s, o) AS b, arg_max(p, seq) AS property FROM kg GROUP BY 1, 2)"""

TYPES = f"""
ty0 AS (
  SELECT 'kg:nation/' || n_nationkey AS uri, 'onto:Nation' AS type FROM nation UNION ALL SELECT 'kg:region/' || r_regionkey, 'onto:Region' FROM region
  UNION ALL SELECT 'kg:customer/' || c_custkey, 'onto:Customer' FROM customer UNION ALL SELECT 'kg:supplier/' || s_suppkey, 'onto:Supplier' FROM supplier
  UNION ALL SELECT 'kg:supplier/1', 'onto:Place' WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1)),
up(child, parent) AS (VALUES ('onto:Region', 'onto:Place'), ('onto:Nation', 'onto:Place'), ('onto:Customer', 'onto:Agent'), ('onto:Supplier', 'onto:Agent'), ('onto:View', 'onto:Event'), ('onto:Click', 'onto:Event')),
ty AS (SELECT DISTINCT uri, type FROM (SELECT * FROM ty0 UNION ALL SELECT uri, parent FROM ty0 JOIN up ON type = child))"""

CLASSES = """
cl(ord, uri, label) AS (VALUES (0, 'onto:Place', 'Place'), (1, 'onto:Region', 'Region'), (2, 'onto:Nation', 'Nation'), (3, 'onto:Agent', 'Agent'), (4, 'onto:Customer', 'Customer'),
  (5, 'onto:Supplier', 'Supplier of goods'), (6, 'onto:Event', 'Purchase event'), (7, 'onto:View', 'page view'), (8, 'onto:Click', 'click'))"""

ORACLES: dict[str, str] = dict(REASONING)


def _put(name: str, sql: str) -> None:
    ORACLES[name] = sql


def _docs(name: str, select: str, **limits: int) -> None:
    _put(name, f"WITH {_scored(**limits)} {select}")


def _kg(name: str, select: str, more: str = "") -> None:
    _put(name, f"WITH RECURSIVE {KG}{', ' + more if more else ''} {select}")


_docs("extract_knowledge", "SELECT doc_id, seq, s, p, o, confidence, confidence_level FROM sco WHERE confidence >= 0.7::DOUBLE")
_docs("chunk_counts", "SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY doc_id")
_docs("chunks", "SELECT doc_id, chunk_idx, chunk FROM ch")
_docs("entity_mentions", "SELECT doc_id, uri, label, n, source FROM en")
_docs("entity_boost", "SELECT doc_id, uri, n, confidence FROM el")
_docs("entity_limit", "SELECT doc_id, uri, rank FROM el", max_entities=5)
_docs("entity_levels", f"SELECT {LEVEL.format('confidence')} AS level, count(*) AS n FROM el GROUP BY 1")
_docs("relation_pairs", "SELECT doc_id, chunk_idx, rel_idx, s, p, o FROM lk")
_docs("relation_types", "SELECT DISTINCT doc_id, p AS uri, 'mentioned with' AS label FROM lk")
_docs("triple_scores", "SELECT doc_id, seq, s, o, evidence, neural, confidence_level, confidence FROM sco")
_docs("triple_limit", "SELECT doc_id, seq, s, o FROM sco", max_triples=2)
_docs("evidence_buckets", "SELECT evidence, count(*) AS n FROM sco GROUP BY evidence")
_docs("confidence_levels", "SELECT confidence_level, count(*) AS n FROM sco GROUP BY 1")
_docs("hybrid_filter", "SELECT doc_id, seq, s, o, confidence FROM sco WHERE confidence >= 0.85::DOUBLE")
_docs(
    "doc_confidence",
    f""", a AS (SELECT doc_id, count(*) AS n_triples, avg(confidence) AS confidence FROM sco GROUP BY doc_id),
b AS (SELECT doc_id, length(text)::BIGINT AS text_length, len(cs)::INTEGER AS n_chunks, coalesce(n_triples, 0) AS n_triples, coalesce(confidence, 0) AS c FROM c0 LEFT JOIN a USING (doc_id))
SELECT doc_id, text_length, n_chunks, n_triples, round(c, 9) AS confidence, {LEVEL.format('c')} AS level FROM b""",
)
_docs("fact_score", ", a AS (SELECT doc_id, avg((evidence >= 0.7)::INTEGER) AS f FROM sco GROUP BY doc_id) SELECT doc_id, round(coalesce(f, 0.0), 9)::DOUBLE AS fact_score FROM d LEFT JOIN a USING (doc_id)")
_docs("reasoning_paths", "SELECT doc_id, count(*)::INTEGER AS n, string_agg('Validated: (' || s || ', ' || p || ', ' || o || ')', chr(10) ORDER BY seq) AS path FROM sco GROUP BY doc_id")
_docs("rejected_triples", "SELECT doc_id, seq, s, confidence * 0.1::DOUBLE AS confidence, 'uncertain' AS confidence_level FROM sco WHERE s = o")
_docs("verify_summary", "SELECT doc_id, count(*) FILTER (WHERE confidence >= 0.8) AS n_verified, 0::BIGINT AS n_refuted, count(*) AS n_total, 'Verified: ' || count(*) FILTER (WHERE confidence >= 0.8) || ', Refuted: 0, Total: ' || count(*) AS summary FROM sco GROUP BY doc_id")
_docs(
    "verify_refuted",
    """, x AS (SELECT *, CASE WHEN confidence < 0.8::DOUBLE THEN 'unknown' WHEN s = o THEN 'refuted' ELSE 'verified' END AS status FROM sco),
y AS (SELECT status, CASE status WHEN 'verified' THEN 'verified' WHEN 'refuted' THEN 'uncertain' ELSE confidence_level END AS confidence_level, CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'refuted' THEN confidence * 0.1::DOUBLE ELSE confidence END AS c FROM x)
SELECT status, confidence_level, count(*) AS n, round(avg(c), 9) AS confidence FROM y GROUP BY 1, 2""",
)
_docs(
    "certificates",
    """SELECT doc_id, seq, 'Proof certificate' || chr(10) || 'Triple: (' || s || ', ' || p || ', ' || o || ')' || chr(10) || 'Status: verified' || chr(10) || 'Confidence: 1.0000' || chr(10)
|| 'Proof: Consistent with the rules' || chr(10) || 'Source: ' || chunk || chr(10) || 'Solver: parity' || chr(10) || 'Soundness threshold: 0.99' || chr(10) || 'Extracted by: extractor' AS certificate FROM sco WHERE confidence >= 0.8::DOUBLE""",
)
_kg("formal_triples", "SELECT seq, 'relation' AS type, p AS predicate, s AS subject, o AS object, p || '(' || s || ', ' || o || ')' AS formula FROM kg")
_PROMPT = (
    "Use these terms:\nClasses:\n- Place: somewhere\n- Region: a part of the world\nRelations:\n- in region: \n- located in: \n"
    "List the entities and relations of this text:\n\nAnswer in JSON:\n"
    '{"entities": [{"text": "..", "type": "..", "span": [0, 0]}], "relations": [{"subject": "..", "predicate": "..", "object": ".."}]}'
)
_BEFORE, _AFTER = _PROMPT.split("\nAnswer", 1)
_docs("extraction_prompts", f"SELECT doc_id, chunk_idx, md5('{_BEFORE}' || chunk || chr(10) || 'Answer{_AFTER}') AS prompt_md5 FROM ch")

_REPLAY = r"""
d AS (SELECT doc_id, text, lower(text) AS low, regexp_split_to_array(text, '[^\p{L}]+') AS ws FROM documents),
r AS (SELECT *, ws[2] AS a, ws[3] AS b FROM d WHERE len(ws) >= 3 AND ws[2] <> '' AND ws[3] <> '')"""
_put("parsed_responses", f"""WITH {_REPLAY} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 2 END::INTEGER AS n_entities, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END::INTEGER AS n_relations,
CASE WHEN doc_id % 4 <> 3 THEN 'Works In' END AS predicate FROM r""")
_put(
    "replay_triples",
    f"""WITH {_REPLAY},
u AS (
  SELECT *, '{E_NS}' || regexp_replace(replace(lower('X ' || a), ' ', '_'), '[^a-z0-9_]', '', 'g') AS s, '{E_NS}' || regexp_replace(lower(b), '[^a-z0-9_]', '', 'g') AS o,
    instr(low, lower('X ' || a)) AS sp, instr(low, lower(b)) AS op
  FROM r WHERE doc_id % 4 <> 3),
e AS (
  SELECT doc_id, s, '{P_NS}works_in' AS p, o,
    (CASE WHEN sp > 0 AND op > 0 THEN CASE WHEN abs(sp - op) < 50 THEN 1.0 WHEN abs(sp - op) < 200 THEN 0.8 ELSE 0.6 END ELSE 0.3 END)::DOUBLE AS evidence,
    least(1.0::DOUBLE, 0.8::DOUBLE + least(0.2::DOUBLE, 0.05::DOUBLE * 1)) AS c
  FROM u WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
n AS (SELECT *, least(1.0::DOUBLE, 0.75::DOUBLE * 0.5::DOUBLE + ((c + c) / 2) * 0.3::DOUBLE + evidence * 0.2::DOUBLE) AS neural FROM e)
SELECT doc_id, s, p, o, evidence, neural, least(1.0::DOUBLE, 0.7::DOUBLE * neural + 0.3::DOUBLE * 1.0::DOUBLE) AS confidence FROM n""",
)

_kg("kg_sizes", """SELECT 'kg' AS graph_id, kind, n FROM (
SELECT 'triples' AS kind, count(*) AS n FROM kg UNION ALL SELECT 'relations', count(DISTINCT p) FROM kg UNION ALL SELECT 'entities', count(*) FROM (SELECT s FROM kg UNION SELECT o FROM kg))""")
_kg("kg_by_subject", "SELECT s, p, o FROM kg WHERE s = 'kg:order/7'")
_kg("kg_by_predicate", "SELECT s, p, o FROM kg WHERE p = 'kg:locatedIn'")
_kg("kg_neighbors", "SELECT o AS neighbor FROM kg WHERE s = 'kg:nation/3' UNION SELECT s FROM kg WHERE o = 'kg:nation/3'")
_kg("kg_predicate_counts", "SELECT p, count(*) AS n FROM kg GROUP BY p")
_kg("kg_predicate_examples", "SELECT * FROM (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY seq, s, o))::INTEGER AS rank, s, o FROM kg) WHERE rank <= 5")
_kg("kg_distinct_triples", "SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM kg) GROUP BY p")
_kg(
    "kg_display",
    "SELECT s, p, o, a.label AS s_label, b.label AS o_label FROM kg JOIN e a ON a.uri = s JOIN e b ON b.uri = o",
    "e AS (SELECT 'kg:customer/' || c_custkey AS uri, c_name AS label FROM customer UNION ALL SELECT 'kg:nation/' || n_nationkey, n_name FROM nation)",
)
_put("kg_upsert", "SELECT 'kg' AS graph_id, min(event_id) AS seq, 'kg:user/' || user_id AS uri, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id")
_kg("kg_edges", "SELECT a, b, property FROM edge")
_kg("kg_degree", "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edge UNION ALL SELECT b FROM edge WHERE a <> b) GROUP BY node")
_kg(
    "kg_walks",
    "SELECT start, walk, path FROM w WHERE step = 3",
    """arc AS (SELECT node, next, row_number() OVER (PARTITION BY node ORDER BY md5(next), next) - 1 AS place, count(*) OVER (PARTITION BY node) AS degree FROM (
  SELECT DISTINCT s AS node, o AS next FROM kg UNION SELECT DISTINCT o, s FROM kg)),
w AS (
  SELECT node AS start, walk::INTEGER AS walk, node AS here, node AS path, 0 AS step FROM (SELECT DISTINCT node FROM arc), range(2) g(walk)
  UNION ALL
  SELECT start, walk, next, path || '>' || next, step + 1 FROM w JOIN arc ON node = here
    AND place = ('0x' || left(md5('42|' || start || '|' || walk || '|' || (step + 1)), 8))::BIGINT % degree WHERE step < 3)""",
)
#: A step of the biased walks: the first of the tries whose neighbour is taken. Weights are those of p = 1/2 and q = 2, of the greatest.
_STEP = """,
s{n} AS (
  SELECT start, walk, arg_min(next, try) AS here, any_value(here) AS prev, any_value(path) || '>' || arg_min(next, try) AS path FROM (
    SELECT w.*, a.next, try, CASE WHEN prev IS NULL THEN 1.0 WHEN a.next = prev THEN 1.0 WHEN c.node IS NOT NULL THEN 0.5 ELSE 0.25 END AS weight
    FROM (SELECT s{m}.*, try, ('0x' || left(md5('42|' || start || '|' || walk || '|{n}|' || try || '|place'), 8))::BIGINT AS drawn FROM s{m}, range(80) t(try)) w
    JOIN (SELECT node, degree FROM arc WHERE place = 0) d ON d.node = w.here JOIN arc a ON a.node = w.here AND a.place = w.drawn % d.degree
    LEFT JOIN (SELECT DISTINCT node, next FROM arc) c ON c.node = w.prev AND c.next = a.next)
  WHERE (('0x' || left(md5('42|' || start || '|' || walk || '|{n}|' || try || '|take'), 8))::BIGINT + 0.5) / 4294967296::DOUBLE < weight GROUP BY start, walk)"""
_kg(
    "kg_biased_walks",
    "SELECT start, walk, path FROM s3",
    """arc AS MATERIALIZED (SELECT node, next, row_number() OVER (PARTITION BY node ORDER BY md5(next), next) - 1 AS place, count(*) OVER (PARTITION BY node) AS degree FROM (
  SELECT DISTINCT s AS node, o AS next FROM kg UNION SELECT DISTINCT o, s FROM kg)),
s0 AS (SELECT node AS start, walk::INTEGER AS walk, node AS here, NULL::VARCHAR AS prev, node AS path FROM (SELECT DISTINCT node FROM arc), range(2) g(walk))"""
    + "".join(_STEP.format(n=n, m=n - 1) for n in (1, 2, 3)),
)
_put(
    "text_topk",
    """WITH b AS (SELECT item_id, lower(coalesce(text, '')) AS t FROM benchmark UNION ALL SELECT NULL, 'the thing that was'),
g AS (SELECT row_number() OVER () AS r, item_id, t FROM b),
n AS (SELECT r, item_id, ('0x' || left(md5(substr(t, i::BIGINT, 3)), 8))::BIGINT % 64 AS k FROM (SELECT *, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM g)),
c AS (SELECT r, item_id, k, count(*)::DOUBLE AS n FROM n GROUP BY ALL),
q AS (SELECT k, n FROM c WHERE item_id IS NULL),
l AS (SELECT r, item_id, sqrt(sum(n * n)) AS size FROM c GROUP BY ALL),
s AS (SELECT l.item_id AS doc_id, coalesce(sum(c.n * q.n), 0) / any_value(l.size) / (SELECT sqrt(sum(n * n)) FROM q) AS x FROM l JOIN c USING (r) LEFT JOIN q ON q.k = c.k WHERE l.item_id IS NOT NULL GROUP BY l.r, l.item_id)
SELECT doc_id, round(x, 6) AS similarity FROM s ORDER BY x DESC, doc_id LIMIT 5""",
)
_kg("kg_ntriples", "SELECT '<' || s || '> <' || p || '> <' || o || '> .' AS value FROM kg")
_kg("kg_ntriples_read", "SELECT s, p, o, false AS o_is_literal FROM kg")
_kg("kg_turtle", "SELECT '<' || s || '>' AS s, '<' || s || '> ' || string_agg(po, ' ;' || chr(10) || '    ' ORDER BY po) || ' .' AS block FROM (SELECT s, '<' || p || '> <' || o || '>' AS po FROM kg) GROUP BY s")
_kg("kg_turtle_read", "SELECT s, p, o, false AS o_is_literal FROM kg")
_kg("kg_json_read", "SELECT seq, s, p, o, 'trade' AS graph_id, 'onto:' AS ontology_uri, 7::INTEGER AS tables FROM kg")
_kg("kg_registered", "SELECT 'kg:part/' || p_partkey AS uri FROM part UNION SELECT s FROM kg WHERE p = 'kg:contains' UNION SELECT o FROM kg WHERE p = 'kg:contains' UNION SELECT 'kg:contains'")
_put("literals_round_trip", "SELECT '_:' || source AS s, 'kg:doc/' || doc_id AS p, md5(text) AS o_md5, lang AS o_lang, NULL::VARCHAR AS o_type FROM documents")
_put("ontology_individuals", """SELECT uri, type, count(*) OVER () AS individuals FROM (
SELECT 'kg:nation/' || n_nationkey AS uri, 'onto:Nation' AS type FROM nation UNION ALL SELECT 'kg:region/' || r_regionkey, 'onto:Region' FROM region)""")
_put("ontology_consistency", "SELECT * FROM (VALUES ('regions', true), ('disjointness', false)) t(rule, consistent)")
_docs("extraction_graph", "SELECT 'kg_' || doc_id AS graph_id, seq, s, p, o, confidence FROM sco")
_docs("provenance_records", "SELECT doc_id, length(text)::BIGINT AS text_length, len(cs)::INTEGER AS n_chunks, 'extractor' AS extraction_method, 'onto:' AS ontology FROM c0")
_kg("kg_json", "SELECT 'graph' AS kind, 1::BIGINT AS n UNION ALL SELECT 'triple', count(*) FROM kg UNION ALL SELECT 'relation', count(DISTINCT p) FROM kg UNION ALL SELECT 'entity', count(*) FROM (SELECT s FROM kg UNION SELECT o FROM kg)")
_kg("local_names", "SELECT regexp_extract(s, '[^/#]*$') AS s_name, regexp_extract(o, '[^/#]*$') AS o_name FROM kg")

_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 7)"
_put("cosine_topk", f"WITH {_V}, s AS (SELECT vec_id AS uri, list_cosine_similarity(e, q) AS x FROM v, q WHERE vec_id <> 7) SELECT uri, round(x, 6) AS similarity FROM s ORDER BY x DESC, uri LIMIT 10")
_put("euclid_topk", f"WITH {_V}, s AS (SELECT vec_id AS uri, -list_distance(e, q) AS x FROM v, q WHERE vec_id <> 7) SELECT uri, round(x, 6) AS similarity FROM s ORDER BY x DESC, uri LIMIT 10")
_put("pair_similarity", f"WITH {_V} SELECT a.vec_id AS a, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(-list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
_put(
    "translation_scores",
    f"""WITH {_V} SELECT h.vec_id AS k, round(-list_distance(list_transform(list_zip(h.e, r.e), lambda x: x[1] + x[2]), t.e), 6) AS transe,
round(list_inner_product(list_transform(list_zip(h.e, r.e), lambda x: x[1] * x[2]), t.e), 6) AS distmult
FROM v h JOIN v r ON r.vec_id = h.vec_id + 1 JOIN v t ON t.vec_id = h.vec_id + 2""",
)

_put(
    "type_mapping",
    f"""WITH {CLASSES}, l AS (SELECT DISTINCT event_type FROM events UNION ALL VALUES (''), ('ion'), ('supplier'), ('e'))
SELECT event_type, arg_min(uri, ord) AS class_uri FROM l LEFT JOIN cl ON contains(lower(label), lower(event_type)) GROUP BY event_type""",
)
#: The ontology that queries.table_ontology writes: classes and properties in the order of their names, and its axioms.
KINDS = """
k AS (SELECT 'Event' AS top, event_type AS x, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'Customer', c_mktsegment, count(*) FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'Part', p_type, count(*) FROM part WHERE p_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'Brand', p_brand, count(*) FROM part WHERE p_brand IS NOT NULL GROUP BY 2),
cl AS (SELECT *, row_number() OVER (ORDER BY uri || '"') - 1 AS ord FROM (
  SELECT 'onto:' || lower(top) || '/' || x AS uri, x AS label, 'onto:' || top AS parent FROM k UNION ALL SELECT 'onto:' || x, 'onto:' || x, NULL FROM (VALUES ('Brand'), ('Customer'), ('Event'), ('Part')) t(x))),
op AS (SELECT 'kg:' || x AS uri, x || ' made' AS label, 'onto:User' AS domain, 'onto:event/' || x AS range, row_number() OVER (ORDER BY x || '"') - 1 AS ord FROM k WHERE top = 'Event'),
dp AS (SELECT 'kg:price/' || x AS uri, 'onto:part/' || x AS domain FROM k WHERE top = 'Part'),
ax AS (
  SELECT 'SubClassOf' AS kind, uri AS a, parent AS b FROM cl WHERE parent IS NOT NULL UNION ALL SELECT 'DisjointClasses', 'onto:part/' || x, 'onto:Event' FROM k WHERE top = 'Part'
  UNION ALL SELECT 'EquivalentClasses', 'onto:brand/' || x, 'onto:maker/' || x FROM k WHERE top = 'Brand' UNION ALL SELECT 'ObjectPropertyDomain', uri, domain FROM op
  UNION ALL SELECT 'ObjectPropertyDomain', uri, domain FROM dp UNION ALL SELECT 'ObjectPropertyRange', uri, range FROM op UNION ALL SELECT 'FunctionalDataProperty', uri, NULL FROM dp)"""


def _kinds(name: str, select: str) -> None:
    _put(name, f"WITH {KINDS} {select}")


_kinds(
    "relation_mapping",
    f"""SELECT l.label, coalesce(arg_min(uri, ord), '{P_NS}' || replace(lower(l.label), ' ', '_')) AS uri
FROM (SELECT unnest([x, upper(x), x || ' Twice']) AS label FROM k WHERE top = 'Event') l LEFT JOIN op ON contains(op.label, lower(l.label)) GROUP BY l.label""",
)
_kinds("ontology_statistics", """SELECT 'classes' AS kind, count(*) AS n FROM cl UNION ALL SELECT 'object_properties', count(*) FROM op UNION ALL SELECT 'data_properties', count(*) FROM dp
UNION ALL SELECT 'individuals', 0 UNION ALL SELECT 'axioms', count(*) FROM ax""")
_kinds("ontology_hierarchy", "SELECT parent, string_agg(uri, ',' ORDER BY uri) AS children FROM cl WHERE parent IS NOT NULL GROUP BY parent")
_kinds(
    "ontology_triples",
    """SELECT uri AS s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS p, parent AS o FROM cl WHERE parent IS NOT NULL
UNION ALL SELECT a, 'http://www.w3.org/2000/01/rdf-schema#domain', b FROM ax WHERE kind = 'ObjectPropertyDomain' UNION ALL SELECT uri, 'http://www.w3.org/2000/01/rdf-schema#range', range FROM op""",
)
_kinds(
    "ontology_axioms",
    """, l AS (SELECT kind, regexp_extract(a, '[^/#]*$') AS a, regexp_extract(b, '[^/#]*$') AS b FROM ax)
SELECT 'SubClassOf' AS axiom_type, 'every ' || a || ' is a ' || b AS verbalization FROM (SELECT a, b FROM l WHERE kind IN ('SubClassOf', 'EquivalentClasses') UNION ALL SELECT b, a FROM l WHERE kind = 'EquivalentClasses')
UNION ALL SELECT kind, 'nothing is both a ' || a || ' and a ' || b FROM l WHERE kind = 'DisjointClasses' UNION ALL SELECT kind, 'whatever has ' || a || ' is a ' || b FROM l WHERE kind = 'ObjectPropertyDomain'
UNION ALL SELECT kind, 'whatever is the value of ' || a || ' is a ' || b FROM l WHERE kind = 'ObjectPropertyRange' UNION ALL SELECT kind, a || ' has at most one value' FROM l WHERE kind = 'FunctionalDataProperty'""",
)
_kinds("ontology_prompt_terms", "SELECT 'class' AS kind, ord, label FROM cl WHERE ord < 20 UNION ALL SELECT 'relation', ord, label FROM op WHERE ord < 20")
_put("entity_types", f"WITH {TYPES} SELECT uri, type FROM ty")
_kg("inferred_types", "SELECT uri, string_agg(type, ',' ORDER BY type) AS types FROM (SELECT s AS uri FROM kg UNION SELECT o FROM kg) LEFT JOIN ty USING (uri) GROUP BY uri", TYPES)
_docs("provenance_summary", "SELECT 'extractor' AS method, sum(length(text))::BIGINT AS text_length, sum(len(cs))::BIGINT AS n_chunks, (SELECT count(*) FROM sco) AS n_triples, count(*) AS n_docs FROM c0")
_kg(
    "domain_range_violations",
    """SELECT s, p, o, 'domain' AS violation FROM t WHERE domain IS NOT NULL AND s IN (SELECT uri FROM ty) AND NOT EXISTS (SELECT 1 FROM ty WHERE uri = s AND type = domain)
UNION ALL SELECT s, p, o, 'range' FROM t WHERE range IS NOT NULL AND o IN (SELECT uri FROM ty) AND NOT EXISTS (SELECT 1 FROM ty WHERE uri = o AND type = range)""",
    TYPES + ", pr(pp, domain, range) AS (VALUES ('kg:inRegion', 'onto:Nation', 'onto:Region'), ('kg:locatedIn', 'onto:Customer', 'onto:Nation')), t AS (SELECT kg.*, domain, range FROM kg JOIN pr ON p = pp)",
)
_kg(
    "policy_violations",
    """SELECT DISTINCT s, p, o FROM kg WHERE
(p = 'kg:inRegion' AND s IN (SELECT uri FROM ty) AND s NOT IN (SELECT uri FROM ty WHERE type = 'onto:Nation'))
OR (p = 'kg:placedBy' AND o IN (SELECT uri FROM ty) AND o NOT IN (SELECT uri FROM ty WHERE type = 'onto:Supplier'))
OR (p = 'kg:locatedIn' AND s IN (SELECT s FROM kg WHERE p = 'kg:locatedIn' GROUP BY s HAVING count(DISTINCT o) > 1))
OR s IN (SELECT * FROM bad) OR o IN (SELECT * FROM bad)""",
    TYPES + ", bad AS (SELECT DISTINCT x.uri FROM ty x JOIN ty y ON x.uri = y.uri AND x.type = 'onto:Place' AND y.type = 'onto:Agent')",
)
_kg("functional_violations", "SELECT s, p, count(DISTINCT o) AS n_values FROM kg WHERE p IN ('kg:suppliedBy', 'kg:placedBy') GROUP BY s, p HAVING count(DISTINCT o) > 1")
_put("disjoint_violations", f"WITH {TYPES} SELECT x.uri, 'onto:Place' AS a, 'onto:Agent' AS b FROM ty x JOIN ty y ON x.uri = y.uri AND x.type = 'onto:Place' AND y.type = 'onto:Agent'")
_kg("transitive_closure", "SELECT DISTINCT s, 'kg:within' AS p, o FROM tc", "tc AS (SELECT s, o FROM sk UNION SELECT tc.s, sk.o FROM tc JOIN sk ON tc.o = sk.s)")
_kg("symmetric_closure", "SELECT s, p, o FROM kg WHERE p = 'kg:inRegion' UNION SELECT o, p, s FROM kg WHERE p = 'kg:inRegion'")
_kg(
    "inferred_triples",
    "SELECT s, p, o FROM n ORDER BY s, p, o LIMIT 100",
    """tc AS (SELECT s, o FROM sk UNION SELECT tc.s, sk.o FROM tc JOIN sk ON tc.o = sk.s),
n AS (SELECT s, 'kg:within' AS p, o FROM tc WHERE (s, o) NOT IN (SELECT (s, o) FROM sk) UNION SELECT o, 'kg:holds', s FROM sk)""",
)

_kg("bgp_two_hops", "SELECT a.s AS c, b.o AS r FROM kg a JOIN kg b ON a.o = b.s WHERE a.p = 'kg:locatedIn' AND b.p = 'kg:inRegion'")
_put(
    "bgp_star",
    """SELECT 'kg:order/' || o_orderkey AS o, 'kg:customer/' || o_custkey AS c, 'kg:part/' || l_partkey AS p
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5""",
)
_kg("bgp_optional", "SELECT x.s AS c, y.s AS o FROM kg x LEFT JOIN (SELECT * FROM kg WHERE p = 'kg:placedBy') y ON y.o = x.s WHERE x.p = 'kg:locatedIn' AND x.o = 'kg:nation/5'")
_kg("bgp_union", "SELECT s AS x FROM kg WHERE p = 'kg:locatedIn' AND o = 'kg:nation/1' UNION SELECT s FROM kg WHERE p = 'kg:inRegion' AND o = 'kg:region/2'")
_kg(
    "bgp_unbound",
    "SELECT n, v FROM f WHERE v IS NOT NULL UNION ALL SELECT f.n, c.s FROM f LEFT JOIN (SELECT * FROM kg WHERE p = 'kg:locatedIn' AND contains(s, 'customer')) c ON c.o = f.n WHERE v IS NULL",
    "f AS (SELECT a.s AS n, b.s AS v FROM kg a LEFT JOIN (SELECT * FROM kg WHERE p = 'kg:locatedIn' AND regexp_matches(s, 'supplier/[1-9]$')) b ON b.o = a.s WHERE a.p = 'kg:inRegion')",
)
_kg("bgp_group", "SELECT b.o AS r, count(a.s) AS n, count(DISTINCT a.o) AS nations FROM kg a JOIN kg b ON a.o = b.s WHERE a.p = 'kg:locatedIn' AND b.p = 'kg:inRegion' GROUP BY b.o")
_kg("bgp_filter", "SELECT s, o FROM kg WHERE p = 'kg:locatedIn' AND contains(s, 'supplier') AND (o = 'kg:nation/1' OR regexp_matches(o, '/2[0-9]$'))")
_kg("bgp_order_limit", "SELECT s, o FROM kg WHERE p = 'kg:placedBy' ORDER BY s DESC, o LIMIT 20 OFFSET 5")
_put(
    "hybrid_retrieval",
    """WITH v AS (SELECT 'kg:user/' || vec_id AS uri, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE uri = 'kg:user/1'),
s AS (SELECT uri AS u, list_cosine_similarity(e, q) AS x FROM v, q WHERE uri IN (SELECT 'kg:user/' || user_id FROM events))
SELECT u, round(x, 6) AS similarity FROM s ORDER BY x DESC, u LIMIT 10""",
)
_put("event_stream_triples", "SELECT event_id, 'kg:user/' || user_id AS s, 'kg:performed' AS p, 'kg:event/' || event_type AS o FROM events")
_put("event_hour_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, 'kg:event/' || event_type AS uri, count(*) AS n FROM events GROUP BY 1, 2")
