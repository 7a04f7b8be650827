"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT r, i, len(ws) AS n,
    CASE WHEN i + 2 <= len(ws) THEN array_to_string(ws[i:i + 2], ' ') END AS g3,
    CASE WHEN i + 9 <= len(ws) THEN md5(array_to_string(ws[i:i + 9], ' ')) END AS g10,
    CASE WHEN i + 200 <= len(ws) THEN md5(array_to_string(ws[i:i + 200], ' ')) END AS g201
  FROM p),
c AS (
  SELECT r, i,
    CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 THEN i END AS h3,
    CASE WHEN g10 IS NOT NULL AND count(*) OVER (PARTITION BY r, g10) > 1 THEN i END AS h10,
    CASE WHEN g201 IS NOT NULL AND count(*) OVER (PARTITION BY r, g201) > 1 THEN i END AS h201
  FROM g),
k AS (
  SELECT r, max(h3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    max(h10) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, h201
  FROM c),
a AS (SELECT r, count(c3) AS n_repeat_words, count(c10) AS n_covered, count(h201) > 0 AS too_long FROM k GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY r),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_covered, 0)::BIGINT AS n_covered, coalesce(too_long, false) AS too_long
  FROM d JOIN w USING (r) LEFT JOIN a USING (r) LEFT JOIN dup USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1000 * n_covered <= 300 * n_words AND NOT too_long AS kept
FROM b
"""

OP2 = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS h FROM p),
c AS (SELECT h FROM g WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (
  SELECT r, i, word, max(CASE WHEN c.h IS NOT NULL THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS hit
  FROM g LEFT JOIN c ON g.h = c.h),
a AS (SELECT r, count(hit) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE hit IS NULL) AS kept FROM m GROUP BY r)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h, row_number() OVER () AS r
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::DOUBLE AS cap,
    ([3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3])::DOUBLE AS w
  FROM d GROUP BY source),
t AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total, sum(w) AS weight FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM s),
l AS (SELECT min_by((total - caps) / (weight - ws), k) AS level FROM o, t WHERE NOT cap < w * ((total - caps) / (weight - ws))),
g AS (SELECT source, source_size, CASE WHEN cap < w * level THEN cap ELSE w * level END AS target FROM s, l),
n AS (SELECT greatest(4096, ceil(total / 268435456)::BIGINT) AS bw FROM t),
q AS (
  SELECT *, round(target)::BIGINT // source_size AS rounds, round(target)::BIGINT % source_size AS rest, (source_size + bw - 1) // bw AS blocks
  FROM g, n WHERE source_size > 0),
m AS (
  SELECT *, CASE WHEN blocks < 2 THEN 1 ELSE list_filter(range(a, a + 1000), lambda x: gcd(x, blocks) = 1)[1] END AS step, CASE WHEN blocks < 2 THEN 0 ELSE f % blocks END AS shift
  FROM (
    SELECT *, 1 + ('0x' || substr(md5('mix-1|block-step|' || coalesce(source, '')), 1, 7))::BIGINT % blocks AS a,
      ('0x' || substr(md5('mix-1|block-shift|' || coalesce(source, '')), 1, 7))::BIGINT AS f
    FROM q)),
p AS (
  SELECT r, d.source, size,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM d),
b AS (
  SELECT r, size, off, m.*, unnest(range(off // bw, (off + size - 1) // bw + 1)) AS b
  FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source WHERE size > 0),
k AS (SELECT *, (b * step + shift) % blocks AS rank, ((blocks - 1) * step + shift) % blocks AS place, least(bw, source_size - b * bw) AS full_size FROM b),
e AS (
  SELECT *, greatest(least(rest - (rank * bw - CASE WHEN place < rank THEN bw - (source_size - (blocks - 1) * bw) ELSE 0 END), full_size), 0) AS part FROM k),
w AS (
  SELECT r, sum(rounds * (least(off + size, (b + 1) * bw) - greatest(off, b * bw))
    + greatest(least(b * bw + part, off + size, (b + 1) * bw) - greatest(off, b * bw), 0))::BIGINT AS taken
  FROM e GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN w USING (r)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS c FROM c),
s AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.k = x.c AND l.phrase = array_to_string(x.ws[1:x.c], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - x.c AND r.phrase = array_to_string(x.ws[x.c + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
held AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.k > b.k AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN held USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
gr AS (SELECT DISTINCT lang, source FROM d),
nv AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
ng AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(ng.n, 0) + 5 * nv.v))::BIGINT AS p
  FROM gr JOIN v USING (lang) JOIN nv USING (lang) LEFT JOIN ng USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(c.n) + 5) // (any_value(nl.n) + 5 * any_value(nv.v)))::BIGINT AS q FROM c JOIN nl USING (lang) JOIN nv USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT * FROM k WHERE part = 'pair' OR rank <= 50
"""


def _op13() -> str:
    """The templates as a table; votes, majorities and verification by joins."""
    from .licenses import BASE, LOOKUPS, TEMPLATES, WORD, _keys, words_of

    rows = [(t, label, i, w, i in set(_keys(words_of(text), keys))) for t, (label, text, keys) in enumerate(TEMPLATES) for i, w in enumerate(words_of(text))]
    t = ", ".join(f"({n}, '{label}', {i}, '{w}', {str(key).lower()})" for n, label, i, w, key in rows)
    v = ", ".join(f"('{w}')" for w in sorted({r[3] for r in rows} | {w for phrase, _ in BASE for w in phrase.split()}))
    b = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in BASE)
    return rf"""
WITH t(tid, label, j, w, key) AS (VALUES {t}), v(w) AS (VALUES {v}), b(phrase, label, k) AS (VALUES {b}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
h AS (SELECT * FROM (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d) SEMI JOIN v USING (w)),
base AS (SELECT h.r, h.i, b.label FROM h JOIN b ON h.w = split_part(b.phrase, ' ', 1) JOIN d ON d.r = h.r WHERE array_to_string(d.ws[h.i + 1:h.i + b.k], ' ') = b.phrase),
pw AS (SELECT DISTINCT r, w FROM h),
df AS (SELECT w, count(*) AS n FROM pw GROUP BY w),
need AS (SELECT tid, count(DISTINCT w) AS n FROM t WHERE key GROUP BY tid),
near AS (SELECT r, tid FROM pw JOIN (SELECT DISTINCT tid, w FROM t WHERE key) USING (w) JOIN need USING (tid) GROUP BY r, tid, need.n HAVING count(*) = need.n),
look AS (
  SELECT r, tid, w FROM near JOIN (SELECT DISTINCT tid, w FROM t) USING (tid) JOIN pw USING (r, w) JOIN df USING (w)
  QUALIFY row_number() OVER (PARTITION BY r, tid ORDER BY df.n, w) <= {LOOKUPS}),
size AS (SELECT r, tid, count(*) AS n FROM look GROUP BY r, tid),
place AS (
  SELECT r, tid, h.i - t.j AS o FROM look JOIN h USING (r, w) JOIN t USING (tid, w) JOIN size USING (r, tid)
  GROUP BY r, tid, o, size.n HAVING 2 * count(DISTINCT w) > size.n),
hit AS (
  SELECT p.r, t.label, count(h.w) / count(*) AS share, count(h.w) FILTER (t.key) = count(*) FILTER (t.key) AS whole
  FROM place p JOIN t USING (tid) LEFT JOIN h ON h.r = p.r AND h.i = p.o + t.j AND h.w = t.w GROUP BY p.r, p.tid, p.o, t.label),
f AS (SELECT r, label, share FROM hit WHERE whole),
lb AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM f) GROUP BY r),
bs AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
sc AS (SELECT r, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN lb USING (r) LEFT JOIN sc USING (r)
"""


ORACLES = {
    "op1_quality_rules": OP1,
    "op2_top_k_search": OP2,
    "op3_substring_dedup": OP3,
    "op6_mix_sources": OP6,
    "op11_phrase_collocations": OP11,
    "op12_source_divergence": OP12,
    "op13_license_scan": _op13(),
}
