"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

LINES = r"""
WITH numbered AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered
), repeated AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keep AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_COPIES = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size,
  row_number() OVER (PARTITION BY n.t ORDER BY n.doc_id DESC NULLS LAST) = 1 AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON g.t = n.t
"""

DIVERGENCES = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
    1 + (1000000000 * (coalesce(c.c, 0)::HUGEINT + 5)) // (coalesce(total.n, 0) + 5 * v.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.c)::HUGEINT + 5)) // (any_value(lt.n) + 5 * any_value(v.v)) AS q
  FROM c JOIN v ON v.lang = c.lang JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY lang) lt ON lt.lang = c.lang
  GROUP BY c.lang, c.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR r <= 50
"""


def centroid_rounds(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds written out: an assignment and new centroids for each."""
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v,
    sha256(concat('3:', coalesce(CAST(vec_id AS VARCHAR), ''))) AS code
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
m0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i
  FROM (SELECT v, row_number() OVER (ORDER BY code, v) - 1 AS c FROM kept QUALIFY row_number() OVER (ORDER BY code, v) <= {k})
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""
a{n} AS MATERIALIZED (
  SELECT r, min_by(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT p.r, m.c, CAST(sum((p.x - m.x) * (p.x - m.x)) AS BIGINT) AS d FROM parts p JOIN m{n} m ON m.i = p.i GROUP BY p.r, m.c)
  GROUP BY r
)"""
        )
        if n < rounds:
            steps.append(
                f"""
s{n} AS MATERIALIZED (SELECT a.c, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM parts p JOIN a{n} a ON a.r = p.r GROUP BY a.c, p.i),
m{n + 1} AS MATERIALIZED (
  SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
  FROM m{n} m LEFT JOIN s{n} s ON s.c = m.c AND s.i = m.i
)"""
            )
    return f"""
WITH {",".join(steps)},
sizes AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY c),
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)
SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, sizes.s AS cluster_inertia,
  (SELECT CAST(sum(s) AS BIGINT) FROM sizes) AS inertia, digests.h AS centroid_sha256
FROM a{rounds} a JOIN kept ON kept.r = a.r JOIN sizes ON sizes.c = a.c JOIN digests ON digests.c = a.c
"""
