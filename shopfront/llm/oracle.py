"""Plain SQL with the same rows, for the queries that SQL can express over whole tables."""

from __future__ import annotations

#: All pairs of documents that share a shingle, then everything reachable.
NEAR_DUPLICATES = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM texts),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.seen = l.a),
smallest AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN smallest m ON s.doc_id = m.doc_id
"""

#: Products of floats are exact as doubles, and as whole numbers of 2^-90 so are their sums.
NEAREST = """
WITH fit AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: CAST(z[1] * z[2] * pow(2, 90) AS HUGEINT))) AS VARCHAR) AS DOUBLE) / pow(2, 90) AS score
  FROM fit q JOIN fit v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Addresses, the redirects worked out from them, everything reachable over links, and the rules.
URL_FILTER = r"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
pages_ AS (
  SELECT page_id, url, regexp_extract(html, '(?is)<title>([^<]+)', 1) AS title, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
split AS (
  SELECT page_id, url, title, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages_),
site AS (
  SELECT url, title, regexp_replace(host, '^(www|m|blog)[.]', '') AS host, regexp_replace(path, '([.]html|/)$', '') AS path,
    regexp_replace(query, '(^|&)(ref|utm_[a-z]+)=[^&]*', '', 'g') AS query
  FROM split WHERE url LIKE '%://%'),
plain AS (
  SELECT url, 'https://' || host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS target, path, title FROM site),
redirects AS (
  SELECT url AS a, target AS b FROM plain
  UNION SELECT target, min(target) OVER (PARTITION BY path, title) FROM plain WHERE path <> '' AND title <> ''),
links AS (SELECT a, b FROM redirects WHERE a <> b UNION SELECT b, a FROM redirects WHERE a <> b),
reach AS (SELECT DISTINCT a, a AS seen FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.seen = l.a),
urls AS (SELECT url FROM split UNION SELECT seen FROM reach),
parts AS (
  SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls WHERE url IS NOT NULL),
ruled AS (
  SELECT p.url, r.host || r.path AS rule, r.verdict FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY length(r.host || r.path) DESC, r.verdict) = 1),
passed AS (SELECT r.a AS url, min(u.verdict) AS verdict FROM reach r JOIN ruled u ON r.seen = u.url GROUP BY r.a)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, u.rule, coalesce(u.verdict, p.verdict, 'allow') AS verdict
FROM split s LEFT JOIN ruled u ON s.url = u.url LEFT JOIN passed p ON s.url = p.url
"""


def _clusters(rounds: int = 3) -> str:
    """Every round as two tables: who is nearest to whom, and the moved centroids."""

    def nearest(at: int) -> str:
        return f"""near{at} AS (
  SELECT row, vec_id, x, number, distance FROM (
    SELECT k.row, k.vec_id, k.x, c.number,
      list_sum(list_transform(list_zip(k.x, c.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS distance,
      row_number() OVER (PARTITION BY k.row ORDER BY distance, c.number) AS place
    FROM kept k CROSS JOIN centroids{at} c) WHERE place = 1)"""

    def moved(at: int) -> str:
        return f"""places{at} AS (
  SELECT number, place, sum(part) AS total, count(*) AS members FROM (
    SELECT number, unnest(x) AS part, unnest(range(1, 65)) AS place FROM near{at - 1}) GROUP BY number, place),
centroids{at} AS (
  SELECT c.number, coalesce(m.x, c.x) AS x FROM centroids{at - 1} c LEFT JOIN (
    SELECT number, list(CAST((total - ((total % members) + members) % members) // members AS BIGINT) ORDER BY place) AS x
    FROM places{at} GROUP BY number) m USING (number))"""

    turns = ",\n".join(f"{nearest(at)},\n{moved(at + 1)}" for at in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 64) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS number, x FROM kept
  WHERE vec_id IS NOT NULL QUALIFY number < 16),
{turns},
{nearest(rounds)},
totals AS (SELECT number, sum(distance) AS own FROM near{rounds} GROUP BY number)
SELECT n.vec_id, CAST(n.number AS INTEGER) AS "cluster", CAST(n.distance AS BIGINT) AS distance, CAST(t.own AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(own) FROM totals) AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{rounds} n JOIN totals t ON n.number = t.number JOIN centroids{rounds} c ON c.number = n.number
"""


ORACLE_SQL = {"op6_near_duplicates": NEAR_DUPLICATES, "op10_nearest": NEAREST, "op12_url_filter": URL_FILTER, "op13_clusters": _clusters()}
