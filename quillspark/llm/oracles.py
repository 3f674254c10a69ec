"""SQL for the operators that SQL can express, as DuckDB runs it."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Without seeds: 11 of 13 equal places hold four in a row (two substitutions leave three runs), so all
#: diagonals with four equal words in a row are compared place by place.  Short items: one word or none of their
#: places may differ, so one of their halves is whole; tiny ones equal the document.
OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format('lower(text)')} AS ws FROM benchmark),
dg AS (SELECT doc_id, p, ws[p:p + 3] AS g FROM d, unnest(range(1, len(ws) - 2)) t(p)),
bg AS (SELECT item_id, q, ws[q:q + 3] AS g FROM b, unnest(range(1, len(ws) - 2)) t(q) WHERE len(ws) >= 13),
dia AS (SELECT DISTINCT doc_id, item_id, p - q AS k FROM dg JOIN bg ON dg.g = bg.g),
eq AS (SELECT doc_id, item_id, list_transform(range(1, len(b.ws) + 1), lambda i: CASE WHEN i + k BETWEEN 1 AND len(d.ws) THEN CAST(d.ws[i + k] = b.ws[i] AS INTEGER) ELSE -100 END) AS e
  FROM dia JOIN d USING (doc_id) JOIN b USING (item_id)),
al AS (SELECT doc_id, item_id, list_max(list_transform(range(1, len(e) - 11), lambda i: list_sum(e[i:i + 12]))) AS matched, 13 AS width FROM eq),
short AS (SELECT doc_id, item_id, list_sum(list_transform(range(1, len(b.ws) + 1), lambda i: CAST(d.ws[k + i] = b.ws[i] AS INTEGER))) AS matched, len(b.ws) AS width
  FROM b, d, unnest(range(0, len(d.ws) - len(b.ws) + 1)) t(k) WHERE len(b.ws) BETWEEN 5 AND 12),
found AS (SELECT * FROM al WHERE matched >= 11 UNION ALL SELECT * FROM short WHERE matched >= width - (2 * width) // 13
  UNION ALL SELECT doc_id, item_id, len(b.ws), len(b.ws) FROM b, d WHERE len(b.ws) BETWEEN 1 AND 4 AND b.ws = d.ws)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(width) AS INTEGER) AS width FROM found GROUP BY 1, 2"""

OP8 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) t(i)),
f AS (SELECT win, min(doc_id) AS least FROM g GROUP BY 1),
r AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.win = f.win WHERE f.least < g.doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, range(0, 13) t(k)),
a AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS kept, count(*) AS n FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p WHERE c.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY 1"""


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM benchmark),
z AS (SELECT count(*) AS N, sum(len(ts)) AS L FROM d WHERE len(ts) > 0),
it AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(ts) AS t FROM i) GROUP BY 1, 2),
dt AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) SEMI JOIN it USING (t) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, z GROUP BY 1),
m AS (SELECT r, doc_id, 25 + (75 * len(ts) * N) // L AS m FROM d, z WHERE len(ts) > 0),
s AS (SELECT q, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM it JOIN dt USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY 1, 2),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k JOIN i USING (q) WHERE rank <= 10"""

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
#: The screens as expressions over host and path.
OP12 = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, {_LOWER.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN {_FITS.format('www.example.com', '/en/')} THEN 'www.example.com/en/' WHEN {_FITS.format('example.com', '/en/')} THEN 'example.com/en/'
  WHEN {_FITS.format('net', '/es/')} THEN 'net/es/' WHEN {_FITS.format('net', '/fr/')} THEN 'net/fr/' WHEN {_FITS.format('com', '/')} THEN 'com/' END AS rule FROM p),
s AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL WHEN host || path = '' THEN 'no address' WHEN regexp_matches(path, '(?s)^/.*\\.(exe|zip|iso|mp[^/])$') THEN 'binaries'
  WHEN regexp_matches(host, '(?s)^(.*\\.)?ads(-.*)?\\.') THEN 'adverts' WHEN regexp_matches(host, '(?s)-bets\\.|casino') THEN 'betting'
  WHEN regexp_matches(path, '(?s)/login[^/]*$|/(cart|checkout)/') THEN 'forms' END AS screen FROM r)
SELECT page_id, host, path, rule, screen, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') OR screen IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM s"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """One table of centroids and one of assignments for each round."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    near = "SELECT r, arg_min(struct_pack(c := j, d := dist), struct_pack(d := dist, c := j)) AS a FROM (SELECT v.r, c.j, CAST({} AS BIGINT) AS dist FROM v, c{} c) GROUP BY 1"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM (SELECT x, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(dist, n)})")
        if n < rounds:
            mean = "SELECT a.c AS j, i, CAST(floor(sum(v.x[i]) / count(*)) AS BIGINT) AS y FROM a{0} JOIN v USING (r), unnest(range(1, 65)) t(i) GROUP BY 1, 2"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT j, list(y ORDER BY i) AS x FROM ({mean.format(n)}) GROUP BY 1) m USING (j))")
    last = f"SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.j = a.c"
    return "WITH " + ",\n".join(parts) + "\n" + last


OP13 = _op13()
