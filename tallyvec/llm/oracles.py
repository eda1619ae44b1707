"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS7 = "coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS7} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS7} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
occ AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM occ JOIN win USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def _op6_sums(prefix: str, by: str, units: str) -> str:
    n, good = "nullif(CAST(sum(n) AS DOUBLE), 0)", "CAST(sum(good) AS DOUBLE)"
    return f"""SELECT {by} sum(n) AS {prefix}_n, sum(good) AS {prefix}_good,
       CASE WHEN m < 2 OR v <= 1e-6 OR v IS NULL THEN 1000.0 ELSE greatest(1.0, least(1000.0, p * (1 - p) / nullif(v, 0) - 1)) END AS {prefix}_k
FROM (SELECT {by} *, b - p * (1 - p) * m / t AS v FROM (
      SELECT {by} sum(n) AS n, sum(good) AS good, {good} / {n} AS p, sum(CASE WHEN n > 0 THEN CAST(good AS DOUBLE) * good / n END) / {n} - ({good} / {n}) * ({good} / {n}) AS b,
             sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS m, {n} AS t
      FROM {units} {"GROUP BY " + by.rstrip(", ") if by else ""}))"""


OP6 = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
named AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '(:[0-9]*)?\z|\.(:[0-9]*)?\z', '') AS name FROM r),
labelled AS (SELECT *, CASE WHEN regexp_matches(name, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])\z') THEN 0
        WHEN array_to_string(string_split(name, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.za', 'co.in', 'co.jp', 'co.kr', 'com.br', 'com.cn', 'com.mx', 'com.tr') THEN 2 ELSE 1 END AS m,
        string_split(name, '.') AS l FROM named),
h AS (SELECT host, count(quality) AS n, coalesce(sum(quality), 0) AS good, any_value(CASE m WHEN 0 THEN name WHEN 1 THEN array_to_string(l[-2:], '.') ELSE array_to_string(l[-3:], '.') END) AS domain,
        any_value(CASE m WHEN 0 THEN name WHEN 1 THEN l[-1] ELSE array_to_string(l[-2:], '.') END) AS suffix
      FROM labelled LEFT JOIN labels ON page_id = doc_id GROUP BY host),
d AS (""" + _op6_sums("d", "domain, suffix, ", "h").replace("sum(n) AS d_n, sum(good) AS d_good", "n AS d_n, good AS d_good") + r"""),
s AS (""" + _op6_sums("s", "suffix, ", "(SELECT suffix, d_n AS n, d_good AS good FROM d)").replace("sum(n) AS s_n, sum(good) AS s_good", "n AS s_n, good AS s_good") + r"""),
t AS (""" + _op6_sums("t", "", "(SELECT s_n AS n, s_good AS good FROM s)").replace("sum(n) AS t_n, sum(good) AS t_good", "n AS t_n, good AS t_good") + r"""),
sp AS (SELECT suffix, s_k, (s_good + t_k * (coalesce(t_good, 0) + 1) / (coalesce(t_n, 0) + 1.25)) / (s_n + t_k) AS s_p FROM s, t),
dp AS (SELECT domain, d_k, (d_good + s_k * s_p) / (d_n + s_k) AS d_p FROM d JOIN sp USING (suffix)),
ab AS (SELECT host, good + d_k * d_p AS a, n - good + d_k * (1 - d_p) AS b FROM h JOIN dp USING (domain)),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
j AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM j JOIN bound USING (host)
"""


OP8 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM d),
n AS (SELECT r, doc_id, len(g) AS n FROM s),
c AS (SELECT min(r) AS c, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
m AS (SELECT r, c FROM s JOIN c ON list_sort(s.g) = c.g),
x AS (SELECT c, len(g) AS n, unnest(g) AS t FROM c),
p AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
low AS (SELECT c, min(doc_id) AS first FROM m JOIN d USING (r) GROUP BY c),
comp AS (SELECT reach.a AS c, min(first) AS component_id FROM reach JOIN low ON reach.b = low.c GROUP BY reach.a)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id
FROM n LEFT JOIN m USING (r) LEFT JOIN comp USING (c)
"""
