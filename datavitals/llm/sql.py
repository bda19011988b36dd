"""Reference SQL (DuckDB) for the operators that SQL expresses."""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM docs GROUP BY source),
leveled AS (
  SELECT *, 3 * source_size AS lim,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0))::DOUBLE AS lv
  FROM sources WINDOW earlier AS (ORDER BY (3 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, n, least(w * coalesce(max(CASE WHEN w * lv <= lim THEN lv END) OVER (), 0), lim::DOUBLE) AS target FROM leveled),
parted AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 3.0::DOUBLE) ELSE 0 END AS e,
         ('0x' || substr(md5(coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(t.n / 1000.0)::BIGINT AS part
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY size, doc_id ASC NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source, part) AS n
  FROM parted),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY part, CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - i // 2 END) - 1 AS r FROM ordered)
SELECT doc_id, size, source_size, target, (least(floor(e * (r + 1) + u) - floor(e * r + u), 3) * size)::BIGINT AS taken FROM placed
"""

URL_RULES_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parts),
voted AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END AS said FROM ruled),
hosts AS (
  SELECT host, count(said) AS n, count(CASE WHEN said = 'block' THEN 1 END) AS k,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix
  FROM voted GROUP BY host),
overall AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS m FROM hosts),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, m FROM hosts, overall GROUP BY suffix, m),
r1 AS (SELECT (sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS x FROM s0 WHERE n > 0),
c1 AS (SELECT CASE WHEN x IS NULL THEN 2.0 ELSE (1 - greatest(least(x, 0.999), 0.001)) / greatest(least(x, 0.999), 0.001) END AS s FROM r1),
s1 AS (SELECT suffix, (k + s * m) / (n + s) AS m, n + s AS held FROM s0, c1),
d0 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, m, held FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix, m, held),
r2 AS (SELECT (sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS x FROM d0 WHERE n > 0),
c2 AS (SELECT CASE WHEN x IS NULL THEN 2.0 ELSE (1 - greatest(least(x, 0.999), 0.001)) / greatest(least(x, 0.999), 0.001) END AS s FROM r2),
d1 AS (SELECT domain, suffix, (k + least(s, held) * m) / (n + least(s, held)) AS m, n + least(s, held) AS held FROM d0, c2),
h0 AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k, m, held FROM hosts JOIN d1 USING (domain, suffix)),
r3 AS (SELECT (sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS x FROM h0 WHERE n > 0),
c3 AS (SELECT CASE WHEN x IS NULL THEN 2.0 ELSE (1 - greatest(least(x, 0.999), 0.001)) / greatest(least(x, 0.999), 0.001) END AS s FROM r3),
h1 AS (SELECT host, k + least(s, held) * m AS a, n - k + least(s, held) * (1 - m) AS b FROM h0, c3),
judged AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.8 THEN 'block' ELSE 'allow' END AS reputed FROM h1)
SELECT page_id, host, path, rule, coalesce(said, reputed) AS verdict FROM voted JOIN judged USING (host)
"""
