"""DuckDB forms of the operators whose rows SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
met AS (SELECT a.doc_id u, b.doc_id v, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM met JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
linked AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(u, v) AS (SELECT u, v FROM linked UNION SELECT r.u, b.v FROM reach r JOIN linked b ON b.u = r.v),
least_of AS (SELECT u, min(v) m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, d.doc_id <= coalesce(m, d.doc_id) kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.u = d.doc_id
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) w FROM documents),
g AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') g FROM d, unnest(range(1, greatest(len(w) - 18, 1))) t(k)),
again AS (SELECT doc_id, k FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(k, k + 20)) t(p)),
word AS (SELECT doc_id, p, w[p] word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY p) text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, len(w)::BIGINT - coalesce(n, 0) n_removed, sha256(coalesce(text, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) w FROM documents),
b AS (SELECT item_id::VARCHAR item, regexp_extract_all({_LOWER}, {_ALNUM}) w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13)::BIGINT n, array_to_string(list_slice(w, k, k + 12), ' ') g FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') g FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) t(k)),
found AS (SELECT doc_id, k, g.n, item FROM g JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM found, unnest(range(k, k + n)) t(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(listed, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"

URLS = f"""
WITH u AS (SELECT page_id, url, {_HOST} host, {_PATH} path,
  list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('ref', 'fbclid', 'gclid'))) told FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)$', ''), '\\.$', ''), '^www\\.', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN len(told) > 0 THEN '?' || array_to_string(told, '&') ELSE '' END END canonical FROM u),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND list_has_any(string_split(host, '.'), ['casino-win', 'free-bets', 'ads-track', 'spam-farm', 'cheap-pills'])),
ruled AS (SELECT c.*, l.canonical IS NOT NULL listed, CASE WHEN {_FITS.format("example.net", "/en/")} THEN 'example.net/en/' WHEN {_FITS.format("example.com", "/de/")} THEN 'example.com/de/'
  WHEN {_FITS.format("org", "/fr/")} THEN 'org/fr/' WHEN {_FITS.format("net", "/")} THEN 'net/' END AS rule FROM c LEFT JOIN listed l ON l.canonical = c.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END verdict, listed FROM ruled
"""
