"""The same results in DuckDB SQL, for the operators that SQL can express.

Merging by rank, compression, suffix removal with its digests, trained models, rolling
hashes and differencing are beyond it; tests hold those against brute force.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item, n, w[i:i + n - 1] AS p
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), win AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pat))
), hit AS (
  SELECT doc_id, i, win.n, item FROM win JOIN pat ON win.p = pat.p
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, w[i:i + 3] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * common.n >= 85 * (sa.n + sb.n - common.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS node, b AS other FROM edges
  UNION
  SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT node AS doc_id, min(other) AS low FROM reach GROUP BY node) USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS m, strlen(coalesce(html, '')) AS n,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
         '"' || md5(coalesce(html, ''))[1:16] || '"' AS tag
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)='))), '&') AS query
  FROM p
), k AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM q
), moved AS (
  SELECT *, page_id * 2 + ((length(coalesce(url, '')) * 7919 + page_id * 104729) % 2001 - 1000) * 2 + 1 AS ts FROM k
), full_ AS (
  SELECT url_key, page_id * 2 AS ts, page_id, m, n, tag FROM k
), r AS (
  SELECT moved.page_id, moved.url_key, moved.ts, moved.tag AS own, f.page_id AS other, f.m, f.n, f.tag
  FROM moved ASOF LEFT JOIN full_ f ON moved.url_key = f.url_key AND moved.ts > f.ts
)
SELECT page_id * 2 + 1 AS revisit_id, url_key, ts,
       CASE WHEN other IS NULL THEN 'missing' WHEN own = tag THEN 'resolved' ELSE 'mismatch' END AS state,
       CASE WHEN own = tag THEN other * 2 END AS refers_to, CASE WHEN own = tag THEN other * 2 END AS refers_ts,
       CASE WHEN own = tag THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || n || chr(10)
         || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/' || own || chr(10)
         || 'last-modified: ' || other END AS headers,
       CASE WHEN own = tag THEN m END AS payload_md5, CASE WHEN own = tag THEN n END AS payload_bytes
FROM r
"""

def _quartiles(keys: str) -> str:
    """Rows, lower and upper quartile of each rate, by the given keys of the table `r` with a trailing comma."""
    return f"""
  SELECT {keys} rate, rows, min(b) FILTER (4 * upto >= rows) AS q1, min(b) FILTER (4 * upto >= 3 * rows) AS q3
  FROM (SELECT {keys} rate, b, sum(count(*)) OVER (PARTITION BY {keys} rate ORDER BY b) AS upto,
               sum(count(*)) OVER (PARTITION BY {keys} rate) AS rows FROM r GROUP BY {keys} rate, b)
  GROUP BY {keys} rate, rows"""


ADAPTIVE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT k, i, w[i:i + 2] AS s FROM (SELECT k, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM d)
), again AS (
  SELECT k, count(DISTINCT p) AS n FROM (
    SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1)
  GROUP BY k
), c AS (
  SELECT k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM d LEFT JOIN again USING (k)
), v AS (
  SELECT *, unnest([{{'rate': 'word_length', 'v': 100 * word_chars // n_words}}, {{'rate': 'symbols', 'v': 1000 * n_symbols // n_words}},
                    {{'rate': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(len(l), 1)}},
                    {{'rate': 'repeats', 'v': 1000 * n_repeat_words // n_words}}], recursive := true)
  FROM c WHERE NOT base_failed
), r AS (
  SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b FROM v
), own AS ({_quartiles('lang, source,')}), wide AS ({_quartiles('lang,')}), whole AS ({_quartiles('')}), q AS (
  SELECT own.lang, own.source, rate,
         CASE WHEN own.rows >= 100 THEN own.q1 WHEN wide.rows >= 100 THEN wide.q1 ELSE whole.q1 END AS q1,
         CASE WHEN own.rows >= 100 THEN own.q3 WHEN wide.rows >= 100 THEN wide.q3 ELSE whole.q3 END AS q3
  FROM own JOIN wide USING (lang, rate) JOIN whole USING (rate)
), f AS (
  SELECT k, bool_and(CASE rate WHEN 'word_length' THEN v BETWEEN q1 - greatest(3 * (q3 - q1), 100) AND q3 + greatest(3 * (q3 - q1), 100)
                     WHEN 'symbols' THEN v <= q3 + greatest(3 * (q3 - q1), 20)
                     ELSE v <= q3 + greatest(3 * (q3 - q1), 300) END) AS inside
  FROM v JOIN q USING (lang, source, rate) GROUP BY k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(inside, FALSE) AS kept
FROM c LEFT JOIN f USING (k)
"""

COLLOCATIONS = rf"""
WITH piece AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS t FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents)
), w AS (
  SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece
), c AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))
  GROUP BY ALL
), n AS (
  SELECT lang, sum(a) AS n FROM c WHERE k = 1 GROUP BY lang
), f AS (
  SELECT * FROM c WHERE a >= 10
), cut AS (
  SELECT lang, p, a, k, unnest(range(1, k)) AS j FROM f WHERE k > 1
), s AS (
  SELECT cut.lang, cut.p, cut.a, arg_min({{'l': x.a, 'r': y.a}}, (score, j)) AS lr, min(score) AS score
  FROM (SELECT *, p[1:j] AS pl, p[j + 1:] AS pr FROM cut) cut JOIN f x ON x.lang = cut.lang AND x.p = pl
  JOIN f y ON y.lang = cut.lang AND y.p = pr,
  LATERAL (SELECT 1000000::HUGEINT * cut.a * cut.a // (x.a::HUGEINT * y.a) AS score)
  GROUP BY ALL
), longer AS (
  SELECT lang, p, max(a) AS most FROM (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, a FROM f WHERE k = 3) GROUP BY ALL
), best AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, lr.l AS l, lr.r AS r, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, phrase) AS rank
  FROM s LEFT JOIN longer ON longer.lang = s.lang AND longer.p = s.p WHERE most IS NULL OR 100 * most < 50 * s.a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op11_collocations": COLLOCATIONS,
    "op13_adaptive_rules": ADAPTIVE,
    "op6_decontamination": DECONTAMINATION,
    "op7_warc_revisits": WARC,
    "op9_jaccard_join": JACCARD,
}
