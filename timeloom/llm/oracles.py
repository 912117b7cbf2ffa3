"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

URLS = f"""WITH u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
h AS (SELECT rule, verdict, split_part(rule, '/', 1) AS name, substr(rule, strpos(rule, '/')) AS own FROM r),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN h ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, own) GROUP BY page_id),
s AS (SELECT DISTINCT host, regexp_replace(host, '^(m|www|blog)[.]', '') AS site, starts_with(host, 'm.') AS mobile FROM p),
m AS (SELECT host FROM s WHERE mobile AND site IN (SELECT site FROM s WHERE NOT mobile))
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN host IN (SELECT host FROM m) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f USING (page_id)"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM rep, range(5) t(k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM ln WHERE trim(raw, {_BLANK}) <> '' GROUP BY doc_id),
nl AS (SELECT doc_id, host, text, lower(trim(raw, {_BLANK})) AS line FROM ln WHERE trim(raw, {_BLANK}) <> ''),
common AS (SELECT host, line FROM nl GROUP BY host, line HAVING count(DISTINCT text) > 20),
cw AS (SELECT doc_id, sum(len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS n FROM nl WHERE (host, line) IN (SELECT (host, line) FROM common) GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(cw.n, 0) AS common_words FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN cw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (common_words > 0 AND (n_words - common_words < 10 OR 100 * (n_words - common_words) < 20 * n_words)) AS kept FROM s"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
n AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
c AS (SELECT key FROM n WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT doc_id, k, line, key IN (SELECT key FROM c) AS gone FROM n)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

PASSAGES = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - 19)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS g FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, range(20) t(k)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""

_PARTS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(_LOWER.format("coalesce(text, '')"))

LEAKS = f"""WITH d AS (SELECT doc_id, {_PARTS} AS w FROM documents), b AS (SELECT item_id, {_PARTS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
own AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p:p + size - 1], ' '))) AS g FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
met AS (SELECT doc_id, i, win.size, item_id FROM own JOIN win ON own.size = win.size AND own.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: CRC-32 byte by byte: the table of the reversed polynomial, then a fold over the UTF-8 bytes of letters up to U+00FF.
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
_BYTES = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"
SPELLING = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
runs AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS word FROM documents) GROUP BY ALL),
summed AS (SELECT word, n, list_reduce(list_prepend(4294967295, {_BYTES.format("doc_id || ':' || word")}), lambda c, b: xor(crc[(xor(c, b) % 256) + 1], c // 256)) AS c FROM runs, t),
hashed AS (SELECT word, n, xor(c, 4294967295) AS h, length(word) AS size FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(word, 1, h % size) || substr(word, h % size + 2) ELSE word END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS rest FROM words),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, list({{'near': near, 'n': near_n}} ORDER BY near_n DESC, near COLLATE C)[1] AS top FROM pairs GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * words.n THEN top.near END AS form, CASE WHEN top.n >= 5 * words.n THEN top.n END AS form_n FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, 0 AS far FROM forms UNION ALL SELECT ways.word, forms.form, far + 1 FROM ways JOIN forms ON ways.root = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, far) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

ORACLES = {"op5_url_cascade": URLS, "op6_quality_rules": QUALITY, "op8_line_dedup": LINES, "op9_passage_dedup": PASSAGES, "op12_spelling_variants": SPELLING, "op13_benchmark_overlap": LEAKS}
