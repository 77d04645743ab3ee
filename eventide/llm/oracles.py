"""DuckDB SQL for the queries of this subpackage that SQL can express."""

URLS = r"""
WITH rules(verdict, rh, rp) AS (
  VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
rest AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x
  FROM pages),
parts AS (
  SELECT page_id, r, translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT r, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC, verdict DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (r)
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS n FROM iw WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM dwin JOIN wins USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_COMMON = (
    "a al and are as at auf be by con das dans de dem den der des die du ein en est et for from has have in is it la las le les los "
    "mit nicht of on or par pas pour que qui se sich sur that the this to un una und une von was with y zu"
).split()
_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[\x00-\x08\x0E-\x1F!\x22\x27()+,\-./:;=?@\[\\\]^_`{}~\x7F]", r"[^\x00-\x7F]")

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS lang
  FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c >= 2) GROUP BY r),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT r, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
hist AS (
  SELECT r, lang, 'c' AS kind, k AS bin, length(text) - length(regexp_replace(text, pattern, '', 'gs')) AS n
  FROM d, (SELECT unnest(range(1, {len(_CLASSES) + 1})) AS k, unnest([{", ".join("'" + c + "'" for c in _CLASSES)}]) AS pattern)
  UNION ALL
  SELECT r, lang, 'w' AS kind, coalesce(list_position([{", ".join("'" + c + "'" for c in _COMMON)}], translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 0) AS bin, count(*) AS n
  FROM (SELECT r, lang, unnest(w) AS x FROM w) GROUP BY ALL),
ref AS (SELECT lang, kind, bin, sum(n) AS n FROM hist GROUP BY ALL),
q AS (SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM ref),
p AS (SELECT r, lang, kind, bin, n / sum(n) OVER (PARTITION BY r, kind) AS p FROM hist),
js AS (
  SELECT docs.r, q.kind, sum(CASE WHEN coalesce(p, 0) > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((coalesce(p, 0) + q) / 2)) ELSE 0 END) / 2 AS x
  FROM (SELECT r, lang FROM d) docs JOIN q USING (lang) LEFT JOIN p ON p.r = docs.r AND p.kind = q.kind AND p.bin = q.bin
  GROUP BY docs.r, q.kind),
far AS (SELECT r, max(CASE WHEN kind = 'c' THEN sqrt(greatest(x, 0)) END) AS cd, max(CASE WHEN kind = 'w' THEN sqrt(greatest(x, 0)) END) AS wd FROM js GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words >= 50 AND (coalesce(cd, 0) > 0.25 OR coalesce(wd, 0) > 0.30)) AS kept
FROM base LEFT JOIN far USING (r)
"""

NGRAMS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

_TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_TRIGGER = r"(?i)licen[cs]e|copyright|spdx|creative commons|public domain|redistribution|\bcc[ -](by|0)"

LICENSES = rf"""
WITH tt AS (
  SELECT license, term, count(*) AS n FROM (
    SELECT license, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TEMPLATES)}) v(license, t)) GROUP BY ALL),
idf AS (SELECT term, ln((1 + {len(_TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tn AS (SELECT license, sqrt(sum((n * idf) ** 2)) AS norm FROM tt JOIN idf USING (term) GROUP BY license),
tw AS (SELECT license, term, n * idf / norm AS weight FROM tt JOIN idf USING (term) JOIN tn USING (license)),
d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text FROM documents),
l AS (
  SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_TRIGGER}')),
c AS (
  SELECT doc_id, pos, term, count(*) AS n FROM (
    SELECT doc_id, pos, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM l) GROUP BY ALL),
w AS (SELECT doc_id, pos, term, n * coalesce(idf, ln(1 + {len(_TEMPLATES)}) + 1) AS w FROM c LEFT JOIN idf USING (term)),
norm AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
score AS (
  SELECT doc_id, pos, license, round(sum(w * weight) / any_value(norm), 6) AS cosine
  FROM w JOIN tw USING (term) JOIN norm USING (doc_id, pos) GROUP BY ALL),
line_best AS (
  SELECT doc_id, pos, license, cosine, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY cosine DESC, license) AS k FROM score) JOIN l USING (doc_id, pos) WHERE k = 1 AND cosine >= 0.75),
own AS (
  SELECT doc_id, license AS own_license, cosine, words FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS k FROM line_best)
  JOIN (SELECT doc_id, sum(words) AS license_words FROM line_best GROUP BY doc_id) USING (doc_id) WHERE k = 1),
owned AS (
  SELECT d.doc_id, d.path, own_license, cosine, 100 * license_words >= 50 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS is_file
  FROM d JOIN own USING (doc_id) JOIN (SELECT doc_id, sum(words) AS license_words FROM line_best GROUP BY doc_id) USING (doc_id)),
speaks AS (
  SELECT above, own_license AS inherited_license FROM (
    SELECT regexp_extract(path, '^(.*)/', 1) AS above, own_license, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY cosine DESC, own_license) AS k
    FROM owned WHERE is_file) WHERE k = 1),
near AS (
  SELECT doc_id, inherited_license FROM (
    SELECT doc_id, inherited_license, row_number() OVER (PARTITION BY doc_id ORDER BY length(above) DESC) AS k
    FROM d JOIN speaks ON above = '' OR starts_with(path, above || '/')) WHERE k = 1)
SELECT d.doc_id, d.path, own_license, cosine, coalesce(is_file, false) AS is_file, inherited_license, coalesce(own_license, inherited_license) AS license
FROM d LEFT JOIN owned USING (doc_id) LEFT JOIN near USING (doc_id)
"""
