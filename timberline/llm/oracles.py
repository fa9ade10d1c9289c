"""DuckDB SQL for the corpus operators that SQL can express on whole tables."""

from __future__ import annotations

from timberline.llm.chat_format import OP2_SQL
from timberline.llm.conversation_repair import OP12_SQL
from timberline.llm.quality_rules import METRICS
from timberline.llm.url_filters import OP11_SQL
from timberline.llm.vector_codes import OP13_SQL

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {AZ}) AS key FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT k.*, keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS key FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS key FROM d, (SELECT DISTINCT size FROM win), unnest(range(1, len(w) - size + 2)) AS t(i)),
h AS (SELECT r, i, size, item_id FROM dw JOIN win USING (size, key)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM h, unnest(range(i, i + size)) AS t(q) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN it USING (r)
"""

_SLACK = " ".join(f"WHEN '{m}' THEN {v}" for m, v in METRICS.items())
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS n FROM (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS key FROM w, unnest(range(1, len(w) - 3)) AS t(i))),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM s, unnest(range(0, 5)) AS t(k) WHERE s.n >= 2 GROUP BY r),
base AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines
    FROM w LEFT JOIN rep USING (r)),
m AS (SELECT r, lang, source, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'chars_per_word']) AS metric,
    unnest([n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) AS v FROM base),
sk AS (SELECT lang, source, metric, CASE WHEN v > 1e-9 THEN CAST(ceil(ln(v) / ln(CAST(1.02 AS DOUBLE))) AS INTEGER) ELSE -1073741824 END AS bucket, count(*) AS n FROM m GROUP BY ALL),
lv AS (SELECT 0 AS level, lang, source, metric, bucket, n FROM sk UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM sk GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM sk GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM lv),
q AS (SELECT level, lang, source, metric, any_value(total) AS total, min(bucket) FILTER (c >= 0.25 * total) AS b25, min(bucket) FILTER (c >= 0.75 * total) AS b75 FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, metric, total, CASE WHEN b25 = -1073741824 THEN 0.0 ELSE exp(b25 * ln(CAST(1.02 AS DOUBLE))) * (2 / CAST(2.02 AS DOUBLE)) END AS q25, CASE WHEN b75 = -1073741824 THEN 0.0 ELSE exp(b75 * ln(CAST(1.02 AS DOUBLE))) * (2 / CAST(2.02 AS DOUBLE)) END AS q75 FROM q),
t AS (SELECT *, q75 + greatest(3 * (q75 - q25), CASE metric {_SLACK} END) AS top FROM f),
bad AS (SELECT m.r, bool_or(v > (t0.total * t0.top + 200 * ((t1.total * t1.top + 200 * t2.top) / (t1.total + 200))) / (t0.total + 200)) AS outside FROM m
    LEFT JOIN t t0 ON t0.level = 0 AND t0.metric = m.metric AND t0.lang IS NOT DISTINCT FROM m.lang AND t0.source IS NOT DISTINCT FROM m.source
    LEFT JOIN t t1 ON t1.level = 1 AND t1.metric = m.metric AND t1.lang IS NOT DISTINCT FROM m.lang
    LEFT JOIN t t2 ON t2.level = 2 AND t2.metric = m.metric GROUP BY m.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT outside AS kept
FROM base JOIN bad USING (r)
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b USING (k) WHERE a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT r, r AS c FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.c = e.a)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach USING (r) JOIN d o ON o.r = reach.c LEFT JOIN n ON n.r = d.r GROUP BY d.r
"""

ORACLES = {"op1_line_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op8_decontamination": OP8_SQL, "op9_quality_rules": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_url_filters": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_vector_codes": OP13_SQL}
