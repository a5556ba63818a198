"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations

from .quality import CLASSES, COMMON_WORDS

_OP5 = r"""
WITH words AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
               UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE side = 1 AND len(w) > 0),
starts AS (SELECT side, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lens WHERE len(w) >= k AND (side = 0 OR k = least(len(w), 5))),
shingles AS (SELECT DISTINCT side, id, array_to_string(w[i:i + k - 1], ' ') AS s FROM starts),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, z.n AS n_item, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / z.n AS containment
FROM shingles b JOIN shingles d ON b.s = d.s AND b.side = 1 AND d.side = 0 JOIN sizes z ON z.id = b.id
GROUP BY d.id, b.id, z.n HAVING CAST(count(*) AS DOUBLE) / z.n >= CAST(0.8 AS DOUBLE) - CAST(1e-9 AS DOUBLE)
"""

_OP7 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, held.k IS NOT NULL AND keyed.doc_id <> held.keep AS gone FROM keyed LEFT JOIN held ON keyed.k = held.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _quality() -> str:
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    k = len(CLASSES) + 1
    counts = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in CLASSES.values())
    return rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
named AS (SELECT doc_id, lang, t, w, len(w) AS n, [{counts}] AS c FROM base),
classed AS (SELECT doc_id, lang, t, w, n, list_append(c, length(t) - list_sum(c)) AS c FROM named),
counted AS (SELECT doc_id, lang, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM classed),
class_ref AS (SELECT lang, i, CAST(sum(v) AS DOUBLE) / sum(sum(v)) OVER (PARTITION BY lang) AS q
              FROM (SELECT lang, i, v FROM counted WHERE lang IS NOT NULL UNION ALL SELECT NULL, i, v FROM counted) GROUP BY lang, i),
class_js AS (SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
             FROM (SELECT x.doc_id, CAST(x.v AS DOUBLE) / greatest(length(z.t), 1) AS p, r.q FROM counted x JOIN classed z USING (doc_id)
                   JOIN class_ref r ON r.lang IS NOT DISTINCT FROM x.lang AND r.i = x.i) GROUP BY doc_id),
common AS (SELECT doc_id, lang, w, count(*) AS c FROM (SELECT doc_id, lang, lower(unnest(w)) AS w FROM base) WHERE w IN ({listed}) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM (SELECT lang, n FROM classed WHERE lang IS NOT NULL UNION ALL SELECT NULL, n FROM classed) GROUP BY lang),
word_ref AS (SELECT c.lang, w, CAST(sum(c) AS DOUBLE) / max(t.n) AS q FROM (SELECT lang, w, c FROM common WHERE lang IS NOT NULL UNION ALL SELECT NULL, w, c FROM common) c
             JOIN totals t ON t.lang IS NOT DISTINCT FROM c.lang GROUP BY c.lang, w),
cells AS (SELECT z.doc_id, coalesce(CAST(x.c AS DOUBLE), 0) / greatest(z.n, 1) AS p, r.q FROM classed z JOIN word_ref r ON r.lang IS NOT DISTINCT FROM z.lang
          LEFT JOIN common x ON x.doc_id = z.doc_id AND x.w = r.w),
both_sides AS (SELECT doc_id, p, q FROM cells UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM cells GROUP BY doc_id),
word_js AS (SELECT doc_id, sum(CASE WHEN p > 1e-15 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 1e-15 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM both_sides GROUP BY doc_id),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM classed WHERE n >= 3)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
facts AS (SELECT z.doc_id, z.n AS n_words, length(z.t) - z.c[5] AS word_chars, z.c[3] AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
                 coalesce(r.r, 0) AS n_repeat_words, length(z.t) AS chars, sqrt(least(greatest(cj.d, 0), 1)) AS char_js, sqrt(least(greatest(wj.d, 0), 1)) AS word_js
          FROM classed z LEFT JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN class_js cj USING (doc_id) LEFT JOIN word_js wj USING (doc_id)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND (chars < 200 OR char_js <= CAST(0.25 AS DOUBLE)) AND (n_words < 50 OR word_js <= CAST(0.14 AS DOUBLE) + CAST(1.75 AS DOUBLE) / sqrt(n_words)) AS kept
FROM ruled
"""


_OP4 = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
whole AS (SELECT conv_id, count(*) AS n, list([role, text] ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts,
                 string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat FROM rows GROUP BY conv_id),
one AS (SELECT ts, n, chat, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY ts, n, chat)
SELECT conv_id, n AS n_turns, n_copies, chat FROM one
WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.n > one.n AND w.ts[1:one.n] = one.ts)
"""

_OP6 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
one AS (SELECT c, count(*) AS n FROM places GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM places WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM places WHERE a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT sum(n) AS n FROM one),
scored AS (SELECT p.doc_id, (p.a IS NOT NULL AND t3.n < 2) OR (p.a IS NULL AND p.b IS NOT NULL AND t2.n < 2) AS back,
             CASE WHEN t3.n >= 2 THEN ln(CAST(t3.n AS DOUBLE) / ab.n)
                  WHEN t2.n >= 2 THEN ln(CAST(t2.n AS DOUBLE) / ob.n) + CASE WHEN p.a IS NULL THEN 0 ELSE ln(CAST(0.4 AS DOUBLE)) END
                  ELSE ln(CAST(o.n AS DOUBLE) / total.n) + CASE WHEN p.b IS NULL THEN 0 WHEN p.a IS NULL THEN 1 ELSE 2 END * ln(CAST(0.4 AS DOUBLE)) END AS s
           FROM places p JOIN one o ON o.c = p.c LEFT JOIN two t2 ON t2.b = p.b AND t2.c = p.c LEFT JOIN three t3 ON t3.a = p.a AND t3.b = p.b AND t3.c = p.c
           LEFT JOIN two ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN one ob ON ob.c = p.b, total),
sums AS (SELECT doc_id, count(*) AS n, sum(CAST(back AS INTEGER)) AS k, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_backoff, round(s / n, 6) AS mean_score FROM documents d LEFT JOIN sums USING (doc_id)
"""

_OP10 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i - 1 AS lo, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
held AS (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
found AS (SELECT doc_id, lo FROM windows SEMI JOIN held ON windows.h = held.h),
marked AS (SELECT doc_id, lo, CASE WHEN lo - lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) <= 50 THEN 0 ELSE 1 END AS new,
                  least(50, coalesce(lo - lag(lo) OVER (PARTITION BY doc_id ORDER BY lo), 50)) AS gain FROM found)
SELECT doc_id, CAST(sum(new) AS BIGINT) AS n_spans, CAST(sum(gain) AS BIGINT) AS n_repeated, min(lo) AS first_start, max(lo) + 50 AS last_end FROM marked GROUP BY doc_id
"""

_OP8 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
             UNION SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT r.a AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""

ORACLE = {
    "op2_quality_divergence": _quality(),
    "op4_chat_collapse": _OP4,
    "op5_decontaminate": _OP5,
    "op6_stupid_backoff": _OP6,
    "op7_line_dedup": _OP7,
    "op8_jaccard_join": _OP8,
    "op10_suffix_dedup": _OP10,
}
