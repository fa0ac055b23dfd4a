"""DuckDB SQL for the operator queries that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) v(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT doc_id, lang, base_failed, 'symbols' AS rule, 1000 * n_symbols // greatest(word_chars, 1) AS score FROM b
  UNION ALL SELECT doc_id, lang, base_failed, 'dup_lines', 1000 * n_dup_lines // greatest(n_lines, 1) FROM b
  UNION ALL SELECT doc_id, lang, base_failed, 'repeats', 1000 * n_repeat_words // greatest(n_words, 1) FROM b),
good AS (SELECT lang, rule, score FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
c AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM good, unnest([10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900]) u(cutoff) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * 0.01e0 THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01e0) + (n - i) * ln(0.99e0))) FROM unnest(range(0, k + 1)) u(i)) END AS p, count(*) OVER () AS tests FROM c),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM p WHERE p <= 0.05e0 / tests GROUP BY ALL),
hit AS (SELECT doc_id, list(s.rule) AS r FROM s JOIN cut ON cut.lang IS NOT DISTINCT FROM s.lang AND cut.rule = s.rule AND score > cutoff GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  array_to_string(list_filter(['symbols', 'dup_lines', 'repeats'], lambda x: list_contains(coalesce(r, []), x)), ',') AS rejected_by, NOT base_failed AND r IS NULL AS kept
FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id"""

OP2 = rf"""
WITH z AS (SELECT doc_id, source, text, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS sym FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0) / CASE WHEN size > 0 THEN CAST(size AS DOUBLE) / (size + 10 * sym) ELSE 1e0 END AS key FROM z),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM g),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) / w AS ratio, coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(w) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww, sum(source_size) OVER () AS t FROM w),
l AS (SELECT *, (CAST(t AS DOUBLE) * 1.5e0 - CAST(c AS DOUBLE)) / CAST(ww AS DOUBLE) AS level FROM r),
h AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS ep FROM h),
q AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.ep, CAST(floor(e.target - e.ep * e.source_size) AS BIGINT) AS rest,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before FROM k JOIN e ON e.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(ep * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM q"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id"""

_TERMS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8 = rf"""
WITH d AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_TERMS.format("coalesce(text, '')")} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 8, 2))) u(k) WHERE len(w) > 0),
x AS (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS g FROM d, (SELECT DISTINCT size FROM v), unnest(range(1, len(w) - size + 2)) u(k)),
h AS (SELECT doc_id, k, x.size, item_id FROM x JOIN v ON v.g = x.g AND v.size = x.size),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM h, unnest(range(0, size)) u(j) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM h WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

#: Bytes as hex digits; strings of 100 bytes compared by their MD5.
OP9 = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, length(h) // 2 - 99)) AS p, unnest(list_transform(range(0, length(h) // 2 - 99), lambda p: md5_number(substr(h, 2 * p + 1, 200)))) AS s FROM d),
twice AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM (SELECT r, p, row_number() OVER (PARTITION BY s ORDER BY r, p) AS n FROM w) WHERE n > 1),
runs AS (SELECT r, min(p) AS a, max(p) + 100 AS e FROM (SELECT *, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM twice) GROUP BY r, k),
gone AS (SELECT r, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, sum(e - a) AS n FROM runs GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE e[i] END) + 1, 2 * ((CASE WHEN i = len(a) THEN length(h) // 2 ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE e[i] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (r)"""

_BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _found(kind: int, pattern: str) -> str:
    """(r, kind, i, m, gap): matches in order, each with the text between it and the one before."""
    return f"SELECT r, {kind} AS kind, i, m, gap FROM (SELECT r, unnest(m) AS m, unnest(g[1 : len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM texts) WHERE len(m) > 0)"


_START = "CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT)"
_KINDS = "['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || a || ':' || e"
_DIGIT = "CAST(substr(d, length(d) - i, 1) AS INT)"
OP7 = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, text AS t FROM (SELECT DISTINCT text FROM documents)),
size AS (SELECT count(*) AS total FROM texts),
raw AS ({" UNION ALL ".join(_found(k, p) for k, p in enumerate(_BASE))}),
placed AS (SELECT r, kind, m, {_START} AS a, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM raw WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
base AS (SELECT r, kind, a, a + length(m) AS e, kind || ':' || CASE kind WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE d END AS entity FROM placed
  WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: regexp_full_match(x, '0*([0-9]{{1,2}}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))) = 4
    WHEN 2 THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGIT} ELSE ({_DIGIT} * 2) % 10 + ({_DIGIT} * 2) // 10 END)) % 10 = 0
    ELSE length(d) BETWEEN 10 AND 15 END),
words AS (SELECT r, i, {LOW.format("m")} AS term, {_START} AS a, {_START} + length(m) AS e FROM ({_found(4, _WORD)}) WINDOW w AS (PARTITION BY r ORDER BY i)),
touched AS (SELECT DISTINCT w.r, w.i FROM words w JOIN base b ON b.r = w.r AND b.e > w.a AND b.a < w.e),
sides AS (SELECT b.r, b.entity, max(w.i) FILTER (w.e <= b.a) AS left_, min(w.i) FILTER (w.a >= b.e) AS right_ FROM base b JOIN words w ON w.r = b.r GROUP BY b.r, b.entity, b.a, b.e, b.kind),
near AS (SELECT DISTINCT s.r, w.term, s.entity FROM sides s JOIN words w ON w.r = s.r AND (w.i > left_ - 8 AND w.i <= left_ OR w.i >= right_ AND w.i < right_ + 8) ANTI JOIN touched t ON t.r = w.r AND t.i = w.i WHERE length(w.term) >= 3 AND regexp_matches(w.term, '\p{{L}}')),
pairs AS (SELECT term, entity, count(*) AS n FROM near GROUP BY ALL HAVING count(*) >= 2),
df AS (SELECT term, count(DISTINCT r) AS df FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term),
seen AS (SELECT entity, count(DISTINCT r) AS n_entity FROM base GROUP BY entity),
judged AS (SELECT term, CAST(n AS DOUBLE) / df AS share, CAST(n_entity AS DOUBLE) / total AS p, n, df FROM pairs JOIN df USING (term) JOIN seen USING (entity), size),
telling AS (SELECT DISTINCT term FROM judged WHERE share >= 0.5 AND CASE WHEN share > p AND p < 1 THEN n * log2(share / p) + CASE WHEN n < df THEN (df - n) * log2((1 - share) / (1 - p)) ELSE 0 END ELSE 0 END >= 8),
terms AS (SELECT w.r, 4 AS kind, w.a, w.e FROM words w ANTI JOIN touched t ON t.r = w.r AND t.i = w.i WHERE term IN (SELECT term FROM telling)),
every AS (SELECT r, kind, a, e FROM base UNION ALL SELECT * FROM terms),
lines AS (SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, count(*) FILTER (kind = 4) AS n_term,
  string_agg({_KINDS}, ',' ORDER BY a, kind, e) AS spans, string_agg({_KINDS}, ',' ORDER BY a, kind) FILTER (kind < 4) AS b FROM every GROUP BY r)
SELECT d.doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_email", "n_ip", "n_card", "n_phone"))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM documents d JOIN texts ON texts.t IS NOT DISTINCT FROM d.text LEFT JOIN lines ON lines.r = texts.r"""
