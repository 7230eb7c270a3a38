"""DuckDB statements of the text queries that SQL can express; each stands for the query of the same name."""

from __future__ import annotations

from .license_scan import ANCHOR, KNOWN, LABEL, RULES

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: The shape of op10: features, quartiles of log-linear bins by group, cutoffs, verdict. Column names end in the digest.
QUALITY_CTES = r"""
q_words AS (
  SELECT row_number() OVER () AS rid, *, """ + WORDS.format("coalesce(text, '')") + r""" AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
q_windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
  FROM (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM q_words WHERE len(w) >= 8))
),
q_repeats AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM q_windows WHERE c > 1) GROUP BY rid
),
q_base AS (
  SELECT q.* EXCLUDE (w, l), CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM q_words q LEFT JOIN q_repeats r USING (rid)
),
q_feat AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length,
    CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_share,
    CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END AS upper_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_share
  FROM q_base
),
q_long AS (
  SELECT lang, source, feature, CAST((v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS BIGINT) AS b
  FROM (SELECT lang, source, unnest(['word_length', 'symbol_share', 'upper_share', 'dup_line_share']) AS feature,
               unnest([word_length, symbol_share, upper_share, dup_line_share]) AS v FROM q_feat)
),
q_own AS (SELECT lang, source, feature, count(*) AS n, quantile_disc(b, [0.25, 0.5, 0.75]) AS q FROM q_long GROUP BY ALL),
q_lang AS (SELECT lang, feature, count(*) AS n, quantile_disc(b, [0.25, 0.5, 0.75]) AS q FROM q_long GROUP BY ALL),
q_all AS (SELECT feature, quantile_disc(b, [0.25, 0.5, 0.75]) AS q FROM q_long GROUP BY ALL),
q_drawn AS (
  SELECT o.lang, o.source, o.feature, list_transform([1, 2, 3], lambda k: (o.n * o.q[k] + 20 * ((l.n * l.q[k] + 20 * a.q[k]) // (l.n + 20))) // (o.n + 20)) AS q
  FROM q_own o JOIN q_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.feature = l.feature JOIN q_all a ON o.feature = a.feature
),
q_slack(feature, below, above) AS (VALUES ('word_length', 300, 300), ('symbol_share', NULL, 50), ('upper_share', NULL, 150), ('dup_line_share', NULL, 500)),
q_cut AS (
  SELECT lang, source, feature, lo - 6 * (q[3] - lo) - below AS low, hi + 6 * (hi - q[1]) + above AS high
  FROM (SELECT *, greatest(q[1], 3 * q[2] - 2 * q[3] - coalesce(below, 0) // 20 - q[2] // 16) AS lo, least(q[3], 3 * q[2] - 2 * q[1] + above // 20 + q[2] // 16) AS hi FROM q_drawn JOIN q_slack USING (feature))
),
q_wide AS (
  SELECT lang, source,
    max(CASE WHEN feature = 'word_length' THEN low END) AS low_len,
    max(CASE WHEN feature = 'word_length' THEN high END) AS high_len,
    max(CASE WHEN feature = 'symbol_share' THEN high END) AS high_sym,
    max(CASE WHEN feature = 'upper_share' THEN high END) AS high_up,
    max(CASE WHEN feature = 'dup_line_share' THEN high END) AS high_dup
  FROM q_cut GROUP BY lang, source
),
q_judged AS (
  SELECT f.*, NOT base_failed AND NOT (word_length < low_len OR word_length > high_len OR symbol_share > high_sym
      OR upper_share > high_up OR dup_line_share > high_dup) AS kept
  FROM q_feat f JOIN q_wide w ON f.lang IS NOT DISTINCT FROM w.lang AND f.source IS NOT DISTINCT FROM w.source
)"""

OP10 = f"WITH {QUALITY_CTES}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged"

#: The shape of op8: of each text and item the window with the most shared shingles, found by plain counting.
LEAK_CTES = r"""
l_docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
l_items AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS width FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
l_widths AS (SELECT DISTINCT width FROM l_items),
l_grams AS (SELECT rid, n, width, p, array_to_string(w[p:p + width - 1], ' ') AS g FROM (SELECT rid, w, len(w) AS n, width, unnest(range(1, len(w) - width + 2)) AS p FROM l_docs, l_widths WHERE len(w) >= width)),
l_bags AS (SELECT item_id, n, width, g, count(*) AS k FROM (SELECT item_id, n, width, array_to_string(w[p:p + width - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - width + 2)) AS p FROM l_items)) GROUP BY ALL),
l_hits AS (SELECT d.rid, d.n, d.p, d.g, b.item_id, b.n AS size, b.width, b.k FROM l_grams d JOIN l_bags b ON d.width = b.width AND d.g = b.g),
l_windows AS (SELECT DISTINCT rid, item_id, n, size, width, least(p, greatest(n - size + 1, 1)) AS s FROM l_hits),
l_shared AS (
  SELECT rid, item_id, n, size, width, s, sum(least(c, k)) AS m
  FROM (SELECT w.rid, w.item_id, w.n, w.size, w.width, w.s, h.g, h.k, count(*) AS c FROM l_windows w JOIN l_hits h ON w.rid = h.rid AND w.item_id = h.item_id AND h.p BETWEEN w.s AND w.s + w.size - w.width GROUP BY ALL)
  GROUP BY ALL
),
l_leaks AS (
  SELECT rid, item_id, max(m / (total - m)) AS similarity
  FROM (SELECT *, least(size, n) + size - 2 * width + 2 AS total FROM l_shared)
  WHERE 100 * m >= 80 * (total - m) GROUP BY rid, item_id
)"""

OP8 = "WITH " + LEAK_CTES.replace("{docs}", "documents") + """
SELECT doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items,
  coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS item_ids, max(similarity) AS similarity
FROM l_docs LEFT JOIN l_leaks USING (rid) GROUP BY rid, doc_id"""

def _license_sql() -> str:
    """op1: sentences as rows, identifiers by a join, then one replacement after the other for the rules."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    steps, last = [], "s0"
    for k, (_, seq) in enumerate(RULES):
        pattern = "".join(f"|{i}|" for i in seq)
        steps.append(f"s{k + 1} AS (SELECT rid, doc_id, ids, replace(s, '{pattern}', '|-|') AS s, CASE WHEN contains(s, '{pattern}') THEN list_append(hit, {k}) ELSE hit END AS hit FROM {last})")
        last = f"s{k + 1}"
    names = ", ".join(f"'{name}'" for name, _ in RULES)
    return rf"""
WITH known(sentence, ident) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS cut FROM documents),
parts AS (SELECT rid, unnest(range(1, len(cut) + 1)) AS i, unnest(cut) AS raw FROM docs),
ids AS (
  SELECT p.rid, p.i, CASE WHEN regexp_matches(p.raw, '{ANCHOR}') THEN coalesce(k.ident, '-') ELSE '-' END AS ident
  FROM (SELECT * FROM parts WHERE regexp_matches(raw, '[A-Za-z0-9]') AND NOT regexp_matches(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), '{LABEL}')) p
  LEFT JOIN known k ON trim(regexp_replace(lower(p.raw), '[^a-z0-9]+', ' ', 'g')) = k.sentence
),
s0 AS (
  SELECT d.rid, d.doc_id, coalesce(list(ident ORDER BY i) FILTER (ident <> '-'), []) AS ids,
    coalesce('|' || string_agg(ident, '||' ORDER BY i) || '|', '||') AS s, CAST([] AS INTEGER[]) AS hit
  FROM docs d LEFT JOIN ids USING (rid) GROUP BY d.rid, d.doc_id
),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS identifiers, array_to_string(hit, ',') AS rules,
  coalesce((SELECT string_agg(name, ',' ORDER BY first) FROM (SELECT ([{names}])[k + 1] AS name, min(k) AS first FROM (SELECT unnest(hit) AS k) GROUP BY name)), '') AS licences
FROM {last}"""


OP1 = _license_sql()

#: The shape of op4: turns numbered in order, the last answers swapped, the first turn that differs, and both rests
#: rendered with running lengths.
OP4 = r"""
WITH t AS (SELECT conv_id AS pair, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT pair, count(*) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last, CASE WHEN pair % 2 = 0 THEN pair + 1 ELSE pair - 1 END AS partner FROM t GROUP BY pair),
sides AS (
  SELECT pair, 0 AS side, i, role, text FROM t
  UNION ALL SELECT pair, 1, i, role, text FROM t JOIN convs USING (pair) WHERE last IS NULL OR i < last
  UNION ALL SELECT c.pair, 1, coalesce(c.last, c.n + 1), t.role, t.text FROM convs c JOIN convs p ON p.pair = c.partner JOIN t ON t.pair = p.pair AND t.i = p.last
),
same AS (SELECT a.pair, a.i FROM sides a JOIN sides b ON a.pair = b.pair AND a.i = b.i AND a.side = 0 AND b.side = 1 WHERE a.role = b.role AND a.text = b.text),
shared AS (SELECT c.pair, c.partner, coalesce((SELECT max(i) FROM (SELECT i, row_number() OVER (ORDER BY i) AS k FROM same s WHERE s.pair = c.pair) WHERE i = k), 0) AS shared FROM convs c),
parts AS (
  SELECT s.pair, s.shared, x.side, x.i, x.role,
    '<|' || replace(x.role, '<|', '< |') || '|>' || chr(10) AS head, replace(x.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM shared s JOIN sides x USING (pair)
),
ends AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair, side ORDER BY i) AS upto FROM parts WHERE i > shared)
SELECT s.pair, s.pair AS chosen_id, s.partner AS rejected_id, CAST(s.shared AS BIGINT) AS shared,
  coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM parts p WHERE p.pair = s.pair AND side = 0 AND i <= p.shared), '') AS prompt,
  coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM ends p WHERE p.pair = s.pair AND side = 0), '') AS chosen,
  coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM ends p WHERE p.pair = s.pair AND side = 1), '') AS rejected,
  coalesce((SELECT string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY i) FROM ends p WHERE p.pair = s.pair AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY i) FROM ends p WHERE p.pair = s.pair AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM shared s"""

#: The shape of op12: distinct words, their bytes folded into a crc32 by a table made from its polynomial, gains, weights, ranks.
OP12 = r"""
WITH RECURSIVE crc_steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY byte) AS crc FROM crc_steps WHERE k = 8),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
own AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(w) AS w FROM docs) GROUP BY ALL),
wanted AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
bytes AS (SELECT w, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT) AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM own UNION SELECT w FROM wanted))),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM own JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM wanted JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
),
weights AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM own JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (rid)
),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, (CASE WHEN r <= k THEN r END)::BIGINT AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20"""

#: The shape of op13: each document's five flags, each order's steps by the filters before, sums over documents.
OP13 = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM texts LEFT JOIN known USING (doc_id)
),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL),
letters AS (SELECT chr(65 + k::INT) AS l, (1 << k)::INT AS bit FROM range(5) t(k)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit) JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
steps AS (SELECT filter_order, step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
measured AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | f) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & f > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & f > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & f > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & f > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM measured"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1, "op4_preference_formatting": OP4, "op8_benchmark_decontamination": OP8, "op10_quality_rules": OP10,
    "op12_importance_resampling": OP12, "op13_filter_audit": OP13,
}
