"""The same results as SQL over the pre-registered tables, where SQL can express them."""

from __future__ import annotations

import re

from rollcall.llm.licenses import PHRASES, STEP, TEMPLATES

SPACE = r"\x20\x09-\x0D"

#: Rows, words and windows of all documents; rid tells repeated rows apart.
QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws FROM d
), u AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
), win AS (
  SELECT rid, pos,
    word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' '
      || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS run
  FROM u WINDOW p AS (PARTITION BY rid ORDER BY pos)
), twice AS (
  SELECT rid, run FROM win WHERE run IS NOT NULL GROUP BY rid, run HAVING count(*) > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (
    SELECT DISTINCT rid, pos + k AS pos
    FROM win JOIN twice USING (rid, run), (SELECT unnest([0, 1, 2, 3, 4]) AS k) ks
  ) x GROUP BY rid
), body AS (
  SELECT rid, min(md5(run)) AS b FROM win WHERE run IS NOT NULL GROUP BY rid
), counts AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM u GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), spoken AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^{SPACE}]+')) AS n,
    trim(regexp_replace(regexp_replace(
      translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9]+', '0', 'g'), '[{SPACE}]+', ' ', 'g')) AS norm
  FROM lines WHERE regexp_matches(line, '[^{SPACE}]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM spoken GROUP BY rid
), identity AS (
  SELECT d.rid, d.source, coalesce(b, md5(coalesce(array_to_string(ws, ' '), ''))) AS b
  FROM d JOIN w USING (rid) LEFT JOIN body USING (rid)
), hosts AS (
  SELECT source, count(DISTINCT b) AS of_host FROM identity GROUP BY source
), frequent AS (
  SELECT x.source, x.norm FROM (
    SELECT source, norm, count(DISTINCT b) AS n
    FROM spoken JOIN identity USING (rid) GROUP BY source, norm
  ) x JOIN hosts h ON x.source IS NOT DISTINCT FROM h.source
  WHERE x.n >= 5 AND x.n >= 0.01 * h.of_host
), cut AS (
  SELECT s.rid, sum(s.n) AS n FROM spoken s JOIN d USING (rid)
  JOIN frequent f ON f.norm = s.norm AND f.source IS NOT DISTINCT FROM d.source GROUP BY s.rid
), measured AS (
  SELECT d.rid, d.doc_id, d.t,
    coalesce(counts.n_words, 0)::BIGINT AS n_words, coalesce(counts.word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(counts.n_words, 0) - coalesce(cut.n, 0) AS left_words
  FROM d LEFT JOIN counts USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN cut USING (rid)
), verdict AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
"""

OP2 = QUALITY_RULES + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND left_words >= 5 AND left_words >= 0.3 * n_words AS kept
FROM verdict
"""

def near_duplicates(length: int, percent: int) -> str:
    """Every pair of documents that share a shingle, then the smallest id reachable."""
    later = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER p" for k in range(1, length))])
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS ws
  FROM documents
), u AS (
  SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d WHERE len(ws) >= {length}
), s AS (
  SELECT DISTINCT doc_id, run FROM (
    SELECT doc_id, n, pos, {later} AS run FROM u WINDOW p AS (PARTITION BY rid ORDER BY pos)
  ) x WHERE pos <= n - {length - 1}
  UNION
  SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {length - 1}
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM s x JOIN s y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= {percent} * (p.n + q.n - shared.n)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), smallest AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN smallest USING (doc_id)
"""

OP9 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), newest AS (
  SELECT payload_digest, max(page_id) AS page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page IS NULL OR page IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page IS NULL OR page IS NOT DISTINCT FROM page_id THEN NULL ELSE page END::BIGINT AS refers_to
FROM p LEFT JOIN newest USING (payload_digest)
"""


def personal_data(reach: int, share: float, texts: int) -> str:
    """Plain patterns with positions from what stands between matches, and terms by counts of documents."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    starts = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for k, (kind, p) in enumerate(kinds.items())
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), every AS (
  SELECT rid, k, kind, g, m, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM ({found}) f WHERE len(m) > 0
), placed AS (
  SELECT rid, k, kind, v, ({starts})::BIGINT AS a, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM every
), spans AS (
  SELECT rid, k, kind, v, a, a + length(v) AS b FROM placed
  WHERE kind = 'email'
    OR (kind = 'ip' AND list_max(list_transform(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) END)) <= 255)
    OR (kind = 'phone' AND length(digits) BETWEEN 9 AND 15)
    OR (kind = 'card' AND length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
         lambda n: CASE WHEN n % 2 = 1 THEN digits[length(digits) - n + 1]::INTEGER
           ELSE (digits[length(digits) - n + 1]::INTEGER * 2) // 10 + (digits[length(digits) - n + 1]::INTEGER * 2) % 10 END)) % 10 = 0)
), sides AS (
  SELECT rid, kind || ':' || v AS entity, greatest(a - {reach}, 0) AS low, a AS high, a > {reach} AS cut_low, false AS cut_high FROM spans
  UNION ALL
  SELECT rid, kind || ':' || v, b, least(b + {reach}, length(t)), false, b + {reach} < length(t) FROM spans JOIN d USING (rid)
), stretch AS (
  SELECT s.*, substring(t, (low + 1)::BIGINT, (high - low)::BIGINT) AS c FROM sides s JOIN d USING (rid)
), words AS (
  SELECT *, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM (SELECT *, regexp_extract_all(c, '\p{{L}}+') AS m, string_split_regex(c, '\p{{L}}+') AS g FROM stretch) x WHERE len(m) > 0
), near AS (
  SELECT rid, entity, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, a, b FROM (
    SELECT *, (low + {starts})::BIGINT AS a, (low + {starts} + length(w))::BIGINT AS b FROM words
  ) y WHERE NOT (cut_low AND a = low) AND NOT (cut_high AND b = high)
    AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.rid = y.rid AND o.a < y.b AND y.a < o.b)
), joint AS (
  SELECT entity, term, count(*) AS n_et FROM (SELECT DISTINCT rid, entity, term FROM near) x JOIN d USING (rid)
  GROUP BY entity, term HAVING count(DISTINCT t) >= {texts}
), entities AS (
  SELECT kind || ':' || v AS entity, count(DISTINCT rid) AS n_e FROM spans GROUP BY 1
), terms AS (
  SELECT term, count(DISTINCT rid) AS n_t FROM (
    SELECT rid, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{{L}}+')) AS term FROM d
  ) x GROUP BY term
), good AS (
  SELECT entity, term FROM joint JOIN entities USING (entity) JOIN terms USING (term), (SELECT count(*) AS n FROM d) c
  WHERE log2(n / n_e) > 0 AND log2(n_et * n / (n_e * n_t)) >= {share} * log2(n / n_e)
), all_spans AS (
  SELECT rid, k, kind, a, b FROM spans
  UNION ALL
  SELECT DISTINCT rid, 4, 'term', a, b FROM near JOIN good USING (entity, term)
), told AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_term,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a, b) FILTER (kind <> 'term'), '') AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a, b) AS spans
  FROM all_spans GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, coalesce(n_term, 0)::BIGINT AS n_term, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""


def licenses() -> str:
    """Phrases by neighbouring words; every window against every template, without filters."""
    rows = []
    for at, template in enumerate(TEMPLATES):
        words = sorted(set(re.findall(r"[a-z0-9]+", template.text.lower())))
        need = -(-9 * len(words) // 10)
        rows += [f"({at}, '{template.label}', '{word}', {len(words)}, {need})" for word in words]
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), u AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d
), runs AS (
  SELECT rid, pos, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS three,
    word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p AS four
  FROM u WINDOW p AS (PARTITION BY rid ORDER BY pos)
), hits AS (
  SELECT rid, pos, label FROM runs JOIN (VALUES {phrases}) AS v(phrase, label) ON phrase = three OR phrase = four
), base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM hits GROUP BY rid
), template(template, label, word, size, need) AS (
  VALUES {", ".join(rows)}
), held AS (
  SELECT DISTINCT rid, pos // {STEP} - k AS block, word FROM u, (SELECT unnest([0, 1]) AS k) ks
  WHERE pos // {STEP} >= k AND word IN (SELECT word FROM template)
), matched AS (
  SELECT rid, label, count(*) / size AS share FROM held JOIN template USING (word)
  GROUP BY rid, block, template, label, size, need HAVING count(*) >= need
), best AS (
  SELECT rid, max(share) AS share FROM matched GROUP BY rid
), named AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT DISTINCT rid, label FROM (SELECT rid, label FROM matched UNION ALL SELECT rid, label FROM hits) x) y GROUP BY rid
), base_named AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM hits) x GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN best USING (rid) LEFT JOIN named USING (rid) LEFT JOIN base_named USING (rid)
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', doc_id)) AS h,
    list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS sizes
  FROM documents
), drawn AS (
  SELECT *, len(sizes) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), cut AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(list_sum(sizes[1:least(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT AS low, coalesce(list_sum(sizes[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT AS high FROM drawn
), parts AS (
  SELECT *, substring(t, 1, low) AS p, substring(t, low + 1, high - low) AS m, substring(t, high + 1) AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

OP13 = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": OP2,
        "op3_near_duplicates": near_duplicates(3, 85),
        "op4_pii": personal_data(64, 0.8, 2),
        "op5_licenses": licenses(),
        "op9_warc": OP9,
        "op11_fill_in_middle": OP11,
        "op13_hard_negatives": OP13,
    }
