"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the
operators' code."""

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_W = WORDS.format(t=LOWER.format(t="coalesce(text, '')"))
_TERMS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(t=LOWER.format(t="coalesce(text, '')"))
_H = "('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {k}, 8))::BIGINT"

ORACLE_SQL = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*)::DOUBLE / any_value(item_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(item_shingles) - 1e-9
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN n > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
""",
    "op7_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1/|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op8_urls": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1
""",
    "op9_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most,
  ([3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t FROM s),
rounds AS (SELECT 0 AS k, 0::BIGINT AS n, t / (SELECT sum(weight) FROM s)::DOUBLE AS rate FROM total
  UNION ALL SELECT k + 1, n2, rate2 FROM (SELECT r.k, r.n, r.rate,
    (SELECT count(*) FROM s WHERE most <= weight * r.rate) AS n2,
    CASE WHEN (SELECT sum(weight) FROM s WHERE most > weight * r.rate) IS NULL THEN r.rate ELSE
      ((SELECT t FROM total) - (SELECT coalesce(sum(most), 0) FROM s WHERE most <= weight * r.rate)::DOUBLE) / (SELECT sum(weight) FROM s WHERE most > weight * r.rate)::DOUBLE END AS rate2
    FROM rounds r) WHERE n2 > n),
t AS (SELECT source, source_size, least(most::DOUBLE, weight * (SELECT rate FROM rounds ORDER BY k DESC LIMIT 1)) AS target FROM s),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place)::BIGINT AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, source, size, place, copy, CASE WHEN target > 0 THEN (done + copy * source_size)::DOUBLE / target ELSE 0 END AS finish FROM q, (VALUES (0), (1)) v(copy)),
l AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, encode(coalesce(source, '')), copy, place)::BIGINT AS line FROM c),
k AS (SELECT doc_id, place, sum(size)::BIGINT AS taken FROM l WHERE line <= (SELECT sum(target) FROM t) GROUP BY 1, 2)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.place = k.place
""",
    "op12_fill_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {", ".join(_H.format(k=8 * k + 1) + f" AS h{k + 1}" for k in range(4))} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
    "op13_lexical_search": f"""
WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms)::BIGINT AS own FROM t WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(own)::BIGINT AS all_terms FROM d),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term, docs),
q AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * own * docs) // all_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (r), g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10
""",
}
