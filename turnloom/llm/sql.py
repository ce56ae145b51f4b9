"""DuckDB SQL for the numbered operators that SQL can express; window and cover tests are by brute force."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words keep their case in other alphabets.
OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[k : k + least(len(w), 13) - 1]) AS size, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS gram
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, k, dw.size AS size, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(after, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
             regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, h.url AS url, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(verdict, length(r.host || r.path)) AS verdict
         FROM h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL)
SELECT h.page_id, h.host, h.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict
            WHEN regexp_matches(translate(coalesce(h.url, ''), '{_UP}', '{_LOW}'), '(^|[./-])spam-farm\.|(^|[./-])(adult|casino|escort|phishing|poker|porn|torrent|viagra|warez|xxx)([./-]|$)|/wp-login\.php($|[?#])') THEN 'block'
            ELSE 'allow' END AS verdict
FROM h LEFT JOIN fits f ON f.page_id = h.page_id AND f.url = h.url
"""

OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, len(regexp_extract_all(text, '<\\*\|im_')) AS marks,
             contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|im_') AS hard FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + CASE WHEN hard THEN marks ELSE 0 END + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, ([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
goal AS (SELECT CAST(sum(source_size) AS HUGEINT) * 150 AS hundredths FROM r),
ordered AS (SELECT r.*, coalesce(sum(2 * source_size) OVER w, 0) AS caps, sum(weight) OVER (ORDER BY source_size / weight, source DESC NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM r WINDOW w AS (ORDER BY source_size / weight, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT caps, rest FROM ordered, goal WHERE CAST(200 AS HUGEINT) * source_size * rest > weight * (hundredths - 100 * caps) ORDER BY caps LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN rest IS NULL THEN 0.0::DOUBLE
             WHEN CAST(200 AS HUGEINT) * source_size * rest <= weight * (hundredths - 100 * caps) THEN source_size * 2.0::DOUBLE
             ELSE weight * CAST(hundredths - 100 * caps AS DOUBLE) / CAST(100 * rest AS DOUBLE) END AS target
      FROM r CROSS JOIN goal LEFT JOIN level ON true),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
             CAST(CAST('0x' || left(sha256('8:' || coalesce(CAST(doc_id AS VARCHAR), '')), 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""

#: Each document's windows of 20 words, but for those whose words also start earlier.
OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, k + o AS p FROM rep, generate_series(0, 19) g(o)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

#: Shapley values here by what each order removes, order for order.
OP11 = r"""
WITH d AS (SELECT coalesce(source, '') AS part, coalesce(doc_id, -9223372036854775808) AS doc, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc) OVER (PARTITION BY t) AS first FROM d),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN doc > first THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN g USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(generate_series(1, 5)) AS step)),
x AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""

OP13 = r"""
WITH e AS (SELECT row_number() OVER () AS key, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT key, id, label, v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT key, id, label, list_transform(v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM ok),
s AS (SELECT a.key AS akey, a.id AS anchor_id, a.label AS alabel, b.key AS bkey, b.id AS id, b.label AS label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
      FROM q a JOIN q b ON a.id % 100 = 0 AND a.key <> b.key),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY akey ORDER BY score DESC, id NULLS LAST, bkey) AS n FROM s WHERE label = alabel) WHERE n <= 5),
h AS (SELECT p.akey, p.anchor_id, p.n, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.akey, p.n ORDER BY s.score DESC, s.id NULLS LAST, s.bkey) AS rank
      FROM p JOIN s ON s.akey = p.akey AND s.label <> p.alabel AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
"""

ORACLE_SQL = {"op3_decontamination": OP3, "op5_url_filter": OP5, "op7_chat_formatting": OP7, "op8_source_mixing": OP8, "op9_minhash_dedup": OP9, "op10_substring_dedup": OP10, "op11_filter_interaction_audit": OP11, "op13_hard_negatives": OP13}
