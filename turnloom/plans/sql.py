"""DuckDB SQL for the registered queries of the knowledge base's operators."""

from __future__ import annotations

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+\z', '')"


def _words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> ''))"


def _hash(x: str) -> str:
    return f"left(sha256({x}), 16)"


_TURNS = f"""
turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS seq, role, {_strip('text')} AS text,
                 (CASE role WHEN 'user' THEN '**User:** ' ELSE '**Assistant:** ' END) || {_strip('text')} || chr(10) AS rendered
          FROM conversations WHERE role IN ('user', 'assistant') AND {_strip('text')} <> '')"""

_CONTEXTS = f"""{_TURNS},
short AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4),
whole AS (SELECT session_id, string_agg(rendered, chr(10) ORDER BY seq) AS whole, CAST(count(*) AS INT) AS turn_count FROM short GROUP BY session_id),
cut AS (SELECT *, right(whole, 1500) AS c, strpos(right(whole, 1500), chr(10) || '**') AS b FROM whole),
contexts AS (SELECT session_id, CASE WHEN length(whole) <= 1500 THEN whole WHEN b > 1 THEN substr(c, b + 1) ELSE c END AS context, turn_count, length(whole) > 1500 AS truncated FROM cut)"""

_EVENTS = "events_ AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS source, event_id FROM events)"

_HEAD = "'# Daily Log: ' || strftime(log_date, '%Y-%m-%d') || chr(10) || chr(10) || '## Sessions' || chr(10) || chr(10) || '## Memory Maintenance' || chr(10) || chr(10)"

_LOGS = f"""
firsts AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
bodies AS (SELECT CAST(DATE '2024-01-01' + CAST(conv_id % 30 AS INT) AS DATE) AS log_date,
                  string_agg('### Session (' || lpad(CAST((conv_id % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') || ')' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY conv_id, turn, text) AS body
           FROM firsts GROUP BY 1),
plain AS (SELECT strftime(log_date, '%Y-%m-%d') || '.md' AS file, log_date, {_HEAD} || body AS content FROM bodies),
logs AS (SELECT *, {_hash('content')} AS hash FROM plain),
manifest AS (SELECT file, CASE WHEN day(log_date) % 7 = 1 THEN 'stale' ELSE hash END AS hash, CAST(log_date + INTERVAL 1 DAY AS TIMESTAMP) AS compiled_at,
                    CAST(day(log_date) AS DECIMAL(18,6)) / 100 AS cost_usd FROM logs WHERE day(log_date) % 5 <> 0),
pending AS (SELECT l.* FROM logs l LEFT JOIN manifest m USING (file) WHERE m.file IS NULL OR m.hash IS DISTINCT FROM l.hash)"""


def _key(i: str) -> str:
    return f"(['concepts', 'connections', 'qa'])[CAST(({i}) % 3 + 1 AS BIGINT)] || '/d' || CAST({i} AS VARCHAR)"


def _bullet(when: str, target: str) -> str:
    return f"CASE WHEN {when} THEN '- [[' || {target} || ']]' || chr(10) ELSE '' END"


_ARTICLES = f"""
base AS (SELECT doc_id AS i, text, (SELECT count(*) FROM documents) AS n, 'daily/' || strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INT), '%Y-%m-%d') AS log,
                CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS updated,
                'daily/' || strftime(DATE '2024-01-02' + CAST(doc_id % 30 AS INT), '%Y-%m-%d') || '.md' AS second FROM documents),
articles AS (SELECT i, (['concepts', 'connections', 'qa'])[CAST(i % 3 + 1 AS BIGINT)] AS kind, {_key('i')} || '.md' AS path, {_key('i')} AS key, CASE WHEN i % 6 = 0 THEN [log || '.md', second] ELSE [log || '.md'] END AS sources, updated,
    CASE WHEN i % 4 <> 3 THEN '---' || chr(10) || 'title: "D' || CAST(i AS VARCHAR) || '"' || chr(10) || 'sources: [' || log || '.md]' || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN i % 4 = 1 THEN '## Key Points' || chr(10) || chr(10) || repeat('- A point' || chr(10), CAST((i // 4) % 5 + 2 AS INT)) || chr(10) || '## Details' || chr(10) || chr(10) ELSE '' END
    || coalesce(text, '') || CASE WHEN i % 8 = 1 THEN chr(10) || chr(10) || 'More on D' || CAST(i AS VARCHAR) || '.' ELSE '' END || chr(10) || chr(10) || '## Related Concepts' || chr(10) || chr(10)
    || '- [[' || {_key('(i * 7) % (n // 2)')} || ']]' || chr(10)
    || {_bullet('i % 4 = 0 AND i + 1 < n', _key('i + 1'))} || {_bullet('i % 8 = 1', _key('i - 1'))}
    || {_bullet('i % 11 = 0', "'concepts/missing-' || CAST(i AS VARCHAR)")} || {_bullet('i % 5 = 0', "'index'")} || {_bullet('i % 13 = 0', _key('i'))}
    || {_bullet('i % 17 = 0', _key('(i * 7) % (n // 2)'))} || {_bullet('i % 3 = 0', 'log')}
    || CASE WHEN i % 4 = 1 AND i % 12 <> 1 THEN chr(10) || '## Sources' || chr(10) || chr(10) || '- [[' || log || ']]: all of it' || chr(10) ELSE '' END AS content FROM base),
known AS (SELECT key, content FROM articles UNION ALL VALUES ('index', '# Knowledge Base Index'), ('log', '')),
link_lists AS (SELECT key AS src, path AS src_path, regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1) AS t FROM articles),
links AS (SELECT src, src_path, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS dst FROM link_lists),
mentions AS (SELECT DISTINCT key AS src, unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS dst FROM known),
inbound AS (SELECT a.key, count(m.src) AS inbound FROM articles a LEFT JOIN (SELECT * FROM mentions SEMI JOIN articles ON src = key) m ON m.dst = a.key GROUP BY a.key),
bodies_ AS (SELECT path, key, CASE WHEN starts_with(content, '---') AND strpos(substr(content, 4), '---') > 0 THEN substr(content, 3 + strpos(substr(content, 4), '---') + 3) ELSE content END AS body FROM articles),
word_counts AS (SELECT path, key, CAST({_words('body')} AS INT) AS words FROM bodies_)"""

_BROKEN = "SELECT 'error' AS severity, 'broken_link' AS \"check\", src_path AS file, 'Broken link: [[' || dst || ']] - target does not exist' AS detail, false AS auto_fixable FROM links WHERE NOT starts_with(dst, 'daily/') AND dst NOT IN (SELECT key FROM known)"
_ORPHANS = "SELECT 'warning' AS severity, 'orphan_page' AS \"check\", key || '.md' AS file, 'Orphan page: no other articles link to [[' || key || ']]' AS detail, false AS auto_fixable FROM inbound WHERE inbound = 0"
_NEW = "SELECT 'warning' AS severity, 'orphan_source' AS \"check\", 'daily/' || file AS file, 'Uncompiled daily log: ' || file || ' has not been ingested' AS detail, false AS auto_fixable FROM logs ANTI JOIN manifest USING (file)"
_STALE = "SELECT 'warning' AS severity, 'stale_article' AS \"check\", 'daily/' || l.file AS file, 'Stale: ' || l.file || ' has changed since last compilation' AS detail, false AS auto_fixable FROM logs l JOIN manifest m USING (file) WHERE coalesce(m.hash, '') <> l.hash"
_BACK = "SELECT 'suggestion' AS severity, 'missing_backlink' AS \"check\", src_path AS file, '[[' || src || ']] links to [[' || dst || ']] but not vice versa' AS detail, true AS auto_fixable FROM links l WHERE NOT starts_with(dst, 'daily/') AND dst IN (SELECT key FROM known) AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.src = l.dst AND m.dst = l.src)"
_SPARSE = "SELECT 'suggestion' AS severity, 'sparse_article' AS \"check\", path AS file, 'Sparse article: ' || CAST(words AS VARCHAR) || ' words (minimum recommended: 200)' AS detail, false AS auto_fixable FROM word_counts WHERE words < 200"
_ISSUES = f"{_LOGS}, {_ARTICLES}, issues AS ({' UNION ALL '.join((_BROKEN, _ORPHANS, _NEW, _STALE, _BACK, _SPARSE))})"

_CHECKS = ("broken_link", "orphan_page", "orphan_source", "stale_article", "missing_backlink", "sparse_article", "contradiction")

_RUNS = f"""{_LOGS}, runs AS (SELECT file, hash, TIMESTAMP '2024-02-15 00:00:00' AS compiled_at, CAST(0.25 AS DECIMAL(18,6)) AS cost_usd,
       day(log_date) % 3 = 0 AS failed, 'run-' || CAST(day(log_date) % 2 AS VARCHAR) AS run_id FROM pending)"""

_UNTIL = r"regexp_extract(coalesce(text, '') || chr(10) || '**', '(?s)^(.*?)\n\*\*', 1)"

_RESPONSES = """made AS (SELECT conv_id * 10 + turn AS id, text FROM conversations),
responses AS (SELECT id, CASE id % 5 WHEN 0 THEN 'FLUSH_OK' WHEN 1 THEN 'FLUSH_ERROR: E: x' WHEN 2 THEN text || ' FLUSH_ERROR FLUSH_OK' WHEN 3 THEN ''
    ELSE '**Context:** ' || coalesce(text, '') || chr(10) || chr(10) || '**Key Exchanges:**' || chr(10) || '- first ' || CAST(length(text) AS VARCHAR) || chr(10) || '- second' || chr(10) || chr(10)
         || '**Decisions Made:**' || chr(10) || '- decided ' || CAST(id AS VARCHAR) || chr(10) || chr(10) || '**Lessons Learned:**' || chr(10) || chr(10) || '**Action Items:**' || chr(10) || '- do it' END AS response FROM made)"""

_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 2))"

_RANKED = f"""{_ARTICLES},
docs_t AS (SELECT key, unnest({_TERMS.format(x='content')}) AS term FROM articles),
asked AS (SELECT item_id AS question_id, unnest({_TERMS.format(x='text')}) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM docs_t WHERE term IN (SELECT term FROM asked) GROUP BY term),
total AS (SELECT count(*) AS total FROM articles),
weights AS (SELECT term, (1000 * (total - df)) // total AS weight FROM dfs, total),
scores AS (SELECT question_id, key, CAST(sum(weight) AS BIGINT) AS score, count(*) AS n FROM docs_t JOIN weights USING (term) JOIN asked USING (term) GROUP BY ALL HAVING count(*) >= 3),
top AS (SELECT question_id, key, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INT) AS rank FROM scores QUALIFY rank <= 10),
ranked AS (SELECT item_id AS question_id, key, score, rank FROM benchmark LEFT JOIN top ON item_id = question_id)"""

_PACKS = f"""{_RANKED}, whole_parts AS (SELECT question_id, rank, '## ' || path || chr(10) || chr(10) || content AS p FROM ranked JOIN articles USING (key)),
parts AS (SELECT question_id, rank, CASE WHEN rank = 1 AND length(p) > 20000 THEN left(p, 20000) || chr(10) || chr(10) || '...(truncated)' ELSE p END AS part FROM whole_parts),
used AS (SELECT *, sum(length(part)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM parts),
packed AS (SELECT question_id, count(*) AS n_articles, CAST(max(used) AS BIGINT) AS n_chars, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS pack FROM used WHERE used <= 20000 OR rank = 1 GROUP BY question_id),
packs AS (SELECT item_id AS question_id, text AS question, coalesce(pack, '') AS pack, coalesce(n_articles, 0) AS n_articles, coalesce(n_chars, 0) AS n_chars FROM benchmark LEFT JOIN packed ON item_id = question_id)"""


def _last_lines(x: str, n: int) -> str:
    lines = rf"regexp_split_to_array(regexp_replace({x}, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r')"
    return f"array_to_string(list_slice({lines}, greatest(len({lines}) - {n - 1}, 1), len({lines})), chr(10))"


_INJECT = f"""{_LOGS}, starts AS (SELECT log_date AS d FROM logs), held AS (SELECT * FROM logs WHERE day(log_date) % 7 NOT IN (0, 1)),
recent AS (SELECT d, coalesce(t.file, y.file) AS file, coalesce({_last_lines('coalesce(t.content, y.content)', 30)}, '(no recent daily log)') AS recent
           FROM starts LEFT JOIN held t ON t.log_date = d LEFT JOIN held y ON y.log_date = d - 1),
joined AS (SELECT d, '## Today' || chr(10) || strftime(d, '%A, %B %d, %Y') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Knowledge Base Index' || chr(10) || chr(10) || '# Knowledge Base Index'
           || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Recent Daily Log' || chr(10) || chr(10) || recent AS c FROM recent),
injected AS (SELECT d, CASE WHEN length(c) > 2000 THEN left(c, 2000) || chr(10) || chr(10) || '...(truncated)' ELSE c END AS context FROM joined)"""

_DEDUP = f"""WITH RECURSIVE {_EVENTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k FROM events_),
fold AS (SELECT session_id, ts, source, event_id, k, ts AS last, true AS keep FROM numbered WHERE k = 1
         UNION ALL SELECT n.session_id, n.ts, n.source, n.event_id, n.k, CASE WHEN n.ts - f.last < INTERVAL 60 SECOND THEN f.last ELSE n.ts END, NOT (n.ts - f.last < INTERVAL 60 SECOND)
         FROM fold f JOIN numbered n ON n.session_id = f.session_id AND n.k = f.k + 1)
SELECT session_id, ts, event_id, source FROM fold WHERE keep"""

_SINGLE = f"""WITH RECURSIVE {_EVENTS},
o AS (SELECT *, CASE WHEN lag(session_id) OVER w = session_id AND ts - lag(ts) OVER w < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS s FROM events_ WINDOW w AS (ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS k FROM r),
fold AS (SELECT run, session_id, ts, source, event_id, k, ts AS last, true AS keep FROM numbered WHERE k = 1
         UNION ALL SELECT n.run, n.session_id, n.ts, n.source, n.event_id, n.k, CASE WHEN n.ts - f.last < INTERVAL 60 SECOND THEN f.last ELSE n.ts END, NOT (n.ts - f.last < INTERVAL 60 SECOND)
         FROM fold f JOIN numbered n ON n.run = f.run AND n.k = f.k + 1)
SELECT session_id, ts, event_id, source FROM fold WHERE keep"""

_ENTRY = "'### ' || source || ' (' || strftime(ts, '%H:%M') || ')' || chr(10) || chr(10) || 'event ' || CAST(event_id AS VARCHAR) || chr(10) || chr(10)"

_PARSED = f"""WITH c AS (SELECT *, (conv_id + turn) % 4 AS shape FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS seq, role,
       (CASE role WHEN 'user' THEN '**User:** ' ELSE '**Assistant:** ' END) || {_strip('''(CASE WHEN shape = 1 THEN CASE WHEN trim(text) = '' THEN '' ELSE text || chr(10) END || '[Tool: Read] ' || @input ELSE text END)''')} || chr(10) AS rendered
FROM c WHERE shape <> 3 AND role IN ('user', 'assistant') AND (shape = 1 OR {_strip('text')} <> '')"""

_INDEX = "index_ AS (SELECT i, key, 'Article ' || CAST(i AS VARCHAR) AS summary, array_to_string(sources, ', ') AS sources, updated FROM articles)"

_SLUG = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_strip("lower(coalesce(text, ''))")}, '[^\p{{L}}\p{{N}}_{_WS[1:-1]}-]', '', 'g'), '[{_WS[1:-1]}_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+\z', '', 'g')"""


def _reply(p: str) -> str:
    return f"CASE WHEN length({p}) % 3 = 0 THEN 'FLUSH_ERROR: ValueError: length ' || CAST(length({p}) AS VARCHAR) ELSE CAST(length({p}) AS VARCHAR) || ':' || md5({p}) END"


_EXTRACT = "'Review this conversation and answer with the sections Context, Key Exchanges, Decisions Made, Lessons Learned and Action Items, or with FLUSH_OK if nothing is worth keeping.' || chr(10) || chr(10)"

_PROMPTS = f"{_CONTEXTS}, prompts AS (SELECT session_id, {_EXTRACT} || context AS p FROM contexts)"

_COMPILED = f"""{_LOGS}, asked_logs AS (SELECT file, hash, 'Compile this daily log into concept and connection articles.' || chr(10) || chr(10) || 'Log ' || file || ':' || chr(10) || chr(10) || content || chr(10) || chr(10) || 'Existing articles:' || chr(10) || chr(10) || '(none)' AS p FROM pending),
compiled AS (SELECT file, hash, p, CAST(CASE WHEN length(p) % 4 < 2 THEN 0 ELSE 0.25 END AS DECIMAL(18,6)) AS cost_usd, CASE WHEN length(p) % 4 < 2 THEN 0 ELSE 1 END AS n_articles,
             CASE length(p) % 4 WHEN 0 THEN 'ValueError: length ' || CAST(length(p) AS VARCHAR) WHEN 1 THEN 'ValueError: no articles in the answer' END AS error FROM asked_logs)"""

_ANSWERS = f"""{_PACKS}, asked_q AS (SELECT question_id, 'Answer from these articles and cite them.' || chr(10) || chr(10) || CASE WHEN pack = '' THEN '(none)' ELSE pack END || chr(10) || chr(10) || 'Question: ' || question AS p FROM packs),
answers AS (SELECT question_id, CASE WHEN length(p) % 3 = 0 THEN 'Error querying knowledge base: length ' || CAST(length(p) AS VARCHAR) ELSE CAST(length(p) AS VARCHAR) || ':' || md5(p) END AS answer,
            CASE WHEN length(p) % 3 = 0 THEN 'ValueError: length ' || CAST(length(p) AS VARCHAR) END AS error FROM asked_q)"""

_CLASSES = """classes AS (SELECT key, list_sort(sources) AS logs, CAST(to_json(list_sort(sources)) AS VARCHAR) AS class FROM articles),
cited AS (SELECT DISTINCT class, unnest(logs) AS source FROM classes),
class_pairs AS (SELECT x.class AS "left", y.class AS "right", count(*) AS shared FROM cited x JOIN cited y ON x.source = y.source AND x.class <= y.class GROUP BY ALL)"""

#: Blocks of half of 100,000 characters, a log's articles put in one after the other; two blocks are a pack.
_REVIEW = """texts AS (SELECT key, '## ' || path || chr(10) || chr(10) || content AS t, list_sort(list_distinct(sources)) AS logs FROM articles),
cited AS (SELECT source, key, length(t) AS size, logs, row_number() OVER (PARTITION BY source ORDER BY class, key) AS place FROM (SELECT key, t, logs, CAST(to_json(logs) AS VARCHAR) AS class, unnest(logs) AS source FROM texts)),
cut AS (SELECT source, place, key, logs, 1 AS block, size AS used FROM cited WHERE place = 1
        UNION ALL SELECT c.source, c.place, c.key, c.logs, CASE WHEN used + c.size > 50000 THEN block + 1 ELSE block END, CASE WHEN used + c.size > 50000 THEN c.size ELSE used + c.size END FROM cut JOIN cited c ON c.source = cut.source AND c.place = cut.place + 1),
last AS (SELECT source, max(block) AS n FROM cut GROUP BY source),
pairs AS (SELECT source, n, p, q FROM last, LATERAL (SELECT unnest(generate_series(1, n)) AS p), LATERAL (SELECT unnest(generate_series(1, n)) AS q) WHERE p < q OR n = 1),
members AS (SELECT DISTINCT pairs.source, p, q, key, logs FROM pairs JOIN cut ON cut.source = pairs.source AND block IN (p, q)),
sizes AS (SELECT source, p, q, count(*) AS n FROM members GROUP BY ALL),
shared AS (SELECT m.source, m.p, m.q, log FROM (SELECT source, p, q, unnest(logs) AS log FROM members) m JOIN sizes s USING (source, p, q) GROUP BY m.source, m.p, m.q, log, s.n HAVING count(*) = s.n),
fresh AS (SELECT source, p, q FROM shared JOIN sizes USING (source, p, q) WHERE n > 1 GROUP BY source, p, q HAVING min(log) >= source),
packs AS (SELECT source, p, q, list(key ORDER BY key) AS keys FROM members SEMI JOIN fresh USING (source, p, q) GROUP BY ALL),
prompts AS (SELECT 'Review these articles. Name contradictions between any two of them, a line CONTRADICTION: or INCONSISTENCY: for each, or say NO_ISSUES.' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY key) AS p
            FROM (SELECT source, p, q, unnest(keys) AS key FROM packs) JOIN texts USING (key) GROUP BY source, p, q)"""

_REVIEWED = """SELECT CASE length(p) % 4 WHEN 0 THEN 'error' ELSE 'warning' END AS severity, 'contradiction' AS "check", CASE length(p) % 4 WHEN 0 THEN '(system)' ELSE '(cross-article)' END AS file,
       CASE length(p) % 4 WHEN 0 THEN 'LLM check failed: length ' || CAST(length(p) AS VARCHAR) WHEN 2 THEN 'CONTRADICTION: a vs b - ' || CAST(length(p) AS VARCHAR) ELSE 'INCONSISTENCY: ' || md5(p) END AS detail, false AS auto_fixable
FROM prompts WHERE length(p) % 4 <> 1"""

_ACTIVITY = """activity AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS ts, 'compile' AS op, replace(sources[1], 'daily/', '') AS subject, coalesce(string_agg(key, ',' ORDER BY key) FILTER (i % 2 = 1), '') AS created,
    coalesce(string_agg(key, ',' ORDER BY key) FILTER (i % 2 = 0), '') AS updated, '' AS consulted FROM articles WHERE i % 3 = 0 GROUP BY sources[1])"""

_FILED = f"""consulted_ AS (SELECT question_id, string_agg(key, ',' ORDER BY key) AS consulted, count(*) AS n FROM top GROUP BY question_id),
filed AS (SELECT question_id, text AS question, 'qa/' || {_SLUG} AS key, consulted, '---' || chr(10) || 'title: "Q: ' || text || '"' || chr(10) || '---' || chr(10) || chr(10) || 'Found ' || CAST(n AS VARCHAR) AS content
          FROM (SELECT item_id AS question_id, text FROM benchmark) JOIN consulted_ USING (question_id))"""


def _linked(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' ELSE '[[' || replace({x}, ',', ']], [[') || ']]' END"


def _section(name: str) -> str:
    return f"regexp_extract(chr(10) || content || chr(10) || '## ', '(?s)\\n## {name}[ \\t]*\\n(.*?)\\n## ', 1)"


def _bullets(name: str) -> str:
    return f"len(regexp_extract_all(chr(10) || {_section(name)}, '\\n[-*] '))"

_PICK = "list_distinct(list_filter(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1), lambda t: t <> key AND NOT starts_with(t, 'daily/')))"

ORACLE_SQL: dict[str, str] = {
    "turns_rendered": f"WITH {_TURNS} SELECT session_id, seq, role, rendered FROM turns",
    "turn_counts": f"WITH {_TURNS} SELECT session_id, CAST(least(count(*), 30) AS INT) AS turn_count, count(*) >= 1 AS session_end, count(*) >= 5 AS pre_compact, count(*) >= 2 AS backfill FROM turns GROUP BY session_id",
    "last_n_turns": f"WITH {_TURNS} SELECT session_id, seq, rendered FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4",
    "session_contexts": f"WITH {_CONTEXTS} SELECT session_id, context, turn_count, CAST(length(context) AS INT) AS n_chars, truncated, CASE WHEN {_strip('context')} = '' THEN 'empty' WHEN turn_count < 2 THEN 'too_few_turns' END AS skip_reason FROM contexts",
    "transcript_parse": _PARSED.replace("@input", "'{\"n\":' || CAST(turn AS VARCHAR) || '}'"),
    "transcript_parse_spaced": _PARSED.replace("@input", "'{\"n\": ' || CAST(turn AS VARCHAR) || '}'"),
    "subagent_turns": f"""WITH {_TURNS}, c AS (SELECT CAST(session_id AS BIGINT) AS id, seq, rendered FROM turns),
u AS (SELECT id, 0 AS later, '' AS subagent, seq, rendered FROM c WHERE id % 2 = 0
      UNION ALL SELECT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), seq, rendered FROM c WHERE id % 2 = 1
      UNION ALL SELECT DISTINCT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), -1, '**[Subagent: agent-' || CAST(id AS VARCHAR) || ']**' || chr(10) FROM c WHERE id % 2 = 1)
SELECT CAST(id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY id ORDER BY later, subagent, seq) - 1 AS INT) AS seq, subagent, rendered FROM u""",
    "flush_dedup": _DEDUP,
    "flush_dedup_single_slot": _SINGLE,
    "stream_flush_dedup": _DEDUP,
    "flush_route": f"WITH {_RESPONSES} SELECT id, response, CASE WHEN contains(response, 'FLUSH_ERROR') THEN 'Memory Flush' ELSE 'Session' END AS section FROM responses WHERE NOT contains(response, 'FLUSH_OK')",
    "log_sections": f"""WITH {_RESPONSES}, l AS (SELECT id, text FROM made JOIN responses USING (id) WHERE id % 5 = 4 AND NOT contains(response, 'FLUSH_OK'))
SELECT id, 'Context' AS section, 0 AS item_no, {_strip(_UNTIL)} AS text FROM l WHERE {_strip(_UNTIL)} <> ''
UNION ALL SELECT id, 'Key Exchanges', 0, 'first ' || CAST(length(text) AS VARCHAR) FROM l UNION ALL SELECT id, 'Key Exchanges', 1, 'second' FROM l
UNION ALL SELECT id, 'Decisions Made', 0, 'decided ' || CAST(id AS VARCHAR) FROM l UNION ALL SELECT id, 'Action Items', 0, 'do it' FROM l""",
    "daily_log_render": f"""WITH {_EVENTS}, b AS (SELECT CAST(ts AS DATE) AS log_date, string_agg({_ENTRY}, '' ORDER BY ts, source, 'event ' || CAST(event_id AS VARCHAR)) AS body FROM events_ GROUP BY 1),
t AS (SELECT strftime(log_date, '%Y-%m-%d') || '.md' AS file, log_date, {_HEAD} || body AS content FROM b) SELECT file, CAST(log_date AS VARCHAR) AS log_date, content, {_hash('content')} AS hash FROM t""",
    "stream_daily_append": f"WITH {_EVENTS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS log_date, ts, source AS section, 'event ' || CAST(event_id AS VARCHAR) AS content FROM events_",
    "end_of_day_trigger": f"""WITH {_LOGS}, late AS (SELECT DISTINCT CAST(ts AS DATE) AS log_date FROM events WHERE hour(ts) >= 18),
j AS (SELECT late.log_date, strftime(late.log_date, '%Y-%m-%d') || '.md' AS file FROM late)
SELECT CAST(j.log_date AS VARCHAR) AS log_date, j.file, CASE WHEN m.file IS NULL THEN 'not_compiled' ELSE 'changed' END AS reason FROM j LEFT JOIN logs l USING (file) LEFT JOIN manifest m USING (file) WHERE m.file IS NULL OR l.hash IS DISTINCT FROM m.hash""",
    "compile_pending": f"WITH {_LOGS} SELECT file, hash FROM pending",
    "incremental_run": f"WITH {_LOGS} SELECT file, hash FROM pending",
    "manifest_upsert": f"WITH {_RUNS}, e AS (SELECT * FROM manifest UNION ALL SELECT file, hash, compiled_at, cost_usd FROM runs WHERE NOT failed) SELECT file, hash, compiled_at, CAST(cost_usd AS DECIMAL(18,6)) AS cost_usd FROM e QUALIFY row_number() OVER (PARTITION BY file ORDER BY compiled_at DESC, hash DESC) = 1",
    "cost_rollup": f"WITH {_RUNS} SELECT run_id, CAST(sum(cost_usd) AS DECIMAL(28,6)) AS cost_usd, count(*) AS n FROM runs WHERE NOT failed GROUP BY ROLLUP (run_id)",
    "orphan_sources": f"WITH {_LOGS} {_NEW}",
    "stale_sources": f"WITH {_LOGS} {_STALE}",
    "wikilinks": f"WITH {_ARTICLES} SELECT src, CAST(pos AS INT) AS pos, dst FROM links",
    "inbound_counts": f"WITH {_ARTICLES} SELECT key, inbound FROM inbound",
    "broken_links": f"WITH {_ARTICLES} {_BROKEN}",
    "orphan_pages": f"WITH {_ARTICLES} {_ORPHANS}",
    "missing_backlinks": f"WITH {_ARTICLES} {_BACK}",
    "sparse_articles": f"WITH {_ARTICLES} {_SPARSE}",
    "word_counts": f"WITH {_ARTICLES} SELECT key, words FROM word_counts",
    "lint_all": f"WITH {_ISSUES} SELECT * FROM issues",
    "lint_summary": f"WITH {_ISSUES} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'suggestion') AS suggestions, count(*) AS total, count(*) FILTER (severity = 'error') = 0 AS healthy FROM issues",
    "lint_by_check": f"WITH {_ISSUES}, names AS (SELECT unnest([{', '.join(repr(c) for c in _CHECKS)}]) AS \"check\") SELECT names.\"check\" AS \"check\", count(issues.file) AS n FROM names LEFT JOIN issues ON issues.\"check\" = names.\"check\" GROUP BY 1",
    "lint_report": f"""WITH {_ISSUES},
counted AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'suggestion') AS s, count(*) AS t FROM issues),
r AS (SELECT *, CAST(list_position(['error', 'warning', 'suggestion'], severity) AS INT) AS sr, CAST(list_position([{', '.join(repr(c) for c in _CHECKS)}], "check") AS INT) AS cr FROM issues)
SELECT 0 AS part, CAST(k AS INT) AS severity_rank, 0 AS check_rank, '' AS file, '' AS detail, line FROM counted, LATERAL (SELECT unnest(generate_series(0, 6)) AS k, unnest(['# Lint Report - 2024-01-31', '', '**Total issues:** ' || t, '- Errors: ' || e, '- Warnings: ' || w, '- Suggestions: ' || s, '']) AS line)
UNION ALL SELECT 1, sr, cr, file, detail, '- **[' || (['x', '!', '?'])[sr] || ']** `' || file || '` - ' || detail || CASE WHEN auto_fixable THEN ' (auto-fixable)' ELSE '' END FROM r
UNION ALL SELECT DISTINCT 1, sr, 0, '', '', '## ' || upper(left(severity, 1)) || substr(severity, 2) || 's' FROM r
UNION ALL SELECT DISTINCT 1, sr, 0, '', ' ', '' FROM r UNION ALL SELECT DISTINCT 1, sr, 8, '', '', '' FROM r
UNION ALL SELECT 1, 0, k, '', '', line FROM counted, (VALUES (0, 'All checks passed. Knowledge base is healthy.'), (1, '')) v(k, line) WHERE t = 0""",
    "contradiction_parse": """WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS k FROM conversations)
SELECT 'warning' AS severity, 'contradiction' AS "check", '(cross-article)' AS file, CASE k WHEN 1 THEN 'CONTRADICTION: a vs b - ' || CAST(conv_id AS VARCHAR) ELSE 'INCONSISTENCY: ' || CAST(turn AS VARCHAR) END AS detail, false AS auto_fixable FROM c WHERE k IN (1, 2)""",
    "quality_checks": f"""WITH {_ARTICLES},
f AS (SELECT path, regexp_matches(content, '^---\\n') AND regexp_matches(regexp_extract(content, '(?s)\\A---\\n(.*?)\\n---', 1), '(?m)^sources:') AS front, len({_PICK}) AS targets,
             {_bullets('Key Points')} AS points, len(list_filter(regexp_split_to_array({_section('Details')}, '\\n\\s*\\n'), lambda p: {_strip('p')} <> '')) AS details,
             {_bullets('Related Concepts')} AS related, contains({_section('Sources')}, 'daily/') AS cited FROM articles),
rule AS (SELECT path, unnest(list_filter([CASE WHEN NOT front THEN 'frontmatter' END, CASE WHEN targets < 2 THEN 'few_links' END, CASE WHEN points NOT BETWEEN 3 AND 5 THEN 'key_points' END,
                CASE WHEN details < 2 THEN 'details' END, CASE WHEN related < 2 THEN 'related' END, CASE WHEN NOT cited THEN 'sources' END], lambda x: x IS NOT NULL)) AS rule FROM f)
SELECT 'suggestion' AS severity, 'quality_' || rule AS "check", path AS file, 'Article breaks rule: ' || rule AS detail, false AS auto_fixable FROM rule
UNION ALL SELECT 'suggestion', 'quality_concepts_per_log', source, 'Log has ' || CAST(count(*) AS VARCHAR) || ' concepts, not 3 to 7', false FROM (SELECT unnest(sources) AS source FROM articles WHERE kind = 'concepts') GROUP BY source HAVING count(*) NOT BETWEEN 3 AND 7""",
    "slugs": f"SELECT doc_id, {_SLUG} AS slug FROM documents",
    "content_hashes": f"WITH {_ARTICLES} SELECT key, {_hash('content')} AS hash FROM articles",
    "article_keys": f"WITH {_ARTICLES} SELECT path, key, split_part(key, '/', 1) || '/a.' || split_part(key, '/', 2) AS odd_key, CAST(list_position(['concepts', 'connections', 'qa'], kind) AS INT) AS kind_rank FROM articles",
    "index_rows": f"WITH {_ARTICLES}, {_INDEX} SELECT key, '| [[' || key || ']] | ' || summary || ' | ' || sources || ' | ' || CAST(updated AS VARCHAR) || ' |' AS line FROM index_",
    "index_parse": f"WITH {_ARTICLES}, {_INDEX} SELECT key, summary, sources, CAST(updated AS VARCHAR) AS updated FROM index_",
    "index_upsert": f"WITH {_ARTICLES}, {_INDEX} SELECT key, CASE WHEN i % 3 = 0 THEN 'New ' || summary ELSE summary END AS summary, sources, CAST(CASE WHEN i % 3 = 0 THEN updated + 40 ELSE updated END AS VARCHAR) AS updated FROM index_ WHERE i % 2 = 0 OR i % 3 = 0",
    "activity_log": f"WITH {_ARTICLES}, {_ACTIVITY} SELECT * FROM activity",
    "activity_entries": f"""WITH {_RANKED}, {_ACTIVITY}, {_FILED}
SELECT subject, '## [2024-01-31T00:00:00Z] compile | ' || subject || chr(10) || '- Source: daily/' || subject || chr(10) || '- Articles created: ' || {_linked('created')} || chr(10)
       || CASE WHEN updated <> '' THEN '- Articles updated: ' || {_linked('updated')} || chr(10) ELSE '' END AS entry FROM activity
UNION ALL SELECT question, '## [2024-01-31T00:00:00Z] query (filed) | ' || question || chr(10) || '- Question: ' || question || chr(10) || '- Consulted: ' || {_linked('consulted')} || chr(10) || '- Filed to: [[' || key || ']]' || chr(10) FROM filed""",
    "source_classes": f"WITH {_ARTICLES}, {_CLASSES} SELECT key, class FROM classes",
    "shared_source_pairs": f"WITH {_ARTICLES}, {_CLASSES} SELECT * FROM class_pairs",
    "kb_size": f"WITH {_ARTICLES} SELECT kind, count(*) AS n FROM articles GROUP BY kind",
    "kb_text": f"WITH {_ARTICLES} SELECT CAST(list_position(['concepts', 'connections', 'qa'], kind) AS INT) AS kind, path, md5('## ' || path || chr(10) || chr(10) || content) AS text_md5 FROM articles UNION ALL SELECT 0, '', md5('## INDEX' || chr(10) || chr(10) || '# Knowledge Base Index')",
    "retrieve_topk": f"WITH {_RANKED} SELECT question_id, key, coalesce(score, 0) AS score, coalesce(rank, 0) AS rank FROM ranked",
    "context_pack": f"WITH {_PACKS} SELECT question_id, n_articles, n_chars, md5(pack) AS pack_md5 FROM packs",
    "qa_file_back": f"WITH {_RANKED}, {_FILED} SELECT question_id, key, consulted, md5(content) AS content_md5, '2024-01-31' AS updated FROM filed",
    "recent_log": f"WITH {_INJECT} SELECT CAST(d AS VARCHAR) AS d, file, recent FROM recent",
    "inject_context": f"WITH {_INJECT} SELECT CAST(d AS VARCHAR) AS d, context FROM injected",
    "inject_payload": f"WITH {_INJECT} SELECT CAST(d AS VARCHAR) AS d, 'SessionStart' AS event, md5(context) AS context_md5 FROM injected",
    "date_renderings": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, strftime(ts, '%A, %B %d, %Y') AS long, strftime(ts, '%Y%m%d-%H%M%S') AS compact, hour(ts) >= 18 AS late FROM events",
    "hook_payload_repair": "SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN turn % 3 = 0 THEN role ELSE 'unknown' END AS source, 'C:' || chr(92) || 'Users' || chr(92) || 't' || CAST(conv_id AS VARCHAR) || chr(92) || CAST(turn AS VARCHAR) AS transcript_path FROM conversations WHERE turn % 3 <> 2",
    "model_extract": f"WITH {_PROMPTS}, r AS (SELECT session_id, {_reply('p')} AS response FROM prompts) SELECT session_id, CASE WHEN contains(response, 'FLUSH_ERROR') THEN 'Memory Flush' ELSE 'Session' END AS section, response FROM r WHERE NOT contains(response, 'FLUSH_OK')",
    "model_error_rows": f"WITH {_PROMPTS} SELECT 'error' AS severity, 'contradiction' AS \"check\", '(system)' AS file, 'LLM check failed: length ' || CAST(length(p) AS VARCHAR) AS detail, false AS auto_fixable FROM prompts WHERE length(p) % 3 = 0",
    "compile_run": f"WITH {_COMPILED} SELECT file, hash, cost_usd, n_articles, error FROM compiled",
    "compile_articles": f"""WITH {_COMPILED}, ok AS (SELECT *, 'concepts/n' || CAST(length(p) % 5 AS VARCHAR) AS key FROM compiled WHERE error IS NULL)
SELECT 'concepts' AS kind, key || '.md' AS path, key, 'Length ' || CAST(max_by(length(p), file) AS VARCHAR) AS summary, md5(max_by(p, file)) AS content, string_agg('daily/' || file, ',' ORDER BY file) AS sources, '2024-02-15' AS updated FROM ok GROUP BY key""",
    "compile_manifest": f"""WITH {_COMPILED}, e AS (SELECT * FROM manifest UNION ALL SELECT file, hash, TIMESTAMP '2024-02-15 00:00:00', cost_usd FROM compiled WHERE error IS NULL)
SELECT file, hash, compiled_at, CAST(cost_usd AS DECIMAL(18,6)) AS cost_usd FROM e QUALIFY row_number() OVER (PARTITION BY file ORDER BY compiled_at DESC, hash DESC) = 1""",
    "model_answers": f"WITH {_ANSWERS} SELECT question_id, answer, error FROM answers",
    "query_count": f"WITH {_ANSWERS} SELECT count(*) AS query_count, count(error) AS failed FROM answers",
    "review_packs": f"WITH RECURSIVE {_ARTICLES}, {_REVIEW} SELECT source, array_to_string(keys, ',') AS keys FROM packs",
    "contradiction_check": f"WITH RECURSIVE {_ARTICLES}, {_REVIEW} {_REVIEWED}",
    "lint_with_review": f"WITH RECURSIVE {_ISSUES}, {_REVIEW} SELECT * FROM issues UNION ALL ({_REVIEWED})",
    "backfill_sessions": f"""WITH {_TURNS}, c AS (SELECT CAST(session_id AS BIGINT) AS id, seq, rendered FROM turns),
u AS (SELECT id, 0 AS later, '' AS subagent, seq, rendered FROM c WHERE id % 2 = 0
      UNION ALL SELECT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), seq, rendered FROM c WHERE id % 2 = 1
      UNION ALL SELECT DISTINCT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), -1, '**[Subagent: agent-' || CAST(id AS VARCHAR) || ']**' || chr(10) FROM c WHERE id % 2 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY later, subagent, seq) AS k, count(*) OVER (PARTITION BY id) AS n FROM u),
w AS (SELECT id, string_agg(rendered, chr(10) ORDER BY k) AS whole, CAST(count(*) AS INT) AS turn_count FROM o WHERE k > n - 30 GROUP BY id),
x AS (SELECT *, right(whole, 15000) AS cut, strpos(right(whole, 15000), chr(10) || '**') AS b FROM w),
y AS (SELECT id, turn_count, CASE WHEN length(whole) <= 15000 THEN whole WHEN b > 1 THEN substr(cut, b + 1) ELSE cut END AS context FROM x),
p AS (SELECT *, CASE WHEN {_strip('context')} = '' THEN 'empty' WHEN turn_count < 2 THEN 'too_few_turns' END AS skip_reason, {_EXTRACT} || context AS p FROM y WHERE CAST(id AS VARCHAR) IN (SELECT session_id FROM turns)),
r AS (SELECT *, CASE WHEN skip_reason IS NULL THEN {_reply('p')} END AS response FROM p)
SELECT CAST(id AS VARCHAR) AS session_id, CAST(DATE '2024-01-01' + CAST(id % 30 AS INT) AS TIMESTAMP) AS ts, turn_count, skip_reason,
       CASE WHEN contains(response, 'FLUSH_ERROR') THEN 'Memory Flush' WHEN response IS NOT NULL THEN 'Session' END AS section, response FROM r""",
    "transcript_scan": f"""WITH parsed AS ({_PARSED.replace("@input", "'{\"n\":' || CAST(turn AS VARCHAR) || '}'")}), c AS (SELECT CAST(session_id AS BIGINT) AS id, seq, rendered FROM parsed),
u AS (SELECT id, 0 AS later, '' AS subagent, seq, rendered FROM c WHERE id % 2 = 0
      UNION ALL SELECT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), seq, rendered FROM c WHERE id % 2 = 1
      UNION ALL SELECT DISTINCT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), -1, '**[Subagent: agent-' || CAST(id AS VARCHAR) || ']**' || chr(10) FROM c WHERE id % 2 = 1)
SELECT CAST(id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY id ORDER BY later, subagent, seq) - 1 AS INT) AS seq, subagent, rendered FROM u""",
    "capture_contexts": f"""WITH parsed AS ({_PARSED.replace("@input", "'{\"n\":' || CAST(turn AS VARCHAR) || '}'")}), c AS (SELECT CAST(session_id AS BIGINT) AS id, seq, rendered FROM parsed),
u AS (SELECT id, 0 AS later, '' AS subagent, seq, rendered FROM c WHERE id % 2 = 0
      UNION ALL SELECT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), seq, rendered FROM c WHERE id % 2 = 1
      UNION ALL SELECT DISTINCT id - 1, 1, 'agent-' || CAST(id AS VARCHAR), -1, '**[Subagent: agent-' || CAST(id AS VARCHAR) || ']**' || chr(10) FROM c WHERE id % 2 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY later, subagent, seq) AS k, count(*) OVER (PARTITION BY id) AS n FROM u),
w AS (SELECT id, string_agg(rendered, chr(10) ORDER BY k) AS whole, CAST(count(*) AS INT) AS turn_count FROM o WHERE k > n - 30 GROUP BY id),
x AS (SELECT *, right(whole, 15000) AS cut, strpos(right(whole, 15000), chr(10) || '**') AS b FROM w),
y AS (SELECT id, turn_count, length(whole) > 15000 AS truncated, CASE WHEN length(whole) <= 15000 THEN whole WHEN b > 1 THEN substr(cut, b + 1) ELSE cut END AS context FROM x)
SELECT CAST(id AS VARCHAR) AS session_id, 'end-' || CAST(id % 3 AS VARCHAR) AS source, turn_count, truncated, md5(context) AS context_md5
FROM y WHERE id % 10 <> 8 AND id IN (SELECT conv_id FROM conversations WHERE turn < 2 AND (turn = 0 OR conv_id % 4 = 0)) AND {_strip('context')} <> ''""",
    "session_listing": "SELECT 'session-' || CAST(conv_id AS VARCHAR) AS session_id, 'session-' AS short_id, count(*) + 1 AS size FROM conversations GROUP BY conv_id",
    "latest_source": "SELECT max_by('dir-' || CAST(conv_id % 7 AS VARCHAR), CAST(conv_id % 30 AS VARCHAR).lpad(2, '0') || 'dir-' || CAST(conv_id % 7 AS VARCHAR)) AS dir FROM conversations",
    "daily_log_scan": f"WITH {_LOGS} SELECT file, CAST(log_date AS VARCHAR) AS log_date, {_hash('content || chr(10)')} AS hash, CAST(length(content) + 1 AS INT) AS n_chars FROM logs",
    "article_scan": f"WITH {_ARTICLES} SELECT kind, path, key, md5(content || chr(10)) AS content_md5 FROM articles",
    "manifest_scan": f"WITH {_LOGS} SELECT file, hash, compiled_at, CAST(cost_usd AS DECIMAL(18,6)) AS cost_usd FROM manifest",
    "index_scan": f"WITH {_ARTICLES}, {_INDEX} SELECT key, summary, sources, CAST(updated AS VARCHAR) AS updated FROM index_",
    "context_sink": f"WITH {_CONTEXTS} SELECT session_id, turn_count, md5(context) AS context_md5 FROM contexts WHERE {_strip('context')} <> '' AND turn_count >= 2",
}
ORACLE_SQL["stream_hooks"] = ORACLE_SQL["hook_payload_repair"]

#: What is committed is what the upserts return, and a history in two runs is that of one.
ORACLE_SQL |= {"manifest_commit": ORACLE_SQL["manifest_upsert"], "index_commit": ORACLE_SQL["index_upsert"], "backfill_resumed": ORACLE_SQL["backfill_sessions"], "stream_flush_dedup_batches": ORACLE_SQL["stream_flush_dedup"]}

#: Files end in a line feed, so that all of a first run are pending, and of a second one those that have more.
ORACLE_SQL["incremental_files"] = f"""WITH {_LOGS}, f AS (SELECT file, log_date, content || chr(10) AS one, content || 'more' || chr(10) || chr(10) AS two FROM logs)
SELECT file, {_hash('one')} AS hash, 1 AS run FROM f UNION ALL SELECT file, {_hash('two')}, 2 FROM f WHERE day(log_date) % 3 = 0"""
