"""Reference SQL of the operators that SQL can express, for DuckDB over the supplied tables."""

from __future__ import annotations

MIX = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
    SELECT *, row_number() OVER f AS i,
        least(1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE), sum(cap) OVER ()) AS budget,
        (least(1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE), sum(cap) OVER ())
         - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / (CAST(sum(w) OVER () AS DOUBLE) - coalesce(CAST(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)) AS level
    FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
opened AS (SELECT *, min(CASE WHEN level * w <= cap THEN i END) OVER () AS open FROM levels),
targets AS (
    SELECT source, source_size, budget,
        CASE WHEN i < open OR open IS NULL THEN cap ELSE max(CASE WHEN i = open THEN level END) OVER () * w END AS target,
        CAST(floor(budget / 64) AS BIGINT) AS seats, greatest(CAST(ceil(source_size / 1048576) AS BIGINT), 1) AS shards
    FROM opened),
bounds AS (
    SELECT *, CASE WHEN seats > 0 AND sum(target) OVER () > 0 THEN target * seats / sum(target) OVER () ELSE 0 END AS q,
        CASE WHEN seats > 0 THEN count(*) OVER () / seats ELSE 0 END AS slack FROM targets),
sure AS (
    SELECT *, greatest(CAST(floor(q * (1 - slack)) AS BIGINT) - 1, 0) AS low, CAST(ceil(q * (1 + slack)) AS BIGINT) + 1 AS high FROM bounds),
ranked AS (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r,
        CASE WHEN q > 0 OR low > 0 THEN seats - total ELSE 0 END AS remaining
    FROM (SELECT *, sum(low) OVER () AS total FROM sure) s, LATERAL (SELECT unnest(range(low, high + 1)) AS k) c),
blocks AS (
    SELECT s.source, s.source_size, s.target, s.shards,
        s.low + (SELECT count(*) FROM ranked r WHERE r.source IS NOT DISTINCT FROM s.source AND r.r <= r.remaining) AS blocks FROM sure s),
placed AS (
    SELECT d.*, b.* EXCLUDE (source), md5('42:' || CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR)) AS o
    FROM sized d JOIN blocks b ON d.source IS NOT DISTINCT FROM b.source),
sharded AS (SELECT *, CAST(('0x' || substr(o, 1, 8)) AS BIGINT) % shards AS shard FROM placed),
shard_sizes AS (
    SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, any_value(blocks) AS blocks, any_value(target) AS target FROM sharded GROUP BY source, shard),
shard_bounds AS (
    SELECT *, CASE WHEN blocks > 0 AND sum(words) OVER g > 0 THEN words * blocks / CAST(sum(words) OVER g AS DOUBLE) ELSE 0 END AS q,
        CASE WHEN blocks > 0 THEN count(*) OVER g / blocks ELSE 0 END AS slack FROM shard_sizes WINDOW g AS (PARTITION BY source)),
shard_sure AS (
    SELECT *, greatest(CAST(floor(q * (1 - slack)) AS BIGINT) - 1, 0) AS low, CAST(ceil(q * (1 + slack)) AS BIGINT) + 1 AS high FROM shard_bounds),
shard_ranked AS (
    SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard, k) AS r, blocks - total AS remaining
    FROM (SELECT *, sum(low) OVER (PARTITION BY source) AS total FROM shard_sure) s, LATERAL (SELECT unnest(range(low, high + 1)) AS k) c
    WHERE q > 0 OR low > 0),
quotas AS (
    SELECT s.*, s.low + (SELECT count(*) FROM shard_ranked r
            WHERE r.source IS NOT DISTINCT FROM s.source AND r.shard = s.shard AND r.r <= r.remaining) AS quota,
        row_number() OVER (PARTITION BY source ORDER BY words DESC, shard) = 1 AS largest FROM shard_sure s),
takes AS (
    SELECT source, shard, words, least(greatest(quota * 64 + CASE WHEN largest THEN CAST(floor(target + 0.5) AS BIGINT) - blocks * 64 ELSE 0 END, 0), 2 * words) AS take,
        CAST(('0x' || substr(md5('42:' || coalesce(source, '') || ':' || CAST(shard AS VARCHAR)), 1, 8)) AS BIGINT)
            % greatest(CAST(ceil(words / 64) AS BIGINT), 1) * 64 AS begin_at
    FROM quotas),
runs AS (
    SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN take % words ELSE 0 END AS run FROM takes),
laid AS (
    SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY o, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS at FROM sharded)
SELECT l.doc_id, l.size, l.source_size, l.target,
    CAST(r.passes * l.size
        + greatest(least(least(r.begin_at + r.run, r.words) - l.at, l.size) - greatest(r.begin_at - l.at, 0), 0)
        + greatest(least(r.begin_at + r.run - r.words - l.at, l.size) - greatest(0 - l.at, 0), 0) AS BIGINT) AS taken
FROM laid l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND l.shard = r.shard
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
plain AS (
    SELECT *, NOT (contains(role, chr(10)) OR regexp_matches(role, '<\||\\\\|\\\||\\n') OR regexp_matches(text, '<\||\\\\|\\\||\\n')) AS ok FROM turns),
sizes AS (
    SELECT *, 24 + length(role) + length(text) + CASE WHEN ok THEN 0 ELSE
        length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '<|', ''))) // 2 + length(role) - length(replace(role, chr(10), ''))
        + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2 END AS chars FROM plain),
told AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sizes GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM told
"""

NEAR_TEXTS = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
elements AS (SELECT doc_id, unnest(s) AS e FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a)
SELECT r.a AS doc_id, s.n AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r JOIN sized s ON s.doc_id = r.a GROUP BY r.a, s.n
"""

NEAR_VECTORS = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, named.c AS component_id, e.vec_id = named.c AS kept
FROM embeddings e JOIN named ON named.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

URLS = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parsed AS (
    SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
    SELECT DISTINCT host, path, arg_max(h || p, length(h || p)) OVER (PARTITION BY host, path) AS rule, arg_max(v, length(h || p)) OVER (PARTITION BY host, path) AS verdict
    FROM (SELECT DISTINCT host, path FROM parsed) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, parsed.host, parsed.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fits ON parsed.host = fits.host AND parsed.path = fits.path
"""

REPEATS = r"""
WITH words AS (
    SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM windows JOIN firsts USING (s) WHERE first < doc_id GROUP BY doc_id),
kept AS (
    SELECT words.doc_id, w, CASE WHEN g IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(g, i)] END AS k
    FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, [x FOR x IN string_split_regex(p, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) r(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (
    SELECT * FROM counts c WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM counts q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.a >= 100 * c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
    SELECT c.*, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS left_part, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS right_part
    FROM candidates c, range(1, 5) r(j) WHERE j < k),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.j, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
    FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.left_part JOIN counts r ON r.lang = c.lang AND r.phrase = c.right_part
    JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
    CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

SEARCH = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY doc_id, t),
sizes AS (SELECT doc_id, sum(tf) AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark),
weighed AS (
    SELECT item_id, t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM asked JOIN dfs USING (t), totals),
lengths AS (SELECT doc_id, 75 + CAST((25 * n * nn) // ll AS BIGINT) AS m FROM sizes, totals),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM weighed JOIN tfs USING (t) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
