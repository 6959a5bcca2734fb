"""SQL for DuckDB whose results equal those of the registered queries of the same names.

Fingerprints (op1), token ids (op5, op8), the classifier (op10) and eigenvectors (op12) have no
counterpart in SQL; their queries are tested against plain versions instead.
"""

from tallymark.llm.hard_negatives import (
    LEAST_PERCENT,
    MOST_PERCENT,
    NEGATIVES,
    POSITIVES,
    SCALE as MINED_SCALE,
)
from tallymark.llm.line_dedup import MAX_RATIO, MIN_PAGES
from tallymark.llm.prefix_join import PERCENT
from tallymark.llm.quality_rules import (
    MAX_LINE_SHARE,
    MAX_REPEAT_PERCENT,
    MIN_KEPT_PERCENT,
    MIN_LINE_DOCS,
    MIN_WORDS,
)
from tallymark.llm.secrets import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEST_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DOCS = "SELECT *, row_number() OVER () AS row_id FROM documents"

LINE_DEDUP = f"""
WITH pages AS ({_DOCS}),
lines AS (
    SELECT row_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM pages
),
keyed AS (SELECT *, trim(line, {_SPACE}) AS key FROM lines),
totals AS (SELECT source, count(*) AS n_pages FROM pages GROUP BY source),
often AS (
    SELECT source, key
    FROM keyed JOIN totals USING (source)
    WHERE key <> ''
    GROUP BY source, key, n_pages
    HAVING count(DISTINCT row_id) >= {MIN_PAGES}
        AND count(DISTINCT row_id) > n_pages * {MAX_RATIO}
),
cut AS (
    SELECT k.row_id, count(*) AS n_lines, count(o.key) AS n_dropped,
        coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (o.key IS NULL), '') AS text
    FROM keyed k LEFT JOIN often o ON k.source = o.source AND k.key = o.key
    GROUP BY k.row_id
)
SELECT p.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped, c.text
FROM pages p LEFT JOIN cut c USING (row_id)
"""

DECONTAMINATION = f"""
WITH docs AS (
    SELECT row_id, doc_id, coalesce({_TEST_WORDS.format(_LOWER.format("text"))}, []) AS words
    FROM ({_DOCS})
),
items AS (
    SELECT item_id, {_TEST_WORDS.format(_LOWER.format("text"))} AS words FROM benchmark
),
windows AS (
    SELECT item_id, least(len(words), 10) AS size,
        unnest([
            array_to_string(words[k : k + 9], ' ') FOR k IN range(1, greatest(len(words) - 9, 1) + 1)
        ]) AS phrase
    FROM items
    WHERE len(words) > 0
),
places AS (
    SELECT row_id, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS phrase
    FROM (
        SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM docs, (SELECT DISTINCT size FROM windows)
    )
),
found AS (
    SELECT DISTINCT row_id, pos, size, item_id FROM places JOIN windows USING (size, phrase)
),
hits AS (
    SELECT row_id, count(DISTINCT hit) AS n_hit
    FROM (SELECT row_id, unnest(range(pos, pos + size)) AS hit FROM found)
    GROUP BY row_id
),
names AS (
    SELECT row_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (
        SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS name
        FROM found WHERE item_id IS NOT NULL
    )
    GROUP BY row_id
),
spans AS (
    SELECT row_id, count(*) AS n_spans
    FROM (
        SELECT row_id, hit, lag(hit) OVER (PARTITION BY row_id ORDER BY hit) AS before
        FROM (SELECT DISTINCT row_id, unnest(range(pos, pos + size)) AS hit FROM found)
    )
    WHERE before IS NULL OR before < hit - 1
    GROUP BY row_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(n_spans, 0) AS n_spans
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN names USING (row_id) LEFT JOIN spans USING (row_id)
"""


def _escaped(column: str) -> str:
    doubled = rf"replace({column}, '\', '\\')"
    return rf"regexp_replace({doubled}, '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')"


CHAT_FORMAT = f"""
WITH said AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        role IS NOT DISTINCT FROM 'assistant' AS is_reply
    FROM said
),
placed AS (
    SELECT *,
        row_number() OVER same AS pos,
        count(*) OVER (PARTITION BY conv_id) AS n,
        sum(20 + length({_escaped("role")}) + length({_escaped("text")})) OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
        ) AS written
    FROM turns
    WINDOW same AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (is_reply), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (is_reply), '')) AS loss_sha256,
    CAST(sum(written) FILTER (is_reply OR pos = n) AS BIGINT) AS formatted_chars,
    count(*) FILTER (is_reply OR pos = n) AS n_examples
FROM placed
GROUP BY conv_id
"""

QUALITY_RULES = rf"""
WITH docs AS (
    SELECT row_id, doc_id, source, coalesce(text, '') AS text,
        {_WORDS.format("coalesce(text, '')")} AS words
    FROM ({_DOCS})
),
windows AS (
    SELECT row_id, pos, array_to_string(words[pos : pos + 4], ' ') AS phrase
    FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS pos FROM docs)
),
again AS (
    SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, phrase) AS times FROM windows
),
repeated AS (
    SELECT row_id, count(DISTINCT word) AS n_repeat_words
    FROM (SELECT row_id, unnest(range(pos, pos + 5)) AS word FROM again WHERE times > 1)
    GROUP BY row_id
),
lines AS (
    SELECT row_id, source, text, line, {_WORDS.format("line")} AS words,
        array_to_string({_WORDS.format(_LOWER.format("line"))}, ' ') AS key
    FROM (SELECT row_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
),
filled AS (SELECT * FROM lines WHERE key <> ''),
dups AS (
    SELECT row_id, CAST(sum(times - 1) AS BIGINT) AS n_dup_lines
    FROM (SELECT row_id, line, count(*) AS times FROM filled GROUP BY row_id, line)
    GROUP BY row_id
),
often AS (
    SELECT source, key
    FROM filled JOIN (
        SELECT source, count(DISTINCT text) AS n_all FROM docs GROUP BY source
    ) USING (source)
    GROUP BY source, key, n_all
    HAVING count(DISTINCT text) > {MIN_LINE_DOCS}
        AND count(DISTINCT text) > n_all * {MAX_LINE_SHARE}
),
shared AS (
    SELECT row_id, CAST(sum(len(words)) AS BIGINT) AS n_shared_words
    FROM filled JOIN often USING (source, key)
    GROUP BY row_id
),
counted AS (
    SELECT doc_id, len(words) AS n_words,
        CAST(coalesce(list_sum([length(word) FOR word IN words]), 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_shared_words, 0) AS n_shared_words
    FROM docs
    LEFT JOIN repeated USING (row_id) LEFT JOIN dups USING (row_id) LEFT JOIN shared USING (row_id)
),
judged AS (
    SELECT *,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
            AS base_failed,
        n_words - n_shared_words AS n_left
    FROM counted
)
SELECT * EXCLUDE (n_left),
    NOT base_failed AND n_left >= {MIN_WORDS} AND 100 * n_left >= {MIN_KEPT_PERCENT} * n_words AS kept
FROM judged
"""


def _rule(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Return SQL for the matches of one rule: the lengths of gaps and matches give the places."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT row_id, {rank} AS rank, '{kind}' AS kind, start, start + length(match) AS stop
    FROM (
        SELECT row_id, match, value,
            sum(length(gap)) OVER so_far + sum(length(match)) OVER so_far - length(match) AS start
        FROM (
            SELECT row_id, unnest(range(1, len(matches) + 1)) AS pos, unnest(matches) AS match,
                unnest(vals) AS value, unnest(gaps[1 : len(matches)]) AS gap
            FROM (
                SELECT row_id, string_split_regex(text, '{quoted}') AS gaps,
                    regexp_extract_all(text, '{quoted}') AS matches,
                    regexp_extract_all(text, '{quoted}', {group}) AS vals
                FROM docs
            )
        )
        WINDOW so_far AS (PARTITION BY row_id ORDER BY pos)
    )
    WHERE length(value) >= {least}
    """


SECRET_SCAN = f"""
WITH docs AS (SELECT row_id, doc_id, coalesce(text, '') AS text FROM ({_DOCS})),
found AS ({" UNION ALL ".join(_rule(rank, *rule) for rank, rule in enumerate(RULES))}),
listed AS (
    SELECT row_id,
        count(*) FILTER (rank = 0) AS n_assign,
        count(*) FILTER (rank = 1) AS n_access,
        count(*) FILTER (rank = 2) AS n_hex,
        string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank)
            FILTER (rank < 3) AS base,
        string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans
    FROM found
    GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_id)
"""

SUBSTRING_DEDUP = f"""
WITH docs AS (
    SELECT row_id, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM ({_DOCS})
),
windows AS (
    SELECT row_id, doc_id, pos, array_to_string(words[pos : pos + 49], ' ') AS phrase
    FROM (
        SELECT row_id, doc_id, words, unnest(range(1, len(words) - 48)) AS pos
        FROM docs WHERE doc_id IS NOT NULL
    )
),
firsts AS (SELECT phrase, min(doc_id) AS least FROM windows GROUP BY phrase),
gone AS (
    SELECT DISTINCT row_id, unnest(range(pos, pos + 50)) AS pos
    FROM windows JOIN firsts USING (phrase)
    WHERE doc_id > least
),
places AS (
    SELECT row_id, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
),
kept AS (
    SELECT row_id, count(gone.pos) AS n_removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL) AS left_words
    FROM places LEFT JOIN gone USING (row_id, pos)
    GROUP BY row_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(left_words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (
    SELECT row_id, doc_id, coalesce({_WORDS.format(_LOWER.format("text"))}, []) AS words
    FROM ({_DOCS})
),
shingles AS (
    SELECT DISTINCT row_id, unnest([
        array_to_string(words[pos:pos + 3], ' ')
        for pos in range(1, greatest(1, len(words) - 3) + 1)
    ]) AS shingle
    FROM docs
    WHERE len(words) > 0
),
sizes AS (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
shared AS (
    SELECT a.row_id AS a, b.row_id AS b, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.row_id <> b.row_id
    GROUP BY a.row_id, b.row_id
),
links AS (
    SELECT a, b
    FROM shared JOIN sizes p ON a = p.row_id JOIN sizes q ON b = q.row_id
    WHERE 100 * n_both >= {PERCENT} * (p.n + q.n - n_both)
),
reached AS (
    SELECT row_id, row_id AS other FROM docs
    UNION
    SELECT r.row_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM docs d
JOIN reached r USING (row_id)
JOIN docs o ON r.other = o.row_id
LEFT JOIN sizes s ON d.row_id = s.row_id
GROUP BY d.row_id, d.doc_id
"""

HARD_NEGATIVES = f"""
WITH points AS (
    SELECT vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: CAST(floor({MINED_SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(
        embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE))
    )) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, p.vec_id, a.label = p.label AS same,
        CAST(list_sum(list_transform(
            range(1, len(a.x) + 1), lambda i: a.x[i] * p.x[i]
        )) AS BIGINT) AS score
    FROM points a, points p
    WHERE a.vec_id % 100 = 0 AND a.vec_id <> p.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scores
    WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (
        PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id
    ) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score
    AND 100 * s.score <= {MOST_PERCENT} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""

ORACLE_SQL = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_decontamination": DECONTAMINATION,
    "op4_chat_format": CHAT_FORMAT,
    "op6_quality_rules": QUALITY_RULES,
    "op7_secret_scan": SECRET_SCAN,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op11_jaccard_join": JACCARD_JOIN,
    "op13_hard_negatives": HARD_NEGATIVES,
}
