"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from geoloom.llm import licenses, urls
from geoloom.llm.chat import MARK, NARRATOR, OPEN, PLAIN
from geoloom.llm.lines import MIN_LINES
from geoloom.llm.lines import MIN_WORDS as MIN_LONG_LINE
from geoloom.llm.quality import MAX_REPEAT, MIN_WORDS, RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rules() -> str:
    tests = []
    for r in RULES:
        if r.least is not None:
            tests.append(f"100 * {r.top} >= {r.least} * {r.bottom}")
        if r.most is not None:
            tests.append(f"100 * {r.top} <= {r.most} * {r.bottom}")
    return " AND ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, {_WORDS} AS words,
    list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) > 0) AS lines FROM d),
t AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM t) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
s AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: length(x) <= 6 AND regexp_replace(lower(x), '[.,;:!?]', '', 'g') IN ({_STOP}))) AS n_stop_words,
    len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[•\\-\\*]\\s'))) AS n_bullet_lines
  FROM w LEFT JOIN p USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  (NOT base_failed AND {_rules()}) AS kept
FROM b
"""



def _url_case(rules, value) -> str:
    """The longest fitting rule first."""
    order = sorted(rules, key=lambda r: -len(r[-2] + r[-1]))
    fits = lambda r: f"(host = '{r[-2]}' OR host LIKE '%.{r[-2]}') AND path LIKE '{r[-1]}%'"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in order) + " END"


URLS = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {_url_case(urls.RULES, lambda r: r[1] + r[2])} AS rule, {_url_case(urls.RULES, lambda r: r[0])} AS said,
    {_url_case(urls.LISTED, lambda r: "block")} IS NOT NULL AS listed FROM b)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM c
"""

CHAT = f"""
WITH t AS (SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '{MARK}', '{PLAIN}'), chr(13) || chr(10), '  ') AS speaker, replace(coalesce(text, ''), '{MARK}', '{PLAIN}') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{NARRATOR}'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{NARRATOR}' THEN '{NARRATOR}' ELSE 'user' END AS role
    FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, row_number() OVER o - 1 AS position, sum(length(segment)) OVER o - length(segment) AS start
    FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, role, segment, CAST(start AS BIGINT) AS start, CAST(start + length(segment) AS BIGINT) AS "end",
  CASE WHEN speaker = perspective THEN CAST(start + length(head) AS BIGINT) END AS train_start,
  CASE WHEN speaker = perspective THEN CAST(start + length(segment) - 1 AS BIGINT) END AS train_end
FROM w
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(words[i + 1 : i + 20], ' ')) AS h
    FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS i FROM w)),
f AS (SELECT h, min((doc_id, i)) AS first FROM g GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE (doc_id, i) <> first),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, (SELECT unnest(range(0, 20)) AS k) GROUP BY doc_id),
k AS (SELECT doc_id, words, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN words
    ELSE list_filter(words, lambda x, j: NOT list_contains(gone, j - 1)) END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

JACCARD = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i + 1 : i + 4], ' ') END AS s
    FROM (SELECT rid, words, unnest(range(0, greatest(1, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.least AS component_id, CAST(coalesce(d.k, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (rid) LEFT JOIN (SELECT x AS rid, count(*) AS k FROM l GROUP BY 1) d USING (rid)
JOIN (SELECT r.x AS rid, min(w.doc_id) AS least FROM r JOIN w ON r.y = w.rid GROUP BY 1) m USING (rid)
"""

_BLANK = "length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) > 0"
_LONG = "len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) >= " + str(MIN_LONG_LINE)

LINES = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l AS MATERIALIZED (SELECT doc_id, all_lines, list_filter(list_transform(all_lines, lambda x, i: {{'place': i, 'x': x}}), lambda s: {_BLANK.replace("(x,", "(s.x,")}) AS lines FROM d),
e AS MATERIALIZED (SELECT doc_id, i, lines[i].place AS place, lines[i].x AS x FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
n AS MATERIALIZED (SELECT doc_id, i, place, x, min((doc_id, i)) OVER (PARTITION BY x) AS name, count(*) OVER (PARTITION BY x) AS c FROM e),
r AS (SELECT 1 AS size, doc_id, i, name FROM n WHERE c > 1
  UNION ALL SELECT size, doc_id, i, name FROM (SELECT r.size + 1 AS size, r.doc_id, r.i, min((r.doc_id, r.i)) OVER w AS name, count(*) OVER w AS c
    FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + r.size WHERE n.c > 1 WINDOW w AS (PARTITION BY r.name, n.name)) WHERE c > 1),
p AS MATERIALIZED (SELECT doc_id, i, max(size) AS size FROM r WHERE name <> (doc_id, i) GROUP BY doc_id, i),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM p WHERE size >= {MIN_LINES}
  UNION SELECT doc_id, i FROM p JOIN n USING (doc_id, i) WHERE {_LONG}),
c AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM g JOIN n USING (doc_id, i) GROUP BY doc_id),
o AS (SELECT doc_id, max(size) AS longest FROM p WHERE size >= {MIN_LINES} GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run,
  sha256(array_to_string(CASE WHEN places IS NULL THEN all_lines ELSE list_filter(all_lines, lambda x, j: NOT list_contains(places, j)) END, chr(10))) AS kept_sha256
FROM l LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""

def _string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _vectors(name: str, of: str) -> str:
    """Norms and weighted terms of the vectors in ``of`` (key, terms)."""
    return f"""{name}_t AS MATERIALIZED (SELECT key, term, count(*) * (ln((1.0e0 + (SELECT n FROM total)) / (1 + coalesce(any_value(df), 0))) + 1) AS w
    FROM (SELECT key, unnest(terms) AS term FROM {of}) LEFT JOIN df USING (term) GROUP BY key, term),
{name}_n AS (SELECT key, sqrt(sum(w * w)) AS norm FROM {name}_t GROUP BY key)"""


_TERMS = f"regexp_extract_all(lower(line), {_string(licenses.TERM)})"
_FLAT = f"regexp_replace(p, {_string(licenses.SPACE + '+')}, ' ', 'g')"
_SOME_CUE = _string(licenses.cue("[^a-z0-9_]+"))

LICENSES = f"""
WITH d AS MATERIALIZED (SELECT doc_id, text, concat(coalesce(source, 'unknown'), '/', coalesce(lang, 'unknown'), '/', coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), 'null'), '/', coalesce(CAST(doc_id AS VARCHAR), 'null'), '.txt') AS path FROM documents),
c AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), {_string('(?m)' + licenses.SIGNS)}, '', 'g') AS p FROM d WHERE regexp_matches(text, {_SOME_CUE})),
notice AS MATERIALIZED (SELECT DISTINCT doc_id, 0 AS kind, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM c) WHERE regexp_matches(line, {_string(licenses.CUE)})
  UNION ALL SELECT DISTINCT doc_id, 1, {_FLAT} FROM (SELECT doc_id, unnest(regexp_split_to_array(p, {_string(licenses.BLANK)})) AS p FROM c)
    WHERE regexp_matches(p, {_string(licenses.WRAPPED)}) AND regexp_matches({_FLAT}, {_string(licenses.CUE)})
  UNION ALL SELECT DISTINCT doc_id, 2, {_FLAT} FROM c),
template AS (SELECT * FROM (VALUES {", ".join(f"({_string(a)}, {_string(b)})" for a, b in licenses.TEMPLATES)}) AS t(license, line)),
total AS (SELECT (SELECT count(*) FROM notice WHERE kind = 0) + (SELECT count(*) FROM template) AS n),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM notice WHERE kind = 0 UNION ALL SELECT unnest(list_distinct({_TERMS})) FROM template) GROUP BY term),
a AS (SELECT DISTINCT line AS key, {_TERMS} AS terms FROM notice),
b AS (SELECT license || chr(10) || line AS key, {_TERMS} AS terms FROM template),
{_vectors("a", "a")},
{_vectors("b", "b")},
s AS (SELECT a_t.key AS line, split_part(b_t.key, chr(10), 1) AS license, round(sum(a_t.w * b_t.w) / (any_value(a_n.norm) * any_value(b_n.norm)), 6) AS score
  FROM a_t JOIN b_t USING (term) JOIN a_n ON a_n.key = a_t.key JOIN b_n ON b_n.key = b_t.key GROUP BY a_t.key, b_t.key),
o AS MATERIALIZED (SELECT doc_id, min((-score, license)) AS best, max(CASE WHEN kind = 2 AND score >= {licenses.FILE_THRESHOLD} THEN 1 ELSE 0 END) AS whole FROM notice JOIN s USING (line) WHERE score >= {licenses.THRESHOLD} GROUP BY doc_id),
e AS MATERIALIZED (SELECT d.doc_id, d.path, o.best[2] AS own, -o.best[1] AS own_score, o.whole, regexp_replace(d.path, '/[^/]*$', '') AS home FROM d LEFT JOIN o USING (doc_id)),
f AS (SELECT home AS dir, min((-own_score, path, own)) AS b FROM e WHERE own IS NOT NULL AND whole = 1 GROUP BY home),
h AS (SELECT DISTINCT home, string_split(home, '/') AS parts FROM e),
u AS (SELECT home, n, array_to_string(parts[1 : n], '/') AS dir FROM (SELECT home, parts, unnest(range(0, len(parts) + 1)) AS n FROM h)),
n AS (SELECT home, max((n, dir, b)) AS best FROM u JOIN f USING (dir) GROUP BY home)
SELECT doc_id, path, coalesce(own, best[3][3]) AS license, coalesce(own_score, -best[3][1]) AS score,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN best IS NOT NULL THEN 'inherited' ELSE 'none' END AS found, CASE WHEN own IS NULL THEN best[2] END AS from_dir
FROM e LEFT JOIN n USING (home)
"""

SQL = {"op5_license_scans": LICENSES, "op1_line_dedup": LINES, "op3_ngram_jaccard_join": JACCARD, "op9_substring_dedup": SUBSTRING, "op7_chat_formatting": CHAT, "op2_url_filters": URLS, "op4_quality_rules": QUALITY}
