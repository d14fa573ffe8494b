"""DuckDB SQL for the queries that SQL can express.

Op 5 sums logarithms, whose last digits depend on the order of additions, op 10 is approximate, and ops 6, 8 and 9 need tokenizers or
learned trees; tests hold those against brute force.
"""

from __future__ import annotations

from .quality import LEAST, SHARE
from .urls import LISTED_HOST, LOWER, RULES, TRACKING, UPPER

SPACE = r"[\x20\x09-\x0D]+"
LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}'), lambda x: x <> '')"


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(LOWERED)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * o >= 80 * (n + m - o)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.sh
"""

OP2 = f"""
WITH w AS (SELECT doc_id, {words("text")} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS pos, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 34], ' ') AS win FROM v),
d AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) > 1 AS twice FROM k),
c AS (SELECT u.doc_id, u.word, u.pos, coalesce(max(CASE WHEN d.twice THEN 1 ELSE 0 END) OVER (PARTITION BY u.doc_id ORDER BY u.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM u LEFT JOIN d ON u.doc_id = d.doc_id AND u.pos = d.pos),
g AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(g.n_words, 0)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

OP3 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {words("text")} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS pos, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[pos:pos + 7], ' ')) > 1 AS twice FROM win),
c AS (SELECT doc_id, unnest(range(pos, pos + 8)) AS spot FROM k WHERE twice),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM c GROUP BY doc_id),
raw AS (SELECT doc_id, source, md5(t) AS own, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, source, own, place, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{SPACE}', ' ', 'g')) AS line FROM raw),
ln AS (SELECT * FROM norm WHERE line <> ''),
cnt AS (SELECT source, line, count(DISTINCT own) AS n FROM ln GROUP BY 1, 2),
host AS (SELECT source, count(DISTINCT md5(t)) AS docs FROM w GROUP BY 1),
freq AS (SELECT cnt.source, line FROM cnt JOIN host USING (source) WHERE n > {LEAST} AND n > {SHARE} * docs),
lost AS (SELECT ln.doc_id, sum(len(string_split(ln.line, ' '))) AS n FROM ln JOIN freq ON ln.source = freq.source AND ln.line = freq.line GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
      coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM b
"""



def escapes(text: str) -> str:
    """Characters that escaping adds."""
    return rf"(len({text}) - len(translate({text}, '\<>', '')))"


OP4 = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 6 + len(role) + {escapes("role")} + 1 + len(text) + {escapes("text")} + 8 AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  len(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def rule_case(column: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    value = lambda r: r[1] + r[2] if column else r[0]
    return "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in ordered) + " END"


OP7 = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (SELECT page_id, url, tail, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{TRACKING}='))), '&') AS query FROM h),
n AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS name, {rule_case(1)} AS rule, {rule_case(0)} AS said FROM q),
l AS (SELECT DISTINCT name FROM n WHERE url IS NOT NULL AND regexp_matches(host, '{LISTED_HOST.replace(chr(92) + "A", "^")}'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(said, CASE WHEN host <> '' AND name IN (SELECT name FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM n
"""

ORACLE_SQL = {"op1_jaccard": OP1, "op2_substrings": OP2, "op3_quality": OP3, "op4_chat": OP4, "op7_urls": OP7}
