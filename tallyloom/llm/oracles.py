"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import licences, linededup, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def licence_scan() -> str:
    """op4: every unit against every template, the best at or above the threshold."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, [{', '.join(map(quote, sorted(b)))}])" for name, many in licences.TEMPLATES.items() for t in many if (b := licences.bigrams(t)))
    gap = r"E'\n[ \t\r]*\n'"
    return f"""WITH t AS (SELECT * FROM (VALUES {rows}) AS v(licence, b)),
u AS (SELECT doc_id, 'line' AS unit, i - 1 AS unit_no, l[i] AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM documents)
UNION ALL SELECT doc_id, 'paragraph', i - 1, l[i] FROM (SELECT doc_id, string_split_regex(text, {gap}) AS l, unnest(range(1, len(l) + 1)) AS i FROM documents) WHERE contains(trim(l[i], chr(10)), chr(10))
UNION ALL SELECT doc_id, 'text', 0, text FROM documents WHERE regexp_matches(text, {gap})),
w AS (SELECT doc_id, unit, unit_no, regexp_extract_all(translate(body, '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM u),
g AS (SELECT doc_id, unit, unit_no, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS g FROM w),
s AS (SELECT doc_id, unit, unit_no, licence, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g JOIN t ON len(g) BETWEEN len(b) * {licences._least_share(licences.THRESHOLD)!r} AND len(b) / {licences._least_share(licences.THRESHOLD)!r}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, licence) AS n FROM s WHERE dice >= {licences.THRESHOLD})
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, licence, dice FROM r WHERE n = 1"""


def quality_rules() -> str:
    """op8: counts, and lines held by many distinct documents of a source."""
    return rf"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM q) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d),
f AS (SELECT doc_id, host, x, {_WORDS.format("translate(x, '" + _UPPER + "123456789', '" + _LOWER + "000000000')")} AS w FROM l),
h AS (SELECT doc_id, host, x, len(w) AS n, substring(md5(array_to_string(w, ' ')), 1, 16) AS line FROM f WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM h GROUP BY doc_id),
same AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(line))), '') AS content FROM h GROUP BY doc_id),
r AS (SELECT DISTINCT host, line, content FROM h JOIN same USING (doc_id)),
o AS (SELECT host, line FROM r GROUP BY host, line HAVING count(*) > {quality.LINE_LIMIT}),
lost AS (SELECT doc_id, sum(n) AS n FROM h JOIN o ON h.line = o.line AND h.host IS NOT DISTINCT FROM o.host GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{_BLANKS}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, lost_words, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= {quality.LOST_SHARE} * n_words AS kept FROM a"""


def line_dedup() -> str:
    """op10: lines with an earlier equal line, or an earlier line one word away."""
    return rf"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(translate(x[i], chr(9) || chr(11) || chr(12) || chr(13), '    '), ' +', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS x, unnest(range(1, len(x) + 1)) AS i FROM documents)),
k AS (SELECT * FROM l WHERE line <> ''),
f AS (SELECT line, min({{'d': doc_id, 'n': line_no}}) AS first, string_split(line, ' ') AS w FROM k GROUP BY line),
v AS (SELECT line, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT line, first, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {linededup.NEAR_WORDS})),
p AS (SELECT a.line, b.first AS mate FROM v a JOIN v b ON a.v = b.v AND a.i = b.i WHERE b.first < a.first UNION ALL SELECT v.line, f.first FROM v JOIN f ON v.v = f.line WHERE len(f.w) >= {linededup.NEAR_WORDS} AND f.first < v.first UNION ALL SELECT f.line, v.first FROM v JOIN f ON v.v = f.line WHERE len(f.w) >= {linededup.NEAR_WORDS} AND v.first < f.first),
m AS (SELECT line, min(mate) AS mate FROM p GROUP BY line),
j AS (SELECT k.doc_id, k.line_no, {{'d': k.doc_id, 'n': k.line_no}} <> first AS exact, first, mate FROM k JOIN f USING (line) LEFT JOIN m USING (line))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN exact THEN first.d ELSE mate.d END AS keep_doc_id, CAST(CASE WHEN exact THEN first.n ELSE mate.n END AS INTEGER) AS keep_line_no, exact FROM j WHERE exact OR mate IS NOT NULL"""


ORACLE: dict[str, str] = {"op4_licences": licence_scan(), "op8_quality": quality_rules(), "op10_linededup": line_dedup()}
