"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from .quality import CLASSES, WIDE, Divergence

SPACES = r"\x20\x09-\x0D"


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def quality_sql(rule: Divergence = Divergence()) -> str:
    everything = sorted({w for ws in rule.words.values() for w in ws})
    forms = sorted({f for w in everything for f in (w, w.capitalize(), w.upper())})
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN {quoted(ws)}" for k, ws in rule.words.items()) + f" ELSE {quoted(everything)} END"
    kept = []
    for c in CLASSES.values():
        kept.append("length(regexp_replace(t, '[^" + c.replace("'", "''") + "]+', '', 'g'))")
    kept.append(f"length(regexp_replace(t, '{WIDE}', '', 'g'))")
    classes = ", ".join(kept)

    def distance(p: str, q: str) -> str:
        share = lambda h: f"list_transform({h}, lambda x: x / CAST(list_sum({h}) AS DOUBLE))"
        term = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0.0 END"
        mean = "(z[1] + z[2]) / 2"
        return (f"sqrt(greatest(list_sum(list_transform(list_zip({share(p)}, {share(q)}), "
                f"lambda z: ({term('z[1]', mean)} + {term('z[2]', mean)}) / 2)), 0.0))")

    def far(d: str, limit: float, column: str, n: str) -> str:
        return f"coalesce({d} * {d} > {limit} * {limit} + len({column}) / ({8 * math.log(2.0)!r} * {n}), false)"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{SPACES}]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines FROM d),
tri AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM tri) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
f AS (SELECT row, doc_id, coalesce(lang, '') AS lang, CAST(len(words) AS BIGINT) AS n_words,
        length(t) AS signs, [{classes}] AS kept,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, {listed} AS listed,
        list_transform(list_filter(words, lambda x: rtrim(x, '.,') IN ({quoted(forms)[1:-1]})), lambda x: lower(rtrim(x, '.,'))) AS common
      FROM w),
h AS (SELECT *, list_transform(listed, lambda x: len(list_filter(common, lambda c: c = x))) AS found FROM f),
v AS (SELECT h.*, coalesce(covered.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(covered.n, 0) > 50 * n_words AS base_failed,
        list_append(kept, signs - list_sum(kept)) AS classes,
        list_append(found, n_words - CAST(list_sum(found) AS BIGINT)) AS words FROM h LEFT JOIN covered USING (row)),
rc AS (SELECT lang, list(n ORDER BY i) AS ref_classes FROM (SELECT lang, i, sum(classes[i]) AS n
        FROM v, (SELECT unnest(range(1, {len(CLASSES) + 3})) AS i) WHERE NOT base_failed GROUP BY lang, i) GROUP BY lang),
rw AS (SELECT lang, list(n ORDER BY i) AS ref_words FROM (SELECT lang, i, sum(words[i]) AS n
        FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM v WHERE NOT base_failed) GROUP BY lang, i) GROUP BY lang),
s AS (SELECT v.*,
        CASE WHEN list_sum(classes) >= {rule.least_signs} THEN {distance('classes', 'ref_classes')} END AS class_distance,
        CASE WHEN n_words >= {rule.least_words} THEN {distance('words', 'ref_words')} END AS word_distance
      FROM v LEFT JOIN rc USING (lang) LEFT JOIN rw USING (lang))
SELECT doc_id, n_words, CAST(signs - kept[{list(CLASSES).index('space') + 1}] AS BIGINT) AS word_chars,
  CAST(kept[{list(CLASSES).index('symbol') + 1}] AS BIGINT) AS n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT {far('class_distance', rule.class_limit, 'classes', 'list_sum(classes)')}
    AND NOT {far('word_distance', rule.word_limit, 'words', 'n_words')} AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM s"""



def spelling_sql(damage: int = 97, signs: int = 5, count: int = 3) -> str:
    """Words by crc32 written out; near words by what is left when the letter at one place is taken out."""
    step = "list_transform({}, lambda c: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)"
    table = "range(256)"
    for _ in range(8):
        table = step.format(table)
    return rf"""
WITH RECURSIVE crc AS (SELECT {table} AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents),
per AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= {signs} GROUP BY ALL),
hexed AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS h FROM per),
hashed AS (SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS k
        FROM hexed, crc),
spelt AS (SELECT CASE WHEN k % {damage} = 0 THEN substr(run, 1, k % length(run)) || substr(run, k % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {signs} GROUP BY word HAVING sum(n) >= {count}),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gaps a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM gaps a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
known AS (SELECT v.word, CASE WHEN near_n >= 2 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS stop FROM known UNION ALL SELECT way.word, known.form FROM way JOIN known ON known.word = way.stop WHERE known.form IS NOT NULL),
ends AS (SELECT way.word, way.stop FROM way JOIN known ON known.word = way.stop WHERE known.form IS NULL)
SELECT word, form, stop AS root, n, n_near, form_n FROM known JOIN ends USING (word)"""
