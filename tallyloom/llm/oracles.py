"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from tallyloom.llm.license_join import PHRASES, TEMPLATES, WORD
from tallyloom.llm.quality_rules import RULES, SYMBOLS
from tallyloom.llm.quality_rules import SPACE as WHITE
from tallyloom.llm.quality_rules import WORD as BLACK

_RATES = ", ".join(
    f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS f_{name}" for name, rule in RULES.items()
)
_PRIORS = ", ".join(
    f"sum(f_{k}) / sum(n)::DOUBLE AS m_{k}, sum(f_{k} * f_{k} / n::DOUBLE) / sum(n) - (sum(f_{k}) / sum(n)::DOUBLE) ** 2"
    f" - (sum(f_{k}) / sum(n)::DOUBLE) * (1 - sum(f_{k}) / sum(n)::DOUBLE) * count(*) / sum(n) AS b_{k}"
    for k in RULES
)
_WEIGHT = "CASE WHEN b_{k} <= 0 OR m_{k} IN (0, 1) THEN 1000 ELSE least(greatest(m_{k} * (1 - m_{k}) / b_{k} - 1, 1), 1000) END"
_BAD = " OR ".join(f"(f_{k} + m_{k} * ({_WEIGHT.format(k=k)})) / (n + ({_WEIGHT.format(k=k)})) > 0.5" for k in RULES)

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{BLACK}') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{BLACK}')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
    (length(t) - length(regexp_replace(t, '{WHITE}', '', 'g')))::BIGINT AS n_space,
    length(regexp_replace(t, '{WHITE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT source, count(*) AS n, {_RATES} FROM m GROUP BY source),
p AS (SELECT {_PRIORS} FROM f),
bad AS (SELECT source, true AS rejected FROM f CROSS JOIN p WHERE {_BAD})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({RULES['short']} OR {RULES['repeats']}) AS base_failed,
  NOT ({RULES['short']} OR {RULES['repeats']}) AND coalesce(rejected, false) = false AS kept
FROM m LEFT JOIN bad ON m.source IS NOT DISTINCT FROM bad.source
"""

_PHRASE_ROWS = " UNION ALL ".join(
    f"SELECT row, '{label}' AS label, i - 1 AS place FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)"
    f" WHERE {' AND '.join(f'ws[i + {k}] = ' + repr(word) for k, word in enumerate(phrase.split()))}"
    for label, phrase in PHRASES.items()
)


def _template_rows(share: float = 0.8) -> str:
    """A row for each word of each template: label, word, distinct words, words needed, width of a window."""
    rows = []
    for label, text in TEMPLATES.items():
        own = sorted(set(text.split()))
        need, width = math.ceil(round(share * len(own), 9)), math.floor(round(len(text.split()) / share, 9))
        rows += [f"('{label}', '{word}', {len(own)}, {need}, {width})" for word in own]
    return ", ".join(rows)


_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, t, regexp_extract_all({_LOWER.format(x='t')}, '{WORD}') AS ws FROM d),
ph AS ({_PHRASE_ROWS}),
b AS (SELECT row, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS ls FROM ph GROUP BY row),
t AS (SELECT * FROM (VALUES {_template_rows()}) v(label, word, size, need, width)),
s AS (SELECT row, i, label, t.word AS word, size, need, width
  FROM (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) x JOIN t ON x.word = t.word),
f AS (SELECT row, label, held / size::DOUBLE AS share FROM (SELECT row, label, size, need, count(DISTINCT word) OVER (
    PARTITION BY row, label ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS held FROM s) WHERE held >= need),
g AS (SELECT row, list(DISTINCT label) AS ls, max(share) AS best FROM f GROUP BY row)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
  hi::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(g.ls, [])))), ','), '') AS labels,
  greatest(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM w LEFT JOIN b ON w.row = b.row LEFT JOIN g ON w.row = g.row
"""

LEAKS = f"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
i AS (SELECT item_id, ws, least(10, len(ws)) AS k
  FROM (SELECT item_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{WORD}') AS ws FROM benchmark)),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS s FROM i WHERE k > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT row, s, k, array_to_string(ws[s:s + k - 1], ' ') AS g
  FROM (SELECT row, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w CROSS JOIN ks WHERE len(ws) >= k)),
h AS (SELECT row, item_id, s, dw.k AS k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
p AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(s, s + k)) AS place FROM h) GROUP BY row),
t AS (SELECT row, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM w LEFT JOIN p ON w.row = p.row LEFT JOIN t ON w.row = t.row
"""

RECORDS = """
WITH b AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
c AS (SELECT *, from_hex(s)::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY s) AS last FROM b)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT
    + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM c
"""

#: All orders of the five filters, and what each step of them finds among the documents counted by failed filters.
AUDIT = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
prefixes AS (SELECT '' AS p UNION ALL
  SELECT p || l FROM prefixes, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(p, l)),
steps AS (SELECT p, k AS step, substr(p, k, 1) AS letter, 1 << (ascii(substr(p, k, 1)) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(substr(p, j, 1)) - 65))), 0)::INT AS done
  FROM (SELECT p, unnest(range(1, 6)) AS k FROM prefixes WHERE length(p) = 5)),
found AS (SELECT part, p, step, letter,
    sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & done <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL)
SELECT part, p AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM found
"""
