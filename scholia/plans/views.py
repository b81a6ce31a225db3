"""The relations of `scholia.sources.adapters` in SQL, as common table expressions."""

from __future__ import annotations

from scholia.functions import srs
from scholia.sources.adapters import STOP, TOKEN

PAPERS = """papers AS (SELECT substr(sha256(text), 1, 8) AS paper_id, doc_id, source AS folder, lang, substr(split_part(text, chr(10), 1), 1, 60) AS title, text
  FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY sha256(text)))"""
LINES = """lines AS (SELECT doc_id, n, parts[n] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM papers)))"""
ANNOTATED = """annotated AS (SELECT *, CASE WHEN section % 2 = 0 THEN CAST(top AS VARCHAR) ELSE CAST(top AS VARCHAR) || '.1' END AS number, CASE WHEN section % 2 = 0 THEN 1 ELSE 2 END AS level,
  line || CASE WHEN n % 2 = 0 THEN ' [' || n || ']' ELSE ' (Smith et al., ' || (2000 + n % 20) || ')' END
    || CASE WHEN n % 5 = 0 THEN ' as in Fig. ' || (n % 9 + 1) || '.' WHEN n % 5 = 1 THEN ' see Table ' || (n % 4 + 1) || '.'
      WHEN n % 7 = 2 THEN ' by Figs. ' || (n % 4 + 1) || '-' || (n % 9 + 1) || '(b), ' || (n % 4 + 1) || ' and A' || (n % 9 + 1)
      WHEN n % 7 = 3 THEN ' of Eqs. (' || (n % 9 + 1) || ')–(' || (n % 4 + 1) || 'c) here' ELSE '' END AS body
  FROM (SELECT doc_id, n, line, (n - 1) % 3 = 0 AS opens, (n - 1) // 3 AS section, ((n - 1) // 3) // 2 + 1 + CASE WHEN doc_id % 7 = 0 AND (n - 1) // 3 >= 4 THEN 1 ELSE 0 END AS top FROM lines))"""
_NUM = r"(?:[A-Z]-?\d+|\d+)(?:\([a-z]\)|[a-z]\b)?"
REFERENCE = rf"\b(?:Fig(?:ure)?s?\.?|FIG(?:URE)?S?\.?|Tables?|TABLES?|Tabs?\.|Eq(?:uation)?s?\.?)\s*\(?{_NUM}\)?(?:\s*(?:,|and|&|–|-|to)\s*\(?{_NUM}\)?)*"
REFERENCES = rf"""refs AS (SELECT DISTINCT doc_id, n, CASE lower(r[1]) WHEN 'f' THEN 'figure:' WHEN 't' THEN 'table:' ELSE 'equation:' END || regexp_replace(x, '^([A-Z])(\d)', '\1-\2') AS key
  FROM (SELECT doc_id, n, r, unnest(regexp_extract_all(r, '[A-Z]-?\d+|\d+')) AS x FROM (SELECT doc_id, n, unnest(regexp_extract_all(body, '{REFERENCE}')) AS r FROM annotated)))"""
FIRST_REFERENCE = rf"""first_refs AS (SELECT doc_id, n, CASE lower(r[1]) WHEN 'f' THEN 'figure:' WHEN 't' THEN 'table:' ELSE 'equation:' END || regexp_replace(regexp_extract(r, '[A-Z]-?\d+|\d+', 0), '^([A-Z])(\d)', '\1-\2') AS key
  FROM (SELECT doc_id, n, regexp_extract(body, '{REFERENCE}', 0) AS r FROM annotated) WHERE r <> '')"""
SECTIONS = """rows3 AS (SELECT *, section + 1 AS sec FROM annotated),
sections AS (SELECT doc_id, sec AS n, level, number, CASE WHEN sec = 1 AND doc_id % 2 = 0 THEN 'front' WHEN sec > 12 THEN 'back' ELSE 'body' END AS kind, CASE WHEN sec = 4 AND doc_id % 5 = 0 THEN 'Abstract' ELSE number || ' ' || substr(line, 1, 40) END AS title FROM rows3 WHERE opens),
sentences AS (SELECT doc_id, sec AS section, (n - 1) % 3 AS k, body AS text FROM rows3 WHERE NOT opens)"""
PAGE_LINES = """page_rows AS (SELECT doc_id, n, opens, number, line, body, (n - 1) // 10 + 1 AS page, (n - 1) % 10 AS r, section AS k FROM annotated),
page_lines AS (SELECT doc_id, n * 10 AS n, page, CASE WHEN opens THEN 12.0 WHEN n % 11 = 0 THEN 7.0 ELSE 10.0 END AS size, opens AS bold, (r + 1) * 0.08 + 0.02 AS y,
    CASE WHEN NOT opens THEN body WHEN k = 0 AND doc_id % 2 = 0 THEN 'Abstract' WHEN k = 12 THEN 'References' ELSE number || ' ' || substr(line, 1, 40) END AS text FROM page_rows
  UNION ALL SELECT doc_id, n * 10 + 1, page, 12.0, true, (r + 1) * 0.08 + 0.03, 'and more of it' FROM page_rows WHERE (n - 1) % 12 = 0
  UNION ALL SELECT doc_id, min(n) * 10 - 5, page, 8.0, false, 0.03, 'Journal of Tests, page ' || page FROM page_rows GROUP BY doc_id, page)"""
PAGE_ROWS = """laid AS (SELECT *, (n - 1) // 12 + 1 AS page, (n - 1) % 12 AS slot, ((n - 1) // 12 + 1) % 3 <> 2 AS two, section = 1 AND doc_id % 5 = 0 AS early FROM annotated),
laid2 AS (SELECT *, CASE WHEN two THEN slot // 6 * 270 + 50 ELSE 50 END::DOUBLE AS x0, CASE WHEN two THEN slot % 6 * 100 + 80 ELSE slot * 50 + 80 END::DOUBLE AS y0, CASE WHEN early THEN 0 ELSE section % 4 END AS style FROM laid),
page_rows AS (SELECT doc_id, page, n * 10 AS line, x0, x0 + CASE WHEN two THEN 240 ELSE 490 END AS x1, y0, y0 + 12 AS y1,
    CASE WHEN opens THEN CASE WHEN section = 0 AND doc_id % 2 = 0 THEN 'ABSTRACT' WHEN early THEN 'References and links' WHEN section = 12 THEN 'References' ELSE number || ' ' || substr(line, 1, 40) END
      WHEN n = 3 AND doc_id % 2 = 0 THEN 'Keywords: a few words' WHEN n % 9 = 5 THEN '• ' || body ELSE body END AS text,
    CASE WHEN opens THEN CASE WHEN style = 0 THEN 12.0 ELSE 10.0 END WHEN n % 11 = 0 THEN 7.0 ELSE 10.0 END::DOUBLE AS size,
    opens AND style IN (0, 2) AS bold, opens AND style = 1 AS italic, opens AND style = 3 AS ocr, CASE WHEN NOT opens AND n % 13 = 0 THEN 0.8 ELSE 0 END::DOUBLE AS math FROM laid2
  UNION ALL SELECT doc_id, page, n * 10 + 1, x0, x0 + CASE WHEN two THEN 240 ELSE 490 END, y0 + 14, y0 + 26, 'and more of it', 12.0, true, false, false, 0 FROM laid2 WHERE n % 12 = 1 AND n > 1
  UNION ALL SELECT DISTINCT doc_id, page, 1, 50, 300, 20, 30, 'Journal of Tests, page ' || page, 8.0, true, false, false, 0 FROM laid2
  UNION ALL SELECT DISTINCT doc_id, page, 2, 50, 540, 66, 76, 'A paper of ' || doc_id, 18.0, true, false, false, 0 FROM laid2 WHERE page = 1
  UNION ALL SELECT DISTINCT doc_id, page, 3, 5, 20, 300, 500, 'arXiv:2101.00001v1 [cs.CL] 1 Jan 2021', 20.0, true, false, false, 0 FROM laid2 WHERE page = 1)"""
TOKENS = f"""tokens AS (SELECT doc_id, pos - 1 AS pos, words[pos] AS token FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS words FROM papers)))"""
DICTIONARY = f"""dictionary AS (SELECT DISTINCT lower(w) AS lower FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS w FROM benchmark))"""
REVIEWS = """reviews AS (SELECT event_id AS uid, user_id AS headword, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 3 ELSE 4 END AS rating, ts AS reviewed_at, event_id % 2 AS device FROM events)"""
MARKS = """marks AS (SELECT user_id * 10 + event_id % 10 AS uid, event_id % 50 AS paper, substr(props, 1, 20) AS note, ts AS updated_at, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS deleted, event_id % 2 AS device, event_id FROM events)"""
_W = ", ".join(str(x) for x in srs.W)
_REPLAY = f"""w_of_STATES AS (SELECT [{_W}]::DOUBLE[] AS w),
ordered_for_STATES AS (SELECT headword, rating AS r, CAST(floor(epoch(reviewed_at)) AS BIGINT) AS t, row_number() OVER (PARTITION BY headword ORDER BY floor(epoch(reviewed_at)), uid) AS i, count(*) OVER (PARTITION BY headword) AS n FROM PAST),
STATES AS (WITH RECURSIVE fold AS (
  SELECT headword, n, 0::BIGINT AS i, 0::BIGINT AS phase, 0::BIGINT AS step, 0::DOUBLE AS s, 0::DOUBLE AS d, 0::BIGINT AS due, 0::BIGINT AS last FROM ordered_for_STATES WHERE i = 1
  UNION ALL
  SELECT headword, n, i, CASE WHEN up THEN 2 WHEN phase >= 2 THEN 3 ELSE 1 END, CASE WHEN up OR r = 1 THEN 0 WHEN r = 3 THEN step + 1 ELSE step END, s2, d2,
    t + CASE WHEN up THEN 86400 * CAST(least(greatest(round_even(s2, 0), 1), 36500) AS BIGINT) WHEN phase >= 2 THEN CASE r WHEN 2 THEN 900 ELSE 600 END WHEN r = 1 THEN 60 WHEN r = 3 OR step > 0 THEN 600 ELSE 330 END, t
  FROM (SELECT *, CASE WHEN phase = 2 THEN r > 1 ELSE r = 4 OR r = 3 AND step + 1 >= stairs OR r = 2 AND step >= stairs END AS up
    FROM (SELECT *, CASE phase WHEN 3 THEN 1 ELSE 2 END AS stairs, greatest(0.001, CASE WHEN phase = 0 THEN w[r] WHEN away = 0 THEN s * CASE WHEN r = 1 THEN g ELSE greatest(g, 1) END
        WHEN r = 1 THEN least(s / exp(w[18] * w[19]), w[12] * ((s + 1) ** w[14] - 1) / d ** w[13] * exp(w[15] * (1 - held)))
        ELSE s + s * exp(w[9]) * (11 - d) / s ** w[10] * (exp(w[11] * (1 - held)) - 1) * CASE r WHEN 2 THEN w[16] WHEN 4 THEN w[17] ELSE 1 END END) AS s2,
      least(10, greatest(1, CASE WHEN phase = 0 THEN w[5] + 1 - exp(w[6] * (r - 1)) ELSE w[8] * (w[5] + 1 - exp(3 * w[6])) + (1 - w[8]) * (d - w[7] * (r - 3) * (10 - d) / 9) END)) AS d2
      FROM (SELECT o.headword, o.n, o.i, o.r, o.t, f.phase, f.step, f.s, f.d, w, greatest(o.t - f.last, 0) // 86400 AS away,
          exp(w[18] * (o.r - 3 + w[19])) / f.s ** w[20] AS g, (1 + (0.9 ** (-1 / w[21]) - 1) * (greatest(o.t - f.last, 0) // 86400) / f.s) ** -w[21] AS held
        FROM fold f JOIN ordered_for_STATES o ON o.headword = f.headword AND o.i = f.i + 1, w_of_STATES))))
  SELECT headword, n, phase, step, s, d, due, last FROM fold WHERE i = n)"""


def replay(past: str = "past", states: str = "states") -> str:
    """The replay fold by recursion over the answers of `past`, one at a time, written from the published model and not from
    the expression that Spark runs: phase 0 new, 1 learning, 2 review, 3 relearning; steps 1 and 10 minutes, relearning 10."""
    return _REPLAY.replace("STATES", states).replace("PAST", past)


STATE = "SELECT headword, phase, step, round(s, 5) AS stability, round(d, 5) AS difficulty, due, last, n FROM states"
STOPS = ", ".join(f"'{w}'" for w in STOP)


def sql(*views: str, query: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + query


def undone(w: str, rules: list[tuple[str, str]]) -> str:
    """`text._undone` in SQL: the word and what is left of it by the rules."""
    forms = []
    for suffix, put in rules:
        k = len(suffix)
        if put == "2":
            forms.append(f"CASE WHEN {w} LIKE '%{suffix}' AND length({w}) > {k + 2} AND substr({w}, -{k + 1}, 1) = substr({w}, -{k + 2}, 1) THEN substr({w}, 1, length({w}) - {k + 1}) END")
        else:
            forms.append(f"CASE WHEN {w} LIKE '%{suffix}'{' AND ' + w + ' NOT LIKE ' + repr('%ss') if suffix == 's' else ''} THEN substr({w}, 1, length({w}) - {k}) || '{put}' END")
    return f"list_concat([{w}], list_filter([{', '.join(forms)}], lambda x: x IS NOT NULL AND length(x) >= 2))"
