"""DuckDB twins of the native operators, built from the same fixed values."""

from __future__ import annotations

from flowsieve.llm import licenses, pii


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    lower = f"translate({text}, '{licenses.UPPER}', '{licenses.LOWER}')"
    return f"list_filter(string_split_regex({lower}, '{licenses.SEPARATORS}'), lambda x: x <> '')"


def license_scan(k: int = 3, gap: int = 2, least: float = 0.8) -> str:
    templates = ", ".join(f"({i}, {_text(label)}, {_text(t)})" for i, (label, t) in enumerate(
        (label, t) for label, ts in licenses.TEMPLATES.items() for t in ts))
    starts = {label: "list_filter(range(0, greatest(len(w) - {n} + 1, 0)), lambda i: {c})".format(n=len(p.split()), c=" AND ".join(
        f"w[i + {j + 1}] = {_text(x)}" for j, x in enumerate(p.split()))) for p, label in licenses.PHRASES.items()}
    places = "list_concat(" + ", ".join(f"p{i}" for i in range(len(starts))) + ")"
    found = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN {_text(label)} END" for i, label in enumerate(starts))
    run = " || ' ' || ".join(f"w[i + {j + 1}]" for j in range(k))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT r, doc_id, len(w) AS n_words, {', '.join(f'{s} AS p{i}' for i, s in enumerate(starts.values()))} FROM d),
base AS (SELECT r, doc_id, n_words, {places} AS starts, list_sort(list_filter([{found}], lambda x: x IS NOT NULL)) AS labels FROM b),
runs AS (SELECT r, i AS pos, {run} AS run FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {k} + 1, 0))) AS i FROM d)),
tw AS (SELECT template, label, {_sql_words('t')} AS w FROM (VALUES {templates}) v(template, label, t)),
tr AS (SELECT template, label, len(w) - {k} + 1 AS t_runs, i AS t_pos, {run} AS run FROM (SELECT *, unnest(range(0, len(w) - {k} + 1)) AS i FROM tw)),
diagonals AS (SELECT r, template, label, t_runs, pos - t_pos AS diagonal, list_distinct(list(t_pos)) AS found FROM runs JOIN tr USING (run) GROUP BY ALL),
spans AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {gap} THEN 0 ELSE 1 END AS apart FROM diagonals)),
covered AS (SELECT r, label, len(list_distinct(flatten(list(found)))) / t_runs AS coverage FROM spans GROUP BY r, template, label, t_runs, span),
best AS (SELECT r, list_distinct(list(label)) AS labels, max(coverage) AS coverage FROM covered WHERE coverage >= {least} GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word,
       CAST(list_max(starts) AS BIGINT) AS last_word, array_to_string(base.labels, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(best.labels, [])))), ',') AS labels,
       CAST(coalesce(best.coverage, CASE WHEN len(starts) > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM base LEFT JOIN best USING (r)"""


# The plain forms of the patterns.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _cut(ctx: str, pattern: str) -> str:
    """Structs (i, match, before, at) of a pattern's matches in a text; ``at`` is where each starts."""
    return (f"SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all({ctx}, '{pattern}') AS m, "
            f"string_split_regex({ctx}, '{pattern}') AS g FROM")


def pii_find(alpha: float = 0.9, support: int = 3) -> str:
    at = "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    digits = "regexp_replace({m}, '[^0-9]', '', 'g')"
    ok = {"email": "true", "ip": "list_max(list_transform(string_split(m[i], '.'), lambda x: TRY_CAST(x AS HUGEINT))) <= 255 "
                                  "AND list_bool_and(list_transform(string_split(m[i], '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NOT NULL))",
          "phone": f"length({digits.format(m='m[i]')}) BETWEEN 8 AND 15",
          "card": f"length({digits.format(m='m[i]')}) BETWEEN 16 AND 19 AND list_sum(list_transform(list_reverse(string_split({digits.format(m='m[i]')}, '')), "
                  "lambda c, k: CASE WHEN k % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN CAST(c AS INTEGER) * 2 - 9 ELSE CAST(c AS INTEGER) * 2 END)) % 10 = 0"}
    hits = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, {n} AS k, m[i] AS match, {at} AS s, {at} + length(m[i]) AS e, "
        f"right(g[i], {pii.REACH}) AS l, left(g[i + 1], {pii.REACH}) AS ri FROM ({_cut('text', p)} d) WHERE len(m) > 0) WHERE {ok[kind]}"
        for n, (kind, p) in enumerate(PLAIN.items(), 1))
    entity = f"kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits.format(m='match')} ELSE lower(match) END"

    def near(side: str, origin: str, keep: str) -> str:
        return (f"SELECT r, entity, lower(m[i]) AS term, {origin} + {at} AS ts, {origin} + {at} + length(m[i]) AS te FROM "
                f"({_cut(side, pii.TERM)} (SELECT *, {entity} AS entity FROM base)) WHERE len(m) > 0) WHERE {keep}")
    left = near("l", "s - length(l)", f"i > len(m) - {pii.NEAR} AND NOT (length(l) >= {pii.REACH} AND {at} = 0)")
    right = near("ri", "e", f"i <= {pii.NEAR} AND NOT (length(ri) >= {pii.REACH} AND {at} + length(m[i]) >= {pii.REACH})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({hits})),
near AS (SELECT DISTINCT * FROM ({left} UNION ALL {right})),
pairs AS (SELECT entity, term, count(DISTINCT r) AS n_et FROM near GROUP BY ALL HAVING count(DISTINCT r) >= {support}),
entities AS (SELECT entity, count(DISTINCT r) AS n_e FROM near GROUP BY ALL),
terms AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{pii.TERM}'))) AS term FROM d) GROUP BY ALL),
told AS (SELECT entity, term FROM pairs JOIN entities USING (entity) JOIN terms USING (term), (SELECT count(*) AS n FROM d)
         WHERE ln(n / n_e) > 0 AND ln(CAST(n_et AS DOUBLE) * n / (CAST(n_t AS DOUBLE) * n_e)) >= {alpha} * ln(n / n_e)),
found AS (SELECT DISTINCT r, ts, te FROM near JOIN told USING (entity, term)),
added AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.s < f.te AND b.e > f.ts)),
spans AS (SELECT r, k, kind, s, e FROM base UNION ALL SELECT r, 5, 'term', ts, te FROM added),
by_doc AS (SELECT r, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 4) AS n4,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 5) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS a
  FROM spans GROUP BY r)
SELECT doc_id, CAST(coalesce(n1, 0) AS BIGINT) AS n_email, CAST(coalesce(n2, 0) AS BIGINT) AS n_ip, CAST(coalesce(n3, 0) AS BIGINT) AS n_card,
       CAST(coalesce(n4, 0) AS BIGINT) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN by_doc USING (r)"""


def collocations(least: int = 30, share: int = 80, top: int = 2000) -> str:
    """Every phrase spelled out and counted by its text."""
    phrase = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p WHERE len(w) >= {k})"
                                for k in range(1, 5))
    cut = "SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS cut FROM (SELECT *, string_split(phrase, ' ') AS w FROM cand)"
    sub = " UNION ALL ".join(f"SELECT lang, a AS longer, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM (SELECT lang, a, w, unnest(range(1, len(w) - {m} + 2)) AS i FROM "
                             f"(SELECT *, string_split(phrase, ' ') AS w FROM cand WHERE k > {m}))" for m in (2, 3))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
sizes AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS a FROM ({phrase}) GROUP BY ALL HAVING count(*) >= {least}),
cand AS (SELECT * FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM ({cut})),
scored AS (SELECT c.lang, c.phrase, c.a, cut, h.a AS l, r.a AS r, (2000000 * c.a::HUGEINT) // (h.a::HUGEINT + r.a::HUGEINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM scored) WHERE i = 1),
inside AS (SELECT lang, phrase, max(longer) AS longer FROM ({sub}) GROUP BY ALL),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase
  WHERE longer IS NULL OR 100 * longer::HUGEINT < {share} * a::HUGEINT)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}"""


def ranked_search(k: int = 20) -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
totals AS (SELECT count(*) AS documents, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, totals),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * documents) // CAST(terms AS BIGINT) AS m FROM d, totals WHERE len(w) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
