"""DuckDB SQL of the span engines, their suppression and their merge, over a CTE ``d`` (doc_id, text).

Each builder gives rows (doc_id, engine, type, start, end, match, score)."""

from __future__ import annotations

from .. import schema as S
from .fixtures import LUHN_SQL, context_sql, find_sql

DIGITS = "regexp_replace(match, '[^0-9]', '', 'g')"
LUHN = LUHN_SQL.format(d=DIGITS)
MOD97 = "list_reduce(list_prepend(0, list_transform(string_split({s}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, v: CASE WHEN v >= 1000 THEN (a * 100 + v - 1000) % 97 ELSE (a * 10 + v) % 97 END)"
IOU = """CASE WHEN least({a}e, {b}e) > greatest({a}s, {b}s) THEN (least({a}e, {b}e) - greatest({a}s, {b}s)) / CAST(greatest({a}e, {b}e) - least({a}s, {b}s) AS DOUBLE) ELSE 0 END"""
HEAD = rf"^[\s\-*|]*(?:\*\*)?\s*({S.FIELD_KEY})\s*(?:\*\*)?\s*[:=]\s*(?:\*\*)?\s*"
LINES = "SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM d)"


def words(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def iban(c: str) -> str:
    s = f"upper(regexp_replace({c}, '\\s+', '', 'g'))"
    return f"(regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,30}}') AND {MOD97.format(s=f'(substring({s}, 5) || substring({s}, 1, 4))')} = 1)"


def ssn(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"(length({d}) = 9 AND substring({d}, 1, 3) NOT IN ('000', '666') AND substring({d}, 1, 3) < '900' AND substring({d}, 4, 2) <> '00' AND substring({d}, 6, 4) <> '0000')"


BARE = "list_transform(string_split_regex(match, '\\s+'), lambda w: lower(regexp_replace(w, '^[.,]+|[.,]+$', '', 'g')))"
PERSON = f"(len({BARE}) BETWEEN 2 AND 4 AND NOT list_has_any({BARE}, {words(S.STOP_WORDS)}) AND (list_has_any({BARE}, {words(S.GIVEN_NAMES)}) OR regexp_matches(({BARE})[-1], '({'|'.join(S.SURNAME_SUFFIXES)})$')))"


def _found(engine: str, kind: str, pattern: str, score: str, near: str | None = None, where: str = "true") -> str:
    src = find_sql(pattern, "d")
    if near:
        src = f"SELECT *, regexp_matches(context, '{near}') AS near FROM ({context_sql(src, 'd')})"
    return f"""SELECT doc_id, '{engine}' AS engine, '{kind}' AS type, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", match, CAST({score} AS DOUBLE) AS score FROM ({src}) WHERE {where}"""


def _inner(pattern: str, score: float) -> str:
    """Only the name at the end of each match counts."""
    name = f"regexp_extract(match, '({S.NAME})$', 1)"
    return f"""SELECT doc_id, 'rule' AS engine, 'PERSON' AS type, CAST("end" - length({name}) AS BIGINT), CAST("end" AS BIGINT), {name}, CAST({score} AS DOUBLE) FROM ({find_sql(pattern, 'd')})"""


RULES = " UNION ALL ".join([
    _found("rule", "EMAIL", S.EMAIL, "0.97"), _found("rule", "CREDIT_CARD", S.CARD, f"CASE WHEN {LUHN} THEN 0.98 ELSE 0.35 END"), _found("rule", "IBAN", S.IBAN, f"CASE WHEN {iban('match')} THEN 0.99 ELSE 0.40 END"),
    _found("rule", "SSN", S.SSN_DASHED, f"CASE WHEN {ssn('match')} THEN 0.96 ELSE 0.50 END"), _found("rule", "SSN", S.SSN_BARE, "0.85", S.CONTEXT["SSN"], "near"),
    _found("rule", "PHONE", S.PHONE, "CASE WHEN near THEN 0.92 ELSE 0.55 END", S.CONTEXT["PHONE"]), _found("rule", "DOB", S.DATE, "CASE WHEN near THEN 0.90 ELSE 0.20 END", S.CONTEXT["DOB"]),
    _found("rule", "ACCOUNT_NUMBER", S.ACCOUNT, "0.88", S.CONTEXT["ACCOUNT_NUMBER"], "near"), _found("rule", "ADDRESS", S.ADDRESS, "CASE WHEN regexp_matches(match, '[0-9]{5}$') THEN 0.92 ELSE 0.80 END"),
    _inner(S.HONORIFIC, 0.85), _inner(S.ROLE, 0.78), _found("rule", "PERSON", S.CAP_BIGRAM, "0.40"),
])
TITLES = _found("heuristic-ner", "PERSON", S.TITLE_RUN, f"CASE WHEN list_contains({words(S.GIVEN_NAMES)}, ({BARE})[1]) THEN 0.82 ELSE 0.62 END", where=PERSON)
FIELDS = f"""SELECT doc_id, 'heuristic-ner' AS engine, type, CAST(pos + length(head) AS BIGINT) AS start, CAST(pos + length(head) + length(v) AS BIGINT) AS "end", v AS match, CAST(0.9 AS DOUBLE) AS score FROM (
    SELECT doc_id, pos, head, regexp_replace(substring(line, length(head) + 1), '[ .*|]+$', '') AS v, CASE lower(key) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FIELDS.items())} END AS type FROM (
    SELECT doc_id, line, pos, regexp_extract(line, '(?i){HEAD}', 0) AS head, regexp_extract(line, '(?i){HEAD}', 1) AS key FROM ({LINES}))) WHERE type IS NOT NULL AND head <> '' AND v <> ''"""
HEURISTICS = f"{FIELDS} UNION ALL {TITLES} UNION ALL {_found('heuristic-ner', 'EMAIL', S.EMAIL, '0.93')}"
_LEFT = "regexp_replace(match, '^[\\-*(\\[\"'']+', '')"
_CLASSES = "list_transform(string_split(token, ''), lambda x: CASE WHEN regexp_full_match(x, '\\p{Ll}') THEN 'l' WHEN regexp_full_match(x, '\\p{Lu}') THEN 'U' WHEN regexp_full_match(x, '\\p{Nd}') THEN 'd' ELSE x END)"
SHAPES = f"""SELECT doc_id, 'shape' AS engine, type, CAST(start AS BIGINT) AS start, CAST(start + length(token) AS BIGINT) AS "end", token AS match, CAST(score AS DOUBLE) AS score FROM (
    SELECT *, CASE shape {' '.join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in S.SHAPES.items())} END AS type, CASE shape {' '.join(f"WHEN '{k}' THEN {v}" for k, (_, v) in S.SHAPES.items())} END AS score, length(regexp_replace(token, '[^0-9]', '', 'g')) AS nd FROM (
    SELECT doc_id, start, token, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 1 AND c[i] = c[i-1] THEN '' ELSE c[i] END), '') AS shape FROM (
    SELECT *, {_CLASSES} AS c FROM (SELECT doc_id, start + length(match) - length({_LEFT}) AS start, regexp_replace({_LEFT}, '[\\-*)\\]"''.:;]+$', '') AS token FROM ({find_sql(r'[^\s,;|]+', 'd')})) WHERE length(token) >= 3)))
    WHERE CASE type WHEN 'ACCOUNT_NUMBER' THEN nd BETWEEN 8 AND 17 WHEN 'IBAN' THEN length(token) BETWEEN 12 AND 34 WHEN 'PERSON' THEN length(token) >= 4 AND NOT list_contains({words(S.STOP_WORDS)}, lower(token)) WHEN 'SSN' THEN nd = 9 ELSE type IS NOT NULL END
    UNION ALL {_found('shape', 'PERSON', S.CAP_BIGRAM, '0.46', where=f"NOT list_has_any(list_transform(string_split_regex(match, '\\s'), lambda t: lower(t)), {words(S.STOP_WORDS)})")}"""
ENGINES = f"{RULES} UNION ALL {HEURISTICS} UNION ALL {SHAPES}"


def suppressed(src: str, out: str, keys: str, test: str = "> 0.5") -> str:
    """CTEs that keep of ``src`` what no better kept span of the same ``keys`` overlaps; for a WITH RECURSIVE."""
    same = " AND ".join(f"r.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"""{out}_r AS MATERIALIZED (SELECT *, start AS s, "end" AS e, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, start, "end", match) AS k FROM {src}),
    {out}_w AS (SELECT {keys}, k, [{{'s': s, 'e': e, 'k': k}}] AS kept, true AS ok FROM {out}_r WHERE k = 1
      UNION ALL SELECT {mine}, r.k, CASE WHEN hit THEN kept ELSE list_append(kept, {{'s': r.s, 'e': r.e, 'k': r.k}}) END, NOT hit FROM
        (SELECT r.*, w.kept, coalesce(list_bool_or(list_transform(w.kept, lambda x: {IOU.format(a='x.', b='r.')} {test})), false) AS hit FROM {out}_w w JOIN {out}_r r ON {same} AND r.k = w.k + 1) r),
    {out} AS MATERIALIZED (SELECT r.* EXCLUDE (s, e, k) FROM {out}_r r JOIN {out}_w w USING ({keys}, k) WHERE w.ok)"""


def united(src: str) -> str:
    """CTEs i and u: overlapping spans of a document joined to one, under the type with the highest score."""
    return f"""i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, type ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {src})),
    u AS (SELECT doc_id, island, min(start) AS start, max("end") AS "end", first(type ORDER BY score DESC, start, type DESC) AS type, max(score) AS score FROM i GROUP BY 1, 2)"""


MERGED = f"a AS MATERIALIZED ({ENGINES}), {suppressed('a', 'b', 'doc_id, engine, type')}, {suppressed('b', 'm', 'doc_id, type', '>= 0.5')}"
# How many engines found each merged span: a span counts for the first kept one that it overlaps.
MULTIPLE = f"""mk AS (SELECT r.* FROM m_r r JOIN m_w w USING (doc_id, type, k) WHERE w.ok), bk AS (SELECT *, start AS s, "end" AS e FROM b),
    v AS (SELECT doc_id, type, k, count(DISTINCT engine) AS multiplicity FROM (SELECT b.doc_id, b.type, b.engine, min(m.k) AS k FROM bk b JOIN mk m ON m.doc_id = b.doc_id AND m.type = b.type AND {IOU.format(a='m.', b='b.')} >= 0.5 GROUP BY b.doc_id, b.type, b.engine, b.s, b.e, b.match, b.score) GROUP BY 1, 2, 3)"""
