"""DuckDB SQL for those queries that SQL can express on whole tables."""

from __future__ import annotations

from .decontamination import SHORTEST, UNITS, WINDOW

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUP = "CAST('0x' || substring(sha, CAST(5 * g + 1 AS INT), 5) AS BIGINT)"
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda g: " + " || ".join(f"substring('{_ALPHABET}', CAST((({_GROUP} >> {k}) & 31) + 1 AS INT), 1)" for k in (15, 10, 5, 0)) + "), '')"

WARC = f"""SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS sha, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS top FROM pages)"""

NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


def _tokens(text: str) -> str:
    """Points and commas before a digit are marked first, as RE2 can't look ahead."""
    marked = f"regexp_replace(regexp_replace(coalesce({text}, ''), '\\.(\\p{{N}})', chr(1) || '\\1', 'g'), ',(\\p{{N}})', chr(2) || '\\1', 'g')"
    return f"list_filter(string_split_regex({marked}, '[^\\p{{L}}\\p{{N}}%$€£\\x01\\x02]+'), lambda x: x <> '')"


_UNITS = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"
_TEMPLATE = f"(CASE WHEN substring(x, 1, 1) BETWEEN '0' AND '9' OR (length(x) > 1 AND substring(x, 1, 1) IN ('$', '€', '£', chr(1), chr(2))) THEN '#n' WHEN list_contains({_UNITS}, lower(x)) THEN '#u' WHEN x <> lower(x) AND length(x) > 1 AND substring(x, 2) = substring(lower(x), 2) THEN '#p' ELSE lower(x) END)"
# Windows (id, i, kind, h) of rows (id, t, ts): those of WINDOW tokens in up to three forms, and runs of the lengths of short items.
_WIN = f"""SELECT id, i, kind, h FROM (SELECT id, i, ks, ws, len(ks) AS size, len(list_filter(ks, lambda k: k = '#p')) AS names, len(list_filter(ks, lambda k: k IN ('#n', '#u'))) AS nums
FROM (SELECT id, i, ts[i:i+{WINDOW - 1}] AS ks, list_transform(t[i:i+{WINDOW - 1}], lambda x: lower(x)) AS ws FROM (SELECT id, t, ts, unnest(range(1, greatest(len(ts) - {WINDOW - 1}, 1) + 1)) AS i FROM {{src}} WHERE len(ts) > 0))),
LATERAL (SELECT 2 AS kind, 'T ' || array_to_string(ks, ' ') AS h WHERE 2 * (names + nums) <= size UNION ALL
SELECT 1, 'T ' || array_to_string(list_transform(range(1, size + 1), lambda j: CASE WHEN ks[j] = '#p' THEN ws[j] ELSE ks[j] END), ' ') WHERE names > 0 AND 2 * nums <= size UNION ALL
SELECT 0, 'W ' || array_to_string(ws, ' ') WHERE 2 * nums > size)
UNION ALL SELECT id, i, 0, 'R ' || array_to_string(list_transform(t[i:i+n-1], lambda x: lower(x)), ' ') FROM (SELECT id, t, n, unnest(range(1, len(ts) - n + 2)) AS i FROM {{src}}, short WHERE len(ts) {{fits}} n)"""


def _covered(n: str, m: str) -> str:
    """The better of the three shares: which of (typed, templated, all) it is, as 1 to 3."""
    better = lambda i, j: f"{n}{i} > 0 AND {m}{i} * {n}{j} >= {m}{j} * {n}{i}"
    return f"CASE WHEN {better(1, 2)} AND {better(1, 3)} THEN 1 WHEN {better(2, 3)} THEN 2 ELSE 3 END"


_COUNTS = "count(DISTINCT CASE WHEN kind = 2 THEN ipos END) AS m1, count(DISTINCT CASE WHEN kind >= 1 THEN ipos END) AS m2, count(DISTINCT ipos) AS m3"
_BEST = f"SELECT *, [n1, n2, n3][w] AS n_windows, [m1, m2, m3][w] AS n_matched FROM (SELECT *, {_covered('n', 'm')} AS w FROM ({{rows}}))"

DECONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT id, doc_id, t, list_transform(t, lambda x: {_TEMPLATE}) AS ts FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, '')) AS id, doc_id, {_tokens('text')} AS t FROM documents)),
b AS MATERIALIZED (SELECT id, item_id, t, list_transform(t, lambda x: {_TEMPLATE}) AS ts FROM (SELECT coalesce(CAST(item_id AS VARCHAR), 'text ' || coalesce(text, '')) AS id, item_id, {_tokens('text')} AS t FROM benchmark)),
short AS (SELECT DISTINCT len(ts) AS n FROM b WHERE len(ts) BETWEEN {SHORTEST} AND {WINDOW - 1}),
gw AS MATERIALIZED (SELECT DISTINCT id AS item, i - 1 AS ipos, max(kind) OVER (PARTITION BY id, i) AS kind, h FROM ({_WIN.format(src='b', fits='=')})),
dw AS MATERIALIZED (SELECT DISTINCT id AS doc, i - 1 AS pos, h FROM ({_WIN.format(src='d', fits='>=')})),
totals AS (SELECT item, m1 AS n1, m2 AS n2, m3 AS n3 FROM (SELECT item, {_COUNTS} FROM gw GROUP BY 1)),
r AS MATERIALIZED (SELECT DISTINCT doc, item, pos - ipos AS shift, ipos, kind FROM dw JOIN gw USING (h)),
p AS (SELECT doc, item, n1, n2, n3 FROM ({_BEST.format(rows=f'SELECT doc, item, n1, n2, n3, {_COUNTS} FROM r JOIN totals USING (item) GROUP BY ALL')}) WHERE n_matched >= 0.5 * n_windows),
c AS MATERIALIZED (SELECT *, sum(new) OVER (PARTITION BY doc, item ORDER BY shift) AS copy FROM (SELECT *, CASE WHEN shift - lag(shift) OVER (PARTITION BY doc, item ORDER BY shift) <= {WINDOW} THEN 0 ELSE 1 END AS new
FROM (SELECT doc, item, n1, n2, n3, shift, min(ipos) AS low, max(ipos) AS high FROM r JOIN p USING (doc, item) GROUP BY ALL))),
way AS MATERIALIZED (SELECT doc, item, shift, 0 AS way, 0 AS place FROM c UNION ALL SELECT doc, item, shift, 1, copy FROM c UNION ALL SELECT doc, item, shift, 2, shift FROM c),
v AS MATERIALIZED (SELECT c.doc, c.item, shift, b.ts[k] AS kind, lower(b.t[k]) AS a, lower(d.t[k + shift]) AS z FROM (SELECT *, unnest(range(low + 1, high + {WINDOW} + 1)) AS k FROM c) AS c JOIN b ON b.id = c.item JOIN d ON d.id = c.doc WHERE b.ts[k] = d.ts[k + shift] AND substring(b.ts[k], 1, 1) = '#'),
g AS (SELECT doc, item, way, place, count(*) AS n_slots, count(DISTINCT (kind, a)) AS one, count(DISTINCT (kind, a, z)) AS two, bool_or(a <> z) AS changed FROM v JOIN way USING (doc, item, shift) GROUP BY ALL),
k AS ({_BEST.format(rows=f'SELECT doc, item, way, place, n1, n2, n3, {_COUNTS} FROM r JOIN p USING (doc, item) JOIN way USING (doc, item, shift) GROUP BY ALL')}),
o AS (SELECT doc, item, way, place, n_windows, n_matched, round(n_matched / CAST(n_windows AS DOUBLE), 6) AS coverage, coalesce(n_slots, 0) AS n_slots, CASE WHEN two > 0 THEN round(one / CAST(two AS DOUBLE), 6) ELSE 1.0 END AS consistency, CASE WHEN changed THEN 'reparameterised' ELSE 'verbatim' END AS kind FROM k LEFT JOIN g USING (doc, item, way, place) WHERE n_matched >= 0.5 * n_windows)
SELECT doc_id, item_id, n_windows, n_matched, coverage, n_slots, consistency, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY coverage DESC, n_slots DESC, way, place DESC) AS rk FROM o WHERE consistency >= 0.8)
JOIN (SELECT DISTINCT id AS doc, doc_id FROM d) USING (doc) JOIN (SELECT DISTINCT id AS item, item_id FROM b) USING (item) WHERE rk = 1"""


_NORM = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
QUOTATION = rf"""WITH RECURSIVE k AS MATERIALIZED (SELECT row_number() OVER () AS rw, conv_id, turn, role, text FROM conversations),
l AS (SELECT rw, conv_id, turn, pos, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS p, line FROM (SELECT rw, conv_id, turn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT *, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM k))),
b AS MATERIALIZED (SELECT *, lag(level) OVER w AS before, lead(level) OVER w AS after FROM (SELECT rw, conv_id, turn, pos, length(regexp_replace(p, '[^>]', '', 'g')) AS level, substring(line, length(p) + 1) AS body FROM l) WINDOW w AS (PARTITION BY rw ORDER BY pos)),
o AS MATERIALIZED (SELECT k.rw, k.conv_id, k.turn, k.role, CASE WHEN x.quoted THEN regexp_replace(coalesce(x.own, ''), '^\s+|\s+$', '', 'g') ELSE coalesce(k.text, '') END AS own FROM k JOIN (SELECT rw, bool_or(level > 0) AS quoted, string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT (regexp_matches(body, '(?i)^.{{0,200}}\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') AND coalesce(after, 0) > 0)) AS own FROM b GROUP BY rw) x USING (rw)),
q AS (SELECT * FROM (SELECT *, sum(CASE WHEN before IS NULL OR before <> level THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN trim(body, ' ' || chr(9)) = '' THEN 1 ELSE 0 END) OVER w AS para FROM b WINDOW w AS (PARTITION BY rw ORDER BY pos)) WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
u AS MATERIALIZED (SELECT *, length(unit) AS chars FROM (SELECT rw, conv_id, turn, run, level, grain, para, {_NORM.format(c="string_agg(body, ' ' ORDER BY pos)")} AS unit FROM (SELECT rw, conv_id, turn, run, level, 0 AS grain, -1 AS para, -1 AS line, pos, body FROM q UNION ALL SELECT rw, conv_id, turn, run, level, 1, para, -1, pos, body FROM q UNION ALL SELECT rw, conv_id, turn, run, level, 2, para, pos, pos, body FROM q) GROUP BY rw, conv_id, turn, run, level, grain, para, line) WHERE unit <> ''),
s AS MATERIALIZED (SELECT conv_id, unit, min(turn) AS turn FROM (SELECT conv_id, turn, {_NORM.format(c="part")} AS unit FROM (SELECT conv_id, turn, unnest(list_concat([own], string_split_regex(own, '\n\s*\n'), string_split_regex(own, '\r\n|\r|\n'))) AS part FROM o WHERE conv_id IS NOT NULL AND turn IS NOT NULL)) WHERE unit IN (SELECT unit FROM u) GROUP BY 1, 2),
f AS (SELECT unit, first(conv_id ORDER BY conv_id, turn) AS c, first(turn ORDER BY conv_id, turn) AS t FROM s GROUP BY unit),
m AS (SELECT u.*, CASE WHEN s.turn < u.turn THEN u.conv_id WHEN (f.c < u.conv_id OR f.c = u.conv_id AND f.t < u.turn) AND chars >= 12 THEN f.c END AS oc, CASE WHEN s.turn < u.turn THEN s.turn WHEN (f.c < u.conv_id OR f.c = u.conv_id AND f.t < u.turn) AND chars >= 12 THEN f.t END AS ot FROM u LEFT JOIN s ON s.unit = u.unit AND s.conv_id = u.conv_id LEFT JOIN f ON f.unit = u.unit),
g AS (SELECT *, coalesce(bool_or(grain = 0 AND oc IS NOT NULL) OVER (PARTITION BY rw, run), false) AS whole, coalesce(bool_or(grain = 1 AND oc IS NOT NULL) OVER (PARTITION BY rw, run, para), false) AS by_para FROM m),
c AS MATERIALIZED (SELECT *, oc IS NOT NULL AND CASE WHEN whole THEN grain = 0 ELSE grain = 1 OR grain = 2 AND NOT by_para END AS linked FROM g),
n AS (SELECT conv_id, turn, count(*) AS n_quotes, count(*) FILTER (WHERE ok) AS n_linked FROM (SELECT conv_id, turn, rw, run, bool_or(linked) AS ok FROM c GROUP BY ALL) GROUP BY 1, 2),
a AS MATERIALIZED (SELECT conv_id, turn, oc AS parent_conv, ot AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, oc = conv_id DESC, oc DESC, ot DESC) AS rk FROM (SELECT conv_id, turn, oc, ot, sum(chars) AS chars FROM c WHERE linked AND level = 1 GROUP BY 1, 2, 3, 4)) WHERE rk = 1),
r AS (SELECT conv_id, turn, parent_conv AS rc, parent_turn AS rt, CAST(1 AS BIGINT) AS depth FROM a UNION ALL SELECT r.conv_id, r.turn, a.parent_conv, a.parent_turn, depth + 1 FROM r JOIN a ON a.conv_id = rc AND a.turn = rt),
z AS (SELECT conv_id, turn, arg_max(rc, depth) AS rc, arg_max(rt, depth) AS rt, max(depth) AS depth FROM r GROUP BY 1, 2),
e AS (SELECT o.conv_id, o.turn, o.role, own AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, parent_conv, parent_turn, coalesce(rc, o.conv_id) AS thread_conv, coalesce(rt, min(o.turn) OVER (PARTITION BY o.conv_id)) AS thread_turn, coalesce(depth, 0) AS depth FROM (SELECT * FROM o WHERE conv_id IS NOT NULL AND turn IS NOT NULL) o LEFT JOIN n USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn))
SELECT *, row_number() OVER (PARTITION BY thread_conv, thread_turn ORDER BY conv_id, turn, role NULLS FIRST, text) - 1 AS position FROM e
UNION ALL SELECT conv_id, turn, role, own, 0, 0, NULL, NULL, NULL, NULL, 0, NULL FROM o WHERE conv_id IS NULL OR turn IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC, "op6_chat_quotation": QUOTATION, "op7_minhash_near_dedup": NEAR_DEDUP, "op9_decontamination": DECONTAMINATION}
