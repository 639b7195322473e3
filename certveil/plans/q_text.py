"""Queries over text: scalars, spans, labels, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import checksums as C
from ..functions import text as T
from ..operators import graph, labels, spans
from . import sql_spans as Q
from .fixtures import FOLDED_SQL, FORMS_SQL, LUHN_SQL, context_sql, find_sql, folded, forms, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _out(df):
    return df.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "type", F.round("score", 6).alias("score"))


def _with(docs_sql: str, body: str) -> str:
    return f"WITH d AS ({docs_sql}) {body}"


def _spans_sql(docs_sql: str, kind: str, pattern: str, score: str, where: str = "", context: bool = False) -> str:
    found = find_sql(pattern, "d")
    src = context_sql(found, "d") if context else found
    return _with(docs_sql, f"""SELECT doc_id, start AS span_start, "end" AS span_end, '{kind}' AS type, CAST({score} AS DOUBLE) AS score FROM ({src}) {where}""")


_SPAN = 'SELECT doc_id, start AS span_start, "end" AS span_end, type, round(score, 6) AS score FROM'
_LUHN, _MOD97, _iban_sql, _ssn_sql, _words, _PERSON, _BARE = Q.LUHN, Q.MOD97, Q.iban, Q.ssn, Q.words, Q.PERSON, Q.BARE


@query("span_email", _spans_sql(FOLDED_SQL, "EMAIL", S.EMAIL, "0.97"))
def span_email(spark, d):
    return _out(spans.rule_spans(folded(spark, d), ["EMAIL"], suppress=False))


@query("span_card_luhn", _spans_sql(FOLDED_SQL, "CREDIT_CARD", S.CARD, f"CASE WHEN {_LUHN} THEN 0.98 ELSE 0.35 END"))
def span_card_luhn(spark, d):
    return _out(spans.rule_spans(folded(spark, d), ["CREDIT_CARD"], suppress=False))


@query("span_phone_ctx", _spans_sql(FOLDED_SQL, "PHONE", S.PHONE, f"CASE WHEN regexp_matches(context, '{S.CONTEXT['PHONE']}') THEN 0.92 ELSE 0.55 END", context=True))
def span_phone_ctx(spark, d):
    return _out(spans.rule_spans(folded(spark, d), ["PHONE"], suppress=False))


@query("span_cap_bigram", _spans_sql(FOLDED_SQL, "PERSON", S.CAP_BIGRAM, "0.40"))
def span_cap_bigram(spark, d):
    rows = T.finditer(folded(spark, d), S.CAP_BIGRAM)
    return _out(rows.withColumns({"type": F.lit("PERSON"), "score": F.lit(0.40)}))


@query("span_account_ctx", _spans_sql(FORMS_SQL, "ACCOUNT_NUMBER", S.ACCOUNT, "0.88", f"WHERE regexp_matches(context, '{S.CONTEXT['ACCOUNT_NUMBER']}')", context=True))
def span_account_ctx(spark, d):
    return _out(spans.rule_spans(forms(spark, d), ["ACCOUNT_NUMBER"], suppress=False))


@query("span_iban", _spans_sql(FORMS_SQL, "IBAN", S.IBAN, f"CASE WHEN {_iban_sql('match')} THEN 0.99 ELSE 0.40 END"))
def span_iban(spark, d):
    return _out(spans.rule_spans(forms(spark, d), ["IBAN"], suppress=False))


@query("span_ssn_dashed", _spans_sql(FORMS_SQL, "SSN", S.SSN_DASHED, f"CASE WHEN {_ssn_sql('match')} THEN 0.96 ELSE 0.50 END"))
def span_ssn_dashed(spark, d):
    rows = T.finditer(forms(spark, d), S.SSN_DASHED)
    return _out(rows.withColumns({"type": F.lit("SSN"), "score": F.when(C.ssn_plausible(F.col("match")), 0.96).otherwise(0.50)}))


@query("span_dob_ctx", _spans_sql(FORMS_SQL, "DOB", S.DATE, f"CASE WHEN regexp_matches(context, '{S.CONTEXT['DOB']}') THEN 0.90 ELSE 0.20 END", context=True))
def span_dob_ctx(spark, d):
    return _out(spans.rule_spans(forms(spark, d), ["DOB"], suppress=False))


@query("span_address", _spans_sql(FORMS_SQL, "ADDRESS", S.ADDRESS, "CASE WHEN regexp_matches(match, '[0-9]{5}$') THEN 0.92 ELSE 0.80 END"))
def span_address(spark, d):
    return _out(spans.rule_spans(forms(spark, d), ["ADDRESS"], suppress=False))


def _group_sql(pattern: str, score: float) -> str:
    inner = f"regexp_extract(match, '({S.NAME})$', 1)"
    return f"""SELECT doc_id, "end" - length({inner}) AS span_start, "end" AS span_end, 'PERSON' AS type, CAST({score} AS DOUBLE) AS score FROM ({find_sql(pattern, 'd')})"""


@query("span_title_and_role", _with(FORMS_SQL, f"{_group_sql(S.HONORIFIC, 0.85)} UNION ALL {_group_sql(S.ROLE, 0.78)}"))
def span_title_and_role(spark, d):
    return _out(spans.apply_rules(forms(spark, d), [r for r in spans.RULES if r.inner]))


@query("span_titlecase_person", _spans_sql(FORMS_SQL, "PERSON", S.TITLE_RUN, f"CASE WHEN list_contains({_words(S.GIVEN_NAMES)}, ({_BARE})[1]) THEN 0.82 ELSE 0.62 END", f"WHERE {_PERSON}"))
def span_titlecase_person(spark, d):
    return _out(spans.title_case_persons(forms(spark, d)))


@query("span_labelled_field", f"WITH d AS ({FORMS_SQL}) {_SPAN} ({Q.FIELDS})")
def span_labelled_field(spark, d):
    return _out(spans.labelled_fields(forms(spark, d)))


@query("shape_signature", """SELECT token, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 1 AND c[i] = c[i-1] THEN '' ELSE c[i] END), '') AS shape, n FROM (
    SELECT token, count(*) AS n, list_transform(string_split(token, ''), lambda x: CASE WHEN regexp_full_match(x, '\\p{Ll}') THEN 'l' WHEN regexp_full_match(x, '\\p{Lu}') THEN 'U' WHEN regexp_full_match(x, '\\p{Nd}') THEN 'd' ELSE x END) AS c
    FROM (SELECT unnest(regexp_extract_all(text, '[^\\s,;|]+')) AS token FROM documents) GROUP BY token)""")
def shape_signature(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s,;|]+"), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return rows.select("token", T.shape_signature(F.col("token")).alias("shape"), "n")


@query("span_shape", f"WITH RECURSIVE d AS ({FORMS_SQL}), a AS MATERIALIZED ({Q.SHAPES}), {Q.suppressed('a', 'b', 'doc_id, type')} {_SPAN} b")
def span_shape(spark, d):
    return _out(spans.shape_spans(forms(spark, d)))


@query("span_rules", f"WITH RECURSIVE d AS ({FOLDED_SQL}), a AS MATERIALIZED ({Q.RULES}), {Q.suppressed('a', 'b', 'doc_id, type')} {_SPAN} b")
def span_rules(spark, d):
    return _out(spans.rule_spans(folded(spark, d)))


@query("span_heuristics", f"WITH RECURSIVE d AS ({FORMS_SQL}), a AS MATERIALIZED ({Q.HEURISTICS}), {Q.suppressed('a', 'b', 'doc_id, type')} {_SPAN} b")
def span_heuristics(spark, d):
    return _out(spans.heuristic_spans(forms(spark, d)))


@query("span_ensemble_merge", f"WITH RECURSIVE d AS ({FORMS_SQL}), {Q.MERGED} {_SPAN} m")
def span_ensemble_merge(spark, d):
    return _out(spans.ensemble(forms(spark, d)))


_PAIRS = f"SELECT l_orderkey AS doc_id, 'x' AS engine, l_returnflag AS type, CAST(20 * (l_linenumber // 2) + l_partkey % 7 AS BIGINT) AS start, CAST(20 * (l_linenumber // 2) + 10 + l_suppkey % 5 AS BIGINT) AS \"end\", round(l_discount + l_linenumber / 1000.0, 4) AS score FROM lineitem"


@query("span_nms", f"""WITH RECURSIVE s AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY score DESC, start, "end") AS k FROM s),
    w AS (SELECT doc_id, type, k, [{{'s': start, 'e': "end"}}] AS kept, true AS ok FROM r WHERE k = 1
      UNION ALL SELECT r.doc_id, r.type, r.k, CASE WHEN hit THEN kept ELSE list_append(kept, {{'s': r.start, 'e': r."end"}}) END, NOT hit FROM
        (SELECT r.*, w.kept, coalesce(list_bool_or(list_transform(w.kept, lambda x: CASE WHEN least(x.e, r."end") > greatest(x.s, r.start) THEN (least(x.e, r."end") - greatest(x.s, r.start)) / CAST(greatest(x.e, r."end") - least(x.s, r.start) AS DOUBLE) ELSE 0 END > 0.5)), false) AS hit FROM w JOIN r ON r.doc_id = w.doc_id AND r.type = w.type AND r.k = w.k + 1) r)
    SELECT r.doc_id, r.start AS span_start, r."end" AS span_end, r.type, r.score FROM r JOIN w USING (doc_id, type, k) WHERE w.ok""")
def span_nms(spark, d):
    rows = spark.sql(_PAIRS.replace("//", "div").replace('"end"', "`end`").replace("FROM lineitem", "FROM {t}").replace("/ 1000.0", "/ 1000D"), t=table(spark, d, "lineitem"))
    return _out(spans.dedupe_overlaps(rows.withColumn("match", F.lit(""))))


_NUMBERS = "SELECT o_orderkey AS k, '4' || lpad(CAST((o_orderkey * 7919 + o_custkey) % 1000000000000000 AS STRING), CAST(11 + o_orderkey % 8 AS INT), '5') AS number, 'GB' || lpad(CAST(o_orderkey % 97 AS STRING), 2, '0') || 'WEST' || lpad(CAST((o_orderkey * 104729) % 100000000000000 AS STRING), 14, '0') AS iban, lpad(CAST((o_orderkey * 1000003) % 1000000000 AS STRING), 9, '0') AS ssn FROM orders"


def _numbers(spark, d):
    return spark.sql(_NUMBERS.replace("FROM orders", "FROM {o}"), o=table(spark, d, "orders"))


@query("checksum_luhn", f"SELECT k, number, {LUHN_SQL.format(d='number')} AS valid, CASE WHEN {LUHN_SQL.format(d='number')} THEN 'luhn-ok' ELSE 'luhn-bad' END AS class FROM ({_NUMBERS})")
def checksum_luhn(spark, d):
    return _numbers(spark, d).select("k", "number", C.luhn_valid(F.col("number")).alias("valid"), C.checksum_class(F.col("number"), F.lit("CREDIT_CARD")).alias("class"))


@query("luhn_check_digit", f"SELECT k, (SELECT list_min(list_filter(range(0, 10), lambda c: list_sum(list_transform(range(1, length(number) + 2), lambda i: CASE WHEN i % 2 = 0 THEN (2 * (ascii(substring(reverse(number || c), CAST(i AS INT), 1)) - 48)) // 10 + (2 * (ascii(substring(reverse(number || c), CAST(i AS INT), 1)) - 48)) % 10 ELSE ascii(substring(reverse(number || c), CAST(i AS INT), 1)) - 48 END)) % 10 = 0))) AS digit FROM ({_NUMBERS})")
def luhn_check_digit(spark, d):
    return _numbers(spark, d).select("k", C.luhn_check_digit(F.col("number")).cast("long").alias("digit"))


@query("checksum_iban", f"""SELECT k, {_iban_sql('iban')} AS valid, CASE WHEN {_iban_sql('iban')} THEN 'iso7064-ok' ELSE 'iso7064-bad' END AS class, 'GB' || lpad(CAST(98 - {_MOD97.format(s="(substring(iban, 5) || 'GB00')")} AS STRING), 2, '0') || substring(iban, 5) AS built FROM ({_NUMBERS})""")
def checksum_iban(spark, d):
    return _numbers(spark, d).select("k", C.iban_valid(F.col("iban")).alias("valid"), C.checksum_class(F.col("iban"), F.lit("IBAN")).alias("class"), C.make_iban(F.lit("GB"), F.substring("iban", 5, 64)).alias("built"))


@query("ssn_rules", f"SELECT k, {_ssn_sql('ssn')} AS plausible FROM ({_NUMBERS})")
def ssn_rules(spark, d):
    return _numbers(spark, d).select("k", C.ssn_plausible(F.col("ssn")).alias("plausible"))


_NAMES = "SELECT c_custkey AS k, c_name || CASE c_custkey % 3 WHEN 0 THEN ', Dr. ' ELSE ' - ' END || c_mktsegment AS name FROM customer"
_FOLD = "regexp_replace(lower(name), '[\\s\\-_./()]', '', 'g')"
_TOK = f"list_sort(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_words(S.ROLE_WORDS)}, t)))"


@query("norm_value", f"SELECT k, CASE WHEN len({_TOK}) > 0 THEN array_to_string({_TOK}, '|') ELSE {_FOLD} END AS person, {_FOLD} AS folded, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS canonical FROM ({_NAMES})")
def norm_value(spark, d):
    rows = spark.sql(_NAMES.replace("FROM customer", "FROM {c}"), c=table(spark, d, "customer"))
    n = F.col("name")
    return rows.select("k", T.normalise_value(n, F.lit("PERSON")).alias("person"), T.normalise_value(n, F.lit("ADDRESS")).alias("folded"), T.canonicalise(n).alias("canonical"))


_LABELS = "SELECT CASE l_linenumber WHEN 1 THEN 'first_name' WHEN 2 THEN 'api_key' WHEN 3 THEN 'Date-Of Birth' WHEN 4 THEN 'dob' WHEN 5 THEN 'E_MAIL' WHEN 6 THEN 'EMAIL' ELSE 'National_ID' END AS label FROM lineitem"
_UP = "translate(upper(label), '- ', '__')"


@query("label_map_stats", f"""SELECT label, type, n, coalesce(list_contains({_words(S.FINANCE_TYPES)}, type), false) AS kept FROM (SELECT label, count(*) AS n,
    CASE WHEN list_contains({_words(S.CANONICAL_TYPES)}, {_UP}) THEN {_UP} ELSE CASE {_UP} {' '.join(f"WHEN '{k.upper()}' THEN '{v}'" for k, v in S.GRETEL_LABELS.items())} END END AS type FROM ({_LABELS}) GROUP BY label)""")
def label_map_stats(spark, d):
    return labels.label_stats(spark.sql(_LABELS.replace("FROM lineitem", "FROM {t}"), t=table(spark, d, "lineitem")), S.GRETEL_LABELS)


@query("split_cal_test", """WITH d AS (SELECT doc_id, doc_id % 9 = 0 AS is_dup, md5(doc_id || '|7') AS key FROM documents), u AS (SELECT key, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM d WHERE NOT is_dup)
    SELECT doc_id, is_dup, CASE WHEN NOT is_dup AND key <= (SELECT max(key) FROM u WHERE rn <= least(greatest(1, CAST(round_even(0.4 * n, 0) AS BIGINT)), n - 1)) THEN 'calibration' ELSE 'test' END AS part FROM d""")
def split_cal_test(spark, d):
    return labels.split(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 9 == 0).alias("is_dup"))).select("doc_id", "is_dup", "part")


@query("corpus_info", "SELECT lang, count(*) AS docs, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def corpus_info(spark, d):
    return labels.corpus_info(table(spark, d, "documents")).select("lang", "docs", F.round("mean_chars", 6).alias("mean_chars"), F.col("max_chars").cast("long").alias("max_chars"), "sources")


_RAW = "SELECT doc_id, doc_id % 50 AS start, doc_id % 50 + 5 AS \"end\", CASE doc_id % 3 WHEN 0 THEN translate(substring(text, CAST(doc_id % 50 + 1 AS INT), 5), 'aehinorst', 'AEHINORST') WHEN 1 THEN substring(text, CAST(doc_id % 50 + 1 AS INT), 5) ELSE 'zzzzz' END AS text FROM documents"


@query("verify_spans", f"""SELECT count(DISTINCT g.doc_id) AS docs, count(*) AS spans, count(*) FILTER (WHERE NOT ok) AS out_of_range, count(*) FILTER (WHERE ok AND real <> said AND lower(real) = lower(said)) AS case_only, count(*) FILTER (WHERE ok AND lower(real) <> lower(said)) AS mismatched FROM (
    SELECT r.doc_id, r.text AS said, r."end" <= length(d.text) AS ok, substring(d.text, CAST(r.start + 1 AS INT), 5) AS real FROM ({_RAW}) r JOIN documents d USING (doc_id)) g""")
def verify_spans(spark, d):
    docs = table(spark, d, "documents")
    raw = spark.sql(_RAW.replace('"end"', "`end`").replace("FROM documents", "FROM {t}"), t=docs)
    return labels.inspect(raw, docs)


@query("exact_dups", "SELECT doc_id, h AS content_hash, first_id, doc_id <> first_id AS is_dup FROM (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS first_id FROM (SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS h FROM documents))")
def exact_dups(spark, d):
    return graph.exact_duplicates(table(spark, d, "documents"))


_SHINGLES = "SELECT DISTINCT doc_id, CAST(('0x' || substring(md5(array_to_string(w[i:i+4], ' ')), 1, 8)) AS BIGINT) % 2147483647 AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)"
_COEF = graph.coefficients(128)
_MINHASH = f"SELECT doc_id, [{', '.join(f'min((h * {a} + {b}) % 2147483647)' for a, b in _COEF)}] AS sig FROM ({_SHINGLES}) GROUP BY doc_id"


@query("minhash_pairs", f"""WITH s AS MATERIALIZED ({_MINHASH}), g AS (SELECT sig, min(doc_id) AS doc_id FROM s GROUP BY sig), b AS (SELECT doc_id, unnest(range(0, 32)) AS band, sig FROM g), k AS (SELECT doc_id, band, sig, sig[4*band+1:4*band+4] AS key FROM b),
    p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.sig AS sa, y.sig AS sb FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id)
    SELECT a, b, list_sum(list_transform(range(1, 129), lambda i: CASE WHEN sa[i] = sb[i] THEN 1 ELSE 0 END)) / 128.0 AS agreement FROM p""")
def minhash_pairs(spark, d):
    """128 permutations, 32 bands of 4."""
    sig = graph.signatures(table(spark, d, "documents").select("doc_id", "text"), 128)
    return graph.lsh_pairs(sig, 32).select("a", "b", F.col("agreement").cast("double").alias("agreement"))


@query("neighbours", f"""WITH s AS MATERIALIZED ({_MINHASH}), g AS (SELECT sig, min(doc_id) AS doc_id FROM s GROUP BY sig), k AS (SELECT doc_id, band, sig, sig[4*band+1:4*band+4] AS key FROM (SELECT doc_id, unnest(range(0, 32)) AS band, sig FROM g)),
    p AS (SELECT DISTINCT x.doc_id AS doc_id, y.doc_id AS other, x.sig AS sa, y.sig AS sb FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.doc_id <> y.doc_id),
    q AS (SELECT doc_id, other, list_sum(list_transform(range(1, 129), lambda i: CASE WHEN sa[i] = sb[i] THEN 1 ELSE 0 END)) / 128.0 AS agreement FROM p) SELECT * FROM q WHERE agreement >= 0.6""")
def neighbours(spark, d):
    sig = graph.signatures(table(spark, d, "documents").select("doc_id", "text"), 128)
    return graph.neighbours(graph.lsh_pairs(sig, 32), 0.6).withColumn("agreement", F.col("agreement").cast("double"))


@query("duplicate_of", f"""WITH s AS MATERIALIZED ({_MINHASH}), h AS MATERIALIZED ({_SHINGLES}), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1), g AS (SELECT sig, min(doc_id) AS doc_id FROM s GROUP BY sig),
    k AS (SELECT doc_id, band, sig[4*band+1:4*band+4] AS key FROM (SELECT doc_id, unnest(range(0, 32)) AS band, sig FROM g)),
    p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id UNION SELECT g.doc_id, s.doc_id FROM s JOIN g USING (sig) WHERE s.doc_id <> g.doc_id),
    j AS (SELECT a, b, count(*) AS shared FROM p JOIN h x ON x.doc_id = a JOIN h y ON y.doc_id = b AND y.h = x.h GROUP BY 1, 2),
    e AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY c ORDER BY doc_id) AS first_id FROM (SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS c FROM documents)),
    m AS (SELECT b, first(a ORDER BY v DESC, a) AS near FROM (SELECT a, b, shared / CAST(na.n + nb.n - shared AS DOUBLE) AS v FROM j JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b) WHERE v >= 0.75 GROUP BY b)
    SELECT e.doc_id, CASE WHEN e.doc_id <> first_id THEN first_id ELSE near END AS original FROM e LEFT JOIN m ON m.b = first_id""")
def duplicate_of(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    sig = graph.signatures(docs, 128)
    pairs = graph.lsh_pairs(sig, 32).select("a", "b").unionByName(graph.equal_signatures(sig))
    return graph.duplicate_of(docs, graph.full_agreement(pairs, graph.word_shingles(docs)), 0.75)


@query("lsh_curve", "SELECT l_linenumber, round(1 - pow(1 - pow(l_discount * 10, 4), 32), 9) AS p, count(*) AS n FROM lineitem GROUP BY 1, 2")
def lsh_curve(spark, d):
    from ..functions.stats import collision_probability

    p = F.round(collision_probability(F.col("l_discount") * 10, 32, 4), 9)
    return table(spark, d, "lineitem").groupBy("l_linenumber", p.alias("p")).agg(F.count("*").alias("n"))


@query("shape_features", "SELECT doc_id, round(ln(1 + length(text)) / 10, 9) AS f_length, round(len(regexp_extract_all(text, '\\S+')) / CAST(greatest(length(text), 1) AS DOUBLE), 9) AS f_tokens, round(len(regexp_extract_all(text, '[0-9]')) / CAST(greatest(length(text), 1) AS DOUBLE), 9) AS f_digits, round(len(regexp_extract_all(text, '[A-Z]')) / CAST(greatest(length(text), 1) AS DOUBLE), 9) AS f_upper, round(len(regexp_extract_all(text, chr(10))) / CAST(greatest(length(text), 1) AS DOUBLE), 9) AS f_lines FROM documents")
def shape_features(spark, d):
    rows = table(spark, d, "documents").select("doc_id", *T.shape_statistics(F.col("text")))
    return rows.select("doc_id", *[F.round(c, 9).alias(c) for c in ("f_length", "f_tokens", "f_digits", "f_upper", "f_lines")])


@query("token_offsets", f"SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(\"end\") AS BIGINT) AS ends FROM (SELECT doc_id, sum(g + n) OVER (PARTITION BY doc_id ORDER BY k) - n AS start, sum(g + n) OVER (PARTITION BY doc_id ORDER BY k) AS \"end\" FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, length(unnest(p[1:len(m)])) AS g, length(unnest(m)) AS n FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS m, string_split_regex(text, '\\S+') AS p FROM documents))) GROUP BY doc_id")
def token_offsets(spark, d):
    return T.tokens(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


# Replies of four kinds: two items (one absent from the text), a bare list, no JSON, an item without text.
_REPLIES = """SELECT c_custkey AS doc_id, c_name AS text, CASE c_custkey % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '[{"text": "' || right(c_name, 3) || '", "type": "person"}, {"text": "absent", "type": "EMAIL"}]' || chr(10) || '```'
    WHEN 1 THEN '[{"text": "' || left(c_name, 4) || '", "type": "Person"}, {"text": "' || right(c_name, 2) || '", "type": "ssn"}]' WHEN 2 THEN 'I found nothing.' ELSE '[{"text": "", "type": "DOB"}]' END AS reply FROM customer"""


@query("reply_parse", f"""WITH r AS ({_REPLIES}), i AS (SELECT doc_id, text, right(text, 3) AS t, 'PERSON' AS type FROM r WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, text, left(text, 4), 'PERSON' FROM r WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, text, right(text, 2), 'SSN' FROM r WHERE doc_id % 4 = 1)
    SELECT doc_id, CAST(instr(text, t) - 1 AS BIGINT) AS span_start, CAST(instr(text, t) - 1 + length(t) AS BIGINT) AS span_end, type, CAST(0.7 AS DOUBLE) AS score FROM i""")
def reply_parse(spark, d):
    rows = spark.sql(_REPLIES.replace("{", "{{").replace("}", "}}").replace("chr(10)", "char(10)").replace("FROM customer", "FROM {c}"), c=table(spark, d, "customer"))
    return _out(spans.parse_reply(rows))
