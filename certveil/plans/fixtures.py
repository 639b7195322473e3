"""Inputs of the registered queries, each as a DataFrame and as DuckDB SQL that gives the same rows.

``FORMS`` are documents built from the customer table, full of personal data in known places.
``LINES`` read order lines as spans: a document per order, candidates, gold and tokens by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt

GIVEN = ["Melanie", "Jordan", "Greta", "Thomas", "Priya", "Xandra", "Zoltan"]
FAMILY = ["Carter", "Lindberg", "Hartfield", "Okafor", "Smith", "Zhao", "Morton", "Quist"]

_FORM = """
SELECT doc_id,
  'Applicant: ' || g || ' ' || s || chr(10) || 'SSN: ' || ssn || chr(10) || 'Card: ' || card || chr(10) || 'Email: ' || email || chr(10)
  || 'Date of birth: ' || dob || chr(10) || 'Account number: ' || acct || chr(10) || 'IBAN ' || iban || chr(10)
  || 'Call ' || phone || ' about wire ' || acct || '. Dr. ' || h || ' ' || t || ' signed at ' || house || ' Maple Street, Spring Field, CA 90210.' AS text, g, s, h, t, ssn, card, email, dob, acct, iban, phone, house
FROM (
  SELECT c_custkey AS doc_id, {given1} AS g, {family1} AS s, {given2} AS h, {family2} AS t,
    lpad(CAST(c_custkey % 950 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 90 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 9999 AS STRING), 4, '0') AS ssn,
    '45' || lpad(CAST((c_custkey * 7919) % 100000000000000 AS STRING), 14, '0') AS card,
    lower({given1}) || '.' || lower({family1}) || CAST(c_custkey AS STRING) || '@example.com' AS email,
    lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '/' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '/' || CAST(1950 + c_custkey % 50 AS STRING) AS dob,
    lpad(CAST((c_custkey * 104729) % 10000000000 AS STRING), 10, '7') AS acct,
    'DE' || lpad(CAST(c_custkey % 97 AS STRING), 2, '0') || lpad(CAST((c_custkey * 15485863) % 1000000000000 AS STRING), 18, '3') AS iban,
    '(' || CAST(200 + c_custkey % 700 AS STRING) || ') 555-' || lpad(CAST(c_custkey % 9999 AS STRING), 4, '0') AS phone,
    CAST(1 + c_custkey % 99 AS STRING) AS house
  FROM {customer}) AS parts
"""


def _form(pick, customer: str) -> str:
    return _FORM.format(given1=pick(GIVEN, "c_custkey"), family1=pick(FAMILY, "c_custkey"), given2=pick(GIVEN, "c_custkey + 3"), family2=pick(FAMILY, "c_custkey * 3 + 1"), customer=customer)


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# What each field of a form is: its type, what stands before it, its value.
_FIELDS = (
    ("PERSON", "'Applicant: '", "g || ' ' || s"), ("SSN", "'SSN: '", "ssn"), ("CREDIT_CARD", "'Card: '", "card"), ("EMAIL", "'Email: '", "email"), ("DOB", "'birth: '", "dob"), ("ACCOUNT_NUMBER", "'number: '", "acct"),
    ("IBAN", "'IBAN '", "iban"), ("PHONE", "'Call '", "phone"), ("ACCOUNT_NUMBER", "'wire '", "acct"), ("PERSON", "'Dr. '", "h || ' ' || t"), ("ADDRESS", "'signed at '", "house || ' Maple Street, Spring Field, CA 90210'"),
)


def _gold(forms: str) -> str:
    parts = [f"SELECT doc_id, {k} AS gid, '{kind}' AS type, instr(text, {before} || {value}) - 1 + length({before}) AS start, length({value}) AS n FROM f" for k, (kind, before, value) in enumerate(_FIELDS)]
    return f"""WITH f AS ({forms}) SELECT doc_id, CAST(gid AS BIGINT) AS gid, type, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end" FROM ({' UNION ALL '.join(parts)}) AS u"""


FORMS_ALL = _form(lambda words, at: f"([{_list(words)}])[1 + ({at}) % {len(words)}]", "customer").replace("\n", " ")
FORMS_SQL = f"SELECT doc_id, text FROM ({FORMS_ALL}) AS f"
FORM_GOLD_SQL = _gold(FORMS_ALL)


def _spark_forms(sql, spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, at: f"array({_list(words)})[cast(({at}) % {len(words)} as int)]"
    text = sql(_form(pick, "{customer}").replace("chr(10)", "char(10)")).replace('"end"', "`end`")
    return spark.sql(text, customer=dealt(table(spark, sf_dir, "customer")))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_forms(lambda f: f"SELECT doc_id, text FROM ({f}) AS f", spark, sf_dir)


def form_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, gid, type, start, end): where the personal data of the forms stand."""
    return _spark_forms(_gold, spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that stand in fewer splits than there are cores (a small single file) are dealt out; large ones have splits enough."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name == "documents" else rows


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import fold_accents

    return table(spark, sf_dir, "documents").select("doc_id", fold_accents(F.col("text")).alias("text"))


FOLDED_SQL = "SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ž]', '_', 'g') AS text FROM documents"


def find_sql(pattern: str, docs: str) -> str:
    """The matches of ``pattern`` in the CTE ``docs``, as finditer() gives them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, x.s AS start, x.s + length(x.m) AS "end", x.m AS match FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'s': CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT), 'm': ms[i]}})) AS x
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM {docs}) WHERE len(ms) > 0)"""


def context_sql(spans: str, docs: str, width: int = 48) -> str:
    return f"""SELECT c.*, lower(substring(d.text, CAST(greatest(0, c.start - {width}) + 1 AS INT), CAST(c."end" + {width} - greatest(0, c.start - {width}) AS INT))) AS context FROM ({spans}) c JOIN {docs} d USING (doc_id)"""


LUHN_SQL = """coalesce(CASE WHEN length({d}) BETWEEN 12 AND 19 THEN list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * (ascii(substring(reverse({d}), CAST(i AS INT), 1)) - 48)) // 10 + (2 * (ascii(substring(reverse({d}), CAST(i AS INT), 1)) - 48)) % 10 ELSE ascii(substring(reverse({d}), CAST(i AS INT), 1)) - 48 END)) % 10 = 0 END, false)"""
LINES_SQL = "(SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2) AS x"
_KIND = "CASE {c} WHEN 'A' THEN 'PERSON' WHEN 'N' THEN 'EMAIL' ELSE 'IBAN' END"

CANDIDATES_SQL = f"""SELECT l_orderkey AS doc_id, l_linenumber AS cand, {_KIND.format(c='l_returnflag')} AS type, 10 * l_linenumber AS start, 10 * l_linenumber + 3 + CAST(l_partkey % 6 AS INT) AS "end", round(l_discount * 8 + 0.1 + l_tax, 2) AS score FROM {LINES_SQL}"""
GOLD_SQL = f"""SELECT l_orderkey AS doc_id, l_linenumber AS gid, CASE WHEN l_suppkey % 5 = 0 THEN 'EMAIL' ELSE {_KIND.format(c='l_returnflag')} END AS type, 10 * l_linenumber + CAST(l_suppkey % 3 AS INT) AS start, 10 * l_linenumber + 5 + CAST(l_suppkey % 3 AS INT) AS "end" FROM {LINES_SQL} WHERE l_partkey % 3 = 0"""
TOKENS_SQL = """SELECT o_orderkey AS doc_id, k, 6 * k AS start, 6 * k + 5 AS "end" FROM orders CROSS JOIN (SELECT unnest(range(0, 14)) AS k)"""


def lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace('"end"', "`end`").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, CANDIDATES_SQL)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, GOLD_SQL)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k"))
    return orders.select("doc_id", "k", (6 * F.col("k")).alias("start"), (6 * F.col("k") + 5).alias("end"))
