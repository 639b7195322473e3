"""Queries over shift, monitors, actions, streams and the whole pipeline."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import act, monitor, shift
from ..operators.spans import rule_spans
from ..schema import ROLE_WORDS
from ..session import materialised
from . import sql_spans as Q
from .fixtures import FOLDED_SQL, FORMS_SQL, forms, table

QUERIES, SQL = {}, {}
KEY = b"certveil test key"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# shift -----------------------------------------------------------------------
_SCORES = "SELECT doc_id AS pos, round(len(regexp_extract_all(text, '[aeiou]')) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS score, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS is_target FROM documents"


def _scores(spark, d):
    n = F.regexp_count("text", F.lit("[aeiou]")) / F.greatest(F.length("text"), F.lit(1)).cast("double")
    return table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.round(n, 6).alias("score"), (F.col("lang") != "en").cast("int").alias("is_target"))


@query("auc_rank", f"SELECT round((sum(CASE WHEN is_target = 1 THEN r END) - t * (t + 1) / 2) / (t * s), 9) AS auc FROM (SELECT is_target, row_number() OVER (ORDER BY score, is_target) AS r, sum(is_target) OVER () AS t, sum(1 - is_target) OVER () AS s FROM ({_SCORES})) GROUP BY t, s")
def auc_rank(spark, d):
    return shift.auc_by_rank(_scores(spark, d)).select(F.round("auc", 9).alias("auc"))


@query("overlap_stat", f"WITH x AS ({_SCORES}), q AS (SELECT quantile_cont(score, 0.05) FILTER (WHERE is_target = 1) AS lo, quantile_cont(score, 0.95) FILTER (WHERE is_target = 0) AS hi FROM x) SELECT round(avg(CASE WHEN is_target = 0 THEN CASE WHEN score >= lo THEN 1.0 ELSE 0.0 END END) * avg(CASE WHEN is_target = 1 THEN CASE WHEN score <= hi THEN 1.0 ELSE 0.0 END END), 9) AS overlap FROM x CROSS JOIN q")
def overlap_stat(spark, d):
    return shift.overlap(_scores(spark, d)).select(F.round("overlap", 9).alias("overlap"))


_ODDS = "SELECT o_orderkey AS pos, (1 + o_custkey % 97) / 100.0 AS p FROM orders"
_RATIO = f"WITH o AS (SELECT pos, p / (1 - p) AS o FROM ({_ODDS})), c AS (SELECT pos, least(o, (SELECT quantile_cont(o, 0.99) FROM o)) AS o FROM o), w AS (SELECT pos, o / avg(o) OVER () AS w FROM c)"


def _ratio(spark, d):
    return shift.clipped_ratio(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), ((1 + F.col("o_custkey") % 97) / 100.0).alias("p")))


@query("ratio_clip", f"{_RATIO} SELECT pos, round(w, 9) AS w FROM w")
def ratio_clip(spark, d):
    return _ratio(spark, d).withColumn("w", F.round("w", 9))


@query("chi2_div", f"{_RATIO} SELECT round(avg(pow(w - 1, 2)) / 2, 9) AS rho FROM w")
def chi2_div(spark, d):
    return _ratio(spark, d).agg(F.round(shift.chi2_divergence(F.col("w")), 9).alias("rho"))


@query("tv_inflation", f"{_RATIO} SELECT round(2.0 * least(1.0, avg(abs(w - 1)) / 2), 9) AS by_error, round(2.0 * least(1.0, sqrt(avg(pow(w - 1, 2)) / 2 / 2)), 9) AS by_chi2, round(2.0 * least(1.0, avg(abs(w - 1)) / 2), 9) AS by_tv FROM w")
def tv_inflation(spark, d):
    rows = _ratio(spark, d).agg(F.avg(F.abs(F.col("w") - 1)).alias("e"), shift.chi2_divergence(F.col("w")).alias("c"))
    ways = {"by_error": {"mean_abs_error": F.col("e")}, "by_chi2": {"chi2": F.col("c")}, "by_tv": {"tv": F.col("e") / 2}}
    return rows.select(*[F.round(stats.tv_inflation(2.0, **way), 9).alias(name) for name, way in ways.items()])


_UCB = "greatest(0.0, least(1.0, m {s} least(sqrt({l} / (2 * n)), sqrt(2 * v * {b} / n) + 7 * {b} / (3 * (n - 1)))))"


@query("ucb_mean", "SELECT k, round({u}, 9) AS upper, round({d}, 9) AS lower FROM (SELECT l_linenumber AS k, count(*) AS n, avg(l_discount) AS m, var_samp(l_discount) AS v FROM lineitem GROUP BY 1)".format(u=_UCB.format(s="+", l=math.log(20), b=math.log(20)), d=_UCB.format(s="-", l=math.log(20), b=math.log(20))))
def ucb_mean(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"), F.var_samp("l_discount").alias("v"))
    a = (F.col("m"), F.col("v"), F.col("n"), 0.05)
    return x.select("k", F.round(stats.upper_mean(*a), 9).alias("upper"), F.round(stats.upper_mean(*a, sign=-1), 9).alias("lower"))


@query("dro_worst_case", "WITH h AS (SELECT l_discount AS loss, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT (SELECT min(loss) FROM h) - 1 + i / 511.0 * ((SELECT max(loss) FROM h) - (SELECT min(loss) FROM h) + 1) AS eta FROM (SELECT unnest(range(0, 512)) AS i)) SELECT round(min(v), 8) AS worst FROM (SELECT eta + sqrt(1 + 2 * 0.3) * sqrt(sum(n * pow(greatest(loss - eta, 0), 2)) / sum(n)) AS v FROM h CROSS JOIN e GROUP BY eta)")
def dro_worst_case(spark, d):
    h = shift.loss_histogram(table(spark, d, "lineitem").select(F.col("l_discount").alias("loss")))
    return shift.dro_worst_case(h, 0.3).select(F.round("worst", 8).alias("worst"))


def _histogram(spark, d):
    import numpy as np

    rows = shift.loss_histogram(table(spark, d, "lineitem").select(F.col("l_discount").alias("loss"))).orderBy("loss").collect()  # distinct losses
    return np.array([r.loss for r in rows]), np.array([r.n for r in rows], float)


def _upper(x: str, log: str, most: str) -> str:
    """Mean and slack of ``x`` over the histogram (loss, n) of all lines, as a struct (m, s)."""
    mean, var = f"(sum(n * {x}) / sum(n))", f"((sum(n * pow({x}, 2)) - sum(n) * pow(sum(n * {x}) / sum(n), 2)) / (sum(n) - 1))"
    return f"{{'m': {mean}, 's': least({most} * sqrt({log} / (2 * sum(n))), sqrt(2 * greatest(0, {var}) * {log} / sum(n)) + 7 * {most} * {log} / (3 * (sum(n) - 1)))}}"


_FINITE = f"""WITH h AS (SELECT l_discount AS loss, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1), p AS (SELECT unnest([0.0, 0.1, 0.5, 1.0]) AS rho),
    b AS (SELECT sum(n * loss) / sum(n) AS m, sum(n * loss * loss) / sum(n) - pow(sum(n * loss) / sum(n), 2) AS v, max(loss) AS top, {_upper('loss', repr(math.log(20)), '1')} AS plain, {_upper('loss', repr(math.log(60)), '1')} AS one, {_upper('(loss * loss)', repr(math.log(60)), '1')} AS two FROM h),
    e AS (SELECT rho, unnest(list_distinct(list_concat(list_transform(range(0, 64), lambda i: -1 + i * (top + 1) / 63.0::DOUBLE), CASE WHEN m - sqrt(v / (2 * rho)) BETWEEN -1 AND top THEN [m - sqrt(v / (2 * rho))] ELSE [] END))) AS eta FROM p, b WHERE rho > 0),
    k AS (SELECT *, ln(60.0 * count(*) OVER (PARTITION BY rho)) AS lg, pow(1 - least(eta, 0), 2) AS most FROM e),
    z AS (SELECT rho, eta, any_value(most) AS most, {_upper('pow(greatest(loss - eta, 0), 2)', 'any_value(lg)', 'any_value(most)')} AS u FROM k, h GROUP BY rho, eta),
    g AS (SELECT rho, min(sqrt(1 + 2 * rho) * sqrt(least(most, u.m + u.s)) + eta) AS hinge FROM z GROUP BY rho)
    SELECT rho, round(CASE WHEN rho = 0 THEN least(1, plain.m + plain.s) ELSE least(1, greatest(0, least(hinge, least(1, one.m + one.s) + sqrt(2 * rho * greatest(0, least(1, two.m + two.s) - pow(greatest(0, one.m - one.s), 2)))))) END, 7) AS bound FROM p JOIN b ON true LEFT JOIN g USING (rho)"""


@query("dro_finite_sample", _FINITE)
def dro_finite_sample(spark, d):
    x, n = _histogram(spark, d)
    return spark.createDataFrame([(r, round(float(shift.finite_sample_worst_case(x, n, r)), 7)) for r in (0.0, 0.1, 0.5, 1.0)], "rho double, bound double")


@query("certified_radius")
def certified_radius(spark, d):
    x, n = _histogram(spark, d)
    rows = [(a, shift.certified_radius(x, n, a), shift.finite_radius(x, n, a)) for a in (0.06, 0.08, 0.1)]
    return spark.createDataFrame(rows, "alpha double, rho double, rho_finite double")


_U = "(CAST('0x' || substring(md5(pos || '|' || rep || '|rho'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"


@query("bootstrap_ci", f"{_RATIO}, k AS (SELECT rep, w, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.99634 THEN 4 ELSE 5 END AS k FROM (SELECT rep, w, {_U} AS u FROM w CROSS JOIN (SELECT unnest(range(1, 201)) AS rep))), r AS (SELECT rep, 0.5 * (sum(k * w * w) / sum(k) / pow(sum(k * w) / sum(k), 2) - 1) AS rho FROM k GROUP BY rep) SELECT round(quantile_cont(rho, 0.025), 8) AS lo, round(quantile_cont(rho, 0.975), 8) AS hi FROM r")
def bootstrap_ci(spark, d):
    return shift.bootstrap_rho(_ratio(spark, d)).select(F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("shift_audit")
def shift_audit(spark, d):
    """English documents against each other language, all of them."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    rows = []
    for lang in sorted(r.lang for r in docs.where("lang <> 'en'").select("lang").distinct().limit(64).collect()):
        r = shift.fit_density_ratio(docs.where("lang = 'en'").drop("lang"), docs.where(F.col("lang") == lang).drop("lang"))
        rows.append((lang, r.auc, r.overlap, r.separable, r.rho_hat))
    return spark.createDataFrame(rows, "lang string, auc double, overlap double, separable boolean, rho_hat double")


@query("discriminator_fit")
def discriminator_fit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("lang") == "en").cast("int").alias("target"))
    f = shift.featurise(docs.select("doc_id", "text")).join(docs.select("doc_id", "target"), "doc_id")
    beta = shift.fit_discriminator(f)
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "feature int, beta double")


# monitors ----------------------------------------------------------------------
_STREAM = "SELECT user_id % 8 AS series, event_id AS pos, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS x FROM events"


def _stream(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 8).alias("series"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").cast("double").alias("x"))


_FOLD = f"""WITH RECURSIVE s AS (SELECT series, pos, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY series ORDER BY pos) AS t FROM ({_STREAM})),
    f AS (SELECT series, CAST(0 AS BIGINT) AS t, CAST(1.0 AS DOUBLE) AS w, CAST(1.0 AS DOUBLE) AS peak, CAST(0.15 AS DOUBLE) AS mu, CAST(0.25 AS DOUBLE) AS v, CAST(NULL AS BIGINT) AS alarm FROM (SELECT DISTINCT series FROM s)
      UNION ALL SELECT series, t + 1, nw, greatest(peak, nw), nmu, CASE WHEN t = 0 THEN 0.0 ELSE v + ((x - mu) * (x - nmu) - v) / (t + 1) END, coalesce(alarm, CASE WHEN nw >= 20 THEN pos END) FROM (
        SELECT f.*, s.x, s.pos, greatest(1e-300, f.w * (1 + greatest(0.0, least(0.5 / 0.15, (f.mu - 0.15) / greatest(f.v, 1e-4))) * (s.x - 0.15))) AS nw, CASE WHEN f.t = 0 THEN s.x ELSE f.mu + (s.x - f.mu) / (f.t + 1) END AS nmu FROM f JOIN s ON s.series = f.series AND s.t = f.t + 1))"""


@query("eprocess_final", f"{_FOLD} SELECT series, round(ln(arg_max(w, t)), 6) AS log_wealth, round(ln(arg_max(peak, t)), 6) AS log_peak, CAST(max(t) AS INT) AS n, max(alarm) AS alarm FROM f GROUP BY series")
def eprocess_final(spark, d):
    e = monitor.e_process(_stream(spark, d), 0.15, 0.05)
    return e.select("series", F.round(F.ln("wealth"), 6).alias("log_wealth"), F.round(F.ln("e_value"), 6).alias("log_peak"), "n", "alarm")


_MIX = _FOLD.replace("(PARTITION BY series ORDER BY pos) AS t FROM", "(PARTITION BY series ORDER BY pos) AS t0 FROM").replace("WITH RECURSIVE s AS (SELECT", "WITH RECURSIVE b AS (SELECT").replace(",\n    f AS", f", s AS (SELECT series * 100 + k AS series, pos, x, t0 - 25 * k AS t FROM b JOIN (SELECT unnest(range(0, 64)) AS k) ON t0 > 25 * k),\n    f AS", 1)
_NORM = (1 - 0.85**64) / 0.15


@query("edetector_mixture", f"{_MIX}, z AS (SELECT series // 100 AS name, series % 100 AS k, arg_max(w, t) AS w FROM f GROUP BY series) SELECT name AS series, round(ln(sum(pow(0.85, k) / {_NORM!r} * w) + 1 - sum(pow(0.85, k) / {_NORM!r})), 6) AS log_e FROM z GROUP BY name")
def edetector_mixture(spark, d):
    return monitor.e_detector(_stream(spark, d), 0.15).select("series", F.round(F.ln("e_value"), 6).alias("log_e"))


@query("ebh_reject", "WITH v AS (SELECT l_linenumber AS name, max(l_quantity) * l_linenumber AS e_value FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY e_value DESC) AS rk, count(*) OVER () AS m FROM v), k AS (SELECT max(rk) AS k FROM r WHERE e_value >= m / (0.05 * rk)) SELECT name, e_value, coalesce(e_value >= m / (0.05 * k), false) AS rejected FROM r CROSS JOIN k")
def ebh_reject(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("name")).agg((F.max("l_quantity") * F.col("l_linenumber")).alias("e_value"))
    return monitor.e_bh(v, 0.05)


_CHAO = """SELECT type, n_obs, CAST(f1 AS BIGINT) AS f1, CAST(f2 AS BIGINT) AS f2, round(n_obs + x, 6) AS n_hat, round(CASE WHEN x > 0 AND var > 0 THEN n_obs + x * exp({z!r} * sqrt(ln(1 + var / (x * x)))) ELSE n_obs + x END, 6) AS n_upper, n_obs >= 30 AND f2 > 0 AS informative FROM (
    SELECT *, {a!r}::DOUBLE * f1 * (f1 - 1) / (2 * (f2 + 1)) AS x, CASE WHEN f2 > 0 THEN {a!r}::DOUBLE * f1 * (f1 - 1) / (2 * (f2 + 1)) + {a!r}::DOUBLE * {a!r}::DOUBLE * f1 * pow(2 * f1 - 1, 2) / (4 * pow(f2 + 1, 2)) + {a!r}::DOUBLE * {a!r}::DOUBLE * f1 * f1 * f2 * pow(f1 - 1, 2) / (4 * pow(f2 + 1, 4))
      ELSE greatest(0.0, {a!r}::DOUBLE * f1 * (f1 - 1) / 2 + {a!r}::DOUBLE * {a!r}::DOUBLE * f1 * pow(2 * f1 - 1, 2) / 4 - {a!r}::DOUBLE * {a!r}::DOUBLE * pow(f1, 4) / (4 * greatest(n_obs + {a!r}::DOUBLE * f1 * (f1 - 1) / 2, 1))) END AS var FROM ({src}))"""
_CAP = "SELECT o_orderstatus AS type, count(*) AS n_obs, CAST(count(*) FILTER (WHERE o_custkey % 4 = 0) AS DOUBLE) AS f1, CAST(count(*) FILTER (WHERE o_custkey % 4 = 1) AS DOUBLE) AS f2 FROM orders GROUP BY 1"


@query("chao1_by_type", _CHAO.format(z=stats.normal_quantile(0.975), a=2 / 3, src=_CAP))
def chao1_by_type(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("type"), (1 + F.col("o_custkey") % 4).alias("multiplicity"))
    return monitor.chao1(rows, 3).select("type", "n_obs", "f1", "f2", F.round("n_hat", 6).alias("n_hat"), F.round("n_upper", 6).alias("n_upper"), "informative")


@query("dark_matter", "WITH RECURSIVE d AS ({forms}), {merged}, {multiple}, c AS ({chao}) SELECT *, round(CASE WHEN n_hat > 0 THEN 1 - n_obs / n_hat ELSE 0 END, 6) AS dark_rate FROM c".format(forms=FORMS_SQL, merged=Q.MERGED, multiple=Q.MULTIPLE, chao=_CHAO.format(z=stats.normal_quantile(0.975), a=2 / 3, src="SELECT type, count(*) AS n_obs, CAST(count(*) FILTER (WHERE multiplicity = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (WHERE multiplicity = 2) AS DOUBLE) AS f2 FROM v GROUP BY 1")))
def dark_matter(spark, d):
    from ..operators.spans import ensemble

    out = monitor.dark_matter(materialised(ensemble(forms(spark, d)).select("type", "score", "engines"), "merged"))
    return out.select("type", "n_obs", "f1", "f2", F.round("n_hat", 6).alias("n_hat"), F.round("n_upper", 6).alias("n_upper"), "informative", F.round(1 - F.col("n_obs") / F.round("n_hat", 6), 6).alias("dark_rate"))


_CUSUM = f"SELECT series, pos, s - least(0, min(s) OVER (PARTITION BY series ORDER BY pos)) AS stat FROM (SELECT series, pos, sum(CAST(x AS DOUBLE) - 0.15 - 0.02) OVER (PARTITION BY series ORDER BY pos) AS s FROM ({_STREAM}))"


@query("cusum_alarm", f"SELECT series, min(pos) FILTER (WHERE stat > 3.05) AS alarm, round(max(stat), 6) AS peak FROM ({_CUSUM}) GROUP BY series")
def cusum_alarm(spark, d):
    return monitor.cusum_alarm(_stream(spark, d), 0.15, 3.05).withColumn("peak", F.round("peak", 6))


_LIMIT = 0.15 + 2.01 * math.sqrt(0.15 * 0.85 / 50)


@query("fixed_window_alarm", f"SELECT series, min(pos) FILTER (WHERE t >= 50 AND m > {_LIMIT!r}) AS alarm, round((max(m) FILTER (WHERE t >= 50) - 0.15) / {math.sqrt(0.15 * 0.85 / 50)!r}, 6) AS peak FROM (SELECT series, pos, row_number() OVER (PARTITION BY series ORDER BY pos) AS t, avg(x) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m FROM ({_STREAM})) GROUP BY series")
def fixed_window_alarm(spark, d):
    return monitor.fixed_window_alarm(_stream(spark, d), 0.15, 50, 2.01).withColumn("peak", F.round("peak", 6))


@query("threshold_calibration", f"SELECT round(quantile_cont(peak, 0.9), 6) AS threshold FROM (SELECT series, CAST(max(stat) AS DOUBLE) AS peak FROM ({_CUSUM}) GROUP BY series)")
def threshold_calibration(spark, d):
    return monitor.calibrate_threshold(monitor.cusum_alarm(_stream(spark, d), 0.15, 3.0), 0.1).select(F.round("threshold", 6).alias("threshold"))


@query("delay_stats", "SELECT round(avg(CASE WHEN a < 500 THEN 1.0 ELSE 0.0 END), 9) AS false_alarm_rate, round(avg(CASE WHEN a >= 500 THEN 1.0 ELSE 0.0 END), 9) AS detected, median(CASE WHEN a >= 500 THEN a - 500 END) AS median_delay, round(avg(CASE WHEN a >= 500 THEN a - 500 END), 6) AS mean_delay FROM (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'error') AS a FROM events GROUP BY 1)")
def delay_stats(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("alarm"))
    s = monitor.delay_stats(a, 500)
    return s.select(F.round("false_alarm_rate", 9).alias("false_alarm_rate"), F.round("detected", 9).alias("detected"), "median_delay", F.round("mean_delay", 6).alias("mean_delay"))


# actions ---------------------------------------------------------------------------
def _hmac_sql(message: str) -> str:
    key = KEY.ljust(64, b"\0")
    pad = lambda x: "unhex('" + bytes(b ^ x for b in key).hex() + "')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


@query("surrogate_hmac", f"SELECT c_custkey AS k, {_hmac_sql('c_name')} AS mac FROM customer")
def surrogate_hmac(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), T.hmac_sha256(KEY, F.col("c_name")).alias("mac"))


def _redact(spark, docs):
    """All nine types, found on a copy with accents folded (offsets are equal), masked in the text as it is."""
    found = rule_spans(docs.withColumn("text", T.fold_accents(F.col("text"))))
    return act.rewrite(docs, act.union_spans(found).withColumn("replacement", F.concat(F.lit("["), "type", F.lit("]"))))


@query(
    "redact_text",
    f"""WITH RECURSIVE d AS ({FOLDED_SQL}), o AS (SELECT doc_id, text FROM documents), a AS MATERIALIZED ({Q.RULES}), {Q.suppressed('a', 'b', 'doc_id, type')}, {Q.united('b')},
    p AS (SELECT u.doc_id, u.start, substring(o.text, CAST(coalesce(lag("end") OVER w, 0) + 1 AS INT), CAST(u.start - coalesce(lag("end") OVER w, 0) AS INT)) || '[' || type || ']' AS part, "end" FROM u JOIN o USING (doc_id) WINDOW w AS (PARTITION BY u.doc_id ORDER BY u.start)),
    x AS (SELECT doc_id, string_agg(part, '' ORDER BY start) AS head, max("end") AS last, count(*) AS n FROM p GROUP BY doc_id)
    SELECT o.doc_id, CASE WHEN x.n IS NULL THEN o.text ELSE head || substring(o.text, CAST(last + 1 AS INT)) END AS text, CAST(coalesce(n, 0) AS INT) AS n_masked FROM o LEFT JOIN x USING (doc_id)""",
)
def redact_text(spark, d):
    return _redact(spark, table(spark, d, "documents").select("doc_id", "text"))


@query("surrogate_text")
def surrogate_text(spark, d):
    docs = forms(spark, d)
    spans = act.union_spans(rule_spans(docs).where("score >= 0.5"))
    values = spans.join(docs, "doc_id").select("doc_id", "start", "end", "type", F.expr("substring(text, start + 1, `end` - start)").alias("value"))
    return act.rewrite(docs, act.with_surrogates(values, KEY))


_LEDGER = "SELECT CAST(o_custkey AS BIGINT) AS ledger, o_orderkey AS seq, o_orderstatus || '|' || CAST(o_custkey AS STRING) AS payload FROM orders"
_CHAIN = f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY seq) AS t FROM ({_LEDGER})),
    c AS (SELECT ledger, seq, payload, t, repeat('0', 64) AS prev_digest, sha256(repeat('0', 64) || '|' || payload) AS digest FROM p WHERE t = 1 UNION ALL SELECT p.ledger, p.seq, p.payload, p.t, c.digest, sha256(c.digest || '|' || p.payload) FROM c JOIN p ON p.ledger = c.ledger AND p.t = c.t + 1)"""


def _ledger(spark, d):
    """Every order, in a ledger per customer."""
    rows = table(spark, d, "orders")
    return act.ledger_chain(rows.select(F.col("o_custkey").cast("long").alias("ledger"), F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", F.lit("|"), F.col("o_custkey").cast("string")).alias("payload")))


@query("ledger_chain", f"{_CHAIN} SELECT ledger, seq, payload, prev_digest, digest FROM c")
def ledger_chain(spark, d):
    return _ledger(spark, d)


@query("ledger_verify", f"{_CHAIN} SELECT ledger, count(*) AS n_rows, count(*) FILTER (WHERE seq = 402) AS n_bad, count(*) FILTER (WHERE seq = 402) = 0 AS valid, arg_max(digest, seq) AS head FROM c GROUP BY ledger")
def ledger_verify(spark, d):
    chain = _ledger(spark, d)
    broken = F.when(F.col("seq") == 402, F.lit("forged")).otherwise(F.col("payload"))
    return act.ledger_verify(chain.withColumn("payload", broken))


@query("key_fingerprint", "SELECT substring(sha256('certveil-key-fingerprint' || 'certveil test key'), 1, 16) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM customer")
def key_fingerprint(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("n")).select(T.key_fingerprint(KEY).alias("fingerprint"), "n")


# streams ------------------------------------------------------------------------------
@query("stream_eprocess", f"{_FOLD} SELECT series, round(ln(arg_max(peak, t)), 6) AS log_peak, max(t) AS n FROM f GROUP BY series")
def stream_eprocess(spark, d):
    from ..streaming import streams

    out = streams.run_e_process(spark, f"{d}/events.parquet", 0.15)
    return out.select("series", F.round(F.ln("peak"), 6).alias("log_peak"), "n")


@query("stream_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT sha256(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) FROM documents)")
def stream_dedup(spark, d):
    from ..streaming import streams

    return streams.run_dedup(spark, f"{d}/documents.parquet").agg(F.count("*").alias("n"))


@query("stream_alarm_windows", "SELECT window_start, n, errors FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) ORDER BY 1")
def stream_alarm_windows(spark, d):
    from ..streaming import streams

    return streams.run_alarm_windows(spark, f"{d}/events.parquet")


# The key of an entity: checksummed values with their class, names as sorted words, others folded.
_FOLDED = "regexp_replace(lower(match), '[\\s\\-_./()]', '', 'g')"
_NAME = f"list_sort(list_filter(regexp_extract_all(lower(match), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({Q.words(ROLE_WORDS)}, t)))"
VALUE = f"""CASE WHEN type = 'CREDIT_CARD' THEN {_FOLDED} || CASE WHEN {Q.LUHN} THEN '|luhn-ok' ELSE '|luhn-bad' END WHEN type = 'IBAN' THEN {_FOLDED} || CASE WHEN {Q.iban('match')} THEN '|iso7064-ok' ELSE '|iso7064-bad' END
    WHEN type = 'PERSON' AND len({_NAME}) > 0 THEN array_to_string({_NAME}, '|') ELSE {_FOLDED} END"""


@query("form_candidates", f"""WITH RECURSIVE d AS ({FORMS_SQL}), {Q.MERGED}, n AS (SELECT doc_id, start, "end", type, {VALUE} AS value, score FROM m)
    SELECT doc_id, start, "end", type, value, round(CASE WHEN count(*) OVER w > 1 THEN greatest(score, 0.95 * max(score) OVER w) ELSE score END, 6) AS score FROM n WINDOW w AS (PARTITION BY type, value)""")
def form_candidates(spark, d):
    from .pipeline import Config, form_candidates

    return form_candidates(forms(spark, d), Config()).select("doc_id", "start", "end", "type", "value", F.round("score", 6).alias("score"))

