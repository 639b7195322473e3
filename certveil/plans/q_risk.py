"""Queries over the masking family, its risks and its tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import act, graph, metrics, risk
from ..session import materialised
from .fixtures import CANDIDATES_SQL, GOLD_SQL, LINES_SQL, TOKENS_SQL, candidates, gold, lines, table, tokens

QUERIES, SQL = {}, {}
IOU = """CASE WHEN least({a}."end", {b}."end") > greatest({a}.start, {b}.start) THEN (least({a}."end", {b}."end") - greatest({a}.start, {b}.start)) / CAST(greatest({a}."end", {b}."end") - least({a}.start, {b}.start) AS DOUBLE) ELSE 0 END"""
BASE = f"WITH c AS ({CANDIDATES_SQL}), g AS ({GOLD_SQL}), t AS ({TOKENS_SQL})"
PATH = """path AS (SELECT row_number() OVER (ORDER BY score DESC, type) AS j, type, score FROM (SELECT DISTINCT type, score FROM c) ORDER BY score DESC, type LIMIT 2046),
    steps AS (SELECT j, j / CAST(n AS DOUBLE) AS t, type, score, j = n AS complete FROM (SELECT j, type, score FROM path UNION ALL SELECT 0, NULL, NULL UNION ALL SELECT (SELECT max(j) FROM path) + 1, NULL, NULL), (SELECT max(j) + 1 AS n FROM path))"""
THR = "thr AS (SELECT type, min(score) AS threshold FROM path WHERE j <= 40 GROUP BY type)"
MASKED = "m AS (SELECT c.* FROM c JOIN thr USING (type) WHERE score >= threshold)"
HITS = f"hits AS (SELECT DISTINCT g.doc_id, g.gid FROM g JOIN m ON g.doc_id = m.doc_id AND g.type = m.type AND {IOU.format(a='g', b='m')} >= 0.5)"
PLAIN = """plain AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = t.doc_id AND g.start < t."end" AND t.start < g."end"))"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _all(spark, d):
    """(candidates, gold, tokens) of all orders; the lines behind the first two are grouped once."""
    rows = materialised(lines(spark, d, f"SELECT * FROM {LINES_SQL}"), "lines")
    of = lambda sql: spark.sql(sql.replace('"end"', "`end`").replace(LINES_SQL, "{rows}"), rows=rows)
    return of(CANDIDATES_SQL), of(GOLD_SQL), tokens(spark, d)


@query("mask_path", f"{BASE}, {PATH} SELECT j, round(t, 9) AS t, type, score, complete FROM steps")
def mask_path(spark, d):
    return risk.mask_path(candidates(spark, d)).select(F.col("j").cast("long").alias("j"), F.round("t", 9).alias("t"), "type", "score", "complete")


@query("quantile_path", f"""{BASE}, r AS (SELECT type, score, row_number() OVER (PARTITION BY type ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY type) AS n FROM c), q AS (SELECT unnest(range(1, 31)) AS i),
    s AS (SELECT i, list(struct_pack(type := type, score := score) ORDER BY type) AS x FROM r JOIN q ON rk = floor((1 - i / 31.0::DOUBLE) * (n - 1) + 1e-12) GROUP BY i), k AS (SELECT *, row_number() OVER (ORDER BY i) AS j FROM (SELECT *, lag(x) OVER (ORDER BY i) AS before FROM s) WHERE before IS NULL OR before <> x),
    p AS (SELECT j, unnest(x, recursive := true) FROM k), n AS (SELECT max(j) + 1 AS n FROM p)
    SELECT j, round(j / CAST(n AS DOUBLE), 9) AS t, type, score, j = n AS complete FROM (SELECT * FROM p UNION ALL SELECT 0, NULL, NULL UNION ALL SELECT (SELECT n FROM n), NULL, NULL), n""")
def quantile_path(spark, d):
    return risk.quantile_path(candidates(spark, d), 32).select(F.col("j").cast("long").alias("j"), F.round("t", 9).alias("t"), "type", "score", "complete")


@query("risk_leak", f"{BASE}, {PATH}, {THR}, {MASKED}, {HITS} SELECT g.doc_id, round(1 - count(h.gid) / CAST(count(*) AS DOUBLE), 9) AS leak FROM g LEFT JOIN hits h USING (doc_id, gid) GROUP BY g.doc_id")
def risk_leak(spark, d):
    c, g, _ = _all(spark, d)
    return risk.leakage(g, risk.mask(c, risk.thresholds_at(c, 40))).select("doc_id", F.round("leak", 9).alias("leak"))


@query("risk_overmask", f"""{BASE}, {PATH}, {THR}, {MASKED}, {PLAIN} SELECT doc_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.doc_id = plain.doc_id AND m.start < plain."end" AND plain.start < m."end") THEN 1.0 ELSE 0.0 END), 9) AS over FROM plain GROUP BY doc_id""")
def risk_overmask(spark, d):
    c, g, t = _all(spark, d)
    return risk.overmask(t, g, risk.mask(c, risk.thresholds_at(c, 40))).select("doc_id", F.round("over", 9).alias("over"))


@query("risk_escalation", f"{BASE}, {PATH}, {THR} SELECT doc_id, round(avg(CASE WHEN score >= 0.3 AND score < coalesce(threshold, 2) THEN 1.0 ELSE 0.0 END), 9) AS esc FROM c LEFT JOIN thr USING (type) GROUP BY doc_id")
def risk_escalation(spark, d):
    c = candidates(spark, d)
    return risk.escalation(c, risk.thresholds_at(c, 40), 0.3).select("doc_id", F.round("esc", 9).alias("esc"))


@query("banded_spans", f"{BASE}, {PATH}, {THR} SELECT doc_id, cand, type, score FROM c JOIN thr USING (type) WHERE score >= 0.3 AND score < threshold")
def banded_spans(spark, d):
    c = candidates(spark, d)
    return risk.banded(c, risk.thresholds_at(c, 40), 0.3).select("doc_id", "cand", "type", "score")


@query("risk_matrix_mean", f"""{BASE}, {PATH}, a AS (SELECT c.*, j FROM c JOIN path USING (type, score)),
    gj AS (SELECT g.doc_id, g.gid, min(a.j) AS j FROM g LEFT JOIN a ON g.doc_id = a.doc_id AND g.type = a.type AND {IOU.format(a='g', b='a')} >= 0.5 GROUP BY 1, 2),
    gn AS (SELECT gj.*, count(*) OVER (PARTITION BY doc_id) AS n FROM gj), {PLAIN},
    tj AS (SELECT plain.doc_id, plain.k, min(a.j) AS j FROM plain LEFT JOIN a ON plain.doc_id = a.doc_id AND a.start < plain."end" AND plain.start < a."end" GROUP BY 1, 2), tn AS (SELECT tj.*, count(*) OVER (PARTITION BY doc_id) AS n FROM tj),
    cn AS (SELECT a.*, count(*) OVER (PARTITION BY doc_id) AS n FROM a)
    SELECT j, round(t, 9) AS t, n, round(CASE WHEN complete THEN 0 ELSE (SELECT sum(CASE WHEN gn.j IS NULL OR gn.j > s.j THEN 1.0 / gn.n ELSE 0 END) FROM gn) / n END, 7) AS leak,
      round((SELECT sum(CASE WHEN s.complete OR tn.j <= s.j THEN 1.0 / tn.n ELSE 0 END) FROM tn) / n, 7) AS over,
      round(CASE WHEN complete THEN 1 ELSE (SELECT sum(CASE WHEN score >= 0.2 AND cn.j > s.j THEN 1.0 / cn.n ELSE 0 END) FROM cn) / n END, 7) AS esc FROM (SELECT DISTINCT j, t, complete FROM steps) s, (SELECT count(*) AS n FROM orders)""")
def risk_matrix_mean(spark, d):
    rows = _risks(spark, d)[1]
    return rows.select(F.col("j").cast("long").alias("j"), F.round("t", 9).alias("t"), "n", *[F.round(x, 7).alias(x) for x in ("leak", "over", "esc")])


def _risks(spark, d):
    """Losses of each order's document and their means over the steps of the path."""
    c, g, t = _all(spark, d)
    path = materialised(risk.mask_path(c), "path")
    losses = materialised(risk.document_losses(c, g, t, table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), path), "losses")
    return losses, risk.mean_risks(losses, path)


_LOSS = "SELECT l_linenumber AS j, avg(l_discount / l_linenumber) AS mean_risk, count(*) AS n FROM lineitem GROUP BY 1"


@query("crc_select", f"SELECT min(j) AS j_star, round(arg_min(inflated, j), 9) AS inflated FROM (SELECT j, CAST(n AS DOUBLE) / (n + 1) * mean_risk + 1.0 / (n + 1) AS inflated FROM ({_LOSS})) WHERE inflated <= 0.02")
def crc_select(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("j")).agg(F.avg(F.col("l_discount") / F.col("l_linenumber")).alias("mean_risk"), F.count("*").alias("n"))
    return risk.crc_select(rows, F.col("n"), 0.02).select("j_star", F.round("inflated", 9).alias("inflated"))


_W = "SELECT o_orderkey AS pos, 0.5 + o_custkey % 10 / 10.0 AS w FROM orders"
_WL = "SELECT o_orderkey AS pos, j, (o_totalprice - floor(o_totalprice)) / j AS loss FROM orders CROSS JOIN (SELECT unnest(range(1, 9)) AS j)"


def _weights(spark, d):
    o = table(spark, d, "orders")
    w = o.select(F.col("o_orderkey").alias("pos"), (0.5 + F.col("o_custkey") % 10 / 10.0).alias("w"))
    x = o.select(F.col("o_orderkey").alias("pos"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j"), (F.col("o_totalprice") - F.floor("o_totalprice")).alias("f"))
    return w, x.select("pos", "j", (F.col("f") / F.col("j")).alias("loss"))


@query("weighted_crc", f"WITH w AS ({_W}), l AS ({_WL}), s AS (SELECT sum(w) AS s, max(w) AS m FROM w), r AS (SELECT j, sum(w.w * loss) / (max(s.s) + max(s.m)) + max(s.m) / (max(s.s) + max(s.m)) AS risk FROM l JOIN w USING (pos) CROSS JOIN s GROUP BY j) SELECT CAST(min(j) AS INT) AS j_star, round(arg_min(risk, j), 9) AS risk FROM r WHERE risk <= 0.1")
def weighted_crc(spark, d):
    w, losses = _weights(spark, d)
    return risk.weighted_crc(losses, w, 0.1).select("j_star", F.round("risk", 9).alias("risk"))


@query("weighted_crc_weights", f"WITH w AS ({_W}) SELECT pos, round(w / (sum(w) OVER () + max(w) OVER ()), 12) AS weight FROM w")
def weighted_crc_weights(spark, d):
    return risk.weighted_crc_weights(_weights(spark, d)[0]).withColumn("weight", F.round("weight", 12))


def _kl(a: str, b: float) -> str:
    return f"(CASE WHEN {a} > 0 THEN {a} * ln({a} / {b}) ELSE 0 END + CASE WHEN {a} < 1 THEN (1 - {a}) * ln((1 - {a}) / {1 - b!r}) ELSE 0 END)"


def _hb(mean: str, n: str, alpha: float) -> str:
    """Hoeffding-Bentkus p-value, the binomial terms through log-gamma."""
    cdf = f"list_sum(list_transform(range(0, CAST(ceil(round({n} * {mean}, 9)) AS INT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({alpha}) + ({n} - i) * ln({1 - alpha!r}))))"
    return f"(CASE WHEN {mean} >= {alpha} THEN 1.0 ELSE least(1.0, exp(-{n} * {_kl(f'least({mean}, {alpha})', alpha)}), {math.e!r} * least(1.0, {cdf})) END)"


@query("hb_pvalue", f"SELECT nationkey AS k, round({_hb('m', 'n', 0.06)}, 6) AS p FROM (SELECT c_nationkey AS nationkey, count(*) AS n, avg(CASE WHEN c_acctbal < -500 THEN 1.0 ELSE 0.0 END) AS m FROM customer GROUP BY 1)")
def hb_pvalue(spark, d):
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") < -500).cast("double")).alias("m"))
    return rows.select("k", F.round(stats.hoeffding_bentkus(F.col("m"), F.col("n"), 0.06), 6).alias("p"))


# The steps of the path over all orders; the risks as risk_matrix_mean has them.
_MATRIX = SQL["risk_matrix_mean"]


def _ltt_sql(rule: str) -> str:
    return f"WITH s AS ({_MATRIX}), p AS (SELECT j, {_hb('leak', 'n', 0.75)} AS pl, {_hb('over', 'n', 0.3)} AS po FROM s) SELECT j, round(pl, 6) AS p_leak, round(po, 6) AS p_over, {rule} AS certified FROM p"


def _tested(spark, d, method):
    risks = _risks(spark, d)[1].withColumns({c: F.round(c, 7) for c in ("leak", "over")})
    tests = risk.learn_then_test(risks, 0.75, 0.3, 0.05, method)
    return tests.select(F.col("j").cast("long").alias("j"), F.round("p_leak", 6).alias("p_leak"), F.round("p_over", 6).alias("p_over"), "certified")


@query("ltt_fixed_sequence", _ltt_sql("(bool_and(pl <= 0.025) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AND bool_and(po <= 0.025) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"))
def ltt_fixed_sequence(spark, d):
    return _tested(spark, d, "fixed-sequence")


@query("ltt_bonferroni", _ltt_sql("(pl <= 0.05 / 2 / count(*) OVER () AND po <= 0.05 / 2 / count(*) OVER ())"))
def ltt_bonferroni(spark, d):
    return _tested(spark, d, "bonferroni")


@query("betting_pvalue", """WITH RECURSIVE s AS (SELECT user_id % 8 AS series, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS t, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS x FROM events),
    f AS (SELECT series, CAST(0 AS BIGINT) AS t, CAST(1.0 AS DOUBLE) AS w, CAST(1.0 AS DOUBLE) AS peak, CAST(0.5 AS DOUBLE) AS mu, CAST(0.25 AS DOUBLE) AS v FROM (SELECT DISTINCT series FROM s)
      UNION ALL SELECT series, t + 1, nw, greatest(peak, nw), nmu, CASE WHEN t = 0 THEN 0.0 ELSE v + ((x - mu) * (x - nmu) - v) / (t + 1) END FROM (
        SELECT f.*, s.x, greatest(0.0, f.w * (1 + CASE WHEN f.t = 0 THEN 0.0 ELSE least(0.5 / 0.7, greatest(0.0, (0.3 - f.mu) / greatest(f.v, 1e-4))) END * (0.3 - s.x))) AS nw, f.mu + (s.x - f.mu) / (f.t + 1) AS nmu FROM f JOIN s ON s.series = f.series AND s.t = f.t + 1))
    SELECT series, round(least(1.0, 1 / arg_max(peak, t)), 6) AS p FROM f GROUP BY series""")
def betting_pvalue(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("series"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").cast("double").alias("x"))
    return risk.betting_pvalue(e, 0.3).select("series", F.round("p", 6).alias("p"))


@query("operating_point", "SELECT arg_max(j, CASE WHEN esc <= 0.5 THEN rho ELSE rho - 100 END - j * 1e-9) AS j FROM (SELECT l_linenumber AS j, max(l_quantity) - l_linenumber AS rho, avg(l_tax) * 10 AS esc, avg(l_discount) AS over FROM lineitem GROUP BY 1)")
def operating_point(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("j")).agg((F.max("l_quantity") - F.col("l_linenumber")).alias("rho"), (F.avg("l_tax") * 10).alias("esc"), F.avg("l_discount").alias("over"))
    return risk.operating_point(rows.withColumn("certified", F.lit(True)), "rho", 0.5)


_NODES = "SELECT o_orderkey AS node, o_orderstatus AS type, CAST(o_custkey AS STRING) AS value, round((o_orderkey % 97) / 100.0, 2) AS score FROM orders"


def _nodes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("type"), F.col("o_custkey").cast("string").alias("value"), F.round(F.col("o_orderkey") % 97 / 100.0, 2).alias("score"))


@query("identity_components", f"SELECT type, value, count(*) AS size, max(score) AS top FROM ({_NODES}) GROUP BY 1, 2")
def identity_components(spark, d):
    return graph.components(_nodes(spark, d))


@query("graph_stats", f"SELECT CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, CAST(sum(n - 1) AS BIGINT) AS identity_edges, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT count(*) AS n FROM ({_NODES}) GROUP BY type, value)")
def graph_stats(spark, d):
    return graph.graph_stats(_nodes(spark, d)).withColumn("mean_size", F.round("mean_size", 6))


@query("propagate_identity", f"SELECT node, round(CASE WHEN count(*) OVER w > 1 THEN greatest(score, 0.95 * max(score) OVER w) ELSE score END, 9) AS identity FROM ({_NODES}) WINDOW w AS (PARTITION BY type, value)")
def propagate_identity(spark, d):
    return graph.identity_channel(_nodes(spark, d)).select("node", F.round("identity", 9).alias("identity"))


_EDGES = "SELECT l_orderkey AS src, l_orderkey + 1 + l_partkey % 5 AS dst, max(l_discount + 0.01) AS w FROM lineitem GROUP BY 1, 2"
_AFF = f"b AS (SELECT src, dst, w FROM ({_EDGES}) UNION ALL SELECT dst, src, w FROM ({_EDGES})), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rk FROM b), e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM k WHERE rk <= 4)"


def _affinity(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + 1 + F.col("l_partkey") % 5).alias("dst")).agg(F.max(F.col("l_discount") + 0.01).alias("w"))
    return graph.affinity(e, 4)


@query("similarity_degree_cap", f"WITH {_AFF} SELECT src, dst, round(w, 9) AS w FROM e")
def similarity_degree_cap(spark, d):
    return _affinity(spark, d).withColumn("w", F.round("w", 9))


_DIFF = f"""WITH {_AFF}, x0 AS (SELECT node, score AS x FROM ({_NODES})), x1 AS (SELECT src AS node, sum(w * x) AS x FROM e JOIN x0 ON dst = node GROUP BY src), x2 AS (SELECT src AS node, sum(w * x) AS x FROM e JOIN x1 ON dst = node GROUP BY src), x3 AS (SELECT src AS node, sum(w * x) AS x FROM e JOIN x2 ON dst = node GROUP BY src),
    y AS (SELECT node, sum(y) AS diffusion FROM (SELECT node, 0.4 * x AS y FROM x0 UNION ALL SELECT node, 0.4 * 0.6 * x FROM x1 UNION ALL SELECT node, 0.4 * 0.36 * x FROM x2 UNION ALL SELECT node, 0.4 * 0.216 * x FROM x3) GROUP BY node)"""


@query("propagate_diffusion", f"{_DIFF} SELECT node, round(diffusion, 8) AS diffusion FROM y")
def propagate_diffusion(spark, d):
    return graph.diffusion_channel(_nodes(spark, d), _affinity(spark, d)).withColumn("diffusion", F.round("diffusion", 8))


@query("propagate_scores", f"{_DIFF} SELECT n.node, round(least(1.0, greatest(CASE WHEN count(*) OVER v > 1 THEN greatest(score, 0.95 * max(score) OVER v) ELSE score END, coalesce(diffusion, 0))), 8) AS score FROM ({_NODES}) n LEFT JOIN y USING (node) WINDOW v AS (PARTITION BY type, value)")
def propagate_scores(spark, d):
    return graph.propagate(_nodes(spark, d), _affinity(spark, d)).select("node", F.round("score", 8).alias("score"))


@query("recall_amplification", "SELECT l_linenumber AS m, round(1 - pow(1 - l_discount, greatest(1, l_linenumber)), 9) AS r, round(0.6 * l_tax / 0.4 * l_discount, 9) AS leak_bound, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def recall_amplification(spark, d):
    r = F.round(stats.recall_amplification(F.col("l_discount"), F.col("l_linenumber")), 9)
    b = F.round(stats.cross_entity_leak_bound(0.6, F.col("l_tax"), F.col("l_discount")), 9)
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("m"), r.alias("r"), b.alias("leak_bound")).agg(F.count("*").alias("n"))


_ESC = "SELECT node AS cand_id, type, value, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END AS pi FROM ({n})".format(n=_NODES)


def _eligible(spark, d):
    return _nodes(spark, d).select(F.col("node").alias("cand_id"), "type", "value", (F.col("score") >= 0.5).cast("double").alias("pi"))


_TOPK = f"(SELECT type, value, min(cand_id) AS cand_id, sum(pi) AS gain FROM ({_ESC}) GROUP BY 1, 2 HAVING sum(pi) > 0 ORDER BY gain DESC, cand_id LIMIT 50)"


@query("escalate_topk", f"SELECT CAST(row_number() OVER (ORDER BY gain DESC, cand_id) AS INT) AS rank, cand_id, type, value, gain FROM {_TOPK}")
def escalate_topk(spark, d):
    return act.escalate(_eligible(spark, d), 50)


@query("coverage_value", f"SELECT sum(gain) AS coverage FROM {_TOPK}")
def coverage_value(spark, d):
    e = _eligible(spark, d)
    return act.coverage_value(e, act.escalate(e, 50))


@query("resolved_mask", f"SELECT node AS doc_id, type FROM ({_NODES}) WHERE (type, value) IN (SELECT (type, value) FROM {_TOPK})")
def resolved_mask(spark, d):
    e = _eligible(spark, d)
    spans = _nodes(spark, d).withColumns({"doc_id": F.col("node"), "start": F.lit(0), "end": F.lit(1)})
    return act.resolve(spans, act.escalate(e, 50)).select("doc_id", "type")


# Gold spans and predictions that compete: some of either stand there twice, shifted by one.
_PRED = f"""SELECT doc_id, cand AS pid, type, start, "end", score FROM ({CANDIDATES_SQL}) UNION ALL SELECT doc_id, cand + 100, type, start + 1, "end" + 1, score FROM ({CANDIDATES_SQL}) WHERE cand % 2 = 0"""
_GOLD = f"""SELECT doc_id, gid, type, start, "end" FROM ({GOLD_SQL}) UNION ALL SELECT doc_id, gid + 100, type, start + 1, "end" + 1 FROM ({GOLD_SQL}) WHERE gid % 3 = 0"""
_M = f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, gid, pid) AS k FROM (SELECT g.doc_id, g.gid, p.pid, {IOU.format(a='g', b='p')} AS v FROM g JOIN p ON g.doc_id = p.doc_id AND g.type = p.type) WHERE v >= 0.5"""


@query("span_prf", f"""WITH RECURSIVE p AS ({_PRED}), g AS ({_GOLD}), q AS MATERIALIZED ({_M}),
    w AS (SELECT doc_id, k, [gid] AS gs, [pid] AS ps, true AS ok FROM q WHERE k = 1 UNION ALL SELECT doc_id, k, CASE WHEN hit THEN gs ELSE list_append(gs, gid) END, CASE WHEN hit THEN ps ELSE list_append(ps, pid) END, NOT hit
      FROM (SELECT q.*, w.gs, w.ps, list_contains(w.gs, q.gid) OR list_contains(w.ps, q.pid) AS hit FROM w JOIN q ON q.doc_id = w.doc_id AND q.k = w.k + 1)),
    m AS (SELECT doc_id, gid, pid FROM q JOIN w USING (doc_id, k) WHERE ok),
    r AS (SELECT type, CASE WHEN m.gid IS NULL THEN 0 ELSE 1 END AS tp, 0 AS fp, CASE WHEN m.gid IS NULL THEN 1 ELSE 0 END AS fn FROM g LEFT JOIN m USING (doc_id, gid) UNION ALL SELECT type, 0, 1, 0 FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.pid = p.pid)),
    s AS (SELECT coalesce(type, 'ALL') AS type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r GROUP BY GROUPING SETS ((type), ()))
    SELECT type, tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM s""")
def span_prf(spark, d):
    rows = metrics.evaluate(lines(spark, d, _GOLD), lines(spark, d, _PRED))
    return rows.select("type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("candidate_miss", f"WITH c AS ({CANDIDATES_SQL}), g AS ({GOLD_SQL}), h AS (SELECT DISTINCT g.doc_id, g.gid FROM g JOIN c ON g.doc_id = c.doc_id AND g.type = c.type AND {IOU.format(a='g', b='c')} >= 0.5 WHERE c.score >= 0.3) SELECT coalesce(g.type, 'ALL') AS type, count(*) AS n_gold, count(*) - count(h.gid) AS n_missed, round((count(*) - count(h.gid)) / CAST(count(*) AS DOUBLE), 9) AS miss_rate FROM g LEFT JOIN h USING (doc_id, gid) GROUP BY GROUPING SETS ((g.type), ())")
def candidate_miss(spark, d):
    return metrics.candidate_miss(gold(spark, d), candidates(spark, d), least_score=0.3).withColumn("miss_rate", F.round("miss_rate", 9))


@query("effective_miss", f"{BASE}, {PATH}, {THR}, {MASKED}, {HITS} SELECT count(*) AS n_gold, round(1 - count(h.gid) / CAST(count(*) AS DOUBLE), 9) AS effective_miss FROM g LEFT JOIN hits h USING (doc_id, gid)")
def effective_miss(spark, d):
    c, g, _ = _all(spark, d)
    hit = risk.gold_matches(g, risk.mask(c, risk.thresholds_at(c, 40))).select("doc_id", "gid").distinct().withColumn("hit", F.lit(1))
    return g.join(hit, ["doc_id", "gid"], "left").agg(F.count("*").alias("n_gold"), F.round(1 - F.count("hit") / F.count("*"), 9).alias("effective_miss"))


@query("recall_multiplicity", f"""{BASE}, {PATH}, {THR}, {MASKED}, {HITS}, v AS (SELECT g.*, g.doc_id % 400 AS value FROM g), s AS (SELECT type, value, least(count(*), 6) AS multiplicity FROM v GROUP BY 1, 2) SELECT multiplicity, count(*) AS n_gold, round(count(h.gid) / CAST(count(*) AS DOUBLE), 9) AS recall FROM v JOIN s USING (type, value) LEFT JOIN hits h USING (doc_id, gid) GROUP BY 1""")
def recall_multiplicity(spark, d):
    c, g, _ = _all(spark, d)
    rows = metrics.recall_by_multiplicity(g.withColumn("value", F.col("doc_id") % 400), risk.mask(c, risk.thresholds_at(c, 40)))
    return rows.withColumn("recall", F.round("recall", 9))


_TESTS = "SELECT o_orderpriority || o_orderstatus AS name, round(avg(o_totalprice - floor(o_totalprice)) / 20, 9) AS p FROM orders GROUP BY 1"


@query("holm", f"SELECT name, p, round(max(least(1.0, (n - i) * p)) OVER (ORDER BY p, name), 9) AS adjusted FROM (SELECT name, p, row_number() OVER (ORDER BY p, name) - 1 AS i, count(*) OVER () AS n FROM ({_TESTS}))")
def holm(spark, d):
    rows = table(spark, d, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("name")).agg(F.round(F.avg(F.col("o_totalprice") - F.floor("o_totalprice")) / 20, 9).alias("p"))
    return metrics.holm(rows).withColumn("adjusted", F.round("adjusted", 9))


@query("perm_test_hashed", """WITH u AS (SELECT c_custkey AS unit, round(c_acctbal / 1000, 3) AS d FROM customer), o AS (SELECT sum(d) AS observed FROM u), r AS (SELECT rep, sum(CASE WHEN CAST('0x' || substring(md5(unit || '|' || rep || '|0'), 1, 4) AS INT) % 2 = 0 THEN d ELSE -d END) AS s FROM u CROSS JOIN (SELECT unnest(range(1, 101)) AS rep) GROUP BY rep)
    SELECT round(max(observed), 6) AS observed, round((count(*) FILTER (WHERE abs(s) >= abs(observed) - 1e-9) + 1) / 101.0, 9) AS p FROM r CROSS JOIN o""")
def perm_test_hashed(spark, d):
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.round(F.col("c_acctbal") / 1000, 3).alias("d"))
    return metrics.permutation_test(u, 100).select(F.round("observed", 6).alias("observed"), F.round("p", 9).alias("p"))


@query("bca_ci")
def bca_ci(spark, d):
    lo, hi = metrics.bca_interval(table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("x")))
    return spark.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


@query("pooled_roles", "SELECT role, count(*) AS n FROM (SELECT 'calibration' AS role FROM orders WHERE o_orderkey % 5 < 2 UNION ALL SELECT 'deployment' FROM orders WHERE o_orderkey % 5 >= 2) GROUP BY role")
def pooled_roles(spark, d):
    o = table(spark, d, "orders")
    cal, dep = o.where("o_orderkey % 5 < 2"), o.where("o_orderkey % 5 >= 2")
    return cal.withColumn("role", F.lit("calibration")).unionByName(dep.withColumn("role", F.lit("deployment"))).groupBy("role").agg(F.count("*").alias("n"))

