"""Queries over calibration and deployment, and the reports of the method's experiments.

Calibration and deployment are the two parts of a split of all forms; gold spans are where the forms' data stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry, stats
from ..operators import act, graph, labels, metrics, monitor, risk, shift, spans
from ..session import materialised
from . import pipeline as P
from . import sql_spans as Q
from .fixtures import FORM_GOLD_SQL, FORMS_SQL, find_sql, form_gold, forms, table
from .q_monitor import _CHAO, VALUE
from .q_risk import _MATRIX, _hb

QUERIES, SQL = {}, {}
ALPHAS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)
BUDGETS = (0.0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _halves(spark, d):
    """(calibration, deployment, their gold spans): all forms, split by a digest of the id."""
    docs, gold = forms(spark, d), form_gold(spark, d)
    part = materialised(labels.split(docs.withColumn("is_dup", F.lit(False))).select("doc_id", "text", "part"), "split")
    cal, dep = (part.where(F.col("part") == p).select("doc_id", "text") for p in ("calibration", "test"))
    of = lambda x: gold.join(x.select("doc_id"), "doc_id", "left_semi")
    return cal, dep, of(cal), of(dep)


SETUP = {"alpha": 0.3, "gamma": 0.3}


def _run(spark, d, **changes):
    cal, dep, g, h = _halves(spark, d)
    return P.run(cal, dep, P.Config(**(SETUP | changes)), g, h)


@query("certified_run")
def certified_run(spark, d):
    """What is masked per type where the certificate of one part of the forms serves the other."""
    return _run(spark, d).summary


@query("deploy_report")
def deploy_report(spark, d):
    """One row per setting: certified, refused (no step can be certified), and without a promise (the best F1)."""
    cal, dep, g, h = _halves(spark, d)
    rows = []
    p = None
    for name, changes in (("certified", {}), ("refused", {"alpha": 1e-6, "gamma": 1e-6}), ("best-f1", {"select_by": "max_f1"})):
        c, p = P.calibrate(cal, dep, g, P.Config(**(SETUP | changes)), p)
        r = P.deploy(c, p, h)
        rows.append((name, c.verdict, c.j, c.rho_star, c.rho_hat, r.n_docs, r.n_escalated, r.escalated_fraction, r.realised_leakage, r.realised_overmask, r.ledger.count(), c.uncertified))
    return spark.createDataFrame(rows, "setting string, verdict string, step int, rho_star double, rho_hat double, n_docs long, n_escalated long, escalated double, leakage double, overmask double, ledger_rows long, uncertified boolean")


# The certified steps of the calibration part, from the engines on.
_SPLIT = "h AS (SELECT doc_id, md5(doc_id || '|7') AS key FROM d), cal AS (SELECT doc_id FROM h WHERE key <= (SELECT max(key) FROM (SELECT key, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM h) WHERE rn <= least(greatest(1, CAST(round_even(0.4 * n, 0) AS BIGINT)), n - 1)))"
_POOL = f"""WITH RECURSIVE d AS ({FORMS_SQL}), {Q.MERGED}, {_SPLIT}, v AS (SELECT doc_id, start, "end", type, {VALUE} AS value, score FROM m),
    c AS MATERIALIZED (SELECT doc_id, start, "end", type, round(CASE WHEN count(*) OVER w > 1 THEN greatest(score, 0.95 * max(score) OVER w) ELSE score END, 6) AS score FROM v WINDOW w AS (PARTITION BY type, value)),
    path AS (SELECT row_number() OVER (ORDER BY score DESC, type) AS j, type, score FROM (SELECT DISTINCT type, score FROM c) ORDER BY score DESC, type LIMIT 2046),
    steps AS (SELECT j, j = (SELECT max(j) + 1 FROM path) AS complete FROM (SELECT j FROM path UNION ALL SELECT 0 UNION ALL SELECT (SELECT max(j) + 1 FROM path)))"""
_OVER = """least({a}."end", {b}."end") > greatest({a}.start, {b}.start)"""
_RISKS = f"""{_POOL}, act AS MATERIALIZED (SELECT c.*, j FROM c JOIN path USING (type, score) WHERE doc_id IN (SELECT doc_id FROM cal)), g AS MATERIALIZED (SELECT * FROM ({FORM_GOLD_SQL}) WHERE doc_id IN (SELECT doc_id FROM cal)),
    t AS MATERIALIZED (SELECT doc_id, start, "end" FROM ({find_sql('[^ \\t\\n\\x0B\\f\\r]+', 'd')}) WHERE doc_id IN (SELECT doc_id FROM cal)), plain AS MATERIALIZED (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = t.doc_id AND {_OVER.format(a='g', b='t')})),
    gj AS (SELECT g.doc_id, g.gid, min(a.j) AS j FROM g LEFT JOIN act a ON g.doc_id = a.doc_id AND g.type = a.type AND {_OVER.format(a='g', b='a')} AND (least(g."end", a."end") - greatest(g.start, a.start)) >= 0.5 * (greatest(g."end", a."end") - least(g.start, a.start)) GROUP BY 1, 2),
    gn AS MATERIALIZED (SELECT j, 1.0 / count(*) OVER (PARTITION BY doc_id) AS w FROM gj), tj AS (SELECT p.doc_id, p.start, min(a.j) AS j FROM plain p LEFT JOIN act a ON p.doc_id = a.doc_id AND {_OVER.format(a='p', b='a')} GROUP BY 1, 2), tn AS MATERIALIZED (SELECT j, 1.0 / count(*) OVER (PARTITION BY doc_id) AS w FROM tj),
    r AS (SELECT j, complete, n, CASE WHEN complete THEN 0 ELSE (SELECT sum(CASE WHEN gn.j IS NULL OR gn.j > s.j THEN w ELSE 0 END) FROM gn) / n END AS leak, (SELECT sum(CASE WHEN s.complete OR tn.j <= s.j THEN w ELSE 0 END) FROM tn) / n AS over FROM steps s, (SELECT count(*) AS n FROM cal))"""


@query("certificate_points", f"""{_RISKS}, q AS (SELECT j, round(leak, 7) AS leak, round(over, 7) AS over, {_hb('round(leak, 7)', 'n', 0.3)} AS pl, {_hb('round(over, 7)', 'n', 0.3)} AS po FROM r)
    SELECT j, leak, over, round(pl, 6) AS p_leak, round(po, 6) AS p_over, (bool_and(pl <= 0.025) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AND bool_and(po <= 0.025) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS certified FROM q""")
def certificate_points(spark, d):
    """Risks, p-values and the certified set of the calibration part, on the path of the pool."""
    cal, dep, g, _ = _halves(spark, d)
    config = P.Config(**SETUP)
    p = P.pool(cal, dep, config)
    docs, path = P._part(p.docs, "calibration"), risk.mask_path(p.candidates, config.grid)
    losses = risk.document_losses(P._part(p.candidates, "calibration"), P._keyed(g, "calibration"), P.T.tokens(docs), docs, materialised(path, "path"))
    risks = risk.mean_risks(materialised(losses, "losses"), path).withColumns({c: F.round(c, 7) for c in ("leak", "over")})
    risks = materialised(risks, "risks")
    tests = risk.learn_then_test(risks, 0.3, 0.3, 0.05)
    return risks.join(tests, "j").select(F.col("j").cast("long").alias("j"), "leak", "over", F.round("p_leak", 6).alias("p_leak"), F.round("p_over", 6).alias("p_over"), "certified")


def _frontier_sql(alpha: float) -> str:
    return f"SELECT {alpha} AS alpha, bool_or(ok) AS feasible, min(j) FILTER (WHERE ok) AS step FROM (SELECT j, bool_and(pl <= 0.025) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AND bool_and(po <= 0.025) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM (SELECT j, {_hb('leak', 'n', alpha)} AS pl, {_hb('over', 'n', 0.4)} AS po FROM s))"


@query("alpha_frontier", f"WITH s AS MATERIALIZED ({_MATRIX}) " + " UNION ALL ".join(map(_frontier_sql, ALPHAS)))
def alpha_frontier(spark, d):
    """Which levels of leakage some step can be certified for, over all orders."""
    from .q_risk import _risks

    risks = materialised(_risks(spark, d)[1].withColumns({c: F.round(c, 7) for c in ("leak", "over")}), "risks")
    out = None
    for alpha in ALPHAS:
        row = risk.learn_then_test(risks, alpha, 0.4, 0.05).agg(F.lit(alpha).alias("alpha"), F.bool_or("certified").alias("feasible"), F.min(F.when(F.col("certified"), F.col("j"))).cast("long").alias("step"))
        out = row if out is None else out.unionByName(row)
    return out


_GREEDY = f"""q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY engine, doc_id ORDER BY v DESC, gid, pid) AS k FROM (SELECT p.engine, g.doc_id, g.gid, p.pid, (least(g."end", p."end") - greatest(g.start, p.start)) / CAST(greatest(g."end", p."end") - least(g.start, p.start) AS DOUBLE) AS v FROM g JOIN p ON g.doc_id = p.doc_id AND g.type = p.type AND {_OVER.format(a='g', b='p')}) WHERE v >= 0.5),
    w AS (SELECT engine, doc_id, k, [gid] AS gs, [pid] AS ps, true AS ok FROM q WHERE k = 1 UNION ALL SELECT engine, doc_id, k, CASE WHEN hit THEN gs ELSE list_append(gs, gid) END, CASE WHEN hit THEN ps ELSE list_append(ps, pid) END, NOT hit
      FROM (SELECT q.*, w.gs, w.ps, list_contains(w.gs, q.gid) OR list_contains(w.ps, q.pid) AS hit FROM w JOIN q ON q.engine = w.engine AND q.doc_id = w.doc_id AND q.k = w.k + 1))"""
ENGINES = ("rule", "heuristic-ner", "shape")


@query("engine_baselines", f"""WITH RECURSIVE d AS ({FORMS_SQL}), a AS MATERIALIZED ({Q.ENGINES}), {Q.suppressed('a', 'b', 'doc_id, engine, type')}, {Q.suppressed('b', 'e', 'doc_id, engine, type', '>= 0.5')}, g AS MATERIALIZED ({FORM_GOLD_SQL}),
    p AS MATERIALIZED (SELECT *, 1000000 * start + 1000 * "end" + ascii(type) AS pid FROM e), {_GREEDY}, n AS (SELECT engine, count(*) AS n_pred FROM p GROUP BY 1), x AS (SELECT engine, count(*) AS tp FROM w WHERE ok GROUP BY 1), z AS (SELECT count(*) AS n_gold FROM g), f AS (SELECT engine, count(DISTINCT (doc_id, gid)) AS found FROM q GROUP BY 1)
    SELECT engine, tp, n_pred - tp AS fp, n_gold - tp AS fn, round(tp / CAST(n_pred AS DOUBLE), 9) AS precision, round(tp / CAST(n_gold AS DOUBLE), 9) AS recall, round(2 * tp / CAST(n_pred + n_gold AS DOUBLE), 9) AS f1, round(1 - found / CAST(n_gold AS DOUBLE), 9) AS miss FROM n JOIN x USING (engine) JOIN f USING (engine), z""")
def engine_baselines(spark, d):
    """Each engine by itself against the gold spans of all forms."""
    docs, gold = materialised(forms(spark, d), "forms"), materialised(form_gold(spark, d), "gold")
    out = None
    for name in ENGINES:
        found = materialised(spans.ensemble(docs, name), "found")
        pid = 1_000_000 * F.col("start") + 1000 * F.col("end") + F.ascii("type")
        row = metrics.evaluate(gold, found.withColumn("pid", pid.cast("long"))).where("type = 'ALL'")
        miss = metrics.candidate_miss(gold, found).where("type = 'ALL'").select("miss_rate")
        row = row.crossJoin(F.broadcast(miss)).select(F.lit(name).alias("engine"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], F.round("miss_rate", 9).alias("miss"))
        out = row if out is None else out.unionByName(row)
    return out


@query("chao_audit", "WITH RECURSIVE d AS ({forms}), {merged}, {multiple}, c AS ({chao}), g AS ({gold}), u AS (SELECT g.type, count(*) AS gold_total, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.type = g.type AND {over} AND (least(g.\"end\", m.\"end\") - greatest(g.start, m.start)) >= 0.5 * (greatest(g.\"end\", m.\"end\") - least(g.start, m.start)))) AS unproposed FROM g GROUP BY 1) SELECT type, gold_total, unproposed, n_obs, round(n_hat - n_obs, 5) AS point_unseen, round(n_upper - n_obs, 5) AS upper_unseen, unproposed <= n_upper - n_obs + 1e-9 AS covered, informative FROM u JOIN c USING (type)".format(
    forms=FORMS_SQL, merged=Q.MERGED, multiple=Q.MULTIPLE, gold=FORM_GOLD_SQL, over=_OVER.format(a="g", b="m"),
    chao=_CHAO.format(z=stats.normal_quantile(0.975), a=2 / 3, src="SELECT type, count(*) AS n_obs, CAST(count(*) FILTER (WHERE multiplicity = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (WHERE multiplicity = 2) AS DOUBLE) AS f2 FROM v GROUP BY 1")))
def chao_audit(spark, d):
    """Does the label-free limit cover what no engine proposed? Per type, over all forms."""
    merged = materialised(spans.ensemble(forms(spark, d)), "merged")
    missed = metrics.candidate_miss(form_gold(spark, d), merged).where("type <> 'ALL'")
    est = monitor.dark_matter(merged)
    rows = missed.join(est, "type")
    point, upper = F.round("n_hat", 6) - F.col("n_obs"), F.round("n_upper", 6) - F.col("n_obs")
    return rows.select("type", F.col("n_gold").alias("gold_total"), F.col("n_missed").alias("unproposed"), "n_obs", F.round(point, 5).alias("point_unseen"), F.round(upper, 5).alias("upper_unseen"), (F.col("n_missed") <= upper + 1e-9).alias("covered"), "informative")


@query("exp_main_table")
def exp_main_table(spark, d):
    """Each engine alone, then the system at a strict and a loose level and at its best F1, on the deployment part."""
    cal, dep, g, h = _halves(spark, d)
    dep, h = materialised(dep, "deployed"), materialised(h, "gold")
    rows, p = [], None
    for name in ENGINES:
        found = materialised(spans.ensemble(dep, name), "found")
        m = metrics.evaluate(h, found.withColumn("pid", F.xxhash64("start", "end", "type"))).where("type = 'ALL'").first()
        miss = metrics.candidate_miss(h, found).where("type = 'ALL'").first().miss_rate
        rows.append((name, None, m.precision, m.recall, m.f1, miss, None, None, None))
    for name, changes in (("strict", {"alpha": 0.01, "gamma": 0.1}), ("balanced", {"alpha": 0.1, "gamma": 0.1}), ("uncertified", {"select_by": "max_f1"})):
        c, p = P.calibrate(cal, dep, g, P.Config(**(SETUP | changes)), p)
        r = P.deploy(c, p, h, emit=False)
        m = r.span_metrics.where("type = 'ALL'").first() if r.span_metrics is not None else None
        held = "none" if c.uncertified else "no-certificate" if c.empty else "held" if r.realised_leakage <= c.config.alpha else "void"
        rows.append((name, None if c.uncertified else c.config.alpha, *((m.precision, m.recall, m.f1) if m else (None, None, None)), r.realised_leakage, r.realised_overmask, r.escalated_fraction, held))
    return spark.createDataFrame(rows, "system string, alpha double, precision double, recall double, f1 double, miss double, overmask double, escalated double, certified string")


@query("exp_shift_radius")
def exp_shift_radius(spark, d):
    """Worst-case leakage over growing shifts at the first certified step, and the radii that it allows."""
    cal, dep, g, _ = _halves(spark, d)
    c, p = P.calibrate(cal, dep, g, P.Config(**SETUP))
    first = c.points.where("certified").agg(F.min("j").alias("j")).first().j
    docs, path = P._part(p.docs, "calibration"), materialised(risk.mask_path(p.candidates), "path")
    losses = risk.document_losses(P._part(p.candidates, "calibration"), P._keyed(g, "calibration"), P.T.tokens(docs), docs, path)
    j = first if first is not None else max(0, path.agg(F.max("j").alias("j")).first().j - 1)
    x, n = risk.leak_histograms(losses, [j])[j]
    star, finite = shift.certified_radius(x, n, c.config.alpha), shift.finite_radius(x, n, c.config.alpha)
    rows = [(j, float(r), float(shift.worst_case(x, n, r)), float(shift.finite_sample_worst_case(x, n, r)), star, finite, c.rho_hat, c.verdict) for r in (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)]
    return spark.createDataFrame(rows, "step int, rho double, worst double, worst_finite double, rho_star double, rho_star_finite double, rho_hat double, verdict string")


VARIANTS = {
    "full": {}, "no-escalation": {"budget": 0.0}, "no-propagation": {"beta1": 0.0, "beta2": 0.0}, "one-engine": {"engines": "rule"}, "no-radius": {"select_by": "min_overmask"}, "no-weights": {"weighted": False}, "bonferroni": {"method": "bonferroni"},
}


@query("exp_ablation")
def exp_ablation(spark, d):
    """The system without each of its parts: what is certified and what comes of it."""
    cal, dep, g, h = _halves(spark, d)
    rows, pools, ratio = [], {}, None
    for name, changes in VARIANTS.items():
        config = P.Config(**(SETUP | changes))
        key = (config.engines, config.beta1, config.beta2)
        if key not in pools:
            pools[key] = P.pool(cal, dep, config)
            pools[key].ratio = ratio  # the texts are the same in all pools
        c, _ = P.calibrate(cal, dep, g, config, pools[key])
        ratio = pools[key].ratio
        r = P.deploy(c, pools[key], h, emit=False)
        f1 = r.span_metrics.where("type = 'ALL'").first().f1 if r.span_metrics is not None else None
        rows.append((name, c.verdict, f1, r.realised_leakage, r.realised_overmask, c.rho_star, r.escalated_fraction, r.candidate_miss.where("type = 'ALL'").first().miss_rate, r.effective_miss.where("type = 'ALL'").first().miss_rate))
    return spark.createDataFrame(rows, "variant string, verdict string, f1 double, leakage double, overmask double, rho_star double, escalated double, candidate_miss double, effective_miss double")


def _simulated(spark, streams: int, length: int, change: int, before: float, after: float, salt: str):
    """Error indicators drawn by digest: ``before`` up to the change, ``after`` from there on."""
    rows = spark.range(streams * length).select((F.col("id") / length).cast("long").alias("series"), (F.col("id") % length).alias("pos"))
    u = (F.pmod(F.xxhash64("series", "pos", F.lit(salt)), F.lit(1_000_003)) + 0.5) / 1_000_003
    return rows.withColumn("x", (u < F.when(F.col("pos") < change, before).otherwise(after)).cast("double"))


@query("exp_monitor")
def exp_monitor(spark, d):
    """False alarms without change and delays after one, of every registered monitor; two with thresholds calibrated to the same rate."""
    alpha, streams, length, change = 0.05, 60, 1500, 500
    null = materialised(_simulated(spark, streams, length, length, alpha, alpha, "null"), "null")
    moved = materialised(_simulated(spark, streams, length, change, alpha, 0.35, "moved"), "moved")
    bar = monitor.calibrate_threshold(monitor.cusum_alarm(null, alpha, 5.0), 0.05).first().threshold
    kinds = registry.alarms()
    z = monitor.calibrate_threshold(monitor.fixed_window_alarm(null, alpha, 200, 1.645), 0.05).first().threshold
    runs = [(n, f, {}) for n, f in kinds.items()] + [("cusum calibrated", kinds["cusum"], {"threshold": bar}), ("fixed-window calibrated", kinds["fixed-window"], {"z": z})]
    out = None
    for name, f, more in runs:
        fa = f(null, alpha, **more).agg(F.avg(F.col("alarm").isNotNull().cast("double")).alias("null_alarms"))
        row = monitor.delay_stats(f(moved, alpha, **more), change).crossJoin(F.broadcast(fa)).withColumn("monitor", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("monitor", "null_alarms", "false_alarm_rate", "detected", "median_delay", "mean_delay")


@query("exp_escalation")
def exp_escalation(spark, d):
    """What a growing review budget buys at the best-F1 step: a queue that approves all, and one that knows the gold spans."""
    cal, dep, g, h = _halves(spark, d)
    c, p = P.calibrate(cal, dep, g, P.Config(**(SETUP | {"select_by": "max_f1"})))
    keyed = materialised(P._keyed(h, "deployment"), "gold")
    right = act.oracle_resolver(P._part(p.candidates, "deployment"), keyed).select("node").withColumn("right", F.lit(True))
    known = P.Pool(p.docs, materialised(p.candidates.join(right, "node", "left"), "known"), p.stats)
    rows = []
    for budget in BUDGETS:
        c.config = P.Config(**(SETUP | {"select_by": "max_f1", "budget": budget}))
        for resolver, keep in (("review", None), ("gold", F.coalesce("right", F.lit(False)))):
            r = P.deploy(c, known, h, keep, emit=False)
            m = r.span_metrics.where("type = 'ALL'").first()
            rows.append((budget, resolver, m.precision, m.recall, m.f1, r.realised_leakage, r.realised_overmask, r.escalated_fraction, r.n_escalated))
    return spark.createDataFrame(rows, "budget double, resolver string, precision double, recall double, f1 double, leakage double, overmask double, escalated double, n_escalated long")


_PV = "WITH v AS (SELECT c_nationkey AS k, c_nationkey % 3 = 0 AS empty, CASE WHEN c_nationkey % 4 <> 1 THEN round(avg(abs(c_acctbal)) / 10000, 6) END AS rho_hat, round(0.3 + c_nationkey / 60.0, 6) AS rho_star FROM customer GROUP BY c_nationkey) SELECT *, "


@query("certificate_verdict", f"{_PV} CASE WHEN empty THEN 'no-certificate' WHEN rho_hat IS NULL THEN 'valid-at-P' WHEN rho_hat <= rho_star THEN 'valid' ELSE 'void' END AS verdict FROM v")
def certificate_verdict(spark, d):
    k = F.col("c_nationkey")
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg(F.abs("c_acctbal")) / 10000, 6).alias("r"))
    rows = rows.select(k.alias("k"), (k % 3 == 0).alias("empty"), F.when(k % 4 != 1, F.col("r")).alias("rho_hat"), F.round(0.3 + k / 60.0, 6).alias("rho_star"))
    return rows.withColumn("verdict", stats.verdict(F.col("empty"), F.col("rho_hat"), F.col("rho_star")))


@query("bounded_mean_pvalue", f"""WITH RECURSIVE s AS (SELECT user_id % 8 AS series, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS t, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS x FROM events),
    f AS (SELECT series, CAST(0 AS BIGINT) AS t, CAST(1.0 AS DOUBLE) AS w, CAST(1.0 AS DOUBLE) AS peak, CAST(0.5 AS DOUBLE) AS mu, CAST(0.25 AS DOUBLE) AS v FROM (SELECT DISTINCT series FROM s)
      UNION ALL SELECT series, t + 1, nw, greatest(peak, nw), nmu, CASE WHEN t = 0 THEN 0.0 ELSE v + ((x - mu) * (x - nmu) - v) / (t + 1) END FROM (
        SELECT f.*, s.x, f.w * (1 + CASE WHEN f.t = 0 THEN 0.0 ELSE least(0.5 / 0.78, greatest(0.0, (0.22 - f.mu) / greatest(f.v, 1e-4))) END * (0.22 - s.x)) AS nw, f.mu + (s.x - f.mu) / (f.t + 1) AS nmu FROM f JOIN s ON s.series = f.series AND s.t = f.t + 1)),
    b AS (SELECT series, least(1.0, 1 / arg_max(peak, t)) AS bet FROM f GROUP BY series), h AS (SELECT series, count(*) AS n, avg(x) AS m FROM s GROUP BY series)
    SELECT series, round({_hb('m', 'n', 0.22)}, 6) AS hb, round(bet, 6) AS betting, round(least(1.0, 2 * least({_hb('m', 'n', 0.22)}, bet)), 6) AS min2 FROM h JOIN b USING (series)""")
def bounded_mean_pvalue(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("series"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").cast("double").alias("x"))
    hb = e.groupBy("series").agg(F.count("*").alias("n"), F.avg("x").alias("m")).select("series", stats.hoeffding_bentkus(F.col("m"), F.col("n"), 0.22).alias("hb"))
    rows = hb.join(risk.betting_pvalue(e, 0.22).withColumnRenamed("p", "betting"), "series")
    return rows.select("series", *[F.round(risk.bounded_mean_pvalue(F.col("hb"), F.col("betting"), k), 6).alias(k) for k in ("hb", "betting", "min2")])


@query("ledger_round_trip", "SELECT CAST(o_custkey AS BIGINT) AS ledger, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, true AS valid FROM orders GROUP BY 1")
def ledger_round_trip(spark, d):
    """Ledgers written as JSON lines, read again and verified."""
    import uuid

    from ..session import shared_dir
    from .q_monitor import _ledger

    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    act.write_ledger(_ledger(spark, d), path)
    return act.ledger_verify(act.read_ledger(spark, path)).drop("head")


_SPAN_SQL = "SELECT c_custkey AS doc_id, CAST(instr(c_name, '#') AS INT) AS start, CAST(length(c_name) AS INT) AS \"end\", 'NUMBER' AS type, substring(c_name, CAST(instr(c_name, '#') + 1 AS INT)) AS match, CAST(0.5 AS DOUBLE) AS score, 'certveil_numbers' AS engine FROM customer WHERE instr(c_name, '#') > 0"


@query("registered_engine", _SPAN_SQL)
def registered_engine(spark, d):
    """A table function of one's own over every customer's name."""
    registry.register_engine(spark, "certveil_numbers", lambda text: [(text.index("#") + 1, len(text), "NUMBER", 0.5)] if "#" in text else [])
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text"))
    return registry.engine_spans(docs, "certveil_numbers")


@query("registered_statistic", "SELECT c_mktsegment AS segment, round(median(c_acctbal), 6) AS value FROM customer GROUP BY 1")
def registered_statistic(spark, d):
    value = registry.register_statistic(spark, "certveil_median", lambda x: x.median())
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(value("c_acctbal"), 6).alias("value"))


@query("affinity_mass")
def affinity_mass(spark, d):
    """The graph's numbers over the pool of all forms, with the largest sum of a node's edges."""
    cal, dep, _, _ = _halves(spark, d)
    stats_ = P.pool(cal, dep, P.Config()).stats
    return spark.createDataFrame([tuple(float(stats_[k]) for k in ("nodes", "components", "identity_edges", "similarity_edges", "largest", "mean_size", "epsilon"))], "nodes double, components double, identity_edges double, similarity_edges double, largest double, mean_size double, epsilon double")


@query("gold_counts", """WITH f AS (SELECT doc_id, gid, type, start, "end" FROM (""" + FORM_GOLD_SQL + """)), n AS (SELECT CASE WHEN type = 'PERSON' AND gid = 0 THEN 'first_name' WHEN type = 'DOB' THEN 'api_key' WHEN type = 'PHONE' THEN 'Phone_Number' ELSE type END AS label, CASE WHEN type = 'EMAIL' AND doc_id % 2 = 0 THEN 100000 ELSE "end" END AS e FROM f)
    SELECT label, CASE label WHEN 'first_name' THEN 'PERSON' WHEN 'Phone_Number' THEN 'PHONE' WHEN 'api_key' THEN NULL ELSE label END AS type, count(*) FILTER (WHERE label <> 'api_key' AND e < 100000) AS kept, count(*) FILTER (WHERE label = 'api_key') AS dropped, count(*) FILTER (WHERE label <> 'api_key' AND e = 100000) AS out_of_range FROM n GROUP BY label""")
def gold_counts(spark, d):
    """Native labels of the forms' spans: mapped, dropped or out of range."""
    from ..schema import GRETEL_LABELS

    name = F.when((F.col("type") == "PERSON") & (F.col("gid") == 0), "first_name").when(F.col("type") == "DOB", "api_key").when(F.col("type") == "PHONE", "Phone_Number").otherwise(F.col("type"))
    end = F.when((F.col("type") == "EMAIL") & (F.col("doc_id") % 2 == 0), 100_000).otherwise(F.col("end")).cast("int")
    rows = form_gold(spark, d).select("doc_id", F.struct(F.col("start").cast("int").alias("start"), end.alias("end"), F.lit(None).cast("string").alias("type"), name.alias("label"), F.lit(None).cast("string").alias("text")).alias("g"))
    docs = forms(spark, d).join(rows.groupBy("doc_id").agg(F.collect_list("g").alias("gold")), "doc_id")
    return labels.gold_counts(docs, GRETEL_LABELS)


@query("gold_info", f"SELECT type, count(*) AS n_gold, (SELECT count(*) FROM ({FORMS_SQL})) AS docs, round((SELECT avg(length(text)) FROM ({FORMS_SQL})), 6) AS mean_chars FROM ({FORM_GOLD_SQL}) GROUP BY type")
def gold_info(spark, d):
    return labels.gold_info(forms(spark, d), form_gold(spark, d)).withColumn("mean_chars", F.round("mean_chars", 6))
