"""The nested masking family, its risks, and the choice of an operating point.

Candidates: (doc_id, cand, type, start, end, score); gold: (doc_id, gid, type, start, end); tokens:
(doc_id, k, start, end). Instead of a document-by-grid matrix every candidate gets the step of the
path that masks it first; risks follow by counting and cumulative sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import crc_bound, hoeffding_bentkus
from ..functions.text import iou
from .folds import fold


def levels(candidates: DataFrame) -> DataFrame:
    return candidates.select("type", "score").distinct()


def mask_path(candidates: DataFrame, grid: int = 2048) -> DataFrame:
    """(j, t, type, score, complete): step 0 masks nothing, step j lowers ``type`` to ``score`` (by score, ties by type), the last
    step is full redaction. There are at most ``grid`` steps, so only that many levels are ever sorted or gathered."""
    if grid < 2:
        raise ValueError("a path has two steps at least")
    top = levels(candidates).orderBy(F.desc("score"), "type").limit(grid - 2)
    w = Window.orderBy(F.desc("score"), "type")
    steps = top.select(F.row_number().over(w).alias("j"), "type", "score")
    return _closed(steps)


def _closed(steps: DataFrame) -> DataFrame:
    """Adds step 0, full redaction and the place t of each step on the path to (j, type, score) with j from 1."""
    n = steps.agg((F.coalesce(F.max("j"), F.lit(0)) + 1).alias("n"))
    ends = n.select(F.explode(F.array(F.lit(0), F.col("n"))).alias("j")).select("j", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("score"))
    rows = steps.select("j", "type", F.col("score").cast("double").alias("score")).unionByName(ends).crossJoin(F.broadcast(n))
    return rows.select("j", F.when(F.col("j") < F.col("n"), F.col("j") / F.col("n")).otherwise(1.0).alias("t"), "type", "score", (F.col("j") == F.col("n")).alias("complete"))


def quantile_path(candidates: DataFrame, grid: int = 2048) -> DataFrame:
    """(j, t, type, score, complete): all types at once at one share of their scores, in ``grid`` steps at most, repeats collapsed.

    A step's threshold is the order statistic of all scores of the type. Scores are counted per level, so each level knows
    the ranks it holds and hence the few steps that fall on it."""
    inner = max(grid - 2, 1)
    counts = candidates.groupBy("type", "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy("score")
    ranked = counts.withColumn("hi", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("type"))).withColumn("lo", F.col("hi") - F.col("n"))
    share = lambda r: (inner + 1) * (1 - r / F.greatest(F.col("total") - 1, F.lit(1)))
    first, last = F.greatest(F.floor(share(F.col("hi"))) - 1, F.lit(1)), F.least(F.ceil(share(F.col("lo"))) + 1, F.lit(inner))
    rows = ranked.where(first <= last).withColumn("i", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.floor((1 - F.col("i") / (inner + 1)) * (F.col("total") - 1) + 1e-12)
    rows = rows.where((at >= F.col("lo")) & (at < F.col("hi"))).select("i", "type", F.col("score").cast("double").alias("score"))
    steps = rows.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("type", "score"))).alias("all"))  # a row a step, a type an entry
    order = Window.orderBy("i")
    steps = steps.withColumn("new", F.coalesce(F.lag("all").over(order) != F.col("all"), F.lit(True)).cast("int")).where("new = 1")
    steps = steps.withColumn("j", F.row_number().over(order)).select("j", "all").select("j", F.explode("all").alias("x")).select("j", "x.type", "x.score")
    return _closed(steps)


def activation(candidates: DataFrame, path: DataFrame) -> DataFrame:
    """Candidates with ``j``, the first step that masks them; null for those that only full redaction does. The path is at most its grid."""
    rows = path.where("type is not null").groupBy("type", "score").agg(F.min("j").alias("j"))
    return candidates.join(F.broadcast(rows), ["type", "score"], "left")


def thresholds_at(candidates: DataFrame, j: int, path: DataFrame | None = None) -> DataFrame:
    """(type, threshold) of a step; types that the step leaves alone have no row."""
    rows = (mask_path(candidates) if path is None else path).where(F.col("type").isNotNull() & (F.col("j") <= j))
    return rows.groupBy("type").agg(F.min("score").alias("threshold"))


def mask(candidates: DataFrame, thresholds: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Candidates at or over their type's threshold, or resolved by (doc_id, start, end, type)."""
    hit = candidates.join(F.broadcast(thresholds), "type", "left").withColumn("masked", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    if resolved is not None:
        keys = ["doc_id", "start", "end", "type"]
        hit = hit.join(resolved.select(*keys).distinct().withColumn("r", F.lit(True)), keys, "left").withColumn("masked", F.col("masked") | F.coalesce("r", F.lit(False))).drop("r")
    return hit.where("masked").select(candidates.columns)


def banded(candidates: DataFrame, thresholds: DataFrame, floor: float) -> DataFrame:
    """Candidates between the review floor and their type's threshold."""
    t = candidates.join(F.broadcast(thresholds), "type", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1 + 1e-9)))
    return t.where((F.col("score") >= floor) & (F.col("score") < F.col("threshold"))).select(candidates.columns)


def gold_matches(gold: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """Gold spans joined to candidates of their document and type with enough overlap."""
    c = candidates.select("doc_id", "type", F.col("start").alias("cs"), F.col("end").alias("ce"), *[x for x in candidates.columns if x not in ("doc_id", "type", "start", "end")])
    both = gold.join(c, ["doc_id", "type"])
    return both.where((F.col("cs") < F.col("end")) & (F.col("start") < F.col("ce")) & (iou(F.col("start"), F.col("end"), F.col("cs"), F.col("ce")) >= least))


def leakage(gold: DataFrame, masked: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, leak): the share of a document's gold spans that no masked span covers; documents without gold have none."""
    covered = gold_matches(gold, masked, least).select("doc_id", "gid").distinct().withColumn("hit", F.lit(1))
    return gold.join(covered, ["doc_id", "gid"], "left").groupBy("doc_id").agg((1 - F.count("hit") / F.count("*")).alias("leak"))


def covered_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.select("doc_id", F.col("start").alias("ss"), F.col("end").alias("se"))
    cond = (tokens["doc_id"] == s["doc_id"]) & (s["ss"] < tokens["end"]) & (tokens["start"] < s["se"])
    return tokens.join(s, cond, "left_semi")


def plain_tokens(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """Tokens outside gold spans. The join is by document alone, so that later ones find the tokens where they are."""
    g = gold.select(F.col("doc_id").alias("_d"), F.col("start").alias("ss"), F.col("end").alias("se"))
    return tokens.join(g, (F.col("doc_id") == F.col("_d")) & (F.col("ss") < F.col("end")) & (F.col("start") < F.col("se")), "left_anti")


def first_on_tokens(plain: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, k, j) of every token: the least ``j`` of the spans that touch it, null where none does. Shuffles no token again."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("start").alias("ss"), F.col("end").alias("se"), "j")
    rows = plain.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("ss") < F.col("end")) & (F.col("start") < F.col("se")), "left")
    return rows.groupBy("doc_id", "k").agg(F.min("j").alias("j"))


def first_on_gold(gold: DataFrame, spans: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, gid, j) of every gold span: the least ``j`` of the spans that match it, null where none does."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("type").alias("_t"), F.col("start").alias("cs"), F.col("end").alias("ce"), "j")
    near = (F.col("cs") < F.col("end")) & (F.col("start") < F.col("ce")) & (iou(F.col("start"), F.col("end"), F.col("cs"), F.col("ce")) >= least)
    return gold.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("type") == F.col("_t")) & near, "left").groupBy("doc_id", "gid").agg(F.min("j").alias("j"))


def overmask(tokens: DataFrame, gold: DataFrame, masked: DataFrame) -> DataFrame:
    """(doc_id, over): the masked share of the tokens outside gold spans."""
    hit = first_on_tokens(plain_tokens(tokens, gold), masked.withColumn("j", F.lit(1)))
    return hit.groupBy("doc_id").agg((F.count("j") / F.count("*")).alias("over"))


def escalation(candidates: DataFrame, thresholds: DataFrame, floor: float) -> DataFrame:
    t = candidates.join(F.broadcast(thresholds), "type", "left")
    inside = (F.col("score") >= floor) & (F.col("score") < F.coalesce("threshold", F.lit(1 + 1e-9)))
    return t.groupBy("doc_id").agg(F.avg(inside.cast("double")).alias("esc"))


def document_losses(candidates: DataFrame, gold: DataFrame, tokens: DataFrame, docs: DataFrame, path: DataFrame, least: float = 0.5, floor: float = 0.2) -> DataFrame:
    """(doc_id, n_gold, n_plain, n_cands, n_band, events): what every step of the path does to each document of ``docs``.

    ``events`` are (j, gold, plain, band), by j: how many gold spans, tokens outside gold and banded candidates step j is the
    first to mask. A document's risks at any step are sums of its few events; there is no matrix of documents and steps."""
    act = activation(candidates, path)
    inside = F.col("score") >= floor
    kinds = ("gold", "plain", "band", "cand", "doc")
    rows = lambda x, **n: x.select("doc_id", "j", *[(n[k] if k in n else F.lit(0)).cast("long").alias(k) for k in kinds])
    n = F.count("*")
    parts = [
        rows(first_on_gold(gold, act, least).groupBy("doc_id", "j").agg(n.alias("n")), gold=F.col("n")), rows(first_on_tokens(plain_tokens(tokens, gold), act).groupBy("doc_id", "j").agg(n.alias("n")), plain=F.col("n")),
        rows(act.withColumn("j", F.when(inside, F.col("j"))), band=inside, cand=F.lit(1)), rows(docs.select("doc_id", F.lit(None).cast("int").alias("j")), doc=F.lit(1)),
    ]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).repartition("doc_id").groupBy("doc_id", "j").agg(*[F.sum(k).alias(k) for k in kinds])
    event = F.when(F.col("j").isNotNull() & (F.col("gold") + F.col("plain") + F.col("band") > 0), F.struct("j", *kinds[:3]))
    total = lambda k, name: F.sum(k).alias(name)
    out = each.groupBy("doc_id").agg(total("gold", "n_gold"), total("plain", "n_plain"), total("cand", "n_cands"), total("band", "n_band"), total("doc", "n_docs"), F.array_sort(F.collect_list(event)).alias("events"))
    return out.where("n_docs > 0").drop("n_docs")


def mean_risks(losses: DataFrame, path: DataFrame) -> DataFrame:
    """(j, t, n, leak, over, esc): the risks of each step, averaged over all documents.

    Documents without gold leak nothing and those without other tokens can't be masked too much; full redaction leaks
    nothing, masks all and leaves all to review. Weighted events, then one cumulative sum over the steps."""
    totals = losses.agg(F.count("*").alias("n"), F.count_if(F.col("n_gold") > 0).alias("dg"), F.count_if(F.col("n_plain") > 0).alias("dt"), F.sum(F.col("n_band") / F.greatest("n_cands", F.lit(1))).alias("eb"))
    e = losses.select("n_gold", "n_plain", "n_cands", F.explode("events").alias("e"))
    share = lambda a, b: F.sum(F.when(F.col(b) > 0, F.col(f"e.{a}") / F.col(b)).otherwise(0.0)).alias(a)
    sums = e.groupBy("e.j").agg(share("gold", "n_gold"), share("plain", "n_plain"), share("band", "n_cands"))
    w = Window.orderBy("j")
    run = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(w)
    rows = path.groupBy("j").agg(F.first("t").alias("t"), F.max("complete").alias("complete")).join(sums, "j", "left")
    rows = rows.select("j", "t", "complete", run("gold").alias("g"), run("plain").alias("p"), run("band").alias("b")).crossJoin(F.broadcast(totals))
    n = F.greatest("n", F.lit(1))
    pick = lambda end, other: F.when(F.col("complete"), end).otherwise(other)
    return rows.select(
        "j", "t", "n", (pick(F.lit(0.0), F.col("dg") - F.col("g")) / n).alias("leak"), (pick(F.col("dt").cast("double"), F.col("p")) / n).alias("over"),
        pick(F.lit(1.0), (F.coalesce("eb", F.lit(0.0)) - F.col("b")) / n).alias("esc"),
    )


def leak_histograms(losses: DataFrame, steps: list[int], weights: DataFrame | None = None, parts: int = 1000) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each of ``steps`` the distinct leakages and how many documents have them, from changes alone.

    Leakages (times ``weights`` (doc_id, w), where given) are rounded up to 1/parts, which keeps bounds on them valid and
    the result small: steps times some parts rows, whatever the number of documents."""
    rows = losses.join(weights, "doc_id", "left") if weights is not None else losses.withColumn("w", F.lit(1.0))
    w = F.coalesce("w", F.lit(1.0))
    value = lambda left: F.ceil(F.round(left / F.greatest("n_gold", F.lit(1)) * w * parts, 6)).cast("long")
    hits = F.filter("events", lambda e: e["gold"] > 0)
    rows = rows.select("n_gold", "w", hits.alias("hits"))
    before = lambda i: F.aggregate(F.slice("hits", F.lit(1), i), F.lit(0).cast("long"), lambda s, e: s + e["gold"])
    moves = F.flatten(F.transform("hits", lambda e, i: F.array(F.struct(e["j"].alias("j"), value(F.col("n_gold") - before(i)).alias("loss"), F.lit(-1).alias("n")), F.struct(e["j"].alias("j"), value(F.col("n_gold") - before(i) - e["gold"]).alias("loss"), F.lit(1).alias("n")))))
    start = F.array(F.struct(F.lit(0).alias("j"), value(F.col("n_gold")).alias("loss"), F.lit(1).alias("n")))
    changes = rows.select(F.explode(F.concat(start, moves)).alias("x")).groupBy("x.loss", "x.j").agg(F.sum("x.n").alias("n")).where("n <> 0").orderBy("j").collect()
    out, now, at = {}, {}, 0
    for j in sorted(steps):
        while at < len(changes) and changes[at].j <= j:
            now[changes[at].loss] = now.get(changes[at].loss, 0) + changes[at].n
            at += 1
        some = sorted((x, n) for x, n in now.items() if n)
        out[j] = np.array([x / parts for x, _ in some]), np.array([n for _, n in some], float)
    return out


def betting_path(losses: DataFrame, steps: int, alpha: float, gamma: float) -> DataFrame:
    """(j, b_leak, b_over): betting p-values of every step, full redaction last, the documents in the order of doc_id.

    A sequential test: one task reads the documents in turn and holds a bettor per step and risk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leak, over = LowBettor(alpha, steps=steps), LowBettor(gamma, steps=steps)
        for batch in batches:
            for n_gold, n_plain, events in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, p = np.zeros(steps), np.zeros(steps)
                for e in events:
                    g[e["j"]] += e["gold"]
                    p[e["j"]] += e["plain"]
                x = np.round((n_gold - np.cumsum(g)) / n_gold, 12) if n_gold else np.zeros(steps)
                y = np.cumsum(p) / n_plain if n_plain else np.zeros(steps)
                x[-1], y[-1] = 0.0, float(n_plain > 0)
                leak.see(x)
                over.see(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(steps, dtype=np.int32)), pa.array(leak.ps()), pa.array(over.ps())], names=["j", "b_leak", "b_over"])

    rows = losses.orderBy("doc_id").select("n_gold", "n_plain", "events").coalesce(1)
    return rows.mapInArrow(run, "j int, b_leak double, b_over double")


def crc_select(risks: DataFrame, n: Column, alpha: float, bound: float = 1.0) -> DataFrame:
    """(j_star, inflated): the first step whose inflated mean risk is at most ``alpha``."""
    ok = risks.withColumn("inflated", crc_bound(F.col("mean_risk"), n, bound)).where(F.col("inflated") <= alpha)
    return ok.agg(F.min("j").alias("j_star"), F.min_by("inflated", "j").alias("inflated"))


def weighted_crc(losses: DataFrame, weights: DataFrame, alpha: float, bound: float = 1.0, inflation: float = 0.0) -> DataFrame:
    """(j_star, risk): weights as weighted_crc_weights has them; the left-over mass counts at the bound."""
    total = weights.agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    rows = losses.join(weights, "pos").crossJoin(F.broadcast(total))
    means = rows.groupBy("j").agg((F.sum(F.col("w") * F.col("loss")) / F.max(F.col("s") + F.col("m")) + bound * F.max(F.col("m") / (F.col("s") + F.col("m")))).alias("risk"))
    return means.where(F.col("risk") <= alpha - inflation).agg(F.min("j").alias("j_star"), F.min_by("risk", "j").alias("risk"))


def weighted_crc_weights(weights: DataFrame) -> DataFrame:
    """(pos, weight) from (pos, w): w / (sum w + max w). Negative weights raise when they are met; all zero gives equal ones."""
    total = weights.agg(F.sum("w").alias("s"), F.max("w").alias("m"), F.count("*").alias("n"))
    safe = F.when(F.col("w") < 0, F.raise_error(F.lit("weights are not negative"))).otherwise(F.col("w"))
    return weights.crossJoin(F.broadcast(total)).select("pos", F.when(F.col("s") > 0, safe / (F.col("s") + F.col("m"))).otherwise(1 / (F.col("n") + 1)).alias("weight"))


def bounded_mean_pvalue(hb: Column, betting: Column, combine: str = "min2") -> Column:
    """The p-value of "the mean is at least alpha": of one kind, or twice the smaller."""
    if combine not in ("hb", "betting", "min2"):
        raise ValueError(f"unknown combination {combine!r}")
    return {"hb": hb, "betting": betting, "min2": F.least(F.lit(1.0), 2 * F.least(hb, betting))}[combine]


def learn_then_test(risks: DataFrame, alpha: float, gamma: float, delta: float, method: str = "fixed-sequence", combine: str = "hb") -> DataFrame:
    """(j, p_leak, p_over, certified) from (j, n, leak, over), with (b_leak, b_over) if betting is combined: the leakage walk
    comes down from the last step, the other up from the first."""
    hb = lambda m, level: hoeffding_bentkus(F.col(m), F.col("n"), level)
    bet = lambda m: F.lit(1.0) if combine == "hb" else F.coalesce(F.col(m), F.lit(1.0))
    p = lambda m, b, level: F.when(F.col("n") > 0, bounded_mean_pvalue(hb(m, level), bet(b), combine)).otherwise(1.0)
    rows = risks.select("j", p("leak", "b_leak", alpha).alias("p_leak"), p("over", "b_over", gamma).alias("p_over"))
    if method == "bonferroni":
        level = delta / 2 / F.count("*").over(Window.partitionBy())
        return rows.withColumn("certified", (F.col("p_leak") <= level) & (F.col("p_over") <= level))
    w = Window.orderBy("j")
    down = F.min((F.col("p_leak") <= delta / 2).cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    up = F.min((F.col("p_over") <= delta / 2).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("certified", (down == 1) & (up == 1))


class LowBettor:
    """A bettor against "the mean is over alpha", once or side by side for many steps (arrays). It stakes nothing at
    first, then by the mean and variance of what came before (they begin at 1/2 and 1/4)."""

    def __init__(self, alpha: float, fraction: float = 0.5, steps: int | None = None):
        self.alpha, self.most, self.n = alpha, fraction / (1 - alpha), 0
        self.wealth, self.peak, self.mu, self.var = (np.full(steps or 1, x) for x in (1.0, 1.0, 0.5, 0.25))

    def see(self, x) -> None:
        x = np.clip(x, 0.0, 1.0)
        gap = self.alpha - self.mu
        stake = np.clip(gap / np.maximum(self.var, 1e-4), 0.0, self.most) if self.n else 0.0
        self.wealth = np.clip(self.wealth * (1 + stake * (self.alpha - x)), 0.0, 1e300)
        self.n += 1
        d = x - self.mu
        self.mu = self.mu + d / self.n
        self.var = self.var + (d * (x - self.mu) - self.var) / self.n
        self.peak = np.maximum(self.peak, self.wealth)

    def ps(self) -> np.ndarray:
        return np.where(self.wealth > 0, np.minimum(1.0, 1 / self.peak), 1.0)

    def p(self) -> float:
        return float(self.ps()[0])


def betting_pvalue(values: DataFrame, alpha: float, key: str = "series", fraction: float = 0.5) -> DataFrame:
    """(key, p): one over the largest wealth of a bettor against "mean over alpha", in the order of ``pos``."""
    rows = values.select(key, "pos", F.col("x").cast("double").alias("x"))
    return fold(rows, [key], ["pos"], ["x"], f"`{key}` {dict(rows.dtypes)[key]}, p double", lambda: LowBettor(alpha, fraction), LowBettor.see, lambda b: (b.p(),))


def operating_point(points: DataFrame, by: str = "rho", budget: float = 1.0) -> DataFrame:
    """The certified point within the escalation budget with the best key (rho: widest radius, min_escalation, min_overmask); else the widest of all."""
    key = {"rho": F.col("rho"), "min_escalation": -F.col("esc"), "min_overmask": -F.col("over")}[by]
    inside = F.col("esc") <= budget
    best = points.where("certified").agg(F.max_by("j", F.struct(inside.alias("i"), F.when(inside, key).otherwise(F.col("rho")).alias("k"), -F.col("j"))).alias("j"))
    return best
