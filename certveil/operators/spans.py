"""Span extraction: rule, heuristic and shape engines, suppression and merging.

Spans are rows (doc_id, start, end, type, match, score, engine)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.checksums import iban_valid, luhn_valid, ssn_plausible
from ..functions.text import finditer, iou, part_sums, parts, shape_signature, starts

COLUMNS = ("doc_id", "start", "end", "type", "match", "score", "engine")


@dataclass(frozen=True)
class Rule:
    """One pattern: what its matches are and what they score. ``inner``: only the part at the end that fits it counts."""

    name: str
    type: str
    pattern: str
    score: Callable[[Column, Column], Column]
    near: str | None = None  # context pattern handed to ``score`` and, if ``needed``, asked for
    needed: bool = False
    inner: str | None = None
    keep: Callable[[Column], Column] | None = None
    engine: str = "rule"


def _fixed(x: float):
    return lambda m, near: F.lit(x)


def _either(check, yes: float, no: float):
    return lambda m, near: F.when(check(m), yes).otherwise(no)


def _by_context(yes: float, no: float):
    return lambda m, near: F.when(near, yes).otherwise(no)


RULES = (
    Rule("email", "EMAIL", S.EMAIL, _fixed(0.97)),
    Rule("card", "CREDIT_CARD", S.CARD, _either(luhn_valid, 0.98, 0.35)),
    Rule("iban", "IBAN", S.IBAN, _either(iban_valid, 0.99, 0.40)),
    Rule("ssn", "SSN", S.SSN_DASHED, _either(ssn_plausible, 0.96, 0.50)),
    Rule("ssn-bare", "SSN", S.SSN_BARE, _fixed(0.85), near=S.CONTEXT["SSN"], needed=True),
    Rule("phone", "PHONE", S.PHONE, _by_context(0.92, 0.55), near=S.CONTEXT["PHONE"]),
    Rule("date", "DOB", S.DATE, _by_context(0.90, 0.20), near=S.CONTEXT["DOB"]),
    Rule("account", "ACCOUNT_NUMBER", S.ACCOUNT, _fixed(0.88), near=S.CONTEXT["ACCOUNT_NUMBER"], needed=True),
    Rule("address", "ADDRESS", S.ADDRESS, _either(lambda m: m.rlike(r"[0-9]{5}$"), 0.92, 0.80)),
    Rule("title", "PERSON", S.HONORIFIC, _fixed(0.85), inner=S.NAME),
    Rule("role", "PERSON", S.ROLE, _fixed(0.78), inner=S.NAME),
    Rule("bigram", "PERSON", S.CAP_BIGRAM, _fixed(0.40)),
)


def apply_rules(docs: DataFrame, rules: Iterable[Rule], width: int = 48) -> DataFrame:
    """All rules' spans in one scan of the texts: one regular expression pass per rule, one explode, no join and no shuffle.

    Each match becomes a struct with its start and, where the rule looks around, whether its context fits."""
    rules = list(rules)
    rows = docs.select("doc_id", "text", *[parts(F.col("text"), r.pattern).alias(f"p{k}") for k, r in enumerate(rules)])
    rows = rows.select("*", *[part_sums(f"p{k}").alias(f"s{k}") for k in range(len(rules))])

    def spans(k: int, r: Rule) -> Column:
        def one(start, x):
            if r.near is None:
                near = F.lit(False)
            else:
                left = F.greatest(start - width, F.lit(0))
                near = F.lower(F.substring(F.col("text"), left + 1, start + F.length(x) + width - left)).rlike(r.near)
            part = x if r.inner is None else F.regexp_extract(x, f"({r.inner})$", 1)
            return F.struct(F.lit(k).alias("k"), (start + F.length(x) - F.length(part)).alias("start"), part.alias("match"), near.alias("near"))

        return starts(f"p{k}", f"s{k}", one)

    none = F.array().cast("array<struct<k:int,start:int,match:string,near:boolean>>")
    rows = rows.select("doc_id", F.explode(F.concat(*[spans(k, r) for k, r in enumerate(rules)], none)).alias("x"))
    rows = rows.select("doc_id", "x.k", "x.start", (F.col("x.start") + F.length("x.match")).alias("end"), "x.match", "x.near")
    kind = score = engine = good = None
    for k, r in enumerate(rules):
        at, m, near = F.col("k") == k, F.col("match"), F.col("near")
        ok = (near if r.needed else F.lit(True)) if r.keep is None else r.keep(m)
        kind = F.when(at, r.type) if kind is None else kind.when(at, r.type)
        score = F.when(at, r.score(m, near).cast("double")) if score is None else score.when(at, r.score(m, near).cast("double"))
        engine = F.when(at, r.engine) if engine is None else engine.when(at, r.engine)
        good = F.when(at, ok) if good is None else good.when(at, ok)
    return rows.where(good).select("doc_id", "start", "end", kind.alias("type"), "match", score.alias("score"), engine.alias("engine"))


def rule_spans(docs: DataFrame, types: Iterable[str] = S.FINANCE_TYPES, suppress: bool = True) -> DataFrame:
    """The rule engine: checksummed patterns and context words around them."""
    types = set(types)
    spans = apply_rules(docs, [r for r in RULES if r.type in types])
    return dedupe_overlaps(spans) if suppress else spans


def _union(frames: list[DataFrame], suppress: bool) -> DataFrame:
    out = frames[0]
    for p in frames[1:]:
        out = out.unionByName(p)
    return dedupe_overlaps(out) if suppress else out


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[.,]+|[.,]+$", ""))


def looks_like_person(c: Column) -> Column:
    """2 to 4 words, none a stop word, one a given name or the last with a surname's ending."""
    words = F.transform(F.split(F.trim(c), r"\s+"), _bare)
    ending = F.element_at(words, -1).rlike(f"({'|'.join(S.SURNAME_SUFFIXES)})$")
    lit = lambda names: F.array(*map(F.lit, names))
    return F.size(words).between(2, 4) & ~F.arrays_overlap(words, lit(S.STOP_WORDS)) & (F.arrays_overlap(words, lit(S.GIVEN_NAMES)) | ending)


def _first_name(m: Column) -> Column:
    return _bare(F.element_at(F.split(m, r"\s+"), 1)).isin(*S.GIVEN_NAMES)


NER_RULES = (
    Rule("run", "PERSON", S.TITLE_RUN, _either(_first_name, 0.82, 0.62), keep=looks_like_person, engine="heuristic-ner"),
    Rule("email", "EMAIL", S.EMAIL, _fixed(0.93), engine="heuristic-ner"),
)


def title_case_persons(docs: DataFrame) -> DataFrame:
    return apply_rules(docs, NER_RULES[:1])


def labelled_fields(docs: DataFrame) -> DataFrame:
    """``key: value`` lines. The value's offset is the match's end less what follows the value's start."""
    head = rf"^[\s\-*|]*(?:\*\*)?\s*({S.FIELD_KEY})\s*(?:\*\*)?\s*[:=]\s*(?:\*\*)?\s*"
    line = rf"(?imd){head}.+?\s*(?:\*\*)?\s*$"
    spans = finditer(docs, line)
    prefix = F.regexp_extract("match", rf"(?isd){head}", 0)
    body = F.regexp_replace(F.substring("match", F.length(prefix) + 1, F.length("match")), r"\s*(?:\*\*)?\s*$", "")
    key = F.trim(F.lower(F.regexp_replace(F.regexp_extract("match", rf"(?isd){head}", 1), r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for kv in S.FIELDS.items() for x in kv])
    rows = spans.select("doc_id", (F.col("start") + F.length(prefix)).alias("start"), body.alias("value"), F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.regexp_replace(key, r"\.+$", ""))).alias("type"))
    rows = rows.where("type is not null and value <> '' and not startswith(value, '[') and lower(value) not in ('n/a', 'none', '-')")
    cut = F.regexp_replace("value", r"[ .*|]+$", "")
    rows = rows.withColumn("match", cut).where(F.length("match") > 0)
    return rows.select("doc_id", "start", (F.col("start") + F.length("match")).alias("end"), "type", "match", F.lit(0.90).alias("score"), F.lit("heuristic-ner").alias("engine"))


def heuristic_spans(docs: DataFrame, types: Iterable[str] = S.FINANCE_TYPES, suppress: bool = True) -> DataFrame:
    found = [labelled_fields(docs), apply_rules(docs, NER_RULES)]
    return _union([p.where(F.col("type").isin(*types)) for p in found], suppress)


def shape_spans(docs: DataFrame, types: Iterable[str] = S.FINANCE_TYPES, suppress: bool = True) -> DataFrame:
    """Tokens by the classes of their characters, and pairs of capitalised words."""
    rows = docs.select("doc_id", parts(F.col("text"), r"[^\s,;|]+").alias("parts"))
    rows = rows.select("doc_id", "parts", part_sums("parts").alias("sums"))
    # A token is worked out step by step before the explode: beyond it each condition would work it out anew.
    found = starts("parts", "sums", lambda start, match: F.struct(start.alias("start"), match.alias("match")))
    found = F.transform(found, lambda x: F.struct((x["start"] + F.length(x["match"])).alias("end"), F.regexp_replace(x["match"], r"^[\-*(\[\"']+", "").alias("left")))
    found = F.transform(found, lambda x: F.struct((x["end"] - F.length(x["left"])).alias("start"), F.regexp_replace(x["left"], r"[\-*)\]\"'.:;]+$", "").alias("match")))
    found = F.transform(F.filter(found, lambda x: F.length(x["match"]) >= 3), lambda x: F.struct(x["start"].alias("start"), x["match"].alias("match"), shape_signature(x["match"]).alias("shape")))
    rows = rows.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.start", "x.match", "x.shape")
    kind = F.create_map(*[F.lit(x) for k, (t, _) in S.SHAPES.items() for x in (k, t)])
    score = F.create_map(*[F.lit(x) for k, (_, s) in S.SHAPES.items() for x in (k, s)])
    rows = rows.withColumn("type", F.try_element_at(kind, F.col("shape"))).where(F.col("type").isin(*types))
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    n = F.length("match")
    ok = (
        F.when(F.col("type") == "ACCOUNT_NUMBER", digits.between(8, 17))
        .when(F.col("type") == "IBAN", n.between(12, 34))
        .when(F.col("type") == "PERSON", (n >= 4) & ~F.lower("match").isin(*S.STOP_WORDS))
        .when(F.col("type") == "SSN", digits == 9)
        .otherwise(True)
    )
    rows = rows.where(ok).select("doc_id", "start", (F.col("start") + n).alias("end"), "type", "match", F.try_element_at(score, F.col("shape")).alias("score"), F.lit("shape").alias("engine"))
    if "PERSON" in set(types):
        pairs = finditer(docs, S.CAP_BIGRAM)
        pairs = pairs.where(~F.exists(F.split("match", r"\s"), lambda t: F.lower(t).isin(*S.STOP_WORDS)))
        rows = rows.unionByName(pairs.select("doc_id", "start", "end", F.lit("PERSON").alias("type"), "match", F.lit(0.46).alias("score"), F.lit("shape").alias("engine")))
    return dedupe_overlaps(rows) if suppress else rows


def _keep(threshold: float, strict: bool):
    """Fold step: a span joins those kept unless one of them overlaps it enough."""

    def hit(k, x):
        v = iou(k["start"], k["end"], x["start"], x["end"])
        return v > threshold if strict else v >= threshold

    return hit


def _sorted(*extra: str) -> Column:
    return F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "start", "end", "match", *extra)))


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``island``: spans of one group of ``keys`` that overlap, directly or by way of others. Rules on overlaps hold within islands, which are short."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dedupe_overlaps(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression within (doc_id, engine, type): best score first, then start and end; an overlap over ``threshold`` drops."""
    hit = _keep(threshold, strict=True)
    keys = ["doc_id", "engine", "type"]
    grouped = islands(spans, keys).groupBy(*keys, "island").agg(_sorted().alias("all"))
    empty = F.expr("slice(`all`, 1, 0)")
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda k: hit(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    out = grouped.select("doc_id", "engine", "type", F.explode(kept).alias("x"))
    return out.select("doc_id", "x.start", "x.end", "type", "x.match", (-F.col("x.order")).alias("score"), "engine")


def merge_spans(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The ensemble's merge within (doc_id, type): a span joins the first kept one it overlaps by ``threshold`` or more; engines gather."""
    hit = _keep(threshold, strict=False)
    keys = ["doc_id", "type"]
    grouped = islands(spans, keys).groupBy(*keys, "island").agg(_sorted(F.array("engine").alias("engines")).alias("all"))
    empty = F.expr("slice(`all`, 1, 0)")

    def step(acc, x):
        first = F.array_position(F.transform(acc, lambda k: hit(k, x)), F.lit(True))
        joined = F.transform(acc, lambda k, i: F.struct(k["order"].alias("order"), k["start"].alias("start"), k["end"].alias("end"), k["match"].alias("match"), F.when(i + 1 == first, F.array_sort(F.array_union(k["engines"], x["engines"]))).otherwise(k["engines"]).alias("engines")))
        return F.when(first > 0, joined).otherwise(F.concat(acc, F.array(x)))

    out = grouped.select("doc_id", "type", F.explode(F.aggregate("all", empty, step)).alias("x"))
    return out.select("doc_id", "x.start", "x.end", "type", "x.match", (-F.col("x.order")).alias("score"), "x.engines")


ENGINES = {"rule": rule_spans, "heuristic-ner": heuristic_spans, "ner": heuristic_spans, "heuristic": heuristic_spans, "shape": shape_spans}


def ensemble(docs: DataFrame, spec: str = "rule,heuristic-ner,shape", types: Iterable[str] = S.FINANCE_TYPES) -> DataFrame:
    """All named engines' spans, merged. Unknown names raise."""
    names = [n.strip().lower() for n in spec.split(",") if n.strip()]
    if unknown := [n for n in names if n not in ENGINES]:
        raise ValueError(f"unknown engines: {', '.join(unknown)}")
    return merge_spans(_union([ENGINES[n](docs, types) for n in dict.fromkeys(names)], suppress=False))


def parse_reply(replies: DataFrame) -> DataFrame:
    """A language model's reply (JSON list of {text, type}, fenced or not) as spans at their first occurrence."""
    body = F.regexp_replace(F.regexp_replace("reply", r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```.*$", "")
    items = F.from_json(body, "array<struct<text:string,type:string>>")
    rows = replies.select("doc_id", "text", F.explode(items).alias("x"))
    start = F.expr("locate(x.text, text)") - 1
    return rows.where((F.length("x.text") > 0) & (start >= 0)).select("doc_id", start.alias("start"), (start + F.length("x.text")).alias("end"), F.upper("x.type").alias("type"), F.col("x.text").alias("match"), F.lit(0.7).alias("score"), F.lit("llm").alias("engine"))


def external_engine(docs: DataFrame, name: str, labels: dict[str, str], threshold: float = 0.3) -> DataFrame:
    """Optional model engines, loaded once per worker; they raise ImportError where their package is missing."""
    __import__({"gliner": "gliner", "presidio": "presidio_analyzer"}[name])
    from .models import detect_with

    return detect_with(docs, name, labels, threshold)
