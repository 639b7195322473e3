"""Benchmark decontamination by template canonicalisation.

A text becomes tokens (runs of letters, digits and money or percent signs; a point or comma before a
digit belongs to its number). A token's template is ``#n`` for numbers, ``#u`` for units, ``#p`` for
capitalised words (names), else the token in lower case. Windows of WINDOW templates, at least half
of them plain words, are hashed on both sides and joined. Each window is hashed a second time with
its names as plain lower-case words, so that case never decides whether a copy is found. Windows of
which more than half are numbers and units say too little as templates; they are hashed as the words
that they are, in lower case. A window matches in any form. The coverage of an item is the best of
three shares: of its typed windows, of all windows that have a template, and of all windows.

A document and an item with a coverage of at least ``coverage`` are then aligned token by token on
each diagonal, and the slots are compared: an item's value must stand for one value of the document
throughout. An alignment is one diagonal, a run of diagonals at most WINDOW apart, or all diagonals of
the pair. A pair is contaminated if any of its alignments has both the coverage and a consistency
(distinct item values / distinct value pairs) of at least ``consistency``; the row tells of the one
that covers most (ties: most slots), ``verbatim`` if all its slots are equal, else ``reparameterised``.

Items of SHORTEST to WINDOW - 1 tokens are found wherever their words stand in a row, in any case;
still shorter ones only as a whole document.

All steps are DataFrame functions. The item windows are broadcast while there are at most FEW of
them (counted; 24 bytes each), else both sides are shuffled by hash and salt, so that a common window
doesn't gather in one task.

Defined cases: null or empty texts have no windows; a row with a null id counts as a document (or
item) of its own by its text, and its result has the null id; rows that repeat an id count as one
document (or item) with the better of their alignments; equal windows of several items count for each;
other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import texts_of, written

WINDOW, SHORTEST, FEW, SALTS = 6, 3, 200_000, 16
# Units of measure, time and money, in lower case.
UNITS = (
    "%", "$", "€", "£", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "cent", "cents", "dollar", "dollars", "euro", "euros", "mph", "kmh", "degree", "degrees", "celsius", "fahrenheit", "watt", "watts", "volt", "volts",
)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?:[^\p{L}\p{N}%$€£.,]|[.,](?!\p{N}))+"), lambda t: t != "")


def template(t: Column) -> Column:
    low, first = F.lower(t), F.substring(t, 1, 1)
    name = (F.length(t) > 1) & (F.substring(t, 2, 2_000_000_000) == F.substring(low, 2, 2_000_000_000))
    number = first.between("0", "9") | ((F.length(t) > 1) & (first.isin("$", "€", "£", ".", ",")))
    return F.when(number, F.lit("#n")).when(low.isin(*UNITS), F.lit("#u")).when((t != low) & name, F.lit("#p")).otherwise(low)


def windows(rows: DataFrame, key: str, short: list[int]) -> DataFrame:
    """(key, pos, kind, h) of ``rows`` (key, tokens): the hashes of each window's forms.

    Kind 2 is the window's templates, 1 the templates with names as words, 0 its words: of windows with
    mostly numbers and units, and of all runs of ``short`` tokens. Only the templates are a higher-order
    function; windows are read from the array by position, which compiles, and the outer explode keeps
    the optimizer from working out the templates a second time for a filter."""
    rows = rows.withColumn("templates", F.transform("tokens", template)).select(key, "tokens", "templates", F.posexplode_outer("templates").alias("pos", "_t"))
    n = F.size("templates")
    kinds = [F.get("templates", F.col("pos") + j) for j in range(WINDOW)]
    words = [F.lower(F.get("tokens", F.col("pos") + j)) for j in range(WINDOW)]
    plain = [F.when(k == "#p", w).otherwise(k) for k, w in zip(kinds, words, strict=True)]
    count = lambda test: sum((F.coalesce(test(k), F.lit(False)).cast("int") for k in kinds), F.lit(0))
    names, values = count(lambda k: k == "#p"), count(lambda k: k.isin("#n", "#u"))
    last = F.greatest(n - WINDOW + 1, F.lit(1)) if not short else n - min(short) + 1
    rows = rows.where(F.col("pos") < F.greatest(last, F.lit(1))).withColumn("names", names).withColumn("values", values)
    size, whole = F.least(n, F.lit(WINDOW)), F.col("pos") < F.greatest(n - WINDOW + 1, F.lit(1))
    two = F.when(whole & (2 * (F.col("names") + F.col("values")) <= size), F.xxhash64(*kinds))
    one = F.when(whole & (F.col("names") > 0) & (2 * F.col("values") <= size), F.xxhash64(*plain))
    zero = F.when(whole & (2 * F.col("values") > size), F.xxhash64(F.lit("words"), *words))
    runs = [F.when(F.col("pos") + k <= n, F.xxhash64(F.lit("run"), *words[:k])) for k in short]
    forms = rows.select(key, "pos", F.posexplode(F.array(two, one, zero, *runs)).alias("form", "h")).where("h is not null")
    return forms.select(key, "pos", F.greatest(2 - F.col("form"), F.lit(0)).alias("kind"), "h")


def covered(rows: DataFrame, codes: str) -> DataFrame:
    """Adds n_windows and n_matched: of the windows of kind 2, of kinds 2 and 1, or of all, whichever are covered best (ties: the first of these)."""
    n = [F.col(c) for c in ("n_typed", "n_all", "n_every")]
    least = lambda k: F.size(F.filter(codes, lambda c: c % 4 >= k))
    m = [least(2), least(1), F.size(codes)]
    better = lambda i, j: (n[i] > 0) & (m[i] * n[j] >= m[j] * n[i])
    first, second = better(0, 1) & better(0, 2), better(1, 2)
    pick = lambda x: F.when(first, x[0]).when(second, x[1]).otherwise(x[2])
    return rows.withColumn("n_windows", pick(n)).withColumn("n_matched", pick(m))


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): a null id is told apart by its text. No field of the key is null, so that keys can be joined."""
    text, none = F.col("text").cast("string"), F.col(key).cast("long").isNull()
    own = F.when(none, F.xxhash64(text)).otherwise(F.col(key).cast("long"))
    return rows.select(F.struct(own.alias("id"), none.alias("none")).alias(key), text.alias("text"))


def _id(key: str) -> Column:
    return F.when(~F.col(f"{key}.none"), F.col(f"{key}.id")).alias(key)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, consistency: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, n_slots, consistency, kind: one row for each contaminated pair."""
    texts = _keyed(docs, "doc_id")
    items = _keyed(benchmark, "item_id").select("item_id", tokens(F.col("text")).alias("item_tokens"))
    sizes = items.select(F.size("item_tokens").alias("n")).where(F.col("n").between(SHORTEST, WINDOW - 1)).distinct()
    short = sorted(r.n for r in sizes.collect())  # at most WINDOW - SHORTEST rows
    by_size = [items.where(F.size("item_tokens") == k) if k else items.where(~F.size("item_tokens").isin(*short)) if short else items for k in (0, *short)]
    parts = [windows(part.select("item_id", F.col("item_tokens").alias("tokens")), "item_id", [k] if k else []) for part, k in zip(by_size, (0, *short), strict=True)]
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)
    grams = grams.withColumnRenamed("pos", "ipos").distinct()
    # A window's code is four times its position, and its highest kind.
    kind = F.max("kind").over(Window.partitionBy("item_id", "ipos"))
    grams = written(grams.select("item_id", (4 * F.col("ipos") + kind).alias("code"), "h").distinct(), "windows")
    of = lambda k: F.countDistinct(F.when(F.col("code") % 4 >= k, F.col("code")))
    totals = grams.groupBy("item_id").agg(of(2).alias("n_typed"), of(1).alias("n_all"), of(0).alias("n_every"))
    few = grams.limit(FEW + 1).count() <= FEW

    found = windows(texts.select("doc_id", tokens(F.col("text")).alias("tokens")), "doc_id", short)
    if few:
        hits = found.join(F.broadcast(grams), "h")
    else:
        salted = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.hash("doc_id", "pos"), F.lit(SALTS))).join(salted, ["h", "salt"])
    runs = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.expr("code div 4").cast("int")).alias("shift")).agg(F.collect_set("code").alias("codes"))
    runs = written(runs, "runs")  # read twice
    pairs = runs.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("all"))
    counts = ["n_typed", "n_all", "n_every"]
    pairs = covered(pairs.join(totals, "item_id"), "all").where(F.col("n_matched") >= coverage * F.col("n_windows")).select("doc_id", "item_id", *counts)
    first, last = F.expr("array_min(codes) div 4").cast("int").alias("low"), F.expr("array_max(codes) div 4").cast("int").alias("high")
    chosen = written(runs.join(pairs, ["doc_id", "item_id"]).select("doc_id", "item_id", *counts, "shift", "codes", first, last), "aligned")

    aligned = chosen.withColumnRenamed("doc_id", "doc").join(texts_of(texts, chosen.select(F.col("doc_id").alias("doc"))), "doc").join(items.select("item_id", "item_tokens"), "item_id")
    aligned = aligned.withColumn("doc_tokens", tokens(F.col("text")))
    size = F.col("high") - F.col("low") + WINDOW
    ours, theirs = F.slice("item_tokens", F.col("low") + 1, size), F.slice("doc_tokens", F.greatest(F.col("low") + F.col("shift") + 1, F.lit(1)), size)
    slots = F.filter(
        F.zip_with(ours, theirs, lambda a, b: F.struct(template(a).alias("kind"), template(b).alias("other"), F.lower(a).alias("a"), F.lower(b).alias("b"))),
        lambda s: (s["kind"] == s["other"]) & (F.substring(s["kind"], 1, 1) == "#"),
    )
    slots = aligned.select("doc", "item_id", *counts, "shift", "codes", slots.alias("slots"))
    # Alignments: each diagonal, each run of neighbouring diagonals (a copy with words put in or left out), all together.
    w = Window.partitionBy("doc", "item_id").orderBy("shift")
    new = F.coalesce(F.col("shift") - F.lag("shift").over(w) > WINDOW, F.lit(True)).cast("int")
    slots = slots.withColumn("new", new).withColumn("copy", F.sum("new").over(w))
    ways = F.array(*[F.struct(F.lit(k).alias("way"), c.cast("int").alias("at")) for k, c in enumerate((F.lit(0), F.col("copy"), F.col("shift")))])
    slots = slots.withColumn("by", F.explode(ways)).groupBy("doc", "item_id", *counts, "by").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    slots = covered(slots, "codes").where(F.col("n_matched") >= coverage * F.col("n_windows"))
    values, both = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["a"])))), F.size(F.array_distinct("slots"))
    changed = F.exists("slots", lambda s: s["a"] != s["b"])
    out = slots.select(
        F.col("doc").alias("doc_id"), "item_id", "n_windows", F.col("n_matched").cast("long").alias("n_matched"), F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage"), F.size("slots").cast("long").alias("n_slots"),
        F.when(both > 0, F.round(values / both, 6)).otherwise(F.lit(1.0)).alias("consistency"), F.when(changed, "reparameterised").otherwise("verbatim").alias("kind"), "by",
    )
    best = F.max_by(F.struct(*[c for c in out.columns if c not in ("doc_id", "item_id", "by")]), F.struct("coverage", "n_slots", -F.col("by.way"), "by.at"))
    return out.where(F.col("consistency") >= consistency).groupBy("doc_id", "item_id").agg(best.alias("x")).select(_id("doc_id"), _id("item_id"), "x.*")
