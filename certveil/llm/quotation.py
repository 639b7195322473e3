"""Quotation linking: from quoted messages to reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` marks it begins with. A message's own text is its lines
of level 0, without a line that only introduces a quote ("... wrote:"). Consecutive quoted lines of
one level form a run. A run, each of its paragraphs and each of its lines are units; a unit is
normalised (lower case, white space to one space) and hashed. Each message's own text offers its
whole, its paragraphs and its lines, hashed alike; the first message to say a unit is its original:
the earliest of the same conversation before the quoting message, else the earliest of all if that
comes before by (conv_id, turn). Units of fewer than SHORT characters say too little for the latter;
they are linked within their conversation only. A run is linked by its whole, else by those of its
paragraphs that are found, and the others by those of their lines that are.

A message replies to the original that its quotes of level 1 cover with the most characters (ties:
the same conversation, then the latest). Pointer jumping finds the first message of its thread and
its depth; a message without original begins at its own conversation. ``position`` numbers a thread's
rows from 0 in the order of (conv_id, turn), so that every reply comes after what it replies to.

All steps are DataFrame functions. A hot unit, original, conversation or thread is split: joins
broadcast the hot keys (see ``split_join``) or are salted, aggregates combine before the shuffle, and
positions are counted within ranges of rows and shifted by the counts of the ranges before.

Defined cases: null text is empty; messages with a null conv_id or turn keep their own text and are
linked with nothing (position null); repeated (conv_id, turn) rows are each returned and take the same
parent; ties in the order go by role and text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, split_join, written

SHORT = 12  # characters below which a unit is linked within its conversation only
FEW, SALTS = 200_000, 16  # asked units up to which they are broadcast (44 bytes each); else salts of their join
_PREFIX = r"^[ \t]*(?:>[ \t]?)+"
_INTRO = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def _normal(c):
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def split_quotes(messages: DataFrame) -> DataFrame:
    """Adds ``own`` (text without quotes) and ``lines`` (position, level, body) to (conv_id, turn, role, text)."""
    parts = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 0), "[^>]", ""))
    rows = messages.withColumn("lines", F.transform(parts, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _PREFIX, "").alias("body"))))
    plain = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(_INTRO) & (F.coalesce(F.try_element_at(F.col("lines"), i + 2)["level"], F.lit(0)) > 0)))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    own = F.when(quoted, F.regexp_replace(F.array_join(F.transform(plain, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce("text", F.lit("")))
    return rows.withColumn("own", own)


def _units(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, row, run, level, grain, para, chars, key) of quoted runs (grain 0), paragraphs (1) and lines (2)."""
    some = rows.where(F.exists("lines", lambda x: x["level"] > 0)).withColumn("row", F.monotonically_increasing_id())
    lines = some.select("conv_id", "turn", "row", F.posexplode("lines").alias("at", "line")).select("conv_id", "turn", "row", "at", "line.level", "line.body")
    w = Window.partitionBy("row").orderBy("at")
    lines = lines.withColumn("new", (F.coalesce(F.lag("level").over(w), F.lit(-1)) != F.col("level")).cast("int")).withColumn("blank", F.col("body").rlike(r"^\s*$").cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(w)).withColumn("para", F.sum("blank").over(w)).where("level > 0")
    none = F.lit(-1).cast("long")
    grains = F.array(*[F.struct(F.lit(k).alias("grain"), p.cast("long").alias("para"), n.cast("long").alias("line")) for k, p, n in ((0, none, none), (1, F.col("para"), none), (2, F.col("para"), F.col("at")))])
    keys = ["conv_id", "turn", "row", "run", "level"]
    parts = lines.select(*keys, "at", "body", F.explode(grains).alias("g")).groupBy(*keys, "g").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    units = parts.select(*keys, "g.grain", "g.para", _normal(F.array_join(F.transform("parts", lambda x: x["body"]), " ")).alias("unit")).where("unit <> ''")
    return units.withColumn("chars", F.length("unit")).withColumn("key", F.sha2("unit", 256)).drop("unit")


def _said(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, conv_id, turn): who first says each of the ``asked`` units in each conversation."""
    lines = F.split("own", r"\r\n|\r|\n")
    texts = F.array_distinct(F.concat(F.array(F.col("own")), F.split("own", r"\n\s*\n"), lines))
    said = keyed.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(texts, _normal))).alias("unit")).where("unit <> ''")
    said = said.select(F.sha2("unit", 256).alias("key"), "conv_id", "turn")
    if asked.limit(FEW + 1).count() <= FEW:
        found = said.join(F.broadcast(asked), "key", "left_semi")
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = said.withColumn("salt", F.pmod(F.hash("conv_id", "turn"), F.lit(SALTS))).join(salted, ["key", "salt"], "left_semi")
    return found.groupBy("key", "conv_id").agg(F.min("turn").alias("turn"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_conv, parent_turn, thread_conv, thread_turn, depth, position."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = split_quotes(base)
    keyed = rows.where("conv_id is not null and turn is not null")
    units = written(_units(keyed), "units")
    total = units.count()
    said = written(_said(keyed, units.select("key").distinct()), "said")

    here = said.withColumnRenamed("turn", "here_turn").join(units.groupBy("key", "conv_id").agg(F.count("*").alias("n")), ["key", "conv_id"])
    first = said.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first")).join(units.groupBy("key").agg(F.count("*").alias("n")), "key")
    found = split_join(units, here, ["key", "conv_id"], "n", total, "left").drop("n")
    found = split_join(found, first, ["key"], "n", total, "left").drop("n")
    near = F.col("here_turn") < F.col("turn")
    far = (F.col("first") < F.struct("conv_id", "turn")) & (F.col("chars") >= SHORT)
    original = F.when(near, F.struct("conv_id", F.col("here_turn").alias("turn"))).when(far, F.col("first"))
    runs = found.groupBy("conv_id", "turn", "row", "run", "level").agg(F.collect_list(F.struct("grain", "para", "chars", original.alias("o"))).alias("all"))
    good = F.filter("all", lambda u: u["o"].isNotNull())
    paras = F.transform(F.filter("good", lambda u: u["grain"] == 1), lambda u: u["para"])
    chosen = F.filter("good", lambda u: F.when(F.exists("good", lambda v: v["grain"] == 0), u["grain"] == 0).otherwise((u["grain"] == 1) | ((u["grain"] == 2) & ~F.array_contains("paras", u["para"]))))
    runs = written(runs.withColumn("good", good).withColumn("paras", paras).select("conv_id", "turn", "level", chosen.alias("links")), "runs")
    weights = runs.where("level = 1").select("conv_id", "turn", F.explode("links").alias("u")).groupBy("conv_id", "turn", "u.o").agg(F.sum("u.chars").alias("chars"))
    best = weights.groupBy("conv_id", "turn").agg(F.max(F.struct("chars", (F.col("o.conv_id") == F.col("conv_id")).alias("same"), "o")).alias("b"))
    parents = written(best.select("conv_id", "turn", F.col("b.o.conv_id").alias("parent_conv"), F.col("b.o.turn").alias("parent_turn")), "parents")
    counts = runs.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count_if(F.size("links") > 0).alias("n_linked"))
    roots = _roots(parents)

    out = keyed.join(counts, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    out = out.withColumn("thread_conv", F.coalesce("root_conv", "conv_id"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    columns = ["conv_id", "turn", "role", F.col("own").alias("text"), zero("n_quotes"), zero("n_linked"), "parent_conv", "parent_turn", "thread_conv"]
    out = written(out.select(*columns, "root_turn", zero("depth")), "linked")
    starts = keyed.groupBy("conv_id").agg(F.min("turn").alias("start")).withColumnRenamed("conv_id", "thread_conv").join(out.groupBy("thread_conv").agg(F.count("*").alias("n")), "thread_conv")
    out = split_join(out, starts, ["thread_conv"], "n", out.count(), "left").withColumn("thread_turn", F.coalesce("root_turn", "start"))
    fields = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth"]
    out = _positions(out.select(fields))
    lost = rows.where("conv_id is null or turn is null").select("conv_id", "turn", "role", F.col("own").alias("text"))
    return out.unionByName(lost.withColumns({"n_quotes": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long"), "depth": F.lit(0).cast("long")}), allowMissingColumns=True)


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``position``: a row's number in its thread. Ranges of all rows in order are counted by themselves and shifted."""
    thread, order = ["thread_conv", "thread_turn"], ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *thread, *order)
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*thread).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shifts = ranged.groupBy(*thread, "range").agg(F.count("*").alias("n")).select(*thread, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy(*thread, "range").orderBy(*order)
    out = ranged.withColumn("rank", F.row_number().over(within)).join(shifts, [*thread, "range"])
    return out.select(*rows.columns, (F.col("shift") + F.col("rank") - 1).alias("position"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of the messages that have a parent."""
    now = parents.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    root, total = ["root_conv", "root_turn"], parents.count()
    while total:
        above = now.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("d"))
        above = above.join(now.groupBy(*root).agg(F.count("*").alias("n")), root)
        moved = split_join(now, above, root, "n", total, "left")
        moved = moved.select("conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return now
