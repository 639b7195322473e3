"""Text expressions: offsets of matches, context, canonical and normalised forms, shapes, HMAC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHECKSUMMED_TYPES, ROLE_WORDS
from .checksums import checksum_class


def fold_accents(c: Column) -> Column:
    """Accented letters as ``_``: one code point for one, so that offsets hold and word borders are those of any engine."""
    return F.regexp_replace(c, "[À-ÖØ-öø-ÿĀ-ž]", "_")


MARK = "\uffff"  # a noncharacter that parts matches from the text between them; in texts it becomes another one
BLOCK = 64  # parts that are summed together


def parts(text: Column, pattern: str) -> Column:
    """Gap, match, gap, match, ..., gap: one pass of the pattern."""
    return F.split(F.regexp_replace(F.translate(text, MARK, "\ufffe"), f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK, -1)


def part_sums(parts: str) -> Column:
    """The lengths of each BLOCK of parts, summed."""
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda s, x: s + F.length(x)))


def starts(parts: str, sums: str, each) -> Column:
    """An array of ``each(start, match)`` over the matches of ``parts``. Sums of blocks, then one fold within each block,
    which carries the place along: near linear in the parts.

    Both arrays are columns made in earlier projections and used more than once here, so that the optimizer
    doesn't work them out again for each match."""
    ahead = F.transform(sums, lambda s, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda t, x: t + x))
    places = F.sequence(F.lit(0), F.lit(BLOCK // 2 - 1))
    none = F.slice(F.array(each(F.lit(0), F.lit(""))), 1, 0)

    def block(base, b):
        pairs = F.floor(F.least(F.lit(BLOCK), F.size(parts) - b * BLOCK) / 2).cast("int")

        def step(a, j):
            at = b * BLOCK + 2 * j
            start, match = a["at"] + F.length(F.get(F.col(parts), at)), F.get(F.col(parts), at + 1)
            return F.struct((start + F.length(match)).alias("at"), F.array_append(a["out"], each(start, match)).alias("out"))

        return F.aggregate(F.slice(places, F.lit(1), pairs), F.struct(base.alias("at"), none.alias("out")), step, lambda a: a["out"])

    return F.flatten(F.transform(ahead, block))


def finditer(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, start, end, match) of the non-overlapping, never empty matches, 0-based and half-open. The text itself isn't carried through the explode."""
    rows = docs.select("doc_id", parts(F.col(text), pattern).alias("parts"))
    rows = rows.select("doc_id", "parts", part_sums("parts").alias("sums"))
    rows = rows.select("doc_id", F.explode(starts("parts", "sums", lambda start, match: F.struct(start.alias("start"), match.alias("match")))).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.match")).alias("end"), F.col("x.match").alias("match"))


def with_context(spans: DataFrame, docs: DataFrame, width: int = 48) -> DataFrame:
    """Adds the lower-cased window of ``width`` characters to both sides. Spans meet their documents by id."""
    left = F.greatest(F.col("start") - width, F.lit(0))
    cut = F.lower(F.substring("text", left + 1, F.col("end") + width - left))
    return spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("context", cut).drop("text")


def tokens(docs: DataFrame, pattern: str = r"\S+") -> DataFrame:
    """(doc_id, k, start, end) of tokens."""
    rows = docs.select("doc_id", parts(F.col("text"), pattern).alias("parts"))
    rows = rows.select("doc_id", "parts", part_sums("parts").alias("sums"))
    rows = rows.select("doc_id", F.posexplode(starts("parts", "sums", lambda start, match: F.struct(start.alias("start"), (start + F.length(match)).alias("end")))).alias("k", "x"))
    return rows.select("doc_id", "k", "x.start", "x.end")


def canonicalise(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"\s+", " ")


def content_hash(c: Column) -> Column:
    return F.sha2(canonicalise(c), 256)


def normalise_value(text: Column, kind: Column) -> Column:
    """The key under which two surface forms are one entity."""
    folded = F.regexp_replace(F.lower(text), r"[\s\-_./()]", "")
    words = F.array_sort(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 1) & ~t.isin(*ROLE_WORDS)))
    person = F.when(F.size(words) > 0, F.array_join(words, "|")).otherwise(folded)
    return F.when(kind.isin(*CHECKSUMMED_TYPES), F.concat(folded, F.lit("|"), checksum_class(text, kind))).when(kind == "PERSON", person).otherwise(folded)


def shape_signature(c: Column) -> Column:
    """Classes of characters (U, l, d, or the character itself), runs collapsed."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Ll}", "\x01"), r"\p{Lu}", "\x02"), r"\p{Nd}", "\x03")
    return F.translate(F.regexp_replace(marked, r"(?s)(.)\1+", "$1"), "\x01\x02\x03", "lUd")


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return F.when(both > 0, both / (F.greatest(e1, e2) - F.least(s1, s2)).cast("double")).otherwise(F.lit(0.0))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex HMAC of a string column; keys of at most 64 bytes."""
    if len(secret) > 64:
        raise ValueError("keys have at most 64 bytes")
    key = secret.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def key_fingerprint(secret: bytes) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(b"certveil-key-fingerprint"), F.lit(secret)), 256), 1, 16)


def shape_statistics(c: Column) -> list[Column]:
    """log1p(n)/10, tokens/n, digits/n, upper-case/n, line feeds/n, 1: the last six features of a text."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)) / n
    return [(F.log1p(F.length(c)) / 10).alias("f_length"), count(r"\S+").alias("f_tokens"), count("[0-9]").alias("f_digits"), count("[A-Z]").alias("f_upper"), count("\n").alias("f_lines"), F.lit(1.0).alias("f_one")]
