"""Luhn, ISO 7064 and social security checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _luhn_sum(d: Column, doubled: int) -> Column:
    """Sum of the digits from the right, every second one doubled, the last if ``doubled`` is 0."""

    def one(x, i):
        v = F.ascii(x) - 48
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(i % 2 == doubled, twice).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(d), ""), one), F.lit(0), lambda a, x: a + x)


def luhn_check_digit(payload: Column) -> Column:
    d = digits_of(payload)
    return F.when(F.length(d) > 0, (10 - _luhn_sum(d, 0) % 10) % 10)


def luhn_valid(text: Column) -> Column:
    """12 to 19 digits, whatever stands between, whose last is the check digit of the others."""
    d = digits_of(text)
    return F.coalesce(F.when(F.length(d).between(12, 19), _luhn_sum(d, 1) % 10 == 0), F.lit(False))


def _mod97(c: Column) -> Column:
    """Remainder of a string of digits and capital letters (A: 10 to Z: 35)."""

    def step(a, x):
        v = F.ascii(x)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.split(c, ""), F.lit(0), step)


def _compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def iban_checksum(country: Column, bban: Column) -> Column:
    return F.lpad((98 - _mod97(F.concat(_compact(bban), _compact(country), F.lit("00")))).cast("string"), 2, "0")


def make_iban(country: Column, bban: Column) -> Column:
    return F.concat(_compact(country), iban_checksum(country, bban), _compact(bban))


def iban_valid(text: Column) -> Column:
    s = _compact(text)
    shape = s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$")
    return F.coalesce(F.when(shape, _mod97(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))) == 1), F.lit(False))


def ssn_plausible(text: Column) -> Column:
    d = digits_of(text)
    area = F.substring(d, 1, 3)
    ok = ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    return F.coalesce((F.length(d) == 9) & ok, F.lit(False))


def checksum_class(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "CREDIT_CARD", F.when(luhn_valid(text), "luhn-ok").otherwise("luhn-bad"))
        .when(kind == "IBAN", F.when(iban_valid(text), "iso7064-ok").otherwise("iso7064-bad"))
        .otherwise("n/a")
    )
