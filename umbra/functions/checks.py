"""Check digits as expressions on a matched value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the two check digits of a national id.
FIRST_WEIGHTS = (3, 7, 6, 1, 8, 9, 4, 5, 2)
SECOND_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
#: Weights of the check digit of an organisation number.
ORG_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "(?U)[^\\d]", "")


def _with_number(value: Column, length: int, right: Callable[[Callable[[int], Column]], Column]) -> Column:
    """Whether value has so many ASCII digits and right(i -> digit i) holds. The number is bound once, as it is referred to often."""
    d = digits(value)
    number = F.when(F.length(d) == length, d.try_cast("long"))

    def holds(n: Column) -> Column:
        return F.coalesce(right(lambda i: F.call_function("div", n, F.lit(10 ** (length - 1 - i))) % 10), F.lit(False))

    return F.get(F.transform(F.array(number), holds), F.lit(0))


def _ends_right(digit: Callable[[int], Column], weights: tuple[int, ...]) -> Column:
    """Whether the digit after the weighted ones is 11 less the weighted sum's remainder, 0 for 0; a remainder of 1 is never right,
    as 10 is no digit. So the sum with that digit is a multiple of 11."""
    total = digit(len(weights))
    for i, w in enumerate(weights):
        total = total + digit(i) * w
    return total % 11 == 0


def national_id(value: Column) -> Column:
    """Whether both check digits are right."""
    return _with_number(value, 11, lambda digit: _ends_right(digit, FIRST_WEIGHTS) & _ends_right(digit, SECOND_WEIGHTS))


def org_number(value: Column) -> Column:
    """Whether the last of nine digits is right."""
    return _with_number(value, 9, lambda digit: _ends_right(digit, ORG_WEIGHTS))


def luhn(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def iban(value: Column) -> Column:
    """Whether the digits, with letters from 10 and the first four last, leave 1 modulo 97."""
    v = F.upper(F.regexp_replace(value, "\\s", ""))
    turned = F.split(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4)), "")

    def add(acc: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(n < 10, (acc * 10 + n) % 97).otherwise((acc * 100 + n) % 97)

    return F.length(v).between(15, 34) & (F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), add) == 1)


CHECKS = {"national_id": national_id, "org_number": org_number, "luhn": luhn, "iban": iban}
