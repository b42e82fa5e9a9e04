"""Check digits and context rules of the pattern catalogue, as column expressions.

Digits are Unicode decimal digits where they are searched for, and ASCII ones where they are computed with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.spans import let
from spanwright.functions.text import END, START

#: Of the eight digits before the check digit.
VAT_WEIGHTS = [5, 4, 3, 2, 7, 6, 5, 4]


def _no() -> Column:
    return F.lit(False)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _digit_array(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def luhn(value: Column) -> Column:
    """Payment cards: 13 to 19 digits whose Luhn sum is a multiple of ten."""
    doubled = lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    right = lambda d: (F.size(d) >= 13) & (F.size(d) <= 19) & (_sum(F.transform(d, doubled)) % 10 == 0)
    return F.coalesce(let(_digit_array(F.reverse(digits(value))), right), _no())


def iban_ch(value: Column) -> Column:
    """CH, two check digits and 17 digits, which modulo 97 leave one."""
    bare = F.regexp_replace(value, "[ -]", "")
    number = F.concat(F.substring(bare, 5, 17), F.lit("1217"), F.substring(bare, 3, 2))
    return F.coalesce(bare.rlike("^CH[0-9]{19}$") & (number.try_cast("decimal(38,0)") % 97 == 1), _no())


def ahv(value: Column) -> Column:
    """Social insurance numbers: 13 digits from 756 on, the last an EAN-13 check digit."""
    d = _digit_array(digits(value))
    weighted = F.transform(F.slice(d, 1, 12), lambda x, i: F.when(i % 2 == 1, 3 * x).otherwise(x))
    right = F.pmod(10 - _sum(weighted) % 10, F.lit(10)) == F.element_at(d, 13)
    return F.coalesce(F.when(digits(value).rlike("^756[0-9]{10}$"), right), _no())


def vat_che(value: Column) -> Column:
    """Company numbers: the ninth digit checks the first eight modulo 11; ten is never valid, later digits don't count."""
    d = _digit_array(F.substring(digits(value), 1, 9))
    weights = F.array(*(F.lit(w) for w in VAT_WEIGHTS))
    check = F.pmod(11 - _sum(F.zip_with(F.slice(d, 1, 8), weights, lambda x, w: x * w)) % 11, F.lit(11))
    return F.coalesce(F.when(F.length(digits(value)) >= 9, check == F.element_at(d, 9)), _no())


# -- context


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before a 0-based offset, lower-cased."""
    lo = F.greatest(start - n, F.lit(0))
    return F.lower(F.substring(text, lo + 1, start - lo))


def after(text: Column, end: Column, n: int) -> Column:
    return F.lower(F.substring(text, end + 1, F.lit(n)))


CARD_WORDS = ["amex", "card", "credit ", "cvv", "karte", "kontonummer", "pan ", "visa"]
DEVICE_WORDS = ["seriennummer", "serial", "imei"]
REFERENCE_WORDS = ["patent", "isbn", "issn", "doi ", "doi:"]


def has_any(text: Column, words: list[str]) -> Column:
    out = _no()
    for w in words:
        out = out | text.contains(w)
    return out


def numeric_list(value: Column) -> Column:
    """Six or more groups of digits, at most one of them longer than three."""
    groups = F.regexp_extract_all(value, F.lit(r"(\p{Nd}+)"), 1)
    return (F.size(groups) >= 6) & (F.size(F.filter(groups, lambda g: F.length(g) > 3)) <= 1)


def in_numeric_table(text: Column, start: Column, end: Column) -> Column:
    """Whether a card-shaped match is noise. Words of payment before it keep it, whatever else; words of devices and
    references, a list of small numbers, or three other numbers around reject it."""
    window = before(text, start, 80)
    value = F.substring(text, start + 1, end - start)
    lo = F.greatest(start - 30, F.lit(0))
    around = F.concat(F.substring(text, lo + 1, start - lo), F.lit(" "), after(text, end, 30))
    numbers = F.size(F.regexp_extract_all(around, F.lit(rf"{START}(\p{{Nd}}+){END}"), 1))
    return F.when(has_any(window, CARD_WORDS), False).otherwise(has_any(window, DEVICE_WORDS + REFERENCE_WORDS) | numeric_list(value) | (numbers >= 3))


def implausible_phone(text: Column, start: Column, end: Column) -> Column:
    """Whether a phone-shaped match is part of another identifier."""
    window = before(text, start, 80)
    value = F.regexp_replace(F.substring(text, start + 1, end - start), r"[^\p{Nd}]", "")
    return value.startswith("0000") | has_any(window, REFERENCE_WORDS) | window.rlike(rf"{START}10\.\p{{Nd}}{{4,5}}/")
