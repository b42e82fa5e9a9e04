"""Scalar functions on surfaces, placeholders and keys; all are column expressions unless they say otherwise.

Character classes are written out, so that they mean the same as Unicode-aware ones elsewhere: Java's plain
\\w, \\d and \\b are ASCII, and its (?U) counts combining marks as word characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.schema import TAGS

WORD = r"\p{L}\p{N}_"
BLANK = r" \t\n\x0B\f\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
START = rf"(?<![{WORD}])"
END = rf"(?![{WORD}])"
PLACEHOLDER = r"<[A-Z][0-9A-Z_]*_\p{Nd}+>"


def lit_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


# -- keys

#: Anything besides ASCII and the Latin-1 letters may change under NFKC.
_BEYOND_LATIN = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"


@F.pandas_udf(T.StringType())
def exact_fold(values: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed; for what expressions can't fold."""
    return values.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", str(s)).casefold().split()))


def collapse(value: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, rf"[{BLANK}]+", " "))


def fold_latin(value: Column) -> Column:
    """Case folding with white space collapsed; exact for ASCII and Latin-1 letters."""
    return collapse(F.lower(F.replace(value, F.lit("ß"), F.lit("ss"))))


def fold(value: Column) -> Column:
    """The key under which surfaces share a placeholder; only rows beyond Latin letters reach Python."""
    odd = F.when(value.rlike(_BEYOND_LATIN), value)
    return F.when(value.rlike(_BEYOND_LATIN), exact_fold(odd)).otherwise(fold_latin(value))


def value_key(value: Column) -> Column:
    """Stripped and folded, inner white space kept: the key of caps, merges and audits."""
    stripped = F.regexp_replace(value, rf"^[{BLANK}]+|[{BLANK}]+$", "")
    return F.lower(F.replace(stripped, F.lit("ß"), F.lit("ss")))


def german(value: Column) -> Column:
    """Umlauts as two letters on top of fold_latin."""
    out = value
    for umlaut, letters in (("ä", "ae"), ("Ä", "ae"), ("ö", "oe"), ("Ö", "oe"), ("ü", "ue"), ("Ü", "ue")):
        out = F.replace(out, F.lit(umlaut), F.lit(letters))
    return fold_latin(out)


def e164_ch(value: Column) -> Column:
    """Swiss numbers as +41 and nine digits; null for anything else."""
    bare = F.regexp_replace(value, r"\(0\)|[\s\-/.()]", "")
    national = F.regexp_extract(bare, r"^(?:\+41|0041|0)([1-9][0-9]{8})$", 1)
    return F.when(national != "", F.concat(F.lit("+41"), national))


_MONTHS = {
    "januar": 1, "janvier": 1, "gennaio": 1, "january": 1, "februar": 2, "février": 2, "febbraio": 2, "february": 2, "märz": 3, "mars": 3, "marzo": 3, "march": 3,
    "april": 4, "avril": 4, "aprile": 4, "mai": 5, "maggio": 5, "may": 5, "juni": 6, "juin": 6, "giugno": 6, "june": 6, "juli": 7, "juillet": 7, "luglio": 7, "july": 7,
    "august": 8, "août": 8, "agosto": 8, "september": 9, "septembre": 9, "settembre": 9, "oktober": 10, "octobre": 10, "ottobre": 10, "october": 10,
    "november": 11, "novembre": 11, "dezember": 12, "décembre": 12, "dicembre": 12, "december": 12,
}


def iso_date(value: Column) -> Column:
    """Day-month-year and year-month-day spellings as YYYY-MM-DD; null for anything else or no such day."""
    text = F.lower(collapse(value))
    dmy = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    ymd = r"^(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})$"
    named = r"^(\d{1,2})(?:\.|er|°)? (\p{L}+) (\d{4})$"
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    joined = (
        F.when(text.rlike(dmy), F.concat_ws("-", part(dmy, 3), F.lpad(part(dmy, 2), 2, "0"), F.lpad(part(dmy, 1), 2, "0")))
        .when(text.rlike(ymd), F.concat_ws("-", part(ymd, 1), F.lpad(part(ymd, 2), 2, "0"), F.lpad(part(ymd, 3), 2, "0")))
        .when(text.rlike(named), F.concat_ws("-", part(named, 3), F.lpad(lit_map(_MONTHS)[part(named, 2)].cast("string"), 2, "0"), F.lpad(part(named, 1), 2, "0")))
    )
    return F.date_format(F.try_to_date(F.when(F.length(joined) == 10, joined), "yyyy-MM-dd"), "yyyy-MM-dd")


NORMALIZERS: dict[str, Callable[[Column], Column]] = {"e164": e164_ch, "iso_date": iso_date, "german": german}


def resolve_normalizer(spec: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A named normaliser, or the function given; anything else is a ValueError."""
    if callable(spec):
        return spec
    if spec not in NORMALIZERS:
        raise ValueError(f"no normaliser {spec!r}; there are {sorted(NORMALIZERS)}, or give a function from column to column")
    return NORMALIZERS[spec]


# -- placeholders


def label_tag(label: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(TAGS), label), F.upper(label))


def placeholder(label: Column, index: Column) -> Column:
    return F.concat(F.lit("<"), label_tag(label), F.lit("_"), index.cast("string"), F.lit(">"))


def parse_placeholder(text: Column) -> Column:
    """struct(tag, index) of a whole placeholder; null for anything else."""
    pattern = r"^<([A-Z][0-9A-Z_]*)_(\d+)>$"
    whole = text.rlike(pattern) & ~text.endswith("\n")
    return F.when(whole, F.struct(F.regexp_extract(text, pattern, 1).alias("tag"), F.regexp_extract(text, pattern, 2).cast("int").alias("index")))


def is_placeholder_prefix(buffer: Column) -> Column:
    """Whether more characters may complete a placeholder: the tag may be absent, and at most one digit can be seen."""
    return F.coalesce(buffer.rlike(r"\A<(?:[A-Z][0-9A-Z_]*)?(?:_(?:\d)?)?\z"), F.lit(False))


# -- labels and scores


def category_of(label: Column) -> Column:
    return F.when(label.contains("-"), F.substring_index(label, "-", -1)).otherwise(label)


def prefix_of(label: Column) -> Column:
    return F.when(label.contains("-"), F.substring_index(label, "-", 1)).otherwise(F.lit(""))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Columns precision, recall, f1; an empty denominator gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "mid").otherwise("single")


def prompt_language(language: Column) -> Column:
    """The language whose prompt a text gets: Swiss German reads German, unknown ones English."""
    return F.when(language == "gsw", "de_ch").when(language.isin("en", "rm", *(f"{c}_ch" for c in ("de", "fr", "it"))), language).otherwise("en")
