"""Spans as arrays of structs: finding, ordering, resolving overlaps, masking, splicing. Offsets count code points, ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions import kernels
from spanwright.functions.text import BLANK

MATCH = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_all(text: Column, pattern: str) -> Column:
    """start, end, text of every match, left to right. The gaps between matches place them, so each is
    found where the pattern matched and not where its text occurs first."""
    none = F.array().cast(MATCH)

    def place(found: Column) -> Column:
        def lengths(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("t")))
            step = lambda acc, p: F.struct(
                (acc["at"] + p["g"] + p["h"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + p["h"]).alias("end"), p["t"].alias("text")))).alias("out"),
            )
            return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

        # split only where something was found
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lengths)).otherwise(none)

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), 0), place), none)


def surface(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without blanks, tabs and line feeds at the edges; null if nothing is left."""
    return _trim(text, start, end, r" \t\n")


def trim_span_unicode(text: Column, start: Column, end: Column) -> Column:
    """As trim_span, for all white space."""
    return _trim(text, start, end, BLANK)


def _trim(text: Column, start: Column, end: Column, blank: str) -> Column:
    value = F.substring(text, start + 1, end - start)
    left = F.length(F.regexp_extract(value, rf"\A[{blank}]*", 0))
    right = F.length(F.regexp_extract(value, rf"[{blank}]*\z", 0))
    return F.when(left < F.length(value), F.struct((start + left).alias("start"), (end - right).alias("end")))


def trim_url(start: Column, value: Column) -> Column:
    """The end of a URL without the punctuation that closes the sentence."""
    return start + F.length(F.rtrim(value, F.lit(".,;:!?\")>]")))


def by_start_longest(spans: Column) -> Column:
    """Ascending start, then descending length; otherwise as they were."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-(s["end"] - s["start"])).alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def by_start_end(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def drop_overlapping(spans: Column, kind: str) -> Column:
    """Of spans in order, from offset 0 on, each that starts at or after the end of the last kept one. kind: the struct's type."""
    begin = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    add = lambda acc, s: F.struct(s["end"].cast("int").alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))
    return F.aggregate(spans, begin, lambda acc, s: F.when(s["start"] >= acc["last"], add(acc, s)).otherwise(acc), lambda acc: acc["out"])


MERGED = "struct<start:int,end:int,label:string>"


def merge_adjacent(text: Column, spans: Column) -> Column:
    """Of spans in order: invalid ones and those that overlap an earlier one go; neighbours of one label with at most one
    white-space character between become one span."""
    bare = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label")))
    valid = F.filter(bare, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] < s["end"]))

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        gap = F.substring(text, last["end"] + 1, s["start"] - last["end"])
        joins = (s["label"] == last["label"]) & gap.rlike(rf"\A[{BLANK}]?\z")
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"), last["label"].alias("label"))))
        return F.when(F.size(out) == 0, F.array(s)).when(s["start"] < last["end"], out).when(joins, joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(valid, F.array().cast(f"array<{MERGED}>"), step)


def merge_adjacent_long(text: Column, spans: Column) -> Column:
    """merge_adjacent for texts with many spans, in Arrow; not for use inside of other functions' lambdas, into which Spark may pull it."""
    return kernels.merged(text, spans)


def mask(text: Column, spans: Column) -> Column:
    """The text with the spans' characters as blanks, its length unchanged."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each of the disjoint, ordered spans replaced."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), replacement(s)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.coalesce(done, text)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def not_overlapping(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlaps(s, o)))


def locate_value(text: Column, value: Column) -> Column:
    """struct(start, end, value) of a stripped value's first occurrence; null if empty or absent."""
    v = F.regexp_replace(value, rf"^[{BLANK}]+|[{BLANK}]+$", "")
    at = F.position(v, text)
    return F.when((v != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(v)).alias("end"), v.alias("value")))


def locate_values(text: Column, values: Column) -> Column:
    """locate_value of each value of an array, null where it is empty or absent; for many values of one text."""
    return kernels.located(text, values)


def locate_in_order(text: Column, values: Column) -> Column:
    """Spans of values, each searched from the end of the one before; null if one is absent. Empty values are skipped."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(acc: Column, v: Column) -> Column:
        at = F.position(v, text, acc["at"] + 1)
        found = F.struct(
            (at - 1 + F.length(v)).alias("at"),
            F.concat(acc["out"], F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length(v)).alias("end"), v.alias("value")))).alias("out"),
        )
        missed = F.struct(acc["at"].alias("at"), F.lit(None).cast(kind).alias("out"))
        return F.when(v == "", acc).when(at > 0, found).otherwise(missed)

    return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def invalid_reason(text: Column, spans: Column) -> Column:
    """Why an example's spans can't stand: bounds, overlap or a blank surface; null if they can."""
    ordered = by_start_end(spans)
    bounds = F.exists(ordered, lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length(text)))
    crossing = F.exists(F.sequence(F.lit(2), F.greatest(F.size(ordered), F.lit(2))), lambda i: F.coalesce(F.try_element_at(ordered, i)["start"] < F.try_element_at(ordered, i - 1)["end"], F.lit(False)))
    blank = F.exists(ordered, lambda s: surface(text, s).rlike(rf"\A[{BLANK}]*\z"))
    return F.when(bounds, "bounds").when(crossing, "overlap").when(blank, "blank")
