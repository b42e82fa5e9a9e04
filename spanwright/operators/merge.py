"""Labellers' claims merged to spans with their signals; place names and label conflicts put right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.spans import locate_value
from spanwright.functions.text import value_key

C = F.col
#: Order in which sources speak; the first claim of a key places its span unless a longer one follows.
SOURCES = ["gemma", "qwen", "nemotron", "regex", "audit"]


def last_by_id(claims: DataFrame, id_col: str, spans_col: str, order_col: str) -> DataFrame:
    """One row per non-null id, the last by order; null spans as none. For an index of a labeller's file."""
    from pyspark.sql.functions import coalesce

    last = claims.where(C(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(spans_col, order_col).alias(spans_col))
    return last.withColumn(spans_col, coalesce(C(spans_col), F.array().cast(dict(claims.dtypes)[spans_col])))


def raw_spans(claims: DataFrame) -> DataFrame:
    """Claims (…, text, value, label) with start and end where the stripped value first occurs; claims without value, label or place go."""
    placed = claims.where("value is not null and label is not null").withColumn("p", locate_value(C("text"), C("value"))).where("p is not null")
    return placed.withColumns({"start": C("p.start"), "end": C("p.end"), "value": C("p.value")}).drop("p")


def merge_signals(claims: DataFrame) -> DataFrame:
    """id, start, end, label, value, signals, n_signals, subtype from claims (id, source, pos, start, end, label, value, subtype).

    Claims of one chunk with the same folded value and label are one span. Audits are signals but don't count; spans that
    only they claim go.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in SOURCES)), C("source"))
    keyed = claims.withColumn("key", value_key(C("value"))).withColumn("turn", F.struct(rank.alias("r"), C("pos").alias("p")))
    size = C("end") - C("start")
    # the longest claim; of those as long the first
    best = F.min_by(F.struct("start", "end", "value"), F.struct((-size).alias("n"), C("turn")))
    grouped = keyed.groupBy("id", "key", "label").agg(
        best.alias("best"),
        F.array_sort(F.collect_set("source")).alias("signals"),
        F.min_by("subtype", F.when(C("subtype").isNotNull(), C("turn"))).alias("subtype"),
        F.min("turn").alias("turn"),
    )
    counted = grouped.withColumn("n_signals", F.size(F.array_remove("signals", "audit")))
    return counted.where("n_signals > 0").select("id", C("best.start").alias("start"), C("best.end").alias("end"), "label", C("best.value").alias("value"), "signals", "n_signals", "subtype", "turn")


def demote_places(spans: DataFrame, places: DataFrame) -> DataFrame:
    """Persons whose value is a place's name become addresses. places: name; a dimension, joined by folded name."""
    known = places.select(value_key(C("name")).alias("place")).distinct()
    joined = spans.withColumn("folded", value_key(C("value"))).join(known, C("folded") == C("place"), "left")
    moved = (C("label") == "private_person") & C("place").isNotNull()
    return joined.withColumn("label", F.when(moved, "private_address").otherwise(C("label"))).drop("folded", "place")


def resolve_conflicts(spans: DataFrame) -> DataFrame:
    """One span per (id, start, end). Of one label: all signals together. Of several: the span with most signals, ties to the first label; its signals alone."""
    at = spans.groupBy("id", "start", "end").agg(
        F.count_distinct("label").alias("labels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("all_signals"),
        F.min_by("value", "turn").alias("first_value"),
        F.min_by("subtype", F.when(C("subtype").isNotNull(), C("turn"))).alias("any_subtype"),
        F.min_by(F.struct("label", "value", "signals", "subtype"), F.struct((-C("n_signals")).alias("n"), "label", "turn")).alias("win"),
    )
    one = C("labels") == 1
    signals = F.when(one, C("all_signals")).otherwise(C("win.signals"))
    return at.select(
        "id", "start", "end", C("win.label").alias("label"),
        F.when(one, C("first_value")).otherwise(C("win.value")).alias("value"),
        signals.alias("signals"), F.size(F.array_remove(signals, "audit")).alias("n_signals"),
        F.when(one, C("any_subtype")).otherwise(C("win.subtype")).alias("subtype"),
    )


def with_confidence(spans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confidence: the share of the labellers that ran on the chunk. candidates: id, n_candidates."""
    return spans.join(candidates, "id").withColumn("confidence", C("n_signals") / C("n_candidates"))


def candidates(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """id, n_candidates: the first labeller and the rules always, the others where they have a record, with spans or without."""
    mark = lambda df, name: df.select("id", F.lit(1).alias(name)).distinct()
    both = first.select("id").join(mark(second, "b"), "id", "left").join(mark(third, "c"), "id", "left")
    return both.select("id", (2 + F.coalesce("b", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("n_candidates"))


def assemble(claims: DataFrame, candidate_counts: DataFrame, places: DataFrame) -> DataFrame:
    """The whole merge: signals, place names, conflicts, confidence."""
    return with_confidence(resolve_conflicts(demote_places(merge_signals(claims), places)), candidate_counts)
