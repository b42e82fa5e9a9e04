"""Span scores: exact, by character and softly overlapping; verdicts, consensus, reports.

Rows are (row_id, language, gold, pred) with arrays of struct(start, end, label); spans are sets, so repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.spans import let, overlaps
from spanwright.functions.text import precision_recall_f1
from spanwright.operators.together import span_counts

C = F.col
COUNTS = ["tp", "fp", "fn"]
SPANS = "array<struct<start:int,end:int,label:string>>"


def row_counts(rows: DataFrame) -> DataFrame:
    """row_id, language, label, tp, fp, fn, char_tp, char_fp, char_fn, n_gold per row and label.

    Counted where the row lies, over distinct spans, and characters by a sweep over the spans' ends, never one by one; no span is shuffled.
    """
    kinds = dict(rows.dtypes)  # a walk over spans that are as they should be costs more than their counts
    spans = lambda name: C(name) if kinds[name] == SPANS else F.transform(name, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label")))
    counted = rows.select("row_id", "language", F.explode(span_counts(spans("gold"), spans("pred"))).alias("x"))
    return counted.select("row_id", "language", "x.*")


def totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Summed counts and both kinds of precision, recall and F1 per group."""
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "char_tp", "char_fp", "char_fn", "n_gold")]
    out = (counts.groupBy(*keys) if keys else counts.groupBy()).agg(*sums)
    for prefix in ("", "char_"):
        names = [F.col(f"{prefix}{c}") for c in COUNTS]
        for column, name in zip(precision_recall_f1(*names), ("precision", "recall", "f1")):
            out = out.withColumn(f"{prefix}{name}", F.round(column, 6))
    return out


def report(rows: DataFrame) -> DataFrame:
    """level (overall, category, language), name, and the totals: one pass over the counts by grouping sets."""
    counts = row_counts(rows)
    sums = ", ".join(f"sum({c}) AS {c}" for c in (*COUNTS, "char_tp", "char_fp", "char_fn", "n_gold"))
    view = counts.select("language", "label", *COUNTS, "char_tp", "char_fp", "char_fn", "n_gold")
    grouped = view.groupingSets([[], [C("label")], [C("language")]], C("label"), C("language")).agg(F.grouping_id().alias("g"), *(F.expr(s) for s in sums.split(", ")))
    level = F.when(C("g") == 3, "overall").when(C("g") == 1, "category").otherwise("language")
    out = grouped.select(level.alias("level"), F.coalesce("label", "language", F.lit("")).alias("name"), *COUNTS, "char_tp", "char_fp", "char_fn", "n_gold")
    for prefix in ("", "char_"):
        for column, name in zip(precision_recall_f1(*(F.col(f"{prefix}{c}") for c in COUNTS)), ("precision", "recall", "f1")):
            out = out.withColumn(f"{prefix}{name}", F.round(column, 6))
    return out


def matrix(rows: DataFrame) -> DataFrame:
    """language, label, char_f1 and n_gold; null where there is neither gold nor prediction."""
    cells = totals(row_counts(rows), ["language", "label"])
    empty = C("char_tp") + C("char_fp") + C("char_fn") == 0
    return cells.select("language", "label", F.when(~empty, C("char_f1")).alias("char_f1"), "n_gold")


def weighted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Averages of F1 by gold support; null cells don't count."""
    known = cells.where("char_f1 is not null")
    return (known.groupBy(*keys) if keys else known.groupBy()).agg(F.round(F.try_divide(F.sum(C("char_f1") * C("n_gold")), F.sum("n_gold")), 6).alias("char_f1"), F.sum("n_gold").alias("n_gold"))


def margins(cells: DataFrame) -> DataFrame:
    """language, label, char_f1, n_gold: the cells' averages per language (label null), per label (language null) and over all (both null); one pass by grouping sets."""
    known = cells.where("char_f1 is not null")
    f1 = F.round(F.try_divide(F.sum(C("char_f1") * C("n_gold")), F.sum("n_gold")), 6)
    return known.groupingSets([[C("language")], [C("label")], []], C("language"), C("label")).agg(f1.alias("char_f1"), F.sum("n_gold").alias("n_gold"))


def soft_counts(gold: Column, pred: Column) -> Column:
    """struct(tp, fp, fn) by overlap with a span of the same label."""
    same = lambda a, b: (a["label"] == b["label"]) & overlaps(a, b)
    tp = F.size(F.filter(gold, lambda g: F.exists(pred, lambda p: same(g, p))))
    fp = F.size(F.filter(pred, lambda p: ~F.exists(gold, lambda g: same(g, p))))
    return let(tp, lambda n: F.struct(n.alias("tp"), fp.alias("fp"), (F.size(gold) - n).alias("fn")))


def verdict(gold: Column, counts: Column) -> Column:
    """Of a probe: nothing expected and nothing found, or something; all found and nothing else; nothing found; or a part."""
    return (
        F.when(F.size(gold) == 0, F.when(counts["fp"] == 0, "PASS_NEG").otherwise("FAIL_NEG"))
        .when((counts["fn"] == 0) & (counts["fp"] == 0), "PASS")
        .when(counts["tp"] == 0, "FAIL")
        .otherwise("PARTIAL")
    )


def consensus(votes: DataFrame, least: int = 2, count_mode: str = "model") -> DataFrame:
    """id, key, label that at least `least` models name; count_mode 'span' counts their spans instead."""
    n = F.count_distinct("model") if count_mode == "model" else F.count(F.lit(1))
    return votes.groupBy("id", "key", "label").agg(n.alias("votes")).where(C("votes") >= least)


def key_counts(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn of two sets of keys, per group; one full join."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = pred.select(*keys).distinct().withColumn("p", F.lit(1))
    joined = g.join(p, keys, "full")
    hit = lambda a, b: F.count_if(a & b)
    has_g, has_p = C("g").isNotNull(), C("p").isNotNull()
    return joined.groupBy(*by).agg(hit(has_g, has_p).alias("tp"), hit(~has_g, has_p).alias("fp"), hit(has_g, ~has_p).alias("fn"))


def fuzzy_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn of (id, label, key) where one value may be part of the other; joined by id and label, compared within."""
    g = gold.groupBy("id", "label").agg(F.collect_set("key").alias("gs"))
    p = pred.groupBy("id", "label").agg(F.collect_set("key").alias("ps"))
    j = g.join(p, ["id", "label"], "full").withColumns({"gs": F.coalesce("gs", F.array().cast("array<string>")), "ps": F.coalesce("ps", F.array().cast("array<string>"))})
    alike = lambda a, b: a.contains(b) | b.contains(a)
    tp = F.size(F.filter("gs", lambda a: F.exists("ps", lambda b: alike(a, b))))
    fp = F.size(F.filter("ps", lambda a: ~F.exists("gs", lambda b: alike(a, b))))
    return j.groupBy().agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(F.size("gs") - tp).alias("fn"))


def failing_examples(cases: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Counts of verdicts per group, and the first n case ids that didn't pass; ids ranked in a window, no list of all."""
    bad = ~C("verdict").isin("PASS", "PASS_NEG")
    ranked = cases.withColumn("nth", F.when(bad, F.row_number().over(Window.partitionBy(*keys, bad).orderBy("case_id"))))
    counts = [F.count_if(C("verdict") == v).alias(v.lower()) for v in "FAIL FAIL_NEG PARTIAL PASS PASS_NEG".split()]
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts, F.array_sort(F.collect_list(F.when(C("nth") <= n, C("case_id")))).alias("failing"))


def ranking(results: DataFrame, headline: str) -> DataFrame:
    """Systems, the headline first, the others by strict F1 (a fallback where it is null) downwards; whether each is its language's best."""
    score = F.coalesce("strict_f1", "per_f1")
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.when(C("system") == headline, 0).otherwise(1), F.desc(score), "system"))
    return results.withColumn("place", place).withColumn("best", score == F.max(score).over(Window.partitionBy("language")))


def rivals(results: DataFrame, headline: str, n: int = 2) -> DataFrame:
    """language, system, place of the n best systems besides the headline in each language."""
    score = F.coalesce("strict_f1", "per_f1")
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc_nulls_last(score), "system"))
    return results.where(C("system") != headline).withColumn("place", place).where(C("place") <= n).select("language", "system", "place")


def entity_rows(labels: Column) -> Column:
    """Entities of a label sequence as struct(start, end, label), token numbers; a change of category or a B or S starts one."""
    from spanwright.functions.sequences import spans_of_sequence

    return spans_of_sequence(labels, F.transform(labels, lambda _, i: F.struct(i.alias("a"), (i + 1).alias("b"))))


def first_subword(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each word's first token, for scores by word. tokens: keys, word, token, …"""
    return tokens.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "word").orderBy("token"))).where("__n = 1").drop("__n")
