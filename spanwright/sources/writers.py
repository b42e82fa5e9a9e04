"""Sinks: JSON lines, published splits, results, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.spans import by_start_end, invalid_reason
from spanwright.functions.text import lit_map

C = F.col


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Chunks with their spans in the order (start, end)."""
    chunks.withColumn("spans", by_start_end(C("spans"))).write.mode(mode).format(fmt).save(path)


def validated(chunks: DataFrame) -> DataFrame:
    """The chunks; reading one whose spans can't stand raises an error that says why."""
    reason = invalid_reason(C("text"), C("spans"))
    return chunks.withColumn("text", F.when(reason.isNull(), C("text")).otherwise(F.raise_error(F.concat(F.lit("invalid spans: "), reason)).cast("string")))


def published(chunks: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Chunks (…, subset, template_id?, split?) as published: the source's public name, no nulls in text fields, `validation` for `val`."""
    source = F.coalesce(F.try_element_at(lit_map(aliases), C("subset")), C("subset")) if aliases else C("subset")
    out = chunks.withColumn("source", source)
    if "split" in out.columns:
        out = out.withColumn("split", F.when(C("split") == "val", "validation").otherwise(C("split")))
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c, kind in out.dtypes if kind == "string"})


def write_splits(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split, so that reading one split reads no other."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def append_new(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append the rows whose key the log at `path` hasn't, each key once (of several rows the least as JSON); returns the log. A run that broke off goes on where it was.

    One writer at a time: two that run at once may both append a key. For a stream use it as foreachBatch: a batch that runs again finds its keys there.
    """
    from spanwright.operators.balance import not_done
    from spanwright.sources.readers import exists

    spark = rows.sparkSession
    named = rows.where(C(key).isNotNull())
    least = named.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns))).alias("__r")).select("__r.*")
    new = not_done(least, spark.read.parquet(path), key) if exists(spark, path) else least
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_layers(layers: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Layers of one corpus in their order, a folder each, so that reading one reads no other; `layer` numbers them."""
    out = None
    for i, rows in enumerate(layers.values()):
        part = rows.withColumn("layer", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out.write.mode(mode).partitionBy("layer").parquet(path)


def summary_json(parts: dict[str, DataFrame]) -> DataFrame:
    """One row `json`: each part's rows as a list under its name, ordered; for reports, whose parts are aggregates."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # a row each
    return out.select(F.to_json(F.struct(*parts)).alias("json"))


def matrix_rows(cells: DataFrame, row: str, column: str, value: str, columns: list[str], digits: int = 3) -> DataFrame:
    """`line`, `place`: a Markdown table with a row per `row` and the given columns; empty cells as a dash, numbers with `digits` digits; head and rule first."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    text = [F.coalesce(F.format_number(c, digits), F.lit("—")) for c in columns]
    body = wide.select(F.concat(F.lit("| "), F.concat_ws(" | ", C(row), *text), F.lit(" |")).alias("line"), (F.row_number().over(Window.orderBy(row)) + 1).alias("place"))
    head = ["| " + " | ".join([row, *columns]) + " |", "|" + "-|" * (len(columns) + 1)]
    return cells.sparkSession.createDataFrame([(h, i) for i, h in enumerate(head)], "line string, place int").unionByName(body)


def result_json(metrics: DataFrame, **facts: str) -> DataFrame:
    """One JSON string per row of metrics, with the given facts as first fields."""
    return metrics.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in facts.items()), F.struct(*metrics.columns).alias("metrics"))).alias("json"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A line of a Markdown table per row; null cells as a dash."""
    cells = [F.coalesce(C(c).cast("string"), F.lit("—")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
