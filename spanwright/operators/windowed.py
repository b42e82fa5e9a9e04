"""Long texts detected in overlapping windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.sequences import windows
from spanwright.functions.spans import surface, trim_span

C = F.col


def detect_windowed(texts: DataFrame, id_col: str, text_col: str, detect: Callable[[Column], Column], size: int, overlap: int, at: Column | None = None) -> DataFrame:
    """id, start, end, label, surface: what `detect` (a column function from text to array of struct(start, end, label)) finds in each window,
    moved to the text's offsets, trimmed, each (start, end, label) once. A span that a window's edge cuts is found in part there and whole where
    another window has it, both of which stay; empty texts have none.

    at: the windows as an array of struct(start, end), instead of those of `size` characters. Windows become rows, so that a long text is the work of
    many; only spans are shuffled, by id.
    """
    rows = texts.select(C(id_col), C(text_col).alias("__text"), F.explode(windows(F.length(text_col), size, overlap) if at is None else at).alias("__w"))
    piece = rows.withColumn("__piece", F.substring("__text", C("__w.start") + 1, C("__w.end") - C("__w.start"))).select(id_col, "__w", "__piece")
    hits = piece.select(id_col, "__w", "__piece", F.explode(detect(C("__piece"))).alias("s"))
    hits = hits.withColumn("t", trim_span(C("__piece"), C("s.start"), C("s.end"))).where("t is not null")
    base = C("__w.start")
    moved = hits.select(id_col, (base + C("t.start")).cast("int").alias("start"), (base + C("t.end")).cast("int").alias("end"), C("s.label").alias("label"), surface(C("__piece"), C("t")).alias("surface"))
    return moved.dropDuplicates([id_col, "start", "end", "label"])
