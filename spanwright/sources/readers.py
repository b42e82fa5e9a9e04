"""Sources: JSON lines, place names, splits, inputs to label, a client for remote detectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.text import lit_map
from spanwright.schema import CHUNK, EXAMPLE, SIGNALS, TAGS

C = F.col
#: Cantons by the language that most of their places speak.
CANTONS = {
    **dict.fromkeys(["AG", "AI", "AR", "BE", "BL", "BS", "GL", "LU", "NW", "OW", "SG", "SH", "SO", "SZ", "TG", "UR", "ZG", "ZH"], "de_ch"),
    **dict.fromkeys(["FR", "GE", "JU", "NE", "VD", "VS"], "fr_ch"),
    "TI": "it_ch",
    "GR": "rm",
}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Training examples from JSON lines; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)


def valid_span(span) -> F.Column:
    """The rules of a labelled span: known label, bounds, signals known, sorted and not empty, confidence in (0, 1]."""
    s = span["signals"]
    return (
        span["label"].isin(*TAGS) & (span["start"] >= 0) & (span["start"] < span["end"]) & (F.size(s) > 0) & (F.array_sort(s) == s)
        & F.forall(s, lambda x: x.isin(*SIGNALS)) & (span["confidence"] > 0) & (span["confidence"] <= 1)
    )


def read_chunks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Labelled chunks from JSON lines. strict: a chunk with a span against the rules is an error; else it is dropped."""
    rows = spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)
    good = F.forall(F.coalesce("spans", F.array().cast(CHUNK["spans"].dataType)), valid_span)
    if strict:
        return rows.withColumn("id", F.when(F.coalesce(good, F.lit(False)), C("id")).otherwise(F.raise_error(F.concat(F.lit("invalid span in "), "id")).cast("string")))
    return rows.where(F.coalesce(good, F.lit(False)))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """plz, city, canton, canton_full, district, language of a tab-separated gazetteer; other countries and cantons are dropped, none left is an error."""
    fields = ["country", "plz", "city", "canton_full", "canton", "district", "district_code"]
    rows = spark.read.option("sep", "\t").option("quote", "").schema(", ".join(f"{f} string" for f in fields)).csv(path)
    places = rows.where((C("country") == "CH") & C("district_code").isNotNull()).withColumn("language", F.try_element_at(lit_map(CANTONS), C("canton"))).where("language is not null")
    # one row per place is small; the check and the result share one reading
    kept = places.persist()
    if kept.isEmpty():
        kept.unpersist()
        raise ValueError(f"no places in {path}")
    return kept.select("plz", "city", "canton", "canton_full", "district", "language")


TEMPLATES = "template_id string, language string, layer string, part string, text string, values array<struct<value:string,label:string>>"


def read_templates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Templates of the synthetic layers from JSON lines: template_id, language, layer, part (of e-mails), text with markers, values (literal spans).

    Without a path those that come with the library, a small set. An unknown layer, a repeated id or a text without id is an error when rows are read.
    """
    from spanwright.operators.synth import VOLUMES

    if path is None:
        lines = (Path(__file__).resolve().parent.parent / "data" / "templates.jsonl").read_text("utf-8").splitlines()
        rows = spark.createDataFrame([(line,) for line in lines], "value string").select(F.from_json("value", TEMPLATES).alias("t")).select("t.*")
    else:
        rows = spark.read.schema(TEMPLATES).option("mode", "FAILFAST").json(path)
    n = F.count(F.lit(1)).over(Window.partitionBy("template_id"))
    wrong = ~F.coalesce(C("layer").isin("emails", *VOLUMES), F.lit(False)) | (F.coalesce("template_id", F.lit("")) == "") | (n > 1)
    checked = rows.withColumn("wrong", wrong)
    said = F.concat(F.lit("bad template "), F.coalesce("template_id", F.lit("without id")))
    return checked.withColumn("template_id", F.when(C("wrong"), F.raise_error(said).cast("string")).otherwise(C("template_id"))).drop("wrong")


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """result, metrics…: result files (JSON, one object each) by a glob, each named after its file; files may lack fields that others have."""
    rows = spark.read.option("multiLine", True).json(pattern)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("result"), *rows.columns)


def read_split(spark: SparkSession, path: str, split: str, languages: list[str] | None = None, split_col: str = "split", language_col: str = "language") -> DataFrame:
    """One published split; split and languages reach the scan."""
    rows = spark.read.parquet(path).where(C(split_col) == split)
    return rows.where(C(language_col).isin(*languages)) if languages is not None else rows


def inputs(rows: DataFrame, done: DataFrame | None = None, default: str = "de_ch") -> DataFrame:
    """Rows to label: with id and text, not done yet, the default language where there is none."""
    from spanwright.operators.balance import not_done

    ready = rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(default)))
    return ready if done is None else not_done(ready, done)


DETECTED = "id string, spans array<struct<label:string,start:int,end:int,text:string,score:double>>"


class Busy(Exception):
    """What a client raises when its service asks to come back later (too many requests, or it can't be reached just now)."""


LABELLED = "id string, answer string, error string"


def label_remote(rows: DataFrame, connect: Callable[[], Callable[[str], str]], workers: int = 8, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """id, answer, error of prompts (id, prompt) sent to a model. connect is called once per partition and gives a function from one prompt to one answer, of which
    up to `workers` run at once. A call that raises Busy is repeated after wait, 2 * wait, … seconds, `tries` times in all; one that raises anything else
    isn't. What fails has no answer and says why; nothing stops the run. Null prompts aren't sent.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()

        def one(prompt: str | None) -> tuple[str | None, str | None]:
            if prompt is None:
                return None, None
            for turn in range(tries):
                try:
                    return call(prompt), None
                except Busy as busy:
                    said = f"busy: {busy}"
                    if turn + 1 < tries:
                        time.sleep(wait * 2**turn)
                except Exception as wrong:  # noqa: BLE001 - a row's error is a value
                    return None, f"{type(wrong).__name__}: {wrong}"
            return None, said

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                answers = list(pool.map(one, [None if pd.isna(p) else p for p in batch["prompt"]]))
                yield pd.DataFrame({"id": batch["id"], "answer": [a for a, _ in answers], "error": [e for _, e in answers]}, dtype=object)

    return rows.select("id", "prompt").mapInPandas(label, LABELLED)


def detect_remote(rows: DataFrame, connect: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> DataFrame:
    """id, spans from a service. connect is called once per partition and gives a function from texts to lists of
    {label, start, end, score}; spans are trimmed, empty ones dropped; empty texts aren't sent."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        for batch in batches:
            texts = batch["text"].fillna("")
            full = texts[texts != ""]
            answers = dict(zip(full.index, call(full.tolist()))) if len(full) else {}
            spans = []
            for i, text in texts.items():
                found = []
                for s in answers.get(i, []):
                    a, b = s["start"], s["end"]
                    while a < b and text[a] in " \t\n":
                        a += 1
                    while b > a and text[b - 1] in " \t\n":
                        b -= 1
                    if b > a:
                        found.append({"label": s["label"], "start": a, "end": b, "text": text[a:b], "score": float(s.get("score", 1.0))})
                spans.append(found)
            yield pd.DataFrame({"id": batch["id"], "spans": spans})

    return rows.select("id", "text").mapInPandas(detect, DETECTED)


def parse_claims(text: F.Column, raw: F.Column) -> F.Column:
    """Spans (value, label) of a model's answer: JSON, or what stands between the first and the last brace. Values are stripped and must occur in the text; null if it isn't JSON."""
    kind = "struct<spans:array<struct<value:string,label:string>>>"
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.from_json(raw, kind)["spans"], F.from_json(inner, kind)["spans"])
    stripped = F.transform(parsed, lambda s: F.struct(F.trim(s["value"]).alias("value"), s["label"].alias("label")))
    return F.filter(stripped, lambda s: s["value"].isNotNull() & s["label"].isNotNull() & (s["value"] != "") & text.contains(s["value"]))
