"""Queries of sources, sinks and streams that the given tables can feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import session
from spanwright.plans.fixtures import load
from spanwright.plans.registry import query
from spanwright.plans.sessions import _MARKED, messages
from spanwright.sources.readers import inputs, parse_claims

C = F.col


@query("s08_split_by_language", "SELECT doc_id, lang FROM documents WHERE source = 'src1' AND lang IN ('de', 'fr')")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published split and languages, which reach the scan. The documents' source and lang stand for them."""
    from spanwright.sources.readers import read_split

    return read_split(spark, f"{sf_dir}/documents.parquet", "src1", ["de", "fr"], split_col="source", language_col="lang").select("doc_id", "lang")


@query("s15_inputs", "SELECT CAST(conv_id AS VARCHAR) || '#' || CAST(turn AS VARCHAR) AS id, CASE WHEN turn % 2 = 0 THEN 'de_ch' ELSE 'fr_ch' END AS language FROM conversations WHERE turn % 5 <> 4 AND coalesce(text, '') <> '' AND NOT (role = 'assistant' AND turn % 3 = 1)")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("turn", "role", F.when(C("turn") % 5 != 4, F.concat_ws("#", "conv_id", "turn")).alias("id"), "text", F.when(C("turn") % 2 == 1, "fr_ch").alias("language"))
    done = rows.where((C("role") == "assistant") & (C("turn") % 3 == 1)).select("id")
    return inputs(rows, done).select("id", "language")


@query("f24_parse_claims", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE w END AS value FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]{3,}') AS w FROM documents) WHERE w <> ''")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON, with words around it, with a value that isn't in the text, and none."""
    w = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    claim = F.concat(F.lit('{"spans": [{"value": " '), w, F.lit('", "label": "secret"}, {"value": "#gone#", "label": "secret"}]}'))
    raw = F.when(C("doc_id") % 4 == 3, "nothing").when(C("doc_id") % 4 == 1, F.concat(F.lit("Sure: "), claim, F.lit(" done."))).otherwise(claim)
    return load(spark, sf_dir, "documents").where(w != "").select("doc_id", F.get(parse_claims(C("text"), raw), F.lit(0))["value"].alias("value"))


_SEEN = f"{_MARKED}, x AS (SELECT conv_id, max(CASE WHEN tag = 'PERSON' AND idx = 1 THEN surface END) AS p1, max(CASE WHEN tag = 'PERSON' AND idx = 2 THEN surface END) AS p2, max(CASE WHEN tag = 'PERSON' AND idx = 3 THEN surface END) AS p3, max(CASE WHEN tag = 'EMAIL' THEN surface END) AS e1 FROM map GROUP BY 1) SELECT d.conv_id AS session_id, d.turn AS channel, replace(replace(replace(replace(redacted, '<PERSON_1>', p1), '<PERSON_2>', coalesce(p2, '<PERSON_2>')), '<PERSON_3>', coalesce(p3, '<PERSON_3>')), '<EMAIL_1>', e1) AS text FROM done d JOIN x ON x.conv_id = d.conv_id"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The redacted turns in pieces of seven characters, after their session's map and before an end."""
    done, table = session.apply_spans(messages(spark, sf_dir), recover=False)
    none = F.lit(None).cast("string")
    key = [C("session_id"), C("seen").cast("string").alias("channel")]
    size = F.ceil(F.length("redacted") / 7).cast("int")
    pieces = done.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(C("redacted"), i * 7 + 1, F.lit(7)))).alias("seq", "delta"))
    pieces = pieces.select("session_id", "channel", (C("seq") + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), "delta", none.alias("placeholder"), none.alias("surface"))
    ends = done.select(*key, F.lit(1 << 40).alias("seq"), F.lit("end").alias("kind"), none.alias("delta"), none.alias("placeholder"), none.alias("surface"))
    mark = F.concat(F.lit("<"), "tag", F.lit("_"), "idx", F.lit(">"))
    maps = done.select(*key).join(table.select("session_id", mark.alias("placeholder"), "surface"), "session_id")
    maps = maps.select("session_id", "channel", F.lit(0).cast("long").alias("seq"), F.lit("map").alias("kind"), none.alias("delta"), "placeholder", "surface")
    return maps.unionByName(pieces).unionByName(ends)


@query("r01_batch_twin", _SEEN)
def r01_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream gives in the end: the pieces in order, restored at once."""
    rows = deltas(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("kind") == "delta", F.struct("seq", "delta")))), lambda x: x["delta"]), "")
    mapping = F.map_from_entries(F.collect_list(F.when(C("kind") == "map", F.struct("placeholder", "surface"))))
    whole = rows.groupBy("session_id", "channel").agg(text.alias("t"), mapping.alias("m"))
    return whole.select("session_id", C("channel").cast("long").alias("channel"), session.restore(C("t"), C("m")).alias("text"))


@query("r02_stream", _SEEN)
def r02_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 to R6 as a stream over the shared folder: pieces written there, restored by state, read back and joined in order."""
    from spanwright.streaming.restore import restore_stream
    from spanwright.session import cut
    from spanwright.streaming.shared import folder, remove

    base = f"{folder(spark)}/restore-{uuid.uuid4().hex}"
    source = deltas(spark, sf_dir)
    source.write.parquet(f"{base}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        restored = restore_stream(spark.readStream.schema(source.schema).parquet(f"{base}/in"))
        run = restored.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(store, before)
    rows = cut(spark.read.parquet(f"{base}/out").groupBy("session_id", "channel").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x")))
    remove(spark, base)  # the stream's files; what it gave is written
    return rows.select("session_id", C("channel").cast("long").alias("channel"), F.array_join(C("x.text"), "").alias("text"))
