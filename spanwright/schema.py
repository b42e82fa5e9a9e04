"""Types and enumerations: spans, labelled chunks, labels, tags and sources."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])
DETECTED = T.StructType([*SPAN.fields, T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])
LABELLED = T.StructType(
    [
        *SPAN.fields,
        T.StructField("value", T.StringType()),
        T.StructField("signals", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("regex_subtype", T.StringType()),
    ]
)
EXAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("language", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("template_id", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("subset", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("spans", T.ArrayType(LABELLED)),
        T.StructField("build_pipeline", T.StringType()),
        T.StructField("labelers", T.ArrayType(T.StringType())),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Category -> the tag of its placeholders.
TAGS = {
    "account_number": "ACCOUNT",
    "private_address": "ADDRESS",
    "private_date": "DATE",
    "private_email": "EMAIL",
    "private_person": "PERSON",
    "private_phone": "PHONE",
    "private_url": "URL",
    "secret": "SECRET",
}
CATEGORIES = sorted(TAGS)
#: Outside first, then B, I, E, S of each category.
LABELS = ["O", *(f"{p}-{c}" for c in CATEGORIES for p in "BIES")]
LANGUAGES = "de_ch fr_ch it_ch rm gsw en".split()
SIGNALS = "audit gemma nemotron qwen regex synthetic".split()
REAL_SOURCES = ["curia_vista", "entscheidsuche", "fineweb", "romansh"]
SYNTHETIC_SOURCES = [f"synthetic_{s}" for s in ("adversarial", "common_word", "docs", "emails", "forms", "multilang_docs", "rm_secrets", "short_form", "slot_fill")]
