"""Inputs of the queries: the given tables with personal data seeded by arithmetic on their keys.

The tables hold hardly any of what the catalogue finds. The seeds are expressions that Spark and DuckDB read
alike, so that a query's SQL starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import kernels
from spanwright.functions.checks import VAT_WEIGHTS
from spanwright.session import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(text: str, i: int) -> str:
    return f"CAST(substr({text}, {i}, 1) AS INT)"


def padded(number: str, n: int) -> str:
    return f"lpad(CAST({number} AS STRING), {n}, '0')"


K = "doc_id"
_BBAN = f"('00762' || {padded(f'({K} * 7919 + 13) % 1000000000000', 12)})"
_IBAN_CHECK = f"(98 - CAST(CAST({_BBAN} || '121700' AS DECIMAL(38,0)) % 97 AS INT))"
IBAN = f"('CH' || {padded(f'CASE WHEN {K} % 5 = 0 THEN {_IBAN_CHECK} % 96 + 1 ELSE {_IBAN_CHECK} END', 2)} || {_BBAN})"
_AHV_BODY = f"('756' || {padded(f'({K} * 104729 + 7) % 1000000000', 9)})"
_AHV_SUM = " + ".join(f"{digit(_AHV_BODY, i)} * {1 if i % 2 else 3}" for i in range(1, 13))
_AHV_CHECK = f"((10 - ({_AHV_SUM}) % 10) % 10)"
_AHV = f"({_AHV_BODY} || CAST(CASE WHEN {K} % 4 = 0 THEN ({_AHV_CHECK} + 1) % 10 ELSE {_AHV_CHECK} END AS STRING))"
AHV = f"(CASE WHEN {K} % 2 = 0 THEN {_AHV} ELSE substr({_AHV}, 1, 3) || '.' || substr({_AHV}, 4, 4) || '.' || substr({_AHV}, 8, 4) || '.' || substr({_AHV}, 12, 2) END)"
_VAT_BODY = padded(f"10000000 + ({K} * 7907) % 89999999", 8)
_VAT_SUM = " + ".join(f"{digit(_VAT_BODY, i)} * {w}" for i, w in zip(range(1, 9), VAT_WEIGHTS))
_VAT_CHECK = f"((11 - ({_VAT_SUM}) % 11) % 11 % 10)"
_VAT = f"({_VAT_BODY} || CAST({_VAT_CHECK} AS STRING))"
VAT = f"('CHE-' || substr({_VAT}, 1, 3) || '.' || substr({_VAT}, 4, 3) || '.' || substr({_VAT}, 7, 3) || CASE WHEN {K} % 3 = 0 THEN ' MWST' ELSE '' END)"
_CARD_BODY = f"('4' || {padded(f'({K} * 15485863 + 11) % 100000000000000', 14)})"
_CARD_SUM = " + ".join((f"({digit(_CARD_BODY, i)} * 2 - CASE WHEN {digit(_CARD_BODY, i)} > 4 THEN 9 ELSE 0 END)" if i % 2 else digit(_CARD_BODY, i)) for i in range(1, 16))
_CARD_CHECK = f"((10 - ({_CARD_SUM}) % 10) % 10)"
_CARD = f"({_CARD_BODY} || CAST(CASE WHEN {K} % 7 = 0 THEN ({_CARD_CHECK} + 1) % 10 ELSE {_CARD_CHECK} END AS STRING))"
CARD = f"(CASE WHEN {K} % 2 = 0 THEN {_CARD} ELSE substr({_CARD}, 1, 4) || ' ' || substr({_CARD}, 5, 4) || ' ' || substr({_CARD}, 9, 4) || ' ' || substr({_CARD}, 13, 4) END)"
PHONE = f"(CASE {K} % 3 WHEN 0 THEN '+41 44 ' WHEN 1 THEN '044 ' ELSE '0041 (0)44 ' END || {padded(f'{K} * 37 % 1000', 3)} || ' ' || {padded(f'{K} % 100', 2)} || ' ' || {padded(f'{K} * 7 % 100', 2)})"
EMAIL = f"('user.' || CAST({K} AS STRING) || '@mail' || CAST({K} % 7 AS STRING) || '.example.ch')"
URL = f"('https://www.example.ch/p/' || CAST({K} AS STRING) || CASE WHEN {K} % 2 = 0 THEN '.' ELSE '' END)"
DATE = f"(CASE WHEN {K} % 2 = 0 THEN CAST(1 + {K} % 28 AS STRING) || '.' || CAST(1 + {K} % 12 AS STRING) || '.' || CAST(1965 + {K} % 60 AS STRING) ELSE CAST(1965 + {K} % 60 AS STRING) || '-' || {padded(f'1 + {K} % 12', 2)} || '-' || {padded(f'1 + {K} % 28', 2)} END)"
_MD5 = f"md5(CAST({K} AS STRING))"
SECRET = f"(CASE {K} % 3 WHEN 0 THEN 'ghp_' || {_MD5} || substr({_MD5}, 1, 4) WHEN 1 THEN 'AKIA' || upper(substr({_MD5}, 1, 16)) ELSE 'sk-proj-' || substr({_MD5}, 1, 24) END)"
_CARD_CONTEXT = f"CASE {K} % 6 WHEN 0 THEN 'IMEI ' WHEN 1 THEN 'Karte ' WHEN 2 THEN 'Tabelle 12 7 2011 ' ELSE 'bezahlt mit ' END"
_REFERENCE = f"CASE WHEN {K} % 8 = 0 THEN ' DOI: 10.5555/07.ABC.0000345678.12345.67 ' WHEN {K} % 8 = 1 THEN ' Skala 31 32 33 34 35 36 37 38 Ende' WHEN {K} % 8 = 2 THEN ' Mail: -buero@firma.example.ch, ...max@post.example.ch Ende' ELSE '' END"
TEXT = f"""(text || ' Kontakt: ' || {EMAIL} || ', ' || {URL} || ' Telefon ' || {PHONE} || '; Konto ' || {IBAN} || ' / AHV ' || {AHV}
 || ' / ' || {VAT} || '. Der Betrag wurde mit der folgenden Nummer am Schalter gebucht und danach ohne weiteren Vermerk abgelegt: ' || {_CARD_CONTEXT} || {CARD}
 || ' sowie am Tag ' || {DATE} || ' mit dem Schluessel ' || {SECRET} || {_REFERENCE})"""
PII_DOCS_SQL = f"SELECT doc_id, lang, source, {TEXT} AS text FROM documents"


def pii_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text: the documents, each with one of most kinds of personal data at its end."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).selectExpr("doc_id", "lang", "source", f"{TEXT} AS text")


# -- the words of each document, as spans

CATEGORY = "CASE ({n}) % 8 WHEN 0 THEN 'account_number' WHEN 1 THEN 'private_address' WHEN 2 THEN 'private_date' WHEN 3 THEN 'private_email' WHEN 4 THEN 'private_person' WHEN 5 THEN 'private_phone' WHEN 6 THEN 'private_url' ELSE 'secret' END"
LANGUAGE = "CASE lang WHEN 'de' THEN 'de_ch' WHEN 'fr' THEN 'fr_ch' WHEN 'es' THEN 'it_ch' ELSE 'en' END"
WORDS_SQL = f"""
SELECT doc_id, lang, source, i, value, CAST(e - length(value) AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (
  SELECT *, sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e
  FROM (SELECT doc_id, {LANGUAGE} AS lang, source, unnest(w) AS value, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '[ \\n]') AS w FROM documents)))
WHERE length(value) > 0
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").selectExpr("doc_id", f"{LANGUAGE} AS lang", "source", "text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, i, value, s, e: all words of the whole texts with their offsets, a row each; no shuffle."""
    return texts(spark, sf_dir).mapInArrow(kernels.word_rows, "doc_id long, lang string, source string, i int, value string, s int, e int")


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text, w: of each document that has words these in order, as struct(i, value, s, e); no shuffle."""
    return texts(spark, sf_dir).mapInArrow(kernels.word_lists, "doc_id long, lang string, source string, text string, w array<struct<i:int,value:string,s:int,e:int>>")


def from_words(spark: SparkSession, sf_dir: str, make: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What `make` gives of a batch (doc_id, lang, source, text) and its words as flat arrays (kernels.split_words); no shuffle. Lists of words
    that are taken apart again by expressions cost more than what is made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches, "text", 2 << 20):
            yield make(batch, *kernels.split_words(batch.column("text")))

    return texts(spark, sf_dir).mapInArrow(run, schema)


def third_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: the third word of each text, without splitting the rest."""
    third = F.get(F.split("text", "[ \n]", 4), F.lit(2))
    return load(spark, sf_dir, "documents").select(third.alias("value")).where(F.length("value") > 0)
