"""Queries of the pattern catalogue and of composite detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import catalogue, checks, spans
from spanwright.plans.fixtures import PII_DOCS_SQL, WORDS_SQL, load, pii_docs, word_lists
from spanwright.plans.registry import query

W = r"[\p{L}\p{N}_]"
_MAIL = r"\b[\p{L}\p{N}_+%.\-]+@[\p{L}\p{N}_\-.]+\.[a-zA-Z]{2,}\b"
_LINK = r"https?://[^>)\]\s]+"
_LEAD = "|".join([r"\+41", "0041", r"\b0"])
_SEP = r"[./\s\-]?"
_PARTS = [f"[0-9]{{{n}}}" for n in (2, 3, 2, 2)]
_BANK = r"\bCH[0-9]{2}(?:[-\s]?[0-9]){17}\b"
#: label, subtype, pattern for an engine without lookaround, its validator and its context rule by name.
_SQL_RULES = [
    ("private_email", None, _MAIL, None, None),
    ("private_url", None, _LINK, None, None),
    ("private_phone", "swiss_phone", rf"(?:{_LEAD})(?:\s?\(0\))?\s?{_SEP.join(_PARTS)}\b", None, "phone"),
    ("account_number", "iban_ch", _BANK, "iban", None),
    ("account_number", "ahv", r"\b756(?:\.[0-9]{4}){2}\.[0-9]{2}\b", "ahv", None),
    ("account_number", "ahv", r"\b756[0-9]{10}\b", "ahv", None),
    ("account_number", "vat_che", r"\bCHE-[0-9]{3}(?:\.[0-9]{3}){2}(?:\s+(?:IVA|MWST|TVA))?\b", "vat", None),
    ("account_number", "credit_card", r"\b[0-9](?:[-\s]?[0-9]){15,16}\b", "luhn", "table"),
    ("private_date", None, r"\b(?:[0-9]{4}(?:[-./][0-9]{1,2}){2}|(?:[0-9]{1,2}[./]){2}[0-9]{4})\b", None, None),
    ("secret", "openai_key", r"\bsk-(?:proj-)?[-0-9A-Z_a-z]{20,}\b", None, None),
    ("secret", "github_pat", r"\bghp_[0-9A-Za-z]{36}\b", None, None),
    ("secret", "aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", None, None),
]
_SQL_LOOSE = [
    ("private_email", None, _MAIL, None, None),
    ("private_url", None, _LINK, None, None),
    ("private_phone", None, rf"(?:{_LEAD})\s?" + r"\s?".join(_PARTS) + r"\b", None, None),
    ("account_number", None, _BANK, None, None),
    ("account_number", None, r"\b756(?:[.]?[0-9]{4}){2}[.]?[0-9]{2}\b", None, None),
    ("private_date", None, r"\b(?:[0-9]{1,2}\.){2}(?:[0-9]{4}|[0-9]{2})\b", None, None),
]


def sql_digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def sql_luhn(v: str) -> str:
    d = f"reverse({sql_digits(v)})"
    x = f"CAST(substr({d}, i, 1) AS INT)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN {x} * 2 - CASE WHEN {x} > 4 THEN 9 ELSE 0 END ELSE {x} END for i in generate_series(1, length({d}))]) % 10 = 0)"


def sql_iban(v: str) -> str:
    s = f"regexp_replace({v}, '[ -]', '', 'g')"
    return f"(regexp_full_match({s}, 'CH[0-9]{{19}}') AND TRY_CAST(substr({s}, 5) || '1217' || substr({s}, 3, 2) AS HUGEINT) % 97 = 1)"


def sql_ahv(v: str) -> str:
    d = sql_digits(v)
    total = " + ".join(f"CAST(substr({d}, {i}, 1) AS INT) * {1 if i % 2 else 3}" for i in range(1, 13))
    return f"CASE WHEN regexp_full_match({d}, '756[0-9]{{10}}') THEN (10 - ({total}) % 10) % 10 = CAST(substr({d}, 13, 1) AS INT) ELSE false END"


def sql_vat(v: str) -> str:
    d = sql_digits(v)
    total = " + ".join(f"CAST(substr({d}, {i}, 1) AS INT) * {w}" for i, w in zip(range(1, 9), checks.VAT_WEIGHTS))
    return f"CASE WHEN length({d}) >= 9 THEN (11 - ({total}) % 11) % 11 = CAST(substr({d}, 9, 1) AS INT) ELSE false END"


def sql_before(n: int) -> str:
    return f"lower(substr(text, greatest(s - {n}, 0) + 1, s - greatest(s - {n}, 0)))"


_REFERENCES = ["patent", "isbn", "issn", "doi ", "doi:"]


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_table() -> str:
    window = sql_before(80)
    around = "(substr(text, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0)) || ' ' || lower(substr(text, e + 1, 30)))"
    groups = r"regexp_extract_all(v, '\d+')"
    listed = f"(len({groups}) >= 6 AND len(list_filter({groups}, lambda x: length(x) > 3)) <= 1)"
    alone = rf"len(list_filter(regexp_split_to_array({around}, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '\d+'))) >= 3"
    return f"CASE WHEN {sql_any(window, ['amex', 'card', 'credit ', 'cvv', 'karte', 'kontonummer', 'pan ', 'visa'])} THEN false ELSE {sql_any(window, ['seriennummer', 'serial', 'imei', *_REFERENCES])} OR {listed} OR {alone} END"


def sql_phone() -> str:
    window = sql_before(80)
    return rf"(starts_with({sql_digits('v')}, '0000') OR {sql_any(window, _REFERENCES)} OR regexp_matches({window}, '\b10\.\d{{4,5}}/'))"


_VALID = {"luhn": sql_luhn, "iban": sql_iban, "ahv": sql_ahv, "vat": sql_vat}
_REJECT = {"table": sql_table, "phone": sql_phone}


def sql_matches(source: str, rules=_SQL_RULES) -> str:
    """All rules' matches over `source` (doc_id, text), before overlaps are resolved."""
    parts = []
    for n, (label, subtype, pattern, valid, reject) in enumerate(rules):
        url = label == "private_url"
        v = "rtrim(v[i], '.,;:!?\")>]')" if url else "v[i]"
        where = [f"{_VALID[valid]('v')}"] if valid else []
        where += [f"NOT ({_REJECT[reject]()})"] if reject else []
        parts.append(
            f"""SELECT doc_id, {n} AS rule, '{label}' AS label, {f"'{subtype}'" if subtype else 'CAST(NULL AS VARCHAR)'} AS subtype, s, e, v FROM (
  SELECT doc_id, text, s, s + length(v) AS e, v FROM (SELECT doc_id, text, {v} AS v,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s
  FROM (SELECT doc_id, text, v, g, unnest(generate_series(1, len(v))) AS i FROM (
    SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS v, string_split_regex(text, '{pattern}') AS g FROM {source})))) WHERE {' AND '.join(where) or 'length(v) > 0'}"""
        )
    return "\nUNION ALL\n".join(parts)


def sql_spans(source: str, rules=_SQL_RULES) -> str:
    """CTEs (to follow WITH RECURSIVE) that end in found(doc_id, label, subtype, s, e, v)."""
    return f"""
hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, s - e, rule) AS n FROM ({sql_matches(source, rules)})),
walk AS (
  SELECT doc_id, n, e AS last, true AS keep FROM hits WHERE n = 1
  UNION ALL
  SELECT h.doc_id, h.n, CASE WHEN h.s >= w.last THEN h.e ELSE w.last END, h.s >= w.last FROM walk w JOIN hits h ON h.doc_id = w.doc_id AND h.n = w.n + 1),
found AS (SELECT h.doc_id, h.label, h.subtype, CAST(h.s AS INTEGER) AS s, CAST(h.e AS INTEGER) AS e, h.v FROM hits h JOIN walk w ON h.doc_id = w.doc_id AND h.n = w.n WHERE w.keep)"""


SPANS_SQL = f"WITH RECURSIVE docs AS ({PII_DOCS_SQL}), {sql_spans('docs')}"


def found_rows(spark: SparkSession, sf_dir: str, rules=catalogue.STRICT) -> DataFrame:
    """doc_id, lang, source, then one row per span: s, e, v, label, subtype."""
    rows = pii_docs(spark, sf_dir).select("doc_id", "lang", "source", F.explode(catalogue.find_spans(F.col("text"), rules)).alias("x"))
    return rows.select("doc_id", "lang", "source", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.text").alias("v"), F.col("x.label").alias("label"), F.col("x.subtype").alias("subtype"))


@query(
    "x01_find_all",
    rf"""WITH docs AS ({PII_DOCS_SQL}) SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s, v[i] AS v
FROM (SELECT doc_id, v, g, unnest(generate_series(1, len(v))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+[.-][0-9]+') AS v, string_split_regex(text, '[0-9]+[.-][0-9]+') AS g FROM docs))""",
)
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_docs(spark, sf_dir).select("doc_id", F.explode(spans.find_all(F.col("text"), "[0-9]+[.-][0-9]+")).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("s"), F.col("x.text").alias("v"))


@query("x02_catalogue_spans", f"{SPANS_SQL} SELECT doc_id, s, e, v, label, coalesce(subtype, '') AS subtype FROM found")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_rows(spark, sf_dir).select("doc_id", "s", "e", "v", "label", F.coalesce("subtype", F.lit("")).alias("subtype"))


@query("x03_plain_spans", f"{SPANS_SQL} SELECT doc_id, s, e, label FROM found")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_rows(spark, sf_dir).select("doc_id", "s", "e", "label")


#: A stand-in for a learned model: capitalised words before a comma are persons.
MODEL_PATTERN = r"[A-Z][a-z]+(?=,)"


def stub_model(text):
    return F.transform(spans.find_all(text, MODEL_PATTERN), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit("private_person").alias("label")))




@query(
    "x04_composite_detection",
    rf"""{SPANS_SQL},
per AS (SELECT doc_id, list({{'s': s, 'e': e}} ORDER BY s) AS ss FROM found GROUP BY doc_id),
masked AS (SELECT d.doc_id, coalesce(p.ss, []) AS ss, d.text FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id),
m AS (SELECT doc_id, ss, text, unnest(generate_series(1, len(v))) AS i, v, g FROM (SELECT doc_id, ss, text, regexp_extract_all(text, '([A-Z][a-z]+),', 1) AS v, string_split_regex(text, '[A-Z][a-z]+,') AS g FROM masked)),
model AS (SELECT doc_id, ss, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS s, v[i] AS v FROM m)
SELECT doc_id, s, e, label, 'rule' AS source FROM found
UNION ALL SELECT doc_id, s, CAST(s + length(v) AS INTEGER), 'private_person', 'model' FROM model WHERE len(list_filter(ss, lambda x: x.s < s + length(v) AND s < x.e)) = 0""",
)
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_docs(spark, sf_dir).select("doc_id", F.explode(catalogue.composite(F.col("text"), stub_model)).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.label").alias("label"), F.col("x.source").alias("source"))


@query("x05_loose_catalogue", f"WITH RECURSIVE docs AS ({PII_DOCS_SQL}), {sql_spans('docs', _SQL_LOOSE)} SELECT doc_id, s, e, v, label FROM found")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_rows(spark, sf_dir, catalogue.LOOSE).select("doc_id", "s", "e", "v", "label")


#: Scores of a recogniser baseline by label; its dates need three parts, and null drops the label.
RECOGNISER_SCORES = {"private_email": 1.0, "private_url": 0.6, "private_phone": 0.75, "account_number": 0.95, "private_date": 0.5, "secret": None}


@query(
    "x06_scored_recognisers",
    f"""{SPANS_SQL} SELECT doc_id, s, e, label, score FROM (SELECT *, CASE label WHEN 'private_email' THEN CAST(1.0 AS DOUBLE) WHEN 'private_url' THEN 0.6 WHEN 'private_phone' THEN 0.75 WHEN 'account_number' THEN 0.95 WHEN 'private_date' THEN 0.5 END AS score FROM found)
WHERE score >= 0.6""",
)
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwright.functions.text import lit_map

    scores = lit_map({k: v for k, v in RECOGNISER_SCORES.items() if v is not None})
    return found_rows(spark, sf_dir).withColumn("score", F.try_element_at(scores, F.col("label"))).where("score >= 0.6").select("doc_id", "s", "e", "label", "score")


@query(
    "x07_merge_adjacent",
    """WITH w AS (SELECT doc_id, i, s, e, CASE WHEN (doc_id + i) % 4 = 0 THEN 'secret' ELSE 'private_person' END AS label FROM words WHERE (doc_id * 3 + i) % 5 <> 0),
j AS (SELECT *, CASE WHEN lag(label) OVER p = label AND s - lag(e) OVER p <= 1 THEN 0 ELSE 1 END AS fresh FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY s)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS grp FROM j)
SELECT doc_id, min(s) AS s, max(e) AS e, any_value(label) AS label FROM g GROUP BY doc_id, grp""".replace("FROM words", f"FROM ({WORDS_SQL})"),
)
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter("w", lambda x: (F.col("doc_id") * 3 + x["i"]) % 5 != 0)
    label = lambda x: F.when((F.col("doc_id") + x["i"]) % 4 == 0, "secret").otherwise("private_person")
    own = F.transform(kept, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), label(x).alias("label")))
    rows = word_lists(spark, sf_dir).select("doc_id", F.explode(spans.merge_adjacent_long(F.col("text"), spans.by_start_longest(own))).alias("m"))
    return rows.select("doc_id", F.col("m.start").alias("s"), F.col("m.end").alias("e"), F.col("m.label").alias("label"))


@query(
    "x08_locate_in_order",
    """WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\n]'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, text, w[CAST(floor((len(w) + 1) / 2) AS BIGINT)] AS v1, w[len(w)] AS v2 FROM d WHERE len(w) >= 2),
b AS (SELECT *, instr(text, v1) - 1 AS s1 FROM a)
SELECT doc_id, CAST(s1 AS INTEGER) AS s1, CAST(s1 + length(v1) + instr(substr(text, s1 + length(v1) + 1), v2) - 1 AS INTEGER) AS s2 FROM b""",
)
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word in the middle of a text and then its last one."""
    w = F.filter(F.split("text", "[ \n]"), lambda x: x != "")
    docs = load(spark, sf_dir, "documents").withColumn("w", w).where(F.size("w") >= 2)
    asked = F.array(F.element_at("w", F.floor((F.size("w") + 1) / 2).cast("int")), F.element_at("w", -1))
    return docs.select("doc_id", spans.locate_in_order(F.col("text"), asked).alias("x")).select("doc_id", F.col("x")[0]["start"].alias("s1"), F.col("x")[1]["start"].alias("s2"))


@query(
    "p07_commercial_register",
    """WITH d AS (SELECT doc_id, lang, text || CASE doc_id % 5 WHEN 0 THEN ' Einzelunterschrift' WHEN 1 THEN ' le Directeur' WHEN 2 THEN ' FIRMA collettiva' WHEN 3 THEN ' Managing Director' ELSE '' END AS text,
  CASE lang WHEN 'de' THEN 'de_ch' WHEN 'fr' THEN 'fr_ch' WHEN 'es' THEN 'xx' ELSE 'en' END AS language FROM documents)
SELECT doc_id, language FROM d WHERE CASE language
  WHEN 'de_ch' THEN regexp_matches(lower(text), 'einzelunterschrift|geschäftsführer|gesellschafter|kollektivunterschrift|personen mit entscheidungsbefugnis|prokurist|verwaltungsrat|verwaltungsräte|vorsitz|wurde im jahr')
  WHEN 'fr_ch' THEN regexp_matches(lower(text), 'administrateur|administratrice|conseil d.administration|directeur|directrice|gérant|signature collective|signature individuelle')
  WHEN 'en' THEN regexp_matches(lower(text), 'board of directors|managing director|sole signatory')
  ELSE regexp_matches(lower(text), 'einzelunterschrift|directeur|firma collettiva|managing director|gerente|gérant|direttore|vorsitz') END""",
)
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 as a predicate and P8 as the filter."""
    extra = F.expr("CASE doc_id % 5 WHEN 0 THEN ' Einzelunterschrift' WHEN 1 THEN ' le Directeur' WHEN 2 THEN ' FIRMA collettiva' WHEN 3 THEN ' Managing Director' ELSE '' END")
    language = F.expr("CASE lang WHEN 'de' THEN 'de_ch' WHEN 'fr' THEN 'fr_ch' WHEN 'es' THEN 'xx' ELSE 'en' END")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat("text", extra).alias("text"), language.alias("language"))
    return docs.where(catalogue.is_commercial_register(F.col("text"), F.col("language"))).select("doc_id", "language")


@query("a06_freq_cells", f"{SPANS_SQL} SELECT d.lang, f.label, coalesce(f.subtype, '') AS subtype, count(*) AS n_spans, count(DISTINCT f.doc_id) AS n_docs FROM found f JOIN docs d ON d.doc_id = f.doc_id GROUP BY ALL")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found_rows(spark, sf_dir)
    return rows.groupBy("lang", "label", F.coalesce("subtype", F.lit("")).alias("subtype")).agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    "a06_span_histogram",
    f"""{SPANS_SQL}, n AS (SELECT d.doc_id, d.lang, count(f.s) AS k, count(DISTINCT f.label) AS c FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY ALL)
SELECT lang, CAST(least(k, 10) AS INTEGER) AS n_spans, count(*) AS n_docs, count_if(c > 1) AS n_multi_category, count_if(k = 0) AS n_negative FROM n GROUP BY ALL""",
)
def a06_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_docs(spark, sf_dir).select("lang", catalogue.find_spans(F.col("text")).alias("x"))
    rows = rows.select("lang", F.size("x").alias("k"), F.size(F.array_distinct(F.transform("x", lambda s: s["label"]))).alias("c"))
    return rows.groupBy("lang", F.least("k", F.lit(10)).alias("n_spans")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("c") > 1).alias("n_multi_category"), F.count_if(F.col("k") == 0).alias("n_negative"))


@query(
    "e11_test_pool",
    f"""{SPANS_SQL}, f AS (SELECT d.doc_id, d.lang, max(CASE WHEN x.label = 'account_number' THEN 1 ELSE 0 END) AS dense FROM docs d LEFT JOIN found x ON x.doc_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, dense ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM f) SELECT doc_id, lang, CAST(dense AS INTEGER) AS dense FROM r WHERE n <= 10""",
)
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of language and structured data, a quota from each, without documents used before."""
    from pyspark.sql.window import Window

    fresh = pii_docs(spark, sf_dir).join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    dense = F.exists(catalogue.find_spans(F.col("text")), lambda s: s["label"] == "account_number").cast("int")
    order = Window.partitionBy("lang", "dense").orderBy(F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id")
    return fresh.select("doc_id", "lang", dense.alias("dense")).withColumn("n", F.row_number().over(order)).where("n <= 10").drop("n")
