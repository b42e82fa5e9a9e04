"""Queries of the generators. Their templates are one per document and language, so volume follows the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import checks
from spanwright.operators import synth
from spanwright.plans.fixtures import load
from spanwright.plans.registry import query

C = F.col
SEED = 11
_LANG = "CASE o_custkey % 5 WHEN 0 THEN 'de_ch' WHEN 1 THEN 'fr_ch' WHEN 2 THEN 'it_ch' WHEN 3 THEN 'rm' ELSE 'en' END"
_TEXT = "'Konto [[PII:account_number/ahv]], [[PII:account_number/vat]] & [[PII:account_number/card]] von [[PII:private_person]], geboren am [[PII:private_date]]. Tel [[PII:private_phone]]; [[PII:private_email]] ' || o_orderstatus || ' [[PII:account_number]] [[PII:secret]] [[PII:private_url]] in [[PII:private_address]].'"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS template_id", f"{_LANG} AS language", f"{_TEXT} AS text")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.render(templates(spark, sf_dir), 2, SEED)


def _surfaces(rows: DataFrame, label: str) -> DataFrame:
    one = rows.select("template_id", "render", "text", F.explode(F.filter("spans", lambda s: s["label"] == label)).alias("s"))
    return one.select("template_id", "render", C("s.label").alias("label"), F.substring("text", C("s.start") + 1, C("s.end") - C("s.start")).alias("surface"))


@query("g01_render")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per text; the test holds the spans against their checks."""
    return rendered(spark, sf_dir).select("template_id", "language", "render", "text", F.size("spans").alias("n_spans"))


@query("g06_check_digits", "SELECT 'account_number' AS label, 4 * 2 * count(*) AS n, 4 * 2 * count(*) AS n_valid FROM orders")  # no account fails its check
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generated account passes its own check."""
    v = C("surface")
    ok = F.when(v.startswith("CHE-"), checks.vat_che(v)).when(v.startswith("CH"), checks.iban_ch(v)).when(v.startswith("756"), checks.ahv(v)).otherwise(checks.luhn(v))
    accounts = _surfaces(rendered(spark, sf_dir), "account_number")
    return accounts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"))




@query("g10_compose", "SELECT o_orderkey, 'Hallo x' || CAST(o_orderkey % 700 AS VARCHAR) || chr(10) || chr(10) || 'Ende y' || CAST(o_custkey % 11 AS VARCHAR) AS text, CAST(6 AS INTEGER) AS s1, CAST(7 + length('x' || CAST(o_orderkey % 700 AS VARCHAR)) + 6 AS INTEGER) AS s2 FROM orders")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    fixed = lambda text, v: synth.fill(F.lit(text), lambda label, fmt, n: v)
    x = F.concat(F.lit("x"), (C("o_orderkey") % 700).cast("string"))
    y = F.concat(F.lit("y"), (C("o_custkey") % 11).cast("string"))
    parts = F.array(fixed("Hallo [[PII:private_person]]", x), fixed("Ende [[PII:secret]]", y))
    made = orders.select("o_orderkey", synth.compose(parts).alias("c"))
    return made.select("o_orderkey", C("c.text").alias("text"), C("c.spans")[0]["start"].alias("s1"), C("c.spans")[1]["start"].alias("s2"))


_PAIRS = "CASE o_orderkey % 3 WHEN 0 THEN 'Frau Frei und ' WHEN 1 THEN 'Der Platz ist frei, ' ELSE 'Frei: Herr Frei und ' END || 'x' || CAST(o_custkey AS STRING) || ' Koch'"


@query("g12_pairs_and_negatives", f"SELECT o_orderkey, r.r AS render, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE CAST(instr(text, 'Frei') - 1 AS INTEGER) END AS s1, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE CAST(instr(text, 'Koch') - 1 AS INTEGER) END AS s2 FROM (SELECT o_orderkey, {_PAIRS} AS text FROM orders), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS r) r")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words as names, found in order, and the same words as words, without spans."""
    one = lambda v: F.struct(F.lit(v).alias("value"), F.lit("private_person").alias("label"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PAIRS).alias("text"), F.when(C("o_orderkey") % 3 != 1, F.array(one("Frei"), one(""), one("Koch"))).alias("values"))
    made = synth.literal_layer(rows.select(C("o_orderkey").cast("string").alias("template_id"), F.lit("de_ch").alias("language"), "text", "values"), 2)
    return made.select(C("template_id").cast("long").alias("o_orderkey"), "render", F.get("spans", F.lit(0))["start"].alias("s1"), F.get("spans", F.lit(1))["start"].alias("s2"))


@query("g10_emails", "SELECT 'en' AS language, 'T' || CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS n, true AS in_parts FROM customer GROUP BY c_nationkey UNION ALL SELECT 'rm', 'T' || CAST(c_nationkey AS VARCHAR), count(*), true FROM customer WHERE c_nationkey < 5 GROUP BY c_nationkey")
def g10_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many e-mails of a language and sender as asked for, each of three or four fragments of its own language, one of each part."""
    customers = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    asked = customers.select(F.concat(F.lit("en/T"), C("c_nationkey").cast("string")).alias("language"), "n").union(customers.where("c_nationkey < 5").select(F.concat(F.lit("rm/T"), C("c_nationkey").cast("string")), "n"))
    fragments = spark.createDataFrame([(f"{p}{i}", c, p, f"{c} {p} {i}") for c in ("en", "rm") for p in ("greeting", "body", "signature") for i in range(3)], "fragment_id string, code string, part string, text string")
    own = asked.select("language").join(fragments, F.substring_index("language", "/", 1) == C("code")).drop("code")
    made = synth.compose_emails(own, asked, SEED)
    code = F.substring_index("language", "/", 1)
    good = C("text").rlike(r"\A(en|rm) greeting \d\n\n(\1 body \d\n\n){1,2}\1 signature \d\z") & C("text").startswith(code) & ~C("text").rlike(r"body (\d)\n\n.. body \1")
    return made.groupBy(code.alias("language"), F.substring_index("language", "/", -1).alias("nation")).agg(F.count_distinct("template_id").alias("n"), F.bool_and(good).alias("in_parts"))


#: Renders of the library's templates at a hundredth of the volumes.
_LAYERS = [("emails", "de_ch", 120), ("emails", "en", 20), ("emails", "fr_ch", 80), ("emails", "it_ch", 60), ("emails", "rm", 30), ("adversarial", "de_ch", 2), ("common_word", "de_ch", 2), ("common_word", "fr_ch", 2), ("docs", "de_ch", 6), ("forms", "de_ch", 4), *(("multilang_docs", c, 14) for c in ("de_ch", "en", "fr_ch", "it_ch", "rm")), ("rm_secrets", "rm", 2), ("short_form", "de_ch", 2), *(("short_form", c, 1) for c in ("en", "fr_ch", "it_ch", "rm"))]


@query("g14_layers", "SELECT * FROM (VALUES " + ", ".join(f"('synthetic_{a}', '{b}', CAST({n} AS BIGINT), true)" for a, b, n in _LAYERS) + ") t(source, language, n, stand)")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers from templates (S12) in their volumes, with noise; every span stands."""
    from spanwright.functions.spans import invalid_reason
    from spanwright.sources.readers import read_templates

    rows = synth.layers(read_templates(spark), SEED, 0.01)
    return rows.groupBy("source", "language").agg(F.count_distinct("id").alias("n"), F.bool_and(invalid_reason(C("text"), C("spans")).isNull()).alias("stand"))


def _forgetful():
    """A writer of texts that now and then leaves a value out."""
    import zlib

    def write(names: list[str], values: list[list[str]]) -> list[str]:
        return [f"{name}: " + ", ".join(v[: -1 if zlib.crc32("".join(v).encode()) % 3 == 0 else None]) + "." for name, v in zip(names, values)]

    return write


@query("g15_slot_fill", "SELECT template, language, CAST(sum(target) AS BIGINT) AS n, true AS complete FROM (SELECT ['customer_record', 'dev_chat', 'incident_report'][CAST(n_nationkey % 3 AS BIGINT) + 1] AS template, CASE WHEN n_regionkey < 2 THEN 'fr_ch' ELSE 'de_ch' END AS language, n_nationkey % 5 + 1 AS target FROM nation) GROUP BY 1, 2")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many texts of each kind as asked for, with all values of their payload; what a writer left out is asked for again."""
    template = F.get(F.array(*(F.lit(x) for x in sorted(synth.PAYLOADS))), (C("n_nationkey") % 3).cast("int"))
    targets = load(spark, sf_dir, "nation").groupBy(template.alias("template"), F.when(C("n_regionkey") < 2, "fr_ch").otherwise("de_ch").alias("language")).agg(F.sum(C("n_nationkey") % 5 + 1).alias("target"))
    made = synth.slot_fill(targets, _forgetful, SEED)
    sizes = F.create_map(*(x for k, v in synth.PAYLOADS.items() for x in (F.lit(k), F.lit(len(v)))))
    return made.groupBy("template", "language").agg(F.count_distinct("id").alias("n"), F.bool_and(F.size("spans") == sizes[C("template")]).alias("complete"))


@query("g13_noise")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per text; the test holds the surfaces before and after against each other."""
    rows = rendered(spark, sf_dir).withColumn("x", synth.once(synth.noise(C("text"), C("spans"), synth.seed_of(SEED, C("template_id"), C("render")))))
    same = F.zip_with("spans", "x.spans", lambda a, b: F.substring(C("text"), a["start"] + 1, a["end"] - a["start"]) == F.substring(C("x.text"), b["start"] + 1, b["end"] - b["start"]))
    aligned = (C("text") == C("x.text")) & (C("spans") == C("x.spans")) | F.forall(same, lambda t: t)  # most texts have no noise
    return rows.select("template_id", "render", C("x.kind").alias("kind"), aligned.alias("aligned"), C("x.text").alias("text"))
