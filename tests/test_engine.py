"""Hand-picked cases and invariants."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from spanwright.functions import catalogue, checks, sequences, spans, text
from spanwright.operators import balance, merge, score, session, synth
from spanwright.sources import external, readers, writers
from spanwright.streaming.restore import release

SF = "/root/testdata/sf0.001"
C = F.col


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "check, value, good",
    [
        (checks.iban_ch, "CH9300762011623852957", True), (checks.iban_ch, "CH93 0076 2011 6238 5295 7", True), (checks.iban_ch, "CH93-0076-2011-6238-5295-7", True),
        (checks.iban_ch, "CH9900762011623852957", False), (checks.iban_ch, "DE89370400440532013000", False), (checks.iban_ch, "CH123456", False), (checks.iban_ch, "", False),
        (checks.luhn, "4111111111111111", True), (checks.luhn, "4111-1111-1111-1111", True), (checks.luhn, "4111111111111112", False), (checks.luhn, "41", False),
        (checks.ahv, "123.4567.8901.23", False), (checks.vat_che, "CHE-1", False),
    ],
)
def test_check_digits(spark, check, value, good):
    assert one(spark, check(C("v")), v=value) is good


def found(spark, value):
    return [(s["label"], s["text"]) for s in one(spark, catalogue.find_spans(C("t")), t=value)]


@pytest.mark.parametrize(
    "value, label, count",
    [
        ("Tabelle: 20966 3 2011 2011 2011 1-3 1-3 1-3 5100 5100", "account_number", 0),
        ("Karte 4111 1111 1111 1111 belastet am 2024-01-15.", "account_number", 1),
        ("Lohnklassen 31 32 33 34 35 36 37 38", "account_number", 0),
        ("Telefon (IMEI 3512340000000019)", "account_number", 0),
        ("DOI: 10.5555/07.ABC.0000345678.12345.67", "private_phone", 0),
        ("Zentrale: 034 555 12 83, Fax 034 555 12 04.", "private_phone", 2),
        ("Schreiben Sie an müller@exämple.ch oder", "private_email", 1),
        ("Mail: -info@firma.example.ch", "private_email", 1),
        ("", "private_email", 0),
    ],
)
def test_catalogue_cases(spark, value, label, count):
    assert sum(name == label for name, _ in found(spark, value)) == count


def test_catalogue_keeps_phone_after_a_date_and_trims_urls(spark):
    assert ("private_phone", "+41 58 465 11 22") in found(spark, "Le 10.02.2022, +41 800 24-7-365 / +41 58 465 11 22 Appel.")
    assert found(spark, "See https://example.ch.") == [("private_url", "https://example.ch")]


def test_mails_begin_at_a_words_edge(spark):
    for value, expected in (
        ("Mail: -info@firma.ch", ["info@firma.ch"]), ("...max@x.ch", ["max@x.ch"]), ("a.b+c@x.ch", ["a.b+c@x.ch"]), ("(m%n@x.ch)", ["m%n@x.ch"]), ("-@x.ch", []),
        ("a@b.ch,-y@c.ch", ["a@b.ch", "y@c.ch"]),
    ):
        assert [t for label, t in found(spark, value) if label == "private_email"] == expected, value


def test_zones_lose_no_match(spark):
    """The rules over whole texts, one by one, against those over zones."""
    import random

    rng = random.Random(4)
    bits = ["CH93 0076 2011 6238 5295 7", "756.9217.0769.85", "+41 44 268 12 34", "0041 (0)44 268 12 34", "4111 1111 1111 1111", "CHE-116.281.710 MWST", "CHE-116.281.710\u00a0 TVA,", "31.12.2020", "a.b@c.ch", "https://x.ch/a).", "sk-" + "a" * 24, "ghp_" + "A1" * 18, "AKIA" + "Z" * 16, "IVA", "wort", "und,", "7", "-", "(0)", "é", "\n", "10.5555/3", "DOI:"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "  ", "\n", "", "-", ".", "\u2003"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts.append("1 " * 30_000)  # a long table of numbers
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    whole = lambda t: F.struct(F.lit(0).alias("start"), t.alias("text"))
    for rules in (catalogue.STRICT, catalogue.LOOSE):
        plain = spans.drop_overlapping(spans.by_start_longest(F.concat(*(catalogue._by_rule(C("t"), whole(C("t")), r) for r in rules))), catalogue.FOUND)
        wrong = df.select("i", plain.alias("a"), catalogue.find_spans(C("t"), rules).alias("b")).where("a <> b").collect()
        assert not wrong, (texts[wrong[0]["i"]], wrong[0])


def test_offsets_count_code_points(spark):
    hits = one(spark, spans.find_all(C("t"), "[a-z]ü"), t="aü 😀 bü")
    assert [(h["start"], h["end"], h["text"]) for h in hits] == [(0, 2, "aü"), (5, 7, "bü")]


def test_null_text_has_no_spans(spark):
    assert spark.range(1).select(catalogue.find_spans(F.lit(None).cast("string")).alias("x")).first()["x"] == []


def test_mask_keeps_the_length(spark):
    row = spark.range(1).select(F.lit("von a.b@example.ch, ja").alias("t")).withColumn("m", spans.mask(C("t"), catalogue.find_spans(C("t")))).first()
    assert len(row["m"]) == len(row["t"]) and row["m"] == "von " + " " * 14 + ", ja"


def test_exact_folding(spark):
    for a, b in (("ﬁn", "FIN"), ("Straße", "STRASSE"), ("Jo el", "joel")):
        same = one(spark, text.fold(C("a")) == text.fold(C("b")), a=a, b=b)
        assert same is (b != "joel")


def test_normalizers(spark):
    assert text.resolve_normalizer("german") is text.german
    assert text.resolve_normalizer(text.fold) is text.fold
    with pytest.raises(ValueError):
        text.resolve_normalizer("unknown")
    assert one(spark, text.german(C("v")), v="MÜLLER  x") == "mueller x"
    assert one(spark, text.e164_ch(C("v")), v="0041 (0)44 268 12 34") == "+41442681234"
    assert one(spark, text.iso_date(C("v")), v="1er février 2020") == "2020-02-01"


def test_session_recovers_whole_words_only(spark):
    rows = [(1, 1, "Müller wohnt an der Müllergasse. Müller!", [(0, 6, "private_person")])]
    texts = spark.createDataFrame(rows, "session_id int, seen int, text string, spans array<struct<start:int,end:int,label:string>>")
    out, table = session.apply_spans(texts)
    row = out.first()
    assert row["redacted"] == "<PERSON_1> wohnt an der Müllergasse. <PERSON_1>!"
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(0, 6), (33, 39)]
    back = out.join(session.session_maps(table), "session_id").select(session.restore(C("redacted"), C("mapping")).alias("x")).first()["x"]
    assert back == rows[0][2]


def test_session_normalisers_share_a_placeholder(spark):
    rows = [(1, 1, "+41 44 268 12 34 und 044 268 12 34", [(0, 16, "private_phone"), (21, 34, "private_phone")])]
    texts = spark.createDataFrame(rows, "session_id int, seen int, text string, spans array<struct<start:int,end:int,label:string>>")
    assert session.apply_spans(texts, recover=False)[0].first()["redacted"] == "<PHONE_1> und <PHONE_2>"
    assert session.apply_spans(texts, {"private_phone": text.e164_ch}, recover=False)[0].first()["redacted"] == "<PHONE_1> und <PHONE_1>"


def test_texts_without_spans_stay(spark):
    rows = [(1, 1, "Anna", [(0, 4, "private_person")]), (1, 2, "Anna again", [])]
    texts = spark.createDataFrame(rows, "session_id int, seen int, text string, spans array<struct<start:int,end:int,label:string>>")
    assert {r["seen"]: r["redacted"] for r in session.apply_spans(texts)[0].collect()} == {1: "<PERSON_1>", 2: "Anna again"}


def test_guard(spark):
    df = spark.range(1).select(F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        session.guard(df, ["text"], set())
    assert session.guard(df, ["text"], set(), allow_raw=True) is df
    assert session.guard(df, ["text"], {"text"}) is df


def test_stream_gives_the_same_for_every_cut():
    mapping = {"<PERSON_1>": "Joel", "<EMAIL_12>": "a<b"}
    whole = "Hi <PERSON_1>, <PERSON_9> <b <<EMAIL_12>> < PERSON_1> <_1> <A"
    expected, held = release(whole, lambda p: mapping.get(p, p))
    for cuts in itertools.chain(itertools.combinations(range(1, len(whole)), 1), itertools.combinations(range(1, len(whole)), 2), [tuple(range(1, len(whole)))]):
        out, hold = "", ""
        for a, b in zip((0, *cuts), (*cuts, len(whole))):
            text_out, hold = release(hold + whole[a:b], lambda p: mapping.get(p, p))
            out += text_out
        assert out + hold == expected + held


def test_long_tails_are_not_held():
    out, held = release("<" + "A" * 80, lambda p: p)
    assert (out, held) == ("<" + "A" * 80, "")


def claims_of(spark, rows):
    return spark.createDataFrame([(1, s, i, *r) for i, (s, *r) in enumerate(rows)], "id int, source string, pos int, start int, end int, label string, value string, subtype string")


def assembled(spark, rows, n=4):
    places = spark.createDataFrame([("Chur",)], "name string")
    out = merge.assemble(claims_of(spark, rows), spark.createDataFrame([(1, n)], "id int, n_candidates int"), places)
    return [(r["value"], r["label"], r["signals"], r["confidence"]) for r in out.orderBy("start", "end").collect()]


def test_merge_cases(spark):
    everyone = [(s, 0, 4, "private_person", "Anna", None) for s in ("gemma", "qwen", "nemotron", "regex")]
    assert assembled(spark, everyone)[0][3] == 1.0
    assert assembled(spark, everyone[:3])[0][3] == 0.75
    assert assembled(spark, everyone[:1])[0][3] == 0.25
    assert assembled(spark, [("audit", 0, 4, "private_person", "Anna", None)]) == []
    two = assembled(spark, [("gemma", 4, 10, "private_person", "Müller", None), ("qwen", 0, 10, "private_person", "Dr. Müller", None)])
    assert [v for v, *_ in two] == ["Dr. Müller", "Müller"]
    moved = assembled(spark, [("gemma", 0, 4, "private_address", "Chur", None), ("nemotron", 0, 4, "private_person", "Chur", None)])
    assert moved == [("Chur", "private_address", ["gemma", "nemotron"], 0.5)]
    tie = assembled(spark, [("gemma", 0, 4, "secret", "Anna", None), ("qwen", 0, 4, "private_url", "Anna", None)])
    assert [label for _, label, *_ in tie] == ["private_url"]


def test_consensus_counts_models(spark):
    votes = spark.createDataFrame([(1, "a", "x", "m1"), (1, "a", "x", "m1"), (1, "b", "x", "m1"), (1, "b", "x", "m2")], "id int, key string, label string, model string")
    assert [r["key"] for r in score.consensus(votes).collect()] == ["b"]
    assert sorted(r["key"] for r in score.consensus(votes, count_mode="span").collect()) == ["a", "b"]


def test_cells_never_overflow_and_rejects_would(spark):
    rows = [(f"c{i}", i, j, "rm", "fineweb", "private_person" if j else "private_url", "k") for i in range(500) for j in range(1 + i % 3)]
    cells = spark.createDataFrame(rows, "id string, pos int, n int, language string, subset string, label string, key string")
    admitted = {r["id"]: r["admitted"] for r in balance.admit_by_cells(cells).collect()}
    used: dict = {}
    for i, _, _, _, _, label, _ in rows:
        if admitted[i]:
            used[label] = used.get(label, 0) + 1
    assert max(used.values()) <= 600 and sum(used.values()) == len(rows)
    rows = rows * 2
    cells = spark.createDataFrame([(f"{n}{r[0]}", *r[1:]) for n, r in enumerate(rows)], cells.schema)
    many = cells.withColumn("id", F.concat("id", "n"))
    used = {r["label"]: r["n"] for r in many.join(balance.admit_by_cells(many).where("admitted"), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(used.values()) == 600


def test_splits_keep_documents_together_and_near_their_shares(spark):
    rows = [(f"d{d}#{i}", "de_ch", "fineweb", f"d{d}") for d in range(300) for i in range(1 + d % 4)]
    chunks = spark.createDataFrame(rows, "id string, language string, subset string, doc_id string")
    splits = balance.assign_splits(chunks)
    joined = balance.with_split(chunks, splits)
    assert joined.count() == len(rows)
    assert joined.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    sizes = {r["split"]: r["count"] / len(rows) for r in joined.groupBy("split").count().collect()}
    assert abs(sizes["train"] - 0.8) < 0.02 and abs(sizes["val"] - 0.1) < 0.02


def test_generated_spans_stand(spark):
    t = spark.createDataFrame([("t1", "fr_ch", "A [[PII:private_person]]\n[[PII:account_number/vat]] & [[PII:private_address]], le [[PII:private_date]].")], "template_id string, language string, text string")
    rows = synth.render(t, 200, 3)
    assert rows.where(spans.invalid_reason(C("text"), C("spans")).isNotNull()).isEmpty()
    values = rows.select(F.explode("spans").alias("s"), "text").select("s.label", F.substring("text", C("s.start") + 1, C("s.end") - C("s.start")).alias("v"))
    assert values.where("label = 'account_number'").where(~checks.vat_che(C("v"))).isEmpty()
    assert values.where("label = 'private_date'").select("v").distinct().count() > 100
    again = synth.render(t, 200, 3)
    assert rows.exceptAll(again).isEmpty()
    noisy = rows.withColumn("x", synth.once(synth.noise(C("text"), C("spans"), synth.seed_of(1, C("render")), 100)))
    kinds = {r["kind"] for r in noisy.select(C("x.kind").alias("kind")).distinct().collect()}
    assert len(kinds) == 7
    changed = noisy.select("text", "spans", C("x.text").alias("t2"), C("x.spans").alias("s2"))
    same = F.forall(F.zip_with("spans", "s2", lambda a, b: F.substring("text", a["start"] + 1, a["end"] - a["start"]) == F.substring("t2", b["start"] + 1, b["end"] - b["start"])), lambda x: x)
    assert changed.where(~same).isEmpty() and changed.where(spans.invalid_reason(C("t2"), C("s2")).isNotNull()).isEmpty()


def test_values_of_many_slots_are_those_of_the_columns(spark):
    labels = ["private_person", "private_email", "private_phone", "private_date", "private_address", "private_url", "account_number", "secret", "unknown"]
    formats = ["", "/ahv", "/vat", "/card", "/street_only", "/with_canton", "/common_word", "/last_first_upper", "/password", "/hex64", "/access_id", "/odd"]
    rows = [(f"t{i}", [*synth.POOLS, "xx", None][i % 7], f"ä{i} " + " ,ü".join(f"[[PII:{x}{formats[(i + 5 * j) % len(formats)]}]]" for j, x in enumerate(labels)) + " [[PII:Bad]]") for i in range(84)]
    rows += [("none", "en", None), ("plain", "en", "no marker"), ("empty", "en", "")]
    t = spark.createDataFrame(rows, "template_id string, language string, text string")
    made = synth.render(t, 3, 5)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()  # no shuffle of slots
    parsed = t.select("template_id", "language", synth.once(synth.slots_of(C("text"))).alias("slots")).crossJoin(spark.range(3).select(C("id").cast("int").alias("render")))
    slots = parsed.select("template_id", "language", "render", F.explode("slots").alias("s")).select("template_id", "language", "render", "s.*")
    h, female = synth.seed_of(5, C("template_id"), C("render"), C("n")), F.pmod(synth.seed_of(5, C("template_id"), C("render"), F.lit("gender")), F.lit(2)) == 0
    valued = slots.withColumn("h", synth.once(h)).withColumn("value", F.when(C("label").isNotNull(), synth.value(C("label"), C("fmt"), C("h"), C("language"), female)))
    rowwise = valued.groupBy("template_id", "language", "render").agg(F.array_sort(F.collect_list(F.struct("n", "gap", "value", "label"))).alias("slots"))
    expected = {(r[0], r[1]): r[2] for r in rowwise.select("template_id", "render", synth.once(synth.join_slots(C("slots")))).collect()}
    got = {(r["template_id"], r["render"]): (r["text"], r["spans"]) for r in made.collect()}
    assert len(got) == 3 * len(rows) and got == {k: tuple(v) for k, v in expected.items()}


def test_noise_of_odd_texts(spark):
    rows = [(None, []), ("", []), ("a b  c", None), ("ß x é", [(0, 1, "a"), (2, 3, "b")]), ("x", [(0, 1, "a")])]
    t = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,label:string>>").crossJoin(spark.range(60))
    noisy = synth.noise(C("text"), C("spans"), synth.seed_of(2, C("id")), 100)
    assert "ArrowEvalPython" in t.select(noisy)._jdf.queryExecution().executedPlan().toString()  # not a walk over each text's places from its beginning
    out = t.select("text", "spans", synth.once(noisy).alias("x")).select("text", "spans", "x.*", C("x.text").alias("t2"), C("x.spans").alias("s2")).collect()
    assert {r["kind"] for r in out} == set(synth.NOISE_KINDS)
    for r in out:
        if not r[0] or r[1] is None:
            assert (r["t2"], r["s2"]) == (r[0], r[1])
        else:
            assert [r[0][a:b] for a, b, _ in r[1]] == [r["t2"][a:b] for a, b, _ in r["s2"]]


def test_scored_spans_are_made_where_words_are_split(spark):
    from spanwright.plans import evaluation as E
    from spanwright.plans.fixtures import word_lists

    rows = E.scored(spark, SF)
    assert "transform(" not in score.row_counts(rows)._jdf.queryExecution().optimizedPlan().toString().lower()
    w = word_lists(spark, SF).select(C("doc_id").alias("row_id"), C("lang").alias("language"), "w")
    by_words = w.select("row_id", "language", E._spans_over("w", E._GOLD, "e", E._CAT).alias("gold"), E._spans_over("w", E._PRED, E._PRED_END, E._PRED_LABEL).alias("pred"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, by_words.collect()))


def test_bioes_round_trip_and_repair(spark):
    offsets = [(0, 0), (0, 3), (4, 7), (8, 9)]
    offset_type = "array<struct<a:int,b:int>>"
    row = spark.createDataFrame([("Max Egl x", offsets, [(0, 7, "private_person")], ["O", "I-secret", "E-secret", "E-private_url"])], f"text string, offsets {offset_type}, spans array<struct<start:int,end:int,label:string>>, broken array<string>")
    out = row.select(sequences.bioes(C("offsets"), C("spans")).alias("l"), sequences.decode_bioes(C("text"), C("offsets"), C("broken")).alias("d")).first()
    assert out["l"] == ["O", "B-private_person", "E-private_person", "O"]
    assert [tuple(s) for s in out["d"]] == [(0, 7, "secret"), (8, 9, "private_url")]


def test_windows(spark):
    for n, expected in ((0, []), (5, [(0, 5)]), (10, [(0, 10)]), (11, [(0, 10), (8, 11)]), (18, [(0, 10), (8, 18)])):
        assert [tuple(w) for w in one(spark, sequences.windows(C("n"), 10, 2), n=n)] == expected
    with pytest.raises(ValueError):
        sequences.windows(F.lit(3), 10, 10)


def test_translation():
    assert sequences.translation(["O", "B"], ["O", "B"]) == {0: 0, 1: 1}
    assert sequences.translation(["O", "X"], ["O", "B"], {"X": "B"}) == {0: 0, 1: 1}
    with pytest.raises(ValueError):
        sequences.translation(["O", "X"], ["O", "B"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "places.tsv").write_text("CH\t8001\tZürich\tKanton Zürich\tZH\tBezirk\t1\t\nDE\t1\tBerlin\tB\tBE\tx\t1\t\nCH\t1\tX\tY\tQQ\tz\t1\t\n")
    assert [(r["city"], r["language"]) for r in readers.read_places(spark, str(tmp_path / "places.tsv")).collect()] == [("Zürich", "de_ch")]
    (tmp_path / "none.tsv").write_text("DE\t1\tBerlin\tB\tBE\tx\t1\t\n")
    with pytest.raises(ValueError):
        readers.read_places(spark, str(tmp_path / "none.tsv"))
    span = {"start": 0, "end": 4, "label": "secret", "value": "abcd", "signals": ["gemma"], "confidence": 1.0}
    good, bad = {"id": "1", "text": "abcd", "spans": [{**span, "start": 2}, span]}, {"id": "2", "text": "abcd", "spans": [{**span, "signals": []}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(bad) + "\n")
    assert [r["id"] for r in readers.read_chunks(spark, str(tmp_path / "c.jsonl"), strict=False).collect()] == ["1"]
    with pytest.raises(Exception, match="invalid span in 2"):
        readers.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()
    writers.write_chunks(readers.read_chunks(spark, str(tmp_path / "c.jsonl"), strict=False), str(tmp_path / "out"))
    assert [s["start"] for s in readers.read_chunks(spark, str(tmp_path / "out")).first()["spans"]] == [0, 2]
    log = str(tmp_path / "log")
    writers.append_new(spark.createDataFrame([("a",), ("b",)], "id string"), log)
    assert sorted(r["id"] for r in writers.append_new(spark.createDataFrame([("b",), ("c",)], "id string"), log).collect()) == ["a", "b", "c"]
    writers.write_splits(spark.createDataFrame([("a", "train", "rm"), ("b", "test", "en")], "id string, split string, language string"), str(tmp_path / "splits"))
    assert [r["id"] for r in readers.read_split(spark, str(tmp_path / "splits"), "test", ["en"]).collect()] == ["b"]
    with pytest.raises(Exception, match="invalid spans: bounds"):
        writers.validated(spark.createDataFrame([("abc", [(0, 9, "x")])], "text string, spans array<struct<start:int,end:int,label:string>>")).collect()


def test_remote_detector(spark):
    def connect():
        return lambda texts: [[{"label": "secret", "start": 0, "end": 4}, {"label": "secret", "start": 3, "end": 4}] for _ in texts]

    rows = spark.createDataFrame([("1", "abc d"), ("2", ""), ("3", None)], "id string, text string")
    out = {r["id"]: [(s["start"], s["end"], s["text"]) for s in r["spans"]] for r in readers.detect_remote(rows, connect).collect()}
    assert out == {"1": [(0, 3, "abc")], "2": [], "3": []}


def test_external_corpora(spark, tmp_path):
    ner = [(["Max", "Egli", "in", "Chur"], ["B-PER", "I-PER", "O", "B-LOC"], "de"), (["Bern"], ["B-LOC"], "fr")]
    spark.createDataFrame(ner, "tokens array<string>, ner_tags array<string>, language string").write.parquet(str(tmp_path / "ner"))
    row = external.load_corpus(spark, "swissner", str(tmp_path / "ner"), ["de"]).first()
    assert row["text"] == "Max Egli in Chur" and [tuple(s) for s in row["spans"]] == [(0, 8, "private_person")]  # places are outside
    assert external.load_corpus(spark, "swissner", str(tmp_path / "ner"), positive_only=True).count() == 1
    numbered = spark.createDataFrame([(["Max", "AG", "x"], [1, 3, 99], "de")], "tokens array<string>, ner_tags array<int>, language string")
    assert [tuple(s) for s in external.CORPORA["wikineural"].rows(numbered).first()["spans"]] == [(0, 3, "private_person")]
    assert external.CORPORA["conll2003"].rows(numbered).first()["language"] == "en"
    rows = [("Max 1980", '[{"start": 0, "end": 3, "label": "first_name"}, {"start": 4, "end": 8, "label": "date_of_birth"}, {"start": 0, "end": 3, "label": "company"}]', "German"), ("x", "[]", "France"), ("y", "no json", "English"), ("", "[]", "English"), (None, None, "English")]
    spark.createDataFrame(rows, "generated_text string, pii_spans string, language string").write.parquet(str(tmp_path / "g"))
    got = {r["text"]: ([tuple(s) for s in r["spans"]], r["language"]) for r in external.load_corpus(spark, "gretel", str(tmp_path / "g")).collect()}
    assert got == {"Max 1980": ([(0, 3, "private_person"), (4, 8, "private_date")], "de_ch"), "x": ([], "fr_ch")}
    assert [r["text"] for r in external.load_corpus(spark, "gretel", str(tmp_path / "g"), positive_only=True).collect()] == ["Max 1980"]
    with pytest.raises(ValueError):
        external.load_corpus(spark, "nothing", str(tmp_path))


def test_external_samples(spark):
    kind = "source_text string, privacy_mask array<struct<label:string,start:int,end:int>>, language string, pos int"
    rows = [(f"Max {i}", [("GIVENNAME", 0, 3)] if i % 3 else [("SEX", 0, 3)], ["de", "en", "es"][i % 3 if i < 30 else 0], i) for i in range(90)]
    table = spark.createDataFrame(rows, kind)
    scanned = external.evaluation_rows("openpii", table, 5, C("pos"))
    assert sorted((r["language"], r["pos"]) for r in scanned.collect()) == [("de", p) for p in (0, 3, 6, 9, 12)] + [("en", p) for p in (1, 4, 7, 10, 13)]
    mixed = external.training_rows("openpii", table, 4)
    assert {(r["language"], r["n"]) for r in mixed.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()} == {("de_ch", 4), ("en", 4)}
    assert mixed.where("size(spans) = 0 or not synthetic").isEmpty()
    ner = spark.createDataFrame([(["A%d" % i], [1 if i % 4 == 0 else 5], "rm") for i in range(40)], "tokens array<string>, ner_tags array<int>, language string")
    some = external.training_rows("wikiann", ner, 6)
    assert 0 < some.count() <= 6 and some.where("size(spans) = 0").isEmpty() and some.first()["language"] == "rm"
    whole = external.training_mix({"openpii": lambda: table, "wikiann": lambda: ner}, "commercial")
    positive = sum(1 for r in rows if r[1][0][0] == "GIVENNAME" and r[2] != "es")
    assert whole.select("id").distinct().count() == whole.count() == positive + 10
    with pytest.raises(ValueError):
        external.training_mix({}, "none")


def test_labelled_projection(spark):
    row = spark.range(1).select(F.lit("Max in Bern").alias("t"), F.array(F.struct(F.lit(0).alias("a"), F.lit(3).alias("b"), F.lit("x").alias("l")), F.struct(F.lit(4).alias("a"), F.lit(6).alias("b"), F.lit("O").alias("l")), F.struct(F.lit(4).alias("a"), F.lit(6).alias("b"), F.lit(None).cast("string").alias("l"))).alias("s"))
    out = row.select(external.as_labelled(C("t"), external.spans_of(C("s"), "a", "b", "l")).alias("x")).first()["x"]
    assert [(s["value"], s["signals"], s["confidence"]) for s in out] == [("Max", ["external"], 1.0)]


def test_splits_of_large_strata_keep_their_shares(spark):
    rows = [(f"d{d}#{i}", "de_ch", "fineweb", f"d{d}") for d in range(3000) for i in range(1 + d % 4)]
    chunks = spark.createDataFrame(rows, "id string, language string, subset string, doc_id string")
    splits = balance.assign_splits(chunks, most=200)
    assert splits.count() == 3000 and splits.select("grp").distinct().count() == 3000
    sizes = {r["split"]: r["count"] / len(rows) for r in balance.with_split(chunks, splits).groupBy("split").count().collect()}
    assert abs(sizes["train"] - 0.8) < 0.02 and abs(sizes["val"] - 0.1) < 0.02


def test_language_decision(spark):
    from spanwright.functions.language import decide, stop_word_score

    assert one(spark, decide(C("t"), F.lit("fineweb"), F.lit("fr"), F.lit(0.9)), t="hi") == "de_ch"
    assert one(spark, decide(C("t"), F.lit("romansh"), F.lit("fr"), F.lit(0.2)), t="Bun di a tuts ensemen qua") == "rm"
    assert one(spark, stop_word_score(C("t")), t="the cat and the dog in a house")["code"] == "en"


def test_verdicts(spark):
    kind = "array<struct<start:int,end:int,label:string>>"
    cases = [([], [], "PASS_NEG"), ([], [(0, 1, "a")], "FAIL_NEG"), ([(0, 4, "a")], [(1, 3, "a")], "PASS"), ([(0, 4, "a")], [(1, 3, "b")], "FAIL"), ([(0, 4, "a"), (5, 6, "a")], [(1, 3, "a")], "PARTIAL")]
    rows = spark.createDataFrame([(i, g, p) for i, (g, p, _) in enumerate(cases)], f"i int, gold {kind}, pred {kind}")
    out = rows.select("i", score.verdict(C("gold"), score.soft_counts(C("gold"), C("pred"))).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in out] == [v for *_, v in cases]


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "session_id int, seen int, text string, spans array<struct<start:int,end:int,label:string>>")
    out, table = session.apply_spans(texts)
    assert out.count() == 0 and table.count() == 0
    rows = spark.createDataFrame([], "row_id int, language string, gold array<struct<start:int,end:int,label:string>>, pred array<struct<start:int,end:int,label:string>>")
    assert score.matrix(rows).count() == 0 and score.report(rows).where("level <> 'overall'").count() == 0
    chunks = spark.createDataFrame([], "id string, language string, subset string, doc_id string")
    assert balance.assign_splits(chunks).count() == 0 and balance.cap_documents(chunks).count() == 0
    cells = spark.createDataFrame([], "id string, pos int, n int, language string, subset string, label string, key string")
    assert balance.admit_by_cells(cells).count() == 0 and balance.cap_values(cells).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    """One text of 30,000 words; steps that walk it again for every word took minutes."""
    import time

    words = [f"w{i}" for i in range(30_000)]
    whole = " ".join(words)
    a = [0]
    for w in words[:-1]:
        a.append(a[-1] + len(w) + 1)
    offsets = [(x, x + len(w)) for x, w in zip(a, words)]
    own = [(x, y, "secret") for x, y in offsets[::2]]
    row = spark.createDataFrame([(whole, words, offsets, own)], "text string, tokens array<string>, offsets array<struct<a:int,b:int>>, spans array<struct<start:int,end:int,label:string>>")
    begin = time.time()
    labels = sequences.bioes(C("offsets"), C("spans"))
    both = F.array(F.lit("B-PER"), F.lit("O"))
    tags = F.transform("tokens", lambda _, k: F.get(both, k % 2))
    out = row.select(
        labels.alias("labels"), sequences.decode_bioes(C("text"), C("offsets"), labels).alias("decoded"), sequences.spans_of_sequence(labels, C("offsets")).alias("runs"),
        sequences.spans_of_tags(C("tokens"), tags, text.lit_map({"PER": "secret"})).alias("tagged"), spans.merge_adjacent_long(C("text"), C("spans")).alias("merged"),
        external.project_spans(C("text"), C("spans"), {"secret": "secret"}).alias("projected"), spans.locate_values(C("text"), C("tokens"))["start"].alias("located"),
    ).first()
    assert time.time() - begin < 30
    assert out["labels"] == ["S-secret", "O"] * 15_000
    assert all([tuple(s) for s in out[name]] == own for name in ("decoded", "runs", "tagged", "merged", "projected"))
    assert out["located"] == [whole.find(w) for w in words]


def test_label_folds_on_odd_sequences(spark):
    """Null labels, tokens without order, special tokens inside a span, lists of different lengths."""
    shape = "offsets array<struct<a:int,b:int>>, spans array<struct<start:int,end:int,label:string>>, labels array<string>"
    rows = [
        ([(0, 2), (0, 0), (3, 5), (6, 7)], [(0, 5, "x"), (6, 6, "y")], ["B-x", None, "I-x", "I-y"]),
        ([(6, 7), (0, 2), (3, 5)], [(0, 7, "x"), (3, 5, "y")], ["I-x", "S-x", "O", "B-y"]),
        (None, None, None), ([], [], []),
    ]
    df = spark.createDataFrame(rows, shape)
    got = [(r["l"], r["s"] and [tuple(x) for x in r["s"]]) for r in df.select(sequences.bioes(C("offsets"), C("spans")).alias("l"), sequences.spans_of_sequence(C("labels"), C("offsets")).alias("s")).collect()]
    assert got[0] == (["B-x", "O", "E-x", "O"], [(0, 5, "x"), (6, 7, "y")])
    assert got[1] == (["B-x", "I-x", "S-y"], [(6, 7, "x"), (0, 2, "x")])
    assert got[2:] == [([], None), ([], [])]


SMALLEST = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_merged_together_as_in_rows(spark):
    """No claim or span is shuffled, and the spans are those of the operators on rows."""
    from spanwright.plans import balancing as B
    from spanwright.plans import evaluation as E

    columns = ["id", "start", "end", "label", "value", "signals", "subtype"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    in_rows = merge.merge_signals(B.claims(spark, SMALLEST))
    assert rows(B.counted_spans(spark, SMALLEST)) == rows(in_rows)
    moved = merge.demote_places(in_rows, B.places(spark, SMALLEST))
    assert rows(B.placed_spans(spark, SMALLEST, False)) == rows(moved)
    solved = B.assembled(spark, SMALLEST)
    assert rows(solved) == rows(merge.resolve_conflicts(moved))
    count = {r["id"]: r["n_candidates"] for r in B.candidate_counts(spark, SMALLEST).collect()}
    assert all(count[r["id"]] == r["n_candidates"] for r in solved.select("id", "n_candidates").distinct().collect())
    for df in (solved, B.counted_spans(spark, SMALLEST), E.a15(spark, SMALLEST), score.row_counts(E.scored(spark, SMALLEST))):
        assert "hashpartitioning" not in plan_of(df) and "Join" not in plan_of(df)


def test_fuzzy_counts_as_pair_by_pair():
    import random

    from spanwright.operators.together import fuzzy

    deal = random.Random(5)
    word = lambda: "".join(deal.choice("ab\x00") for _ in range(deal.choice([0, 1, 2, 3, 5, 40])))
    for _ in range(300):
        gold, pred = ({word() for _ in range(deal.randrange(12))} for _ in range(2))
        alike = lambda a, others: any(a in b or b in a for b in others)
        tp = sum(alike(g, pred) for g in gold)
        assert fuzzy(gold, pred) == (tp, sum(not alike(p, gold) for p in pred), len(gold) - tp)
    many = {f"x{i}y" for i in range(100_000)}
    assert fuzzy(many, {"x1"}) == (sum(x.startswith("x1") for x in many), 0, sum(not x.startswith("x1") for x in many))


def test_span_counts_by_brute_force(spark):
    import random

    deal = random.Random(7)
    span = lambda: (s := deal.randrange(30), s + deal.randrange(0, 8), deal.choice("xyz"))
    rows = [(i, "de", [span() for _ in range(deal.randrange(9))], [span() for _ in range(deal.randrange(9))]) for i in range(60)] + [(99, "de", None, [(0, 2, "x")])]
    kind = "array<struct<start:int,end:int,label:string>>"
    got = {(r["row_id"], r["label"]): tuple(r)[3:] for r in score.row_counts(spark.createDataFrame(rows, f"row_id int, language string, gold {kind}, pred {kind}")).collect()}
    want = {}
    for i, _, gold, pred in rows:
        for label in {x[2] for x in (gold or []) + pred}:
            g, p = ([x for x in side or [] if x[2] == label] for side in (gold, pred))
            cg, cp = ({c for s, e, _ in set(side) for c in range(s, e)} for side in (g, p))
            want[i, label] = (len(set(g) & set(p)), len(set(p) - set(g)), len(set(g) - set(p)), len(cg & cp), len(cp - cg), len(cg - cp), len(g))
    assert got == want


def test_splits_of_a_large_stratum_are_dealt_as_a_whole(spark):
    """F16: above 20,000 groups a stratum was cut by hash, each part with its own shares."""
    import hashlib

    rows = spark.range(25_000).selectExpr("CAST(id AS STRING) AS id", "'en' AS language", "'fineweb' AS subset", "'d' || CAST(id AS STRING) AS doc_id")
    got = {r["grp"]: r["split"] for r in balance.assign_splits(rows).collect()}
    lacks, want = {"train": 0.8 * 25_000, "val": 0.1 * 25_000, "test": 0.1 * 25_000}, {}
    for grp in sorted((f"d{i}" for i in range(25_000)), key=lambda g: (hashlib.md5(f"{balance.SEED}{g}".encode()).hexdigest(), g)):
        want[grp] = max(lacks, key=lacks.get)
        lacks[want[grp]] -= 1
    assert got == want


def test_extract_or_reject_of_odd_texts(spark, tmp_path):
    """empty texts, none, and one that holds the sign of the absent value."""
    from spanwright.plans.scalars import f23

    texts = [(i, t) for i, t in enumerate(["", None, "\x01\x01\x01", "a"] * 5)] + [(20, "\x01"), (24, ""), (28, None), (32, "ab.\x01ab.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all(r["n"] == (None if r["doc_id"] % 4 == 0 else 1) for r in f23(spark, str(tmp_path)).collect())


def test_foreign_corpora_look_each_label_up_once(spark):
    """words' labels and tags aren't walked by expressions, and JSON is read once; odd spans and tags give what the expressions gave."""
    from spanwright.queries import QUERIES

    for name in ("finance_corpus", "masking_corpus", "masking_corpus_500k", "newswire", "swiss_news", "wiki_ann", "wiki_neural"):
        plan = plan_of(QUERIES[f"s09_{name}"](spark, SF)).lower()
        assert "lambdafunction" not in plan and plan.count("from_json(") == (name == "finance_corpus"), name
    kind = "text string, spans array<struct<label:string,start:bigint,end:bigint>>"
    rows = [
        ("Max Egli", [("N", 0, 3), None, (None, 0, 3), ("N", None, 3), ("", 0, 3), ("O", 0, 3), ("X", 0, 3), ("Q", 0, 3), ("N", -1, 3), ("N", 3, 3), ("N", 4, 9), ("M", 4, 8)]),
        (None, [("N", 0, 3)]), ("", [("N", 0, 0)]), ("Max", None), ("é😀", [("M", 0, 2), ("M", 0, 3)]),
    ]
    remap = {"N": "private_person", "M": "secret", "Q": "O", "O": "secret", "": "secret"}
    table = text.lit_map(remap)
    mapped = F.transform(external.spans_of(C("spans")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(table, s["label"]).alias("label")))
    before = F.filter(mapped, lambda s: s["label"].isNotNull() & (s["label"] != "O") & (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length("text")))
    got = spark.createDataFrame(rows, kind).coalesce(1).select(external.project_spans(C("text"), C("spans"), remap).alias("a"), before.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and [len(r["a"] or []) for r in got] == [2, 0, 0, 0, 1]
    names = ["O", "B-PER", "I-PER", "B-LOC", "I-A-PER", "PER", "S-PER"]
    tagged = [(["a", "bc", "d", "e"], [1, 2, 0, 2]), ([], []), (["x", "y", "z"], [6, 2, 1]), (["x", "y"], [1, 99]), (["x"], [None]), (["é", None, "z"], [1, 2, 2]), (["x", "y"], [1]), (["x"], [4, 2]), (None, [1]), (["x"], None), (["p", "q", "r"], [5, 4, -1])]
    for some in (tagged[:3], tagged):  # without odd ones, all at once
        df = spark.createDataFrame(some, "tokens array<string>, numbers array<int>").coalesce(1)
        df = df.withColumn("tags", F.transform("numbers", lambda t: F.coalesce(F.get(F.array(*map(F.lit, names)), t), F.lit("O"))))
        own = {"PER": "private_person"}
        forms = (sequences.spans_of_tags(C("tokens"), C("tags"), text.lit_map(own)), sequences.spans_of_tags(C("tokens"), C("tags"), own), sequences.spans_of_tags(C("tokens"), C("numbers"), own, names))
        rows = df.select(*(f.alias(f"f{n}") for n, f in enumerate(forms))).collect()
        assert all(r["f0"] == r["f1"] == r["f2"] for r in rows)
        assert [tuple(x) for x in rows[0]["f0"]] == [(0, 4, "private_person"), (7, 8, "private_person")] and [tuple(x)[:2] for x in rows[2]["f0"]] == [(0, 3), (4, 5)]


def test_labels_are_made_where_words_are_split(spark):
    """no list of words goes back and forth, and the labels and numbers are those of the column functions."""
    from spanwright.plans import sequences as P
    from spanwright.queries import QUERIES
    from spanwright.schema import LABELS

    queries = [QUERIES[n](spark, SF) for n in ("t01_bioes", "t02_label_ids", "t02_label_ids_of_a_window")]
    assert not any("ArrowEvalPython" in plan_of(df) or "Generate" in plan_of(df) for df in queries)
    rows = P.token_rows(spark, SF).withColumn("labels", sequences.bioes(C("offsets"), C("spans")))
    by_column = rows.select("doc_id", F.posexplode("labels").alias("k", "lab"))
    assert sorted(map(tuple, queries[0].collect())) == sorted(map(tuple, by_column.collect()))
    cut = rows.withColumn("ids", sequences.label_ids(C("labels"), C("offsets"), 512)).select("doc_id", F.size("ids"), F.size(F.filter("ids", lambda x: x > 0)))
    assert sorted(map(tuple, queries[2].collect())) == sorted(map(tuple, cut.collect()))
    odd = [(["O", "B-secret", "x", None], [(0, 1), (0, 0), (1, 2), (3, 4)]), (["S-secret"], [(0, 1), (0, 0), None]), (["O", "O"], [(0, 0)]), (None, [(0, 1)]), (["O"], None), ([], [])]
    table = F.create_map(*(x for i, name in enumerate(LABELS) for x in (F.lit(name), F.lit(i))))
    before = F.zip_with("labels", "offsets", lambda name, t: F.when((t["a"] == 0) & (t["b"] == 0), -100).otherwise(F.try_element_at(table, name)))
    for some in (odd[:1], odd):
        got = spark.createDataFrame(some, "labels array<string>, offsets array<struct<a:int,b:int>>").coalesce(1).select(sequences.label_ids(C("labels"), C("offsets")).alias("a"), before.alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]


def test_parts_of_a_batch_give_what_the_whole_gives(spark):
    """workers hold rows as Python objects for some rows at a time, and few patterns; F4 to F10: flat arrays of some documents at a time."""
    import pyarrow as pa

    from spanwright.functions import kernels
    from spanwright.operators import requests

    assert session._whole.cache_info().maxsize <= 4096
    assert not any("PANDAS" in str(f.evalType) or f.evalType == 200 for f in (requests.body_texts, requests.with_texts, requests.restored_bodies, session.recover_occurrences))
    held = []
    got = kernels.gathered((held.append(n) or [str(n)] if n % 7 else None for n in range(2500)), pa.list_(pa.string()), 1000)
    assert got.to_pylist() == [[str(n)] if n % 7 else None for n in range(2500)] and kernels.gathered(iter(()), pa.string()).to_pylist() == []
    lists, seen = pa.array([[1, 2], None, [], [3, 4, 5, 6], [7]], pa.list_(pa.int32())), []
    count = lambda x, y: seen.append(len(y)) or pa.array([None if v is None else x[0].as_py() + sum(v) for v in y.to_pylist()], pa.int64())
    for lo, hi, parts in ((0, 5, 3), (1, 4, 2), (5, 5, 1)):
        seen.clear()
        own = kernels.in_parts(count, 2)(pa.array([0] * (hi - lo), pa.int64()), lists[lo:hi])
        assert own.to_pylist() == [None if v is None else sum(v) for v in lists[lo:hi].to_pylist()] and len(seen) == parts
    rows = [("s", 1, "chat", json.dumps({"messages": [{"content": "Anna Keller kommt"}, {"content": None}]})), ("s", 2, "chat", "no json"), ("s", 3, None, None), ("s", 4, "speech", '{"input":"Anna Keller"}')]
    names = lambda t: F.when(t.startswith("Anna"), F.array(F.struct(F.lit(0).alias("start"), F.lit(11).alias("end"), F.lit("private_person").alias("label")))).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>"))
    done, _ = requests.anonymise(spark.createDataFrame(rows, "session_id string, seen int, kind string, body string"), names)
    assert {r["seen"]: r["body"] for r in done.collect()} == {1: '{"messages":[{"content":"<PERSON_1> kommt"},{"content":null}]}', 2: "no json", 3: None, 4: '{"input":"<PERSON_1>"}'}
