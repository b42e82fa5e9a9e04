"""Queries of sessions: placeholders given, applied, restored, stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import spans
from spanwright.operators import requests, session
from spanwright.plans.fixtures import load
from spanwright.plans.registry import query

C = F.col
_NAME = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'Anna Keller' WHEN 1 THEN 'ANNA KELLER' WHEN 2 THEN 'Max Frei' WHEN 3 THEN 'Rosa  Egli' ELSE 'Rosa Egli' END"
_MAIL = "'post' || CAST(conv_id % 3 AS STRING) || '@example.ch'"
_TEXT = f"coalesce(text, '') || ' Von ' || {_NAME} || ' an ' || {_MAIL} || ' und ' || {_NAME} || '.'"
#: Two spans per turn; the name's second occurrence is left to recovery.
_S1, _E1 = "length(coalesce(text, '')) + 5", f"length(coalesce(text, '')) + 5 + length({_NAME})"
_S2 = f"({_E1} + 4)"
_E2 = f"({_S2} + length({_MAIL}))"
MESSAGES_SQL = f"SELECT conv_id, turn, role, {_TEXT} AS text, {_S1} AS s1, {_E1} AS e1, {_S2} AS s2, {_E2} AS e2, {_NAME} AS name, {_MAIL} AS mail FROM conversations"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seen, role, text, spans: the conversations with a name and an address in each turn."""
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{_TEXT} AS text", f"{_S1} AS s1", f"{_E1} AS e1", f"{_S2} AS s2", f"{_E2} AS e2")
    span = lambda n, label: F.struct(C(f"s{n}").cast("int").alias("start"), C(f"e{n}").cast("int").alias("end"), F.lit(label).alias("label"))
    return rows.select(C("conv_id").alias("session_id"), C("turn").alias("seen"), "role", "text", F.array(span(2, "private_email"), span(1, "private_person")).alias("spans"))


_MENTIONS = f"""m AS ({MESSAGES_SQL}),
mentions AS (SELECT conv_id, turn, 0 AS n, 'PERSON' AS tag, name AS surface FROM m UNION ALL SELECT conv_id, turn, 1, 'EMAIL', mail FROM m),
keyed AS (SELECT *, regexp_replace(lower(surface), ' +', ' ', 'g') AS key FROM mentions),
firsts AS (SELECT conv_id, tag, key, min(turn * 10 + n) AS seen, arg_min(surface, turn * 10 + n) AS surface FROM keyed GROUP BY ALL),
map AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tag ORDER BY seen) AS idx FROM firsts)"""


@query("n01_allocate", f"WITH {_MENTIONS} SELECT conv_id AS session_id, tag, key, CAST(idx AS INTEGER) AS idx, surface FROM map")
def n01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.apply_spans(messages(spark, sf_dir), recover=False)[1].select("session_id", "tag", "key", "idx", "surface")


_MARKED = f"""WITH {_MENTIONS},
marked AS (SELECT k.conv_id, k.turn, k.n, '<' || k.tag || '_' || CAST(p.idx AS VARCHAR) || '>' AS mark FROM keyed k JOIN map p ON k.conv_id = p.conv_id AND k.tag = p.tag AND k.key = p.key),
done AS (SELECT m.conv_id, m.turn, m.text, m.name, m.mail, m.role, substr(m.text, 1, m.s1) || a.mark || ' an ' || b.mark || ' und ' || m.name || '.' AS redacted, substr(m.text, 1, m.s1) || a.mark || ' an ' || b.mark || ' und ' AS head, a.mark AS mark
  FROM m JOIN marked a ON a.conv_id = m.conv_id AND a.turn = m.turn AND a.n = 0 JOIN marked b ON b.conv_id = m.conv_id AND b.turn = m.turn AND b.n = 1)"""


@query("n02_apply_spans", f"{_MARKED} SELECT conv_id AS session_id, turn AS seen, redacted FROM done")
def n02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.apply_spans(messages(spark, sf_dir), recover=False)[0].select("session_id", "seen", "redacted")


@query(
    "n03_recover_duplicates",
    f"""{_MARKED}, k AS (SELECT d.conv_id, d.turn, d.head, max(CASE WHEN p.surface = d.name THEN '<PERSON_' || CAST(p.idx AS VARCHAR) || '>' END) AS again, any_value(d.name) AS name
  FROM done d LEFT JOIN map p ON p.conv_id = d.conv_id AND p.tag = 'PERSON' AND p.seen <= d.turn * 10 + 9 GROUP BY ALL)
SELECT conv_id AS session_id, turn AS seen, head || coalesce(again, name) || '.' AS redacted, CASE WHEN again IS NULL THEN 2 ELSE 3 END AS n_spans FROM k""",
)
def n03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation in order, one session each."""
    return session.apply_spans(messages(spark, sf_dir))[0].select("session_id", "seen", "redacted", F.size("spans").alias("n_spans"))


_ANSWER = "'Re: <PERSON_1> <EMAIL_1> <URL_9> ' || substr(coalesce(text, ''), 1, 20) || '<PERSON_2>'"
_RESTORED = "'Re: ' || coalesce(x.p1, '<PERSON_1>') || ' ' || coalesce(x.e1, '<EMAIL_1>') || ' <URL_9> ' || substr(coalesce(c.text, ''), 1, 20) || coalesce(x.p2, '<PERSON_2>')"


@query("n04_restore", f"WITH {_MENTIONS}, x AS (SELECT conv_id, max(CASE WHEN tag = 'PERSON' AND idx = 1 THEN surface END) AS p1, max(CASE WHEN tag = 'PERSON' AND idx = 2 THEN surface END) AS p2, max(CASE WHEN tag = 'EMAIL' THEN surface END) AS e1 FROM map GROUP BY 1) SELECT c.conv_id AS session_id, c.turn AS seen, {_RESTORED} AS restored FROM conversations c JOIN x ON x.conv_id = c.conv_id")
def n04(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = session.apply_spans(messages(spark, sf_dir), recover=False)[1]
    answers = load(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "turn AS seen", f"{_ANSWER} AS answer")
    return answers.join(session.session_maps(table), "session_id").select("session_id", "seen", session.restore(C("answer"), C("mapping")).alias("restored"))


@query("n05_round_trip", f"SELECT conv_id AS session_id, turn AS seen, coalesce(text, '') || ' Von ' || arg_min(n, t) OVER k || ' an ' || m || ' und ' || arg_min(n, t) OVER k || '.' AS restored FROM (SELECT conv_id, turn, text, turn AS t, {_NAME} AS n, {_MAIL} AS m, regexp_replace(lower({_NAME}), ' +', ' ', 'g') AS key FROM conversations) WINDOW k AS (PARTITION BY conv_id, key) QUALIFY true")
def n05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted and restored: each surface as it was first seen. Both occurrences of a name are given as spans here."""
    both = messages(spark, sf_dir)
    last = F.struct((F.length("text") - 1 - (C("spans")[1]["end"] - C("spans")[1]["start"])).cast("int").alias("start"), (F.length("text") - 1).cast("int").alias("end"), F.lit("private_person").alias("label"))
    done, table = session.apply_spans(both.withColumn("spans", F.array_append("spans", last)), recover=False)
    return done.join(session.session_maps(table), "session_id").select("session_id", "seen", session.restore(C("redacted"), C("mapping")).alias("restored"))


#: What the detector of these queries finds: a name before " an " or alone, and the address.
_NAMES = "Anna Keller|ANNA KELLER|Max Frei|Rosa  Egli|Rosa Egli"


def detect(text: Column) -> Column:
    found = lambda pattern, label: F.transform(spans.find_all(text, pattern), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(label).alias("label")))
    return F.concat(found(rf"(?:{_NAMES})(?= an post|\z)", "private_person"), found(r"post[0-9]@example\.ch", "private_email"))


def quoted(value: Column) -> Column:
    """A JSON string; null as null."""
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1))


def _request_sql(where: str, more: str = "") -> str:
    """The map of the requests' texts: mentions in the messages that take part, and others of later places."""
    return f"""m AS ({MESSAGES_SQL}),
mentions AS (SELECT conv_id, turn * 10 AS place, 'PERSON' AS tag, name AS surface FROM m WHERE {where} UNION ALL SELECT conv_id, turn * 10 + 1, 'EMAIL', mail FROM m WHERE {where}{more}),
keyed AS (SELECT *, regexp_replace(lower(surface), ' +', ' ', 'g') AS key FROM mentions),
firsts AS (SELECT conv_id, tag, key, min(place) AS seen, arg_min(surface, place) AS surface FROM keyed GROUP BY ALL),
map AS (SELECT *, '<' || tag || '_' || CAST(row_number() OVER (PARTITION BY conv_id, tag ORDER BY seen) AS VARCHAR) || '>' AS mark FROM firsts),
done AS (SELECT m.conv_id, m.turn, substr(m.text, 1, m.s1) || a.mark || ' an ' || b.mark || ' und ' || CASE WHEN a.surface = m.name THEN a.mark ELSE m.name END || '.' AS redacted
  FROM m JOIN map a ON a.conv_id = m.conv_id AND a.tag = 'PERSON' AND a.key = regexp_replace(lower(m.name), ' +', ' ', 'g') JOIN map b ON b.conv_id = m.conv_id AND b.tag = 'EMAIL' AND b.key = m.mail WHERE {where})"""


#: Contents are null in every third turn, then a string, then parts; every fourth turn names its speaker; a tool's description mentions the address.
_CHAT = _request_sql("m.turn % 3 <> 0", " UNION ALL SELECT conv_id, 1000000 + turn, 'PERSON', name FROM m WHERE turn % 4 = 1 UNION ALL SELECT DISTINCT conv_id, 2000000, 'EMAIL', mail FROM m")


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{_TEXT} AS text", f"{_NAME} AS name", f"{_MAIL} AS mail")
    parts = F.concat(F.lit('[{"type":"text","text":'), quoted(C("text")), F.lit('},{"type":"image","text":"post1@example.ch"}]'))
    content = F.when(C("turn") % 3 == 0, "null").when(C("turn") % 3 == 1, quoted(C("text"))).otherwise(parts)
    name = F.when(C("turn") % 4 == 1, F.concat(F.lit(',"name":'), quoted(C("name")))).otherwise("")
    message = F.concat(F.lit('{"role":'), quoted(C("role")), F.lit(',"content":'), content, name, F.lit(',"turn":'), C("turn").cast("string"), F.lit("}"))
    per = rows.select("conv_id", "turn", "mail", message.alias("message")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("m"), F.min("mail").alias("mail"))
    tools = F.concat(F.lit(',"tools":[{"function":{"name":"send","description":'), quoted(F.concat(F.lit("Schreibt an "), C("mail"))), F.lit('}},{"type":"other"}]'))
    body = F.concat(F.lit('{"model":"m","messages":['), F.array_join("m.message", ","), F.lit("]"), tools, F.lit("}"))
    return per.select(C("conv_id").alias("session_id"), F.lit(1).alias("seen"), F.lit("chat").alias("kind"), body.alias("body"))


@query("n06_messages", f"WITH {_CHAT} SELECT m.conv_id AS session_id, m.turn, role, CASE WHEN m.turn % 3 = 0 THEN NULL WHEN m.turn % 3 = 1 THEN redacted ELSE redacted || '|post1@example.ch' END AS content FROM m LEFT JOIN done d ON d.conv_id = m.conv_id AND d.turn = m.turn")
def n06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in order in one session: null contents and other fields stay, strings change, and of parts those of type text."""
    done, _ = requests.anonymise(chat_requests(spark, sf_dir), detect)
    rows = done.select("session_id", F.explode(F.from_json("body", "messages array<struct<role:string,content:string,turn:int>>")["messages"]).alias("x"))
    parts = F.from_json("x.content", "array<struct<type:string,text:string>>")
    content = F.when(C("x.content").startswith('[{"type"'), F.array_join(F.transform(parts, lambda p: p["text"]), "|")).otherwise(C("x.content"))
    return rows.select("session_id", C("x.turn").alias("turn"), C("x.role").alias("role"), content.alias("content"))


@query("n09_chat_request", f"WITH {_CHAT} SELECT m.conv_id AS session_id, m.turn, CASE WHEN m.turn % 4 = 1 THEN p.mark END AS name, 'Schreibt an ' || e.mark AS description FROM m LEFT JOIN map p ON p.conv_id = m.conv_id AND p.tag = 'PERSON' AND p.key = regexp_replace(lower(m.name), ' +', ' ', 'g') JOIN map e ON e.conv_id = m.conv_id AND e.tag = 'EMAIL' AND e.key = m.mail")
def n09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat request's speakers and the descriptions of its tools."""
    done, _ = requests.anonymise(chat_requests(spark, sf_dir), detect)
    kind = "messages array<struct<name:string,turn:int>>, tools array<struct<function:struct<description:string>>>"
    rows = done.withColumn("p", F.from_json("body", kind)).select("session_id", F.explode("p.messages").alias("x"), C("p.tools")[0]["function"]["description"].alias("description"))
    return rows.select("session_id", C("x.turn").alias("turn"), C("x.name").alias("name"), "description")


#: A request per turn, its kind by the turn; the last kind has no text.
_KINDS = ["completions", "embeddings", "moderations", "images", "speech", "transcriptions", "translations", "responses", "variations"]
_KIND = f"{_KINDS!r}[CAST(m.turn % 9 AS BIGINT) + 1]"
_TAKES_PART = "m.turn % 9 <> 8"


def call_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "turn AS seen", f"{_TEXT} AS text")
    kind = F.get(F.array(*(F.lit(k) for k in _KINDS)), (C("seen") % 9).cast("int"))
    text, ids = quoted(C("text")), F.lit("[1,2,3]")
    nested = F.concat(F.lit("["), text, F.lit(","), ids, F.lit(',"",["x"]]'))  # a list in which token ids and an empty text stay
    fields = (
        F.when(C("kind") == "embeddings", F.concat(F.lit('"input":'), nested)).when(C("kind") == "moderations", F.concat(F.lit('"input":'), text)).when(C("kind") == "speech", F.concat(F.lit('"voice":"v","input":"a","instructions":'), text))
        .when(C("kind") == "responses", F.concat(F.lit('"input":[5],"instructions":'), text)).otherwise(F.concat(F.lit('"prompt":'), text))
    )
    return rows.withColumn("kind", kind).select("session_id", "seen", "kind", F.concat(F.lit('{"n":1,'), fields, F.lit("}")).alias("body"))


_FIRST_TEXT = "coalesce(prompt, instructions, CASE WHEN kind = 'embeddings' THEN from_json(input, 'array<string>')[0] ELSE input END)"


@query(
    "n11_to_n14_requests",
    f"WITH {_request_sql(_TAKES_PART)} SELECT m.conv_id AS session_id, m.turn AS seen, {_KIND} AS kind, coalesce(d.redacted, m.text) AS text, CASE {_KIND} WHEN 'embeddings' THEN '[1,2,3]' WHEN 'responses' THEN '[5]' WHEN 'speech' THEN 'a' END AS rest FROM m LEFT JOIN done d ON d.conv_id = m.conv_id AND d.turn = m.turn",
)
def n11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of all other kinds of requests, lists of texts and token ids (N7) among them; a kind without texts passes."""
    done, _ = requests.anonymise(call_requests(spark, sf_dir), detect)
    parsed = done.withColumn("p", F.from_json("body", "prompt string, input string, instructions string")).select("session_id", "seen", "kind", "p.*")
    rest = F.when(C("kind") == "embeddings", F.from_json("input", "array<string>")[1]).when(C("kind").isin("responses", "speech"), C("input"))
    return parsed.select("session_id", "seen", "kind", F.expr(_FIRST_TEXT).alias("text"), rest.alias("rest"))


@query("n08_own_sessions", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'c' || CAST(conv_id AS VARCHAR) ELSE 'call:' || CAST(conv_id AS VARCHAR) || '#' || CAST(turn AS VARCHAR) END AS session_id, CASE WHEN turn % 2 = 0 THEN '<PERSON_' || CAST(dense_rank() OVER (PARTITION BY conv_id, turn % 2 ORDER BY f) AS VARCHAR) || '>' ELSE '<PERSON_1>' END AS name FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, turn % 2, key) AS f FROM (SELECT conv_id, turn, regexp_replace(lower({_NAME}), ' +', ' ', 'g') AS key FROM conversations))")
def n08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that name a session share its map, others have their own."""
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn AS seen", f"{_NAME} AS name").withColumn("call_id", F.concat_ws("#", "conv_id", "turn"))
    named = rows.withColumn("session_id", F.when(C("turn") % 2 == 0, F.concat(F.lit("c"), C("conv_id").cast("string"))))
    body = F.concat(F.lit('{"prompt":'), quoted(C("name")), F.lit("}"))
    done, _ = requests.anonymise(requests.resolve_sessions(named).withColumns({"kind": F.lit("completions"), "body": body}), detect)
    return done.select("conv_id", "turn", "session_id", F.get_json_object("body", "$.prompt").alias("name"))


_RESPONSE_KINDS = ["chat", "responses", "completions", "transcriptions", "translations", "embeddings"]
_P1 = "(SELECT p1 FROM x WHERE x.conv_id = c.conv_id)"


@query(
    "n10_to_n14_responses",
    f"""WITH {_MENTIONS}, x AS (SELECT conv_id, max(CASE WHEN tag = 'PERSON' AND idx = 1 THEN surface END) AS p1 FROM map GROUP BY 1)
SELECT c.conv_id AS session_id, c.turn AS seen, {_RESPONSE_KINDS!r}[CAST(turn % 6 AS BIGINT) + 1] AS kind, CASE WHEN turn % 6 = 5 THEN 'Hallo <PERSON_1>' ELSE 'Hallo ' || p1 END AS text,
  CASE WHEN turn % 6 = 0 THEN 'weil ' || p1 || '|an ' || p1 || ' <URL_9>|{{"to":"' || p1 || '"}}' END AS more FROM conversations c JOIN x ON x.conv_id = c.conv_id""".replace("{{", "{").replace("}}", "}"),
)
def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents, reasoning and its details, and the arguments of calls; outputs, choices and transcripts; a kind without texts passes."""
    table = session.apply_spans(messages(spark, sf_dir), recover=False)[1]
    kind = F.get(F.array(*(F.lit(k) for k in _RESPONSE_KINDS)), (C("seen") % 6).cast("int"))
    chat = '{"choices":[{"message":{"content":"Hallo <PERSON_1>","reasoning":"weil <PERSON_1>","reasoning_details":[{"text":"an <PERSON_1> <URL_9>"},{"n":1}],"tool_calls":[{"function":{"arguments":"{\\"to\\":\\"<PERSON_1>\\"}"}}]}},{"index":1}]}'
    body = (
        F.when(C("kind") == "chat", chat).when(C("kind") == "responses", '{"output":[{"content":[{"text":"Hallo <PERSON_1>"},{"image":"x"}]},{"id":"<PERSON_1>"}]}')
        .when(C("kind") == "completions", '{"choices":[{"text":"Hallo <PERSON_1>"}]}').otherwise('{"text":"Hallo <PERSON_1>"}')
    )
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "turn AS seen").withColumn("kind", kind).withColumn("body", body)
    done = requests.restore(rows, table)
    field = lambda path: F.get_json_object("body", path)
    text = F.coalesce(field("$.choices[0].message.content"), field("$.output[0].content[0].text"), field("$.choices[0].text"), field("$.text"))
    more = F.concat_ws("|", field("$.choices[0].message.reasoning"), field("$.choices[0].message.reasoning_details[0].text"), field("$.choices[0].message.tool_calls[0].function.arguments"))
    return done.select("session_id", "seen", "kind", text.alias("text"), F.when(C("kind") == "chat", more).alias("more"))


@query("k09_session_json", f"WITH {_MENTIONS} SELECT conv_id AS session_id, tag, CAST(idx AS INTEGER) AS idx, key, surface FROM map")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as JSON and read back: keys re-derived from surfaces."""
    maps = session.session_maps(session.apply_spans(messages(spark, sf_dir), recover=False)[1])
    return session.from_json(session.to_json(maps))


@query("k09_session_counters", f"WITH {_MENTIONS} SELECT conv_id AS session_id, tag, CAST(max(idx) AS INTEGER) AS counter FROM map GROUP BY ALL")
def k09_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = session.session_maps(session.apply_spans(messages(spark, sf_dir), recover=False)[1])
    return session.from_json(session.to_json(maps)).groupBy("session_id", "tag").agg(F.max("idx").alias("counter"))
