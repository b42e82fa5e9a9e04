"""Requests to language models and their responses, as JSON bodies: the texts in them replaced by placeholders, and restored.

A kind of request names where its texts are; all else of a body stays as it is. Bodies have no one schema (a content is a string or a list
of parts, an input a string, a list or token ids), so that Python walks them, in Arrow batches; the texts then are rows like any others.
A body that is no JSON object has no texts and stays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.functions.kernels import gathered
from spanwright.operators import session

C = F.col
Change = Callable[[str], str]


def _value(value, change: Change):
    """A string, or the strings in lists of lists; token ids and all else stay."""
    if isinstance(value, str):
        return change(value) if value else value
    if isinstance(value, list) and not all(isinstance(x, int) for x in value):
        return [_value(x, change) for x in value]
    return value


def _fields(*names: str):
    def walk(body: dict, change: Change) -> None:
        for name in names:
            if name in body:
                body[name] = _value(body[name], change)

    return walk


def _string(name: str):
    def walk(body: dict, change: Change) -> None:
        if isinstance(body.get(name), str):
            body[name] = change(body[name])

    return walk


def _list(body, name: str) -> list[dict]:
    """The objects of a list field; none where it is something else."""
    found = body.get(name) if isinstance(body, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def _tools(body: dict, change: Change) -> None:
    for tool in _list(body, "tools"):
        function = tool.get("function")
        if isinstance(function, dict) and isinstance(function.get("description"), str):
            function["description"] = _value(function["description"], change)


def _chat(body: dict, change: Change) -> None:
    """Contents first, parts of type text among them; then the speakers' names, then the tools."""
    for message in _list(body, "messages"):
        if isinstance(message.get("content"), str):
            message["content"] = change(message["content"])
        for part in _list(message, "content"):
            if part.get("type") == "text" and isinstance(part.get("text"), str):
                part["text"] = change(part["text"])
    for message in _list(body, "messages"):
        if isinstance(message.get("name"), str):
            message["name"] = _value(message["name"], change)
    _tools(body, change)


def _responses(body: dict, change: Change) -> None:
    _fields("input", "instructions")(body, change)
    _tools(body, change)


#: Where a request's texts are, in order; other kinds, such as variations of images, have none.
REQUESTS = {
    "chat": _chat, "responses": _responses, "completions": _fields("prompt"), "embeddings": _fields("input"), "moderations": _fields("input"), "images": _fields("prompt"),
    "speech": _fields("input", "instructions"), "transcriptions": _string("prompt"), "translations": _string("prompt"),
}


def _chat_response(body: dict, change: Change) -> None:
    for choice in _list(body, "choices"):
        message = choice.get("message")
        if isinstance(message, dict):
            for name in ("content", "reasoning"):
                _string(name)(message, change)
            for detail in _list(message, "reasoning_details"):
                _string("text")(detail, change)
            for call in _list(message, "tool_calls"):
                if isinstance(call.get("function"), dict):
                    _string("arguments")(call["function"], change)


def _responses_response(body: dict, change: Change) -> None:
    for item in _list(body, "output"):
        for part in _list(item, "content"):
            _string("text")(part, change)


def _completions_response(body: dict, change: Change) -> None:
    for choice in _list(body, "choices"):
        _string("text")(choice, change)


#: Where a response's texts are; embeddings, moderations, images and speech give none.
RESPONSES = {"chat": _chat_response, "responses": _responses_response, "completions": _completions_response, "transcriptions": _string("text"), "translations": _string("text")}


def _walk(table: dict, kind, body, change: Change) -> str | None:
    """The body with its texts changed; as it was where there is nothing to walk."""
    if kind not in table or not isinstance(body, str):
        return body
    try:
        parsed = json.loads(body)
    except ValueError:
        return body
    if not isinstance(parsed, dict):
        return body
    table[kind](parsed, change)
    return json.dumps(parsed, ensure_ascii=False, separators=(",", ":"))


def _rows(*columns: pa.Array):
    """Rows of columns, each value made when it is asked for."""
    return (tuple(x.as_py() for x in row) for row in zip(*columns))


@F.arrow_udf(T.ArrayType(T.StringType()))
def body_texts(kind: pa.Array, body: pa.Array) -> pa.Array:
    """The texts of request bodies in order."""

    def texts(k: str | None, b: str | None) -> list[str]:
        found: list[str] = []
        _walk(REQUESTS, k, b, lambda t: found.append(t) or t)
        return found

    return gathered((texts(*row) for row in _rows(kind, body)), pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def with_texts(kind: pa.Array, body: pa.Array, texts: pa.Array) -> pa.Array:
    """The bodies with their texts, in order, in place of those they had; without any texts the body itself."""

    def changed(k: str | None, b: str | None, t: list | None) -> str | None:
        turn = iter(t or ())
        return _walk(REQUESTS, k, b, lambda _: next(turn)) if t else b

    return gathered((changed(*row) for row in _rows(kind, body, texts)), pa.string())


def resolve_sessions(calls: DataFrame, call_id: str = "call_id") -> DataFrame:
    """Calls whose session is their own where they name none: it is called after the call, so that a task that runs again gives the same."""
    return calls.withColumn("session_id", F.coalesce(C("session_id").cast("string"), F.concat(F.lit("call:"), C(call_id).cast("string"))))


def anonymise(requests: DataFrame, detect: Callable[[Column], Column], normalizers: dict[str, Callable[[Column], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with placeholders in their bodies' texts, the sessions' map). requests: session_id, seen, kind, body; (session_id, seen) is unique.

    detect: a column function from text to array of struct(start, end, label). The texts of a session's requests share one map, in the order of the
    requests and of the texts in them.
    """
    listed = requests.withColumn("__texts", body_texts("kind", "body"))
    rows = listed.select("session_id", C("seen").alias("at"), F.posexplode("__texts").alias("n", "text"))
    texts = rows.select("session_id", F.struct("at", "n").alias("seen"), "text", detect(C("text")).alias("spans"))
    done, table = session.apply_spans(texts, normalizers)
    per = done.groupBy("session_id", C("seen.at").alias("__at")).agg(F.array_sort(F.collect_list(F.struct(C("seen.n").alias("n"), "redacted"))).alias("__done"))
    per = per.select(C("session_id").alias("__session"), "__at", C("__done.redacted").alias("__done"))
    joined = requests.join(per, (C("session_id") == C("__session")) & (C("seen") == C("__at")), "left")
    return joined.withColumn("body", with_texts("kind", "body", "__done")).drop("__session", "__at", "__done"), table


_PLACEHOLDER = re.compile(r"<[A-Z][0-9A-Z_]*_\d+>")


@F.arrow_udf(T.StringType())
def restored_bodies(kind: pa.Array, body: pa.Array, marks: pa.Array, surfaces: pa.Array) -> pa.Array:
    """Response bodies with known placeholders replaced in one pass; unknown ones stay, and a surface is not searched again."""

    def changed(k: str | None, b: str | None, m: list | None, s: list | None) -> str | None:
        known = {} if m is None else dict(zip(m, s))
        return _walk(RESPONSES, k, b, lambda text: _PLACEHOLDER.sub(lambda hit: known.get(hit[0], hit[0]), text)) if known else b

    return gathered((changed(*row) for row in _rows(kind, body, marks, surfaces)), pa.string())


def restore(responses: DataFrame, table: DataFrame) -> DataFrame:
    """Responses (session_id, kind, body, …) with the surfaces of their session's map in their texts. table: the map as a long table."""
    maps = session.session_maps(table).select(C("session_id").alias("__session"), F.map_keys("mapping").alias("__marks"), F.map_values("mapping").alias("__surfaces"))
    joined = responses.join(maps, C("session_id") == C("__session"), "left")
    return joined.withColumn("body", restored_bodies("kind", "body", "__marks", "__surfaces")).drop("__session", "__marks", "__surfaces")
