"""Sessions: surfaces replaced by placeholders, consistently within a session, and restored.

A session's map is a long table (session_id, tag, idx, key, surface): one row per distinct surface key. Numbers
are given per session and tag in the order in which keys are first seen, and the first surface stands for the key.
"""

from __future__ import annotations

import functools
import re
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanwright.functions import spans as S
from spanwright.functions.kernels import gathered
from spanwright.functions.text import PLACEHOLDER, WORD, fold, label_tag
from spanwright.schema import SPAN

C = F.col
MAP_KEY = ["session_id", "tag", "key"]


def surface_key(label: Column, surface: Column, normalizers: dict[str, Callable[[Column], Column]] | None = None, exact: bool = True) -> Column:
    """The key that surfaces of one placeholder share: the label's normaliser, or where it gives null or there is none the folded surface."""
    from spanwright.functions.text import fold_latin

    plain = fold(surface) if exact else fold_latin(surface)
    if not normalizers:
        return plain
    own = None
    for name, normalise in normalizers.items():
        own = F.when(label == name, normalise(surface)) if own is None else own.when(label == name, normalise(surface))
    return F.coalesce(own, plain)


def allocate(mentions: DataFrame, normalizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """session_id, tag, key, idx, surface, first_seen of mentions (session_id, seen, label, surface). seen: an orderable struct or number, unique in a session.

    One shuffle finds each key's first mention, one by session numbers them.
    """
    keyed = mentions.withColumn("tag", label_tag(C("label"))).withColumn("key", surface_key(C("label"), C("surface"), normalizers))
    first = keyed.groupBy(*MAP_KEY).agg(F.min(F.struct("seen", "surface")).alias("f")).select(*MAP_KEY, C("f.seen").alias("first_seen"), C("f.surface").alias("surface"))
    return first.withColumn("idx", F.row_number().over(Window.partitionBy("session_id", "tag").orderBy("first_seen")))


def merged_spans(texts: DataFrame) -> DataFrame:
    """texts (…, text, spans) with `spans` ordered, invalid and overlapping ones dropped, neighbours joined."""
    return texts.withColumn("spans", S.merge_adjacent(C("text"), S.by_start_longest(C("spans"))))


def apply_spans(texts: DataFrame, normalizers: dict[str, Callable[[Column], Column]] | None = None, recover: bool = True) -> tuple[DataFrame, DataFrame]:
    """(texts with `redacted` and `spans`, the sessions' map). texts: session_id, seen, text, spans (of start, end, label).

    recover: further whole-word occurrences of the surfaces that the session knew by then are replaced too, the longest first, and
    those of surfaces detected in this text are added to its spans. A text without spans stays as it is.
    """
    ready = merged_spans(texts)
    mentions = ready.select("session_id", C("seen").alias("at"), F.posexplode("spans").alias("n", "s"), "text").select(
        "session_id", F.struct("at", "n").alias("seen"), C("s.label").alias("label"), S.surface(C("text"), C("s")).alias("surface"), C("s.start").alias("start")
    )
    table = allocate(mentions, normalizers)
    marked = mentions.withColumn("tag", label_tag(C("label"))).withColumn("key", surface_key(C("label"), C("surface"), normalizers))
    placed = marked.join(table.select(*MAP_KEY, "idx"), MAP_KEY).groupBy("session_id", C("seen.at").alias("seen")).agg(
        F.array_sort(F.collect_list(F.struct("start", F.concat(F.lit("<"), "tag", F.lit("_"), "idx", F.lit(">")).alias("mark")))).alias("marks")
    )
    joined = ready.join(placed, ["session_id", "seen"], "left")
    marks = F.map_from_entries(C("marks"))
    redacted = S.splice(C("text"), C("spans"), lambda s: F.element_at(marks, s["start"]))
    out = joined.withColumn("redacted", F.when(C("marks").isNull(), C("text")).otherwise(redacted)).drop("marks")
    if not recover:
        return out, table
    # The map as it was once a text was done: of entries first seen up to it, those that can occur in it. A surface that occurs as whole words has its
    # first run of word characters in the text as a whole run, so that texts and entries meet by run; no session's map comes together.
    runs = rf"[{WORD}]+"
    entries = table.select("session_id", C("first_seen.at").alias("at"), F.concat(F.lit("<"), "tag", F.lit("_"), "idx", F.lit(">")).alias("mark"), "surface", F.regexp_extract("surface", runs, 0).alias("run")).where("surface <> ''")
    found_in = F.regexp_extract_all(F.concat_ws(" ", "text", "redacted"), F.lit(runs), 0)
    asking = out.where(F.size("spans") > 0).select("session_id", "seen", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), found_in))).alias("run"))
    usable = asking.join(entries, ["session_id", "run"]).where(C("at") <= C("seen")).groupBy("session_id", "seen").agg(F.collect_list(F.struct("mark", "surface")).alias("entries"))
    met = out.join(usable, ["session_id", "seen"], "left")
    patched = recover_occurrences(C("text"), C("redacted"), C("spans"), C("entries"))
    done = met.withColumn("r", patched).withColumn("redacted", C("r.redacted")).withColumn("spans", C("r.spans")).drop("r", "entries")
    return done, table


#: Patterns that a worker keeps; each takes some kB, and most surfaces are seen in one session only.
@functools.lru_cache(maxsize=1 << 12)
def _whole(surface: str) -> re.Pattern:
    return re.compile("(?<!\\w)%s(?!\\w)" % re.escape(surface))


def _recovered(t: str | None, r: str | None, found: list | None, known: list | None) -> dict:
    kept = [] if found is None else [(s["start"], s["end"], s["label"]) for s in found]
    if known and kept:
        label_of = {t[a:b]: label for a, b, label in kept}
        more: list = []
        for e in sorted(known, key=lambda e: (-len(e["surface"]), e["mark"])):
            if e["surface"] not in t and e["surface"] not in r:
                continue
            whole = _whole(e["surface"])
            r = whole.sub(lambda _, mark=e["mark"]: mark, r)
            label = label_of.get(e["surface"])
            if label is not None:
                for m in whole.finditer(t):
                    if not any(m.start() < b and a < m.end() for a, b, _ in kept + more):
                        more.append((m.start(), m.end(), label))
        kept = sorted(kept + more) if more else kept
    return {"redacted": r, "spans": [{"start": a, "end": b, "label": label} for a, b, label in kept]}


@F.arrow_udf(T.StructType([T.StructField("redacted", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]))
def recover_occurrences(text: pa.Array, redacted: pa.Array, spans: pa.Array, entries: pa.Array) -> pa.Array:
    """Whole-word occurrences of known surfaces, replaced in the redacted text and added to the spans of the text."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
    rows = (_recovered(*(x.as_py() for x in row)) for row in zip(text, redacted, spans, entries))
    return gathered(rows, pa.struct([("redacted", pa.string()), ("spans", pa.list_(span))]))


def restore(text: Column, mapping: Column) -> Column:
    """Known placeholders replaced by their surfaces in one pass; unknown ones stay, and a surface is not searched again."""
    by_text = S.let(S.find_all(text, PLACEHOLDER), lambda hits: S.splice(text, hits, lambda h: F.coalesce(F.try_element_at(mapping, h["text"]), h["text"])))
    return F.when(mapping.isNull() | ~text.contains("<"), text).otherwise(by_text)


def session_maps(table: DataFrame) -> DataFrame:
    """session_id, mapping: placeholder -> surface."""
    mark = F.concat(F.lit("<"), "tag", F.lit("_"), "idx", F.lit(">"))
    return table.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(mark.alias("mark"), "surface")))).alias("mapping"))


def to_json(maps: DataFrame) -> DataFrame:
    """session_id, json: only the mapping is kept."""
    return maps.select("session_id", F.to_json(F.struct("mapping")).alias("json"))


def from_json(stored: DataFrame) -> DataFrame:
    """session_id, tag, idx, key, surface: the map re-derived; what is no placeholder is skipped, other fields are ignored."""
    from spanwright.functions.text import parse_placeholder

    parsed = stored.select("session_id", F.explode(F.from_json("json", "mapping map<string,string>")["mapping"]).alias("mark", "surface"))
    parsed = parsed.withColumn("p", parse_placeholder(C("mark"))).where("p is not null")
    return parsed.select("session_id", C("p.tag").alias("tag"), C("p.index").alias("idx"), fold(C("surface")).alias("key"), "surface")


_warned: set[str] = set()


def guard(df: DataFrame, text_columns: list[str], redacted: set[str], allow_raw: bool = False, strict: bool = True) -> DataFrame:
    """df, unless a text column that isn't marked as redacted would leave; then a ValueError names it, or, where not strict, a warning does, once per column."""
    raw = [c for c in text_columns if c in df.columns and c not in redacted]
    if raw and not allow_raw:
        said = f"columns {raw} are not redacted; redact them or pass allow_raw=True"
        if strict:
            raise ValueError(said)
        if not _warned.issuperset(raw):
            _warned.update(raw)
            warnings.warn(said, stacklevel=2)
    return df
