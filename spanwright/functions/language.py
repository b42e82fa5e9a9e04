"""Decisions about a text's language, and prompts by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.text import BLANK, collapse, lit_map, prompt_language

#: Codes of an identifier and ours.
CODES = {c: c for c in ("en", "gsw", "rm")} | {c: f"{c}_ch" for c in ("de", "fr", "it")}
#: Frequent words, for a scorer that needs no model.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "mit", "von", "für"],
    "fr": ["le", "la", "les", "et", "est", "pas", "une", "avec", "des", "pour"],
    "it": ["il", "lo", "gli", "e", "è", "non", "una", "con", "del", "per"],
    "rm": ["il", "la", "ils", "ed", "è", "betg", "ina", "cun", "dal", "per"],
    "en": ["the", "of", "and", "is", "not", "a", "with", "to", "in", "for"],
}


def decide(text: Column, subset: Column, code: Column, score: Column, least: float = 0.5) -> Column:
    """The language of a text for which an identifier gave a code with a score. Texts under 20 characters, low scores and unknown codes get the subset's default."""
    default = F.when(subset == "romansh", "rm").otherwise("de_ch")
    short = F.length(F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")) < 20
    known = F.try_element_at(lit_map(CODES), code)
    return F.when(text.isNull() | short, default).when((score >= least) & known.isNotNull(), known).otherwise(default)


def stop_word_score(text: Column) -> Column:
    """struct(code, score): the language with the greatest share of its frequent words; ties to the last code."""
    words = F.filter(F.split(F.lower(collapse(text)), r"[^\p{L}]+"), lambda w: w != "")
    def share(stops: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stops))) / F.greatest(F.size(words), F.lit(1))

    shares = F.array(*(F.struct(share(stops).alias("score"), F.lit(code).alias("code")) for code, stops in sorted(STOP_WORDS.items())))
    best = F.array_max(shares)
    return F.struct(best["code"].alias("code"), F.least(best["score"] * 3, F.lit(1.0)).alias("score"))


def messages(text: Column, language: Column, system: Column, examples: Column) -> Column:
    """A prompt as array of struct(role, content): the language's system text, examples as turns, the text between marks."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    framed = lambda t: F.concat(F.lit("Input:\n<<<\n"), t, F.lit("\n>>>"))
    shots = F.flatten(F.transform(examples, lambda e: F.array(turn("user", framed(e["input"])), turn("assistant", e["answer"]))))
    return F.concat(F.array(turn("system", F.try_element_at(system, prompt_language(language)))), shots, F.array(turn("user", framed(text))))
