"""The pattern catalogue: personal data that rules find, with check digits and context rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions import checks, spans
from spanwright.functions.text import BLANK, END, START, WORD

D = r"\p{Nd}"
GAP = rf"[{BLANK}\-]?"
FOUND = "struct<start:int,end:int,text:string,label:string,subtype:string>"


@dataclass(frozen=True)
class Rule:
    """A pattern; `hint` is a cheap condition without which it can't match."""

    label: str
    pattern: str
    hint: Callable[[Column], Column]
    subtype: str | None = None
    valid: Callable[[Column], Column] | None = None
    reject: Callable[[Column, Column, Column], Column] | None = None
    trims_url: bool = False


def _digits4(t: Column) -> Column:
    return t.rlike(r"\p{Nd}{2}")


def starts(first: str) -> str:
    """`first`, of one character or literal, where no word character comes before; it is looked for before what precedes it."""
    return rf"{first}(?<![{WORD}]{first})"


#: An e-mail address begins at the edge of a word: with a word's first character, or with a sign that stands right after one.
_MAIL = rf"(?:{START}[{WORD}]|(?<=[{WORD}])[+%.\-])[{WORD}+%.\-]*+@[{WORD}\-.]+\.[a-zA-Z]{{2,}}{END}"
#: The same characters as BLANK, by category; it is quicker to test.
_SPACE = r"\p{Z}\t-\r\x1C-\x1F\x85"
#: Where matches can lie: runs of blank-delimited tokens that hold a digit or a literal that a rule needs. A match that crosses a
#: blank does so between digits, brackets of digits or before a tax mark, so that each lies in one zone. Quantifiers over tokens are possessive,
#: so that long tables of numbers need no recursion and nothing is tried twice.
_TOKEN = rf"(?:[^{_SPACE}{D}@/_sA]++|s(?!k-)|A(?!KIA))*+(?:[{D}@/_]|sk-|AKIA)[^{_SPACE}]*+"
ZONE = rf"(?<![^{_SPACE}]){_TOKEN}(?:[{_SPACE}]++(?:{_TOKEN}|(?:IVA|MWST|TVA)[^{_SPACE}]*+))*+"
#: Order counts: of matches that start together and are as long, the first rule's wins.
STRICT = [
    Rule("private_email", _MAIL, lambda t: t.contains("@")),
    Rule("private_url", rf"https?://[^{BLANK}>)\]]+", lambda t: t.contains("://"), trims_url=True),
    Rule("private_phone", rf"(?:\+41|0041|{starts('0')})(?:[{BLANK}]?\(0\))?[{BLANK}]?{D}{{2}}[{BLANK}\-/.]?{D}{{3}}[{BLANK}\-/.]?{D}{{2}}[{BLANK}\-/.]?{D}{{2}}{END}", _digits4, "swiss_phone", None, checks.implausible_phone),
    Rule("account_number", rf"{starts('CH')}{D}{{2}}(?:{GAP}{D}){{17}}{END}", lambda t: t.contains("CH"), "iban_ch", checks.iban_ch),
    Rule("account_number", rf"{starts('756')}\.{D}{{4}}\.{D}{{4}}\.{D}{{2}}{END}", lambda t: t.contains("756."), "ahv", checks.ahv),
    Rule("account_number", rf"{starts('756')}{D}{{10}}{END}", lambda t: t.contains("756"), "ahv", checks.ahv),
    Rule("account_number", rf"{starts('CHE-')}{D}{{3}}\.{D}{{3}}\.{D}{{3}}(?:[{BLANK}]+(?:IVA|MWST|TVA))?{END}", lambda t: t.contains("CHE-"), "vat_che", checks.vat_che),
    Rule("account_number", rf"{starts(D)}{GAP}(?:{D}{GAP}){{14,15}}{D}{END}", _digits4, "credit_card", checks.luhn, checks.in_numeric_table),
    Rule("private_date", rf"{starts(D)}(?:{D}?[./]{D}{{1,2}}[./]{D}{{4}}|{D}{{3}}[./\-]{D}{{1,2}}[./\-]{D}{{1,2}}){END}", _digits4),
    Rule("secret", rf"{starts('sk-')}(?:proj-)?[\-0-9A-Z_a-z]{{20,}}{END}", lambda t: t.contains("sk-"), "openai_key"),
    Rule("secret", rf"{starts('ghp_')}[0-9A-Za-z]{{36}}{END}", lambda t: t.contains("ghp_"), "github_pat"),
    Rule("secret", rf"{starts('AKIA')}[0-9A-Z]{{16}}{END}", lambda t: t.contains("AKIA"), "aws_access_key"),
]
#: A looser one without check digits and context; two-digit years count.
LOOSE = [
    Rule("private_email", _MAIL, lambda t: t.contains("@")),
    Rule("private_url", rf"https?://[^{BLANK}>)\]]+", lambda t: t.contains("://"), trims_url=True),
    Rule("private_phone", rf"(?:\+41|0041|{starts('0')})[{BLANK}]?{D}{{2}}[{BLANK}]?{D}{{3}}[{BLANK}]?{D}{{2}}[{BLANK}]?{D}{{2}}{END}", _digits4),
    Rule("account_number", rf"{starts('CH')}{D}{{2}}(?:{GAP}{D}){{17}}{END}", lambda t: t.contains("CH")),
    Rule("account_number", rf"{starts('756')}[.]?{D}{{4}}[.]?{D}{{4}}[.]?{D}{{2}}{END}", lambda t: t.contains("756")),
    Rule("private_date", rf"{starts(D)}{D}?\.{D}{{1,2}}\.(?:{D}{{4}}|{D}{{2}}){END}", _digits4),
]


def _nothing() -> Column:
    return F.array().cast(f"array<{FOUND}>")


def _by_rule(text: Column, zone: Column, rule: Rule) -> Column:
    """The rule's matches in a zone (struct start, text) of the text, at the text's offsets."""
    inside, base = zone["text"], zone["start"]
    hits = F.transform(spans.find_all(inside, rule.pattern), lambda h: F.struct((h["start"] + base).alias("start"), (h["end"] + base).alias("end"), h["text"].alias("text")))
    if rule.trims_url:
        hits = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), spans.trim_url(h["start"], h["text"]).alias("end"), F.rtrim(h["text"], F.lit(".,;:!?\")>]")).alias("text")))
        hits = F.filter(hits, lambda h: h["end"] > h["start"])
    if rule.valid is not None:
        hits = F.filter(hits, lambda h: rule.valid(h["text"]))
    if rule.reject is not None:
        hits = F.filter(hits, lambda h: ~rule.reject(text, h["start"], h["end"]))
    named = F.transform(hits, lambda h: F.struct(h["start"], h["end"], h["text"], F.lit(rule.label).alias("label"), F.lit(rule.subtype).cast("string").alias("subtype")).cast(FOUND))
    return F.when(rule.hint(inside), named).otherwise(_nothing())


def find_spans(text: Column, rules: list[Rule] = STRICT) -> Column:
    """array of struct(start, end, text, label, subtype): all rules' matches, the leftmost and longest first, without overlaps. Null texts have none.

    One pass finds the zones, mostly a small part of a text; the rules search only those."""
    per_zone = lambda zone: F.concat(*(_by_rule(text, zone, r) for r in rules))
    found = F.flatten(F.transform(spans.find_all(text, ZONE), per_zone))
    return F.coalesce(spans.drop_overlapping(spans.by_start_longest(found), FOUND), _nothing())


def composite(text: Column, model: Callable[[Column], Column], rules: list[Rule] = STRICT) -> Column:
    """struct(start, end, label, source): the rules' spans, and those that a model finds in the text masked by them, without
    the model's that overlap a rule's. model: a column function from masked text to array of struct(start, end, label)."""
    bare = lambda source: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(source).alias("source"))

    def both(ruled: Column) -> Column:
        learned = spans.let(spans.mask(text, ruled), lambda masked: spans.not_overlapping(model(masked), ruled))
        return spans.by_start_end(F.concat(F.transform(ruled, bare("rule")), F.transform(learned, bare("model"))))

    return spans.let(find_spans(text, rules), both)


#: Phrases of commercial registers by language; each stands for all longer ones that contain it.
REGISTER_PHRASES = {
    "de_ch": ["einzelunterschrift", "geschäftsführer", "gesellschafter", "ist eine gesellschaft mit beschränkter haftung", "kollektivunterschrift", "personen mit entscheidungsbefugnis", "prokurist", "verwaltungsrat", "verwaltungsräte", "vorsitz", "wurde im jahr"],
    "fr_ch": ["administrateur", "administratrice", "associé gérant", "conseil d'administration", "directeur", "directrice", "fondé de pouvoir", "gérant", "personnes ayant le pouvoir de décision", "signature collective", "signature individuelle"],
    "it_ch": ["amministratore", "amministratrice", "consiglio di amministrazione", "direttore", "direttrice", "firma collettiva", "firma individuale", "gerente", "persone con potere decisionale", "procuratore"],
    "en": ["board of directors", "chief executive officer", "joint stock company", "limited liability company", "managing director", "member of the board", "persons authorised to take decisions", "president of the board", "sole signatory"],
}


def is_commercial_register(text: Column, language: Column) -> Column:
    """Whether a phrase of the language's registers occurs, in any case; of any language for an unknown one."""
    low = F.lower(text)
    any_of = lambda words: checks.has_any(low, words)
    out = F.when(F.coalesce(text, F.lit("")) == "", False)
    for code, words in REGISTER_PHRASES.items():
        out = out.when(language == code, any_of(words))
    return F.coalesce(out.otherwise(any_of([w for words in REGISTER_PHRASES.values() for w in words])), F.lit(False))
