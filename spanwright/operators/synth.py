"""Synthetic texts: templates filled with generated values, composed, with noise; spans stay aligned.

Everything is drawn from hashes of (seed, template, render, slot), so a build is the same anywhere. Values are
column expressions over a hash; the pools are small and our own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.checks import VAT_WEIGHTS
from spanwright.functions.spans import by_start_end, find_all, invalid_reason, let, locate_in_order
from spanwright.session import cut, spread

C = F.col
MARKER = r"\[\[PII:[a-z_]+(?:/[a-z_0-9]+)?\]\]"
SPANS = "array<struct<start:int,end:int,label:string>>"
NOISE = 15
#: E-mails of each language, and renders of each template of the other layers.
EMAILS = {"de_ch": 12_000, "en": 2_000, "fr_ch": 8_000, "it_ch": 6_000, "rm": 3_000}
VOLUMES = {"adversarial": 80, "common_word": 60, "docs": 250, "forms": 200, "multilang_docs": 1_400, "rm_secrets": 40, "short_form": 80}
#: Given names of men and women, surnames, streets or what French streets are called after, towns: pools by language.
POOLS = {
    "de_ch": (["Beat", "Reto", "Urs", "Jürg"], ["Anna", "Vreni", "Regula", "Käthi"], ["Keller", "Frei", "Hofer", "Egli", "Baumann", "Zürcher"], ["Bahnhofstrasse", "Dorfweg", "Lindenallee", "Mühlegasse"], ["8001 Zürich", "3011 Bern", "6003 Luzern"]),
    "fr_ch": (["Jean", "Luc", "Noé"], ["Chloé", "Aline", "Océane"], ["Favre", "Rochat", "Blanc"], ["Lausanne", "Yverdon", "Orbe", "Morges", "Aigle"], ["1003 Lausanne", "1204 Genève", "2000 Neuchâtel"]),
    "it_ch": (["Marco", "Elio"], ["Giulia", "Sofia"], ["Bernasconi", "Rossi", "Galli"], ["via Stazione", "via San Gottardo", "viale Franscini"], ["6900 Lugano", "6500 Bellinzona"]),
    "rm": (["Gian", "Flurin"], ["Ladina", "Seraina"], ["Caduff", "Camenisch"], ["via Principala", "via da Scola"], ["7130 Glion", "7500 San Murezzan"]),
    "en": (["Tom", "Harry"], ["Alice", "Grace"], ["Baker", "Hill", "Woods"], ["Station Road", "Mill Lane"], ["4051 Basel", "6300 Zug"]),
}
#: Surnames that are words; for the other languages the common ones do.
WORD_NAMES = {"de_ch": ["Frei", "Koch", "Vogel", "Lang", "Winter"], "fr_ch": ["Blanc", "Petit", "Roy", "Berger"], "it_ch": ["Forte", "Bianchi", "Conte", "Sole"]}
#: Titles of men and of women, short and in full.
TITLES = {
    "de_ch": ((["Hr.", "Ing.", "Dr."], ["Herr", "Professor"]), (["Fr.", "Dr. med.", "Dr."], ["Frau", "Professorin"])),
    "fr_ch": ((["M.", "Me"], ["Monsieur", "Docteur"]), (["Mme", "Me"], ["Madame", "Docteure"])),
    "it_ch": ((["Sig.", "Avv."], ["Signor", "Dottor"]), (["Sig.ra", "Avv."], ["Signora", "Dottoressa"])),
    "rm": ((["Sgnr.", "Dr."], ["Signur"]), (["Sgnra.", "Dr."], ["Signura"])),
    "en": ((["Mr.", "Hon."], ["Mr", "Doctor"]), (["Ms.", "Mrs."], ["Ms", "Doctor"])),
}
STYLES = ["first_last", "last_first", "last_first_upper", "first_initial", "title_last", "title_first_last", "title_initial_last", "last_only", "first_only"]
CANTONS = ["AG", "BE", "BS", "GE", "GR", "LU", "SG", "TI", "VD", "VS", "ZH"]


def seed_of(seed: int, *parts: Column) -> Column:
    """A non-negative hash below 2^62."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 62))


def sub(h: Column, n: int) -> Column:
    """The n-th further hash of one."""
    return F.pmod(F.xxhash64(h, F.lit(n)), F.lit(1 << 62))


def pick(h: Column, values: list[str]) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(h, F.lit(len(values))).cast("int"))


def by_language(language: Column, make: Callable[[str], Column], default: str = "en") -> Column:
    """make(code) of the row's language; that of the default for others."""
    out = reduce(lambda w, code: w.when(language == code, make(code)), [c for c in POOLS if c != default], F.when(F.lit(False), make(default)))
    return out.otherwise(make(default))


_WORD64, _DASH64, _BASE64 = "AZ", "-_", "+/"  # the last two of 64 signs
_UPPER32, _HEX = "upper", "hex"


def drawn(h: Column, n: int, alphabet: str) -> Column:
    """n signs drawn by a digest of h, in one compiled call or two: letters and digits and two more signs (85 at most), capitals and 2 to 7, or hexadecimal digits (128 at most)."""
    if alphabet == _UPPER32:
        halves = [F.lpad(F.conv(F.pmod(sub(h, 50 + i), F.lit(1 << 40)).cast("string"), 10, 32), 8, "0") for i in range(-(-n // 8))]
        return F.translate(F.substring(F.concat(*halves), 1, n), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digest = F.sha2(sub(h, 50).cast("string"), 512)
    return F.substring(digest, 1, n) if alphabet == _HEX else F.substring(F.translate(F.base64(F.unhex(digest)), "+/\r\n", alphabet), 1, n)


def pad(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def number(h: Column, n: int) -> Column:
    """n decimal digits."""
    return pad(F.pmod(h, F.lit(10**n)), n)


def _weighted(digits: Column, weights: list[int]) -> Column:
    return sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights[1:], 1)), F.substring(digits, 1, 1).cast("int") * weights[0])


def iban(h: Column) -> Column:
    def whole(bban: Column) -> Column:
        check = 98 - F.concat(bban, F.lit("121700")).cast("decimal(38,0)") % 97
        return F.concat(F.lit("CH"), pad(check.cast("int"), 2), bban)

    return let(F.concat(F.lit("00762"), number(h, 12)), whole)


def ahv(h: Column) -> Column:
    def whole(body: Column) -> Column:
        check = F.pmod(10 - _weighted(body, [1, 3] * 6) % 10, F.lit(10))
        d = F.concat(body, check.cast("string"))
        return F.concat_ws(".", F.substring(d, 1, 3), F.substring(d, 4, 4), F.substring(d, 8, 4), F.substring(d, 12, 2))

    return let(F.concat(F.lit("756"), number(h, 9)), whole)


def vat(h: Column) -> Column:
    """The first of two numbers whose check digit isn't ten: adding one to the last of the eight changes the sum by four."""
    weights = VAT_WEIGHTS

    def whole(body: Column) -> Column:
        check = F.pmod(11 - _weighted(body, weights) % 11, F.lit(11))
        return let(
            F.struct(body.alias("b"), check.alias("c")),
            lambda x: let(
                F.when(x["c"] == 10, F.concat(F.substring(x["b"], 1, 7), F.pmod(F.substring(x["b"], 8, 1).cast("int") + 1, F.lit(10)).cast("string"))).otherwise(x["b"]),
                lambda b: F.concat(F.lit("CHE-"), F.substring(b, 1, 3), F.lit("."), F.substring(b, 4, 3), F.lit("."), F.substring(b, 7, 2), F.pmod(11 - _weighted(b, weights) % 11, F.lit(11)).cast("string")),
            ),
        )

    return let(F.concat(F.lit("1"), number(h, 7)), whole)


def card(h: Column) -> Column:
    def whole(body: Column) -> Column:
        twice = lambda i: F.when(F.substring(body, i, 1).cast("int") > 4, F.substring(body, i, 1).cast("int") * 2 - 9).otherwise(F.substring(body, i, 1).cast("int") * 2)
        total = sum((twice(i) if i % 2 else F.substring(body, i, 1).cast("int") for i in range(2, 16)), twice(1))
        d = F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))
        return F.concat_ws(" ", *(F.substring(d, i, 4) for i in (1, 5, 9, 13)))

    return let(F.concat(F.lit("4"), number(h, 14)), whole)


_MONTHS = {
    "de_ch": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr_ch": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "it_ch": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split(),
    "rm": "schaner favrer mars avrigl matg zercladur fanadur avust settember october november december".split(),
    "en": "January February March April May June July August September October November December".split(),
}


def date(h: Column, language: Column) -> Column:
    """Seven spellings, 28 : 16 : 6 : 8 : 28 : 8 : 6 of a hundred; days to 28, years 1965 to 2027."""
    day, month, year = F.pmod(sub(h, 1), F.lit(28)) + 1, F.pmod(sub(h, 2), F.lit(12)) + 1, (F.pmod(sub(h, 3), F.lit(63)) + 1965).cast("string")
    name = F.when(F.lit(False), "")
    for code, months in _MONTHS.items():
        name = name.when(language == code, F.get(F.array(*(F.lit(m) for m in months)), (month - 1).cast("int")))
    name = name.otherwise(pad(month, 2))
    spoken = F.when(language == "de_ch", F.concat(day.cast("string"), F.lit(". "), name)).when((language == "fr_ch") & (day == 1), F.concat(F.lit("1er "), name)).when(language == "rm", F.concat(day.cast("string"), F.lit(" da "), name)).otherwise(F.concat_ws(" ", day.cast("string"), name))
    d, m = day.cast("string"), month.cast("string")
    r = F.pmod(h, F.lit(100))
    return (
        F.when(r < 28, F.concat_ws(".", pad(day, 2), pad(month, 2), year)).when(r < 44, F.concat_ws(".", d, m, year)).when(r < 50, F.concat_ws("/", d, m, year))
        .when(r < 58, F.concat_ws("-", year, pad(month, 2), pad(day, 2))).when(r < 86, F.concat_ws(" ", spoken, year)).when(r < 94, spoken).otherwise(F.concat_ws(".", pad(day, 2), pad(month, 2), F.substring(year, 3, 2)))
    )


def phone(h: Column) -> Column:
    """Seven spellings of a Swiss number."""
    area, a, b, c = pick(sub(h, 1), ["44", "31", "22", "91", "79", "76"]), number(sub(h, 2), 3), number(sub(h, 3), 2), number(sub(h, 4), 2)
    return F.get(
        F.array(
            F.concat_ws(" ", F.lit("+41"), area, a, b, c), F.concat_ws(" ", F.concat(F.lit("0"), area), a, b, c), F.concat_ws(" ", F.lit("0041"), area, a, b, c), F.concat(F.lit("0"), area, a, b, c),
            F.concat(F.lit("+41"), area, a, b, c), F.concat_ws(" ", F.lit("+41 (0)"), F.concat_ws(" ", area, a, b, c)), F.concat(F.lit("0"), F.concat_ws("/", area, F.concat_ws(".", a, b, c))),
        ),
        F.pmod(h, F.lit(7)).cast("int"),
    )


def title(h: Column, language: Column, female: Column, full: Column) -> Column:
    """An honorific by gender, short or in full."""
    def of(code: str) -> Column:
        (m_short, m_full), (f_short, f_full) = TITLES[code]
        return F.when(female, F.when(full, pick(h, f_full)).otherwise(pick(h, f_short))).otherwise(F.when(full, pick(h, m_full)).otherwise(pick(h, m_short)))

    return by_language(language, of)


def given_name(h: Column, language: Column, female: Column) -> Column:
    return by_language(language, lambda code: F.when(female, pick(sub(h, 1), POOLS[code][1])).otherwise(pick(sub(h, 1), POOLS[code][0])))


def surname(h: Column, language: Column, common_word: Column | None = None) -> Column:
    """A surname; where common_word, one that is a word of the language, if there are such."""
    plain = lambda code: pick(sub(h, 2), POOLS[code][2])
    return by_language(language, lambda code: plain(code) if common_word is None or code not in WORD_NAMES else F.when(common_word, pick(sub(h, 2), WORD_NAMES[code])).otherwise(plain(code)))


def name(h: Column, language: Column, style: Column | None = None, female: Column | None = None) -> Column:
    """A name in one of nine styles, titles by gender; `common_word` is a surname that is a word. Style and gender are drawn where they are null."""
    female = F.pmod(sub(h, 5), F.lit(2)) == 0 if female is None else female
    style = F.lit(None).cast("string") if style is None else style
    asked = F.when(style.isin(*STYLES), style).otherwise(pick(sub(h, 6), STYLES))
    first, last = given_name(h, language, female), surname(h, language, style == "common_word")
    initial = F.concat(F.substring(first, 1, 1), F.lit("."))
    honorific = title(sub(h, 7), language, female, F.pmod(sub(h, 8), F.lit(2)) == 0)
    short = title(sub(h, 7), language, female, F.lit(False))
    return (
        F.when(style == "common_word", last).when(asked == "last_first", F.concat_ws(", ", last, first)).when(asked == "last_first_upper", F.concat_ws(", ", F.upper(last), first)).when(asked == "first_initial", F.concat_ws(" ", initial, last))
        .when(asked == "title_last", F.concat_ws(" ", honorific, last)).when(asked == "title_first_last", F.concat_ws(" ", honorific, first, last)).when(asked == "title_initial_last", F.concat_ws(" ", short, initial, last))
        .when(asked == "last_only", last).when(asked == "first_only", first).otherwise(F.concat_ws(" ", first, last))
    )


def address(h: Column, language: Column, fmt: Column | None = None) -> Column:
    """Whole, with its canton, the street alone, or the town first: 60 : 15 : 15 : 10. French streets are called after places, with elision; 8 in a hundred
    house numbers have a letter, 5 in a hundred addresses are a box."""
    r = F.pmod(sub(h, 9), F.lit(100))
    fmt = F.lit(None).cast("string") if fmt is None else fmt
    asked = F.coalesce(fmt, F.when(r < 60, "full").when(r < 75, "with_canton").when(r < 90, "street_only").otherwise("city_first"))
    house = F.concat((F.pmod(sub(h, 3), F.lit(120)) + 1).cast("string"), F.when(F.pmod(sub(h, 4), F.lit(100)) < 8, pick(sub(h, 10), ["a", "b", "c"])).otherwise(""))
    box = {"de_ch": "Postfach", "fr_ch": "Case postale", "it_ch": "Casella postale", "rm": "Chascha postala", "en": "P.O. Box"}

    def street(code: str) -> Column:
        own = pick(sub(h, 1), POOLS[code][3])
        line = F.concat_ws(" ", own, house)
        if code == "fr_ch":
            line = F.concat_ws(", ", F.concat(pick(sub(h, 11), ["rue", "avenue", "chemin"]), F.when(own.rlike("^[AEIOUYÉÈH]"), " d'").otherwise(" de "), own), house)
        return F.when(F.pmod(h, F.lit(100)) < 5, F.concat_ws(" ", F.lit(box[code]), house)).otherwise(line)

    line, town = by_language(language, street), by_language(language, lambda code: pick(sub(h, 2), POOLS[code][4]))
    return (
        F.when(asked == "street_only", line).when(asked == "city_first", F.concat_ws(", ", town, line)).when(asked == "with_canton", F.concat(line, F.lit(", "), town, F.lit(" "), pick(sub(h, 12), CANTONS)))
        .otherwise(F.concat_ws(", ", line, town))
    )


def _ascii(value: Column) -> Column:
    spelled = reduce(lambda v, x: F.replace(v, F.lit(x[0]), F.lit(x[1])), {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.items(), F.lower(value))
    return F.replace(spelled, F.lit(" "), F.lit(""))


def email(h: Column, language: Column, female: Column | None = None) -> Column:
    """Nine patterns of local parts; umlauts are spelled out."""
    female = F.pmod(sub(h, 5), F.lit(2)) == 0 if female is None else female
    first, last = _ascii(given_name(h, language, female)), _ascii(surname(h, language))
    a, z = F.substring(first, 1, 1), F.substring(last, 1, 1)
    tag, year = pick(sub(h, 9), ["info", "kontakt", "billing", "service"]), (F.pmod(sub(h, 10), F.lit(30)) + 70).cast("string")
    dotted = F.concat_ws(".", first, last)
    local = [dotted, F.concat_ws("_", first, last), F.concat_ws("-", first, last), F.concat_ws(".", a, last), F.concat(first, z), F.concat_ws("+", dotted, tag), F.concat_ws(".", last, first), first, F.concat(dotted, year)]
    return F.concat(F.get(F.array(*local), F.pmod(sub(h, 11), F.lit(len(local))).cast("int")), F.lit("@"), pick(sub(h, 8), ["post.example.ch", "firma.example.ch", "mail.example.org"]))


def url(h: Column) -> Column:
    """A bare domain, its root, with a path, with path and query: 20 : 25 : 35 : 20."""
    domain, path, asked = pick(sub(h, 1), ["amt.example.ch", "shop.example.ch", "verein.example.org"]), pick(sub(h, 2), ["", "/", "/info", "/login", "/p/42"]), pick(sub(h, 3), ["", "?lang=de", "?id=42"])
    r = F.pmod(h, F.lit(100))
    return F.when(r < 20, domain).when(r < 45, F.concat(F.lit("https://"), domain)).when(r < 80, F.concat(F.lit("https://"), domain, path)).otherwise(F.concat(F.lit("https://"), domain, path, asked))


def _secrets(h: Column) -> dict[str, Column]:
    long_number = lambda n: F.concat((F.pmod(sub(h, 20 + n), F.lit(9)) + 1).cast("string"), number(sub(h, 30 + n), 11))
    chat = lambda mark: F.concat(F.lit(mark), long_number(1), F.lit("-"), long_number(2), F.lit("-"), drawn(h, 24, _WORD64))
    return {
        "project_key": F.concat(F.lit("sk-proj-"), drawn(h, 43, _DASH64)), "classic_key": F.concat(F.lit("sk-"), drawn(h, 48, _WORD64)), "long_token": F.concat(F.lit("github_pat_"), drawn(h, 82, _WORD64)),
        "classic_token": F.concat(F.lit("ghp_"), drawn(h, 36, _WORD64)), "chat_bot": chat("xoxb-"), "chat_user": chat("xoxp-"), "access_id": F.concat(F.lit("AKIA"), drawn(h, 16, _UPPER32)), "map_key": F.concat(F.lit("AIza"), drawn(h, 35, _DASH64)),
        "live_payment": F.concat(F.lit("sk_live_"), drawn(h, 48, _WORD64)), "test_payment": F.concat(F.lit("sk_test_"), drawn(h, 48, _WORD64)), "jwt": F.concat(drawn(h, 32, _DASH64), F.lit("."), drawn(sub(h, 40), 64, _DASH64), F.lit("."), drawn(sub(h, 41), 43, _DASH64)),
        "hex64": drawn(h, 64, _HEX), "base64_token": drawn(h, 40, _BASE64),
    }


#: What templates' secrets are: five kinds at random; others by name.
_USUAL = ["project_key", "classic_token", "chat_bot", "access_id", "jwt"]
SECRET_KINDS = ["project_key", "classic_key", "long_token", "classic_token", "chat_bot", "chat_user", "access_id", "map_key", "live_payment", "test_payment", "jwt", "hex64", "base64_token"]


def secret(h: Column, kind: Column | None = None, among: list[str] | None = None) -> Column:
    """A key or token of a named kind (also password, payment_live, payment_test, vendor_key), else of one drawn from `among`."""
    kinds = _secrets(h)
    among = among or _USUAL
    chosen = pick(sub(h, 13), among)
    if kind is not None:
        chosen = F.coalesce(F.when(kind.isin(*kinds, "password", "payment_live", "payment_test", "vendor_key"), kind), chosen)
        kinds |= {
            "password": drawn(h, 24, _BASE64), "payment_live": F.concat(F.lit("sk_live_"), drawn(h, 24, _WORD64)), "payment_test": F.concat(F.lit("sk_test_"), drawn(h, 24, _WORD64)), "vendor_key": F.concat(F.lit("sk-ven-api03-"), drawn(h, 80, _DASH64)),
        }
    else:
        kinds = {k: v for k, v in kinds.items() if k in among}
    names = list(kinds)
    return reduce(lambda w, k: w.when(chosen == k, kinds[k]), names[1:], F.when(chosen == names[0], kinds[names[0]]))


def value(label: Column, fmt: Column, h: Column, language: Column, female: Column | None = None) -> Column:
    """The value of a slot; formats name an account's kind, a name's style, an address' form, a secret's kind."""
    account = F.when(fmt == "ahv", ahv(h)).when(fmt == "vat", vat(h)).when(fmt == "card", card(h)).otherwise(iban(h))
    return (
        F.when(label == "private_person", name(h, language, fmt, female)).when(label == "private_email", email(h, language, female)).when(label == "private_phone", phone(h)).when(label == "private_date", date(h, language))
        .when(label == "private_address", address(h, language, fmt)).when(label == "private_url", url(h)).when(label == "account_number", account).when(label == "secret", secret(h, fmt))
    )


def fill(text: Column, values: Callable[[Column, Column, Column], Column]) -> Column:
    """struct(text, spans): markers replaced by values(label, format, slot), each value a span."""
    return let(slots_of(text), lambda slots: join_slots(F.transform(slots, lambda s: F.struct(s["gap"].alias("gap"), F.when(s["label"].isNotNull(), values(s["label"], s["fmt"], s["n"])).alias("value"), s["label"].alias("label")))))


def slots_of(text: Column) -> Column:
    """The text as array of struct(n, gap, label, fmt): each marker with the text before it, and last the text after them, without a label."""
    def parts(hits: Column) -> Column:
        before = lambda i: F.coalesce(F.get(hits, i - 1)["end"], F.lit(0))
        inner = lambda h: F.regexp_extract(h["text"], r"^\[\[PII:(.*)\]\]$", 1)
        slot = lambda h, i: F.struct(i.alias("n"), F.substring(text, before(i) + 1, h["start"] - before(i)).alias("gap"), F.substring_index(inner(h), "/", 1).alias("label"), F.when(inner(h).contains("/"), F.substring_index(inner(h), "/", -1)).alias("fmt"))
        last = F.struct(F.size(hits).alias("n"), F.substring(text, before(F.size(hits)) + 1, F.length(text)).alias("gap"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("fmt"))
        return F.concat(F.transform(hits, slot), F.array(last))

    return let(find_all(text, MARKER), parts)


def join_slots(slots: Column) -> Column:
    """struct(text, spans) of slots (gap, value, label) in order."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["gap"])
        end = start + F.coalesce(F.length(s["value"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(s["label"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), s["label"].alias("label"))))).alias("spans"))

    text = F.array_join(F.transform(slots, lambda s: F.concat(s["gap"], F.coalesce(s["value"], F.lit("")))), "")
    return F.struct(text.alias("text"), F.aggregate(slots, begin, step, lambda acc: acc["spans"]).alias("spans"))


def once(made: Column) -> Column:
    """A generator of the one value, which later expressions can't inline and so compute again and again."""
    return F.explode(F.array(made))


def render(templates: DataFrame, renders: int | Column, seed: int) -> DataFrame:
    """template_id, language, render, text, spans: each template `renders` times. templates: template_id (unique), language, text.

    A row per render goes to Arrow, where markers are found, values made and texts put together (operators.slots), without a shuffle. The names and titles
    of a render are of one gender.
    """
    from spanwright.operators import slots

    count = F.lit(renders) if isinstance(renders, int) else renders
    rows = spread(templates).select("template_id", "language", "text", count.alias("renders")).where("renders > 0").select("template_id", "language", "text", F.explode(F.sequence(F.lit(0), (C("renders") - 1).cast("int"))).alias("render"))
    h = F.xxhash64(F.lit(seed), C("template_id"), C("render"))
    female = F.pmod(seed_of(seed, C("template_id"), C("render"), F.lit("gender")), F.lit(2)) == 0
    kinds = dict(templates.dtypes)
    return rows.select("template_id", "language", "render", "text", h.alias("h"), female.alias("female")).mapInArrow(slots.rendered, f"template_id {kinds['template_id']}, language string, render int, text string, spans {SPANS}")


def compose(parts: Column, glue: str = "\n\n") -> Column:
    """struct(text, spans) of parts (array of struct(text, spans)) one after another; spans move along."""
    begin = F.struct(F.lit(None).cast("string").alias("text"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        shift = F.coalesce(F.length(acc["text"]) + len(glue), F.lit(0))
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + shift).cast("int").alias("start"), (s["end"] + shift).cast("int").alias("end"), s["label"].alias("label")))
        return F.struct(F.concat_ws(glue, acc["text"], p["text"]).alias("text"), F.concat(acc["spans"], moved).alias("spans"))

    return F.aggregate(parts, begin, step)


_ENTITIES = {"ä": "auml", "ö": "ouml", "ü": "uuml", "Ä": "Auml", "Ö": "Ouml", "Ü": "Uuml", "ß": "szlig", "é": "eacute", "è": "egrave", "à": "agrave", "ç": "ccedil"}
_LOOKALIKES = {"B": "8", "G": "6", "I": "l", "S": "5", "Z": "2", "a": "@", "e": "c", "l": "1", "o": "0"}
NOISE_KINDS = ["broken_caps", "html_entity", "markdown", "nbsp", "no_space", "ocr_swap", "stray_punct"]


def noise(text: Column, spans: Column, h: Column, share: int = NOISE) -> Column:
    """struct(text, spans, kind): in `share` of a hundred texts one kind of noise. Of what lies outside the spans: two in five blanks become no-break
    blanks; one letter in twenty, one at least, changes its case; one blank goes; one umlaut or accent becomes an entity; a sign comes before one blank; one
    letter becomes a look-alike; or marks go around one span. The spans' surfaces never change.

    Each kind is a list of edits (place, characters that go, what comes); spans move by the edits before them.
    """
    from spanwright.operators.slots import noisy

    return noisy(text, spans, h, F.lit(share).cast("long"))


def with_noise(rows: DataFrame, seed: int, share: int = NOISE) -> DataFrame:
    """Rendered rows with noise in a share of them; `noise` names its kind."""
    made = rows.withColumn("__x", once(noise(C("text"), C("spans"), seed_of(seed, F.lit("noise"), C("template_id"), C("render")), share)))
    return made.withColumns({"text": C("__x.text"), "spans": C("__x.spans"), "noise": C("__x.kind")}).drop("__x")


# -- layers


def compose_emails(fragments: DataFrame, emails: DataFrame, seed: int) -> DataFrame:
    """template_id, language, text: e-mail templates of a greeting, one body or in a fifth of them two, and a signature, a blank line between.

    fragments: fragment_id, language, part (greeting, body, signature), text; emails: language, n. A template set is small beside what is made of
    it; its texts meet the e-mails by language and number.
    """
    order = F.row_number().over(Window.partitionBy("language", "part").orderBy("fragment_id")) - 1
    numbered = fragments.withColumn("k", order.cast("long"))
    sizes = numbered.groupBy("language").pivot("part", ["greeting", "body", "signature"]).agg(F.count(F.lit(1))).where("greeting > 0 and body > 0 and signature > 0")
    asked = emails.where("n > 0").select("language", F.explode(F.sequence(F.lit(0), (C("n") - 1).cast("int"))).alias("nth")).join(sizes, "language")
    h = seed_of(seed, F.lit("email"), C("language"), C("nth"))
    drawn_rows = asked.withColumn("h", h).select(
        "language", "nth", F.pmod(sub(C("h"), 1), C("greeting")).alias("greeting_k"), F.pmod(sub(C("h"), 2), C("body")).alias("body_k"), F.pmod(sub(C("h"), 3), C("signature")).alias("signature_k"),
        F.when((F.pmod(sub(C("h"), 4), F.lit(100)) < 20) & (C("body") > 1), F.pmod(F.pmod(sub(C("h"), 2), C("body")) + 1 + F.pmod(sub(C("h"), 5), F.greatest(C("body") - 1, F.lit(1))), C("body"))).alias("second_k"),
    )
    out = drawn_rows
    for part, key, how in (("greeting", "greeting_k", "inner"), ("body", "body_k", "inner"), ("body", "second_k", "left"), ("signature", "signature_k", "inner")):
        own = numbered.where(C("part") == part).select(C("language").alias("__l"), C("k").alias("__k"), C("fragment_id").alias(f"{key}_id"), C("text").alias(f"{key}_text"))
        out = out.join(own, (C("language") == C("__l")) & (C(key) == C("__k")), how).drop("__l", "__k")
    text = F.concat_ws("\n\n", "greeting_k_text", "body_k_text", "second_k_text", "signature_k_text")
    ids = F.concat(F.concat_ws("+", "greeting_k_id", "body_k_id", "signature_k_id"), F.lit("#"), C("nth").cast("string"))
    return out.select(ids.alias("template_id"), "language", text.alias("text"))


def literal_layer(templates: DataFrame, renders: int) -> DataFrame:
    """template_id, language, render, text, spans of templates (…, values: array of struct(value, label)) whose spans are literal: common words as names, and,
    without any values, the same words as words. A value that isn't in its text, in order, is an error."""
    found = locate_in_order(C("text"), F.transform("values", lambda v: v["value"]))
    checked = F.when(found.isNotNull(), found).otherwise(F.from_json(F.raise_error(F.concat(F.lit("values are missing in "), C("template_id"))).cast("string"), "array<struct<start:int,end:int,value:string>>"))
    spans = F.zip_with(checked, F.col("values"), lambda f, v: F.struct(f["start"].alias("start"), f["end"].alias("end"), v["label"].alias("label")))
    rows = templates.withColumn("values", F.filter(F.coalesce("values", F.array().cast("array<struct<value:string,label:string>>")), lambda v: v["value"] != ""))
    return rows.withColumn("spans", spans).select("template_id", "language", F.explode(F.sequence(F.lit(0), F.lit(renders - 1))).alias("render"), "text", "spans")


def layers(templates: DataFrame, seed: int, scale: float = 1.0) -> DataFrame:
    """id, template_id, language, source, text, spans, noise: all synthetic layers in their volumes. templates: template_id, language, layer, part, text, values.

    scale multiplies the volumes, which are per language for e-mails and per template for the other layers.
    """
    times = lambda n: max(1, round(n * scale))
    emails = templates.sparkSession.createDataFrame([(k, times(n)) for k, n in EMAILS.items()], "language string, n int")
    parts = [render(compose_emails(templates.where("layer = 'emails'").withColumnRenamed("template_id", "fragment_id"), emails, seed), 1, seed).withColumn("layer", F.lit("emails"))]
    for layer, n in VOLUMES.items():
        own = templates.where(C("layer") == layer)
        made = literal_layer(own, times(n)) if layer in ("common_word", "adversarial") else render(own, times(n), seed)
        parts.append(made.withColumn("layer", F.lit(layer)))
    whole = with_noise(reduce(DataFrame.unionByName, parts), seed)
    source = F.concat(F.lit("synthetic_"), C("layer"))
    return whole.select(F.concat_ws("__", source, "template_id", "render").alias("id"), "template_id", "language", source.alias("source"), "text", "spans", "noise")


# -- texts that a model writes around given values

PAYLOADS = {"customer_record": ["private_person", "private_address", "private_email", "private_phone", "account_number"], "dev_chat": ["secret", "private_person", "private_email"], "incident_report": ["secret", "private_person", "private_phone", "private_email"]}


def payload(template: Column, language: Column, h: Column) -> Column:
    """array of struct(label, value): what a text of the template must hold; reports are in English, secrets of thirteen kinds."""
    out = None
    for name_, labels in PAYLOADS.items():
        tongue = F.lit("en") if name_ == "incident_report" else language
        make = {"secret": lambda g: secret(g, among=SECRET_KINDS), "private_person": lambda g: name(g, tongue, F.lit("first_last")), "private_email": lambda g: email(g, tongue), "private_phone": phone, "private_address": lambda g: address(g, tongue), "account_number": iban}  # noqa: B023
        made = F.array(*(F.struct(F.lit(x).alias("label"), make[x](sub(h, 90 + i)).alias("value")) for i, x in enumerate(labels)))
        out = F.when(template == name_, made) if out is None else out.when(template == name_, made)
    return out


_WRITTEN = "template string, language string, attempt long, values array<struct<label:string,value:string>>, text string"


def slot_fill(targets: DataFrame, connect: Callable[[], Callable[[list[str], list[list[str]]], list[str]]], seed: int, rounds: int = 10) -> DataFrame:
    """id, template, language, text, spans: of each (template, language) as many texts as `target` says. targets: template, language, target.

    connect is called once per partition and gives a function from prompts' templates and values to texts. A text is kept if it has all values once, in any order, else its
    place is asked for again, with a new payload, in the next round; after `rounds` rounds what is still missing stays missing. What a round kept is written to the shared folder.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        for batch in batches:
            if len(batch):
                texts = call(batch["template"].tolist(), [[v["value"] for v in values] for values in batch["values"]])
                yield batch.assign(text=texts)[["template", "language", "attempt", "values", "text"]]

    keys, kept = ["template", "language"], None
    for turn in range(rounds):
        have = targets if kept is None else targets.join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("have")), keys, "left")
        missing = have.withColumn("missing", C("target") - (F.lit(0) if kept is None else F.coalesce("have", F.lit(0)))).where("missing > 0")
        if turn and missing.isEmpty():
            break
        asks = missing.select(*keys, F.explode(F.sequence(F.lit(1), C("missing").cast("int"))).alias("k"))
        asks = asks.where(C("template").isin(*PAYLOADS)).select(*keys, (F.lit(turn * 1_000_000_000_000) + C("k")).cast("long").alias("attempt"))
        seeded = asks.withColumn("h", once(seed_of(seed, C("template"), C("language"), C("attempt"))))
        drafts = seeded.withColumn("values", payload(C("template"), C("language"), C("h"))).drop("h")
        written = drafts.mapInPandas(write, _WRITTEN)
        placed = F.transform("values", lambda v: F.struct((F.position(v["value"], C("text")) - 1).cast("int").alias("start"), (F.position(v["value"], C("text")) - 1 + F.length(v["value"])).cast("int").alias("end"), v["label"].alias("label")))
        good = cut(written.where("text is not null").withColumn("spans", by_start_end(placed)).where(~F.exists("spans", lambda s: s["start"] < 0) & invalid_reason(C("text"), C("spans")).isNull()).select(*keys, "attempt", "text", "spans"))
        kept = good if kept is None else kept.unionByName(good)
    number_ = F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))
    return kept.withColumn("n", number_).select(F.concat_ws("#", F.lit("synthetic"), *keys, "n").alias("id"), *keys, "text", "spans")
