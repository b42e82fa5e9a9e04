"""Values of many slots at once and texts put together of them, over flat arrays: what synth's column functions give, without a row and a shuffle per slot.

As one expression the values were too large to be compiled."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.functions.checks import VAT_WEIGHTS
from spanwright.functions.kernels import coded, edges, pieces
from spanwright.operators import synth as S

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_U = np.uint64
_MARKER = re.compile(r"\[\[PII:([a-z_]+)(?:/([a-z_0-9]+))?\]\]")


# -- Spark's xxhash64


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _P2
    x = (x ^ (x >> _U(29))) * _P3
    return x ^ (x >> _U(32))


def hash_int(i: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """Of 32-bit numbers that aren't negative; unsigned."""
    i = np.asarray(i).astype(_U)
    return _mixed(_turned((seed + _P5 + _U(4)) ^ (i * _P1), 23) * _P2 + _P3)


def hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    return _mixed(_turned((seed + _P5 + _U(8)) ^ (_turned(x.astype(_U) * _P2, 31) * _P1), 27) * _P1 + _P4)


def below(x: np.ndarray, bits: int = 62) -> np.ndarray:
    return (x & _U((1 << bits) - 1)).astype(np.int64)


def sub(h: np.ndarray, n: int) -> np.ndarray:
    """synth.sub."""
    return below(hash_int(n, hash_long(h, np.full(1, 42, _U))))


# -- strings


def cat(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def text(x: np.ndarray) -> pa.Array:
    return pa.array(x).cast(pa.string())


def pad(x: np.ndarray, n: int) -> pa.Array:
    return pc.utf8_lpad(text(x), n, "0")


def number(h: np.ndarray, n: int) -> pa.Array:
    return pad(h % 10**n, n)


def pick(h: np.ndarray, values: list[str]) -> pa.Array:
    return pa.array(values).take(pa.array(h % len(values)))


def pooled(h: np.ndarray, which: np.ndarray, pools: list[list[str]]) -> pa.Array:
    """One of the pool that `which` numbers."""
    size = np.array([len(p) for p in pools])
    return pa.array([v for p in pools for v in p]).take(pa.array((np.cumsum(size) - size)[which] + h % size[which]))


def part(x: pa.Array, start: int, stop: int | None = None) -> pa.Array:
    return pc.utf8_slice_codeunits(x, start, stop)


def chosen(which: np.ndarray, make: list[Callable[[np.ndarray], pa.Array]]) -> pa.Array:
    """make[k](rows) for the rows where which is k; null where it is no place in make."""
    rows = [np.flatnonzero(which == k) for k in range(len(make))]
    rest = np.flatnonzero((which < 0) | (which >= len(make)))
    made = [f(r) if len(r) else pa.array([], pa.string()) for f, r in zip(make, rows)]
    back = np.empty(len(which), np.int64)
    back[np.concatenate([*rows, rest])] = np.arange(len(which))
    return pa.concat_arrays([*(x.cast(pa.string()) for x in made), pa.nulls(len(rest), pa.string())]).take(pa.array(back))


# -- values

LANGUAGES = list(S.POOLS)
_EN = LANGUAGES.index("en")


def _digits(x: np.ndarray, weights: list[int]) -> np.ndarray:
    n = len(weights)
    return sum((x // 10 ** (n - 1 - i) % 10 * w for i, w in enumerate(weights)), np.zeros(len(x), np.int64))


def iban(h: np.ndarray) -> pa.Array:
    x = h % 10**12
    check = 98 - ((762 * 10**12 + x) % 97 * 10**6 + 121700) % 97
    return cat("CH", pad(check, 2), "00762", pad(x, 12))


def ahv(h: np.ndarray) -> pa.Array:
    x = h % 10**9
    check, d = (10 - _digits(756 * 10**9 + x, [1, 3] * 6) % 10) % 10, pad(x, 9)
    return cat("756.", part(d, 0, 4), ".", part(d, 4, 8), ".", part(d, 8), text(check))


def vat(h: np.ndarray) -> pa.Array:
    b = 10**7 + h % 10**7
    check = lambda x: (11 - _digits(x, VAT_WEIGHTS) % 11) % 11
    b = np.where(check(b) == 10, b - b % 10 + (b % 10 + 1) % 10, b)
    d = text(b)
    return cat("CHE-", part(d, 0, 3), ".", part(d, 3, 6), ".", part(d, 6), text(check(b)))


def card(h: np.ndarray) -> pa.Array:
    b, total = 4 * 10**14 + h % 10**14, np.zeros(len(h), np.int64)
    for i in range(15):
        d = b // 10 ** (14 - i) % 10
        total += d if i % 2 else np.where(d > 4, d * 2 - 9, d * 2)
    d = text(b * 10 + (10 - total % 10) % 10)
    return cat(part(d, 0, 4), " ", part(d, 4, 8), " ", part(d, 8, 12), " ", part(d, 12))


def date(h: np.ndarray, language: np.ndarray) -> pa.Array:
    day, month, year = sub(h, 1) % 28 + 1, sub(h, 2) % 12 + 1, sub(h, 3) % 63 + 1965
    months = [*(S._MONTHS[c] for c in LANGUAGES), [f"{m:02}" for m in range(1, 13)]]
    r = h % 100
    at = lambda k, c: np.flatnonzero(language[k] == LANGUAGES.index(c))

    def spoken(k: np.ndarray) -> pa.Array:
        glue, first = np.full(len(k), " ", object), day[k].astype(str).astype(object)
        glue[at(k, "de_ch")], glue[at(k, "rm")] = ". ", " da "
        first[np.flatnonzero((language[k] == LANGUAGES.index("fr_ch")) & (day[k] == 1))] = "1er"
        return cat(pa.array(first, pa.string()), pa.array(glue, pa.string()), pooled(month[k] - 1, language[k], months))

    kind = np.searchsorted([28, 44, 50, 58, 86, 94], r, side="right")
    return chosen(kind, [
        lambda k: cat(pad(day[k], 2), ".", pad(month[k], 2), ".", text(year[k])), lambda k: cat(text(day[k]), ".", text(month[k]), ".", text(year[k])),
        lambda k: cat(text(day[k]), "/", text(month[k]), "/", text(year[k])), lambda k: cat(text(year[k]), "-", pad(month[k], 2), "-", pad(day[k], 2)),
        lambda k: cat(spoken(k), " ", text(year[k])), spoken, lambda k: cat(pad(day[k], 2), ".", pad(month[k], 2), ".", pad(year[k] % 100, 2)),
    ])


def phone(h: np.ndarray) -> pa.Array:
    area, a, b, c = pick(sub(h, 1), ["44", "31", "22", "91", "79", "76"]), number(sub(h, 2), 3), number(sub(h, 3), 2), number(sub(h, 4), 2)
    four = pa.array(["+41 ", "0", "0041 ", "0", "+41", "+41 (0) ", "0"]).take(pa.array(h % 7))
    one = pa.array([" ", " ", " ", "", "", " ", "/"]).take(pa.array(h % 7))
    two = pa.array([" ", " ", " ", "", "", " ", "."]).take(pa.array(h % 7))
    return cat(four, area, one, a, two, b, two, c)


_GIVEN = [S.POOLS[c][g] for c in LANGUAGES for g in (0, 1)]
_LAST = [*(S.POOLS[c][2] for c in LANGUAGES), *(S.WORD_NAMES.get(c, S.POOLS[c][2]) for c in LANGUAGES)]
_TITLES = [S.TITLES[c][g][full] for c in LANGUAGES for g in (0, 1) for full in (0, 1)]


def name(h: np.ndarray, language: np.ndarray, style: np.ndarray, female: np.ndarray) -> pa.Array:
    """style: a place in STYLES, len(STYLES) for common_word, -1 for any."""
    lang = np.where(language >= len(LANGUAGES), _EN, language)
    common, h1, h2, h7 = style == len(S.STYLES), sub(h, 1), sub(h, 2), sub(h, 7)
    asked = np.where(common, 7, np.where(style >= 0, style, sub(h, 6) % len(S.STYLES)))  # 7: the surname alone
    who = 2 * lang + female
    full = sub(h, 8) % 2 == 0
    first = lambda k: pooled(h1[k], who[k], _GIVEN)
    last = lambda k: pooled(h2[k], (lang + len(LANGUAGES) * common)[k], _LAST)
    title = lambda k, whole: pooled(h7[k], 2 * who[k] + whole, _TITLES)
    initial = lambda k: cat(part(first(k), 0, 1), ".")
    return chosen(asked, [
        lambda k: cat(first(k), " ", last(k)), lambda k: cat(last(k), ", ", first(k)), lambda k: cat(pc.utf8_upper(last(k)), ", ", first(k)), lambda k: cat(initial(k), " ", last(k)),
        lambda k: cat(title(k, full[k]), " ", last(k)), lambda k: cat(title(k, full[k]), " ", first(k), " ", last(k)), lambda k: cat(title(k, 0), " ", initial(k), " ", last(k)), last, first,
    ])


_FORMS = ["full", "with_canton", "street_only", "city_first"]
_BOXES = {"de_ch": "Postfach", "fr_ch": "Case postale", "it_ch": "Casella postale", "rm": "Chascha postala", "en": "P.O. Box"}
_STREETS = [[(" d'" if c == "fr_ch" and re.match("[AEIOUYÉÈH]", s) else " de " if c == "fr_ch" else "") + s for s in S.POOLS[c][3]] for c in LANGUAGES]


def address(h: np.ndarray, language: np.ndarray, form: np.ndarray) -> pa.Array:
    """form: a place in _FORMS, -1 for any."""
    lang = np.where(language >= len(LANGUAGES), _EN, language)
    asked = np.where(form >= 0, form, np.searchsorted([60, 75, 90], sub(h, 9) % 100, side="right"))
    letter = np.where(sub(h, 4) % 100 < 8, sub(h, 10) % 3, 3)
    house = cat(text(sub(h, 3) % 120 + 1), pick(letter, ["a", "b", "c", ""]))
    french, boxed = lang == LANGUAGES.index("fr_ch"), h % 100 < 5
    way = pick(np.where(french, sub(h, 11) % 3, 3), ["rue", "avenue", "chemin", ""])
    street = cat(way, pooled(sub(h, 1), lang, _STREETS), pick(french.astype(np.int64), [" ", ", "]), house)
    line = pc.if_else(pa.array(boxed), cat(pa.array([_BOXES[c] for c in LANGUAGES]).take(pa.array(lang)), " ", house), street)
    town = pooled(sub(h, 2), lang, [S.POOLS[c][4] for c in LANGUAGES])
    on = lambda x, k: x.take(pa.array(k))
    return chosen(asked, [
        lambda k: cat(on(line, k), ", ", on(town, k)), lambda k: cat(on(line, k), ", ", on(town, k), " ", pick(sub(h[k], 12), S.CANTONS)), lambda k: on(line, k), lambda k: cat(on(town, k), ", ", on(line, k)),
    ])


def _ascii(value: str) -> str:
    for a, b in {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", " ": ""}.items():
        value = value.lower().replace(a, b)
    return value


_GIVEN_ASCII, _LAST_ASCII = [[_ascii(v) for v in p] for p in _GIVEN], [[_ascii(v) for v in p] for p in _LAST]


def email(h: np.ndarray, language: np.ndarray, female: np.ndarray) -> pa.Array:
    lang = np.where(language >= len(LANGUAGES), _EN, language)
    first, last = pooled(sub(h, 1), 2 * lang + female, _GIVEN_ASCII), pooled(sub(h, 2), lang, _LAST_ASCII)
    on = lambda x, k: x.take(pa.array(k))
    both = lambda glue: lambda k: cat(on(first, k), glue, on(last, k))
    local = chosen(sub(h, 11) % 9, [
        both("."), both("_"), both("-"), lambda k: cat(part(on(first, k), 0, 1), ".", on(last, k)), lambda k: cat(on(first, k), part(on(last, k), 0, 1)),
        lambda k: cat(on(first, k), ".", on(last, k), "+", pick(sub(h[k], 9), ["info", "kontakt", "billing", "service"])), lambda k: cat(on(last, k), ".", on(first, k)), lambda k: on(first, k),
        lambda k: cat(on(first, k), ".", on(last, k), text(sub(h[k], 10) % 30 + 70)),
    ])
    return cat(local, "@", pick(sub(h, 8), ["post.example.ch", "firma.example.ch", "mail.example.org"]))


def url(h: np.ndarray) -> pa.Array:
    kind = np.searchsorted([20, 45, 80], h % 100, side="right")
    path = pick(np.where(kind >= 2, sub(h, 2) % 5, 0), ["", "/", "/info", "/login", "/p/42"])
    asked = pick(np.where(kind == 3, sub(h, 3) % 3, 0), ["", "?lang=de", "?id=42"])
    return cat(pick((kind > 0).astype(np.int64), ["", "https://"]), pick(sub(h, 1), ["amt.example.ch", "shop.example.ch", "verein.example.org"]), path, asked)


def drawn(h: np.ndarray, n: int, alphabet: str) -> pa.Array:
    if alphabet == S._UPPER32:
        halves = [(sub(h, 50 + i) & ((1 << 40) - 1)).tolist() for i in range(-(-n // 8))]
        return pa.array(["".join(base64.b32encode(x.to_bytes(5, "big")).decode() for x in some)[:n] for some in zip(*halves)], pa.string())
    digests = (hashlib.sha512(b"%d" % x) for x in sub(h, 50).tolist())
    if alphabet == S._HEX:
        return pa.array([d.hexdigest()[:n] for d in digests], pa.string())
    signs = b"".join([binascii.b2a_base64(d.digest(), newline=False) for d in digests]).translate(bytes.maketrans(b"+/", alphabet.encode()))
    own = np.ascontiguousarray(np.frombuffer(signs, np.uint8).reshape(len(h), 88)[:, :n])
    return pa.StringArray.from_buffers(len(h), pa.py_buffer(np.arange(len(h) + 1, dtype=np.int32) * n), pa.py_buffer(own))


def _long_number(h: np.ndarray, n: int) -> pa.Array:
    return cat(text(sub(h, 20 + n) % 9 + 1), number(sub(h, 30 + n), 11))


def _chat(mark: str) -> Callable[[np.ndarray], pa.Array]:
    return lambda h: cat(mark, _long_number(h, 1), "-", _long_number(h, 2), "-", drawn(h, 24, S._WORD64))


def _marked(mark: str, n: int, alphabet: str) -> Callable[[np.ndarray], pa.Array]:
    return lambda h: cat(mark, drawn(h, n, alphabet))


_SECRETS = {
    "project_key": _marked("sk-proj-", 43, S._DASH64), "classic_key": _marked("sk-", 48, S._WORD64), "long_token": _marked("github_pat_", 82, S._WORD64), "classic_token": _marked("ghp_", 36, S._WORD64),
    "chat_bot": _chat("xoxb-"), "chat_user": _chat("xoxp-"), "access_id": _marked("AKIA", 16, S._UPPER32), "map_key": _marked("AIza", 35, S._DASH64), "live_payment": _marked("sk_live_", 48, S._WORD64),
    "test_payment": _marked("sk_test_", 48, S._WORD64), "jwt": lambda h: cat(drawn(h, 32, S._DASH64), ".", drawn(sub(h, 40), 64, S._DASH64), ".", drawn(sub(h, 41), 43, S._DASH64)), "hex64": _marked("", 64, S._HEX),
    "base64_token": _marked("", 40, S._BASE64), "password": _marked("", 24, S._BASE64), "payment_live": _marked("sk_live_", 24, S._WORD64), "payment_test": _marked("sk_test_", 24, S._WORD64), "vendor_key": _marked("sk-ven-api03-", 80, S._DASH64),
}
_KINDS = list(_SECRETS)


def secret(h: np.ndarray, kind: np.ndarray) -> pa.Array:
    """kind: a place in _KINDS, -1 for a usual one."""
    usual = np.array([_KINDS.index(k) for k in S._USUAL])
    return chosen(np.where(kind >= 0, kind, usual[sub(h, 13) % len(usual)]), [lambda k, make=make: make(h[k]) for make in _SECRETS.values()])


_LABELS = ["private_person", "private_email", "private_phone", "private_date", "private_address", "private_url", "account_number", "secret"]


def values(label: pa.Array, fmt: pa.Array, h: np.ndarray, language: np.ndarray, female: np.ndarray) -> pa.Array:
    """synth.value of many slots; language: a place in LANGUAGES, their number for others."""
    code, names = coded(label)
    which = np.array([*(_LABELS.index(n) if n in _LABELS else -1 for n in names), -1])[code]
    code, names = coded(fmt)

    def place(known: list[str], other: int = -1) -> np.ndarray:
        return np.array([*(known.index(n) if n in known else other for n in names), -1])[code]

    style, form, kind, account = place([*S.STYLES, "common_word"]), place(_FORMS, 0), place(_KINDS), np.maximum(place(["iban", "ahv", "vat", "card"]), 0)
    accounts = [iban, ahv, vat, card]
    return chosen(which, [
        lambda k: name(h[k], language[k], style[k], female[k]), lambda k: email(h[k], language[k], female[k]), lambda k: phone(h[k]), lambda k: date(h[k], language[k]), lambda k: address(h[k], language[k], form[k]), lambda k: url(h[k]),
        lambda k: chosen(account[k], [lambda j, make=make: make(h[k][j]) for make in accounts]), lambda k: secret(h[k], kind[k]),
    ])


# -- texts


def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """template_id, language, render, text, spans of template_id, language, render, text, h (the hash of seed, template and render), female."""
    for batch in pieces(batches, "text", 1 << 20):
        gaps, labels, formats, count, last, parts = [], [], [], [], None, [""]
        for t in batch.column("text").to_pylist():
            if t is not last and t != last:
                last, parts = t, _MARKER.split(t or "")
            gaps += parts[0::3]
            labels += parts[1::3]
            labels.append(None)
            formats += parts[2::3]
            formats.append(None)
            count.append(len(parts) // 3 + 1)
        count = np.array(count)
        to = np.cumsum(count)
        row, begin = np.repeat(np.arange(len(count)), count), to - count
        n = np.arange(to[-1]) - begin[row]
        code, names = coded(batch.column("language"))
        language = np.array([*(LANGUAGES.index(x) if x in LANGUAGES else len(LANGUAGES) for x in names), len(LANGUAGES)])[code][row]
        h = below(hash_int(n, batch.column("h").to_numpy().view(_U)[row]))
        label, gap = pa.array(labels, pa.string()), pa.array(gaps, pa.string())
        value = values(label, pa.array(formats, pa.string()), h, language, batch.column("female").to_numpy(zero_copy_only=False)[row]).fill_null("")
        whole = cat(gap, value)
        at = np.frombuffer(whole.buffers()[1], np.int32)
        texts = pa.StringArray.from_buffers(len(count), pa.py_buffer(at[np.concatenate([[0], to])]), whole.buffers()[2])
        size = pc.utf8_length(value).to_numpy()
        end = np.cumsum(pc.utf8_length(gap).to_numpy() + size)
        end = end - np.concatenate([[0], end])[begin][row]
        real = np.flatnonzero(label.is_valid().to_numpy(zero_copy_only=False))
        int32 = lambda x: pa.array(x.astype(np.int32))
        one = pa.StructArray.from_arrays([int32((end - size)[real]), int32(end[real]), label.take(pa.array(real))], ["start", "end", "label"])
        spans = pa.ListArray.from_arrays(int32(np.concatenate([[0], np.cumsum(count - 1)])), one)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("template_id", "language", "render")), texts, spans], names=["template_id", "language", "render", "text", "spans"])


# -- noise

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))
_MARKUP = {k: f"&{v};" for k, v in S._ENTITIES.items()}
Edit = tuple[int, int, str]


def _flipped(c: str) -> str:
    return (c.upper() if c.lower() == c else c.lower())[0]


def _edits(kind: str, t: str, spans: list[tuple[int, int]], h: np.ndarray, h2: int, h3: int) -> list[Edit]:
    """Place, characters that go and what comes, in order."""
    if kind == "markdown":
        wrap = ["**", "*", "_"][h3 % 3]
        return [(p, 0, wrap) for p in spans[h2 % len(spans)]] if spans else []
    covered = bytearray(len(t) + 2)
    for s, e in spans:
        lo, hi = max(s, -1) + 1, min(e, len(t) + 1) + 1
        if lo < hi:
            covered[lo:hi] = b"\1" * (hi - lo)
    own = {"html_entity": _MARKUP, "ocr_swap": S._LOOKALIKES}.get(kind)
    free = [p for p, c in enumerate(t) if not covered[p + 1] and (c in own if own is not None else c.isalpha() if kind == "broken_caps" else c == " ")]
    if kind in ("nbsp", "broken_caps"):
        drawn_at = below(hash_int(np.array(free, np.int64), hash_long(h, np.full(1, 42, _U))), 40).tolist()
        if kind == "nbsp":
            return [(p, 1, "\u00a0") for p, d in zip(free, drawn_at) if d % 100 < 40]
        return sorted((p, 1, _flipped(t[p])) for _, p in sorted(zip(drawn_at, free))[: max(1, len(free) // 20)])
    if kind != "html_entity" and kind != "ocr_swap":
        free = [p for p in free if not covered[p] and (kind == "stray_punct" or not covered[p + 2])]
    if not free:
        return []
    p = free[h2 % len(free)]
    return [(p, 0, [",", ";", "."][h3 % 3]) if kind == "stray_punct" else (p, 1, own[t[p]] if own else "")]


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", _SPAN), T.StructField("kind", T.StringType())]))
def noisy(text: pa.Array, spans: pa.Array, h: pa.Array, share: pa.Array) -> pa.Array:
    """synth.noise; only the texts that get some are walked."""
    seed = h.fill_null(0).to_numpy()
    some = (seed % 100 < share.to_numpy()) & h.is_valid().to_numpy(zero_copy_only=False)
    kind = np.where(some, sub(seed, 1) % len(S.NOISE_KINDS), len(S.NOISE_KINDS))
    h2, h3 = sub(seed, 2), sub(seed, 3)
    fields = [pc.struct_field(spans.values, n) for n in ("start", "end", "label")]
    start, end, label = fields[0].cast(pa.int32()), fields[1].cast(pa.int32()), fields[2].cast(pa.string())
    known = (start.is_valid().to_numpy(zero_copy_only=False)) & (end.is_valid().to_numpy(zero_copy_only=False))
    s, e = start.fill_null(0).to_numpy().copy(), end.fill_null(0).to_numpy().copy()
    where, at, texts = edges(spans), np.flatnonzero(some), []
    for k in at.tolist():
        t = text[k].as_py()
        if t is not None and where[k] is not None:
            p, q = where[k]
            edits = _edits(S.NOISE_KINDS[kind[k]], t, list(zip(s[p:q].tolist(), e[p:q].tolist())), seed[k : k + 1], int(h2[k]), int(h3[k])) if known[p:q].all() else []
            if edits:
                out, done = [], 0
                for place, gone, put in edits:
                    out += [t[done:place], put]
                    done = place + gone
                for i in range(p, q):
                    moved = sum(len(put) - gone for place, gone, put in edits if place < s[i] or place == s[i] and not gone)
                    s[i], e[i] = s[i] + moved, e[i] + moved
                t = "".join(out) + t[done:]
        texts.append(t)
    source = np.arange(len(text))
    source[at] = len(text) + np.arange(len(at))
    whole = pa.concat_arrays([text.cast(pa.string()), pa.array(texts, pa.string())]).take(pa.array(source))
    one = pa.StructArray.from_arrays([pa.array(s, mask=~start.is_valid().to_numpy(zero_copy_only=False)), pa.array(e, mask=~end.is_valid().to_numpy(zero_copy_only=False)), label], ["start", "end", "label"])
    lists = pa.ListArray.from_arrays(pa.array(spans.offsets.to_numpy()), one, mask=spans.is_null() if spans.null_count else None)
    return pa.StructArray.from_arrays([whole, lists, pick(kind, [*S.NOISE_KINDS, "none"])], ["text", "spans", "kind"])
