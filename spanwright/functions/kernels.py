"""Folds over long arrays as Arrow functions, linear in an array's length. As expressions they would copy what they have so far, or walk a text from its
beginning, for every element. Each runs document by document over a batch's flat buffers."""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.schema import LABELS

#: Types as objects, since workers, which have no session to parse them, import this module too.
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))
#: The characters of text.BLANK.
BLANKS = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


# -- flat buffers


def edges(lists: pa.Array) -> list[tuple[int, int] | None]:
    """Where each list lies in its values; None for null."""
    at = lists.offsets.to_numpy().tolist()
    pairs: list = list(zip(at, at[1:]))
    if lists.null_count:
        pairs = [p if ok else None for p, ok in zip(pairs, lists.is_valid().to_pylist())]
    return pairs


def cells(values: pa.Array, name: str | None = None) -> Callable[[int, int], list]:
    """A function that gives a range of a struct's field (or of the values themselves) as a list."""
    x = values if name is None else pc.struct_field(values, name)
    if x.null_count or not pa.types.is_integer(x.type):
        return lambda lo, hi: x[lo:hi].to_pylist()
    flat = x.to_numpy()
    return lambda lo, hi: flat[lo:hi].tolist()


def coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """Strings as numbers, -1 for null, and the strings by number."""
    d = values.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(), d.dictionary.to_pylist()


class Found:
    """Spans of each document, as one Arrow array in the end."""

    def __init__(self) -> None:
        self.start, self.end, self.code = array("i"), array("i"), array("i")
        self.at, self.null = array("i", [0]), []
        self.names: dict[str | None, int] = {}

    def add(self, start: int, end: int, label: str | None) -> None:
        self.start.append(start)
        self.end.append(end)
        self.code.append(self.names.setdefault(label, len(self.names)))

    def close(self, known: bool = True) -> None:
        """Ends a document; known: false for null instead of a list."""
        self.at.append(len(self.start))
        self.null.append(not known)

    def result(self) -> pa.Array:
        ints = lambda x: pa.array(np.frombuffer(x, dtype=np.int32) if len(x) else np.empty(0, np.int32), pa.int32())
        labels = pa.array(list(self.names), pa.string()).take(ints(self.code))
        one = pa.StructArray.from_arrays([ints(self.start), ints(self.end), labels], ["start", "end", "label"])
        mask = pa.array(self.null) if any(self.null) else None
        return pa.ListArray.from_arrays(ints(self.at), one, mask=mask)


def listed(doc: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """Values of n documents, in order, as a list of each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)), values)


def ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def gathered(rows: Iterator, type: pa.DataType, most: int = 1000) -> pa.Array:  # noqa: A002
    """Rows as an Arrow array, without holding all of them as Python objects."""
    out = [pa.array([], type)]
    while held := list(itertools.islice(rows, most)):
        out.append(pa.array(held, type))
    return pa.concat_arrays(out)


def in_parts(run: Callable[[pa.Array, pa.Array], pa.Array], most: int = 1 << 19) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """A function of two columns, the second of lists, some documents after others, so that what it holds beside its input doesn't grow with a batch."""

    def over(x: pa.Array, lists: pa.Array) -> pa.Array:
        at, out, lo = lists.offsets.to_numpy(), [], 0
        while lo < len(lists) or not out:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1) if len(lists) else 0
            out.append(run(*(pa.concat_arrays([c[lo:hi]]) for c in (x, lists))))
            lo = hi
        return pa.concat_arrays(out)

    return over


# -- words


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Document, number from 1, value, start and end of each word between blanks and line feeds; places count code points."""
    parts = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
    at = parts.offsets.to_numpy().astype(np.int64)
    values = parts.values
    size = pc.utf8_length(values).to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size + 1)])
    count = np.diff(at)
    doc = np.repeat(np.arange(len(text)), count)
    end = total[1:][at[0] : at[-1]] - np.repeat(total[at[:-1]], count) - 1
    number = np.arange(at[0], at[-1]) - np.repeat(at[:-1], count) + 1
    size, values = size[at[0] : at[-1]], values[at[0] : at[-1]]
    keep = size > 0
    return doc[keep], number[keep], values.filter(pa.array(keep)), (end - size)[keep], end[keep]


#: Characters of text that are split at once, so that a batch of long documents needs little memory.
_CHUNK = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed a size."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=batch.schema.names)
            lo = hi


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per word: the document's columns without its text, i, value, s, e."""
    for batch in pieces(batches, "text"):
        doc, i, value, s, e = split_words(batch.column("text"))
        own = [n for n in batch.schema.names if n != "text"]
        take, int32 = pa.array(doc), lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in own), int32(i), value, int32(s), int32(e)], names=[*own, "i", "value", "s", "e"])


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document that has words: its columns and w, the words in order as struct(i, value, s, e)."""
    for batch in pieces(batches, "text"):
        doc, i, value, s, e = split_words(batch.column("text"))
        count = np.bincount(doc, minlength=batch.num_rows)
        int32 = lambda x: pa.array(x.astype(np.int32))
        one = pa.StructArray.from_arrays([int32(i), value, int32(s), int32(e)], ["i", "value", "s", "e"])
        lists = pa.ListArray.from_arrays(int32(np.concatenate([[0], np.cumsum(count)])), one)
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "w"]).filter(pa.array(count > 0))


# -- label sequences


def _labels(code: np.ndarray, names: list) -> list:
    """(category, prefix) of each label, None for null."""
    known = [(n.rpartition("-")[2], n.partition("-")[0] if "-" in n else "") for n in names] + [None]
    return [known[c] for c in code.tolist()]


def _padded(x: list, n: int) -> list:
    return x if len(x) >= n else x + [None] * (n - len(x))


def _runs(found: Found, labels: list, a: list, b: list) -> None:
    """Runs of one category; a B or S starts a new one."""
    cat, s, e = None, 0, 0
    for lab, x, y in zip(labels, a, b):
        if lab is None:
            continue
        if cat is None or cat != lab[0] or lab[1] == "B" or lab[1] == "S":
            if cat is not None:
                found.add(s, e, cat)
            cat = lab[0] if lab[0] != "O" and x is not None else None
            s, e = x or 0, y or 0
        elif y is not None:
            e = y
    if cat is not None:
        found.add(s, e, cat)


def _alike(x: pa.Array, y: pa.Array) -> bool:
    """Whether all lists are there, and of the same length in both."""
    return not x.null_count and not y.null_count and np.array_equal(np.diff(x.offsets.to_numpy()), np.diff(y.offsets.to_numpy()))


def _whole(lists: pa.Array) -> pa.Array:
    """The values of the lists alone."""
    return lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()] if len(lists) else lists.values[:0]


def _runs_at_once(at: np.ndarray, code: np.ndarray, names: list, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """_runs of many documents, where nothing is null. at: where each one's tokens begin and end."""
    known = [(n.rpartition("-")[2], "-" in n and n.partition("-")[0] in ("B", "S")) for n in names]
    cats = list(dict.fromkeys(c for c, _ in known))
    cat = np.array([cats.index(c) for c, _ in known], np.int32)[code]
    fresh = np.array([new for _, new in known], bool)[code]
    fresh[1:] |= cat[1:] != cat[:-1]
    fresh[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(code)) - 1
    inside = cat[first] != (cats.index("O") if "O" in cats else -1)
    first, last = first[inside], last[inside]
    one = pa.StructArray.from_arrays([ints(a[first]), ints(b[last]), pa.array(cats, pa.string()).take(pa.array(cat[first]))], ["start", "end", "label"])
    return pa.ListArray.from_arrays(ints(np.searchsorted(first, at)), one)


@F.arrow_udf(SPANS)
def sequence_spans(labels: pa.Array, offsets: pa.Array) -> pa.Array:
    if _alike(labels, offsets):
        own, tokens = _whole(labels), _whole(offsets)
        a, b = (pc.struct_field(tokens, n) for n in "ab")
        if not (own.null_count or a.null_count or b.null_count):
            at = labels.offsets.to_numpy()
            return _runs_at_once(at - at[0], *coded(own), a.to_numpy(), b.to_numpy())
    found, (code, names) = Found(), coded(labels.values)
    first, last = cells(offsets.values, "a"), cells(offsets.values, "b")
    for of, at in zip(edges(labels), edges(offsets)):
        if of is not None and at is not None:
            own, a, b = _labels(code[slice(*of)], names), first(*at), last(*at)
            n = max(len(own), len(a))
            _runs(found, _padded(own, n), _padded(a, n), _padded(b, n))
        found.close(of is not None and at is not None)
    return found.result()


@F.arrow_udf(SPANS)
def collapsed(labels: pa.Array, offsets: pa.Array) -> pa.Array:
    """Runs whatever the prefixes, over tokens that have a width."""
    found, (code, names) = Found(), coded(labels.values)
    first, last = cells(offsets.values, "a"), cells(offsets.values, "b")
    for of, at in zip(edges(labels), edges(offsets)):
        if of is not None and at is not None:
            wide = [(lab and (lab[0], "I"), a, b) for lab, a, b in zip(_labels(code[slice(*of)], names), first(*at), last(*at)) if a is not None and b is not None and a < b]
            _runs(found, *zip(*wide)) if wide else None
        found.close(of is not None and at is not None)
    return found.result()


def _tag_spans(tokens: pa.Array, labels: pa.Array, code: np.ndarray, names: list) -> pa.Array:
    """Runs over tokens joined by blanks. code: of all the lists' labels their place in names, -1 for null."""
    if _alike(tokens, labels) and len(tokens):
        at, of = tokens.offsets.to_numpy().astype(np.int64), labels.offsets.to_numpy()
        size, own = pc.utf8_length(_whole(tokens)), code[of[0] : of[-1]]
        if not size.null_count and (own >= 0).all():
            at, size = at - at[0], size.to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size + 1)])
            end = total[1:] - np.repeat(total[at[:-1]], np.diff(at)) - 1
            return _runs_at_once(at, own, names, end - size, end)
    found, sizes = Found(), cells(pc.utf8_length(tokens.values))
    for at, of in zip(edges(tokens), edges(labels)):
        if at is not None and of is not None:
            a, b, place = [], [], -1
            for n in sizes(*at):
                place = None if n is None or place is None else place + 1 + n
                a.append(None if place is None else place - n)
                b.append(place)
            own = _labels(code[slice(*of)], names)
            n = max(len(own), len(a))
            _runs(found, _padded(own, n), _padded(a, n), _padded(b, n))
        found.close(at is None or at[0] == at[1] or of is not None)
    return found.result()


@F.arrow_udf(SPANS)
def tag_spans(tokens: pa.Array, labels: pa.Array) -> pa.Array:
    return _tag_spans(tokens, labels, *coded(labels.values))


def tag_spans_by(remap: dict[str, str], names: list[str] | None = None) -> Callable:
    """tag_spans of BIO tags, or of their numbers in `names`, with categories through a remap; a tag without one is O. Each different tag is looked up once."""

    def label(tag: str | None) -> str:
        own = None if tag is None or tag == "O" else remap.get(tag.rpartition("-")[2])
        return "O" if own is None else f"{tag.partition('-')[0]}-{own}"

    def run(tokens: pa.Array, tags: pa.Array) -> pa.Array:
        if names is None:
            code, known = coded(tags.values)
        else:
            code, known = tags.values.cast(pa.int64(), safe=False).fill_null(-1).to_numpy(), names
        code = np.where((code >= 0) & (code < len(known)), code, len(known))
        return _tag_spans(tokens, tags, code, [label(t) for t in [*known, None]])

    @F.arrow_udf(SPANS)
    def found(tokens: pa.Array, tags: pa.Array) -> pa.Array:
        return in_parts(run)(tokens, tags)

    return found


def _owners(a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens and spans in order: each token's last span (-1 for none), and 0 to 3 for S, B, E, I."""
    owner, prefix = np.full(len(a), -1), np.zeros(len(a), np.int64)
    k = np.flatnonzero((a != 0) | (b != 0))
    x, y = a[k], b[k]
    if (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all():
        lo, hi = np.searchsorted(y, s, side="right"), np.searchsorted(x, e, side="left")
        n = np.maximum(hi - lo, 0)
        own = np.full(len(k), -1)
        if n.sum() <= 8 * len(k):
            own[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(np.arange(len(s)), n)
        else:  # many spans over the same tokens
            for j, (p, q) in enumerate(zip(lo.tolist(), hi.tolist())):
                own[p:q] = j
        t = np.flatnonzero(own >= 0)
        owner[k] = own
        prefix[k[t]] = 2 * (t > lo[own[t]]) + (t < hi[own[t]] - 1)
        return owner, prefix
    special = (a == 0) & (b == 0)
    for i in np.flatnonzero(~special).tolist():
        over = np.flatnonzero((a[i] < e) & (b[i] > s))
        if len(over):
            j = owner[i] = over[-1]
            into = (a < e[j]) & (b > s[j]) & ~special
            back = i > 0 and (into[i - 1] or special[i - 1] and into[:i].any())
            on = i < len(a) - 1 and (into[i + 1] or special[i + 1] and into[i + 1 :].any())
            prefix[i] = 2 * bool(back) + bool(on)
    return owner, prefix


def bioes_of(offsets: pa.Array, spans: pa.Array) -> pa.Array:
    tokens, own = offsets.values, spans.values
    number = lambda x, name: pc.struct_field(x, name).cast(pa.int64()).fill_null(0).to_numpy()
    a, b, s, e = number(tokens, "a"), number(tokens, "b"), number(own, "start"), number(own, "end")
    whole = (pc.struct_field(own, "start").is_valid().to_numpy(False) & pc.struct_field(own, "end").is_valid().to_numpy(False)) if own.null_count or pc.struct_field(own, "start").null_count or pc.struct_field(own, "end").null_count else None
    code, names = coded(pc.struct_field(own, "label"))
    out, at = [np.empty(0, np.int64)], [0]
    outside, unnamed = 4 * len(names), 4 * len(names) + 1
    for where, over in zip(edges(offsets), edges(spans)):
        if where is not None:
            p, q = over or (0, 0)
            pick = np.arange(p, q) if whole is None else p + np.flatnonzero(whole[p:q])
            pick = pick[np.lexsort((e[pick], s[pick]))]
            owner, prefix = _owners(a[slice(*where)], b[slice(*where)], s[pick], e[pick])
            mine = code[pick][owner] if len(pick) else owner
            out.append(np.where(owner < 0, outside, np.where(mine < 0, unnamed, 4 * mine + prefix)))
        at.append(at[-1] + (where[1] - where[0] if where else 0))
    table = pa.array([f"{p}-{n}" for n in names for p in "SBEI"] + ["O", None], pa.string())
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), table.take(pa.array(np.concatenate(out))))


@F.arrow_udf(T.ArrayType(T.StringType()))
def bioes_labels(offsets: pa.Array, spans: pa.Array) -> pa.Array:
    return bioes_of(offsets, spans)


def numbers_of(labels: pa.Array, offsets: pa.Array) -> pa.Array:
    """Labels as numbers, null for unknown ones, -100 for tokens at (0, 0); as long as the longer of the two lists."""
    code, names = coded(labels.values)
    own = np.array([LABELS.index(n) if n in LABELS else -1 for n in names] + [-1], np.int32)[code]
    a, b = (pc.struct_field(offsets.values, n).cast(pa.int64()).fill_null(-1).to_numpy() for n in "ab")
    special = (a == 0) & (b == 0)
    if _alike(labels, offsets) and len(labels):
        at, of = labels.offsets.to_numpy(), offsets.offsets.to_numpy()
        ids = np.where(special[of[0] : of[-1]], -100, own[at[0] : at[-1]])
        return pa.ListArray.from_arrays(ints(at - at[0]), pa.array(ids, pa.int32(), mask=ids == -1))
    out = []
    for x, y in zip(edges(labels), edges(offsets)):
        if x is None or y is None:
            out.append(None)
        else:
            n = max(x[1] - x[0], y[1] - y[0])
            pairs = zip(_padded(own[slice(*x)].tolist(), n), _padded(special[slice(*y)].tolist(), n))
            out.append([-100 if s else None if i == -1 else i for i, s in pairs])
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def label_numbers(labels: pa.Array, offsets: pa.Array) -> pa.Array:
    return numbers_of(labels, offsets)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The places without white space at the edges; None if nothing is left."""
    value = text[start:end]
    if value and value[0] not in BLANKS and value[-1] not in BLANKS:
        return start, end
    left = next((i for i, c in enumerate(value) if c not in BLANKS), len(value))
    right = next((i for i, c in enumerate(reversed(value)) if c not in BLANKS), len(value))
    return (start + left, end - right) if left < len(value) else None


@F.arrow_udf(SPANS)
def decoded(text: pa.Array, offsets: pa.Array, labels: pa.Array) -> pa.Array:
    found, (code, names) = Found(), coded(labels.values)
    first, last = cells(offsets.values, "a"), cells(offsets.values, "b")
    for body, at, of in zip(text, edges(offsets), edges(labels)):
        if at is not None and of is not None:
            body = body.as_py()

            def add(s: int, e: int, cat: str) -> None:
                place = None if body is None else _trimmed(body, s, e)  # noqa: B023
                if place:
                    found.add(*place, cat)

            own, a, b = _labels(code[slice(*of)], names), first(*at), last(*at)
            n, cat, s, e = max(len(own), len(a)), None, 0, 0
            for lab, x, y in zip(_padded(own, n), _padded(a, n), _padded(b, n)):
                if x is None or y is None or x == 0 and y == 0:
                    continue
                here, prefix = lab or ("O", "")
                goes_on = cat is not None and cat == here
                if prefix == "E" and goes_on:
                    add(s, y, here)
                    cat = None
                elif prefix == "I" and goes_on:
                    e = y
                else:
                    if cat is not None:
                        add(s, e, cat)
                    outside = here == "O" and prefix == ""
                    if prefix in ("S", "E") and not outside:
                        add(x, y, here)
                    cat, s, e = (None, 0, 0) if outside or prefix in ("S", "E") else (here, x, y)
            if cat is not None:
                add(s, e, cat)
        found.close(at is not None and of is not None)
    return found.result()


# -- spans


def projected_by(remap: dict[str, str]) -> Callable:
    """Of spans over texts of n characters those that lie in the text and whose label has one of ours other than `O`, with our label. Each different label is looked up once."""
    known = {foreign: own for foreign, own in remap.items() if foreign not in ("", "O") and own not in (None, "O")}
    ours = list(dict.fromkeys(known.values()))

    def run(n: pa.Array, spans: pa.Array) -> pa.Array:
        if not len(spans):
            return pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))
        at, own = spans.offsets.to_numpy().astype(np.int64), _whole(spans)
        code, names = coded(pc.struct_field(own, "label"))
        label = np.array([ours.index(known[x]) if x in known else -1 for x in names] + [-1], np.int32)[code]
        start, end = (pc.struct_field(own, x).fill_null(-1).to_numpy() for x in ("start", "end"))
        keep = (label >= 0) & (start >= 0) & (end > start) & (end <= np.repeat(n.fill_null(-1).to_numpy(), np.diff(at)))
        one = pa.StructArray.from_arrays([ints(start[keep]), ints(end[keep]), pa.array(ours, pa.string()).take(pa.array(label[keep]))], ["start", "end", "label"])
        return pa.ListArray.from_arrays(ints(np.concatenate([[0], np.cumsum(keep)])[at - at[0]]), one, mask=spans.is_null() if spans.null_count else None)

    @F.arrow_udf(SPANS)
    def found(n: pa.Array, spans: pa.Array) -> pa.Array:
        return in_parts(run)(n, spans)

    return found


@F.arrow_udf(SPANS)
def merged(text: pa.Array, spans: pa.Array) -> pa.Array:
    found, own = Found(), spans.values
    starts, ends, (code, names) = cells(own, "start"), cells(own, "end"), coded(pc.struct_field(own, "label"))
    names = [*names, None]
    for body, at in zip(text, edges(spans)):
        body = body.as_py()
        if at is not None and body is not None:
            size, last = len(body), None
            for s, e, c in zip(starts(*at), ends(*at), code[slice(*at)].tolist()):
                if s is None or e is None or not 0 <= s < e <= size or last and s < last[1]:
                    continue
                if last and c >= 0 and c == last[2] and (s == last[1] or s == last[1] + 1 and body[last[1]] in BLANKS):
                    last = (last[0], e, c)
                    continue
                if last:
                    found.add(last[0], last[1], names[last[2]])
                last = (s, e, c)
            if last:
                found.add(last[0], last[1], names[last[2]])
        found.close(at is not None)
    return found.result()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])))
def located(text: pa.Array, values: pa.Array) -> pa.Array:
    """The first occurrence of each value, stripped; each different value of a text is looked for once."""
    start, end, what, at, null = array("i"), array("i"), [], array("i", [0]), []
    blank = "".join(sorted(BLANKS))
    for body, own in zip(text, edges(values)):
        body, seen = body.as_py(), {}
        for v in values.values[slice(*own)].to_pylist() if own else []:
            if v not in seen:
                bare = v and v.strip(blank)
                place = body.find(bare) if bare and body is not None else -1
                seen[v] = (place, place + len(bare), bare) if place >= 0 else (0, 0, None)
            s, e, bare = seen[v]
            start.append(s)
            end.append(e)
            what.append(bare)
        at.append(len(what))
        null.append(own is None)
    ints = lambda x: pa.array(np.array(x, dtype=np.int32))
    one = pa.StructArray.from_arrays([ints(start), ints(end), pa.array(what, pa.string())], ["start", "end", "value"], mask=pa.array([w is None for w in what], pa.bool_()))
    return pa.ListArray.from_arrays(ints(at), one, mask=pa.array(null) if any(null) else None)
