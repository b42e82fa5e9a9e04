"""Token label sequences and spans; windows of long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions import kernels
from spanwright.functions.spans import let
from spanwright.functions.text import category_of

IGNORE = -100


def bioes(offsets: Column, spans: Column) -> Column:
    """One label per token (struct a, b): those that overlap a span are S, or B, I …, E. Spans go by start, later ones
    overwrite; tokens at (0, 0) are special and stay O. A token is its span's first or last where no other token before or after it overlaps the span."""
    return F.when(F.size(offsets) > 0, kernels.bioes_labels(offsets, spans)).otherwise(F.array().cast("array<string>"))


def label_ids(labels: Column, offsets: Column, most: int | None = None) -> Column:
    """Labels as numbers, special tokens as -100, cut at `most` tokens."""
    ids = kernels.label_numbers(labels, offsets)
    return ids if most is None else F.slice(ids, 1, most)


def decode_bioes(text: Column, offsets: Column, labels: Column) -> Column:
    """Spans of a label sequence, repaired: I without its B starts a span, E without one is a single, any other label ends what is open. Trimmed; empty ones go."""
    return kernels.decoded(text, offsets, labels)


def spans_of_sequence(labels: Column, offsets: Column) -> Column:
    """Runs of one category; a B or S starts a new one (any label without a hyphen is its own category)."""
    return kernels.sequence_spans(labels, offsets)


def merge_collapsed(labels: Column) -> Column:
    """B-X becomes I-X after any label of the same category."""
    def one(lab: Column, i: Column) -> Column:
        last = F.get(labels, i - 1)
        again = lab.startswith("B-") & (F.substring(last, 2, 1) == "-") & (F.length(last) > 2) & (category_of(last) == category_of(lab))
        return F.when((i > 0) & F.coalesce(again, F.lit(False)), F.concat(F.lit("I-"), category_of(lab))).otherwise(lab)

    return F.transform(labels, one)


def text_of_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def spans_of_tags(tokens: Column, tags: Column, remap: Column | dict[str, str], names: list[str] | None = None) -> Column:
    """Spans of BIO tags in the tokens joined by blanks; categories through remap, unmapped ones end a span. With a dict, which costs
    less than a map's column, tags may be numbers in `names`."""
    if isinstance(remap, dict):
        return kernels.tag_spans_by(remap, names)(tokens, tags)
    labels = F.transform(tags, lambda t: F.when(t == "O", "O").otherwise(F.coalesce(F.concat(F.substring_index(t, "-", 1), F.lit("-"), F.try_element_at(remap, F.substring_index(t, "-", -1))), F.lit("O"))))
    return kernels.tag_spans(tokens, labels)


def windows(length: Column, size: int, overlap: int) -> Column:
    """struct(start, end) of sliding windows over 0 … length; the first that reaches the end is the last. Nothing for length 0."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the window")
    stride = size - overlap
    count = F.when(length <= size, 1).otherwise(F.ceil((length - size) / stride) + 1).cast("int")
    all_of = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, length).alias("end")))
    return F.when(length > 0, all_of).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def token_windows(offsets: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens as struct(start, end) in characters, from the first token's start to the last one's end."""
    return F.transform(windows(F.size(offsets), size, overlap), lambda w: F.struct(F.get(offsets, w["start"])["a"].cast("int").alias("start"), F.get(offsets, w["end"] - 1)["b"].cast("int").alias("end")))


def collapsed_spans(labels: Column, offsets: Column) -> Column:
    """Runs of tokens of one category as spans, whatever the labels' prefixes; tokens without width are special and end nothing."""
    return kernels.collapsed(labels, offsets)


def biased_argmax(logits: Column, bias: float, outside: int = 0) -> Column:
    """The greatest logit's index (the first of equals), the outside label's lowered by the bias."""
    lowered = F.transform(logits, lambda x, i: F.when(i == outside, x - bias).otherwise(x))
    return let(lowered, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def translation(own: list[str], other: list[str], remap: dict[str, str] | None = None) -> dict[int, int]:
    """Label numbers of one label list in another: by a remap of names, or the same names; else a ValueError with the first differences."""
    if remap is not None:
        return {i: other.index(remap.get(name, "O")) for i, name in enumerate(own)}
    if own == other:
        return {i: i for i in range(len(own))}
    wrong = [f"{i}: {a!r} is {b!r}" for i, (a, b) in enumerate(zip(own, other)) if a != b][:5]
    raise ValueError(f"label lists differ ({len(own)} and {len(other)} labels): {wrong}")
