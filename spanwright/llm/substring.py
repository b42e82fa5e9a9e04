"""Substring deduplication with a distributed count-min prefilter (operator 2).

A window is `size` consecutive words of one document; words are runs without ASCII white space. A
window is repeated if it occurs more than once in all documents, within one document included.

1. Documents are hashed into blocks. Each block builds its sketch: for each of two rows, a counter
   index per distinct window and whether the block has it more than once, cut into shards of the
   counter array. Nothing the size of the corpus is ever in one place or broadcast.
2. Shards are merged by addition (saturated at two), so each counter is at least the count of every
   window that hashes to it. For each block a bit per index that it sent says whether the sum is two or more.
3. Windows whose counters are two or more in both rows, all repeated ones and a few others, are
   grouped exactly by 96 bits of hash. Each group's first occurrence, by doc_id, block, text and
   position, is kept (a doc_id's different texts may lie in different blocks).
4. The blocks turn the groups' verdicts into spans of words, or cut the words from the texts.

Steps 1, 3 and 4 read the same shuffled blocks. The number of blocks, the counters and the shards
follow from the bytes of text, so that each task's work stays the same as the corpus grows.

Defined results: null and empty texts, and texts shorter than a window, have no repeats and are never
changed. A null doc_id sorts last. Repeated rows repeat each other; the first keeps its words. An
empty table gives no rows. Other columns, whatever their names, are carried or ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import buffers, fresh, ident, mix, powers, range_hashes, table, word_hashes, word_ranges

SIZE = 50
#: Bytes of text in a block, and counters (bytes of memory) in a shard.
BLOCK_BYTES = 3 << 20
SHARD_BITS = 22
#: Counters per window and row, at least: one window in 64 or fewer passes the prefilter by chance.
LOAD = 8
_ROWS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93))
_LAST = (1 << 63) - 1

SKETCH = "block int, srow int, shard int, cells binary"
VERDICT = "block int, srow int, shard int, bits binary"
KEYS = "xshard int, block int, keys binary"
REPEATS = "block int, xshard int, keys binary"
SPANS = "doc_id long, start_word int, end_word int, removed_words int"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers below 2^32 as differences, two bytes each where they fit, else four."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    narrow = not len(steps) or int(steps.max()) < 65536
    return (b"\x02" if narrow else b"\x04") + steps.astype("<u2" if narrow else "<u4").tobytes()


def unpack_sorted(data: memoryview) -> np.ndarray:
    return np.cumsum(np.frombuffer(data[1:], dtype="<u2" if data[0] == 2 else "<u4"), dtype=np.int64)


class Block:
    """The rows of a block in the order (doc_id, text), their words, and the windows' hashes."""

    def __init__(self, ids: pa.Array, texts: pa.Array, size: int):
        self.ids = np.array([_LAST if x is None else x for x in ids.to_pylist()], dtype=np.int64)
        data, offsets = buffers(texts)
        by_text = sorted(range(len(self.ids)), key=lambda i: (self.ids[i], data[offsets[i] : offsets[i + 1]].tobytes())) if len(set(self.ids.tolist())) < len(self.ids) else np.argsort(self.ids, kind="stable")
        self.order = np.asarray(by_text, dtype=np.int64)
        texts = texts.take(pa.array(self.order)) if len(self.order) else texts
        self.ids = self.ids[self.order]
        self.data, self.offsets = buffers(texts)
        self.starts, self.ends, self.rows = word_ranges(self.data, self.offsets)
        self.size = size
        counts = np.maximum(np.diff(self.rows) - (size - 1), 0)
        self.row_of = np.repeat(np.arange(len(counts)), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.at = np.arange(len(self.row_of)) - self.first[self.row_of] + self.rows[self.row_of]
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.hash = range_hashes(self.words, self.at, self.at + size)

    def second(self, at: np.ndarray) -> np.ndarray:
        """32 more bits for the windows that start at these words, independent of the first hash."""
        return (range_hashes(mix(self.words), at, at + self.size, 0xA0761D6478BD642F) >> np.uint64(32)).astype(np.uint32)

    def cells(self, srow: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows' counters in a row of the sketch, and the same distinct and ascending with their counts."""
        index = (mix(self.hash ^ _ROWS[srow]) >> np.uint64(64 - bits)).astype(np.int64)
        ordered = np.sort(index)
        begins = np.flatnonzero(np.diff(ordered, prepend=-1))
        return index, ordered[begins], np.diff(begins, append=len(ordered))


def emit_sketch(block: int, b: Block, bits: int) -> pa.Table:
    out = {"block": [], "srow": [], "shard": [], "cells": []}
    for srow in (0, 1):
        _, index, count = b.cells(srow, bits)
        shard = index >> SHARD_BITS
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(0, int)
        for lo, hi in zip(edges[:-1], edges[1:]):
            many = np.packbits(count[lo:hi] > 1).tobytes()
            cells = pack_sorted(index[lo:hi] - (int(shard[lo]) << SHARD_BITS))
            out["block"].append(block), out["srow"].append(srow), out["shard"].append(int(shard[lo]))
            out["cells"].append(len(many).to_bytes(4, "little") + many + cells)
    return pa.table(out, pa.schema([("block", pa.int32()), ("srow", pa.int32()), ("shard", pa.int32()), ("cells", pa.binary())]))


def merge_sketches(part: pa.Table) -> pa.Table:
    """One shard of one row: the sum of all blocks' sketches, and for each block which of its counters reached two."""
    sums = np.zeros(1 << SHARD_BITS, dtype=np.uint8)
    sent = []
    for cells in part["cells"]:
        view = memoryview(cells.as_buffer())
        n = int.from_bytes(view[:4], "little")
        index = unpack_sorted(view[4 + n :])
        many = np.unpackbits(np.frombuffer(view[4 : 4 + n], dtype=np.uint8), count=len(index))
        sums[index] = np.minimum(sums[index] + many + 1, 2)
        sent.append(index)
    bits = [np.packbits(sums[index] > 1).tobytes() for index in sent]
    return part.drop_columns(["cells"]).append_column("bits", pa.array(bits, pa.binary()))


def passed(b: Block, verdicts: pa.Table, bits: int) -> np.ndarray:
    """Which windows have counters of two or more in both rows."""
    keep = np.ones(len(b.hash), dtype=bool)
    for srow in (0, 1):
        index, distinct, _ = b.cells(srow, bits)
        flags = np.zeros(len(distinct), dtype=bool)
        shard = distinct >> SHARD_BITS
        for r, s, answer in zip(verdicts["srow"].to_pylist(), verdicts["shard"].to_pylist(), verdicts["bits"]):
            if r == srow:
                lo, hi = np.searchsorted(shard, [s, s + 1])
                flags[lo:hi] = np.unpackbits(np.frombuffer(answer.as_buffer(), dtype=np.uint8), count=hi - lo)
        keep &= flags[np.searchsorted(distinct, index)]
    return keep


_KEY = np.dtype([("h", "<u8"), ("g", "<u4"), ("many", "u1"), ("doc", "<i8")])


def emit_keys(block: int, b: Block, verdicts: pa.Table, bits: int, shards: int) -> pa.Table:
    """The block's distinct windows that passed, with the least doc_id that has each and whether it occurs again in the block."""
    at = np.flatnonzero(passed(b, verdicts, bits))
    h, g = b.hash[at], b.second(b.at[at])
    order = np.lexsort((g, h))  # stable: within a window, rows stay in the order (doc_id, text)
    h, g, doc = h[order], g[order], b.ids[b.row_of[at[order]]]
    begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, int)
    many = np.diff(begins, append=len(h)) > 1
    h, g, doc = h[begins], g[begins], doc[begins]
    xshard = (mix(h) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(xshard, kind="stable")
    edges = np.flatnonzero(np.diff(xshard[order], prepend=-1, append=-1)) if len(h) else np.zeros(0, int)
    out = {"xshard": [], "block": [], "keys": []}
    for lo, hi in zip(edges[:-1], edges[1:]):
        some = order[lo:hi]
        # column by column: high bytes of neighbouring doc_ids are alike and compress well
        body = h[some].tobytes() + g[some].tobytes() + np.packbits(many[some]).tobytes() + np.ascontiguousarray(doc[some].view(np.uint8).reshape(-1, 8).T).tobytes()
        out["xshard"].append(int(xshard[some[0]])), out["block"].append(block), out["keys"].append(len(some).to_bytes(4, "little") + body)
    return pa.table(out, pa.schema([("xshard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())]))


def read_keys(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    flags = -(-n // 8)
    h = np.frombuffer(data[4 : 4 + 8 * n], dtype="<u8")
    g = np.frombuffer(data[4 + 8 * n : 4 + 12 * n], dtype="<u4")
    many = np.unpackbits(np.frombuffer(data[4 + 12 * n : 4 + 12 * n + flags], dtype=np.uint8), count=n)
    doc = np.ascontiguousarray(np.frombuffer(data[4 + 12 * n + flags :], dtype=np.uint8).reshape(8, n).T).view("<i8").ravel()
    return h, g, many, doc


def merge_keys(part: pa.Table) -> pa.Table:
    """Exact groups of one shard: for each block its repeated windows' hashes, and for which of them it holds the first occurrence."""
    blocks = part["block"].to_numpy()
    read = [read_keys(memoryview(x.as_buffer())) for x in part["keys"]]
    h, g, many, doc = (np.concatenate(x) for x in zip(*read))
    block = np.repeat(blocks, [len(r[0]) for r in read])
    order = np.lexsort((block, doc, g, h))
    same = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
    group = np.cumsum(same) - 1
    repeated = np.empty(len(h), dtype=bool)
    repeated[order] = (np.bincount(group, weights=1.0 + many[order]) > 1)[group]
    owner = np.empty(len(h), dtype=bool)
    owner[order] = same
    at = np.flatnonzero(repeated)
    at = at[np.lexsort((h[at], block[at]))]
    edges = np.flatnonzero(np.diff(block[at], prepend=-1, append=-1)) if len(at) else np.zeros(0, int)
    shard = int(part["xshard"][0].as_py())
    out = {"block": [], "xshard": [], "keys": []}
    for lo, hi in zip(edges[:-1], edges[1:]):
        mine = at[lo:hi]
        body = h[mine].tobytes() + g[mine].tobytes() + np.packbits(owner[mine]).tobytes()
        out["block"].append(int(block[mine[0]])), out["xshard"].append(shard), out["keys"].append(len(mine).to_bytes(4, "little") + body)
    return pa.table(out, pa.schema([("block", pa.int32()), ("xshard", pa.int32()), ("keys", pa.binary())]))


def covered(b: Block, repeats: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each word: whether a repeated window covers it, and whether one that isn't the first of its kind does."""
    parts = []
    for x in repeats["keys"]:
        data = memoryview(x.as_buffer())
        n = int.from_bytes(data[:4], "little")
        parts.append((np.frombuffer(data[4 : 4 + 8 * n], "<u8"), np.frombuffer(data[4 + 8 * n : 4 + 12 * n], "<u4"), np.unpackbits(np.frombuffer(data[4 + 12 * n :], np.uint8), count=n)))
    none = np.zeros(len(b.starts), dtype=bool)
    if not parts:
        return none, none
    h, g, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((g, h))
    h, g, owner = h[order], g[order], owner[order].astype(bool)
    place = np.searchsorted(h, b.hash)
    at = np.flatnonzero((place < len(h)) & (h[np.minimum(place, len(h) - 1)] == b.hash))
    place = place[at]
    second = b.second(b.at[at])
    found = np.zeros(len(at), dtype=bool)
    while True:  # windows that agree in the first 64 bits follow each other; each is looked at
        at_key = np.minimum(place, len(h) - 1)
        live = ~found & (place < len(h)) & (h[at_key] == b.hash[at])
        found |= live & (g[at_key] == second)
        place = np.where(live & ~found, place + 1, place)
        if not (live & ~found).any():
            break
    at, place = at[found], place[found]
    first_here = np.zeros(len(at), dtype=bool)
    if len(at):
        _, first = np.unique(place, return_index=True)  # rows are in the order (doc_id, text)
        first_here[first] = True
    extra = at[~(owner[place] & first_here)]

    def cover(windows: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(b.starts) + 1, dtype=np.int32)
        np.add.at(steps, b.at[windows], 1)
        np.add.at(steps, b.at[windows] + b.size, -1)
        return np.cumsum(steps[:-1]) > 0

    return cover(at), cover(extra)


def spans_of(b: Block, repeats: pa.Table) -> pa.Table:
    inside, extra = covered(b, repeats)
    row_of_word = np.repeat(np.arange(len(b.rows) - 1), np.diff(b.rows))
    new_row = np.r_[True, row_of_word[1:] != row_of_word[:-1]] if len(row_of_word) else np.zeros(0, bool)
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | new_row)) if len(inside) else np.zeros(0, int)
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | np.r_[new_row[1:], True])) + 1 if len(inside) else np.zeros(0, int)
    row = row_of_word[starts]
    removed = np.concatenate([[0], np.cumsum(extra)])
    ids = b.ids[row]
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=ids == _LAST),
            "start_word": pa.array(starts - b.rows[row], pa.int32()),
            "end_word": pa.array(ends - b.rows[row], pa.int32()),
            "removed_words": pa.array(removed[ends] - removed[starts], pa.int32()),
        }
    )


def cut_rows(part: pa.Table, b: Block, repeats: pa.Table, text: str) -> pa.Table:
    """The block's rows with the repeated words cut, each run with the white space after it."""
    _, extra = covered(b, repeats)
    part = part.take(pa.array(b.order))
    kept_words = np.diff(np.concatenate([[0], np.cumsum(~extra)])[b.rows])
    emptied = (np.diff(b.rows) > 0) & (kept_words == 0)
    keep = np.ones(len(b.data), dtype=bool)
    word = np.flatnonzero(extra)
    until = np.append(b.starts[1:], len(b.data))[word]
    until = np.minimum(until, b.offsets[np.searchsorted(b.offsets, b.starts[word], "right")])
    steps = np.zeros(len(b.data) + 1, dtype=np.int32)
    np.add.at(steps, b.starts[word], 1)
    np.add.at(steps, until, -1)
    if len(b.data):
        keep = np.cumsum(steps[:-1]) == 0
    total = np.concatenate([[0], np.cumsum(keep)])[b.offsets].astype(np.int64)
    at = part.schema.get_field_index(text)
    null = part[text].combine_chunks().is_null() if part.num_rows else None
    values = pa.LargeStringArray.from_buffers(len(total) - 1, pa.py_buffer(total.tobytes()), pa.py_buffer(b.data[keep].tobytes()))
    if part.num_rows and null.true_count:
        values = pa.compute.if_else(null, pa.scalar(None, pa.large_string()), values)
    return part.set_column(at, part.schema.field(at), values.cast(part.schema.field(at).type)).filter(pa.array(~emptied))


def _plan(docs: DataFrame, text_col: str, block_bytes: int) -> tuple[int, int]:
    """Blocks, and bits of a counter's index, from the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(ident(text_col).cast("string")))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return blocks, max(SHARD_BITS, math.ceil(math.log2(max(1, LOAD * total / 6))))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, size: int, extra: list[str], block_bytes: int):
    spark = docs.sparkSession
    blocks, bits = _plan(docs, text_col, block_bytes)
    if bits > 63:
        raise ValueError("too much text for one sketch")
    block, ids, text = "block", "wid", "wtext"
    key = F.pmod(F.xxhash64(ident(id_col), ident(text_col)), F.lit(blocks)).cast("int")
    carried = [ident(c).alias(f"c{i}") for i, c in enumerate(extra)]
    # a fixed number of partitions: the three readings share one shuffle, whatever sizes they need otherwise
    parted = docs.select(key.alias(block), ident(id_col).cast("long").alias(ids), ident(text_col).cast("string").alias(text), *carried).repartition(
        max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))) if blocks > 1 else 1, block
    )
    number = lambda t: int(t.column("block")[0].as_py())

    def sketch(part: pa.Table) -> pa.Table:
        return emit_sketch(number(part), Block(part["wid"].combine_chunks(), part["wtext"].combine_chunks(), size), bits)

    def keys(part: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"xshard": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "keys": pa.array([], pa.binary())})
        return emit_keys(number(part), Block(part["wid"].combine_chunks(), part["wtext"].combine_chunks(), size), verdicts, bits, blocks)

    verdicts = parted.groupBy(block).applyInArrow(sketch, SKETCH).groupBy("srow", "shard").applyInArrow(merge_sketches, VERDICT)
    found = parted.groupBy(block).cogroup(verdicts.groupBy(block)).applyInArrow(keys, KEYS)
    return parted, found.groupBy("xshard").applyInArrow(merge_keys, REPEATS)


def repeated_spans(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, start_word, end_word, removed_words: each run of words that repeated windows cover.

    removed_words counts the words of the run under windows that occurred before, by (doc_id, text, position).
    """
    parted, repeats = _verdicts(docs, id_col, text_col, size, [], block_bytes)

    def spans(part: pa.Table, found: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.int32()) for c in ("start_word", "end_word", "removed_words")}})
        return spans_of(Block(part["wid"].combine_chunks(), part["wtext"].combine_chunks(), size), found)

    return parted.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(spans, SPANS)


def cut_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with the repeated words cut from their texts, all columns kept; a document of which nothing is left goes.

    Documents whose text was null or blank before stay as they were.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    parted, repeats = _verdicts(docs, id_col, text_col, size, others, block_bytes)
    schema = T.StructType([f for f in parted.schema.fields])

    def cut(part: pa.Table, found: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part
        return cut_rows(part, Block(part["wid"].combine_chunks(), part["wtext"].combine_chunks(), size), found, "wtext")

    done = parted.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(cut, schema)
    names = {id_col: "wid", text_col: "wtext", **{c: f"c{i}" for i, c in enumerate(others)}}
    kinds = dict(docs.dtypes)
    return done.select(*(F.col(names[c]).cast(kinds[c]).alias(c) for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
p AS (
  SELECT doc_id, text, g AS pos, md5(array_to_string(ws[g + 1 : g + 50], ' ')) AS h
  FROM w, LATERAL (SELECT unnest(generate_series(0, len(ws) - 50)) AS g) WHERE len(ws) >= 50),
r AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, text, pos) AS nth FROM p),
hit AS (SELECT * FROM r WHERE n > 1),
isl AS (
  SELECT *, sum(CASE WHEN pos <= last + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, text ORDER BY pos) AS grp
  FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id, text ORDER BY pos) AS last FROM hit)),
spans AS (SELECT doc_id, text, grp, min(pos) AS s, max(pos) + 50 AS e FROM isl GROUP BY ALL),
gone AS (
  SELECT i.doc_id, i.text, i.grp, least(50, i.pos + 50 - coalesce(lag(i.pos) OVER (PARTITION BY i.doc_id, i.text, i.grp ORDER BY i.pos) + 50, i.pos)) AS k
  FROM isl i WHERE nth > 1)
SELECT s.doc_id, CAST(s.s AS INTEGER) AS start_word, CAST(s.e AS INTEGER) AS end_word, CAST(coalesce(sum(g.k), 0) AS INTEGER) AS removed_words
FROM spans s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.text = g.text AND s.grp = g.grp
GROUP BY s.doc_id, s.text, s.grp, s.s, s.e
"""
