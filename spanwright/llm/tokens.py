"""Token ids packed to fixed rows, as binary columns (operator 8).

Texts are encoded with a byte-level BPE vocabulary, each followed by an end token, and packed by best-fit
decreasing: pieces in descending length, each into the open row with the least room that suffices, found by
descent in a segment tree over the possible rooms. A longer text is split into full rows and a rest; nothing is dropped.

Texts are dealt to buckets of about BUCKET_BYTES by a hash of id and text, one shuffle of the text, and a bucket
packs its texts in the order of id and text hash; so rows and their ids, bucket and number, are the same
however the input is split into files. Only a bucket's last rows are less full. A task packs at most FLUSH_TOKENS tokens at
once: a bucket that equal rows have swollen is packed in parts.

Defined results: a null text takes no place. A null id is carried as null. An empty text is its end token
alone. Repeated rows are packed each. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.common import ident, table

ROW = 2048
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 24_000_000
#: Tokens that a task packs at once, and one text more.
FLUSH_TOKENS = 16_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: The public pre-tokenising pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


class Encoder:
    """A tokeniser with its vocabulary from a file; encodes whole batches."""

    _open: dict[tuple[str, int], "Encoder"] = {}

    def __init__(self, path: str, end: int):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end, self.greatest = end, max(ranks.values(), default=0)

    @classmethod
    def of(cls, path: str, end: int) -> "Encoder":
        if (path, end) not in cls._open:
            cls._open[path, end] = cls(path, end)
        return cls._open[path, end]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with its end, how many each has)."""
        encode = self.encoding.encode_to_numpy
        ids = [encode(t, disallowed_special=()) for t in texts]
        lengths = np.array([len(x) + 1 for x in ids], dtype=np.int64)
        out = np.empty(int(lengths.sum()), dtype=np.uint32)
        at = 0
        for x, n in zip(ids, lengths.tolist()):
            out[at : at + n - 1] = x
            out[at + n - 1] = self.end
            at += n
        return out, lengths


class Rooms:
    """How many open rows have each room, in a segment tree; finds the least room that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int]:
        """(room, row) of the row with the least room of at least `need`, removed; (-1, -1) if there is none."""
        count, at = self.count, self.size + need
        if not count[at]:
            while True:
                while at & 1:
                    at >>= 1
                if not at:
                    return -1, -1
                at += 1
                if count[at]:
                    break
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """(row of each piece, rows); equal lengths go in the order of the pieces."""
    out = np.zeros(len(lengths), dtype=np.int64)
    rooms, rows = Rooms(most), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if not 0 < need <= most:
            raise ValueError("a piece must have between 1 and `most` tokens")
        room, row = rooms.take(need)
        if row < 0:
            room, row, rows = most, rows, rows + 1
        out[i] = row
        if room > need:
            rooms.add(room - need, row)
    return out, rows


def pack_rows(ids: np.ndarray, offsets: np.ndarray, doc_ids: list, most: int, base: int, pad: int, kind: np.dtype) -> pa.RecordBatch:
    """The texts' tokens packed to rows of `most`."""
    lengths = np.diff(offsets)
    parts = -(-lengths // most)
    doc = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(most, lengths[doc] - nth * most)
    row, rows = best_fit_decreasing(size, most)
    order = np.lexsort((np.arange(len(doc)), -size, row))
    doc, nth, size, row = doc[order], nth[order], size[order], row[order]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    running = np.cumsum(size) - size
    within = running - running[begin][row]
    matrix = np.full(rows * most, pad, dtype=kind)
    position = np.zeros(rows * most, dtype=kind)
    step = np.arange(int(size.sum())) - np.repeat(running, size)
    target = np.repeat(row * most + within, size) + step
    matrix[target] = ids[np.repeat(offsets[doc] + nth * most, size) + step]
    position[target] = step
    used = np.bincount(row, weights=size, minlength=rows).astype(np.int32)
    held = np.bincount(row, minlength=rows)
    edges = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    ends = (within + size).astype(np.int32)
    lengths_with_zero = np.insert(ends, begin, 0).astype(np.int32)
    blocks = lambda x: pa.array([b.tobytes() for b in x.reshape(rows, most)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(base + np.arange(rows), pa.int64()),
            pa.array(used),
            blocks(matrix),
            pa.ListArray.from_arrays(pa.array(edges + np.arange(rows + 1, dtype=np.int32)), pa.array(lengths_with_zero)),
            blocks(position),
            pa.ListArray.from_arrays(pa.array(edges), pa.array([doc_ids[i] for i in doc.tolist()], pa.int64())),
            pa.ListArray.from_arrays(pa.array(edges), pa.array(nth * most, pa.int64())),
        ],
        ["row_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"],
    )


def pack_tokens(docs: DataFrame, row_tokens: int = ROW, vocabulary: str = VOCABULARY, end_id: int = END, pad_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of row_tokens ids: row_id, n_tokens, ids and positions (little-endian, 2 bytes each if they fit, else 4), cu_seqlens, doc_ids, starts.

    Segment i of a row is ids[cu_seqlens[i]:cu_seqlens[i + 1]], of document doc_ids[i] from its token starts[i] on; positions count from 0 in each segment.
    """
    if row_tokens < 1:
        raise ValueError("row_tokens must be positive")
    greatest = Encoder.of(vocabulary, end_id).greatest
    kind = np.dtype("<u2" if max(greatest, end_id, pad_id, row_tokens) < 65536 else "<u4")
    lean = docs.select(ident(id_col).cast("long").alias("doc_id"), ident(text_col).cast("string").alias("text")).where("text is not null")
    size = lean.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    tied = lean.withColumn("tie", F.xxhash64("text")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    moved = tied.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "tie")

    def pack(batches):
        encoder = Encoder.of(vocabulary, end_id)
        held, names, number, now, base = [], [], 0, None, 0

        def flush():
            nonlocal held, names, number, base
            if held:
                lengths = np.concatenate([x[1] for x in held])
                ids = np.concatenate([x[0] for x in held])
                held = []
                packed = pack_rows(ids, np.concatenate([[0], np.cumsum(lengths)]), names, row_tokens, base, pad_id, kind)
                base += packed.num_rows
                names, number = [], 0
                for lo in range(0, packed.num_rows, 2000):
                    yield packed.slice(lo, 2000)

        for batch in batches:
            bucket = batch.column(2).to_numpy()
            for lo in range(0, batch.num_rows, 500):
                for part in np.unique(bucket[lo : lo + 500]).tolist():
                    some = lo + np.flatnonzero(bucket[lo : lo + 500] == part)
                    if part != now:
                        yield from flush()
                        now, base = part, part << 40
                    a, n = int(some[0]), len(some)
                    ids, lengths = encoder.batch(batch.column(1).slice(a, n).to_pylist())
                    names += batch.column(0).slice(a, n).to_pylist()
                    held.append((ids.astype(kind), lengths))
                    number += len(ids)
                    if number >= FLUSH_TOKENS:
                        yield from flush()
        yield from flush()

    return moved.select("doc_id", "text", "bucket").mapInArrow(pack, PACKED)


def unpack(packed: list, kind: str = "<u2") -> dict:
    """doc_id -> token ids, from collected rows; of unique ids."""
    parts: dict = {}
    for r in packed:
        ids, cu = np.frombuffer(bytes(r["ids"]), dtype=kind), r["cu_seqlens"]
        for a, b, doc, start in zip(cu[:-1], cu[1:], r["doc_ids"], r["starts"]):
            parts.setdefault(doc, []).append((start, ids[a:b]))
    return {doc: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]) for doc, v in parts.items()}


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))
