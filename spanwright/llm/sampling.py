"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding (operator 9).

A text's units are its chunks between blanks, each with the word mark before it, the first included. A unit's
lattice has an edge for every vocabulary piece that matches in it; a character without a piece of its own has
an edge of byte pieces. An edge weighs exp(alpha * score); as the vocabulary's merges carry ranks, not
probabilities, score is -log(rank + OFFSET), Zipf's law, and -log of the vocabulary's size for each byte.
The forward pass sums the weights of all paths to each place, once per distinct unit of a batch; the
backward pass draws each occurrence's last piece, the piece before it and so on, each with its posterior
probability. The draws hash (seed, row key, unit's number, step), so a row's segmentation is the same
in any batch, partition or run.

Pieces with a word mark elsewhere than at the front are not used. A word mark that stands in the text itself is written as
bytes, so decoding gives back every text exactly, blanks, line ends and unknown characters included.

Defined results: a null text has null ids, an empty one none. A null key counts as 0. Rows with equal key and text get
equal ids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanwright.llm.common import _BYTE, buffers, ident, mix, mix_int, pieces, range_hashes, table, unit

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 20240229
OFFSET = 10.0
MARK = 0x2581
_LITERAL = 0x110000
_GOLD = 0x9E3779B97F4A7C15
SAMPLED = "doc_id long, n_pieces int, piece_ids array<int>, lossless boolean"


class Vocabulary:
    """A vocabulary's pieces in a trie held as a hash table of (node, code point) -> node."""

    _open: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        texts: list[bytes] = [b""] * self.size
        normal: list[tuple[int, str]] = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                texts[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece.rfind("▁") <= 0:
                normal.append((i, piece))
                texts[i] = piece.replace("▁", " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary needs byte pieces")
        self._build(normal, texts)

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _build(self, normal: list[tuple[int, str]], texts: list[bytes]) -> None:
        #: Score by piece, then of a byte, then of no edge.
        score = np.full(self.size + 2, -np.inf)
        rank = 0
        children: dict[int, int] = {}
        piece_of = [-1]
        self.longest = 1
        for i, piece in normal:
            score[i] = -np.log(rank + OFFSET)
            rank += 1
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in children:
                    children[key] = len(piece_of)
                    piece_of.append(-1)
                node = children[key]
            piece_of[node] = i
            self.longest = max(self.longest, len(piece))
        score[self.size] = -np.log(self.size + OFFSET)
        self.score, self.piece_of = score, np.array(piece_of, dtype=np.int32)
        bits = max(8, (4 * len(children)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.nodes = np.zeros(1 << bits, dtype=np.int32)
        for key, node in children.items():
            slot = ((key * _GOLD) & (2**64 - 1)) >> (64 - bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.nodes[slot] = key, node
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.text_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def child(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The nodes that follow by these code points, -1 where none does."""
        key = node.astype(np.int64) << 21 | point
        slot = ((key.view(np.uint64) * np.uint64(_GOLD)) >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int32)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.nodes[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out


class Lattices:
    """The lattices of distinct units, filtered forwards."""

    def __init__(self, vocabulary: Vocabulary, units: list[bytes], alpha: float):
        v = self.vocabulary = vocabulary
        text = (" " + b" ".join(units).decode("utf-8", "replace")).encode("utf-32-le", "surrogatepass") if units else b""
        points = np.frombuffer(text, dtype="<u4").astype(np.int64)
        points[points == MARK] = _LITERAL
        self.start = np.flatnonzero(points == 32)
        points[points == 32] = MARK
        self.points = points
        self.length = np.diff(self.start, append=len(points))
        n, most = len(points), v.longest
        self.edge = np.full((n, most), -1, dtype=np.int32)  # by last character and length - 1
        until = np.repeat(self.start + self.length, self.length)
        place, node = np.arange(n), np.zeros(n, dtype=np.int32)
        single = np.zeros(n, dtype=bool)
        for k in range(most):
            inside = place + k < until[place]
            place, node = place[inside], node[inside]
            node = v.child(node, points[place + k])
            alive = node >= 0
            place, node = place[alive], node[alive]
            piece = v.piece_of[node]
            good = piece >= 0
            self.edge[place[good] + k, k] = piece[good]
            if k == 0:
                single[place[good]] = True
            if not len(place):
                break
        self.edge[~single, 0] = v.size  # bytes
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        self.width = np.where(points == _LITERAL, 3, width)
        score = alpha * v.score
        score[v.size + 1] = -np.inf
        self.cdf = np.zeros((n, most), dtype=np.float32)
        total = np.zeros(n + len(self.start))  # log weight of all paths to each boundary of each unit
        first = self.start + np.arange(len(self.start))
        order = np.argsort(-self.length, kind="stable")
        sizes = self.length[order]
        for p in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            active = order[: np.searchsorted(-sizes, -p, "right")]
            m = min(p, most)
            last = self.start[active] + p - 1
            edges = self.edge[last, :m]
            weight = score[edges]  # -1: the entry of no edge
            weight[:, 0] = np.where(edges[:, 0] == v.size, weight[:, 0] * self.width[last], weight[:, 0])
            weight += total[(first[active] + p)[:, None] - np.arange(1, m + 1)]
            top = weight.max(axis=1)
            weight -= top[:, None]
            np.exp(weight, out=weight)
            run = np.cumsum(weight, axis=1)
            total[first[active] + p] = top + np.log(run[:, -1])
            self.cdf[last, :m] = run / run[:, -1:]
            self.cdf[last, m:] = 2.0
        self.log_total = total[first + self.length]

    def sample(self, unit_of: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all occurrences one after another, how many each has). base: each occurrence's hash."""
        v = self.vocabulary
        start, left = self.start[unit_of], self.length[unit_of].copy()
        steps, number = [], np.zeros(len(unit_of), dtype=np.int64)
        active, turn = np.arange(len(unit_of)), 0
        while len(active):
            turn += 1
            draw = unit(mix(base[active] + np.uint64((turn * _GOLD) & (2**64 - 1))))
            last = start[active] + left[active] - 1
            size = (self.cdf[last] <= draw[:, None].astype(np.float32)).sum(axis=1) + 1
            edge = self.edge[last, np.minimum(size, self.edge.shape[1]) - 1]
            wrong = np.flatnonzero((edge < 0) | (size > self.edge.shape[1]))
            for i in wrong.tolist():  # a draw at the edge of single precision: the longest piece there is
                k = int(np.flatnonzero(self.edge[last[i]] >= 0)[-1])
                size[i], edge[i] = k + 1, self.edge[last[i], k]
            count = np.where(edge == v.size, self.width[last], 1)
            steps.append((active, edge, last, count))
            number[active] += count
            left[active] -= size
            active = active[left[active] > 0]
        end = np.cumsum(number)
        ids = np.empty(int(end[-1]) if len(end) else 0, dtype=np.int32)
        for active, edge, last, count in steps:
            end[active] -= count
            plain = edge < v.size
            ids[end[active[plain]]] = edge[plain]
            for w in (1, 2, 3, 4):
                some = np.flatnonzero(~plain & (count == w))
                if len(some):
                    c = self.points[last[some]]
                    c = np.where(c == _LITERAL, MARK, c)
                    for j in range(w):
                        rest = (c >> (6 * (w - 1 - j))) & 0x3F | 0x80
                        byte = c if w == 1 else np.where(j == 0, (c >> (6 * (w - 1))) | (0xF00 >> w & 0xFF), rest)
                        ids[end[active[some]] + j] = v.byte_ids[byte]
        return ids, number


def encode(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the texts in them). keys: each row's."""
    rows = len(offsets) - 1
    blanks = np.flatnonzero(data == 32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.concatenate([offsets[full], blanks + 1]), kind="stable")
    # a unit ends at the next blank or the end of its text
    ends = np.sort(np.concatenate([offsets[full + 1], blanks]), kind="stable")
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(blanks, offsets)) + (np.diff(offsets) > 0))
    _, first, inverse = np.unique(range_hashes(_BYTE[data], starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    lattices = Lattices(vocabulary, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], alpha)
    per_row = np.bincount(row, minlength=rows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    base = mix(mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(mix_int(seed)))[row] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    ids, number = lattices.sample(inverse, base)
    total = np.concatenate([[0], np.cumsum(number)])
    return ids, total[np.concatenate([[0], np.cumsum(per_row)])]


def decode(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts whose ids these are; the first word mark of each goes."""
    size = np.diff(vocabulary.text_at)[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    data = vocabulary.text_bytes[np.repeat(vocabulary.text_at[ids] - at[:-1], size) + np.arange(at[-1])]
    edges = at[offsets]
    keep = np.ones(len(data), dtype=bool)
    keep[edges[:-1][np.diff(edges) > 0]] = False
    return data[keep], edges - np.concatenate([[0], np.cumsum(np.diff(edges) > 0)])


def sample_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, piece_ids, lossless: whether decoding the ids gave the text."""

    def segment(batches):
        pieces_of = Vocabulary.of(vocabulary)
        for batch in batches:
            texts, data_offsets = batch.column(1), buffers(batch.column(1))
            data, offsets = data_offsets
            keys = batch.column(0).fill_null(0).to_numpy()
            null = texts.is_null().to_numpy(zero_copy_only=False)
            for lo, hi in pieces(offsets, 3 << 19):
                part, inner = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, at = encode(pieces_of, part, inner, keys[lo:hi], alpha, seed)
                back, edges = decode(pieces_of, ids, at)
                same = np.diff(edges) == np.diff(inner)
                if same.all() and np.array_equal(back, part):
                    pass
                else:
                    same &= np.array([back[a:b].tobytes() == part[c:d].tobytes() for a, b, c, d in zip(edges[:-1], edges[1:], inner[:-1], inner[1:])], dtype=bool)
                gone = null[lo:hi]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int32(), mask=gone), lists, pa.array(same, mask=gone)],
                    ["doc_id", "n_pieces", "piece_ids", "lossless"],
                )

    lean = docs.select(ident(id_col).cast("long").alias("doc_id"), ident(text_col).cast("string").alias("text"))
    return lean.mapInArrow(segment, SAMPLED)


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"))
