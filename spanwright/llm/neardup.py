"""Near-duplicates by DartMinHash signatures over weighted shingles (operator 3).

A document's weighted set holds its word trigrams, weighted by how often they occur; a document of
one or two words has all its words as its one element. Conceptually each element owns a quarter-plane of
(weight, rank) on which hashed darts lie with density one. A document hits the darts that lie below its
weight and below rank t / (its total weight), t in the mean whatever its size, and finds them region by region: weights in
[2^v - 1, 2^(v+1) - 1) and ranks in doubling classes, each cut into cells of area one or less that
hold a Poisson number of darts. A dart's hash names one of k coordinates; each coordinate keeps its dart of
least rank. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
A document that left a coordinate empty throws again with twice the darts.

Documents with equal signatures are one vertex. Bands of the signatures give buckets, and pairs of a bucket
whose signatures agree in `threshold` of the coordinates are edges. Connected components, found by alternating
large and small stars, are the groups; the least doc_id of each stays. Two steps find the same components as all
pairs of all buckets would: first every document is paired with its bucket's least doc_id and its predecessor, a
number of pairs linear in the bucket; then, in buckets of four or more that still hold several components, all
pairs of different components are compared, blocks of a bucket's documents in tasks of their own.

Defined results: null and empty texts, and null doc_ids, belong to no group. Rows that repeat a doc_id are one
vertex under the least of their signatures. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.llm.common import buffers, cut, ensure_shared_dir, fresh, ident, mix, pieces, range_hashes, table, unit, word_hashes, word_ranges

K = 128
BANDS = 32
SHINGLE = 3
THRESHOLD = 0.45
#: Expected darts of a document in its first throw: a coordinate stays empty with probability exp(-t / k).
DARTS = 1024
#: Total weight up to which ranks fall into one class.
_BASE = 8192
#: Documents of a bucket that meet in one task; larger buckets are split into pairs of blocks.
CROWD = 16384
_GOLD = 0x9E3779B97F4A7C15


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight), ordered by row and hash."""
    starts, ends, rows = word_ranges(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(rows)
    size = np.minimum(count, n)
    number = np.where(count > 0, count - size + 1, 0)
    row = np.repeat(np.arange(len(count)), number)
    at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + rows[row]
    hashes = range_hashes(words, at, at + size[row])
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    begins = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, int)
    return row[begins], hashes[begins], np.diff(begins, append=len(row))


def _cdf(area: float) -> np.ndarray:
    """The Poisson distribution function of a mean of one or less, as far as doubles tell it from one."""
    term = total = math.exp(-area)
    out = [total]
    for j in range(1, 24):
        term *= area / j
        total += term
        out.append(total)
    return np.array(out)


def throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, darts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, dart) of the darts that each row's elements hit; limit: each row's greatest rank."""
    r0 = darts / _BASE
    out_row, out_rank, out_dart = [], [], []
    most = float(limit.max()) if len(limit) else 0.0
    v = 0
    while len(row):
        w_lo, w_width = float((1 << v) - 1), float(1 << v)
        r, inside, r_lo, r_hi = 0, np.arange(len(row)), 0.0, r0
        while r_lo < most and len(inside):
            cells = max(1, math.ceil(w_width * (r_hi - r_lo)))
            height = (r_hi - r_lo) / cells
            area = w_width * height
            base = element[inside] + np.uint64(((v * 64 + r + 1) * _GOLD) & (2**64 - 1))
            owner, cell_lo = inside, None
            if cells > 1:
                used = np.minimum(cells, np.ceil((limit[row[inside]] - r_lo) / height)).astype(np.int64)
                owner = np.repeat(inside, used)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(used) - used, used)
                base = np.repeat(base, used) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
                cell_lo = r_lo + nth * height
            key = mix(base)
            u = unit(key)
            cdf = _cdf(area)
            hit = np.flatnonzero(u >= cdf[0])
            if len(hit):
                number = np.searchsorted(cdf, u[hit], "right")
                who = np.repeat(hit, number)
                j = np.arange(len(who)) - np.repeat(np.cumsum(number) - number, number)
                dart = mix(key[who] + (j + 1).astype(np.uint64) * np.uint64(_GOLD))
                at_w = w_lo + w_width * unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))
                at_r = (r_lo if cell_lo is None else cell_lo[who]) + height * unit(mix(dart ^ np.uint64(0x14057B7EF767814F)))
                who = owner[who]
                good = (at_w < weight[who]) & (at_r < limit[row[who]])
                out_row.append(row[who[good]]), out_rank.append(at_r[good]), out_dart.append(dart[good])
            r += 1
            r_lo, r_hi = r_hi, 2 * r_hi
            inside = inside[limit[row[inside]] > r_lo]
        v += 1
        more = weight >= (1 << v)
        row, element, weight = row[more], element[more], weight[more]
    if not out_row:
        return np.zeros(0, int), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_rank), np.concatenate(out_dart)


def signatures(data: np.ndarray, offsets: np.ndarray, k: int = K, darts: int = DARTS, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have words, and their signatures: uint32 [rows, k]."""
    row, element, weight = weighted_shingles(data, offsets, n)
    rows = np.unique(row)
    total = np.bincount(row, weights=weight, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1)
    out = np.zeros((len(offsets) - 1, k), dtype=np.uint32)
    todo, factor = np.ones(len(row), dtype=bool), 1
    while todo.any():
        with np.errstate(divide="ignore"):
            limit = darts * factor / total
        limit[total == 0] = 0
        live = np.zeros(len(total), dtype=bool)
        live[row[todo]] = True
        at, rank, dart = throw(row[todo], element[todo], weight[todo], np.where(live, limit, 0), darts)
        cell = at * k + (mix(dart ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        cell, dart = cell[first], dart[order[first]]
        filled = np.bincount(cell // k, minlength=len(total)) == k
        good = filled[cell // k]
        out[cell[good] // k, cell[good] % k] = (dart[good] >> np.uint64(32)).astype(np.uint32)
        todo &= ~filled[row]
        factor *= 2
    return rows, out[rows]


def signature_table(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, sig (binary, k little-endian 32-bit integers)."""

    def sign(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in pieces(offsets):
                rows, sigs = signatures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + lo)), pa.array([s.tobytes() for s in sigs], pa.binary())], ["doc_id", "sig"])

    lean = docs.select(ident(id_col).cast("long").alias("doc_id"), ident(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return lean.mapInArrow(sign, "doc_id long, sig binary")


def band_keys(signed: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, bucket: a row for each band; buckets of different bands don't mix."""
    wide = 4 * (k // bands)
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", i * wide + 1, wide)) for i in range(bands)))
    return signed.select("doc_id", F.explode(keys).alias("bucket"))


def agreement(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """a, b of the pairs (a, b, sig_a, sig_b) that agree in `threshold` of the coordinates."""

    def check(batches):
        for batch in batches:
            x, y = (np.frombuffer(buffers(batch.column(i))[0].tobytes(), dtype="<u4").reshape(-1, k) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= threshold))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(check, "a long, b long")


def bridges(ids: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of edges that join different roots' rows as all agreeing pairs of rows would; with two blocks only pairs across them."""
    label = np.unique(roots, return_inverse=True)[1]
    across = len(np.unique(blocks)) > 1
    a, b = [], []
    for i in range(len(ids) - 1):
        apart = label[i + 1 :] != label[i]
        if across:
            apart &= blocks[i + 1 :] != blocks[i]
        rest = np.flatnonzero(apart) + i + 1
        if not len(rest):
            continue
        hit = rest[(sigs[rest] == sigs[i]).mean(axis=1) >= threshold]
        if len(hit):
            a.append(np.full(len(hit), ids[i])), b.append(ids[hit])
            label[np.isin(label, label[hit])] = label[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def crowded_edges(placed: DataFrame, roots: DataFrame, heads: DataFrame, k: int, threshold: float, crowd: int) -> DataFrame:
    """a, b: edges between components (node, root) that share one of the buckets (bucket, doc_id)."""
    inside = Window.partitionBy("bucket")
    known = placed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = known.withColumns({"lo": F.min("root").over(inside), "hi": F.max("root").over(inside), "n": F.count(F.lit(1)).over(inside)}).where("lo <> hi")
    number = F.ceil(F.col("n") / crowd).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), number).cast("int")
    # a bucket has a task for each of its blocks and for each two of them
    tasks = mixed.select("bucket", "doc_id", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), number - 1)).alias("mate"))
    tasks = tasks.select("bucket", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("two"), "doc_id", "root", "block")
    full = tasks.join(heads, "doc_id").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "doc_id")

    def compare(batches):
        def edges(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(rows)
            ids, roots, blocks = (part[c].to_numpy() for c in ("doc_id", "root", "block"))
            sigs = np.frombuffer(b"".join(buffers(r.column(4))[0].tobytes() for r in rows), dtype="<u4").reshape(-1, k)
            a, b = bridges(ids, roots, blocks, sigs, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            begins = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
            for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)]):
                if held and tuple(keys[lo]) != now:
                    yield edges(held)
                    held = []
                now = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo).select(["bucket", "doc_id", "root", "block", "sig"]))
        if held:
            yield edges(held)

    return full.select("bucket", "one", "two", "doc_id", "root", "block", "sig").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (a, b) other than a root, the least node of its component.

    Alternates large stars (link each greater neighbour to the least one) and small stars (link each
    lesser neighbour to the least one) until nothing changes. Each round's edges are written to the shared folder.
    """
    ensure_shared_dir(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: (u, v). For each u the least of its v and itself takes the v's place."""
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        linked = pairs.withColumn("m", least)
        if large:
            return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        return linked.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b")).where("a <> b")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True).distinct()
        after = cut(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct())
        told = mark(after)
        if told == seen:
            break
        now, seen = after, told
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, duplicate_of: each document that another one of its group, the least doc_id, stands for."""
    if k % bands:
        raise ValueError("k must be a multiple of bands")
    signed = cut(signature_table(docs, k, id_col, text_col))
    # equal signatures are one vertex; a repeated doc_id keeps the least of its signatures
    one = signed.groupBy("doc_id").agg(F.min("sig").alias("sig"))
    same = Window.partitionBy("code").orderBy("doc_id")
    coded = cut(one.select("doc_id", F.xxhash64("sig").alias("code")).withColumn("head", F.first("doc_id").over(same)))
    equal = coded.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    heads = one.join(coded.where("doc_id = head").select("doc_id"), "doc_id", "left_semi")
    bucket = Window.partitionBy("bucket")
    inside = bucket.orderBy("doc_id")
    placed = cut(band_keys(heads, k, bands).withColumns({"least": F.first("doc_id").over(inside), "last": F.lag("doc_id").over(inside), "n": F.count(F.lit(1)).over(bucket)}).where("n > 1"))
    pairs = placed.where("last is not null").select(F.col("doc_id").alias("a"), F.explode(F.array("least", "last")).alias("b")).distinct()
    left = heads.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = heads.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    roots = components(agreement(pairs.join(left, "a").join(right, "b"), k, threshold).union(equal))
    # in buckets of two or three these were all pairs
    more = cut(crowded_edges(placed.where("n > 3").select("bucket", "doc_id"), roots, heads, k, threshold, crowd).distinct())
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that near_duplicates() names; of rows that share a doc_id the one of least text hash stays, rows without one all do."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    key = fresh(docs, "gone")
    kept = docs.join(gone.select(F.col("doc_id").alias(key)), ident(id_col) == F.col(key), "left_anti")
    repeated = kept.where(ident(id_col).isNotNull()).groupBy(ident(id_col).alias(key)).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return kept
    # of a repeated id's rows the least hash of the text stays, then the least text and the least row as JSON
    turn, tie, row = fresh(docs, "turn"), F.xxhash64(ident(text_col)), F.to_json(F.struct(*(ident(c) for c in docs.columns)))
    order = Window.partitionBy(ident(id_col)).orderBy(tie, ident(text_col), row)
    several = kept.join(repeated, ident(id_col) == F.col(key), "left_semi").withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn)
    single = kept.join(repeated, ident(id_col) == F.col(key), "left_anti")  # null ids among them
    return single.unionByName(several)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
