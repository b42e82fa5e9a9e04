"""Exact top-k search by columnar branch and bound (operator 7).

The query set are the vectors whose id is divisible by `every`; each asks for its k nearest among all others by squared
Euclidean distance. Vectors lie in blocks, each as a matrix with one row per dimension. A query block meets the
candidate blocks in turn and keeps each query's k best so far. Against a candidate block distances accumulate over groups of dimensions, those of
greatest variance first; after each group a pair lives on while its distance so far plus the least that the
remaining mass allows, (|q_rest| - |x_rest|)^2, doesn't exceed the query's k-th best. While many pairs live the
next group is added for all of the block's pairs at once; when few do, they are compacted to a list and only they go
on. What survives all groups gets its distance again in double precision, in the order of dimensions, which
alone decides; the bound carries a slack for single precision. So the result is exact.

Queries and candidates meet in tiles: a tile has at most TILE_QUERIES queries, which its task holds, and
TILE_ROWS candidates, which stream past them. So a query is sent once per candidate group and a candidate once per query
group, far less than once per pair of blocks, and nothing is broadcast. Tiles report k rows per query, which a window with a
group limit merges. The work is that of the stated query set against all rows.

Defined results: null vectors, vectors of another length than the most frequent one (of equally frequent ones the
greater), empty ones, and vectors with nulls, NaN or infinities neither ask nor are found; so do rows with a null id. A row that
repeats an id counts as another vector, and no row finds a row of its own id; rows that repeat an id that asks ask each
and give their neighbours each. Ties go to the lesser neighbour id. Fewer than k others: fewer rows. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.llm.common import cut, ident, table

TOP = 10
#: The query set: ids divisible by this, against all rows.
EVERY = 20
BLOCK = 2048
TILE_QUERIES = 65_536
TILE_ROWS = 8_192
GROUPS = 4
#: Below this share of living pairs they are compacted to a list.
SPARSE = 0.05
REPORT = "asker long, vec_id long, neighbor_id long, distance double"


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed dimension by dimension in double precision."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += (q[:, d] - x[:, d]) ** 2
    return total


class Best:
    """The k best of each query of a block so far, by (distance, id)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.distance = np.full((len(ids), k), np.inf)
        self.neighbor = np.full((len(ids), k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        return self.distance[:, -1]

    def add(self, query: np.ndarray, neighbor: np.ndarray, distance: np.ndarray) -> None:
        rows = np.unique(query)
        if not len(rows):
            return
        q = np.concatenate([query, np.repeat(rows, self.k)])
        d = np.concatenate([distance, self.distance[rows].ravel()])
        n = np.concatenate([neighbor, self.neighbor[rows].ravel()])
        order = np.lexsort((n, d, q))
        q, d, n = q[order], d[order], n[order]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        take = (begin[:, None] + np.arange(self.k)).ravel()
        self.distance[rows], self.neighbor[rows] = d[take].reshape(-1, self.k), n[take].reshape(-1, self.k)

    def rows(self, asker: np.ndarray) -> pa.RecordBatch:
        real = np.isfinite(self.distance)
        ids, askers = (np.broadcast_to(x[:, None], real.shape) for x in (self.ids, asker))
        return pa.RecordBatch.from_arrays(
            [pa.array(askers[real]), pa.array(ids[real]), pa.array(self.neighbor[real]), pa.array(self.distance[real])],
            ["asker", "vec_id", "neighbor_id", "distance"],
        )


def meet(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray, groups: int = GROUPS, sparse: float = SPARSE, step: int = 256) -> None:
    """Offer the vectors x (dimensions by rows, like q) to the queries."""
    dims = q.shape[0]
    order = np.argsort(-(x.var(axis=1) + q.var(axis=1)), kind="stable")
    parts = np.array_split(order, min(groups, dims))
    qf, xf = q.astype(np.float32), x.astype(np.float32)
    rest = lambda m: [np.sqrt(np.maximum(sum((m[p] ** 2).sum(axis=0) for p in parts[i + 1 :]), 0)) if i + 1 < len(parts) else np.zeros(m.shape[1]) for i in range(len(parts))]
    q_rest, x_rest = rest(q), rest(x)
    scale = float(max((q**2).sum(axis=0).max(initial=0), (x**2).sum(axis=0).max(initial=0)))
    slack = 1e-5 * scale + 1e-30
    part_norm_q = [(qf[p] ** 2).sum(axis=0) for p in parts]
    part_norm_x = [(xf[p] ** 2).sum(axis=0) for p in parts]
    for lo in range(0, q.shape[1], step):
        some = np.arange(lo, min(lo + step, q.shape[1]))
        if not np.isfinite(best.bound()[some]).all():
            # no bound yet: the nearest of the block by all groups at once give one
            d = sum(part_norm_q[i][some, None] + part_norm_x[i][None, :] - 2.0 * (qf[p][:, some].T @ xf[p]) for i, p in enumerate(parts))
            d[best.ids[some][:, None] == ids[None, :]] = np.inf
            k = min(best.k, d.shape[1])
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            kth = np.take_along_axis(d, near, axis=1).max(axis=1)
            who, which = np.nonzero(d <= np.where(np.isfinite(kth), kth, np.finfo(np.float32).max)[:, None] + 2 * slack)
            keep = np.isfinite(d[who, which])
            who, which = some[who[keep]], which[keep]
            best.add(who, ids[which], exact(q[:, who].T, x[:, which].T))
            continue
        limit = (best.bound()[some] + slack).astype(np.float64)
        dense, who, which, so_far = np.zeros((len(some), x.shape[1]), dtype=np.float32), None, None, None
        for i, p in enumerate(parts):
            if who is None:
                dense += part_norm_q[i][some, None] + part_norm_x[i][None, :]
                dense -= 2.0 * (qf[p][:, some].T @ xf[p])
                if i + 1 < len(parts):
                    gap = q_rest[i][some, None].astype(np.float32) - x_rest[i][None, :].astype(np.float32)
                    alive = dense + gap * gap <= limit[:, None]
                else:
                    alive = dense <= limit[:, None]
                if i + 1 == len(parts) or np.count_nonzero(alive) <= sparse * alive.size:
                    a, which = np.nonzero(alive)
                    so_far, who = dense[a, which].astype(np.float64), some[a]
            else:
                so_far = so_far + ((qf[p][:, who] - xf[p][:, which]) ** 2).sum(axis=0)
                alive = so_far + (q_rest[i][who] - x_rest[i][which]) ** 2 <= limit[who - lo]
                who, which, so_far = who[alive], which[alive], so_far[alive]
            if who is not None and not len(who):
                break
        other = best.ids[who] != ids[which]
        who, which = who[other], which[other]
        if len(who):
            best.add(who, ids[which], exact(q[:, who].T, x[:, which].T))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(asker, id, v of the vectors that take part, their number). asker numbers the rows, so that repeated ids ask apart."""
    rows = vectors.select(ident(id_col).cast("long").alias("id"), ident(vec_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf")))))
    seen = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.agg(F.max(F.struct("n", "dims")).alias("most")).first()["most"]
    if seen is None:
        return rows.withColumn("asker", F.lit(0).cast("long")), 0
    return rows.where(F.size("v") == seen["dims"]).withColumn("asker", F.monotonically_increasing_id()), seen["n"]


def pack_blocks(rows: DataFrame, block: int) -> DataFrame:
    """grp, side, block, askers, ids, vecs: a row per block of the rows (grp, side, asker, id, v), the vectors dimension by dimension."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, side = (batch.column(i).to_numpy() for i in (0, 1))
            asker, ids = (batch.column(i).to_numpy() for i in (2, 3))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.lexsort((ids, side, grp))
            begins = np.flatnonzero(np.r_[True, (np.diff(grp[order]) != 0) | (np.diff(side[order]) != 0)])
            for lo, hi in zip(begins, [*begins[1:], len(order)]):
                for at in range(lo, hi, block):
                    some = order[at : min(at + block, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([grp[some[0]]], pa.int32()), pa.array([side[some[0]]], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (asker[some], ids[some], flat[some].T))],
                        ["grp", "side", "askers", "ids", "vecs"],
                    )

    return rows.select("grp", "side", "asker", "id", "v").mapInArrow(pack, "grp int, side int, askers binary, ids binary, vecs binary")


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, block: int = BLOCK, tile_queries: int = TILE_QUERIES, tile_rows: int = TILE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, neighbor_rank, neighbor_id, distance (squared, 5 digits) of the vectors whose id is divisible by `every`."""
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    rows, n = usable_vectors(vectors, id_col, vec_col)
    rows = cut(rows)
    asks = rows.where(F.pmod("id", F.lit(every)) == 0)
    q_groups, r_groups = max(1, -(-asks.count() // tile_queries)), max(1, -(-n // tile_rows))
    spread = lambda m, salt: F.pmod(F.xxhash64("asker", F.lit(salt)), F.lit(m)).cast("int")
    each_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # side 0: the queries of a tile, which come first; side 1: its candidates
    left = asks.select("asker", "id", "v", spread(q_groups, 1).alias("qg"), each_of(r_groups).alias("rg"), F.lit(0).alias("side"))
    right = rows.select("asker", "id", "v", spread(r_groups, 2).alias("rg"), each_of(q_groups).alias("qg"), F.lit(1).alias("side"))
    both = left.unionByName(right).withColumn("grp", (F.col("qg") * r_groups + F.col("rg")).cast("int"))
    # rows of a tile gather into blocks before they move, so that the shuffle carries few, packed rows
    packed = pack_blocks(both, block)
    tiled = packed.repartitionById(q_groups * r_groups, F.col("grp")).sortWithinPartitions("grp", "side")

    def search(batches):
        now, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                grp, side, askers, ids, vecs = (batch.column(j)[i].as_py() for j in range(5))
                if grp != now:
                    yield from (best.rows(who) for best, _, who in asked)
                    now, asked = grp, []
                own = np.frombuffer(ids, np.int64)
                matrix = np.frombuffer(vecs).reshape(-1, len(own))
                if side == 0:
                    asked.append((Best(own, k), matrix, np.frombuffer(askers, np.int64)))
                else:
                    for best, q, _ in asked:
                        meet(best, q, own, matrix)
        yield from (best.rows(who) for best, _, who in asked)

    found = tiled.mapInArrow(search, REPORT)
    rank = F.row_number().over(Window.partitionBy("asker", "vec_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("neighbor_rank", rank).where(F.col("neighbor_rank") <= k).select("vec_id", "neighbor_rank", "neighbor_id", F.round("distance", 5).alias("distance"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, sum((CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)) * (CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)) ORDER BY a.d) AS dist
  FROM (SELECT * FROM e WHERE vec_id % {EVERY} = 0) a JOIN e b ON a.d = b.d AND a.vec_id <> b.vec_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor_id) AS nth FROM p)
SELECT vec_id, CAST(nth AS INTEGER) AS neighbor_rank, neighbor_id, round(dist, 5) AS distance FROM r WHERE nth <= {TOP}
"""
