"""Best-fit packing planned over a histogram of lengths (operator 1).

A document's length is its number of words, runs without ASCII white space. A document longer than
the capacity is cut into full pieces and a rest, so that nothing is lost. The histogram of piece
lengths, bounded by the capacity and not by the corpus, comes to the driver, which runs best-fit
decreasing over counts: all bins with one remaining capacity are one group. Documents then take
the planned slots by joining on their rank within their length.

Defined results: null, empty and blank texts have no words and take no slot; a null doc_id is
packed like any other and stays null; repeated rows take one slot each; an empty table gives no
rows; columns besides the id and the text are ignored, whatever their names. Ties within a length
are ranked by salt, doc_id (nulls first), hash of the text and piece.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.llm.common import cut, ident, table

CAPACITY = 2048
#: Ranks are counted within (length, salt), so that no length, however frequent, is one task's work.
SALTS = 16
PLAN_SCHEMA = "p_length int, p_salt int, nth_lo long, nth_hi long, skipped long, bin_lo long, per_bin int, offset_lo int"
#: Plan rows up to which the planned slots are broadcast; more are joined by shuffle, on the same keys (length, salt).
BROADCAST_ROWS = 200_000


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_lo, rank_hi, bin_lo, per_bin, offset_lo) per run of slots.

    The piece of rank r takes bin bin_lo + (r - rank_lo) // per_bin, at
    offset_lo + (r - rank_lo) % per_bin * length. The bins are those of best-fit decreasing over single documents: a bin
    that is the best fit stays so for documents of the same length until they no longer fit.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    rooms: list[int] = []  # remaining capacities that some open bin has, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    rows, bins = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than `each` are left: they share one bin
                rows.append((length, rank, rank + left, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(room, first + full, n - full)
    return rows


def salted_slots(plan: list[tuple], bases: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The plan's runs cut at the salts' edges: (length, salt, nth_lo, nth_hi, skipped, bin_lo, per_bin, offset_lo), nth counted within (length, salt).

    bases: (length, salt, rank of the salt's first piece, pieces), ascending, as are a length's runs. skipped: the run's slots before nth_lo.
    """
    runs: dict[int, list[tuple]] = {}
    for run in plan:
        runs.setdefault(run[0], []).append(run)
    out, at = [], dict.fromkeys(runs, 0)
    for length, salt, base, n in bases:
        mine, i = runs[length], at[length]
        while i < len(mine):
            _, lo, hi, first, each, offset = mine[i]
            a, b = max(lo, base), min(hi, base + n)
            if a < b:
                out.append((length, salt, a - base, b - base, a - lo, first, each, offset))
            if hi > base + n:
                break
            i += 1
        at[length] = i
    return out


def piece_lengths(docs: DataFrame, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie, piece, start_word, length: a row for each piece of each document that has words."""
    words = F.regexp_count(F.col("text"), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("int")
    counted = docs.select(ident(id_col).alias("doc_id"), ident(text_col).cast("string").alias("text")).select(
        "doc_id", F.xxhash64("text").alias("tie"), words.alias("n")
    )
    parts = F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)
    return (
        counted.where(F.col("n") > 0)
        .select("doc_id", "tie", "n", F.explode(parts).alias("piece"))
        .select("doc_id", "tie", "piece", (F.col("piece") * capacity).alias("start_word"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("length"))
    )


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start_word, n_words, bin_id, bin_offset: where each piece of each document goes."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(SALTS)).cast("int").alias("salt")
    lengths = cut(piece_lengths(docs, capacity, id_col, text_col).select("*", salt))
    counts = lengths.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity * SALTS rows
    histogram: dict[int, int] = {}
    bases = []
    for row in sorted(counts):
        bases.append((row["length"], row["salt"], histogram.get(row["length"], 0), row["n"]))
        histogram[row["length"]] = histogram.get(row["length"], 0) + row["n"]
    slots = salted_slots(plan_slots(histogram, capacity), bases)
    planned = spark.createDataFrame(slots, PLAN_SCHEMA)
    planned = F.broadcast(planned) if len(slots) <= BROADCAST_ROWS else planned
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "tie", "piece")
    ranked = lengths.withColumn("nth", F.row_number().over(within) - 1)
    same = (F.col("length") == F.col("p_length")) & (F.col("salt") == F.col("p_salt"))
    step = F.col("skipped") + F.col("nth") - F.col("nth_lo")
    return ranked.join(planned, same & (F.col("nth") >= F.col("nth_lo")) & (F.col("nth") < F.col("nth_hi"))).select(
        "doc_id",
        "piece",
        "start_word",
        F.col("length").alias("n_words"),
        (F.col("bin_lo") + F.floor(step / F.col("per_bin"))).alias("bin_id"),
        (F.col("offset_lo") + F.pmod(step, F.col("per_bin")) * F.col("length")).cast("int").alias("bin_offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
