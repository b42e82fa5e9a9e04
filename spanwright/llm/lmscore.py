"""Unbounded n-gram scoring over sharded suffix arrays of the corpus (operator 10).

Tokens are words, runs without ASCII white space, by 64-bit hash. Each task cuts its documents into shards of
about SHARD_WORDS tokens and sorts each shard's suffixes, read backwards, so that the occurrences of a context
are one range, which grows leftwards by binary search. A document's end ends every match. For each
token of each scored text a shard reports the longest context before it that it has, how often, and how often with
the token after it. Only shards that have the longest context of all shards add to its counts:

    p(token | text before) = (count(context token) + ALPHA * p1(token)) / (count(context) + ALPHA)
    p1(token) = (count(token) + 1) / (tokens + types)

where `types` counts the corpus' distinct words and one for unknown ones.
What the shards report, the words' counts among it, grows with the corpus: the corpus is read once, and the one table
of reports, written to the shared folder, gives the matches, the words' counts and their number.

Texts to score are hashed where they lie and go to the shards in chunks of at most CHUNK_WORDS tokens (one text more),
which bounds what is broadcast. Where there are several chunks, the shards are written to the shared folder once, with
their suffix arrays, and each chunk reads them.

Defined results: a null or empty text has no tokens, null log-probabilities and zero matches. Null ids stay;
repeated rows are scored each. Null and empty documents add nothing; with an empty corpus every p is 1.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.common import buffers, cut, ident, pieces, table, word_hashes, word_ranges

ALPHA = 1.0
SHARD_WORDS = 1_000_000
CHUNK_WORDS = 2_000_000

#: Rows of matches (row, pos, length, with_context, with_token) and of words' counts (word, n).
REPORT = "row long, pos int, length int, with_context long, with_token long, word long, n long"


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer sequence; a shorter suffix comes before those it begins.

    Prefix doubling that sorts only what is still tied.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    new = np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]] if n else np.zeros(0, bool)
    head = np.flatnonzero(new)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = head[np.cumsum(new) - 1]  # a group's rank is the place of its first member
    size = np.diff(head, append=n)
    tied = np.repeat(size > 1, size)
    slots = np.flatnonzero(tied)
    k = 1
    while len(slots):
        who = order[slots]
        after = rank[np.minimum(who + k, n)]
        group = rank[who]
        by = np.lexsort((after, group))
        who, after, group = who[by], after[by], group[by]
        order[slots] = who
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        head = np.flatnonzero(new)
        rank[who] = slots[head][np.cumsum(new) - 1]
        size = np.diff(head, append=len(slots))
        slots = slots[np.repeat(size > 1, size)]
        k *= 2
    return order


class Shard:
    """Documents' tokens backwards, each document followed by a mark that no text has, and their suffix array."""

    def __init__(self, vocabulary: np.ndarray, text: np.ndarray, order: np.ndarray):
        self.vocabulary, self.text, self.order = vocabulary, text, order
        self.tokens = int(np.count_nonzero(text >= 0))

    @classmethod
    def of(cls, tokens: list[np.ndarray]) -> "Shard":
        words = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        vocabulary, codes = np.unique(words, return_inverse=True)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        # place of each token in the backward text: documents in turn, tokens reversed, one mark after each
        document = np.repeat(np.arange(len(tokens)), lengths)
        begin = np.cumsum(lengths) - lengths
        text = np.empty(len(words) + len(tokens), dtype=np.int64)
        local = np.arange(len(words)) - begin[document]
        text[begin[document] + document + lengths[document] - 1 - local] = codes
        marks = np.cumsum(lengths) + np.arange(len(tokens))
        # marks sort before all tokens and differ from each other, so that no match runs past one
        text[marks] = np.arange(len(tokens)) - len(tokens)
        return cls(vocabulary, text, suffix_array(text))

    def counts(self) -> np.ndarray:
        """How often each word of the vocabulary occurs."""
        return np.bincount(self.text[self.text >= 0], minlength=len(self.vocabulary))

    def stored(self) -> list[bytes]:
        return [self.vocabulary.tobytes(), self.text.astype("<i4").tobytes(), self.order.astype("<i4").tobytes()]

    @classmethod
    def read(cls, vocabulary: bytes, text: bytes, order: bytes) -> "Shard":
        return cls(np.frombuffer(vocabulary, np.uint64), np.frombuffer(text, "<i4").astype(np.int64), np.frombuffer(order, "<i4").astype(np.int64))

    def longest(self, query: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of query: the longest context before it that occurs here, how often, and how often with the place's token.

        begins: where the text that holds each place begins; contexts don't reach before it.
        """
        n = len(query)
        place = np.searchsorted(self.vocabulary, query)
        code = np.where((place < len(self.vocabulary)) & (self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == query), place, -10) if len(self.vocabulary) else np.full(n, -10)
        length, count = np.zeros(n, np.int64), np.full(n, self.tokens, np.int64)
        # ranges[d]: (ends, counts) for which the d tokens before an end occur; an end n is the place after the last
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.arange(1, n + 1)
        floor = begins
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        depth = 0
        while len(ends):
            good = ends - 1 - depth >= floor
            ends, floor, lo, hi = ends[good], floor[good], lo[good], hi[good]
            want = code[ends - 1 - depth]
            good = want >= 0
            ends, floor, lo, hi, want = ends[good], floor[good], lo[good], hi[good], want[good]
            if not len(ends):
                break
            lo, hi = self._bound(lo, hi, depth, want, False), self._bound(lo, hi, depth, want, True)
            good = hi > lo
            ends, floor, lo, hi = ends[good], floor[good], lo[good], hi[good]
            depth += 1
            steps.append((ends, hi - lo))
            same_text = np.zeros(len(ends), bool)
            inside = ends < n
            same_text[inside] = begins[ends[inside]] == floor[inside]
            at = ends[same_text]
            length[at], count[at] = depth, (hi - lo)[same_text]
        both = np.zeros(n, np.int64)
        for d, (ends, number) in enumerate(steps, 1):
            # the token at end - 1 after d - 1 tokens: what a context of length d - 1 needs
            mine = length[ends - 1] == d - 1
            both[ends[mine] - 1] = number[mine]
        return length, count, both

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
        lo, hi, last = lo.copy(), hi.copy(), len(self.text) - 1
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            spot = self.order[mid] + depth
            has = np.where(spot <= last, self.text[np.minimum(spot, last)], -(1 << 62))
            right = has <= want[open_] if after else has < want[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]


def shards_of(batches, column: int, shard_words: int):
    """The tokens of the documents of Arrow batches, gathered to shards of about shard_words; a longer document is a shard of its own."""
    held, number = [], 0
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for lo, hi in pieces(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, rows = word_ranges(part, offsets[lo : hi + 1] - offsets[lo])
            words = word_hashes(part, starts, ends)
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                if b > a:
                    if held and number + b - a > shard_words:
                        yield held
                        held, number = [], 0
                    held.append(words[a:b])
                    number += b - a
    if held:
        yield held


def tokenised(batches):
    """(row, words) of Arrow batches (row, text): the text's words' hashes as bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for lo, hi in pieces(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, rows = word_ranges(part, offsets[lo : hi + 1] - offsets[lo])
            words = word_hashes(part, starts, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([words[a:b].tobytes() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())], pa.binary())], ["row", "words"]
            )


def _word_rows(shard: Shard) -> pa.RecordBatch:
    n = len(shard.vocabulary)
    none = [pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, pa.array(shard.vocabulary.view(np.int64)), pa.array(shard.counts().astype(np.int64))], ["row", "pos", "length", "with_context", "with_token", "word", "n"])


def _searcher(shared, shards, words_too: bool):
    """A function from Arrow batches to reports: the matches of a chunk of queries in the shards that `shards` makes of the batches."""

    def search(batches):
        row, pos, query, begins = shared.value
        n = len(query)
        best, with_context, with_token, any_shard = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), False
        for shard in shards(batches):
            any_shard = True
            if words_too:
                yield _word_rows(shard)
            length, count, both = shard.longest(query, begins)
            longer, same = length > best, length == best
            with_context = np.where(longer, count, np.where(same, with_context + count, with_context))
            with_token = np.where(longer, both, np.where(same, with_token + both, with_token))
            best = np.maximum(best, length)
        if any_shard:
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(pos), pa.array(best.astype(np.int32)), pa.array(with_context), pa.array(with_token), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                ["row", "pos", "length", "with_context", "with_token", "word", "n"],
            )

    return search


def _chunk(rows: DataFrame):
    """(row, pos, words, begins) of a bounded number of tokenised texts."""
    held = rows.toArrow()
    words = [np.frombuffer(x.as_py(), np.uint64) for x in held["words"]]
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(held["row"].to_numpy(), lengths) if held.num_rows else np.zeros(0, np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return row.astype(np.int64), (np.arange(len(flat)) - begins).astype(np.int32), flat, begins


def score(queries: DataFrame, corpus: DataFrame, query_id: str = "item_id", query_text: str = "text", corpus_text: str = "text", alpha: float = ALPHA, shard_words: int = SHARD_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """A row per query row: item_id, n_tokens, log2_prob, bits_per_token, mean_match, longest_match."""
    spark = queries.sparkSession
    asked = cut(queries.select(F.monotonically_increasing_id().alias("row"), ident(query_id).cast("long").alias("item_id"), ident(query_text).cast("string").alias("text")))
    texts = cut(asked.where("text is not null").select("row", "text").mapInArrow(tokenised, "row long, words binary").where("octet_length(words) > 0").withColumn("size", (F.octet_length("words") / 8).cast("long")))
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # chunks by hash hold half of the bound on average; a longer text is a chunk's rest
    chunks = max(1, -(-2 * total // chunk_words)) if total > chunk_words else 1
    placed = texts.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    lean = corpus.select(ident(corpus_text).cast("string").alias("text")).where("text is not null")
    built = lambda batches: (Shard.of(tokens) for tokens in shards_of(batches, 0, shard_words))

    if chunks == 1:
        shared = spark.sparkContext.broadcast(_chunk(placed))
        reports = cut(lean.mapInArrow(_searcher(shared, built, True), REPORT))
        shared.unpersist()
    else:

        def keep(batches):
            for shard in built(batches):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.stored()], ["vocabulary", "text", "order"])

        def stored(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield Shard.read(*(batch.column(j)[i].as_py() for j in range(3)))

        shards = cut(lean.mapInArrow(keep, "vocabulary binary, text binary, `order` binary"))
        parts = []
        for c in range(chunks):
            shared = spark.sparkContext.broadcast(_chunk(placed.where(F.col("chunk") == c)))
            parts.append(cut(shards.mapInArrow(_searcher(shared, stored, c == 0), REPORT)))
            shared.unpersist()
        reports = parts[0]
        for part in parts[1:]:
            reports = reports.union(part)
    counts = reports.where("word is not null").groupBy("word").agg(F.sum("n").alias("n1"))
    whole = counts.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("tokens"), (F.count(F.lit(1)) + 1).alias("types"))  # one row
    summed = reports.where("row is not null").groupBy("row", "pos", "length").agg(F.sum("with_context").alias("with_context"), F.sum("with_token").alias("with_token"))
    longest = summed.groupBy("row", "pos").agg(F.max_by(F.struct("length", "with_context", "with_token"), "length").alias("m"))

    def spread(batches):
        for batch in batches:
            words = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            lengths = [len(w) for w in words]
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]) if lengths else np.zeros(0, np.int32)
            flat = np.concatenate(words) if words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), lengths)), pa.array(pos), pa.array(flat)], ["row", "pos", "word"])

    places = texts.select("row", "words").mapInArrow(spread, "row long, pos int, word long")
    known = places.join(counts, "word", "left").join(longest, ["row", "pos"], "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(c, F.lit(0))
    p1 = (zero(F.col("n1")) + 1) / (F.col("tokens") + F.col("types"))
    bits = F.log2((zero(F.col("m.with_token")) + alpha * p1) / (zero(F.col("m.with_context")) + alpha))
    per = known.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum(bits).alias("log2_prob"), F.avg(zero(F.col("m.length"))).alias("mean_match"), F.max(zero(F.col("m.length"))).alias("longest_match"))
    return asked.select("row", "item_id").join(per, "row", "left").select(
        "item_id",
        zero(F.col("n")).cast("int").alias("n_tokens"),
        F.round("log2_prob", 6).alias("log2_prob"),
        F.round(-F.col("log2_prob") / F.col("n"), 6).alias("bits_per_token"),
        F.round(F.coalesce("mean_match", F.lit(0.0)), 6).alias("mean_match"),
        F.coalesce("longest_match", F.lit(0)).cast("int").alias("longest_match"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text scored by all documents."""
    return score(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
