"""Language identification by interpolated Kneser-Ney character models (operator 6).

One model of order ORDER per language, over code points of lower-cased words; a word is a run without ASCII
white space, its context starts at the blank before it, and the blank after it is scored as its end. Word
by word the same sums result as over the text, and each distinct word of a batch is scored once.

For every order one ascending array holds the hashes of all n-grams that any language has, and one column per
language their interpolated probability; a second one holds the contexts' back-off weights. An n-gram that no
language has takes its context's weight times the probability of the order below. The text belongs to the
language of least cross-entropy per character (ties: the first by name).

Training fits a classifier, so it takes a bounded sample: per language the `train_docs` documents of least hash
by (doc_id, text) that carry its label; every fifth of them is held out. On these the rejection is calibrated: each
language's median m of bits per character, the deviation s of words^(1/2) * (bits - m), and the greatest
z = words^(1/2) * (bits - m) / s and bits - m of the usual texts, those within TRIM deviations in both. Deviations are
scaled medians of absolute values, so a few bad rows move no limit. Rejected are documents that exceed both by the
factor MARGIN, and those without words.

Defined results: null, empty and blank texts have no language, no bits and are not accepted. A null doc_id is
judged like any other. Rows with a null label train nothing; without any label at all nothing is accepted.
Repeated rows repeat their result. An empty table gives no rows. Other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.llm.common import buffers, ident, mix, pieces, table, word_hashes, word_ranges

ORDER = 5
TRAIN_DOCS = 500
#: Deviations beyond which a held-out document is unusual and sets no limit.
TRIM = 12.0
#: How far beyond the worst usual held-out document, as a factor of its z, a document must be to be rejected.
MARGIN = 1.5
#: Deviations of n held-out texts are widened by SMALL / n for their own error.
SMALL = 8.0
_STEP = 0x9E3779B97F4A7C15


def code_points(words: list[bytes]) -> np.ndarray:
    """The words, lower-cased, each between blanks: ' one two ' as code points."""
    text = " " + b" ".join(words).decode("utf-8", "replace").lower() + " "
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order the hash of the n code points that end at each place; 0 where a blank lies before the last but not first.

    A blank may only begin an n-gram (the word's start) or end it (the word's end).
    """
    n = len(points)
    blank = points == 32
    out = [mix(points + np.uint64(1))]
    run = out[0].copy()
    legal = np.ones(n, dtype=bool)
    for k in range(1, order):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[k:] = mix(points[: max(0, n - k)] + np.uint64((1 + k * _STEP) & (2**64 - 1)))
        inner = np.zeros(n, dtype=bool)
        if k > 1:
            inner[k - 1 :] = blank[: max(0, n - k + 1)]
        legal = legal & ~inner
        legal[:k] = False
        run = run + shifted
        out.append(np.where(legal, mix(run), np.uint64(0)))
    return out


class Models:
    """Kneser-Ney models of several languages in sorted hash arrays."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        counts = [self._counts(samples[lang]) for lang in self.languages]
        size = len(self.languages)
        self.grams: list[np.ndarray] = []
        self.probability: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        alphabet = len(np.unique(np.concatenate([c[0][0] for c in counts] or [np.zeros(0, np.uint64)]))) + 1
        for n in range(order):
            hashes = np.unique(np.concatenate([c[n][0] for c in counts] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(np.concatenate([c[n][1] for c in counts] or [np.zeros(0, np.uint64)]))
            p = np.zeros((len(hashes), size))
            weight = np.ones((len(contexts), size))
            for i, c in enumerate(counts):
                gram, context, number, lower = c[n]
                if not len(gram):
                    continue
                once, twice = (number == 1).sum(), (number == 2).sum()
                discount = once / (once + 2.0 * twice) if once and twice else 0.5
                keys, where = np.unique(context, return_inverse=True)
                total = np.bincount(where, weights=number)
                kinds = np.bincount(where)
                back = discount * kinds / total
                weight[np.searchsorted(contexts, keys), i] = back
                seen = np.searchsorted(hashes, gram)
                p[seen, i] = np.maximum(number - discount, 0) / total[where]
            # interpolation: add the context's weight times the order below
            own_context, below = self._links(n, hashes, counts)
            if n == 0:
                w = weight[np.searchsorted(contexts, own_context)] if len(contexts) else np.ones((len(hashes), size))
                p += w / alphabet
            else:
                w = weight[np.searchsorted(contexts, own_context)]
                p += w * self.probability[n - 1][np.searchsorted(self.grams[n - 1], below)]
            self.grams.append(hashes), self.probability.append(p), self.contexts.append(contexts), self.weight.append(weight)
        self.floor = 1.0 / alphabet
        self.log_p = [np.log2(p).astype(np.float32) for p in self.probability]
        self.log_w = [np.log2(np.maximum(w, 1e-12)).astype(np.float32) for w in self.weight]

    def _counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per n: distinct n-grams, their contexts' hashes, their counts (continuation counts below the highest order), the n-gram without its first."""
        words = [w for t in texts for w in t.encode("utf-8", "replace").split()]
        points = code_points(words)
        hashes = gram_hashes(points, self.order)
        context = self._contexts(points, hashes)
        out: list = [None] * self.order
        upper = None
        for n in reversed(range(self.order)):
            scored = np.arange(len(points)) > 0
            good = scored & (hashes[n] != 0 if n else scored)
            gram, first, number = np.unique(hashes[n][good], return_index=True, return_counts=True)
            place = np.flatnonzero(good)[first]
            number = number.astype(np.float64)
            if upper is not None:  # how many different characters come before it; counts where only a word's start can
                ups = hashes[n + 1][upper]
                kinds = np.bincount(np.searchsorted(gram, hashes[n][upper]), minlength=len(gram)) if len(ups) else np.zeros(len(gram))
                starts = np.zeros(len(gram), dtype=bool)
                begins = np.zeros(len(points), dtype=bool)
                begins[n:] = points[: max(0, len(points) - n)] == 32
                if n:
                    starts[np.searchsorted(gram, hashes[n][good & begins])] = True
                number = np.where(starts | (kinds == 0), number, kinds)
            out[n] = (gram, context[n][place], number, hashes[n - 1][place] if n else gram)
            upper = place
        return out

    @staticmethod
    def _contexts(points: np.ndarray, hashes: list[np.ndarray]) -> list[np.ndarray]:
        """The hash of the n code points before each place, for n = 0 .. order - 1, marked apart from n-grams."""
        out = [np.full(len(points), 7, dtype=np.uint64)]
        for h in hashes[:-1]:
            shifted = np.zeros(len(points), dtype=np.uint64)
            shifted[1:] = mix(h[:-1] ^ np.uint64(0x5BF0_3635_AE5F_1D2B))
            out.append(shifted)
        return out

    @staticmethod
    def _links(n: int, hashes: np.ndarray, counts) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram its context and its n-gram of one less, from whichever language has it."""
        own, below = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
        for c in counts:
            at = np.searchsorted(hashes, c[n][0])
            own[at], below[at] = c[n][1], c[n][3]
        return own, below

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language [words, languages], and the characters scored in each."""
        points = code_points(words)
        hashes = gram_hashes(points, self.order)
        context = self._contexts(points, hashes)
        bits = np.zeros((len(points), len(self.languages)), dtype=np.float64)
        todo = np.arange(1, len(points))
        for n in reversed(range(self.order)):
            legal = todo[hashes[n][todo] != 0] if n else todo
            rest = todo[hashes[n][todo] == 0] if n else todo[:0]
            place = np.minimum(np.searchsorted(self.grams[n], hashes[n][legal]), max(0, len(self.grams[n]) - 1))
            found = self.grams[n][place] == hashes[n][legal] if len(self.grams[n]) else np.zeros(len(legal), bool)
            bits[legal[found]] -= self.log_p[n][place[found]]
            legal = legal[~found]
            if len(self.contexts[n]):
                place = np.minimum(np.searchsorted(self.contexts[n], context[n][legal]), len(self.contexts[n]) - 1)
                found = self.contexts[n][place] == context[n][legal]
                bits[legal[found]] -= self.log_w[n][place[found]]
            todo = np.sort(np.concatenate([legal, rest]))
        bits[todo] -= np.log2(self.floor)
        ends = np.flatnonzero(points == 32)
        if not len(words):
            return np.zeros((0, len(self.languages))), np.zeros(0, int)
        total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits[1:], axis=0)])
        return total[ends[1:]] - total[ends[:-1]], np.diff(ends)

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's number, bits per character in it, words) of each text; -1 where it has no words."""
        starts, ends, rows = word_ranges(data, offsets)
        codes, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        bits, chars = self.score([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        count = np.diff(rows)
        best, least = np.full(len(count), -1), np.full(len(count), np.nan)
        full = np.flatnonzero(count)
        if len(full) and self.languages:
            sums = np.add.reduceat(bits[inverse], rows[full], axis=0)
            length = np.add.reduceat(chars[inverse], rows[full])
            per = sums / length[:, None]
            best[full] = per.argmin(axis=1)
            least[full] = per.min(axis=1)
        return best, least, count


class Identifier:
    """Models with their calibrated limits."""

    def __init__(self, labelled: dict[str, list[str]], order: int = ORDER, margin: float = MARGIN):
        held = {k: v[::5] if len(v) >= 10 else v for k, v in labelled.items()}
        self.models = Models({k: [t for i, t in enumerate(v) if i % 5 or len(v) < 10] for k, v in labelled.items()}, order)
        self.mean, self.deviation, self.limit = {}, {}, {}
        for i, lang in enumerate(self.models.languages):
            data, offsets = buffers(pa.array(held[lang], pa.large_string()))
            best, bits, words = self.models.judge(data, offsets)
            mine = best == i
            # a repeated text counts once
            _, once = np.unique(bits[mine], return_index=True)
            bits, root = bits[mine][once], np.sqrt(words[mine][once])
            m = float(np.median(bits)) if len(bits) else 0.0
            drift = bits - m
            s, spread = (max(1.4826 * float(np.median(x)), 1e-6) if len(bits) else 1e-6 for x in (root * np.abs(drift), np.abs(drift)))
            s *= 1 + SMALL / max(1, len(bits))
            z = root * drift / s
            usual = (z <= TRIM) & (drift <= TRIM * spread)
            self.mean[i], self.deviation[i] = m, s
            self.limit[i] = (margin * float(z[usual].max(initial=3.0)), margin * float(drift[usual].max(initial=0.0)))

    def accepts(self, best: np.ndarray, bits: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Not beyond the limits: neither the deviation for its number of words nor what the usual held-out texts of its language have."""
        good = np.zeros(len(best), dtype=bool)
        for i in self.mean:
            mine = best == i
            z = np.sqrt(words[mine]) * (bits[mine] - self.mean[i]) / self.deviation[i]
            good[mine] = (z <= self.limit[i][0]) | (bits[mine] - self.mean[i] <= self.limit[i][1])
        return good


def training_sample(docs: DataFrame, train_docs: int, id_col: str, text_col: str, label_col: str) -> dict[str, list[str]]:
    """Per label the texts of the train_docs rows of least hash, in the order of hash; read through a hash bound, not a sort."""
    key = F.xxhash64(F.coalesce(ident(id_col).cast("string"), F.lit("")), ident(text_col).cast("string"))
    rows = docs.select(ident(label_col).cast("string").alias("label"), ident(text_col).cast("string").alias("text"), key.alias("key")).where("label is not null and text is not null and text <> ''")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    # a bound that leaves about four times the sample of each label; the rest is never sorted or moved
    bound = F.lit(None).cast("long")
    for label, n in counts.items():
        share = min(1.0, 4.0 * train_docs / n)
        bound = F.when(F.col("label") == label, F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).otherwise(bound)
    some = rows.where(F.col("key") <= bound)
    order = Window.partitionBy("label").orderBy("key", "text")
    picked = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= train_docs).orderBy("label", "nth").collect()
    out: dict[str, list[str]] = {}
    for r in picked:
        out.setdefault(r["label"], []).append(r["text"])
    return out


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", keep: bool = False) -> DataFrame:
    """doc_id, language, bits_per_char, accepted; language is null where the document is rejected.

    keep: instead, all of docs' columns of the accepted documents.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Identifier(training_sample(docs, train_docs, id_col, text_col, label_col), order))

    def judged(column: pa.Array):
        data, offsets = buffers(column)
        for lo, hi in pieces(offsets):
            who = shared.value
            best, bits, words = who.models.judge(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield lo, hi, best, bits, who.accepts(best, bits, words)

    if keep:

        def good(batches):
            for batch in batches:
                for lo, hi, _, _, accepted in judged(batch.column(at)):
                    yield batch.slice(lo, hi - lo).filter(pa.array(accepted))

        at = docs.columns.index(text_col)
        return docs.mapInArrow(good, docs.schema)

    def rows(batches):
        for batch in batches:
            for lo, hi, best, bits, accepted in judged(batch.column(1)):
                names = np.array([*shared.value.models.languages, None], dtype=object)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(names[np.where(accepted, best, -1)], pa.string()),
                        pa.array(np.round(bits, 4), pa.float64(), mask=np.isnan(bits)),
                        pa.array(accepted),
                    ],
                    ["doc_id", "language", "bits_per_char", "accepted"],
                )

    lean = docs.select(ident(id_col).cast("long").alias("doc_id"), ident(text_col).cast("string").alias("text"))
    return lean.mapInArrow(rows, "doc_id long, language string, bits_per_char double, accepted boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
