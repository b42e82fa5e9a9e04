"""Corpus operators against brute force, round trips and hard inputs."""

import base64
import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwright.llm import langid, lmscore, media, neardup, packing, sampling, substring, tokens, topk, warc
from spanwright.llm.common import buffers
from spanwright.session import ship

DOCS = "doc_id long, text string, lang string, block int, Text2 string, gone string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    ship(spark)
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = text(60), text(200)
    rows = [(i, text(rng.randint(1, 120)), "en") for i in range(60)]
    rows += [(100, base, "en"), (101, base, "en"), (102, base + " " + text(3), "en"), (103, " ".join(base.split()[5:]), "en")]
    rows += [(110, text(80) + " " + shared + " " + text(80), "en"), (111, text(90) + "\n" + shared + "\t" + text(70), "en"), (112, shared, "en")]
    rows += [(120, "", "en"), (121, None, "en"), (None, text(40), None), (None, None, None), (122, "   \n", "de"), (123, text(3000), "en"), (124, text(5), "en"), (124, text(5), "en"), (1, rows[1][1], "en")]
    return [(*r, 1, "x", "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1


def bfd(lengths, most):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(most - n)
    return sorted(most - r for r in rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        most = rng.randint(1, 30)
        lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 60))]
        used: collections.Counter = collections.Counter()
        for length, lo, hi, first, per, offset in packing.plan_slots(collections.Counter(lengths), most):
            for r in range(lo, hi):
                assert offset + (r - lo) % per * length + length <= most
                used[first + (r - lo) // per] += length
        assert sorted(used.values()) == bfd(lengths, most)


def test_packing_rows(spark, docs, corpus):
    rows = packing.best_fit_pack(docs, 100).collect()
    spans = collections.defaultdict(list)
    for r in rows:
        assert r["bin_offset"] + r["n_words"] <= 100
        spans[r["bin_id"]].append((r["bin_offset"], r["n_words"]))
    for v in spans.values():
        v.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(v, v[1:]))
    lengths = [min(100, len(t.split()) - k) for _, t, *_ in corpus if t for k in range(0, len(t.split()), 100)]
    assert sorted(sum(n for _, n in v) for v in spans.values()) == bfd(lengths, 100)
    assert packing.best_fit_pack(empty(spark)).count() == 0


# -- 2


def brute_repeats(corpus, size):
    """(doc_id, start, end, removed) by words, occurrences ordered by doc_id, nulls last."""
    rows = [(d, t.split()) for d, t, *_ in corpus if t]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    seen = collections.defaultdict(list)
    for i, (_, w) in enumerate(rows):
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])].append((i, k))
    out = []
    for i, (d, w) in enumerate(rows):
        hot, extra = [False] * len(w), [False] * len(w)
        for k in range(len(w) - size + 1):
            places = seen[tuple(w[k : k + size])]
            if len(places) > 1:
                for j in range(k, k + size):
                    hot[j] = True
                    extra[j] = extra[j] or places[0] != (i, k)
        for flag, run in itertools.groupby(range(len(w)), key=lambda j: hot[j]):
            run = list(run)
            if flag:
                out.append((d, run[0], run[-1] + 1, sum(extra[j] for j in run)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_repeats_are_exact(spark, docs, corpus, block_bytes):
    got = sorted((tuple(r) for r in substring.repeated_spans(docs, block_bytes=block_bytes).collect()), key=repr)
    assert got == brute_repeats(corpus, 50) and len(got) >= 8


def test_cut_keeps_everything_else(spark, docs, corpus):
    out = substring.cut_repeats(docs, block_bytes=2000)
    assert out.columns == docs.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert left[(100, corpus[60][1])] == 1 and (101, corpus[60][1]) not in left and not any(d == 101 for d, _ in left)
    assert left[(121, None)] == 1 and left[(120, "")] == 1 and left[(None, None)] == 1 and left[(122, "   \n")] == 1
    removed = sum(r[3] for r in brute_repeats(corpus, 50))
    before, after = sum(len(t.split()) for _, t, *_ in corpus if t), sum(len(t.split()) * n for (_, t), n in left.items() if t)
    assert before - after == removed
    assert substring.cut_repeats(empty(spark)).count() == 0 and substring.repeated_spans(empty(spark)).count() == 0


# -- 3


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)]
    texts = [" ".join(base)] + [" ".join(rng.choice(base) if rng.random() < p else w for w in base) for p in (0.02, 0.1, 0.3)]
    data, offsets = buffers(pa.array(texts))
    _, sig = neardup.signatures(data, offsets, 1024, 8 * 1024)
    bags = [collections.Counter(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    for i, j in itertools.combinations(range(4), 2):
        exact = sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values())
        assert abs((sig[i] == sig[j]).mean() - exact) < 0.06


def test_near_duplicates(spark, docs):
    got = {(r["doc_id"], r["duplicate_of"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(101, 100), (102, 100), (103, 100)}
    kept = neardup.drop_near_duplicates(docs)
    ids = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[1] == 1 and ids[124] == 1 and ids[None] == 2 and 101 not in ids and ids[121] == 1 and kept.columns == docs.columns
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_repeated_ids_have_one_defined_survivor(spark):
    rows = [(7, f"text number {i} of one id", i) for i in range(20)] + [(7, None, 99), (8, "", 1), (None, "a b c", 1), (None, "a b c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, turn int")
    hashed = {r["text"]: r["h"] for r in df.where("doc_id = 7 and text is not null").select("text", F.xxhash64("text").alias("h")).collect()}
    for n in (1, 5):
        kept = sorted((tuple(r) for r in neardup.drop_near_duplicates(df.repartition(n)).collect()), key=repr)
        assert [k for k in kept if k[0] is None] == [(None, "a b c", 1)] * 2 and [k for k in kept if k[0] == 8] == [(8, "", 1)]
        (mine,) = [k for k in kept if k[0] == 7]
        least = min([*hashed.items(), (None, 42)], key=lambda x: x[1])[0]  # the hash of a null is the seed
        assert mine[1] == least


@pytest.mark.parametrize("crowd", [neardup.CROWD, 3])
def test_mixed_buckets_lose_no_pair(spark, crowd):
    """Pairs of about 0.5 whose boilerplate, below 0.3, puts many of them into one bucket; against all pairs of all buckets."""
    shared = [f"b{i}" for i in range(90)]
    texts = [" ".join([*shared, *(f"g{i % 400}w{j}" for j in range(50)), *(f"t{i}n{j}" for j in range(64))]) for i in range(800)]
    _, sigs = neardup.signatures(*buffers(pa.array(texts)))
    banded = sigs.reshape(len(sigs), neardup.BANDS, -1)
    root = np.arange(len(sigs))
    for i in range(len(sigs) - 1):
        met = (banded[i + 1 :] == banded[i]).all(axis=2).any(axis=1) & ((sigs[i + 1 :] == sigs[i]).mean(axis=1) >= neardup.THRESHOLD)
        same = np.unique(np.r_[root[i], root[i + 1 :][met]])
        root[np.isin(root, same)] = same[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["duplicate_of"] for r in neardup.near_duplicates(df, crowd=crowd).collect()}
    assert got == {i: r for i, r in enumerate(root.tolist()) if i != r} and len(got) > 200


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# -- 4


def test_jpeg_thumbnails_and_damage():
    rng = np.random.default_rng(0)
    for w, h, sampling_, restart in [(8, 8, [(1, 1)], 0), (33, 17, [(1, 1)], 2), (50, 70, [(2, 2), (1, 1), (1, 1)], 0), (50, 70, [(2, 1), (1, 1), (1, 1)], 3)]:
        mh, mv = max(a for a, _ in sampling_), max(b for _, b in sampling_)
        across, down = -(-w // (8 * mh)), -(-h // (8 * mv))
        planes = [rng.integers(0, 256, (down * v * 8, across * x * 8)).astype(np.uint8) for x, v in sampling_]
        image = media.encode(planes, sampling_, (w, h), 2, restart)
        width, height, n, thumb = media.decode(image)
        means = planes[0].astype(float).reshape(planes[0].shape[0] // 8, 8, -1, 8).mean((1, 3))[: -(-h // 8), : -(-w // 8)]
        assert (width, height, n) == (w, h, len(sampling_)) and np.abs(thumb - means).max() <= 1
        for cut in range(0, len(image) - 2, 7):
            try:
                media.decode(image[:cut])
            except media.BadImage:
                pass


def reference_means(image):
    """Block means of the first component of a one-scan JPEG with 1 x 1 sampling throughout, decoded bit by bit from a string of bits."""
    tables, at = {}, 2
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body, at = image[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while body:
                code, symbols, place = 0, {}, 17
                for size in range(1, 17):
                    for _ in range(body[size]):
                        symbols[format(code, f"0{size}b")] = body[place]
                        code, place = code + 1, place + 1
                    code *= 2
                tables[body[0]], body = symbols, body[place:]
        elif marker == 0xDB:
            step = body[1]
        elif marker == 0xC0:
            height, width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
        elif marker == 0xDA:
            break
    bits = "".join(format(x, "08b") for x in image[at:-2].replace(b"\xff\x00", b"\xff"))
    spot = 0

    def symbol(table):
        nonlocal spot
        for size in range(1, 17):
            if bits[spot : spot + size] in table:
                spot += size
                return table[bits[spot - size : spot]]
        raise ValueError("no code")

    def number(size):
        nonlocal spot
        spot += size
        raw = bits[spot - size : spot]
        return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

    down, across = -(-height // 8), -(-width // 8)
    out, last = [], [0] * n
    for _ in range(down * across):
        for c in range(n):
            last[c] += number(symbol(tables[0]))
            if c == 0:
                out.append(last[0] * step / 8 + 128)
            k = 1
            while k < 64:
                s = symbol(tables[16])
                if s == 0:
                    break
                number(s & 15)
                k += (s >> 4) + 1
    return np.array(out).reshape(down, across)


def test_decoder_against_a_bit_by_bit_one():
    """Huffman tables of the standard's annex in a hand-made file, and images of the encoder."""
    rng = np.random.default_rng(8)
    for w, h, n in ((40, 24, 1), (17, 65, 3)):
        planes = [rng.integers(0, 256, (-(-h // 8) * 8, -(-w // 8) * 8)).astype(np.uint8) for _ in range(n)]
        image = media.encode(planes, [(1, 1)] * n, (w, h), 3)
        assert np.abs(media.decode(image)[3] - reference_means(image)).max() <= 0.5
    # one grey 16 x 8 image by hand: DC table of the standard, AC with an end of block alone in one bit
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    head = part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xFE, b"by hand") + part(0xDB, b"\0" + b"\x08" * 64) + part(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += part(0xC4, b"\0" + dc) + part(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0") + part(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    # DC +5 (size 3: code 100, value 101), end 0; DC -20 (size 5: code 110, value 01011), end 0; ones to the byte's end
    bits = "100" + "101" + "0" + "110" + "01011" + "0"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    width, height, n, thumb = media.decode(b"\xff\xd8" + head + data + b"\xff\xd9")
    assert (width, height, n, thumb.tolist()) == (16, 8, 1, [[133, 113]])


def test_colour_spaces():
    red, green, blue = (np.full((8, 8), x, np.uint8) for x in (200, 100, 40))
    image = media.encode([red, green, blue], [(1, 1)] * 3, (8, 8), 1, names=b"RGB")
    assert abs(int(media.decode(image)[3][0, 0]) - (0.299 * 200 + 0.587 * 100 + 0.114 * 40)) <= 1
    plain = media.encode([red, green, blue], [(1, 1)] * 3, (8, 8), 1)
    assert media.decode(plain)[3][0, 0] == 200
    adobe = lambda transform: b"\xff\xee\0\x0eAdobe\0\x64\0\0\0\0" + bytes([transform])
    assert media.decode(plain[:2] + adobe(0) + plain[2:])[3][0, 0] == media.decode(image)[3][0, 0]
    assert media.decode(plain[:2] + adobe(1) + plain[2:])[3][0, 0] == 200
    four = media.encode([red, green, blue, red], [(1, 1)] * 4, (8, 8), 1)
    with pytest.raises(media.BadImage, match="CMYK"):
        media.decode(four)
    odd = media.encode([np.full((16, 16), 9, np.uint8), green, blue], [(2, 2), (1, 1), (1, 1)], (16, 16), 1, names=b"RGB")
    with pytest.raises(media.BadImage, match="sampled"):
        media.decode(odd)


def test_damaged_bytes_never_break_a_batch(spark):
    rng = random.Random(7)
    good = media.render(b"some page " * 40)
    rows = []
    for i in range(400):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows.append((i, bytes(bad), "x", None))
    df = spark.createDataFrame(rows, "media_id long, image binary, thumbnail string, error string")
    out = media.media_columns(df).collect()
    assert len(out) == 400 and all((r["error"] is None) == (r["thumbnail"] is not None) for r in out)
    assert media.media_columns(df.limit(0)).count() == 0


def test_pages_are_drawn_whole(spark):
    """The last byte of a long page moves its image; null pages have none."""
    long = b"<p>" + bytes(range(32, 127)) * 60
    assert media.render(long + b"a") != media.render(long + b"~")
    width, height, _, thumb = media.decode(media.render(long))
    assert width * height >= len(long) and thumb.size >= len(long) // 64
    pages = spark.createDataFrame([(1, "x" * 500), (2, None), (3, ""), (None, "y")], "page_id long, html string")
    got = {r["media_id"]: r["image"] for r in media.page_images(pages).collect()}
    assert got[2] is None and got[3] is not None and got[None] is not None and media.page_images(pages.limit(0)).count() == 0


def test_media_rows(spark):
    good = media.render(b"hello")
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:-20]), (6, good.replace(b"\xff\xc0", b"\xff\xc2")), (None, good), (1, good)]
    out = media.media_columns(spark.createDataFrame(rows, "media_id long, image binary")).collect()
    assert [r["error"] for r in out] == [None, "null", "empty", "no JPEG", "cut off", "progressive", None, None]
    assert out[0]["thumbnail"] == out[6]["thumbnail"] and out[1]["width"] is None


# -- 5


def test_archive_round_trip(spark):
    head = lambda n, digest="": f"WARC/1.0\r\nContent-Length: {n}\r\nWARC-Payload-Digest: {digest}\r\n\r\n".encode()
    body = b"\x00\xffabc\r\n\r\nx"
    records = [(1, head(len(body)) + body + b"\r\n\r\n"), (2, head(len(body)) + body), (3, head(0)), (4, b"no blank line"), (5, head(99) + b"short"), (6, head(1, "sha256:00") + b"y"), (None, head(1) + b"y"), (7, None), (1, head(len(body)) + body + b"\r\n\r\n")]
    df = spark.createDataFrame([(i, x, "a", 1, "b") for i, x in records], "record_id long, record binary, digest string, size int, Payload string")
    headers, payloads = warc.archive(df)
    rebuilt = warc.reconstruct(headers, payloads).collect()
    back = collections.Counter((r["record_id"], bytes(r["record"])) for r in rebuilt)
    assert back == collections.Counter((i, x) for i, x in records if x is not None) and all(r["verified"] for r in rebuilt)
    assert payloads.count() == 3  # body, nothing, y
    flags = {r["record_id"]: (r["parsed"], r["digest_ok"]) for r in headers.where("record_id in (4, 5, 6)").collect()}
    assert flags == {4: (False, None), 5: (False, None), 6: (True, False)}
    nothing, none_stored = warc.archive(df.limit(0))
    assert nothing.count() == none_stored.count() == warc.reconstruct(nothing, none_stored).count() == 0


def test_digests_and_http_payloads(spark):
    """Digests as crawlers write them; a response's payload is what follows HTTP's headers."""
    page = "<p>Grüezi</p>".encode()
    sums = {"sha1": hashlib.sha1(page), "sha256": hashlib.sha256(page), "md5": hashlib.md5(page)}
    named = [f"{k}:{v.hexdigest()}" for k, v in sums.items()] + [f"{k}:{base64.b32encode(sums[k].digest()).decode()}" for k in ("sha1", "sha256")]
    named += [f"sha1:{base64.b32encode(hashlib.sha1(b'other').digest()).decode()}", "sha1:short", "blake3:00", ""]
    http = b"HTTP/1.1 200 OK\r\nX: \xe9\r\n\r\n"

    def record(digest, kind, content, block):
        field = f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: {content}\r\n{field}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    rows = [(i, record(d, "response", "application/http; msgtype=response", http + page)) for i, d in enumerate(named)]
    rows += [(100, record(named[0], "resource", "text/html", page)), (101, record("", "response", "application/http", b"no headers"))]
    headers, payloads = warc.archive(spark.createDataFrame(rows, "record_id long, record binary"))
    assert {bytes(r["payload"]): r["n_records"] for r in payloads.collect()} == {page: len(named) + 1, b"no headers": 1}
    agrees = {r["record_id"]: r["digest_ok"] for r in headers.collect()}
    assert agrees == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: None, 8: None, 100: True, 101: None}
    assert {(r["record_id"], bytes(r["record"])) for r in warc.reconstruct(headers, payloads).collect()} == set(rows)
    broken = payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    assert not any(r["verified"] for r in warc.reconstruct(headers, broken).collect())


# -- 6


def kneser_ney(texts, order, alphabet):
    """p(c | context) of an interpolated Kneser-Ney model from counts in plain Python; words stand between blanks.

    Grams of full order, and those that begin a word, count occurrences; others how many characters are seen before them.
    """
    grams = [collections.Counter() for _ in range(order + 1)]
    ahead = [collections.defaultdict(set) for _ in range(order + 1)]
    for word in " ".join(texts).split():
        padded = " " + word + " "
        for end in range(1, len(padded)):
            for n in range(1, order + 1):
                if end - n + 1 >= 0:
                    gram = padded[end - n + 1 : end + 1]
                    grams[n][gram] += 1
                    if end - n >= 0:
                        ahead[n][gram].add(padded[end - n])
    count = lambda n, g: grams[n][g] if n == order or (n > 1 and g[0] == " ") or not ahead[n][g] else len(ahead[n][g])
    tables = {}
    for n in range(1, order + 1):
        counts = {g: count(n, g) for g in grams[n]}
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        by_context = collections.defaultdict(dict)
        for g, v in counts.items():
            by_context[g[:-1]][g[-1]] = v
        tables[n] = (once / (once + 2 * twice) if once and twice else 0.5, by_context)

    def p(c, context):
        n = len(context) + 1
        lower = p(c, context[1:]) if context else 1 / alphabet
        discount, by_context = tables[n]
        seen = by_context.get(context)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen.get(c, 0) - discount, 0) / total + discount * len(seen) / total * lower

    return lambda c, context: p(c, context[-(order - 1) :] if order > 1 else "")


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_against_counts_in_plain_python(order):
    texts = {"a": ["abab abc cab ba", "abcab"], "b": ["xyx yx xyz", "zyx xx"]}
    letters = sorted({c for t in texts.values() for c in "".join(t)})
    models = langid.Models(texts, order)
    alphabet = len(letters) + 1  # one for all characters that no language has
    for i, lang in enumerate("ab"):
        p = kneser_ney(texts[lang], order, alphabet)
        for word in ("abc", "xyz", "b", "qab", "axb", "abababab"):
            expected, context = 0.0, " "
            for c in word + " ":
                expected -= np.log2(p(c, context))
                context += c
            assert abs(models.score([word.encode()])[0][0, i] - expected) < 1e-3, (lang, word)
        for context in (" ", " a", " ab", " x", " zz"):  # all characters and the one unknown make one
            total = sum(p(c, context) for c in [*letters, "?"])
            assert abs(total - 1) < 1e-9


def test_identification(spark):
    ship(spark)
    rng = random.Random(4)
    langs = {"en": ["the", "of", "and", "house", "tion"], "de": ["der", "und", "nicht", "haus", "keit"]}
    rows = [(i, " ".join(rng.choice(langs[lang]) + rng.choice(["", "er", "s"]) for _ in range(rng.randint(5, 60))), lang) for i in range(400) for lang in (["en", "de"][i % 2],)]
    rows += [(1000, "qqzx 99%% ## qqx zzkw %%$ xxqk " * 20, None), (1001, "", "en"), (1002, None, "de"), (None, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(out[i]["language"] == lang for i, _, lang in rows[:400])
    assert not out[1000]["accepted"] and not out[1001]["accepted"] and not out[1002]["accepted"] and out[1002]["bits_per_char"] is None
    assert out[None]["language"] == "en"
    kept = langid.identify(df, keep=True)
    assert kept.columns == df.columns and kept.count() == 401
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert not langid.identify(none).first()["accepted"]
    assert langid.identify(df.limit(0)).count() == 0


def test_training_without_ids_and_odd_columns(spark):
    """Null and repeated ids don't empty a label's sample; ties, repeated rows, very long texts and clashing names do no harm."""
    rng = random.Random(6)
    parts = {"en": ["the", "of", "and", "house"], "de": ["der", "und", "nicht", "haus"]}
    say = lambda lang, n: " ".join(rng.choice(parts[lang]) + rng.choice(["", "er", "s"]) for _ in range(n))
    rows = [(None if i % 2 else 1, say(lang, rng.randint(5, 40)), lang, "x", 1.0) for lang in parts for i in range(120)]
    rows += [rows[0], rows[0], (5, say("de", 200_000), None, "y", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string, key double")
    sample = langid.training_sample(df, 10, "doc_id", "text", "lang")
    assert {k: len(v) for k, v in sample.items()} == {"en": 10, "de": 10}
    assert sample == langid.training_sample(df.repartition(5), 10, "doc_id", "text", "lang")
    out = langid.identify(df).collect()
    assert len(out) == len(rows) and all(r["language"] is not None for r in out) and [r["language"] for r in out if r["doc_id"] == 5] == ["de"]
    kept = langid.identify(df, keep=True)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_labelled_junk_moves_no_limit():
    rng = random.Random(11)
    parts = {"en": ["the", "of", "and", "house", "tion"], "de": ["der", "und", "nicht", "haus", "keit"]}
    say = lambda lang: " ".join(rng.choice(parts[lang]) + rng.choice(["", "er", "s"]) for _ in range(rng.randint(5, 60)))
    noise = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40))
    labelled = {lang: [say(lang) for _ in range(500)] for lang in parts}
    for texts in labelled.values():
        texts[::25] = [noise("#%$&*0123456789") for _ in texts[::25]]  # 4 percent, all of them held out
    who = langid.Identifier(labelled)
    judged = lambda texts: who.accepts(*who.models.judge(*buffers(pa.array(texts))))
    assert not judged([noise("ыжшщюячэ") for _ in range(20)] + [noise("#%$&*0123456789") for _ in range(20)]).any()
    assert judged([say(lang) for lang in parts for _ in range(100)]).all()


# -- 7


def test_top_k_is_exact(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    vectors = (centres[rng.integers(0, 5, 230)] + 0.1 * rng.normal(size=(230, 16))).tolist()
    vectors[7] = vectors[3]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 16), (None, vectors[0]), (903, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array(vectors)
    for every, tile_queries, tile_rows in ((1, 1000, 1000), (1, 64, 50), (20, 1000, 100)):
        got = collections.defaultdict(list)
        for r in topk.top_k(df, 7, every, 40, tile_queries, tile_rows).orderBy("vec_id", "neighbor_rank").collect():
            got[r["vec_id"]].append(r["neighbor_id"])
        for i in range(0, 230, every):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            assert got[i] == sorted(range(230), key=lambda j: (d[j], j))[:7]
        assert len(got) == -(-230 // every)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_hard_tables(spark):
    """A malformed first row, repeated ids, fewer than k others, and columns with clashing names."""
    ship(spark)
    rows = [(0, [9.0], "a", 1), (1, [0.0, 0.0], "b", 2), (2, [1.0, 0.0], "c", 3), (2, [3.0, 0.0], "d", 4), (4, [], "e", 5), (6, [0.0, 2.0], "f", 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side string, grp int")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, every=2).collect())
    assert got == [(2, 1, 1, 1.0), (2, 1, 1, 9.0), (2, 2, 6, 5.0), (2, 2, 6, 13.0), (6, 1, 1, 4.0), (6, 2, 2, 5.0), (6, 3, 2, 13.0)]


# -- 8 and 9


def test_token_rows(spark, docs, corpus):
    """Nulls, repeated rows and clashing names among them: every text comes back as often as it went in."""
    rows = tokens.pack_tokens(docs, 64).collect()
    encoder = tokens.Encoder.of(tokens.VOCABULARY, tokens.END)
    pieces = collections.Counter()
    for r in rows:
        ids, positions, cu = np.frombuffer(bytes(r["ids"]), "<u2"), np.frombuffer(bytes(r["positions"]), "<u2"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64
        for a, b, doc, start in zip(cu, cu[1:], r["doc_ids"], r["starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[doc, start, tuple(ids[a:b].tolist())] += 1
    expected = collections.Counter()
    for d, t, *_ in corpus:
        if t is not None:
            own = [*encoder.encoding.encode(t, disallowed_special=()), tokens.END]
            expected.update((d, i, tuple(own[i : i + 64])) for i in range(0, len(own), 64))
    assert pieces == expected and pieces[1, 0, tuple([*encoder.encoding.encode(corpus[1][1]), tokens.END][:64])] == 2
    assert tokens.pack_tokens(empty(spark)).count() == 0


def test_token_rows_do_not_depend_on_the_layout(spark, docs, monkeypatch):
    monkeypatch.setattr(tokens, "BUCKET_BYTES", 9000)
    seen = [sorted(tuple(map(str, r)) for r in tokens.pack_tokens(docs.repartition(n, "text"), 64).collect()) for n in (1, 7)]
    assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == len(seen[0])
    monkeypatch.setattr(tokens, "FLUSH_TOKENS", 200)
    parts = tokens.pack_tokens(docs, 64).collect()
    assert len({r["row_id"] for r in parts}) == len(parts) and sum(r["n_tokens"] for r in parts) == sum(int(r[1]) for r in seen[0])


def test_token_ids_are_as_wide_as_the_vocabulary(spark, tmp_path):
    """A vocabulary whose ranks pass 65,535 although the end token doesn't."""
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % (i + 70_000 * (i == 97)) for i in range(256)))
    df = spark.createDataFrame([(1, "aab")], "doc_id long, text string")
    row = tokens.pack_tokens(df, 8, str(path), 5, 5).first()
    assert np.frombuffer(bytes(row["ids"]), "<u4")[:4].tolist() == [70_097, 70_097, 98, 5]


def test_best_fit_rows():
    rng = random.Random(0)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        row, n = tokens.best_fit_decreasing(np.array(lengths, dtype=np.int64), 20)
        assert sorted(np.bincount(row, weights=lengths, minlength=n).astype(int).tolist() if lengths else []) == bfd(lengths, 20)


def test_segmentations_are_sampled_right_and_lossless(spark, docs):
    v = sampling.Vocabulary.of(sampling.VOCABULARY)
    odd = ["  a  b\n\n c ", "", " ", "▁x ▁", "\U0001f600 é　ü", "hello world", "\n", "a\x00b", "x" * 5000]
    data, offsets = buffers(pa.array(odd))
    ids, at = sampling.encode(v, data, offsets, np.arange(len(odd)), 1.0, 1)
    back, edges = sampling.decode(v, ids, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:])] == odd
    for i, text in enumerate(odd):
        one = sampling.encode(v, *buffers(pa.array([text])), np.array([i]), 1.0, 1)[0]
        assert one.tolist() == ids[at[i] : at[i + 1]].tolist()
    by_text = {v.text_bytes[v.text_at[i] : v.text_at[i + 1]].tobytes().decode("utf-8", "ignore"): i for i in range(v.size) if v.score[i] > -np.inf}
    weight = {}
    for cuts in itertools.product([0, 1], repeat=5):
        parts, last = [], " "
        for cut, c in zip(cuts, "there"):
            parts, last = ([*parts, last], c) if cut else (parts, last + c)
        parts.append(last)
        if all(p in by_text for p in parts):
            weight[tuple(by_text[p] for p in parts)] = float(np.exp(sum(v.score[by_text[p]] for p in parts)))
    n, total = 60_000, sum(weight.values())
    ids, at = sampling.encode(v, *buffers(pa.array(["there"] * n)), np.arange(n), 1.0, 7)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    assert set(seen) <= set(weight) and max(abs(seen[p] / n - w / total) for p, w in weight.items()) < 0.01
    out = sampling.sample_pieces(docs).collect()
    assert all(r["lossless"] or r["lossless"] is None for r in out) and sum(r["piece_ids"] is None for r in out) == 2
    assert sampling.sample_pieces(empty(spark)).count() == 0


# -- 10


def test_lm_scores_match_brute_force(spark):
    ship(spark)
    rng = random.Random(3)
    corpus = [[rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(12)]
    queries = [[rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(5)]
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(corpus)] + [(99, None), (98, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(queries)] + [(50, None), (51, ""), (None, "a b")], "item_id long, text string")
    n, types = sum(map(len, corpus)), 1 + len({c for d in corpus for c in d})

    def count(gram):
        return sum(d[i : i + len(gram)] == gram for d in corpus for i in range(len(d) - len(gram) + 1)) if gram else n

    for shard, chunk in ((1_000_000, 2_000_000), (10, 8)):
        out = {r["item_id"]: r for r in lmscore.score(asked, docs, shard_words=shard, chunk_words=chunk).collect()}
        for k, q in enumerate(queries):
            total, longest = 0.0, 0
            for i in range(len(q)):
                size = max(m for m in range(i + 1) if count(q[i - m : i]) > 0)
                p1 = (count(q[i : i + 1]) + 1) / (n + types)
                total += np.log2((count(q[i - size : i + 1]) + p1) / (count(q[i - size : i]) + 1))
                longest = max(longest, size)
            assert abs(out[k]["log2_prob"] - total) < 1e-4 and out[k]["longest_match"] == longest
        assert out[50]["n_tokens"] == 0 and out[51]["log2_prob"] is None and out[None]["n_tokens"] == 2
    odd = spark.createDataFrame([(1, "a b a", "r", 1), (1, "a b a", "r", 1), (2, "a " * 3000, "s", 2)], "item_id long, text string, row string, word int")
    twice = lmscore.score(odd, docs.withColumn("word", F.lit(1)), chunk_words=100).collect()
    assert len(twice) == 3 and twice.count([r for r in twice if r["item_id"] == 1][0]) == 2 and [r["n_tokens"] for r in twice if r["item_id"] == 2] == [3000]
    assert lmscore.score(asked, docs.limit(0)).where("item_id = 0").first()["log2_prob"] == 0
    assert lmscore.score(asked.limit(0), docs).count() == 0


# -- the pipeline


def test_run_gives_what_the_stages_give(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["the", "of", "and", "house", "nation", "river", "stone", "light"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "er", "s", "ing"]) for _ in range(n))
    rows = [(i, text(rng.randint(20, 200)), "en") for i in range(60)]
    rows += [(90, rows[4][1], "en"), (91, rows[5][1] + " " + rows[6][1], "en"), (92, None, "en"), (None, rows[7][1], None), (90, rows[4][1], "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, bucket int"
    df = spark.createDataFrame([(d, t, lang, "s", len(t or ""), "g", 1) for d, t, lang in rows], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    as_set = lambda frame: sorted(map(repr, frame.collect()))
    assert as_set(corpus_pipeline.run(spark, str(tmp_path))) == as_set(docs) and docs.count() > 50
    nothing = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, str(tmp_path))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == df.columns)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["the", "of", "and", "house", "nation", "river", "stone", "light"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "er", "s", "ing"]) for _ in range(n))
    shared = text(70)
    rows = [(i, text(rng.randint(20, 90)), "en") for i in range(80)]
    rows += [(200, rows[3][1], "en"), (201, text(200) + " " + shared, "en"), (202, text(200) + " " + shared, "en"), (203, "", "en"), (204, None, None), (205, "%%# 88$ ~~ ^^| " * 40, None)]
    df = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs, sizes = df, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == df.columns
    kept = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in sizes]
    assert kept[0] == {d for d, t, _ in rows if t} - {205}
    assert kept[1] == kept[0] - {200}
    cut = {r["doc_id"]: r for r in sizes[2].collect()}
    assert len(cut[202]["text"].split()) == 200 and cut[202]["n_chars"] == len(cut[202]["text"]) and len(cut[201]["text"].split()) == 270
    assert kept[3] == kept[2] == kept[1]
    assert sizes[3].agg(F.sum("n_words")).first()[0] == sum(len(r["text"].split()) for r in cut.values())
