"""Media columns from baseline JPEG images (operator 4).

The markers give size, components, quantisation and Huffman tables; the scans' entropy-coded data is
decoded in full, of which only the luminance blocks' DC coefficients are kept: one pixel per 8 x 8 block, the
block's mean. Images that say they are RGB (component names R, G, B, or Adobe's marker without a transform) have the luminance
0.299 R + 0.587 G + 0.114 B of their blocks' means. The thumbnail's hash is the difference hash: 8 x 9 cells of box means, a bit per pair of
neighbours.

Defined results: a null image has null columns and the error 'null'. What can't be decoded - empty, no JPEG, progressive or arithmetic
coding, 12-bit samples, CMYK, RGB whose components are sampled differently, damaged or cut off - has null columns and says why in `error`. A null id stays; repeated rows
repeat their result; an empty table gives no rows. Other columns are ignored, whatever their names.

The test tables hold no images; page_images() renders one per page from its HTML with the encoder below, a pixel per byte, so that
images are as large as the pages are long.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanwright.llm.common import ident, table

MEDIA = "media_id long, width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, thumb_hash long, error string"
_FRAMES = {0xC1: "extended", 0xC2: "progressive", 0xC3: "lossless", 0xC5: "differential", 0xC6: "differential", 0xC7: "differential", 0xC9: "arithmetic", 0xCA: "arithmetic", 0xCB: "arithmetic", 0xCD: "arithmetic", 0xCE: "arithmetic", 0xCF: "arithmetic"}
#: Places of the zigzag order in a block's rows.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


class BadImage(ValueError):
    """Why an image can't be decoded."""


def _codes_of(spec: bytes):
    """(first, end, symbol, bits) by the next 16 bits of each code. spec: 16 counts, then symbols."""
    counts, symbols = spec[:16], spec[16:]
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
            if hi > 65536 or at >= len(symbols):
                raise BadImage("bad Huffman table")
            yield lo, hi, symbols[at], bits
            code, at = code + 1, at + 1
        code <<= 1


@functools.lru_cache(maxsize=256)
def dc_table(spec: bytes) -> list[int]:
    """size << 5 | code length by the next 16 bits; 0 where no code fits or the size is too large."""
    out = np.zeros(65536, np.int64)
    for lo, hi, symbol, bits in _codes_of(spec):
        out[lo:hi] = symbol << 5 | bits if symbol <= 11 else 0
    return out.tolist()


#: What an end of block adds to the place in it; more than any run.
_END = 1 << 10


@functools.lru_cache(maxsize=256)
def ac_table(spec: bytes) -> list[int]:
    """places passed << 5 | bits of code and value, by the next 16 bits; 0 where no code fits."""
    out = np.zeros(65536, np.int64)
    for lo, hi, symbol, bits in _codes_of(spec):
        run, size = symbol >> 4, symbol & 15
        passed = run + 1 if size else 16 if symbol == 0xF0 else _END if symbol == 0 else None
        out[lo:hi] = 0 if passed is None else passed << 5 | bits + size
    return out.tolist()


class Scan:
    """Entropy-coded data as bits."""

    def __init__(self, data: bytes):
        # a zero byte follows each 0xFF; ones pad the end
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at, self.held, self.bits = 0, 0, 0
        self.most = 8 * len(self.data)

    def block(self, dc: list[int], ac: list[int]) -> int:
        """Decode a block; its DC difference."""
        held, bits, k = self.held, self.bits, 0
        value = 0
        while k < 64:
            if bits < 64:
                some = self.data[self.at : self.at + 48]
                self.at += 48
                held = (held & ((1 << bits) - 1)) << 384 | int.from_bytes(some + b"\xff" * (48 - len(some)), "big")
                bits += 384
            if k:
                step = ac[held >> bits - 16 & 0xFFFF]
                if not step:
                    raise BadImage("bad AC code")
                bits -= step & 31
                k += step >> 5
            else:
                step = dc[held >> bits - 16 & 0xFFFF]
                if not step:
                    raise BadImage("bad DC code")
                size = step >> 5
                bits -= (step & 31) + size
                value = held >> bits & (1 << size) - 1
                if size and not value >> size - 1:
                    value -= (1 << size) - 1
                k = 1
        if 64 < k < _END:
            raise BadImage("bad run of zeros")
        self.held, self.bits = held, bits
        if 8 * self.at - bits > self.most:
            raise BadImage("cut off")
        return value


def decode(image: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, DC thumbnail of the luminance as uint8 [rows, columns])."""
    if image[:2] != b"\xff\xd8":
        raise BadImage("no JPEG" if image else "empty")
    tables: dict[int, list[int]] = {}
    steps: dict[int, int] = {}
    frame: list[tuple[int, int, int, int]] = []
    width = height = restart = 0
    adobe, planes = None, {}
    at = 2
    while True:
        while at < len(image) and image[at] != 0xFF:
            at += 1
        while at < len(image) and image[at] == 0xFF:
            at += 1
        if at >= len(image):
            break
        marker = image[at]
        at += 1
        if marker == 0xD9:
            break
        if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > len(image) or at + (size := int.from_bytes(image[at : at + 2], "big")) > len(image) or size < 2:
            raise BadImage("cut off")
        body = image[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                    raise BadImage("bad quantisation table")
                steps[name] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                if len(body) < 17 or len(body) < 17 + (n := sum(body[1:17])):
                    raise BadImage("bad Huffman table")
                tables[body[0]] = (ac_table if body[0] >> 4 else dc_table)(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            if frame or len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise BadImage("bad frame")
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise BadImage("not 8 bits a sample")
            if not (width and height and n):
                raise BadImage("no size")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in frame):
                raise BadImage("bad sampling")
        elif marker in _FRAMES:
            raise BadImage(_FRAMES[marker])
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not frame or not body or len(body) < 1 + 2 * body[0] + 3:
                raise BadImage("bad scan")
            end = at
            while True:  # the data ends at a marker that isn't a restart
                end = image.find(b"\xff", end)
                if end < 0 or end + 1 >= len(image):
                    end = len(image)
                    break
                if image[end + 1] == 0 or 0xD0 <= image[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            names = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            wanted = range(3) if _is_rgb(frame, adobe) else range(1)
            for i, got in _scan(image[at:end], names, frame, tables, width, height, restart, wanted).items():
                if frame[i][3] not in steps:
                    raise BadImage("no quantisation table")
                planes[i] = got * steps[frame[i][3]]
            at = end
    if len(frame) == 4 and adobe != 2:
        raise BadImage("CMYK")
    if 0 not in planes or _is_rgb(frame, adobe) and len(planes) < 3:
        raise BadImage("no luminance scan" if frame else "no frame")
    mean = planes[0] / 8 if len(planes) == 1 else (0.299 * planes[0] + 0.587 * planes[1] + 0.114 * planes[2]) / 8
    return width, height, len(frame), np.clip(np.floor(mean + 0.5) + 128, 0, 255).astype(np.uint8)


def _is_rgb(frame, adobe: int | None) -> bool:
    if len(frame) != 3 or not (adobe == 0 or adobe is None and bytes(f[0] for f in frame) == b"RGB"):
        return False
    if len({f[1:3] for f in frame}) > 1:
        raise BadImage("RGB sampled differently")
    return True


def _scan(data: bytes, names, frame, tables, width: int, height: int, restart: int, wanted) -> dict[int, np.ndarray]:
    """The DC coefficients of those of the wanted components that the scan holds."""
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    parts = []
    for name, spec in names:
        f = next((f for f in frame if f[0] == name), None)
        if f is None or spec >> 4 not in tables or 16 | spec & 15 not in tables:
            raise BadImage("bad scan")
        parts.append((frame.index(f), f[1], f[2], tables[spec >> 4], tables[16 | spec & 15]))
    if not any(p[0] in wanted for p in parts):
        return {}
    size_of = lambda i: (-(-(-(-height * frame[i][2] // most_v)) // 8), -(-(-(-width * frame[i][1] // most_h)) // 8))
    if len(parts) == 1:
        down, across = size_of(parts[0][0])
        parts = [(parts[0][0], 1, 1, parts[0][3], parts[0][4])]
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if across * down > 8 * len(data) + 64:  # each unit takes bits
        raise BadImage("cut off")
    pieces, begin = [], 0
    if restart:
        i = 0
        while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
            if 0xD0 <= data[i + 1] <= 0xD7:
                pieces.append(data[begin:i])
                begin = i + 2
            i += 2
    pieces.append(data[begin:])
    units, each = across * down, restart or across * down
    if len(pieces) < -(-units // each):
        raise BadImage("cut off")
    plan = [(part, dc, ac) for part, (_, h, v, dc, ac) in enumerate(parts) for _ in range(v * h)]
    found: list[list[int]] = [[] for _ in parts]
    for k in range(-(-units // each)):
        bits, last = Scan(pieces[k]), [0] * len(parts)
        for _ in range(k * each, min(units, (k + 1) * each)):
            for part, dc, ac in plan:
                last[part] += bits.block(dc, ac)
                found[part].append(last[part])
    done = {}
    for (i, h, v, _, _), values in zip(parts, found):
        if i in wanted:  # units in rows, each with its v x h blocks
            grid = np.array(values, dtype=np.int64).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            rows, columns = size_of(i)
            done[i] = grid[:rows, :columns]
    return done


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits, row by row of 8 x 9 box means: whether a cell is brighter than the one before; as a signed integer."""
    rows, columns = thumb.shape
    sums = np.zeros((rows + 1, columns + 1), dtype=np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(8) * rows // 8, np.arange(9) * columns // 9
    y1, x1 = np.maximum(y0 + 1, np.arange(1, 9) * rows // 8), np.maximum(x0 + 1, np.arange(1, 10) * columns // 9)
    box = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    mean = box * 256 // ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return int.from_bytes(np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes(), "big", signed=True)


def media_columns(images: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """media_id, width, height, components, thumb_width, thumb_height, thumbnail, thumb_hash, error."""

    def read(batches):
        for batch in batches:
            rows = []
            for image in batch.column(1).to_pylist():
                if image is None:
                    rows.append((None,) * 7 + ("null",))
                    continue
                try:
                    width, height, n, thumb = decode(image)
                    rows.append((width, height, n, thumb.shape[1], thumb.shape[0], thumb.tobytes(), difference_hash(thumb), None))
                except BadImage as why:
                    rows.append((None,) * 7 + (str(why),))
            kinds = [pa.int32()] * 5 + [pa.binary(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["media_id", "width", "height", "components", "thumb_width", "thumb_height", "thumbnail", "thumb_hash", "error"])

    return images.select(ident(id_col).cast("long").alias("media_id"), ident(image_col).cast("binary").alias("image")).mapInArrow(read, MEDIA)


# -- an encoder, for images to read

_DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
#: End of block in 2 bits, the shortest runs of small values in 4 to 6, all others in 10.
_AC_SHORT = [0x00], [0x01, 0x11, 0x02, 0x21], [0x03, 0x12, 0x31, 0x04, 0x41, 0x22, 0x13, 0x05]
_AC_REST = [s for s in [0xF0, *(r << 4 | n for n in range(1, 11) for r in range(16))] if s not in sum(_AC_SHORT, [])]
_AC = bytes([0, 1, 0, 4, 0, 8, 0, 0, 0, len(_AC_REST), 0, 0, 0, 0, 0, 0]) + bytes(sum(_AC_SHORT, []) + _AC_REST)
_COS = np.array([[np.sqrt((1 + (u > 0)) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(spec: bytes) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 16
    for bits, n in enumerate(spec[:16], 1):
        for _ in range(n):
            out[spec[at]] = code, bits
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _code_arrays(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (c, n) in _codes(spec).items():
        code[symbol], length[symbol] = c, n
    return code, length


_DC_CODES, _AC_CODES = _code_arrays(_DC), _code_arrays(_AC)
_BITS = np.array([i.bit_length() for i in range(4096)])


def _entropy(blocks: np.ndarray) -> bytes:
    """The bits of blocks [n, 64], their first the DC difference, as bytes without stuffing; the last byte filled up with ones."""
    n = len(blocks)
    size = _BITS[np.abs(blocks)]
    extra = np.where(blocks >= 0, blocks, blocks + (1 << size) - 1)
    at, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    before = np.where(np.r_[True, at[1:] != at[:-1]], 0, np.r_[0, k[:-1]]) if len(at) else k
    run = k - before - 1
    zrl = run // 16
    symbol = (run % 16) << 4 | size[at, k]
    last = np.zeros(n, np.int64)
    np.maximum.at(last, at, k)
    ends = np.flatnonzero(last < 63)
    long_at, long_k = np.repeat(at, zrl), np.repeat(k, zrl)
    (dc, dc_n), (ac, ac_n) = _DC_CODES, _AC_CODES
    first = size[:, 0]
    value = np.concatenate([dc[first] << first | extra[:, 0], np.full(len(long_at), ac[0xF0]), ac[symbol] << size[at, k] | extra[at, k], np.full(len(ends), ac[0])])
    width = np.concatenate([dc_n[first] + first, np.full(len(long_at), ac_n[0xF0]), ac_n[symbol] + size[at, k], np.full(len(ends), ac_n[0])])
    # order: the block, the place in it, runs of 16 before the value they lead to
    turn = np.concatenate([np.arange(n) * 130, long_at * 130 + 2 * long_k, at * 130 + 2 * k + 1, ends * 130 + 129])
    order = np.argsort(turn, kind="stable")
    value, width = value[order], width[order]
    place = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    bits = (np.repeat(value, width) >> (np.repeat(width, width) - 1 - place)) & 1
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)).tobytes()


def encode(planes: list[np.ndarray], sampling: list[tuple[int, int]], size: tuple[int, int], step: int = 16, restart: int = 0, names: bytes | None = None) -> bytes:
    """A baseline JPEG. planes: one per component, of whole units each; size: (width, height); names: the components', a byte each."""
    width, height = size
    names = names or bytes(range(1, len(planes) + 1))
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(planes) == 1:
        across, down = -(-width // 8), -(-height // 8)
    units, each = across * down, restart or across * down
    begins = np.arange(0, units, each)
    in_units = []
    for plane, (h, v) in zip(planes, sampling):
        if len(planes) == 1:
            h = v = 1
        blocks = (plane.astype(np.float64) - 128).reshape(down * v, 8, across * h, 8).transpose(0, 2, 1, 3)
        c = np.rint(_COS @ blocks @ _COS.T / step).astype(np.int64).reshape(down, v, across, h, 64)[..., ZIGZAG]
        c = c.transpose(0, 2, 1, 3, 4).reshape(units * v * h, 64)
        dc = np.diff(c[:, 0], prepend=0)
        dc[begins * v * h] = c[begins * v * h, 0]
        c[:, 0] = dc
        in_units.append(c.reshape(units, v * h, 64))
    coded = np.concatenate(in_units, axis=1)
    segments = []
    for i, lo in enumerate(begins.tolist()):
        mark = bytes([0xFF, 0xD0 | i % 8]) if lo + each < units else b""
        segments.append(_entropy(coded[lo : lo + each].reshape(-1, 64)).replace(b"\xff", b"\xff\x00") + mark)
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    head = part(0xDB, bytes([0]) + bytes([step]) * 64)
    head += part(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([names[i], h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += part(0xC4, bytes([0]) + _DC) + part(0xC4, bytes([0x10]) + _AC)
    head += part(0xDD, restart.to_bytes(2, "big")) if restart else b""
    head += part(0xDA, bytes([len(planes)]) + b"".join(bytes([name, 0]) for name in names) + bytes([0, 63, 0]))
    return b"\xff\xd8" + head + b"".join(segments) + b"\xff\xd9"


def render(text: bytes) -> bytes:
    """An image of a whole text: its bytes as the brightness of pixels, row by row, the last rows filled up with the text again; grey or with
    colour at half size, with or without restarts, wider or higher, by the text's checksum."""
    code = zlib.crc32(text)
    n = max(len(text), 64)
    width = max(8, int(n**0.5 * (3 + code % 5) / 5))
    height = -(-n // width)
    colour, restart = code >> 12 & 1, (code >> 13 & 1) * 16
    unit = 16 if colour else 8
    w, h = -(-width // unit) * unit, -(-height // unit) * unit
    luma = np.zeros((h, w), dtype=np.uint8)
    luma[:height, :width] = np.resize(np.frombuffer(text or b"\0", dtype=np.uint8), (height, width))
    luma[height:], luma[:, width:] = luma[height - 1], luma[:, width - 1 : width]
    if not colour:
        return encode([luma], [(1, 1)], (width, height), 48, restart)
    chroma = luma[::2, ::2]
    return encode([luma, chroma, 255 - chroma], [(2, 2), (1, 1), (1, 1)], (width, height), 48, restart)


def page_images(pages: DataFrame) -> DataFrame:
    """media_id, image: a rendered image per page; null for null HTML."""

    def draw(batches):
        for batch in batches:
            images = [None if x is None else render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["media_id", "image"])

    return pages.select(ident("page_id").cast("long").alias("media_id"), ident("html").cast("binary").alias("html")).mapInArrow(draw, "media_id long, image binary")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(page_images(table(spark, sf_dir, "pages")))
