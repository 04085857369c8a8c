"""Progressive JPEG media columns (operator 1).

``decode`` reads a progressive JPEG: every scan adds its part, a spectral band at some bit precision, to the coefficient
arrays of the components (spectral selection and successive approximation); then the coefficients are dequantised,
inverse-transformed in numpy, chroma is upsampled and the planes become a full-resolution RGB tensor.

``encode`` stores bytes losslessly in the coefficients, the format's own unit: byte b becomes the coefficient whose size
category is 8 and whose eight magnitude bits are b (b if b >= 128, else b - 255), in zigzag order, block by block, so that
it survives what lossy steps come after. Its scans are DC and two AC bands at half precision, then refinements of each;
chroma is subsampled 2 x 2 (4:2:0), six blocks a unit.

In these files every AC code word of a first scan has the same length, as its table has a single symbol, and the
decoder takes such scans, and refinement scans of blocks without new coefficients, as arrays; any other scan goes through
the bit reader, with any tables, end-of-band runs and restarts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts, whole

UNIT = 192
BLOCK = 64
#: Bytes of a payload that one picture holds, at most (a multiple of UNIT).
PART = UNIT << 16


def _zigzag() -> np.ndarray:
    """Row-major index of each place in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    order = sorted(cells, key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return np.array([r * 8 + c for r, c in order])


def _cosines() -> np.ndarray:
    """64 x 64: coefficients (row-major) to samples of the inverse DCT."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    return np.kron(one, one).astype(np.float32)


ZIGZAG, IDCT = _zigzag(), _cosines()
_B = np.arange(256)
#: By byte: its coefficient, the seven magnitude bits of half of it, its last bit.
VALUE = np.where(_B >= 128, _B, _B - 255).astype(np.int16)
HALF = np.where(_B >= 128, _B >> 1, 127 - ((255 - _B) >> 1)).astype(np.uint8)
LAST = (np.abs(VALUE) & 1).astype(np.uint8)
#: By difference of two DC values: the code word of its category (four bits) and its magnitude bits.
DC_TEXT = {
    d: f"{abs(d).bit_length():04b}" + (f"{d if d > 0 else d + (1 << abs(d).bit_length()) - 1:0{abs(d).bit_length()}b}" if d else "")
    for d in range(-511, 512)
}
#: By seven magnitude bits: the coefficient, in units of its precision.
SEVEN = np.where(_B[:128] >= 64, _B[:128], _B[:128] - 127).astype(np.int16)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))  # rows, columns, zigzag
    wide: int = 0
    high: int = 0


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


# --- writing -------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(cls: int, ident: int, symbols: list[int], length: int) -> bytes:
    """Huffman table whose symbols all have code words of one length."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([cls << 4 | ident, *counts, *symbols]))


def _scan(components: list[tuple[int, int, int]], low: int, high: int, before: int, at: int, data: bytes) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, d << 4 | a]) for c, d, a in components)
    return _segment(0xDA, body + bytes([low, high, before << 4 | at])) + data


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits (0 or 1) as scan bytes, padded by ones."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(pad, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")


def _dc_bits(values: np.ndarray) -> bytes:
    """DC codes (4-bit code words, one for each category 0 to 14) of the differences of ``values``."""
    diff = (values[1:] - values[:-1]).tolist()
    text = "".join([DC_TEXT[int(values[0])], *[DC_TEXT[d] for d in diff]])
    return _stuffed(np.frombuffer(text.encode(), np.uint8) & 1)


def shape(n_blocks: int) -> tuple[int, int]:
    """Units across and down of a 4:2:0 picture with room for n_blocks blocks."""
    units = -(-n_blocks // 6)
    across = max(1, min(8000 // 16, int(np.sqrt(units))))
    return across, -(-units // across)


def encode(payload: bytes) -> bytes:
    """Progressive JPEG with the payload (a positive multiple of 64 bytes) as coefficients; its length is in a comment."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    across, down = shape(len(payload) // BLOCK)
    if down > 4095:
        raise ValueError("a picture holds 786,240,000 bytes at most")
    data = np.full(across * down * 6 * BLOCK, 128, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    units = data.reshape(down, across, 6, BLOCK)
    # Each component's blocks in raster order: four luma blocks a unit, then one of each chroma.
    luma = units[:, :, :4].reshape(down, across, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    planes = [luma, units[:, :, 4].reshape(-1, BLOCK), units[:, :, 5].reshape(-1, BLOCK)]
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"bytes=%d" % len(payload)),
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, list(range(12)), 4),
        _table(1, 0, [7], 1),  # first AC scans: category 7 without a run, one bit
        _table(1, 1, [0], 1),  # refinements: end of band, one bit
    ]
    for c, plane in enumerate(planes, 1):
        out.append(_scan([(c, 0, 0)], 0, 0, 0, 1, _dc_bits(VALUE[plane[:, 0]] >> 1)))
    for low, high in ((1, 5), (6, 63)):
        for c, plane in enumerate(planes, 1):
            # A 0 for the code word, then seven magnitude bits: of half the coefficient, towards zero.
            out.append(_scan([(c, 0, 0)], low, high, 0, 1, HALF[plane[:, low : high + 1]].tobytes()))
    for c, plane in enumerate(planes, 1):
        out.append(_scan([(c, 0, 0)], 0, 0, 1, 0, _stuffed((VALUE[plane[:, 0]] & 1).astype(np.uint8))))
    for c, plane in enumerate(planes, 1):
        bit = LAST[plane]
        bit[:, 0] = 0  # the code word of the band's end
        out.append(_scan([(c, 0, 1)], 1, 63, 1, 0, _stuffed(bit.ravel())))
    return b"".join([*out, b"\xff\xd9"])


# --- reading -------------------------------------------------------------------------------------------------------


BYTE = [f"{b:08b}" for b in range(256)]


class Bits:
    """Bit reader over the bytes of one restart interval (unstuffed)."""

    def __init__(self, data: bytes):
        self.text, self.at = "".join([BYTE[b] for b in data]), 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > len(self.text):
            raise ValueError("the scan's data ends too early")
        return int(self.text[self.at - n : self.at], 2)

    def symbol(self, codes: Codes) -> int:
        at, text = self.at, self.text
        for n in codes.lengths:
            if (got := codes.get(text[at : at + n])) is not None:
                self.at = at + n
                return got
        raise ValueError("no such code word")


class Codes(dict):
    """Symbols by code word; the lengths that code words have."""

    lengths: tuple[int, ...] = ()


def _codes(counts: bytes, symbols: bytes) -> Codes:
    out, word, at = Codes(), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[f"{word:0{n}b}"] = symbols[at]
            word, at = word + 1, at + 1
        word <<= 1
    out.lengths = tuple(n for n, count in enumerate(counts, 1) if count)
    return out


def _extend(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


@dataclass
class Scan:
    components: list[tuple[Component, Codes, Codes]]
    low: int
    high: int
    before: int
    at: int
    restart: int
    data: bytes

    def intervals(self) -> list[bytes]:
        if not self.restart:
            return [self.data.replace(b"\xff\x00", b"\xff")]
        parts, at, i = [], 0, 0
        while (i := self.data.find(b"\xff", i)) >= 0:
            if 0xD0 <= self.data[i + 1] <= 0xD7:
                parts.append(self.data[at:i])
                at = i + 2
            i += 2
        return [p.replace(b"\xff\x00", b"\xff") for p in (*parts, self.data[at:])]

    def order(self) -> list[tuple[int, int, int]]:
        """(component of the scan, row, column) of its blocks in coding order, unit by unit."""
        if len(self.components) == 1:
            c = self.components[0][0]
            return [(0, r, k) for r in range(c.high) for k in range(c.wide)]
        first = self.components[0][0]
        rows, columns = first.blocks.shape[0] // first.v, first.blocks.shape[1] // first.h
        return [
            (i, r * c.v + y, k * c.h + x)
            for r in range(rows) for k in range(columns)
            for i, (c, _, _) in enumerate(self.components) for y in range(c.v) for x in range(c.h)
        ]

    def per_unit(self) -> int:
        return 1 if len(self.components) == 1 else sum(c.h * c.v for c, _, _ in self.components)

    def apply(self) -> None:
        if not self.whole():
            self.serial()

    def whole(self) -> bool:
        """Scans of one component whose codes have one length, as arrays; False if this is not such a scan."""
        if len(self.components) != 1 or self.restart:
            return False
        c, _, ac = self.components[0]
        n, width = c.high * c.wide, self.high - self.low + 1
        view = c.blocks[: c.high, : c.wide]
        if self.low and not self.before and ac == {"0": 7}:
            raw = np.frombuffer(self.data.replace(b"\xff\x00", b"\xff"), np.uint8)
            if len(raw) < n * width or (raw[: n * width] > 127).any():
                return False
            view[:, :, self.low : self.high + 1] = (SEVEN[raw[: n * width]] << self.at).reshape(c.high, c.wide, width)
            return True
        if self.before:
            flags = np.unpackbits(np.frombuffer(self.data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if not self.low:
                if len(flags) < n:
                    return False
                view[:, :, 0] |= flags[:n].reshape(c.high, c.wide).astype(np.int16) << self.at
                return True
            part = view[:, :, self.low : self.high + 1]
            if ac != {"0": 0} or len(flags) < n * (width + 1) or not part.all():
                return False
            flags = flags[: n * (width + 1)].reshape(c.high, c.wide, width + 1)
            if flags[..., 0].any():
                return False
            step = flags[..., 1:].astype(np.int16) << self.at
            part += np.where(part < 0, -step, step)
            return True
        return False

    def serial(self) -> None:
        order, per = self.order(), self.per_unit()
        size = self.restart * per if self.restart else len(order)
        parts = self.intervals()
        for k, at in enumerate(range(0, len(order), max(1, size))):
            bits, predicted, run = Bits(parts[k]), [0] * len(self.components), 0
            for i, r, col in order[at : at + size]:
                c, dc, ac = self.components[i]
                block = c.blocks[r, col]
                if self.low == 0:
                    if self.before:
                        block[0] |= bits.take(1) << self.at
                    else:
                        s = bits.symbol(dc)
                        predicted[i] += _extend(bits.take(s), s) if s else 0
                        block[0] = predicted[i] << self.at
                elif self.before:
                    run = self.refine(block, bits, ac, run)
                else:
                    run = self.first(block, bits, ac, run)

    def first(self, block: np.ndarray, bits: Bits, ac: Codes, run: int) -> int:
        if run:
            return run - 1
        k = self.low
        while k <= self.high:
            rs = bits.symbol(ac)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                block[k] = _extend(bits.take(s), s) << self.at
                k += 1
            elif r == 15:
                k += 16
            else:
                return (1 << r) + (bits.take(r) if r else 0) - 1
        return 0

    def refine(self, block: np.ndarray, bits: Bits, ac: Codes, run: int) -> int:
        one, k = 1 << self.at, self.low

        def correct(at: int) -> None:
            if bits.take(1):
                block[at] += one if block[at] > 0 else -one

        if not run:
            while k <= self.high:
                rs = bits.symbol(ac)
                r, s = rs >> 4, rs & 15
                new = 0
                if s:
                    new = one if bits.take(1) else -one
                elif r < 15:
                    run = (1 << r) + (bits.take(r) if r else 0)
                    break
                while k <= self.high:
                    if block[k]:
                        correct(k)
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if new and k <= self.high:
                    block[k] = new
                k += 1
        if run:
            for at in range(k, self.high + 1):
                if block[at]:
                    correct(at)
            run -= 1
        return run


def read(data: bytes) -> Picture:
    """Coefficient arrays of a progressive JPEG, after all its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, at, codes, restart = Picture(), 2, {}, 0
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            for i in range(n):
                ident, hv, table = body[6 + 3 * i : 9 + 3 * i]
                out.components.append(Component(ident, hv >> 4, hv & 15, table))
            most_h, most_v = max(c.h for c in out.components), max(c.v for c in out.components)
            across, down = -(-out.width // (8 * most_h)), -(-out.height // (8 * most_v))
            for c in out.components:
                c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int16)
                c.wide = -(-(-(-out.width * c.h // most_h)) // 8)
                c.high = -(-(-(-out.height * c.v // most_v)) // 8)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman coding is read")
        elif marker == 0xDA:
            stop = at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise ValueError("a scan doesn't end")
                if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                    stop += 2
                    continue
                break
            n = body[0]
            chosen = []
            for i in range(n):
                ident, t = body[1 + 2 * i], body[2 + 2 * i]
                comp = next(c for c in out.components if c.ident == ident)
                chosen.append((comp, codes.get((0, t >> 4), Codes()), codes.get((1, t & 15), Codes())))
            low, high, approx = body[1 + 2 * n : 4 + 2 * n]
            Scan(chosen, low, high, approx >> 4, approx & 15, restart, data[at:stop]).apply()
            at = stop
    return out


def payload_of(picture: Picture) -> bytes:
    """The bytes that ``encode`` stored."""
    n = next(int(c[6:]) for c in picture.comments if c.startswith(b"bytes="))
    luma, blue, red = (c.blocks for c in picture.components)
    down, across = blue.shape[:2]
    units = np.empty((down, across, 6, BLOCK), np.int16)
    units[:, :, :4] = luma.reshape(down, 2, across, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, BLOCK)
    units[:, :, 4], units[:, :, 5] = blue, red
    flat = units.reshape(-1)
    out = flat.astype(np.uint8)
    out -= flat < 0
    return out.tobytes()[:n]


def rgb(picture: Picture) -> np.ndarray:
    """Full-resolution tensor (height, width, 3) of unsigned bytes: inverse DCT, chroma upsampling, colour conversion."""
    most_h, most_v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        rows, columns = c.blocks.shape[:2]
        grid = np.empty((rows * columns, 64), np.float32)
        grid[:, ZIGZAG] = c.blocks.reshape(-1, 64) * picture.quant[c.table]
        plane = (grid @ IDCT).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)[..., None].repeat(3, 2)
    y, b, r = planes
    # The colour conversion of JFIF.
    out = np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), 2) + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return rgb(read(data))


# --- the column ----------------------------------------------------------------------------------------------------


def padded(text: str) -> bytes:
    """UTF-8 of a text, with spaces up to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def feature(tensor: np.ndarray) -> str:
    """height x width and the mean of each channel over the four quarters."""
    h, w = tensor.shape[0] // 2, tensor.shape[1] // 2
    quarters = tensor.reshape(2, h, 2, w, 3).sum((1, 3), dtype=np.int64) / max(1, h * w)
    return f"{2 * h}x{2 * w}:" + ",".join([f"{m:.2f}" for m in quarters.ravel().tolist()])


def measures(text: str, files: bool, tensors: bool) -> list:
    """MEASURES of a text that is stored and read back, and the file's and the tensor's bytes if asked for."""
    sent = padded(text)
    payload, medium, pixels = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
    n_payload, n_medium, tail, features, kept, planes, first = 0, 0, b"", [], [], [], None
    for at in range(0, len(sent), PART):
        stored = encode(sent[at : at + PART])
        picture = read(stored)
        back, tensor = payload_of(picture), rgb(picture)
        payload.update(back)
        medium.update(stored)
        pixels.update(np.ascontiguousarray(tensor))
        n_payload, n_medium, tail = n_payload + len(back), n_medium + len(stored), (tail + back[-16:])[-16:]
        features.append(feature(tensor))
        first = first or tensor.shape[:2]
        kept += [stored] * files
        planes += [tensor.tobytes()] * tensors
    row = [len(text.encode()), n_payload, payload.hexdigest(), zlib.crc32(tail), n_medium, medium.hexdigest(), ";".join(features), pixels.hexdigest()]
    return row + [b"".join(kept)] * files + [b"".join(planes), *first] * tensors


def media(docs: DataFrame, keep: list[str], files: bool = False, tensors: bool = False) -> DataFrame:
    """``keep`` columns and the stored picture's measures; with the file's bytes and the RGB tensor's bytes if asked for.

    Null and empty texts are one unit of spaces; a text needs no neighbour, so repeated rows have equal values. A payload of
    more than PART bytes is several pictures one after another, so that memory is bounded whatever its length; then the
    file and the tensor are those of all pictures, height and width those of the first.
    """
    more = [("media", pa.binary())] * files + [("tensor", pa.binary()), ("height", pa.int32()), ("width", pa.int32())] * tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 64):
                b = whole_batch.slice(at, 64)
                rows, known = [], {}
                for text in texts(b):
                    if text in known:
                        rows.append(known[text])
                        continue
                    known[text] = measures(text, files, tensors)
                    rows.append(known[text])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[t for _, t in more]]
                columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *arrays], names=[*keep, *MEASURES, *[n for n, _ in more]])

    kept = docs.select(*keep, whole().alias("text"))
    types = dict(kept.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    extra = ", media binary" * files + ", tensor binary, height int, width int" * tensors
    return kept.mapInArrow(
        run,
        fields + ", n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tensor_sha256 string" + extra,
    )


MEASURES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor_sha256")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(documents(spark, sf_dir), ["doc_id"])
