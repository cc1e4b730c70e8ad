"""Texts as baseline JPEG and back, with features from DC-only thumbnails.

A payload byte is the DC coefficient of one 8x8 luminance block: quantised by 8
it gives a flat block of that sample value, so the thumbnail that a decoder
rebuilds from the DC terms alone is the payload. Blocks lie in rows of 192; a
frame has at most 8,191 block rows, and longer payloads are a sequence of
frames. Differences of neighbouring DC terms have categories 0 to 8; the
category of s bits has a Huffman code of 9 - s bits, a complete and legal code
set that leaves the all-ones code free. An end-of-block code closes each block.

The decoder parses markers (DQT, SOF0, DHT, DRI, SOS, restart markers, EOI) of
any grey or colour baseline file and walks the scan symbol by symbol. When a
scan is grey, its AC table has the end-of-block code only and every DC category
has one total width, symbol positions are known and numpy decodes all at once.

Defined cases: null and empty texts are 192 spaces; the payload is the text's
UTF-8 bytes with spaces up to a positive multiple of 192, none added to an exact
multiple. Repeated rows come back each; equal texts give equal media. A null
medium gives null features. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_batches

WIDTH = 192
FRAME_ROWS = 8191
HASH_SIDE = 8
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, width int, height int"

#: The zigzag order of ITU T.81 is not needed for DC terms; categories 0 to 8 by code length 9 to 1.
DC_COUNTS = bytes([1] * 9 + [0] * 7)
DC_SYMBOLS = bytes(range(8, -1, -1))
#: End of block is the one AC code, a zero bit.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), b"\x00"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _ten_bit_codes() -> np.ndarray:
    """The bits of one block (DC code, magnitude, end of block) by difference + 255."""
    out = np.empty(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << 9 - s) - 2  # canonical: lengths 1, 2, 3, ... give 0, 10, 110, ...
        extra = d if d > 0 else d + (1 << s) - 1
        out[d + 255] = ((code << s) | extra) << 1
    return out


_CODES = _ten_bit_codes()


def _frame(payload: np.ndarray) -> bytes:
    rows = len(payload) // WIDTH
    dc = payload.astype(np.int16) - 128
    codes = _CODES[np.diff(dc, prepend=np.int16(0)).astype(np.intp) + 255].reshape(-1, 4)
    forty = (codes[:, 0] << np.uint64(30)) | (codes[:, 1] << np.uint64(20)) | (codes[:, 2] << np.uint64(10)) | codes[:, 3]
    scan = forty.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_SYMBOLS),
            _segment(0xC4, bytes([0x10]) + AC_COUNTS + AC_SYMBOLS),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        )
    )


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def encode(payload: bytes) -> bytes:
    """One or more baseline JPEG frames that hold the payload."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    values, step = np.frombuffer(payload, np.uint8), WIDTH * FRAME_ROWS
    return b"".join(_frame(values[i : i + step]) for i in range(0, len(values), step))


class _Bits:
    """Bits of an unstuffed scan, most significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        first = self.at >> 3
        chunk = int.from_bytes(self.data[first : first + 4].ljust(4, b"\xff"), "big")
        return chunk >> 32 - (self.at & 7) - n & (1 << n) - 1

    def take(self, n: int) -> int:
        got = self.peek(n) if n else 0
        self.at += n
        return got


def _table(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _symbol(bits: _Bits, codes: dict[tuple[int, int], int]) -> int:
    for length in range(1, 17):
        if (found := codes.get((length, bits.peek(length)))) is not None:
            bits.at += length
            return found
    raise ValueError("no such Huffman code in the scan")


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> size - 1 else value - (1 << size) + 1


def _fixed_width(scan: bytes, n: int, dc: dict) -> np.ndarray | None:
    """DC differences of n blocks if every category takes one width and blocks end at once."""
    widths = {length + size for (length, _), size in dc.items()}
    if len(widths) != 1:
        return None
    width = widths.pop()
    lookup = np.full(1 << width, np.iinfo(np.int32).max, np.int32)
    for (length, code), size in dc.items():
        for extra in range(1 << size):
            lookup[code << size | extra] = _extend(extra, size)
    at = np.arange(n, dtype=np.int64) * (width + 1)
    data = np.frombuffer(scan + bytes(4), np.uint8)
    first = at >> 3
    window = sum(data[first + i].astype(np.uint32) << np.uint32(24 - 8 * i) for i in range(4))
    block = window >> (np.uint32(32 - width - 1) - (at & 7).astype(np.uint32)) & np.uint32((2 << width) - 1)
    found = lookup[block >> np.uint32(1)]
    if (block & np.uint32(1)).any() or (found == np.iinfo(np.int32).max).any():
        raise ValueError("no such Huffman code in the scan")
    return found


def _scan(parts: list[bytes], frame: dict, order: list, interval: int, tables: dict) -> np.ndarray:
    """Dequantised DC terms of the luminance component, by block row and column."""
    comps = frame["components"]
    most_h, most_v = max(c["h"] for c in comps.values()), max(c["v"] for c in comps.values())
    wide, high = -(-frame["width"] // (8 * most_h)), -(-frame["height"] // (8 * most_v))
    luma = order[0][0]
    if len(order) == 1:
        c = comps[luma]
        wide, high = -(-frame["width"] * c["h"] // (8 * most_h)), -(-frame["height"] * c["v"] // (8 * most_v))
        h, v = 1, 1
    else:
        h, v = comps[luma]["h"], comps[luma]["v"]
    out = np.zeros((high * v, wide * h), np.int64)
    _, dc_at, ac_at = order[0]
    if len(order) == 1 and not interval and tables[1, ac_at] == {(1, 0): 0} and len(parts) == 1:
        diffs = _fixed_width(parts[0], wide * high, tables[0, dc_at])
        if diffs is not None:
            return np.cumsum(diffs, dtype=np.int64).reshape(high, wide) * comps[luma]["q"]
    mcu = 0
    for part in parts:
        bits, last = _Bits(part), dict.fromkeys(comps, 0)
        for _ in range(min(interval or wide * high, wide * high - mcu)):
            for ident, dc, ac in order:
                c = comps[ident]
                ch, cv = (1, 1) if len(order) == 1 else (c["h"], c["v"])
                for k in range(ch * cv):
                    size = _symbol(bits, tables[0, dc])
                    last[ident] += _extend(bits.take(size), size)
                    spot = 1
                    while spot < 64:
                        s = _symbol(bits, tables[1, ac])
                        if s == 0:
                            break
                        bits.at += s & 15
                        spot += 16 if s == 0xF0 else (s >> 4) + 1
                    if ident == luma:
                        out[mcu // wide * v + k // ch, mcu % wide * h + k % ch] = last[ident] * c["q"]
            mcu += 1
    return out


def decode(media: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """DC-only luminance thumbnails (uint8, one sample per block) and (width, height) of each frame."""
    thumbs, sizes, at = [], [], 0
    quant, tables, frame, interval = {}, {}, {}, 0
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker, at = media[at + 1], at + 2
        if marker == 0xD8:
            quant, tables, frame, interval = {}, {}, {}, 0
            continue
        if marker in (0xD9, 0x01) or 0xD0 <= marker <= 0xD7:
            continue
        if marker == 0xFF:
            at -= 1
            continue
        length = int.from_bytes(media[at : at + 2], "big")
        body, at = media[at + 2 : at + length], at + length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = _table(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xC0:
            _, high, wide, n = struct.unpack(">BHHB", body[:6])
            frame = {"width": wide, "height": high, "components": {body[6 + 3 * i]: {"h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": quant[body[8 + 3 * i]]} for i in range(n)}}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            parts, start = [], at
            while True:
                end = media.index(b"\xff", at)
                if media[end + 1] == 0:
                    at = end + 2
                    continue
                parts.append(media[start:end].replace(b"\xff\x00", b"\xff"))
                if 0xD0 <= media[end + 1] <= 0xD7:
                    start = at = end + 2
                    continue
                at = end
                break
            dc = _scan(parts, frame, order, interval, tables)
            thumbs.append(np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8))
            sizes.append((frame["width"], frame["height"]))
    return thumbs, sizes


def feature(thumbs: list[np.ndarray], sizes: list[tuple[int, int]]) -> str:
    """Dimensions of each frame, average hash and difference hash of an 8x9 reduction of all
    frames one below the other (narrower ones padded at the right with their last column), and a digest of all thumbnails."""
    wide = max(t.shape[1] for t in thumbs)
    small = _reduce(np.vstack([np.pad(t, ((0, 0), (0, wide - t.shape[1])), "edge") for t in thumbs]) if len(thumbs) > 1 else thumbs[0], HASH_SIDE, HASH_SIDE + 1)
    average = np.packbits(small[:, :HASH_SIDE] > small[:, :HASH_SIDE].mean()).tobytes().hex()
    difference = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    whole = hashlib.md5(b"".join(t.tobytes() for t in thumbs)).hexdigest()[:16]
    return f"{'+'.join(f'{w}x{h}' for w, h in sizes)}*{len(sizes)}:{average}:{difference}:{whole}"


def _reduce(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over a grid of rows x cols cells (cells of a small image may share samples)."""
    def cells(n, k):
        start = np.arange(k) * n // k
        return start, np.maximum((np.arange(k) + 1) * n // k, start + 1)

    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    (r0, r1), (c0, c1) = cells(image.shape[0], rows), cells(image.shape[1], cols)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    return (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for every row of docs: the text's bytes as JPEG."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Features and digests from the stored bytes of (doc_id, n_bytes, media)."""

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 9
        thumbs, sizes = decode(media)
        payload = b"".join(t.tobytes() for t in thumbs)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(thumbs, sizes), len(sizes), sizes[0][0], sizes[0][1]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
