"""Operator 6: media columns and signature sniffing.

An Aho-Corasick automaton locates every magic byte string in a value; a validator of the
format then confirms structure and lengths, so a chance hit is dropped. The format that is
confirmed at offset 0 and covers the value is its type, whatever was declared; formats
confirmed elsewhere are embedded media and can be carved out.

For documents, the text's bytes (padded with bytes 255 to a positive multiple of 576) are kept
as the samples of an 8-bit grey PNG, 576 to the row. The stored bytes are sniffed, their
declared type is corrected, the samples are read back from the confirmed structure, and the
payload is sniffed for embedded media in turn.

Null counts as empty; an empty value has no type. Equal values give equal results. Map-only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import arrow_map, texts
from pointloom.session import table

ROW = 576
PNG = b"\x89PNG\r\n\x1a\n"


def png_end(data: bytes, at: int) -> int:
    """End of the PNG at this place, or -1: every chunk's length and checksum, IHDR first, IEND last."""
    to, first, pixels = at + 8, True, False
    while to + 12 <= len(data):
        n = int.from_bytes(data[to : to + 4], "big")
        kind, end = data[to + 4 : to + 8], to + 12 + n
        if end > len(data) or first != (kind == b"IHDR") or first and n != 13:
            return -1
        if zlib.crc32(memoryview(data)[to + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return -1
        pixels |= kind == b"IDAT"
        if kind == b"IEND":
            return end if pixels and n == 0 else -1
        to, first = end, False
    return -1


def gif_end(data: bytes, at: int) -> int:
    """End of the GIF: screen, colour tables, blocks up to the trailer."""

    def blocks(to: int) -> int:
        while to < len(data) and data[to]:
            to += 1 + data[to]
        return to + 1

    if at + 13 > len(data):
        return -1
    flags = data[at + 10]
    to = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    images = 0
    while to < len(data):
        if data[to] == 0x3B:
            return to + 1 if images else -1
        if data[to] == 0x21:
            to = blocks(to + 2)
        elif data[to] == 0x2C and to + 10 < len(data):
            local = data[to + 9]
            to = blocks(to + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
            images += 1
        else:
            return -1
    return -1


def jpeg_end(data: bytes, at: int) -> int:
    """End of the JPEG: marker segments with lengths, a frame, a scan, the end marker."""
    to, frame = at + 2, False
    while to + 4 <= len(data) and data[to] == 0xFF:
        mark = data[to + 1]
        if mark == 0xD9:
            return to + 2 if frame else -1
        if mark == 0xFF:
            to += 1
            continue
        if 0xD0 <= mark <= 0xD8 or mark in (0, 1):
            return -1
        n = int.from_bytes(data[to + 2 : to + 4], "big")
        if n < 2:
            return -1
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        to += 2 + n
        if mark == 0xDA:
            while True:
                to = data.find(b"\xff", to)
                if to < 0 or to + 1 >= len(data):
                    return -1
                if data[to + 1] and not 0xD0 <= data[to + 1] <= 0xD7:
                    break
                to += 2
    return to + 2 if frame and data[to : to + 2] == b"\xff\xd9" else -1


def riff_end(data: bytes, at: int) -> int:
    """End of a RIFF WAVE file: its size field, and chunks that fill it exactly."""
    if data[at + 8 : at + 12] != b"WAVE":
        return -1
    end, to, kinds = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12, set()
    if end > len(data):
        return -1
    while to + 8 <= end:
        kinds.add(data[to : to + 4])
        n = int.from_bytes(data[to + 4 : to + 8], "little")
        to += 8 + n + n % 2
    return end if to in (end, end + 1) and {b"fmt ", b"data"} <= kinds else -1


def bmp_end(data: bytes, at: int) -> int:
    """End of a BMP: header sizes, planes, depth and the pixel array's place."""
    if at + 54 > len(data):
        return -1
    size, _, start, header, width, height, planes, depth = struct.unpack("<IIIIiiHH", data[at + 2 : at + 30])
    ok = header in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size <= len(data) - at and width > 0 and height
    return at + size if ok and start + (width * depth + 31) // 32 * 4 * abs(height) <= size else -1


def gzip_end(data: bytes, at: int) -> int:
    """End of a gzip member without optional header fields; its data has to inflate."""
    if data[at + 3 : at + 4] != b"\0":
        return -1
    out = zlib.decompressobj(31)
    try:
        rest = memoryview(data)[at:]
        for i in range(0, len(rest), 1 << 16):
            out.decompress(rest[i : i + (1 << 16)])
            if out.eof:
                return min(at + i + (1 << 16), len(data)) - len(out.unused_data)
    except zlib.error:
        pass
    return -1


def pdf_end(data: bytes, at: int) -> int:
    """End of a PDF: the last end mark before any further header, with a cross-reference before it."""
    stop = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, stop if stop >= 0 else len(data))
    return end + 5 if end >= 0 and data.find(b"startxref", at, end) >= 0 else -1


# Magic bytes, media type and validator of each format.
FORMATS = [
    (PNG, "image/png", png_end),
    (b"GIF87a", "image/gif", gif_end),
    (b"GIF89a", "image/gif", gif_end),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_end),
    (b"RIFF", "audio/wav", riff_end),
    (b"BM", "image/bmp", bmp_end),
    (b"\x1f\x8b\x08", "application/gzip", gzip_end),
    (b"%PDF-", "application/pdf", pdf_end),
]
_automaton = None


def automaton():
    """The Aho-Corasick automaton of all magic bytes, over bytes as Latin-1 characters."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        own = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            own.add_word(magic.decode("latin-1"), k)
        own.make_automaton()
        _automaton = own
    return _automaton


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of all confirmed media, outermost only, in order."""
    out, floor = [], 0
    for last, k in automaton().iter(data.decode("latin-1")):
        magic, kind, end_of = FORMATS[k]
        start = last + 1 - len(magic)
        if start >= floor and (end := end_of(data, start)) > start:
            out.append((kind, start, end))
            floor = end
    return out


def png(payload: bytes, width: int = ROW) -> bytes:
    """A grey 8-bit PNG whose rows hold the payload, unfiltered."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    return b"".join([PNG, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)), chunk(b"IEND", b"")])


def samples(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and the samples of an unfiltered grey 8-bit PNG."""
    to, packed, width, height = 8, [], 0, 0
    while to < len(media):
        n, kind = int.from_bytes(media[to : to + 4], "big"), media[to + 4 : to + 8]
        if kind == b"IHDR":
            width, height = struct.unpack(">II", media[to + 8 : to + 16])
        elif kind == b"IDAT":
            packed.append(media[to + 8 : to + 8 + n])
        to += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return width, height, rows[:, 1:].tobytes()


def described(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}@{a}+{b - a}" for kind, a, b in found)


def store_and_sniff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    feature: confirmed type, width x height, whether the declared type (application/octet-stream)
    was corrected, the mean sample, and the embedded media of the payload. with_media adds the
    stored bytes as `media`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in texts(batch.column(1)):
                media = png(text + b"\xff" * (-len(text) % ROW or ROW * (not text)))
                found = sniff(media)
                whole = [x for x in found if x[1] == 0 and x[2] == len(media)]
                width, height, payload = samples(media)
                mean = int(np.frombuffer(payload, np.uint8).mean() * 1000)
                feature = f"{whole[0][0]};{width}x{height};corrected={whole[0][0] != 'application/octet-stream'};mean={mean / 1000:.3f};embedded={described(sniff(payload))}"
                for column, x in zip(out, (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)):
                    column.append(x)
            columns = [batch.column(0), *(pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if with_media:
                columns.append(pa.array(out[7], pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * with_media
    return arrow_map(df, [id_col, text_col], run, schema)


def sniff_column(df: DataFrame, media_col: str, declared_col: str | None = None, id_col: str = "id", carve: bool = False) -> DataFrame:
    """For any binary column: id, declared, sniffed, corrected, found (array of type, start, end[, bytes]).

    A row is corrected if its whole value is confirmed as a type other than the declared one.
    Null or unknown values have a null type and nothing found.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = [("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())] + [("bytes", pa.binary())] * carve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(1))
            declared = batch.column(2).to_pylist() if declared_col else [None] * len(values)
            hits = [sniff(x) for x in values]
            kinds = [next((k for k, a, b in h if a == 0 and b == len(x)), None) for x, h in zip(values, hits)]
            found = [[{"type": k, "start": a, "end": b} | ({"bytes": x[a:b]} if carve else {}) for k, a, b in h] for x, h in zip(values, hits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(declared, pa.string()), pa.array(kinds, pa.string()), pa.array([k is not None and k != d for k, d in zip(kinds, declared)], pa.bool_()), pa.array(found, pa.list_(pa.struct(fields)))],
                names=[id_col, "declared", "sniffed", "corrected", "found"],
            )

    inner = "type: string, start: bigint, end: bigint" + ", bytes: binary" * carve
    return arrow_map(df, [id_col, media_col, *([declared_col] if declared_col else [])], run, f"`{id_col}` {kind}, declared string, sniffed string, corrected boolean, found array<struct<{inner}>>")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_sniff(table(spark, sf_dir, "documents"))
