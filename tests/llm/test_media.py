import gzip
import hashlib
import struct
import zlib

from pointloom.llm import media as M

WAV = b"RIFF" + struct.pack("<I", 4 + 8 + 16 + 8 + 4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"abcd"
BMP = b"BM" + struct.pack("<IIIIiiHH", 54 + 8, 0, 54, 40, 1, 2, 1, 24) + bytes(24) + bytes(8)
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 128, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04ab\xff\xda\x00\x04ab12\xff\x0034\xff\xd9"
PNG = M.png(b"abc" * 192 * 4)
PDF = b"%PDF-1.4 x startxref 0 %%EOF"
ALL = [("image/png", PNG), ("audio/wav", WAV), ("image/bmp", BMP), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/gzip", gzip.compress(b"hello" * 99)), ("application/pdf", PDF)]


def test_embedded_media_are_carved():
    blob, want = b"junkBM GIF89a \xff\xd8\xff RIFF", []
    for kind, data in ALL:
        want.append((kind, len(blob), len(blob) + len(data)))
        blob += data + b"BM."
    assert M.sniff(blob) == want and M.sniff(b"") == []


def test_damage_is_noticed():
    for kind, data in ALL:
        assert M.sniff(data) == [(kind, 0, len(data))]
        assert (kind, 0, len(data)) not in M.sniff(data[:-1])


def test_payload_round_trip(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "x" * 576), (5, "é" * 1000 + GIF.decode("latin-1")), (1, "abc")]
    df = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id bigint, text string, feature string")
    got = M.store_and_sniff(df, with_media=True).collect()
    for (doc, text), r in zip(sorted(rows, key=lambda x: x[0]), sorted(got, key=lambda r: r.doc_id)):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc, len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert M.samples(bytes(r.media))[2] == payload and r.feature.startswith("image/png;576x")
    assert M.store_and_sniff(df.limit(0)).count() == 0


def test_declared_types_are_corrected(spark):
    df = spark.createDataFrame([(i, bytearray(d), "image/png") for i, (_, d) in enumerate(ALL)] + [(9, None, "image/gif"), (10, bytearray(b"text"), None)], "id bigint, data binary, said string")
    got = {r.id: r for r in M.sniff_column(df, "data", "said", carve=True).collect()}
    assert [got[i].sniffed for i in range(7)] == [k for k, _ in ALL]
    assert not got[0].corrected and all(got[i].corrected for i in range(1, 7)) and got[9].sniffed is None and got[10].found == []
    assert bytes(got[3].found[0].bytes) == GIF
