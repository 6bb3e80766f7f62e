import hashlib
import struct
import zlib

import pytest

from faultweave.llm import media as M


def test_round_trip(docs_of, odd_rows):
    rows = M.media_round_trip(docs_of(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        full = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        want.append((str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert got == sorted(want)
    same = {(r.media_sha256, r.feature) for r in rows if r.doc_id in (3, 4)}
    assert len(same) == 1 and all(r.media_type in M.ENCODERS for r in rows)


@pytest.mark.parametrize("kind", M.ENCODERS)
def test_formats_and_carving(kind):
    data = M.padded(bytes(range(256)) * 3)
    blob = M.encode_samples(data, kind)
    assert M.decode_samples(blob, kind) == data and M.find_media(blob) == [(kind, 0, len(blob), None)]
    assert M.find_media(b"BM\xff\xd8\xffOggSftyp" + blob + b"tail" + blob) == [(kind, 13, len(blob), None), (kind, 17 + len(blob), len(blob), None)]
    assert M.find_media(blob[:-1]) == []


def test_other_formats():
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xc0\x00\x05abc\xff\xda\x00\x02\x10\xff\x00\x20\xff\xd9"
    mp4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 8) + b"moov"
    ogg = b"OggS\x00\x06" + bytes(20) + b"\x01\x03abc"
    webp = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"
    for kind, blob in (("image/gif", gif), ("image/jpeg", jpeg), ("video/mp4", mp4), ("application/ogg", ogg), ("image/webp", webp)):
        assert M.find_media(blob) == [(kind, 0, len(blob), None)], kind
        assert M.find_media(b"junk" + blob + b"more")[0] == (kind, 4, len(blob), None), kind


def test_column(spark):
    wav = M.encode_samples(M.padded(b"x"), "audio/wav")
    df = spark.createDataFrame([(1, bytearray(wav), "image/png"), (2, bytearray(b"pre" + wav), "audio/wav"), (3, None, None), (4, bytearray(b""), "image/png")], "id int, media binary, declared_type string")
    rows = {r.id: r for r in M.sniff(df).collect()}
    assert (rows[1].media_type, rows[1].type_corrected) == ("audio/wav", True)
    assert rows[2].media_type == "unknown" and [(c.type, c.offset, c.length) for c in rows[2].carved] == [("audio/wav", 3, len(wav))]
    assert rows[3].media_type is None and rows[4].media_type == "unknown"
    assert M.sniff(df.limit(0)).count() == 0


def test_media_inside_media():
    """A thumbnail in a segment of a JPEG, and media in a bitmap's pixels."""
    png = M.encode_samples(M.padded(b"thumb"), "image/png")
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(png)) + png + b"\xff\xc0\x00\x05abc\xff\xda\x00\x02\x10\xff\xd9"
    assert M.find_media(b"x" + jpeg) == [("image/jpeg", 1, len(jpeg), None), ("image/png", 7, len(png), 1)]
    pixels = M.padded(jpeg)
    assert [m[3] for m in M.find_media(M.encode_samples(pixels, "image/bmp") + png)] == [None, 0, 54, None]


def test_loose_headers_are_no_media():
    bmp = bytearray(M.encode_samples(M.padded(b"x"), "image/bmp"))
    bmp[2:6], bmp[30:34] = struct.pack("<I", 4), struct.pack("<I", 1)
    png = M.encode_samples(M.padded(b"x"), "image/png")
    end = png.index(b"IDAT") - 4
    n = struct.unpack(">I", png[end : end + 4])[0]
    assert M.find_media(bytes(bmp)) == [] and M.find_media(png[:end] + png[end + 12 + n :]) == []


def test_clashing_columns(spark):
    wav = M.encode_samples(M.padded(b"x"), "audio/wav")
    df = spark.createDataFrame([(1, bytearray(wav), "a", "b", 3)], "id int, media binary, media_type string, _blob string, Carved int")
    out = M.sniff(df)
    assert out.columns == ["id", "media", "_blob", "media_type", "type_corrected", "media_length", "carved"] and out.first().media_type == "audio/wav"


def test_what_is_no_media():
    """Text with magic words, a wave without RIFF, empty and broken pictures."""
    wav = M.encode_samples(M.padded(b"x"), "audio/wav")
    assert M.find_media(b"GIF89a1234567;") == [] and M.find_media(b"XXXX" + wav[4:]) == []

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(width, body):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")

    good = zlib.compress(b"\0\0")
    assert len(M.find_media(png(1, good))) == 1
    assert M.find_media(png(0, good)) == M.find_media(png(1, b"")) == M.find_media(png(1, b"no deflate stream at all")) == []


def test_streams_of_boxes_and_pages():
    mp4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 8) + b"moov"
    assert M.find_media(mp4 + mp4) == [("video/mp4", 0, 24, None), ("video/mp4", 24, 24, None)]

    def page(serial, flags):
        return b"OggS\x00" + bytes([flags]) + bytes(8) + struct.pack("<I", serial) + bytes(8) + b"\x01\x02ab"

    two = page(1, 2) + page(2, 2) + page(1, 4) + page(2, 0) + page(2, 4)
    assert M.find_media(two + page(3, 6)) == [("application/ogg", 0, len(two), None), ("application/ogg", len(two), 30, None)]
    assert M.find_media(page(1, 0) + page(1, 4)) == [] and M.find_media(page(1, 2)) == []


@pytest.mark.parametrize("piece", [struct.pack(">I", 12) + b"ftypisom", struct.pack(">I", 0) + b"ftyp", b"OggS\x00\x02" + bytes(21), b"\xff\xd8\xff\xc0\x00\x05abc\xff\xda\x00\x02", b"\x00\x00\x00\x0cftypisom\x00\x00\x00\x08free"])
def test_time_is_linear(piece):
    import time

    began = time.time()
    M.find_media(piece * (500_000 // len(piece)))
    assert time.time() - began < 10


def test_media_in_texts(docs_of):
    rows = {r.doc_id: r for r in M.media_round_trip(docs_of([(1, "plain"), (2, "GIF89a" + "\x01\x00\x01\x00\x00\x00\x00" + "\x2c" + "\x00" * 9 + "\x02\x01\x44\x00\x3b tail")])).collect()}
    assert rows[1].n_payload_media == 0 and rows[2].n_payload_media == 1
