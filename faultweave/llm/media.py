"""Media columns: signature sniffing, type correction and carving.

``sniff`` finds every known magic value in a blob with one Aho-Corasick pass, then lets a
validator of that format confirm structure and length. A confirmed blob at offset 0 fixes
the type of the column, whatever was declared; confirmed blobs further in that no earlier
one contains are carved with offset and length. ``encode_samples`` stores bytes losslessly
as 8-bit samples of a WAV, BMP or PNG, and ``decode_samples`` gives them back.

Defined results: a null blob has type null, nothing carved. An empty blob and one without
a confirmed signature have type ``unknown``. A format that ends early is not confirmed.
Repeated rows and extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, staged, unused

#: Bytes that one row of samples holds: 64 RGB pixels, or 192 grey pixels or sound samples.
ROW = 192

#: The length of a format that starts at a place of a blob, or 0. What validators learn of a
#: blob on the way is kept in a dictionary, so that no stretch is walked for each start.
Validator = Callable[[memoryview, int, dict], int]


def _u(view: memoryview, at: int, form: str) -> int:
    return struct.unpack_from(form, view, at)[0]


def _png(v: memoryview, at: int, known: dict) -> int:
    """Chunks with right CRCs from IHDR to IEND, a size above 0, and image data that can be
    inflated."""
    i, first, data = at + 8, True, False
    while i + 12 <= len(v):
        n = _u(v, i, ">I")
        kind = bytes(v[i + 4 : i + 8])
        if i + 12 + n > len(v) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(v[i + 4 : i + 8 + n]) != _u(v, i + 8 + n, ">I") or (first and not all(struct.unpack_from(">II", v, i + 8))):
            return 0
        if kind == b"IDAT" and n and not data:
            try:
                data = bool(zlib.decompressobj().decompress(v[i + 8 : i + 8 + n], 1)) or n < 16
            except zlib.error:
                return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at if data else 0
    return 0


def _riff(kind: bytes) -> Validator:
    def check(v: memoryview, at: int, known: dict) -> int:
        """The sizes of the chunks fill the size of the whole, and a data chunk is there."""
        if at + 12 > len(v) or bytes(v[at : at + 4]) != b"RIFF" or bytes(v[at + 8 : at + 12]) != kind:
            return 0
        end = at + 8 + _u(v, at + 4, "<I")
        if end > len(v):
            return 0
        i, names = at + 12, []
        while i + 8 <= end:
            names.append(bytes(v[i : i + 4]))
            n = _u(v, i + 4, "<I")
            i += 8 + n + (n & 1)
        want = {b"WAVE": [b"fmt ", b"data"], b"WEBP": [], b"AVI ": [b"LIST"]}[kind]
        if kind == b"WEBP" and not (names and names[0] in (b"VP8 ", b"VP8L", b"VP8X")):
            return 0
        return end - at if i == end and all(w in names for w in want) else 0

    return check


def _bmp(v: memoryview, at: int, known: dict) -> int:
    if at + 54 > len(v):
        return 0
    size, start, header = _u(v, at + 2, "<I"), _u(v, at + 10, "<I"), _u(v, at + 14, "<I")
    width, height, planes, bits = struct.unpack_from("<iiHH", v, at + 18)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return 0
    need = start + (width * bits + 31) // 32 * 4 * abs(height)
    packed = _u(v, at + 30, "<I") not in (0, 3)
    return size if 14 + header <= start < size and at + size <= len(v) and (packed or size >= need) else 0


def _gif(v: memoryview, at: int, known: dict) -> int:
    if at + 13 > len(v):
        return 0
    flags, i, n, images = v[at + 10], at + 13, len(v), 0
    i += 3 * (2 << (flags & 7)) if flags & 0x80 else 0

    def blocks(i: int) -> int:
        while i < n and v[i]:
            i += v[i] + 1
        return i + 1

    while i < n:
        if v[i] == 0x3B:
            return i + 1 - at if images else 0
        if v[i] == 0x21:
            i = blocks(i + 2)
        elif v[i] == 0x2C and i + 10 < n:
            local, images = v[i + 9], images + 1
            i = blocks(i + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
        else:
            return 0
    return 0


#: Fixed value: in image data a marker that is neither stuffing nor a restart.
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _jpeg(v: memoryview, at: int, known: dict) -> int:
    """Marker segments up to the end-of-image marker, with a frame and a scan."""
    i, n, frame = at + 2, len(v), False
    while i + 4 <= n:
        if v[i] != 0xFF:
            return 0
        mark = v[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark in (0x00, 0x01, 0xD8) or 0xD0 <= mark <= 0xD7:
            return 0
        if mark == 0xD9:
            return i + 2 - at if frame else 0
        size = _u(v, i + 2, ">H")
        if size < 2 or i + 2 + size > n:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if mark == 0xDA:
            mark = _MARK.search(v, i) if i < known.get("no mark from", n) else None
            if mark is None:
                known["no mark from"] = min(i, known.get("no mark from", n))
                return 0
            i = mark.start()
            if v[i + 1] == 0xD9:
                return i + 2 - at if frame else 0
    return 0


def _box(v: memoryview, i: int) -> tuple[bytes, int]:
    """The kind of the box at ``i`` and where it ends; 0 if there is no whole box."""
    if i + 8 > len(v):
        return b"", 0
    n, kind, head = _u(v, i, ">I"), bytes(v[i + 4 : i + 8]), 8
    if n == 1 and i + 16 <= len(v):
        n, head = _u(v, i + 8, ">Q"), 16
    elif n == 0:
        n = len(v) - i
    return kind, i + n if kind.isalnum() and n >= head and i + n <= len(v) else 0


def _mp4(v: memoryview, at: int, known: dict) -> int:
    """Boxes one after the other, ftyp first, moov or moof among them, up to another ftyp.
    Where the boxes from a place on end is worked out once."""
    kind, i = _box(v, at)
    if kind != b"ftyp" or not i:
        return 0
    ends, way = known.setdefault("boxes", {}), []
    while i not in ends:
        kind, after = _box(v, i)
        if not after or kind == b"ftyp":
            ends[i] = (i, False)
            break
        way.append((i, kind))
        i = after
    end, media = ends[i]
    for i, kind in reversed(way):
        media |= kind in (b"moov", b"moof")
        ends[i] = (end, media)
    return end - at if media else 0


def _ogg(v: memoryview, at: int, known: dict) -> int:
    """Pages one after the other, from a first page of a stream to where all streams that
    have begun have ended. Pages that a walk has passed are no starts of their own."""
    passed, open_, i = known.setdefault("pages", set()), set(), at
    if at in passed or at + 27 > len(v) or not v[at + 5] & 2:
        return 0
    while i + 27 <= len(v) and bytes(v[i : i + 4]) == b"OggS" and v[i + 4] == 0:
        segments, flags, serial = v[i + 26], v[i + 5], _u(v, i + 14, "<I")
        passed.add(i)
        if i + 27 + segments > len(v):
            return 0
        open_ |= {serial} if flags & 2 else set()
        open_ -= {serial} if flags & 4 else set()
        i += 27 + segments + sum(v[i + 27 : i + 27 + segments])
        if i > len(v):
            return 0
        if not open_:
            return i - at
    return 0


#: Magic bytes, where they stand in the format, its type and validator.
SIGNATURES: tuple[tuple[bytes, int, str, Validator], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVEfmt ", 8, "audio/wav", _riff(b"WAVE")),
    (b"WEBPVP8", 8, "image/webp", _riff(b"WEBP")),
    (b"AVI LIST", 8, "video/avi", _riff(b"AVI ")),
    (b"OggS", 0, "application/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, back, kind, check in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), back, kind, check))
    found.make_automaton()
    return found


def find_media(blob: bytes) -> list[tuple[str, int, int, int | None]]:
    """``(type, offset, length, parent)`` of each confirmed media: ``parent`` is the offset
    of the media that it lies inside of, null if none."""
    view, out, around, known = memoryview(blob), [], [], {}
    hits = sorted((end + 1 - size - back, kind, check) for end, (size, back, kind, check) in _automaton().iter(blob.decode("latin-1")))
    for at, kind, check in hits:
        while around and at >= sum(around[-1]):
            around.pop()
        if at >= 0 and not (around and at == around[-1][0]) and (n := check(view, at, known)):
            if around and at + n > sum(around[-1]):
                continue
            out.append((kind, at, n, around[-1][0] if around else None))
            around.append((at, n))
    return out


def _wav(samples: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def _bitmap(samples: bytes) -> bytes:
    rows = len(samples) // ROW
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(samples), 0, 54, 40, ROW // 3, -rows, 1, 24, 0, len(samples), 2835, 2835, 0, 0) + samples


def _portable(samples: bytes) -> bytes:
    rows = len(samples) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, ROW)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


ENCODERS = {"audio/wav": _wav, "image/bmp": _bitmap, "image/png": _portable}


def padded(payload: bytes) -> bytes:
    """``payload`` and blanks up to a positive multiple of ``ROW``."""
    return payload.ljust(max(1, -(-len(payload) // ROW)) * ROW, b" ")


def encode_samples(payload: bytes, kind: str) -> bytes:
    return ENCODERS[kind](payload)


def decode_samples(blob: bytes, kind: str) -> bytes:
    """The 8-bit samples of a WAV, BMP or PNG that ``encode_samples`` can write."""
    if kind == "audio/wav":
        i = 12
        while blob[i : i + 4] != b"data":
            i += 8 + _u(memoryview(blob), i + 4, "<I")
        return blob[i + 8 : i + 8 + _u(memoryview(blob), i + 4, "<I")]
    if kind == "image/bmp":
        start, (width, height) = _u(memoryview(blob), 10, "<I"), struct.unpack_from("<ii", blob, 18)
        return blob[start : start + 3 * width * abs(height)]
    if kind == "image/png":
        i, body, width, height = 8, [], *struct.unpack_from(">II", blob, 16)
        while i < len(blob):
            n = _u(memoryview(blob), i, ">I")
            if blob[i + 4 : i + 8] == b"IDAT":
                body.append(blob[i + 8 : i + 8 + n])
            i += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
        if lines[:, 0].any():
            raise ValueError("only unfiltered lines can be read")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no samples in {kind}")


def feature(samples: bytes, kind: str) -> str:
    """Type, rows of samples, mean and spread, and 8 shares of the histogram in permille."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    spread = (max(float(counts @ (values * values)) / len(x) - mean * mean, 0.0)) ** 0.5
    shares = counts.reshape(8, 32).sum(1) * 1000 // len(x)
    return f"{kind};rows={len(x) // ROW};mean={mean:.3f};spread={spread:.3f};histogram=" + ",".join(map(str, shares))


def kind_of(payload: bytes) -> str:
    """The format that a payload is stored in; it depends on the payload alone."""
    return list(ENCODERS)[zlib.crc32(payload) % len(ENCODERS)]


def store_texts(docs: DataFrame, declared: str = "audio/wav", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, declared_type, media``: each text's bytes as a media blob. All
    rows declare the same type, right or wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = [(t.as_py() or "").encode() for t in part.column(1)]
                media = [encode_samples(p, kind_of(p)) for p in map(padded, raw)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([declared] * len(raw)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared_type", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, declared_type string, media binary")


CARVED = "array<struct<type:string,offset:long,length:long,sha256:string,parent:long>>"
SNIFFED = f"media_type string, type_corrected boolean, media_length long, carved {CARVED}"


def sniff(table: DataFrame, media: str = "media", declared: str = "declared_type", samples: bool = False) -> DataFrame:
    """Add to ``table`` the confirmed ``media_type``, whether it differs from the declared
    one, the confirmed length and the ``carved`` media behind or inside it. With ``samples``
    also what the samples hold: ``payload_bytes, payload_sha256, tail_crc32, feature`` and the
    number of media in it, ``n_payload_media``, and ``media_bytes, media_sha256`` of the blob; the blob itself then goes. Columns of the
    table with one of these names are replaced.
    """
    made = ["media_type", "type_corrected", "media_length", "carved", *(["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_payload_media"] if samples else [])]
    rest = [f for f in table.schema.fields if f.name.lower() not in made and (not samples or f.name != media)]
    blobs, saids = unused(table.columns, "_blob", "_said")
    more = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_payload_media int" if samples else ""
    names = [f.name for f in rest]

    def one(blob: bytes | None, said: str | None) -> tuple:
        found = find_media(blob) if blob is not None else []
        kind = None if blob is None else found[0][0] if found and found[0][1] == 0 else "unknown"
        own = found[0][2] if found and found[0][1] == 0 else None
        carved = [{"type": k, "offset": at, "length": n, "sha256": hashlib.sha256(blob[at : at + n]).hexdigest(), "parent": up} for k, at, n, up in found if at]
        row = (kind, None if kind is None else kind != said, own, carved)
        if not samples:
            return row
        if kind not in ENCODERS:
            return (*row, None, None, None, None if blob is None else len(blob), None if blob is None else hashlib.sha256(blob).hexdigest(), None, None)
        data = decode_samples(blob, kind)
        return (*row, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(data, kind), len(find_media(data)))

    types = [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("parent", pa.int64())]))]
    types += [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()] if samples else []
    out = [*names, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [one(b.as_py(), s.as_py()) for b, s in zip(part.column(blobs), part.column(saids), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), SNIFFED]) + more
    said = F.col(declared) if declared in table.columns else F.lit(None).cast("string")
    return table.select(*quoted(names), F.col(media).alias(blobs), said.alias(saids)).mapInArrow(run, schema)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Texts stored as media in a table of the shared folder, read back and sniffed."""
    return sniff(staged(store_texts(docs), "media"), samples=True)
