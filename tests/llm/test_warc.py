import base64
import gzip
import hashlib
import io

from faultweave.llm import warc as W

ROWS = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, None, "other é"), (7, "http://a/\r\nX: 1", None), (8, "u", ""), (2, "http://a/2", "same"), (3, "u", "x" * 300_000), (None, "n", "lone"), (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")


def test_round_trip(spark):
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.warc_round_trip(pages(spark)).collect()), key=str)
    want, seen = [], {}
    for i, _, h in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        raw = (h or "").encode()
        first = seen.setdefault(raw, i)
        again = raw in {(x[2]) for x in want}
        want.append((str(i), len(raw), raw, "revisit" if again else "response", first if again else None))
    want = [(a, b, base64.b32encode(hashlib.sha1(c).digest()).decode(), d, e) for a, b, c, d, e in want]
    assert got == sorted(want, key=str)
    assert W.warc_round_trip(pages(spark).limit(0)).count() == 0


def test_filters_and_modes(spark, tmp_path):
    for packed in ("none", "gzip"):
        folder = str(tmp_path / packed)
        W.write_pages(pages(spark), folder, max_file_bytes="1000", compression=packed)
        rows = W.read_archives(spark, folder).where("record_type = 'response'").collect()
        assert sorted(bytes(r.payload).decode() for r in rows) == sorted({h or "" for _, _, h in ROWS}) and all(r.digest_ok for r in rows)
        skipped = W.read_archives(spark, folder, payload="skip").where("record_type = 'revisit'").collect()
        assert sorted(r.refers_to for r in skipped) == ["<urn:page:2>", "<urn:page:2>", "<urn:page:7>"] and all(r.payload is None for r in skipped)
        one = W.read_archives(spark, folder).where("record_id = '<urn:page:3>'").collect()
        assert [len(r.payload) for r in one] == [300_000]


def test_unwanted_payloads_are_not_read():
    class Stream(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    raw = W.record("response", "<a>", "u", None, b"x" * 10_000) + W.record("response", "<b>", "u", None, b"y" * 10)
    stream = Stream(raw)
    rows = list(W.records(stream, lambda r: r["record_id"] == "<b>", "decode"))
    assert [r[7] for r in rows] == [b"y" * 10] and stream.taken == 10
    assert len(list(W.records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw))), lambda r: True, "verify"))) == 2


def test_push_down():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = W.WarcReader({"path": "/x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3), EqualTo(("payload_digest",), "A")]))
    assert len(left) == 2 and reader.rules == [("record_type", frozenset(["response"]))]
