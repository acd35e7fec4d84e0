import io

import pytest

from wayline.llm import warc


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def record(k, payload):
    import hashlib

    return warc.record_bytes("response", f"urn:page:{k}", "http://a/", payload, hashlib.sha256(payload).hexdigest())


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_resumes_after_damage(zipped):
    pack = warc.gzip_member if zipped else bytes
    parts = [pack(record(k, b"payload %d " % k * 40 + b"\r\n\r\nWARC/1.1\r\n not a record")) for k in range(6)]
    whole = b"".join(parts)
    good = list(warc.salvage(File(whole)))
    assert [r["record_id"] for r in good] == [f"urn:page:{k}" for k in range(6)] and all(r["kind"] == "record" for r in good)
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    for at in (0, len(parts[0]) // 2, len(parts[0]) - 2):
        broken = bytearray(whole)
        broken[starts[2] + at] ^= 0xFF
        rows = list(warc.salvage(File(bytes(broken))))
        assert [r["record_id"] for r in rows if r["kind"] == "record"] == [f"urn:page:{k}" for k in (0, 1, 3, 4, 5)]
        assert [(r["start"], r["end"]) for r in rows if r["kind"] == "gap"] == [(starts[2], starts[3])]
    cut = list(warc.salvage(File(whole[:-7])))
    assert [r["kind"] for r in cut] == ["record"] * 5 + ["gap"] and cut[-1]["end"] == len(whole) - 7
    junk = list(warc.salvage(File(b"junk\x1f\x8b\x08" + whole)))
    assert junk[0] | {"reason": ""} == {"kind": "gap", "start": 0, "end": 7, "reason": ""} and len(junk) == 7
    assert list(warc.salvage(File(b""))) == []


def test_pages_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "http://b /", None), (4, "http://c/", ""), (5, "u", "y" * 99), (6, "u", "y" * 99), (7, "u", "é" * 50), (0, "u", "é" * 50), (8, "u", "long " * 100_000), (8, "u", "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect())
    assert out == [(0, 100, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 99, "response", None), (6, 99, "response", None), (7, 100, "revisit", 0), (8, 500_000, "response", None), (8, 500_000, "response", None)]
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_ids_of_any_kind_and_other_columns(spark):
    rows = [("b /ü", "u", "x" * 200, 1), ("a+%", "u", "x" * 200, 2), (None, "u", "x" * 200, 3), ("c", None, "", 4), ("d", None, None, 5)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, payload int").withColumnRenamed("payload", "digest")
    out = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()), key=repr)
    assert out == sorted([("a+%", 200, "response", None), ("b /ü", 200, "revisit", "a+%"), (None, 200, "response", None), ("c", 0, "response", None), ("d", 0, "response", None)], key=repr)


def test_lost_records_are_noticed(spark, monkeypatch):
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda files, folder: read(files, folder).limit(2))
    pages = spark.createDataFrame([(k, "u", "x" * 200) for k in range(5)], "page_id long, url string, html string")
    with pytest.raises(RuntimeError, match="5 records were written, 2 were read"):
        warc.archive_and_read(pages)
