import base64
import hashlib

import pytest

from linework.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")


ROWS = [(1, "http://a/ü", "same"), (2, "b", "same"), (3, "c", "same"), (4, None, None), (5, "d\r\nX: 1", ""), (6, "e", "é" * 100_000), (7, "f", "7"), (7, "f", "7"), (None, "g", "null id")]


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    got = sorted(warc.round_trip(pages(spark, ROWS).repartition(3), least).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    want, led = [], set()
    for i, _, h in sorted(ROWS, key=lambda r: (r[0] or 0)):
        data = (h or "").encode()
        best = max((j for j, _, x in ROWS if (x or "") == (h or "") and j is not None), default=None)
        again = (i != best or data in led) and len(data) >= least  # of rows with the same page_id one leads
        led |= set() if again else {data}
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None, None if again else data))
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got] == want


def test_hot_payload(spark):
    rows = [(i, "u", "hot" if i % 3 else f"p{i}") for i in range(3000)]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert all(got[i].refers_to == (2999 if i % 3 and i != 2999 else None) for i in range(3000))


def one(**change):
    return warc.record(9, "u", b"payload", None, "response")


def test_layout_and_checks():
    records = [warc.record(i, f"u{i}", b"text %d " % i * 40, None, "response") for i in range(50)]
    data = warc.archive(records)
    assert list(warc.frames(data)) == records
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    for bad in (b"", data[:6], b"x" + data[1:], data[:-3], data[:-40] + b"\0" * 40):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    good = one()
    assert warc.content(*warc.parse(good)) == (7, b"payload")
    for bad in (good[1:], good[:-1], good.replace(b"payload", b"pAyload"), good.replace(b"WARC-Type", b"WARC-Typo"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b"WARC/1.1\r\nx"):
        with pytest.raises(ValueError):
            warc.content(*warc.parse(bad))


def test_damaged_archive_fails_by_name(spark):
    data = warc.archive([one()] * 20)
    stored = spark.createDataFrame([("a.warc.zst", bytearray(data[:-2]))], "name string, content binary")
    with pytest.raises(Exception, match="a.warc.zst"):
        warc.records(stored).collect()


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_repeated_rows_have_one_response(spark):
    rows = [(7, "a", "same"), (7, "b", "same"), (7, "b", "same"), (3, "c", "same"), (7, "d", "other"), (None, "e", "none"), (None, "f", "none")]
    got = warc.round_trip(pages(spark, rows).repartition(3)).collect()
    kinds = sorted((r.url in ("e", "f"), r.payload_bytes, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(False, 4, "response", 0), (False, 4, "revisit", 7), (False, 4, "revisit", 7), (False, 4, "revisit", 7), (False, 5, "response", 0), (True, 4, "response", 0), (True, 4, "revisit", 0)]
