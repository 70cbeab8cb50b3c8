import base64
import glob
import hashlib
import struct

from skyloom.llm import warc


def test_pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "common words here " * (i % 9 + 1) + str(i) + "</p>", 1) for i in range(400)]
    rows += [(1000 + i, "http://same", "copy", 1) for i in range(50)]
    rows += [(2000, None, None, 1), (2001, "u\r\nEvil: 1", "", 1), (2002, "x", "\n\r\n WARC/1.1\r\n é", 1), (7, "http://x/7", rows[7][2], 1), (None, "n", "copy", 1), (None, "n", "alone", 1), (None, "n", "alone", 1), (3001, "r", "again", 1), (3001, "r", "again", 1), (9, "r", "again", 1), (3000, "l", "long é" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(7)
    folder = warc.write(df)
    out = sorted(map(tuple, warc.read_index(spark, folder).collect()), key=str)
    by = {}
    for p, _, h, _ in rows:
        by.setdefault(h or "", []).append(p)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        last = max((x for x in by[h or ""] if x is not None), default=None)
        revisit = last is not None and (p is None or p < last)
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert out == sorted(want, key=str)
    payloads, ids, named = {}, [], set()
    for f in glob.glob(folder.removeprefix("file:") + "/part-*"):
        data = open(f, "rb").read()
        assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
        for headers, block in warc.read(data):
            ids.append(headers["warc-record-id"])
            named |= {headers["warc-refers-to"]} if "warc-refers-to" in headers else set()
            payloads[headers["page-id"]] = warc.payload_of(headers, block)[2]
    assert len(ids) == len(set(ids)) == len(rows) and named and named <= set(ids)
    assert payloads["2002"].decode() == rows[452][2]
    assert warc.read_index(spark, warc.write(df.limit(0))).collect() == []


def test_small_archives():
    records = [warc.record(i, "u", b"x" * 1000 + bytes([i]), None) for i in range(50)]
    assert sum(1 for a in warc.archives(iter(records), b"", 100) for _ in warc.read(a)) == 50
