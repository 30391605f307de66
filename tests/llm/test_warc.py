import hashlib
import io
import random
import zipfile

import pytest

from tidewick.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_round_trip(spark):
    big, other = "<p>é</p>" * 50, "z" * 100
    rows = [(5, "http://a", big), (3, "http://b", big), (9, None, big), (1, "u r l\n", "short"), (2, "x", "short"), (4, "x", None), (6, "x", ""), (7, "x", other), (8, "x", other), (8, "x", other), (None, "x", other), (11, "x", "WARC/1.1\r\n\r\n" * 30)]
    got = W.archive_and_read(spark, pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.verified is not False for r in got)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[h or ""] if len(b) >= 100 else i
        want.append(((i is None, i or 0), len(b), hashlib.sha256(b).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    assert sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=str) or {str(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got} == set(map(str, want))
    assert W.archive_and_read(spark, pages(spark, [(1, "a", "b")]).where("false")).count() == 0


def directory(data):
    return W.directory(lambda o, n: data[o : o + n], len(data))


def test_directory_reads_what_zipfile_writes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            with z.open(f"m{i}", "w", force_zip64=i % 2 == 0) as f:
                f.write(bytes([i]) * i * 10)
        z.comment = b"PK\x05\x07 comment"
    data = out.getvalue()
    for i in range(5):
        o, n = directory(data)[f"m{i}"]
        assert data[o : o + n] == bytes([i]) * i * 10


def test_zip64_directory():
    """So many members that only the ZIP64 records can count them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"{i}", b"")
    assert len(directory(out.getvalue())) == 66_000


def test_damage_is_an_error():
    for junk in (b"", b"not a zip", random.Random(1).randbytes(500)):
        with pytest.raises(ValueError):
            directory(junk)
    with pytest.raises(ValueError):
        W.parse_record(b"HTTP/1.1 200\r\n\r\n")
    with pytest.raises(ValueError):
        W.parse_record(W.record(1, "u", b"payload", "d", None)[:-20])


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    from tidewick.llm import registry

    big = "<p>é</p>" * 50
    rows = [(5, "http://a", big), (3, "http://b", big), (None, None, big), (1, "u", "short"), (2, "x", "short"), (4, "x", None), (6, "x", "")]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    r = con.execute(registry.oracle_sql()["op8_warc"])
    names = [c[0] for c in r.description]
    want = sorted((dict(zip(names, x)) for x in r.fetchall()), key=str)
    got = sorted(({n: row[n] for n in names} for row in W.op8_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == want
