"""Archives: round trips, coalesced reads, damaged records."""

import gzip
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from voltarc.llm import queries, warc

BIG = "<p>é</p>" * 40
ROWS = [(5, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (None, "http://a/3", BIG),
        (1, "http://a/4", "short"), (3, "http://a/ 5\r\nX: y", "short"), (4, "", None), (6, "u", ""),
        (2, "http://a/2", BIG), (7, "v", "\r\n\r\n" * 50), (8, "w", "x" * 3_000_000),
        (2**62 + 1, "z", "x" * 3_000_000), (None, "n", "y" * 100), (None, "n", "y" * 100)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        f = first.get(h) if len(b) >= 100 else None
        again = f is not None and i != f
        out.append((i, u, "revisit" if again else "response", f if again else None, len(b),
                    hashlib.sha256(b).hexdigest(), None if again else b))
    return sorted(out, key=repr)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("file_bytes", [1, 2000, warc.FILE_BYTES])
def test_round_trip(spark, tmp_path, file_bytes):
    pages = pages_of(spark, ROWS).repartition(3).withColumns(
        {c: F.lit("mine") for c in ("payload", "digest", "first", "revisit", "offset")})
    index = warc.write_archives(pages, str(tmp_path), file_bytes=file_bytes)
    got = warc.read_archives(index, str(tmp_path), chunk=500).collect()
    assert sorted(((*r[:-1], None if r.payload is None else bytes(r.payload)) for r in got),
                  key=repr) == expected(ROWS)
    # every file is a whole sequence of gzip members, the index names each record
    listed = {(r.file, r.offset): r.length for r in index.collect()}
    assert len(listed) == len(ROWS)
    for name in {f for f, _ in listed}:
        data = (tmp_path / name).read_bytes()
        raw = gzip.decompress(data)
        assert raw.count(b"WARC/1.1\r\n") == 1 + sum(f == name for f, _ in listed)
        for (f, at), n in listed.items():
            if f == name:
                fields, block = warc.parse(data[at:at + n])
                assert int(fields["Content-Length"]) == len(block)


def test_selected_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 30) for i in range(200)]
    index = warc.write_archives(pages_of(spark, rows), str(tmp_path))
    got = warc.read_archives(index.where("page_id % 7 = 0"), str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [
        (i, h) for i, _, h in rows if i % 7 == 0]


def test_coalesced_reads():
    assert warc.coalesced([]) == []
    ranges = [(10, 5), (15, 5), (40, 10), (51, 4), (1000, 2000), (3000, 1)]
    assert warc.coalesced(ranges, gap=0, most=100) == [(0, 2, 10), (2, 3, 10), (3, 4, 4),
                                                       (4, 5, 2000), (5, 6, 1)]
    assert warc.coalesced(ranges, gap=20, most=100) == [(0, 4, 45), (4, 5, 2000), (5, 6, 1)]
    assert warc.coalesced(ranges, gap=1000, most=10_000) == [(0, 6, 2991)]


def test_damage_is_found(spark, tmp_path):
    index = warc.write_archives(pages_of(spark, ROWS[:1]).coalesce(1), str(tmp_path))
    row = index.first()
    body = b"other"
    bad = warc.page_record(5, "http://a/1", body, hashlib.sha256(b"!").hexdigest(), "d")
    with pytest.raises(ValueError):
        warc._records([(bad, "http://a/1")])
    path = tmp_path / row.file
    data = bytearray(path.read_bytes())
    data[row.offset + row.length // 2] ^= 255
    path.write_bytes(data)
    with pytest.raises(Exception):
        warc.read_archives(index, str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    index = warc.write_archives(pages_of(spark, []), str(tmp_path))
    assert warc.read_archives(index, str(tmp_path)).count() == 0
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".gz")]


def test_query_equals_sql(spark, same):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/sf0.01/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_warc"]).fetchdf()
    same(queries.op12_warc(spark, f"{DATA}/sf0.01").select(*want.columns), want)
