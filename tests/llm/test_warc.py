from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from quillwork.llm import warc
from quillwork.tables import table

BIG, SMALL = "<p>" + "x" * 120 + "é</p>", "tiny"
ROWS = [(3, "http://a/1", BIG), (1, "http://a/2", BIG), (2, None, SMALL), (4, "http://a/\r\nX: 1", SMALL), (5, "u", None), (6, "u", ""), (1, "http://a/2", BIG), (None, "u", BIG), (7, "u", "日本" * 200), (8, "u", "y" * 100), (9, "u", "y" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99)]
SCHEMA = "page_id long, url string, html string, payload string, file string, offset long, first long"


def brute(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same) if same and len(body) >= 100 and sum((h or "").encode() == body for _, _, h in rows) > 1 else None
        again = first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def test_records_come_back(spark):
    index, folder = warc.archive(pages(spark, ROWS))
    got = warc.read_records(index, folder)
    assert sorted((tuple(r) for r in got.drop("payload").collect()), key=repr) == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in got.filter("record_type = 'response'").collect()}
    assert payloads[1] == BIG.encode() and payloads[5] == b"" and payloads[7] == ("日本" * 200).encode()


def test_selection_reads_its_ranges_only(spark, sf_dir):
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    chosen = index.filter(F.col("page_id") % 7 == 0)
    got = sorted(r.page_id for r in warc.read_records(chosen, folder).collect())
    assert got == sorted(r.page_id for r in chosen.collect())


def test_archives_are_warc_files(spark, tmp_path):
    index, _ = warc.archive(pages(spark, ROWS).coalesce(1), f"file://{tmp_path}")
    rows = sorted(index.collect(), key=lambda r: r.offset)
    data = (tmp_path / rows[0].file).read_bytes()
    assert len({r.file for r in rows}) == 1 and rows[-1].offset + rows[-1].length == len(data)
    members, rest = [], data
    while rest:
        unpack = zlib.decompressobj(31)
        members.append(unpack.decompress(rest))
        rest = unpack.unused_data
    assert len(members) == len(ROWS)
    for m in members:
        head, _, body = m.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n")
        names = [line.split(b":")[0] for line in head.split(b"\r\n")[1:]]
        assert len(names) == len(set(names)) and b"X" not in names
        assert int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)[b"Content-Length"]) == len(body) - 4


def test_empty_table(spark):
    index, folder = warc.archive(pages(spark, ROWS).limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_rewritten_files_are_not_read(spark, tmp_path):
    """A second run of a task leaves files that the index doesn't name."""
    (tmp_path / "stray.warc.gz").write_bytes(b"not an archive")
    index, folder = warc.archive(pages(spark, ROWS), f"file://{tmp_path}")
    assert warc.read_records(index, folder).count() == len(ROWS)


def test_string_ids(spark):
    rows = [(None if p is None else f"page %0A\n{p:02}", u, h) for p, u, h in ROWS]
    index, folder = warc.archive(spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id string, url string, html string, n long, page string"))
    got = warc.read_records(index, folder)
    assert dict(got.dtypes)["page_id"] == dict(index.dtypes)["refers_to"] == "string"
    assert sorted((tuple(r) for r in got.drop("payload").collect()), key=repr) == brute(rows)


def test_very_long_payloads_that_pack_well(spark):
    """Ranges of a few bytes unpack to many batches; each holds PAYLOAD_BYTES or a single record."""
    rows = [(k, "u", f"{k}" + "a" * (3 << 20)) for k in range(12)] + [(99, "u", "b" * (20 << 20))]
    index, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert index.agg(F.sum("length")).first()[0] < 1 << 20
    sizes = warc.read_records(index, folder).select("page_id", "payload_bytes", F.octet_length("payload").alias("n")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.n) for r in sizes) == [(i, len(h), len(h)) for i, _, h in rows]


def test_stores():
    assert warc.open_store("/a/b")[1] == warc.open_store("file:///a/b")[1] == warc.open_store("file:/a/b")[1] == "/a/b"
    for folder in ("s3a://bucket/x?region=us-east-1", "s3n://bucket/x?region=us-east-1"):  # a region, so that none is looked up
        store, path = warc.open_store(folder)
        assert store.type_name == "s3" and path == "bucket/x"
