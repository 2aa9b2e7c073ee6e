"""WARC archives with an index that is written first: records are read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.skew import join_counted
from quillwork.storage import new_path, written

MIN_REVISIT_BYTES = 100
FILE_BYTES = 1 << 30
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOAD_BYTES = 8 << 20  # of unpacked payloads that a batch holds, or a single larger one
# Ids are written and read as text, and have the pages' own type again in the tables.
_INDEX = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, file string, offset long, length long"
_RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
# Names of the same stores in the cluster's file system and in Arrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs", "wasbs": "abfs"}


def open_store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder that Spark names: a local one, or one of Arrow's stores (s3, gs, abfs, hdfs;
    credentials come from the workers' environment). Other schemes are opened through fsspec if it is there."""
    scheme, _, rest = folder.partition(":")
    if "://" not in folder and not (rest.startswith("/") and scheme.isalpha()):
        return pyarrow.fs.LocalFileSystem(), folder
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return pyarrow.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        try:
            import fsspec
        except ModuleNotFoundError:
            raise ValueError(f"archives can't be written to {folder}: Arrow has no file system of this scheme") from None
        store, path = fsspec.core.url_to_fs(folder)
        return pyarrow.fs.PyFileSystem(pyarrow.fs.FSSpecHandler(store)), path


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload and its size, digest, record type and the page it refers to.

    Of equal payloads of MIN_REVISIT_BYTES or more, the one with the smallest page_id (null last) is a response and
    the rest refer to it; rows that repeat that page_id are responses too. Digests are counted before rows meet them,
    and only those that repeat are joined; rows of a frequent payload stay where they are.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    first = written(rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated-payloads")
    joined = join_counted(rows, first, "payload_digest", pages.count(), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), "payload")


def _field(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _quoted(page_id: str | None) -> str:
    """An id on one line: - for null, else = and the id with what isn't printable, and %, escaped."""
    return "-" if page_id is None else "=" + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", page_id)


def _id(quoted: str | None) -> str | None:
    return None if quoted in (None, "-") else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), quoted[1:])


def _record_id(page_id: str | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(row: dict) -> bytes:
    """A gzip member with one WARC record: the HTTP headers, and the payload unless it is a revisit."""
    payload = row["payload"].encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    if not revisit:
        block += payload
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_record_id(row['page_id'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_field(row['url'] or '')}"]
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Page-ID: {_quoted(row['page_id'])}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'])}", f"X-Refers-To-Page-ID: {_quoted(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The record in a gzip member. Its payload is checked against its digest; a revisit has none."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {"page_id": _id(fields.get("X-Page-ID")), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _id(fields.get("X-Refers-To-Page-ID")), "payload": None if revisit else payload}


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of ``plan_records`` as .warc.gz files in ``folder``; the index: file, offset, length and all
    but the payload of each.

    A task writes files of its own, named at random, so a task that is run again leaves those of its first run unread:
    the index, written to the shared folder, names the files of one run of each.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = record(row)
                out.write(member)
                row.pop("payload")
                index.append(row | {"file": name, "offset": offset, "length": len(member)})
                offset += len(member)
            if out is not None:
                out.flush()
            yield pa.RecordBatch.from_pylist(index, _schema(_INDEX))
        if out is not None:
            out.close()

    kind = records.schema["page_id"].dataType
    text = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return written(text.mapInArrow(apply, _INDEX).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}), "warc-index")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the rows of ``index`` (a whole index, or any selection), read from the archives.

    Ranges are sorted by file and offset, and those up to GAP_BYTES apart are read as one, up to RANGE_BYTES. Records
    leave a task whenever their unpacked payloads are PAYLOAD_BYTES, so that much or a single larger one is held.
    """
    stripe = F.floor(F.col("offset") / RANGE_BYTES)
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))  # index rows are small, what they name is not
    wanted = index.select("file", "offset", "length").repartition(tasks, "file", stripe).sortWithinPartitions("file", "offset")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        source, name = None, None
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            while k < len(rows):
                first, last = rows[k], k + 1
                end = first["offset"] + first["length"]
                while last < len(rows) and rows[last]["file"] == first["file"] and rows[last]["offset"] - end <= GAP_BYTES and rows[last]["offset"] + rows[last]["length"] - first["offset"] <= RANGE_BYTES:
                    end = max(end, rows[last]["offset"] + rows[last]["length"])
                    last += 1
                if name != first["file"]:
                    if source is not None:
                        source.close()
                    name = first["file"]
                    source = store.open_input_file(f"{path}/{name}")
                blob = source.read_at(end - first["offset"], first["offset"])
                found, held = [], 0
                for r in rows[k:last]:
                    at = r["offset"] - first["offset"]
                    found.append(parse(blob[at : at + r["length"]]))
                    held += len(found[-1]["payload"] or b"")
                    if held >= PAYLOAD_BYTES:
                        yield pa.RecordBatch.from_pylist(found, _schema(_RECORD))
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, _schema(_RECORD))
                k = last
        if source is not None:
            source.close()

    kind = index.schema["page_id"].dataType
    return wanted.mapInArrow(apply, _RECORD).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> tuple[DataFrame, str]:
    """Writes ``pages`` to archives in ``folder`` (a new one in the shared folder): the index and the folder.

    Null html is an empty payload, a null url an empty one, a null page_id stays null; rows that repeat a page_id are
    records of their own; ids have any type that is ordered and can be read from text. A very long payload is a record
    like any other, whole in a task. Other columns are not read, whatever their names. An empty table gives an empty
    index.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    return write_archives(plan_records(pages, **columns), folder), folder
