"""WARC archives: writer, monolithic gzip normaliser with a sidecar offset index, and indexed reader.

Archives are rows of a binary column, so Spark's own writers and commit protocol put them where all executors reach
them, and a lost task is simply run again.  ``spark.read.format("binaryFile")`` gives the same shape for archives from
elsewhere.

The writer packs the records of a partition into archives of bounded size, each gzipped as one stream (monolithic: no
record can be reached without inflating all before it).  The normaliser inflates such a stream once, piece by piece, cuts
it into records by their headers, rewrites every record as a gzip member of its own, and lists where each one starts; the list
travels with its archive, and :func:`sidecar` makes a table of it.
The reader then inflates single members by the index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import map_columns, materialize
from .near_dup import id_filter, maybe_among

ARCHIVE_BYTES = 2 << 20
PIECE = 1 << 16
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<record_id:string,record_type:string,offset:long,length:long>>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_safe(value: str) -> str:
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in value)


def record(record_id: str, uri: str, payload: bytes, record_type: str, refers_to: str | None) -> bytes:
    """One uncompressed record; a revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_header_safe(uri)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """Named fields of a record or HTTP header, names in lower case."""
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def judge_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with record_type and refers_to (columns of these names are replaced): of rows with equal payloads, those of the largest id are responses.

    Payloads are compared by SHA-1 of their UTF-8 bytes (null: empty).  Rows that repeat the largest id are responses too.
    A null id is smaller than any other; where all are null, all are responses.  Very long payloads are hashed whole; an
    empty table stays empty.  Only digests are shuffled, after partial aggregation, and the pages whose digest may occur more
    than once (a bitmap tells); AQE splits a hot digest on their side of the join.
    """
    kept = [c for c in pages.columns if c not in ("record_type", "refers_to")]
    sha1, last_id, n = (next(x for x in (name + "_" * i for i in range(len(kept) + 1)) if x not in kept) for name in ("sha1", "last_id", "rows"))
    keyed = pages.select(*kept, F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")).alias(sha1))
    counted = keyed.groupBy(sha1).agg(F.max(id_col).alias(last_id), F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    repeated = materialize(counted.withColumn(n, F.xxhash64(sha1)), "repeated")
    placed = keyed.withColumn(n, F.xxhash64(sha1))
    doubt = maybe_among(placed, n, id_filter(repeated, n))
    once = placed.where(~doubt).select(*kept, F.lit("response").alias("record_type"), F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"))
    joined = placed.where(doubt).drop(n).join(repeated.drop(n), sha1, "left")
    last = F.col(last_id).isNull() | F.coalesce(F.col(id_col) == F.col(last_id), F.lit(False))
    return once.union(joined.select(*kept, F.when(last, "response").otherwise("revisit").alias("record_type"), F.when(~last, F.col(last_id)).alias("refers_to")))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, warc): monolithic gzip archives of a record for each row of :func:`judge_revisits`.

    An archive is closed once it holds ``archive_bytes`` of records; a longer payload is an archive of its own, written
    whole.  Null urls and payloads are written empty, a null id as None; repeated rows give a record each, an empty table no
    archive.  Other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, packed, squeeze = TaskContext.get().partitionId(), 0, 0, [], zlib.compressobj(6, wbits=31)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.gz"]), pa.array([b"".join([*packed, squeeze.flush()])], pa.binary())], ["archive", "warc"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for page, url, payload, kind, refers in zip(*columns, strict=True):
                raw = record(str(page), url or "", (payload or "").encode("utf-8", "surrogatepass"), kind, None if refers is None else str(refers))
                packed.append(squeeze.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    n, size, packed, squeeze = n + 1, 0, [], zlib.compressobj(6, wbits=31)
        if size:
            yield close()

    return map_columns(pages, [id_col, url_col, payload_col, "record_type", "refers_to"], kernel, "archive string, warc binary")


def inflate(stream: bytes) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or several members, each byte inflated once.  A cut or broken stream raises zlib.error."""
    rest = memoryview(stream)
    while len(rest):
        member = zlib.decompressobj(wbits=31)
        while len(rest) and not member.eof:
            yield member.decompress(rest[:PIECE])
            rest = rest[PIECE:]
            if member.eof and member.unused_data:
                rest = memoryview(member.unused_data + bytes(rest))
        if not member.eof:
            raise zlib.error("the gzip stream ends early")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive; no more than one record and one piece are held."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("no WARC record where one should start")
                size = headers(bytes(held[:end])).get("content-length", "")
                if not size.isdecimal():
                    raise ValueError("a record without a length")
                need = end + 4 + int(size) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(stream: bytes) -> tuple[bytearray, list[dict], str | None]:
    """An archive as one gzip member for each record, the index of the members, and what ended the reading early, if anything.

    The stream is inflated once.  Of a cut or broken archive the whole records before the fault are kept.
    """
    out, index, error = bytearray(), [], None
    try:
        for raw in split_records(inflate(stream)):
            squeeze = zlib.compressobj(6, wbits=31)
            at = len(out)
            out += squeeze.compress(raw)
            out += squeeze.flush()
            named = headers(raw[: raw.index(b"\r\n\r\n")])
            index.append({"record_id": named.get("warc-record-id"), "record_type": named.get("warc-type"), "offset": at, "length": len(out) - at})
    except (zlib.error, ValueError) as fault:
        error = str(fault)
    return out, index, error


def normalise_archives(archives: DataFrame, name_col: str = "archive", bytes_col: str = "warc") -> DataFrame:
    """(archive, warc, index, error) of each archive: its records as gzip members, and the sidecar index of them.

    A null or empty archive has no records and no error; of a cut or broken one the whole records before the fault stay and
    error says what it was.  Repeated rows give equal rows, an empty table none.  Other columns are not read; a null name
    stays null.  :func:`sidecar` gives the index as rows of its own.
    """
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, stream in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, index, error = normalise(stream.as_buffer() or b"")
                held = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), held, pa.array([index], kind), pa.array([error], pa.string())], ["archive", "warc", "index", "error"])

    return map_columns(archives, [name_col, bytes_col], kernel, f"archive string, warc binary, index {INDEX}, error string")


def sidecar(normalised: DataFrame) -> DataFrame:
    """(archive, record_id, record_type, offset, length): the offset index of normalised archives as a table of its own, to be written beside them."""
    return normalised.select("archive", F.explode("index").alias("entry")).select("archive", "entry.*")


_RECORD = "archive string, offset long, record_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, intact boolean, error string"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string()]


def _bare(name: str | None) -> str | None:
    return None if name is None else name.removeprefix("<").removesuffix(">").removeprefix("urn:page:")


def _parsed(name: str, data: memoryview, entry: dict) -> tuple:
    try:
        raw = zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], wbits=31)
    except (zlib.error, TypeError) as fault:
        return (name, entry["offset"], _bare(entry["record_id"]), None, entry["record_type"], None, None, None, None, False, str(fault))
    head, _, block = raw[:-4].partition(b"\r\n\r\n")
    named = headers(head)
    kind, said = named.get("warc-type"), named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, payload = {}, block
    if named.get("content-type", "").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = headers(first)
    size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
    lead = (name, entry["offset"], _bare(named.get("warc-record-id")), named.get("warc-target-uri"), kind, _bare(named.get("warc-refers-to")))
    if kind == "revisit":
        return (*lead, None, size, said, True, None)
    found = payload_digest(payload)
    return (*lead, payload, len(payload), found, said in (None, found) and size in (None, len(payload)), None)


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each indexed record, its member inflated alone: ids, url, type, payload (null in a revisit), size and digest.

    payload_bytes and payload_digest are of the full payload: counted from it, or in a revisit named by the header (null where
    the header doesn't say).  Records of any type are read: those that carry HTTP have the payload after its header, others
    (warcinfo, resource, metadata ...) their whole block.  intact tells whether size and digest agree with what the headers
    name, if they name them.  A member that doesn't inflate is a row with an error, no payload and intact false.  Archives
    with a null or empty index give no rows; repeated rows give equal rows; other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, index in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                view, rows, held = memoryview(data.as_buffer() or b""), [], 0
                for entry in index or []:
                    rows.append(_parsed(name, view, entry))
                    held += rows[-1][7] or 0
                    if held > ARCHIVE_BYTES or len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    return map_columns(archives, ["archive", "warc", "index"], kernel, _RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write, normalise and read back the pages: :func:`read_records` of their archives, a row for each page."""
    written = materialize(write_archives(judge_revisits(pages, id_col, payload_col), id_col, url_col, payload_col), "warc")
    return read_records(materialize(normalise_archives(written), "warc-members"))
