"""WARC archives: writing with revisit records for repeated payloads, sequential reading.

Every record is a gzip member of its own. The reader never seeks: it inflates the file piece
by piece, takes each record's header, then as many block bytes as Content-Length says, and
checks the block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.shared import run_folder, staged

ARCHIVE_BYTES = 64 << 20   # a task begins a new archive beyond this
PIECE = 1 << 18            # bytes read from a file at once
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def header_value(text: str | None) -> str:
    """A value that keeps to its header line."""
    return "".join(" " if c in "\r\n" else c for c in text or "")


def unquoted(key: str | None) -> str | None:
    return None if key is None else unquote(key)


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One record: an HTTP response with its payload, or a revisit, which has the same HTTP
    header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(f'{key}')}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}",
             f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if key is not None:
        lines.append(f"X-Page-ID: {quote(key)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(f'{refers_to}')}",
                  f"X-Refers-To-Page-ID: {quote(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflater:
    """Bytes of a file of gzip members, member by member."""

    def __init__(self, stream):
        self.stream, self.raw, self.ready, self.unzip = stream, b"", bytearray(), None

    def more(self) -> bool:
        """Inflate a piece more of the current member; False at its end."""
        if self.unzip.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
        self.ready += self.unzip.decompress(self.raw, 4 * PIECE)
        self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True

    def next_member(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.unzip = zlib.decompressobj(31)
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self.more():
                raise ValueError("a record header has no end")
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def end_member(self) -> None:
        while self.more():
            pass
        if self.ready:
            raise ValueError("a gzip member holds more than one record")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, HTTP header, payload) of every record in file order, digests verified."""
    source = Inflater(stream)
    while source.next_member():
        version, *lines = source.until(b"\r\n\r\n").decode().split("\r\n")[:-2]
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = source.take(int(head["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        source.end_member()
        http, _, payload = block.partition(b"\r\n\r\n")
        checks = [("WARC-Block-Digest", block)]
        if head["WARC-Type"] == "response":
            checks.append(("WARC-Payload-Digest", payload))
        for name, data in checks:
            if head.get(name) != f"sha1:{base32_sha1(data)}":
                raise ValueError(f"{name} of {head.get('WARC-Record-ID')} does not fit its bytes")
        yield head, http, payload


def http_length(http: bytes) -> int:
    lines = (x.partition(b":") for x in http.split(b"\r\n"))
    return next(int(v) for k, _, v in lines if k.lower() == b"content-length")


def mark_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, revisit). Among rows with equal payloads of at least
    ``least_bytes`` bytes, those of the largest page_id are responses and the others revisit
    it. A null html is an empty payload; a null page_id counts as the smallest. Rows that
    repeat the largest page_id with the same payload are all responses."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    # digests that repeat are written first: the join then stands alone, so that Spark can
    # broadcast them if they are few, and else split a payload that many pages share
    last = rows.where(F.length("payload") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = staged(last.where("n > 1").drop("n"), run_folder(pages.sparkSession, "warc-digests"), "last")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(last, "same", "left").select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"),
                                                  revisit.alias("revisit"))


def write_archives(marked: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives below ``folder`` (a URI that all
    executors share) and return their manifest (path, records). A task writes under names of
    its own attempt, and only the manifest tells which archives count, so a task that is run
    again leaves no record twice."""
    def run(batches):
        where, below = fs.FileSystem.from_uri(f"{folder}/archives")
        path, out, count = None, None, 0
        for batch in batches:
            for key, url, payload, to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    where.create_dir(below)
                    out = where.open_output_stream(f"{below}/{path}", compression=None)
                zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(zipped.compress(record(key, url, payload, to, revisit)) + zipped.flush())
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/archives/{path}"], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/archives/{path}"], "records": [count]})

    text = marked.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "revisit")
    return staged(text.mapInArrow(run, "path string, records bigint"), folder, "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of all archives: (page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload), ids as text. A revisit's payload is null; its length is that of
    its HTTP header. A manifest whose record count differs from the file's raises."""
    def run(batches):
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                where, below = fs.FileSystem.from_uri(path)
                rows, held, seen = [], 0, 0
                with where.open_input_stream(below, compression=None) as stream:
                    for head, http, payload in read_records(stream):
                        revisit = head["WARC-Type"] == "revisit"
                        rows.append((unquoted(head.get("X-Page-ID")), head["WARC-Target-URI"], head["WARC-Type"],
                                     unquoted(head.get("X-Refers-To-Page-ID")), http_length(http),
                                     head["WARC-Payload-Digest"].removeprefix("sha1:"),
                                     None if revisit or not payloads else payload))
                        held, seen = held + len(payload), seen + 1
                        if held > 4 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, not {records}")

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    archives = manifest.repartition(max(1, manifest.count()))
    return archives.select("path", "records").mapInArrow(
        run, "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, "
             "payload_digest string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """Write all pages as WARC archives in the shared folder and read them back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to). Empty tables give no rows."""
    folder = run_folder(pages.sparkSession, "warc")
    id_type = pages.schema[id_col].dataType
    back = read_archives(write_archives(mark_revisits(pages, least_bytes, id_col, url_col, html_col), folder), payloads=False)
    return back.select(F.col("page_id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(id_type).alias("refers_to"))
