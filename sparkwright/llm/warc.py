"""WARC archives: writing, and normalising whole-file gzip streams.

``write`` packs records into archives that are one gzip stream each, the way
monolithic crawls arrive.  ``normalise`` inflates such a stream once, in
pieces, writes every record as a gzip member of its own and a sidecar with the
offset of each, after which any record can be read alone.  ``read`` follows the
sidecar.  Archives are bounded by the partition they come from, records are
streamed, and only archives named by a committed manifest are ever read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import storage

PIECE = 1 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long"
INDEX = pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    part = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if part == "none" else int(part)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    z = zlib.decompressobj(31)
    while data := source.read(PIECE):
        while data:
            yield z.decompress(data, PIECE)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head and whole bytes of each record of an inflated stream; one record is held at a time."""
    held = bytearray()
    seen = 0
    need: int | None = None
    fields: dict[str, str] = {}
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(held)
                    break
                fields = parse_head(bytes(held[:end]))
                need = end + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need, seen = None, 0
    if held:
        raise ValueError("archive is cut short")


def _name(suffix: str) -> str:
    context = TaskContext.get()
    return f"part-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}{suffix}"


def _row(name: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [name], "records": [n]})


def assign(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each page.

    Of equal payloads of at least ``smallest`` bytes, rows with the least
    page_id (nulls aside) are originals and the others refer to it.  Digests
    that occur once never leave their partition except as counts.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= smallest
    original = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("digest", "original")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return rows.join(original, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(assigned: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Archives of one gzip stream for each partition; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system, root = storage.open_fs(folder)
                    system.create_dir(root, recursive=True)
                    name, n, z = _name(".whole.warc.gz"), 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(z.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_to"] is not None)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield _row(name, n)

    return storage.keep(assigned.mapInArrow(run, MANIFEST), "whole")


def _files(manifest: DataFrame) -> DataFrame:
    """The manifest dealt over all cores."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def normalise(manifest: DataFrame, folder: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives of ``manifest`` in ``folder`` below ``target``, a member for each record, with sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source_fs, source_root = storage.open_fs(folder)
        system, root = storage.open_fs(target)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                name, at, index = _name(".warc.gz"), 0, []
                with source_fs.open_input_stream(f"{source_root}/{row['file']}", compression=None) as source, system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for fields, data in records(inflate(source)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        index.append((at, len(member), fields["warc-record-id"], fields["warc-type"]))
                        at += len(member)
                with system.open_output_stream(f"{root}/{name}.idx") as out:
                    pq.write_table(pa.table([pa.array(x) for x in zip(*index, strict=True)] if index else [[]] * 4, schema=INDEX), out)
                yield _row(name, len(index))

    return storage.keep(_files(manifest).mapInArrow(run, MANIFEST), "normal")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record, found by the sidecars.

    The digest of each payload is computed again and must equal the one stored.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}.idx") as source:
                    index = pq.read_table(source)
                out: list[tuple] = []
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    for at, length in zip(index.column("offset").to_pylist(), index.column("length").to_pylist(), strict=True):
                        source.seek(at)
                        head, _, block = zlib.decompress(source.read(length), 31).partition(b"\r\n\r\n")
                        fields = parse_head(head)
                        http, _, payload = block[:-4].partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} in {row['file']} differs from its digest")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        refers = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                        out.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], refers, fields.get("warc-target-uri")))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _files(manifest).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages (page_id, url, html)`` as whole-file archives, normalise these, read all records back.

    Null html is an empty payload; a null page_id stays null and is never an
    original; repeated rows give a record each, and all with the least id are
    responses; other columns are ignored; an empty table gives no archive.
    """
    spark = pages.sparkSession
    whole, normal = storage.scratch(spark, "whole-warc"), storage.scratch(spark, "warc")
    manifest = normalise(write(assign(pages), whole), whole, normal)
    storage.delete(spark, whole)
    return read(manifest, normal)
