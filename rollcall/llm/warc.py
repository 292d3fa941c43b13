"""Operator 4: a dictionary-compressed WARC writer and its reader.

Every archive begins with a skippable frame that holds a Zstandard dictionary trained on the archive's own records; each record is a
frame of its own, compressed with it, so that any record can be read alone. Records that repeat an earlier payload are written as revisits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, staged, text_batches

# The formats' own.
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one archive are held together up to so many bytes; a dictionary of at most so many bytes is trained on a sample of so many,
#: taken in pieces of SAMPLE_BYTES spread over the whole archive, over long records as over short ones.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 10, 2 << 20, 4096
LEAST_REVISIT = 1000


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, payload, digest, refers_to): refers_to is the largest page_id with the same payload of ``least`` bytes or more, null for itself and for smaller ones."""
    recs = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    same = recs.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    same = staged(same.select(F.xxhash64("digest").alias("k"), F.col("digest").alias("twin"), "top"), shared_dir(pages.sparkSession), "twins")
    # the second key makes Spark exchange both sides for this join alone, so that a hot digest can be split
    joined = recs.join(F.broadcast(same) if bounded(same, 160) else same, (F.xxhash64("digest") == F.col("k")) & (F.col("digest") == F.col("twin")), "left")
    other = F.col("twin").isNotNull() & (F.octet_length("payload") >= least) & ~F.col("top").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("top")).alias("refers_to"))


def record_id(page_id, digest: str) -> str:
    """Different payloads under one page_id are different records; rows that repeat both are one record written twice."""
    return f"<urn:page:{'' if page_id is None else page_id}:sha1:{digest}>"


def page_of(field: str) -> str | None:
    return field.removeprefix("<urn:page:").rpartition(":sha1:")[0] or None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = TRAIN_BYTES):
    """A dictionary from pieces spread evenly over the archive, ``sample`` bytes in all; where there are too few, of their own bytes."""
    import zstandard

    data = b"".join(records)
    some = [data[i : i + SAMPLE_BYTES] for i in range(0, len(data), SAMPLE_BYTES * max(1, -(-len(data) // sample)))]
    try:
        return zstandard.train_dictionary(size, some)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> tuple[bytes, list[int]]:
    """The archive's bytes, and where each record's frame begins."""
    import zstandard

    known = train(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=known)
    raw = known.as_bytes()
    frames = [packer.compress(r) for r in records]
    at = [8 + len(raw)]
    for f in frames[:-1]:
        at.append(at[-1] + len(f))
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *frames]), at


def dictionary(data: bytes):
    """The dictionary in the leading skippable frame (null if that is empty), and where the records begin."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    raw = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None, 8 + size


def frame_ends(data: bytes, at: int) -> Iterator[int]:
    """The end of each frame from ``at`` on, by the lengths that its blocks give: no byte is read twice."""
    import zstandard

    while at < len(data):
        head = zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
        last = 0
        while not last:
            block = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 * head.has_checksum
        yield at


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of the record whose frame begins at ``at``."""
    import zstandard

    return parsed(zstandard.ZstdDecompressor(dict_data=dictionary(data)[0]).decompress(data[at : next(frame_ends(data, at))]))


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, in order."""
    import zstandard

    known, at = dictionary(data)
    opener = zstandard.ZstdDecompressor(dict_data=known)
    for end in frame_ends(data, at):
        yield parsed(opener.decompress(data[at:end]))
        at = end


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(uri: str, date: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, store = TaskContext.get(), _store(uri)
        files, path = store
        files.create_dir(path, recursive=True)
        held, ids, bytes_, done = [], 0, 0, 0

        def close():
            nonlocal held, bytes_, done
            name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{done:04d}.warc.zst"
            data, at = archive(held)
            with files.open_output_stream(name) as out:
                out.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["archive", "records", "bytes", "offsets"])
            held, bytes_, done = [], 0, done + 1
            return row

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page, url, payload, digest, refers, date))
                bytes_ += len(held[-1])
                if bytes_ >= size:
                    yield close()
        if held:
            yield close()

    return run


def write_warc(pages: DataFrame, uri: str | None = None, date: str = "2024-01-01T00:00:00Z", size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of the rows of ``pages`` under ``uri`` (a new shared folder by default) and returns their manifest (archive, records, bytes, offsets): offsets say where
    each record begins, so that one can be read alone.

    Only archives in the manifest count: what a lost task left behind has another name. Null payloads are empty, null URLs too; rows that
    repeat a page_id each have a record; a payload longer than ``size`` has an archive of its own; an empty table gives no archive; columns
    other than page_id, url and html are ignored.
    """
    at = shared_dir(pages.sparkSession)
    text_batches(pages.sparkSession)
    rows = mark_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return staged(rows.mapInArrow(_write(uri or f"{at}/archives", date, size), "archive string, records long, bytes long, offsets array<long>"), at, "manifest")


def _read(uri: str):
    def run(batches):
        files, _ = _store(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(name) as src:
                    data = src.read()
                out: list[list] = [[] for _ in range(6)]
                for fields, block in read_archive(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    response = fields["WARC-Type"] == "response"
                    size = len(payload) if response else int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                    digest = hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    values = (page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To", "")))
                    for c, v in zip(out, values):
                        c.append(v)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the manifest's archives; length and digest of a response are those of the payload read."""
    shape = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    names = manifest.select("archive")
    first = names.first()
    return names.repartition(spark.sparkContext.defaultParallelism * 2, "archive").mapInArrow(_read(first[0] if first else "/"), shape)


def warc_report(pages: DataFrame) -> DataFrame:
    """The contract's columns, read back from the archives that were written."""
    kind = dict(pages.dtypes)["page_id"]
    back = read_warc(pages.sparkSession, write_warc(pages))
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
