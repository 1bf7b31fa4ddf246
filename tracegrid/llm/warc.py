"""WARC archives in Zstandard: one frame for each record, a dictionary in the leading skippable frame.

An archive is a skippable frame that holds the dictionary (itself a Zstandard frame), then one frame for each record.
Writers cut archives by size. Each attempt of a task writes to names of its own, and a settled table of (file, records)
names the files that count; what else lies in the folder, from attempts that were lost or ran twice, is not read, and a
file that lacks or holds other than its number of records is an error. The dictionary is trained on the first records of the archive, up to DICT_SAMPLE.

Reading checks the magic numbers, that each frame ends where the record does, the version line, the needed
headers, Content-Length against the block, and the payload's digest; what fails is an error, never skipped.

Edge cases: a null payload is empty; records of equal payloads, copies of whole rows included, are revisits of that with
the greatest id, if the payload is long enough; rows that repeat the greatest id and its payload are responses too, as
are rows with a null id; an empty table writes no archive and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm.shared import settled, shared_dir

#: The skippable frame's and a frame's magic numbers.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of payload after which a writer begins another archive; bytes that train its dictionary; the dictionary's size.
ARCHIVE_BYTES, DICT_SAMPLE, DICT_BYTES = 16 << 20, 1 << 20, 32 << 10
#: Revisits (about 100 bytes each), and names of archives, up to which their table is sent to every task.
FEW_REVISITS, FEW_FILES = 200_000, 100_000
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key, url: str, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """One record. A revisit has no block of its own and names the response by page and record id."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length))]
    if key is not None:
        head.append(("X-Page-ID", str(key)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError says what is wrong with it."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if missing := [k for k in NEEDED if k not in fields]:
        raise ValueError(f"headers missing: {missing}")
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    block = rest[:size]
    if fields["WARC-Type"] == "response" and fields.get("WARC-Payload-Digest") != f"sha1:{digest_of(block)}":
        raise ValueError("payload digest does not match")
    return fields, block


def archive(records: list[bytes]) -> bytes:
    """A whole archive. Few or alike records can't train a dictionary; theirs is their own beginning."""
    sample, size = [], 0
    for r in records:
        if size >= DICT_SAMPLE:
            break
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(512, size // 10)), sample).as_bytes() if len(sample) >= 8 else sample[0][:512]
    except zstandard.ZstdError:
        trained = sample[0][:512]
    held = zstandard.ZstdCompressor(level=3).compress(trained)
    one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    return struct.pack("<II", DICT_MAGIC, len(held)) + held + b"".join(one.compress(r) for r in records)


def read_archive(data: bytes):
    """(headers, block) of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    body = memoryview(data)
    trained = bytes(body[8 : 8 + size])
    if struct.unpack_from("<I", trained)[0] == FRAME_MAGIC:
        trained = zstandard.ZstdDecompressor().decompress(trained, max_output_size=64 << 20)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    at = 8 + size
    while at < len(data):
        if struct.unpack_from("<I", body, at)[0] != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one = reader.decompressobj()
        parts, end = [], at
        while not one.eof:  # in steps, as the rest of the archive is not this frame's
            if end >= len(data):
                raise ValueError("the last frame is cut short")
            step = body[end : end + (64 << 10)]
            parts.append(one.decompress(step))
            end += len(step)
        at = end - len(one.unused_data)
        yield parse(b"".join(parts))


def revisits(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """(key, d, refers_to) of the revisits, d the payload's SHA-1. Digests alone are shuffled."""
    bytes_ = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    each = settled(pages.select(key, F.sha1(bytes_).alias("d"), F.octet_length(bytes_).alias("n")))
    last = settled(each.where(F.col("n") >= least).groupBy("d").agg(F.max(key).alias("last")))
    return each.join(last, "d").where(F.col("last") > F.col(key)).select(key, "d", F.col("last").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write the rows as archives under ``folder``, which every executor must reach; returns (file, records) as a settled table."""
    seen = settled(revisits(pages.where(F.col(key).isNotNull()), key, payload, least).select(F.col(key).alias("k"), "d", "refers_to"))
    if seen.count() <= FEW_REVISITS:  # payloads stay where they are
        seen = F.broadcast(seen)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("p"), F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")).alias("d"))
    rows = rows.join(seen, ["k", "d"], "left")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        store.create_dir(root, recursive=True)
        attempt, held, size, n = uuid.uuid4().hex, [], 0, 0

        def close():
            name = f"{attempt}-{n:06d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(archive(held))
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(held)]})

        for batch in batches:
            k, u, p, r = (batch.column(batch.schema.get_field_index(c)) for c in ("k", "u", "p", "refers_to"))
            for key_, url_, body, refers in zip(k.to_pylist(), u.to_pylist(), p.cast(pa.binary()).to_pylist(), r.to_pylist(), strict=True):
                body = body or b""
                held.append(record(key_, (url_ or "").replace("\r", "%0D").replace("\n", "%0A"), body, digest_of(body), len(body), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, n = [], 0, n + 1
        if held:
            yield close()

    return settled(rows.select("k", "u", "p", "refers_to").mapInArrow(run, "file string, records bigint"))


def read_archives(spark: SparkSession, folder: str, written: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives that ``written`` names: headers that are needed, and the block if asked for.

    written: (file, records), as write_archives gives it. A file that it names and that is not there is an error.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for data, records in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                for head, block in read_archive(data.as_py()):
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    if head["WARC-Type"] == "response" and number("X-Payload-Length") not in (None, len(block)):
                        raise ValueError("the payload is not as long as its header says")
                    rows.append((number("X-Page-ID"), number("X-Payload-Length"), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number("X-Refers-To-Page"), head.get("WARC-Target-URI"), block)[: len(names)])
                    size, seen = size + len(block), seen + 1
                    if size > 8 << 20 and payloads or len(rows) >= 10_000:
                        yield table(rows)
                        rows, size = [], 0
                if seen != records:
                    raise ValueError(f"an archive holds {seen} records instead of {records}")
                if rows:
                    yield table(rows)

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    told = written.select("file", "records")
    if (n := told.count()) == 0:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    if n <= FEW_FILES:  # contents stay where they are read
        told = F.broadcast(told)
    if (there := files.select(file.alias("file")).join(told, "file").count()) != n:
        raise ValueError(f"{n - there} of {n} archives are missing")
    return files.select(file.alias("file"), "content").join(told, "file").select("content", "records").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, written, payloads=False)


#: SHA-1 in base 32: 32 groups of five bits, looked up in the alphabet.
ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS n, sha1(decode(b)) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
         (CAST('0x' || substr(h || '00', 1 + CAST(i * 5 // 4 AS BIGINT), 3) AS BIGINT) >> CAST(7 - (i * 5) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to, url
FROM m
"""
