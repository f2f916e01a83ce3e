"""Operator 10: WARC archives with a two-level capture index.

Pages are range-partitioned by their reversed-host URL keys. A task writes its records, each a gzip member, to one archive
and the sorted captures in compressed blocks to an index file beside it; the block directory, a row for each block, is a
Parquet table. A look-up finds the block in the directory, searches the block by bisection and reads the record's bytes.
Reading everything goes through the directory too: one read of the index and one of the archive for each block.

Of records with equal payloads, that of the largest page_id is a response and others revisit it. A revisit has the HTTP
header of the whole response, so its Content-Length is that of the payload.

Files are written with pyarrow's file systems to the folder's URI, under a name of the attempt first and then moved, so a
lost task can be repeated.

Nulls: a null html is an empty payload, a null url an empty one; a null page_id is smaller than any. Rows of equal page_id
and payload are records of one type. An empty table gives no archives' rows. Other columns are not read."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, parts, shared_folder

#: A block ends with this many captures or with the record that reaches this many bytes of the archive.
BLOCK_CAPTURES, BLOCK_BYTES, LEVEL = 512, 4 << 20, 3
DIRECTORY = "first_key string, last_key string, archive string, index_at long, index_bytes long, at long, bytes long, captures int"
_directory = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("archive", pa.string()), ("index_at", pa.int64()), ("index_bytes", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()), ("captures", pa.int32())])
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """The host's labels reversed and joined by commas, a port that is not the scheme's own, then ")" and what follows; lower case in the host. Controls are written as spaces."""
    url = F.translate(F.coalesce(url, F.lit("")), "\t\r\n", "   ")
    front = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?"
    scheme, host, port = (F.lower(F.regexp_extract(url, front, k)) for k in (1, 2, 3))
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == ""), "").otherwise(F.concat(F.lit(":"), port))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record as it stands in the archive, before compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.translate({9: "%09", 10: "%0A", 13: "%0D"}))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC fields, the payload's length by its HTTP header, the payload that is there) of a record. A response whose digest is wrong is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and (len(payload) != length or "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"]):
        raise ValueError("a payload isn't what its record says")
    return fields, length, payload


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark resolves it: one without a scheme is in the default file system, not on each machine's disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def write(pages: DataFrame, folder: str, partitions: int | None = None) -> None:
    """pages (page_id, url, html) as archives, index files and directory in the folder, a URI. html is shuffled once; which records are revisits comes along as narrow rows."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    filled = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", url_key(F.col("url")))
    narrow = filled.select("page_id", "key", F.unhex(F.sha1(F.encode("html", "utf-8"))).alias("digest"))
    same = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    # One payload, the empty one say, may be that of very many pages.
    revisits = join_unique(narrow, same, "digest", "n", pages.count()).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    flags = revisits.select("key", "page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = filled.select("key", "page_id", F.lit(None).cast("binary").alias("digest"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    both = flags.union(rows).repartitionByRange(partitions or parts(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "kind", "digest", "html")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, files, at = TaskContext.get(), *_files(folder)
        name = f"{context.partitionId():07d}"
        own = f"{at}/.{name}-{context.taskAttemptId()}"
        files.create_dir(at, recursive=True)
        blocks, lines, place, index_at, begun = [], [], 0, 0, 0
        with files.open_output_stream(own + ".warc.gz", compression=None) as out, files.open_output_stream(own + ".idx", compression=None) as index:

            def done() -> None:
                nonlocal index_at, begun, lines
                raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
                index.write(raw)
                blocks.append((lines[0][0], lines[-1][0], name, index_at, len(raw), begun, place - begun, len(lines)))
                index_at, begun, lines = index_at + len(raw), place, []

            known, flagged = None, {}
            for batch in batches:
                for key, page_id, digest, kind, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                    if known != (key, page_id):
                        known, flagged = (key, page_id), {}
                    if kind == 0:
                        flagged[digest] = refers_to
                        continue
                    payload = html.encode()
                    refers = flagged.get(hashlib.sha1(payload).digest()) if flagged else None
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, refers, refers is not None)) + packer.flush()
                    out.write(raw)
                    lines.append((key, "" if page_id is None else page_id, place, len(raw)))
                    place += len(raw)
                    if len(lines) == BLOCK_CAPTURES or place - begun >= BLOCK_BYTES:
                        done()
            if lines:
                done()
        for end in (".warc.gz", ".idx"):
            files.move(own + end, f"{at}/{name}{end}")
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks, strict=True), _directory, strict=True)], schema=_directory)

    both.select("key", "page_id", "digest", "kind", "url", "html", "refers_to").mapInArrow(archive, DIRECTORY).write.mode("overwrite").parquet(f"{folder}/directory")


def _captures(files, at: str, archive: str, index_at: int, index_bytes: int) -> list[list[str]]:
    with files.open_input_file(f"{at}/{archive}.idx") as f:
        f.seek(index_at)
        return [x.split("\t") for x in zlib.decompress(f.read(index_bytes)).decode().split("\n")]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record, read from the archives."""
    folder = qualified(spark, folder)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _files(folder)
        for batch in batches:
            for archive, index_at, index_bytes, begun, size in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                with files.open_input_file(f"{at}/{archive}.warc.gz") as f:
                    f.seek(begun)
                    region = f.read(size)
                out = []
                for _, _, place, length in _captures(files, at, archive, index_at, index_bytes):
                    fields, payload_bytes, _ = parse(zlib.decompress(region[int(place) - begun : int(place) - begun + int(length)], 31))
                    out.append((number(fields["WARC-Record-ID"]), payload_bytes, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, fields.get("WARC-Target-URI")))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    blocks = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory").select("archive", "index_at", "index_bytes", "at", "bytes")
    return blocks.repartition(parts(spark)).mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def look_up(spark: SparkSession, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """(fields, payload) of each record of the URL. Only blocks whose range of keys has its key are read, by the directory."""
    folder = qualified(spark, folder)
    key = spark.range(1).select(url_key(F.lit(url))).first()[0]
    blocks = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory").where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("archive", "index_at").collect()
    files, at = _files(folder)
    out = []
    for block in blocks:
        captures = _captures(files, at, block["archive"], block["index_at"], block["index_bytes"])
        k = bisect_left([c[0].encode() for c in captures], key.encode())
        with files.open_input_file(f"{at}/{block['archive']}.warc.gz") as f:
            while k < len(captures) and captures[k][0] == key:
                f.seek(int(captures[k][2]))
                fields, _, payload = parse(zlib.decompress(f.read(int(captures[k][3])), 31))
                out.append((fields, payload))
                k += 1
    return out


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
