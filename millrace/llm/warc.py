"""WARC archives with revisit records, and the resolution of revisits to their responses.

Headers (page_id, payload digest, size) are shuffled by digest and aggregated before the shuffle, so a payload that
many pages share is one row a task. Payloads do not move: each task learns which of its digests repeat and writes
its pages as response or revisit records, gzipped one by one, with fresh headers. Archives are read by the manifest of
those that a task has finished: what a task left that died, or that ran twice, isn't in it. Reading gives the headers;
revisits are joined to the responses that they refer to.

Null html counts as an empty payload; payloads below `least` bytes are always responses. Of equal payloads the
smallest page_id is the response. Rows with a null page_id revisit it, or are responses where no row of the group
has an id; rows that repeat the smallest page_id are responses too. Record ids are made of page_id and digest; of rows that
repeat both, the first has that id, and the others' are made of their place, too (the input is read twice, and its rows
must have the same places each time, as those of files have). Dates are that of the writing. A null url is written as urn:page:<page_id>.
Payloads of any length are written and digested whole; a task holds one record beside the archive that it fills. An
empty table gives no archive and no row. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import file_system, put_file, shared_dir, small_side, table, trimmed, written

LEAST_BYTES = 100
#: Compressed bytes after which a writer begins another archive.
BYTES_PER_FILE = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to_record string"


def record_id(page_id: int | None, digest: str, copy: int | None = None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' + ('' if copy is None else f':{copy}'))}>"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str | None = None, copy: int | None = None) -> bytes:
    """A gzipped record: a response, or a revisit of the response with the page_id refers_to. copy: tells it from other rows of the same page_id and payload; date: now, if it isn't given."""
    date = date or now()
    digest = hashlib.sha256(payload).hexdigest()
    uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def records(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, gzipped or not."""
    raw = io.BufferedReader(data if isinstance(data, io.RawIOBase) else io.BytesIO(data))
    source = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, source.read(int(head["content-length"]))


def heads_of(pages: DataFrame) -> DataFrame:
    """page_id, at, digest, size of all pages: what is known of payloads where they don't move."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "at", F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).alias("size"))


def repeated(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """digest and response_id of the payloads that more than one page has."""
    groups = heads.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1 AND response_id IS NOT NULL").select("digest", "response_id")


def copies(heads: DataFrame) -> DataFrame:
    """of_page, copied (a digest) and the smallest place, first, of the rows that share both."""
    groups = heads.groupBy(F.col("page_id").alias("of_page"), F.col("digest").alias("copied")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").drop("n")


def _writer(folder: str, bytes_per_file: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, held, size, n = TaskContext.get(), 0, [], 0, 0
        own = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}"  # no two attempts write the same file

        def flush() -> pa.RecordBatch:
            name = f"{own}-{seq:06d}.warc.gz"
            put_file(f"{folder}/{name}", b"".join(held))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to, copy in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "copy"))):
                held.append(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), date, copy.as_py()))
                size, n = size + len(held[-1]), n + 1
                if size >= bytes_per_file:
                    yield flush()
                    held, size, n, seq = [], 0, 0, seq + 1
        if held:
            yield flush()

    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, bytes_per_file: int = BYTES_PER_FILE) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and returns the manifest: file, n_records."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.monotonically_increasing_id().alias("at"))
    heads = written(heads_of(pages), "page-heads")
    known, twice = small_side(written(repeated(heads, least), "repeated-payloads")), small_side(written(copies(heads), "repeated-pages"))
    told = pages.withColumn("digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)).join(known, "digest", "left")
    told = told.join(twice, (F.col("digest") == F.col("copied")) & F.col("page_id").eqNullSafe(F.col("of_page")), "left")
    told = told.select("page_id", "url", "html", F.when(F.col("at") != F.col("first"), F.col("at")).alias("copy"), F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))
    schema = "file string, n_records long"
    told.mapInArrow(trimmed(_writer(f"{folder}/archives", bytes_per_file, now())), schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def _reader(folder: str):
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_record", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for name in (x for batch in batches for x in batch.column("file").to_pylist()):
            rows: list[tuple] = []
            with fs.open_input_file(f"{path}/{name}") as data:
                for head, block in records(data.read_buffer()):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else head["warc-payload-digest"].partition(":")[2]
                    page_id = int(head["page-id"]) if "page-id" in head else None
                    rows.append((head["warc-record-id"], page_id, kind, digest, len(payload) if kind == "response" else None, head.get("warc-refers-to")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return read


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The headers of all records of the archives in a manifest, or of all archives in a folder; digests and sizes of responses are those of the payloads read."""
    if manifest is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
        manifest = found.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return manifest.select("file").repartition(F.col("file")).mapInArrow(trimmed(_reader(folder)), RECORD)


def resolve(heads: DataFrame) -> DataFrame:
    """Joins revisits to the responses that they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit whose response is not in the archives keeps null payload_bytes and refers_to.
    """
    responses = heads.where("record_type = 'response'")
    revisits = heads.where("record_type = 'revisit'")
    referred = responses.where("payload_bytes > 0").groupBy(F.col("record_id").alias("refers_to_record"), "payload_digest").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("bytes"))
    found = revisits.join(referred, ["refers_to_record", "payload_digest"], "left").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    if not manifest.limit(1).count():
        return resolve(spark.createDataFrame([], RECORD))
    heads = read_archives(spark, f"{folder}/archives", manifest)
    return resolve(written(heads, "warc-heads"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
