"""10. WARC archives with revisit resolution.

Payload digests are computed where the pages are; headers (id, digest, url) are reduced
by digest to find each digest's response, the least id. Pages meet the responses of
payloads that occur more than once: their table is broadcast where Spark finds it small,
else the pages are exchanged by digest with their payloads, by a join that Spark can
split. Pages are then written as WARC 1.1 records, one gzip
member each, with fresh headers: a revisit has no payload but names its response
(WARC-Refers-To, -Target-URI). Tasks write files under unique names and report
them; only the files of the reported (successful) attempt are read back, so a lost
executor leaves at most an unread file.

Defined results: null html is an empty payload; payloads under ``SMALL`` bytes are
always responses; rows with the same id and payload as the response are responses
too (repeated rows); rows with a null id are written, sort after all others and,
where the only copies of a payload, are responses; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import materialize, partitions, shared_dir
from farpairs.llm.files import read_range, write_bytes
from farpairs.tables import table

#: Payloads below so many bytes are never revisits.
SMALL = 100
#: Bytes of compressed records after which a new archive begins.
ROLL = 32_000_000
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


def resolved(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with digest, length and, for revisits, the response's id and url.

    Hot digests are reduced before the exchange of headers, and the join back is one that
    Spark can split.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("length"),
        F.sha2(payload, 256).alias("digest"),
    )
    head = rows.where(f"length >= {SMALL}").groupBy("digest").agg(F.min("id").alias("first_id"), F.min_by("url", F.struct("id", "url")).alias("first_url"), F.count("*").alias("copies"))
    head = head.where("copies > 1 and first_id is not null").drop("copies")
    joined = rows.join(head, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "payload", "length", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))


def _record(i: int | None, url: str | None, payload: bytes, length: int, digest: str, refers: int | None, refers_url: str | None) -> bytes:
    clean = lambda s: (s or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(i, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Identified-Row: {'' if i is None else i}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"WARC-Truncated-Payload-Length: {length}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def write_archives(pages: DataFrame, path: str, **names: str) -> DataFrame:
    """Write the pages below ``path`` as .warc.gz files; returns (file, records, bytes), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []

        def file() -> pa.RecordBatch:
            name = f"{path}/{uuid.uuid4().hex}.warc.gz"
            write_bytes(name, parts)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)], pa.int64()), pa.array([sum(map(len, parts))], pa.int64())], ["file", "records", "bytes"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "length", "digest", "refers_to", "refers_url"))):
                parts.append(_record(*(x.as_py() for x in row)))
                size += len(parts[-1])
                if size >= ROLL:
                    yield file()
                    parts, size = [], 0
        if parts:
            yield file()

    return materialize(resolved(pages, **names).mapInArrow(run, "file string, records long, bytes long"))


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "surrogatepass").partition(": ")
            head[k.rstrip(":")] = v
        yield head, f.read(int(head["Content-Length"]))


def read_archives(files: DataFrame) -> DataFrame:
    """(record_id, id, url, record_type, payload, payload_bytes, payload_digest, refers_record).

    One row per record of the archives that ``files`` (file) lists. The digest and
    length of a response are computed from its payload; those of a revisit are its
    headers', and its payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_record", pa.string())])
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0):
                for head, block in _records(read_range(name.as_py())):
                    kind, row = head["WARC-Type"], head["WARC-Identified-Row"]
                    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    said = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = said if body is None else hashlib.sha256(body).hexdigest()
                    if digest != said:
                        raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} does not have its digest")
                    n = int(head["WARC-Truncated-Payload-Length"]) if body is None else len(body)
                    rows.append((head["WARC-Record-ID"], int(row) if row else None, head["WARC-Target-URI"], kind, body, n, digest, head.get("WARC-Refers-To")))
                    size += n
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # a stated number of tasks: the rows are only names, and would else meet in one
    listed = files.select("file").repartition(partitions(files.sparkSession), "file")
    return listed.mapInArrow(run, "record_id string, id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_record string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark))
    heads = materialize(read_archives(files).drop("payload", "url"))
    # a revisit's record id names its response's record; only headers of responses that are named meet here
    named = heads.where("refers_record is not null").select(F.col("refers_record").alias("record_id")).distinct()
    responses = heads.where("record_type = 'response'").select("record_id", "id").join(named, "record_id", "left_semi")
    found = responses.groupBy("record_id").agg(F.min("id").alias("refers_to")).withColumnRenamed("record_id", "refers_record")
    return heads.join(found, "refers_record", "left").select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
f as (select h, min(page_id) as first_id from d where n >= {SMALL} group by h)
select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
  case when f.first_id is not null and page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from f.first_id then f.first_id end as refers_to
from d left join f using (h)
"""
