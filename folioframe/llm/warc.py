"""Web archives as tables of chunked records (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, mapped, saved, spread_join

#: Bytes of payload in a chunk; payloads of fewer bytes than SHORT are always written as they are.
CHUNK, SHORT = 1 << 20, 1000
DATE = "2026-01-01T00:00:00Z"
END = b"\r\n\r\n"
ARCHIVE = "archive int, record long, chunk int, last boolean, data binary, digest string"
RECORD = "record_id string, page string, record_type string, target string, payload_bytes long, payload_digest string"


def record_id(page: str | None, digest: str) -> str:
    """Names a record by its page and payload; equal rows share it, as they share all else."""
    return f"<urn:record:{quote(page or '', safe='')}:{digest}>"


def header(page: str | None, url: str | None, size: int, digest: str, keeper: str | None) -> bytes:
    """WARC and HTTP headers up to the first byte of the payload; a keeper makes it a revisit, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if keeper is None else "revisit", "WARC-Record-ID": record_id(page, digest), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")  # no space or line end can get into the header
    if page is not None:
        fields["WARC-Page-ID"] = quote(page, safe="")
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if keeper is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(keeper, digest)}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http) + (size if keeper is None else 0))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + http


def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, size, declared, keeper, chunk, last, data) in order to rows of ARCHIVE.

    What is held of a record is one chunk and the digest's state.
    """
    archive, record, sha = TaskContext.get().partitionId(), -1, hashlib.sha1()
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for page, url, size, declared, keeper, chunk, last, data in zip(*(c.to_pylist() for c in b.columns)):
            if chunk == 0:
                record, sha = record + 1, hashlib.sha1()
            sha.update(data)
            if last and keeper is None and sha.hexdigest() != declared:
                raise ValueError(f"chunks of page {page} give {sha.hexdigest()}, its payload {declared}")
            piece = (header(page, url, size, declared, keeper) if chunk == 0 else b"") + data + (END if last else b"")
            for column, value in zip(out, (archive, record, chunk, last, piece, declared if keeper is not None else sha.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()))], names=["archive", "record", "chunk", "last", "data", "digest"])


def keepers(payloads: DataFrame, short: int = SHORT) -> DataFrame:
    """(page, size, digest, check) to (size, digest, check, keeper): payloads of at least `short` bytes that more than one row has, and the largest id of each."""
    same = payloads.where(F.col("size") >= short).groupBy("size", "digest", "check").agg(F.max("page").alias("keeper"), F.count("*").alias("n"))
    return same.where("n > 1 and keeper is not null").drop("n")


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK, short: int = SHORT) -> DataFrame:
    """pages as a written table of ARCHIVE: the data of an archive, by record and chunk, are the bytes of a WARC file.

    A payload is the html in UTF-8, null as an empty one. Of rows with equal payloads of at least `short`
    bytes, those with the largest id are responses, the others revisits that refer to it; a null id is
    smaller than any, and of rows that all have none each is a response. Payloads are the same if length, SHA-1 and a
    second hash agree. Payloads leave the JVM in chunks of `chunk` bytes, each with the digest of all up to
    it. Repeated rows become records of one id. Other columns are not read.
    """
    p = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    p = p.select("page", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("check"))
    # Written, so that its size is known: small, it is broadcast and no payload is shuffled.
    of = saved(keepers(p.select("page", "size", "digest", "check"), short), "keepers")
    named = p.join(of, ["size", "digest", "check"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    named = named.withColumn("keeper", F.when(revisit, F.col("keeper"))).withColumn("payload", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    most = F.greatest(F.lit(0), F.floor((F.octet_length("payload") - 1) / chunk)).cast("int")
    cut = named.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0), "most")))
    cut = cut.select(
        F.col("page").cast("string").alias("page"), "url", "size", "digest", F.col("keeper").cast("string").alias("keeper"), "chunk", (F.col("chunk") == F.col("most")).alias("last"),
        F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"),
    )
    out = saved(mapped(cut, framed, ARCHIVE), "warc")
    dropped(of)
    return out


class Record:
    """Reads one record from its bytes, cut anywhere; holds the headers only."""

    def __init__(self) -> None:
        self.head, self.left, self.size, self.sha, self.fields = bytearray(), -1, 0, hashlib.sha1(), {}

    def feed(self, data: bytes) -> None:
        if self.left < 0:  # headers: of the record, then of the answer
            self.head += data
            first = self.head.find(END)
            second = self.head.find(END, first + 4) if first >= 0 else -1
            if second < 0:
                return
            self.fields = dict(line.split(": ", 1) for line in self.head[:first].decode().split("\r\n")[1:])
            self.left = int(self.fields["Content-Length"]) - (second - first)
            data, self.head = bytes(self.head[second + 4 :]), bytearray()
        body = data[: self.left]
        self.left -= len(body)
        self.size += len(body)
        self.sha.update(body)
        self.head += data[len(body) :]

    def row(self) -> tuple:
        if self.left or self.head != END:
            raise ValueError(f"record {self.fields.get('WARC-Record-ID')} is cut short or too long")
        kind, declared = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and self.sha.hexdigest() != declared:
            raise ValueError(f"record {self.fields['WARC-Record-ID']} has another payload than it says")
        page = self.fields.get("WARC-Page-ID")
        return self.fields["WARC-Record-ID"], page and unquote(page), kind, self.fields.get("WARC-Refers-To"), self.size if kind == "response" else None, declared


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (archive, record, chunk, last, data, digest), a record's together and in order, to rows of RECORD."""
    now, r = None, Record()
    for b in batches:
        rows = []
        for archive, record, chunk, last, data, digest in zip(*(c.to_pylist() for c in b.columns)):
            if chunk == 0:
                now, r = (archive, record, 0), Record()
            if now != (archive, record, chunk):
                raise ValueError(f"chunk {chunk} of record {record} in archive {archive} is out of place")
            r.feed(data)
            if r.fields.get("WARC-Type") == "response" and r.sha.hexdigest() != digest:
                raise ValueError(f"chunk {chunk} of record {record} in archive {archive} is damaged")
            now = (archive, record, chunk + 1)
            if last:
                rows.append(r.row())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64() if i == 4 else pa.string()) for i in range(6)], names=["record_id", "page", "record_type", "target", "payload_bytes", "payload_digest"])


def records(archive: DataFrame) -> DataFrame:
    """The records of an archive table, each read from its bytes; damage anywhere is an error.

    Records of one chunk are read where they lie. Only those of several are brought together, as a
    sorted stream of chunks of which a task holds one batch.
    """
    whole = F.col("last") & (F.col("chunk") == 0)
    columns = ["archive", "record", "chunk", "last", "data", "digest"]
    long = archive.where(~whole).select(columns).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return mapped(archive.where(whole).select(columns), parsed, RECORD).unionByName(mapped(long, parsed, RECORD))


def resolved(found: DataFrame) -> DataFrame:
    """Records with what they stand for: a revisit takes page and size from the response that it refers to."""
    found = saved(found, "records")
    total = found.count()
    wanted = found.where("target is not null").groupBy("target").agg(F.count("*").alias("n"))
    kept = found.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    of = saved(wanted.join(kept, "target").groupBy("target").agg(F.first("n").alias("n"), F.min("refers_to").alias("refers_to"), F.min("bytes").alias("bytes")), "targets")
    revisits = spread_join(found.where("target is not null").drop("payload_bytes"), of, ["target"], "n", total).withColumnRenamed("bytes", "payload_bytes")
    own = found.where("target is null").withColumn("refers_to", F.lit(None).cast("string"))
    return own.unionByName(revisits).drop("target")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    archive = archived(pages)
    out = resolved(records(archive))
    dropped(archive)  # its records are read and written by now
    return out.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
), r AS (
  SELECT *, strlen(payload) >= 1000 AND page_id IS DISTINCT FROM keeper AS again FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to
FROM r
"""
