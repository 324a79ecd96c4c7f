"""Operator 3, WARC: a content-addressed archive.

``write_archive`` writes one WARC record per page. Pages are hashed where they lie (SHA-256 and
length identify a payload, SHA-1 is the published digest); a small table of keys, never the
payloads, decides which record of equal payloads is the response that stores the bytes. The others
become revisits without payload. The exact record headers go to a separate table.

Files are gzip WARC, written by Spark's text writer with CRLF ends, a bounded number of records
each. ``read_archive`` parses them by content length and verifies every stored payload against its
published digest; ``reconstruct`` joins revisits to the payloads of their responses. ``rebuild`` goes the
whole way: the payloads read from the files, each once under the SHA-256 of its bytes, are joined to the
table of exact headers, which gives every original record back; a header whose strong digest no stored
payload has fails the job. Sizes and digests of its rows are taken from the stored bytes, never from headers.

A third of all pages may share one payload: its keys are pre-aggregated before the shuffle, and the
joins of headers to owners and payloads carry keys only (sort-merge, split by adaptive execution when
skewed), unless full records are asked for.

Defined results: a null payload counts as empty; records under ``least_bytes`` are always responses;
rows that repeat the largest id of their payload are all responses; a null id is always a response;
line ends and blanks in urls are percent-encoded; an empty table gives an empty archive; extra
columns are ignored. Payloads of any length are kept whole (a task holds one file of records).
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubrisk.llm.common import cut, map_batches, sized_hint
from hubrisk.session import scratch_path

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    least_bytes: int = 1000
    records_per_file: int = 1000
    broadcast_rows: int = 100_000  # revisit keys sent to every task at most; beyond it, a shuffle join


def with_keys(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    return pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"), F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256"))


def revisits(keys: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, sha256, refers_to) of the pages whose payload another page stores."""
    large = keys.filter((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    owners = large.groupBy("sha256", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    return (large.join(owners.filter("n > 1"), ["sha256", "n_bytes"]).filter("page_id < refers_to")
            .select("page_id", "sha256", "refers_to").distinct())


def record_headers(keyed: DataFrame) -> DataFrame:
    """Add ``header``: the exact WARC and HTTP header text of each record (``refers_to`` null: response)."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    is_revisit = F.col("refers_to").isNotNull()
    uri: Column = F.coalesce(F.col("url"), F.lit(""))
    for c, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        uri = F.replace(uri, F.lit(c), F.lit(code))
    block = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return keyed.withColumn("header", F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http))


def write_archive(pages: DataFrame, path: str, params: WarcParams = WarcParams(), page_id: str = "page_id",
                  url: str = "url", payload: str = "html") -> None:
    """Write ``path/records`` (WARC files) and ``path/headers`` (record id and exact header, Parquet)."""
    keyed = with_keys(pages, page_id, url, payload)
    keys = cut(keyed.drop("payload"), "warc-keys")
    again = cut(revisits(keys, params.least_bytes), "warc-revisits")
    links = sized_hint(again, again.count(), params.broadcast_rows)
    record_headers(keys.join(links, ["page_id", "sha256"], "left")).select(
        "page_id", "sha256", "refers_to", "header").write.parquet(f"{path}/headers")
    records = record_headers(keyed.join(links, ["page_id", "sha256"], "left"))
    block = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    (records.select(F.concat("header", block, F.lit(CRLF)).alias("value")).write
     .option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", params.records_per_file)
     .text(f"{path}/records"))


FIELD = re.compile(rb"([A-Za-z-]+):[ ]?(.*)")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC fields, exact header with the HTTP part, payload) of each record of one file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            if m := FIELD.match(line):
                fields[m[1].decode()] = m[2].decode()
        stop = end + int(fields["Content-Length"])
        body = data.index(b"\r\n\r\n", end, stop) + 4
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, data[at:body], data[body:stop]
        at = stop + 4


RECORD = ("page_id long, url string, record_type string, payload_digest string, refers_to long, stored_bytes long, "
          "stored_sha256 string, header binary, payload binary")


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of an archive. The payload of each response is checked against its digest: a mismatch
    fails the job. ``stored_bytes`` and ``stored_sha256`` are those of the stored bytes (null for revisits).
    ``with_payload=False`` leaves header and payload bytes null after that check."""
    def number(s: str | None) -> int | None:
        s = s and s.removeprefix("<urn:page:").removesuffix(">")
        return int(s) if s and s != "null" else None

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        for (files,) in batches:
            for packed in files:
                out: dict[str, list] = {n: [] for n in RECORD_NAMES}
                for f, header, payload in parse(gzip.decompress(packed)):
                    digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} does not have its digest")
                    row = (number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], digest,
                           number(f.get("WARC-Refers-To")), None if revisit else len(payload),
                           None if revisit else hashlib.sha256(payload).hexdigest(), header if with_payload else None, payload if with_payload and not revisit else None)
                    for n, v in zip(RECORD_NAMES, row):
                        out[n].append(v)
                yield out
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("content")
    return map_batches(files, run, RECORD)


RECORD_NAMES = tuple(x.split()[0] for x in RECORD.split(", "))


def reconstruct(records: DataFrame) -> DataFrame:
    """Every record with the full payload (or its size) that its response stores. Payload rows are
    taken once per response record; revisits find theirs by record id and digest."""
    stored = (records.filter("record_type = 'response'")
              .select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("stored_bytes").alias("_bytes"),
                      F.col("payload").alias("_payload")).dropDuplicates(["refers_to", "payload_digest"]))
    responses = records.filter("record_type = 'response'").withColumn("payload_bytes", F.col("stored_bytes"))
    revisit = (records.filter("record_type = 'revisit'").join(stored, ["refers_to", "payload_digest"], "left")
               .withColumns({"payload": F.col("_payload"), "payload_bytes": F.col("_bytes")}))
    return responses.unionByName(revisit.select(responses.columns))


def rebuild(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every original record: the table of exact headers joined by strong digest to the payloads read back from
    the files. ``record`` is header and payload; ``payload_bytes`` and ``payload_digest`` are those of the stored
    bytes. ``with_payload=False`` moves digests and sizes only (``record`` is null)."""
    read = read_archive(spark, path, with_payload).filter("record_type = 'response'")
    stored = (read.select(F.col("stored_sha256").alias("sha256"), F.col("stored_bytes").alias("payload_bytes"),
                          "payload_digest", "payload")
              .groupBy("sha256").agg(*[F.first(c).alias(c) for c in ("payload_bytes", "payload_digest", "payload")]))
    if not with_payload:
        stored = cut(stored.drop("payload"), "warc-stored").withColumn("payload", F.lit(None).cast("binary"))
    missing = F.raise_error(F.concat(F.lit("no stored payload has the digest "), F.col("sha256"))).cast("long")
    return (spark.read.parquet(f"{path}/headers").join(stored, "sha256", "left")
            .select("page_id", F.coalesce("payload_bytes", missing).alias("payload_bytes"), "payload_digest",
                    F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to",
                    F.concat(F.col("header").cast("binary"), "payload").alias("record")))


def round_trip(pages: DataFrame, params: WarcParams = WarcParams(), page_id: str = "page_id", url: str = "url",
               payload: str = "html") -> DataFrame:
    """Write the archive in the shared folder, read it back: one row per page with the size and digest of the
    payload that its rebuilt record has."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, params, page_id, url, payload)
    return rebuild(pages.sparkSession, path, with_payload=False).drop("record")


def oracle_sql(least_bytes: int = 1000) -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {least_bytes} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {least_bytes} AND page_id < top THEN top END::BIGINT AS refers_to
FROM k"""
