"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading: the bytes `WARC/1.0` can stand in any payload, so a task that finds them emits only a candidate: where it starts,
and where its header says that the next record starts. Pointer jumping from the start of each file keeps the candidates
that the chain of successors reaches; a magic inside a payload is on no chain.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
MAGIC = b"WARC/1.0\r\n"
REVISIT_FROM = 1000
FILE_RECORDS = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_digest and refers_to: of the pages with one payload of at least
    least bytes, the one with the largest page_id is the response (refers_to null) and the others revisit it.

    A null html is an empty payload. Rows that repeat the largest page_id are all responses. A null page_id is smaller than
    any; pages that share a payload and all lack a page_id are responses. Further columns are ignored.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= least
    firsts = p.filter(large).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = firsts.select(F.col("payload_digest").alias("d"), "first")
    joined = p.join(firsts, (p["payload_digest"] == firsts["d"]) & large, "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("d", "first")


def record_text(marked: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column, value: the WARC record of each row up to the line ends that follow it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit("WARC/1.0" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.when(F.col("page_id").isNotNull(), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html" + CRLF),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
    )
    return marked.select(F.concat(header, body).alias("value"))


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_FROM) -> None:
    """Archives (gzip) at path with a record for each page, FILE_RECORDS to a file at most; an empty table: no records."""
    text = record_text(mark_revisits(pages, least))
    text.write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADER = re.compile(rb"WARC/1\.0\r\n((?:[^\r\n]+\r\n)*)\r\n")


def candidates(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, successor's offset, headers, payload) of everything in data that could be a record."""
    at = data.find(MAGIC)
    while at >= 0:
        m = _HEADER.match(data, at)
        if m:
            head = dict(x.split(": ", 1) for x in m[1].decode(errors="replace").split(CRLF) if ": " in x)
            size = head.get("Content-Length", "")
            if size.isdigit() and m.end() + int(size) + 4 <= len(data) and data[m.end() + int(size) : m.end() + int(size) + 4] == b"\r\n\r\n":
                end = m.end() + int(size)
                yield at, end + 4, head, data[m.end() : end]
        at = data.find(MAGIC, at + 1)


CANDIDATE = "path string, at long, next long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, named_digest string, file_bytes long"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("named_digest", pa.string()), ("file_bytes", pa.int64())])


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data = content.as_buffer().to_pybytes()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            rows = [
                (path.as_py(), at, after, h.get("WARC-Type"), _page(h.get("WARC-Record-ID")), _page(h.get("WARC-Refers-To")), len(body), hashlib.sha1(body).hexdigest(), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), len(data))
                for at, after, h, body in candidates(data)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows else pa.RecordBatch.from_pylist([], schema=_ARROW)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the candidates the chain from offset 0 reaches, by pointer jumping; at is ascending."""
    n = len(at)
    jump = np.searchsorted(at, after)
    jump = np.where((jump < n) & (np.append(at, -1)[np.minimum(jump, n)] == after), jump, n)
    jump = np.append(jump, n)
    reach = np.zeros(n + 1, bool)
    reach[0] = n > 0 and at[0] == 0
    for _ in range(max(1, n).bit_length()):
        reach[jump[reach]] = True  # what was reached reaches what lies twice as far each round
        jump = jump[jump]
    return reach[:n]


def _chain(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    return table.filter(pa.array(reachable(table["at"].to_numpy(), table["next"].to_numpy())))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives at path, by their verified chains: CANDIDATE's columns. Payloads stay in the tasks.

    A group is one file's candidates without payloads, so its size is bounded by the file's. A chain that breaks before the end
    of its file ends there: later records of a damaged file are not guessed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_emit, CANDIDATE).groupBy("path").applyInArrow(_chain, CANDIDATE)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the full payload's size and digest: a revisit takes them from the response that it refers to."""
    r = records.filter("record_type IN ('response', 'revisit')").select("record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "named_digest")
    full = r.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("target"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).dropDuplicates(["target", "full_digest"])
    revisits, responses = r.filter("record_type = 'revisit'"), r.filter("record_type = 'response'")
    joined = revisits.join(full, (revisits["refers_to"] == full["target"]) & (revisits["named_digest"] == full["full_digest"]))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    joined = joined.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.select(columns).unionByName(joined.select(columns))


