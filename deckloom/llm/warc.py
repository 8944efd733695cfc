"""Operator 9: WARC archives of pages, and their merged index.

Pages become WARC/1.1 records: the first page of a payload a ``response``, later
ones a ``revisit`` without the payload. Spark's text writer puts them into files,
its line separator being the blank lines that end a record, so files are gzipped
and committed as those of any other table. Spark's text reader gives an archive back
as a stream, of which a task holds one record at a time; reading follows the records'
own lengths. An offset is a place in the unpacked archive.

The index of captures is an external merge sort: each archive's captures, sorted
by URL key and time, are a run on disk; the key space is cut into ranges, and in
each range a loser tree merges the slices of all runs, which come in their order and
are kept as they come, in columns. The ranges in order are the capture histories of
all URLs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

#: Pages in an archive at most, whose captures are sorted in a task's memory.
ARCHIVE_PAGES = 5000
#: Captures in a range of the merge, about.
RANGE_ROWS = 200_000
END = "\r\n\r\n"
#: Digits of base 32 as ``conv`` writes them, and those of RFC 4648.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    hexed = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), CONV_DIGITS, RFC_DIGITS)


def utc(seconds: Column) -> Column:
    """Seconds since 1970 as a time in UTC, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    parts = [F.lpad(F.floor(F.pmod(seconds, F.lit(of)) / per).cast("string"), 2, "0") for of, per in ((86_400, 3600), (3600, 60), (60, 1))]
    return F.concat(day, F.lit("T"), F.concat_ws(":", *parts), F.lit("Z"))


def _header(**fields: Column) -> Column:
    lines = [F.concat(F.lit(f"{k.replace('_', '-')}: "), v) for k, v in fields.items()]
    return F.concat_ws("\r\n", *lines)


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """WARC files of all pages in the folder.

    Of pages with equal payloads of at least ``least_bytes`` that with the smallest
    id is the response. A missing html is an empty payload, a missing URL an empty
    one; pages without an id refer to that with the smallest id or, if there is none,
    are all responses. Rows that repeat an id and payload are each written, alike.
    The capture time is the id in seconds after 2024-01-01. Other columns are not written.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]", "").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )
    # Written before the join, so that both its sides are plain shuffles and Spark can split a very frequent payload.
    first = cut(rows.groupBy("digest", "n").agg(F.min("id").alias("first")))
    rows = rows.join(first, ["digest", "n"])
    again = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END)
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    seconds = F.lit(1_704_067_200) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(10**9))
    head = _header(
        WARC_Type=F.when(again, "revisit").otherwise("response"),
        WARC_Record_ID=urn(F.col("id")),
        WARC_Target_URI=F.col("url"),
        WARC_Date=utc(seconds),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
    )
    profile = F.when(
        again,
        F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            urn(F.col("first")),
        ),
    ).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), head, profile,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))).cast("string"), F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_PAGES).option("compression", "gzip").text(path)


class Records:
    """Offset, headers (names in lower case) and block of each record of an archive that comes in parts."""

    def __init__(self) -> None:
        self.held, self.at, self.wanted = bytearray(), 0, 1

    def add(self, part: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """The records that the next part completes."""
        self.held += part
        while len(self.held) >= self.wanted:
            body = self.held.find(b"\r\n\r\n") + 4
            if not self.held.startswith(b"WARC/1."[: len(self.held)]):
                if self.held == b"\r\n\r\n":
                    return  # what ends an archive may be added to it by who reads it by lines
                raise ValueError(f"no WARC record at byte {self.at}")
            if body < 4:
                self.wanted = len(self.held) + 1
                return
            lines = self.held[: body - 4].decode().split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            end = body + int(head["content-length"])
            if len(self.held) < end + 4:
                self.wanted = end + 4
                return
            if self.held[end : end + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {self.at} has another length than it says")
            block, at = bytes(self.held[body:end]), self.at
            del self.held[: end + 4]
            self.at, self.wanted = self.at + end + 4, 1
            yield at, head, block

    def finish(self) -> None:
        if self.held not in (b"", b"\r\n\r\n"):
            raise ValueError(f"the record at byte {self.at} is not whole")


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of a whole archive."""
    found = Records()
    yield from found.add(data)
    found.finish()


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query, in lower case."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


INDEX = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured_at", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("archive", pa.string()),
        ("archive_offset", pa.int64()),
    ]
)
DDL = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, archive_offset long"
ORDER = ("url_key", "captured_at", "page_id")


def _urn_id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def capture(archive: str, at: int, head: dict[str, str], block: bytes) -> tuple:
    """The index row of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    kind = head["warc-type"]
    if kind == "response":
        if len(payload) != n:
            raise ValueError(f"the payload at byte {at} has another length than it says")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        digest = head["warc-payload-digest"].removeprefix("sha1:")
    page, refers = _urn_id(head["warc-record-id"]), _urn_id(head.get("warc-refers-to"))
    return url_key(head["warc-target-uri"]), head["warc-date"], page, n, digest, kind, refers, archive, at


def sort_key(row: tuple) -> tuple:
    """By URL key, time and id, a missing id first; the place in the archives settles what is left."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)


def write_runs(spark: SparkSession, archives: str, path: str) -> None:
    """The sorted run of every archive, as parquet. An archive is read as lines that end like records do, so never whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found, rows = None, Records(), []

        def sorted_run() -> Iterator[pa.RecordBatch]:
            found.finish()
            if rows:
                yield _batch(sorted(rows, key=sort_key))

        for batch in batches:
            for file, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file != name:
                    yield from sorted_run()
                    name, found, rows = file, Records(), []
                rows += [capture(name.rpartition("/")[2], *r) for r in found.add(part.as_py() + END.encode())]
        yield from sorted_run()

    files = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*").text(archives)
    files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary")).mapInArrow(run, DDL).write.parquet(path)


def loser_tree(runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]) -> Iterator[tuple]:
    """Merges sorted runs. Every inner node holds the run that lost there; the winner's path is replayed."""
    k = len(runs)
    heads = [iter(r) for r in runs]
    rows: list[tuple | None] = [next(h, None) for h in heads]
    keys = [None if r is None else key(r) for r in rows]

    def beats(a: int, b: int) -> bool:
        if keys[b] is None:
            return True
        return keys[a] is not None and keys[a] <= keys[b]

    losers = [0] * max(1, k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        left, right = build(2 * node), build(2 * node + 1)
        winner, loser = (left, right) if beats(left, right) else (right, left)
        losers[node] = loser
        return winner

    winner = build(1) if k > 1 else 0
    while k and rows[winner] is not None:
        yield rows[winner]
        before = keys[winner]
        rows[winner] = next(heads[winner], None)
        keys[winner] = None if rows[winner] is None else key(rows[winner])
        if keys[winner] is not None and keys[winner] < before:
            raise ValueError("a run is not sorted")
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def _rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a slice, some thousand at a time as Python values."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 2000).columns))


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and id: partition after partition, row after row."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column(7).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for a, b in zip(edges, edges[1:]):
                slices.setdefault(names[a], []).append(batch.slice(a, b - a))
        out = []
        for row in loser_tree([_rows(slices[name]) for name in sorted(slices)], sort_key):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // RANGE_ROWS)
    dealt = runs.repartitionByRange(n, *[F.col(c) for c in ORDER])
    # A shuffle brings the slices of the runs in any order, and in blocks; here each comes whole and as it was.
    return dealt.sortWithinPartitions("archive", *ORDER, "archive_offset").mapInArrow(merge, DDL)


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives and index runs under the folder; returns the merged index, a row for each page."""
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/warc", least_bytes)
    write_runs(spark, f"{folder}/warc", f"{folder}/runs")
    return merge_runs(spark.read.schema(DDL).parquet(f"{folder}/runs"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at"
    )


#: Base 32 of a SHA-1 digest: five hex digits at a time are one number below 2^20, which has four digits.
SQL = {
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
d AS (SELECT *, array_to_string(list_transform(range(8), lambda k:
        list_reduce(list_transform([15, 10, 5, 0], lambda sh: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> sh) & 31) + 1, 1)), lambda a, b: a || b)), '') AS digest FROM q),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
       lower(array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')), ',') || ')' ||
             CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END ||
             regexp_extract(url, '[?][^#]+')) AS url_key,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM f
"""
}
