"""WARC archives with an externally merged capture index.

Records are built by DataFrame functions and written by Spark's text writer with the record separator as line
separator, so each part file is a WARC file, in any store that Spark writes to. Pages are written by classes of size, each
with as many records in a file as FILE_BYTES hold, so that reading, which takes whole files, is bounded by bytes: only a
record of more bytes than that is alone in a larger file. Each file gives a locally sorted run of index rows; the key range is then cut into parts, and
in each part a loser tree merges the k runs by URL key and timestamp, so that the parts in order are the global capture
history. A part holds about ROWS_PER_PART short index rows, however large the archive.

Of records with equal payloads (SHA-1 and length) of at least min_bytes, the one with the smallest page_id is a
response and the others revisit it, without the payload.

Defined cases: null html is an empty payload, null url an empty target; rows that repeat the id of the response are
responses too; a row without an id revisits an equal one with an id, and without such a one is a response; control
characters in urls are percent-encoded; `captured` is the name of a timestamp column, and without one captures are a
second apart in id order from CAPTURE_START; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import map_arrow, shared_dir, staged, whole_id

ROWS_PER_PART = 200_000
#: Bytes of payloads in a file at most, and the bounds of the classes of payloads that share files.
FILE_BYTES, CLASSES = 32 << 20, (16 << 10, 256 << 10, 4 << 20)
#: So many rows of three short values, about 20 MB, are sent to every executor at most.
REVISITS_BROADCAST = 200_000
CAPTURE_START = "2024-01-01 00:00:00"
END = "\r\n\r\n"
#: Fixed value: the profile of identical payloads in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, size bigint"
COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def base32(digest_hex: Column) -> Column:
    """Base 32 of forty hex digits: ten are forty bits, which conv writes as eight digits of base 32."""
    tens = [F.lpad(F.conv(F.substring(digest_hex, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*tens), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(digest: Column, page_id: Column) -> Column:
    h = F.sha1(F.concat(digest, F.lit("/"), F.coalesce(page_id.cast("string"), F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """A column `value`: a WARC record for each row, without its last two line ends; and `n_bytes` of its payload."""
    page_id, html = whole_id("page_id").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code != 32 else F.replace(url, F.lit(" "), F.lit("%20"))
    start = F.timestamp_add("SECOND", F.coalesce(whole_id("page_id"), F.lit(0)), F.lit(CAPTURE_START).cast("timestamp_ntz"))
    when = F.date_format(F.col(captured) if captured else start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(page_id, url.alias("url"), html, when.alias("when"))
    digest, size = F.sha1("html"), F.octet_length("html")
    keys = rows.select("page_id", digest.alias("hex"), size.cast("long").alias("n_bytes")).where(F.col("n_bytes") >= min_bytes)
    # A row for each payload that several rows share, then one for each row but the first: pages themselves don't move.
    shared = keys.groupBy("hex", "n_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = keys.join(shared, ["hex", "n_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = staged(again.select("hex", F.coalesce("page_id", F.lit(-(1 << 63))).alias("_id"), "refers_to").distinct(), "revisits")
    if again.count() <= REVISITS_BROADCAST:  # else a join by payload, in which pages move once
        again = F.broadcast(again)
    rows = rows.withColumns({"hex": digest, "n_bytes": size, "_id": F.coalesce("page_id", F.lit(-(1 << 63)))}).join(again, ["hex", "_id"], "left")
    revisit = F.col("refers_to").isNotNull()
    bare = base32(F.col("hex"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit(END))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(bare, F.col("page_id"))),
        line("WARC-Date", F.col("when")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), bare)),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(bare, F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return rows.select(F.concat(head, line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body).alias("value"), F.col("n_bytes").cast("long").alias("n_bytes"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, captured: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Archives of at most file_bytes of payloads each, but for single records that have more."""
    rows = records(pages, min_bytes, captured)
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    bounds = [b for b in CLASSES if b < file_bytes]
    classes = [*zip([-1, *bounds], [*bounds, 1 << 62], strict=True)]
    found = pages.agg(*(F.count(F.when((size > low) & (size <= high), 1)) for low, high in classes)).first()
    mode = "error"
    for n, (low, high) in zip(found, classes, strict=True):
        if n or (mode == "error" and high == 1 << 62):
            part = rows.where((F.col("n_bytes") > low) & (F.col("n_bytes") <= high)).select("value")
            part.write.mode(mode).option("lineSep", END).option("maxRecordsPerFile", max(1, file_bytes // high)).text(path)
            mode = "append"


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, size, header fields and block of each record."""
    at = 0
    while at < len(content):
        top = content.index(END.encode(), at)
        lines = content[at:top].decode().split("\r\n")
        if lines[0] not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = top + 4
        end = start + int(fields["content-length"])
        if content[end : end + 4] != END.encode():
            raise ValueError(f"the WARC record at byte {at} has another length than it says")
        yield at, end + 4 - at, fields, content[start:end]
        at = end + 4


def url_key(url: str) -> str:
    """Sortable form: labels of the host from the last, then path and query."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, tail = rest.partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + tail


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of each file, sorted: a run."""
    schema = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64()}[k]) for c, k in (x.split() for x in INDEX.split(", "))])
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for at, size, fields, block in parse(content):
                http, _, payload = block.partition(END.encode())
                length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != length or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{file}: the payload at byte {at} doesn't fit its digest")
                page = fields.get("x-page-id")
                refers = fields.get("x-refers-to-page")
                rows.append((url_key(fields["warc-target-uri"]), fields["warc-date"], None if page is None else int(page), length, digest, kind, None if refers is None else int(refers), file, at, size))
            rows.sort(key=order)
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5000], strict=True), schema, strict=True)], schema=schema)


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next row costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else order(h) for h in self.heads]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and x <= y)

    def _play(self, i: int) -> None:
        """Run i climbs; a node without a loser yet keeps it and ends the climb (while the tree is built)."""
        at = (i + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = i
                return
            if self._beats(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else order(self.heads[w])
            self._play(w)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part of the key range: its pieces of runs, which arrive each in order, merged."""
    held, schema = [], None
    for batch in batches:
        held.append(batch)
    if not held:
        return
    schema = held[0].schema
    some = pa.Table.from_batches(held).combine_chunks()
    files = some.column("file").to_pylist()
    cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]

    def run(a: int, b: int) -> Iterator[tuple]:
        for i in range(a, b, 2000):
            yield from zip(*(c.to_pylist() for c in some.slice(i, min(2000, b - i)).columns), strict=True)

    tree = iter(LoserTree([run(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]))
    while rows := [r for _, r in zip(range(5000), tree)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of the archives in a folder, globally ordered by URL key, timestamp and id."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = staged(map_arrow(files, _runs, INDEX), "runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // ROWS_PER_PART))
    keys = ["url_key", "captured", "page_id"]
    ranged = runs.repartitionByRange(parts, *keys).sortWithinPartitions("file", *keys, "offset")  # brings pieces of runs together
    return map_arrow(ranged, _merged, INDEX)


def archive(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as WARC files, read them back and return the index."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write(pages, path, min_bytes)
    return read_index(spark, path)
