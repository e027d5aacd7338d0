"""WARC archives of web pages, with a merged external index of captures.

Each task writes its pages as gzip'd WARC records into files of bounded size in the shared folder and
returns its captures as a run sorted by URL key and time. The runs are merged in two steps: captures
are range-partitioned by (URL key, time, id), then each task merges the pieces of the runs that reach
it with a loser tree, so that its output, and with it the whole index in order of the ranges, is in
order: the capture history of every URL. The archives are read back file by file along the index.

Of records with equal payloads of at least `min_bytes` the one with the smallest page_id is a
response; the others are revisit records that name it and hold no payload, but its digest and length.
A file of a lost or repeated attempt is not in the index and never read.

Reading back checks each response's payload against the digest of its record; a difference is an error.
captured_at is the pages' own time where they have such a column, else a fixed day plus page_id seconds.

Edge cases: null html is an empty payload; a null captured_at counts as one that is not there; a null url is written as an empty target with key ''; a
null page_id stays null and is never the one referred to; repeated rows are captures of their own
(equal ids: both responses).
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetide.llm.common import new_path, saved

MIN_BYTES = 100
FILE_BYTES = 16 << 20
#: Captures that a range of the merge holds, and bytes of archives that a task reads back.
RANGE_ROWS, READ_BYTES = 100_000, 16 << 20
CRLF = b"\r\n"
INDEX = "url_key string, captured_at string, page_id long, run string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels reversed, then the path: com,example,blog)/en/1?q — scheme, port, user, www and fragment do not count."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(lower, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www[0-9]*\.", "")
    path = F.regexp_extract(lower, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(host == "", F.regexp_extract(lower, r"^[^#]*", 0)).otherwise(key)


def with_record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, captured_at (as WARC-Date), payload, payload_digest, record_type, refers_to."""
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    if "captured_at" in pages.columns:
        stamp = F.coalesce(F.col("captured_at").try_cast("timestamp"), stamp)
    when = F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), when, F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = same.where("n > 1").select(F.col("payload_digest").alias("_d"), "first")
    joined = rows.join(same, rows["payload_digest"] == same["_d"], "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "captured_at", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _file_system(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def record_bytes(page_id, url: str | None, when: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {when}", "WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return CRLF.join(x.encode() for x in head) + CRLF * 2 + block + CRLF * 2


def parse_record(data: bytes) -> dict:
    """Header fields (lower case), the payload's own length and, for a response, the payload."""
    head, _, rest = data.partition(CRLF * 2)
    version, *lines = head.split(CRLF)
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(CRLF * 2)
    return fields | {"payload": payload, "http-length": int(re.search(rb"Content-Length: (\d+)", http)[1])}


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records (see with_record_types, and url_key) and return their INDEX rows, a sorted run per task."""

    def run(batches):
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        run_id, out, sink, name, at, number = uuid.uuid4().hex, [], None, None, 0, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                page_id = None if pd.isna(r.page_id) else int(r.page_id)
                refers_to = None if pd.isna(r.refers_to) else int(r.refers_to)
                if sink is None or at >= file_bytes:
                    if sink:
                        sink.close()
                    name, at, number = f"{run_id}-{number:05d}.warc.gz", 0, number + 1
                    sink = system.open_output_stream(f"{path}/{name}", compression=None)
                data = gzip.compress(record_bytes(page_id, r.url, r.captured_at, bytes(r.payload), r.payload_digest, r.record_type, refers_to), 6, mtime=0)
                sink.write(data)
                out.append((r.url_key, r.captured_at, page_id, run_id, name, at, len(data)))
                at += len(data)
        if sink:
            sink.close()
        out.sort(key=_order)
        columns = [x.split()[0] for x in INDEX.split(", ")]
        for i in range(0, len(out), 10_000):
            yield pd.DataFrame(out[i : i + 10_000], columns=columns).astype({"page_id": "Int64"})

    return records.mapInPandas(run, INDEX)


def _order(row: tuple):
    """(URL key, time, id) with missing ids first."""
    return row[0].encode(), row[1], -(2**63) - 1 if row[2] is None or row[2] != row[2] else int(row[2])


class LoserTree:
    """k-way merge of sorted lists: each inner node holds the loser of the match played there."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.heads[a][0], a) <= (self.heads[b][0], b)

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """INDEX rows in global order: ascending over the partitions and inside each, with `part` and `place`.

    Ranges are made for their number of rows, whatever the size of the index; no two captures are equal in
    what they are ranged by, so that the captures of one URL are split too."""
    partitions = max(1, math.ceil(index.count() / range_rows))
    ranged = index.repartitionByRange(partitions, "url_key", "captured_at", "page_id", "run", "file", "offset").withColumn("part", F.spark_partition_id())

    def merge(batches):
        runs: dict[str, list] = {}
        part, columns = 0, None
        for pdf in batches:
            columns = [c for c in pdf.columns if c != "part"]
            part = int(pdf["part"].iloc[0])
            for row in pdf[columns].itertuples(index=False, name=None):
                runs.setdefault(row[3], []).append((_order(row), row))
        out = [(*row, part, i) for i, (_, row) in enumerate(LoserTree([runs[r] for r in sorted(runs)]))]
        for i in range(0, len(out), 10_000):
            yield pd.DataFrame(out[i : i + 10_000], columns=[*columns, "part", "place"]).astype({"page_id": "Int64"})

    return ranged.sortWithinPartitions("run", "url_key", "captured_at", F.col("page_id").asc_nulls_first()).mapInPandas(merge, INDEX + ", part int, place long")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index, read along each file: page_id, url, record_type, payload_digest, payload_bytes, refers_to, html.

    Tasks read READ_BYTES each, or less where that would leave cores without work; large files are shared."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(size / READ_BYTES), min(index.sparkSession.sparkContext.defaultParallelism * 2, math.ceil(size / (256 << 10))))

    def run(batches):
        system, path = _file_system(folder)
        name, source = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.file != name:
                    if source:
                        source.close()
                    name, source = r.file, system.open_input_file(f"{path}/{r.file}")
                f = parse_record(gzip.decompress(source.read_at(r.length, r.offset)))
                number = lambda k: None if f.get(k, "<urn:page:None>") == "<urn:page:None>" else int(f[k][10:-1])  # noqa: B023,E731
                html, digest = None, f["warc-payload-digest"].removeprefix("sha256:")
                if f["warc-type"] == "response":
                    html, found = f["payload"].decode(), hashlib.sha256(f["payload"]).hexdigest()
                    if found != digest or len(f["payload"]) != f["http-length"]:
                        raise ValueError(f"{r.file} at {r.offset}: the payload is not the one of the record's digest and length")
                out.append((number("warc-record-id"), f["warc-target-uri"], f["warc-type"], digest, f["http-length"], number("warc-refers-to"), html))
            made = pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"
    return index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(run, schema)


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame, str]:
    """Write the archives of pages; returns (merged index, written table; records read back; folder)."""
    folder = new_path(pages.sparkSession, "warc")
    records = with_record_types(pages, min_bytes).withColumn("url_key", url_key(F.col("url")))
    index = saved(write_archives(records, folder, file_bytes), "runs")
    merged = saved(merge_index(index, range_rows), "index")
    return merged, read_archives(merged, folder), folder
