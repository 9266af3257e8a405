"""WARC archives with a two-level index: write pages, index the captures, look them up, read them back.

Archives are files of gzip members, one per record, so a record can be read by its range alone. The index is
sorted by reversed-host key, cut into compressed blocks, with a directory of each block's first key beside
each part; the parts' first and last keys are the top level. A lookup finds the part by binary search in the
top level, the block by binary search in the part's directory, and reads that block's range only.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.session import shuffle_partitions, stage

LEAST_REVISIT_BYTES = 100
LINES_PER_BLOCK = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then the path and the query: ``com,example)/a?b``. Null: empty."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return text.lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path there: local, HDFS, S3 or any other that Arrow knows."""
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page ``refers_to`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; the captures (key, file, offset, length).

    Of rows with equal payloads of at least 100 bytes, that with the smallest page_id is the response and the others
    revisit it; a null html is an empty payload, and rows without an id are responses. A file per task; a task that
    runs again writes another file, and only the files of the captures count. Other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long_ones = rows.filter((F.octet_length("payload") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = long_ones.groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stage(first.filter("n > 1").drop("n"), "repeated-payloads")
    marked = rows.join(first, rows["digest"] == first["same"], "left")
    marked = marked.withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("same", "first")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for part in parts:
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            made = []
            for r in part.to_pylist():
                record = make_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)
                member = gzip.compress(record, 6, mtime=0)
                out.write(member)
                made.append({"key": url_key(r["url"]), "file": name, "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(made, _schema(CAPTURE))
        if out:
            out.close()

    return stage(marked.mapInArrow(batches, CAPTURE), "captures")


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


@dataclass(frozen=True)
class Index:
    """A written index: where it is, and each part's first and last key. As many parts as were asked for."""

    archives: str
    folder: str
    parts: tuple[tuple[str, str, int], ...]  # (first key, last key, part), in order


def build_index(captures: DataFrame, archives: str, folder: str, lines_per_block: int = LINES_PER_BLOCK) -> Index:
    """Sort the captures and write the parts of the index. Many captures of one key may run over several parts."""
    spark = captures.sparkSession
    order = ["key", "file", "offset"]
    parts = captures.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    schema = "first string, last string, part bigint"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        # Unlike a partition's number, an attempt's is not used twice.
        part, at, directory, block, last = context.taskAttemptId(), 0, [], [], ""
        out = None

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress(json.dumps(block).encode(), 6)
            out.write(data)
            directory.append((block[0][0], at, len(data)))
            at, last_key = at + len(data), block[-1][0]
            block = []
            return last_key

        for some in rows:
            for row in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                out = out or store.open_output_stream(f"{path}/{part}.blocks", compression=None)
                block.append(row)
                if len(block) == lines_per_block:
                    last = flush()
        if block:
            last = flush()
        if out:
            out.close()
            with store.open_output_stream(f"{path}/{part}.directory", compression=None) as file:
                file.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "last": last, "part": part}], _schema(schema))

    written = stage(parts.mapInArrow(batches, schema), "index-parts")
    tops = sorted((r["first"], r["last"], r["part"]) for r in written.collect())
    return Index(archives, folder, tuple(tops))


class BlockReader:
    """Looks keys up in one part: its directory is read once, and of its blocks only those asked for."""

    def __init__(self, store: fs.FileSystem, path: str, part: int) -> None:
        with store.open_input_file(f"{path}/{part}.directory") as file:
            self.directory = json.loads(file.read())
        self.firsts = [x[0] for x in self.directory]
        self.file = store.open_input_file(f"{path}/{part}.blocks")
        self.held: tuple[int, list, list] = (-1, [], [])

    def block(self, i: int) -> tuple[list, list]:
        if self.held[0] != i:
            _, at, size = self.directory[i]
            self.file.seek(at)
            lines = json.loads(zlib.decompress(self.file.read(size)))
            self.held = (i, lines, [x[0] for x in lines])
        return self.held[1], self.held[2]

    def find(self, key: str) -> Iterator[list]:
        """All lines of a key; they may run over several blocks."""
        i = max(bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines, keys = self.block(i)
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]
            i += 1


def look_up(urls: DataFrame, index: Index, url_col: str = "url") -> DataFrame:
    """The captures (key, file, offset, length) of the distinct keys of some URLs. Keys without one give no row."""
    spark = urls.sparkSession
    firsts, tops = [p[0] for p in index.parts], index.parts
    most = max((p[1] for p in tops), default="")

    def locate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            found = []
            for key in {url_key(u) for u in some.column(0).to_pylist()}:
                i = bisect_right(firsts, key) - 1
                while 0 <= i and tops[i][1] >= key <= most:  # parts before hold the key only up to their last key
                    found.append({"key": key, "part": tops[i][2]})
                    i -= 1
            yield pa.RecordBatch.from_pylist(found, _schema("key string, part bigint"))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(index.folder)
        reader, of = None, None
        for some in rows:
            found = []
            for key, part in zip(some.column("key").to_pylist(), some.column("part").to_pylist(), strict=True):
                if part != of:
                    reader, of = BlockReader(store, path, part), part
                found += reader.find(key)
            columns = [[x[i] for x in found] for i in range(4)]
            schema = _schema(CAPTURE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    keys = urls.select(F.col(f"`{url_col}`").cast("string")).mapInArrow(locate, "key string, part bigint").distinct()
    # Ranges, not hashes: a task's keys are neighbours in few parts, and a part's many keys may go to several tasks.
    keys = keys.repartitionByRange(shuffle_partitions(spark), "part", "key").sortWithinPartitions("part", "key")
    return keys.mapInArrow(read, CAPTURE)


RECORD = "page_id bigint, url string, record_type string, payload binary, payload_digest string, refers_to bigint"


def read_records(captures: DataFrame, archives: str) -> DataFrame:
    """The records at some captures, each read by its range; a revisit has a null payload and the digest it refers to."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(archives)
        file, of = None, None
        for some in rows:
            for at in range(0, some.num_rows, 256):
                made = []
                for r in some.slice(at, 256).to_pylist():
                    if r["file"] != of:
                        file, of = store.open_input_file(f"{path}/{r['file']}"), r["file"]
                    file.seek(r["offset"])
                    head, payload = parse_record(gzip.decompress(file.read(r["length"])))
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                    made.append(
                        {
                            "page_id": None if page is None else int(page),
                            "url": head["WARC-Target-URI"],
                            "record_type": head["WARC-Type"],
                            "payload": payload if refers is None else None,
                            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
                            "refers_to": None if refers is None else int(refers),
                        }
                    )
                yield pa.RecordBatch.from_pylist(made, _schema(RECORD))

    order = ["file", "offset"]
    near = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), *order).sortWithinPartitions(*order)
    return near.mapInArrow(batches, RECORD)


def payload_sizes(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit has its response's size and digest.

    The digest of a response is taken from the payload that was read, not from its header. A page id may have several
    records with different payloads: a revisit belongs to that response of the id it refers to whose payload has the
    digest in the revisit's header. One without such a response has null size and digest.
    """
    read = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    own = records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        read.alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    own = stage(own, "records")
    responses, revisits = (own.filter(F.col("record_type") == kind) for kind in ("response", "revisit"))
    # Equal digests are equal payloads, so any response of the id and digest has the size.
    of = responses.groupBy(F.col("page_id").alias("response"), F.col("payload_digest").alias("digest"))
    of = of.agg(F.max("payload_bytes").alias("bytes"))
    same = (F.col("refers_to") == F.col("response")) & (F.col("payload_digest") == F.col("digest"))
    found = revisits.join(of, same, "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return responses.unionAll(found)
