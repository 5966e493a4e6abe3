"""WARC archives with a two-level capture index.

Each task writes its pages into an archive of its own, one compressed member per record, and returns where each
record lies. These captures are sorted by reversed-host URL key over all tasks; each range becomes an index
file of compressed blocks of lines, with a sparse directory of the blocks' first keys at its end. A lookup
binary-searches the files' first keys, then the directory, then the block, and the record is fetched by a
range read. Bulk reads sort the places first and read neighbours together.

Files go to the folder all executors share, under names with the task attempt in them, so a task that runs
again disturbs nothing: only files of attempts whose rows arrived are ever referred to.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm.shared import NO_ID, shared_folder, small, stored

LEAST_BYTES = 100
BLOCK_LINES = 2000
FILE_LINES = 2_000_000
GAP = 64 * 1024
READ = 4 * 1024 * 1024
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query, without white space; ``-`` for no URL."""
    text = re.sub(r"\s", "%20", (url or "").strip())
    if not text:
        return "-"
    try:
        parts = urlsplit(text if "://" in text else f"http://{text}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"-{text}"
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (
        f"?{parts.query}" if parts.query else "")


def open_folder(folder: str):
    """The file system of a shared folder, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One record as a compressed member of its own; a revisit has the headers of its page but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Page-ID: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one compressed record; checks length and digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
    return {"headers": headers, "payload": payload, "size": size, "digest": digest}


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``key_id``, ``digest``, ``refers_to`` of the pages whose payload another page with a smaller id has; stored."""
    pages = stored(pages.select("key_id", "digest", "n_bytes").filter(F.col("n_bytes") >= least_bytes))
    first = stored(pages.groupBy("digest").agg(F.min(F.when(F.col("key_id") != NO_ID, F.col("key_id"))).alias("refers_to"),
                                               F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n"))
    return stored(pages.join(first, "digest").filter(F.col("key_id") != F.col("refers_to"))
                  .select("key_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
                   least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record per page and return the captures: ``key``, ``file``, ``offset``, ``length``; stored.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the smallest id is a response and the others
    revisit it. Null html is an empty payload. Rows of one id and payload are alike: all responses, or all
    revisits. A page without id is a response unless a page with one has its payload. An empty table writes
    nothing.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("page"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("key_id"),
                        F.col(url_column).alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload"))
    rows = rows.join(small(revisits(rows, least_bytes)), ["key_id", "digest"], "left").select("page", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, path = open_folder(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            places = []
            for page, url, body, digest, refers in batch.itertuples(index=False):
                if out is None:
                    system.create_dir(path)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                page = None if pd.isna(page) else int(page)
                record = warc_record(page, url, body, digest, None if pd.isna(refers) else int(refers), not pd.isna(refers))
                out.write(record)
                places.append((f"{url_key(url)} {page}", name, at, len(record)))
                at += len(record)
            yield pd.DataFrame(places, columns=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(rows.mapInPandas(write, "key string, file string, offset long, length long")).withColumn("folder", F.lit(folder))


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index of captures; one row per index file: ``index``, ``first_key``, ``lines``; stored."""
    spark = captures.sparkSession
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    files = max(1, -(-captures.count() // FILE_LINES))
    rows = captures.select("key", F.concat_ws("/", "folder", "file").alias("file"), "offset", "length")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, path = open_folder(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.idx"
        out, at, lines, directory, waiting = None, 0, 0, [], []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                system.create_dir(path)
                out = system.open_output_stream(name, compression=None)
            block = zlib.compress("\n".join(waiting).encode("utf-8", "surrogatepass"))
            directory.append((waiting[0], at, len(block)))
            out.write(block)
            at += len(block)
            waiting.clear()

        for batch in batches:
            for key, file, offset, length in batch.itertuples(index=False):
                waiting.append(f"{key} {offset} {length} {file}")
                lines += 1
                if len(waiting) == block_lines:
                    flush()
        if waiting:
            flush()
        if out is not None:
            end = zlib.compress(json.dumps(directory).encode())
            out.write(end + struct.pack("<q", len(end)))
            out.close()
            yield pd.DataFrame({"index": [name], "first_key": [directory[0][0]], "lines": [lines]})

    return stored(rows.repartitionByRange(files, "key").sortWithinPartitions("key", "file", "offset")
                  .mapInPandas(write, "index string, first_key string, lines long")).withColumn("folder", F.lit(folder))


class IndexReader:
    """Binary search in the index files; holds one directory and one block at a time."""

    def __init__(self, folder: str, files: list[tuple[str, str]]):
        self.system, _ = open_folder(folder)
        self.firsts, self.names = [first for first, _ in files], [name for _, name in files]
        self.number = self.place = None

    def _directory(self, number: int) -> None:
        if number != self.number:
            self.number, self.place = number, None
            self.file = self.system.open_input_file(self.names[number])
            size = self.file.size()
            self.file.seek(size - 8)
            length = struct.unpack("<q", self.file.read(8))[0]
            self.file.seek(size - 8 - length)
            self.blocks = json.loads(zlib.decompress(self.file.read(length)))

    def _block(self, place: int) -> None:
        if place != self.place:
            self.place = place
            _, at, length = self.blocks[place]
            self.file.seek(at)
            self.lines = zlib.decompress(self.file.read(length)).decode("utf-8", "surrogatepass").split("\n")

    def lookup(self, prefix: str) -> Iterator[tuple[str, int, int, str]]:
        """Key, offset, length and file of each line that begins with the prefix."""
        number = max(bisect.bisect_left(self.firsts, prefix) - 1, 0)
        while number < len(self.names):
            self._directory(number)
            place = max(bisect.bisect_left(self.blocks, prefix, key=lambda block: block[0]) - 1, 0)
            while place < len(self.blocks):
                self._block(place)
                at = bisect.bisect_left(self.lines, prefix)
                while at < len(self.lines):
                    if not self.lines[at].startswith(prefix):
                        return
                    key, offset, length, file = self.lines[at].rsplit(" ", 3)
                    yield key, int(offset), int(length), file
                    at += 1
                place += 1
            number += 1


def lookup(index: DataFrame, wanted: DataFrame, column: str = "prefix") -> DataFrame:
    """Captures whose line begins with a wanted prefix (a URL key and a space, or a whole key and a space): ``prefix``,
    ``key``, ``file``, ``offset``, ``length``; stored. Wanted rows are sorted, so each task reads its part of the index once."""
    files = sorted((row["first_key"], row["index"]) for row in index.select("first_key", "index").collect())
    folder = next(iter(files), ("", ""))[1].rsplit("/", 1)[0]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for batch in batches:
            reader = reader or IndexReader(folder, files)
            found = [(prefix, *capture) for prefix in batch["prefix"] for capture in reader.lookup(prefix)]
            yield pd.DataFrame(found, columns=["prefix", "key", "offset", "length", "file"])

    wanted = stored(wanted.select(F.col(column).alias("prefix")).filter("prefix IS NOT NULL").distinct())
    result = wanted.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInPandas(
        search, "prefix string, key string, offset long, length long, file string")
    return stored(result if files else result.limit(0))


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at ``file``, ``offset``, ``length``: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, and ``payload`` (binary, null for revisits) if asked for. Payloads are checked against their digests."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if with_payload else ""

    def row(raw: bytes) -> tuple:
        record = parse_record(raw)
        headers = record["headers"]
        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
        found = (None if page is None else int(page), headers.get("warc-target-uri"), record["size"], record["digest"],
                 headers["warc-type"], None if refers is None else int(refers))
        return (*found, record["payload"] if headers["warc-type"] == "response" else None) if with_payload else found

    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file, begin, data = None, None, 0, b""
        for batch in batches:
            places = list(batch[["file", "offset", "length"]].itertuples(index=False, name=None))
            rows = []
            for i, (where, offset, length) in enumerate(places):
                if where != name:
                    system, path = open_folder(where)
                    name, file, data = where, system.open_input_file(path), b""
                if not begin <= offset <= offset + length <= begin + len(data):
                    end = offset + length
                    for other, start, size in places[i + 1:]:  # neighbours come with the same read
                        if other != where or start - end > GAP or start + size - offset > READ:
                            break
                        end = max(end, start + size)
                    file.seek(offset)
                    begin, data = offset, file.read(end - offset)
                rows.append(row(data[offset - begin:offset - begin + length]))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions(
        "file", "offset").mapInPandas(read, schema)


def wanted_keys(spark: SparkSession, pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The whole keys of these pages as lookup prefixes."""

    @F.pandas_udf("string")
    def key(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([f"{url_key(url)} {None if page == '' else page} " for page, url in zip(pages, urls)])

    return pages.select(key(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.col(url_column), F.lit(""))).alias("prefix"))
