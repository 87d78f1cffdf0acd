"""WARC archives of pages, with a two-level index over sorted keys, and reading through that index.

Writing: each task writes one archive of gzip members, a record each; pages with a payload that another
page has already stored become revisit records.  Index: one line per record under its reversed-host
key, globally sorted, packed into compressed blocks; a part's directory holds the first key of each of
its blocks, and a table of parts holds the first key of each directory.  Reading: a key finds its part,
the directory is searched by bisection, one block is read, and then the record's bytes.

All files lie in the shared folder; only files named by rows that a finished task returned are read,
so a task may be lost and run again.
"""

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaespark.llm.arrays import small_batches, written
from vitaespark.llm.joins import salted_left
from vitaespark.session import shared_folder

#: Index lines of one compressed block.
BLOCK_LINES = 300
#: Parts of the index, at most: what the table of parts on each task can hold.
MOST_PARTS = 2000
#: Index lines of one part, if that makes fewer parts.
PART_LINES = 20_000
#: One capture time for all: the tables carry none, and archives are then the same on every run.
DATE = "2024-01-01T00:00:00Z"

ENTRY = "key string, page_id long, digest string, file string, place long, size long"


def files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def payload_digest(payload: Column) -> Column:
    return F.sha1(payload)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the path: ``com,example)/a?b``; pages of a site sort together."""
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host):]


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``digest`` and ``refers_to`` (null: the record holds its payload) to rows (page_id, url, html).

    Of equal payloads of ``least_bytes`` or more the smallest page_id keeps its payload.
    """
    # digests and ids only: the payloads are not shuffled to be counted
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digest = payload_digest(payload)
    small = pages.select("page_id", digest.alias("digest"), F.length(payload).alias("bytes")).where(F.col("bytes") >= least_bytes)
    # kept: digests of two rows or more, by a combining aggregate, so a very common payload is no burden
    shared = small.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    joined = salted_left(pages.withColumn("digest", digest), shared.select("digest", "first_id"), ["digest"], "page_id")
    long_enough = F.length(payload) >= least_bytes
    return joined.withColumn("refers_to", F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers (with the payload's length) but no payload."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": f"sha1:{base32(digest)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>",
                 "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record; lengths are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of (page_id, url, html); return an index line per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files(folder)
        name, place, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, digest, refers_to = row
                data = gzip.compress(record(page_id, url, html, digest, refers_to), 5, mtime=0)
                out.write(data)
                rows.append((url_key(url), page_id, digest, name, place, len(data)))
                place += len(data)
            columns = list(zip(*rows)) if rows else [()] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["key", "page_id", "digest", "file", "place", "size"])
        if out is not None:
            out.close()

    small_batches(pages.sparkSession)
    frame = with_references(pages.select(F.col("page_id").cast("long"), "url", "html"), least_bytes)
    return frame.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, ENTRY)


def line_key() -> Column:
    """Order of index lines: by key, page and payload; the form that blocks and directories hold."""
    page = F.lpad(F.coalesce(F.col("page_id"), F.lit(-1)).cast("string"), 20, "0")
    return F.concat_ws(" ", F.coalesce("key", F.lit("")), page, F.coalesce("digest", F.lit("")))


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """Pack sorted index lines into blocks; one row (part file, first key, lines) per part."""
    spark = lines.sparkSession
    total = lines.count()
    parts = max(1, min(MOST_PARTS, total // PART_LINES + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = files(folder)
        name, out, place, held, directory, count = f"{uuid.uuid4().hex}.idx", None, 0, [], [], 0

        def flush():
            nonlocal place, held
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            out.write(data)
            directory.append((held[0][0], place, len(data)))
            place, held = place + len(data), []

        for batch in batches:
            for line in batch.itertuples(index=False):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                held.append((line.sorted, line.file, int(line.place), int(line.size)))
                count += 1
                if len(held) == BLOCK_LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with system.open_output_stream(f"{base}/{name}.dir", compression=None) as there:
                there.write(zlib.compress(json.dumps(directory).encode()))
            yield pd.DataFrame({"first": [directory[0][0]], "part": [name], "lines": [count]})

    ordered = lines.select(line_key().alias("sorted"), "file", "place", "size")
    ordered = ordered.repartitionByRange(parts, "sorted").sortWithinPartitions("sorted", "file", "place")
    return written(ordered.mapInPandas(run, "first string, part string, lines long"), "parts") if total else (
        spark.createDataFrame([], "first string, part string, lines long"))


class Reader:
    """Records of one archive folder by key, through its index."""

    def __init__(self, archive: str, index: str):
        self.archive, self.index = files(archive), files(index)
        self.directories, self.blocks, self.open = {}, {}, {}

    def block(self, part: str, wanted: str) -> list:
        """Lines of the block that may hold a key."""
        system, base = self.index
        if part not in self.directories:
            with system.open_input_stream(f"{base}/{part}.dir", compression=None) as there:
                self.directories[part] = json.loads(zlib.decompress(there.read()))
        directory = self.directories[part]
        at = bisect_right(directory, wanted, key=lambda row: row[0]) - 1
        if at < 0:
            return []
        if (part, at) not in self.blocks:
            self.blocks = {}  # lookups come in order: one block at a time is enough
            _, place, size = directory[at]
            with system.open_input_file(f"{base}/{part}") as there:
                there.seek(place)
                self.blocks[part, at] = [json.loads(x) for x in zlib.decompress(there.read(size)).decode().split("\n")]
        return self.blocks[part, at]

    def get(self, part: str, wanted: str) -> tuple[dict[str, str], bytes, bytes] | None:
        """The record of a key; None if there is none."""
        lines = self.block(part, wanted)
        at = bisect_right(lines, wanted, key=lambda line: line[0]) - 1
        if at < 0 or lines[at][0] != wanted:
            return None
        _, name, place, size = lines[at]
        system, base = self.archive
        if name not in self.open:
            while len(self.open) >= 50:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = system.open_input_file(f"{base}/{name}")
        self.open[name].seek(place)
        return parse(gzip.decompress(self.open[name].read(size)))


FOUND = "page_id long, found boolean, type string, refers_to long, bytes long, digest string"


def lookup(keys: DataFrame, parts: DataFrame, archive: str, index: str) -> DataFrame:
    """Read the records of rows (key, page_id, digest) back; payload digests are computed anew from what was read."""
    # one row per part, MOST_PARTS at most
    table = sorted((r.first, r.part) for r in parts.select("first", "part").collect())
    firsts, names = [r[0] for r in table], [r[1] for r in table]

    @F.pandas_udf("int")
    def part_of(wanted: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(np.array(firsts, object), wanted.to_numpy(object), "right") - 1, 0), dtype="int32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(archive, index)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                got = reader.get(names[row.part], row.wanted) if names else None
                page = None if pd.isna(row.page_id) else int(row.page_id)
                if got is None:
                    out.append((page, False, None, None, None, None))
                    continue
                fields, http, payload = got
                refers = fields.get("WARC-Refers-To")
                said = fields["WARC-Payload-Digest"].partition(":")[2]
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if refers is None:
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if own != said or length != len(payload):
                        raise ValueError("a payload does not fit its digest")
                refers = None if refers is None else int(refers[len("<urn:page:"):-1])
                out.append((page, True, fields["WARC-Type"], refers, length, said))
            frame = pd.DataFrame(out, columns=["page_id", "found", "type", "refers_to", "bytes", "digest"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "bytes": "Int64"})

    asked = keys.select(F.col("page_id"), line_key().alias("wanted"))
    asked = asked.withColumn("part", part_of("wanted")) if names else asked.withColumn("part", F.lit(0))
    # keys of one part meet where they are looked up, in key order; a part is a bounded number of lines
    asked = asked.repartitionByRange(max(1, len(names)), "part", "wanted").sortWithinPartitions("part", "wanted")
    return asked.mapInPandas(run, FOUND)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive (page_id, url, html) rows, index them, and read every page back by its key.

    Null html is an empty payload, a null url an empty one.  Rows that repeat a page_id are a record
    each; those with the smallest id of their payload are all responses.  Null ids refer to the smallest
    id with their payload, if there is one.  An empty table gives no rows; more columns are ignored.
    """
    spark = pages.sparkSession
    archive, index = shared_folder(spark, "archive"), shared_folder(spark, "index")
    lines = written(write_archives(pages, archive, least_bytes), "lines")
    parts = write_index(lines, index)
    return lookup(lines.select("key", "page_id", "digest"), parts, archive, index)
