"""WARC archives with a two-level capture index.

Writing: a record per page, gzip-compressed one by one, in archive files under the shared folder.  Of records with equal
payloads of at least `REVISIT_BYTES` bytes, those of the largest page_id are responses, the others revisits of it.

Index: captures are sorted by URL key (host reversed, so that a site's pages lie together) and page, and written as shards of
compressed blocks of lines; each shard keeps a sparse directory of its blocks' first keys, and a short list holds the
shards' first keys.  A lookup binary-searches the list, the directory and the block, then reads the record's byte range.

Every file has a name of its own for each task attempt, and only names that a finished task returned are read, so lost
executors and repeated tasks leave no trace but unread files.

Defined results: null html is an empty payload; a null url gets the key `-` and no target; rows with a null page_id
are always responses and never referred to; rows that repeat a page_id are recorded each, and are responses if theirs is the
largest id; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path

REVISIT_BYTES = 1000
#: Captures of a block, and of a shard at most.
BLOCK_LINES = 256
SHARD_LINES = 1_000_000
#: Byte range of an archive that one read task takes; gap up to which neighbouring records are read at once, and how much at once.
READ_RANGE = 32 << 20
GAP, READ_AT_ONCE = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def url_key(url: str | None) -> str:
    """Reversed-host key: `https://www.Example.com:80/a?b` -> `com,example,www)/a?b`."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower().rstrip("."), parts.port
    except ValueError:
        return _line(url)
    if not host:
        return _line(url)
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return _line(key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def _line(text: str) -> str:
    """Without white space and control characters, so that it keeps to one field of one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url:
        head.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
        if refers_url:
            head.append(("WARC-Refers-To-Target-URI", _line(refers_url)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page_id: int | None
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None
    headers: dict[str, str]


def parse_record(raw: bytes) -> Record:
    """Parse one uncompressed record and check what it says of itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, body = block.partition(b"\r\n\r\n")
    told = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = headers["WARC-Type"]
    if kind == "response" and (hashlib.sha1(body).hexdigest() != told or len(body) != size):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return Record(kind, number("X-Page-Id"), number("X-Refers-To-Page"), told, size, body if kind == "response" else None, headers)


def _filesystem(folder: str):
    """(file system, path) of a folder URI, for any store that pyarrow reaches (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _attempt() -> str:
    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): payloads below `least` bytes never meet a join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    large = (F.octet_length("html") >= least) & F.col("page_id").isNotNull()
    nothing = rows.where(~large).select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    keyed = rows.where(large).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # combined by digest in each task before the shuffle; only payloads that do repeat go on to the join
    first = keyed.groupBy("digest").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.max_by("url", "page_id").alias("top_url")).where("top > low").drop("low")
    same = F.col("top").isNull() | (F.col("top") == F.col("page_id"))
    joined = keyed.join(first, "digest", "left").select(
        "page_id", "url", "html", F.when(~same, F.col("top")).alias("refers_to"), F.when(~same, F.col("top_url")).alias("refers_url")
    )
    return joined.unionByName(nothing)


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write the records; a row per capture: key, page_id, file, offset, length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _filesystem(folder)
        store.create_dir(path, recursive=True)
        name, out, at = f"{_attempt()}.warc.gz", None, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, to, to_url in zip(b["page_id"].astype("Int64"), b["url"], b["html"], b["refers_to"].astype("Int64"), b["refers_url"]):
                    page_id, to = (None if pd.isna(x) else int(x) for x in (page_id, to))
                    raw = gzip.compress(build_record(page_id, url, html.encode("utf-8", "replace"), to, to_url), level, mtime=0)
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(raw)
                    rows.append((url_key(url), page_id, name, at, len(raw)))
                    at += len(raw)
                df = pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"])
                df["page_id"] = df["page_id"].astype("Int64")
                yield df
        finally:
            if out is not None:
                out.close()

    return pages.mapInPandas(run, "key string, page_id long, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Write the shards; (first key and page, name) of each, in order: the list that a lookup starts from."""
    spark = captures.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // SHARD_LINES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _filesystem(folder)
        store.create_dir(path, recursive=True)
        name, out, at, lines, directory, first = f"{_attempt()}.cdx", None, 0, [], [], None

        def flush():
            nonlocal out, at, lines
            raw = zlib.compress("\n".join(lines).encode(), 6)
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            out.write(raw)
            directory.append(f"{lines[0].rsplit(' ', 1)[0]}\t{at}\t{len(raw)}")
            at, lines = at + len(raw), []

        for b in batches:
            for key, page, file, offset, length in zip(b["key"], b["page_id"].astype("Int64"), b["file"], b["offset"], b["length"]):
                lines.append(entry_key(key, None if pd.isna(page) else int(page)) + " " + json.dumps([file, int(offset), int(length)], separators=(",", ":")))
                first = first or lines[0].rsplit(" ", 1)[0]
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write(zlib.compress("\n".join(directory).encode(), 6))
            yield pd.DataFrame({"first": [first], "name": [name]})

    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", F.col("page_id").asc_nulls_first(), "file", "offset")
    # a row for each shard, which holds up to a million captures
    return sorted(tuple(r) for r in ordered.mapInPandas(run, "first string, name string").collect())


def entry_key(key: str, page_id: int | None) -> str:
    """Sorts by key, then page: ids are shifted to be positive and padded."""
    return f"{key} {'' if page_id is None else format(page_id + (1 << 63), '020d')}"


class Shard:
    """Binary search of one shard: its directory, then the one or two blocks that a key can lie in."""

    def __init__(self, store, path: str):
        with store.open_input_stream(f"{path}.dir", compression=None) as f:
            rows = [x.split("\t") for x in zlib.decompress(f.read()).decode().split("\n")]
        self.firsts = [r[0] for r in rows]
        self.places = [(int(r[1]), int(r[2])) for r in rows]
        self.file = store.open_input_file(path)
        self.held: tuple[int, list[str], list[str]] = (-1, [], [])

    def block(self, k: int) -> tuple[list[str], list[str]]:
        if self.held[0] != k:
            at, size = self.places[k]
            lines = zlib.decompress(self.file.read_at(size, at)).decode().split("\n")
            self.held = (k, [x.rsplit(" ", 1)[0] for x in lines], lines)
        return self.held[1:]

    def find(self, wanted: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key and page."""
        out = []
        k = max(bisect_right(self.firsts, wanted) - 1, 0)
        while k >= 0:
            keys, lines = self.block(k)
            hi = bisect_right(keys, wanted)
            lo = hi
            while lo and keys[lo - 1] == wanted:
                lo -= 1
            out += [tuple(json.loads(x.rsplit(" ", 1)[1])) for x in lines[lo:hi]]
            if lo or self.firsts[k] != wanted:  # else the run may begin in the block before
                break
            k -= 1
        return out


def lookup(wanted: DataFrame, folder: str, shards: list[tuple[str, str]]) -> DataFrame:
    """(key, page_id) -> (file, offset, length), a row per capture found, through the index alone."""
    firsts, names = [s[0] for s in shards], [s[1] for s in shards]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [entry_key(k, None if pd.isna(p) else int(p)) for k, p in zip(b["key"], b["page_id"].astype("Int64"))]
            rows = []
            for k in keys:
                at = max(bisect_right(firsts, k) - 1, 0)
                rows.append((at, k))
                while at and firsts[at] == k:  # equal captures may begin in the shard before
                    at -= 1
                    rows.append((at, k))
            yield pd.DataFrame(rows, columns=["shard", "wanted"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _filesystem(folder)
        held: tuple[int, Shard | None] = (-1, None)
        for b in batches:
            rows = []
            for at, k in zip(b["shard"], b["wanted"]):
                if at != held[0]:
                    held = (at, Shard(store, f"{path}/{names[at]}"))
                rows += held[1].find(k)
            yield pd.DataFrame(rows, columns=["file", "offset", "length"])

    if not shards:
        return wanted.sparkSession.createDataFrame([], "file string, offset long, length long")
    # a capture that several equal requests found is one capture
    routed = wanted.mapInPandas(route, "shard int, wanted string").distinct()
    routed = routed.repartition(len(shards), "shard").sortWithinPartitions("shard", "wanted")
    return routed.mapInPandas(search, "file string, offset long, length long")


def read_captures(places: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """Parse the records at (file, offset, length); neighbours are read in one range."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _filesystem(folder)
        name, source = None, None
        for b in batches:
            todo = list(zip(b["file"], b["offset"].tolist(), b["length"].tolist()))
            rows, i = [], 0
            while i < len(todo):
                j, (file, at, end) = i, (todo[i][0], todo[i][1], todo[i][1])
                while j < len(todo) and todo[j][0] == file and 0 <= todo[j][1] - end <= GAP and (j == i or todo[j][1] + todo[j][2] - at <= READ_AT_ONCE):
                    end = todo[j][1] + todo[j][2]
                    j += 1
                if file != name:
                    name, source = file, store.open_input_file(f"{path}/{file}")
                data = source.read_at(end - at, at)
                for _, o, n in todo[i:j]:
                    r = parse_record(gzip.decompress(data[o - at : o - at + n]))
                    rows.append((r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to) + ((r.payload,) if keep_payload else ()))
                i = j
            df = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            for c in ("page_id", "refers_to"):
                df[c] = df[c].astype("Int64")
            yield df

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.withColumn("part", F.floor(F.col("offset") / READ_RANGE)).repartition(n, "file", "part").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, index them, look every page up in the index and read its record back."""
    folder = new_path(pages.sparkSession, "warc")
    captures = materialise(write_archives(mark_revisits(pages), folder), "warc-captures")
    shards = build_index(captures, f"{folder}/index")
    return read_captures(lookup(captures.select("key", "page_id"), f"{folder}/index", shards), folder)
