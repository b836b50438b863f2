"""WARC archives with a two-level capture index.

Captures are sorted by URL key (host reversed) and stored as compressed blocks of lines in index files.
Each index file has a sparse directory, the first key and the place of every block. Above them stands
one entry per index file. A lookup searches the entries, then the directory, both by halving, reads one
block by its range, and then the record by its own range in the archive.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import text_or_empty
from roamframe.storage import cut, new_path, saved

LEAST_SHARED = 100
BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id bigint, archive string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``http://www.a.org/x?y`` gives ``org,a,www)/x?y``.

    Scheme, user, fragment and the usual ports go; a text that is no URL is its own key, a null one ``-``.
    White space and control characters are written as ``%20``.
    """
    start = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?"
    host = F.lower(F.regexp_extract(url, start, 1))
    port = F.regexp_replace(F.regexp_extract(url, start, 2), "^:(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    key = F.when(host == "", F.lower(url)).otherwise(key)
    return F.regexp_replace(F.when(F.coalesce(url, F.lit("")) == "", "-").otherwise(key), r"[\x00-\x20\x7f]", "%20")


def _files(root: str):
    """File system and folder of ``root``; any that the Arrow library opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")


def _packed(data: bytes) -> bytes:
    """A gzip member of its own, so that it can be read without what stands before."""
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the response's headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    place = " ".join((url or "").split()) or "-"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {place}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; damage is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, refers = (int(fields[f]) if f in fields else None for f in ("X-Page-Id", "X-Refers-To-Page"))
    return page, length, digest, kind, refers


@dataclass
class CaptureIndex:
    """Index files under ``root``; ``shards``: (file, first key, last key, directory offset), one per file, in order of keys."""

    root: str
    shards: list[tuple[str, str, str, int]]


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``root``; the captures, stored.

    Of equal payloads of at least LEAST_SHARED bytes the one with the smallest page_id is written whole,
    the others as revisits. Rows that repeat page_id and payload are captures of one page: each is whole.
    A null html is an empty payload, a null url has the key ``-``; a null page_id is never referred to.
    """
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= LEAST_SHARED)
    shared = cut(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    dealt = rows.join(shared, "digest", "left").select(
        "page_id",
        "url",
        url_key(F.col("url")).alias("key"),
        "payload",
        "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"),
    )

    def write(batches):
        files, folder = _files(root)
        files.create_dir(f"{folder}/archives", recursive=True)
        context, number, out, at = TaskContext.get(), 0, None, 0
        for batch in batches:
            captures = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, key, payload, digest, refers_to = row
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    # The attempt is in the name: files of a lost attempt are never referred to.
                    name = f"archives/{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz"
                    out, at, number = files.open_output_stream(f"{folder}/{name}", compression=None), 0, number + 1
                data = _packed(record(page_id, url, payload, digest, refers_to))
                out.write(data)
                captures.append((key, page_id, name, at, len(data)))
                at += len(data)
            if captures:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*captures), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return saved(dealt.mapInArrow(write, _CAPTURE), "captures")


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures by key and write index files: compressed blocks, then the directory of them."""

    def write(batches):
        files, folder = _files(root)
        files.create_dir(f"{folder}/index", recursive=True)
        context = TaskContext.get()
        name = f"index/{context.partitionId():06d}-{context.taskAttemptId()}.cdxj.gz"
        out, at, lines, directory, last = None, 0, [], [], None

        def flush():
            nonlocal at
            data = _packed("\n".join(line for _, line in lines).encode())
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, page_id, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                lines.append((key, f"{key} {json.dumps({'page': page_id, 'file': archive, 'offset': offset, 'length': length})}"))
                last = key
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.write(_packed(json.dumps(directory).encode()))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": context.partitionId(), "first": directory[0][0], "last": last, "at": at}])

    made = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    entries = cut(made.mapInArrow(write, "file string, part bigint, first string, last string, at bigint"))
    # One entry per index file, and as many files as the shuffle has partitions.
    return CaptureIndex(root, [(r.file, r.first, r.last, r["at"]) for r in entries.orderBy("part").collect()])


def look_up(keys: DataFrame, index: CaptureIndex) -> DataFrame:
    """Captures (key, page_id, archive, offset, length) of the distinct keys in column ``key``."""
    firsts = [s[1].encode() for s in index.shards]
    lasts = [s[2].encode() for s in index.shards]
    root, shards = index.root, index.shards

    def choose(batches):
        for batch in batches:
            found = [(k, s) for k in batch.column(0).to_pylist() for s in range(bisect_left(lasts, k.encode()), bisect_right(firsts, k.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())], ["key", "shard"])

    def search(batches):
        files, folder = _files(root)
        shard, source, names, directory, held, lines, heads = None, None, [], [], None, [], []
        for batch in batches:
            out = []
            for key, own in zip(*(c.to_pylist() for c in batch.columns)):
                if own != shard:
                    shard, held = own, None
                    source = files.open_input_file(f"{folder}/{shards[own][0]}")
                    end = shards[own][3]
                    source.seek(end)
                    directory = json.loads(_unpacked(source.read()))
                    names = [d[0].encode() for d in directory]
                wanted = key.encode()
                block = max(0, bisect_left(names, wanted) - 1)
                while block < len(names) and names[block] <= wanted:
                    if held != block:
                        _, at, length = directory[block]
                        source.seek(at)
                        lines, held = _unpacked(source.read(length)).split(b"\n"), block
                        heads = [x.partition(b" ")[0] for x in lines]
                    for line in lines[bisect_left(heads, wanted) : bisect_right(heads, wanted)]:
                        c = json.loads(line.partition(b" ")[2])
                        out.append((key, c["page"], c["file"], c["offset"], c["length"]))
                    block += 1
                if len(out) > 20_000:
                    yield _captured(out)
                    out = []
            if out:
                yield _captured(out)

    dealt = keys.select("key").distinct().mapInArrow(choose, "key string, shard bigint")
    # Neighbouring keys meet in a task, which then reads a block once; no shard is tied to one task.
    near = dealt.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    return near.mapInArrow(search, _CAPTURE)


def _captured(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "page_id", "archive", "offset", "length"])


def read_records(captures: DataFrame, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the captures, by range reads."""

    def read(batches):
        files, folder = _files(root)
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    name, source = archive, files.open_input_file(f"{folder}/{archive}")
                source.seek(offset)
                rows.append(parsed(_unpacked(source.read(length))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    near = captures.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives with their index, then read every record back through the index.

    One row per row of ``pages``. Other columns are ignored; an empty table gives an empty result.
    """
    root = new_path(pages.sparkSession, "warc")
    index = write_index(write_archives(pages, root), root)
    keys = pages.select(url_key(F.col("url").cast("string")).alias("key"))
    return read_records(look_up(keys, index), root)
