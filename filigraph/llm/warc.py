"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself possibly a Zstandard frame; each following frame is one record.
The dictionary is trained on a bounded sample of payloads (``sample`` pages, those
with the smallest id hashes).  Archives are cut at ``archive_bytes`` and written to the
shared folder in one step each, so a retried task is harmless.

The reader streams frame by frame and checks each record: version line, header
syntax, required headers, block length, end of record, and payload digest.

Of equal payloads of at least ``least_bytes`` bytes, the page of smallest id is the
response and the others revisit it.

Edge cases: a null payload is empty; a null page id sorts last and is written
without an id; rows that repeat the smallest id of a payload are all responses; an
empty table gives no archives; a truncated or foreign archive raises; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, heavy_split_join, is_local, local_path, put_file, released, saved, small_batches, work_dir

MAGIC, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_REQUIRED = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")


def _page_urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, ends included."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _page_urn(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", clean),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_urn(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes, compressed: bool = True) -> bytes:
    import zstandard

    body = zstandard.ZstdCompressor(level=19).compress(dictionary) if compressed else dictionary
    return struct.pack("<II", MAGIC, len(body)) + body


def parse(data: bytes, where: str = "") -> tuple[dict[str, str], bytes]:
    """Headers and block of a whole record; raises on whatever is wrong with it."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")) or end < 0:
        raise ValueError(f"{where}: no WARC version line or header end")
    head: dict[str, str] = {}
    for line in data[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"{where}: malformed header {line[:80]!r}")
        head[name] = value.strip()
    for name in _REQUIRED:
        if name not in head:
            raise ValueError(f"{where}: {name} is missing")
    if not head["Content-Length"].isdigit():
        raise ValueError(f"{where}: malformed Content-Length")
    size = int(head["Content-Length"])
    block, tail = data[end + 4 : end + 4 + size], data[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"{where}: the block is not {size} bytes long")
    return head, block


def _chunks(uri: str, size: int = 1 << 14) -> Iterator[bytes]:
    if is_local(uri):
        f = open(local_path(uri), "rb")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        f = store.open_input_stream(path)
    with f:
        while part := f.read(size):
            yield part


def frames(uri: str) -> Iterator[bytes]:
    """The decoded frames of an archive, one after another."""
    import zstandard

    chunks = _chunks(uri)
    rest = b""

    def need(n: int) -> bytes:
        nonlocal rest
        parts, have = [rest], len(rest)
        while have < n:
            part = next(chunks, None)
            if part is None:
                raise ValueError(f"{uri}: truncated")
            parts.append(part)
            have += len(part)
        whole = b"".join(parts)
        rest = whole[n:]
        return whole[:n]

    magic, size = struct.unpack("<II", need(8))
    if magic != MAGIC:
        raise ValueError(f"{uri}: no dictionary frame")
    raw = need(size)
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while True:
        if not rest:
            rest = next(chunks, b"")
            if not rest:
                return
        d, out = plain.decompressobj(), []
        while True:
            out.append(d.decompress(rest))
            if d.eof:
                rest = d.unused_data
                break
            rest = next(chunks, None)
            if rest is None:
                raise ValueError(f"{uri}: truncated frame")
        yield b"".join(out)


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload (without the HTTP head) of each record, checked."""
    for k, data in enumerate(frames(uri)):
        head, block = parse(data, f"{uri}, record {k}")
        http, mark, payload = block.partition(b"\r\n\r\n")
        if head["WARC-Type"] == "response":
            if not mark or not http.startswith(b"HTTP/"):
                raise ValueError(f"{uri}, record {k}: no HTTP head")
            said = head.get("WARC-Payload-Digest", "")
            if said.startswith("sha1:") and said[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                raise ValueError(f"{uri}, record {k}: the payload's digest differs")
        yield head, payload


def train(pages: DataFrame, html: str = "html", id_: str = "page_id", sample: int = 1000, size: int = 65_536, each: int = 16_384) -> bytes:
    """A dictionary from a bounded sample of payloads; empty if they are too few.

    Of the pages whose id's hash falls in a share that holds half more than ``sample``
    ids, those with the ``sample`` smallest hashes give the first ``each`` bytes (one
    page for each hash): tasks send the driver no more than that share.
    """
    import zstandard

    total = pages.count()
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    rows = pages.select(F.xxhash64(id_).alias("h"), F.col(html).alias("b")).filter(unit < 1.5 * sample / max(total, 1))
    rows = rows.groupBy("h").agg(F.min(F.substring(F.encode(F.coalesce("b", F.lit("")), "UTF-8"), 1, each)).alias("b")).orderBy("h").limit(sample).collect()
    parts = [bytes(r.b) for r in rows if r.b]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if len(parts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, dictionary: bytes, id_: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0, archive_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Write archives; returns (path, records)."""
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.col(id_).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    ids = saved(own.filter(F.octet_length("html") >= least_bytes).select(F.coalesce("page", F.lit(NO_ID)).alias("p"), F.sha1("html").alias("sha")), f"{folder}/digests")
    firsts = ids.groupBy("sha").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").select("sha", "first", "n")
    refs = heavy_split_join(ids, saved(firsts, f"{folder}/firsts"), ["sha"], "n", ids.count()).filter("p > first").select("p", F.col("sha").alias("s"), "first").distinct()
    refs = saved(refs, f"{folder}/refs")
    left = own.withColumn("p", F.coalesce("page", F.lit(NO_ID)))
    if refs.limit(1).count():
        few = refs.limit(50_001).count() <= 50_000
        left = left.withColumn("s", F.sha1("html")).join(F.broadcast(refs) if few else refs.hint("shuffle_hash"), ["p", "s"], "left").select("page", "url", "html", "first")
    else:
        left = left.select("page", "url", "html", F.lit(None).cast("long").alias("first"))

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        pack = zstandard.ZstdCompressor(level=level, write_checksum=True, **given)
        head = dictionary_frame(dictionary)
        out, size, n, k = [head], len(head), 0, 0

        def close():
            uri = f"{folder}/warc/part-{part:06d}-{k:04d}.warc.zst"
            put_file(uri, b"".join(out))
            return pa.RecordBatch.from_pydict({"path": [uri], "records": pa.array([n], pa.int64())})

        for b in batches:
            for page, u, text, first in zip(*(c.to_pylist() for c in b.columns)):
                payload = text.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                frame = pack.compress(record(page, u, payload, digest, first, first is not None))
                out.append(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    yield close()
                    out, size, n, k = [head], len(head), 0, k + 1
        if n:
            yield close()

    return saved(left.mapInArrow(released(run), "path string, records long"), f"{folder}/written")


def read(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every record of the archives: path, headers, payload."""
    spark = paths.sparkSession

    def run(batches):
        kind = pa.schema([("path", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for b in batches:
            for p in b.column(0).to_pylist():
                rows, size = [], 0
                for head, payload in records(p):
                    rows.append((p, list(head.items()), payload))
                    size += len(payload)
                    if size > 8 << 20 or len(rows) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kind.types)], schema=kind)

    spread = paths.select(path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), path)
    return spread.mapInArrow(released(run), "path string, headers map<string,string>, payload binary")


def digests(pages: DataFrame) -> DataFrame:
    """Write all pages as archives and read them back; one row per page."""
    folder = work_dir(pages.sparkSession, "warc")
    written = write(pages, folder, train(pages))
    h = F.col("headers")
    return read(written).select(
        h["X-Page-ID"].cast("long").alias("page_id"), h["X-Payload-Length"].cast("long").alias("payload_bytes"), F.substring(h["WARC-Payload-Digest"], 6, 32).alias("payload_digest"),
        h["WARC-Type"].alias("record_type"), h["X-Refers-To-Page"].cast("long").alias("refers_to"))
