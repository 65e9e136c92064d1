"""A Spark data source for coded adjacency: ``spark.read.format("filigraph")``.

A file holds chunks of consecutive vertices: magic, version, code, chunk size, then
for each chunk its number, first vertex, vertex and edge counts, and the length of
its bits; the bits follow.  Codes: an integer code (gaps, with one reference), ``plain``
(degrees and ids of fixed width, big-endian), ``coder`` (the list coder, with the offset
of each record), ``entropy`` (adaptive range coding), ``huffman`` (words by the chunk's
own frequencies).  One file is one input partition; a filter on ``id`` for a single
vertex is pushed down, so that a lookup decodes one chunk, or with ``coder`` and ``plain``
only the records needed.  The writer takes
(id, nbrs) rows and expects them partitioned by chunk (see ``write``).
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..functions import entropy
from ..functions import lists as kernels
from ..functions.codes import Bits
from ..graph import Graph
from ..operators import coder
from ..operators.codec import decode_lists, encode_lists
from ..runtime import local_path, ship

MAGIC = b"FGC1"
INTEGER = ("gamma", "delta", "fibonacci", "zeta")
CODES = (*INTEGER, "plain", "coder", "entropy", "huffman")
_FILE, _CHUNK = struct.Struct("<4sBII"), struct.Struct("<QQIQI")


def packed(lists: list[tuple[int, list[int]]], code: str, window: int) -> bytes:
    """The lists of consecutive vertices as a chunk's bytes."""
    if code in INTEGER:
        return encode_lists(lists, code, window)
    first, rows = lists[0][0], [x for _, x in lists]
    if code == "coder":
        data, at, _ = coder.encode(first, rows, coder.Options(window=window))
        return np.array([len(at), *at], "<u4").tobytes() + data
    if code == "plain":
        width = max(1, (max((x[-1] for x in rows if x), default=0).bit_length() + 7) // 8)
        return bytes([width]) + np.array([len(x) for x in rows], ">u4").tobytes() + b"".join(v.to_bytes(width) for x in rows for v in x)
    if code == "entropy":
        e = entropy.NumberEncoder()
        for k, xs in enumerate(rows):
            e.contexts.reset()
            e.put(len(xs))
            for j, x in enumerate(xs):
                e.put(x - xs[j - 1] - 1 if j else kernels.zigzag(x - first - k))
        return e.finish()
    w = Bits()
    tree = entropy.huffman_tree(Counter(v for x in rows for v in x))
    w.put(int(tree is not None), 1)
    if tree is not None:
        entropy.write_tree(w, tree)
        words = entropy.huffman_codes(tree)
        for xs in rows:
            kernels.write_small(w, len(xs), "gamma")
            entropy.write_huffman(w, xs, words)
    return w.bytes()


def unpacked(data: bytes, first: int, n: int, code: str, only: int | None = None) -> list[tuple[int, list[int]]]:
    """The lists of a chunk; where ``only`` names a vertex, codes with an index give just its list."""
    if code in INTEGER:
        return decode_lists(data, first, n, code)
    if only is not None and not first <= only < first + n:
        return []
    if code == "coder":
        k = int.from_bytes(data[:4], "little")
        at, bits = np.frombuffer(data, "<u4", k, 4).tolist(), data[4 + 4 * k :]
        if only is not None:
            return [(only, coder.lookup(bits, at, first, only))]
        return list(enumerate(coder.decode(bits, first, n), first))
    if code == "plain":
        width, degrees = data[0], np.frombuffer(data, ">u4", n, 1)
        ends = np.cumsum(degrees, dtype=np.int64).tolist()
        body = 1 + 4 * n
        read = lambda k: [int.from_bytes(data[body + i * width : body + (i + 1) * width]) for i in range(ends[k] - int(degrees[k]), ends[k])]
        return [(first + k, read(k)) for k in (range(n) if only is None else [only - first])]
    out: list[tuple[int, list[int]]] = []
    if code == "entropy":
        d = entropy.NumberDecoder(data)
        for k in range(n):
            d.contexts.reset()
            xs: list[int] = []
            for _ in range(d.take()):
                xs.append(xs[-1] + 1 + d.take() if xs else first + k + kernels.unzigzag(d.take()))
            out.append((first + k, xs))
        return out
    r = Bits(data)
    if not r.take(1):
        return [(first + k, []) for k in range(n)]
    tree = entropy.read_tree(r)
    return [(first + k, entropy.read_huffman(r, tree, kernels.read_small(r, "gamma"))) for k in range(n)]


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str
    vertices: int
    edges: int


class ContainerReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                self.only = int(f.value)
            yield f  # Spark checks it again

    def partitions(self):
        return [Part(p) for p in sorted(glob.glob(f"{self.path}/*.fgc"))] or [Part("")]

    def read(self, part: Part):
        if not part.path:
            return
        with open(part.path, "rb") as f:
            magic, code, size, n = _FILE.unpack(f.read(_FILE.size))
            if magic != MAGIC or code >= len(CODES):
                raise ValueError(f"{part.path} is no adjacency container")
            for _ in range(n):
                chunk, first, k, _, length = _CHUNK.unpack(f.read(_CHUNK.size))
                if self.only is not None and chunk != self.only // size:
                    f.seek(length, 1)
                    continue
                data = f.read(length)
                if len(data) != length:
                    raise ValueError(f"{part.path} is truncated")
                for v, nbrs in unpacked(data, first, k, CODES[code], self.only):
                    yield v, nbrs


class ContainerWriter(DataSourceWriter):
    def __init__(self, path: str, code: str, size: int, window: int):
        self.path, self.code, self.size, self.window = path, code, size, window

    def write(self, rows) -> Written:
        chunks: dict[int, dict[int, list[int]]] = {}
        for r in rows:
            chunks.setdefault(r.id // self.size, {})[r.id] = sorted(r.nbrs)
        os.makedirs(self.path, exist_ok=True)
        part = f"{self.path}/.{uuid.uuid4().hex}.part"
        edges = 0
        with open(part, "wb") as f:
            f.write(_FILE.pack(MAGIC, CODES.index(self.code), self.size, len(chunks)))
            for c in sorted(chunks):
                own, first = chunks[c], c * self.size
                lists = [(first + i, own.get(first + i, [])) for i in range(max(own) - first + 1)]
                data = packed(lists, self.code, self.window)
                m = sum(len(x) for _, x in lists)
                edges += m
                f.write(_CHUNK.pack(c, first, len(lists), m, len(data)) + data)
        return Written(part, sum(len(c) for c in chunks.values()), edges)

    def commit(self, messages) -> None:
        for k, m in enumerate(x for x in messages if x is not None):
            if m.vertices:
                os.replace(m.path, f"{self.path}/part-{k:06d}.fgc")
            else:
                os.remove(m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class Container(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filigraph"

    def schema(self) -> str:
        return "id long, nbrs array<long>"

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(local_path(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        o = self.options
        return ContainerWriter(local_path(o["path"]), o.get("code", "zeta"), int(o.get("chunk", "256")), int(o.get("window", "7")))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Container)


def write(g: Graph, path: str, code: str = "zeta", chunk: int = 256, window: int = 7, files: int = 8) -> None:
    """Write a graph's lists; whole chunks go to one file."""
    spark = g.edges.sparkSession
    register(spark)
    lists = g.neighbour_lists().repartition(files, F.floor(F.col("id") / chunk)).sortWithinPartitions("id")
    lists.write.format("filigraph").option("code", code).option("chunk", str(chunk)).option("window", str(window)).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, nbrs) of every vertex up to the last of each chunk."""
    register(spark)
    return spark.read.format("filigraph").load(path)
