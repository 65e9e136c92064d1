"""Byte-level BPE encoding and decoding.

The distinct words (matches of the pattern) of all texts that are not tokens
themselves are encoded by Spark higher-order functions: ``aggregate`` folds ranked
merges over the array of a word's byte tokens, each step merging the leftmost
neighbours of lowest rank, which a literal map from pairs of tokens to ranks gives.
(A Spark map literal is searched linearly, so the map is a literal hash table
without collisions: a table of entries, and the modulus that each bucket of keys
uses.)  Words of over ``FOLD_BYTES`` bytes are merged with a heap instead, since a
fold copies the array at each step and so is quadratic in the word's length.

The words' ids are written as sorted, hash-addressed files in the shared folder
and memory-mapped by the tasks that assemble the texts: neither the texts nor the
words' occurrences are shuffled, and nothing unbounded is broadcast.  Words are
addressed by a 128-bit hash.  Decoding concatenates the vocabulary's binary pieces.

Texts of common characters are cut by the pattern with its classes spelt out;
texts with others by the same pattern with the classes as the tiktoken library
has them, read from the library once a worker.

Edge cases: a null or empty text has no ids (the hashes of the empty string);
repeated rows are encoded alike; an empty table gives no rows; extra columns are
ignored by ``digests`` and kept by ``encoded`` and ``decoded``, whose new column
replaces a namesake.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from .common import BPE_FAST, BPE_PATTERN, BPE_RARE, arrow_fn, bpe_pattern, map_file, put_file, release, released, small_batches, work_dir

FOLD_BYTES = 2048
SPREAD = 2097143  # a prime; its product with a pair of ids fits in a long


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def _table(path: str) -> tuple[int, list[int], list[int], list[int]]:
    """Bits of a token id, and the rank map: its entries, by bucket the modulus that addresses them, and the ids of bytes."""
    rank = ranks(path)
    bits = max(rank.values()).bit_length()
    if bits > 20:
        raise ValueError("token ids of over 20 bits")
    entries = {}
    for x, r in rank.items():
        for i in range(1, len(x)):
            left, right = rank.get(x[:i]), rank.get(x[i:])
            if left is not None and right is not None:
                entries[left << bits | right] = r
    size = 2 * len(entries) + 257
    prime = next(n for n in range(len(entries) // 3 + 3, 10**9) if all(n % k for k in range(2, int(n**0.5) + 1)))
    buckets: list[list[int]] = [[] for _ in range(prime)]
    for key in entries:
        buckets[key % len(buckets)].append(key)
    table, moved = [-1] * size, [0] * len(buckets)
    for at in sorted(range(len(buckets)), key=lambda k: -len(buckets[k])):
        for off in range(size // 2):
            places = [(key + 1) * SPREAD % (size - off) for key in buckets[at]]
            if len(set(places)) == len(places) and all(table[x] < 0 for x in places):
                break
        else:
            raise ValueError("no table without collisions was found")
        moved[at] = off
        for x, key in zip(places, buckets[at]):
            table[x] = key << bits | entries[key]
    return bits, table, [size - x for x in moved], [rank.get(bytes([x]), 0) for x in range(256)]


def _literal(values: list[int]) -> Column:
    """An array<bigint> literal, handed over as bytes: one of JSON text would be in every print of the plan."""
    sc = SparkSession.active().sparkContext
    jvm, longs = sc._jvm, sc._gateway.new_array(sc._jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(bytearray(np.array(values, ">i8").tobytes())).asLongBuffer().get(longs)
    array = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(longs)
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>")
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(array, kind)))


def rank_literal(path: str) -> tuple[int, int, Column]:
    """Bits of a token id, buckets, and the literal: t, d and b, the arrays of ``_table``."""
    bits, table, moduli, of_bytes = _table(path)
    release()
    return bits, len(moduli), F.struct(_literal(table).alias("t"), _literal(moduli).alias("d"), _literal(of_bytes).alias("b"))


def fold(word: Column, table: tuple[int, int, Column]) -> Column:
    """The ids of a word (array<bigint>), by folding ranked merges over its bytes; an empty word has none."""
    bits, buckets, literal = table
    none = F.array().cast("array<bigint>")
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def ids(t: Column) -> Column:
        def score(a: Column, b: Column) -> Column:
            """The rank of a pair; a number of more than ``bits`` bits, or below 0, if it has none."""
            key = F.shiftleft(a, bits).bitwiseOR(b)
            return t["t"][(key + 1) * SPREAD % t["d"][key % buckets]].bitwiseXOR(F.shiftleft(key, bits))

        def ranked(a: Column, b: Column) -> Column:
            return let(score(a, b), lambda x: F.when((x >= 0) & (x < (1 << bits)), x))

        def step(acc: Column, _) -> Column:
            # p: the tokens; r: the ranks of neighbours (null: none); least: the least of them.  A merge changes two ranks only
            p, r, m = acc["p"], acc["r"], acc["least"]

            def merge(i: Column) -> Column:
                left = F.when(i > 1, F.array(ranked(F.get(p, i - 2), m))).otherwise(none)
                right = F.when(i < F.size(r), F.array(ranked(m, F.get(p, i + 1)))).otherwise(none)
                near = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r)))
                rest = F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p)))
                return let(near, lambda x: F.struct(rest.alias("p"), x.alias("r"), F.array_min(x).alias("least")))

            return F.when(m.isNull(), acc).otherwise(let(F.array_position(r, m).cast("int"), merge))

        def over(p: Column) -> Column:
            n = F.size(p)
            near = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), ranked)
            start = let(near, lambda r: F.struct(p.alias("p"), r.alias("r"), F.array_min(r).alias("least")))
            return F.when(n < 2, p).otherwise(F.aggregate(F.sequence(F.lit(2), n), start, step)["p"])

        # each byte as the character of that number
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        return F.when(F.length(word) == 0, none).otherwise(let(F.transform(chars, lambda c: t["b"][F.ascii(c)]), over))

    return let(literal, ids)


def merged(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of neighbours: n log n, for long words."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(word[i : end[j]])) is not None:
            heap.append((r, i, end[j])) if not heap else heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != e:
            continue
        alive[j], end[i], after[i] = False, e, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


@functools.lru_cache(1)
def _library_pattern():
    """The pattern with the classes as the tiktoken library has them."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bytes_ = {bytes([b]): b for b in range(256)}

    def members(p: str) -> str:
        got = bytes(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=bytes_, special_tokens={}).encode_ordinary(every)).decode()
        points, out = list(map(ord, got)), []
        for c in points:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    return re.compile(bpe_pattern(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))).findall


@functools.lru_cache(1)
def cutter():
    """A function that cuts a text as the pattern does."""
    fast, rare = re.compile(BPE_FAST).findall, re.compile(BPE_RARE).search
    return lambda t: _library_pattern()(t) if rare(t) else fast(t)


@functools.lru_cache(2)
def _whole(path: str) -> dict[str, bytes]:
    """The tokens that are text, with their ids as little-endian unsigned 32-bit integers."""
    out = {}
    for x, r in ranks(path).items():
        try:
            out[x.decode()] = r.to_bytes(4, "little")
        except UnicodeDecodeError:
            pass
    return out


def distinct_words(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(w): the distinct pattern matches of all texts that are not tokens themselves."""

    def cut(batches):
        find, whole = cutter(), _whole(path).keys()
        seen: set[str] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(find(t))
            if len(seen) > 400_000:
                yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen - whole), pa.string())})
                seen = set()
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen - whole), pa.string())})

    return docs.select(F.col(text)).mapInArrow(released(cut), "w string").distinct()


class Dictionary:
    """Words' ids in files of the shared folder, cut by hash and mapped on first use."""

    def __init__(self, folder: str, shards: int, present: list[int]):
        self.folder, self.shards, self.present, self._files = folder, shards, set(present), {}

    def __getstate__(self):
        return {**self.__dict__, "_files": {}}

    def _shard(self, s: int):
        if s not in self._files:
            f = lambda what, kind: map_file(f"{self.folder}/{s}.{what}").view(kind)
            self._files[s] = f("high", np.uint64), f("low", np.uint64), f("at", np.int64), f("ids", np.uint32)
        return self._files[s]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and each word's offset."""
        h = _hashes(words)
        shard = _shard_of(h[:, 0], self.shards)
        order = np.lexsort((h[:, 0], shard))
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        sizes, parts = np.zeros(len(words), np.int64), [None] * self.shards
        for s in range(self.shards):
            mine = order[cut[s] : cut[s + 1]]
            if not len(mine):
                continue
            high, low, at, ids = self._shard(s)
            k = np.searchsorted(high, h[mine, 0])
            while (off := (high[k] == h[mine, 0]) & (low[k] != h[mine, 1])).any():  # equal first halves
                k = k + off
            if not ((high[k] == h[mine, 0]) & (low[k] == h[mine, 1])).all():
                raise KeyError("a word is missing from the dictionary")
            sizes[mine] = at[k + 1] - at[k]
            parts[s] = mine, _ranges(ids, at[k], sizes[mine])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(offsets[-1], np.uint32)
        for p in parts:
            if p is not None:
                out[_places(offsets[p[0]], sizes[p[0]])] = p[1]
        return out, offsets


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each range in turn."""
    total = int(size.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(total) + shift


def _ranges(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return values[_places(start, size)]


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), ">u8").reshape(-1, 2).astype(np.uint64)


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def dictionary(docs: DataFrame, path: str, text: str = "text", shards: int | None = None) -> Dictionary:
    """Encode the distinct words of all texts, into files."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = work_dir(spark, "bpe")
    all_words = distinct_words(docs, path, text)
    short = F.octet_length("w") <= FOLD_BYTES
    coded = all_words.select("w", F.when(short, fold(F.col("w"), rank_literal(path))).alias("ids"))

    def keyed(batches):
        rank = ranks(path)
        for b in batches:
            w = b.column(0).to_pylist()
            h = _hashes(w)
            ids = b.column(1)
            if ids.null_count:
                ids = pa.array([merged(x.encode(), rank) if i is None else i for x, i in zip(w, ids.to_pylist())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(h[:, 0], shards)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), ids], ["s", "high", "low", "ids"])

    def stored(batches):
        got: dict[int, list] = {}
        for b in batches:
            s = np.asarray(b.column(0))
            size = np.asarray(pa.compute.list_value_length(b.column(3))).astype(np.int64)
            ids = np.asarray(b.column(3).flatten()).astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(size)])[:-1]
            for k in np.unique(s):
                m = s == k
                got.setdefault(int(k), []).append((np.asarray(b.column(1))[m].view(np.uint64), np.asarray(b.column(2))[m].view(np.uint64), size[m], _ranges(ids, at[m], size[m])))
        for k in sorted(got):
            high, low, size, ids = (np.concatenate(x) for x in zip(*got.pop(k)))
            at = np.concatenate([[0], np.cumsum(size)])[:-1]
            o = np.lexsort((low, high))
            put_file(f"{folder}/{k}.ids", _ranges(ids, at[o], size[o]).tobytes())
            put_file(f"{folder}/{k}.at", np.concatenate([[0], np.cumsum(size[o])]).astype(np.int64).tobytes())
            put_file(f"{folder}/{k}.low", low[o].tobytes())
            put_file(f"{folder}/{k}.high", high[o].tobytes())
            yield pa.RecordBatch.from_pydict({"s": pa.array([k], pa.int64())})

    made = coded.mapInArrow(released(keyed), "s long, high long, low long, ids array<long>").repartition(shards, "s").mapInArrow(released(stored), "s long").collect()
    return Dictionary(folder, shards, [r.s for r in made])


MEMO = 300_000


class Assembler:
    """A worker's own memo of words' ids (as bytes), filled from the dictionary batch by batch and bounded."""

    def __init__(self, words: Dictionary, path: str):
        self.words, self.whole = words, _whole(path)
        self.memo = dict(self.whole)

    def batch(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        find = cutter()
        if len(self.memo) > len(self.whole) + MEMO:
            self.memo = dict(self.whole)
        cuts = [find(t) if t else [] for t in column.to_pylist()]
        new = list(set().union(*cuts) - self.memo.keys())
        if new:
            ids, at = self.words.ids(new)
            raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
            self.memo.update(zip(new, [raw[i:j] for i, j in zip(at, at[1:])]))
        of = self.memo.__getitem__
        return [b"".join(map(of, x)) for x in cuts]


def encoded(docs: DataFrame, path: str, text: str = "text", words: Dictionary | None = None) -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array<int>)."""
    words = words or dictionary(docs, path, text)

    def run(t: pa.Array) -> pa.Array:
        raw = Assembler(words, path).batch(t)
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    return docs.withColumn("ids", arrow_fn(run, "array<int>")(F.col(text)))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes that the ids stand for; null ids give null. Unknown ids raise."""

    def run(column: pa.Array) -> pa.Array:
        piece = {r: b for b, r in ranks(path).items()}
        return pa.array([None if x is None else b"".join(map(piece.__getitem__, x)) for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, arrow_fn(run, "binary")(F.col(ids)))


def digests(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    words = dictionary(docs, path, text)

    def run(batches):
        pieces = {r: b for b, r in ranks(path).items()}
        piece = [pieces.get(i, b"") for i in range(max(pieces) + 1)].__getitem__
        assembler = Assembler(words, path)
        for b in batches:
            raw = assembler.batch(b.column(1))
            sha = [hashlib.sha256(x).hexdigest() for x in raw]
            back = [hashlib.sha256(b"".join(map(piece, np.frombuffer(x, "<u4").tolist()))).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["i", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("i"), F.col(text)).mapInArrow(released(run), f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("i", id_)

