"""Whole documents as token ids in Arrow batches: what lies inside a document is counted there, and sums over
documents travel as sorted, delta-coded blocks of pairs instead of a row a pair.

Texts are cut in pieces of at most ``CHUNK`` tokens (or one document).  A piece's pairs are sorted as packed
integers; pairs that are summed over documents go to one of several buckets by their second token, each of which
is merged by one call and holds about ``BUCKET`` pairs, whatever the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import is_local, local_path, map_file, put_file, saved, ship, work_dir

CHUNK, DOCS, BUCKET, ROWS = 1 << 19, 1 << 14, 1 << 22, 1 << 16
#: A vocabulary of more tokens is joined instead of held by each worker.
HELD = 1 << 22


@dataclass
class Piece:
    """Documents in a row: ``rows`` has their columns, ``doc``, ``pos`` and ``code`` those of each token; ids[code] is its id, ascending."""

    rows: pa.Table
    doc: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    ids: np.ndarray
    part: np.ndarray | None = None

    def first(self) -> np.ndarray:
        """Each token's distance from its document's first."""
        n = np.arange(len(self.doc))
        return n - np.searchsorted(self.doc, self.doc)

    def near(self, reach: int, step: int) -> np.ndarray:
        """How far the same token is before (step -1) or after (1) each one; ``reach`` + 1 if beyond."""
        n, out = len(self.doc), np.full(len(self.doc), reach + 1, np.int64)
        for k in range(min(reach, n - 1), 0, -1):
            same = (self.code[k:] == self.code[:-k]) & (self.doc[k:] == self.doc[:-k])
            (out[k:] if step < 0 else out[:-k])[same] = k
        return out


def session(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def cut(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a-z of lowered texts, the document and place of each, and the number of [.!?]+ before it."""
    a = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    heads = at[:-1][at[:-1] < len(raw)]

    def begins(inside: np.ndarray) -> np.ndarray:
        b = inside.copy()
        b[1:] &= ~inside[:-1]
        b[heads] = inside[heads]
        return b

    inside = (raw >= 97) & (raw <= 122)
    starts = np.flatnonzero(begins(inside))
    letters = np.cumsum(inside, dtype=np.int32)
    bounds = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[inside]))
    doc = np.searchsorted(at, starts, "right") - 1
    pos = np.arange(len(starts)) - np.searchsorted(starts, at[:-1])[doc]
    ends = np.concatenate([[0], np.cumsum(begins((raw == 46) | (raw == 33) | (raw == 63)), dtype=np.int64)])
    return flat, doc, pos, ends[starts] - ends[at[:-1]][doc]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Lists of (rows, tokens or ids, doc, pos, part) of bounded size."""
    held, tokens, docs = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        if "tokens" in rows.column_names:
            x = rows["tokens"].combine_chunks()
            own = np.asarray(x.value_lengths().fill_null(0)).astype(np.int64)
            doc = np.repeat(np.arange(len(own)), own)
            got = (x.flatten(), doc, np.asarray(rows["places"].combine_chunks().flatten()).astype(np.int64), doc * 0)
            rows = rows.drop_columns(["tokens", "places"])
        else:
            got = cut(rows["text"].combine_chunks())
            rows = rows.drop_columns(["text"])
        held.append((rows, *got))
        tokens, docs = tokens + len(got[1]), docs + b.num_rows
        if tokens >= CHUNK or docs >= DOCS:
            yield held
            held, tokens, docs = [], 0, 0
    if held:
        yield held


def pieces(batches: Iterator[pa.RecordBatch], vocab: str | None) -> Iterator[Piece]:
    """The documents in pieces; of tokens those of the vocabulary, if one is given, else all, with their places in the vocabulary 0."""
    words = ids = None
    for held in _gathered(batches):
        shift = np.cumsum([0, *(x[0].num_rows for x in held)])
        rows = pa.concat_tables([x[0] for x in held])
        doc, pos, part = (np.concatenate([x[k] + (shift[i] if k == 2 else 0) for i, x in enumerate(held)]) for k in (2, 3, 4))
        flat = pa.concat_arrays([x[1] for x in held])
        if pa.types.is_integer(flat.type):
            own = np.asarray(flat).astype(np.int64)
            uniq, code = np.unique(own, return_inverse=True)
            yield Piece(rows, doc, pos, code.astype(np.int64), uniq, part)
            continue
        d = flat.dictionary_encode()
        code = np.asarray(d.indices).astype(np.int64)
        if vocab is None:
            yield Piece(rows, doc, pos, code, d.dictionary, part)
            continue
        if words is None:
            words, ids = _vocabulary(vocab)
        at = pc.index_in(d.dictionary, value_set=words)
        own = np.where(np.asarray(at.is_valid()), ids[np.asarray(at.fill_null(0))] if len(ids) else 0, 0)
        order = np.argsort(own, kind="stable")
        rank = np.empty(len(own), np.int64)
        none = int(np.count_nonzero(own == 0))
        rank[order] = np.arange(len(own)) - none
        code = rank[code]
        ok = code >= 0
        yield Piece(rows, doc[ok], pos[ok], code[ok], own[order[none:]], part[ok])


def _vocabulary(uri: str) -> tuple[pa.StringArray, np.ndarray]:
    import pyarrow.dataset as ds

    t = ds.dataset(local_path(uri) if is_local(uri) else uri, format="parquet").to_table(columns=["token", "token_id"])
    return t["token"].combine_chunks().cast(pa.string()), t["token_id"].to_numpy().astype(np.int64)


def counted_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) of texts ``docs(text)``: counted in each piece, then summed."""
    session(docs.sparkSession)

    def run(batches):
        held, n = [], 0
        for p in pieces(batches, None):
            held.append(pa.table({"token": p.ids, "n": np.bincount(p.code, minlength=len(p.ids))}))
            n += len(p.ids)
            if n > 1 << 19:
                held = [pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])]
                n = held[0].num_rows
                if n > 1 << 18:
                    yield from held[0].to_batches(ROWS)
                    held, n = [], 0
        if held:
            yield from pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"]).to_batches(ROWS)

    return docs.select(F.lower("text").alias("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def by_document(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose id occurs once, and the others, if there are any: those of one id are one document."""
    if not {"doc_id", "text"} <= set(docs.columns):
        raise ValueError("doc_id and text are needed")
    many = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"))
    if not many.limit(1).count():
        return docs, None
    many = saved(many, work_dir(docs.sparkSession, "repeated"))
    same = docs["doc_id"].eqNullSafe(many["_id"])
    return docs.join(many, same, "left_anti"), docs.join(many, same, "left_semi")


class Corpus:
    """Documents and a vocabulary: ``toks`` are texts (doc_id, text) or tokens (doc_id, pos, token).

    ``map`` runs a function over pieces; ``summed`` also adds up what it gives for pairs of tokens.
    """

    def __init__(self, toks: DataFrame, vocab: DataFrame):
        self.spark = toks.sparkSession
        session(self.spark)
        uri = work_dir(self.spark, "words")
        self.vocab = saved(vocab.select("token", F.col("token_id").cast("long").alias("token_id"), *(["n"] if "n" in vocab.columns else [])), uri)
        self.uri = uri
        size = self.vocab.agg(F.count(F.lit(1)), F.coalesce(F.max("token_id"), F.lit(0))).first()
        self.held, self.top = size[0] <= HELD, int(size[1])
        self.texts = "token" not in toks.columns
        if self.texts:
            self.docs, self.repeated = by_document(toks)
        else:
            self.docs, self.repeated = None, toks
        if self.texts and not self.held:
            self.docs, self.repeated = None, toks

    def sources(self, extra: DataFrame | None = None) -> list[DataFrame]:
        """Tables for ``mapInArrow``: (doc_id, h, text) or (doc_id, h, places, tokens), and the columns of ``extra(doc_id, ..)``."""
        out = []
        h = F.xxhash64("doc_id").alias("h")
        if self.docs is not None:
            out.append(self.docs.select("doc_id", h, F.lower("text").alias("text")))
        if self.repeated is not None:
            from .text import tokens

            t = tokens(self.repeated) if self.texts else self.repeated
            t = t.join(self.vocab, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token_id"))).alias("x"))
            out.append(t.select("doc_id", h, F.col("x.pos").alias("places"), F.col("x.token_id").alias("tokens")))
        return out if extra is None else [x.join(extra, "doc_id") for x in out]

    def map(self, f: Callable[[Piece], Iterator[pa.RecordBatch]], schema: str, extra: DataFrame | None = None) -> DataFrame:
        uri = self.uri

        def run(batches):
            for p in pieces(batches, uri):
                yield from f(p)

        out = None
        for x in self.sources(extra):
            x = x.mapInArrow(run, schema)
            out = x if out is None else out.unionByName(x)
        return out

    def total(self) -> int:
        """How many of the documents' tokens are in the vocabulary."""
        if "n" in self.vocab.columns:
            return int(self.vocab.agg(F.sum("n")).first()[0] or 0)
        n = self.map(lambda p: iter([pa.record_batch({"n": pa.array([len(p.doc)], pa.int64())})]), "n long").agg(F.sum("n")).first()[0]
        return int(n or 0)

    def buckets(self, pairs: int, floats: bool = False) -> Buckets:
        """For at most so many pairs before they are summed."""
        return Buckets(max(1, -(-pairs // BUCKET)), self.top, floats)

    def summed(self, f: Callable[[Piece, Buckets], Iterator[pa.RecordBatch]], reduce: Callable, schema: str, b: Buckets) -> DataFrame:
        """``f`` gives the blocks of a piece; ``reduce(u, v, value, bucket)`` the rows of a bucket's sums, ordered by v, u."""
        blocks = self.map(lambda p: f(p, b), "bucket int, n int, keys binary, data binary")

        def merge(key, table):
            u, v, x = b.merged(key[0].as_py(), table)
            return pa.Table.from_batches(list(out_batches(reduce(u, v, x, key[0].as_py()))))

        return blocks.groupBy("bucket").applyInArrow(merge, schema)


def out_batches(columns: dict) -> Iterator[pa.RecordBatch]:
    """The columns in batches of ``ROWS`` rows; at least one."""
    b = pa.record_batch({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()})
    for at in range(0, max(1, b.num_rows), ROWS):
        yield b.slice(at, ROWS)


def coded(x: np.ndarray) -> bytes:
    """64-bit words by byte planes, as many as are needed, compressed."""
    x = np.ascontiguousarray(x).view(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def decoded(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[1:], n * width, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).reshape(-1)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


@dataclass
class Buckets:
    """Pairs of ids up to ``top``, in ``count`` buckets by the second: key (v // count) (top + 1) + u."""

    count: int
    top: int
    floats: bool = False

    def order(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes in the order of (bucket, id), and each one's place there."""
        order = np.lexsort((ids, ids % self.count))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        return order, rank

    def blocks(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Blocks of distinct pairs of codes that are sorted by (place of v in ``order``, u)."""
        iv = ids[v]
        bucket, key = iv % self.count, iv // self.count * (self.top + 1) + ids[u]
        at = run_starts(bucket)
        ends = np.append(at[1:], len(bucket))
        rows = [(int(bucket[a]), int(z - a), coded(np.diff(key[a:z], prepend=0)), coded(value[a:z])) for a, z in zip(at, ends)]
        for k in range(0, len(rows), 256):
            b, n, keys, data = zip(*rows[k : k + 256])
            yield pa.record_batch({"bucket": pa.array(b, pa.int32()), "n": pa.array(n, pa.int32()), "keys": pa.array(keys, pa.binary()), "data": pa.array(data, pa.binary())})

    def merged(self, bucket: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a bucket's blocks the pairs (u, v) and sums, ordered by (v, u); blocks are summed whenever enough have come up."""
        keys, data, held, limit = [], [], 0, 1 << 21

        def shrink():
            k, x = np.concatenate(keys), np.concatenate(data)
            order = np.argsort(k, kind="stable")
            k, x = k[order], x[order]
            at = run_starts(k)
            return [k[at]], [np.add.reduceat(x, at)]

        for n, k, d in zip(table["n"].to_pylist(), table["keys"], table["data"]):
            keys.append(np.cumsum(decoded(k.as_py(), n).view(np.int64)))
            data.append(decoded(d.as_py(), n).view(np.float64 if self.floats else np.int64))
            held += n
            if held > limit:
                keys, data = shrink()
                held = len(keys[0])
                limit = max(limit, 2 * held)
        if len(keys) > 1:
            keys, data = shrink()
        k = keys[0]
        return k % (self.top + 1), k // (self.top + 1) * self.count + bucket, data[0]


class Packed:
    """Columns of small integers in one, sorted: the first one leads."""

    def __init__(self, *columns: tuple[np.ndarray, int]):
        self.bits = [max(1, int(n - 1).bit_length()) for _, n in columns]
        if sum(self.bits) > 63:
            raise ValueError(f"a document's keys take {sum(self.bits)} bits")
        key = np.zeros(len(columns[0][0]), np.int64)
        for (x, _), b in zip(columns, self.bits):
            key <<= b
            key |= x
        key.sort()
        self.key = key

    def column(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The k-th column, of the rows at ``at``."""
        low = sum(self.bits[k + 1 :])
        return (self.key[at] >> low) & ((1 << self.bits[k]) - 1)

    def starts(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Where runs of equal first k columns begin, among the rows at ``at``."""
        return run_starts(self.key[at] >> sum(self.bits[k:]))


def summed_runs(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at) if len(at) else x[:0]


def window_pairs(p: Piece, width: int, docs: bool = False) -> tuple[np.ndarray, ...]:
    """(a, b, w), a < b: codes of two tokens less than ``width`` apart, and of how many windows theirs are the first such tokens; with ``docs`` also their document."""
    first, before, out = p.first(), p.near(width - 1, -1), []
    for d in range(1, min(width, len(p.doc))):
        w = np.minimum(np.minimum(first[:-d] + 1, width - d), np.minimum(before[:-d], before[d:] - d))
        ok = np.flatnonzero((w > 0) & (p.doc[d:] == p.doc[:-d]))
        x, y = p.code[ok], p.code[ok + d]
        out.append((np.minimum(x, y), np.maximum(x, y), w[ok], *([p.doc[ok]] if docs else [])))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * (3 + docs)


def pairs_ahead(p: Piece, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, u, v, k): v is k + 1 after u, k < ``reach``, and before u's next occurrence."""
    after, out = p.near(reach, 1), []
    for d in range(1, min(reach + 1, len(p.doc))):
        ok = np.flatnonzero((after[:-d] > d) & (p.doc[d:] == p.doc[:-d]))
        out.append((p.doc[ok], p.code[ok], p.code[ok + d], np.full(len(ok), d - 1)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def hashed(x: np.ndarray, seed: np.ndarray, bits: int) -> np.ndarray:
    """Spark's xxhash64 of an int (32 ``bits``) or long column, given the hashes of the columns before it."""
    p1, p2, p3, p4, p5 = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda h, k: (h << np.uint64(k)) | (h >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = seed.view(np.uint64) + p5 + np.uint64(bits // 8)
        if bits == 32:
            h = turn(h ^ ((x.view(np.uint64) & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
        else:
            h = turn(h ^ (turn(x.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def met_pairs(p: Piece, near: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, a, b), a < b: codes of tokens that are at most ``near`` places apart."""
    out, d = [], 1
    while d < len(p.doc):
        ok = np.flatnonzero((p.doc[d:] == p.doc[:-d]) & (p.pos[d:] - p.pos[:-d] <= near))
        if not len(ok):
            break
        ok = ok[code[ok] != code[ok + d]]
        x, y = code[ok], code[ok + d]
        out.append((p.doc[ok], np.minimum(x, y), np.maximum(x, y)))
        d += 1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def column_of(uri: str, name: str, top: int, fill: float = 0.0) -> np.ndarray:
    """A column of a saved (token_id, ..) table by token id."""
    import pyarrow.dataset as ds

    t = ds.dataset(local_path(uri) if is_local(uri) else uri, format="parquet").to_table(columns=["token_id", name])
    out = np.full(top + 1, fill)
    out[t["token_id"].to_numpy()] = t[name].to_numpy()
    return out


def save_postings(p: Piece, b: Buckets, folder: str) -> str:
    """A file of a piece's documents as ascending ids, and where the ids of each bucket are in them; its name is returned."""
    x = Packed((p.doc, p.rows.num_rows), (p.code, len(p.ids)))
    at = x.starts(2)
    doc, ids = x.column(0, at), p.ids[x.column(1, at)]
    order = np.lexsort((ids, ids % b.count))
    ends = np.searchsorted((ids % b.count)[order], np.arange(b.count + 1))
    starts = run_starts(doc)
    name = f"{folder}/{uuid.uuid4().hex}"
    put_file(name, np.array([len(ids), len(starts)], np.int64).tobytes() + ends.astype(np.int64).tobytes() + ids.astype(np.int32).tobytes() + order.astype(np.int32).tobytes() + starts.astype(np.int32).tobytes())
    return name


def held_together(files: list[str], b: Buckets, bucket: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """In how many documents of the files both tokens of each pair are, u < v; the pairs ordered by (v, u), v in the bucket.

    The documents of each v are read from their beginning up to v.  Frequent u are counted in a table of all v by such u,
    of bounded size; the others are sorted by the batch.
    """
    out = np.zeros(len(u), np.int64)
    if not len(u):
        return out
    at = run_starts(v)
    vs = v[at]
    place = np.repeat(np.arange(len(vs)), np.diff(np.append(at, len(v))))
    keys = (place << 32) | u
    dense = max(1, (1 << 23) // len(vs))
    table = np.zeros(len(vs) * dense, np.int32)
    rest, held = [], 0

    def add():
        x = np.concatenate(rest)
        x.sort()
        s = run_starts(x)
        n, x = np.diff(np.append(s, len(x))), x[s]
        to = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        ok = keys[to] == x
        out[to[ok]] += n[ok]

    for name in files:
        raw = map_file(name)
        n, docs = raw[:16].view(np.int64)
        lo, hi = raw[16 + 8 * bucket : 32 + 8 * bucket].view(np.int64)
        if lo == hi:
            continue
        base = 16 + 8 * (b.count + 1)
        ids, post, starts = (raw[base + 4 * x : base + 4 * y].view(np.int32) for x, y in ((0, n), (n + lo, n + hi), (2 * n, 2 * n + docs)))
        ids = np.asarray(ids)
        post = np.asarray(post).astype(np.int64)
        own = np.minimum(np.searchsorted(vs, ids[post]), len(vs) - 1)
        ok = vs[own] == ids[post]
        post, own = post[ok], own[ok]
        begin = starts[np.searchsorted(starts, post, "right") - 1].astype(np.int64)
        size = post - begin
        ends = np.cumsum(size)
        a = 0
        while a < len(post):  # as many documents at once as make about two million tokens
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 21), "right")))
            k = size[a:z]
            to = np.arange(int(k.sum())) + np.repeat(begin[a:z] - (np.cumsum(k) - k), k)
            x, y = ids[to].astype(np.int64), np.repeat(own[a:z], k)
            often = x < dense
            np.add.at(table, y[often] * dense + x[often], 1)
            x = (y[~often] << 32) | x[~often]
            rest.append(x)
            held += len(x)
            if held > 1 << 22:
                add()
                rest, held = [], 0
            a = z
    if rest:
        add()
    often = u < dense
    out[often] += table[place[often] * dense + u[often]]
    return out
