"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the words of the training texts, sorted by 64-bit hash, with exact
counts.  Level k > 1 holds the n-grams kept (count at least ``least[k - 2]``) as a
monotone pointer sequence over the contexts of level k - 1 and a monotone
sequence of context-relative successors, both Elias-Fano coded, with 16-bit
quantised log10 probabilities.  A context's back-off weight is quantised too.
Levels are cut into shards by the hash of the first word; a shard is one file per
level in the shared folder, written by one task and memory-mapped by the scoring
tasks.  Nothing of the model passes through the driver but its shards' sizes.

Counting reads the texts twice: once for the words, once for the n-grams of the
highest order, whose prefixes are those of all lower orders (an n-gram that the
text's end cuts short is padded).  Tasks sum their own n-grams and send each
shard one sorted, delta-coded, compressed block of columns, so that the only
shuffle of n-grams takes a few bytes each; a shard's task merges its blocks and
writes its part of every level.

Probability: P1(w) = (c(w) + 1) / (N + V + 1), where unknown words have c = 0;
P(w | h) = max(c(hw) - D, 0) / c(h) + g(h) P(w | h') over kept n-grams, where g(h) is
the mass left by them.  Quantisation rounds down, so sums stay at most 1.  The
context of a text's first word is the end token.

``least`` must not fall: then an n-gram is kept only where its prefix and its
suffix are, as it is never more frequent than they are.

Edge cases: a null or empty text is the end token alone; a null id has the crc32
of the empty text; without training texts every word has base probability 1 / 1;
repeated rows count and score again; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, map_file, put_file, released, small_batches, words, work_dir
from .eliasfano import EliasFano

END = np.uint64(0xE5D0C0FFEE123457)
LOCAL = 40  # bits of a place within its shard
_MASK = (1 << LOCAL) - 1
SCALE = 8191.0
_TABLE = np.concatenate([[0.0], 10.0 ** (np.arange(1, 65536) / SCALE - 8)])


def _quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor((np.log10(p) + 8) * SCALE), 0, 65535).astype(np.uint16)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, each token's index into them, and text offsets; every text ends with END."""
    import xxhash

    flat, at = words(column)
    d = flat.dictionary_encode()
    values = d.dictionary.to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))
    one, place = np.unique(np.append(h, END), return_inverse=True)  # sorts distinct words only
    docs = len(at) - 1
    ends = at[1:] + np.arange(docs)
    is_word = np.ones(len(flat) + docs, bool)
    is_word[ends] = False
    index = np.full(len(is_word), place[-1], np.int64)
    index[is_word] = place[np.asarray(d.indices)]
    return one, index, np.concatenate([[0], ends + 1])


class _Words:
    """Sums the counts of word hashes in sorted arrays; full ones are handed on."""

    def __init__(self, limit: int = 1 << 21):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, h: np.ndarray, n: np.ndarray):
        self.parts.append((h, n))
        self.size += len(h)
        if self.size > self.limit:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = len(self.parts[0][0])
            if self.size > self.limit // 2:
                yield from self.flush()

    def flush(self):
        if self.parts:
            h, n = _summed(*(np.concatenate(x) for x in zip(*self.parts)))
            self.parts, self.size = [], 0
            for k in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["h", "n"])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    start = _starts(keys)
    return keys[start], np.add.reduceat(n[order], start) if len(start) else n


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ordered(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of small non-negative integers in lexicographic order, and the sums of their counts."""
    if not len(n):
        return columns, n
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    if sum(bits) <= 63:  # rows fit in one integer each
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:]):
            key = key << b | c
        if (n == 1).all():
            key.sort()
            start = _starts(key)
            n = np.diff(np.append(start, len(key)))
            key = key[start]
        else:
            key, n = _summed(key, n)
        out = []
        for b in bits[:0:-1]:
            out.append(key & ((1 << b) - 1))
            key = key >> b
        return [key, *out[::-1]], n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    start = _starts(*columns)
    return [c[start] for c in columns], np.add.reduceat(n[order], start)


def _block(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows in lexicographic order: differences to the row before within equal prefixes, byte by byte, compressed."""
    import zstandard

    same = np.zeros(len(n), bool)
    same[1:] = True
    out = []
    for c in columns:
        before = np.concatenate([[0], c[:-1]])
        out.append(np.where(same, c - before, c))
        same &= c == before
    out.append(n)
    planes = b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in out)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unblock(raw: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(columns + 1, 8, -1)
    *parts, n = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes)
    out, new = [], np.zeros(len(n), bool)
    new[:1] = True
    for d in parts:  # sums of differences since the prefix last changed
        total = np.cumsum(d)
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        c = total - (total[start] - d[start])[run]
        out.append(c)
        new[1:] |= c[1:] != c[:-1]
    return out, n


class _Ngrams:
    """Gathers the n-grams of texts; full sets are summed and handed on as one block for each shard."""

    def __init__(self, model: Model, order: int, limit: int = 1 << 21):
        self.model, self.order, self.limit, self.parts, self.size = model, order, limit, [], 0
        self.end = int(model.dense(1, model.words(np.array([END]))[0])[0])

    def add(self, column: pa.Array):
        one, index, at = _tokens(column)
        if len(at) > 1:
            self.parts.append((self.model.dense(1, self.model.words(one)[0]), index, at))
            self.size += len(index)
        if self.size > self.limit:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        every = np.unique(np.concatenate([p[0] for p in self.parts] + [[self.end]]))
        end, k = int(np.searchsorted(every, self.end)) + 1, self.order
        row = []  # texts in a row with the end token before each and k zeros after it; others count from 1
        for own, index, at in self.parts:
            place = (np.searchsorted(every, own) + 1)[index]
            docs, size = len(at) - 1, np.diff(at)
            line = np.zeros(len(place) + docs * (k + 1), np.int64)
            shift = np.arange(docs) * (k + 1)
            line[at[:-1] + shift] = end
            line[np.arange(len(place)) + np.repeat(shift + 1, size)] = place
            row.append(line)
        row.append(np.zeros(k, np.int64))
        line, self.parts, self.size = np.concatenate(row), [], 0
        ok = (line[: len(line) - k] > 0) & (line[1 : len(line) - k + 1] > 0)
        columns, n = _ordered([line[j : len(line) - k + j][ok] for j in range(k)], np.ones(int(ok.sum()), np.int64))
        dense = np.concatenate([[-1], every])
        columns = [dense[c] for c in columns]
        base = self.model.base[0]
        cut = np.searchsorted(columns[0], base)
        shards = [s for s in range(self.model.shards) if cut[s] < cut[s + 1]]
        blocks = [_block([columns[0][cut[s] : cut[s + 1]] - base[s], *(c[cut[s] : cut[s + 1]] + 1 for c in columns[1:])], n[cut[s] : cut[s + 1]]) for s in shards]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blocks, pa.binary())], ["s", "block"])


class Model:
    """The trie as the scoring tasks see it; files are mapped on first use."""

    def __init__(self, folder: str, shards: int, sizes: list[list[int]], total: int):
        self.folder, self.shards, self.sizes, self.total = folder, shards, sizes, total
        self.order = len(sizes)
        self.base = [np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in sizes]
        self.vocabulary = int(self.base[0][-1])
        self._files: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "_files": {}}

    def file(self, level: int, shard: int, what: str):
        key = level, shard, what
        if key not in self._files:
            raw = map_file(f"{self.folder}/{level}-{shard}.{what}")
            kind = {"hash": np.uint64, "count": np.int64, "prob": np.uint16, "rest": np.uint16}
            self._files[key] = raw.view(kind[what]) if what in kind else EliasFano(raw)
        return self._files[key]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (shard and place within; -1: unknown) and counts of sorted distinct hashes."""
        place, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cut = np.searchsorted(_shard(h, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            part = h[cut[s] : cut[s + 1]]
            if len(part) and self.sizes[0][s]:
                own = self.file(1, s, "hash")
                at = np.minimum(np.searchsorted(own, part), len(own) - 1)
                ok = own[at] == part
                place[cut[s] : cut[s + 1]][ok] = (s << LOCAL) | at[ok]
                count[cut[s] : cut[s + 1]][ok] = self.file(1, s, "count")[at[ok]]
        return place, count

    def dense(self, level: int, place: np.ndarray) -> np.ndarray:
        return self.base[level - 1][place >> LOCAL] + (place & _MASK)

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of n-grams (-1: not kept), their probabilities, and the contexts' back-off weights; contexts ascend, -1 first."""
        place, p, rest = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        cut = np.searchsorted(context, np.arange(self.shards + 1) << LOCAL)
        for s in np.flatnonzero(np.diff(cut)):
            if not self.sizes[level - 1][s]:
                continue
            mine = slice(cut[s], cut[s + 1])
            c = context[mine] & _MASK
            rest[mine] = _TABLE[self.file(level, s, "rest")[c]]
            mine = np.arange(cut[s], cut[s + 1])
            seen = word[mine] >= 0
            mine, c = mine[seen], c[seen]
            at = self.file(level, s, "next").find(c * self.vocabulary + self.dense(1, word[mine]))
            ok = at >= 0
            mine, c, at = mine[ok], c[ok], at[ok]
            pointers = self.file(level, s, "ptr")
            inside = (pointers.get(c) <= at) & (at < pointers.get(c + 1))
            mine, at = mine[inside], at[inside]
            place[mine] = (s << LOCAL) | at
            p[mine] = _TABLE[self.file(level, s, "prob")[at]]
        return place, p, rest

    def chain(self, column: pa.Array, upto: int):
        """Token places, counts and offsets of texts, and for each level from 2 to ``upto`` what find() gives.

        Each distinct n-gram of the texts is sought once, in the order of the shards.
        """
        one, index, at = _tokens(column)
        own, counts = self.words(one)
        place, count = own[index], counts[index]
        first = at[:-1]
        found = []
        # the context of each token: an index into ``contexts``, whose places ascend
        contexts, context = own, np.empty_like(index)
        if len(index):
            context[1:] = index[:-1]
            context[first] = np.searchsorted(one, END)
        for level in range(2, upto + 1):
            pair = context << 32 | index  # a context of -1 stays negative
            distinct, back = np.unique(pair, return_inverse=True)
            c = distinct >> 32
            places = np.where(c >= 0, contexts[c], -1) if len(contexts) else np.full(len(c), -1, np.int64)
            by = np.argsort(places, kind="stable")
            got = [np.empty_like(x) for x in (places, np.zeros(0), np.zeros(0))] if not len(c) else [np.empty(len(c), x) for x in (np.int64, float, float)]
            for to, x in zip(got, self.find(level, places[by], own[distinct & 0xFFFFFFFF][by])):
                to[by] = x
            found.append(tuple(x[back] for x in got))
            contexts, last = got[0], np.where(got[0] >= 0, np.arange(len(c)), -1)[back]
            context = np.full_like(index, -1)
            if len(index):
                context[1:] = last[:-1]
                context[first] = -1
        return place, count, at, context, found

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score, model score."""
        place, count, at, _, found = self.chain(column, self.order)
        base = (count + 1) / (self.total + self.vocabulary + 1)
        p = base
        for _, q, rest in found:
            p = q + rest * p
        start = at[:-1]
        total = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0)
        return np.diff(at), total((count > 0).astype(np.int64)), total(np.log10(base)), total(np.log10(p))


def train(docs: DataFrame, id_: str = "doc_id", text: str = "text", held: tuple[int, int] | None = (7, 2),
          least: tuple[int, ...] = (2, 3), discount: float = 0.75, shards: int | None = None) -> Model:
    """A model of order ``len(least) + 1`` from the rows whose crc32(id) mod held[0] is not held[1]."""
    if list(least) != sorted(least) or not least or least[0] < 1:
        raise ValueError("least must be positive and not fall")
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark, "lm")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_), F.col(text))
    order = len(least) + 1

    def training(b: pa.RecordBatch) -> pa.Array:
        column = b.column(1)
        return column if held is None else column.filter(pa.array(crc_of_id(b.column(0)) % held[0] != held[1]))

    def unigrams(batches):
        c = _Words()
        for b in batches:
            one, index, at = _tokens(training(b))
            if len(at) > 1:
                n = np.bincount(index, minlength=len(one))
                yield from c.add(one[n > 0], n[n > 0])
        yield from c.flush()

    def level1(batches):
        for s, (h, n) in _by_shard(batches, lambda h: _shard(h.view(np.uint64), shards)):
            h, n = _summed(h.view(np.uint64), n)
            put_file(f"{folder}/1-{s}.hash", h.tobytes())
            put_file(f"{folder}/1-{s}.count", n.tobytes())
            yield pa.RecordBatch.from_pydict({"s": [int(s)], "size": [len(h)], "total": [int(n.sum())]})

    key = F.expr(f"shiftright(shiftrightunsigned(h, 32) * {shards}L, 32)")
    made = texts.mapInArrow(released(unigrams), "h long, n long").repartition(shards, key).mapInArrow(released(level1), "s long, size long, total long").collect()
    words_ = Model(folder, shards, [_sizes(made, shards)], sum(r.total for r in made))
    if not words_.vocabulary:
        return Model(folder, shards, [words_.sizes[0]] + [[0] * shards for _ in least], 0)

    def ngrams(batches):
        c = _Ngrams(words_, order)
        for b in batches:
            yield from c.add(training(b))
        yield from c.flush()

    def build(batches):
        got: dict[int, list[bytes]] = {}
        for b in batches:
            for s, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.setdefault(s, []).append(block)
        for s in sorted(got):
            parts = [_unblock(x, order) for x in got.pop(s)]
            columns, n = _ordered([np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))
            del parts
            whole, contexts, context = np.asarray(words_.file(1, s, "count")), words_.sizes[0][s], columns[0]
            sizes = []
            for level, few in enumerate(least, 2):
                # rows are sorted: an n-gram is a run of rows with one context and one word
                word = columns[level - 1]
                live = np.flatnonzero((context >= 0) & (word > 0))
                start = _starts(context[live], word[live])
                sums = np.add.reduceat(n[live], start) if len(start) else np.zeros(0, np.int64)
                kept = sums >= few
                first = live[start[kept]]
                c, w, m = context[first], word[first] - 1, sums[kept]
                p = (m - discount) / whole[c]
                rest = 1.0 - np.bincount(c, weights=p, minlength=contexts)
                pointers = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=contexts))])
                put_file(f"{folder}/{level}-{s}.ptr", EliasFano.encode(pointers, len(c) + 1))
                put_file(f"{folder}/{level}-{s}.next", EliasFano.encode(c * words_.vocabulary + w, contexts * words_.vocabulary))
                put_file(f"{folder}/{level}-{s}.prob", _quantised(p).tobytes())
                put_file(f"{folder}/{level}-{s}.rest", _quantised(np.maximum(rest, 0)).tobytes())
                sizes.append(len(c))
                # each row's n-gram of this level is the context of the next
                place = np.full(len(n), -1, np.int64)
                place[live] = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1), np.diff(np.append(start, len(live))))
                whole, contexts, context = m, len(c), place
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(sizes), pa.int64()), pa.array(range(1, len(sizes) + 1), pa.int64()), pa.array(sizes, pa.int64())], ["s", "level", "size"])

    blocks = texts.mapInArrow(released(ngrams), "s long, block binary")
    made = blocks.repartition(shards, "s").mapInArrow(released(build), "s long, level long, size long").collect()
    return Model(folder, shards, [words_.sizes[0]] + [_sizes([r for r in made if r.level == k], shards) for k in range(1, order)], words_.total)


def _sizes(made: list, shards: int) -> list[int]:
    sizes = [0] * shards
    for r in made:
        sizes[r.s] = r.size
    return sizes


def _by_shard(batches, shard_of):
    """The rows of a partition, gathered by shard."""
    got: dict[int, list] = {}
    for b in batches:
        cols = [np.asarray(c) for c in b.columns]
        s = shard_of(cols[0])
        for k in np.unique(s):
            got.setdefault(int(k), []).append([c[s == k] for c in cols])
    for k in sorted(got):
        yield k, [np.concatenate(x) for x in zip(*got.pop(k))]


def scored(docs: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", held: tuple[int, int] = (7, 2)) -> DataFrame:
    """doc id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""

    def run(batches):
        for b in batches:
            n, known, base, score = model.score(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(crc_of_id(b.column(0)) % held[0] == held[1]), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.total, np.int64)), pa.array(base), pa.array(score)],
                ["i", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("i"), F.col(text)).mapInArrow(released(run), f"i {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("i", id_)
