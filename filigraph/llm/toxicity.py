"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over an index of all their terms.

Terms are words and their 4- and 5-character beginnings, and within scripts that
are written without spaces all pairs of neighbouring characters.  Every term of
the examples is in the index; association with the label (log-likelihood ratio)
only adds to a term's weight.  The index holds a bounded, documented sample of
labelled documents: ``examples`` of either label, those with the smallest id
hashes.  Every document is then compared with every example: frequent terms by a
dense matrix product, all others by their postings, so the ``k`` nearest are exact.
The vote weighs labels by squared similarity beside a constant share for the
examples without any term, and is calibrated by a logistic fit to the examples'
own leave-one-out votes, at the labels' true rate.

Labels, language, source and id are no inputs of a score.

Edge cases: a null or empty text, or one that shares no term with any example, gets
the calibrated score of no evidence; labels other than 0 and 1 are left out, and of
a document's repeated labels the larger counts; without labels, or with one class
only, every score is the (smoothed) rate of toxic labels; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, saved, small_batches, work_dir

_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Runs of characters of scripts written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
#: Log-likelihood ratio up to which a term's association with the label counts as chance.
CHANCE = 10.0


def _words(text: str | None) -> Counter:
    return Counter(text.encode().translate(_BYTES).decode().split()) if text else Counter()


def word_terms(w: str) -> list[str]:
    """A word's terms: itself (a long one by its digest), its beginnings, and the character pairs of unspaced scripts."""
    out = [w if len(w) <= 24 else "#" + hashlib.blake2b(w.encode(), digest_size=12).hexdigest(), *(w[:k] + "*" for k in (4, 5) if len(w) > k)]
    if not w.isascii():
        for run in _UNSPACED.findall(w):
            out += [run[i : i + 2] + "+" for i in range(max(1, len(run) - 1))]
    return out


def term_key(term: str) -> int:
    """The 64-bit hash that stands for a term; a million terms share one with a chance of 3e-8."""
    h = xxhash.xxh3_64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


class BlockMaxIndex:
    """Postings of unit vectors by term, cut into blocks of examples with the largest weight of each.

    Its search is quick for a few terms only; the model compares by ``ExactIndex``, which tests hold against this one.
    """

    def __init__(self, vectors: list[dict[int, float]], block: int = 64):
        self.n, self.block = len(vectors), block
        by: dict[int, list[tuple[int, float]]] = {}
        for i, v in enumerate(vectors):
            for t, w in v.items():
                by.setdefault(t, []).append((i, w))
        self.lists = {}
        for t, p in by.items():
            ids, ws = np.array([i for i, _ in p]), np.array([w for _, w in p])
            blocks, start = np.unique(ids // block, return_index=True)
            self.lists[t] = ids, ws, blocks, np.append(start, len(ids)), np.maximum.reduceat(ws, start)

    def nearest(self, vector: dict[int, float], k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, as (cosine, example); ties go to the smaller example."""
        terms = [(w, self.lists[t]) for t, w in sorted(vector.items()) if t in self.lists]
        if not terms:
            return []
        bound = np.zeros((self.n + self.block - 1) // self.block)
        for w, (_, _, blocks, _, most) in terms:
            bound[blocks] += w * most
        best: list[tuple[float, int]] = []
        for b in np.lexsort((np.arange(len(bound)), -bound)):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            score = np.zeros(self.block)
            for w, (ids, ws, blocks, start, _) in terms:
                at = np.searchsorted(blocks, b)
                if at < len(blocks) and blocks[at] == b:
                    s = slice(start[at], start[at + 1])
                    score[ids[s] - b * self.block] += w * ws[s]
            found = [(float(score[i]), int(b * self.block + i)) for i in np.flatnonzero(score > 0) if b * self.block + i != but]
            best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
        return best


class ExactIndex:
    """Cosines with all of n unit vectors: terms in over n / 32 of them (``head`` at most) as a matrix, the others as postings."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, head: int = 512):
        self.n = n
        df = np.bincount(term, minlength=terms)
        frequent = np.lexsort((np.arange(terms), -df))[:head]
        self.frequent = frequent[df[frequent] > n / 32]
        self.place = np.full(terms, -1, np.int32)
        self.place[self.frequent] = np.arange(len(self.frequent))
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order].astype(np.int32), weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self._dense = None

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    @property
    def dense(self) -> np.ndarray:
        """The frequent terms' weights in each example; made where it is used."""
        if self._dense is None:
            self._dense = np.zeros((len(self.frequent), self.n))
            for i, t in enumerate(self.frequent):
                own = slice(self.at[t], self.at[t + 1])
                self._dense[i, self.row[own]] = self.weight[own]
        return self._dense

    def cosines(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each vector (its terms and weights), with its cosine to each example."""
        q = np.zeros((len(vectors), len(self.dense)))
        for i, (t, w) in enumerate(vectors):
            p = self.place[t]
            q[i, p[p >= 0]] = w[p >= 0]
        out = q @ self.dense
        for i, (t, w) in enumerate(vectors):
            p = self.place[t]
            t, w = t[p < 0], w[p < 0]
            start, size = self.at[t], self.at[t + 1] - self.at[t]
            total = int(size.sum())
            if total:
                each = np.arange(total) + np.repeat(start - np.cumsum(size) + size, size)
                out[i] += np.bincount(self.row[each], self.weight[each] * np.repeat(w, size), self.n)
        return out

    @staticmethod
    def best(cosine: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, as (cosine, example); ties go to the smaller example."""
        least = np.partition(cosine, -k)[-k] if len(cosine) > k else 0.0
        near = np.flatnonzero((cosine >= least - 1e-11) & (cosine > 1e-12))
        c = np.round(cosine[near], 12)
        pick = np.lexsort((near, -c))[:k]
        return list(zip(c[pick].tolist(), near[pick].tolist()))


class Model:
    """``keys``: hashes of the terms; ``sizes``: terms of each example, which ``at`` and ``counts`` hold one example after the other."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, ids: list[int], labels: np.ndarray, sizes: np.ndarray, at: np.ndarray, counts: np.ndarray, rate: float, k: int, share: float):
        self.keys, self.weights, self.k, self.share, self.rate, self.ids, self.labels = keys, weights, k, share, rate, ids, labels
        weight = {1: rate / max(1, (labels == 1).sum()), 0: (1 - rate) / max(1, (labels == 0).sum())}
        self.weight = weight
        bare = labels[sizes == 0].tolist()
        total = sum(weight[y] for y in bare)
        self.bare = sum(weight[y] for y in bare if y) / total if total else rate
        self.slope, self.shift = 1.0, 0.0
        if not ids:
            return
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        v = (1 + np.log(counts)) * weights[at]
        v /= np.sqrt(np.bincount(row, v * v, len(ids)))[row]
        self.index = ExactIndex(len(ids), row, at, v, len(weights))
        if 0 < labels.mean() < 1:
            pick = np.linspace(0, len(ids) - 1, min(len(ids), 3000)).astype(int)
            end = np.cumsum(sizes)
            own = [slice(end[i] - sizes[i], end[i]) for i in pick]
            raw = np.array([u for u, _ in self.votes([(at[o], v[o]) for o in own], pick)])
            self._calibrate(raw, labels[pick])
        self.index._dense = None

    def places(self) -> dict[int, int]:
        """The place of each term by its hash."""
        return dict(zip(self.keys.tolist(), range(len(self.keys))))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(counts)) * self.weights[terms]
        norm = np.sqrt((v * v).sum())
        return (terms, v / norm) if norm > 0 else (terms[:0], v[:0])

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: np.ndarray | None = None) -> list[tuple[float, list[tuple[float, int]]]]:
        """Of each vector: the vote, and its nearest examples; ``but`` names an example that each leaves out."""
        out = []
        for s in range(0, len(vectors), 128):
            cosines = self.index.cosines(vectors[s : s + 128])
            for i, row in enumerate(cosines):
                if but is not None:
                    row[but[s + i]] = 0.0
                near = self.index.best(row, self.k)
                up, down = self.share * self.bare, self.share
                for c, j in near:
                    up += c * c * self.labels[j]
                    down += c * c
                out.append((float(up / down), near))
        return out

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        x = self._logit(raw)
        w = np.array([self.weight[v] for v in y])
        w = w / w.sum() * len(y)
        goal = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(w * (p - goal) * x).sum() + 1e-3 * (a - 1), (w * (p - goal)).sum()])
            h = w * p * (1 - p)
            m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
            da, db = np.clip(np.linalg.solve(m, g), -1, 1)
            a, b = max(0.05, a - da), b - db
        self.slope, self.shift = float(a), float(b)

    @staticmethod
    def _logit(p):
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def scores(self, counted: list[dict[int, int]]) -> list[tuple[float, list[tuple[float, int]]]]:
        if not self.ids:
            return [(self.rate, [])] * len(counted)
        vectors = [self.vector(np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c))) for c in counted]
        return [(float(1 / (1 + np.exp(-(self.slope * self._logit(raw) + self.shift)))), near) for raw, near in self.votes(vectors)]


def _count_terms(text: str | None, memo: dict) -> dict[int, int]:
    out: dict[int, int] = {}
    for w, n in _words(text).items():
        for t in memo[w] if len(w) <= 64 else memo.places(w):
            out[t] = out.get(t, 0) + n
    return out


class _Memo(dict):
    def __init__(self, places: dict[int, int]):
        self.known = places

    def places(self, w: str) -> tuple[int, ...]:
        return tuple(self.known[h] for h in map(term_key, word_terms(w)) if h in self.known)

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        r = self[w] = self.places(w)
        return r


def weighted(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Terms' weights: inverse document frequency, raised with the log-likelihood ratio of term and label."""
    def x(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    df, n = c0 + c1, n0 + n1
    g = 2 * (x(c0, df * n0 / n) + x(c1, df * n1 / n) + x(n0 - c0, (n - df) * n0 / n) + x(n1 - c1, (n - df) * n1 / n))
    return np.log((n + 1) / (df + 0.5)) * (1 + np.maximum(g - CHANCE, 0) / CHANCE)


def fit(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "toxic", held: tuple[int, int] = (4, 2),
        examples: int = 3000, k: int = 15, share: float = 0.1) -> Model:
    """A model from the labels whose crc32(id) mod held[0] is not held[1].

    At most ``examples`` rows of each label, those with the smallest hashes of their ids;
    the votes are calibrated on at most 3000 of them, evenly taken.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark, "toxicity")
    key = F.col(id_).cast("string")
    own = labels.filter(F.col(id_).isNotNull() & F.col(label).isin(0, 1) & (F.pmod(F.crc32(key), F.lit(held[0])) != held[1]))
    own = own.groupBy(id_).agg(F.max(label).alias("y"))
    sizes = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    rate = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    chosen = [own.filter(F.col("y") == y).orderBy(F.xxhash64(id_), id_).limit(examples) for y in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * examples rows
    texts = docs.select(id_, text).join(sample, id_).select(F.col(id_).cast("long").alias("i"), F.col("y").cast("int"), F.col(text).alias("t"))
    texts = saved(texts.dropDuplicates(["i"]), f"{folder}/examples")
    seen = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    if not n0 or not n1:
        return Model(none := np.zeros(0, np.int64), none, [], none, none, none, none, rate, k, share)

    def count(batches):
        both: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for term in {x for w in _words(t) for x in word_terms(w)}:
                    both.setdefault(term, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"h": pa.array([term_key(t) for t in both], pa.int64()), "c0": pa.array([c[0] for c in both.values()], pa.int64()), "c1": pa.array([c[1] for c in both.values()], pa.int64())})

    table = texts.mapInArrow(released(count), "h long, c0 long, c1 long").groupBy("h").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    got = table.toArrow().sort_by("h")  # the terms of at most 2 * examples texts
    keys = got.column("h").to_numpy()
    weights = weighted(*(got.column(c).to_numpy().astype(np.float64) for c in ("c0", "c1")), n0, n1)
    del got
    shared = spark.sparkContext.broadcast(keys)

    def vectors(batches):
        memo = _Memo(dict(zip(shared.value.tolist(), range(len(shared.value)))))
        for b in batches:
            out = [_count_terms(t, memo) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(o) for o in out], pa.list_(pa.int32())), pa.array([list(o.values()) for o in out], pa.list_(pa.int32()))], ["i", "y", "t", "c"])

    rows = texts.mapInArrow(released(vectors), "i long, y int, t array<int>, c array<int>").toArrow().sort_by("i")  # at most 2 * examples
    shared.destroy()
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in rows.column(c).chunks])
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in rows.column("t").chunks])
    return Model(keys, weights, rows.column("i").to_pylist(), rows.column("y").to_numpy().astype(np.int64), sizes, flat("t"), flat("c"), rate, k, share)


def scored(docs: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", least: float = 0.3, held: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc id, held_out, score, predicted and the ids of the nearest examples of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples

    def run(batches):
        m = shared.value
        memo = _Memo(m.places())
        for b in batches:
            res = m.scores([_count_terms(t, memo) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in res], pa.float64()), pa.array([[m.ids[i] for _, i in near] for _, near in res], pa.list_(pa.int64()))], ["i", "score", "nearest"])

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("i"), F.col(text)).mapInArrow(released(run), f"i {kind}, score double, nearest array<long>")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("i").cast("string"), F.lit(""))), F.lit(held[0])) == held[1]
    return out.select(F.col("i").alias(id_), held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "nearest")
