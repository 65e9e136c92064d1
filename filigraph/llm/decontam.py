"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the word sequences of the test items, in blocks of at
most ``block_words`` item words, so that what a task holds is bounded whatever the
size of the benchmark; texts pass every block in one go.  A text's words run
through the automaton, which gives the longest match that ends at each word.
Where a match reaches a window's length, the words of the window are hit, and the
state tells which items hold it.  Runs of words unknown to the items, and runs
shorter than the shortest window, are skipped.

A window is ``window`` consecutive words of an item; an item with fewer words, but
not none, is one window.

Edge cases: a null or empty text has no words and is clean; items without words
or without an id are never found (an id-less item still hits); equal items are all
found; an empty benchmark leaves everything clean; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_fn, packed, small_batches, unpacked

_WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.shortest = min((min(window, len(w)) for _, w in items), default=window)
        self.ids = [i for i, _ in items]
        owners: dict[int, set[int]] = {}
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        for k, (_, words) in enumerate(items):
            size = min(window, len(words))
            state, n = 0, 0
            for w in words:
                state, n = self.follow(state, n, self.vocabulary[w])
                if n >= size:
                    owners.setdefault(self._cut(state, size), set()).add((k, size))
        # what a state tells of its own suffixes: (size, item) of windows at itself and its links
        self.told: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = owners.get(s)
            above = self.told[self.link[s]]
            self.told[s] = (*above, *sorted(((size, k) for k, size in own))) if own else above

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def follow(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, n + 1)

    def _cut(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, numbers: list[int], hit: np.ndarray, found: set, offset: int) -> int:
        """Mark the words of window occurrences; returns the longest match."""
        state = n = longest = 0
        for i, c in enumerate(numbers):
            state, n = self.follow(state, n, c)
            longest = max(longest, n)
            told = self.told[state]
            if told and n >= told[0][0]:
                size = 0
                for s, k in told:
                    if s <= n:
                        found.add(k)
                        size = max(size, s)
                hit[offset + i + 1 - size : offset + i + 1] = True
        return longest


class Detector:
    """The automata of all blocks, over one vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, block_words: int):
        self.automata: list[Automaton] = []
        block, size = [], 0
        for i, text in items:
            w = item_words(text)
            if not w:
                continue
            if block and size + len(w) > block_words:
                self.automata.append(Automaton(block, window))
                block, size = [], 0
            block.append((i, w))
            size += len(w)
        if block:
            self.automata.append(Automaton(block, window))

    def look(self, words: list[bytes]) -> tuple[np.ndarray, list[str], int]:
        """Hit words, found items, longest match."""
        hit, ids, longest = np.zeros(len(words), bool), set(), 0
        for a in self.automata:
            get = a.vocabulary.get
            numbers = np.array([get(w, -1) for w in words], np.int64)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]])))
            start, end = edge[::2], edge[1::2]
            found: set[int] = set()
            for s, e in zip(start, end):
                if e - s >= a.shortest:
                    longest = max(longest, a.scan(numbers[s:e].tolist(), hit, found, int(s)))
            ids.update(a.ids[k] for k in found if a.ids[k] is not None)
        return hit, sorted(ids), longest


def _loaded(benchmark: DataFrame, id_: str, text: str, window: int, block_words: int, most_words: int) -> list[list]:
    """The items in groups that a task can hold: each becomes one broadcast."""
    rows = benchmark.select(F.col(id_).cast("string"), F.col(text)).orderBy(F.col(id_).cast("string"), text)
    groups, group, size = [], [], 0
    for r in rows.toLocalIterator():
        n = len(r[1] or "") // 4 + 1
        if group and size + n > most_words:
            groups.append(group)
            group, size = [], 0
        group.append((r[0], r[1]))
        size += n
    return [*groups, group] if group else groups


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
           window: int = 10, block_words: int = 200_000, most_words: int = 1_000_000) -> DataFrame:
    """All columns of ``docs`` and ``found``: n_words, n_hit, longest, items, spans of hit words (byte offsets).

    A benchmark of over ``most_words`` words is passed in several runs over the texts,
    whose findings are merged text by text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = "n_words long, hits array<struct<a:int,b:int>>, longest long, items array<string>"
    struct = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("longest", pa.int64()), ("items", pa.list_(pa.string()))])

    def finder(items: list):
        shared = spark.sparkContext.broadcast(items)  # at most most_words words
        made: list[Detector] = []

        def find(t: pa.Array) -> pa.Array:
            if not made:
                made.append(_detector(shared, window, block_words))
            out = []
            for x in t.to_pylist():
                w = item_words(x)
                hit, ids, longest = made[0].look(w) if w else (np.zeros(0, bool), [], 0)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                out.append({"n_words": len(w), "hits": [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])], "longest": longest, "items": ids})
            return pa.array(out, struct)

        return arrow_fn(find, kind)

    groups = _loaded(benchmark, item_id, item_text, window, block_words, most_words) or [[]]
    need = {"_text": text}
    if len(groups) == 1:  # as a rule: one function finds and places
        shared = spark.sparkContext.broadcast(groups[0])  # at most most_words words
        made: list[Detector] = []

        def mark(t: pa.Array) -> pa.Array:
            if not made:
                made.append(_detector(shared, window, block_words))
            res = []
            for x in t.to_pylist():
                w = item_words(x)
                hit, ids, longest = made[0].look(w) if w else (np.zeros(0, bool), [], 0)
                res.append({"n_words": len(w), "n_hit": int(hit.sum()), "longest": longest, "items": ids, "spans": _spans(x, hit)})
            return pa.array(res, _FOUND)

        out = packed(docs, **need)
        return unpacked(out.withColumn("_found", arrow_fn(mark, _FOUND_DDL)(F.col("_text"))), docs.columns, need, found=F.col("_found"))
    parts = [finder(g)(F.col("_text")) for g in groups]
    out = packed(docs, **need).withColumns({f"_f{k}": p for k, p in enumerate(parts)})
    names = [f"_f{k}" for k in range(len(parts))]

    def spans(fs: list[pa.Array], t: pa.Array) -> pa.Array:
        res = []
        for x, *each in zip(t.to_pylist(), *[f.to_pylist() for f in fs]):
            hit = np.zeros(each[0]["n_words"], bool)
            for e in each:
                for h in e["hits"]:
                    hit[h["a"] : h["b"]] = True
            res.append({"n_words": len(hit), "n_hit": int(hit.sum()), "longest": max(e["longest"] for e in each), "items": sorted({i for e in each for i in e["items"]}), "spans": _spans(x, hit)})
        return pa.array(res, _FOUND)

    merge = arrow_fn(_last_first(spans, len(names)), _FOUND_DDL)
    out = out.withColumn("_found", merge(*[F.col(n) for n in names], F.col("_text")))
    return unpacked(out, docs.columns, need, found=F.col("_found"))


_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])))])
_FOUND_DDL = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<start:long,end:long,words:long>>"


def _spans(text: str | None, hit: np.ndarray) -> list[dict]:
    """Runs of hit words, by byte offsets."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    if not len(edge):
        return []
    place = [m.span() for m in _WORD.finditer((text or "").encode().translate(_WORD_BYTES))]
    return [{"start": place[a][0], "end": place[b - 1][1], "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


def _last_first(f, n: int):
    def call(*args: pa.Array) -> pa.Array:
        return f(list(args[:n]), args[n])

    call.__annotations__ = {"args": pa.Array, "return": pa.Array}
    return call


_MADE: dict = {}


def _detector(shared, window: int, block_words: int) -> Detector:
    """The worker's own automata of a broadcast, built once."""
    key = hashlib.sha256(repr((shared.value, window, block_words)).encode()).digest()
    if key not in _MADE:
        if len(_MADE) > 3:
            _MADE.clear()
        _MADE[key] = Detector(shared.value, window, block_words)
    return _MADE[key]


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_words: int = 10, coverage: float = 0.5, **how) -> DataFrame:
    """``docs`` with hit spans of at least ``least_words`` words cut out; texts hit in over ``coverage`` of their words go.

    Spans shorter than ``least_words`` (whole items of fewer words) are cut too where
    they make up over half of the coverage limit.
    """
    need = {"_text": text}
    out = marked(packed(docs, **need), benchmark, "_text", **how)

    long_enough = lambda x: (x["words"] >= least_words) | (F.col("found.n_hit") > coverage / 2 * F.col("found.n_words"))
    raw, start = F.encode("_text", "UTF-8"), F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    cut = F.aggregate(F.filter("found.spans", long_enough), start, lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))).alias("out")))
    rest = F.transform(F.array(cut), lambda a: F.decode(F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), F.length(raw))), "UTF-8"))[0]
    out = out.filter(F.col("found.n_hit") <= coverage * F.col("found.n_words"))
    out = out.withColumn("_text", F.when(F.size("found.spans") > 0, rest).otherwise(F.col("_text")))
    return unpacked(out, docs.columns, need)


def digests(docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id") -> DataFrame:
    f = F.col("found")
    out = marked(docs.select(id_, "text"), benchmark)
    return out.select(id_, f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"), f["longest"].alias("longest"))


def filtered(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: test passages cut out, documents made up of them dropped."""
    out = cleaned(docs, benchmark)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
