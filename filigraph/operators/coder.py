"""The list coder: for each vertex the cheapest of its modes and encodings, in chunks with random access.

A chunk holds consecutive vertices.  Each vertex's record is a header, references,
and what is left of its list:

* modes: empty; none; one reference (copied places of a list up to ``window``
  vertices back in the chunk, then what is left); two references.
* encodings of what is left: gaps with stop bits, gap runs, intervals of at least 2
  to 5 (the rest in one list, or in two about the vertex).

Headers are prefix codes, short for what is common.  Costs are exact: candidates
are written.  Chunks are coded and decoded in parallel; a chunk carries the bit
offset of every record, so that a lookup reads one record and those it refers to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.codes import Bits, read, write
from ..graph import Graph

#: (references, encoding): prefix code.  Kraft's sum is 1.
HEADERS = {(1, "gaps"): "0", (0, "gaps"): "10", "empty": "110", (1, "sides2"): "111000", (0, "sides2"): "111001", (1, "interval4"): "111010",
           (0, "interval4"): "111011", (2, "gaps"): "1111000", (0, "runs"): "1111001", (1, "runs"): "1111010", (0, "interval3"): "1111011",
           (1, "interval3"): "1111100", (2, "interval4"): "1111101", (2, "runs"): "11111100", (0, "sides4"): "11111101", (1, "sides4"): "11111110",
           (0, "interval5"): "111111110", (1, "interval5"): "1111111110", (2, "sides2"): "1111111111"}
_BY_WORD = {w: h for h, w in HEADERS.items()}
ENCODINGS = tuple(dict.fromkeys(h[1] for h in HEADERS if h != "empty"))


@dataclass(frozen=True)
class Options:
    """How a graph is coded; the first candidates are tried only where they can pay."""

    code: str = "zeta"
    window: int = 16
    chunk: int = 256
    references: int = 2  # at most
    candidates: int = 6  # references tried, by overlap; the nearer first among equals
    least_second: int = 6  # shortest list that a second reference is tried for


def header(w: Bits, mode) -> None:
    word = HEADERS[mode]
    w.put(int(word, 2), len(word))


def read_header(r: Bits):
    word = ""
    while word not in _BY_WORD:
        word += str(r.take(1))
    return _BY_WORD[word]


def write_rest(w: Bits, xs: list[int], how: str, code: str, near: int) -> None:
    if how == "gaps":
        lists.write_stop(w, xs, code, near)
    elif how == "runs":
        lists.write_runs(w, xs, code, near)
    else:
        lists.write_intervals(w, xs, code, int(how[-1]), near, how.startswith("sides"))


def read_rest(r: Bits, how: str, code: str, near: int) -> list[int]:
    if how == "gaps":
        return lists.read_stop(r, code, near)
    if how == "runs":
        return lists.read_runs(r, code, near)
    return lists.read_intervals(r, code, int(how[-1]), near, how.startswith("sides"))


def _referred(xs: list[int], refs: list[tuple[int, list[int]]]) -> tuple[Bits, Bits, list[int]]:
    """The reference and copy parts of a record, and what is left of the list."""
    reference, copy, left = Bits(), Bits(), xs
    for d, ref in refs:
        write(reference, d, "gamma")
        copied, left = lists.split_reference(left, ref)
        lists.write_copy(copy, copied, "gamma")
    return reference, copy, left


def record(v: int, xs: list[int], past: list[list[int]], o: Options) -> tuple[dict[str, Bits], tuple]:
    """The cheapest record of a list and its mode; ``past``: the chunk's lists before it."""
    if not xs:
        w = Bits()
        header(w, "empty")
        return {"header": w}, ("empty",)
    own = set(xs)
    near = [(d, past[-d]) for d in range(1, min(o.window, len(past)) + 1)]
    overlap = sorted(((-len(own.intersection(ref)), d, ref) for d, ref in near if not own.isdisjoint(ref)), key=lambda x: x[:2])[: o.candidates]
    choices: list[list[tuple[int, list[int]]]] = [[], *[[(d, ref)] for _, d, ref in overlap]]
    if o.references > 1 and len(xs) >= o.least_second:
        for _, d, ref in overlap[:2]:
            left = own - set(ref)
            second = max(((len(left.intersection(r2)), -e, r2) for e, r2 in near if e != d), key=lambda x: x[:2], default=(0, 0, []))
            if len(left) >= 3 and second[0] >= 3:
                choices.append([(d, ref), (-second[1], second[2])])
    best = None
    for refs in choices:
        reference, copy, left = _referred(xs, refs)
        for how in ENCODINGS:
            mode = len(refs), how
            if mode not in HEADERS or best and len(reference) + len(copy) + len(HEADERS[mode]) >= best[0]:
                continue
            rest = Bits()
            write_rest(rest, left, how, o.code, v)
            size = len(HEADERS[mode]) + len(reference) + len(copy) + len(rest)
            if best is None or size < best[0]:
                best = size, {"reference": reference, "copy": copy, "rest": rest}, mode
    w = Bits()
    header(w, best[2])
    return {"header": w, **best[1]}, best[2]


def encode(first: int, rows: list[list[int]], o: Options = Options()) -> tuple[bytes, list[int], list[tuple]]:
    """Bits, each record's offset, and for each record (mode, bits by part)."""
    out, offsets, chosen = Bits(), [], []
    for k, xs in enumerate(rows):
        offsets.append(len(out))
        parts, mode = record(first + k, xs, rows[max(0, k - o.window) : k], o)
        for b in parts.values():
            out.extend(b)
        chosen.append((mode, {k: len(b) for k, b in parts.items()}))
    return out.bytes(), offsets, chosen


def _one(r: Bits, first: int, k: int, code: str, before: Callable[[int], list[int]]) -> list[int]:
    mode = read_header(r)
    if mode == "empty":
        return []
    got: list[int] = []
    refs, how = mode
    # references come first, then their copied places: the second copies from what the first has left
    distances = [read(r, "gamma") for _ in range(refs)]
    for d in distances:
        ref = before(k - d)
        got += [x for x, c in zip(ref, lists.read_copy(r, len(ref), "gamma")) if c]
    return sorted([*got, *read_rest(r, how, code, first + k)])


def decode(data: bytes, first: int, n: int, code: str = "zeta") -> list[list[int]]:
    """All lists of a chunk, in turn."""
    r, out = Bits(data), []
    for k in range(n):
        out.append(_one(r, first, k, code, out.__getitem__))
    return out


def lookup(data: bytes, offsets: list[int], first: int, v: int, code: str = "zeta") -> list[int]:
    """One list, by reading its record and those it refers to."""
    r, known = Bits(data), {}

    def get(k: int) -> list[int]:
        if k not in known:
            at, r.at = r.at, offsets[k]
            known[k] = _one(r, first, k, code, get)
            r.at = at
        return known[k]

    return get(v - first)


# graphs ------------------------------------------------------------------------------------


def _grouped(g: Graph, o: Options, run: Callable, schema: str) -> DataFrame:
    edges = g.edges.select("src", "dst").unionByName(g.vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")))
    return edges.withColumn("chunk", F.floor(F.col("src") / o.chunk)).groupBy("chunk").applyInPandas(run, schema)


def _rows(pdf, o: Options) -> tuple[int, list[list[int]]]:
    first = int(pdf.chunk.iloc[0]) * o.chunk
    rows: list[list[int]] = [[] for _ in range(int(pdf.src.max()) - first + 1)]
    for s, d in zip(pdf.src.tolist(), pdf.dst.tolist()):
        if d == d:
            rows[s - first].append(int(d))
    return first, [sorted(set(x)) for x in rows]


def encoded(g: Graph, o: Options = Options()) -> DataFrame:
    """(chunk, first, n, m, data, offsets) of dense ids from 0; missing ids are empty lists."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, rows = _rows(pdf, o)
        data, offsets, _ = encode(first, rows, o)
        return pd.DataFrame({"chunk": [int(pdf.chunk.iloc[0])], "first": [first], "n": [len(rows)], "m": [sum(map(len, rows))], "data": [data], "offsets": [offsets]})

    return _grouped(g, o, run, "chunk long, first long, n long, m long, data binary, offsets array<long>")


def decoded(chunks: DataFrame, o: Options = Options()) -> DataFrame:
    """(src, dst): all links of the chunks given."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            pairs = [(f + k, x) for f, n, d in zip(pdf["first"], pdf["n"], pdf["data"]) for k, xs in enumerate(decode(d, int(f), int(n), o.code)) for x in xs]
            yield pd.DataFrame(pairs, columns=["src", "dst"], dtype="int64")

    return chunks.select("first", "n", "data").mapInPandas(run, "src long, dst long")


def neighbours(chunks: DataFrame, ids: DataFrame, o: Options = Options()) -> DataFrame:
    """(id, nbrs) of ``ids(id)``: their chunks only are read, and of those the records needed."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "nbrs": [lookup(d, list(map(int, at)), int(f), int(v), o.code) if v - f < len(at) else [] for v, f, d, at in zip(pdf["id"], pdf["first"], pdf["data"], pdf["offsets"])]})

    wanted = ids.select("id").distinct().withColumn("chunk", F.floor(F.col("id") / o.chunk))
    return wanted.join(chunks, "chunk").select("id", "first", "data", "offsets").mapInPandas(run, "id long, nbrs array<long>")


def budget(g: Graph, o: Options = Options()) -> DataFrame:
    """(mode, encoding, records, header, reference, copy, rest): bits by component of the coded graph."""
    import pandas as pd

    names = ["header", "reference", "copy", "rest"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, rows = _rows(pdf, o)
        out = [(str(m[0]), m[1] if len(m) > 1 else "", *[b.get(k, 0) for k in names]) for m, b in encode(first, rows, o)[2]]
        return pd.DataFrame(out, columns=["mode", "encoding", *names])

    x = _grouped(g, o, run, "mode string, encoding string, " + ", ".join(f"{k} long" for k in names))
    return x.groupBy("mode", "encoding").agg(F.count(F.lit(1)).alias("records"), *[F.sum(k).alias(k) for k in names])


def entropy_coded(g: Graph, chunk: int = 256) -> DataFrame:
    """(chunk, first, n, data): lists as adaptively range-coded degrees and gaps, by chunk."""
    import pandas as pd

    from ..functions import entropy

    o = Options(chunk=chunk)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, rows = _rows(pdf, o)
        e = entropy.NumberEncoder()
        for k, xs in enumerate(rows):
            e.contexts.reset()
            e.put(len(xs))
            for j, x in enumerate(xs):
                e.put(x - xs[j - 1] - 1 if j else lists.zigzag(x - first - k))
        return pd.DataFrame({"chunk": [int(pdf.chunk.iloc[0])], "first": [first], "n": [len(rows)], "data": [e.finish()]})

    return _grouped(g, o, run, "chunk long, first long, n long, data binary")


def entropy_decoded(chunks: DataFrame) -> DataFrame:
    """(src, dst) of range-coded chunks."""
    import pandas as pd

    from ..functions import entropy

    def run(batches):
        for pdf in batches:
            pairs = []
            for first, n, data in zip(pdf["first"], pdf["n"], pdf["data"]):
                d = entropy.NumberDecoder(data)
                for k in range(int(n)):
                    d.contexts.reset()
                    x = 0
                    for j in range(d.take()):
                        x = x + 1 + d.take() if j else int(first) + k + lists.unzigzag(d.take())
                        pairs.append((int(first) + k, x))
            yield pd.DataFrame(pairs, columns=["src", "dst"], dtype="int64")

    return chunks.select("first", "n", "data").mapInPandas(run, "src long, dst long")


def huffman_coded(g: Graph) -> DataFrame:
    """(src, bits): every vertex's targets as Huffman code words by in-degree, as a text of bits.

    The tree is made over degree classes' members, so it needs one row a target on the
    driver: for graphs whose targets are few (``huffman_bits`` gives sizes for any graph).
    """
    from ..functions import entropy

    weights = {int(r.id): int(r.in_degree) for r in g.in_degrees().filter("in_degree > 0").collect()}
    words = entropy.huffman_codes(entropy.huffman_tree(weights))
    table = g.edges.sparkSession.createDataFrame(list(words.items()), "dst long, word string")
    each = g.edges.join(table, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "word"))).alias("x"))
    return each.select("src", F.array_join(F.transform("x", lambda t: t["word"]), "").alias("bits"))
