"""Helpers shared by the corpus operators: shared work folders, Arrow text access, tokens."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import is_local, local_path, map_file, put_file, saved, ship, work_dir  # noqa: F401 (the operators take them from here)

#: ASCII white space as the operators define it: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()
#: The pattern that cuts text into words before byte-level BPE merges.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond those that pattern engines of different Unicode versions agree on (a test compares all of them).
BPE_RARE = r"[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3]"
# The pattern's classes within those characters, spelt out for the standard engine, which is over twice as fast.
_LETTERS = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02c1\u02c6-\u02d1\u02e0-\u02e4\u02ec\u02ee\u0370-\u0374\u0376-\u0377\u037a-\u037d\u037f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03f5\u03f7-\u0481\u048a-\u052f\u0531-\u0556\u2102\u2107\u210a-\u2113\u2115\u2119-\u211d\u2124\u2126\u2128\u212a-\u212d\u212f-\u2139\u213c-\u213f\u2145-\u2149\u214e\u3005-\u3006\u3031-\u3035\u303b-\u303c\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u4e00-\u9fef\uac00-\ud7a3"
_NUMBERS = r"0-9\u00b2-\u00b3\u00b9\u00bc-\u00be\u3007\u3021-\u3029\u3038-\u303a"
_SPACES = r"\u0009-\u000d\u0020\u0085\u00a0\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000"


def bpe_pattern(letters: str, numbers: str, spaces: str) -> str:
    """The pattern with its classes spelt out."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


BPE_FAST = bpe_pattern(_LETTERS, _NUMBERS, _SPACES)
#: Stands for a missing document id when the smallest id is sought: it sorts last.
NO_ID = 2**63 - 1
#: Rows a broadcast side may have; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Ship the package to the workers, and bound what one Arrow batch of texts holds."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


#: Holds the columns that an operator passes through, so that none can clash with its own.
ROW = "__row"


def packed(docs: DataFrame, **need: str | None) -> DataFrame:
    """``need`` maps an operator's own names to columns of ``docs`` (None: null text); all other columns ride in one struct."""
    rest = [c for c in docs.columns if c not in need.values()]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)
    return docs.select(row.alias(ROW), *[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in need.items()])


def unpacked(df: DataFrame, columns: list[str], need: dict[str, str | None], **new) -> DataFrame:
    """The columns of the packed table again, in their order, and ``new`` ones; a new one replaces its namesake."""
    own = {c: k for k, c in need.items()}
    old = [(new[c] if c in new else F.col(own[c]) if c in own else F.col(f"{ROW}.`{c}`")).alias(c) for c in columns]
    return df.select(*old, *[v.alias(k) for k, v in new.items() if k not in columns])


def release() -> None:
    """Give freed memory back to the system: workers are reused, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """A function for ``mapInArrow`` that releases memory at a task's end."""

    @functools.wraps(run)
    def call(batches):
        yield from run(batches)
        release()

    return call


def arrow_fn(f, kind: str):
    """An Arrow function that the optimiser neither repeats nor moves, as it would a cheap one."""
    calls = [0]

    @functools.wraps(f)
    def call(*args):
        out = f(*args)
        calls[0] += 1
        if calls[0] % 4 == 0:
            release()
        return out

    return F.arrow_udf(call, kind).asNondeterministic()


def heavy_split_join(left: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with one row per key; keys that hold over 1/500 of ``total`` rows are broadcast.

    At most 500 keys can hold so many rows, so the broadcast is bounded whatever
    the input; all other groups are small against the input and shuffle.
    ``counts``: a written table with the counts of all keys.  Where it has no such
    key the join is a plain one, which spares the driver two broadcasts.
    """
    limit = max(1000, total // 500)
    if counts is not None and not counts.filter(F.col(count) > limit).limit(1).count():
        return left.join(keys, on)
    heavy = F.broadcast(keys.filter(F.col(count) > limit))
    light = keys.filter(F.col(count) <= limit)
    rest = left.join(F.broadcast(keys.filter(F.col(count) > limit).select(*on)), on, "left_anti")
    return left.join(heavy, on).unionByName(rest.join(light, on))


def strings(column: pa.Array) -> pa.StringArray:
    """A text column with 32-bit offsets and nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (one more than texts)."""
    a = strings(column)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, lower: bool = True) -> tuple[pa.StringArray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and the offsets of each text's words."""
    a = strings(column)
    split = pc.ascii_split_whitespace(pc.ascii_lower(a) if lower else a)
    at = np.asarray(split.offsets).astype(np.int64)
    flat = split.values.slice(at[0], at[-1] - at[0])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).cast(pa.uint8()))
    before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    if not full.all():
        flat = flat.filter(pa.array(full.astype(bool)))
    return flat, before[at - at[0]]


def word_hashes(flat: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word, computed once per distinct word."""
    import xxhash

    d = flat.dictionary_encode()
    values = d.dictionary.to_pylist()
    one = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))
    return one[np.asarray(d.indices)] if len(flat) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over an array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def crc_of_id(ids: pa.Array) -> np.ndarray:
    """crc32 of each document id written in decimal; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()], np.int64)
