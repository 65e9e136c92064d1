"""Token counts by the whole-token shortcut.

``prove`` finds, once per vocabulary file, the vocabulary strings that the
library itself encodes alone as one token and that the pre-tokeniser's pattern
leaves in one piece.  Texts are then cut into pre-tokens; those in the proven set
count one each, only the rest is merged (by the library's own model, with a
bounded memo).  Special strings in a text count one each and cut it in parts, as
in the library; texts with a character outside the range in which the two pattern
engines were compared are cut by the library's own pre-tokeniser.

Edge cases: a null or empty text has no bytes and no tokens; repeated rows are
counted alike; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BPE_FAST, BPE_PATTERN, BPE_RARE, released, small_batches

MEMO = 100_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def prove(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and one token."""
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    back = {c: b for b, c in _byte_chars().items()}
    pattern = regex.compile(BPE_PATTERN)
    texts = []
    for s in t.get_vocab(with_added_tokens=False):
        try:
            x = bytes(back[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not text on its own
        if pattern.findall(x) == [x]:
            texts.append(x)
    return frozenset(x for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


@functools.lru_cache(2)
def _counter(path: str):
    """The worker's own counting function."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    singles = _PROVEN.get(path) or prove(path)
    chars = str.maketrans({chr(b): c for b, c in _byte_chars().items()})
    cut, rare = re.compile(BPE_FAST).findall, re.compile(BPE_RARE).search
    added = t.get_added_tokens_decoder().values()
    if any(a.lstrip or a.rstrip or a.single_word for a in added) or t.normalizer is not None:
        raise ValueError("a vocabulary with added tokens that take their surroundings, or with a normaliser")
    special = re.compile("|".join(re.escape(a.content) for a in sorted(added, key=lambda a: -len(a.content))) or "(?!)")
    model, own_cut = t.model, t.pre_tokenizer.pre_tokenize_str

    class Memo(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) > len(singles) + MEMO:
                self.clear()
                self.update(dict.fromkeys(singles, 1))
            n = self[piece] = len(model.tokenize(piece.encode().decode("latin-1").translate(chars)))
            return n

    memo = Memo.fromkeys(singles, 1)
    shown = {c: chr(b) for b, c in _byte_chars().items()}
    back = str.maketrans(shown)

    def part(text: str) -> int:
        if rare(text):  # the pieces come in the printable stand-ins of their bytes
            return sum(memo[p.translate(back).encode("latin-1").decode()] for p, _ in own_cut(text))
        return sum(map(memo.__getitem__, cut(text)))

    def count(text: str) -> int:
        if not text:
            return 0
        parts = special.split(text)
        return len(parts) - 1 + sum(part(x) for x in parts if x)

    return count


_PROVEN: dict[str, frozenset[str]] = {}


def counted(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc id, n_bytes, n_tokens, over_limit of every row. ``path``: a byte-level vocabulary of the tokenizers library."""
    spark = docs.sparkSession
    small_batches(spark)
    singles = spark.sparkContext.broadcast(prove(path))  # bounded by the vocabulary

    def run(batches):
        _PROVEN.setdefault(path, singles.value)
        count = _counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.fromiter((count(t) for t in texts), np.int64, len(texts))
            size = pa.array([0 if t is None else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["i", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("i"), F.col(text)).mapInArrow(released(run), f"i {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("i", id_)
