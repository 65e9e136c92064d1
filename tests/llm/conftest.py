import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, found string, gone int, n string"
DATA = "/root/testdata/sf0.001"


def corpus(n: int = 90, seed: int = 3) -> list[tuple]:
    """Small texts with near and exact copies, repeated lines, long runs and edge cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnoprstuvwxyzé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [line(12) for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [line(r.randint(3, 25)) for _ in range(r.randint(1, 6))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), r.choice(shared).upper() if r.random() < 0.5 else "  " + r.choice(shared) + "\t")
        if r.random() < 0.2:
            lines += lines[:1]
        rows.append([i, "\n".join(lines)])
    for i in range(20):  # near and exact copies
        j = r.randrange(n)
        words = rows[j][1].split(" ")
        if i % 2 and len(words) > 30:
            words[r.randrange(len(words))] = "changed"
        rows.append([n + i, " ".join(words)])
    rows += [[200, None], [201, ""], [202, " \n\t "], [203, "x"], [204, "one two three"], [205, "one two three"], [206, "a" * 3000], [207, " ".join(shared[:3] * 3)], [208, " # $ % !! 12 éé 日本 <|endoftext|> don't  stop\r\n\r\nnow"],
             [209, "😀😀 שלום नमस्ते สวัสดี مرحبا ١٢٣ 𝒜𝒷 ⅷ <|endoftext|><|endoftext|> ꙮ don't " * 9], [210, "\n".join(line(20) for _ in range(1000))]]
    return [(i, t, "en" if i % 3 else None, "s1" if i % 2 else None, len(t or ""), True, "x", 1, "y") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in corpus()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def twice(docs):
    """Every row twice, and one with a null id."""
    null = docs.filter("doc_id = 3").withColumn("doc_id", docs["doc_id"] - docs["doc_id"]).selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    return docs.unionByName(docs).unionByName(null)
