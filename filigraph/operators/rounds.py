"""Rounds over the vertices of a graph whose adjacency lies in blocks: a round reads the blocks and one number a vertex, and shuffles nothing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..runtime import map_file, put_file, work_dir
from .overlap import ROW_BLOCK, _block, _blocks


class Rounds:
    """``edges(src, dst)``: each source's ties in files of about ``ROW_BLOCK`` ties; the numbers of all vertices are held by each task."""

    def __init__(self, edges: DataFrame, name: str):
        self.spark = edges.sparkSession
        self.folder, self.runs = work_dir(self.spark, name), 0
        self.files = _blocks(edges, "src", "dst", ROW_BLOCK, self.spark.sparkContext.defaultParallelism, False)

    def _run(self, f: Callable, schema: str) -> DataFrame:
        def run(batches):
            for b in batches:
                for k in b["id"].to_pylist():
                    yield from f(k)

        n = len(self.files)
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)

    def run(self, first: Callable, step: Callable, most: int, settled: Callable = lambda k, changed: not changed, strict: bool = True, places: bool = False) -> DataFrame:
        """(id, value) after rounds of ``step(ids, sizes, ties, values, own, k)``, which gives a block's new values.

        ``first(ids, sizes, at)`` are the values before, ``at`` the place of the first id; ``ties``: the places of the
        ties' ends in ``values``; ``own``: the block's slice of them.  It ends where ``settled(k, changed)``, or after
        ``most`` rounds, which is an error if ``strict``.  ``places``: the values are places of ids, and given as ids.
        """
        self.runs += 1
        files, folder = self.files, f"{self.folder}/{self.runs}"

        def start(k):
            import pyarrow as pa

            ids, sizes, items, _ = _block(files[k])
            parts = [_ids(f) for f in files]
            every, at = np.concatenate(parts), sum(map(len, parts[:k]))
            put_file(f"{folder}/ties{k}", np.searchsorted(every, items).astype(np.int32 if len(every) < 1 << 31 else np.int64).tobytes())
            put_file(f"{folder}/0_{k}", first(ids, sizes, at).astype(np.int64).tobytes())
            yield pa.record_batch({"n": pa.array([len(ids)], pa.int64())})

        counts = [r.n for r in self._run(start, "n long").collect()]
        wide = 4 if sum(counts) < 1 << 31 else 8

        def turn(r):
            def go(k):
                import pyarrow as pa

                ids, sizes, _, _ = _block(files[k])
                parts = [np.asarray(map_file(f"{folder}/{r}_{j}")).view(np.int64) for j in range(len(files))]
                at = sum(map(len, parts[:k]))
                own = slice(at, at + len(ids))
                new = step(ids, sizes, np.asarray(map_file(f"{folder}/ties{k}")).view(np.int32 if wide == 4 else np.int64), np.concatenate(parts), own, r)
                put_file(f"{folder}/{r + 1}_{k}", new.astype(np.int64).tobytes())
                yield pa.record_batch({"n": pa.array([int((new != parts[k]).sum())], pa.int64())})

            return go

        r = -1
        for r in range(most if files else 0):
            if settled(r, sum(x.n for x in self._run(turn(r), "n long").collect())):
                break
        else:
            if strict:
                raise RuntimeError(f"values did not settle in {most} rounds")

        def last(k):
            import pyarrow as pa

            ids, values = _ids(files[k]), np.asarray(map_file(f"{folder}/{r + 1}_{k}")).view(np.int64)
            if places:
                values = np.concatenate([_ids(f) for f in files])[values]
            for at in range(0, len(ids), 1 << 16):
                yield pa.record_batch({"id": ids[at : at + (1 << 16)], "value": values[at : at + (1 << 16)]})

        return self._run(last, "id long, value long")


def _ids(name: str) -> np.ndarray:
    raw = map_file(name)
    return np.asarray(raw[16 : 16 + 8 * int(raw[:8].view(np.int64)[0])]).view(np.int64)
