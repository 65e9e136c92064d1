"""What every operator needs of a session: the package on the workers, and shared work folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="filigraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/filigraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def is_local(uri: str) -> bool:
    return uri.startswith("file:") or "://" not in uri


def local_path(uri: str) -> str:
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under its final name in one step, so that a retried task is harmless."""
    if is_local(uri):
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file of the shared folder: memory-mapped where it is mounted, read otherwise."""
    if is_local(uri):
        path = local_path(uri)
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder; removed at exit where it is a local path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='filigraph-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
    uri = f"{base.rstrip('/')}/filigraph/{name}-{uuid.uuid4().hex}"
    if is_local(uri):
        atexit.register(shutil.rmtree, local_path(uri), ignore_errors=True)
    return uri


def saved(df: DataFrame, uri: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
