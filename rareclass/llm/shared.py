"""Files and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rareclass.llm.words import slices
from rareclass.session import checkpoint_folder


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of this session hold about ``size`` bytes at most, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path of a mounted folder; None when the folder is only reachable through a client library."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """One array per file. The rename is atomic and a retried task writes equal bytes, so attempts cannot clash."""
    path = local_path(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
        np.save(part, values)
        os.replace(part, f"{path}/{name}.npy")
        return
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}.npy"
    with store.open_output_stream(part) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(values), allow_pickle=False)
    store.move(part, f"{base}/{name}.npy")


def map_array(folder: str, name: str) -> np.ndarray:
    """Memory-map a saved array. From a store without a mount it is copied to an unlinked local file first."""
    path = local_path(folder)
    if path is not None:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    handle, copy = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, store.open_input_stream(f"{base}/{name}.npy") as source:
            while block := source.read(1 << 22):
                out.write(block)
        return np.load(copy, mmap_mode="r")
    finally:
        os.unlink(copy)


def annotated(docs: DataFrame, fields: list[T.StructField], judge: Callable[[list], list[pa.Array]], budget: int = 1 << 20) -> DataFrame:
    """All columns of ``docs`` and those that ``judge`` makes from a list of its texts; rows never leave their partition.

    ``judge`` sees about ``budget`` characters at a time, not a whole Arrow batch; a longer text stands alone.
    """
    bounded_batches(docs.sparkSession)
    names = [*docs.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts], budget):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *judge(texts[a:b])], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
