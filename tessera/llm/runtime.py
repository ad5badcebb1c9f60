"""What the operators of this subpackage share: scratch tables, Arrow batch sizes and file systems.

Scratch data goes to the shared folder that the cluster names in ``spark.checkpoint.dir``. Only where
neither that setting nor a checkpoint folder exists, and the master is local, a temporary folder is made.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"  # fixed: a word is a run of anything but ASCII white space
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds and let local workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder, also set as the checkpoint folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and what is read is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(spark: SparkSession, *places: DataFrame | str) -> None:
    """Remove tables that ``stored`` gave, or scratch folders, which nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for place in places:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place if isinstance(place, str) else place.scratch_path)
        path.getFileSystem(conf).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI and the path in it; runs on executors."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return pafs.LocalFileSystem(), uri


def commit(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file to its final name. Attempts of one task write equal bytes, so a file that is there stays."""
    if fs.get_file_info(final).type == pafs.FileType.NotFound:
        fs.move(temporary, final)
    else:
        fs.delete_file(temporary)


def freed(run: Callable) -> Callable:
    """A function over batches that gives memory back when its input ends, as workers live on for other tasks."""

    def wrapped(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(found)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, joined, and the n + 1 offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, start = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[start : start + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ..., and each name's new one, so that no column clashes with an operator's own."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
