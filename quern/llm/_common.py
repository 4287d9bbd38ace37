"""What the operators of this subpackage share: table access, cut lineage, streamed groups."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder goes with the cluster's scratch space
        return


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read back: lineage ends here, so a lost executor
    costs no recomputation beyond this point. The files go when the session's driver ends, or by discard()."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose result has been written: it does so for plans that the driver's
    garbage collectors have found dead, and a quiet driver may not run them for hours."""
    for _ in range(2):  # the first round tells the JVM which of its objects Python has dropped
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Deletes what written() made; nothing may read it any more."""
    if path := getattr(df, "_quern_path", None):
        drop_path(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of df has it (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of rows with equal keys, from batches sorted by the keys, as numpy columns. Only one group and one batch
    are held. Keys hold no nulls. Yields a run of whole groups together with 'starts', the first row of each."""
    held: list[pa.RecordBatch] = []

    def cut(b: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def out(bs: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(bs).combine_chunks()
        cols = {n: t.column(n).to_numpy() for n in t.column_names}
        change = np.ones(t.num_rows, bool)
        change[1:] = False
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        return cols | {"starts": np.flatnonzero(change)}

    for b in batches:
        if not b.num_rows:
            continue
        at = cut(b)
        if held:
            first = {k: held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys}
            if any(b.column(b.schema.get_field_index(k))[0].as_py() != v for k, v in first.items()):
                at = np.concatenate([[0], at])
        if len(at):
            last = int(at[-1])
            whole = [*held, *([b.slice(0, last)] if last else [])]
            if whole:
                yield out(whole)
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield out(held)


def release() -> None:
    """Gives freed memory back to the machine; allocators would keep it, and a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with memory released between the batches it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> Iterator[pa.RecordBatch]:
            seen = 0
            for b in batches:
                seen += b.nbytes
                yield b
                del b
                if seen > 8 << 20:
                    release()
                    seen = 0

        yield from f(taken())
        release()

    return run


def binary_text(col: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit(b"").cast("binary"))


def slices(b: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of column `name` (binary without nulls); a longer value stands alone."""
    col = b.column(b.schema.get_field_index(name))
    ends = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in col]) if b.num_rows else np.zeros(0, int)
    at = 0
    while at < b.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield b.slice(at, to - at)
        at = to
