"""What the operators share: the shared folder, Arrow mapping that keeps the caller's columns, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts of at most so many characters are handed to a Python function at a time; a longer text goes alone.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, as in tests on one machine, a folder of our own is set as Spark's checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="runeflow-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return os.path.dirname(sc.getCheckpointDir())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/runeflow-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there, and lost executors cost nothing that is done."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for small frames in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; matching is case-insensitive as in Spark, other columns of any name are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(texts: Sequence[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def let_go() -> None:
    """What a task held goes back to the system: a worker lives on after its task, beside the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def append_columns(df: DataFrame, text_col: str, fields: Sequence[tuple[str, T.DataType]], make: Callable[[], Callable[[list], Sequence]], carry: Sequence[str] | None = None, most: int = SLICE_CHARS) -> DataFrame:
    """``df`` with one output column a field, computed from the whole texts by ``make()(texts)``.

    ``make`` runs once in each Python worker and returns a function from a list of texts (nulls already empty) to one
    list or Arrow array a field. ``carry`` names the columns to keep (all by default); a kept column whose name clashes
    with an output is replaced by the output. Memory is bounded by the slices of ``most`` characters, whatever the batch.
    """
    made = {name.lower() for name, _ in fields}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in made]
    text_at = len(kept)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))  # read by place, so its name may clash
    schema = T.StructType([source.schema[c] for c in source.columns[:text_at]] + [T.StructField(n, t) for n, t in fields])
    types = [to_arrow_type(t) for _, t in fields]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 100)  # tables of millions of small objects are no garbage
        fn = None
        try:
            for batch in batches:
                if fn is None:
                    fn = make()
                texts = [t or "" for t in batch.column(text_at).to_pylist()]
                for a, b in slices(texts, most):
                    out = fn(texts[a:b])
                    cols = [batch.column(k).slice(a, b - a) for k in range(text_at)]
                    cols += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=t) for x, t in zip(out, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:  # a worker lives on after its task; what the task held must not
            fn = None
            let_go()

    return source.mapInArrow(run, schema)
