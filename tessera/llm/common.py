"""What the operators share: the shared folder, words, and the division of rows by key."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at which a text is cut into words: space and the controls from tab to carriage return.
ASCII_SPACE = "\\x20\\x09-\\x0D"


#: Bytes of rows that Python workers take at a time, where the session doesn't say otherwise. Texts differ in length by
#: four orders of magnitude, so that a number of rows bounds no memory.
ARROW_BYTES = 4 << 20
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset and all
    executors are on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/tessera"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which need not have it installed; once for each context.

    The driver serves the archive for as long as it lives; only the driver reads the file.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    pack = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(pack, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(pack))
    sc._tessera_shipped = True


def _tidy() -> None:
    """Give back to the system what a task has freed: workers are used again, and Spark counts on their memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow on workers that have this package, in batches of ARROW_BYTES."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_ARROW_KEY, None) in _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _tidy()

    return df.mapInArrow(tidied, schema)


#: Paths of tables by who is to delete them; the last list takes new ones.
_OWNERS: list[list[str]] = [[]]


@contextmanager
def owned_by(paths: list[str]) -> Iterator[None]:
    """Tables that operators write within the block are added to `paths`, for the caller to forget()."""
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.pop()


def new_folder(spark: SparkSession, name: str, owned: bool = True) -> str:
    """A fresh path below the shared folder, in the list of its owner."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if owned:
        _OWNERS[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no more than a read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables in `paths` and empty the list.

    For callers that have written their results: a DataFrame that still reads such a table fails afterwards.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def forget_written(spark: SparkSession) -> None:
    """forget() all tables that operators have left outside of owned_by()."""
    forget(spark, _OWNERS[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; of the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """A prefix, made of name, that no column of df begins with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def text_bytes(batch, name: str = "text") -> list[bytes | None]:
    """A batch's texts in UTF-8."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
