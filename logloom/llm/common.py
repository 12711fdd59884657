"""What the operators of this subpackage share: tables, shared storage and hash draws."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the Arrow batches in which whole texts go to Python workers.
ARROW_BYTES = 8 << 20
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the process ends.

    Only in local mode, where the session names none (tests), a temporary folder is set; on a
    cluster that is an error, since executors could not read what others wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='logloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _folders.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_folders):
        try:
            _remove(path)
        except (Py4JError, OSError, AttributeError):  # the JVM has gone already
            return


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, each row is made once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Removes tables of ``materialize`` that nothing reads any more: what was made of them is written."""
    for df in dfs:
        if path := _tables.pop(df, None):
            _remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to ARROW_BYTES, so that 10,000 long texts never make one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What hash draws see of a row: its doc_id, or for a null doc_id the digest of its text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def uniform(label: str, *parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 digest of label and parts."""
    digest = F.md5(F.concat(F.lit(f"{label}|"), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def integer(label: str, *parts: Column) -> Column:
    """A bigint in [0, 2**60) from the first 60 bits of an MD5 digest of label and parts."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{label}|"), *parts)), 1, 15), 16, 10).cast("bigint")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
