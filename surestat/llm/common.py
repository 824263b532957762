"""What the operators share: reading tables, batches for Arrow functions, tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handled at once inside an Arrow function; bounds a worker's memory.
ROWS_AT_ONCE = 512

#: Rows and bytes of a batch between the JVM and its workers.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session, whose tasks all run on
    this machine, gets a temporary one; a cluster has to name a folder that its executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get() if made.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="surestat-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which release() deletes."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, written with options: cuts the lineage, survives lost executors, is read column by column."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables that written() made and new_folder()'s; call it once results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with the cluster's
            return


atexit.register(release)


_holder: tuple[str, Callable[[], None]] | None = None


def only_memory(name: str, forget: Callable[[], None]) -> None:
    """Called where an operator begins to remember things in a worker, which lives on from task to task: what another
    operator has left there is forgotten, so a worker's memory holds one operator's at a time."""
    global _holder
    if _holder and _holder[0] != name:
        _holder[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)
    _holder = (name, forget)


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list]], schema: str) -> DataFrame:
    """mapInArrow in slices of ROWS_AT_ONCE. make() runs once in each task and returns the function of a slice.

    Arrow's buffers lie outside the heap on both sides and grow with a batch's texts, so the session's batches are held to
    ARROW_ROWS rows and ARROW_BYTES bytes, unless it has set less."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    size = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not 0 < size <= ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield handle(batch.slice(at, ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)
