"""Sinks. Outputs are tables, partitioned where the reader chooses by it; appending and an anti join with what is done make
a run resumable, and overwriting resets it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

#: Most rows of a CSV file.
FILE_ROWS = 250_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get() if made.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Every part has its header, so that parts of several runs can be read together; blanks at a value's ends stay. A task's rows go to files of
    FILE_ROWS, whose names are in their order (for 1,000 files a task), as a file is read by one task."""
    rows.write.mode("append").options(header=True, maxRecordsPerFile=FILE_ROWS, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def append_table(rows: DataFrame, root: str, settings: Settings, kind: str) -> None:
    rows.write.mode("append").parquet(f"{root}/{settings.output(kind)}")


def by_method(rows: DataFrame, path: str) -> None:
    """One table with a folder for each method."""
    rows.write.mode("overwrite").partitionBy("method").parquet(path)


def summary_csv(rows: DataFrame, path: str) -> None:
    """A row for each method: one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def reset(rows: DataFrame, path: str) -> None:
    """Replaces an output by an empty one of the same columns."""
    rows.limit(0).write.mode("overwrite").parquet(path)


def walk_stats(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Start-node statistics with names: (note_index, node_name, C, S, W, prob)."""
    return anchors.join(nodes.select("index", "name"), "index", "left").select(F.col("note").alias("note_index"), F.col("name").alias("node_name"), "C", "S", "W", "prob")


def report(rows: DataFrame, n: int = 50) -> None:
    rows.show(n, truncate=False)
