"""Scans, with declared schemas, and resumable sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import METHODS, Settings


class MissingInput(FileNotFoundError):
    """A source's path isn't there."""


def _loaded(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise MissingInput(path) from e
        raise


def csv(spark: SparkSession, path: str, schema: str, place: str | None = None) -> DataFrame:
    """Quoted multi-line CSV with a header; columns by the header's names whatever their order or case. place: a column of that name
    is added that orders the rows by file and by line (a file is read by one task, so store large ones as Parquet once)."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    raw = _loaded(read.csv, path)
    have = {c.lower(): c for c in raw.columns}
    parts = [x.strip().split(" ", 1) for x in schema.split(",")]
    return raw.select(*((F.expr(f"try_cast(`{have[n.lower()]}` AS {t})") if n.lower() in have else F.lit(None).cast(t)).alias(n) for n, t in parts), *([F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("line")).alias(place)] if place else []))


def notes(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """(index, text), the text column by data set. An index is required: a generated one would differ between steps."""
    raw = csv(spark, path, f"index long, {settings.text_column} string")
    return in_range(raw.toDF("index", "text"), settings.start_index, settings.end_index)


def in_range(rows: DataFrame, start: int = 0, end: int | None = None, order: str = "index") -> DataFrame:
    """Rows by place in order, from start up to before end; None or a range beyond the rows: to the end.

    Places count on from the partitions before, after a sort by range: no task sees all rows."""
    if not start and end is None:
        return rows
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    dealt = dealt.checkpoint()
    sizes = dict(dealt.groupBy("_part").count().collect())  # a row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return rows
    offset = F.try_element_at(F.create_map(*(F.lit(int(x)) for p in before.items() for x in p)), F.col("_part"))
    place = offset + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    inside = F.col("_place") >= max(0, start)
    if end is not None:
        inside &= F.col("_place") < end
    return dealt.withColumn("_place", place).where(inside).select(*rows.columns)


def entities(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (index, entities); of lines with one index the last in (file, line) order holds; blank lines are skipped."""
    raw = _loaded(spark.read.text, path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    rows = raw.select(F.from_json("value", schemas.ENTITIES).alias("x"), "file_path", "line").where("x.index IS NOT NULL")
    return rows.groupBy(F.col("x.index").alias("index")).agg(F.max_by("x.entities", F.struct("file_path", "line")).alias("entities"))


def with_entities(note_rows: DataFrame, found: DataFrame) -> DataFrame:
    return note_rows.join(found, "index", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def done(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Distinct indices of an output so far; empty if there is none. Only the index is read."""
    try:
        rows = csv(spark, path, "index long") if kind == "csv" else _loaded(spark.read.schema("index long").format(kind).load, path)
    except MissingInput:
        return spark.createDataFrame([], "index long")
    return rows.where("index IS NOT NULL").select("index").distinct()


def remaining(rows: DataFrame, finished: DataFrame) -> DataFrame:
    return rows.join(finished, "index", "left_anti")


def kg_edges(spark: SparkSession, path: str) -> DataFrame:
    """The graph's rows with ord, the row's place: its file's path, then its line."""
    return csv(spark, path, schemas.KG_EDGES, place="ord")


def kge(spark: SparkSession, matrix_path: str, map_path: str, rows_at_once: int = 10_000) -> DataFrame:
    """(node_id, vec): rows of a complex .npy matrix as real parts, then imaginary parts. A memory-mapped one-off load for storage as Parquet:
    each task maps the file, on a shared file system, and reads its own range of rows."""
    shape = np.load(matrix_path, mmap_mode="r").shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(matrix_path, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                x = np.asarray(matrix[start : start + rows_at_once])
                x = np.concatenate([x.real, x.imag], 1) if np.iscomplexobj(x) else x
                yield pa.RecordBatch.from_arrays([pa.array(range(start, start + len(x)), pa.int64()), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["matrix_index", "vec"])

    rows = spark.range(0, shape[0], rows_at_once).mapInArrow(read, "matrix_index long, vec array<float>")
    names = csv(spark, map_path, schemas.KGE_MAP).groupBy("primekg_node_id").agg(F.max("matrix_index").alias("matrix_index"))
    return names.join(rows, "matrix_index").select(F.col("primekg_node_id").alias("node_id"), "vec")


def scores(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(index, disease, uq_<name>) of a score file: headers in any case, `uq` or `ccp_score` as the score; a missing file is empty."""
    schema = f"index long, disease string, uq_{name} double"
    try:
        raw = _loaded(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv, path)
    except MissingInput:
        return spark.createDataFrame([], schema)
    have = {c.lower(): c for c in raw.columns}
    score = next((have[c] for c in ("uq", "ccp_score", f"uq_{name}") if c in have), None)
    if score is None or "index" not in have or "disease" not in have:
        return spark.createDataFrame([], schema)
    out = raw.select(F.expr(f"CAST(try_cast(`{have['index']}` AS double) AS long)").alias("index"), F.col(have["disease"]).alias("disease"), F.expr(f"try_cast(`{score}` AS double)").alias(f"uq_{name}"))
    return named(out.where("index IS NOT NULL"))


def named(rows: DataFrame, column: str = "disease") -> DataFrame:
    """Tokens that CSV readers take for missing are null names."""
    missing = ["", "na", "n/a", "nan", "null", "none", "#n/a", "<na>"]
    return rows.withColumn(column, F.when(~F.lower(F.trim(column)).isin(missing), F.col(column)))


def predictions(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """All method scores, read once and kept wide; missing columns are null; expanded rows go if they are to be ignored."""
    try:
        rows = named(csv(spark, path, schemas.PREDICTIONS))
    except MissingInput:
        return spark.createDataFrame([], schemas.PREDICTIONS)
    if settings.ignore_expansion:
        rows = rows.where(~F.coalesce("is_expanded", F.lit(False)))
    return rows if settings.limit_index is None else rows.where(F.col("index") <= settings.limit_index)


def method_scores(rows: DataFrame, method: str, suffix: str) -> DataFrame:
    """(index, disease, score_<suffix>) of one method, for comparing modes."""
    if method not in METHODS:
        raise ValueError(method)
    return rows.select("index", "disease", F.col(method).alias(f"score_{suffix}"))
