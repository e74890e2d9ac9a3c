"""File drops into staging: decode, register, number, skip what is known."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions.refs import platform_from_file_name
from rosterlake.session import cut_lineage
from rosterlake.sources import bigcsv

ROWS = T.StructType([
    T.StructField("file_sha256", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("row_number", T.LongType()), T.StructField("raw", T.MapType(T.StringType(), T.StringType()))])

ARROW_ROWS = pa.schema([("file_sha256", pa.string()), ("columns", pa.list_(pa.string())), ("row_number", pa.int64()),
                        ("raw", pa.map_(pa.string(), pa.string()))])
#: bytes or letters worked on at once
PIECE = 4 << 20


def read_drop(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Whole small files as bytes with their content hash; one row per distinct content."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", "modificationTime"))
    return fingerprinted(files)


def fingerprinted(files: DataFrame) -> DataFrame:
    hashed = files.withColumn("file_sha256", F.sha2("content", 256))
    return hashed.groupBy("file_sha256").agg(F.min("file_name").alias("file_name"), F.first("content").alias("content"),
                                             F.min("modificationTime").alias("modified_at"))


def not_seen(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content was not imported before (A2)."""
    return files.join(registry.select("file_sha256"), "file_sha256", "left_anti")


def decode(data: bytes) -> str:
    """Text of a file: UTF-8, UTF-16 when it says so, Windows-1252, else UTF-8 with replacements (A3)."""
    marked = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    for encoding in ("utf-8-sig", "utf-16" if marked else "cp1252", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def _reads(data: bytes, encoding: str) -> bool:
    """Whether a file is text of an encoding, looked at piece by piece."""
    decoder = codecs.getincrementaldecoder(encoding)()
    try:
        for at in range(0, len(data), PIECE):
            decoder.decode(data[at:at + PIECE])
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return True


def opened(data: bytes) -> io.TextIOBase:
    """The text that ``decode`` gives, line by line, so that a big file is never held as a text as well."""
    if len(data) <= PIECE:
        return io.StringIO(decode(data))
    marked = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    for encoding in ("utf-8-sig", "utf-16" if marked else "cp1252", "cp1252"):
        if _reads(data, encoding):
            return io.TextIOWrapper(io.BytesIO(data), encoding, newline="\n")
    return io.TextIOWrapper(io.BytesIO(data), "utf-8", errors="replace", newline="\n")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all files, about 5,000 or ``PIECE`` letters at a time; row number 0 carries the header of the file."""
    csv.field_size_limit(2**31 - 1)
    block, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(cells, t) for cells, t in zip(zip(*block), ARROW_ROWS.types)], schema=ARROW_ROWS)
    for files in batches:
        for content in files.column(0):
            data = content.as_py()
            if data is None:
                raise TypeError("a file without content")
            sha = hashlib.sha256(data).hexdigest()
            reader = csv.DictReader(opened(data))
            header = list(reader.fieldnames or [])
            block.append((sha, header, 0, []))
            held += 64 + sum(map(len, header))
            for n, row in enumerate(reader, 1):
                # cells beyond the header have no name and are dropped
                cells = [(k, v) for k, v in row.items() if k is not None]
                block.append((sha, None, n, cells))
                held += 64 + sum(len(k) + len(v or "") for k, v in cells)
                if len(block) >= 5000 or held >= PIECE:
                    yield batch()
                    block, held = [], 0
            if len(block) >= 5000 or held >= PIECE:
                yield batch()
                block, held = [], 0
    if block:
        yield batch()


def parse_rows(files: DataFrame) -> DataFrame:
    """``(file_sha256, columns, row_number, raw)``. Files are uploads of at most some tens of megabytes, one per task."""
    return files.select("content").mapInArrow(_parse, ROWS)


def dense_index(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Number rows 1..n in order without gathering them: range partitions are numbered inside and offset by the sizes
    of the partitions before, of which there are as many as shuffle partitions."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(spread.withColumn("_part", F.spark_partition_id())
                         .withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_offset") + F.col("_in") + 1 + start).cast("bigint")).drop("_part", "_in", "_offset")


def ingest(files: DataFrame, ingested_at: Column, registry: DataFrame | None = None, hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(import_batches, staging_rows)`` of files that are new (A1-A6). Batches are numbered by file name."""
    fresh = files if registry is None else not_seen(files, registry)
    start = 0 if registry is None else (registry.agg(F.max("batch_id")).first()[0] or 0)
    parsed = cut_lineage(parse_rows(fresh))
    facts = parsed.groupBy("file_sha256").agg(F.count_if(F.col("row_number") > 0).alias("row_count"),
                                              F.max(F.when(F.col("row_number") == 0, F.col("columns"))).alias("columns"))
    guess = F.lit(hint).cast("string") if hint else platform_from_file_name(F.col("file_name"))
    registered = fresh.select("file_sha256", "file_name", guess.alias("platform_hint"), ingested_at.alias("ingested_at")).join(
        facts, "file_sha256")
    batches = dense_index(registered, [F.col("file_name"), F.col("file_sha256")], "batch_id", start).select(
        "batch_id", "file_name", "file_sha256", "platform_hint", "row_count", "columns", "ingested_at")
    # the registry of one drop is a name and a header per file
    rows = parsed.where(F.col("row_number") > 0).drop("columns").join(batches.select("batch_id", "file_sha256"), "file_sha256")
    return batches, rows.select(row_id(F.col("batch_id"), F.col("row_number")).alias("row_id"), "batch_id", "row_number", "raw")


def row_id(batch_id: Column, row_number: Column) -> Column:
    """Row ids that sort by batch and row number."""
    return F.shiftleft(batch_id, 32) + row_number


def large_csv(spark: SparkSession, path: str, batch_id: int) -> tuple[list[str], DataFrame]:
    """``(columns, staging rows)`` of big files, cut into byte ranges and parsed in parallel; the rows are those of ``parse_rows`` (A1)."""
    return bigcsv.large_csv(spark, path, batch_id, row_id)


def without_batch(batch_id: int, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Undo an import: every table without that batch (A8). The stored file is kept."""
    return tuple(t.where(F.col("batch_id") != batch_id) for t in tables)


def keep_originals(files: DataFrame, path: str) -> None:
    """Untouched copies, one row per content."""
    files.select("file_sha256", "file_name", "content").write.mode("append").parquet(path)
