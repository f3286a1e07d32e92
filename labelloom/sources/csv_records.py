"""Quoted CSV files with line breaks inside fields, read by as many tasks as the files have splits.

Whether a line break ends a record depends on all quotes before it in the file. One native pass counts the quotes of every
split; their running parity tells in which state each split begins. A second pass cuts each split's lines into records with
that state. A record that crosses splits leaves a piece in each (two per split at most), and only these pieces are
shuffled to be put together. Records are numbered by counts per split, so no row is sorted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelloom.scale.staging import StagingScope

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Splits are told to the tasks in one table on the driver, some 50 bytes each; a split holds spark.sql.files.maxPartitionBytes.
MAX_SPLITS = 2_000_000
WHOLE, HEAD, PIECE = 0, 1, 2
CUT_ROWS = 5_000


def _cutting(inside):
    """(file, start, value) lines in file order to records: whole ones, and the pieces of those that cross a split's border."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        split, quoted, number, held, begun = None, False, 0, [], False

        def put(kind: int) -> None:
            for column, value in zip(out, (*split, number, kind, "\n".join(held))):
                column.append(value)

        def told() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["file", "start", "number", "kind", "text"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != split:
                    if held:
                        put(HEAD if begun else PIECE)
                    split, quoted, number, held = (file, start), inside.value.get((file, start), False), 0, []
                    begun = not quoted  # else the first lines belong to a record of an earlier split
                if not quoted and not held and not line.strip("\r"):
                    continue  # a blank line between records
                held.append(line)
                if line.count('"') % 2:
                    quoted = not quoted
                if not quoted:
                    put(WHOLE if begun else PIECE)
                    number += begun
                    held, begun = [], True
                    if len(out[0]) >= CUT_ROWS:
                        yield told()
        if held:
            put(HEAD if begun else PIECE)
        if out[0]:
            yield told()

    return cut


def read_csv_records(spark: SparkSession, path: str, columns: list[str], id_name: str) -> DataFrame:
    """Rows of all files below ``path`` with their 0-based number in the order of paths and lines; every column is a string.

    Every file begins with a header record, which is no row. Records end with LF or CRLF, a quote inside a quoted field is
    doubled, blank lines between records are passed over. A quote that is never closed makes the rest of its file one record.
    """
    scope = StagingScope(spark, "csv")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_path").alias("path"), "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = scope.stage(
        lines.groupBy("file", "start", "path").agg((F.sum(quotes) % 2).alias("odd")), "splits"
    )
    if splits.count() > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    inside = spark.sparkContext.broadcast({(r["file"], r["start"]): True for r in begins.filter("inside").collect()})
    pieces = lines.select("file", "start", "value").mapInArrow(
        _cutting(inside), "file long, start long, number long, kind int, text string"
    )
    pieces = scope.stage(pieces, "pieces")
    # Pieces in order: each follows its head. They are few, two per split at most.
    in_order = Window.partitionBy("file").orderBy("start", "number", F.desc("kind"))
    crossing = pieces.filter(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == HEAD).cast("long")).over(in_order))
    part = F.struct("start", "number", F.col("kind"), "text")
    glued = crossing.groupBy("file", "record").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        "file", F.get("parts", F.lit(0))["start"].alias("start"), F.get("parts", F.lit(0))["number"].alias("number"),
        F.array_join("parts.text", "\n").alias("text"),
    )
    records = pieces.filter(F.col("kind") == WHOLE).select("file", "start", "number", "text").unionByName(glued)
    counted = pieces.filter(F.col("kind") != PIECE).groupBy("file", "start").agg(F.count("*").alias("records"))
    # One row per split; the header is record 0 of its file.
    all_before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("path").orderBy("start")) == 1
    starts = splits.join(counted, ["file", "start"]).withColumn("first", first).withColumn(
        "base", F.coalesce(F.sum(F.col("records") - F.col("first").cast("long")).over(all_before), F.lit(0)) - F.col("first").cast("long")
    )
    placed = records.join(F.broadcast(starts.select("file", "start", "first", "base")), ["file", "start"])
    rows = placed.filter(~F.col("first") | (F.col("number") > 0)).select((F.col("base") + F.col("number")).alias(id_name), "text")
    schema = StructType([StructField(c, StringType()) for c in columns])
    text = F.regexp_replace("text", r"\r\z", "")
    parsed = F.from_csv(text, schema.toDDL(), {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"})
    return rows.select(id_name, parsed.alias("_row")).select(id_name, "_row.*")
