"""CSV records with line breaks inside fields, read by many tasks per file.

Spark reads lines by blocks of a file, but whether a line begins a record depends on the quotes of all
lines before it. Of a block only two things can be true: it begins a record, or it begins inside a quoted
field. A first pass finds for both where each block would end; going through the blocks of a file in
order then tells how each one begins. The second pass puts lines together to records, and pieces of a record
that lie in different blocks meet at last.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedbackmill.session import stage

_PLACE = ["file_path", "block"]


def goes_on(line: str, quoted: bool) -> bool:
    """Whether a quoted field is open at the end of a line, if one was (``quoted``) or none was at its begin.

    Quotes open a field at its begin only, doubled ones stand for themselves, and what follows the
    closing one belongs to the field until the next comma.
    """
    if '"' not in line:
        return quoted
    at = 0
    while True:
        if not quoted:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find('"', at) + 1
        if not at:
            return True
        if line.startswith('"', at):
            at, quoted = at + 1, True
            continue
        at, quoted = line.find(",", at) + 1, False
        if not at:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, file_name, file_time, block, seq (rising in a block) and line; a file's byte order mark is dropped."""
    first = F.col("block") == 0
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value"),
    ).select(*_PLACE, "seq", F.when(first, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")).alias("line"))


def block_begins(lines: DataFrame) -> DataFrame:
    """(file_path, block, quoted): whether a block begins inside a quoted field, staged; a row per block."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, states = None, (False, True)

        def row():
            return pa.RecordBatch.from_pydict({
                "file_path": [place[0]], "block": pa.array([place[1]], pa.int64()), "if_not": [states[0]], "if_quoted": [states[1]],
            })

        for batch in batches:
            for path, block, line in zip(*(batch.column(c).to_pylist() for c in (*_PLACE, "line")), strict=True):
                if (path, block) != place:
                    if place:
                        yield row()
                    place, states = (path, block), (False, True)
                if '"' in line:
                    states = tuple(goes_on(line, s) for s in states)
        if place:
            yield row()

    blocks = lines.select(*_PLACE, "line").mapInArrow(ends, "file_path string, block long, if_not boolean, if_quoted boolean")
    # A row per block of a file, some hundred bytes for as many megabytes, in order.
    order = F.array_sort(F.collect_list(F.struct("block", "if_not", "if_quoted")))
    begins = F.aggregate(
        order, F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(False).alias("quoted"), F.lit(False).alias("after"))),
        lambda done, b: F.concat(done, F.array(F.struct(
            b["block"].alias("block"), F.element_at(done, -1)["after"].alias("quoted"),
            F.when(F.element_at(done, -1)["after"], b["if_quoted"]).otherwise(b["if_not"]).alias("after"),
        ))),
    )
    found = blocks.groupBy("file_path").agg(begins.alias("begins")).select("file_path", F.inline("begins"))
    return stage(found.where("block >= 0").select(*_PLACE, "quoted"), "block-begins")


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of all files as text: file_path, block and seq of the first line, record.

    Records are as Spark's ``multiLine`` reader finds them in files whose quotes are balanced. Empty
    lines between records are none, line ends of a record are dropped, those inside fields are kept.
    A record may reach over any number of blocks. (file_path, block, seq) is the order of records.
    """
    lines = _lines(spark, paths)
    begun = lines.join(block_begins(lines), _PLACE).sortWithinPartitions(*_PLACE, "seq")
    schema = "file_path string, block long, seq long, kind int, record string"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kinds: 0 ends a record of an earlier block, 1 goes on with one, 2 is a whole record, 3 begins one.
        place, parts, start, inside, quoted, out = None, [], 0, False, False, []

        def close(kind):
            if parts:
                out.append((*place, start, kind, "\n".join(parts)))
                parts.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*_PLACE, "seq", "line", "quoted"))
            for path, block, seq, line, begins in zip(*columns, strict=True):
                if (path, block) != place:
                    close(1 if inside else 3)
                    place, inside, quoted = (path, block), begins, begins
                if not parts:
                    start = seq
                parts.append(line)
                quoted = goes_on(line, quoted)
                if not quoted:
                    close(0 if inside else 2)
                    inside = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_PLACE, "seq", "kind", "record"])
                out.clear()
        close(1 if inside else 3)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_PLACE, "seq", "kind", "record"])

    pieces = stage(begun.select(*_PLACE, "seq", "line", "quoted").mapInArrow(gather, schema.replace("kind int", "kind long")), "csv-pieces")
    # Two pieces per block at most are no whole records.
    cut = pieces.where("kind <> 2").withColumn("begins", (F.col("kind") == 3).cast("int"))
    order = W.partitionBy("file_path").orderBy("block", "seq")
    cut = cut.withColumn("nth", F.sum("begins").over(order))
    joined = cut.groupBy("file_path", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "record"))).alias("parts"))
    joined = joined.select(
        "file_path", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["seq"].alias("seq"),
        F.array_join(F.col("parts")["record"], "\n").alias("record"),
    )
    whole = pieces.where("kind = 2").select(*_PLACE, "seq", "record").unionByName(joined)
    return whole.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def record_fields(records: DataFrame, width: int) -> DataFrame:
    """Adds ``fields``, an array of ``width`` strings, as Spark's CSV reader splits them."""
    names = [f"c{i}" for i in range(width)]
    options = {"multiLine": "true", "lineSep": "\n", "escape": '"', "mode": "PERMISSIVE"}
    parsed = records.withColumn("_csv", F.from_csv("record", ", ".join(f"{n} string" for n in names), options))
    return parsed.withColumn("fields", F.array(*(F.col("_csv")[n] for n in names))).drop("_csv")
