"""Reviews from uploaded CSV files with free header names."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedbackmill.functions.labels import name_or_unknown
from feedbackmill.functions.ratings import parse_rating
from feedbackmill.functions.text import strip
from feedbackmill.operators.lookup import attach
from feedbackmill.schemas import DEFAULT_DATASET, UNKNOWN
from feedbackmill.session import stage

# A comma that is followed by an even number of quotes lies between two header names.
HEADER_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: ``names``, its header names lower-cased and stripped."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.regexp_replace("value", "^﻿", "").alias("line"),
    )
    header = (
        lines.where((F.col("_block") == 0) & (F.trim("line") != ""))
        .groupBy("file_path")
        .agg(F.min_by("line", "_seq").alias("line"))
    )
    names = F.transform(
        F.split("line", HEADER_COMMA),
        lambda n: strip(F.lower(F.regexp_replace(F.regexp_replace(n, '^"|"\\s*$', ""), '""', '"'))),
    )
    return header.select("file_path", names.alias("names"))


def _last_place(names: Column, wanted: Column) -> Column:
    """0-based place of the last header equal to ``wanted``; null without one."""
    from_end = F.array_position(F.reverse(names), wanted)
    return F.when(from_end > 0, F.size(names) - from_end).cast("int")


def column_places(headers: DataFrame) -> DataFrame:
    """Where each file keeps its text, stars, title, name and date; null where it has no such
    column. The date is the first header that contains ``date`` or ``time``."""
    names = F.col("names")
    dated = F.get(
        F.filter(names, lambda n: F.contains(n, F.lit("date")) | F.contains(n, F.lit("time"))),
        F.lit(0),
    )
    places = [_last_place(names, F.lit(n)).alias(n) for n in ("text", "stars", "title", "name")]
    return headers.select("file_path", *places, _last_place(names, dated).alias("date"))


def _file_name() -> Column:
    """Name of the scanned file; Spark gives it URL-encoded, with plus signs as they are."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded).alias("file_name")


def _raw_rows(spark: SparkSession, paths: list[str], multi_line: bool) -> DataFrame:
    """Every record of every file, header records included, as (file, block, order, fields)."""
    headers = stage(read_headers(spark, paths), "headers")
    width = headers.agg(F.coalesce(F.max(F.size("names")), F.lit(1))).first()[0]
    columns = [f"c{i}" for i in range(width)]
    # Read by place, so that one scan serves files whose headers differ.
    records = (
        spark.read.schema(", ".join(f"{c} string" for c in columns))
        .option("header", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(paths)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            _file_name(),
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"),
            F.array(*columns).alias("_fields"),
        )
    )
    placed = attach(records, column_places(headers), ["file_path"], spread=["_seq"])
    fields = [
        F.get("_fields", F.col(n)).alias(n) for n in ("text", "stars", "title", "name", "date")
    ]
    return placed.select("file_path", "file_name", "file_time", "_block", "_seq", *fields)


def _number_records(rows: DataFrame) -> DataFrame:
    """Add ``pos``, the place in the file (the header has -1), and ``line_no`` over all files.

    A block is the part of a file that one scan task reads in order. Blocks are counted and summed
    up, which needs one row per scan task; the records themselves are not sorted.
    """
    blocks = rows.groupBy("file_path", "_block").agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_n")
    )

    def earlier(window) -> Column:
        before = window.rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(before), F.lit(0))

    blocks = blocks.select(
        "file_path",
        "_block",
        "_first",
        earlier(W.partitionBy("file_path").orderBy("_block")).alias("_before_in_file"),
        earlier(W.orderBy("file_path", "_block")).alias("_before"),
    )
    in_block = F.col("_seq") - F.col("_first")
    return (
        attach(rows, blocks, ["file_path", "_block"], spread=["_seq"])
        .withColumn("pos", in_block + F.col("_before_in_file") - 1)
        .withColumn("line_no", in_block + F.col("_before"))
        .drop("_seq", "_block", "_first", "_before_in_file", "_before")
    )


def dataset_keys(records: DataFrame) -> DataFrame:
    """One dataset per file: its last title that is not empty, else its name, else a default."""
    titled = (F.col("pos") >= 0) & (F.col("title") != "")
    return (
        records.groupBy("file_path")
        .agg(
            F.max_by("title", F.when(titled, F.col("pos"))).alias("title"),
            F.max("file_name").alias("file_name"),
            F.max("file_time").alias("file_time"),
        )
        .select(
            "file_path",
            F.coalesce(
                "title", F.nullif("file_name", F.lit("")), F.lit(DEFAULT_DATASET)
            ).alias("business_url"),
            "file_time",
        )
    )


def file_datasets(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """(file_path, business_url) of the files; those of no bytes are in no dataset and left out."""
    titles = _raw_rows(spark, paths, multi_line).select("file_path", "file_name", "file_time", "_block", "_seq", "title")
    return dataset_keys(_number_records(stage(titles, "titles"))).select("file_path", "business_url")


def part_files(records: DataFrame) -> DataFrame:
    """(business_url, file_path, rows_before): files of one dataset are parts of one upload.

    They follow each other in the order in which they were written. One row per file meets in a
    window here, no records.
    """
    sizes = records.groupBy("file_path").agg((F.max("pos") + 1).alias("rows"))
    before = W.partitionBy("business_url").orderBy("file_time", "file_path").rowsBetween(W.unboundedPreceding, -1)
    return dataset_keys(records).join(sizes, "file_path").select(
        "business_url", "file_path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")
    )


def read_review_csv(
    spark: SparkSession, paths: list[str], max_rows: int | None = None, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Reviews in the files and the datasets they belong to.

    Returns (business_url, pos, line_no, user_name, rating, date, review_text) and
    (business_url, file_path, rows_before). Files of one dataset are parts of one upload, of which
    the first ``max_rows`` rows are kept. A file with only a header gives a dataset without rows,
    and one of no bytes is skipped by Spark. ``multi_line=False`` lets Spark split large files, for
    files known to hold no line break inside a field.
    """
    staged = stage(_raw_rows(spark, paths, multi_line), "csv")
    records = _number_records(staged)
    datasets = stage(part_files(records), "datasets")
    rows = attach(records.where(F.col("pos") >= 0), datasets, ["file_path"], spread=["line_no"])
    rows = rows.withColumn("pos", F.col("pos") + F.col("rows_before"))
    if max_rows is not None:
        rows = rows.where(F.col("pos") < max_rows)
    reviews = rows.select(
        "business_url",
        "pos",
        "line_no",
        name_or_unknown(F.col("name")).alias("user_name"),
        parse_rating(F.col("stars")).alias("rating"),
        F.coalesce("date", F.lit(UNKNOWN)).alias("date"),
        F.coalesce("text", F.lit("")).alias("review_text"),
    )
    return reviews, datasets
