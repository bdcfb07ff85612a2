"""Ingest of the CSV files that have arrived or changed in a folder since the last run."""

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from feedbackmill.plans.ingest import IngestOptions, RunResult, ingest_csv
from feedbackmill.session import scratch, stage
from feedbackmill.sinks.store import ReviewStore
from feedbackmill.sources.csv_files import file_datasets

VERSION = ("path", "modificationTime", "length")
#: A file without a dataset has an empty one; ``call`` grows from one call to the next.
LEDGER_ROWS = "path string, modificationTime timestamp, length long, dataset string, call long"


def _seen(store: ReviewStore, ledger: str) -> DataFrame:
    """Rows of the ledger; files that were noted without their dataset count as not seen."""
    try:
        return store.spark.read.schema(LEDGER_ROWS).parquet(ledger).where("dataset is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return store.spark.createDataFrame([], LEDGER_ROWS)


def present_files(store: ReviewStore, folder: str) -> DataFrame:
    """The CSV files of the folder; their contents are not read."""
    return (
        store.spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(*VERSION, F.col("_metadata.file_path").alias("file_path"))
    )


def _with_datasets(store: ReviewStore, files: DataFrame, resolved: str, limit: int) -> DataFrame:
    """``files`` with their datasets; the table in ``resolved`` grows by ``limit`` files at a time."""
    schema = f"{LEDGER_ROWS.rsplit(',', 1)[0]}, file_path string"
    store.spark.createDataFrame([], schema).write.parquet(resolved)
    while True:
        known = store.spark.read.schema(schema).parquet(resolved)
        left = files.join(known, "file_path", "left_anti").select(*VERSION, "file_path")
        some = left.orderBy("file_path").limit(limit).collect()
        if not some:
            return known
        datasets = file_datasets(store.spark, [r["path"] for r in some])
        rows = store.spark.createDataFrame(some, left.schema).join(datasets, "file_path", "left")
        rows = rows.select(*VERSION, F.coalesce("business_url", F.lit("")).alias("dataset"), "file_path")
        rows.write.mode("append").parquet(resolved)


def _parts(present: DataFrame, new: DataFrame, seen: DataFrame) -> DataFrame:
    """The files to ingest: the new ones, and the other parts of uploads of which a part was rewritten."""
    last = seen.where("dataset <> ''").groupBy("dataset").agg(F.max("call").alias("call"))
    current = seen.join(last, ["dataset", "call"]).select(*VERSION, "dataset").distinct()
    touched = current.join(new.select("path"), "path", "left_semi").select("dataset").distinct()
    others = current.join(touched, "dataset", "left_semi").join(present, list(VERSION), "left_semi")
    others = others.join(new.select("path"), "path", "left_anti")
    return new.select(*VERSION, "dataset").unionByName(others.select(*VERSION, "dataset"))


def _ingest(
    store: ReviewStore, folder: str, ledger: str, options: IngestOptions, max_rows: int | None,
    files_per_batch: int, new: DataFrame | None = None,
) -> Iterator[RunResult]:
    """Ingest the files of ``new`` (or all) that the ledger lacks, in groups of whole datasets.

    A group is named by the versions of its files. If its reviews are in the store already, since an
    earlier attempt died before it reached the ledger, it is only noted there.
    """
    spark = store.spark
    with scratch(spark) as staged:
        present = stage(present_files(store, folder), "present-files")
        seen = stage(_seen(store, ledger), "ledger")
        unseen = present.join(seen, list(VERSION), "left_anti")
        if new is not None:
            unseen = unseen.join(new, list(VERSION), "left_semi")
        unseen = stage(unseen, "new-files")
        call = max(time.time_ns(), (seen.agg(F.max("call")).first()[0] or 0) + 1)
        unseen = _with_datasets(store, unseen, f"{staged}/resolved", files_per_batch)
        parts = stage(_parts(present, unseen, seen), "parts")
        sizes = parts.groupBy("dataset").agg(F.min("modificationTime").alias("oldest"), F.count("*").alias("files"))
        sizes = stage(sizes, "batches")
        after = F.lit(True)
        while True:
            # Paths of ``files_per_batch`` files, or of one dataset, reach the driver.
            heads = sizes.where(after).orderBy("oldest", "dataset").limit(files_per_batch).collect()
            if not heads:
                return
            take, files = 1, heads[0]["files"]
            while take < len(heads) and files + heads[take]["files"] <= files_per_batch:
                files += heads[take]["files"]
                take += 1
            end = heads[take - 1]
            after = (F.col("oldest") > F.lit(end["oldest"])) | (
                (F.col("oldest") == F.lit(end["oldest"])) & (F.col("dataset") > F.lit(end["dataset"]))
            )
            batch = parts.where(F.col("dataset").isin([r["dataset"] for r in heads[:take]])).collect()
            if paths := [r["path"] for r in batch if r["dataset"]]:
                versions = sorted(f"{r['path']} {r['modificationTime']} {r['length']}" for r in batch)
                name = hashlib.sha256("\n".join(versions).encode()).hexdigest()
                yield ingest_csv(store, paths, options, max_rows, batch=f"drop folder {name}")
            done = spark.createDataFrame(batch, parts.schema).withColumn("call", F.lit(call))
            done.coalesce(1).write.mode("append").parquet(ledger)


def ingest_new_files(
    store: ReviewStore,
    folder: str,
    ledger: str,
    options: IngestOptions = IngestOptions(),
    max_rows: int | None = None,
    files_per_batch: int = 1000,
) -> Iterator[RunResult]:
    """Ingest the new and the rewritten files, oldest first, and remember them in ``ledger``.

    The ledger keeps path, time and length, and the dataset of each file. Headers differ from file to
    file, so each batch of paths goes through the batch reader. A batch holds all parts of its datasets: it
    ends before ``files_per_batch`` files, unless a single dataset has more. New files of a dataset
    in one call are parts of one upload and replace what earlier calls brought; if a part of the
    present upload was rewritten, its other parts are ingested with it. A batch that fails is not
    remembered and comes again.
    """
    yield from _ingest(store, folder, ledger, options, max_rows, files_per_batch)


# As a stream


class DropFolder(DataSource):
    """The versions of a folder's CSV files (path, modificationTime, length) as a streaming source.

    Spark's own file stream knows files by path and never reads a rewritten one. Options: ``folder``,
    and ``snapshots``, a folder for the listings that offsets stand for.
    """

    @classmethod
    def name(cls) -> str:
        return "csv_drop_folder"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long"

    def streamReader(self, schema) -> "VersionReader":
        return VersionReader(self.options["folder"], self.options["snapshots"])


@dataclass
class Versions(InputPartition):
    rows: list[tuple[str, int, int]]


class VersionReader(DataSourceStreamReader):
    """An offset is the number of a snapshot, a listing of all versions in the folder; the versions
    between two offsets are those that only the later one has. A listing is made on the driver and
    holds a path, a time and a length per file."""

    def __init__(self, folder: str, snapshots: str):
        self.folder, self.snapshots = folder, snapshots

    @staticmethod
    def _opened(folder: str):
        """File system, path in it, and what goes before such paths in Spark."""
        from pyarrow import fs

        if "://" in folder and not folder.startswith("file:"):
            files, root = fs.FileSystem.from_uri(folder)
            scheme, rest = folder.split("://", 1)
            return files, root, f"{scheme}://{rest.split('/', 1)[0]}" if root.startswith("/") else f"{scheme}://"
        root = "/" + folder.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), root, "file:"

    def _listed(self) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        files, root, before = self._opened(self.folder)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        # Times by milliseconds, as Spark lists them; hidden files are none of its files either.
        return sorted(
            (before + i.path, i.mtime_ns // 1_000_000, i.size) for i in found
            if i.is_file and i.path.lower().endswith(".csv") and not i.base_name.startswith((".", "_"))
        )

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        files, root, _ = self._opened(self.snapshots)
        names = [i.base_name for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _snapshot(self, number: int) -> list[tuple[str, int, int]]:
        if number < 0:
            return []
        files, root, _ = self._opened(self.snapshots)
        with files.open_input_stream(f"{root}/{number}.json") as file:
            return [tuple(row) for row in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        last = numbers[-1] if numbers else -1
        listed = self._listed()
        if listed == self._snapshot(last):
            return {"snapshot": last}
        files, root, _ = self._opened(self.snapshots)
        files.create_dir(root)
        # Moved to its name when whole; a number that was made but never used is made again.
        part = f"{root}/{last + 1}.part"
        with files.open_output_stream(part) as file:
            file.write(json.dumps(listed).encode())
        files.move(part, f"{root}/{last + 1}.json")
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Versions]:
        before = set(self._snapshot(start["snapshot"]))
        new = [v for v in self._snapshot(end["snapshot"]) if v not in before]
        return [Versions(new[i:i + 1000]) for i in range(0, len(new), 1000)]

    def read(self, partition: Versions) -> Iterator[tuple]:
        for path, time_ms, length in partition.rows:
            yield path, datetime.fromtimestamp(time_ms // 1000, timezone.utc).replace(microsecond=time_ms % 1000 * 1000), length

    def commit(self, end: dict) -> None:
        """Drop the snapshots that no offset to come starts from."""
        files, root, _ = self._opened(self.snapshots)
        for number in self._numbers():
            if number < end["snapshot"]:
                files.delete_file(f"{root}/{number}.json")


def stream_new_files(
    store: ReviewStore,
    folder: str,
    state: str,
    options: IngestOptions = IngestOptions(),
    max_rows: int | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start a stream that ingests what is new or rewritten in ``folder`` now, and then ends.

    The same rules hold as in :func:`ingest_new_files`. ``state`` is a folder for the stream's
    checkpoint, its snapshots and the ledger. A batch that died at any point comes again: groups of
    files that are in the ledger are left out, and one whose reviews are in the store changes nothing.
    """
    spark = store.spark
    spark.dataSource.register(DropFolder)

    def ingest(batch: DataFrame, _: int) -> None:
        with scratch(spark):
            new = stage(batch, "versions")
            if new.isEmpty():
                return
            for _ in _ingest(store, folder, f"{state}/ledger", options, max_rows, files_per_batch, new):
                pass

    versions = spark.readStream.format(DropFolder.name()).option("folder", folder).option("snapshots", f"{state}/snapshots").load()
    stream = versions.writeStream.foreachBatch(ingest).option("checkpointLocation", f"{state}/checkpoint")
    return stream.trigger(availableNow=True).start()
