"""Stored tables: reviews, what is derived from them, and the run registry.

Every write adds a generation of rows and then one entry to the log of commits, which says for which
datasets the generation holds. Readers join the commits, so a dataset is replaced, emptied or extended
as a whole, and a write that fails before its commit is never seen. Writers may work at the same time:
each takes ids of its own, and of two that replace one dataset the later is refused.
"""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedbackmill import schemas
from feedbackmill.operators.dashboard import COUNTS, KEY, SUMS, dashboard_partials, monthly_partials
from feedbackmill.operators.runs import latest_status
from feedbackmill.schemas import NOT_FOUND
from feedbackmill.session import remove_path, scratch, stage
from feedbackmill.sinks.commit_log import APPEND, IDS, REPLACE, RUNS, CommitLog

#: Folders of a generation; a dataset lies in one of them.
BUCKETS = 64
GENERATION = (T.StructField("generation", T.StringType()), T.StructField("bucket", T.IntegerType()))
SCHEMAS = {
    "reviews": schemas.REVIEWS,
    "aspect_sentiments": schemas.ASPECT_SENTIMENTS,
    "review_clusters": schemas.REVIEW_CLUSTERS,
    "term_frequencies": schemas.TERM_FREQUENCIES,
    "review_totals": T.StructType([
        T.StructField(KEY, T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS),
        *(T.StructField(c, T.DoubleType()) for c in SUMS),
    ]),
    "review_months": T.StructType([
        T.StructField(KEY, T.StringType()), T.StructField("period", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("rating_sum", T.DoubleType()),
    ]),
}
#: Partial sums of each generation of reviews. They hold as long as it does, so a replaced dataset takes its
#: sums along, and what holds adds up to the sums of all its reviews.
PARTIALS = {"review_totals": dashboard_partials, "review_months": monthly_partials}
#: Read from the log.
REGISTRY = "dataset_runs"


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class ReviewStore:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.path("commits"))

    def _stored(self, table: str) -> DataFrame:
        """All rows of a table that were ever written and not compacted away."""
        stored = T.StructType([*SCHEMAS[table], *GENERATION])
        try:
            return self.spark.read.schema(stored).parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], stored)

    def live(self, table: str, key: str | None = None) -> DataFrame:
        """(business_url, generation) of what holds: the last replacement and what was added since."""
        owner = "reviews" if table in PARTIALS else table
        commits = self.log.commits().where(F.col("table_name") == owner)
        if key is not None:
            commits = commits.where(F.col(KEY) == key)
        return self.log.holding(commits).select(KEY, "generation").distinct()

    def read(self, table: str, key: str | None = None) -> DataFrame:
        """A whole table, or one dataset of it, for which only its bucket's folders are read."""
        if table == REGISTRY:
            return self.log.runs() if key is None else self.log.runs().where(F.col(KEY) == key)
        rows = self._stored(table)
        if key is not None:
            rows = rows.where((F.col(KEY) == key) & (F.col("bucket") == bucket(F.lit(key))))
        rows = rows.join(self.live(table, key), [KEY, "generation"], "left_semi")
        return rows.select(*(f.name for f in SCHEMAS[table]))

    def _add(self, table: str, rows: DataFrame, generation: str | None = None) -> str:
        """Write a generation of rows, and the partial sums of reviews.

        Rebalancing gathers small buckets and splits large ones.
        """
        generation = generation or uuid.uuid4().hex
        names = [f.name for f in SCHEMAS[table]]
        keyed = rows.select(*names, F.lit(generation).alias("generation"), bucket(F.col(KEY)).alias("bucket"))
        (
            keyed.hint("rebalance", "bucket").sortWithinPartitions("bucket", KEY)
            .write.mode("append").partitionBy("generation", "bucket").parquet(self.path(table))
        )
        if table == "reviews":
            written = self._stored(table).where(F.col("generation") == generation)
            for part, sums in PARTIALS.items():
                self._add(part, sums(written), generation)
        return generation

    def _commit(
        self, table: str, datasets: DataFrame, generation: str, kind: str,
        since: int | None, writer: str | None, batch: str | None = None, compacts: bool = False,
    ) -> None:
        entry = {"kind": kind, "table": table, "generation": generation, "writer": writer or generation}
        if batch:
            entry["batch"] = batch
        if compacts:
            entry["compacts"] = True
        self.log.add(entry, datasets.select(KEY).distinct(), since)

    def replace(
        self, table: str, rows: DataFrame, datasets: DataFrame,
        since: int | None = None, writer: str | None = None, batch: str | None = None,
    ) -> None:
        """Put ``rows`` in place of all rows of ``datasets``; other datasets stay.

        A dataset without new rows is emptied. Rows of datasets that are not named are not kept. If
        another writer has replaced one of the datasets after version ``since`` of the log (that of the
        call's begin unless given), this one is refused with :class:`ConflictingWrite`. ``batch``
        names the batch of a stream that the rows come from.
        """
        since = self.log.version() if since is None else since
        self._commit(table, datasets, self._add(table, rows), REPLACE, since, writer, batch)

    def clear(self, table: str, datasets: DataFrame, since: int | None = None, writer: str | None = None) -> None:
        """Empty ``datasets``."""
        self._commit(table, datasets, uuid.uuid4().hex, REPLACE, since, writer)

    def append(self, rows: DataFrame) -> None:
        """Add review rows to their datasets; ``rows`` is read twice, so it should be staged."""
        self._commit("reviews", rows.select(KEY), self._add("reviews", rows), APPEND, None, None)

    def compact(self, table: str) -> None:
        """Write what holds as one generation and drop the older ones; no reader may be at work.

        A writer that commits in the meantime makes it fail without loss; none may be about to. The
        folders dropped are as many as there were writes since the last compaction.
        """
        since = self.log.version()
        old = [r["generation"] for r in self._stored(table).select("generation").distinct().collect()]
        with scratch(self.spark):
            held = self.live(table).select(KEY).distinct()
            rows, held = stage(self.read(table), "compacted"), stage(held, "held")
            self._commit(table, held, self._add(table, rows), REPLACE, since, None, compacts=True)
        for generation in old:
            for name in (table, *(PARTIALS if table == "reviews" else ())):
                remove_path(self.spark, f"{self.path(name)}/generation={generation}")

    def log_run(
        self, datasets: DataFrame, run_id: str, status: str, next_id: int, warnings: str = ""
    ) -> None:
        """Add one registry row per dataset."""
        entry = datasets.select(
            KEY,
            F.lit(run_id).alias("run_id"),
            F.lit(status).alias("status"),
            F.lit(warnings).alias("warnings"),
            F.lit(next_id).cast("long").alias("next_id"),
            F.current_timestamp().alias("ts"),
        )
        self.log.add({"kind": RUNS, "next_id": next_id}, entry.hint("rebalance"))

    def take_ids(self, count: int) -> int:
        """The first of ``count`` review ids that no other writer gets."""
        return self.log.add({"kind": IDS, "ids": count})

    def next_id(self) -> int:
        """First review id that no run has taken."""
        return self.log.next_id()

    def status(self, key: str) -> str:
        found = latest_status(self.read("dataset_runs", key)).first()
        return found["status"] if found else NOT_FOUND
