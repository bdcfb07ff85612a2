"""Running sums along sorted groups, without sending a group to one task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.session import stage

#: Sums are taken modulo this power of two, so that hashes can be summed, too.
BITS = 61
_MASK = (1 << BITS) - 1


def running_sums(rows: DataFrame, group: str, order: list, sums: list[str]) -> DataFrame:
    """``rows`` with run_<c> for each long column c in ``sums``; ``group`` is long and never null.

    run_<c> is the sum of c over the rows of the group up to and with this one in the given order,
    modulo 2^61; rows that tie in the order are added in any sequence. All rows are range-sorted and
    summed in each task. Of every task the driver sees the first and the last group only, and tells
    the next ones what came before.
    """
    names = [f"run_{c}" for c in sums]
    made = [(n, "long") for n in (*names, "_part", "_at")]
    schema = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, *made])

    def scan(batches):
        from pyspark import TaskContext

        part, at, last, carried = TaskContext.get().partitionId(), 0, None, [np.uint64(0)] * len(sums)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            mine = np.repeat(np.arange(len(begins)), np.diff([*begins, size]))
            runs = []
            for i, c in enumerate(sums):
                total = np.r_[np.uint64(0), np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))]
                before = total[begins]
                if groups[0] == last:
                    before[0] -= carried[i]
                run = (total[1:] - before[mine]) & np.uint64(_MASK)
                carried[i] = run[-1]
                runs.append(pa.array(run.view(np.int64)))
            last = groups[-1]
            runs += [pa.array(np.full(size, part, np.int64)), pa.array(np.arange(at, at + size, dtype=np.int64))]
            at += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *runs], [*batch.schema.names, *(n for n, _ in made)])

    summed = stage(rows.orderBy(group, *order).mapInArrow(scan, schema), "running")
    ends = summed.groupBy("_part").agg(
        F.min(group).alias("first"), F.max(group).alias("last"), *(F.max_by(n, "_at").alias(n) for n in names)
    )
    offsets, before = [], None
    for end in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row per task
        goes_on = before is not None and before[0] == end["first"]
        if goes_on:
            offsets.append((end["_part"], *before))
        own = [end[n] for n in names]
        if goes_on and end["first"] == end["last"]:
            own = [(a + b) & _MASK for a, b in zip(own, before[1:], strict=True)]
        before = (end["last"], *own)
    if not offsets:
        return summed.drop("_part", "_at")
    columns = ["_part", "_group", *(f"_{n}" for n in names)]
    earlier = rows.sparkSession.createDataFrame(offsets, ", ".join(f"{c} long" for c in columns))
    joined = summed.join(F.broadcast(earlier.withColumnRenamed("_part", "_of")), (F.col("_part") == F.col("_of")) & (F.col(group) == F.col("_group")), "left")
    whole = {n: (F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).bitwiseAND(F.lit(_MASK)) for n in names}
    return joined.withColumns(whole).select(*rows.columns, *names)
