"""Exact duplicates by progressive refinement: equal length, then equal beginning, then equal hash.

Each level looks at the rows only that the level before has left in a group of two or more. What a
level leaves is told to the next one by a bitmap of fixed size, so that texts are never shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.llm.bitmap import only_survivors, survivors
from feedbackmill.llm.hot_join import join_groups
from feedbackmill.session import stage

#: Characters of a text's beginning that the second level compares.
PREFIX_CHARS = 128
# Fixed value: the white space that counts as one space.
_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_unique: bool = False
) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same with each run of white space as one space; null is empty.
    Of a group of equal texts the row with the smallest doc_id stays, of several rows of that id one
    of them. A null id is smallest only if nothing else is in the group, so that ``keep_id`` is null.
    Repeated rows come back each, other columns are ignored, an empty table gives no rows.

    Lengths and beginnings are read in a first pass. The second reads contents and hashes them, but
    only of texts whose length and beginning are found twice; ``text_sha256`` of others is null,
    unless ``hash_unique`` asks for it. The bitmaps between levels let through some rows too many
    when they are full, never one too few, and groups are formed by full keys.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("_text"))
    size, head = F.octet_length("_text").alias("size"), F.xxhash64(F.substring("_text", 1, PREFIX_CHARS)).alias("head")
    heads = stage(rows.select(size, head), "heads")
    sizes = survivors(_repeated(heads, ["size"]), ["size"])
    alike = only_survivors(heads, sizes, ["size"]).where("survives")
    suspects = stage(survivors(_repeated(alike, ["size", "head"]), ["size", "head"]), "suspects")

    marked = only_survivors(rows.select("doc_id", "_text", size, head), suspects, ["size", "head"])
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    hashed = marked.select(
        "doc_id", "size", "survives",
        (digest if hash_unique else F.when(F.col("survives"), digest)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    hashed = stage(hashed, "hashes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    again = hashed.where("survives").groupBy("size", "text_sha256").agg(first, F.count("*").alias("n"))
    named = again.select("size", "text_sha256", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    groups, total = stage(named, "groups"), hashed.count()
    found = join_groups(hashed.where("survives"), groups, ["size", "text_sha256"], "n", total)
    found = found.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    alone = hashed.where("not survives").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256",
    )
    return found.unionByName(alone)
