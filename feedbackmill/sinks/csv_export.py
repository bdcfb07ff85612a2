"""CSV export of a result."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _export_text(df: DataFrame, name: str) -> Column:
    """Value as text: null is the word null, a whole double has no decimals."""
    value = F.col(f"`{name}`")
    text = value.cast("string")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        whole = (F.floor(value) == value) & (F.abs(value) < F.lit(1e15))
        text = F.when(whole, value.cast("long").cast("string")).otherwise(text)
    return F.coalesce(text, F.lit("null")).alias(name)


def export_csv(df: DataFrame, path: str) -> bool:
    """Write every value quoted, quotes doubled, under a header; an empty result writes nothing."""
    if df.isEmpty():
        return False
    (
        df.select(*[_export_text(df, name) for name in df.columns])
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return True
