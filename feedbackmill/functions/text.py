"""Text columns: cleaning, tokens, lengths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Python's \s (str patterns) and of JavaScript's \s, as the inside
# of a pattern class. \p{Z} holds the space separators, the plain space among them.
PY_SPACE = r"\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\p{Z}"
JS_SPACE = r"\x{9}-\x{d}\x{feff}\p{Z}"

# Stop list of the top-words chart.
CHART_STOP_WORDS = (
    "the", "and", "to", "a", "was", "is", "of", "it", "in", "for", "that", "i", "this", "but",
    "they", "with", "on", "you", "have", "we", "are", "so", "not", "very", "my", "as", "at", "be",
    "had", "food", "place", "good", "great", "service", "there", "were", "which", "just", "like",
    "can",
)


def clean_text(text: Column) -> Column:
    """Null becomes empty; runs of white space become one space; ends are stripped."""
    # A single plain space needs no change, so the pattern passes over it.
    runs = f"[{PY_SPACE}]{{2,}}|[{PY_SPACE}&&[^ ]]"
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), runs, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; null counts as empty."""
    encoded = F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")
    return F.shiftright(F.octet_length(encoded), 1).cast("long")


def letters_only(text: Column) -> Column:
    """Lower case with everything but a-z and white space deleted (not replaced)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^a-z{JS_SPACE}]+", "")


def chart_tokens(text: Column) -> Column:
    """All white-space separated tokens of the letters-only text."""
    return F.filter(F.split(letters_only(text), f"[{JS_SPACE}]+"), lambda w: w != "")


def chart_words(text: Column) -> Column:
    """The tokens of :func:`chart_tokens` that have more than three letters."""
    return F.regexp_extract_all(letters_only(text), F.lit("[a-z]{4,}"), F.lit(0))


def cloud_tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more signs, apostrophes kept inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_']+"), F.lit(0))


def feature_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
