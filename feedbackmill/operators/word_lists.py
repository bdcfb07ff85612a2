"""Words of texts on Arrow batches: most texts are cut in one go over their bytes, the others by Spark's own patterns.

A text is plain if it has no signs from U+0180 on and no U+0130: lower case and the kinds of its signs are
then the same everywhere, and each sign is one or two bytes before and after. Other texts bring their words along.
"""

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_PLAIN = r"[^\x{0}-\x{12f}\x{131}-\x{17f}]"
_SIGNS = [chr(i) for i in range(0x180)]
_LOWER = np.array([i if i == 0x130 else ord(c.lower()) for i, c in enumerate(_SIGNS)])
_IN_WORD = np.array([c == "_" or unicodedata.category(c)[0] in "LN" for c in _SIGNS])
_LOWER_BYTE = np.array([_LOWER[i] if i < 0x80 else i for i in range(256)], np.uint8)
_NUMBERS = "".join(c for c in _SIGNS if unicodedata.category(c)[0] == "N")
_APOSTROPHE = ord("'")


def plain_or_words(text: Column, words: Column) -> list[Column]:
    """``text`` where it is plain, and ``words``, which Spark finds in it, where it is not."""
    plain = ~text.rlike(_NOT_PLAIN)
    return [F.when(plain, text).alias("plain"), F.when(~plain, words).alias("words")]


def _plain_words(texts: pa.StringArray, apostrophes: bool) -> tuple[np.ndarray, pa.StringArray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    inside = np.zeros(256, bool)
    inside[:0x80] = _IN_WORD[:0x80]
    inside[_APOSTROPHE] = apostrophes
    inside, lower = inside[data], _LOWER_BYTE[data]
    leads = np.flatnonzero(data >= 0xC0)
    signs = (data[leads].astype(np.int64) & 0x1F) << 6 | data[leads + 1] & 0x3F
    inside[leads] = inside[leads + 1] = _IN_WORD[signs]
    lower[leads], lower[leads + 1] = 0xC0 | _LOWER[signs] >> 6, 0x80 | _LOWER[signs] & 0x3F
    # A word begins and ends where the kind of sign changes or a text does.
    edge = np.ones(size + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    places = np.flatnonzero(edge)
    runs = np.flatnonzero(inside[places[:-1]])
    first, last = places[runs], places[runs + 1]
    while apostrophes and (led := (first < last) & (data[np.minimum(first, size - 1)] == _APOSTROPHE)).any():
        first = first + led
    signs = last - first
    two = signs == 2
    kept = (signs > 2) | (two & (data[np.minimum(first, size - 1)] < 0x80))
    first, last = first[kept], last[kept]
    change = np.zeros(size + 1, np.int8)
    change[first] += 1
    change[last] -= 1
    taken = lower[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(taken))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, offsets))), words


def _cloud_forms(rows: np.ndarray, words: pa.StringArray) -> tuple[np.ndarray, pa.Array]:
    """Words without possessive endings, and without bare numbers."""
    words = words.dictionary_encode()
    forms = words.dictionary
    forms = pc.if_else(pc.ends_with(forms, "'s"), pc.utf8_slice_codeunits(forms, 0, -2), forms)
    kept = pc.invert(pc.match_substring_regex(forms, f"^[{_NUMBERS}]+$")).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
    return rows[kept], forms.take(words.indices.filter(pa.array(kept)))


def row_words(batch: pa.RecordBatch | pa.Table, cloud: bool = False) -> tuple[np.ndarray, pa.Array]:
    """The words of a batch with the columns of :func:`plain_or_words`: the row of each, and the words in order.

    Words of one row stand together. They are lower-case runs of two or more letters, digits and underscores, as
    ``feature_tokens`` finds them, or, with ``cloud``, those of the word clouds.
    """
    plain, given = (c.combine_chunks() if isinstance(c := batch.column(n), pa.ChunkedArray) else c for n in ("plain", "words"))
    rows, words = _plain_words(plain.fill_null(""), cloud)
    if cloud:
        rows, words = _cloud_forms(rows, words)
    if given.null_count < len(given):
        lengths = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False)
        rows = np.concatenate([rows, np.repeat(np.arange(len(given)), lengths)])
        words = pa.concat_arrays([words, given.flatten()])
    return rows, words
