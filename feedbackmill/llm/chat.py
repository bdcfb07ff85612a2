"""Chat formatting by token-level assembly.

Roles and texts are encoded apart from each other, and reserved ids that no text can give are
spliced between them. The loss mask is the running sum of marks where masked stretches begin and
end. Strings that look like control strings of some chat format are escaped in texts, reversibly.
"""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.llm.common import slices, worker_store

#: Reserved ids stand right after the vocabulary, in this order; so they are written in plain text.
MARKS = ("<|conversation|>", "<|role|>", "<|text|>", "<|end|>")
#: Control strings of other formats that texts may hold.
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
LOSS_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double the escape character, and put one behind the first character of control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class ChatTokens:
    """Byte-level ids of the vocabulary in ``path``; marks have the ids after it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1

    def mark(self, name: str) -> int:
        return self.first + MARKS.index(name)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn. The mask covers a text to be learned and its end mark."""
        said = [self.encoding.encode_ordinary(escape(t)) for t in (role, text)]
        parts = [[self.mark("<|role|>")], said[0], [self.mark("<|text|>")], said[1], [self.mark("<|end|>")]]
        edges = np.cumsum([0, *map(len, parts)])
        steps = np.zeros(edges[-1] + 1, np.int8)
        if role == LOSS_ROLE:
            steps[edges[3]] += 1
            steps[edges[5]] -= 1
        return np.concatenate([np.array(p, np.int32) for p in parts]), np.cumsum(steps[:-1]) > 0

    def render(self, ids: np.ndarray) -> list[str]:
        """The marks and the escaped texts between them, in order."""
        cuts = np.flatnonzero(ids >= self.first)
        shown, at = [], 0
        for cut in [*cuts.tolist(), len(ids)]:
            if cut > at:
                shown.append(self.encoding.decode_bytes(ids[at:cut].tolist()).decode())
            if cut < len(ids):
                shown.append(MARKS[ids[cut] - self.first])
            at = cut + 1
        return shown


def chat_tokens(path: str, pattern: str) -> ChatTokens:
    store = worker_store("chat tokens")
    if path not in store:
        store[path] = ChatTokens(path, pattern)
    return store[path]


def encode_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, mark (a hash of the text), ids and mask of each row, encoded where it lies.

    Null role and text are empty.
    """

    def encode(batches):
        tokens = chat_tokens(path, pattern)
        for batch in slices(batches, "text"):
            pairs = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            made = [tokens.turn(r, t) for r, t in pairs]
            sizes = pa.array(np.cumsum([0, *(len(i) for i, _ in made)]), pa.int32())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("conv_id", "turn", "role", "mark")},
                "ids": pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([i for i, _ in made]), pa.int32())),
                "mask": pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([m for _, m in made]))),
            })

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("mark", F.md5(F.col("text").cast("binary")))
    return rows.mapInArrow(encode, "conv_id long, turn long, role string, mark string, ids array<int>, mask array<boolean>")


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(values, (column.offsets.to_numpy()[1:-1] - column.offsets[0].as_py()))


def _assemble(batches, tokens: ChatTokens):
    """Turns sorted by conversation, as (conv_id, nth, start, ids, mask); the first turn opens it."""
    conversation, nth, start = (), 0, 0
    opening, unmasked = np.array([tokens.mark("<|conversation|>")], np.int32), np.zeros(1, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        for key, ids, mask in zip(batch.column("conv_id").to_pylist(), _lists(batch, "ids"), _lists(batch, "mask"), strict=True):
            if (key,) != conversation:
                conversation, nth, start = (key,), 0, 0
                ids, mask = np.concatenate([opening, ids]), np.concatenate([unmasked, mask])
            yield key, nth, start, ids, mask
            nth, start = nth + 1, start + len(ids)


def _sorted(encoded: DataFrame) -> DataFrame:
    order = ("conv_id", "turn", "role", "mark")
    return encoded.repartition("conv_id").sortWithinPartitions(*order)


def format_conversations(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """The formatted conversations, a row per turn: conv_id, nth, start, ids, mask.

    A conversation's output is that of its rows by ``nth``, one after the other; ``start`` is the
    place of a row's first id. Turns go by ``turn``, nulls first, ties by role and then by a hash of the text.
    Rows of a null conv_id are one conversation. All rows are kept, other columns are ignored, and a
    conversation may have any number of turns: tasks hold one Arrow batch at a time.
    """

    def assemble(batches):
        rows = []

        def batch():
            names = ("conv_id", "nth", "start", "ids", "mask")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], list(names)
            )

        for row in _assemble(batches, chat_tokens(path, pattern)):
            rows.append(row)
            if len(rows) >= 256:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    schema = "conv_id long, nth long, start long, ids array<int>, mask array<boolean>"
    return _sorted(encode_turns(turns, path, pattern)).mapInArrow(assemble, schema)


class _Reading:
    """What is read back from the output of a conversation, row by row."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.formatted = key, 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, tokens: ChatTokens, ids: np.ndarray, mask: np.ndarray) -> None:
        shown = tokens.render(ids)
        self.formatted += sum(map(len, shown))
        texts, place = {"<|role|>": "", "<|text|>": ""}, None
        for part in shown:
            if part in MARKS:
                place = part
            else:
                texts[place] = unescape(part)
        self.turns += 1
        self.said.update(f"{texts['<|role|>']}\n{texts['<|text|>']}\n".encode())
        learned = ids[mask & (ids < tokens.first)]
        text = unescape(tokens.encoding.decode_bytes(learned.tolist()).decode())
        self.loss_chars += len(text)
        self.learned.update(text.encode())

    def row(self):
        return self.key, self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.formatted


def conversation_digest(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation, read back from its formatted ids and mask: turns, digests and lengths.

    Digests run along the sorted turns and hold no conversation as a whole. Only their updates are
    bound to one task per conversation; encoding is done before, wherever the rows lie.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def read(batches):
        tokens, now, done = chat_tokens(path, pattern), None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], list(names))

        for key, nth, _, ids, mask in _assemble(batches, tokens):
            if not nth:
                if now:
                    done.append(now.row())
                now = _Reading(key)
            now.add(tokens, ids, mask)
            if len(done) >= 1024:
                yield batch()
                done.clear()
        if now:
            done.append(now.row())
            yield batch()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _sorted(encode_turns(turns, path, pattern)).mapInArrow(read, schema)
