"""Packing of token pieces into sequences of bounded length by bin completion.

Only the number of pieces of each length reaches the driver: at most ``capacity`` rows, whatever
the size of the corpus. The search works on these counts and gives patterns, each with the number
of sequences filled that way; pieces then find their sequence by their rank among those of their
length.
"""

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedbackmill.llm.common import slices
from feedbackmill.llm.word_tokens import word_tokens
from feedbackmill.session import stage

#: Effort of the search, as lengths looked at over all its nodes, and fillings tried per sequence.
#: More can only save further sequences; every piece is packed at any effort.
SEARCH_EFFORT = 40_000
FILLINGS = 12

Pattern = tuple[int, ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces that can't share one."""
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    at_most, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half = capacity // 2
    small = np.arange(1, half + 2)
    # Longer than capacity - small: alone. Longer than half: apart. From small to half: in their room.
    alone, apart = at_most[-1] - at_most[capacity - small], at_most[capacity - small] - at_most[half]
    room = capacity * apart - (total[capacity - small] - total[half])
    short = total[half] - total[small - 1]
    by_size = alone + apart + np.maximum(0, -((room - short) // capacity))
    return int(max(-(-total[-1] // capacity), by_size.max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest piece first, each into the sequence it fills most; equal sequences are filled together."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # of sequences that aren't empty, in ascending order
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                filled = [((length,) * fits, left // fits)] if left >= fits else []
                filled += [((length,) * (left % fits), 1)] if left % fits else []
                left = 0
            else:
                room = rooms[at]
                pattern, n = open_by_room[room].pop()
                fits = room // length
                each = min(fits, max(1, left // n))
                used = min(n, left // each)
                filled = [(pattern + (length,) * each, used)]
                left -= each * used
                if used < n:
                    open_by_room[room].append((pattern, n - used))
                elif not open_by_room[room]:
                    rooms.pop(at)
            for pattern, n in filled:
                room = capacity - sum(pattern)
                held = open_by_room.setdefault(room, [])
                if not held:
                    insort(rooms, room)
                held.append((pattern, n))
    return [x for held in open_by_room.values() for x in held]


def fillings(counts: dict[int, int], capacity: int, limit: int) -> list[Pattern]:
    """Undominated fillings around the longest piece, by waste; at most ``limit``.

    A filling is dominated if one more piece fits, or if a longer piece can take the place of one
    or two of its pieces.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    ascending = lengths[::-1]
    found: list[tuple[int, Pattern]] = []
    steps = 40 * limit

    def dominated(chosen: list[int], room: int) -> bool:
        used, rest = Counter(chosen), chosen[1:]
        pairs = {a + b for i, a in enumerate(rest) for b in rest[i + 1 :]}

        def spare(above: int, most: int) -> bool:
            for n in ascending[bisect_left(ascending, above + 1) : bisect_left(ascending, most + 1)]:
                if counts[n] > used[n]:
                    return True
            return False

        return (
            spare(0, room) or any(spare(s, s + room) for s in set(rest))
            or any(spare(s - 1, s + room) for s in pairs)
        )

    def grow(chosen: list[int], room: int, at: int) -> None:
        nonlocal steps
        grew = False
        for i in range(max(at, len(lengths) - bisect_left(ascending, room + 1)), len(lengths)):
            length = lengths[i]
            if steps <= 0 or (found and len(found) >= limit and found[0][0] == 0):
                break
            if length <= room and counts[length] > chosen.count(length):
                steps -= 1
                grew = True
                grow([*chosen, length], room - length, i)
        if not grew and not dominated(chosen, room):
            found.append((room, tuple(chosen)))
            found.sort()

    grow([lengths[0]], capacity - lengths[0], 0)
    # What the limit on steps leaves: the longest that fits, again and again.
    chosen, room = [lengths[0]], capacity - lengths[0]
    for length in lengths:
        while length <= room and counts[length] > chosen.count(length):
            chosen.append(length)
            room -= length
    if all(tuple(chosen) != p for _, p in found):
        found.append((room, tuple(chosen)))
    return [p for _, p in sorted(found)[:limit]]


@dataclass
class _Search:
    capacity: int
    best: list[tuple[Pattern, int]]
    floor: int
    effort: int
    size: int = field(init=False)

    def __post_init__(self):
        self.size = sum(n for _, n in self.best)

    def run(self, counts: dict[int, int], total: int) -> None:
        """Depth first over the fillings of the longest piece, with a stack of open choices."""
        stack = [(counts, [], 0, 0)]
        while stack and self.effort > 0 and self.size > self.floor:
            counts, packed, used, waste = stack.pop()
            # A better packing may waste this much in all; what is wasted so far stays wasted.
            if waste > (self.size - 1) * self.capacity - total:
                continue
            self.effort -= len(counts)
            if not counts:
                self.best, self.size = packed, used
                continue
            rest = best_fit(counts, self.capacity)
            if used + sum(n for _, n in rest) < self.size:
                self.best, self.size = packed + rest, used + sum(n for _, n in rest)
            if used + lower_bound(counts, self.capacity) >= self.size:
                continue
            for pattern in reversed(fillings(counts, self.capacity, FILLINGS)):
                need = Counter(pattern)
                times = min(counts[n] // k for n, k in need.items())
                left = {n: c - times * need[n] for n, c in counts.items() if c > times * need[n]}
                lost = times * (self.capacity - sum(pattern))
                stack.append((left, [*packed, (pattern, times)], used + times, waste + lost))


def plan_packing(counts: dict[int, int], capacity: int, effort: int = SEARCH_EFFORT) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences each fills; every piece has its place.

    Branch and bound by bin completion, with the best-fit packing as the first incumbent. It ends
    when a packing meets the lower bound, when the ``FILLINGS`` of each node are searched, or after ``effort``.
    """
    counts = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("pieces must have 1 to capacity tokens")
    if not counts:
        return []
    search = _Search(capacity, best_fit(counts, capacity), lower_bound(counts, capacity), effort)
    search.run(counts, sum(n * c for n, c in counts.items()))
    return search.best


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id",
    text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: ids of the whole text and the end id, cut only if too long.

    Null and empty texts have the end id alone. ``part`` and ``nth`` number the pieces of a length
    within the task that made them; the table is staged, so the numbers stay.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"

    def cut(batches):
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), word_tokens(tokenizer)
        end, seen = np.array([end_id], np.uint32), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows: dict[str, list] = {c.split()[0]: [] for c in kinds.split(", ")} | {"ids": []}
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([tokens.encode(value), end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    raw = ids[start : start + capacity].tobytes()
                    length = len(raw) // 4
                    for name, cell in (
                        ("doc_id", key), ("piece", piece), ("start", start), ("length", length),
                        ("ids_crc32", zlib.crc32(raw)), ("part", part), ("nth", int(seen[length])),
                    ):
                        rows[name].append(cell)
                    if keep_ids:
                        rows["ids"].append(raw)
                    seen[length] += 1
            if not keep_ids:
                del rows["ids"]
            kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            schema = pa.schema([(c.split()[0], kind[c.split()[1]]) for c in fields])
            yield pa.RecordBatch.from_pydict(rows, schema)

    fields = kinds.split(", ") + ["ids binary"] * keep_ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(cut, ", ".join(fields)), "pieces")


def pack_pieces(pieces: DataFrame, capacity: int, effort: int = SEARCH_EFFORT) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless from 0 in each sequence."""
    by_length = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    keys, firsts, bases, offsets = [], [], [], []
    ranks, sequence = Counter(), 0
    for pattern, times in plan_packing(by_length, capacity, effort):
        offset = 0
        for length in pattern:
            keys.append(length)
            firsts.append(ranks[length])
            bases.append(sequence)
            offsets.append(offset)
            ranks[length] += times
            offset += length
        sequence += times
    order = np.lexsort((firsts, keys)) if keys else np.zeros(0, int)
    keys, firsts, bases, offsets = (np.array(x, np.int64)[order] for x in (keys, firsts, bases, offsets))

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            # Runs are sorted by length and first rank, so a piece's run is the last that begins by it.
            at = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                a, b = np.searchsorted(keys, [length, length + 1])
                at[mine] = a + np.searchsorted(firsts[a:b], ranks[mine], side="right") - 1
            sequences = bases[at] + ranks - firsts[at]
            yield batch.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets[at]))

    so_far = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        pieces.groupBy("part", "length").count()
        .select("part", "length", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("before"))
    )
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select(*pieces.columns, "rank").drop("part", "nth")
    schema = f"{', '.join(f'{n} {t}' for n, t in ranked.dtypes)}, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).drop("rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces that kept theirs; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.expr("transform(parts, p -> struct(p.doc_id, p.piece, p.offset, p.length))").alias("pieces"),
        F.expr("aggregate(parts, cast('' as binary), (s, p) -> concat(s, p.ids))").alias("ids"),
    )
