"""Near duplicates by SimHash: fingerprints, BK-trees over shards of them, connected classes.

Two fingerprints that differ in at most three bits agree in two of five blocks of bits at least, so
each of the ten pairs of blocks deals fingerprints into shards, and similar ones meet in a shard.
A BK-tree is built per shard. Large shards are split into parts; the tree of each part is handed to
the tasks of all parts that search it. Trees are not broadcast: together they hold all fingerprints,
whose number has no bound.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.llm.bitmap import only_survivors, survivors
from feedbackmill.llm.common import slices
from feedbackmill.llm.components import components
from feedbackmill.llm.hot_join import join_groups, without_groups
from feedbackmill.session import stage

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a shard's part; larger shards get more parts.
PART = 4096
#: Shingles hashed at once.
_BLOCK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text; zero for null and for texts without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : min(at + _BLOCK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(min(shingle, len(words))))))
        hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], "<u8").view(np.uint8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(hashes[k::8], minlength=256) @ _BITS
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _mark(text: Column) -> Column:
    """A hash that tells texts of one id, or of none, apart."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """doc_id and the signed fingerprint of each row, if asked a mark of its text; other columns are ignored."""
    kept = ["doc_id", "mark"] if marked else ["doc_id"]

    def hashed(batches):
        for batch in slices(batches, "text"):
            found = [fingerprint(t) for t in batch.column("text").to_pylist()]
            columns = {c: batch.column(c) for c in kept}
            yield pa.RecordBatch.from_pydict({**columns, "fp": pa.array(found, pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    schema = "doc_id long, mark string, fp long" if marked else "doc_id long, fp long"
    return rows.select(*kept, "text").mapInArrow(hashed, schema)


class BKTree:
    """A tree of distinct 64-bit values: children hang by their Hamming distance to the parent."""

    def __init__(self, values: np.ndarray):
        """The first value is the root; each child takes all values at its distance, and so on."""
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        pending = [(0, np.arange(1, len(values)))] if len(values) else []
        while pending:
            node, below = pending.pop()
            if not len(below):
                continue
            distance = np.bitwise_count(values[below] ^ values[node])
            order = np.argsort(distance, kind="stable")
            below, distance = below[order], distance[order]
            firsts = np.flatnonzero(np.diff(distance, prepend=-1))
            for a, b in zip(firsts, [*firsts[1:], len(below)], strict=True):
                self.children[node][int(distance[a])] = int(below[a])
                pending.append((int(below[a]), below[a + 1 : b]))

    def search(
        self, queries: np.ndarray, radius: int, enough: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) positions of the pairs within the radius.

        All queries walk together; to a child go those whose distance to the parent differs from
        the child's edge by the radius at most. A query that has met a value marked in ``enough``
        walks no further.
        """
        hits_q, hits_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        done = np.zeros(len(queries), bool)
        pending = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while pending:
            node, mine = pending.pop()
            if enough is not None:
                mine = mine[~done[mine]]
                if not len(mine):
                    continue
            distance = np.bitwise_count(queries[mine] ^ self.values[node]).astype(np.int64)
            near = mine[distance <= radius]
            if len(near):
                hits_q.append(near)
                hits_v.append(np.full(len(near), node))
                if enough is not None and enough[node]:
                    done[near] = True
            for edge, child in self.children[node].items():
                rest = mine[np.abs(distance - edge) <= radius]
                if len(rest):
                    pending.append((child, rest))
        return np.concatenate(hits_q), np.concatenate(hits_v)


class _Sets:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def linked_classes(values: np.ndarray, queries: np.ndarray | None, radius: int, batch: int = 256) -> np.ndarray:
    """For each value, and after them for each query, the position of the first of its class.

    Classes come from links between the two sides; without queries, the values ask themselves.
    After a first batch most of a dense shard is one class, and one link to that class is enough:
    later queries stop there, and seek the values outside of it in a tree of their own.
    """
    alone, n = queries is None, len(values)
    asked = values if alone else queries
    first = 0 if alone else n  # position of the first query
    sets, tree = _Sets(first + len(asked)), BKTree(values)
    q, v = tree.search(asked[:batch], radius)
    sets.join(q + first, v)
    if len(asked) > batch:
        roots = sets.roots()
        names, sizes = np.unique(roots, return_counts=True)
        largest = roots[:n] == names[np.argmax(sizes)]
        outside = np.flatnonzero(~largest)
        small = BKTree(values[outside])
        for at in range(batch, len(asked), batch):
            mine = asked[at : at + batch]
            q, v = tree.search(mine, radius, largest)
            sets.join(q + first + at, v)
            q, v = small.search(mine, radius)
            sets.join(q + first + at, outside[v])
    return sets.roots()


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in range(a, e)) for a, e in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_keys(fp: Column, radius: int = RADIUS) -> Column:
    """The shards of a fingerprint: what it holds in each choice of two out of radius + 2 blocks."""
    masks = [_signed(a | b) for a, b in combinations(_block_masks(radius + 2), 2)]
    return F.array(*(
        F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("held")) for i, m in enumerate(masks)
    ))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the radius of each other.

    Each shard gives one link per fingerprint at most, to the smallest of its class there, not all
    pairs. Shards of one fingerprint are dropped before anything is sent to them.
    """
    keyed = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("choice", "held").count().where("count > 1")
    parts = F.ceil(F.col("count") / PART).cast("int")
    met = keyed.join(sizes, ["choice", "held"]).select("choice", "held", "fp", parts.alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A part meets itself and each other part once: the lower one's tree, the higher one's queries.
    meetings = met.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = meetings.select(
        "choice", "held", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") <= F.col("other")).alias("tree"), "fp",
    )
    group = ["choice", "held", "low", "high"]

    def join(batches):
        def finish(key, tree, asked):
            if key is None:
                return None
            values, alone = np.concatenate(tree), key[2] == key[3]
            queries = None if alone else np.concatenate(asked)
            if len(values) < 1 + alone or (not alone and not len(queries)):
                return None
            everything = values if alone else np.concatenate([values, queries])
            roots = linked_classes(values, queries, radius)
            linked = everything != everything[roots]
            pairs = np.unique(np.stack([everything[linked], everything[roots[linked]]], 1), axis=0)
            if not len(pairs):
                return None
            return pa.RecordBatch.from_pydict({
                "a": pa.array(pairs[:, 0].view(np.int64)), "b": pa.array(pairs[:, 1].view(np.int64)),
            })

        key, tree, asked = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in group], 1)
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            is_tree = batch.column("tree").to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for a, b in zip(firsts, [*firsts[1:], len(keys)], strict=True):
                mine = tuple(keys[a])
                if mine != key:
                    if (found := finish(key, tree, asked)) is not None:
                        yield found
                    key, tree, asked = mine, [], []
                tree.append(values[a:b][is_tree[a:b]])
                asked.append(values[a:b][~is_tree[a:b]])
        if (found := finish(key, tree, asked)) is not None:
            yield found

    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "fp")
    return ordered.mapInArrow(join, "a long, b long")


def _named_classes(rows: DataFrame, radius: int) -> DataFrame:
    """fp, class (the smallest fingerprint of its class), component_id of each fingerprint in ``rows``."""
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius), "fp", "class")
    in_class = roots.join(classes, "fp")
    firsts = in_class.groupBy("class").agg(F.min("first").alias("least"))
    least = in_class.join(firsts, "class").select("fp", "class", "least")
    named = classes.join(least, "fp", "left").select(
        "fp", F.coalesce("class", "fp").alias("class"), F.coalesce("least", "first").alias("component_id")
    )
    return stage(named, "named-classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, signed fp, component_id of every row: the smallest id that links lead to.

    Documents link if their fingerprints differ in ``radius`` bits at most; equal ones always do,
    so null, empty and blank texts, all with fingerprint zero, are one class. Repeated rows come
    back each. A null id is no class's smallest unless nothing else is in the class.
    """
    rows = stage(fingerprints(docs, doc_id, text), "fingerprints")
    return rows.join(_named_classes(rows, radius), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, with all its columns: that with the smallest id.

    Of repeated rows of that id in the class the one with the largest columns, in their order,
    stays. A class in which no row has an id keeps one row, too. Rows are told apart by id and
    text, so an id that stands for several texts loses none, if they lie in classes of their own.
    Rows are chosen by id and a hash of the text; only texts of rows that go, or of which columns must
    decide, are moved.
    """
    rows = stage(fingerprints(docs, doc_id, text, marked=True), "fingerprints")
    classes = rows.join(_named_classes(rows, radius), "fp")
    texts = classes.groupBy("doc_id", "mark").agg(
        F.max("class").alias("class"), F.max("component_id").alias("component_id"), F.count("*").alias("n")
    )
    texts = stage(texts, "texts")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Rows of a class among which columns must decide, as several have its smallest id.
    rivals = texts.where(first).groupBy("class").agg(F.sum("n").alias("rivals")).where("rivals > 1")
    fates = texts.join(rivals, "class", "left").where(~first | F.col("rivals").isNotNull())
    key = ["_none", "_id", "_mark"]
    fates = stage(fates.select(
        F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark"),
        F.when(first, F.col("class")).alias("_class"), F.col("n").alias("_n"),
    ), "fates")
    packed = docs.select(
        F.col(doc_id).isNull().alias("_none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_id"),
        _mark(F.col(text)).alias("_mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
    )
    # Rows that stay for sure stay where they lie; a bitmap tells them from the others.
    told = only_survivors(packed, survivors(fates, key), key, "_told")
    moved, total = told.where("_told"), rows.count()
    decided = join_groups(moved, fates.where("_class is not null"), key, "_n", total).groupBy("_class").agg(F.max("_row").alias("_row"))
    kept = told.where("not _told").select("_row").unionByName(decided.select("_row"))
    return kept.unionByName(without_groups(moved, fates, key, "_n", total).select("_row")).select("_row.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
