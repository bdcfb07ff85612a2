"""A trie of conversation prefixes, built as a z-fast trie.

Every prefix of a conversation has a hash. A compacted node, an edge of the trie with its lower end, is
found by the hash of one prefix only: its handle, the prefix at the two-fattest depth on the edge, that
is the depth there with the most trailing zero bits. So the place where a conversation leaves the trie
is found by probes at ever less even depths, the fat binary search, which all conversations do at once.
Those which leave at one place with one next turn are a batch. A small batch is inserted by one task, one
conversation after the other; a large one sends one conversation into the trie, and the others go on
from it. At the end, the edges are expanded into the nodes of single turns.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.llm.hot_join import join_groups
from feedbackmill.llm.running import running_sums
from feedbackmill.session import stage

#: Conversations of one group begin as their first one does, up to OWN_FROM - 1 turns.
GROUP, OWN_FROM = 20, 4
#: Conversations and turns of a batch that one task inserts.
BATCH_CONVERSATIONS, BATCH_TURNS = 1000, 50_000
#: Depths of an edge that are expanded from one row.
_CHUNK = 4096
_WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = hashlib.sha256().hexdigest()


def _zeros(depth: Column | str) -> Column:
    """Trailing zero bits of a depth."""
    bits = F.bin(depth)
    return F.length(bits) - F.length(F.rtrim(bits, F.lit("0")))


def two_fattest(above: Column, below: Column) -> Column:
    """The depth in (above, below] with the most trailing zero bits."""
    shift = F.length(F.bin(above.bitwiseXOR(below))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", below, shift), shift)


def own_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), words and a, b, a hash of role and text, of each row.

    Rows go by turn, nulls first, then by role and a hash of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(text.cast("binary")).alias("mark"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        *(F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(c) for c, at in (("a", 1), ("b", 16))),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"),
    )
    # Equal rows may be many; the number of the row spreads them and says nothing else.
    numbered = running_sums(rows, "conv", [F.asc_nulls_first("turn"), "role", "mark", "tie"], ["one"])
    return numbered.select("conv", (F.col("run_one") - 1).alias("pos"), "words", "a", "b")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth from 1, words, a, b) after sharing beginnings.

    Conversation c has the first h turns of c - c % GROUP, or all if those are fewer, and then its own
    after its first h; h is the unsigned crc32 of c in decimal digits modulo OWN_FROM.
    """
    sizes = stage(own.groupBy("conv").agg(F.count("*").alias("size")), "sizes")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % OWN_FROM).cast("long")
    based = sizes.select("conv", "size", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = sizes.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = based.join(bases, "base", "left").withColumn("taken", taken)
    convs = stage(convs.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "conversations")
    # A group has a bounded number of conversations, and each takes OWN_FROM - 1 turns at most.
    firsts = own.where((F.col("conv") % GROUP == 0) & (F.col("pos") < OWN_FROM - 1)).withColumnRenamed("conv", "base")
    shared = convs.select("conv", "base", "h").join(firsts, "base").where("pos < h")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rest = join_groups(own.where(F.col("pos") >= h), convs.select("conv", "size", "h", "taken"), ["conv"], "size", total)
    columns = ("words", "a", "b")
    turns = shared.select("conv", (F.col("pos") + 1).alias("depth"), *columns).unionByName(
        rest.select("conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), *columns)
    )
    return convs.select("conv", "length"), turns


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, p1, p2 (hash of the prefix of that many turns), words, w (words so far), level.

    A prefix's hash is the sum of its turns' hashes, each made with its depth; so it comes from sums
    along the sorted turns. ``level`` is the number of trailing zero bits of the depth, and the table is
    stored by it: each step of a search reads its own level.
    """
    keyed = turns.select("conv", "depth", "words", F.xxhash64("depth", "a", "b").alias("k1"), F.xxhash64("b", "depth", "a").alias("k2"))
    summed = running_sums(keyed, "conv", ["depth"], ["k1", "k2", "words"])
    named = summed.select(
        "conv", "depth", F.col("run_k1").alias("p1"), F.col("run_k2").alias("p2"), "words", F.col("run_words").alias("w"),
        _zeros("depth").alias("level"),
    )
    return stage(named, "prefixes", "level")


def _at(table: DataFrame, conv: str, depth: str, **names: str) -> DataFrame:
    """The prefix table to be joined on ``conv`` and ``depth``, with columns renamed."""
    return table.select(F.col("conv").alias(conv), F.col("depth").alias(depth), *(F.col(c).alias(n) for c, n in names.items()))


def _described(bare: DataFrame, table: DataFrame) -> DataFrame:
    """Nodes (rep, p, e), which reach from below depth p down to e on the path of conversation rep, with
    the hashes at their parent (q), below it (m), at their handle (f) and lower end (e), and words there."""
    ends = {"q": F.col("p"), "m": F.col("p") + 1, "f": two_fattest(F.col("p"), F.col("e")), "e": F.col("e")}
    asked = bare.select("rep", "p", "e", F.explode(F.array(*(
        F.struct(F.lit(k).alias("kind"), d.alias("depth")) for k, d in ends.items()
    ))).alias("at")).select("rep", "p", "e", "at.*")
    met = asked.join(_at(table, "rep", "depth", p1="p1", p2="p2", w="w"), ["rep", "depth"], "left")

    def one(kind, column):
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    return met.groupBy("rep", "p", "e").agg(
        F.max(F.when(F.col("kind") == "f", F.col("depth"))).alias("f"), one("q", "w").alias("wp"), one("e", "w").alias("we"),
        *(one(kind, f"p{i}").alias(f"{kind}{i}") for kind in ends for i in (1, 2)),
    )


def fat_search(strings: DataFrame, nodes: DataFrame, table: DataFrame, levels: int) -> DataFrame:
    """x, length, and the node last met: its depths gp and a, its hash g1, g2 and its conversation grep.

    Level by level, the depth in (a, b) that is a multiple of 2^level, if there is one, is probed. A hit is
    a node; the search goes on below it. A miss bounds it from below. Nodes that the conversation
    follows to their ends are never passed by; whether it does so with the last one is for the caller to
    check, as it is known there only. No node met is depth 0.
    """
    none = F.lit(None).cast("long")
    state = strings.select(
        "x", "length", F.lit(0).cast("long").alias("a"), (F.col("length") + 1).alias("b"),
        *(none.alias(c) for c in ("g1", "g2", "gp", "grep")),
    )
    for level in reversed(range(levels)):
        last = F.col("b") - 1
        fat = F.call_function("shiftleft", F.call_function("shiftright", last, F.lit(level)), F.lit(level))
        asks = fat > F.col("a")
        # Those without a probe get a depth that nobody has, so that they are spread over the tasks.
        state = state.withColumn("f", F.when(asks, fat).otherwise(F.lit(-1)))
        of_level = table.where(F.col("level") == level)
        state = state.join(_at(of_level, "x", "f", p1="y1", p2="y2"), ["x", "f"], "left")
        state = state.withColumn("y1", F.coalesce("y1", "x"))
        handles = nodes.where(_zeros("f") == level).select(
            "f", F.col("f1").alias("y1"), F.col("f2").alias("y2"), F.col("e").alias("to"), F.col("e1").alias("t1"),
            F.col("e2").alias("t2"), F.col("p").alias("tp"), F.col("rep").alias("trep"),
        )
        state = state.join(handles, ["f", "y1", "y2"], "left")
        hit = F.col("to").isNotNull()
        state = state.select(
            "x", "length", F.when(hit, F.col("to")).otherwise(F.col("a")).alias("a"),
            F.when(hit, F.greatest(F.col("b"), F.col("to") + 1)).when(F.col("f") > 0, F.col("f")).otherwise(F.col("b")).alias("b"),
            *(F.when(hit, F.col(t)).otherwise(F.col(g)).alias(g) for t, g in (("t1", "g1"), ("t2", "g2"), ("tp", "gp"), ("trep", "grep"))),
        )
    return state.drop("b")


def _exits(strings: DataFrame, nodes: DataFrame | None, table: DataFrame, levels: int) -> DataFrame:
    """x, length, s (the depth at which x leaves the trie), and the node it leaves: rep, p, e, null below a node's end."""
    none = F.lit(None).cast("long")
    if nodes is None:
        return strings.select("x", "length", F.lit(0).cast("long").alias("s"), *(none.alias(c) for c in ("rep", "p", "e")))
    met = fat_search(strings, nodes, table, levels)
    met = met.join(_at(table, "x", "a", p1="h1", p2="h2"), ["x", "a"], "left").withColumn("below", F.col("a") + 1)
    met = met.join(_at(table, "x", "below", p1="m1", p2="m2"), ["x", "below"], "left")
    follows = (F.col("a") == 0) | F.coalesce((F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), F.lit(False))
    met = met.withColumn("follows", follows).withColumn("m1", F.coalesce("m1", "x"))
    children = nodes.select(F.col("p").alias("a"), "m1", "m2", F.col("e").alias("ce"), F.col("rep").alias("crep"))
    met = met.join(children, ["a", "m1", "m2"], "left")
    placed = stage(met.select(
        "x", "length", "a", "follows", F.when(F.col("follows"), F.col("crep")).otherwise(F.col("grep")).alias("rep"),
        F.when(F.col("follows"), F.col("a")).otherwise(F.col("gp")).alias("p"),
        F.when(F.col("follows"), F.col("ce")).otherwise(F.col("a")).alias("e"),
    ), "placed")
    on_edge = placed.where(F.col("rep").isNotNull())
    mine = on_edge.join(table.select(F.col("conv").alias("x"), "depth", "p1", "p2"), "x")
    mine = mine.where((F.col("depth") > F.col("p")) & (F.col("depth") <= F.least("e", "length")))
    same = mine.join(_at(table, "rep", "depth", p1="r1", p2="r2"), ["rep", "depth"]).where("p1 = r1 and p2 = r2")
    reached = same.groupBy("x").agg(F.max("depth").alias("s"))
    left = on_edge.join(reached, "x", "left").select("x", "length", F.coalesce("s", "p").alias("s"), "rep", "p", "e")
    at_end = placed.where(F.col("rep").isNull()).select("x", "length", F.col("a").alias("s"), "rep", none.alias("p"), "e")
    return left.unionByName(at_end)


class SmallTrie:
    """The part of the trie below one place, for a batch of bounded size."""

    def __init__(self, top: int):
        self.top = top
        self.paths: dict[int, list[tuple]] = {}  # of each conversation, (p1, p2, w) from depth ``top`` on
        self.handles: dict[tuple, list[int]] = {}  # a node is [p, e, rep]
        self.names: dict[tuple, list[int]] = {}

    def at(self, x: int, depth: int) -> tuple:
        return self.paths[x][depth - self.top][:2]

    @staticmethod
    def fattest(above: int, below: int) -> int:
        return below >> (shift := (above ^ below).bit_length() - 1) << shift

    def _put(self, node: list[int]) -> None:
        p, e, rep = node
        f = self.fattest(p, e)
        self.handles[f, self.at(rep, f)] = self.names[p, self.at(rep, p + 1)] = node

    def _exit(self, x: int, length: int) -> tuple[int, list[int] | None]:
        """The depth of the last node that x follows to its end, and the node on whose edge x leaves, if any."""
        a, b, last = self.top, length + 1, None
        while b - a > 1:
            f = self.fattest(a, b - 1)
            node = self.handles.get((f, self.at(x, f)))
            if node:
                last, a = node, node[1]
                b = max(b, a + 1)
            else:
                b = f
        if last and (a > length or self.at(x, a) != self.at(last[2], a)):
            return last[0], last
        return a, self.names.get((a, self.at(x, a + 1))) if a < length else None

    def insert(self, x: int, path: list[tuple]) -> None:
        self.paths[x] = path
        length = self.top + len(path) - 1
        s, node = self._exit(x, length)
        if node:
            s, high = s + 1, min(node[1], length)  # they share the turn after the place
            while s < high:
                middle = (s + high + 1) // 2
                s, high = (middle, high) if self.at(x, middle) == self.at(node[2], middle) else (s, middle - 1)
            p, e, rep = node
            del self.handles[f := self.fattest(p, e), self.at(rep, f)]
            node[1] = s
            self._put(node)
            self._put([s, e, rep])
        if s < length:
            self._put([s, length, x])

    def rows(self):
        """The nodes as rows of NODE."""
        for p, e, rep in self.names.values():
            f = self.fattest(p, e)
            yield rep, p, e, f, self.paths[rep][p - self.top][2], self.paths[rep][e - self.top][2], *(
                h for d in (p, p + 1, f, e) for h in self.at(rep, d)
            )


NODE = ("rep", "p", "e", "f", "wp", "we", *(f"{kind}{i}" for kind in "qmfe" for i in (1, 2)))


def _inserted(members: DataFrame, table: DataFrame) -> DataFrame:
    """The nodes of small batches (x, s, m1, m2), each inserted by one task."""
    batch_of = ["s", "m1", "m2"]

    def nodes(tries):
        found = list(tries.rows())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], list(NODE))

    def insert(batches):
        trie, key, x, path = None, None, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*batch_of, "x", "depth", "p1", "p2", "w"))
            for s, m1, m2, of, depth, p1, p2, w in zip(*columns, strict=True):
                if key != (s, m1, m2) or x != of:
                    if trie:
                        trie.insert(x, path)
                    if (s, m1, m2) != key:
                        if trie:
                            yield nodes(trie)
                        trie, key = SmallTrie(s), (s, m1, m2)
                    x, path = of, [(0, 0, 0)] if s == 0 else []
                path.append((p1, p2, w))
        if trie:
            trie.insert(x, path)
            yield nodes(trie)

    rows = members.select("x", *batch_of).join(table.select(F.col("conv").alias("x"), "depth", "p1", "p2", "w"), "x")
    rows = rows.where("depth >= s").repartition(*batch_of).sortWithinPartitions(*batch_of, "x", "depth")
    return rows.mapInArrow(insert, ", ".join(f"{c} long" for c in NODE))


def compacted_trie(strings: DataFrame, table: DataFrame) -> DataFrame | None:
    """The compacted nodes of distinct conversations (x, length); None if there are none.

    Each round cuts the edges that conversations leave, inserts the small batches, and hangs one
    conversation of each large batch where it leaves. Which one is as good as random, so the rounds are
    about as many as the logarithm of the largest batch at most.
    """
    waiting, nodes = stage(strings.where("length > 0").select("x", "length"), "waiting"), None
    longest = waiting.agg(F.max("length")).first()[0]
    place = ["s", "m1", "m2"]
    while longest:
        exits = _exits(waiting, nodes, table, int(longest).bit_length())
        if nodes is not None:
            exits = stage(exits, "exits")
        leaving = exits.where("s < length").withColumn("below", F.col("s") + 1)
        leaving = leaving.join(_at(table, "x", "below", p1="m1", p2="m2"), ["x", "below"]).select("x", "length", *place)
        batches = stage(leaving.groupBy(*place).agg(
            F.count("*").alias("n"), F.sum(F.col("length") - F.col("s")).alias("turns"),
            F.min_by(F.struct("x", "length"), F.struct(F.xxhash64("x"), "x")).alias("one"),
        ), "batches")
        small = (F.col("n") > 1) & (F.col("n") <= BATCH_CONVERSATIONS) & (F.col("turns") <= BATCH_TURNS)
        dealt = join_groups(leaving, batches.select(*place, "n", F.col("one.x").alias("rep"), small.alias("small")), place, "n", waiting.count())
        dealt = stage(dealt, "dealt")
        bare = batches.where(~small).select(F.col("one.x").alias("rep"), F.col("s").alias("p"), F.col("one.length").alias("e"))
        kept = nodes
        if nodes is not None:
            cuts = stage(exits.where("rep is not null and s < e").select("rep", "p", "e", "s").distinct(), "cuts")
            marks = cuts.unionByName(cuts.select("rep", "p", "e", F.col("e").alias("s")).distinct())
            # The pieces of an edge end at its cuts, and begin where the piece before ends.
            begins = F.expr("lag(s) over (partition by rep, p, e order by s)")
            bare = bare.unionByName(marks.select("rep", F.coalesce(begins, "p").alias("p"), F.col("s").alias("e")))
            kept = nodes.join(cuts.select("rep", "p", "e").distinct(), ["rep", "p", "e"], "left_anti")
        added = _described(bare, table).select(*NODE).unionByName(_inserted(dealt.where("small"), table))
        nodes = stage(added if kept is None else kept.unionByName(added), "nodes")
        waiting = stage(dealt.where("not small and x <> rep").select("x", "length"), "waiting")
        longest = waiting.agg(F.max("length")).first()[0]
    return nodes


def _subtrees(values: DataFrame) -> DataFrame:
    """Sums (least: minimum) over all nodes below and with each node, by key; each step doubles the reach.

    ``values`` has key, up (the parent's key, null at the top), and the columns to be summed.
    """
    sums = [c for c in values.columns if c not in ("key", "up", "least")]
    now = stage(values, "subtrees")
    while now.where("up is not null").limit(1).count():
        given = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(
            F.min("least").alias("_least"), *(F.sum(c).alias(f"_{c}") for c in sums)
        )
        above = now.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("_up"))
        now = stage(now.join(given, "key", "left").join(above, "up", "left").select(
            "key", F.col("_up").alias("up"), F.least("least", "_least").alias("least"),
            *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums),
        ), "subtrees")
    return now.drop("up")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """depth, p1, p2 and the SHA-256 of the sorted conversations that end there, comma-joined.

    The digest runs along sorted rows. Conversations that end at one node go through one task, since
    SHA-256 has one order, but are never held together.
    """
    key = ["depth", "p1", "p2"]

    def digest(batches):
        now, running = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *mine, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv")), strict=True):
                if mine != now:
                    if now:
                        done.append((*now, running.hexdigest()))
                    now, running = mine, hashlib.sha256(str(conv).encode())
                else:
                    running.update(f",{conv}".encode())
            if done:
                yield table(done)
        if now:
            yield table([(*now, running.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*key, "sha"])

    ordered = ends.select(*key, "conv").repartition(*key).sortWithinPartitions(*key, "conv")
    return ordered.mapInArrow(digest, "depth long, p1 long, p2 long, sha string")


def prefix_nodes(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations (see :func:`rebuilt`), the empty one included.

    conv_id (smallest member), depth, parent_conv_id (that of the prefix one turn shorter; null at depth
    0), n_convs (members: conversations that begin so), n_children, n_leaves (childless nodes in the
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the words of each node's last text) and
    ends_sha256 (of the ids of members of just that length, ascending, comma-joined).

    Turns go by ``turn``, nulls first, ties by role and a hash of the text; null roles and texts are
    empty; repeated rows are turns of their own. Rows without conv_id belong to no conversation and are
    left out. Other columns are ignored; without conversations there are no nodes.
    """
    own = own_turns(turns)
    convs, rows = rebuilt(own)
    table = prefixes(rows)
    lasts = _at(table, "conv", "length", p1="p1", p2="p2", w="w")
    ends = stage(convs.join(lasts, ["conv", "length"], "left").select(
        "conv", F.col("length").alias("depth"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("p1", "p2", "w"))
    ), "ends")
    distinct = stage(ends.groupBy("depth", "p1", "p2").agg(
        F.min("conv").alias("x"), F.count("*").alias("n"), F.sum("w").alias("wl")
    ), "distinct")
    digests = stage(_ends_digest(ends), "digests")
    whole = distinct.agg(F.sum("n").alias("n"), F.min("x").alias("least")).first()
    nodes = compacted_trie(distinct.select("x", F.col("depth").alias("length")), table)
    schema = (
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    )
    top = {"children": 0, "leaves": 1, "saved": 0}
    below = spark.createDataFrame([], schema)
    if nodes is not None:
        subtrees = stage(_with_subtrees(nodes, distinct), "nodes")
        of_top = F.when(F.col("p") == 0, F.lit(1))
        top = subtrees.where("p = 0").agg(
            F.count(of_top).alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.col("wl") - F.col("ww")).alias("saved")
        ).first().asDict()
        below = _expanded(subtrees, table, digests, whole["least"])
    if not whole["n"]:
        return below
    empty = digests.where("depth = 0").select("sha").first()
    root = (whole["least"], 0, None, whole["n"], top["children"], top["leaves"], top["saved"], empty["sha"] if empty else _EMPTY)
    return below.unionByName(spark.createDataFrame([root], schema))


def _with_subtrees(nodes: DataFrame, distinct: DataFrame) -> DataFrame:
    """The nodes with n, least, leaves, wl (words of all members), ww (words of all nodes) of their subtrees,
    their children and their parent's least."""
    key, up = F.struct("e", "e1", "e2"), F.struct(F.col("p").alias("e"), F.col("q1").alias("e1"), F.col("q2").alias("e2"))
    keyed = nodes.withColumns({"key": key, "up": F.when(F.col("p") > 0, up)})
    ending = distinct.select(
        F.struct(F.col("depth").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2")).alias("key"), "n", F.col("x").alias("least"), "wl"
    )
    children = keyed.where("p > 0").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("children"))
    keyed = stage(keyed.join(children, "key", "left").withColumn("children", F.coalesce("children", F.lit(0))), "keyed")
    values = keyed.join(ending, "key", "left").select(
        "key", "up", "least", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "wl")),
        (F.col("children") == 0).cast("long").alias("leaves"), (F.col("we") - F.col("wp")).alias("ww"),
    )
    sums = _subtrees(values)
    parents = sums.select(F.col("key").alias("up"), F.col("least").alias("parent_least"))
    return keyed.join(sums, "key").join(parents, "up", "left").select(
        "rep", "p", "e", "e1", "e2", "wp", "children", "n", "least", "leaves", "wl", "ww", "parent_least"
    )


def _expanded(nodes: DataFrame, table: DataFrame, digests: DataFrame, least: int) -> DataFrame:
    """A row per depth of each compacted node."""
    first, last = F.col("p") + 1, F.col("e")
    chunks = nodes.withColumn("from", F.explode(F.sequence(first, last, F.lit(_CHUNK).cast("long"))))
    depths = chunks.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + (_CHUNK - 1), last))))
    rows = depths.join(_at(table, "rep", "depth", w="w", words="words"), ["rep", "depth"])
    rows = rows.withColumn("end", F.when(F.col("depth") == last, last))
    shas = digests.where("depth > 0").select(F.col("depth").alias("end"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), "sha")
    at_end = rows.where("end is not null").join(shas, ["end", "e1", "e2"], "left")
    rows = rows.where("end is null").withColumn("sha", F.lit(None).cast("string")).unionByName(at_end)
    before = F.col("w") - F.col("words")
    return rows.select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") > first, F.col("least")).otherwise(F.coalesce("parent_least", F.lit(least))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("end").isNull(), F.lit(1).cast("long")).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("wl") - F.col("n") * before - (F.col("ww") - (before - F.col("wp")))).alias("saved_tokens"),
        F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"),
    )
