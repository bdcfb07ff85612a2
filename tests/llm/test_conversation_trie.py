"""The trie of conversation prefixes against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from feedbackmill.llm import conversation_trie as trie
from feedbackmill.llm.running import running_sums

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        said = own.get(conv - int(abs(conv) % 20 * (1 if conv > 0 else -1)), [])[:h] + turns[h:]
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append((conv, d == len(said)))
    below = {k: [] for k in nodes}
    for k in nodes:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    parents = {k[:-1] for k in nodes if k}
    words = {k: len(re.findall(r"[^\x20\x09-\x0d]+", k[-1][1])) if k else 0 for k in nodes}
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        out.append((
            min(c for c, _ in members), len(k), min(c for c, _ in nodes[k[:-1]]) if k else None, len(members),
            sum(1 for x in below[k] if len(x) == len(k) + 1), sum(1 for x in below[k] if x not in parents),
            sum((len(nodes[x]) - 1) * words[x] for x in below[k]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows):
    schema = "conv_id long, turn long, role string, text string, depth long, p1 string"
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], schema).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_nodes(spark, df).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "a b"), (0, 1, "assistant", None), (0, None, None, "first"), (1, 0, "user", "a b"), (1, 0, "user", "a b"),
        (2, 0, "user", ""), (None, 0, "user", "no conversation"), (-3, 0, "user", "x"), (-3, 1, "assistant", "y\x0bz"),
        (41, 0, "user", "no base"), (41, 1, "us", "erno base"), (42, 0, "user", "long " * 50_000), (43, 1, None, None), (7, 5, "user", "a"),
        (7, 5, "assistant", "a"), (7, 5, "user", "b"),
    ]
    rows += [(20 * k, 0, "user", "only one turn") for k in range(5, 9)] + [(100 + i, t, "user", f"w{t % 2}") for i in range(1, 9) for t in range(i % 5)]
    check(spark, rows)
    assert trie.prefix_nodes(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_conversations_without_turns_only(spark):
    # Ids that take one turn at least from an absent first conversation, and have no more than that.
    ids = [i for i in range(1, 200) if i % 20 and zlib.crc32(str(i).encode()) % 4]
    check(spark, [(i, 0, "user", "gone") for i in ids])


@pytest.mark.parametrize("batch", [1, 4, 1000])
def test_many_branches_and_one_hot_path(spark, monkeypatch, batch):
    monkeypatch.setattr(trie, "BATCH_CONVERSATIONS", batch)
    monkeypatch.setattr(trie, "_CHUNK", 16)
    rng = random.Random(1)
    rows = []
    for conv in range(150):
        kind, length = conv % 3, rng.randint(1, 9)
        if kind == 0:
            said = ["same"] * rng.choice([3, 9, 17, 33])  # beginnings of one path, and copies
        elif kind == 1:
            said = [rng.choice("ab") for _ in range(length)]
        else:
            said = ["same"] * rng.randint(0, 20) + [f"own {conv}"] * rng.randint(0, 3)
        rows += [(conv, t, "user" if t % 2 else "assistant", s) for t, s in enumerate(said)]
    rows += [(1003, t, "user", "same" if t < 30 else f"turn {t % 7}") for t in range(700)]  # more than all others
    check(spark, rows)


def test_two_fattest_depth_and_levels(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    zeros = lambda d: (d & -d).bit_length() - 1
    for r in df.select("a", "b", trie.two_fattest(df.a, df.b).alias("f"), trie._zeros("b").alias("z")).collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=zeros) and r["z"] == zeros(r["b"])


def test_running_sums_over_cut_groups(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([1, -5, (1 << 62) + 3])) for g, n in ((0, 3), (1, 500), (2, 1), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the small partitions
    try:
        got = running_sums(df, "g", ["i"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sums, want = {}, {}
    for g, i, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        want[g, i] = sums[g] % (1 << 61)
    assert {(r["g"], r["i"]): r["run_v"] for r in got} == want and len(got) == len(rows)
