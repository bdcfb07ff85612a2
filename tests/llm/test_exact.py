"""Exact duplicates against a plain grouping of normalised texts."""

import hashlib
import random
import re

import pytest

from feedbackmill.llm import bitmap, exact, hot_join


def plain(rows):
    """doc_id, keep_id, group_size and hash of each row, sorted; and the number of kept rows."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, size string, n int").repartition(3)
    got = exact.exact_duplicates(df, hash_unique=True, **options).collect()
    want, groups = plain(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\t\n "), (5, "a b"), (6, "a\n\nb"), (7, " a b"), (8, "a b "), (None, "a\x0bb"), (None, None),
    (None, "no id"), (None, "no id"), (9, "a b"), (9, "a b"), (9, "other text of that id"), (10, "é" * 300_000), (11, "é" * 300_000),
    (12, "é" * 299_999 + "e"), (13, "x" * 200 + "1"), (14, "x" * 200 + "2"), (15, "x" * 200 + "1"), (16, "A b"), (17, "a\x1cb"), (18, "a\x00b"),
]


def test_odd_rows(spark):
    check(spark, ODD)
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("words", [1, bitmap.MAP_WORDS])
def test_many_copies_with_full_and_empty_bitmaps(spark, monkeypatch, words):
    monkeypatch.setattr(bitmap, "MAP_WORDS", words)
    monkeypatch.setattr(exact, "PREFIX_CHARS", 4)
    rng = random.Random(words)
    rows = [(i, "the same text") for i in range(0, 3000, 3)]  # a third of all
    rows += [(i, " ".join(rng.choices("abc", k=rng.randint(1, 5)))) for i in range(3000) if i % 3 == 1]
    rows += [(i, f"text {i}") for i in range(3000) if i % 3 == 2]
    check(spark, rows)


def test_only_suspects_are_hashed(spark):
    rows = [(1, "alone"), (2, "alike 1" + "x" * 300), (3, "alike 1" + "y" * 300), (4, "begin" * 40 + "1"), (5, "begin" * 40 + "2"), (6, "twice"), (7, "twice")]
    got = {r["doc_id"]: r for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["text_sha256"]} == {4, 5, 6, 7}  # of 2 and 3 the beginnings differ already
    assert {i for i, r in got.items() if not r["kept"]} == {7}


def test_hot_groups_stay_where_they_lie(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(1100)] + [(None, 0)], "k string, v int")
    groups = rows.groupBy("k").count()
    joined = hot_join.join_groups(rows, groups, ["k"], "count", 2001)
    assert joined.count() == 2000
    assert {(r["k"], r["count"]) for r in joined.collect()} == {("hot", 900)} | {(f"k{i}", 1) for i in range(1100)}
    plan = joined._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "ResolvedHint (strategy=broadcast)" in plan
