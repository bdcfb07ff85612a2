"""Copies of benchmark items: planted exact and edited ones, and a plain alignment."""

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedbackmill.llm import bitmap, decontaminate
from feedbackmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_align(item, words):
    best, rows = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(-1, 3), max_size=20))
def test_alignment(item, words):
    words = [w if w >= 0 else 9 for w in words]
    score, end = decontaminate.align(np.array(item, int), np.array(words, int))
    assert score == plain_align(item, words)
    if score:
        assert plain_align(item, words[:end]) == score and words[end - 1] in item


def test_query_finds_exact_copies_and_little_else(spark):
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r["item_id"]: words(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    docs = {r["doc_id"]: words(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    exact = {(d, i) for i, x in items.items() for d, t in docs.items() if x in t}
    rows = QUERIES["op3_decontamination"](spark, SF).collect()
    assert exact <= {(r["doc_id"], r["item_id"]) for r in rows}
    assert all(r["score"] == 1 for r in rows if (r["doc_id"], r["item_id"]) in exact)
    # A plain search of everything else: each document against each item.
    extra = {(r["doc_id"], r["item_id"]) for r in rows} - exact
    for d, i in extra:
        assert plain_align(items[i].split(), docs[d].split()) >= len(items[i].split())


def test_edited_copies(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(vocabulary, k=40))) for i in range(20)]
    docs, want = [], set()
    for i, text in items:
        for kind, share in enumerate((0.0, 0.1, 0.15)):
            edited = []
            for w in text.split():
                roll = random.random()
                edited += [] if roll < share / 3 else [random.choice(vocabulary)] if roll < share else [w.upper() + ","]
            around = random.choices(vocabulary, k=300)
            docs.append((3 * i + kind, " ".join(around[:150] + edited + around[150:]), "x"))
            want.add((3 * i + kind, i))
    docs += [(1000 + i, " ".join(random.choices(vocabulary, k=500)), "x") for i in range(100)]
    docs += [(2000 + i, items[0][1], "x") for i in range(300)]  # a passage in most documents
    want |= {(2000 + i, 0) for i in range(300)}
    found = decontaminate.find_copies(
        spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    texts = {d: t for d, t, _ in docs}
    for r in found:
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].split()) in range(28, 50)


@pytest.mark.parametrize("words", [1, bitmap.MAP_WORDS])
def test_odd_rows(spark, monkeypatch, words):
    monkeypatch.setattr(bitmap, "MAP_WORDS", words)
    monkeypatch.setattr(decontaminate, "KEPT_WORDS", 3)
    items = [(1, None), (2, ""), (3, "two words"), (4, "the quick brown fox jumps"), (4, "the quick brown fox jumps"), (5, "ein kleines Haus am See"), (None, "nobody knows my name")]
    docs = [(1, None), (2, ""), (3, "The quick, brown fox -- jumps. Ein KLEINES haus am See!"), (3, "nobody knows my name"), (4, "fox the of"), (5, "the quick brown fox jumps " * 20_000)]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    doc_df = spark.createDataFrame([(*d, 0.5, 1) for d in docs], "doc_id long, text string, score double, end int")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["score"]) for r in decontaminate.find_copies(doc_df, item_df).collect())
    assert got == [(3, 0, 1.0), (3, 4, 1.0), (3, 5, 1.0), (5, 4, 1.0)]
    kept = decontaminate.drop_contaminated(doc_df, item_df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4] and kept.columns == doc_df.columns
    assert decontaminate.find_copies(doc_df, item_df.limit(0)).collect() == []
    assert decontaminate.find_copies(doc_df.limit(0), item_df).collect() == []
    assert decontaminate.drop_contaminated(doc_df, item_df.limit(0)).count() == len(docs)


def test_evenly_edited_copies_of_short_items(spark):
    """Every copy that scores enough is found, wherever its edits lie and however rare its words are."""
    rng = random.Random(9)
    want, docs, kinds = set(), [], {}
    texts = [" ".join(f"r{i}x{k}" for k in range(n)) for i, n in enumerate([3, 4, 5, 8, 12, 20, 30, 30])]
    for i, text in enumerate(texts):
        words = text.split()
        edits = {}
        for step in (2, 3, 4, 5, 6):
            edits[f"replaced {step}"] = [w if (k + 1) % step else "foreign" for k, w in enumerate(words)]
            edits[f"dropped {step}"] = [w for k, w in enumerate(words) if (k + 1) % step]
            edits[f"parted {step}"] = [x for k, w in enumerate(words) for x in ([w] if (k + 1) % step else [w, "foreign"])]
        for share in (0.2, 0.25, 0.3):
            for n in range(20):
                edits[f"random {share} {n}"] = [w if rng.random() >= share else "foreign" for w in words]
        for kind, edited in edits.items():
            if plain_align(words, edited) >= len(words):
                want.add((len(docs), i))
                kinds[kind] = kinds.get(kind, 0) + 1
            docs.append((len(docs), " ".join(["around"] * 50 + edited + ["around"] * 50)))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    found = decontaminate.find_copies(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {"replaced 3", "replaced 4", "replaced 5", "replaced 6", "parted 2", "dropped 3"} <= kinds.keys()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=9), st.lists(st.integers(0, 4), max_size=30))
def test_no_copy_is_ruled_out(item, words):
    items = decontaminate.Items.of([(1, " ".join(map(str, item)))])
    found = decontaminate.copies(items, decontaminate.Pairs.of(items), " ".join(map(str, words)))
    score = plain_align(item, words)
    assert [f[1] for f in found] == ([score / (2 * len(item))] if score >= len(item) else [])


def test_seeds_are_the_rarest_pairs_and_join_every_copy(spark):
    """Each document that scores enough is a candidate, and common pairs alone make none."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for i in range(40)]
    docs = []
    for i in range(400):
        said = rng.choice(items)[1].split()
        edited = [x for w in said for x in ([w], [w], [w, rng.choice(words)], [rng.choice(words)], [])[rng.randrange(5)]]
        docs.append((i, " ".join(rng.choices(words, k=20) + edited + rng.choices(words, k=20))))
    docs += [(1000 + i, "common pair " * 3) for i in range(600)]
    items += [(100, "common pair of words that is the only thing known of this item"), (101, "common pair common pair common pair")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "doc_id as doc", "text")
    numbered = decontaminate.numbered_items(spark.createDataFrame(items, "item_id long, text string"))
    ids = {r["item"]: r["item_id"] for r in numbered.collect()}
    found = {(r["doc"], ids[r["item"]]) for r in decontaminate.candidates(df, numbered).collect()}
    want = {(d, i) for d, t in docs for i, x in items if plain_align(x.split(), t.split()) >= len(x.split())}
    assert want <= found and len(want) > 600
    assert not any(i == 100 for _, i in found)


def test_one_scan_of_texts_for_any_number_of_items(spark):
    items = spark.createDataFrame([(i, f"a b{i} c d e{i} f g h{i} j k") for i in range(9000)], "item_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = decontaminate.find_copies(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1


@given(st.integers(3, 400))
def test_plan_of_seeds(words):
    seeds, shared = decontaminate.seed_plan(words)
    pairs = words - 1 if words > 3 else 3
    held = max(1, math.ceil((words - 3) / 3))
    # The pairs that are no seeds, all held, leave so many for the seeds.
    assert 1 <= shared <= held and held - (pairs - seeds) == shared and seeds <= pairs
