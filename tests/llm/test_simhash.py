"""SimHash, BK-trees and components against plain versions."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
from xxhash import xxh64_intdigest

from feedbackmill.llm import simhash
from feedbackmill.llm.components import components
from feedbackmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=3):
    """The smallest key reachable from each, by comparing all pairs."""
    keys = sorted(prints, key=lambda k: (k is None, k))
    label = {k: k for k in keys}
    for start in keys:
        if label[start] is not start:
            continue
        open_keys = [start]
        while open_keys:
            k = open_keys.pop()
            for other in keys:
                if other != start and label[other] is other and other != k and bin(prints[k] ^ prints[other]).count("1") <= radius:
                    label[other] = start
                    open_keys.append(other)
    return label


def test_query_against_all_pairs(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    label = plain_classes(prints)
    want = sorted((k, f"{p:016x}", label[k]) for k, p in prints.items())
    assert sorted(map(tuple, QUERIES["op7_simhash"](spark, SF).collect())) == want


def test_odd_rows(spark):
    texts = [
        (9, None), (8, ""), (7, " \t\n\x0b\x0c\r"), (3, "One two"), (2, "one TWO"), (5, " x É é"), (5, " x É é"),
        (None, "one two"), (6, "w " * 200_000),
    ]
    df = spark.createDataFrame([(k, t, 0, 1) for k, t in texts], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in got) == sorted((k or -1, plain_fingerprint(t)) for k, t in texts)
    smallest = {r["doc_id"]: r["component_id"] for r in got}
    assert smallest == {9: 7, 8: 7, 7: 7, 3: 2, 2: 2, 5: 5, None: 2, 6: 6}
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 300, np.uint64) | (rng.integers(0, 2, 300, np.uint64) << np.uint64(63)))
    near = values[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ np.uint64(3)
    q, v = simhash.BKTree(values).search(near, 3)
    want = {(i, j) for i in range(len(near)) for j in range(len(values)) if int(near[i] ^ values[j]).bit_count() <= 3}
    assert set(zip(q.tolist(), v.tolist())) == want


def test_dense_shards_in_parts(spark, monkeypatch):
    """Thousands of fingerprints close to each other, dealt to parts and searched in small batches."""
    monkeypatch.setattr(simhash, "PART", 64)
    random.seed(3)
    ball = {0x0123456789ABCDEF ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(700)}
    far = {random.getrandbits(64) for _ in range(200)}
    chain = [0xF0F0 << 40]
    for b in range(0, 60, 3):
        chain.append(chain[-1] ^ (7 << b))
    values = sorted(ball | far | set(chain))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df)).collect()}
    label = plain_classes(dict(zip(range(len(values)), values)))
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(label[i], set()).add(v)
    for group in groups.values():
        if len(group) == 1:
            assert not group & found.keys()
        else:
            assert len({found[v] for v in group}) == 1
    assert len(set(found.values())) == sum(len(g) > 1 for g in groups.values())


def test_dense_search_stops_early_and_misses_nothing():
    rng = np.random.default_rng(5)
    base = np.uint64(0x5555AAAA5555AAAA)
    bits = lambda n: (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    values = np.unique(np.concatenate([base ^ bits(900) ^ bits(900), base ^ np.uint64(0xFFF) ^ bits(60), rng.integers(0, 1 << 62, 50, np.uint64)]))
    rng.shuffle(values)
    roots = simhash.linked_classes(values, None, 3, batch=64)
    label = plain_classes(dict(enumerate(values.tolist())))
    assert len(set(zip(roots.tolist(), label.values()))) == len(set(label.values())) == len(set(roots.tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 4), (141, 140), (59, 58)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 142)} | {i: 7 for i in range(7, 60)}


def test_kept_rows_by_class(spark):
    """Several texts without an id, and ids that stand for several texts."""
    plain = ["alpha beta gamma delta", "one two three four", "red green blue black"]
    rows = [(None, plain[0], 1), (None, plain[1], 1), (None, plain[1], 2), (None, plain[2], 1), (4, plain[2], 1)]
    rows += [(1, "north south east west", 1), (1, "iron gold tin lead", 1), (2, "iron gold tin lead", 1)]
    rows += [(3, "sun moon star sky", 1), (3, "sun moon star sky", 2), (None, None, 1), (None, "", 2)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(map(tuple, kept), key=lambda r: (r[0] or 0, r[1] or "")) == [
        (None, "", 2), (None, plain[0], 1), (None, plain[1], 2),
        (1, "iron gold tin lead", 1), (1, "north south east west", 1), (3, "sun moon star sky", 2), (4, plain[2], 1),
    ]
