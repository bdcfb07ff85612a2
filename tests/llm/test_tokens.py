"""Cached ids, token files and packing against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedbackmill.llm import packing, token_files
from feedbackmill.llm.queries import QUERIES, word_tokenizer
from feedbackmill.llm.word_tokens import WordTokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens():
    return WordTokens(word_tokenizer())


def plain_ids(tokens, text):
    return tokens.tokenizer.encode(text or "", add_special_tokens=False).ids


def sample_texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_cached_ids_equal_whole_text_ids(tokens):
    for _, text in sample_texts():
        assert tokens.encode(text).tolist() == plain_ids(tokens, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé Σς́İß×²½1'.,<|>\n\t\x0b\x1c\x00\x01\x1f\x7f\x80\x85\xa0\xad  日😀stmre"), max_size=40))
def test_cached_ids_of_odd_texts(tokens, text):
    assert tokens.encode(text).tolist() == plain_ids(tokens, text)


def test_ids_of_every_low_code_point(tokens):
    for point in range(0x250):
        for text in (chr(point), f"a{chr(point)}b", f"1 {chr(point)}{chr(point)} x", f"é{chr(point)}."):
            assert tokens.encode(text).tolist() == plain_ids(tokens, text), hex(point)


def test_control_characters_through_files_and_packing(spark, tokens):
    texts = [f"a{chr(point)}b é{chr(point)}" for point in [*range(0x20), *range(0x7F, 0xA1)]] + ["\x7f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = {i: plain_ids(tokens, t) for i, t in enumerate(texts)}
    for r in token_files.token_file_digest(df, word_tokenizer(), 2).collect():
        mine = np.array([*ids[r["doc_id"]], 2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(mine), zlib.crc32(mine.tobytes()))
    pieces = packing.token_pieces(df, word_tokenizer(), capacity=2048, end_id=0)
    check_packing(packing.pack_pieces(pieces, capacity=2048).collect(), ids)


def test_special_strings_and_forgetting(tokens, monkeypatch):
    monkeypatch.setattr("feedbackmill.llm.word_tokens.KEPT_CHUNKS", 3)
    for text in ("a<|endoftext|>b <|startoftext|>", "one two three four five six one two", "I'm don'T he'Ll"):
        assert tokens.encode(text).tolist() == plain_ids(tokens, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300) | st.integers(0, 70_000), max_size=20), max_size=8))
def test_blocks_round_trip(docs):
    keys = [None if i == 3 else i * 7 - 5 for i in range(len(docs))]
    block = token_files.encode_block(keys, [np.array(d, np.uint32) for d in docs])
    two = list(token_files.decode_blocks(block + block))
    assert len(two) == 2
    for names, nulls, sizes, ids in two:
        assert [None if z else n for n, z in zip(names.tolist(), nulls.tolist())] == keys
        assert sizes.tolist() == [len(d) for d in docs]
        assert ids.tolist() == [x for d in docs for x in d]


def test_long_ranks_round_trip():
    ids = np.arange(70_000, dtype=np.uint32) * 60_000 % 70_001
    (_, _, _, got), = token_files.decode_blocks(token_files.encode_block([1], [ids]))
    assert (got == ids).all()


def test_damage_is_noticed():
    block = bytearray(token_files.encode_block([1], [np.arange(9, dtype=np.uint32)]))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        list(token_files.decode_blocks(bytes(block)))


def test_token_file_query(spark, tokens):
    want, start = [], 0
    for doc_id, text in sample_texts():
        ids = np.array([*plain_ids(tokens, text), 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op5_token_files"](spark, SF).collect())) == want


def test_token_files_of_odd_rows(spark, tokens, monkeypatch):
    rows = [(5, None, "x"), (5, "same", "x"), (5, "same", "y"), (None, "no id", "x"), (1, "", "x"), (2, "long " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, name string").repartition(3)
    got = sorted(map(tuple, token_files.token_file_digest(df, word_tokenizer(), 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 5, 5, 5]
    assert [r[2] for r in got] == [len(plain_ids(tokens, t)) + 1 for t in ("no id", "", "long " * 3000, None, "same", "same")]
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got)][:-1]))
    assert token_files.token_file_digest(df.limit(0), word_tokenizer(), 2).collect() == []


def check_packing(rows, ids_of, capacity=2048):
    """Every piece of every document once, in place, and sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids = np.array([*ids_of[key], 0], "<u4")
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [
            (i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()))
            for i, s in enumerate(range(0, len(ids), capacity))
        ]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, tokens):
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    used = check_packing(rows, {k: plain_ids(tokens, t) for k, t in sample_texts()})
    counts = Counter(r["length"] for r in rows)
    assert packing.lower_bound(counts, 2048) <= used <= packing.lower_bound(counts, 2048) + 1


def test_packing_of_odd_rows(spark, tokens):
    texts = {1: None, 2: "", 3: "a " * 50, 4: "b " * 7, 5: "c " * 7, 6: "d " * 7}
    df = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "doc_id long, text string, offset int").repartition(4)
    pieces = packing.token_pieces(df, word_tokenizer(), 16, 0, keep_ids=True)
    packed = packing.pack_pieces(pieces, 16)
    assert check_packing(packed.collect(), {k: plain_ids(tokens, t) for k, t in texts.items()}, 16) == 5
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(len(plain_ids(tokens, t)) + 1 for t in texts.values())
    none = packing.token_pieces(df.limit(0), word_tokenizer(), 16, 0)
    assert packing.pack_pieces(none, 16).collect() == []


def fewest(lengths, capacity):
    """The optimum of a small instance, by trying all places."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [r - lengths[i] * (k == j) for k, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal_on_small_instances(lengths):
    lengths = sorted(lengths, reverse=True)
    plan = packing.plan_packing(Counter(lengths), 20)
    got = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 20
        for n in pattern:
            got[n] += times
    assert got == Counter(lengths)
    best = fewest(lengths, 20)
    assert packing.lower_bound(Counter(lengths), 20) <= best if lengths else not plan
    assert sum(t for _, t in plan) == best
