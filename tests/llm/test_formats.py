"""Chat formatting, WARC packages and nearest neighbours against SQL and plain versions."""

import hashlib
import io
import random
import uuid
import zipfile

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import differences, duck
from pyspark.sql import functions as F

from feedbackmill.llm import ann, chat, warc, zip_archive
from feedbackmill.llm.queries import ORACLES, QUERIES
from feedbackmill.session import shared_dir

SF = "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


control_heavy = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "</", "[", "s>", "INST]", "a", "é\n", "<|", "|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(control_heavy)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "system", None), (1, 1, "user", ""), (1, 1, "assistant", "a"), (1, 1, "assistant", "b\\<|end|>"), (1, None, None, "first"),
        (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (None, 0, "assistant", "no id"), (3, 0, "<|role|>", "long " * 60_000),
    ]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, nth int").repartition(3)
    got = {r["conv_id"]: r for r in chat.conversation_digest(df, PATH, PATTERN).collect()}
    turns = {1: [("", "first"), ("system", ""), ("user", ""), None, None], 2: [("assistant", "x")] * 2, None: [("assistant", "no id")], 3: [("<|role|>", "long " * 60_000)]}
    turns[1] = [("", "first"), ("system", ""), ("assistant", "a"), ("assistant", "b\\<|end|>"), ("user", "")]
    turns[1][2:4] = sorted(turns[1][2:4], key=lambda rt: hashlib.md5(rt[1].encode()).hexdigest())
    assert got.keys() == turns.keys()
    for key, said in turns.items():
        learned = "".join(t for r, t in said if r == "assistant")
        assert got[key]["n_turns"] == len(said)
        assert got[key]["loss_chars"] == len(learned) and got[key]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        whole = "<|conversation|>" + "".join(f"<|role|>{chat.escape(r)}<|text|>{chat.escape(t)}<|end|>" for r, t in said)
        assert got[key]["formatted_chars"] == len(whole)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    formatted = chat.format_conversations(df, PATH, PATTERN).orderBy("conv_id", "nth").collect()
    assert len(formatted) == len(rows)
    tokens, at = chat.ChatTokens(PATH, PATTERN), {}
    for r in formatted:
        assert r["start"] == at.get(r["conv_id"], 0) and len(r["ids"]) == len(r["mask"])
        at[r["conv_id"]] = r["start"] + len(r["ids"])
        assert max(r["ids"]) < tokens.first + len(chat.MARKS)
    assert chat.conversation_digest(df.limit(0), PATH, PATTERN).collect() == []
    assert chat.format_conversations(df.limit(0), PATH, PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(st.characters(codec="utf-8", exclude_characters="\0"), min_size=1, max_size=8), st.binary(max_size=50), max_size=5), st.booleans())
def test_packages_agree_with_the_standard_reader(members, zip64):
    package = zip_archive.zip_stored(list(members.items()), zip64)
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        assert {i.filename: z.read(i) for i in z.infolist()} == members
    read = lambda a, b: package[a:b]
    found = zip_archive.read_directory(read, len(package))
    assert {m.name: package[(s := zip_archive.member_start(read, m)) : s + m.size] for m in found} == members


def test_packages_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("a.txt", "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("b.txt", b"squeezed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    raw = out.getvalue()
    read = lambda a, b: raw[a:b]
    a, b = zip_archive.read_directory(read, len(raw))
    assert raw[(s := zip_archive.member_start(read, a)) : s + a.size] == b"stored"
    with pytest.raises(ValueError):
        zip_archive.member_start(read, b)
    with pytest.raises(ValueError):
        zip_archive.read_directory(lambda a, b: (b"x" * 90)[a:b], 90)


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 400)
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    big, small = "é" * 600, "s" * 999
    rows = [
        (1, "http://a/ä b\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", small), (5, "u", small),
        (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (9, "u", "x" * 300_000),
    ]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "page_id long, url string, html string, same string, refers_to int")
    got = warc.archived(spark, df).collect()
    assert len(got) == len(rows)
    types = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert types == sorted([(0, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None)] + [(i, "response", None) for i in range(4, 10)])
    html = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        assert r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == hashlib.sha1(html[r["page_id"]]).hexdigest()
        assert r["html"] is None if r["record_type"] == "revisit" else r["html"].encode() == html[r["page_id"]]
    assert warc.archived(spark, df.limit(0)).collect() == []


def test_small_pages_and_common_payloads_stay_spread(spark):
    """No task gets more than twice the mean, with nine tenths of small pages and a payload in most of the rest."""
    rows = [(i, "u", f"small {i}") for i in range(3600)] + [(i, "u", "same " * 300) for i in range(3600, 3900)]
    rows += [(i, "u", f"large {i} " * 200) for i in range(3900, 4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = warc.with_originals(df).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sizes = [r["n"] for r in found]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / len(sizes)


def test_repeated_attempts_leave_packages_alone(spark, monkeypatch):
    """A second attempt with other cuts writes packages of its own; those of the kept one read as before."""
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 2000)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = [(i, "u", f"{i} " * (i % 90 + 1)) for i in range(300)]
    schema = "page_id long, url string, html string"
    kept = warc.write_packages(spark.createDataFrame(rows, schema).coalesce(1), folder)
    late = warc.write_packages(spark.createDataFrame(rows[::-1][:200], schema).coalesce(1), folder)
    assert not {r["name"] for r in kept.collect()} & {r["name"] for r in late.collect()}
    got = sorted((r["page_id"], r["html"]) for r in warc.read_packages(folder, kept).collect())
    assert got == [(i, h) for i, _, h in rows]


def brute(rows, every, k):
    ids = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ids[i] = min(ids.get(i, list(v)), list(v))
    out = {}
    for q, v in ids.items():
        if q % every == 0:
            far = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i) for i, w in ids.items() if i != q and len(w) == len(v))
            out[q] = far[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = 0
    for q, best in want.items():
        mine = sorted(found.get(q, []))
        assert [x[0] for x in mine] == list(range(1, len(best) + 1))
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hits += len({i for _, i in best} & {i for *_, i in mine})
    assert found.keys() == {q for q, b in want.items() if b}
    return hits / max(1, sum(map(len, want.values())))


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(QUERIES["op1_collision_search"](spark, SF).collect(), brute(rows, 100, 10)) >= 0.95


def test_nearest_over_shards_with_clusters_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    points = [(int(i), (centres[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(900)]
    points += [(1000 + i, centres[0].tolist()) for i in range(300)]  # a very common vector
    rng.shuffle(points)
    df = spark.createDataFrame([(int(i), v, 1) for i, v in points], "vec_id long, embedding array<double>, shard int")
    assert recall(ann.nearest(df, every=50, k=10).collect(), brute(points, 50, 10)) >= 0.95


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [5.0, 5.0]), (9, [2.0, 0.0]), (10, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 4.0]), (30, [7.0]), (10, [1.0, 2.0, 3.0]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = ann.nearest(df, every=10, k=10).collect()
    assert recall(got, brute(rows, 10, 10)) == 1
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(7, 0.0), (8, 0.0), (9, 1.0)]
    assert ann.nearest(df.limit(0), 10, 10).collect() == []
    random.seed(0)
