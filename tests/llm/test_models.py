"""Toxicity and language against held-out labels, plain versions and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from feedbackmill.llm import langid, toxicity
from feedbackmill.llm.common import labelled_sample
from feedbackmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " .!? \n"), (4, "!" * 9), (None, "plain words here"), (5, "12 34"), (5, "12 34"), (6, "mot " * 100_000)]
ODD_SCHEMA = "doc_id long, text string, score int, label int"


def odd_rows(spark):
    return spark.createDataFrame([(k, t, 1, 1) for k, t in ODD], ODD_SCHEMA)


def test_toxicity_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = QUERIES["op4_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([s for s, y in judged if y == v] for v in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert np.mean([g >= 0.7 for g in good]) < 0.03


def plain_noisy_or(model, text):
    """One less the probability that no sentence is toxic; a sentence's logit is a sum over its words."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(r"\w+", sentence)
        if words:
            logit = model.bias
            for word in words:
                for name in ["=" + word] + [word[:n] for n in range(3, 8) if n <= len(word)]:
                    logit += float(model.weights[zlib.crc32(name.encode()) % toxicity.BUCKETS])
            clean *= 1 - 1 / (1 + math.exp(-logit))
    return 1 - clean


def test_scores_equal_a_plain_noisy_or(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        assert math.isclose(r["score"], plain_noisy_or(model, texts[r["doc_id"]]), abs_tol=1e-4)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["vile ", "oaf", "é", "_", ". ", "!?", "\n", "12 ", "a", "Déjà "], k=rng.randint(0, 30)))
        assert math.isclose(model.score(text), plain_noisy_or(model, text), abs_tol=1e-4)


def test_the_fit_is_a_likely_one():
    """The likelihood of the labels, computed plainly, falls when weights or the bias are moved at random."""
    rng = random.Random(6)
    good, bad = [f"good{i}" for i in range(30)], ["vile", "oaf", "rotten"]
    sample = []
    for i in range(300):
        said = [" ".join(rng.choices(good, k=5)) for _ in range(4)]
        if i % 3 == 0:
            said[rng.randrange(4)] += " " + rng.choice(bad)
        sample.append((". ".join(said), int(i % 3 == 0)))
    model = toxicity.fit_sentences(sample)

    def loss(weights, bias):
        moved = toxicity.SentenceModel(weights, bias, "moved")
        scores = [min(max(plain_noisy_or(moved, t), 1e-9), 1 - 1e-9) for t, _ in sample]
        return -sum(math.log(p if y else 1 - p) for p, (_, y) in zip(scores, sample))

    fitted = loss(model.weights, model.bias)
    assert fitted < 0.5 * loss(np.zeros_like(model.weights), math.log(1 / 11))
    used = np.flatnonzero(model.weights)
    numbers = np.random.default_rng(1)
    for _ in range(6):
        weights = model.weights.copy()
        weights[used] += numbers.normal(0, 0.5, len(used)).astype(np.float32)
        assert loss(weights, model.bias) > fitted
    assert loss(model.weights, model.bias + 2) > fitted and loss(model.weights, model.bias - 4) > fitted


def test_offending_sentences_are_located():
    sample = [("all is well. the day is fine.", 0), ("we walk home.\nit rains.", 0)] * 40 + [("all is well. you vile oaf! it rains.", 1)] * 20
    model = toxicity.fit_sentences(sample)
    text = "the day is fine. Such a VILE oaf? we walk home."
    assert model.score(text) > 0.7 > 0.2 > model.score("the day is fine. we walk home.")
    (start, end, p), = model.offences(text)
    assert text[start:end].strip() == "Such a VILE oaf?" and p > 0.5


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.train(odd_rows(spark), known)
        got = toxicity.score_toxicity(odd_rows(spark), model).collect()
        assert len(got) == len(ODD)
        assert all(r["score"] == 0 and not r["offending"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert toxicity.score_toxicity(odd_rows(spark).limit(0), model).collect() == []


def test_gradients_of_the_network():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(0)
    d = langid.Direction(*(rng.normal(0, 0.2, s) for s in ((24, 256), (24, 9))))
    columns, pull = rng.integers(0, 256, (5, 3)).astype(np.uint8), rng.normal(0, 1, (5, 8, 3))

    def loss():
        _, states = langid._forward(d, columns, range(5))
        return sum((states[t] * pull[t]).sum() for t in range(5))

    trace, _ = langid._forward(d, columns, range(5))
    table, back = langid._backward(d, columns, reversed(range(5)), trace, {t: pull[t].astype(float) for t in range(5)})
    for param, grad in ((d.table, table), (d.back, back)):
        for i, j in zip(rng.integers(0, 24, 12), rng.choice(columns.ravel() if param is d.table else np.arange(9), 12)):
            param[i, j] += 1e-4
            up = loss()
            param[i, j] -= 2e-4
            down = loss()
            param[i, j] += 1e-4
            assert abs((up - down) / 2e-4 - grad[i, j]) < 2e-3 * max(1, abs(grad[i, j]))


def test_language_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def test_pooling_equals_position_by_position():
    net = langid.train_network([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 20, steps=60, batch=32)
    texts = ["the dog and the man " * 30, "und der mann", "a", None, "..."]
    pooled = net.probabilities(texts)
    assert np.allclose(pooled[:3].sum(1), 1, atol=1e-4) and not pooled[3:].any()
    assert [net.languages[i] for i in pooled[:2].argmax(1)] == ["en", "de"]
    assert len(net.positions(texts[0])) == len(texts[0])
    assert np.allclose(net.probabilities(texts[:1]), pooled[:1], atol=1e-5)


def plain_probabilities(net, text):
    """Mean over the letters of a text of what both directions say at each byte, one step after the other."""
    units, raw, total, letters = langid.UNITS, text.encode(), np.zeros(len(net.languages)), 0
    for at in range(0, len(raw), langid.WINDOW):
        part = raw[at : at + langid.WINDOW]
        window = part + b" " * (langid.WINDOW - len(part))
        states = []
        for direction, order in ((net.ahead, range(langid.WINDOW)), (net.behind, range(langid.WINDOW - 1, -1, -1))):
            h, mine = np.zeros(units), {}
            for t in order:
                a = direction.table[:, window[t]].astype(float)
                u = direction.back[:, :units].astype(float) @ h + direction.back[:, units]
                z = np.clip((a[:units] + u[:units]) / 4 + 0.5, 0, 1)
                r = np.clip((a[units : 2 * units] + u[units : 2 * units]) / 4 + 0.5, 0, 1)
                new = np.clip(a[2 * units :] + r * u[2 * units :], -1, 1)
                h = z * h + (1 - z) * new
                mine[t] = h
            states.append(mine)
        for t in range(len(part)):
            if chr(part[t]).isalpha() if part[t] < 128 else True:
                e = np.exp(net.out.astype(float) @ np.concatenate([states[0][t], states[1][t], [1.0]]))
                total += e / e.sum()
                letters += 1
    return total / max(1, letters)


def test_network_equals_a_plain_forward_pass(spark):
    sample = [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat était là", "fr")] * 20
    net = langid.train_network(sample, steps=40, batch=32)
    texts = ["the dog", "der Mann. " * 60, "été là-bas 12 fois", "x", "a" * (langid.WINDOW + 1), " - été"]
    pooled = net.probabilities(texts)
    for text, mine in zip(texts, pooled, strict=True):
        assert np.allclose(mine, plain_probabilities(net, text), atol=1e-3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict_language(df, net).collect():
        mine = plain_probabilities(net, texts[r["doc_id"]])
        assert r["lang_pred"] == net.languages[int(mine.argmax())] and math.isclose(r["score"], mine.max(), abs_tol=1e-3)


def test_language_of_odd_rows(spark):
    rows = odd_rows(spark)
    known = rows.selectExpr("doc_id", "text", "case when doc_id = 6 then 'fr' end as lang")
    for net in (langid.train(known), langid.train(known.limit(0))):
        got = langid.predict_language(rows, net).collect()
        assert len(got) == len(ODD)
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4, 5))
    assert langid.predict_language(rows.limit(0), None).collect() == []


def test_long_texts_leave_the_sample_its_rows(spark):
    """Every fourth text is too long for the sample, or so long that few of them fill it."""
    texts = [(i, ("x" * (200_000 if i % 8 else 30_000)) if i % 4 == 0 else f"short {i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as label")
    sample = labelled_sample(docs, labels, 50, 100_000)
    assert len(sample) == 50 and all(t.startswith("short") for t, _ in sample)
    sample = labelled_sample(docs, labels, 200, 100_000)
    assert sum(t.startswith("short") for t, _ in sample) > 80 and 0 < sum(t.startswith("x") for t, _ in sample) <= 3
    assert sum(len(t) for t, _ in sample) <= 100_000
    assert labelled_sample(docs.where("doc_id % 8 = 4"), labels, 50, 100_000) == []
