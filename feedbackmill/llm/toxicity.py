"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or.

Only documents are labelled. A sentence is toxic with probability sigmoid(bias + sum of its words'
weights), and a document is toxic unless none of its sentences is. Training maximises the
likelihood of the documents' labels; the sentence scores then show where the offence is.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.llm.common import labelled_sample, share, slices, worker_store

#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS = 5000
SAMPLE_BYTES = 16 << 20
#: Hashed weights, and the lengths of word beginnings that have a weight besides the whole word's.
BUCKETS = 1 << 18
BEGINNINGS = range(3, 8)
#: Documents of the sample in which a weight's words must occur.
MIN_DOCUMENTS = 4
#: Probability from which a sentence is reported, and from which a document counts as toxic.
SENTENCE_AT = 0.5
TOXIC_AT = 0.7
#: Words whose weight a Python worker keeps.
KEPT_WORDS = 200_000

_TOKENS = re.compile(r"\w+|[.!?\n]")
_SENTENCES = re.compile(r"[^.!?\n]+[.!?]*")
_ENDS = (".", "!", "?", "\n")


def word_features(word: str) -> list[int]:
    """Buckets of a lower-cased word: itself and its beginnings."""
    names = ["=" + word, *(word[:n] for n in BEGINNINGS if n <= len(word))]
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


@dataclass
class SentenceModel:
    """Weights of words and the bias of a sentence; ``key`` tells models of one worker apart."""

    weights: np.ndarray
    bias: float
    key: str

    def kept(self) -> dict[str, float]:
        store = worker_store("toxicity")
        if self.key not in store:
            store.clear()
            store[self.key] = {end: None for end in _ENDS}
        return store[self.key]

    def sentence_logits(self, text: str | None) -> np.ndarray:
        """Of every sentence with a word; none for null texts and texts without words."""
        tokens = _TOKENS.findall((text or "").lower())
        known = self.kept()
        if len(known) > KEPT_WORDS:
            worker_store("toxicity").clear()
            known = self.kept()
        for word in set(tokens).difference(known):
            known[word] = float(self.weights[word_features(word)].sum())
        found = np.array(list(map(known.__getitem__, tokens)), float)
        ends = np.isnan(found)
        sentence = np.cumsum(ends)[~ends]
        if not len(sentence):
            return np.zeros(0)
        _, sentence = np.unique(sentence, return_inverse=True)
        return np.bincount(sentence, found[~ends]) + self.bias

    def score(self, text: str | None) -> float:
        """Probability that some sentence is toxic; 0 for texts without words."""
        return float(-np.expm1(-np.logaddexp(0, self.sentence_logits(text)).sum()))

    def offences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) in code points of the sentences at least as likely as not."""
        found = []
        for m in _SENTENCES.finditer(text or ""):
            logits = self.sentence_logits(m[0])
            if len(logits) and (p := float(1 / (1 + np.exp(-logits[0])))) >= SENTENCE_AT:
                found.append((m.start(), m.end(), p))
        return found


def fit_sentences(
    sample: list[tuple[str, int]], rounds: int = 160, rate: float = 0.05, votes: float = 0.5
) -> SentenceModel:
    """Fit by full-batch proximal Adam on the noisy-or likelihood with an absolute-value penalty.

    The penalty equals the pull of ``votes`` documents, so chance words keep no weight. An empty sample gives a model of zero scores.
    """
    words: dict[str, int] = {}
    features: list[np.ndarray] = []  # buckets of each word
    seen = np.zeros(BUCKETS, np.int32)  # documents with each bucket
    flat, sentence_of, doc_of, labels = [], [], [], []
    sentences = 0
    for text, label in sample:
        first = sentences
        for m in re.split(r"[.!?\n]", text.lower()):
            ids = [words.setdefault(w, len(words)) for w in re.findall(r"\w+", m)]
            if ids:
                flat.append(np.array(ids, np.int32))
                doc_of.append(len(labels))
                sentences += 1
        if sentences > first:
            labels.append(int(label == 1))
            features += [np.array(word_features(w), np.int32) for w in list(words)[len(features) :]]
            mine = np.unique(np.concatenate(flat[first:]))
            seen[np.unique(np.concatenate([features[i] for i in mine]))] += 1
    weights, bias = np.zeros(BUCKETS), -6.0
    if not sentences:
        return SentenceModel(weights.astype(np.float32), -50.0, "empty")
    sentence_of = np.repeat(np.arange(sentences, dtype=np.int32), [len(x) for x in flat])
    flat, doc_of = np.concatenate(flat), np.array(doc_of, np.int32)
    labels = np.array(labels, float)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    buckets = np.concatenate(features)
    # Weights that few documents speak for would only learn those documents by heart.
    keep = seen[buckets] >= MIN_DOCUMENTS
    owner, buckets = owner[keep], buckets[keep]
    used, buckets = np.unique(buckets, return_inverse=True)
    weighted = np.isin(flat, owner)
    flat, sentence_of = flat[weighted], sentence_of[weighted]
    w = np.zeros(len(used))
    mean, square, mean_b, square_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        per_word = np.bincount(owner, w[buckets], len(features))
        z = np.bincount(sentence_of, per_word[flat], sentences) + bias
        clean = np.bincount(doc_of, np.logaddexp(0, z), len(labels))  # -log of no toxic sentence
        # d loss / d z: p for clean documents, -p (1 - P) / P for toxic ones.
        pull = np.where(labels > 0, -1 / np.maximum(np.expm1(np.minimum(clean, 500)), 1e-9), 1.0)
        dz = pull[doc_of] / (1 + np.exp(np.minimum(-z, 500)))
        g = np.bincount(buckets, np.bincount(flat, dz[sentence_of], len(features))[owner], len(used))
        g /= len(labels)
        gb = dz.sum() / len(labels)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        mean_b, square_b = 0.9 * mean_b + 0.1 * gb, 0.99 * square_b + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        each = step / (np.sqrt(square) + 1e-6)
        w -= each * mean
        w = np.sign(w) * np.maximum(0, np.abs(w) - each * votes / len(labels))
        bias -= step * mean_b / (np.sqrt(square_b) + 1e-6)
    weights[used] = w
    weights = weights.astype(np.float32)
    return SentenceModel(weights, float(bias), f"{zlib.crc32(weights.tobytes())}")


def train(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    """The model of a bounded sample of labelled documents; held-out ids take no part."""
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    return fit_sentences(labelled_sample(docs, known, SAMPLE_ROWS, SAMPLE_BYTES))


def score_toxicity(docs: DataFrame, model: SentenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted and offending sentences (start, end, score) of every row.

    Whole texts are scored. Null, empty and wordless texts score 0; repeated rows come back each.
    Other columns are ignored, also in training.
    """
    schema = (
        "doc_id long, score double, predicted int, "
        "offending array<struct<start: long, end: long, score: double>>"
    )
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    shared = share(docs.sparkSession, model)  # 1 MB, whatever the corpus

    def scored(batches):
        model = shared()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            scores = [min(1.0, max(0.0, model.score(t))) for t in texts]
            found = [
                [dict(zip(("start", "end", "score"), x)) for x in model.offences(t)] if s >= SENTENCE_AT else []
                for t, s in zip(texts, scores, strict=True)
            ]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= TOXIC_AT) for s in scores], pa.int32()),
                "offending": pa.array(found, spans),
            })

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, model: SentenceModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that don't count as toxic, with all their columns; nothing is moved."""
    shared = share(docs.sparkSession, model)

    def clean(batches):
        model = shared()
        for batch in slices(batches, text):
            kept = [model.score(t) < TOXIC_AT for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
