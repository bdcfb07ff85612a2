"""Language of a text by a bidirectional gated recurrent network over its bytes.

Both directions run over windows of bytes; every position gets a probability of each language from
the two states there, and a document's probabilities are the mean over its letters. The network is
trained in numpy by backpropagation through time. Gates are piecewise linear, which keeps a step
cheap: all windows of a batch step together, with states in columns.
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.llm.common import labelled_sample, share, slices

#: Bounds of the sample that the network is trained on.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 24 << 20
#: Units of each direction, bytes of a window, and windows that step together.
UNITS = 8
WINDOW = 128
TOGETHER = 1024
#: Bytes of a training window, windows of a training step, and steps.
TRAIN_WINDOW = 48
TRAIN_BATCH = 256
TRAIN_STEPS = 400

UNKNOWN = "und"
_LATIN = re.compile("[A-Za-z]")
#: Bytes that count as letters: Latin ones and those of all other scripts.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class Direction:
    """``table``: what each byte adds to update, reset and new state; ``back``: what the state adds.

    The last column of ``back`` is a bias, so states carry a last row of ones.
    """

    table: np.ndarray
    back: np.ndarray


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray  # languages x (both directions' units and a bias)

    def positions(self, text: str) -> list[str]:
        """The language of each byte of the text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [p[:, :n].argmax(0) for p, n in self._walk(raw, np.arange(0, len(raw), WINDOW))]
        return [self.languages[i] for part in found for i in part.tolist()]

    def _walk(self, raw: np.ndarray, starts: np.ndarray):
        """(probabilities by language and position, length) of each window, one after the other."""
        for start in starts:
            window = raw[start : start + WINDOW]
            whole = np.full((WINDOW, 1), 32, np.uint8)
            whole[: len(window), 0] = window
            seen = np.zeros((len(self.languages), WINDOW), np.float32)
            self.pool(whole, np.ones((WINDOW, 1), np.float32), lambda t, p: seen.__setitem__((slice(None), t), p[:, 0]))
            yield seen, len(window)

    def pool(self, columns: np.ndarray, weight: np.ndarray, each=None) -> np.ndarray:
        """Weighted sums of the positions' probabilities, a row per language and a column per window.

        ``columns`` holds a window of bytes per column.
        """
        steps, n = columns.shape
        units = UNITS
        kept = np.empty((steps, units, n), np.float32)
        sums = np.zeros((len(self.languages), n), np.float32)
        byte, back = np.empty((3 * units, n), np.float32), np.empty((3 * units, n), np.float32)
        first, second = self.out[:, :units].copy(), self.out[:, units:].copy()
        for direction, order in ((self.ahead, range(steps)), (self.behind, reversed(range(steps)))):
            # A gate is clip(x / 4 + 1 / 2, 0, 1); the scaling is done once here.
            table, weights = direction.table.copy(), direction.back.copy()
            table[: 2 * units] = table[: 2 * units] / 4 + 0.5
            weights[: 2 * units] /= 4
            state = np.zeros((units + 1, n), np.float32)
            state[units] = 1
            h = state[:units]
            gates, new = byte[: 2 * units], byte[2 * units :]
            z, r = byte[:units], byte[units : 2 * units]
            for t in order:
                np.take(table, columns[t], axis=1, out=byte, mode="clip")
                np.dot(weights, state, out=back)
                gates += back[: 2 * units]
                np.clip(gates, 0, 1, out=gates)
                r *= back[2 * units :]
                new += r
                np.clip(new, -1, 1, out=new)
                h -= new
                h *= z
                h += new
                if direction is self.ahead:
                    kept[t] = h
                else:
                    logits = np.dot(first, kept[t])
                    logits += np.dot(second, state)
                    np.exp(logits, out=logits)
                    logits *= weight[t] / logits.sum(0)
                    sums += logits
                    if each is not None:
                        each(t, logits)
        return sums

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        """Mean probabilities over the letters of each whole text; zeros without letters."""
        raws = [(t or "").encode() for t in texts]
        sizes = np.array([len(r) for r in raws], np.int64)
        totals = np.zeros((len(raws), len(self.languages)))
        letters = np.zeros(len(raws))
        if not sizes.sum():
            return totals
        buffer = np.frombuffer(b"".join(raws) + b" " * WINDOW, np.uint8)
        counts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(raws)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = np.cumsum(sizes)
        starts, ends = (ends - sizes)[doc] + nth * WINDOW, ends[doc]
        for at in range(0, len(doc), TOGETHER):
            mine = slice(at, at + TOGETHER)
            where = starts[mine, None] + np.arange(WINDOW)
            inside = where < ends[mine, None]
            window = np.where(inside, buffer[np.where(inside, where, 0)], np.uint8(32))
            weight = np.ascontiguousarray((_LETTER[window] & inside).T, np.float32)
            sums = self.pool(np.ascontiguousarray(window.T), weight)
            np.add.at(totals, doc[mine], sums.T)
            np.add.at(letters, doc[mine], weight.sum(0))
        return totals / np.maximum(letters, 1)[:, None]


def _forward(d: Direction, columns, order):
    """All that backpropagation needs, by time: state before, gates, new state, recurrent part."""
    units, n = UNITS, columns.shape[1]
    h, trace, states = np.zeros((units, n), np.float32), {}, {}
    for t in order:
        a = d.table[:, columns[t]]
        u = d.back[:, :units] @ h + d.back[:, units:]
        gates = np.clip((a[: 2 * units] + u[: 2 * units]) / 4 + 0.5, 0, 1)
        z, r = gates[:units], gates[units:]
        new = np.clip(a[2 * units :] + r * u[2 * units :], -1, 1)
        trace[t] = (h, z, r, new, u[2 * units :])
        h = new + z * (h - new)
        states[t] = h
    return trace, states


def _backward(d: Direction, columns, order, trace, pulls):
    """Gradients of a direction, from those of its states."""
    units = UNITS
    carried = np.zeros_like(trace[0][0])
    table, back = np.zeros_like(d.table), np.zeros_like(d.back)
    parts = np.empty((3 * units, *columns.shape), np.float32)
    for t in order:
        before, z, r, new, u = trace[t]
        dh = carried + pulls[t]
        dnew = dh * (1 - z) * (np.abs(new) < 1)
        dz = dh * (before - new) * ((z > 0) & (z < 1)) / 4
        dr = dnew * u * ((r > 0) & (r < 1)) / 4
        parts[:, t] = np.concatenate([dz, dr, dnew])
        du = np.concatenate([dz, dr, dnew * r])
        back[:, :units] += du @ before.T
        back[:, units] += du.sum(1)
        carried = dh * z + d.back[:, :units].T @ du
    flat = columns.reshape(-1)
    for k in range(3 * units):
        table[k] = np.bincount(flat, parts[k].reshape(-1), 256)
    return table, back


def train_network(
    sample: list[tuple[str, str]], steps: int = TRAIN_STEPS, batch: int = TRAIN_BATCH, seed: int = 7
) -> Network | None:
    """Train on windows at random places of the sampled texts; None without any letter to learn from."""
    sample = [(t.encode(), label) for t, label in sample if has_letter(t)]
    if not sample:
        return None
    languages = sorted({label for _, label in sample})
    by_language = [[t for t, label in sample if label == name] for name in languages]
    rng = np.random.default_rng(seed)
    units, n = UNITS, len(languages)

    def direction():
        table = rng.normal(0, 0.5, (3 * units, 256)).astype(np.float32)
        back = rng.normal(0, 0.3, (3 * units, units + 1)).astype(np.float32)
        back[:units, units] = 1.0  # keep the state at first
        return Direction(table, back)

    net = Network(languages, direction(), direction(), rng.normal(0, 0.3, (n, 2 * units + 1)).astype(np.float32))
    net.out[:, -1] = 0
    params = [net.ahead.table, net.ahead.back, net.behind.table, net.behind.back, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        columns = np.full((TRAIN_WINDOW, batch), 32, np.uint8)
        target = rng.integers(0, n, batch)
        for j, k in enumerate(target):
            raw = by_language[k][rng.integers(len(by_language[k]))]
            start = rng.integers(max(1, len(raw) - TRAIN_WINDOW + 1))
            part = np.frombuffer(raw[start : start + TRAIN_WINDOW], np.uint8)
            columns[: len(part), j] = part
        letters = _LETTER[columns] & (columns != 32)
        scale = 1 / max(1, letters.sum())
        trace_a, states_a = _forward(net.ahead, columns, range(TRAIN_WINDOW))
        trace_b, states_b = _forward(net.behind, columns, reversed(range(TRAIN_WINDOW)))
        d_out = np.zeros_like(net.out)
        pulls_a, pulls_b = {}, {}
        for t in range(TRAIN_WINDOW):
            state = np.concatenate([states_a[t], states_b[t], np.ones((1, batch), np.float32)])
            p = np.exp(net.out @ state)
            p /= p.sum(0)
            p[target, np.arange(batch)] -= 1
            p *= letters[t] * np.float32(scale)
            d_out += p @ state.T
            pull = net.out.T @ p
            pulls_a[t], pulls_b[t] = pull[:units], pull[units : 2 * units]
        grads = [
            *_backward(net.ahead, columns, reversed(range(TRAIN_WINDOW)), trace_a, pulls_a),
            *_backward(net.behind, columns, range(TRAIN_WINDOW), trace_b, pulls_b),
            d_out,
        ]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g *= min(1.0, 1.0 / max(size, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame) -> Network | None:
    """The network of a bounded sample of (doc_id, text, lang); held-out ids and null lang take no part."""
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    return train_network(labelled_sample(docs, labels, SAMPLE_ROWS, SAMPLE_BYTES))


def predict_language(
    docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there was
    nothing to learn from. Ties go to the first language by name. Other columns are ignored and
    repeated rows come back each.
    """
    shared = share(docs.sparkSession, net)  # some 100 KB, whatever the corpus

    def predict(batches):
        net = shared()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            known = [net is not None and has_letter(t) for t in texts]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if any(known):
                pooled = net.probabilities(t if k else None for t, k in zip(texts, known, strict=True))
                best = pooled.argmax(1)
                scores = np.where(known, np.minimum(1, pooled[np.arange(len(texts)), best]), 0)
                names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()),
            })

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
