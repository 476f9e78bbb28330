"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``passage_words`` words.  Each passage is
described by its byte and word-shape distribution, encoded by a small network,
and weighted by gated attention; the document's score is read from the weighted
mean.  Only documents carry labels, the attention learns which passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext

_WORD_BUCKETS = 64
_SHAPES = 6
FEATURES = 256 + _WORD_BUCKETS + _SHAPES


@dataclass(frozen=True)
class QualityRule:
    """Passage length, decision threshold, and the bounds of the training sample.

    ``sample_rows`` labelled documents of each class at most are used to learn,
    taken in the order of a hash of their id; longer ones than ``sample_chars``
    are not used to learn.  Scoring has no such bounds.
    """

    passage_words: int = 48
    threshold: float = 0.3
    sample_rows: int = 1500
    sample_chars: int = 60_000
    hidden: int = 24
    gate: int = 12
    epochs: int = 12
    rate: float = 0.01
    seed: int = 7


@dataclass
class QualityModel:
    """Weights of encoder, gated attention and read-out."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag; ``bags`` holds where each begins."""
        return _forward(self.weights, (features - self.mean) / self.scale, bags)["p"]


def passages(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice, and the first passage of each text.

    A text without words is one passage of zeros.
    """
    powers = _POWERS
    inside = ~_SPACES[data]
    starts, ends = bytetext.runs(inside, offsets)
    n_texts = len(offsets) - 1
    doc_of = np.searchsorted(offsets, starts, "right") - 1
    per_doc = np.bincount(doc_of, minlength=n_texts)
    n_passages = np.maximum(1, -(-per_doc // size))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    first_word = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
    passage = first[doc_of] + (np.arange(len(starts)) - first_word[doc_of]) // size
    total = int(first[-1])
    lengths = ends - starts
    words = np.bincount(passage, minlength=total).astype(np.float32)
    safe = np.maximum(words, 1)[:, None]
    # bytes of words only, each counted in its passage
    of_byte = np.repeat(passage, lengths)
    inner = data[inside]
    octets = np.bincount(of_byte * 256 + inner, minlength=total * 256).reshape(total, 256).astype(np.float32)
    octets /= np.maximum(octets.sum(1, keepdims=True), 1)
    hashes = bytetext.span_hashes(data, starts, ends, powers)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % _WORD_BUCKETS
    spread = np.bincount(passage * _WORD_BUCKETS + bucket, minlength=total * _WORD_BUCKETS).reshape(total, -1) / safe
    shape = np.zeros((total, _SHAPES), np.float32)
    if len(starts):
        head, tail = data[starts], data[ends - 1]
        same = np.zeros(len(starts), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        for k, marks in enumerate((same, (head >= 65) & (head <= 90), ~_WORDLIKE[tail], lengths == 1, ~_WORDLIKE[head])):
            shape[:, k] = np.bincount(passage, marks, minlength=total) / safe[:, 0]
        shape[:, 5] = np.log1p(np.bincount(passage, lengths, minlength=total) / safe[:, 0]) / 4
    return np.concatenate([np.sqrt(octets), np.sqrt(spread), shape], axis=1, dtype=np.float32), first[:-1]


_POWERS = bytetext.Powers()
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_WORDLIKE = bytetext.letters_table()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(bags, len(x)))
    h = np.tanh(x @ w["W"] + w["b"])
    left, gate = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (left * gate) @ w["a"]
    shifted = np.exp(logit - np.repeat(np.maximum.reduceat(logit, bags), sizes))
    alpha = shifted / np.repeat(np.add.reduceat(shifted, bags), sizes)
    z = np.add.reduceat(h * alpha[:, None], bags, axis=0)
    return {"h": h, "left": left, "gate": gate, "alpha": alpha, "z": z, "sizes": sizes, "p": _sigmoid(z @ w["c"] + w["d"][0])}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, bags)
    h, alpha, sizes = f["h"], f["alpha"], f["sizes"]
    err = (f["p"] - y) * weight / len(y)
    dz = np.repeat(err[:, None] * w["c"][None], sizes, axis=0)
    d_alpha = (dz * h).sum(1)
    centred = d_alpha - np.repeat(np.add.reduceat(d_alpha * alpha, bags), sizes)
    d_logit = alpha * centred
    d_prod = d_logit[:, None] * w["a"][None]
    d_left = d_prod * f["gate"] * (1 - f["left"] ** 2)
    d_gate = d_prod * f["left"] * f["gate"] * (1 - f["gate"])
    dh = (dz * alpha[:, None] + d_left @ w["V"].T + d_gate @ w["U"].T) * (1 - h**2)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ d_left, "U": h.T @ d_gate,
        "a": (f["left"] * f["gate"]).T @ d_logit, "c": f["z"].T @ err, "d": np.array([err.sum()]),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, rule: QualityRule) -> QualityModel:
    """Learn from bags of passage features; with no bag or one class, scores are constant."""
    rng = np.random.default_rng(rule.seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {
        "W": draw(FEATURES, rule.hidden), "b": np.zeros(rule.hidden, np.float32), "V": draw(rule.hidden, rule.gate),
        "U": draw(rule.hidden, rule.gate), "a": draw(rule.gate), "c": np.zeros(rule.hidden, np.float32), "d": np.zeros(1, np.float32),
    }
    if not bags or labels.min() == labels.max():
        w["d"][0] = 0.0 if not bags else (4.0 if labels[0] else -4.0)
        return QualityModel(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), w)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    share = np.array([max(1, (labels == k).sum()) for k in (0, 1)]) / len(labels)
    weight = np.where(labels == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(rule.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            chosen = order[at : at + 32]
            x = np.concatenate([bags[i] for i in chosen])
            begin = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])[:-1]
            grads = _gradient(w, x, begin, labels[chosen].astype(np.float32), weight[chosen])
            step += 1
            rate = rule.rate * (1 - epoch / rule.epochs)
            for k, g in grads.items():
                g = g + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, rule: QualityRule = QualityRule(), learnable=None) -> QualityModel:
    """Fit on a bounded sample of labelled documents.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; rows with nulls are
    skipped, repeated ones averaged).  ``learnable`` is a condition on ``doc_id``
    that keeps held-out rows away.  At most ``2 * sample_rows`` documents of
    ``sample_chars`` characters reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null")
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = bytetext.bounded_sample(known, "doc_id", "quality", rule.sample_rows, 2)
    texts = bytetext.id_and_text(docs).where(F.length("text") <= rule.sample_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", F.encode("text", "utf-8").alias("raw"), "quality").collect()
    rows.sort(key=lambda r: r.doc_id)
    bags = []
    for r in rows:
        data = np.frombuffer(bytes(r.raw), np.uint8)
        bags.append(passages(data, np.array([0, len(data)]), rule.passage_words)[0])
    return fit(bags, np.array([r.quality for r in rows], np.int64), rule)


def score(docs: DataFrame, model: QualityModel, rule: QualityRule = QualityRule()) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``, from its whole text alone.

    Null and empty texts are one empty passage and get the model's score of it.
    Repeated rows give repeated results, other columns are ignored, and an empty
    table gives an empty result.  No shuffle; a task holds one slice of a batch.
    """
    size, threshold = rule.passage_words, rule.threshold
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytetext.slices(batches):
            features, bags = passages(*bytetext.flat(part.column("text")), size)
            p = model.scores(features, bags).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return texts.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, rule: QualityRule = QualityRule()) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, all columns as they came."""
    size, threshold = rule.passage_words, rule.threshold
    bytetext.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytetext.slices(batches):
            features, bags = passages(*bytetext.flat(part.column("text")), size)
            yield part.filter(pa.array(model.scores(features, bags) >= threshold))

    return docs.mapInArrow(run, docs.schema)
