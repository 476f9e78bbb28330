"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of windows.  To predict, a text is cut into windows that cover it wholly,
every position gets label probabilities, and the document takes their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRule:
    """Network size, window length, and the bounds of the training sample.

    ``sample_rows`` documents of each of the ``sample_langs`` most frequent
    languages at most are used to learn, taken in the order of a hash of their id,
    and ``sample_windows`` windows of each: its beginning, and others at hashed places.  Prediction has no
    such bounds.
    """

    hidden: int = 12
    window: int = 64
    train_window: int = 40
    sample_rows: int = 300
    sample_windows: int = 6
    sample_langs: int = 100
    steps: int = 420
    batch: int = 128
    rate: float = 0.02
    seed: int = 11
    slice_bytes: int = 1 << 18


@dataclass
class LanguageModel:
    """Weights, and the languages in the order of the outputs."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities ``[time, window, label]`` of byte windows ``[time, window]``."""
        w = self.weights
        steps, n = windows.shape
        size = w["Uf"].shape[0]
        # windows lie along the last axis: a row is one unit's values, and gates are whole rows
        out = np.empty((steps, len(self.langs), n), np.float32)
        out[:] = w["bo"][:, None]
        x, g = np.empty((3 * size, n), np.float32), np.empty((3 * size, n), np.float32)
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: the halves go into the weights of both gates
            half = np.where(np.arange(3 * size) < 2 * size, 0.5, 1.0).astype(np.float32)
            table = np.ascontiguousarray(((w["E" + way] + w["b" + way]) * half).T)
            back, read = np.ascontiguousarray((w["U" + way] * half).T), np.ascontiguousarray(w["O" + way].T)
            h = np.zeros((size, n), np.float32)
            for t in order:
                np.take(table, windows[t], axis=1, out=x, mode="clip")
                np.matmul(back, h, out=g)
                gates, new = x[: 2 * size], g[2 * size :]
                gates += g[: 2 * size]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new *= gates[size:]
                new += x[2 * size :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:size]
                h += new
                out[t] += read @ h
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out.transpose(0, 2, 1)

    def documents(self, data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
        """Mean probabilities of each text of a slice, over all its positions."""
        lengths = np.diff(offsets)
        per = np.maximum(1, -(-lengths // window))
        doc = np.repeat(np.arange(len(lengths)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        # the last window of a longer text ends with it, so only short texts are padded
        begin = offsets[doc] + np.minimum(k * window, np.maximum(0, lengths[doc] - window))
        at = begin[None, :] + np.arange(window)[:, None]
        real = at < offsets[doc + 1][None, :]
        bytes_ = np.full(at.shape, 32, np.uint8)
        bytes_[real] = data[at[real]]
        p = self.positions(bytes_)
        p *= real[:, :, None]
        total = np.zeros((len(lengths), len(self.langs)))
        np.add.at(total, doc, p.sum(0))
        return total / np.maximum(np.bincount(doc, real.sum(0), minlength=len(lengths)), 1)[:, None]


def _start(langs: int, rule: LanguageRule) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(rule.seed)
    size, w = rule.hidden, {"bo": np.zeros(langs, np.float32)}
    for way in "fb":
        w["E" + way] = (0.3 * rng.standard_normal((256, 3 * size))).astype(np.float32)
        w["U" + way] = (rng.standard_normal((size, 3 * size)) / np.sqrt(size)).astype(np.float32)
        w["b" + way] = np.zeros(3 * size, np.float32)
        w["O" + way] = (rng.standard_normal((size, langs)) / np.sqrt(size)).astype(np.float32)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gradients(w: dict[str, np.ndarray], windows: np.ndarray, target: np.ndarray, real: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all real positions, and its gradients by backpropagation through time."""
    steps, n = windows.shape
    share = np.full((steps, n), 1 / (steps * n), np.float32) if real is None else (real / max(1, real.sum())).astype(np.float32)
    size, states = w["Uf"].shape[0], {}
    logits = np.zeros((steps, n, len(w["bo"])), np.float32) + w["bo"]
    for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h, kept = np.zeros((n, size), np.float32), {}
        for t in order:
            x, g = w["E" + way][windows[t]] + w["b" + way], h @ w["U" + way]
            z, r = _sigmoid(x[:, :size] + g[:, :size]), _sigmoid(x[:, size : 2 * size] + g[:, size : 2 * size])
            new = np.tanh(x[:, 2 * size :] + r * g[:, 2 * size :])
            kept[t] = (h, z, r, new, g[:, 2 * size :])
            h = new + z * (h - new)
            logits[t] += h @ w["O" + way]
            kept[t] += (h,)
        states[way] = kept
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    loss = -(np.log(p[:, np.arange(n), target] + 1e-9) * share).sum()
    p[:, np.arange(n), target] -= 1
    p *= share[:, :, None]
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["bo"] = p.sum((0, 1))
    for way, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        carry = np.zeros((n, size), np.float32)
        for t in order:
            before, z, r, new, inner, h = states[way][t]
            grads["O" + way] += h.T @ p[t]
            dh = p[t] @ w["O" + way].T + carry
            d_new = dh * (1 - z) * (1 - new**2)
            d_z = dh * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
            grads["U" + way] += before.T @ d_g
            grads["b" + way] += d_x.sum(0)
            np.add.at(grads["E" + way], windows[t], d_x)
            carry = dh * z + d_g @ w["U" + way].T
    return float(loss), grads


def fit(windows: list[bytes], names: list[str], rule: LanguageRule) -> LanguageModel:
    """Learn from equally long byte windows and their languages."""
    langs = sorted(set(names))
    if len(langs) < 2:
        return LanguageModel(langs or [UNKNOWN], _start(max(1, len(langs)), rule))
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), -1)
    y = np.searchsorted(langs, names)
    # each language is drawn equally often
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    rng = np.random.default_rng(rule.seed)
    w = _start(len(langs), rule)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, rule.steps + 1):
        chosen = np.array([rng.choice(of[k]) for k in rng.integers(0, len(langs), rule.batch)])
        # some windows are cut short and padded, as short texts are when they are read
        length = np.where(rng.random(rule.batch) < 0.3, rng.integers(4, x.shape[1] + 1, rule.batch), x.shape[1])
        real = np.arange(x.shape[1])[:, None] < length[None]
        _, grads = gradients(w, np.where(real, x[chosen].T, 32), y[chosen], real)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = rule.rate * (1 - (step - 1) / rule.steps)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return LanguageModel(langs, w)


def train(docs: DataFrame, rule: LanguageRule = LanguageRule(), learnable=None) -> LanguageModel:
    """Fit on windows of a bounded sample of ``docs (doc_id, text, lang)``.

    Rows with a null id, text or language and texts shorter than a window are not
    used to learn.  ``learnable`` is a condition on ``doc_id`` that keeps held-out
    rows away.  Only the windows reach the driver.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null")
    known = known.where(F.length("text") >= rule.train_window)
    if learnable is not None:
        known = known.where(learnable)
    ids = bytetext.bounded_sample(known, "doc_id", "lang", rule.sample_rows, rule.sample_langs)
    place = F.pmod(F.xxhash64("doc_id", "k"), F.length("text") - rule.train_window + 1).cast("int") + 1
    place = F.when(F.col("k") == 1, 1).otherwise(place)
    cut = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(1), F.lit(rule.sample_windows))).alias("k"))
    rows = cut.select("doc_id", "k", "lang", F.encode(F.substring(F.col("text"), place, F.lit(rule.train_window)), "utf-8").alias("raw")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.k, r.lang, bytes(r.raw)))
    return fit([bytes(r.raw)[: rule.train_window] for r in rows], [r.lang for r in rows], rule)


def predict(docs: DataFrame, model: LanguageModel, rule: LanguageRule = LanguageRule()) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from its whole text alone.

    ``score`` is the mean probability of the predicted language over all byte
    positions.  Null texts and texts without a letter are ``und`` with score 0.
    Ties go to the language first in order.  Repeated rows give repeated results;
    other columns are ignored.
    """
    texts = bytetext.id_and_text(docs).withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytetext.slices(batches, limit=rule.slice_bytes):
            lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = bytetext.flat(part.column("text"))
            if offsets[-1] > 4 * rule.slice_bytes:
                p = _long_text(model, data, rule)
            else:
                p = model.documents(data, offsets, rule.window)
            best = p.argmax(1)
            names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
            scores = np.where(lettered, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _long_text(model: LanguageModel, data: np.ndarray, rule: LanguageRule) -> np.ndarray:
    """One very long text, piece by piece."""
    total, step = np.zeros((1, len(model.langs))), rule.slice_bytes // rule.window * rule.window
    for at in range(0, len(data), step):
        piece = data[at : at + step]
        total += model.documents(piece, np.array([0, len(piece)]), rule.window) * len(piece)
    return total / len(data)
