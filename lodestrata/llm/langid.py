"""Operator 3: language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes, one in each direction; a linear layer on
both states labels every byte. A document's probabilities are the mean of its letter bytes'.
Gates use s(x) = x / (1 + |x|): the update is n + z * (h - n), with z and r in (0, 1).

Training is numpy backpropagation through time on a bounded sample (``TRAIN_WINDOWS`` windows of
``TRAIN_CHARS`` characters) of rows with a label outside the held-out quarter. Inference runs on
Spark over whole texts, cut into segments of ``SEGMENT`` bytes that are read side by side; each
segment starts from the zero state, so every byte is labelled from its own segment.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no labels.
A null id is not held out. If no row has a label, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import hash_sample, prepare

TRAIN_WINDOWS = 4096
TRAIN_CHARS = 200
HIDDEN = 8
SEGMENT = 128
LANES = 1024
LEAST_UPDATES = 280
UNDETERMINED = "und"
#: Bytes that count towards a document's probabilities: ASCII letters and parts of longer characters.
LETTER_BYTE = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)], np.float32)


def _s(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Layer:
    """One direction: ``inputs`` (256, 3H) by byte, ``state`` (3H, H); gates in the order z, r, n."""

    inputs: np.ndarray
    state: np.ndarray

    def read(self, codes: np.ndarray, mask: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
        """States (T, H, B) for codes (T, B); a masked-out place resets the state."""
        steps, lanes = codes.shape
        size = self.state.shape[1]
        states = np.empty((steps, size, lanes), np.float32) if out is None else out
        h = np.zeros((size, lanes), np.float32)
        held, work = np.empty((3 * size, lanes), np.float32), np.empty((2 * size, lanes), np.float32)
        for t in range(steps):
            x = np.ascontiguousarray(self.inputs[codes[t]].T)
            np.dot(self.state, h, out=held)
            gates = x[: 2 * size]
            gates += held[: 2 * size]
            np.abs(gates, out=work)
            work += 1
            gates /= work
            gates *= 0.5
            gates += 0.5
            n = held[2 * size :]
            n *= gates[size:]
            n += x[2 * size :]
            part = work[:size]
            np.abs(n, out=part)
            part += 1
            n /= part
            h = states[t]
            np.subtract(states[t - 1] if t else 0.0, n, out=h)
            h *= gates[:size]
            h += n
            if mask is not None:
                h *= mask[t]
        return states

    def trace(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """States with a leading zero, and what the backward pass needs."""
        steps, lanes = codes.shape
        size = self.state.shape[1]
        states, kept = np.zeros((steps + 1, size, lanes), np.float32), []
        for t in range(steps):
            x, held = self.inputs[codes[t]].T, self.state @ states[t]
            gates = 0.5 + 0.5 * _s(x[: 2 * size] + held[: 2 * size])
            n = _s(x[2 * size :] + gates[size:] * held[2 * size :])
            states[t + 1] = n + gates[:size] * (states[t] - n)
            kept.append((gates, n, held[2 * size :]))
        return states, kept

    def backward(self, codes: np.ndarray, states: np.ndarray, kept: list, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and state, from ``into`` (T, H, B), the loss's gradient at each state."""
        steps, lanes = codes.shape
        size = self.state.shape[1]
        grad_state, pre = np.zeros_like(self.state), np.empty((3 * size, steps, lanes), np.float32)
        carry = np.zeros((size, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            gates, n, inner = kept[t]
            z, r = gates[:size], gates[size:]
            carry = carry + into[t]
            da_n = carry * (1 - z) * (1 - np.abs(n)) ** 2
            da_z = carry * (states[t] - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            da_r = da_n * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            pre[:, t] = np.concatenate([da_z, da_r, da_n])
            through = np.concatenate([da_z, da_r, da_n * r])
            grad_state += through @ states[t].T
            carry = carry * z + self.state.T @ through
        flat = codes.ravel()
        grad_inputs = np.stack([np.bincount(flat, p.ravel(), 256) for p in pre], axis=1).astype(np.float32)
        return grad_inputs, grad_state


@dataclass
class Model:
    languages: list[str]
    forward: Layer
    reverse: Layer
    out: np.ndarray  # (languages, 2H)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def probabilities(self, codes: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """(languages, T, B) for byte codes (T, B)."""
        ahead = self.forward.read(codes, mask)
        back = self.reverse.read(codes[::-1], None if mask is None else mask[::-1])[::-1]
        size = ahead.shape[1]
        logits = np.stack([np.tensordot(row[:size], ahead, (0, 1)) + np.tensordot(row[size:], back, (0, 1)) for row in self.out])
        logits += self.bias[:, None, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits


def new_model(languages: list[str], hidden: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    layers = [Layer(rng.normal(0, 0.5, (256, 3 * hidden)).astype(np.float32), rng.normal(0, 0.4, (3 * hidden, hidden)).astype(np.float32)) for _ in "ab"]
    return Model(languages, *layers, rng.normal(0, 0.4, (len(languages), 2 * hidden)).astype(np.float32), np.zeros(len(languages), np.float32))


def loss_and_gradients(model: Model, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all places, and its gradients in the order of ``parameters``."""
    turned = codes[::-1]
    ahead, kept_a = model.forward.trace(codes)
    back, kept_b = model.reverse.trace(turned)
    both = np.concatenate([ahead[1:], back[:0:-1]], axis=1)  # (T, 2H, B)
    logits = np.einsum("lh,thb->tlb", model.out, both) + model.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    lane = np.arange(codes.shape[1])
    loss = -float(np.log(p[:, labels, lane] + 1e-9).mean())
    p[:, labels, lane] -= 1
    p /= codes.size
    into = np.einsum("lh,tlb->thb", model.out, p)
    size = model.forward.state.shape[1]
    grads = [*model.forward.backward(codes, ahead, kept_a, into[:, :size]), *model.reverse.backward(turned, back, kept_b, into[::-1, size:])]
    return loss, [*grads, np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))]


def parameters(model: Model) -> list[np.ndarray]:
    return [model.forward.inputs, model.forward.state, model.reverse.inputs, model.reverse.state, model.out, model.bias]


def train(windows: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = 64, lanes: int = 128, rounds: int = 3, rate: float = 0.03) -> Model | None:
    """Fits on (text, language) windows; windows are cut into runs of ``steps`` bytes. Adam updates."""
    languages = sorted({language for _, language in windows})
    runs, labels = [], []
    for text, language in windows:
        raw = text.encode()
        for at in range(0, len(raw) - steps + 1, steps):
            runs.append(np.frombuffer(raw, np.uint8, steps, at))
            labels.append(languages.index(language))
        if len(raw) < steps and raw:
            runs.append(np.frombuffer((raw * (steps // len(raw) + 1))[:steps], np.uint8))
            labels.append(languages.index(language))
    if not runs:
        return None
    codes, label = np.stack(runs), np.array(labels)
    model, rng = new_model(languages, hidden), np.random.default_rng(11)
    values = parameters(model)
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    batches = -(-len(codes) // lanes)
    rounds = max(rounds, -(-LEAST_UPDATES // batches))  # small samples are gone over more often
    total = rounds * batches
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), lanes):
            pick = order[at : at + lanes]
            _, grads = loss_and_gradients(model, np.ascontiguousarray(codes[pick].T), label[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            pace = rate * (1 - step / (total + 1)) * min(1.0, 1.0 / (norm + 1e-6))
            for v, g, m1, m2 in zip(values, grads, first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                v -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def label_batch(model: Model, texts: list[bytes], segment: int = SEGMENT, lanes: int = LANES, places: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray] | None]:
    """For each text the mean probabilities of its letter bytes and the counts of its byte labels."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // segment)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(lengths) - lengths, counts) + within * segment
    size = np.minimum(segment, lengths[owner] - within * segment)
    kinds = len(model.languages)
    sums, weights, votes = np.zeros((kinds, len(texts))), np.zeros(len(texts)), np.zeros((kinds, len(texts)), np.int64)
    labels = np.zeros(len(whole), np.uint8) if places else None
    order = np.argsort(-size, kind="stable")
    offsets = np.arange(segment)
    for at in range(0, len(order), lanes):
        pick = order[at : at + lanes]
        longest = int(size[pick[0]])
        spots = start[pick][None, :] + offsets[:longest, None]
        mask = None
        if size[pick[-1]] < longest:
            mask = (offsets[:longest, None] < size[pick][None, :]).astype(np.float32)
            spots = np.minimum(spots, len(whole) - 1)
        codes = whole[spots]
        p = model.probabilities(codes, mask)
        best = p.argmax(axis=0).astype(np.uint8)
        letters = LETTER_BYTE[codes]
        if mask is not None:
            letters *= mask
        for k in range(kinds):
            sums[k] += np.bincount(owner[pick], np.einsum("tb,tb->b", p[k], letters), len(texts))
            hit = best == k
            votes[k] += np.bincount(owner[pick], (hit if mask is None else hit & (mask > 0)).sum(axis=0), len(texts)).astype(np.int64)
        weights += np.bincount(owner[pick], letters.sum(axis=0), len(texts))
        if labels is not None:
            real = np.ones(spots.shape, bool) if mask is None else mask > 0
            labels[spots[real]] = best[real]
    parts = np.split(labels, np.cumsum(lengths)[:-1]) if labels is not None and len(texts) else None
    return (sums / np.maximum(weights, 1e-9)).T, votes.T, parts


def is_held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", windows: int = TRAIN_WINDOWS, chars: int = TRAIN_CHARS) -> Model | None:
    """Trains on at most ``windows`` labelled windows of rows that are not held out, chosen by a hash of the id."""
    place = F.pmod(F.xxhash64(id_column, F.lit(1)), F.greatest(F.length(text_column) - chars, F.lit(0)) + 1) + 1
    rows = df.filter(F.col(lang_column).isNotNull() & ~is_held_out(id_column))
    total = rows.count()  # reads no text
    rows = rows.filter(F.col(text_column).isNotNull())
    rows = rows.select(F.col(id_column).alias("o"), F.substring(text_column, place.cast("int"), F.lit(chars)).alias("w"), F.col(lang_column).alias("l"))
    sample = hash_sample(rows, windows, "o", "w", "l", total=total).collect()
    return train([(row["w"], row["l"]) for row in sample])


def identify(df: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", segment: int = SEGMENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score, byte_labels); the last counts the bytes labelled with each language."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if has_letter(t) else None for t in batch.column(0).to_pylist()]
            known = [n for n, t in enumerate(texts) if t is not None and model]
            names, scores, counts = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
            if known:
                p, votes, _ = label_batch(model, [texts[n].encode() for n in known], segment)
                best = p.argmax(axis=1)
                for n, k, row, vote in zip(known, best.tolist(), p, votes.tolist(), strict=True):
                    names[n], scores[n] = model.languages[k], min(1.0, float(row[k]))
                    counts[n] = ",".join(f"{name}:{v}" for name, v in zip(model.languages, vote, strict=True) if v)
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], "lang_pred", "score", "byte_labels"])

    rows = df.select(F.col(text_column).alias("__text"), id_column, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, byte_labels string")


def screen(df: DataFrame, model: Model | None, least_score: float, text_column: str = "text", lang_column: str = "lang", segment: int = SEGMENT) -> DataFrame:
    """The rows of df, same columns, whose language is determined with at least this score; a null language is filled in."""
    prepare(df.sparkSession)
    text_at, lang_at = df.columns.index(text_column), df.columns.index(lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            known = [n for n, t in enumerate(texts) if model and has_letter(t)]
            stays, langs = [False] * len(texts), batch.column(lang_at).to_pylist()
            if known:
                p, _, _ = label_batch(model, [texts[n].encode() for n in known], segment)
                for n, row in zip(known, p, strict=True):
                    stays[n] = bool(row.max() >= least_score)
                    langs[n] = langs[n] if langs[n] is not None else model.languages[int(row.argmax())]
            columns = batch.columns
            columns[lang_at] = pa.array(langs, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stays, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``identify``."""
    return found.select(id_column, is_held_out(id_column).alias("held_out"), "lang_pred", "score", "byte_labels")
