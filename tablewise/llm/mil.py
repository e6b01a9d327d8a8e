"""Multiple-instance learning with gated attention, in numpy: passages, encoder, training and scores.

A text is cut into passages of ``PASSAGE`` bytes, all of them. A passage's features are how often
each pair of neighbouring byte classes stands in it, how many of its words stand earlier in the text,
and its length. A learned layer encodes the passage, learned gated attention weighs the
passages of a text, and a logistic unit scores the weighted mean of their codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PASSAGE = 512
HIDDEN = 24
ATTENTION = 16
#: Classes of bytes that say most about form; letters beyond ASCII are one class for first and one for later bytes.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "#", "$%&*", "<>{}[]=/\\", "'\"()-_@+")
KINDS = len(CLASSES) + 2
PAIRS = KINDS * KINDS
INPUTS = PAIRS + 2


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("?"), np.int64)
    for kind, letters in enumerate(CLASSES):
        table[[ord(c) for c in letters]] = kind
    table[0x80:0xC0], table[0xC0:] = KINDS - 1, KINDS - 2
    return table


CLASS_TABLE = _class_table()


@dataclass
class Passages:
    """Feature rows of all passages and where each text's begin; every text has one passage at least."""

    features: np.ndarray
    offsets: np.ndarray


def repeated_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and whether the same three words in a row stand earlier in the same text."""
    blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = np.flatnonzero(~blank & (first[:-1] | np.append(True, blank[:-1])))
    if not len(begin):
        return begin, np.zeros(0, bool)
    end = np.append(begin[1:], len(data))
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    place = np.minimum(np.arange(len(data)) - np.repeat(np.append(0, begin), np.diff(np.append(0, np.append(begin, len(data))))), 63)
    summed = np.append(np.uint64(0), np.cumsum(np.where(blank, 0, data).astype(np.uint64) * powers[place]))
    word = summed[end] - summed[begin]
    owner = np.searchsorted(offsets, begin, "right").astype(np.uint64)
    three = word.copy()
    three[2:] = (word[2:] * np.uint64(31) + word[1:-1]) * np.uint64(31) + word[:-2]
    key = (three ^ owner * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(begin), bool)
    seen[order[1:]] = key[order[1:]] == key[order[:-1]]
    return begin, seen


def passages(data: np.ndarray, offsets: np.ndarray) -> Passages:
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    begins = np.append(0, np.cumsum(counts))
    total = int(begins[-1])
    text = np.repeat(np.arange(len(sizes)), sizes)
    number = begins[text] + (np.arange(len(data)) - offsets[text]) // PASSAGE
    kinds = CLASS_TABLE[data]
    inner = np.flatnonzero(text[1:] == text[:-1]) if len(data) else np.zeros(0, int)
    pair = kinds[inner] * KINDS + kinds[inner + 1]
    table = np.bincount(number[inner] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS)
    begin, seen = repeated_words(data, offsets)
    words = np.bincount(number[begin], minlength=total)
    repeated = np.bincount(number[begin[seen]], minlength=total) / np.maximum(words, 1)
    length = np.bincount(number, minlength=total) / PASSAGE
    shares = np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1))
    return Passages(np.concatenate([shares, repeated[:, None], length[:, None]], 1).astype(np.float32), begins)


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def run(self, bags: Passages) -> dict[str, np.ndarray]:
        w, x, at = self.weights, bags.features, bags.offsets[:-1]
        owner = np.repeat(np.arange(len(at)), np.diff(bags.offsets))
        code = np.tanh(x @ w["W"] + w["b"])
        content, gate = np.tanh(code @ w["V"]), 1 / (1 + np.exp(-(code @ w["U"])))
        raised = (content * gate) @ w["a"]
        raised = np.exp(raised - np.maximum.reduceat(raised, at)[owner])
        weight = raised / np.add.reduceat(raised, at)[owner]
        mean = np.add.reduceat(weight[:, None] * code, at)
        score = 1 / (1 + np.exp(-np.clip(mean @ w["c"] + w["d"], -30, 30)))
        return {"owner": owner, "code": code, "content": content, "gate": gate, "weight": weight, "mean": mean, "score": score}


def fit(bags: Passages, labels: np.ndarray, rounds: int = 300, rate: float = 0.02, shrink: float = 1e-5, seed: int = 0) -> Model:
    """Minimise the log loss of the texts' labels by Adam over all of them."""
    random = np.random.default_rng(seed)
    shape = {"W": (INPUTS, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,)}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s) if k != "b" else np.zeros(s) for k, s in shape.items()}
    share = np.clip(labels.mean(), 0.01, 0.99)
    weights["d"] = np.array(np.log(share / (1 - share)))
    model = Model(weights)
    mean, square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        r, w = model.run(bags), weights
        error = (r["score"] - labels) / len(labels)
        d_mean = error[:, None] * w["c"]
        by_place = d_mean[r["owner"]]
        d_weight = (by_place * r["code"]).sum(1)
        d_raised = r["weight"] * (d_weight - np.add.reduceat(r["weight"] * d_weight, bags.offsets[:-1])[r["owner"]])
        d_gated = d_raised[:, None] * w["a"]
        d_content = d_gated * r["gate"] * (1 - r["content"] ** 2)
        d_gate = d_gated * r["content"] * r["gate"] * (1 - r["gate"])
        d_code = (r["weight"][:, None] * by_place + d_content @ w["V"].T + d_gate @ w["U"].T) * (1 - r["code"] ** 2)
        slope = {
            "W": bags.features.T @ d_code, "b": d_code.sum(0), "V": r["code"].T @ d_content, "U": r["code"].T @ d_gate,
            "a": (r["content"] * r["gate"]).T @ d_raised, "c": r["mean"].T @ error, "d": error.sum(),
        }
        for k, gradient in slope.items():
            gradient = gradient + shrink * w[k] * (k not in "bd")
            mean[k] = 0.9 * mean[k] + 0.1 * gradient
            square[k] = 0.999 * square[k] + 0.001 * gradient**2
            w[k] = w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model
