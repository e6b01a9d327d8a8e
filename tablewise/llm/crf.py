"""A linear-chain conditional random field over words: features, forward-backward and training, in numpy.

A word's score for a label is the sum of learned weights of its affixes, its character n-grams
and, if the word is in the lexicon of frequent training words, of the word itself; learned
transitions join neighbouring words. Texts are cut into segments whose transfer matrices are
multiplied side by side, so that long texts take as few steps as short ones; the result
is that of the plain recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablewise.llm.common import binary_array
from tablewise.llm.pretokens import LETTER, byte_classes

TABLE = 1 << 16
GRAMS = (1, 2, 3, 4)
AFFIXES = (1, 2, 3, 4)
LEXICON_WORDS = 20_000
SEGMENT = 128


@dataclass
class Words:
    """Words of many texts: the distinct ones, each place's distinct word, and the places of each text."""

    distinct: pa.Array
    index: np.ndarray
    offsets: np.ndarray
    spans: np.ndarray


@dataclass
class Model:
    labels: list[str]
    lexicon: pa.Array
    weights: np.ndarray  # rows: hashed n-grams and affixes, then lexicon words
    transitions: np.ndarray  # logs, from row to column
    start: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters of lower-cased texts."""
    letter = np.zeros(len(data) + 2, np.int8)
    letter[1:-1] = byte_classes(data) == LETTER if len(data) else 0
    change = np.zeros(len(data) + 1, bool)
    change[offsets] = True
    begin = np.flatnonzero((letter[1:] == 1) & ((letter[:-1] == 0) | change))
    end = np.flatnonzero((letter[:-1] == 1) & ((letter[1:] == 0) | change))
    sizes = end - begin
    bounds = np.append(0, np.cumsum(sizes))
    packed = data[np.repeat(begin - bounds[:-1], sizes) + np.arange(bounds[-1])] if len(begin) else data[:0]
    coded = binary_array(packed, bounds).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(begin, offsets), np.stack([begin, end], 1) if len(begin) else np.zeros((0, 2), np.int64))


def features(words: pa.Array, lexicon: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, row of the weights) of every feature of the distinct words."""
    count = len(words)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = b"".join(b"\x02%b\x03" % w for w in words.to_pylist())
    data = np.frombuffer(marked, np.uint8).astype(np.uint64)
    starts = np.flatnonzero(data == 2)
    sizes = np.diff(np.append(starts, len(data)))
    owner = np.repeat(np.arange(count), sizes)
    owners, rows, code = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(*GRAMS, *AFFIXES) + 2):
        size = len(data) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint64(0x100000001B3) + data[n - 1 :]
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        row = (mixed >> np.uint64(48)).astype(np.int64)
        inside = owner[:size] == owner[n - 1 :]
        edge = (data[:size] == 2) | (data[n - 1 :] == 3)
        # An affix of n letters is a gram of n + 1 bytes that holds a word's edge.
        chosen = inside & (edge & (n - 1 in AFFIXES) | ~edge & (n in GRAMS))
        owners.append(owner[:size][chosen])
        rows.append(row[chosen])
    known = pc.index_in(words, lexicon)
    found = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
    owners.append(found)
    rows.append(TABLE + known.drop_null().to_numpy().astype(np.int64))
    return np.concatenate(owners), np.concatenate(rows)


def emissions(model: Model, words: pa.Array) -> np.ndarray:
    """Log scores of the labels of each distinct word."""
    owner, row = features(words, model.lexicon)
    return np.stack([np.bincount(owner, model.weights[:, k][row], len(words)) for k in range(len(model.labels))], 1).astype(np.float32)


@dataclass
class Chains:
    """Segments of texts: where each begins and how long it is, and the segments of each text."""

    begin: np.ndarray
    size: np.ndarray
    first: np.ndarray
    text: np.ndarray


def chains(offsets: np.ndarray, segment: int = SEGMENT) -> Chains:
    lengths = np.diff(offsets)
    parts = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(parts)[:-1]), parts)
    begin = offsets[:-1][text] + number * segment
    return Chains(begin, np.minimum(segment, lengths[text] - number * segment), number == 0, text)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray, parts: Chains, want_pairs: bool = False, segment: int = SEGMENT):
    """Marginals (step, segment, label) and, if wanted, summed ones of neighbouring labels.

    ``scores``: log scores of each place, in order.
    """
    count, labels, kind = len(parts.begin), scores.shape[1], scores.dtype
    steps = min(segment, int(parts.size.max())) if count else 0
    place = np.minimum(parts.begin[None, :] + np.arange(steps)[:, None], max(len(scores) - 1, 0))
    valid = np.arange(steps)[:, None] < parts.size[None, :]
    emitted = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60))[place]
    move, begin = np.exp(transitions - transitions.max()).astype(kind), np.exp(start - start.max()).astype(kind)
    # Transfer matrices of the segments of texts with several; a text's first step has no transition.
    many = np.flatnonzero(np.bincount(parts.text)[parts.text] > 1) if count else np.zeros(0, int)
    matrix = np.zeros((count, labels, labels), kind)
    if len(many):
        product = np.where(parts.first[many, None, None], np.eye(labels, dtype=kind), move) * emitted[0][many, None, :]
        for t in range(1, steps):
            following = (product.reshape(-1, labels) @ move).reshape(product.shape) * emitted[t][many, None, :]
            following /= following.max((1, 2), keepdims=True)
            product = np.where(valid[t][many, None, None], following, product)
        matrix[many] = product
    into, out = np.tile(begin / begin.sum(), (count, 1)), np.ones((count, labels), kind)
    number = np.arange(count) - np.maximum.accumulate(np.where(parts.first, np.arange(count), 0)) if count else np.zeros(0, int)
    for step in range(1, int(number.max()) + 1 if count else 0):
        at = np.flatnonzero(number == step)
        moved = np.einsum("si,sij->sj", into[at - 1], matrix[at - 1])
        into[at] = moved / moved.sum(1, keepdims=True)
    for step in range(int(number.max()) if count else 0, 0, -1):
        at = np.flatnonzero(number == step)
        moved = np.einsum("sij,sj->si", matrix[at], out[at])
        out[at - 1] = moved / moved.sum(1, keepdims=True)
    ahead = np.empty((steps, count, labels), kind)
    before = into
    for t in range(steps):
        carried = before @ move
        if t == 0:
            carried = np.where(parts.first[:, None], before, carried)
        before = carried * emitted[t]
        before /= before.sum(1, keepdims=True)
        ahead[t] = before
    marginals, pairs = ahead, np.zeros((labels, labels))
    behind = out
    for t in range(steps - 1, -1, -1):
        both = ahead[t] * behind
        weighted = emitted[t] * behind
        if want_pairs:
            source = marginals[t - 1] if t else into
            joint = source[:, :, None] * move * weighted[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint[valid[t] if t else valid[t] & ~parts.first].sum(0)
        marginals[t] = both / both.sum(1, keepdims=True)
        back = weighted @ move.T
        back /= back.sum(1, keepdims=True)
        behind = np.where(valid[t][:, None], back, behind)
    return marginals, pairs, place, valid


def label_shares(model: Model, words: Words) -> np.ndarray:
    """Mean marginal of each label in each text; zero without words."""
    parts, labels = chains(words.offsets), len(model.labels)
    if not len(parts.begin):
        return np.zeros((len(words.offsets) - 1, labels))
    scores = emissions(model, words.distinct)[words.index]
    marginals, _, _, valid = forward_backward(scores, model.transitions, model.start, parts)
    sums = (marginals * valid[:, :, None]).sum(0)
    totals = np.stack([np.bincount(parts.text, sums[:, k], len(words.offsets) - 1) for k in range(labels)], 1)
    return totals / np.maximum(np.diff(words.offsets), 1)[:, None]


def word_marginals(model: Model, words: Words) -> np.ndarray:
    """Marginal of each label at each place."""
    found = np.zeros((len(words.index), len(model.labels)))
    parts = chains(words.offsets)
    if len(parts.begin):
        scores = emissions(model, words.distinct)[words.index]
        marginals, _, place, valid = forward_backward(scores, model.transitions, model.start, parts)
        found[place[valid]] = marginals[valid]
    return found


def fit(words: Words, gold: np.ndarray, labels: list[str], rounds: int = 30, rate: float = 0.3, shrink: float = 1e-3) -> Model:
    """Maximise the conditional likelihood of each place's label (``gold``) by Adam over all texts."""
    counts = np.bincount(words.index, minlength=len(words.distinct))
    frequent = np.argsort(-counts, kind="stable")[:LEXICON_WORDS]
    lexicon = words.distinct.take(pa.array(frequent[counts[frequent] > 2]))
    owner, row = features(words.distinct, lexicon)
    size, parts, places = len(labels), chains(words.offsets), max(1, len(words.index))
    observed = np.zeros((len(words.distinct), size))
    np.add.at(observed, (words.index, gold), 1)
    first = words.offsets[:-1][np.diff(words.offsets) > 0]
    inner = np.setdiff1d(np.arange(1, len(gold)), first)
    seen_pairs, seen_first = np.zeros((size, size)), np.bincount(gold[first], minlength=size)
    np.add.at(seen_pairs, (gold[inner - 1], gold[inner]), 1)
    values = [np.zeros((TABLE + len(lexicon), size)), np.zeros((size, size)), np.zeros(size)]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        model = Model(labels, lexicon, *values)
        by_word = np.stack([np.bincount(owner, values[0][row, k], len(words.distinct)) for k in range(size)], 1)
        marginals, pairs, place, valid = forward_backward(by_word[words.index], values[1], values[2], parts, True)
        expected = np.stack([np.bincount(words.index[place[valid]], marginals[valid][:, k], len(words.distinct)) for k in range(size)], 1)
        missing = (observed - expected) / places
        slope = [
            np.stack([np.bincount(row, missing[owner, k], len(values[0])) for k in range(size)], 1) - shrink / TABLE * values[0],
            (seen_pairs - pairs) / places - shrink * values[1] / size,
            (seen_first - marginals[0][parts.first].sum(0)) / places - shrink * values[2] / size,
        ]
        for i, gradient in enumerate(slope):
            mean[i] = 0.9 * mean[i] + 0.1 * gradient
            square[i] = 0.99 * square[i] + 0.01 * gradient**2
            values[i] = values[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, lexicon, values[0].astype(np.float32), values[1], values[2])
