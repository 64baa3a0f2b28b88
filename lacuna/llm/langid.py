"""Language of a text by a bidirectional gated recurrent network over bytes.

UTF-8 bytes are cut into windows of ``WINDOW`` bytes, all of them, whatever the
length of the text; the states start anew at each window. One network reads a
window forwards, one backwards, byte by byte; from both states each position gets
a probability per language, and a document's probabilities are the means over its
positions. The network is
trained on the driver in numpy by backpropagation through time, from a bounded
sample of labelled rows, and travels to the tasks as one small broadcast.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import text_bytes
from .text import bounded_sample, unused

WINDOW = 64
HIDDEN = 8
#: Labelled rows that the fit may use, and pieces taken from each, spread over its whole text.
SAMPLE_ROWS = 3000
PIECES = 6
#: Steps of gradient descent, however many pieces there are, and pieces per step.
UPDATES = 420
BATCH = 256
SEED = 11
#: Windows handled at once in a task.
BLOCK = 4096

UNKNOWN = "und"
#: Where between chance (one language in so many) and certainty the score of a text in a learned language must lie at least.
LEAST_CERTAINTY = 0.2


@dataclass
class Network:
    languages: list[str]
    #: Per direction: input weights (256, 3H), recurrent weights (H, 3H), biases (3H).
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    #: Labels from both states: (2H, languages) and (languages).
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.bias, self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(net: Network, codes: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, H) of one direction over codes (rows, WINDOW); ``keep`` gets what the way back needs."""
    rows, hidden = len(codes), net.recurrent[way].shape[0]
    steps = codes.shape[1]
    state = np.zeros((rows, hidden), np.float32)
    states = np.empty((steps, rows, hidden), np.float32)
    gate_weights = np.ascontiguousarray(net.recurrent[way][:, : 2 * hidden])
    new_weights = np.ascontiguousarray(net.recurrent[way][:, 2 * hidden:])
    by_byte = net.inputs[way] + net.bias[way]
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        read = by_byte.take(codes[:, t], axis=0)
        gates = _sigmoid(read[:, : 2 * hidden] + state @ gate_weights)
        update, reset = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(read[:, 2 * hidden:] + (reset * state) @ new_weights)
        if keep is not None:
            keep.append((t, state, update, reset, new))
        state = new + update * (state - new)
        states[t] = state
    return states


def _label(net: Network, both: np.ndarray) -> np.ndarray:
    scores = both @ net.out + net.out_bias
    scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-1, keepdims=True)
    return scores


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(positions, rows, languages) label probabilities."""
    return _label(net, np.concatenate([_states(net, codes, 0), _states(net, codes, 1)], axis=-1))


def _gradients(net: Network, codes: np.ndarray, labels: np.ndarray, present: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over present positions."""
    hidden = net.recurrent[0].shape[0]
    kept: list[list] = [[], []]
    both = np.concatenate([_states(net, codes, way, kept[way]) for way in (0, 1)], axis=-1)
    wrong = _label(net, both)
    wrong[:, np.arange(len(labels)), labels] -= 1
    wrong *= (present / max(1, present.sum()))[:, :, None]
    flat = wrong.reshape(-1, wrong.shape[-1])
    d_out, d_out_bias = both.reshape(-1, 2 * hidden).T @ flat, flat.sum(axis=0)
    d_both = wrong @ net.out.T
    d_inputs, d_recurrent, d_bias = [], [], []
    for way in (0, 1):
        weights = net.recurrent[way]
        d_in, d_rec, d_b = np.zeros_like(net.inputs[way]), np.zeros_like(weights), np.zeros_like(net.bias[way])
        d_state = np.zeros((len(codes), hidden), np.float32)
        for t, before, update, reset, new in reversed(kept[way]):
            d_state = d_state + d_both[t, :, way * hidden:(way + 1) * hidden]
            d_new = d_state * (1 - update) * (1 - new * new)
            d_reset = (d_new @ weights[:, 2 * hidden:].T) * before * reset * (1 - reset)
            d_update = d_state * (before - new) * update * (1 - update)
            d_read = np.concatenate([d_update, d_reset, d_new], axis=1)
            d_rec[:, : 2 * hidden] += before.T @ d_read[:, : 2 * hidden]
            d_rec[:, 2 * hidden:] += (reset * before).T @ d_new
            d_b += d_read.sum(axis=0)
            read = np.zeros((len(codes), 256), np.float32)
            read[np.arange(len(codes)), codes[:, t]] = 1
            d_in += read.T @ d_read
            d_state = (
                d_state * update + d_read[:, : 2 * hidden] @ weights[:, : 2 * hidden].T
                + reset * (d_new @ weights[:, 2 * hidden:].T)
            )
        d_inputs.append(d_in)
        d_recurrent.append(d_rec)
        d_bias.append(d_b)
    return [*d_inputs, *d_recurrent, *d_bias, d_out, d_out_bias]


def train(pieces: list[bytes], labels: list[str], hidden: int = HIDDEN, updates: int = UPDATES, seed: int = SEED) -> Network | None:
    """A network fitted to windows of bytes; None without any. Equal input gives an equal network."""
    languages = sorted(set(labels))
    if not languages:
        return None
    chance = np.random.default_rng(seed)

    def drawn(*shape, size):
        return (chance.standard_normal(shape) * size).astype(np.float32)

    net = Network(
        languages, [drawn(256, 3 * hidden, size=0.3) for _ in "fb"],
        [drawn(hidden, 3 * hidden, size=hidden**-0.5) for _ in "fb"], [np.zeros(3 * hidden, np.float32) for _ in "fb"],
        drawn(2 * hidden, len(languages), size=0.3), np.zeros(len(languages), np.float32),
    )
    codes, present = np.zeros((len(pieces), WINDOW), np.uint8), np.zeros((len(pieces), WINDOW), bool)
    for i, piece in enumerate(pieces):
        part = np.frombuffer(piece[:WINDOW], np.uint8)
        codes[i, : len(part)], present[i, : len(part)] = part, True
    marks = np.searchsorted(languages, labels)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    done = 0
    while done < updates:
        order = chance.permutation(len(pieces))
        for at in range(0, len(order), BATCH)[: updates - done]:
            rows = order[at:at + BATCH]
            seen = present[rows].T.astype(np.float32)
            done += 1
            rate = 0.02 * (1 - 0.9 * done / updates)
            for p, g, a, b in zip(net.parameters(), _gradients(net, codes[rows], marks[rows], seen), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**done)) / (np.sqrt(b / (1 - 0.99**done)) + 1e-8)
    return net


def _pooled(net: Network, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean label probabilities of each text; text i is data[starts[i]:starts[i] + lengths[i]]."""
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + nth * WINDOW
    size = np.minimum(WINDOW, lengths[owner] - nth * WINDOW)
    sums = np.zeros((len(lengths), len(net.languages)))
    places = np.arange(WINDOW)
    for at in range(0, len(owner), BLOCK):
        block = slice(at, at + BLOCK)
        there = places < size[block, None]
        codes = np.where(there, data.take(begin[block, None] + places, mode="clip"), 0)
        found = np.einsum("tr,trl->rl", there.T.astype(np.float32), probabilities(net, codes))
        for language in range(len(net.languages)):
            sums[:, language] += np.bincount(owner[block], found[:, language], len(lengths))
    return sums / np.maximum(lengths, 1)[:, None]


def _predictor(net: Network | None, keep: list[str], names: tuple[str, str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 2))
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            lengths = np.where(lettered, np.diff(offsets), 0)
            if net is None or not len(lengths):
                best, score = np.full(len(lengths), UNKNOWN, object), np.zeros(len(lengths))
            else:
                pooled = _pooled(net, data, offsets[:-1], lengths)
                best = np.where(lettered, np.array(net.languages, object)[pooled.argmax(axis=1)], UNKNOWN)
                score = np.where(lettered, pooled.max(axis=1).clip(0, 1), 0.0)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(score)], [*keep, *names])

    return predict


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_pieces(docs: DataFrame, rows: int = SAMPLE_ROWS, pieces: int = PIECES) -> list:
    """(piece, lang) of at most ``rows`` labelled rows in a fixed random order.

    Rows without id, held-out rows and rows without lang are left out. The
    pieces lie evenly over the whole text, so at most rows * pieces * WINDOW
    characters come to the driver.
    """
    text = F.col("text").cast("string")
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", text.alias("text"))
    # Drawn by id and language, which are narrow; a null text has no pieces.
    ranked = bounded_sample(usable, rows, SEED, "doc_id", "lang").where(F.col("text").rlike(r"\p{L}"))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: F.substr("text", (F.length("text") * i / pieces).cast("int") + 1, F.lit(WINDOW)),
    )
    found = ranked.select("lang", F.explode(F.array_distinct(spread)).alias("piece")).where("piece <> ''")
    return [(r["piece"], r["lang"]) for r in found.collect()]


def fit(docs: DataFrame, **options) -> Network | None:
    """A network for the languages of a bounded sample of ``docs`` (doc_id, text, lang)."""
    found = sorted(training_pieces(docs, **options))
    return train([piece.encode() for piece, _ in found], [lang for _, lang in found])


def identify(docs: DataFrame, net: Network | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` (text, ...) as they are, and the two ``names``, one row per row.

    A text that is null or has no letter is ``und`` with score 0; so is any text
    if there was no labelled row to learn from.
    """
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    own = unused(docs, "_read", "_lettered")
    read = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias(own[0]), lettered.alias(own[1]))
    schema = T.StructType([docs.schema[c] for c in keep]).add(names[0], "string").add(names[1], "double")
    return read.mapInArrow(_predictor(net, keep, names), schema)


def least_score(net: Network | None, certainty: float = LEAST_CERTAINTY) -> float:
    """The score that a text in a learned language reaches: chance, and a share of what is left to certainty."""
    chance = 1 / len(net.languages) if net else 1.0
    # One language alone is always certain.
    return chance + certainty * (1 - chance) if chance < 1 else 0.0


def keep_identified(docs: DataFrame, certainty: float = LEAST_CERTAINTY, **options) -> DataFrame:
    """The rows of ``docs`` in a language that is known well enough, with all their columns."""
    names = unused(docs, "_lang_pred", "_lang_score")
    net = fit(docs, **options)
    found = identify(docs, net, docs.columns, tuple(names))
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score(net, certainty))).select(*[F.col(f"`{c}`") for c in docs.columns])


def language_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; null ids are not held out."""
    found = identify(docs, fit(docs, **options), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
