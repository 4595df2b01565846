"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a whole text's bytes forwards and backwards, labels every position with a distribution over
languages, and the document's distribution is the mean over all positions.  It is trained in numpy by
backpropagation through time, on the driver, from the whole texts of a bounded sample of at most ``SAMPLE`` documents.

Texts are laid out as windows that are stepped through side by side, with one matrix product a step.  A window begins
with the state that the one read before it ends with: all windows are first read from nothing, then those whose beginning has changed
are read again until their states agree with the earlier reading to within ``AGREED``, round after round until nothing changes.  That
gives the states of one reading from end to end.  In training, gradients stop at the borders of windows, states don't.

Defined cases: texts that are null, empty or without letters are ``und`` with score 0; documents without a language are not learned from
but are predicted; without any to learn from all are ``und``; repeated rows each get their row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow, first_by_hash, slices, text_bytes
from quillon.llm.quality import held_out

#: Documents that are learned from, at most; all of their text is.
SAMPLE = 600
#: Bytes of a window in scoring, and in training, where gradients go no further back.
WINDOW = 256
STRETCH = 64
HIDDEN = 8
#: The most of a state that an update gate carries on to the next position, so that what two readings began with is forgotten geometrically.
CARRY = 0.75
#: The most that the absolute weights of a candidate on the earlier states add up to, so that no state holds itself up for ever.
ECHO = 0.6
#: Difference below which two readings of a position are the same.
AGREED = 1e-4
#: Windows that are held at once.
BLOCK = 2048
LETTER = regex.compile(r"\p{L}")
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(table: np.ndarray, gates: np.ndarray, cand: np.ndarray, x: np.ndarray, mask: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after one position.  ``table`` holds what each byte adds to reset, update and candidate, a row each; features come first in all arrays."""
    size = cand.shape[0]
    g = table[:, x]
    a = gates @ h
    a += g[: 2 * size]
    _sigmoid(a)
    a[size:] *= CARRY
    r, z = a[:size], a[size:]
    rh = r * h
    c = cand @ rh
    c += g[2 * size :]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    new *= mask
    if keep is not None:
        keep.append((h, r, z, rh, c))
    return new


def _gru(table: np.ndarray, gates: np.ndarray, cand: np.ndarray, x: np.ndarray, mask: np.ndarray, order: range, h: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """States after each position, from the states ``h``, nothing by default."""
    length, n = x.shape
    states = np.empty((length, cand.shape[0], n), np.float32)
    h = np.zeros((cand.shape[0], n), np.float32) if h is None else h
    for t in order:
        h = states[t] = _step(table, gates, cand, x[t], mask[t], h, keep)
    return states


def _reading(w: dict[str, np.ndarray], d: str, x: np.ndarray, mask: np.ndarray, before: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at all positions of windows, and those they begin with; ``before`` is the window read before each, or -1 for those that begin with ``edge``."""
    part = w[f"table_{d}"], w[f"gates_{d}"], w[f"cand_{d}"]
    order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    begin = np.where(before < 0, edge, np.float32(0))
    states = _gru(*part, x, mask, order, begin)
    last = states[order[-1]]
    after = np.full(len(before), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    todo = np.flatnonzero(before >= 0)
    while len(todo):
        now = last[:, before[todo]]
        moved = np.abs(now - begin[:, todo]).max(axis=0) > AGREED
        todo, h = todo[moved], now[:, moved]
        begin[:, todo] = h
        for k, t in enumerate(order):
            if not len(todo):
                break
            h = _step(*part, x[t, todo], mask[t, todo], h)
            if k % 8 == 7:
                apart = np.abs(h - states[t][:, todo]).max(axis=0) > AGREED
                states[t][:, todo] = h
                todo, h = todo[apart], h[:, apart]
            else:
                states[t][:, todo] = h
        todo = after[todo]
        todo = todo[todo >= 0]
    return states, begin


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=-2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-2, keepdims=True)
    return z


class Windows:
    """Where the windows of all texts lie; those of one text are neighbours."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        count = -(-np.diff(offsets) // width)
        self.data, self.width = data, width
        self.row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.start = offsets[self.row] + nth * width
        self.size = np.minimum(width, offsets[self.row + 1] - self.start)
        self.continues = nth > 0

    def bytes_of(self, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and mask, positions first."""
        spot = np.arange(self.width)[:, None]
        mask = spot < self.size[at]
        return self.data[np.where(mask, self.start[at] + spot, 0)], mask.astype(np.float32)

    def read(self, w: dict[str, np.ndarray], block: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, tuple, tuple]]:
        """``(windows, bytes, mask, (states, beginnings) forwards, (states, beginnings) backwards)``, block by block.

        Where a text goes on in the next block, what the network has read backwards up to there is found first; only its
        state at each border is kept.
        """
        n, size = len(self.row), w["cand_f"].shape[0]
        blocks = [slice(at, min(at + block, n)) for at in range(0, n, block)]
        border = [np.zeros(size, np.float32)] * (len(blocks) + 1)
        for k in range(len(blocks) - 1, 0, -1):
            if self.continues[blocks[k].start]:
                own = np.arange(blocks[k].start, blocks[k].stop)
                own = own[self.row[own] == self.row[own[0]]]
                x, mask = self.bytes_of(own)
                before = np.r_[np.arange(1, len(own)), -1]
                goes_on = own[-1] + 1 < n and self.continues[own[-1] + 1]
                border[k] = _reading(w, "b", x, mask, before, self._edge(len(own), -1, border[k + 1] if goes_on else None, size))[0][0][:, 0]
        ahead = None
        for k, at in enumerate(blocks):
            x, mask = self.bytes_of(at)
            number = np.arange(at.stop - at.start)
            goes_on = np.r_[self.continues[at.start + 1 : at.stop], at.stop < n and self.continues[at.stop]]
            inner = goes_on.copy()
            inner[-1] = False
            forwards = _reading(w, "f", x, mask, np.where(np.r_[False, self.continues[at.start + 1 : at.stop]], number - 1, -1), self._edge(len(number), 0, ahead if self.continues[at.start] else None, size))
            backwards = _reading(w, "b", x, mask, np.where(inner, number + 1, -1), self._edge(len(number), -1, border[k + 1] if goes_on[-1] else None, size))
            ahead = forwards[0][-1][:, -1]
            yield at, x, mask, forwards, backwards

    @staticmethod
    def _edge(n: int, at: int, state: np.ndarray | None, size: int) -> np.ndarray:
        edge = np.zeros((size, n), np.float32)
        if state is not None:
            edge[:, at] = state
        return edge


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, np.ndarray]

    def pooled(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The mean distribution over all positions of each text, 0 for empty ones."""
        w, laid = self.weights, Windows(data, offsets, WINDOW)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for at, x, mask, (ahead, _), (back, _) in laid.read(w, block):
            total = np.zeros((len(self.langs), x.shape[1]), np.float32)
            for t in range(WINDOW):
                z = w["out_f"] @ ahead[t]
                z += w["out_b"] @ back[t]
                z += w["bias"]
                z = _softmax(z)
                z *= mask[t]
                total += z
            for c in range(len(self.langs)):
                out[:, c] += np.bincount(laid.row[at], total[c], len(out))
        return out / np.maximum(np.diff(offsets), 1)[:, None]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = text_bytes(column)
        p = self.pooled(data, offsets)
        seen = np.r_[0, np.cumsum(_ASCII[data])]
        letters = seen[offsets[1:]] > seen[offsets[:-1]]
        for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[k] = LETTER.search(column[int(k)].as_py()) is not None
        best = p.argmax(axis=1)
        known = letters & (p.max(axis=1) > 0)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def train(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, epochs: int = 3, batch: int = 384, rate: float = 0.015, seed: int = 5) -> Model:
    """Backpropagation through time over the windows of whole texts, which begin with the states of the epoch's start; Adam steps."""
    names = sorted(set(langs))
    if not names:
        return Model(["und"], {k: np.zeros(s, np.float32) for k, s in (("table_f", (3, 256)), ("table_b", (3, 256)), ("gates_f", (2, 1)), ("gates_b", (2, 1)), ("cand_f", (1, 1)), ("cand_b", (1, 1)), ("out_f", (1, 1)), ("out_b", (1, 1)), ("bias", (1, 1)))})
    rng = np.random.default_rng(seed)
    size = np.array([len(t) for t in texts], np.int64)
    laid = Windows(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(size)], STRETCH)
    n = len(laid.row)
    y = np.array([names.index(g) for g in langs])[laid.row]

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[1] if shape[1] != 256 else 4)).astype(np.float32)

    w = {}
    for d in "fb":
        w |= {f"table_{d}": start(3 * hidden, 256), f"gates_{d}": start(2 * hidden, hidden), f"cand_{d}": start(hidden, hidden), f"out_{d}": start(len(names), hidden)}
    w["bias"] = np.zeros((len(names), 1), np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    total = epochs * -(-n // batch)
    for epoch in range(epochs):
        begin = [np.zeros((hidden, n), np.float32) for _ in "fb"]
        if epoch:
            for at, _, _, (_, ahead), (_, back) in laid.read(w, 4 * BLOCK):
                begin[0][:, at], begin[1][:, at] = ahead, back
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            grads = _gradients(w, *laid.bytes_of(own), y[own], begin[0][:, own], begin[1][:, own])
            step += 1
            lr = rate * min(1, step / 20) * (1 - step / (total + 1))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                w[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
            for d in "fb":
                w[f"cand_{d}"] *= np.minimum(1, ECHO / np.abs(w[f"cand_{d}"]).sum(axis=1, keepdims=True))
    return Model(names, w)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray, ahead: np.ndarray | None = None, back: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over all positions of windows that begin with the states ``ahead`` and ``back``."""
    length = len(x)
    tape: dict[str, list] = {"f": [], "b": []}
    states = {"f": _gru(w["table_f"], w["gates_f"], w["cand_f"], x, mask, range(length), ahead, tape["f"]), "b": _gru(w["table_b"], w["gates_b"], w["cand_b"], x, mask, range(length - 1, -1, -1), back, tape["b"])}
    p = _softmax(w["out_f"] @ states["f"] + w["out_b"] @ states["b"] + w["bias"])
    p[:, y, np.arange(len(y))] -= 1
    p *= (mask / mask.sum())[:, None, :]
    grads = {"bias": p.sum(axis=(0, 2))[:, None]}
    for d in "fb":
        gates, cand = w[f"gates_{d}"], w[f"cand_{d}"]
        size = len(cand)
        grads[f"out_{d}"] = np.einsum("tcn,thn->ch", p, states[d])
        outer = np.einsum("ch,tcn->thn", w[f"out_{d}"], p)
        dg, dc = np.zeros_like(gates), np.zeros_like(cand)
        into = np.empty((length, 3 * size, x.shape[1]), np.float32)
        later = np.zeros((size, x.shape[1]), np.float32)
        order = range(length) if d == "f" else range(length - 1, -1, -1)
        for t, (h, r, z, rh, c) in zip(reversed(order), reversed(tape[d])):
            dh = (outer[t] + later) * mask[t]
            da = dh * (1 - z) * (1 - c * c)
            drh = cand.T @ da
            dc += da @ rh.T
            dz = dh * (h - c) * z * (1 - z / CARRY)
            dr = drh * h * r * (1 - r)
            both = np.concatenate([dr, dz])
            dg += both @ h.T
            later = dh * z + drh * r + gates.T @ both
            into[t, : 2 * size], into[t, 2 * size :] = both, da
        flat = x.ravel()
        grads[f"gates_{d}"], grads[f"cand_{d}"] = dg, dc
        grads[f"table_{d}"] = np.stack([np.bincount(flat, into[:, k].ravel(), 256) for k in range(3 * size)]).astype(np.float32)
    return grads


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the whole texts of the ``sample`` documents, not held out, that come first by a hash of their id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.xxhash64("doc_id").alias("place"), "lang", F.coalesce("text", F.lit("")).alias("whole"))
    got = [r for r in first_by_hash(rows, "place", sample, "lang", "whole").collect() if r.whole]
    return train([r.whole.encode() for r in got], [r.lang for r in got])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                lang, score = sent.value.predict(batch.column("text"))
                yield arrow(schema, doc_id=batch.column("doc_id"), lang_pred=lang, score=score)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language(docs: DataFrame) -> DataFrame:
    rows = predicted(docs, fit(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
