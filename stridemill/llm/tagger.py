"""Character-level bidirectional LSTM with a CRF on top, in NumPy: training, decoding, marginals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner character of each kind
SYMBOLS = 1 + 5 + 33       # padding, five classes, ASCII punctuation and the rest
EMBEDDING, HIDDEN = 8, 16
_FORBIDDEN = -1e4

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000 // 0x400, 5, np.int8)  # any other character, by its high bits
    low = np.full(0x400, 4, np.int8)                # letters beyond ASCII and the like
    for i in range(128):
        c = chr(i)
        low[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5
        if c in _PUNCTUATION:
            low[i] = 6 + _PUNCTUATION.index(c)
    return np.concatenate([low, np.repeat(table[1:2], 1)])


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Class of every character: cases and digits by kind, ASCII punctuation by itself."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(points, 0x400)]


def allowed() -> np.ndarray:
    """Zero where a tag may follow another: an inner tag only follows its own kind."""
    rule = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inner = 2 + 2 * k
        rule[:, inner] = _FORBIDDEN
        rule[[inner - 1, inner], inner] = 0
    return rule


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """Both directions of the LSTM share arrays: their first axis is the direction."""

    embedding: np.ndarray    # symbols x E
    inputs: np.ndarray       # 2 x E x 4H
    bias: np.ndarray         # 2 x 4H
    recurrent: np.ndarray    # 2 x H x 4H
    out: np.ndarray          # 2H x tags
    out_bias: np.ndarray
    transitions: np.ndarray  # tags x tags

    FIELDS = ("embedding", "inputs", "bias", "recurrent", "out", "out_bias", "transitions")

    @classmethod
    def new(cls, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        bias = np.zeros((2, 4 * HIDDEN))
        bias[:, HIDDEN : 2 * HIDDEN] = 1.0
        arrays = (
            rng.normal(0, 0.5, (SYMBOLS, EMBEDDING)), draw(2, EMBEDDING, 4 * HIDDEN), bias, draw(2, HIDDEN, 4 * HIDDEN),
            draw(2 * HIDDEN, TAGS), np.zeros(TAGS), rng.normal(0, 0.1, (TAGS, TAGS)),
        )
        return cls(*[a.astype(np.float32) for a in arrays])

    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        size, steps = x.shape
        table = self.embedding @ self.inputs + self.bias[:, None]
        ways = np.stack([x, x[:, ::-1]])
        h, c = np.zeros((2, size, HIDDEN), table.dtype), np.zeros((2, size, HIDDEN), table.dtype)
        states = np.empty((steps, 2, size, HIDDEN), table.dtype)
        tape = []
        for t in range(steps):
            a = h @ self.recurrent
            a[0] += table[0][ways[0, :, t]]
            a[1] += table[1][ways[1, :, t]]
            gates = _sigmoid(a[..., : 3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            g = np.tanh(a[..., 3 * HIDDEN :])
            before, past = c, h
            c = f * c + i * g
            top = np.tanh(c)
            h = o * top
            states[t] = h
            if keep:
                tape.append((i, f, o, g, before, past, top))
        both = np.concatenate([states[:, 0], states[::-1, 1]], -1).transpose(1, 0, 2)
        return both, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores of a batch of windows of symbols: windows x characters x tags."""
        return self._run(x, False)[0] @ self.out + self.out_bias

    def decode(self, emissions: np.ndarray) -> np.ndarray:
        """Best tag path of each window (Viterbi)."""
        rule = self.transitions + allowed()
        size, steps, _ = emissions.shape
        score = emissions[:, 0] + allowed()[0]
        back = np.empty((steps, size, TAGS), np.int8)
        for t in range(1, steps):
            paths = score[:, :, None] + rule
            back[t] = paths.argmax(1)
            score = paths.max(1) + emissions[:, t]
        best = np.empty((size, steps), np.int8)
        best[:, -1] = score.argmax(1)
        rows = np.arange(size)
        for t in range(steps - 1, 0, -1):
            best[:, t - 1] = back[t, rows, best[:, t]]
        return best

    def marginals(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, tag probabilities per character, expected transitions."""
        rule = self.transitions + allowed()
        size, steps, _ = emissions.shape
        forward, backward = np.empty_like(emissions), np.zeros_like(emissions)
        forward[:, 0] = emissions[:, 0] + allowed()[0]
        for t in range(1, steps):
            forward[:, t] = _log_sum(forward[:, t - 1, :, None] + rule, 1) + emissions[:, t]
        for t in range(steps - 2, -1, -1):
            backward[:, t] = _log_sum(rule + (emissions[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = _log_sum(forward[:, -1], 1)
        tags = np.exp(forward + backward - total[:, None, None])
        ahead = emissions[:, 1:] + backward[:, 1:] - total[:, None, None]
        pairs = np.exp(forward[:, :-1, :, None] + rule + ahead[:, :, None, :])
        return total, tags, pairs.sum((0, 1))

    def gradients(self, x: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold paths and its gradients."""
        size, steps = x.shape
        both, tape = self._run(x, True)
        emissions = both @ self.out + self.out_bias
        total, tags, moves = self.marginals(emissions)
        rows, at = np.arange(size)[:, None], np.arange(steps)
        path = emissions[rows, at, gold].sum(1) + self.transitions[gold[:, :-1], gold[:, 1:]].sum(1)
        d_em = tags.copy()
        d_em[rows, at, gold] -= 1
        d_em /= size
        np.add.at(moves, (gold[:, :-1], gold[:, 1:]), -1)
        grads = {
            "transitions": moves / size, "out": np.einsum("bth,btk->hk", both, d_em, optimize=True), "out_bias": d_em.sum((0, 1)),
            "recurrent": np.zeros_like(self.recurrent),
        }
        d_both = d_em @ self.out.T
        d_states = np.stack([d_both[..., :HIDDEN], d_both[:, ::-1, HIDDEN:]])
        d_gates = np.empty((steps, 2, size, 4 * HIDDEN), both.dtype)
        dh, dc = np.zeros_like(tape[0][4]), np.zeros_like(tape[0][4])
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, past, top = tape[t]
            dh = dh + d_states[:, :, t]
            dc = dc + dh * o * (1 - top * top)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)], -1)
            grads["recurrent"] += past.transpose(0, 2, 1) @ da
            d_gates[t] = da
            dh = da @ self.recurrent.transpose(0, 2, 1)
            dc = dc * f
        seen = np.eye(SYMBOLS, dtype=both.dtype)[np.stack([x.T, x[:, ::-1].T])]  # 2 x steps x windows x symbols
        d_table = np.einsum("dnv,dnk->dvk", seen.reshape(2, -1, SYMBOLS), d_gates.transpose(1, 0, 2, 3).reshape(2, steps * size, -1), optimize=True)
        grads["inputs"] = self.embedding.T @ d_table
        grads["bias"] = d_table.sum(1)
        grads["embedding"] = np.einsum("dvg,deg->ve", d_table, self.inputs)
        return float((total - path).mean()), grads

    def fit(self, x: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.03, seed: int = 1) -> list[float]:
        """Adam over shuffled batches; the mean loss of every epoch."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(getattr(self, n)) for n in self.FIELDS}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.FIELDS}
        losses, step = [], 0
        for epoch in range(epochs):
            order, sums = rng.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                loss, grads = self.gradients(x[rows], gold[rows])
                sums += loss * len(rows)
                step += 1
                pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for n in self.FIELDS:
                    g = np.clip(grads[n], -1, 1)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    setattr(self, n, getattr(self, n) - pace * first[n] / (np.sqrt(second[n]) + 1e-8))
            losses.append(sums / len(x))
        return losses
