"""Linear-chain conditional random fields in numpy: forward-backward, Viterbi and training steps."""

from __future__ import annotations

import numpy as np

CHUNK = 64


class Chain:
    """Forward and backward messages over texts laid end to end, in chunks that are stepped through together.

    emission: (n, L), positive factors. transition: (L, L), positive factors. begins: where a text begins; there the
    label is free again, each as likely as another. A text too long for one chain is laid over several: `product` is
    what a chain does to a message, and `posterior` takes the messages that arrive at either end.
    """

    def __init__(self, emission: np.ndarray, transition: np.ndarray, begins: np.ndarray):
        n, size = emission.shape
        self.n, self.size, self.chunks, self.transition = n, size, -(-n // CHUNK), transition
        e = np.ones((self.chunks * CHUNK, size))
        e[:n] = emission
        # Places beyond the end are free, so that they add nothing to the messages that come back from there.
        fresh = np.ones(self.chunks * CHUNK, bool)
        fresh[:n] = begins
        self.e, self.fresh = e.reshape(self.chunks, CHUNK, size), fresh.reshape(self.chunks, CHUNK)
        self.uniform = np.full(size, 1 / size)
        product = np.broadcast_to(np.eye(size), (self.chunks, size, size)).copy()
        for t in range(CHUNK):
            product = self._step(product, t)
        self.products = product

    def _step(self, a: np.ndarray, t: int) -> np.ndarray:
        """(…, L) messages through position t, of all chunks."""
        flags = self.fresh[:, t].reshape((self.chunks,) + (1,) * (a.ndim - 1))
        moved = np.where(flags, a.sum(axis=-1, keepdims=True) * self.uniform, a @ self.transition)
        moved = moved * self.e[:, t].reshape((self.chunks,) + (1,) * (a.ndim - 2) + (self.size,))
        return moved / moved.sum(axis=-1, keepdims=True).max(axis=tuple(range(1, a.ndim)), keepdims=True)

    def product(self) -> np.ndarray:
        out = np.eye(self.size)
        for p in self.products:
            out = out @ p
            out /= out.sum()
        return out

    def posterior(self, into: np.ndarray | None = None, out_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Posterior probabilities (n, L) of labels, and the forward messages (n, L)."""
        starts, ends = np.empty((self.chunks, self.size)), np.empty((self.chunks, self.size))
        a = self.uniform if into is None else into
        for k in range(self.chunks):
            starts[k] = a
            a = a @ self.products[k]
            a = a / a.sum()
        b = np.ones(self.size) if out_of is None else out_of
        for k in range(self.chunks - 1, -1, -1):
            ends[k] = b
            b = self.products[k] @ b
            b = b / b.sum()
        alpha = np.empty((self.chunks, CHUNK, self.size))
        a = starts
        for t in range(CHUNK):
            a = self._step(a, t)
            alpha[:, t] = a
        post = np.empty_like(alpha)
        beta = ends
        for t in range(CHUNK - 1, -1, -1):
            post[:, t] = alpha[:, t] * beta
            back = beta * self.e[:, t]
            moved = np.where(self.fresh[:, t, None], (back * self.uniform).sum(axis=1, keepdims=True), back @ self.transition.T)
            beta = moved / moved.sum(axis=1, keepdims=True)
        post = post.reshape(-1, self.size)[: self.n]
        return post / post.sum(axis=1, keepdims=True), alpha.reshape(-1, self.size)[: self.n]


def forward_backward(emission: np.ndarray, transition: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Posterior probabilities (n, L) of labels, for texts laid end to end (see Chain)."""
    return Chain(emission, transition, begins).posterior()[0]


def carried(parts: int, emission_of, transition: np.ndarray):
    """Posteriors of one text's parts in turn, with the messages carried from part to part in both directions.

    emission_of(k): emissions of part k; all parts but the last have a multiple of CHUNK places. Each part's are made
    twice, so only one part is held at a time.
    """

    def chain(k: int) -> Chain:
        e = emission_of(k)
        return Chain(e, transition, np.arange(len(e)) == (0 if k == 0 else -1))

    products = [chain(k).product() for k in range(parts)]
    size = len(transition)
    into, out_of = [np.full(size, 1 / size)], [np.ones(size)]
    for p in products[:-1]:
        a = into[-1] @ p
        into.append(a / a.sum())
    for p in products[:0:-1]:
        b = p @ out_of[-1]
        out_of.append(b / b.sum())
    for k in range(parts):
        yield chain(k).posterior(into[k], out_of[parts - 1 - k])[0]


class Field:
    """Weights of hashed features and of transitions, learned by adaptive gradient steps on the likelihood."""

    def __init__(self, hashed: int, size: int, rate: float):
        self.weights = np.zeros((hashed, size), np.float32)
        self.logits = np.zeros((size, size))
        self.rate = rate
        self._seen, self._seen_t = np.full_like(self.weights, 1e-6), np.full_like(self.logits, 1e-6)

    def transition(self) -> np.ndarray:
        """Positive factors, at most 1."""
        return np.exp(self.logits - self.logits.max())

    def factors(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        scores = np.add.reduceat(self.weights[at], starts, axis=0)
        return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12

    def update(self, at: np.ndarray, starts: np.ndarray, y: np.ndarray, begins: np.ndarray, sequences: int) -> None:
        """One step. at, starts: features of the words of all sequences, end to end; y: labels; begins: where a sequence begins."""
        hashed, size = self.weights.shape
        t = self.transition()
        post, alpha = Chain(self.factors(at, starts), t, begins).posterior()
        grad = post.copy()
        grad[np.arange(len(y)), y] -= 1
        rows = np.repeat(grad, np.diff(np.append(starts, len(at))), axis=0)
        g = np.stack([np.bincount(at, rows[:, k], hashed) for k in range(size)], axis=1) / sequences
        self._seen += g * g
        self.weights -= (self.rate * g / np.sqrt(self._seen)).astype(np.float32)
        inner = np.flatnonzero(~begins)
        joint = alpha[inner - 1][:, :, None] * t[None] * (post[inner] / np.maximum(alpha[inner - 1] @ t, 1e-300))[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        real = np.zeros((size, size))
        np.add.at(real, (y[inner - 1], y[inner]), 1)
        gt = (joint.sum(axis=0) - real) / sequences
        self._seen_t += gt * gt
        self.logits -= self.rate / 4 * gt / np.sqrt(self._seen_t)


def viterbi(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best label sequences (b, n) of a batch of padded sequences. scores: (b, n, L), log factors; transition: (L, L), log."""
    b, n, size = scores.shape
    back = np.zeros((b, n, size), np.int16)
    best = scores[:, 0].copy()
    for t in range(1, n):
        reach = best[:, :, None] + transition[None]
        back[:, t] = reach.argmax(axis=1)
        new = reach.max(axis=1) + scores[:, t]
        best = np.where((t < lengths)[:, None], new, best)
    out = np.zeros((b, n), np.int64)
    label = best.argmax(axis=1)
    rows = np.arange(b)
    for t in range(n - 1, -1, -1):
        inside = t < lengths
        out[:, t] = np.where(inside, label, 0)
        label = np.where(inside & (t > 0), back[rows, t, label], label)
    return out
