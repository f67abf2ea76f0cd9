"""A gated recurrent language model in numpy with a class-factored output.

Words are numbered by falling frequency in classes of equal size; number 0 is
"any other word".  P(word) = P(class | state) * P(word | class, state).  The output
biases start at the log frequencies, so an untrained model is the unigram model
of its vocabulary.  Training is back-propagation truncated to windows, with
Adagrad; the state is carried from window to window and reset where a text begins.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
CLASSES = 64
CLASS_SIZE = 64
WINDOW = 32
RATE = 0.12


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    #: Parameters in the order in which they are packed.
    NAMES = ("inputs", "gates", "candidate", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, size: int = CLASS_SIZE, seed: int = 3):
        """``counts``: mass of each of the ``classes * size`` words, 0 for numbers without a word."""
        r = np.random.default_rng(seed)
        k = classes * size
        self.hidden, self.classes, self.size = hidden, classes, size
        mass = np.maximum(counts.astype(np.float64), 1e-9)[:k].reshape(classes, size)
        f = lambda x: x.astype(np.float32)
        self.p = {
            "inputs": f(r.normal(0, 0.3, (k, 3 * hidden))),
            "gates": f(r.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))),
            "candidate": f(r.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))),
            "class_w": np.zeros((hidden, classes), np.float32),
            "class_b": f(np.log(mass.sum(1) / mass.sum())),
            "word_w": np.zeros((classes, hidden, size), np.float32),
            "word_b": f(np.log(mass / mass.sum(1, keepdims=True))),
        }
        self.p["inputs"][:, :hidden] += 1.0
        self.sums = None

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            shape, count = self.p[n].shape, self.p[n].size
            self.p[n] = flat[at : at + count].reshape(shape).astype(np.float32)
            at += count

    def advance(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, tape: dict | None = None):
        """States after each of the (steps, lanes) inputs; ``fresh`` resets a lane before its input.  ``tape`` takes what learning needs."""
        p, n = self.p, self.hidden
        x = p["inputs"][ids]
        states = np.empty((*ids.shape, n), np.float32)
        if tape is not None:
            tape |= {"h": np.empty_like(states), "zr": np.empty((*ids.shape, 2 * n), np.float32), "c": np.empty_like(states)}
        resets = fresh.any(axis=1)
        for t in range(len(ids)):
            if resets[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            zr = h @ p["gates"]
            zr += x[t, :, : 2 * n]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr += np.float32(1.0)
            zr *= np.float32(0.5)
            z, r = zr[:, :n], zr[:, n:]
            c = (r * h) @ p["candidate"]
            c += x[t, :, 2 * n :]
            np.tanh(c, out=c)
            if tape is not None:
                tape["h"][t], tape["zr"][t], tape["c"][t] = h, zr, c
            h = c + z * (h - c)
            states[t] = h
        return states, h

    def _exponentials(self, logits: np.ndarray, bound: float) -> np.ndarray:
        """``exp`` in place; the largest logit of a row is taken off first only if logits could be too large for it."""
        if bound > 80.0:
            logits -= logits.max(1, keepdims=True)
        return np.exp(logits, out=logits)

    def _outputs(self, flat: np.ndarray, target: np.ndarray, grad: dict | None):
        """Log probability (natural) of each target; with ``grad``, also the gradient by state."""
        p = self.p
        cls = target // self.size
        order = np.argsort(cls.astype(np.min_scalar_type(self.classes)), kind="stable")
        cls, word, flat = cls[order], target[order] % self.size, flat[order]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        live = [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        rows = np.arange(len(flat))
        bound = lambda w, b: float(np.abs(w).sum(-2).max() + np.abs(b).max())  # noqa: E731  states are between -1 and 1
        back = None
        log = 0.0
        for which, at in (("class", cls), ("word", word)):
            w, b = p[f"{which}_w"], p[f"{which}_b"]
            if which == "class":
                logits = flat @ w
                logits += b
            else:
                logits = np.empty((len(flat), self.size), np.float32)
                for c, lo, hi in live:
                    np.matmul(flat[lo:hi], w[c], out=logits[lo:hi])
                    logits[lo:hi] += b[c]
            hit = logits[rows, at]
            most = bound(w, b)
            if most > 80.0:
                hit = hit - logits.max(1)
            e = self._exponentials(logits, most)
            total = e.sum(1)
            log = log + hit - np.log(total)
            if grad is None:
                continue
            e *= (-1.0 / total)[:, None]
            e[rows, at] += 1.0
            if which == "class":
                back = e @ w.T
                grad["class_w"], grad["class_b"] = flat.T @ e, e.sum(0)
            else:
                sums = np.add.reduceat(e, [lo for _, lo, _ in live], axis=0)
                grad["word_w"], grad["word_b"] = {}, {}
                for (c, lo, hi), s in zip(live, sums):
                    back[lo:hi] += e[lo:hi] @ w[c].T
                    grad["word_w"][c], grad["word_b"][c] = flat[lo:hi].T @ e[lo:hi], s
        out = np.empty(len(flat), np.float32)
        out[order] = log
        if back is not None:
            unsorted = np.empty_like(back)
            unsorted[order] = back
            back = unsorted
        return out, back

    def log_probabilities(self, ids: np.ndarray, fresh: np.ndarray, target: np.ndarray, h: np.ndarray):
        states, h = self.advance(ids, fresh, h)
        out, _ = self._outputs(states.reshape(-1, self.hidden), target.ravel(), None)
        return out.reshape(target.shape), h

    def learn(self, ids: np.ndarray, fresh: np.ndarray, target: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window of (steps, lanes); the state to go on with."""
        p, n = self.p, self.hidden
        tape: dict = {}
        states, last = self.advance(ids, fresh, h, tape)
        g: dict = {}
        _, back = self._outputs(states.reshape(-1, n), target.ravel(), g)
        back = back.reshape(states.shape)
        before, c = tape["h"], tape["c"]
        z, r = tape["zr"][:, :, :n], tape["zr"][:, :, n:]
        # What the steps multiply the gradient by, for all steps at once.
        to_c, to_z, to_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), before * r * (1 - r)
        dx = np.empty((*ids.shape, 3 * n), np.float32)
        dh = np.zeros_like(last)
        resets = fresh.any(axis=1)
        gates, candidate = np.ascontiguousarray(p["gates"].T), np.ascontiguousarray(p["candidate"].T)
        for t in range(len(ids) - 1, -1, -1):
            dh += back[t]
            d = dx[t]
            np.multiply(dh, to_z[t], out=d[:, :n])
            np.multiply(dh, to_c[t], out=d[:, 2 * n :])
            gated = d[:, 2 * n :] @ candidate
            np.multiply(gated, to_r[t], out=d[:, n : 2 * n])
            dh *= z[t]
            gated *= r[t]
            dh += gated
            dh += d[:, : 2 * n] @ gates
            if resets[t]:
                dh[fresh[t]] = 0.0
        dx = dx.reshape(-1, 3 * n)
        g["gates"] = before.reshape(-1, n).T @ dx[:, : 2 * n]
        g["candidate"] = (r * before).reshape(-1, n).T @ dx[:, 2 * n :]
        self._step(g, ids.ravel(), dx)
        return last

    def _move(self, name: str, at, d: np.ndarray) -> None:
        np.clip(d, -5, 5, out=d)
        sums = self.sums[name][at]
        sums += d * d
        self.sums[name][at] = sums
        d *= np.float32(RATE)
        d /= np.sqrt(sums)
        self.p[name][at] += d

    def _step(self, g: dict, ids: np.ndarray, dx: np.ndarray) -> None:
        if self.sums is None:
            self.sums = {k: np.full(v.shape, 1.0, np.float32) for k, v in self.p.items()}
        for name in ("gates", "candidate", "class_w", "class_b"):
            self._move(name, ..., g[name])
        for name in ("word_w", "word_b"):
            if g[name]:
                self._move(name, list(g[name]), np.stack(list(g[name].values())))
        order = np.argsort(ids.astype(np.uint16) if len(self.p["inputs"]) <= 1 << 16 else ids, kind="stable")
        ranked = ids[order]
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self._move("inputs", ranked[at], np.add.reduceat(dx[order], at, axis=0))


def lanes_of(lengths: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Texts dealt over lanes of about equal total length, the longest lane first."""
    order = np.argsort(-lengths, kind="stable")
    load = np.zeros(min(lanes, max(1, len(lengths))), np.int64)
    held: list[list[int]] = [[] for _ in load]
    import heapq

    heap = [(0, i) for i in range(len(load))]
    for row in order.tolist():
        total, lane = heapq.heappop(heap)
        held[lane].append(row)
        load[lane] = total + int(lengths[row])
        heapq.heappush(heap, (int(load[lane]), lane))
    return [np.array(held[i], np.int64) for i in np.argsort(-load, kind="stable")]


class Lanes:
    """Texts laid end to end in lanes, the longest lane first; windows are gathered as they are needed.

    The input before the first token of a text is number 0.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, lanes: int):
        lengths = np.diff(bounds)
        held = lanes_of(lengths, lanes)
        order = np.concatenate(held) if held else np.zeros(0, np.int64)
        n = lengths[order]
        ends = np.cumsum(n)
        self.place = (np.arange(int(n.sum()), dtype=np.int64) + np.repeat(bounds[order] - (ends - n), n)).astype(np.int32)
        self.target = ids[self.place].astype(np.int32)
        self.fresh = np.zeros(len(self.target), bool)
        self.fresh[(ends - n)[n > 0]] = True
        self.before = np.zeros(len(self.target), np.int32)
        self.before[1:] = self.target[:-1]
        self.before[self.fresh] = 0
        self.sizes = np.array([lengths[x].sum() for x in held], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def windows(self, size: int):
        """Places (steps, lanes) in the laid-out arrays; each window has only lanes that last to its end."""
        a, longest = 0, int(self.sizes.max(initial=0))
        while a < longest:
            active = int((self.sizes > a).sum())
            end = int(min(self.sizes[active - 1], a + size))
            yield self.starts[None, :active] + np.arange(a, end)[:, None]
            a = end


def train(model: Gru, ids: np.ndarray, bounds: np.ndarray, lanes: int = 128, window: int = WINDOW) -> None:
    laid = Lanes(ids, bounds, lanes)
    h = np.zeros((len(laid.sizes), model.hidden), np.float32)
    for at in laid.windows(window):
        h = model.learn(laid.before[at], laid.fresh[at], laid.target[at], h[: at.shape[1]])


def score(model: Gru, ids: np.ndarray, bounds: np.ndarray, lanes: int = 640, window: int = WINDOW) -> np.ndarray:
    """Natural log probability of each token; every text from its own beginning to its end."""
    laid = Lanes(ids, bounds, lanes)
    out = np.zeros(len(ids), np.float32)
    h = np.zeros((len(laid.sizes), model.hidden), np.float32)
    for at in laid.windows(window):
        got, h = model.log_probabilities(laid.before[at], laid.fresh[at], laid.target[at], h[: at.shape[1]])
        out[laid.place[at].ravel()] = got.ravel()
    return out
