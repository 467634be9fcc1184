"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import ctypes
import glob
import heapq
import os

import numpy as np

#: Arrays of a model, in the order of its flat form.
NAMES = ("embed", "wx", "u", "b", "class_w", "class_b", "word_w", "word_b")


def one_thread() -> None:
    """Settings of a worker that steps through many small products.

    numpy's own OpenBLAS uses one thread: a second one only spins.  Freed arrays of up to 64 MB stay
    with the process, at most 128 MB of them: to get their pages anew for every window costs a
    fifth of the time.
    """
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        put = getattr(ctypes.CDLL(path), "scipy_openblas_set_num_threads64_", None)
        if put is not None:
            put(1)
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        for name, value in ((-3, 64 << 20), (-1, 128 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            mallopt(name, value)


def sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.negative(x, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def bounded(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether logits h @ w + b of states within -1 and 1 leave room for their exponentials in float32."""
    return float((np.abs(w).sum(axis=0) + np.abs(b)).max()) <= 60


def exponentials(h: np.ndarray, w: np.ndarray, b: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logits h @ w + b and their exponentials; each row's maximum is taken off first unless they are small."""
    logits = h @ w
    logits += b
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    return logits, np.exp(logits)


def word_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word (given by falling count): equal shares of the summed square roots of counts."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 0.5)))
    raw = np.minimum((mass - mass[0]) / mass[-1] * classes, classes - 1).astype(np.int64)
    return np.unique(raw, return_inverse=True)[1]


class Gru:
    """Next-token model over ids 0 to V - 1, whose first ids are the most frequent.

    A token's probability is that of its class times that within the class.  Ids of one class are
    consecutive.  States start at zero with every document.
    """

    def __init__(self, counts: np.ndarray, classes: int = 40, embed: int = 24, hidden: int = 24, seed: int = 5) -> None:
        self.of = word_classes(counts, classes)
        self.first = np.searchsorted(self.of, np.arange(self.of[-1] + 2))
        k, v = int(self.of[-1]) + 1, len(counts)
        rng = np.random.default_rng(seed)
        share = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()
        mass = np.add.reduceat(share, self.first[:-1])
        f = np.float32
        self.p = {
            "embed": rng.normal(0, 0.1, (v, embed)).astype(f),
            "wx": rng.normal(0, 0.3, (embed, 3 * hidden)).astype(f),
            "u": rng.normal(0, 0.2, (hidden, 3 * hidden)).astype(f),
            "b": np.zeros(3 * hidden, f),
            "class_w": np.zeros((hidden, k), f),
            "class_b": np.log(mass).astype(f),
            "word_w": np.zeros((hidden, v), f),
            "word_b": np.log(share / mass[self.of]).astype(f),
        }
        self.hidden = hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in NAMES])

    def load(self, flat: np.ndarray) -> Gru:
        self.view(flat.astype(np.float32))
        return self

    def view(self, flat: np.ndarray) -> None:
        """Let the parameters be views of their flat form."""
        at = 0
        for n in NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape)
            at += size

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = self.hidden
        g = h @ self.p["u"]
        zr = sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
        c = np.tanh(x[:, 2 * n :] + zr[:, n:] * g[:, 2 * n :])
        return c + zr[:, :n] * (h - c)

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after its state."""
        by_target = np.argsort(targets.astype(np.uint16), kind="stable")  # ids of one class are consecutive
        h, targets = h[by_target], targets[by_target]
        of, rows = self.of[targets], np.arange(len(targets))
        logits, powers = exponentials(h, self.p["class_w"], self.p["class_b"], bounded(self.p["class_w"], self.p["class_b"]))
        logs = logits[rows, of] - np.log(powers @ np.ones(powers.shape[1], powers.dtype))
        cuts, small = np.searchsorted(of, np.arange(len(self.first))), bounded(self.p["word_w"], self.p["word_b"])
        for k in range(len(self.first) - 1):
            lo, hi, a, b = int(self.first[k]), int(self.first[k + 1]), cuts[k], cuts[k + 1]
            if hi - lo == 1 or a == b:
                continue
            inner, powers = exponentials(h[a:b], self.p["word_w"][:, lo:hi], self.p["word_b"][lo:hi], small)
            logs[a:b] += inner[rows[: b - a], targets[a:b] - lo] - np.log(powers @ np.ones(hi - lo, powers.dtype))
        out = np.empty_like(logs)
        out[by_target] = logs
        return out

    def score(self, ids: np.ndarray, starts: np.ndarray, window: int = 64, cells: int = 1 << 15) -> np.ndarray:
        """Natural log probability of each whole document; the state passes from window to window."""
        table = self.p["embed"] @ self.p["wx"] + self.p["b"]
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        begin, sizes = starts[:-1][order], lengths[order]
        total = np.zeros(len(order))
        h = np.zeros((len(order), self.hidden), np.float32)
        t, longest = 0, int(sizes[0]) if len(sizes) else 0
        while t < longest:
            live = int(np.searchsorted(-sizes, -t, side="left"))
            span = min(longest - t, max(window, cells // max(live, 1)))
            states, targets, owners = [], [], []
            for s in range(t, t + span):
                live = int(np.searchsorted(-sizes, -s, side="left"))
                h = h[:live]
                token = ids[begin[:live] + s]
                states.append(h)
                targets.append(token)
                owners.append(live)
                h = self.step(table[token], h)
            logs = self.log_probs(np.concatenate(states), np.concatenate(targets))
            at = 0
            for live in owners:
                total[:live] += logs[at : at + live]
                at += live
            t += span
        out = np.zeros(len(order))
        out[order] = total
        return out

    def gradients(self, tokens: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of a window (steps x lanes); fresh marks first tokens of documents, live the real tokens."""
        p, n = self.p, self.hidden
        steps, lanes = tokens.shape
        x = (p["embed"] @ p["wx"] + p["b"])[tokens]
        states = np.empty((steps, lanes, n), x.dtype)
        gates = np.empty((steps, lanes, 2 * n), x.dtype)
        inner_g, cand = np.empty_like(states), np.empty_like(states)
        for s in range(steps):
            if fresh[s].any():
                h = np.where(fresh[s][:, None], x.dtype.type(0), h)
            states[s] = h
            g = h @ p["u"]
            zr, c = gates[s], cand[s]
            np.add(x[s, :, : 2 * n], g[:, : 2 * n], out=zr)
            sigmoid(zr, out=zr)
            inner_g[s] = g[:, 2 * n :]
            np.multiply(zr[:, n:], g[:, 2 * n :], out=c)
            c += x[s, :, 2 * n :]
            np.tanh(c, out=c)
            h = h - c
            h *= zr[:, :n]
            h += c
        flat, target, weight = states.reshape(-1, n), tokens.ravel(), live.ravel().astype(x.dtype)
        by_target = np.argsort(target.astype(np.uint16), kind="stable")  # ids of one class are consecutive
        flat_s, target_s, weight_s = flat[by_target], target[by_target], weight[by_target]
        class_s, rows = self.of[target_s], np.arange(len(target))
        _, prob = exponentials(flat_s, p["class_w"], p["class_b"], bounded(p["class_w"], p["class_b"]))
        prob *= (1 / (prob @ np.ones(prob.shape[1], prob.dtype)))[:, None]
        loss = float(-(np.log(prob[rows, class_s] + 1e-30) * weight_s).sum())
        prob[rows, class_s] -= 1
        prob *= weight_s[:, None]
        g = {"class_w": flat_s.T @ prob, "class_b": prob.sum(axis=0), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        dh_s = prob @ p["class_w"].T
        cuts, small = np.searchsorted(class_s, np.arange(len(self.first))), bounded(p["word_w"], p["word_b"])
        for k in range(len(self.first) - 1):
            lo, hi, a, b = int(self.first[k]), int(self.first[k + 1]), cuts[k], cuts[k + 1]
            if hi - lo == 1 or a == b:
                continue
            _, q = exponentials(flat_s[a:b], p["word_w"][:, lo:hi], p["word_b"][lo:hi], small)
            q *= (1 / (q @ np.ones(hi - lo, q.dtype)))[:, None]
            own, at = target_s[a:b] - lo, rows[: b - a]
            loss -= float((np.log(q[at, own] + 1e-30) * weight_s[a:b]).sum())
            q[at, own] -= 1
            q *= weight_s[a:b, None]
            g["word_w"][:, lo:hi] = flat_s[a:b].T @ q
            g["word_b"][lo:hi] = q.sum(axis=0)
            dh_s[a:b] += q @ p["word_w"][:, lo:hi].T
        dh_out = np.empty_like(dh_s)
        dh_out[by_target] = dh_s
        dh_out = dh_out.reshape(steps, lanes, n)
        # dx is the gradient of x; where it meets the candidate, that of h @ u has the reset gate as a factor
        z, r = gates[:, :, :n], gates[:, :, n:]
        to_cand = (1 - z) * (1 - cand * cand)
        to_z, to_r = (states - cand) * z * (1 - z), inner_g * r * (1 - r)
        dx, dg = np.empty_like(x), np.empty_like(x)
        dh, back = np.zeros((lanes, n), x.dtype), p["u"].T.copy()
        for s in reversed(range(steps)):
            own = dg[s]
            dc = dx[s, :, 2 * n :]
            np.multiply(dh, to_cand[s], out=dc)
            np.multiply(dh, to_z[s], out=own[:, :n])
            np.multiply(dc, to_r[s], out=own[:, n : 2 * n])
            np.multiply(dc, r[s], out=own[:, 2 * n :])
            dh = dh * z[s]
            dh += own @ back
            dh += dh_out[s]
            if fresh[s].any():
                dh[fresh[s]] = 0
        dx[:, :, : 2 * n] = dg[:, :, : 2 * n]
        g["u"] = flat.T @ dg.reshape(-1, 3 * n)
        flat_dx = dx.reshape(-1, 3 * n)
        g["b"] = flat_dx.sum(axis=0)
        g["wx"] = p["embed"][target].T @ flat_dx
        first = np.flatnonzero(np.diff(target_s, prepend=-1))
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][target_s[first]] = np.add.reduceat((flat_dx @ p["wx"].T)[by_target], first)
        return g, h, loss

    def train(
        self, documents: list[np.ndarray], lanes: int = 256, window: int = 32, rate: float = 0.006, epochs: int = 1, span: int = 2048
    ) -> float:
        """Adam over windows of all documents, dealt to lanes; returns the last epoch's loss per token.

        The state passes from a window to the next; gradients do not.  A document of more than
        span tokens is learned in spans of their own, so that one long text does not leave the
        other lanes idle.
        """
        documents = [d[k : k + span] for d in documents for k in range(0, len(d), span)]
        if not documents:
            return 0.0
        bins: list[list[np.ndarray]] = [[] for _ in range(min(lanes, len(documents)))]
        heap = [(0, k) for k in range(len(bins))]
        for d in documents:
            fill, k = heapq.heappop(heap)
            bins[k].append(d)
            heapq.heappush(heap, (fill + len(d), k))
        bins.sort(key=lambda own: -sum(map(len, own)))  # live lanes are always the first ones
        fills = np.array([sum(map(len, own)) for own in bins])
        longest = -(-int(fills[0]) // window) * window
        tokens = np.zeros((longest, len(bins)), np.int64)
        fresh = np.zeros((longest, len(bins)), bool)
        for k, own in enumerate(bins):
            tokens[: fills[k], k] = np.concatenate(own)
            fresh[np.cumsum([0, *map(len, own[:-1])]), k] = True
        live = np.arange(longest)[:, None] < fills
        flat = self.flat()
        self.view(flat)
        m, v, grad = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        step, loss = 0, 0.0
        for _ in range(epochs):
            h, loss = np.zeros((len(bins), self.hidden), np.float32), 0.0
            for t in range(0, longest, window):
                n = int(np.searchsorted(-fills, -t, side="left"))
                part = slice(t, t + window)
                g, h, lost = self.gradients(tokens[part, :n], fresh[part, :n], live[part, :n], h[:n])
                loss += lost
                step += 1
                np.concatenate([g[k].ravel() for k in NAMES], out=grad)
                grad /= int(live[part, :n].sum())
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return loss / int(fills.sum())
