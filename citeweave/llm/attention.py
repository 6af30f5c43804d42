"""A small causal self-attention model over subword ids, trained and run in numpy.

What a subword is like comes from counts of the corpus: a vector of fixed features for each id, and the logits of the
class behind it. At each place, the features of the subwords up to there are embedded and attended to by one head with
learned positions; what it finds is added to the logits of the last subword and gives the distribution of the next
subword's class. Windows of SPAN places overlap by half; only the second half of each is scored
or trained on, so that every place counts once and sees at least half a window (behind the start: all there is).
"""

from __future__ import annotations

import numpy as np

SPAN, HALF = 48, 24
#: Logits are held under this, so that no exponential overflows a 32-bit number.
TOP = np.float32(60)


class Attention:
    """features and logits: one row for each id, then one for the start of a text; features has one of zeros more, for the
    void before it."""

    def __init__(self, features: np.ndarray, logits: np.ndarray, width: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.features, self.last, self.width = np.asarray(features, np.float32), np.asarray(logits, np.float32), width
        m, self.classes = features.shape[1], logits.shape[1]
        self.start, self.void = len(features) - 2, len(features) - 1
        self.p = {"e": near(m, width), "at": near(SPAN, width), "q": near(width, width), "k": near(width, width), "v": near(width, width), "o": near(width, self.classes) * 0.1, "b": np.zeros(self.classes, np.float32)}
        self.load(self.vector())
        self.top = float(self.last.max()) if self.last.size else 0.0
        self.mask = (np.arange(SPAN)[None, :] <= np.arange(HALF, SPAN)[:, None]).astype(np.float32)
        self.reset()

    def reset(self) -> None:
        """Forget the optimiser's state."""
        self._embedded, self._some = None, {}
        self.first, self.second, self.step = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.moments = dict(zip(self.p, zip(self._views(self.first).values(), self._views(self.second).values())))

    # --- parameters as one vector, for averaging; their number doesn't depend on the vocabulary

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, vector: np.ndarray) -> Attention:
        self.flat, self._embedded = np.array(vector, np.float32), None
        self.p = self._views(self.flat)
        return self

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters as parts of one array."""
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        return {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(flat, cuts))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.load(self.vector()).reset()

    # --- windows

    def windows(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (n, SPAN) of texts laid end to end, and for each place of the texts its place among the n * HALF scored."""
        size = np.diff(edges)
        n = -(-size // HALF)
        total = int(n.sum())
        # each text takes n + 1 halves: void and then its start in front
        first = (np.cumsum(n + 1) - (n + 1)) * HALF
        full = np.full((total + len(n)) * HALF, self.void, np.int32)
        spot = np.arange(len(ids)) - np.repeat(edges[:-1], size)
        place = np.repeat(first + HALF, size) + spot
        full[place[spot == 0]] = self.start
        inner = np.flatnonzero(spot > 0)
        full[place[inner]] = ids[inner - 1]
        halves = full.reshape(-1, HALF)
        left = np.repeat(first // HALF - (np.cumsum(n) - n), n) + np.arange(total)
        x = np.concatenate([halves[left], halves[left + 1]], axis=1) if total else np.zeros((0, SPAN), np.int32)
        return x, np.repeat((np.cumsum(n) - n) * HALF, size) + spot

    def _attend(self, x: np.ndarray, h: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """What the places spots (n, any) of the second halves find."""
        p, scale = self.p, np.float32(self.width**-0.5)
        h += p["at"]
        late = h[np.arange(len(x))[:, None], HALF + spots]
        q, k, v = (late @ p["q"]) * scale, h @ p["k"], h @ p["v"]
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, TOP, out=a)
        np.exp(a, out=a)
        a *= self.mask[spots]
        early = np.flatnonzero(x[:, 0] == self.void)
        a[early] *= (x[early] != self.void)[:, None, :]
        total = a.sum(axis=2, keepdims=True)
        return (a @ v) / total

    def _logits(self, last: np.ndarray, c: np.ndarray, classes: int) -> np.ndarray:
        z = c @ self.p["o"][:, :classes]
        z += (self.last if classes == self.classes else self._some[classes])[last]
        z += self.p["b"][:classes]
        return np.minimum(z, TOP, out=z)

    def found(self, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some of the x's n * HALF places, given in order: the id before each, and what attention finds there."""
        if self._embedded is None:
            self._embedded = self.features @ self.p["e"]
        window = places // HALF
        many = np.bincount(window, minlength=len(x))
        spots = np.zeros((len(x), max(1, int(many.max()))), np.int64)
        spot = np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many)
        spots[window, spot] = places % HALF
        return x[:, HALF:].ravel()[places], self._attend(x, self._embedded[x], spots)[window, spot]

    def logits(self, last: np.ndarray, c: np.ndarray, classes: int | None = None) -> np.ndarray:
        """Logits of the first so many classes (all) at places that were `found`."""
        classes = classes or self.classes
        if classes < self.classes and classes not in self._some:
            self._some[classes] = np.ascontiguousarray(self.last[:, :classes])
        return self._logits(last, c, classes)

    def train(self, x: np.ndarray, targets: np.ndarray, rate: float = 0.01) -> float:
        """One step of Adam on these windows; targets: classes of the n * HALF places (-1: none). The loss before it."""
        p, scale, n, w = self.p, np.float32(self.width**-0.5), len(x), self.width
        largest = lambda t: max(float(t.max()), -float(t.min()))
        # all places by one product each; a column of ones carries sums along
        f = self.features.take(x.ravel(), axis=0)
        h = np.ones((n, SPAN, w + 1), np.float32)
        np.add((f @ p["e"]).reshape(n, SPAN, w), p["at"], out=h[:, :, :w])
        by = np.zeros((w + 1, 2 * w + 1), np.float32)
        by[:w, :w], by[:w, w : 2 * w], by[w, 2 * w] = p["k"], p["v"], 1
        kv = (h.reshape(-1, w + 1) @ by).reshape(n, SPAN, 2 * w + 1)
        k, v = kv[:, :, :w], kv[:, :, w:]
        late = np.ascontiguousarray(h[:, HALF:, :w]).reshape(-1, w)
        q = (late @ (p["q"] * scale)).reshape(n, HALF, w)
        # weights are not divided by their sums; what they are multiplied with is
        a = q @ k.transpose(0, 2, 1)
        if largest(q) * largest(k) * w > TOP:
            np.minimum(a, TOP, out=a)
        np.exp(a, out=a)
        a *= self.mask
        early = np.flatnonzero(x[:, 0] == self.void)
        if len(early):
            a[early] *= (x[early] != self.void)[:, None, :]
        c = a @ v
        total = c[:, :, w:].copy()
        c /= total
        last, seen = x[:, HALF:].ravel(), c.reshape(-1, w + 1)
        whole = targets.min() >= 0
        if not whole:
            some = np.flatnonzero(targets >= 0)
            last, seen, targets = last[some], seen[some], targets[some]
        o = self.flat[-(w + 1) * self.classes :].reshape(w + 1, self.classes)  # with b as its last row
        z = self.last.take(last, axis=0)
        z += seen @ o
        if self.top + largest(seen) * float(np.abs(o).sum(axis=0).max()) > TOP:
            np.minimum(z, TOP, out=z)
        own = np.arange(len(z)), targets
        hit = z[own]
        np.exp(z, out=z)
        back = np.ones((self.classes, w + 1), np.float32)
        back[:, :w] = p["o"].T
        d = z @ back
        sums = d[:, w].copy()
        loss = float((np.log(sums) - hit).mean())
        z[own] -= sums
        d[:, :w] -= sums[:, None] * back[:, :w].take(targets, axis=0)
        share = (1 / (sums * np.float32(len(z))))[:, None]
        g_o = (seen * share).T @ z
        d *= share
        if whole:
            dc = d.reshape(n, HALF, w + 1)
        else:
            dc = np.zeros((n * HALF, w + 1), np.float32)
            dc[some] = d
            dc = dc.reshape(n, HALF, w + 1)
        dc /= total
        dc[:, :, w] = -np.einsum("nij,nij->ni", dc[:, :, :w], c[:, :, :w])
        da = dc @ v.transpose(0, 2, 1)
        da *= a
        dkv = np.empty((n, SPAN, 2 * w), np.float32)
        dkv[:, :, w:] = a.transpose(0, 2, 1) @ dc[:, :, :w]
        dkv[:, :, :w] = da.transpose(0, 2, 1) @ q  # q holds the scale
        dq, dkv = (da @ k).reshape(-1, w), dkv.reshape(-1, 2 * w)
        g_kv = h.reshape(-1, w + 1).T @ dkv
        dh = (dkv @ by[:w, : 2 * w].T).reshape(n, SPAN, w)
        dh[:, HALF:] += (dq @ (p["q"].T * scale)).reshape(n, HALF, w)
        g = np.concatenate([x.ravel() for x in (f.T @ dh.reshape(-1, w), dh.sum(axis=0), (late.T @ dq) * scale, g_kv[:w, :w], g_kv[:w, w:], g_o)])
        self.step += 1
        self.first += 0.1 * (g - self.first)
        self.second += 0.01 * (g * g - self.second)
        self.flat -= np.float32(rate) * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-6)
        self._embedded = None
        return loss
