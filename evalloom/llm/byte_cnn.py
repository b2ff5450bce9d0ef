"""A byte convolutional network in numpy: embedding, filters of several widths, max pooling over time, softmax."""

from __future__ import annotations

import io
import unicodedata

import numpy as np

WINDOW = 96
WIDTHS = (2, 3, 4, 5)
FILTERS = 32
EMBED = 12
BATCH = 64


def strip_accents(text: str) -> str:
    plain = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    return plain.replace("ł", "l").replace("Ł", "L").replace("ß", "ss")


def wrongly_decoded(text: str) -> str:
    """UTF-8 bytes read as Windows-1252, where a byte has no character there as Latin-1."""
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def windows(data: bytes) -> list[bytes]:
    """Windows of WINDOW bytes that cover ``data`` evenly; a shorter text gives one, padded with zeros when stacked."""
    if len(data) <= WINDOW:
        return [data]
    n = -(-len(data) // WINDOW)
    step = (len(data) - WINDOW) / (n - 1)
    return [data[int(i * step) : int(i * step) + WINDOW] for i in range(n)]


def stack(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), WINDOW)


class ByteCNN:
    """``fit`` on labelled texts; ``log_probabilities`` of windows. Weights are small (about 30 kB) and picklable."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.filters = {w: (rng.standard_normal((w * EMBED, FILTERS)) / np.sqrt(w * EMBED)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (rng.standard_normal((FILTERS * len(WIDTHS), len(labels))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self._tables: dict | None = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def _step(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict:
        """Gradients of the mean cross entropy on one batch of byte windows."""
        n, e = len(x), self.embed[x.T]  # places first: maxima then run over long rows
        pooled, at, cols = [], {}, {}
        for w in WIDTHS:
            c = np.concatenate([e[j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            z = c.reshape(-1, w * EMBED) @ self.filters[w]
            z = np.ascontiguousarray(z.reshape(WINDOW - w + 1, n * FILTERS).T)
            best = z.argmax(axis=1)
            at[w], cols[w] = best.reshape(n, FILTERS), c
            pooled.append(z[np.arange(len(z)), best].reshape(n, FILTERS) + self.bias[w])
        h = np.concatenate(pooled, axis=1)
        active = (h > 0) & (rng.random(h.shape) > 0.3)
        h = np.where(active, h / 0.7, 0).astype(np.float32)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        grads: dict = {"out": h.T @ p, "out_bias": p.sum(axis=0)}
        embed = np.zeros(self.embed.size)
        dh = np.where(active, (p @ self.out.T) / 0.7, 0).astype(np.float32)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            picked = cols[w][at[w], rows]
            grads["filters", w] = np.einsum("nf,nfk->kf", d, picked)
            grads["bias", w] = d.sum(axis=0)
            back = d[:, :, None] * self.filters[w].T[None]
            where = x[rows[:, :, None], at[w][:, :, None] + np.arange(w)]
            place = (where.reshape(-1, 1).astype(np.int64) * EMBED + np.arange(EMBED)).ravel()
            embed += np.bincount(place, weights=back.ravel(), minlength=self.embed.size)
        grads["embed"] = embed.reshape(self.embed.shape).astype(np.float32)
        return grads

    def fit(self, texts: list[str], labels: list[str], steps: int = 900, rate: float = 0.004, seed: int = 0) -> ByteCNN:
        """Adam on random crops of the texts, written as they are, without accents and wrongly decoded; languages equally often."""
        rng = np.random.default_rng(seed)
        by: dict[int, list[bytes]] = {}
        for text, label in zip(texts, labels, strict=True):
            for form in (text, text, strip_accents(text), wrongly_decoded(text)):
                by.setdefault(self.labels.index(label), []).append(form.lower().encode("utf-8"))
        kinds = sorted(by)
        state: dict = {}
        for t in range(1, steps + 1):
            parts, y = [], rng.choice(kinds, BATCH)
            for k in y:
                data = by[k][rng.integers(len(by[k]))]
                size = int(rng.integers(20, WINDOW + 1))
                start = int(rng.integers(0, max(1, len(data) - size + 1)))
                parts.append(data[start : start + size])
            for name, g in self._step(stack(parts), y, rng).items():
                m, v = state.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                state[name] = (m, v)
                change = rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                target = getattr(self, name) if isinstance(name, str) else getattr(self, name[0])[name[1]]
                target -= change.astype(np.float32)
        self._tables = None
        return self

    def to_bytes(self) -> bytes:
        """The labels and weights, for from_bytes."""
        out = io.BytesIO()
        many = {f"{kind}{w}": getattr(self, kind)[w] for kind in ("filters", "bias") for w in WIDTHS}
        np.savez(out, labels=np.array(self.labels), embed=self.embed, out=self.out, out_bias=self.out_bias, **many)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ByteCNN:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            net = cls([str(x) for x in z["labels"]])
            net.embed, net.out, net.out_bias = z["embed"], z["out"], z["out_bias"]
            net.filters, net.bias = ({w: z[f"{kind}{w}"] for w in WIDTHS} for kind in ("filters", "bias"))
        return net

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, labels). The convolution of one byte at one place of a filter is a table look-up, so no embedding is multiplied here."""
        if self._tables is None:
            self._tables = {w: [np.ascontiguousarray(self.embed @ self.filters[w][j * EMBED : (j + 1) * EMBED]) for j in range(w)] for w in WIDTHS}
        out = np.empty((len(x), len(self.labels)), np.float32)
        for s in range(0, len(x), 128):
            b = np.ascontiguousarray(x[s : s + 128].T.astype(np.intp))  # places first, so that the maximum runs over long rows
            pooled = []
            for w in WIDTHS:
                z = self._tables[w][0].take(b[: WINDOW - w + 1], axis=0)
                for j in range(1, w):
                    z += self._tables[w][j].take(b[j : WINDOW - w + 1 + j], axis=0)
                pooled.append(np.maximum(z.max(axis=0) + self.bias[w], 0))
            z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[s : s + 128] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out
