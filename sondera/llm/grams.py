"""Hashed byte n-grams and linear classifiers in numpy."""

from __future__ import annotations

import numpy as np

#: ASCII characters that are not letters part words; upper case becomes lower case.
_LETTERS = bytes((c | 0x20) if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: For texts whose marks matter: only case and digits are evened out.
_MARKS = bytes((c | 0x20) if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_SLICE = 1_000_000


def gram_counts(text: str, dims: int, letters_only: bool = True) -> np.ndarray:
    """Counts of hashed 1- to 3-byte grams of the whole text; ``dims`` is a power of two."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LETTERS if letters_only else _MARKS)
    raw = b" " + b" ".join(raw.split()) + b" "
    shift = np.uint32(32 - dims.bit_length() + 1)
    total = np.zeros(dims, dtype=np.int64)
    for low in range(0, len(raw), _SLICE):  # memory does not grow with the text
        b = np.frombuffer(raw[low : low + _SLICE + 2], dtype=np.uint8).astype(np.uint32)
        own = min(_SLICE, len(raw) - low)
        for n in (1, 2, 3):
            if len(b) < n:
                continue
            code = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                code = (code << np.uint32(8)) | b[k : len(b) - n + 1 + k]
            code = (code[:own] + np.uint32(n << 24)) * np.uint32(2654435761)
            total += np.bincount(code >> shift, minlength=dims)
    return total


def gram_vector(text: str, dims: int, letters_only: bool = True) -> np.ndarray:
    """The logarithms of ``gram_counts`` at unit length."""
    v = np.log1p(gram_counts(text, dims, letters_only)).astype(np.float32)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else v


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, turns: int = 150, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of logistic regressions, one for each column of ``y`` in {0, 1}, by full-batch Adam."""
    y = np.asarray(y, dtype=np.float32).reshape(len(x), -1)
    weight = np.ones(len(x), dtype=np.float32) if weight is None else np.asarray(weight, dtype=np.float32)
    share = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, turns + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * share
        gw, gb = x.T @ g + l2 * w, g.sum(0)
        step = rate / (1 + 0.02 * t)
        for param, grad, m, v in ((w, gw, mw, vw), (b, gb, mb, vb)):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
