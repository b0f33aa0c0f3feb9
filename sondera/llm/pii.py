"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF for what they miss."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, slices

#: Kinds in their order; the patterns find the first four, the network all of them.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match within a run of digits can only begin where the run or the last match does
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Characters of a window, and between the starts of two; spans that touch an inner edge are decoded again with more text around.
WINDOW, STRIDE = 96, 48
#: Windows decoded at once, labelled windows that the network learns from, and how long.
AT_ONCE, TRAINED_ON, EPOCHS = 512, 1200, 6
HIDDEN, EMBED = 12, 10
#: A span's least mean margin, in log-odds, over having no span there.
LEAST_MARGIN = 2.0
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the patterns' matches, leftmost and non-overlapping within a kind; failing ones are dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # the longest local part before each at sign; a failing domain fails for every shorter one too
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# ---- characters ----

_SIGNS = " \n\t.,@+-()_=\"':;/#%$&*!|"
_CLASSES = 4 + len(_SIGNS) + 26


def char_classes(text: str) -> np.ndarray:
    """Each character's class: letters by themselves without case, digits together, some signs, the rest in two groups."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _TABLE[np.minimum(codes, 128)]


def _table() -> np.ndarray:
    out = np.zeros(129, dtype=np.int64)
    for c in range(128):
        ch = chr(c)
        out[c] = 1 if ch.isdigit() else 4 + _SIGNS.index(ch) if ch in _SIGNS else 4 + len(_SIGNS) + ord(ch.lower()) - 97 if ch.isalpha() else 2
    out[128] = 3
    return out


_TABLE = _table()

# ---- the network ----


@dataclass
class Network:
    """Embedding, one LSTM in each direction, a linear layer and the CRF's transitions, all in one dictionary of arrays."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        t = len(TAGS)
        p = {"emb": rng.normal(0, 0.3, (_CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, t)), "out_b": np.zeros(t), "trans": np.zeros((t, t)), "start": np.zeros(t)}
        for d in "fb":
            p[f"w{d}"] = rng.normal(0, 0.25, (EMBED, 4 * HIDDEN))
            p[f"u{d}"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of windows (class numbers, time first); with ``keep`` also what the way back needs."""
        steps, n = x.shape
        table = self.p["emb"] @ self.p[f"w{d}"] + self.p[f"b{d}"]  # one row for each class of character
        h, c, u = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"]
        out, saved = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]] + h @ u
            s = 1.0 / (1.0 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                saved.append((t, i, f, o, g, tc, before, c_before))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, sf = self._lstm(x, "f", keep)
        hb, sb = self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["out_b"], (h, sf, sb)

    def _back(self, x: np.ndarray, d: str, dh_all: np.ndarray, saved: list, grads: dict[str, np.ndarray]) -> None:
        n = x.shape[1]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dtable = np.zeros((_CLASSES, 4 * HIDDEN), np.float32)
        u = self.p[f"u{d}"]
        for t, i, f, o, g, tc, before, c_before in reversed(saved):
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(dtable, x[t], dz)
            grads[f"u{d}"] += before.T @ dz
            dh, dc = dz @ u.T, dc * f
        grads[f"w{d}"] += self.p["emb"].T @ dtable
        grads[f"b{d}"] += dtable.sum(0)
        grads["emb"] += dtable @ self.p[f"w{d}"].T

    def learn(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags ``y`` and its gradients (time first)."""
        e, (h, sf, sb) = self.emissions(x, keep=True)
        steps, n, t = e.shape
        trans, at = self.p["trans"], np.arange(n)
        top = lambda a, axis: (lambda m: np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis)))(a.max(axis, keepdims=True))
        alpha, beta = np.empty((steps, n, t)), np.zeros((steps, n, t))
        alpha[0] = self.p["start"] + e[0]
        for k in range(1, steps):
            alpha[k] = top(alpha[k - 1][:, :, None] + trans[None], 1) + e[k]
        for k in range(steps - 2, -1, -1):
            beta[k] = top(trans[None] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = top(alpha[-1], 1)
        gold = self.p["start"][y[0]] + e[0, at, y[0]] + sum(trans[y[k - 1], y[k]] + e[k, at, y[k]] for k in range(1, steps))
        de = np.exp(alpha + beta - z[None, :, None])
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dtrans = np.zeros((t, t))
        for k in range(1, steps):
            dtrans += np.exp(alpha[k - 1][:, :, None] + trans[None] + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dtrans, (y[k - 1], y[k]), -1.0)
        start = de[0].sum(0)
        np.add.at(start, y[0], -1.0)
        de[np.arange(steps)[:, None], at[None], y] -= 1.0
        de = (de / n).astype(np.float32)
        grads["trans"], grads["start"] = (dtrans / n).astype(np.float32), (start / n).astype(np.float32)
        flat = de.reshape(-1, t)
        grads["out"], grads["out_b"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        dh = de @ self.p["out"].T
        self._back(x, "f", dh[:, :, :HIDDEN], sf, grads)
        self._back(x, "b", dh[:, :, HIDDEN:], sb, grads)
        return float((z - gold).mean()), grads

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of windows (time first), and each place's margin of its tag's emission over that of O."""
        e, _ = self.emissions(x)
        steps, n, t = e.shape
        allowed = _allowed()
        trans = np.where(allowed[1:], self.p["trans"], -1e4).astype(np.float32)
        v = np.where(allowed[0], self.p["start"], -1e4) + e[0]
        came = np.empty((steps, n, t), dtype=np.int8)
        for k in range(1, steps):
            options = v[:, :, None] + trans[None]
            came[k] = options.argmax(1)
            v = np.take_along_axis(options, came[k][:, None, :].astype(np.int64), 1)[:, 0] + e[k]
        tags = np.empty((steps, n), dtype=np.int64)
        tags[-1] = v.argmax(1)
        for k in range(steps - 1, 0, -1):
            tags[k - 1] = came[k][np.arange(n), tags[k]]
        return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]


def _allowed() -> np.ndarray:
    """Row 0: tags that may come first; row 1 + a: tags that may follow tag a. An inner tag follows its own kind only."""
    t = len(TAGS)
    out = np.ones((t + 1, t), dtype=bool)
    for b, name in enumerate(TAGS):
        if name[0] == "I":
            out[0, b] = False
            for a, last in enumerate(TAGS):
                out[1 + a, b] = last[2:] == name[2:]
    return out


# ---- labelled spans ----

_SYLLABLES = "the an er ou ing tion st nd ly ha ble que eau oi ment lich keit ung sch der zu ción ado llo se que ar té è ß ü".split()


def labelled_windows(count: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up prose with made-up personal data and their tags, time first.

    The data vary more than the patterns allow: spaced or spelled-out addresses, phone numbers without a leading sign, cards with
    other separators, tokens and keys. Numbers that are no personal data (years, amounts, versions) are left untagged.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))

    def word() -> str:
        w = "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
        return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.1 else w

    def card() -> str:
        n = int(rng.integers(13, 20))
        body = str(rng.integers(1, 10)) + digits(n - 2)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        full, sep = body + last, pick(["", "", " ", "-", ".", "  "])
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4))

    def email() -> str:
        name, host, top = word().lower(), pick(["mail", "example", "post"]) + pick(["", str(rng.integers(0, 10))]), pick(["com", "org", "example.com", "de"])
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
        return f"{name}{pick(['.', '_', ''])}{pick([digits(2), word().lower()])}{at}{host}{dot.join(['', top])}"

    def make() -> tuple[str, int]:
        kind = int(rng.integers(0, 5))
        if kind == 0:
            return email(), 0
        if kind == 1:
            return pick([".", ".", ".", " . ", "[.]"]).join(str(x) for x in rng.integers(0, 256, 4)), 1
        if kind == 2:
            return card(), 2
        if kind == 3:
            lead = pick(["+1 ", "+1 ", "+49 ", "", "00 49 "])
            return lead + pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) 555-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), 3
        hexes = "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, 40))
        return pick([f'token = "{hexes}"', f'token = "{hexes}"', f"api_key: {hexes[:32]}", f'TOKEN = "{hexes.upper()}"']), 4

    def harmless() -> str:
        return pick([str(rng.integers(1900, 2030)), digits(int(rng.integers(1, 6))), f"{rng.integers(0, 10)}.{rng.integers(0, 10)}", f"{rng.integers(1, 100)}%", f"{digits(2)}/{digits(2)}/{digits(4)}", f"version {rng.integers(1, 9)}.0"])

    x, y = np.zeros((WINDOW, count), dtype=np.int64), np.zeros((WINDOW, count), dtype=np.int64)
    for n in range(count):
        text, tags = "", []
        while len(text) < 3 * WINDOW:
            kind = -1
            r = rng.random()
            piece, kind = make() if r < 0.10 else (harmless(), -1) if r < 0.18 else (word(), -1)
            gap = pick([" ", " ", " ", " ", ", ", ". ", "\n", "!! ", "### ", " | "])
            tags += ([0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)) + [0] * len(gap)
            text += piece + gap
        at = int(rng.integers(0, 2 * WINDOW))
        x[:, n] = char_classes(text)[at : at + WINDOW]
        y[:, n] = tags[at : at + WINDOW]
    return x, y


def train(count: int = TRAINED_ON, epochs: int = EPOCHS, seed: int = 42) -> Network:
    """A network fitted by Adam on ``count`` labelled windows."""
    x, y = labelled_windows(count, seed)
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    mean, square, turn = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    size = 48
    for epoch in range(epochs):
        order = rng.permutation(count)
        for low in range(0, count, size):
            rows = order[low : low + size]
            _, grads = net.learn(x[:, rows], y[:, rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            turn += 1
            rate = 0.02 * (0.55**epoch) + 0.001
            for k, g in grads.items():
                g = g * min(1.0, 10.0 / (norm + 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= (rate * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


# ---- whole texts ----


_SPELLED_AT = re.compile(r"\(at\)|\[at\]")


def _anchored(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an at sign or one spelled out; a span needs one of them, so none can begin and end in another window."""
    length = len(text)
    spelled = [m.start() for m in _SPELLED_AT.finditer(text)]
    if not length or not (spelled or "@" in text or _DIGIT.search(text)):
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    at = np.union1d(at, np.array(spelled, dtype=at.dtype))
    last = max(0, -(-(length - WINDOW) // STRIDE))
    high = np.minimum(at // STRIDE, last)
    low = np.maximum(0, -(-(at - WINDOW + 1) // STRIDE))
    low = np.minimum(low, last)
    return np.unique(np.concatenate([np.minimum(low + k, high) for k in range(-(-WINDOW // STRIDE) + 1)])).tolist()


def window_spans(net: Network, windows: list[tuple[int, int, np.ndarray, int]]) -> Iterator[tuple[int, int, int, int, float, bool]]:
    """``(text number, kind, start, end, score, whole)`` of windows ``(text number, start, classes, text length)``.

    Spans that touch an inner edge of their window are not whole, and given whatever their score.
    """
    for low in range(0, len(windows), AT_ONCE):
        part = windows[low : low + AT_ONCE]
        x = np.zeros((max(WINDOW, *(len(w[2]) for w in part)), len(part)), dtype=np.int64)
        for n, (_, _, classes, _) in enumerate(part):
            x[: len(classes), n] = classes
        tags, margin = net.decode(x)
        for n in np.flatnonzero((tags > 0).any(0)):
            row, start, classes, length = part[n]
            k, size = 0, len(classes)
            while k < size:
                tag = tags[k, n]
                if tag == 0:
                    k += 1
                    continue
                end = k + 1
                while end < size and tags[end, n] > 0 and TAGS[tags[end, n]] == f"I-{TAGS[tag][2:]}":
                    end += 1
                whole = (k > 0 or start == 0) and (end < size or start + size == length)
                score = float(margin[k:end, n].mean())
                if not whole or score >= LEAST_MARGIN:
                    yield row, (int(tag) - 1) // 2, start + k, start + end, score, whole
                k = end


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _meets(span: tuple[int, int], merged: list[tuple[int, int]]) -> bool:
    """Whether one of the merged ranges has a character of the span."""
    i = bisect.bisect_left(merged, (span[1], -1)) - 1
    return i >= 0 and merged[i][1] > span[0]


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Spans ``(kind, start, end)`` that do not overlap and have the largest sum of score by length, over a whole text.

    The same span from several windows counts once, with its mean score.
    """
    scores: dict[tuple[int, int, int], list[float]] = {}
    for kind, start, end, score in found:
        scores.setdefault((end, start, kind), []).append(score)
    spans = sorted(scores)
    ends = [s[0] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    back: list[int] = [0]
    for n, span in enumerate(spans):
        lo, hi = 0, n
        while lo < hi:  # the spans that end at or before this one's start
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= span[1] else (lo, mid)
        gain = best[lo][0] + (span[0] - span[1]) * sum(scores[span]) / len(scores[span])
        best.append((gain, n) if gain > best[n][0] else (best[n][0], -1))
        back.append(lo)
    out, n = [], len(spans)
    while n > 0:
        if best[n][1] >= 0:
            end, start, kind = spans[n - 1]
            out.append((kind, start, end))
            n = back[n]
        else:
            n -= 1
    return out[::-1]


def plausible(kind: int, piece: str) -> bool:
    """Whether a span's characters can be of its kind at all; every span needs a digit or an at sign, which may be spelled out."""
    digits = sum(c in "0123456789" for c in piece)
    if kind == 0:
        return bool(re.search(r"@|\(at\)|\[at\]", piece)) and not re.search(r"\n", piece)
    if kind == 1:
        return len(re.findall(r"[0-9]+", piece)) == 4 and all(int(p[-9:]) <= 255 for p in re.findall(r"[0-9]+", piece))
    if kind == 2:
        only = re.sub(r"[^0-9]", "", piece)
        return 13 <= digits <= 19 and luhn(only) and not re.search(r"[A-Za-z]", piece)
    if kind == 3:
        return 9 <= digits <= 15 and not re.search(r"[A-Za-z\n]", piece)
    return digits >= 4 and len(piece) >= 20 and bool(re.search(r"[A-Za-z0-9_/+-]{16,}", piece))


def find(texts: list[str], net: Network) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each whole text the base spans, and those that the network adds: none that overlaps a base span."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    windows: list[tuple[int, int, np.ndarray, int]] = []

    edges: list[list[tuple[int, int]]] = [[] for _ in texts]

    def flush() -> None:
        for row, kind, start, end, score, whole in window_spans(net, windows):
            if not whole:
                edges[row].append((start, end))
            elif plausible(kind, texts[row][start:end]):
                found[row].append((kind, start, end, score))
        windows.clear()

    for n, text in enumerate(texts):
        for k in _anchored(text):
            start = k * STRIDE
            windows.append((n, start, char_classes(text[start : start + WINDOW]), len(text)))
            if len(windows) >= 4 * AT_ONCE:
                flush()
    flush()

    # spans that touch an edge, and that no whole one holds: decoded again with more text around them, until they end inside
    reach = STRIDE
    while True:
        wider = []
        for n, cut in enumerate(edges):
            if cut:
                held = sorted((s, e) for _, s, e, _ in found[n])
                most = [0, *accumulate((e for _, e in held), max)]  # the largest end of the first spans
                own = _merged([c for c in cut if most[bisect.bisect_right(held, (c[0], len(texts[n])))] < c[1]])
                places = _merged([(max(0, s - reach), min(len(texts[n]), e + reach)) for s, e in own])
                wider += [(n, low, high, own) for low, high in places]
                edges[n] = []
        if not wider:
            break
        wider.sort(key=lambda w: w[2] - w[1])
        low = 0
        while low < len(wider):  # alike long ones together, so that little is filled up
            high = low + 1
            longest = wider[low][2] - wider[low][1] + STRIDE
            while high < len(wider) and high - low < AT_ONCE and wider[high][2] - wider[high][1] <= longest:
                high += 1
            part = wider[low:high]
            own = {w[0]: w[3] for w in part}
            again = [(n, s, char_classes(texts[n][s:e]), len(texts[n])) for n, s, e, _ in part]
            for row, kind, start, end, score, whole in window_spans(net, again):
                if not _meets((start, end), own[row]):
                    continue  # the first windows around it have it
                if not whole:
                    edges[row].append((start, end))
                elif plausible(kind, texts[row][start:end]):
                    found[row].append((kind, start, end, score))
            low = high
        reach *= 2
    out = []
    for own, more in zip(base, found, strict=True):
        taken = sorted((s, e) for _, s, e in own)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
        free = []
        for span in more:
            i = int(np.searchsorted(starts, span[2])) if taken else 0  # base spans that start before this one's end
            if not i or reach[i - 1] <= span[1]:
                free.append(span)
        out.append((own, reconcile(free)))
    return out


def pii_spans(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``(doc_id, base, added)`` for every row of ``docs(doc_id, text)``: arrays of ``struct<kind, start, end>`` over the whole text.

    Positions are code points, the end is exclusive. ``base`` has the patterns' spans; ``added`` those that the network finds beside
    them, at least one digit or at sign each (one spelled out, too). Null and empty texts have none. Repeated rows and null doc_ids come out as they are;
    extra columns are ignored; an empty table gives an empty result. Rows are independent: nothing is shuffled. Windows without
    any of them are not decoded, as no span can be in them alone; a span that no window holds whole is decoded with more text around it.
    """
    net = net or train()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for part in slices(batch, 1, 1_000_000, 500):
                got = find([t or "" for t in part.column(1).to_pylist()], net)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([named(b) for b, _ in got], span), pa.array([named(a) for _, a in got], span)], names=["doc_id", "base", "added"])

    kinds = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {kinds}, added {kinds}")


def digest(spans: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_spans, base_sha256, spans)`` of ``spans(doc_id, base, added)``; ``n_spans`` counts all."""
    order = lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))
    spelled = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, order)), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in KINDS[:4]], (F.size("base") + F.size("added")).cast("long").alias("n_spans"), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"))


__all__ = ["Network", "base_spans", "digest", "find", "pii_spans", "reconcile", "train"]
