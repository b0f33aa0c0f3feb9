"""Quality classification by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_sample, slices, unit_hash
from .grams import fit_logistic, gram_vector, sigmoid

#: Labelled and unlabelled rows that the two views are fitted on, whatever the table's size.
LABELLED, UNLABELLED = 2000, 2000
#: Rounds, and pseudo-labels that each view gives the other in one: so many of each class at most, none less sure than this.
ROUNDS, GIVEN, SURE = 5, 100, 0.97
DIMS, SHAPE, SOURCE_DIMS = 1 << 11, 16, 64
PAGE = 3 + 2 * SOURCE_DIMS
#: Documents of less than this probability of good quality are rejected.
THRESHOLD = 0.5


def text_view(text: str) -> np.ndarray:
    """What the text says: hashed byte n-grams, marks included, and the shape of its words and lines."""
    lines = text.split("\n")
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=128) if raw else np.zeros(128)
    upper, digits, spaces = counts[65:91].sum(), counts[48:58].sum(), counts[[9, 10, 13, 32]].sum()
    lower = counts[97:123].sum() + counts[128:].sum()
    marks = max(0, len(raw) - upper - lower - digits - spaces)
    pairs = len(set(zip(words, words[1:], strict=False)))
    shape = [
        np.log1p(len(text)) / 10, np.log1p(len(words)) / 8, np.log1p(len(lines)) / 5, min(3.0, len(words) / len(lines) / 50),
        upper / n, digits / n, marks / n, 10 * marks / n, min(3.0, n / m / 8), len(set(words)) / m, pairs / max(1, m - 1),
        len(set(lines)) / len(lines), 20 * counts[124] / n, 20 * (counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / n, 20 * counts[33] / n, float(len(words) < 5),
    ]
    return np.concatenate([gram_vector(text, DIMS, letters_only=False), np.array(shape, dtype=np.float32)])


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known about the page without its text: where it is from, its language, its recorded size."""
    out = np.zeros(PAGE, dtype=np.float32)
    if n_chars is not None and n_chars >= 0:
        out[:2] = np.log1p(n_chars) / 10, (np.log1p(n_chars) / 10 - 0.8) ** 2
    else:
        out[2] = 1.0
    out[3 + zlib.crc32(f"s{source}".encode("utf-8", "surrogatepass")) % SOURCE_DIMS] = 1.0
    out[3 + SOURCE_DIMS + zlib.crc32(f"l{lang}".encode("utf-8", "surrogatepass")) % SOURCE_DIMS] = 1.0
    return out


@dataclass(frozen=True)
class View:
    """A linear classifier, its features' scale, and the line that turns its margins into calibrated log-odds."""

    weights: np.ndarray
    bias: float
    centre: np.ndarray
    spread: np.ndarray
    slope: float
    shift: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margins(x) + self.shift


@dataclass(frozen=True)
class Model:
    """Both views and how much the calibrated log-odds of each count, as held-back labels show."""

    text: View
    page: View
    share: tuple[float, float, float]

    def probability(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.page.log_odds(page)
        return sigmoid(self.share[0] * a + self.share[1] * b + self.share[2]), sigmoid(a), sigmoid(b)


def _fit_view(x: np.ndarray, y: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """``scaled`` tells which features are centred and divided by their spread."""
    centre = np.where(scaled, x.mean(0), 0).astype(np.float32)
    spread = np.where(scaled, np.maximum(x.std(0), 0.05), 1).astype(np.float32)
    each = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y > 0, 1.0 / max(1, each[1]), 1.0 / max(1, each[0]))  # both classes count alike
    w, b = fit_logistic((x - centre) / spread, y, weight, l2=1e-4, turns=200, rate=0.2)
    return w[:, 0], float(b[0]), centre, spread


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's line through held-back margins; the slope stays positive."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = max(float(np.abs(margin).mean()), 1e-6)
    w, b = fit_logistic((margin / scale)[:, None], y, l2=1e-2, turns=300, rate=0.1)
    return max(float(w[0, 0]) / scale, 1e-3), float(b[0])


def _combine(odds: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """How much two views' calibrated log-odds count together: a logistic regression that starts from their mean; none counts against itself."""
    if len(set(y.tolist())) < 2:
        return 0.5, 0.5, 0.0
    scale = np.maximum(np.abs(odds).mean(0), 1e-6)
    w, b = fit_logistic(odds / scale, y, l2=1e-3, turns=300, rate=0.1)
    w = np.maximum(w[:, 0], 0.0) / scale
    return (float(w[0]), float(w[1]), float(b[0])) if w.sum() > 0 else (0.5, 0.5, 0.0)


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, more_text: np.ndarray, more_page: np.ndarray, rounds: int = ROUNDS, given: int = GIVEN) -> Model | None:
    """Two views that teach each other.

    A fifth of the labelled rows is held back for calibration. In each round both views are fitted on the labels and on what the
    other one gave them; each then gives the other its surest pseudo-labels of each class among rows not yet given. None if the
    labels are of one class only.
    """
    if len(set(y.tolist())) < 2:
        return None
    back = np.random.default_rng(42).random(len(y)) < 0.2
    for value in (0, 1):
        own = np.flatnonzero(y == value)
        if back[own].all() or (len(own) > 1 and not back[own].any()):
            back[own] = np.arange(len(own)) % 5 == 0
            back[own[0]] = len(own) > 1
            back[own[-1]] = False
    held = np.flatnonzero(~back)
    shape = np.arange(text.shape[1]) >= DIMS
    views = {"text": (text, more_text, shape), "page": (page, more_page, np.zeros(page.shape[1], dtype=bool))}
    taught = {name: (np.zeros(0, dtype=int), np.zeros(0, dtype=np.float32)) for name in views}
    fitted: dict[str, View] = {}
    for turn in range(rounds + 1):
        for name, (x, more, scaled) in views.items():
            rows, labels = taught[name]
            w, b, centre, spread = _fit_view(np.concatenate([x[held], more[rows]]), np.concatenate([y[held], labels]), scaled)
            plain = View(w, b, centre, spread, 1.0, 0.0)
            slope, shift = _calibrate(plain.margins(x[back]), y[back])
            fitted[name] = View(w, b, centre, spread, slope, shift)
        if turn == rounds or not len(more_text):
            break
        for name, other in (("text", "page"), ("page", "text")):
            p = sigmoid(fitted[name].log_odds(views[name][1]))
            rows, labels = taught[other]
            free = np.ones(len(p), dtype=bool)
            free[rows] = False
            for value, sure in ((1, p), (0, 1 - p)):
                pick = np.flatnonzero(free & (sure >= SURE))
                pick = pick[np.argsort(-sure[pick], kind="stable")][:given]
                rows, labels = np.concatenate([rows, pick]), np.concatenate([labels, np.full(len(pick), value, dtype=np.float32)])
            taught[other] = (rows, labels)
    odds = np.stack([fitted[name].log_odds(x[back]) for name, (x, _, _) in views.items()], axis=1)
    return Model(fitted["text"], fitted["page"], _combine(odds, y[back]))


FIELDS = ("text", "lang", "source", "n_chars")


def _views(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of FIELDS."""
    if not rows:
        return np.zeros((0, DIMS + SHAPE), dtype=np.float32), np.zeros((0, PAGE), dtype=np.float32)
    return np.stack([text_view(r[0] or "") for r in rows]), np.stack([page_view(*r[1:]) for r in rows])


def _fields(docs: DataFrame) -> list[Column]:
    """FIELDS, each as the type that the views expect; ``n_chars`` is missing where ``docs`` have no such column."""
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return [*(F.col(c).cast("string").alias(c) for c in FIELDS[:3]), size.cast("long").alias("n_chars")]


def _vectors(rows: DataFrame) -> list:
    """``(id, y, views)`` of rows ``(id, y, *FIELDS)``: the driver gets vectors of one size, not texts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches(source) for part in slices(whole, 2, _TEXT_AT_ONCE, _ROWS_AT_ONCE)):
            text, page = _views(list(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)))
            both = np.concatenate([text, page], axis=1).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in both], pa.binary())], names=["id", "y", "views"])

    return rows.mapInArrow(run, "id long, y int, views binary").collect()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model | None:
    """A model of ``docs(doc_id, text, lang, source, n_chars)`` and ``labels(doc_id, quality)``.

    It is fitted on at most ``labelled`` labelled rows and ``unlabelled`` others, the first in the order of a hash of doc_id. Labels
    that contradict each other, null ones and labels of other documents are not used.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    one = one.where("least = most").select(F.col("doc_id").alias("__id"), F.col("least").cast("int").alias("__y"))
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), *_fields(docs))
    # labels first, so that no more texts are read out than are learnt from
    drawn = hash_sample(one, "__id", 42, 2 * labelled)
    known = own.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).orderBy(unit_hash("__doc", 42), "__doc").limit(labelled)
    rows = _vectors(known.select("__doc", "__y", *FIELDS))
    taken = {r["id"] for r in rows}
    more = [r for r in _vectors(hash_sample(own, "__doc", 43, unlabelled).select("__doc", F.lit(0), *FIELDS)) if r["id"] not in taken]
    x, more_x = (np.frombuffer(b"".join(r["views"] for r in part), dtype="<f4").reshape(-1, DIMS + SHAPE + PAGE) for part in (rows, more))
    at = DIMS + SHAPE
    return co_train(x[:, :at], x[:, at:], np.array([r["y"] for r in rows], dtype=np.float32), more_x[:, :at], more_x[:, at:])


_TEXT_AT_ONCE, _ROWS_AT_ONCE = 2_000_000, 256


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``__quality`` (probability of good quality), ``__text_score`` and ``__page_score``, of every whole text.

    Without a model (no labels of both classes) every score is 1: nothing is known against a document.
    """
    names = docs.columns
    given = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(f"__field_{name}") for c, name in zip(_fields(docs), FIELDS, strict=True)])
    text_at = names.index("text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches(source) for part in slices(whole, text_at, _TEXT_AT_ONCE, _ROWS_AT_ONCE)):
            if model is None:
                found = [np.ones(batch.num_rows)] * 3
            else:
                found = model.probability(*_views(list(zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(np.asarray(x, dtype=np.float64)) for x in found)], names=[*names, "__quality", "__text_score", "__page_score"])

    schema = docs.select(*names).schema
    for name in ("__quality", "__text_score", "__page_score"):
        schema = schema.add(name, "double")
    return given.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with its scores, see ``score``, by a model of ``fit``.

    Null texts count as empty ones, null languages and sources as one more value; repeated rows and null doc_ids come out as they
    are; extra columns pass through; an empty table gives an empty result.
    """
    return score(docs, fit(docs, labels))
