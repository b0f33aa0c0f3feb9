"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, slices, unit_hash
from .grams import fit_logistic, gram_vector, sigmoid

#: Labelled rows that are learnt from, for each language and in all; hashed grams.
SAMPLE_A_LANGUAGE, SAMPLE, DIMS = 300, 3000, 1 << 13
#: Languages whose losses are closer than this are told apart too weakly: the row is flagged.
AMBIGUOUS = 0.1
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def codewords(classes: int, seed: int = 42) -> np.ndarray:
    """A row of -1 and 1 for each class: all splits of the classes up to seven of them, else random ones kept far apart."""
    if classes == 1:
        return np.ones((1, 1))
    if classes <= 7:
        bits = [[1 if (split >> k) & 1 else -1 for k in range(classes)] for split in range(1, 1 << (classes - 1))]
        return np.array(bits, dtype=np.float64).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(200):
        code = np.where(rng.random((classes, length)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(0)) < classes]  # a bit that is the same for all tells nothing
        distance = ((code[:, None] != code[None]).sum(2) + np.eye(classes) * length).min() if code.shape[1] else 0
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    #: How much each bit's loss counts: its classifier's accuracy on held-back rows.
    trust: np.ndarray


def train(x: np.ndarray, languages: list[str], seed: int = 42) -> Model | None:
    """One binary classifier for each bit of the codewords, of n-gram vectors ``x`` and their languages; None without any."""
    if not languages:
        return None
    names = sorted(set(languages))
    label = np.array([names.index(lang) for lang in languages])
    code = codewords(len(names), seed)
    y = (code[label] > 0).astype(np.float32)
    per_class = np.bincount(label, minlength=len(names))
    weight = 1.0 / per_class[label]
    back = np.random.default_rng(seed).random(len(x)) < 0.2
    if back.all() or not back.any():
        back = np.arange(len(x)) % 5 == 0
    fitted = ~back if (~back).any() else back
    w, b = fit_logistic(x[fitted], y[fitted], weight[fitted])
    right = ((x[back] @ w + b > 0) == (y[back] > 0)).mean(0)
    trust = np.maximum(right - 0.5, 0.05)
    w, b = fit_logistic(x, y, weight)
    return Model(names, code, w, b, trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of least loss, its share among the classes and whether the next is close.

    A codeword's loss is the sum over bits of the logistic loss of the bit's margin, weighted by how far the bit is to be trusted.
    """
    loss = (np.log1p(np.exp(-np.clip(model.code[None] * margins[:, None, :], -30, 30))) * model.trust).sum(2) * model.code.shape[1]
    order = np.sort(loss, axis=1)
    share = np.exp(-(loss - order[:, :1]))
    score = 1.0 / share.sum(1)
    close = order[:, 1] - order[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), dtype=bool)
    return loss.argmin(1), score, close


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, a_language: int = SAMPLE_A_LANGUAGE, sample: int = SAMPLE, dims: int = DIMS) -> Model | None:
    """A model of the rows of ``docs(doc_id, text, lang)`` that are not held out and have a language.

    It is fitted on at most ``a_language`` rows a language and ``sample`` rows in all, the first in the order of a hash of doc_id.
    """
    known = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # a row for each language, ``sample`` of them at most; then about four times the rows wanted get as far as the ranking
    shares = known.groupBy("lang").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "lang").limit(sample).select(F.col("lang").alias("__lang"), (4 * a_language / F.col("__n")).alias("__share"))
    at = unit_hash("doc_id", 42)
    few = known.select("doc_id", "text", "lang").join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(at < F.col("__share"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(at, "doc_id"))
    drawn = few.withColumn("n", order).where(F.col("n") <= a_language)
    chosen = drawn.orderBy("n", "lang").limit(sample).select("text", "lang")

    def grams(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for i, text in enumerate(batch.column(0)):
                v = gram_vector(text.as_py(), dims)
                used = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([used.astype("<u2").tobytes()]), pa.array([v[used].astype("<f4").tobytes()]), batch.column(1).slice(i, 1)], names=["used", "v", "lang"])

    # the driver gets vectors of a bounded size, not texts
    rows = chosen.mapInArrow(grams, "used binary, v binary, lang string").collect()
    x = np.zeros((len(rows), dims), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["used"], dtype="<u2")] = np.frombuffer(r["v"], dtype="<f4")
    return train(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row of ``docs(doc_id, text)``, from its whole text alone."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches(source) for part in slices(whole, 1, 4_000_000, 2000)):
            names, scores, flags = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            rows, margins = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if model is not None and text and _LETTER.search(text):
                    rows.append(i)
                    margins.append(gram_vector(text, len(model.weights)) @ model.weights + model.biases)
            if rows:
                label, score, close = decode(model, np.stack(margins).astype(np.float64))
                for i, k in zip(rows, label, strict=True):
                    names[i] = model.languages[k]
                scores[rows], flags[rows] = score, close
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(flags)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for every row of ``docs(doc_id, text, lang)``.

    Rows whose crc32 of doc_id as text is a multiple of 5 are held out of the training. Null texts and texts without a letter are
    ``und`` with score 0, as are all texts where no row has a language. Rows without doc_id are not held out. Repeated rows come
    out as they are; extra columns are ignored; an empty table gives an empty result. Nothing is shuffled but the sample.
    """
    return predict(docs, fit(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", F.col("score").cast("double").alias("score"), "ambiguous")


__all__ = ["Model", "codewords", "decode", "fit", "language_id", "predict", "sigmoid", "train"]
