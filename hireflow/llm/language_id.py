"""Hierarchical language identification with linear support vector machines.

A text is the square roots of its relative byte n-gram frequencies (hashed into
``DIMENSIONS`` numbers, so its length is 1 whatever the text's length). One-versus-one
machines first tell language families apart; inside the family that wins,
one-versus-one machines separate its languages.

The machines are fitted on a bounded sample of labelled rows: at most
``max_sample`` rows, evenly by language, picked by a hash of the identifier. Every
row's text is read whole, in the sample and in prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import LOWER, Texts, slices

DIMENSIONS = 1 << 12
#: Which languages belong together; any other language is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
            "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
            "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl")}
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def features(texts: Texts) -> np.ndarray:
    """One row per document: roots of the relative frequencies of its byte 2-, 3- and 4-grams."""
    data = LOWER[texts.data].astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), texts.ends - texts.starts)
    total = np.zeros(len(texts) * DIMENSIONS)
    gram = data.copy()
    for size in (2, 3, 4):
        gram = gram[:-1] * np.uint32(257) + data[size - 1:] if len(data) >= size else gram[:0]
        whole = doc[:len(gram)] == doc[size - 1:] if len(gram) else np.zeros(0, bool)
        h = gram[whole] * np.uint32(2654435761)
        at = (h ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - 12)
        total += np.bincount(doc[:len(gram)][whole] * DIMENSIONS + at.astype(np.int64), minlength=len(total))
    out = total.reshape(len(texts), DIMENSIONS)
    return np.sqrt(out / np.maximum(1, out.sum(axis=1, keepdims=True)))


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear machine: squared hinge loss, accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    ahead, t = w.copy(), 1.0
    scale = cost / len(x)
    top = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        top = x.T @ (x @ (top / np.linalg.norm(top)))
    step = float(1.0 / (1.0 + 2.2 * scale * np.linalg.norm(top)))
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead - 2 * scale * (x.T @ (y * slack)))
        t, before = float((1 + np.sqrt(1 + 4 * t * t)) / 2), t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


class OneVersusOne:
    """One machine per pair of classes; most votes win, then the larger sum of margins."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        at = np.array([self.classes.index(c) for c in labels])
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.array([
            _machine(x[(at == a) | (at == b)], np.where(at[(at == a) | (at == b)] == a, 1.0, -1.0))
            for a, b in self.pairs]).reshape(len(self.pairs), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and score of each row: the mean logistic margin of the winner's machines."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums, chance = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for j, (a, b) in enumerate(self.pairs):
            m = np.clip(margin[:, j], -30, 30)
            p = 1 / (1 + np.exp(-3 * m))
            for c, v, s in ((a, m >= 0, p), (b, m < 0, 1 - p)):
                votes[:, c] += v
                sums[:, c] += m if c == a else -m
                chance[:, c] += s / (k - 1)
        best = np.argmax(votes + 1e-6 * np.tanh(sums / k), axis=1)
        return best, chance[np.arange(n), best]


class Hierarchy:
    """Families first, then the languages of the winning family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family(c) for c in langs]
        self.top = OneVersusOne(x, families)
        self.inside = {f: OneVersusOne(x[[g == f for g in families]],
                                       [c for c, g in zip(langs, families, strict=True) if g == f])
                       for f in self.top.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, score = self.top.predict(x)
        langs = np.empty(len(x), object)
        for i, f in enumerate(self.top.classes):
            mine = np.flatnonzero(which == i)
            if len(mine):
                best, chance = self.inside[f].predict(x[mine])
                langs[mine] = [self.inside[f].classes[b] for b in best]
                score[mine] *= chance
        return langs.tolist(), score


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column("text"), rows=64):
            x = features(texts).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(first, len(texts)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["lang", "x"])


def _predict(hierarchy: Hierarchy | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text"), rows=64):
                lettered = batch.column("lettered").slice(first, len(texts)).to_numpy(zero_copy_only=False)
                langs, score = ([UNKNOWN] * len(texts), np.zeros(len(texts))) if hierarchy is None else \
                    hierarchy.predict(features(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(texts)),
                     pa.array([c if ok else UNKNOWN for c, ok in zip(langs, lettered, strict=True)]),
                     pa.array(np.where(lettered, score, 0.0))], ["row", "lang_pred", "score"])
    return run


def fit(labelled: DataFrame, max_sample: int = 1200) -> Hierarchy | None:
    """A hierarchy from a table (doc_id, text, lang); None if it has no usable row.

    The sample is at most ``max_sample`` rows of DIMENSIONS numbers: its size on the
    driver has that bound.
    """
    usable = labelled.filter("lang is not null").filter(has_letter(F.col("text")))
    languages = usable.select("lang").distinct().count()
    if not languages:
        return None
    each = max(1, max_sample // languages)
    usable = usable.withColumn("order", F.xxhash64("doc_id", "text"))
    by_lang = Window.partitionBy("lang").orderBy("order")
    first = lambda d: d.withColumn("turn", F.row_number().over(by_lang)).filter(F.col("turn") <= each)
    # The last hash that each language's sample takes, from hashes alone; the texts are then
    # picked where they are read. One row per language.
    last = first(usable.select("lang", "order")).groupBy(F.col("lang").alias("of")).agg(F.max("order").alias("last"))
    picked = usable.join(F.broadcast(last) if languages <= max_sample else last,
                         (F.col("lang") == F.col("of")) & (F.col("order") <= F.col("last")))
    rows = (first(picked).select("lang", "text")
            .mapInArrow(_sample_features, "lang string, x binary").collect())
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows])
    return Hierarchy(x, [r.lang for r in rows])


def is_held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, max_sample: int = 1200, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, row (a struct of the input columns).

    Learns from text and non-null lang of the rows that are not held out (those whose
    crc32 of the identifier as text is 2 modulo 4 are; a null identifier is neither
    held out nor learned from). lang_pred is a learned language, or ``und`` with score
    0 where the text is null or has no letter, or where there is nothing to learn from.
    Repeated rows each get their row; an empty table gives an empty result.
    """
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    learn = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(learn.filter(F.col("doc_id").isNotNull() & ~is_held_out("doc_id")), max_sample)
    text = F.col(f"row.{text_col}")
    out = named.select("row", text.alias("text"), has_letter(text).alias("lettered")).mapInArrow(
        _predict(model), f"row {named.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col(f"row.{id_col}").alias("doc_id"), is_held_out(f"row.{id_col}").alias("held_out"),
                      "lang_pred", "score", "row")
