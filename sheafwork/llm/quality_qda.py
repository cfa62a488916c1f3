"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics (shares of byte classes, word and line shapes, repetition), transformed to be
roughly normal. The labelled vectors' counts, sums and cross products are summed in the tasks; the driver gets those
moments only, shrinks each class covariance towards the pooled one and its diagonal, and keeps the Cholesky factors.
A score is the logistic of the Mahalanobis log-density difference plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import Words, pieces, text_buffers, written

POOLED, DIAGONAL, FLOOR, THRESHOLD = 0.05, 0.02, 1e-3, 0.7
#: Byte classes, by first match: lower, upper, digit, beyond ASCII, blank, line end, sentence marks, each odd mark.
MARKS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", None, " \t", "\n", ".,;:?'\"-()",
         "|", "!", "#", "$", "%", "&", "*"]
NAMES = ["lower", "upper", "digit", "wide", "blank", "line", "stop", "bar", "bang", "hash", "dollar", "percent", "amp", "star",
         "other"]


def _classes() -> np.ndarray:
    table = np.full(256, len(MARKS), np.uint8)
    table[128:] = 3
    for i, marks in enumerate(MARKS):
        for c in marks or "":
            table[ord(c)] = i
    return table


CLASS_OF = _classes()
FEATURES = [*NAMES, "log_bytes", "log_words", "word_length", "word_spread", "distinct", "repeat_next", "repeat_gap",
            "top_word", "log_line", "short_lines", "upper_words", "mark_words"]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges first[i]..first[i+1]."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x FEATURES; a text without bytes gives the vector of an empty text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kind = CLASS_OF[data]
    text = np.repeat(np.arange(n) * (len(MARKS) + 1), size)
    counts = np.bincount(text + kind, minlength=n * (len(MARKS) + 1)).reshape(n, -1)[:, :len(MARKS) + 1]
    w = Words(data, offsets)
    words = w.counts()
    length = (w.ends - w.starts).astype(np.float64)
    some = np.maximum(words, 1)
    mean = per_text(length, w.first) / some
    spread = np.sqrt(np.maximum(per_text(length ** 2, w.first) / some - mean ** 2, 0))
    owner = np.repeat(np.arange(n), words)

    def same(gap: int) -> np.ndarray:
        flag = np.zeros(len(w.hashes))
        flag[gap:] = (w.hashes[gap:] == w.hashes[:-gap]) & (owner[gap:] == owner[:-gap])
        return per_text(flag, w.first) / some

    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    lead = np.ones(len(h), bool)
    lead[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    heads = np.flatnonzero(lead)
    runs = np.diff(np.append(heads, len(h)))
    distinct = np.bincount(o[heads], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, o[heads], runs)
    # words wholly in upper case, and words that run into an odd mark
    up = np.concatenate([[0], np.cumsum(kind == 1)])
    whole_up = (up[w.ends] - up[w.starts] == w.ends - w.starts) & (length > 1)
    after = np.append(kind, 4)[w.ends]
    ends_odd = after >= 7
    breaks = np.flatnonzero(data == 10)
    lines = counts[:, 5] + 1
    edges = np.unique(np.concatenate([offsets[:-1], breaks + 1, offsets[1:]]))
    line_text = np.searchsorted(offsets, edges[:-1], "right") - 1
    short = np.bincount(line_text, weights=np.diff(edges) < 30, minlength=n)[:n] / lines
    shares = counts / (size + 40.0)[:, None]
    columns = [np.log(shares + 1e-3) - np.log(1e-3), np.log1p(size)[:, None], np.log1p(words)[:, None], np.log1p(mean)[:, None],
               spread[:, None] / 4, (distinct / some)[:, None], np.log(same(1) + 1e-2)[:, None],
               np.log(np.maximum(same(2), same(3)) + 1e-2)[:, None], np.log(top / some + 1e-2)[:, None],
               np.log1p(size / lines)[:, None], short[:, None], np.log(per_text(whole_up, w.first) / some + 1e-2)[:, None],
               np.log(per_text(ends_odd, w.first) / some + 1e-2)[:, None]]
    return np.concatenate(columns, axis=1)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=1 << 19):
        x = statistics(*text_buffers(batch.column("text")))
        d = x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d, pa.int32()), pa.array(x.ravel()))],
            names=["doc_id", "x"])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cross products of (1, x) for each class, as (good, i, j, value)."""
    total: dict[bool, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.concatenate([np.ones((batch.num_rows, 1)), matrix(batch.column("x"))], axis=1)
        good = np.array(batch.column("good").to_pylist())
        for c in (False, True):
            if (good == c).any():
                total[c] = total.get(c, 0) + x[good == c].T @ x[good == c]
    for c, m in total.items():
        i, j = np.triu_indices(len(m))
        yield pa.RecordBatch.from_pydict({"good": pa.array([c] * len(i)), "i": pa.array(i, pa.int32()),
                                          "j": pa.array(j, pa.int32()), "value": pa.array(m[i, j])})


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log prior odds; ``means`` is empty if a class has under two rows, and all scores are equal."""

    odds: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        delta = np.full(len(x), self.odds)
        for sign, mean, factor in zip((-1.0, 1.0), self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            delta += sign * (-0.5 * (z ** 2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(delta, -50, 50)))


def fit(measured: DataFrame, labels: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """``labels``: doc_id, quality. Several labels of a doc_id are averaged, nulls left out. All labelled rows count."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).alias("good"))
    known = measured.join(truth, "doc_id").select("good", "x").mapInArrow(moments, "good boolean, i int, j int, value double")
    d = len(FEATURES) + 1
    sums = {c: np.zeros((d, d)) for c in (False, True)}
    for r in known.groupBy("good", "i", "j").agg(F.sum("value").alias("value")).collect():  # two matrices of fixed size
        sums[r.good][r.i, r.j] = sums[r.good][r.j, r.i] = r.value
    n0, n1 = sums[False][0, 0], sums[True][0, 0]
    odds = float(np.log((n1 + 1) / (n0 + 1)))
    if n0 < 2:
        return Discriminant(50.0)  # nothing is known to be bad
    if n1 < 2:
        return Discriminant(odds)
    means = tuple(sums[c][0, 1:] / sums[c][0, 0] for c in (False, True))
    covs = [sums[c][1:, 1:] / sums[c][0, 0] - np.outer(m, m) for c, m in zip((False, True), means)]
    both = (covs[0] * n0 + covs[1] * n1) / (n0 + n1)
    factors = []
    for cov in covs:
        s = (1 - pooled) * cov + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + FLOOR * np.eye(len(s))
        factors.append(np.linalg.cholesky(s))
    return Discriminant(odds, means, tuple(factors))


def score_documents(docs: DataFrame, labels: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only labels of documents whose crc32(doc_id as text) mod 4 is not 2 are learned; the others are held out. Nothing but
    the text enters a score. Null and empty texts are scored as empty ones; a row without doc_id is scored and not held
    out. With fewer than two labelled documents of class 0 every score is 1, with fewer of class 1 the prior share. Repeated rows are scored each;
    further columns are not read.
    """
    measured = written(docs.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, x array<double>"), "statistics")
    held = "coalesce(crc32(CAST(doc_id AS STRING)) % 4 = 2, false)"
    model = fit(measured, labels.select("doc_id", "quality").where(f"NOT {held}"), pooled, diagonal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(model.score(matrix(batch.column("x"))))], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.expr(held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
