"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled texts of quality 1; every text of the corpus is unlabelled web text; the
share of good text in it (the class prior) is estimated. With a squared loss the non-negative unbiased
risk

    R(w) = prior * E_pos[l(w x, +1)] + max(0, E_all[l(w x, -1)] - prior * E_pos[l(w x, -1)])

depends on the data through the first and second moments of the features only, which one scan over all
documents sums exactly; the risk is then minimised on the driver on matrices of fixed size. Nothing is
sampled. While the bracket is negative its gradient is reversed, as non-negative learning does, so the
fit cannot profit from driving the unlabelled risk below zero. The classifier's value estimates
2 P(good | text) - 1, hence score = clip((value + 1) / 2, 0, 1).

The prior is estimated from positives and unlabelled texts alone (best-bin estimation): a linear score is
fitted to tell half the positives from all texts; of the texts above a threshold at least as large a
share of all as of the other half's positives, times the prior, is good, so the least ratio of the two
shares over all thresholds, each widened by its sampling error, bounds the prior and meets it where some threshold leaves next
to nothing but good texts above it. It needs no negative label and no random choice of what is labelled
among the good. A caller who knows the prior passes a number.

Features (of the text alone, none of them of the row): shares and means of character and word classes,
cut into fixed bins and one-hot encoded, so that a linear function can bend, and the content: the square roots
of the shares of words in WORDS hashed groups. Defined results: a null or empty text has the features of
the empty text and gets a score; texts of any length are read whole; of equal scores none goes first; rows without a label, or whose label is
null, are unlabelled; repeated rows count as often as they occur; an id with several labels is a
positive if one of them is 1. Without any positive the score is the prior, 0.5 if that is unknown as
well. Empty tables give empty results; columns named like the result's are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import crc_mod, cut, table

#: Upper edges of the bins of each feature.
_SHARE = (0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95)
EDGES: dict[str, tuple[float, ...]] = {
    "words": (0.5, 5, 15, 30, 60, 120, 250, 500, 1000, 2500),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 10, 14),
    "upper": _SHARE,
    "digit": _SHARE,
    "stop": _SHARE,
    "symbol": _SHARE,
    "bang": _SHARE,
    "short": _SHARE,
    "long": _SHARE,
    "marked": _SHARE,
    "line_words": (2, 4, 8, 12, 18, 25, 35, 50, 80, 150),
    "repeat": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
}
WORDS = 64
ONE_HOT = 1 + sum(len(e) + 1 for e in EDGES.values())
WIDTH = ONE_HOT + WORDS

_UPPER = tk.byte_table(lambda b: 65 <= b <= 90)
_DIGIT = tk.byte_table(lambda b: 48 <= b <= 57)
_STOP = tk.byte_table(lambda b: chr(b) in ".,;")
_SYMBOL = tk.byte_table(lambda b: chr(b) in "#$%&*@^~|<>{}[]\\/_=+")
_BANG = tk.byte_table(lambda b: chr(b) in "!?")
_LETTER = tk.byte_table(lambda b: b >= 128 or chr(b).isalpha())
_BREAK = tk.byte_table(lambda b: b == 10)


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features' values, a row for each text of the chunk, and the square roots of the word groups' shares in 255ths."""
    n = len(offsets) - 1

    def count(table_: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table_[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    starts, ends, bounds = tk.runs(data, offsets, tk.NON_SPACE)
    words = np.diff(bounds).astype(np.float64)
    some, size = np.maximum(words, 1), ends - starts
    row = np.repeat(np.arange(n), np.diff(bounds))

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) / some

    letters = np.maximum(count(_LETTER), 1)
    filled = np.maximum(np.bincount(row, weights=size, minlength=n), 1)
    inside = np.concatenate([[0], np.cumsum(_SYMBOL[data] | _BANG[data])])
    key = np.stack([row.astype(np.uint64), tk.run_hashes(tk.FOLD[data], starts, ends)])
    group = (key[1] >> np.uint64(58)).astype(np.int64)
    content = np.sqrt(np.bincount(row * WORDS + group, minlength=n * WORDS).reshape(n, WORDS) / some[:, None])
    order = np.lexsort(key[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any(key[:, order[1:]] != key[:, order[:-1]], axis=0)
    distinct = np.bincount(row[order[fresh]], minlength=n)
    columns = {
        "words": words,
        "word_length": filled / some,
        "upper": count(_UPPER) / letters,
        "digit": count(_DIGIT) / filled,
        "stop": count(_STOP) / filled,
        "symbol": count(_SYMBOL) / filled,
        "bang": count(_BANG) / filled,
        "short": of_words(size <= 3),
        "long": of_words(size >= 12),
        "marked": of_words(inside[ends] > inside[starts]),
        "line_words": words / (1 + count(_BREAK)),
        "repeat": 1 - distinct / some * (words > 0),
    }
    return np.stack([columns[name] for name in EDGES], axis=1), np.rint(content * 255).astype(np.uint8)


def one_hot(values: np.ndarray) -> np.ndarray:
    """Bins of the values as positions in the weight vector, a column for each feature; 0 is the constant."""
    out, first = np.zeros((len(values), 1 + len(EDGES)), dtype=np.int64), 1
    for k, edges in enumerate(EDGES.values()):
        out[:, k + 1] = first + np.searchsorted(edges, values[:, k], side="right")
        first += len(edges) + 1
    return out


def described(column: pa.Array) -> np.ndarray:
    """The features of the column's texts: bytes, the positions of one_hot as 16-bit integers and the word groups."""
    out = []
    for _, _, data, offsets in tk.chunks(column):
        values, content = measures(data, offsets)
        out.append(np.concatenate([one_hot(values).astype("<u2").view(np.uint8).reshape(len(content), -1), content], axis=1))
    return np.concatenate(out) if out else np.zeros((0, BYTES), np.uint8)


BYTES = 2 * (1 + len(EDGES)) + WORDS


def features(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and bins: described(), 90 bytes a text."""
    keep = [c for c in keep if c != "bins"]
    inputs = docs.select(*dict.fromkeys([*keep, text_col]))
    at = inputs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(list(map(bytes, described(batch.column(at)))), pa.binary())], names=[*keep, "bins"])

    return inputs.mapInArrow(scan, inputs.select(*keep).schema.add("bins", "binary"))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BYTES)


def _parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ones, and the word groups' values."""
    n = 2 * (1 + len(EDGES))
    return np.ascontiguousarray(rows[:, :n]).view("<u2").astype(np.int64), rows[:, n:].astype(np.float32) / np.float32(255)


def values(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weights . x for each row."""
    bins, content = _parts(rows)
    return weights[bins].sum(axis=1) + content @ weights[ONE_HOT:]


def moments(rows: DataFrame) -> np.ndarray:
    """Of rows(bins, half): second moments of the features (sums; the constant's row holds the first
    moments and the counts) of all rows, of the positives of half 0 and of those of half 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        sums = np.zeros((3, WIDTH, WIDTH))
        for batch in batches:
            here = _rows(batch.column(0))
            half = np.array([-1 if v is None else v for v in batch.column(1).to_pylist()], dtype=np.int64)
            for k, mine in enumerate((here, here[half == 0], here[half == 1])):
                for lo in range(0, len(mine), 4096):
                    bins, content = _parts(mine[lo : lo + 4096])
                    x = np.zeros((len(bins), WIDTH), dtype=np.float32)
                    np.put_along_axis(x, bins, 1, axis=1)
                    x[:, ONE_HOT:] = content
                    sums[k] += x.T @ x
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(at), pa.array(flat[at])], names=["k", "v"])

    flat = np.zeros(3 * WIDTH * WIDTH)
    got = rows.select("bins", "half").mapInArrow(scan, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # 3 * WIDTH ** 2 rows at most
    flat[np.asarray(got.column("k"))] = np.asarray(got.column("v"))
    return flat.reshape(3, WIDTH, WIDTH)


_CELLS = 2000


def ridge(positives: float) -> np.ndarray:
    """The penalty on squared weights. That on the word groups' falls with the positives: few of them can't bear so many."""
    out = np.full(WIDTH, 1e-3)
    out[ONE_HOT:] = max(1e-3, 10 / max(1.0, positives))
    return out


def estimate_prior(rows: DataFrame, every: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among rows(bins, half): positive are the moments of those of half 0, by which
    the score is fitted; the positives of half 1 measure it."""
    a, p = every / max(1.0, every[0, 0]), positive / max(1.0, positive[0, 0])
    w = np.linalg.solve(a + p + np.diag(ridge(positive[0, 0])), p[0])  # 1 for positives, 0 for all, in least squares

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        count = np.zeros((2, _CELLS), dtype=np.int64)
        for batch in batches:
            cell = np.clip((values(_rows(batch.column(0)), w) + 1) * (_CELLS / 3), 0, _CELLS - 1).astype(np.int64)
            mine = np.array([v == 1 for v in batch.column(1).to_pylist()], dtype=bool)
            count += np.stack([np.bincount(cell, minlength=_CELLS), np.bincount(cell[mine], minlength=_CELLS)])
        at = np.flatnonzero(count[0])
        yield pa.record_batch([pa.array(at), pa.array(count[0][at]), pa.array(count[1][at])], names=["cell", "n", "p"])

    count = np.zeros((2, _CELLS))
    for r in rows.select("bins", "half").mapInArrow(scan, "cell long, n long, p long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect():  # _CELLS rows at most
        count[:, r.cell] = r.n, r.p
    n, m = count.sum(axis=1)
    if not m:
        return 0.5
    above = np.cumsum(count[:, ::-1], axis=1)
    share, hit = above[0] / n, above[1] / m
    some = hit > 0
    slack = 1.01 * (np.sqrt(np.log(40) / (2 * n)) + np.sqrt(np.log(40) / (2 * m)))
    best = np.argmin((share[some] + slack) / hit[some])
    return float(np.clip(share[some][best] / hit[some][best], 0.001, 0.999))


def fit(every: np.ndarray, positive: np.ndarray, prior: float, *, tolerance: float = 1e-7, most: int = 4000, rate: float = 0.5) -> np.ndarray:
    """Weights of least non-negative risk by gradient descent on the moments, until no weight moves by more
    than tolerance in a step (or, where the bracket's sign keeps turning, `most` steps)."""
    a, p = every / max(1.0, every[0, 0]), positive / max(1.0, positive[0, 0])
    penalty = ridge(positive[0, 0])
    w = np.zeros(WIDTH)
    step = rate / max(np.linalg.eigvalsh(a + prior * p)[-1], 1e-9)
    for _ in range(most):
        at_pos = p @ w
        good = prior * (at_pos - p[0])  # half the gradients of the three means of squares
        bad_all, bad_pos = a @ w + a[0], at_pos + p[0]
        unlabelled = w @ a @ w + 2 * a[0] @ w + a[0, 0] - prior * (w @ at_pos + 2 * p[0] @ w + p[0, 0])
        rest = bad_all - prior * bad_pos
        move = step * ((good + rest if unlabelled >= 0 else good - rest) + penalty * w)
        w -= move
        if np.abs(move).max() < tolerance:
            break
    return w


class QualityModel:
    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    def score(self, rows: DataFrame) -> DataFrame:
        """rows of features(), bins replaced by score."""
        w, names = self.weights, [c for c in rows.columns if c not in ("bins", "score")]
        rows = rows.select(*names, "bins")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = values(_rows(batch.column(len(names))), w)
                yield pa.record_batch([*(batch.column(c) for c in range(len(names))), pa.array(np.clip((value + 1) / 2, 0, 1))], names=[*names, "score"])

        return rows.mapInArrow(scan, rows.select(*names).schema.add("score", "double"))

    def keep(self, docs: DataFrame, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
        """The documents that score least or more, columns as they are, in one pass over the texts."""
        w, at = self.weights, docs.columns.index(text_col)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tk.python_threads()
            for batch in batches:
                score = np.clip((values(described(batch.column(at)), w) + 1) / 2, 0, 1)
                yield batch.filter(pa.array(score >= least, pa.bool_()))

        return docs.mapInArrow(scan, docs.schema)


def train(rows: DataFrame, labels: DataFrame, *, trusted: Column | None = None, prior: float | None = None, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """rows: features() with the id; trusted: of which of them labels may be learnt (all by default).

    The join with the labels moves ids and bins only, never texts.
    """
    known = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__id")).distinct()
    trusted = F.lit(True) if trusted is None else trusted
    half = F.when(trusted & F.col("__id").isNotNull(), F.pmod(F.xxhash64("__id"), F.lit(2)).cast("int"))
    marked = cut(rows.join(known, F.col(id_col) == F.col("__id"), "left").select("bins", half.alias("half")))
    every, one, other = moments(marked)
    positive = one + other
    if not positive[0, 0]:
        weights = np.zeros(WIDTH)
        weights[0] = 2 * (0.5 if prior is None else prior) - 1
        return QualityModel(weights, 0.5 if prior is None else prior)
    if prior is None:
        prior = estimate_prior(marked, every, one)
    return QualityModel(fit(every, positive, min(0.999, prior)), prior)


HELD_OUT = 1


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(features(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    held = F.coalesce(crc_mod("doc_id", 3) == HELD_OUT, F.lit(False))
    model = train(rows, table(spark, sf_dir, "labels"), trusted=crc_mod("doc_id", 3) != HELD_OUT)
    return model.score(rows).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
