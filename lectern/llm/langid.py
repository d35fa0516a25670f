"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from its code point, so any script works and no
table is kept). A letter n-gram is bound from its letters' vectors, each rotated by its place in the
n-gram, by elementwise products; a text's vector bundles (adds) the vectors of its n-grams. A
language's prototype bundles all its training texts, summed over all tasks without sampling: the sum
has a fixed size whatever the corpus. A text gets the language whose prototype has the largest cosine
with its vector; the score is that cosine, cut to 0..1.

Letters are lower-cased; a run of anything else is one word boundary, a symbol of its own. Defined
results: a text that is null or has no letter, or any text if nothing could be learnt, is `und` with
score 0; rows of null language are never learnt from; of equal cosines the smallest language value
wins; repeated rows count as often as they occur; texts of any length are read whole; extra columns stay
if kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import crc_mod, table

DIMENSIONS, ORDER, UNKNOWN = 1024, 3, "und"
_CHUNK = 1 << 18
_BOUNDARY = 0


class Encoder:
    """Texts to bundled n-gram vectors. Holds no data of the corpus but a bounded cache of letter vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER):
        self.dimensions, self.order = dimensions, order
        self._letters: dict[int, np.ndarray] = {}
        points = np.arange(0x110000, dtype=np.uint32)
        points[0xD800:0xE000] = 32  # surrogates are no letters
        text = points.tobytes().decode("utf-32-le")
        self._letter = np.fromiter((c.isalpha() for c in text), dtype=bool, count=len(text))

    def letter(self, point: int) -> np.ndarray:
        v = self._letters.get(point)
        if v is None:
            if len(self._letters) > 20_000:
                self._letters.clear()
            v = np.random.default_rng(1_000_003 + point).integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)
            self._letters[point] = v
        return v

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct n-grams as rows of code points, counts as texts by n-grams, whether a text has a letter)."""
        rows = [t.lower() for t in texts]
        size = np.fromiter((len(t) for t in rows), dtype=np.int64, count=len(rows))
        joined = "".join(rows)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(points < 0x110000, points, 32)
        row = np.repeat(np.arange(len(rows)), size)
        letter = self._letter[points]
        # a boundary opens and closes each text, and a run of non-letters becomes one
        fresh = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        keep = letter.copy()
        keep[1:] |= ~letter[1:] & (letter[:-1] & ~fresh[1:])
        points = np.where(letter, points, _BOUNDARY)[keep]
        row = row[keep]
        some = np.bincount(row, minlength=len(rows)) > 0
        has = np.bincount(row[points != _BOUNDARY], minlength=len(rows)) > 0 if len(row) else np.zeros(len(rows), bool)
        # pad: a boundary before each text, and one after if the last symbol is a letter
        first = np.searchsorted(row, np.arange(len(rows)))
        end = np.searchsorted(row, np.arange(len(rows)), side="right")
        tail = np.flatnonzero(some)
        tail = tail[points[end[tail] - 1] != _BOUNDARY] if len(tail) else tail
        at = np.concatenate([end[tail], first[some]])  # where one text ends and the next begins, the end comes first
        points = np.insert(points, at, _BOUNDARY)
        row = np.insert(row, at, np.concatenate([tail, np.flatnonzero(some)]))
        n = len(points) - self.order + 1
        if n <= 0:
            return np.zeros((0, self.order), np.int64), np.zeros((len(rows), 0), np.float32), has
        values, code = np.unique(points, return_inverse=True)
        key = np.zeros(n, dtype=np.int64)
        for k in range(self.order):
            key = key * len(values) + code[k : k + n]
        ok = row[:n] == row[self.order - 1 :]
        key, owner = key[ok], row[:n][ok]
        space = len(values) ** self.order
        if space <= 1 << 22:
            seen = np.zeros(space, dtype=bool)
            seen[key] = True
            grams = np.flatnonzero(seen)
            index = np.cumsum(seen) - 1
            gram = index[key]
        else:
            grams, gram = np.unique(key, return_inverse=True)
        table_ = np.bincount(owner * len(grams) + gram, minlength=len(rows) * len(grams)).astype(np.float32).reshape(len(rows), len(grams))
        letters = np.stack([grams // len(values) ** (self.order - 1 - k) % len(values) for k in range(self.order)], axis=1)
        return values[letters].astype(np.int64), table_, has

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of n-grams given by code points."""
        values, code = np.unique(grams, return_inverse=True)
        code = code.reshape(grams.shape)
        base = np.stack([self.letter(int(v)) for v in values]) if len(values) else np.zeros((0, self.dimensions), np.int8)
        out = np.ones((len(grams), self.dimensions), dtype=np.int8)
        for k in range(self.order):
            out *= np.roll(base, self.order - 1 - k, axis=1)[code[:, k]]
        return out.astype(np.float32)

    def bundles(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, bundled vectors, has letters) for slices of the texts of bounded size."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or (size + len(texts[hi]) <= _CHUNK and (hi - lo + 1) * (size + len(texts[hi])) <= 1 << 25)):
                size += len(texts[hi])
                hi += 1
            grams, counts, has = self.counts(texts[lo:hi])
            out = np.zeros((hi - lo, self.dimensions), dtype=np.float32)
            for k in range(0, len(grams), 4096):
                out += counts[:, k : k + 4096] @ self.vectors(grams[k : k + 4096])
            yield lo, out, has
            lo = hi


def prototypes(docs: DataFrame, *, trusted: Column | None = None, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER) -> dict[str, np.ndarray]:
    """The bundles of all trusted texts by language. The result's size is languages by dimensions."""
    trusted = F.lit(True) if trusted is None else trusted

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        encoder, sums = Encoder(dimensions, order), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, vectors, _ in encoder.bundles(["" if t is None else t for t in batch.column(1).to_pylist()]):
                here = np.array(langs[lo : lo + len(vectors)], dtype=object)
                for lang in set(here.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[here == lang].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions)), pa.array(v)], names=["lang", "k", "v"])

    rows = docs.where(F.col(lang_col).isNotNull() & trusted).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(scan, "lang string, k long, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.lang, np.zeros(dimensions))[r.k] = r.v
    return {k: v for k, v in out.items() if np.any(v)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *, keep: list[str] | None = None, text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """The kept columns (all by default), lang_pred and score."""
    ours = ("lang_pred", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ours]
    inputs = docs.select(*dict.fromkeys([*keep, text_col]))
    at = inputs.columns.index(text_col)
    names = sorted(profiles)
    matrix = np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in names], axis=1).astype(np.float32) if names else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        encoder = Encoder(dimensions, order)
        for batch in batches:
            lang, score = [], []
            for _, vectors, has in encoder.bundles(["" if t is None else t for t in batch.column(at).to_pylist()]):
                if matrix is None:
                    lang += [UNKNOWN] * len(vectors)
                    score += [0.0] * len(vectors)
                    continue
                cosine = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)) @ matrix
                best = cosine.argmax(axis=1)
                lang += [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score += np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64).tolist()
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *ours])

    return inputs.mapInArrow(scan, inputs.select(*keep).schema.add("lang_pred", "string").add("score", "double"))


HELD_OUT = 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = prototypes(docs, trusted=crc_mod("doc_id", 4) != HELD_OUT)
    out = identify(docs, profiles, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
