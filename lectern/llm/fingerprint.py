"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words (A-Z lower-cased), weighted by how often they occur. For
each sample k a term of weight w draws, from a hash of term and k alone, r and c of Gamma(2, 1) and b
uniform on (0, 1), and then

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b) - r

The sample is (term, t) of the smallest a. Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity sum(min(w, w')) / sum(max(w, w')) of their terms. A fingerprint is
`samples` such pairs, each kept as a hash of 16 bits (four hex digits); the share of equal digits
groups estimates the similarity with a standard error of sqrt(s (1 - s) / samples).

Defined results: a null or empty text, or one of white space only, has the fingerprint of zeros: alike
to another such text and to nothing else. Equal texts have equal fingerprints, wherever they are.
Repeated rows each get theirs. Extra columns stay if kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table

SAMPLES = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Draws made at a time: what is worked on stays in a core's cache.
_CELLS = 1 << 15
#: Bytes of texts sampled together; a word that they share is drawn once.
CHUNK = 1 << 22
#: In a row that weighs FEW or more, only draws with an a below LOW are held against each other.
LOW, FEW = 1 / 16, 128


def _mix(h: np.ndarray) -> np.ndarray:
    """tk.mix in place."""
    spare = h >> np.uint64(30)
    h ^= spare
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(27), out=spare)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(31), out=spare)
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    """Words of 32 bits as numbers between 0 and 1."""
    u = h.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-32)
    return u


def _two_units(h: np.ndarray) -> np.ndarray:
    """The product of two numbers between 0 and 1, one from either half of h; minus its logarithm is of Gamma(2, 1)."""
    u = _unit(h.view(np.uint32))
    return np.maximum(u[:, ::2] * u[:, 1::2], np.float32(1e-30))


def _seeds(terms: np.ndarray, samples: int) -> np.ndarray:
    return terms[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * _STEP)[None, :]


def _r_and_c(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(-r) and c, a row for each term and a column for each sample."""
    c = _two_units(_mix(seed ^ np.uint64(0x5851F42D4C957F2D)))
    return _two_units(_mix(seed.copy())), np.maximum(-np.log(c), np.float32(1e-30))


def _packed(terms: np.ndarray, seed: np.ndarray, exp_r: np.ndarray, c: np.ndarray, ln_w: np.ndarray, below: float = np.inf) -> tuple[np.ndarray, np.ndarray | slice]:
    """Words that sort by ln a and carry 16 bits of the sample's id, never zero, of those draws whose ln a is below the bound, and which they are."""
    three = _mix(seed + np.uint64(0x14057B7EF767814F))
    b = np.minimum(_unit((three >> np.uint64(32)).astype(np.uint32)), np.float32(0.99999994))
    r = np.maximum(-np.log(exp_r), np.float32(1e-6))
    t = np.floor(ln_w / r + b)  # 0 for a weight of 1
    ln_a = np.log(c) - r * (t - b) - r
    at = np.flatnonzero(ln_a < np.float32(below)) if below < np.inf else slice(None)
    ln_a, t = ln_a[at], t[at]
    ids = _mix((three[at] & np.uint64(0xFFFFFFFF)) + (terms[at] << np.uint64(7)))
    ids = np.where(t == 0, ids, _mix(ids + t.astype(np.int64).astype(np.uint64) * _STEP))
    bits = ln_a.view(np.uint32)
    key = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    return key << np.uint64(32) | (ids & np.uint64(0xFFFFFFFE)) | np.uint64(1), at


_NONE = ~np.uint64(0)


def _least_of_all(rows: np.ndarray, terms: np.ndarray, ln_w: np.ndarray, n: int, samples: int) -> np.ndarray:
    """The least packed draw of each row in each sample (n by samples), _NONE for a row without terms; all draws are made."""
    out = np.full((n, samples), _NONE)
    each = max(1, _CELLS // samples)
    for lo in range(0, len(rows), each):
        row, some = rows[lo : lo + each], terms[lo : lo + each]
        seed = _seeds(some, samples)
        draw = _packed(np.repeat(some, samples), seed.ravel(), *(x.ravel() for x in _r_and_c(seed)), np.repeat(ln_w[lo : lo + each], samples))[0].reshape(-1, samples)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.minimum(out[row[first]], np.minimum.reduceat(draw, first, axis=0))
    return out


def _low_draws(terms: np.ndarray, ln_w: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted terms' draws those with an a below LOW: packed, their samples, and the terms' bounds in them.

    t - b is at most ln w / r, so a is at least c exp(-r) / w: where that is not below LOW (by more than is lost in rounding), nothing
    else of the draw is made."""
    each = max(1, _CELLS // samples)
    draws, sample, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    limit = np.float32(LOW * 1.001) * np.exp(ln_w)
    for lo in range(0, len(terms), each):
        some = terms[lo : lo + each]
        seed = _seeds(some, samples)
        exp_r, c = _r_and_c(seed)
        row, col = np.nonzero(c * exp_r < limit[lo : lo + each, None])
        cell = row * samples + col
        got, at = _packed(some[row], seed.ravel()[cell], exp_r.ravel()[cell], c.ravel()[cell], ln_w[lo : lo + each][row], np.log(LOW))
        draws.append(got)
        sample.append(col[at])
        count.append(np.bincount(row[at], minlength=len(some)))
    return np.concatenate(draws), np.concatenate(sample), np.cumsum(np.concatenate(count))


def _least_of_low(rows: np.ndarray, terms: np.ndarray, ln_w: np.ndarray, n: int, samples: int) -> np.ndarray:
    """What _least_of_all gives, wherever a row has a draw below LOW in a sample; else _NONE."""
    out = np.full(n * samples, _NONE)
    known, index = np.unique(terms, return_inverse=True)
    heights, height = np.unique(ln_w, return_inverse=True)
    both, index = np.unique(index * len(heights) + height, return_inverse=True)  # each term once for each of its weights
    draws, sample, bounds = _low_draws(known[both // len(heights)], heights[both % len(heights)], samples)
    for lo in range(0, len(rows), 1 << 13):
        at = index[lo : lo + (1 << 13)]
        count = bounds[at + 1] - bounds[at]
        ends = np.cumsum(count)
        source = np.arange(ends[-1]) + np.repeat(bounds[at] - ends + count, count)
        np.minimum.at(out, np.repeat(rows[lo : lo + (1 << 13)] * samples, count) + sample[source], draws[source])
    return out.reshape(n, samples)


def weighted_samples(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, samples: int = SAMPLES) -> np.ndarray:
    """Sample ids (n by samples, 16 bits, 0 for a row without terms) of rows' weighted terms; rows ascending.

    a is exponential with a rate of the weight, so the least of a heavy row is nearly always below LOW, and most draws are not. A
    light row, or one that has no draw below LOW in some sample, has all its draws made; what comes out is the same."""
    ln_w = np.log(weights.astype(np.float32))
    least = np.full((n, samples), _NONE)
    some = (np.bincount(rows, weights, minlength=n) >= FEW)[rows]
    if some.any():
        least = _least_of_low(rows[some], terms[some], ln_w[some], n, samples)
    rest = (least == _NONE).any(axis=1)
    some = rest[rows]
    if some.any():
        least[rest] = _least_of_all(rows[some], terms[some], ln_w[some], n, samples)[rest]
    got = (least & np.uint64(0xFFFF)).astype(np.uint16) ^ ((least >> np.uint64(16)) & np.uint64(0xFFFE)).astype(np.uint16)
    got[got == 0] = 1
    got[(least == _NONE).all(axis=1)] = 0
    return got


def term_weights(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, counts) of the words of the chunk's texts, rows ascending."""
    starts, ends, bounds = tk.runs(data, offsets, tk.NON_SPACE)
    h = tk.run_hashes(tk.FOLD[data], starts, ends)
    known, index = np.unique(h, return_inverse=True)
    each = np.sort(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * max(1, len(known)) + index)
    at = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.zeros(0, np.int64)
    row, index = np.divmod(each[at], max(1, len(known)))
    return row, known[index], np.diff(np.append(at, len(h)))


def sample_texts(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    got = [weighted_samples(*term_weights(data, offsets), hi - lo, samples) for lo, hi, data, offsets in tk.chunks(texts, CHUNK)]
    return np.concatenate(got) if got else np.zeros((0, samples), np.uint16)


def hex_strings(samples: np.ndarray) -> list[str]:
    width = samples.shape[1] * 4
    text = samples.astype(">u2").tobytes().hex()
    return [text[i : i + width] for i in range(0, len(text), width)]


def fingerprint(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """The kept columns (all by default) and fingerprint."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    inputs = docs.select(*dict.fromkeys([*keep, text_col]))
    at = inputs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(hex_strings(sample_texts(batch.column(at), samples)), pa.string())], names=[*keep, "fingerprint"])

    return inputs.mapInArrow(scan, inputs.select(*keep).schema.add("fingerprint", "string"))


SAMPLED = 32


def _above(bounds: list[int], value: Column) -> Column:
    """How many of the bounds (descending) are greater than value, by bisection; comparisons only, so no overflow."""
    if not bounds:
        return F.lit(0)
    table_ = F.lit(bounds).cast("array<bigint>")
    step, steps = 1, []
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table_, at + s - 1) > value), at + s).otherwise(at))


def by_neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ghost, id, text) partitioned and sorted so that each document is followed by the next one
    by descending id (nulls last; ties by a digest of the text); the last one's next is the first.

    Ranges of (id, digest) are the buckets; the first document of a bucket also enters the bucket before, as
    its ghost. Texts move once. The bounds are quantiles of a sample of the ids, SAMPLED for each bucket, so ids may
    lie as they will (the sample decides how even the buckets are, and nothing else); an id (or the lack of one) that takes more than a bucket's share of the rows is
    split by the digest. Bounds and the buckets' first rows, of the number of buckets, are all that reaches the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = rows.agg(F.count("id").alias("n"), F.count("*").alias("all")).first()
    share = min(1.0, SAMPLED * buckets / max(1, got.n))
    some = np.sort(np.asarray(rows.select("id").where("id is not null").sample(share, 17).toArrow().column("id"), dtype=np.int64))  # about SAMPLED * buckets ids
    times: dict[int, int] = {}
    for k in range(1, buckets if len(some) else 0):
        q = int(some[k * len(some) // buckets])
        times[q] = times.get(q, 0) + 1
    bounds = sorted(times, reverse=True)
    # cells: above the first bound, equal to it, between it and the second, ..., without an id; each of so many buckets
    split = [1] + [n for b in bounds for n in (times[b], 1)] + [max(1, buckets * (got["all"] - got.n) // max(1, got["all"]))]
    start = [sum(split[:c]) for c in range(len(split))]
    over = _above(bounds, F.col("id"))
    same = F.get(F.lit(bounds or [0]).cast("array<bigint>"), over) == F.col("id")
    cell = F.when(F.col("id").isNull(), len(split) - 1).otherwise(2 * over + F.when(same, 1).otherwise(0))
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("cell", cell)
    part = F.col("digest").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    many = F.get(F.lit(split), F.col("cell"))
    rows = rows.withColumn("bucket", (F.get(F.lit(start), F.col("cell")) + F.when(many == 1, 0).otherwise(F.least(many - 1, F.floor(part * many)))).cast("int"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("digest").alias("d"))).alias("top")).collect()
    heads = {r.bucket: (r.top.id, ~r.top.d) for r in heads}
    order = sorted(heads)
    pairs = [(order[i - 1], b, *heads[b]) for i, b in enumerate(order)]
    is_head = spark.createDataFrame(pairs, "before int, own int, top long, d long")  # a row for each bucket
    ghosts = rows.join(F.broadcast(is_head), (F.col("bucket") == F.col("own")) & (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("top")))
    ghosts = ghosts.select(F.col("before").alias("bucket"), F.lit(1).alias("ghost"), "id", "digest", "text").dropDuplicates(["bucket"])
    both = rows.select("bucket", F.lit(0).alias("ghost"), "id", "digest", "text").union(ghosts)
    return both.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("id"), "digest").select("bucket", "ghost", "id", "text")


def edited_text(text: str, following: str) -> str:
    """text, its last third (rounded down) replaced by as much of the beginning of following."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = by_neighbours(docs, "doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        held: list[tuple[int, int, int | None, str]] = []
        size = 0

        def flush(rest: bool) -> pa.RecordBatch:
            """Of the rows held, all that have their next; the last one stays held unless rest."""
            nonlocal held, size
            own, texts = [], []
            for i, (bucket, ghost, _, text) in enumerate(held):
                if not ghost and i + 1 < len(held) and held[i + 1][0] == bucket:
                    own.append(i)
                    texts.append(edited_text(text, held[i + 1][3]))
            plain = [h[3] for h in held]
            got = sample_texts(pa.array(plain + texts, pa.large_string()))
            mine, changed = got[: len(held)][own] if own else got[:0], got[len(held) :]
            following = got[[i + 1 for i in own]] if own else got[:0]
            out = pa.record_batch(
                [
                    pa.array([held[i][2] for i in own], pa.int64()),
                    pa.array([len(plain[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array(hex_strings(mine), pa.string()),
                    pa.array(hex_strings(changed), pa.string()),
                    pa.array((mine == changed).mean(axis=1) if own else [], pa.float64()),
                    pa.array((mine == following).mean(axis=1) if own else [], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            held = [] if rest else held[-1:]
            size = sum(len(h[3]) for h in held)
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield flush(False)
        yield flush(True)

    return rows.mapInArrow(scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
