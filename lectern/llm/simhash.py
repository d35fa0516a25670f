"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint of 64 bits is cut into three segments; the counts of ones in them are a point of a small
integer grid. Flipping a bit moves the point by one, so the Manhattan distance of two points is at most
the Hamming distance of the fingerprints: a lower bound to search by. Of two points at Manhattan
distance 2 or less, one grid point lies within distance 1 of both. Two flips also leave one segment as it
is, so every distinct fingerprint enters, for each segment that might be that one, the segment's bits
with its own cell of the other two counts and the cells one step away: 15 rows. Candidates meet in an
equi-join on these, in one of them only, and the Hamming distance of a pair that met decides. Nothing
within the radius is missed. A fingerprint has 2080 others within two bits at most, so what the
join makes grows with the input.

Copies of a text have one fingerprint and are grouped before the join, so a large group of exact
copies is one row.

Two bits fit near-exact copies only; an edit of one text in twenty moves five to ten. keep_one can so link,
beside these, the texts of which at least a given share of five-word shingles is common. A radius that
covers them leaves no part of 64 bits by which to search (11 segments of 6 bits, of which one is sure to
agree, put all texts into 64 buckets), so those meet by MinHash bands of their shingles: at a similarity of
0.8 all bands miss a pair with probability (1 - 0.8 ** 5) ** 24 = 0.00007, above it with less. What meets is
decided on the whole sets.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; fewer words
than the shingle size give one shingle, the whole word sequence; a null id joins a component (the
smallest non-null id of it) but names none: a component with null ids only has a null component id.
Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .linededup import band_keys, extremes
from .shared import SKETCH, bucket_links, cut, distinct_hashes, free, parity_sketch, shared_buckets, star_components, table
from .shared import WORDS as WORDS_OF_SKETCH

WORDS, BANDS, ROWS = 5, 24, 5

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else (b if tk.NON_SPACE[b] else 32) for b in range(256))
#: For a byte, its bits as eight counters of eight bits each in one word.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
_SLICE = 255  # the most hashes that a counter of eight bits takes


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row (hashes[bounds[i]:bounds[i + 1]]) the word whose bits are set in over half of them."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    count = np.diff(bounds)
    rows = np.flatnonzero(count)
    if not len(rows):
        return out
    pieces = -(-count[rows] // _SLICE)
    cut = np.repeat(bounds[:-1][rows], pieces) + _SLICE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    first = np.cumsum(pieces) - pieces
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], cut)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        more = (2 * ones > count[rows][:, None]).astype(np.uint64)
        for i in range(8):
            out[rows] |= more[:, i] << np.uint64(8 * k + i)
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the chunk's rows, and the rows' bounds in it."""
    starts, ends, bounds = tk.runs(data, offsets, tk.NON_SPACE)
    words = np.diff(bounds)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    limits = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(limits[-1]) - np.repeat(limits[:-1], count) + np.repeat(bounds[:-1], count)
    last = first + np.repeat(np.minimum(words, shingle), count) - 1
    raw = data.tobytes()
    text = b" ".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)).translate(_CLEAN)
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])  # in text, words follow each other with one space between
    h = xxhash.xxh64_intdigest
    got = [h(text[a:b], seed) for a, b in zip(at[first].tolist(), (at[last + 1] - 1).tolist(), strict=True)]
    return np.array(got, dtype=np.uint64), limits


def word_windows(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words of the chunk's rows, the rows' bounds in them, and a digest of each row's words."""
    data = tk.FOLD[data]
    starts, ends, bounds = tk.runs(data, offsets, tk.NON_SPACE)
    total, words = tk.prefix_hash(tk.run_hashes(data, starts, ends)), np.diff(bounds)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    limits = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(limits[-1]) - np.repeat(limits[:-1], count) + np.repeat(bounds[:-1], count)
    return tk.window_hash(total, first, np.repeat(np.minimum(words, size), count)), limits, tk.window_hash(total, bounds[:-1], words).view(np.int64)


def word_keys(h: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Band keys of the rows of window hashes (none of them empty)."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    return band_keys(extremes(x, limits[:-1], BANDS * ROWS, 17), BANDS, ROWS)


class SharedWords:
    """The texts that share a band, fetched once, and the exact comparison of their five-word sets."""

    def __init__(self, texts: DataFrame, similarity: float):
        """texts(id, text): cut from their lineage."""
        self.texts, self.similarity = texts, similarity

    def describe(self, ids: DataFrame) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tk.python_threads()
            for batch in batches:
                for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                    h, limits, _ = word_windows(data, offsets)
                    h, row, n = distinct_hashes(h, limits)
                    s = parity_sketch(h, row, hi - lo, WORDS_OF_SKETCH)
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *(pa.array(s[:, k]) for k in range(WORDS_OF_SKETCH))], names=["id", "n", *SKETCH])

        return cut(self.texts.mapInArrow(scan, f"id long, n long, {', '.join(f'{s} long' for s in SKETCH)}"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        similarity = self.similarity

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok: list[bool] = []
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    x, y = ([h[a:b] for _, _, data, offsets in tk.chunks(c) for h, limits, _ in [word_windows(data, offsets)] for a, b in zip(limits[:-1], limits[1:], strict=True)] for c in part.columns[2:])
                    for s, t in zip(x, y, strict=True):
                        s, t = np.unique(s), np.unique(t)
                        shared = len(np.intersect1d(s, t, assume_unique=True))
                        ok.append(shared >= similarity * (len(s) + len(t) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        a, b = (self.texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def word_links(prints: DataFrame, docs: DataFrame, row: str, text_col: str, similarity: float) -> DataFrame:
    """(id, root) of the texts, by the digests of their words, linked by a five-word Jaccard similarity.

    prints: row, words and keys of simhash(words=True) over docs, cut; row names docs' rows by a digest."""
    members = shared_buckets(prints.select(F.col("words").alias("id"), "keys"))
    near = prints.join(members.select(F.col("id").alias("words")).distinct(), "words", "left_semi").groupBy(F.col("words").alias("id")).agg(F.min(row).alias("one"))
    texts = cut(docs.join(near, docs[row] == near["one"]).select(near["id"], docs[text_col].alias("text")).dropDuplicates(["id"]))
    links = SharedWords(texts, similarity)
    return bucket_links(members, links.verify, links.describe, similarity)


def simhash(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", shingle: int = 3, seed: int = 42, name: str = "fp", words: bool = False) -> DataFrame:
    """The kept columns (all by default) and the fingerprint, a long of 64 bits. words adds the columns words
    (a digest of the text's words) and keys (the buckets of its five-word set; none for a text without words)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    inputs = docs.select(*dict.fromkeys([*keep, text_col]))
    at = inputs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(at)):
                columns = [*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(fingerprints(*shingle_hashes(data, offsets, shingle, seed)).view(np.int64))]
                if words:
                    h, limits, ids = word_windows(data, offsets)
                    count = np.diff(limits)
                    full = np.flatnonzero(count)
                    bounds = np.concatenate([[0], np.cumsum((count > 0) * BANDS)])
                    keys = word_keys(h, np.append(limits[full], limits[-1])) if len(full) else np.zeros(0, np.int64)
                    columns += [pa.array(ids), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel()))]
                yield pa.record_batch(columns, names=names)

    schema, names = inputs.select(*keep).schema.add(name, "long"), [*keep, name, *(["words", "keys"] if words else [])]
    return inputs.mapInArrow(scan, schema.add("words", "long").add("keys", T.ArrayType(T.LongType())) if words else schema)


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


_BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and width


def _bits(x: str, first: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(x), first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def grid_points(points: DataFrame) -> DataFrame:
    """(block, value, x, y, id): for each block of the id, its bits, and the cells of the other two blocks'
    popcounts: the id's own and those one step away."""
    rows = []
    for t, (first, width) in enumerate(_BLOCKS):
        x, y = (F.bit_count(_bits("id", *_BLOCKS[u])).cast("int") for u in range(3) if u != t)
        steps = [F.struct((x + F.lit(dx)).alias("x"), (y + F.lit(dy)).alias("y")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
        rows.append(F.struct(F.lit(t).alias("block"), _bits("id", first, width).cast("int").alias("value"), F.array(*steps).alias("cells")))
    out = points.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.block", "r.value", F.explode("r.cells").alias("c"))
    return out.select("block", "value", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "id")


def grid_links(points: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b), a > b: the pairs of points(id) that differ in at most `bits` bits, each once.

    Two flipped bits leave one of three blocks as it is, and the popcounts of the other two blocks are within
    Manhattan distance 2 of each other, so one cell is within a step of both points. A pair is made in the
    first block that it shares, in one cell: halfway in a coordinate that differs by two, else a's x and b's y.
    """
    grid = grid_points(points)
    a, b = (grid.select("block", "value", "x", "y", F.col("id").alias(s)) for s in "ab")
    met = a.join(b, ["block", "value", "x", "y"]).where((F.col("a") > F.col("b")) & (hamming("a", "b") <= bits))
    first, cell = F.lit(False), F.lit(False)
    for t in range(3):
        earlier = F.lit(True)
        for u in range(t):
            earlier = earlier & (_bits("a", *_BLOCKS[u]) != _bits("b", *_BLOCKS[u]))
        first = first | ((F.col("block") == t) & earlier)
        (ax, bx), (ay, by) = (tuple(F.bit_count(_bits(s, *_BLOCKS[u])).cast("int") for s in "ab") for u in range(3) if u != t)
        x = F.when(F.abs(ax - bx) == 2, F.least(ax, bx) + 1).otherwise(ax)
        y = F.when(F.abs(ay - by) == 2, F.least(ay, by) + 1).otherwise(by)
        cell = cell | ((F.col("block") == t) & (F.col("x") == x) & (F.col("y") == y))
    return met.where(first & cell).select("a", "b")


def components(prints: DataFrame, *, id_col: str = "doc_id", name: str = "fp", bits: int = 2, links: DataFrame | None = None) -> DataFrame:
    """prints with component_id, the smallest id reachable over links of at most `bits` differing bits, and
    component, the smallest fingerprint reachable (never null). prints is read twice: cut its lineage first. links(a, b): further links of fingerprints."""
    if not 0 <= bits <= 2:
        raise ValueError("three blocks and cells one step away serve up to 2 bits")
    points = prints.groupBy(F.col(name).alias("id")).agg(F.min(id_col).alias("first"))
    near = grid_links(points.select("id"), bits)
    roots = star_components(near if links is None else near.union(links.select("a", "b")))
    named = points.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "root").select(F.col("id").alias("__id"), "component_id", F.col("root").alias("component"))
    return prints.join(named, F.col(name) == F.col("__id"), "left").drop("__id")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(id, fingerprint, component_id) of every document; fingerprint as 16 hex digits."""
    prints = cut(simhash(docs, keep=[id_col], text_col=text_col, **options))
    out = components(prints, id_col=id_col)
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """One document of each component, columns as they are: that with the smallest id (nulls last; of
    repeated ids one by a digest of the row; of rows alike in all columns one). Components are found on
    ids, digests and fingerprints; the texts move once, in the join with the kept keys. similarity: texts
    of at least this five-word Jaccard similarity are linked too, and the texts that share a band move."""
    row, fp = free("row", docs.columns), free("fp", docs.columns)
    here = docs.withColumn(row, F.xxhash64(*docs.columns))
    prints = cut(simhash(here, keep=[id_col, row], text_col=text_col, name=fp, words=similarity is not None))
    links = None
    if similarity is not None:
        fps = prints.groupBy("words").agg(F.min(fp).alias("f"))  # texts of equal words have one fingerprint
        a, b = (fps.select(F.col("words").alias(k), F.col("f").alias(side)) for k, side in (("id", "a"), ("root", "b")))
        links = word_links(prints, here, row, text_col, similarity).join(a, "id").join(b, "root").select("a", "b")
    prints = prints.select(F.col(id_col).alias("i"), F.col(row).alias("d"), F.col(fp).alias("fp"))
    key = F.struct(F.col("i").isNull().alias("n"), "i", "d")
    kept = components(prints, id_col="i", links=links).groupBy("component").agg(F.min(key).alias("k"))
    kept = kept.select(F.col("k.i").alias("__i"), F.col("k.d").alias("__d"))
    out = here.join(kept, here[id_col].eqNullSafe(kept["__i"]) & (here[row] == kept["__d"]), "left_semi")
    alike = prints.groupBy("i", "d").count().where("count > 1").limit(1).count()
    return (out.dropDuplicates([id_col, row]) if alike else out).drop(row)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
