"""Fuzzy line dedup: MinHash signatures, banding, exact Jaccard, distributed union-find.

A line is a maximal piece of a text between newlines. Its set is its character shingles of `shingle`
code points after lower-casing and collapsing white space; a line shorter than that is near its exact
copies only. Lines are named by a 64-bit hash of that normal form (of a billion different lines two share
one with a probability of 0.03), so exact copies meet at once.

1. One scan of the texts gives the occurrences of all lines and, of lines of a shingle or more, a
   signature of `bands * rows` MinHash values over the whole line: the least and the greatest value under
   each of half as many permutations. Lines of similarity s meet in some band with probability
   1 - (1 - s ** rows) ** bands: 0.996 at the threshold of 0.8, 0.9997 at 0.85 (measured in the tests).
2. Band keys and occurrences go through one exchange, packed by part. A task keeps what is shared: the
   ids of buckets with two different lines or more. What it remembers of a bucket is one id, so its
   memory doesn't grow with the bucket.
3. Of the lines in such buckets one occurrence each is read again, by a Bloom filter of fixed size over
   (row, place), which lets a few others through, to no effect.
4. Candidate pairs are made as shared.bucket_links says: at a cost in proportion to a bucket's size
   however many of its lines are alike, with exact bounds on size and on parity sketches and nothing
   lost after the bands. Their shingle sets are compared exactly.
5. Components of the verified links by alternating stars; of each component, and of each line's exact
   copies, the first occurrence by (id, place in the text) is kept in the whole corpus.

Five characters to a shingle let a line of 100 characters or more lose a word and stay similar (a
replaced word costs about its length and five shingles on each side), while unlike prose has next to none
in common.

Defined results: null and empty texts stay as they are; a row with a null id comes after all others; of
repeated rows (equal id and text) each but one loses all its lines, as a repetition; of rows of equal id
and unlike texts the one with the smaller digest comes first. Blank lines stay. Texts of any length are
read whole; a line of any length is one set. Extra columns stay, whatever their names. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import HELD, PENDING, SKETCH, WORDS, Shared, bucket_links, cut, dealt, distinct_hashes, free, pack, parity_sketch, release, table, tasks_and_parts, unpack

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 18, 6, 0.8
_SLICE = 1 << 17  # code points whose signatures are computed at once
_LATER = 4096  # lines whose band keys are computed at once


def normal(line: str) -> str:
    line = line.lower()
    if line.isprintable() and "  " not in line:  # then the space is the only white space
        return line.strip(" ")
    return " ".join(line.split())


def lines_of(text: str | None, least: int = 1) -> Iterator[tuple[int, str]]:
    """(place, normal form) of the lines whose normal form has `least` code points or more, by default of all but blank ones."""
    if not text:
        return
    text = text.lower()
    plain = "  " not in text and text.replace("\n", "").isprintable()
    for k, line in enumerate(text.split("\n")):
        n = line.strip(" ") if plain else " ".join(line.split())
        if len(n) >= least:
            yield k, n


def line_id(n: str) -> int:
    h = xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' code points, and where each line starts and ends in them."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)))
    return points, np.concatenate([[0], ends[:-1]]), ends


def shingle_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines (each at least a shingle long), and the lines' bounds."""
    points, starts, ends = _points(lines)
    windows = ends - starts - shingle + 1
    bounds = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], windows)
    odd = np.random.default_rng(31).integers(1, 2**62, shingle, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
    wide = points.astype(np.uint64)
    h = wide * odd[0]
    for k in range(1, shingle):
        h[:-k] += wide[k:] * odd[k]
    return tk.mix(h[at]), bounds


def jaccard(a: str, b: str, shingle: int = SHINGLE) -> float:
    x, y = ({s[i : i + shingle] for i in range(max(1, len(s) - shingle + 1))} for s in (a, b))
    return len(x & y) / len(x | y) if x or y else 0.0


def similar(a: str, b: str, x: np.ndarray, y: np.ndarray, similarity: float, shingle: int) -> bool:
    """Whether jaccard(a, b) >= similarity. x, y: the lines' distinct shingle hashes, sorted. They decide
    unless a single collision of 64-bit hashes could change the answer; then the strings do."""
    if min(len(x), len(y)) + 1 < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    union = len(both) - shared
    if shared - 1 >= similarity * (union + 1):
        return True
    if shared + 2 < similarity * (union - 2):
        return False
    return jaccard(a, b, shingle) >= similarity


def extremes(x: np.ndarray, starts: np.ndarray, count: int, seed: int) -> np.ndarray:
    """MinHash values (count by rows) of rows of 32-bit hashes, each running to the next one's start: the
    least and the greatest value under count / 2 permutations."""
    mult = np.random.default_rng(seed).integers(1, 2**31, -(-count // 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out, buffer = np.empty((count, len(starts)), dtype=np.uint32), np.empty_like(x)
    for k in range(count):
        if not k & 1:
            np.multiply(x, mult[k >> 1], out=buffer)
        (np.maximum if k & 1 else np.minimum).reduceat(buffer, starts, out=out[k])
    return out


def signatures(lines: list[str], shingle: int, count: int) -> np.ndarray:
    """MinHash values, count by lines, each line a shingle or longer."""
    points, starts, ends = _points(lines)
    odd = np.random.default_rng(29).integers(1, 2**31, shingle, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    h = points * odd[0]
    for k in range(1, shingle):
        h[:-k] += points[k:] * odd[k]
    for k in range(1, shingle):  # a window that would leave its line is the line's first one again
        h[ends - k] = h[starts]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return extremes(h, starts, count, 11)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the bands (a row for each line) of signatures that are count by lines."""
    out = np.empty((sig.shape[1], bands), dtype=np.uint64)
    odd = np.random.default_rng(37).integers(1, 2**62, rows, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
    for b in range(bands):
        h = np.full(sig.shape[1], (b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
        for r in range(rows):
            h += sig[b * rows + r] * odd[r]
        out[:, b] = tk.mix(h)
    return out.view(np.int64)


def slices(lines: list[str]) -> Iterator[list[str]]:
    lo, size = 0, 0
    for hi, n in enumerate(lines):
        if size and size + len(n) > _SLICE:
            yield lines[lo:hi]
            lo, size = hi, 0
        size += len(n)
    if lo < len(lines):
        yield lines[lo:]


def keys_of(lines: list[str], shingle: int, bands: int, rows: int) -> np.ndarray:
    sigs = [signatures(part, shingle, bands * rows) for part in slices(lines)]
    return band_keys(np.concatenate(sigs, axis=1), bands, rows) if sigs else np.zeros((0, bands), np.int64)


def line_index(docs: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """From docs(i, d, text), d a digest of i and text: the members (bucket, id, low, pair) of buckets that lines
    share, pair true only for buckets of two ids, and the occurrences (i, d, place, line, many, lead) of all lines
    but blank ones; many is false only where a line occurs once, lead is true for one occurrence of a line at
    least. One scan, one exchange."""
    tasks, parts = tasks_and_parts(docs.sparkSession)
    kind = docs.schema["i"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        seen: set[int] = set()
        todo: dict[int, str] = {}
        held: list[np.ndarray] = []
        names = ["part", "keys", "occ", "ids"]

        def hand_over() -> pa.RecordBatch:
            rows_ = np.concatenate(held)
            held.clear()
            part, blob, _, _ = pack((rows_[:, 0] >> 20) % parts, parts, rows_)
            return pa.record_batch([part, blob, pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.list_(id_type))], names=names)

        def flush() -> None:
            ids = np.fromiter(todo, dtype=np.int64, count=len(todo))
            keys = keys_of(list(todo.values()), shingle, bands, rows)
            todo.clear()
            held.append(np.stack([keys.ravel(), np.repeat(ids, bands)], axis=1))

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            row, place, line = [], [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                for k, n in lines_of(text):
                    i = line_id(n)
                    row.append(r)
                    place.append(k)
                    line.append(i)
                    if i not in seen and len(n) >= shingle:
                        if len(seen) > 1 << 18:  # forgetting costs repeated rows only
                            seen.clear()
                        seen.add(i)
                        todo[i] = n
                if len(todo) >= _LATER:
                    flush()
                    if sum(map(len, held)) >= PENDING:
                        yield hand_over()
            if row:
                at = np.array(row)
                digest = np.asarray(batch.column(1))
                occ = np.stack([np.array(line, dtype=np.int64), digest[at], np.array(place, dtype=np.int64)], axis=1)
                part, blob, order, ends = pack((occ[:, 0] >> 20) % parts, parts, occ)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column(0).take(pa.array(at[order])))
                yield pa.record_batch([part, pa.nulls(len(part), pa.binary()), blob, ids], names=names)
        if todo:
            flush()
        if held:
            yield hand_over()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        now, size, first = None, 0, True
        buckets, keys, occ, ids = Shared(), [], [], []
        names = ["kind", "a", "b", "c", "i"]

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size, first, buckets
            if keys:
                out = buckets.add(np.concatenate(keys), last)
                _, back, count = np.unique(out[:, 0], return_inverse=True, return_counts=True)
                pair = (count[back] == 2) & (first and last)
                yield pa.record_batch([pa.array(-pair.astype(np.int32)), *(pa.array(out[:, k]) for k in range(3)), pa.nulls(len(out), id_type)], names=names)
            if occ:
                rows_ = np.concatenate(occ)
                _, at, back, count = np.unique(rows_[:, 0], return_index=True, return_inverse=True, return_counts=True)
                many = (count[back] > 1) | (not (first and last))
                kind = 1 + many.astype(np.int32)
                kind[at] += 2
                yield pa.record_batch([pa.array(kind), *(pa.array(rows_[:, k]) for k in range(3)), pa.concat_arrays(ids)], names=names)
            for x in (keys, occ, ids):
                x.clear()
            size, first = 0, last
            if last:
                buckets = Shared()

        id_type = None
        for batch in batches:
            id_type = batch.column(3).type.value_type
            part = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if now is not None and part[lo] != now:
                    yield from give(True)
                now = part[lo]
                some = batch.slice(lo, hi - lo)
                got, seen = unpack(some.column(1).drop_null(), 2), unpack(some.column(2).drop_null(), 3)
                size += len(got) + len(seen)
                if len(got):
                    keys.append(got)
                if len(seen):
                    occ.append(seen)
                    ids.append(some.column(3).drop_null().flatten())
                if size > HELD:
                    yield from give(False)
        if now is not None:
            yield from give(True)

    packed = docs.select("i", "d", "text").mapInArrow(scan, T.StructType().add("part", "integer").add("keys", "binary").add("occ", "binary").add("ids", T.ArrayType(kind)))
    both = cut(dealt(packed, tasks).mapInArrow(reduce, T.StructType().add("kind", "integer").add("a", "long").add("b", "long").add("c", "long").add("i", kind)))
    members = both.where("kind <= 0").select(F.col("a").alias("bucket"), F.col("b").alias("id"), F.col("c").alias("low"), (F.col("kind") < 0).alias("pair"))
    found = both.where("kind > 0").select("i", F.col("b").alias("d"), F.col("c").cast("int").alias("place"), F.col("a").alias("line"), F.col("kind").isin(2, 4).alias("many"), (F.col("kind") > 2).alias("lead"))
    return members, found


_FILTER = 25  # log2 of the bits of each of two filters, over (row, place) and over line ids: 4 MB, whatever the corpus


class Candidates:
    """The texts of candidate lines and their sets' sizes and sketches, from one more scan, and what is asked about them."""

    def __init__(self, docs: DataFrame, found: DataFrame, ids: DataFrame, *, shingle: int, similarity: float):
        self.shingle, self.similarity = shingle, similarity
        release(docs.sparkSession)  # the first exchange is the largest
        # of each line one occurrence; keys of one text's lines differ in the bits that count
        key = F.col("d").bitwiseXOR(F.shiftleft(F.col("place").cast("long"), 64 - _FILTER))
        one = found.where("lead").select("line", key.alias("key")).join(ids.select(F.col("id").alias("line")), "line", "left_semi").select("key", "line")
        half = 1 << (_FILTER - 6)

        def cells(x: np.ndarray) -> np.ndarray:
            return (x.view(np.uint64) >> np.uint64(64 - _FILTER)).astype(np.int64)

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = np.unique(np.concatenate([cells(np.asarray(batch.column(k))) + (k << _FILTER) for k in range(2)]))
                    word, first = np.unique(cell >> 6, return_index=True)
                    mask = np.bitwise_or.reduceat(np.uint64(1) << (cell & 63).astype(np.uint64), first)
                    yield pa.record_batch([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        bits = np.zeros(2 * half, dtype=np.uint64)
        got = one.mapInArrow(words, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2 ** 20 rows at most
        bits[np.asarray(got.column("word"))] = np.asarray(got.column("mask")).view(np.uint64)

        def is_set(cell: np.ndarray, base: int) -> np.ndarray:
            return (bits[base + (cell >> 6)] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tk.python_threads()
            seen: set[int] = set()
            for batch in batches:
                texts = batch.column(1).to_pylist()
                count = np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.int64)
                row = np.repeat(np.arange(len(texts)), count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                hit = np.flatnonzero(is_set((cells(np.asarray(batch.column(0)))[row] ^ place) & ((1 << _FILTER) - 1), 0))
                got: dict[int, str] = {}
                last, lines = -1, []
                for r, p in zip(row[hit].tolist(), place[hit].tolist(), strict=True):
                    if r != last:
                        last, lines = r, (texts[r] or "").split("\n")
                    n = normal(lines[p])
                    if len(n) >= shingle and (i := line_id(n)) not in seen:
                        if len(seen) > 1 << 18:  # forgetting costs repeated rows only
                            seen.clear()
                        seen.add(i)
                        got[i] = n
                ids = np.fromiter(got, dtype=np.int64, count=len(got))
                meant = is_set(cells(ids), half)
                ids, chosen = ids[meant], [n for n, m in zip(got.values(), meant.tolist(), strict=True) if m]
                lo = 0
                for some in slices(chosen):
                    h, of, n = distinct_hashes(*shingle_hashes(some, shingle))
                    s = parity_sketch(h, of, len(some), WORDS)
                    yield pa.record_batch([pa.array(ids[lo : lo + len(some)]), pa.array(some, pa.string()), pa.array(n, pa.int64()), *(pa.array(s[:, k]) for k in range(WORDS))], names=["id", "line", "n", *SKETCH])
                    lo += len(some)

        self.texts = cut(docs.select("d", "text").mapInArrow(scan, f"id long, line string, n long, {', '.join(f'{s} long' for s in SKETCH)}").repartition("id").dropDuplicates(["id"]))

    def describe(self, ids: DataFrame) -> DataFrame:
        return self.texts.select("id", "n", *SKETCH)

    def verify(self, pairs: DataFrame) -> DataFrame:
        shingle, similarity = self.shingle, self.similarity

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok: list[bool] = []
                for lo in range(0, batch.num_rows, 128):  # lines of a slice are hashed together, each once
                    i, j, x, y = (c.to_pylist() for c in batch.slice(lo, 128).columns)
                    lines = dict(zip(i, x, strict=True)) | dict(zip(j, y, strict=True))
                    h, _, n = distinct_hashes(*shingle_hashes(list(lines.values()), shingle))
                    ends = np.cumsum(n).tolist()
                    sets = {k: h[a:b] for k, a, b in zip(lines, [0, *ends], ends, strict=False)}
                    ok += [similar(x[k], y[k], sets[i[k]], sets[j[k]], similarity, shingle) for k in range(len(i))]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        both = pairs.join(self.texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(self.texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def line_components(docs: DataFrame, members: DataFrame, found: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of the lines that are near another line; other lines are their own component."""
    lines = Candidates(docs, found, members.select("id").distinct(), shingle=shingle, similarity=similarity)
    return bucket_links(members, lines.verify, lines.describe, similarity)


#: In place of places: every line that isn't blank.
ALL = -1


def with_losses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY) -> tuple[DataFrame, str]:
    """docs with a column (of the name returned) of the places of the lines each row loses, null if none."""
    digest, lost, nth, i, d = (free(n, docs.columns) for n in ("digest", "places", "nth", "id", "of"))
    here = docs.withColumn(digest, F.xxhash64(id_col, text_col))
    named = here.select(F.col(id_col).alias("i"), F.col(digest).alias("d"), F.col(text_col).alias("text"))
    members, found = line_index(named, shingle=shingle, bands=bands, rows=rows)
    roots = line_components(named, members, found, shingle=shingle, similarity=similarity)
    # most lines occur once and are near no other: only what is shared is held against its component's first
    shared = found.join(roots.withColumnRenamed("id", "line"), "line", "left").where("many or root is not null").select("i", "d", "place", F.coalesce("root", "line").alias("root"))
    shared = cut(shared)
    order = F.struct(F.col("i").isNull().alias("n"), F.col("i").alias("i"), F.col("d").alias("d"), F.col("place").alias("p"))
    # a table of its own, so that the join's rows of a frequent line can be split
    first = cut(shared.groupBy("root").agg(F.min(order).alias("keep"), F.count("*").alias("n")).where("n > 1").select("root", "keep"))
    del members, found, roots
    release(docs.sparkSession)
    gone = shared.join(first, "root").where(~order.eqNullSafe(F.col("keep")))
    gone = gone.groupBy(F.col("i").alias(i), F.col("d").alias(d)).agg(F.array_sort(F.collect_set("place")).alias(lost)).hint("shuffle_hash")
    mine = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(digest) == F.col(d))
    joined = here.join(gone, mine, "left").select(*here.columns, lost)
    alike = shared.groupBy("i", "d", "place").count().where("count > 1").select(F.col("i").alias(i), F.col("d").alias(d)).distinct()
    if alike.take(1):  # rows that repeat id and text: all but one of each lose everything
        again = joined.join(alike, mine, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(id_col, digest).orderBy(digest)))
        again = again.withColumn(lost, F.when(F.col(nth) > 1, F.array(F.lit(ALL))).otherwise(F.col(lost))).drop(nth)
        joined = joined.join(alike, mine, "left_anti").unionByName(again)
    return joined.drop(digest), lost


def _drop(text: str | None, places: list[int] | None) -> tuple[str | None, list[int]]:
    """The text without the lines at those places, and the places."""
    if text is None or not places:
        return text, []
    lines = text.split("\n")
    if places[0] == ALL:
        places = [k for k, line in enumerate(lines) if line.strip()]
    gone = set(places)
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), places


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, **options) -> DataFrame:
    """The documents without their repeated lines; columns as they are.

    drop_emptied: leave out documents of which no non-blank line stays (but keep those that had none).
    """
    joined, lost = with_losses(docs, id_col=id_col, text_col=text_col, **options)
    at, names = docs.columns.index(text_col), docs.columns
    joined = joined.select(*names, lost)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(len(names)).to_pylist()
            texts = [_drop(t, p)[0] for t, p in zip(batch.column(at).to_pylist(), places, strict=True)]
            out = pa.record_batch([pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(len(names))], names=names)
            yield out.filter(pa.array([not p or bool(t.strip()) for t, p in zip(texts, places, strict=True)], pa.bool_())) if drop_emptied else out

    return joined.mapInArrow(rewrite, docs.schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it loses and where, the length and the digest of what stays."""
    joined, lost = with_losses(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_drop(t, p) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            texts = [t or "" for t, _ in kept]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(p) for _, p in kept], pa.int64()), pa.array([p or None for _, p in kept], pa.list_(pa.int32())), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "n_removed", "removed", "n_chars", "kept_sha256"],
            )

    return joined.select("doc_id", "text", lost).mapInArrow(digest, "doc_id long, n_removed long, removed array<int>, n_chars long, kept_sha256 string")
