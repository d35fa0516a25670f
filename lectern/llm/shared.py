"""What the operators of this package share: tables, lineage cuts, row keys, components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where that is unset
    (tests, one machine), a temporary folder that then becomes the checkpoint directory."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not have:
        have = tempfile.mkdtemp(prefix="lectern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return have


def release(spark: SparkSession) -> None:
    """Let Spark delete the exchanges and cut tables that nothing refers to any more. It does so for what the
    driver's JVM has collected, and a driver that has little to do may not collect for hours. What hangs on a finalizer goes the second time."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; lost executors do not lose it."""
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def free(name: str, columns: list[str]) -> str:
    """A column name beginning with name that isn't one of columns (whatever their case)."""
    taken, name = {c.lower() for c in columns}, f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df, of that many rows or fewer, in as many partitions as hold `each` rows; for what leaves an exchange."""
    return df.coalesce(max(1, -(-rows // each)))


#: Links that one task joins by itself; more go through distributed rounds first.
ALONE = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of the links of one partition: labels fall to the least neighbour's, then along labels, until they rest."""
    ends = [np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]) for batch in batches if batch.num_rows]
    if not ends:
        return
    ids, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    yield pa.record_batch([pa.array(ids), pa.array(ids[label])], names=["id", "root"])


def star_components(edges: DataFrame, *, alone: int = ALONE) -> DataFrame:
    """Connected components of edges(a, b) as (id, root), root the smallest id reachable.

    Alternating large-star and small-star rounds, each cut from its lineage. A round aggregates a node's
    least neighbour before the shuffle and joins it back, so a node of many links is never gathered and
    Spark may split its rows. Once the links left number `alone` or fewer (they are counted in every
    round), one task joins them: the same components by a shorter way. Self links and null ends are
    ignored; an empty input gives an empty result.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b")
              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] <= alone:
            return cut(now.coalesce(1).mapInArrow(_union_find, "id long, root long"))
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(few(small.union(low.select("a", F.col("m").alias("b"))).distinct(), 2 * mark[0]))
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())


# ---------------------------------------------------------------- buckets of band keys

def pack(part: np.ndarray, parts: int, rows: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Rows (a line of longs each) grouped by part: part numbers, one blob a part, and the order and bounds of the rows in it."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(bounds))
    data = np.ascontiguousarray(rows[order])
    ends = np.append(bounds[full], len(rows)).astype(np.int64) * data.shape[1] * 8
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.array(full.astype(np.int32)), blobs.cast(pa.binary()), order, np.append(bounds[full], len(rows))


def unpack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, width)


class Shared:
    """Of (bucket, id) rows met one after the other, those of buckets with two different ids or more, as
    (bucket, id, low), low one id of the bucket. What is remembered is one id for each bucket."""

    def __init__(self):
        self.buckets, self.low, self.told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, rows: np.ndarray, last: bool) -> np.ndarray:
        if last and not len(self.buckets):  # nothing is remembered and nothing follows: buckets of one row can go at once
            s = np.sort(rows[:, 0])
            twice = s[1:][s[1:] == s[:-1]]
            at = np.minimum(np.searchsorted(twice, rows[:, 0]), max(0, len(twice) - 1))
            rows = rows[twice[at] == rows[:, 0]] if len(twice) else rows[:0]
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        bucket, ident = rows[order, 0], rows[order, 1]
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
        bucket, ident = bucket[fresh], ident[fresh]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        names, count = bucket[first], np.diff(np.append(first, len(bucket)))
        known = np.searchsorted(self.buckets, names)
        old = known < len(self.buckets)
        old[old] = self.buckets[known[old]] == names[old]
        low = ident[first].copy()
        low[old] = self.low[known[old]]
        told = np.zeros(len(names), bool)
        told[old] = self.told[known[old]]
        lows = np.repeat(low, count)
        other = np.add.reduceat((ident != lows).astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
        give = np.repeat(other, count)
        back = other & old & ~told  # the remembered id itself, now that another one has come
        out = np.concatenate([np.stack([bucket[give], ident[give], lows[give]], axis=1), np.stack([names[back], low[back], low[back]], axis=1)])
        if not last:
            self.told[known[old]] |= other[old]
            names, low, told = (np.concatenate([x, y[~old]]) for x, y in ((self.buckets, names), (self.low, low), (self.told, other)))
            order = np.argsort(names)
            self.buckets, self.low, self.told = names[order], low[order], told[order]
        return out


#: Rows that a task collects before it hands them on, and that it holds of a part.
PENDING, HELD = 1 << 18, 1 << 22


def dealt(packed: DataFrame, tasks: int) -> DataFrame:
    """Records of pack() with their part first to last in each of `tasks` tasks."""
    return packed.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")


def tasks_and_parts(spark: SparkSession) -> tuple[int, int]:
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tasks, tasks * max(1, min(8, 4096 // tasks))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, id, low) of rows(id, keys array<long>): the members of buckets that hold two different ids or more, low one of them."""
    tasks, parts = tasks_and_parts(rows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand_over() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            held.clear()
            part, blob, _, _ = pack((pairs[:, 0] >> 20) % parts, parts, pairs)
            return pa.record_batch([part, blob], names=["part", "keys"])

        for batch in batches:
            count = np.diff(np.asarray(batch.column(1).offsets))
            held.append(np.stack([np.asarray(batch.column(1).flatten()), np.repeat(np.asarray(batch.column(0)), count)], axis=1))
            if sum(map(len, held)) >= PENDING:
                yield hand_over()
        if held:
            yield hand_over()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, buckets, held = None, 0, Shared(), []

        def give(last: bool) -> pa.RecordBatch:
            nonlocal size, buckets
            out = buckets.add(np.concatenate(held), last)
            held.clear()
            size, buckets = 0, Shared() if last else buckets
            return pa.record_batch([pa.array(out[:, k]) for k in range(3)], names=["bucket", "id", "low"])

        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and part != now and held:
                    yield give(True)
                now = part
                held.append(np.frombuffer(blob, dtype="<i8").reshape(-1, 2))
                size += len(held[-1])
                if size > HELD:
                    yield give(False)
                    held.append(np.zeros((0, 2), np.int64))
        if held:
            yield give(True)

    packed = rows.select("id", "keys").mapInArrow(scan, "part int, keys binary")
    return cut(dealt(packed, tasks).mapInArrow(reduce, "bucket long, id long, low long"))


def parity_sketch(hashes: np.ndarray, row: np.ndarray, rows: int, words: int) -> np.ndarray:
    """For each row `words` longs: bit k tells whether an odd number of its (distinct) hashes fall on k.

    The exclusive or of two rows' sketches is that of their symmetric difference, so it has no more bits
    set than the difference has members: a bound that loses nothing."""
    bits = 64 * words
    at = (hashes >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    odd = (np.bincount(row * bits + at, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8").reshape(rows, words)


def distinct_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each row (hashes[bounds[i]:bounds[i + 1]]), their rows and the rows' numbers of them."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = hashes.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], row[fresh], np.bincount(row[fresh], minlength=len(bounds) - 1)


WORDS = 8
SKETCH = [f"s{k}" for k in range(WORDS)]


def possible(similarity: float) -> Column:
    """Whether rows a and b, of n_a and n_b members and the sketches s*_a and s*_b, can have that Jaccard similarity."""
    differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{SKETCH[0]}_a").bitwiseXOR(F.col(f"{SKETCH[0]}_b"))))
    size = F.least("n_a", "n_b") >= F.lit(similarity - 1e-9) * F.greatest("n_a", "n_b")
    return size & (differ * F.lit(1 + similarity) <= (F.col("n_a") + F.col("n_b")) * F.lit(1 - similarity) + F.lit(1e-6))


def bucket_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], describe: Callable[[DataFrame], DataFrame], similarity: float, *, rounds: int = 2, pivots: int = 4, each: int = 32, alone: int = ALONE) -> DataFrame:
    """Components of ids linked by a verified pair of some bucket, as (id, root); ids alone are left out.

    members(bucket, id, low), cut from its lineage: ids that share a bucket are candidates, and low is one id of it; a
    column `pair` may mark buckets known to hold two ids only. verify turns pairs(a, b), a > b, into those that truly
    link. describe turns ids into (id, n, s0..), and may give more ids than asked for: the size and the parity sketch
    of their sets, cut too if they are costly.

    Connectivity is that of all verified pairs of all buckets, and nothing is left to chance after the
    buckets. Both bounds of possible() are exact, so only pairs that pass them are ever verified. Each id is first
    held against the lows of its buckets. Then buckets of three ids or more whose members aren't all connected are
    left; while their pairs not yet connected number more than `each` times their members, those are held against a
    few others of the bucket taken at random; and then all pairs are tried whose ends are not yet connected. So a group of
    alike ids costs links in proportion to its size, and what is compared beyond that is close to the threshold. A pair that shares several of the buckets left is made in the first of them.
    """
    info = ["n", *SKETCH]
    known = describe(members.select("id").distinct()).select("id", *info)

    def side(rows: DataFrame, end: str, *more: str) -> DataFrame:
        return rows.select(*more, F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c not in ("id", *more)])

    def tried(pairs: DataFrame) -> DataFrame:
        return cut(verify(cut(pairs.select("a", "b"))).select("a", "b"))

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return cut(rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))

    pairs = members.where("id <> low").select(F.greatest("id", "low").alias("a"), F.least("id", "low").alias("b")).distinct()
    links = tried(pairs.join(side(known, "a"), "a").join(side(known, "b"), "b").where(possible(similarity)))
    roots = star_components(links, alone=alone)
    left = rooted((members.where("not pair") if "pair" in members.columns else members).select("bucket", "id"), roots)
    some = left.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y and n > 2").select("bucket")
    left = cut(left.join(some, "bucket", "left_semi"))
    near = (F.col("root_a") != F.col("root_b")) & possible(similarity)
    two = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    for k in range(rounds + 1):
        size = left.groupBy("bucket", "root").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.expr("double(count) * count")).alias("alike"))
        size = size.agg(F.sum("n").alias("rows"), F.sum(F.expr("double(n) * n - alike") / 2).alias("pairs")).first()
        if not size["pairs"]:
            return roots
        if not k:
            left = cut(left.join(known, "id").join(left.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("keys")), "id"))
        if k == rounds or size["pairs"] <= each * size["rows"]:
            break
        chosen = [F.min_by(F.struct("id", "root", *info), F.xxhash64("id", F.lit(k * pivots + p))) for p in range(pivots)]
        other = left.groupBy("bucket").agg(F.array(*chosen).alias("p")).select("bucket", F.explode(F.array_distinct("p")).alias("p")).select("bucket", "p.*")
        new = tried(side(left, "a", "bucket").join(side(other, "b", "bucket"), "bucket").where(near).select(*two).distinct())
        if not new.take(1):
            break
        links = links.union(new)
        roots = star_components(links, alone=alone)
        left = rooted(left.drop("root"), roots)
    before = F.array_position("keys_a", F.col("bucket")).cast("int") - 1
    earlier = F.arrays_overlap(F.slice("keys_a", F.lit(1), before), "keys_b")
    rest = side(left, "a", "bucket").join(side(left, "b", "bucket"), "bucket").where((F.col("a") > F.col("b")) & near & ~earlier)
    more = tried(rest)
    return star_components(links.union(more), alone=alone) if more.take(1) else roots
