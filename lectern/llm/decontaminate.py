"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

A window is `window` consecutive words of an item; an item of fewer words (but not none) is one window.
A window's set is its shingles of `shingle` words (a shorter window is one shingle). For exact
containment a document must hold every shingle of the window, so the prefix to index is a single
shingle: the one rarest in the whole corpus, counted over all documents. The join then goes

1. count every benchmark shingle over all documents (one scan, partial counts, one small shuffle);
2. keep each window's rarest shingle and its position: the necessary prefix token;
3. in a second scan, look up the prefix tokens; a hit at word q for a token at position p of a window
   of n words proposes the window at q - p, which must begin and end inside the document (positional
   and length bounds);
4. compare the proposal's rolling hash, and then the words themselves: only exact containment counts.

Documents never move between machines; no step holds more of the benchmark than one block of
`block_windows` windows. A larger benchmark is joined block by block, and the blocks' hits are
merged by the digest of the text, since they depend on nothing else.

Defined results: a null or empty text has no words and no hits; a null item text gives no window; an
item whose id is null still marks words but is not counted among the items; repeated documents
each get their row; repeated items count once per id. Extra columns are kept if asked for, unless
their names are those of the result's columns, which win.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import free, table

_SEPARATORS = bytes(b if k and not 65 <= b <= 90 else (b + 32 if k else 32) for b, k in enumerate(tk.ALNUM))


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def item_windows(items: DataFrame, window: int, text_col: str, id_col: str) -> DataFrame:
    """(item, words, size): the distinct windows of every item, words joined by a space."""
    schema = "item string, words string, size int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, joined, size = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                for k in range(max(1, len(w) - window + 1) if w else 0):
                    part = w[k : k + window]
                    item.append(i)
                    joined.append(b" ".join(part).decode())
                    size.append(len(part))
            yield pa.record_batch([pa.array(item, pa.string()), pa.array(joined, pa.string()), pa.array(size, pa.int32())], names=["item", "words", "size"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, schema).distinct()


class Block:
    """One block of windows with its shingles, on the driver and in the tasks."""

    def __init__(self, rows: list[tuple[str | None, str, int]], shingle: int):
        texts = sorted({(words, size) for _, words, size in rows})
        where = {t: i for i, t in enumerate(texts)}
        self.words = [w.encode() for w, _ in texts]
        self.size = np.array([n for _, n in texts], dtype=np.int64)
        self.items: list[list[str]] = [[] for _ in texts]
        for item, words, size in rows:
            if item is not None:
                self.items[where[words, size]].append(item)
        data = np.frombuffer(b"\n".join(self.words), dtype=np.uint8)
        lengths = np.array([len(w) + 1 for w in self.words], dtype=np.int64)
        starts, ends, _ = tk.runs(data, np.array([0, len(data)]), tk.NON_SPACE)
        hashes = tk.run_hashes(data, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(self.size)])
        assert len(starts) == bounds[-1] and len(lengths) == len(texts)
        total = tk.prefix_hash(hashes)
        self.hash = tk.window_hash(total, bounds[:-1], self.size)
        self.shingle = np.minimum(self.size, shingle)
        self.sizes = [int(n) for n in np.unique(self.shingle)]
        keys, owner, position = [], [], []
        for n in self.sizes:
            mine = np.flatnonzero(self.shingle == n)
            count = self.size[mine] - n + 1
            who = np.repeat(mine, count)
            at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            keys.append(tk.window_hash(total, bounds[who] + at, n) ^ np.uint64(n))
            owner.append(who)
            position.append(at)
        self.keys, self.owner, self.position = map(np.concatenate, (keys, owner, position))
        self.known = np.unique(self.keys)

    def choose(self, frequency: np.ndarray) -> None:
        """Keep for each window the shingle that is rarest by frequency (of known)."""
        of = frequency[np.searchsorted(self.known, self.keys)]
        order = np.lexsort((self.position, self.keys, of, self.owner))
        first = order[np.concatenate([[True], np.diff(self.owner[order]) > 0])]
        first = first[np.argsort(self.keys[first], kind="stable")]
        self.prefix, self.lead, self.at = self.keys[first], self.owner[first], self.position[first]
        self.tokens, self.begin = np.unique(self.prefix, return_index=True)
        self.begin = np.append(self.begin, len(self.prefix))
        del self.keys, self.owner, self.position, self.known


class Lookup:
    """Membership of 64-bit keys: a bit per hash slot first, a binary search for what passes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - min(26, max(10, int(len(keys) * 16).bit_length())))
        self.seen = np.zeros(1 << int(64 - self.shift), dtype=bool)
        self.seen[(keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and their indexes in keys."""
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        ok = k < len(self.keys)
        at, k = at[ok], k[ok]
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def _tokens(data: np.ndarray, offsets: np.ndarray, sizes: list[int]):
    starts, ends, bounds = tk.runs(data, offsets, tk.ALNUM)
    folded = tk.FOLD[data]
    total = tk.prefix_hash(tk.run_hashes(folded, starts, ends))
    for n in sizes:
        at, row = tk.window_starts(bounds, n)
        yield n, at, row, tk.window_hash(total, at, n) ^ np.uint64(n), starts, ends, bounds, total


def shingle_counts(docs: DataFrame, block: Block, text_col: str) -> np.ndarray:
    """How often each known shingle of the block occurs in all documents."""
    known, sizes = block.known, block.sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        look, sums = Lookup(known), np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0)):
                for _, _, _, h, *_ in _tokens(data, offsets, sizes):
                    _, k = look.find(h)
                    sums += np.bincount(k, minlength=len(known))
        k = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(k), pa.array(sums[k])], names=["k", "n"])

    out = np.zeros(len(known), dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def _matches(block: Block, look: Lookup, data: np.ndarray, offsets: np.ndarray):
    """Exact occurrences in one chunk: arrays of first word, end word, row, window; and word bounds."""
    found, bounds = [], None
    for n, at, row, h, starts, ends, bounds, total in _tokens(data, offsets, block.sizes):
        hit, token = look.find(h)
        if not len(hit):
            continue
        count = block.begin[token + 1] - block.begin[token]
        entry = np.repeat(block.begin[token], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        who, hit = block.lead[entry], np.repeat(hit, count)
        first, size, r = at[hit] - block.at[entry], block.size[who], row[hit]
        ok = (block.shingle[who] == n) & (first >= bounds[r]) & (first + size <= bounds[r + 1])
        first, size, r, who = first[ok], size[ok], r[ok], who[ok]
        ok = tk.window_hash(total, first, size) == block.hash[who]
        first, size, r, who = first[ok], size[ok], r[ok], who[ok]
        raw = data.tobytes() if len(first) else b""
        same = [b" ".join(raw[starts[a] : ends[a + m - 1]].translate(_SEPARATORS).split()) == block.words[w] for a, m, w in zip(first.tolist(), size.tolist(), who.tolist(), strict=True)]
        same = np.array(same, dtype=bool)
        found.append((first[same], (first + size)[same], r[same], who[same]))
    if bounds is None:
        _, _, bounds = tk.runs(data, offsets, tk.ALNUM)
    if not found:
        return (np.zeros(0, np.int64),) * 4, bounds
    return tuple(map(np.concatenate, zip(*found, strict=True))), bounds


def _spans(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of word intervals as disjoint, sorted intervals."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = "array<struct<start:int,end:int>>"
_SPANS_TYPE = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(block: Block, text_at: int, names: list[str], only_hits: bool):
    """A mapInArrow function: the named input columns and n_words, spans, items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.python_threads()
        look = Lookup(block.tokens)
        for batch in batches:
            n_words, spans, items = [], [], []
            for lo, hi, data, offsets in tk.chunks(batch.column(text_at)):
                (first, end, row, who), bounds = _matches(block, look, data, offsets)
                n_words.append(np.diff(bounds))
                got = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                order = np.argsort(row, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
                    r = int(row[at[0]])
                    got[0][r] = [{"start": a, "end": b} for a, b in _spans(first[at], end[at])]
                    got[1][r] = sorted({i for w in np.unique(who[at]) for i in block.items[w]})
                spans += got[0]
                items += got[1]
            n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            out = [batch.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
            out = pa.record_batch(out, names=[*names, "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return scan


def _merge_spans(spans: list | None) -> list:
    flat = np.array([(s["start"], s["end"]) for s in spans if s] if spans is not None else [], dtype=np.int64).reshape(-1, 2)
    return [{"start": a, "end": b} for a, b in _spans(flat[:, 0], flat[:, 1])]


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 3, keep: list[str] | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = 200_000) -> DataFrame:
    """Every document with n_words, the disjoint word spans hit (spans) and the ids of the items found (items).

    keep: the columns of docs to keep (all by default).
    """
    spark = docs.sparkSession
    ours = ("n_words", "spans", "items")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ours]
    windows = item_windows(items, window, item_text, item_id)
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    inputs = docs.select(*dict.fromkeys([*keep, text_col]))
    schema = T.StructType([inputs.schema[c] for c in keep]).add("n_words", "long").add("spans", _SPANS_TYPE).add("items", T.ArrayType(T.StringType()))
    if not n:
        return _word_counts(inputs, keep, text_col, schema)
    if blocks > 1:
        windows = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))

    def block(k: int) -> Block | None:
        part = windows if blocks == 1 else windows.where(F.col("block") == k)
        rows = [(r.item, r.words, r.size) for r in part.select("item", "words", "size").collect()]  # at most about block_windows
        if not rows:
            return None
        b = Block(rows, shingle)
        b.choose(shingle_counts(docs, b, text_col))
        return b

    if blocks == 1:
        return inputs.mapInArrow(_scan(block(0), inputs.columns.index(text_col), keep, False), schema)
    hits = None
    for k in range(blocks):
        if (b := block(k)) is None:
            continue
        some = docs.select(F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("digest")).mapInArrow(_scan(b, 0, ["digest"], True), f"digest string, n_words long, spans {_SPANS}, items array<string>").dropDuplicates(["digest"])
        hits = some if hits is None else hits.union(some)
    merged = F.udf(_merge_spans, _SPANS, useArrow=True)  # of a contaminated text's few spans, once for each such text
    hits = hits.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", merged("spans"))
    digest, other = free("digest", inputs.columns), free("other", inputs.columns)
    counted = _word_counts(inputs.withColumn(digest, F.sha2(F.col(text_col), 256)), [*keep, digest], text_col, T.StructType(schema.fields[:-3]).add(digest, "string").add("n_words", "long"))
    out = counted.join(hits.withColumnRenamed("digest", other), F.col(digest) == F.col(other), "left")
    none = F.array().cast
    return out.select(*keep, "n_words", F.coalesce("spans", none(_SPANS)).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))


def _word_counts(df: DataFrame, keep: list[str], text_col: str, schema: T.StructType) -> DataFrame:
    """keep and n_words; spans and items, if the schema has them, empty."""
    at, names = df.columns.index(text_col), [f.name for f in schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(tk.runs(data, offsets, tk.ALNUM)[2]) for _, _, data, offsets in tk.chunks(batch.column(at))]
            out = [batch.column(c) for c in keep] + [pa.array(np.concatenate(n) if n else [], pa.int64())]
            if "spans" in names:
                empty = [[]] * batch.num_rows
                out += [pa.array(empty, _SPANS_ARROW), pa.array(empty, pa.list_(pa.string()))]
            yield pa.record_batch(out, names=names)

    return df.mapInArrow(count, schema)


def decontaminate(docs: DataFrame, items: DataFrame, max_share: float = 0.0, **options) -> DataFrame:
    """The documents, columns as they are, of whose words at most max_share are hit."""
    out = contamination(docs, items, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.where((F.size("spans") == 0) | (hit <= F.lit(max_share) * F.col("n_words"))).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
with dw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
iw as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
win as (
  select distinct item, array_to_string(w[k:k + 9], ' ') as s, least(10, len(w)) as n
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from iw where len(w) > 0)),
sizes as (select distinct n from win),
occ as (
  select r, k, n, array_to_string(w[k:k + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from dw, sizes where len(w) >= n)),
hit as (select occ.r, occ.k, occ.n, win.item from occ join win on occ.s = win.s and occ.n = win.n),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hit) group by r),
its as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as l
  from (select distinct r, item from hit where item is not null) group by r)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(l, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (r) left join its using (r)
"""
