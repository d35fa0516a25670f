"""SimHash and line dedup against brute force; components; edge cases."""

import gc
import random
import time

import numpy as np
import xxhash

from lectern.llm import linededup, shared, simhash

random.seed(5)
BASE = [f"word{random.randrange(4000)}" for _ in range(400)]


def near(n):
    w = list(BASE)
    w[n % len(w)] = f"changed{n}"
    return " ".join(w)


def fingerprint(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(links, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(spark):
    texts = [near(i) for i in range(60)] + ["A b", "a  B", "", None, " \n", "\u00a0", "one two three four", "É é", "x " * 700, " ".join(BASE)] * 2
    rows = [(i if i % 11 else None, t, "c") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = [(i, f"{fingerprint(t):016x}") for i, t, _ in rows]
    assert sorted([(r.doc_id, r.fingerprint) for r in got], key=str) == sorted(want, key=str)
    fp = [int(f, 16) for _, f in want]
    group = roots([(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2], len(fp))
    least = {}
    for (i, _), g in zip(want, group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert sorted([(r.fingerprint, str(r.component_id)) for r in got]) == sorted((f, str(least[g])) for (_, f), g in zip(want, group, strict=True))


def test_grid_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    points = sorted({s ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 62, (12, 2))} | set(seeds))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    want = roots([(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= 2], len(points))
    low = {}
    for i, g in enumerate(want):
        low.setdefault(g, i)
    assert got == {i: low[g] for i, g in enumerate(want)}


def test_one_of_each_stays(spark):
    rows = [(3, "a b c", 1), (1, "A B C", 2), (1, "a b c", 3), (2, "other text here", 1), (2, "other text here", 1), (None, "a b c", 9), (None, "only null", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp int")
    got = simhash.keep_one(df.withColumnRenamed("__fp", "lang"))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"] and got.columns == ["doc_id", "text", "lang"]
    assert simhash.keep_one(df.withColumnRenamed("__fp", "lang").limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (7, 7), (None, 3), (500, 499), (499, 500)]
    chain += [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(chain, "a long, b long")
    for alone in (0, 50, shared.ALONE):  # rounds to the end, rounds and a task, a task
        got = {r.id: r.root for r in shared.star_components(df, alone=alone).collect()}
        assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200, 202: 200, 499: 499, 500: 499} | {i: 1000 for i in range(1000, 1301)}
    assert shared.star_components(df.limit(0)).count() == shared.star_components(df.limit(0), alone=-1).count() == 0


def test_shared_buckets(spark):
    rng = random.Random(2)
    rows = [(i % 400, [rng.randrange(900) << 30 for _ in range(rng.randrange(4))] + [7 << 50] * (i % 3 == 0)) for i in range(700)]
    want = {}
    for i, keys in rows:
        for k in keys:
            want.setdefault(k, set()).add(i)
    want = {(k, i) for k, ids in want.items() if len(ids) > 1 for i in ids}
    held = shared.HELD
    try:
        for shared.HELD in (held, 3):
            got = shared.shared_buckets(spark.createDataFrame(rows, "id long, keys array<long>")).collect()
            assert {(r.bucket, r.id) for r in got} == want
            assert all((r.bucket, r.low) in want for r in got) and len({(r.bucket, r.low) for r in got}) == len({k for k, _ in want})
    finally:
        shared.HELD = held


def test_bucket_links_lose_no_link(spark):
    rng = random.Random(4)
    sets = {}
    for g in range(5):  # groups around a base, many pairs just under and over the threshold
        base = rng.sample(range(1000 * g, 1000 * g + 700), 120)
        for _ in range(24):
            gone = set(rng.sample(base, rng.randrange(2, 16)))
            sets[len(sets)] = frozenset([x for x in base if x not in gone] + [rng.randrange(10**6) for _ in range(rng.randrange(12))])
    hashes = {x: int(h) for x in {x for s in sets.values() for x in s} for h in [np.uint64(xxhash.xxh64_intdigest(str(x)))]}
    buckets = {i: sorted({min(sets[i]) // 1000 * 10 + d for d in (0, i % 2, i % 3)}) for i in sets}

    def jaccard(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    rows = []
    for i, s in sets.items():
        h = np.sort(np.array([hashes[x] for x in s], dtype=np.uint64))
        rows.append((i, len(s), *(int(x) for x in shared.parity_sketch(h, np.zeros(len(h), np.int64), 1, shared.WORDS)[0]), buckets[i]))
    described = spark.createDataFrame(rows, f"id long, n long, {', '.join(f'{s} long' for s in shared.SKETCH)}, keys array<long>")
    compared = []

    def verify(pairs):
        got = [(r.a, r.b) for r in pairs.collect()]
        compared.extend(got)
        return spark.createDataFrame([p for p in got if jaccard(*p) >= 0.8], "a long, b long")

    members = shared.shared_buckets(described)
    want = roots([(a, b) for a in sets for b in range(a) if jaccard(a, b) >= 0.8 and set(buckets[a]) & set(buckets[b])], len(sets))
    low = {}
    for i, g in enumerate(want):
        low.setdefault(g, i)
    for rounds in (0, 2):
        got = {r.id: r.root for r in shared.bucket_links(members, verify, lambda ids: described.join(ids, "id", "left_semi"), 0.8, rounds=rounds).collect()}
        assert got == {i: low[g] for i, g in enumerate(want) if want.count(g) > 1}
    assert len(compared) < len(sets) ** 2 / 2


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (3, 200, 3000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, n // 3, dtype=np.uint64)]))
        s = [shared.parity_sketch(v, np.zeros(len(v), np.int64), 1, shared.WORDS).view(np.uint64) for v in (x, y)]
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(x, y))


def lines(n):
    rng = random.Random(n)
    return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(10**6)}" for _ in range(40))


def test_line_dedup_against_brute_force(spark):
    base = [lines(i) for i in range(12)]
    texts = ["\n".join([base[i % 12], base[(i * 5) % 12][:-9] + f" end{i}", f"own {lines(100 + i)}", "short", ""]) for i in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, texts[3], "x"), (40, None, "x"), (41, "", "x"), (42, "a\n" + "b" * 70_000, "x"), (43, "b" * 70_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, places string")
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    occ = [(i is None, i or 0, k, n) for i, t, _ in rows for k, n in linededup.lines_of(t)]
    names = sorted({n for *_, n in occ})
    same = [(a, b) for a in range(len(names)) for b in range(a) if len(names[a]) < 9999 > len(names[b]) and linededup.jaccard(names[a], names[b]) >= 0.8]
    group = dict(zip(names, roots(same, len(names)), strict=True))
    first = {}
    for null, i, k, n in sorted(occ):
        first.setdefault(group[n], (null, i, k))
    want, seen = [], set()
    for i, t, _ in rows:
        gone = {k for k, n in linededup.lines_of(t) if first[group[n]] != (i is None, i or 0, k) or (i, t) in seen}
        seen.add((i, t))
        want.append((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    assert got == sorted(want, key=str)
    kept = linededup.dedup_lines(df, drop_emptied=True)
    assert {40, 41} <= {r.doc_id for r in kept.select("doc_id").collect()} and 43 not in {r.doc_id for r in kept.select("doc_id").collect()}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_pair_decisions_are_exact():
    rng = random.Random(8)
    for _ in range(60):
        a = lines(rng.randrange(5))
        w = a.split(" ")
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = "zz"
        b = " ".join(w)
        x, y = (np.unique(linededup.shingle_hashes([s], 8)[0]) for s in (a, b))
        assert linededup.similar(a, b, x, y, 0.8, 8) == (linededup.jaccard(a, b, 8) >= 0.8)


def test_short_lines_lose_their_copies(spark):
    rows = [(1, "les.\n\n日本語の文。\nx"), (2, "  LES. \n\nles\n日本語の文。"), (3, "x\nles.\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "\nles", 3: " "}


def test_five_word_similarity_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(16):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([90, 200]))]
        for edits in (0, 1, 3, 12):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, "too short"), (101, "Too  short"), (102, ""), (None, rows[0][1])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    fp = [fingerprint(t) for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum((fp[a] ^ fp[b]).bit_count() > 2 for a, b in alike) >= 5
    group = roots(alike + [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2], len(rows))
    want = {g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None) for g in group}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, similarity=0.8).collect()) == sorted(want.values())
    assert simhash.keep_one(df.limit(0), similarity=0.8).count() == 0


def test_lines_with_a_replaced_word_are_near(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]
    base = [rng.sample(words, 12) for _ in range(20)]
    edited = [[*w[:7], f"x{i}", *w[8:]] for i, w in enumerate(base)]
    texts = ["\n".join(" ".join(w) for w in part) for part in (base, edited)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(linededup.jaccard(a, b, linededup.SHINGLE) >= 0.8 > linededup.jaccard(a, b, 8) for a, b in zip(*(t.split("\n") for t in texts), strict=True))
    assert got == {0: texts[0], 1: ""}


def test_recall_of_the_bands():
    rng = random.Random(12)
    met, pairs = [0, 0], [0, 0]
    for _ in range(700):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)).strip()
        b = a
        while (s := linededup.jaccard(a, b)) >= 0.8:
            k = rng.randrange(len(b))
            last, b = b, b[:k] + rng.choice("ABCDEF") + b[k + 1 :]
        a, b = a, last  # the last one at the threshold or above
        s = linededup.jaccard(a, b)
        x, y = linededup.keys_of([a, b], linededup.SHINGLE, linededup.BANDS, linededup.ROWS)
        at = s >= 0.82
        pairs[at] += 1
        met[at] += bool(set(x) & set(y))
    assert pairs[0] > 300 and met[0] / pairs[0] >= 0.985


def test_slices_do_not_change_signatures():
    rng = random.Random(13)
    some = ["".join(rng.choice("abc é日") for _ in range(rng.choice([5, 6, 40, 300]))) for _ in range(60)]
    one = [linededup.signatures([s], linededup.SHINGLE, 12)[:, 0] for s in some]
    assert (linededup.signatures(some, linededup.SHINGLE, 12).T == np.array(one)).all()
    for s in some:
        got, bounds = linededup.shingle_hashes([s], linededup.SHINGLE)
        assert len(np.unique(got)) == len({s[i : i + linededup.SHINGLE] for i in range(len(s) - linededup.SHINGLE + 1)}) and bounds[-1] == len(got)


def test_repeated_rows_keep_one(spark):
    text, other = "a line of some length that is repeated\nles.", "other words in this line\n"
    rows = [(1, text, 1, 2), (1, text, 1, 2), (None, text, 3, 4), (None, text, 3, 4), (0, other, 5, 6), (0, other, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, places int, __digest int").repartition(3)
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    assert got == sorted([(1, text), (1, ""), (None, ""), (None, ""), (0, other), (0, "")], key=str)


def test_string_ids(spark):
    rows = [("b", "the same line of text in both"), ("a", "the same line of text in both")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": rows[1][1], "b": ""}


def test_bucket_links_verify_what_the_bounds_allow(spark):
    rng = random.Random(9)
    base = rng.sample(range(10**6), 100)
    sets = {0: set(rng.sample(range(10**6), 100)), 1: set(base[:60])}  # the lows: unlike, and too small
    sets |= {i: set(base) - {base[i]} for i in range(2, 12)}
    hashes = {x: int(h) for x in set().union(*sets.values()) for h in [np.uint64(xxhash.xxh64_intdigest(str(x)))]}
    rows = [(i, len(s), *(int(x) for x in shared.parity_sketch(np.array([hashes[x] for x in s], dtype=np.uint64), np.zeros(len(s), np.int64), 1, shared.WORDS)[0]), [b for b in (0, 1) if i >= b]) for i, s in sets.items()]
    described = spark.createDataFrame(rows, f"id long, n long, {', '.join(f'{s} long' for s in shared.SKETCH)}, keys array<long>")
    members = spark.createDataFrame([(b, i, b) for b in (0, 1) for i in sets if i >= b], "bucket long, id long, low long")
    compared = []

    def verify(pairs):
        got = [(r.a, r.b) for r in pairs.collect()]
        compared.extend(got)
        return spark.createDataFrame([(a, b) for a, b in got if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], "a long, b long")

    got = {r.id: r.root for r in shared.bucket_links(members, verify, lambda ids: described, 0.8).collect()}
    assert got == {i: 2 for i in range(2, 12)}
    assert compared and not {x for pair in compared for x in pair} & {0, 1}


def test_line_dedup_lets_its_exchanges_go(spark):
    def exchanges():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    base = [lines(i) for i in range(12)]
    df = spark.createDataFrame([(i, "\n".join([base[i % 12], base[i * 5 % 12][:-9] + f" end{i}"])) for i in range(30)], "doc_id long, text string")
    for _ in range(3):  # those of other tests
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
    before = exchanges()
    joined, _ = linededup.with_losses(df)
    for _ in range(20):  # they are deleted in the background
        if exchanges() - before <= 10:
            break
        time.sleep(0.5)
    assert exchanges() - before <= 10
    assert joined.count() == 30
