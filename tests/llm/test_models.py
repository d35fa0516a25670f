"""Quality, language, mixing and fingerprints: accuracy, estimates and edge cases."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from lectern.llm import fingerprint as fg
from lectern.llm import langid, mixing, quality

random.seed(9)
VOCAB = {lang: ["".join(random.choice(letters) for _ in range(random.randrange(2, 8))) for _ in range(300)] for lang, letters in {"xx": "abcdefghe", "yy": "klmnopqro", "zz": "стуфхцчщ"}.items()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB[lang]) for _ in range(n)).capitalize() + "."


def junk(n, seed):
    r = random.Random(seed)
    return " | ".join(r.choice(VOCAB["xx"]).upper() + "!!" for _ in range(n))


def test_language(spark):
    rows = [(i, prose(lang, 30, i), lang, "clash") for i, lang in enumerate(["xx", "yy", "zz"] * 30)]
    rows += [(200, None, "xx", "c"), (201, "", "yy", "c"), (202, "12 !?", "zz", "c"), (203, prose("zz", 9000, 1), None, "c"), (None, prose("xx", 5, 2), "xx", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = langid.prototypes(docs.where("doc_id < 60"))
    assert sorted(profiles) == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:90]) and got[203].lang_pred == "zz" and got[None].lang_pred == "xx"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202)) and all(0 <= r.score <= 1 for r in got.values())
    assert langid.prototypes(docs.limit(0)) == {} and {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), profiles).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    e = langid.Encoder(64)
    got = next(e.bundles(["Ab, a"]))[1][0]
    v = [np.zeros(64)]
    for g in (" ab", "ab ", "b a", " a "):
        a, b, c = (e.letter(0 if x == " " else ord(x)).astype(int) for x in g)
        v.append(np.roll(a, 2) * np.roll(b, 1) * c)
    assert np.array_equal(got, sum(v))


def test_quality(spark):
    rows = [(i, prose("xx", 60, i) if i % 4 else junk(60, i), "c") for i in range(240)] + [(900, None, "c"), (901, "", "c"), (None, prose("xx", 60, 1), "c"), (3, prose("xx", 60, 3), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 240, 3)] + [(None, 1), (5, None), (7, 1), (7, 1)], "doc_id long, quality int")
    feats = quality.features(docs, keep=["doc_id"])
    model = quality.train(feats, labels)
    got = {r.doc_id: r.score for r in model.score(feats).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 243
    assert all((got[i] >= 0.5) == (i % 4 > 0) for i in range(240))
    kept = model.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id < 240").collect()} == {i for i in range(240) if i % 4}
    none = quality.train(feats, labels.limit(0))
    assert {r.score for r in none.score(feats).collect()} == {0.5} and model.keep(docs.limit(0)).count() == 0
    assert quality.train(feats.limit(0), labels).prior == 0.5


def test_risk_is_not_negative():
    rng = np.random.default_rng(1)
    x = np.zeros((400, quality.WIDTH))
    x[:, 0] = 1
    x[np.arange(400), 1 + rng.integers(0, 30, 400)] = 1
    every, positive = x.T @ x, x[:5].T @ x[:5]
    w = quality.fit(every, positive, 0.9)
    unlabelled = ((x @ w + 1) ** 2).mean() - 0.9 * ((x[:5] @ w + 1) ** 2).mean()
    assert np.all(np.isfinite(w)) and unlabelled > -0.05


def test_mixing(spark):
    rows = [(i, prose("xx", 20 + i % 9, i) if i % 5 else junk(20, i), "c") for i in range(150)] + [(900, None, "c"), (901, "", "c"), (None, prose("xx", 30, 7), "c"), (4, prose("xx", 24, 4), "c"), (4, prose("xx", 24, 4), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 150, 3)] + [(None, 1, 0), (2, None, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    for targets in ({"good": 0.5, "poor": 0.5}, {"good": 1.0}):
        out = mixing.mix(docs, labels, targets)
        assert out.columns == ["doc_id", "text", "tokens", "posterior", "rate", "copies"] and out.count() == len(rows)
        got = out.collect()
        p, n, r = (np.array([x[c] for x in got], dtype=float) for c in ("posterior", "tokens", "rate"))
        assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1) and all(abs(x.copies - x.rate) < 1 for x in got)
        shares = (p * (n * r)[:, None]).sum(axis=0) / n.sum()
        assert np.allclose(shares, [targets.get(d, 0) for d in ("good", "poor")], atol=0.01)
        assert {x.tokens for x in got if not x.text} == {0}
    assert mixing.mix(docs, labels.limit(0)).where("rate = 1").count() == len(rows)
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_posteriors_tell_domains(spark):
    rows = [(i, prose("xx", 40, i) if i % 2 else junk(40, i)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 3)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, keep=["doc_id"], smoothing=50).collect()
    mean = [np.mean([r.posterior[0] for r in got if r.doc_id % 2 == k]) for k in (0, 1)]
    assert mean[1] - mean[0] > 0.5


def generalised(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(2)
    errors = []
    for k in range(60):
        a = prose("xx", rng.randrange(5, 400), k).split()
        b = a[: len(a) * rng.randrange(1, 10) // 10] + prose("yy", rng.randrange(1, 200), k).split()
        a, b = " ".join(a), " ".join(b)
        import pyarrow as pa

        x = fg.sample_texts(pa.array([a, b]), 1024)
        errors.append((x[0] == x[1]).mean() - generalised(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.02


def test_fingerprints(spark):
    rows = [(i, t, "c") for i, t in enumerate(["a b c", "A  b\nc", None, "", " ", "a a a b", "x" * 300_000, "a b c"])]
    got = {r.doc_id: r.fingerprint for r in fg.fingerprint(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()}
    assert got[0] == got[1] == got[7] and got[2] == got[3] == got[4] == "0" * 256 and "0000" not in [got[0][i : i + 4] for i in range(0, 256, 4)]


def test_low_draws_give_what_all_draws_give(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [1, 0, 5000, 127, 128, 129, 700, 0, 300, 40_000]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = rng.integers(0, 2**63, 30_000, dtype=np.uint64)[rng.integers(0, 30_000, len(rows))]
    weights = np.where(rng.random(len(rows)) < 0.8, 1.0, rng.choice([0.01, 0.5, 2, 3, 1000], len(rows)))
    for case in (weights, np.ones(len(rows), np.int64), np.full(len(rows), 1e-6)):
        got = fg.weighted_samples(rows, terms, case, len(sizes))
        with monkeypatch.context() as patch:
            patch.setattr(fg, "FEW", np.inf)
            assert (got == fg.weighted_samples(rows, terms, case, len(sizes))).all()
        with monkeypatch.context() as patch:
            patch.setattr(fg, "FEW", 0)  # rows of few words, and a bound that many samples of theirs don't reach
            patch.setattr(fg, "LOW", 0.001)
            patch.setattr(fg, "_CELLS", 1 << 10)
            assert (got == fg.weighted_samples(rows, terms, case, len(sizes))).all()
        assert ((got == 0).all(axis=1) == (np.array(sizes) == 0)).all() and ((got == 0).any(axis=1) == (np.array(sizes) == 0)).all()


def test_draws_are_made_in_bounded_memory():
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 60_000, 400)) for _ in range(300)], pa.large_string())
    tracemalloc.start()
    try:
        fg.sample_texts(texts)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20  # 64 draws of 52,000 words take 27 MB for each number of 8 bytes
    finally:
        tracemalloc.stop()


def digest(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_edited_texts_follow_the_order(spark, tmp_path):
    rows = [(9, "abcdefghi", 1), (7, "xy", 1), (5, None, 1), (5, "zzz", 1), (3, "é\U0001f600é" * 4, 1), (None, "last", 1), (None, "last of all", 1)] + [(-i, f"t{i} " * (i % 7), 1) for i in range(1, 60)]
    for n, data in (("all", rows), ("one", rows[:1]), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang int").repartition(3).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = fg.op9_fingerprint(spark, f"{tmp_path}/{n}").collect()
        order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1] or "")))
        texts = [r[1] or "" for r in order]
        import hashlib

        want = [(r[0], len(t), hashlib.sha256(fg.edited_text(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(order, texts, strict=True))]
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
        assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)


def test_neighbours_are_dealt_evenly(spark):
    ids = {"an outlier": [*range(2000), 4 * 10**18], "the ends of the type": [*range(-(2**63), -(2**63) + 900), *range(2**63 - 900, 2**63)], "a hot id": [7] * 700 + list(range(1300)), "no id": [None] * 700 + list(range(1300))}
    for name, some in ids.items():
        rows = [(i, f"text {k}") for k, i in enumerate(some)]
        df = fg.by_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text")
        got = [r for part in df.rdd.glom().collect() for r in part]
        sizes = Counter(r.bucket for r in got)
        assert max(sizes.values()) < 3 * len(rows) / len(sizes) and len(sizes) >= 12, name
        # buckets hold consecutive rows of the order, and each ends with the first row of the next one
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
        place = {r: k for k, r in enumerate(order)}
        after = {}
        for bucket in sizes:
            here = [(r.id, r.text, r.ghost) for r in got if r.bucket == bucket]
            assert [g for *_, g in here] == [0] * (len(here) - 1) + [1]
            for a, b in zip(here, here[1:], strict=False):
                after[a[:2]] = b[:2]
        assert all(place[b] == (place[a] + 1) % len(order) for a, b in after.items()) and len(after) == len(order), name
