"""The registered queries that SQL can't express, and the pipeline's stages, against plain versions on small tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import fingerprint, langid, linededup, mixing, quality
from lectern.llm.queries import QUERIES

from ..oracle import DIR
from .test_near_duplicates import fingerprint as simhash_of
from .test_near_duplicates import roots

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def design(texts):
    """The features, from the definition, of one text after the other."""
    rows = []
    for t in texts:
        b = (t or "").encode()
        words = [w for w in re.split(rb"[ \t-\r]+", b) if w]
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        n, some, filled = len(words), max(1, len(words)), max(1, sum(map(len, words)))
        letters = max(1, sum(c >= 128 or chr(c).isalpha() for c in b))
        symbol, bang = set(b"#$%&*@^~|<>{}[]\\/_=+"), set(b"!?")
        v = {
            "words": n, "word_length": filled / some, "upper": sum(65 <= c <= 90 for c in b) / letters, "digit": sum(48 <= c <= 57 for c in b) / filled, "stop": sum(c in b".,;" for c in b) / filled,
            "symbol": sum(c in symbol for c in b) / filled, "bang": sum(c in bang for c in b) / filled, "short": sum(len(w) <= 3 for w in words) / some, "long": sum(len(w) >= 12 for w in words) / some,
            "marked": sum(any(c in symbol | bang for c in w) for w in words) / some, "line_words": n / (1 + b.count(b"\n")), "repeat": (1 - len(set(low)) / some) * (n > 0),
        }
        x = np.zeros(quality.ONE_HOT)
        x[0], first = 1, 1
        for name, edges in quality.EDGES.items():
            x[first + sum(e <= v[name] for e in edges)] = 1
            first += len(edges) + 1
        rows.append(x)
    return np.array(rows)


def test_quality(spark, docs, labels):
    texts = [t for _, t, _ in docs]
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, DIR).collect()}
    described = quality.described(pa.array(texts, pa.large_string()))
    x = np.zeros((len(docs), quality.WIDTH))
    x[:, : quality.ONE_HOT] = design(texts)
    x[:, quality.ONE_HOT :] = quality._parts(described)[1]
    one_hot = np.zeros((len(docs), quality.ONE_HOT))
    np.put_along_axis(one_hot, quality._parts(described)[0], 1, axis=1)
    assert (one_hot == x[:, : quality.ONE_HOT]).all()
    for t, content in zip(texts[:20], x[:20, quality.ONE_HOT :], strict=True):  # the groups' shares sum to one
        assert abs((content**2).sum() - bool(t.split())) < 0.05
    good = np.array([i in labels and labels[i].quality == 1 and crc(i, 3) != 1 for i, *_ in docs])
    half = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) & 1 for i, *_ in docs])
    every, one, both = x.T @ x, x[good & (half == 0)].T @ x[good & (half == 0)], x[good].T @ x[good]
    a, p = every / every[0, 0], one / one[0, 0]
    score = x @ np.linalg.solve(a + p + np.diag(quality.ridge(one[0, 0])), p[0])
    cell = np.clip((score + 1) * (quality._CELLS / 3), 0, quality._CELLS - 1).astype(int)
    other = good & (half == 1)
    slack = 1.01 * (np.sqrt(np.log(40) / (2 * len(x))) + np.sqrt(np.log(40) / (2 * other.sum())))
    cuts = [((cell >= c).mean(), (cell[other] >= c).mean()) for c in range(quality._CELLS) if (cell[other] >= c).any()]
    prior = min(cuts, key=lambda c: (c[0] + slack) / c[1])
    w = quality.fit(every, both, float(np.clip(prior[0] / prior[1], 0.001, 0.999)))
    want = np.clip((x @ w + 1) / 2, 0, 1)
    for (i, *_), s in zip(docs, want, strict=True):
        assert abs(got[i].score - s) < 1e-3 and got[i].held_out == (crc(i, 3) == 1) and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].predicted, labels[i].quality) for i, *_ in docs if i in labels and crc(i, 3) == 1]
    assert np.mean([a == b for a, b in held]) > 0.9


@pytest.mark.parametrize(("prior", "seed"), [(0.3, 1), (0.6, 2), (0.85, 3)])
def test_prior_without_negatives(spark, prior, seed):
    from .test_models import junk, prose

    rng = np.random.default_rng(seed)
    good = rng.random(3000) < prior
    rows = [(i, prose("xx", int(rng.integers(20, 80)), i) if g else junk(int(rng.integers(20, 80)), i)) for i, g in enumerate(good)]
    # labels are no random sample: of the good texts with even ids half are labelled, of the others none, and no bad one
    known = [(i, 1) for i, g in enumerate(good) if g and i % 2 == 0 and rng.random() < 0.5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = quality.train(quality.features(docs, keep=["doc_id"]), spark.createDataFrame(known, "doc_id long, quality int"))
    assert abs(model.prior - good.mean()) < 0.05


def test_language(spark, docs):
    encoder, sums = langid.Encoder(), {}

    def vector(text):
        low = " ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""])
        out = np.zeros(langid.DIMENSIONS)
        for g, n in Counter(low[k : k + 3] for k in range(len(low) - 2)).items():
            a, b, c = (encoder.letter(0 if x == " " else ord(x)).astype(int) for x in g)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    texts = [(i, t, lang, vector(t)) for i, t, lang in docs]
    for i, _, lang, v in texts:
        if lang is not None and crc(i, 4) != 2:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    matrix = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, t, _, v in texts:
        cosine = matrix @ v / max(np.linalg.norm(v), 1e-9)
        assert got[i].held_out == (crc(i, 4) == 2)
        if any(map(str.isalpha, t)):
            assert abs(got[i].score - max(0, cosine.max())) < 1e-4 and (got[i].lang_pred == names[cosine.argmax()] or np.sort(cosine)[-1] - np.sort(cosine)[-2] < 1e-5)
    held = [(got[i].lang_pred, lang) for i, _, lang in docs if crc(i, 4) == 2]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_mixing(spark, docs, labels):
    got = {r.doc_id: r for r in QUERIES["op6_mixing"](spark, DIR).collect()}
    ids = [i for i, *_ in docs]
    # naive Bayes from the definition; only the hash of a token is Spark's
    words = {i: set(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w) for i, t, _ in docs}
    shape = {i: [re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z\x80-\U0010ffff]+", "a", s))) for s in t.split()] for i, t, _ in docs}
    tokens = [(w, "word") for w in set().union(*words.values())] + [(s, "shape") for s in set().union(*map(set, shape.values()))]
    hashed = spark.createDataFrame(tokens, "w string, seed string").select("w", "seed", F.pmod(F.hash("w", "seed"), F.lit(mixing.BUCKETS)).alias("b"))
    bucket = {(r.w, r.seed): r.b for r in hashed.collect()}
    grams = {i: {bucket[w, "word"] for w in words[i]} | {bucket[s, "shape"] for s in shape[i]} for i in ids}
    name = {(1, 0): "good", (1, 1): "good_toxic", (0, 0): "poor", (0, 1): "poor_toxic"}
    domain = {i: name[r.quality, r.toxic] for i, r in labels.items() if i in grams}
    names = sorted(set(domain.values()))
    seen = np.zeros((len(names), mixing.BUCKETS))
    for i, d in domain.items():
        seen[names.index(d), list(grams[i])] += 1
    prior = np.array([list(domain.values()).count(d) for d in names]) / len(domain)
    everywhere = (seen.sum(axis=0) + 1) / (seen.sum() + mixing.BUCKETS)
    ratio = np.log((seen + 5000 * everywhere) / (seen.sum(axis=1, keepdims=True) + 5000)) - np.log(everywhere)
    for i in ids:
        logs = np.log(prior) + ratio[:, list(grams[i])].sum(axis=1)
        parts = np.exp(np.maximum(logs - logs.max(), -60))
        assert got[i].tokens == len(shape[i]) and np.allclose(got[i].posterior, parts / parts.sum(), atol=1e-3)
    p, n, r = (np.array([got[i][c] for i in ids], dtype=float) for c in ("posterior", "tokens", "rate"))
    wanted = np.array([mixing.TARGETS[d] for d in names]) * n.sum()
    assert (r >= 0).all() and np.abs((p * (r * n)[:, None]).sum(axis=0) / wanted - 1).max() < 1e-6

    # the same fit by plain projected gradient steps: another point of the same residual, none
    x, g = np.ones(len(n)), np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(200_000):
        off = (p * (x * n)[:, None]).sum(axis=0) - wanted
        if np.abs(off / wanted).max() < 1e-6:
            break
        x = np.maximum(0, x - p @ (g @ off))
    assert np.abs(off / wanted).max() < 1e-6
    # both draw the same documents: no rate differs by more than the fits leave open
    assert np.corrcoef(x, r)[0, 1] > 0.99


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(10, [1.0, 0.0])] * 5, "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="not met"):
        fit = mixing.fit_rates(rows, ["a", "b"], {"a": 25.0, "b": 25.0})
    assert not fit.met and abs(fit.reached[0] - 25) < 1e-6 and fit.reached[1] == 0
    fit = mixing.fit_rates(rows.union(spark.createDataFrame([(10, [0.5, 0.5])] * 9, rows.schema)), ["a", "b"], {"a": 100.0, "b": 5.0})
    assert fit.met and np.allclose(fit.reached, [100, 5])


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op9_fingerprint"](spark, DIR).collect()}
    order = sorted(docs, key=lambda r: -r[0])
    sample = lambda t: fingerprint.sample_texts(pa.array([t], pa.large_string()))[0]
    errors = []
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r, a, b, c = got[i], sample(t), sample(edited), sample(after)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:04x}" for x in a) and r.edited_fingerprint == "".join(f"{x:04x}" for x in b)
        assert abs(r.near_edited - (a == b).mean()) < 1e-9 and abs(r.near_next - (a == c).mean()) < 1e-9
        x, y = (Counter(re.split("[ \t-\r]+", s.translate(str.maketrans({chr(u): chr(u + 32) for u in range(65, 91)})))) for s in (t, edited))
        errors.append((a == b).mean() - sum((x & y).values()) / max(1, sum((x | y).values())))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_line_dedup(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, DIR).collect()}
    occ = [(i, k, n) for i, t, _ in docs for k, n in linededup.lines_of(t)]
    names = sorted({n for *_, n in occ})
    size = linededup.SHINGLE
    sets = [{n[j : j + size] for j in range(max(1, len(n) - size + 1))} for n in names]
    long = [len(n) >= size for n in names]
    near = [(a, b) for a in range(len(names)) for b in range(a) if long[a] and long[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    keys = dict(zip((n for n, x in zip(names, long, strict=True) if x), linededup.keys_of([n for n, x in zip(names, long, strict=True) if x], size, linededup.BANDS, linededup.ROWS), strict=True))
    met = [(a, b) for a, b in near if (keys[names[a]] == keys[names[b]]).any()]
    assert len(met) >= 0.98 * len(near) > 0
    group = dict(zip(names, roots(met, len(names)), strict=True))
    first = {}
    for i, k, n in occ:
        first.setdefault(group[n], (i, k))
    for i, t, _ in docs:
        gone = [k for j, k, n in occ if j == i and first[group[n]] != (j, k)]
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert (got[i].n_removed, got[i].removed or [], got[i].n_chars, got[i].kept_sha256) == (len(gone), gone, len(kept), hashlib.sha256(kept.encode()).hexdigest())


def test_simhash(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_simhash"](spark, DIR).collect()}
    fp = [simhash_of(t) for _, t, _ in docs]
    group = roots([(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2], len(fp))
    low = {}
    for (i, *_), g in zip(docs, group, strict=True):
        low[g] = min(low.get(g, i), i)
    for (i, *_), f, g in zip(docs, fp, group, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", low[g])


# ---------------------------------------------------------------- the pipeline

AWKWARD = [
    (1, "The first line of a plain text that is long enough to be kept.\nles.", "en", "s", 5), (1, "The first line of a plain text that is long enough to be kept.\nles.", "en", "s", 5), (None, "no id here but some words to keep", None, None, None),
    (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, " \n\n ", "fr", None, 4), (5, "x" * 200_000 + " tail", "en", "s", 9), (6, "word " * 60_000, "en", "s", 9), (7, "The first line of a plain text that is long enough to be kept.\nand one more", "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["__d", "__i", "__row", "__places", "places", "words", "fp", "bins", "rate0", "digest", "part", "line", "root", "bucket"]


def words10(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_stages(spark, docs):
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)
    whole = spark.read.parquet(f"{DIR}/documents.parquet")
    scores = {r.doc_id: r.score for r in QUERIES["op2_quality"](spark, DIR).collect()}
    one = stage["quality classifier"](spark, whole, DIR)
    assert one.columns == whole.columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, s in scores.items() if s >= 0.5)

    removed = {r.doc_id: set(r.removed or []) for r in QUERIES["op7_line_dedup"](spark, DIR).collect()}
    want = {}
    for i, t, _ in docs:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[i])
        if kept.strip() or not removed[i]:
            want[i] = (kept, len(kept))
    two = stage["line dedup"](spark, whole, DIR)
    assert two.columns == whole.columns and {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == want

    fp = [simhash_of(t) for _, t, _ in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (re.findall("[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, t, _ in docs)]
    link = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2 or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = roots(link, len(fp))
    low = {g: min(i for (i, *_), h in zip(docs, group, strict=True) if h == g) for g in group}
    three = stage["simhash near-dedup"](spark, whole, DIR)
    assert three.columns == whole.columns and sorted(r.doc_id for r in three.collect()) == sorted(low.values()) and len(low) < len(docs)

    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words10(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = [i for i, t, _ in docs if not any(tuple(w[k : k + n]) in windows for w in [words10(t)] for n in sizes for k in range(len(w) - n + 1))]
    four = stage["benchmark decontamination"](spark, whole, DIR)
    assert four.columns == whole.columns and sorted(r.doc_id for r in four.collect()) == clean and len(clean) < len(docs)

    five = stage["mixing to target weights"](spark, whole, DIR)
    assert five.columns[: len(whole.columns)] == whole.columns
    rates = {r.doc_id: (r.tokens, round(r.rate, 9), r.copies >= 0) for r in QUERIES["op6_mixing"](spark, DIR).collect()}
    assert {r.doc_id: (r.tokens, round(r.rate, 9), r.copies >= 0) for r in five.collect()} == rates


def test_awkward_rows_in_every_stage(spark):
    import corpus_pipeline as cp

    plain = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)
    clash = plain.select("*", *[F.lit(c).alias(c) for c in CLASH])
    least = {"quality classifier": 0, "line dedup": 5, "simhash near-dedup": 4, "benchmark decontamination": 9, "mixing to target weights": 9}
    for name, stage in cp.STAGES:
        for given in (plain, clash):
            out = stage(spark, given, DIR)
            rows = out.collect()
            assert out.columns[: len(given.columns)] == given.columns and least[name] <= len(rows) <= len(AWKWARD)
            assert given is plain or all(r[c] == c for r in rows for c in CLASH)
        empty = stage(spark, plain.limit(0), DIR)
        assert empty.count() == 0 and empty.columns == stage(spark, plain, DIR).columns


def test_queries_on_empty_tables_and_nulls(spark, tmp_path):
    schemas = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}
    rows = {"documents": AWKWARD, "labels": [(1, 1, 0), (None, 0, 1), (3, None, None), (5, 0, 0), (5, 1, 1)], "benchmark": [(1, None), (None, "no id here but some words"), (2, "")], "pages": [(1, None, None), (None, "http://a.example.com/en/", "x" * 300), (2, "", ""), (2, "nothing", "x" * 300)]}
    for kind, data in (("empty", {}), ("awkward", rows)):
        for name, schema in schemas.items():
            spark.createDataFrame(data.get(name, []), schema).write.parquet(f"{tmp_path}/{kind}/{name}.parquet")
        for name, query in QUERIES.items():
            n = len(data.get("pages" if name in ("op3_url_filter", "op5_warc") else "documents", []))
            assert query(spark, f"{tmp_path}/{kind}").count() == n, (kind, name)
