"""Decontamination against a direct search, with nulls, empty tables, repeats and clashing columns."""

import re

import pytest

from lectern.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_words string, spans string, extra int"


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, v in windows:
            for k in range(len(w) - len(v) + 1):
                if w[k : k + len(v)] == v:
                    hit.update(range(k, k + len(v)))
                    found.add(str(i)) if i is not None else None
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 17}x{i % 5}" for i in range(60))
ITEMS = [(1, LONG), (2, "Three little WORDS"), (3, "é"), (4, None), (5, ""), (6, "!!"), (None, "secret item words here"), (2, "another text of item two"), (1, LONG)]
TEXTS = [LONG, "so " + LONG[30:] + " " + LONG, "three little words three, little. WORDS", "Xé é", None, "", "a secret item words here b", "another text of item two", "nothing at all", "w0x0 " * 200, LONG]


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_brute_force(spark, block):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[2])]
    df = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in docs], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = dc.contamination(df, items, block_windows=block)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "spans", "items"]
    rows = sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got.collect()], key=str)
    assert rows == brute(docs, ITEMS)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert [r.n_words for r in dc.contamination(df, items.limit(0)).collect()] == [60]
    assert dc.contamination(df.limit(0), items).count() == 0
    assert dc.decontaminate(df, items).count() == 0 and dc.decontaminate(df, items.where("item_id = 3")).columns == df.columns


def test_kept_share(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j three little words"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert [r.doc_id for r in dc.decontaminate(df, items).collect()] == [2]
    assert dc.decontaminate(df, items, 0.5).count() == 2
