"""Folds: goldens, and properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import folds
from lectern.operators.sections import span_cuts, tokens_of

SIZES = st.lists(st.integers(1, 40_000), min_size=1, max_size=40)


def contiguous(sizes):
    out, at = [], 0
    for i, n in enumerate(sizes):
        out.append({"title": f"t{i}", "kind": "chapter" if i % 3 else "front", "start": at, "end": at + n})
        at += n
    return out


def test_goldens():
    assert folds.spaced([0, 30, 60, 120]) == [0, 2, 3]
    parts = folds.split_parts([500] * 20, 3, 2500)
    assert [parts.count(p) for p in (1, 2, 3)] == [3, 8, 9]
    assert folds.split_parts([300, 300], 4) == [1, 2]
    assert folds.split_parts([300] * 5, 1, 900) == [1] * 5
    assert folds.split_parts([], 3) == []
    assert folds.pack([], 10) == []


def test_spans_at_paragraphs():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 50 for i in range(20))
    spans = span_cuts(text, 3)
    assert len(spans) == 3 and all(text[a:].startswith("Paragraph") for a, _ in spans)
    assert span_cuts("", 3) == [(0, 0)] and span_cuts("x" * 100, 4) == [(0, 25), (25, 50), (50, 75), (75, 100)]


@given(st.text("ab. \n", max_size=300), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_spans_cover(text, n):
    spans = span_cuts(text, n)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


@given(SIZES, st.integers(1, 6), st.integers(0, 5000))
@settings(max_examples=80, deadline=None)
def test_parts_are_contiguous(sizes, n, extra):
    parts = folds.split_parts(sizes, n, extra)
    assert parts == sorted(parts) and parts[0] in (1, 2) and max(parts) <= min(n, len(sizes))


@given(SIZES, st.integers(50, 20_000))
@settings(max_examples=80, deadline=None)
def test_groups_fit(sizes, budget):
    groups = folds.pack(sizes, budget)
    assert groups == sorted(groups)
    for g in set(groups):
        mine = [s for s, x in zip(sizes, groups, strict=True) if x == g]
        assert len(mine) == 1 or tokens_of(sum(mine) + 2 * (len(mine) - 1)) <= budget


@given(SIZES)
@settings(max_examples=80, deadline=None)
def test_sections_lose_no_text(sizes):
    sections = contiguous(sizes)
    folded = folds.fold_headings(sections, tokens_of)
    merged = folds.merge_small(folded, tokens_of, 700, 8000)
    for out in (folded, merged):
        assert out[0]["start"] == 0 and out[-1]["end"] == sections[-1]["end"]
        assert all(a["end"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    assert sum(len(m["titles"]) for m in merged) == len(folded)
