"""Folds over the ordered rows of a key.

The greedy steps of sectioning compare a row with what was kept so far, which no window function can
express. A key's rows (offsets and sizes, never texts) come to one task in order and pass through a
plain Python generator, in time linear in their number. A key is one book.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], step: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """step gets a key's rows as dicts, sorted by order, and yields result rows of the schema."""
    names = [part.split()[0] for part in _fields(schema)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = list(step(group.sort_values(order, kind="stable").to_dict("records")))
        return pd.DataFrame({n: pd.Series([r[n] for r in found], dtype=object) for n in names}).infer_objects()

    return rows.groupBy(*key).applyInPandas(run, schema)


def _fields(schema: str) -> Iterator[str]:
    depth, part = 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            yield part.strip()
            part = ""
        else:
            part += c
    yield part.strip()


def spaced(offsets: list[int], least: int = 40) -> list[int]:
    """Positions kept of sorted offsets: each at least least after the one kept before."""
    out: list[int] = []
    for i, offset in enumerate(offsets):
        if not out or offset - offsets[out[-1]] >= least:
            out.append(i)
    return out


def fold_headings(sections: list[dict], tokens: Callable[[int], int], least: int = 150) -> list[dict]:
    """Sections (start, end, ...) without those of under least tokens, whose text goes to the next section
    where that begins at their end. The last section stays whatever its size."""
    out, carried = [], None
    for i, s in enumerate(sections):
        start = carried["start"] if carried is not None and carried["end"] == s["start"] else s["start"]
        carried = None
        grown = {**s, "start": start}
        if tokens(s["end"] - start) < least and i < len(sections) - 1:
            carried = grown
        else:
            out.append(grown)
    return out


def merge_small(sections: list[dict], tokens: Callable[[int], int], least: int, most: int) -> list[dict]:
    """Sections joined with the one before while one of the two is under least tokens and both fit into most."""
    out: list[dict] = []
    for s in sections:
        item = {"titles": [s["title"]], "kind": s["kind"], "start": s["start"], "end": s["end"]}
        if out:
            last = out[-1]
            before, now = tokens(last["end"] - last["start"]), tokens(s["end"] - s["start"])
            if min(before, now) < least and before + now <= most and last["end"] == s["start"]:
                last["titles"].append(s["title"])
                last["end"] = s["end"]
                last["kind"] = "chapter" if s["kind"] == "chapter" else last["kind"]
                continue
        out.append(item)
    return out


def pack(lengths: list[int], budget: int, joiner: int = 2) -> list[int]:
    """Group number (from 1) of texts of the given lengths, filled in order up to budget tokens of the joined
    text; a group has one text at least."""
    out, group, total = [], 1, -1
    for n in lengths:
        joined = n if total < 0 else total + joiner + n
        if total >= 0 and joined * 5 // 18 + 1 > budget:
            group, joined = group + 1, n
        total = joined
        out.append(group)
    return out


def split_parts(sizes: list[int], parts: int, first_extra: int = 0) -> list[int]:
    """Part number (from 1) of chapters of the given sizes: contiguous parts of like sums, the first of which
    also carries first_extra.

    A part ends before the first chapter whose middle lies beyond the part's share, counted from the
    part's start; middles ascend, so bisection finds it. It ends earlier where the chapters left are as
    many as the parts to come, and not before it has any load.
    """
    count = len(sizes)
    n = max(1, min(parts, count))
    before = [0, *accumulate(sizes)]
    middle = [before[i] + size / 2 for i, size in enumerate(sizes)]
    share = (before[-1] + first_extra) / n
    starts, base = [0], -first_extra
    for k in range(1, n):
        loaded = bisect_right(before, base, starts[-1] + (k > 1))  # the first chapter with some load before it
        by_share = bisect_right(middle, base + share, starts[-1] + (k > 1))
        by_need = count - (n - k)
        cut = max(loaded, by_share) if by_need < loaded else min(max(loaded, by_share), by_need)
        if cut >= count:
            break
        starts.append(cut)
        base = before[cut]
    return [bisect_right(starts, i) for i in range(count)]
