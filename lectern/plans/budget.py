"""Word and minute budgets, as column expressions, and the split into reading parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import ordered_fold, split_parts

WORDS_PER_MINUTE, OVERVIEW_MOST = 230, 2600

#: Words an item of a list takes, and the least and most items of it.
CAPS = {"arguments": (90, 2, 5), "frameworks": (200, 1, 3), "data_points": (200, 1, 4), "examples": (250, 1, 2), "quotes": (200, 2, 3), "takeaways": (120, 2, 4)}


def note_caps(words: Column) -> Column:
    """struct of the most items of each list of a chapter's notes, from the chapter's word budget (600 if null or 0)."""
    w = F.coalesce(F.nullif(words, F.lit(0)), F.lit(600)).cast("double")
    return F.struct(*[F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(w / F.lit(float(per))).cast("int"))).alias(name) for name, (per, lo, hi) in CAPS.items()])


def words_of_tokens(tokens: Column) -> Column:
    return F.floor(tokens * 3 / F.lit(4)).cast("long")


def read_plan(wanted: Column, part: Column, most: Column) -> Column:
    """struct<lo, hi, minutes, parts>: reading minutes within bounds and the parts they make."""
    hi = F.greatest(F.lit(10), most)
    lo = F.greatest(F.lit(5), F.least(part - 10, hi))
    minutes = F.greatest(lo, F.least(hi, wanted))

    def parts(x: Column) -> Column:
        return F.ceil(x / part.cast("double")).cast("int")

    return F.struct(lo.alias("lo"), hi.alias("hi"), minutes.alias("minutes"), F.greatest(F.lit(1), F.least(parts(minutes), parts(hi))).alias("parts"))


def budgets(minutes: Column, chunks: Column) -> Column:
    """struct<per_chunk, overview>: words of a chunk's notes and of the whole-book overview."""
    total = minutes * WORDS_PER_MINUTE
    overview = F.least(F.lit(OVERVIEW_MOST), F.floor(total * F.lit(0.45)).cast("int"))
    chapters = F.floor((total - overview) * F.lit(0.85))
    per = F.floor(chapters / F.greatest(F.lit(1), chunks)).cast("int")
    return F.struct(F.greatest(F.lit(120), per).alias("per_chunk"), overview.alias("overview"))


def read_minutes(words: Column) -> Column:
    return F.ceil(words / F.lit(float(WORDS_PER_MINUTE))).cast("int")


def assign_parts(chapters: DataFrame, book: str, order: str, size: str, parts: int, first_extra: int = 0) -> DataFrame:
    """(book, order, part): each book's chapters in contiguous parts of like size."""

    def step(rows: list[dict]):
        for r, p in zip(rows, split_parts([int(r[size]) for r in rows], parts, first_extra), strict=True):
            yield {book: r[book], order: r[order], "part": p}

    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema.fields}
    return ordered_fold(chapters.select(book, order, size), [book], [order], step, f"{book} {kinds[book]}, {order} {kinds[order]}, part int")
