"""One coordinate system: offsets of units in a book, pages as of an offset, intervals.

Lookups are window functions or equi-joins on the book with a range condition, never joins without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(units: DataFrame, book: str, order: str | list[str], length: Column, joiner: int = 2) -> DataFrame:
    """units with start_off and end_off in the book's text, units joined by joiner characters."""
    w = Window.partitionBy(book).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("__n") + joiner).over(w), F.lit(0)).cast("long")
    rows = units.withColumn("__n", length).withColumn("start_off", start)  # measured first: texts that nobody asks for stay out of the window
    return rows.withColumn("end_off", (F.col("start_off") + F.col("__n")).cast("long")).drop("__n")


def page_spans(pages: DataFrame, book: str = "book_id") -> DataFrame:
    """Pages (book, offset, seq, label) as half-open intervals; the first one reaches back to the beginning,
    and of pages at one offset the last counts."""
    w = Window.partitionBy(book).orderBy("offset", "seq")
    first = F.row_number().over(w) == 1
    return (
        pages.withColumn("__next", F.lead("offset").over(w)).withColumn("page_start", F.when(first, F.lit(-(2**62))).otherwise(F.col("offset")))
        .withColumn("page_end", F.coalesce("__next", F.lit(2**62))).where("page_start < page_end").select(book, "page_start", "page_end", "label")
    )


def page_as_of(probes: DataFrame, pages: DataFrame, book: str = "book_id", at: str = "probe") -> DataFrame:
    """probes with the label of the page that holds the offset; null for a book without pages.

    Both sides are put in one order and the last page is carried forward, so a book of many pages and
    probes costs a sort and not their product.
    """
    lines = pages.select(F.col(book).alias("__b"), F.col("offset").cast("long").alias("__o"), F.lit(0).alias("__k"), F.col("seq").cast("long").alias("__s"), F.col("label").alias("__l"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("__p"))
    asked = probes.select(F.col(book).alias("__b"), F.col(at).cast("long").alias("__o"), F.lit(1).alias("__k"), F.lit(0).cast("long").alias("__s"), F.lit(None).cast("string").alias("__l"), F.struct(*probes.columns).alias("__p"))
    forward = Window.partitionBy("__b").orderBy("__o", "__k", "__s").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min_by("__l", F.when(F.col("__k") == 0, F.struct("__o", "__s"))).over(Window.partitionBy("__b"))
    both = lines.union(asked).repartition("__b")  # an exchange of its own: a union's two sides may be dealt out differently
    found = both.withColumn("label", F.coalesce(F.last("__l", ignorenulls=True).over(forward), first))
    return found.where("__k = 1").select("__p.*", "label")


def assign_interval(points: DataFrame, spans: DataFrame, book: str, at: str, start: str = "start", end: str = "end", how: str = "left") -> DataFrame:
    """points joined with the span of their book that holds them (start <= at < end)."""
    s = spans.withColumnRenamed(book, "__book")
    return points.join(s, (points[book] == s["__book"]) & (points[at] >= s[start]) & (points[at] < s[end]), how).drop("__book")


def marked_text(chunks: DataFrame, pages: DataFrame, book: str = "book_id") -> DataFrame:
    """chunks (book, idx, start, end, text) with marked: page markers put in where a page begins inside."""
    inside = chunks.select(book, "idx", "start", "end").join(pages.select(F.col(book).alias("__b"), "offset", "seq", "label"), (F.col(book) == F.col("__b")) & (F.col("offset") > F.col("start")) & (F.col("offset") < F.col("end")))
    cuts = inside.groupBy(book, "idx").agg(F.array_sort(F.collect_list(F.struct("offset", "seq", "label"))).alias("cuts"))  # a chunk's pages
    first = page_as_of(chunks.select(book, "idx", F.col("start").alias("probe")), pages, book).select(book, "idx", F.col("label").alias("first"))
    rows = chunks.join(cuts, [book, "idx"], "left").join(first, [book, "idx"], "left")
    begin = F.struct(F.col("start").cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        piece = F.substring(F.col("text"), (acc["at"] - F.col("start") + 1).cast("int"), (c["offset"] - acc["at"]).cast("int"))
        return F.struct(c["offset"].cast("long").alias("at"), F.concat(acc["out"], piece, F.lit("[p. "), c["label"], F.lit("] ")).alias("out"))

    empty = F.array().cast("array<struct<offset:bigint,seq:bigint,label:string>>")
    typed = F.transform(F.coalesce(F.col("cuts").cast("array<struct<offset:bigint,seq:bigint,label:string>>"), empty), lambda c: c)
    body = F.aggregate(typed, begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] - F.col("start") + 1).cast("int"), F.length("text"))))
    head = F.when(F.coalesce("first", F.lit("")) == "", "").otherwise(F.concat(F.lit("[p. "), F.col("first"), F.lit("]\n")))
    return rows.withColumn("marked", F.concat(head, body)).drop("cuts", "first")
