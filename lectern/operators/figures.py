"""Choosing figures, and the small relational steps they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx


def first_of(rows: DataFrame, key: list, order: list, book: list[str] | None = None) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*(book or []), *key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def repeated(rows: DataFrame, key: list[str], counted: str | None = None, most: int = 2) -> DataFrame:
    """(key, n): keys used more than most times, by rows or by distinct values of a column."""
    n = F.count_distinct(counted) if counted else F.count("*")
    return rows.groupBy(*key).agg(n.alias("n")).where(F.col("n") > most)


def top_then_order(rows: DataFrame, book: str, best: list, order: list, k: int) -> DataFrame:
    """The k best rows of each book, then numbered as rank in the given order."""
    w = Window.partitionBy(book)
    top = rows.withColumn("__n", F.row_number().over(w.orderBy(*best))).where(F.col("__n") <= k).drop("__n")
    return top.withColumn("rank", F.row_number().over(w.orderBy(*order)))


def vector_figures(drawings: DataFrame, book: str = "book_id", least: int = 25) -> DataFrame:
    """(book, page, box, share): pages where 25 drawings or more, each under 80 % of the page, cover 8 to 90 % of it."""
    small = drawings.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < 0.8 * F.col("page_area"))
    box = small.groupBy(book, "page").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("page_area").alias("page_area"))
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.col("page_area")
    return box.where(F.col("n") >= least).withColumn("share", share).where(F.col("share").between(0.08, 0.9)).drop("n", "page_area")


def candidates(images: DataFrame, book: str = "book_id", most: int = 30) -> DataFrame:
    """Images (book, seq, ref, page, width, height, shown, dhash) worth a look: not repeated, of a useful size,
    the first of those that look alike, and the largest of each book."""
    uses = images.groupBy(book, "ref").agg(F.count_distinct("page").alias("uses"))
    fit = images.join(uses, [book, "ref"]).where(fx.accept_geometry(F.col("width"), F.col("height"), F.col("shown"), F.col("uses")))
    alike = first_of(fit, ["dhash"], ["seq"], [book])
    return top_then_order(alike.withColumn("area", F.col("width") * F.col("height")), book, [F.desc("area"), "seq"], ["seq"], most)


def select_figures(screened: DataFrame, book: str = "book_id", most: int = 15) -> DataFrame:
    """Screened candidates (book, seq, offset, area, meaningful, kind, importance) that are kept, numbered by offset."""
    kept = screened.where(fx.keep_figure(F.col("meaningful"), F.col("kind"), F.col("importance")))
    return top_then_order(kept, book, [F.desc("importance"), F.desc("area"), "seq"], ["offset", "seq"], most)


def figure_file(rank: Column, mime: Column) -> Column:
    return F.concat(F.lit("fig_"), F.lpad(rank.cast("string"), 2, "0"), F.when(mime == "image/png", ".png").otherwise(".jpg"))
