"""Finding a book's structure in blocks, lines and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx

# What a chapter's line begins with.
_UNITS = "chapter|part|book|section|lesson|step"
_NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
CHAPTER_LINE = rf"(?i)^({_UNITS})\s+([0-9]+|[ivxlcdm]+|{_NUMBERS})\b"
PAGE_NUMBER = r"^[0-9ivxlcIVXLC]{1,6}$"


def running_key(text):
    """Lower case, runs of digits as one sign."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\d+", "#")


def running_blocks(blocks: DataFrame, book: str = "book_id", band: float = 0.08, least: int = 3, share: float = 0.2) -> DataFrame:
    """(book, key, n, is_running): keys of blocks in a page's top or bottom band, and whether they are headers or
    footers: on at least 3 and a fifth of the pages."""
    edge = (F.col("y0") <= band * F.col("page_height")) | (F.col("y1") >= (1 - band) * F.col("page_height"))
    pages = blocks.groupBy(book).agg(F.count_distinct("page").alias("pages"))
    keys = blocks.where(edge).groupBy(book, running_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))
    return keys.join(pages, book).select(book, "key", "n", (F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("pages"))).alias("is_running"))


def body_blocks(blocks: DataFrame, book: str = "book_id") -> DataFrame:
    """blocks without headers, footers and bare page numbers."""
    running = running_blocks(blocks, book).where("is_running").select(F.col(book).alias("__b"), F.col("key").alias("__k"))
    edge = (F.col("y0") <= 0.08 * F.col("page_height")) | (F.col("y1") >= 0.92 * F.col("page_height"))
    named = blocks.withColumn("__key", F.when(edge, running_key(F.col("text"))))
    kept = named.join(running, (named[book] == running["__b"]) & (F.col("__key") == F.col("__k")), "left_anti").drop("__key")
    return kept.where(~F.trim("text").rlike(PAGE_NUMBER))


def body_size(lines: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, body): the font size with the most characters, of equal ones the first to occur."""
    sizes = lines.groupBy(book, "size").agg(F.sum(F.length("text")).alias("chars"), F.min("seq").alias("first"))
    return sizes.groupBy(book).agg(F.max_by("size", F.struct("chars", (-F.col("first")).alias("f"))).alias("body"))


def font_headings(lines: DataFrame, pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, seq, page, text, level) of lines (book, seq, page, text, size): chapter lines if a book has three of
    them, else the lines of the largest font size that is neither rare nor frequent; lines of one heading joined."""
    rows = lines.join(body_size(lines, book), book).join(pages.groupBy(book).agg(F.count("*").alias("n_pages")), book)
    w = Window.partitionBy(book).orderBy("seq")
    rows = rows.withColumn("next", F.lead(F.struct("page", "text", "size")).over(w))
    chapter = F.col("text").rlike(CHAPTER_LINE) & (F.length("text") < 90)
    follows = (F.col("next.page") == F.col("page")) & (F.col("next.size") >= F.col("body") * 1.15) & (F.length("next.text") < 90) & ~F.col("next.text").rlike(CHAPTER_LINE)
    rows = rows.withColumn("n_chapter", F.count(F.when(chapter, 1)).over(Window.partitionBy(book)))
    level = F.when(F.startswith(F.lower("text"), F.lit("part")), 0).otherwise(1)
    named = rows.where(chapter & (F.col("n_chapter") >= 3)).select(book, "seq", "page", F.when(follows, F.concat("text", F.lit(" — "), "next.text")).otherwise(F.col("text")).alias("text"), level.alias("level"))
    big = rows.where((F.col("n_chapter") < 3) & (F.col("size") >= F.col("body") * 1.25) & (F.length("text") < 100) & F.col("text").rlike("[A-Za-z]{3}"))
    counts = big.groupBy(book, "size", "n_pages").agg(F.count("*").alias("n")).where((F.col("n") >= 3) & (F.col("n") <= F.greatest(F.lit(3.0), F.col("n_pages") * 0.6)))
    chosen = counts.groupBy(book).agg(F.max("size").alias("chosen"))
    picked = big.join(chosen, book).where(F.abs(F.col("size") - F.col("chosen")) < 0.6)
    gap = F.coalesce((F.lag("page").over(w) != F.col("page")) | (F.col("seq") - F.lag("seq").over(w) > 2), F.lit(True))
    islands = picked.withColumn("island", F.sum(gap.cast("int")).over(w))
    joined = islands.groupBy(book, "island").agg(F.min("seq").alias("seq"), F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    return named.union(joined.select(book, "seq", "page", "text", F.lit(1).alias("level")))


def cascade(sources: DataFrame, least: dict[str, int], book: str = "book_id") -> DataFrame:
    """Of headings from several sources (book, source, ...) those of each book's first source, in the order of
    least, that has enough of them."""
    order = list(least)
    need = F.create_map(*[F.lit(x) for s in order for x in (s, least[s])])
    rank = F.create_map(*[F.lit(x) for k, s in enumerate(order) for x in (s, k)])
    enough = sources.groupBy(book, "source").agg(F.count("*").alias("n")).where(F.col("n") >= need[F.col("source")])
    best = enough.groupBy(book).agg(F.min_by("source", rank[F.col("source")]).alias("source"))
    return sources.join(best, [book, "source"])


def toc_offsets(toc: DataFrame, pages: DataFrame, book: str = "book_id") -> DataFrame:
    """Offsets of contents entries (book, seq, level, title, page from 1) on pages (book, number, offset, text)."""
    p = pages.select(F.col(book).alias("__b"), F.col("number").alias("__n"), F.col("offset").alias("__o"), F.col("text").alias("__t"))
    rows = toc.join(p, (F.col(book) == F.col("__b")) & (F.col("page") == F.col("__n")))
    return rows.select(book, "seq", "level", "title", (F.col("__o") + fx.locate_title(F.col("__t"), F.col("title"))).alias("offset"))


def resolve_links(links: DataFrame, files: DataFrame, anchors: DataFrame, book: str = "book_id") -> DataFrame:
    """links (book, seq, href) with offset: of the href's file (the first in spine order that has the path, ends
    in it, or has its base name), or of its anchor there. files: book, pos, name, offset; anchors: book, name, anchor, offset."""
    href = F.url_decode(F.replace(F.coalesce("href", F.lit("")), F.lit("+"), F.lit("%2B")))
    rows = links.withColumns({"file": F.substring_index(href, "#", 1), "fragment": F.when(F.contains(href, F.lit("#")), F.regexp_extract(href, "#(.*)$", 1)).otherwise("")})
    base = F.substring_index("file", "/", -1)
    f = files.select(F.col(book).alias("__b"), "pos", "name", F.col("offset").alias("file_offset"), F.substring_index("name", "/", -1).alias("__base"))
    # all three ways of meeting imply equal base names: an equi-join
    met = rows.withColumn("__base0", base).join(f, (F.col(book) == F.col("__b")) & (F.col("__base0") == F.col("__base")))
    first = met.groupBy(book, "seq", "href", "fragment").agg(F.min_by(F.struct("name", "file_offset"), "pos").alias("hit"))
    a = anchors.select(F.col(book).alias("__b"), F.col("name").alias("__name"), F.col("anchor"), F.col("offset").alias("anchor_offset"))
    out = first.join(a, (F.col(book) == F.col("__b")) & (F.col("hit.name") == F.col("__name")) & (F.col("fragment") == F.col("anchor")), "left")
    return out.select(book, "seq", "href", F.coalesce("anchor_offset", "hit.file_offset").alias("offset"))


def flatten_toc(entries: DataFrame, book: str = "book_id") -> DataFrame:
    """Entries (book, id, parent, seq, title) of a contents tree with level (roots 1) and path, in reading order by
    path. A tree's levels are walked one join at a time, to the last; entries on no root (in a circle, or of a parent
    that is missing) have no level and are left out."""
    level = entries.where("parent is null").withColumns({"level": F.lit(1), "path": F.array("seq")})
    done, k = level, 1
    while level.take(1):
        k += 1
        up = level.select(F.col(book).alias("__b"), F.col("id").alias("__id"), F.col("path").alias("__path"))
        level = entries.join(up, (F.col(book) == F.col("__b")) & (F.col("parent") == F.col("__id"))).select(*entries.columns, F.lit(k).alias("level"), F.concat("__path", F.array("seq")).alias("path"))
        done = done.union(level)
    return done
