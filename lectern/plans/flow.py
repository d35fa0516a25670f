"""From books to summaries: the model's calls as tables of requests, one step after the other.

A step asks for all books at once and its answers are a stage table, so a run that was cut short goes on where it
stopped. A book for which an answer is missing leaves the run with its error; the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx
from ..operators import offsets, quotes, sections
from . import budget, model, synthesis
from .stages import StageStore, cut

RULES = "You work for readers who want a book's substance in less time. Everything you write must come from the text you are given: no outside knowledge, no invented names, figures or quotations. Answer with one JSON object and nothing else."
#: What a chapter's notes hold, field by field.
FIELDS = """core_idea: one sentence with the idea that matters most here.
summary: the section told densely.
key_arguments: its main claims, each with what supports it.
frameworks: methods, models or rules that the author gives a name or steps to; none if there are none.
data_points: figures and findings with their context; none if there are none.
examples: stories worth retelling and what they teach.
quotes: sentences worth quoting, copied sign by sign from the section; page is the number in the last [p. N] before them, without the marker itself.
takeaways: what a reader can do."""


def _messages(content: Column) -> Column:
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(RULES).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content"))))


def _part(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n\n{title}:\n"), fx.escape_chat(body))


@F.pandas_udf(T.StringType())
def _note_schema(words: pd.Series) -> pd.Series:
    return words.map(lambda w: json.dumps(synthesis.note_schema(int(w))))


def plan_requests(books: DataFrame, chunks: DataFrame, style: str, lo: int, hi: int) -> DataFrame:
    """(book_id, messages, schema, max_tokens): how long the summary should take to read, from the contents and the first
    6000 characters of the first chunk. books: book_id, title; chunks: book_id, idx, title, tokens, text."""
    line = F.concat(F.col("idx").cast("string"), F.lit(". "), "title", F.lit(" ("), F.col("tokens").cast("string"), F.lit(" tokens)"))
    toc = chunks.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("toc"), F.min_by("text", "idx").alias("first"))
    content = F.concat(F.lit(f"How many minutes should a summary of this book take to read, from {lo} to {hi}? Judge by how much of substance there is. Book: "), "title", _part("Contents", F.col("toc")), _part("How it begins", F.substring("first", 1, 6000)), F.lit(f"\n\nStyle wanted:\n{style}"))
    return books.join(toc, "book_id").select("book_id", _messages(content).alias("messages"), F.lit(json.dumps(synthesis.plan_schema(lo, hi))).alias("schema"), F.lit(300).alias("max_tokens"))


def note_requests(books: DataFrame, marked: DataFrame, plan: DataFrame, style: str) -> DataFrame:
    """(book_id, idx, tokens, messages, schema, max_tokens) of every chunk. books: book_id, title, author; marked: book_id, idx,
    title, tokens, marked; plan: book_id, per_chunk."""
    rows = marked.withColumnRenamed("title", "section").join(books.select("book_id", "title", "author"), "book_id").join(plan.select("book_id", "per_chunk"), "book_id")
    by = F.when(F.coalesce("author", F.lit("")) == "", "").otherwise(F.concat(F.lit(" by "), "author"))
    room = F.concat(F.lit("\n\nWrite at most "), F.col("per_chunk").cast("string"), F.lit(" words in all, quotations not counted; rather fewer items than longer ones."))
    content = F.concat(F.lit("Take notes of one section. Book: "), "title", by, F.lit(". Section: "), "section", _part("Section text", F.col("marked")), F.lit(f"\n\nStyle wanted (the length below goes first):\n{style}\n\nThe notes:\n{FIELDS}"), room)
    return rows.select("book_id", "idx", "tokens", _messages(content).alias("messages"), _note_schema("per_chunk").alias("schema"), F.lit(None).cast("int").alias("max_tokens"))


def draft_requests(material: DataFrame, draft: str, style: str, thesis: Column | None = None) -> DataFrame:
    """(book_id, messages, schema, max_tokens) of one of synthesis.DRAFTS. material: book_id, title, text, overview (words)."""
    share, schema = synthesis.DRAFTS[draft]
    words = F.floor(F.col("overview") * share).cast("int").cast("string")
    known = F.lit("") if thesis is None else _part("The book's thesis, as already written", thesis)
    names = ", ".join(schema["properties"])
    content = F.concat(F.lit("Notes of all chapters of a book, for its summary. Book: "), "title", _part("Notes", F.col("text")), F.lit(f"\n\nStyle wanted:\n{style}"), known, F.lit(f"\n\nFrom these notes write {names}, in about "), words, F.lit(" words. Name chapters as Ch N."))
    return material.select("book_id", _messages(content).alias("messages"), F.lit(json.dumps(schema)).alias("schema"), F.lit(None).cast("int").alias("max_tokens"))


def audit_requests(material: DataFrame, drafts: DataFrame) -> DataFrame:
    """(book_id, messages, schema, max_tokens): what the draft (book_id, draft as JSON) says that the notes don't."""
    content = F.concat(F.lit("Check a draft against the notes it was written from. Report at most twelve corrections, each of one item: what is unsupported, wrong, repeated or missing. Book: "), "title", _part("Notes", F.col("text")), _part("Draft", F.col("draft")), F.lit("\n\nfield and index name the item; action is replace, remove or add; value is the new text, or the new object as JSON. No corrections is a good answer."))
    return material.join(drafts, "book_id").select("book_id", _messages(content).alias("messages"), F.lit(json.dumps(synthesis.FIXES)).alias("schema"), F.lit(2000).alias("max_tokens"))


def screen_requests(figures: DataFrame) -> DataFrame:
    """(book_id, seq, messages, schema, max_tokens) of figures (book_id, seq, mime, content, idea): whether a picture carries
    information. idea: the core idea of the chapter it stands in."""
    picture = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(fx.data_uri(F.col("content"), F.col("mime")).alias("url")).alias("image_url")))
    words = F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit("What does this picture of a book show, and does it carry information that the text needs? The chapter's idea: "), fx.escape_chat(F.coalesce("idea", F.lit("")))).alias("text")))
    user = F.concat(F.lit('[{"role":"system","content":'), F.to_json(F.struct(F.lit(RULES).alias("c"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.lit(RULES).alias("c")))) - 6), F.lit('},{"role":"user","content":['), words, F.lit(","), picture, F.lit("]}]"))
    return figures.select("book_id", "seq", user.alias("messages"), F.lit(json.dumps(synthesis.VISION)).alias("schema"), F.lit(400).alias("max_tokens"))


def screened(asked: DataFrame) -> DataFrame:
    """(book_id, seq, kind, meaningful, importance, caption) of the answers to screen_requests; an error is a picture without meaning."""
    got = F.from_json("response", model.ddl(synthesis.VISION))
    return asked.select("book_id", "seq", got.alias("v")).select("book_id", "seq", F.coalesce("v.kind", F.lit("other")).alias("kind"), F.coalesce("v.meaningful", F.lit(False)).alias("meaningful"), F.coalesce("v.importance", F.lit(1)).alias("importance"), F.coalesce("v.caption", F.lit("")).alias("caption"))


def call_stats(asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, first_try, tokens, tokens_per_second) of answers of model.ask."""
    return asked.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("first_try").alias("first_try"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("tokens_per_second"))


class Flow:
    """The steps from books (book_id, title, author, text, content_start, content_end), headings and pages (book_id, offset, seq,
    label) to books as JSON for rendering. folder holds the stage tables, make_client gives a model's client."""

    def __init__(self, spark: SparkSession, folder: str, make_client: Callable[[], Callable], *, style: str = "", max_minutes: int = 120, chunk_tokens: int = 8000, context: int = model.CONTEXT, output: int = 3500, parallel: int = 2, threshold: float = 90):
        self.spark, self.store, self.make_client, self.style = spark, StageStore(spark, folder), make_client, style
        self.max_minutes, self.chunk_tokens, self.context, self.output, self.parallel, self.threshold = max_minutes, chunk_tokens, context, output, parallel, threshold

    def ask(self, requests: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
        return model.ask(requests, self.make_client, keys=keys, parallel=self.parallel, output=self.output, order=order)

    def run(self, books: DataFrame, headings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(book_id, book) and (book_id, step, error) of the books that left the run."""
        ids = books.select("book_id")
        failed: list[DataFrame] = []

        def step(name: str, todo: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
            """The answers of the books all of whose requests were answered."""
            got = self.store.run(name, todo, compute)
            bad = got.where("response is null").groupBy("book_id").agg(F.first("error").alias("error"))
            failed.append(bad.select("book_id", F.lit(name).alias("step"), "error"))
            return got.join(bad, "book_id", "left_anti").select("book_id", *[k for k in keys if k != "book_id"], "response")

        def chunked(todo: DataFrame) -> DataFrame:
            texts = books.select("book_id", "text", "content_start", "content_end").join(todo, "book_id", "left_semi")
            built = sections.build_chunks(texts, headings, chunk_tokens=self.chunk_tokens, context=self.context, output=self.output)
            return sections.with_bodies(built, texts, "book_id").withColumnRenamed("body", "text")

        chunks = self.store.run("chunk", ids, chunked)
        part = F.lit(self.spark.range(1).select(fx.part_minutes(F.lit(self.style))).first()[0])
        lo, hi = self.spark.range(1).select(budget.read_plan(F.lit(0), part, F.lit(self.max_minutes)).alias("p")).select("p.lo", "p.hi").first()
        plans = step("plan", ids, ["book_id"], lambda todo: self.ask(plan_requests(books.join(todo, "book_id", "left_semi"), chunks, self.style, lo, hi), ["book_id"]))
        n = chunks.groupBy("book_id").agg(F.count("*").cast("int").alias("n"))
        wanted = F.get_json_object("response", "$.read_minutes").cast("int")
        plan = plans.join(n, "book_id").withColumn("p", budget.read_plan(wanted, part, F.lit(self.max_minutes)))
        plan = cut(plan.withColumn("b", budget.budgets(F.col("p.minutes"), F.col("n"))).select("book_id", "p.minutes", "p.parts", "b.per_chunk", "b.overview"))

        marked = offsets.marked_text(chunks.select("book_id", "idx", "start", "end", "title", "tokens", "text"), pages)
        answers = step("extract", plan.select("book_id"), ["book_id", "idx"], lambda todo: self.ask(note_requests(books, marked.join(todo, "book_id", "left_semi"), plan, self.style), ["book_id", "idx"], order="tokens"))
        kind = model.ddl(synthesis.note_schema(600))
        notes = answers.withColumn("n", F.from_json("response", kind)).select("book_id", "idx", "n")
        said = notes.select("book_id", "idx", F.posexplode("n.quotes").alias("seq", "q")).select("book_id", "idx", "seq", F.col("q.text").alias("text"))
        verdicts = self.store.run("verify", answers.select("book_id").distinct(), lambda todo: quotes.verify_quotes(said.join(todo, "book_id", "left_semi"), chunks, pages, threshold=self.threshold))
        kept = verdicts.where("verdict in ('exact', 'fuzzy')").groupBy("book_id", "idx").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("found").alias("text"), F.coalesce("page", F.lit("")).alias("page")))).alias("kept"))
        none = F.array().cast("array<struct<seq:int,text:string,page:string>>")
        notes = notes.join(kept, ["book_id", "idx"], "left").withColumn("kept", F.coalesce("kept", none))
        report = quotes.quote_report(verdicts)

        label = offsets.page_as_of(chunks.select("book_id", "idx", F.col("start").alias("probe")), pages).select("book_id", "idx", F.col("label").alias("first"))
        last = offsets.page_as_of(chunks.select("book_id", "idx", (F.col("end") - 1).alias("probe")), pages).select("book_id", "idx", F.col("label").alias("last"))
        told = notes.join(chunks.select("book_id", "idx", "title"), ["book_id", "idx"]).join(label, ["book_id", "idx"]).join(last, ["book_id", "idx"])
        told = cut(told.withColumn("pages", F.coalesce(fx.page_range(F.col("first"), F.col("last")), F.lit(""))))
        lines = told.select("book_id", F.col("idx").alias("_index"), F.col("title").alias("_title"), F.col("pages").alias("_pages"), "n.*")
        room = max(1000, self.context - self.output - 2500)
        fitting = cut(synthesis.fitting_digest(lines, "book_id", room))
        long = lines.join(fitting.where("level = 'condense'").select("book_id"), "book_id", "left_semi")
        texts = long.select("book_id", F.col("_index").cast("long").alias("seq"), F.concat(F.lit("Ch "), F.col("_index").cast("string")).alias("label"), synthesis.note_digest(False).alias("text"))
        short = synthesis.condense(texts, "book_id", room, self._group) if long.take(1) else texts.select("book_id", "text").limit(0)
        digest = fitting.where("level <> 'condense'").select("book_id", "text").union(short)
        material = cut(digest.join(books.select("book_id", "title"), "book_id").join(plan.select("book_id", "overview"), "book_id"))

        def drafts(todo: DataFrame) -> DataFrame:
            mine = material.join(todo, "book_id", "left_semi")
            first = self.ask(draft_requests(mine, "overview", self.style), ["book_id"]).select("book_id", F.col("response").alias("overview_json"), F.col("error").alias("e0"))
            first = cut(first)  # what was answered is not asked again
            thesis = mine.join(first.select("book_id", F.get_json_object("overview_json", "$.core_thesis").alias("thesis")), "book_id")
            ideas, action = (self.ask(draft_requests(thesis, d, self.style, F.coalesce("thesis", F.lit(""))), ["book_id"]).select("book_id", F.col("response").alias(d), F.col("error").alias(e)) for d, e in (("ideas", "e1"), ("action", "e2")))
            rows = first.join(ideas, "book_id").join(action, "book_id")
            # three objects as one: the braces between them go
            merged = F.concat(F.regexp_replace("overview_json", r"\}$", ","), F.regexp_replace(F.regexp_replace("ideas", r"^\{", ""), r"\}$", ","), F.regexp_replace("action", r"^\{", ""))
            return rows.select("book_id", merged.alias("response"), F.coalesce("e0", "e1", "e2").alias("error"))

        draft = step("synthesize", material.select("book_id"), ["book_id"], drafts).withColumnRenamed("response", "draft")
        audits = step("audit", draft.select("book_id"), ["book_id"], lambda todo: self.ask(audit_requests(material, draft.join(todo, "book_id", "left_semi")), ["book_id"]))
        final = draft.join(audits, "book_id").withColumn("r", synthesis.apply_fixes_json("draft", F.get_json_object("response", "$.fixes"))).select("book_id", "r.final", "r.applied")

        chapter = F.struct("idx", "title", "pages", F.struct(*[F.col(f"n.{c}").alias(c) for c in synthesis.note_schema(600)["properties"] if c != "quotes"], F.col("kept").alias("quotes")).alias("notes"))
        told = told.withColumn("chapter", chapter)
        sized = told.withColumn("size", fx.count_leaf_words(F.col("chapter"), told.schema["chapter"].dataType)).select("book_id", "idx", "chapter", "size")
        share = plan.select("book_id", "parts", "overview")
        parts = [budget.assign_parts(sized.join(share.where(F.col("parts") == k), "book_id", "left_semi"), "book_id", "idx", "size", k, budget.OVERVIEW_MOST) for k in [r.parts for r in share.select("parts").distinct().collect()]]  # a few numbers
        of = parts[0] if parts else sized.select("book_id", "idx", F.lit(1).alias("part")).limit(0)
        for p in parts[1:]:
            of = of.union(p)
        full = sized.join(of, ["book_id", "idx"]).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("idx", "part", "chapter"))).alias("c"))
        rows = full.join(final, "book_id").join(report, "book_id", "left").join(books.select("book_id", "title", "author"), "book_id")
        told_report = F.to_json(F.struct(F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("fuzzy", F.lit(0)).alias("fuzzy")))
        head = F.to_json(F.struct("title", F.coalesce("author", F.lit("")).alias("author"), F.transform("c", lambda x: x["part"]).alias("parts"), F.transform("c", lambda x: x["chapter"]).alias("chapters")))
        book = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"summary":'), "final", F.lit(',"fixes":'), "applied", F.lit(',"report":'), told_report, F.lit("}"))
        errors = failed[0]
        for e in failed[1:]:
            errors = errors.union(e)
        return rows.select("book_id", book.alias("book")), errors

    def _group(self, groups: DataFrame) -> DataFrame:
        """Groups of notes (book_id, grp, label, text) put shortly by the model; one that isn't answered keeps its beginning."""
        content = F.concat(F.lit("Put the notes of several chapters together: what they say in common, the best evidence, and what a reader can do. Chapters: "), "label", _part("Notes", F.col("text")))
        asked = self.ask(groups.select("book_id", "grp", _messages(content).alias("messages"), F.lit(json.dumps(synthesis.GROUP)).alias("schema"), F.lit(None).cast("int").alias("max_tokens")), ["book_id", "grp"])
        rows = groups.join(asked.select("book_id", "grp", "response"), ["book_id", "grp"])
        return rows.select("book_id", "grp", F.coalesce(F.concat(F.lit("["), "label", F.lit("] "), "response"), F.substring("text", 1, 900)).alias("text"))
