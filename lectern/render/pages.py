"""Reading parts as HTML pages: the context of each part as nested rows, and its rendering."""

from __future__ import annotations

import html
import json
import math
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..plans.budget import WORDS_PER_MINUTE

#: The parts of a page's context that are read, and so counted.
READ_KEYS = ("tldr", "core_thesis", "themes", "chapters", "frameworks", "key_stories", "figures", "takeaways", "quotes", "critique", "cheat_sheet")
_EMPTY = {"tldr": [], "core_thesis": "", "themes": [], "frameworks": [], "key_stories": [], "takeaways": [], "critique": {}, "cheat_sheet": []}
_MARKS = [(re.compile(pattern.removeprefix("(?U)")), rf"<{tag}>\1</{tag}>") for pattern, tag in fx.MARKS]


def _escaped(text: str) -> str:
    return html.escape(text, quote=False).replace("'", "&#39;").replace('"', "&#34;")


def md(text: str | None) -> str:
    """functions.text.inline_md for use inside the renderer: the same patterns, one after the other."""
    line = _escaped(text or "")
    for pattern, tagged in _MARKS:
        line = pattern.sub(tagged, line)
    return line


_CHAPTERS = re.compile(r"(\d+)(?:\s*[–-]\s*(\d+))?")


def named_chapters(ref: str) -> list[int]:
    """The chapters of a reference such as Ch 2, 4-6; a range that runs backwards is its two ends."""
    found: set[int] = set()
    for first, last in _CHAPTERS.findall(ref):
        ends = int(first), int(last or first)
        found |= set(range(ends[0], ends[1] + 1)) | set(ends)
    return sorted(found)


def chapter_refs(refs, hrefs: dict[int, str]) -> str:
    """References as links to the chapters that hrefs has; a plain mark for one that has none of them."""

    def shown(ref: str) -> str:
        known = [n for n in named_chapters(ref) if n in hrefs]
        if not known:
            return f'<span class="ref">{_escaped(ref)}</span>'
        return " ".join(f'<a class="ref" href="{hrefs[n]}#ch-{n}">Ch {n}</a>' for n in known)

    return " ".join(map(shown, [refs] if isinstance(refs, str) else refs or ()))


def words_in(value) -> int:
    if isinstance(value, str):
        return 0 if value.startswith("data:") else len(value.split())
    if isinstance(value, dict):
        return sum(map(words_in, value.values()))
    return sum(map(words_in, value)) if isinstance(value, list) else 0


def word_count(context: dict) -> int:
    return sum(words_in(context[k]) for k in READ_KEYS if k in context)


def _entry(c: dict) -> dict:
    """A chapter as the pages have it: without its quotes, which stand together."""
    return {"index": c["idx"], "title": c["title"], "pages": c.get("pages", ""), **{x: v for x, v in c["notes"].items() if x != "quotes"}}


def _quotes(c: dict) -> list[dict]:
    return [{**q, "chapter": c["idx"]} for q in c["notes"].get("quotes", [])]


def part_contexts(book: dict) -> list[dict]:
    """The contexts of a book's parts. Part 1 carries the overview and the corrections; all have the navigation.

    book: title, author, parts (part of each chapter), chapters (idx, title, pages, notes), summary, fixes,
    figures (chapter, caption, src) and report.
    """
    n = max([1, *book["parts"]])
    names = [f"{book['title']} – Summary{f' (Part {k} of {n})' if n > 1 else ''}.html" for k in range(1, n + 1)]
    where = {c["idx"]: names[p - 1] for c, p in zip(book["chapters"], book["parts"], strict=True)}
    out = []
    for k in range(1, n + 1):
        mine = [c for c, p in zip(book["chapters"], book["parts"], strict=True) if p == k]
        ids = {c["idx"] for c in mine}
        context = {
            **(book["summary"] if k == 1 else _EMPTY), "title": book["title"], "author": book.get("author", ""), "part": k, "parts": n, "name": names[k - 1],
            "nav": [{"part": j + 1, "href": quote(names[j])} for j in range(n)],
            "hrefs": {i: "" if f == names[k - 1] else quote(f) for i, f in where.items()},
            "chapters": [_entry(c) for c in mine], "quotes": [q for c in mine for q in _quotes(c)],
            "figures": [f for f in book.get("figures", []) if f["chapter"] in ids], "fixes": book.get("fixes", []) if k == 1 else [], "report": book.get("report", {}),
        }
        context["words"] = word_count(context)
        context["minutes"] = max(1, math.ceil(context["words"] / WORDS_PER_MINUTE))
        out.append(context)
    return out


def _section(title: str, anchor: str, body: str) -> str:
    return f'<section id="{anchor}"><h2>{title}</h2>{body}</section>' if body else ""


def _list(items: list[str], tag: str = "ul") -> str:
    return f"<{tag}>{''.join(f'<li>{i}</li>' for i in items)}</{tag}>" if items else ""


def _chapter(c: dict) -> str:
    head = f'<article id="ch-{c["index"]}"><h3>{c["index"]}. {html.escape(c["title"])}</h3>' + (f'<p class="pages">{html.escape(c["pages"])}</p>' if c["pages"] else "")
    body = f'<p class="idea">{md(c.get("core_idea"))}</p><p>{md(c.get("summary"))}</p>' + _list([md(a) for a in c.get("key_arguments", [])])
    body += "".join(f"<h4>{md(f['name'])}</h4><p>{md(f['description'])}</p>{_list([md(s) for s in f['steps']], 'ol')}" for f in c.get("frameworks", []))
    body += _list([f"{md(d['fact'])} <small>{md(d['context'])}</small>" for d in c.get("data_points", [])])
    body += "".join(f"<p><strong>{md(e['title'])}</strong> {md(e['story'])} <em>{md(e['lesson'])}</em></p>" for e in c.get("examples", []))
    return head + body + _list([md(t) for t in c.get("takeaways", [])]) + "</article>"


def _quote(q: dict) -> str:
    return f"<blockquote>{html.escape(q['text'])}{f' <cite>p. {html.escape(q['page'])}</cite>' if q.get('page') else ''}</blockquote>"


def render_part(c: dict, chapters: str | None = None, quotes: str | None = None) -> str:
    """One part as a page. Sections without content are left out. chapters, quotes: these sections, rendered before."""
    chapters = "".join(map(_chapter, c["chapters"])) if chapters is None else chapters
    quotes = "".join(map(_quote, c["quotes"])) if quotes is None else quotes
    h = c["hrefs"]
    nav = " ".join(f"<strong>Part {n['part']}</strong>" if n["part"] == c["part"] else f'<a href="{n["href"]}">Part {n["part"]}</a>' for n in c["nav"]) if c["parts"] > 1 else ""
    crit = c["critique"]
    names = (("strengths", "Strengths"), ("weaknesses", "Weaknesses"), ("missing", "Missing"))
    parts = [
        _section("In short", "tldr", _list([md(t) for t in c["tldr"]])), _section("Thesis", "thesis", f"<p>{md(c['core_thesis'])}</p>" if c["core_thesis"] else ""),
        _section("Themes", "themes", "".join(f"<h3>{md(t['name'])}</h3><p>{md(t['explanation'])} {chapter_refs(t['chapters'], h)}</p>" for t in c["themes"])),
        _section("Chapters", "chapters", chapters),
        _section("Frameworks", "frameworks", "".join(f"<h3>{md(f['name'])}</h3><p>{md(f['what'])}</p><p>{md(f['how_to_apply'])} {chapter_refs(f['chapters'], h)}</p>" for f in c["frameworks"])),
        _section("Stories", "stories", "".join(f"<h3>{md(s['title'])}</h3><p>{md(s['story'])}</p><p><em>{md(s['lesson'])}</em> {chapter_refs(s['chapter'], h)}</p>" for s in c["key_stories"])),
        _section("Figures", "figures", "".join(f'<figure><img src="{html.escape(f["src"])}" alt=""/><figcaption>{md(f["caption"])}</figcaption></figure>' for f in c["figures"])),
        _section("What to do", "takeaways", _list([f"<strong>{md(t['action'])}</strong> {md(t['why'])}" for t in c["takeaways"]], "ol")),
        _section("Quotes", "quotes", quotes),
        _section("Critique", "critique", "".join(f"<h3>{title}</h3>{_list([md(x) for x in crit[key]])}" for key, title in names if crit.get(key)) + (f"<p>{md(crit['who_should_read'])}</p>" if crit.get("who_should_read") else "")),
        _section("Cheat sheet", "cheat-sheet", _list([f"<strong>{md(x['label'])}</strong> {md(x['line'])}" for x in c["cheat_sheet"]])),
    ]
    report = c["report"]
    foot = f"{report['kept']} of {report['total']} quotes verified" if report.get("total") else ""
    fixes = _list([f"{html.escape(f['field'])}: {html.escape(f['problem'])}" for f in c["fixes"]])
    by = f"<p>{html.escape(c['author'])}</p>" if c["author"] else ""
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"/><title>{html.escape(c["title"])}</title></head><body><nav>{nav}</nav><header><h1>{html.escape(c["title"])}</h1>{by}<p>{c["minutes"]} min · {c["words"]} words</p></header>{"".join(parts)}<footer>{foot}{fixes}</footer></body></html>'


def render_books(books: DataFrame) -> DataFrame:
    """(book_id, part, name, html, words, minutes) of books (book_id, book as JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, c["part"], c["name"], render_part(c), c["words"], c["minutes"]) for i, b in zip(batch["book_id"], batch["book"], strict=True) for c in part_contexts(json.loads(b))]
            yield pd.DataFrame(rows, columns=["book_id", "part", "name", "html", "words", "minutes"])

    kind = books.schema["book_id"].dataType.simpleString()
    return books.select("book_id", "book").mapInPandas(run, f"book_id {kind}, part int, name string, html string, words int, minutes int")


def whole_books(frames: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, book) for render_books, of frames (book_id, book), JSON without chapters, and chapters (book_id, idx, part, title, notes)."""
    text = F.to_json(F.struct("idx", "title"))
    one = F.concat(F.substring(text, 1, F.length(text) - 1), F.lit(',"notes":'), F.col("notes"), F.lit("}"))
    sides = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("idx", "part", one.alias("one")))).alias("c"))
    parts, all_ = F.array_join(F.transform("c", lambda c: c["part"].cast("string")), ","), F.array_join(F.transform("c", lambda c: c["one"]), ",")
    whole = F.concat(F.expr("substring(book, 1, length(book) - 1)"), F.lit(',"parts":['), parts, F.lit('],"chapters":['), all_, F.lit("]}"))
    return frames.join(sides, "book_id").select("book_id", whole.alias("book"))


def render_chapters(chapters: DataFrame) -> DataFrame:
    """(book_id, part, idx, article, quotes, words) of chapters (book_id, idx, part, title, notes as JSON), each by itself:
    what a part's page has of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, idx, part, title, notes in zip(batch["book_id"], batch["idx"], batch["part"], batch["title"], batch["notes"], strict=True):
                c = {"idx": int(idx), "title": title, "notes": json.loads(notes)}
                entry, quoted = _entry(c), _quotes(c)
                rows.append((i, part, idx, _chapter(entry), "".join(map(_quote, quoted)), words_in(entry) + words_in(quoted)))
            yield pd.DataFrame(rows, columns=["book_id", "part", "idx", "article", "quotes", "words"])

    kind = chapters.schema["book_id"].dataType.simpleString()
    return chapters.select("book_id", "idx", "part", "title", "notes").mapInPandas(run, f"book_id {kind}, part int, idx int, article string, quotes string, words int")


def render_frames(frames: DataFrame, rendered: DataFrame) -> DataFrame:
    """(book_id, part, name, words, minutes, head, middle, tail) of frames (book_id, book), JSON without chapters, and their
    rendered chapters. A part's page is its head, its articles by idx, the middle, its quotes by idx and the tail, so a page
    is known from rows none of which holds more than a chapter."""
    sums = rendered.groupBy("book_id", "part").agg(
        F.sum("words").alias("words"), (F.max(F.length("article")) > 0).alias("articles"), (F.max(F.length("quotes")) > 0).alias("quotes"), F.array_sort(F.collect_list("idx")).alias("idx")
    )
    sums = sums.groupBy("book_id").agg(F.collect_list(F.struct("part", "words", "articles", "quotes", "idx")).alias("parts"))  # a book's parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, sides in zip(batch["book_id"], batch["book"], batch["parts"], strict=True):
                book, of = json.loads(text), {int(p["part"]): p for p in sides}
                mine = [(int(k), n) for n in sorted(of) for k in of[n]["idx"]]
                light = {**book, "parts": [n for _, n in mine], "chapters": [{"idx": k, "title": "", "notes": {}} for k, _ in mine]}
                for c in part_contexts(light):
                    p, c = of.get(c["part"], {"words": 0, "articles": False, "quotes": False}), {**c, "chapters": [], "quotes": []}
                    words = word_count(c) + int(p["words"])
                    c |= {"words": words, "minutes": max(1, math.ceil(words / WORDS_PER_MINUTE))}
                    mark = uuid.uuid4().hex
                    cuts = render_part(c, mark if p["articles"] else "", mark if p["quotes"] else "").split(mark)
                    head, middle, tail = (cuts[0], "", "".join(cuts[1:])) if len(cuts) < 3 else cuts
                    rows.append((i, c["part"], c["name"], words, c["minutes"], head, middle, tail))
            yield pd.DataFrame(rows, columns=["book_id", "part", "name", "words", "minutes", "head", "middle", "tail"])

    kind = frames.schema["book_id"].dataType.simpleString()
    return frames.join(sums, "book_id").select("book_id", "book", "parts").mapInPandas(run, f"book_id {kind}, part int, name string, words int, minutes int, head string, middle string, tail string")


def part_sizes(frames: DataFrame, rendered: DataFrame) -> DataFrame:
    """(book_id, part, name, words, minutes, n_chars): the parts' pages and the length of their HTML."""
    inner = rendered.groupBy("book_id", "part").agg(F.sum(F.length("article") + F.length("quotes")).alias("inner"))
    around = F.length("head") + F.length("middle") + F.length("tail")
    rows = render_frames(frames, rendered).join(inner, ["book_id", "part"], "left")
    return rows.select("book_id", "part", "name", "words", "minutes", (around + F.coalesce("inner", F.lit(0))).alias("n_chars"))


def write_pages(parts: DataFrame, folder: str) -> list[str]:
    """One HTML file of its own name for each row of (name, html); the names written.

    Tasks write the pages beside the folder's files, and each is then renamed to its name, over an older page of that
    name. Other files of the folder stay.
    """
    spark = parts.sparkSession
    aside = f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    named = parts.select(fx.safe_filename(F.regexp_replace("name", r"\.html$", "")).alias("name"), "html")
    named.write.partitionBy("name").option("lineSep", "\n").text(aside)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = []
    for status in fs.listStatus(path(aside)):  # a folder for each page
        kind, _, value = status.getPath().getName().partition("=")
        if kind != "name":
            continue
        target = path(folder, jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value) + ".html")
        page = next(f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-"))
        fs.delete(target, False)
        fs.rename(page, target)
        written.append(target.getName())
    fs.delete(path(aside), True)
    return sorted(written)
