"""The summary as an EPUB 3 with stdlib means: an overview, a page for each chapter, the lists, contents twice."""

from __future__ import annotations

import base64
import html
import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import md

_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_STAMP = (2020, 1, 1, 0, 0, 0)


def _page(title: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def _p(text: str | None, head: str = "") -> str:
    return f"<p>{head}{md(text)}</p>" if text else ""


def _ul(items: list[str]) -> str:
    return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if items else ""


class Epub:
    """An EPUB that is written chapter by chapter: of what is written, only names and titles are kept beside the packed bytes.

    book: see pages.part_contexts; a figure has content, base64, and mime. Its chapters are given to add.
    """

    def __init__(self, book: dict):
        self.book, self.pages, self.files, self.out = book, [], [], io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w")
        self.zip.writestr(zipfile.ZipInfo("mimetype", _STAMP), "application/epub+zip", zipfile.ZIP_STORED)
        self._put("META-INF/container.xml", _CONTAINER)
        s, crit = book["summary"], book["summary"].get("critique", {})
        self._page("overview", "Overview", _ul([md(t) for t in s.get("tldr", [])]) + _p(s.get("core_thesis")) + "".join(f"<h2>{md(t['name'])}</h2>{_p(t['explanation'])}" for t in s.get("themes", [])) + "".join(f"<h2>{k.title()}</h2>{_ul([md(x) for x in crit[k]])}" for k in ("strengths", "weaknesses", "missing") if crit.get(k)) + _p(crit.get("who_should_read")))

    def _put(self, path: str, data: str | bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(path, _STAMP), data, zipfile.ZIP_DEFLATED)

    def _page(self, name: str, title: str, body: str) -> None:
        if body:
            self.pages.append((name, title))
            self._put(f"OEBPS/{name}.xhtml", _page(title, body))

    def add(self, c: dict) -> None:
        n = c["notes"]
        body = _p(c.get("pages")) + _p(n.get("core_idea")) + _p(n.get("summary")) + _ul([md(a) for a in n.get("key_arguments", [])])
        body += "".join(f"<h2>{md(f['name'])}</h2>{_p(f['description'])}{_ul([md(x) for x in f['steps']])}" for f in n.get("frameworks", []))
        body += _ul([f"{md(d['fact'])} ({md(d['context'])})" for d in n.get("data_points", [])])
        body += "".join(f"<h2>{md(e['title'])}</h2>{_p(e['story'])}{_p(e['lesson'])}" for e in n.get("examples", []))
        body += "".join(f"<blockquote><p>{html.escape(q['text'])}{' — p. ' + html.escape(q['page']) if q.get('page') else ''}</p></blockquote>" for q in n.get("quotes", []))
        body += _ul([md(t) for t in n.get("takeaways", [])])
        for f in self.book.get("figures", []):
            if f["chapter"] == c["idx"]:
                name = f"fig_{len(self.files) + 1:02d}.{'png' if f['mime'] == 'image/png' else 'jpg'}"
                self.files.append((name, f["mime"]))
                self._put(f"OEBPS/{name}", base64.b64decode(f["content"]))
                body += f'<div><img src="{name}" alt=""/>{_p(f["caption"])}</div>'
        self._page(f"ch{c['idx']:03d}", f"{c['idx']}. {c['title']}", body)

    def close(self) -> bytes:
        """The lists, the contents and the package, and all bytes."""
        book, s = self.book, self.book["summary"]
        self._page("frameworks", "Frameworks", "".join(f"<h2>{md(f['name'])}</h2>{_p(f['what'])}{_p(f['how_to_apply'])}" for f in s.get("frameworks", [])))
        self._page("stories", "Stories", "".join(f"<h2>{md(x['title'])}</h2>{_p(x['story'])}{_p(x['lesson'])}{_p(x['chapter'])}" for x in s.get("key_stories", [])))
        self._page("takeaways", "Takeaways", _ul([f"<strong>{md(t['action'])}</strong> {md(t['why'])}" for t in s.get("takeaways", [])]))
        self._page("cheat-sheet", "Cheat sheet", _ul([f"<strong>{md(x['label'])}</strong> {md(x['line'])}" for x in s.get("cheat_sheet", [])]))
        title, author = html.escape(book["title"]), html.escape(book.get("author", ""))
        name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_DNS, book['title'] + book.get('author', ''))}"
        items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i, _ in self.pages) + "".join(f'<item id="{n.split(".")[0]}" href="{n}" media-type="{m}"/>' for n, m in self.files)
        spine = "".join(f'<itemref idref="{i}"/>' for i, _ in self.pages)
        opf = f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{name}</dc:identifier><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator><dc:language>en</dc:language><meta property="dcterms:modified">2020-01-01T00:00:00Z</meta></metadata><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{spine}</spine></package>'
        links = "".join(f'<li><a href="{i}.xhtml">{html.escape(t)}</a></li>' for i, t in self.pages)
        nav = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
        points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{html.escape(t)}</text></navLabel><content src="{i}.xhtml"/></navPoint>' for k, (i, t) in enumerate(self.pages, 1))
        ncx = f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{name}"/></head><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>'
        for path, data in (("content.opf", opf), ("nav.xhtml", nav), ("toc.ncx", ncx)):
            self._put(f"OEBPS/{path}", data)
        self.zip.close()
        return self.out.getvalue()


def build_epub(book: dict) -> bytes:
    """The bytes of the EPUB of a book (see Epub) with its chapters."""
    made = Epub(book)
    for c in book["chapters"]:
        made.add(c)
    return made.close()


def epub_books(books: DataFrame) -> DataFrame:
    """(book_id, content, error) of books (book_id, book as JSON); a failure is a row, for the pages go on without."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, b in zip(batch["book_id"], batch["book"], strict=True):
                try:
                    rows.append((i, build_epub(json.loads(b)), None))
                except (KeyError, ValueError, TypeError) as e:
                    rows.append((i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["book_id", "content", "error"])

    kind = books.schema["book_id"].dataType.simpleString()
    return books.select("book_id", "book").mapInPandas(run, f"book_id {kind}, content binary, error string")


def epub_chapters(frames: DataFrame, chapters: DataFrame) -> DataFrame:
    """epub_books of frames (book_id, book), JSON without chapters, and chapters (book_id, idx, title, notes as JSON). A book's
    chapters come to one task in order and are packed one after the other, so only its packed bytes are held at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made, error = None, None, None

        def ended() -> pd.DataFrame:
            content, why = None, error
            if why is None:
                try:
                    content = made.close()
                except (KeyError, ValueError, TypeError) as e:
                    why = f"{type(e).__name__}: {e}"
            return pd.DataFrame([(now, content, why)], columns=["book_id", "content", "error"])

        for batch in batches:
            for i, idx, title, data in zip(batch["book_id"], batch["idx"], batch["title"], batch["data"], strict=True):
                if idx < 0:
                    if now is not None:
                        yield ended()
                    now, made, error = i, None, None
                if error is None:
                    try:
                        if idx < 0:
                            made = Epub(json.loads(data))
                        else:
                            made.add({"idx": int(idx), "title": title, "notes": json.loads(data)})
                    except (KeyError, ValueError, TypeError) as e:
                        error = f"{type(e).__name__}: {e}"
        if now is not None:
            yield ended()

    kind = frames.schema["book_id"].dataType.simpleString()
    first = frames.select("book_id", F.lit(-1).alias("idx"), F.lit("").alias("title"), F.col("book").alias("data"))
    rows = first.union(chapters.join(frames.select("book_id"), "book_id", "left_semi").select("book_id", "idx", "title", F.col("notes").alias("data")))
    return rows.repartition("book_id").sortWithinPartitions("book_id", "idx").mapInPandas(run, f"book_id {kind}, content binary, error string")
