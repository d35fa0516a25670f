"""Offsets, quotes, sections, structure, sources and rendering on small tables."""

import http.server
import io
import json
import random
import threading
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions.python import normalized
from lectern.operators import headings, offsets, quotes, sections
from lectern.plans import client, flow, model, stages, synthesis
from lectern.render import epub, pages
from lectern.sources import books, config, html, pdf
from lectern.streaming import watch

TEXT = "Front line of the book here.\nThe first principle is that you must not fool yourself — and you are the easiest person to fool.\n\nSecond paragraph about “curly quotes” and things that matter.\n\n" + "Filler sentence number one. " * 50


@pytest.fixture(scope="module")
def tables(spark):
    chunk = spark.createDataFrame([(1, 1, 0, len(TEXT), TEXT)], "book_id int, idx int, start long, end long, text string")
    page = spark.createDataFrame([(1, 0, 0, "1"), (1, 60, 1, "2"), (1, 130, 2, "3")], "book_id int, offset long, seq long, label string")
    return chunk, page


def verdicts(spark, tables, texts):
    q = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(texts)], "book_id int, idx int, seq int, text string")
    return [(r.verdict, r.page, r.found) for r in quotes.verify_quotes(q, *tables).orderBy("seq").collect()]


def test_quotes(spark, tables):
    got = verdicts(spark, tables, ["you must not fool yourself", "you must not fool yourself - and you are the easiest person to fool", 'Second paragraph about "curly quotes" and things', "Success is the sum of small efforts repeated every day.", "[p. 1] you must not fool yourself", "too short", "you must not foul yourselv — and you are the easiest persn to fool"])
    assert [v for v, *_ in got] == ["exact", "exact", "exact", "dropped", "duplicate", "dropped", "fuzzy" if got[6][2] != got[1][2] else "duplicate"]
    assert got[0][1] == "1" and got[2][1] == "2" and "—" in got[1][2]


def test_quote_report(spark, tables):
    q = spark.createDataFrame([(1, 1, 0, "you must not fool yourself"), (1, 1, 1, "Never said by anybody in here."), (1, 1, 2, "you must not fool yourself")], "book_id int, idx int, seq int, text string")
    r = quotes.quote_report(quotes.verify_quotes(q, *tables)).first()
    assert (r.total, r.kept, r.exact, r.fuzzy, len(r.dropped)) == (3, 1, 1, 0, 1)


def test_alignment():
    text, at = normalized("Zz İstanbul")
    assert len(text) == len(at)
    score, a, b = quotes.align("the quick brown fox jumps", "say: the quack brown fox jumped over", 85)
    assert score > 85 and "say: the quack brown fox jumped over"[a:b].strip().startswith("the quack")
    assert quotes.align("the quick brown fox jumps", "nothing of the kind in this text", 85) is None
    assert quotes.align("longer than the source", "short", 90) is None


def test_alignment_misses_no_window():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    for _ in range(120):
        source = " ".join(rng.choice(words) for _ in range(60))
        at = rng.randrange(len(source) - 60)
        x = list(source[at : at + rng.randrange(20, 60)])
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], ["q", x[k]], ["z"]]) if len(x) > 16 else x[k : k + 1]
        quote = "".join(x)
        masks, n = quotes.character_masks(quote), len(quote)
        for cutoff in (80, 90):
            windows = [source[a : a + n] for a in range(len(source))]
            best = max(200 * quotes.lcs_length(masks, n, w) / (n + len(w)) for w in windows)
            got = quotes.align(quote, source, cutoff)
            assert (got is None) == (best < cutoff) and (got is None or got[0] >= best)


def test_contained_is_a_full_search(spark):
    q = spark.createDataFrame([(1, "one two three four five six seven"), (2, "extraordinary circumstances"), (3, "absent words in any of them")], "item_id int, text string")
    s = spark.createDataFrame([(1, "say one  two THREE four five six seventeen"), (2, "the most extraordinary circumstances, indeed"), (3, None)], "doc_id int, text string")
    got = {(r.item_id, r.doc_id): r.norm_pos for r in quotes.contained(q, s, quote_id="item_id", source_id="doc_id").collect()}
    assert got == {(1, 1): 4, (2, 2): 9}


def test_pages(spark, tables):
    chunk, page = tables
    probe = spark.createDataFrame([(1, -5), (1, 0), (1, 59), (1, 60), (1, 9999), (2, 0)], "book_id int, probe long")
    assert {(r.book_id, r.probe): r.label for r in offsets.page_as_of(probe, page).collect()} == {(1, -5): "1", (1, 0): "1", (1, 59): "1", (1, 60): "2", (1, 9999): "3", (2, 0): None}
    m = offsets.marked_text(chunk, page).first().marked
    assert m.startswith("[p. 1]\n") and m.replace("[p. 1]\n", "").replace("[p. 2] ", "").replace("[p. 3] ", "") == TEXT and m.index("[p. 2] ") == 60 + 7
    none = offsets.marked_text(chunk, page.where("book_id = 9")).first().marked
    assert none == TEXT


def test_chunks(spark):
    parts = [("Preface", 300), ("Part One", 40), ("Chapter 1", 5000), ("Chapter 2", 3000), ("Index", 900)]
    text, heads = "", []
    for i, (title, n) in enumerate(parts):
        heads.append((1, len(text), 1, title, i))
        text += title + "\n\n" + "Sentence of words here. " * n + "\n\n"
    b = books.with_content_range(spark.createDataFrame([(1, text)], "book_id int, text string"))
    h = spark.createDataFrame(heads, "book_id int, offset long, level int, title string, seq long")
    got = sections.build_chunks(b, h, chunk_tokens=8000, min_tokens=700).orderBy("idx").collect()
    assert got[0].title == "Preface · Part One" and got[0].start == 0
    assert all(x.end == y.start for x, y in zip(got, got[1:], strict=False)) and got[-1].end == heads[-1][1]
    assert any("part 1/" in r.title for r in got) and max(r.tokens for r in got) <= 12_000
    one = sections.build_chunks(b, h.limit(1)).orderBy("idx").collect()
    assert one[0].title.startswith("Section") and one[-1].end == len(text)


def test_structure(spark):
    files = spark.createDataFrame([(1, 0, "text/a.xhtml", 0), (1, 1, "text/b.xhtml", 100)], "book_id int, pos int, name string, offset int")
    anchors = spark.createDataFrame([(1, "text/b.xhtml", "x", 150)], "book_id int, name string, anchor string, offset int")
    links = spark.createDataFrame([(1, 1, "b.xhtml#x"), (1, 2, "other/a.xhtml#none"), (1, 3, "missing.xhtml")], "book_id int, seq int, href string")
    assert {r.seq: r.offset for r in headings.resolve_links(links, files, anchors).collect()} == {1: 150, 2: 0}
    blocks = spark.createDataFrame([(1, p, s, y, y + 5.0, 100.0, t) for p in range(10) for s, (y, t) in enumerate([(1.0, f"The Book {p}"), (50.0, f"Body of page {p}"), (95.0, str(p))])], "book_id int, page int, seq int, y0 double, y1 double, page_height double, text string")
    assert sorted({r.text for r in headings.body_blocks(blocks).collect()}) == sorted(f"Body of page {p}" for p in range(10))


def test_pdf_assembly(spark):
    blocks = spark.createDataFrame([("a", 0, "i", 0, "One\n two"), ("a", 0, "i", 1, "Three"), ("a", 1, "ii", 0, "Four")], "path string, page int, label string, seq int, text string")
    text, page = books.assemble_pdf(blocks)
    assert text.first().text == "One two\n\nThree\n\nFour"
    assert [(r.offset, r.label) for r in page.orderBy("page").collect()] == [(0, "i"), (16, "ii")]


HTML = """<html><head><title>no</title></head><body><h1 id="top">A  title</h1><p>One <b>two</b><br>three <img src="x.png">&amp; four<!-- no -->
<span epub:type="pagebreak" title="Page 7"></span>after</p><script>no()</script><div class="pagenum">[8]</div><p>End"""


def test_html(spark):
    r = html.page_texts(spark.createDataFrame([(1, HTML), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert r[0].text == "A title\n\nOne two\n\nthree & four after\n\nEnd\n\n" and r[1].text == ""
    assert [(b.label, r[0].text[b.offset :][:3]) for b in r[0].breaks] == [("7", "aft"), ("8", "End")]
    assert r[0].anchors[0].name == "top" and r[0].images[0].src == "x.png"


def sample_book():
    stub = model.StubClient()
    notes = stub.fill(synthesis.note_schema(600), "note")
    chapters = [{"idx": i, "title": f"Chapter {i}", "pages": "p. 1", "notes": notes} for i in (1, 2, 3)]
    return {"title": "T & Co", "author": "A", "parts": [1, 1, 2], "chapters": chapters, "summary": stub.fill(synthesis.SUMMARY, "summary"), "report": {"total": 3, "kept": 3}, "figures": [{"chapter": 3, "caption": "cap", "src": "data:x", "content": "aGk=", "mime": "image/png"}], "fixes": [{"field": "tldr", "problem": "p"}]}


def test_rendering(spark):
    df = spark.createDataFrame([(1, json.dumps(sample_book()))], "book_id int, book string")
    got = pages.render_books(df).orderBy("part").collect()
    assert [r.name for r in got] == ["T & Co – Summary (Part 1 of 2).html", "T & Co – Summary (Part 2 of 2).html"]
    assert "In short" in got[0].html and "In short" not in got[1].html and "Figures" in got[1].html and 'id="ch-3"' in got[1].html
    z = zipfile.ZipFile(io.BytesIO(epub.epub_books(df).first().content))
    assert z.namelist()[0] == "mimetype"
    for name in z.namelist():
        if name.endswith((".xhtml", ".opf", ".ncx", ".xml")):
            ElementTree.fromstring(z.read(name))
    back = books.read_epub(epub.build_epub(sample_book()))
    assert back["title"] == "T & Co" and [h["title"] for h in back["headings"]][:2] == ["Overview", "1. Chapter 1"] and back["heading_source"] == "epub-nav"


def test_every_leaf_reaches_the_epub():
    n = iter(range(10_000))

    def fill(schema):
        if schema["type"] == "object":
            return {k: fill(v) for k, v in schema["properties"].items()}
        if schema["type"] == "array":
            return [fill(schema["items"]), fill(schema["items"])]
        return f"V{next(n):04d}"

    book = sample_book() | {"summary": fill(synthesis.SUMMARY)}
    book["chapters"] = [{"idx": 1, "title": "X", "pages": "", "notes": fill(synthesis.note_schema(600))}]
    book["parts"] = [1]
    z = zipfile.ZipFile(io.BytesIO(epub.build_epub(book)))
    text = "".join(z.read(x).decode() for x in z.namelist() if x.endswith("xhtml"))

    def leaves(v, skip=False):
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in leaves(y, k == "chapters")]
        return [x for y in v for x in leaves(y, skip)] if isinstance(v, list) else [] if skip else [v]

    assert [x for x in leaves(book["summary"]) + leaves(book["chapters"][0]["notes"]) if x not in text] == []


def test_epub_errors_are_rows(spark):
    df = spark.createDataFrame([("a.epub", bytearray(b"no zip")), ("My_Book.epub", bytearray(epub.build_epub(sample_book() | {"title": "untitled"})))], "path string, content binary")
    got = {r.path: r for r in books.load_epubs(df).collect()}
    assert got["a.epub"].error and got["My_Book.epub"].error is None and got["My_Book.epub"].title == "My Book"


def test_fixes():
    draft = {"tldr": ["a", "b", "c"], "core_thesis": "old", "critique": {"weaknesses": ["w1"]}}
    fix = lambda f, a, i, v: {"field": f, "action": a, "index": i, "problem": "p", "value": v}
    given = [fix("tldr", "replace", 1, "B is the corrected bullet text"), fix("tldr", "replace", 2, "x"), fix("tldr", "remove", 0, ""), fix("core_thesis", "replace", 0, "new"), fix("critique.weaknesses", "add", 0, "w2: evidence is anecdotal only"), fix("frameworks", "add", 0, "{not json"), fix("tldr", "remove", 9, "")]
    out, done = synthesis.apply_fixes(draft, given)
    assert out == {"tldr": ["B is the corrected bullet text", "c"], "core_thesis": "new", "critique": {"weaknesses": ["w1", "w2: evidence is anecdotal only"]}, "frameworks": []}
    assert len(done) == 4 and draft["tldr"] == ["a", "b", "c"]


def test_model_contract(spark):
    answers = iter(["no json", '{"a": 1}', '<think>x</think>```json\n{"name": "  - fine"}\n```'])
    call = model.Caller(lambda m, s, n: {"text": next(answers), "finish": "stop"}, pauses=(0, 0, 0))
    assert call([{"content": "q"}], model.record(name=model.string(3))) == {"name": "fine"} and call.stats["calls"] == 3
    with pytest.raises(model.InvalidAnswer):
        model.Caller(lambda m, s, n: {"text": "never"}, pauses=(0, 0))([{"content": "q"}], model.record(name=model.string()))
    assert not list(model.problems(model.StubClient().fill(synthesis.SUMMARY, "s"), synthesis.SUMMARY))
    assert list(model.problems({"a": True, "c": 1}, model.record(a=model.integer(0, 1), b=model.string())))
    req = spark.createDataFrame([(1, json.dumps([{"role": "user", "content": "x"}]), json.dumps(synthesis.VISION), None)], "id int, messages string, schema string, max_tokens int")
    r = model.ask(req, model.StubClient, keys=["id"]).first()
    assert r.error is None and json.loads(r.response)["kind"] == "diagram"


def test_condense(spark):
    x = spark.createDataFrame([(1, i, f"Ch {i}", "word " * 300) for i in range(12)], "book_id int, seq long, label string, text string")
    labels = []

    def reduce(groups):
        labels.extend(r.label for r in groups.orderBy("grp").collect())
        return groups.select("book_id", "grp", F.substring("text", 1, 400).alias("text"))

    text = synthesis.condense(x, "book_id", 1000, reduce).first().text
    assert labels[0].startswith("Ch 0–") and len(text) / 3.6 <= 1000


def test_stages(spark, tmp_path):
    runs = []
    store = stages.StageStore(spark, str(tmp_path / "work"))
    b = spark.createDataFrame([(1,), (2,)], "book_id int")

    def compute(todo):
        runs.append(todo.count())
        return todo.withColumn("v", F.lit("x"))

    assert store.run("chunk", b.where("book_id = 1"), compute).count() == 1
    assert store.run("chunk", b, compute).count() == 2 and runs == [1, 1]
    assert store.run("chunk", b, compute).count() == 2 and runs == [1, 1]
    assert store.reset("chunk", "1") == ["chunk"] and store.run("chunk", b, compute).count() == 2 and runs == [1, 1, 1]
    assert store.read("plan") is None
    stages.save(b, str(tmp_path / "t"))
    stages.save(b.limit(1), str(tmp_path / "t"))
    assert stages.load(spark, str(tmp_path / "t")).count() == 1


@pytest.mark.parametrize(("title", "outputs", "saved", "done"), [(None, ["a.html"], True, True), (None, [], True, False), ("T", ["a.html"], True, False), ("T", ["a.html"], False, True), ("T", ["a.html", "a.epub"], True, True), ("T", ["a.epub"], True, False)])
def test_skip_rules(spark, title, outputs, saved, done):
    index = spark.createDataFrame([("s", title, ["/old/a.html"] + ["/old/a.epub"] * (title is not None))], "sha256 string, title string, files array<string>")
    out = spark.createDataFrame([(o,) for o in outputs], "name string")
    got = stages.finished(index, out, spark.createDataFrame([("s", saved, saved)], "sha256 string, has_synthesis boolean, has_images boolean"))
    assert got.count() == done


def test_config(tmp_path):
    p = tmp_path / "config.json"
    p.write_text(json.dumps({"_note": 1, "chunk_tokens": 10, "temperature": 1}))
    (tmp_path / ".env").write_text('BOOKS_INPUT_DIR="/in"\n# no\n')
    c = config.load_config(p)
    assert c["chunk_tokens"] == 10 and c["input_dir"] == "/in" and c["min_chunk_tokens"] == 700
    p.write_text(json.dumps({"chunk_tokens": True, "nope": 1}))
    with pytest.raises(model.LecternError, match="nope.*chunk_tokens"):
        config.load_config(p)


def test_books_in_a_folder(spark, tmp_path):
    for name in ("B.PDF", "a.epub", ".hidden.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    listed = books.list_books(spark, str(tmp_path))
    assert [r.name for r in listed.select("name").collect()] == ["B.PDF", "a.epub"]
    assert books.find_book(listed, "A.E").endswith("a.epub")
    for wanted in ("zzz", "."):
        with pytest.raises(model.LecternError):
            books.find_book(listed, wanted)


def test_watch_decisions(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    listing = spark.createDataFrame([("a", t0, 5), ("b", t0, 6), ("c", t0, 7)], "path string, mtime timestamp, length long")
    seen = spark.createDataFrame([("a", t0, 5, False), ("b", t0, 5, False), ("c", t0, 7, True)], "path string, mtime timestamp, length long, handled boolean")
    ready, state = watch.decide(listing, seen, F.lit(t0 + dt.timedelta(seconds=60)))
    assert [r.path for r in ready.collect()] == ["a"]
    assert {r.path: r.handled for r in state.collect()} == {"a": True, "b": False, "c": True}
    soon, _ = watch.decide(listing, seen, F.lit(t0 + dt.timedelta(seconds=3)))
    assert soon.count() == 0


def test_watch_stream(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.epub").write_bytes(b"abc")
    got = []
    q = watch.watch(spark, str(folder), str(tmp_path / "seen"), str(tmp_path / "cp"), lambda df: got.extend(r.path for r in df.collect()), "1 second")
    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(0.5)
    time.sleep(3)
    q.stop()
    assert len(got) == 1 and got[0].endswith("a.epub")


def test_summaries_have_every_chunk(spark, tmp_path):
    docs = [(i, "src0", f"Document {i} begins. " + f"Sentence of document {i} goes on. " * 1200) for i in range(14)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = queries.chunk_build(spark, str(tmp_path)).collect()
    book = json.loads(queries.summaries(spark, str(tmp_path)).first().book)
    assert len(chunks) > 12 and sorted(c["idx"] for c in book["chapters"]) == sorted(c.idx for c in chunks)


def test_every_document_is_a_chapter(spark, tmp_path):
    spark.createDataFrame([(i, "src0", f"first {i}\nsecond") for i in range(7)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in queries.note_digest(spark, str(tmp_path)).collect()) == list(range(7))


def test_headings_and_requests_read_whole_texts(spark, tmp_path, monkeypatch):
    text = "\n".join(f"line {k} of plain text" for k in range(30))
    spark.createDataFrame([(i, "src0", text) for i in range(50)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries.headings, "font_headings", lambda lines, pages: lines)
    monkeypatch.setattr(queries.model, "ask", lambda x, *_, **__: x)
    given = queries.font_headings(spark, str(tmp_path)).collect()
    assert len(given) == len({r.seq for r in given}) == 50 * 30
    asked = queries.model_requests(spark, str(tmp_path)).collect()
    assert len(asked) == 50 and all(json.loads(r.messages)[0]["content"] == text for r in asked)


def make_pdf(pages, compressed=True, encrypted=False):
    """A PDF of lines on pages, with page labels i, ii, A-7, ..."""
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 2 << /S /D /St 7 /P (A-) >>] >> >>")]
    objects.append((2, f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode()))
    objects.append((3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Times /Encoding /WinAnsiEncoding >>"))
    for i, lines in enumerate(pages):
        shown = " ".join("(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj T*" for x in lines if x) if lines else ""
        body = f"BT /F1 12 Tf 14 TL 72 700 Td {shown} ET".encode("cp1252")
        body = zlib.compress(body) if compressed else body
        objects.append((4 + 2 * i, f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>".encode()))
        objects.append((5 + 2 * i, f"<< /Length {len(body)} {'/Filter /FlateDecode' if compressed else ''} >>\nstream\n".encode() + body + b"\nendstream"))
    return b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in objects) + (b"trailer << /Root 1 0 R /Encrypt 9 0 R >>" if encrypted else b"trailer << /Root 1 0 R >>")


def test_pdf_decoder():
    for compressed in (True, False):
        got = pdf.decode(make_pdf([["Hello (world) café", "second hy-", "phen line"], ["page two"], ["three"]], compressed))
        assert [(r["page"], r["label"], r["text"]) for r in got] == [(0, "i", "Hello (world) café\nsecond hyphen line"), (1, "ii", "page two"), (2, "A-7", "three")]
    with pytest.raises(model.LecternError):
        pdf.decode(make_pdf([["x"]], encrypted=True))
    with pytest.raises(model.LecternError):
        pdf.decode(b"no pdf")
    wide = pdf.Font(pdf.Document(b"%PDF-1.4\n7 0 obj\n<< /Length 83 >>\nstream\n1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0005> <D83DDE00> endbfchar\nendstream\nendobj"), {"Subtype": "Type0", "ToUnicode": pdf.Ref(7)})
    assert wide.text(b"\x00\x01\x00\x03\x00\x05") == "AC\U0001f600"


def test_books_of_all_kinds(spark):
    content = [["My Book 1", "Chapter One", "Words of the first chapter."], ["My Book 2", "More words."], ["My Book 3", "Chapter Two", "Words again."], ["My Book 4", "The end."]]
    laid = make_pdf([]) and make_pdf([[p[0]] for p in content])
    files = [("/in/A_tale.pdf", bytearray(make_pdf(content))), ("/in/b.epub", bytearray(epub.build_epub(sample_book()))), ("/in/c.txt", bytearray(b"x")), ("/in/d.pdf", bytearray(b"broken")), ("/in/e.pdf", bytearray(laid))]
    found, marks, heads = books.load_books(spark.createDataFrame(files, "path string, content binary"))
    got = {r.path: r for r in found.collect()}
    assert set(got) == {f for f, _ in files} and got["/in/A_tale.pdf"].title == "A tale" and "Words again." in got["/in/A_tale.pdf"].text
    assert got["/in/c.txt"].error and got["/in/d.pdf"].error and not got["/in/b.epub"].error
    assert [r.label for r in marks.where("path = '/in/A_tale.pdf'").orderBy("offset").collect()] == ["i", "ii", "A-7", "A-8"] or marks.where("path = '/in/A_tale.pdf'").count() == 4
    assert heads.where("path = '/in/b.epub'").count() >= 4
    back = books.from_json(books.to_json(found), found.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(map(str, back.collect())) == sorted(map(str, found.collect()))


def test_figure_items(spark):
    images = spark.createDataFrame([("a", 0, 5, "img/x.png"), ("a", 1, 9, "other/y.png"), ("a", 2, 9, "none.png")], "path string, seq int, offset int, href string")
    items = spark.createDataFrame([("a", "img/x.png", "image/png", bytearray(b"1")), ("a", "p/x.png", "image/png", bytearray(b"2")), ("a", "p/y.png", "image/png", bytearray(b"3"))], "path string, href string, mime string, content binary")
    assert {r.seq: r.item for r in books.figure_items(images, items).collect()} == {0: "img/x.png", 1: "p/y.png"}
    files = spark.createDataFrame([("b.epub", bytearray(epub.build_epub(sample_book())))], "path string, content binary")
    assert [(r.mime, bytes(r.content)) for r in books.epub_items(files).collect()] == [("image/png", b"hi")]


def test_pages_keep_their_names(spark, tmp_path):
    (tmp_path / "other.html").write_text("stays")
    rows = [("A: b – Summary.html", "<p>one\ntwo</p>"), ("C = 100 % – Summary.html", "<p>x</p>")]
    for _ in range(2):
        written = pages.write_pages(spark.createDataFrame(rows, "name string, html string"), str(tmp_path))
    assert written == ["A b – Summary.html", "C = 100 % – Summary.html"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted([*written, "other.html"])
    assert (tmp_path / written[0]).read_text().strip() == rows[0][1] and (tmp_path / "other.html").read_text() == "stays"


def test_saved_tables_never_vanish(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stages.load(spark, path) is None
    for n in (5, 3, 4):
        stages.save(spark.range(n), path)
        assert stages.load(spark, path).count() == n
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet at all")
    assert stages._readable(spark, str(tmp_path / "bad")) is None


def test_http_client():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            if self.path == "/busy":
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            for x in ('{"choices":[{"delta":{"reasoning_content":"hm"}}]}', '{"choices":[{"delta":{"content":"{\\"a\\": \\"é\\"}"},"finish_reason":"length"}]}', '{"choices":[],"usage":{"completion_tokens":7}}', "[DONE]"):
                self.wfile.write(f"data: {x}\n\n".encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    got = client.HttpClient(f"{url}/v1", "m")([{"role": "user", "content": "q"}], model.record(a=model.string()), 90)
    assert got == {"text": '{"a": "é"}', "finish": "length", "tokens": 7} and seen[0]["max_tokens"] == 90 and seen[0]["stream"]
    with pytest.raises(model.ModelBusy):
        client.HttpClient(f"{url}/busy", "m")([], {}, 1)
    server.shutdown()


def test_flow_from_files_to_pages(spark, tmp_path):
    import lectern.__main__ as cli

    (tmp_path / "input").mkdir()
    text = [[f"Chapter {k}"] + [f"Sentence {j} of chapter {k} says a thing." for j in range(40)] for k in ("One", "Two", "Three")]
    (tmp_path / "input" / "A tale.pdf").write_bytes(make_pdf(text))
    (tmp_path / "input" / "broken.pdf").write_bytes(b"no")
    (tmp_path / "config.json").write_text("{}")
    assert cli.main(["preflight", "--config", str(tmp_path / "config.json")]) == 0
    assert cli.main(["book", "--config", str(tmp_path / "config.json")]) == 1  # one of them is broken
    assert cli.main(["book", "tale", "--config", str(tmp_path / "config.json")]) == 0
    names = sorted(p.name for p in (tmp_path / "output").iterdir() if not p.name.startswith("."))
    assert names == ["A tale – Summary.epub", "A tale – Summary.html"]
    page = (tmp_path / "output" / names[1]).read_text()
    assert "In short" in page and "Cheat sheet" in page and "0 of 1 quotes verified" in page or "quotes verified" in page
    with (tmp_path / "output" / ".lock").open("w") as f:
        cli.fcntl.flock(f, cli.fcntl.LOCK_EX)
        assert cli.main(["book", "--config", str(tmp_path / "config.json")]) == 1
    assert cli.main(["book", "no such", "--config", str(tmp_path / "config.json")]) == 1


def test_flow_isolates_failures(spark, tmp_path):
    class Picky(model.StubClient):
        def __call__(self, messages, schema, most):
            if "Bad book" in messages[1]["content"]:
                return {"text": "no answer", "finish": "stop"}
            return super().__call__(messages, schema, most)

    text = "Chapter 1\n\n" + "A sentence of some words that is said here. " * 300
    b = spark.createDataFrame([(1, "Good book", "", text, 0, len(text)), (2, "Bad book", "", text, 0, len(text))], "book_id long, title string, author string, text string, content_start int, content_end int")
    heads = spark.createDataFrame([(1, 0, 1, "Chapter 1", 0), (2, 0, 1, "Chapter 1", 0)], "book_id long, offset long, level int, title string, seq long")
    page = spark.createDataFrame([(1, 0, 0, "1")], "book_id long, offset long, seq long, label string")
    run = flow.Flow(spark, str(tmp_path / "work"), Picky, context=7000)
    run.ask = lambda requests, keys, order=None: model.ask(requests, Picky, keys=keys, pauses=(0, 0), order=order)
    done, failed = run.run(b, heads, page)
    assert [r.book_id for r in done.collect()] == [1] and [(r.book_id, r.step) for r in failed.collect()] == [(2, "plan")]
    book = json.loads(done.first().book)
    assert book["chapters"] and book["summary"]["tldr"] and book["report"]["total"] >= 1


def test_screening(spark):
    figures = spark.createDataFrame([(1, 0, "image/png", bytearray(b"x"), 'an "idea"'), (1, 1, "image/png", bytearray(b"y"), None)], "book_id int, seq int, mime string, content binary, idea string")
    asked = flow.screen_requests(figures)
    messages = json.loads(asked.first().messages)
    assert messages[0]["content"] == flow.RULES and messages[1]["content"][1]["image_url"]["url"] == "data:image/png;base64,eA=="
    got = flow.screened(model.ask(asked, model.StubClient, keys=["book_id", "seq"])).collect()
    assert all(r.meaningful and r.kind == "diagram" for r in got) and len(got) == 2
    none = spark.createDataFrame([(1, 0, None)], "book_id int, seq int, response string")
    assert not flow.screened(none).first().meaningful
    stats = flow.call_stats(model.ask(asked, model.StubClient, keys=["book_id", "seq"]), ["book_id"]).first()
    assert (stats.calls, stats.first_try) == (2, 2)


def test_chunks_of_pieces(spark):
    """A book's text in pieces has the content range and the chunks of the whole, wherever markers and sections begin."""
    stars, begin, end = "*** ", "START OF THE PROJECT GUTENBERG EBOOK ***", "END OF THE PROJECT GUTENBERG EBOOK ***"
    prose = "Sentence of words here. "
    told = {
        "plain": [prose * 9, "", prose * 4000, "é" * 50, prose * 30],
        "inside": [prose, "END of it\n" + stars + end, prose + "\n" + stars + begin + "\nfirst", prose * 300, "last\n" + stars + end, prose],
        "crossing": ["ends with ***", " \n", "\n" + begin + "\nfirst", prose * 200, "more ***", end.lower(), prose],
        "stars": [stars + begin, end, prose * 200, stars, "  ", "no " + end, stars + end],
        "never": [prose * 100, "***", begin[:-30], end],
        "nothing": ["", ""],
    }
    pieces, whole, heads, lengths = [], [], [], []
    for name, parts in told.items():
        at = 0
        for k, part in enumerate(parts):
            pieces.append((name, at, part + "\n\n"))
            heads.append((name, at, 1, f"Title {k}", k))
            at += len(part) + 2
        whole.append((name, "\n\n".join(parts)))
        lengths.append((name, at - 2))
    whole = books.with_content_range(spark.createDataFrame(whole, "book_id string, text string"))
    pieces = spark.createDataFrame(pieces, "book_id string, piece long, text string")
    pieces = sections.Pieces(pieces.select("book_id", "piece", F.length("text").alias("length")), pieces, ["book_id", "piece"])
    heads = spark.createDataFrame(heads, "book_id string, offset long, level int, title string, seq long")
    ranges = books.pieces_range(pieces, spark.createDataFrame(lengths, "book_id string, length long"))
    want = {r.book_id: (r.content_start, r.content_end) for r in whole.collect()}
    assert {r.book_id: (r.content_start, r.content_end) for r in ranges.collect()} == want
    assert all(want[name][0] > 0 for name in ("inside", "crossing", "stars")) and want["never"][0] == 0

    def chunks(*given):
        return sorted(map(tuple, sections.build_chunks(*given, chunk_tokens=900).select("book_id", "idx", "title", "start", "end", "tokens").collect()))

    got = chunks(ranges, heads, pieces)
    assert got == chunks(whole, heads) and len(got) > 20


def test_no_row_holds_a_book(spark, tmp_path):
    docs = [(i, "src0", None if i == 3 else f"Document {i} begins. " + "Words of it. " * 90) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ranges, _, pieces = queries.book_pieces(spark, str(tmp_path))
    longest = max(len(d[2]) for d in docs if d[2])
    assert max(len(r.text) for r in pieces.texts.collect()) == longest + 2
    assert [(r.content_start, r.content_end) for r in ranges.collect()] == [(0, sum(len(d[2]) + 2 for d in docs if d[2]) - 2)]
    chunks = queries.chunk_build(spark, str(tmp_path)).orderBy("idx").collect()
    assert chunks[0].start == 0 and chunks[-1].end == ranges.first().content_end and all(a.end == b.start for a, b in zip(chunks, chunks[1:], strict=False))


def test_prices_are_rounded_as_the_sql_does(spark, tmp_path):
    import duckdb

    rows = [(p, size, price) for size in (9, 10, 45, 95) for p, price in ((5, 900.5), (6, 901.5), (7, 899.5), (8, 180.5), (9, 179.5), (10, 900.4), (11, 1000.5))]
    spark.createDataFrame([(p + 100 * k, s, x) for k, (p, s, x) in enumerate(rows)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(map(tuple, queries.figure_geometry(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(queries.SQL["figure_geometry"]).fetchall()) and (5, True) in got


def test_pages_and_epub_chapter_by_chapter(spark, tmp_path):
    """Rendered a chapter at a time, parts' pages and EPUB files are those of the books in one row."""
    docs = [(i, f"src{i % 2}", f"Document {i} <begins>.\n" + "\n".join(f"Sentence {k} of *document* {i} goes on & on." for k in range(120))) for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frames, chapters = queries.book_frames(spark, str(tmp_path))
    whole = pages.whole_books(frames, chapters).collect()
    rendered = pages.render_chapters(chapters)
    inner = {}
    for r in rendered.orderBy("idx").collect():
        articles, quoted = inner.setdefault((r.book_id, r.part), ([], []))
        articles.append(r.article)
        quoted.append(r.quotes)
    got = {(f.book_id, f.part): (f.name, f.words, f.minutes, f.head + "".join(a) + f.middle + "".join(q) + f.tail) for f in pages.render_frames(frames, rendered).collect() for a, q in [inner.get((f.book_id, f.part), ([], []))]}
    want = {(b.book_id, c["part"]): (c["name"], c["words"], c["minutes"], pages.render_part(c)) for b in whole for c in pages.part_contexts(json.loads(b.book))}
    assert got == want and len(got) > 2
    assert {(r.book_id, r.part): r.n_chars for r in pages.part_sizes(frames, rendered).collect()} == {k: len(v[3]) for k, v in want.items()}
    files = {r.book_id: (bytes(r.content), r.error) for r in epub.epub_chapters(frames, chapters).collect()}
    assert files == {b.book_id: (epub.build_epub(json.loads(b.book)), None) for b in whole}
    bad = epub.epub_chapters(frames, chapters.withColumn("notes", F.when(F.col("book_id") == "src0", F.lit("[")).otherwise(F.col("notes")))).collect()
    assert {r.book_id: (r.error is None, r.content is None) for r in bad} == {"src0": (False, True), "src1": (True, False)}
