"""Named queries over the test tables, each with its SQL where SQL can say it.

Views: a source is a book whose sections are its documents in order of doc_id, joined by blank lines; a
conversation is a book whose pages are its turns; benchmark passages are quotes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import python as fp
from .functions import text as fx
from .operators import figures, headings, offsets, quotes, sections
from .plans import budget, model, stages, synthesis
from .plans.stages import cut
from .render import epub, pages
from .sources import books, html
from .streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def _values(data: list[tuple]) -> str:
    def one(v) -> str:
        return "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in data)


_BOOK = "(select *, coalesce(sum(length(text) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as off from documents)"


def book_view(spark: SparkSession, d: str) -> DataFrame:
    return offsets.running_offsets(t(spark, d, "documents"), "source", "doc_id", F.length("text"))


# ---------------------------------------------------------------- tokens and offsets


@query("select doc_id, cast(length(text) * 5 // 18 + 1 as int) as tokens from documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", fx.est_tokens(F.col("text")).alias("tokens"))


@query(f"select source, doc_id, cast(off as bigint) as start_off, cast(off + length(text) as bigint) as end_off from {_BOOK}")
def book_offsets(spark, d):
    return book_view(spark, d).select("source", "doc_id", "start_off", "end_off")


@query("""select source, count(*) as docs, cast(sum(length(text)) as bigint) as chars, cast(sum(length(text) * 5 // 18 + 1) as bigint) as tokens,
  cast(sum(length(text) * 5 // 18 + 1) * 3 // 4 as bigint) as words, cast(ceil((sum(length(text) * 5 // 18 + 1) * 3 // 4) / 230.0) as int) as minutes from documents group by source""")
def book_token_totals(spark, d):
    g = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(fx.est_tokens(F.col("text"))).alias("tokens"))
    g = g.withColumn("words", budget.words_of_tokens(F.col("tokens")))
    return g.withColumn("minutes", budget.read_minutes(F.col("words")))


def conversation_pages(spark, d):
    c = offsets.running_offsets(t(spark, d, "conversations"), "conv_id", "turn", F.length("text"))
    return c.select("conv_id", F.col("start_off").alias("offset"), F.col("turn").alias("seq"), (F.col("turn") + 1).cast("string").alias("label"), "text")


_PROBES = [-1, 0, 1, 60, 130, 400, 1000, 10**7]
_CONV = "(select *, coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as off from conversations)"


@query(f"""with p as (select conv_id, off, turn, cast(turn + 1 as varchar) as label from {_CONV}), q as (select conv_id, probe from (select distinct conv_id from p), (values {_values([(x,) for x in _PROBES])}) v(probe))
select q.conv_id, cast(q.probe as bigint) as probe, coalesce((select arg_max(label, (off, turn)) from p where p.conv_id = q.conv_id and p.off <= q.probe), (select arg_min(label, (off, turn)) from p where p.conv_id = q.conv_id)) as label from q""")
def page_asof(spark, d):
    p = conversation_pages(spark, d)
    probes = p.select("conv_id").distinct().withColumn("probe", F.explode(F.array(*[F.lit(x).cast("long") for x in _PROBES])))
    return offsets.page_as_of(probes, p, "conv_id")


@query(f"""with p as (select conv_id, turn, off, text from {_CONV}), m as (select conv_id, string_agg(case when off > 0 then '[p. ' || (turn + 1) || '] ' else '' end || text, chr(10) || chr(10) order by turn) as body, arg_min(turn, off) as f from p group by conv_id)
select conv_id, cast(length('[p. ' || (f + 1) || ']' || chr(10) || body) as int) as n, sha256('[p. ' || (f + 1) || ']' || chr(10) || body) as digest from m""")
def page_markers(spark, d):
    p = conversation_pages(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    chunk = p.groupBy("conv_id").agg(text.alias("text")).select("conv_id", F.lit(1).alias("idx"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), "text")
    m = offsets.marked_text(chunk, p.drop("text"), "conv_id")
    return m.select("conv_id", F.length("marked").alias("n"), F.sha2("marked", 256).alias("digest"))


def _points(b):
    """A point every 1777 characters of a book, to its end."""
    return b.groupBy("source").agg(F.max("end_off").alias("e")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("e"), F.lit(1777).cast("long"))).alias("point"))


@query(f"""with b as (select source, doc_id, off, off + length(text) as e from {_BOOK}), q as (select source, unnest(range(cast(0 as bigint), cast(max(e) as bigint) + 1, 1777)) as point from b group by source)
select q.source, q.point, b.doc_id from q left join b on q.source = b.source and q.point >= b.off and q.point < b.e""")
def chunk_for_offset(spark, d):
    b = book_view(spark, d).select("source", "doc_id", "start_off", "end_off")
    q = _points(b)
    return offsets.assign_interval(q, b, "source", "point", "start_off", "end_off").select("source", "point", "doc_id")


@query(f"""with b as (select source, doc_id, off, off + length(text) as e from {_BOOK}), q as (select source, unnest(range(cast(0 as bigint), cast(max(e) as bigint) + 1, 1777)) as point from b group by source)
select source, point from q where exists (select 1 from b where q.source = b.source and q.point >= b.off and q.point < b.e)""")
def figures_inside(spark, d):
    b = book_view(spark, d).select("source", "start_off", "end_off")
    q = _points(b)
    return offsets.assign_interval(q, b, "source", "point", "start_off", "end_off", "left_semi")


# ---------------------------------------------------------------- text

_TITLES = ["Acknowledgments", "Index", "Notes", "Notes on Strategy", "Introduction", "Chapter 12: Epilogue", "The Full Project Gutenberg License", "3. The Power of Habit", "Part IV Conclusion", "Appendix A", "About the Author", "Praise for the book", "How to use this book", "12 Rules", "List of Figures", "Coda", "Civil Index", "  contents.  ", "Bibliography", ""]


def _sql_title(x: str) -> str:
    def like(words: tuple[str, ...], head: str, tail: str) -> str:
        return f"(?i){head}{fx._any(words)}{tail}".replace("'", "''")

    bare = f"regexp_replace({x}, '(?i){fx.TITLE_NUMBER}', '')"

    def m(p: str, v: str) -> str:
        return f"regexp_matches({v}, '{p}')"

    whole, begin = like(fx.SKIP_WHOLE, r"^\s*", r"\s*\.?\s*$"), like(fx.SKIP_BEGINNING, r"^\s*", r"\b")
    front, back = like(fx.FRONT_BEGINNING, r"^\s*", ""), like(fx.BACK_BEGINNING, r"^\s*", "")
    skip = " or ".join(m(p, v) for v in (x, bare) for p in (whole, begin))
    return f"case when {m(like(fx.SKIP_ANYWHERE, '', ''), x)} then 'skip' when {skip} then 'skip' when {m(front, x)} then 'front' when {m(back, x)} then 'back' when {m(front, bare)} then 'front' when {m(back, bare)} then 'back' else 'chapter' end"


@query(f"""with x as (select * from (values {_values([(v,) for v in _TITLES])}) v(title) union all select trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) from pages)
select title, {_sql_title('title')} as kind from x""")
def title_classify(spark, d):
    x = rows(spark, [(v,) for v in _TITLES], "title string").union(t(spark, d, "pages").select(F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))))
    return x.select("title", fx.classify_title(F.col("title")).alias("kind"))


_IDX = fx.INDEX_LINE.replace("'", "''")


@query(rf"""with l as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') as a from documents),
m as (select doc_id, text, len(a) as lines, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0) as total, coalesce(list_sum(list_transform(a, lambda x: case when regexp_matches(x, '{_IDX}') then length(x) else 0 end)), 0) as ic,
  coalesce(list_sum(list_transform(a, lambda x: case when regexp_matches(x, '^\d{{1,3}}[.)]?\s') then length(x) else 0 end)), 0) as nc from l)
select doc_id, cast(lines as int) as lines, cast(total as int) as total, cast(ic as int) as index_chars, lines >= 15 and (ic / greatest(total, 1) > 0.5 or (nc / greatest(total, 1) > 0.6 and contains(lower(text), 'ibid'))) as flag from m""")
def index_like_docs(spark, d):
    m = fx.index_measures(F.col("text"))
    return t(spark, d, "documents").select("doc_id", m["lines"].alias("lines"), m["total"].alias("total"), m["index_chars"].alias("index_chars"), fx.is_index_or_notes(F.col("text")).alias("flag"))


_INDEX = "Index\n" + "\n".join(f"word{i}, {i}, {i + 2}" for i in range(20))
_TAILS = [(-1, "Real chapter text that ends here.\n\n" * 5 + _INDEX), (-2, _INDEX), (-3, "no index"), (-4, "Long line of the text itself, which is no entry of any index at all.\n" + _INDEX.replace("word7,", "a heading\nword7,"))]


def _sql_skip(x: str) -> str:
    whole, begin = fx._WHOLE.replace("'", "''"), fx._BEGINNING.replace("'", "''")
    return f"(regexp_matches({x}, '{whole}') or regexp_matches({x}, '{begin}'))"


@query(rf"""with docs as (select doc_id, text from documents union all select id, replace(v, '\n', chr(10)) from (values {_values([(i, v.replace(chr(10), chr(92) + 'n')) for i, v in _TAILS])}) g(id, v)),
l as (select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as k from docs),
m as (select *, trim(raw) as line, sum(length(raw) + 1) over (partition by doc_id order by k) - length(raw) - 1 as pos from l),
h as (select *, raw <> '' and (regexp_matches(line, '{_IDX}') or {_sql_skip('line')}) as hit from m),
c as (select *, coalesce(sum(cast(hit as int)) over (partition by doc_id order by k desc rows between unbounded preceding and 1 preceding), 0) as seen from h),
s as (select doc_id, coalesce(max(k) filter (not hit and raw <> '' and (length(line) >= 60 or seen = 0)), 0) as stop from c group by doc_id),
r as (select c.doc_id, any_value(text) as text, count(*) filter (hit and k > stop) as run, min(pos) filter (hit and k > stop) as cut from c join s using (doc_id) group by c.doc_id)
select doc_id, cast(case when run >= 8 and cut > 0 then cut else length(text) end as int) as cut, cast(length(text) as int) as length from r""")
def trim_tail(spark, d):
    golden = rows(spark, _TAILS, "doc_id long, text string")
    docs = t(spark, d, "documents").select("doc_id", "text").union(golden)
    return docs.select("doc_id", fx.index_tail(F.col("text")).cast("int").alias("cut"), F.length("text").alias("length"))


@query(r"""with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k, len(string_split(text, chr(10))) as n from documents),
pg as (select source, count(distinct doc_id) as pages from l group by source),
ky as (select source, regexp_replace(lower(trim(line)), '\d+', '#', 'g') as key, count(*) as n from l where k / n <= 0.08 or (k + 1) / n >= 0.92 group by all)
select source, key, n, n >= greatest(3.0, 0.2 * pages) as is_running from ky join pg using (source)""")
def running_headers(spark, d):
    lines = F.split("text", "\n")
    b = t(spark, d, "documents").select("source", "doc_id", F.size(lines).alias("n"), F.posexplode(lines).alias("k", "text"))
    b = b.select("source", F.col("doc_id").alias("page"), (F.col("k") / F.col("n")).alias("y0"), ((F.col("k") + 1) / F.col("n")).alias("y1"), F.lit(1.0).alias("page_height"), "text")
    return headings.running_blocks(b, "source")


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as a from documents) select doc_id, cast(len(a) as int) as words from w""")
def word_count(spark, d):
    return t(spark, d, "documents").select("doc_id", fx.count_words(F.col("text")).alias("words"))


@query(r"""select conv_id, cast(sum(len(list_filter(regexp_split_to_array(role, '\s+'), lambda x: x <> '')) + len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) as bigint) as words from conversations group by conv_id""")
def nested_word_count(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("turns"), F.count("*").alias("n"))
    return c.select("conv_id", fx.count_leaf_words(F.col("turns"), c.schema["turns"].dataType).cast("long").alias("words"))


_THINK = [('<think>hmm</think>{"a":1}',), ("reasoning</think>{}",), ('<think>x</think>```json\n{"a": 2}\n```',), ('{"b":1}<think>never closed',), ('Here it is: {"c": [1, 2]} as asked',), ("no json at all",)]


_ANSWERS = [('{"a":1}', '{"a":1}'), ("{}", "{}"), ('```json\n{"a": 2}\n```', '{"a": 2}'), ('{"b":1}', '{"b":1}'), ('Here it is: {"c": [1, 2]} as asked', '{"c": [1, 2]}'), ("no json at all", None)]


@query(f"""select cast(event_id as varchar) as id, '```json' || chr(10) || props || chr(10) || '```' as plain, props as json from events
union all select 'golden', replace(plain, '\\n', chr(10)), json from (values {_values([(p.replace(chr(10), chr(92) + 'n'), j) for p, j in _ANSWERS])}) v(plain, json)""")
def model_answers(spark, d):
    e = t(spark, d, "events").select("event_id", "props").where("event_id is not null")
    wrapped = F.concat(F.lit("<think>so {"), "event_id", F.lit("}</think>```json\n"), "props", F.lit("\n```"))
    return e.select(F.col("event_id").cast("string").alias("id"), wrapped.alias("answer")).union(rows(spark, _THINK, "answer string").select(F.lit("golden"), "answer")).select("id", fx.strip_think(F.col("answer")).alias("plain"), fx.json_text(F.col("answer")).alias("json"))


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def loose_json(spark, d):
    wrapped = F.concat(F.lit("<think>so {"), F.col("event_id").cast("string"), F.lit("}</think>```json\n"), "props", F.lit("\n```"))
    return t(spark, d, "events").select("event_id", F.get_json_object(fx.json_text(wrapped), "$.k").cast("int").alias("k"))


_MD = ["<b>x</b> **y**", "snake_case_name and _em_", "*a* ** b ** 2*3*4", "plain & 'quoted' \"text\"", "**bold** _it_ *em*", "_ no _ * no *"]


_MD_HTML = [
    "&lt;b&gt;x&lt;/b&gt; <strong>y</strong>", "snake_case_name and <em>em</em>", "<em>a</em> <strong> b </strong> 2*3*4", "plain &amp; &#39;quoted&#39; &#34;text&#34;",
    "<strong>bold</strong> <em>it</em> <em>em</em>", "_ no _ * no *",
]


@query(f"select * from (values {_values(list(zip(_MD, _MD_HTML, strict=True)))}) v(text, html)")
def inline_md(spark, d):
    return rows(spark, [(v,) for v in _MD], "text string").select("text", fx.inline_md(F.col("text")).alias("html"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"


@query(f"""with x as (select item_id, replace(replace(replace(text, chr(10), ' '), '*', ' '), '_', ' ') as v from benchmark)
select item_id, v || ' & end' as plain, '<strong>' || {_ESCAPED.format('v')} || '</strong> &amp; <em>end</em>' as html from x""")
def markdown_passages(spark, d):
    x = F.concat(F.lit("**"), F.translate("text", "\n*_", "   "), F.lit("** & _end_"))
    return t(spark, d, "benchmark").select("item_id", fx.strip_md(x).alias("plain"), fx.inline_md(x).alias("html"))


_REFS = [(1, "Ch 2–3"), (2, "Ch 9"), (3, "Chapters 2, 4"), (4, "none"), (5, "Ch 5-7, 1"), (6, "Ch 7–5")]


@query(f"""with r as (select * from (values {_values(_REFS)}) v(id, ref)), n as (
  select id, ref, unnest(list_transform(regexp_extract_all(ref, '(\\d+)', 1), lambda x: cast(x as int))) as n from r union
  select id, ref, unnest(range(a, case when a <= b then b + 1 else a end)) from (select id, ref, unnest(list_transform(regexp_extract_all(ref, '(\\d+)\\s*[–-]\\s*(\\d+)', 1), lambda x: cast(x as int))) as a, unnest(list_transform(regexp_extract_all(ref, '(\\d+)\\s*[–-]\\s*(\\d+)', 2), lambda x: cast(x as int))) as b from r))
select distinct id, cast(n as int) as n from n""")
def chapter_refs(spark, d):
    return rows(spark, _REFS, "id int, ref string").select("id", F.explode(fx.chapter_numbers(F.col("ref"))).alias("n"))


_LINK = '<a class="ref" href="{}#ch-{}">Ch {}</a>'
_TO2, _TO3, _TO1 = _LINK.format("", 2, 2), _LINK.format("Part%202.html", 3, 3), _LINK.format("", 1, 1)
_LINKS = [(1, f"{_TO2} {_TO3}"), (2, '<span class="ref">Ch 9</span>'), (3, _TO2), (4, '<span class="ref">none</span>'), (5, _TO1), (6, '<span class="ref">Ch 7–5</span>')]


@query(f"select cast(id as int) as id, html from (values {_values(_LINKS)}) v(id, html)")
def chapter_links(spark, d):
    hrefs = F.create_map(F.lit(1), F.lit(""), F.lit(2), F.lit(""), F.lit(3), F.lit("Part%202.html"))
    return rows(spark, _REFS, "id int, ref string").select("id", fx.chapter_link(F.col("ref"), hrefs).alias("html"))


@query(r"""with x as (select trim(regexp_replace(regexp_extract(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '<[^>]+>|\s+', ' ', 'g')) as title from pages union all select * from (values ('Éléments — d''analyse'), ('日本'), ('  A  b/c ')) v(title)),
y as (select title, trim(left(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-') as s from x)
select title, case when s = '' then 'book-' || left(sha256(title), 8) else s end as slug from y""")
def slug(spark, d):
    x = t(spark, d, "pages").select(html.first_heading(F.col("html")).alias("title")).union(rows(spark, [("Éléments — d'analyse",), ("日本",), ("  A  b/c ",)], "title string"))
    return x.select("title", fp.slug("title").alias("slug"))


@query(r"""with x as (select page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) as title from pages),
y as (select page_id, substr(trim(regexp_replace(regexp_replace(title, '[/\\:*?"<>|\n\r\t]+', ' ', 'g'), '\s+', ' ', 'g')), 1, 150) as s from x)
select page_id, case when s = '' then 'Book' else s end as name, case when s = '' then 'Book' else s end || ' – Summary (Part 2 of 3).html' as file from y""")
def safe_name(spark, d):
    x = t(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))
    return x.select("page_id", fx.safe_filename(F.col("title")).alias("name"), fx.output_name(F.col("title"), F.lit(2), F.lit(3)).alias("file"))


@query("select doc_id, sha256(text) as sha from documents")
def fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", books.fingerprint(F.col("text").cast("binary")).alias("sha"))


@query("select page_id, 'data:text/html;base64,' || to_base64(encode(html)) as uri from pages")
def data_uris(spark, d):
    return t(spark, d, "pages").select("page_id", fx.data_uri(F.col("html").cast("binary"), F.lit("text/html")).alias("uri"))


_META = ["", "Untitled", "report.docx", " Real Title ", "unknown", "a.pdf", "The .pdf story"]


@query(f"select v as raw, case when trim(v) = '' or lower(trim(v)) in ('untitled', 'unknown', 'none') or regexp_matches(trim(v), '(?i)\\.(docx?|indd|pdf|qxd)$') then '' else trim(v) end as clean from (values {_values([(v,) for v in _META])}) x(v)")
def clean_metadata(spark, d):
    return rows(spark, [(v,) for v in _META], "raw string").select("raw", fx.clean_meta(F.col("raw")).alias("clean"))


@query("""select doc_id, cast(length('head' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK ***') as int) as content_start, cast(length('head' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK ***' || chr(10) || text || chr(10)) as int) as content_end from documents""")
def content_range(spark, d):
    text = F.concat(F.lit("head\n*** START OF THE PROJECT GUTENBERG EBOOK ***\n"), "text", F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK ***\ntail"))
    return t(spark, d, "documents").select("doc_id", fx.content_start(text).alias("content_start"), fx.content_end(text).alias("content_end"))


_WORD, _GAPS = r"[\p{L}\p{M}\p{N}_]+", r"[^\p{L}\p{M}\p{N}_]*"


@query(rf"""with w as (select doc_id, text, regexp_extract_all(text, '{_WORD}') as a from documents), p as (select doc_id, text, array_to_string(a[len(a) // 2 + 1:len(a) // 2 + 4], '{_GAPS}') as p from w)
select doc_id, case when p = '' then 0 else cast(length(regexp_extract(text, '(?is)^(.*?)(?:' || p || ')', 1)) as int) end as at from p""")
def title_location(spark, d):
    """Where the first four words of the second half of a document stand in it, with other signs between them."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    x = t(spark, d, "documents").withColumn("w", words)
    title = F.array_join(F.slice("w", F.floor(F.size("w") / 2).cast("int") + 1, F.lit(4)), "  - ")
    return x.select("doc_id", fx.locate_title(text, title).alias("at"))


@query("""select cast(1 as int) as id, '{"a":"text","b":["one","two-three","x"]}' as v""")
def tidy_strings(spark, d):
    x = rows(spark, [(1, {"a": "  , • text ", "b": ["- one", "two-three ", ";:x"]})], "id int, v struct<a:string,b:array<string>>")
    return x.select("id", F.to_json(fx.tidy(F.col("v"), x.schema["v"].dataType)).alias("v"))


# ---------------------------------------------------------------- html


@query()
def html_text(spark, d):
    return html.page_texts(t(spark, d, "pages").select("page_id", "html")).select("page_id", F.length("text").alias("n_chars"), "text", F.size("anchors").alias("anchors"), F.size("images").alias("images"))


@query(r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '<[^>]+>|\s+', ' ', 'g')) as title from pages")
def html_titles(spark, d):
    return t(spark, d, "pages").select("page_id", html.first_heading(F.col("html")).alias("title"))


# ---------------------------------------------------------------- sections

_GAP = 5000


@query(f"""with recursive h as (select source, cast(off as bigint) as off, row_number() over (partition by source order by off) as rn from {_BOOK}),
f as (select source, rn, off as last, true as kept from h where rn = 1 union all
  select h.source, h.rn, case when h.off - f.last >= {_GAP} then h.off else f.last end, h.off - f.last >= {_GAP} from f join h on h.source = f.source and h.rn = f.rn + 1)
select source, last as kept_offset from f where kept""")
def heading_dedup(spark, d):
    h = book_view(spark, d).select("source", F.col("start_off").alias("offset"), F.lit(1).alias("level"), F.lit("").alias("title"), F.col("doc_id").alias("seq"))
    return sections.dedup_headings(h, "source", _GAP).select("source", F.col("offset").alias("kept_offset"))


_SECT = f"(select source, doc_id, cast(off as bigint) as a, cast(coalesce(lead(off) over (partition by source order by doc_id), off + length(text)) as bigint) as b, row_number() over (partition by source order by doc_id) as rn, count(*) over (partition by source) as n from {_BOOK})"


def section_view(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    b = book_view(spark, d)
    return b.select("source", F.col("doc_id").alias("seq"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("chapter").alias("kind"), F.col("start_off").alias("start"), F.coalesce(F.lead("start_off").over(w), F.col("end_off")).alias("end"))


@query(f"""with recursive s as {_SECT},
f as (select source, rn, a as c0, a as o, b as o_end, (b - a) * 5 // 18 + 1 < 150 and rn < n as carry from s where rn = 1 union all
  select s.source, s.rn, s.a, case when f.carry and f.o_end = s.a then f.o else s.a end, s.b, (s.b - case when f.carry and f.o_end = s.a then f.o else s.a end) * 5 // 18 + 1 < 150 and s.rn < s.n
  from f join s on s.source = f.source and s.rn = f.rn + 1)
select source, o as start, o_end as "end" from f where not carry""")
def section_fold(spark, d):
    return sections.fold_sections(section_view(spark, d), "source").select("source", "start", "end")


@query(f"""with recursive s as {_SECT},
f as (select source, rn, a as g, b as e, 1 as grp, 1 as titles from s where rn = 1 union all
  select s.source, s.rn, case when m then f.g else s.a end, s.b, case when m then f.grp else f.grp + 1 end, case when m then f.titles + 1 else 1 end
  from (select f.*, s.a as sa, least((f.e - f.g) * 5 // 18 + 1, (s.b - s.a) * 5 // 18 + 1) < 700 and (f.e - f.g) * 5 // 18 + 1 + (s.b - s.a) * 5 // 18 + 1 <= 8000 and f.e = s.a as m from f join s on s.source = f.source and s.rn = f.rn + 1) f join s on s.source = f.source and s.rn = f.rn + 1)
select source, min(g) as start, max(e) as "end", cast(max(titles) as int) as n_titles from f group by source, grp""")
def section_merge(spark, d):
    return sections.merge_sections(section_view(spark, d), "source").select("source", "start", "end", F.size("titles").alias("n_titles"))


@query(f"""with h as (select source, doc_id, cast(off as bigint) as off, cast(doc_id % 3 + 1 as int) as level, sum(length(text) + 2) over (partition by source) - 2 as total from {_BOOK}),
x as (select h.*, lv from h join (select distinct source, level as lv from h) l on h.source = l.source and h.level <= lv),
z as (select source, lv, (coalesce(lead(off) over (partition by source, lv order by off, level, doc_id), total) - off) * 5 // 18 + 1 as tok from x),
g as (select source, lv, median(tok) filter (tok >= 300) as mid, count(*) filter (tok >= 300) as n from z group by all)
select source, coalesce(min(lv) filter (n >= 4 and mid <= 600), max(lv)) as level from g group by source""")
def level_pick(spark, d):
    b = book_view(spark, d)
    total = F.max("end_off").over(Window.partitionBy("source"))
    h = b.select("source", F.col("start_off").alias("offset"), (F.col("doc_id") % 3 + 1).cast("int").alias("level"), F.lit("A title").alias("title"), F.col("doc_id").alias("seq"), total.alias("content_end"))
    return sections.pick_level(h, "source", chunk_tokens=300)


_BREAKS = "list_filter(list_transform(range(1, len({0}) + 1), lambda i: list_sum(list_transform({0}[1:i], lambda x: length(x)))), lambda b: b > 0 and b < len_)"


@query(rf"""with recursive d as (select doc_id, length(text) as len_, cast(ceil((length(text) * 5 // 18 + 1) / 600.0) as int) as n, regexp_extract_all(text, '(?s).*?\n\s*\n') as pp, regexp_extract_all(text, '(?s).*?(?:[.!?]["”’)]|[.!?])\s+') as sp from documents where length(text) * 5 // 18 + 1 > 600),
p as (select doc_id, len_, n, case when len(pp) < 3 * n then {_BREAKS.format('sp')} else {_BREAKS.format('pp')} end as breaks from d),
f as (select doc_id, 0 as k, cast(0 as bigint) as start, 0 as made, cast(null as bigint) as a, cast(null as bigint) as b from p union all
  select doc_id, k + 1, case when ok then cut else start end, made + cast(ok as int), case when ok then start end, cut from (
    select *, start < cut and cut < len_ as ok from (
      select f.doc_id, f.k, f.start, f.made, p.len_, coalesce(list_sort(list_transform(list_filter(p.breaks, lambda x: x > f.start), lambda x: {{'d': abs(x - p.len_ * (f.k + 1) // p.n), 'x': x}}))[1].x, p.len_ * (f.k + 1) // p.n) as cut
      from f join p using (doc_id) where f.k + 1 < p.n)))
select doc_id, cast(made - 1 as int) as k, cast(a as int) as start, cast(b as int) as "end" from f where a is not null
union all select doc_id, cast(made as int), cast(start as int), cast(len_ as int) from f join p using (doc_id) where f.k = p.n - 1""")
def split_spans(spark, d):
    x = t(spark, d, "documents").where(fx.est_tokens(F.col("text")) > 600)
    s = F.posexplode(sections.split_spans("text", sections.parts_of(F.col("text"), 600)))
    return x.select("doc_id", s.alias("k", "s")).select("doc_id", "k", "s.start", "s.end")


def book_pieces(spark, d):
    """Content ranges, headings and texts of the sources as books. A text's pieces are its documents, each with the blank
    line after it, so no row holds a book, and offsets are made without texts."""
    key = [F.col("source").alias("book_id"), "doc_id", F.xxhash64("text").alias("h")]
    docs = t(spark, d, "documents")
    b = cut(offsets.running_offsets(docs.select(*key, F.length("text").alias("n")), "book_id", ["doc_id", "h"], F.col("n")))
    places = b.where("n is not null").select("book_id", "doc_id", "h", F.col("start_off").alias("piece"), (F.col("n") + 2).alias("length"))
    texts = docs.where("text is not null").select(*key, F.concat("text", F.lit("\n\n")).alias("text"))
    lengths = b.groupBy("book_id").agg(F.coalesce(F.max("end_off"), F.lit(0)).alias("length"))
    heads = b.select("book_id", F.col("start_off").alias("offset"), F.lit(1).alias("level"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").alias("seq"))
    pieces = sections.Pieces(places, texts, ["book_id", "doc_id", "h"])
    return books.pieces_range(pieces, lengths), heads, pieces


@query()
def chunk_build(spark, d):
    return sections.build_chunks(*book_pieces(spark, d)).select("book_id", "idx", "title", "kind", "start", "end", "tokens")


_PARTS, _EXTRA = 3, 2500


@query(f"""with recursive s as (select source, doc_id, (length(text) * 5 // 18 + 1) * 3 // 4 as size, row_number() over (partition by source order by doc_id) as rn, count(*) over (partition by source) as n, (sum((length(text) * 5 // 18 + 1) * 3 // 4) over (partition by source) + {_EXTRA}) / least({_PARTS}, count(*) over (partition by source)) as target from documents),
f as (select source, cast(0 as bigint) as rn, 1 as part, cast({_EXTRA} as double) as load, cast(-1 as bigint) as doc_id from s where rn = 1 union all
  select s.source, s.rn, f.part + cast(up as int), case when up then 0 else f.load end + s.size, s.doc_id
  from (select f.*, s.rn as r2, f.part < least({_PARTS}, s.n) and f.load > 0 and (f.load + s.size / 2 > s.target or s.n - s.rn + 1 = least({_PARTS}, s.n) - f.part) as up from f join s on s.source = f.source and s.rn = f.rn + 1) f join s on s.source = f.source and s.rn = f.r2)
select source, doc_id, cast(part as int) as part from f where rn > 0""")
def part_split(spark, d):
    s = t(spark, d, "documents").select("source", "doc_id", budget.words_of_tokens(fx.est_tokens(F.col("text"))).alias("size"))
    return budget.assign_parts(s, "source", "doc_id", "size", _PARTS, _EXTRA)


@query("""with recursive s as (select source, doc_id, length(text) as n, row_number() over (partition by source order by doc_id) as rn from documents),
f as (select source, rn, doc_id, 1 as grp, n as total from s where rn = 1 union all
  select s.source, s.rn, s.doc_id, case when (f.total + 2 + s.n) * 5 // 18 + 1 > 8000 then f.grp + 1 else f.grp end, case when (f.total + 2 + s.n) * 5 // 18 + 1 > 8000 then s.n else f.total + 2 + s.n end from f join s on s.source = f.source and s.rn = f.rn + 1)
select source, doc_id, cast(grp as int) as grp from f""")
def group_pack(spark, d):
    x = t(spark, d, "documents").select("source", "doc_id", F.length("text").alias("length"))
    return synthesis.pack_groups(x, "source", "doc_id", 8000)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
u as (select doc_id, k, sum(length(line) * 5 // 18 + 2) over (partition by doc_id order by k) as used from l)
select doc_id, cast(count(*) filter (used <= 400) as int) as kept_lines from u group by doc_id""")
def budget_prefix(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    kept = synthesis.running_prefix(x, ["doc_id"], "k", 400).groupBy("doc_id").agg(F.count("*").cast("int").alias("kept_lines"))
    return t(spark, d, "documents").select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept_lines", F.lit(0)).alias("kept_lines"))


@query("""with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
u as (select *, sum(length(line) * 5 // 18 + 2) over (partition by doc_id order by k) as used from l),
g as (select doc_id, any_value(text) as text, coalesce(sum(length(line) + 1) filter (used <= 400) - 1, 0) as n from u group by doc_id)
select doc_id, cast(case when n = 0 then least(length(text), 1440) else n end as int) as n from g""")
def budget_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length(synthesis.paragraph_prefix(F.col("text"), 400, "\n")).alias("n"))


# ---------------------------------------------------------------- budgets


@query("""with g as (select cast(m as int) as minutes, cast(n as int) as chunks, cast(m * 230 as int) as total from range(5, 125, 5) a(m), range(1, 41, 3) b(n)), o as (select *, least(2600, cast(floor(total * 0.45::double) as int)) as overview from g)
select minutes, chunks, overview, greatest(120, cast(floor(floor((total - overview) * 0.85::double) / chunks) as int)) as per_chunk from o""")
def budgets(spark, d):
    g = spark.range(5, 125, 5).select(F.col("id").cast("int").alias("minutes")).withColumn("chunks", F.explode(F.sequence(F.lit(1), F.lit(40), F.lit(3))))
    return g.withColumn("b", budget.budgets(F.col("minutes"), F.col("chunks"))).select("minutes", "chunks", "b.overview", "b.per_chunk")


@query("select cast(w as int) as words, " + ", ".join(f"greatest({lo}, least({hi}, cast(round_even(w / {per}.0::double, 0) as int))) as {name}" for name, (per, lo, hi) in budget.CAPS.items()) + " from range(50, 2000, 25) r(w)")
def note_caps(spark, d):
    return spark.range(50, 2000, 25).select(F.col("id").cast("int").alias("words")).withColumn("c", budget.note_caps(F.col("words"))).select("words", "c.*")


@query("""with g as (select cast(w as int) as wanted, cast(p as int) as part, greatest(10, 120) as hi, greatest(5, least(p - 10, 120)) as lo from range(1, 140, 7) a(w), (values (20), (30), (45)) b(p)), m as (select *, greatest(lo, least(hi, wanted)) as minutes from g)
select wanted, part, cast(lo as int) as lo, cast(hi as int) as hi, cast(minutes as int) as minutes, greatest(1, least(cast(ceil(minutes / part) as int), cast(ceil(hi / part) as int))) as parts from m""")
def read_plan(spark, d):
    g = spark.range(1, 140, 7).select(F.col("id").cast("int").alias("wanted")).withColumn("part", F.explode(F.array(F.lit(20), F.lit(30), F.lit(45))))
    return g.withColumn("p", budget.read_plan(F.col("wanted"), F.col("part"), F.lit(120))).select("wanted", "part", "p.*")


# ---------------------------------------------------------------- quotes


@query(r"""with q as (select item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' "''.,;:') as k from benchmark), s as (select doc_id, lower(ltrim(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents)
select item_id, doc_id, cast(strpos(t, k) - 1 as int) as norm_pos from q join s on contains(t, k) where length(k) >= 15""")
def quote_exact(spark, d):
    return quotes.contained(t(spark, d, "benchmark"), t(spark, d, "documents"), quote_id="item_id", source_id="doc_id")


def _quotes(spark, d, edit=None):
    """Benchmark passages as quotes of the documents that hold them, and for every document one that nobody wrote."""
    found = quotes.contained(t(spark, d, "benchmark"), t(spark, d, "documents"), quote_id="item_id", source_id="doc_id")
    text = F.col("text") if edit is None else edit(F.col("text"))
    true = found.join(t(spark, d, "benchmark"), "item_id").select(F.col("doc_id").alias("book_id"), F.lit(1).alias("idx"), F.col("item_id").alias("seq"), text.alias("text"))
    false = t(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.lit(1).alias("idx"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("Nobody has written sentence "), "doc_id", F.lit(" of this whole book; judge yourself why.")).alias("text"))
    return true.union(false)


def _sources(spark, d):
    docs = t(spark, d, "documents")
    chunk = docs.select(F.col("doc_id").alias("book_id"), F.lit(1).alias("idx"), F.lit(0).cast("long").alias("start"), "text")
    page = docs.select(F.col("doc_id").alias("book_id"), F.posexplode(F.sequence(F.lit(0), F.length("text"), F.lit(1000))).alias("seq", "offset")).select("book_id", "seq", F.col("offset").cast("long").alias("offset"), (F.col("seq") + 1).cast("string").alias("label"))
    return chunk, page


@query()
def quote_fuzzy(spark, d):
    edit = lambda x: F.concat(F.substring(x, 1, 25), F.substring(x, 27, 20), F.lit("x"), F.substring(x, 47, 1000))
    chunk, page = _sources(spark, d)
    return quotes.verify_quotes(_quotes(spark, d, edit), chunk, page).select("book_id", "seq", "verdict", "found", "page", "score")


_HELD = r"""with q as (select item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' "''.,;:') as k from benchmark), s as (select doc_id, lower(ltrim(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents),
n as (select doc_id, count(*) as c, count(distinct k) as kept from q join s on contains(t, k) where length(k) >= 15 group by doc_id),
r as (select doc_id as book_id, 1 + coalesce(c, 0) as total, coalesce(kept, 0) as kept from documents left join n using (doc_id))"""


@query(_HELD + " select book_id, total, kept, kept as exact, cast(0 as bigint) as fuzzy, cast(1 as int) as dropped from r")
def quote_totals(spark, d):
    chunk, page = _sources(spark, d)
    return quotes.quote_report(quotes.verify_quotes(_quotes(spark, d), chunk, page)).withColumn("dropped", F.size("dropped"))


@query(_HELD + " select cast(sum(total) as bigint) as total, cast(sum(kept) as bigint) as kept, cast(sum(kept) as bigint) as exact, cast(0 as bigint) as fuzzy, count(*) as dropped from r")
def quote_report(spark, d):
    chunk, page = _sources(spark, d)
    r = quotes.quote_report(quotes.verify_quotes(_quotes(spark, d), chunk, page))
    return r.agg(*[F.sum(c).alias(c) for c in ("total", "kept", "exact", "fuzzy")], F.sum(F.size("dropped")).alias("dropped"))


# ---------------------------------------------------------------- figures and choices


@query("select min(doc_id) as doc_id from documents group by text")
def dedup_first_wins(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"))
    return figures.first_of(x, ["h", "s"], ["doc_id"]).select("doc_id")


@query("select sha256(text) as text_hash, count(*) as n from documents group by text having count(*) > 2")
def repeat_suppress(spark, d):
    return figures.repeated(t(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash")), ["text_hash"])


@query("""with r as (select source, doc_id, row_number() over (partition by source order by length(text) desc, doc_id) as k from documents)
select source, doc_id, cast(row_number() over (partition by source order by doc_id) as int) as rank from r where k <= 15""")
def topk_then_reorder(spark, d):
    x = t(spark, d, "documents").select("source", "doc_id", F.length("text").alias("area"))
    return figures.top_then_order(x, "source", [F.desc("area"), "doc_id"], ["doc_id"], 15).select("source", "doc_id", "rank")


@query("""select d.doc_id from documents d left join labels l using (doc_id) where coalesce(l.quality = 1 and (d.lang in ('en', 'fr') or (d.lang = 'de' and d.doc_id % 10 >= 8)), false)""")
def screen_keep(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("lang").isin("en", "fr"), "diagram").when(F.col("lang") == "de", "photo").otherwise("text")
    return x.where(fx.keep_figure(F.col("quality") == 1, kind, F.col("doc_id") % 10)).select("doc_id")


@query("""select p_partkey, coalesce(least(w, h) >= 160 and w * h >= 51200 and w / h between 0.2 and 5 and (shown is null or shown >= 0.04) and uses <= 2, false) as keep
from (select p_partkey, p_size * 20 as w, cast(p_retailprice as int) as h, case when p_partkey % 5 = 0 then null else (p_partkey % 100) / 500.0 end as shown, p_partkey % 4 as uses from part)""")
def figure_geometry(spark, d):
    p = t(spark, d, "part")
    shown = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 100) / F.lit(500.0))
    return p.select("p_partkey", fx.accept_geometry(F.col("p_size") * 20, F.rint("p_retailprice").cast("int"), shown, F.col("p_partkey") % 4).alias("keep"))


@query("""with s as (select source, cast(length(text) // 500 as bigint) as size, sum(length(text)) as chars, min(doc_id) as f from documents group by all)
select source, arg_max(size, (chars, -f)) as body from s group by source""")
def font_mode(spark, d):
    x = t(spark, d, "documents").select("source", F.expr("length(text) div 500").alias("size"), F.col("doc_id").alias("seq"), "text")
    return headings.body_size(x, "source")


@query("""with s as (select source, count(*) as n, min(doc_id % 97) as x0, min(doc_id % 89) as y0, max(doc_id % 97 + 20) as x1, max(doc_id % 89 + 20) as y1 from documents group by source)
select source as book_id, cast(0 as int) as page, cast(x0 as bigint) as x0, cast(y0 as bigint) as y0, cast(x1 as bigint) as x1, cast(y1 as bigint) as y1, (x1 - x0) * (y1 - y0) / 20000.0::double as share from s where n >= 25 and (x1 - x0) * (y1 - y0) / 20000.0 between 0.08 and 0.9""")
def vector_figures(spark, d):
    x = t(spark, d, "documents").select(F.col("source").alias("book_id"), F.lit(0).alias("page"), (F.col("doc_id") % 97).alias("x0"), (F.col("doc_id") % 89).alias("y0"), (F.col("doc_id") % 97 + 20).alias("x1"), (F.col("doc_id") % 89 + 20).alias("y1"), F.lit(20000.0).alias("page_area"))
    return figures.vector_figures(x)


_PIXEL = "cast(trunc(px[{}] * 1000::float) as int)"
_NIBBLES = " || ".join("printf('%x', " + " + ".join(f"{8 >> b} * cast({_PIXEL.format(9 * (n // 2) + 4 * (n % 2) + b + 1)} > {_PIXEL.format(9 * (n // 2) + 4 * (n % 2) + b + 2)} as int)" for b in range(4)) + ")" for n in range(16))


@query(f"""with g as (select vec_id, label, list_concat(embedding[1:64], embedding[1:8]) as px from embeddings),
x as (select vec_id % 10 as book_id, vec_id as seq, label as ref, vec_id % 2 as page, 200 + vec_id % 300 as w, 180 + vec_id % 400 as h, {_NIBBLES} as dhash from g),
u as (select book_id, ref, count(distinct page) as uses from x group by all),
f as (select x.*, row_number() over (partition by book_id, dhash order by seq) as k from x join u using (book_id, ref) where least(w, h) >= 160 and w * h >= 51200 and w / h between 0.2 and 5 and uses <= 2),
b as (select *, row_number() over (partition by book_id order by w * h desc, seq) as big from f where k = 1)
select book_id, seq, cast(row_number() over (partition by book_id order by seq) as int) as rank, dhash from b where big <= 30""")
def figure_candidates(spark, d):
    e = t(spark, d, "embeddings")
    gray = F.transform(F.concat(F.slice("embedding", 1, 64), F.slice("embedding", 1, 8)), lambda v: (v * 1000).cast("int"))
    x = e.select((F.col("vec_id") % 10).alias("book_id"), F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("ref"), (F.col("vec_id") % 2).alias("page"), (F.lit(200) + F.col("vec_id") % 300).alias("width"), (F.lit(180) + F.col("vec_id") % 400).alias("height"), F.lit(0.2).alias("shown"), fp.image_hash(gray).alias("dhash"))
    return figures.candidates(x).select("book_id", "seq", "rank", "dhash")


@query("""with x as (select source as book_id, doc_id as seq, length(text) as area, quality, case when lang = 'en' then 'chart' else 'photo' end as kind, doc_id % 10 + 1 as importance from documents join labels using (doc_id)),
k as (select *, row_number() over (partition by book_id order by importance desc, area desc, seq) as k from x where quality = 1 and (kind = 'chart' or importance >= 8)),
r as (select book_id, seq, cast(row_number() over (partition by book_id order by seq) as int) as rank from k where k <= 15)
select book_id, seq, rank, 'fig_' || lpad(cast(rank as varchar), 2, '0') || '.png' as file from r""")
def figure_selection(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    x = x.select(F.col("source").alias("book_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("offset"), F.length("text").alias("area"), (F.col("quality") == 1).alias("meaningful"), F.when(F.col("lang") == "en", "chart").otherwise("photo").alias("kind"), (F.col("doc_id") % 10 + 1).alias("importance"))
    s = figures.select_figures(x)
    return s.select("book_id", "seq", "rank", figures.figure_file(F.col("rank"), F.lit("image/png")).alias("file"))


# ---------------------------------------------------------------- structure


@query("""with c as (select source as book_id, case when doc_id % 2 = 0 then 'toc' when doc_id % 3 = 0 then 'heading' else 'spine' end as source from documents),
n as (select book_id, source, count(*) as n from c where source <> 'toc' or book_id in ('src2', 'src4') group by all),
r as (select *, row_number() over (partition by book_id order by case source when 'toc' then 1 when 'heading' then 2 else 3 end) as k from n where n >= case when source = 'spine' then 1 else 3 end)
select book_id, source, n from r where k = 1""")
def heading_cascade(spark, d):
    toc = t(spark, d, "documents").select(F.col("source").alias("book_id"), F.when(F.col("doc_id") % 2 == 0, "toc").when(F.col("doc_id") % 3 == 0, "heading").otherwise("spine").alias("source"), F.col("doc_id").alias("offset"))
    return headings.cascade(toc.where("source <> 'toc' or book_id in ('src2', 'src4')"), {"toc": 3, "heading": 3, "spine": 1}).groupBy("book_id", "source").agg(F.count("*").alias("n"))


@query()
def font_headings(spark, d):
    x = t(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).where("trim(text) <> ''")
    seq = F.shiftleft("doc_id", 24) + F.col("k")
    lines = x.select(F.col("source").alias("book_id"), seq.alias("seq"), F.col("doc_id").alias("page"), F.when(F.col("k") == 0, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).otherwise(F.col("text")).alias("text"), F.when((F.col("k") == 0) & (F.floor(F.col("doc_id") / 20) % 3 == 0), 18.0).otherwise(10.0).alias("size"))
    return headings.font_headings(lines, x.select(F.col("source").alias("book_id"), "doc_id").distinct())


@query("select cast(b as int) as book_id, cast(q as int) as seq, href, cast(o as int) as \"offset\" from (values (1, 1, 'b.xhtml#x', 150), (1, 2, 'text/b.xhtml', 100), (1, 3, 'other/c.xhtml#none', 200), (1, 5, 'text%2Fa.xhtml', 0)) v(b, q, href, o)")
def link_resolution(spark, d):
    files = rows(spark, [(1, 0, "text/a.xhtml", 0), (1, 1, "text/b.xhtml", 100), (1, 2, "c.xhtml", 200)], "book_id int, pos int, name string, offset int")
    anchors = rows(spark, [(1, "text/b.xhtml", "x", 150)], "book_id int, name string, anchor string, offset int")
    links = rows(spark, [(1, 1, "b.xhtml#x"), (1, 2, "text/b.xhtml"), (1, 3, "other/c.xhtml#none"), (1, 4, "missing.xhtml"), (1, 5, "text%2Fa.xhtml")], "book_id int, seq int, href string")
    return headings.resolve_links(links, files, anchors)


@query("""with recursive e as (select doc_id as id, case when doc_id < 5 then null else doc_id // 5 end as parent, doc_id as seq from documents), w as (select id, 1 as level from e where parent is null union all select e.id, w.level + 1 from e join w on e.parent = w.id) select id, cast(level as int) as level from w""")
def toc_tree(spark, d):
    e = t(spark, d, "documents").select(F.lit(1).alias("book_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") >= 5, F.floor(F.col("doc_id") / 5)).alias("parent"), F.col("doc_id").alias("seq"))
    return headings.flatten_toc(e).select("id", "level")


@query("""with s as (select source as path, doc_id, row_number() over (partition by source order by doc_id) - 1 as page, case when source = 'src1' then 'x' else cast(doc_id as varchar) end as label from documents)
select path, cast(page as int) as page, case when path = 'src1' then cast(page + 1 as varchar) else label end as label from s""")
def page_labels(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    x = t(spark, d, "documents").select(F.col("source").alias("path"), (F.row_number().over(w) - 1).alias("page"), F.when(F.col("source") == "src1", "x").otherwise(F.col("doc_id").cast("string")).alias("label"))
    return books.page_labels(x)


@query("""select source as path, cast(sum(length(text)) as bigint) as chars, count(*) as pages, count(*) filter (length(trim(text)) < 20) as empty,
  case when sum(length(text)) < greatest(200, 40 * count(*)) then 'scanned' when count(*) filter (length(trim(text)) < 20) > 0.5 * count(*) then 'sparse' else 'ok' end as verdict from documents group by source""")
def scan_guard(spark, d):
    return books.scan_guard(t(spark, d, "documents").select(F.col("source").alias("path"), "text"))


# ---------------------------------------------------------------- synthesis and corrections


def stub_notes(spark, d):
    """Notes of each document as a chapter: pieces of its text in the fields."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    x = t(spark, d, "documents").select("source", "doc_id", "text", lines.alias("l"))
    return x.select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("_index"), F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")).alias("_title"), F.lit("pp. 1–2").alias("_pages"),
        F.substring("text", 1, 80).alias("core_idea"), F.substring("text", 1, 300).alias("summary"), F.slice("l", 1, 7).alias("key_arguments"),
        F.array(F.struct(F.lit("F").alias("name"), F.substring("text", 10, 50).alias("description"), F.slice("l", 2, 2).alias("steps"))).alias("frameworks"),
        F.transform(F.slice("l", 1, 5), lambda s: F.struct(F.substring(s, 1, 30).alias("fact"), F.lit("c").alias("context"))).alias("data_points"),
        F.array(F.struct(F.lit("S").alias("title"), F.substring("text", 5, 60).alias("story"), F.lit("lesson").alias("lesson"))).alias("examples"), F.slice("l", 1, 6).alias("takeaways"),
    )


_DIGESTS = """with l as (select source, doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') as l from documents),
n as (select source, doc_id, '[Ch ' || doc_id || '] Chapter ' || doc_id || ' (pp. 1–2)' as head, 'Core idea: ' || substr(text, 1, 80) as core, l, text from l),
g as (select source, doc_id,
  array_to_string(list_concat([head, core, 'Summary: ' || substr(text, 1, 300)], list_transform(l[1:6], lambda x: '- ' || x), ['Framework — F: ' || substr(text, 10, 50) || case when len(l[2:3]) > 0 then ' Steps: ' || array_to_string(l[2:3], '; ') else '' end],
    list_transform(l[1:4], lambda x: 'Data: ' || substr(x, 1, 30) || ' (c)'), ['Story — S: ' || substr(text, 5, 60) || ' Lesson: lesson'], list_transform(l[1:5], lambda x: 'Takeaway: ' || x)), chr(10)) as "full",
  array_to_string(list_concat([head, core], list_transform(l[1:4], lambda x: '- ' || x), ['Framework — F: ' || substr(text, 10, 50), 'Story — S: Lesson: lesson'], list_transform(l[1:3], lambda x: 'Takeaway: ' || x)), chr(10)) as compact from n)"""


@query(_DIGESTS + ' select doc_id, "full", compact from g')
def note_digest(spark, d):
    return stub_notes(spark, d).select(F.col("_index").alias("doc_id"), synthesis.note_digest(True).alias("full"), synthesis.note_digest(False).alias("compact"))


@query(_DIGESTS + """, z as (select source, sum(length("full")) + 2 * (count(*) - 1) as f, sum(length(compact)) + 2 * (count(*) - 1) as c from g group by source)
select source as book_id, case when f * 5 // 18 + 1 <= 6000 then 'full' when c * 5 // 18 + 1 <= 6000 then 'compact' else 'condense' end as level, cast(case when f * 5 // 18 + 1 <= 6000 then f when c * 5 // 18 + 1 <= 6000 then c end as int) as n from z""")
def fitting_digest(spark, d):
    return synthesis.fitting_digest(stub_notes(spark, d), "book_id", 6000).select("book_id", "level", F.length("text").alias("n"))


@query()
def condensed_digest(spark, d):
    x = stub_notes(spark, d).select("book_id", F.col("_index").alias("seq"), F.concat(F.lit("Ch "), F.col("_index").cast("string")).alias("label"), synthesis.note_digest(True).alias("text"))
    return synthesis.condense(x, "book_id", 1500, lambda g: g.select("book_id", "grp", F.concat(F.lit("["), "label", F.lit("]\n"), F.substring("text", 1, 900)).alias("text"))).select("book_id", F.length("text").alias("n"))


_DRAFT = {"tldr": ["a", "b", "c"], "core_thesis": "old", "critique": {"weaknesses": ["w1"]}, "frameworks": [{"name": "F", "what": "x", "how_to_apply": "y", "chapters": ["Ch 1"]}]}
_GIVEN = [
    ("tldr", "replace", 1, "B is the corrected bullet text"), ("tldr", "replace", 2, "x"), ("tldr", "remove", 0, ""), ("core_thesis", "replace", 0, "new"), ("critique.weaknesses", "add", 0, "w2: evidence is anecdotal only"),
    ("frameworks", "add", 0, json.dumps({"name": "G", "what": "A framework described in enough words to pass", "how_to_apply": "Apply it weekly to every decision", "chapters": ["Ch 2"]})), ("frameworks", "add", 0, "{not json"), ("tldr", "remove", 9, ""),
]


_FINAL = (
    '{"tldr": ["B is the corrected bullet text", "c"], "core_thesis": "new", "critique": {"weaknesses": ["w1", "w2: evidence is anecdotal only"]}, "frameworks": [{"name": "F", "what": "x", "how_to_apply": "y", "chapters": ["Ch 1"]}, '
    '{"name": "G", "what": "A framework described in enough words to pass", "how_to_apply": "Apply it weekly to every decision", "chapters": ["Ch 2"]}]}'
)


@query(f"select item_id, {_values([(_FINAL,)])[1:-1]} as final, 'tldr replace, core_thesis replace, tldr remove, critique.weaknesses add, frameworks add' as applied from benchmark")
def apply_fixes(spark, d):
    """The same draft and audit for each row of a table; what is applied as field and action, in order."""
    fixes = [dict(zip(("field", "action", "index", "value"), f, strict=True), problem="p") for f in _GIVEN]
    x = t(spark, d, "benchmark").select("item_id", F.lit(json.dumps(_DRAFT)).alias("draft"), F.lit(json.dumps(fixes)).alias("fixes"))
    done = F.from_json("r.applied", "array<struct<field:string,action:string>>")
    applied = F.array_join(F.transform(done, lambda f: F.concat(f["field"], F.lit(" "), f["action"])), ", ")
    return x.select("item_id", synthesis.apply_fixes_json("draft", "fixes").alias("r")).select("item_id", "r.final", applied.alias("applied"))


@query()
def model_requests(spark, d):
    schema = json.dumps(synthesis.note_schema(600))
    x = t(spark, d, "documents").select("doc_id", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).alias("messages"), F.lit(schema).alias("schema"), F.lit(None).cast("int").alias("max_tokens"))
    return model.ask(x, model.StubClient, keys=["doc_id"]).drop("seconds")


# ---------------------------------------------------------------- manifest and streaming


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def skip_done(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sha256"))
    index = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sha256"), F.lit(None).cast("string").alias("title"), F.array(F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".html"))).alias("files"))
    outputs = t(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("name"))
    saved = index.select("sha256", F.lit(True).alias("has_synthesis"), F.lit(True).alias("has_images"))
    return stages.to_do(docs, stages.finished(index, outputs, saved)).select("doc_id")


@query("select distinct cast(d.doc_id as varchar) || '.html' as name from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and d.doc_id % 2 = 0")
def stale_outputs(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".html"))
    docs = t(spark, d, "documents")
    return stages.stale(docs.select(F.concat(F.lit("/old/"), name).alias("file")), t(spark, d, "labels").select(name.alias("file")), docs.where("doc_id % 2 = 0").select(name.alias("name")))


@query("""select cast(doc_id as varchar) as sha256, source from documents where doc_id not in (select doc_id from labels) union all select cast(doc_id as varchar), 'new' from labels""")
def manifest_upsert(spark, d):
    old = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"), "source")
    return stages.upsert(old, t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sha256"), F.lit("new").alias("source")))


@query("""with p as (select user_id, event_id, cast(floor(value) as bigint) as size, lag(cast(floor(value) as bigint)) over (partition by user_id order by event_id) as last from events) select user_id, min(event_id) as "at" from p where size = last group by user_id""")
def watch_stable(spark, d):
    return watch.first_stable(t(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("size")), "user_id", "event_id", "size")


# ---------------------------------------------------------------- the whole


def book_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Books as (book_id, book), JSON with a stub synthesis and a report on quotes but without chapters, and their
    chapters (book_id, idx, part, title, notes): chunks with extracted notes and verified quotes, a row each."""
    b, h, pieces = book_pieces(spark, d)
    chunks = cut(sections.build_chunks(b, h, pieces).select("book_id", "idx", "title", "start", "end"))
    bodies = sections.with_bodies(chunks, pieces, "book_id").withColumnRenamed("body", "text")
    lines = F.split("text", "\n")
    drawn = cut(bodies.select(
        "book_id", "idx", "title", F.substring("text", 1, 120).alias("core_idea"), F.substring("text", 300, 90).alias("later"), F.substring("text", 1, 600).alias("summary"),
        F.slice(lines, 2, 3).alias("key_arguments"), F.slice(lines, 5, 2).alias("takeaways"), F.size(F.split("text", " ")).alias("size"),
    ))
    quoted = drawn.select("book_id", "idx", F.explode(F.array("core_idea", "later")).alias("text"))
    quoted = quoted.withColumn("seq", F.row_number().over(Window.partitionBy("book_id", "idx").orderBy("text")))
    page = h.select("book_id", "seq", "offset", F.col("seq").cast("string").alias("label"))
    verdicts = cut(quotes.verify_quotes(quoted, bodies, page))
    kept = verdicts.where("verdict in ('exact', 'fuzzy')").groupBy("book_id", "idx").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("found").alias("text"), "page"))).alias("quotes"))
    parts = budget.assign_parts(drawn, "book_id", "idx", "size", 3, 2500)
    notes = F.struct("core_idea", "summary", "key_arguments", "takeaways", F.coalesce("quotes", F.array().cast("array<struct<seq:int,text:string,page:string>>")).alias("quotes"))
    chapters = drawn.join(kept, ["book_id", "idx"], "left").join(parts, ["book_id", "idx"]).select("book_id", "idx", "part", "title", F.to_json(notes).alias("notes"))
    stub = model.StubClient().fill(synthesis.SUMMARY, "summary")
    report = quotes.quote_report(verdicts).select("book_id", F.struct("total", "kept", "exact", "fuzzy").alias("report"))
    return report.select("book_id", F.to_json(F.struct(F.col("book_id").alias("title"), F.lit("").alias("author"), F.from_json(F.lit(json.dumps(stub)), model.ddl(synthesis.SUMMARY)).alias("summary"), "report")).alias("book")), chapters


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Books as one JSON each, with their chapters, for books that a row can hold."""
    return pages.whole_books(*book_frames(spark, d))


@query()
def book_summary(spark, d):
    frames, chapters = book_frames(spark, d)
    return pages.part_sizes(frames, pages.render_chapters(chapters))


@query("select source as book_id, true as made, cast(null as varchar) as error from documents group by source")
def book_epub(spark, d):
    return epub.epub_chapters(*book_frames(spark, d)).select("book_id", (F.length("content") > 1000).alias("made"), "error")


@query(f"""with f as ({SQL['index_like_docs']}), p as (select source, count(*) as docs, cast(sum(length(text) * 5 // 18 + 1) as bigint) as tokens from documents join f using (doc_id) where not flag group by source)
select source, docs, tokens, cast(tokens * 3 // 4 as bigint) as words from p""")
def kept_tokens(spark, d):
    """Token totals of the documents that are not index-like."""
    x = t(spark, d, "documents").where(~fx.is_index_or_notes(F.col("text")))
    g = x.groupBy("source").agg(F.count("*").alias("docs"), F.sum(fx.est_tokens(F.col("text"))).alias("tokens"))
    return g.withColumn("words", budget.words_of_tokens(F.col("tokens")))
