"""WARC archives: writing with payload revisits, and reading by boundary-chain verification.

Writing. A row becomes one record; of rows with equal payloads of at least `least` bytes, that with the
smallest id is a response and the others are revisits that refer to it. Archives are written by Spark's
text writer, one record a line with the record's two closing line breaks as the line separator, so any
file system that Spark reaches will do and a lost task is written again. A file holds at most
`per_file` records.

Reading. Spark's text reader cuts the files at every occurrence of the record magic, wherever it stands:
each piece is a candidate record. From its header alone a task derives where the record would end, so
every candidate emits a pair (offset, successor offset). The chain that starts at a file's first byte
runs through exactly the true records; pointer jumping follows it: in round k each reached offset is
sent 2^k records ahead and every pointer is joined with itself, so a file of n records takes
about log2(n) rounds of equi-joins on small rows. Candidates that are not reached are magic
inside payloads. A payload that holds the magic spans several pieces and is put together again
from the pieces between its record and the record's successor.

Defined results: a null payload is the empty one; a null id is written without an id field and read as
null; rows with equal payloads and the same smallest id (repeated rows) are all responses, and rows
without an id are the response only if no row with that payload has an id; ids, urls and payloads may
contain anything but that line breaks in a url are written as spaces; an archive that ends inside a record
yields the records before it; an empty table gives no records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import cut, free, shared_dir, table

MAGIC = "WARC/1.1\r\n"
LEAST, PER_FILE = 100, 2000
_NO_DATE = "1970-01-01T00:00:00Z"  # nothing in a row dates it


def payload_roles(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to (null for responses).

    Digests are grouped first, which combines before the shuffle, so a payload that many pages share
    reaches the join as one row.
    """
    digest, one = free("digest", pages.columns), free("first", pages.columns)
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.withColumns({"payload_digest": F.sha2(body, 256), "payload_bytes": F.octet_length(body).cast("long")})
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"))
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias(digest), F.col("first.i").alias(one))
    joined = rows.join(shared, F.col("payload_digest") == F.col(digest), "left")
    return joined.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col(one)), F.col(one))).drop(digest, one)


def record_text(rows: DataFrame, *, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(value): the rows of payload_roles as WARC records without the two closing line breaks."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload_col), F.lit("")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def urn(value: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))

    head = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", urn(F.col(id_col))),
        field("WARC-Date", F.lit(_NO_DATE)),
        field("WARC-Target-URI", F.regexp_replace(F.col(url_col), "[\r\n\\x{85}\\x{2028}\\x{2029}]+", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Refers-To", urn(F.col("refers_to"))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, per_file: int = PER_FILE, compression: str = "gzip") -> None:
    """Write pages as WARC archives into the new folder path."""
    rows = payload_roles(pages, id_col=id_col, payload_col=payload_col, least=least)
    records = record_text(rows, id_col=id_col, url_col=url_col, payload_col=payload_col)
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, place): what stands between the magics, in order by block and place in a file."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def _header(value: Column) -> Column:
    """The header of a candidate up to its blank line, empty if it has none."""
    end = F.instr(value, "\r\n\r\n")
    return F.when(end > 0, F.substring(value, F.lit(1), end + 1)).otherwise("")


def _field(header: Column, name: str) -> Column:
    got = F.regexp_extract(header, rf"(?imd)^{name}: *([^\r\n]*)", 1)
    return F.when(got != "", got)


def candidates(raw: DataFrame) -> DataFrame:
    """Of pieces, the small columns: file, offset and, where a header follows the magic, its fields and the
    successor's offset; digest and bytes of a payload that lies in the piece itself."""
    head = raw.withColumn("header", _header(F.col("value")))
    size = F.expr("try_cast(content as bigint)")
    head = head.withColumn("content", _field(F.col("header"), "Content-Length")).withColumn("content", size)
    body = F.octet_length("header") + 2  # bytes of the piece before the payload
    binary = F.col("value").cast("binary")
    own = F.octet_length("value") >= body + F.col("content")
    payload = F.substring(binary, (body + 1).cast("int"), F.col("content").cast("int"))
    small = head.select(
        "file", "block", "place",
        F.octet_length("value").cast("long").alias("length"),
        body.cast("long").alias("body"), "content",
        F.when(own, F.sha2(payload, 256)).alias("digest"),
        _field(F.col("header"), "WARC-Type").alias("record_type"),
        F.regexp_extract(_field(F.col("header"), "WARC-Record-ID"), "^<urn:page:(.*)>$", 1).alias("record_id"),
        F.regexp_extract(_field(F.col("header"), "WARC-Refers-To"), "^<urn:page:(.*)>$", 1).alias("refers_to"),
        F.regexp_extract(_field(F.col("header"), "WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("declared"),
        _field(F.col("header"), "WARC-Target-URI").alias("url"),
    )
    # the first piece of a file is what stands before its first magic: nothing, in an archive
    ran = F.sum(F.col("length") + len(MAGIC)).over(_in_file())
    return small.withColumn("offset", ran - F.col("length") - 2 * len(MAGIC)).where("content is not null and offset >= 0").withColumn("next", F.col("offset") + len(MAGIC) + F.col("body") + F.col("content") + 4)


def _in_file() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of links(file, offset, next) on the chain from offset 0, by pointer jumping."""
    jump = cut(links.select("file", "offset", "next"))
    seen = cut(jump.where("offset = 0").select("file", "offset"))
    while True:
        ahead = seen.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        now = cut(seen.union(ahead).distinct())
        # every reached chain is now twice as long; it has ended where the pointers of the last round found none
        if now.count() == seen.count():
            break
        seen = now
        far = jump.select("file", F.col("offset").alias("middle"), F.col("next").alias("far"))
        jump = cut(jump.withColumnRenamed("next", "middle").join(far, ["file", "middle"]).select("file", "offset", F.col("far").alias("next")))
    return seen.join(links.select("file", "offset"), ["file", "offset"], "left_semi")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives in path: file, offset, record_type, record_id, refers_to, url, declared
    (digest), digest and payload_bytes as read (of a revisit: of its own, empty payload), and with
    payloads the payload as binary."""
    raw = pieces(spark, path)
    found = cut(candidates(raw))
    true = found.join(reachable(found), ["file", "offset"], "left_semi")
    columns = [F.col(c) for c in ("file", "offset", "record_type", "record_id", "refers_to", "url", "declared")]
    simple = true.where("digest is not null")
    split = true.where("digest is null")
    done = simple.select(*columns, "digest", F.col("content").alias("payload_bytes"))
    if not payloads and not split.take(1):
        return done
    # records of which the payload holds the magic, or whose payload is asked for: fetch their pieces
    wanted = true if payloads else split
    ranges = wanted.select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("place").alias("p"), F.col("offset").alias("o"), "body", "content", "next")
    spans = _spanned(raw, ranges)
    out = wanted.join(spans, ["file", "offset"]).where(F.octet_length("payload") == F.col("content"))
    out = out.select(*columns, F.sha2("payload", 256).alias("digest"), F.col("content").alias("payload_bytes"), "payload")
    return out if payloads else done.unionByName(out.drop("payload"))


def _spanned(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, offset, payload) of records given by ranges(f, b, p, o, body, content, next)."""
    lengths = raw.select("file", "block", "place", F.octet_length("value").cast("long").alias("length"))
    offsets = lengths.withColumn("offset", F.sum(F.col("length") + len(MAGIC)).over(_in_file()) - F.col("length") - 2 * len(MAGIC)).drop("length")
    marks = offsets.join(ranges.select(F.col("f").alias("file"), F.col("o").alias("offset"), "body", "content", "next"), ["file", "offset"], "left")
    marks = marks.withColumn("r", F.last(F.when(F.col("next").isNotNull(), F.struct("offset", "body", "content", "next")), ignorenulls=True).over(_in_file())).where("r is not null and offset < r.next")
    parts = raw.join(marks.select("file", "block", "place", F.col("r.offset").alias("start"), F.col("r.body").alias("body"), F.col("r.content").alias("content"), F.col("offset").alias("at")), ["file", "block", "place"])
    # a record's pieces are as many as its payload has magics; the payload is whole in one row in any case
    whole = parts.groupBy("file", F.col("start").alias("offset"), "body", "content").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: x["value"]), MAGIC).cast("binary")
    return whole.select("file", "offset", F.substring(text, (F.col("body") + 1).cast("int"), F.col("content").cast("int")).alias("payload"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = cut(read(spark, path).select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "declared", "digest", "payload_bytes"))
    _remove(spark, path)
    # what a revisit refers to has its payload; responses that are referred to are few beside their revisits
    origin = records.where("record_type = 'response'").join(records.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    origin = origin.groupBy(F.col("page_id").alias("o"), F.col("digest").alias("od")).agg(F.first("payload_bytes").alias("ob"))
    full = records.join(origin, (F.col("refers_to") == F.col("o")) & (F.col("declared") == F.col("od")), "left")
    return full.select("page_id", F.coalesce("ob", "payload_bytes").alias("payload_bytes"), F.coalesce("od", "digest").alias("payload_digest"), "record_type", "refers_to")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


OP5_SQL = """
with p as (
  select row_number() over () as r, page_id, sha256(coalesce(html, '')) as d, cast(strlen(coalesce(html, '')) as bigint) as n from pages),
f as (select d, min(page_id) as first, count(*) as c from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when c > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when c > 1 and page_id <> first then first end as refers_to
from p left join f on p.d = f.d
"""
