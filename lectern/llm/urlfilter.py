"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Entries are listed canonical URLs, `host + path`, of which a prefix listing is made: an entry fits a
page if its host is the page's or a parent domain of it, and its path is a prefix of the page's. So a
page is looked up by the keys (domain suffix, path prefix) whose prefix length some entry has.

The filter is a table of 64-bit blocks, one block for each `per_block` entries: a key's hash names one
block, and `probes` bits in that block. It is built by an aggregation (bit_or by block) and read by a
join on the block; a key whose bits are all set is a possible hit, and an exact join on the key text
removes the false positives. Every step is a DataFrame expression.

Filter and list are broadcast only while they hold at most `broadcast_entries` entries. A larger list is
joined by shuffle, for which a page's keys are first reduced to the distinct keys of all pages, so a host
that has a third of the pages is one key there.

Of the rule entries that fit, the longest (host and path together, of equal ones the longer host) gives
the verdict. Where none fits, the method's own verdict counts: block if a listed URL fits, else allow.
Defined results: null or urls without `://` have empty host and path and fit nothing; null ids and
repeated rows stay rows of their own; entries with a null host or path are ignored; of entries alike in
host and path, block wins; without entries all is allowed. Extra columns stay unless named as the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract, and what the method lists besides (whole hosts of spam).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LISTED = ["spam-farm.example.org/", "casino-win.example.org/", "adult-x.example.org/", "cheap-pills.example.org/", "spam-farm.example.net/", "casino-win.example.net/", "adult-x.example.net/", "cheap-pills.example.net/"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/?[^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, probes: int) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")) for k in range(probes)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def bloom(keys: DataFrame, blocks: int, probes: int) -> DataFrame:
    """(block, word) of the keys (column key)."""
    return keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key"), probes).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def judge(pages: DataFrame, entries: DataFrame, *, url_col: str = "url", per_block: int = 6, probes: int = 4, broadcast_entries: int = 100_000) -> DataFrame:
    """pages with host, path, rule and verdict.

    entries: host, path, verdict ('allow' or 'block') and is_rule; the others are listed URLs.
    """
    entries = (
        entries.where("host is not null and path is not null and verdict is not null").groupBy("host", "path")
        .agg(F.max(F.when(F.col("is_rule"), F.col("verdict"))).alias("rule_verdict"), F.max(~F.col("is_rule")).alias("listed"))
        .select(F.concat_ws("\n", "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "rule_verdict", "listed", F.length("path").alias("path_length"))
    )  # 'block' is the greater of the two verdicts
    n, lengths = entries.agg(F.count("*"), F.array_sort(F.collect_set("path_length"))).first()
    ours = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in ours]
    named = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not n:
        return named.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    small = n <= broadcast_entries
    hint = F.broadcast if small else (lambda df: df)
    blocks = max(1, n // per_block)
    words = hint(bloom(entries, blocks, probes))
    found = hint(entries.drop("path_length"))

    def hits(keys: DataFrame) -> DataFrame:
        """keys(key, ...) that are entries, with the entry's columns: first the filter, then the exact join."""
        probed = keys.withColumns({"block": _block(F.col("key"), blocks), "mask": _mask(F.col("key"), probes)}).join(words, "block")
        possible = probed.where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
        return possible.drop("block", "mask", "word").join(found, "key")

    prefixes = F.transform(F.filter(F.lit(lengths), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    keys = F.when(F.col("host") != "", keys)
    best_rule = F.when(F.count("rule_verdict") > 0, F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("rule").alias("l"), F.col("host_length").alias("h"), F.col("rule"), F.col("rule_verdict").alias("v")))))
    # a page's verdict depends on host and path alone, so each pair is judged once
    places = named.select("host", "path").distinct().withColumn("keys", keys)
    looked = places.select("host", "path", F.explode("keys").alias("key"))
    if small:
        got = hits(looked)
    else:
        got = looked.join(hits(looked.select("key").distinct()), "key")
    judged = got.groupBy("host", "path").agg(best_rule.alias("best"), F.max("listed").alias("listed"))
    judged = judged.select("host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.v"), F.when(F.col("listed"), F.lit("block"))).alias("verdict"))
    return named.join(judged, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def entry_table(spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[str]) -> DataFrame:
    """Rules and listed canonical URLs as entries; a listed URL blocks what it is a prefix of."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(u.partition("/")[0], "/" + u.partition("/")[2], "block", False) for u in listed]
    return spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, entry_table(spark, RULES, LISTED)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_LISTED = ", ".join("('{}', '/{}')".format(*u.split("/", 1)) for u in LISTED)
OP3_SQL = rf"""
with p as (
  select row_number() over () as r, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/?[^?#]*)', 1, 's') as path
  from pages),
rules(h, q, v) as (values {_VALUES}),
listed(h, q) as (values {_LISTED}),
best as (
  select r, arg_max(h || q, length(h || q)) as rule, arg_max(v, length(h || q)) as v
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by r),
spam as (select distinct r from p join listed on (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
select page_id, host, path, rule, coalesce(v, case when spam.r is null then 'allow' else 'block' end) as verdict
from p left join best using (r) left join spam using (r)
"""
