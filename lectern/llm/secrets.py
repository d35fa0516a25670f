"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every matching text
satisfies (trigram_query): literals give the conjunction of their trigrams, alternatives a
disjunction, anything else nothing. The queries are brought to clauses, sets of trigrams that all must
occur. The index holds, for each trigram that some clause names, the postings (trigram, id) of the texts
whose folded form has it. Postings are intersected by counting, for a document and a clause, the clause's
trigrams that it has; where the count is the clause's size the document is a candidate of the rule, and
only candidates are searched with the rule's expression. A rule without mandatory trigrams is searched
everywhere.

All steps are DataFrame expressions. Spans are code points, end exclusive: the text's pieces between
matches and the matches themselves, both in order, sum up to offsets.

Defined results: a null text is the empty text and has no spans; a null id is an id like any other;
repeated ids share their candidates (a superset, which the search then decides row by row); extra columns
stay unless named as the result's.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. value: the group that must have at least least characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules of the contract. Runs of hex digits or of an access key are maximal, so asking for their
#: least length in the expression drops just those that fail.
BASE = [Rule("assign", ASSIGN, 2, 8), Rule("access", "AKIA[A-Z0-9]{12,}"), Rule("hex", "[0-9a-f]{32,}")]
#: What the method finds besides.
MORE = [
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
]

Clauses = list[frozenset[str]]
_MOST = 64  # strings or clauses that are followed; beyond that, a part asks for nothing


def _trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Clauses, b: Clauses) -> Clauses:
    """The conjunction of two disjunctions of clauses; [empty set] asks for nothing."""
    out = list({x | y for x in a for y in b})
    return out if len(out) <= _MOST else min(a, b, key=len)


class _Part:
    """What a piece of an expression can be: exactly one of a few strings, or whatever satisfies the clauses."""

    def __init__(self, exact: set[str] | None, clauses: Clauses):
        self.exact, self.clauses = exact, clauses

    def query(self) -> Clauses:
        if self.exact is None:
            return self.clauses
        found = {_trigrams(s) for s in self.exact}
        return [frozenset()] if frozenset() in found else list(found)


_ANY = [frozenset()]


def _sequence(items) -> _Part:
    exact: set[str] = {""}
    clauses, whole = _ANY, True
    for op, arg in items:
        part = _item(op, arg)
        joined = {a + b for a, b in product(exact, part.exact)} if part.exact is not None else None
        if joined is not None and len(joined) <= _MOST:
            exact = joined
            continue
        clauses = _both(clauses, _Part(exact, []).query())
        exact, whole = {""}, False
        clauses = _both(clauses, part.query())
    if whole:
        return _Part(exact, [])
    return _Part(None, _both(clauses, _Part(exact, []).query()))


def _item(op, arg) -> _Part:
    name = str(op)
    if name == "LITERAL":
        return _Part({chr(arg).lower()}, [])
    if name == "AT":
        return _Part({""}, [])
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST:
            return _Part(set().union(*(p.exact for p in parts)), [])
        return _Part(None, list({c for p in parts for c in p.query()}))
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        part = _sequence(inner)
        if part.exact is not None and (low, high) == (0, 1):
            return _Part(part.exact | {""}, [])
        if part.exact is not None and low == high and len(part.exact) ** low <= _MOST and low <= 8:
            return _sequence(list(inner) * low)
        return _Part(None, part.query() if low else _ANY)
    if name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
        return _Part({chr(c).lower() for _, c in arg}, [])
    return _Part(None, _ANY)


def trigram_query(pattern: str) -> Clauses:
    """Clauses of trigrams of the lower-cased text, one of which a matching text satisfies. A clause without
    trigrams makes the query void: the rule must be searched everywhere."""
    clauses = _sequence(sre.parse(pattern)).query()
    return [c for c in clauses if not any(d < c for d in clauses)]


def candidates(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame | None:
    """(id, kinds): the kinds of indexed rules that the texts of an id may match; None if no rule has an index."""
    clauses = [(r.kind, k, c) for r in rules if all(q := trigram_query(r.pattern)) for k, c in enumerate(q)]
    if not clauses:
        return None
    spark = docs.sparkSession
    terms = spark.createDataFrame([(t, f"{kind} {k}", kind, len(c)) for kind, k, c in clauses for t in sorted(c)], "trigram string, clause string, kind string, size long")
    needed = sorted({t for *_, c in clauses for t in c})
    folded = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("folded"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in needed]))
    postings = folded.select("id", F.explode(found).alias("trigram"))
    counts = postings.distinct().join(F.broadcast(terms), "trigram").groupBy("id", "clause", "kind", "size").agg(F.count("*").alias("n"))  # terms: the rules' trigrams only
    return counts.where("n = size").groupBy("id").agg(F.collect_set("kind").alias("kinds"))  # as many kinds as rules at most


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start, rank, end>> of the rule's matches in text, those with a short value left out."""
    p = F.lit(rule.pattern)
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    values = matches if rule.value == 0 else F.regexp_extract_all(text, p, F.lit(rule.value))
    steps = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"), values.alias("value"))
    kind = "array<struct<start:int,rank:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))).cast(kind)
        return F.struct(end.alias("at"), F.when(F.length(x["2"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    steps = F.transform(steps, lambda x: F.struct(x["piece"].alias("0"), x["match"].alias("1"), x["value"].alias("2")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with secrets: array<struct<start, rank, end>>, by start and then the rule's rank."""
    rules = BASE + MORE if rules is None else rules
    possible = candidates(docs, rules, id_col, text_col)
    kinds, of = free("kinds", docs.columns), free("of", docs.columns)
    keep = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(*keep)
    if possible is None:
        rows = rows.withColumn(kinds, F.array().cast("array<string>"))
    else:
        possible = possible.select(F.col("id").alias(of), F.col("kinds").alias(kinds))
        rows = rows.join(possible, F.col(id_col).eqNullSafe(F.col(of)), "left")
    kind, none = "array<struct<start:int,rank:int,end:int>>", F.array()
    found = []
    for rank, rule in enumerate(rules):
        may = F.array_contains(kinds, rule.kind) if all(trigram_query(rule.pattern)) else F.lit(True)
        may = F.coalesce(may & F.col(text_col).rlike(rule.pattern), F.lit(False))
        found.append(F.when(may, _spans(rule, rank, F.col(text_col))).otherwise(none.cast(kind)))
    return rows.select(*keep, F.array_sort(F.concat(*found)).alias("secrets"))


def joined(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """docs with every secret span replaced by mask (overlapping spans as one)."""
    text_col = options.get("text_col", "text")
    found = scan(docs, **options)
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("secrets", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, done).otherwise(text)).select(*docs.columns)


def _count(rank: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE + MORE
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    counts = [_count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base, rules), 256).alias("base_sha256"), joined(F.col("secrets"), rules).alias("spans"))


def _rule_sql(rank: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
select r, {rank} as rank, '{rule.kind}' as kind,
  cast(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) as bigint) as s,
  length(found[k]) as n
from (select r, pieces, found, vals, unnest(range(1, len(found) + 1)) as k from (
  select r, string_split_regex(t, '{p}') as pieces, regexp_extract_all(t, '{p}', 0) as found, regexp_extract_all(t, '{p}', {rule.value}) as vals
  from d where regexp_matches(t, '{p}')))
where length(vals[k]) >= {rule.least}"""


OP4_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as ({' union all '.join(_rule_sql(k, r) for k, r in enumerate(BASE + MORE))}),
j as (
  select r, count(*) filter (rank = 0) as a, count(*) filter (rank = 1) as b, count(*) filter (rank = 2) as c,
    string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, rank) filter (rank < {len(BASE)}) as base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, rank) as everything
  from s group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(everything, '') as spans
from d left join j using (r)
"""
