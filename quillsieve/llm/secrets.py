"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regex is parsed into a Boolean trigram query: alternatives, each a set of trigrams that any match must
hold. The index has postings (trigram, document) for the trigrams of these queries. Intersecting postings by
alternative gives candidate documents; only those run the rule's regex. Rules without mandatory trigrams scan every
document. The index is case-folded, so it may name too many documents, never too few.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def any_case(word: str) -> str:
    """A pattern for the ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key") + ")"
#: The base kinds in their order, then the kinds that this scan adds.
BASE = (
    Rule("assign", ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),  # a run of 16 and more: the same spans as all runs less the short ones
)
#: What follows a key's header: all up to its END line, with no other header between; without one, the base64 lines
#: that follow, indented or not. Loops are over single classes, as Java recurses in others.
KEY_REST = (
    "(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:[\x20\t\r\n]*(?:Proc-Type|DEK-Info): [^\r\n]*){0,2}(?:[A-Za-z0-9+/=\\\x20\t\r\n]*[A-Za-z0-9+/=]{40,}[A-Za-z0-9+/=\\\r\n]*[\x20\t\r\n]*[A-Za-z0-9+/=]*|[\x20\t\r\n\\]*[A-Za-z0-9+/=\\]{16,}[A-Za-z0-9+/=\\\r\n]*)|)"
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + KEY_REST),
    Rule("code_host", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"://[A-Za-z0-9._-]*:[A-Za-z0-9._%+-]+@"),
)
RULES = BASE + MORE


def trigram_query(pattern: str, most: int = 256) -> list[frozenset]:
    """Alternatives of lower-case trigrams, one of which every match holds in full; [empty set]: no such query.

    A regex is unrolled into runs of literals. Small classes and options branch; wide classes and repetitions end a run.
    """

    def grow(states, item):
        # a state: finished runs, open run
        op, arg = item
        name = str(op)
        if name == "LITERAL":
            return {(done, run + chr(arg).lower()) for done, run in states}
        if name == "IN":
            chars = _members(arg)
            if chars and len(chars) * len(states) <= most:
                return {(done, run + c) for done, run in states for c in chars}
        if name == "SUBPATTERN":
            return walk(states, arg[3])
        if name == "BRANCH":
            out = set().union(*(walk(states, way) for way in arg[1]))
            if len(out) <= most:
                return out
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, top, body = arg
            if (least, top) == (0, 1) and len(out := states | walk(states, body)) <= most:
                return out
            for _ in range(min(least, 3)):
                states = walk(states, body)
        return {(done | {run}, "") for done, run in states}

    def walk(states, items):
        for item in items:
            states = grow(states, item)
        return states

    ways = {frozenset(run[k : k + 3] for run in done | {last} for k in range(len(run) - 2)) for done, last in walk({(frozenset(), "")}, re._parser.parse(pattern))}
    if frozenset() in ways:
        return [frozenset()]
    return sorted((w for w in ways if not any(v < w for v in ways)), key=sorted)


def _members(items) -> set:
    """Lower-case members of a class, or none if it is negated or wide."""
    out = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return set()
    return out if len(out) <= 8 else set()


@functools.cache
def _plan(rules: tuple) -> tuple[list[str], list[tuple[str, int, int, int]], list[str]]:
    """Trigrams of the index; rows (trigram, rule, alternative, trigrams in it); kinds that scan every document."""
    need, full = [], []
    for k, rule in enumerate(rules):
        ways = trigram_query(rule.pattern)
        if ways == [frozenset()]:
            full.append(rule.kind)
        else:
            need += [(t, k, n, len(way)) for n, way in enumerate(ways) for t in sorted(way)]
    return sorted({t for t, *_ in need}), need, full


def postings(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The inverted index over the trigrams of the rules' queries: ``trigram string, doc_id long``."""
    wanted, _, _ = _plan(rules)
    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(common.whole_text()).alias("t"))
    present = F.array_compact(F.array(*[F.when(F.col("t").contains(t), F.lit(t)) for t in wanted]))
    return folded.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``doc_id long, kinds array<string>``: rules of which an alternative has the document in all its postings."""
    spark = docs.sparkSession
    _, need, _ = _plan(rules)
    kinds = [r.kind for r in rules]
    queries = F.broadcast(spark.createDataFrame(need, "trigram string, rule int, way int, n int"))  # as large as the rules
    met = postings(docs, rules).where(F.col("doc_id").isNotNull()).join(queries, "trigram").groupBy("doc_id", "rule", "way", "n").agg(F.count_distinct("trigram").alias("m"))
    named = F.element_at(F.array(*map(F.lit, kinds)), F.col("rule") + 1)
    return met.where("m = n").groupBy("doc_id").agg(F.collect_set(named).alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule in a text, in code points: array of (start, rank, kind, end)."""
    pieces, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else found
    lengths = F.zip_with(F.slice(F.transform(pieces, F.length), 1, F.size(found)), F.transform(found, F.length), lambda gap, own: F.struct(gap.cast("long").alias("gap"), own.cast("long").alias("own")))
    with_size = F.zip_with(lengths, sized, lambda x, s: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), (F.length(s) >= rule.least).alias("ok")))
    kind = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["own"]).alias("stop")))
        return F.struct((begin + x["own"]).alias("at"), F.concat(acc["out"], F.when(x["ok"], one).otherwise(F.array().cast(kind))).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(with_size, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: tuple = RULES, keep: list[str] | None = None, name: str = "found") -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text`` and the columns of ``keep``) with ``name``: its spans by start, then kind.

    Null texts count as empty and have no spans. Rows with a null id can have no postings, so every rule verifies
    them, without a shuffle. Repeated rows each get their own spans. Candidates meet texts by a shuffle on the id;
    nothing is broadcast but the rules. ``name`` must not be a column that is kept.
    """
    _, _, full = _plan(rules)
    columns = ["doc_id", "text", *(c for c in keep or [] if c not in ("doc_id", "text"))]
    free = common.free_names([*columns, name], "id", "kinds", "text")
    names = candidates(docs, rules).select(F.col("doc_id").alias(free["id"]), F.col("kinds").alias(free["kinds"]))
    base = docs.select(*columns)
    named = base.where(F.col("doc_id").isNotNull()).join(names.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(free["id"]), "left")
    text, none = F.col(free["text"]), F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")

    def verified(rows: DataFrame, asked) -> DataFrame:
        found = [F.when(F.lit(True) if r.kind in full else asked(r.kind), spans_of(text, r, k)).otherwise(none) for k, r in enumerate(rules)]
        return rows.withColumn(free["text"], common.whole_text()).withColumn(name, F.array_sort(F.concat(*found))).select(*columns, name)

    nameless = base.where(F.col("doc_id").isNull())
    return verified(named, lambda kind: F.array_contains(free["kinds"], kind)).union(verified(nameless, lambda kind: F.lit(True)))


def written_spans(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` (see the README's contract)."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["rank"] < len(BASE))
    counts = [_count_of(found, r.kind).alias(f"n_{r.kind}") for r in BASE]
    return scan(docs).select("doc_id", *counts, F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(found).alias("spans"))


def redact(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[kind]``; overlapping spans give the first one's mark."""
    name = common.free_names(docs.columns, "found")["found"]
    marked = scan(docs, rules, docs.columns, name)
    text = common.whole_text()
    empty = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] + 1 >= acc["at"], F.concat(F.substring(text, acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"] + 1).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate(name, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int"), F.lit(2**31 - 1))))
    return marked.withColumn("text", F.when(F.size(name) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)


def _duck_rule(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT r, kind, rank, unnest(range(1, len(own) + 1)) AS i, gap, own, size FROM (
    SELECT r, '{rule.kind}' AS kind, {order} AS rank,
      list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gap,
      list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS own,
      list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x) >= {rule.least}) AS size
    FROM texts WHERE regexp_matches(t, '{p}'))"""


def oracle() -> str:
    """DuckDB SQL of :func:`digests`: every rule scans every text, without an index."""
    rows = "\n  UNION ALL".join(_duck_rule(r, k) for k, r in enumerate(RULES))
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
every AS ({rows}),
spans AS (
  SELECT r, kind, rank, list_sum(gap[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS start,
    list_sum(gap[1:i]) + list_sum(own[1:i]) AS stop FROM every WHERE size[i]),
said AS (SELECT r, kind, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM spans),
summed AS (SELECT r, {counts}, string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans FROM said GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN summed USING (r)"""
