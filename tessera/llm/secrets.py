"""Secret scans: a trigram inverted index chooses the texts in which each expression is tried.

From each rule's expression a Boolean trigram query is derived: alternatives, each a set of trigrams that any match must hold (in lower
case). The index has postings (trigram, doc_id) for the trigrams that occur in queries; intersecting the postings of an alternative gives the
candidates of a rule. Candidates are verified by the expression itself on the whole text. Rules without mandatory trigrams, such as
hexadecimal runs, scan every text. All of it is DataFrame and SQL functions.

Matches are found natively with their places: regexp_replace puts marks around leftmost non-overlapping matches, and the
lengths of the pieces between marks give code-point offsets, summed in blocks, so the work grows with the matches and not with their square. Marks (U+0001, U+0002) in the text itself are first replaced by another control character that no
rule matches, so places stay right.

Defined results: null and empty texts have no spans; a null doc_id is kept and its text tried with every rule, without the index; repeated rows each get a
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import texts

EXACT = 64


class Rule(NamedTuple):
    """head and tail: two halves of an expression (Java and Python alike); a match counts if its tail has `least` characters."""

    kind: str
    head: str
    tail: str
    least: int = 0
    any_case: bool = False


#: The first three are the contract's; their order is the order of kinds.
RULES = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]{24,}"),  # runs are maximal, so these are the runs of [0-9a-f]+ that are long enough
    Rule("forge_token", r"gh[opsur]_", r"[A-Za-z0-9]+", 36),
    Rule("chat_token", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*", r"PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 10),
    Rule("map_key", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("pay_key", r"[rs]k_live_", r"[A-Za-z0-9]+", 16),
    Rule("package_token", r"npm_", r"[A-Za-z0-9]+", 36),
    Rule("bearer", r"[Bb]earer\x20+", r"[A-Za-z0-9+/_.~=-]+", 20),
)
BASE = 3
#: pieces summed at once
BLOCK = 128
SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"


def _cased(rule: Rule) -> str:
    return rule.head.replace("password|passwd|secret|token|api_?key", "(?i:password|passwd|secret|token|api_?key)") if rule.kind == "assign" else rule.head


Alternatives = frozenset  # of frozensets of trigrams; an empty set inside: no constraint
ANY: Alternatives = frozenset([frozenset()])


def _all_of(a: Alternatives, b: Alternatives) -> Alternatives:
    if len(a) * len(b) > EXACT:
        return min(a, b, key=lambda q: (min(map(len, q)) == 0, len(q)))
    return frozenset(x | y for x in a for y in b)


def _strings(exact: set[str]) -> Alternatives:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact)


def _analyse(nodes) -> tuple[set[str] | None, Alternatives]:
    """(all strings the nodes match, if few; else None, and what a match must hold)."""
    exact: set[str] = {""}
    query = ANY
    whole = True
    for kind, value in nodes:
        own: set[str] | None = None
        must = ANY
        if kind is op.LITERAL:
            own = {chr(value).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
            own = {chr(v).lower() for _, v in value}
        elif kind is op.SUBPATTERN:
            own, must = _analyse(value[-1])
        elif kind is op.BRANCH:
            parts = [_analyse(p) for p in value[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= EXACT:
                own = set().union(*(e for e, _ in parts))
            else:
                must = frozenset().union(*(_strings(e) if e is not None else q for e, q in parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            e, q = _analyse(inner)
            if high == 1 and e is not None:
                own = e | {""}
            elif low >= 1:
                must = q if e is None else _strings(e)
        if own is not None and len(exact) * len(own) <= EXACT:
            exact = {a + b for a in exact for b in own}
        else:
            query = _all_of(_all_of(query, _strings(exact)), must if own is None else _strings(own))
            exact, whole = {""}, False
    return (exact, ANY) if whole else (None, _all_of(query, _strings(exact)))


def trigram_query(expression: str) -> Alternatives | None:
    """Alternatives of mandatory trigrams; None if some match needs none."""
    exact, query = _analyse(list(parser.parse(expression)))
    if exact is not None:
        query = _strings(exact)
    query = frozenset(q for q in query if not any(p < q for p in query))
    return None if frozenset() in query else query


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the trigrams asked for: the part of the inverted index that queries read."""
    low = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """(doc_id, kinds: rules whose trigram query the text meets), and the kinds that have no such query."""
    entries, full = [], []
    for rule in rules:
        query = trigram_query(rule.head + rule.tail)
        if query is None:
            full.append(rule.kind)
            continue
        for k, need in enumerate(sorted(map(sorted, query))):
            entries += [(t, rule.kind, k, 1 << bit, (1 << len(need)) - 1) for bit, t in enumerate(need)]
    wanted = docs.sparkSession.createDataFrame(entries, "trigram string, kind string, alternative int, bit long, need long")  # as many rows as rules have trigrams
    met = (
        postings(docs, sorted({e[0] for e in entries}))
        .join(F.broadcast(wanted), "trigram")
        .groupBy("doc_id", "kind", "alternative", "need")
        .agg(F.bit_or("bit").alias("bits"))
        .where("bits = need")
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )
    return met, full


def _let(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums(sizes: Column, first: Column) -> Column:
    """first, first + sizes[0], first + sizes[0] + sizes[1] ..., one more than sizes. Quadratic, so for few."""
    return F.aggregate(sizes, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def starts(sizes: Column) -> Column:
    """Where each of consecutive pieces begins, from their sizes: sums within blocks of BLOCK, then of the blocks."""
    zero = F.lit(0).cast("long")
    block = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)
    within = lambda blocks, before: F.flatten(F.transform(blocks, lambda b, i: F.slice(_sums(b, F.get(before, i)), F.lit(1), F.size(b))))
    return _let(sizes, lambda v: _let(block(v), lambda blocks: _let(_sums(F.transform(blocks, total), zero), lambda before: within(blocks, before))))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's matches, by start."""
    marked = F.regexp_replace(text, f"({_cased(rule)})({rule.tail})", "\x01$1\x02$2\x01")
    size = lambda p, i: (F.length(p) - F.when(i % 2 == 1, 1).otherwise(0)).cast("long")

    def spans(pieces: Column) -> Column:
        def of(at: Column, sizes: Column) -> Column:
            own = F.filter(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.length(F.substring_index(F.get(pieces, i), "\x02", -1)) >= rule.least)
            return F.transform(own, lambda i: F.struct(F.get(at, i).alias("start"), F.lit(order).alias("rank"), (F.get(at, i) + F.get(sizes, i)).alias("end"), F.lit(rule.kind).alias("kind")))

        return F.when(F.size(pieces) > 2, _let(F.transform(pieces, size), lambda sizes: _let(starts(sizes), lambda at: of(at, sizes)))).otherwise(F.array().cast(SPANS))

    return _let(F.split(marked, "\x01"), spans)


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each document: doc_id and spans, array<struct<start, rank, end, kind>> in code points, end exclusive, by start and rank
    (the place of the kind in `rules`)."""
    docs = texts(documents)
    met, full = candidates(docs, rules)
    met = met.select(F.col("doc_id").alias("met_id"), "kinds")
    docs = docs.select("doc_id", F.translate("text", "\x01\x02", "\x03\x03").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    known = known.join(met.hint("shuffle_hash"), known["doc_id"] == F.col("met_id"), "left").select("doc_id", "text", "kinds")
    # rows without an id have no postings: every rule is tried, where they are
    docs = known.unionByName(docs.where("doc_id IS NULL").withColumn("kinds", F.array(*(F.lit(r.kind) for r in rules))))
    none = F.array().cast(SPANS)
    found = [matches(F.col("text"), r, i) if r.kind in full else F.when(F.array_contains("kinds", r.kind), matches(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return docs.select("doc_id", F.sort_array(F.concat(*(F.coalesce(x, none) for x in found))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < BASE)
    return found.select(
        "doc_id",
        *(F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = f"({_cased(rule)})({rule.tail})".replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS p FROM d")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM m),
s AS (SELECT *, CAST(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM u),
f AS (SELECT doc_id, kind, rank, e - length(replace(piece, chr(2), '')) AS b, e FROM s WHERE i % 2 = 0 AND length(split_part(piece, chr(2), 2)) >= least),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('assign', 'access', 'hex'))}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < {BASE}) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
